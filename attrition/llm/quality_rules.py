"""Quality rules with host verdicts.

Every document is measured and tested against the rules below.  The failures
of each rule are then counted by host (``source``), each host's rate is shrunk
towards the rate of all hosts with a beta prior fitted to the hosts' own rates
(method of moments), and a host whose shrunk rate of some rule exceeds that
rule's limit is rejected.  The verdict is joined back to the documents.

    failure rate shrunk = (failures + a) / (documents + a + b)

A host with few documents therefore stays near the common rate and is only
rejected on much evidence; a host with many keeps its own rate.

Defined cases: a null or empty text has no words and fails ``short``; a null
host is one host of its own (``NULL`` groups with ``NULL``); equal rows count
one by one; a text of any length is measured whole; with one host, or hosts of equal rates, the prior is as strong as
``MAX_STRENGTH`` documents; an empty table gives an empty result.  A column of
the input with the name of an output column is not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, kept_columns, pieces_by_bytes, written

WHITE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Keys a host is spread over when verdicts are joined back.
HOST_SALTS = 64
#: Prior strength (in documents) when the hosts' rates vary no more than chance.
MAX_STRENGTH = 1000


@dataclass(frozen=True)
class HostRules:
    """Largest shrunk failure rate of a host, by rule."""

    limits: dict[str, float] = field(default_factory=lambda: {
        "short": 0.8, "repeats": 0.8, "symbols": 0.8, "dup_lines": 0.8})


def rule_failures() -> dict[str, Column]:
    """Each rule as a condition on the measures; the first two form ``base_failed``."""
    c = F.col
    return {"short": c("n_words") < 50,
            "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
            "symbols": 10 * c("n_symbols") > c("n_words"),
            "dup_lines": 10 * c("n_dup_lines") > c("n_words")}


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more (``numbers``: one per word, equal for equal words)."""
    n = len(numbers)
    if n < 4:
        return 0
    pair = np.unique(numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:], return_inverse=True)[1]
    window = pair[:-1] * (int(numbers.max()) + 1) + numbers[2:]
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    hit = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The measures of one UTF-8 text, in the order of MEASURES."""
    words = text.split()  # bytes.split cuts exactly at \x20 and \x09-\x0D
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, _NOT_COUNTED)), len(text.translate(None, _NOT_SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(numbers) if len(number) < len(words) else 0)


def document_measures(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns and the measures of every whole text; a map without shuffle."""
    source = docs.select(*keep, F.col(text).alias("_llm_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", 1 << 23):
                found = np.array([measure(t) for t in as_bytes(batch.column("_llm_text"))], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in found.T)],
                                                 names=[*keep, *MEASURES])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return bounded_batches(source).mapInArrow(run, kept + ", ".join(f"{m} bigint" for m in MEASURES))


def host_counts(measured: DataFrame, host: str = "source") -> DataFrame:
    """Documents and failures of each rule, by host (partial sums before the shuffle)."""
    fails = [F.sum(F.when(cond, 1).otherwise(0)).alias(f"k_{rule}") for rule, cond in rule_failures().items()]
    return measured.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *fails)


def beta_priors(hosts: DataFrame, rules: HostRules) -> DataFrame:
    """One row, ``a_<rule>`` and ``b_<rule>``: the beta distribution fitted to the hosts' rates of each rule.

    Moments weighted by documents, so that many tiny hosts do not set the
    prior: the mean is m = K / N, and the spread between hosts beyond what
    drawing n documents explains gives the strength a + b = m (1 - m) / tau2.
    """
    c = F.col
    n = c("n").cast("double")
    sums = [F.sum(n).alias("N"), F.sum(n * n).alias("N2"), F.count(F.lit(1)).cast("double").alias("h")]
    for rule in rules.limits:
        k = c(f"k_{rule}").cast("double")
        sums += [F.sum(k).alias(f"K_{rule}"), F.sum(k * k / n).alias(f"Q_{rule}")]
    out = []
    for rule in rules.limits:
        m = c(f"K_{rule}") / c("N")
        # E[sum n (p - m)^2] = (h - 1) m (1 - m) + (N - N2 / N - (h - 1)) tau2
        spread = c(f"Q_{rule}") - c("N") * m * m - (c("h") - 1) * m * (1 - m)
        room = c("N") - c("N2") / c("N") - (c("h") - 1)
        strength = F.least(F.lit(float(MAX_STRENGTH)), F.coalesce(
            F.when((room > 0) & (spread > 0), m * (1 - m) * room / spread), F.lit(float(MAX_STRENGTH))))
        # half a failure and half a success keep the prior proper where a rule never or always fails
        out += [(m * strength + 0.5).alias(f"a_{rule}"), ((1 - m) * strength + 0.5).alias(f"b_{rule}")]
    return hosts.agg(*sums).select(*out)


def host_verdicts(hosts: DataFrame, rules: HostRules, host: str = "source") -> DataFrame:
    """``host``, the shrunk rate of every rule and ``host_rejected``.

    The priors are a one-row aggregate of the host table, read as a scalar
    subquery; nothing is collected.
    """
    priors = beta_priors(hosts, rules)
    prior = priors.select(F.struct(*priors.columns)).scalar()
    out, reject = hosts, F.lit(False)
    for rule, limit in rules.limits.items():
        a, b = prior.getField(f"a_{rule}"), prior.getField(f"b_{rule}")
        out = out.withColumn(f"rate_{rule}", (F.col(f"k_{rule}") + a) / (F.col("n") + a + b))
        reject = reject | (F.col(f"rate_{rule}") > limit)
    return out.withColumn("host_rejected", reject)


def quality_rules(docs: DataFrame, rules: HostRules = HostRules(), keep: tuple[str, ...] = ("doc_id",),
                  host: str = "source", text: str = "text") -> DataFrame:
    """``keep`` columns, the measures, ``base_failed``, ``host_rejected`` and ``kept``.

    The measures are written once (they feed both the host table and the
    documents).  Only rejected hosts go back to the documents, each copied to
    HOST_SALTS keys, and a document looks up the copy its own salt names, so a
    host with a third of all rows is spread over that many join keys.
    """
    keep = kept_columns(keep, (*MEASURES, "base_failed", "host_rejected", "kept"))
    columns = tuple(dict.fromkeys((*keep, host)))
    measured = written(document_measures(docs, columns, text), "quality")
    hosts = written(host_counts(measured, host), "hosts")
    rejected = (host_verdicts(hosts, rules, host).filter("host_rejected")
                .select(F.col(host).alias("_llm_host"), F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))).alias("_llm_salt")))
    c = F.col
    salted = measured.withColumn("_llm_salt", F.pmod(F.xxhash64(*MEASURES, *columns), F.lit(HOST_SALTS)).cast("int"))
    joined = salted.join(rejected.withColumn("_llm_hit", F.lit(True)),
                         c(host).eqNullSafe(c("_llm_host")) & (salted["_llm_salt"] == rejected["_llm_salt"]), "left")
    failures = rule_failures()
    base_failed = failures["short"] | failures["repeats"]
    host_rejected = F.coalesce(c("_llm_hit"), F.lit(False))
    return joined.select(*keep, *MEASURES, base_failed.alias("base_failed"), host_rejected.alias("host_rejected"),
                         (~base_failed & ~host_rejected).alias("kept"))
