"""Soft-membership mixing to target weights, in DataFrame operations only.

A classifier trained on the labelled table gives every document a posterior
over the domains ``clean``, ``low`` (low quality) and ``toxic``.  A document of
t words (its tokens here) with posterior p and rate r contributes r t p[d]
expected tokens to domain d.  Projected-gradient least squares finds rates
r >= 0 whose domain totals S match the targets T:

    minimise  sum_d (S_d - T_d)^2 / mass_d,   S_d = sum_i r_i t_i p_id

from r = 1, where mass_d is the total at rate 1.  The step of document i,
scaled by its own tokens, is r_i <- max(0, r_i - sum_d p_id (S_d - T_d) / mass_d):
it depends on the document only through p_i.  Posteriors are kept on a grid of
1 / GRID, so documents of one grid cell always have the same rate, and all that
the iterations need of the corpus is the tokens per cell, one distributed sum
over whole texts.  The iterations themselves run on that bounded array inside
one expression; no rows are collected and nothing depends on the corpus size.

Classifier: naive Bayes over the hashed distinct words of a text and four
binned shares (symbols, capitals, distinct words, length), with the features
whose frequency differs between a domain and the others by ``Z_MIN`` standard
errors.  It is fitted on at most ``max_labels`` labelled rows, those with the
smallest hash of their id; every document is scored.

Defined cases: a null or empty text has no words, the posterior of the prior
and 0 tokens; labels with a null id or null values are not used, and an id
labelled more than once takes the worst label; without labels the prior is
uniform and no feature counts; equal rows are rated alike but drawn one by one;
an empty table gives an empty result; the documents' columns are kept and
output columns replace columns of the same name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import ascii_words, written

DOMAINS = ("clean", "low", "toxic")
#: Hash buckets of words; the binned shares follow.
BUCKETS = 1 << 18
BINS = 11
#: Posteriors are multiples of 1 / GRID.
GRID = 64
Z_MIN = 5.0
SHARES = ("symbols", "capitals", "distinct words", "length")


@dataclass(frozen=True)
class MixPlan:
    """Target token weights by domain; the total is such that the clean documents' tokens fill their share.

    Documents that are of an ``unwanted`` domain with a chance above one half have rate 0, whatever the targets.
    """

    weights: dict[str, float] = field(default_factory=lambda: {"clean": 0.95, "low": 0.04, "toxic": 0.01})
    max_rate: float | None = None   # an upper bound to project on, if any
    unwanted: tuple[str, ...] = ()
    iterations: int = 200
    max_labels: int = 20_000
    smoothing: float = 0.5


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with ``_llm_n`` (words) and ``_llm_f`` (feature numbers)."""
    c = F.col
    body = F.coalesce(c(f"`{text}`"), F.lit(""))
    symbols = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑÓÍÁ", ""))
    hashed = F.transform(ascii_words(F.lower(body)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    rows = docs.withColumn("_llm_h", hashed).withColumn("_llm_d", F.array_distinct("_llm_h")).withColumn("_llm_n", F.size("_llm_h").cast("long"))
    n = F.greatest(c("_llm_n"), F.lit(1))
    shares = (10 * symbols / n, 20 * capitals / F.greatest(F.length(body), F.lit(1)), 10 * F.size("_llm_d") / n, F.log2(n.cast("double")))
    bins = [F.least(F.lit(BINS - 1), F.floor(s)).cast("int") + (BUCKETS + BINS * k) for k, s in enumerate(shares)]
    return rows.withColumn("_llm_f", F.concat("_llm_d", F.array(*bins))).drop("_llm_h", "_llm_d")


def labelled(labels: DataFrame, plan: MixPlan) -> DataFrame:
    """``_llm_label_id, domain`` of at most ``max_labels`` ids: the sample the classifier may see."""
    c = F.col
    rows = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    by_id = rows.groupBy(c("doc_id").alias("_llm_label_id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(c("t") > 0, "toxic").when(c("q") < 1, "low").otherwise("clean")
    return by_id.orderBy(F.xxhash64("_llm_label_id"), "_llm_label_id").limit(plan.max_labels).select("_llm_label_id", domain.alias("domain"))


@dataclass(frozen=True)
class Classifier:
    """Log odds against ``clean`` for each other domain: a base and one weight per feature number.

    The feature space is fixed, so the model's size is too, whatever it was fitted on.
    """

    base: dict[str, float]
    weight: dict[str, list[float]]

    @staticmethod
    def of(totals: Row, absent: Row, telling: list[Row]) -> "Classifier":
        weight = {d: [0.0] * (BUCKETS + len(SHARES) * BINS) for d in DOMAINS[1:]}
        for r in telling:
            for d in DOMAINS[1:]:
                weight[d][r["f"]] = round(r[d], 4)
        return Classifier({d: log((totals[d] + 1) / (totals["clean"] + 1)) + (absent[d] or 0.0) for d in DOMAINS[1:]}, weight)

    def scores(self, features: str) -> list[Column]:
        """Clipped log odds of a row's features, one column per domain but ``clean``."""
        out = []
        for d in DOMAINS[1:]:
            # a constant array: folded once when the query is planned, read in place by every task
            w = F.from_json(F.lit(json.dumps(self.weight[d])), "array<float>")
            out.append(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), _summed(features, self.base[d], w))))
        return out


def _summed(features: str, base: float, w: Column) -> Column:
    return F.aggregate(features, F.lit(base), lambda s, f: s + F.get(w, f))


def classifier(docs: DataFrame, labels: DataFrame, plan: MixPlan) -> Classifier:
    """The naive Bayes model of a bounded labelled sample."""
    c, a = F.col, plan.smoothing
    sample = F.broadcast(labelled(labels, plan))  # at most max_labels narrow rows
    # the sampled texts are written first, so that only theirs are measured
    texts = written(docs.select("doc_id", "text").join(sample, c("doc_id") == c("_llm_label_id")).select("domain", "text"), "sample")
    seen = written(measured(texts).select("domain", "_llm_f"), "features")
    by_domain = [F.count(F.when(c("domain") == d, 1)).alias(d) for d in DOMAINS]
    totals = written(seen.agg(*by_domain), "totals")
    total = totals.select(F.struct(*DOMAINS)).scalar()
    counts = seen.select("domain", F.explode("_llm_f").alias("f")).groupBy("f").agg(*by_domain)

    def share(k: Column, n: Column) -> Column:
        return (k + a) / (n + 2 * a)

    def log_odds(p: Column) -> Column:
        return F.log(p / (1 - p))

    n_all = reduce(lambda x, y: x + y, [total[x] for x in DOMAINS])
    k_all = reduce(lambda x, y: x + y, [c(x) for x in DOMAINS])

    def telling(d: str) -> Column:
        """The feature's frequency in d differs from that in the other domains."""
        n, k, rest, k_rest = total[d], c(d), n_all - total[d], k_all - c(d)
        pooled = share(k_all, n_all)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        return F.abs(k / F.greatest(n, F.lit(1)) - k_rest / F.greatest(rest, F.lit(1))) >= Z_MIN * spread

    # presence adds the difference of the log odds; the base holds the absence of the features that speak for d.
    # The absence of a feature that speaks against d says nothing: a short text lacks most common words.
    p = {d: share(c(d), total[d]) for d in DOMAINS}
    weights = counts.select("f", *[F.when(telling(d), F.when(p[d] > p["clean"], log_odds(p[d]) - log_odds(p["clean"])).otherwise(F.log(p[d] / p["clean"]))).otherwise(0.0).cast("float").alias(d) for d in DOMAINS[1:]],
                            *[F.when(telling(d) & (p[d] > p["clean"]), F.log((1 - p[d]) / (1 - p["clean"]))).otherwise(0.0).alias(f"absent_{d}") for d in DOMAINS[1:]])
    weights = written(weights, "weights")
    telling_rows = weights.filter(" or ".join(f"{d} <> 0" for d in DOMAINS[1:])).select("f", *DOMAINS[1:]).collect()
    return Classifier.of(totals.first(), weights.agg(*[F.sum(f"absent_{d}").alias(d) for d in DOMAINS[1:]]).first(), telling_rows)


def posterior_cells(rows: DataFrame, model: Classifier) -> DataFrame:
    """``rows`` of ``measured`` with ``_llm_cell``, the grid cell of the posterior."""
    rows = rows.withColumn("_llm_s", F.array(*model.scores("_llm_f"))).drop("_llm_f")
    low, toxic = (F.exp(F.get("_llm_s", F.lit(k))) for k in range(2))
    whole = 1 + low + toxic
    # halves are rounded down, so that the two parts never exceed 1 together
    place = [F.floor(GRID * x / whole + 0.5 - 1e-9).cast("int") for x in (low, toxic)]
    return rows.withColumn("_llm_cell", place[0] * (GRID + 1) + place[1]).drop("_llm_s")


def posterior(cell: Column) -> dict[str, Column]:
    """The posterior that a cell stands for."""
    low, toxic = F.floor(cell / (GRID + 1)) / GRID, F.pmod(cell, F.lit(GRID + 1)) / GRID
    return {"clean": F.greatest(F.lit(0.0), 1 - low - toxic), "low": low, "toxic": toxic}


def fitted_rates(cells: DataFrame, plan: MixPlan) -> DataFrame:
    """``_llm_cell, _llm_rate``: the rate of every cell, from ``_llm_cell`` and ``tokens``.

    The array of cells is bounded by the grid.  ``aggregate`` runs the
    projected-gradient steps one after another on it.
    """
    c = F.col
    parts = posterior(c("_llm_cell").cast("double"))
    # the targets alone would leave a share of the unwanted domain's cells, as the steps slow down near the optimum
    unwanted = reduce(lambda x, y: x | y, [parts[d] > 0.5 for d in plan.unwanted], F.lit(False))
    filled = cells.select(F.struct("_llm_cell", c("tokens").cast("double").alias("t"), *[parts[d].alias(d) for d in DOMAINS], unwanted.alias("out")).alias("x"))
    one = filled.agg(F.sort_array(F.collect_list("x")).alias("x"))

    def total(rates: Column, d: str) -> Column:
        return F.aggregate(F.zip_with(rates, c("x"), lambda r, x: r * x["t"] * x[d]), F.lit(0.0), lambda s, v: s + v)

    mass = {d: total(F.transform("x", lambda x: F.lit(1.0)), d) for d in DOMAINS}
    one = one.select("x", F.struct(*[F.greatest(mass[d], F.lit(1.0)).alias(d) for d in DOMAINS]).alias("mass"))
    budget = c("mass.clean") / plan.weights["clean"]
    # written, as the steps read these constants again and again
    one = written(one.select("x", "mass", F.struct(*[(budget * plan.weights[d]).alias(d) for d in DOMAINS]).alias("target")), "targets")

    def step(rates: Column, _: Column) -> Column:
        over = F.struct(*[((total(rates, d) - c(f"target.{d}")) / c(f"mass.{d}")).alias(d) for d in DOMAINS])
        # the residuals are one value a step: held in a one-element array, not computed for every cell
        def moved(g: Column) -> Column:
            new = F.zip_with(rates, c("x"), lambda r, x: F.greatest(F.lit(0.0), r - reduce(lambda p, q: p + q, [x[d] * g[d] for d in DOMAINS])))
            new = new if plan.max_rate is None else F.transform(new, lambda r: F.least(r, F.lit(float(plan.max_rate))))
            return F.zip_with(new, c("x"), lambda r, x: F.when(x["out"], 0.0).otherwise(r)) if plan.unwanted else new
        return F.flatten(F.transform(F.array(over), moved))

    start = F.transform("x", lambda x: F.lit(1.0))
    rates = F.aggregate(F.sequence(F.lit(1), F.lit(plan.iterations)), start, step)
    solved = written(one.select("x", rates.alias("r")), "rates")
    pairs = solved.select(F.explode(F.arrays_zip("x", "r")).alias("c"))
    return pairs.select(c("c.x._llm_cell").alias("_llm_cell"), c("c.r").alias("_llm_rate"))


def mixed(docs: DataFrame, labels: DataFrame, plan: MixPlan = MixPlan(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``n_tokens``, ``p_clean``, ``p_low``, ``p_toxic``, ``rate`` and ``copies``.

    The scored rows are written once: they give the tokens per cell, then the result.
    """
    c = F.col
    outputs = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    kept = [c(f"`{x}`") for x in (keep or docs.columns) if x not in outputs]
    # the row's place is part of the draw: equal rows are drawn one by one
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    model = classifier(docs, labels, plan)
    scored = posterior_cells(measured(docs.withColumn("_llm_u", chance)), model)
    rows = written(scored.select(*kept, "_llm_u", "_llm_n", "_llm_cell"), "scored")
    rates = fitted_rates(rows.groupBy("_llm_cell").agg(F.sum("_llm_n").alias("tokens")), plan)
    parts = posterior(c("_llm_cell"))
    rated = rows.join(F.broadcast(rates), "_llm_cell")  # at most one row per grid cell, (GRID + 1)^2
    # floor(rate) copies and one more with the chance of the rest, decided by the row's hash
    return rated.select(*kept, c("_llm_n").alias("n_tokens"), *[parts[d].alias(f"p_{d}") for d in DOMAINS], c("_llm_rate").alias("rate"),
                        F.floor(c("_llm_rate") + c("_llm_u")).cast("int").alias("copies"))
