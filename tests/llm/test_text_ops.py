"""Quality rules, sharding and token counts against brute force, with the edge cases their docstrings define."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attrition.llm import quality_rules as qr
from attrition.llm import sharding, token_counts as tc
from attrition.llm.queries import QUERIES, SQL
from tests.llm.conftest import SF

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def brute_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\x0c\x85\xa0#|日 ", max_size=60))
def test_measures_equal_the_definitions(text):
    assert qr.measure(text.encode()) == brute_measures(text)


def test_quality_query_equals_sql(spark):
    from attrition.plans.verify import compare, duckdb_connection
    out = compare(QUERIES["op1_quality_rules"](spark, SF), duckdb_connection(SF), SQL["op1_quality_rules"])
    assert out["match"], out


def test_host_verdict_needs_evidence_and_reaches_the_documents(make_docs):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short text"
    rows = [(i, good, f"h{i % 10}") for i in range(400)] + [(1000 + i, bad, "farm") for i in range(300)]
    rows += [(2000, good, "farm"), (3000, bad, "tiny"), (3001, good, "tiny"), (4000, good, None), (None, None, None)]
    out = {r["doc_id"]: r for r in qr.quality_rules(make_docs(rows)).collect()}
    assert out[2000]["host_rejected"] and not out[2000]["base_failed"] and not out[2000]["kept"]
    assert out[3001]["kept"] and not out[3000]["kept"] and out[4000]["kept"]
    assert all(out[i]["kept"] for i in range(400))
    assert out[None]["n_words"] == 0 and out[None]["base_failed"]


def test_quality_of_an_empty_table(make_docs):
    assert qr.quality_rules(make_docs([])).collect() == []


def check_shards(rows, n, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n and sorted(map(len, by.values())) == sorted(x for x in sharding.shard_sizes(n, shards) if x)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_exact_and_repeatable(spark, docs):
    many = docs.repartition(7).select("*")
    path = __import__("tempfile").mkdtemp(prefix="shards-") + "/t"
    many.write.parquet(path)
    many = spark.read.parquet(path)
    first = sharding.uniform_shards(many, 8, rows_per_cell=10).collect()
    check_shards(first, 200, 8)
    again = sharding.uniform_shards(many, 8, rows_per_cell=10).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    other = sharding.uniform_shards(many, 8, seed=99).collect()
    assert {r["doc_id"]: r["shard"] for r in first} != {r["doc_id"]: r["shard"] for r in other}


def test_sharding_query_carries_whole_texts(spark, docs):
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = QUERIES["op2_sharding"](spark, SF).collect()
    check_shards(rows, len(want), 8)
    for r in rows:
        raw = want[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_sharding_edge_cases(make_docs):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 200_000), (2, None)]
    out = sharding.uniform_shards(make_docs(rows, extra="shard"), 8).collect()
    check_shards(out, 5, 8)
    assert sharding.uniform_shards(make_docs([]), 8).collect() == []


def test_cells_are_filled_evenly_whatever_the_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 4000, 1, 4).selectExpr("cast(if(id % 3 = 0, null, id) as bigint) as doc_id", "'same' as text").write.parquet(path)
    out = sharding.uniform_shards(spark.read.parquet(path), 2, rows_per_cell=200)
    check_shards(out.collect(), 4000, 2)
    # rows of one key are spread over the slots of a shard: in one cell of ten, all 667 would stand together
    nulls = sorted(r["slot"] for r in out.filter("doc_id is null and shard = 0").collect())
    assert np.histogram(nulls, bins=10, range=(0, 2000))[0].max() < 0.2 * len(nulls)


def test_matrix_rows_add_up_and_are_uniform():
    ends, wanted = np.cumsum([0, 30, 0, 11, 59]), np.array([34, 33, 33])
    total = np.zeros((4, 3))
    for seed in range(300):
        m = np.array([sharding.matrix_row(p, ends, wanted, seed) for p in range(4)])
        assert (m.sum(0) == wanted).all() and (m.sum(1) == np.diff(ends)).all()
        total += m
    expected = np.outer(np.diff(ends), wanted) / 100
    assert np.abs(total / 300 - expected).max() < 0.6


def test_large_hypergeometric_has_the_right_moments():
    rng = np.random.default_rng(5)
    good, bad, draws = 3_000_000_000, 9_000_000_000, 4_000_000
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(2000)])
    sd = (draws * 0.25 * 0.75) ** 0.5
    assert abs(x.mean() - draws * 0.25) < 5 * sd / 2000 ** 0.5 and 0.93 < x.std() / sd < 1.07


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b's", "é", "\xa0", "<|endoftext|>", "99", "##", "日", "\x1f", "́", " "]),
                max_size=40).map("".join), st.integers(1, 8))
def test_pieces_count_like_the_whole(text, limit):
    pieces = tc.safe_pieces(text, limit)
    t = tc.tokenizer(BYTE_BPE)
    assert "".join(pieces) == text
    assert sum(len(t.encode(p, add_special_tokens=False)) for p in pieces) == len(t.encode(text, add_special_tokens=False))


def test_token_query_equals_the_library(spark, docs):
    t = tc.tokenizer(BYTE_BPE)
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False)) for r in docs.collect()}
    rows = QUERIES["op3_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, "a b\n" * 60_000), (2, "a b\n" * 60_000), (3, "x" * 50_000)]])
def test_token_counts_edge_cases(make_docs, rows):
    t = tc.tokenizer(BYTE_BPE)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in
                 tc.token_counts(make_docs(rows, extra="n_tokens"), BYTE_BPE, batch_bytes=1000, piece_chars=500).collect())
    want = sorted((i or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows)
    assert got == want
