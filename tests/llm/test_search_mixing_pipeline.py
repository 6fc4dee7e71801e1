"""Exact search, mixing and the pipeline against brute force, held-out labels and the edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrition.llm import exact_topk as et
from attrition.llm import mixing as mx
from attrition.llm.queries import QUERIES, SQL
from tests.llm.conftest import SF


def brute_top(rows, queries, k, scale=256):
    vec = {(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows
           if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for qi, q in vec:
        if qi in queries:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in vec if i != qi and len(v) == len(q))[:k]
            out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")


def test_search_query_equals_sql(spark):
    from attrition.plans.verify import compare, duckdb_connection
    out = compare(QUERIES["op9_exact_topk"](spark, SF), duckdb_connection(SF), SQL["op9_exact_topk"])
    assert out["match"], out


def test_search_with_ties_bad_vectors_and_many_blocks(spark):
    rnd = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)]) for i in range(150)]
    common = [rnd.gauss(0, 0.3) for _ in range(6)]
    rows += [(200 + i, list(common)) for i in range(60)] + [(300, [0.0] * 6), (301, [0.0] * 6)]
    rows += [(400, None), (401, []), (402, [1.0, None, 0, 0, 0, 0]), (403, [nan] * 6), (404, [inf, 0, 0, 0, 0, 0]), (None, common)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, -1.0]), (205, list(common)), (600, [-300.0, 5e3, 1, 0, 0, 0])]
    df = frame(spark, rows)
    for plan in (et.VaPlan(block=40, wave=2, cells=4), et.VaPlan(k=3, cells=200)):
        got = {tuple(r) for r in et.top_k(df, df.filter("vec_id % 5 = 0"), plan).collect()}
        assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, plan.k)


def test_search_of_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5])]
    df = frame(spark, rows)
    assert {tuple(r) for r in et.top_k(df, df).collect()} == brute_top(rows, {0, 50}, 5)
    assert et.top_k(df.limit(1), df.limit(1)).collect() == [] and et.top_k(df.limit(0), df.limit(0)).collect() == []


def test_cells_bound_the_products():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-100, 100, (200, 8)), rng.integers(-100, 100, (20, 8))
    low = np.unique(np.linspace(-100, 100, 9).astype(int)[:-1])
    edge = low, np.append(low[1:] - 1, 99)
    lo, hi = et.bounds(q, np.searchsorted(low, v, side="right") - 1, edge)
    exact = q @ v.T
    assert (lo <= exact).all() and (exact <= hi).all()


def test_rates_equal_a_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    cells = sorted({int(a) * (mx.GRID + 1) + int(b) for a, b in rng.integers(0, 30, (40, 2))} | {0, mx.GRID * (mx.GRID + 1), mx.GRID})
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    tokens[0] = 20_000
    low, toxic = np.array(cells) // (mx.GRID + 1) / mx.GRID, np.array(cells) % (mx.GRID + 1) / mx.GRID
    p = np.stack([1 - low - toxic, low, toxic], 1)
    for cap in (None, 1.0):
        plan = mx.MixPlan(max_rate=cap)
        df = spark.createDataFrame(list(zip(cells, tokens.tolist(), strict=True)), "_llm_cell int, tokens double")
        got = {r["_llm_cell"]: r["_llm_rate"] for r in mx.fitted_rates(df, plan).collect()}
        mass = tokens @ p
        target = mass[0] / plan.weights["clean"] * np.array([plan.weights[d] for d in mx.DOMAINS])
        r = np.ones(len(cells))
        for _ in range(plan.iterations):
            r = np.clip(r - p @ (((r * tokens) @ p - target) / mass), 0, cap)
        assert np.allclose([got[c] for c in cells], r, atol=1e-9)


def test_totals_meet_the_targets_without_a_bound(spark):
    rows = [(0, 90_000.0), (mx.GRID * (mx.GRID + 1), 8_000.0), (mx.GRID, 6_000.0), (20, 500.0)]
    plan = mx.MixPlan()
    rate = {r["_llm_cell"]: r["_llm_rate"] for r in mx.fitted_rates(spark.createDataFrame(rows, "_llm_cell int, tokens double"), plan).collect()}
    toxic = sum(t * rate[c] * (c % 65) / 64 for c, t in rows)
    low = sum(t * rate[c] * (c // 65) / 64 for c, t in rows)
    clean = sum(t * rate[c] for c, t in rows) - toxic - low
    assert abs(low / clean - 4 / 95) < 1e-3 and abs(toxic / clean - 1 / 95) < 1e-3


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    out = mx.mixed(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.filter(half), keep=("doc_id",))
    seen = out.join(labels.filter(~half), "doc_id").select("p_clean", "p_toxic", "copies", "quality", "toxic").collect()
    toxic = [r for r in seen if r["toxic"] == 1]
    clean = [r for r in seen if r["toxic"] == 0 and r["quality"] == 1]
    assert np.mean([r["p_toxic"] > 0.5 for r in toxic]) > 0.8 and np.mean([r["p_clean"] > 0.9 for r in clean]) > 0.98
    assert np.mean([r["copies"] >= 1 for r in clean]) > 0.98 and np.mean([r["copies"] for r in toxic]) < 0.3


def test_unwanted_domain_goes_however_little_there_is(spark):
    half = mx.GRID // 2
    for toxic in (10.0, 500.0, 50_000.0):
        rows = [(0, 1_000_000.0), (mx.GRID, toxic), (half + 1, toxic / 50), (half, 100.0), (mx.GRID * (mx.GRID + 1), 1_000.0)]
        cells = spark.createDataFrame(rows, "_llm_cell int, tokens double")
        rate = {r["_llm_cell"]: r["_llm_rate"] for r in mx.fitted_rates(cells, corpus_pipeline.MIX).collect()}
        assert rate[mx.GRID] == rate[half + 1] == 0 and rate[0] == rate[mx.GRID * (mx.GRID + 1)] == 1


def test_pipeline_drops_recognised_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = mx.mixed(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, corpus_pipeline.MIX, keep=("doc_id",))
    seen = out.join(labels, "doc_id").select("n_tokens", "p_toxic", "p_clean", "copies", "quality", "toxic").collect()
    recognised = [r for r in seen if r["p_toxic"] > 0.5]
    clean = [r for r in seen if r["toxic"] == 0 and r["quality"] == 1]
    print("recognised", len(recognised), "clean kept", np.mean([r["copies"] for r in clean]), "toxic kept", np.mean([r["copies"] for r in seen if r["toxic"] == 1]))
    assert recognised and all(r["copies"] == 0 for r in recognised)
    assert np.mean([r["copies"] for r in clean]) > 0.98


def test_mixing_edge_cases(spark, make_docs):
    rows = [(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "w " * 100_000)]
    docs = make_docs(rows, extra="rate")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, 1), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        out = mx.mixed(docs, some).collect()
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 0), (1, 0), (2, 3), (2, 3), (3, 100_000)]
        assert all(r["rate"] >= 0 and abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in out)
    assert mx.mixed(make_docs([]), labels).collect() == []


def test_mixing_plan_is_native(spark):
    plan = QUERIES["op10_mixing"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages_act_on_what_the_last_one_kept(spark, docs, tmp_path):
    words = " ".join(f"w{i}" for i in range(80))
    extra = [(10_001, words, "en", "s", 0), (10_002, words, "en", "s", 0), (10_003, words + " tail", "en", "s", 0), (10_004, "too short", "en", "s", 0),
             (10_005, words.upper() + ' token = "abcdef0123456789abcdef0123456789"', "en", "s", 0), (None, None, None, None, None)]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = all_docs
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append(kept)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert {10_001, 10_002, 10_003, 10_005} <= ids[0] and not {10_004, None} & ids[0]
    assert {10_001, 10_005} <= ids[1] and not {10_002, 10_003} & ids[1] and ids[2] == ids[1]
    (r,) = seen[2].filter("doc_id = 10005").collect()
    assert r["text"].endswith('token = "[SECRET]"') and r["n_chars"] == len(r["text"])
    assert 10_001 in ids[3] and ids[4] == ids[3] <= ids[2]
    assert seen[4].filter("doc_id = 10001").agg(F.sum("length"), F.max("doc_tokens")).first()[0] == seen[4].filter("doc_id = 10001").first()["doc_tokens"]


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "secret_scan", "mixing", "packing"])
def test_stages_on_an_empty_table(spark, docs, tmp_path, name):
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(str(tmp_path / "none")), SF).collect() == []
