"""Clashing column names in every operator and stage, repeated and null rows, and the whole pipeline."""

import collections
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrition.llm import binary_packing, common, exact_topk, mixing, ngram_join, quality_rules, token_counts
from attrition.llm.queries import OP1_SQL, OP8_SQL, OP9_SQL, op1_quality_rules, op8_warc, op9_exact_topk
from attrition.session import checkpoint_dir
from tests.llm.conftest import SF
from tests.llm.test_packing_secrets_warc import BYTES, WORDS

CLASHES = ("n_words", "kept", "n_tokens", "start", "shard", "slot", "spans", "rate", "copies", "class_id", "row", "base_failed", "_llm_row", "host_rejected",
           "domain", "cell", "ids", "length", "N_WORDS2", "class_first")


@pytest.fixture(scope="module")
def clashing(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, docs, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out, plain = stage(spark, clashing, SF), stage(spark, docs, SF)
    if name == "packing":
        assert out.columns == plain.columns and out.count() == plain.count()
        return
    assert out.columns == clashing.columns
    rows = out.collect()
    assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHES)
    if name != "mixing":  # whose draw depends on the row's place in its table
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect())


def test_operators_replace_clashing_columns(clashing):
    some = clashing.limit(5)
    keep = ("doc_id", "n_words", "kept", "n_tokens", "start", "length", "ids", "rate", "copies")
    for out, name, kind in ((quality_rules.quality_rules(some, keep=keep), "n_words", "bigint"), (token_counts.token_counts(some, BYTES, keep=keep), "n_tokens", "bigint"),
                            (binary_packing.binary_pieces(some, WORDS, "words", keep=keep), "start", "bigint")):
        assert dict(out.dtypes)[name] == kind and len(out.columns) == len(set(out.columns)) and out.count() >= 5


def test_warc_query_on_repeated_pages(spark, tmp_path):
    long, other = "x" * 200, "y" * 150
    rows = [(3, "u", long), (3, "u", long), (5, "v", long), (None, "w", long), (None, "w", other), (None, "w", other), (1, "a", "short"), (1, "a", "short"), (2, "b", None), (9, None, long)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = sorted((tuple(r[c] for c in columns) for r in op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP8_SQL})").fetchall(), key=str)
    assert collections.Counter((r[0], r[3]) for r in got)[3, "response"] == 1


def test_search_on_repeated_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.5, 0.5]),
            (50, [0.5, 0.5]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [9.0, 9.0]), (100, [float("nan"), 1.0]), (100, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    columns = ("query_id", "rank", "vec_id", "score")
    got = sorted(tuple(r[c] for c in columns) for r in op9_exact_topk(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP9_SQL})").fetchall())
    with pytest.raises(ValueError):
        exact_topk.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet")), spark.read.parquet(str(tmp_path / "embeddings.parquet")), exact_topk.VaPlan(cells=300))


def test_equal_documents_are_drawn_one_by_one(spark, make_docs, tmp_path, monkeypatch):
    make_docs([(1, "some words that repeat")] * 2000).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(mixing, "fitted_rates", lambda cells, plan: cells.select("_llm_cell", F.lit(0.25).alias("_llm_rate")))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    copies = mixing.mixed(docs, labels).agg(F.sum("copies")).first()[0]
    assert abs(copies - 500) < 5 * math.sqrt(2000 * 0.25 * 0.75)


def test_a_plan_that_needs_too_many_runs_is_refused():
    with pytest.raises(ValueError):
        ngram_join.JoinPlan(similarity=0.3).runs()


def test_row_filter_keeps_every_wanted_row(spark, monkeypatch):
    wanted = spark.range(0, 4000, 7).select((F.col("id") * 8589934592 + 3).alias("row"))
    every = spark.range(0, 4000).select((F.col("id") * 8589934592 + 3).alias("row"))
    for most in (1 << 26, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", most)
        maps, same, hit = common.row_filter(wanted, "row")
        passed = {r["row"] for r in every.join(maps, same).filter(hit).select("row").collect()}
        assert {r["row"] for r in wanted.collect()} <= passed and len(passed) < 1200


def test_run_equals_the_stages_and_leaves_only_its_result(spark, docs, tmp_path):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("llm-")]) == 1
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(tuple, out.drop("sequence_id").collect())) == sorted(map(tuple, kept.drop("sequence_id").collect()))


def test_host_verdicts_equal_sql_where_they_decide(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    marked = " ".join(f"#word{i}" for i in range(60))
    repeated = "\n".join(["the same line again and again"] * 12)
    rows = [(k, good, "huge") for k in range(400)]                                        # a third of all rows
    rows += [(1000 + k, marked if k % 20 else good, "marked") for k in range(300)]        # breaks a rule that is no base rule
    rows += [(2000 + k, "short" if k % 10 else good, "short") for k in range(200)]
    rows += [(3000 + k, repeated if k % 25 else good, None) for k in range(200)]          # the null host
    rows += [(4000 + k, marked, "few") for k in range(2)] + [(5000 + k, good if k % 2 else "x", f"h{k % 7}") for k in range(100)] + [(None, None, "h1")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = op1_quality_rules(spark, str(tmp_path))
    columns = ", ".join(found.columns)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({OP1_SQL})").fetchall(), key=str)
    verdict = {(None if i is None else i // 1000): r for i, r in ((r["doc_id"], r["host_rejected"]) for r in found.collect())}
    assert verdict[1] and verdict[2] and verdict[3] and not verdict[0] and not verdict[4] and not verdict[5]
    assert any(not r["base_failed"] and not r["kept"] for r in found.collect())


def test_posteriors_equal_a_plain_naive_bayes(spark, tmp_path):
    """The classifier's cells against the same model written with dictionaries."""
    import numpy as np
    rnd = np.random.default_rng(3)
    vocabulary = {"clean": [f"c{k}" for k in range(40)], "low": [f"l{k}" for k in range(15)], "toxic": [f"t{k}" for k in range(15)]}
    rows, labels = [], []
    for i in range(360):
        domain = ("clean", "clean", "low", "toxic")[i % 4]
        words = [*rnd.choice(vocabulary["clean"], 30), *rnd.choice(vocabulary[domain], 25)]
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, int(domain != "low"), int(domain == "toxic")))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = mixing.MixPlan()
    out = {r["doc_id"]: (r["p_low"], r["p_toxic"]) for r in mixing.mixed(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}

    feats = {r["doc_id"]: set(r["_llm_f"]) for r in mixing.measured(docs).select("doc_id", "_llm_f").collect()}
    of = {i: "toxic" if t else "low" if q < 1 else "clean" for i, q, t in labels}
    n = collections.Counter(of.values())
    count = {d: collections.Counter(f for i in of if of[i] == d for f in feats[i]) for d in mixing.DOMAINS}
    share = lambda k, m: (k + plan.smoothing) / (m + 2 * plan.smoothing)
    odds = lambda p: math.log(p / (1 - p))
    weight, base = {d: {} for d in mixing.DOMAINS[1:]}, {}
    total = sum(n.values())
    for d in mixing.DOMAINS[1:]:
        base[d] = math.log((n[d] + 1) / (n["clean"] + 1))
        for f in {f for c in count.values() for f in c}:
            k, everywhere = count[d][f], sum(c[f] for c in count.values())
            pooled = share(everywhere, total)
            spread = math.sqrt(pooled * (1 - pooled) * (1 / n[d] + 1 / (total - n[d])))
            if abs(k / n[d] - (everywhere - k) / (total - n[d])) < mixing.Z_MIN * spread:
                continue
            p, clean = share(k, n[d]), share(count["clean"][f], n["clean"])
            weight[d][f] = odds(p) - odds(clean) if p > clean else math.log(p / clean)
            base[d] += math.log((1 - p) / (1 - clean)) if p > clean else 0.0
    for i, fs in feats.items():
        score = {d: max(-50.0, min(50.0, base[d] + sum(weight[d].get(f, 0.0) for f in fs))) for d in weight}
        whole = 1 + sum(map(math.exp, score.values()))
        for d, got in zip(mixing.DOMAINS[1:], out[i], strict=True):
            assert abs(got - math.exp(score[d]) / whole) <= 1.01 / mixing.GRID
    assert np.mean([out[i][1] > 0.5 for i in out if i % 4 == 3]) > 0.9 and np.mean([max(out[i]) < 0.1 for i in out if i % 4 < 2]) > 0.9
