"""The similarity join against all pairs, on planted copies, dense groups and the edge cases."""

import random

import numpy as np
import pytest

from attrition.llm import ngram_join as nj
from attrition.llm.queries import QUERIES, SQL
from tests.llm.conftest import SF


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Per row: class members (row numbers) and links, over all pairs."""
    sets = [grams(r[1]) for r in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
            for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return root, [len(x) for x in near]


def stored(spark, df, tmp_path):
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


def check(spark, make_docs, tmp_path, rows, plan=nj.JoinPlan()):
    out = {r["doc_id"]: r for r in nj.similarity_join(stored(spark, make_docs(rows, extra="n_links"), tmp_path), plan).collect()}
    root, links = brute(rows)
    assert len(out) == len(rows)
    for (i, *_), r, n in zip(rows, root, links, strict=True):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == r]
        assert (out[i]["class_id"], out[i]["n_links"], out[i]["class_first"]) == (min(ids), n, i == min(ids)), i


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10 ** 6)}"
    return " ".join(words)


def test_query_equals_sql(spark):
    from attrition.plans.verify import compare, duckdb_connection
    out = compare(QUERIES["op4_ngram_join"](spark, SF), duckdb_connection(SF), SQL["op4_ngram_join"])
    assert out["match"], out


def test_planted_copies_common_passage_and_dense_group(spark, make_docs, tmp_path):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        base = [word() for _ in range(rnd.randrange(5, 200))]
        rows += [(len(rows) + k, edited(rnd, base, e)) for k, e in enumerate((0, 0, 1, 2, 4))]
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(40)])) for k in range(80)]
    dense = [word() for _ in range(150)]
    rows += [(len(rows) + k, edited(rnd, dense, 2)) for k in range(90)]
    # small limits: buckets split, and the dense group is compared in blocks
    check(spark, make_docs, tmp_path, rows, nj.JoinPlan(bucket=8, block=25))


def test_edge_cases(spark, make_docs, tmp_path):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "a b c d"), (7, "a b c d"), (8, "a b c e"), (9, long),
            (10, long + " tail"), (11, "a b c d e f"), (12, "a b\nc  d\te f")]
    check(spark, make_docs, tmp_path, rows)


def test_null_and_repeated_ids(spark, make_docs, tmp_path):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (7, text), (None, "other words stand in this one here"), (9, text + " z")]
    out = nj.similarity_join(stored(spark, make_docs(rows), tmp_path)).collect()
    same = [r for r in out if r["n_links"] == 4]
    assert len(out) == 6 and len(same) == 5 and {r["class_id"] for r in same} == {7} and sum(r["class_first"] for r in same) == 1
    (alone,) = [r for r in out if r["n_links"] == 0]
    assert alone["class_id"] is None and alone["class_first"]


def test_empty_table(spark, make_docs, tmp_path):
    assert nj.similarity_join(stored(spark, make_docs([]), tmp_path)).collect() == []


def test_plan_reaches_its_recall():
    plan = nj.JoinPlan()
    assert (1 - plan.run_recall()) ** plan.runs() <= 1 - plan.recall and plan.runs() < nj.TOKENS // 2
    hit = []
    rnd = np.random.default_rng(1)
    for _ in range(300):  # similarity 0.8: 160 of 200 tokens shared
        t = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = nj.sampled_tokens(np.sort(t[:180])), nj.sampled_tokens(np.sort(np.concatenate([t[:160], t[180:]])))
        hit.append((a == b).mean())
    assert abs(np.mean(hit) - 0.8) < 0.02


def test_components_of_a_long_chain(spark):
    n = 40
    edges = [(bytes([(i * 7) % n]), bytes([((i + 1) * 7) % n])) for i in range(n - 1)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf1")]
    out = dict(map(tuple, nj.components(spark.createDataFrame(edges, "a binary, b binary")).collect()))
    assert {bytes(v) for k, v in out.items() if bytes(k) < b"\xf0"} == {b"\0"} and len(out) == n + 2
    assert bytes(out[b"\xf1"]) == b"\xf0"


@pytest.mark.parametrize("rows,block,across,want", [
    (5, [0] * 5, False, {(i, j) for i in range(5) for j in range(i + 1, 5)}),
    (4, [0, 1, 0, 1], True, {(0, 1), (0, 3), (2, 1), (2, 3)}), (1, [0], False, set()), (3, [2, 2, 2], True, set())])
def test_pairs_of_a_cell(rows, block, across, want):
    got = [p for i, j in nj._pairs(rows, np.array(block), across, chunk=3) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want)
