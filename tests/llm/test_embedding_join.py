"""Subspace pigeonhole join against all pairs."""

import duckdb
import numpy as np
import pytest

from attrition.llm import embedding_join as E
from attrition.llm.queries import OP13_SQL, op13_embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string"


def brute(rows):
    """From the definition: cosines of all pairs, components by repeated merging."""
    units = [E.unit(v) if lab is not None else None for _, v, lab in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if float(units[i] @ units[j]) >= 0.93:
                    links[i] += 1
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((v, links[i], least, v == least))
    return sorted(out, key=str)


def run(spark, rows, plan, tmp_path, parts=5):
    path = str(tmp_path / "v")
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    assert table.schema["vec_id"].name == "vec_id"
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(table, plan).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(5)
    rows, dim = [], 24
    for k in range(150):
        rows.append((g.standard_normal(dim), 1 if k % 3 else 2))
    for seed in range(6):  # near copies around the threshold, chains included
        base = g.standard_normal(dim)
        for _ in range(25):
            rows.append((base + g.standard_normal(dim) * g.uniform(0.02, 0.45), 1))
    rows += [rows[0]] * 4 + [rows[160]] * 3
    return [(int(i), [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]


@pytest.mark.parametrize("plan", [E.SubspacePlan(), E.SubspacePlan(group=16, chunk=500), E.SubspacePlan(group=40, blocks=3), E.SubspacePlan(group=3, blocks=24)])
def test_links_components_and_counts(spark, vectors, plan, tmp_path):
    assert run(spark, vectors, plan, tmp_path) == brute(vectors)


def test_nulls_zeros_ties_and_lengths(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 2), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1),
            (11, [1.0, 0.0, 0.0], 1), (12, [-0.0, 1.0], 5), (13, [0.0, 1.0], 5), (14, [3e38, 3e38], 6), (15, [1e-40, 1e-40], 6), (16, [5.0], 7), (17, [2.0], 7), (18, [-2.0], 7)]
    assert run(spark, rows, E.SubspacePlan(), tmp_path) == brute(rows)
    assert run(spark, rows, E.SubspacePlan(group=1, blocks=2), tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], E.SubspacePlan(), tmp_path, 1) == []


def test_bytes_never_lose_a_pair():
    g = np.random.default_rng(1)
    plan = E.SubspacePlan()
    for dim in (1, 2, 5, 64, 100):
        sp = E.space(dim, plan)
        x = np.stack([E.unit(v) for v in g.standard_normal((400, dim)).tolist()])
        y = np.stack([E.unit(v) for v in (x + g.standard_normal(x.shape) * 0.37 / dim ** 0.5 * g.uniform(0, 1.2, (400, 1))).tolist()])
        near = (x * y).sum(1) >= plan.cosine
        gap = (sp.codes(x).astype(int) - sp.codes(y)) ** 2
        assert (gap.sum(1)[near] <= sp.whole).all()
        assert np.any([gap[:, s].sum(1) <= b for s, b in zip(sp.parts, sp.budgets, strict=True)], axis=0)[near].all()


def test_query_equals_sql_on_planted_copies(spark, tmp_path):
    g = np.random.default_rng(9)
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in base]
    for k in range(120):
        v = np.array(rows[k % 9][1])
        rows.append((1000 + k, (v + g.standard_normal(len(v)) * 0.03).astype(np.float32).tolist(), rows[k % 9][2]))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in op13_embedding_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert found == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({OP13_SQL})").fetchall())
    assert sum(r[1] for r in found) > 500
