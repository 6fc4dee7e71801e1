"""Exact top-k by inner product with a vector-approximation file.

Vectors are integer vectors.  The approximation file holds, for every distinct
vector, one small cell number per component; a cell's borders bound the
component, so the cells bound the inner product with any query.

1. scan the cells: for each query the k best lower bounds over all vectors give
   a score that the k-th result reaches for certain;
2. scan the cells again: vectors whose upper bound is below that score are out;
3. read the exact vectors of the rest in waves, in the order of their upper
   bounds (a high bound on the product is a low bound on the distance); after a
   wave a query goes on only with those whose bound still reaches its k-th
   exact score, until none is left.

Equal vectors are one entry with its k + 1 smallest ids, repeated ids included
(one may be the query's own row): more can never be among the results, as ties
go to the smaller id.  Equal query vectors are searched once.  Queries and vectors meet in
blocks: a block of queries and a block of cells are one group of one task, so
neither side is ever broadcast or held whole.

Defined cases: a vector that is null, empty, or holds a null or non-finite
component, or has a null id, takes no part, neither as query nor as candidate;
every other row is a candidate of its own, rows that repeat an id or an id and a
vector too, and every query row has its own results; vectors of different lengths do not meet; fewer than k candidates give
fewer results; an empty table gives an empty result; other columns are ignored.
Scores are exact while they fit a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written


@dataclass(frozen=True)
class VaPlan:
    k: int = 5
    cells: int = 32            # cells of a component, 256 at most: a cell is a byte of the file
    block: int = 8192          # distinct vectors of a block, about: a block meets the queries of a query block in one task
    query_block: int = 32768   # distinct query vectors of a block, about: the file is read once for each
    wave: int = 32             # exact vectors read for a query before the stop rule is tried; each wave is 8 times the last


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``id, q``: rows that take part, with floor(scale * x) of every component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(sound, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(scale * x)).alias("q"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``key, dim, q, ids``: each distinct vector once with its ``keep`` smallest ids.

    The rank limit is applied before the shuffle too (a partial window limit),
    so a vector that a third of all rows hold sends ``keep`` ids per task.
    """
    ranked = rows.withColumn("key", F.xxhash64("q"))
    order = Window.partitionBy("key", "q").orderBy("id")
    few = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    return few.groupBy("key", "q").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("q"))


def borders(vectors: DataFrame, plan: VaPlan) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest component of each cell, by dimension: equal widths between the extremes
    (two numbers a dimension are collected)."""
    found = vectors.groupBy("dim").agg(F.min(F.array_min("q")).alias("lo"), F.max(F.array_max("q")).alias("hi")).collect()
    out = {}
    for r in found:
        low = sorted({r["lo"] + (r["hi"] + 1 - r["lo"]) * i // plan.cells for i in range(plan.cells)})
        out[r["dim"]] = np.array(low, np.int64), np.array([*(x - 1 for x in low[1:]), r["hi"]], np.int64)
    return out


def bounds(query: np.ndarray, cell: np.ndarray, edge: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, queries by vectors.

    The products are taken in doubles and widened by more than their rounding.
    """
    lo, hi = edge[0][cell].astype(float), edge[1][cell].astype(float)
    plus, minus = np.maximum(query, 0).astype(float), np.minimum(query, 0).astype(float)
    slack = (np.abs(query.astype(float)).sum(1) * max(1.0, float(np.abs(edge[0].astype(float)).max()), float(abs(edge[1][-1]))) * 1e-12)[:, None]
    return plus @ lo.T + minus @ hi.T - slack, plus @ hi.T + minus @ lo.T + slack


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def approximations(vectors: DataFrame, edges: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file: ``key, dim, block`` and one byte per component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [(np.searchsorted(edges[d][0], np.asarray(q), side="right") - 1).astype(np.uint8).tobytes()
                     for d, q in zip(b.column("dim").to_pylist(), b.column("q").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("key", "entry", "dim", "block")), pa.array(cells, pa.binary())],
                                             names=["key", "entry", "dim", "block", "cell"])

    return vectors.select("key", "entry", "dim", "block", "q").mapInArrow(run, "key bigint, entry bigint, dim int, block int, cell binary")


def _meet(queries: DataFrame, file: DataFrame, query_blocks: int, blocks: int, fn, schema: str) -> DataFrame:
    """Every block of queries with every block of the file, one group each."""
    left = queries.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = file.withColumnRenamed("block", "vb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    return left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInArrow(fn, schema)


def top_k(table: DataFrame, queries: DataFrame, plan: VaPlan = VaPlan(), vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k best other rows of ``table``."""
    k, c, spark = plan.k, F.col, table.sparkSession
    if not 1 <= plan.cells <= 256:
        raise ValueError("a cell number is one byte: 1 to 256 cells")
    entries = written(distinct_vectors(integer_vectors(table, vec_id, vector, scale), k + 1)
                      .withColumn("entry", F.monotonically_increasing_id()), "vectors")
    asked = written(integer_vectors(queries, vec_id, vector, scale).withColumn("key", F.xxhash64("q")).withColumn("asker", F.monotonically_increasing_id()), "asked")
    wanted = written(asked.select("key", "q").dropDuplicates(["key", "q"])
                     .withColumn("query", F.monotonically_increasing_id()).withColumn("dim", F.size("q")), "queries")
    blocks, query_blocks = (max(1, -(-t.count() // n)) for t, n in ((entries, plan.block), (wanted, plan.query_block)))
    edges = borders(entries, plan)
    spread = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks)).cast("int")
    entries = entries.withColumn("block", spread)
    file = written(approximations(entries, edges), "approximations")
    blocked = wanted.withColumn("qb", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(query_blocks)).cast("int"))
    sides = blocked.select("query", "q", "dim", "qb")

    def scan_lower(q: pa.Table, v: pa.Table) -> pa.Table:
        out = {"query": [], "bound": []}
        if q.num_rows and v.num_rows:
            edge, cell = edges[q.column("dim")[0].as_py()], np.frombuffer(b"".join(v.column("cell").to_pylist()), np.uint8).reshape(v.num_rows, -1)
            names, m = q.column("query").to_numpy(), _matrix(q.column("q"))
            for s in range(0, len(m), 256):
                low = bounds(m[s:s + 256], cell, edge)[0]
                # an entry stands for one candidate at least unless it is the query's own vector, so one more is kept
                best = -np.partition(-low, min(k, low.shape[1] - 1), axis=1)[:, :k + 1]
                out["query"].append(np.repeat(names[s:s + 256], best.shape[1]))
                out["bound"].append(best.ravel())
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query": join(out["query"], pa.int64()), "bound": join(out["bound"], pa.float64())})

    lows = _meet(sides, file, query_blocks, blocks, scan_lower, "query bigint, bound double")
    # the (k + 1)-th best lower bound: at least k candidates beside the query itself reach it
    best = Window.partitionBy("query").orderBy(F.desc("bound"))
    sure = written(lows.withColumn("r", F.row_number().over(best)).filter(c("r") == k + 1).select("query", c("bound").alias("sure")), "sure")

    def scan_upper(q: pa.Table, v: pa.Table) -> pa.Table:
        out = {"query": [], "entry": [], "bound": []}
        if q.num_rows and v.num_rows:
            edge, cell = edges[q.column("dim")[0].as_py()], np.frombuffer(b"".join(v.column("cell").to_pylist()), np.uint8).reshape(v.num_rows, -1)
            names, entry, m = q.column("query").to_numpy(), v.column("entry").to_numpy(), _matrix(q.column("q"))
            reach = q.column("sure").to_numpy()
            for s in range(0, len(m), 256):
                up = bounds(m[s:s + 256], cell, edge)[1]
                i, j = np.nonzero(up >= reach[s:s + 256, None])
                out["query"].append(names[s + i])
                out["entry"].append(entry[j])
                out["bound"].append(up[i, j])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query": join(out["query"], pa.int64()), "entry": join(out["entry"], pa.int64()), "bound": join(out["bound"], pa.float64())})

    certain = sides.join(sure, "query", "left").withColumn("sure", F.coalesce("sure", F.lit(float("-inf"))))
    left = written(_meet(certain, file, query_blocks, blocks, scan_upper, "query bigint, entry bigint, bound double"), "left")

    exact = entries.select("entry", "ids", c("q").alias("v"))
    # A wave takes the next candidates of each query in the order of their bounds: a limited rank, so that a task sends that many
    # rows of a query and no query's candidates are sorted whole.  ``last`` is where the query's last wave ended.
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "entry")
    scored, state, until = None, None, plan.wave
    while True:
        rest = left
        if state is not None:
            behind = (c("bound") < c("last.bound")) | ((c("bound") == c("last.bound")) & (c("entry") > -c("last.back")))
            rest = left.join(state, "query").filter(behind & (c("kth").isNull() | (c("bound") >= c("kth")))).select(*left.columns)
        now = written(rest.withColumn("at", F.row_number().over(order)).filter(c("at") <= until).drop("at"), "wave")
        if now.isEmpty():
            break
        pairs = now.join(exact, "entry").join(wanted.select("query", "q"), "query")
        wave = written(pairs.select("query", "ids", "q", "v", (c("q") == c("v")).alias("same"))
                       .mapInArrow(_products, "query bigint, score bigint, ids array<bigint>, same boolean"), "scored")
        scored = wave if scored is None else scored.unionByName(wave)
        # of the k + 1 best entries one may be the query's own vector
        best = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = scored.withColumn("r", F.row_number().over(best)).filter(c("r") == k + 1).select("query", c("score").alias("kth"))
        # a query that got fewer than the wave's rows has no more
        ends = now.groupBy("query").agg(F.min(F.struct("bound", (-c("entry")).alias("back"))).alias("last"), F.count(F.lit(1)).alias("n"))
        state = written(ends.filter(c("n") >= until).drop("n").join(kth, "query", "left"), "state")
        until *= 8

    if scored is None:
        scored = spark.createDataFrame([], "query bigint, score bigint, ids array<bigint>, same boolean")
    asking = asked.join(wanted.select("key", "q", "query"), ["key", "q"]).select("query", "asker", c("id").alias("query_id"))
    # of an entry with the query's own vector, its own row is one occurrence of its id
    own = F.array_position("ids", c("query_id")).cast("int")
    others = F.concat(F.slice("ids", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("ids", own + 1, F.size("ids")))
    named = scored.join(asking, "query").withColumn("vec_id", F.explode(F.when(c("same") & (own > 0), others).otherwise(c("ids")))).drop("ids", "same")
    final = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(final)).filter(c("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact integer inner products of ``q`` and ``v``."""
    for b in batches:
        q, v = b.column("q"), b.column("v")
        owner = np.repeat(np.arange(b.num_rows), np.diff(q.offsets.to_numpy()))
        score = np.zeros(b.num_rows, np.int64)
        np.add.at(score, owner, q.flatten().to_numpy() * v.flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(score), b.column("ids"), b.column("same")], names=["query", "score", "ids", "same"])
