"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of input partition p go to shard s follows a multivariate
hypergeometric law with the partition sizes as row sums and the wanted shard
sizes as column sums.  The matrix is never built whole: a binary tree over the
partitions splits the shards' rows between its two halves with one seeded draw
per node, so a task finds the matrix row of its own partition with
shards * log2(partitions) draws, the same row however often it is run.

1. count the rows of each input partition (one long per partition to the driver);
2. permute locally: a partition's rows are sorted by a keyed hash; the first
   A[p, 0] go to shard 0, the next A[p, 1] to shard 1, and so on;
3. exchange by (shard, cell); a cell is a hash-chosen part of a shard that fits
   a task, so a shard may be larger than any machine;
4. permute again: a cell's rows are sorted by another keyed hash.  A row's slot
   is the number of rows in the shard's earlier cells plus its rank; the rows
   per cell are counted before, over the key columns only, and stay a table.

Every slot is hit exactly once, shard sizes differ by one row at most, and no
key of the data decides where a row goes, so there are no hot keys.  Both
permutations depend on the rows' content only, not on the order in which a task
happens to read them, so a recomputed task repeats its result.  The input must
put the same rows into the same partitions when it is read again: a stored
table or a written frame, not the direct outcome of another exchange; a task
that finds another number of rows than were counted stops the job.

Defined cases: equal rows are moved one by one; null keys hash like any value;
a text of any length moves whole; an empty table gives an empty result; all columns of the input are kept, but
columns named like an output column (``shard``, ``slot``) are replaced.
"""

from __future__ import annotations

from math import floor, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

_INDEX_BITS = 33  # monotonically_increasing_id: partition above, row number below


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard, at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement; ratio of uniforms beyond the sampler's range."""
    if not good or not draws:
        return 0
    if not bad or draws == good + bad:
        return min(good, draws)
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    total, few, take = good + bad, min(good, bad), min(draws, good + bad - draws)

    def weight(x: int) -> float:
        return -(lgamma(x + 1) + lgamma(few - x + 1) + lgamma(take - x + 1) + lgamma(total - few - take + x + 1))

    share = few / total
    centre = take * share + 0.5
    width = sqrt((total - take) * take * share * (1 - share) / (total - 1) + 0.5)
    scale = 1.7155277699214135 * width + 0.8989161620588988  # fixed values: 2 sqrt(2/e) and 3 - 2 sqrt(3/e)
    top = weight(floor((take + 1) * (few + 1) / (total + 2)))
    end = min(min(take, few) + 1, floor(centre + 16 * width))
    while True:
        u = 1 - rng.random()
        place = centre + scale * (rng.random() - 0.5) / u
        if 0 <= place < end and 2 * log(u) <= weight(floor(place)) - top:
            break
    x = floor(place)
    x = x if good <= bad else take - x
    return x if take == draws else good - x


def _split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` rows drawn without replacement from classes of these sizes, how many are of each class."""
    out, rest = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for s, m in enumerate(map(int, sizes)):
        rest -= m
        out[s] = hypergeometric(rng, m, rest, n)
        n -= int(out[s])
    return out


def matrix_row(p: int, ends: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row ``p`` of the communication matrix; ``ends``: running sum of the partition sizes from 0."""
    low, high, node = 0, len(ends) - 1, 1
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(np.random.default_rng((seed, node)), sizes, int(ends[mid] - ends[low]))
        if p < mid:
            sizes, high, node = left, mid, 2 * node
        else:
            sizes, low, node = sizes - left, mid, 2 * node + 1
    return sizes


def _permuted(rows: DataFrame, keys: tuple[str, ...], seed: int, whole_row: bool) -> DataFrame:
    """Each partition sorted by a keyed hash, with the row's partition and number in it."""
    order = [F.xxhash64(F.lit(seed), *keys)]
    if whole_row:  # equal keys in a fixed order, so that a recomputed task repeats its choice
        order.append(F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in rows.columns]))
    place = F.monotonically_increasing_id()
    return rows.sortWithinPartitions(*order).withColumn("_llm_at", place)


def uniform_shards(rows: DataFrame, shards: int, keys: tuple[str, ...] = ("doc_id",), seed: int = 20,
                   rows_per_cell: int = 1 << 14) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard)."""
    rows = rows.drop("shard", "slot")
    counted = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one row per partition
    sizes = np.zeros(1 + max([0, *(r["p"] for r in counted)]), np.int64)
    for r in counted:
        sizes[r["p"]] = r["count"]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    wanted = shard_sizes(int(ends[-1]), shards)
    cells = max(1, -(-int(ends[-1]) // (shards * rows_per_cell)))

    @F.pandas_udf("int")
    def shard_of(at: pd.Series) -> pd.Series:
        number, p = at.to_numpy(), at.to_numpy() >> _INDEX_BITS
        out = np.zeros(len(number), np.int32)
        for part in np.unique(p):
            here = p == part
            border = np.cumsum(matrix_row(int(part), ends, wanted, seed))
            index = number[here] & ((1 << _INDEX_BITS) - 1)
            if index.max() >= border[-1]:
                raise ValueError(f"partition {part} has more rows than the {border[-1]} counted before")
            out[here] = np.searchsorted(border, index, side="right")
        return pd.Series(out)

    # by the row's place, which both passes share, so that a cell is filled evenly whatever the keys are
    cell = F.pmod(F.xxhash64(F.lit(seed + 2), "_llm_at"), F.lit(cells)).cast("int")

    def placed(frame: DataFrame, whole_row: bool) -> DataFrame:
        return (_permuted(frame, keys, seed, whole_row).withColumn("shard", shard_of("_llm_at"))
                .withColumn("_llm_cell", cell).drop("_llm_at"))

    # rows in the shard's earlier cells, from the key columns alone: a small table beside the rows, joined on the
    # partitioning that the second permutation needs anyway; a shard's cells are one row each per ``rows_per_cell`` rows
    filled = written(placed(rows.select(*keys), False).groupBy("shard", "_llm_cell").count(), "cells")
    earlier = Window.partitionBy("shard").orderBy("_llm_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = filled.select("shard", "_llm_cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_llm_first"))

    moved = placed(rows, True)
    again = Window.partitionBy("shard", "_llm_cell").orderBy(
        F.xxhash64(F.lit(seed + 3), *keys), F.xxhash64(F.lit(seed + 4), *[F.col(f"`{c}`") for c in rows.columns]))
    ranked = moved.withColumn("_llm_rank", F.row_number().over(again)).join(first.hint("merge"), ["shard", "_llm_cell"], "left")
    return ranked.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col("_llm_first") + F.col("_llm_rank") - 1).alias("slot"))
