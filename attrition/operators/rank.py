"""Global ranking and running sums without a single-partition window.

``ROW_NUMBER``/``NTILE`` or a running sum over a global order make Spark
gather every row in one task (``Exchange SinglePartition``).  Here the rows
are range-partitioned on the full sort key (ties broken by a unique key, so
a heavily tied value is split across partitions too), sorted inside each
partition and numbered locally.  That numbered table is checkpointed once:
range boundaries come from a sample whose input order is not deterministic,
so the per-partition counts and the row positions must be read from the
same materialised copy (it also cuts the lineage, so a lost executor does
not force a re-sort).  Positions are then shifted by the totals of the
preceding partitions; that offset table has one row per partition, so its
broadcast is bounded by the partition count, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row index


def _sort_cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _numbered(df: DataFrame, order: Sequence, num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _sort_cols(order)
    numbered = (df.repartitionByRange(n_parts, *cols)
                  .sortWithinPartitions(*cols)
                  .withColumn("_mid", F.monotonically_increasing_id()))
    numbered = (numbered.withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
                        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    checkpoint_dir(spark)
    return numbered.checkpoint(eager=True)


def global_rank(df: DataFrame, order: Sequence, rank_col: str = "_rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position ``rank_col`` of each row in ``order`` and the
    total row count ``_n``.  ``order`` must be a total order (end with a
    unique key), e.g. ``[F.col('revenue').asc(), F.col('customer_id').asc()]``.
    """
    numbered = _numbered(df, order, num_partitions)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: prefix sums over a bounded, tiny table
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"),
    )
    ranked = numbered.join(F.broadcast(offsets), "_pid")
    return (ranked.withColumn(rank_col, (F.col("_offset") + F.col("_local")).cast("bigint"))
                  .drop("_mid", "_pid", "_local", "_offset"))


@dataclass(frozen=True)
class _Cut:
    """The key at a position of one order is sought among ``count`` keys of [low, high), ``before`` keys in front of them."""

    order: int
    position: int
    low: tuple | None = None
    high: tuple | None = None
    before: int = 0
    count: int = 0


def _key_lit(key: tuple) -> Column:
    return F.struct(F.lit(key[0]).cast(KEY_TYPE).alias("v"), F.lit(key[1]).cast("bigint").alias("u"))


KEY_TYPE = "decimal(30,2)"


def multi_ntile(df: DataFrame, orders: dict[str, Column], k: int, unique: str, final: int = 4096, sample: int = 512, splitters: int = 32) -> DataFrame:
    """NTILE(k) columns of several orders at once, without sorting the rows.

    ``orders`` names the output columns and gives the ascending sort values (numbers of two decimals at most; the unique
    whole-number column breaks ties).  A tile begins at a known position, so only the keys at the k - 1 positions of each order
    are needed.  They are selected: all rows are counted between splitters from a sample, and the interval that
    holds a position is sampled and counted again until it has at most ``final`` keys, of which the right one is taken.
    Every round is one pass for all orders, over the rows of open intervals only; a round divides an interval by about
    ``splitters``, ties included, as splitters are whole keys.  The driver holds splitters, counts and cuts, whose number
    depends on ``k`` and the number of orders.  One narrow copy is checkpointed; the tiles come from comparing with the cuts.
    """
    spark = df.sparkSession
    names = list(orders)
    keys = [F.struct(orders[n].cast(KEY_TYPE).alias("v"), F.col(unique).cast("bigint").alias("u")) for n in names]
    checkpoint_dir(spark)
    rows = df.select("*", *[x.alias(f"_key{i}") for i, x in enumerate(keys)]).checkpoint(eager=True)
    total = rows.count()
    q, m = divmod(total, k)
    starts = [j * q + min(j, m) for j in range(1, k)]
    cuts = [_Cut(i, p, count=total) for i in range(len(names)) for p in starts if p < total]

    def inside(intervals: list[tuple]) -> DataFrame:
        """The keys of each interval: ``iv`` (its number) and ``key``."""
        marks = []
        for n, (i, low, high) in enumerate(intervals):
            key = F.col(f"_key{i}")
            there = F.lit(True) if low is None else key >= _key_lit(low)
            there = there if high is None else there & (key < _key_lit(high))
            marks.append(F.when(there, F.struct(F.lit(n).alias("iv"), key.alias("key"))))
        return rows.select(F.explode(F.array_compact(F.array(*marks))).alias("x")).select("x.iv", "x.key")

    def key_of(r) -> tuple:
        return (r["v"], r["u"])

    while any(x.count > final for x in cuts):
        intervals = sorted({(x.order, x.low, x.high) for x in cuts if x.count > final}, key=str)
        number = {iv: n for n, iv in enumerate(intervals)}
        keyed = inside(intervals)
        by_hash = Window.partitionBy("iv").orderBy(F.xxhash64("key.u"), "key")
        drawn = keyed.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= sample).select("iv", "key").collect()
        splits = []
        for n in range(len(intervals)):
            mine = sorted(key_of(r["key"]) for r in drawn if r["iv"] == n)
            splits.append(sorted({mine[j * len(mine) // splitters] for j in range(1, splitters)}))
        table = F.array(*[F.array(*map(_key_lit, s)) for s in splits])
        part = F.size(F.filter(F.get(table, F.col("iv")), lambda s: s <= F.col("key")))
        counted = {(r["iv"], r["part"]): r["count"] for r in keyed.select("iv", part.alias("part")).groupBy("iv", "part").count().collect()}
        narrowed = []
        for x in cuts:
            if x.count > final:
                n = number[x.order, x.low, x.high]
                at, edges = x.before, [x.low, *splits[n], x.high]
                for j in range(len(edges) - 1):
                    size = counted.get((n, j), 0)
                    if at + size > x.position:
                        x = _Cut(x.order, x.position, edges[j], edges[j + 1], at, size)
                        break
                    at += size
            narrowed.append(x)
        cuts = narrowed

    intervals = sorted({(x.order, x.low, x.high) for x in cuts}, key=str)
    found: dict[tuple, tuple] = {}
    if intervals:
        wanted = [(n, x.position - x.before + 1, x.order, x.position) for x in cuts for n in [intervals.index((x.order, x.low, x.high))]]
        in_order = Window.partitionBy("iv").orderBy("key")  # at most ``final`` keys each
        hit = F.array(*[F.struct(F.lit(n).alias("a"), F.lit(r).alias("b")) for n, r, _, _ in wanted])
        numbered = inside(intervals).withColumn("_r", F.row_number().over(in_order))
        taken = numbered.where(F.array_contains(hit, F.struct(F.col("iv").alias("a"), F.col("_r").alias("b")))).collect()
        at = {(r["iv"], r["_r"]): key_of(r["key"]) for r in taken}
        found = {(i, p): at[n, r] for n, r, i, p in wanted}
    tiles = []
    for i, name in enumerate(names):
        reached = [F.when(F.col(f"_key{i}") >= _key_lit(found[i, p]), 1).otherwise(0) for p in starts if (i, p) in found]
        tiles.append((sum(reached, F.lit(1))).cast("int").alias(name))
    return rows.select(*[F.col(f"`{x}`") for x in df.columns], *tiles)


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """SQL NTILE(k) bucket (1-based) of a 0-based position in n rows.

    The first n mod k buckets hold q+1 rows, the rest q rows (q = n div k).
    """
    q = F.floor(n / F.lit(k)).cast("bigint")
    m = (n % F.lit(k)).cast("bigint")
    big = m * (q + 1)
    return (F.when(q == 0, rank + 1)
             .when(rank < big, F.floor(rank / (q + 1)) + 1)
             .otherwise(F.floor((rank - big) / F.greatest(q, F.lit(1))) + m + 1)).cast("int")


def global_ntile(df: DataFrame, order: Sequence, k: int, out_col: str,
                 num_partitions: int | None = None) -> DataFrame:
    ranked = global_rank(df, order, "_r", num_partitions)
    return ranked.withColumn(out_col, ntile_from_rank(F.col("_r"), F.col("_n"), k)).drop("_r", "_n")


def prefix_sum(df: DataFrame, order: Sequence, value_col: str, out_col: str,
               num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` in ``order``, distributed."""
    numbered = _numbered(df, order, num_partitions)
    wl = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    local = numbered.withColumn("_local_sum", F.sum(value_col).over(wl))
    totals = numbered.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(out_col, F.col("_off") + F.col("_local_sum"))
                 .drop("_mid", "_pid", "_local", "_local_sum", "_off"))


def grouped_running_sums(df: DataFrame, group_cols: Sequence[str], order: Sequence, value_cols: Sequence[str],
                         suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of several columns in ``order`` within each group.

    One distributed pass over the global order (groups first), then each
    group's starting totals are subtracted.  The start table has one row per
    group (models, metrics: a handful), so it is broadcast.
    """
    numbered = _numbered(df, [*[F.col(g).asc() for g in group_cols], *order], num_partitions)
    wl = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    local = numbered.select("*", *[F.sum(v).over(wl).alias(f"_l_{v}") for v in value_cols])
    totals = numbered.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}")
                                      for v in value_cols])
    g = local.join(F.broadcast(offsets), "_pid").select(
        "*", *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{v}{suffix}") for v in value_cols])
    if group_cols:
        starts = g.groupBy(*group_cols).agg(
            *[F.min(F.col(f"{v}{suffix}") - F.col(v)).alias(f"_s_{v}") for v in value_cols])
        out = g.join(starts, list(group_cols))
        for v in value_cols:
            out = out.withColumn(f"{v}{suffix}", F.col(f"{v}{suffix}") - F.col(f"_s_{v}"))
    else:
        out = g  # a single group starts at 0
    drop = ["_mid", "_pid", "_local"] + [f"_{p}_{v}" for v in value_cols for p in ("l", "o", "s")]
    return out.drop(*drop)


def grouped_percentiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                        probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact percentiles with linear interpolation (position (n-1)p between
    the neighbouring order statistics), per group, without gathering a
    group's values in one task.

    Values are counted per (group, value), the counts get distributed running
    sums in value order, and each wanted order statistic is the value whose
    cumulative range covers its position.  The per-group totals table has one
    row per group and is broadcast (callers group by a handful of keys).
    """
    v = F.col(value_col).cast("double")
    per = (df.where(F.col(value_col).isNotNull())
             .groupBy(*group_cols, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    cum = grouped_running_sums(per, list(group_cols), [F.col("_v").asc()], ["_c"])
    # the totals come from the numbered copy: the input is not computed again
    if group_cols:
        tot = cum.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
        j = cum.join(tot, list(group_cols))
    else:
        j = cum.withColumn("_n", cum.select(F.sum("_c")).scalar())
    lo_start = F.col("_c_cum") - F.col("_c")
    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((lo_start <= lo) & (lo < F.col("_c_cum")), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((lo_start <= hi) & (hi < F.col("_c_cum")), F.col("_v"))).alias(f"_hi_{name}"))
        aggs.append(F.max(pos - lo).alias(f"_d_{name}"))
    g = j.groupBy(*group_cols).agg(*aggs)
    return g.select(*group_cols, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_d_{n}")).alias(n) for n in names])


def grouped_median(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str = "median") -> DataFrame:
    return grouped_percentiles(df, group_cols, value_col, [0.5], [name])
