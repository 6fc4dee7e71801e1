"""Near duplicates of labelled vectors: subspace pigeonhole join.

Unit vectors of cosine 0.93 or more are at a squared distance of at most
2 - 2 * 0.93.  The vectors are rotated by a fixed orthogonal matrix, so that
every coordinate carries a like share of a distance, and split into blocks of
few dimensions.  If a pair is within the whole budget, it is within the
proportional part of the budget (its dimensions' share) in one block at least.
So each block is range-joined under its own budget, and the union of the blocks'
pairs, each pair looked at in the first block that admits it, holds every link.

The range join of a block.  Vectors are held as one signed byte a coordinate;
rounding moves a distance by a known bound, which widens the budgets, and
clipping only shortens distances, so nothing within budget is lost.  The vectors
of a label are one cell while they are few.  For a large label the block's first
coordinates are cut into quarters around the label's mean, as many coordinates
as give cells of about ``group`` vectors; a vector is at home in one cell and
visits every later cell whose box is within the budget of it.  A cell that is
still too large (a dense cluster) is split by hash, homes of one part visiting
the later parts.  A task keeps the homes of one cell and reads its visitors as
a stream.

Two passes over cells.  The first works on bytes and marks the vectors with a
partner within the widened budget of all dimensions; only those bring their exact
vectors to the second, which takes the cosine in double precision and returns,
for each vector, its number of links and the edges of a spanning forest.  Pairs
are never listed outside a task.  Components are found over the edges.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite
component, and one with a null label, links with nothing; vectors of different
length do not meet; equal vectors of a label are one entry with a number of
copies, so repeated rows and a very common vector cost one entry; a null
``vec_id`` is allowed, a component is named by its smallest non-null id, and
``kept`` compares null-safely; components of any finite size are scaled first;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .ngram_join import _forest, components

#: Quartiles of a standard normal distribution: borders of a coordinate's four parts.
QUARTERS = np.array([-0.6745, 0.0, 0.6745])


@dataclass(frozen=True)
class SubspacePlan:
    cosine: float = 0.93
    blocks: int = 4          # of about equal dimension
    group: int = 16384       # homes of a cell, about
    chunk: int = 1 << 21     # distances held at a time

    def budget(self) -> float:
        return 2 - 2 * self.cosine + 1e-6  # the rotation rounds


@dataclass(frozen=True)
class Space:
    """Everything that depends on the dimension only."""

    rotation: np.ndarray
    scale: float               # bytes per unit; four standard deviations of a coordinate reach the end
    parts: tuple[slice, ...]
    budgets: np.ndarray        # squared, in byte units, by block
    whole: float

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(unit @ self.rotation * self.scale), -127, 127).astype(np.int8)


@lru_cache(maxsize=8)
def space(dim: int, plan: SubspacePlan) -> Space:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    sizes = [len(x) for x in np.array_split(np.arange(dim), min(plan.blocks, dim))]
    ends = np.cumsum(sizes)
    scale = 127 / 4 * dim ** 0.5
    # a difference of two rounded coordinates is off by one at most, so a distance by the root of the dimensions
    widened = lambda d: ((plan.budget() * d / dim) ** 0.5 * scale + d ** 0.5) ** 2
    return Space(q * np.sign(np.diag(r)), scale, tuple(slice(int(e - n), int(e)) for e, n in zip(ends, sizes, strict=True)),
                 np.array([widened(n) for n in sizes]), widened(dim))


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length one, in doubles; None if it takes no part."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def coded(table: DataFrame, plan: SubspacePlan, vec_id: str, vector: str, label: str) -> DataFrame:
    """Every row with its number, vector, label and, if it takes part, its entry's ``key`` and byte ``codes``."""
    source = table.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                          F.col(f"`{vector}`").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys, codes, dims = [], [], []
                for label_, v in zip(b.column("label").to_pylist(), b.column("v").to_pylist(), strict=True):
                    u = unit(v) if label_ is not None else None
                    dims.append(len(v) if u is not None else None)
                    codes.append(space(len(v), plan).codes(u).tobytes() if u is not None else None)
                    keys.append(hashlib.blake2b(b"%d:" % len(v) + (np.asarray(v, np.float64) + 0.0).tobytes() + label_.encode(), digest_size=16).digest() if u is not None else None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary())],
                                                 names=[*b.schema.names, "dim", "key", "codes"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"row bigint, id {kinds['id']}, label string, v {kinds['v']}, dim int, key binary, codes binary")


def large_labels(entries: DataFrame, plan: SubspacePlan) -> DataFrame:
    """``label, dim, depth, centre, spread`` (byte units) of labels with more than ``group`` entries."""
    c = F.col
    sizes = entries.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > plan.group)
    sizes = written(sizes.select(c("label").alias("l"), c("dim").alias("d"), "n"), "labels")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array([f"{d}:{x}" for d, x in zip(b.column("dim").to_pylist(), b.column("label").to_pylist(), strict=True)], object)
            for name in set(names.tolist()):
                x = np.stack([np.frombuffer(r, np.int8) for r in b.column("codes").filter(pa.array(names == name)).to_pylist()]).astype(np.int64)
                d, label = name.split(":", 1)
                yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([int(d)], pa.int32()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64())),
                                                  pa.array([int((x * x).sum())], pa.int64())], names=["label", "dim", "sums", "squares"])

    rows = entries.join(sizes, (c("label") == c("l")) & (c("dim") == c("d"))).select("label", "dim", "codes")
    partial = written(rows.mapInArrow(sums, "label string, dim int, sums array<bigint>, squares bigint"), "sums")
    each = partial.select("label", "dim", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("x").alias("x"))
    centre = each.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    squares = partial.groupBy(c("label").alias("l"), c("dim").alias("d")).agg(F.sum("squares").alias("squares"))
    found = centre.join(squares, (c("label") == c("l")) & (c("dim") == c("d"))).drop("l", "d")
    found = found.join(sizes, (c("label") == c("l")) & (c("dim") == c("d"))).drop("l", "d")
    mean = F.transform("xs", lambda p: p["x"] / c("n"))
    spread = F.sqrt(F.greatest(F.lit(1.0), c("squares") / c("n") - F.aggregate("centre", F.lit(0.0), lambda a, m: a + m * m)) / c("dim"))
    depth = F.ceil(F.log(c("n") / plan.group) / F.log(F.lit(4.0))).cast("int")
    return written(found.withColumn("centre", mean).withColumn("spread", spread)
                   .select(c("label").alias("l"), c("dim").alias("d"), depth.alias("depth"), "centre", "spread"), "large")


def reached(x: np.ndarray, centre: np.ndarray, spread: float, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block that rows of byte coordinates reach: row numbers, cell numbers and whether the row is at home there."""
    owner, cell, home, far = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    for j in range(x.shape[1]):
        cuts = centre[j] + spread * QUARTERS
        low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)
        at = x[:, j].astype(float)
        own = np.searchsorted(cuts, at, side="right")
        gap = np.maximum(0, np.maximum(low[None] - at[:, None], at[:, None] - high[None])) ** 2
        grown = far[:, None] + gap[owner]
        keep = grown <= budget
        digit = np.nonzero(keep)[1]
        count = keep.sum(1)
        owner, cell, home, far = np.repeat(owner, count), np.repeat(cell * 4, count) + digit, np.repeat(home * 4, count), grown[keep]
        home = home + own[owner]
    return owner, cell, cell == home


def placed(entries: DataFrame, plan: SubspacePlan) -> DataFrame:
    """A row for each block and cell that an entry is at home in (``visit`` false) or visits, with the cell's name."""
    c = F.col
    large = large_labels(entries, plan)
    source = entries.join(large, (c("label") == c("l")) & (c("dim") == c("d")), "left").select("row", "label", "dim", "codes", "copies", "depth", "centre", "spread")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "label", "dim", "codes", "copies"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                dims, labels, depths = (b.column(n).to_pylist() for n in ("dim", "label", "depth"))
                groups: dict[tuple, list[int]] = {}
                for k, (d, t) in enumerate(zip(dims, depths, strict=True)):  # small labels share one plan: a single cell a block
                    groups.setdefault((d, labels[k] if t else None, t or 0), []).append(k)
                for (dim, _, depth), rows in groups.items():
                    sp = space(dim, plan)
                    part = b.take(pa.array(rows))
                    x = np.stack([np.frombuffer(r, np.int8) for r in part.column("codes").to_pylist()])
                    centre = np.array(part.column("centre")[0].as_py()) if depth else np.zeros(dim)
                    spread = part.column("spread")[0].as_py() if depth else 1.0
                    for block, s in enumerate(sp.parts):
                        use = slice(s.start, min(s.stop, s.start + depth))
                        owner, cell, home = reached(x[:, use], centre[use], spread, float(sp.budgets[block]))
                        # a pair of cells meets in the later one: homes stay, visitors come from earlier cells only
                        own = np.empty(len(x), np.int64)
                        own[owner[home]] = cell[home]
                        wanted = home | (cell > own[owner])
                        owner, cell, home = owner[wanted], cell[wanted], home[wanted]
                        out = part.select(names).take(pa.array(owner))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(owner), block, np.int32)), pa.array(cell), pa.array(~home)],
                                                         names=[*names, "block", "number", "visit"])

    rows = source.mapInArrow(run, "row bigint, label string, dim int, codes binary, copies bigint, block int, number bigint, visit boolean")
    name = F.concat_ws(":", "dim", "block", "number", "label")  # the label comes last: no two cells share a name
    return rows.select("row", "dim", "codes", "copies", "block", "visit", F.unhex(F.md5(name)).alias("cell"))


def spread_cells(rows: DataFrame, plan: SubspacePlan) -> DataFrame:
    """Split cells with more than ``group`` homes by hash; homes of a part visit the later parts, visitors visit all."""
    c = F.col
    hot = rows.filter(~c("visit")).groupBy("cell").count().filter(c("count") > plan.group)
    hot = written(hot.select(c("cell").alias("hot"), F.ceil(c("count") / plan.group).cast("int").alias("n_parts")), "hot")
    if hot.isEmpty():
        return rows
    joined = rows.join(hot, c("cell") == c("hot"), "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    mine = F.when(c("visit"), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), c("n_parts")).cast("int"))
    each = joined.withColumn("mine", mine).withColumn("part", F.explode(F.sequence("mine", c("n_parts") - 1)))
    named = F.when(c("hot").isNull(), c("cell")).otherwise(F.unhex(F.md5(F.concat(c("cell"), F.encode(c("part").cast("string"), "UTF-8")))))
    return each.select("row", "dim", "codes", "copies", "block", (c("visit") | (c("part") != c("mine"))).alias("visit"), named.alias("cell"))


def admitted(x: np.ndarray, y: np.ndarray, block: int, sp: Space, plan: SubspacePlan, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``x`` and ``y`` that the block admits and no earlier one does, within the widened whole budget."""
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 22 else np.float64  # whole numbers stay exact
    s = sp.parts[block]
    left, right = x[:, s].astype(kind), y[:, s].astype(kind)
    ln, rn = (left * left).sum(1), (right * right).sum(1)
    step = max(1, plan.chunk // max(1, len(y)))
    for k in range(0, len(x), step):
        near = ln[k:k + step, None] + rn[None] - 2 * (left[k:k + step] @ right.T) <= sp.budgets[block]
        i, j = np.nonzero(near)
        i += k
        if within:
            i, j = i[i < j], j[i < j]
        most = max(1, (1 << 22) // x.shape[1])
        for q in range(0, len(i), most):
            a, b = i[q:q + most], j[q:q + most]
            gap = (x[a].astype(np.int32) - y[b]) ** 2
            good = gap.sum(1) <= sp.whole
            for e in range(block):
                good &= gap[:, sp.parts[e]].sum(1) > sp.budgets[e]
            yield a[good], b[good]


class Homes:
    """The homes of the cell that a task is reading."""

    def __init__(self, slices: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(slices).combine_chunks()
        self.codes = codes_of(self.rows)
        self.block = self.rows.column("block")[0].as_py()
        self.dim = self.rows.column("dim")[0].as_py()


def codes_of(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int8).reshape(rows.num_rows, -1)


def by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Homes | None, pa.RecordBatch | None]]:
    """From rows sorted by cell, homes first: ``(homes, None)`` once a cell, ``(homes, visitors)`` for each run of its
    visitors, ``(None, None)`` at its end.  A cell without homes has nothing to compare."""
    current, waiting, homes = None, [], None
    for b in batches:
        cells, visit = b.column("cell").to_pylist(), b.column("visit").to_pylist()
        start = 0
        for k in range(1, b.num_rows + 1):
            if k < b.num_rows and cells[k] == cells[start] and visit[k] == visit[start]:
                continue
            if cells[start] != current:
                if waiting:
                    yield Homes(waiting), None
                if waiting or homes:
                    yield None, None
                current, waiting, homes = cells[start], [], None
            part = b.slice(start, k - start)
            if not visit[start]:
                waiting.append(part)
            else:
                if waiting:
                    homes, waiting = Homes(waiting), []
                    yield homes, None
                if homes:
                    yield homes, part
            start = k
    if waiting:
        yield Homes(waiting), None
    if waiting or homes:
        yield None, None


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("cell")).sortWithinPartitions("cell", "visit")


def candidates(rows: DataFrame, plan: SubspacePlan) -> DataFrame:
    """The rows of a cell that have a partner there by their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, last = None, None
        for homes, visitors in by_cell(batches):
            if homes is None:
                if hit.any():
                    yield from last.rows.filter(pa.array(hit)).combine_chunks().to_batches()
                continue
            sp = space(homes.dim, plan)
            if visitors is None:
                last, hit = homes, np.zeros(len(homes.codes), bool)
                for i, j in admitted(homes.codes, homes.codes, homes.block, sp, plan, True):
                    hit[i] = hit[j] = True
            else:
                mine = np.zeros(visitors.num_rows, bool)
                for i, j in admitted(codes_of(visitors), homes.codes, homes.block, sp, plan, False):
                    mine[i] = hit[j] = True
                if mine.any():
                    yield visitors.filter(pa.array(mine))

    return _sorted(rows).mapInArrow(run, rows.schema)


def verified(rows: DataFrame, plan: SubspacePlan) -> DataFrame:
    """Exact cosines within cells: ``row``, its links found there (copies included) and ``root``, an edge of a forest."""

    def units(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([unit(v) for v in t.column("v").to_pylist()])

    def out(row: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(links), pa.array(root)], names=["row", "links", "root"])

    def linked(x: np.ndarray, y: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in pairs:
            near = np.einsum("ij,ij->i", x[i], y[j]) >= plan.cosine
            yield i[near], j[near]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = copies = exact = links = root = None
        for homes, visitors in by_cell(batches):
            if homes is None:
                hit = np.nonzero(links)[0]
                if len(hit):
                    yield out(row[hit], links[hit], row[root[hit]])
                continue
            sp = space(homes.dim, plan)
            if visitors is None:
                row, copies = homes.rows.column("row").to_numpy(), homes.rows.column("copies").to_numpy()
                exact, links, root = units(homes.rows), np.zeros(len(row), np.int64), np.arange(len(row))
                for i, j in linked(exact, exact, admitted(homes.codes, homes.codes, homes.block, sp, plan, True)):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    _forest(len(row), i, j, root)
            else:
                theirs, n = visitors.column("row").to_numpy(), visitors.num_rows
                times, mine, first = visitors.column("copies").to_numpy(), np.zeros(n, np.int64), np.full(n, len(row))
                for i, j in linked(units(visitors), exact, admitted(codes_of(visitors), homes.codes, homes.block, sp, plan, False)):
                    np.add.at(mine, i, copies[j])
                    np.add.at(links, j, times[i])
                    np.minimum.at(first, i, j)
                    _forest(len(row), first[i], j, root)  # homes with a common visitor are connected
                hit = np.nonzero(mine)[0]
                if len(hit):
                    yield out(theirs[hit], mine[hit], row[first[hit]])

    return _sorted(rows).mapInArrow(run, "row bigint, links bigint, root bigint")


def near_duplicates(table: DataFrame, plan: SubspacePlan = SubspacePlan(), vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    c = F.col
    rows = written(coded(table, plan, vec_id, vector, label), "vectors")
    first = F.struct(c("id").isNull().alias("no_id"), c("id").alias("id"))
    entries = written(rows.filter("key is not null").groupBy("key").agg(
        F.min("row").alias("row"), F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("codes").alias("codes")), "entries")
    cells = written(placed(entries, plan), "cells")
    wanted = written(candidates(spread_cells(cells, plan), plan), "candidates")
    found = written(verified(wanted.join(rows.select("row", "v"), "row"), plan), "links")

    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.select(c("row").alias("a"), c("root").alias("b")))
    several = (entries.select("key", "row", "first", "copies").join(links, "row", "left").join(roots.withColumnRenamed("key", "row"), "row", "left")
               .filter((c("copies") > 1) | c("links").isNotNull())
               .select("key", "first", F.coalesce("root", "row").alias("root"), (F.coalesce("links", F.lit(0)) + c("copies") - 1).alias("links")))
    several = written(several, "several")
    named = several.groupBy("root").agg(F.min("first").alias("least"))
    info = written(several.join(named, "root").select(c("key").alias("entry"), "links", c("least.id").alias("least")), "info")
    joined = rows.select("id", "key").join(info, c("key") == c("entry"), "left")
    component = F.when(c("entry").isNull(), c("id")).otherwise(c("least"))
    return joined.select(c("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         c("id").eqNullSafe(component).alias("kept"))
