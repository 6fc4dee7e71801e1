"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles.  Pairs with Jaccard similarity of at
least 0.8 are found by recursive splitting: in every run a set follows one
sampled token (the shingle that is smallest under the run's hash), and sets
that share it meet in a bucket.  A bucket that is too large is split again,
each set following two more sampled tokens, chosen by the bucket's own seed; a
bucket that has become small is compared by brute force.  Sets of similarity s
share a sampled token with probability s, so a pair at the threshold survives
a run with probability ``run_recall`` at least, whatever the depth, and runs
are repeated until the target recall is reached.

A bucket that hardly shrinks when it is split consists of sets that are mostly
similar to each other, so its pairs are wanted; it is compared in blocks, each
pair of blocks a task of its own.

How pairs are counted without being listed:

* sets that are equal are one set with a number of copies;
* every pair is looked at in one bucket only, the smallest of the buckets it
  shares: each set carries the sorted list of its buckets;
* a first pass over 64-byte sketches finds the sets that have a candidate in a
  bucket; only those fetch their text, and the similarity is computed exactly;
* a bucket returns, for each set, its number of links and one edge of a
  spanning forest; connected components of the edges are the classes.

Defined cases: a text of fewer than five words is one shingle of all its
words; a null, empty or blank text has no shingles, is linked to nothing and
forms a class alone; equal rows are copies of each other (similarity 1); a
null ``doc_id`` is allowed, a class is named by its smallest non-null id; an
empty table gives an empty result; columns of the input named like an output
column are replaced.  The input must be a stored or written table: a row is
found again by its partition and place, and a row that reads differently the
second time stops the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, kept_columns, pieces_by_bytes, row_filter, written

#: Sampled tokens held of each set; the first ones open the runs, the others split buckets.
TOKENS = 64
#: Sampled tokens that a set of an oversized bucket follows.
BRANCHES = 2

_SEEDS = np.random.default_rng(20180401).integers(0, 1 << 63, (2, TOKENS), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio, odd


@dataclass(frozen=True)
class JoinPlan:
    """Parameters of the join; ``recall`` is the chance that a pair at the threshold is found."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999999
    bucket: int = 256      # a bucket of at most so many sets is compared
    block: int = 1024      # a dense bucket is compared in blocks of about so many sets
    shrink: float = 0.5    # a bucket that keeps more than this share of its parent is dense
    max_depth: int = 8

    def run_recall(self) -> float:
        """Least survival of a pair at the threshold in one run: the limit of q = 1 - (1 - s q)^BRANCHES, times s."""
        q = 1.0
        for _ in range(self.max_depth):
            q = 1 - (1 - self.similarity * q) ** BRANCHES
        return self.similarity * q

    def runs(self) -> int:
        n = ceil(log(1 - self.recall) / log(1 - self.run_recall()))
        if n > TOKENS // 2:
            raise ValueError(f"{n} runs are needed for a recall of {self.recall} at similarity {self.similarity}; sets hold tokens for {TOKENS // 2}")
        return n


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k:len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sampled_tokens(s: np.ndarray) -> np.ndarray:
    """The smallest token of the set under each of TOKENS hash functions."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1 << 12):  # bounded memory for very long texts
        v = (s[k:k + (1 << 12), None] ^ _SEEDS[0]) * _SEEDS[1]
        best = np.minimum(best, (v ^ (v >> np.uint64(32))).min(0))
    return best


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def features(docs: DataFrame, plan: JoinPlan, keep: tuple[str, ...], text: str) -> DataFrame:
    """``keep``, the row's number, its set's key, size and sampled tokens (null key: no shingles)."""
    source = docs.select(*[F.col(f"`{k}`") for k in keep], F.monotonically_increasing_id().alias("_llm_row"), F.col(text).alias("_llm_text"))
    names = [*keep, "_llm_row"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", 1 << 22):
                sets = [shingles(t, plan.words) for t in as_bytes(batch.column("_llm_text"))]
                tokens = [sampled_tokens(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())),
                     pa.array([t.astype(np.uint8).tobytes() for t in tokens], pa.binary())],
                    names=[*names, "_llm_key", "_llm_size", "_llm_tokens", "_llm_sketch"])

    extra = T.StructType().add("_llm_key", "binary").add("_llm_size", "long").add("_llm_tokens", T.ArrayType(T.LongType())).add("_llm_sketch", "binary")
    return bounded_batches(source).mapInArrow(run, T.StructType([*source.schema.fields[:-1], *extra.fields]))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two sets or more, with the bucket's size; both sides are plain
    stored tables, so Spark can split a hot bucket's side of the join."""
    rows = written(rows, "paths")
    sizes = written(rows.groupBy("bucket").count().filter("count > 1").withColumnRenamed("count", "n"), "sizes")
    return rows.join(sizes.hint("merge"), "bucket")


def leaf_buckets(sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """``key``, ``bucket`` and its size ``n`` for every bucket that is to be compared."""
    c = F.col
    runs = plan.runs()
    level = sets.select("key", F.posexplode(F.slice("tokens", 1, runs)).alias("run", "token"))
    level = level.select("key", F.xxhash64("run", "token").alias("bucket"), F.lit(None).cast("long").alias("parent_n"))
    leaves = None
    for depth in range(plan.max_depth + 1):
        found = written(_sized(level), "level")
        dense = c("parent_n").isNotNull() & (c("n") > c("parent_n") * plan.shrink)
        done = (c("n") <= plan.bucket) | dense if depth < plan.max_depth else F.lit(True)
        part = found.filter(done).select("key", "bucket", "n")
        leaves = part if leaves is None else leaves.unionByName(part)
        open_rows = found.filter(~done) if depth < plan.max_depth else None
        if open_rows is None or open_rows.isEmpty():
            break
        followed = open_rows.join(sets.select("key", "tokens").hint("merge"), "key").withColumn("branch", F.explode(F.array(*map(F.lit, range(BRANCHES)))))
        which = F.pmod(F.xxhash64("bucket", "branch"), F.lit(TOKENS - runs)).cast("int") + runs
        level = followed.select("key", F.xxhash64("bucket", "branch", F.get("tokens", which)).alias("bucket"), c("n").alias("parent_n"))
    return leaves


def cells(leaves: DataFrame, plan: JoinPlan) -> DataFrame:
    """Leaves as cells for one task each: a small bucket is one cell, a dense one a cell per pair of blocks."""
    c = F.col
    blocks = F.ceil(c("n") / plan.block).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "bucket"), c("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), c("blocks") - 1))
    paired = placed.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return paired.select("key", "bucket", "block", (c("block") != c("other")).alias("across"), F.xxhash64("bucket", low, high).alias("cell"))


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The cells of rows that arrive sorted by cell, across batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column("cell").to_numpy(zero_copy_only=False)
        borders = [0, *(np.nonzero(cell[1:] != cell[:-1])[0] + 1).tolist(), len(cell)]
        for lo, hi in zip(borders, borders[1:], strict=False):
            part = b.slice(lo, hi - lo)
            if rest and rest[0].column("cell")[0].as_py() != cell[lo]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def _joined(tables: Iterable[pa.Table], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The tables of many cells in fewer batches."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(map(len, held)) >= rows or len(held) >= 512:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _bits(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """One bit row per owner over the values that two owners or more hold (values are distinct within an owner)."""
    _, which, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[which]
    owner, bit = owner[use], place[which[use]]
    words = -(-int(shared.sum()) // 64)
    out = np.zeros((rows, max(1, words)), np.uint64)
    np.bitwise_or.at(out, (owner, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def _pairs(rows: int, block: np.ndarray, across: bool, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell, or those between its two blocks, in chunks of bounded size."""
    if across:
        a, b = np.nonzero(block == block.min())[0], np.nonzero(block != block.min())[0]
        step = max(1, chunk // max(1, len(b)))
        for k in range(0, len(a), step):
            yield np.repeat(a[k:k + step], len(b)), np.tile(b, len(a[k:k + step]))
        return
    step = max(1, chunk // rows)
    for k in range(0, rows - 1, step):
        i = np.arange(k, min(k + step, rows - 1))
        n = rows - 1 - i
        left = np.repeat(i, n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)


def _new_pairs(t: pa.Table, plan: JoinPlan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the cell with fitting sizes that share no smaller bucket."""
    size, bucket = t.column("size").to_numpy(), t.column("bucket")[0].as_py()
    lists = t.column("buckets").combine_chunks()
    value, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    earlier = _bits(owner[value < bucket], value[value < bucket], len(lists))
    for i, j in _pairs(t.num_rows, t.column("block").to_numpy(), t.column("across")[0].as_py()):
        fit = np.minimum(size[i], size[j]) >= plan.similarity * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        first = ~(earlier[i] & earlier[j]).any(1)
        yield i[first], j[first]


def sketch_limit(plan: JoinPlan, misses: float = 5.0) -> int:
    """Equal sketch bytes that a pair at the threshold has but for ``misses`` standard deviations."""
    s = plan.similarity
    return int(TOKENS * s - misses * (TOKENS * s * (1 - s)) ** 0.5)


def candidates(placed: DataFrame, plan: JoinPlan) -> DataFrame:
    """The rows of a cell that have a partner there by their sketches."""
    limit = sketch_limit(plan)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        for t in _grouped(batches):
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            hit = np.zeros(t.num_rows, bool)
            for i, j in _new_pairs(t, plan):
                alike = (sketch[i] == sketch[j]).sum(1) >= limit
                hit[i[alike]] = hit[j[alike]] = True
            if hit.any():
                yield t.drop_columns(["sketch"]).filter(pa.array(hit))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _joined(near(batches))

    kept = placed.drop("sketch")
    by_cell = placed.repartition(F.col("cell")).sortWithinPartitions("cell")
    return by_cell.mapInArrow(run, kept.schema)


def _forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Join the trees of linked rows; ``root`` points to the smallest row of a tree."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def verified(rows: DataFrame, plan: JoinPlan) -> DataFrame:
    """Exact similarity within cells: ``key``, links found there (copies included) and ``root``, an edge of the forest."""

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        def prepared() -> Iterator[pa.RecordBatch]:
            for whole in batches:  # texts become shingle hashes as they arrive
                for b in pieces_by_bytes(whole, "text", 1 << 22):
                    sets = [shingles(x, plan.words) for x in as_bytes(b.column("text"))]
                    for key, s in zip(b.column("key").to_pylist(), sets, strict=True):
                        if set_key(s) != key:
                            raise ValueError("the documents read differently the second time; pass a stored table")
                    names = [n for n in b.schema.names if n != "text"]
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                     names=[*names, "set"])

        for t in _grouped(prepared()):
            n, size, copies = t.num_rows, t.column("size").to_numpy(), t.column("copies").to_numpy()
            bits = _bits(np.repeat(np.arange(n), size), np.frombuffer(b"".join(t.column("set").to_pylist()), np.uint64), n)
            links, root = np.zeros(n, np.int64), np.arange(n)
            for i, j in _new_pairs(t, plan):
                step = max(1, (1 << 19) // bits.shape[1])  # 4 MB of bit rows on each side
                for k in range(0, len(i), step):
                    a, b = i[k:k + step], j[k:k + step]
                    both = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
                    near = both >= plan.similarity * (size[a] + size[b] - both) - 1e-9
                    a, b = a[near], b[near]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    _forest(n, a, b, root)
            hit = np.nonzero(links)[0]
            if len(hit):
                key = t.column("key").combine_chunks()
                yield pa.table([key.take(pa.array(hit)), pa.array(links[hit]), key.take(pa.array(root[hit]))], names=["key", "links", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _joined(linked(batches))

    by_cell = rows.repartition(F.col("cell")).sortWithinPartitions("cell")
    return by_cell.mapInArrow(run, "key binary, links bigint, root binary")


def components(edges: DataFrame) -> DataFrame:
    """``key`` and ``root`` for all ends of the edges ``(a, b)``; equal roots: connected.

    Every node moves to its smallest neighbour and the edges move with it,
    until none is left.  All steps are partial aggregates and joins of stored
    tables; a hot node is a hot join key on one bare side only, which Spark
    splits.
    """
    edges = written(edges.filter("a != b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("root")), "labels")
    moved = labels
    while True:
        step = moved.select(F.col("key").alias("node"), F.col("root").alias("to"))
        left = edges.join(step, edges["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        edges = written(left.join(step, left["b"] == step["node"]).select("a", F.col("to").alias("b")).filter("a != b").distinct(), "edges")
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("root")), "moved")
        step = moved.select(F.col("key").alias("node"), F.col("root").alias("to"))
        labels = written(labels.join(step, labels["root"] == step["node"], "left").select("key", F.coalesce("to", "root").alias("root")), "labels")


def similarity_join(docs: DataFrame, plan: JoinPlan = JoinPlan(), doc_id: str = "doc_id", text: str = "text",
                    keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (default the id) of every row with ``class_id``, ``copy_id`` (smallest id with an equal
    set), ``n_links`` (rows of similarity 0.8 or more, copies included) and ``class_first`` (true for one row of a class)."""
    c = F.col
    outputs = ("class_id", "copy_id", "n_links", "class_first")
    keep = kept_columns(keep or (doc_id,), outputs)
    rows = written(features(docs, plan, (doc_id,), text), "features")  # narrow: texts are read again where they are needed
    first = F.struct(c(f"`{doc_id}`").isNull().alias("no_id"), c(f"`{doc_id}`").alias("id"), c("_llm_row").alias("row"))
    sets = written(rows.filter("_llm_key is not null").groupBy(c("_llm_key").alias("key")).agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("_llm_size").alias("size"), F.min("_llm_row").alias("row"),
        F.first("_llm_tokens").alias("tokens"), F.first("_llm_sketch").alias("sketch")), "sets")

    leaves = written(leaf_buckets(sets, plan), "leaves")
    buckets = leaves.groupBy("key").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    known = written(sets.join(buckets.hint("merge"), "key").select("key", "size", "copies", "row", "buckets", "sketch"), "known")
    placed = cells(leaves, plan).join(known.hint("merge"), "key")
    wanted = written(candidates(placed, plan), "candidates")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    maps, same, hit = row_filter(written(wanted.select("row").distinct(), "wanted"), "row")
    texts = texts.join(maps, same).filter(hit).select("row", "text")  # only texts of candidates, and few others, are exchanged
    found = written(verified(wanted.join(texts.hint("merge"), "row"), plan), "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(c("key").alias("a"), c("root").alias("b")))
    several = written(sets.select("key", "first", "copies").join(roots, "key", "left").join(links, "key", "left")
                      .filter((c("copies") > 1) | c("links").isNotNull())
                      .select("key", "first", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + c("copies") - 1).alias("links")), "classes")
    classes = written(several.groupBy("root").agg(F.min("first").alias("class_first")), "firsts")
    info = written(several.join(classes, "root").select(c("key").alias("_llm_set"), c("first").alias("_llm_copy"), c("class_first").alias("_llm_class"),
                                                        c("links").alias("_llm_links")), "info")
    joined = rows.join(info.hint("merge"), c("_llm_key") == c("_llm_set"), "left")
    ids = [F.when(c("_llm_set").isNull(), c(f"`{doc_id}`")).otherwise(c(f"{x}.id")) for x in ("_llm_class", "_llm_copy")]
    verdict = [ids[0].alias("class_id"), ids[1].alias("copy_id"), F.coalesce("_llm_links", F.lit(0)).cast("long").alias("n_links"),
               F.coalesce(c("_llm_class.row") == c("_llm_row"), F.lit(True)).alias("class_first")]
    if set(keep) <= {doc_id}:
        return joined.select(*[c(f"`{k}`") for k in keep], *verdict)

    # whole rows: those of a class of several go through the exchange, the others get their verdict in the scan
    several = written(joined.filter(c("_llm_set").isNotNull()).select(c("_llm_row").alias("_llm_at"), c(f"`{doc_id}`").alias("_llm_id"), *verdict), "found")
    maps, same, hit = row_filter(several.select(c("_llm_at").alias("_llm_row")), "_llm_row")
    whole = docs.select(*[c(f"`{k}`") for k in docs.columns if k in {*keep, doc_id}], F.monotonically_increasing_id().alias("_llm_row"))
    marked = whole.join(maps, same, "left").withColumn("_llm_hit", hit)
    alone = marked.filter(~c("_llm_hit")).select(*[c(f"`{k}`") for k in keep], c(f"`{doc_id}`").alias("class_id"), c(f"`{doc_id}`").alias("copy_id"),
                                                 F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("class_first"))
    met = marked.filter("_llm_hit").join(several.hint("merge"), c("_llm_row") == c("_llm_at"), "left")
    same_id = c("_llm_at").isNull() | c(f"`{doc_id}`").eqNullSafe(c("_llm_id"))
    checked = F.when(same_id, F.coalesce("class_first", F.lit(True))).otherwise(
        F.raise_error(F.lit("the documents read differently the second time; pass a stored table")).cast("boolean"))
    own = lambda n: F.when(c("_llm_at").isNull(), c(f"`{doc_id}`")).otherwise(c(n)).alias(n)
    met = met.select(*[c(f"`{k}`") for k in keep], own("class_id"), own("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     checked.alias("class_first"))
    return alone.unionByName(met)
