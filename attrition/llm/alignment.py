"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Tokenizer A (byte-level) reads a space and the text; tokenizer B (pieces, with
its own leading space) reads the text, so both cover the same bytes.  The byte
ends of A's and B's tokens are two sorted lists; their merge visits every pair
of overlapping tokens once and every offset where both end once.

The merge is not walked from one end.  Equally spaced diagonals of the merge
matrix are located by binary searches (all diagonals at once), which divides
the merge of a whole block of documents into independent pieces of equal work,
whatever the lengths of the documents.  A piece emits its ends with the pair of
tokens that overlap there; where both lists end at a piece's border, the two
pieces are stitched: the end belongs to the earlier piece and closes a group.

Corpus-wide counts of id pairs: a block carries its distinct pairs once, so the
counts, and the answers that go back to the blocks, move one row per block and
distinct pair and not one per link.  A block is about ``block_bytes`` of text
of one scan partition; a longer text is a block alone.

Defined cases: a null or empty text, and one whose joined A or B bytes are not
a space and the text's UTF-8 bytes, has no tokens (zeros and an empty digest);
a text of many megabytes is encoded in pieces cut before spaces, where neither
tokenizer joins; equal rows are counted one by one; a null ``doc_id`` stays
null; an empty table gives an empty result; of the input only ``keep`` and the
text are read, and a kept column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteFiles, ByteTokens, pieces
from .common import written

OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

@dataclass(frozen=True)
class TokenizerFiles:
    """``byte`` is tokenizer A, ``pieces`` the file of tokenizer B."""

    byte: ByteFiles
    pieces: str


class PieceTokens:
    """B: ids and their byte strings; U+2581 is a space, ``<0xHH>`` a byte."""

    def __init__(self, files: TokenizerFiles):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


class Pair:
    """Both tokenizers of a worker, with their ids' lengths and decimal names."""

    def __init__(self, files: TokenizerFiles):
        self.a, self.b = ByteTokens(files.byte), PieceTokens(files)
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.named = [{sep: np.array([b"%d%s" % (i, sep) for i in range(len(t.bytes))], object) for sep in seps}
                      for t, seps in ((self.a, (b",", b"|")), (self.b, (b",", b";")))]

    def tokens(self, raw: bytes, piece_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where the tokens' bytes are not those of a space and the text."""
        none = np.zeros(0, np.int32)
        if not raw:
            return none, none
        text = raw.decode("utf-8", "replace")
        a, b = [], []
        for k, piece in enumerate(pieces(text, piece_chars)):
            a += self.a.encode(" " + piece if k == 0 else piece)
            b += self.b.encode(piece if k == 0 else piece[1:])
        whole = b" " + raw
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return none, none
        return np.array(a, np.int32), np.array(b, np.int32)


_LOADED: dict[TokenizerFiles, Pair] = {}


def _pair(files: TokenizerFiles) -> Pair:
    if files not in _LOADED:
        _LOADED[files] = Pair(files)
    return _LOADED[files]


def diagonal_splits(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` lie before each ``work``-th diagonal of their merge (equal values: ``a`` first)."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        i, j = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        more = open_ & (a[i] <= b[j])   # a[mid] comes before b[d - mid - 1]: the split lies beyond mid
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """One piece: its distinct ends, the tokens of A and B that overlap before each, and whether both end there."""
    left, right = a[i[0]:i[1]], b[j[0]:j[1]]
    both = np.concatenate([left, right])
    both.sort(kind="stable")  # two runs: one merge
    end = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    at, bt = np.searchsorted(left, end), np.searchsorted(right, end)
    shared = np.zeros(len(end), bool)
    known = (at < len(left)) & (bt < len(right))
    shared[known] = left[at[known]] == right[bt[known]]
    return end, at + i[0], bt + j[0], shared


def overlaps(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct ends of two sorted end lists that close together, with the overlapping tokens and shared flags."""
    ai, bj = diagonal_splits(a, b, work)
    out = []
    for p in range(len(ai) - 1):
        end, at, bt, shared = merge_piece(a, b, (ai[p], ai[p + 1]), (bj[p], bj[p + 1]))
        # stitch: an end of A just before the border whose equal end of B lies behind it
        if len(end) and ai[p] and a[ai[p] - 1] == end[0]:
            for last in reversed(out):
                if len(last[0]):
                    last[3][-1] = True
                    break
            end, at, bt, shared = end[1:], at[1:], bt[1:], shared[1:]
        out.append((end, at, bt, shared))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(found: list[tuple[np.ndarray, np.ndarray]], pair: Pair, work: int) -> dict[str, np.ndarray | list]:
    """Counts, digests and links of a block of documents."""
    sizes = [np.array([len(x[k]) for x in found], np.int64) for k in (0, 1)]
    ids = [np.concatenate([x[k] for x in found]) for k in (0, 1)]
    ends = [np.cumsum(pair.lengths[k][ids[k]]) for k in (0, 1)]
    end, at, bt, shared = overlaps(*ends, work)
    last = np.cumsum(sizes[0])              # a document's last tokens end together
    doc = np.searchsorted(last, at, side="right")
    n = len(found)
    groups = np.bincount(doc[shared], minlength=n)
    closes = end[shared]
    group = [np.searchsorted(closes, e) for e in ends]
    per_group = [np.bincount(g, minlength=len(closes)) for g in group]
    before = [np.concatenate([[0], np.cumsum(x)]) for x in per_group]
    place = [np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]]
    names = np.empty(len(ids[0]) + len(ids[1]), object)
    for k, (inner, outer) in enumerate(((b",", b"|"), (b",", b";"))):
        final = np.append(group[k][1:] != group[k][:-1], True)[:len(ids[k])]
        names[place[k][~final]] = pair.named[k][inner][ids[k][~final]]
        names[place[k][final]] = pair.named[k][outer][ids[k][final]]
    cut = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
    digests = [hashlib.sha256(b"".join(names[cut[d]:cut[d + 1]])[:-1]).hexdigest() if cut[d] < cut[d + 1] else "" for d in range(n)]
    key = (ids[1][bt].astype(np.int64) << 32) | ids[0][at]
    distinct, local, times = np.unique(key, return_inverse=True, return_counts=True)
    mine, count = np.unique(doc * max(1, len(distinct)) + local, return_counts=True)
    borders = np.searchsorted(mine, np.arange(n + 1) * max(1, len(distinct)))
    return {"n_a": sizes[0], "n_b": sizes[1], "n_groups": groups, "n_links": np.bincount(doc, minlength=n), "groups_sha256": digests,
            "pairs": distinct, "pair_times": times, "local": mine % max(1, len(distinct)), "times": count, "borders": borders}


def aligned_blocks(docs: DataFrame, files: TokenizerFiles, keep: tuple[str, ...], text: str, block_bytes: int, piece_chars: int,
                   work: int) -> DataFrame:
    """Every document with its block, counts, digest and links (``local`` pair numbers with ``times``);
    the first row of a block holds the block's ``pairs``."""
    names = [f"_llm_k{k}" for k in range(len(keep))]
    source = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("_llm_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, size, block = _pair(files), [], 0, TaskContext.get().partitionId() << 33

        def closed() -> pa.RecordBatch:
            nonlocal held, size, block
            rows = pa.Table.from_batches([b for b, _ in held]).combine_chunks()
            x = align([f for _, fs in held for f in fs], pair, work)
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(x["borders"], pa.int32()), pa.array(v, t))
            first = lambda v: pa.array([v] + [None] * (rows.num_rows - 1), pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays(
                [*(rows.column(n).combine_chunks() if rows.num_rows else rows.column(n) for n in names), pa.array([block] * rows.num_rows, pa.int64()),
                 *(pa.array(x[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups_sha256"], pa.string()),
                 lists(x["local"], pa.int32()), lists(x["times"], pa.int32()), first(x["pairs"]), first(x["pair_times"])],
                names=[*names, "_llm_block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "local", "times", "pairs", "pair_times"])
            held, size, block = [], 0, block + 1
            return out

        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            start, found = 0, []
            for r, raw in enumerate(b.column("_llm_text").to_pylist()):
                found.append(pair.tokens(raw or b"", piece_chars))
                size += len(raw or b"")
                if size >= block_bytes:
                    held.append((b.select(names).slice(start, r + 1 - start) if names else b.slice(start, r + 1 - start), found))
                    yield closed()
                    start, found = r + 1, []
            if found:
                held.append((b.select(names).slice(start) if names else b.slice(start), found))
        if held:
            yield closed()

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}_llm_block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                  "local array<int>, times array<int>, pairs array<bigint>, pair_times array<bigint>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair`` (B's id in the upper 32 bits, A's in the lower), ``links`` in the corpus and ``best``: no A id has more for this B id.

    At most one row per pair of vocabulary entries; a B id has at most as many rows as A has entries.
    """
    c = F.col
    each = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "pair_times")).alias("p"))
    counts = written(each.groupBy(c("p.pairs").alias("pair")).agg(F.sum("p.pair_times").alias("links")), "pair-counts")
    b = F.shiftright("pair", 32)
    top = counts.groupBy(b.alias("b")).agg(F.max("links").alias("top"))
    return written(counts.join(top, b == c("b")).select("pair", "links", (c("links") == c("top")).alias("best")), "pair-best")


def aligned(docs: DataFrame, files: TokenizerFiles, keep: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = 1 << 20,
            piece_chars: int = 1 << 16, work: int = 1 << 15) -> DataFrame:
    """``keep`` columns of every row with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    c = F.col
    keep = tuple(k for k in keep if k not in OUTPUTS)
    blocks = written(aligned_blocks(docs, files, keep, text, block_bytes, piece_chars, work), "aligned")
    counts = pair_counts(blocks)
    asked = blocks.filter("pairs is not null").select(c("_llm_block").alias("block"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("block", "at", "links", "best")
    rows = blocks.drop("pairs", "pair_times")
    kept = rows.columns[:len(keep)]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        links, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # numbered without gaps within a block
        links[at], best[at] = right.column("links").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        local, times = left.column("local").combine_chunks(), left.column("times").combine_chunks()
        owner = np.repeat(np.arange(left.num_rows), np.diff(local.offsets.to_numpy()))
        i, t = local.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = np.zeros((2, left.num_rows), np.int64)
        np.add.at(sums[0], owner, t * best[i])
        np.add.at(sums[1], owner, t * links[i])
        columns = [*kept, "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(n) for n in columns), pa.array(sums[0]), pa.array(sums[1]), left.column("groups_sha256")],
                        names=[*columns, *OUTPUTS[4:]])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:len(kept)])
    out = rows.groupBy("_llm_block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"{schema}n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.select(*[c(n).alias(k) for n, k in zip(kept, keep, strict=True)], *OUTPUTS)
