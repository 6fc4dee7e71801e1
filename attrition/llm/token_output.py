"""Packed id matrices by best-fit-decreasing.

Texts become token ids with an end id.  A document longer than a row is split
losslessly into full rows and a rest; rests and short documents are packed
into rows best-fit-decreasing: longest first, each into the fullest row that
still has room.  A segment tree over the free lengths answers "smallest free
length that is at least n" in log2(row length) steps.

Packing is done in windows of ``window_tokens`` tokens inside each input
partition: ids never move through a shuffle, a task holds one window, and a
row is at most one window's last rows away from the packing of a whole table.

Written, one record per row of the matrix: the ids (unsigned 16-bit,
little-endian, padded with the end id), cumulative segment lengths from 0,
position ids that restart at each segment, and for each segment its document
and its start in that document.

Defined cases: a null or empty text is the end id alone; equal rows are packed
one by one; a null ``doc_id`` stays null in the lists; an empty table writes an
empty matrix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary_packing import with_end
from .byte_bpe import ByteFiles, byte_encoder
from .common import as_bytes, bounded_batches, pieces_by_bytes
from .encoding import encoder


class FreeLengths:
    """Segment tree over 1..size; a leaf holds the open rows with that free length."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, free: int, n: int) -> None:
        node = free + self.width
        while node:
            self.count[node] += n
            node >>= 1

    def push(self, free: int, row: int) -> None:
        if free:
            self.rows[free].append(row)
            self._add(free, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Take the row with the smallest free length of at least ``need``; ``(free, row)``."""
        node = need + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.width
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of segment numbers; no row exceeds ``size``.  Equal lengths keep their order."""
    free, rows = FreeLengths(size), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = free.best(n)
        if found is None:
            rows.append([k])
            free.push(size - n, len(rows) - 1)
        else:
            rows[found[1]].append(k)
            free.push(found[0] - n, found[1])
    return rows


def row_cuts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the segments of documents of these lengths: full rows, then the rest."""
    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = index * size
    return owner, start, np.minimum(size, lengths[owner] - start)


def packed_matrix(docs: DataFrame, tokenizer_path: str | None = None, units: str = "spaces", end_id: int = 0, row: int = 2048, text: str = "text",
                  doc_id: str = "doc_id", window_tokens: int = 1 << 21, byte_files: ByteFiles | None = None) -> DataFrame:
    """One record per matrix row: ``ids``, ``position_ids`` (binary), ``cu_seqlens``, ``doc_ids``, ``starts``, ``n_tokens``.

    The tokenizer is ``byte_files``, or the file ``tokenizer_path`` cut into ``units`` (see ``encoding``).
    """
    source = docs.select(F.col(doc_id).cast("long").alias("_llm_id"), F.col(text).alias("_llm_text"))

    def pack(window: list[tuple[list, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names = [x for w in window for x in w[0]]
        ids, n = np.concatenate([w[1] for w in window]), np.concatenate([w[2] for w in window])
        owner, start, size = row_cuts(n, row)
        at = (np.cumsum(n) - n)[owner] + start
        out: dict[str, list] = {k: [] for k in ("ids", "position_ids", "cu_seqlens", "doc_ids", "starts", "n_tokens")}
        for segments in best_fit_decreasing(size, row):
            matrix, position = np.full(row, end_id, "<u2"), np.zeros(row, "<u2")
            ends = np.cumsum(size[segments])
            for s, e in zip(segments, ends.tolist(), strict=True):
                m = int(size[s])
                matrix[e - m:e] = ids[at[s]:at[s] + m]
                position[e - m:e] = np.arange(m)
            out["ids"].append(matrix.tobytes())
            out["position_ids"].append(position.tobytes())
            out["cu_seqlens"].append([0, *ends.tolist()])
            out["doc_ids"].append([names[owner[s]] for s in segments])
            out["starts"].append(start[segments].tolist())
            out["n_tokens"].append(int(ends[-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(out["ids"], pa.binary()), pa.array(out["position_ids"], pa.binary()), pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
             pa.array(out["doc_ids"], pa.list_(pa.int64())), pa.array(out["starts"], pa.list_(pa.int64())), pa.array(out["n_tokens"], pa.int32())],
            names=list(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(byte_files) if byte_files else encoder(tokenizer_path, units).encode
        window, tokens = [], 0
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", 1 << 21):
                ids, n = with_end(*encode(as_bytes(batch.column("_llm_text"))), end_id)
                window.append((batch.column("_llm_id").to_pylist(), ids, n))
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield pack(window)
                    window, tokens = [], 0
        if window:
            yield pack(window)

    if row > 1 << 16 or end_id >= 1 << 16:
        raise ValueError("positions and ids are written as unsigned 16-bit numbers")
    return bounded_batches(source).mapInArrow(run, "ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, "
                                  "starts array<bigint>, n_tokens int")


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the matrix below ``path`` with its row numbers and read it back."""
    packed_matrix(docs, **options).withColumn("row_id", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
