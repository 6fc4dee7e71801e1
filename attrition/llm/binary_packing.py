"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into pieces whose lengths are the
binary digits of their number: whole contexts first, then the powers of two
that add up to the rest, largest first.  Every piece is a sequence of its own,
so no sequence crosses documents and none needs padding; pieces of one length
form a bucket from which batches of equal tokens are drawn.

A map over the input's partitions: tokenizing and cutting need no shuffle, and
a batch of texts of bounded bytes is in memory at a time.

Defined cases: a null or empty text is the end id alone (one piece of length
1); equal rows are packed one by one; a null ``doc_id`` stays null; an empty
table gives an empty result; other columns are ignored unless named in
``keep``, and output columns win over input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, kept_columns, pieces_by_bytes
from .encoding import encoder


def binary_cuts(lengths: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of all pieces, in order; ``context`` is a power of two.

    A length n has n // context whole pieces and one piece for each binary
    digit of n % context.
    """
    whole = lengths // context
    bits = np.array([1 << k for k in reversed(range(context.bit_length() - 1))], np.int64)
    has = (lengths[:, None] & bits) > 0
    owner = np.concatenate([np.repeat(np.arange(len(lengths)), whole), np.nonzero(has)[0]])
    size = np.concatenate([np.full(int(whole.sum()), context, np.int64), np.broadcast_to(bits, has.shape)[has]])
    order = np.lexsort((-size, owner))
    owner, size = owner[order], size[order]
    ends = np.cumsum(size)
    before = np.concatenate([[0], np.cumsum(lengths)])
    return owner, ends - size - before[owner], size


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat ids with ``end_id`` after each document, and the new lengths."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def slices(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose values tile the flat id array, without a copy."""
    data = np.ascontiguousarray(flat)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def binary_pieces(docs: DataFrame, tokenizer_path: str, units: str, context: int = 2048, end_id: int = 1,
                  text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 22,
                  memo_units: int | None = None) -> DataFrame:
    """One row per piece: ``keep``, ``start``, ``length``, ``doc_tokens``, ``ids`` (unsigned 32-bit,
    little-endian), ``sequence_id`` and ``offset`` (0: a sequence is one piece).

    A worker remembers the ids of ``memo_units`` distinct units at most (null: ``encoding.MEMO_UNITS``).
    ``length`` names the bucket.  A sequence id is the number of the partition
    and of the piece in it, which a recomputed task repeats.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    keep = kept_columns(keep, ("start", "length", "doc_tokens", "ids", "sequence_id", "offset"))
    source = docs.select(*keep, F.col(text).alias("_llm_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, units, memo_units).encode
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", batch_bytes):
                ids, n = with_end(*encode(as_bytes(batch.column("_llm_text"))), end_id)
                owner, start, size = binary_cuts(n, context)
                kept = [batch.column(c).take(pa.array(owner)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(start), pa.array(size), pa.array(n[owner]), slices(ids.astype("<u4"), size).cast(pa.binary())],
                    names=[*keep, "start", "length", "doc_tokens", "ids"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return (bounded_batches(source).mapInArrow(run, kept + "start bigint, length bigint, doc_tokens bigint, ids binary")
            .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length: ``length=64/...``; the id column of a folder is a matrix of equal rows."""
    pieces.write.partitionBy("length").parquet(path)
