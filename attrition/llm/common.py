"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.session import checkpoint_dir
from attrition.sources.io import delete_path

_SCOPE: ContextVar[list[str] | None] = ContextVar("llm_scratch", default=None)
#: Bits of the largest row filter: 8 MB, whatever the table's size.
FILTER_BITS = 1 << 26


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; an open ``scratch_scope`` deletes it at its end."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    held = _SCOPE.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end; what is to stay must be written to a path taken before."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        held = _SCOPE.get()
        _SCOPE.reset(token)
        for path in held or ():
            delete_path(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only tasks that read the written
    files, and a table that is read by two consumers is computed once.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_filter(rows: DataFrame, row: str, name: str = "_llm_maybe") -> tuple[DataFrame, Column, Column]:
    """A bitmap over hashed row numbers of a written table: ``(bitmaps, key, hit)``.

    A frame with a column ``row`` that is joined to ``bitmaps`` (small by construction, so broadcast) on its ``key`` has
    ``hit`` true for every row of ``rows`` and for few others.  The bitmap has 16 bits a row and FILTER_BITS at most: beyond
    that it only passes more rows, which an exact join after it takes out.
    """
    bits = 1 << 15
    wanted = 16 * rows.count()
    while bits < wanted and bits < FILTER_BITS:
        bits *= 2
    at = F.pmod(F.xxhash64(row), F.lit(bits))
    maps = rows.select(at.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(f"{name}_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(f"{name}_map"))
    place = F.bitmap_bit_position(at)
    octet = F.conv(F.hex(F.substring(F.col(f"{name}_map"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", octet, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return F.broadcast(maps), F.bitmap_bucket_number(at) == F.col(f"{name}_bucket"), hit


def kept_columns(keep: Sequence[str], outputs: Sequence[str]) -> tuple[str, ...]:
    """The columns to keep that no output column replaces (names are compared as Spark does, without case)."""
    taken = {x.lower() for x in outputs}
    return tuple(k for k in keep if k.lower() not in taken)


def bounded_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, after limiting the session's Arrow batches to ``rows`` rows.

    The default of 10,000 rows is meant for narrow rows; with whole texts the
    buffers of such batches, on both sides, would be most of a worker's memory.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(conf.get(key))
    if before <= 0 or before > rows:
        conf.set(key, str(rows))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts total about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
