"""Token counts: batch encoding in an Arrow function that returns lengths only.

Rows reach the library in batches of about equal bytes rather than equal rows,
and a long text is cut into pieces at borders where the tokenizer's splitting
always starts a new pre-token, so the counts of the pieces add up to the count
of the whole text and one text never fills a batch's memory with its encoding.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); equal rows are
counted one by one; a null ``doc_id`` stays null; an empty table gives an empty
result; other columns of the input are ignored unless named in ``keep``, and an output
column replaces a kept one of its name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, kept_columns, pieces_by_bytes

#: A non-space character before a space or line feed: a byte-level or word
#: tokenizer starts a new pre-token there whatever stands around it.
SAFE_BORDER = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎​﻿])(?=[ \n])")

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The worker's tokenizer of this file, without truncation or padding."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _LOADED[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _LOADED[path]


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut at the first safe border after every ``limit`` characters; one piece where there is none."""
    out, start = [], 0
    while len(text) - start > limit:
        border = SAFE_BORDER.search(text, start + limit)
        if border is None:
            break
        out.append(text[start:border.start()])
        start = border.start()
    out.append(text[start:])
    return out


def _lengths(texts: list[bytes], path: str, piece_chars: int, batch_bytes: int) -> np.ndarray:
    """Token counts of the texts, encoding runs of pieces of about ``batch_bytes``."""
    counts = np.zeros(len(texts), np.int64)
    encode = tokenizer(path).encode_batch_fast
    waiting, owners, size = [], [], 0

    def flush() -> None:
        np.add.at(counts, owners, [len(e) for e in encode(waiting, add_special_tokens=False)])
        waiting.clear(), owners.clear()

    for k, raw in enumerate(texts):
        for piece in safe_pieces(raw.decode("utf-8", "replace"), piece_chars) if raw else ():
            waiting.append(piece)
            owners.append(k)
            size += len(raw) if len(piece) == len(raw) else len(piece.encode("utf-8", "replace"))
            if size >= batch_bytes:
                flush()
                size = 0
    if waiting:
        flush()
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 18, piece_chars: int = 1 << 15) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row's whole text.

    A map over the input's partitions: no shuffle, and a lost task is simply
    run again on its own split.
    """
    keep = kept_columns(keep, ("n_bytes", "n_tokens", "over_limit"))
    source = docs.select(*keep, F.col(text).alias("_llm_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", 1 << 23):
                texts = as_bytes(batch.column("_llm_text"))
                n = _lengths(texts, tokenizer_path, piece_chars, batch_bytes)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array([len(t) for t in texts], pa.int64()), pa.array(n),
                     pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return bounded_batches(source).mapInArrow(run, f"{kept}, n_bytes bigint, n_tokens bigint, over_limit boolean")
