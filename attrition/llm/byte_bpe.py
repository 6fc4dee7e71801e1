"""Token ids of a byte-level tokenizer, by the faster of two libraries where both surely agree.

The JSON file defines the ids; the rank file is the same vocabulary for a
library that encodes whole texts about four times as fast.  It is used for texts
of characters that every version of both libraries classes alike and without very
long unbroken runs; all others go to the JSON file's own library.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Border of a piece of a long text: spaces with a character behind them, after a character that is no kind of space.
_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎​﻿])(?= +[^ ])")
#: Texts on which the two byte-level libraries agree by construction and neither is slow.
_COMMON = re.compile("[\t\n\x20-\x7e\xa1-ɏ]*")
_RUN = re.compile(r"\S{2000}|\s{2000}")


@dataclass(frozen=True)
class ByteFiles:
    """``json`` defines the ids; ``ranks`` is the same vocabulary for the faster library, with its ``pattern``."""

    json: str
    ranks: str
    pattern: str


class ByteTokens:
    """Ids and their byte strings."""

    def __init__(self, files: ByteFiles):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken

        self.path, self._library = files.json, None
        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        with open(files.json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        size = 1 + max(vocab.values())
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 onwards
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes: list[bytes] = [b""] * size
        for entry, i in vocab.items():
            if all(ch in byte for ch in entry):
                self.bytes[i] = bytes(byte[ch] for ch in entry)

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = t = Tokenizer.from_file(self.path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = True
        return self._library

    def encode(self, text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not _RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.library().encode(text, add_special_tokens=False).ids


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cut at the first border after every ``limit`` characters; all but the first begin with their space."""
    start = 0
    while len(text) - start > limit:
        border = _CUT.search(text, start + limit)
        if border is None:
            break
        yield text[start:border.start()]
        start = border.start()
    yield text[start:]


_LOADED: dict[ByteFiles, ByteTokens] = {}


def byte_encoder(files: ByteFiles, piece_chars: int = 1 << 16):
    """``encode(texts)``: all ids of UTF-8 texts, flat, and the number of ids of each; a reused worker keeps its tokenizer."""
    if files not in _LOADED:
        _LOADED[files] = ByteTokens(files)
    one = _LOADED[files].encode

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array([i for p in pieces(t.decode("utf-8", "replace"), piece_chars) for i in one(p)] if len(t) > piece_chars
                          else one(t.decode("utf-8", "replace")), np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
    return encode
