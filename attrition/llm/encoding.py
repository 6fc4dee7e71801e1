"""Token ids by the ``tokenizers`` library, encoding each distinct unit of text once per worker.

A text is cut only where the tokenizer's own splitting always starts a new
pre-token, so the ids of a text are the concatenated ids of its units:

* ``words``: the tokenizer drops white space and never joins across it, so the
  units are the words between ASCII white space;
* ``spaces``: a byte-level tokenizer attaches one leading space to a word.
  Between a non-space character and a following space or line feed there is
  always a pre-token border, so units start there.  A text with irregular
  white space (two in a row, or other Unicode spaces) is cut by a regular
  expression at the same borders instead.

Units repeat heavily, so a worker keeps a bounded memo from unit to ids; the
library encodes the units that are missing, many in one batch.  A unit is as
long as the text between two borders, whatever that is; nothing is truncated.
Punctuation after a letter or digit is a pre-token of its own, and the word
tokenizer lowers case, so ``Word.`` is looked up as ``word`` and ``.``.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .token_counts import SAFE_BORDER

#: Distinct units, and bytes of units and ids, that a worker's memo holds before it starts over; bounds its memory (about 250 MB).
MEMO_UNITS = 1_200_000
MEMO_BYTES = 1 << 26

_TAIL = re.compile("(.*[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([.,!?;:#*$%&|]+)", re.DOTALL)
_ENCODERS: dict[str, "UnitEncoder"] = {}


class _Memo(dict):
    """Unit -> number; a new unit gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.size = 0
        self.bytes = 0

    def __missing__(self, unit: bytes) -> int:
        self[unit] = n = self.size
        self.size += 1
        self.bytes += len(unit)
        self.new.append(unit)
        return n


class UnitEncoder:
    """Encode batches of UTF-8 texts to one flat id array and text borders."""

    def __init__(self, tokenizer_path: str, units: str, memo_units: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = units
        self.memo_units = memo_units
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.irregular = np.zeros(1 << 16, bool)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n_ids = 0

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _parts(self, unit: bytes) -> list[bytes] | None:
        """Simpler units with the same ids, or None if the library has to encode this one."""
        low = unit.lower() if self.units == "words" and b"<|" not in unit else unit  # ASCII letters only
        tail = _TAIL.fullmatch(low.decode("utf-8", "replace"))
        if tail:
            return [tail[1].encode(), tail[2].encode()]
        return None if low == unit else [low]

    def _learn(self) -> None:
        new = self.memo.new
        if not new:
            return
        first, plain, built, parts = self.memo.size - len(new), [], [], []
        for k, unit in enumerate(new):  # parts that are new themselves join the list while it is walked
            simpler = self._parts(unit)
            if simpler is None:
                plain.append(k)
            else:
                built.append(k)
                parts.append([self.memo[x] for x in simpler])
        for name in ("starts", "lengths", "irregular"):
            setattr(self, name, self._grown(getattr(self, name), self.memo.size))
        for k in range(0, len(plain), 4096):
            at = np.array(plain[k:k + 4096])
            texts = [new[i].decode("utf-8", "replace") for i in at]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._store(first + at, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        if built:
            flat = np.fromiter(chain.from_iterable(parts), np.int64)
            sizes = np.add.reduceat(self.lengths[flat], np.cumsum([0, *map(len, parts[:-1])]))
            self._store(first + np.array(built), self._ids_of(flat), sizes)
        if self.units == "spaces":
            self.irregular[first:self.memo.size] = [
                not t.strip(" \n") or t[-1].isspace() or t[-1] in "\x85\u180e\u200b\ufeff" or t[:2].isspace() and len(t) > 1
                for t in (u.decode("utf-8", "replace") for u in new)]
        self.memo.new = []

    def _store(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = self._grown(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.starts[numbers] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.n_ids += len(ids)

    def _ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of units one after another."""
        lengths = self.lengths[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)]

    def _cut(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if self.units == "words":
            return text.split()
        # every unit but the first starts with its space or line feed; "\x20" is put back by the join
        parts = text.replace(b"\n", b" \n").split(b" ")
        return [parts[0]] * (parts[0] != b"") + [p if p[:1] == b"\n" else b" " + p for p in parts[1:]]

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, flat, and each text's count of units.

        A unit's number is only valid until the next call: a full memo starts over.
        """
        if self.memo.size > (self.memo_units or MEMO_UNITS) or self.memo.bytes + self.ids.itemsize * self.n_ids > MEMO_BYTES:
            self._reset()
        get = self.memo.__getitem__
        found = [list(map(get, self._cut(t))) for t in texts]
        self._learn()
        if self.units == "spaces":
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
            odd = np.unique(np.repeat(np.arange(len(found)), counts)[self.irregular[flat]])
            for k in odd:
                found[k] = list(map(get, (u.encode() for u in SAFE_BORDER.split(texts[k].decode("utf-8", "replace")))))
            self._learn()
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, flat, and the number of ids of each text."""
        flat, counts = self.numbers(texts)
        totals = np.concatenate([[0], np.cumsum(self.lengths[flat], dtype=np.int64)])
        borders = np.cumsum(counts)
        return self._ids_of(flat), totals[borders] - totals[borders - counts]


def encoder(tokenizer_path: str, units: str, memo_units: int | None = None) -> UnitEncoder:
    """The worker's encoder of this file; a reused worker keeps its memo."""
    key = f"{units}:{memo_units}:{tokenizer_path}"
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = UnitEncoder(tokenizer_path, units, memo_units)
    return _ENCODERS[key]
