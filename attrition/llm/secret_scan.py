"""Secret scan with structural confirmation.

Base spans are found by pattern: assignments to a secret's name (``assign``),
access key ids (``access``) and long hex runs (``hex``).  Further spans are
reported only if what they encode proves to be a secret:

* ``pem``     a PEM block whose body decodes to a private key, or is the
              ciphertext that its ``DEK-Info`` line announces;
* ``key``     base64 that decodes to a private key or to such a PEM block;
* ``jwt``     a signed token: three base64url parts of which the first decodes
              to a JSON object with an algorithm and the second to a JSON object;
* ``hexkey``  hex that decodes to a private key.

A PEM body may have header lines, escaped line ends (backslash n) and quotes,
indents or comment signs around its lines.  Base64 and hex may be wrapped, with
plain or escaped line ends, if the first line has ``LINE`` characters; the key
may start anywhere in it and ends with a line or before a path sign.  Escapes
may be doubled, up to eight backslashes.

A private key is DER whose nested lengths fill the value exactly and whose
members are those of PKCS#1, PKCS#8, SEC1 or an encrypted PKCS#8 key, or an
``openssh-key-v1`` container whose length-prefixed fields fit.  A random run of
the same length does not pass.

Spans are in code points, end exclusive.  A span of a kind never overlaps
another of that kind; kinds may overlap.  Order: start, then kind as listed.

Defined cases: a null text counts as empty and has no spans; equal rows are
scanned one by one; an empty table gives an empty result; the input's other
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, pieces_by_bytes

KINDS = ("assign", "access", "hex", "pem", "key", "jwt", "hexkey")

# Patterns run on UTF-8 bytes, so "either case" means ASCII letters only.
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # whole runs: a shorter one fails anyway
_ARMOUR = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_ENCRYPTED = re.compile(rb"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*([A-Za-z0-9-]+),\s*((?:[0-9A-Fa-f]{2})+)\s")
_HEADER = re.compile(rb"(?m)^[A-Za-z][A-Za-z0-9-]*:.*$")
_LINE_DRESS = re.compile(rb"""(?m)["'`][ \t+.,;&)\\]*$|^[ \t>#*|"'`]+|(?<![ \t\\])[ \t\\]++$""")
#: Wrapped base64 (and hex, whose alphabet is a part): lines of it with plain or escaped ends; a slash may be escaped.
LINE = 16
_BLOCK = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]|\\{1,8}/){%d,}+(?:(?:[ \t]*+(?:\r?\n|(?:\\{1,8}[rn])++)[ \t]*+)++(?:[A-Za-z0-9+/_-]|\\{1,8}/)++)*+" % LINE)
_SEGMENT = re.compile(rb"((?:\\{1,8}[rn])++)|\\{1,8}|([A-Za-z0-9+/_-]++)")
#: Where a key can start in base64: a DER sequence shorter than 2^32, the OpenSSH magic, or PEM armour at any of three offsets.
_SSH_MAGIC = b"openssh-key-v1\0"
_ARMOURS = [base64.b64encode(b"\0" * k + b"-----BEGIN ")[(4 * k + 2) // 3:(4 * (k + 11)) // 3] for k in range(3)]
_KEY_START = re.compile(b"M[A-I]|" + base64.b64encode(_SSH_MAGIC) + b"|" + b"|".join(b"(%s)" % re.escape(a) for a in _ARMOURS))
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{64,}")
_HEX_START = re.compile(b"30(?:[0-7][0-9a-f]|8[1-4])|" + _SSH_MAGIC.hex().encode(), re.I)
_JWT = re.compile(rb"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")


def unbase64(raw: bytes) -> bytes | None:
    """Decoded standard or URL-safe base64, padding optional; None if it is not base64."""
    body = re.sub(rb"\s+", b"", raw).rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_values(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the DER values that fill ``data`` exactly; None if the lengths do not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n, at = int.from_bytes(data[at:at + width], "big"), at + width
            if n < 0x80 or n < 1 << 8 * (width - 1):  # DER writes the shortest length
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


def der_private_key(data: bytes) -> bool:
    """PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8, checked through all nested lengths."""
    outer = der_values(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    members = der_values(outer[0][1])
    if not members:
        return False
    tags = [t for t, _ in members]
    nested = [der_values(v) if t & 0x20 else [] for t, v in members]
    if None in nested:
        return False
    if tags[:9] == [0x02] * 9:  # version, n, e, d, p, q, dp, dq, qinv
        return members[0][1] in (b"\0", b"\1") and len(members[1][1]) >= 32
    if tags[:2] == [0x02, 0x04] and members[0][1] == b"\1":  # SEC1: version 1, key
        return len(members[1][1]) >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and members[0][1] in (b"\0", b"\1"):  # version, algorithm, key
        inner = members[2][1]
        return nested[1][:1] != [] and nested[1][0][0] == 0x06 and (der_private_key(inner) or (der_values(inner) or [(0, b"")])[0][0] == 0x04)
    if tags == [0x30, 0x04]:  # encryption scheme, data
        return bool(nested[0]) and nested[0][0][0] == 0x06 and len(members[1][1]) >= 16
    return False


def der_length(data: bytes) -> int:
    """Bytes of the DER sequence that ``data`` starts with, by its outer length; 0 if it cannot be a private key."""
    if len(data) < 8 or data[0] != 0x30:
        return 0
    width = data[1] & 0x7F if data[1] >= 0x80 else 0
    if width > 4:
        return 0
    inside = data[2 + width:5 + width]
    if inside[:2] != b"\x02\x01" and inside[:1] != b"\x30":
        return 0
    return 2 + width + (int.from_bytes(data[2:2 + width], "big") if data[1] >= 0x80 else data[1])


#: Decoded bytes on demand: ``read(i, j)`` gives at most the bytes i to j of what a run encodes.
Reader = Callable[[int, int], bytes]
#: Members of a DER sequence that is looked at; private keys have ten at most.
MEMBERS = 64


def base64_reader(run: bytes, start: int) -> Reader:
    """The bytes of base64 from ``start``, decoding only the characters that are asked for."""
    def read(i: int, j: int) -> bytes:
        quad = start + i // 3 * 4
        raw = run[quad:max(quad, start + -(-j // 3) * 4)]
        return (unbase64(raw[:len(raw) - (len(raw) % 4 == 1)]) or b"")[i - i // 3 * 3:][:max(0, j - i)]
    return read


def hex_reader(run: bytes, start: int, end: int) -> Reader:
    def read(i: int, j: int) -> bytes:
        raw = run[start + 2 * i:min(end, start + 2 * j)]
        return bytes.fromhex(raw[:len(raw) // 2 * 2].decode())
    return read


def sequence_fits(read: Reader, size: int) -> bool:
    """The lengths of the members of a DER sequence of ``size`` bytes lead exactly to its end; only headers are decoded."""
    at = 2 + (read(1, 2)[0] & 0x7F if read(1, 2) >= b"\x80" else 0)
    for _ in range(MEMBERS):
        if at >= size:
            break
        head = read(at, at + 6)
        width = head[1] & 0x7F if len(head) > 1 and head[1] >= 0x80 else 0
        if len(head) < 2 + width or width > 4 or head[0] & 0x1F == 0x1F:
            return False
        at += 2 + width + (int.from_bytes(head[2:2 + width], "big") if head[1] >= 0x80 else head[1])
    return at == size


def openssh_length(read: Reader, size: int) -> int:
    """Bytes of the ``openssh-key-v1`` container at the start: magic, then cipher, KDF, options, number of keys, public keys,
    private part.  Only the magic and the lengths are decoded."""
    at, fields, keys = len(_SSH_MAGIC), 0, 0
    if read(0, at) != _SSH_MAGIC:
        return 0
    while at + 4 <= size:
        n, at = int.from_bytes(read(at, at + 4), "big"), at + 4
        if fields == 3:
            keys = n
        elif at + n > size:
            return 0
        else:
            at += n
        fields += 1
        if fields == 5 + keys:
            return at if keys >= 1 else 0
    return 0


def openssh_private_key(data: bytes) -> bool:
    """An ``openssh-key-v1`` container that fills ``data``."""
    return bool(data) and openssh_length(lambda i, j: data[i:j], len(data)) == len(data)


def private_key(data: bytes | None) -> bool:
    return bool(data) and (openssh_private_key(data) or der_private_key(data))


def pem_private_key(body: bytes) -> bool:
    """What stands between the armour lines: headers, then base64 of a private key or of the announced ciphertext."""
    body = re.sub(rb"\\{1,8}u00([0-7][0-9A-Fa-f])", lambda m: bytes.fromhex(m[1].decode()), body)
    body = re.sub(rb"\\{1,8}(?=/)", b"", re.sub(rb"(?:\\{1,8}[rn])+|\r\n?", b"\n", body))
    body = _LINE_DRESS.sub(b"", body)
    scheme = _ENCRYPTED.search(body)
    if scheme:
        data, block = unbase64(_HEADER.sub(b"", body[scheme.end():])), len(scheme[2]) // 2
        return bool(data) and len(data) >= 32 and (not re.search(rb"CBC|ECB", scheme[1]) or len(data) % block == 0)
    return private_key(unbase64(_HEADER.sub(b"", body)))


def armoured(run: bytes, quad: int) -> tuple[int, int]:
    """Start and end of the PEM block of a private key that the base64 from ``quad`` opens with, as ``(first byte, end in
    run)``, or (0, 0).  Twice as much is decoded until the armour after the first one is there with what follows it."""
    size = 512
    while True:
        whole = quad + size >= len(run)
        data = unbase64(run[quad:len(run) - ((len(run) - quad) % 4 == 1)] if whole else run[quad:quad + size]) or b""
        marks = list(islice(_ARMOUR.finditer(data), 2))
        if whole or len(marks) == 2 and len(data) - marks[1].end() >= 16:
            break
        size *= 2
    found = pem_spans(data[:marks[1].end()]) if len(marks) == 2 else []
    if not found or found[0][0] > 2:
        return 0, 0
    first, used = found[0]
    line_ends = len(data) - used - len(data[used:].lstrip(b"\r\n"))
    return first, quad - (-4 * (used + line_ends) // 3)


def pem_spans(text: bytes) -> list[tuple[int, int]]:
    """Start and end of the PEM blocks that hold private keys."""
    marks = list(_ARMOUR.finditer(text))
    return [(a.start(), b.end()) for a, b in zip(marks, marks[1:])
            if a[1] == b"BEGIN" and b[1] == b"END" and a[2] == b[2] and pem_private_key(text[a.end():b.start()])]


def base64_keys(run: bytes, ends: set[int]) -> Iterator[tuple[int, int]]:
    """Start and end of keys in the characters of a base64 block; ``ends``: where its lines end."""
    at = 0
    while m := _KEY_START.search(run, at):
        start, at = m.start(), m.start() + 1
        end = 0
        if m.lastindex:  # PEM armour; the first whole character of it stands for its offset in the three bytes
            quad = start - (4 * (m.lastindex - 1) + 2) // 3
            if quad < 0 or not re.match(rb"(?s).{0,2}-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", unbase64(run[quad:quad + 84]) or b""):
                continue
            first, end = armoured(run, quad)
            start = quad + (4 * first) // 3
        elif m[0].startswith(b"M"):
            used = der_length(unbase64(run[start:start + 16]) or b"")
            n = -(-4 * used // 3)
            if 48 <= n <= len(run) - start and sequence_fits(base64_reader(run, start), used) and der_private_key(unbase64(run[start:start + n]) or b""):
                end = start + n
        else:
            used = openssh_length(base64_reader(run, start), (len(run) - start) * 3 // 4)
            end = start - (-4 * used // 3) if used else 0
        if end and (m.lastindex or end in ends or run[end:end + 1] in b"/_-"):
            yield start, end
            at = end


def hex_keys(run: bytes, ends: set[int]) -> Iterator[tuple[int, int]]:
    """Start and end of keys in the hex runs of a block; a digit may be glued to either side."""
    for whole in _HEX_RUN.finditer(run):
        at = whole.start()
        while m := _HEX_START.search(run, at, whole.end()):
            start, at = m.start(), m.start() + 1
            room = (whole.end() - start) // 2
            used = der_length(bytes.fromhex(run[start:start + 2 * min(room, 12)].decode()))
            if not used and not m[0].startswith(b"30"):
                used = openssh_length(hex_reader(run, start, whole.end()), room)
            elif not (32 <= used <= room and sequence_fits(hex_reader(run, start, whole.end()), used)):
                continue
            end = start + 2 * used
            if 32 <= used <= room and (end in ends or whole.end() - end < 2) and private_key(bytes.fromhex(run[start:end].decode())):
                yield start, end
                at = end


def block_spans(text: bytes) -> Iterator[tuple[int, int, str]]:
    """``key`` and ``hexkey`` spans: keys in blocks of base64 or hex, whose line ends are taken out first."""
    for block in _BLOCK.finditer(text):
        parts, places, size, ends = [], [], 0, set()  # places: where a part starts in the joined run and in the text
        for m in _SEGMENT.finditer(text, block.start(), block.end()):
            if m[2]:
                if parts and places[-1][2] != m.start():
                    ends.add(size)
                parts.append(m[2])
                places.append((size, m.start(), m.end()))
                size += len(m[2])
        ends.add(size)
        run, firsts = b"".join(parts), [p[0] for p in places]

        def place(x: int) -> int:
            joined, here, _ = places[bisect_right(firsts, x) - 1]
            return here + x - joined

        for start, end in base64_keys(run, ends):
            stop = place(end - 1) + 1
            pad = -(end - start) % 4
            yield place(start), stop + len(re.match(rb"={0,%d}" % min(pad, 2), text[stop:stop + 2])[0]), "key"
        for start, end in hex_keys(run, ends):
            yield place(start), place(end - 1) + 1, "hexkey"


def signed_token(header: bytes, payload: bytes) -> bool:
    """A JWT: the header is a JSON object naming its algorithm, the payload a JSON object."""
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def byte_spans(text: bytes) -> list[tuple[int, int, str, int]]:
    """Start, end, kind and start of the secret itself, in bytes; in the final order."""
    out = [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    out += [(a, b, "pem", a) for a, b in pem_spans(text)]
    out += [(a, b, kind, a) for a, b, kind in block_spans(text)]
    out += [(m.start(), m.end(), "jwt", m.start()) for m in _JWT.finditer(text) if signed_token(m[1], m[2])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans(text: bytes) -> list[dict]:
    """The spans of one UTF-8 text in code points."""
    found = byte_spans(text)
    if not found:
        return []
    if text.isascii():
        return [{"kind": k, "start": s, "end": e, "secret": p} for s, e, k, p in found]
    place, at, seen = {}, 0, 0
    for b in sorted({x for s, e, _, p in found for x in (s, e, p)}):
        seen += len(text[at:b].decode("utf-8", "replace"))
        place[b], at = seen, b
    return [{"kind": k, "start": place[s], "end": place[e], "secret": place[p]} for s, e, k, p in found]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,secret:bigint>>"


def _mapped(docs: DataFrame, keep: tuple[str, ...], text: str, column: str, kind: str, arrow: pa.DataType, fn) -> DataFrame:
    source = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text).alias("_llm_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_by_bytes(whole, "_llm_text", 1 << 23):
                found = pa.array(fn(batch.column("_llm_text")), arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, column])

    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(f"`{column}` {kind}").fields])
    return bounded_batches(source).mapInArrow(run, schema)


def secret_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans`` of every whole text; a map without shuffle.

    ``secret`` is where the secret itself starts inside the span (after the
    name and the sign of an assignment).
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.int64())]))
    return _mapped(docs, keep, text, "spans", SPANS, arrow, lambda col: [spans(t) for t in as_bytes(col)])


def spans_of(kinds: tuple[str, ...], spans_column: str = "spans") -> Column:
    """The spans of some kinds, in order."""
    return F.filter(F.col(spans_column), lambda s: s["kind"].isin(*kinds))


def joined(kinds: tuple[str, ...] = KINDS, spans_column: str = "spans") -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined in order."""
    chosen = spans_of(kinds, spans_column)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: bytes, mask: bytes = b"[SECRET]") -> bytes:
    """The text with every secret replaced; overlapping secrets by one mask."""
    out, at, until = [], 0, 0
    for p, e in sorted((p, e) for _, e, _, p in byte_spans(text)):
        if p >= until:
            out += [text[at:p], mask]
        at = until = max(until, e)
    return b"".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the secrets in ``text`` masked; a null text stays null."""
    rest = tuple(c for c in docs.columns if c != text)

    def fn(column: pa.Array) -> list:
        raw = as_bytes(column)
        return [redact(t).decode("utf-8", "replace") if ok else None for t, ok in zip(raw, column.is_valid().to_pylist(), strict=True)]

    return _mapped(docs, rest, text, text, "string", pa.string(), fn).select(*[F.col(f"`{c}`") for c in docs.columns])
