"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writing.  A page becomes a gzip member holding one WARC/1.1 record, and Spark's
text sink writes the members to archive files in any store Spark reaches (the
line separator is one zero byte, the padding that gzip readers skip between
members).  Pages with equal payloads of at least ``MIN_REVISIT`` bytes are kept
once, with the smallest page id; the others become revisit records.

Reading.  The archive files are read as binary files, each whole in a task, so
the writer bounds their size.  The reader walks from record to record.  When a
check fails (the member's checksum, the version line, the header fields, the
content length, the record's end, the payload digest) it searches for the next
place where a whole record reads correctly, a gzip member or a bare version
line, goes on from there, and logs the bytes in between as a quarantined gap
with the reason.  A member may hold several records: the walk goes on at the
next version line inside it, and of a member that inflates in part only the
records whose payload digest agrees are given.  No later record is lost to earlier damage.

Defined cases: a null html is an empty payload; a null url is an empty target;
of equal payloads exactly one row is the response, the first by page id (nulls
last) and place in the table, and every other one a revisit, equal rows and rows
with a null page id too; a null page id is written as an empty id, and a revisit of
it has no ``WARC-Refers-To``; an empty table gives no records; other columns are
ignored.  The pages must be a stored table: a row is known by its place in it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches

MIN_REVISIT = 100
#: Keys that a group of equal payloads is spread over.
GROUP_SALTS = 32
VERSION = b"WARC/1.1"
#: The record types of the standard.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
_ID = "urn:page:"


def deduplicated(pages: DataFrame, salts: int = GROUP_SALTS) -> DataFrame:
    """``page_id, url, html, digest, revisit, refers_to``: whether an equal page comes first, and that page's id.

    The first page per digest is a partial aggregate over narrow rows.  Only
    digests that occur twice go back to the pages, each copied to ``salts``
    keys, and a page looks up the copy that its own salt names.
    """
    c = F.col
    html = F.coalesce(c("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.monotonically_increasing_id().alias("_llm_row"))
    first = F.struct(c("page_id").isNull().alias("no_id"), c("page_id").alias("id"), c("_llm_row").alias("row"))
    firsts = (pages.filter(F.octet_length("html") >= MIN_REVISIT).groupBy(c("digest").alias("_llm_digest"))
              .agg(F.min(first).alias("_llm_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
              .withColumn("_llm_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salted = pages.withColumn("_llm_key", F.pmod(F.xxhash64("_llm_row"), F.lit(salts)).cast("int"))
    joined = salted.join(firsts, (c("digest") == c("_llm_digest")) & (c("_llm_key") == c("_llm_salt")), "left")
    revisit = F.coalesce(c("_llm_row") != c("_llm_first.row"), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, c("_llm_first.id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool | None = None) -> bytes:
    """One WARC record; a revisit has the fields of the full payload but no block.

    Without ``revisit`` a record that refers to a page is one; a revisit of a page with a null id has to be named so.
    """
    revisit = refers_to is not None if revisit is None else revisit
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>"]
    block = b"" if revisit else payload
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, records_per_file: int = 2000, max_bytes: int = 1 << 28) -> None:
    """Write archives of at most ``records_per_file`` records and ``max_bytes`` (or one record) below ``path``.

    Pages longer than their share of an archive are written apart, fewer to an
    archive; equal payloads are of one length and stay together.
    """
    share = max_bytes // records_per_file
    payload = F.coalesce(F.octet_length("html"), F.lit(0))
    # header lines, gzip's frame and a percent-encoded target on top of the payload
    size = payload.cast("long") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    largest = pages.agg(F.max(F.when(payload <= share, size)), F.max(F.when(payload > share, size))).first()
    mode = "errorifexists"
    for some, most in zip((payload <= share, payload > share), largest, strict=True):
        if most or not any(largest):  # of an empty table, empty archives
            _write(pages.filter(some), path, max(1, min(records_per_file, max_bytes // (most or 1))), mode)
            mode = "append"


def _write(pages: DataFrame, path: str, records_per_file: int, mode: str) -> None:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b.column("html")),
                       b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), b.column("revisit").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r)) for r in rows], pa.binary())], names=["value"])

    members = bounded_batches(deduplicated(pages)).mapInArrow(run, "value binary")
    # a cast from binary to string keeps the bytes as they are, and the text sink writes them unchanged
    (members.select(F.col("value").cast("string").alias("value")).write.mode(mode).option("lineSep", "\u0000")
     .option("maxRecordsPerFile", records_per_file).text(path))


class Damage(Exception):
    """A check failed; the message names it."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Damage."""
    head_end = data.find(b"\r\n\r\n", at)
    if data[at:at + 5] != b"WARC/" or head_end < 0:
        raise Damage("version line" if data[at:at + 5] != b"WARC/" else "header end")
    version, *lines = data[at:head_end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        raise Damage("version line")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or re.search(rb"[\x00-\x08\x0a-\x1f\x7f]", line):
            raise Damage("header field")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")) or "warc-record-id" not in fields or fields.get("warc-type") not in TYPES:
        raise Damage("header field")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damage("record end")
    block = data[start:end]
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damage("payload digest")
    return {"fields": fields, "block": block}, end + 4


def inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` inflates to, where it ends, and the reason if it is damaged."""
    z = zlib.decompressobj(31)
    # through a view in steps, so that a broken member does not copy or inflate the rest of the archive
    out, view, pos = [], memoryview(data), at
    while not z.eof and pos < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[pos:pos + (1 << 16)]))
        except zlib.error as e:
            try:  # once more byte by byte, for what comes before the damage
                for k in range(pos, min(pos + (1 << 16), len(data))):
                    out.append(before.decompress(view[k:k + 1]))
            except zlib.error:
                pass
            return b"".join(out), at, "member checksum" if "check" in str(e) else "member data"
        pos += 1 << 16
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), "" if z.eof else "member cut short"


def records_in(inner: bytes, verified: bool) -> tuple[list[dict], str]:
    """The records of an inflated member, and why bytes between them were left out, if any were.

    ``verified``: only records whose payload digest was compared, as the member's checksum does not vouch for them.
    """
    found, reason, at = [], "", 0
    while at < len(inner):
        try:
            one, at = parse_record(inner, at)
        except Damage as e:
            reason = reason or str(e)
            following = _VERSION.search(inner, at + 1)
            if not following:
                break
            at = following.start()
            continue
        if not verified or one["fields"]["warc-type"] == "response" and one["fields"].get("warc-payload-digest", "").startswith("sha256:"):
            found.append(one)
    return found, reason


def read_at(data: bytes, at: int) -> tuple[list[dict], int, str]:
    """The records at ``at``, where they end and why a part of them was left out; raises Damage if none reads.

    Of a damaged member the end is not known: it is given as ``at``.
    """
    if data[at:at + 3] != b"\x1f\x8b\x08":
        found, end = parse_record(data, at)
        return [found], end, ""
    inner, end, damage = inflated(data, at)
    found, reason = records_in(inner, verified=bool(damage))
    if not found:
        raise Damage(damage or reason or "version line")
    return found, at if damage else end, damage or reason


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """``("record", start, end, record)`` and ``("gap", start, end, reason)`` in order, covering the archive.

    Zero bytes between members and line ends between bare records are padding.
    Records of one member have the member's place.  A member of which a part
    was left out is also logged as a gap, and of a damaged one the place ends
    where the next record or member reads correctly.
    """
    at = 0
    while at < len(data):
        if data[at] == 0 or data[at:at + 2] == b"\r\n":
            at += 1 if data[at] == 0 else 2
            continue
        start, some, reason = at, [], ""
        try:
            some, at, reason = read_at(data, start)
        except Damage as e:
            reason = str(e)
        if at == start:
            at = _next_whole(data, start + 1)
        for found in some:
            yield "record", start, at, found
        if reason:
            yield "gap", start, at, reason


def _next_whole(data: bytes, at: int) -> int:
    """The next place from ``at`` where a record reads, or the end."""
    for m in _START.finditer(data, at):
        try:
            read_at(data, m.start())
        except Damage:
            continue
        return m.start()
    return len(data)


_READ = ("path string, kind string, start bigint, end bigint, reason string, record_id string, record_type string, target string, "
         "payload_digest string, payload_bytes bigint, refers_to string, block binary")


def _row(path: str, kind: str, start: int, end: int, x: object) -> tuple:
    if kind == "gap":
        return (path, kind, start, end, x, None, None, None, None, None, None, None)
    f = x["fields"]
    name = lambda key: f[key].strip("<>").removeprefix(_ID) if key in f else None
    full = f["warc-type"] == "response"
    return (path, kind, start, end, None, name("warc-record-id"), f["warc-type"], f.get("warc-target-uri"),
            hashlib.sha256(x["block"]).hexdigest() if full else f.get("warc-payload-digest", "").removeprefix("sha256:"),
            len(x["block"]) if full else int(f.get("x-payload-length") or 0), name("warc-refers-to"), x["block"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined gaps (``kind = 'gap'``) of all archives below ``path``."""
    return salvaged(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def salvaged(archives: DataFrame) -> DataFrame:
    """The same from a frame of ``path`` and ``content``; several tasks read archives, one archive is read by one."""
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t])
                        for n, t in (f.split() for f in _READ.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for found in salvage(content.as_py() or b""):
                    rows.append(_row(path.as_py(), *found))
                    if len(rows) == 100:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("path", "content").mapInArrow(run, _READ)
