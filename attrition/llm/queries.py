"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import TokenizerFiles, aligned
from .binary_packing import binary_pieces
from .byte_bpe import ByteFiles
from .common import scratch_path, table
from .conversation_repair import damaged, repair_report
from .embedding_join import near_duplicates
from .exact_topk import top_k
from .mixing import mixed
from .ngram_join import similarity_join
from .quality_rules import quality_rules
from .secret_scan import joined, secret_spans, spans_of
from .sharding import uniform_shards
from .token_counts import token_counts
from .token_output import write_packed
from .warc import read_archives, write_archives

c = F.col
BYTE_FILES = ByteFiles(json=public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       pattern=public_tokenizers.PATTERN)
ALIGNED_FILES = TokenizerFiles(byte=BYTE_FILES, pieces=public_tokenizers.path("piece_bpe_32k.model"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rows are exchanged; size and checksum are taken of the text as it arrives in its shard."""
    moved = uniform_shards(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce(c("text"), F.lit("")).cast("binary")
    return moved.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per matrix row, from the written files: its documents, borders and checksums of ids and positions."""
    files = write_packed(table(spark, sf_dir, "documents"), scratch_path(spark, "packed"), end_id=50256, byte_files=BYTE_FILES)
    return files.select("row_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.crc32("ids").alias("ids_crc32"),
                        F.crc32("position_ids").alias("positions_crc32"))


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binary_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), units="words")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(spans_of((k,))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined().alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), archives)
    return (read_archives(spark, archives).filter("kind = 'record'")
            .select(F.nullif(c("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.nullif(c("refers_to"), F.lit("")).cast("long").alias("refers_to")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), ALIGNED_FILES)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_output": op5_token_output,
    "op6_binary_packing": op6_binary_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_exact_topk": op9_exact_topk,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_alignment": op12_alignment,
    "op13_embedding_dedup": op13_embedding_dedup,
}

# Measures, rules, priors and verdicts again from the definitions, on the bare documents.
OP1_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS step(k) WHERE times > 1 GROUP BY rid
), measured AS (
  SELECT rid, doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)
), flagged AS (
  SELECT source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > n_words]) AS failed,
         unnest([1, 2, 3, 4]) AS rule FROM measured
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, (count(*) FILTER (failed))::DOUBLE AS k FROM flagged GROUP BY ALL
), moments AS (
  SELECT rule, sum(n) AS nn, sum(k) / sum(n) AS m, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room,
         sum(k * k / n) - sum(k) * sum(k) / sum(n) - (count(*) - 1) * (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS spread
  FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, m, least(1000.0, CASE WHEN room > 0 AND spread > 0 THEN m * (1 - m) * room / spread ELSE 1000.0 END) AS strength FROM moments
), rejected AS (
  SELECT DISTINCT source FROM hosts JOIN priors USING (rule) WHERE (k + m * strength + 0.5) / (n + strength + 1) > 0.8
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, r.source IS NOT NULL OR
             (m.source IS NULL AND EXISTS (SELECT 1 FROM rejected WHERE source IS NULL)) AS host_rejected
      FROM measured m LEFT JOIN rejected r ON m.source = r.source)
"""

# What the archives must give back: every page once; of equal long payloads one response, the smallest page, and revisits of it.
OP8_SQL = """
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN refers THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN refers THEN first END AS refers_to
FROM (SELECT *, strlen(html) >= 100 AND place > 1 AS refers
      FROM (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
                   row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place FROM pages))
"""

# All pairs that share a shingle, and the classes by following links.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sized AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles
), linked AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) = any_value(a.n) AND count(*) = any_value(b.n) AS same
  FROM sized a JOIN sized b ON a.s = b.s GROUP BY 1, 2 HAVING 10 * count(*) >= 8 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reach r JOIN linked l ON r.y = l.x
)
SELECT d.doc_id, coalesce(c.id, d.doc_id) AS class_id, coalesce(k.id, d.doc_id) AS copy_id, coalesce(k.n, 0) AS n_links,
       d.doc_id = coalesce(c.id, d.doc_id) AS class_first
FROM documents d
LEFT JOIN (SELECT x, min(y) AS id FROM reach GROUP BY x) c ON c.x = d.doc_id
LEFT JOIN (SELECT x, min(y) FILTER (same) AS id, count(*) - 1 AS n FROM linked GROUP BY x) k ON k.x = d.doc_id
"""

# Every product of a query with every other vector, ranked.
OP9_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
         row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS place
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""



def _repair_sql() -> str:
    """Damage and faults again, and the cheapest edits by a table over (turn, last role): for each the least (cost, letters),
    with the lines that they give."""
    def step(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def when(condition: str, option: str) -> str:
        return f"CASE WHEN {condition} THEN {option} ELSE {far} END"

    far = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    extra, line = "CASE WHEN truncated THEN 3 ELSE 0 END", "role || ':' || text"
    new = {s: step(s, f"3 + {extra}", "R", f"'{'assistant' if s == 'u' else 'user'}:' || text") for s in "esua"}
    kept = {s: step(s, extra, "K", line) for s in "esua"}
    gone = {s: step(s, "4", "D") for s in "esua"}
    put = {s: step(s, "3", "I", f"'{'assistant' if s == 'u' else 'user'}:'") for s in "esua"}
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), checked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
    4294967295) % 20 AS kind FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM checked WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM hurt
), faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM ordered
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
), moves AS (
  SELECT conv_id, i, role, text, left(role, 1) AS x, fault IN ('blank', 'duplicate') AS must, fault = 'truncated' AS truncated FROM faults
), done(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {far}, {{'c': 3, 'a': 'I', 't': ['user:']}},
         {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} FROM conversations
  UNION ALL
  SELECT conv_id, i, e, s, u, {least('a', put['u'])} FROM (
    SELECT conv_id, i, e, s, {least('u', put['e'], put['s'], put['a'])} AS u, a FROM (
      SELECT conv_id, i, e, s, u, {least('a', put['u'])} AS a FROM (
        SELECT conv_id, i, e, s, {least('u', put['e'], put['s'], put['a'])} AS u, a FROM (
          SELECT d.conv_id, m.i, {gone['e']} AS e, {least(gone['s'], when("NOT must AND x = 's'", kept['e']))} AS s,
                 {least(gone['u'], *[when('NOT must', new[z]) for z in 'esa'], *[when("NOT must AND x = 'u'", kept[z]) for z in 'esa'])} AS u,
                 {least(gone['a'], when('NOT must', new['u']), when("NOT must AND x = 'a'", kept['u']))} AS a
          FROM done d JOIN moves m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1))))
), best AS (
  SELECT d.conv_id, {least('e', 'a')} AS b, f.* EXCLUDE (conv_id) FROM done d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
  WHERE d.i = coalesce(f.n, 0)
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
FROM best
"""


OP11_SQL = _repair_sql()

# All pairs of a label, and the components by following links.
OP13_SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), sound AS (
  SELECT r, label, e FROM vectors
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT x, y FROM linked UNION SELECT p.x, l.y FROM reach p JOIN linked l ON p.y = l.x
), named AS (
  SELECT x, min(vec_id) AS id FROM (SELECT x, y FROM reach UNION SELECT r, r FROM vectors) JOIN vectors ON r = y GROUP BY x
), counted AS (
  SELECT x, count(*) AS n FROM linked GROUP BY x
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, d.id AS component_id, v.vec_id IS NOT DISTINCT FROM d.id AS kept
FROM vectors v JOIN named d ON d.x = v.r LEFT JOIN counted c ON c.x = v.r
"""

SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op4_ngram_join": OP4_SQL, "op8_warc": OP8_SQL, "op9_exact_topk": OP9_SQL,
                       "op11_conversation_repair": OP11_SQL, "op13_embedding_dedup": OP13_SQL}
