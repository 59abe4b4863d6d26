"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import language, pieces, toxicity
from flowloom.llm.chat import repair
from flowloom.llm.common import fold, table
from flowloom.llm.decontaminate import contamination
from flowloom.llm.exact_dedup import exact_duplicates
from flowloom.llm.html_text import page_texts
from flowloom.llm.near_dedup import near_duplicates
from flowloom.llm.packing import pack
from flowloom.llm.passages import passages
from flowloom.llm.quality import quality_scores
from flowloom.llm.structure import damaged, repair_structure
from flowloom.llm.whitening import whitened

THRESHOLD = 0.3


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text of all pages."""
    return page_texts(table(spark, folder, "pages"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    scores = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scores.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates of all documents by normalised text."""
    found = exact_duplicates(table(spark, folder, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model).withColumn("held_out", held_out)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Packed pieces with a checksum in place of their ids."""
    return pack(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed_pieces(table(spark, folder, "documents"))


def op6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that repeat across documents."""
    return passages(table(spark, folder, "documents"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations with legal roles, rendered."""
    return repair(table(spark, folder, "conversations"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark phrases in all documents."""
    found = contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, folder, "documents")
    labels = toxicity.toxic_labels(table(spark, folder, "labels"))
    scores = toxicity.toxic_scores(docs, toxicity.fit(docs, labels))
    return scores.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of all documents, and what they decode to."""
    coded = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened embeddings, up to 16 components a row."""
    rows = whitened(table(spark, folder, "embeddings"))
    # A deviation beyond 64 bits is null.
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Repaired structure of all conversations after planted damage."""
    turns = table(spark, folder, "conversations")
    found, _ = repair_structure(damaged(turns))
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_passages": op6_passages,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_pieces": op11_pieces,
    "op12_whitening": op12_whitening,
    "op13_structure": op13_structure,
}

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _edited(state: str, letter: str, cost: str) -> str:
    """SQL of a repair state ``{c, a}`` after one more edit; null where there is none."""
    return f"""CASE WHEN {state} IS NOT NULL
      THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"""


def _kept(states: list[str], role: str) -> str:
    """SQL of keeping a row, or of giving it a role."""
    ways = []
    for state in states:
        ways.append(f"CASE WHEN NOT gone AND r = '{role}' THEN {_edited(state, 'K', 'extra')} END")
        if role != "s":
            ways.append(f"CASE WHEN NOT gone THEN {_edited(state, 'R', '1 + extra')} END")
    return ", ".join(ways)


_STRUCTURE = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
sums AS (
  SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda z, n:
      xor(z >> 1, CASE WHEN z % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
    4294967295::BIGINT), 4294967295::BIGINT) % 20 AS damage FROM raw),
rows_left AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM sums WHERE damage <> 0),
lined AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
  FROM rows_left),
judged AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM lined),
kinds AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS n
  FROM kinds GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS e,
    NULL::STRUCT(c BIGINT, a VARCHAR) AS s, {{'c': 5::BIGINT, 'a': 'I'}} AS u,
    {{'c': 10::BIGINT, 'a': 'II'}} AS a
  FROM counts
  UNION ALL
  SELECT conv_id, i, e, s, u, least(a, {_edited("u", "I", "5")}) AS a
  FROM (
    SELECT conv_id, i, e, s, a, least(u, {_edited("e", "I", "5")}, {_edited("s", "I", "5")},
      {_edited("a", "I", "5")}) AS u
    FROM (
      SELECT p.conv_id, k.i, {_edited("e", "D", "2")} AS e,
        least({_edited("s", "D", "2")}, {_kept(["e"], "s")}) AS s,
        least({_edited("u", "D", "2")}, {_kept(["e", "s", "a"], "u")}) AS u,
        least({_edited("a", "D", "2")}, {_kept(["u"], "a")}) AS a
      FROM steps p JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.i = p.i + 1))),
chosen AS (
  SELECT s.conv_id, least(s.e, s.a).c AS cost, least(s.e, s.a).a AS audit
  FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i),
edits AS (
  SELECT conv_id, audit, p, audit[p] AS edit,
    len(replace(audit[:p], 'I', '')) + CASE WHEN audit[p] = 'I' THEN 1 ELSE 0 END AS i,
    len(replace(audit[:p], 'D', '')) - len(replace(audit, 'D', '')) % 2 AS place
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS p FROM chosen)),
lines AS (
  SELECT e.conv_id, p,
    CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM edits e LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.i = e.i
  WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""

SQL = {
    "op3_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents),
hashed AS (SELECT doc_id, sha256(plain) AS text_sha256 FROM plain)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS ws
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS ws
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")},
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * shared >= 75 * (m.n + n.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)""",
    "op13_structure": _STRUCTURE,
}
