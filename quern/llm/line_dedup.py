"""Line dedup: lines that many documents share go, but for one copy.

Native: split, hash, two-level distinct count, join by hash, reassembly by position; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import OTHERS, SPACE, Scratch, lower_ascii, pack, table, unpack

#: Parts in which the rows of one shared line are joined.
SALTS = 32


def split_lines(text: Column) -> Column:
    """Lines of a text, split at \\n; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What makes two lines equal: stripped of SPACE at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, scratch: Scratch, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key has at least `min_chars` code points and stands in at least `min_docs` distinct
    documents, except in the largest doc_id that holds it.

    In: doc_id, text and any other columns. Out: the same rows and columns with the text that is left, plus
    `ld_lines` (lines before) and `ld_dropped`. Lines that stay keep their order and are joined by \\n.

    Null or empty text: one empty line, never dropped (a shorter key than min_chars). Null doc_id: the row counts
    for no key and keeps all lines. Repeated rows of one doc_id count as one document and each is treated alike.
    All lines dropped: the empty text. Empty table: empty result. Columns
    named ld_lines or ld_dropped are replaced; other names are free.

    Plan: one scan makes (two 64-bit hashes, doc_id, position) of each long line, written once; the distinct count
    first meets by (hash, doc_id), so that a line of a third of all documents is spread, and then sums partial counts
    by hash. A shared line's rows meet its keeper in SALTS parts. Only positions to drop return to the documents, by doc_id and text hash.
    """
    lines = split_lines(F.col("text"))
    key = lambda x: line_key(x)
    src = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("ld_id"), F.col("text").alias("ld_text"))
    occ = scratch.write(
        src.select("ld_id", F.xxhash64("ld_text").alias("ld_th"), F.posexplode(F.transform(split_lines(F.col("ld_text")), key)).alias("ld_pos", "ld_key"))
        .filter(F.length("ld_key") >= min_chars)
        .select("ld_id", "ld_th", "ld_pos", F.xxhash64("ld_key").alias("ld_h1"), F.xxhash64(F.lit(1), "ld_key").alias("ld_h2"))
    )
    common = (
        occ.groupBy("ld_h1", "ld_h2").agg(F.count_distinct("ld_id").alias("ld_n"), F.max("ld_id").alias("ld_keeper")).filter(F.col("ld_n") >= min_docs).drop("ld_n")
    ).withColumn("ld_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = (
        occ.withColumn("ld_salt", F.pmod(F.xxhash64("ld_id"), F.lit(SALTS)).cast("int"))
        .join(common, ["ld_h1", "ld_h2", "ld_salt"])
        .filter(F.col("ld_id") != F.col("ld_keeper"))
        .groupBy("ld_id", "ld_th")
        .agg(F.array_sort(F.collect_set("ld_pos")).alias("ld_drop"))
    )
    joined = pack(docs, "doc_id", "text").join(drops, (F.col("doc_id") == F.col("ld_id")) & (F.xxhash64("text") == F.col("ld_th")), "left")
    n = F.size(lines)
    # The kept lines are the slices between dropped positions: work in proportion to the lines.
    edges = F.concat(F.array(F.lit(-1)), F.col("ld_drop"), F.array(n))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ld_drop")), lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1)))
    text = F.when(F.col("ld_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.select("doc_id", F.col(OTHERS), text.alias("text"), n.cast("long").alias("n"), F.coalesce(F.size("ld_drop"), F.lit(0)).cast("long").alias("d"))
    return unpack(out, docs.columns, "doc_id", "text", ld_lines=F.col("n"), ld_dropped=F.col("d"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, Scratch(spark)).select(
        "doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (
  SELECT l.doc_id, l.line, l.pos, common.key IS NOT NULL AND l.doc_id <> common.keeper AS gone
  FROM l LEFT JOIN common ON l.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
