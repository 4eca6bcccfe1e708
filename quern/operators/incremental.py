"""Incremental corpora: what changed by content hash, children with their fallback, and replacement by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import chunkers


def changed_sources(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """slug, file_hash, is_new: sources (slug, file_hash) whose hash the manifest doesn't hold."""
    m = manifest.select(F.col("slug").alias("m_slug"), F.col("file_hash").alias("m_hash"))
    return now.join(m, F.col("slug") == F.col("m_slug"), "left").select("slug", "file_hash", (~F.col("m_hash").eqNullSafe(F.col("file_hash"))).alias("is_new"))


def orphans(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """slug, in_corpus for each slug of the manifest."""
    c = corpus.select(F.col("slug").alias("c_slug")).distinct()
    return manifest.select("slug").join(c, F.col("slug") == F.col("c_slug"), "left").select("slug", F.col("c_slug").isNotNull().alias("in_corpus"))


def latest(rows: DataFrame, *key: str, order: str = "ord") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new holds, and new: a source that changed replaces all its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def children(parents: DataFrame, views: DataFrame) -> DataFrame:
    """child_id, slug, parent_id, section_title, text. parents: slug, chunk_id, section_title, document_text; views:
    slug, text with dividers. A source's passages come from its view by blank lines; a source whose view gives none has
    its parents' first 8000 characters packed by sentences. Rows without id are left out."""
    own = parents.filter(F.coalesce("chunk_id", F.lit("")) != "")
    titles = own.select(F.col("slug").alias("p_slug"), F.col("chunk_id").alias("p_id"), F.col("section_title").alias("p_title"))
    cut = chunkers.paragraphs(chunkers.divider_sections(views), "slug", "parent_id", "section_title")
    md = cut.join(titles, (F.col("slug") == F.col("p_slug")) & (F.col("parent_id") == F.col("p_id")), "left").select(
        F.concat_ws("__", "slug", "parent_id", F.concat(F.lit("p"), "ord")).alias("child_id"), "slug", "parent_id", F.coalesce("section_title", "p_title", F.lit("")).alias("section_title"), "text"
    )
    rest = own.join(md.select("slug").distinct(), "slug", "left_anti").withColumn("text", F.left("document_text", F.lit(8000)))
    packed = chunkers.sentence_children(rest, "slug", "chunk_id", "section_title").select(
        F.concat_ws("__", "slug", "chunk_id", F.concat(F.lit("c"), "ord")).alias("child_id"), "slug", F.col("chunk_id").alias("parent_id"), F.coalesce("section_title", F.lit("")).alias("section_title"), "text"
    )
    return md.unionByName(packed)
