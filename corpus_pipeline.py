"""A corpus from raw documents to token ids, in five stages; each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import Scratch, table, with_text
from quern.llm.decontaminate import contamination
from quern.llm.line_dedup import line_dedup
from quern.llm.minmax_dedup import near_duplicates
from quern.llm.quality_rules import quality_rules
from quern.llm.sentencepieces import encode_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules(docs.select("text", F.struct(*docs.columns).alias("__row"))).filter("qr_kept").select("__row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a later one of at least three documents holds."""
    out = line_dedup(docs, Scratch(spark))
    return with_text(out, F.col("text")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five words, similarity of 0.8); each of its texts once, and of
    rows equal in these the one of smallest hash. Rows without id stay, and texts without words once for each id."""
    gone = near_duplicates(docs.select("doc_id", "text"), Scratch(spark)).filter("NOT kept").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(gone.hint("merge"), "doc_id", "left_anti")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*(c for c in docs.columns if c != "text")))
    first = named.select(*docs.columns, F.row_number().over(once).alias("__nth")).filter("__nth = 1")
    return first.select(docs.columns).union(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark, its items without id too, doesn't contaminate. Rows are told by a hash of id and text,
    so that rows without id are judged too."""
    key = F.xxhash64("doc_id", "text")
    judged = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), Scratch(spark), unnamed=True)
    gone = judged.filter("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("minmax_dedup", one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("sentencepieces", to_tokens),
]

#: Segmentation by the best sum of scores isn't expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    scratch.close(docs)
    return docs
