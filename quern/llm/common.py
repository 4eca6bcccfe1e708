"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import read_table
from quern.sources.scratch import Scratch, delete, shared_dir

__all__ = ["OTHERS", "SPACE", "Scratch", "delete", "lower_ascii", "pack", "shared_dir", "table", "unpack", "with_text", "words"]

#: Characters that end a word: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text: runs of characters other than SPACE. Null: no words."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with a new text, and n_chars kept in step where there is one."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


OTHERS = "__others"


def pack(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct, so that no name of theirs meets an operator's own."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*names, (F.struct(*others) if others else F.lit(None).cast("struct<x:int>")).alias(OTHERS))


def unpack(df: DataFrame, columns: list[str], *names: str, **added: Column) -> DataFrame:
    """The columns as they were before pack(df, *names), then the added ones, which replace columns of their name."""
    old = [F.col(c) if c in names else F.col(OTHERS).getField(c).alias(c) for c in columns if c not in added]
    return df.select(*old, *(c.alias(n) for n, c in added.items()))
