"""Nested documents of unknown shape: VARIANT values taken apart level by level, to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null, and other for what JSON has no word for."""
    s = F.schema_of_variant(v)
    out = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
    return out.when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), "number").otherwise("other")


def step(key: Column, pos: Column) -> Column:
    """How a path goes on: `.key`, quoted if it isn't a plain word, or `[pos]`."""
    named = F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    return F.when(key.isNotNull(), F.concat(F.lit("."), named)).otherwise(F.concat(F.lit("["), pos.cast("string"), F.lit("]")))


def flattened(rows: DataFrame, document: str, scratch: Scratch) -> DataFrame:
    """The other columns of rows, and path, type, value for each value of the JSON in `document`, containers too (their value
    is null). The root's path is `$`. Null and broken documents give no row; empty containers give one; repeated rows are
    repeated.

    A level is exploded from the containers of the one before, so a document of many members is many rows from then on; every
    level is written, and the loop ends with the depth of the data."""
    keys = [c for c in rows.columns if c != document]
    level = rows.select(*keys, F.lit("$").alias("path"), F.try_parse_json(document).alias("v")).filter("v IS NOT NULL")
    levels = []
    while True:
        done = scratch.write(level.withColumn("type", kind(F.col("v"))))
        levels.append(done)
        inner = done.filter(F.col("type").isin("object", "array"))
        if inner.isEmpty():
            break
        own = ", ".join(f"l.`{c}`" for c in keys)
        made = rows.sparkSession.sql(f"SELECT {own}, l.path, t.pos, t.key AS __key, t.value AS v FROM {{l}} AS l, LATERAL variant_explode(l.v) AS t", l=inner)
        level = made.select(*keys, F.concat("path", step(F.col("__key"), F.col("pos"))).alias("path"), "v")
    leaf = F.when(~F.col("type").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
    out = None
    for done in levels:
        part = done.select(*keys, "path", "type", leaf.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
