"""Checks of generated code: forbidden constructs, unused signals, open blocks, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: A declaration of one net.
DECLARATION = r"^\s*(?:logic|wire|reg)(?:\s+(?:signed|unsigned))?(?:\s*\[[^\]]*\])?\s+(\w+)\s*;"


def violations(modules: DataFrame) -> DataFrame:
    """module, rule of (module, code): each forbidden construct that occurs, in any case. The rules are a literal array,
    so the scan is one pass without a join."""
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(f"(?i){p}").alias("pattern")) for n, p in T.FORBIDDEN])
    return modules.select("module", "code", F.explode(rules).alias("r")).filter(F.expr("code RLIKE r.pattern")).select("module", F.col("r.rule").alias("rule"))


def violation_lists(modules: DataFrame) -> DataFrame:
    """module, n, rules: one row a module, clean ones too."""
    v = violations(modules).groupBy("module").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return modules.select("module").join(v, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rules", F.lit("")).alias("rules"))


def unused_signals(modules: DataFrame) -> DataFrame:
    """module, signal: declared nets whose name stands in no line but that of the declaration, comments left out. The
    words of a module meet its declarations by name."""
    lines = modules.select("module", F.posexplode(F.split("code", "\n")).alias("i", "line"))
    decl = lines.select("module", "i", F.regexp_extract("line", DECLARATION, 1).alias("signal")).filter("signal <> ''").groupBy("module", "signal").agg(F.max("i").alias("decl"))
    words = lines.select("module", "i", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("line", "//.*", ""), F.lit(r"\w+"), F.lit(0)))).alias("signal"))
    seen = words.join(decl, ["module", "signal"]).groupBy("module", "signal").agg(F.max("decl").alias("decl"), F.count("*").alias("n"), F.min("i").alias("at"))
    return seen.filter("n = 1 AND at = decl").select("module", "signal")


def block_report(modules: DataFrame) -> DataFrame:
    """module, open_blocks, complete."""
    return modules.select("module", T.open_blocks(F.col("code")).alias("open_blocks"), T.is_complete_module(F.col("code")).alias("complete"))
