"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import OTHERS, pack, table, unpack, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is it that for on with as at by from this be are was a an or not
le la les de des du et en un une est que qui dans pour par sur au avec
der die das und ist von zu mit den dem ein eine nicht im auf für sich
el los las del y que es por con para una se lo como más su al
""".split()


@dataclass(frozen=True)
class Rule:
    """A document fails if `value` is under `low` or over `high`, once it has at least `min_words` words.
    `value` is SQL over the measures named in MEASURES."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Word counts and repeats are the base; the rest is the method's own verdict, set to spare plain prose.
BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "100 * n_repeat_words / greatest(n_words, 1)", high=50),
)
METHOD_RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=2.0, high=25.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", high=0.10),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.75, min_words=1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", low=0.01, min_words=50),
    Rule("letters", "n_letters / greatest(word_chars, 1)", low=0.55, min_words=50),
    Rule("capitals", "n_upper / greatest(n_letters, 1)", high=0.60, min_words=50),
)


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Columns of docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
    n_letters, n_upper (long), each behind `prefix`. Null text has no words; a line without a word is no duplicate.

    n_repeat_words: words that stand in a three-word window found at least twice in the text. A window is known by a
    64-bit hash; the windows found twice are the equal neighbours of the sorted hashes.
    """
    p = lambda n: f"{prefix}{n}"
    t = F.coalesce(F.col(text), F.lit(""))
    less = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    w, h = F.col("__q_w"), F.col("__q_h")
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    s = F.sort_array(h)
    twice = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_distinct(F.filter(F.col("__q_s"), lambda x, i: (i > 0) & (x == F.get(F.col("__q_s"), i - 1))))).otherwise(F.array().cast("array<bigint>"))
    few = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(F.col("__q_d"), F.get(h, i)))
    # Many repeated windows: sort (hash, position) instead, so that work stays n log n.
    pairs = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
    many = F.array_sort(
        F.transform(
            F.filter(F.col("__q_p"), lambda x, i: (x["h"] == F.get(F.col("__q_p"), i - 1)["h"]) | (x["h"] == F.get(F.col("__q_p"), i + 1)["h"])),
            lambda x: x["i"],
        )
    )
    at = F.col("__q_at")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(at) - 1),
        F.lit(0),
        lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(at, k + 1), F.lit(2_000_000_000)) - F.get(at, k)),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (
        docs.withColumns({"__q_w": words(F.col(text)), "__q_l": lines})
        .withColumn("__q_h", windows)
        .withColumn("__q_s", F.when(F.size(F.array_distinct(h)) < F.size(h), s))
        .withColumn("__q_d", twice)
        .withColumn("__q_p", F.when(F.size("__q_d") > 64, pairs))
        .withColumn("__q_at", F.when(F.size("__q_d") == 0, F.array().cast("array<int>")).when(F.size("__q_d") > 64, many).otherwise(few))
        .withColumns(
            {
                p("n_words"): F.size(w).cast("long"),
                p("word_chars"): less("[ \\t\\n\\x0B\\f\\r]+"),
                p("n_symbols"): less("[#*$%&|<>]+"),
                p("n_letters"): less("\\p{L}+"),
                p("n_upper"): less("\\p{Lu}+"),
                p("n_lines"): F.size("__q_l").cast("long"),
                p("n_dup_lines"): (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
                p("n_repeat_words"): F.when(F.size(at) == 0, 0).otherwise(covered).cast("long"),
                p("n_stop_words"): F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            }
        )
        .withColumn(p("word_chars"), F.length(t).cast("long") - F.col(p("word_chars")))
        .drop("__q_w", "__q_l", "__q_h", "__q_s", "__q_d", "__q_p", "__q_at")
    )


def fails(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """True if any rule fails: the table as one expression."""
    import re

    out = F.lit(False)
    for r in rules:
        v = F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{prefix}\1`", r.value))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (v < r.low)
        if r.high is not None:
            bad = bad | (v > r.high)
        out = out | (bad & (F.col(f"{prefix}n_words") >= r.min_words))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with the measures (behind `qr_`), qr_base_failed and qr_kept. One projection, no shuffle, no user function.

    Null and empty texts have no words and fail too_short. Rows are judged one by one: repeated rows alike; an empty
    table gives an empty result; other columns pass through, but for those of the names added.
    """
    m = measures(pack(docs, "text"), prefix="qr_")
    names = [c for c in m.columns if c not in ("text", OTHERS)]
    base = fails(base, "qr_")
    judged = F.struct(*names, base.alias("qr_base_failed"), (~(base | fails(rules, "qr_"))).alias("qr_kept"))
    # A generator of one row: a filter on a verdict would else be pushed into the measures, which would be computed over
    # and over.
    out = m.select("text", OTHERS, F.inline(F.array(judged)))
    return unpack(out, docs.columns, "text", **{c: F.col(c) for c in (*names, "qr_base_failed", "qr_kept")})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(F.col(f"qr_{x}").alias(x) for x in names))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - len(regexp_extract_all(t, '[ \t\n\x0B\f\r]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CAST(len(regexp_extract_all(t, '\p{{L}}')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS g FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars / g < 2.0 OR word_chars / g > 25.0 OR n_symbols / g > 0.10
            OR (n_words >= 1 AND n_dup_lines / greatest(n_lines, 1) > 0.75) OR (n_words >= 50 AND n_stop_words / g < 0.01)
            OR (n_words >= 50 AND n_letters / greatest(word_chars, 1) < 0.55)
            OR (n_words >= 50 AND n_upper / greatest(n_letters, 1) > 0.60)) AS kept
FROM b
"""
