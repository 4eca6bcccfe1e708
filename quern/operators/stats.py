"""Corpus, run and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.sources.scratch import Scratch

#: Lower ends of the token histogram; the last has no upper end.
BINS = (0, 250, 500, 1000, 2000, 4000, 10000)
#: Tokens that a key may use a day, less a margin.
DAILY_BUDGET = 200_000 - 10_000


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """document_type, chunks, tokens (cut to whole numbers by row, then summed); a missing type is unknown."""
    return chunks.groupBy(F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(F.count("*").alias("chunks"), F.sum(T.tokens_by_words(F.coalesce("text", F.lit("")))).alias("tokens"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """slug, chunks, tokens (words summed, then cut), doc_types as "type:count, ..." by type."""
    by = chunks.groupBy("slug", F.coalesce("document_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"), F.sum(T.word_count(F.coalesce("text", F.lit("")))).alias("words"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat(x["t"], F.lit(":"), x["n"])), ", ")
    return by.groupBy("slug").agg(F.sum("n").alias("chunks"), F.floor(F.sum("words") * F.lit(1.3)).cast("long").alias("tokens"), types.alias("doc_types"))


def token_summary(chunks: DataFrame) -> DataFrame:
    n = T.tokens_by_words(F.coalesce("text", F.lit("")))
    return chunks.agg(F.count("*").alias("chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def token_histogram(chunks: DataFrame) -> DataFrame:
    """low, high (null for the last), chunks; empty ranges too. A text is counted once, in a projection of its own."""
    counted = chunks.select(T.tokens_by_words(F.coalesce("text", F.lit(""))).alias("tokens"))
    low = F.lit(BINS[0])
    for b in BINS[1:]:
        low = F.when(F.col("tokens") >= b, F.lit(b)).otherwise(low)
    got = counted.groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    bins = chunks.sparkSession.createDataFrame(list(zip(BINS, [*BINS[1:], None], strict=True)), "low int, high int")
    return bins.join(F.broadcast(got), "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"))


def scoreboard(lines: DataFrame) -> DataFrame:
    """passed, failed, timed_out, unknown, total, perfect of verdict lines; others are no tests."""
    v = T.verdict(T.strip(F.col("line")))
    s = lines.select(v["status"].alias("s")).filter("s IS NOT NULL")
    n = lambda x: F.count_if(F.col("s") == x)
    return s.agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("TIMEOUT").alias("timed_out"), n("UNKNOWN").alias("unknown"), F.count("*").alias("total"), ((F.count("*") == n("PASS")) & (F.count("*") > 0)).alias("perfect"))


def next_version(paths: DataFrame) -> DataFrame:
    return paths.agg((F.coalesce(F.max(T.version_of(F.col("path"))), F.lit(0)) + 1).alias("version"))


def latest_run(paths: DataFrame) -> DataFrame:
    """The last path by its text, not by its number."""
    return paths.agg(F.max("path").alias("path"))


def usage_by_key(log: DataFrame) -> DataFrame:
    """key, prompt_tokens, completion_tokens, total_tokens, remaining of the daily budget."""
    total = F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))
    return log.groupBy("key").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), total.alias("total_tokens"), (F.lit(DAILY_BUDGET) - total).alias("remaining"))


def usable_keys(log: DataFrame, exhausted: DataFrame, needed: int) -> DataFrame:
    """Keys that are not exhausted and can still afford `needed` tokens."""
    return usage_by_key(log).filter(F.col("remaining") >= needed).join(exhausted, "key", "left_anti").select("key", "remaining")


def line_counts(modules: DataFrame) -> DataFrame:
    """module, lines of (module, code): a final line feed ends the last line."""
    code = F.regexp_replace("code", r"\n\z", "")
    return modules.select("module", F.when(F.col("code") == "", 0).otherwise(F.size(F.split(code, "\n"))).alias("lines"))


def checklist(texts: DataFrame, checks: DataFrame) -> DataFrame:
    """name, passed for (name, file, needle) against (file, text); a file that is missing fails."""
    return checks.join(texts, "file", "left").groupBy("name").agg(F.every(F.coalesce(F.contains("text", "needle"), F.lit(False))).alias("passed"))


def all_pass(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("all_passed"), F.count_if(~F.col("passed")).alias("failed"))


def rate_window(log: DataFrame, seconds: int = 60) -> DataFrame:
    """log (key, ts, tokens, id) with requests and tokens of its key in the last minute; an entry of exactly a minute ago
    is out. An entry also stands in the next minute's rows, so that a task holds two minutes of a key, however busy."""
    span, at = seconds * 1_000_000, F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(at / span)
    both = log.withColumn("__at", at).withColumn("__slot", F.explode(F.array(slot, slot + 1)))
    w = Window.partitionBy("key", "__slot").orderBy("__at").rangeBetween(-(span - 1), Window.currentRow)
    out = both.withColumns({"requests_60s": F.count("*").over(w), "tokens_60s": F.sum("tokens").over(w)})
    return out.filter(F.col("__slot") == F.floor(F.col("__at") / span)).drop("__at", "__slot")


def runs_of(trace: DataFrame, part: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """start, value, repeats (beyond the first) of (seq, value), seq distinct in a part: consecutive equal values as one row.

    The rows are dealt by ranges of (part, seq), so that one long trace or one busy part is many tasks. Runs are found in
    each range and written; then those that go on over a border are joined to the run they began in, by a table of the
    borders alone."""
    scratch, key = scratch or Scratch(trace.sparkSession), F.col(part) if part else F.lit(0)
    n = max(2, int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = trace.select(key.alias("__part"), "seq", "value").repartitionByRange(n, "__part", "seq").withColumn("__range", F.spark_partition_id())
    by = Window.partitionBy("__part", "__range").orderBy("seq")
    new = F.when(F.row_number().over(by) == 1, 1).otherwise((~F.col("value").eqNullSafe(F.lag("value").over(by))).cast("int"))
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = scratch.write(rows.groupBy("__part", "__range", "__run").agg(F.min("seq").alias("start"), F.first("value").alias("value"), F.count("*").alias("n")))
    edge = runs.groupBy("__part", "__range").agg(F.max("__run").alias("last"), F.min_by(F.struct("value"), "__run").alias("head"), F.max_by(F.struct("value"), "__run").alias("tail"))
    order = Window.partitionBy("__part").orderBy("__range")
    edge = edge.withColumn("goes_on", F.col("head")["value"].eqNullSafe(F.lag("tail").over(order)["value"]) & F.lag("tail").over(order).isNotNull())
    opens = F.when((F.col("last") > 1) | ~F.col("goes_on"), F.struct("__range", "last"))  # its last run began in this range
    edge = edge.withColumn("owner", F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("goes_on").select("__part", "__range", "owner")
    moved = runs.join(edge, ["__part", "__range"], "left")
    first = (F.col("__run") == 1) & F.col("owner").isNotNull()
    moved = moved.select("__part", F.when(first, F.col("owner.__range")).otherwise(F.col("__range")).alias("__range"), F.when(first, F.col("owner.last")).otherwise(F.col("__run")).alias("__run"), "start", "value", "n")
    out = moved.groupBy("__part", "__range", "__run").agg(F.min("start").alias("start"), F.first("value").alias("value"), (F.sum("n") - 1).alias("repeats"))
    return out.select(*([F.col("__part").alias(part)] if part else []), "start", "value", "repeats")


def last_lines(lines: DataFrame, n: int = 30) -> DataFrame:
    """The last n of (seq, line), by a partial top-n in each partition."""
    return lines.orderBy(F.desc("seq")).limit(n)


def module_levels(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """module, level of a graph (src, dst: src depends on dst): 0 without dependencies, else one more than the deepest.
    What no leaf is reached from is left out; a cycle above a leaf is an error.

    Two walks, each of which takes an edge once: up from the leaves, to find the edges that lead to one; then off with the
    modules whose dependencies all have levels, round by round. So the work is that of the edges, however many ways lead to a
    module, and a round's new modules are a table."""
    scratch = scratch or Scratch(edges.sparkSession)
    named = lambda rows, c: rows.select(F.col(c).alias("module")).distinct()
    taken = lambda rows, of, how: scratch.write(rows.join(of.select(F.col("module").alias("dst")), "dst", how))
    rest = scratch.write(edges.select("src", "dst").distinct())
    now = leaves = scratch.write(named(rest.filter("dst IS NOT NULL"), "dst").subtract(named(rest, "src")))
    left = rest.limit(0)
    while not now.isEmpty():
        used, rest = taken(rest, now, "left_semi"), taken(rest, now, "left_anti")
        left, now = left.unionByName(used), scratch.write(named(used, "src"))
    level, now, left, out = 0, leaves, scratch.write(left), leaves.withColumn("level", F.lit(0))
    while not left.isEmpty():
        rest = taken(left, now, "left_anti")
        level, now = level + 1, scratch.write(named(left, "src").subtract(named(rest, "src")))
        if now.isEmpty():
            raise ValueError(f"a cycle among the modules, or above it: {sorted(str(r[0]) for r in named(rest, 'src').limit(5).collect())}")
        out, left = out.unionAll(now.withColumn("level", F.lit(level))), rest
    return out


def listing(rows: DataFrame, *by: str, first: int) -> DataFrame:
    """The first rows in order of `by`: a partial top-n in each partition."""
    return rows.orderBy(*by).limit(first)


def specs_of(selected: DataFrame, specs: DataFrame) -> DataFrame:
    """selected (module, others) with the spec of the first entry of its name in specs (pos, module, spec); null if none."""
    first = specs.groupBy("module").agg(F.min_by("spec", "pos").alias("spec"))
    return selected.join(first, "module", "left")
