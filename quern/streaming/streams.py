"""Streams: verdict lines with a running score, incremental ingest by content hash, usage by second and its peaks in sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import incremental
from quern.sources.scratch import Scratch


def verdict_lines(spark: SparkSession, folder: str) -> DataFrame:
    """line of each text file that arrives in a folder."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"))


def running_score(lines: DataFrame) -> DataFrame:
    """status, tests so far; for complete mode."""
    return lines.select(T.verdict(T.strip(F.col("line")))["status"].alias("status")).filter("status IS NOT NULL").groupBy("status").agg(F.count("*").alias("tests"))


def seconds_of(log: DataFrame) -> DataFrame:
    """key, second (since 1970), requests, tokens of (key, ts, tokens) or of such sums. Sums of parts of a log add up, so a
    stream needs no state for them. Rows without ts are left out."""
    rows = log if "second" in log.columns else log.filter("ts IS NOT NULL").select("key", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("second"), F.lit(1).cast("long").alias("requests"), "tokens")
    return rows.groupBy("key", "second").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


def usage_peaks(seconds: DataFrame, span: int = 60) -> DataFrame:
    """key, windows, most_requests, most_tokens of seconds_of(): the busy windows of `span` seconds that begin at every
    second, and the most requests and tokens of one. No window is made: sums change only where a second with requests
    comes in, as a window's last one, or has gone, just before its first one. A key's seconds are dealt by slots of ten
    spans, with those within a span of a slot copied in, so that no busy key is one task."""
    width = 10 * span
    slot = lambda d: F.floor((F.col("second") + d) / width)
    dealt = seconds.withColumn("slot", F.explode(F.array_distinct(F.array(slot(0), slot(-span), slot(span)))))
    by = Window.partitionBy("key", "slot").orderBy("second")
    ends, follows = by.rangeBetween(1 - span, 0), by.rangeBetween(1, span)
    new = F.least(F.lit(span), F.coalesce(F.col("second") - F.lag("second").over(by), F.lit(span)))
    most = lambda c: F.greatest(F.sum(c).over(ends), F.sum(c).over(follows))
    own = dealt.withColumns({"windows": new, "most_requests": most("requests"), "most_tokens": most("tokens")}).filter(F.col("slot") == slot(0))
    return own.groupBy("key").agg(F.sum("windows").alias("windows"), F.max("most_requests").alias("most_requests"), F.max("most_tokens").alias("most_tokens"))


def ingest(sources: DataFrame, manifest_of: Callable[[], DataFrame], apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's new or changed sources (slug, file_hash, others) to `apply`, which replaces their rows and then
    records their hashes; a batch that is run again finds them recorded and does nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("slug").agg(F.max_by("file_hash", "seq").alias("file_hash"))
        new = incremental.changed_sources(last, manifest_of()).filter("is_new").select("slug", "file_hash")
        apply(rows.join(new, ["slug", "file_hash"], "left_semi"))

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, scratch: Scratch, mode: str = "complete", of_batch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The stream's result once all that is there has been read, as a table in the shared folder. In complete mode a batch
    holds all of the result and replaces the one before; in append mode batches add up. `of_batch`: what is written of a
    batch."""
    path, spark, last = scratch.path(), stream.sparkSession, [None]

    def batch(rows: DataFrame, number: int) -> None:
        last[0] = f"{path}/{number}"
        of_batch(rows).write.mode("overwrite").parquet(last[0])

    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", scratch.path()).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = of_batch(spark.createDataFrame([], stream.schema)).schema
    if last[0] is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(last[0] if mode == "complete" else f"{path}/*")
