"""Queries on statistics, windows, graphs, incremental state and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import incremental as I
from quern.operators import stats as A
from quern.operators.nested import flattened
from quern.plans import fixtures as X
from quern.plans import given as G
from quern.plans.text_plans import TOKENS, WORDS, docs
from quern.sources import files
from quern.sources.scratch import Scratch
from quern.streaming import limiter, streams


def chunks(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("source").alias("slug"), F.col("lang").alias("document_type"), "text")


def log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("key"), "ts", F.floor("value").cast("long").alias("tokens"), F.col("event_type"))


def usage(spark, sf_dir):
    return log(spark, sf_dir).select("key", F.col("tokens").alias("prompt_tokens"), (F.col("tokens") % 7).alias("completion_tokens"))


EXHAUSTED = X.Inline("key bigint", [(1,), (5,), (9,)])
OLD = G.Given(X.Inline("slug string, ord int, text string", [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("c", 0, "c0")]), "SELECT source AS slug, CAST(doc_id AS BIGINT) AS ord, text FROM {documents}")
NEW = G.Given(X.Inline("slug string, ord int, text string", [("a", 0, "new a0"), ("d", 0, "d0")]), "SELECT source AS slug, CAST(doc_id AS BIGINT) AS ord, 'new ' || lang AS text FROM {documents} WHERE source LIKE '%1'")


def _folder(scratch, rows, column):
    """A folder of text in the shared directory, as a stream reads it."""
    path = scratch.path()
    rows.select(F.col(column).alias("value")).repartition(3).write.text(path)
    return path


def stream_scoreboard(spark, sf_dir):
    """Verdict lines as a stream, to the same counts as the batch."""
    scratch = Scratch(spark)
    return streams.run_to_end(streams.running_score(streams.verdict_lines(spark, _folder(scratch, G.LINES.df(spark, sf_dir), "line"))), scratch)


def stream_changed_sources(spark, sf_dir):
    """Sources as a stream against a manifest; the result is the manifest afterwards. One batch, so every source is
    recorded once."""
    scratch = Scratch(spark)
    rows = G.NOW.df(spark, sf_dir).withColumn("seq", F.lit(1).cast("long")).select(F.to_json(F.struct("slug", "file_hash", "seq")).alias("value"))
    path, state = _folder(scratch, rows, "value"), {"m": G.MANIFEST.df(spark, sf_dir)}

    def apply(new):
        state["m"] = scratch.write(I.upsert(state["m"], new.select("slug", "file_hash"), "slug"))

    src = spark.readStream.text(path).select(F.from_json("value", "slug string, file_hash string, seq long").alias("r")).select("r.*")
    streams.ingest(src, lambda: state["m"], apply, scratch.path()).awaitTermination()
    return state["m"]


def events(spark, sf_dir):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return files.stream_table(spark, sf_dir, "events", schema)


def stream_usage(spark, sf_dir):
    """Tumbling twin of the sliding usage windows: tokens by type and hour of a stream of event files."""
    w = events(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "60 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("tokens"))
    return streams.run_to_end(w.select(F.col("w.start").alias("start"), "event_type", "n", "tokens"), Scratch(spark))


def stream_usage_windows(spark, sf_dir):
    """Trailing minutes that begin every second, of a stream of event files: for each user the number of busy windows and the
    most requests and tokens of one. Each batch writes its sums by second."""
    log = events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.floor("value").cast("long").alias("tokens"))
    parts = streams.run_to_end(log, Scratch(spark), "append", streams.seconds_of)
    return streams.usage_peaks(streams.seconds_of(parts))


#: Users may take so many tokens and requests in twelve hours; given events are hours apart.
BUDGET = limiter.Budget(tokens=100, requests=3, window=43_200.0, hold=43_201.0)
LATE_MINUTES = 10


def stream_admissions(spark, sf_dir):
    """When each event of a user may go ahead under BUDGET, decided in event order from a stream of event files."""
    asked = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("request"), "ts", F.floor("value").cast("long").alias("tokens"))
    with limiter.with_state_store(spark):
        return streams.run_to_end(limiter.admissions(asked, BUDGET, f"{LATE_MINUTES} minutes"), Scratch(spark), "append")


SPECS = X.Inline("pos int, module string, spec string", [(0, "alu", "adds"), (1, "alu", "later"), (2, "cpu", "wires")])
RUNS = G.Given(X.Inline("artifact string, ord int, line string", [("rtl", 0, "module alu;"), ("rtl", 1, "endmodule"), ("report", 0, "# done")]), "SELECT source AS artifact, CAST(doc_id AS BIGINT) AS ord, md5(text) AS line FROM {documents}")


def run_tables(spark, sf_dir):
    """Two runs written as a runs table and a table for each artifact, and the latest one read back."""
    at = Scratch(spark).path()
    for when, label in (("20240101", "first"), ("20240102", "second")):
        files.write_run_tables(RUNS.df(spark, sf_dir).withColumn("line", F.concat("line", F.lit(f" // {label}"))), at, None, when, label)
    return files.read_latest_run(spark, at)


QUERIES = {
    "chunk_stats": lambda s, d: A.chunk_stats(chunks(s, d)),
    "corpus_stats": lambda s, d: A.corpus_stats(chunks(s, d)),
    "token_summary": lambda s, d: A.token_summary(chunks(s, d)),
    "token_histogram": lambda s, d: A.token_histogram(chunks(s, d)),
    "scoreboard": lambda s, d: A.scoreboard(G.LINES.df(s, d)),
    "next_version": lambda s, d: A.next_version(G.PATHS.df(s, d)),
    "latest_run": lambda s, d: A.latest_run(G.PATHS.df(s, d)),
    "usage_by_key": lambda s, d: A.usage_by_key(usage(s, d)),
    "usable_keys": lambda s, d: A.usable_keys(usage(s, d), EXHAUSTED.df(s), 187_000),
    "rate_window": lambda s, d: A.rate_window(log(s, d)).select("event_id", "requests_60s", "tokens_60s"),
    "trace_runs": lambda s, d: A.runs_of(G.TRACE.df(s, d)),
    "event_runs": lambda s, d: A.runs_of(log(s, d).select("key", F.col("event_id").alias("seq"), F.col("event_type").alias("value")), "key"),
    "last_lines": lambda s, d: A.last_lines(log(s, d).select(F.col("event_id").alias("seq"), F.col("event_type").alias("line"))),
    "module_topo": lambda s, d: A.module_levels(G.EDGES.df(s, d)),
    "changed_sources": lambda s, d: I.changed_sources(G.NOW.df(s, d), G.MANIFEST.df(s, d)),
    "orphans": lambda s, d: I.orphans(G.MANIFEST.df(s, d), G.NOW.df(s, d)),
    "upsert_latest": lambda s, d: I.upsert(OLD.df(s, d), NEW.df(s, d), "slug"),
    "latest_rows": lambda s, d: I.latest(OLD.df(s, d), "slug"),
    "stream_scoreboard": stream_scoreboard,
    "stream_changed_sources": stream_changed_sources,
    "stream_usage": stream_usage,
    "stream_admissions": stream_admissions,
    "nested_values": lambda s, d: flattened(G.DOCUMENTS.df(s, d), "document", Scratch(s)),
    "stream_usage_windows": stream_usage_windows,
    "module_specs": lambda s, d: A.specs_of(G.MODULES.df(s, d).withColumnRenamed("name", "module"), SPECS.df(s)),
    "preview": lambda s, d: A.listing(docs(s, d).select("source", "doc_id", "lang"), "source", "doc_id", first=5),
    "run_tables": run_tables,
    "masked_keys": lambda s, d: G.PATHS.df(s, d).select("path", T.mask_key(F.col("path")).alias("masked")),
}

_t = TOKENS.format(x="text")
_log = "(SELECT event_id, user_id AS key, ts, CAST(floor(value) AS BIGINT) AS tokens, event_type FROM events)"
_use = f"SELECT key, CAST(sum(tokens) AS BIGINT) AS prompt_tokens, CAST(sum(tokens % 7) AS BIGINT) AS completion_tokens, CAST(sum(tokens + tokens % 7) AS BIGINT) AS total_tokens, CAST(190000 - sum(tokens + tokens % 7) AS BIGINT) AS remaining FROM {_log} GROUP BY key"
_runs = """WITH t AS (SELECT {part}seq, value, CASE WHEN row_number() OVER w = 1 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS new FROM {src} WINDOW w AS ({by} ORDER BY seq)),
    r AS (SELECT *, sum(new) OVER ({by} ORDER BY seq) AS run FROM t) SELECT {part}min(seq) AS start, arg_min(value, seq) AS value, count(*) - 1 AS repeats FROM r GROUP BY {part}run"""

SQL = {
    "chunk_stats": f"SELECT coalesce(lang, 'unknown') AS document_type, count(*) AS chunks, CAST(sum({_t}) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "corpus_stats": f"""WITH b AS (SELECT source AS slug, coalesce(lang, 'unknown') AS t, count(*) AS n, sum({WORDS.format(x='text')}) AS words FROM documents GROUP BY 1, 2)
        SELECT slug, CAST(sum(n) AS BIGINT) AS chunks, CAST(floor(sum(words) * 1.3) AS BIGINT) AS tokens, string_agg(t || ':' || n, ', ' ORDER BY t) AS doc_types FROM b GROUP BY slug""",
    "token_summary": f"SELECT count(*) AS chunks, min({_t}) AS least, max({_t}) AS most, round(avg({_t}), 6) AS mean FROM documents",
    "token_histogram": f"WITH b AS (SELECT * FROM (VALUES (0, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 10000), (10000, NULL)) v(low, high)), t AS (SELECT {_t} AS t FROM documents) SELECT low, high, count(t) AS chunks FROM b LEFT JOIN t ON t >= low AND (high IS NULL OR t < high) GROUP BY low, high",
    "scoreboard": f"WITH v AS (SELECT regexp_extract(trim(line), '^(PASS|FAIL|TIMEOUT|UNKNOWN):', 1) AS s FROM {G.LINES.sql()}) SELECT count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (s = 'TIMEOUT') AS timed_out, count(*) FILTER (s = 'UNKNOWN') AS unknown, count(*) AS total, count(*) = count(*) FILTER (s = 'PASS') AS perfect FROM v WHERE s <> ''",
    "next_version": rf"SELECT coalesce(max(CAST(nullif(regexp_extract(path, '_v(\d+)', 1), '') AS INTEGER)), 0) + 1 AS version FROM {G.PATHS.sql()}",
    "latest_run": f"SELECT max(path) AS path FROM {G.PATHS.sql()}",
    "usage_by_key": _use,
    "usable_keys": f"SELECT key, remaining FROM ({_use}) WHERE remaining >= 187000 AND key NOT IN (1, 5, 9)",
    "rate_window": f"SELECT event_id, count(*) OVER w AS requests_60s, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_60s FROM {_log} WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)",
    "trace_runs": _runs.format(part="", src=G.TRACE.sql(), by=""),
    "event_runs": _runs.format(part="key, ", src="(SELECT user_id AS key, event_id AS seq, event_type AS value FROM events)", by="PARTITION BY key"),
    "last_lines": "SELECT event_id AS seq, event_type AS line FROM events ORDER BY event_id DESC LIMIT 30",
    "module_topo": f"WITH RECURSIVE e AS (SELECT * FROM {G.EDGES.sql()}), walk AS (SELECT dst AS module, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT e.src, walk.level + 1 FROM walk JOIN e ON e.dst = walk.module) SELECT module, max(level) AS level FROM walk GROUP BY module",
    "changed_sources": f"SELECT n.slug, n.file_hash, n.file_hash IS DISTINCT FROM m.file_hash AS is_new FROM {G.NOW.sql()} n LEFT JOIN {G.MANIFEST.sql()} m ON n.slug = m.slug",
    "orphans": f"SELECT m.slug, m.slug IN (SELECT slug FROM {G.NOW.sql()} n) AS in_corpus FROM {G.MANIFEST.sql()} m",
    "upsert_latest": f"SELECT * FROM {OLD.sql()} o WHERE slug NOT IN (SELECT slug FROM {NEW.sql()} n) UNION ALL SELECT * FROM {NEW.sql()} n",
    "latest_rows": f"SELECT * FROM {OLD.sql()} o QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ord DESC) = 1",
    "stream_scoreboard": f"WITH v AS (SELECT regexp_extract(trim(line), '^(PASS|FAIL|TIMEOUT|UNKNOWN):', 1) AS status FROM {G.LINES.sql()}) SELECT status, count(*) AS tests FROM v WHERE status <> '' GROUP BY status",
    "stream_changed_sources": f"SELECT slug, file_hash FROM {G.NOW.sql()} n UNION ALL SELECT slug, file_hash FROM {G.MANIFEST.sql()} m WHERE slug NOT IN (SELECT slug FROM {G.NOW.sql()} n)",
    "stream_usage_windows": f"""WITH w AS (SELECT key, unnest(generate_series(time_bucket(INTERVAL '1 second', ts - INTERVAL '59 seconds', TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 second', ts, TIMESTAMP '1970-01-01'), INTERVAL '1 second')) AS start, tokens FROM {_log}),
        g AS (SELECT key, start, count(*) AS n, sum(tokens) AS t FROM w GROUP BY 1, 2) SELECT key, count(*) AS windows, max(n) AS most_requests, CAST(max(t) AS BIGINT) AS most_tokens FROM g GROUP BY 1""",
    "nested_values": f"""SELECT d.id, fullkey AS path, CASE WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE 'number' END AS type,
        CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN atom ->> '$' END AS value FROM (SELECT * FROM {G.DOCUMENTS.sql()} WHERE json_valid(document)) d, json_tree(d.document)""",
    "stream_admissions": f"""WITH RECURSIVE e AS (SELECT key, event_id, epoch_us(ts) AS t, tokens, row_number() OVER w AS i, epoch_us(lead(ts) OVER w) AS next FROM {_log} WHERE ts IS NOT NULL AND tokens IS NOT NULL
            AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - {LATE_MINUTES * 60_000} FROM events) WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
        s AS (SELECT key, 1::BIGINT AS i, t AS now, CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) AS log, CAST(NULL AS BIGINT) AS request, CAST(NULL AS BIGINT) AS asked, CAST(NULL AS BIGINT) AS admitted FROM e WHERE i = 1
            UNION ALL SELECT key, CASE WHEN ok THEN i + 1 ELSE i END, CASE WHEN ok THEN greatest(now, next) ELSE greatest(now + 500000, live[1].t + {round(BUDGET.hold * 1_000_000)}) END,
                CASE WHEN ok THEN list_append(live, {{'t': now, 'n': tokens}}) ELSE live END, CASE WHEN ok THEN event_id END, CASE WHEN ok THEN t END, CASE WHEN ok THEN now END
            FROM (SELECT *, tokens > {BUDGET.tokens} OR len(live) = 0 OR (list_sum(list_transform(live, lambda x: x.n)) + tokens <= {BUDGET.tokens} AND len(live) < {BUDGET.requests}) AS ok
                FROM (SELECT e.*, s.now, list_filter(s.log, lambda x: x.t > s.now - {round(BUDGET.window * 1_000_000)}) AS live FROM s JOIN e ON e.key = s.key AND e.i = s.i)))
        SELECT key, request, make_timestamp(asked) AS asked, make_timestamp(admitted) AS admitted FROM s WHERE request IS NOT NULL""",
    "module_specs": f"SELECT id, name AS module, spec FROM {G.MODULES.sql()} m LEFT JOIN (SELECT module, arg_min(spec, pos) AS spec FROM {SPECS.sql()} GROUP BY 1) s ON s.module = m.name",
    "masked_keys": f"SELECT path, left(path, 4) || '…' || right(path, 4) AS masked FROM {G.PATHS.sql()}",
    "preview": "SELECT source, doc_id, lang FROM documents ORDER BY source, doc_id LIMIT 5",
    "run_tables": f"SELECT 'run_v002_20240102_second' AS run, artifact, ord, line || ' // second' AS line FROM {RUNS.sql()}",
    "stream_usage": "SELECT time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2",
}
