"""State by key in event order, and batches that fail between their writes."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from quern.plans.registry import QUERIES
from quern.sources.scratch import Scratch, create_once
from quern.streaming import limiter, streams
from quern.streaming.ledger import Ledger
from tests.oracle import DATA

BUDGET = limiter.Budget(tokens=100, requests=3, window=60.0, hold=61.0)


def test_budget_by_hand():
    log, now = [], 0
    out = []
    for asked, tokens in [(0, 60), (1, 30), (2, 20), (3, 500), (4, 1)]:
        now = BUDGET.admit(log, max(now, asked * limiter.MICROS), tokens)
        out.append(now // limiter.MICROS)
    # 20 waits until the first is 61 s old; 500 never fits and goes ahead; 1 waits for all of that to leave.
    assert out == [0, 1, 61, 61, 122]


@pytest.mark.parametrize("slots", [2, 1024])
def test_many_keys_share_a_state(spark, slots):
    """Keys of one slot keep their own logs over batches; null requests stay null, large keys whole."""
    scratch, big = Scratch(spark), (1 << 60) + 1
    rows = [(big + i % 40 if i % 41 else None, i if i % 13 else None, (i + 500) * 3_000_000 + i, 40) for i in range(600)]
    path = scratch.path()
    for part in (rows[:300], rows[300:]):
        spark.createDataFrame(part, "key long, request long, us long, tokens long").selectExpr("key", "request", "timestamp_micros(us) AS ts", "tokens").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long, request long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(path)
    budget = limiter.Budget(tokens=100, requests=3, window=300.0, hold=301.0)
    with limiter.with_state_store(spark):
        out = limiter.admissions(stream, budget, "1 minute", slots)
        got = streams.run_to_end(out, scratch, "append").selectExpr("key", "request", "unix_micros(asked)", "unix_micros(admitted)").collect()
    end, logs, last, want = rows[-1][2] // 1000 - 60_000, defaultdict(list), defaultdict(int), []
    for key, request, us, tokens in rows:
        if us // 1000 < end:
            last[key] = budget.admit(logs[key], max(last[key], us), tokens)
            want.append((key, request, us, last[key]))
    order = lambda x: x[2]
    assert sorted(map(tuple, got), key=order) == want and len(want) > 500


def test_admissions_in_event_order_across_batches(spark):
    """Rows come late, but within the watermark; several files, each a batch."""
    r, scratch = random.Random(4), Scratch(spark)
    rows = [(r.choice([1, 2, None]), i, i * 7 + r.random(), r.choice([0, 5, 40, 90, 300])) for i in range(400)]
    order = sorted(rows, key=lambda x: x[2] + r.uniform(0, 250))
    path = scratch.path()
    for k in range(5):
        part = spark.createDataFrame(order[k * 80 : (k + 1) * 80], "key long, request long, at double, tokens long").selectExpr("key", "request", "timestamp_micros(CAST(at * 1000000 AS BIGINT)) AS ts", "tokens")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long, request long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(path)
    with limiter.with_state_store(spark):
        got = streams.run_to_end(limiter.admissions(stream, BUDGET, "5 minutes"), scratch, "append").selectExpr("key", "request", "unix_micros(admitted) AS us").collect()
    end = int(max(x[2] for x in rows) * 1000) - 300_000
    want, logs, last = {}, defaultdict(list), defaultdict(int)
    for key, request, at, tokens in sorted(rows, key=lambda x: x[2]):
        us = int(at * 1_000_000)
        if us // 1000 < end:
            last[key] = want[key, request] = BUDGET.admit(logs[key], max(last[key], us), tokens)
    assert {(x.key, x.request): x.us for x in got} == want and len(got) == len(want) > 300


class Failing(Ledger):
    """Fails once between the rows and the manifest of a batch."""

    failed = False

    def _write(self, what, number, rows):
        if what == "manifest" and number == 2 and not self.failed:
            self.failed = True
            raise RuntimeError("the driver is lost here")
        super()._write(what, number, rows)


def test_a_batch_that_fails_is_neither_lost_nor_doubled(spark):
    scratch = Scratch(spark)
    path, checkpoint = scratch.path(), scratch.path()
    for k in range(3):
        spark.createDataFrame([(f"s{i}", f"h{i}{k if i % 2 else ''}", i, k) for i in range(k * 2, 8)], "slug string, file_hash string, x int, k int").coalesce(1).write.mode("append").parquet(path)
    ledger = Failing(spark, scratch.path(), "slug string, x int, k int")
    stream = lambda: spark.readStream.schema("slug string, file_hash string, x int, k int").option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(Exception):  # noqa: B017
        ledger.ingest(stream(), checkpoint).awaitTermination()
    assert ledger.failed and ledger.committed() == [0]
    torn = ledger.rows().count()
    assert torn == 8  # what the failed batch wrote isn't seen
    again = Ledger(spark, ledger.path, ledger.schema)  # another driver
    again.ingest(stream(), checkpoint).awaitTermination()
    assert again.committed() == [0, 2, 4]
    want = {(f"s{i}", i, 0 if i % 2 == 0 else min(i // 2, 2)) for i in range(8)}
    assert sorted(tuple(x) for x in again.rows().select("slug", "x", "k").collect()) == sorted(want)
    assert not again.apply(2, again.rows().selectExpr("slug", "'other' AS file_hash", "x", "k"))
    assert again.compact() == 3
    assert sorted(tuple(x) for x in again.rows().select("slug", "x", "k").collect()) == sorted(want)
    assert again.apply(3, spark.createDataFrame([("s1", "late", 9, 9), (None, "x", 1, 1)], "slug string, file_hash string, x int, k int"))
    assert sorted(tuple(x) for x in again.rows().select("slug", "x", "k").collect()) == sorted((want - {("s1", 1, 0)}) | {("s1", 9, 9)})


def test_one_of_many_makes_a_file(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{Scratch(spark).path()}/once"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: create_once(spark, path), range(16))) == 1


def test_streams_read_tables_of_parts(spark, tmp_path):
    """documents and events as folders of parts, and a document without text that an earlier state had."""
    docs = spark.createDataFrame([(i, None if i == 10 else f"A sentence of document {i} that is long enough to stay. Another one.", "en", "s", 9) for i in range(23)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.changed, r.n_children) for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()}
    assert got == {i: (i % 2 == 1 or i % 10 == 0, 0 if i == 10 else 1) for i in range(23)}
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["stream_usage"](spark, str(tmp_path)).selectExpr("sum(n)").first()[0] == events.count()
