"""Admission under budgets of tokens and requests, as state by slot of keys: when each request of a log may go ahead."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
#: Keys are dealt into so many slots of state: what a state costs is paid by slot and not by key.
SLOTS = 1024
#: What is kept of a request: by these, in this order, requests are decided.
WAITING = ["no_key", "key", "us", "no_request", "request", "tokens"]


@dataclass(frozen=True)
class Budget:
    """What a window of seconds may hold. A request that doesn't fit waits until `hold` seconds after the oldest one, `least`
    seconds at least, and tries again; one larger than the budget never fits, and goes ahead."""

    tokens: int = 8000
    requests: int = 30
    window: float = 60.0
    hold: float = 61.0
    least: float = 0.5

    def admit(self, log: list[tuple[int, int]], now: int, tokens: int) -> int:
        """Admission time in microseconds of a request that asks at `now`; the log (time, tokens) is pruned and gets it."""
        while True:
            gone = now - round(self.window * MICROS)
            log[:] = [x for x in log if x[0] > gone]
            if tokens > self.tokens or not log or (sum(n for _, n in log) + tokens <= self.tokens and len(log) < self.requests):
                log.append((now, tokens))
                return now
            now = max(now + round(self.least * MICROS), log[0][0] + round(self.hold * MICROS))


class Admission(StatefulProcessor):
    """By slot of keys: requests that wait for the watermark, and of each key the admitted ones of the last window and the last
    admission. A key's requests go in order of (ts, request), each not before the one ahead of it. A timer at the earliest
    waiting request brings the watermark's news, so rows that come late but within it keep their place. State is kept as
    blocks of numbers: one value for each block of rows that came, and one for all logs of the slot's keys."""

    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.logs = handle.getValueState("logs", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r[WAITING].to_numpy(np.int64) for r in rows if len(r)]
        if new:
            self.waiting.appendList([(x.tobytes(),) for x in new])
            self.handle.registerTimer(min(int(x[:, 2].min()) for x in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts = [np.frombuffer(x[0], np.int64).reshape(-1, len(WAITING)) for x in self.waiting.get()]
        waiting = np.concatenate(parts) if parts else np.empty((0, len(WAITING)), np.int64)
        ripe = waiting[:, 2] // 1000 < mark
        due, left = waiting[ripe], waiting[~ripe]
        if len(left):
            self.handle.registerTimer(int(left[:, 2].min()) // 1000 + 1)
        if not len(due):
            return
        due = due[np.lexsort(due.T[::-1])]  # by key, time and request
        state = self.logs.get() if self.logs.exists() else None
        logs: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        for nulls, k, last, us, tokens in np.frombuffer(state[0], np.int64).reshape(-1, 5).tolist() if state else ():
            logs.setdefault((nulls, k), (last, []))[1].append((us, tokens))
        admitted, who, now, log = [], None, None, []
        for nulls, k, us, _, _, tokens in due.tolist():
            if who != (nulls, k):
                if who:
                    logs[who] = now, log
                who = nulls, k
                now, log = logs.get(who, (None, []))
            now = self.budget.admit(log, us if now is None else max(us, now), tokens)
            admitted.append(now)
        logs[who] = now, log
        self.logs.update((np.array([(*k, last, *x) for k, (last, log) in logs.items() for x in log], np.int64).tobytes(),))
        if len(left):
            self.waiting.put([(left.tobytes(),)])
        else:
            self.waiting.clear()
        whole = lambda values, nulls: pd.arrays.IntegerArray(values.copy(), nulls == 1)
        yield pd.DataFrame({"key": whole(due[:, 1], due[:, 0]), "request": whole(due[:, 4], due[:, 3]), "asked_us": due[:, 2], "admitted_us": np.array(admitted, np.int64)})

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, budget: Budget, late: str = "10 minutes", slots: int = SLOTS) -> DataFrame:
    """key, request, asked, admitted of a stream of requests (key long, request long, ts, tokens long): when each may go
    ahead. A request is decided once the watermark is past it, so rows may come `late`. State by slot of keys (a key's slot is
    told by its hash, so `slots` has to stay the same for a checkpoint): the requests that wait for the watermark and those
    admitted in the last window. A key's requests are decided in one order, by one task. Null ts or tokens: left out; repeated rows are requests of their own. Run it in append mode, in with_state_store()."""
    known = requests.filter("ts IS NOT NULL AND tokens IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("request").cast("long").alias("request"), "ts", F.col("tokens").cast("long").alias("tokens"))
    flag = lambda c: F.col(c).isNull().cast("long")
    rows = known.withWatermark("ts", late).select(
        "ts", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"), flag("key").alias("no_key"), F.coalesce("key", F.lit(0)).alias("key"), F.unix_micros("ts").alias("us"), flag("request").alias("no_request"), F.coalesce("request", F.lit(0)).alias("request"), "tokens"
    )
    out = rows.groupBy("slot").transformWithStateInPandas(Admission(budget), "key long, request long, asked_us long, admitted_us long", "append", "EventTime")
    return out.select("key", "request", F.timestamp_micros("asked_us").alias("asked"), F.timestamp_micros("admitted_us").alias("admitted"))


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that state by key with timers needs, for queries that start and end in here."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)
