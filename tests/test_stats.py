"""Levels of graphs with many ways to a module, and peaks of sliding windows, against plain counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import stats as A
from quern.streaming import streams


def levels(spark, edges):
    rows = A.module_levels(spark.createDataFrame(edges, "src string, dst string")).collect()
    out = {r.module: r.level for r in rows}
    assert len(out) == len(rows)
    return out


def test_levels_with_a_million_ways(spark):
    """Layers of 2 modules, each on both of the layer below, every edge twice: 2 * 4 ** 11 walks."""
    edges = [(f"{k + 1}{a}", f"{k}{b}") for k in range(11) for a in "xy" for b in "xy"] * 2
    assert levels(spark, edges) == {f"{k}{a}": k for k in range(12) for a in "xy"}


def test_levels_leave_out_what_no_leaf_reaches(spark):
    edges = [("a", "b"), ("c", "a"), ("c", "b"), ("p", "q"), ("q", "p"), ("a", "p"), ("n", None), ("m", "n"), (None, "a")]
    assert levels(spark, edges) == {"b": 0, "a": 1, "c": 2, None: 2}
    assert levels(spark, []) == {}
    with pytest.raises(ValueError, match="cycle"):
        levels(spark, [("a", "b"), ("b", "a"), ("a", "leaf")])


def test_peaks_of_windows_against_all_windows(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.randint(-700, 3000) + r.choice([0.0, 0.25]), r.choice([None, 0, 5, 40, -30])) for _ in range(400)]
    rows += [(7, 50.5, None), (8, 1e9, 3), (9, None, 5)]
    want = {}
    for key, at, tokens in rows:
        for w in range(int(at // 1) - 59, int(at // 1) + 1) if at is not None else ():
            want.setdefault(key, {}).setdefault(w, []).append(tokens)
    total = lambda ts: [sum(t for t in ts if t is not None)] if any(t is not None for t in ts) else []
    want = {k: (len(ws), max(map(len, ws.values())), max((x for ts in ws.values() for x in total(ts)), default=None)) for k, ws in want.items()}
    log = spark.createDataFrame(rows, "key long, at double, tokens long").select("key", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "tokens")
    parts = streams.seconds_of(log.filter("tokens IS NULL OR tokens < 6")).unionByName(streams.seconds_of(log.filter("tokens >= 6")))
    got = streams.usage_peaks(streams.seconds_of(parts)).collect()
    assert {x.key: (x.windows, x.most_requests, x.most_tokens) for x in got} == want and len(got) == len(want)
