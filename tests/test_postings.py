"""Stored postings against scores counted by hand."""

from __future__ import annotations

import gc
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import postings as P
from quern.operators import retrieval as R
from quern.sources.scratch import Scratch

TOKEN = re.compile(r"[a-zA-Z0-9_\-\.]+")


def corpus(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    return [(i // 3, i % 3, "t", " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(n)]


def by_hand(rows: list[tuple], question: str, k: int) -> list[tuple]:
    tf = {(p, o): Counter(TOKEN.findall(t.lower())) for p, o, _, t in rows}
    df = Counter(t for c in tf.values() for t in c)
    avgdl = sum(sum(c.values()) for c in tf.values()) / len(tf)
    idf = {t: math.log(len(tf) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    least = 0.25 * sum(idf.values()) / len(idf)
    score = lambda c: sum(max(idf[t], least if idf[t] < 0 else idf[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl)) for t in TOKEN.findall(question.lower()) if c[t])
    best = sorted(((key, score(c)) for key, c in tf.items()), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return [(i, *key, round(s, 6)) for i, (key, s) in enumerate(best)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "parent_id long, ord int, title string, text string")


@pytest.mark.parametrize("size", [64, 16_384])
def test_search_equals_scores_by_hand(spark, size, monkeypatch):
    rows = corpus(900)
    monkeypatch.setattr(P.segments, "__defaults__", (0, size))
    index = R.Index.build(frame(spark, rows).repartition(3), Scratch(spark))
    asked = ["w1 w2 w77 w3", "w1 w1 w1", "nothing known", "", "w900 w12 w5 w1 w2 w8 w9 w30 w31"]
    got = R.bm25_topk(index, spark.createDataFrame([*enumerate(asked), (9, None)], "question_id long, question string"), 12).collect()
    for q, question in enumerate(asked):
        assert sorted((r["rank"], r.parent_id, r.ord, r.score) for r in got if r.question_id == q) == by_hand(rows, question, 12)
    assert {r.question_id for r in got} == set(range(len(asked)))


def test_blocks_that_cannot_enter_are_skipped():
    """Rare words lift a few passages; the blocks of common words are read where these are only."""
    r = np.random.default_rng(3)
    n = 8000
    texts = [" ".join(["common"] * int(r.integers(1, 3)) + [f"mid{int(r.integers(0, 40))}"] + (["rare other"] if i % 997 == 5 else [])) for i in range(n)]
    segment = P.Segment(3.0)
    segment.add(P.segment_rows(0, np.arange(n), np.zeros(n, np.int64), texts))
    asked = [("rare", 20.0), ("other", 15.0), ("mid7", 3.0), ("common", 0.5)]
    docs, scores = segment.best(asked, 5)
    assert segment.skipped > 50 and segment.read < 30
    plain = P.Segment(3.0)
    plain.add(P.segment_rows(0, np.arange(n), np.zeros(n, np.int64), texts))
    every, all_scores = plain.best(asked, n)
    best = np.lexsort((every, -np.round(all_scores, 9)))[:5]
    mine = np.lexsort((docs, -np.round(scores, 9)))[:5]
    assert every[best].tolist() == docs[mine].tolist() and np.allclose(all_scores[best], scores[mine])
    assert plain.skipped == 0


def test_skipping_never_changes_a_result():
    r = random.Random(9)
    for _ in range(60):
        n = r.randint(1, 700)
        texts = [" ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(r.randint(0, 12))) for _ in range(n)]
        asked = [(f"w{i}", r.choice([0.1, 0.5, 1.0, 4.0])) for i in r.sample(range(1, 30), r.randint(1, 12))]
        results = []
        for k in (3, n):
            s = P.Segment(5.0)
            s.add(P.segment_rows(0, np.arange(n), np.zeros(n, np.int64), texts))
            docs, scores = s.best(asked, k)
            order = np.lexsort((docs, -np.round(scores, 9)))[:3]
            results.append([(int(docs[i]), round(float(scores[i]), 9)) for i in order])
        assert results[0] == results[1]


def test_replaced_keeps_segments_and_counts(spark, monkeypatch):
    monkeypatch.setattr(P.segments, "__defaults__", (0, 1024))
    old, new = corpus(6000), [(p, o, "t", t + " renewed") for p, o, _, t in corpus(30, 5)] + [(5000, 0, "t", "an added one")]
    scratch = Scratch(spark)
    path = scratch.path()
    R.Index.build(frame(spark, old).coalesce(1), scratch).save(path)
    index = R.Index.load(spark, path)
    monkeypatch.setattr(R.T, "tokenize", None)  # no passage is tokenized by Spark either
    after = index.replaced(frame(spark, new), spark.createDataFrame([(1999,)], "parent_id long"), scratch)
    gone = {p for p, *_ in new} | {1999}
    rows = [x for x in old if x[0] not in gone] + new
    before, now = ({r[0] for r in x.blocks.select("segment").distinct().collect()} for x in (index, after))
    assert len(before) >= 5 and before < now
    kept = {f for f in after.blocks.inputFiles() if f.startswith(f"file://{path}") or path in f}
    assert kept and kept <= set(index.blocks.inputFiles())
    df = Counter(t for _, _, _, text in rows for t in set(TOKEN.findall(text.lower())))
    assert {r.term: r.df for r in after.terms.collect()} == {**df, "": len(rows)}
    monkeypatch.undo()
    for question in ("w1 w2 renewed added", "w40 w1999 one"):
        got = R.bm25_topk(after, spark.createDataFrame([(1, question)], "question_id long, question string"), 10).collect()
        assert sorted((r["rank"], r.parent_id, r.ord, r.score) for r in got) == by_hand(rows, question, 10)


def test_segments_are_searched_once(spark, monkeypatch):
    """Each segment counts itself where it is searched."""
    index = R.Index.build(frame(spark, corpus(300)).coalesce(1), Scratch(spark))
    met, search = spark.sparkContext.accumulator(0), P.search

    def counted(*args):
        def run(batches):
            for b in batches:
                met.add(b.num_rows)
                yield b

        out = search(*args)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(P, "search", counted)
    R.bm25_topk(index, spark.createDataFrame([(1, "w1 w2"), (2, "none")], "question_id long, question string"), 5).collect()
    assert met.value == 5


@pytest.mark.parametrize("few", [True, False])
def test_replaced_segments_stay_whole_files_without_taking_postings_apart(spark, monkeypatch, few):
    """One file and one task a segment, no posting is a row, an index that is built in its place, thinned twice."""
    monkeypatch.setattr(P.segments, "__defaults__", (0, 1024))
    if not few:
        monkeypatch.setattr(P, "BROADCAST_SEGMENTS", 0)
    rows, scratch = corpus(3000), Scratch(spark)
    index = R.Index.build(frame(spark, rows).coalesce(1), scratch, scratch.path())
    plans, write = [], P.write_segments

    def written(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(P, "write_segments", written)
    for gone in (range(0, 1000, 9), range(5, 1000, 7)):
        index = index.replaced(frame(spark, rows[:0]), spark.createDataFrame([(i,) for i in gone], "parent_id long"), scratch)
        rows = [x for x in rows if x[0] not in gone]
    assert len(plans) >= 2 and not any("explode" in p.lower() for p in plans)
    blocks = index.blocks.select("*", F.input_file_name().alias("file"))
    assert blocks.groupBy("segment").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert {r.term: r.df for r in index.terms.collect()} == {**Counter(t for _, _, _, text in rows for t in set(TOKEN.findall(text.lower()))), "": len(rows)}
    got = R.bm25_topk(index, spark.createDataFrame([(1, "w1 w2 w30")], "question_id long, question string"), 10).collect()
    assert sorted((r["rank"], r.parent_id, r.ord, r.score) for r in got) == by_hand(rows, "w1 w2 w30", 10)


def test_wide_passages_make_segments_of_as_many_tokens(spark, monkeypatch):
    """A segment ends at a number of tokens, too, and nothing is lost where it does."""
    rows = [(i, 0, "t", " ".join(f"w{i % 7} x" for _ in range(50))) for i in range(200)]
    monkeypatch.setattr(P, "SEGMENT_TOKENS", 1000)
    index = R.Index.build(frame(spark, rows).coalesce(1), Scratch(spark))
    assert sorted(r.n for r in index.blocks.filter("term = ''").collect()) == [8, 64, 64, 64]
    assert {r.term: r.df for r in index.terms.collect()} == {"": 200, "x": 200} | {f"w{k}": len(range(k, 200, 7)) for k in range(7)}


def test_a_segment_that_is_done_leaves_nothing():
    """No cycle keeps its vocabulary until the collector comes."""
    held = P.Filling()
    held.add([1, 2], [0, 0], ["a b a", "b c"])
    vocabulary = held.vocabulary
    P.rows_of(0, held)
    assert dict(vocabulary) == {"a": 0, "b": 1, "c": 2} and vocabulary not in gc.get_referents(*gc.get_referents(vocabulary))


def test_an_empty_index(spark):
    index = R.Index.build(frame(spark, []), Scratch(spark))
    assert R.bm25_topk(index, spark.createDataFrame([(1, "a b")], "question_id long, question string")).count() == 0
