"""The kept vector store against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from quern.operators import retrieval as R
from quern.operators.vectors import VectorStore
from quern.sources.scratch import Scratch, exists


def clustered(n: int, dim: int, groups: int, seed: int, spread: float = 0.05) -> np.ndarray:
    r = np.random.default_rng(seed)
    return (r.normal(size=(groups, dim))[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))).astype(np.float32)


def frame(spark, v, sources, first=0):
    return spark.createDataFrame([(sources[i % len(sources)], first + i, x.tolist()) for i, x in enumerate(v)], "source string, child_id long, embedding array<float>")


def best(v: dict, q: np.ndarray, k: int) -> list[tuple]:
    norm = lambda x: x / max(np.linalg.norm(x), 1e-300)
    s = sorted(((-round(float(norm(q.astype(float)) @ norm(x.astype(float))), 9), i) for i, x in v.items()))[:k]
    return [(r, i, round(-x, 6) + 0.0) for r, (x, i) in enumerate(s)]


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_search_is_exact_and_reads_few_cells(spark, cells):
    scratch = Scratch(spark)
    v = clustered(600, 8, 12, 1)
    v[5] = 0  # norm 0
    v[20] = v[21] = v[22]  # ties
    store = VectorStore(spark, scratch.path(), ("child_id",)).create(frame(spark, v, ["a", "b", "c/d"]), cells)
    q = np.vstack([v[[0, 7, 20, 5]], clustered(3, 8, 3, 9)]).astype(float)
    found = store.search(np.arange(len(q)), q, 10, scratch)
    rows = R.top_k(found.hits, 10).collect()
    for i in range(len(q)):
        assert sorted((r["rank"], r.child_id, r.score + 0.0) for r in rows if r.question_id == i) == best(dict(enumerate(v)), q[i], 10)
    assert found.pairs == len(q) * len(np.flatnonzero(store.bounds()[1])) and (cells < 40 or found.scored < 0.6 * found.pairs)


def test_a_source_is_replaced_alone(spark):
    scratch = Scratch(spark)
    v, w = clustered(200, 6, 5, 2), clustered(30, 6, 5, 3)
    store = VectorStore(spark, scratch.path(), ("child_id",)).create(frame(spark, v, ["a", "b"]))
    files = {f for f in store.vectors.inputFiles() if "source=b" in f}
    store.replace(frame(spark, w, ["a"], 1000))
    assert files == {f for f in store.vectors.inputFiles() if "source=b" in f}
    now = {i: x for i, x in enumerate(v) if i % 2 == 1} | {1000 + i: x for i, x in enumerate(w)}
    assert {r.child_id for r in store.vectors.collect()} == set(now) and store.bounds()[1].sum() == len(now)
    rows = R.top_k(store.search(np.array([3]), w[:1].astype(float), 50, scratch).hits, 50).collect()
    assert sorted((r["rank"], r.child_id, r.score + 0.0) for r in rows) == best(now, w[0], 50)
    assert exists(spark, f"{store.path}/centroids")


def test_fewer_vectors_than_asked_for_and_none(spark):
    scratch = Scratch(spark)
    v = clustered(4, 5, 2, 4)
    store = VectorStore(spark, scratch.path(), ("child_id",)).create(frame(spark, v, ["a"]).unionByName(spark.createDataFrame([("a", 9, None), (None, 8, [1.0] * 5)], "source string, child_id long, embedding array<float>")))
    assert R.top_k(store.search(np.array([1]), v[:1].astype(float), 12, scratch).hits, 12).count() == 4
    assert store.search(np.empty(0, np.int64), np.empty((0, 5)), 12, scratch).hits.count() == 0
