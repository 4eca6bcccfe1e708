"""Learnt vectors against a plain SVD."""

from __future__ import annotations

import random

import numpy as np

from quern.operators import latent
from quern.operators import retrieval as R

TOPICS = [["cat", "dog", "tail", "paw", "fur"], ["gate", "wire", "clock", "adder", "latch"], ["boil", "salt", "oven", "spoon", "dough"]]


def texts(n: int) -> list[tuple]:
    r = random.Random(2)
    return [(i, 0, str(i % 3), " ".join(r.choice(TOPICS[i % 3]) if r.random() < 0.85 else f"word{r.randint(0, 200)}" for _ in range(14))) for i in range(n)] + [(n, 0, "", ""), (n + 1, 0, "", None)]


def test_vectors_span_what_the_svd_does(spark):
    rows = texts(300)
    frame = spark.createDataFrame(rows, "parent_id long, ord int, title string, text string")
    terms = R.term_counts(frame)
    one, many = (latent.latent_embedder(frame.repartition(k, "parent_id"), terms, dim=6, passes=8) for k in (1, 7))
    plain = [x[3] for x in rows]
    assert np.allclose(one(plain), many(plain), atol=1e-7)
    assert np.array_equal(one(plain)[-2:], np.zeros((2, 6)))
    row, term, w = latent.weighed(plain, one.place, one.idf)
    a = np.zeros((len(plain), len(one.place)))
    a[row, term] = w
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.linalg.norm(one(plain), axis=0)[:3], s[:3], rtol=1e-3)
    assert np.linalg.norm(a - one(plain) @ one.vectors.T) < 1.05 * np.sqrt((s[6:] ** 2).sum())


def test_dense_and_rare_terms_add_up_to_the_same_product():
    r = np.random.default_rng(5)
    a = np.where(r.random((300, 50)) < np.geomspace(0.5, 0.003, 50), r.random((300, 50)), 0.0)
    row, term = np.nonzero(a)
    x, m, total = latent.Weights(row, term, a[row, term], 300), r.random((50, 4)), np.ones((50, 4))
    assert 0 < len(x.head) < 50 and len(x.term)
    x.back(x.times(m), total)
    assert np.allclose(x.times(m), a @ m) and np.allclose(total, 1 + a.T @ (a @ m))


def test_texts_are_read_once(spark):
    """Not once a pass: each text counts itself where it is read."""
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    frame = spark.createDataFrame(texts(60), "parent_id long, ord int, title string, text string")
    latent.latent_embedder(frame.select("text").mapInArrow(counted, "text string"), R.term_counts(frame), dim=4)
    assert met.value == 62


def agreement(vectors: np.ndarray, labels: list[str]) -> float:
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    near = v @ v.T
    np.fill_diagonal(near, -2)
    return float(np.mean([labels[i] == labels[j] for i, j in enumerate(near.argmax(1))]))


def test_neighbours_share_topics_more_often_than_with_hashes(spark):
    rows = texts(300)[:300]
    frame = spark.createDataFrame(rows, "parent_id long, ord int, title string, text string")
    learnt = latent.latent_embedder(frame, R.term_counts(frame), dim=8)
    plain, labels = [x[3] for x in rows], [x[2] for x in rows]
    assert agreement(learnt(plain), labels) >= max(0.97, agreement(R.HashingEmbedder()(plain), labels))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([], "parent_id long, ord int, title string, text string")
    assert latent.latent_embedder(frame, R.term_counts(frame), dim=4)(["a b", None]).tolist() == [[0.0] * 4] * 2
