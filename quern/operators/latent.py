"""An embedder that learns: latent semantic vectors, by a distributed randomized SVD of term weights.

The terms of the vocabulary get vectors W by subspace iteration: each pass over the texts sums up A' (A W) for the matrix A of
weights (texts x terms), and a tall-skinny QR on the driver makes the sum orthonormal again. The vocabulary has a bound, and
so has W. A text's vector is its row of A times W."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.memory import give_back
from quern.sources.scratch import Scratch

#: Terms that have vectors: the most frequent ones, by text. With 64 dimensions they take 16 MB.
VOCABULARY, DIM, SPARE, PASSES = 32_768, 64, 16, 3
#: Terms of a block of sums, and texts that a task weighs at once.
ROWS, TEXTS = 2048, 1024
#: A term in so many of these texts is a column of a dense matrix.
OFTEN = 8


def counted(texts: list[str | None], place: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of texts in order of row and term."""
    find, get, sizes, terms = re.compile(T.TOKEN).findall, place.get, [], array("i")
    for t in texts:
        known = [x for x in map(get, find((t or "").lower())) if x is not None]
        sizes.append(len(known))
        terms.extend(known)
    both, tf = np.unique(np.repeat(np.arange(len(texts)) * size, sizes) + np.array(terms, np.int64), return_counts=True)
    return *np.divmod(both, max(1, size)), tf


def weights(row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """(1 + ln tf) idf, of length one in each row."""
    w = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    return w / np.maximum(norm[row], 1e-300)


def weighed(texts: list[str | None], place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of texts in order of row and term."""
    row, term, tf = counted(texts, place, len(idf))
    return row, term, weights(row, term, tf, idf, len(texts))


class Weights:
    """Rows of the matrix of weights: terms of many of these texts as a dense matrix, the others one by one."""

    def __init__(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int):
        met, at, times = np.unique(term, return_inverse=True, return_counts=True)
        often = times >= OFTEN
        dense, rare = often[at], ~often[at]
        self.head, self.a = met[often], np.zeros((n, int(often.sum())))
        self.a[row[dense], (np.cumsum(often) - 1)[at[dense]]] = w[dense]
        self.row, self.term, self.w = row[rare], term[rare], w[rare, None]

    def times(self, m: np.ndarray) -> np.ndarray:
        """A m"""
        out = self.a @ m[self.head]
        _add(out, self.row, m[self.term] * self.w)
        return out

    def back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds A' y to total."""
        total[self.head] += self.a.T @ y
        order = np.argsort(self.term, kind="stable")
        _add(total, self.term[order], y[self.row[order]] * self.w[order])


def _add(out: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows of values by key, in ascending order of keys."""
    if len(keys):
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        out[keys[starts]] += np.add.reduceat(values, starts)


class LatentEmbedder:
    """Texts to vectors by learnt term vectors; a text without known terms gets zeros."""

    def __init__(self, place: dict[str, int], idf: np.ndarray, vectors: np.ndarray):
        self.place, self.idf, self.vectors, self.dim = place, idf, vectors, vectors.shape[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            out[at : at + TEXTS] = Weights(*weighed(part, self.place, self.idf), len(part)).times(self.vectors)
        return out


def upright(m: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive, so that signs are no matter of chance."""
    return m * np.where(m[np.abs(m).argmax(0), np.arange(m.shape[1])] < 0, -1.0, 1.0)


def latent_embedder(texts: DataFrame, terms: DataFrame, *, dim: int = DIM, vocabulary: int = VOCABULARY, passes: int = PASSES, seed: int = 7, scratch: Scratch | None = None) -> LatentEmbedder:
    """Learns from every text of texts (text) and its term table (term, df; the row of the empty term has the number of
    texts). The texts are read once, and their counts of the vocabulary's terms written down. Each pass over these is one
    job: a task passes on a block of sums for each block of terms that it met. Sums are of doubles, so vectors agree to
    rounding however the texts are dealt. The dimension is the number of terms if that is smaller."""
    top = terms.filter("term <> ''").orderBy(F.desc("df"), "term").limit(vocabulary).toArrow().to_pydict()
    n = max(1, terms.filter("term = ''").agg(F.coalesce(F.max("df"), F.lit(1))).first()[0])
    place = {t: i for i, t in enumerate(top["term"])}
    idf, size = np.log(1 + n / np.array(top["df"], float)), len(place)
    if not size:
        return LatentEmbedder({}, np.ones(1), np.zeros((1, dim)))
    wide, sc = min(size, dim + SPARE), texts.sparkSession.sparkContext
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, wide)))[0]
    sent = sc.broadcast(place)

    def read(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.column(0).slice(at, TEXTS).to_pylist()
                row, term, tf = (x.astype(np.int32).tobytes() for x in counted(part, sent.value, size))
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), *(pa.array([x], pa.binary()) for x in (row, term, tf))], names=["n", "row", "term", "tf"])
        give_back()

    scratch = scratch or Scratch(texts.sparkSession)
    counts = scratch.write(texts.select("text").mapInArrow(read, "n int, row binary, term binary, tf binary"))
    sent.unpersist()
    for k in range(passes + 1):
        sent, last = sc.broadcast((idf, w)), k == passes

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last: bool = last) -> Iterator[pa.RecordBatch]:
            idf, w = sent.value
            total = np.zeros((w.shape[1], w.shape[1]) if last else w.shape)
            for batch in batches:
                for i in range(batch.num_rows):
                    n, (row, term, tf) = batch.column(0)[i].as_py(), (np.frombuffer(batch.column(j)[i].as_py(), np.int32) for j in (1, 2, 3))
                    a = Weights(row, term, weights(row, term, tf, idf, n), n)
                    y = a.times(w)
                    if last:
                        total += y.T @ y
                    else:
                        a.back(y, total)
            for at in range(0, len(total), ROWS):
                if total[at : at + ROWS].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + ROWS].tobytes()], pa.binary())], names=["at", "sums"])
            del total
            give_back()

        def added(t: pa.Table) -> pa.Table:
            total = 0.0
            for x in sorted(t["sums"].to_pylist()):
                total = total + np.frombuffer(x)
            return pa.table({"at": t["at"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        got = counts.mapInArrow(run, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").toArrow().to_pydict()
        total = np.zeros((wide, wide) if last else w.shape)
        for at, sums in zip(got["at"], got["sums"], strict=True):
            part = np.frombuffer(sums).reshape(-1, wide)
            total[at : at + len(part)] = part
        sent.unpersist()
        if last:  # the columns turned to the singular vectors, largest first
            value, turn = np.linalg.eigh(total)
            w = upright(w @ turn[:, np.argsort(-value, kind="stable")][:, :dim])
        else:
            w = np.linalg.qr(total)[0]
    scratch.drop(counts)
    return LatentEmbedder(place, idf, w)
