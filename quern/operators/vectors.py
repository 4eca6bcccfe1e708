"""A kept store of vectors that is searched exactly: k-means cells with radii give bounds, and cells that can't hold one of a
query's k best vectors are not scored; cells that no query needs are not read.

A store is a folder: `vectors`, partitioned by source and sorted by cell; `bounds`, (cell, n, radius) by source; and
`centroids`. A source is replaced by overwriting its partitions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources.scratch import Scratch

#: Cells are about the root of the vectors, up to MOST_CELLS, which bounds what the driver holds and sends.
MOST_CELLS, ROUNDS = 4096, 4
#: Scores and bounds are compared with this slack, as sums of doubles depend on their order.
SLACK = 1e-7
#: Pairs of query and cell that the driver holds at once, and scores that a task does.
PAIRS, CELLS_AT_ONCE = 1 << 20, 1 << 22


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each unit vector, and the distance to its centroid."""
    cell = np.argmax(v @ centroids.T - (centroids**2).sum(1) / 2, axis=1)
    return cell, np.linalg.norm(v - centroids[cell], axis=1)


def k_means(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors (embedding). They begin as the vectors of smallest hash, and each round is one pass in which
    a task passes on a sum for each cell; a cell that loses all stays where it was."""
    first = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(cells).toArrow()
    at = unit(matrix(first.column(0).combine_chunks()))
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(at), np.zeros(len(at), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = unit(matrix(batch.column(0)))
                    cell, _ = nearest(v, at)
                    np.add.at(total, cell, v)
                    n += np.bincount(cell, minlength=len(at))
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array([x.tobytes() for x in total[held]], pa.binary())], names=["cell", "n", "total"])

        def added(t: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x) for x in sorted(t["total"].to_pylist())], axis=0)
            return pa.table({"cell": t["cell"][:1], "n": pa.array([sum(t["n"].to_pylist())]), "total": pa.array([total.tobytes()], pa.binary())})

        got = vectors.select("embedding").mapInArrow(sums, "cell long, n long, total binary").groupBy("cell").applyInArrow(added, "cell long, n long, total binary").toArrow().to_pydict()
        at = at.copy()
        for cell, n, total in zip(got["cell"], got["n"], got["total"], strict=True):
            at[cell] = np.frombuffer(total) / n
    return at


class Hits:
    """The k best of the vectors that a task has scored, for each query by number: rounded score, then key."""

    def __init__(self, queries: int, k: int, keys: int):
        self.k, self.scores, self.keys = k, np.full((queries, k), np.nan), [np.zeros((queries, k), np.int64) for _ in range(keys)]

    def offer(self, rows: np.ndarray, scores: np.ndarray, keys: list[np.ndarray]) -> None:
        """scores: the queries `rows` x vectors."""
        s = np.hstack([self.scores[rows], scores])
        ks = [np.hstack([old[rows], np.broadcast_to(x, scores.shape)]) for old, x in zip(self.keys, keys, strict=True)]
        order = np.lexsort((*ks[::-1], np.where(np.isnan(s), np.inf, -np.round(s, 9))), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(s, order, 1)
        for old, x in zip(self.keys, ks, strict=True):
            old[rows] = np.take_along_axis(x, order, 1)


@dataclass
class Found:
    """hits: question_id, key columns, score, of which each question's k best are right; pairs of query and cell that were
    scored, of all pairs."""

    hits: DataFrame
    scored: int
    pairs: int


class VectorStore:
    """Vectors (source string, key columns long, embedding) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...]):
        self.spark, self.path, self.key = spark, path, key

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, vectors and radius of each cell, over all sources."""
        at = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toArrow()
        n, radius = np.zeros(at.num_rows, np.int64), np.zeros(at.num_rows)
        for r in self.spark.read.parquet(f"{self.path}/bounds").groupBy("cell").agg(F.sum("n"), F.max("radius")).collect():
            n[r[0]], radius[r[0]] = r[1], r[2]
        return matrix(at["centroid"].combine_chunks()), n, radius

    def create(self, vectors: DataFrame, cells: int | None = None) -> VectorStore:
        """A new store of vectors. Rows without key, source or embedding are left out; no vector at all: no cell."""
        known = vectors.filter("embedding IS NOT NULL")
        cells = cells or max(1, min(MOST_CELLS, round(known.count() ** 0.5)))
        at = k_means(known, cells)
        self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(at)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return self.replace(vectors)

    def replace(self, vectors: DataFrame) -> VectorStore:
        """All vectors of the sources that `vectors` has are replaced by these; other sources' files are not touched."""
        at = matrix(self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toArrow()["centroid"].combine_chunks())
        key, n = self.key, len(self.key)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, far = nearest(unit(matrix(batch.column(n + 1))), at)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["source", *key, "embedding", "cell", "far"])

        rows = vectors.select("source", *(F.col(c).cast("long").alias(c) for c in self.key), F.col("embedding").cast("array<float>").alias("embedding")).dropna()
        types = ", ".join(["source string", *(f"{c} long" for c in self.key), "embedding array<float>", "cell int", "far double"])
        scratch = Scratch(self.spark)
        made = scratch.write(rows.mapInArrow(dealt, types))
        kept = {"partitionOverwriteMode": "dynamic"}
        made.drop("far").repartition("source", "cell").sortWithinPartitions("source", "cell").write.options(**kept).mode("overwrite").partitionBy("source").parquet(f"{self.path}/vectors")
        made.groupBy("source", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).repartition("source").write.options(**kept).mode("overwrite").partitionBy("source").parquet(f"{self.path}/bounds")
        scratch.close()
        return self

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, scratch: Scratch) -> Found:
        """The k best vectors by cosine of each query (ids, and a row of queries each), exactly: first in the nearest cells
        that together hold k vectors, then in every cell whose bound reaches the k-th score found there. A vector or query of
        norm 0 scores 0. Queries go in blocks of PAIRS pairs of query and cell, which is what the driver holds."""
        bounds = self.bounds()
        blocks = np.array_split(np.arange(len(ids)), max(1, -(-len(ids) * len(bounds[1]) // PAIRS)))
        found = [self._searched(ids[rows], queries[rows], k, scratch, *bounds) for rows in blocks]
        hits = found[0].hits
        for f in found[1:]:
            hits = hits.unionByName(f.hits)
        return Found(hits, sum(f.scored for f in found), sum(f.pairs for f in found))

    def _searched(self, ids: np.ndarray, queries: np.ndarray, k: int, scratch: Scratch, centroids: np.ndarray, n: np.ndarray, radius: np.ndarray) -> Found:
        q, cells = unit(queries), np.flatnonzero(n)
        if not len(cells) or not len(ids):
            return Found(self.spark.createDataFrame([], self._types()), 0, 0)
        far = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ centroids[cells].T + (centroids[cells] ** 2).sum(1), 0))
        order = np.argsort(far, axis=1)
        before = np.cumsum(n[cells][order], axis=1) - n[cells][order]
        a, b = np.nonzero(before < k)
        first = np.zeros(far.shape, bool)
        first[a, order[a, b]] = True
        rows, at = np.nonzero(first)
        hits = scratch.write(self._scored(ids, q, rows, cells[at], k))
        # Every query's nearest cells hold k vectors, if the store does; its k-th score there is one that the k best reach.
        kth, place = np.full(len(ids), -np.inf), {int(x): i for i, x in enumerate(ids)}
        nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
        for r in hits.select("question_id", "score", nth.alias("nth")).filter(F.col("nth") == k).collect():
            kth[place[r[0]]] = r[1]
        bound = 1 - np.maximum(far - radius[cells] - SLACK, 0) ** 2 / 2
        rows, at = np.nonzero((bound >= kth[:, None] - SLACK) & ~first)
        if len(rows):
            hits = hits.unionByName(self._scored(ids, q, rows, cells[at], k))
        return Found(hits, int(first.sum()) + len(rows), far.size)

    def _types(self) -> str:
        return ", ".join(["question_id long", *(f"{c} long" for c in self.key), "score double"])

    def _scored(self, ids: np.ndarray, q: np.ndarray, rows: np.ndarray, cells: np.ndarray, k: int) -> DataFrame:
        """Each task's k best of each query over the cells that the pairs (rows, cells) name; only these cells are read."""
        order = np.argsort(cells, kind="stable")
        rows, cells = rows[order], cells[order]
        names, starts = np.unique(cells, return_index=True)
        of = dict(zip(names.tolist(), np.split(rows, starts[1:]), strict=True))
        sent, key, n = self.spark.sparkContext.broadcast((ids, q, of)), self.key, len(self.key)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, of = sent.value
            best = Hits(len(ids), k, n)
            for batch in batches:
                cell = batch.column(n + 1).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)).tolist()
                for a, b in zip(edges, edges[1:], strict=False):
                    asked = of[int(cell[a])]
                    for at in range(a, b, max(1, CELLS_AT_ONCE // len(asked))):
                        part = batch.slice(at, min(b - at, max(1, CELLS_AT_ONCE // len(asked))))
                        best.offer(asked, q[asked] @ unit(matrix(part.column(n))).T, [part.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
            row, col = np.nonzero(~np.isnan(best.scores))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), *(pa.array(x[row, col]) for x in best.keys), pa.array(best.scores[row, col])], names=["question_id", *key, "score"])

        wanted = self.vectors.filter(F.col("cell").isin(names.tolist())).select(*self.key, "embedding", "cell")
        return wanted.mapInArrow(run, self._types())
