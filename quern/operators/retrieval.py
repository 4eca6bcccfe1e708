"""Retrieval: BM25 and exact cosine over passages, rank fusion, parent expansion and budgeted prompts, for all questions at
once. Ties are broken by the passages' keys, and scores are compared after rounding to nine places, as sums of doubles
depend on their order in the last place.

Both searches send the questions, in blocks of bounded size, to what is stored, BM25 to segments of postings and cosine
search to vectors: each task passes on its k best a question, so no posting and no pair of question and passage is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.functions.memory import give_back
from quern.operators import incremental
from quern.operators import postings as P
from quern.sources.scratch import Scratch

K1, B, IDF_FLOOR = P.K1, P.B, 0.25
BM25_FETCH, TOP_CHILDREN, TOP_PARENTS, RRF_K = 15, 12, 3, 60
MAX_PARENT_CHARS, MAX_INPUT_TOKENS, OVERHEAD_TOKENS = 6000, 5500, 60
#: Question vectors and question texts go to all executors up to this size; more are searched in blocks of it.
QUERY_BLOCK_BYTES = 64 << 20
#: Scores of questions x passages that a task holds at once.
SCORE_CELLS = 1 << 21
#: Passages whose scores are all compared at once, and texts that are embedded at once.
OFFERED, TEXTS = 1024, 1024
#: Tokens whose places a task remembers.
KNOWN_TOKENS = 1 << 17
#: Keys of hits are broadcast up to this number; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: What names a passage: its document and its place in it.
KEY = ("parent_id", "ord")
#: The row of a term table that holds the number of passages and the sum of their lengths; no token is empty.
ALL = P.ALL
SYSTEM = "Answer from the given context alone. Be precise, cite the names and values that it states, and say what is missing if it does not suffice."


def children_of(docs: DataFrame) -> DataFrame:
    """parent_id, ord, title, text of the packed passages of documents (doc_id, text, source)."""
    from quern.operators.chunkers import sentence_children

    out = sentence_children(docs.select("doc_id", "source", "text"), "doc_id", "source")
    return out.select(F.col("doc_id").alias("parent_id"), "ord", F.col("source").alias("title"), "text")


def term_counts(children: DataFrame) -> DataFrame:
    """term, df, dl in one pass: the number of passages that hold a term; the row ALL has the number of passages and the
    sum of their lengths. Tables of disjoint passages add up by term."""
    t = children.select(T.tokenize(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    one = t.select("n", F.explode(F.array_append(F.array_distinct("t"), F.lit(ALL))).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == ALL, F.col("n"))).alias("dl"))


def bm25_stats(children: DataFrame) -> DataFrame:
    """One row: n_children, avgdl, n_terms, n_postings."""
    every, some = F.col("term") == ALL, F.col("term") != ALL
    return term_counts(children).agg(
        F.coalesce(F.max(F.when(every, F.col("df"))), F.lit(0)).alias("n_children"), F.max(F.when(every, F.col("dl") / F.col("df"))).alias("avgdl"),
        F.count_if(some).alias("n_terms"), F.coalesce(F.sum(F.when(some, F.col("df"))), F.lit(0)).alias("n_postings"),
    )


@dataclass
class Index:
    """Passages, their stored postings and the term table, kept as Parquet."""

    passages: DataFrame
    terms: DataFrame
    blocks: DataFrame

    @classmethod
    def build(cls, children: DataFrame, scratch: Scratch, path: str | None = None) -> Index:
        """One pass tokenizes the passages; the term table adds up what the segments hold. With a path (of a folder that isn't
        there) the index is kept where it is built, as save() would leave it."""
        if path:
            children.write.parquet(f"{path}/passages")
            blocks = P.write_segments(P.segments(children.sparkSession.read.schema(children.schema).parquet(f"{path}/passages")), f"{path}/blocks")
            P.counts_of(blocks).write.parquet(f"{path}/terms")
            return cls.load(children.sparkSession, path)
        passages = scratch.write(children)
        blocks = P.write_segments(P.segments(passages), scratch.path())
        return cls(passages, scratch.write(P.counts_of(blocks)), blocks)

    def save(self, path: str) -> None:
        self.passages.write.mode("overwrite").parquet(f"{path}/passages")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.blocks.repartition("segment").sortWithinPartitions("segment", "term", "block").write.mode("overwrite").partitionBy("segment").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/passages"), spark.read.parquet(f"{path}/terms"), P.read_segments(spark, f"{path}/blocks"))

    def replaced(self, new: DataFrame, gone: DataFrame, scratch: Scratch) -> Index:
        """The index without the passages of the parents in `gone` (parent_id) and with the passages `new`. Only `new` is
        tokenized. Segments that hold a passage of these parents are written again from their postings, all others stay
        the files that they are; the term table loses and gains what these segments do."""
        new = scratch.write(new)
        parents = scratch.write(gone.select("parent_id").union(new.select("parent_id")).distinct())
        left, hit = P.without(self.blocks, parents, scratch)
        last = self.blocks.agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0]
        added = P.write_segments(P.segments(new, last + 1), scratch.path())
        changes = P.counts_of(added)
        if hit:
            less = P.counts_of(self.blocks.filter(F.col("segment").isin(hit))).select("term", (-F.col("df")).alias("df"), (-F.col("dl")).alias("dl"))
            changes = changes.unionByName(less).unionByName(P.counts_of(left.filter(F.col("segment").isin(hit))))
        terms = self.terms.unionByName(changes).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).filter("df > 0")
        passages = self.passages.join(parents, "parent_id", "left_anti").select(*new.columns).unionByName(new)
        return Index(scratch.write(passages), scratch.write(terms), left.unionByName(added))

    def weights(self, floor: float | None = IDF_FLOOR) -> DataFrame:
        """term, idf, avgdl: idf = ln(N - df + 0.5) - ln(df + 0.5), a negative one raised to `floor` times the mean of all
        terms (None: kept). The two statistics of the whole corpus are single rows."""
        size = self.terms.filter(F.col("term") == ALL).select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
        out = self.terms.filter(F.col("term") != ALL).select("term", "df").crossJoin(F.broadcast(size))
        out = out.withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
        if floor is not None:
            least = out.agg((F.avg("idf") * floor).alias("least"))
            out = out.crossJoin(F.broadcast(least)).withColumn("idf", F.when(F.col("idf") < 0, F.col("least")).otherwise(F.col("idf")))
        return out.select("term", "idf", "avgdl")


class Best:
    """The k best of the passages that one task has scored, for each question: by rounded score, ties by key. A score that
    is no number comes last."""

    def __init__(self, questions: int, k: int, keys: int):
        self.k, self.scores, self.keys = k, np.empty((questions, 0)), [np.empty((questions, 0), np.int64) for _ in range(keys)]

    def offer(self, scores: np.ndarray, keys: list[np.ndarray]) -> None:
        """scores: questions x passages, the passages in ascending order of their keys. Once k are held, only what can enter
        is looked at."""
        if scores.shape[1] > OFFERED and not self._few(scores, keys):
            for a in range(0, scores.shape[1], OFFERED):
                self.offer(scores[:, a : a + OFFERED], [x[a : a + OFFERED] for x in keys])
        elif scores.shape[1] <= OFFERED and not self._few(scores, keys):
            self._all(scores, keys)

    def _few(self, scores: np.ndarray, keys: list[np.ndarray]) -> bool:
        """Takes what reaches the k-th score; False if nothing was done, as that is too much or fewer than k are held."""
        if self.scores.shape[1] < self.k or not self.scores.size or not np.isfinite(self.scores[:, -1]).all():
            return False
        rows, cols = np.nonzero(scores >= np.round(self.scores[:, -1:], 9) - 1e-9)  # nothing that rounds to it is left out
        if len(rows) * 8 > scores.size:
            return False
        if len(rows):
            n = len(self.scores)
            q, s = np.append(np.repeat(np.arange(n), self.k), rows), np.append(self.scores.ravel(), scores[rows, cols])
            ks = [np.append(old.ravel(), k[cols]) for old, k in zip(self.keys, keys, strict=True)]
            order = np.lexsort((*ks[::-1], -np.round(s, 9), q))
            take = order[np.searchsorted(q[order], np.arange(n))[:, None] + np.arange(self.k)]
            self.scores, self.keys = s[take], [k[take] for k in ks]
        return True

    def _all(self, scores: np.ndarray, keys: list[np.ndarray]) -> None:
        scores = np.where(np.isnan(scores), -np.inf, scores)
        r, n = np.round(scores, 9), scores.shape[1]
        cols = np.broadcast_to(np.arange(n), scores.shape)
        if n > self.k:
            last = np.partition(r, n - self.k, axis=1)[:, n - self.k, None]
            level = r == last  # of those that tie for the last place the first ones win
            spare = self.k - (r > last).sum(axis=1, keepdims=True)
            cols = np.nonzero((r > last) | level & (np.cumsum(level, axis=1) <= spare))[1].reshape(len(r), self.k)
        s = np.hstack([self.scores, np.take_along_axis(scores, cols, 1)])
        ks = [np.hstack([old, k[cols]]) for old, k in zip(self.keys, keys, strict=True)]
        order = np.lexsort((*ks[::-1], -np.round(s, 9)), axis=1)[:, : self.k]
        self.scores, self.keys = np.take_along_axis(s, order, 1), [np.take_along_axis(k, order, 1) for k in ks]


def scan(passages: DataFrame, value: str, ids: np.ndarray, scorer: Callable[[list | pa.Array], np.ndarray], k: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """question_id, `key`, score: each task's k best passages of each question. scorer: from values of some passages to
    their scores (questions x passages); it gets as many at once as SCORE_CELLS allows."""
    step, types = max(1, SCORE_CELLS // max(1, len(ids))), {f.name: f.dataType.simpleString() for f in passages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k, len(key))
        for batch in batches if len(ids) else ():
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                keys = [part.column(j).to_numpy().astype(np.int64) for j in range(len(key))]
                order = np.lexsort(keys[::-1])
                best.offer(scorer(part.column(len(key)))[:, order], [x[order] for x in keys])
            give_back()
        n = best.scores.shape[1]
        if n:
            cols = [pa.array(np.repeat(ids, n)), *(pa.array(x.ravel()) for x in best.keys), pa.array(best.scores.ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=["question_id", *key, "score"])

    found = passages.filter(F.col(value).isNotNull()).select(*key, value).mapInArrow(run, ", ".join(["question_id long", *(f"{c} long" for c in key), "score double"]))
    return found.select("question_id", *(F.col(c).cast(types[c]).alias(c) for c in key), "score")


def blocks_of(questions: DataFrame, size: Column) -> Iterator[pa.Table]:
    """Rows of questions in blocks of at most about QUERY_BLOCK_BYTES."""
    total = questions.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    n = total // QUERY_BLOCK_BYTES + 1
    for block in range(n):
        yield (questions if n == 1 else questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(n)) == block)).toArrow()


def bm25_topk(index: Index, questions: DataFrame, k: int = BM25_FETCH, floor: float | None = IDF_FLOOR) -> DataFrame:
    """question_id, rank (from 0), parent_id, ord, score (6 places): the k best passages of each question. A repeated
    question term counts again; unknown terms count 0; ties, and passages that match nothing, come in order of their keys.
    Questions without id or text are left out.

    The stored postings of the asked terms are searched, once, as hits are written down before they are read three times; no
    passage is tokenized. If a weight isn't positive, which only
    `floor=None` or a corpus of few passages allows, bounds don't hold and the passages are scanned instead."""
    spark, weights, out = questions.sparkSession, index.weights(floor), None
    asked_rows = questions.filter("question_id IS NOT NULL AND question IS NOT NULL").select("question_id", "question")
    for block in blocks_of(asked_rows, F.octet_length("question") * 2):
        ids, find = block.column(0).to_numpy().astype(np.int64), re.compile(T.TOKEN).findall
        asked = [find(t.lower()) for t in block.column(1).to_pylist()]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for ts in asked for t in ts))}
        names = spark.createDataFrame(pa.table({"term": pa.array(list(vocabulary), pa.string())}))
        known = weights.join(F.broadcast(names), "term", "left_semi").toArrow().to_pydict()
        idf, avgdl = dict(zip(known["term"], known["idf"], strict=True)), (known["avgdl"] or [1.0])[0]
        if all(x > 0 for x in idf.values()):
            terms = {q: [(t, n * idf[t] * (K1 + 1)) for t, n in Counter(ts).items() if t in idf] for q, ts in zip(ids.tolist(), asked, strict=True)}
            found = filled(Scratch(spark).write(P.search(index.blocks, terms, avgdl, k)), index.blocks, ids.tolist(), k)
        else:
            found = scan(index.passages, "text", ids, _bm25(asked, vocabulary, idf, avgdl), k)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def filled(hits: DataFrame, blocks: DataFrame, ids: list[int], k: int) -> DataFrame:
    """Hits (a table that has been written) with the first passages by key of the segments added, of score 0, where they are
    no hits already: what fills up questions that fewer than k passages match. k + k rows a question are enough, whatever
    the corpus."""
    keys = blocks.filter(F.col("term") == ALL).select(F.inline(F.arrays_zip(F.col("parents").alias("parent_id"), F.col("ords").alias("ord"))))
    first = [tuple(r) for r in keys.filter("parent_id IS NOT NULL").orderBy(*KEY).limit(2 * k).collect()]
    few = hits.groupBy("question_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    spark = hits.sparkSession
    lacking = spark.createDataFrame(pa.table({"question_id": pa.array(ids, pa.int64())})).join(few, "question_id", "left_anti")
    keys = F.array(*(F.struct(F.lit(p).cast("long").alias("parent_id"), F.lit(o).cast("int").alias("ord")) for p, o in first)).cast("array<struct<parent_id:bigint,ord:int>>")
    zero = lacking.select("question_id", F.inline(keys)).join(hits, ["question_id", *KEY], "left_anti").withColumn("score", F.lit(0.0))
    return hits.unionByName(zero)


def _bm25(asked: list[list[str]], vocabulary: dict[str, int], idf: dict[str, float], avgdl: float) -> Callable[[pa.Array], np.ndarray]:
    """Texts to scores of all questions."""
    pairs = np.array([(vocabulary[t], q) for q, ts in enumerate(asked) for t in ts if t in idf], np.int64).reshape(-1, 2)
    pairs, qf = np.unique(pairs, axis=0, return_counts=True)
    values = np.zeros(len(vocabulary))
    values[[vocabulary[t] for t in idf]] = list(idf.values())
    weight = qf * values[pairs[:, 0]] * (K1 + 1)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
    of = {t: i for t, i in vocabulary.items() if t in idf}

    def score(texts: pa.Array) -> np.ndarray:
        find, rows, terms, dl = re.compile(T.TOKEN).findall, [], [], np.zeros(len(texts))
        for i, t in enumerate(texts.to_pylist()):
            tokens = find(t.lower())
            dl[i] = len(tokens)
            hit = [of[x] for x in tokens if x in of]
            terms += hit
            rows += [i] * len(hit)
        out = np.zeros((len(asked), len(texts)))
        both, tf = np.unique(np.array(terms, np.int64) * len(texts) + np.array(rows, np.int64), return_counts=True)
        term, row = np.divmod(both, max(1, len(texts)))
        part = tf / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        ends = np.flatnonzero(np.diff(term, append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ():
            w = slice(starts[term[a]], starts[term[a] + 1])
            out[np.ix_(pairs[w, 1], row[a:b])] += weight[w, None] * part[a:b]
        return out

    return score


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each question_id, best first; Spark cuts each partition to k before the shuffle."""
    key = [c for c in scored.columns if c not in ("question_id", "score")]
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), *key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("question_id", (F.col("rank") - 1).cast("int").alias("rank"), *key, F.round("score", 6).alias("score"))


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose `on` is in `keys`, a table that has been written: by broadcast while they are few, else by a shuffle."""
    small = keys.select(*on).distinct()
    return rows.join(F.broadcast(small) if keys.count() <= BROADCAST_KEYS else small, on, "left_semi")


def with_passages(hits: DataFrame, passages: DataFrame, scratch: Scratch) -> DataFrame:
    """question_id, rank, parent_id, title, text of hits (question_id, rank, parent_id, ord)."""
    hits = scratch.write(hits)
    return hits.join(narrowed(passages, hits, list(KEY)), list(KEY)).select("question_id", "rank", "parent_id", "title", "text")


class Embedder(Protocol):
    """Text to vectors; a batch at a time, on the executors."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Places(dict):
    """Token to twice its place, and one more where it takes away."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        h = md5(token.encode()).hexdigest()
        code = int(h[:8], 16) % self.dim * 2 + (h[8] >= "8")
        if len(self) < KNOWN_TOKENS:
            self[token] = code
        return code


class HashingEmbedder:
    """Deterministic default: each token adds one to, or takes one from, a place told by its md5."""

    dim = 64

    def __call__(self, texts: list[str]) -> np.ndarray:
        find, out = re.compile(T.TOKEN).findall, np.zeros((len(texts), self.dim))
        place = self.__dict__.setdefault("places", Places(self.dim)).__getitem__
        for at in range(0, len(texts), TEXTS):
            codes, sizes = array("i"), []
            for t in texts[at : at + TEXTS]:
                tokens = find((t or "").lower())
                sizes.append(len(tokens))
                codes.extend(map(place, tokens))
            codes = np.array(codes, np.int64)
            cells = np.repeat(np.arange(len(sizes)) * self.dim, sizes) + codes // 2
            out[at : at + TEXTS] = np.bincount(cells, 1 - 2 * (codes % 2), minlength=len(sizes) * self.dim).reshape(-1, self.dim)
        return out

    def __getstate__(self) -> dict:
        return {}


def embed(rows: DataFrame, key: tuple[str, ...], text_col: str, embedder: Embedder | None = None) -> DataFrame:
    """(`key`, embedding array<double>)."""
    embedder, n = embedder or HashingEmbedder(), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = embedder(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list(v), pa.list_(pa.float64()))], names=[*key, "embedding"])

    out = rows.select(*key, text_col)
    return out.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out.schema[:n]), "embedding array<double>"]))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_CHILDREN, key: tuple[str, ...] = KEY, embedder: Embedder | None = None) -> DataFrame:
    """question_id, rank, `key`, score: exact cosine of queries (question_id, embedding) to vectors (`key`, embedding). A
    vector of norm 0 scores 0; rows without vector are left out. With an embedder, `vectors` are texts (`key`, text) that
    become vectors where they are scored, some at a time: no vector leaves its task, and a task is one Python process."""
    out = None
    if embedder is None:
        value, of = "embedding", lambda v: v.flatten().to_numpy().astype(float).reshape(len(v), -1)
    else:
        value, of = "text", lambda v: embedder(v.to_pylist())
        vectors = vectors.select(*key, F.coalesce("text", F.lit("")).alias("text"))
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for block in blocks_of(queries.filter("question_id IS NOT NULL AND embedding IS NOT NULL").select("question_id", "embedding"), F.size("embedding") * 8):
        ids, flat = block.column(0).to_numpy().astype(np.int64), block.column(1).combine_chunks().flatten().to_numpy().astype(float)
        q = unit(flat.reshape(len(ids), -1)) if len(ids) else flat.reshape(0, 1)
        found = scan(vectors, value, ids, lambda v, q=q: q @ unit(of(v)).T, k, key)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, n: int = TOP_CHILDREN, dedup: bool = False) -> DataFrame:
    """question_id, rank, key, parent_id, title, text, score: reciprocal-rank fusion of two hit lists (question_id, rank,
    parent_id, title, text) by the first 120 characters. Equal keys of one list add up (dedup: only the best counts); a
    key's payload is its last dense hit, else its first sparse one; ties in order of first appearance, dense first."""
    hits = dense.withColumn("list", F.lit(0)).unionByName(sparse.withColumn("list", F.lit(1))).withColumn("key", F.left("text", F.lit(120)))
    if dedup:
        best = Window.partitionBy("question_id", "key", "list").orderBy("rank")
        hits = hits.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
    hit = F.struct("parent_id", "title", "text")
    keyed = hits.groupBy("question_id", "key").agg(
        F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"),
        F.coalesce(F.max_by(hit, F.when(F.col("list") == 0, F.col("rank"))), F.min_by(hit, F.when(F.col("list") == 1, F.col("rank")))).alias("hit"),
        F.min(F.col("list") * 1_000_000 + F.col("rank")).alias("first"),
    )
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "first")
    return keyed.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).filter(F.col("rank") < n).select("question_id", "rank", "key", "hit.parent_id", "hit.title", "hit.text", F.round("score", 6).alias("score"))


def expand_parents(fused: DataFrame, parents: DataFrame, n: int = TOP_PARENTS, scratch: Scratch | None = None) -> DataFrame:
    """question_id, ord, parent_id, section_title, full_text (6000 characters), child_matched, score: the first hit of
    each parent, n parents a question. A parent that is missing gives its id as title and the child as text. The hits are
    written down first, so that only the parents they name are read out of the corpus."""
    first = Window.partitionBy("question_id", "parent_id").orderBy("rank")
    again = Window.partitionBy("question_id").orderBy("rank")
    hits = fused.withColumn("nth", F.row_number().over(first)).filter("nth = 1").withColumn("place", F.row_number().over(again)).filter(F.col("place") <= n)
    hits = (scratch or Scratch(fused.sparkSession)).write(hits)
    p = narrowed(parents, hits, ["parent_id"]).select(F.col("parent_id").alias("pid"), F.col("title").alias("parent_title"), F.col("text").alias("parent_text"))
    return hits.join(p, F.col("parent_id") == F.col("pid"), "left").select(
        "question_id", (F.col("place") - 1).cast("int").alias("ord"), "parent_id", F.coalesce("parent_title", F.col("parent_id").cast("string")).alias("section_title"),
        F.left(F.coalesce("parent_text", "text"), F.lit(MAX_PARENT_CHARS)).alias("full_text"), F.col("text").alias("child_matched"), "score",
    )


def prompts(questions: DataFrame, contexts: DataFrame, system: str = SYSTEM) -> DataFrame:
    """question_id, n_parents, user_content, prompt_tokens: the token budget is split evenly, 200 characters a parent at
    least. Questions without parents get an empty context."""
    n = F.greatest(F.coalesce("n_parents", F.lit(0)), F.lit(1))
    by = contexts.groupBy("question_id").agg(F.count("*").cast("int").alias("n_parents"), F.array_sort(F.collect_list(F.struct("ord", "section_title", "child_matched", "full_text"))).alias("c"))
    fixed = T.tokens_by_chars(F.lit(system)) + T.tokens_by_chars(F.col("question")) + OVERHEAD_TOKENS
    chars = F.greatest(F.lit(200), F.floor((MAX_INPUT_TOKENS - fixed) / n).cast("int") * 4)
    part = lambda x: F.concat(F.lit("[Source: "), x["section_title"], F.lit(' | child_match: "'), F.left(x["child_matched"], F.lit(80)), F.lit('..."]\n\n'), F.left(x["full_text"], F.col("chars")))
    out = questions.join(by, "question_id", "left").withColumn("chars", chars)
    block = F.coalesce(F.array_join(F.transform("c", part), "\n\n---\n\n"), F.lit(""))
    out = out.withColumn("user_content", F.concat(F.lit("CONTEXT:\n"), block, F.lit("\n\nQUESTION: "), "question"))
    return out.select("question_id", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), "user_content", (T.tokens_by_chars(F.lit(system)) + T.tokens_by_chars(F.col("user_content"))).alias("prompt_tokens"))


def output_allowance(prompt_tokens: Column, limit: int = 7800, least: int = 256) -> Column:
    """What a call may still answer with: the limit less the prompt, `least` at least."""
    return F.greatest(F.lit(least), F.lit(limit) - prompt_tokens)


class QueryExpander(Protocol):
    """Questions to the texts that the dense side searches with, a batch at a time; the sparse side always takes the questions."""

    def __call__(self, questions: list[str]) -> list[str]: ...


def expanded(questions: DataFrame, expander: QueryExpander) -> DataFrame:
    """question_id, question: what the expander makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expander(batch.column(1).to_pylist()), pa.string())], names=["question_id", "question"])

    return questions.select("question_id", "question").mapInArrow(run, "question_id long, question string")


def both_lists(index: Index, questions: DataFrame, scratch: Scratch, embedder: Embedder | None = None, expander: QueryExpander | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits with their passages: of the cosine search with the expanded questions, and of BM25 with the questions."""
    asked = expanded(questions, expander) if expander else questions
    embedder = embedder or HashingEmbedder()
    dense = cosine_topk(index.passages, embed(asked, ("question_id",), "question", embedder), embedder=embedder)
    return with_passages(dense, index.passages, scratch), with_passages(bm25_topk(index, questions), index.passages, scratch)


def retrieve(index: Index, docs: DataFrame, questions: DataFrame, scratch: Scratch, embedder: Embedder | None = None, expander: QueryExpander | None = None, *, top_parents: int = TOP_PARENTS) -> DataFrame:
    """Questions (question_id, question) over documents (doc_id, source, text) and their index to contexts; see
    expand_parents."""
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("source").alias("title"), "text")
    return expand_parents(fuse(*both_lists(index, questions, scratch, embedder, expander)), parents, top_parents, scratch)


def upsert_vectors(store: DataFrame | None, passages: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """A store of vectors (parent_id, ord, embedding) after the passages: all vectors of a parent that they hold are replaced."""
    new = embed(passages, KEY, "text", embedder)
    return new if store is None else incremental.upsert(store, new, "parent_id")
