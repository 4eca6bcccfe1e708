"""Stored postings: immutable segments of an inverted index, and top-k search that skips blocks by their bounds.

A segment holds some thousand passages: one row with their keys and lengths, and for each term its postings in blocks of 128,
each with the highest term frequency and the shortest passage, from which a bound of its scores follows for any state of the
corpus. A segment is one file of one row group, sorted by term, so that one task reads it whole and pages of other terms are
left out. Search reads the blocks of its terms only; no text is tokenized again.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.memory import give_back
from quern.sources.scratch import Scratch

K1, B = 1.5, 0.75
#: Passages of a segment, and postings of a block.
SEGMENT_PASSAGES, BLOCK = 16_384, 128
#: Tokens at which a segment is full, too, and passages that are added to it at once.
SEGMENT_TOKENS, STEP = 1 << 21, 64
#: Segments whose marks of passages that are gone (2 KB each) are broadcast; those of more are joined by a shuffle.
BROADCAST_SEGMENTS = 32_768
#: Segments that one task can number.
TASK_SEGMENTS = 1 << 20
#: The row of a segment that holds its passages; no token is empty.
ALL = ""
#: Terms up to this number are a filter that reaches the files; more are a broadcast join.
PUSHED_TERMS = 500
#: The k-th score is looked at after so many terms of a question, and before a term in more than one of LONG passages.
LOOK, LONG = 6, 8
#: Scores are compared after rounding to nine places.
SLACK = 2e-9
SCHEMA = "segment long, term string, block int, n int, docs array<int>, tfs array<int>, max_tf int, min_dl int, parents array<long>, ords array<int>, dls array<int>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema(
    [("segment", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("max_tf", pa.int32()), ("min_dl", pa.int32())]
    + [("parents", pa.list_(pa.int64())), ("ords", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32()))]
)


class Filling:
    """A segment as its passages come: their terms by number, so that no text is held."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[str, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parents, self.ords, self.dls, self.terms = array("q"), array("i"), array("i"), array("i")

    def add(self, parents: list[int], ords: list[int], texts: list[str]) -> None:
        find, number = re.compile(T.TOKEN).findall, self.vocabulary.__getitem__
        self.parents.extend(parents)
        self.ords.extend(ords)
        for text in texts:
            tokens = find(text.lower())
            self.dls.append(len(tokens))
            self.terms.extend(map(number, tokens))


def segment_rows(segment: int, parents: np.ndarray, ords: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    """The rows of one segment."""
    held = Filling()
    held.add(parents.tolist(), ords.tolist(), texts)
    return rows_of(segment, held)


def rows_of(segment: int, held: Filling) -> pa.RecordBatch:
    """The rows of one segment; its passages are numbered in the order of their keys."""
    parents, ords, dls, vocabulary = np.array(held.parents, np.int64), np.array(held.ords, np.int64), np.array(held.dls, np.int64), held.vocabulary
    order = np.lexsort((ords, parents))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    vocabulary.default_factory = None  # it holds the table that holds it
    names = sorted(vocabulary)
    place = np.empty(len(names), np.int64)
    place[[vocabulary[t] for t in names]] = np.arange(len(names))
    both = place[np.array(held.terms, np.int32)]  # one array of the postings' size, changed in place
    both *= len(order)
    both += np.repeat(number, dls)
    both.sort()
    runs = np.flatnonzero(np.diff(both, prepend=-1))
    both, tf = both[runs], np.diff(runs, append=len(both))
    term, doc = np.divmod(both, max(1, len(order)))
    parents, ords, dls = parents[order], ords[order], dls[order]
    first = np.searchsorted(term, np.arange(len(names)))
    block = (np.arange(len(term)) - first[term]) // BLOCK
    starts = np.flatnonzero(np.diff(term, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool))
    size, n = np.diff(starts, append=len(term)), len(starts)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(np.append(0, starts), len(term)).astype(np.int32)), pa.array(x.astype(np.int32)))
    reduced = lambda f, x: np.append(0, f.reduceat(x, starts) if n else []).astype(np.int32)
    one = lambda x, kind: pa.concat_arrays([pa.array([x], pa.list_(kind)), pa.nulls(n, pa.list_(kind))])
    cols = [
        pa.array(np.full(n + 1, segment)), pa.array([ALL, *(names[i] for i in term[starts].tolist())], pa.string()), pa.array(np.append(0, block[starts]).astype(np.int32)), pa.array(np.append(len(order), size).astype(np.int32)),
        lists(doc), lists(tf), pa.array(reduced(np.maximum, tf)), pa.array(reduced(np.minimum, dls[doc])), one(parents, pa.int64()), one(ords, pa.int32()), one(dls, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(cols, schema=ARROW)


def segments(passages: DataFrame, first: int = 0, size: int = SEGMENT_PASSAGES) -> DataFrame:
    """SCHEMA of passages (parent_id, ord, text; without null): each task cuts what it reads into segments, numbered from
    `first` on. A segment is full at `size` passages or at SEGMENT_TOKENS tokens, whatever comes first, so that a task holds
    as much for wide passages as for many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = Filling(), first + TaskContext.get().partitionId() * TASK_SEGMENTS
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                held.add(*(part.column(j).to_pylist() for j in range(3)))
                whole = (at + STEP) % 1024 == 0 or at + STEP >= batch.num_rows
                if whole and len(held.dls) + 1024 > size or len(held.terms) >= SEGMENT_TOKENS:
                    yield rows_of(number, held)
                    held, number = Filling(), number + 1
                    give_back()
        if held.dls:
            yield rows_of(number, held)
            held = None
            give_back()

    return passages.filter("text IS NOT NULL AND parent_id IS NOT NULL").select(F.col("parent_id").cast("long"), F.col("ord").cast("int"), "text").mapInArrow(run, SCHEMA)


def write_segments(rows: DataFrame, path: str) -> DataFrame:
    """A file for each segment, its rows by term. Rows of a segment come from one task."""
    rows.sortWithinPartitions("segment", "term", "block").write.partitionBy("segment").mode("append").parquet(path)
    return read_segments(rows.sparkSession, path)


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(NAMES)


def counts_of(blocks: DataFrame) -> DataFrame:
    """term, df, dl of segments: passages that hold a term; the row ALL has the number of passages and their lengths."""
    length = F.aggregate(F.coalesce("dls", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.when(F.col("term") == ALL, length)).alias("dl")).filter("df > 0")


def without(blocks: DataFrame, parents: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """Segments after their passages of `parents` (parent_id) are gone: those without any are kept as they are; the others
    are written again, in the same numbers of passages, and are also given by number. A passage that is gone keeps its number
    with length 0 and no key, and its postings are left out; bounds of blocks stay bounds."""
    keys = blocks.filter(F.col("term") == ALL).select("segment", F.posexplode("parents").alias("doc", "parent_id"))
    bit = F.when(F.col("gone"), F.expr("shiftleft(1L, doc & 63)")).otherwise(F.lit(0).cast("long"))
    words = keys.join(parents.select("parent_id").distinct().withColumn("gone", F.lit(True)), "parent_id", "left").groupBy("segment", F.shiftright("doc", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    by = words.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select("segment", F.col("w.bits").alias("gone"))
    dead = scratch.write(by.filter(F.exists("gone", lambda x: x != 0)))
    hit = [r[0] for r in dead.select("segment").collect()]  # a number for each segment that changes
    if not hit:
        return blocks, []
    few = len(hit) <= BROADCAST_SEGMENTS  # then a task writes the segments that it reads
    some = blocks.filter(F.col("segment").isin(hit)).join(F.broadcast(dead) if few else dead, "segment")
    stays = lambda doc: F.getbit(F.get("gone", F.shiftright(doc, 6)), doc.bitwiseAND(F.lit(63))) == 0
    alive = lambda c, other: F.transform(c, lambda x, i: F.when(stays(i), x).otherwise(other)).alias(c)
    fewer = F.col("n") - F.aggregate("gone", F.lit(0), lambda acc, x: acc + F.bit_count(x))
    left = some.withColumn("e", F.filter(F.arrays_zip("docs", "tfs"), lambda e: stays(e["docs"]))).filter((F.col("term") == ALL) | (F.size("e") > 0))
    rows = left.select(
        "segment", "term", "block", F.when(F.col("term") == ALL, fewer).otherwise(F.size("e")).alias("n"), F.col("e.docs").alias("docs"), F.col("e.tfs").alias("tfs"), "max_tf", "min_dl",
        alive("parents", F.lit(None).cast("bigint")), "ords", alive("dls", F.lit(0)),
    )
    return blocks.filter(~F.col("segment").isin(hit)).unionByName(write_segments(rows if few else rows.repartition("segment"), scratch.path())), hit


class Term:
    """A term's blocks in one segment: (docs, tfs, bound)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.all: tuple[np.ndarray, np.ndarray] | None = None
        self.edges: tuple[np.ndarray, np.ndarray] | None = None

    def outline(self) -> tuple[np.ndarray, np.ndarray]:
        """First passages and bounds of the blocks."""
        if self.edges is None:
            self.edges = np.array([b[0][0] for b in self.blocks]), np.array([b[2] for b in self.blocks])
        return self.edges

    def whole(self, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            docs, tfs = (np.concatenate([b[k] for b in self.blocks]) for k in (0, 1))
            self.all = docs, tfs / (tfs + norm[docs])
        return self.all


class Segment:
    """One segment's blocks of the asked terms, for search. read and skipped count blocks."""

    def __init__(self, avgdl: float):
        self.avgdl, self.terms, self.read, self.skipped = avgdl, {}, 0, 0

    def add(self, rows: pa.RecordBatch) -> None:
        col = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
        flat, edges = {n: col[n].flatten().to_numpy(zero_copy_only=False) for n in ("docs", "tfs")}, {n: np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(col[n]), 0).to_numpy(zero_copy_only=False))) for n in ("docs", "tfs")}
        most, least = (col[n].to_numpy(zero_copy_only=False) for n in ("max_tf", "min_dl"))
        bounds = most / np.maximum(most + K1 * (1 - B + B * least / self.avgdl), 1e-300)
        for i, term in enumerate(col["term"].to_pylist()):
            if term == ALL:
                self.parents, self.ords = col["parents"][i].values.to_numpy(zero_copy_only=False), col["ords"][i].values.to_numpy(zero_copy_only=False)
                self.norm = K1 * (1 - B + B * col["dls"][i].values.to_numpy(zero_copy_only=False) / self.avgdl)
            else:
                a, b = edges["docs"][i], edges["docs"][i + 1]
                self.terms.setdefault(term, Term()).blocks.append((flat["docs"][a:b], flat["tfs"][a:b], float(bounds[i])))

    def best(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage numbers, scores) of the k best passages that hold an asked term, or somewhat more, for positive weights
        (term, weight): term by term from the highest bound down. Once what is to come can't lift a new passage over the
        k-th score so far, only passages that can still pass it are followed, and only blocks that hold one and whose own
        bound suffices are read."""
        lists = sorted(((w * max(b[2] for b in t.blocks), term, w, t) for term, w in asked if (t := self.terms.get(term))), key=lambda x: (-x[0], x[1]))
        if not lists:
            return np.empty(0, np.int64), np.empty(0)
        ahead = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0.0)
        scores, kth, j = np.zeros(len(self.norm)), 0.0, 0
        while j < len(lists):
            _, _, w, t = lists[j]
            if j and len(scores) > k and (j % LOOK == 0 or LONG * len(t.blocks) * BLOCK > len(scores)):
                kth = max(kth, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if ahead[j] < kth - SLACK:
                break
            docs, part = t.whole(self.norm)
            scores[docs] += w * part
            self.read += len(t.blocks)
            j += 1
        docs = np.flatnonzero(scores > 0)
        for j in range(j, len(lists)):
            docs = docs[scores[docs] + ahead[j] >= kth - SLACK]
            _, _, w, t = lists[j]
            firsts, bounds = t.outline()
            at = np.searchsorted(firsts, docs, "right") - 1
            could = (at >= 0) & (scores[docs] + w * bounds[at] + ahead[j + 1] >= kth - SLACK)
            chosen, at = docs[could], at[could]  # both in ascending order, so that a block's passages lie together
            cuts = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(at)]
            self.read, self.skipped = self.read + len(cuts) - 1, self.skipped + len(t.blocks) - len(cuts) + 1
            for a, b in zip(cuts, cuts[1:], strict=False):
                block, tfs, _ = t.blocks[at[a]]
                mine = chosen[a:b]
                place = np.minimum(np.searchsorted(block, mine), len(block) - 1)
                there = block[place] == mine
                mine, tf = mine[there], tfs[place[there]]
                scores[mine] += w * (tf / (tf + self.norm[mine]))
        s = scores[docs]
        if len(docs) > k:
            keep = np.round(s, 9) >= np.round(np.partition(s, len(s) - k)[len(s) - k], 9)
            docs, s = docs[keep], s[keep]
        return docs, s


def search(blocks: DataFrame, asked: dict[int, list[tuple[str, float]]], avgdl: float, k: int) -> DataFrame:
    """question_id, parent_id, ord, score: of each segment, each question's k best passages of positive score. asked: by
    question, its known terms and their weights, all positive. Each task reads whole segments; nothing is shuffled."""
    types, names = "question_id long, parent_id long, ord int, score double", sorted({t for ts in asked.values() for t, _ in ts})
    if not asked:
        return blocks.sparkSession.createDataFrame([], types)
    if len(names) <= PUSHED_TERMS:
        wanted = blocks.filter(F.col("term").isin([ALL, *names]))
    else:
        wanted = blocks.join(F.broadcast(blocks.sparkSession.createDataFrame(pa.table({"term": pa.array([ALL, *names])}))), "term", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Segment(avgdl)
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                if at is not None and number[a] != at:
                    yield found(held)
                    held = Segment(avgdl)
                    give_back()
                at = int(number[a])
                held.add(batch.slice(a, b - a))
        if at is not None:
            yield found(held)
            held = None
            give_back()

    def found(held: Segment) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for question, terms in asked.items():
            docs, scores = held.best(terms, k)
            order = np.lexsort((docs, -np.round(scores, 9)))[:k]
            for c, x in zip(out, (np.full(len(order), question), held.parents[docs[order]].astype(np.int64), held.ords[docs[order]], scores[order]), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["question_id", "parent_id", "ord", "score"])

    return wanted.select(NAMES).mapInArrow(run, types)
