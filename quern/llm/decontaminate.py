"""Benchmark decontamination over a distributed positional inverted index.

The documents are indexed once, all their words, in segments (blocks of documents), each a row of postings: term, told by
a 64-bit hash, and its word positions. The index knows nothing of a benchmark and answers any number of them. A benchmark
window is answered segment by segment: its rarest term's positions, shifted to the window's start, are intersected with
the shifted positions of the next rarest, until none or all terms have agreed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, table

WINDOW = 13
#: Bytes of text that a segment holds at most, but for a longer single document.
SEGMENT_BYTES = 8 << 20
#: Bytes of benchmark text sent to the executors at once, but for a longer single item: a number a word, and a hash for each
#: distinct one. More items are searched block after block, over the same index.
BLOCK_BYTES = 16 << 20
#: Bytes that stand in no word: all ASCII but digits and letters, once A-Z are lower-cased.
GAPS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def index_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(GAPS).split()


class TermHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


@dataclass
class Windows:
    """Benchmark items as words; a window is `width` words in turn, or a whole shorter item."""

    terms: np.ndarray  # hashes of the distinct words
    words: np.ndarray  # places in terms, item after item
    ends: np.ndarray  # of items in words
    item_ids: list[str | None]
    width: int

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and item of every window."""
        begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        number = np.maximum(self.ends - begins - self.width, 0) + 1 if len(self.ends) else begins[:0]
        item = np.repeat(np.arange(len(number)), number)
        start = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number) + begins[item]
        return start, np.minimum(start + self.width, self.ends[item]), item


def benchmark_windows(rows: list[tuple[str | None, bytes | None]], width: int) -> Windows:
    """The items that have words."""
    place, words, ends, ids = {}, [], [], []
    for item_id, text in rows:
        w = index_words(text)
        if w:
            words.append(np.fromiter((place.setdefault(x, len(place)) for x in w), np.int32, len(w)))
            ends.append(len(w))
            ids.append(item_id)
    terms = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
    return Windows(terms, np.concatenate([*words, np.empty(0, np.int32)]), np.cumsum(np.array(ends, np.int64)), ids, width)


SEGMENT = "doc_ids array<long>, hashes array<long>, lens array<int>, terms binary, counts binary, gaps binary"
SEGMENT_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of postings of all words of docs (doc_id, text). Positions count the words of the segment's documents one
    after another with one place left free between documents, so no phrase spans two. A term's positions are kept as gaps,
    terms in order of their hashes."""
    known = TermHashes()

    def segment(ids: list, texts: list) -> pa.RecordBatch:
        parts, lens, places, begin = [], [], [], 0
        hashes = [xxhash.xxh3_64_intdigest(t or b"") - (1 << 63) for t in texts]
        for t in texts:
            w = index_words(t)
            parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            places.append(np.arange(begin, begin + len(w), dtype=np.int32))
            lens.append(len(w))
            begin += len(w) + 1
        at = np.concatenate(parts)
        order = np.argsort(at, kind="stable")
        at, pos = at[order], np.concatenate(places)[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else order
        found, counts, gaps = at[first], np.diff(first, append=len(at)).astype(np.int32), np.diff(pos, prepend=np.int32(0)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([hashes], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (found, counts, gaps))],
            schema=SEGMENT_ARROW,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                t = t.as_py()
                if ids and held + len(t or b"") > SEGMENT_BYTES:
                    yield segment(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t or b"")
        if ids:
            yield segment(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, SEGMENT)


class Postings:
    """One segment, ready to be searched for the words of some windows."""

    def __init__(self, row: dict, terms: np.ndarray):
        own = np.frombuffer(row["terms"], np.uint64)
        k = np.minimum(np.searchsorted(own, terms), max(0, len(own) - 1))
        self.there = own[k] == terms if len(own) else np.zeros(len(terms), bool)
        self.at = k
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int32), dtype=np.int64)])
        self.pos = np.cumsum(np.frombuffer(row["gaps"], np.int32), dtype=np.int32)

    def of(self, term: int) -> np.ndarray:
        k = self.at[term]
        return self.pos[self.ends[k] : self.ends[k + 1]] if self.there[term] else self.pos[:0]

    def alive(self, w: Windows, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Windows of which the segment holds all words."""
        missing = np.concatenate([[0], np.cumsum(~self.there[w.words])])
        return np.flatnonzero(missing[end] == missing[start])

    def find(self, window: np.ndarray, slop: int = 0) -> np.ndarray:
        """Starts of the window. slop: how far each other term may stand from its place beside the rarest one."""
        lists = [self.of(t) for t in window.tolist()]
        order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
        starts = lists[order[0]] - order[0]
        for j in order[1:]:
            p = lists[j]
            if not len(starts) or not len(p):
                return p[:0]
            k = np.minimum(np.searchsorted(p, starts + (j - slop)), len(p) - 1)
            starts = starts[np.abs(p[k] - (starts + j)) <= slop]
        return starts


def search(index: DataFrame, windows) -> DataFrame:
    """For every indexed document: doc_id, hash (of its text), n_words, n_hit (words inside any occurrence of a window), items (sorted
    ids whose windows occur, then a null if an unnamed item's does) and edges (where runs of hit words begin and end, in turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(**windows.value)  # a broadcast holds plain values only
        first, last, item = w.spans()
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], np.int64)
                begin = np.concatenate([[0], np.cumsum(lens + 1)])
                p = Postings(row, w.terms)
                edge, pairs = np.zeros(begin[-1] + 1, np.int32), set()
                for k in p.alive(w, first, last).tolist():
                    starts = p.find(w.words[first[k] : last[k]])
                    if len(starts):
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + (last[k] - first[k]), -1)
                        pairs.update((d, item[k]) for d in np.unique(np.searchsorted(begin, starts, "right") - 1).tolist())
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
                items = [[] for _ in lens]
                for d, k in pairs:
                    items[d].append(w.item_ids[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["hashes"], pa.int64()), pa.array(lens), pa.array(hit[begin[1:]] - hit[begin[:-1]], pa.int64()), pa.array([sorted(set(x), key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())), pa.array([np.flatnonzero(np.diff(np.cumsum(edge[a:b]) > 0, prepend=False, append=False)).astype(np.int64) if x else [] for x, a, b in zip(items, begin[:-1], begin[1:], strict=True)], pa.list_(pa.int64()))],
                    names=["doc_id", "hash", "n_words", "n_hit", "items", "edges"],
                )

    return index.mapInArrow(run, "doc_id long, hash long, n_words long, n_hit long, items array<string>, edges array<long>")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, slop: int = 3) -> DataFrame:
    """(doc_id, item_id, start): places where all terms of a window stand within `slop` words of their place beside its
    rarest term. start counts words from 0 and may lie up to slop before the first. slop 0: exact phrases."""
    spark = docs.sparkSession
    windows = spark.sparkContext.broadcast(vars(benchmark_windows([(r[0], r[1]) for r in _items(benchmark).collect()], width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(**windows.value)
        first, last, item = w.spans()
        for batch in batches:
            for row in batch.to_pylist():
                begin = np.concatenate([[0], np.cumsum(np.array(row["lens"], np.int64) + 1)])
                p, out = Postings(row, w.terms), set()
                for k in p.alive(w, first, last).tolist():
                    for s in p.find(w.words[first[k] : last[k]], slop).tolist():
                        d = int(np.searchsorted(begin, max(s, 0), "right")) - 1
                        out.add((row["doc_ids"][d], w.item_ids[item[k]], s - int(begin[d])))
                out = sorted(out, key=repr)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "item_id", "start"])

    return build_index(docs).mapInArrow(run, "doc_id long, item_id string, start long")


def _items(benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    return (benchmark if unnamed else benchmark.filter("item_id IS NOT NULL")).select(F.col("item_id").cast("string"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, *, width: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text; others ignored): doc_id, n_words, n_hit, items (sorted array of item_ids
    as strings), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and are clean; items without words have no windows; items without id are
    searched if `unnamed`, and are then one null at the end of items; repeated rows of documents are judged alike, repeated items count once. Empty tables: empty result, or all clean. Benchmark text is
    sent to executors in blocks of BLOCK_BYTES; more blocks mean more passes over the index, merged by document. Documents are
    read once and not shuffled: each task indexes what it reads, and the index is kept in the shared folder.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 2 * size // BLOCK_BYTES + 1  # dealt by hash, blocks come to half of it on the average
    index, found = scratch.write(build_index(docs)), None
    for k in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        w = benchmark_windows([(r[0], r[1]) for r in _items(part, unnamed).collect()], width)
        one = search(index, spark.sparkContext.broadcast(vars(w))).withColumn("block", F.lit(k))
        found = one if found is None else found.unionByName(one)
    if n > 1:  # edges of hit ranges, merged by document: an even edge opens, an odd one closes
        doc = found.groupBy("doc_id", "hash", "n_words").agg(F.count_if(F.col("block") == 0).cast("int").alias("rows"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("edges").alias("edges"))
        sweep = F.array_sort(F.flatten(F.transform("edges", lambda e: F.transform(e, lambda x, i: F.struct(x.alias("at"), F.when(i % 2 == 0, 1).otherwise(-1).alias("d"))))))
        total = F.aggregate(
            sweep,
            F.struct(F.lit(0).alias("open"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.struct((a["open"] + x["d"]).alias("open"), x["at"].alias("last"), (a["n"] + F.when(a["open"] > 0, x["at"] - a["last"]).otherwise(0)).alias("n")),
        )["n"]
        found = doc.select("doc_id", "n_words", total.alias("n_hit"), F.array_sort("items").alias("items"), F.sequence(F.lit(1), "rows").alias("rows")).withColumn("row", F.explode("rows"))
    return found.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents against all items; see contamination."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), Scratch(spark), unnamed=True).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP5_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i : i + 12]) AS n, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n)),
m AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit ON low.doc_id = hit.doc_id LEFT JOIN it ON low.doc_id = it.doc_id
"""
