"""Audit of how sources of one language differ: a byte-level tokenizer, counts as sparse rows, and exact integer divergences.

A table of 256 entries turns the concatenated UTF-8 buffers of a batch into lower-cased term bytes and boundaries; slices are
grouped by xxhash and held against each other byte by byte. A term's counts by source are a sparse row; rows are merged,
kept and compared as compressed sparse matrices, whose parts numpy sums up with reduceat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import Scratch, table

LEAST_DOCUMENTS, TOP_TERMS, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Bytes of text that are tokenized at once.
BATCH_BYTES = 8 << 20
#: Slices up to this length are hashed and compared as 8-byte lanes; longer ones one by one.
LANES = 8
#: Terms of a sparse block.
BLOCK_ROWS = 4096
COUNTS = "lang int, hash long, term binary, documents long, cells binary"
#: The primes of the 64-bit hash.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def byte_table() -> np.ndarray:
    """Byte to term byte: letters and bytes from 0x80 on, A-Z lowered; 0 for what ends a term."""
    t = np.zeros(256, np.uint8)
    t[0x80:] = np.arange(0x80, 0x100)
    for first in (0x41, 0x61):
        t[first : first + 26] = np.arange(0x61, 0x7B)
    return t


BYTES = byte_table()


def slices_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term bytes of a buffer, and starts and lengths of its terms; edges: where texts begin, and the end."""
    low = BYTES[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = low != 0
    before = np.zeros(len(low) + 1, bool)
    before[1:] = inside[:-1]
    before[edges] = False  # a text's first byte follows nothing
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(low) + 1, bool)
    after[:-1] = inside[1:]
    after[edges[1:][edges[1:] > edges[:-1]] - 1] = False  # nothing follows a text's last byte
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends - starts


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def lanes_of(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The slices as 8-byte little-endian numbers, lane by lane, with zeros behind their ends."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(low) + 1,), (1,))  # a number from each byte on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = [words[starts] & masks[np.minimum(lengths, 8)]]
    for k in range(1, -(-int(lengths.max(initial=1)) // 8)):
        longer = np.flatnonzero(lengths > 8 * k)
        out.append(np.zeros(len(starts), np.uint64))
        out[-1][longer] = words[starts[longer] + 8 * k] & masks[np.minimum(lengths[longer] - 8 * k, 8)]
    return out


def xxh64(lanes: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """The 64-bit xxhash, seed 0, of slices shorter than 32 bytes, all at once."""
    with np.errstate(over="ignore"):
        h = P5 + lengths.astype(np.uint64)
        for k, lane in enumerate(lanes[:4]):
            whole = lengths >= 8 * k + 8
            mixed = rotated(h ^ rotated(lane * P2, 31) * P1, 27) * P1 + P4
            h = np.where(whole, mixed, h)
        rest, at = lengths % 8, lengths // 8
        tail = np.choose(np.minimum(at, len(lanes) - 1), lanes) if len(lanes) > 1 else lanes[0].copy()
        half = rest >= 4
        h = np.where(half, rotated(h ^ (tail & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3, h)
        tail = np.where(half, tail >> np.uint64(32), tail)
        rest = np.where(half, rest - 4, rest)
        for j in range(3):
            byte = (tail >> np.uint64(8 * j)) & np.uint64(0xFF)
            h = np.where(rest > j, rotated(h ^ byte * P5, 11) * P1, h)
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def hashed(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of slices, those of 32 bytes and more one by one, and their lanes, of which there are LANES at most."""
    short = np.minimum(lengths, 8 * LANES)
    lanes = lanes_of(low, starts, short)
    h = xxh64(lanes, np.minimum(lengths, 31))
    for i in np.flatnonzero(lengths >= 32):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return h, lanes


def grouped(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hasher: Callable = hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of slices by hash (stable), where each run of byte-equal slices begins in it, and the hashes in that order.
    Equal hashes are held against the slice before them, byte by byte; where two differ, their hash's slices are sorted by
    bytes."""
    h, lanes = hasher(low, starts, lengths)
    order = np.argsort(h, kind="stable")
    same_hash = np.zeros(len(order), bool)
    same_hash[1:] = h[order[1:]] == h[order[:-1]]
    equal = same_hash.copy()
    for x in (lengths, *lanes):
        equal[1:] &= x[order[1:]] == x[order[:-1]]
    for i in np.flatnonzero(equal & (lengths[order] > 8 * LANES)):
        a, b, n = starts[order[i - 1]], starts[order[i]], lengths[order[i]]
        equal[i] = bool((low[a : a + n] == low[b : b + n]).all())
    clash = np.flatnonzero(same_hash & ~equal)
    if len(clash):
        firsts = np.flatnonzero(~same_hash)
        text = lambda i: low[starts[i] : starts[i] + lengths[i]].tobytes()
        for run in np.unique(np.searchsorted(firsts, clash, "right") - 1):
            a, b = firsts[run], firsts[run + 1] if run + 1 < len(firsts) else len(order)
            part = sorted(order[a:b].tolist(), key=lambda i: (text(i), i))
            order[a:b] = part
            equal[a + 1 : b] = [text(x) == text(y) for x, y in zip(part, part[1:], strict=False)]
    return order, np.flatnonzero(~equal), h[order]


CELL = np.dtype([("group", "<u4"), ("n", "<u4")])


def counted(texts: pa.Array, langs: np.ndarray, groups: np.ndarray, hasher: Callable = hashed) -> pa.RecordBatch | None:
    """COUNTS of texts (binary), which stand in order of their groups: a row for each term of each language, its `cells` the
    groups that hold it and how often. langs, groups: numbers by text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low, starts, lengths = slices_of(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
    if not len(starts):
        return None
    order, runs, h = grouped(low, starts, lengths, hasher)
    # Within a run slices stand in the order of their texts, so every change of group begins an entry.
    d = (np.searchsorted(offsets - offsets[0], starts, "right") - 1)[order]
    changes = lambda x: np.diff(x, prepend=-1).astype(bool)
    row = np.zeros(len(order), bool)
    row[runs] = True
    row |= changes(langs[d])
    entry = row | changes(groups[d])
    new_doc = entry | changes(d)
    rows, entries = np.flatnonzero(row), np.flatnonzero(entry)
    cells = np.empty(len(entries), CELL)
    cells["group"], cells["n"] = groups[d[entries]], np.diff(entries, append=len(order))
    first, ends = order[rows], np.cumsum(lengths[order[rows]])
    where = np.arange(ends[-1]) + np.repeat(starts[first] - (ends - lengths[first]), lengths[first])
    binary = lambda values, edges: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(values)])
    cols = [
        pa.array(langs[d[rows]], pa.int32()), pa.array(h[rows].view(np.int64)), binary(np.ascontiguousarray(low[where]), np.append(0, ends)),
        pa.array(np.add.reduceat(new_doc.astype(np.int64), rows)), binary(cells, np.append(np.searchsorted(entries, rows), len(entries)) * CELL.itemsize),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "hash", "term", "documents", "cells"])


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """KEPT from COUNTS sorted by (lang, hash, term): terms of at least `least` documents of a language, their cells added up.
    The last term of a batch waits for the next one."""
    waiting: tuple | None = None

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names=["lang", "term", "groups", "counts"])

    def row(lang: int, term: bytes, groups: np.ndarray, counts: np.ndarray) -> tuple:
        order = np.argsort(groups, kind="stable")
        firsts = np.flatnonzero(np.diff(groups[order], prepend=-1))
        return lang, term.decode(), groups[order][firsts], np.add.reduceat(counts[order], firsts)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, h, documents = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        term, cells = batch.column(2), batch.column(4)
        again = np.flatnonzero((np.diff(lang) == 0) & (np.diff(h) == 0)) + 1
        new = np.ones(len(lang), bool)
        new[again] = [term[int(i)] != term[int(i) - 1] for i in again]
        runs = np.append(np.flatnonzero(new), len(lang))
        total = np.add.reduceat(documents, runs[:-1])
        edges = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1] // CELL.itemsize
        flat, out = np.frombuffer(cells.buffers()[2], CELL), []
        for k in range(len(total)):
            first, last = k == 0 and waiting is not None, k == len(total) - 1
            if not (first or last or total[k] >= least):
                continue
            a, part = int(runs[k]), flat[edges[runs[k]] : edges[runs[k + 1]]]
            this = (int(lang[a]), term[a].as_py(), int(total[k]), part["group"].astype(np.int64), part["n"].astype(np.int64))
            if first:
                if waiting[:2] == this[:2]:
                    this = (*this[:2], this[2] + waiting[2], *row(*this[:2], np.append(waiting[3], this[3]), np.append(waiting[4], this[4]))[2:])
                elif waiting[2] >= least:
                    out.append(row(*waiting[:2], *waiting[3:]))
            if last:
                waiting = this
            elif this[2] >= least:
                out.append(row(*this[:2], *this[3:]))
        yield made(out)
    if waiting and waiting[2] >= least:
        yield made([row(*waiting[:2], *waiting[3:])])


def scaled(counts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * counts / size) for counts up to size, exactly, with 64-bit numbers up to 9e15: three digits at a time."""
    q, r = np.divmod(counts, size)
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // size, r % size
    return q + 1


@dataclass
class Sizes:
    """Of one language: its groups' numbers, N + 5 V by group and of the language."""

    groups: np.ndarray
    sizes: np.ndarray
    whole: int


def pair_sums(indptr: np.ndarray, terms: np.ndarray, p: np.ndarray, none: np.ndarray, n_terms: int) -> np.ndarray:
    """Sums over a block's terms of |p_a - p_b| for all groups a and b, from a compressed sparse matrix by group (terms, p);
    none: a group's p for terms that it lacks. Every a is spread out once; what others hold is summed up by reduceat, and
    what they lack through a's sorted values."""
    n, held = len(none), np.flatnonzero(np.diff(indptr))
    at = indptr[held]
    by = np.repeat(np.arange(n), np.diff(indptr))
    out = np.empty((n, n), np.int64)
    for a in range(n):
        own = np.full(n_terms, none[a], np.int64)
        own[terms[indptr[a] : indptr[a + 1]]] = p[indptr[a] : indptr[a + 1]]
        low = np.sort(own)
        sums = np.append(0, np.cumsum(low))
        k = np.searchsorted(low, none)
        out[a] = none * (2 * k - n_terms) + sums[-1] - 2 * sums[k]
        if len(held):
            x = own[terms]
            out[a, held] += np.add.reduceat(np.abs(x - p) - np.abs(x - none[by]), at)
    return out


def divergences(batches: Iterator[pa.RecordBatch], sizes: dict[int, Sizes], top: int) -> Iterator[pa.RecordBatch]:
    """PARTS of KEPT: sums of a block for each pair of a language's groups (item null, other set), and each group's `top`
    terms of the block (other null)."""

    def made(group: list, other: list, item: list, value: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(other, pa.int32()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["group", "other", "item", "value"])

    for batch in batches:
        langs, step = batch.column(0).to_numpy(zero_copy_only=False), BLOCK_ROWS
        for lang in np.unique(langs):
            own, of = batch.filter(pa.array(langs == lang)), sizes[int(lang)]
            for at in range(0, own.num_rows, step):
                part = own.slice(at, step)
                lists = part.column(2)
                flat, counts = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()[: part.num_rows + 1]))
                g = np.searchsorted(of.groups, flat)
                p = scaled(counts + SMOOTHING, of.sizes[g])
                none = scaled(np.full(len(of.groups), SMOOTHING, np.int64), of.sizes)
                order = np.lexsort((row, g))
                indptr = np.searchsorted(g[order], np.arange(len(of.groups) + 1))
                sums = pair_sums(indptr, row[order], p[order], none, part.num_rows)
                a, b = np.nonzero(~np.eye(len(of.groups), dtype=bool))
                yield made(of.groups[a], of.groups[b], [None] * len(a), sums[a, b])
                whole = np.add.reduceat(counts, np.flatnonzero(np.diff(row, prepend=-1)))
                f = p - scaled(whole + SMOOTHING, of.whole)[row]
                names = part.column(1).to_pylist()
                rank = np.empty(len(names), np.int64)
                rank[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
                best = np.lexsort((rank[row], -f, g))
                best = best[f[best] > 0]
                firsts = np.searchsorted(g[best], g[best], "left")
                best = best[np.arange(len(best)) - firsts < top]
                yield made(of.groups[g[best]], [None] * len(best), [names[i] for i in row[best]], f[best])


def divergence_audit(docs: DataFrame, scratch: Scratch, *, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """How far each source of a language is from every other one, and which terms set it apart from the whole language.

    docs: lang, source, text (others ignored); null is the empty text. Terms are runs of letters a-z, A-Z (lowered) and of
    all characters from U+0080 on. A language keeps its terms of `least` rows or more; a row is a document, repeated rows
    too. Every (lang, source) that occurs gives each kept term p = 1 + floor(1e9 (count + 5) / (N + 5 V)). Out: lang, source,
    part, item, value, rank: part `pair`, each other source and the sum of |p - q|; part `term`, terms of larger p than in
    the language, by difference, `top` of them. Ties by item. Groups without terms and languages without kept terms have
    their pairs (of value 0 if no term is kept); an empty table gives no row. Long texts and terms are taken whole.

    One pass over the texts, in blocks of BATCH_BYTES or of one longer text; a shuffle of one row a block and term; kept
    terms are written and compared where they lie. Groups are numbered on the driver: the result has a row for every two
    sources of a language, so their number is far below what a driver holds. Sums are exact while N + 5 V is below 9e15.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("binary").alias("text"))
    groups = sorted(tuple(r) for r in rows.select("lang", "source").distinct().collect())
    langs = sorted({lang for lang, _ in groups})
    lang_of, group_of = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(groups)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            g = np.array([group_of[k] for k in keys], np.int64)
            size = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy())
            edges = np.searchsorted(size, np.arange(0, int(size[-1]) if len(size) else 0, BATCH_BYTES))
            for a, b in pairwise([*np.unique(edges).tolist(), batch.num_rows]):
                order = a + np.argsort(g[a:b], kind="stable")
                of = g[order]
                made = counted(batch.column(2).take(pa.array(order)), np.array([lang_of[groups[i][0]] for i in of], np.int64), of)
                if made:
                    yield made

    counts = rows.mapInArrow(count, COUNTS)
    dealt = counts.repartition("lang", "hash").sortWithinPartitions("lang", "hash", "term")
    kept = scratch.write(dealt.mapInArrow(lambda batches: merged(batches, least), "lang int, term string, groups array<int>, counts array<long>"))
    cells = kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("c"))
    n = dict(cells.groupBy("c.groups").agg(F.sum("c.counts")).collect())
    v = dict(kept.groupBy("lang").count().collect())
    sizes = {}
    for lang in v:
        own = np.array([i for i, (name, _) in enumerate(groups) if lang_of[name] == lang], np.int64)
        each = np.array([n.get(i, 0) for i in own.tolist()], np.int64)
        sizes[lang] = Sizes(own, each + SMOOTHING * v[lang], int(each.sum()) + SMOOTHING * v[lang])
    parts = kept.mapInArrow(lambda batches: divergences(batches, sizes, top), "group int, other int, item string, value long")
    named = spark.createDataFrame([(i, *x) for i, x in enumerate(groups)], "group int, lang string, source string")
    bare = named.filter(~F.col("lang").isin([langs[i] for i in v])) if v else named
    others = bare.alias("a").join(bare.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.group") != F.col("b.group")))
    none = others.select("a.group", F.col("b.group").alias("other"), F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = parts.unionByName(none).groupBy("group", "other", "item").agg(F.sum("value").alias("value"))
    out = summed.join(named, "group").join(named.select(F.col("group").alias("other"), F.col("source").alias("there")), "other", "left")
    out = out.select("lang", "source", F.when(F.col("other").isNull(), "term").otherwise("pair").alias("part"), F.coalesce("item", "there").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"), Scratch(spark))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT e.lang, source, term, e.n, 1 + CAST((1000000000::HUGEINT * (e.n + 5)) // (sum(e.n) OVER (PARTITION BY e.lang, source) + 5 * v) AS BIGINT) AS p,
             1 + CAST((1000000000::HUGEINT * (whole + 5)) // (size.n + 5 * v) AS BIGINT) AS q FROM every e JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
