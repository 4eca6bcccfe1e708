"""Near-dedup by min-max hashing: each permutation gives both its minimum and its maximum, so 144 hash evaluations a
shingle give a signature of 288 values, banded 48 x 6. Links are confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import Scratch, table

BANDS, PERMS_PER_BAND = 48, 3
SEED = 20240229
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Words remembered by a worker; beyond that the memory starts anew.
MEMORY = 1 << 20
#: Members of a bucket that are compared pair by pair; members and shingles of a block; and columns of one matrix product.
SMALL, BLOCK, BLOCK_SHINGLES, COLUMNS = 16, 256, 1 << 19, 8192
#: Rounds in which the members of a bucket meet one of them, before all pairs are looked at.
ROUNDS = 2
#: Parts in which the rows of one key are joined.
SALTS = 8
#: Keys with more than one row in so many (and more than LEAST_HEAVY) are heavy; so there are never more than these.
HEAVY_SHARE, LEAST_HEAVY = 10_000, 500


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; no words: none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    acc = h[: len(h) - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = mix(acc * M1) + h[j : len(h) - k + 1 + j]
    return np.unique(mix(acc))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * PERMS_PER_BAND
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def minmax(sets: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every permutation over a set, in blocks, so that memory doesn't grow with the text."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), step):
        v = a[:, None] * x[None, i : i + step] + b[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, from its three minima and three maxima; bands don't share keys."""
    with np.errstate(over="ignore"):
        rows = np.concatenate([low.reshape(BANDS, -1), high.reshape(BANDS, -1)], 1).astype(np.uint64)
        acc = np.arange(1, BANDS + 1, dtype=np.uint64) * M1
        for j in range(rows.shape[1]):
            acc = mix((acc ^ rows[:, j]) * M1)
    return acc.view(np.int64)


SIGNED = pa.schema([("mm_id", pa.int64()), ("mm_t", pa.int64()), ("mm_n", pa.int64()), ("mm_f1", pa.int64()), ("mm_f2", pa.int64()), ("mm_bands", pa.list_(pa.int64()))])


def sign(docs: DataFrame, k: int) -> DataFrame:
    """(mm_id, hash of the text, size of the shingle set, 128-bit fingerprint of the set, band keys; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), permutations()
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingles(text.as_py(), k, hashes)
                n.append(len(s))
                f1.append(int(mix(s * M1 + M2).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix((s ^ M3) * M2).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(*minmax(s, a, b)) if len(s) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bands])]), pa.int32()), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], schema=SIGNED)

    return docs.select(F.col("doc_id").cast("long").alias("mm_id"), F.xxhash64("text").alias("mm_t"), F.col("text").alias("mm_text")).mapInArrow(run, "mm_id long, mm_t long, mm_n long, mm_f1 long, mm_f2 long, mm_bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of the pairs (a, fa, b, fb) of which 100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            a, b, fa, ta, tb = (batch.column(i) for i in range(5))
            ta, tb, keep = ta.cast(pa.binary()), tb.cast(pa.binary()), []
            for i, x in enumerate(zip(a.to_pylist(), fa.to_pylist(), strict=True)):
                if x != last:
                    last, held = x, shingles(ta[i].as_py(), k, hashes)
                s = shingles(tb[i].as_py(), k, hashes)
                both = len(np.intersect1d(held, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(s) - both) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    ta = texts.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("mm_text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("mm_text").alias("tb"))
    return pairs.join(tb, ["b", "fb"]).join(ta, ["a", "fa"]).select("a", "b", "fa", "ta", "tb").mapInArrow(run, "a long, b long")


def star_pass(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Large star, then small star: of each node u the larger neighbours meet the smallest of u and all neighbours, then u and
    its smaller neighbours the smallest of these. Edges of u are in order in one group; those of a hub in SALTS groups, each
    of which has the hub's smallest neighbour (hubs: u, least) besides its own. Repeated edges go."""
    at = Window.partitionBy("u", "salt").orderBy("v")

    def near(df: DataFrame) -> DataFrame:
        nil = F.lit(None).cast("long")
        dealt = df.select("u", "v", nil.alias("least")) if hubs is None else df.join(F.broadcast(hubs), "u", "left")
        salt = F.when(F.col("least").isNull(), 0).otherwise(salt_of("v")).alias("salt")
        return dealt.select("*", salt).select("u", "v", F.least(F.first("v").over(at), "least").alias("m"), F.lag("v").over(at).alias("before")).filter("NOT v <=> before")

    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    large = near(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    one, first = F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
    return near(large).select(F.explode(F.when(F.col("before").isNull(), F.array(first, one)).otherwise(F.array(one))).alias("e")).select("e.u", "e.v").filter("u <> v")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node with an edge (a, b), once. Alternates large star and small
    star until the edges (u, v) are stars: every u has one v, and no v is a u. edges are read more than once."""
    edges, made = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v"), None
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("low")), F.struct(F.col("v").alias("x"), F.lit(None).cast("long").alias("low")))).alias("e")).select("e.*")
        seen = scratch.write(ends.groupBy(F.col("x").alias("node")).agg(F.coalesce(F.min("low"), "x").alias("comp"), F.max("low").alias("most"), F.count_if(F.isnull("low")).alias("below"), F.count("*").alias("c")))
        rows, loose = seen.agg(F.coalesce(F.sum("below"), F.lit(0)), F.count_if(F.expr("comp < most OR most IS NOT NULL AND below > 0"))).first()
        if made is not None and not loose:
            scratch.drop(made)
        if not loose:
            return seen
        # Hubs are few by their definition. A node has no more smaller neighbours after the large star than before.
        hubs = [tuple(r) for r in seen.filter(F.col("c") > max(LEAST_HEAVY, rows // HEAVY_SHARE)).select("node", "comp").collect()]
        after = scratch.write(star_pass(edges, scratch.spark.createDataFrame(hubs, "u long, least long") if hubs else None))
        scratch.drop(seen, *([] if made is None else [made]))
        edges = made = after


def salt_of(column: str) -> Column:
    """The part of its key's rows that a row belongs to."""
    return F.pmod(F.xxhash64(F.lit(3), column), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """Every row once for each part, so that it meets all parts of its key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def confirm_blocks(rest: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different components inside large buckets, without a row for each pair.

    rest: (key, id, f, n, comp). Every member has the largest of its buckets as its home, and the members of one home and
    of about one size are dealt into blocks (those of a large component into blocks of their own). Two blocks meet once,
    and only if some bucket has members of both, of different components, and if their sizes allow a link; a matrix
    product counts all their intersections.
    """
    size = rest.groupBy("key").agg(F.count("*").alias("c"))
    home = rest.withColumn("salt", salt_of("id")).join(salted(size), ["key", "salt"]).groupBy("id", "f").agg(
        F.max(F.struct("c", "key"))["key"].alias("home"), F.first("comp").alias("comp"), F.first("n").alias("n"), F.floor(F.log(1.25, F.first("n"))).cast("int").alias("z")
    )
    who = scratch.write(home)
    at = ["home", "z", "comp"]
    count = who.groupBy(*at).agg(F.count("*").alias("c"), F.sum("n").alias("sh")).withColumn("own", F.when(F.col("c") >= BLOCK, F.col("comp")))
    blocks_of = F.greatest(F.ceil(F.sum("c") / BLOCK), F.ceil(F.sum("sh") / BLOCK_SHINGLES))
    total = count.groupBy("home", "z", "own").agg(blocks_of.alias("blocks")).select(F.col("home").alias("home_"), F.col("z").alias("z_"), F.col("own").alias("own_"), "blocks")
    count = count.join(total, (F.col("home") == F.col("home_")) & (F.col("z") == F.col("z_")) & F.col("own").eqNullSafe(F.col("own_"))).select(*at, "own", "blocks")
    # Members are dealt by hash, and the counts that say how many blocks there are meet them in SALTS parts.
    member = scratch.write(
        who.withColumn("salt", salt_of("id")).join(salted(count), [*at, "salt"])
        .select(F.struct("home", "z", F.coalesce("own", F.lit(-1)).alias("own"), F.col("own").isNull().alias("mixed"), F.pmod(F.xxhash64("id", "f"), F.col("blocks")).alias("k")).alias("block"), "id", "f", "comp")
    )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), k, hashes).tobytes() for t in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], names=["block", "id", "comp", "set"])

    kind = "block struct<home:long,z:int,own:long,mixed:boolean,k:long>"
    blocks = scratch.write(
        member.join(texts, ["id", "f"]).select("block", "id", "comp", "mm_text").mapInArrow(to_sets, f"{kind}, id long, comp long, set binary")
        .groupBy("block").agg(F.collect_list(F.struct("id", "comp", "set")).alias("m"))
    )
    held = scratch.write(rest.select("key", "id", "f").join(member, ["id", "f"]).groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    side = lambda x: held.select("key", F.col("block").alias(f"block_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    meet = side("x").join(side("y"), "key").filter("block_x <= block_y AND abs(block_x.z - block_y.z) <= 1 AND NOT (lo_x = hi_x AND lo_y = hi_y AND lo_x = lo_y)").select("block_x", "block_y").distinct()
    one = lambda x: blocks.select(F.col("block").alias(f"block_{x}"), F.col("m").alias(f"m_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                both = [np.frombuffer(m["set"], np.uint64) for m in (*x, *y)]
                size = np.array([len(s) for s in both])
                of, flat = np.repeat(np.arange(len(both)), size), np.concatenate(both)
                sort = np.argsort(flat, kind="stable")
                column = np.cumsum(np.concatenate([[0], np.diff(flat[sort]) != 0]))
                inter = np.zeros((len(x), len(y)), np.float32)
                for at in range(0, int(column[-1]) + 1, COLUMNS):  # in blocks of columns, so that memory has a bound
                    i, j = np.searchsorted(column, [at, at + COLUMNS])
                    m = np.zeros((len(both), COLUMNS), np.float32)
                    m[of[sort[i:j]], column[i:j] - at] = 1
                    inter += m[: len(x)] @ m[len(x) :].T
                nx, ny = size[: len(x), None], size[None, len(x) :]
                good = (100 * inter >= percent * (nx + ny - inter)) & (np.array([m["comp"] for m in x])[:, None] != np.array([m["comp"] for m in y])[None])
                i, j = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array([x[q]["id"] for q in i], pa.int64()), pa.array([y[q]["id"] for q in j], pa.int64())], names=["a", "b"])

    return meet.join(one("x"), "block_x").join(one("y"), "block_y").select("m_x", "m_y").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, f, mm_text of the wanted rows (id, t, f, again), once each. Sorted-merge at every size, as they may be many; rows
    that the table repeats are brought together before they are joined."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), F.col("text").alias("mm_text"))
    out = own.join(wanted.filter("NOT again").hint("merge"), ["id", "t"]).select("id", "f", "mm_text")
    if wanted.filter("again").head(1):
        once = own.groupBy("id", "t").agg(F.first("mm_text").alias("mm_text"))
        out = out.union(once.join(wanted.filter("again").hint("merge"), ["id", "t"]).select("id", "f", "mm_text"))
    return out


def pair_of(near: Column) -> Column:
    """(a, fa, b, fb) of a member (id, f) and another (id2, f2), the smaller id first; null unless `near`."""
    one, two = (F.struct(F.col(f"id{x}").alias("i"), F.col(f"f{x}").alias("f")) for x in ("", "2"))
    low, high = F.least(one, two), F.greatest(one, two)
    return F.when(near & (F.col("id") != F.col("id2")), F.struct(low["i"].alias("a"), low["f"].alias("fa"), high["i"].alias("b"), high["f"].alias("fb")))


def near_duplicates(docs: DataFrame, scratch: Scratch, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text, others ignored): doc_id, n_shingles, component_id, kept.

    Rows of one shingle set are one class, named by its smallest doc_id and its fingerprint, and only one row of it is
    banded. In each bucket every member is first paired with the member that shares most buckets with others, the likely
    origin of its copies; pairs are confirmed and merged. A bucket whose members are then in one component has nothing
    more to tell. While others of more than SMALL members are left, this is repeated with the likeliest member of another
    component (ROUNDS in all). Then every pair of different components in a bucket is confirmed: pair by pair in buckets of up to SMALL, in blocks beyond
    (confirm_blocks); buckets of the same members are looked at once. So no candidate is lost, and a group of copies makes
    rows in proportion to its size; its rows meet in SALTS parts.

    Fewer than k words: the whole sequence is the one shingle. Null or empty text: n_shingles 0, its own component, kept.
    Null doc_id: null component, kept. Repeated rows of a doc_id: one node, which has the links of all its texts; all its
    rows share component and verdict. Empty table: empty result. Two documents at a similarity of exactly 0.8 meet in some
    band but for a chance of 5e-7, were the permutations random.
    """
    signed = scratch.write(sign(docs, k).withColumn("mm_row", F.monotonically_increasing_id()))
    nodes = signed.filter("mm_id IS NOT NULL AND mm_n > 0")
    # Of a class: its smallest id, and the first and last row of that.
    lowest = [F.min(F.struct("mm_id", (F.lit(sign_) * F.col("mm_row")).alias("row"))).alias(name) for name, sign_ in (("low", 1), ("high", -1))]
    classes = nodes.groupBy("mm_f1", "mm_f2").agg(*lowest, F.count("*").alias("c")).filter("c > 1").select("mm_f1", "mm_f2", F.col("low.mm_id").alias("rep"), F.col("low.row").alias("first"), F.expr("low.row <> -high.row").alias("again"))
    named = scratch.write(
        nodes.withColumn("salt", salt_of("mm_row")).join(salted(classes), ["mm_f1", "mm_f2", "salt"], "left")
        .select("mm_id", F.col("mm_f1").alias("f"), F.coalesce("rep", "mm_id").alias("rep"), "mm_n", "mm_t", "salt", F.coalesce("again", F.lit(False)).alias("again"), F.when(F.coalesce(F.col("mm_row") == F.col("first"), F.lit(True)), F.col("mm_bands")).alias("bands"))
    )
    member = scratch.write(named.groupBy("mm_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")))
    buckets = named.filter("bands IS NOT NULL").select(F.col("mm_id").alias("id"), "f", F.col("mm_n").alias("n"), F.col("mm_t").alias("t"), "again", "salt", F.explode("bands").alias("key"))
    multi = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("key", "c")
    own = Window.partitionBy("id", "f")
    shared = scratch.write(buckets.join(salted(multi), ["key", "salt"]).select("*", F.sum(F.col("c") - 1).over(own).alias("degree"), (F.row_number().over(own.orderBy("key")) == 1).alias("once")))
    texts = scratch.write(texts_of(docs, shared.filter("once").select("id", "t", "f", "again")))
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    head = F.max(F.struct("degree", (-F.col("id")).alias("low"), "id", "f", "n", "comp")).alias("x")
    state, tried, edges = shared.select("id", "f", "n", "key", "salt", "c", "degree", F.col("id").alias("comp")), None, None
    if member.filter("rep <> last").head(1):  # a document of several texts ties their classes together
        tied = named.join(member.filter("rep <> last").select("mm_id", F.col("rep").alias("least")), "mm_id").filter("rep <> least")
        edges = scratch.write(tied.select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct())
    for turn in range(ROUNDS):
        heads = state.groupBy("key").agg(head)
        if turn:  # the head before has met all; now the likeliest of the others
            likeliest = Window.partitionBy("key").orderBy(F.desc("x"))
            heads = state.groupBy("key", "comp").agg(head).select("key", "x", F.row_number().over(likeliest).alias("rank")).filter("rank = 2")
        heads = heads.select("key", *(F.col(f"x.{c}").alias(f"{c}2") for c in ("id", "f", "n", "comp")))
        pairs = state.join(salted(heads), ["key", "salt"]).filter("NOT comp <=> comp2").select(pair_of(near).alias("p")).filter("p IS NOT NULL").select("p.*").distinct()
        pairs = scratch.write(pairs if tried is None else pairs.join(tried, ["a", "fa", "b", "fb"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        links = scratch.write(confirm(pairs, texts, k, percent))
        comp = components(links if edges is None else edges.union(links), scratch)
        edges = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        again = state.drop("comp").join(comp.select("node", "comp"), F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "id")).drop("node")
        split = again.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("most")).filter("lo <> hi AND most > 2").select("key")
        state = scratch.write(again.join(salted(split), ["key", "salt"]))
        if not state.filter(F.col("c") > SMALL).head(1):
            break
    scratch.drop(shared)
    marks = [F.sum(F.xxhash64(F.lit(x), "id", "f").cast("decimal(38,0)")).alias(f"h{x}") for x in (1, 2)]
    once = state.groupBy("key").agg(F.count("*").alias("m"), *marks).groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    rest = scratch.write(state.join(salted(once), ["key", "salt"]).drop("salt"))
    small = rest.filter(F.col("c") <= SMALL)
    other = small.select("key", F.col("id").alias("id2"), F.col("f").alias("f2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "key").filter((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2"))).select(pair_of(near).alias("p")).filter("p IS NOT NULL").select("p.*").distinct()
    more = [confirm(scratch.write(pairs.join(tried, ["a", "fa", "b", "fb"], "left_anti")), texts, k, percent)]
    if rest.filter(F.col("c") > SMALL).head(1):
        more.append(confirm_blocks(rest.filter(F.col("c") > SMALL).select("key", "id", "f", "n", "comp"), texts, scratch, k, percent))
    late = scratch.write(more[0] if len(more) == 1 else more[0].union(more[1]))
    if late.head(1):
        comp = components(edges.union(late), scratch)
    of = member.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("mm_id", F.coalesce("comp", "rep").alias("rep"))
    out = signed.select("mm_id", "mm_n").join(of, "mm_id", "left").select(
        F.col("mm_id").alias("doc_id"), F.col("mm_n").alias("n_shingles"), F.coalesce("rep", "mm_id").alias("component_id")
    )
    scratch.close(signed, member, comp)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), k=2)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS at FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.at = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.at) AS component_id, min(r.at) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
