"""LM scoring: a log-bilinear model of two context words, trained in numpy by noise-contrastive estimation.

A context (a, b) predicts a vector u*R[a] + v*R[b]; the score of an output is its product with Q[output], plus a bias. The
model's vocabulary grows with the root of the number of training tokens, and each of its words has a context vector of its
own. Outputs form a tree of three levels: the most frequent words, groups of words, one class for all other words and the
end are told apart first, then the parts of a group, then the words of a part; each choice is normalised over the few
outputs it is made from. A word out of the vocabulary is told by its smoothed share of the other class, so that the
probabilities of all words sum to one.

Training documents are dealt by a hash into parts, whose number follows from the number of tokens alone, and into rounds.
In a round every part takes its steps from the same parameters, and these move by the average. What comes out doesn't
depend on how the input is partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, delete, table

#: The end token's key in counts: no word is empty.
END = b""
#: The model's words: so many for each root of a training token, of this count at least, and HEAD in any case. Beside
#: them, words whose counts are sent to all executors; counts of rarer ones are joined.
GROWTH, LEAST, HEAD, KNOWN = 8, 5, 1024, 200_000
#: Largest vocabulary: what is sent to all executors has this bound. It is reached at 250 billion training tokens.
MOST_WORDS = 4_000_000
#: Training tokens of a part, and shares of the documents (in 32nds) that the rounds train on, one after the other.
PART_TOKENS, ROUNDS = 6_000_000, (4, 6, 10, 12)
#: Words told apart at the first level.
SINGLE = 128
DIM, BATCH, NOISE, RATE = 24, 4096, 32, 0.2
#: Rows of parameters that are averaged together.
ROWS = 128
#: Texts and bytes of text that are taken at once: the more, the more often a word or a pair of context words comes back.
TEXTS, BYTES = 1024, 4 << 20
#: Context words whose powers at the first level are held at once.
POWERS = 200_000
#: Positions of one part of the tree that are multiplied together.
BLOCK = 32
#: Distinct words that a counting task holds before it passes its partial counts on.
HELD = 400_000
LN10 = float(np.log(10))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the text, then the end."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def stretches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice): neighbouring texts, TEXTS and BYTES at most, or one text alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        end = max(at + 1, min(end, at + TEXTS))
        yield at, texts.slice(at, end - at)
        at = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary), one after the other, and each text's number of them: tokens() without the ends."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(bare)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words, none = lists.flatten().view(pa.binary()), pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if none.any():  # an empty text is split into one empty word
        words, lens = words.filter(pc.greater(pc.binary_length(words), 0)), lens - none
    return words, lens


def places(words: pa.Array, keys: pa.Array, place: np.ndarray, missing: int) -> np.ndarray:
    """place of each word, or `missing`; every distinct word is looked up once."""
    coded = words.dictionary_encode()
    found = pc.index_in(coded.dictionary, value_set=keys).fill_null(len(keys)).to_numpy()
    return np.append(place, missing).astype(np.int32)[found][coded.indices.to_numpy()]


def keyed(place: dict) -> tuple[pa.Array, np.ndarray]:
    """The words of a dict and their numbers."""
    return pa.array(list(place), pa.binary()), np.fromiter(place.values(), np.int32, len(place))


def summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, n): over the training documents; partial counts by task, summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def add(words: pa.Array, n: pa.Array) -> Iterator[pa.RecordBatch]:
            held.append(pa.table([words, n], names=["word", "n"]))
            if sum(map(len, held)) >= 2 * HELD:
                held[:] = [summed(held)]
                if len(held[0]) >= HELD:
                    yield from held.pop().to_batches()

        for batch in batches:
            train = batch.filter(pa.array([not held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()))
            if train.num_rows:
                yield from add(pa.array([END], pa.binary()), pa.array([train.num_rows], pa.int64()))
            for _, texts in stretches(train.column(1)):
                yield from add(*words_of(texts)[0].value_counts().flatten())
        if held:
            yield from summed(held).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(counts: list[int], other: int, end: int) -> dict:
    """Untrained parameters. counts: of the vocabulary, best first; other, end: of the other class and the end. Contexts:
    words, other, begin. Outputs, by level: the SINGLE best words, groups, other, end; parts of groups; words of parts.
    share: of an output among those it is told from; mass: of the grouped words, summed up; tree: see tree()."""
    n = np.array([*counts, other, end], float) + 0.5
    single = min(SINGLE, len(counts))
    leaf = n[single : len(counts)]
    branch = max(2, round(len(leaf) ** (1 / 3) + 0.5))
    part, group = (np.add.reduceat(leaf, np.arange(0, len(leaf), k)) if len(leaf) else leaf for k in (branch, branch**2))
    top = np.concatenate([n[:single], group, n[len(counts) :]])
    share = np.concatenate([top / top.sum(), part / np.repeat(group, branch)[: len(part)], leaf / np.repeat(part, branch)[: len(leaf)]]).astype(np.float32)
    r = np.random.default_rng(11)
    return {
        "R": r.normal(0, 0.3, (len(n), DIM)).astype(np.float32), "Q": np.zeros((len(share), DIM), np.float32), "u": np.full(DIM, 1, np.float32), "v": np.full(DIM, 1, np.float32),
        "bias": np.log(share), "share": share, "mass": np.concatenate([[0], np.cumsum(leaf)]), "tree": np.array([single, branch, len(leaf)]),
    }


def tree(m: dict) -> tuple[int, int, int, int, int]:
    """Single words, parts of a group (and words of a part), grouped words, outputs of the first level, parts."""
    single, branch, leaves = m["tree"].tolist()
    return single, branch, leaves, single - (-leaves // branch**2) + 2, -(-leaves // branch)


def top_of(m: dict, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of words w at the first level; where grouped words are, and their numbers among these."""
    single, branch, leaves, first, _ = tree(m)
    j = w - single
    deep = np.flatnonzero((j >= 0) & (j < leaves))
    c = np.where(j < 0, w, np.where(j < leaves, single + j // branch**2, first - 2 + j - leaves))
    return c, deep, j[deep]


def rows_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at], which numpy does faster this way."""
    return np.take(x, at, 0, mode="clip")


def climb(into: np.ndarray, squares: np.ndarray, steps: np.ndarray, g: np.ndarray, rate: float, at=slice(None)) -> None:
    """A step up the gradient g of rows `at`, by Adagrad with one sum of squares a row; the steps of a row are counted."""
    wide = g.reshape(len(g), -1)
    sums = squares[at] + np.einsum("ij,ij->i", wide, wide) / wide.shape[1]
    squares[at] = sums
    steps[at] += 1
    move = (wide * (rate / np.sqrt(sums + 1e-8))[:, None]).reshape(g.shape)
    move += into[at] if isinstance(at, slice) else rows_of(into, at)
    into[at] = move


def by_row(rows: np.ndarray, values: np.ndarray, of: np.ndarray | None = None, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values (or of values[of] * by), an even number of them in single precision. Most rows
    come once or twice and need no sums of many; of the others two values are added at a time, as a complex number."""
    key = np.sort((rows.astype(np.int64) << 32) | np.arange(len(rows)))
    order, rows = key & 0xFFFFFFFF, key >> 32
    if of is not None:
        of, by = rows_of(of, order), rows_of(by, order)

    def taken(at: np.ndarray) -> np.ndarray:
        if of is None:
            return rows_of(values, order[at])
        out = rows_of(values, of[at])
        out *= by[at, None]
        return out

    first = np.flatnonzero(np.diff(rows, prepend=-1))
    counts = np.diff(first, append=len(rows))
    out = taken(first)
    more = np.flatnonzero(counts > 1)
    out[more] += taken(first[more] + 1)
    more = more[counts[more] > 2]
    if len(more):
        left = counts[more] - 2
        starts = np.cumsum(left) - left
        rest = taken(np.repeat(first[more] + 2 - starts, left) + np.arange(left.sum()))
        out[more] += np.add.reduceat(rest.view(np.complex64), starts, 0).view(np.float32)
    return rows[first], out


def inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce_step(m: dict, s: dict, n: dict, x: np.ndarray, target: np.ndarray, r: np.random.Generator, cdf: np.ndarray, rate: float) -> None:
    """One minibatch, a stretch x of the token stream: each word x[i + 2] with target[i] after the two before it, at each
    level against outputs drawn by their share there: NOISE at the first level, shared by the minibatch, and one for each
    position at the others. s: sums of squares; n: steps."""
    _, branch, leaves, first, parts = tree(m)
    context = rows_of(m["R"], x)
    q = context[:-2] * m["u"]
    q += context[1:-1] * m["v"]
    q = q[target]
    top, deep, j = top_of(m, x[2:][target])
    noise = np.minimum(np.searchsorted(cdf, r.random(NOISE)), first - 1)
    odds = m["bias"][:first] - np.log(NOISE * m["share"][:first])
    dq, qn = rows_of(m["Q"], top), m["Q"][noise]
    good = inverse(np.einsum("ij,ij->i", q, dq) + odds[top])  # 1 - sigmoid
    bad = q @ qn.T
    bad += odds[noise]
    bad = -inverse(np.negative(bad, out=bad))
    dq *= good[:, None]
    dq += bad @ qn
    k, n_top = len(deep), len(q) + NOISE
    q1 = np.zeros((n_top, DIM + 2), np.float32)  # one for the bias, and a column that makes their number even
    q1[: len(q), :DIM], q1[: len(q), DIM] = q, 1
    np.matmul(bad.T, q1[: len(q)], out=q1[len(q) :])
    # The steps of rows: q1[of] * by.
    rows, by = np.concatenate([top, noise, np.empty(4 * k, np.int64)]), np.concatenate([good, np.ones(NOISE + 4 * k, np.float32)])
    of = np.concatenate([np.arange(n_top), deep, deep, deep, deep])
    if k:
        qd, dd = rows_of(q, deep), np.zeros((k, DIM), np.float32)
        for start, base, node, unit in ((n_top, first, j // branch, branch), (n_top + 2 * k, first + parts, j, 1)):
            mass = np.append(m["mass"][:leaves:unit], m["mass"][leaves])
            low = node // branch * branch
            high = np.minimum(low + branch, len(mass) - 1)
            below = rows_of(mass, low)
            drawn = np.searchsorted(mass, below + r.random(k) * (rows_of(mass, high) - below), "right") - 1
            at = rows[start : start + 2 * k]
            at[:k], at[k:] = node, np.clip(drawn, low, high - 1)
            at += base
            qs = rows_of(m["Q"], at)
            z = np.concatenate([np.einsum("ij,ij->i", qs[:k], qd), np.einsum("ij,ij->i", qs[k:], qd)]) + rows_of(m["bias"], at) - np.log(rows_of(m["share"], at))
            g = -inverse(np.negative(z, out=z))
            g[:k] += 1
            qs *= g[:, None]
            dd += qs[:k]
            dd += qs[k:]
            by[start : start + 2 * k] = g
        dd += rows_of(dq, deep)
        dq[deep] = dd
    at, g = by_row(rows, q1, of, by)
    climb(m["Q"], s["Q"], n["Q"], g[:, :DIM], rate, at)
    climb(m["bias"], s["bias"], n["bias"], g[:, DIM], rate / 10, at)
    d, g = np.zeros((len(x) - 2, DIM), np.float32), np.zeros((len(x), DIM), np.float32)
    d[target] = dq
    g[:-2] = d * m["u"]
    g[1:-1] += d * m["v"]
    at, g = by_row(x, g)
    climb(m["R"], s["R"], n["R"], g, rate, at)
    climb(m["u"], s["u"], n["u"], np.einsum("ij,ij->j", d, context[:-2]), rate / 10)
    climb(m["v"], s["v"], n["v"], np.einsum("ij,ij->j", d, context[1:-1]), rate / 10)


def tables(m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, logZ): ln p(c | a, b) = A[a, c] + B[b, c] - logZ[a, b] at the first level, with the bias in B; all contexts at
    once, for small vocabularies."""
    first = tree(m)[3]
    a, b = (m["R"] * m["u"]) @ m["Q"][:first].T, (m["R"] * m["v"]) @ m["Q"][:first].T + m["bias"][:first]
    ta, tb = a.max(1, keepdims=True), b.max(1, keepdims=True)
    z = np.log(np.exp(a - ta) @ np.exp(b - tb).T) + ta + tb.T
    return a, b, z


#: Scores up to this size are raised to powers as they are; single precision holds the sums.
SAFE = 60.0


def log_sums(x: np.ndarray, safe: bool) -> np.ndarray:
    """ln of the sums of powers of x, row by row. safe: no score is beyond SAFE. Powers are taken in single precision, which takes
    a third of the time."""
    most = 0 if safe else x.max(1)
    power = (x if safe else x - most[:, None]).astype(np.float32)
    np.exp(power, out=power)
    return most + np.log(power @ np.ones(x.shape[1], np.float32))


def first_sums(m: dict, q: np.ndarray, a: np.ndarray, b: np.ndarray, safe: bool, step: int) -> np.ndarray:
    """log_sums of the first level for distinct pairs of context words, which predict q. A power of a sum is a product of powers:
    these are taken by word, of which there are fewer, and only multiplied by pair."""
    first = tree(m)[3]
    vectors, bias = m["Q"][:first].T.astype(np.float64), m["bias"][:first].astype(np.float64)
    out = np.empty(len(a), np.float32)
    parts = [slice(k, k + step) for k in range(0, len(a), step)]
    if not safe:
        for k in parts:
            out[k] = log_sums(q[k] @ vectors + bias, safe)
        return out
    (x, at), (y, to) = (np.unique(w, return_inverse=True) for w in (a, b))
    if len(x) + len(y) > POWERS and len(a) > 1:
        half = len(a) // 2
        return np.concatenate([first_sums(m, q[k], a[k], b[k], safe, step) for k in (slice(half), slice(half, None))])
    powers = []
    for w, by, more in ((x, m["u"], 0), (y, m["v"], bias)):
        powers.append(np.empty((len(w), first), np.float32))
        for k in range(0, len(w), step):
            powers[-1][k : k + step] = rows_of(m["R"], w[k : k + step]) * by @ vectors + more
            np.exp(powers[-1][k : k + step], out=powers[-1][k : k + step])
    for k in parts:
        out[k] = np.einsum("ij,ij->i", rows_of(powers[0], at[k]), rows_of(powers[1], to[k]))
    return np.log(out, out=out)


def below(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, node: np.ndarray, safe: bool, blocks: int) -> np.ndarray:
    """ln of the share of output node (in ascending order) among those of its parent, for each predicted vector. vectors and
    bias: by parent. A parent's rows are dealt into blocks of BLOCK, the last one filled up; so many blocks are multiplied at
    once."""
    branch = bias.shape[1]
    parent, c = np.divmod(node, branch)
    bounds = np.flatnonzero(np.diff(parent, prepend=-1, append=-1))
    sizes = np.diff(bounds)
    need = -(-sizes // BLOCK)
    slot = np.repeat((np.cumsum(need) - need) * BLOCK - bounds[:-1], sizes) + np.arange(len(node))
    of = np.repeat(parent[bounds[:-1]], need)
    row, flat = np.zeros(len(of) * BLOCK, np.int64), np.arange(len(of) * BLOCK) * branch
    row[slot] = np.arange(len(node))
    flat[slot] += c
    out = np.empty(len(of) * BLOCK, np.float64)
    for k in range(0, len(of), blocks):
        s, w = slice(k * BLOCK, (k + blocks) * BLOCK), of[k : k + blocks]
        x = rows_of(q, row[s]).reshape(len(w), BLOCK, DIM) @ rows_of(vectors, w)
        x += rows_of(bias, w)[:, None]
        out[s] = rows_of(x.reshape(-1), flat[s] - k * BLOCK * branch)
        out[s] -= log_sums(x.reshape(-1, branch), safe)
    return out[slot]


def levels(m: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, bias) by parent, in double precision, of the parts of groups and of the words of parts; where a last parent has
    fewer, nothing of its sum goes to outputs that aren't there."""
    _, branch, leaves, first, parts = tree(m)
    out = []
    for base, n in ((first, parts), (first + parts, leaves)):
        full = -(-n // branch) * branch
        vectors, bias = np.zeros((full, DIM)), np.full(full, -np.inf)
        vectors[:n], bias[:n] = m["Q"][base : base + n], m["bias"][base : base + n]
        out.append((np.ascontiguousarray(vectors.reshape(-1, branch, DIM).transpose(0, 2, 1)), bias.reshape(-1, branch)))
    return out


def log_probs(m: dict, a: np.ndarray, b: np.ndarray, w: np.ndarray, step: int = 1024) -> np.ndarray:
    """ln p(w | a, b), summed over the levels. A pair of context words is predicted from, and its sum at the first level taken,
    once. Products that go by matrix are in double precision, so that it doesn't matter what stands beside a row."""
    _, branch, _, first, _ = tree(m)
    top, deep, j = top_of(m, w)
    long = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
    safe = long(m["R"]) * float(np.abs(m["u"]).max() + np.abs(m["v"]).max()) * long(m["Q"]) + float(np.abs(m["bias"]).max()) < SAFE
    pair = a.astype(np.int64) * len(m["R"]) + b
    order = np.argsort(pair)
    new = np.diff(pair[order], prepend=-1) != 0
    of = np.empty(len(w), np.int64)
    of[order] = np.cumsum(new) - 1
    at = order[new]
    x, y = a[at], b[at]
    q = rows_of(m["R"], x)
    q *= m["u"]
    for k in (slice(k, k + step) for k in range(0, len(at), step)):
        q[k] += rows_of(m["R"], y[k]) * m["v"]
    sums = first_sums(m, q, x, y, safe, step)
    out = np.empty(len(w), np.float64)
    for k in (slice(k, k + step) for k in range(0, len(w), step)):
        out[k] = np.einsum("ij,ij->i", rows_of(q, of[k]), rows_of(m["Q"], top[k])) + m["bias"][top[k]] - sums[of[k]]
    if len(deep):
        order = np.argsort(j)  # the words of a part, and the parts of a group, stand side by side
        deep, j = deep[order], j[order]
        x = rows_of(q, of[deep])
        for (vectors, bias), node in zip(levels(m), (j // branch, j), strict=True):
            out[deep] += below(x, vectors, bias, node, safe, max(1, step // BLOCK))
    return out


def positions(w: np.ndarray, first: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with their two contexts, over texts of vocabulary ids that begin at `first` (words out of it: other; the end
    is the last token, other + 1). As a context, other + 1 is the begin."""
    a, b = np.empty_like(w), np.empty_like(w)
    b[1:], a[2:] = w[:-1], w[:-2]
    b[first] = a[first] = other + 1
    second = first + 1
    a[second[second < len(w)]] = other + 1
    return a, b, w


def packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows of 32-bit numbers, which end at `ends`."""
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)]).cast(pa.binary())


def encode(docs: DataFrame, place, other: int, parts: int) -> DataFrame:
    """(round, part, key, ids) of the training documents: two begins, the words' places (out of the vocabulary: other), the
    end (as a context: the begin), as 32-bit numbers. Documents are dealt by a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = keyed(place.value)
        for batch in batches:
            for at, texts in stretches(batch.column(1)):
                words, lens = words_of(texts)
                ends = np.cumsum(lens + 3)
                ids = np.full(int(ends[-1]), other + 1, np.int32)
                ids[np.arange(len(words)) + np.repeat(3 * np.arange(len(lens)) + 2, lens)] = places(words, *known, other)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), packed(ids, ends)], names=["key", "ids"])

    train = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1)
    out = train.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "key long, ids binary")
    turn = F.pmod(F.col("key"), F.lit(sum(ROUNDS)))
    return out.select(
        F.size(F.filter(F.array(*(F.lit(sum(ROUNDS[:k])) for k in range(1, len(ROUNDS)))), lambda x: x <= turn)).alias("round"),
        F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "ids",
    )


NAMES = ("R", "Q", "u", "v", "bias")
UPDATE = "name string, block long, part int, at binary, steps binary, squares binary, x binary"


def average(rows: pa.Table) -> pa.Table:
    """One block's moves of rows in several parts (UPDATE) to their averages by steps taken; parts in their order."""
    total = weight = squares = None
    for _, at, n, sq, x in sorted(zip(*(rows[k].to_pylist() for k in ("part", "at", "steps", "squares", "x")), strict=True)):
        at, n, sq = np.frombuffer(at, np.int32), np.frombuffer(n, np.float32).astype(np.float64), np.frombuffer(sq, np.float32)
        x = np.frombuffer(x, np.float16).reshape(len(at), -1)
        if total is None:
            total, weight, squares = np.zeros((ROWS, x.shape[1])), np.zeros(ROWS), np.zeros(ROWS)
        total[at] += x * n[:, None]
        squares[at] += sq * n
        weight[at] += n
    at = np.flatnonzero(weight)
    w = weight[at]
    held = [at.astype(np.int32), w.astype(np.float32), (squares[at] / w).astype(np.float32), (total[at] / w[:, None]).astype(np.float16)]
    return pa.table([rows["name"][:1], rows["block"][:1], rows["part"][:1], *(pa.array([y.tobytes()], pa.binary()) for y in held)], names=["name", "block", "part", "at", "steps", "squares", "x"])


def halved(model: dict) -> dict:
    """Parameters as they are sent: in half precision."""
    return model | {k: model[k].astype(np.float16) for k in NAMES}


def whole(model: dict) -> dict:
    return model | {k: model[k].astype(np.float32) for k in NAMES}


def train_round(encoded: DataFrame, parts: int, model: dict, squares: dict, turn: int) -> tuple[dict, dict]:
    """One round over encoded documents: a task for each part takes steps from the same parameters over all its documents,
    in the order of their keys, and each row of parameters (and its sum of squares) moves by the average over the parts that
    took steps on it, by their number. A task passes on only such rows, in half precision, so what is shuffled follows the
    input."""
    sc = encoded.sparkSession.sparkContext
    base = whole(halved(model))
    shipped = sc.broadcast((halved(model), squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, before = shipped.value
        m, part = whole(half), TaskContext.get().partitionId()
        s, n = {k: before[k].copy() for k in NAMES}, {k: np.zeros(len(m[k]), np.float32) for k in NAMES}
        cdf, r = np.cumsum(m["share"][: tree(m)[3]], dtype=np.float64), np.random.default_rng([5, turn, part])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [np.frombuffer(t.as_buffer(), np.int32) for t in batch.column(0).slice(at, 256)]
                x = np.concatenate(texts)
                target = np.ones(len(x), bool)
                first = np.cumsum([0, *map(len, texts)])[:-1]
                target[first] = target[first + 1] = False
                for k in range(0, len(x) - 2, BATCH):
                    nce_step(m, s, n, x[k : k + BATCH + 2], target[k + 2 : k + BATCH + 2], r, cdf, RATE)
        for name in NAMES:
            for k in range(0, len(m[name]), ROWS):
                at = np.flatnonzero(n[name][k : k + ROWS])
                if len(at):
                    old = half[name][k + at].astype(np.float32)
                    held = [at.astype(np.int32), n[name][k + at], s[name][k + at], (m[name][k + at] - old).astype(np.float16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // ROWS]), pa.array([part], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in held)], names=["name", "block", "part", "at", "steps", "squares", "x"])

    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("key").select("ids")
    got = dealt.mapInArrow(run, UPDATE).groupBy("name", "block").applyInArrow(average, UPDATE).select("name", "block", "at", "squares", "x").toArrow()
    out, sums = base | {k: base[k].copy() for k in NAMES}, {k: squares[k].copy() for k in NAMES}
    for name, block, at, sq, x in zip(*(c.to_pylist() for c in got.columns), strict=True):
        at = np.frombuffer(at, np.int32) + block * ROWS
        out[name][at] += np.frombuffer(x, np.float16).reshape(out[name][at].shape)
        sums[name][at] = np.frombuffer(sq, np.float32)
    shipped.unpersist()
    return out, sums


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, n) of about the `most` most frequent words, best first. A histogram of counts by sixteenths of an octave gives
    the lowest count that is taken; of the step in which that falls, words are taken by a hash, as many as are missing."""
    step = F.floor(F.log2("n") * 16)
    left, last, share = most, None, 0.0
    for last, n in sorted(counts.groupBy(step.alias("step")).agg(F.count("*")).collect(), reverse=True):
        if n > left:
            share = left / n
            break
        left -= n
        share = 1.0
    if last is None:
        return []
    chosen = (step > last) | (step == last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = counts.filter(chosen).toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes what queries that start and end in here have shuffled as soon as each ends, not when the driver's memory is next
    cleared: a round's moves are no longer needed when the next one starts."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<binary>"


def score_texts(docs: DataFrame, model: dict, words, tail: float) -> DataFrame:
    """SCORED rows. words: broadcast (word -> place, counts); logs: sum of log10(c + 0.5) of the known ones; score: log10
    probability, without log10(c + 0.5) of `rare` words (all occurrences), which are in no broadcast count. tail: log10 of the
    other class's size."""
    shipped, other = docs.sparkSession.sparkContext.broadcast(halved(model)), len(model["R"]) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, counts), m = words.value, whole(shipped.value)
        logs = np.log10(np.asarray(counts) + 0.5)
        outside = (logs - tail) * (np.arange(len(logs)) >= other)  # the vocabulary's places come first
        outside[place[END]] = 0
        numbers = keyed(place)
        key = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for at, texts in stretches(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                said, lens = words_of(texts)
                lens += 1
                first = np.cumsum(lens) - lens
                flat = np.full(int(lens.sum()), place[END], np.int32)
                word_at = np.arange(len(said)) + np.repeat(np.arange(len(lens)), lens - 1)
                flat[word_at] = places(said, *numbers, -1)
                known = flat >= 0
                own = np.where(known & (flat < other), flat, other).astype(np.int32)
                own[first + lens - 1] = other + 1
                a, b, w = positions(own, first, other)
                lp = log_probs(m, a, b, w) / LN10
                lp += np.where(known, outside[flat], -tail)
                unknown = ~known
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(unknown, first, dtype=np.int64))]), pa.int32()), said.filter(pa.array(unknown[word_at])))
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key + 1, key + 1 + len(lens))), ids.cast(pa.int64()), pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(lens, pa.int64()), pa.array(add(known.astype(np.int64))), pa.array(add(np.where(known, logs[flat], 0.0))), pa.array(add(lp)), rare],
                    names=["key", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"],
                )
                key += len(lens)

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, scratch: Scratch, *, least: int = LEAST, head: int = HEAD, known: int = KNOWN, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per row of docs (doc_id, text; others ignored): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10).

    Counts and training cover every training document, once. Null and empty texts are the end alone. Null ids train.
    Repeated rows count as often and are scored alike. No training document: every count is 0 and the model is uniform over
    its classes. Empty table: empty result. The model's words are the GROWTH * sqrt(training tokens) best ones of count
    `least` and more (MOST_WORDS at most), and the `head` best ones in any case; their counts and parameters are gathered and
    broadcast, besides counts of other words up to `known` in all. The rest of the counts is joined.
    """
    spark = docs.sparkSession
    with freed(spark):
        counts = scratch.write(count_tokens(docs))
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    size = min(MOST_WORDS, int(GROWTH * total**0.5))
    top = frequent(counts.filter(F.octet_length("word") > 0), max(known, size))
    ends = (counts.filter(F.octet_length("word") == 0).first() or (END, 0))[1]
    head = max(min(head, len(top)), min(size, sum(n >= least for _, n in top)))
    in_head = sum(n for _, n in top[:head])
    other = total - in_head - ends
    model = start([n for _, n in top[:head]], other, ends)
    sc = spark.sparkContext
    place = sc.broadcast({w: i for i, (w, _) in enumerate(top[:head])} | {END: head + 1})
    if total:
        parts, squares = -(-total // part_tokens), {k: np.zeros(len(model[k]), np.float32) for k in NAMES}
        at = scratch.path()
        encode(docs, place, head, parts).write.partitionBy("round").parquet(at)
        encoded = spark.read.schema("part int, key long, ids binary, round int").parquet(at)
        with freed(spark):
            for turn in range(len(ROUNDS)):
                model, squares = train_round(encoded.filter(F.col("round") == turn), parts, model, squares, turn)
        delete(spark, at)
    model = whole(halved(model))
    # Places: words of the model, one that no word has, the end, then the other known words.
    where = {w: i for i, (w, _) in enumerate(top[:head])} | {END: head + 1} | {w: head + 2 + i for i, (w, _) in enumerate(top[head:])}
    words = sc.broadcast((where, [n for _, n in top[:head]] + [0, ends] + [n for _, n in top[head:]]))
    tail = float(np.log10(other + 0.5 * (max(0, distinct - head - bool(ends)) + 1)))
    scored = scratch.write(score_texts(docs, model, words, tail))
    rare = scored.select("key", F.explode("rare").alias("word")).groupBy("key", "word").agg(F.count("*").alias("m"))
    logs = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rest = rare.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("m") * logs).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    base = F.log10(F.lit(float(total)) + 0.5 * F.lit(float(distinct + 1)))
    return scored.drop("rare").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") - F.when(F.lit(ends == 0), 1).otherwise(0) + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * base).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), Scratch(spark))
