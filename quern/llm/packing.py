"""Packing: whole texts become token ids, and sum-of-squares online packing puts them into windows of a fixed length.

A document comes in, and goes to the fill level that leaves the sum of the squared counts of partly filled windows
smallest; an array by level holds these counts. So no level gathers windows that wait for one fitting length."""

from __future__ import annotations

import os
import re
import sys
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

WINDOW, END_ID = 2048, 1
#: Windows that a task holds open; beyond it they are filled up by cutting, so a task's memory has a bound.
MOST_OPEN = 2048
#: Chunks of text that a worker remembers, in all and in characters each; beyond that the memory starts anew.
MEMORY, REMEMBERED = 1_000_000, 64
#: What an empty level takes off.
NEVER = -(1 << 29)
#: Sequences of one task; its number goes above.
TASK_BITS = 40
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Ids(dict):
    """Chunk of text to its token ids, little-endian unsigned 32-bit.

    The tokenizer drops white space, lowers case character by character and composes characters; none of that reaches over
    a blank, so chunks are encoded alone and remembered. Chunks of plain letters, digits and marks fall into words, which
    go straight to the merges; every other chunk goes through the whole tokenizer."""

    #: Bytes of Latin-1 that keep a text from being lowered and split first, besides special tokens and all other characters.
    rare = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    plain = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
    parts = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
    chunks = re.compile(r"[^ \t\n\r]+")
    #: The printable stand-ins of bytes in byte-level vocabularies; bytes of these letters from 0x80 to 0xFF.
    stand_in = {c: "".join(chr(b) if b > 0xA0 and b != 0xAD else chr(0x100 + 33 + b - 0x7F if b <= 0xA0 else 0x143) for b in chr(c).encode()) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}

    def __init__(self, model: str, memory: int = MEMORY):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.memory, self.new = Tokenizer.from_file(model), memory, {}
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")

    def common(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.rare)) == len(raw) and b"<|" not in raw

    def __missing__(self, chunk: str) -> bytearray:
        self[chunk] = self.new[chunk] = cell = bytearray()  # filled when the slice's chunks are all known
        return cell

    def learn(self, words: list[str]) -> None:
        """Ids of words of plain letters, many in one call."""
        groups = [words[at : at + 200] for at in range(0, len(words), 200)]
        plain = [" ".join([w if w.isascii() else w.translate(self.stand_in) for w in g]) for g in groups]
        for group, done in zip(groups, self.merges.encode_batch(plain, add_special_tokens=False), strict=True):
            ids, edges = np.array(done.ids, "<u4").tobytes(), np.flatnonzero(np.diff(done.word_ids, prepend=-1, append=-1)) * 4
            self.update(zip(group, [ids[a:b] for a, b in pairwise(edges.tolist())], strict=True))

    def fill(self) -> None:
        """Gives all new chunks their ids."""
        new, words, whole, parted = self.new, [], [], {}
        for c in new:
            plain = self.plain.fullmatch(c) and "<|" not in c
            if plain and len(parts := self.parts.findall(c)) > 1:
                parted[c] = parts
            else:
                (words if plain and c.isalpha() else whole).append(c)
        for p in {p for parts in parted.values() for p in parts if p not in self}:
            (words if p.isalpha() else whole).append(p)
        self.learn(words)
        for c in whole:
            self[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        for c, parts in parted.items():
            self[c] = b"".join([self[p] for p in parts])
        for c, cell in new.items():
            cell += self[c]
        for c in [c for c in new if len(c) > REMEMBERED]:
            del self[c]
        self.new = {}

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of whole texts; of null and empty ones: none."""
        if len(self) >= self.memory:
            self.clear()
        parts = [list(map(self.__getitem__, t.lower().split() if self.common(t) else self.chunks.findall(t))) if t else () for t in texts]
        self.fill()
        return map(b"".join, parts)


def remembered(model: str) -> Ids:
    """The memory of this worker, which lives on from task to task."""
    home = sys.modules.setdefault("quern_worker_memory", ModuleType("quern_worker_memory")).__dict__
    if model not in home:
        home[model] = Ids(model)
    return home[model]


class SumOfSquares:
    """Windows of `size` tokens. A piece is (key, start, ids, total): a document's ids from `start` on, of `total`.

    put() gives back the windows that it fills, each a list of pieces; rest() what is still open, cut so that all windows
    but the last are full, and the last one in parts whose lengths are powers of two, which need no padding."""

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN):
        self.size, self.most_open, self.n_open = size, most_open, 0
        #: Number of windows by level, and from it what a window more at a level adds to the sum of squares, and one less takes off.
        self.level = np.zeros(size + 1, np.int32)
        self.more = 2 * self.level + 1
        self.more[size] = 0
        self.less = np.full(size + 1, NEVER, np.int32)
        self.less[0] = 0
        self.open: list[list] = [[] for _ in range(size + 1)]

    def count(self, at: int, by: int) -> None:
        self.level[at] += by
        n, self.n_open = int(self.level[at]), self.n_open + by
        self.more[at] = 2 * n + 1
        self.less[at] = 2 * n - 1 if n else NEVER

    def best(self, length: int) -> int:
        """The level that takes a piece of `length`; of equal ones the fullest, 0 for a new window."""
        change = self.more[length:] - self.less[: self.size + 1 - length]
        return self.size - length - int(np.argmin(change[::-1]))

    def put(self, key: int, ids: np.ndarray) -> Iterator[list]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [(key, at, ids[at : at + self.size], total)]
            at += self.size
        length = total - at
        if not length:
            return
        level = self.best(length)
        window = self.open[level].pop() if level else []
        if level:
            self.count(level, -1)
        window.append((key, at, ids[at:], total))
        if level + length == self.size:
            yield window
            return
        self.open[level + length].append(window)
        self.count(level + length, 1)
        if self.n_open > self.most_open:
            yield from self.drain()

    def drain(self) -> Iterator[list]:
        """Open windows poured into each other from the fullest down, with cuts, until one at most is not full; it stays open."""
        pieces = deque(p for windows in reversed(self.open) for w in windows for p in w)
        for level in np.flatnonzero(self.level):
            self.open[level].clear()
            self.count(level, -int(self.level[level]))
        window, room = [], self.size
        for key, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((key, start, part, total))
                start, room = start + len(part), room - len(part)
                if not room:
                    yield window
                    window, room = [], self.size
        if window:
            self.open[self.size - room].append(window)
            self.count(self.size - room, 1)

    def rest(self) -> Iterator[list]:
        yield from self.drain()
        for level in map(int, np.flatnonzero(self.level)):
            window, part, room = self.open[level].pop(), [], 0
            self.count(level, -1)
            for key, start, ids, total in window:
                while len(ids):
                    room = room or 1 << (level.bit_length() - 1)
                    part.append((key, start, ids[:room], total))
                    used = len(part[-1][2])
                    start, ids, level, room = start + used, ids[used:], level - used, room - used
                    if not room:
                        yield part
                        part = []


def pack_documents(docs: DataFrame, model: str | None = None, *, size: int = WINDOW, end_id: int = END_ID, most_open: int = MOST_OPEN) -> DataFrame:
    """docs (doc_id, text; others ignored) as pieces in sequences of at most `size` tokens: doc_id, start (ids of the row's
    document before it), length, ids (little-endian unsigned 32-bit, as binary), doc_tokens (with `end_id`, which ends each
    document), sequence_id, offset (place in the sequence, gapless from 0).

    A document is cut where it is longer than a window, and where windows that wait are filled up. Null and empty texts are
    `end_id` alone; repeated rows are packed each; null ids stay null. Empty table: empty result. Long texts are encoded
    chunk by chunk, and their full windows leave at once.

    No shuffle: each task packs the rows that it reads, so sequences depend on how the table lies, and a task that is run
    again gives the same ones if its input has the same order, as a table's files do. A task holds `most_open` windows at
    most. Sequences are full but for some of the task's last tokens, whose sequences have a power of two as length.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer, sequence = remembered(model), SumOfSquares(size, most_open), TaskContext.get().partitionId() << TASK_BITS
        end = np.array([end_id], "<u4").tobytes()

        def rows(windows: Iterable[list]) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(7)]
            for window in windows:
                offset = 0
                for key, start, ids, total in window:
                    for c, v in zip(cols, (key, start, len(ids), ids.tobytes(), total, sequence, offset), strict=True):
                        c.append(v)
                    offset += len(ids)
                sequence += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = zip(part.column(0).to_pylist(), known.of(part.column(1).to_pylist()), strict=True)
                yield rows(w for key, ids in texts for w in packer.put(key, np.frombuffer(ids + end, "<u4")))
        yield rows(packer.rest())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence of pack_documents(): sequence_id, ids (binary), documents (array of doc_id, offset, length in
    order: where attention may not reach over). A sequence has a window's tokens at most."""
    piece = F.struct("offset", "doc_id", "length", "ids")
    out = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return out.select("sequence_id", joined.alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
