"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces finds, end by end, every piece of a
text, and each match relaxes the best score of its end: Viterbi in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stands for a literal BLANK of the text while it is split; no UTF-8 text can hold it.
LITERAL = "\ud800"
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker remembers; beyond that the memory starts anew.
MEMORY = 400_000


def load_pieces(model: str = MODEL) -> dict:
    """Plain values of a model file: pieces (text, id, score), byte ids, and scores; control and unused pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    normal, byte_ids, score = [], [0] * 256, 0.0
    for i in range(sp.vocab_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
            normal.append((sp.id_to_piece(i), i, sp.get_score(i)))
            score = min(score, normal[-1][2])
    return {"pieces": normal, "bytes": byte_ids, "unknown": score - UNKNOWN_PENALTY, "size": sp.vocab_size()}


class Codec:
    """Encoder and decoder over load_pieces(). Every text comes back exactly: characters without a piece go by bytes, as
    does a literal BLANK, which otherwise stands for a space."""

    def __init__(self, pieces: dict, memory: int = MEMORY):
        self.byte_ids, self.unknown, self.memory = pieces["bytes"], pieces["unknown"], memory
        self.find = ahocorasick.Automaton()
        self.singles, alphabet = set(), set()
        table = [b""] * pieces["size"]
        for piece, i, score in pieces["pieces"]:
            self.find.add_word(piece, (len(piece), i, score))
            alphabet.update(piece)
            if len(piece) == 1:
                self.singles.add(piece)
            table[i] = piece.replace(BLANK, " ").encode()
        self.find.make_automaton()
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        self.table = table
        # No piece crosses a cut before a run of BLANKs, or beside a character of no piece: the chunks are independent.
        whole = any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces["pieces"])
        inner = "".join(re.escape(c) for c in sorted(alphabet - {BLANK}))
        self.chunks = re.compile(f"[{inner}{BLANK}]+|[^{inner}{BLANK}]" if whole else f"{BLANK}*[{inner}]+|{BLANK}+|[^{inner}{BLANK}]", re.S).findall
        self.known: dict[str, bytes] = {}

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation by sum of scores; of equals, the one whose last pieces are longest."""
        n = len(chunk)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        todo = [i for i, c in enumerate(chunk) if c not in self.singles]
        k = 0
        for end, (length, i, score) in self.find.iter(chunk):
            while k < len(todo) and todo[k] < end:
                self.relax_unknown(best, back, todo[k])
                k += 1
            s = best[end + 1 - length] + score
            if s > best[end + 1]:
                best[end + 1], back[end + 1] = s, (end + 1 - length, i)
        for at in todo[k:]:
            self.relax_unknown(best, back, at)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append([i] if i >= 0 else [self.byte_ids[b] for b in (BLANK if chunk[start] == LITERAL else chunk[start]).encode()])
            at = start
        return [i for part in reversed(out) for i in part]

    def relax_unknown(self, best: list, back: list, at: int) -> None:
        if best[at] + self.unknown > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + self.unknown, (at, -1)

    def __getitem__(self, chunk: str) -> bytes:
        out = self.known.get(chunk)
        if out is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            out = np.array(self.viterbi(chunk), np.int32).tobytes()
            if len(chunk) <= 64:
                self.known[chunk] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """int32 ids; null and empty texts have none."""
        if not text:
            return np.empty(0, np.int32)
        text = BLANK + (text.replace(BLANK, LITERAL) if BLANK in text else text).replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; without the blank that encoding puts first."""
        out = b"".join(map(self.table.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of docs (doc_id, text; others ignored): doc_id, n_tokens, token_ids array<int>, round_trip (the
    decoded ids are the text).

    Null and empty texts: no ids, round_trip true. Long texts are encoded whole, chunk by chunk. Repeated rows alike.
    No shuffle; the model is read once on the driver and sent as plain values (its size is the vocabulary's).
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512)
                ids = [codec.encode(t) for t in part.to_pylist()]
                same = [codec.decode(x) == (t.as_py() or b"") for x, t in zip(ids, part.cast(pa.binary()), strict=True)]
                lens = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(lens, pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give the empty text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int32)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
