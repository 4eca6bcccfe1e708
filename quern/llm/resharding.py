"""Sharding: from the shards' old sizes and new capacities, a minimum-cost flow says how many bytes go from where to
where; whole blocks of documents carry them out, and only files of shards that change are written again. The driver sees
blocks, whose number has a bound; rows are shuffled once, by the file that they go to."""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import Scratch, table

#: Blocks that old shards are cut into by hash: some LEAST_BLOCKS in all, so that sizes come near to equal, and more
#: where a block would hold more than BLOCK_BYTES; about MOST_BLOCKS at most, which bounds the plan that is gathered and sent
#: to all executors.
LEAST_BLOCKS, BLOCK_BYTES, MOST_BLOCKS = 8192, 64 << 20, 1_000_000
#: A file closes with the block that takes it to this size.
FILE_BYTES = 32 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each source to each sink that ships all supply at least cost, for any costs; successive shortest paths on
    the residual graph of a few dozen nodes. Raises ValueError if capacity is short."""
    n, m = len(supply), len(capacity)
    left, room, flow = list(supply), list(capacity), [[0] * m for _ in range(n)]
    if sum(left) > sum(room):
        raise ValueError("capacities are smaller than the shards")
    while any(left):
        # Bellman-Ford from every source that has supply left; nodes 0..n-1 sources, n.. sinks.
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        prev: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            moved = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]):
                        dist[n + j], prev[n + j], moved = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                        dist[i], prev[i], moved = dist[n + j] - cost[i][j], n + j, True
            if not moved:
                break
        end = min((j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda j: (dist[n + j], j))
        path, at = [], n + end
        while prev[at] is not None:
            path.append((prev[at], at))
            at = prev[at]
        amount = min([left[at], room[end], *(flow[v][u - n] for u, v in path if u >= n)])
        for u, v in path:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def cheapest_flow(supply: list[int], capacity: list[int]) -> list[dict[int, int]]:
    """The same where staying (source and sink of one number) costs nothing and moving one a byte: what fits stays, which no
    flow can better, and the rest fills what room is left, in order. By source: sink to bytes, n + m entries in all."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than the shards")
    stay = [min(a, capacity[i]) if i < len(capacity) else 0 for i, a in enumerate(supply)]
    room = [c - (stay[j] if j < len(stay) else 0) for j, c in enumerate(capacity)]
    out, j = [{i: x} if x else {} for i, x in enumerate(stay)], 0
    for i, left in enumerate(a - x for a, x in zip(supply, stay, strict=True)):
        while left:
            amount = min(left, room[j])
            if amount:
                out[i][j] = out[i].get(j, 0) + amount
                left -= amount
                room[j] -= amount
            if left:
                j += 1
    return out


@dataclass
class Move:
    old: int
    block: int
    shard: int
    size: int
    rows: int
    file: int = 0
    offset: int = 0


def plan_moves(blocks: list[tuple[int, int, int, int]], old_ids: list[int], new_ids: list[int], file_bytes: int = FILE_BYTES) -> list[Move]:
    """Target of every block (old shard, block, bytes, rows), its file there (numbered over all shards), and the place of
    the file's first row in the shard. Blocks go from the largest down to the target with most of its flow still open, so
    shards differ by about one small block. old_ids and new_ids count from 0."""
    size: dict[int, int] = defaultdict(int)
    for old, _, b, _ in blocks:
        size[old] += b
    total = sum(size.values())
    share = [total // len(new_ids) + (k < total % len(new_ids)) for k in range(len(new_ids))]
    flow = cheapest_flow([size[o] for o in old_ids], share)
    # The fullest target of an old shard first; of equally full ones its own, then the first.
    open_ = {o: [(-amount, to != o, to) for to, amount in f.items()] for o, f in zip(old_ids, flow, strict=True)}
    for heap in open_.values():
        heapq.heapify(heap)
    out = []
    for old, block, b, rows in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        amount, moves, to = open_[old][0]
        heapq.heapreplace(open_[old], (amount + b, moves, to))
        out.append(Move(old, block, to, b, rows))
    file, at, filled, last = -1, 0, 0, None
    start = 0
    for x in sorted(out, key=lambda x: (x.shard, x.old, x.block)):
        if x.shard != last:
            at, filled, last = 0, file_bytes, x.shard
        if filled >= file_bytes:
            file, filled, start = file + 1, 0, at
        x.file, x.offset = file, start
        at += x.rows
        filled += x.size
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null: none plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def block_of(sizes: dict[int, int], blocks: int | None) -> Column:
    """The block of a row of old shard rs_old, by a hash of its id."""
    total = max(1, sum(sizes.values()))
    most = max(BLOCK_BYTES, 2 * total // MOST_BLOCKS)
    number = {o: blocks or max(-(-LEAST_BLOCKS // len(sizes)) if len(sizes) < LEAST_BLOCKS else 1, -(-n // most)) for o, n in sizes.items()}
    common = min(number.values(), default=1)
    n = F.lit(common)
    for o, k in number.items():
        n = F.when(F.col("rs_old") == o, k).otherwise(n) if k != common else n
    return F.pmod(F.xxhash64(F.lit(17), "doc_id"), n).cast("int")


@dataclass
class Resharding:
    """Rows with their plan. rows: the table's columns in a struct `row`, rs_old, rs_block, rs_size, rs_tie, rs_shard,
    rs_file and rs_offset; changed: shards that don't keep exactly their rows."""

    rows: DataFrame
    changed: list[int]
    shards: int = 0

    def numbered(self) -> DataFrame:
        """With rs_slot: the place in the shard. The one shuffle, by file."""
        order = Window.partitionBy("rs_file").orderBy("rs_old", "rs_block", "rs_doc", "rs_tie")
        return self.rows.withColumn("rs_slot", (F.col("rs_offset") + F.row_number().over(order) - 1).cast("long"))

    def write(self, out: str) -> DataFrame:
        """Writes the shards that change to `out`/shard=K, and returns where every row is: rs_shard, rs_slot and the row's
        own columns, in a struct `row`, read from what was written and, for the others, from the table."""
        hit, columns = F.col("rs_shard").isin(self.changed), ("row", "rs_old", "rs_size", "rs_shard", "rs_slot")
        stay = Resharding(self.rows.filter(~hit), []).numbered().select(*columns)
        if not self.changed:
            return stay
        Resharding(self.rows.filter(hit), []).numbered().select(*columns, F.col("rs_shard").alias("shard")).write.partitionBy("shard").parquet(out)
        again = self.rows.sparkSession.read.schema(stay.schema).parquet(out).select(*columns)
        return again if len(self.changed) == self.shards else again.unionByName(stay)


def plan_of(docs: DataFrame, old: Column, *, old_shards: int, shards: int, blocks: int | None = None, file_bytes: int = FILE_BYTES) -> Resharding:
    spark = docs.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = {"rs_old": old.cast("int"), "rs_doc": F.col("doc_id"), "rs_size": text_size(F.col("text")), "rs_tie": F.coalesce(F.xxhash64("text"), F.lit(0))}
    rows = docs.select(row.alias("row"), *(c.alias(n) for n, c in own.items()), "doc_id")
    sizes = dict.fromkeys(range(old_shards), 0) | {r[0]: r[1] for r in rows.groupBy("rs_old").agg(F.sum("rs_size")).collect()}
    rows = rows.withColumn("rs_block", block_of(sizes, blocks)).drop("doc_id")
    sums = rows.groupBy("rs_old", "rs_block").agg(F.sum("rs_size"), F.count("*")).collect()
    moves = plan_moves([tuple(r) for r in sums], list(range(old_shards)), list(range(shards)), file_bytes)
    changed = sorted({x.shard for x in moves if x.shard != x.old} | {x.old for x in moves if x.shard != x.old and x.old < shards})
    plan = spark.createDataFrame([(x.old, x.block, x.shard, x.file, x.offset) for x in moves], "rs_o int, rs_b int, rs_shard int, rs_file int, rs_offset long")
    joined = rows.join(F.broadcast(plan), (F.col("rs_old") == F.col("rs_o")) & (F.col("rs_block") == F.col("rs_b")))
    return Resharding(joined.drop("rs_o", "rs_b"), changed, shards)


def reshard(docs: DataFrame, old: Column, *, old_shards: int, shards: int, blocks: int | None = None, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs (doc_id, text, others) with rs_old, rs_block, rs_size, rs_shard and rs_slot (gapless from 0 in a shard).

    Law: bytes. `old` is the shard that holds a row now, from 0 to old_shards - 1. The driver gathers one row per block and
    solves the flow; blocks are told by a hash of the document id, so a group of equal texts, a source or an old shard of a
    third of all rows is dealt over as many blocks as its share. A document larger than a shard's share fills a shard alone.
    Null ids and texts are rows like others; repeated rows get slots of their own. Empty table: empty result. `carry` names
    the columns that go through the shuffle that numbers the slots (all by default); columns of the names added are replaced.
    """
    made = plan_of(docs, old, old_shards=old_shards, shards=shards, blocks=blocks)
    keep, added = list(docs.columns if carry is None else carry), ("rs_old", "rs_block", "rs_size", "rs_shard", "rs_slot")
    slim = made.rows.withColumn("row", F.struct(*(F.col("row").getField(c).alias(c) for c in keep)))
    return Resharding(slim, made.changed).numbered().select(*(F.col("row").getField(c).alias(c) for c in keep if c not in added), *added)


def rewrite_files(docs: DataFrame, old: Column, out: str, *, old_shards: int, shards: int, blocks: int | None = None) -> list[int]:
    """Write the shards that change to `out`/shard=K and return their numbers; a shard that keeps exactly its rows is not
    written. Rows of a shard go to files of about FILE_BYTES, in the order of their slots."""
    made = plan_of(docs, old, old_shards=old_shards, shards=shards, blocks=blocks)
    if made.changed:
        rows = made.numbered().filter(F.col("rs_shard").isin(made.changed))
        rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"), F.col("rs_shard").alias("shard")).write.partitionBy("shard").parquet(out)
    return made.changed


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by hash of the id to eight of equal bytes: the shards are written, and sizes and checksums are those
    of the texts read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = plan_of(docs, F.pmod(F.xxhash64("doc_id"), F.lit(6)), old_shards=6, shards=8).write(Scratch(spark).path())
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        text_size(F.col("row.text")).alias("size"),
        F.coalesce(F.crc32("row.text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("rs_shard").alias("shard"),
        F.col("rs_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("rs_old").alias("old_shard"),
    )
