"""Exactly-once ingest: a ledger of committed batches beside the rows and the manifest that they wrote.

A batch writes its rows, then its part of the manifest, then one empty file in the ledger. Only what the ledger names is read,
so a batch that fails in between is as if it had not been, and writes over its own leavings when it is run again; a batch that
the ledger holds does nothing. Nothing is kept in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import incremental
from quern.sources.scratch import create_once, names_in

#: Batches that one run of a stream can number.
BATCHES = 1_000_000_000


class Ledger:
    """Rows of sources (column slug, others of `schema`) and their hashes, in a folder. `epoch` numbers the streams that
    write to it one after the other; a stream that goes on from its checkpoint keeps its epoch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def committed(self) -> list[int]:
        """Places in the ledger: 2 n for batch n, 2 n + 1 for all up to it as one."""
        return [int(n) for n in names_in(self.spark, f"{self.path}/ledger")]

    def _read(self, what: str, schema: str) -> DataFrame:
        done = [f"{self.path}/{what}/number={n}" for n in self.committed()]
        reader = self.spark.read.schema(f"{schema}, number long")
        return reader.option("basePath", f"{self.path}/{what}").parquet(*done) if done else self.spark.createDataFrame([], f"{schema}, number long")

    def manifest(self) -> DataFrame:
        """slug, file_hash, number: the last committed hash of each source, and the batch that wrote it."""
        return self._read("manifest", "slug string, file_hash string").groupBy("slug").agg(F.max_by("file_hash", "number").alias("file_hash"), F.max("number").alias("number"))

    def rows(self) -> DataFrame:
        """The rows of each source's last committed batch."""
        return self._read("rows", self.schema).join(self.manifest().select("slug", "number"), ["slug", "number"], "left_semi").drop("number")

    def apply(self, number: int, sources: DataFrame) -> bool:
        """Commits the new and changed ones of sources (slug, file_hash, columns of the schema; a slug's rows share their
        hash) as batch `number`; False if the ledger has it. Rows without slug are left out; of a slug with several hashes
        the greatest counts."""
        number *= 2
        if number in self.committed():
            return False
        last = sources.filter("slug IS NOT NULL").groupBy("slug").agg(F.max("file_hash").alias("file_hash"))
        new = incremental.changed_sources(last, self.manifest()).filter("is_new").select("slug", "file_hash")
        self._write("rows", number, sources.join(new, ["slug", "file_hash"], "left_semi").select(*(c.split()[0] for c in self.schema.split(", "))))
        self._write("manifest", number, new)
        return create_once(self.spark, f"{self.path}/ledger/{number:020d}")

    def _write(self, what: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{what}/number={number}")

    def ingest(self, stream: DataFrame, checkpoint: str, epoch: int = 0) -> StreamingQuery:
        """Applies each batch of a stream of sources until all that is there is read."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.apply(epoch * BATCHES + n, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self) -> int:
        """The state as one batch, placed behind the last one; returns how many it stands for. Until it is committed readers
        use the old ones, and after that these only lose to it."""
        done = self.committed()
        if len(done) > 1:
            number = max(done) | 1
            self._write("rows", number, self.rows())
            self._write("manifest", number, self.manifest().select("slug", "file_hash"))
            create_once(self.spark, f"{self.path}/ledger/{number:020d}")
        return len(done)
