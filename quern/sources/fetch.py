"""Pages as a data source of Spark: what fetches a page is a parameter, and a page that can't be fetched is a row with its
error. The default fetches from an archive, a Parquet table (page_id, url, html), without a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import pyarrow.dataset as pad
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

#: A row of the archive (page_id, url, html) to the page's text; it raises what went wrong.
Fetch = Callable[[dict], str]
FORMAT, SCHEMA = "pages_by_fetch", "page_id long, url string, html string, error string"
#: Row groups of the archive that one partition fetches.
GROUPS = 1
#: Pages that are fetched and passed on together.
BATCH = 256
KNOWN = ("page_id", "url")


def archived(page: dict) -> str:
    if page["html"] is None:
        raise LookupError("the archive has no content")
    return page["html"]


@dataclass
class Groups(InputPartition):
    """Row groups of a file."""

    file: str
    groups: list[int]


def condition(f: Filter) -> pad.Expression | None:
    """A filter on the archive's own columns as an expression of its reader; None: Spark has to do it."""
    if len(f.attribute) != 1 or f.attribute[0] not in KNOWN:
        return None
    c = pad.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return c.is_valid()
    if isinstance(f, EqualTo):
        return c == f.value
    if isinstance(f, In):
        return c.isin(list(f.value))
    if isinstance(f, StringStartsWith):
        return pa.compute.starts_with(c, f.value)
    for of, make in ((GreaterThan, c.__gt__), (GreaterThanOrEqual, c.__ge__), (LessThan, c.__lt__), (LessThanOrEqual, c.__le__)):
        if type(f) is of:
            return make(f.value)
    return None


class PageReader(DataSourceReader):
    def __init__(self, path: str, groups: int, fetch: Fetch):
        self.path, self.groups, self.fetch, self.wanted = path, groups, fetch, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            c = condition(f)
            if c is None:
                yield f
            else:
                self.wanted = c if self.wanted is None else self.wanted & c

    def dataset(self, file: str | None = None) -> pad.Dataset:
        return pad.dataset(file or self.path.removeprefix("file://"), format="parquet")

    def partitions(self) -> list[InputPartition]:
        """Groups of row groups; those that the pushed filters rule out by their statistics are left out."""
        out = []
        for fragment in self.dataset().get_fragments(filter=self.wanted):
            ids = [g.id for part in fragment.split_by_row_group(filter=self.wanted) for g in part.row_groups]
            out += [Groups(fragment.path, ids[i : i + self.groups]) for i in range(0, len(ids), self.groups)]
        return out

    def read(self, partition: Groups | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no row group is left
            return
        for fragment in self.dataset(partition.file).get_fragments():
            for batch in fragment.subset(row_group_ids=partition.groups).to_batches(columns=["page_id", "url", "html"], filter=self.wanted, batch_size=BATCH):
                rows = [self.fetched(p) for p in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), *[pa.string()] * 3)], names=["page_id", "url", "html", "error"])

    def fetched(self, page: dict) -> tuple:
        try:
            return page["page_id"], page["url"], self.fetch(page), None
        except Exception as e:  # a page that fails is a row
            return page["page_id"], page["url"], None, f"{type(e).__name__}: {e}"


def source_of(fetch: Fetch = archived, name: str = FORMAT) -> type[DataSource]:
    """A data source that fetches with `fetch`. Options: path, the archive; groups, row groups in a partition."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(self.options["path"], int(self.options.get("groups", GROUPS)), fetch)

    return Pages


def read_pages(spark: SparkSession, path: str, fetch: Fetch = archived, name: str = FORMAT, groups: int = GROUPS) -> DataFrame:
    """page_id, url, html, error of the pages that an archive lists: exactly one of html and error is null. Filters on page_id
    and url are made before anything is fetched. The archive must be in a store that Arrow reads, by the same path on all
    machines."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(fetch, name))
    return spark.read.format(name).option("path", path).option("groups", groups).load()
