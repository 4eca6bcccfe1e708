"""The data source of pages: error rows, groups as partitions, filters before anything is fetched."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from quern.sources import fetch


def archive(tmp_path) -> str:
    rows = [(i, f"https://h{i % 3}.org/{i}" if i % 10 else None, None if i % 7 == 0 else f"<p>{i}</p>") for i in range(100)]
    table = pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows], "extra": [0] * 100})
    pq.write_table(table, tmp_path / "pages.parquet", row_group_size=20)
    return str(tmp_path / "pages.parquet")


def test_every_page_is_a_row(spark, tmp_path):
    got = fetch.read_pages(spark, archive(tmp_path), groups=2)
    assert got.rdd.getNumPartitions() == 3
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == 100 and all((r.html is None) == (r.error is not None) for r in rows.values())
    assert rows[7].error == "LookupError: the archive has no content" and rows[8].html == "<p>8</p>"


def test_filters_come_before_fetching(spark, tmp_path):
    def only_some(page: dict) -> str:
        if not 30 <= page["page_id"] < 50:
            raise AssertionError("not asked for")
        if page["page_id"] == 40:
            raise TimeoutError("slow")
        return page["url"]

    pages = fetch.read_pages(spark, archive(tmp_path), only_some, "some_pages").filter("page_id >= 30 AND page_id < 50 AND url LIKE 'https://h1%' AND url IS NOT NULL")
    rows = pages.collect()
    assert {r.page_id for r in rows} == {i for i in range(30, 50) if i % 3 == 1 and i % 10}
    assert all(r.error is None for r in rows if r.page_id != 40) and pages.rdd.getNumPartitions() == 2
    failed = fetch.read_pages(spark, archive(tmp_path), only_some, "some_pages").filter("page_id IN (40, 41)").collect()
    assert sorted((r.page_id, r.error) for r in failed) == [(40, "TimeoutError: slow"), (41, None)]
    assert fetch.read_pages(spark, archive(tmp_path), only_some, "some_pages").filter("page_id > 1000").count() == 0
