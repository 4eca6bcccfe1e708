import json

import pytest
from pyspark.sql import functions as F

from quern.operators import incremental
from quern.plans import fixtures as X
from quern.sources import files


def test_corpus_round(spark, tmp_path):
    chunks = [{"chunk_id": 3, "section_title": "T", "document_text": "x" * 50}, {"chunk_id": "b", "document_text": None}]
    (tmp_path / "doc_chunks.json").write_text(json.dumps(chunks))
    (tmp_path / "doc_full_doc.md").write_text("<!-- chunk_id=3 | T -->\n\n" + "words " * 20)
    got = files.read_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.slug, r.chunk_id) for r in got] == [("doc", "3"), ("doc", "b")]
    assert files.read_views(spark, str(tmp_path)).first().slug == "doc"
    kids = incremental.children(files.read_chunks(spark, str(tmp_path)), files.read_views(spark, str(tmp_path))).collect()
    assert [k.child_id for k in kids] == ["doc__3__p0"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a_chunks.json").write_text("[]")
    at = str(tmp_path / "manifest")
    assert files.read_manifest(spark, at).count() == 0
    now = files.read_hashes(spark, str(tmp_path))
    assert incremental.changed_sources(now, files.read_manifest(spark, at)).first().is_new
    files.write_manifest(now, at)
    assert not incremental.changed_sources(now, files.read_manifest(spark, at)).first().is_new


def test_tree(spark, tmp_path):
    for name in ("a.v", "d/b.S", "d/c.svg", "1/2/3/4/5/6/deep.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    got = {(r.name, r.source_type, r.file_slug) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.v", "VERILOG", "a"), ("b.S", "ASM", "b")}


def test_instructions_and_writers(spark, tmp_path):
    (tmp_path / "isa.json").write_text(json.dumps({"name": "n", "xlen": 32, "num_registers": 32, "instructions": [{"mnemonic": "ADD", "format": "R", "opcode": "0110011", "funct3": "000", "funct7b5": 0}, {"mnemonic": "LUI", "format": "U", "opcode": "0110111", "funct3": None, "funct7b5": None}]}))
    assert [r.mnemonic for r in files.read_instructions(spark, str(tmp_path / "isa.json")).orderBy("ord").collect()] == ["ADD", "LUI"]
    out = str(tmp_path / "chunks")
    files.write_chunks(X.PARENTS.df(spark), out)
    files.write_chunks(X.PARENTS.df(spark).filter("slug = 'bare'").withColumn("section_title", F.lit("again")), out)
    assert spark.read.parquet(out).filter("section_title = 'again'").count() == 2 and spark.read.parquet(out).count() == 5
    files.write_run(X.PATHS.df(spark), str(tmp_path / "runs"), 1)
    assert spark.read.parquet(str(tmp_path / "runs")).first().version == 1
    assert "| a | 1 |" in files.run_report(spark.createDataFrame([("a", 1)], "name string, value int"), "R").first().text
    files.write_texts(spark.createDataFrame([("m", "x\ny")], "module string, text string"), str(tmp_path / "t"), "module")
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_facts_spans_and_hierarchy(spark, tmp_path):
    (tmp_path / "facts.json").write_text('{"alu_operations": ["ADD", "SUB"], "branch_conditions": ["EQ"], "other": 1}')
    got = [tuple(r) for r in files.read_facts(spark, str(tmp_path / "facts.json")).collect()]
    assert sorted(got) == [("alu", 0, "ADD"), ("alu", 1, "SUB"), ("branch", 0, "EQ")]
    (tmp_path / "spans").mkdir()
    (tmp_path / "spans" / "m.json").write_text('{"doc": "m", "page": 1, "seq": 1, "text": "words", "size": 10}\n{"doc": "m", "page": 1, "seq": 2, "text": "  ", "size": 10}\n')
    assert [r.text for r in files.read_spans(spark, str(tmp_path / "spans")).collect()] == ["words"]
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    words = "A sentence of the first part that is long enough. " * 3
    for slug in ("a", "b"):
        (corpus / f"{slug}_chunks.json").write_text('[{"chunk_id": "%s_0", "section_title": "T", "document_text": "%s"}]' % (slug, words + slug))
    (corpus / "a_full_doc.md").write_text(f"<!-- chunk_id=a_0 | T -->\n\n{words}\n")
    manifest = str(tmp_path / "manifest")
    parents, kids, new = files.hierarchy(spark, str(corpus), manifest)
    assert parents.count() == 2 and {r.slug for r in kids.collect()} == {r.slug for r in new.collect()} == {"a", "b"}
    files.write_manifest(files.read_hashes(spark, str(corpus)).filter("slug = 'a'"), manifest)
    _, kids, new = files.hierarchy(spark, str(corpus), manifest)
    assert {r.slug for r in kids.collect()} == {"a", "b"} and {r.slug for r in new.collect()} == {"b"}


def test_two_writers_get_two_versions_and_a_torn_run_is_never_read(spark):
    from concurrent.futures import ThreadPoolExecutor

    from quern.sources import files
    from quern.sources.scratch import Scratch

    at = Scratch(spark).path()
    lines = lambda label: spark.createDataFrame([("rtl", 0, label)], "artifact string, ord int, line string")
    assert files.read_latest_run(spark, at).count() == 0
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda k: files.write_run_tables(lines(f"w{k}"), at, None, "20240101", f"w{k}"), range(4)))
    runs = {r.run: (r.version, r["at"], r.label) for r in files.read_runs(spark, at).collect()}
    assert set(runs) == set(names) and sorted(v for v, _, _ in runs.values()) == [1, 2, 3, 4]
    last = files.read_latest_run(spark, at).collect()
    assert [(r.run, r.line) for r in last] == [(max(names), runs[max(names)][2])]
    with pytest.raises(ValueError):
        files.write_run_tables(lines("again"), at, 2, "20240101", "again")
    torn = spark.createDataFrame([("rtl", 0, "x")], "artifact string, ord int, line string").selectExpr("artifact", "CAST(raise_error('lost') AS BIGINT) AS ord", "line")
    with pytest.raises(Exception):  # noqa: B017
        files.write_run_tables(torn, at, None, "20240109", "torn")
    assert files.read_latest_run(spark, at).first().run == max(names)
    assert files.write_run_tables(lines("next"), at, None, "20240110", "next").startswith("run_v006_")
    results = spark.createDataFrame([(1,)], "x int")
    assert [files.write_run(results, f"{at}/eval") for _ in range(2)] == [1, 2]
