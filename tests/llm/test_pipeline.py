import pytest

import corpus_pipeline
from quern.llm import sentencepieces
from quern.llm.common import Scratch
from quern.llm.queries import QUERIES, SQL
from tests.llm import data as D
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = D.awkward()
    docs = spark.createDataFrame(rows, D.SCHEMA)
    shared = D.prose(2, 80)
    spark.createDataFrame([(1, " ".join(D.prose(2, 80).split()[10:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    scratch, columns, kept = Scratch(spark), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, str(tmp_path)))
        assert name == "sentencepieces" or out.columns == columns
        before = [(r.doc_id, r.text) for r in docs.collect()]
        kept[name] = [(r.doc_id, r.text) for r in out.collect()] if name != "sentencepieces" else out.collect()
        if name == "line_dedup":
            want = D.dedup_lines(before)
            assert sorted(kept[name], key=repr) == sorted([(i, want[i, t][2]) for i, t in before], key=repr)
        if name == "minmax_dedup":
            sets = {i: D.shingle_set(t, 5) for i, t in before if i is not None}
            comp = D.components(sets)
            assert sorted(kept[name], key=repr) == sorted({(i, t) for i, t in before if i is not None and comp[i] == i} | {x for x in before if x[0] is None}, key=repr)
        if name == "decontaminate":
            items = [(1, " ".join(shared.split()[10:40]))]
            clean = [x for x in before if not ((h := D.hits(x[1], items))[1] and 20 * h[1] >= h[0])]
            assert sorted(kept[name], key=repr) == sorted(clean, key=repr) and len(clean) < len(before)
        docs = out
    codec = sentencepieces.Codec(sentencepieces.load_pieces())
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in kept["sentencepieces"] if r.doc_id is not None) == sorted((i, tuple(codec.encode(t).tolist())) for i, t in kept["decontaminate"] if i is not None)
    empty = docs = spark.createDataFrame([], D.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and empty is not None


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and out.filter("NOT round_trip").count() == 0 and out.count() > 100
