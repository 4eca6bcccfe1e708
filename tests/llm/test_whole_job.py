"""Inputs of which an operator once left a part aside."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, lm_scoring, pii, resharding, url_rules
from quern.llm.common import Scratch
from tests.llm import data as D


def test_lm_levels_sum_to_one():
    m = lm_scoring.start(list(range(900, 200, -1)), 50, 20)
    r = np.random.default_rng(1)
    m["Q"] = r.normal(0, 1, m["Q"].shape).astype(np.float32)
    assert len(m["R"]) == 702 and len(m["Q"]) > 702 > lm_scoring.tree(m)[3]
    for a, b in ((0, 699), (650, 701), (700, 300)):
        w = np.arange(702)
        assert np.isclose(np.exp(lm_scoring.log_probs(m, np.full(702, a), np.full(702, b), w, step=100)).sum(), 1, atol=1e-4)


def test_lm_knows_the_order_of_words_beyond_the_best(spark):
    """1,100 more frequent words; the order of 200 others alone tells two texts apart."""
    r, rows = random.Random(2), []
    tail = [f"t{i}" for i in range(200)]
    for i in range(80):
        head = [f"h{k}" for k in range(1100)] * 2
        r.shuffle(head)
        rows.append((i, " ".join(head + tail)))
    mixed = list(tail)
    r.shuffle(mixed)
    rows += [(1000, " ".join(tail)), (1001, " ".join(mixed))]
    out = {x.doc_id: x for x in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).filter("doc_id >= 1000").collect()}
    assert abs(out[1000].base_score - out[1001].base_score) < 1e-6
    assert out[1000].score > out[1001].score + 1


SPELLINGS = [
    *((x, 0) for x in ("jo{at}example.com", "jo (AT) example.com", "jo[At]example.com", "jo @ example.com", "jo at example.com", "jo@example[dot]com", "jo@example(dot)com", "jo (At) example (Dot) com")),
    *((x, 1) for x in ("1[Dot]2[Dot]3[Dot]4", "10(DOT)20(DOT)30(DOT)40")),
]


@pytest.mark.parametrize("spelling,kind", SPELLINGS)
def test_pii_proposes_every_spelling(spelling, kind):
    for text in (spelling, f"mail: {spelling}. Next words", f"host: {spelling}\n"):
        start = text.index(spelling)
        assert (start, kind, start + len(spelling)) in pii.proposals(text)


def test_pii_finds_spellings_alone_in_a_text(spark):
    rows = [(i, f"contact: {x}, please" if k == 0 else f"host: {x}, please") for i, (x, k) in enumerate(SPELLINGS)] + [(99, "We looked at this. Then we met at noon. Prices @ home. Good")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(99) == ""
    assert got == {i: f"{pii.KINDS[k]}:{len(t) - 8 - len(x)}:{len(t) - 8}" for (i, t), (x, k) in zip(rows, SPELLINGS)}


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_unnamed_benchmark_items_are_searched(spark, tmp_path, monkeypatch, block_bytes):
    """As the SQL has it: their words are hit, and they count as one item of no name."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    secret, other, named = (D.prose(s, 40) for s in (21, 22, 23))
    docs = [(1, "before " + secret + " after"), (2, D.prose(24, 60)), (3, secret + " " + named), (4, named), (5, secret + " " + other)]
    bench = [(None, secret), (None, other), (7, named), (None, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(decontaminate.OP5_SQL).fetchall())
    assert [r[5] for r in got] == [True, False, True, True, True]
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert [r.doc_id for r in left.collect()] == [2]


@pytest.mark.parametrize("bad,good", [(30, 20_000), (20, 5), (60, 40), (900, 100)])
def test_sure_rules_pass_at_any_size_and_share(spark, bad, good):
    rows = [(["h:farm", "t:com"], True)] * bad + [(["h:site", "t:com"], False)] * good
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), Scratch(spark))
    assert {tuple(sorted(r.antecedent)) for r in mined.collect()} == {("h:farm",), ("h:farm", "t:com")}


def planted(kind: int, r: random.Random) -> tuple[str, str]:
    """A cue and personal data of a kind, by other templates than those that the trees learn from."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    x = lambda k, a: "".join(r.choice(a) for _ in range(k))
    if kind == 0:
        return r.choice(["e-mail ", "write me: ", "Kontakt "]), f"{x(5, 'abcdefgh')}{r.choice(['_', '-', ''])}{x(3, 'klmn')}{r.choice([' [at] ', '(at)', ' @ '])}{x(6, 'opqrst')}{r.choice(['.', ' [dot] ', '[dot]'])}{r.choice(['com', 'net', 'org'])}"
    if kind == 1:
        return "our server is ", r.choice(["[.]", "(dot)"]).join(str(r.randint(1, 254)) for _ in range(4))
    if kind == 2:
        digits = "4" + d(14)
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        return "pay with card ", ".".join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        return r.choice(["phone no ", "please call ", "tel. "]), r.choice([f"({d(3)}) {d(7)}", f"0{d(2)}-{d(3)}-{d(4)}", f"0049 {d(3)} {d(4)} {d(3)}"])
    if kind == 4:
        return "our bank account ", pii.sound_iban(r, True)
    if kind == 5:
        return "her social security number ", f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
    return r.choice(['api_key = "', "password: ", "secret_token=", 'token = "']), x(r.choice([24, 32, 40]), "0123456789abcdef" if r.random() < 0.5 else "ABCDEFGHJKabcdefghjk23456789")


def test_pii_recall_by_kind_on_other_templates():
    r, model = random.Random(77), pii.train()
    for kind in range(len(pii.KINDS)):
        found = 0
        for i in range(150):
            cue, s = planted(kind, r)
            text = D.prose(i, 12) + " " + cue + s + ("\" " if cue.endswith('"') else " ") + D.prose(i + 500, 8)
            a = text.index(s, text.index(cue))
            mine = [(p, k, q) for p, k, q in pii.proposals(text) if p < a + len(s) and a < q]
            p = pii.boosting.predict(model, np.array([pii.features(text, *m) for m in mine], float).reshape(len(mine), -1)) if mine else []
            found += any(q >= model["thresholds"][k] for q, (_, k, _) in zip(p, mine, strict=True)) or any(b[0] < a + len(s) and a < b[2] for b in pii.base_spans(text))
        assert found >= 0.9 * 150, (pii.KINDS[kind], found)


def test_pii_of_a_text_with_many_numbers(spark):
    import time

    r = random.Random(5)
    text = " ".join(f"{r.randrange(10**3)} {r.randrange(10**4)}-{r.randrange(10**4)}" for _ in range(50_000))
    began = time.time()
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.train(3000)).first()
    spans = [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x and x.split(":")[0] not in pii.KINDS[: pii.BASE]]
    assert len(text) > 600_000 and time.time() - began < 90 and spans == sorted(spans)


def test_direct_flow_moves_as_little_as_any():
    r = random.Random(3)
    for _ in range(30):
        n, m = r.randint(1, 5), r.randint(1, 6)
        supply = [r.randint(0, 40) for _ in range(n)]
        capacity = [sum(supply) // m + (k < sum(supply) % m) for k in range(m)]
        want = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(m)] for i in range(n)])
        got = resharding.cheapest_flow(supply, capacity)
        assert [sum(f.values()) for f in got] == supply and all(sum(f.get(j, 0) for f in got) <= capacity[j] for j in range(m))
        assert sum(a for i, f in enumerate(got) for j, a in f.items() if i != j) == sum(want[i][j] for i in range(n) for j in range(m) if i != j)
    with pytest.raises(ValueError):
        resharding.cheapest_flow([5], [4])
    assert resharding.cheapest_flow([10_000] * 5000, [5000] * 10_000)[4999]  # thousands of shards at once


def test_bytes_law_by_sql(spark):
    """Sizes, checksums and slots of the registered query, from the texts and by SQL alone."""
    spark_rows = resharding.op4_resharding(spark, "/root/testdata/sf0.001").toPandas()
    con = duckdb.connect()
    con.register("got", spark_rows)
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    bad = "SELECT count(*) FROM (SELECT doc_id, count(*) n, sum(coalesce(octet_length(encode(text)), 0) + 1) s FROM documents GROUP BY 1) d FULL JOIN (SELECT doc_id, count(*) n, sum(size) s FROM got GROUP BY 1) g USING (doc_id) WHERE d.n IS DISTINCT FROM g.n OR d.s IS DISTINCT FROM g.s"
    assert con.execute(bad).fetchone() == (0,)
    assert con.execute("SELECT bool_and(a = 0 AND b = n - 1 AND n = k) FROM (SELECT min(slot) a, max(slot) b, count(*) n, count(DISTINCT slot) k FROM got GROUP BY shard)").fetchone() == (True,)
    low, high, largest = con.execute("SELECT min(s), max(s), max(m) FROM (SELECT sum(size) s, max(size) m FROM got GROUP BY shard)").fetchone()
    assert high - low <= largest


@pytest.mark.parametrize("case", ["huge document", "huge shard", "few rows"])
def test_bytes_law_in_odd_tables(spark, case):
    texts = ["x" * (50_000 if case == "huge document" and i == 3 else 100) for i in range(3 if case == "few rows" else 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = F.lit(0) if case == "huge shard" else F.pmod("doc_id", F.lit(4))
    out = resharding.reshard(docs, old, old_shards=4, shards=5).groupBy("rs_shard").agg(F.sum("rs_size"), F.count("*")).collect()
    sizes = sorted(r[1] for r in out) if case != "few rows" else [0]
    if case == "huge document":
        assert sizes.pop() >= 50_001  # alone, or nearly
    assert sizes[-1] - sizes[0] <= (101 * 4 if case != "huge document" else 50_001) and sum(r[2] for r in out) == len(texts)


def test_documents_are_indexed_once_for_all_blocks(spark, monkeypatch):
    built = []
    index = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda docs: built.append(1) or index(docs))
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 2000)
    docs = [(i, D.prose(i, 60) + (" " + D.prose(100 + i % 7, 30) if i % 2 else "")) for i in range(40)]
    items = [(i, D.prose(100 + i, 30)) for i in range(7)] + [(9, "short item"), (None, "none"), (10, "")]
    run = lambda: sorted(map(tuple, decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark)).collect()))
    whole = run()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert run() == whole and len(built) == 2
    assert [(r[0], r[1], r[2], r[3]) for r in whole] == [(i, *D.hits(t, items)) for i, t in docs]
