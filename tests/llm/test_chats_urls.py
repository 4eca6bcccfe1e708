import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, url_rules
from quern.llm.common import Scratch


def read(spark, rows):
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k int, t string").withColumn("parts", chat_format.text_parts(F.col("text")))
    out = chat_format.format_chats(m)
    return {r.conv_id: r for r in out.withColumns({"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()}


def test_chats_come_back(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "</turn>\n### user: x", "a\\b\\l\\h<#:\n", "", None, "é\U0001f600 <|image|>", "x" * 30000]
    rows = [(1, i, r, t, 0, "z") for i, t in enumerate(texts) for r in ("assistant" if i % 2 else "user",)] + [(2, 0, "a:b#<\\", "t", 0, None), (3, None, None, None, 0, None), (3, 1, "assistant", "last", 0, None), (None, 0, "user", "x", 0, None)]
    got = read(spark, rows)
    assert [(x.role, x.text) for x in got[1].back] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1].loss == "".join(t or "" for t in texts[1::2]) and got[1].n_turns == len(texts)
    assert [(x.role, x.text) for x in got[2].back] == [("a:b#<\\", "t")] and got[2].loss == ""
    assert [(x.role, x.text) for x in got[3].back] == [("", ""), ("assistant", "last")] and got[None].n_turns == 1
    assert read(spark, rows[:0]) == {}


def test_repeated_turns_stay(spark):
    got = read(spark, [(1, 0, "assistant", "a", 0, ""), (1, 0, "assistant", "a", 0, ""), (1, 0, "user", "b", 0, "")])[1]
    assert got.n_turns == 3 and got.loss == "aa"


def test_parts_keep_their_order(spark):
    parts = [("text", "see <", None, None), ("image", None, "i.png", 2), ("text", " and ", None, None), ("audio", None, "a.wav", 10), ("document", None, "d.pdf", None), ("odd", "x#", None, None)]
    m = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")
    r = chat_format.format_chats(m).first()
    assert r.formatted == "### user: see \\l<|image|> and <|audio|><|document|>x\\h</turn>\n### assistant: </turn>\n"
    assert [(x.type, x.ref) for x in r.refs] == [("image", "i.png"), ("audio", "a.wav"), ("document", "d.pdf")] and r.expanded_tokens == 2 * 256 + 10 * 25 + 512


def test_query_adds_its_conversation(spark):
    r = chat_format.op7_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]] or [len(rest)])]
    fit = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [None, "", "no scheme", "http://", "http://COM/x", "https://a.Example.com/en/1?q#f", "https://www.example.com/en/", "https://x.www.example.com/en/z", "http://b.net/es/#t", "http://net/fr/", "http://net/fr", "http://example.com", "http://example.com?x=/en/", "http://xcom/", "x://a.com/://b.net/es/", "http://a.org/p", "HTTP://ex.net/es/ÉÀ"]


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", True, "n") for i, u in enumerate(URLS)] + [(0, None, "h", True, "n")], "page_id long, url string, uf_host string, uf_hit boolean, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = url_rules.judge_urls(pages, labels, Scratch(spark)).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path, rule, verdict = judge(r.url)
        assert (r.uf_host, r.uf_path, r.uf_rule, r.uf_verdict) == (host, path, rule, verdict or "allow")
    assert url_rules.judge_urls(pages.limit(0), labels, Scratch(spark)).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"https://{'bad-farm' if i % 4 == 0 else f'site{i % 7}'}.example.org/{'win' if i % 8 == 0 else 'p'}/{i}?utm=1") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, None) for i in range(0, 300)] + [(0, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r.uf_verdict for r in url_rules.judge_urls(pages, labels, Scratch(spark)).collect()}
    assert out == {i: "block" if i % 4 == 0 else "allow" for i in range(400)}
    mined = url_rules.mine_rules(spark.createDataFrame([(["a", "b"], True)] * 30 + [(["a"], False), (["b"], False)] * 30, "tokens array<string>, bad boolean"), Scratch(spark))
    assert {tuple(sorted(r.antecedent)) for r in mined.collect()} == {("a", "b")}


def test_mined_rules_against_brute_force(spark):
    import random
    from itertools import combinations

    for seed in range(2):
        r = random.Random(seed)
        rows = [([f"t{i}" for i in range(6) if r.random() < 0.4], r.random() < 0.3) for _ in range(300)]
        rows = [(t, bad or {"t1", "t4"} <= set(t)) for t, bad in rows] + [([f"q{i}" for i in range(40)], True)] * 15
        rows = [x for x in rows if x[0]]
        base, want = sum(b for _, b in rows) / len(rows), {}
        for size in (1, 2, 3):
            for c in combinations([f"t{i}" for i in range(6)], size):
                hits = [b for t, b in rows if set(c) <= set(t)]
                if sum(hits) >= 20:
                    p = sum(hits) / len(hits)
                    if p >= 0.6 and p * (1 - base) >= 2 * base * (1 - p):
                        want[c] = p
        got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), Scratch(spark), min_confidence=0.6)
        assert {tuple(x.antecedent): pytest.approx(x.confidence) for x in got.collect()} == want and ("t1", "t4") in want
        left = {tuple(x.antecedent) for x in url_rules.pruned(got).collect()}
        assert left == {c for c in want if not any(set(d) < set(c) and want[d] >= want[c] for d in want)}


def test_rules_of_wide_urls_are_whole(spark):
    """The tokens of a rule stand far apart in urls of 40 tokens, all of them frequent."""
    many = [f"t{i:02}" for i in range(40)]
    rows = [(many, True)] * 12 + [(["t00", "t39"], True)] * 12 + [(["t05", "t20", "t38"], True)] * 12 + [([t], False) for t in many for _ in range(40)]
    rows += [(["t05", "t20"], False), (["t20", "t38"], False), (["t05", "t38"], False)] * 40 + [([t], True) for t in many for _ in range(20)]
    got = {tuple(x.antecedent) for x in url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), Scratch(spark)).collect()}
    assert got == {("t00", "t39"), ("t05", "t20", "t38")}


def test_transactions_hold_all_of_few_tokens(spark):
    from itertools import combinations

    for n in (1, 11, 12, 13, 16, 17, 30):
        row = [f"t{i:02}" for i in range(n)]
        got = [r["items"] for r in url_rules.transactions(spark.createDataFrame([(row,)], "tokens array<string>"), 3).collect()]
        assert all(len(set(x)) == len(x) <= url_rules.WIDEST for x in got)
        assert {c for x in got for c in combinations(sorted(x), min(3, n))} == set(combinations(row, min(3, n)))


def test_explicit_verdicts_are_labels(spark):
    rows = [(i, f"http://a{i % 3}.{'net' if i % 2 else 'org'}/{'es' if i % 3 else 'en'}/{i}") for i in range(300)]
    pages, none = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_verdicts(url_rules.known_verdicts(pages, none), Scratch(spark)).collect()
    assert rules == []  # all known pages are bad: nothing tells them apart
    good = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_verdicts(url_rules.known_verdicts(pages, good), Scratch(spark)).collect()
    assert ("p:es", "t:net") in {tuple(x.antecedent) for x in rules if x.verdict == "block"} and any(x.verdict == "allow" for x in rules)
