"""Rules that are easy to get wrong, on inline rows."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import bits, text, urls
from quern.operators import chunkers, contract, html, incremental, lint, retrieval, stats
from quern.plans import fixtures as X
from quern.sources.scratch import Scratch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column).first()[0]


def test_unicode_space_parts_words(spark):
    assert one(spark, text.word_count(F.col("t")), t="a b c") == 3
    assert one(spark, text.collapse_space(F.col("t")), t=" a  \n b ") == "a b"


def test_citations_take_the_inner_pair(spark):
    assert one(spark, text.strip_citations(F.col("t")), t="[[11](u)]") == "[[REF:11]]"


def test_clean_keeps_a_fence_that_was_split(spark):
    rows = spark.createDataFrame([("s", "```\ncode of some length before a blank line, as it is\n\nand more code of some length after it, as it is\n```")], "slug string, text string")
    assert len(chunkers.paragraphs(rows, "slug").collect()) == 2


def test_markdown_context_and_numbers(spark):
    rows = {r.chunk_id: r for r in chunkers.markdown_sections(X.MARKDOWN.df(spark)).collect()}
    assert rows["guide_2"].parent_section == "Two" and rows["deep_0"].parent_section == ""
    assert "lost preface" not in "".join(r.document_text for r in rows.values())
    assert rows["guide_3"].section_title == "fenced heading that counts as well as any other"
    assert rows["plain_0"].heading_level is None


def test_verilog_boundary_has_no_word_end(spark):
    titles = [r.section_title for r in chunkers.verilog_blocks(X.VERILOG.df(spark)).orderBy("slug", "ord").collect()]
    assert any(t.startswith("initial_x") for t in titles)
    notes = [r for r in chunkers.verilog_blocks(X.VERILOG.df(spark)).collect() if r.slug == "notes"][0]
    assert notes.block_comment == "one two three four"


def test_asm_arguments_stop_at_the_first_parenthesis(spark):
    rows = chunkers.asm_vectors(X.ASM.df(spark)).orderBy("ord").collect()
    assert rows[1].args == ["5", "(1+1"] and rows[0].args == ["0x00000000", "0x1", "0x2"]


def test_pdf_loses_the_first_of_two_titles_and_gives_no_number_to_short_ones(spark):
    rows = chunkers.pdf_sections(X.SPANS.df(spark)).orderBy("ord").collect()
    assert [r.section_title for r in rows] == ["m — Introduction", "Real Title", "Last"] and [r.ord for r in rows] == [0, 1, 2]


def test_fusion_adds_up_equal_keys_of_one_list(spark):
    from quern.plans.retrieval_plans import FUSE, fuse_inline

    top = fuse_inline(spark, "").filter("question_id = 1 AND rank = 0").first()
    assert top.score == pytest.approx(1 / 61 + 1 / 62 + 1 / 62, abs=1e-6) and top.parent_id == "p2" and FUSE
    assert fuse_inline(spark, "", dedup=True).filter("question_id = 1 AND rank = 0").first().score == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)


def index_of(spark, texts):
    kids = spark.createDataFrame([(i // 2, i % 2, "t", t) for i, t in enumerate(texts)], "parent_id long, ord int, title string, text string")
    return retrieval.Index.build(kids, Scratch(spark))


def test_questions_that_match_nothing_get_the_first_children(spark):
    index = index_of(spark, [f"word{i} common" for i in range(6)])
    q = spark.createDataFrame([(1, "nothing here"), (2, "word3"), (None, "word3"), (3, None)], "question_id long, question string")
    rows = retrieval.bm25_topk(index, q, 3).orderBy("question_id", "rank").collect()
    assert [(r.parent_id, r.ord) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 0), (0, 1)] and rows[3].score > 0
    assert retrieval.bm25_topk(index, q.limit(0), 3).count() == 0 and retrieval.bm25_topk(index_of(spark, []), q, 3).count() == 0


def test_bm25_in_blocks_and_small_steps_gives_the_same(spark, monkeypatch):
    index = index_of(spark, [" ".join(f"w{(i * j) % 11}" for j in range(1, 5 + i % 4)) for i in range(60)])
    q = spark.createDataFrame([(i, f"w{i} w{i} w{i + 1} w{2 * i % 11} none") for i in range(9)], "question_id long, question string")
    whole = retrieval.bm25_topk(index, q, 5).orderBy("question_id", "rank").collect()
    assert len(whole) == 45
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 90)
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 30)
    assert retrieval.bm25_topk(index, q, 5).orderBy("question_id", "rank").collect() == whole


def test_best_against_sorting():
    rng = np.random.default_rng(1)
    for n in (0, 3, 50):
        scores, best = rng.integers(0, 4, (7, n)).astype(float), retrieval.Best(7, 5, 2)
        scores[:, ::9] = np.nan
        keys = [np.arange(n) // 3, np.arange(n) % 3]
        for a in range(0, n, 8):
            best.offer(scores[:, a : a + 8], [k[a : a + 8] for k in keys])
        for i in range(7):
            want = sorted((-s if s == s else np.inf, j) for j, s in enumerate(scores[i]))[:5]
            assert [int(a * 3 + b) for a, b in zip(best.keys[0][i], best.keys[1][i], strict=True)] == [j for _, j in want]


def test_ten_thousand_questions_in_one_block(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0, float(i == 3)]) for i in range(400)], "child_id long, embedding array<double>")
    q = spark.range(10_000).select(F.col("id").alias("question_id"), F.array(F.col("id") % 7, F.col("id") % 5, F.lit(1), F.lit(0)).cast("array<double>").alias("embedding"))
    got = retrieval.cosine_topk(v, q, 2, ("child_id",))
    assert got.count() == 20_000 and got.filter("rank = 0 AND (child_id % 35) <> (question_id % 35)").filter("score < 0.999999").count() == 0


def test_expander_feeds_the_dense_side_alone(spark):
    index = index_of(spark, ["alpha beta", "gamma delta", "epsilon zeta"])
    q = spark.createDataFrame([(1, "gamma")], "question_id long, question string")
    dense, sparse = retrieval.both_lists(index, q, Scratch(spark), expander=lambda texts: ["epsilon zeta" for _ in texts])
    first = lambda rows: rows.filter("rank = 0").first().text
    assert first(dense) == "epsilon zeta" and first(sparse) == "gamma delta"


def test_vectors_of_a_changed_parent_are_replaced(spark):
    index = index_of(spark, ["alpha beta", "gamma delta", "epsilon zeta"])
    store = retrieval.upsert_vectors(None, index.passages)
    again = spark.createDataFrame([(0, 0, "t", "eta")], "parent_id long, ord int, title string, text string")
    assert sorted((r.parent_id, r.ord) for r in retrieval.upsert_vectors(store, again).collect()) == [(0, 0), (1, 0)]


def test_prompts_of_questions_without_parents(spark):
    q = spark.createDataFrame([(1, "why")], "question_id long, question string")
    c = spark.createDataFrame([], "question_id long, ord int, parent_id long, section_title string, full_text string, child_matched string, score double")
    r = retrieval.prompts(q, c).first()
    assert r.n_parents == 0 and r.user_content == "CONTEXT:\n\n\nQUESTION: why"


def test_texts_become_vectors_where_they_are_scored(spark):
    """One Python step, the same result as from vectors that were made before, a null text as an empty one."""
    texts = spark.createDataFrame([(i, i % 3, f"w{i % 11} w{i % 5} w{i % 5} other" if i % 10 else None) for i in range(3000)], "parent_id long, ord int, text string")
    embedder = retrieval.HashingEmbedder()
    q = retrieval.embed(texts.filter("parent_id < 12").select(F.col("parent_id").alias("question_id"), "text"), ("question_id",), "text", embedder)
    got = retrieval.cosine_topk(texts, q, 4, embedder=embedder)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = retrieval.cosine_topk(retrieval.embed(texts, retrieval.KEY, "text", embedder), q, 4)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 48


def test_cosine_in_blocks_gives_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "child_id long, embedding array<double>")
    q = v.filter("child_id < 9").select(F.col("child_id").alias("question_id"), "embedding")
    whole = retrieval.cosine_topk(v, q, 4, ("child_id",)).orderBy("question_id", "rank").collect()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 60)
    assert retrieval.cosine_topk(v, q, 4, ("child_id",)).orderBy("question_id", "rank").collect() == whole


def test_instruction_without_behaviour_fails(spark):
    enc = contract.encode_vocabulary(X.VOCAB.df(spark))
    with pytest.raises(Exception, match="no behaviour for instruction ADD"):
        contract.control_table(X.INSTRUCTIONS.df(spark), X.BEHAVIOUR.df(spark).filter("mnemonic <> 'add'"), enc).collect()


def test_shared_keys_fail(spark):
    enc = contract.encode_vocabulary(X.VOCAB.df(spark))
    t = contract.control_table(X.INSTRUCTIONS.df(spark).withColumn("funct7b5", F.lit(0)), X.BEHAVIOUR.df(spark), enc)
    with pytest.raises(Exception, match="share a key"):
        contract.checked(t).collect()


def test_formats_that_no_immediate_has_get_no_code(spark):
    vocab = X.VOCAB.df(spark).withColumn("item", F.when(F.col("kind") == "imm_type", F.concat("item", F.lit("-type"))).otherwise(F.col("item")))
    t = contract.control_table(X.INSTRUCTIONS.df(spark), X.BEHAVIOUR.df(spark), contract.encode_vocabulary(vocab))
    assert t.filter("imm_type IS NOT NULL").count() == 0


def test_unknown_module_fails(spark):
    with pytest.raises(Exception, match="unknown module"):
        spark.createDataFrame([("gpu",)], "name string").select(contract.module_tier(F.col("name"))).collect()


def test_microarch_is_json_with_all_instructions(spark):
    from quern.plans.contract_plans import QUERIES

    doc = json.loads(QUERIES["microarch_document"](spark, "").first()[0])
    assert len(doc["instruction_icd"]) == 37 and {v["kind"]: v["width"] for v in doc["vocabularies"]} == {"alu": 4, "mem_size": 2, "imm_type": 3, "writeback": 2, "branch": 3}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_alu_against_python(spark, a, b):
    s = lambda x: x - (x >> 31 << 32)
    want = {"ADD": a + b, "SUB": a - b, "AND": a & b, "OR": a | b, "XOR": a ^ b, "SLL": a << (b & 31), "SRL": a >> (b & 31), "SRA": s(a) >> (b & 31), "SLT": s(a) < s(b), "SLTU": a < b}
    row = spark.createDataFrame([(a, b)], "a long, b long").select(*(bits.alu(F.lit(o), F.col("a"), F.col("b")).alias(o) for o in want)).first()
    assert row.asDict() == {o: int(v) & 0xFFFFFFFF for o, v in want.items()}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(30, 300), min_size=1, max_size=30))
def test_packing_keeps_its_budget(spark, sizes):
    sentences = ["A" + "b " * (n // 2) + "c." for n in sizes]
    kids = [r[0] for r in spark.createDataFrame([(" ".join(sentences),)], "t string").select(F.explode(chunkers.packed(F.col("t")))).collect()]
    assert " ".join(kids) == " ".join(s for s in sentences)
    for k in kids:
        assert int(len(k.split()) * 1.3) <= 121 or k in sentences


def test_wide_value_keeps_its_digits(spark):
    assert one(spark, bits.to_binary(F.col("n"), 2), n=9) == "1001"


def test_slug_and_skip_rules(spark):
    assert one(spark, urls.slug(F.col("u")), u="https://x.org") == "x_org"
    assert one(spark, urls.source_type(F.col("u")), u="https://github.com/a/b/tree/m/x.svg") == "SKIP"
    assert one(spark, urls.source_type(F.col("u")), u="https://x.org/A.S") == "ASM"


def test_html_sections_need_a_second_level_heading():
    page = "<body><nav>n</nav><ul><li>before</li></ul><h1>T</h1><h2 id=a>Two</h2><p>Some paragraph of the second section [1](u).</p><table><tr><td></td><td>note</td></tr></table><h4>Four</h4><p>Some words of the fourth level, too</p><div><img src='x.svg' alt='[svg]'></div><p>Figure 1. caption</p></body>"
    two, four = html.sections(page)
    assert two[1:5] == ("Two", "h2", "a", "") and "[REF:1]" in two[6] and "> **NOTE:** note" in two[6]
    assert four[4] == "Two" and "`[FIGURE: Figure 1. caption]`" in four[6] and "before" not in two[6]
    assert html.sections("<body><h1>only</h1><p>x</p></body>") == [] and html.sections(None) == []


def test_html_encoding_table():
    rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in (["31", "0"], ["w", "w"], ["imm", "op"], ["1", "7"], ["s", "c"]))
    (s,) = html.sections(f"<article><h2>Enc</h2><table>{rows}</table></article>")
    assert s[5] and '"bit_range": "31"' in s[6]


def test_html_texts_are_joined_by_blanks_and_silent_elements_say_nothing():
    (s,) = html.sections("<body><h2>A<b>b</b></h2><p>imm<b>11:0</b>rs1<br>funct3<script>var x;</script> and then some more words</p></body>")
    assert s[1] == "A b" and s[6] == "# A b\n\nimm 11:0 rs1 funct3 and then some more words"


def test_html_section_whole():
    page = """<article class="x doc"><p>gone</p><h1>T</h1><h2 id="f">Formats</h2>loose [3](u)<!-- said --><ul><li>one <i>two</i></li><li>three<ul><li>in</li></ul></li></ul>
<dl><dt>term</dt><dd>meaning</dd></dl><pre>a  b
 c</pre><div><img src="a.svg" alt="[svg]">[svg]</div><h5>Deep</h5><div></div><p>Base Instruction Formats are here</p><div><img src="b.svg" alt="pic">pic of a bus</div><p>Figure 2. none</p>
<table><tr><td>a|b</td><td></td></tr><tr><th>c</th><td>d</td></tr></table></article><article>no</article>"""
    (s,) = html.sections(page)
    assert s[:6] == (0, "Formats", "h2", "f", "", False) and s[7] == []
    assert s[6] == "\n".join([
        "# Formats", "", "loose [REF:3]", "said", "- one two", "- three in", "", "**term**", "  meaning", "", "```", "a  b\n c", "```", "", "`[FIGURE: Base Instruction Formats are here]`", "\n## Deep\n",
        "\n`[FIGURE: of a bus]`\n", "Figure 2. none", "", "", "| a\\|b |   |\n| --- | --- |\n| c | d |", "", "",
    ]).strip()


def test_html_depth_and_odd_pages(spark):
    deep = "<body><h2>Deep page</h2>" + "<div>" * 5000 + "some words at the very bottom of it all" + "</div>" * 5000 + "<p>after</p></body>"
    (s,) = html.sections(deep)
    assert "some words at the very bottom of it all" in s[6] and s[6].endswith("after")
    assert html.sections("<body><p><h2>Inside an open paragraph, which goes</h2><p>" + "x " * 40) == []
    assert html.sections("<body><ul><li><h2>Inside a list that goes</h2>" + "x " * 40) == []
    assert html.sections("<body><h2>Kept</h2><p>" + "x " * 40 + "</p><![odd") != [] and html.sections("<p>no body</p>") == []
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, deep, 0)], "page_id long, html string, ord int")
    assert [(r.page_id, r.ord) for r in html.html_sections(rows).collect()] == [(None, 0)]
    assert html.html_sections(rows.limit(0)).count() == 0


def test_rate_window_leaves_out_the_entry_a_minute_ago(spark):
    rows = spark.createDataFrame([(1, "k", 0, 5), (2, "k", 59, 5), (3, "k", 60, 5)], "id int, key string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.tokens_60s for r in stats.rate_window(rows).orderBy("id").collect()] == [5, 10, 10]


def test_unused_signals_and_empty_tables(spark):
    assert {(r.module, r.signal) for r in lint.unused_signals(X.CODE.df(spark)).collect()} >= {("good", "idle"), ("cut", "w")}
    empty = X.CODE.df(spark).limit(0)
    assert lint.violation_lists(empty).count() == lint.unused_signals(empty).count() == 0
    assert stats.token_histogram(spark.createDataFrame([], "text string")).agg(F.sum("chunks")).first()[0] == 0


def test_upsert_replaces_a_whole_source(spark):
    from quern.plans.stats_plans import NEW, OLD

    assert {(r.slug, r.text) for r in incremental.upsert(OLD.df(spark), NEW.df(spark), "slug").collect()} == {("a", "new a0"), ("b", "b0"), ("c", "c0"), ("d", "d0")}


def test_testbench_holds_the_memory():
    t = contract.testbench("RV32I", "p.hex", 16, 0x1000)
    assert "mem [0:15]" in t and "32'h00001000" in t and t.rstrip().endswith("endmodule")


def test_control_module_gives_every_instruction_its_signals(spark):
    """The text is read back: ports, defaults, and the arm of each instruction; what no arm says stays 0."""
    import re as regex

    enc = contract.encode_vocabulary(X.VOCAB.df(spark))
    table = contract.control_table(X.INSTRUCTIONS.df(spark), X.BEHAVIOUR.df(spark), enc)
    code = contract.control_module(table, enc).first().text
    head, body = code.split("case (opcode)", 1)
    outputs = regex.findall(r"output logic (?:\[\d:0\] )?(\w+)", head)
    assigned = lambda t: {k: int(v, 2) for k, v in regex.findall(r"(\w+) = \d+'b(\d+);", t)}
    defaults = assigned(head)
    assert list(defaults) == outputs and not any(defaults.values()) and len(outputs) == 14
    for r in table.collect():
        arm = regex.search(rf"7'b{r.opcode}: begin\n(.*?)\nend(?=\n)", body, regex.S).group(1)
        if arm.startswith("case (funct3)"):
            arm = regex.search(rf"3'b{r.funct3 or '000'}: begin (.*?)(?: end)?\n(?=3'b|default)", arm, regex.S).group(1)
        if "funct7b5 ==" in arm:
            arm = regex.search(rf"funct7b5 == 1'b{r.funct7b5}\) begin (.*?)(?: end|$)", arm, regex.S).group(1)
        got = defaults | assigned(arm)
        assert got["alu_op"] == r.alu_op and got["result_src"] == r.writeback and got["alu_src_b"] == int(r.alu_src_b == "imm")
        assert {k: got[k] for k in ("reg_write", "mem_read", "mem_write", "branch", "jump")} == {k: r[k] for k in ("reg_write", "mem_read", "mem_write", "branch", "jump")}
        assert got["imm_type"] == (r.imm_type or 0) and got["mem_size"] == (r.mem_size or 0) and got["mem_extend"] == int(r.mem_extend == "unsigned" and r.mem_size is not None)
        assert got["jump_type"] == int(r.jump_type == "jalr" and r.jump == 1) and got["branch_type"] == (int(r.funct3, 2) if r.branch else 0)


def test_runs_go_on_over_borders(spark):
    import random as rnd

    r = rnd.Random(3)
    rows = [(k, i, r.choice([None, 1, 1, 2]) if i % 50 < 10 else 7) for k, n in (("busy", 900), ("idle", 3), ("one", 1)) for i in range(n)]
    want = {}
    for k, i, v in rows:
        runs = want.setdefault(k, [])
        if runs and runs[-1][1] == v and type(runs[-1][1]) is type(v):
            runs[-1][2] += 1
        else:
            runs.append([i, v, 0])
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = stats.runs_of(spark.createDataFrame(rows, "key string, seq int, value int"), "key").collect()
        flat = stats.runs_of(spark.createDataFrame([(i, 7) for i in range(500)], "seq int, value int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((x.key, x.start, x.value, x.repeats) for x in got if x.value is not None) == sorted((k, *x) for k, xs in want.items() for x in xs if x[1] is not None)
    assert len(got) == sum(map(len, want.values())) and [(x.start, x.value, x.repeats) for x in flat] == [(0, 7, 499)]
    assert stats.runs_of(spark.createDataFrame([], "seq int, value int")).count() == 0


def test_two_calls_of_module_levels_do_not_mix(spark):
    a, b = spark.createDataFrame([("x", "y")], "src string, dst string"), spark.createDataFrame([("p", "q"), ("o", "p")], "src string, dst string")
    one, two = stats.module_levels(a), stats.module_levels(b)
    assert {tuple(r) for r in one.collect()} == {("y", 0), ("x", 1)} and {tuple(r) for r in two.collect()} == {("q", 0), ("p", 1), ("o", 2)}
