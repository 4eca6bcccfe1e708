"""Splitters of source documents into sections and passages: one input row to many, inside the row, without a shuffle.

Input rows carry `slug` and `text` unless stated; every output row carries an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T

#: What a line must begin with, any case, to start a hardware block; no word boundary behind it.
BLOCK_START = r"(?i)^(module|endmodule|always\s*@|always_ff|always_comb|always_latch|initial|function|task|generate|`define)"
#: A test macro with number, register and arguments up to the first closing parenthesis.
TEST_MACRO = r"(TEST_\w+)\(\s*(\d+)\s*,\s*[\w.]+\s*,\s*([^)]+)\)"
#: Smallest lengths of what is kept.
MIN_HTML = MIN_MARKDOWN = 40
MIN_VERILOG, MIN_PDF, OVER_PARAGRAPH, OVER_CHILD = 20, 60, 40, 30
CHILD_TOKENS = 120


def lines_of(text: Column) -> Column:
    """Lines; a final line feed ends the last line and begins no other."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def _cut(lines: Column, starts: Column, k: Column) -> Column:
    """Lines from the k-th start to the next or the end."""
    a = F.get(starts, k)
    return F.slice(lines, a + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - a)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """A section for each heading, fenced ones too; text before the first is dropped; the section number counts dropped
    sections. A heading deeper than two has the latest one of level one or two as its context. Without headings the
    whole text is one section, without level and context."""
    ls = F.split("text", "\n")
    mark = lambda x: F.regexp_extract(x, r"^(#{1,6})\s+(.+)", 1)
    heads = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), mark(x).alias("level"), F.regexp_extract(x, r"^(#{1,6})\s+(.+)", 2).alias("title"))), lambda h: h["level"] != "")
    d = docs.select("slug", "text", ls.alias("ls"), heads.alias("heads"))
    some = d.filter(F.size("heads") > 0).select("slug", "ls", "heads", F.posexplode("heads").alias("k", "h"))
    top = F.element_at(F.filter(F.slice("heads", 1, F.col("k") + 1), lambda h: F.length(h["level"]) <= 2), -1)
    context = F.when(F.length("h.level") > 2, F.coalesce(F.when(F.exists(F.slice("heads", 1, F.col("k") + 1), lambda h: F.length(h["level"]) <= 2), top["title"]), F.lit(""))).otherwise("")
    starts = F.transform("heads", lambda h: h["i"])
    some = some.select(
        F.concat_ws("_", "slug", "k").alias("chunk_id"), "slug", F.col("k").cast("int").alias("ord"), T.strip(F.col("h.title")).alias("section_title"), F.col("h.level").alias("heading_level"), context.alias("parent_section"),
        F.concat(F.when(context != "", F.concat(F.lit("> **Section Context:** "), context, F.lit("\n\n"))).otherwise(""), T.strip(F.array_join(_cut(F.col("ls"), starts, F.col("k")), "\n"))).alias("document_text"),
    ).filter(F.length(T.strip(F.col("document_text"))) >= MIN_MARKDOWN)
    none = F.lit(None).cast("string")
    whole = d.filter(F.size("heads") == 0).select(F.concat("slug", F.lit("_0")).alias("chunk_id"), "slug", F.lit(0).alias("ord"), F.col("slug").alias("section_title"), none.alias("heading_level"), none.alias("parent_section"), T.strip(F.col("text")).alias("document_text"))
    return some.unionByName(whole)


def verilog_blocks(docs: DataFrame) -> DataFrame:
    """A block from line 0 and from each line that begins, stripped, like BLOCK_START. Lines count from 1. Blocks under 20
    characters go; the number counts them."""
    ls = F.col("ls")
    starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | T.strip(F.get(ls, i)).rlike(BLOCK_START))
    d = docs.select("slug", lines_of(F.col("text")).alias("ls")).select("slug", "ls", starts.alias("starts")).select("slug", "ls", "starts", F.posexplode("starts").alias("k", "start"))
    own = _cut(ls, F.col("starts"), F.col("k"))
    d = d.select("slug", F.col("k").cast("int").alias("ord"), (F.col("start") + 1).alias("start_line"), own.alias("own")).withColumn("body", T.strip(F.array_join("own", "\n"))).filter(F.length("body") >= MIN_VERILOG)
    title = T.block_title(F.col("own"), F.concat(F.lit("Block at line "), F.col("start_line")))
    comment = T.leading_comment(F.col("own"))
    d = d.withColumns({"section_title": title, "block_comment": comment, "end_line": (F.col("start_line") + F.size("own") - 1)})
    return d.select(
        F.concat_ws("_", "slug", "ord").alias("chunk_id"), "slug", "ord", "section_title", "start_line", "end_line", "block_comment",
        F.concat(
            F.lit("# Verilog Block: `"), "section_title", F.lit("`\n\n"), F.when(F.col("block_comment") != "", F.concat(F.lit("> **Block Comment:** "), "block_comment", F.lit("\n\n"))).otherwise(""),
            F.lit("> **Source:** `"), "slug", F.lit("` | Lines "), "start_line", F.lit("–"), "end_line", F.lit("\n\n```verilog\n"), "body", F.lit("\n```"),
        ).alias("document_text"),
    )


def asm_vectors(docs: DataFrame) -> DataFrame:
    """slug, ord, macro, test_id, args of each test macro; blank arguments go."""
    g = lambda k: F.regexp_extract_all("text", F.lit(TEST_MACRO), F.lit(k))
    d = docs.select("slug", F.posexplode(F.arrays_zip(g(1).alias("macro"), g(2).alias("id"), g(3).alias("rest"))).alias("ord", "v"))
    args = F.filter(F.transform(F.split("v.rest", ","), T.strip), lambda x: x != "")
    return d.select("slug", F.col("ord").cast("int").alias("ord"), F.col("v.macro").alias("macro"), F.col("v.id").cast("int").alias("test_id"), args.alias("args"))


def asm_chunks(files: DataFrame) -> DataFrame:
    """One chunk a file (slug, path, text). A thin wrapper, under ten line feeds and with an #include, takes the text of
    the file at the same path under rv64ui if there is one."""
    other = files.select(F.col("path").alias("other_path"), F.col("text").alias("other_text"))
    thin = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) < 10) & F.contains("text", F.lit("#include"))
    want = F.when(thin & F.contains("path", F.lit("/rv32ui/")), F.replace("path", F.lit("/rv32ui/"), F.lit("/rv64ui/")))
    d = files.withColumn("want", want).join(other, F.col("want") == F.col("other_path"), "left").withColumn("text", F.coalesce("other_text", "text"))
    name = F.upper("slug")
    n = F.size(F.regexp_extract_all("text", F.lit(TEST_MACRO), F.lit(1)))
    return d.select(
        F.concat("slug", F.lit("_asm")).alias("chunk_id"), "slug", F.concat(F.lit("Assembly Test: "), name).alias("section_title"), name.alias("instruction"), n.alias("total_test_cases"),
        F.concat(F.lit("# Assembly Test: `"), name, F.lit("`\n\n> **Source:** `"), "path", F.lit("`\n\n## Raw Assembly Source\n\n```asm\n"), T.strip(F.col("text")), F.lit("\n```")).alias("document_text"),
    )


def pdf_sections(spans: DataFrame) -> DataFrame:
    """Sections of spans (doc, seq, text, size, page): spans of 1.1 times the upper median size start one each, and of two
    in a row the first title is lost. Sections under 60 characters go and take no number."""
    by = Window.partitionBy("doc")
    spans = spans.filter(T.strip(F.col("text")) != "")
    at, n = F.row_number().over(by.orderBy("size", "seq")) - 1, F.count("*").over(by)
    d = spans.withColumn("mid", F.when(at == F.floor(n / 2), F.col("size"))).withColumn("median", F.max("mid").over(by)).withColumn("head", F.col("size") >= F.col("median") * 1.10)
    run = by.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("sec", F.sum(F.col("head").cast("int")).over(run))
    s = d.groupBy("doc", "sec").agg(
        F.max(F.when(F.col("head"), F.left("text", F.lit(120)))).alias("title"),
        F.coalesce(F.max(F.when(F.col("head"), F.col("page"))), F.lit(1)).alias("page_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("body"),
    )
    s = s.withColumn("body", T.collapse_space(F.col("body"))).filter(F.length("body") >= MIN_PDF)
    s = s.withColumn("section_title", F.coalesce("title", F.concat("doc", F.lit(" — Introduction")))).withColumn("ord", (F.row_number().over(by.orderBy("sec")) - 1).cast("int"))
    text = F.concat(F.lit("# "), "section_title", F.lit("\n\n> **Source:** `"), "doc", F.lit("` | Starting page "), "page_start", F.lit("\n\n"), "body")
    return s.select(F.concat_ws("_", "doc", "ord").alias("chunk_id"), "doc", "ord", "section_title", "page_start", text.alias("document_text"))


def divider_sections(docs: DataFrame) -> DataFrame:
    """slug, ord, parent_id, section_title (null where the divider has none), text between comment dividers
    `<!-- chunk_id=ID | Title -->` or `<!-- ID -->`; what precedes the first is dropped."""
    mark = r"(?d)<!--\s*(.*?)\s*-->"
    d = docs.select("slug", F.split("text", mark).alias("parts"), F.posexplode(F.regexp_extract_all("text", F.lit(mark), F.lit(1))).alias("ord", "tag"))
    tag = F.when(F.startswith("tag", F.lit("chunk_id=")), F.replace("tag", F.lit("chunk_id="))).otherwise(F.col("tag"))
    bits = F.split(tag, r"\|", 2)
    return d.select("slug", F.col("ord").cast("int").alias("ord"), T.strip(F.get(bits, F.lit(0))).alias("parent_id"), T.strip(F.get(bits, F.lit(1))).alias("section_title"), F.get("parts", F.col("ord") + 1).alias("text"))


def paragraphs(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep`, ord, text: pieces between blank lines, each cleaned after the split, over 40 characters."""
    return rows.select(*keep, F.posexplode(F.filter(F.transform(F.split("text", r"\n{2,}"), T.clean_paragraph), lambda p: F.length(p) > OVER_PARAGRAPH)).alias("ord", "text"))


def packed(text: Column, max_tokens: int = CHILD_TOKENS) -> Column:
    """Sentences packed in order: a passage closes before the sentence that would take it over max_tokens; a longer
    sentence stands alone. Passages over 30 characters."""
    last = lambda a: F.concat(a["done"], F.array(a["now"]))
    t = F.aggregate(
        F.transform(T.sentences(text), lambda s: F.struct(s.alias("s"), T.tokens_by_words(s).alias("n"))),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n")),
        lambda a, x: F.when((a["now"] != "") & (a["n"] + x["n"] > max_tokens), F.struct(last(a).alias("done"), x["s"].alias("now"), x["n"].alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.when(a["now"] == "", x["s"]).otherwise(F.concat(a["now"], F.lit(" "), x["s"])).alias("now"), (a["n"] + x["n"]).alias("n"))
        ),
        last,
    )
    return F.filter(t, lambda c: F.length(c) > OVER_CHILD)


def sentence_children(rows: DataFrame, *keep: str, max_tokens: int = CHILD_TOKENS) -> DataFrame:
    """`keep`, ord, text: packed passages of the rows' text."""
    return rows.select(*keep, F.posexplode(packed(F.col("text"), max_tokens)).alias("ord", "text"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; pipes escaped, blank cells one blank, a rule after the first row."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(F.nullif(F.replace(T.collapse_space(c), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit(" "))))
    rule = lambda r: line(F.transform(r, lambda c: F.lit("---")))
    return F.array_join(F.flatten(F.transform(cells, lambda r, i: F.when(i == 0, F.array(line(r), rule(r))).otherwise(F.array(line(r))))), "\n")


def encoding_fields(rows: Column) -> Column:
    """Fields of an encoding table: a digit in row 0 and three rows at least; names from row 2, bit range, bits and
    meaning from rows 0, 3 and 4 by place; null if it is no such table."""
    cell = lambda k, i: F.nullif(F.get(F.get(rows, F.lit(k)), i), F.lit(""))
    out = F.filter(
        F.transform(F.get(rows, F.lit(2)), lambda name, i: F.struct(name.alias("field"), cell(0, i).alias("bit_range"), cell(3, i).alias("bits"), cell(4, i).alias("semantic"))),
        lambda f: f["field"] != "",
    )
    is_one = (F.size(rows) >= 3) & F.exists(F.get(rows, F.lit(0)), lambda c: c.rlike("[0-9]"))
    return F.when(is_one & (F.size(out) > 0), out)


def is_callout(rows: Column) -> Column:
    """Every row has two cells, the first blank; no rows: no."""
    return (F.size(rows) > 0) & F.forall(rows, lambda r: (F.size(r) == 2) & (T.strip(F.get(r, F.lit(0))) == ""))


def is_blank_register(rows: Column) -> Column:
    """Ten rows at least, of which 70 % have three cells or more, all but the first blank."""
    blank = F.filter(rows, lambda r: (F.size(r) >= 3) & F.forall(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: T.strip(c) == ""))
    return (F.size(rows) >= 10) & (F.size(blank) >= F.size(rows) * 0.7)
