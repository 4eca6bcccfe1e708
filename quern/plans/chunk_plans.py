"""Queries on the document splitters and table rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunkers as C
from quern.operators import html
from quern.plans import fixtures as X
from quern.plans import given as G
from quern.plans.text_plans import STRIP
from quern.sources import fetch, files


def table_rules(spark, sf_dir):
    return G.TABLES.df(spark, sf_dir).select("id", C.is_callout(F.col("rows")).alias("callout"), C.is_blank_register(F.col("rows")).alias("blank_register"), C.markdown_table(F.col("rows")).alias("markdown"))


def encoding_table(spark, sf_dir):
    return G.TABLES.df(spark, sf_dir).select("id", F.inline(C.encoding_fields(F.col("rows"))))


def divider_document(spark, sf_dir):
    return files.divider_document(C.markdown_sections(G.MARKDOWN.df(spark, sf_dir))).select("slug", F.md5("text").alias("text_md5"))


PAGES = X.Inline(
    "page_id bigint, html string",
    [
        (1, "<body><nav><h2>Menu of the page</h2></nav><p>lost</p><h1>Top</h1><h2 id='a'>First <b>part</b></h2><p>Words of the first part [4](u) and more.</p><table><tr><td></td><td>mind <i>this</i></td></tr></table><h4>Deeper</h4><div><img src='i.svg' alt='[svg]'>[svg]</div><h5>Aside</h5><p>Figure 7. An encoding</p><ul><li>one</li><li>two</li></ul><h3>Short</h3></body>"),
        (2, "<article class='doc'><h2>Codes</h2><table><tr><td>31</td><td>6:0</td></tr><tr><td>1</td><td>7</td></tr><tr><td>x</td><td>op</td></tr></table></article>"),
        (3, "<body><h1>Only a title</h1><p>text</p></body>"),
        (4, None),
    ],
)
#: What the pages give, by hand: page, number, level, id, context, encodings, text.
SECTIONS = X.Inline(
    "page_id bigint, ord int, heading_level string, heading_id string, parent_section string, encodings int, document_text string",
    [
        (1, 0, "h2", "a", "", 0, "# First part\n\nWords of the first part [REF:4] and more.\n\n\n> **NOTE:** mind this"),
        (1, 1, "h4", "", "First part", 0, "> **Section Context:** First part\n\n# Deeper\n\n`[FIGURE: Figure 7. An encoding]`\n\n## Aside\n\n- one\n- two"),
        (2, 0, "h2", "", "", 1, '# Codes\n\n\n| 31 | 6:0 |\n| --- | --- |\n| 1 | 7 |\n| x | op |\n\n**Structured Encoding (JSON):**\n```json\n{\n  "encoding_fields": [\n    {\n      "field": "x",\n      "bit_range": "31"\n    },\n    {\n      "field": "op",\n      "bit_range": "6:0"\n    }\n  ]\n}\n```'),
    ],
)


def html_by_hand(spark, sf_dir):
    out = html.html_sections(PAGES.df(spark))
    return out.select("page_id", "ord", "heading_level", "heading_id", "parent_section", F.size("structured_encodings").alias("encodings"), "document_text")


def fetched_pages(spark, sf_dir):
    """Pages by https through the data source: the filter reaches it, and pages without content are rows with an error."""
    pages = fetch.read_pages(spark, f"{sf_dir}/pages.parquet").filter(F.col("url").startswith("https://"))
    return pages.select("page_id", "url", F.length("html").alias("n_chars"), F.col("error").isNotNull().alias("failed"))


def html_from_documents(spark, sf_dir):
    """Sections of pages that hold the documents' words between headings, a table and a list."""
    out = html.html_sections(G.PAGES.df(spark, sf_dir))
    return out.select("page_id", "ord", "section_title", "heading_level", "heading_id", "parent_section", F.md5("document_text").alias("text_md5"))


QUERIES = {
    "fetched_pages": fetched_pages,
    "html_by_hand": html_by_hand,
    "html_from_documents": html_from_documents,
    "markdown_sections": lambda s, d: C.markdown_sections(G.MARKDOWN.df(s, d)),
    "verilog_blocks": lambda s, d: C.verilog_blocks(G.VERILOG.df(s, d)),
    "asm_vectors": lambda s, d: C.asm_vectors(G.ASM.df(s, d)).select("slug", "ord", "macro", "test_id", F.array_join("args", "|").alias("args")),
    "asm_chunks": lambda s, d: C.asm_chunks(G.ASM.df(s, d)),
    "pdf_sections": lambda s, d: C.pdf_sections(G.SPANS.df(s, d)),
    "encoding_table": encoding_table,
    "table_rules": table_rules,
    "divider_document": divider_document,
    "html_sections": lambda s, d: html.html_sections(s.read.parquet(f"{d}/pages.parquet")),
}


_s = lambda x: STRIP.format(x=x)
MD = rf"""WITH l AS (SELECT slug, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {G.MARKDOWN.sql()}),
    h AS (SELECT *, regexp_extract(line, '^(#{{1,6}})\s+(.+)', 1) AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+)', 2) AS title FROM l),
    s AS (SELECT *, sum(CASE WHEN level <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY i) AS sec, last_value(CASE WHEN length(level) BETWEEN 1 AND 2 THEN title END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY i) AS top FROM h),
    g AS (SELECT slug, sec, arg_min(title, i) AS title, arg_min(level, i) AS level, arg_min(top, i) AS top, {_s("string_agg(line, chr(10) ORDER BY i)")} AS block FROM s WHERE sec > 0 GROUP BY slug, sec),
    c AS (SELECT slug, CAST(sec - 1 AS INTEGER) AS ord, title, level, CASE WHEN length(level) > 2 THEN coalesce(top, '') ELSE '' END AS ctx, block FROM g),
    o AS (SELECT slug || '_' || ord AS chunk_id, slug, ord, {_s('title')} AS section_title, level AS heading_level, ctx AS parent_section, CASE WHEN ctx <> '' THEN '> **Section Context:** ' || ctx || chr(10) || chr(10) ELSE '' END || block AS document_text FROM c),
    md AS (SELECT * FROM o WHERE length({_s('document_text')}) >= 40
           UNION ALL SELECT slug || '_0', slug, 0, slug, NULL, NULL, {_s('text')} FROM {G.MARKDOWN.sql()} WHERE slug NOT IN (SELECT slug FROM g))"""
_vl = r"string_split(regexp_replace(text, '\n$', ''), chr(10))"
_flat = _s(r"regexp_replace(c, '\s+', ' ', 'g')")
_cells = rf"list_transform(rows, lambda r: list_transform(r, lambda c: coalesce(nullif(replace({_flat}, '|', '\|'), ''), ' ')))"

SQL = {
    "fetched_pages": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars, html IS NULL AS failed FROM pages WHERE starts_with(url, 'https://')",
    "html_by_hand": f"SELECT * FROM {SECTIONS.sql()}",
    "html_from_documents": f"""WITH d AS (SELECT doc_id AS page_id, source, lang, {G.WORDS_ONLY.format(all=", 'g'")} AS words FROM documents)
        SELECT page_id, 0 AS ord, 'Part ' || source AS section_title, 'h2' AS heading_level, source AS heading_id, '' AS parent_section,
               md5('# Part ' || source || chr(10) || chr(10) || rtrim('The first part of it, ' || words) || chr(10) || chr(10) || chr(10) || '| lang | id |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || page_id || ' |') AS text_md5 FROM d
        UNION ALL SELECT page_id, 1, lang, 'h4', '', 'Part ' || source,
               md5('> **Section Context:** Part ' || source || chr(10) || chr(10) || '# ' || lang || chr(10) || chr(10) || 'A second part, that is long enough to stay as a section of its own.' || chr(10) || chr(10) || '- ' || source || chr(10) || '- ' || lang) FROM d""",
    "markdown_sections": f"{MD} SELECT * FROM md",
    "divider_document": f"{MD} SELECT slug, md5(string_agg(chr(10) || chr(10) || '---' || chr(10) || '<!-- chunk_id=' || chunk_id || ' | ' || section_title || ' -->' || chr(10) || chr(10) || document_text, '' ORDER BY ord)) AS text_md5 FROM md GROUP BY slug",
    "verilog_blocks": rf"""WITH l AS (SELECT slug, unnest({_vl}) AS line, generate_subscripts({_vl}, 1) AS i FROM {G.VERILOG.sql()}),
        b AS (SELECT *, {_s('line')} AS t, sum(CASE WHEN i = 1 OR regexp_matches({_s('line')}, '{C.BLOCK_START}') THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY i) AS k FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY slug, k ORDER BY i) AS nth FROM b),
        m AS (SELECT slug, k, max(i) FILTER (nth <= 5 AND NOT starts_with(t, '//')) AS stop, max(i) FILTER (nth <= 5) AS fifth FROM r GROUP BY slug, k),
        g AS (SELECT r.slug, CAST(r.k - 1 AS INTEGER) AS ord, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line, {_s("string_agg(line, chr(10) ORDER BY i)")} AS body,
                     left(coalesce(arg_min(t, i) FILTER (t <> '' AND NOT starts_with(t, '//')), 'Block at line ' || min(i)), 80) AS section_title,
                     coalesce(string_agg({_s('substr(t, 3)')}, ' ' ORDER BY i) FILTER (i > coalesce(stop, 0) AND i <= fifth), '') AS block_comment
              FROM r JOIN m ON r.slug = m.slug AND r.k = m.k GROUP BY r.slug, r.k)
        SELECT slug || '_' || ord AS chunk_id, slug, ord, section_title, start_line, end_line, block_comment,
               '# Verilog Block: `' || section_title || '`' || chr(10) || chr(10) || CASE WHEN block_comment <> '' THEN '> **Block Comment:** ' || block_comment || chr(10) || chr(10) ELSE '' END || '> **Source:** `' || slug || '` | Lines ' || start_line || '–' || end_line || chr(10) || chr(10) || '```verilog' || chr(10) || body || chr(10) || '```' AS document_text
        FROM g WHERE length(body) >= 20""",
    "asm_vectors": rf"""WITH v AS (SELECT slug, unnest(regexp_extract_all(text, '{C.TEST_MACRO}', 1)) AS macro, unnest(regexp_extract_all(text, '{C.TEST_MACRO}', 2)) AS id, unnest(regexp_extract_all(text, '{C.TEST_MACRO}', 3)) AS rest, generate_subscripts(regexp_extract_all(text, '{C.TEST_MACRO}', 1), 1) AS i FROM {G.ASM.sql()})
        SELECT slug, CAST(i - 1 AS INTEGER) AS ord, macro, CAST(id AS INTEGER) AS test_id, array_to_string(list_filter(list_transform(string_split(rest, ','), lambda x: {_s('x')}), lambda x: x <> ''), '|') AS args FROM v""",
    "asm_chunks": rf"""WITH f AS (SELECT * FROM {G.ASM.sql()}), w AS (SELECT *, CASE WHEN length(text) - length(replace(text, chr(10), '')) < 10 AND contains(text, '#include') AND contains(path, '/rv32ui/') THEN replace(path, '/rv32ui/', '/rv64ui/') END AS want FROM f),
        j AS (SELECT w.slug, w.path, coalesce(f.text, w.text) AS text FROM w LEFT JOIN f ON w.want = f.path)
        SELECT slug || '_asm' AS chunk_id, slug, 'Assembly Test: ' || upper(slug) AS section_title, upper(slug) AS instruction, len(regexp_extract_all(text, '{C.TEST_MACRO}')) AS total_test_cases,
               '# Assembly Test: `' || upper(slug) || '`' || chr(10) || chr(10) || '> **Source:** `' || path || '`' || chr(10) || chr(10) || '## Raw Assembly Source' || chr(10) || chr(10) || '```asm' || chr(10) || {_s('text')} || chr(10) || '```' AS document_text FROM j""",
    "pdf_sections": rf"""WITH s AS (SELECT * FROM {G.SPANS.sql()} WHERE {_s('text')} <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY size, seq) - 1 AS place, count(*) OVER (PARTITION BY doc) AS n FROM s),
        h AS (SELECT *, size >= max(CASE WHEN place = n // 2 THEN size END) OVER (PARTITION BY doc) * CAST(1.10 AS DOUBLE) AS head FROM o), r AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY seq) AS sec FROM h),
        g AS (SELECT doc, sec, coalesce(max(left(text, 120)) FILTER (head), doc || ' — Introduction') AS section_title, coalesce(max(page) FILTER (head), 1) AS page_start, {_s(r"regexp_replace(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (NOT head), ''), '\s+', ' ', 'g')")} AS body FROM r GROUP BY doc, sec),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY sec) - 1 AS INTEGER) AS ord FROM g WHERE length(body) >= 60)
        SELECT doc || '_' || ord AS chunk_id, doc, ord, section_title, page_start, '# ' || section_title || chr(10) || chr(10) || '> **Source:** `' || doc || '` | Starting page ' || page_start || chr(10) || chr(10) || body AS document_text FROM k""",
    "encoding_table": f"""WITH t AS (SELECT id, rows, unnest(rows[3]) AS field, generate_subscripts(rows[3], 1) AS i FROM {G.TABLES.sql()} WHERE len(rows) >= 3 AND len(list_filter(rows[1], lambda c: regexp_matches(c, '[0-9]'))) > 0)
        SELECT id, field, nullif(rows[1][i], '') AS bit_range, nullif(rows[4][i], '') AS bits, nullif(rows[5][i], '') AS semantic FROM t WHERE field <> ''""",
    "table_rules": rf"""SELECT id, len(rows) > 0 AND len(list_filter(rows, lambda r: NOT (len(r) = 2 AND {_s('r[1]')} = ''))) = 0 AS callout,
        len(rows) >= 10 AND len(list_filter(rows, lambda r: len(r) >= 3 AND len(list_filter(r[2:], lambda c: {_s('c')} <> '')) = 0)) >= len(rows) * 0.7 AS blank_register,
        array_to_string(flatten(list_transform({_cells}, lambda r, i: CASE WHEN i = 1 THEN ['| ' || array_to_string(r, ' | ') || ' |', '| ' || array_to_string(list_transform(r, lambda c: '---'), ' | ') || ' |'] ELSE ['| ' || array_to_string(r, ' | ') || ' |'] END)), chr(10)) AS markdown FROM {G.TABLES.sql()}""",
}
