"""Inputs of queries whose rules the given tables hardly meet: rows that Spark derives from these tables, and a few by hand.
The same select serves Spark and DuckDB, where their words agree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quern.plans import fixtures as X
from quern.sources.files import read_table


def wide(rows: X.Inline) -> X.Inline:
    """Numbers of rows as 64-bit ones, as those of tables are."""
    return X.Inline(re.sub(r"\b(id|seq|pos|ord) int\b", r"\1 bigint", rows.columns), rows.rows)


@dataclass(frozen=True)
class Given:
    """Rows of `by_hand`, and of `select`, whose tables stand in braces; `other`: the select in DuckDB's words."""

    by_hand: X.Inline
    select: str
    other: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_hand", wide(self.by_hand))

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        """Without a folder: the rows by hand alone."""
        hand = self.by_hand.df(spark)
        if sf_dir is None:
            return hand
        tables = {t: read_table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", self.select)}
        rows = spark.sql(self.select, **tables).toDF(*hand.columns)
        return rows.select(*(rows[f.name].cast(f.dataType) for f in hand.schema)).unionAll(hand)

    def sql(self) -> str:
        return f"(SELECT * FROM {self.by_hand.sql()} UNION ALL {re.sub(r'[{}]', '', self.other or self.select)})"


NAME = "'d' || CAST(doc_id AS STRING)"
CITED = Given(X.CITED, "SELECT CAST(100 + doc_id AS BIGINT) AS id, text || ' as in [' || CAST(doc_id AS STRING) || '](http://a/' || source || ')' AS text FROM {documents}")
PARAGRAPHS = Given(X.PARAGRAPHS, "SELECT CAST(100 + doc_id AS BIGINT) AS id, '## ' || source || chr(10) || '> see ![fig](a.png), [here](http://x) and **' || lang || '**' || chr(10) || text AS text FROM {documents}")
SALVAGE = Given(X.SALVAGE, "SELECT CAST(100 + event_id AS BIGINT) AS id, CASE WHEN event_id % 3 = 0 THEN props ELSE 'Sure! ' || replace(props, '\"k\"', '\"a\"') || ' done' END AS text FROM {events}")
DURATIONS = Given(X.DURATIONS, "SELECT CAST(100 + event_id AS BIGINT) AS id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS STRING) || 'm' || CAST(event_id % 60 AS STRING) || '.5s' END AS text FROM {events}")
ERRORS = Given(
    X.ERRORS,
    """SELECT CAST(100 + event_id AS BIGINT) AS id, CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'view' THEN 413 WHEN event_type = 'click' THEN 500 END AS status,
    CASE WHEN event_id % 4 = 0 THEN 'Error code: ' WHEN event_id % 4 = 1 THEN 'tokens per minute ' WHEN event_id % 4 = 2 THEN 'quota per day ' ELSE '' END || props AS message FROM {events}""",
)
LINES = Given(X.LINES, "SELECT CAST(100 + event_id AS BIGINT) AS seq, CASE WHEN event_type = 'error' THEN 'FAIL:' || event_type || ':' || props WHEN event_type = 'view' THEN ' TIMEOUT:view' WHEN event_type = 'click' THEN props ELSE 'PASS:' || event_type END AS line FROM {events}")
CODE = Given(X.CODE, f"SELECT {NAME} AS module, 'module d;' || chr(10) || '  logic used;' || chr(10) || '  wire ' || source || ';' || chr(10) || text || chr(10) || 'assign y = used; // ' || source || chr(10) || 'endmodule' AS code FROM {{documents}}")
FILES = Given(X.FILES, f"SELECT {NAME} AS file, text FROM {{documents}}")
CHECKS = Given(X.CHECKS, f"SELECT source AS name, {NAME} AS file, lang AS needle FROM {{documents}}")
MARKDOWN = Given(X.MARKDOWN, f"SELECT {NAME} AS slug, text || chr(10) || '# ' || source || chr(10) || text || chr(10) || '### Part ' || lang || chr(10) || text AS text FROM {{documents}}")
VERILOG = Given(X.VERILOG, f"SELECT {NAME} AS slug, '// ' || source || chr(10) || 'module ' || source || ';' || chr(10) || text || chr(10) || 'endmodule' AS text FROM {{documents}}")
ASM = Given(X.ASM, f"SELECT {NAME} AS slug, '/isa/rv32ui/' || {NAME} || '.S' AS path, 'RVTEST_START' || chr(10) || 'TEST_RR_OP( ' || CAST(doc_id AS STRING) || ',  add, ' || source || ', 0x1 );' || chr(10) || text AS text FROM {{documents}}")
SPANS = Given(X.SPANS, "SELECT 'c' || CAST(conv_id AS STRING) AS doc, CAST(turn AS BIGINT) AS seq, text, CAST(CASE WHEN role = 'system' THEN 14 WHEN role = 'user' THEN 12 ELSE 10 END AS DOUBLE) AS size, CAST(turn + 1 AS INT) AS page FROM {conversations}")
VIEWS = Given(X.VIEWS, f"SELECT {NAME} AS slug, 'lost' || chr(10) || '<!-- chunk_id=' || {NAME} || '_0 | ' || source || ' -->' || chr(10) || chr(10) || text || chr(10) || chr(10) || lang AS text FROM {{documents}} WHERE doc_id % 2 = 0")
PARENTS = Given(X.PARENTS, f"SELECT {NAME} AS slug, {NAME} || '_0' AS chunk_id, lang AS section_title, text AS document_text FROM {{documents}}")
PATHS = Given(X.PATHS, "SELECT 'r/test_v' || CAST(doc_id AS STRING) || '.json' AS path FROM {documents}")
EDGES = Given(X.EDGES, "SELECT 'n' || CAST(n_nationkey AS STRING) AS src, 'r' || CAST(n_regionkey AS STRING) AS dst FROM {nation} UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) AS src, 'n' || CAST(c_nationkey AS STRING) AS dst FROM {customer}")
TRACE = Given(X.TRACE, "SELECT CAST(100 + event_id AS BIGINT) AS seq, user_id AS value FROM {events}")
MODULES = Given(X.MODULES, "SELECT CAST(100 + p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'control' WHEN p_partkey % 4 = 1 THEN 'alu' WHEN p_partkey % 4 = 2 THEN 'tb_cpu' ELSE 'imm_gen' END AS name FROM {part}")
NOW = Given(X.NOW, f"SELECT {NAME} AS slug, md5(text) AS file_hash FROM {{documents}}")
MANIFEST = Given(X.MANIFEST, f"SELECT CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE '' END || {NAME} AS slug, CASE WHEN doc_id % 3 = 0 THEN md5(source) ELSE md5(text) END AS file_hash FROM {{documents}}")
TABLES = Given(
    X.TABLES,
    "SELECT CAST(100 + l_orderkey * 10 + l_linenumber AS BIGINT) AS id, array(array(CAST(l_linenumber AS STRING), '30:25', l_returnflag), array('w', 'w', 'w'), array(CAST(l_shipdate AS STRING), '', l_linestatus), array('1', '', '7'), array(l_returnflag, 'x|y', l_linestatus)) AS rows FROM {lineitem}",
    "SELECT CAST(100 + l_orderkey * 10 + l_linenumber AS BIGINT) AS id, [[CAST(l_linenumber AS STRING), '30:25', l_returnflag], ['w', 'w', 'w'], [CAST(l_shipdate AS STRING), '', l_linestatus], ['1', '', '7'], [l_returnflag, 'x|y', l_linestatus]] AS rows FROM lineitem",
)
PLANS = Given(
    X.Inline("plan string, document string", [("p", '{"modules": [{"name": "alu", "depends_on": []}, {"name": "cpu", "depends_on": ["alu", "control"]}, {"name": "control"}], "other": 1}'), ("q", "{}"), ("r", "no json")]),
    """SELECT 'e' || CAST(event_id AS STRING) AS plan, chr(123) || '"modules": [' || chr(123) || '"name": "m' || CAST(user_id AS STRING) || '", "depends_on": ["' || event_type || '", "x"]' || chr(125) || ', ' || chr(123) || '"name": "x"'
    || chr(125) || '], "other": ' || props || chr(125) AS document FROM {events}""",
)
BASE_QUESTIONS = Given(X.Inline("key string, question string", [("ops", "which operations"), ("sizes", "which sizes")]), "SELECT 'item_' || CAST(item_id AS STRING) AS key, text AS question FROM {benchmark}")
DYNAMIC = Given(X.Inline("pos int, question string", [(0, "what else"), (1, "and then")]), "SELECT CAST(100 + item_id AS BIGINT) AS pos, text AS question FROM {benchmark}")
DOCUMENTS = Given(
    X.Inline("id bigint, document string", [(1, '{"a b": {"": [1, [2, {"deep": [true, null]}], "x"]}, "n": -1.5}'), (2, "7"), (3, "no json"), (4, None), (5, "[]"), (6, '{"e": {}, "s": "text"}')]),
    """SELECT 100 + event_id AS id, chr(123) || '"props": ' || props || ', "type": "' || event_type || '", "list": [' || CAST(user_id AS STRING) || ', ' || chr(123) || '"v": [' || CAST(event_id AS STRING) || ', []]' || chr(125) || ', "z"], "none": null'
    || chr(125) AS document FROM {events}""",
)
WORDS_ONLY = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' '{all}))"
_page = """SELECT doc_id AS page_id, '<html><body><nav><h2>Menu of the site</h2></nav><article><h1>Top</h1><h2 id="' || source || '">Part <i>' || source || '</i></h2><p>The <b>first</b> part of it, ' || {words}
    || '</p><table><tr><th>lang</th><th>id</th></tr><tr><td>' || lang || '</td><td>' || CAST(doc_id AS STRING) || '</td></tr></table><h4>' || lang || '</h4><p>A second part, that is long enough to stay as a section of its own.</p><ul><li>'
    || source || '</li><li>' || lang || '</li></ul></article></body></html>' AS html FROM {documents}"""
PAGES = Given(X.Inline("page_id bigint, html string", [(-1, None), (-2, ""), (-3, "<p>no heading</p>")]), _page.replace("{words}", WORDS_ONLY.format(all="")), _page.replace("{words}", WORDS_ONLY.format(all=", 'g'")))
