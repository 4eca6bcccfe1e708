"""Queries on text and URL functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import lint, stats
from quern.plans import fixtures as X
from quern.plans import given as G
from quern.sources.files import read_table


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


WORDS = r"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"
TOKENS = rf"CAST(floor({WORDS} * 1.3) AS INTEGER)"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
CLEAN = "text"
for _p, _to in T.CLEANING:
    CLEAN = f"regexp_replace({CLEAN}, '{_p}', '{_to.replace('$', chr(92))}', 'g')"
CLEAN = STRIP.format(x=CLEAN)
LAST = "(length({c}) - strpos(reverse({c}), '{ch}') + 1)"


def between(a: str, b: str) -> str:
    last = f"(CASE WHEN strpos(reverse(t), '{b}') > 0 THEN length(t) - strpos(reverse(t), '{b}') + 1 ELSE 0 END)"
    return f"CASE WHEN strpos(t, '{a}') > 0 AND {last} > strpos(t, '{a}') THEN substr(t, strpos(t, '{a}'), {last} - strpos(t, '{a}') + 1) END"


HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
ALL_URLS = f"(SELECT id, url FROM {X.URLS.sql()} UNION ALL SELECT 1000 + page_id, url FROM pages)"


def urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((1000 + F.col("page_id")).alias("id"), "url")
    return X.URLS.df(spark).select(F.col("id").cast("bigint").alias("id"), "url").unionByName(pages)


def _verdicts(spark, sf_dir):
    v = T.verdict(T.strip(F.col("line")))
    return G.LINES.df(spark, sf_dir).select("seq", v["status"].alias("status"), v["name"].alias("name"), v["code"].alias("code"))


QUERIES = {
    "tokens_by_word": lambda s, d: docs(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.tokens_by_words(F.col("text")).alias("n_tokens")),
    "tokens_by_char": lambda s, d: docs(s, d).select("doc_id", T.tokens_by_chars(F.col("text")).alias("n_tokens")),
    "tokenize": lambda s, d: docs(s, d).select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("tokens_md5")),
    "clean_text": lambda s, d: docs(s, d).select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("text_md5")),
    "content_hash": lambda s, d: docs(s, d).select("doc_id", F.md5("text").alias("content_md5")),
    "prefixes": lambda s, d: docs(s, d).select("doc_id", F.left("text", F.lit(120)).alias("fuse_key"), F.md5(F.left("text", F.lit(6000))).alias("parent_md5"), F.right("text", F.lit(30)).alias("tail")),
    "strip_citations": lambda s, d: G.CITED.df(s, d).select("id", T.strip_citations(F.col("text")).alias("text")),
    "clean_paragraph": lambda s, d: G.PARAGRAPHS.df(s, d).select("id", T.clean_paragraph(F.col("text")).alias("text")),
    "json_salvage": lambda s, d: G.SALVAGE.df(s, d).withColumn("v", T.salvage_json(F.col("text"))).select("id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.a", "int").alias("a")),
    "json_substring": lambda s, d: G.SALVAGE.df(s, d).select("id", T.json_substring(F.col("text")).alias("json")),
    "durations": lambda s, d: G.DURATIONS.df(s, d).select("id", T.duration_seconds(F.col("text")).alias("seconds")),
    "error_classes": lambda s, d: G.ERRORS.df(s, d).select("id", T.error_class(F.col("status"), F.col("message")).alias("class")),
    "verdict_lines": _verdicts,
    "probe": lambda s, d: docs(s, d).select("doc_id", T.probe(F.col("text"), "the").alias("found")),
    "source_type": lambda s, d: urls(s, d).select("id", U.source_type(F.col("url")).alias("source_type")),
    "url_slug": lambda s, d: urls(s, d).select("id", U.slug(F.col("url")).alias("slug")),
    "raw_url": lambda s, d: urls(s, d).select("id", U.raw_url(F.col("url")).alias("raw_url")),
    "api_url": lambda s, d: urls(s, d).select("id", U.directory_api(F.col("url")).alias("api_url")),
    "forbidden_patterns": lambda s, d: lint.violations(G.CODE.df(s, d)),
    "violation_lists": lambda s, d: lint.violation_lists(G.CODE.df(s, d)),
    "unused_signals": lambda s, d: lint.unused_signals(G.CODE.df(s, d)),
    "block_report": lambda s, d: lint.block_report(G.CODE.df(s, d)),
    "line_counts": lambda s, d: stats.line_counts(G.CODE.df(s, d)),
    "checklist": lambda s, d: stats.checklist(G.FILES.df(s, d), G.CHECKS.df(s, d)),
    "all_checks": lambda s, d: stats.all_pass(stats.checklist(G.FILES.df(s, d), G.CHECKS.df(s, d))),
    "api_errors": lambda s, d: G.ERRORS.df(s, d).select("id", T.is_api_error(F.concat(F.lit("  // API ERROR: "), "message")).alias("is_error"), T.is_api_error(F.col("message")).alias("bare_is_error")),
    "strip_js_comments": lambda s, d: G.SALVAGE.df(s, d).select("id", T.strip_js_comments(F.concat("text", F.lit(" // note\n1"))).alias("text")),
}

_rules = ", ".join(f"('{n}', '(?i){p}')" for n, p in T.FORBIDDEN)
_violations = f"SELECT module, rule FROM {G.CODE.sql()} c, (VALUES {_rules}) AS r(rule, pattern) WHERE regexp_matches(code, pattern)"
_signals = lambda xs: "(" + " OR ".join(f"contains(lower(message), '{x}')" for x in xs) + ")"
_low = f"lower({PATH})"
_name = f"list_extract(string_split({_low}, '/'), -1)"
_skip = ", ".join(f"'{x}'" for x in U.SKIP_EXTENSIONS)
_kinds = " ".join(f"WHEN regexp_matches({_low}, '{p[:-2]}$') THEN '{k}'" for p, k in U.TYPE_ENDINGS)
_parts = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
_tree, _repo = r"^https?://github\.com/([^/]+)/([^/]+)/tree/([^/]+)(?:/(.*))?", r"^https?://github\.com/([^/]+)/([^/]+)"
_decl = lint.DECLARATION
_checks = f"SELECT name, bool_and(coalesce(contains(text, needle), false)) AS passed FROM {G.CHECKS.sql()} k LEFT JOIN {G.FILES.sql()} f ON k.file = f.file GROUP BY name"
_fence = STRIP.format(x=r"regexp_replace(regexp_replace(" + STRIP.format(x="text") + r", '(?i)^```[a-z]*\n?', ''), '\n?```\s*$', '')")
_js = STRIP.format(x=r"regexp_replace(regexp_replace(" + STRIP.format(x="text || ' // note' || chr(10) || '1'") + r", '(?i)^```[a-z]*\n?', ''), '\n?```\s*$', '')")

SQL = {
    "tokens_by_word": f"SELECT doc_id, {WORDS.format(x='text')} AS n_words, {TOKENS.format(x='text')} AS n_tokens FROM documents",
    "tokens_by_char": "SELECT doc_id, greatest(1, length(text) // 4) AS n_tokens FROM documents",
    "tokenize": r"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_\-\.]+') AS t FROM documents)",
    "clean_text": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM documents",
    "content_hash": "SELECT doc_id, md5(text) AS content_md5 FROM documents",
    "prefixes": "SELECT doc_id, left(text, 120) AS fuse_key, md5(left(text, 6000)) AS parent_md5, right(text, 30) AS tail FROM documents",
    "strip_citations": rf"SELECT id, regexp_replace(text, '\[(\d+)\]\([^)]+\)', '[REF:\1]', 'g') AS text FROM {G.CITED.sql()}",
    "clean_paragraph": f"SELECT id, {CLEAN} AS text FROM {G.PARAGRAPHS.sql()}",
    "json_salvage": f"WITH t AS (SELECT id, {STRIP.format(x='text')} AS t FROM {G.SALVAGE.sql()}), j AS (SELECT id, CASE WHEN json_valid(t) THEN t WHEN json_valid({between('{', '}')}) THEN {between('{', '}')} WHEN json_valid({between('[', ']')}) THEN {between('[', ']')} END AS j FROM t) SELECT id, j IS NOT NULL AS parsed, CAST(json_extract_string(j, '$.a') AS INTEGER) AS a FROM j",
    "json_substring": f"""WITH t AS (SELECT id, {_fence} AS t FROM {G.SALVAGE.sql()}),
        p AS (SELECT id, t, strpos(t, '{{') AS o, strpos(t, '[') AS a, greatest(CASE WHEN strpos(t, '}}') > 0 THEN length(t) - strpos(reverse(t), '}}') + 1 ELSE 0 END, CASE WHEN strpos(t, ']') > 0 THEN length(t) - strpos(reverse(t), ']') + 1 ELSE 0 END) AS z FROM t),
        q AS (SELECT id, t, z, CASE WHEN o > 0 AND a > 0 THEN least(o, a) ELSE greatest(o, a) END AS f FROM p)
        SELECT id, CASE WHEN f = 0 THEN t WHEN z < f THEN substr(t, f) ELSE substr(t, f, z - f + 1) END AS json FROM q""",
    "durations": rf"SELECT id, coalesce(TRY_CAST(regexp_extract(text, '^(?:(\d+)m)?(\d+(?:\.\d+)?)s', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(text, '^(?:(\d+)m)?(\d+(?:\.\d+)?)s', 2) AS DOUBLE), 0) AS seconds FROM {G.DURATIONS.sql()}",
    "error_classes": f"SELECT id, CASE WHEN status = 413 THEN 'request_size' WHEN coalesce(status = 429, false) OR {_signals(('rate', 'quota', '429'))} THEN CASE WHEN {_signals(T.MINUTE_SIGNALS)} THEN 'per_minute' WHEN {_signals(T.DAILY_SIGNALS)} THEN 'daily' ELSE 'per_minute' END ELSE 'other' END AS class FROM {G.ERRORS.sql()}",
    "verdict_lines": f"""WITH p AS (SELECT seq, regexp_extract({STRIP.format(x='line')}, '^(PASS|FAIL|TIMEOUT|UNKNOWN):([^:]*)(?::([\\s\\S]*))?$', ['s', 'n', 'c']) AS r, contains(regexp_replace({STRIP.format(x='line')}, '^[A-Z]+:[^:]*', ''), ':') AS has FROM {G.LINES.sql()})
        SELECT seq, nullif(r.s, '') AS status, CASE WHEN r.s <> '' THEN r.n END AS name, CASE WHEN has AND r.s <> '' THEN r.c END AS code FROM p""",
    "probe": "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN substr(text, strpos(text, 'the'), 400) END AS found FROM documents",
    "source_type": f"SELECT id, CASE WHEN (CASE WHEN contains({_name}, '.') THEN '.' || list_extract(string_split({_name}, '.'), -1) ELSE '' END) IN ({_skip}) THEN 'SKIP' WHEN {HOST} = 'api.github.com' THEN 'GITHUB_DIR' WHEN contains({HOST}, 'github.com') AND contains({PATH}, '/tree/') THEN 'GITHUB_DIR' {_kinds} ELSE 'HTML_DOC' END AS source_type FROM {ALL_URLS}",
    "url_slug": rf"SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(CASE WHEN len({_parts}) > 0 THEN list_extract({_parts}, -1) ELSE {HOST} END, '(?i)\.(html?|md|v|sv|S)$', ''), '[^\w\-]', '_', 'g'), 60), ''), 'doc') AS slug FROM {ALL_URLS}",
    "raw_url": f"SELECT id, replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') AS raw_url FROM {ALL_URLS}",
    "api_url": f"""SELECT id, CASE WHEN contains(url, 'api.github.com') THEN url
        WHEN regexp_matches(url, '{_tree}') THEN 'https://api.github.com/repos/' || regexp_extract(url, '{_tree}', 1) || '/' || regexp_extract(url, '{_tree}', 2) || '/contents/' || regexp_extract(url, '{_tree}', 4) || '?ref=' || regexp_extract(url, '{_tree}', 3)
        WHEN regexp_matches(url, '{_repo}') THEN 'https://api.github.com/repos/' || regexp_extract(url, '{_repo}', 1) || '/' || regexp_extract(url, '{_repo}', 2) || '/contents' ELSE url END AS api_url FROM {ALL_URLS}""",
    "forbidden_patterns": _violations,
    "violation_lists": f"SELECT c.module, count(rule) AS n, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS rules FROM {G.CODE.sql()} c LEFT JOIN ({_violations}) v ON c.module = v.module GROUP BY c.module",
    "unused_signals": rf"""WITH l AS (SELECT module, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM {G.CODE.sql()}),
        d AS (SELECT module, regexp_extract(line, '{_decl}', 1) AS signal, max(i) AS decl FROM l WHERE regexp_matches(line, '{_decl}') GROUP BY 1, 2),
        r AS (SELECT d.module, d.signal, d.decl, l.i FROM d JOIN l ON d.module = l.module WHERE list_contains(regexp_extract_all(regexp_replace(line, '//.*', ''), '\w+'), d.signal))
        SELECT module, signal FROM r GROUP BY module, signal, decl HAVING count(*) = 1 AND min(i) = decl""",
    "block_report": rf"""WITH l AS (SELECT module, {STRIP.format(x="unnest(string_split(code, chr(10)))")} AS line FROM {G.CODE.sql()}),
        o AS (SELECT module, sum(CASE WHEN starts_with(line, '//') THEN 0 ELSE len(regexp_extract_all(line, '\b(begin|case|casez|casex)\b')) - len(regexp_extract_all(line, '\b(end|endcase)\b')) END) AS open_blocks FROM l GROUP BY module),
        k AS (SELECT module, contains(list_extract(list_filter(string_split(regexp_replace(code, '```\w*', '', 'g'), chr(10)), lambda x: {STRIP.format(x='x')} <> ''), -1), 'endmodule') AS complete FROM {G.CODE.sql()})
        SELECT o.module, CAST(open_blocks AS INTEGER) AS open_blocks, complete FROM o JOIN k ON o.module = k.module""",
    "line_counts": rf"SELECT module, len(string_split(regexp_replace(code, '\n$', ''), chr(10))) AS lines FROM {G.CODE.sql()}",
    "checklist": _checks,
    "all_checks": f"SELECT bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS failed FROM ({_checks})",
    "api_errors": f"SELECT id, true AS is_error, starts_with(message, '// API ERROR:') OR contains(left(message, 120), 'Error code:') AS bare_is_error FROM {G.ERRORS.sql()}",
    "strip_js_comments": f"SELECT id, regexp_replace({_js}, '//[^\\n]*', '', 'g') AS text FROM {G.SALVAGE.sql()}",
}
