"""Text functions: cleaning, token counts, salvage of JSON, and predicates on generated code. All are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the sparse index.
TOKEN = r"[a-zA-Z0-9_\-\.]+"
#: Where a sentence ends and the next begins.
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z\-`*])"
#: Patterns of Markdown noise and what takes their place, in order: figures, fences, table rows, quotes,
#: images, links, emphasis, heading marks, blanks.
CLEANING = (
    (r"`\[FIGURE:[^\]`]*\]`", ""),
    (r"```[\s\S]*?```", ""),
    (r"(?m)^\|.+\|$", ""),
    (r"(?m)^>.*$", ""),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[.*?\]\(.*?\)", ""),
    (r"\*{1,2}(.*?)\*{1,2}", "$1"),
    (r"#{1,6}\s+", ""),
    (r"[ \t]+", " "),
)
#: Signals of rate-limit messages; the minute ones come first.
MINUTE_SIGNALS = ("per minute", "tpm", "rpm", "rate_limit_exceeded", "request too large")
DAILY_SIGNALS = ("per day", "tpd", "rpd", "daily limit", "daily quota", "quota_exceeded", "insufficient_quota", "exceeded your current quota", "organization_quota_exceeded")
#: Constructs that a single-cycle design with external memory must not hold; matched in any case.
FORBIDDEN = (
    ("memory_array_logic", r"\blogic\s+\[\d+:\d+\]\s+\w+\s*\[\s*\d+\s*:\s*\d+\s*\]"),
    ("memory_array_reg", r"\breg\s+\[\d+:\d+\]\s+\w+\s*\["),
    ("pipeline_register", r"\b(IF_ID|ID_EX|EX_MEM|MEM_WB)\b"),
    ("hazard_logic", r"\bhazard\b|\bforward\b|\bstall\b|\bflush\b"),
)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_citations(c: Column) -> Column:
    """[11](url) to [REF:11]; of [[11](url)] the inner pair."""
    return F.regexp_replace(c, r"\[(\d+)\]\([^)]+\)", "[REF:$1]")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def tokens_by_words(c: Column) -> Column:
    """1.3 tokens a word, cut to a whole number."""
    return F.floor(word_count(c) * F.lit(1.3)).cast("int")


def tokens_by_chars(c: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def clean_paragraph(c: Column) -> Column:
    """Markdown noise goes, step by step in this order: figures, fences, table rows, quotes, images, links, emphasis,
    heading marks; then runs of blanks become one."""
    for pattern, to in CLEANING:
        c = F.regexp_replace(c, f"(?d){pattern}", to)
    return strip(c)


def light_clean(c: Column) -> Column:
    """What sentence packing takes out first: figures and table rows."""
    c = F.regexp_replace(F.regexp_replace(c, r"`\[FIGURE:[^\]`]*\]`", ""), r"\|[^\n]+\|", "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(light_clean(c), SENTENCE_GAP), strip), lambda s: F.length(s) > 25)


def strip_fences(c: Column) -> Column:
    """A code fence around the whole text goes."""
    c = F.regexp_replace(strip(c), r"(?i)^```[a-z]*\n?", "")
    return strip(F.regexp_replace(c, r"\n?```\s*\z", ""))


def _last(c: Column, ch: str) -> Column:
    """1-based position of the last ch, 0 if there is none."""
    at = F.locate(ch, F.reverse(c))
    return F.when(at > 0, F.length(c) - at + 1).otherwise(0)


def salvage_json(c: Column) -> Column:
    """The text as JSON (variant): as it is, else from the first { to the last }, else from the first [ to the last ];
    null if none parses."""
    c = strip(c)
    between = lambda a, b: F.when((F.locate(a, c) > 0) & (_last(c, b) > F.locate(a, c)), F.substr(c, F.locate(a, c), _last(c, b) - F.locate(a, c) + 1))
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(between("{", "}")), F.try_parse_json(between("[", "]")))


def json_substring(c: Column) -> Column:
    """Without fences, from the earliest of { [ to the latest of } ]; without either bracket, the text."""
    c = strip_fences(c)
    first = F.when((F.locate("{", c) > 0) & (F.locate("[", c) > 0), F.least(F.locate("{", c), F.locate("[", c))).otherwise(F.greatest(F.locate("{", c), F.locate("[", c)))
    last = F.greatest(_last(c, "}"), _last(c, "]"))
    return F.when(first == 0, c).when(last < first, F.substr(c, first)).otherwise(F.substr(c, first, last - first + 1))


def duration_seconds(c: Column) -> Column:
    """2m59.5s, 7.66s; a text of another form gives 0."""
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"^(?:(\d+)m)?(\d+(?:\.\d+)?)s", k), F.lit("")), F.lit("99999999D999999")).cast("double"), F.lit(0.0))
    return part(1) * 60 + part(2)


def error_class(status: Column, message: Column) -> Column:
    low = F.lower(message)
    has = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda s: F.contains(low, s))
    limited = (status == 429) | has(("rate", "quota", "429"))
    return F.when(status == 413, "request_size").when(F.coalesce(limited, F.lit(False)), F.when(has(MINUTE_SIGNALS), "per_minute").when(has(DAILY_SIGNALS), "daily").otherwise("per_minute")).otherwise("other")


def verdict(line: Column) -> dict[str, Column]:
    """PASS:name, FAIL:name:code, TIMEOUT:name, UNKNOWN:name; DONE and others have no status."""
    parts = F.split(line, ":", 3)
    kind = F.get(parts, 0)
    known = kind.isin("PASS", "FAIL", "TIMEOUT", "UNKNOWN") & (F.size(parts) > 1)
    return {"status": F.when(known, kind), "name": F.when(known, F.get(parts, 1)), "code": F.when(known, F.get(parts, 2))}


def version_of(path: Column) -> Column:
    """The number behind _v in a file name, null without one."""
    return F.nullif(F.regexp_extract(path, r"_v(\d+)", 1), F.lit("")).cast("int")


def _code_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def is_complete_module(code: Column) -> Column:
    """Without fences, the last line that isn't blank names endmodule."""
    return F.coalesce(F.contains(F.element_at(_code_lines(F.concat(F.lit("-\n"), F.regexp_replace(code, r"```\w*", ""))), -1), F.lit("endmodule")), F.lit(False))


def is_api_error(text: Column) -> Column:
    t = strip(text)
    return F.startswith(t, F.lit("// API ERROR:")) | F.contains(F.left(t, F.lit(120)), F.lit("Error code:"))


def open_blocks(code: Column) -> Column:
    """begin and case words less end and endcase words, comment lines left out."""
    lines = F.filter(F.transform(F.split(code, "\n"), strip), lambda x: ~F.startswith(x, F.lit("//")))
    n = lambda x, p: F.regexp_count(x, F.lit(p))
    return F.aggregate(lines, F.lit(0), lambda acc, x: acc + n(x, r"\b(begin|case|casez|casex)\b") - n(x, r"\b(end|endcase)\b"))


def strip_js_comments(c: Column) -> Column:
    """// to the end of the line, inside strings too; and a fence around the text."""
    return F.regexp_replace(strip_fences(c), r"(?d)//.*", "")


def block_title(lines: Column, fallback: Column) -> Column:
    """The first line that is neither blank nor a // comment, cut to 80 characters."""
    own = F.filter(F.transform(lines, strip), lambda x: (x != "") & ~F.startswith(x, F.lit("//")))
    return F.left(F.coalesce(F.get(own, F.lit(0)), fallback), F.lit(80))


def leading_comment(lines: Column) -> Column:
    """Comments read backwards from the last of the first five lines, until a line that is none."""
    back = F.reverse(F.transform(F.slice(lines, 1, 5), strip))
    state = F.aggregate(
        back,
        F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("got")),
        lambda a, x: F.when(a["done"] | ~F.startswith(x, F.lit("//")), F.struct(F.lit(True).alias("done"), a["got"].alias("got"))).otherwise(
            F.struct(F.lit(False).alias("done"), F.concat(F.array(strip(F.substr(x, F.lit(3)))), a["got"]).alias("got"))
        ),
    )
    return F.array_join(state["got"], " ")


def probe(text: Column, marker: str, n: int = 400) -> Column:
    """n characters from the marker on; null without it."""
    return F.when(F.locate(marker, text) > 0, F.substr(text, F.locate(marker, text), F.lit(n)))


def mask_key(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(4)), F.lit("…"), F.right(c, F.lit(4)))
