"""URL functions: source type, slug, raw and directory addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are not text to be read.
SKIP_EXTENSIONS = """
.svg .png .jpg .jpeg .gif .ico .webp .bin .elf .o .a .so .hex .mem .gz .zip .tar .ttf .woff .woff2
.core .pcf .lds .ld .h .c .cpp .py .yml .yaml .toml .json .gitignore
""".split()
#: Endings and what they say, in order.
TYPE_ENDINGS = ((r"\.(v|sv|vh)\z", "VERILOG"), (r"\.s\z", "ASM"), (r"\.md\z", "MARKDOWN"), (r"\.pdf\z", "PDF"), (r"\.html?\z", "HTML_DOC"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """What follows the host up to ? or #; of a text without scheme, the text up to there."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def raw_url(url: Column) -> Column:
    """A code host's page of a file to the file itself."""
    return F.replace(F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/blob/"), F.lit("/"))


def source_type(url: Column) -> Column:
    """HTML_DOC, VERILOG, ASM, GITHUB_DIR, MARKDOWN, PDF or SKIP. The skip test precedes all; what no ending tells is
    HTML_DOC, as a failed request for its content type is."""
    p, h = F.lower(path(url)), host(url)
    name = F.element_at(F.split(p, "/"), -1)
    ext = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")
    out = F.when(ext.isin(SKIP_EXTENSIONS), "SKIP").when(h == "api.github.com", "GITHUB_DIR").when(F.contains(h, F.lit("github.com")) & F.contains(path(url), F.lit("/tree/")), "GITHUB_DIR")
    for pattern, kind in TYPE_ENDINGS:
        out = out.when(p.rlike(pattern), kind)
    return out.otherwise("HTML_DOC")


def slug(url: Column) -> Column:
    """The last part of the path, else the host; known endings go, other characters than words and - become _; 60
    characters at most; doc if nothing is left."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    name = F.coalesce(F.when(F.size(parts) > 0, F.element_at(parts, -1)), host(url))
    name = F.regexp_replace(F.regexp_replace(name, r"(?i)\.(html?|md|v|sv|S)\z", ""), r"(?U)[^\w\-]", "_")
    return F.coalesce(F.nullif(F.left(name, F.lit(60)), F.lit("")), F.lit("doc"))


def file_slug(name: Column) -> Column:
    """A file's stem, cleaned, 40 characters at most."""
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.left(F.regexp_replace(stem, r"(?U)[^\w\-]", "_"), F.lit(40))


def directory_api(url: Column) -> Column:
    """A directory page of a code host to its listing; a repository page to its root listing; others stay."""
    tree, repo = r"^https?://github\.com/([^/]+)/([^/]+)/tree/([^/]+)(?:/(.*))?", r"^https?://github\.com/([^/]+)/([^/]+)"
    g = lambda k: F.regexp_extract(url, tree, k)
    r = lambda k: F.regexp_extract(url, repo, k)
    api = F.lit("https://api.github.com/repos/")
    return (
        F.when(F.contains(url, F.lit("api.github.com")), url)
        .when(url.rlike(tree), F.concat(api, g(1), F.lit("/"), g(2), F.lit("/contents/"), g(4), F.lit("?ref="), g(3)))
        .when(url.rlike(repo), F.concat(api, r(1), F.lit("/"), r(2), F.lit("/contents")))
        .otherwise(url)
    )
