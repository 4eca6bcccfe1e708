"""URL filters: explicit host and path rules first, then association rules mined by FP-growth from pages whose verdict is
known, by an explicit rule or by a label.

Native: string functions, Spark's own FP-growth, and an inverted index join; no Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, lower_ascii, pack, table, unpack

#: Tokens of a rule at most, and tokens of one transaction of FP-growth at most: so an itemset's subsets are bounded. Wider
#: urls become several transactions that together hold every LONGEST of their tokens.
LONGEST, WIDEST = 3, 12
#: Parts in which the urls of one token meet the rules filed under it.
SALTS = 8
RULE = "antecedent array<string>, confidence double, lift double, support double"
#: The contract's rules: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; query: after
    ? up to #. Null or no ://: all empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return {
        "host": lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a url: host labels, the last of them also as the top-level domain, path segments, query keys."""
    part = lambda c, sep, kind: F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    top = F.when(host != "", F.array(F.concat(F.lit("t:"), F.substring_index(host, ".", -1)))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(part(host, "[.]", "h:"), top, part(path, "/", "p:"), keys))


def explicit_rule(host: Column, path: Column, rules=RULES) -> dict[str, Column]:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return {"rule": name, "verdict": verdict}


def filed(sets: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """(token, salt, `name`): each set of tokens under the one of its tokens that is rarest by counts (token, n)."""
    one = sets.select(name, F.explode(name).alias("token")).join(counts, "token", "left").groupBy(name).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def met(rows: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """rows (tokens, others) with each set of the index that is part of their tokens."""
    dealt = rows.select("*", F.explode("tokens").alias("token")).withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int"))
    return dealt.join(index, ["token", "salt"]).filter(F.size(F.array_intersect("tokens", name)) == F.size(name)).drop("token", "salt")


def transactions(rows: DataFrame, longest: int, widest: int = WIDEST) -> DataFrame:
    """items: tokens of each row (tokens, without repeats) in transactions of `widest` at most, such that any `longest` tokens
    of a row are together in one. A wider row is cut into chunks of widest / longest, and every `longest` chunks are one
    transaction."""
    width = max(1, widest // longest)
    n = F.ceil(F.size("tokens") / width).cast("int")
    chunk = lambda i: F.slice("tokens", i * width + 1, F.lit(width))
    whole = rows.filter(F.size("tokens") <= longest * width).select(F.col("tokens").alias("items"))
    wide = rows.filter(F.size("tokens") > longest * width).select("tokens", F.lit(-1).alias("last"), F.array().cast("array<string>").alias("items"))
    for k in range(longest):
        wide = wide.select("tokens", "items", F.explode(F.sequence(F.col("last") + 1, n - (longest - k))).alias("last")).select("tokens", "last", F.concat("items", chunk(F.col("last"))).alias("items"))
    return whole.unionByName(wide.select("items"))


def mine_rules(labelled: DataFrame, scratch: Scratch, *, min_rows: int = 20, min_confidence: float = 0.9, min_odds: float = 2.0, longest: int = LONGEST) -> DataFrame:
    """Rules (antecedent array<string>, confidence, lift, support) that say bad, from (tokens array<string>, bad boolean).

    FP-growth over the bad rows gives the candidates: itemsets of up to `longest` tokens on `min_rows` bad rows, however many
    rows there are. Each candidate is then counted over all rows, through an index by its rarest token. A rule multiplies the
    odds of bad by `min_odds` at least, which a sure one does at any share of bad rows. Tokens on fewer bad rows are in no
    candidate and are left out of what FP-growth reads; a url that still has more than WIDEST gives transactions that together
    hold every `longest` of its tokens, so no candidate is lost, and what they count twice the count over all rows sets right. No rows, or
    all or none bad: no rules.
    """
    spark = labelled.sparkSession
    rows = scratch.write(labelled.filter(F.size("tokens") > 0).select(F.array_sort("tokens").alias("tokens"), "bad"))
    n, n_bad = rows.agg(F.count("*"), F.count_if(F.col("bad"))).first()
    if n_bad in (0, n):
        return spark.createDataFrame([], RULE)
    one = rows.filter("bad").select(F.monotonically_increasing_id().alias("row"), "tokens")
    often = one.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    left = one.select("row", F.explode("tokens").alias("token")).join(often.select("token"), "token").groupBy("row").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    bad = scratch.write(transactions(left, longest))
    if bad.isEmpty():
        return spark.createDataFrame([], RULE)
    fp = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / bad.count()), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.write(fp.fit(bad).freqItemsets.filter(F.size("items") <= longest).select(F.array_sort("items").alias("antecedent"), "freq"))
    counts = found.filter(F.size("antecedent") == 1).select(F.element_at("antecedent", 1).alias("token"), F.col("freq").alias("n"))
    seen = met(rows, filed(found.select("antecedent"), "antecedent", counts), "antecedent").groupBy("antecedent").agg(F.count("*").alias("c"), F.count_if(F.col("bad")).alias("b"))
    sure, base = F.col("b") / F.col("c"), n_bad / n
    good = seen.filter((F.col("b") >= min_rows) & (sure >= min_confidence) & (sure * (1 - base) >= min_odds * base * (1 - sure)))
    return scratch.write(good.select("antecedent", sure.alias("confidence"), (sure / base).alias("lift"), (F.col("b") / n).alias("support")))


def pruned(rules: DataFrame) -> DataFrame:
    """The rules without those that a shorter one of no less confidence implies."""
    key = lambda c: F.array_join(c, "\n")
    whole = F.col("antecedent")
    one = F.transform(whole, lambda x: F.array(x))
    two = F.flatten(F.transform(whole, lambda x, i: F.transform(F.slice(whole, i + 2, F.size(whole)), lambda y: F.array(x, y))))
    parts = rules.select(key(whole).alias("k"), "confidence", F.explode(F.filter(F.concat(one, two), lambda x: F.size(x) < F.size(whole))).alias("part"))
    known = rules.select(key(whole).alias("p"), F.col("confidence").alias("sure"))
    gone = parts.join(known, key(F.col("part")) == F.col("p")).filter("sure >= confidence").select(F.col("k").alias("gone")).distinct()
    return rules.join(gone, key(whole) == F.col("gone"), "left_anti")


def matching_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict): what the surest rule (antecedent, confidence, verdict) says whose tokens are part of the url's; of
    equally sure ones the longest, then block."""
    counts = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = met(urls, filed(rules.select("antecedent").distinct(), "antecedent", counts), "antecedent")
    best = F.max(F.struct("confidence", F.size("antecedent").alias("n"), "verdict"))["verdict"]
    return found.join(rules.select("antecedent", "confidence", "verdict"), "antecedent").groupBy("url").agg(best.alias("verdict"))


def known_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, tokens, bad) of the pages whose verdict is known: by the explicit rule that fits, else by their labels
    (quality 0 or toxic 1 is bad)."""
    p = url_parts(F.col("url"))
    parts = pages.select("page_id", "url").withColumns({**p, "tokens": url_tokens(p["host"], p["path"], p["query"])})
    says = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))  # null only if both are
    bad = labels.groupBy("doc_id").agg(F.max(says).alias("bad")).filter("bad IS NOT NULL")
    r = explicit_rule(F.col("host"), F.col("path"), rules)
    both = parts.join(bad, F.col("page_id") == F.col("doc_id"), "left").withColumn("bad", F.coalesce(r["verdict"] == "block", F.col("bad") == 1))
    return both.filter("bad IS NOT NULL").select("page_id", "url", "tokens", "bad")


def mine_verdicts(known: DataFrame, scratch: Scratch, **mining) -> DataFrame:
    """Rules (antecedent, confidence, lift, support, verdict) from (tokens, bad): mined for block and for allow, pruned."""
    block = pruned(mine_rules(known.select("tokens", "bad"), scratch, **mining)).withColumn("verdict", F.lit("block"))
    allow = pruned(mine_rules(known.select("tokens", (~F.col("bad")).alias("bad")), scratch, **mining)).withColumn("verdict", F.lit("allow"))
    return scratch.write(block.unionByName(allow))


def judge_urls(pages: DataFrame, labels: DataFrame, scratch: Scratch, *, rules=RULES, **mining) -> DataFrame:
    """pages with uf_host, uf_path, uf_rule and uf_verdict.

    pages: page_id, url and any other columns. labels: doc_id (a page_id), quality, toxic; see known_verdicts. An explicit
    rule decides where one fits, else the surest mined rule that matches, and the rest is allowed. Null or malformed urls
    have no tokens and no host: allowed. Repeated rows are judged alike; a page with several labels is bad if one says so.
    Empty tables: empty result, or no mined rules. The mined match runs on distinct urls, so that one url of a third of all
    rows costs one match. Columns of the names added are replaced.
    """
    p = url_parts(F.col("url"))
    mined = mine_verdicts(scratch.write(known_verdicts(pages, labels, rules)), scratch, **mining)
    urls = pages.select("url").distinct().withColumns({**p, "tokens": url_tokens(p["host"], p["path"], p["query"])}).select("url", "tokens")
    hit = matching_urls(urls, mined).select(F.col("url").alias("uf_url"), F.col("verdict").alias("uf_hit"))
    out = pack(pages, "url").withColumns({"uf_host": p["host"], "uf_path": p["path"]}).join(hit, F.col("url") == F.col("uf_url"), "left")
    r = explicit_rule(F.col("uf_host"), F.col("uf_path"), rules)
    verdict = F.coalesce(r["verdict"], F.col("uf_hit"), F.lit("allow"))
    return unpack(out, pages.columns, "url", uf_host=F.col("uf_host"), uf_path=F.col("uf_path"), uf_rule=r["rule"], uf_verdict=verdict)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all pages; see judge_urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge_urls(pages, table(spark, sf_dir, "labels"), Scratch(spark))
    return out.select("page_id", *(F.col(f"uf_{x}").alias(x) for x in ("host", "path", "rule", "verdict")))
