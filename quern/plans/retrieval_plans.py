"""Queries on passages, BM25, cosine search, fusion and prompts, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import chunkers as C
from quern.operators import incremental as I
from quern.operators import retrieval as R
from quern.operators.latent import latent_embedder
from quern.plans import fixtures as X
from quern.plans import given as G
from quern.plans.text_plans import CLEAN, STRIP, TOKENS, docs
from quern.operators.vectors import VectorStore, matrix
from quern.sources.files import stream_table
from quern.sources.scratch import Scratch
from quern.streaming.ledger import Ledger

#: The cosine search asks with every vector whose id this divides, against all vectors.
QUERY_EVERY = 50


def questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("child_id"), "embedding", "label")


def asked_vectors(v):
    return v.filter(F.col("child_id") % QUERY_EVERY == 0)


def index(spark, sf_dir, scratch=None):
    return R.Index.build(R.children_of(docs(spark, sf_dir)), scratch or Scratch(spark))


def bm25(spark, sf_dir, k=R.BM25_FETCH):
    return R.bm25_topk(index(spark, sf_dir), questions(spark, sf_dir), k)


def contexts(spark, sf_dir, expander=None):
    scratch = Scratch(spark)
    return R.retrieve(index(spark, sf_dir, scratch), docs(spark, sf_dir), questions(spark, sf_dir), scratch, expander=expander)


def kept_index(spark, sf_dir):
    """An index of the first half of the documents, kept, read again and brought up to date with the others and with a
    changed text of every tenth."""
    scratch, all_docs = Scratch(spark), docs(spark, sf_dir)
    early = all_docs.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("An earlier state. "), "text")).otherwise(F.col("text")))
    at = scratch.path()
    R.Index.build(R.children_of(early), scratch, at)
    late = all_docs.filter("doc_id % 2 = 1 OR doc_id % 10 = 0")
    return R.Index.load(spark, at).replaced(R.children_of(late), late.select(F.col("doc_id").alias("parent_id")), scratch)


def ingested(spark, sf_dir):
    """Documents as a stream of sources into a ledger that holds an earlier state of half of them: each document's hash and
    number of passages afterwards, by the last batch that changed it."""
    scratch, earlier = Scratch(spark), F.concat(F.lit("An earlier state. "), F.coalesce("text", F.lit("")))
    early = docs(spark, sf_dir).filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, earlier).otherwise(F.col("text")))
    hashed = lambda d: d.select(F.col("doc_id").cast("string").alias("slug"), F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"), "doc_id", "source", "text")
    ledger = Ledger(spark, scratch.path(), "slug string, doc_id long, source string, text string")
    ledger.apply(0, hashed(early))
    stream = stream_table(spark, sf_dir, "documents", "doc_id long, text string, lang string, source string, n_chars long")
    ledger.ingest(hashed(stream), scratch.path(), epoch=1).awaitTermination()
    kids = R.children_of(ledger.rows()).groupBy("parent_id").agg(F.count("*").alias("n"))
    last = ledger.manifest().select(F.col("slug").cast("long").alias("doc_id"), "file_hash", (F.col("number") > 0).alias("changed"))
    return last.join(kids, F.col("doc_id") == F.col("parent_id"), "left").select("doc_id", "file_hash", "changed", F.coalesce("n", F.lit(0)).alias("n_children"))


def cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.cosine_topk(v, asked_vectors(v).select(F.col("child_id").alias("question_id"), "embedding"), key=("child_id",))


def cosine_label(spark, sf_dir):
    """By label of the query: queries, and those whose nearest other vector has the same label."""
    v = vectors(spark, sf_dir)
    q = asked_vectors(v)
    top = R.cosine_topk(v, q.select(F.col("child_id").alias("question_id"), "embedding"), 2, ("child_id",)).filter(F.col("question_id") != F.col("child_id"))
    best = top.groupBy("question_id").agg(F.min_by("child_id", "rank").alias("child_id"))
    a, b = q.select(F.col("child_id").alias("question_id"), F.col("label").alias("asked")), v.select("child_id", F.col("label").alias("found"))
    return best.join(a, "question_id").join(b, "child_id").groupBy("asked").agg(F.count("*").alias("queries"), F.count_if(F.col("asked") == F.col("found")).alias("same_label"))


def vector_store(spark, sf_dir):
    """A store whose sources (the labels) of even number hold earlier vectors at first, then replaced by the given ones, asked
    with every vector whose id 50 divides."""
    scratch, v = Scratch(spark), vectors(spark, sf_dir).withColumn("source", F.col("label").cast("string"))
    late = v.filter("label % 2 = 0")
    early = late.withColumn("embedding", F.reverse("embedding")).unionByName(late.withColumn("child_id", F.col("child_id") + 1_000_000_000))
    store = VectorStore(spark, scratch.path(), ("child_id",)).create(v.filter("label % 2 <> 0 OR label IS NULL").unionByName(early))
    store.replace(late)
    asked = asked_vectors(v).filter("embedding IS NOT NULL").select(F.col("child_id").alias("question_id"), "embedding")
    out = None
    for block in R.blocks_of(asked, F.size("embedding") * 8):
        found = store.search(block.column(0).to_numpy(), matrix(block.column(1).combine_chunks()) if block.num_rows else np.empty((0, 1)), R.TOP_CHILDREN, scratch).hits
        out = found if out is None else out.unionByName(found)
    return R.top_k(out, R.TOP_CHILDREN)


def dense(spark, sf_dir):
    return R.cosine_topk(R.children_of(docs(spark, sf_dir)), R.embed(questions(spark, sf_dir), ("question_id",), "question"), embedder=R.HashingEmbedder())


def dense_latent(spark, sf_dir):
    """The dense search with vectors learnt from the passages themselves."""
    scratch = Scratch(spark)
    passages = scratch.write(R.children_of(docs(spark, sf_dir)))
    learnt = latent_embedder(passages, scratch.write(R.term_counts(passages)), scratch=scratch)
    return R.cosine_topk(passages, R.embed(questions(spark, sf_dir), ("question_id",), "question", learnt), embedder=learnt)


FUSE = X.Inline(
    "list int, question_id int, rank int, parent_id string, title string, text string",
    [
        (0, 1, 0, "p1", "A", "x" * 120 + "one"), (0, 1, 1, "p2", "B", "x" * 120 + "two"), (0, 1, 2, "p3", "C", "alone in dense"),
        (1, 1, 0, "p4", "D", "alone in sparse"), (1, 1, 1, "p1", "A", "x" * 120 + "three"), (1, 1, 2, "p5", "E", "alone in sparse, too"), (1, 2, 0, "p6", "F", "other question"),
    ],
)


def fuse_inline(spark, sf_dir, dedup=False):
    f = FUSE.df(spark)
    side = lambda k: f.filter(F.col("list") == k).drop("list")
    return R.fuse(side(0), side(1), dedup=dedup).select("question_id", "rank", "parent_id", "title", F.length("text").alias("n_chars"), "score")


def fused(spark, sf_dir):
    scratch = Scratch(spark)
    return R.fuse(*R.both_lists(index(spark, sf_dir, scratch), questions(spark, sf_dir), scratch)).select("question_id", "rank", "parent_id", "title", F.md5("key").alias("key_md5"), "score")


def prompt_budget(spark, sf_dir):
    """The flagship: questions to passages by both searches, fused, expanded to parents and budgeted."""
    q = questions(spark, sf_dir)
    return R.prompts(q, contexts(spark, sf_dir)).select("question_id", "n_parents", F.md5("user_content").alias("content_md5"), "prompt_tokens", R.output_allowance(F.col("prompt_tokens")).alias("allowance"))


QUERIES = {
    "sentence_pack": lambda s, d: R.children_of(docs(s, d)).select("parent_id", "ord", F.md5("text").alias("text_md5")),
    "paragraph_split": lambda s, d: C.paragraphs(G.VIEWS.df(s, d), "slug"),
    "divider_split": lambda s, d: C.divider_sections(G.VIEWS.df(s, d)),
    "hierarchy_fallback": lambda s, d: I.children(G.PARENTS.df(s, d), G.VIEWS.df(s, d)),
    "bm25_stats": lambda s, d: R.bm25_stats(R.children_of(docs(s, d))).select("n_children", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings"),
    "bm25_topk": bm25,
    "bm25_prefilter": lambda s, d: bm25(s, d, 2),
    "bm25_kept_index": lambda s, d: kept_index(s, d).terms.select("term", "df"),
    "bm25_kept_topk": lambda s, d: R.bm25_topk(kept_index(s, d), questions(s, d)),
    "postings": lambda s, d: index(s, d).blocks.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"), F.max("max_tf").alias("max_tf")),
    "stream_ingest": ingested,
    "cosine_topk": cosine,
    "cosine_top1_label": cosine_label,
    "vector_store_topk": vector_store,
    "dense_topk": dense,
    "dense_latent": dense_latent,
    "rrf_fuse": fused,
    "rrf_duplicate_keys": fuse_inline,
    "rrf_dedup": lambda s, d: fuse_inline(s, d, True),
    "expand_parents": lambda s, d: contexts(s, d).select("question_id", "ord", "parent_id", "section_title", F.md5("full_text").alias("text_md5"), F.md5("child_matched").alias("child_md5"), "score"),
    "prompt_budget": prompt_budget,
}

LIGHT = STRIP.format(x=r"regexp_replace(regexp_replace(regexp_replace(text, '`\[FIGURE:[^\]`]*\]`', '', 'g'), '\|[^\n]+\|', '', 'g'), '[ \t]+', ' ', 'g')")
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({LIGHT}, '([.!?])\s+([A-Z\-`*])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {STRIP.format(x='s')}), lambda s: length(s) > 25)"


def packed(source: str, key: str) -> str:
    """CTEs that end in pk(key, g, text, ord): packed passages of `source` (key, text)."""
    return rf"""sl AS (SELECT {key}, {SENTENCES} AS ss FROM {source}),
    se AS (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sl),
    st AS (SELECT *, {TOKENS.format(x='s')} AS t FROM se),
    pa AS (SELECT {key}, i, 0 AS g, t AS n FROM st WHERE i = 1
           UNION ALL SELECT st.{key}, st.i, CASE WHEN pa.n + st.t > 120 THEN g + 1 ELSE g END, CASE WHEN pa.n + st.t > 120 THEN st.t ELSE pa.n + st.t END
           FROM pa JOIN st ON st.{key} = pa.{key} AND st.i = pa.i + 1),
    pg AS (SELECT pa.{key}, g, string_agg(s, ' ' ORDER BY pa.i) AS text FROM pa JOIN st ON pa.{key} = st.{key} AND pa.i = st.i GROUP BY pa.{key}, g),
    pk AS (SELECT {key}, g, text, row_number() OVER (PARTITION BY {key} ORDER BY g) - 1 AS ord FROM pg WHERE length(text) > 30)"""


KIDS = f"{packed('documents', 'doc_id')}, kids AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pk.doc_id, ord) AS child_id, pk.doc_id AS parent_id, CAST(ord AS INTEGER) AS ord, source AS title, pk.text FROM pk JOIN documents d ON pk.doc_id = d.doc_id)"
TOK = r"regexp_extract_all(lower({x}), '[a-zA-Z0-9_\-\.]+')"


def bm25_sql(k: int) -> str:
    return f"""kt AS MATERIALIZED (SELECT child_id, {TOK.format(x='text')} AS t FROM kids),
    dl AS (SELECT child_id, len(t) AS dl FROM kt), av AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    tf AS MATERIALIZED (SELECT child_id, term, count(*) AS tf FROM (SELECT child_id, unnest(t) AS term FROM kt) GROUP BY 1, 2),
    rawidf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, av GROUP BY term, n),
    fl AS (SELECT avg(idf) * 0.25 AS least FROM rawidf), idf AS (SELECT term, CASE WHEN idf < 0 THEN least ELSE idf END AS idf FROM rawidf, fl),
    qt AS (SELECT question_id, term, count(*) AS qf FROM (SELECT item_id AS question_id, unnest({TOK.format(x='text')}) AS term FROM benchmark) GROUP BY 1, 2),
    sc AS (SELECT question_id, child_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (child_id), av GROUP BY 1, 2),
    fi AS (SELECT question_id, child_id, coalesce(score, 0) AS score FROM (SELECT item_id AS question_id, child_id FROM benchmark, kids) LEFT JOIN sc USING (question_id, child_id)),
    sp AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, child_id) - 1 AS INTEGER) AS rank, child_id, round(score, 6) AS score FROM fi QUALIFY rank < {k})"""


def vec(source: str, key: str) -> str:
    return f"(SELECT {key}, j, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM (SELECT {key}, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS j FROM (SELECT {key}, md5(unnest({TOK.format(x='text')})) AS h FROM {source})) GROUP BY {key}, j)"


DENSE = f"""kv AS MATERIALIZED {vec('kids', 'child_id')}, qv AS MATERIALIZED {vec('(SELECT item_id AS question_id, text FROM benchmark)', 'question_id')},
    kn AS (SELECT child_id, sqrt(sum(v * v)) AS n FROM kv GROUP BY 1), qn AS (SELECT question_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1),
    dp AS (SELECT question_id, child_id, sum(CAST(kv.v AS DOUBLE) * qv.v) AS p FROM kv JOIN qv USING (j) GROUP BY 1, 2),
    ds AS (SELECT question_id, child_id, CASE WHEN kn.n * qn.n = 0 THEN 0 ELSE p / (kn.n * qn.n) END AS score FROM dp JOIN kn USING (child_id) JOIN qn USING (question_id)),
    de AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, child_id) - 1 AS INTEGER) AS rank, child_id, round(score, 6) AS score FROM ds QUALIFY rank < 12)"""


def fuse(source: str, dedup: bool = False) -> str:
    """CTEs that end in fu(question_id, rank, key, parent_id, title, text, score) from hits (list, question_id, rank, ...)."""
    once = "QUALIFY row_number() OVER (PARTITION BY question_id, key, list ORDER BY rank) = 1" if dedup else ""
    return f"""ha AS (SELECT *, left(text, 120) AS key FROM {source} {once}),
    kx AS (SELECT question_id, key, sum(1.0::DOUBLE / (60 + rank + 1)) AS score, min(list * 1000000 + rank) AS first,
                  coalesce(arg_max({{'p': parent_id, 't': title, 'x': text}}, rank) FILTER (list = 0), arg_min({{'p': parent_id, 't': title, 'x': text}}, rank) FILTER (list = 1)) AS h FROM ha GROUP BY 1, 2),
    fu AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, first) - 1 AS INTEGER) AS rank, key, h.p AS parent_id, h.t AS title, h.x AS text, round(score, 6) AS score FROM kx QUALIFY rank < 12)"""


LISTS = f"{KIDS}, {bm25_sql(15)}, {DENSE}, hi AS (SELECT 0 AS list, question_id, rank, parent_id, title, text FROM de JOIN kids USING (child_id) UNION ALL SELECT 1, question_id, rank, parent_id, title, text FROM sp JOIN kids USING (child_id)), {fuse('hi')}"
EXPAND = f"""{LISTS}, f1 AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY question_id, parent_id ORDER BY rank) = 1),
    f2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS INTEGER) AS ord FROM f1 QUALIFY ord < 3),
    ctx AS (SELECT question_id, ord, parent_id, coalesce(source, CAST(parent_id AS VARCHAR)) AS section_title, left(coalesce(d.text, f2.text), 6000) AS full_text, f2.text AS child_matched, score FROM f2 LEFT JOIN documents d ON f2.parent_id = d.doc_id)"""
_sys = f"greatest(1, length({X.literal(R.SYSTEM)}) // 4)"
PROMPT = f"""{EXPAND}, nb AS (SELECT question_id, CAST(count(*) AS INTEGER) AS n FROM ctx GROUP BY 1),
    bu AS (SELECT item_id AS question_id, text AS question, coalesce(n, 0) AS n_parents, greatest(200, ((5500 - ({_sys} + greatest(1, length(text) // 4) + 60)) // greatest(coalesce(n, 0), 1)) * 4) AS chars FROM benchmark LEFT JOIN nb ON item_id = question_id),
    bl AS (SELECT c.question_id, string_agg('[Source: ' || section_title || ' | child_match: "' || left(child_matched, 80) || '..."]' || chr(10) || chr(10) || left(full_text, chars), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS block FROM ctx c JOIN bu ON c.question_id = bu.question_id GROUP BY 1),
    co AS (SELECT bu.question_id, n_parents, 'CONTEXT:' || chr(10) || coalesce(block, '') || chr(10) || chr(10) || 'QUESTION: ' || question AS u FROM bu LEFT JOIN bl ON bu.question_id = bl.question_id)
    SELECT question_id, n_parents, md5(u) AS content_md5, {_sys} + greatest(1, length(u) // 4) AS prompt_tokens, greatest(256, 7800 - ({_sys} + greatest(1, length(u) // 4))) AS allowance FROM co"""
DIVIDED = r"""dv AS (SELECT slug, string_split_regex(text, '<!--\s*.*?\s*-->') AS parts, regexp_extract_all(text, '<!--\s*(.*?)\s*-->', 1) AS tags FROM {views}),
    dx AS (SELECT slug, unnest(tags) AS raw, generate_subscripts(tags, 1) AS i, parts FROM dv),
    dt AS (SELECT slug, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN starts_with(raw, 'chunk_id=') THEN replace(raw, 'chunk_id=', '') ELSE raw END AS tag, parts[i + 1] AS text FROM dx),
    di AS (SELECT slug, ord, trim(split_part(tag, '|', 1)) AS parent_id, CASE WHEN contains(tag, '|') THEN trim(substr(tag, strpos(tag, '|') + 1)) END AS section_title, text FROM dt)"""
PARA = r"list_filter(list_transform(string_split_regex({x}, '\n{{2,}}'), lambda q: {clean}), lambda p: length(p) > 40)"
_para = PARA.format(x="text", clean=CLEAN.replace("(text,", "(q,"))
_cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

SQL = {
    "sentence_pack": f"WITH RECURSIVE {KIDS} SELECT parent_id, ord, md5(text) AS text_md5 FROM kids",
    "paragraph_split": f"SELECT slug, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS ord FROM (SELECT slug, {_para} AS p FROM {G.VIEWS.sql()})",
    "divider_split": f"WITH {DIVIDED.format(views=G.VIEWS.sql())} SELECT * FROM di",
    "hierarchy_fallback": f"""WITH RECURSIVE {DIVIDED.format(views=G.VIEWS.sql())}, ow AS (SELECT * FROM {G.PARENTS.sql()} WHERE chunk_id <> ''),
        pp AS (SELECT slug, parent_id, section_title, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT slug, parent_id, section_title, {_para} AS p FROM di)),
        md AS (SELECT pp.slug || '__' || parent_id || '__p' || ord AS child_id, pp.slug, parent_id, coalesce(pp.section_title, ow.section_title, '') AS section_title, text FROM pp LEFT JOIN ow ON pp.slug = ow.slug AND parent_id = chunk_id),
        re AS (SELECT slug, chunk_id, section_title, left(document_text, 8000) AS text FROM ow WHERE slug NOT IN (SELECT slug FROM md)), {packed('re', 'chunk_id')}
        SELECT * FROM md UNION ALL SELECT re.slug || '__' || re.chunk_id || '__c' || ord, re.slug, re.chunk_id, coalesce(section_title, ''), pk.text FROM pk JOIN re ON pk.chunk_id = re.chunk_id""",
    "bm25_stats": f"WITH RECURSIVE {KIDS}, {bm25_sql(15)} SELECT (SELECT n FROM av) AS n_children, (SELECT round(avgdl, 6) FROM av) AS avgdl, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM tf",
    "bm25_topk": f"WITH RECURSIVE {KIDS}, {bm25_sql(15)} SELECT question_id, rank, parent_id, ord, score FROM sp JOIN kids USING (child_id)",
    "bm25_prefilter": f"WITH RECURSIVE {KIDS}, {bm25_sql(2)} SELECT question_id, rank, parent_id, ord, score FROM sp JOIN kids USING (child_id)",
    "bm25_kept_index": f"WITH RECURSIVE {KIDS}, {bm25_sql(15)} SELECT term, count(*) AS df FROM tf GROUP BY 1 UNION ALL SELECT '', n FROM av",
    "bm25_kept_topk": f"WITH RECURSIVE {KIDS}, {bm25_sql(15)} SELECT question_id, rank, parent_id, ord, score FROM sp JOIN kids USING (child_id)",
    "postings": f"WITH RECURSIVE {KIDS}, {bm25_sql(15)} SELECT term, count(*) AS df, sum(tf) AS occurrences, CAST(max(tf) AS INTEGER) AS max_tf FROM tf GROUP BY 1",
    "cosine_topk": f"SELECT a.vec_id AS question_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos}, 9) DESC, b.vec_id) - 1 AS INTEGER) AS rank, b.vec_id AS child_id, round({_cos}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank < 12",
    "cosine_top1_label": f"WITH t AS (SELECT a.label AS asked, b.label AS found, a.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos}, 9) DESC, b.vec_id) = 1) SELECT asked, count(*) AS queries, count(*) FILTER (asked = found) AS same_label FROM t GROUP BY asked",
    "dense_topk": f"WITH RECURSIVE {KIDS}, {DENSE} SELECT question_id, rank, parent_id, ord, score FROM de JOIN kids USING (child_id)",
    "rrf_fuse": f"WITH RECURSIVE {LISTS} SELECT question_id, rank, parent_id, title, md5(key) AS key_md5, score FROM fu",
    "rrf_duplicate_keys": f"WITH {fuse(FUSE.sql())} SELECT question_id, rank, parent_id, title, length(text) AS n_chars, score FROM fu",
    "rrf_dedup": f"WITH {fuse(FUSE.sql(), True)} SELECT question_id, rank, parent_id, title, length(text) AS n_chars, score FROM fu",
    "expand_parents": f"WITH RECURSIVE {EXPAND} SELECT question_id, ord, parent_id, section_title, md5(full_text) AS text_md5, md5(child_matched) AS child_md5, score FROM ctx",
    "prompt_budget": f"WITH RECURSIVE {PROMPT}",
}
SQL["vector_store_topk"] = SQL["cosine_topk"]
SQL["stream_ingest"] = f"""WITH RECURSIVE {KIDS}, n AS (SELECT parent_id, count(*) AS n FROM kids GROUP BY 1)
    SELECT doc_id, md5(coalesce(text, '')) AS file_hash, doc_id % 2 <> 0 OR doc_id % 10 = 0 AS changed, coalesce(n, 0) AS n_children FROM documents LEFT JOIN n ON parent_id = doc_id"""
