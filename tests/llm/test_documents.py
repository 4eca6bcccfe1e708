"""Every document operator on awkward rows, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, lm_scoring, minmax_dedup, pii, quality_rules, resharding, sentencepieces
from quern.llm.common import Scratch
from quern.llm.line_dedup import line_dedup
from tests.llm import data as D


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(D.awkward(), D.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows():
    return [(r[0], r[1]) for r in D.awkward()]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, k):
    got = minmax_dedup.near_duplicates(docs, Scratch(spark), k=k).collect()
    assert len(got) == len(rows())
    sets = {i: D.shingle_set(t, k) for i, t in rows() if i is not None}
    want = D.components(sets)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minmax_dedup.near_duplicates(empty, Scratch(spark), k=k).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Copies with edits, of which many are linked to none: bucket pairs and blocks together find what brute force finds."""
    import random

    monkeypatch.setattr(minmax_dedup, "SMALL", 2)
    monkeypatch.setattr(minmax_dedup, "BLOCK", 8)
    r, base = random.Random(4), D.prose(11, 120).split()
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
        texts[i] = " ".join(w)
    want = D.components({i: D.shingle_set(t, 2) for i, t in texts.items()})
    got = minmax_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), Scratch(spark), k=2).collect()
    assert {x.doc_id: x.component_id for x in got} == want and len(set(want.values())) > 5


def linked_by_id(rows, k, percent=80):
    """Brute force where ids repeat: ids with the links of all their texts."""
    sets = {(i, n): D.shingle_set(t, k) for n, (i, t) in enumerate(rows)}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in sets.items():
        for y, b in sets.items():
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(x[0]), root(y[0])
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}


def test_near_duplicates_of_ids_with_several_texts(spark):
    import random

    a, b = D.prose(20, 100), D.prose(21, 100)
    cases = [[(2, a), (5, a), (5, b), (9, b + " more")]]
    for seed in range(2):
        r = random.Random(seed)
        made = []
        for _ in range(60):
            w = D.prose(30 + r.randrange(8), 60).split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            made.append((r.randrange(40), r.choice([" ", "  "]).join(w)))
        cases.append(made + made[:5])
    for rows_ in cases:
        got = minmax_dedup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), Scratch(spark), k=2).collect()
        assert len(got) == len(rows_) and {x.doc_id: x.component_id for x in got} == linked_by_id(rows_, 2)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "LEAST_HEAVY", 5)
    edges = spark.createDataFrame([(50, i) for i in range(100) if i != 50] + [(200, i) for i in range(201, 240)] + [(239, 300), (300, 301)], "a long, b long")
    got = {r.node: r.comp for r in minmax_dedup.components(edges, Scratch(spark)).distinct().collect()}
    assert got == {i: 0 for i in range(100)} | {i: 200 for i in [*range(200, 240), 300, 301]}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in minmax_dedup.components(edges, Scratch(spark)).distinct().collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates_take_few_jobs(spark):
    """Each shuffle is a job or more, whose tasks cost the same on small tables: they are what a table of many parts pays for."""
    import random

    r, base = random.Random(5), D.prose(12, 120).split()
    texts = [(i, " ".join(f"new{r.randrange(9999)}" if r.random() < 0.05 else w for w in base)) for i in range(60)] + [(60 + i, D.prose(40 + i % 3, 30)) for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spark.sparkContext.setJobGroup("near_duplicates_jobs", "")
    got = minmax_dedup.near_duplicates(docs, Scratch(spark), k=2).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {x.doc_id: x.component_id for x in got} == D.components({i: D.shingle_set(t, 2) for i, t in texts})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near_duplicates_jobs")) < 120


def test_minmax_signature_is_unbiased():
    a, b = minmax_dedup.permutations()
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 1500, dtype=np.uint64)
    one, two = np.unique(x[:1200]), np.unique(x[300:])
    (l1, h1), (l2, h2) = minmax_dedup.minmax(one, a, b), minmax_dedup.minmax(two, a, b)
    assert abs(np.mean(np.concatenate([l1 == l2, h1 == h2])) - 0.6) < 0.1
    assert all(np.array_equal(p, q) for p, q in zip(minmax_dedup.minmax(one, a, b, 7), (l1, h1), strict=True))


def test_line_dedup(spark, docs, empty):
    out = line_dedup(docs, Scratch(spark))
    assert out.columns == [*docs.columns, "ld_lines", "ld_dropped"]
    want = D.dedup_lines(rows())
    assert any(w[1] for w in want.values())
    got = Counter((r.doc_id, r.ld_lines, r.ld_dropped, r.text or "") for r in out.collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows())
    assert line_dedup(empty, Scratch(spark)).count() == 0


def test_contamination(spark, docs, empty):
    items = [(1, " ".join(D.prose(2, 80).split()[10:40])), (2, "two words"), (3, ""), (4, None), (None, "one"), (5, "日本語"), (1, " ".join(D.prose(2, 80).split()[10:40])), (6, D.prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, Scratch(spark)).collect()
    want = Counter()
    for i, t in rows():
        n, h, found = D.hits(t, items)
        want[i, n, h, tuple(found), h > 0 and 20 * h >= n] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    assert any(w[4] for w in want) and decontaminate.contamination(empty, bench, Scratch(spark)).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0), Scratch(spark)).collect())


def test_contamination_in_blocks(spark, docs, monkeypatch):
    items = [(i, " ".join(D.prose(s, 80).split()[a : a + 25])) for i, (s, a) in enumerate([(2, 5), (2, 20), (3, 0), (4, 30), (1, 100)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    judged = lambda: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench, Scratch(spark)).collect())
    whole = judged()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert judged() == whole


def test_segments_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 64)
    docs = spark.createDataFrame([(1, "zero alpha beta gamma delta"), (2, "alpha then beta gamma"), (3, "gamma beta"), (4, "beta gamma alpha beta gamma")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = lambda slop: {(r.doc_id, r.start) for r in decontaminate.proximity_matches(docs, bench, slop=slop).collect()}
    assert found(0) == {(1, 1), (4, 2)} and {d for d, _ in found(1)} == {1, 2, 4}


def test_quality(spark, docs, empty):
    out = quality_rules.quality_rules(docs)
    assert out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "qr_kept"]
    for r in out.collect():
        t = r.text or ""
        w = D.WORD.findall(t)
        lines = [x for x in t.split("\n") if D.WORD.search(x)]
        assert r.qr_n_words == len(w) and r.qr_word_chars == sum(map(len, w)) and r.qr_n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.qr_n_dup_lines == len(lines) - len(set(lines)) and r.qr_n_repeat_words == D.repeated(w)
        assert r.qr_base_failed == (len(w) < 50 or 100 * D.repeated(w) > 50 * len(w)) and not (r.qr_base_failed and r.qr_kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_spares_labelled_good_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    j = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id")
    assert j.filter("quality = 1 AND NOT qr_base_failed AND NOT qr_kept").count() == 0 and j.filter("quality = 0 AND qr_kept").count() == 0


def test_sharding(spark, docs, empty):
    out = resharding.reshard(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)), old_shards=3, shards=4).collect()
    assert len(out) == len(rows())
    for s in range(4):
        assert sorted(r.rs_slot for r in out if r.rs_shard == s) == list(range(sum(r.rs_shard == s for r in out)))
    assert all(r.rs_size == len((r.text or "").encode()) + 1 for r in out)
    assert resharding.reshard(empty, F.lit(0), old_shards=1, shards=4).count() == 0


def test_flow_is_cheapest():
    flow = resharding.min_cost_flow([10, 2, 7], [8, 8, 3], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert [sum(f) for f in flow] == [10, 2, 7] and flow[0][0] == 8 and flow[1][1] == 2 and flow[2][2] == 3
    assert resharding.min_cost_flow([1, 1], [1, 1], [[1, 5], [1, 9]]) == [[0, 1], [1, 0]]
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], [[0]])


def test_rewritten_files(spark, docs, tmp_path):
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    changed = resharding.rewrite_files(docs, old, str(tmp_path / "out"), old_shards=2, shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows()) and 2 in changed
    same = resharding.plan_moves([(0, 0, 5, 1), (1, 0, 5, 1)], [0, 1], [0, 1])
    assert all(m.old == m.shard for m in same)


def test_sentencepieces(spark, docs, empty):
    out = sentencepieces.encode_documents(docs)
    got = out.collect()
    assert len(got) == len(rows()) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    back = Counter((r.doc_id, r.text) for r in sentencepieces.decode_documents(out).collect())
    assert back == Counter((i, t or "") for i, t in rows())
    assert sentencepieces.encode_documents(empty).count() == 0


def test_viterbi_is_best():
    pieces = sentencepieces.load_pieces()
    codec = sentencepieces.Codec(pieces)
    score = {p: s for p, _, s in pieces["pieces"]}
    by_id = {i: s for _, i, s in pieces["pieces"]}
    for word in ["▁theation", "▁", "▁▁▁", "xéß", "▁日本", "hello", "\n", "▁international"]:
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max([best[a] + score[word[a:end]] for a in range(max(0, end - 16), end) if word[a:end] in score] + ([best[end - 1] + pieces["unknown"]] if word[end - 1] not in score else []))
        ids = codec.viterbi(word)
        unknown = sum(c not in score for c in word)
        assert sum(by_id.get(i, 0) for i in ids) + unknown * pieces["unknown"] == pytest.approx(best[-1])


def test_segmentations_score_no_less_than_the_library():
    """Against the library's own unigram search over the same pieces and scores."""
    sp = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2", exc_type=ImportError)
    m = proto.ModelProto()
    with open(sentencepieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    pieces = sentencepieces.load_pieces()
    lib, codec, score = sp.SentencePieceProcessor(model_proto=m.SerializeToString()), sentencepieces.Codec(pieces), {i: s for _, i, s in pieces["pieces"]}
    for t in ("hello world", "the international station", "eine kleine Nachtmusik"):
        ours, theirs = codec.encode(t).tolist(), lib.encode(t)
        assert lib.decode(ours) == lib.decode(theirs) == t and sum(map(score.get, ours)) >= sum(map(score.get, theirs))


def test_lm_counts_and_scores(spark, docs, empty):
    out = lm_scoring.lm_scores(docs, Scratch(spark), head=40, known=60).collect()
    tok = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]) for i, t in rows()]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, x in tok if not out_of(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out_of(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for i, x in tok)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in out)
    assert lm_scoring.lm_scores(empty, Scratch(spark)).count() == 0
    alone = lm_scoring.lm_scores(spark.createDataFrame([(4, "no one trains")], "doc_id long, text string"), Scratch(spark)).first()
    assert out_of(4) or alone.train_tokens == 4


def test_lm_probabilities_sum_to_one():
    m = lm_scoring.start([5, 3, 2], 7, 4)
    r = np.random.default_rng(1)
    m["Q"] = r.normal(0, 1, m["Q"].shape).astype(np.float32)
    a, b, z = lm_scoring.tables(m)
    p = np.exp(a[:, None, :] + b[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def plain_log_prob(m, a, b, w):
    """ln p(w | a, b) by the definition: the shares of a word's outputs among those that each is told from."""
    single, branch, leaves, first, parts = lm_scoring.tree(m)
    q = m["R"][a].astype(float) * m["u"] + m["R"][b].astype(float) * m["v"]
    z = m["Q"].astype(float) @ q + m["bias"]
    told = lambda c, low, high: z[c] - math.log(sum(math.exp(x) for x in z[low:high]))
    j = w - single
    if not 0 <= j < leaves:
        return told(w if j < 0 else first - 2 + j - leaves, 0, first)
    group, part = j // branch**2, j // branch
    up = told(single + group, 0, first) + told(first + part, first + group * branch, first + min(parts, (group + 1) * branch))
    return up + told(first + parts + j, first + parts + part * branch, first + parts + min(leaves, (part + 1) * branch))


def test_lm_score_is_the_sum_of_log_probabilities(spark):
    names, r = [f"w{i}".encode() for i in range(300)], np.random.default_rng(2)
    m = lm_scoring.start(list(range(900, 600, -1)), 50, 20)
    m["Q"] = r.normal(0, 1, m["Q"].shape).astype(np.float32)
    m["bias"] = m["bias"] + r.normal(0, 0.3, m["bias"].shape).astype(np.float32)
    m = lm_scoring.whole(lm_scoring.halved(m))
    where = {w: i for i, w in enumerate(names)} | {b"": 301, b"also": 302}
    words = spark.sparkContext.broadcast((where, [*range(900, 600, -1), 0, 20, 7]))
    tail = math.log10(50 + 0.5 * 9)
    texts = ["", "w0", "w5 w200 also w17 never w299 w130\nnever W1", " ".join(f"w{int(x)}" for x in r.integers(0, 300, 400))]
    got = {x.doc_id: x.score for x in lm_scoring.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m, words, tail).collect()}
    for i, t in enumerate(texts):
        ids = [where.get(w, 300) for w in lm_scoring.tokens(t.encode())]
        own = [min(x, 300) if x != 301 else 301 for x in ids]
        path, want = [301, 301, *own], 0.0
        for k, (x, w) in enumerate(zip(ids, own, strict=True)):
            want += plain_log_prob(m, path[k], path[k + 1], w) / math.log(10)
            want += math.log10(7.5) - tail if x == 302 else -tail if x == 300 else 0
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_lm_powers_are_taken_in_single_precision(monkeypatch):
    """At every level of the tree, and the sums of a level below the first in double precision, whatever stands beside a word."""
    kinds = []
    m = lm_scoring.start(list(range(900, 200, -1)), 50, 20)
    m["Q"] = np.random.default_rng(2).normal(0, 0.5, m["Q"].shape).astype(np.float32)
    r = np.random.default_rng(3)
    a, b, w = (r.integers(0, 702, 4000) for _ in range(3))
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, **k: kinds.append(x.dtype) or exp(x, **k))
    got = lm_scoring.log_probs(m, a, b, w)
    monkeypatch.undo()
    assert set(kinds) == {np.dtype(np.float32)}
    few = np.concatenate([lm_scoring.log_probs(m, a[k : k + 1024], b[k : k + 1024], w[k : k + 1024]) for k in range(0, 4000, 1024)])
    assert np.abs(got - few).max() < 1e-8


def test_lm_predicts_from_a_pair_of_words_once(monkeypatch):
    """4,000 words after 50 pairs, of 20 words: powers at the first level are as many as words (or pairs), not as the words scored,
    and a score stays what it is by the definition and beside any other."""
    made = []
    m = lm_scoring.start(list(range(900, 200, -1)), 50, 20)
    r = np.random.default_rng(4)
    m["Q"] = r.normal(0, 0.5, m["Q"].shape).astype(np.float32)
    first = lm_scoring.tree(m)[3]
    pairs, w = r.integers(0, 20, (50, 2)), r.integers(0, 702, 4000)
    a, b = pairs[r.integers(0, 50, 4000)].T
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, **k: made.append(x.shape) or exp(x, **k))
    got = lm_scoring.log_probs(m, a, b, w)
    monkeypatch.undo()
    assert 0 < sum(x[0] for x in made if x[-1] == first) <= 50
    assert np.allclose(got[:40], [plain_log_prob(m, *x) for x in zip(a[:40], b[:40], w[:40], strict=True)], atol=1e-5)
    mixed = r.permutation(4000)
    assert np.abs(lm_scoring.log_probs(m, a[mixed], b[mixed], w[mixed]) - got[mixed]).max() < 1e-8
    monkeypatch.setattr(lm_scoring, "POWERS", 8)
    assert np.abs(lm_scoring.log_probs(m, a, b, w) - got).max() < 1e-8


def test_lm_powers_too_large_for_single_precision():
    m = lm_scoring.start(list(range(900, 200, -1)), 50, 20)
    r = np.random.default_rng(5)
    m["Q"] = r.normal(0, 40, m["Q"].shape).astype(np.float32)
    a, b, w = r.integers(0, 20, 300), r.integers(0, 3, 300), r.integers(0, 702, 300)
    assert np.allclose(lm_scoring.log_probs(m, a, b, w), [plain_log_prob(m, *x) for x in zip(a, b, w, strict=True)], rtol=1e-4)


def test_lm_words_of_odd_texts():
    texts = [None, "", " ", "a", "\x0bA\x0c b\x1cc\x85\u00a0D\r\n", "\u00c4\u0130 \x00", "\t\tx  y ", "  "]
    words, lens = lm_scoring.words_of(pa.array(texts, pa.string()))
    want = [lm_scoring.tokens(None if t is None else t.encode())[:-1] for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and lens.tolist() == [len(x) for x in want]
    slices = [(at, len(x)) for at, x in lm_scoring.stretches(pa.array(["a" * 5_000_000] * 3 + ["b" * 9_000_000, None] + ["c"] * 5000))]
    assert slices == [(0, 1), (1, 1), (2, 1), (3, 1), *((4 + k, min(1024, 5001 - k)) for k in range(0, 5001, 1024))] and list(lm_scoring.stretches(pa.array([], pa.string()))) == []


def test_lm_sums_of_rows():
    r = np.random.default_rng(6)
    rows, values = (1.2 ** r.integers(0, 40, 3000)).astype(np.int32), r.normal(0, 1, (3000, 6)).astype(np.float32)
    at, sums = lm_scoring.by_row(rows, values)
    assert at.tolist() == sorted(set(rows.tolist())) and np.allclose(sums, [values[rows == k].sum(0) for k in at], atol=1e-4)
    at, sums = lm_scoring.by_row(np.array([7, 3, 7], np.int32), values[:3])
    assert at.tolist() == [3, 7] and np.allclose(sums, [values[1], values[0] + values[2]])


def test_lm_rounds_leave_no_shuffled_files(spark, monkeypatch):
    """What a round has shuffled is deleted when it ends; the session is as before."""
    seen, held = [], spark.conf.get(lm_scoring.CLEANUP)
    tracked = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    docs = spark.range(60).selectExpr("id doc_id", "concat('some words of text ', id % 7) text").repartition(4)
    round_of = lm_scoring.train_round

    def counted(*args):
        before = tracked.size()
        out = round_of(*args)
        seen.append((spark.conf.get(lm_scoring.CLEANUP), tracked.size() <= before))
        return out

    monkeypatch.setattr(lm_scoring, "train_round", counted)
    assert lm_scoring.lm_scores(docs, Scratch(spark)).count() == 60
    assert seen == [("true", True)] * len(lm_scoring.ROUNDS) and spark.conf.get(lm_scoring.CLEANUP) == held


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    score = lambda n: sorted((r.doc_id, r.score) for r in lm_scoring.lm_scores(docs.repartition(n), Scratch(spark), part_tokens=20_000).collect())
    one, eight = score(1), score(8)
    assert [i for i, _ in one] == [i for i, _ in eight] and np.allclose([x for _, x in one], [x for _, x in eight], rtol=1e-9)


def test_lm_vocabulary_when_all_counts_are_equal(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 3) for i in range(4000)], "word binary, n long")
    assert 400 < len(lm_scoring.frequent(counts, 500)) < 600 and len(lm_scoring.frequent(counts, 9000)) == 4000 and lm_scoring.frequent(counts.limit(0), 5) == []


def test_lm_beats_unigrams_on_held_out_texts(spark):
    r = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), Scratch(spark)).filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert r.score > r.base


def base_pii(t: str) -> list[tuple]:
    kinds = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", None), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))), (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15))
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok is None or ok(m.group()))


def test_pii(spark, docs, empty):
    model = pii.train(3000)
    got = pii.find_pii(docs, model).collect()
    assert len(got) == len(rows())
    texts = dict(rows())
    for r in got:
        if r.doc_id is not None:
            want = base_pii(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(pii.join_spans(want).encode()).hexdigest()
            assert set(filter(None, pii.join_spans(want).split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
    assert pii.find_pii(empty, model).count() == 0


@pytest.mark.parametrize("t", ["a@b.c@d.e", "@x.y", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.256", "+1 (2) 3-4.5 678901", "4111-1111-1111-1111 4111111111111111", "0000.1.1.1", "é1.2.3.4é a+b@c-d.e", "++49 1234567 8+"])
def test_pii_base_matches(t):
    assert pii.base_spans(t) == base_pii(t)


def test_pii_trees_on_held_out_spans():
    model = pii.train(6000)
    held = pii.made_up(3000, 1234)
    x = np.array([pii.features(t, a, k, b) for t, a, k, b, _ in held], float)
    y = np.array([q for *_, q in held])
    chosen = pii.boosting.predict(model, x) >= np.array(model["thresholds"])[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.8
    text = "please call: 030 1234 5678 or write to jo [at] site [dot] org"
    found = {(text[a:b], k) for a, k, b in pii.proposals(text)}
    assert ("jo [at] site [dot] org", 0) in found
