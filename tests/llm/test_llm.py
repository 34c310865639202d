"""The operators of the training-data pipeline against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from depotlens.llm import (backoff_lm, chat_format, common, components, host_rules, jaccard_join, knn_quality,
                           pattern_packing, pfair_mix, pivot_search, queries, rendezvous, secret_scan)
from depotlens.session import ARROW_BYTES, small_batches

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG_WORD = "ab" * 40_000


@pytest.fixture(scope="session")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


@pytest.fixture
def odd(spark):
    """NULLs, empty and very long texts, repeated rows, and columns that clash with names in use."""
    rows = [(1, None, None, "x"), (2, "", "a", None), (3, "   \n\t ", "a", "y"), (4, "one two", "a", "y"),
            (4, "one two", "a", "y"), (5, "é—\U0001f600 " * 30_000, None, "z"), (6, LONG_WORD, "b", "z"),
            (None, "no key here", "b", None), (7, "tie", "b", "t"), (8, "tie", "b", "t")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row string").withColumns(
        {c: F.lit("own") for c in ("_base", "_source", "_bucket", "position", "label", "tokens", "score", "_host", "lang")}
    ).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture
def nothing(odd):
    return odd.limit(0)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def by_id(df):
    return {r[0]: r for r in df.collect()}


# op1 ------------------------------------------------------------------------------------------------

BASE = [("assign", re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def brute_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rule, group, least) in enumerate(BASE)
             for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def test_secret_scan_keeps_the_base_spans(spark, small, docs):
    got = by_id(queries.op1_secret_scan(spark, small))
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text):
        base = brute_base(text)
        row = got[doc]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(b.startswith(k) for b in base) for k, *_ in BASE]
        assert [s for s in row.spans.split(",") if s and not s.startswith("markov")] == base
        assert row.spans.split(",") == sorted(row.spans.split(","), key=lambda s: int((s.split(":") + ["0"])[1]))


def test_secret_scan_cases(spark):
    texts = ["password: token: abcdefghijklmnop", "TOKEN = 'abc-def_ghi.12' x", "AKIA" + "A" * 13, "é\U0001f600 AKIA" + "B" * 14,
             "deadbeefdeadbeef!", "0123456789abcdeF", "secret=" + "a=" * 30, "api_key:apikey=passwd", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    spans = by_id(df.select("doc_id", secret_scan.base_spans(F.coalesce("text", F.lit(""))).alias("s")))
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans[i].s] == brute_base(t)


def test_markov_model_tells_random_strings_from_identifiers(spark):
    rng = np.random.default_rng(1)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    random = ["".join(rng.choice(alphabet, 32)) for _ in range(300)]
    parts = ["get", "user", "name", "count", "total", "index", "value", "list", "item", "order", "_", "-"]
    plain = ["".join(rng.choice(parts, 7)) for _ in range(300)]
    samples = spark.createDataFrame([(s, 1) for s in random[:200]] + [(s, 0) for s in plain[:200]] + [(None, 0), ("", 1)],
                                    "sample string, label int")
    model = secret_scan.train(samples)
    assert model.count() == 128 * 128
    texts = [f"see {s} here" for s in random[200:] + plain[200:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = [r.secret_spans for r in secret_scan.scan(df, model).orderBy("doc_id").collect()]
    assert sum(any(s.kind == "markov" and (s.start, s.end) == (4, 36) for s in f) or any(s.kind != "markov" for s in f)
               for f in found[:100]) >= 97
    assert sum(bool(f) for f in found[100:]) <= 2


def test_secret_scan_odd_rows(odd, nothing):
    model = secret_scan.train(secret_scan.labelled_samples(odd))
    scanned = secret_scan.scan(odd, model)
    assert set(odd.columns) | {"secret_spans"} == set(scanned.columns)
    assert scanned.where("_base = 'own'").count() == 10
    assert secret_scan.digest(scanned).count() == 10
    empty = secret_scan.train(secret_scan.labelled_samples(nothing))
    assert {r.llr for r in empty.collect()} == {0.0}
    assert secret_scan.scan(nothing, empty).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token = 'abcdefghijklm' z é AKIA" + "C" * 16 + "."), (2, None), (3, "plain")],
                               "doc_id bigint, text string")
    df = df.withColumn("secret_spans", secret_scan.base_spans(F.coalesce("text", F.lit(""))))
    assert {r.doc_id: r.text for r in secret_scan.redact(df).collect()} == {
        1: "a <secret>' z é <secret>.", 2: None, 3: "plain"}


# op2 ------------------------------------------------------------------------------------------------

def brute_figures(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = {k for k, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_host_rules_match_brute_force(spark, small, docs):
    got = by_id(queries.op2_host_rules(spark, small))
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text):
        n, *_, repeat = figures = brute_figures(text)
        row = got[doc]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == figures
        assert row.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (row.base_failed and row.kept)


def test_host_rules_keep_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").merge(queries.op2_host_rules(spark, sf).toPandas(), on="doc_id")
    long = labels[labels.n_words >= 50]
    assert long[long.quality == 1].kept.mean() >= 0.99
    assert long[long.quality == 0].kept.mean() <= 0.15


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "x y", "a b c d a b c", "q " * 3000, None, "1 2 3 4 2 3 4 1 2 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = by_id(host_rules.word_figures(df))
    assert [got[i].n_repeat_words for i in range(len(texts))] == [brute_figures(t)[-1] for t in texts]


def test_host_rates_are_shrunk(spark):
    rows = [("good", i < 5) for i in range(100)] + [("bad", i < 95) for i in range(100)] + [("tiny", True)] + [(None, False)]
    failed = spark.createDataFrame(rows, "source string, failed boolean")
    verdicts = {r.source: r for r in host_rules.host_verdicts(failed, "source").collect()}
    assert verdicts["good"].host_ok and not verdicts["bad"].host_ok
    assert 0.5 < verdicts["tiny"].host_rate < 1 and 0 < verdicts[None].host_rate < 0.5
    judged = host_rules.judged(failed, host_rules.host_verdicts(failed, "source"), "source")
    assert judged.count() == len(rows) and judged.where("source is null and kept").count() == 1
    assert judged.where("source = 'bad' and kept").count() == 0


def test_host_rules_odd_rows(odd, nothing):
    for df, n in ((odd, 10), (nothing, 0)):
        failed = host_rules.failures(host_rules.word_figures(df))
        judged = host_rules.judged(failed, host_rules.host_verdicts(failed, "source"), "source")
        assert judged.count() == n and "_host" in judged.columns


# op3 ------------------------------------------------------------------------------------------------

def brute_components(texts, size=4, percent=85):
    sets = {}
    for doc, text in texts.items():
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        w = words(w)
        sets[doc] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    holders = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    common = collections.Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in texts}


def components_of(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(df, **options).collect()}


def test_jaccard_join_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    frame = pd.read_parquet(f"{sf}/documents.parquet")
    got = components_of(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got == brute_components(dict(zip(frame.doc_id, frame.text)))


@pytest.mark.parametrize("hot", [1, 3, 24])
def test_jaccard_join_of_crowded_near_copies(spark, hot):
    """Near copies around and across the threshold, common passages, short texts; with every kind of hot token."""
    rng = np.random.default_rng(hot)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(vocabulary, 60))
    texts = {}
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 220))))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.1:
                copy = copy + copy[:len(copy) // 8]
            texts[len(texts)] = " ".join(copy)
    for _ in range(20):
        texts[len(texts)] = " ".join(passage + list(rng.choice(vocabulary, int(rng.integers(0, 40)))))
    for t in ("", None, "One", "one", "one two", "One  two", "one two three four", "one two three four five"):
        texts[len(texts)] = t
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id bigint, text string")
    assert components_of(df, hot=hot) == brute_components(texts)


def test_jaccard_join_of_two_large_groups_just_apart(spark, monkeypatch):
    """Near copies of a text and of its variant share most tokens, all of them frequent; a text between may link them."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = {}
    for bridged in (False, True):
        base = list(rng.choice(vocabulary, 150))
        other = list(rng.choice(vocabulary, 16))
        variant = base[:60] + other + base[76:]
        for original, copies in ((base, 100), (variant, 50)):
            for _ in range(copies):
                copy = list(original)
                copy[int(rng.integers(150))] = str(rng.choice(vocabulary))
                texts[len(texts)] = " ".join(copy)
        if bridged:
            for text in (base, variant, base[:60] + other[:8] + base[68:]):
                texts[len(texts)] = " ".join(text)
    pairs, rest = [], jaccard_join._rest_pairs

    def counted(*args):
        found = jaccard_join.checkpointed(rest(*args))
        pairs.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "_rest_pairs", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    expected = brute_components(texts)
    assert components_of(df) == expected
    assert len({c for _, c in expected.values()}) == 3
    assert pairs[0] < 2 * len(texts)


def test_jaccard_join_odd_rows(odd, nothing):
    got = jaccard_join.linked(odd).collect()
    assert len(got) == 10
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (4, 7, 8)} == {(4, 4), (7, 7), (8, 7)}
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard_join.linked(nothing).count() == 0


def test_jaccard_join_of_several_texts_under_one_id(spark):
    """Every text of an id has its own links, and one row of each component is kept."""
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(rng.choice([f"v{i}" for i in range(900)], 120)) for _ in range(4))
    rows = [(1, a), (1, b), (4, b + " "), (5, a + " one"), (6, c), (6, b + " two"), (2, d), (2, d), (2, ""), (2, None),
            (8, d + " three"), (9, "alone in the world today"), (7, c + " four"), (3, c + " five")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    brute = brute_components(dict(enumerate(t for _, t in rows)))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[brute[i][1]] = min(doc, least.get(brute[i][1], doc))
    expected = sorted((doc, brute[i][0], least[brute[i][1]]) for i, (doc, _) in enumerate(rows))
    got = jaccard_join.linked(df)
    assert sorted(map(tuple, got.collect())) == expected and (5, 118, 1) in expected
    kept = [tuple(r) for r in jaccard_join.one_of_each(df).collect()]
    # a and its near copy, b and both of its copies, c and its copies, d and its copy, one text without words, one alone
    assert len(kept) == 6 and sum(1 for _, t in kept if not t) == 1
    assert {t[:20] for _, t in kept if t} == {t[:20] for t in (a, b, c, d, "alone in the world today")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (5, 5)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100, **{1000 + i: 1000 for i in range(1, 200)}}


# op4 ------------------------------------------------------------------------------------------------

def brute_nearest(rows, asked, top=10):
    usable = [(k, [math.floor(1024 * float(x)) for x in v]) for k, v in rows
              if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, q in usable:
        if asked(k):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != k and len(v) == len(q))
            out += [(k, n, i, -s) for n, (s, i) in enumerate(scores[:top], 1)]
    return sorted(out)


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    v = [(centres[i % 5] + rng.normal(size=16) * 0.1).astype(np.float32).tolist() for i in range(900)]
    rows = list(enumerate(v)) + [(900 + i, v[0]) for i in range(300)]
    rows += [(2000, None), (2100, []), (2200, [1.0, None] * 8), (2300, [float("nan")] * 16), (2400, [float("inf")] * 16),
             (2500, [1.0] * 3), (2600, [0.5] * 3), (None, v[1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1))
    got = pivot_search.nearest(df, is_query=F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows, lambda k: k % 100 == 0)
    assert pivot_search.nearest(df.limit(0), is_query=F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 2])
def test_nearest_with_negative_scores_and_exact_ties(spark, dim):
    """Bounds that equal the score, below zero: a tie to a smaller id in a ring of its own must be visited."""
    rng = np.random.default_rng(dim)
    v = [[5.0] * dim, [3.0] * dim] + rng.integers(-30, 0, (200, dim)).astype(float).tolist()
    rows = [(int(k), x) for k, x in zip(rng.permutation(400), v)]
    asked = {k for k, _ in rows[:2]} | {k for k, _ in rows[::20]}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for top in (1, 3):
        got = pivot_search.nearest(df, is_query=F.col("vec_id").isin(asked), top=top, pivots=8, rings=12)
        assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows, asked.__contains__, top)


def test_large_components_keep_exact_scores(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-10**6, 10**6, 4)]) for i in range(40)]
    got = pivot_search.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"),
                               is_query=F.col("vec_id") < 5, top=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows, lambda k: k < 5, 3)


# op5 ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("broadcast_words", [None, 0])
def test_backoff_scores_with_a_cut_match_brute_force(spark, docs, broadcast_words):
    texts = [re.sub("[A-Z]+", lambda m: m[0].lower(), t or "") for t in docs.text]
    w = [words(t) for t in texts]
    one = collections.Counter(itertools.chain.from_iterable(w))
    two = collections.Counter(p for x in w for p in zip(x, x[1:]))
    total = sum(one.values())
    unknown = math.log(sum(n for n in one.values() if n < 2) / total)

    def word(x):
        return math.log(one[x] / total) if one[x] >= 2 else unknown

    got = by_id(backoff_lm.scores(spark.createDataFrame(docs[["doc_id", "text"]]), min_count=2,
                                  broadcast_words=broadcast_words))
    assert len(got) == len(docs)
    for doc, x in zip(docs.doc_id, w):
        expected = sum(math.log(two[p] / one[p[0]]) if two[p] >= 2 else math.log(0.4) + word(p[1]) for p in zip(x, x[1:]))
        expected += word(x[0]) if x else 0
        assert got[doc].n_words == len(x)
        assert got[doc].log_score == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("broadcast_words", [None, 0])
def test_whole_backoff_counts_every_ngram(spark, docs, broadcast_words):
    """Every n-gram by its own count, with known words looked up by broadcast and by shuffle."""
    texts = {d: words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for d, t in zip(docs.doc_id, docs.text)}
    tiny = {0: ["new", "words", "only"], 1: ["a", "b", "a", "b", "a", "c"], 2: ["once"], 3: []}
    hot = {i: ["the", "of", f"x{i}"] + ["the"] * (i % 3) for i in range(3000)} | {3000: ["of", "the", "of"]}
    frame = lambda t: spark.createDataFrame([(k, " ".join(x)) for k, x in t.items()], "doc_id bigint, text string")
    for w in (texts, tiny, hot):
        got = backoff_lm.scores(frame(w), broadcast_words=broadcast_words)
        one = collections.Counter(itertools.chain.from_iterable(w.values()))
        two = collections.Counter(p for x in w.values() for p in zip(x, x[1:]))
        total, got = sum(one.values()), by_id(got)
        assert len(got) == len(w)
        for doc, x in w.items():
            expected = sum(math.log(two[p] / one[p[0]]) for p in zip(x, x[1:])) + (math.log(one[x[0]] / total) if x else 0)
            assert got[doc].n_words == len(x)
            assert got[doc].log_score == pytest.approx(expected, abs=1e-4)


def test_whole_backoff_asks_for_counts_it_does_not_know(spark, docs, monkeypatch, request):
    """With few words and pairs known beforehand and small packets, texts of one word, repeated ids and empty texts."""
    for name, value in (("TOP_WORDS", 20), ("HOT_SHARE", 30), ("HOT_PAIRS", 200), ("ASKED_WORDS", 3000), ("WORDS_PER_PART", 2000)):
        monkeypatch.setattr(backoff_lm, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    rows = [(int(d), t) for d, t in zip(docs.doc_id, docs.text)]
    rows += [(None, "alone"), (None, "alone"), (-1, "once"), (-2, ""), (-3, None), (-4, "the same"), (-4, "the same again")] + [
        (1000 + i, f"of w{i % 7}") for i in range(500)]
    w = [(d, words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for d, t in rows]
    one = collections.Counter(itertools.chain.from_iterable(x for _, x in w))
    two = collections.Counter(p for _, x in w for p in zip(x, x[1:]))
    expected, n = collections.Counter(), collections.Counter()
    for d, x in w:
        n[d] += len(x)
        expected[d] += sum(math.log(two[p] / one[p[0]]) for p in zip(x, x[1:])) + (math.log(one[x[0]] / sum(one.values())) if x else 0)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = backoff_lm._known(frame)
    asked = backoff_lm.questions(frame, known, 5)
    assert len(known.words) <= 20 + 30 and known.total == sum(one.values())
    assert asked.select("packet").distinct().count() > spark.sparkContext.defaultParallelism
    assert asked.where("grams is not null").count() > 20
    got = by_id(backoff_lm.scores(frame))
    assert set(got) == set(n)
    for d, row in got.items():
        assert row.n_words == n[d] and row.log_score == pytest.approx(expected[d], abs=1e-4)
    with pytest.raises(Exception, match="lists of a packet are missing"):
        backoff_lm.summed(backoff_lm.answered(asked.where("part > 0 or lists is not null"), 5)).collect()


def test_whole_backoff_sends_few_bytes_per_word(spark, docs, request):
    """No row per occurrence is shuffled and nothing joined, with no table small enough to broadcast, as in a large corpus."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows = [(int(d) + 1000 * i, " ".join(f"{w}{i % 3}" if len(w) > 5 else w for w in words(t)))
            for i in range(5) for d, t in zip(docs.doc_id, docs.text)]
    scored = backoff_lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), broadcast_words=0)
    total = sum(r.n_words for r in scored.collect())

    def shuffled(node):
        inner = "plan" if node.nodeName().endswith("QueryStage") else "executedPlan" if node.nodeName() == "AdaptiveSparkPlan" else None
        children = node.children()
        below = [getattr(node, inner)()] if inner else [children.apply(i) for i in range(children.size())]
        own = node.metrics().get("shuffleBytesWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(map(shuffled, below))

    plan = scored._jdf.queryExecution().executedPlan()
    assert 0 < shuffled(plan) < 16 * total
    assert "Join" not in plan.toString()


def test_lookup_by_shuffle_spreads_frequent_and_missing_keys(spark):
    facts = spark.range(1, 50).selectExpr("id as w", "100 - id as c", "id * 2 as twice")
    rows = spark.range(400).selectExpr("id", "case when id % 4 = 0 then 1 when id % 4 = 1 then 0 when id % 4 = 2 then null "
                                       "else id % 60 end as w")
    got, expected = (sorted(map(tuple, backoff_lm._looked_up(rows, "w", facts, "c", b, 90, nothing=0).select(
        "id", F.coalesce("w", F.lit(-1)), F.coalesce("c", F.lit(-1)), F.coalesce("twice", F.lit(-1))).collect()))
        for b in (False, True))
    assert got == expected and len(got) == 400


def test_backoff_odd_rows(odd, nothing):
    got = {r.doc_id: r for r in backoff_lm.scores(odd).collect()}
    assert len(got) == 9 and got[1].n_words == 0 and got[2].mean_log_score is None and got[4].n_words == 4
    assert backoff_lm.scores(nothing).count() == 0


# op6 ------------------------------------------------------------------------------------------------

def test_rendezvous(spark, small, docs):
    got = queries.op6_rendezvous(spark, small).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got["size"] == [len(t.encode()) + 16 for t in got.text]).all()
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all()
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 40)).all()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert set(got.law) == {"key"}


def test_weighted_shards_share_and_stay(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    got = rendezvous.assigned(keys, "doc_id", [1.0, 2.0, 5.0], new_weight=2.0).toPandas()
    assert np.allclose(got.shard.value_counts(normalize=True).sort_index(), [1 / 8, 2 / 8, 5 / 8], atol=0.01)
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 3).all() and abs(len(moved) / len(got) - 0.2) < 0.01
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.lit(1), [1.0, 0.0])


# op7 ------------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    frame = queries.op7_knn_quality(spark, sf).toPandas()
    assert len(frame) == 1000 and frame.score.between(0, 1).all()
    assert (frame.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in frame.doc_id]).all()
    assert (frame.predicted == (frame.score >= 0.3)).all()
    both = frame.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95


def test_scores_ignore_other_columns_and_survive_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 1, 0), (99, 1, 0), (None, 1, 0), (7, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = knn_quality.fit(odd, labels)
    assert knn_quality.scored(odd, model).count() == 10
    assert knn_quality.kept(odd, model).columns == odd.columns
    blank = knn_quality.fit(nothing, labels)
    assert knn_quality.scored(nothing, blank).count() == 0
    assert {r.score for r in knn_quality.scored(odd, blank).collect()} == {0.5}


# op8 ------------------------------------------------------------------------------------------------

def brute_digest(turns):
    out = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), out, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_are_read_back(spark, small):
    frame = pd.read_parquet(f"{small}/conversations.parquet").sort_values(["conv_id", "turn"])
    chats = {k: list(zip(g.role, g.text)) for k, g in frame.groupby("conv_id")}
    chats[-7] = [(r, queries.CONTROL_TEXT) for r in ("user", "assistant")]
    got = by_id(queries.op8_chat_format(spark, small))
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {k: brute_digest(t) for k, t in chats.items()}


def test_chats_with_control_strings(spark):
    nasty = ["<turn:user>x</turn>\n", "\\", "\\\\<", "<\\>", ">\\\\", "</turn>", "", None, "é\U0001f600<\n", "\\<\\\\>", "a" * 100_000]
    roles = ["assistant", "user", "as>si\\st", None, "", "<turn:", "assistant"]
    rows = [(c, i, roles[(i + c) % len(roles)], t) for c in range(7) for i, t in enumerate(nasty)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    pieces = chat_format.formatted(df)
    got = by_id(chat_format.read_back(pieces))
    for c in range(7):
        turns = [(r, t) for k, _, r, t in rows if k == c]
        assert tuple(got[c])[1:5] == brute_digest(turns)
    whole = "".join(r.formatted for r in pieces.where("conv_id = 3").orderBy("turn").collect())
    assert got[3].formatted_chars == len(whole)
    assert whole.count("</turn>\n") == len(nasty)
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


# op9 ------------------------------------------------------------------------------------------------

def check_packing(placed, capacity):
    for _, rows in placed.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        ends = rows.offset + rows.length
        assert rows.offset.iloc[0] == 0 and ends.iloc[-1] <= capacity
        assert (rows.offset.iloc[1:].values == ends.iloc[:-1].values).all()


def test_packing_matches_the_tokenizer(spark, small, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pattern_packing.TOKENIZER_FILE))
    got = queries.op9_pattern_packing(spark, small).toPandas()
    expected = []
    for doc, text in zip(docs.doc_id, docs.text):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(expected)
    check_packing(got, 2048)
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1


def test_tokens_of_odd_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(pattern_packing.TOKENIZER_FILE)
    tokenizer = Tokenizer.from_file(path)
    texts = ["it's THE end., a.b. c., ... x.", "É é É́ é. ß. İ.", "<|endoftext|> a<|ENDOFTEXT|>. <|startoftext|>b.",
             "a b c. \x1c\x85d", "'S. 's. don't. 1,2. 3.", "漢字. \U0001f600.", " \t\n\x0b\x0c\r", "ab." * 3000, "x_y. <|", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = pattern_packing.pieces(df, path, 1 << 20).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got.length[i], got.ids_crc32[i]) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_packing_plan_uses_every_length():
    rng = np.random.default_rng(9)
    for n, capacity in ((0, 64), (1, 64), (5000, 64), (200_000, 2048)):
        lengths = np.clip(rng.lognormal(math.log(capacity / 4), 0.8, n), 1, capacity).astype(int)
        histogram = np.bincount(lengths, minlength=capacity + 1)
        plan = pattern_packing.packing_plan(histogram, capacity)
        used = np.zeros(capacity + 1, int)
        for content, k in plan:
            assert sum(content) <= capacity and k > 0
            for x in content:
                used[x] += k
        assert (used == histogram).all()
        bins = sum(k for _, k in plan)
        plain = sum(k for _, k in pattern_packing.best_fit(histogram, capacity))
        assert bins <= 1.01 * max(plain, lengths.sum() / capacity) + 2


def test_packing_odd_rows(odd, nothing):
    path = public_tokenizers.path(pattern_packing.TOKENIZER_FILE)
    placed = pattern_packing.packed(pattern_packing.pieces(odd, path)).toPandas()
    check_packing(placed, 2048)
    assert (placed.piece == 0).sum() == 10
    assert pattern_packing.packed(pattern_packing.pieces(nothing, path)).count() == 0


# op10 -----------------------------------------------------------------------------------------------

def test_period_keeps_to_the_windows():
    for weights in ({"a": 1}, {"a": 3, "b": 3, "c": 4}, {"a": 1, "b": 1, "c": 97, "d": 1}, {str(i): 1 for i in range(40)},
                    {"x": 337, "y": 333, "z": 330}):
        length, placed = sum(weights.values()), pfair_mix.period(weights)
        assert [slot for *_, slot in placed] == list(range(length))
        for s, j, slot in placed:
            assert j * length // weights[s] <= slot < -(-(j + 1) * length // weights[s])


def test_mix_keeps_the_weights_and_all_rows(spark):
    sizes = {"a": 900, "b": 300, "c": 150, None: 40}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("_row", F.lit(1))
    weights = {"a": 5.0, "b": 3.0, "c": 1.5, "": 0.5}
    got = pfair_mix.mixed(df, weights, block_rows=4, resolution=100).toPandas()
    assert sorted(got.doc_id) == list(range(len(rows))) and "_row" in got.columns
    blocks = got.fillna({"source": ""}).groupby("position").agg(source=("source", "first"), n=("source", "nunique"), rows=("doc_id", "count"),
                                        block=("block", "first"), release=("release", "first"), deadline=("deadline", "first"))
    assert (blocks.n == 1).all() and blocks.rows.max() == 4
    assert list(blocks.index) == list(range(len(blocks)))
    lasting = min(blocks.reset_index().groupby("source").position.max())
    for s, w in weights.items():
        had = (blocks.source == s).cumsum().to_numpy()[:lasting + 1]
        assert (abs(had - (np.arange(lasting + 1) + 1) * w / 10) < 1).all()
    early = blocks.loc[:lasting]
    assert ((early.release <= early.index) & (early.index < early.deadline)).all()
    for _, g in blocks.groupby("source"):
        assert list(g.block) == list(range(len(g)))


def test_whole_weights():
    assert pfair_mix.whole_weights({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert pfair_mix.whole_weights({"a": 1e-9, "b": 1}, 10) == {"a": 1, "b": 9}
    assert sum(pfair_mix.whole_weights({str(i): 1 + i for i in range(30)}, 10).values()) == 30
    with pytest.raises(ValueError):
        pfair_mix.whole_weights({"a": 0})


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.0004, "b": 0.9, "c": 0.0996},
                                     {"a": 1 / 3, "b": 0.1234567, "c": 1e-9}, {"a": 0.3, "b": 3.3, "c": 1.7}])
def test_mix_keeps_to_the_given_weights_over_many_periods(spark, weights):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (
        F.col("id") % 3 + 1).cast("int")).alias("source"))
    got = pfair_mix.mixed(df, weights, block_rows=1).toPandas().sort_values("position")
    assert sorted(got.doc_id) == list(range(9000)) and list(got.position) == list(range(9000))
    lasting = got.groupby("source").position.max().min() + 1
    assert lasting > 3000
    total = sum(weights.values())
    for s, w in weights.items():
        had = (got.source == s).cumsum().to_numpy()[:lasting]
        assert (abs(had - (np.arange(lasting) + 1) * w / total) < 1).all()


def test_many_sources_keep_their_weights():
    weights = pfair_mix.exact_weights({str(i): 1 + i % 7 for i in range(1500)})
    assert weights == {str(i): 1 + i % 7 for i in range(1500)}
    blocks = {s: 2 * w for s, w in weights.items()}
    placed = pfair_mix.period(weights)
    assert [x[:2] for x in itertools.islice(pfair_mix.schedule(weights, blocks), len(placed))] == [x[:2] for x in placed]


def brute_positions(weights, blocks):
    """Earliest deadline first, slot after slot of one period; periods follow each other, blocks that are missing leave
    no gap."""
    total, slots, done = sum(weights.values()), [], dict.fromkeys(weights, 0)
    for slot in range(total):
        released = [(-(-(j + 1) * total // weights[s]), s) for s, j in done.items()
                    if j < weights[s] and j * total // weights[s] <= slot]
        s = min(released)[1]
        slots.append((s, done[s]))
        done[s] += 1
    position = {}
    for period in range(max(-(-n // weights[s]) for s, n in blocks.items())):
        for s, j in slots:
            if period * weights[s] + j < blocks[s]:
                position[s, period * weights[s] + j] = len(position)
    return position


def test_op10_mixes_to_unequal_weights(spark, small, docs):
    got = queries.op10_pfair_mix(spark, small).toPandas().fillna({"source": ""})
    sizes = docs.text.fillna("").str.encode("utf-8").str.len().groupby(docs.source.fillna("")).sum()
    weights = pfair_mix.whole_weights({s: math.sqrt(max(n, 1)) for s, n in sizes.items()}, 10_000)
    assert sum(weights.values()) == 10_000 and len(set(weights.values())) > len(weights) / 2
    for s, block, release, deadline in got[["source", "block", "release", "deadline"]].values:
        assert (release, deadline) == (block * 10_000 // weights[s], -(-(block + 1) * 10_000 // weights[s]))
    blocks = {s: -(-n // pfair_mix.BLOCK_ROWS) for s, n in got.source.value_counts().items()}
    position = brute_positions(weights, blocks)
    assert all(position[s, b] == p for s, b, p in got[["source", "block", "position"]].values)
    assert got.groupby(["source", "block"]).size().max() <= pfair_mix.BLOCK_ROWS


def test_positions_equal_brute_force_when_sources_run_out(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(
        F.col("id") % 50 == 1, "b").otherwise("c").alias("source"))
    weights = {"a": 5, "b": 7, "c": 2}
    got = pfair_mix.mixed(df, weights, block_rows=4).toPandas()
    position = brute_positions(weights, {s: -(-n // 4) for s, n in got.source.value_counts().items()})
    assert all(position[s, b] == p for s, b, p in got[["source", "block", "position"]].values)


def test_mix_odd_rows(odd, nothing):
    assert pfair_mix.mixed(odd).count() == 10
    assert pfair_mix.mixed(nothing).count() == 0


# SQL ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = connection.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(expected.columns) and len(got) == len(expected)
    by = sorted(c for c in got.columns if c != "score")
    a, b = (x[sorted(got.columns)].sort_values(by).reset_index(drop=True) for x in (got, expected))
    pd.testing.assert_frame_equal(a, b, check_dtype=True, rtol=1e-12, atol=2e-6)


# pipeline -------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, small, docs):
    kept = {}
    now = spark.read.parquet(f"{small}/documents.parquet")
    before = now
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, small)
        if name != "packing":
            assert out.columns == before.columns
            kept[name] = now = spark.createDataFrame(out.toPandas(), before.schema)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert ids["near_copies"] < ids["quality"] < set(docs.doc_id)
    assert ids["mixing"] == ids["secrets"] == ids["near_copies"]
    frame = kept["near_copies"].toPandas()
    alone = brute_components(dict(zip(frame.doc_id, frame.text)))
    assert all(d == c for d, (_, c) in alone.items())
    assert not any(brute_base(t) for t in kept["secrets"].toPandas().text)
    labels = pd.read_parquet(f"{small}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & ids["quality"]) >= 0.97 * len(good)


def test_near_copies_at_five_words_and_80_percent(spark):
    rng = np.random.default_rng(3)
    listed = []
    for n in (60, 93, 94, 98, 101, 102, 150):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        copy = list(base)
        copy[n // 3], copy[2 * n // 3] = "other", "words"
        listed += [" ".join(base), " ".join(copy)]
    texts = dict(enumerate(listed))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, None).collect()}
    assert got == {c for _, c in brute_components(texts, 5, 80).values()} == {0, 1, 2, 3, 4, 6, 8, 10, 12}


def test_sequences_follow_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = pfair_mix.in_mix(docs).toPandas().set_index("_id")._position
    shuffled = corpus_pipeline.mixing(spark, docs, small).orderBy(F.xxhash64("text"))
    got = corpus_pipeline.packing(spark, shuffled, small).toPandas()
    check_packing(got, 2048)
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    got["position"] = got.doc_id.map(mixed)
    first = got[got.offset == 0].sort_values("sequence_id")
    assert first.position.is_monotonic_increasing and mixed.max() > 3
    for _, g in got.groupby("sequence_id"):
        assert g.sort_values("offset").position.is_monotonic_increasing
    plain = pattern_packing.packed(pattern_packing.pieces(docs, public_tokenizers.path(pattern_packing.TOKENIZER_FILE)))
    plain = plain.toPandas()
    assert sorted(zip(got.doc_id, got.piece, got.ids_crc32)) == sorted(zip(plain.doc_id, plain.piece, plain.ids_crc32))
    assert got.sequence_id.nunique() == plain.sequence_id.nunique()


def test_sequences_of_few_lengths_keep_close_to_the_order(spark):
    lengths = np.random.default_rng(2).choice([300, 500, 700, 900, 1200, 2048], 6000)
    rows = [(i, 0, 0, int(n), i, i // 16) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, pattern_packing.PIECES + ", position bigint")
    got = pattern_packing.packed(cut, position="position").toPandas()
    check_packing(got, 2048)
    assert sorted(got.doc_id) == list(range(len(rows)))
    assert np.corrcoef(got.sequence_id, got.position)[0, 1] > 0.95


def test_pipeline_is_its_stages(spark, small):
    got = corpus_pipeline.run(spark, small).toPandas()
    check_packing(got, 2048)
    stage_one = corpus_pipeline.quality(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, stage_one, small).select("doc_id").collect()}
    assert set(got.doc_id) == left


def test_pipeline_of_nothing(spark, small):
    now = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
    assert now.count() == 0


def test_near_copies_read_small_batches(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{i % 40}x{j}" for j in range(3000))) for i in range(80)]  # 20 KB each, pairs of copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    folder, sets, before = str(tmp_path), jaccard_join.shingle_sets, spark.conf.get(ARROW_BYTES)

    def noted(batches):
        for i, batch in enumerate(batches):
            with open(f"{folder}/{os.getpid()}-{i}", "w") as out:
                out.write(str(batch.nbytes))
            yield batch

    def measured(batches, size):
        return sets(noted(batches), size)

    monkeypatch.setattr(jaccard_join, "shingle_sets", measured)
    monkeypatch.setattr(jaccard_join, "small_batches", lambda s: small_batches(s, 1 << 17))
    found = jaccard_join.linked(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i % 40) for i in range(80)]
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(sizes) > 5 and max(sizes) < 1 << 18
    assert spark.conf.get(ARROW_BYTES) == before


def test_limits_of_batches_are_set_back(spark):
    for before, inside in ((None, "4194304b"), ("64m", "4194304b"), ("1m", "1m")):
        if before:
            spark.conf.set(ARROW_BYTES, before)
        with pytest.raises(KeyError), small_batches(spark):
            assert spark.conf.get(ARROW_BYTES) == inside
            raise KeyError
        assert spark.conf.get(ARROW_BYTES, None) == before
        spark.conf.unset(ARROW_BYTES)


def test_secrets_let_go_of_the_training_before_the_scan(monkeypatch):
    steps = []
    monkeypatch.setattr(secret_scan, "labelled_samples", lambda docs: docs)
    monkeypatch.setattr(secret_scan, "train", lambda samples: steps.append("train"))
    monkeypatch.setattr(corpus_pipeline, "release", lambda spark: steps.append("release"))
    monkeypatch.setattr(secret_scan, "scan", lambda docs, model: steps.append("scan"))
    monkeypatch.setattr(secret_scan, "redact", lambda found: None)
    with pytest.raises(AttributeError):  # there is nothing to redact
        corpus_pipeline.secrets(None, None, None)
    assert steps == ["train", "release", "scan"]


def test_release_gives_native_memory_of_the_driver_back(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def resident():
        return int(re.search(r"Pss_Anon:\s+(\d+)", status.read_text())[1]) / 1024

    taken = [jvm.java.util.zip.Deflater() for _ in range(400)]  # about 1 MB each once used, outside the heap
    for deflater in taken:
        deflater.setInput(bytes(200_000))
        deflater.deflate(bytearray(1000))
    for deflater in taken[:-1]:
        deflater.end()
    for _ in range(3):
        jvm.System.gc()
    before = resident()
    common.release(spark)
    assert before - resident() > 50


def test_release_without_the_command_to_trim(spark, monkeypatch):
    monkeypatch.setattr(common, "TRIM", "noSuchCommand")
    common.release(spark)
