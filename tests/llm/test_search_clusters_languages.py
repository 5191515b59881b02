"""Ranked search, clusters and languages against brute force, on odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ball_kmeans, language_id, lexical_search

# ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    """Brute force: every document against every item."""
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    counts = [collections.Counter(t) for t in terms]
    df = collections.Counter(x for c in counts for x in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, wanted in asked.items():
        found = []
        for (doc, _), words, c in zip(docs, terms, counts, strict=True):
            m = 50 + 50 * len(words) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(i, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k, spark):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("term", "row", "score", "shard", "item")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("own") for c in ("term", "w", "least", "rank")})
    return sorted((tuple(r) for r in lexical_search.rank_documents(d.repartition(3), q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranking_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical_search, "SHARD", 16)
    monkeypatch.setattr(lexical_search, "PART", 8)
    monkeypatch.setattr(lexical_search, "PACK", 10)
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["the"] * 60 + ["É", "Straße", "x1"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, "..."), (7, text(5)), (7, text(5)), (None, "w1 w2 w3"), (203, "w1 " * 5000), (300, "W1, the-w2"), (301, "W1, the-w2")]
    docs += [(400 + i, "the same w5 w6 text as others") for i in range(90)]
    items = [(i, text(r.randrange(1, 25))) for i in range(12)] + [(50, None), (51, "nothing here"), (None, "w1"), (52, "the"), (53, "w1"), (53, "w2"), (54, "w5 w6")]
    assert searched(docs, items, k, spark) == ranked(docs, items, k)


def test_ranking_joins_where_query_terms_are_many(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 3)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 4)
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(30)}" for _ in range(n))
    docs, items = [(i, text(20)) for i in range(80)], [(i, text(6)) for i in range(7)]
    assert searched(docs, items, 5, spark) == ranked(docs, items, 5)


def test_ranking_of_empty_tables(spark):
    assert searched([], [(1, "a")], 5, spark) == searched([(1, "a")], [], 5, spark) == searched([(1, None)], [(1, "a")], 5, spark) == []


# clusters


def clustered(rows, clusters, rounds, dimensions, scale):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, v) for i, v in good if all(abs(x) < ball_kmeans.LARGEST for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in good:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centroids)]
    told = [(i, *near(v)[::-1]) for i, v in good] if centroids else []
    inertia = collections.Counter()
    for _, k, d in told:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in told), key=str)


def through(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("cluster", "distance", "codes", "v")})
    out = ball_kmeans.ball_kmeans(df.repartition(3), **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("clusters", "spread"), [(5, 0.3), (16, 2.0), (3, 400.0)])
def test_clusters_equal_brute_force(spark, clusters, spread):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(0, spread, (6, 4))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 4)).tolist()) for i in range(250)]
    rows += [(7, [1.0, 0.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.0]), (None, [0.5] * 4), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [0.0] * 4), (906, [1e300] * 4), (907, [])]
    how = {"clusters": clusters, "rounds": 3, "dimensions": 4, "scale": 64}
    assert through(spark, rows, **how) == clustered(rows, **how)


def test_few_and_no_vectors(spark):
    how = {"clusters": 16, "rounds": 3, "dimensions": 2, "scale": 64}
    same = [(i, [0.5, 0.25]) for i in range(40)]
    assert through(spark, same, **how) == clustered(same, **how)
    assert through(spark, same[:1], **how) == clustered(same[:1], **how)
    assert through(spark, [], **how) == through(spark, [(None, [1.0, 2.0])], **how) == []


def test_balls_leave_most_distances_out():
    """A vector meets only centroids that can be nearer; the result is that of comparing all."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = np.concatenate([c + rng.integers(-60, 60, (100, 8)) for c in centres])
    start = ball_kmeans.Balls(x[::100].copy(), (None,) * 16)
    own, d = ball_kmeans.nearest(x, start.centroids)
    found = {int(k): (x[own == k].sum(axis=0).tolist(), int((own == k).sum()), int(d[own == k].max()), 0) for k in np.unique(own)}
    balls = ball_kmeans.updated(start, found)
    to, least, met = ball_kmeans.reassigned(x, own, balls)
    want, want_d = ball_kmeans.nearest(x, balls.centroids)
    assert (to == want).all() and (least == want_d).all() and met < len(x) * 15 / 20
    assert sum(map(len, balls.neighbours())) < 16 * 15 / 4


def test_packed_vectors_come_back():
    x = np.array([[1, -128], [127, 5], [128, 0], [-129, 0], [1 << 20, -(1 << 20)], [-32768, 32767]])
    codes = ball_kmeans.packed(x)
    assert [len(c) for c in codes] == [2, 2, 4, 4, 8, 4]
    import pyarrow as pa

    assert (ball_kmeans.unpacked(pa.array(codes, pa.binary()), 2) == x).all()


# languages

SAMPLES = {
    "en": "the quick brown fox jumps over that lazy dog and then they were walking through the other streets with friends",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und danach gingen sie durch die anderen Straßen mit Freunden",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et ensuite ils marchaient dans les autres rues avec amis",
}


def prose(lang, r, n):
    return " ".join(r.choice(SAMPLES[lang].split()) for _ in range(n))


def test_languages_on_held_out_rows(spark):
    r = random.Random(3)
    rows = [(i, prose(lang, r, r.randrange(3, 60)), lang) for i in range(900) for lang in [r.choice(list(SAMPLES))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_on(df)
    got = {g["doc_id"]: g for g in language_id.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= g["lang_score"] <= 1 and g["lang_margin"] >= 0 for g in got.values())
    # A held-out row's label is never seen: other labels there give the same model.
    other = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language_id.fit_on(other) == model


def test_odd_texts_have_defined_languages(spark, odd_documents):
    r = random.Random(4)
    known = spark.createDataFrame([(i, prose(lang, r, 40), lang) for i in range(60) for lang in SAMPLES], "doc_id long, text string, lang string")
    model = language_id.fit_on(known)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... Ⅷ"), (4, "das ist der Hund und die Straßen"), (5, "é"), (6, "x" * 300_000), (6, "x" * 300_000), (None, "the other streets")], "doc_id long, text string").withColumn("lang_pred", F.lit("own"))
    got = [(g["doc_id"], g["lang_pred"], g["lang_score"], g["lang_rejected"]) for g in language_id.identify(rows, model).collect()]
    assert got[0] == (1, "und", 0.0, True) and got[1] == (2, "und", 0.0, True) and got[2] == (3, "und", 0.0, True)
    assert got[3][1] == "de" and got[4][1] in SAMPLES and got[5] == got[6] and got[7][1] == "en"
    assert language_id.identify(odd_documents, model).columns == [*odd_documents.columns, "lang_pred", "lang_score", "lang_margin", "lang_rejected"]
    assert language_id.identify(odd_documents, model).count() == odd_documents.count()


def test_languages_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.fit_on(empty)
    assert model == language_id.Model() and language_id.Identifier(model)("the text") == ("und", 0.0, 0.0)
    one = language_id.fit_on(spark.createDataFrame([(1, "the text", "en"), (2, None, "de"), (None, "le texte", "fr"), (3, "x", None)], "doc_id long, text string, lang string"))
    assert one.languages == ("en",) and language_id.Identifier(one)("any word")[0] == "en"
    many = spark.range(6000).selectExpr("id AS doc_id", "'text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        language_id.fit_on(many)
