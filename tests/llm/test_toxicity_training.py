"""What the toxicity classifier learns from, and what it does where labels are few or one-sided."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from tests.llm.conftest import WORDS

PHRASES = ["alpha kappa beta lambda gamma", "mu delta nu epsilon xi", "zeta omicron eta pi theta"]


def by_order(seed, toxic):
    """Texts of the same words; those of toxic ones come in fixed orders."""
    r = random.Random(seed)
    words = []
    for _ in range(12):
        phrase = r.choice(PHRASES).split()
        words += [r.choice(WORDS), *(phrase if toxic else r.sample(phrase, len(phrase)))]
    return " ".join(words)


def test_word_order_tells():
    model = toxicity.fit([by_order(i, True) for i in range(120)], [by_order(1000 + i, False) for i in range(240)])
    score = model.scorer()
    caught = [score(by_order(5000 + i, True)) >= toxicity.THRESHOLD for i in range(60)]
    wrong = [score(by_order(6000 + i, False)) >= toxicity.THRESHOLD for i in range(60)]
    assert sum(caught) >= 54 and sum(wrong) <= 3


def test_windows_cover_all_words():
    for n in range(40):
        words = [b"w%d" % i for i in range(n)]
        windows = [w.split() for w in toxicity.windows_of(words)]
        assert {w for ws in windows for w in ws} == set(words) and all(len(w) <= toxicity.WINDOW for w in windows)
        assert all(a[toxicity.STEP] == b[0] for a, b in zip(windows, windows[1:], strict=False))
    assert b"".join(b"".join(w.split()) for w in toxicity.windows_of([b"x" * 1000])).count(b"x") >= 1000


def test_one_sided_labels_reject_nothing():
    for toxic, ordinary in ((["a b", "c d", "e f"], ["g h"]), ([f"word{i} x" for i in range(50)], []), ([], ["a b"] * 3)):
        assert toxicity.fit(toxic, ordinary).scorer()("clean text") < toxicity.THRESHOLD


def test_few_labels_still_tell():
    toxic, ordinary = [by_order(i, True) for i in range(16)], [by_order(1000 + i, False) for i in range(48)]
    model = toxicity.fit(toxic, ordinary)
    assert model.weights
    caught = [model.scorer()(by_order(5000 + i, True)) >= toxicity.THRESHOLD for i in range(40)]
    wrong = [model.scorer()(by_order(6000 + i, False)) >= toxicity.THRESHOLD for i in range(40)]
    assert sum(caught) >= 30 and sum(wrong) <= 2


def test_mostly_toxic_labels_keep_clean_documents():
    model = toxicity.fit([by_order(i, True) for i in range(60)], [by_order(1000 + i, False) for i in range(6)])
    clean = [model.scorer()(by_order(6000 + i, False)) < toxicity.THRESHOLD for i in range(40)]
    assert sum(clean) >= 36


def brute_features(model, text):
    """The features of a text by compressors made anew for every length, without memory: windows of words, then single words."""
    import zstandard as zstd

    def length(content, data, strategy):
        how = zstd.ZstdCompressionParameters(window_log=15, chain_log=15, hash_log=13, search_log=4, min_match=4, target_length=64, strategy=strategy,
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data))

    words, fixed = text.lower().encode().split(), toxicity.BEFORE + toxicity.AFTER
    starts = range(0, max(len(words) - toxicity.STEP, min(len(words), 1)), toxicity.STEP)
    windows = [b" ".join(words[i : i + toxicity.WINDOW]) for i in starts]
    by_window = [(length(model.ordinary, w, zstd.STRATEGY_GREEDY) - length(model.toxic, w, zstd.STRATEGY_GREEDY)) / (len(w) + 8) for w in windows] or [0.0]
    by_word = []
    for w in words:
        data = toxicity.BEFORE + b" " + w + b" " + toxicity.AFTER
        by_word.append(length(model.ordinary + fixed, data, zstd.STRATEGY_LAZY) - length(model.ordinary + model.words + fixed, data, zstd.STRATEGY_LAZY))
    best = [*sorted((max(d, 0) for d in by_word), reverse=True), 0, 0, 0][:3]
    return [sum(by_window) / len(by_window), max(by_window), *best, *(sum(d >= k for d in by_word) / (max(len(by_word), 1) + 20) for k in (2, 3, 4))]


def test_scores_equal_brute_force():
    model = toxicity.fit([by_order(i, True) for i in range(40)], [by_order(1000 + i, False) for i in range(80)])
    score, distance = model.scorer(), toxicity.Distance(model.ordinary, model.toxic, model.words)
    for text in (by_order(1, True), by_order(5001, True), by_order(6001, False), "", " \n", "one", "é \U0001f600 x" * 40):
        want = brute_features(model, text)
        assert distance.features(text) == pytest.approx(want)
        exact = 1 / (1 + math.exp(-(sum(w * f for w, f in zip(model.weights, want, strict=False)) + model.weights[-1])))
        assert score(text) == pytest.approx(exact)


def test_texts_of_one_opening_are_all_learned():
    header = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron "
    toxic, ordinary = [header + by_order(i, True) for i in range(60)], [header + by_order(1000 + i, False) for i in range(120)]
    score = toxicity.fit(toxic, ordinary).scorer()
    assert sum(score(header + by_order(5000 + i, True)) >= toxicity.THRESHOLD for i in range(30)) >= 24


def test_fit_on_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([(i, by_order(i, i % 2 == 0), "own") for i in range(30)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), "own") for i in range(30)] + [(None, 1, "own"), (3, None, "own"), (4, 0, "own")], "doc_id long, toxic int, text string")
    assert toxicity.fit_on(docs, labels).weights
    for d, some in ((docs.limit(0), labels), (docs, labels.limit(0))):
        model = toxicity.fit_on(d, some)
        scores = [r["toxicity"] for r in toxicity.score(docs, model).collect()]
        assert len(scores) == 30 and max(scores) < toxicity.THRESHOLD
    twice = toxicity.score(docs.union(docs), toxicity.fit_on(docs, labels))
    assert {r["n"] for r in twice.groupBy("doc_id").agg(F.count_distinct("toxicity").alias("n")).collect()} == {1}
