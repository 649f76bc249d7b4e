"""Rule statistics against plain string code, the forest against a walk through its trees."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import isolation


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@given(st.lists(st.sampled_from(["a", "b", "é", "#", "x|y", "\n", "\n", "a b", "a b c d e f g h", "😀", "\x0b", "\x1c", "\x85"]), max_size=60).map(" ".join), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_counts(text, size):
    assert isolation.counts(text.encode())[:5] == plain(text)
    assert b"".join(isolation._pieces(text.encode(), size)) == text.encode()


def test_repeats_of_long_texts():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 3000)
    text = " ".join("xyz"[w] for w in words)
    assert isolation.counts(text.encode())[4] == plain(text)[4]
    assert isolation.repeated_words(np.zeros(1_000_000, np.int32)) == 1_000_000


def walk(forest, row):
    """The score of one row, node by node."""
    total = 0.0
    for feature, at, left in zip(forest.feature, forest.at, forest.left, strict=True):
        k = 0
        while feature[k] >= 0:
            k = left[k] + int(row[feature[k]] > at[k])
        total += at[k]
    return 2 ** (-total / len(forest.feature) / forest.norm)


def test_forest():
    rng = np.random.default_rng(1)
    rows = np.column_stack([rng.normal(5, 0.2, 600), np.zeros(600), rng.random(600) / 10])
    forest = isolation.Forest.fit(rows, 64, 128, np.array([1.0, 0.2, 0.1]))
    odd = np.array([[5.0, 1.5, 0.05], [9.0, 0.0, 0.05], [5.0, 0.0, 0.05]])
    got = forest.score(odd)
    assert np.allclose(got, [walk(forest, r) for r in odd]) and got[0] > got[2] + 0.1 and got[1] > got[2] + 0.1
    assert forest.feature.shape[1] <= 2 * 128 + 1 and math.isclose(forest.norm, 2 * (math.log(127) + np.euler_gamma) - 2 * 127 / 128)
    assert isolation.Forest.fit(rows[:1], 4, 8, np.ones(3)) is None and isolation.Forest.fit(np.zeros((5, 3)), 4, 8, np.ones(3)).score(odd).shape == (3,)


def some(spark):
    good = [(i, f"this is a plain sentence number {i} with words that say little, and it goes on for some time until it ends here. " + "and so it was, " * (i % 2)) for i in range(200)]
    bad = [(1000 + i, " | ".join(f"cell{i}x{k}" for k in range(40))) for i in range(60)]
    odd = [(2000, None), (2001, ""), (2002, "too short"), (2003, "again and again we say the very same words " * 30), (None, "no id " * 3), (5, good[5][1])]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("quality"), F.lit(2).alias("n_words"), F.lit("x").alias("label"), F.lit(0).alias("order"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 3)] + [(1000 + i, 0) for i in range(0, 60, 2)] + [(None, 1), (7, None), (4, 1)], "doc_id long, quality int")
    return docs, labels


def test_keep_normal(spark):
    docs, labels = some(spark)
    rows = isolation.keep_normal(docs, labels, most_rows=80, trees=32, size=32).collect()
    assert len(rows) == 266
    by = {r.doc_id: r for r in rows}
    assert by[2000].n_words == 0 and all(by[i].base_failed and not by[i].kept for i in (2000, 2001, 2002, 2003, None))
    assert sum(by[i].kept for i in range(200)) >= 195 and sum(by[1000 + i].kept for i in range(60)) <= 3
    assert all(0 <= r.anomaly <= 1 for r in rows) and sum(r.doc_id == 5 for r in rows) == 2


def test_thresholds_by_hand(spark):
    rows = [(i, 50, 0.30, False) for i in range(100)] + [(100 + i, 50, 0.70, False) for i in range(60)] + [(200 + i, 500, 0.5, False) for i in range(3)] + [(300, 50, 0.9, True)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, anomaly double, base_failed boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(100 + i, 0) for i in range(60)] + [(300, 1)], "doc_id long, quality int")
    limits = isolation.thresholds(scored, labels, "doc_id", "quality")
    assert len(limits) == 3 and all(0.3 < x <= 0.7 for x in limits)
    assert isolation.thresholds(scored, labels.filter("quality = 1"), "doc_id", "quality") == [2.0] * 3
    assert isolation.thresholds(scored, labels.limit(0), "doc_id", "quality") == [2.0] * 3


def test_without_labels_or_rows(spark):
    docs, labels = some(spark)
    rows = isolation.keep_normal(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.anomaly == 0.5 for r in rows)
    assert isolation.keep_normal(docs.limit(0), labels).collect() == []
