"""The quality classifier: arrays against walking each tree, statistics, held-out accuracy, odd texts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from groundlake.llm.language_id import held_out
from groundlake.llm.quality_trees import STATISTICS, fit_quality, fit_trees, score_quality, statistics

from .fixtures import clash, documents, frame, words

LABELS = "doc_id long, quality int"


def walk(t, row):
    total = t.base
    for node in t.roots:
        while t.left[node] != node:
            node = t.left[node] + int(row[t.feature[node]] > t.cut[node])
        total += t.value[node]
    return 1 / (1 + math.exp(-total))


def test_arrays_are_the_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    t = fit_trees(x, y, trees=60, leaves=6)
    p = t.score(x)
    assert np.allclose(p, [walk(t, r) for r in x], atol=1e-12)
    assert (((p > 0.5) == y).mean()) > 0.9 and 0 < p.min() and p.max() < 1
    fresh = rng.normal(size=(600, 5))
    assert ((t.score(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.8


def test_split_is_the_best_of_all():
    """One tree of two leaves takes the cut of largest gain among all bins of all columns."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(200) < 0.1)).astype(int)
    t = fit_trees(x, y, trees=1, leaves=2, bins=64, least=5)
    p = (y.sum() + 0.5) / 201
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(j, c):
        low = x[:, j] <= c
        if low.sum() < 5 or (~low).sum() < 5:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(low) + part(~low) - part(np.ones(200, bool))

    every = {(j, c): gain(j, c) for j in range(3) for c in range(11)}
    assert gain(t.feature[0], t.cut[0]) == pytest.approx(max(every.values()))


def test_one_label_or_no_rows():
    for n in (0, 1, 50):
        t = fit_trees(np.zeros((n, 4)), np.ones(n, dtype=int))
        p = t.score(np.zeros((3, 4)))
        assert len(p) == 3 and ((p >= 0) & (p <= 1)).all() and (p >= 0.5).all()
    assert len(t.score(np.zeros((0, 4)))) == 0


@pytest.mark.parametrize("text", [None, "", " \n\t", "x", "a" * 100_000, "é\ud800"[:1], "\x00\x1c", "!!! ???", "| " * 50, "A" + "\n" * 40])
def test_statistics_of_odd_texts(text):
    got = statistics(text)
    assert len(got) == len(STATISTICS) and all(math.isfinite(v) for v in got)


def test_statistics_of_a_known_text():
    got = dict(zip(STATISTICS, statistics("One two two.\n\nONE 12 |\nOne two two.")))
    assert got["distinct_words"] == 6 / 9 and got["top_word"] == 2 / 9 and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["empty_lines"] == 0.25 and got["upper_words"] == 1 / 9 and got["digit_words"] == 1 / 9 and got["bar_words"] == 1 / 9
    assert got["sentence_words"] == 2 / 9 and got["symbol_words"] == 3 / 9 and got["repeated_pairs"] == pytest.approx(1 - 6 / 8)


def quality_rows(n=300):
    """Prose, and shouted or listed words, mixed in with prose."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        t = words(rng, rng.randint(30, 200))
        good = int(rng.random() < 0.7)
        if not good:
            t = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w + rng.choice("#$%&*") * 3 for w in t.split())])(t)
        rows.append((i, t, None, None, len(t)))
        labels.append((i, good))
    return rows, labels


@pytest.mark.parametrize("most", [20_000, 150])
def test_held_out_accuracy(spark, most):
    rows, labels = quality_rows()
    taught = spark.createDataFrame(labels, LABELS).filter(~held_out())
    trees = fit_quality(frame(spark, rows), taught, most=most, trees=20)
    got = score_quality(clash(frame(spark, rows), "score", "x", "label"), trees).withColumn("out", held_out()).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.x == "mine" for r in got)
    out = [r.predicted == truth[r.doc_id] for r in got if r.out]
    assert len(out) > 40 and sum(out) / len(out) > 0.9


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = quality_rows(120)
    fold = {r.doc_id for r in frame(spark, rows).filter(held_out()).collect()}
    scores = []
    for change in (0, 1):
        given = [(i, 1 - q if change and i in fold else q) for i, q in labels] + [(None, 1), (3, None)]
        trees = fit_quality(frame(spark, rows).repartition(1 + 4 * change), spark.createDataFrame(given, LABELS).filter(~held_out()), trees=5)
        scores.append(sorted((r.doc_id, r.score) for r in score_quality(frame(spark, rows), trees).collect()))
    assert scores[0] == scores[1]


def test_odd_documents_and_empty_tables(spark):
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(28)], LABELS)
    trees = fit_quality(frame(spark), labels, trees=3)
    got = score_quality(frame(spark), trees).collect()
    assert len(got) == len(documents())
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    none = fit_quality(frame(spark), spark.createDataFrame([], LABELS))
    assert {r.score for r in score_quality(frame(spark), none).collect()} == {0.5}
    assert score_quality(frame(spark, []), none).collect() == []
