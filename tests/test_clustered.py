"""Exact search over the clustered index, and how much it skips."""

from __future__ import annotations

import numpy as np
import pytest

from groundlake.operators import clustered, retrieve


def vectors(clusters=40, each=60, d=16, spread=0.02, copies=500):
    """Tight clusters, one vector a fifth of all, norms that differ, and rows that cannot be found."""
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(clusters, d))
    x = np.repeat(heart, each, axis=0) + spread * rng.normal(size=(clusters * each, d))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0), 0.1 * rng.normal(size=(50, d))])
    rows = [(f"c{i:05d}", v.tolist()) for i, v in enumerate(x)]
    return [*rows, ("n1", None), ("n2", [None] + [1.0] * (d - 1)), ("n3", [float("nan")] * d), ("n4", [1.0]), ("n5", [float("inf")] * d), ("n6", [])], x


def brute(x, q, k):
    score = (x[None] * q[:, None]).sum(axis=2)
    return {i: sorted(((-s, f"c{j:05d}") for j, s in enumerate(row)))[:k] for i, row in enumerate(score)}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, x = vectors()
    path = str(tmp_path_factory.mktemp("clustered"))
    clustered.build(spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(5), path, file_rows=120)
    return rows, x, path


def asked(spark, q):
    return spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, q_embedding array<double>")


def check(hits, want):
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(int(r.qid[1:]), []).append((-r.score, r.chunk_id))
    assert got.keys() == want.keys()
    for i, rows in want.items():
        assert [c for _, c in got[i]] == [c for _, c in rows] and np.allclose([s for s, _ in got[i]], [s for s, _ in rows], atol=1e-12)


def test_same_answers_and_blocks_skipped(spark, built):
    _, x, path = built
    q = x[::97]
    hits, report = clustered.search(spark, path, asked(spark, q), 8)
    check(hits, brute(x, q, 8))
    counts = report.collect()
    assert len(counts) == len(q) and sum(r.read for r in counts) < 0.4 * sum(r.blocks for r in counts)


def test_far_and_zero_questions_and_large_k(spark, built):
    rows, x, path = built
    q = np.stack([-3 * x[0], np.zeros(16), 1e3 * x[700]])
    for k in (1, 5, 4000):
        hits, _ = clustered.search(spark, path, asked(spark, q), k)
        check(hits, brute(x, q, k))


def test_heap_path_agrees(spark, built):
    rows, x, _ = built
    q = x[::211]
    table = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(7)
    for most in (4096, 3):
        check(retrieve.top_k(table, asked(spark, q), 600, most=most), brute(x, q, 600))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (0.01, 1.0, 30.0):
        x, q, c = rng.normal(size=(200, 6)) * scale, rng.normal(size=(50, 6)), rng.normal(size=6)
        apart, norm = np.linalg.norm(x - c, axis=1), np.linalg.norm(x, axis=1)
        bound = clustered.upper_bounds(q, c[None], apart.min()[None], apart.max()[None], norm.max()[None])[:, 0]
        assert (bound >= (q @ x.T).max(axis=1)).all()


def test_empty_index_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    clustered.build(none, str(tmp_path))
    hits, report = clustered.search(spark, str(tmp_path), asked(spark, np.ones((2, 3))), 3)
    assert hits.collect() == [] and [(r.blocks, r.read) for r in report.collect()] == [(0, 0)] * 2
    hits, report = clustered.search(spark, str(tmp_path), spark.createDataFrame([], "qid string, q_embedding array<double>"), 3)
    assert hits.collect() == [] and report.collect() == []
