"""The prefix trie of conversations, against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from groundlake.llm.prefix_trie import end_digests, prefix_trie, shared_turns

from .fixtures import clash

TURNS = "conv_id long, turn long, role string, text string"


def conversations(n=90, alphabet=3, long=0):
    """Shared starts, copies, gaps, null and repeated turn numbers, nulls, one long conversation."""
    rng = random.Random(8)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        for i in range(rng.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c, rng.choice([i, i, i, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", None, "", " x  y\tz "][:alphabet])))
    rows += [(c, i, "user", "a") for c in range(1000, 1015) for i in range(7)]  # copies
    rows += [(2000, i, "user", f"turn {i // 3}") for i in range(long)] + [(2001, i, "user", f"turn {i // 3}") for i in range(long - 2)]
    rows += [(None, 1, "user", "no conversation"), (-7, 0, "user", "minus"), (-7, 0, "user", "minus"), (5, 3, "user", "aé " * 400)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append(((t is not None, t or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        own_words = len(p[-1][1].split()) if p else 0
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * own_words
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def nodes(df):
    return sorted((r[0], r[1], -1 if r[2] is None and r[1] == 0 else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"piece": 2, "range_turns": 7, "block": 8}, {"piece": 256, "range_turns": 5}])
def test_every_node(spark, options):
    rows = conversations(long=8 if "block" in options else 0)
    df = clash(spark.createDataFrame(rows, TURNS).repartition(6), "conv", "n", "part")
    assert nodes(prefix_trie(df, **options)) == brute(rows)


def test_a_conversation_with_a_third_of_all_rows(spark):
    rows = conversations(60, 5, long=150)
    assert nodes(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4), piece=64, range_turns=40)) == brute(rows)


def test_many_ranges_on_one_path(spark):
    """Every range ends inside a subtree that others share."""
    rows = [(100 * 20 + 20 * c, i, "user", "start" if i < 3 else f"{c % 7}" if i == 3 else f"{c % 3} {c % 5}") for c in range(80) for i in range(4 + c % 3)]
    assert nodes(prefix_trie(spark.createDataFrame(rows, TURNS), range_turns=20)) == brute(rows)


def test_turnless_and_empty(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []
    rows = [(c, 0, "user", "gone") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = nodes(prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert got == brute(rows) and len(got) == 1


def test_digest_blocks(spark):
    ids = list(range(-30, 5000))
    got = end_digests(spark.createDataFrame([(1, 2, c) for c in ids], "e1 long, e2 long, conv long").repartition(5), block=50).collect()
    assert [(r.e1, r.e2, r.ends) for r in got] == [(1, 2, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_shared_turns():
    key = lambda s: b"".join(hashlib.md5(c.encode()).digest() for c in s)
    for a, b, n in (("", "", 0), ("a", "", 0), ("abc", "abd", 2), ("abc", "ab", 2), ("xbc", "abc", 0), ("abcdefgh", "abcdefgx", 7), ("abcdefgh", "abXdefgh", 2)):
        assert shared_turns(key(a), key(b)) == n
