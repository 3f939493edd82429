"""Operators that compare documents, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from groundlake.llm.components import components
from groundlake.llm.induced_sort import permuted_prefixes, suffix_array
from groundlake.llm.line_dedup import PerfectHash, dedup_lines
from groundlake.llm.partenum_join import _count_shared, bands, keep_one, layout, near_pairs, overlaps, signatures, similarity_classes, sketch
from groundlake.llm.suffix_dedup import remove_repeats

from .fixtures import COLUMNS, DOCS, clash, documents, frame, shingles

FAR = 2**63 - 1


def brute_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(FAR if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (FAR if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup(spark, limit):
    df = clash(frame(spark), "n_lines", "part")
    got = dedup_lines(df, broadcast_limit=limit, shard_keys=2)
    assert set(df.columns) - {"n_lines"} <= set(got.columns)
    assert Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(documents())


def test_line_dedup_empty(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    h = PerfectHash(PerfectHash.build(keys))
    assert sorted(h.slots(keys).tolist()) == list(range(5000))


def brute_join(rows):
    """Smallest id reachable by links, per row."""
    sets = [shingles(t) for _, t, *_ in rows]
    ids = [FAR if r[0] is None else r[0] for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), FAR), ids[k])
    return Counter((r[0], len(s), None if least[find(k)] == FAR else least[find(k)]) for k, (r, s) in enumerate(zip(rows, sets)))


def test_partenum_join(spark):
    got = similarity_classes(clash(frame(spark), "set", "n", "row"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(documents())


def test_partenum_join_many_near_copies(spark):
    """Chains and groups of near copies around the threshold."""
    import random

    rng = random.Random(2)
    rows = []
    for g in range(12):
        text = [f"w{g}_{rng.randrange(10**6)}" for _ in range(rng.choice([6, 9, 14, 25, 60, 200]))]
        for c in range(8):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 20)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if len(copy) > 5 and rng.random() < 0.3:
                copy = copy[: -rng.randrange(1, 1 + len(copy) // 5)]
            rows.append((len(rows), " ".join(copy), None, None, None))
            if rng.random() < 0.5:
                text = copy
    got = similarity_classes(frame(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(rows)


@pytest.mark.parametrize("block", [256, 3])
def test_partenum_join_counts_every_link(spark, monkeypatch, block):
    """``n_links`` is the number of other sets linked, also inside a component with a hub."""
    monkeypatch.setattr("groundlake.llm.partenum_join.BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(5, 115, 9)] + [" ".join(base), " ".join(base), "alone in here", None]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    near = lambda a, b: a and b and a != b and 9 * len(a & b) >= 4 * (len(a) + len(b))
    want = {i: sum(bool(near(a, b)) for b in set(sets)) for i, a in enumerate(sets)}
    assert max(want.values()) > 5
    assert {r.doc_id: r.n_links for r in similarity_classes(frame(spark, rows)).collect()} == want


def _loose_group(n=40):
    """Edits of one text so far apart that only some of them link, and texts with a passage of it."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    for i in range(n // 4):
        rows.append(" ".join([f"y{i}_{j}" for j in range(20 + i)] + base[:110] + [f"z{i % 3}"]))
    return [(i, t, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("rounds", "block"), [(2, 256), (1, 5)])
def test_partenum_join_loose_group(spark, monkeypatch, rounds, block):
    """Groups still in several components after the hubs' rounds are compared whole, in blocks."""
    monkeypatch.setattr("groundlake.llm.partenum_join.BLOCK", block)
    monkeypatch.setattr("groundlake.llm.partenum_join.SKETCHES", block)
    monkeypatch.setattr("groundlake.llm.partenum_join.ROUNDS", rounds)
    rows = _loose_group()
    sets = [shingles(t) for _, t, *_ in rows]
    near = lambda a, b: a != b and 9 * len(a & b) >= 4 * (len(a) + len(b))
    got = similarity_classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_join(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: sum(near(a, b) for b in sets) for i, a in enumerate(sets)}


def test_partenum_join_equal_64_bits(spark, monkeypatch):
    """Sets whose first 64 bits are equal stay apart by the next 64."""
    from pyspark import cloudpickle

    from groundlake.llm import partenum_join as module

    real = module.set_key
    monkeypatch.setattr(module, "set_key", lambda s: (real(s)[0] % 3, real(s)[1]))
    cloudpickle.register_pickle_by_value(module)
    try:
        rows = _loose_group(12)
        got = similarity_classes(frame(spark, rows))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def test_shared_tokens_are_streamed():
    """A batch in, its rows out; tokens that many sets share are counted over any batches."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = sorted({(int(t), int(s), int(t) % 2 if s == 7 else 0) for t, s in rng.integers(0, 12, (300, 2))} | {(5, s, 0) for s in range(40)} | {(99, 1, 0), (100, 1, 1)})
    taken = []

    def batches():
        for at in range(0, len(rows), 3):
            taken.append(at)
            part = rows[at : at + 3]
            none = pa.nulls(len(part), pa.int64())
            cols = [pa.array([r[i] for r in part], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, none, none, none, none, none, none], names=["token", "set", "known", "add", "h2", "row", "two", "doc", "n"])

    got, out = Counter(), _count_shared(batches())
    first = next(out)
    assert len(taken) < 12
    for b in [first, *out]:
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    want = Counter()
    for t in {r[0] for r in rows}:
        known = {s: max(k for t2, s2, k in rows if (t2, s2) == (t, s)) for t1, s, _ in rows if t1 == t}
        if len(known) > 1 or any(known.values()):
            want.update(s for s, k in known.items() if not k)
    assert got == want


def test_overlaps():
    rng = np.random.default_rng(9)
    a, b = ([np.unique(rng.integers(0, 6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    assert overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_partenum_join_empty(spark):
    assert similarity_classes(spark.createDataFrame([], DOCS)).collect() == []


def test_keep_one(spark):
    got = keep_one(frame(spark))
    assert got.columns == COLUMNS
    want = brute_join(documents())
    groups = {c for _, n, c in want if n and c is not None}
    kept = [r for r in got.collect()]
    assert {r.doc_id for r in kept if shingles(r.text) and r.doc_id is not None} == groups
    assert sum(not shingles(r.text) for r in kept) == sum(not shingles(t) for _, t, *_ in documents())


def test_keep_one_equal_rows(spark):
    """Equal rows without words all stay, equal rows with words are copies; hashes mark nulls."""
    text = "some words of a text that is long enough"
    rows = [(1, "", "x", None, 0), (1, "", "x", None, 0), (1, "", None, "x", 0), (1, None, "x", None, 0), (2, text, "x", None, 8), (2, text, "x", None, 8), (2, text, None, "x", 8)]
    got = keep_one(frame(spark, rows)).collect()
    assert Counter(map(tuple, got[:])) - Counter(rows[4:]) == Counter(rows[:4])
    assert sum(r.text == text for r in got) == 1


def test_signatures_meet():
    """Sets at the similarity always share a signature; bands leave no pair out."""
    rng = np.random.default_rng(3)
    for n in (5, 6, 9, 13, 17, 30, 77, 240, 900):
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            gone = rng.integers(0, n // 5 + 1)
            new = 0
            while 5 * (n - gone) < 4 * (n + new):
                gone -= 1
            while 5 * (n - gone) >= 4 * (n + new + 1):
                new += 1
            b = np.concatenate((a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)))
            if set(a) != set(b):
                assert len(np.intersect1d(signatures(np.unique(a)), signatures(np.unique(b))))
                both = [np.unique(a), np.unique(b)]
                assert near_pairs(np.array([len(x) for x in both]), [sketch(x) for x in both], np.array([0]), np.array([1]))[0]
    for n in range(1, 2000):
        for m in (n, (5 * n) // 4):
            assert {x for x, _ in bands(n)} & {x for x, _ in bands(m)}
        for _, k in bands(n):
            n1, n2, k2 = layout(k)
            assert k == 0 or (n1 * (k2 + 1) > k and n2 > k2)


def brute_repeats(rows):
    order = sorted(range(len(rows)), key=lambda k: (FAR if rows[k][0] is None else rows[k][0],))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            x = raw[s : s + 100]
            if x in seen:
                gone[s : s + 100] = True
            seen.add(x)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out[k] = (rows[k][0], len(raw), int(gone.sum()), len(edge) // 2, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_suffix_dedup(spark, limit):
    # of rows sharing an id the order is by a hash; the fixture gives them nothing in common
    rows = [r for r in documents() if not (r[1] or "").startswith("same id")]
    got = remove_repeats(clash(frame(spark, rows), "kept", "_row"), limit=limit).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got) == Counter(brute_repeats(rows).values())


def test_suffix_dedup_empty(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 26):
        for n in (1, 2, 7, 60, 200):
            t = rng.integers(97, 97 + k, n).astype(np.uint8)
            b = t.tobytes()
            sa = suffix_array(t)
            assert sa.tolist() == sorted(range(n), key=lambda i: b[i : i + 128] if k == 1 else b[i:]) or k == 1
            if k > 1:
                p = permuted_prefixes(t, sa)
                for x, y in zip(sa[1:], sa[:-1]):
                    same = next((i for i, (u, v) in enumerate(zip(b[x:], b[y:])) if u != v), min(n - x, n - y))
                    assert p[x] == min(same, 128)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}, 150: 150, 200: 150}


def test_components_of_later_edges(spark):
    """Edges that come later join the components found before: merged, extended, untouched, none."""
    rng = random.Random(4)
    table = lambda x: spark.createDataFrame(x, "a long, b long")
    first = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(40)] + [(500, 501), (501, 502)]
    later = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(25)] + [(7, 7), (900, 901)]
    known = components(table(first))
    whole = dict(map(tuple, components(table(first + later)).collect()))
    rows = [tuple(r) for r in components(table(later), known).collect()]
    assert dict(rows) == whole and len(rows) == len(whole)
    assert sorted(map(tuple, components(table([]), known).collect())) == sorted(map(tuple, known.collect()))
    assert components(table([])).collect() == []


def test_lines_against_hash(spark):
    got = dedup_lines(frame(spark).select("doc_id", "text"))
    assert all(len(hashlib.sha256((r.text or "").encode()).hexdigest()) == 64 for r in got.collect())
