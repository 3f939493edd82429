"""Operators that work text by text or on counts, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundlake.llm.common import frequent
from groundlake.llm.brown_lm import exchange, fit, score_texts, shape, tokens
from groundlake.llm.gif_media import Frame, decode_frames, gif_payload, lzw_decode, lzw_encode, read_gif, render, store_texts, text_payload, write_gif
from groundlake.llm.language_id import UNKNOWN, drop_unidentified, fit_profiles, grams, held_out, identify
from groundlake.llm.lexicon_bpe import Lexicon, Vocabulary, compile_lexicon, encode_texts
from groundlake.llm.mixing import _round_block, apply_mix, mix_plan
from groundlake.llm.rabitq_ann import nearest
from groundlake.llm.role_repair import FINAL, FOLLOWS, INSERT, MERGE, RELABEL, ROLES, best_states, repair, segment_matrix

from .fixtures import COLUMNS, DOCS, WORD, clash, documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- mixing -----------------------------------------------------------------------------


def brute_targets(rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    full, left = {}, dict(weight)
    budget = 1.5 * sum(sizes.values())
    while True:
        share = (budget - sum(full.values())) / sum(left.values())
        over = [s for s in left if share * weight[s] > 2 * sizes[s]]
        if not over:
            return sizes, full | {s: share * weight[s] for s in left}
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]


def test_mix_plan(spark):
    rows = documents() + [(1000 + i, "word " * (i % 17), None, f"src{i % 5}", None) for i in range(700)]
    sizes, targets = brute_targets(rows)
    got = mix_plan(clash(frame(spark, rows), "size", "key")).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s, t in targets.items():
        lengths = sorted((r["size"] for r in got if r.source == s), reverse=True)
        # where the others could balance the longest document, a short one is left over
        slack = sorted(x for x in lengths if x)[len(lengths) // 4] if lengths and 2 * lengths[0] < sum(lengths) else lengths[0]
        assert abs(taken[s] - t) <= slack, s
    again = mix_plan(clash(frame(spark, rows), "size", "key").repartition(7)).collect()
    assert Counter((r.row_hash, r.copies) for r in again) == Counter((r.row_hash, r.copies) for r in got)


def test_a_block_leaves_a_short_row_over():
    """A few documents hold most words, yet a source misses its share by a short document at most."""
    import pandas as pd

    rng = random.Random(11)
    size = [5184, 2600, 900] + [rng.randrange(1, 400) for _ in range(120)]
    for seed in range(40):
        q = rng.uniform(0.25, 0.75)
        block = pd.DataFrame({"key": range(len(size)), "key_2": 0, "nth": 1, "size": size, "base": 0, "frac": q, "block": 0, "copies": 0})
        got = _round_block(seed, 0)((0,), block)
        assert abs((got.copies * got["size"]).sum() - q * sum(size)) <= 20


def test_mix_keeps_expectations():
    """Over seeds, every document's mean number of copies is its own ratio, and a block moves no mass."""
    import pandas as pd

    rng = random.Random(4)
    size = [rng.choice([0, 1, 3, 9, 40]) for _ in range(24)]
    frac = [rng.random() for _ in size]
    block = pd.DataFrame({"key": range(24), "key_2": 0, "nth": 1, "size": size, "base": 1, "frac": frac, "block": 0, "copies": 0})
    draws, total = 1000, np.zeros(24)
    for seed in range(draws):
        got = _round_block(seed, 0)((0,), block)
        left = np.nan_to_num(got.frac.to_numpy())
        total += got.copies.to_numpy() + left
        words = (np.array(size) * (got.copies + left - 1)).sum()
        assert words == pytest.approx(sum(f * n for f, n in zip(frac, size))) and (left > 0).sum() <= 1
    error = np.abs(total / draws - 1 - frac)
    assert (error < 5 * np.sqrt(np.array(frac) * (1 - np.array(frac)) / draws) + 1e-9).all()


def test_mix_tells_rows_apart(spark):
    """Rows that differ only in which column is null; equal rows are rounded each."""
    rows = [(1, "aa bb cc", "xx", None, 8), (1, "aa bb cc", None, "xx", 8)] + [(5, "aa bb", "y", "yy", 5)] * 9
    got = Counter(map(tuple, apply_mix(frame(spark, rows), budget=2.0).collect()))
    assert got == Counter({rows[0]: 2, rows[1]: 2, rows[2]: 18})
    plan = mix_plan(frame(spark, rows)).collect()
    assert len(plan) == 11 and len({(r.row_hash, r.row_hash_2) for r in plan}) == 3


def test_apply_mix(spark):
    df = frame(spark)
    assert apply_mix(df).columns == COLUMNS
    assert apply_mix(df).count() == sum(r.copies for r in mix_plan(df).collect())
    assert apply_mix(spark.createDataFrame([], DOCS)).collect() == []


# --- GIF --------------------------------------------------------------------------------


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"a" * 100_000, rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes(), rng.integers(97, 100, 30_000, dtype=np.uint8).tobytes()):
        assert lzw_decode(lzw_encode(data), 8) == data


def test_lzw_other_encoders():
    """A known small stream; a table left full; a literal-only stream with early clears."""
    assert lzw_decode(bytes.fromhex("8c2d99872a1cdc33a0027505"), 2)[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2])
    data = bytes(range(256)) * 60
    bits = "".join(f"{c:09b}"[::-1] for at in range(0, len(data), 200) for c in (256, *data[at : at + 200])) + f"{257:09b}"[::-1]
    stream = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert lzw_decode(stream, 8) == data


def test_store_texts(spark):
    got = store_texts(clash(frame(spark), "gif", "mine")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in documents())
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == text_payload(r.text) == gif_payload(bytes(r.gif)) and r.n_bytes == len(raw)
        assert len(r.payload) % 64 == 0 and r.payload[: len(raw)] == raw and sum(sum(f.hist_g) for f in r.frames) == len(r.payload)
    assert store_texts(spark.createDataFrame([], DOCS)).collect() == []


def test_frames_follow_disposal_and_transparency(spark):
    red = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0]).ljust(768, b"\0")
    frames = [
        Frame(0, 0, 2, 2, 5, 1, None, red, bytes([1, 1, 1, 1])),
        Frame(1, 1, 1, 1, 7, 2, None, red, bytes([2])),
        Frame(0, 0, 2, 1, 9, 3, 2, red, bytes([2, 2])),
        Frame(0, 0, 1, 1, 1, 0, 0, red, bytes([2])),
    ]
    file = write_gif(frames, 2, 2)
    assert read_gif(file)[2] == frames
    shown = [c[:, :, :2].tolist() for c in render(2, 2, frames)]
    r, g, off = [255, 0], [0, 255], [0, 0]
    assert shown == [[[r, r], [r, r]], [[r, r], [r, g]], [[r, r], [r, off]], [[g, r], [r, off]]]
    rows = decode_frames(spark.createDataFrame([(1, bytearray(file)), (2, None)], "doc_id long, gif binary")).orderBy("frame").collect()
    huge = b"GIF89a" + b"\xff" * 4 + bytes(3)
    odd = [(3, bytearray()), (4, bytearray(b"no gif")), (5, bytearray(file[:-8])), (6, bytearray(huge)), (7, bytearray(file[:20]))]
    broken = decode_frames(clash(spark.createDataFrame(odd, "doc_id long, gif binary"), "frame", "error"))
    got = {i: [r.error is not None for r in broken.collect() if r.doc_id == i] for i in range(3, 8)}
    assert all(x[-1] and not any(x[:-1]) for x in got.values()) and len(got[6]) == 1
    assert decode_frames(spark.createDataFrame([], "doc_id long, gif binary")).collect() == []
    assert [(x.start_ms, x.delay_ms, x.disposal) for x in rows] == [(0, 50, 1), (50, 70, 2), (120, 90, 3), (210, 10, 0)]
    assert rows[1].hist_r[15] == 3 and rows[1].hist_g[15] == 1 and sum(rows[2].hist_r) == 3


# --- language ---------------------------------------------------------------------------


def test_language_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs, fit_profiles(docs.filter(~held_out()))).filter(held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_is_least_out_of_place(spark):
    """Profiles, predictions and scores by plain dictionaries over the n-grams of padded words."""
    rows = [r for r in documents() if r[0] is not None and r[0] != 3]
    df = frame(spark, rows)
    profiles = fit_profiles(df, size=40)

    def plain(text):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            for n in (1, 2, 3):
                padded = word if n == 1 else f" {word} "
                out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
        return out

    def rank(found):
        return [g for g, _ in sorted(Counter(found).items(), key=lambda x: (-x[1], x[0]))[:40]]

    for _, t, *_ in rows:
        assert sorted(Counter(grams(t, 3).tolist()).values()) == sorted(Counter(plain(t)).values())
    learned = {lang: rank([g for _, t, x, *_ in rows if x == lang and t is not None for g in grams(t, 3).tolist()]) for lang in ("de", "en")}
    # the same distinct rows only: a repeated row teaches as often as it occurs
    assert profiles.names == sorted(learned)
    for r in identify(df, profiles).collect():
        own = rank(grams(r.text, 3).tolist())
        if own:
            apart = {lang: sum(abs(x.index(g) - i) if g in x else 40 for i, g in enumerate(own)) for lang, x in learned.items()}
            assert r.lang_pred == min(apart, key=lambda x: (apart[x], x)) and r.score == pytest.approx(1 - min(apart.values()) / (40 * len(own)))


def test_language_cases(spark):
    df = clash(frame(spark), "score", "gram")
    got = identify(df, fit_profiles(df)).collect()
    for r in got:
        assert (r.lang_pred == UNKNOWN) == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in ("en", "de", UNKNOWN) and 0 <= r.score <= 1
    nothing = identify(df, fit_profiles(df.filter("false")))
    assert {r.lang_pred for r in nothing.collect()} == {UNKNOWN}
    kept = drop_unidentified(frame(spark))
    assert kept.columns == COLUMNS
    want = {(r.doc_id, r.text): r.lang or r.lang_pred for r in identify(frame(spark), fit_profiles(frame(spark).filter(~held_out()))).collect() if r.lang_pred != UNKNOWN}
    assert {(r.doc_id, r.text): r.lang for r in kept.collect()} == want


def test_frequent_rows(spark):
    """At most so many rows, those of largest counts; equal counts are in or out together."""
    table = spark.createDataFrame([(w, n) for w, n in zip("abcdefgh", (1, 1, 1, 2, 2, 300, 9000, 10**12))], "word string, n long")
    got = {size: sorted(r.word for r in frequent(table, size).collect()) for size in (0, 1, 3, 4, 5, 7, 8, 99)}
    assert got == {0: [], 1: ["h"], 3: [*"fgh"], 4: [*"fgh"], 5: [*"defgh"], 7: [*"defgh"], 8: [*"abcdefgh"], 99: [*"abcdefgh"]}


def test_held_out_is_crc(spark):
    for r in frame(spark).select("doc_id", held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


# --- BPE --------------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    odd = "aB'sÉ é\x1c\x85 1٣你😀ΣςİÅﬁ!.-<|>_\t\n"
    extra = ["".join(rng.choice([rng.choice(odd), chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF)]))]) for _ in range(40)) for _ in range(300)]
    rows = documents() + [(2000 + i, t, None, None, None) for i, t in enumerate([*extra, "x" * 3000, "ab" * 2000])]
    got = encode_texts(clash(frame(spark, rows), "ids", "word"), PATH, lexicon_size=40, with_ids=True, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode_texts(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_lexicon_shares_suffixes():
    v = Vocabulary(open(PATH, encoding="utf-8").read())
    stems = ["walk", "talk", "jump", "über", "über\x00"]
    words = [s + e for s in stems for e in ("", "s", "ed", "ing", "ings")]
    compiled = compile_lexicon({w: v.encode(w) for w in words})
    lexicon = Lexicon(compiled)
    assert all(lexicon.get(w.encode()) == v.encode(w) for w in words)
    assert all(lexicon.get(w.encode()) is None for w in ("", "wal", "walkx", "ing", "übe"))
    assert Lexicon(compile_lexicon({})).get(b"a") is None


# --- language model ---------------------------------------------------------------------


def test_brown_lm(spark):
    rows = documents() + [(4000 + i, f"the cat{i % 4} sat on the mat{i % 3} . Rare{i}", None, None, None) for i in range(80)]
    df = clash(frame(spark, rows), "n", "word")
    train = ~held_out(folds=10)
    model, words = fit(df.filter(train), exchange_words=12, classes=3, head_words=30)
    got = score_texts(df, model, words).collect()
    known = Counter()
    is_train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    for i, t, *_ in rows:
        if is_train(i):
            known.update([*tokens(t), b" end"])
    n, v = sum(known.values()), len(known)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    want = Counter()
    for i, t, *_ in rows:
        toks = [*tokens(t), b" end"]
        base = sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        want[i, len(toks), sum(known[w] > 0 for w in toks), round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    mine = [r for r in got if r.doc_id is not None and r.doc_id >= 4000 and not is_train(r.doc_id)]
    assert mine and sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_brown_lm_is_a_distribution(spark):
    rows = [(i, f"a b c{i % 3} d e{i % 5}.", None, None, None) for i in range(40)]
    df = frame(spark, rows)
    model, _ = fit(df, exchange_words=4, classes=2, head_words=8)
    assert np.allclose((10**model.transition).sum(1), 1)
    for c in set(model.classes.values()):
        assert sum(10 ** model.emission[w] for w, k in model.classes.items() if k == c) == pytest.approx(1)


def test_brown_lm_words_and_one_unseen_sum_to_one_at_most(spark):
    """After every class: all words seen, the end, and one word of each shape not seen; the mass of these is that of words seen once."""
    rows = [(i, f"the cat{i % 7} sat on mat{i % 3} . rare{i} " + "x" * (i % 19 + 1), None, None, None) for i in range(60)]
    df = frame(spark, rows)
    model, words = fit(df, exchange_words=6, classes=3, head_words=20)
    table = [(bytes(r["word"]), r["n"], r["class"]) for r in words.collect()]
    total = Counter()
    for _, n, c in table:
        total[c] += n
    step = 10**model.transition
    assert np.allclose(step.sum(1), 1)
    seen = sum(step[:, c] * n / total[c] for _, n, c in table) + step[:, -1]
    one_each = sum(step[:, model.first_shape + s] * 10 ** model.unseen_word[s] for s in range(10))
    assert (seen + one_each <= 1 + 1e-9).all() and (seen + step[:, model.first_shape : -1].sum(1) == pytest.approx(1))
    share = sum(n == 1 for _, n, _ in table) / model.n
    assert step[:, model.first_shape : -1].sum(1).mean() == pytest.approx(share / (1 + share), rel=0.3)


def test_brown_lm_gains_on_known_and_on_unseen_tokens(spark, sf_dir):
    """Held-out texts of the given table: least squares of the gain over the base on the numbers of known and unseen tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = ~held_out(folds=10)
    model, words = fit(docs.filter(train))
    got = score_texts(docs.filter(~train), model, words).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    counts = np.array([(r.n_known, r.n_tokens - r.n_known) for r in got], dtype=float)
    known, unseen = np.linalg.lstsq(counts, np.array([r.score - r.base_score for r in got]), rcond=None)[0]
    assert known > 0 and unseen > 0, (known, unseen)


def test_brown_lm_empty(spark):
    nothing = spark.createDataFrame([], DOCS)
    model, words = fit(nothing)
    assert score_texts(nothing, model, words).collect() == []
    got = score_texts(frame(spark), model, words).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


def test_brown_lm_classes_every_word(spark):
    """Each training word has the exchange class of most likelihood; scores follow from all words' classes."""
    rng = random.Random(8)
    odd = [" ".join(f"u{rng.randrange(40)}{rng.choice(['', '.', 'xxxxx'])}" if rng.random() < 0.6 else rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = documents() + [(5000 + i, t, None, None, None) for i, t in enumerate([*odd, "z z z z", "z z q"])]
    rows += rows[-2:]
    df = clash(frame(spark, rows), "n", "word", "class")
    model, words = fit(df.filter("doc_id % 4 <> 0"), exchange_words=20, classes=4, head_words=60)
    table = {bytes(r["word"]): (r["n"], r["class"]) for r in words.collect()}
    train = [tokens(t) for i, t, *_ in rows if i is not None and i % 4]
    n = Counter(w for t in train for w in t)
    assert {w: x[0] for w, x in table.items()} == n and len(n) > 200
    assert all(0 <= c < model.first_shape == 4 for _, c in table.values())

    f = lambda c: sum(x * math.log(x) for x in c.values() if x)
    pairs = Counter(p for t in train for p in zip([None, *t], [*t, None]))
    start = lambda w: None if w is None else model.classes.get(w, -1 - shape(w))

    def gain(word, c):
        named = lambda w: c if w == word else start(w)
        both, left, right = Counter(), Counter(), Counter()
        for (a, b), k in pairs.items():
            x, y = named(a), named(b)
            both[x, y] += k
            left[x] += k
            right[y] += k
        return f(both) - f(left) - f(right)

    others = [w for w in table if w not in model.classes]
    for w in [b"z", b"q", *rng.sample([w for w in others if n[w] > 1], 20), *rng.sample(others, 20)]:
        if w in others:
            gains = [gain(w, c) for c in range(4)]
            assert gains[table[w][1]] == pytest.approx(max(gains), abs=1e-6)

    size = Counter()
    for k, c in table.values():
        size[c] += k
    k = model.first_shape + 11
    steps = np.zeros((k, k))
    line = lambda t: [k - 1, *[table[w][1] if w in table else 4 + shape(w) for w in t], k - 1]
    for t in train:
        np.add.at(steps, (line(t)[:-1], line(t)[1:]), 1)
    once, twice = (Counter(shape(w) for w, c in n.items() if c == k) for k in (1, 2))
    tokens_of = sum(n.values()) + len(train)
    for x in range(10):  # as likely after any class: tokens of words seen once against all
        steps[:, 4 + x] = 0
    steps[:, 4:14] = steps.sum(1, keepdims=True) * np.array([(once[x] + 0.5) / (tokens_of + 5) for x in range(10)])
    unseen = lambda w: -math.log10(max(1.0, once[shape(w)] ** 2 / (2 * max(twice[shape(w)], 1))))
    prior = (steps.sum(0) + 1) / (steps.sum() + k)
    step = np.log10((steps + 10 * prior) / (steps.sum(1, keepdims=True) + 10))
    assert np.allclose(step, model.transition)
    want = Counter()
    for i, text, *_ in rows:
        t = tokens(text)
        score = step[line(t)[:-1], line(t)[1:]].sum() + sum(math.log10(table[w][0] / size[table[w][1]]) if w in table else unseen(w) for w in t)
        want[i, len(t) + 1, round(score, 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in score_texts(df, model, words).collect()) == want


def test_exchange_finds_classes():
    """Two kinds of words that alternate end up in different classes."""
    counts = np.zeros((7, 7))
    for a in range(3):
        for b in range(3, 6):
            counts[a, b] = counts[b, a] = 10
    of = exchange(counts, 6, 2)

    def likelihood(of):
        pick = np.eye(max(of) + 1)[of]
        f = lambda x: np.sum(x[x > 0] * np.log(x[x > 0]))
        n = pick.T @ counts @ pick
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    for w in range(6):  # no single move gains
        for c in range(2):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(of) + 1e-6
    assert len(set(of[:3])) == len(set(of[3:6])) == 1 and of[0] != of[3]


# --- neighbours -------------------------------------------------------------------------


def brute_nearest(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, x in good:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x.tolist(), y.tolist())), i) for i, y in good if i != q)[:k]
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(scored)}
    return out


def test_nearest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(500, None), (505, [0.0] * 16), (510, [float("nan")] * 16), (515, [None] + [1.0] * 15)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), "score")
    got = nearest(df, __import__("pyspark").sql.functions.col("_id") % 5 == 0, k=7).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_nearest(rows, 7)


def test_nearest_few(spark):
    F = __import__("pyspark").sql.functions
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(few, F.col("_id") % 5 == 0).collect()) == [(0, 1, 5), (0, 2, 6), (5, 1, 0), (5, 2, 6)]
    assert nearest(few.filter("false"), F.col("_id") % 5 == 0).collect() == []


# --- roles ------------------------------------------------------------------------------


def brute_cost(roles):
    """Cheapest repair by search over (turns read, state)."""
    best = {(0, 0): 0}
    todo = [(0, 0, 0)]
    import heapq

    while todo:
        c, i, s = heapq.heappop(todo)
        if best.get((i, s), 1e9) < c:
            continue
        if i == len(roles) and s in FINAL:
            return c
        moves = [(INSERT, i, r + 1) for r in FOLLOWS[s]]
        if i < len(roles):
            for r in range(3):
                label = 0 if roles[i] == ROLES[r] else RELABEL
                if r in FOLLOWS[s]:
                    moves.append((label, i + 1, r + 1))
                if s == r + 1:
                    moves.append((label + MERGE, i + 1, s))
        for extra, j, t in moves:
            if c + extra < best.get((j, t), 1e9):
                best[j, t] = c + extra
                heapq.heappush(todo, (c + extra, j, t))


def test_repair_renders(spark):
    """The rendered text of each kind of repair, and of very many turns."""
    say = lambda r, t: f"<|{r}|>\n{t}"
    cases = {
        1: ([("user", "a"), ("user", "b"), ("assistant", "c")], [say("user", "a\nb"), say("assistant", "c")], 1),
        2: ([("user", "a")], [say("user", "a"), say("assistant", "")], 3),
        3: ([("system", "s"), ("user", "a"), ("tool", None)], [say("system", "s"), say("user", "a"), say("assistant", "")], 2),
        4: ([("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i}") for i in range(300)], [say(*[("user", f"q{i}"), ("assistant", f"a{i}")][i % 2]) for i in range(300)], 0),
        5: ([(None, None)] * 2, [say("user", ""), say("assistant", "")], 4),
    }
    rows = [(c, i, r, t) for c, (turns, _, _) in cases.items() for i, (r, t) in enumerate(turns)]
    got = {r.conv_id: (r.rendered, r.cost) for r in repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment_turns=7).collect()}
    assert got == {c: ("\n".join(parts), cost) for c, (_, parts, cost) in cases.items()}


def test_repair_costs():
    rng = random.Random(9)
    for _ in range(300):
        roles = [rng.choice([*ROLES, "tool", None]) for _ in range(rng.randrange(0, 12))]
        cut = rng.randrange(0, len(roles) + 1)
        whole = best_states([segment_matrix(roles)])[0]
        assert whole == brute_cost(roles) == best_states([segment_matrix(roles[:cut]), segment_matrix(roles[cut:])])[0]


@pytest.mark.parametrize("segment", [2048, 3])
def test_repair(spark, segment):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (3, 0, "system", "s"), (None, 0, None, None), (4, 5, "user", "x"), (4, 2, "user", "y"), (4, 2, "user", "y"), *[(5, i, "user" if i % 2 else "assistant", str(i)) for i in range(20)]]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "cost")
    got = {r.conv_id: r for r in repair(df, segment_turns=segment).collect()}
    assert got[1].rendered == "<|user|>\nhi\n<|assistant|>\nyo" and got[1].cost == 0
    assert (got[2].cost, got[2].n_turns) == (2, 2)
    assert (got[3].cost, got[3].n_out, got[3].n_relabelled, got[3].n_inserted) == (5, 2, 1, 1)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or "", r))
    for c, turns in by.items():
        roles = [t[3] for t in sorted(turns, key=lambda t: t[:3])]
        assert got[c].cost == brute_cost(roles)
        heads = [line for line in got[c].rendered.split("\n") if line.startswith("<|")]
        assert len(heads) == got[c].n_out and heads[-1] == "<|assistant|>"
        assert all(a != b for a, b in zip(heads, heads[1:])) and heads[0] != "<|assistant|>"
    assert repair(df.filter("false")).collect() == []


def test_bpe_merges_a_piece_once(monkeypatch):
    """Words that differ in capitals or in a mark after them share the merges of their piece."""
    import public_tokenizers
    from groundlake.llm import lexicon_bpe as L

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = L.Vocabulary(f.read())
    merged, merge = [], v.merge
    monkeypatch.setattr(v, "merge", lambda piece: merged.append(piece) or merge(piece))
    words = ["zqthorreou", "Zqthorreou", "zqthorreou,", "ZQTHORREOU.", "zqthorreou's"]
    shown = L.Shown(v, 100)
    got = [shown.word(w) for w in words]
    assert merged.count("zqthorreou") == 1
    assert got == [(len(i), " ".join(map(str, i)), v.decode(i)) for i in map(v.encode, words)]


def python_calls(run):
    """How many Python functions and C functions are called by name while ``run()`` runs."""
    import sys

    seen = Counter()

    def note(frame, event, arg):
        if event in ("call", "c_call"):
            seen[frame.f_code.co_name if event == "call" else arg.__name__] += 1

    sys.setprofile(note)
    try:
        run()
    finally:
        sys.setprofile(None)
    return seen


def test_brown_lm_calls_nothing_per_word(spark, monkeypatch):
    """Shapes of words and the rows of equal words are found by arrays, also where batches cut a word's rows."""
    import pyarrow as pa
    from groundlake.llm import brown_lm as B

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "a", f"w{rng.randrange(900)}{'x' * rng.randrange(14)}{rng.choice(['', '.', 'é', '!'])}"]) for _ in range(40)) for _ in range(200)]
    held = {}

    class Table:
        """Stands for the frame: the steps run here, over batches of some rows."""

        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: type("V", (), {"value": x})())})()})()

        def __init__(self, batches):
            self.batches = batches

        def select(self, *_):
            return self

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, c):
            whole = pa.Table.from_batches(self.batches).sort_by(c)
            return Table(whole.to_batches(max_chunksize=7))

        def mapInArrow(self, f, schema):
            return Table([x for x in f(iter(self.batches))])

    def emit(df, make, schema, *, rows=512):
        out = []
        f, end = make()
        for b in df.batches:
            out += [pa.RecordBatch.from_arrays(x, names=[c.name for c in schema]) for x in f(b)]
        return Table(out + [pa.RecordBatch.from_arrays(x, names=[c.name for c in schema]) for x in end()])

    monkeypatch.setattr(B, "emit_rows", emit)
    train = Table([pa.RecordBatch.from_arrays([pa.array(texts[at : at + 50])], names=["text"]) for at in range(0, 200, 50)])
    of = {b"the": 0, b"a": 1}
    table = np.ones((13, 13)) * 5

    def run():
        held["got"] = B.class_words(train, of, table, 2).batches

    calls = python_calls(run)
    want = Counter(w for t in texts for w in tokens(t) if w not in of)
    got = [(w, n) for b in held["got"] for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(got) == len(want) and dict(got) == want
    assert calls["shape"] == 0 and calls["__missing__"] == 0
    words = pa.array([w for w in want], pa.binary())
    assert B.shapes(words).tolist() == [shape(w) for w in want] and B.shapes(words.slice(5, 9)).tolist() == [shape(w) for w in list(want)[5:14]]
    assert B.shapes(pa.array([], pa.binary())).tolist() == []


def test_bpe_looks_first_pairs_up_by_byte():
    """A piece's first pairs come from a table by bytes; of the merges' dictionary only pairs with a merged or last part are asked."""
    from groundlake.llm.lexicon_bpe import Shown, most

    v = Vocabulary(open(PATH, encoding="utf-8").read())
    asked, rng = [], random.Random(2)

    class Asked(dict):
        def get(self, *a):
            asked.append(a[0])
            return super().get(*a)

    pieces = ["".join(rng.choice("abcdeioustrné") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    whole = [v._long([v._first[b] for b in p.encode()[:-1]] + [v._last[p.encode()[-1]]]) for p in pieces]
    v.pairs = Asked(v.pairs)
    assert [v.merge(p) for p in pieces] == whole
    merges = sum(len(p.encode()) - len(ids) for p, ids in zip(pieces, whole))
    assert len(asked) <= 2 * merges + len(pieces)
    assert [Shown(v, 9).ids(x) for x in whole] == [(len(x), " ".join(map(str, x)), v.decode(x)) for x in whole]
    seen = Counter(rng.choice(pieces) for _ in range(900))
    assert all(most(seen, k) == seen.most_common(k) for k in (1, 20, 1000))
