"""Titles to paper ids by similarity, year-aware (JN-5, SRT-2, TXT-13 to TXT-15, AGG-7, OPS-6).

Exact best matches without matching a title with all papers: equal titles, then the best of
a small sample of the papers, then of a larger one, give it a third-best score to beat; the
papers lie in blocks of about equal length, of which only those meet the title whose lengths
can beat that score; in a block counts of letters, then a longest common subsequence, bound
the similarity from above, and only pairs whose bound passes are matched. Equal titles are
bounded and matched once, whatever their years.
"""

from __future__ import annotations

import uuid
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import is_paper_id
from ..functions.titles import HIGH, adjusted, band, normalize_title, split_year
from ..storage import written

#: Each round meets so many times the titles of those before it; the first has that many at least.
#: Neither changes a result: a round only gives the next one scores to beat.
ROUND, FEWEST = 16, 1000

#: Titles and letters of a block at most, about; titles asked for that meet it at once, about, in so many shares at least.
BLOCK_ROWS, BLOCK_LETTERS, SHARE_ROWS, SHARES = 16_384, 1_000_000, 2048, 8

#: Partitions of a round at most; each then holds several blocks, one after the other.
MOST_TASKS = 4096

#: Length classes an octave, and what agreement of years may add.
CLASSES, NUDGE = 2, 0.05

#: Letters beyond which a common subsequence costs more than it saves, titles advanced at once, and letters in a word of theirs.
LONGEST, ABREAST, WORD = 640, 8192, 63

#: Letters from which on the matcher leaves out frequent ones, pairs matched in one go, and pairs kept until many titles' best are matched together.
JUNK, PAIRS, WAITING = 200, 1024, 2_000_000

_SYMBOLS = np.full(256, 37, dtype=np.uint8)
_SYMBOLS[np.frombuffer(b" abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = np.arange(37)
#: The same, but for what fills the second of two texts.
_MARKED = _SYMBOLS.copy()
_MARKED[1] = 38


def papers_of(index: DataFrame) -> DataFrame:
    """One row per paper, its first chunk's fields: ``paper_id, title, year, norm``."""
    first = index.groupBy("paper_id").agg(F.min_by(F.struct("title", "year"), "chunk_idx").alias("f"))
    return first.select("paper_id", "f.title", "f.year", normalize_title(F.coalesce("f.title", F.lit(""))).alias("norm"))


def similarity(a: str, b: str) -> float:
    """Ratio of longest matching blocks; not symmetric, ``a`` is the title asked for."""
    return SequenceMatcher(None, a, b).ratio()


def padded(texts: list[str], fill: int) -> np.ndarray:
    """The bytes of ASCII texts, a text a row."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), size.max(initial=0)), fill, dtype=np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    return out


def longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of the longest common block of each pair (a column of either) and its starts: the first in ``a``, then in ``b``."""
    held, new = np.zeros((2, len(b) + 1, b.shape[1]), dtype=np.uint8)
    same = np.empty(b.shape, dtype=bool)
    best = np.zeros(b.shape[1], dtype=np.uint8)
    at_a, at_b = np.zeros((2, b.shape[1]), dtype=np.int64)
    for i in range(len(a)):
        np.equal(b, a[i], out=same)
        np.add(held[:-1], 1, out=new[1:])
        np.multiply(new[1:], same.view(np.uint8), out=new[1:])
        most = new.max(axis=0)
        up = np.flatnonzero(most > best)
        if len(up):
            best[up] = size = most[up]
            at_a[up] = i + 1 - size.astype(np.int64)
            at_b[up] = new[:, up].argmax(axis=0) - size.astype(np.int64)
        held, new = new, held
    return best.astype(np.int64), at_a, at_b


def stretches(text: np.ndarray, pair: np.ndarray, start: np.ndarray, end: np.ndarray, fill: int) -> np.ndarray:
    """The letters of a part of each text, a part a column, ``fill`` beyond its end."""
    i = np.arange((end - start).max(initial=0))[:, None] + start
    return np.where(i < end, text[pair, np.minimum(i, text.shape[1] - 1)], np.uint8(fill))


def most_common(left: np.ndarray, right: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What stretches of normal texts can share at most: their longest common subsequence, if one side has 64 letters or less."""
    pair, a0, a1, b0, b1 = parts
    found = np.minimum(a1 - a0, b1 - b0)
    first, second = (left, a0, a1, 0), (right, b0, b1, 1)
    for own, (x, x0, x1, x_fill), (y, y0, y1, y_fill) in ((a1 - a0 <= b1 - b0, first, second), (a1 - a0 > b1 - b0, second, first)):
        own = np.flatnonzero(own & (found <= 64))
        own = own[np.argsort((y1 - y0)[own], kind="stable")]
        for at in (own[n : n + PAIRS] for n in range(0, len(own), PAIRS)):
            short, long = stretches(x, pair[at], x0[at], x1[at], x_fill), stretches(y, pair[at], y0[at], y1[at], y_fill)
            column = np.arange(len(at))
            # fills differ and meet nothing
            marks = np.zeros((39, len(at)), dtype=np.uint64)
            for i, row in enumerate(_MARKED[short]):
                marks[row, column] |= np.uint64(1 << i)
            marks[37:] = 0
            v = np.full(len(at), np.uint64(2**64 - 1))
            for place in _MARKED[long].astype(np.intp) * len(at) + column:
                u = v & marks.ravel()[place]
                v = (v + u) | (v - u)
            found[at] = 64 - np.bitwise_count(v)
    return found


def matched(a: list[str], b: list[str], need: np.ndarray | None = None) -> np.ndarray:
    """Letters in the matching blocks of each pair of ASCII texts, the second under ``JUNK`` letters: those of the matcher.

    A pair of normal texts that cannot have ``need`` of them is left when that is clear, with those found.
    """
    left, right = padded(a, 0), padded(b, 1)
    total = np.zeros(len(a), dtype=np.int64)
    # stretches still to match: pair, from and to in either text
    todo = np.array([np.arange(len(a)), np.zeros(len(a)), [len(x) for x in a], np.zeros(len(a)), [len(x) for x in b]], dtype=np.int64).reshape(5, -1)
    todo = todo[:, (todo[2] > 0) & (todo[4] > 0)]
    while todo.shape[1]:
        todo = todo[:, np.lexsort((todo[4] - todo[3], (todo[2] - todo[1]) // 8))]
        later = []
        for start in range(0, todo.shape[1], PAIRS):
            pair, a0, a1, b0, b1 = todo[:, start : start + PAIRS]
            size, at_a, at_b = longest_blocks(stretches(left, pair, a0, a1, 0), stretches(right, pair, b0, b1, 1))
            np.add.at(total, pair, size)
            at_a, at_b = at_a + a0, at_b + b0
            for sides in ((pair, a0, at_a, b0, at_b), (pair, at_a + size, a1, at_b + size, b1)):
                more = (size > 0) & (sides[1] < sides[2]) & (sides[3] < sides[4])
                later.append(np.array(sides)[:, more])
        todo = np.concatenate(later, axis=1)
        if need is not None and todo.shape[1]:
            for bound in (lambda x: np.minimum(x[2] - x[1], x[4] - x[3]), lambda x: most_common(left, right, x)):
                rest = bound(todo)
                open_ = total + np.bincount(todo[0], weights=rest, minlength=len(total)) >= need
                todo = todo[:, open_[todo[0]] & (rest > 0)]
    return total


def similarities(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """``similarity`` of each pair; short ASCII texts are matched many at a time.

    A pair of normal texts under its ``least`` may have any value under that.
    """
    out = np.ones(len(a))
    short = np.array([len(y) < JUNK and len(x) <= LONGEST and x.isascii() and y.isascii() for x, y in zip(a, b)], dtype=bool)
    at = np.flatnonzero(short)
    for start in range(0, len(at), 16 * PAIRS):
        few = at[start : start + 16 * PAIRS]
        left, right = [a[i] for i in few], [b[i] for i in few]
        size = np.array([len(x) + len(y) for x, y in zip(left, right)])
        need = None if least is None else (least[few] - 1e-9) * size / 2
        out[few] = np.where(size > 0, 2.0 * matched(left, right, need) / np.maximum(size, 1), 1.0)
    m = SequenceMatcher(None)
    # what a matcher knows of its second text serves all titles asked for
    for i in sorted(np.flatnonzero(~short).tolist(), key=lambda i: b[i]):
        if m.b != b[i]:
            m.set_seq2(b[i])
        m.set_seq1(a[i])
        out[i] = m.ratio()
    return out


def common_subsequences(asked: str, norms: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of a normal title with each of many."""
    return subsequences(numbers(asked), places(symbols(norms)))


def numbers(norm: str) -> list[int]:
    """Symbol numbers of a normal title."""
    return _SYMBOLS[np.frombuffer(norm.encode(), dtype=np.uint8)].tolist()


def symbols(norms: list[str]) -> np.ndarray:
    """Symbol numbers of normal titles, a title a column; 37 beyond its end."""
    return np.ascontiguousarray(_SYMBOLS[padded(norms, 0)].T)


def letters(text: np.ndarray) -> np.ndarray:
    """How often each of the 37 symbols occurs in each column of symbol numbers, a symbol a row."""
    n = text.shape[1]
    return np.bincount((text * np.int64(n) + np.arange(n)).ravel(), minlength=38 * n).reshape(38, n)[:37]


def places(text: np.ndarray) -> np.ndarray:
    """Where each symbol stands in each column of symbol numbers, a bit a letter: by symbol, word, column."""
    out = np.zeros((38, max(1, -(-len(text) // WORD)), text.shape[1]), dtype=np.uint64)
    column = np.arange(text.shape[1])
    for i, row in enumerate(text):
        out[row, i // WORD, column] |= np.uint64(1 << i % WORD)
    out[37] = 0
    return out


def subsequences(asked: list[int], marks: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """``common_subsequences`` of symbol numbers with titles in ``places``, all or those ``at``.

    One bit per letter of a title; all titles advance by one letter of ``asked`` at a time.
    """
    tables = {c: marks[c] if at is None else marks[c].take(at, axis=1) for c in set(asked)}
    wide, size = marks.shape[1], marks.shape[2] if at is None else len(at)
    full, top = np.uint64(2**WORD - 1), np.uint64(WORD)
    v = np.full((wide, size), full)
    u, total = np.empty((2, wide, size), dtype=np.uint64)
    carry = np.empty(size, dtype=np.uint64)
    for met in (tables[c] for c in asked):
        np.bitwise_and(v, met, u)
        np.add(v, u, total)
        # a word has a bit to spare, for what goes over to the next one
        for w in range(1, wide):
            np.right_shift(total[w - 1], top, carry)
            np.add(total[w], carry, total[w])
        np.bitwise_xor(v, u, v)
        np.bitwise_or(v, total, v)
        if wide > 1:
            np.bitwise_and(v, full, v)
    # bits beyond a title never meet a letter and stay set
    return WORD * wide - np.bitwise_count(v & full).sum(axis=0, dtype=np.int64)


def size_class(size: Column) -> Column:
    """Length class of a normal title."""
    return F.floor(F.log2(size + 1) * CLASSES).cast("int")


def entries_of(papers: DataFrame, top: int) -> DataFrame:
    """One row per distinct ``norm, year`` with its ``top`` smallest papers: equal titles score alike.

    The group limit keeps ``top`` rows a group in every task, so a title that a third of all
    papers bear is no large group.
    """
    place = F.row_number().over(Window.partitionBy("norm", "year").orderBy("paper_id"))
    few = papers.select("norm", "year", "paper_id", "title").withColumn("_place", place).filter(F.col("_place") <= top)
    return few.groupBy("norm", "year").agg(F.array_sort(F.collect_list(F.struct("paper_id", "title"))).alias("papers"))


def blocks_of(entries: DataFrame, apart: int) -> tuple[DataFrame, DataFrame]:
    """Entries with ``class`` and ``part``, and how many parts each class of lengths has in each round; by length from round ``apart`` on. Equal titles lie together."""
    # the first of several rounds has few titles and hardly a score to beat: they lie together
    marked = entries.withColumn("class", F.when(F.col("round") >= apart, size_class(F.length("norm"))).otherwise(0))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("norm")) / BLOCK_LETTERS, F.lit(1.0))).cast("int")
    # some dozens of rows a round, a few an octave of lengths
    classes = written(marked.groupBy("round", "class").agg(parts.alias("parts")), "titles-classes")
    return marked.join(F.broadcast(classes), ["round", "class"]).withColumn("part", F.pmod(F.xxhash64("norm", F.lit("part")), F.col("parts")).cast("int")).drop("parts"), classes


def scores_to_beat(found: DataFrame, top: int) -> DataFrame:
    """``key, least``: the score of each title's ``top``-th best paper among those found, where there are so many."""
    upto = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("upto", upto).filter(F.col("upto") >= top).groupBy("key").agg(F.max("s").alias("least"))


class Block:
    """Entries of one block by their titles, shorter ones first: lengths, letters, their places, and years."""

    def __init__(self, titles: pd.DataFrame) -> None:
        of, norms = pd.factorize(titles["norm"])
        norms = norms.tolist()
        sizes = np.fromiter(map(len, norms), dtype=np.int64, count=len(norms))
        longer = np.argsort(sizes, kind="stable")
        self.norms, self.sizes = [norms[i] for i in longer], sizes[longer]
        place = np.empty(len(norms), dtype=np.int64)
        place[longer] = np.arange(len(norms))
        self.of, self.copies = place[of], titles["n"].to_numpy()
        # entries of each title
        self.order, self.count = np.argsort(self.of, kind="stable"), np.bincount(self.of, minlength=len(norms))
        self.first = np.cumsum(self.count) - self.count
        self.years = np.array([y if isinstance(y, str) and y else "" for y in titles["year"]], dtype=object)
        self.letters, self.longest = np.zeros((37, len(norms)), dtype=np.int64), int(self.sizes.max(initial=0))
        #: from, to and places of the letters of titles of about one length
        self.runs: list[tuple[int, int, np.ndarray | None]] = []
        start = 0
        while start < len(norms):
            most = max(2 * int(self.sizes[start]), WORD)
            most = min(most, LONGEST) if self.sizes[start] <= LONGEST else most
            end = min(start + ABREAST, int(np.searchsorted(self.sizes, most, side="right")))
            text = symbols(self.norms[start:end])
            self.letters[:, start:end] = letters(text)
            self.runs.append((start, end, places(text) if len(text) <= LONGEST else None))
            start = end
        # the best that agreement of years may add to any entry of a title
        self.other = np.where(np.bincount(self.of, weights=self.years == "", minlength=len(norms)) > 0, 0.0, -NUDGE)
        self.by_year: dict[str, np.ndarray] = {}
        self.least: dict[tuple[int, int, type], np.ndarray] = {}

    def nudge(self, year: str | None) -> np.ndarray:
        """What agreement with ``year`` adds to each title's score at most."""
        key = year if isinstance(year, str) else ""
        if key not in self.by_year:
            self.by_year[key] = most = self.other.copy() if key else np.zeros(len(self.norms))
            most[self.of[self.years == key]] = NUDGE if key else 0.0
        return self.by_year[key]

    def common(self, asked: list[int]) -> np.ndarray:
        """Letters that each title has in common with ``asked`` in any order."""
        kind = np.uint8 if min(len(asked), self.longest) < 256 else np.int32
        total = np.zeros(len(self.norms), dtype=kind)
        for key in ((c, n, kind) for c, n in enumerate(np.bincount(asked, minlength=38)[:37].tolist()) if n):
            if key not in self.least:
                self.least[key] = np.minimum(self.letters[key[0]], key[1]).astype(kind)
            total += self.least[key]
        return total

    def in_order(self, asked: list[int], at: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Letters that the titles ``at``, a rising list, have in common with ``asked`` in their order, or ``common`` where that is dear."""
        common = common[at].astype(np.int64)
        ends = np.searchsorted(at, [end for _, end, _ in self.runs]).tolist()
        for (start, end, marks), first, last in zip(self.runs, [0, *ends], ends):
            if marks is not None and last - first > 8 and len(asked) <= LONGEST:
                few = at[first:last] - start
                some = 3 * len(few) < end - start
                found = subsequences(asked, marks, few if some else None)
                common[first:last] = found if some else found[few]
        return common


def meet(titles: pd.DataFrame, asked: pd.DataFrame, top: int) -> pd.DataFrame:
    """The entries of one block that may be among the ``top`` best of each title: ``qid, at, s``."""
    block = Block(titles)
    of, questions = pd.factorize(asked["q_norm"])
    questions, qids, wanted = questions.tolist(), asked["qid"].tolist(), [y if isinstance(y, str) else None for y in asked["q_year"]]
    floors = asked["least"].to_numpy(dtype=float).copy()
    # rows that ask for each title, by their years
    order, count = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(questions))
    first = np.cumsum(count) - count
    years = np.array([y or "" for y in wanted], dtype=object)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(n: int, share: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By how much titles that share so many letters of both may pass the floor of any row that asks; under 0 none."""
        best = None
        for row in order[first[n] : first[n] + count[n]].tolist():
            over = share + (block.nudge(wanted[row])[at] - (floors[row] - 1e-9))
            best = over if best is None else np.maximum(best, over)
        return best

    def shared(n: int, common: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = block.sizes[at] + float(len(questions[n]))
        if questions[n]:
            return 2.0 * common / total
        return np.where(total > 0, 2.0 * common / np.maximum(total, 1.0), 1.0)

    def candidates(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Titles whose bound reaches a floor, best bound first, and the bounds without years."""
        asked = numbers(questions[n])
        common = block.common(asked)
        at = np.flatnonzero(reach(n, shared(n, common, slice(None)), slice(None)) >= 0)
        bound = shared(n, block.in_order(asked, at, common), at)
        over = reach(n, bound, at)
        best = np.flatnonzero(over >= 0)
        best = best[np.argsort(-over[best], kind="stable")]
        return at[best], bound[best]

    def match(n: np.ndarray, at: np.ndarray, share: np.ndarray) -> None:
        """Scores of entries with titles asked for; raises the floors."""
        ratio = similarities([questions[i] for i in n.tolist()], [block.norms[i] for i in at.tolist()], share)
        # each row that asks with each entry of the title
        times = count[n] * block.count[at]
        pair = np.repeat(np.arange(len(n)), times)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        row = order[first[n[pair]] + within // block.count[at[pair]]]
        entry = block.order[block.first[at[pair]] + within % block.count[at[pair]]]
        a, b = years[row], block.years[entry]
        s = np.minimum(ratio[pair] + np.where((a == "") | (b == ""), 0.0, np.where(a == b, NUDGE, -NUDGE)), 1.0)
        some = np.flatnonzero(s >= floors[row])
        some = some[np.lexsort((-s[some], row[some]))]
        row, entry, s = row[some], entry[some], s[some]
        held = np.cumsum(block.copies[entry])
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        before = np.concatenate([[0], held])[begin]
        enough = held - np.repeat(before, np.diff(begin, append=len(row))) >= top
        np.maximum.at(floors, row[enough], s[enough])
        keep = s >= floors[row]
        out.append((row[keep], entry[keep], s[keep]))

    def settle(found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The best bounds first, then by and by what still reaches a floor."""
        some = top + 1
        while found:
            n = np.repeat([n for n, _, _ in found], [len(at[:some]) for _, at, _ in found])
            at, bound = (np.concatenate([x[i][:some] for x in found]) for i in (1, 2))
            # the least share that reaches the floor of a row
            match(n, at, np.concatenate([b[:some] - reach(n, b[:some], at[:some]) for n, at, b in found]))
            left = [(n, at[some:], bound[some:], reach(n, bound[some:], at[some:]) >= 0) for n, at, bound in found if len(at) > some]
            found = [(n, at[ok], bound[ok]) for n, at, bound, ok in left if ok.any()]
            some *= 4

    waiting, pairs = [], 0
    for n in range(len(questions)):
        at, bound = candidates(n)
        if len(at):
            waiting.append((n, at, bound))
            pairs += len(at)
        if pairs >= WAITING:
            settle(waiting)
            waiting, pairs = [], 0
    if waiting:
        settle(waiting)
    row, at, s = (np.concatenate([x[c] for x in out] or [np.zeros(0)]) for c in range(3))
    row, at = row.astype(int), at.astype(int)
    keep = s >= floors[row]
    return pd.DataFrame({"qid": [qids[i] for i in row[keep].tolist()], "at": at[keep], "s": s[keep].astype(float)})


def resolve(queries: DataFrame, papers: DataFrame, top: int = 3, *, least: float | None = None) -> DataFrame:
    """``qid, rank, paper_id, title, year, score, band``: the best papers of each title.

    ``queries`` has ``qid`` (text) and ``query``; ties go to smaller ids; a null title is
    empty. With ``least``, papers under that score are not looked for. The result is that of
    matching all pairs.
    """
    q = queries.select("qid", split_year(F.coalesce("query", F.lit(""))).alias("s")).select("qid", normalize_title(F.coalesce("s.title", F.lit(""))).alias("q_norm"), F.col("s.year").alias("q_year"))
    # titles asked for that are equal, with their years, are one; the tables are read once
    every = written(q.withColumn("key", F.concat_ws(":", F.coalesce("q_year", F.lit("-")), "q_norm")), "titles-asked")
    asked = written(every.groupBy("key").agg(F.first("q_norm").alias("q_norm"), F.first("q_year").alias("q_year")), "titles-keys")
    entries = written(entries_of(papers, top), "titles")
    number, rounds = entries.count(), 0
    while number // ROUND ** (rounds + 1) >= FEWEST:
        rounds += 1
    shares = max(SHARES, -(-asked.count() // SHARE_ROWS))
    chance, turn = F.pmod(F.xxhash64("norm", F.lit("round")), F.lit(ROUND**rounds)), F.lit(rounds)
    for r in reversed(range(rounds)):
        turn = F.when(chance % ROUND ** (rounds - r) == 0, r).otherwise(turn)
    drawn = entries.select("norm", "year", F.size("papers").alias("n"), turn.cast("int").alias("round"))
    apart = min(rounds, 1)
    blocked, classes = blocks_of(drawn, apart)
    every_class = classes.groupBy("round").agg(F.sum("parts").alias("parts")).collect()
    dealt = {r["round"]: shares if r["round"] >= apart else 4 * shares for r in every_class}
    tasks = {r["round"]: min(MOST_TASKS, 2 * dealt[r["round"]] * r["parts"]) for r in every_class}
    equal = asked.join(drawn.withColumnRenamed("norm", "q_norm"), "q_norm").select("key", F.col("q_norm").alias("norm"), "year", adjusted(F.lit(1.0), F.col("q_year"), F.col("year")).alias("s"), "n", "round")
    met: list[DataFrame] = []
    for r in sorted(tasks):
        # equal titles, and whatever the rounds before found
        known = equal.filter(F.col("round") >= r).drop("round")
        for x in met:
            known = known.unionByName(x)
        floor = F.greatest(F.coalesce("least", F.lit(-1.0)), F.lit(-1.0 if least is None else least))
        now = written(asked.join(scores_to_beat(known, top), "key", "left").withColumn("least", floor), "titles-scores")
        # lengths that can reach the score: the shorter of two sides bounds what they share
        need, size = F.col("least") - NUDGE, F.length("q_norm")
        open_ended = need <= 0.01
        low = F.when(open_ended, F.lit(0)).otherwise(F.floor(size * need / (2 - need)) - 1)
        high = F.when(open_ended, F.lit((1 << 31) - 2)).otherwise(F.ceil(size * (2 - need) / need) + 1)
        spread = F.sequence(size_class(F.greatest(low, F.lit(0))), size_class(high)) if r >= apart else F.array(F.lit(0))
        fields = [F.col("key").alias("qid"), "q_norm", "q_year", "least"]
        sent = now.select(*fields, F.explode(spread).alias("class")).join(F.broadcast(classes.filter(F.col("round") == r)), "class")
        sent = sent.select("qid", "q_norm", "q_year", "least", "class", F.pmod(F.xxhash64("q_norm"), F.lit(dealt[r])).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def both(titles: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            # what meets nothing is not prepared
            got = meet(titles, asked, top) if len(titles) and len(asked) else pd.DataFrame({"qid": [], "at": [], "s": []})
            norm, year, n = titles["norm"].tolist(), titles["year"].tolist(), titles["n"].tolist()
            at = got["at"].astype(int).tolist()
            # plain objects: text columns of several chunks do not go back to Spark
            found = {"key": got["qid"].tolist(), "norm": [norm[i] for i in at], "year": [year[i] for i in at]}
            return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in found.items()} | {"s": got["s"].astype(float), "n": [n[i] for i in at]})

        spot = ["class", "part", "share"]
        lying = blocked.filter(F.col("round") == r).select("class", "part", F.explode(F.sequence(F.lit(0), F.lit(dealt[r] - 1))).alias("share"), "norm", "year", "n")
        # so many tasks whatever their bytes: a block is small and its matching long, and small partitions would be made one
        near = lying.repartition(tasks[r], *spot).groupBy(*spot).cogroup(sent.repartition(tasks[r], *spot).groupBy(*spot)).applyInPandas(both, "key string, norm string, year string, s double, n int")
        met.append(near if r == max(tasks) else written(near, "titles-met"))
    found = met[0] if met else equal.drop("round")
    for x in met[1:]:
        found = found.unionByName(x)
    place = lambda of: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("s"), "paper_id"))
    # an entry has ``top`` papers at most
    named = found.alias("f").join(entries.alias("e"), (F.col("f.norm") == F.col("e.norm")) & F.col("f.year").eqNullSafe(F.col("e.year")))
    named = named.select("key", "s", "f.year", F.explode("papers").alias("p")).select("key", "s", "year", "p.paper_id", "p.title")
    best = named.withColumn("rank", place("key")).filter(F.col("rank") <= top).drop("rank")
    ranked = every.select("qid", "key").join(best, "key").withColumn("rank", place("qid")).filter(F.col("rank") <= top).withColumn("score", F.round("s", 3))
    return ranked.select("qid", "rank", "paper_id", "title", "year", "score", band(F.col("score")).alias("band"))


def resolve_expected(gold: DataFrame, papers: DataFrame) -> DataFrame:
    """``gold`` with titles in ``expected_citations`` replaced by the ids of confident matches.

    Entries that are ids, or match nothing confidently, stay as they are, in order.
    """
    each = gold.select("qid", F.posexplode("expected_citations").alias("pos", "entry"))
    titles = each.filter(~is_paper_id(F.col("entry"))).select(F.concat_ws("#", "qid", "pos").alias("qid"), F.col("entry").alias("query"))
    best = resolve(titles, papers, 1, least=HIGH - 0.001).filter(F.col("score") >= HIGH).select(F.col("qid").alias("key"), "paper_id")
    named = each.withColumn("key", F.concat_ws("#", "qid", "pos")).join(best, "key", "left")
    ids = named.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("paper_id", "entry").alias("id")))), lambda s: s["id"]).alias("ids"))
    out = gold.join(ids, "qid", "left").withColumn("expected_citations", F.coalesce("ids", "expected_citations"))
    return out.select(*gold.columns)


def rewrite_gold(spark: SparkSession, path: str, papers: DataFrame, schema: str) -> bool:
    """Resolves the titles of a gold file in place; whether it changed.

    The file is one of JSON lines that people edit, so its lines keep their order and lines
    without a title to resolve keep their bytes. If no line changes nothing is written. Else
    the new content is written aside by one task, line by line, the old file is kept as ``<path>.old``, and the new one renamed into place.
    """
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    # to the place of a line, as one file read in order gives it
    gold = lines.withColumn("g", F.from_json("value", schema)).select("_line", "value", F.col("_line").cast("string").alias("qid"), F.col("g.expected_citations").alias("expected_citations"))
    known = gold.filter("expected_citations IS NOT NULL")
    done = resolve_expected(known.select("qid", "expected_citations"), papers).withColumnRenamed("expected_citations", "now")
    own = gold.join(done, "qid", "left").withColumn("changed", F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("expected_citations")))
    if not own.filter("changed").take(1):
        return False
    # only the list is replaced; every other character of the line stays
    pattern = r'("expected_citations"\s*:\s*)\[(?:[^\]"]|"(?:\\.|[^"\\])*")*\]'
    start = F.regexp_extract("value", pattern, 0)
    label = F.regexp_extract("value", pattern, 1)
    value = F.when(F.col("changed"), F.replace(F.col("value"), start, F.concat(label, F.to_json("now")))).otherwise(F.col("value"))
    aside = f"{path}.new-{uuid.uuid4().hex}"
    own.select("_line", value.alias("value")).orderBy("_line").coalesce(1).select("value").write.text(aside)
    fs_of = spark._jvm.org.apache.hadoop.fs
    at, old, new = fs_of.Path(path), fs_of.Path(f"{path}.old"), fs_of.Path(aside)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [s.getPath() for s in fs.listStatus(new) if s.getPath().getName().startswith("part-")]
    if fs.exists(old):
        fs.delete(old, False)
    for source, to in ((at, old), (made[0], at)):
        if not fs.rename(source, to):
            raise OSError(f"could not rename {source.toString()}")
    fs.delete(new, True)
    return True


def title_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with ``a, b``, normal titles) and their ``similarity``."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pairs.schema)}, similarity double"

    def run(frames):
        for f in frames:
            yield f.assign(similarity=[similarity(a or "", b or "") for a, b in zip(f["a"], f["b"])])

    return pairs.mapInPandas(run, schema)
