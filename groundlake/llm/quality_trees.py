"""Quality of texts by histogram gradient-boosted trees over document statistics.

A text becomes some thirty numbers (:data:`STATISTICS`); each is cut into bins at
quantiles of the training rows, trees are grown leaf by leaf on sums per bin, and the
finished trees lie in flat arrays through which a batch of rows is sent at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_columns, without

#: What is known of a text; shares are of bytes, words or lines.
STATISTICS = [
    "log_bytes",
    "log_words",
    "log_lines",
    "word_length",
    "word_length_spread",
    "long_words",
    "short_words",
    "distinct_words",
    "top_word",
    "line_words",
    "line_words_spread",
    "repeated_lines",
    "empty_lines",
    "short_lines",
    "lower",
    "upper",
    "digits",
    "blanks",
    "high_bytes",
    "controls",
    "sentence_marks",
    "pauses",
    "quotes_brackets",
    "symbols",
    "top_symbol",
    "symbol_words",
    "upper_words",
    "digit_words",
    "bar_words",
    "sentence_words",
    "byte_entropy",
    "repeated_pairs",
]

_SPACE = b" \t\n\x0b\x0c\r"
_SETS = {"lower": range(97, 123), "upper": range(65, 91), "digits": range(48, 58), "blanks": _SPACE, "high_bytes": range(128, 256), "sentence_marks": b".!?", "pauses": b",;:", "quotes_brackets": b"\"'()[]{}<>"}
_SETS["controls"] = [b for b in [*range(32), 127] if b not in _SPACE]
_SETS["symbols"] = [b for b in range(33, 127) if not any(b in _SETS[k] for k in ("lower", "upper", "digits", "sentence_marks", "pauses", "quotes_brackets"))]
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}


def statistics(text: str | None) -> list[float]:
    """The numbers of :data:`STATISTICS` of a whole text; a null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if size else np.zeros(256, dtype=np.int64)
    share = {k: float(seen[m].sum()) / max(size, 1) for k, m in _MASKS.items()}
    words, lines = raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    place = dict.fromkeys(words)
    for i, w in enumerate(place):
        place[w] = i
    code = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    often = np.bincount(code) if len(words) else np.zeros(1, dtype=np.int64)
    distinct = list(place)
    of_word = lambda f: float(often[np.fromiter(map(f, distinct), dtype=bool, count=len(distinct))].sum()) / n if distinct else 0.0
    pairs = code[:-1] * len(distinct) + code[1:]
    line_words = np.array([len(x.split()) for x in lines])
    full = [x for x in lines if x.strip()]
    symbol = np.where(_MASKS["symbols"] | _MASKS["sentence_marks"], seen, 0)
    p = seen[seen > 0] / max(size, 1)
    return [
        float(np.log1p(size)),
        float(np.log1p(len(words))),
        float(np.log1p(len(lines))),
        float(length.mean()) if len(words) else 0.0,
        float(length.std()) if len(words) else 0.0,
        float((length > 12).mean()) if len(words) else 0.0,
        float((length < 3).mean()) if len(words) else 0.0,
        len(distinct) / n,
        float(often.max()) / n,
        float(line_words.mean()),
        float(line_words.std()),
        1.0 - len(set(full)) / len(full) if full else 0.0,
        1.0 - len(full) / len(lines),
        float((line_words < 4).mean()),
        *[share[k] for k in ("lower", "upper", "digits", "blanks", "high_bytes", "controls", "sentence_marks", "pauses", "quotes_brackets", "symbols")],
        float(symbol.max()) / max(size, 1),
        of_word(lambda w: not w[-1:].isalnum() and w[-1] < 128),
        of_word(lambda w: w.isupper() and len(w) > 1),
        of_word(lambda w: w.isdigit()),
        of_word(lambda w: w in (b"|", b"-", b"*", b"#")),
        float(sum(x in b".!?" for x in (w[-1] for w in words))) / n,
        float(-(p * np.log2(p)).sum()) if size else 0.0,
        1.0 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
    ]


class Trees:
    """Boosted trees as arrays: node i tests ``row[feature[i]] <= cut[i]``, goes to ``left[i]`` or the node after it; a leaf points at itself."""

    def __init__(self, base: float, roots: list[int], feature: list[int], cut: list[float], left: list[int], value: list[float], depth: int):
        self.base, self.depth = base, depth
        self.roots, self.feature, self.left = (np.array(x, dtype=np.int32) for x in (roots, feature, left))
        self.cut, self.value = np.array(cut, dtype=np.float64), np.array(value, dtype=np.float64)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all trees of all rows go down a level at a time."""
        if not len(rows):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        mine = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            inner = self.left[at] != at
            right = rows[mine, self.feature[at]] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(rows: np.ndarray, labels: np.ndarray, *, trees: int = 80, leaves: int = 12, bins: int = 64, rate: float = 0.15, least: int = 8, penalty: float = 1.0) -> Trees:
    """Boosting on log loss. Best leaf first; sums per bin of the larger child are its parent's less its brother's.

    One label only, or no row: a constant near it. Results depend on the rows' values, not
    their order up to rounding.
    """
    n, known = rows.shape[0], labels.astype(np.float64)
    rate_of_ones = (known.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    roots, feature, cut, left, value, deepest = [], [], [], [], [], 0
    if n < 2 * least or known.min() == known.max():
        return Trees(base, roots, feature, cut, left, value, deepest)
    wide = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, j], np.arange(1, bins) / bins)) for j in range(wide)]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(wide) * bins
    raw = np.full(n, base)

    def sums(at: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        cells = flat[at].ravel()
        return np.stack([np.bincount(cells, np.repeat(w, wide), wide * bins) for w in (g[at], h[at], np.ones(len(at)))]).reshape(3, wide, bins)

    def best(found: np.ndarray) -> tuple[float, int, int]:
        upto = found.cumsum(axis=2)[:, :, :-1]
        whole = found[:, :1].sum(axis=2, keepdims=True)
        rest = whole - upto
        gain = upto[0] ** 2 / (upto[1] + penalty) + rest[0] ** 2 / (rest[1] + penalty) - whole[0] ** 2 / (whole[1] + penalty)
        gain = np.where((upto[2] >= least) & (rest[2] >= least), gain, 0.0)
        for j, e in enumerate(edges):
            gain[j, len(e) :] = 0.0
        spot = int(gain.argmax())
        return float(gain.flat[spot]), spot // (bins - 1), spot % (bins - 1)

    def leaf(found: np.ndarray) -> int:
        g, h, _ = found[:, 0].sum(axis=1)
        feature.append(0), cut.append(0.0), left.append(len(left)), value.append(float(-rate * g / (h + penalty)))
        return len(left) - 1

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = p - known, p * (1 - p)
        every = np.arange(n)
        found = sums(every, g, h)
        root = leaf(found)
        roots.append(root)
        open_leaves = [(best(found), root, every, found, 0)]
        while len(open_leaves) < leaves:
            k = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0][0])
            (gain, j, b), node, at, found, depth = open_leaves[k]
            if gain <= 1e-9:
                break
            low = binned[at, j] <= b
            sides = [at[low], at[~low]]
            small = int(len(sides[1]) < len(sides[0]))
            held = [None, None]
            held[small] = sums(sides[small], g, h)
            held[1 - small] = found - held[small]
            kids = [leaf(x) for x in held]
            feature[node], cut[node], left[node] = j, float(edges[j][b]), kids[0]
            open_leaves.pop(k)
            open_leaves += [(best(held[s]), kids[s], sides[s], held[s], depth + 1) for s in (0, 1)]
            deepest = max(deepest, depth + 1)
        for _, node, at, _, _ in open_leaves:
            raw[at] += value[node]
    return Trees(base, roots, feature, cut, left, value, deepest)


def with_statistics(docs: DataFrame, name: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with an array of the text's statistics."""

    def make():
        def f(batch):
            return [pa.array([statistics(t) for t in column(batch, text_col)], pa.list_(pa.float64()))]

        return f

    return map_columns(docs, make, [T.StructField(name, T.ArrayType(T.DoubleType()))], docs.columns)


def fit_quality(docs: DataFrame, labels: DataFrame, *, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees:
    """Trees from a bounded sample of the labelled documents.

    ``most`` is the expected number of labels sampled (all where there are fewer), chosen by
    a hash of the id; only these ids are broadcast, and no text is shuffled. Null ids and
    labels teach nothing; labels above 0 count as 1; an id that occurs more than once
    brings each of its texts with each of its labels.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    sample = known if n <= most else known.filter(draw < most / n)
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").drop("id")
    got = with_statistics(taught, "x").select("label", "x").collect()
    got.sort(key=lambda r: (r["label"], r["x"]))  # sums in one order, however the rows came
    rows = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(STATISTICS))
    return fit_trees(rows, np.array([r["label"] for r in got], dtype=np.int64), **options)


def score_quality(docs: DataFrame, trees: Trees, *, bound: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``bound`` on).

    Whole texts; a null is the empty text, which has a score like any other. Equal texts
    have equal scores. Columns of these names are replaced, others stay. The trees (some
    thousand numbers) are broadcast.
    """
    docs = without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        t = shared.value

        def f(batch):
            rows = np.array([statistics(x) for x in column(batch, text_col)], dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            p = t.score(rows)
            return [pa.array(p, pa.float64()), pa.array((p >= bound).astype(np.int32), pa.int32())]

        return f

    return map_columns(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], docs.columns)

