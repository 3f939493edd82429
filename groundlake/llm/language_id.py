"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams, most frequent
first. A document's own list is compared with every profile: each n-gram adds how far
out of place it is, a missing one adds the most; the nearest profile names the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, id_crc, map_columns, unused, without

UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_alpha: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters, as a table; made once per process."""
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _alpha


def grams(text: str | None, longest: int) -> np.ndarray:
    """Hashes of all n-grams (n up to ``longest``) of the padded lower-case words of a text.

    Anything but letters separates words; an n-gram may begin or end with the blank
    around a word, not contain it. No letters: no n-grams.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = letters()[points]
    if not word.any():
        return np.zeros(0, dtype=np.uint64)
    keep = word.copy()
    keep[1:] |= word[:-1]
    line = np.where(word, points, 32)[keep].astype(np.uint64)
    if line[0] != 32:
        line = np.concatenate(([np.uint64(32)], line))
    if line[-1] != 32:
        line = np.concatenate((line, [np.uint64(32)]))
    blank = line == 32
    out, h, clear = [], line, np.ones(len(line), dtype=bool)
    out.append(line[~blank] * _P)
    for n in range(2, longest + 1):
        if len(line) < n:
            break
        if n > 2:  # what is now inside must not be a blank
            clear = clear[:-1] & ~blank[n - 2 : len(blank) - 1]
        else:
            clear = clear[:-1]
        h = h[:-1] * _P + line[n - 1 :]
        out.append((h * _P + np.uint64(n))[clear])
    return np.concatenate(out)


def ranked(found: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent of the hashes, ties to the smaller hash."""
    values, counts = np.unique(found, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranked n-grams of all languages, ready to be compared with documents."""

    def __init__(self, lists: dict[str, list[int]], size: int, longest: int):
        self.names = sorted(lists)
        self.size, self.longest = size, longest
        every = sorted({g for x in lists.values() for g in x})
        self.every = np.array(every, dtype=np.uint64)
        place = {g: i for i, g in enumerate(every)}
        self.rank = np.full((len(self.names), len(every) + 1), -1, dtype=np.int32)
        for row, name in enumerate(self.names):
            for r, g in enumerate(lists[name]):
                self.rank[row, place[g]] = r

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest distance; ties to the first name."""
        found = grams(text, self.longest)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(found, self.size)
        at = np.searchsorted(self.every, own)
        at[(at == len(self.every)) | (self.every[np.minimum(at, len(self.every) - 1)] != own)] = len(self.every)
        rank = self.rank[:, at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own), dtype=np.int32)))
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return self.names[best], float(1.0 - total[best] / (len(own) * self.size))


def fit_profiles(docs: DataFrame, *, per_language: int = 1000, size: int = 300, longest: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from a bounded sample of the labelled rows of ``docs``.

    ``per_language`` is the expected number of rows sampled per language (all rows where
    there are fewer), chosen by a hash of the id: a filter, not a shuffle. Rows without
    text or label teach nothing.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    share = {r["_lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Profiles({}, size, longest)
    draw = F.pmod(F.xxhash64("_id", F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = known.filter(draw < wanted[F.col("_lang")])

    def make():
        def f(batch):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(column(batch, "_lang"), column(batch, "_text")):
                by.setdefault(lang, []).append(grams(text, longest))
            for lang, parts in by.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))]

        return f, None

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    counts = emit_rows(sample.select("_lang", "_text"), make, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram"))
    top = counts.withColumn("r", place).filter(F.col("r") <= size).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: r["r"]):
        lists.setdefault(r["lang"], []).append(r["gram"] & (2**64 - 1))
    return Profiles(lists, size, longest)


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    Every whole text is compared; a null text, or one without letters, is ``und`` with
    score 0, and so is everything where no profile was learned. Columns of these names
    are replaced, others stay. The profiles (300 numbers a language) are broadcast.
    """
    docs = without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        p = shared.value

        def f(batch):
            got = [p.nearest(t) for t in column(batch, text_col)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return f

    return map_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], docs.columns)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == 0


def drop_unidentified(docs: DataFrame, *, lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` less those in which no language can be told; a null label becomes the language told.

    Columns and given labels are unchanged.
    """
    profiles = fit_profiles(docs.filter(~held_out()), lang_col=lang_col, **options)
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    names = dict(zip(clash, unused(docs, *clash)))
    told = identify(docs.withColumnsRenamed(names), profiles, text_col=options.get("text_col", "text")).filter(F.col("lang_pred") != UNKNOWN)
    given = {c: F.col(f"`{names.get(c, c)}`") for c in docs.columns}
    return told.select(*[(F.coalesce(x, "lang_pred") if c == lang_col else x).alias(c) for c, x in given.items()])
