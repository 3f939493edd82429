"""Titles, years in titles, file-name identities (TXT-11, TXT-12, TXT-14/15, ID-6 to ID-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import strip

HIGH, REVIEW = 0.90, 0.60
#: Text before the last year, the year, the rest; brackets round the year are dropped.
LAST_YEAR = r"(?s)^(.*[^(]\(*?|\(*?)\(?\b((?:19|20)[0-9]{2})\b\)?(.*)$"


def normalize_title(title: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, one blank between."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def split_year(query: Column) -> Column:
    """``struct(title, year)``: the last year is taken out of the text, ``(verify)`` dropped."""
    q = strip(F.regexp_replace(query, r"(?i)\(verify\)", ""))
    has = q.rlike(LAST_YEAR)
    rest = strip(F.concat(F.regexp_extract(q, LAST_YEAR, 1), F.regexp_extract(q, LAST_YEAR, 3)))
    return F.struct(F.when(has, rest).otherwise(q).alias("title"), F.when(has, F.regexp_extract(q, LAST_YEAR, 2)).alias("year"))


def adjusted(ratio: Column, wanted: Column, year: Column) -> Column:
    """Similarity nudged by agreement of years, at most 1; used for ranking before rounding."""
    both = wanted.isNotNull() & (F.coalesce(year, F.lit("")) != "")
    return F.least(ratio + F.when(both & (wanted == year), 0.05).when(both, -0.05).otherwise(0.0), F.lit(1.0))


def band(score: Column) -> Column:
    """Confidence of a rounded score."""
    return F.when(score >= HIGH, "confident").when(score >= REVIEW, "review").otherwise("none")


def report_number(stem: Column) -> Column:
    """Seven digits as a report number."""
    return F.when(stem.rlike(r"^\d{7}\z"), F.regexp_replace(stem, r"^(\d{2})(\d{2})(\d{3})\z", "$1-$2-$3"))


def padded_recid(stem: Column) -> Column:
    """The record number of a name that is digits with leading double zero."""
    return F.when(stem.rlike(r"^00\d*\z"), F.coalesce(F.nullif(F.ltrim(stem, F.lit("0")), F.lit("")), F.lit("0")))


def publisher_doi(stem: Column) -> Column:
    """DOI of names whose publisher puts the DOI's tail into them."""
    return F.when(stem.rlike(r"^BF\d+\z"), F.concat(F.lit("10.1007/"), stem)).when(stem.startswith("PhysRev"), F.concat(F.lit("10.1103/"), stem))


def pii(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"^1-s2\.0-(.+)-main\z", 1), F.lit(""))


def pii_dois(item: Column) -> Column:
    """Candidate DOIs of a publisher item id, best first."""
    s = lambda at, n: F.substring(item, at, n)
    exact = F.format_string("10.1016/%s-%s(%s)%s-%s", s(1, 4), s(5, 4), s(9, 2), s(11, 5), s(16, 1))
    raw = F.array(F.concat(F.lit("10.1016/"), item), F.concat(F.lit("10.1006/"), item))
    return F.when(F.length(item) >= 16, F.concat(F.array(exact), raw)).otherwise(raw)


def title_candidate(text: Column) -> Column:
    """The first line that can be a title, cut to 80 characters."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.substring(F.get(F.filter(lines, lambda x: (F.length(x) > 10) & ~x.startswith("%")), F.lit(0)), 1, 80)


def year_from_filename(stem: Column) -> Column:
    """Year by the first two of exactly seven digits, kept as text; empty elsewhere."""
    two = F.substring(stem, 1, 2)
    return F.when(stem.rlike(r"^\d{7}\z"), F.concat(F.when(two.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), two)).otherwise(F.lit(""))
