"""The identifier domain: grammar, canonical forms, years, categories, author predicates.

Covers FLT-1/2/7/9/10/12, ID-1 to ID-5, ID-11 and DT-1/2 of the operator inventory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier grammar, matched against a trimmed token of its own case.
MODERN = r"\d{4}\.\d{4,5}"
LEGACY = r"[a-z][a-z-]*(\.[A-Z]{2})?/\d{7}"
SYNTHETIC = r"inspire:\d+"
ID_PATTERN = rf"^(({MODERN})|({LEGACY})|({SYNTHETIC}))(v\d+)?\z"
SYNTHETIC_PREFIX = "inspire:"

# The subject whitelist, whole categories and archives whose parts all pass.
CATEGORIES = ["hep-th", "hep-ph", "hep-lat", "math-ph", "gr-qc", "nucl-th", "cond-mat", "quant-ph", "math.AG", "math.QA", "math.SG", "math.GT", "math.DG", "math.RT", "math.CT", "math.AT", "math.NT"]
ARCHIVES = ["hep-th", "hep-ph", "hep-lat", "math-ph", "gr-qc", "nucl-th", "cond-mat", "quant-ph"]


def strip(text: Column) -> Column:
    """White space of every kind off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def normalize_id(paper_id: Column) -> Column:
    """Comparable form: stripped, lower case, no version."""
    return F.regexp_replace(F.lower(strip(paper_id)), r"v\d+\z", "")


def strip_version(paper_id: Column) -> Column:
    """The id without its version, case kept."""
    return F.regexp_replace(paper_id, r"v\d+\z", "")


def is_id(token: str) -> bool:
    """``is_paper_id`` of one text."""
    return re.match(ID_PATTERN.replace(r"\z", r"\Z"), token.strip()) is not None


def bare_id(paper_id: str) -> str:
    """``normalize_id`` of one text."""
    return re.sub(r"v\d+\Z", "", paper_id.strip().lower())


def is_paper_id(token: Column) -> Column:
    return strip(token).rlike(ID_PATTERN)


def is_public(paper_id: Column, prefix: str = SYNTHETIC_PREFIX) -> Column:
    return ~paper_id.startswith(prefix)


def safe_name(paper_id: Column) -> Column:
    """The id as a file name."""
    return F.translate(paper_id, "/:", "__")


def chunk_id(paper_id: Column, index: Column) -> Column:
    """Safe id and three digits or more (``lpad`` would cut longer numbers)."""
    return F.format_string("%s_%03d", safe_name(paper_id), index)


def valid_year(year: Column) -> Column:
    return F.coalesce(year, F.lit("")).rlike(r"^(19|20)[0-9]{2}\z")


def year_from_id(paper_id: Column) -> Column:
    """Year by the two digits of a legacy or modern id; text throughout, null elsewhere."""
    two = F.when(paper_id.contains("/"), F.substring(F.element_at(F.split(paper_id, "/"), -1), 1, 2)).otherwise(F.substring(paper_id, 1, 2))
    return F.when(two.rlike(r"^\d{2}\z"), F.concat(F.when(two.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), two))


def year_of(published: Column) -> Column:
    """Year text of an ISO date; it may be ``????`` and is never cast."""
    return F.substring(published, 1, 4)


def dated(year: Column) -> Column:
    """The approximate timestamp text of a year."""
    return F.concat(year, F.lit("-01-01T00:00:00"))


def author_in(authors: Column, names: list[str]) -> Column:
    """Whether any author, trimmed, is exactly one of ``names``."""
    return F.coalesce(F.exists(authors, lambda a: strip(a).isin(names)), F.lit(False))


def author_contains(authors: Column, part: str) -> Column:
    return F.coalesce(F.exists(authors, lambda a: F.lower(a).contains(part.lower())), F.lit(False))


def category_ok(category: Column, categories: list[str] = CATEGORIES, archives: list[str] = ARCHIVES) -> Column:
    """Whole category whitelisted, or its archive (the text before the first dot)."""
    return category.isin(categories) | F.split_part(category, F.lit("."), F.lit(1)).isin(archives)


def corpus_id(eprint: Column, recid: Column, canonical: Column) -> Column:
    """Eprint, else synthetic id, else the canonical fallback."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(eprint), F.concat(F.lit(SYNTHETIC_PREFIX), some(recid)), canonical)
