"""Citations in answers: extraction, validation, corrections (CIT-1 to CIT-4, JN-9, SET-1/4, PRM-3)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import bare_id, is_id, is_paper_id, normalize_id, strip


#: The inside of an innermost bracket, and what separates ids in it.
BRACKET, SEPARATOR = r"\[([^\[\]]+)\]", "[,;]"


def cited_ids(answer: str) -> list[str]:
    """``extract_citations`` of one text, on the driver or in a Python stage."""
    parts = [t for inner in re.findall(BRACKET, answer) for t in re.split(SEPARATOR, inner)]
    return list(dict.fromkeys(bare_id(t) for t in parts if is_id(t)))


def extract_citations(answer: Column) -> Column:
    """Canonical ids cited in innermost brackets, in order of first appearance."""
    inner = F.regexp_extract_all(answer, F.lit(BRACKET), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda x: F.split(x, SEPARATOR)))
    return F.array_distinct(F.transform(F.filter(parts, is_paper_id), lambda t: normalize_id(strip(t))))


def outside_marker(answer: Column) -> Column:
    return answer.rlike(r"(?i)outside\s+(the\s+)?corpus")


def canonical(ids: Column) -> Column:
    """Distinct canonical ids, sorted."""
    return F.array_sort(F.array_distinct(F.transform(ids, normalize_id)))


def validation(answer: Column, retrieved: Column, expected: Column | None = None) -> Column:
    """How an answer's citations stand to what was retrieved, and to what was expected.

    A null ``expected`` leaves the recall fields null, and so does an empty one: nothing
    could be recalled. The first means that nothing is known, the second that a right
    answer cites nothing; ``expected_ids`` tells them apart.
    """
    cited, given = extract_citations(answer), canonical(retrieved)
    invalid = F.array_sort(F.array_except(cited, given))
    fields = [
        cited.alias("cited_ids"),
        F.size(cited).alias("n_cited"),
        F.array_sort(F.array_intersect(cited, given)).alias("valid_citations"),
        invalid.alias("invalid_citations"),
        F.size(invalid).alias("n_invalid"),
        (F.size(invalid) > 0).alias("grounding_violation"),
        (F.size(cited) == 0).alias("uncited"),
        outside_marker(answer).alias("marked_outside_corpus"),
    ]
    if expected is not None:
        wanted = canonical(expected)
        some = F.size(wanted) > 0
        cites = F.array_sort(F.array_intersect(cited, wanted))
        found = F.size(F.array_intersect(given, wanted))
        share = lambda n: F.when(some, n / F.size(wanted))
        fields += [
            wanted.alias("expected_ids"),
            F.when(some, cites).alias("cites_expected"),
            share(F.size(cites)).alias("expected_citation_recall"),
            share(found).alias("retrieval_recall"),
            F.when(some, found > 0).alias("retrieval_hit"),
        ]
    return F.struct(*fields)


def allowed_list(retrieved: Column) -> Column:
    """Retrieved ids, distinct and sorted, as text; ``(none)`` where there are none."""
    ids = F.array_sort(F.array_distinct(retrieved))
    return F.when(F.size(ids) == 0, F.lit("(none)")).otherwise(F.array_join(ids, ", "))


CORRECTION = "The answer cites %s, which %s not among the passages given. Cite these ids only: %s. Rewrite the answer; leave out what the passages do not support."


def correction(invalid: Column, retrieved: Column) -> Column:
    """What a generator is told after an answer with ids that were not retrieved."""
    verb = F.when(F.size(invalid) == 1, F.lit("is")).otherwise(F.lit("are"))
    return F.format_string(CORRECTION, F.array_join(invalid, ", "), verb, allowed_list(retrieved))


def correction_text(invalid: list[str], retrieved: list[str]) -> str:
    """``correction`` of one answer."""
    return CORRECTION % (", ".join(invalid), "is" if len(invalid) == 1 else "are", ", ".join(sorted(set(retrieved))) or "(none)")
