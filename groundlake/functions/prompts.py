"""Passages, prompts and report lines as text (AGG-8, FMT-1 to FMT-4, PRJ-4, PRM-1/2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "Answer from the passages given and from nothing else. Cite each claim by the passage ids in square brackets. Where the passages do not suffice, say so. Mark anything beyond them [outside corpus]."
CLOSED_BOOK_SYSTEM = "Answer from your own knowledge as precisely as you can. Cite the papers each claim rests on by id or title. Say so where you do not know."
ASK_RAG = "Answer the question from these passages only and cite each claim."
ASK_CLOSED = "Answer the question and cite the papers each claim rests on."


def decimals(value: Column, places: int) -> Column:
    """A fraction as C and Python print it: the stored binary value is rounded, exact halves to even."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places))


def passage(rank: Column, score: Column, title: Column, paper_id: Column, year: Column, text: Column) -> Column:
    return F.format_string("--- Passage %d (sim=%s) ---\nTitle: %s\nID: %s (%s)\nText:\n%s\n", rank, decimals(score, 3), title, paper_id, year, text)


def joined_passages(rank: Column, text: Column) -> Column:
    """Aggregate: passages in the order of their ranks, whatever order they arrive in."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text.alias("text")))), lambda s: s["text"]), "\n")


def rag_prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit("<question>\n"), question, F.lit("\n</question>\n\n<passages>\n"), passages, F.lit("\n</passages>\n\n" + ASK_RAG))


def closed_prompt(question: Column) -> Column:
    return F.concat(F.lit("<question>\n"), question, F.lit("\n</question>\n\n" + ASK_CLOSED))


def cell(value: Column, number: bool = False) -> Column:
    """A table cell: a dash for null, two decimals for a fraction."""
    return F.coalesce(decimals(value, 2) if number else value.cast("string"), F.lit("—"))


def hit_line(rank: Column, score: Column, paper_id: Column, year: Column, title: Column, text: Column) -> Column:
    """One search hit as Markdown."""
    return F.format_string("**%d. `%s` · [%s](https://arxiv.org/abs/%s) (%s)** — %s  \n> %s…\n", rank, decimals(score, 3), paper_id, paper_id, year, title, text)
