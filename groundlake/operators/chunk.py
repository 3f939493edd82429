"""Overlapping word windows (TXT-9, PRJ-3, WIN-3, AGG-9, ID-4, FLT-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunk_id, strip_version, year_of
from ..functions.text import tokens

WORDS, OVERLAP, LEAST_WORDS = 450, 60, 50


def chunk_count(words: Column, window: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Windows needed to reach the end of so many words; none for none."""
    step = window - overlap
    return F.when(words <= 0, 0).when(words <= window, 1).otherwise(F.ceil((words - window) / F.lit(step)).cast("int") + 1)


def chunk_text(text: Column, window: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Array of chunk texts. The words are bound by a lambda, so that a text is split once and not per window."""
    step = window - overlap

    def cut(words):
        n = chunk_count(F.size(words), window, overlap)
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, (i * step + 1).cast("int"), F.lit(window)), " "))
        return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(tokens(text)), cut), F.lit(0))


def chunk_papers(papers: DataFrame, *, text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Chunk rows of papers (``paper_id, title, published, primary_category, text``).

    Papers under ``least_words`` words give no chunks. Nothing is shuffled: a paper's
    windows come from its own row.
    """
    words = F.size(tokens(F.col(text_col)))
    known = papers.filter(words >= least_words).withColumn("_chunks", chunk_text(F.col(text_col)))
    cut = known.select("*", F.posexplode("_chunks").alias("chunk_idx", "_chunk"))
    bare = strip_version(F.col("paper_id"))
    return cut.select(
        chunk_id(bare, F.col("chunk_idx")).alias("chunk_id"),
        bare.alias("paper_id"),
        "title",
        year_of(F.col("published")).alias("year"),
        "primary_category",
        "chunk_idx",
        F.size("_chunks").alias("n_chunks"),
        F.col("_chunk").alias("text"),
    )
