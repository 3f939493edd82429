"""The corpus pipeline: five operators, each over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundlake.llm.common import written
from groundlake.llm.language_id import drop_unidentified
from groundlake.llm.lexicon_bpe import encode_texts
from groundlake.llm.line_dedup import dedup_lines
from groundlake.llm.mixing import apply_mix
from groundlake.llm.partenum_join import keep_one

#: Words of the last stage's automaton, and words a task of it remembers, twice at most
#: (some 9 MB each); a task that counts words keeps eight times the first.
LEXICON, REMEMBERED = 25_000, 25_000

#: Rows of an Arrow batch where whole texts go to Python, which holds a batch as the executor
#: does; stages on rows of numbers keep Spark's own size.
TEXT_ROWS, NUMBER_ROWS = 1_000, 10_000


def _batches(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go."""
    _batches(spark, TEXT_ROWS)
    return drop_unidentified(docs)


def dedup_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all documents but the first; ``n_chars`` follows the text."""
    _batches(spark, TEXT_ROWS)
    done = dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    _batches(spark, TEXT_ROWS)
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _batches(spark, NUMBER_ROWS)
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text."""
    _batches(spark, TEXT_ROWS)
    done = encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), lexicon_size=LEXICON, cache_size=REMEMBERED, with_ids=True)
    return done.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_line),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither n-gram profiles nor dependent rounding nor BPE; tests/llm
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
