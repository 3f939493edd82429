"""Evaluation runs: retrieve, prompt, generate, validate (GEN-4 to GEN-6, PRM-1/2, OPS-5, SNK-8, SNK-10)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import validation
from ..functions.ids import normalize_id
from ..functions.prompts import CLOSED_BOOK_SYSTEM, SYSTEM, closed_prompt, joined_passages, passage, rag_prompt
from ..functions.vectors import prefixed
from . import encode, generate, retrieve

CONDITIONS = ("rag", "closed_book")


def default_path(now: datetime, folder: str = "results") -> str:
    """Where a run goes if nothing else is said."""
    return f"{folder}/run_{now:%Y%m%d-%H%M%S}"


def retrieved(gold: DataFrame, index: DataFrame, k: int, make: Callable[[], encode.Encoder]) -> DataFrame:
    """Ranked passages of every question, with their fields."""
    asked = encode.encode(gold.select("qid", prefixed(F.col("question")).alias("_q")), "_q", make=make, out_col="q_embedding")
    return retrieve.with_payload(retrieve.top_k(index, asked, k), index.drop("embedding"), "chunk_id")


def prompts(gold: DataFrame, hits: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """``qid, condition, system, user, retrieved_ids``; each condition's prompt is built once a question."""
    shown = hits.withColumn("_p", passage(F.col("rank"), F.col("score"), F.col("title"), F.col("paper_id"), F.col("year"), F.col("text")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda s: s["paper_id"])
    per = shown.groupBy("qid").agg(joined_passages(F.col("rank"), F.col("_p")).alias("_passages"), ids.alias("retrieved_ids"))
    none = F.array().cast("array<string>")
    joined = gold.join(per, "qid", "left")
    made = {
        "rag": joined.select("qid", F.lit("rag").alias("condition"), F.lit(SYSTEM).alias("system"), rag_prompt(F.col("question"), F.coalesce("_passages", F.lit(""))).alias("user"), F.coalesce("retrieved_ids", none).alias("retrieved_ids")),
        "closed_book": gold.select("qid", F.lit("closed_book").alias("condition"), F.lit(CLOSED_BOOK_SYSTEM).alias("system"), closed_prompt(F.col("question")).alias("user"), none.alias("retrieved_ids")),
    }
    out = None
    for c in conditions:
        out = made[c] if out is None else out.unionByName(made[c])
    return out


def run(gold: DataFrame, index: DataFrame, providers: list[str], *, conditions: tuple[str, ...] = CONDITIONS, k: int = 8, make: Callable[[], encode.Encoder] = encode.HashingEncoder, factory: Callable[[str], generate.Backend] = generate.get_backend, guardrail: bool = False, max_tokens: int = generate.MAX_TOKENS) -> DataFrame:
    """Run records of every question, provider and condition, human scores left null.

    Providers are made on the driver first, so that a missing key fails before retrieval.
    Write the result before aggregating it: calls must not be repeated.
    """
    spark = gold.sparkSession
    models = spark.createDataFrame([(p, factory(p).model) for p in providers], "backend string, model string")
    asked = prompts(gold, retrieved(gold, index, k, make), conditions).crossJoin(F.broadcast(models))
    said = generate.generate(asked.select("qid", "backend", "condition", "system", "user", "retrieved_ids"), factory, guardrail=guardrail, max_tokens=max_tokens)
    whole = asked.drop("system", "user").join(said, ["qid", "backend", "condition"]).join(gold.select("qid", "question", "type", "expected_citations"), "qid")
    auto = F.when(F.col("error").isNull(), validation(F.col("answer"), F.col("retrieved_ids"), F.col("expected_citations")))
    empty = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("correctness", "faithfulness", "refusal_ok")], F.lit("").alias("notes"))
    return whole.select(
        "qid", "question", F.coalesce("type", F.lit("in_corpus")).alias("type"), "backend", "condition", "model", F.when(F.col("condition") == "rag", k).otherwise(0).alias("k"),
        "retrieved_ids", "expected_citations", empty.alias("human"), "answer", "latency_s", "error", "attempts", "grounded", auto.alias("auto"), F.xxhash64("qid", "backend", "condition").alias("seq"),
    )


def preview(gold: DataFrame, index: DataFrame, *, k: int = 8, make: Callable[[], encode.Encoder] = encode.HashingEncoder) -> DataFrame:
    """``qid, expected_id, rank`` without any generation: what retrieval alone finds."""
    hits = retrieved(gold, index, k, make).withColumn("paper_id", normalize_id(F.col("paper_id")))
    wanted = gold.select("qid", F.explode("expected_citations").alias("e")).select("qid", normalize_id(F.col("e")).alias("expected_id"))
    return retrieve.expected_ranks(hits, wanted)
