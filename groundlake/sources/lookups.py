"""Lookups of rows in other catalogues, in order, at a bounded rate, never twice (SRC-7, SRC-9 to SRC-11)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.versions import Versions


@dataclass
class Step:
    """One place to ask: its name, the key of a row there (null: nothing to ask), and the call.

    ``fetch`` returns the response or ``None`` for a miss; what it raises is a failure, which
    is not remembered. ``found`` says which responses answer; others are misses.
    """

    name: str
    key: Column
    fetch: Callable[[str], str | None]
    found: Callable[[Column], Column] = lambda response: response.isNotNull()


def title_key(title: Column, longest: int = 120) -> Column:
    """A title as a search takes it."""
    cut = F.trim(F.substring(F.trim(title), 1, longest))
    return F.when(cut != "", cut)


def asked(keys: DataFrame, fetch: Callable[[str], str | None], *, rate: float, parallel: int = 4) -> DataFrame:
    """``key, response, failed`` of distinct keys, at most ``rate`` calls a second over all tasks.

    There are ``parallel`` tasks and each leaves ``parallel / rate`` seconds between the
    starts of its calls, the first ones apart by ``1 / rate``, so no coordinator is needed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        due = time.monotonic() + (TaskContext.get().partitionId() % parallel) / rate
        for frame in frames:
            rows = []
            for key in frame["key"]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + parallel / rate
                try:
                    rows.append((key, fetch(key), False))
                except Exception:  # noqa: BLE001 - asked again the next time
                    rows.append((key, None, True))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if c != "failed" else bool) for i, c in enumerate(("key", "response", "failed"))})

    return keys.select("key").repartition(parallel).mapInPandas(run, "key string, response string, failed boolean")


def looked_up(rows: DataFrame, steps: list[Step], cache: str, *, rate: float = 1.0, parallel: int = 4) -> DataFrame:
    """``rows`` with ``source, response``: the first step, in order, that has an answer.

    A step asks only for rows that no step before has answered. Answers and misses are
    kept in the table ``lookups`` of versions at ``cache``: a second run makes no call but
    for new keys and failures. Rows without an answer have nulls; each key is asked once,
    however many rows have it, and a key that most rows share is joined to them by
    broadcast or split by Spark, not gathered.
    """
    spark = rows.sparkSession
    at = Versions(spark, cache)
    if not at.exists():
        at.commit(lambda base: {"lookups": spark.createDataFrame([], "source string, key string, response string")})
    left, done = rows, None
    for step in steps:
        wanted = left.select(step.key.alias("key")).filter("key IS NOT NULL").distinct()
        known = at.read("lookups").filter(F.col("source") == step.name)
        got = asked(wanted.join(known.select("key"), "key", "left_anti"), step.fetch, rate=rate, parallel=parallel)
        _, lying = at.write("asked", got)  # calls are made here, once
        if lying.take(1):
            at.commit(lambda base, lying=lying, step=step: {"lookups": lying.filter("NOT failed").select(F.lit(step.name).alias("source"), "key", "response").join(at.read("lookups", base).filter(F.col("source") == step.name).select("key"), "key", "left_anti").select("source", "key", "response")})
        hits = at.read("lookups").filter(F.col("source") == step.name).filter(F.coalesce(step.found(F.col("response")), F.lit(False))).select(F.col("key").alias("_key"), F.col("source"), F.col("response"))
        met = left.withColumn("_key", step.key).join(hits, "_key", "left").drop("_key")
        found = met.filter("source IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        left = met.filter("source IS NULL").drop("source", "response")
    none = F.lit(None).cast("string")
    rest = left.select("*", none.alias("source"), none.alias("response"))
    return rest if done is None else done.unionByName(rest)
