"""Constraints as columns, all of a table in one aggregate (AGG-11 to AGG-13, OPS-1)."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import valid_year, year_of


@dataclass
class Constraint:
    """What no row of a table may be; ``shown`` names an offending row, ``fatal`` makes it a failure."""

    name: str
    bad: Column
    shown: Column
    fatal: bool = True


def unique(key: str, *, fatal: bool = True) -> tuple[str, str, bool]:
    """The constraint that a key occurs once, for :func:`checked`."""
    return f"{key} unique", key, fatal


def checked(df: DataFrame, constraints: list[Constraint], uniques: tuple[tuple[str, str, bool], ...] = ()) -> DataFrame:
    """``check, status, detail``, a row per constraint, from one pass over ``df``.

    A status is ``OK``, or ``FAIL`` or ``WARN`` with how many rows offend and the least of
    their names. A condition that is null does not offend. Equal keys are counted by
    distinct count; null keys are not compared.
    """
    sums = [F.count("*").alias("n")]
    for i, c in enumerate(constraints):
        sums += [F.count_if(c.bad).alias(f"bad{i}"), F.min(F.when(c.bad, c.shown.cast("string"))).alias(f"shown{i}")]
    for i, (_, key, _) in enumerate(uniques):
        sums += [(F.count(key) - F.count_distinct(F.col(key))).alias(f"twice{i}")]
    told = lambda bad, fatal: F.when(bad == 0, "OK").otherwise("FAIL" if fatal else "WARN")
    rows = [F.struct(F.lit(c.name).alias("check"), told(F.col(f"bad{i}"), c.fatal).alias("status"), F.when(F.col(f"bad{i}") == 0, "").otherwise(F.concat(F.col(f"bad{i}").cast("string"), F.lit(" rows, first "), F.coalesce(f"shown{i}", F.lit("?")))).alias("detail")) for i, c in enumerate(constraints)]
    rows += [F.struct(F.lit(name).alias("check"), told(F.col(f"twice{i}"), fatal).alias("status"), F.concat(F.col("n").cast("string"), F.lit(" rows, "), F.col(f"twice{i}").cast("string"), F.lit(" again")).alias("detail")) for i, (name, _, fatal) in enumerate(uniques)]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def paper_constraints() -> list[Constraint]:
    """What a paper table must hold to."""
    return [
        Constraint("paper ids present", F.coalesce(F.trim("paper_id"), F.lit("")) == "", F.coalesce("title", F.lit(""))),
        Constraint("metadata years", ~valid_year(year_of(F.col("published"))), F.concat_ws(" ", "paper_id", year_of(F.col("published"))), fatal=False),
    ]


def chunk_constraints() -> list[Constraint]:
    """What the chunks of an index must hold to."""
    return [
        Constraint("chunk places", (F.col("chunk_idx") < 0) | (F.col("chunk_idx") >= F.col("n_chunks")), F.col("chunk_id")),
        Constraint("chunk vectors", F.coalesce(F.size("embedding"), F.lit(0)) <= 0, F.col("chunk_id")),
        Constraint("chunk texts", F.coalesce(F.trim("text"), F.lit("")) == "", F.col("chunk_id"), fatal=False),
    ]


def surroundings(spark: SparkSession, *, paths: tuple[str, ...] = (), modules: tuple[str, ...] = ("numpy", "pandas", "pyarrow"), keys: tuple[str, ...] = (), model: Callable[[], str] | None = None, smoke: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``check, status, detail`` of what is no table: paths, imports, keys, the model's folder, a retrieval.

    A missing key is a warning, all else a failure. ``smoke`` retrieves something, whose
    rows have ``rank, score, paper_id``; ``model`` raises where there is none.
    """
    rows = []

    def add(name: str, ok: bool, detail: str = "", fatal: bool = True) -> None:
        rows.append((name, "OK" if ok else "FAIL" if fatal else "WARN", detail))

    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        add(f"exists {p}", at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))
    missing = [m for m in modules if importlib.util.find_spec(m) is None]
    add("runtime imports", not missing, ", ".join(missing))
    for k in keys:
        add(k, bool(os.environ.get(k)), "set" if os.environ.get(k) else "missing: retrieval works, generation does not", fatal=False)
    for name, call in (("model folder", model), ("retrieval", smoke)):
        if call is None:
            continue
        try:
            got = call()
            told = got if isinstance(got, str) else "; ".join(f"{r['rank']}. {r['score']:.3f} {r['paper_id']}" for r in got.orderBy("rank").limit(3).collect())
            add(name, bool(told), told)
        except Exception as e:  # noqa: BLE001 - a check that breaks is a check that fails
            add(name, False, f"{type(e).__name__}: {e}".split("\n")[0][:200])
    return spark.createDataFrame(rows, "check string, status string, detail string")


def report(papers: DataFrame, index: DataFrame, around: DataFrame) -> DataFrame:
    """All checks of a corpus: one job over its papers, one over its index, and its surroundings."""
    return around.unionByName(checked(papers, paper_constraints(), (unique("paper_id"),))).unionByName(checked(index, chunk_constraints(), (unique("chunk_id"),)))


def failed(checks: DataFrame) -> bool:
    """Whether anything is fatal; warnings are not."""
    return bool(checks.filter("status = 'FAIL'").take(1))
