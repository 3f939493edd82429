"""Corpus health checks (AGG-11 to AGG-13, OPS-1)."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import valid_year, year_of


def counts(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of both tables and whether they agree."""
    return index.agg(F.count("*").alias("index_rows")).crossJoin(chunks.agg(F.count("*").alias("chunk_rows"))).withColumn("equal", F.col("index_rows") == F.col("chunk_rows"))


def uniqueness(papers: DataFrame, key: str = "paper_id") -> DataFrame:
    return papers.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids")).withColumn("is_unique", F.col("n_rows") == F.col("n_ids"))


def bad_years(papers: DataFrame, show: int = 5) -> DataFrame:
    """The first papers, by id, whose year is not one."""
    return papers.filter(~valid_year(year_of(F.col("published")))).select("paper_id", year_of(F.col("published")).alias("year"), F.substring("title", 1, 70).alias("title")).orderBy("paper_id").limit(show)


def health(spark: SparkSession, papers: DataFrame, chunks: DataFrame, index: DataFrame, modules: tuple[str, ...] = ("numpy", "pandas", "pyarrow")) -> DataFrame:
    """``check, status, detail``: ``FAIL`` is fatal, ``WARN`` is not."""
    rows = []
    c = counts(index, chunks).first()
    rows.append(("index/chunk counts", "OK" if c["equal"] else "FAIL", f"index={c['index_rows']}, chunks={c['chunk_rows']}"))
    u = uniqueness(papers).first()
    rows.append(("metadata ids unique", "OK" if u["is_unique"] else "FAIL", f"{u['n_rows']} papers, {u['n_ids']} unique ids"))
    years = bad_years(papers).collect()
    rows.append(("metadata years", "WARN" if years else "OK", ", ".join(f"{r['paper_id']} {r['year']}" for r in years)))
    missing = [m for m in modules if importlib.util.find_spec(m) is None]
    rows.append(("runtime imports", "FAIL" if missing else "OK", ", ".join(missing)))
    return spark.createDataFrame(rows, "check string, status string, detail string")
