"""The index table: build, append, export, manifest (SNK-1 to SNK-8, OPS-2/3, SET-2/3, JN-7, BIN-4)."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import is_public
from .versions import Versions


def build(index: DataFrame, path: str) -> None:
    """Chunk rows with their vectors, one row each, in place of what the index had; earlier versions stay readable."""
    Versions(index.sparkSession, path).commit(lambda base: {"index": index}, replaced=("index",))


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of an index; a plain Parquet folder is an index without versions."""
    at = Versions(spark, path)
    return at.read("index", version) if at.exists() else spark.read.parquet(path)


def new_papers(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of papers that the index does not hold yet."""
    return rows.join(existing.select("paper_id").distinct(), "paper_id", "left_anti")


def append(rows: DataFrame, path: str, *, mark: tuple[str, int] | None = None) -> None:
    """Adds rows of new papers; the same rows again add nothing.

    One commit: readers see all rows or none, and writers at the same time do not double a
    paper. ``mark`` names a stream and its batch. On a plain folder the append is Spark's.
    """
    spark = rows.sparkSession
    at = Versions(spark, path)
    if not at.exists():
        new_papers(rows, spark.read.parquet(path)).write.mode("append").parquet(path)
        return
    at.commit(lambda base: {"index": new_papers(rows, at.read("index", base)).select(*at.read("index", base).columns)}, mark=mark)


def public_rows(index: DataFrame) -> DataFrame:
    return index.filter(is_public(F.col("paper_id")))


def of_papers(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks of the papers kept."""
    return chunks.join(kept.select("paper_id").distinct(), "paper_id", "left_semi")


def manifest_counts(index: DataFrame) -> DataFrame:
    """Vectors and papers in all, kept and excluded, in one pass."""
    public = is_public(F.col("paper_id"))
    return index.agg(
        F.count("*").alias("source_vectors"),
        F.countDistinct("paper_id").alias("source_papers"),
        F.count_if(public).alias("public_vectors"),
        F.countDistinct(F.when(public, F.col("paper_id"))).alias("public_papers"),
        F.count_if(~public).alias("excluded_vectors"),
        F.countDistinct(F.when(~public, F.col("paper_id"))).alias("excluded_papers"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def export_public(index: DataFrame, path: str, *, now: datetime | None = None) -> dict:
    """Writes the public part of the index and its manifest; returns the manifest."""
    spark = index.sparkSession
    public_rows(index).write.mode("overwrite").parquet(f"{path}/index")
    c = manifest_counts(index).first()
    dim = index.select(F.max(F.size("embedding"))).first()[0]
    done = {
        "generated_at": (now or datetime.now(UTC)).isoformat(timespec="seconds"),
        "source_index": {"vectors": c["source_vectors"], "papers": c["source_papers"]},
        "public_export": {"vectors": c["public_vectors"], "papers": c["public_papers"], "dim": dim},
        "excluded": {"reason": "synthetic ids are not redistributable", "vectors": c["excluded_vectors"], "papers": c["excluded_papers"]},
        "artifacts": {r["file"]: r["sha256"] for r in file_digests(spark, f"{path}/index").filter("file LIKE '%.parquet'").collect()},
    }
    spark.createDataFrame([(json.dumps(done, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return done
