"""Declared-schema readers (SRC-2 to SRC-6, SRC-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import strip


def json_lines(spark: SparkSession, path: str, schema: str, *, keep_broken: bool = True) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, broken ones kept apart or dropped."""
    if not keep_broken:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line, blank lines skipped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("paper_id")).filter("paper_id <> ''")


def source_blobs(spark: SparkSession, path: str, pattern: str = "*.src") -> DataFrame:
    """Binary files keyed by their safe name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("safe", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", ""))


def pdf_blobs(spark: SparkSession, path: str, skip_prefix: str = "inspire_") -> DataFrame:
    """PDF files of a folder, those already fetched left out, in the order of their paths."""
    files = source_blobs(spark, path, "*.pdf").withColumnRenamed("safe", "stem")
    return files.filter(~F.col("stem").startswith(skip_prefix)).orderBy("path")


def index_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """An index as of a version, the latest if none is named."""
    from ..operators.index import table

    return table(spark, path, version)


def arguments(spark: SparkSession, values: list[str], name: str = "query") -> DataFrame:
    """Command-line values as rows in order."""
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values) if v.strip()], f"qid string, {name} string")
