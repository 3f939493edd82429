"""Driver tables seen as the engine's tables, in Spark and, line for line, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources whose papers stand for those with synthetic ids.
PRIVATE = ["src0", "src3"]

#: The same papers for DuckDB.
PAPERS_SQL = """
papers AS (
  SELECT doc_id, text, lang, source, n_chars,
    CASE WHEN source IN ('src0', 'src3') THEN 'inspire:' || (1000 + doc_id)
         WHEN doc_id % 2 = 0 THEN printf('%04d.%05d', 701 + doc_id % 2000, doc_id)
         ELSE 'hep-th/' || printf('%07d', 9100000 + doc_id) END AS paper_id,
    CASE doc_id % 5 WHEN 0 THEN 'hep-th' WHEN 1 THEN 'cond-mat.str-el' WHEN 2 THEN 'math.AG' WHEN 3 THEN 'math.PR' ELSE 'stat.ML' END AS primary_category,
    CASE WHEN doc_id % 11 = 0 THEN '????' ELSE CAST(1976 + doc_id % 50 AS VARCHAR) END || '-01-01T00:00:00' AS published,
    ['A. Writer', CASE doc_id % 3 WHEN 0 THEN ' Ann Author ' WHEN 1 THEN 'ann author' ELSE 'B. Author-Smith' END] AS authors,
    CASE WHEN length(regexp_extract(text, '^[^.!?\\n]*')) BETWEEN 1 AND 160 THEN regexp_extract(text, '^[^.!?\\n]*') ELSE 'Untitled note ' || doc_id END AS title
  FROM documents
)"""

ANSWERS_SQL = """
answers AS (
  SELECT conv_id * 100 + turn AS seq, conv_id, turn,
    text || CASE conv_id % 4 WHEN 0 THEN ' [hep-th/9100001v2, 1106.4789; x]' WHEN 1 THEN ' [inspire:1000] and [cite] and [1106.4789v3]' WHEN 2 THEN ' Outside the corpus.' ELSE ' [HEP-TH/9112056] [2.7] [hep-th/9100003]' END AS answer,
    CASE WHEN conv_id % 3 = 0 THEN ['1106.4789', 'hep-th/9100001'] WHEN conv_id % 3 = 1 THEN ['inspire:1000v1'] ELSE CAST([] AS VARCHAR[]) END AS retrieved,
    CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN CAST([] AS VARCHAR[]) ELSE ['HEP-TH/9100001', '1106.4789v1'] END AS expected,
    CASE WHEN turn % 2 = 1 THEN 'alpha' ELSE 'beta' END AS backend, CASE WHEN conv_id % 2 = 0 THEN 'rag' ELSE 'closed_book' END AS condition,
    CASE WHEN conv_id % 7 = 0 THEN 'out_of_corpus' ELSE 'in_corpus' END AS type, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'TimeoutError: late' END AS error,
    CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST(conv_id % 3 AS INTEGER) END AS correctness, CAST((conv_id + turn) % 3 AS INTEGER) AS faithfulness
  FROM conversations WHERE role = 'assistant'
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ids of the three forms, categories, dates and authors.

    The title is the first sentence; a text that begins with no sentence of a title's length has none.
    """
    d = table(spark, sf_dir, "documents")
    i, sentence = F.col("doc_id"), F.regexp_extract("text", r"^[^.!?\n]*", 0)
    pick = lambda m, values: F.get(F.array(*[F.lit(v) for v in values]), (i % m).cast("int"))
    return d.select(
        "*",
        F.when(F.col("source").isin(PRIVATE), F.concat(F.lit("inspire:"), (i + 1000).cast("string"))).when(i % 2 == 0, F.format_string("%04d.%05d", 701 + i % 2000, i)).otherwise(F.concat(F.lit("hep-th/"), F.format_string("%07d", 9100000 + i))).alias("paper_id"),
        pick(5, ["hep-th", "cond-mat.str-el", "math.AG", "math.PR", "stat.ML"]).alias("primary_category"),
        F.concat(F.when(i % 11 == 0, "????").otherwise((1976 + i % 50).cast("string")), F.lit("-01-01T00:00:00")).alias("published"),
        F.array(F.lit("A. Writer"), pick(3, [" Ann Author ", "ann author", "B. Author-Smith"])).alias("authors"),
        F.when(F.length(sentence).between(1, 160), sentence).otherwise(F.concat(F.lit("Untitled note "), i.cast("string"))).alias("title"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citations put after them, what was retrieved and expected, and scores."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    i, t = F.col("conv_id"), F.col("turn")
    pick = lambda m, values: F.get(F.array(*[F.lit(v) for v in values]), (i % m).cast("int"))
    none = F.array().cast("array<string>")
    return c.select(
        (i * 100 + t).alias("seq"),
        "conv_id",
        "turn",
        F.concat("text", pick(4, [" [hep-th/9100001v2, 1106.4789; x]", " [inspire:1000] and [cite] and [1106.4789v3]", " Outside the corpus.", " [HEP-TH/9112056] [2.7] [hep-th/9100003]"])).alias("answer"),
        F.when(i % 3 == 0, F.array(F.lit("1106.4789"), F.lit("hep-th/9100001"))).when(i % 3 == 1, F.array(F.lit("inspire:1000v1"))).otherwise(none).alias("retrieved"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, none).otherwise(F.array(F.lit("HEP-TH/9100001"), F.lit("1106.4789v1"))).alias("expected"),
        F.when(t % 2 == 1, "alpha").otherwise("beta").alias("backend"),
        F.when(i % 2 == 0, "rag").otherwise("closed_book").alias("condition"),
        F.when(i % 7 == 0, "out_of_corpus").otherwise("in_corpus").alias("type"),
        F.when((i + t) % 13 == 0, "TimeoutError: late").alias("error"),
        F.when(i % 6 != 0, (i % 3).cast("int")).alias("correctness"),
        ((i + t) % 3).cast("int").alias("faithfulness"),
    )
