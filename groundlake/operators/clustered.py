"""Exact top-K over a clustered index that skips blocks by bounds (SRT-1, JN-4).

Vectors lie with their nearest centre, each cluster in rings by distance from it. A block
is a run of one cluster's rows in one file, known by its centre, the least and greatest
distance from it, and the greatest norm. Three bounds say how large an inner product a
block can hold: by Cauchy and Schwarz against the norm and against the radius, and by the
triangle inequality against the ring. A question reads the blocks of largest bound first,
and then only those whose bound reaches the k-th best found. How much is skipped depends
on the data: in vectors without clusters next to nothing is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import written
from .retrieve import MAX_QUESTIONS, Nearest, asked_vectors, best_of, rows_of

#: Rows of a file; centres at most; sampled rows a centre, and rounds, that place the centres.
FILE_ROWS, CENTRES, SAMPLE, ROUNDS = 8192, 1024, 32, 6

#: Blocks that a question reads before it knows a score to beat.
PROBES = 2


def centres_of(index: DataFrame, number: int, *, id_col: str, vec_col: str) -> np.ndarray:
    """Centres by Lloyd's rounds over a bounded sample: ``SAMPLE`` rows a centre, chosen by a hash of the id.

    Any centres give right answers; better ones skip more.
    """
    n = index.count()
    share = min(1.0, SAMPLE * number / max(n, 1))
    drawn = index if share == 1.0 else index.filter(F.pmod(F.xxhash64(id_col, F.lit("centre")), F.lit(1 << 30)) < int(share * (1 << 30)))
    x = np.array([r[0] for r in drawn.orderBy(F.xxhash64(id_col), id_col).select(vec_col).limit(2 * SAMPLE * number).collect()], dtype=np.float64)
    x = x[np.isfinite(x).all(axis=1)] if len(x) else x
    if not len(x):
        return np.zeros((1, 0))
    few = np.unique(x, axis=0)
    few = few[np.random.default_rng(7).permutation(len(few))[: 4 * number]]
    chosen, apart = [0], ((few - few[0]) ** 2).sum(axis=1)
    while len(chosen) < min(number, len(few)):  # the next centre is the row farthest from all so far
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((few - few[chosen[-1]]) ** 2).sum(axis=1))
    c = few[chosen]
    for _ in range(ROUNDS):
        at = nearest_centre(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n_at = np.bincount(at, minlength=len(c))
        c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance from it."""
    at = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(axis=1))


def build(index: DataFrame, path: str, *, centres: int | None = None, file_rows: int = FILE_ROWS, id_col: str = "chunk_id", vec_col: str = "embedding") -> None:
    """Writes the rows of ``index`` clustered below ``path/rows`` and one row per block below ``path/blocks``.

    Rows without a whole vector of the commonest length cannot be found and are left out.
    Files have about equal numbers of rows, whatever the clusters' sizes: a cluster that
    holds a third of all rows is cut into rings.
    """
    spark = index.sparkSession
    wide = index.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = wide["d"] if wide else 0
    whole = index.filter((F.size(vec_col) == d) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    n = whole.count()
    c = centres_of(whole, centres or max(1, min(CENTRES, n // 64)), id_col=id_col, vec_col=vec_col) if n else np.zeros((1, d))
    shared = spark.sparkContext.broadcast(c)
    schema = T.StructType([*index.schema.fields, T.StructField("_cluster", T.IntegerType()), T.StructField("_apart", T.DoubleType()), T.StructField("_norm", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x = rows_of(batch, id_col, vec_col)
            at, apart = nearest_centre(x, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(apart), pa.array(np.sqrt((x**2).sum(axis=1)))], schema=pa.schema([*batch.schema, *list(arrow)[-3:]]))

    files = max(1, -(-n // file_rows))
    ranged = whole.mapInArrow(place, schema).repartitionByRange(files, "_cluster", "_apart", F.xxhash64(id_col)).sortWithinPartitions("_cluster", "_apart")
    ranged.withColumn("_file", F.spark_partition_id()).write.mode("overwrite").partitionBy("_file").parquet(f"{path}/rows")
    lying = T.StructType([*schema.fields, T.StructField("_file", T.IntegerType())])
    spark.createDataFrame([], lying).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")  # an index without rows has no file that tells it
    rows = spark.read.schema(lying).parquet(f"{path}/rows")
    blocks = rows.groupBy("_file", "_cluster").agg(F.count("*").alias("n"), F.min("_apart").alias("low"), F.max("_apart").alias("high"), F.max("_norm").alias("norm"))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "_cluster int, centre array<double>")
    # centres: bounded by their number
    blocks.join(F.broadcast(points), "_cluster").write.mode("overwrite").parquet(f"{path}/blocks")


def upper_bounds(q: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The largest inner product that each question (row) can have in each block (column), rounded up a little."""
    length = np.sqrt((q**2).sum(axis=1))[:, None]
    apart = np.sqrt(np.maximum(length**2 + (centre**2).sum(axis=1) - 2 * q @ centre.T, 0.0))
    gap = np.maximum(np.maximum(apart - high, low - apart), 0.0)
    bound = np.minimum(np.minimum(length * norm, q @ centre.T + length * high), (length**2 + norm**2 - gap**2) / 2)
    return bound + 1e-7 * (1.0 + np.abs(bound))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 8, *, id_col: str = "chunk_id", vec_col: str = "embedding", qid_col: str = "qid", q_vec_col: str = "q_embedding") -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest rows of each question as :func:`retrieve.top_k` gives them, and ``qid, blocks, read`` per question.

    Up to ``MAX_QUESTIONS`` questions of distinct ids. Pairs of a block and a question, never of rows and
    questions, go through the shuffle; a block's rows meet all questions that need it in
    one product.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    if questions.count() > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions: ask in parts")
    names, q = asked_vectors(questions, qid_col, q_vec_col)
    shared = spark.sparkContext.broadcast((names, q))
    spot = ["_file", "_cluster"]
    pair = T.StructType([T.StructField("_file", T.IntegerType()), T.StructField("_cluster", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("bound", T.DoubleType())])
    hit = T.StructType([T.StructField(qid_col, questions.schema[qid_col].dataType), T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(hit)

    def bounded(floor: np.ndarray | None):
        """Pairs whose bound reaches the question's floor; without floors each task's best ``PROBES`` a question."""
        sent = spark.sparkContext.broadcast(floor)

        def run(batches):
            _, q = shared.value
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                centre = b.column(b.schema.get_field_index("centre")).flatten().to_numpy().reshape(b.num_rows, -1)
                bound = upper_bounds(q, centre, get("low"), get("high"), get("norm"))
                if sent.value is None:
                    most = min(PROBES, b.num_rows)
                    at, block = np.repeat(np.arange(len(q)), most), np.argsort(-bound, axis=1, kind="stable")[:, :most].ravel()
                else:
                    at, block = np.nonzero(bound >= sent.value[:, None])
                for i in range(0, len(at), 65536):
                    a, c = at[i : i + 65536], block[i : i + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(get("_file")[c], pa.int32()), pa.array(get("_cluster")[c], pa.int32()), pa.array(a, pa.int32()), pa.array(bound[a, c])], names=pair.names)

        return blocks.mapInArrow(run, pair)

    def scanned(pairs: DataFrame) -> DataFrame:
        """The best ``k`` of each question in each block it is paired with."""

        def meet(key, table: pa.Table, asked: pa.Table) -> pa.Table:
            names, q = shared.value
            held = Nearest(q, k)
            cols = np.unique(asked.column("at").to_numpy())
            for batch in table.combine_chunks().to_batches(max_chunksize=4096) if len(cols) else ():
                held.add(*rows_of(batch, id_col, vec_col), cols)
            ids = [] if held.ids is None else held.ids.tolist()
            return pa.Table.from_arrays([pa.array([names[c] for c in held.col], arrow.field(0).type), pa.array(ids, arrow.field(1).type), pa.array(held.score)], schema=arrow)

        files = [r["_file"] for r in pairs.select("_file").distinct().limit(1001).collect()]
        wanted = rows.filter(F.col("_file").isin(files)) if len(files) <= 1000 else rows  # other files are not opened
        needed = wanted.select(*spot, id_col, vec_col).join(pairs.select(*spot).distinct(), spot, "left_semi")
        return needed.groupBy(*spot).cogroup(pairs.groupBy(*spot)).applyInArrow(meet, hit)

    best = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("bound"), *spot))
    probes = written(bounded(None).withColumn("_b", best).filter(F.col("_b") <= PROBES).select(*spot, "at"), "probes")
    first = written(scanned(probes), "probed")
    ranked = best_of([first], k, id_col, qid_col)
    least = ranked.filter(F.col("rank") == k).select(qid_col, "score").collect()
    place = {name: i for i, name in enumerate(names)}
    floor = np.full(len(names), -np.inf)
    for r in least:
        floor[place[r[0]]] = r["score"]
    rest = written(bounded(floor).select(*spot, "at").join(probes, [*spot, "at"], "left_anti"), "pairs")
    hits = best_of([first, scanned(rest)], k, id_col, qid_col)
    known = spark.createDataFrame([(i, name) for i, name in enumerate(names)], T.StructType([T.StructField("at", T.IntegerType()), hit.fields[0]]))
    read = probes.unionByName(rest).groupBy("at").agg(F.count("*").alias("read"))
    report = known.join(read, "at", "left").select(qid_col, F.lit(blocks.count()).cast("long").alias("blocks"), F.coalesce("read", F.lit(0).cast("long")).alias("read"))
    return hits, report
