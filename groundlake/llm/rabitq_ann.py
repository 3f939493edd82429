"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector less the centroid is rotated at random and kept as the signs of its components,
its length and the inner product of signs and direction. These estimate any inner
product, with a bound on the error that holds with high probability; only vectors whose
bound reaches the k-th best so far are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, map_columns, written

#: Standard deviations of the estimate that the bound covers.
EPSILON = 4.0
#: Vectors of fewer dimensions are padded with zeros before the rotation, for longer codes.
LEAST_BITS = 256
QUERY_BLOCK = 4096
_TOLERANCE = 1e-9


def rotation(dim: int, seed: int) -> np.ndarray:
    """The rows of a random orthogonal matrix that meet the unpadded components."""
    bits = max(dim, LEAST_BITS)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id, _vec`` of rows that take part: an id, finite components, not all zero."""
    v = F.col("_vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec")).filter(F.col("_id").isNotNull() & fine)


def build_index(vectors: DataFrame, k: int, *, seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Codes of all vectors: ``_id, _vec, code, length, fit``; the centroid; the rotation.

    Of equal vectors only the ``k + 1`` smallest ids are listed: no other of them can be
    among the nearest k of any query, as ties go to smaller ids. The rest are found
    through them, so a very common vector costs no more than a rare one.
    """
    place = F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))
    listed = written(vectors.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place"), "ann-vectors")
    dim = listed.agg(F.max(F.size("_vec"))).first()[0] or 1
    sums = listed.agg(*[F.avg(F.get("_vec", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    centre, turn = np.array([x or 0.0 for x in sums]), rotation(dim, seed)

    def make():
        def f(batch):
            x = np.array(column(batch, "_vec"), dtype=np.float64) - centre
            length = np.sqrt((x * x).sum(1))
            turned = (x / np.where(length > 0, length, 1.0)[:, None]) @ turn
            bits = turned > 0
            fit = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
            return [pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()), pa.array(length), pa.array(fit)]

        return f

    fields = [T.StructField("code", T.BinaryType()), T.StructField("length", T.DoubleType()), T.StructField("fit", T.DoubleType())]
    same = listed.filter(F.size("_vec") == dim)
    return written(map_columns(same, make, fields, ["_id", "_vec"], rows=4096), "ann-codes"), centre, turn


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component in order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total = total + x[:, d] * q[:, d]
    return total


class _Best:
    """The nearest so far of one block of queries."""

    def __init__(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.turned = (queries @ turn).astype(np.float32)
        self.base = queries @ centre
        self.norm = np.sqrt((queries * queries).sum(1))
        self.least = np.full(len(queries), -np.inf)
        self.found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def scan(self, ids: np.ndarray, x: np.ndarray, signs: np.ndarray, length: np.ndarray, fit: np.ndarray) -> None:
        bits = signs.shape[1]
        fit = np.maximum(fit, 1e-9)
        scale = (length / fit / math.sqrt(bits)).astype(np.float32)
        spread = length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * EPSILON / math.sqrt(bits - 1) + 1e-6
        for lo in range(0, len(self.q), 256):
            part = slice(lo, lo + 256)
            guess = (signs @ self.turned[part].T) * scale[:, None] + self.base[part].astype(np.float32)
            n = guess.shape[1]
            if len(ids) >= self.k and np.isinf(self.least[part]).any():
                top = np.argpartition(-guess, self.k - 1, axis=0)[: self.k]
                got = np.einsum("knd,nd->kn", x[top], self.q[part])
                self.least[part] = np.maximum(self.least[part], got.min(0) - _TOLERANCE)
            chosen = guess + spread.astype(np.float32)[:, None] * self.norm[part].astype(np.float32) >= self.least[part].astype(np.float32) - np.float32(1e-5)
            some = np.flatnonzero(chosen.any(1))
            # the chosen vectors of the block are compared in one matrix product
            near = chosen[some] & (x[some] @ self.q[part].T >= self.least[part] - _TOLERANCE)
            r, c = np.nonzero(near)
            r, c = some[r], c + lo
            if len(r):
                own = (self.found[0] >= lo) & (self.found[0] < lo + n)
                q = np.concatenate((self.found[0][own], c))
                i = np.concatenate((self.found[1][own], ids[r]))
                s = np.concatenate((self.found[2][own], _exact(x[r], self.q[c])))
                order = np.lexsort((i, -s, q))
                q, i, s = q[order], i[order], s[order]
                first = np.searchsorted(q, np.arange(lo, lo + n))
                place = np.arange(len(q)) - first[q - lo]
                good = place < self.k
                self.found = tuple(np.concatenate((old[~own], new[good])) for old, new in zip(self.found, (q, i, s)))
                full = good & (place == self.k - 1)
                self.least[q[full]] = np.maximum(self.least[q[full]], s[full] - _TOLERANCE)


def search(index: DataFrame, centre: np.ndarray, turn: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """``_q, _id, score``: the nearest ``k`` listed vectors of each query (``_q, _vec``).

    Queries come in blocks of a few thousand; a block is broadcast and every partition
    of the index answers it, so no task holds more than a block and a batch of codes.
    """
    spark = index.sparkSession
    dim = len(centre)
    queries = written(queries.filter(F.size("_vec") == dim), "ann-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = T.StructType.fromDDL("_q long, _id long, score double")
    answers = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).orderBy("_q").collect()
        names = np.array([r["_q"] for r in rows], dtype=np.int64)
        shared = spark.sparkContext.broadcast((names, np.array([r["_vec"] for r in rows], dtype=np.float64).reshape(len(rows), dim)))

        def make(shared=shared):
            names, q = shared.value
            best = _Best(q, centre, turn, k)

            def f(batch):
                code = np.frombuffer(b"".join(column(batch, "code")), dtype=np.uint8).reshape(batch.num_rows, -1)
                signs = np.unpackbits(code, axis=1, count=turn.shape[1]).astype(np.float32) * 2 - 1
                get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                flat = batch.column(batch.schema.get_field_index("_vec")).flatten().to_numpy(zero_copy_only=False)
                if len(names):
                    best.scan(get("_id"), flat.reshape(-1, dim), signs, get("length"), get("fit"))
                return ()

            def end():
                q, i, s = best.found
                if len(q):
                    yield [pa.array(names[q]), pa.array(i), pa.array(s)]

            return f, end

        answers.append(written(emit_rows(index, make, schema, rows=8192), "ann-found"))
    found = answers[0]
    for x in answers[1:]:
        found = found.unionByName(x)
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def nearest(vectors: DataFrame, is_query: F.Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """``query_id, rank, <id>, score``: each query's ``k`` nearest other rows by inner product.

    ``is_query`` is a condition on the column ``_id``. Null or zero vectors, vectors with
    null or non-finite components, rows without id and vectors of another dimension than
    the table's largest take no part. Fewer candidates than ``k``: all of them. Ties go
    to the smaller id. Equal queries are searched once. Other columns are not read; a
    repeated row is one more candidate. Scores are summed in component order in doubles.
    """
    rows = written(usable(vectors, id_col, vec_col), "ann-usable")
    index, centre, turn = build_index(rows, k, seed=seed)
    asked = rows.filter(is_query)
    names = written(asked.groupBy("_vec").agg(F.min("_id").alias("_q")), "ann-asked")
    found = search(index, centre, turn, names, k + 1)
    # each query row takes the answers of its vector, less itself
    who = asked.join(names, "_vec").select(F.col("_id").alias("query_id"), "_q")
    pairs = who.join(found, "_q").filter(F.col("_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")
