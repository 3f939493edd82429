"""Exact top-K inner-product retrieval (JN-3, JN-4, WIN-1, WIN-2, SRT-1, GEN-5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import inner_product

#: Questions that one pass over the index may answer: at 1,024 floats 32 MB of broadcast.
MAX_QUESTIONS = 4096

#: Scores of a product held at once: 8 MB, however many questions and however long an Arrow batch.
SCORES = 1 << 20


def top_k_single(index: DataFrame, question: list[float], k: int = 8, *, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The ``min(k, n)`` nearest rows of one question: a bounded heap per task, no sort."""
    wanted = F.array(*[F.lit(float(x)) for x in question])
    scored = index.withColumn("score", inner_product(F.col(vec_col), wanted))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


class Nearest:
    """The best ``k`` rows of each question so far: a bounded, mergeable list.

    A product in one go chooses candidates; what is kept is scored again row by row, so
    equal vectors score alike wherever they lie and ties go to smaller ids.
    """

    def __init__(self, questions: np.ndarray, k: int):
        self.q, self.k = questions, k
        self.col = np.zeros(0, dtype=np.int64)
        self.ids, self.score = None, np.zeros(0)
        self.least = np.full(len(questions), -np.inf)  # a question's k-th best, once it has k

    def add(self, ids: np.ndarray, x: np.ndarray, cols: np.ndarray | None = None) -> None:
        """Rows ``x`` against all questions, or those numbered ``cols``."""
        cols = np.arange(len(self.q)) if cols is None else cols
        whole = np.isfinite(x).all(axis=1)
        ids, x = ids[whole], x[whole]
        if not len(ids) or not len(cols):
            return
        q, step = self.q[cols], max(1, SCORES // len(cols))
        for start in range(0, len(ids), step):
            part = x[start : start + step]
            score = part @ q.T
            floor = self.least[cols]
            hit = score >= lowered(floor)
            if len(part) > self.k and np.count_nonzero(hit) > self.k * len(cols):
                floor = np.maximum(floor, np.partition(score, len(part) - self.k, axis=0)[len(part) - self.k])
                hit = score >= lowered(floor)
            row, at = np.nonzero(hit)
            if len(row):
                exact = np.concatenate([(part[row[i : i + 8192]] * q[at[i : i + 8192]]).sum(axis=1) for i in range(0, len(row), 8192)])
                self.merge(cols[at], ids[start + row], exact)

    def merge(self, col: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        col = np.concatenate([self.col, col])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, col))
        col, ids, score = col[order], ids[order], score[order]
        first = np.searchsorted(col, col, side="left")
        keep = np.arange(len(col)) - first < self.k
        self.col, self.ids, self.score = col[keep], ids[keep], score[keep]
        full = np.flatnonzero(self.col[self.k - 1 :] == self.col[: max(0, len(self.col) - self.k + 1)]) + self.k - 1
        self.least[self.col[full]] = self.score[full]

    def sent(self, names: list, schema: pa.Schema) -> pa.RecordBatch:
        """What is held, as a batch of question, id and score."""
        ids = [] if self.ids is None else self.ids.tolist()
        return pa.RecordBatch.from_arrays([pa.array([names[c] for c in self.col], schema.field(0).type), pa.array(ids, schema.field(1).type), pa.array(self.score)], schema=schema)


def lowered(floor: np.ndarray) -> np.ndarray:
    """Floors of the product in one go, whose rounding may differ from that of row by row."""
    return np.where(np.isfinite(floor), floor - 1e-9 * (1.0 + np.abs(floor)), floor)


def rows_of(batch: pa.RecordBatch, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of vectors of a batch whose vectors have one length; missing components are NaN."""
    ids = batch.column(batch.schema.get_field_index(id_col))
    ids = np.array(ids.to_pylist(), dtype=str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)
    vectors = batch.column(batch.schema.get_field_index(vec_col)).flatten().to_numpy(zero_copy_only=False)
    return ids, np.asarray(vectors, dtype=np.float64).reshape(batch.num_rows, -1)


def asked_vectors(questions: DataFrame, qid_col: str, q_vec_col: str) -> tuple[list, np.ndarray]:
    """Questions on the driver: their ids and one matrix; those without a vector are left out."""
    rows = [r for r in questions.select(qid_col, q_vec_col).collect() if r[1]]
    wide = {len(r[1]) for r in rows}
    if len(wide) > 1:
        raise ValueError(f"questions of different lengths: {sorted(wide)}")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), *(wide or {0}))


def top_k(index: DataFrame, questions: DataFrame, k: int = 8, *, id_col: str = "chunk_id", vec_col: str = "embedding", qid_col: str = "qid", q_vec_col: str = "q_embedding", most: int = MAX_QUESTIONS) -> DataFrame:
    """``qid, <id>, score, rank`` for a batch of questions, ranks from 1, ties to smaller ids.

    The stated questions meet every row of the index in one pass, in several beyond
    ``MAX_QUESTIONS`` (counted first), and in a task in blocks of ``most``. A task holds the
    best ``k`` of each question and sends them on at its end, so ``tasks x k`` rows a question
    are shuffled and nothing is sorted before. Rows without a whole vector of the questions'
    length are not found.
    """
    passes = max(1, -(-questions.count() // MAX_QUESTIONS))
    parts = []
    for p in range(passes):
        names, q = asked_vectors(questions if passes == 1 else questions.filter(F.pmod(F.xxhash64(qid_col), F.lit(passes)) == p), qid_col, q_vec_col)
        given = index.sparkSession.sparkContext.broadcast((names, q))
        schema = T.StructType([T.StructField(qid_col, questions.schema[qid_col].dataType), T.StructField(id_col, index.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
        arrow = to_arrow_schema(schema)

        def run(batches, given=given, arrow=arrow):
            names, q = given.value
            held = [Nearest(q[b : b + most], k) for b in range(0, len(q), most)]
            for batch in batches:
                if batch.num_rows and names:
                    ids, x = rows_of(batch, id_col, vec_col)
                    for block in held:
                        block.add(ids, x)
            for b, block in enumerate(held):
                if len(block.col):
                    yield block.sent(names[b * most : (b + 1) * most], arrow)

        rows = index.select(id_col, vec_col).filter(F.size(vec_col) == q.shape[1])
        parts.append(rows.mapInArrow(run, schema))
    return best_of(parts, k, id_col, qid_col)


def best_of(parts: list[DataFrame], k: int, id_col: str, qid_col: str) -> DataFrame:
    """The best ``k`` of each question among what tasks sent on, ranked."""
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy(qid_col).orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_payload(hits: DataFrame, payload: DataFrame, on: str) -> DataFrame:
    """Hits with the fields of their passages."""
    return hits.join(payload, on)


def expected_ranks(hits: DataFrame, expected: DataFrame, *, qid_col: str = "qid", id_col: str = "paper_id") -> DataFrame:
    """Rank of the first hit of each expected id, null for a miss. Ids are canonical on both sides."""
    first = hits.groupBy(qid_col, id_col).agg(F.min("rank").alias("rank"))
    return expected.select(qid_col, F.col("expected_id")).join(first.withColumnRenamed(id_col, "expected_id"), [qid_col, "expected_id"], "left")
