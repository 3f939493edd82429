"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir, written  # noqa: F401 - operators take them from here

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python stage turns into Python objects at once.
SLICE_ROWS = 512


def release() -> None:
    """Gives a Python worker's free memory back: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def map_columns(df: DataFrame, make, fields: list[T.StructField], carry: list[str], *, rows: int = SLICE_ROWS) -> DataFrame:
    """Columns computed batch by batch in Python, beside the carried ones.

    ``make()`` runs once per task and returns ``f(batch) -> list of arrays``; each
    array holds one value per row, in the order of ``fields``.
    """
    schema = T.StructType([df.schema[c] for c in carry] + fields)

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                got = f(part)
                kept = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, *got], names=[x.name for x in schema])
        f = part = got = kept = whole = None
        release()

    return df.mapInArrow(run, schema)


def emit_rows(df: DataFrame, make, schema: T.StructType, *, rows: int = SLICE_ROWS) -> DataFrame:
    """Any number of rows per batch: ``make()`` returns ``(f, end)``.

    ``f(batch)`` and the final ``end()`` (may be ``None``) yield lists of arrays.
    """
    names = [x.name for x in schema]

    def run(batches):
        f, end = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                for got in f(whole.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays(got, names=names)
        for got in end() if end else ():
            yield pa.RecordBatch.from_arrays(got, names=names)
        f = end = got = whole = None
        release()

    return df.mapInArrow(run, schema)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names (case ignored) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def row_hash(df: DataFrame, seed: int) -> F.Column:
    """A 64-bit hash of all columns of a row; two seeds give 128 bits, which tell rows apart.

    Nulls are marked, in columns and within nested values.
    """
    marked = [F.lit(seed)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
            marked.append(c)
        else:
            marked += [c.isNull(), c]
    return F.xxhash64(*marked)


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of ``counts`` of largest ``n``: at most ``size``, rows of about equal ``n`` together.

    The bound on ``n`` comes from a histogram of fewer than 2,100 levels. An ordered limit would
    send the driver ``size`` rows of every partition; this sends it ``size`` in all.
    ``counts`` is read twice.
    """
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(F.floor(F.log2("n") * 32))
    bound, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["level"]):
        total += r["rows"]
        if total > size:
            break
        bound = r["level"]
    return counts.filter(F.lit(False) if bound is None else level >= bound)


def id_crc(col) -> F.Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def collect_blobs(df: DataFrame, *columns: str) -> list[list[bytes]]:
    """Columns of a table of checked size on the driver, packed by the executors.

    Each partition sends one row with a byte string per column (64-bit numbers or byte
    strings laid end to end), instead of an object per row.
    """
    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in columns])

    def make():
        held: list[list[bytes]] = [[] for _ in columns]

        def f(batch):
            for c, out in zip(columns, held):
                got = batch.column(batch.schema.get_field_index(c))
                out.append(b"".join(got.to_pylist()) if pa.types.is_binary(got.type) or pa.types.is_large_binary(got.type) else got.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            return ()

        def end():
            if held[0]:
                yield [pa.array([b"".join(x)], pa.binary()) for x in held]

        return f, end

    return [[bytes(r[c]) for c in columns] for r in emit_rows(df.select(*columns), make, schema, rows=8192).collect()]
