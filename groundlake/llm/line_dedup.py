"""Line deduplication by probing a sharded minimal perfect hash.

Lines become 128-bit hashes; those found in two documents or more are dealt to shards,
and every shard is a minimal perfect hash (levels of bit arrays, each holding the hashes
that met no other on their level) over a fingerprint, a count and a first-document
array. Documents look their lines up in the arrays; lines themselves are never joined.
While the arrays stay under a checked size they are broadcast and one pass over the
documents suffices. Beyond it each shard is streamed past the probes that need it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, map_columns, without, written

STRIP = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
#: Documents without an id are ordered after all others.
NO_ID = (1 << 63) - 1
_U = np.uint64


def line_keys(text: str | None, least: int) -> tuple[list[str], list[int], list[bytes]]:
    """All lines of a text, and number and 16-byte hash of each line long enough."""
    lines = (text or "").split("\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        key = line.strip(STRIP)
        if len(key) >= least:
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, at, hashes


def _words(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + _U((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key's slot is its rank in the levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = [np.unpackbits(x, bitorder="little") for x in levels]
        self.ranks = [np.cumsum(x, dtype=np.int64) for x in self.levels]
        self.starts = np.cumsum([0, *(int(r[-1]) for r in self.ranks)])

    @staticmethod
    def build(keys: np.ndarray) -> list[np.ndarray]:
        levels = []
        while len(keys):
            n = max(64, -(-2 * len(keys) // 64) * 64)
            slots = (_mix(keys, len(levels)) % _U(n)).astype(np.int64)
            alone = np.bincount(slots, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[slots]]
            if len(levels) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
        return levels

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a foreign key any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(rest):
                break
            at = (_mix(keys[rest], k) % _U(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[rest[hit]] = self.starts[k] + self.ranks[k][at[hit]] - 1
            rest = rest[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray) -> bytes:
    """A shard's perfect hash and arrays as one byte string."""
    levels = PerfectHash.build(h1 ^ _mix(h2, 0))
    slots = PerfectHash(levels).slots(h1 ^ _mix(h2, 0)) if len(h1) else np.zeros(0, dtype=np.int64)
    arrays = []
    for values, kind in ((h2, "<u8"), (np.minimum(count, 2**32 - 1), "<u4"), (first, "<i8")):
        placed = np.empty(len(h1), dtype=kind)
        placed[slots] = values
        arrays.append(placed.tobytes())
    head = np.array([len(levels), *map(len, levels), len(h1)], dtype="<u4")
    return head.tobytes() + b"".join(x.tobytes() for x in levels) + b"".join(arrays)


class Shard:
    """Reads what :func:`pack_shard` wrote."""

    def __init__(self, packed: bytes):
        n = int(np.frombuffer(packed, "<u4", 1)[0])
        head = np.frombuffer(packed, "<u4", n + 2)
        at, levels = 4 * (n + 2), []
        for size in head[1 : n + 1].tolist():
            levels.append(np.frombuffer(packed, np.uint8, size, at))
            at += size
        keys = int(head[-1])
        self.hash = PerfectHash(levels)
        self.fingerprint = np.frombuffer(packed, "<u8", keys, at)
        self.count = np.frombuffer(packed, "<u4", keys, at + 8 * keys)
        self.first = np.frombuffer(packed, "<i8", keys, at + 12 * keys)

    def first_docs(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """First document of each hash, -1 shifted away: a mask of hits and the values."""
        slots = self.hash.slots(h1 ^ _mix(h2, 0))
        hit = slots >= 0
        hit[hit] = (self.fingerprint[slots[hit]] == h2[hit]) & (self.count[slots[hit]] >= 2)
        first = np.zeros(len(h1), dtype=np.int64)
        first[hit] = self.first[slots[hit]]
        return hit, first


def _doc_ids(batch, id_col: str) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column(batch, id_col)], dtype=np.int64)


def repeated_lines(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """``h1, h2, n, first`` of line hashes in at least two documents, counted map-side first."""

    def make():
        def f(batch):
            ids, found, owner = _doc_ids(batch, id_col), [], []
            for i, text in enumerate(column(batch, text_col)):
                hashes = set(line_keys(text, least)[2])
                found += hashes
                owner += [i] * len(hashes)
            if found:
                h = _words(found)
                yield [pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(ids[owner])]

        return f, None

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "doc")])
    seen = emit_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), make, schema)
    return seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")


def line_index(repeated: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The sharded index: rows ``shard, packed``, the number of shards, the bytes of all."""
    shards = max(1, -(-repeated.count() // shard_keys))

    def pack(key, rows):
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [int(key[0])], "packed": [pack_shard(h1, h2, rows["n"].to_numpy(), rows["first"].to_numpy())]})

    index = repeated.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards))).groupBy("shard").applyInPandas(pack, "shard long, packed binary")
    index = written(index, "line-index")
    return index, shards, index.agg(F.sum(F.length("packed"))).first()[0] or 0


def _shard_of(h2: np.ndarray, shards: int) -> np.ndarray:
    return h2.view(np.int64) % shards


def dedup_lines(docs: DataFrame, *, least: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = 64 << 20, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with repeated lines taken out, and ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of
    ``least`` code points or more found in two documents or more stay only in the
    document of smallest id (all its lines with the key). Null or empty texts are one
    empty line; a null text stays null. Rows sharing an id are one document; a null id
    comes after all others. Ids are integers. Columns named ``n_lines`` or
    ``n_dropped`` are replaced, others stay. Empty tables give empty results.
    ``broadcast_limit`` is in bytes of packed arrays; above it, shards are streamed.
    """
    docs = without(docs, "n_lines", "n_dropped")
    index, shards, size = line_index(written(repeated_lines(docs, least, id_col, text_col), "lines"), shard_keys)
    if size <= broadcast_limit:
        return _probe_broadcast(docs, index, shards, least, id_col, text_col)
    return _probe_streamed(docs, index, shards, least, id_col, text_col)


_ADDED = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def _rewritten(docs: DataFrame, text_col: str, make, inputs: DataFrame) -> DataFrame:
    done = map_columns(inputs, make, [T.StructField("_kept", T.StringType()), *_ADDED], docs.columns)
    return done.select(*[F.col("_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")


def _probe_broadcast(docs: DataFrame, index: DataFrame, shards: int, least: int, id_col: str, text_col: str) -> DataFrame:
    packed = docs.sparkSession.sparkContext.broadcast({r.shard: r.packed for r in index.collect()})

    def make():
        opened = {k: Shard(v) for k, v in packed.value.items()}

        def f(batch):
            ids, texts = _doc_ids(batch, id_col), column(batch, text_col)
            cut = [line_keys(t, least) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(c[1]) for c in cut])
            drop = np.zeros(len(owner), dtype=bool)
            if len(owner):
                h = _words([x for c in cut for x in c[2]])
                h1, h2 = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
                where = _shard_of(h2, shards)
                for s, shard in opened.items():
                    mine = np.flatnonzero(where == s)
                    hit, first = shard.first_docs(h1[mine], h2[mine])
                    drop[mine] = hit & (first != ids[owner[mine]])
            kept, sizes, dropped, at = [], [], [], 0
            for text, (lines, numbers, _) in zip(texts, cut):
                flags = drop[at : at + len(numbers)]
                at += len(numbers)
                gone = {n for n, x in zip(numbers, flags.tolist()) if x} if flags.any() else ()
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
                sizes.append(len(lines))
                dropped.append(len(gone))
            return [pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]

        return f

    return _rewritten(docs, text_col, make, docs)


def _probe_streamed(docs: DataFrame, index: DataFrame, shards: int, least: int, id_col: str, text_col: str, probes_each: int = 1 << 20) -> DataFrame:
    """Probes are dealt to (shard, part); each part's stream begins with the shard's arrays.

    A shard that many probes need is dealt in several parts, each with its own copy of
    the arrays, so a very common line does not gather in one task. Decisions come back
    as line numbers per document.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))

    def make():
        def f(batch):
            ids, keys = _doc_ids(batch, "_id"), column(batch, "_row")
            out, numbers, owner = [], [], []
            for i, text in enumerate(column(batch, text_col)):
                _, at, hashes = line_keys(text, least)
                out += hashes
                numbers += at
                owner += [i] * len(at)
            if out:
                h = _words(out)
                h2 = np.ascontiguousarray(h[:, 1])
                yield [pa.array(_shard_of(h2, shards)), pa.array(np.array(keys, dtype=np.int64)[owner]), pa.array(ids[owner]), pa.array(np.array(numbers, dtype=np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h2.view(np.int64))]

        return f, None

    schema = T.StructType.fromDDL("shard long, _row long, _id long, line int, h1 long, h2 long")
    probes = written(emit_rows(docs.select(key.alias("_row"), F.col(id_col).cast("long").alias("_id"), text_col).dropDuplicates(["_row"]), make, schema), "line-probes")
    parts = probes.groupBy("shard").agg(F.ceil(F.count("*") / probes_each).cast("int").alias("parts"))
    arrays = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    probes = probes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("_row", "line"), F.col("parts")).cast("int"))
    both = arrays.select("shard", "part", "packed").unionByName(probes.drop("parts"), allowMissingColumns=True)
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("packed").isNull())

    def answer(batches):
        shard = None
        for b in batches:
            packed = column(b, "packed")
            cuts = [i for i, x in enumerate(packed) if x is not None]
            for lo, hi in zip([0, *cuts], [*cuts, len(packed)]):
                if lo < hi and packed[lo] is not None:
                    shard, lo = Shard(packed[lo]), lo + 1
                if lo >= hi:
                    continue
                rows = b.slice(lo, hi - lo)
                get = lambda c: rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                hit, first = shard.first_docs(get("h1").view(np.uint64), get("h2").view(np.uint64))
                drop = hit & (first != get("_id"))
                yield pa.RecordBatch.from_arrays([pa.array(get("_row")[drop]), pa.array(get("line")[drop].astype(np.int32))], names=["_row", "line"])

    gone = dealt.mapInArrow(answer, "_row long, line int").groupBy("_row").agg(F.collect_set("line").alias("_gone"))
    keyed = docs.withColumn("_row", key).join(gone, "_row", "left")

    def rewrite():
        def f(batch):
            kept, sizes, dropped = [], [], []
            for text, numbers in zip(column(batch, text_col), column(batch, "_gone")):
                lines, out = (text or "").split("\n"), set(numbers or ())
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
                sizes.append(len(lines))
                dropped.append(len(out))
            return [pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())]

        return f

    return _rewritten(docs, text_col, rewrite, keyed)
