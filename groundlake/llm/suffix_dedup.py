"""Removal of repeated byte strings by suffix arrays over shards of shared windows.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the
corpus. Every such string has one anchor: the 32-byte gram of least hash in it, so equal
strings have equal anchors at equal offsets. Strings are grouped by anchor: grams that
occur once are dropped, and the text around each of the others (the starts whose string
it anchors, and the bytes these strings cover) is dealt to a shard by the gram's hash.
A shard's windows are suffix-sorted by induction, permuted common prefixes cut the order
into classes of equal strings, and all but the first start of a class is covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collect_blobs, column, emit_rows, map_columns, row_hash, without, written
from .induced_sort import permuted_prefixes, suffix_array

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1
BLOCK = 1 << 22
SHARD_BYTES = 1 << 20
#: Bytes of a table that may be broadcast; beyond it rows are joined.
LIMIT = 64 << 20
U = np.uint64
_TABLE = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every 32-byte gram, by doubling."""
    h, width = _TABLE[data], 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> U(31))) * U(0x7FB5D329728EA185 + 2 * width) + h[width:]
        width *= 2
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: gram hash, first start and number of the starts it anchors.

    Of the grams of a string the one of least hash anchors it, the leftmost of equals;
    starts with one anchor are consecutive.
    """
    out = []
    last = len(data) - LENGTH
    for lo in range(0, last + 1, BLOCK):
        part = data[lo : min(len(data), lo + BLOCK + LENGTH - 1)]
        h = gram_hashes(part)
        key = (h & U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=U)
        low, width = key, 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = REACH - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        at = (low[first] & U(0xFFFFFF)).astype(np.int64)
        out.append((h[at], first + lo, np.diff(np.append(first, len(low)))))
    if not out:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors of two different texts, or of two places in one: ``anchor``. Equal texts count once."""

    def make():
        def f(batch):
            found, owners = [], []
            for text, key in zip(column(batch, "_text"), column(batch, "_class")):
                h, _, _ = anchors(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))
                if len(h):
                    h, n = np.unique(h, return_counts=True)
                    found.append(np.concatenate((h, h[n > 1])))
                    owners += [np.full(len(h), key), np.full(int((n > 1).sum()), ~key)]
            if found:
                h, own = np.concatenate(found), np.concatenate(owners).astype(np.int64)
                order = np.argsort(h, kind="stable")
                h, own = h[order], own[order]
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                yield [pa.array(h[at].view(np.int64)), pa.array(np.minimum.reduceat(own, at)), pa.array(np.maximum.reduceat(own, at))]

        return f, None

    rows = emit_rows(docs.select("_text", "_class"), make, T.StructType.fromDDL("anchor long, lo long, hi long"), rows=4096)
    return rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("anchor")


_WINDOW = "anchor long, doc long, tie long, row long, start long, own int, bytes binary"


def _window_rows(text: str | None, keep) -> list[tuple[int, int, int, bytes]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    h, first, own = anchors(np.frombuffer(raw, dtype=np.uint8))
    at = np.flatnonzero(keep(h)) if len(h) else ()
    return [(int(h[i].view(np.int64)), int(first[i]), int(own[i]), raw[first[i] : first[i] + own[i] + LENGTH - 1]) for i in at]


def _emit_windows(batch, texts, keeps):
    """Windows of a batch's shared anchors; of equal ones only the earliest, the others are covered."""
    meta = list(zip(*[column(batch, c) for c in ("_doc", "_tie", "_row")]))
    order = sorted(range(len(texts)), key=lambda i: meta[i])
    seen: dict[tuple[int, bytes], None] = {}
    out: list[list] = [[] for _ in range(7)]
    covered: dict[int, list[tuple[int, int]]] = {}
    for i in order:
        for anchor, start, own, raw in _window_rows(texts[i], keeps[i]):
            if (anchor, raw) in seen:
                covered.setdefault(i, []).append((start, start + own + LENGTH - 1))
                continue
            seen[anchor, raw] = None
            for column_, value in zip(out, (anchor, *meta[i], start, own, raw)):
                column_.append(value)
    for i, spans in covered.items():
        flat = np.array(merge_spans(spans), dtype="<i8").tobytes()
        for column_, value in zip(out, (None, *meta[i], 0, 0, flat)):
            column_.append(value)
    if out[0]:
        yield [pa.array(x, k) for x, k in zip(out, (*[pa.int64()] * 5, pa.int32(), pa.binary()))]


def windows(docs: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    """Windows around shared anchors; rows without anchor carry spans already known to be covered."""
    schema = T.StructType.fromDDL(_WINDOW)
    columns = ["_doc", "_tie", "_row", "_text"]
    if shared.count() * 8 <= limit:
        table = np.sort(np.frombuffer(b"".join(x for (x,) in collect_blobs(shared, "anchor")), dtype=U))
        given = docs.sparkSession.sparkContext.broadcast(table)

        def make():
            table = given.value
            keep = (lambda h: table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h) if len(table) else (lambda h: np.zeros(len(h), dtype=bool))

            def f(batch):
                texts = column(batch, "_text")
                yield from _emit_windows(batch, texts, [keep] * len(texts))

            return f, None

        return emit_rows(docs.select(columns), make, schema, rows=2048)

    def grams():
        def f(batch):
            for text, row in zip(column(batch, "_text"), column(batch, "_row")):
                h = np.unique(anchors(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))[0])
                if len(h):
                    yield [pa.array(h.view(np.int64)), pa.array(np.full(len(h), row))]

        return f, None

    of_rows = emit_rows(docs.select("_text", "_row"), grams, T.StructType.fromDDL("anchor long, _row long")).join(shared, "anchor", "left_semi")
    held = of_rows.groupBy("_row").agg(F.collect_set("anchor").alias("_anchors"))

    def make_joined():
        def f(batch):
            sets = [np.array(x, dtype=np.int64).view(U) for x in column(batch, "_anchors")]
            yield from _emit_windows(batch, column(batch, "_text"), [lambda h, s=s: np.isin(h, s) for s in sets])

        return f, None

    return emit_rows(docs.select(columns).join(held, "_row"), make_joined, schema, rows=2048)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, touching ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def sort_shard(parts: list[bytes], own: list[int]) -> list[np.ndarray]:
    """For each window (earliest first) its starts whose string an earlier start has."""
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sa = suffix_array(text)
    shared = permuted_prefixes(text, sa)
    group = np.cumsum(shared[sa] < LENGTH)
    mine = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(mine, begin, 1)
    np.add.at(mine, begin + np.array(own), -1)
    owned = np.cumsum(mine[:-1]) > 0
    keep = owned[sa]
    place, group = sa[keep], group[keep]
    order = np.lexsort((place, group))
    place, group = place[order], group[order]
    later = np.concatenate(([False], group[1:] == group[:-1]))
    covered = np.sort(place[later])
    which = np.searchsorted(begin, covered, side="right") - 1
    cut = np.searchsorted(which, np.arange(len(parts) + 1))
    return [covered[cut[i] : cut[i + 1]] - begin[i] for i in range(len(parts))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Spans covered by strings at sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    lo = starts[np.concatenate(([0], gap + 1))]
    hi = starts[np.concatenate((gap, [len(starts) - 1]))] + LENGTH
    return list(zip(lo.tolist(), hi.tolist()))


def _sort_shards(batches):
    """Over windows sorted by anchor, then place: spans covered in each row.

    Whole anchors are gathered until a shard is full. Equal windows of an anchor are
    kept once; later ones are covered as a whole, as soon as they come.
    """
    names = ["row", "spans"]
    held: list[tuple] = []
    size, anchor = 0, None
    seen: dict[bytes, None] = {}

    def flush():
        order = sorted(range(len(held)), key=lambda i: held[i][:4])
        got = sort_shard([held[i][5] for i in order], [held[i][4] for i in order])
        rows = [(held[i][2], held[i][3], s) for i, s in zip(order, got) if len(s)]
        if rows:
            spans = [np.array(_runs(s + start), dtype="<i8").tobytes() for _, start, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, pa.binary())], names=names)

    for batch in batches:
        rows, spans = [], []
        for a, doc, tie, row, start, own, raw in zip(*[column(batch, c) for c in ("anchor", "doc", "tie", "row", "start", "own", "bytes")]):
            if a is None:
                rows.append(row)
                spans.append(raw)
                continue
            if a != anchor:
                anchor, seen = a, {}
                if size >= SHARD_BYTES:
                    yield from flush()
                    held, size = [], 0
            if raw in seen:
                rows.append(row)
                spans.append(np.array([start, start + own + LENGTH - 1], dtype="<i8").tobytes())
                continue
            seen[raw] = None
            held.append((doc, tie, row, start, own, raw))
            size += len(raw)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.binary())], names=names)
    if held:
        yield from flush()


def _covered(docs: DataFrame, spans: DataFrame, limit: int, make, fields, carry: list[str]) -> DataFrame:
    """Columns made by ``make(lookup)`` where ``lookup(batch)`` gives each row's covered spans."""
    size = spans.agg(F.sum(F.length("spans") + 40)).first()[0] or 0
    if size <= limit:
        sized = spans.withColumn("size", F.length("spans").cast("long"))
        parts = collect_blobs(sized, "row", "size", "spans")
        rows = np.frombuffer(b"".join(p[0] for p in parts), dtype="<i8")
        ends = np.cumsum(np.frombuffer(b"".join(p[1] for p in parts), dtype="<i8"))
        order = np.argsort(rows)
        given = docs.sparkSession.sparkContext.broadcast((rows[order], np.concatenate(([0], ends))[order], ends[order], b"".join(p[2] for p in parts)))

        def broadcast_make():
            rows, start, end, flat = given.value

            def lookup(batch):
                wanted = np.array(column(batch, "_row"), dtype=np.int64)
                if not len(rows):
                    return [b""] * len(wanted)
                at = np.minimum(np.searchsorted(rows, wanted), len(rows) - 1)
                return [flat[start[i] : end[i]] if hit else b"" for i, hit in zip(at.tolist(), (rows[at] == wanted).tolist())]

            return make(lookup)

        return map_columns(docs, broadcast_make, fields, carry)
    joined = docs.join(spans.withColumnRenamed("row", "_row").withColumnRenamed("spans", "_spans"), "_row", "left")
    return map_columns(joined, lambda: make(lambda batch: [x or b"" for x in column(batch, "_spans")]), fields, carry)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``kept`` (bytes), ``removed`` (spans ``start, end``), ``n_bytes``.

    Earlier means smaller id, then (rows sharing an id) a hash of the text, then an
    earlier start; null ids come last; of fully equal rows one is first. Null texts are
    empty. Matches never cross documents; texts shorter than 100 bytes keep all. Strings
    are judged on the input. Columns of these names are replaced, others stay; an empty
    table gives an empty result. Ids are integers. ``limit`` bounds, in bytes, what is
    broadcast (shared anchors; covered spans); above it both are joined.
    """
    docs = without(docs, "kept", "removed", "n_bytes", "_class", "_doc", "_tie", "_row", "_first", "_text", "_check")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({
        "_text": text,
        "_class": F.xxhash64(text),
        "_check": F.xxhash64(F.lit(1), text),
        "_doc": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
        "_row": row_hash(docs, 0),
    }).withColumn("_tie", F.col("_class"))
    # of equal texts the earliest stands for all; the rest go whole
    short = keyed.select("_class", F.length(F.col("_text").cast("binary")).alias("_n"), "_doc", "_row", "_check")
    classes = short.groupBy("_class", "_check").agg(F.min(F.struct("_doc", "_row")).alias("m"), F.count("*").alias("c"), F.first("_n").alias("_n"))
    many = written(classes.filter(F.col("c") > 1).select("_class", "_check", F.col("m._row").alias("_first"), "_n"), "repeat-copies")
    shared = written(shared_anchors(keyed), "repeat-anchors")
    copies = short.join(many.drop("_n"), ["_class", "_check"])
    same = written(copies.filter(F.col("_row") == F.col("_first")).groupBy("_row").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("_row").alias("row"), F.col("k")), "repeat-twins")
    twins = same.limit(1).count() > 0
    # rows equal in everything: only one of them can be the first
    found = windows(keyed.dropDuplicates(["_row"]) if twins else keyed, shared, limit)
    dealt = found.repartition(F.coalesce("anchor", "row")).sortWithinPartitions("anchor", "doc", "tie", "row", "start")
    pieces = written(dealt.mapInArrow(_sort_shards, "row long, spans binary"), "repeat-spans")
    joined = pieces.groupBy("row").agg(F.collect_list("spans").alias("parts"))

    def merged():
        def f(batch):
            out = []
            for parts in column(batch, "parts"):
                flat = np.frombuffer(b"".join(parts), dtype="<i8").reshape(-1, 2)
                out.append(np.array(merge_spans(flat.tolist()), dtype="<i8").tobytes())
            return [pa.array(out, pa.binary())]

        return f

    spans = map_columns(joined, merged, [T.StructField("spans", T.BinaryType())], ["row"])
    whole = copies.filter((F.col("_row") != F.col("_first")) & (F.col("_n") >= LENGTH)).select(F.col("_row").alias("row"), F.lit(True).alias("whole")).distinct()
    table = spans.join(whole, "row", "full_outer").select("row", F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("spans")).alias("spans"))
    mark = F.when(F.length("spans") == 0, F.lit(b"*")).otherwise(F.col("spans"))
    table = written(table.select("row", mark.alias("spans")), "repeat-table")
    base = keyed
    if twins:
        counted = keyed.join(same.withColumnRenamed("row", "_row"), "_row", "left")
        nth = F.when(F.col("k") > 1, F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).otherwise(1)
        base = counted.withColumn("_row", F.when(nth > 1, F.lit(0)).otherwise(F.col("_row"))).drop("k")
        # the twins of a first row go whole, like other copies, under the reserved row 0
        table = table.filter("row <> 0").unionByName(docs.sparkSession.createDataFrame([(0, bytearray(b"*"))], "row long, spans binary"))
    fields = [T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.StructType.fromDDL("start long, end long"))), T.StructField("n_bytes", T.LongType())]

    def make(lookup):
        def f(batch):
            kept, removed, sizes = [], [], []
            for text, flat in zip(column(batch, "_text"), lookup(batch)):
                raw = text.encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                if flat == b"*":
                    gone = [(0, len(raw))] if len(raw) >= LENGTH else []
                else:
                    gone = [tuple(x) for x in np.frombuffer(flat, dtype="<i8").reshape(-1, 2).tolist()]
                at, parts = 0, []
                for lo, hi in gone:
                    parts.append(raw[at:lo])
                    at = hi
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                removed.append([{"start": a, "end": b} for a, b in gone])
            return [pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sizes, pa.int64())]

        return f

    return _covered(base, table, limit, make, fields, docs.columns)
