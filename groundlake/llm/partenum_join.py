"""N-gram Jaccard self-join with PartEnum signatures.

Linked sets of one size band differ in at most ``k`` elements. The feature domain is
partitioned into ``n1`` parts of ``n2`` parts each. As a difference of ``k`` cannot reach
``k2 + 1`` elements in every first-level part, some part holds ``k2`` of them at most, and
then ``n2 - k2`` of its second-level parts are equal in both sets. A set's signatures are
therefore all subsets of ``n2 - k2`` second-level parts of each first-level part, so that
linked sets share one for certain. Sets sharing a signature are compared exactly, first
with a few hubs of each group in rounds of linear size, then, where a group is still in
several components, block against block inside a task.

Before that, equal sets become one class, and a class stays in the join only if enough of
its prefix (under one global order of the features, common ones last) occurs in another
class' prefix, which any partner implies. Both steps lose nothing.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, row_hash, unused, written
from .components import components

U = np.uint64
SHINGLE = 5
NUM, DEN = 4, 5  # similarity of at least 4/5
COMMON = 1 << 17
SAMPLE_DOCS = 10_000
BROADCAST_ROWS = 1 << 20
#: Sets of one block (sketches are small, so that more fit), and bytes of its sets.
BLOCK = 256
SKETCHES = 2048
BLOCK_BYTES = 4 << 20
#: Rounds of hubs before groups are compared block against block.
ROUNDS = 2
#: Pairs of a block that are looked at together.
AT_ONCE = 1 << 17
_P = [U(2 * p + 1) for p in (0x4F1BBCDCBFA53E0A, 0x61C8864680B583EA, 0x0B2D8CB394F33CFC, 0x13F6A9780B3ABFE2, 0x42E1B56F3AF43A5D)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes; words are hashed once while remembered."""

    def __init__(self, width: int = SHINGLE, remember: int = 150_000):
        self.width, self.remember, self.known = width, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > self.remember:
            known.clear()
        ids = [known.get(w) for w in words]
        if None in ids:
            for i, w in enumerate(words):
                if ids[i] is None:
                    ids[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        n, width = len(ids), self.width
        if not n:
            return np.zeros(0, dtype=U)
        a = np.array(ids, dtype=U)
        if n < width:
            total = a[:1] * _P[0]
            for j in range(1, n):
                total = total + a[j : j + 1] * _P[j]
            return mix(total + U(n))
        total = a[: n - width + 1] * _P[0]
        for j in range(1, width):
            total = total + a[j : n - width + 1 + j] * _P[j % len(_P)]
        return np.unique(mix(total))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits naming a set, as two signed numbers."""
    h = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def prefix_shape(n: int) -> tuple[int, int]:
    """Prefix length of a set of ``n`` and how many of its elements a partner must share.

    A partner shares at least ceil(4n/5) elements, so of a prefix longer than n - that by
    j, at least j; a partner's own prefix may be shorter by the ratio of sizes.
    """
    share = -(-NUM * n // DEN)
    j = max(1, -(-n // 20))
    return min(n, n - share + j), max(1, -(-share // 20))


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles met in three or more of some ``SAMPLE_DOCS`` documents, at most ``COMMON``.

    They only go last in the global order; any order gives the same links.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    drawn = docs.filter(F.pmod(F.xxhash64(text_col, F.lit("order")), F.lit(1 << 30)) / float(1 << 30) < share)

    def make():
        shingler, seen = Shingler(), []

        def f(batch):
            for text in column(batch, text_col):
                seen.append(shingler(text))
            return ()

        def end():
            if seen:
                values, counts = np.unique(np.concatenate(seen), return_counts=True)
                yield [pa.array(values.view(np.int64)), pa.array(counts)]

        return f, end

    every = emit_rows(drawn.select(text_col), make, T.StructType.fromDDL("shingle long, n long"))
    top = every.groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "shingle").limit(COMMON)
    return np.sort(np.array([r["shingle"] for r in top.collect()], dtype=np.int64).view(U))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


_SCAN = "token long, set long, known int, add long, h2 long, row long, two long, doc long, n long"
_COUNTED = ["set", "add", "h2", "row", "two", "doc", "n"]


def scan_sets(docs: DataFrame, common: np.ndarray, text_col: str) -> DataFrame:
    """One pass over the texts: a row per document and the prefixes, combined batch by batch.

    A token that several classes of a batch hold is counted there and sent on once, so a
    token common to a large group costs a row per batch, not one per member.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        shingler, common = Shingler(), shared.value

        def f(batch):
            rows, two, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("_row", "_two", "_doc"))
            keys, sizes, tokens, owners = [], [], [], []
            for text in column(batch, text_col):
                s = shingler(text)
                keys.append(set_key(s))
                sizes.append(len(s))
                if len(s):
                    last = _is_in(s, common)
                    tokens.append(np.concatenate((s[~last], s[last]))[: prefix_shape(len(s))[0]])
                    owners.append(np.full(len(tokens[-1]), keys[-1][0], dtype=np.int64))
            n = len(keys)
            none = lambda k, kind: pa.nulls(k, kind)
            h1 = pa.array([k[0] for k in keys], pa.int64())
            yield [rows, h1, none(n, pa.int32()), none(n, pa.int64()), pa.array([k[1] for k in keys], pa.int64()), rows, two, ids, pa.array(sizes, pa.int64())]
            if not tokens:
                return
            token, owner = np.concatenate(tokens).view(np.int64), np.concatenate(owners)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[new], owner[new]
            start = np.ones(len(token), dtype=bool)
            start[1:] = token[1:] != token[:-1]
            group = np.cumsum(start) - 1
            many = np.bincount(group) > 1
            inside = many[group]
            k = int(start.sum())
            yield [pa.array(token[start]), pa.array(owner[start]), pa.array(many.astype(np.int32)), *[none(k, pa.int64())] * 6]
            if inside.any():
                sets, counts = np.unique(owner[inside], return_counts=True)
                k = len(sets)
                yield [pa.array(sets), pa.array(sets), none(k, pa.int32()), pa.array(counts), *[none(k, pa.int64())] * 5]

        return f, None

    return emit_rows(docs.select("_row", "_two", "_doc", text_col), make, T.StructType.fromDDL(_SCAN), rows=4096)


def _count_shared(batches):
    """Over rows sorted by token and set: adds one to every set of a token that two sets hold.

    Only the last token and set are carried from batch to batch, and whether another set
    has the token, so a token of any number of sets takes no memory.
    """
    kinds = [pa.int64()] * len(_COUNTED)
    carry, held_before = None, False
    for b in chain(batches, [None]):
        if b is not None:
            get = lambda c: b.column(b.schema.get_field_index(c))
            other = get("known").is_null()
            if (passing := b.filter(other)).num_rows:
                yield pa.RecordBatch.from_arrays([passing.column(passing.schema.get_field_index(c)) for c in _COUNTED], names=_COUNTED)
            rows = b.filter(pa.compute.invert(other))
            token, owner, known = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("token", "set", "known"))
            if carry is not None:
                token, owner, known = (np.concatenate(x) for x in zip(carry, (token, owner, known)))
        elif carry is None:
            return
        else:
            token, owner, known = carry
        if not len(token):
            continue
        pair = np.ones(len(token), dtype=bool)
        pair[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(pair)
        token, owner, known = token[at], owner[at], np.maximum.reduceat(known, at)
        start = np.ones(len(token), dtype=bool)
        start[1:] = token[1:] != token[:-1]
        group = np.cumsum(start) - 1
        held = (np.bincount(group) > 1) | (np.maximum.reduceat(known, np.flatnonzero(start)) > 0)
        held[0] |= held_before
        end = len(token) - (b is not None)
        found = owner[:end][held[group[:end]] & (known[:end] == 0)]
        if len(found):
            sets, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(counts), *[pa.nulls(len(sets), k) for k in kinds[2:]]], names=_COUNTED)
        carry, held_before = (token[end:], owner[end:], known[end:]), bool(held[-1])


def bands(n: int) -> list[tuple[int, int]]:
    """``(level, k)`` of the size bands a set of ``n`` has signatures in: as the smaller set, as the larger."""
    lo, level, below = 1, 0, None
    while True:
        hi = max(lo + 1, (5 * (lo - 1)) // 4 + 1)
        top = hi - 1
        k = (top + (5 * top) // 4) // 9
        if n < hi:
            return [(level, k)] + ([below] if below else [])
        below, lo, level = (level, k), hi, level + 1


#: First-level parts beyond those that a difference of k needs: so many parts agree, one more, in linked sets.
SPARE = 2


def layout(k: int) -> tuple[int, int, int]:
    """``(n1, n2, k2)``: parts, parts within each, and how many of these may differ."""
    if k < 4:
        return k + 1 + SPARE, 1, 0
    return k // 2 + 1 + SPARE, 4, 1


_memo: dict[int, list[tuple]] = {}
#: The low bits of a signature tell its size band.
TAG_BITS = 10


def signatures(shingles: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set of hashed elements.

    In ``n1 - k // (k2 + 1)`` parts at least, linked sets share a signature. Signatures
    without elements are left out if a set has them in fewer parts than that: then a
    part remains in which what it shares has elements, whatever the partner leaves out.
    Sets with more of them (tiny ones) keep all.
    """
    n = len(shingles)
    plan = _memo.get(n)
    if plan is None:
        plan = []
        for level, k in bands(n):
            if k > 0:
                n1, n2, k2 = layout(k)
                subsets = np.array([np.isin(np.arange(n2), x) for x in combinations(range(n2), n2 - k2)]).T
                salt = U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                plan.append((level, n1, n2, n1 - k // (k2 + 1), subsets.astype(U), salt, mix(np.arange(1, n1 * n2 + 1, dtype=U) * U(0xD6E8FEB86659FD93) + salt)))
        _memo[n] = plan
    out = [np.zeros(0, dtype=U)]
    for level, n1, n2, agree, subsets, salt, names in plan:
        spread = mix(shingles + salt)
        slot = (spread % U(n1 * n2)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        at = np.searchsorted(slot[order], np.arange(n1 * n2 + 1))
        total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(spread[order], dtype=U)))
        part = mix(total[at[1:]] - total[at[:-1]] + names).reshape(n1, n2)
        sums = (part[:, :, None] * subsets).sum(1, dtype=U)
        h = mix(sums + np.arange(1, subsets.shape[1] + 1, dtype=U) * salt)
        h = h >> U(TAG_BITS) << U(TAG_BITS) | U(level)
        some = np.diff(at).reshape(n1, n2) @ subsets.astype(np.int64) > 0
        out.append(h[some] if int((~some).any(1).sum()) < agree else h.ravel())
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the elements over 8 n bins or more, a power of two, as packed bits.

    Two sets differ in as many elements at least as their sketches do in bits; a longer
    sketch folds to a shorter one.
    """
    bits = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    odd = np.bincount(((shingles >> U(20)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def near_pairs(sizes: np.ndarray, sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a[i], b[i]`` of sets may link, by sizes and sketches; no linked pair is missed."""
    ok = NUM * np.maximum(sizes[a], sizes[b]) <= DEN * np.minimum(sizes[a], sizes[b])
    width = np.array([len(x) // 8 for x in sketches])
    held = {w: np.frombuffer(b"".join(x for x in sketches if len(x) == 8 * w), dtype=U).reshape(-1, w) for w in np.unique(width).tolist()}
    place = np.zeros(len(width), dtype=np.int64)
    for w in held:
        place[width == w] = np.arange(len(held[w]))
    for u in held:
        for v in held:
            at = np.flatnonzero(ok & (width[a] == u) & (width[b] == v))
            w = min(u, v)
            x, y = _folded(held[u], w), _folded(held[v], w)
            step = max(1, (1 << 20) // w)
            for lo in range(0, len(at), step):
                i = at[lo : lo + step]
                differ = np.bitwise_count(x[place[a[i]]] ^ y[place[b[i]]]).sum(1, dtype=np.int64)
                ok[i] = (DEN + NUM) * differ <= sizes[a[i]] + sizes[b[i]]
    return ok


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by matrix products over their elements."""
    sizes = [len(x) for x in (*left, *right)]
    flat, owner = np.concatenate([*left, *right]), np.repeat(np.arange(len(sizes)), sizes)
    values, name = np.unique(flat, return_inverse=True)
    first = owner < len(left)
    met = (np.bincount(name[first], minlength=len(values)) > 0) & (np.bincount(name[~first], minlength=len(values)) > 0)
    name, owner = (np.cumsum(met) - 1)[name[met[name]]], owner[met[name]]
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, int(met.sum()), 4096):
        part = slice(*np.searchsorted(name, (lo, lo + 4096)))
        held = np.zeros((len(sizes), 4096), dtype=np.float32)
        held[owner[part], name[part] - lo] = 1
        both += np.rint(held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return both


def _cells(rows: DataFrame, sets: DataFrame, carried: str, size: F.Column, block: int) -> DataFrame:
    """``unit, i, j, x, set, label, n, <carried>``: all pairs of blocks of each unit's sets, sorted.

    ``rows`` has ``unit, set, label, n``. A unit's sets are dealt to blocks of some
    ``block`` sets or ``BLOCK_BYTES``, and each pair of blocks is one small group.
    """
    sizes = rows.groupBy("unit").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks"))
    x = F.pmod(F.xxhash64("set", F.lit("block")), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "unit").withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("unit", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "set", "label", "n")
    return cells.join(sets.select("set", carried), "set").select("unit", "i", "j", "x", "set", "label", "n", carried).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "x")


def _whole_cells(batches):
    """The same rows as tables that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            part = whole.slice(at, 2048)
            cell = np.column_stack([part.column(c).to_numpy() for c in range(3)])
            new = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            before = [c[held[-1].num_rows - 1].as_py() for c in held[-1].columns[:3]] if held else []
            if held and before != cell[0].tolist():
                yield pa.Table.from_batches(held)
                held = []
            end = int(new[-1]) if len(new) else 0
            if end:
                yield pa.Table.from_batches([*held, part.slice(0, end)])
                held = []
            held.append(part.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _near_across(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of sets of one unit and different labels that may link by their sketches."""

    def run(batches):
        for t in _whole_cells(batches):
            unit, i, j, x, ids, label, size = (t.column(c).to_numpy() for c in range(7))
            ids, at = np.unique(ids, return_inverse=True)
            first = np.zeros(len(ids), dtype=np.int64)
            first[at] = np.arange(len(at))
            sketches, sizes, n = t.column(7).take(pa.array(first)).to_pylist(), size[first], len(at)
            new = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            ends = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
            pairs = ends - np.arange(n) - 1
            cut = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + AT_ONCE, AT_ONCE))
            for lo, hi in zip(cut[:-1], cut[1:]):
                r = np.arange(lo, hi if hi < cut[-1] else n)
                if not (total := int(pairs[r].sum())):
                    continue
                a = np.repeat(r, pairs[r])
                b = a + 1 + np.arange(total) - np.repeat(np.cumsum(pairs[r]) - pairs[r], pairs[r])
                fit = (label[a] != label[b]) & ((i[a] == j[a]) | (x[a] != x[b]))
                a, b = at[a[fit]], at[b[fit]]
                key = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
                a, b = key // len(ids), key % len(ids)
                ok = near_pairs(sizes, sketches, a, b)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]])], names=["a", "b"])

    return _cells(rows, sets, "sketch", F.col("n") * 2, SKETCHES).mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, *, near: bool = False) -> DataFrame:
    """The pairs ``a, b`` that link; unless they are known to be near, sizes and sketches go first."""
    schema = T.StructType.fromDDL("a long, b long")
    if not near:
        light = sets.select("set", "n", "sketch")
        sized = pairs.join(light.toDF("a", "na", "xa"), "a").join(light.toDF("b", "nb", "xb"), "b").filter(F.greatest("na", "nb") * NUM <= F.least("na", "nb") * DEN)

        def close():
            def f(batch):
                k = batch.num_rows
                sizes = np.array(column(batch, "na") + column(batch, "nb"))
                ok = near_pairs(sizes, column(batch, "xa") + column(batch, "xb"), np.arange(k), k + np.arange(k))
                part = batch.filter(pa.array(ok))
                yield [part.column(part.schema.get_field_index(c)) for c in ("a", "b")]

            return f, None

        pairs = written(emit_rows(sized, close, schema, rows=2048), "join-candidates")
    whole = sets.select("set", "shingles")
    full = pairs.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")

    def exact():
        def f(batch):
            ok = [similar(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)) for x, y in zip(column(batch, "sa"), column(batch, "sb"))]
            part = batch.filter(pa.array(ok, pa.bool_()))
            yield [part.column(part.schema.get_field_index(c)) for c in ("a", "b")]

        return f, None

    return written(emit_rows(full, exact, schema), "join-links")


def _pair(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _joining_links(needed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links enough for the components, and ``node, root`` of all linked sets.

    A round compares each set of a group with one hub, or two: the first round with the
    group's first set, the next ones, in groups still in several components, sets
    outside the largest of these with a set of it and with one set outside. What is
    left, groups whose sets truly do not all link, is compared block against block, and
    only pairs across components can add a link.
    """
    hubs = needed.groupBy("sig").agg(F.min("set").alias("hub"), F.count("*").alias("m"))
    starred = needed.join(hubs, "sig").filter("set <> hub")
    links = _verify(starred.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct(), sets)
    open_ = starred.filter("m > 2").select("sig", "set")  # a hub has met all others
    fresh, roots = links, None
    for r in range(1, ROUNDS + 1):
        roots = components(fresh, roots)
        named = open_.join(roots.withColumnRenamed("node", "set"), "set", "left").select("sig", "set", F.coalesce("root", "set").alias("root"))
        split = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("sig")
        named = written(named.join(split, "sig"), "join-open")
        open_ = named.drop("root")
        if r == ROUNDS or not named.take(1):
            break
        turn = F.xxhash64("set", F.lit(r))
        first = named.groupBy("sig", "root").agg(F.count("*").alias("m"), F.min_by("set", turn).alias("hub"))
        main = first.groupBy("sig").agg(F.max_by(F.struct("root", "hub"), F.struct("m", "root")).alias("main"))
        outside = named.join(main, "sig").filter("root <> main.root")
        other = outside.groupBy("sig").agg(F.min_by(F.struct("root", "set"), turn).alias("other"))
        pairs = outside.select("set", F.col("main.hub").alias("hub")).unionByName(
            outside.join(other, "sig").filter("root <> other.root").select("set", F.col("other.set").alias("hub"))
        )
        fresh = _verify(pairs.select(*_pair("set", "hub")).distinct(), sets)
        links = links.unionByName(fresh)
    if not named.take(1):
        return links, roots

    rows = named.join(sets.select("set", "n"), "set").select(F.col("sig").alias("unit"), "set", F.col("root").alias("label"), "n")
    more = _verify(written(_near_across(rows, sets), "join-candidates"), sets, near=True)
    if more.take(1):
        links = links.unionByName(more)
        roots = components(more, roots)
    return links, roots


def _link_counts(roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``set, n_links``: all links of each set; they are all inside its component.

    Blocks are compared by matrix products in a task; no pair becomes a row.
    """

    def run(batches):
        for t in _whole_cells(batches):
            cell = np.column_stack([t.column(c).to_numpy() for c in range(3)])
            new = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(1))))
            for lo, hi in zip(new.tolist(), np.append(new[1:], len(cell)).tolist()):
                part = t.slice(lo, hi - lo)
                (_, i, j), x, ids = cell[lo], part.column(3).to_numpy(), part.column(4).to_numpy()
                held = [np.frombuffer(v, dtype=U) for v in part.column(7).to_pylist()]
                left, right = np.flatnonzero(x == i), np.flatnonzero(x == j)
                if not len(left) or not len(right):
                    continue
                sizes = np.array([len(v) for v in held])
                links = (DEN + NUM) * overlaps([held[k] for k in left], [held[k] for k in right]) >= NUM * (sizes[left][:, None] + sizes[right])
                if i == j:
                    np.fill_diagonal(links, False)
                    found = ids[left], links.sum(1)
                else:
                    found = np.concatenate((ids[left], ids[right])), np.concatenate((links.sum(1), links.sum(0)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["set", "n_links"])

    rows = roots.join(sets.select("set", "n"), roots["node"] == sets["set"]).select(F.col("root").alias("unit"), "set", F.col("root").alias("label"), "n")
    return _cells(rows, sets, "shingles", F.col("n") * 8, BLOCK).mapInArrow(run, "set long, n_links long").groupBy("set").agg(F.sum("n_links").alias("n_links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, every_link: bool) -> DataFrame:
    """``doc, row, two, n, set, n_links, component, root`` of every row; null ids count as the last."""
    keyed = docs.select(row_hash(docs, 0).alias("_row"), row_hash(docs, 1).alias("_two"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_doc"), F.col(text_col).alias("_text"))
    common = common_shingles(keyed, "_text")
    scanned = scan_sets(keyed, common, "_text").repartition("token").sortWithinPartitions("token", "set")
    parts = written(scanned.mapInArrow(_count_shared, ", ".join(f"{c} long" for c in _COUNTED)), "join-scan")

    members = parts.filter("row IS NOT NULL").drop("add")
    same = members.filter("n > 0").groupBy("set", "h2").agg(F.min("doc").alias("doc"), F.min_by(F.struct("row", "two"), "doc").alias("at"), F.first("n").alias("n"))
    # a set is named by 64 bits, unless another has the same
    nth = F.row_number().over(Window.partitionBy("set").orderBy("h2"))
    classes = written(same.withColumn("node", F.when(nth == 1, F.col("set")).otherwise(F.col("h2"))), "join-classes")
    counted = parts.filter("add IS NOT NULL").groupBy("set").agg(F.sum("add").alias("add"))
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * NUM / DEN) / 20))
    kept = written(classes.join(counted, "set").filter(F.col("add") >= least).select("node", "at.*"), "join-kept")

    rows = kept.select(F.col("row").alias("_row"), F.col("two").alias("_two"), F.col("node").alias("set"))
    if kept.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)  # 24 MB at most
    texts = keyed.join(rows, ["_row", "_two"]).select("set", "_text").dropDuplicates(["set"])

    def make():
        shingler = Shingler()

        def f(batch):
            out: list[list] = [[], [], [], []]
            for text in column(batch, "_text"):
                s = shingler(text)
                for held, x in zip(out, (len(s), sketch(s), s.tobytes(), signatures(s).view(np.int64))):
                    held.append(x)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield [batch.column(batch.schema.get_field_index("set")), *[pa.array(x, k) for x, k in zip(out, kinds)]]

        return f, None

    schema = T.StructType.fromDDL("set long, n long, sketch binary, shingles binary, sigs array<long>")
    sets = written(emit_rows(texts, make, schema, rows=256), "join-sets")

    signed = sets.select("set", F.explode("sigs").alias("sig"))
    met = signed.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1").select("sig")
    links, roots = _joining_links(written(signed.join(met, "sig"), "join-needed"), sets)

    of = classes.select("set", "h2", "doc", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of.groupBy("root").agg(F.min("doc").alias("component"))
    of = of.join(named, "root").select("set", "h2", "node", "root", "component")
    if every_link:
        of = of.join(_link_counts(roots, sets).withColumnRenamed("set", "node"), "node", "left")
    else:
        of = of.withColumn("n_links", F.lit(0).cast("long"))
    out = members.join(of, ["set", "h2"], "left")
    return out.select("doc", "row", "two", "n", F.col("node").alias("set"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "doc").alias("component"), "root")


#: Rows without an id come after all others.
LAST = (1 << 63) - 1


def similarity_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, row_hash, row_hash_2, n_shingles, set_id, n_links, component_id`` for every row of ``docs``.

    Links: Jaccard similarity of the sets of distinct five-word shingles (fewer words:
    the whole sequence is one) of at least 4/5; words are lower-cased (A-Z). A component
    is named by its smallest id. Texts without words, and null texts, have no shingles
    and are linked with nothing. ``set_id`` is equal for equal sets, which link; it is
    null for empty ones. ``n_links`` counts all other sets linked to a row's set. Rows
    sharing an id are rows like others; ids are integers, null ids name no component
    unless alone in it (then it is null). Other columns only tell rows apart, by 128 bits;
    empty tables give none.
    """
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return _classes(docs, id_col, text_col, True).select(
        real("doc").alias(id_col), F.col("row").alias("row_hash"), F.col("two").alias("row_hash_2"), F.col("n").alias("n_shingles"), F.col("set").alias("set_id"), "n_links", real("component").alias("component_id")
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per component: the one of smallest id (null ids last, then of smallest hash).

    Rows without words link with nothing, so all of them stay, equal ones included; of
    other rows equal in everything one stays. Columns are unchanged.
    """
    found = written(_classes(docs, id_col, text_col, False).filter("n > 0").select("root", "doc", "row", "two"), "join-result")
    first = found.groupBy("root").agg(F.min(F.struct("doc", "row", "two")).alias("m"))
    marked = found.join(first, "root").withColumn("kept", (F.col("row") == F.col("m.row")) & (F.col("two") == F.col("m.two")))
    keys = marked.select(F.col("row").alias("_row"), F.col("two").alias("_two"), "kept")
    gone = written(keys.filter(~F.col("kept")).drop("kept").distinct(), "join-gone")
    twins = written(keys.filter("kept").groupBy("_row", "_two").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "join-twins")
    keys = unused(docs, "_row", "_two")
    named = dict(zip(("_row", "_two"), keys))
    left = docs.withColumns({k: row_hash(docs, seed) for seed, k in enumerate(keys)}).join(gone.withColumnsRenamed(named), keys, "left_anti")
    if twins.take(1):
        twins = twins.withColumnsRenamed(named)
        left = left.join(twins, keys, "left_anti").unionByName(left.join(twins, keys, "left_semi").dropDuplicates(keys))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
