"""Prefix trie of conversations by Patricia construction.

Conversations are sorted by their turns; neighbours' common prefixes give the branch
points, so that only branch, end and leaf points are made, with compressed edges between
them. Counts, leaves and savings are summed up on the compressed tree; the unary nodes
inside an edge follow from suffix sums along it.

A turn is known by 16 bytes (MD5 of role and text), a prefix by its turns' bytes. A long
conversation is cut into pieces of ``PIECE`` turns, whose tries are built level by level
from the deepest, so no row or group grows with a conversation. The sorted pieces of a
level lie in ranges that tasks build on their own. What two neighbouring ranges share is a
path (a *seam*), and only its nodes are added up across tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, column, emit_rows, map_columns, written

#: Turns of a piece; bytes of a turn's key; SHA-256 of the empty text.
PIECE, KEY = 256, 16
EMPTY = hashlib.sha256(b"").hexdigest()

#: Bytes of decimal ids in a row on their way to a digest.
BLOCK = 1 << 16

_OUT = "conv long, depth int, parent long, n long, children long, leaves long, saved long, ends string, s1 long, s2 long, pkey binary, skey binary, word long, top long, chain array<binary>"


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place from 1 (``conv, part, pos, key, words``), and one row per conversation and range.

    Turns are ranged and sorted, so a conversation of any length is spread over tasks; its
    place is the place in the range plus the turns of earlier ranges. Order: turn (null
    first), then role and text; equal turns count each.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    t = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    first = F.asc_nulls_first("turn")
    ordered = t.repartitionByRange("conv", first, F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("conv", first, "role", "text")
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    lying = written(ordered.select("conv", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    ranges = lying.groupBy("part", "conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-ranges")
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    return written(lying.join(ranges, ["part", "conv"]).select("conv", "part", pos.alias("pos"), "key", "words"), "trie-placed"), ranges


def rebuilt(turns: DataFrame, ranges: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of the rebuilt conversations: ``conv, d, key, words``, ``d`` from 1.

    The first ``crc32(decimal c) % most`` turns come from conversation ``c - c % every``.
    """
    head = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))), lambda x: F.struct(x["key"], x["words"]))
    heads = turns.filter(F.col("pos") < most).groupBy(F.col("conv").alias("base")).agg(head.alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    known = ranges.filter("before = 0").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    known = known.join(heads, "base", "left").select("conv", "h", taken.alias("taken"))
    lack = known.filter(F.size("taken") < F.col("h")).select("conv", (F.col("h") - F.size("taken")).alias("lack"))
    lack = lack.join(ranges.select("conv", "part"), "conv")  # so that a long conversation meets it range by range
    own = turns.filter(F.col("pos") > h).join(lack, ["conv", "part"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("d"), "key", "words")
    return own.unionByName(known.select("conv", F.posexplode("taken").alias("i", "t")).select("conv", (F.col("i") + 1).cast("long").alias("d"), "t.key", "t.words"))


def pieces_of(turns: DataFrame, piece: int) -> DataFrame:
    """Pieces of up to ``piece`` turns, with the ids of the prefixes before (``s1, s2``) and after (``e1, e2``) them."""
    cut = turns.groupBy("conv", F.floor((F.col("d") - 1) / piece).cast("int").alias("r")).agg(F.array_sort(F.collect_list(F.struct("d", "key", "words"))).alias("t"))
    keys = F.unhex(F.array_join(F.transform("t", lambda x: x["key"]), ""))
    cut = cut.select("conv", "r", keys.alias("keys"), F.transform("t", lambda x: x["words"]).alias("words"))
    along = Window.partitionBy("conv").orderBy("r")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in ("1", "2"):
        own = F.xxhash64(F.lit(int(k)), "r", "keys")
        cut = cut.withColumn(f"e{k}", F.bit_xor(own).over(upto)).withColumn(f"s{k}", F.col(f"e{k}").bitwiseXOR(own))
    return written(cut.withColumn("last", F.lead("r").over(along).isNull()), "trie-pieces")


def end_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """SHA-256 of the ascending decimal ids that end at each prefix (``e1, e2, ends``).

    Ids are sorted over all tasks and joined to blocks first, so that one task reads a few
    long rows even of a prefix at which a third of all conversations ends.
    """
    spots = [T.StructField("e1", T.LongType()), T.StructField("e2", T.LongType())]
    packed = T.StructType([*spots, T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())])

    def pack():
        held: list = []

        def out():
            return [pa.array([x], t) for x, t in zip((*held[0], held[1], ",".join(held[2])), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]

        def f(batch):
            for e1, e2, c in zip(column(batch, "e1"), column(batch, "e2"), column(batch, "conv")):
                if held and (held[0] != (e1, e2) or held[3] > block):
                    yield out()
                    held.clear()
                if not held:
                    held.extend(((e1, e2), c, [], 0))
                held[2].append(str(c))
                held[3] += len(held[2][-1]) + 1

        def end():
            if held:
                yield out()

        return f, end

    def digest():
        held: list = []

        def out():
            return [pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([held[1].hexdigest()], pa.string())]

        def f(batch):
            for e1, e2, ids in zip(column(batch, "e1"), column(batch, "e2"), column(batch, "ids")):
                if held and held[0] != (e1, e2):
                    yield out()
                    held.clear()
                if held:
                    held[1].update(b",")
                else:
                    held.extend(((e1, e2), hashlib.sha256()))
                held[1].update(ids.encode())

        def end():
            if held:
                yield out()

        return f, end

    ordered = ends.repartitionByRange("e1", "e2", "conv").sortWithinPartitions("e1", "e2", "conv")
    blocks = emit_rows(ordered, pack, packed, rows=8192).repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first")
    return emit_rows(blocks, digest, T.StructType([*spots, T.StructField("ends", T.StringType())]), rows=64)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two pieces have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    low, high = 0, n // KEY  # turns known equal, turns known unequal
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY] else (low, mid)
    return low


class _Run:
    """The compressed trie of sorted pieces that share one start: ``rows`` of a task from ``at`` to ``end``."""

    def __init__(self, rows: dict, at: int, end: int, up: int, down: int):
        self.rows = rows
        self.depth, self.row, self.n, self.conv, self.children, self.leaves, self.below, self.ends, self.seam, self.parent = ([] for _ in range(10))
        keys, stack = rows["keys"], [self._point(0, at, True)]
        for i in range(at, end):
            shared = shared_turns(keys[i - 1], keys[i]) if i > at else 0
            while self.depth[stack[-1]] > shared:
                child = stack.pop()
                if self.depth[stack[-1]] < shared:
                    stack.append(self._point(shared, i))
                self._close(child, stack[-1])
            if i == at:
                stack += [self._point(d, i, True) for d in range(1, up + 1)]
            p = self._point(len(keys[i]) // KEY, i)
            self.n[p], self.conv[p], self.ends[p] = rows["n"][i], rows["conv"][i], rows["ends"][i]
            self.children[p], self.leaves[p], self.below[p] = rows["bc"][i], rows["bl"][i], rows["bs"][i]
            stack.append(p)
        for d in range(1, down + 1):
            k = next(k for k, p in enumerate(stack) if self.depth[p] >= d)
            if self.depth[stack[k]] > d:
                stack.insert(k, self._point(d, end - 1))
            self.seam[stack[k]] = True
        while len(stack) > 1:
            child = stack.pop()
            self._close(child, stack[-1])

    def _point(self, depth: int, row: int, seam: bool = False) -> int:
        for have, x in ((self.depth, depth), (self.row, row), (self.n, 0), (self.conv, None), (self.children, 0), (self.leaves, 0), (self.below, 0), (self.ends, None), (self.seam, seam), (self.parent, -1)):
            have.append(x)
        return len(self.depth) - 1

    def _close(self, child: int, parent: int) -> None:
        """A point is complete; what it holds goes to its parent, edge and all, unless others share it."""
        self.parent[child] = parent
        if self.seam[child]:
            return
        if not self.children[child]:
            self.leaves[child] = 1
        self.n[parent] += self.n[child]
        self.conv[parent] = self.conv[child] if self.conv[parent] is None else min(self.conv[parent], self.conv[child])
        self.children[parent] += 1
        self.leaves[parent] += self.leaves[child]
        words = self.rows["words"][self.row[child]]
        self.below[parent] += self.below[child] + (self.n[child] - 1) * sum(words[self.depth[parent] : self.depth[child]])

    def nodes(self):
        """Rows of ``_OUT``: every node of every edge, and what is known here of shared points."""
        i = self.row[0]
        s1, s2, top = self.rows["s1"][i], self.rows["s2"][i], self.rows["top"][i]
        spot = lambda p: hashlib.md5(self.rows["keys"][self.row[p]][: KEY * self.depth[p]]).digest()
        for p, depth in enumerate(self.depth):
            words, n, up = self.rows["words"][self.row[p]], self.n[p], self.parent[p]
            if self.seam[p]:
                path = self.rows["keys"][self.row[p]]
                chain = [hashlib.md5(path[: KEY * d]).digest() for d in range(depth + 1)]
                yield self.conv[p], depth, None, n, self.children[p], self.leaves[p], self.below[p], self.ends[p], s1, s2, None, chain[-1], words[depth - 1] if depth else 0, top, chain
                continue
            saved, above = self.below[p], self.depth[up]
            for d in range(depth, above, -1):
                saved += (n - 1) * words[d - 1]
                parent, pkey = self.conv[p], None
                if d == above + 1:
                    parent, pkey = (top, None) if above == 0 else (None, spot(up)) if self.seam[up] else (self.conv[up], None)
                yield self.conv[p], d, parent, n, self.children[p] if d == depth else 1, self.leaves[p], saved, (self.ends[p] if d == depth else None) or EMPTY, s1, s2, pkey, None, None, None, None


def level_nodes(level: DataFrame, range_turns: int) -> tuple[DataFrame, DataFrame]:
    """All nodes of the tries of one level of pieces, and the sums at their roots (``s1, s2, bc, bl, bs``)."""
    spark = level.sparkSession
    size = level.agg(F.sum(F.size("words")).alias("turns"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(size["turns"] or 0) // range_turns), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size["rows"]))
    ranged = written(level.repartitionByRange(parts, "s1", "s2", "keys").withColumn("part", F.spark_partition_id()), "trie-sorted")
    point = F.struct("s1", "s2", "keys")
    # one row per range meets in one task here, never pieces
    along = Window.orderBy("part")
    bounds = ranged.groupBy("part").agg(F.min(point).alias("lo"), F.max(point).alias("hi"))
    bounds = bounds.withColumn("before", F.lag("hi").over(along)).withColumn("after", F.lead("lo").over(along))

    def meet():
        share = lambda x, y: shared_turns(x["keys"], y["keys"]) if x and y and (x["s1"], x["s2"]) == (y["s1"], y["s2"]) else -1

        def f(batch):
            lo, hi, before, after = (column(batch, c) for c in ("lo", "hi", "before", "after"))
            return [pa.array(list(map(share, before, lo)), pa.int32()), pa.array(list(map(share, hi, after)), pa.int32())]

        return f

    seams = map_columns(bounds, meet, [T.StructField("up", T.IntegerType()), T.StructField("down", T.IntegerType())], ["part"])
    named = ("s1", "s2", "keys", "words", "n", "conv", "ends", "bc", "bl", "bs", "top", "up", "down")
    # as many rows of seams as ranges: three small numbers each
    tasks = ranged.join(F.broadcast(seams), "part").select("part", *named)
    tasks = tasks.repartitionById(int(ranged.agg(F.max("part")).first()[0] or 0) + 1, F.col("part")).sortWithinPartitions("s1", "s2", "keys").select(*named)
    schema = T._parse_datatype_string(_OUT)

    def make():
        rows: dict[str, list] = {c: [] for c in named}

        def f(batch):
            for c in named:
                rows[c] += column(batch, c)
            return ()

        def end():
            starts = list(zip(rows["s1"], rows["s2"]))
            at, out = 0, []
            while at < len(starts):
                end = at
                while end < len(starts) and starts[end] == starts[at]:
                    end += 1
                for node in _Run(rows, at, end, rows["up"][0] if at == 0 else -1, rows["down"][0] if end == len(starts) else -1).nodes():
                    out.append(node)
                    if len(out) == 8192:
                        yield arrays(out)
                        out = []
                at = end
            if out:
                yield arrays(out)

        return f, end

    def arrays(out):
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
        return [pa.array(list(x), t) for x, t in zip(zip(*out), kinds)]

    made = written(emit_rows(tasks, make, schema, rows=8192), "trie-nodes")
    shared = seam_sums(made.filter("skey IS NOT NULL"))
    spot = ["s1", "s2", "skey"]
    above = shared.select("s1", "s2", F.col("skey").alias("pkey"), F.col("conv").alias("above"))
    plain = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    known = made.filter("skey IS NULL AND pkey IS NULL").select(*plain)
    waiting = made.filter("skey IS NULL AND pkey IS NOT NULL").join(above, ["s1", "s2", "pkey"]).withColumn("parent", F.col("above")).select(*plain)
    seam = shared.filter("depth > 0").withColumn("pkey", F.element_at("chain", -2)).join(above, ["s1", "s2", "pkey"])
    seam = seam.withColumn("parent", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("above"))).select(*plain)
    roots = shared.filter("depth = 0").select("s1", "s2", F.col("children").alias("bc"), F.col("leaves").alias("bl"), F.col("saved").alias("bs"))
    return known.unionByName(waiting).unionByName(seam), roots


def seam_sums(parts: DataFrame) -> DataFrame:
    """Shared points put together: what each task knows of them, then sums along their own small tree.

    A shared point always has a child. There are at most as many as ranges times the turns of
    a piece, and one root a start.
    """
    spot = ["s1", "s2", "skey"]
    one = parts.groupBy(*spot).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("children").alias("own"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.max("ends").alias("ends"), F.first("word").alias("word"), F.first("top").alias("top"), F.first("depth").alias("depth"), F.first("chain").alias("chain"))
    one = written(one, "trie-seams")
    up = lambda df, **sums: df.select("s1", "s2", F.explode("chain").alias("skey"), *[F.col(c) for c in sums]).groupBy(*spot).agg(*[f(c).alias(c) for c, f in sums.items()])
    totals = one.drop("n", "conv", "leaves").join(up(one, n=F.sum, conv=F.min, leaves=F.sum), spot)
    totals = totals.withColumn("saved", F.col("below") + F.when(F.col("depth") > 0, (F.col("n") - 1) * F.col("word")).otherwise(0))
    children = one.filter("depth > 0").groupBy("s1", "s2", F.element_at("chain", -2).alias("skey")).agg(F.count("*").alias("more"))
    done = totals.drop("saved").join(up(totals, saved=F.sum), spot).join(children, spot, "left")
    return written(done.withColumn("children", F.col("own") + F.coalesce("more", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(EMPTY))), "trie-shared")


def prefix_trie(conversations: DataFrame, *, piece: int = PIECE, range_turns: int = 100_000, every: int = 20, most: int = 4, block: int = BLOCK) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` as in the contract; a node is named by its smallest member and its depth.
    Rows without ``conv_id`` take no part; null roles and texts are empty; turns of one
    number are ordered by role and text, equal ones count each; other columns are ignored,
    whatever their names; no conversations give no node. Tasks hold ``range_turns`` turns
    at a time. Two prefixes are one if 128 bits agree.
    """
    turns, ranges = placed_turns(conversations)
    cut = pieces_of(rebuilt(turns, ranges, every, most), piece)
    convs = ranges.filter("before = 0").select("conv")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    digests = written(end_digests(convs.join(cut.filter("last").select("conv", "e1", "e2"), "conv", "left").select("conv", zero("e1"), zero("e2")), block), "trie-ends")
    distinct = cut.groupBy("r", "s1", "s2", "e1", "e2").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    distinct = written(distinct.join(digests, ["e1", "e2"], "left"), "trie-distinct")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    deepest = distinct.agg(F.max("r")).first()[0]
    found, below = None, None
    for r in range(-1 if deepest is None else deepest, -1, -1):
        level = distinct.filter(F.col("r") == r)
        if below is None:
            level = level.withColumns({c: F.lit(0).cast("long") for c in ("bc", "bl", "bs")})
        else:
            level = level.join(below.withColumnsRenamed({"s1": "e1", "s2": "e2"}), ["e1", "e2"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("bc", "bl", "bs")})
        if r:
            level = level.join(distinct.filter(F.col("r") == r - 1).select(F.col("e1").alias("s1"), F.col("e2").alias("s2"), F.col("conv").alias("top")), ["s1", "s2"])
        else:
            level = level.withColumn("top", F.lit(whole["least"]))
        nodes, below = level_nodes(level, range_turns)
        nodes = nodes.withColumn("depth", (F.col("depth") + r * piece).cast("long"))
        found = nodes if found is None else found.unionByName(nodes)
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0")
    ends = digests.filter("e1 = 0 AND e2 = 0").select(F.col("ends").alias("ends"))
    sums = below.select("bc", "bl", "bs") if below is not None else convs.sparkSession.createDataFrame([], "bc long, bl long, bs long")
    # one row a side
    root = root.join(ends, F.lit(True), "left").join(sums, F.lit(True), "left")
    root = root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", F.coalesce("bc", F.lit(0)).alias("children"), F.coalesce("bl", F.lit(1)).alias("leaves"), F.coalesce("bs", F.lit(0)).alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"))
    every_node = root if found is None else root.unionByName(found)
    names = {"conv": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    return every_node.select(*[F.col(c).cast("string" if c == "ends" else "long").alias(n) for c, n in names.items()])
