"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear ``target / source_size`` times. The whole
part is taken outright; the fractional parts meet in pairs and one hands mass, in
words, to the other until one of the two is 0 or 1. The sum of words is kept by each
step and every document keeps its expected number of copies. Blocks of a few thousand
documents are rounded independently; the one fraction each leaves goes up a tree of
fan-in ``FAN``, so no task ever sees more than one block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, unused, written

BLOCK_ROWS = 4096
FAN = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """One row per source: ``src, src_null, n, source_size, target``.

    Sources in code-point order (null last) take the weights in turn. Their shares of
    ``budget`` x all words stop at ``cap`` x their own words; what is cut off is shared
    out again by weight. Solved in one pass: sources ordered by the level at which they
    saturate, the water level is the first that stays below the next saturation point.
    Sources are one row each here, pre-aggregated map-side.
    """
    per = sizes.groupBy("src", "src_null").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("src_null", "src")) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("w"))
    order = Window.orderBy("full_at", "src_null", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("at", F.row_number().over(order))
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("at"))).over(everything)
    return per.withColumn("water", level).select(
        "src", "src_null", "n", "source_size", F.least(F.col("most"), F.coalesce(F.col("w") * F.col("water"), F.col("most"))).alias("target")
    )


def _round_block(seed: int, level: int):
    """Rounds one block, longest rows first; at most one row keeps a fraction, as a rule one of the shortest.

    A row meets the rows after it, as many as can hand over or take what it lacks or has
    (in words); mass moves one way or the other, drawn so that every row's expectation is
    kept, and the row is integral. Where the rows left cannot balance it, it is paired with
    the next one, and one of the two becomes integral. What is left over at the end is all
    that a block can miss its share by, hence the order.
    """

    def run(keys, block):
        block = block.sort_values(["size", "key", "key_2", "nth"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(keys[-1]) & 0xFFFFFFFF, len(block), int(block.key.iloc[0]) & 0xFFFFFFFF])
        draws = rng.random(len(block)).tolist()
        size, frac = block["size"].tolist(), block["frac"].tolist()
        up = [0] * len(block)
        left = [None] * len(block)
        for j, q in enumerate(frac):
            if size[j] == 0:  # carries no words: an independent draw
                up[j] = int(draws[j] < q)
        open_rows = [j for j, q in enumerate(frac) if size[j] and 0.0 < q]
        at = 0
        while at < len(open_rows):
            i = open_rows[at]
            p, w = frac[i], size[i]
            if p <= 1e-12 or p >= 1 - 1e-12:
                up[i], at = round(p), at + 1
                continue
            give, take = p * w, (1 - p) * w
            end, able = at + 1, 0.0  # each row after can move the lesser of what it has and lacks
            while end < len(open_rows) and able < max(give, take):
                j = open_rows[end]
                able, end = able + min(frac[j], 1 - frac[j]) * size[j], end + 1
            if able >= max(give, take):
                takes = draws[i] < p
                share = (-take if takes else give) / able
                for j in open_rows[at + 1 : end]:
                    frac[j] += share * min(frac[j], 1 - frac[j])
                up[i], at = int(takes), at + 1
            elif at + 1 < len(open_rows):
                j = open_rows[at + 1]
                give, take = min(give, (1 - frac[j]) * size[j]), min(take, frac[j] * size[j])
                moved = take if rng.random() * (give + take) < give else -give
                frac[i], frac[j] = p + moved / w, frac[j] - moved / size[j]
                if 1e-12 < frac[i] < 1 - 1e-12:  # the partner is integral
                    up[j] = round(frac[j])
                    del open_rows[at + 1]
            else:
                left[i], at = p, at + 1
        block["copies"] = (block["base"] + np.array(up, dtype=np.int32)).astype("int32")
        block["frac"] = np.array([np.nan if x is None else x for x in left], dtype=float)
        block["block"] = block["block"] // FAN
        return block.sort_values(["key", "key_2", "nth"], kind="stable", ignore_index=True)

    return run


def mix_plan(docs: DataFrame, *, weights=(3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns ``<id>, row_hash, row_hash_2, source, size, source_size, target, copies, taken``.
    Null texts have size 0; a null source is a source of its own, the last one. Rows
    without words follow an independent draw with the same expectation. Repeated rows
    are counted, numbered and rounded each on its own; an empty table gives an empty plan.
    Other columns are only read to tell rows apart, by 128 bits that mark nulls. The same
    rows give the same plan, however they are partitioned.
    """
    each = docs.select(
        F.col(id_col).alias("id"),
        row_hash(docs, 0).alias("key"),
        row_hash(docs, 1).alias("key_2"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("src_null"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # equal rows are summed before they meet, then numbered, so that they fall into many blocks
    same = each.groupBy(*each.columns).agg(F.count("*").alias("times"))
    sizes = written(same.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).drop("times"), "mix-sizes")
    targets = written(source_targets(sizes, tuple(weights), budget, cap), "mix-targets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS))
    most = targets.agg(F.max(blocks)).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sizes.join(targets, ["src", "src_null"]).withColumn("ratio", ratio)
    state = rated.select(
        "src", "src_null", "id", "key", "key_2", "nth", "size", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("frac"), F.pmod(F.xxhash64("key", "nth", F.lit(seed)), blocks).alias("block"), F.lit(0).alias("copies")
    )
    # a block's residual climbs; what a level settles stays with that level
    fields = f"src string, src_null boolean, id {docs.schema[id_col].dataType.simpleString()}, key long, key_2 long, nth int, size long, base int, frac double, block long, copies int"
    settled, level = [], 0
    while True:
        done = written(state.groupBy("src", "src_null", "block").applyInPandas(_round_block(seed, level), fields), f"mix-level{level}")
        open_ = F.col("frac").isNotNull() & ~F.isnan("frac")
        settled.append(done.filter(~open_))
        state = done.filter(open_)
        most = math.ceil(most / FAN) if level else most
        level += 1
        if most <= 1:
            break
    last = F.when(F.pmod(F.xxhash64("key", "nth", F.lit(seed), F.lit(level)), F.lit(1 << 30)) / float(1 << 30) < F.col("frac"), 1).otherwise(0)
    settled.append(state.withColumn("copies", (F.col("base") + last).cast("int")))
    counts = settled[0]
    for x in settled[1:]:
        counts = counts.unionByName(x)
    whole = counts.join(targets, ["src", "src_null"])
    return whole.select(
        F.col("id").alias(id_col),
        F.col("key").alias("row_hash"),
        F.col("key_2").alias("row_hash_2"),
        F.when(~F.col("src_null"), F.col("src")).alias("source"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix_plan` takes it, columns unchanged."""
    *keys, copies, nth = unused(docs, "_key", "_key_2", "_copies", "_nth")
    named = mix_plan(docs, **options).withColumnsRenamed(dict(zip(("row_hash", "row_hash_2"), keys)))
    plan = named.groupBy(*keys).agg(F.sum("copies").cast("int").alias(copies))
    keyed = docs.withColumns({k: row_hash(docs, seed) for seed, k in enumerate(keys)})
    many = keyed.dropDuplicates(keys).join(plan, keys).filter(F.col(copies) > 0)
    return many.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
