"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, user first, assistant last. Dynamic programming over that automaton picks
the cheapest way to make a conversation legal: keep a turn, relabel it, merge it into
the turn before, or insert an empty turn. The repaired conversation is then rendered.
Conversations are cut into segments; a segment becomes a min-plus matrix over the
automaton's states, matrices are combined in order, and each segment is then traced back
between its two states, so a conversation of any length is dealt over many tasks.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_columns, written

SEGMENT_TURNS = 2048
RELABEL, MERGE, INSERT = 2, 1, 3
ROLES = ("system", "user", "assistant")
#: State 0 is the start, state i + 1 "the last turn is of role i".
STATES = range(len(ROLES) + 1)
FOLLOWS = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FINAL = (0, 3)
FAR = 1 << 40


def _steps():
    """From each state, every way to reach a role's new turn by inserting legal turns first."""
    ways = {s: {} for s in STATES}
    for s in STATES:
        todo = [(s, ())]
        for at, inserted in todo:
            for role in FOLLOWS[at]:
                if role not in ways[s] or len(inserted) < len(ways[s][role]):
                    ways[s][role] = inserted
                if len(inserted) < 2:
                    todo.append((role + 1, (*inserted, role)))
    return ways


WAYS = _steps()


def options(role: str | None):
    """``(state, next state, cost, merged, inserted roles)`` of one turn, in order of preference."""
    for s, new in product(STATES, range(len(ROLES))):
        label = 0 if role == ROLES[new] else RELABEL
        if s == new + 1:
            yield s, s, label + MERGE, True, ()
        if new in WAYS[s]:
            yield s, new + 1, label + INSERT * len(WAYS[s][new]), False, WAYS[s][new]


_OPTIONS = {r: sorted(options(r), key=lambda o: (o[2], o[3], o[0], o[1])) for r in (*ROLES, None)}


def forward(roles: list[str | None], start: int) -> list[list]:
    """Best cost of every state after each turn, with the option taken."""
    cost = [0 if s == start else FAR for s in STATES]
    table = []
    for role in roles:
        best: list = [(FAR, None)] * len(STATES)
        for option in _OPTIONS.get(role, _OPTIONS[None]):
            c = cost[option[0]] + option[2]
            if c < best[option[1]][0]:
                best[option[1]] = (c, option)
        cost = [b[0] for b in best]
        table.append(best)
    return table


def segment_matrix(roles: list[str | None]) -> list[int]:
    """Cost from every state to every state through a segment, row by row."""
    return [c for s in STATES for c, _ in forward(roles, s)[-1]] if roles else [0 if a == b else FAR for a in STATES for b in STATES]


def best_states(matrices: list[list[int]]) -> tuple[int, list[int]]:
    """Least cost of a whole conversation and the state at each segment's border."""
    n = len(STATES)
    cost, came = [0 if s == 0 else FAR for s in STATES], []
    for m in matrices:
        step = [min((cost[a] + m[a * n + b], a) for a in STATES) for b in STATES]
        cost = [c for c, _ in step]
        came.append([a for _, a in step])
    ends = [(cost[s] + (INSERT * _closing(s) if s not in FINAL else 0), s) for s in STATES]
    total, state = min(ends)
    path = [state]
    for back in reversed(came):
        path.append(back[path[-1]])
    return total, path[::-1]


def _closing(state: int) -> int:
    """Empty turns needed to end legally from a state: a user's answer, after a system turn both."""
    return {1: 2, 2: 1}[state]


def trace(roles: list[str | None], start: int, end: int) -> list[tuple]:
    """The options taken from ``start`` to ``end``."""
    table, state, taken = forward(roles, start), end, []
    for best in reversed(table):
        option = best[state][1]
        taken.append(option)
        state = option[0]
    return taken[::-1]


def turn_text(role: int, text: str) -> str:
    return f"\n<|{ROLES[role]}|>\n{text}"


def render_segment(roles, texts, start: int, end: int, last: bool) -> tuple[str, list[int]]:
    """A segment's part of the rendered conversation and counts: turns, merges, relabels, insertions."""
    out, turns, merges, relabels, inserts = [], 0, 0, 0, 0
    for role, text, (_, state, _, merged, inserted) in zip(roles, texts, trace(roles, start, end)):
        new = state - 1
        relabels += role != ROLES[new]
        for r in inserted:
            out.append(turn_text(r, ""))
        inserts += len(inserted)
        if merged:
            merges += 1
            out.append("\n" + (text or ""))
        else:
            out.append(turn_text(new, text or ""))
        turns += (not merged) + len(inserted)
    if last and end not in FINAL:
        closing = {1: (1, 2), 2: (2,)}[end]
        out += [turn_text(r, "") for r in closing]
        inserts += len(closing)
        turns += len(closing)
    return "".join(out), [turns, merges, relabels, inserts]


def repair(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``<conv>, n_turns, cost, n_out, n_merged, n_relabelled, n_inserted, rendered``.

    Turns are taken by number (null first), equal numbers by role and text. Unknown and
    null roles match no role and are relabelled; null texts are empty. A null
    conversation id is an id of its own. Repeated rows are turns like others. Ties
    between repairs go to keeping turns apart, then to earlier states. Other columns are
    not read; an empty table gives none.
    """
    at = F.col(turn_col).cast("long")
    turn = F.struct(at.alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    seg = F.coalesce(F.floor(at / segment_turns), F.lit(-(1 << 62)))
    cut = conversations.groupBy(F.col(conv_col).alias("_conv"), seg.alias("_seg")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    roles = F.transform("_turns", lambda t: t["role"])
    segments = written(cut.select("_conv", "_seg", roles.alias("_roles"), F.transform("_turns", lambda t: t["text"]).alias("_texts")), "chat-segments")

    def matrices():
        known: dict = {}

        def f(batch):
            out = []
            for r in column(batch, "_roles"):
                key = tuple(r)
                if key not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[key] = segment_matrix(r)
                out.append(known[key])
            return [pa.array(out, pa.list_(pa.int64()))]

        return f

    mats = map_columns(segments.select("_conv", "_seg", "_roles"), matrices, [T.StructField("_m", T.ArrayType(T.LongType()))], ["_conv", "_seg"])
    lined = mats.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_seg", "_m"))).alias("_line"))

    def borders():
        def f(batch):
            got = [best_states([s["_m"] for s in line]) for line in column(batch, "_line")]
            return [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))]

        return f

    found = map_columns(lined, borders, [T.StructField("cost", T.LongType()), T.StructField("_path", T.ArrayType(T.LongType()))], ["_conv", "_line"])
    each = found.select("_conv", "cost", "_path", F.posexplode("_line").alias("_i", "_s")).select("_conv", "cost", F.col("_s._seg").alias("_seg"), F.get("_path", F.col("_i")).alias("_from"), F.get("_path", F.col("_i") + 1).alias("_to"), (F.col("_i") + 2 == F.size("_path")).alias("_last"))
    both = segments.alias("a").join(each.alias("b"), F.col("a._conv").eqNullSafe(F.col("b._conv")) & (F.col("a._seg") == F.col("b._seg"))).select("a.*", "cost", "_from", "_to", "_last")

    def renders():
        def f(batch):
            got = [render_segment(*row) for row in zip(*[column(batch, c) for c in ("_roles", "_texts", "_from", "_to", "_last")])]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([len(r) for r in column(batch, "_roles")], pa.int64())]

        return f

    fields = [T.StructField("_part", T.StringType()), T.StructField("_counts", T.ArrayType(T.LongType())), T.StructField("_n", T.LongType())]
    parts = map_columns(both, renders, fields, ["_conv", "_seg", "cost"])
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_seg", "_part"))), lambda s: s["_part"]), "")
    counts = [F.sum(F.get("_counts", F.lit(i))).alias(c) for i, c in enumerate(("n_out", "n_merged", "n_relabelled", "n_inserted"))]
    return parts.groupBy("_conv").agg(F.sum("_n").alias("n_turns"), F.first("cost").alias("cost"), *counts, F.substr(whole, F.lit(2)).alias("rendered")).withColumnRenamed("_conv", conv_col)
