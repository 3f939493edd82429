"""Counters of a stage, taken in the pass that runs it (AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, **what: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and how many of its rows meet each condition, known once an action has run it.

    The counts come with the action's own tasks: no second scan, no shuffle. Rows for
    which a condition is null do not count.
    """
    seen = Observation()
    return df.observe(seen, *[F.count_if(c).alias(name) for name, c in what.items()]), seen
