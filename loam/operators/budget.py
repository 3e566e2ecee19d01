"""Rows that fit a budget of tokens, in phases.

A key's candidates are one session's or user's, cut to a stated number in order before
they meet in a task; within them rows that don't fit are passed over and later,
smaller ones still taken, which no running sum expresses.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key


def tokens_of(text: Column) -> Column:
    """Four characters count as a token."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def fill(rows: list[dict], used: int, budget: int) -> tuple[list[dict], list[dict], int]:
    """The rows that still fit, those that don't, and what is used then."""
    kept, left = [], []
    for r in rows:
        if used + r["tokens"] <= budget:
            kept.append(r)
            used += r["tokens"]
        else:
            left.append(r)
    return kept, left, used


def layer_selection(rows: list[dict], budget: int, reserve: int) -> set[int]:
    """Positions of the rows that a layer keeps.

    Critical rows always stay.  Constraints come next, up to ``reserve`` tokens of their
    own (without a reserve all of them), beyond it while the budget lasts.  Then all
    others in order that fit.
    """
    kept = [r for r in rows if r["critical"]]
    used, own, others = sum(r["tokens"] for r in kept), 0, []
    for r in (r for r in rows if r["constraint"] and not r["critical"]):
        if not reserve or own + r["tokens"] <= reserve:
            own += r["tokens"]
        elif used + r["tokens"] > budget:
            others.append(r)
            continue
        kept.append(r)
        used += r["tokens"]
    seen = {r["position"] for r in kept}
    more, _, _ = fill([r for r in rows if r["position"] not in seen], used, budget)
    return seen | {r["position"] for r in more}


def scoped_selection(rows: list[dict], most: int) -> dict[int, str]:
    """The section of each row that is kept: ``critical`` has a fifth of ``most`` tokens
    and a tenth more, ``task`` half, ``background`` three tenths, each filled by score."""
    out = {r["position"]: "critical" for r in rows if r["critical"]}
    used = sum(r["tokens"] for r in rows if r["critical"])
    by_score = sorted(rows, key=lambda r: (-r["score"], r["position"]))
    kept, _, _ = fill([r for r in by_score if r["constraint"] and r["position"] not in out], used, most // 5 + most // 10)
    out |= {r["position"]: "critical" for r in kept}
    kept, left, _ = fill([r for r in by_score if r["position"] not in out], 0, most // 2)
    out |= {r["position"]: "task" for r in kept}
    left.sort(key=lambda r: (-r["score"] - r["boost"], r["position"]))
    kept, _, _ = fill(left, 0, most // 5 + most // 10)
    return out | {r["position"]: "background" for r in kept}


def select_per_key(df: DataFrame, keys: list[str], order: list[Column], most_rows: int, choose: Callable[[list[dict]], dict[int, str]]) -> DataFrame:
    """``df`` with ``position`` in its key, from 0, and ``section``, null for rows that
    ``choose`` leaves out.  Only the first ``most_rows`` candidates of a key take part."""
    candidates = top_per_key(df, keys, order, most_rows, "position").withColumn("position", F.col("position") - 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        found = choose(frame.to_dict("records"))
        return frame.assign(section=[found.get(p) for p in frame["position"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields) + ", section string"
    return candidates.groupBy(*keys).applyInPandas(run, schema)
