"""Importance, decay, tiers and trust, at an explicit point in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_life(age_days: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / days)


def initial_importance(hint: Column, correction: Column, repeats: Column, references: Column, edge: Column, layer_weight: Column) -> Column:
    """Points for hints, corrections, repeats and references; a fifth more at either
    end of a session; times the layer's weight; as a share of 300, at most 1."""
    points = 50 + hint + F.when(correction, 50).otherwise(0) + 10 * repeats + 5 * references
    return F.round(F.least(F.lit(1.0), points * F.when(edge, 1.2).otherwise(1.0) * layer_weight / 300), 2)


def effective_score(base: Column, age_days: Column, used: Column, confidence: Column, pinned: Column, critical: Column, days: float = 30.0) -> Column:
    """Decayed base, lifted by use and confidence; critical records keep 0.6; 1 at most."""
    score = base * half_life(age_days, days) * (1 + 0.15 * F.log2(1 + used)) * (0.5 + 0.5 * confidence) + F.when(pinned, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(critical, F.greatest(score, F.lit(0.6))).otherwise(score))


def tier(importance: Column, idle_days: Column) -> Column:
    return F.when((importance >= 0.6) & (idle_days <= 7), "HOT").when((importance >= 0.3) & (idle_days <= 30), "WARM").otherwise("COLD")


def trust(weight: Column, age_days: Column, days: float = 30.0) -> Column:
    """Aggregate: decayed signed weights over decayed absolute ones, mapped from -1..1 to
    0..1; 0.5 without signals."""
    decay = half_life(age_days, days)
    balance = F.coalesce(F.sum(weight * decay) / F.nullif(F.sum(F.abs(weight) * decay), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (balance + 1) / 2))
