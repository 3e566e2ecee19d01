"""Rank fusion of several result lists.

Lists are rows of (query_id, source, id, rank, score) with ranks from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (F.lit(k) + rank)


def _by_max(df: DataFrame, column: str) -> DataFrame:
    """``column`` as a share of its query's largest value."""
    top = df.groupBy("query_id").agg(F.max(column).alias("__top"))
    return df.join(top, "query_id").withColumn(column, F.col(column) / F.col("__top")).drop("__top")


def weighted_rrf(lists: DataFrame, weight: Column, k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) and the number of lists per result."""
    return lists.groupBy("query_id", "id").agg(F.sum(weight * reciprocal_rank(F.col("rank"), k)).alias("fused"), F.count("*").alias("lists"))


def consensus_rrf(lists: DataFrame, weight: Column, factor: float, max_lists: int, k: int = RRF_K) -> DataFrame:
    """As weighted_rrf; results in more than one list gain ``factor`` times their share of lists."""
    boost = F.when(F.col("lists") > 1, 1 + factor * F.col("lists") / max_lists).otherwise(1.0)
    return weighted_rrf(lists, weight, k).withColumn("fused", F.col("fused") * boost)


def fuse_rrf(lists: DataFrame, min_lists: int = 1, k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks over the query's largest sum, with mean score and best rank."""
    found = lists.groupBy("query_id", "id").agg(
        F.sum(reciprocal_rank(F.col("rank"), k)).alias("fused"),
        F.avg("score").alias("mean_score"),
        F.min("rank").alias("best_rank"),
        F.count("*").alias("lists"),
    )
    return _by_max(found.where(F.col("lists") >= min_lists), "fused")


def fuse_frequency(lists: DataFrame, n_lists: int) -> DataFrame:
    """0.4 of the share of lists plus 0.6 of the best score."""
    found = lists.groupBy("query_id", "id").agg(F.count("*").alias("lists"), F.max("score").alias("best"))
    return found.select("query_id", "id", "lists", (0.4 * F.col("lists") / n_lists + 0.6 * F.col("best")).alias("fused"))


def fuse_weighted(lists: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks over the query's largest sum."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(1.0))
    return _by_max(weighted_rrf(lists, weight, k), "fused")


def fuse_max(lists: DataFrame) -> DataFrame:
    """The best score, plus 0.02 per list up to 0.1; 1 at most."""
    found = lists.groupBy("query_id", "id").agg(F.count("*").alias("lists"), F.max("score").alias("best"))
    return found.select("query_id", "id", "lists", F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.1), 0.02 * F.col("lists"))).alias("fused"))


def fuse_minmax(lists: DataFrame) -> DataFrame:
    """Scores scaled between each list's least and largest (1 where equal); the best
    per result."""
    # By a window, as a join would search again and meet its own union of lists.
    own = Window.partitionBy("query_id", "source")
    ends = lists.withColumns({"lo": F.min("score").over(own), "hi": F.max("score").over(own)})
    scaled = ends.withColumn("fused", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return scaled.groupBy("query_id", "id").agg(F.max("fused").alias("fused"))


def hybrid_rrf(vector: DataFrame, text: DataFrame, vector_weight: float = 0.6, text_weight: float = 0.4, k: int = RRF_K) -> DataFrame:
    """Two ranked lists joined in full; ``origin`` tells whether text found the row."""
    v = vector.select("query_id", "id", F.col("rank").alias("v_rank"))
    t = text.select("query_id", "id", F.col("rank").alias("t_rank"))
    part = lambda w, c: F.coalesce(w * reciprocal_rank(F.col(c), k), F.lit(0.0))
    return v.join(t, ["query_id", "id"], "full_outer").select(
        "query_id",
        "id",
        (part(F.lit(vector_weight), "v_rank") + part(F.lit(text_weight), "t_rank")).alias("fused"),
        F.when(F.col("t_rank").isNull(), "vector_only").otherwise("rrf").alias("origin"),
    )


def propensity(rank: Column, n: int, k: int = RRF_K) -> Column:
    """Chance that a rank from 0 is looked at: 1 / (k + rank) over the sum of n ranks."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + 1.0 / (k + i))
    return (1.0 / (k + rank)) / total


def propensity_among(rank: Column, window: WindowSpec, k: int = RRF_K) -> Column:
    """The same where a list's ranks, from 0, are the rows of ``window``."""
    return (1.0 / (k + rank)) / F.sum(1.0 / (k + rank)).over(window)


def importance_multiplier(importance: Column) -> Column:
    return F.when(importance < 0.35, 0.4).otherwise(1.0)


def blend(score: Column, importance: Column, sentiment: Column) -> Column:
    """Without a reranker: 0.85 score and 0.15 importance, times both multipliers."""
    return (score * 0.85 + importance * 0.15) * importance_multiplier(importance) * sentiment


def recency_tier(pinned: Column, age_days: Column, retrievals: Column) -> Column:
    busy = retrievals / F.greatest(age_days, F.lit(1)) > 0.1
    return (
        F.when(pinned, 1.0)
        .when(age_days <= 7, 1.0)
        .when(age_days <= 30, 0.9)
        .when(age_days <= 90, 0.75)
        .when(busy, 0.8)
        .otherwise(0.6)
    )


def usage_signal(retrieved: Column, used: Column, days: Column, half_life: float = 14.0) -> Column:
    """0 under three retrievals; else decayed use, saturating at 1."""
    x = (2 * used + retrieved) * F.exp(-F.log(F.lit(2.0)) / half_life * days)
    return F.when(retrieved < 3, 0.0).otherwise(x / (x + 10))


def usage_blend(score: Column, usage: Column, net_feedback: Column) -> Column:
    boost = F.when(net_feedback > 0, 1.5).when(net_feedback < 0, 0.5).otherwise(1.0)
    return score * 0.85 + F.least(F.lit(1.0), usage * boost) * 0.15
