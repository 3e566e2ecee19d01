"""Time series and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "month")
#: Range that a grain covers where none is given, in days.
DEFAULT_DAYS = {"hour": 1, "day": 30, "week": 90, "month": 365}


def time_buckets(df: DataFrame, ts: str, grain: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows per bucket within an inclusive range; weeks start on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df.groupBy(F.date_format(F.date_trunc(grain, ts), "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(F.count("*").alias("n"))


def default_range(grain: str, as_of: str) -> tuple[Column, Column]:
    """The range before ``as_of`` that a grain covers."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return end - F.expr(f"interval {DEFAULT_DAYS[grain]} days"), end


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum over an aggregate of few rows, such as buckets."""
    return df.withColumn(name, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def gap_markers(df: DataFrame, keys: list[str], ts: str, seconds: int = 600, tie: str | None = None) -> DataFrame:
    """Rows more than ``seconds`` after the row before of their keys, with ``gap_s``.
    The first row of keys and rows at one instant get no marker."""
    w = Window.partitionBy(*keys).orderBy(ts, *([tie] if tie else []))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("gap_s", ((micros - F.lag(micros).over(w)) / 1_000_000)).where(F.col("gap_s") > seconds)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], floor_index: bool = False) -> DataFrame:
    """Percentiles without interpolation: element ceil(p * n) from 1, or with
    ``floor_index`` element floor(p * n) from 0, the last at most.

    Ranks come from counts per distinct value, so equal values cost one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).join(total, keys)

    def at(p: float) -> Column:
        rank = F.least(F.floor(p * F.col("total")) + 1, F.col("total")) if floor_index else F.ceil(F.col("total") * p)
        return F.min(F.when(F.col("upto") >= F.greatest(rank, F.lit(1)), F.col(value)))

    return ranked.groupBy(*keys).agg(*[at(p).alias(name) for name, p in shares.items()])


def daily_gaps(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Counts for every day of a range: ``gap`` where there is none, ``sparse`` below
    half the mean of all days (at least 1)."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    filled = days.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = filled.agg(F.avg("n")).first()[0] or 0.0
    limit = max(1, int(0.5 * mean))
    return filled.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.when(F.col("n") == 0, "gap").when(F.col("n") < limit, "sparse").otherwise("ok").alias("state")
    )
