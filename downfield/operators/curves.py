"""Curves of expected points and success over groups of plays; groups smaller than ``at_least`` are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions.context import distance_bucket, half_seconds


def by_five(yards: Column) -> Column:
    return (F.floor(yards / 5) * 5).cast("long")


def _mean_points(plays: DataFrame, at_least: int, **by: Column) -> DataFrame:
    rows = plays.where("ep_before is not null").groupBy(*(c.alias(n) for n, c in by.items()))
    return rows.agg(F.avg("ep_before").alias("avg_ep"), F.count("*").alias("n")).where(F.col("n") >= at_least)


def points_by_distance(plays: DataFrame, at_least: int = 100, longest: int = 30) -> DataFrame:
    """Mean expected points by yards to go and down; needs ep_before."""
    return _mean_points(plays.where(F.col("distance") <= longest), at_least, distance=F.col("distance"), down=F.col("down"))


def points_by_yards(plays: DataFrame, at_least: int = 100) -> DataFrame:
    """Mean expected points by five yards of the field and down; needs ep_before and yl100."""
    return _mean_points(plays, at_least, yards=by_five(F.col("yl100")), down=F.col("down"))


def points_by_minute(plays: DataFrame, at_least: int = 100) -> DataFrame:
    """Mean expected points by minutes left in the half and down; needs ep_before."""
    return _mean_points(plays, at_least, minute=F.floor(half_seconds(F.col("quarter"), F.col("clock")) / 60).cast("long"), down=F.col("down"))


def points_at_starts(starts: DataFrame, at_least: int = 30) -> DataFrame:
    """Mean expected points by five yards of the field; from drive_starts() with ep_before and yl100."""
    return _mean_points(starts, at_least, yards=by_five(F.col("yl100")))


def success_by_down(plays: DataFrame, at_least: int = 50) -> DataFrame:
    """Share of plays with a gain in expected points, by down, distance bucket and kind (a sack is a pass); needs epa."""
    rows = plays.where("epa is not null AND play_type IN ('pass','rush','sack')")
    kind = F.when(F.col("play_type") == "sack", "pass").otherwise(F.col("play_type"))
    rows = rows.groupBy("down", distance_bucket(F.col("distance")).alias("bucket"), kind.alias("kind"))
    return rows.agg(F.avg((F.col("epa") > 0).cast("double")).alias("success_rate"), F.count("*").alias("n")).where(F.col("n") >= at_least)
