"""Clock, field position and buckets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plays from scrimmage that get an expected-points value.
SCRIMMAGE = ("pass", "rush", "sack", "field_goal")


def half(quarter: Column) -> Column:
    """1, 2, or 3 for overtime."""
    return F.when(quarter <= 2, 1).when(quarter <= 4, 2).otherwise(3)


def loaded_half_seconds(quarter: Column, clock: Column) -> Column:
    """Seconds left in the half as tables of plays store them: 0 in overtime, null without a quarter and for a bad clock."""
    parts = F.split(clock, ":")
    left = F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    return F.when(left.isNotNull(), F.when(quarter >= 5, 0).when(quarter.isin(1, 3), left + 900).when(quarter.isNotNull(), left))


def half_seconds(quarter: Column, clock: Column) -> Column:
    """Seconds left in the half as a feature; 0 in overtime and for a bad clock."""
    parts = F.split(clock, ":")
    left = F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    return F.when(quarter >= 5, 0).otherwise(F.coalesce(left + F.when(quarter.isin(1, 3), 900).otherwise(0), F.lit(0)))


def other_team(team: Column, home: Column, away: Column) -> Column:
    """The other of a game's two teams; null for a team that is neither."""
    return F.when(team == home, away).when(team == away, home)


def yardline_100(team: Column, side: Column, yard_line: Column) -> Column:
    """Yards from the own goal; null if any input is null."""
    return F.when(team == side, yard_line).when(team != side, 100 - yard_line)


def scrimmage(two_point: bool = True) -> Column:
    """Scrimmage plays with down, distance and yard line; without two-point tries."""
    ok = F.col("play_type").isin(*SCRIMMAGE) & F.col("down").isNotNull() & F.col("distance").isNotNull() & F.col("yard_line").isNotNull()
    return ok & ~is_two_point(F.col("description")) if two_point else ok


def is_two_point(description: Column, any_case: bool = True) -> Column:
    """Tries for two points by their text: in any case for models, as written for box scores."""
    told = F.lower(description) if any_case else description
    return F.coalesce(told.contains("2 point") | told.contains("conversion"), F.lit(False))


def distance_bucket(distance: Column) -> Column:
    return F.when(distance <= 3, "Short").when(distance <= 7, "Medium").when(distance <= 12, "Long").otherwise("Very Long")


def play_points() -> Column:
    """Points of a play for the side in possession; null if it scores none."""
    against = F.coalesce(F.col("interception") | F.col("fumble_lost"), F.lit(False))
    touchdown = 6 + F.coalesce(F.col("pat_good").cast("int"), F.lit(0))
    return (
        F.when(F.col("touchdown"), F.when(against, -touchdown).otherwise(touchdown))
        .when((F.col("play_type") == "field_goal") & F.coalesce(F.col("fg_good"), F.lit(False)), 3)
        .when(F.coalesce(F.col("safety"), F.lit(False)), -2)
    )
