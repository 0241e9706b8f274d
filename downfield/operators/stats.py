"""Box-score statistics of players and teams, and sums of EPA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions.context import is_two_point

#: Seasons from which a kneel counts as a rush of minus two yards (fixed values).
KNEEL_SEASON, KNEEL_YARDS = 28, -2


def _n(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def _sum(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, F.coalesce(value, F.lit(0))).otherwise(0)).cast("long")


def regular(plays: DataFrame) -> DataFrame:
    return plays.where(~is_two_point(F.col("description"), any_case=False))


def _first(team: str) -> Column:
    """The team of the first play that has one."""
    return F.min_by(team, F.when(F.col(team).isNotNull(), F.col("play_index"))).alias("team")


def player_passing(plays: DataFrame) -> DataFrame:
    """Per game and passer; sacks are no attempts."""
    done = F.col("description").contains(", complete to")
    thrown = F.col("play_type") == "pass"
    return regular(plays).where("passer_id is not null").groupBy("game_id", "passer_id").agg(
        _n(thrown & done).alias("comp"), _n(thrown).alias("att"), _sum(thrown & done, F.col("yards_gained")).alias("yards"), _n(thrown & done & F.col("touchdown")).alias("td"),
        _n(thrown & F.col("interception")).alias("interceptions"), _n(F.col("play_type") == "sack").alias("sacks"), _sum(F.col("play_type") == "sack", F.col("yards_gained")).alias("sack_yards"),
        _first("possession_team"),
    )


def player_rushing(plays: DataFrame) -> DataFrame:
    return regular(plays).where("rusher_id is not null AND play_type = 'rush'").groupBy("game_id", "rusher_id").agg(F.count("*").alias("att"), F.sum("yards_gained").cast("long").alias("yards"), _n(F.col("touchdown")).alias("td"), _n(F.col("fumble_lost")).alias("fumbles"), _first("possession_team"))


def player_receiving(plays: DataFrame) -> DataFrame:
    caught = regular(plays).where((F.col("play_type") == "pass") & F.col("receiver_id").isNotNull() & F.col("description").contains(", complete to"))
    return caught.groupBy("game_id", "receiver_id").agg(F.count("*").alias("rec"), F.sum("yards_gained").cast("long").alias("yards"), _n(F.col("touchdown")).alias("td"), _first("possession_team"))


def player_defense(plays: DataFrame) -> DataFrame:
    """From the role columns; two-point plays count. A fumble is forced by the tackler, else the sacker."""
    who = {r: F.col(f"{r}_id") for r in ("tackler", "sacker", "interceptor", "fumble_recoverer")} | {"forcer": F.when(F.col("fumble"), F.coalesce("tackler_id", "sacker_id"))}
    roles = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("player_id")) for r, c in who.items()))
    rows = plays.select("game_id", "play_index", "defense_team", F.explode(roles).alias("r")).where("r.player_id is not null")
    return rows.groupBy("game_id", F.col("r.player_id").alias("player_id")).agg(*(_n(F.col("r.role") == r).alias(n) for r, n in (("tackler", "tackles"), ("sacker", "sacks"), ("interceptor", "interceptions"), ("fumble_recoverer", "fumble_recoveries"), ("forcer", "forced_fumbles"))), _first("defense_team"))


def team_games(plays: DataFrame) -> DataFrame:
    """Two rows a game, by one pass: every play counts for its offense; sacks, forced fumbles and recoveries for the defense too."""
    p, t = F.col("play_type"), F.col("side") == "offense"
    done = (p == "pass") & F.col("description").contains(", complete to")
    kneel = (p == "kneel") & (F.col("season") >= KNEEL_SEASON)
    third = (F.col("down") == 3) & p.isin("pass", "rush", "sack")
    sides = F.explode(F.array(F.struct(F.lit("offense").alias("side"), F.col("possession_team").alias("team")), F.struct(F.lit("defense").alias("side"), F.col("defense_team").alias("team"))))
    rows = regular(plays).where("possession_team is not null").select("*", sides.alias("s")).select("*", "s.side", "s.team")
    return rows.groupBy("game_id", "season", "team").agg(
        _n(t & ((p == "pass") & F.col("passer_id").isNotNull() | (p == "spike"))).alias("pass_att"), _n(t & done).alias("pass_comp"), _sum(t & done, F.col("yards_gained")).alias("pass_yards"),
        _n(t & ((p == "rush") | kneel)).alias("rush_att"), F.sum(F.when(t & (p == "rush"), F.col("yards_gained")).when(t & kneel, KNEEL_YARDS).otherwise(0)).cast("long").alias("rush_yards"),
        _n(t & F.col("interception")).alias("interceptions_thrown"), _n(t & F.col("fumble_lost")).alias("fumbles_lost"), _n(t & (p == "sack")).alias("sacks_taken"), _n(~t & (p == "sack")).alias("sacks_made"),
        _n(t & done & F.col("touchdown")).alias("pass_td"), _n(t & (p == "rush") & F.col("touchdown")).alias("rush_td"), _n(~t & F.col("fumble") & (F.col("tackler_id").isNotNull() | F.col("sacker_id").isNotNull())).alias("forced_fumbles"),
        _n(F.when(t, F.col("fumble") & ~F.coalesce("fumble_lost", F.lit(False))).otherwise(F.col("fumble") & F.col("fumble_lost"))).alias("fumble_recoveries"),
        _n(t & F.col("first_down")).alias("first_downs"), _n(t & third).alias("third_down_att"), _n(t & third & (F.col("first_down") | F.col("touchdown"))).alias("third_down_conv"),
    )


def with_results(games: DataFrame, results: DataFrame) -> DataFrame:
    """Adds opponent, at_home and points of game_results() to team_games(), with total yards and turnovers.

    Both sides of a game appear; without any play of its own a team's counts are 0.
    """
    counts = [c for c in games.columns if c not in ("game_id", "season", "team")]
    rows = results.join(games, ["game_id", "season", "team"], "left").fillna(0, subset=counts)
    return rows.withColumn("total_yards", F.col("pass_yards") + F.col("rush_yards")).withColumn("turnovers", F.col("interceptions_thrown") + F.col("fumbles_lost"))


def team_epa(plays: DataFrame) -> DataFrame:
    """EPA of each team, season, game type and side; preseason is left out. Needs epa."""
    rows = plays.where("epa is not null AND possession_team is not null AND game_type <> 'preseason'")
    sides = F.explode(F.array(F.struct(F.lit("offense").alias("side"), F.col("possession_team").alias("team")), F.struct(F.lit("defense").alias("side"), F.col("defense_team").alias("team"))))
    rows = rows.select("season", "game_type", "play_type", "epa", sides.alias("s"))
    return rows.groupBy(F.col("s.team").alias("team"), "season", "game_type", F.col("s.side").alias("side")).agg(
        F.sum("epa").alias("total_epa"), F.sum(F.when(F.col("play_type").isin("pass", "sack"), F.col("epa")).otherwise(0.0)).alias("pass_epa"), F.sum(F.when(F.col("play_type") == "rush", F.col("epa")).otherwise(0.0)).alias("rush_epa"),
        F.count("*").alias("plays"), F.avg("epa").alias("epa_per_play"), F.avg((F.col("epa") > 0).cast("double")).alias("success_rate"),
    )


def player_epa(plays: DataFrame, role: str, types: tuple[str, ...]) -> DataFrame:
    """EPA of each player in a role, season and game type; needs epa."""
    rows = plays.where(F.col("epa").isNotNull() & F.col(f"{role}_id").isNotNull() & F.col("play_type").isin(*types) & (F.col("game_type") != "preseason"))
    return rows.groupBy(F.col(f"{role}_id").alias("player_id"), "season", "game_type").agg(F.sum("epa").alias("epa"), F.count("*").alias("plays"), F.avg("epa").alias("epa_per_play"))


def average_plus(df: DataFrame, value: str, weight: str, by: tuple[str, ...]) -> DataFrame:
    """Adds league, the weighted average of the groups, and plus = 100 (value - league)."""
    league = df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("league"))
    return df.join(league, list(by)).withColumn("plus", (F.col(value) - F.col("league")) * 100)
