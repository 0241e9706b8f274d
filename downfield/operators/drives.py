"""Drives, next scores and expected points by windows over a game; no loop over games, no Python function.

All windows begin with game_id: after one exchange on it only local sorts follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from downfield.functions.context import half, loaded_half_seconds, play_points, scrimmage, yardline_100


def _game() -> WindowSpec:
    return Window.partitionBy("game_id").orderBy("play_index")



def with_context(plays: DataFrame) -> DataFrame:
    """Adds half, yl100 and pts."""
    return plays.withColumns({"half": half(F.col("quarter")), "yl100": yardline_100(F.col("possession_team"), F.col("yard_line_team"), F.col("yard_line")), "pts": play_points()})


def with_drives(plays: DataFrame) -> DataFrame:
    """Adds drive and drive_points; needs with_context().

    A drive begins with the game, a half, a kickoff, after a score, and where a known
    possession differs from the drive's or is its first.
    """
    poss = F.col("possession_team_id")
    fresh = F.lag("half").over(_game()).isNull() | (F.col("half") != F.lag("half").over(_game())) | (F.col("play_type") == "kickoff") | F.lag("pts").over(_game()).isNotNull()
    df = plays.withColumn("fresh", fresh.cast("int")).withColumn("seg", F.sum("fresh").over(_game()))
    seg = Window.partitionBy("game_id", "seg").orderBy("play_index").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("held", F.last("possession_team_id", ignorenulls=True).over(seg))
    turn = (F.col("fresh") == 0) & poss.isNotNull() & (F.col("held").isNull() | (F.col("held") != poss))
    df = df.withColumn("drive", F.sum(F.when((F.col("fresh") == 1) | turn, 1).otherwise(0)).over(_game()))
    points = F.coalesce(F.sum("pts").over(Window.partitionBy("game_id", "drive")), F.lit(0))
    return df.withColumn("drive_points", points).drop("fresh", "seg", "held")


def with_next_score(plays: DataFrame) -> DataFrame:
    """Adds next_score: td, fg or safety, _pos or _neg for the side in possession, or no_score, within the half.

    A touchdown counts for the side in possession, one after a turnover too; a safety for the other of
    the first two ids of the game. Needs half and pts.
    """
    whole, poss = _game().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.col("possession_team_id")
    plays = plays.withColumn("__one", F.first(poss, ignorenulls=True).over(whole))
    plays = plays.withColumn("__two", F.first(F.when(poss != F.col("__one"), poss), ignorenulls=True).over(whole))
    other = F.when(poss == F.col("__one"), F.col("__two")).when(poss == F.col("__two"), F.col("__one"))
    goal = (F.col("play_type") == "field_goal") & F.coalesce("fg_good", F.lit(False))
    event = (
        F.when(F.col("touchdown"), F.struct(F.lit("td").alias("kind"), poss.alias("team")))
        .when(goal, F.struct(F.lit("fg").alias("kind"), poss.alias("team")))
        .when(F.col("safety"), F.struct(F.lit("safety").alias("kind"), other.alias("team")))
    )
    ahead = Window.partitionBy("game_id", "half").orderBy("play_index").rowsBetween(0, Window.unboundedFollowing)
    df = plays.withColumn("next_event", F.first(event, ignorenulls=True).over(ahead))
    side = F.when(F.col("possession_team_id") == F.col("next_event.team"), "_pos").otherwise("_neg")
    return df.withColumn("next_score", F.when(F.col("next_event").isNull(), "no_score").otherwise(F.concat("next_event.kind", side))).drop("next_event", "__one", "__two")


def stub_ep() -> Column:
    """Closed-form expected points on valid scrimmage plays: yards from the own goal / 50."""
    return F.when(scrimmage() & F.col("yl100").isNotNull(), F.col("yl100") / 50.0)


def with_epa(plays: DataFrame, ep: Column | None = None) -> DataFrame:
    """Adds ep_before, ep_after and epa, looking ahead to the end of the drive.

    A block runs from after one stop row (half start, kickoff, a value or a score) to
    the next. A score is worth its points; a change of possession in the next block
    or its end at a half or kickoff is worth 0; else the next stop's value counts.
    """
    df = plays.withColumn("ep_before", stub_ep() if ep is None else ep)
    lag_half = F.lag("half").over(_game())
    edge = lag_half.isNull() | (lag_half != F.col("half")) | (F.col("play_type") == "kickoff")
    df = df.withColumn("edge", edge).withColumn("stop", F.col("edge") | F.col("ep_before").isNotNull() | F.col("pts").isNotNull())
    df = df.withColumn("blk", F.coalesce(F.sum(F.col("stop").cast("int")).over(_game().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    block = Window.partitionBy("game_id", "blk")
    df = df.withColumns({"bmin": F.min("possession_team_id").over(block), "bmax": F.max("possession_team_id").over(block)})
    df = df.withColumn("val", F.when(F.col("edge"), 0.0).otherwise(F.coalesce("ep_before", F.col("pts").cast("double"))))
    stops = Window.partitionBy("game_id", "stop").orderBy("play_index")
    df = df.withColumn("nx", F.when(F.col("stop"), F.lead(F.struct("val", "bmin", "bmax")).over(stops)))
    turned = (F.col("nx.bmin") != F.col("possession_team_id")) | (F.col("nx.bmax") != F.col("possession_team_id"))
    after = F.when(F.col("pts").isNotNull(), F.col("pts").cast("double")).when(F.col("nx").isNull() | turned, 0.0).otherwise(F.col("nx.val"))
    df = df.withColumn("ep_after", F.when(F.col("ep_before").isNotNull(), after))
    return df.withColumn("epa", F.col("ep_after") - F.col("ep_before")).drop("edge", "stop", "blk", "bmin", "bmax", "val", "nx")


def with_half_score_epa(plays: DataFrame) -> DataFrame:
    """Adds hs_after and hs_epa: the next value of the half, negated on a change of possession; needs ep_before."""
    known = Window.partitionBy("game_id", F.col("ep_before").isNotNull()).orderBy("play_index")
    df = plays.withColumn("nx", F.lead(F.struct("ep_before", "half", "possession_team_id")).over(known))
    after = F.when(F.col("pts").isNotNull(), F.col("pts").cast("double")).when(F.col("nx").isNull() | (F.col("nx.half") != F.col("half")), 0.0).when(F.col("nx.possession_team_id") != F.col("possession_team_id"), -F.col("nx.ep_before")).otherwise(F.col("nx.ep_before"))
    df = df.withColumn("hs_after", F.when(F.col("ep_before").isNotNull(), after))
    return df.withColumn("hs_epa", F.col("hs_after") - F.col("ep_before")).drop("nx")


def drive_summary(plays: DataFrame) -> DataFrame:
    """One row a drive: plays, yards, points and where it began; needs with_drives()."""
    real = F.col("play_type").isin("pass", "rush", "sack")
    return plays.groupBy("game_id", "drive").agg(
        F.min("play_index").alias("first_play"),
        F.sum(real.cast("long")).alias("n_plays"),
        F.sum(F.when(real, F.col("yards_gained")).otherwise(0)).cast("long").alias("yards"),
        F.max("drive_points").cast("long").alias("points"),
        F.max_by("play_type", "play_index").alias("last_type"),
    )


#: Plays that a drive's count, yards and EPA take in (fixed values).
DRIVE_PLAYS = ("pass", "rush", "sack", "field_goal", "penalty")


def game_team_map(plays: DataFrame) -> DataFrame:
    """(game_id, possession_team_id, team) for display, in games with two ids and known teams.

    The side that the first play with one names, other than a kickoff or marker, is that of its id; without
    such a play the id seen first is the away team's.
    """
    at, named = F.col("play_index"), F.col("possession_team_id").isNotNull() & F.col("yard_line_team").isNotNull() & ~F.col("play_type").isin("kickoff", "quarter_marker")
    ident = F.col("possession_team_id")
    games = plays.groupBy("game_id").agg(
        F.min_by("home_team", F.when(F.col("home_team").isNotNull(), at)).alias("home"), F.min_by("away_team", F.when(F.col("away_team").isNotNull(), at)).alias("away"), F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.count_distinct(ident).alias("n"),
        F.min_by(F.struct(ident.alias("id"), F.col("yard_line_team").alias("team")), F.when(named, at)).alias("f"), F.min_by(ident, F.when(ident.isNotNull(), at)).alias("first"),
    ).where("n = 2 AND home is not null AND away is not null")
    ident, team = F.coalesce("f.id", "first"), F.coalesce("f.team", "away")
    rest = F.struct(F.when(F.col("lo") == ident, F.col("hi")).otherwise(F.col("lo")).alias("possession_team_id"), F.when(team == F.col("home"), F.col("away")).otherwise(F.col("home")).alias("team"))
    return games.select("game_id", F.inline(F.array(F.struct(ident.alias("possession_team_id"), team.alias("team")), rest)))


def game_drives(plays: DataFrame) -> DataFrame:
    """The drives of a game as its viewer lists them: number from 1, side, start, result of the last play, and plays, yards and EPA of DRIVE_PLAYS.

    A drive begins where the possession (unknown is one of its own) or the half changes, and with each kickoff, not
    after a score. Needs half and epa. A team that is not known has a null name, and its start is the raw yard line.
    """
    now, was = F.struct("possession_team_id", "half"), F.lag(F.struct("possession_team_id", "half")).over(_game())
    rows = plays.withColumn("drive", F.sum((~now.eqNullSafe(was) | (F.col("play_type") == "kickoff")).cast("int")).over(_game()))
    yes, at, real = lambda c: F.coalesce(F.col(c), F.lit(False)), F.col("play_index"), F.col("play_type").isin(*DRIVE_PLAYS)
    result = F.when(yes("touchdown"), "TD").when(yes("fg_good"), "FG").when(yes("interception"), "INT").when(yes("fumble_lost"), "FUM").when(yes("safety"), "Safety").when((F.col("play_type") == "field_goal") & (F.col("fg_good") == F.lit(False)), "Missed FG").when((F.col("down") == 4) & ~yes("first_down"), "Turnover on Downs").otherwise("Punt / End")
    out = rows.groupBy("game_id", "drive", "possession_team_id").agg(
        F.min_by("quarter", at).alias("start_quarter"), F.min_by("clock", at).alias("start_clock"), F.max_by(result, at).alias("result"), F.count_if(real).alias("n_plays"),
        F.sum(F.when(real, F.coalesce("yards_gained", F.lit(0))).otherwise(0)).cast("long").alias("yards"), F.sum(F.when(real, F.coalesce("epa", F.lit(0.0))).otherwise(0.0)).alias("epa"),
        F.min_by(F.struct("yard_line", "yard_line_team"), F.when(real, at)).alias("s"),
    )
    out = out.join(game_team_map(plays), ["game_id", "possession_team_id"], "left")
    spot = F.when(F.col("s.yard_line_team") != F.col("team"), 100 - F.col("s.yard_line")).otherwise(F.col("s.yard_line"))
    return out.select("game_id", "drive", "team", "start_quarter", "start_clock", spot.alias("start_yards"), "result", "n_plays", "yards", "epa")


def all_abbreviations(plays: DataFrame) -> DataFrame:
    """(id, teams): every team name that an id resolves to in some season."""
    return resolve_team_ids(plays, "season").groupBy("id").agg(F.array_sort(F.collect_set("team")).alias("teams"))


def backfill(plays: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Fills half_seconds and yl100 where they are null; a side is the own one if it is among the id's all_abbreviations().

    What lacks a clock that can be read, a quarter, a yard line, its side or a possession stays null.
    """
    seconds = loaded_half_seconds(F.col("quarter"), F.col("clock"))
    known = F.col("yard_line").isNotNull() & F.col("yard_line_team").isNotNull() & F.col("possession_team_id").isNotNull()
    own = F.coalesce(F.array_contains("__teams", F.col("yard_line_team")), F.lit(False))
    yards = F.when(known, F.when(own, F.col("yard_line")).otherwise(100 - F.col("yard_line")))
    rows = plays.join(abbreviations.select(F.col("id").alias("possession_team_id"), F.col("teams").alias("__teams")), "possession_team_id", "left")
    return rows.withColumns({"half_seconds": F.coalesce("half_seconds", seconds), "yl100": F.coalesce("yl100", yards)}).select(plays.columns)


def resolve_team_ids(plays: DataFrame, *by: str) -> DataFrame:
    """(id, team) of each ``by``: the one team that is in every game of the id; ids with none or several are left out."""
    seen = plays.where("possession_team_id is not null").select("game_id", *by, "home_team", "away_team", "possession_team_id").distinct()
    games = seen.groupBy(*by, "possession_team_id").agg(F.count_distinct("game_id").alias("games"))
    teams = seen.select(*by, "possession_team_id", "game_id", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    full = teams.groupBy(*by, "possession_team_id", "team").agg(F.count("*").alias("games")).join(games, [*by, "possession_team_id", "games"])
    return full.groupBy(*by, "possession_team_id").agg(F.count("*").alias("n"), F.min("team").alias("team")).where("n = 1").select(F.col("possession_team_id").alias("id"), *by, "team")
