"""Scores, sides, weeks and model features of games, by windows that begin with game_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from downfield.functions.context import half_seconds, scrimmage
from downfield.operators.drives import resolve_team_ids

#: First season of the newer engine, bounds of features, yard lines that show the receiving side (fixed values).
ENGINE_SEASON, SCORE_CLIP, DISTANCE_CLIP = 27, 28, 30
TOUCHBACK, OWN_HALF, RETURN_SPOT = 25, 50, 45


def _game() -> WindowSpec:
    return Window.partitionBy("game_id").orderBy("play_index")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def own_points() -> Column:
    """Points that the side in possession scores: a touchdown with its kick, or a field goal."""
    return F.when(_flag("touchdown"), 6 + _flag("pat_good").cast("int")).when(_flag("fg_good"), 3).otherwise(0)


def safety_points() -> Column:
    return F.when(_flag("safety"), 2).otherwise(0)


def with_scores(plays: DataFrame) -> DataFrame:
    """Adds score_home and score_away before each play.

    The larger of a game's two ids is the home side; points without a possession go to
    the other one. Null in games with fewer ids. Games that hold a score keep theirs.
    """
    all_game = Window.partitionBy("game_id")
    high, low = F.max("possession_team_id").over(all_game), F.min("possession_team_id").over(all_game)
    home = F.coalesce(F.col("possession_team_id") == F.col("__high"), F.lit(False))
    before = _game().rowsBetween(Window.unboundedPreceding, -1)
    df = plays.withColumns({"__high": high, "__two": high != low})
    rebuilt = {}
    for side, mine in (("home", home), ("away", ~home)):
        total = F.coalesce(F.sum(F.when(mine, own_points()).otherwise(safety_points())).over(before), F.lit(0))
        rebuilt[side] = F.when(F.col("__two"), total)
    if {"score_home", "score_away"} <= set(plays.columns):
        known = F.max(F.col("score_away").isNotNull()).over(all_game)
        rebuilt = {s: F.when(known, F.col(f"score_{s}")).otherwise(c) for s, c in rebuilt.items()}
    return df.withColumns({f"score_{s}": c for s, c in rebuilt.items()}).drop("__high", "__two")


def game_results(plays: DataFrame) -> DataFrame:
    """Two rows a game: team, opponent, points_for, points_against. Plays without a possession add nothing."""
    is_home = F.col("possession_team") == F.col("home_team")
    own = own_points() + F.when(~_flag("touchdown") & _flag("pat_good"), 1).otherwise(0)
    totals = plays.groupBy("game_id", "season", "game_type").agg(
        F.min_by(F.struct("home_team", "away_team"), F.when(F.col("home_team").isNotNull() & F.col("away_team").isNotNull(), F.col("play_index"))).alias("teams"),
        F.sum(F.when(is_home, own).when(~is_home, safety_points()).otherwise(0)).alias("home"),
        F.sum(F.when(is_home, safety_points()).when(~is_home, own).otherwise(0)).alias("away"),
    )
    row = lambda a, b: F.struct(F.col(f"teams.{a}_team").alias("team"), F.col(f"teams.{b}_team").alias("opponent"), F.col(a).alias("points_for"), F.col(b).alias("points_against"), F.lit(a == "home").alias("at_home"))
    return totals.select("game_id", "season", "game_type", F.inline(F.array(row("home", "away"), row("away", "home"))))


def game_list(results: DataFrame) -> DataFrame:
    """One row a game with both sides, from game_results()."""
    pick = lambda c, at: F.max(F.when(F.col("at_home") == at, F.col(c)))
    return results.groupBy("game_id", "season", "game_type").agg(pick("team", True).alias("home_team"), pick("points_for", True).alias("home_points"), pick("team", False).alias("away_team"), pick("points_for", False).alias("away_points"))


def with_week(plays: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """Adds week: every seven game ids from the season's first among ``firsts`` (the rows themselves if None).

    The first ids are one row a season; the optimizer chooses the join.
    """
    first = (plays if firsts is None else firsts).groupBy("season").agg(F.min("game_id").alias("__first"))
    return plays.join(first, "season", "left").withColumn("week", (F.floor((F.col("game_id") - F.col("__first")) / 7) + 1).cast("long")).drop("__first")


def with_features(plays: DataFrame) -> DataFrame:
    """Adds the model features; needs yl100 and scores.

    Without team names the home side is the larger of the game's two ids; a score that
    is unknown counts as 0.
    """
    all_game = Window.partitionBy("game_id")
    high, low = F.max("possession_team_id").over(all_game), F.min("possession_team_id").over(all_game)
    by_id = F.coalesce((high != low) & (F.col("possession_team_id") == high), F.lit(False))
    df = plays.withColumn("is_home", F.coalesce(F.col("possession_team") == F.col("home_team"), by_id).cast("int"))
    ahead = F.coalesce("score_home", F.lit(0)) - F.coalesce("score_away", F.lit(0))
    signed = F.when(F.col("is_home") == 1, ahead).otherwise(-ahead)
    return df.withColumns({
        "score_differential": F.greatest(F.least(signed, F.lit(SCORE_CLIP)), F.lit(-SCORE_CLIP)),
        "half_seconds_remaining": half_seconds(F.col("quarter"), F.col("clock")),
        "is_overtime": (F.col("quarter") >= 5).cast("int"),
        "engine_era": (F.col("season") >= ENGINE_SEASON).cast("int"),
        "distance": F.when(F.col("distance").isNotNull(), F.least("distance", F.lit(DISTANCE_CLIP))),
    })


def drive_matrix(plays: DataFrame) -> DataFrame:
    """Valid scrimmage rows with features, weight (1 / length of the run of equal possession and half) and starts_run.

    Needs with_features() and half; runs are counted over the rows that remain.
    """
    rows = plays.where(scrimmage() & F.col("yl100").isNotNull() & F.col("score_home").isNotNull() & F.col("score_away").isNotNull())
    now, was = F.struct("possession_team_id", "half"), F.lag(F.struct("possession_team_id", "half")).over(_game())
    rows = rows.withColumn("starts_run", ~now.eqNullSafe(was)).withColumn("__run", F.sum(F.col("starts_run").cast("int")).over(_game()))
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("game_id", "__run"))).drop("__run")


def without_preseason(plays: DataFrame, types: DataFrame) -> DataFrame:
    """Leaves out the games that (game_id, game_type) lists as preseason; games it does not list stay."""
    return plays.join(types.where("game_type = 'preseason'").select("game_id"), "game_id", "left_anti")


def training_plays(plays: DataFrame, seasons: list[int], league: str | None = None) -> DataFrame:
    """Plays of the seasons (and league) outside the preseason, with possession_team and scores where they were missing.

    A missing possession is that of an id that resolves to one team over the rows that name both teams, else the
    side by kickoff_votes(). Scores are rebuilt by with_scores().
    """
    rows = plays.where(F.col("season").isin(list(seasons)) & (F.col("game_type") != "preseason"))
    rows = rows.where(F.col("league") == league) if league else rows
    byid = resolve_team_ids(rows.where("possession_team is null AND home_team is not null")).select(F.col("id").alias("possession_team_id"), F.col("team").alias("__resolved"))
    rows = rows.join(byid, "possession_team_id", "left").join(kickoff_votes(rows).withColumnRenamed("team", "__vote"), ["game_id", "possession_team_id"], "left")
    team = F.coalesce("possession_team", F.when(F.col("home_team").isNotNull(), F.col("__resolved")), "__vote")
    return with_scores(rows.withColumn("possession_team", team).drop("__resolved", "__vote").select(plays.columns))


def drive_starts(plays: DataFrame) -> DataFrame:
    """Scrimmage rows whose possession or half differs from the scrimmage row before, or with a kickoff between; needs half."""
    df = plays.withColumn("__kicks", F.count_if(F.col("play_type") == "kickoff").over(_game()))
    rows = df.where(F.col("play_type").isin("pass", "rush", "sack", "field_goal") & F.col("possession_team_id").isNotNull())
    now = F.struct("possession_team_id", "half", "__kicks")
    return rows.withColumn("__was", F.lag(now).over(_game())).where(~now.eqNullSafe(F.col("__was"))).drop("__kicks", "__was")


def play_spans(plays: DataFrame) -> DataFrame:
    """Adds span_start and span_end in yards from the own goal to the scrimmage plays of a drive, and a field label; needs drive and yl100.

    A play ends where the next begins, the last after its yards; one of no length is half a yard long.
    """
    rows = plays.where(F.col("play_type").isin("pass", "rush", "sack") & F.col("yl100").isNotNull())
    cut = lambda c: F.greatest(F.least(c, F.lit(100)), F.lit(0)).cast("double")
    drive = Window.partitionBy("game_id", "drive").orderBy("play_index")
    rows = rows.withColumn("span_start", cut(F.col("yl100")))
    end = F.coalesce(F.lead("span_start").over(drive), cut(F.col("yl100") + F.coalesce("yards_gained", F.lit(0))))
    rows = rows.withColumn("span_end", end).withColumn("span_end", F.when(F.col("span_end") == F.col("span_start"), F.col("span_end") + 0.5).otherwise(F.col("span_end")))
    label = F.when(F.col("yl100") <= 50, F.concat(F.lit("Own "), F.col("yl100").cast("string"))).otherwise(F.concat(F.lit("Opp "), (100 - F.col("yl100")).cast("string")))
    return rows.withColumn("field_label", label)


def game_teams(plays: DataFrame) -> DataFrame:
    """home_team and away_team of each game: those of its first play that has both."""
    known = plays.where("home_team is not null AND away_team is not null")
    return known.groupBy("game_id").agg(F.min_by(F.struct("home_team", "away_team"), "play_index").alias("t")).select("game_id", "t.*")


def kickoff_votes(plays: DataFrame) -> DataFrame:
    """(game_id, possession_team_id, team): the side most often named on plays right after a kickoff.

    Only in games with two ids and two sides or more; of equal counts the side seen first wins.
    """
    sizes = plays.groupBy("game_id").agg(F.count_distinct("possession_team_id").alias("ids"), F.count_distinct("yard_line_team").alias("sides")).where("ids >= 2 AND sides >= 2").select("game_id")
    rows = plays.withColumn("__was", F.lag("play_type").over(_game()))
    rows = rows.where((F.col("__was") == "kickoff") & F.col("play_type").isin("pass", "rush", "sack") & (F.col("yard_line") <= OWN_HALF) & F.col("possession_team_id").isNotNull() & F.col("yard_line_team").isNotNull())
    votes = rows.groupBy("game_id", "possession_team_id", F.col("yard_line_team").alias("team")).agg(F.count("*").alias("n"), F.min("play_index").alias("first"))
    best = votes.groupBy("game_id", "possession_team_id").agg(F.max_by("team", F.struct(F.col("n"), -F.col("first"))).alias("team"))
    return best.join(sizes, "game_id", "left_semi")


def kickoff_sides(plays: DataFrame) -> DataFrame:
    """(game_id, home_id, away_id) of games with two ids and known teams.

    First by plays after a kickoff at the touchback line, where later rows of an id count
    until the other id has one; then, for ids still open, by the first pass, rush or sack after a
    kickoff short of the return spot. One id found gives the other; none leaves the lower as away.
    """
    rows = plays.withColumn("__was", F.lag("play_type").over(_game()))
    rows = rows.where((F.col("__was") == "kickoff") & (F.col("play_type") != "kickoff") & F.col("possession_team_id").isNotNull())
    teams = game_teams(plays).join(plays.groupBy("game_id").agg(F.array_sort(F.collect_set("possession_team_id")).alias("ids")).where("size(ids) = 2"), "game_id")
    rows = rows.select("game_id", "play_index", "play_type", "yard_line", F.col("possession_team_id").alias("id"), F.col("yard_line_team").alias("side"))
    rows = rows.join(teams.select("game_id", "home_team", "away_team"), "game_id").where("side IN (home_team, away_team)")
    at, ident, all_game = F.col("play_index"), Window.partitionBy("game_id", "id"), Window.partitionBy("game_id")
    sure = F.col("yard_line") == TOUCHBACK
    near = (F.col("yard_line") <= RETURN_SPOT) & F.col("play_type").isin("pass", "rush", "sack")
    rows = rows.withColumn("__first", F.min(F.when(sure, at)).over(ident))
    rows = rows.withColumns({"__one": F.min("__first").over(all_game), "__two": F.max("__first").over(all_game)})
    counts = sure & F.when(F.col("__first") == F.col("__one"), (F.col("__one") == F.col("__two")) | (at < F.col("__two"))).otherwise(at == F.col("__first"))
    found = rows.groupBy("game_id", "id", "home_team").agg(
        F.coalesce(F.max_by("side", F.when(counts, at)), F.min_by("side", F.when(near, at))).alias("side"),
        F.coalesce(F.min(F.when(sure, F.struct(F.lit(0).alias("step"), at.alias("at")))), F.min(F.when(near, F.struct(F.lit(1).alias("step"), at.alias("at"))))).alias("order"),
    ).where("side is not null")
    home = F.col("side") == F.col("home_team")
    by_game = found.groupBy("game_id").agg(F.count("*").alias("n"), F.max_by("id", F.when(home, F.col("order"))).alias("h"), F.max_by("id", F.when(~home, F.col("order"))).alias("a"))
    out = teams.join(by_game, "game_id", "left")
    other = lambda c: F.when(F.col(c).isNotNull(), F.when(F.get("ids", F.lit(0)) == F.col(c), F.get("ids", F.lit(1))).otherwise(F.get("ids", F.lit(0))))
    pick = lambda c, o, i: F.when(F.col("n") == 2, F.col(c)).when(F.col("n") == 1, F.coalesce(F.col(c), other(o))).otherwise(F.get("ids", F.lit(i)))
    return out.select("game_id", pick("h", "a", 1).alias("home_id"), pick("a", "h", 0).alias("away_id"))


def fourth_downs(plays: DataFrame, by: str = "yards", score: str = "all", at_least: int = 20) -> DataFrame:
    """Shares of going for it, punts and field goals on fourth down by 5 yards or by minute of the half; needs yl100 and, unless score is all, scores.

    score: all, winning, losing or tied, from the side in possession.
    """
    keys = {"yards": (F.floor(F.col("yl100") / 5) * 5).cast("long"), "minute": F.floor(half_seconds(F.col("quarter"), F.col("clock")) / 60).cast("long")}
    rows = plays.where("down = 4 AND play_type IN ('pass','rush','sack','punt','field_goal')")
    rows = rows.where("yl100 BETWEEN 1 AND 99") if by == "yards" else rows
    if score != "all":
        ahead = F.col("score_home") - F.col("score_away")
        lead = F.when(F.col("possession_team") == F.col("home_team"), ahead).when(F.col("possession_team") == F.col("away_team"), -ahead)  # unknown: no lead
        rows = rows.where({"winning": lead > 0, "losing": lead < 0, "tied": lead == 0}[score])
    share = lambda *t: F.avg(F.col("play_type").isin(*t).cast("double")) * 100
    return rows.groupBy(keys[by].alias(by)).agg(F.count("*").alias("n"), share("pass", "rush", "sack").alias("go_pct"), share("punt").alias("punt_pct"), share("field_goal").alias("fg_pct")).where(F.col("n") >= at_least)
