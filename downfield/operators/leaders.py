"""Season and career tables of players and teams, leaderboards, dashboards and the play browser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.operators.drives import resolve_team_ids
from downfield.operators.games import with_week

OFFENSE, DEFENSE = ("passer", "rusher", "receiver"), ("tackler", "sacker", "interceptor")
#: Roles by which the plays of a player are found; those that a table has no ids of are left out.
ROLES = (*OFFENSE, *DEFENSE, "kicker", "returner", "fumble_recoverer")
#: Positions as football lists them (fixed values); others follow in alphabetical order.
POSITIONS = ("QB", "RB", "FB", "WR", "TE", "OL", "DL", "DE", "DT", "LB", "CB", "S", "FS", "SS", "K", "P")


@dataclass(frozen=True)
class Category:
    """One kind of leaderboard: its EPA, its plays and the statistics of its game rows."""

    epa: str
    plays: str
    ident: str
    stats: tuple[str, ...]
    types: tuple[str, ...]
    least: int
    ascending: bool = False


#: Plays that each category counts, and the least number of them for a leader (fixed values).
CATEGORIES = {
    "passing": Category("pass_epa", "dropbacks", "passer_id", ("comp", "att", "yards", "td", "interceptions", "sacks"), ("pass", "sack"), 100),
    "rushing": Category("rush_epa", "rush_plays", "rusher_id", ("att", "yards", "td", "fumbles"), ("rush",), 50),
    "receiving": Category("recv_epa", "targets", "receiver_id", ("rec", "yards", "td"), ("pass",), 30),
    "defense": Category("def_epa", "def_plays", "player_id", ("tackles", "sacks", "interceptions", "fumble_recoveries", "forced_fumbles"), ("pass", "rush", "sack"), 50, ascending=True),
}


def _category(name: str) -> Category:
    if name not in CATEGORIES:
        raise ValueError(f"{name}: a category is one of {', '.join(CATEGORIES)}")
    return CATEGORIES[name]


def paged(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Part of an ordered list."""
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def player_season_epa(plays: DataFrame) -> DataFrame:
    """One row a player, season and game type: EPA and plays passing, rushing, receiving and defending; needs epa.

    A defender is the sacker, else the interceptor, else the tackler. The team is that of
    the player's first play in the first of these categories. Preseason is left out. One
    explode and one grouping make all four.
    """
    p = F.col("play_type")
    role = lambda rank, kind, cond, ident, team: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.when(cond, ident).alias("player_id"), F.col(team).alias("team"))
    roles = F.array(
        role(0, "passing", p.isin("pass", "sack"), F.col("passer_id"), "possession_team"),
        role(1, "rushing", p == "rush", F.col("rusher_id"), "possession_team"),
        role(2, "receiving", p == "pass", F.col("receiver_id"), "possession_team"),
        role(3, "defense", p.isin("pass", "rush", "sack"), F.coalesce("sacker_id", "interceptor_id", "tackler_id"), "defense_team"),
    )
    rows = plays.where("epa is not null AND game_type <> 'preseason'").select("season", "game_type", "game_id", "play_index", "epa", F.explode(F.filter(roles, lambda r: r.player_id.isNotNull())).alias("r"))
    sums = [a for k, c in CATEGORIES.items() for a in (F.sum(F.when(F.col("r.kind") == k, F.col("epa")).otherwise(0.0)).alias(c.epa), F.count_if(F.col("r.kind") == k).alias(c.plays))]
    first = F.when(F.col("r.team").isNotNull(), F.struct("r.rank", "game_id", "play_index"))
    return rows.groupBy(F.col("r.player_id").alias("player_id"), "season", "game_type").agg(F.min_by("r.team", first).alias("team"), *sums)


def season_stats(games: DataFrame, ident: str, stats: tuple[str, ...], *by: str) -> DataFrame:
    """Sums of game rows for each player (null ids are a group) and ``by``, with the number of games."""
    return games.groupBy(F.col(ident).alias("player_id"), *by).agg(*(F.sum(s).alias(s) for s in stats), F.count_distinct("game_id").alias("games"))


def common_position(positions: DataFrame) -> DataFrame:
    """Each player's most frequent position; of equals the first in alphabetical order."""
    counts = positions.groupBy("player_id", "position").agg(F.count("*").alias("n"))
    return counts.groupBy("player_id").agg(F.min_by("position", F.struct((-F.col("n")).alias("n"), "position")).alias("position"))


def leaderboard(epa: DataFrame, games: DataFrame, positions: DataFrame, category: str, career: bool = False, min_plays: int = 1, limit: int | None = None, position: str | None = None, team: str | None = None) -> DataFrame:
    """Players by EPA a play, with statistics and position; in career mode over all seasons given.

    ``epa``: player_season_epa(), ``games``: game rows of the category with season and
    game_type, ``positions``: one row a player and season. A career's team is the last in
    alphabetical order. Ties go by player_id and season. ``limit`` is the length of the report.
    """
    c = _category(category)
    if career:
        rows = epa.where(F.col(c.plays) > 0).groupBy("player_id").agg(F.max("team").alias("team"), F.sum(c.epa).alias(c.epa), F.sum(c.plays).alias(c.plays))
        on, pos, extra = ["player_id"], common_position(positions), []
    else:
        rows, on, pos, extra = epa.select("player_id", "season", "game_type", "team", c.epa, c.plays), ["player_id", "season"], positions, ["game_type"]
    rows = rows.where(F.col(c.plays) >= min_plays)
    rows = rows.join(season_stats(games, c.ident, c.stats, *(on + extra)[1:]), on + extra, "left").join(pos, on, "left")
    rows = rows.where(F.col("position") == position) if position else rows
    rows = rows.where(F.col("team") == team) if team else rows
    rows = rows.withColumn("epa_per_play", F.col(c.epa) / F.col(c.plays)).fillna(0, subset=[*c.stats, "games"])
    order = F.asc_nulls_last("epa_per_play") if c.ascending else F.desc_nulls_last("epa_per_play")
    return paged(rows.orderBy(order, *on, *extra), limit=limit)


def position_baseline(epa: DataFrame, positions: DataFrame, category: str, min_plays: int = 1) -> DataFrame:
    """EPA+ of each player, season and game type: 100 (EPA a play - the weighted average of the same position).

    A player without a position is held against all players.
    """
    c = _category(category)
    rows = epa.where(F.col(c.plays) >= min_plays).select("player_id", "season", "game_type", (F.col(c.epa) / F.col(c.plays)).alias("per_play"), c.epa, c.plays).join(positions, ["player_id", "season"], "left")
    by = ["season", "game_type"]
    average = lambda df, *k: df.groupBy(*k).agg((F.sum(c.epa) / F.nullif(F.sum(c.plays), F.lit(0))).alias(f"avg_{len(k)}"))
    out = rows.join(average(rows, *by), by, "left").join(average(rows.where("position is not null"), *by, "position"), [*by, "position"], "left")
    return out.select("player_id", *by, "position", "per_play", ((F.col("per_play") - F.coalesce("avg_3", "avg_2")) * 100).alias("plus"))


def team_dashboard(epa: DataFrame, games: DataFrame, results: DataFrame, side: str) -> DataFrame:
    """One ranked row a team, season and game type: EPA, record and rates of its offense, or what its defense allows.

    ``epa``: team_epa(), ``games``: team_games(), ``results``: game_results(). Teams in either part
    appear. The rank is within a season and game type, by EPA a play, the best first; ties share the rank.
    """
    key, by = ["season", "game_type", "team"], ["season", "game_type"]
    rows = results.join(games, ["game_id", "season", "team"], "left")
    who = "team" if side == "offense" else "opponent"
    sums = ("pass_comp", "pass_att", "pass_yards", "rush_att", "rush_yards", "sacks_taken", "interceptions_thrown", "fumbles_lost")
    trad = rows.groupBy(*by, F.col(who).alias("team")).agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums))
    record = results.groupBy(*key).agg(F.count_if(F.expr("points_for > points_against")).alias("wins"), F.count_if(F.expr("points_for < points_against")).alias("losses"), F.count_if(F.expr("points_for = points_against")).alias("ties"), F.sum("points_for").alias("points_for"), F.sum("points_against").alias("points_against"))
    league = epa.groupBy(*by, "side").agg((F.sum("total_epa") / F.nullif(F.sum("plays"), F.lit(0))).alias("league"))
    plus = epa.join(league, [*by, "side"]).withColumn("plus", (F.col("epa_per_play") - F.col("league")) * 100)
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = plus.groupBy(*key).agg(*(pick(side, c).alias(c) for c in ("total_epa", "pass_epa", "rush_epa", "epa_per_play", "success_rate")), pick("offense", "plus").alias("off_plus"), pick("defense", "plus").alias("def_plus"))
    out = trad.join(record, key, "full").join(wide, key, "full")
    drops = F.col("pass_att") + F.col("sacks_taken")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = out.select(
        *key, "wins", "losses", "ties", F.concat_ws("-", "wins", "losses", F.when(F.col("ties") > 0, F.col("ties"))).alias("record"), "points_for", "points_against", "epa_per_play", "total_epa", "success_rate",
        "off_plus", "def_plus", (F.col("off_plus") - F.col("def_plus")).alias("net_plus"), "pass_yards", "rush_yards", "fumbles_lost",
        rate(F.col("pass_epa"), drops).alias("epa_per_pass"), rate(F.col("rush_epa"), F.col("rush_att")).alias("epa_per_rush"), rate(F.col("pass_comp"), F.col("pass_att")).alias("comp_rate"),
        rate(F.col("sacks_taken"), drops).alias("sack_rate"), rate(F.col("interceptions_thrown"), F.col("pass_att")).alias("int_rate"),
    )
    order = F.desc_nulls_last("epa_per_play") if side == "offense" else F.asc_nulls_last("epa_per_play")
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)))


def ranked_by(df: DataFrame, column: str, *by: str, ascending: bool = False) -> DataFrame:
    """Adds rank by any column among ``by``, nulls last; equals share a rank. A record ('3-1') ranks by its wins."""
    value = F.get(F.split(column, "-"), F.lit(0)).try_cast("int") if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    order = F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value)
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)))


def with_heat(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Adds heat: distance of ``column`` from its mean among ``by``, 1 at the farther of minimum and maximum."""
    bounds = df.groupBy(*by).agg(F.avg(column).alias("__mid"), F.greatest(F.max(column) - F.avg(column), F.avg(column) - F.min(column)).alias("__half"))
    heat = F.least(F.abs(F.col(column) - F.col("__mid")) / F.nullif("__half", F.lit(0)), F.lit(1.0))
    return df.join(bounds, list(by)).withColumn("heat", F.coalesce(heat, F.lit(0.0))).drop("__mid", "__half")


def any_of(roles: tuple[str, ...]) -> Column:
    return F.array(*(F.col(f"{r}_id") for r in roles))


def play_list(plays: DataFrame, season: int | None = None, game_id: int | None = None, play_type: str | None = None, player_id: int | None = None, roles: tuple[str, ...] = ROLES, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Plays that pass the filters given, in order of game and play; offset and limit are a page of the list.

    A player's plays are those in which one of the roles is his.
    """
    for name, value in (("season", season), ("game_id", game_id), ("play_type", play_type)):
        plays = plays.where(F.col(name) == value) if value is not None else plays
    if player_id is not None:
        plays = plays.where(F.coalesce(F.array_contains(any_of(tuple(r for r in roles if f"{r}_id" in plays.columns)), F.lit(player_id)), F.lit(False)))
    return paged(plays.orderBy("game_id", "play_index"), offset, limit)


def epa_leaders(epa: DataFrame, plays: DataFrame, kind: str, season: int, game_type: str = "regular", least: int | None = None, top: int | None = 20) -> DataFrame:
    """The best players of a season and game type by EPA a play, with epa_plus = 100 (EPA a play - league average), to one digit.

    epa: player_season_epa(), plays: with epa; the average is over all plays of the category.
    Of equals the smallest ids come first. least: plays that a leader has, top: length of the report.
    """
    c = _category(kind)
    here = (F.col("season") == season) & (F.col("game_type") == game_type)
    league = plays.where(here & F.col("play_type").isin(*c.types) & F.col("epa").isNotNull()).groupBy("season").agg(F.avg("epa").alias("__league"))
    rows = epa.where(here & (F.col(c.plays) >= (c.least if least is None else least)))
    rows = rows.select("player_id", "season", "team", c.epa, c.plays, (F.col(c.epa) / F.col(c.plays)).alias("epa_per_play")).join(league, "season", "left")
    rows = rows.withColumn("epa_plus", F.round((F.col("epa_per_play") - F.col("__league")) * 100, 1)).drop("__league")
    order = F.asc_nulls_last if c.ascending else F.desc_nulls_last
    return paged(rows.orderBy(order("epa_per_play"), "player_id"), limit=top)


def game_logs(games: DataFrame, kind: str, player_id: int | None = None, season: int | None = None) -> DataFrame:
    """Game rows of a category in order of player, season and game; an unknown category is an error."""
    c = _category(kind)
    rows = games.where(F.col(c.ident) == player_id) if player_id is not None else games
    rows = rows.where(F.col("season") == season) if season is not None else rows
    return rows.select(F.col(c.ident).alias("player_id"), "season", "game_id", *c.stats).orderBy("player_id", "season", "game_id")


#: Roles on each side, in the order in which a play's first player is taken, and in which its players are listed (fixed values).
SIDES = {"offense": (("passer", "rusher", "receiver"), ("passer", "receiver", "rusher")), "defense": (("interceptor", "fumble_recoverer", "sacker", "tackler"), ("interceptor", "fumble_recoverer", "sacker", "tackler"))}


def browse(
    plays: DataFrame, positions: DataFrame, side: str, seasons: tuple[int, int] | None = None, game_type: str | None = "regular", play_type: str | None = None, position: str | None = None, player_id: int | None = None,
    team: str | None = None, sort: str = "season", ascending: bool = False, offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Plays with a player on the given side: week, teams by resolved ids, first player, players with roles as text, and EPA.

    Weeks count from the season's first game among the rows. ``team`` keeps the games of a team
    and, if an id resolves to it, the plays in which that id has the ball (offense) or not
    (defense). ``position`` keeps plays with a player of that position on the side.
    Sorted by season, the last first, or by epa or yards_gained, nulls last; then by game and play.
    """
    first, listed = SIDES[side]
    ids = [F.col(f"{r}_id") for r in first]
    rows = plays.where(F.coalesce(*ids).isNotNull())
    rows = rows.where(F.col("season").between(*seasons)) if seasons else rows
    rows = rows.where(F.col("game_type") == game_type) if game_type else rows
    rows = rows.where(F.col("play_type") == play_type) if play_type else rows
    known = plays.where(F.col("home_team").isNotNull())
    known = known.where(F.col("season").between(*seasons)) if seasons else known
    if team:
        in_game = (F.col("home_team") == team) | (F.col("away_team") == team)
        own = resolve_team_ids(known.where(in_game), "season").where(F.col("team") == team).select(F.col("id").alias("possession_team_id")).distinct()
        rows = rows.where(in_game)
        if not own.isEmpty():
            rows = rows.where("possession_team_id is not null").join(own, "possession_team_id", "left_semi" if side == "offense" else "left_anti")
    rows = rows.where(F.array_contains(F.array(*ids), F.lit(player_id))) if player_id is not None else rows
    named = F.array_compact(F.array(*(F.when(F.col(f"{r}_id").isNotNull(), F.struct(F.col(f"{r}_id").alias("player_id"), F.lit(r).alias("role"))) for r in listed)))
    rows = rows.withColumn("players", named)
    if position:
        wanted = positions.where(F.col("position") == position).select("player_id", "season")
        keys = rows.select("game_id", "play_index", "season", F.explode("players.player_id").alias("player_id")).join(wanted, ["player_id", "season"], "left_semi")
        rows = rows.join(keys.select("game_id", "play_index").distinct(), ["game_id", "play_index"], "left_semi")
    teams = resolve_team_ids(known, "season").select("season", F.col("id").alias("possession_team_id"), F.col("team").alias("off_team"))
    rows = with_week(rows).join(teams, ["season", "possession_team_id"], "left")
    other = F.when(F.col("off_team").isNotNull() & F.col("home_team").isNotNull() & F.col("away_team").isNotNull(), F.when(F.col("off_team") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team")))
    told = F.array_join(F.transform("players", lambda x: F.concat_ws(":", x.role, x.player_id)), ",")
    out = rows.select("game_id", "play_index", "season", "week", "play_type", "off_team", other.alias("def_team"), F.coalesce(*ids).alias("player_id"), told.alias("players"), "yards_gained", "epa")
    order = F.desc("season") if sort == "season" else F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)
    return paged(out.orderBy(order, "game_id", "play_index"), offset, limit)


def positions_in_order(positions: DataFrame) -> DataFrame:
    """Distinct positions: those of POSITIONS in its order, then the rest."""
    at = F.array_position(F.array(*(F.lit(p) for p in POSITIONS)), F.col("position"))
    return positions.select("position").distinct().orderBy(F.when(at == 0, len(POSITIONS) + 1).otherwise(at), "position")


def series(rows: DataFrame, label: str, by: str, values: list, value: str, count: str = "n") -> DataFrame:
    """Curve rows to one row a label: value_<v> and n_<v> for each v of ``values``; a missing point has a null value and count 0."""
    wide = rows.groupBy(label).agg(*(a for v in values for a in (F.max(F.when(F.col(by) == v, F.col(value))).alias(f"value_{v}"), F.coalesce(F.max(F.when(F.col(by) == v, F.col(count))), F.lit(0)).alias(f"n_{v}"))))
    return wide.orderBy(label)


def reconcile(games: DataFrame, box: DataFrame, stats: tuple[str, ...], *by: str) -> DataFrame:
    """Share of rows of both tables that agree, for each statistic and ``by``; joined on game_id and team."""
    rows = games.select("game_id", "team", *by, *stats).join(box.select("game_id", "team", *(F.col(s).alias(f"__{s}") for s in stats)), ["game_id", "team"])
    pairs = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).eqNullSafe(F.col(f"__{s}")).alias("same")) for s in stats))
    return rows.select(*by, F.inline(pairs)).groupBy(*by, "stat").agg(F.count("*").alias("compared"), F.count_if("same").alias("same"), F.avg(F.col("same").cast("double")).alias("match_rate"))
