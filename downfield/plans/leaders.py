"""Queries of season tables, leaderboards, dashboards and the play browser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.operators import curves as C
from downfield.operators import games as G
from downfield.operators import leaders as L
from downfield.operators import stats as S
from downfield.plans.queries import EPA, _epa, query, tail
from downfield.sources.projection import POSITIONS_SQL, plays, positions

#: Box-score statistics and their queries.
GAME_ROWS = {"passing": ("a1_player_passing", S.player_passing), "rushing": ("a2_player_rushing", S.player_rushing), "receiving": ("a3_player_receiving", S.player_receiving), "defense": ("a4_player_defense", S.player_defense)}
BOX = ("pass_att", "pass_comp", "pass_yards", "rush_att", "rush_yards")
_ROLES = (("passing", "'pass','sack'", "passer_id", "possession_team"), ("rushing", "'rush'", "rusher_id", "possession_team"), ("receiving", "'pass'", "receiver_id", "possession_team"), ("defense", "'pass','rush','sack'", "coalesce(sacker_id, interceptor_id, tackler_id)", "defense_team"))
SEASON_EPA = (
    EPA
    + ", pr AS ("
    + " UNION ALL ".join(f"SELECT {i} AS rnk, '{k}' AS kind, {ident} AS player_id, season, game_type, game_id, play_index, {team} AS team, epa FROM epa WHERE epa IS NOT NULL AND game_type <> 'preseason' AND play_type IN ({types}) AND {ident} IS NOT NULL" for i, (k, types, ident, team) in enumerate(_ROLES))
    + "), pse AS (SELECT player_id, season, game_type, arg_min(team, rnk * 1000000000000 + game_id * 1000 + play_index) AS team, "
    + ", ".join(f"sum(CASE WHEN kind = '{k}' THEN epa ELSE 0 END) AS {c.epa}, CAST(count(CASE WHEN kind = '{k}' THEN 1 END) AS BIGINT) AS {c.plays}" for k, c in L.CATEGORIES.items())
    + " FROM pr GROUP BY 1, 2, 3)"
)
GAMES = ", gi AS (SELECT DISTINCT game_id, season, game_type FROM plays)"


def _season_epa(spark: SparkSession, sf: str) -> DataFrame:
    return L.player_season_epa(_epa(spark, sf))


def _game_rows(spark: SparkSession, sf: str, category: str) -> DataFrame:
    """Game rows with season and game type; both sides of the join are dealt by game already."""
    base = plays(spark, sf)
    return GAME_ROWS[category][1](base).join(base.select("game_id", "season", "game_type").distinct(), "game_id")


@query(SEASON_EPA + " SELECT player_id, season, game_type, team, def_epa, def_plays FROM pse WHERE def_plays > 0")
def h4_defense_epa(spark: SparkSession, sf: str) -> DataFrame:
    return _season_epa(spark, sf).where("def_plays > 0").select("player_id", "season", "game_type", "team", "def_epa", "def_plays")


@query(SEASON_EPA + " SELECT * FROM pse")
def h5_player_season_epa(spark: SparkSession, sf: str) -> DataFrame:
    return _season_epa(spark, sf)


for _kind, (_rows, _) in GAME_ROWS.items():
    _c = L.CATEGORIES[_kind]
    _sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in _c.stats)

    def _totals(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        c = L.CATEGORIES[kind]
        return L.season_stats(_game_rows(spark, sf, kind), c.ident, c.stats, "season", "game_type").orderBy(F.desc(c.stats[1]), "player_id", "season", "game_type")

    _totals.__name__ = f"a8_{_kind}_totals"
    query(GAMES + tail("gr", _rows) + f" SELECT {_c.ident} AS player_id, season, game_type, {_sums}, count(*) AS games FROM gr JOIN gi USING (game_id) GROUP BY 1, 2, 3")(_totals)

    def _board(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        return L.leaderboard(_season_epa(spark, sf), _game_rows(spark, sf, kind), positions(spark, sf), kind, min_plays=5)

    _nr = {"passing": 19, "rushing": 20, "receiving": 21, "defense": 22}[_kind]
    _board.__name__ = f"q{_nr}_{_kind}_leaderboard"
    _zero = ", ".join(f"coalesce(t.{s}, 0) AS {s}" for s in (*_c.stats, "games"))
    query(
        SEASON_EPA + POSITIONS_SQL + GAMES + tail("gr", _rows) + f", tt AS (SELECT {_c.ident} AS player_id, season, game_type, {_sums}, count(*) AS games FROM gr JOIN gi USING (game_id) GROUP BY 1, 2, 3)"
        f" SELECT e.player_id, e.season, e.game_type, team, {_c.epa}, {_c.plays}, {_zero}, position, {_c.epa} / {_c.plays} AS epa_per_play FROM pse e LEFT JOIN tt t USING (player_id, season, game_type) LEFT JOIN positions USING (player_id, season) WHERE {_c.plays} >= 5"
    )(_board)

    def _career(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        games = _game_rows(spark, sf, kind).where("game_type <> 'preseason'")
        return L.leaderboard(_season_epa(spark, sf), games, positions(spark, sf), kind, career=True, min_plays=5)

    _career.__name__ = f"q23_{_kind}_careers"
    query(
        SEASON_EPA + POSITIONS_SQL + GAMES + tail("gr", _rows) + f", t AS (SELECT {_c.ident} AS player_id, {_sums}, count(*) AS games FROM gr JOIN gi USING (game_id) WHERE game_type <> 'preseason' GROUP BY 1),"
        f" e AS (SELECT player_id, max(team) AS team, sum({_c.epa}) AS {_c.epa}, CAST(sum({_c.plays}) AS BIGINT) AS {_c.plays} FROM pse WHERE {_c.plays} > 0 GROUP BY 1),"
        " ps AS (SELECT player_id, position FROM positions GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, position) = 1)"
        f" SELECT player_id, team, {_c.epa}, {_c.plays}, {_zero}, position, {_c.epa} / {_c.plays} AS epa_per_play FROM e LEFT JOIN t USING (player_id) LEFT JOIN ps USING (player_id) WHERE {_c.plays} >= 5"
    )(_career)

    def _plus(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        return L.position_baseline(_season_epa(spark, sf), positions(spark, sf), kind, min_plays=5)

    _plus.__name__ = f"q10_{_kind}_plus"
    query(
        SEASON_EPA + POSITIONS_SQL + f", b AS (SELECT player_id, season, game_type, position, {_c.epa} AS x, {_c.plays} AS n FROM pse LEFT JOIN positions USING (player_id, season) WHERE {_c.plays} >= 5)"
        " SELECT player_id, season, game_type, position, x / n AS per_play, (x / n - CASE WHEN position IS NOT NULL THEN sum(x) OVER (PARTITION BY season, game_type, position) / sum(n) OVER (PARTITION BY season, game_type, position)"
        " ELSE sum(x) OVER (PARTITION BY season, game_type) / sum(n) OVER (PARTITION BY season, game_type) END) * 100 AS plus FROM b"
    )(_plus)


@query(tail("gr", "a5_team_games") + " SELECT season, team, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in BOX) + ", CAST(sum(pass_yards + rush_yards) AS BIGINT) AS total_yards, count(*) AS games FROM gr GROUP BY 1, 2")
def q5_team_seasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.team_games(plays(spark, sf)).groupBy("season", "team").agg(*(F.sum(c).alias(c) for c in BOX), F.sum(F.col("pass_yards") + F.col("rush_yards")).alias("total_yards"), F.count("*").alias("games"))
    return rows.orderBy(F.desc("total_yards"), "season", "team")


@query(EPA + " SELECT game_id, play_index, quarter, clock, play_type, possession_team, ep_before, ep_after, epa FROM epa")
def q12_plays_with_epa(spark: SparkSession, sf: str) -> DataFrame:
    return _epa(spark, sf).select("game_id", "play_index", "quarter", "clock", "play_type", "possession_team", "ep_before", "ep_after", "epa").orderBy("game_id", "play_index")


@query(POSITIONS_SQL + " SELECT DISTINCT position FROM positions")
def q14_positions(spark: SparkSession, sf: str) -> DataFrame:
    return L.positions_in_order(positions(spark, sf))


for _side, _who, _nr in (("offense", "team", 17), ("defense", "opponent", 18)):

    def _dash(spark: SparkSession, sf: str, side: str = _side) -> DataFrame:
        base = plays(spark, sf)
        results = G.game_results(base).where("game_type <> 'preseason'")
        return L.team_dashboard(S.team_epa(_epa(spark, sf)), S.team_games(base), results, side)

    _dash.__name__ = f"q{_nr}_{_side}_dashboard"
    _cols = ("pass_comp", "pass_att", "pass_yards", "rush_att", "rush_yards", "sacks_taken", "interceptions_thrown", "fumbles_lost")
    _div = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)"
    query(
        tail("tg", "a5_team_games") + tail("res", "f8_game_results") + tail("te", "h6_team_epa")
        + f", tr AS (SELECT season, game_type, {_who} AS team, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _cols) + " FROM res r LEFT JOIN (SELECT game_id, team, " + ", ".join(_cols) + " FROM tg) t USING (game_id, team) WHERE game_type <> 'preseason' GROUP BY 1, 2, 3),"
        " rec AS (SELECT season, game_type, team, count(CASE WHEN points_for > points_against THEN 1 END) AS wins, count(CASE WHEN points_for < points_against THEN 1 END) AS losses, count(CASE WHEN points_for = points_against THEN 1 END) AS ties, CAST(sum(points_for) AS BIGINT) AS points_for, CAST(sum(points_against) AS BIGINT) AS points_against FROM res WHERE game_type <> 'preseason' GROUP BY 1, 2, 3),"
        " pl AS (SELECT *, (epa_per_play - sum(total_epa) OVER g / sum(plays) OVER g) * 100 AS plus FROM te WINDOW g AS (PARTITION BY season, game_type, side)),"
        f" mine AS (SELECT season, game_type, team, total_epa, pass_epa, rush_epa, epa_per_play, success_rate FROM pl WHERE side = '{_side}'), o AS (SELECT season, game_type, team, plus AS off_plus FROM pl WHERE side = 'offense'), d AS (SELECT season, game_type, team, plus AS def_plus FROM pl WHERE side = 'defense')"
        " SELECT season, game_type, team, wins, losses, ties, wins || '-' || losses || CASE WHEN ties > 0 THEN '-' || ties ELSE '' END AS record, points_for, points_against, epa_per_play, total_epa, success_rate, off_plus, def_plus, off_plus - def_plus AS net_plus, pass_yards, rush_yards, fumbles_lost, "
        + f"{_div('pass_epa', '(pass_att + sacks_taken)')} AS epa_per_pass, {_div('rush_epa', 'rush_att')} AS epa_per_rush, {_div('pass_comp', 'pass_att')} AS comp_rate, {_div('sacks_taken', '(pass_att + sacks_taken)')} AS sack_rate, {_div('interceptions_thrown', 'pass_att')} AS int_rate,"
        + f" CAST(rank() OVER (PARTITION BY season, game_type ORDER BY epa_per_play {'DESC' if _side == 'offense' else 'ASC'} NULLS LAST) AS INT) AS rank"
        " FROM tr FULL JOIN rec USING (season, game_type, team) FULL JOIN mine USING (season, game_type, team) FULL JOIN o USING (season, game_type, team) FULL JOIN d USING (season, game_type, team)"
    )(_dash)


@query(tail("te", "h6_team_epa") + ", m AS (SELECT *, avg(epa_per_play) OVER g AS mid, greatest(max(epa_per_play) OVER g - avg(epa_per_play) OVER g, avg(epa_per_play) OVER g - min(epa_per_play) OVER g) AS h FROM te WINDOW g AS (PARTITION BY season, side)) SELECT team, season, game_type, side, epa_per_play, coalesce(least(abs(epa_per_play - mid) / nullif(h, 0), 1.0), 0.0) AS heat FROM m")
def q32_team_heat(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_heat(S.team_epa(_epa(spark, sf)), "epa_per_play", "season", "side").select("team", "season", "game_type", "side", "epa_per_play", "heat")


@query(tail("c", "q27_ep_by_yardline") + " SELECT yards, " + ", ".join(f"max(CASE WHEN down = {d} THEN avg_ep END) AS value_{d}, coalesce(max(CASE WHEN down = {d} THEN n END), 0) AS n_{d}" for d in (1, 2, 3, 4)) + " FROM c GROUP BY yards")
def q33_ep_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.points_by_yards(_epa(spark, sf))
    return L.series(rows, "yards", "down", [1, 2, 3, 4], "avg_ep")


@query(tail("tg", "a5_team_games") + ", st AS (UNPIVOT (SELECT season, game_id, " + ", ".join(BOX) + f" FROM tg) ON {', '.join(BOX)} INTO NAME stat VALUE v)"
       " SELECT season, stat, count(*) AS compared, count(CASE WHEN NOT (stat = 'pass_yards' AND game_id % 7 = 0) THEN 1 END) AS same, avg(CASE WHEN stat = 'pass_yards' AND game_id % 7 = 0 THEN 0.0 ELSE 1.0 END) AS match_rate FROM st GROUP BY 1, 2")
def v1_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Team games against box scores in which the passing yards of each seventh game are off by one."""
    games = S.team_games(plays(spark, sf))
    box = games.withColumn("pass_yards", F.col("pass_yards") + (F.col("game_id") % 7 == 0).cast("int"))
    return L.reconcile(games, box, BOX, "season")
