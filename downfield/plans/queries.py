"""One query for each group of operators; the SQL states the same in windows and joins of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.functions.context import half, half_seconds, loaded_half_seconds, scrimmage, yardline_100
from downfield.functions.names import last_first, normalized
from downfield.functions.parse import parse_plays
from downfield.operators import curves as C
from downfield.operators import drives as D
from downfield.operators import stats as S
from downfield.sources.projection import plays, sql
from downfield.sources.tables import repeated_plays

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The same without the games in front, to build upon.
TAILS: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
            TAILS[f.__name__] = oracle
        return f

    return add


#: Context, drives and EPA in SQL; each follows ``plays``.
CONTEXT = """, ctx AS (
  SELECT *, CASE WHEN quarter <= 2 THEN 1 WHEN quarter <= 4 THEN 2 ELSE 3 END AS half,
         CASE WHEN possession_team = yard_line_team THEN yard_line WHEN possession_team <> yard_line_team THEN 100 - yard_line END AS yl100,
         CASE WHEN touchdown THEN (CASE WHEN interception OR fumble_lost THEN -1 ELSE 1 END) * (6 + CASE WHEN pat_good THEN 1 ELSE 0 END)
              WHEN play_type = 'field_goal' AND fg_good THEN 3 WHEN safety THEN -2 END AS pts
  FROM plays)"""
DRIVES = (
    CONTEXT
    + """, d1 AS (
  SELECT *, CASE WHEN lag(half) OVER w IS NULL OR lag(half) OVER w <> half OR play_type = 'kickoff' OR lag(pts) OVER w IS NOT NULL THEN 1 ELSE 0 END AS fresh
  FROM ctx WINDOW w AS (PARTITION BY game_id ORDER BY play_index)),
d2 AS (SELECT *, sum(fresh) OVER (PARTITION BY game_id ORDER BY play_index) AS seg FROM d1),
d3 AS (SELECT *, last_value(possession_team_id IGNORE NULLS) OVER (PARTITION BY game_id, seg ORDER BY play_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM d2),
d4 AS (SELECT *, CAST(sum(CASE WHEN fresh = 1 OR (possession_team_id IS NOT NULL AND (held IS NULL OR held <> possession_team_id)) THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY play_index) AS BIGINT) AS drive FROM d3),
drv AS (SELECT *, CAST(coalesce(sum(pts) OVER (PARTITION BY game_id, drive), 0) AS BIGINT) AS drive_points FROM d4)"""
)
EPA = (
    CONTEXT
    + """, e1 AS (
  SELECT *, CASE WHEN play_type IN ('pass','rush','sack','field_goal') AND down IS NOT NULL AND distance IS NOT NULL AND yl100 IS NOT NULL THEN yl100 / 50.0::DOUBLE END AS ep_before,
         lag(half) OVER w IS NULL OR lag(half) OVER w <> half OR play_type = 'kickoff' AS edge
  FROM ctx WINDOW w AS (PARTITION BY game_id ORDER BY play_index)),
e2 AS (SELECT *, edge OR ep_before IS NOT NULL OR pts IS NOT NULL AS stop FROM e1),
e3 AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY game_id ORDER BY play_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM e2),
e4 AS (SELECT *, min(possession_team_id) OVER b AS bmin, max(possession_team_id) OVER b AS bmax, CASE WHEN edge THEN 0 ELSE coalesce(ep_before, pts::DOUBLE) END AS val FROM e3 WINDOW b AS (PARTITION BY game_id, blk)),
nx AS (SELECT game_id, play_index, lead(play_index) OVER s AS at, lead(val) OVER s AS nval, lead(bmin) OVER s AS nmin, lead(bmax) OVER s AS nmax FROM e4 WHERE stop WINDOW s AS (PARTITION BY game_id ORDER BY play_index)),
e5 AS (SELECT e4.*, CASE WHEN ep_before IS NOT NULL THEN CASE WHEN pts IS NOT NULL THEN pts::DOUBLE WHEN nx.at IS NULL OR nmin <> possession_team_id OR nmax <> possession_team_id THEN 0 ELSE nval END END AS ep_after
       FROM e4 LEFT JOIN nx USING (game_id, play_index)),
epa AS (SELECT *, ep_after - ep_before AS epa FROM e5)"""
)
TEAM = EPA + """, sides AS (
  SELECT *, 'offense' AS side, possession_team AS team FROM epa WHERE epa IS NOT NULL AND game_type <> 'preseason'
  UNION ALL SELECT *, 'defense', defense_team FROM epa WHERE epa IS NOT NULL AND game_type <> 'preseason'),
te AS (SELECT team, season, game_type, side, sum(epa) AS total_epa, sum(CASE WHEN play_type IN ('pass','sack') THEN epa ELSE 0 END) AS pass_epa, sum(CASE WHEN play_type = 'rush' THEN epa ELSE 0 END) AS rush_epa,
              count(*) AS plays, avg(epa) AS epa_per_play, avg(CASE WHEN epa > 0 THEN 1.0 ELSE 0.0 END) AS success_rate FROM sides GROUP BY ALL)"""


def tail(name: str, of: str) -> str:
    """The result of query ``of`` as a common table expression."""
    return f", {name} AS (WITH nothing AS (SELECT 1){TAILS[of]})"


def _context(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_context(plays(spark, sf))


def _epa(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_epa(_context(spark, sf))


@query(" SELECT * FROM plays")
def s2_plays(spark: SparkSession, sf: str) -> DataFrame:
    """The plays as stored and read again."""
    return plays(spark, sf)


@query(""" SELECT game_id, play_index, CASE WHEN play_index % 7 = 0 THEN NULL WHEN quarter >= 5 THEN 0 ELSE CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT) + CASE WHEN quarter IN (1, 3) THEN 900 ELSE 0 END END AS half_seconds FROM plays""")
def f1_loaded_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds as tables store them; each seventh clock can't be read."""
    clock = F.when(F.col("play_index") % 7 == 0, F.lit("x:y")).otherwise(F.col("clock"))
    return plays(spark, sf).select("game_id", "play_index", loaded_half_seconds(F.col("quarter"), clock).alias("half_seconds"))


@query(" SELECT game_id, play_index, CAST(2 AS BIGINT) AS n FROM plays WHERE game_id % 5 = 0 AND play_index % 50 = 3")
def d4_repeated_plays(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of rows that were loaded twice."""
    base = plays(spark, sf).select("game_id", "play_index")
    return repeated_plays(base.unionByName(base.where("game_id % 5 = 0 AND play_index % 50 = 3")))


@query("""SELECT game_id, play_index, play_type AS parsed_type, CASE WHEN passer_id IS NOT NULL THEN 'P' || CAST(passer_id AS VARCHAR) || ', A.' END AS passer, CASE WHEN rusher_id IS NOT NULL THEN 'P' || CAST(rusher_id AS VARCHAR) || ', B.' END AS rusher,
  CASE WHEN receiver_id IS NOT NULL THEN 'P' || CAST(receiver_id AS VARCHAR) || CASE WHEN interception THEN ', C' ELSE ', C.' END END AS receiver, CASE WHEN tackler_id IS NOT NULL THEN 'P' || CAST(tackler_id AS VARCHAR) || ', D.' END AS tackler, CASE WHEN sacker_id IS NOT NULL THEN 'P' || CAST(sacker_id AS VARCHAR) || ', D.' END AS sacker,
  CASE WHEN interceptor_id IS NOT NULL THEN 'P' || CAST(interceptor_id AS VARCHAR) || ', I.' END AS interceptor, CASE WHEN play_type IN ('pass', 'rush', 'sack') THEN CAST(yards_gained AS INT) END AS yards, fumble, fumble_lost, CASE WHEN fumble_recoverer_id IS NOT NULL THEN 'P' || fumble_recoverer_id || CASE WHEN fumble_lost THEN ', F.' ELSE ', B.' END END AS fumble_recoverer, CASE WHEN fumbler_id IS NOT NULL THEN 'P' || fumbler_id || ', B.' END AS fumbler, touchdown, interception, safety, fg_good FROM plays""")
def p5_parse_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_plays(plays(spark, sf).select("game_id", "play_index", "description"))
    yards = F.when(F.col("parsed_type").isin("pass", "rush", "sack"), F.col("parsed_yards_gained"))
    return p.select("game_id", "play_index", "parsed_type", *(F.col(f"parsed_{c}").alias(c) for c in ("passer", "rusher", "receiver", "tackler", "sacker", "interceptor")), yards.alias("yards"), *(F.col(f"parsed_{c}").alias(c) for c in ("fumble", "fumble_lost", "fumble_recoverer", "fumbler", "touchdown", "interception", "safety", "fg_good")))


@query(" SELECT season, count(*) AS plays, CAST(0 AS BIGINT) AS unparsed FROM plays GROUP BY season")
def p10_parse_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_plays(plays(spark, sf).select("season", "description"))
    return p.groupBy("season").agg(F.count("*").alias("plays"), F.count_if(F.col("parsed_type") == "unknown").alias("unparsed"))


@query(""" SELECT DISTINCT passer_id, 'p' || CAST(passer_id AS VARCHAR) || ', a' AS key, 'rest jr, p' AS other FROM plays WHERE passer_id IS NOT NULL""")
def n4_name_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" P"), F.col("passer_id").cast("string"), F.lit(" (R) ,  A™."))
    other = F.concat(F.lit("P"), F.col("passer_id").cast("string"), F.lit(" Rest Jr."))
    return plays(spark, sf).where("passer_id is not null").select("passer_id", normalized(raw).alias("key"), last_first(other).alias("other")).distinct()


@query(""" SELECT game_id, play_index, CASE WHEN quarter <= 2 THEN 1 WHEN quarter <= 4 THEN 2 ELSE 3 END AS half,
  CASE WHEN quarter >= 5 THEN 0 ELSE CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT) + CASE WHEN quarter IN (1, 3) THEN 900 ELSE 0 END END AS half_seconds,
  CASE WHEN possession_team = yard_line_team THEN yard_line WHEN possession_team <> yard_line_team THEN 100 - yard_line END AS yl100,
  play_type IN ('pass','rush','sack','field_goal') AND down IS NOT NULL AND distance IS NOT NULL AND yard_line IS NOT NULL AS valid FROM plays""")
def f1_play_context(spark: SparkSession, sf: str) -> DataFrame:
    yl = yardline_100(F.col("possession_team"), F.col("yard_line_team"), F.col("yard_line"))
    return plays(spark, sf).select("game_id", "play_index", half(F.col("quarter")).alias("half"), half_seconds(F.col("quarter"), F.col("clock")).alias("half_seconds"), yl.alias("yl100"), scrimmage().alias("valid"))


@query("""SELECT id, min(team) AS team FROM (
  SELECT id, team, count(*) AS n, max(games) AS games FROM (SELECT DISTINCT possession_team_id AS id, game_id, team FROM (SELECT possession_team_id, game_id, home_team AS team FROM plays UNION ALL SELECT possession_team_id, game_id, away_team FROM plays) WHERE possession_team_id IS NOT NULL)
  JOIN (SELECT possession_team_id AS id, count(DISTINCT game_id) AS games FROM plays GROUP BY 1) USING (id) GROUP BY id, team HAVING count(*) = max(games)) GROUP BY id HAVING count(*) = 1""".replace("SELECT id, min", " SELECT id, min", 1))
def f9_team_ids(spark: SparkSession, sf: str) -> DataFrame:
    return D.resolve_team_ids(plays(spark, sf))


@query(DRIVES + " SELECT game_id, play_index, drive, drive_points FROM drv")
def d1_drives(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_drives(_context(spark, sf)).select("game_id", "play_index", "drive", "drive_points")


@query(CONTEXT + """, ev AS (SELECT *, CASE WHEN touchdown THEN 'td' WHEN pts = 3 THEN 'fg' WHEN pts = -2 THEN 'safety' END AS kind,
  CASE WHEN NOT touchdown AND pts = -2 THEN defense_team ELSE possession_team END AS scorer FROM ctx),
nx AS (SELECT *, first_value(CASE WHEN kind IS NOT NULL THEN {'k': kind, 't': scorer} END IGNORE NULLS) OVER (PARTITION BY game_id, half ORDER BY play_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM ev)
SELECT game_id, play_index, CASE WHEN n IS NULL THEN 'no_score' WHEN n.t = possession_team THEN n.k || '_pos' ELSE n.k || '_neg' END AS next_score FROM nx""")
def d3_next_score(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_next_score(_context(spark, sf)).select("game_id", "play_index", "next_score")


@query(DRIVES + """ SELECT game_id, drive, min(play_index) AS first_play, CAST(sum(CASE WHEN play_type IN ('pass','rush','sack') THEN 1 ELSE 0 END) AS BIGINT) AS n_plays,
  CAST(sum(CASE WHEN play_type IN ('pass','rush','sack') THEN yards_gained ELSE 0 END) AS BIGINT) AS yards, max(drive_points) AS points, arg_max(play_type, play_index) AS last_type FROM drv GROUP BY game_id, drive""")
def d8_drive_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.drive_summary(D.with_drives(_context(spark, sf)))


@query(EPA + " SELECT game_id, play_index, ep_before, ep_after, epa FROM epa WHERE epa IS NOT NULL")
def c3_play_epa(spark: SparkSession, sf: str) -> DataFrame:
    return _epa(spark, sf).where("epa is not null").select("game_id", "play_index", "ep_before", "ep_after", "epa")


@query(EPA + """, n AS (SELECT game_id, play_index, lead(ep_before) OVER s AS ne, lead(half) OVER s AS nh, lead(possession_team_id) OVER s AS np FROM epa WHERE ep_before IS NOT NULL WINDOW s AS (PARTITION BY game_id ORDER BY play_index))
SELECT game_id, play_index, CASE WHEN pts IS NOT NULL THEN pts::DOUBLE WHEN nh IS NULL OR nh <> half THEN 0 WHEN np <> possession_team_id THEN -ne ELSE ne END - ep_before AS hs_epa FROM epa JOIN n USING (game_id, play_index)""")
def c4_half_score_epa(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_half_score_epa(_epa(spark, sf)).where("hs_epa is not null").select("game_id", "play_index", "hs_epa")


@query(EPA + " SELECT season, count(*) AS plays, count(ep_before) AS valid, count(epa) AS with_epa, avg(epa) AS mean_epa FROM epa GROUP BY season")
def c5_epa_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _epa(spark, sf).groupBy("season").agg(F.count("*").alias("plays"), F.count("ep_before").alias("valid"), F.count("epa").alias("with_epa"), F.avg("epa").alias("mean_epa"))


@query(""" SELECT game_id, passer_id, CAST(sum(CASE WHEN play_type = 'pass' AND complete THEN 1 ELSE 0 END) AS BIGINT) AS comp, CAST(sum(CASE WHEN play_type = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS att,
  CAST(sum(CASE WHEN complete THEN yards_gained ELSE 0 END) AS BIGINT) AS yards, CAST(sum(CASE WHEN complete AND touchdown THEN 1 ELSE 0 END) AS BIGINT) AS td, CAST(sum(CASE WHEN interception THEN 1 ELSE 0 END) AS BIGINT) AS interceptions,
  CAST(sum(CASE WHEN play_type = 'sack' THEN 1 ELSE 0 END) AS BIGINT) AS sacks, CAST(sum(CASE WHEN play_type = 'sack' THEN yards_gained ELSE 0 END) AS BIGINT) AS sack_yards, arg_min(possession_team, play_index) AS team FROM plays WHERE passer_id IS NOT NULL GROUP BY 1, 2""")
def a1_player_passing(spark: SparkSession, sf: str) -> DataFrame:
    return S.player_passing(plays(spark, sf))


@query(""" SELECT game_id, rusher_id, count(*) AS att, CAST(sum(yards_gained) AS BIGINT) AS yards, CAST(sum(CASE WHEN touchdown THEN 1 ELSE 0 END) AS BIGINT) AS td, CAST(sum(CASE WHEN fumble_lost THEN 1 ELSE 0 END) AS BIGINT) AS fumbles,
  arg_min(possession_team, play_index) AS team FROM plays WHERE rusher_id IS NOT NULL GROUP BY 1, 2""")
def a2_player_rushing(spark: SparkSession, sf: str) -> DataFrame:
    return S.player_rushing(plays(spark, sf))


@query(""" SELECT game_id, receiver_id, count(*) AS rec, CAST(sum(yards_gained) AS BIGINT) AS yards, CAST(sum(CASE WHEN touchdown THEN 1 ELSE 0 END) AS BIGINT) AS td, arg_min(possession_team, play_index) AS team FROM plays WHERE complete GROUP BY 1, 2""")
def a3_player_receiving(spark: SparkSession, sf: str) -> DataFrame:
    return S.player_receiving(plays(spark, sf))


@query(""", r AS (SELECT game_id, play_index, defense_team, tackler_id AS player_id, 1 AS k FROM plays UNION ALL SELECT game_id, play_index, defense_team, sacker_id, 2 FROM plays UNION ALL SELECT game_id, play_index, defense_team, interceptor_id, 3 FROM plays
  UNION ALL SELECT game_id, play_index, defense_team, fumble_recoverer_id, 4 FROM plays UNION ALL SELECT game_id, play_index, defense_team, coalesce(tackler_id, sacker_id), 5 FROM plays WHERE fumble)
SELECT game_id, player_id, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tackles, CAST(sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS BIGINT) AS sacks, CAST(sum(CASE WHEN k = 3 THEN 1 ELSE 0 END) AS BIGINT) AS interceptions, count(CASE WHEN k = 4 THEN 1 END) AS fumble_recoveries, count(CASE WHEN k = 5 THEN 1 END) AS forced_fumbles, arg_min(defense_team, play_index) AS team
FROM r WHERE player_id IS NOT NULL GROUP BY 1, 2""")
def a4_player_defense(spark: SparkSession, sf: str) -> DataFrame:
    return S.player_defense(plays(spark, sf))


@query(""", o AS (SELECT game_id, season, possession_team AS team, sum(CASE WHEN play_type IN ('pass','spike') THEN 1 ELSE 0 END) AS pass_att, sum(CASE WHEN complete THEN 1 ELSE 0 END) AS pass_comp, sum(CASE WHEN complete THEN yards_gained ELSE 0 END) AS pass_yards,
  sum(CASE WHEN play_type = 'rush' OR (play_type = 'kneel' AND season >= 28) THEN 1 ELSE 0 END) AS rush_att, sum(CASE WHEN play_type = 'rush' THEN yards_gained WHEN play_type = 'kneel' AND season >= 28 THEN -2 ELSE 0 END) AS rush_yards,
  sum(CASE WHEN interception THEN 1 ELSE 0 END) AS interceptions_thrown, sum(CASE WHEN fumble_lost THEN 1 ELSE 0 END) AS fumbles_lost, sum(CASE WHEN play_type = 'sack' THEN 1 ELSE 0 END) AS sacks_taken, sum(CASE WHEN first_down THEN 1 ELSE 0 END) AS first_downs,
  sum(CASE WHEN down = 3 AND play_type IN ('pass','rush','sack') THEN 1 ELSE 0 END) AS third_down_att, sum(CASE WHEN down = 3 AND play_type IN ('pass','rush','sack') AND (first_down OR touchdown) THEN 1 ELSE 0 END) AS third_down_conv,
  count(CASE WHEN complete AND touchdown THEN 1 END) AS pass_td, count(CASE WHEN play_type = 'rush' AND touchdown THEN 1 END) AS rush_td, count(CASE WHEN fumble AND NOT fumble_lost THEN 1 END) AS own_recoveries FROM plays WHERE possession_team IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT game_id, season, defense_team AS team, sum(CASE WHEN play_type = 'sack' THEN 1 ELSE 0 END) AS sacks_made, count(CASE WHEN fumble_lost THEN 1 END) AS won, count(CASE WHEN fumble AND coalesce(tackler_id, sacker_id) IS NOT NULL THEN 1 END) AS forced_fumbles FROM plays WHERE possession_team IS NOT NULL GROUP BY 1, 2, 3)
SELECT game_id, season, team, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in "pass_att pass_comp pass_yards rush_att rush_yards interceptions_thrown fumbles_lost sacks_taken sacks_made first_downs third_down_att third_down_conv pass_td rush_td forced_fumbles".split()) + ", coalesce(won, 0) + coalesce(own_recoveries, 0) AS fumble_recoveries FROM o FULL JOIN d USING (game_id, season, team)")
def a5_team_games(spark: SparkSession, sf: str) -> DataFrame:
    return S.team_games(plays(spark, sf))


for _role, _id, _types in (("passing", "passer", ("pass", "sack")), ("rushing", "rusher", ("rush",)), ("receiving", "receiver", ("pass",))):

    def _player(spark: SparkSession, sf: str, role: str = _id, types: tuple[str, ...] = _types) -> DataFrame:
        return S.player_epa(_epa(spark, sf), role, types)

    _player.__name__ = f"h_{_role}_epa"
    query(EPA + f" SELECT {_id}_id AS player_id, season, game_type, sum(epa) AS epa, count(*) AS plays, avg(epa) AS epa_per_play FROM epa WHERE epa IS NOT NULL AND {_id}_id IS NOT NULL AND play_type IN ({', '.join(repr(t) for t in _types)}) AND game_type <> 'preseason' GROUP BY 1, 2, 3")(_player)


@query(TEAM + " SELECT * FROM te")
def h6_team_epa(spark: SparkSession, sf: str) -> DataFrame:
    return S.team_epa(_epa(spark, sf))


@query(TEAM + " SELECT team, season, game_type, total_epa, plays, epa_per_play, success_rate FROM te WHERE side = 'offense' ORDER BY epa_per_play DESC")
def q11_team_epa_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = S.team_epa(_epa(spark, sf)).where("side = 'offense'").select("team", "season", "game_type", "total_epa", "plays", "epa_per_play", "success_rate")
    return ranked.orderBy(F.desc_nulls_last("epa_per_play"), "team", "season", "game_type")


@query(TEAM + ", lg AS (SELECT side, season, game_type, sum(epa_per_play * plays) / sum(plays) AS league FROM te GROUP BY ALL) SELECT team, season, game_type, side, epa_per_play, league, (epa_per_play - league) * 100 AS plus FROM te JOIN lg USING (side, season, game_type)")
def q16_epa_plus(spark: SparkSession, sf: str) -> DataFrame:
    return S.average_plus(S.team_epa(_epa(spark, sf)), "epa_per_play", "plays", ("side", "season", "game_type")).select("team", "season", "game_type", "side", "epa_per_play", "league", "plus")


@query(EPA + " SELECT distance, down, avg(ep_before) AS avg_ep, count(*) AS n FROM epa WHERE ep_before IS NOT NULL AND distance <= 30 GROUP BY 1, 2 HAVING count(*) >= 100")
def q25_ep_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    return C.points_by_distance(_epa(spark, sf))


@query(EPA + """ SELECT down, CASE WHEN distance <= 3 THEN 'Short' WHEN distance <= 7 THEN 'Medium' WHEN distance <= 12 THEN 'Long' ELSE 'Very Long' END AS bucket, CASE WHEN play_type = 'sack' THEN 'pass' ELSE play_type END AS kind,
  avg(CASE WHEN epa > 0 THEN 1.0 ELSE 0.0 END) AS success_rate, count(*) AS n FROM epa WHERE epa IS NOT NULL AND play_type IN ('pass','rush','sack') GROUP BY 1, 2, 3 HAVING count(*) >= 50""")
def q26_success_by_down(spark: SparkSession, sf: str) -> DataFrame:
    return C.success_by_down(_epa(spark, sf))


@query(EPA + " SELECT CAST(floor(yl100 / 5) * 5 AS BIGINT) AS yards, down, avg(ep_before) AS avg_ep, count(*) AS n FROM epa WHERE ep_before IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100")
def q27_ep_by_yardline(spark: SparkSession, sf: str) -> DataFrame:
    return C.points_by_yards(_epa(spark, sf))


@query(""" SELECT season, count(DISTINCT game_id) AS games, count(*) AS plays, CAST(sum(CASE WHEN play_type = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passes, CAST(sum(CASE WHEN play_type = 'rush' THEN 1 ELSE 0 END) AS BIGINT) AS rushes,
  CAST(sum(CASE WHEN touchdown THEN 1 ELSE 0 END) AS BIGINT) AS td, CAST(sum(CASE WHEN interception THEN 1 ELSE 0 END) AS BIGINT) AS interceptions FROM plays GROUP BY season""")
def q9_season_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    return plays(spark, sf).groupBy("season").agg(F.count_distinct("game_id").alias("games"), F.count("*").alias("plays"), n(F.col("play_type") == "pass").alias("passes"), n(F.col("play_type") == "rush").alias("rushes"), n(F.col("touchdown")).alias("td"), n(F.col("interception")).alias("interceptions"))


@query(""" SELECT season, passer_id, sum(CASE WHEN complete THEN yards_gained ELSE 0 END)::BIGINT AS yards, count(DISTINCT game_id) AS games FROM plays WHERE passer_id IS NOT NULL GROUP BY 1, 2 ORDER BY yards DESC, season, passer_id LIMIT 20""")
def q4_passing_leaders(spark: SparkSession, sf: str) -> DataFrame:
    games = S.player_passing(plays(spark, sf))
    seasons = plays(spark, sf).select("game_id", "season").distinct()
    return games.join(seasons, "game_id").groupBy("season", "passer_id").agg(F.sum("yards").alias("yards"), F.count("*").alias("games")).orderBy(F.desc("yards"), "season", "passer_id").limit(20)
