"""Queries on scores, sides, weeks and features of games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.operators import curves as C
from downfield.operators import drives as D
from downfield.operators import games as G
from downfield.plans.queries import CONTEXT, DRIVES, EPA, _context, _epa, query
from downfield.sources.projection import plays

SCORES = CONTEXT + """, s1 AS (
  SELECT *, max(possession_team_id) OVER (PARTITION BY game_id) AS hid, min(possession_team_id) OVER (PARTITION BY game_id) AS aid,
         CASE WHEN touchdown THEN 6 + CASE WHEN pat_good THEN 1 ELSE 0 END WHEN fg_good THEN 3 ELSE 0 END AS own, CASE WHEN safety THEN 2 ELSE 0 END AS saf FROM ctx),
sc AS (
  SELECT *, CASE WHEN hid <> aid THEN coalesce(CAST(sum(CASE WHEN possession_team_id = hid THEN own ELSE saf END) OVER w AS BIGINT), 0) END AS score_home,
         CASE WHEN hid <> aid THEN coalesce(CAST(sum(CASE WHEN possession_team_id = hid THEN saf ELSE own END) OVER w AS BIGINT), 0) END AS score_away
  FROM s1 WINDOW w AS (PARTITION BY game_id ORDER BY play_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SECONDS = "CASE WHEN quarter >= 5 THEN 0 ELSE CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT) + CASE WHEN quarter IN (1, 3) THEN 900 ELSE 0 END END"
RESULTS = SCORES + """, g1 AS (
  SELECT game_id, season, game_type, min(home_team) AS h, min(away_team) AS a,
         CAST(sum(CASE WHEN possession_team = home_team THEN own WHEN possession_team IS NOT NULL THEN saf ELSE 0 END) AS BIGINT) AS hp,
         CAST(sum(CASE WHEN possession_team = home_team THEN saf WHEN possession_team IS NOT NULL THEN own ELSE 0 END) AS BIGINT) AS ap FROM sc GROUP BY 1, 2, 3),
res AS (SELECT game_id, season, game_type, h AS team, a AS opponent, hp AS points_for, ap AS points_against, true AS at_home FROM g1
  UNION ALL SELECT game_id, season, game_type, a, h, ap, hp, false FROM g1)"""
FEATURES = SCORES + f""", ft AS (
  SELECT game_id, play_index, season, half, possession_team_id, play_type, down, least(distance, 30) AS distance, yl100, yard_line, score_home, score_away, CAST(possession_team = home_team AS INT) AS is_home,
         greatest(-28, least(28, CASE WHEN possession_team = home_team THEN score_home - score_away ELSE score_away - score_home END)) AS score_differential,
         {SECONDS} AS half_seconds_remaining, CAST(quarter >= 5 AS INT) AS is_overtime, CAST(season >= 27 AS INT) AS engine_era
  FROM sc WHERE play_type IN ('pass','rush','sack','field_goal') AND down IS NOT NULL AND distance IS NOT NULL AND yl100 IS NOT NULL)"""
MATRIX = ("down", "distance", "yl100", "score_differential", "half_seconds_remaining", "is_home", "is_overtime", "engine_era")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_scores(_context(spark, sf))


@query(SCORES + " SELECT game_id, play_index, score_home, score_away FROM sc")
def f7_scores_before_plays(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("game_id", "play_index", "score_home", "score_away")


@query(RESULTS + " SELECT * FROM res")
def f8_game_results(spark: SparkSession, sf: str) -> DataFrame:
    return G.game_results(plays(spark, sf))


@query(SCORES + " SELECT game_id, arg_max(score_home, play_index) AS home, arg_max(score_away, play_index) AS away FROM sc WHERE score_home IS NOT NULL GROUP BY game_id")
def f13_last_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scores(spark, sf).where("score_home is not null")
    return rows.groupBy("game_id").agg(F.max_by("score_home", "play_index").alias("home"), F.max_by("score_away", "play_index").alias("away"))


@query(RESULTS + " SELECT game_id, season, game_type, h AS home_team, hp AS home_points, a AS away_team, ap AS away_points FROM g1")
def q13_game_list(spark: SparkSession, sf: str) -> DataFrame:
    return G.game_list(G.game_results(plays(spark, sf)))


@query(" SELECT DISTINCT game_id, season, CAST(floor((game_id - min(game_id) OVER (PARTITION BY season)) / 7) + 1 AS BIGINT) AS week FROM plays WHERE game_type <> 'preseason'")
def f14_weeks(spark: SparkSession, sf: str) -> DataFrame:
    games = plays(spark, sf).where("game_type <> 'preseason'").select("game_id", "season").distinct()
    return G.with_week(games).select("game_id", "season", "week")


@query(FEATURES + f" SELECT game_id, play_index, {', '.join(MATRIX)} FROM ft")
def d5_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return G.drive_matrix(G.with_features(_scores(spark, sf))).select("game_id", "play_index", *MATRIX)


@query(FEATURES + """, r1 AS (SELECT *, lag(possession_team_id) OVER w IS DISTINCT FROM possession_team_id OR lag(half) OVER w IS DISTINCT FROM half AS starts_run FROM ft WINDOW w AS (PARTITION BY game_id ORDER BY play_index)),
r2 AS (SELECT *, sum(CAST(starts_run AS INT)) OVER (PARTITION BY game_id ORDER BY play_index) AS run FROM r1)
SELECT game_id, play_index, starts_run, 1.0::DOUBLE / count(*) OVER (PARTITION BY game_id, run) AS weight FROM r2""")
def d6_drive_weights(spark: SparkSession, sf: str) -> DataFrame:
    return G.drive_matrix(G.with_features(_scores(spark, sf))).select("game_id", "play_index", "starts_run", "weight")


STARTS = """, scr AS (SELECT *, lag(play_index) OVER w AS pi, lag(possession_team_id) OVER w AS pp, lag(half) OVER w AS ph FROM {src} WHERE play_type IN ('pass','rush','sack','field_goal') AND possession_team_id IS NOT NULL
  WINDOW w AS (PARTITION BY game_id ORDER BY play_index)),
st AS (SELECT * FROM scr WHERE pi IS NULL OR pp <> possession_team_id OR ph <> half OR EXISTS (SELECT 1 FROM plays k WHERE k.game_id = scr.game_id AND k.play_type = 'kickoff' AND k.play_index > pi AND k.play_index < scr.play_index))"""


@query(CONTEXT + STARTS.format(src="ctx") + " SELECT game_id, play_index FROM st")
def d7_drive_starts(spark: SparkSession, sf: str) -> DataFrame:
    return G.drive_starts(_context(spark, sf)).select("game_id", "play_index")


@query(EPA + STARTS.format(src="epa") + " SELECT CAST(floor(yl100 / 5) * 5 AS BIGINT) AS yards, avg(ep_before) AS avg_ep, count(*) AS n FROM st WHERE ep_before IS NOT NULL GROUP BY 1 HAVING count(*) >= 30")
def q29_ep_at_drive_starts(spark: SparkSession, sf: str) -> DataFrame:
    return C.points_at_starts(G.drive_starts(_epa(spark, sf)))


@query(DRIVES + """, r AS (SELECT *, CAST(greatest(least(yl100, 100), 0) AS DOUBLE) AS span_start FROM drv WHERE play_type IN ('pass','rush','sack') AND yl100 IS NOT NULL),
r2 AS (SELECT *, coalesce(lead(span_start) OVER (PARTITION BY game_id, drive ORDER BY play_index), greatest(least(yl100 + yards_gained, 100), 0)) AS e FROM r)
SELECT game_id, drive, play_index, span_start, CAST(CASE WHEN e = span_start THEN e + 0.5 ELSE e END AS DOUBLE) AS span_end, CASE WHEN yl100 <= 50 THEN 'Own ' || CAST(yl100 AS VARCHAR) ELSE 'Opp ' || CAST(100 - yl100 AS VARCHAR) END AS field_label FROM r2""")
def d9_play_spans(spark: SparkSession, sf: str) -> DataFrame:
    return G.play_spans(D.with_drives(_context(spark, sf))).select("game_id", "drive", "play_index", "span_start", "span_end", "field_label")


@query(""", v AS (SELECT *, lag(play_type) OVER (PARTITION BY game_id ORDER BY play_index) AS was FROM plays),
c AS (SELECT game_id, possession_team_id, yard_line_team AS team, count(*) AS n, min(play_index) AS f FROM v WHERE was = 'kickoff' AND play_type IN ('pass','rush','sack') AND yard_line <= 50 AND possession_team_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT game_id, possession_team_id, team FROM c WHERE game_id IN (SELECT game_id FROM plays GROUP BY 1 HAVING count(DISTINCT possession_team_id) >= 2 AND count(DISTINCT yard_line_team) >= 2)
  QUALIFY row_number() OVER (PARTITION BY game_id, possession_team_id ORDER BY n DESC, f) = 1""")
def f11_kickoff_votes(spark: SparkSession, sf: str) -> DataFrame:
    return G.kickoff_votes(plays(spark, sf))


@query(""", v AS (SELECT *, lag(play_type) OVER (PARTITION BY game_id ORDER BY play_index) AS was FROM plays),
q AS (SELECT game_id, play_index, possession_team_id AS id, yard_line_team AS side, yard_line = 25 AS sure, yard_line <= 45 AND play_type IN ('pass','rush','sack') AS near FROM v
  WHERE was = 'kickoff' AND play_type <> 'kickoff' AND possession_team_id IS NOT NULL AND yard_line_team IN (home_team, away_team)),
fs AS (SELECT game_id, id, min(play_index) AS f FROM q WHERE sure GROUP BY 1, 2),
fo AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY f) AS k, lead(f) OVER (PARTITION BY game_id ORDER BY f) AS nf FROM fs),
a AS (SELECT game_id, id, arg_max(side, play_index) AS side, min(f) AS o FROM q JOIN fo USING (game_id, id) WHERE sure AND (k = 1 AND (nf IS NULL OR play_index < nf) OR k = 2 AND play_index = f) GROUP BY 1, 2),
b AS (SELECT game_id, id, arg_min(side, play_index) AS side, min(play_index) + 1000000 AS o FROM q WHERE near AND NOT EXISTS (SELECT 1 FROM a WHERE a.game_id = q.game_id AND a.id = q.id) GROUP BY 1, 2),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
gm AS (SELECT game_id, min(home_team) AS h, min(possession_team_id) AS lo, max(possession_team_id) AS hi FROM plays GROUP BY 1 HAVING count(DISTINCT possession_team_id) = 2),
m AS (SELECT gm.game_id, lo, hi, count(id) AS n, arg_max(id, o) FILTER (side = h) AS hid, arg_max(id, o) FILTER (side <> h) AS aid FROM gm LEFT JOIN ab USING (game_id) GROUP BY 1, 2, 3)
SELECT game_id, CASE n WHEN 2 THEN hid WHEN 1 THEN coalesce(hid, lo + hi - aid) ELSE hi END AS home_id, CASE n WHEN 2 THEN aid WHEN 1 THEN coalesce(aid, lo + hi - hid) ELSE lo END AS away_id FROM m""")
def p9_kickoff_sides(spark: SparkSession, sf: str) -> DataFrame:
    return G.kickoff_sides(plays(spark, sf))


@query(" SELECT game_id, arg_min(home_team, play_index) AS home_team, arg_min(away_team, play_index) AS away_team FROM plays WHERE home_team IS NOT NULL AND away_team IS NOT NULL GROUP BY 1")
def p8_game_teams(spark: SparkSession, sf: str) -> DataFrame:
    return G.game_teams(plays(spark, sf))


@query(EPA + f" SELECT CAST(floor({SECONDS} / 60) AS BIGINT) AS minute, down, avg(ep_before) AS avg_ep, count(*) AS n FROM epa WHERE ep_before IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100")
def q28_ep_by_minute(spark: SparkSession, sf: str) -> DataFrame:
    return C.points_by_minute(_epa(spark, sf))


SHARES = "count(*) AS n, " + ", ".join(f"100 * avg(CASE WHEN play_type IN ({t}) THEN 1.0 ELSE 0.0 END) AS {n}_pct" for n, t in (("go", "'pass','rush','sack'"), ("punt", "'punt'"), ("fg", "'field_goal'")))
FOURTH = "down = 4 AND play_type IN ('pass','rush','sack','punt','field_goal')"
LEAD = "(CASE WHEN possession_team = home_team THEN score_home - score_away ELSE score_away - score_home END)"


@query(SCORES + f" SELECT CAST(floor({SECONDS} / 60) AS BIGINT) AS minute, {SHARES} FROM sc WHERE {FOURTH} GROUP BY 1 HAVING count(*) >= 20")
def q31_fourth_downs_by_minute(spark: SparkSession, sf: str) -> DataFrame:
    return G.fourth_downs(_context(spark, sf), by="minute")


for _score, _where in (("", ""), ("winning", f" AND {LEAD} > 0"), ("losing", f" AND {LEAD} < 0"), ("tied", f" AND {LEAD} = 0")):

    def _fourth(spark: SparkSession, sf: str, score: str = _score or "all") -> DataFrame:
        return G.fourth_downs(_scores(spark, sf), score=score)

    _fourth.__name__ = f"q30_fourth_downs_{_score}".rstrip("_")
    query(SCORES + f" SELECT CAST(floor(yl100 / 5) * 5 AS BIGINT) AS yards, {SHARES} FROM sc WHERE {FOURTH} AND yl100 BETWEEN 1 AND 99{_where} GROUP BY 1 HAVING count(*) >= 20")(_fourth)
