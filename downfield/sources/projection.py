"""Games made from the ``events`` table, so that the play operators run on tables that hold none.

PLAYS_SQL is common to Spark and other engines. Every 200 events are a game.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from downfield.sources.store import buckets_for, open_store, write_store
from downfield.sources.tables import shared_folder

#: Invented teams; their place here is their number, and the id that a possession has is one more.
TEAMS = "ASH BRK CAN DOV ELM FAR GLD HIL"
PLAYS_SQL = """
WITH k AS (
  SELECT event_id AS e, CAST(floor(event_id / 200) AS BIGINT) AS game_id, event_id % 200 AS play_index,
         (event_id * 7919 + 13) % 997 AS h1, (event_id * 104729 + 7) % 991 AS h2, (event_id * 1299709 + 3) % 983 AS h3
  FROM {events}),
g AS (
  SELECT k.*, 25 + game_id % 5 AS season,
         CASE WHEN game_id % 20 = 7 THEN 'preseason' WHEN game_id % 20 = 19 THEN 'playoff' ELSE 'regular' END AS game_type,
         game_id % 8 AS hm, (game_id % 8 + 1 + CAST(floor(game_id / 8) AS BIGINT) % 7) % 8 AS aw,
         CASE WHEN game_id % 10 = 3 AND play_index >= 190 THEN 5 ELSE 1 + CAST(floor(play_index / 50) AS BIGINT) END AS quarter,
         899 - (play_index % 50) * 18 AS clk,
         CASE WHEN play_index % 50 = 0 THEN 'quarter_marker' WHEN play_index % 50 = 1 THEN 'kickoff'
              WHEN h1 % 100 < 42 THEN 'pass' WHEN h1 % 100 < 72 THEN 'rush' WHEN h1 % 100 < 76 THEN 'sack'
              WHEN h1 % 100 < 80 THEN 'field_goal' WHEN h1 % 100 < 86 THEN 'punt' WHEN h1 % 100 < 91 THEN 'kickoff'
              WHEN h1 % 100 < 95 THEN 'penalty' WHEN h1 % 100 < 96 THEN 'timeout' WHEN h1 % 100 < 98 THEN 'spike' ELSE 'kneel' END AS play_type,
         (CAST(floor((play_index + game_id % 5) / 6) AS BIGINT) + game_id) % 2 AS side
  FROM k),
p AS (
  SELECT game_id, play_index, season, game_type, quarter, play_type, h1, h2, h3,
         split_part('{teams}', ' ', CAST(hm + 1 AS INT)) AS home_team, split_part('{teams}', ' ', CAST(aw + 1 AS INT)) AS away_team,
         CASE WHEN play_type = 'quarter_marker' THEN NULL WHEN side = 0 THEN hm + 1 ELSE aw + 1 END AS possession_team_id,
         CASE WHEN side = 0 THEN aw + 1 ELSE hm + 1 END AS other_id,
         CAST(CAST(floor(clk / 60) AS BIGINT) AS STRING) || ':' || lpad(CAST(clk % 60 AS STRING), 2, '0') AS clock,
         CASE WHEN play_type IN ('pass','rush','sack','field_goal','punt','penalty') THEN 1 + h2 % 4 END AS down,
         CASE WHEN play_type IN ('pass','rush','sack','field_goal','punt','penalty') AND h3 % 41 <> 0 THEN 1 + h3 % 15 END AS distance,
         CASE WHEN play_type NOT IN ('quarter_marker','timeout') THEN 1 + h2 % 50 END AS yard_line,
         CASE WHEN play_type NOT IN ('quarter_marker','timeout') THEN split_part('{teams}', ' ', CAST(CASE WHEN h3 % 2 = 0 THEN hm ELSE aw END + 1 AS INT)) END AS yard_line_team,
         play_type = 'pass' AND h2 % 9 < 6 AND h2 % 37 <> 0 AS complete,
         CASE WHEN play_type = 'pass' AND h2 % 9 < 6 AND h2 % 37 <> 0 OR play_type = 'rush' THEN h3 % 23 - 3 WHEN play_type = 'sack' THEN -(h3 % 11) ELSE 0 END AS yards_gained,
         (play_type = 'pass' AND h2 % 9 < 6 AND h2 % 37 <> 0 OR play_type = 'rush') AND h3 % 29 = 0 OR play_type IN ('pass', 'rush') AND (h2 % 37 = 0 AND play_type = 'pass' OR h2 % 41 = 0 AND play_type = 'rush') AND h3 % 5 = 0 AS touchdown,
         play_type = 'pass' AND h2 % 37 = 0 AS interception,
         play_type = 'rush' AND h2 % 41 = 0 AND h3 % 29 <> 0 AS fumble_lost,
         play_type = 'rush' AND h2 % 43 = 0 AND h2 % 41 <> 0 AND h3 % 29 <> 0 AS fumble_kept,
         play_type = 'sack' AND h2 % 29 = 0 AS safety,
         CASE WHEN play_type = 'field_goal' THEN h2 % 5 <> 0 END AS fg_good
  FROM g)
SELECT game_id, play_index, season, game_type, quarter, play_type, home_team, away_team, possession_team_id,
       CASE WHEN possession_team_id IS NOT NULL THEN split_part('{teams}', ' ', CAST(possession_team_id AS INT)) END AS possession_team,
       CASE WHEN possession_team_id IS NOT NULL THEN split_part('{teams}', ' ', CAST(other_id AS INT)) END AS defense_team,
       clock, down, distance, yard_line, yard_line_team, yards_gained, complete, touchdown, interception, fumble_lost OR fumble_kept AS fumble, fumble_lost, safety, fg_good,
       CASE WHEN touchdown THEN h2 % 8 <> 0 END AS pat_good,
       play_type IN ('pass','rush') AND yards_gained >= coalesce(distance, 10) AS first_down,
       CASE WHEN play_type IN ('pass','sack') THEN possession_team_id * 40 + h1 % 2 END AS passer_id,
       CASE WHEN play_type = 'rush' THEN possession_team_id * 40 + 10 + h1 % 4 END AS rusher_id,
       CASE WHEN play_type = 'pass' THEN possession_team_id * 40 + 20 + h2 % 6 END AS receiver_id,
       CASE WHEN complete OR play_type = 'rush' THEN other_id * 40 + 30 + h3 % 6 END AS tackler_id,
       CASE WHEN play_type = 'sack' THEN other_id * 40 + 30 + h3 % 6 END AS sacker_id,
       CASE WHEN interception THEN other_id * 40 + 36 + h3 % 3 END AS interceptor_id,
       CASE WHEN fumble_kept THEN possession_team_id * 40 + 10 + h1 % 4 END AS fumbler_id,
       CASE WHEN fumble_lost THEN other_id * 40 + 33 + h3 % 3 WHEN fumble_kept THEN possession_team_id * 40 + 10 + (h1 + 1) % 4 END AS fumble_recoverer_id,
       CASE WHEN play_type IN ('field_goal','punt') OR play_type = 'kickoff' AND h3 % 3 = 0 THEN possession_team_id * 40 + CASE WHEN play_type = 'punt' THEN 28 ELSE 29 END END AS kicker_id,
       CASE WHEN play_type = 'kickoff' AND h3 % 3 <> 0 THEN other_id * 40 + 27 END AS returner_id,
       CASE play_type
         WHEN 'quarter_marker' THEN '15:00 - Quarter ' || CAST(quarter AS STRING)
         WHEN 'kickoff' THEN CASE WHEN h3 % 3 = 0 THEN 'Kickoff by Ostrov, K. through the back of the endzone. Touchback.' ELSE 'Kickoff of ' || CAST(40 + h3 % 30 AS STRING) || ' yards. Returned by Marle (C), V. for ' || CAST(h3 % 35 AS STRING) || ' yards.' END
         WHEN 'punt' THEN 'Punt by Tindel (R), H. of ' || CAST(30 + h3 % 25 AS STRING) || ' yards.'
         WHEN 'field_goal' THEN CAST(20 + h3 % 35 AS STRING) || ' yard FG by Ostrov, K. is ' || CASE WHEN fg_good THEN 'good.' ELSE 'NO good.' END
         WHEN 'pass' THEN 'Pass by P' || CAST(possession_team_id * 40 + h1 % 2 AS STRING) || ', A.' ||
              CASE WHEN interception THEN ', to P' || CAST(possession_team_id * 40 + 20 + h2 % 6 AS STRING) || ', C..<br/> INTERCEPTION by P' || CAST(other_id * 40 + 36 + h3 % 3 AS STRING) || ', I. at the ASH - 42 yard line and returned for 4 yards.'
                   WHEN complete THEN ', complete to P' || CAST(possession_team_id * 40 + 20 + h2 % 6 AS STRING) || ', C. for ' || CASE WHEN yards_gained = 0 THEN 'a short gain' ELSE CAST(yards_gained AS STRING) || ' yds' END || '. Tackle by P' || CAST(other_id * 40 + 30 + h3 % 6 AS STRING) || ', D..'
                   ELSE ' to P' || CAST(possession_team_id * 40 + 20 + h2 % 6 AS STRING) || ', C. falls incomplete.' END
         WHEN 'rush' THEN 'Rush by P' || CAST(possession_team_id * 40 + 10 + h1 % 4 AS STRING) || ', B. for ' || CASE WHEN yards_gained = 0 THEN 'a short gain' ELSE CAST(yards_gained AS STRING) || ' yds' END || '. Tackle by P' || CAST(other_id * 40 + 30 + h3 % 6 AS STRING) || ', D..' ||
              CASE WHEN fumble_lost THEN '<br/> FUMBLE recovered by P' || CAST(other_id * 40 + 33 + h3 % 3 AS STRING) || ', F. at the ASH - 30 yard line and returned for 4 yards.'
                   WHEN fumble_kept THEN '<br/> FUMBLE by P' || CAST(possession_team_id * 40 + 10 + h1 % 4 AS STRING) || ', B., recovered by P' || CAST(possession_team_id * 40 + 10 + (h1 + 1) % 4 AS STRING) || ', B..' ELSE '' END
         WHEN 'sack' THEN 'P' || CAST(possession_team_id * 40 + h1 % 2 AS STRING) || ', A. is SACKED by P' || CAST(other_id * 40 + 30 + h3 % 6 AS STRING) || ', D. - DT for ' || CAST(yards_gained AS STRING) || ' yds.'
         WHEN 'penalty' THEN 'Herons Penalty on Quill, B.: Delay of Game.'
         WHEN 'timeout' THEN 'Timeout called by ASH'
         WHEN 'spike' THEN 'P1, A. spikes the ball.'
         ELSE 'Offense kneels the ball.' END || CASE WHEN touchdown THEN '<br/>TOUCHDOWN!' ELSE '' END || CASE WHEN safety THEN '<br/>Safety!' ELSE '' END AS description
FROM p""".replace("{teams}", TEAMS)


PLAYS_SCHEMA = (
    "game_id BIGINT, play_index BIGINT, season BIGINT, game_type STRING, quarter BIGINT, play_type STRING, home_team STRING, away_team STRING, possession_team_id BIGINT, possession_team STRING, defense_team STRING, clock STRING, "
    "down BIGINT, distance BIGINT, yard_line BIGINT, yard_line_team STRING, yards_gained BIGINT, complete BOOLEAN, touchdown BOOLEAN, interception BOOLEAN, fumble BOOLEAN, fumble_lost BOOLEAN, safety BOOLEAN, fg_good BOOLEAN, pat_good BOOLEAN, first_down BOOLEAN, "
    + ", ".join(f"{r}_id BIGINT" for r in ("passer", "rusher", "receiver", "tackler", "sacker", "interceptor", "fumbler", "fumble_recoverer", "kicker", "returner"))
    + ", description STRING"
)
_COLUMNS = [c.split()[0] for c in PLAYS_SCHEMA.split(", ")]
_WRITTEN: dict[tuple[str, str], str] = {}


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays of all games as PLAYS_SQL makes them from the events."""
    return spark.sql(PLAYS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plays of all games, from the store that the session writes once to the shared folder: a partition a season, buckets by game, sorted by game and play.

    Queries read the columns and seasons they need, and windows over a game need no exchange.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _WRITTEN:
        try:
            return open_store(spark, _WRITTEN[key]).select(_COLUMNS)
        except AnalysisException:  # the folder was cleared since
            pass
    path, rows = shared_folder(spark, "plays"), spark.read.parquet(f"{sf_dir}/events.parquet").count()
    write_store(projected(spark, sf_dir).to(T.StructType.fromDDL(PLAYS_SCHEMA)), path, buckets_for(rows))
    _WRITTEN[key] = path
    return open_store(spark, path).select(_COLUMNS)


def sql(rest: str) -> str:
    """SQL over ``plays`` for any engine that has the ``events`` table."""
    return f"WITH plays AS ({PLAYS_SQL.format(events='events')})" + rest


#: Players and seasons of the plays, with a position by the digits of the id; follows ``plays``.
POSITIONS_SQL = """, mention AS (
  SELECT passer_id AS player_id, season FROM plays UNION SELECT rusher_id, season FROM plays UNION SELECT receiver_id, season FROM plays
  UNION SELECT tackler_id, season FROM plays UNION SELECT sacker_id, season FROM plays UNION SELECT interceptor_id, season FROM plays),
positions AS (
  SELECT player_id, season, CASE WHEN player_id % 40 < 10 THEN 'QB' WHEN player_id % 40 < 20 THEN 'RB' WHEN player_id % 40 < 26 THEN CASE WHEN (player_id + season) % 3 = 0 THEN 'TE' ELSE 'WR' END
         WHEN player_id % 40 < 33 THEN 'LB' WHEN player_id % 40 < 36 THEN 'DL' ELSE 'CB' END AS position
  FROM mention WHERE player_id IS NOT NULL)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, season, position: one row a player and season."""
    rows = plays(spark, sf_dir).select("season", F.explode(F.array_compact(F.array(*(F.col(f"{r}_id") for r in ("passer", "rusher", "receiver", "tackler", "sacker", "interceptor"))))).alias("player_id")).distinct()
    n = F.col("player_id") % 40
    catcher = F.when((F.col("player_id") + F.col("season")) % 3 == 0, "TE").otherwise("WR")
    return rows.select("player_id", "season", F.when(n < 10, "QB").when(n < 20, "RB").when(n < 26, catcher).when(n < 33, "LB").when(n < 36, "DL").otherwise("CB").alias("position"))
