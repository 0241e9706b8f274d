"""Queries of typed plays, drive lists, backfills, training plays, rosters, players and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from downfield.functions.context import other_team
from downfield.functions.parse import typed_plays
from downfield.operators import drives as D
from downfield.operators import games as G
from downfield.operators import identity as I
from downfield.operators import leaders as L
from downfield.operators import stats as S
from downfield.plans.games import SECONDS
from downfield.plans.identity import PEOPLE, _keyed
from downfield.plans.leaders import GAME_ROWS, GAMES, _game_rows
from downfield.plans.queries import EPA, _epa, query, tail
from downfield.plans.sources import RAW, _raw
from downfield.sources import tables as T
from downfield.sources.projection import POSITIONS_SQL, plays, positions

_NAME = "CASE WHEN {r}_id IS NOT NULL THEN 'P' || {r}_id || ', {x}' END AS {r}"
_TYPED = ", ".join(_NAME.format(r=r, x=x) for r, x in (("passer", "A."), ("rusher", "B."), ("tackler", "D."), ("sacker", "D."), ("interceptor", "I."), ("fumbler", "B.")))
TYPED = ("game_id", "play_index", "quarter", "clock", "possession_team_id", "down", "distance", "distance_text", "yard_line", "yard_line_team", "play_type", "passer", "rusher", "tackler", "sacker", "interceptor", "fumbler", "yards_gained", "touchdown", "interception", "fumble", "fumble_lost", "safety", "fg_good", "penalty")


@query(RAW + f""" SELECT p.game_id, p.play_index, p.quarter, clock, CAST(p.possession_team_id AS INT) AS possession_team_id, down, CASE WHEN down IS NOT NULL THEN coalesce(distance, 1) END AS distance, CASE WHEN down IS NOT NULL THEN coalesce(CAST(distance AS VARCHAR), 'inches') END AS distance_text,
  yard_line, CASE WHEN yard_line IS NOT NULL THEN yard_line_team END AS yard_line_team, play_type, {_TYPED}, CASE WHEN play_type IN ('pass','rush','sack') THEN yards_gained WHEN play_type = 'kickoff' AND description LIKE '%Returned%' THEN CAST(regexp_extract(description, 'for (\\d+) yards', 1) AS BIGINT) END AS yards_gained,
  touchdown, interception, fumble, fumble_lost, safety, fg_good, play_type = 'penalty' AS penalty FROM plays p""")
def p7_typed_plays(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the game files, typed."""
    rows = typed_plays(_raw(spark, sf)).select(*TYPED)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("quarter", "down", "distance", "yard_line", "yards_gained")})


def _team_map(src: str) -> str:
    return f""", gm0 AS (SELECT game_id, min(home_team) AS home, min(away_team) AS away, min(possession_team_id) AS lo, max(possession_team_id) AS hi, arg_min(possession_team_id, play_index) FILTER (possession_team_id IS NOT NULL) AS first,
  arg_min({{'id': possession_team_id, 't': yard_line_team}}, play_index) FILTER (possession_team_id IS NOT NULL AND yard_line_team IS NOT NULL AND play_type NOT IN ('kickoff','quarter_marker')) AS f FROM {src} GROUP BY 1 HAVING count(DISTINCT possession_team_id) = 2),
gm1 AS (SELECT *, coalesce(f.id, first) AS i, coalesce(f.t, away) AS t FROM gm0),
gmap AS (SELECT game_id, i AS possession_team_id, t AS team FROM gm1 UNION ALL SELECT game_id, lo + hi - i, CASE WHEN t = home THEN away ELSE home END FROM gm1)"""


@query(_team_map("plays") + " SELECT * FROM gmap")
def f19_game_team_map(spark: SparkSession, sf: str) -> DataFrame:
    return D.game_team_map(plays(spark, sf))


@query(EPA + _team_map("plays") + """, n1 AS (SELECT *, lag(half) OVER w IS NULL OR lag(half) OVER w <> half OR lag(possession_team_id) OVER w IS DISTINCT FROM possession_team_id OR play_type = 'kickoff' AS fresh FROM epa WINDOW w AS (PARTITION BY game_id ORDER BY play_index)),
n2 AS (SELECT *, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY game_id ORDER BY play_index) AS BIGINT) AS drive, play_type IN ('pass','rush','sack','field_goal','penalty') AS real,
  CASE WHEN touchdown THEN 'TD' WHEN fg_good THEN 'FG' WHEN interception THEN 'INT' WHEN fumble_lost THEN 'FUM' WHEN safety THEN 'Safety' WHEN play_type = 'field_goal' AND NOT fg_good THEN 'Missed FG' WHEN down = 4 AND NOT first_down THEN 'Turnover on Downs' ELSE 'Punt / End' END AS r FROM n1),
n3 AS (SELECT game_id, drive, min(possession_team_id) AS possession_team_id, arg_min(quarter, play_index) AS start_quarter, arg_min(clock, play_index) AS start_clock, arg_max(r, play_index) AS result, count(CASE WHEN real THEN 1 END) AS n_plays, CAST(sum(CASE WHEN real THEN yards_gained ELSE 0 END) AS BIGINT) AS yards, sum(CASE WHEN real THEN coalesce(epa, 0) ELSE 0 END) AS epa,
  arg_min({'y': yard_line, 't': yard_line_team}, play_index) FILTER (real) AS s FROM n2 GROUP BY 1, 2)
SELECT game_id, drive, team, start_quarter, start_clock, CASE WHEN s.t <> team THEN 100 - s.y ELSE s.y END AS start_yards, result, n_plays, yards, epa FROM n3 LEFT JOIN gmap USING (game_id, possession_team_id)""")
def d8_game_drives(spark: SparkSession, sf: str) -> DataFrame:
    return D.game_drives(_epa(spark, sf))


#: The one team in every game of an id and season.
RESOLVED = """, seen AS (SELECT DISTINCT season, possession_team_id AS id, game_id, home_team, away_team FROM plays WHERE possession_team_id IS NOT NULL),
tn AS (SELECT season, id, team, count(DISTINCT game_id) AS n FROM (SELECT season, id, game_id, home_team AS team FROM seen UNION ALL SELECT season, id, game_id, away_team FROM seen) GROUP BY ALL),
rs AS (SELECT season, id, min(team) AS team FROM tn JOIN (SELECT season, id, count(DISTINCT game_id) AS n FROM seen GROUP BY ALL) USING (season, id, n) GROUP BY 1, 2 HAVING count(*) = 1),
abbr AS (SELECT id, list_sort(list(DISTINCT team)) AS teams FROM rs GROUP BY 1)"""


@query(RESOLVED + " SELECT id, array_to_string(teams, ',') AS teams FROM abbr")
def f10_team_names_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    return D.all_abbreviations(plays(spark, sf)).select("id", F.array_join("teams", ",").alias("teams"))


@query(RESOLVED + f""" SELECT game_id, play_index, CASE WHEN play_index % 2 = 0 THEN -1 ELSE {SECONDS} END AS half_seconds,
  CASE WHEN game_id % 2 = 0 THEN -1 WHEN yard_line IS NULL OR yard_line_team IS NULL OR possession_team_id IS NULL THEN NULL WHEN list_contains(teams, yard_line_team) THEN yard_line ELSE 100 - yard_line END AS yl100 FROM plays LEFT JOIN abbr ON id = possession_team_id""")
def f16_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the values exist (-1) and stay."""
    base = plays(spark, sf)
    rows = base.withColumns({"half_seconds": F.when(F.col("play_index") % 2 == 0, -1).cast("long"), "yl100": F.when(F.col("game_id") % 2 == 0, -1).cast("long")})
    return D.backfill(rows, D.all_abbreviations(base)).select("game_id", "play_index", "half_seconds", "yl100")


@query(" SELECT game_id, play_index, CASE WHEN possession_team = home_team THEN away_team WHEN possession_team = away_team THEN home_team END AS opponent FROM plays")
def f12_opponents(spark: SparkSession, sf: str) -> DataFrame:
    return plays(spark, sf).select("game_id", "play_index", other_team(F.col("possession_team"), F.col("home_team"), F.col("away_team")).alias("opponent"))


@query(" SELECT season, count(*) AS plays FROM plays WHERE season BETWEEN 26 AND 28 GROUP BY 1")
def f18_season_range(spark: SparkSession, sf: str) -> DataFrame:
    """Plays are stored by season; only the partitions of the range are read."""
    path = T.shared_folder(spark, "seasons")
    T.write_partitions(plays(spark, sf).select("season", "game_id", "play_index"), path, "season")
    return T.read_seasons(spark, path, T.season_list(season_range="26-28")).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("plays"))


#: Possessions are taken out from season 27 on, and in season 25 with the teams of the game.
GAPS = {"possession_team": "season >= 27 OR season = 25", "home_team": "season = 25", "away_team": "season = 25"}
TRAINING = ", gaps AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN NOT ({w}) THEN {c} END AS {c}" for c, w in GAPS.items()) + ") FROM plays WHERE game_type <> 'preseason' AND season BETWEEN 25 AND 28)"


@query(TRAINING + """, need AS (SELECT DISTINCT possession_team_id AS id, game_id, home_team, away_team FROM gaps WHERE possession_team IS NULL AND home_team IS NOT NULL AND possession_team_id IS NOT NULL),
t1 AS (SELECT id, team, count(DISTINCT game_id) AS n FROM (SELECT id, game_id, home_team AS team FROM need UNION ALL SELECT id, game_id, away_team FROM need) GROUP BY ALL),
t2 AS (SELECT id, min(team) AS resolved FROM t1 JOIN (SELECT id, count(DISTINCT game_id) AS n FROM need GROUP BY 1) USING (id, n) GROUP BY 1 HAVING count(*) = 1),
v AS (SELECT *, lag(play_type) OVER (PARTITION BY game_id ORDER BY play_index) AS was FROM gaps),
c AS (SELECT game_id, possession_team_id, yard_line_team AS team, count(*) AS n, min(play_index) AS f FROM v WHERE was = 'kickoff' AND play_type IN ('pass','rush','sack') AND yard_line <= 50 AND possession_team_id IS NOT NULL GROUP BY 1, 2, 3),
vt AS (SELECT game_id, possession_team_id, team AS vote FROM c WHERE game_id IN (SELECT game_id FROM gaps GROUP BY 1 HAVING count(DISTINCT possession_team_id) >= 2 AND count(DISTINCT yard_line_team) >= 2) QUALIFY row_number() OVER (PARTITION BY game_id, possession_team_id ORDER BY n DESC, f) = 1)
SELECT game_id, play_index, coalesce(possession_team, CASE WHEN home_team IS NOT NULL THEN resolved END, vote) AS possession_team FROM gaps LEFT JOIN t2 ON id = possession_team_id LEFT JOIN vt USING (game_id, possession_team_id)""")
def s15_training_plays(spark: SparkSession, sf: str) -> DataFrame:
    rows = plays(spark, sf).withColumns({c: F.when(~F.expr(w), F.col(c)) for c, w in GAPS.items()})
    return G.training_plays(rows, [25, 26, 27, 28]).select("game_id", "play_index", "possession_team")


@query(tail("sc", "f7_scores_before_plays") + " SELECT game_id, play_index, score_home, score_away FROM sc JOIN plays USING (game_id, play_index) WHERE game_type <> 'preseason' AND season BETWEEN 25 AND 28")
def s15_training_scores(spark: SparkSession, sf: str) -> DataFrame:
    return G.training_plays(plays(spark, sf), [25, 26, 27, 28]).select("game_id", "play_index", "score_home", "score_away")


@query(" SELECT game_type, count(*) AS n FROM plays WHERE game_type <> 'preseason' GROUP BY 1")
def s16_without_preseason(spark: SparkSession, sf: str) -> DataFrame:
    types = plays(spark, sf).select("game_id", "game_type").distinct()
    return G.without_preseason(plays(spark, sf), types).groupBy("game_type").agg(F.count("*").alias("n"))


@query(tail("tg", "a5_team_games") + tail("res", "f8_game_results") + " SELECT game_id, season, team, game_type, opponent, points_for, points_against, at_home, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("pass_att", "pass_td", "rush_td", "first_downs", "sacks_made", "forced_fumbles", "fumble_recoveries")) + ", coalesce(pass_yards + rush_yards, 0) AS total_yards, coalesce(interceptions_thrown + fumbles_lost, 0) AS turnovers FROM res LEFT JOIN tg USING (game_id, season, team)")
def a9_team_game_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = plays(spark, sf)
    return S.with_results(S.team_games(base), G.game_results(base)).select("game_id", "season", "team", "game_type", "opponent", "points_for", "points_against", "at_home", "pass_att", "pass_td", "rush_td", "first_downs", "sacks_made", "forced_fumbles", "fumble_recoveries", "total_yards", "turnovers")


for _kind, _by in (("rushing", "yards"), ("receiving", "yards"), ("defense", "tackles")):
    _c = L.CATEGORIES[_kind]

    def _leaders(spark: SparkSession, sf: str, kind: str = _kind, by: str = _by) -> DataFrame:
        c = L.CATEGORIES[kind]
        return L.season_stats(_game_rows(spark, sf, kind), c.ident, c.stats, "season").orderBy(F.desc(by), "season", "player_id").limit(20)

    _leaders.__name__ = f"q4_{_kind}_leaders"
    _sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in _c.stats)
    query(GAMES + tail("gr", GAME_ROWS[_kind][0]) + f" SELECT {_c.ident} AS player_id, season, {_sums}, count(*) AS games FROM gr JOIN gi USING (game_id) GROUP BY 1, 2 ORDER BY {_by} DESC, season, 1 LIMIT 20")(_leaders)


#: Players of the plays by id, with a name of each season.
PLAYERS = POSITIONS_SQL + ", nm AS (SELECT player_id, 'P' || player_id || ', ' || CASE WHEN season % 2 = 0 THEN 'A.' ELSE 'B.' END AS name, season FROM positions), pe AS (SELECT player_id, 'P' || player_id AS name, min(season) AS first_season, max(season) AS last_season FROM positions GROUP BY 1)"


def _players(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = positions(spark, sf)
    label = F.concat(F.lit("P"), F.col("player_id").cast("string"))
    names = rows.select("player_id", F.concat(label, F.when(F.col("season") % 2 == 0, ", A.").otherwise(", B.")).alias("name"), "season")
    return rows.groupBy("player_id").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season")).select("player_id", label.alias("name"), "first_season", "last_season"), names


@query(PLAYERS + " SELECT * FROM pe WHERE player_id IN (SELECT player_id FROM nm WHERE lower(name) LIKE '%1, a%' AND season = 26)")
def q7_player_search(spark: SparkSession, sf: str) -> DataFrame:
    return I.search_players(*_players(spark, sf), name="1, A", season=26, limit=None)


@query(PLAYERS + " SELECT * FROM pe WHERE 27 BETWEEN first_season AND last_season")
def q7_players_of_season(spark: SparkSession, sf: str) -> DataFrame:
    return I.search_players(*_players(spark, sf), season=27, limit=None)


_CAREERS = {k: L.CATEGORIES[k] for k in ("passing", "rushing", "receiving")}
_FLAT = [(k, s) for k, c in _CAREERS.items() for s in (*c.stats, "games")]


@query(PLAYERS + "".join(tail(f"gr_{k}", GAME_ROWS[k][0]) + f", ca_{k} AS (SELECT {c.ident} AS player_id, " + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in c.stats) + f", count(*) AS games FROM gr_{k} GROUP BY 1)" for k, c in _CAREERS.items())
       + " SELECT pe.*, (SELECT string_agg(season || ' ' || name, ';' ORDER BY season, name) FROM nm WHERE nm.player_id = pe.player_id) AS aliases, " + ", ".join(f"ca_{k}.{s} AS {k}_{s}" for k, s in _FLAT) + " FROM pe" + "".join(f" LEFT JOIN ca_{k} USING (player_id)" for k in _CAREERS))
def q8_player_profiles(spark: SparkSession, sf: str) -> DataFrame:
    base = plays(spark, sf)
    careers = {k: L.season_stats(GAME_ROWS[k][1](base), c.ident, c.stats) for k, c in _CAREERS.items()}
    rows = I.player_profiles(*_players(spark, sf), careers)
    told = F.array_join(F.transform("aliases", lambda a: F.concat_ws(" ", a["season"], a["name"])), ";")
    return rows.select("player_id", "name", "first_season", "last_season", told.alias("aliases"), *(F.col(k)[s].alias(f"{k}_{s}") for k, s in _FLAT))


@query(" SELECT play_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM plays GROUP BY 1")
def q9_play_types(spark: SparkSession, sf: str) -> DataFrame:
    counts = plays(spark, sf).groupBy("play_type").agg(F.count("*").alias("n"))
    # One row a play type: small without a partition.
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n"), "play_type")


@query(POSITIONS_SQL + " SELECT count(DISTINCT season) AS seasons, count(DISTINCT game_id) AS games, count(*) AS plays, (SELECT count(DISTINCT player_id) FROM positions) AS players FROM plays")
def q9_totals(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_compact(F.array(*(F.col(f"{r}_id") for r in ("passer", "rusher", "receiver", "tackler", "sacker", "interceptor"))))
    # Players are few beside plays: their set of ids is counted over one row each.
    games = plays(spark, sf).groupBy("season", "game_id").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set(ids))).alias("ids"))
    rows = games.select("season", "game_id", "n", F.posexplode_outer("ids").alias("at", "player_id"))
    return rows.agg(F.count_distinct("season").alias("seasons"), F.count_distinct("game_id").alias("games"), F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n"))).alias("plays"), F.count_distinct("player_id").alias("players"))


_ROLES = ("passer", "rusher", "receiver", "kicker", "tackler", "sacker", "interceptor", "returner", "fumbler", "fumble_recoverer")


@query(PEOPLE + ", w AS (SELECT game_id, play_index, " + ", ".join(f"max(CASE WHEN role = '{r}' THEN player_id END) AS {r}_id" for r in _ROLES) + " FROM ky JOIN people USING (player_key) GROUP BY 1, 2) SELECT p.game_id, p.play_index, " + ", ".join(f"w.{r}_id" for r in _ROLES) + " FROM plays p LEFT JOIN w USING (game_id, play_index)")
def r7_play_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the identity queries at the plays whose texts name the players."""
    keyed = _keyed(spark, sf)
    return I.attach_ids(plays(spark, sf).select("game_id", "play_index"), keyed, I.players(keyed), _ROLES)


@query(""", r AS (SELECT DISTINCT receiver_id AS k FROM plays WHERE receiver_id IS NOT NULL),
r2 AS (SELECT k, CASE WHEN k % 5 <> 0 THEN k END AS player_id, CASE WHEN k % 3 = 0 THEN 'OWN' END AS team, k // 40 AS team_id, 'Team ' || (k % 2) AS team_name FROM r),
pt AS (SELECT receiver_id AS player_id, max(possession_team) AS t FROM plays WHERE receiver_id % 2 = 0 GROUP BY 1), im AS (SELECT DISTINCT possession_team_id AS team_id, 'I' || possession_team_id AS t FROM plays WHERE possession_team_id % 2 = 1)
SELECT k, r2.player_id, coalesce(pt.t, team, im.t, CASE WHEN team_name = 'Team 0' THEN 'NAME' END) AS team, r2.player_id IS NOT NULL AS matched FROM r2 LEFT JOIN pt ON pt.player_id = r2.player_id LEFT JOIN im USING (team_id)""")
def r11_roster_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Receivers as a roster: some without a player, a team or an id that is known."""
    base = plays(spark, sf).where("receiver_id is not null")
    k = F.col("receiver_id")
    roster = base.select(k.alias("k")).distinct().selectExpr("k", "CASE WHEN k % 5 <> 0 THEN k END AS player_id", "CASE WHEN k % 3 = 0 THEN 'OWN' END AS team", "k div 40 AS team_id", "concat('Team ', k % 2) AS team_name")
    played = base.where(k % 2 == 0).select(k.alias("player_id"), F.col("possession_team").alias("team")).distinct()
    ids = plays(spark, sf).where("possession_team_id % 2 = 1").select(F.col("possession_team_id").alias("id"), F.concat(F.lit("I"), F.col("possession_team_id").cast("string")).alias("team")).distinct()
    names = base.where("possession_team is not null").select(F.lit("Team 0").alias("team_name"), F.lit("NAME").alias("team")).distinct()
    return I.roster_teams(roster, played, ids, names).select("k", "player_id", "team", "matched")
