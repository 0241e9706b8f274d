"""Queries of play lists, leaders, game logs, the play browser, names of defenders and model outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.operators import drives as D
from downfield.operators import identity as I
from downfield.operators import leaders as L
from downfield.operators import models as M
from downfield.operators import stats as S
from downfield.plans.identity import KEYED, _keyed
from downfield.plans.leaders import GAME_ROWS, GAMES, SEASON_EPA, _game_rows, _season_epa
from downfield.plans.queries import CONTEXT, DRIVES, EPA, _context, _epa, query, tail
from downfield.plans.views import RESOLVED
from downfield.sources.projection import POSITIONS_SQL, plays, positions
from downfield.sources.tables import written

_LIST = "game_id, play_index, season, play_type, description"
_COLUMNS = _LIST.split(", ")


@query(f" SELECT {_LIST} FROM plays WHERE season = 26 AND play_type = 'pass' ORDER BY game_id, play_index LIMIT 40 OFFSET 25")
def q1_play_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the passes of a season."""
    return L.play_list(plays(spark, sf), season=26, play_type="pass", offset=25, limit=40).select(*_COLUMNS)


@query(f" SELECT {_LIST} FROM plays WHERE game_id = 3")
def q2_game_plays(spark: SparkSession, sf: str) -> DataFrame:
    return L.play_list(plays(spark, sf), game_id=3).select(*_COLUMNS)


@query(f" SELECT {_LIST} FROM plays WHERE 71 IN (passer_id, rusher_id, receiver_id, tackler_id, sacker_id, interceptor_id, kicker_id, returner_id, fumble_recoverer_id)")
def q3_player_plays(spark: SparkSession, sf: str) -> DataFrame:
    return L.play_list(plays(spark, sf), player_id=71).select(*_COLUMNS)


@query(f" SELECT {_LIST} FROM plays WHERE kicker_id = 69 OR returner_id = 69 OR fumble_recoverer_id = 69")
def q3_kicker_plays(spark: SparkSession, sf: str) -> DataFrame:
    """A player who only kicks."""
    return L.play_list(plays(spark, sf), player_id=69).select(*_COLUMNS)


for _kind, (_rows, _) in GAME_ROWS.items():
    _c = L.CATEGORIES[_kind]
    _types = ", ".join(f"'{t}'" for t in _c.types)

    def _logs(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        return L.game_logs(_game_rows(spark, sf, kind), kind)

    _logs.__name__ = f"q6_{_kind}_logs"
    query(GAMES + tail("gr", _rows) + f" SELECT {_c.ident} AS player_id, season, game_id, {', '.join(_c.stats)} FROM gr JOIN gi USING (game_id)")(_logs)

    def _leaders(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        return L.epa_leaders(_season_epa(spark, sf), _epa(spark, sf), kind, 26, least=10)

    _leaders.__name__ = f"q10_{_kind}_leaders"
    query(
        SEASON_EPA + f", lg AS (SELECT avg(epa) AS league FROM epa WHERE season = 26 AND game_type = 'regular' AND play_type IN ({_types}))"
        f" SELECT player_id, season, team, {_c.epa}, {_c.plays}, {_c.epa} / {_c.plays} AS epa_per_play, round(({_c.epa} / {_c.plays} - league) * 100, 1) AS epa_plus FROM pse, lg WHERE season = 26 AND game_type = 'regular' AND {_c.plays} >= 10"
        f" ORDER BY epa_per_play {'' if _c.ascending else 'DESC'}, player_id LIMIT 20"
    )(_leaders)

    def _span(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        within = F.col("season").between(26, 28)
        return L.leaderboard(_season_epa(spark, sf).where(within), _game_rows(spark, sf, kind).where(within & (F.col("game_type") != "preseason")), positions(spark, sf).where(within), kind, career=True, min_plays=5)

    _nr = {"passing": 19, "rushing": 20, "receiving": 21, "defense": 22}[_kind]
    _span.__name__ = f"q{_nr}_{_kind}_span"
    _sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in _c.stats)
    _zero = ", ".join(f"coalesce(t.{s}, 0) AS {s}" for s in (*_c.stats, "games"))
    query(
        SEASON_EPA + POSITIONS_SQL + GAMES + tail("gr", _rows) + f", t AS (SELECT {_c.ident} AS player_id, {_sums}, count(*) AS games FROM gr JOIN gi USING (game_id) WHERE game_type <> 'preseason' AND season BETWEEN 26 AND 28 GROUP BY 1),"
        f" e AS (SELECT player_id, max(team) AS team, sum({_c.epa}) AS {_c.epa}, CAST(sum({_c.plays}) AS BIGINT) AS {_c.plays} FROM pse WHERE {_c.plays} > 0 AND season BETWEEN 26 AND 28 GROUP BY 1),"
        " ps AS (SELECT player_id, position FROM positions WHERE season BETWEEN 26 AND 28 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, position) = 1)"
        f" SELECT player_id, team, {_c.epa}, {_c.plays}, {_zero}, position, {_c.epa} / {_c.plays} AS epa_per_play FROM e LEFT JOIN t USING (player_id) LEFT JOIN ps USING (player_id) WHERE {_c.plays} >= 5"
    )(_span)


@query(" SELECT DISTINCT season FROM plays")
def q14_seasons(spark: SparkSession, sf: str) -> DataFrame:
    return plays(spark, sf).select("season").distinct().orderBy("season")


@query(" SELECT DISTINCT team FROM (SELECT home_team AS team FROM plays UNION ALL SELECT away_team FROM plays) WHERE team IS NOT NULL")
def q14_teams(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array("home_team", "away_team")).alias("team")
    return plays(spark, sf).select("home_team", "away_team").distinct().select(both).where("team is not null").distinct().orderBy("team")


def _browsed(side: str, where: str, order: str = "", more: str = "") -> str:
    """SQL of the play browser over rows that pass where."""
    first, listed = L.SIDES[side]
    ids = ", ".join(f"{r}_id" for r in first)
    players = "concat_ws(',', " + ", ".join(f"'{r}:' || {r}_id" for r in listed) + ")"
    return (
        EPA + POSITIONS_SQL + RESOLVED + more + f", b AS (SELECT * FROM epa e WHERE coalesce({ids}) IS NOT NULL AND {where.format(ids=ids)})"
        f" SELECT game_id, play_index, season, CAST(floor((game_id - min(game_id) OVER (PARTITION BY season)) / 7.0) AS BIGINT) + 1 AS week, play_type, rs.team AS off_team, CASE WHEN rs.team = home_team THEN away_team WHEN rs.team IS NOT NULL THEN home_team END AS def_team,"
        f" coalesce({ids}) AS player_id, {players} AS players, yards_gained, epa FROM b LEFT JOIN (SELECT season, id AS possession_team_id, team FROM rs) rs USING (season, possession_team_id)" + order
    )


@query(_browsed("offense", "game_type = 'regular' AND EXISTS (SELECT 1 FROM positions p WHERE p.season = e.season AND p.position = 'WR' AND p.player_id IN ({ids}))"))
def q24_browse_offense(spark: SparkSession, sf: str) -> DataFrame:
    return L.browse(_epa(spark, sf), positions(spark, sf), "offense", position="WR")


@query(_browsed("defense", "game_type = 'regular' AND EXISTS (SELECT 1 FROM positions p WHERE p.season = e.season AND p.position = 'CB' AND p.player_id IN ({ids}))"))
def q24_browse_defense(spark: SparkSession, sf: str) -> DataFrame:
    return L.browse(_epa(spark, sf), positions(spark, sf), "defense", position="CB")


#: Ids of the one team CAN in its games of a season.
_OWN = """, sc AS (SELECT DISTINCT season, possession_team_id AS id, game_id, home_team, away_team FROM plays WHERE possession_team_id IS NOT NULL AND 'CAN' IN (home_team, away_team)),
sn AS (SELECT season, id, team, count(DISTINCT game_id) AS n FROM (SELECT season, id, game_id, home_team AS team FROM sc UNION ALL SELECT season, id, game_id, away_team FROM sc) GROUP BY ALL),
own AS (SELECT id FROM sn JOIN (SELECT season, id, count(DISTINCT game_id) AS n FROM sc GROUP BY ALL) USING (season, id, n) GROUP BY season, id HAVING count(*) = 1 AND min(team) = 'CAN')"""


@query(_browsed("offense", "game_type = 'regular' AND season BETWEEN 25 AND 29 AND play_type = 'pass' AND 'CAN' IN (home_team, away_team) AND (NOT EXISTS (SELECT 1 FROM own) OR possession_team_id IN (SELECT id FROM own))", more=_OWN))
def q24_browse_team(spark: SparkSession, sf: str) -> DataFrame:
    """A team's own passes, found by the id that resolves to it."""
    return L.browse(_epa(spark, sf), positions(spark, sf), "offense", seasons=(25, 29), play_type="pass", team="CAN", sort="epa")


@query(_browsed("defense", "season BETWEEN 25 AND 27 AND 71 IN ({ids})", " ORDER BY epa NULLS LAST, game_id, play_index LIMIT 30 OFFSET 2"))
def q24_browse_player(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a defender's plays, the lowest EPA first."""
    return L.browse(_epa(spark, sf), positions(spark, sf), "defense", seasons=(25, 27), game_type=None, player_id=71, sort="epa", ascending=True, offset=2, limit=30)


@query(tail("te", "h6_team_epa") + " SELECT team, season, game_type, side, success_rate, CAST(rank() OVER (PARTITION BY season, game_type, side ORDER BY success_rate DESC NULLS LAST) AS INT) AS rank FROM te")
def q32_ranked_again(spark: SparkSession, sf: str) -> DataFrame:
    return L.ranked_by(S.team_epa(_epa(spark, sf)), "success_rate", "season", "game_type", "side").select("team", "season", "game_type", "side", "success_rate", "rank")


@query(KEYED + " SELECT season, game_id, play_index, role, name, CASE WHEN role IN ('tackler', 'sacker', 'interceptor', 'fumble_recoverer') AND pid % 40 = 30 AND name = 'P' || pid || ', D.' AND EXISTS (SELECT 1 FROM ky o WHERE o.player_key = 'p' || (ky.pid + 1) || ', d') THEN 'p' || (pid + 1) || ', d' ELSE player_key END AS player_key FROM ky")
def r4_defensive_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Each first linebacker's short name is taken for the second's, in defensive roles only."""
    keyed = written(_keyed(spark, sf), "keyed")
    number = plays(spark, sf).where("tackler_id % 40 = 30").select(F.col("tackler_id").alias("n")).distinct()
    label = lambda c: F.concat(F.lit("P"), c.cast("string"), F.lit(", D."))
    aliases = number.select(label(F.col("n")).alias("name"), label(F.col("n") + 1).alias("canonical"))
    return I.with_defensive_keys(keyed, aliases).select("season", "game_id", "play_index", "role", "name", "player_key")


@query(", a AS (SELECT DISTINCT passer_id AS player_id, season, 'P' || passer_id AS name FROM plays WHERE passer_id IS NOT NULL) SELECT CASE WHEN player_id % 40 = 1 THEN player_id - 1 ELSE player_id END AS player_id, season, name FROM a WHERE player_id % 40 <> 1 OR NOT EXISTS (SELECT 1 FROM a o WHERE o.player_id = a.player_id - 1 AND o.season = a.season)")
def r9_moved_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names of second passers move to the first; where he has one in that season, his stays."""
    names = plays(spark, sf).where("passer_id is not null").select(F.col("passer_id").alias("player_id"), "season", F.concat(F.lit("P"), F.col("passer_id").cast("string")).alias("name")).distinct()
    merges = names.where("player_id % 40 = 1").select(F.col("player_id").alias("removed"), (F.col("player_id") - 1).alias("kept")).distinct()
    return I.moved_rows(names, I.followed(merges), "season")


def _probabilities() -> Column:
    """Seven given shares that sum to 1: the nearer the goal, the more for touchdowns."""
    y = F.col("yl100") / 100.0
    return F.array(0.6 * y, F.lit(0.1), F.lit(0.02), 0.18 + 0.6 * (1 - y), F.lit(0.02), F.lit(0.05), F.lit(0.03))


@query(CONTEXT + " SELECT game_id, play_index, 7 * 0.6 * (yl100 / 100.0) + 3 * 0.1 + 2 * 0.02 - 2 * 0.02 - 3 * 0.05 - 7 * 0.03 AS ep FROM ctx WHERE yl100 IS NOT NULL")
def m5_expected_points(spark: SparkSession, sf: str) -> DataFrame:
    """Expected points of given probabilities."""
    return _context(spark, sf).where("yl100 is not null").select("game_id", "play_index", M.points_of(_probabilities()).alias("ep"))


@query(DRIVES + """, e AS (SELECT season, 1.0::DOUBLE / (1 + play_index % 3) AS w, drive_points::DOUBLE AS y, drive_points - yl100 / 20.0::DOUBLE AS e FROM drv WHERE yl100 IS NOT NULL)
SELECT season, count(*) AS n, sum(w * abs(e)) / sum(w) AS mae, 1 - sum(w * e * e) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) AS r2 FROM e GROUP BY season""")
def m6_regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of given predictions of the points of a drive."""
    rows = D.with_drives(_context(spark, sf)).where("yl100 is not null")
    return M.evaluate_regression(rows.withColumns({"ep": F.col("yl100") / 20.0, "weight": 1.0 / (1 + F.col("play_index") % 3)}), by=("season",))


@query(tail("nx", "d3_next_score") + CONTEXT + """, l AS (SELECT season, CASE next_score WHEN 'td_pos' THEN 0.6 * (yl100 / 100.0) WHEN 'fg_pos' THEN 0.1 WHEN 'safety_pos' THEN 0.02 WHEN 'no_score' THEN 0.18 + 0.6 * (1 - yl100 / 100.0) WHEN 'safety_neg' THEN 0.02 WHEN 'fg_neg' THEN 0.05 ELSE 0.03 END AS p FROM ctx JOIN nx USING (game_id, play_index) WHERE yl100 IS NOT NULL)
SELECT season, count(*) AS n, avg(-ln(greatest(p, 1e-15))) AS log_loss FROM l GROUP BY season""")
def m7_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Log-loss of given probabilities of the next score."""
    rows = D.with_next_score(_context(spark, sf)).where("yl100 is not null")
    return M.log_loss(rows.withColumn("probabilities", _probabilities()), by=("season",))
