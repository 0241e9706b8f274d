"""Queries of player identity over the names in the texts of plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.functions.names import initial_last, last_first, normalized
from downfield.functions.parse import parse_plays
from downfield.operators import identity as I
from downfield.plans.queries import query
from downfield.sources.projection import plays
from downfield.sources import refresh as R
from downfield.sources.tables import shared_folder, written

_LETTERS = (("passer", "A"), ("rusher", "B"), ("receiver", "C"), ("tackler", "D"), ("sacker", "D"), ("interceptor", "I"), ("fumbler", "B"))
_ROLE_ORDER = sorted((*I.OFFENSE, *I.DEFENSE, *I.TEAMLESS))


def _team_of(role: str) -> str:
    return "possession_team" if role in I.OFFENSE else "defense_team" if role in I.DEFENSE else "CAST(NULL AS VARCHAR)"


_ROWS = [
    f"SELECT season, game_id, play_index, '{r}' AS role, {r}_id AS pid, 'P' || {r}_id AS stem, '{x}' AS letter, {_team_of(r)} AS team, '' AS tag FROM plays WHERE {r}_id IS NOT NULL" + (" AND play_type = 'pass'" if r == "receiver" else "")
    for r, x in _LETTERS
]
_ROWS.append("SELECT season, game_id, play_index, 'fumble_recoverer', fumble_recoverer_id, 'P' || fumble_recoverer_id, CASE WHEN fumble_lost THEN 'F' ELSE 'B' END, NULL, '' FROM plays WHERE fumble_recoverer_id IS NOT NULL")
_ROWS += [
    f"SELECT season, game_id, play_index, '{r}', NULL, '{stem}', '{x}', {_team_of(r)}, '{tag}' FROM plays WHERE {cond}"
    for r, stem, x, tag, cond in (("kicker", "Ostrov", "K", "", "play_type = 'field_goal' OR description LIKE 'Kickoff by%'"), ("kicker", "Tindel", "H", " (R)", "play_type = 'punt'"), ("returner", "Marle", "V", " (C)", "description LIKE 'Kickoff of%'"))
]
#: Roles that a text of the games names; even seasons write the first name first.
MENTIONS = ", mn AS (SELECT *, CASE WHEN season % 2 = 0 THEN letter || 'nn ' || stem ELSE stem || tag || ', ' || letter || '.' END AS name FROM (" + " UNION ALL ".join(_ROWS) + "))"
KEYED = MENTIONS + ", ky AS (SELECT *, CASE WHEN season % 2 = 1 OR EXISTS (SELECT 1 FROM mn o WHERE o.stem = mn.stem AND o.letter = mn.letter AND o.season % 2 = 1) THEN lower(stem) || ', ' || lower(letter) ELSE lower(letter) || 'nn ' || lower(stem) END AS player_key FROM mn)"
_ORDER = "CASE role " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(_ROLE_ORDER)) + " END"
PEOPLE = KEYED + f""", pf AS (SELECT player_key, arg_min(name, season * 1e13::BIGINT + game_id * 100000 + play_index * 100 + {_ORDER}) AS name, min({{'s': season, 'g': game_id, 'p': play_index, 'r': role}}) AS f,
  min(season) AS first_season, max(season) AS last_season, count(*) AS mentions FROM ky GROUP BY 1),
people AS (SELECT row_number() OVER (ORDER BY f, player_key) AS player_id, player_key, name, first_season, last_season, mentions FROM pf)"""


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names read from the texts; in even seasons turned to 'First Last', so that both forms occur."""
    rows = I.mentions(parse_plays(plays(spark, sf)), "parsed_")
    turned = F.concat(F.regexp_extract("name", r", (\w)\.?", 1), F.lit("nn "), F.regexp_extract("name", r"^(\w+)", 1))
    return rows.withColumn("name", F.when(F.col("season") % 2 == 0, turned).otherwise(F.concat(F.regexp_replace("name", r"\.$", ""), F.lit("."))))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with keys; texts are parsed once, as several steps read the names."""
    return I.with_player_key(written(_mentions(spark, sf), "mentions"))


@query(MENTIONS + " SELECT season, game_id, play_index, role, name, team FROM mn")
def r1_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf).select("season", "game_id", "play_index", "role", "name", "team")


@query(PEOPLE + " SELECT * FROM people")
def r2_players(spark: SparkSession, sf: str) -> DataFrame:
    return I.players(_keyed(spark, sf))


@query(PEOPLE + " SELECT DISTINCT player_id, ky.name, season, team FROM ky JOIN people USING (player_key)")
def r5_aliases(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    return I.aliases(keyed, I.players(keyed))


TWINS = ", ids AS (SELECT passer_id * 2 + season % 2 AS player_id, 'P' || passer_id || ', A.' AS name, passer_id, min(season) AS first_season, max(season) AS last_season, count(*) AS mentions FROM plays WHERE passer_id IS NOT NULL GROUP BY 1, 2, 3)"


def _twins(spark: SparkSession, sf: str) -> DataFrame:
    """Passers with one id in even and another in odd seasons."""
    rows = plays(spark, sf).where("passer_id is not null")
    return rows.groupBy((F.col("passer_id") * 2 + F.col("season") % 2).alias("player_id"), F.concat(F.lit("P"), F.col("passer_id").cast("string"), F.lit(", A.")).alias("name")).agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("mentions"))


@query(TWINS + " SELECT 'p' || passer_id || ', a' AS norm, min(player_id) AS kept, CAST(max(player_id) AS VARCHAR) AS removed FROM ids GROUP BY passer_id HAVING count(*) >= 2")
def r8_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicates(_twins(spark, sf)).select("norm", "kept", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query(TWINS + " SELECT min(player_id) AS player_id, name, min(first_season) AS first_season, max(last_season) AS last_season, CAST(sum(mentions) AS BIGINT) AS mentions FROM ids GROUP BY name")
def r9_merged_players(spark: SparkSession, sf: str) -> DataFrame:
    people = _twins(spark, sf)
    return I.merge_people(people, I.duplicates(people).select("kept", F.explode("removed").alias("removed")))


@query(TWINS + " SELECT DISTINCT passer_id, 'Ann P' || passer_id || CASE WHEN passer_id % 3 = 0 THEN ' Jr.' ELSE '' END AS name, max(player_id) OVER (PARTITION BY passer_id) AS player_id FROM ids")
def r10_roster_match(spark: SparkSession, sf: str) -> DataFrame:
    jr = F.when(F.col("passer_id") % 3 == 0, " Jr.").otherwise("")
    roster = plays(spark, sf).where("passer_id is not null").select("passer_id", F.concat(F.lit("Ann P"), F.col("passer_id").cast("string"), jr).alias("name")).distinct()
    return I.match_roster(roster, _twins(spark, sf))


def _own_key(rows: str) -> str:
    """The key of a mention of mn among the mentions of ``rows``."""
    return f"CASE WHEN mn.season % 2 = 1 OR EXISTS (SELECT 1 FROM mn o WHERE o.stem = mn.stem AND o.letter = mn.letter AND o.season % 2 = 1 AND {rows}) THEN lower(mn.stem) || ', ' || lower(mn.letter) ELSE lower(mn.letter) || 'nn ' || lower(mn.stem) END"


@query(MENTIONS + f""", k1 AS (SELECT mn.*, {_own_key('o.season <= 27')} AS player_key FROM mn WHERE season <= 27),
st AS (SELECT DISTINCT name, team, player_key FROM k1),
k2 AS (SELECT mn.*, coalesce(st.player_key, {_own_key('true')}) AS player_key FROM mn LEFT JOIN st ON st.name = mn.name AND st.team IS NOT DISTINCT FROM mn.team WHERE mn.season > 27),
f1 AS (SELECT player_key, min({{'s': season, 'g': game_id, 'p': play_index, 'r': role}}) AS f FROM k1 GROUP BY 1), f2 AS (SELECT player_key, min({{'s': season, 'g': game_id, 'p': play_index, 'r': role}}) AS f FROM k2 GROUP BY 1),
i1 AS (SELECT player_key, row_number() OVER (ORDER BY f, player_key) AS player_id FROM f1),
i2 AS (SELECT player_key, (SELECT count(*) FROM i1) + row_number() OVER (ORDER BY f, player_key) AS player_id FROM f2 WHERE player_key NOT IN (SELECT player_key FROM i1)),
ids AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2), ev AS (SELECT player_key, season FROM k1 UNION ALL SELECT player_key, season FROM k2)
SELECT player_id, player_key, min(season) AS first_season, max(season) AS last_season, count(*) AS mentions FROM ev JOIN ids USING (player_key) GROUP BY 1, 2""")
def r6_later_players(spark: SparkSession, sf: str) -> DataFrame:
    """Players of seasons up to 27, stored; then those after are taken in: old ids stay, new names only are resolved."""
    rows, path = written(_mentions(spark, sf), "mentions"), shared_folder(spark, "people")
    first = written(I.with_player_key(rows.where("season <= 27")), "keyed")
    R.write_dimension(I.players(first), path, "player_key")
    later = written(I.extend_keys(rows.where("season > 27"), written(I.name_keys(first), "stored-keys")), "keyed")
    I.extend_players(spark, path, later)
    return R.read_dimension(spark, path).select("player_id", "player_key", "first_season", "last_season", "mentions")


#: Passers by a name that eight teams share; ids of the roster go over two teams, each third has no row for season 27.
SHARED = "'Quill (' || possession_team || '), ' || CASE WHEN passer_id % 2 = 0 THEN 'A' ELSE 'B' END || '.'"


@query(f""", q AS (SELECT season, game_id, play_index, possession_team AS team, CAST(floor(possession_team_id / 2) AS BIGINT) * 10 + passer_id % 2 AS rid, 'quill, ' || CASE WHEN passer_id % 2 = 0 THEN 'a' ELSE 'b' END AS norm FROM plays WHERE passer_id IS NOT NULL),
am AS (SELECT norm FROM q WHERE NOT (season = 27 AND rid % 3 = 0) GROUP BY 1 HAVING count(DISTINCT rid) > 1)
SELECT CASE WHEN norm NOT IN (SELECT norm FROM am) THEN norm WHEN season = 27 AND rid % 3 = 0 THEN norm || '|' || team ELSE norm || '|#' || rid END AS player_key, count(*) AS mentions, min(season) AS first_season, max(season) AS last_season FROM q GROUP BY 1""")
def r3_shared_names(spark: SparkSession, sf: str) -> DataFrame:
    """One key a player of a name that several have: by the roster's team and season, else by team."""
    rows = plays(spark, sf).where("passer_id is not null").select("season", "game_id", "play_index", F.lit("passer").alias("role"), F.expr(SHARED).alias("name"), F.col("possession_team").alias("team"), (F.floor(F.col("possession_team_id") / 2) * 10 + F.col("passer_id") % 2).alias("rid"))
    stays = rows.where("NOT (season = 27 AND rid % 3 = 0)").select(F.col("rid").alias("index_player_id"), "name", "team", F.col("season").alias("first_season"), F.col("season").alias("last_season")).distinct()
    keyed = I.split_by_roster(I.with_player_key(rows.drop("rid")), stays)
    return keyed.groupBy("player_key").agg(F.count("*").alias("mentions"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


@query(PEOPLE + " SELECT player_id, name, first_season, last_season FROM people WHERE player_id IN (SELECT player_id FROM ky JOIN people USING (player_key) WHERE contains(lower(ky.name), 'nn p1'))")
def q7_indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Players with an alias that holds a text in any case, found by the index of names."""
    keyed, path = written(_keyed(spark, sf), "keyed"), shared_folder(spark, "name-index")
    people = I.players(keyed)
    names = written(I.aliases(keyed, people), "aliases")
    I.write_name_index(names, path)
    return I.search_index(spark, path, people, names, "NN P1", limit=None)


@query(""", n AS (SELECT game_id, play_index, passer_id, CASE passer_id % 4 WHEN 0 THEN 'Zoé ™ van der P' || passer_id || ' Jr.' WHEN 1 THEN '  P' || passer_id || ' (C) ,A..' WHEN 2 THEN 'Ann P' || passer_id ELSE 'Solo' || passer_id END AS name FROM plays WHERE passer_id IS NOT NULL)
SELECT game_id, play_index, CASE passer_id % 4 WHEN 0 THEN 'zo van der p' || passer_id || ' jr' WHEN 1 THEN 'p' || passer_id || ', a' WHEN 2 THEN 'ann p' || passer_id ELSE 'solo' || passer_id END AS norm,
       CASE passer_id % 4 WHEN 0 THEN 'van der p' || passer_id || ' jr, z' WHEN 2 THEN 'p' || passer_id || ', a' END AS long, CASE passer_id % 4 WHEN 0 THEN 'jr, z' END AS short FROM n""")
def n3_name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of names with marks, letters beyond ASCII, tags and several words."""
    name = F.expr("CASE passer_id % 4 WHEN 0 THEN concat('Zo\u00e9 \u2122 van der P', passer_id, ' Jr.') WHEN 1 THEN concat('  P', passer_id, ' (C) ,A..') WHEN 2 THEN concat('Ann P', passer_id) ELSE concat('Solo', passer_id) END")
    rows = plays(spark, sf).where("passer_id is not null").select("game_id", "play_index", name.alias("name"))
    return rows.select("game_id", "play_index", normalized(F.col("name")).alias("norm"), last_first(F.col("name")).alias("long"), initial_last(F.col("name")).alias("short"))


@query(KEYED + """, fixed AS (SELECT *, CASE WHEN lower(stem) || ', ' || lower(letter) = 'p81, a' OR lower(letter) || 'nn ' || lower(stem) = 'ann p81' THEN CASE WHEN season % 2 = 1 THEN 'p80, a' ELSE player_key END
  WHEN name = 'Dnn P110' THEN 'dnn p110' ELSE player_key END AS k FROM ky)
SELECT k AS player_key, count(*) AS mentions FROM (SELECT CASE WHEN season % 2 = 0 AND stem = 'P81' AND letter = 'A' THEN 'ann p81' ELSE k END AS k FROM fixed) GROUP BY 1""")
def r4_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with one name that means another, and one that is kept apart from its 'Last, F.' form."""
    over = spark.createDataFrame([("P81, A.", "P80, A.")], "name string, canonical string")
    apart = spark.createDataFrame([("Dnn P110",)], "name string")
    keyed = I.with_player_key(written(_mentions(spark, sf), "mentions"), overrides=over, apart=apart)
    return keyed.groupBy("player_key").agg(F.count("*").alias("mentions"))
