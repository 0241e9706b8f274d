"""Queries of sources and sinks: plays are written in a source's form (files or pages), read back, and compared with what went in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.functions.context import is_two_point
from downfield.functions.parse import filled_distance, pattern_counts, score
from downfield.operators import stats as S
from downfield.plans.leaders import BOX
from downfield.plans.queries import EPA, TEAM, _epa, query, tail
from downfield.operators import drives as D
from downfield.sources import pages as P
from downfield.sources import refresh as R
from downfield.sources import tables as T
from downfield.sources.projection import plays
from downfield.sources.store import LEAST_BUCKETS

#: Down and place as texts, as the game files hold them.
DOWN = "CASE WHEN down IS NULL THEN '---' WHEN distance IS NULL THEN concat(down, 'th and inches') ELSE concat(down, 'th and ', distance) END"
PLACE = "CASE WHEN yard_line IS NULL THEN '--' ELSE concat(yard_line_team, ' - ', yard_line) END"
HEADS = "CASE quarter WHEN 1 THEN 'First Quarter' WHEN 2 THEN 'Second Quarter' WHEN 3 THEN 'Third Quarter' WHEN 4 THEN 'Fourth Quarter' ELSE 'Overtime' END"
RAW = f", raw AS (SELECT game_id, play_index, quarter, CAST(possession_team_id AS INT) AS possession_team_id, clock AS c, {DOWN} AS t, {PLACE} AS o, description AS m FROM plays)"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return plays(spark, sf).select("game_id", "play_index", "quarter", "play_type", F.col("possession_team_id").cast("int").alias("possession_team_id"), F.lit(None).cast("string").alias("s"), F.col("clock").alias("c"), F.expr(DOWN).alias("t"), F.expr(PLACE).alias("o"), F.col("description").alias("m"), F.lit("").alias("css"))


@query(RAW + " SELECT * FROM raw")
def s1_game_files(spark: SparkSession, sf: str) -> DataFrame:
    """Games are written as nested JSON, one a line, read with the schema of the files and flattened."""
    path = T.shared_folder(spark, "games")
    T.nest_games(_raw(spark, sf)).write.json(path)
    return T.flatten_games(T.read_games(spark, path, multi_line=False)).select("game_id", F.col("play_index").cast("long").alias("play_index"), F.col("quarter").cast("long").alias("quarter"), "possession_team_id", "c", "t", "o", "m")


#: A club as its pages write it.
CLUB = "O'Neil & Caf\u00e9"


def _game_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a game: headers for the quarters, and each part of a text between line breaks as a row of its own.

    Texts have references for what markup needs and some other letters, clocks white space and a comment, logos stand by a table of their own.
    """
    rows = _raw(spark, sf).withColumns({"head": F.expr(HEADS), "m": F.replace("m", F.lit("Herons"), F.lit(CLUB))})
    told = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit("\u00e9"), F.lit("&eacute;")), F.lit("TOUCHDOWN!"), F.lit("TOUCHDOWN&#33;")), F.lit("INTERCEPTION"), F.lit("INTERCEPT&#x49;ON"))
    cell = lambda c, css="": F.concat(F.lit(f"<td{css}>"), c, F.lit("</td>"))
    wide = lambda c: F.concat(F.lit("<td>&nbsp;"), c, F.lit(" <!-- & --></td>"))
    parts = F.transform(F.split("m", r"<br/>\s*"), told)
    image = F.concat(F.lit("<table><tr><td>logo</td></tr></table>"), F.coalesce(F.concat(F.lit('<img src="/logos/'), F.col("possession_team_id").cast("string"), F.lit('_s.png">')), F.lit("")))
    first = F.concat(F.lit("<tr>"), cell(image), wide(F.col("c")), cell(F.col("t")), cell(F.col("o")), cell(F.get(parts, F.lit(0)), ' class="c"'), F.lit("</tr>"))
    more = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.lit("<tr>"), *(cell(F.lit("")) for _ in range(4)), cell(p, ' class="d"'), F.lit("</tr>")))
    body = F.when(F.col("play_type") == "quarter_marker", F.concat(F.lit("<tr><th colspan=5>"), F.col("head"), F.lit("</th></tr>"))).otherwise(F.concat(first, F.array_join(more, "")))
    body = F.when((F.col("quarter") == 5) & (F.col("play_index") % 200 == 190), F.concat(F.lit("<tr><th>Overtime</th></tr>"), body)).otherwise(body)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("play_index", body.alias("b")))), lambda x: x.b), "\n")
    return rows.groupBy("game_id").agg(F.concat(F.lit('<html><table class="Grid">'), whole, F.lit("</table></html>")).alias("html"))


@query(RAW + f""", all_rows AS (
  SELECT r.game_id, r.play_index * 2 AS place, r.quarter, CASE WHEN p.play_type = 'quarter_marker' THEN NULL ELSE r.possession_team_id END AS team_id, CASE WHEN p.play_type = 'quarter_marker' THEN '15:00' ELSE r.c END AS c, r.t, r.o,
         CASE WHEN p.play_type = 'quarter_marker' THEN {HEADS.replace('quarter', 'r.quarter')} ELSE replace(replace(r.m, '<br/> ', '<br/>'), 'Herons', '{CLUB.replace("'", "''")}') END AS m, CASE WHEN p.play_type = 'quarter_marker' THEN '' ELSE 'c' END AS css FROM raw r JOIN plays p USING (game_id, play_index)
  UNION ALL SELECT game_id, play_index * 2 - 1, 5, NULL, '15:00', '---', '--', 'Overtime', '' FROM plays WHERE quarter = 5 AND play_index = 190)
SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY quarter, place) - 1 AS INT) AS play_index, CAST(quarter AS INT) AS quarter, team_id, c, t, o, m, css FROM all_rows""")
def s4_play_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.play_rows(_game_pages(spark, sf), "game_id").select("game_id", "play_index", "quarter", "team_id", "c", "t", "o", "m", "css")


@query(tail("tg", "a5_team_games") + " SELECT game_id, CASE WHEN row_number() OVER (PARTITION BY game_id ORDER BY team) = 1 THEN 'away' ELSE 'home' END AS side, CAST(pass_comp AS INT) AS comp, CAST(pass_att AS INT) AS att, CAST(pass_yards AS INT) AS passing, CAST(rush_yards AS INT) AS rushing, CAST(rush_att AS INT) AS rushes FROM tg")
def s6_box_score_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Team games as box-score pages (the first team by name is away), read back."""
    both = S.team_games(plays(spark, sf)).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("team", *BOX))).alias("g"))
    cell = lambda n, c: F.get("g", F.lit(n)).getField(c).cast("string")
    row = lambda label, a, h: F.concat(F.lit(f"<tr><td>{label.replace('/', '&#47;')}</td><td>&nbsp;<b>"), a, F.lit("</b></td><td>"), h, F.lit("&#160;</td></tr>"))
    half = lambda n: F.concat(cell(n, "pass_comp"), F.lit("/"), cell(n, "pass_att"))
    numbers = [row(label, cell(0, c), cell(1, c)) for label, c in (("Passing", "pass_yards"), ("Rushing", "rush_yards"), ("Rushing Attempts", "rush_att"))]
    html = F.concat(F.lit("<table><tr><td><table><tr><td>Scoring</td></tr></table><table><tr><td colspan=3>Team Stats</td></tr><tr><td><table><tr><td>Passing</td><td>1</td></tr></table></td></tr>"), row("Comp/Att", half(0), half(1)), *numbers, F.lit("</table></td></tr></table>"))
    return P.team_stats(both.select("game_id", html.alias("html")), "game_id").select("game_id", "side", "comp", "att", "passing", "rushing", "rushes")


@query(" SELECT DISTINCT possession_team AS team, possession_team || ' City' AS team_name, 'Ann O''P' || passer_id || ' & Co' AS name, passer_id AS index_player_id, CASE WHEN passer_id % 2 = 0 THEN 'OL' ELSE 'QB' END AS position, CASE WHEN passer_id % 3 <> 0 THEN CAST(50 + passer_id % 40 AS INT) END AS overall FROM plays WHERE passer_id IS NOT NULL")
def s7_roster_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Passers as roster pages of their teams, read back."""
    who = plays(spark, sf).where("passer_id is not null").select(F.col("possession_team").alias("team"), "passer_id").distinct()
    row = F.expr("concat('<tr><td><a href=\"/player.html?x=1&amp;id=', passer_id, '\">Ann O&#39;P', passer_id, ' &amp; Co&nbsp;</a></td><td>', CASE WHEN passer_id % 2 = 0 THEN 'T' ELSE 'QB' END, '</td><td>', CASE WHEN passer_id % 3 <> 0 THEN CAST(50 + passer_id % 40 AS STRING) ELSE '-' END, '</td></tr>')")
    html = F.concat(F.lit("<h1>"), F.col("team"), F.lit(" C&#105;ty (3-2-1)</h1><table><tr><td>Active Roster</td></tr><tr><th>Player</th><th>Pos</th><th>Ovr</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    return P.roster_rows(who.groupBy("team").agg(html.alias("html")), "team")


#: Games on a page of results at most; a page is a week, so that no page grows with the table.
PAGE = 16


def _result_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Games as pages of results with a header of each week, and playoff games linked again on pages of their own."""
    games = plays(spark, sf).select("season", "game_id", "game_type").distinct()
    order = F.when(F.col("game_type") == "preseason", 0).otherwise(1)
    row = F.concat(F.lit("<tr><td>"), F.when(order == 0, "Pre-Season Week 1").otherwise("Week 2"), F.lit('</td></tr><tr><td>at</td><td><a href="/Boxscores/'), F.col("game_id").cast("string"), F.lit('.html">box</a></td></tr>'))
    page = F.concat_ws("-", "season", F.floor(F.col("game_id") / PAGE)).alias("page")
    pages = games.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "game_id", row.alias("r")))), lambda x: x.r), "").alias("html"))
    late = games.where("game_type = 'playoff'").select(F.concat(F.lit("late-"), F.col("game_id").cast("string")).alias("page"), F.concat(F.lit('<a href="Boxscore.html?id='), F.col("game_id").cast("string"), F.lit('">x</a> <a href="/Logs/'), F.col("game_id").cast("string"), F.lit('.html">y</a>')).alias("html"))
    return pages, late


@query(" SELECT DISTINCT game_id, game_type FROM plays")
def s8_result_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages, late = _result_pages(spark, sf)
    return P.game_types(pages, "page", late)


@query(" SELECT CAST(game_id AS VARCHAR) AS link, CAST(CASE WHEN min(game_type) = 'playoff' THEN 2 ELSE 1 END AS BIGINT) AS pages FROM plays GROUP BY game_id")
def s9_game_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links to games in their three forms; a page counts once."""
    pages, late = _result_pages(spark, sf)
    return P.links(pages.unionByName(late), "page")


@query(""", l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT link, count(*) AS pages FROM l GROUP BY 1""")
def s9_links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links of all pages."""
    return P.links(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id", pattern=r'href="([^"]*)"')


@query(" SELECT season, game_type, count(*) AS plays, CAST(sum(CASE WHEN season = 26 THEN yards_gained + 1 ELSE yards_gained END) AS BIGINT) AS yards FROM plays WHERE NOT (season = 26 AND play_type = 'timeout') GROUP BY 1, 2")
def s12_season_reload(spark: SparkSession, sf: str) -> DataFrame:
    """All seasons are written, one is written again with other rows, and the table is read back."""
    path = T.shared_folder(spark, "plays")
    base = plays(spark, sf)
    T.write_partitions(base, path, "season")
    T.write_partitions(base.where("season = 26 AND play_type <> 'timeout'").withColumn("yards_gained", F.col("yards_gained") + 1), path, "season")
    rows = T.read_seasons(spark, path).groupBy(F.col("season").cast("long").alias("season"), "game_type")
    return rows.agg(F.count("*").alias("plays"), F.sum("yards_gained").cast("long").alias("yards"))


@query(", p AS (SELECT passer_id AS player_id, min(season) AS first_season, max(season) AS last_season, CASE WHEN max(season) >= 28 THEN 'new' ELSE 'old' END AS name FROM plays WHERE passer_id IS NOT NULL GROUP BY 1) SELECT * FROM p")
def s13_player_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Players of the earlier seasons, updated by those of the later ones."""
    rows = plays(spark, sf).where("passer_id is not null").withColumn("name", F.when(F.col("season") >= 28, "new").otherwise("old"))
    seen = lambda cond: rows.where(cond).groupBy(F.col("passer_id").alias("player_id"), "name").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    return T.upsert(seen("season < 28"), seen("season >= 28"), "player_id", widen=("first_season", "last_season"))


@query(" SELECT game_id, min(season) AS season, CASE WHEN game_id % 4 = 0 THEN 'playoff' ELSE min(game_type) END AS game_type FROM plays GROUP BY 1")
def s13_game_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Games of even ids, then each second of these again with another type and season, and those of odd ids: of an existing row just the type is replaced."""
    rows = plays(spark, sf).groupBy("game_id").agg(F.min("season").alias("season"), F.min("game_type").alias("game_type"))
    again = rows.where("game_id % 4 = 0").withColumn("game_type", F.lit("playoff")).withColumn("season", F.lit(0).cast("long"))
    return T.upsert(rows.where("game_id % 2 = 0"), again.unionByName(rows.where("game_id % 2 = 1")), "game_id", only=("game_type",))


@query(""", n AS (SELECT DISTINCT 'P' || passer_id AS name, season, passer_id, possession_team AS team FROM plays WHERE passer_id IS NOT NULL)
SELECT name, season, max(CASE WHEN season % 2 = 0 THEN passer_id + 1000 ELSE passer_id END) AS player_id, max(CASE WHEN season % 2 = 0 THEN 'NEW' ELSE team END) AS team FROM n GROUP BY 1, 2""")
def s13_name_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Names are unique with the season: those of even seasons come again with another id and team."""
    rows = plays(spark, sf).where("passer_id is not null").select(F.concat(F.lit("P"), F.col("passer_id").cast("string")).alias("name"), "season", F.col("passer_id").alias("player_id"), F.col("possession_team").alias("team"))
    again = rows.where("season % 2 = 0").withColumns({"player_id": F.col("player_id") + 1000, "team": F.lit("NEW")})
    return T.upsert(rows, again, "name", "season")


@query(""", m AS (SELECT DISTINCT rusher_id AS player_id, season FROM plays WHERE rusher_id IS NOT NULL)
SELECT player_id, season, CASE WHEN player_id % 3 = 0 THEN 'FB' ELSE 'RB' END AS position FROM m""")
def s13_position_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Positions are unique with player and season: a third of them come again with another position."""
    rows = plays(spark, sf).where("rusher_id is not null").select(F.col("rusher_id").alias("player_id"), "season", F.lit("RB").alias("position")).distinct()
    return T.upsert(rows, rows.where("player_id % 3 = 0").withColumn("position", F.lit("FB")), "player_id", "season")


@query(" SELECT game_id % 10 + 1 AS bucket, count(*) AS plays, CAST(sum(CASE WHEN game_id % 10 + 1 >= 9 THEN 100 ELSE play_index END) AS BIGINT) AS marks FROM plays GROUP BY 1")
def s14_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Plays in ten buckets of games; the last two are written anew."""
    path = T.shared_folder(spark, "buckets")
    base = plays(spark, sf).select("game_id", F.col("play_index").alias("mark"), T.bucket(F.col("game_id")).alias("bucket"))
    T.write_partitions(base, path, "bucket")
    T.write_partitions(base.where("bucket >= 9").withColumn("mark", F.lit(100).cast("long")), path, "bucket")
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("plays"), F.sum("mark").alias("marks"))


def _plays_epa(rows: DataFrame) -> DataFrame:
    return D.with_epa(D.with_context(rows))


#: Tables that follow the plays of a season.
DERIVED: dict[str, R.Derive] = {
    "play_epa": lambda rows: _plays_epa(rows).where("epa is not null").select("season", "game_id", "play_index", "ep_before", "ep_after", "epa"),
    "team_epa": lambda rows: S.team_epa(_plays_epa(rows)),
    "passer_epa": lambda rows: S.player_epa(_plays_epa(rows), "passer", ("pass", "sack")),
    "team_games": S.team_games,
}


@query(TEAM + tail("tg", "a5_team_games") + """
SELECT 'play_epa' AS kind, season, CAST(game_id AS VARCHAR) AS name, count(*) AS n, sum(epa) AS value FROM epa WHERE epa IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'team_epa', season, team || ' ' || side || ' ' || game_type, plays, total_epa FROM te
UNION ALL SELECT 'passer_epa', season, passer_id || ' ' || game_type, count(*), sum(epa) FROM epa WHERE epa IS NOT NULL AND passer_id IS NOT NULL AND play_type IN ('pass', 'sack') AND game_type <> 'preseason' GROUP BY 2, 3
UNION ALL SELECT 'team_games', season, game_id || ' ' || team, pass_att, rush_yards FROM tg""")
def s14_refreshed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables built when the games of the last two file buckets of seasons 28 and 29 were half played, then refreshed: they equal a full build."""
    rows, folder = plays(spark, sf), T.shared_folder(spark, "refreshed")
    half = rows.where(~(F.col("season").isin(28, 29) & (T.bucket(F.col("game_id")) > R.FILES - 2) & (F.col("play_index") >= 100)))
    R.build_season_tables(half, folder, DERIVED, LEAST_BUCKETS)
    R.refresh_last(rows, folder, [28, 29], DERIVED)
    read = lambda name: spark.read.parquet(R.derived_path(folder, name)).withColumn("season", F.col("season").cast("long"))
    text = lambda *c: F.concat_ws(" ", *c)
    games = read("play_epa").groupBy("season", text("game_id").alias("name")).agg(F.count("*").alias("n"), F.sum("epa").alias("value"))
    parts = {
        "play_epa": games,
        "team_epa": read("team_epa").select("season", text("team", "side", "game_type").alias("name"), F.col("plays").alias("n"), F.col("total_epa").alias("value")),
        "passer_epa": read("passer_epa").select("season", text("player_id", "game_type").alias("name"), F.col("plays").alias("n"), F.col("epa").alias("value")),
        "team_games": read("team_games").select("season", text("game_id", "team").alias("name"), F.col("pass_att").alias("n"), F.col("rush_yards").cast("double").alias("value")),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(name)) for name, df in parts.items()])


@query(""", p AS (SELECT passer_id AS player_id, min(season) AS first_season, max(season) AS last_season, CASE WHEN max(CASE WHEN season = 29 AND passer_id % 7 = 0 THEN 1 ELSE 0 END) = 1 THEN 'new' ELSE 'old' END AS name FROM plays WHERE passer_id IS NOT NULL AND (season < 29 OR passer_id % 7 = 0) GROUP BY 1) SELECT * FROM p""")
def s13_pruned_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Passers in partitions by key; those of season 29 whose id is a multiple of 7 are merged into the partitions that they hit."""
    rows, path = plays(spark, sf).where("passer_id is not null"), T.shared_folder(spark, "passers")
    seen = lambda cond, name: rows.where(cond).groupBy(F.col("passer_id").alias("player_id")).agg(F.min("season").alias("first_season"), F.max("season").alias("last_season")).withColumn("name", F.lit(name))
    R.write_dimension(seen("season < 29", "old"), path, "player_id")
    R.upsert_dimension(spark, path, seen("season = 29 AND passer_id % 7 = 0", "new"), "player_id", widen=("first_season", "last_season"))
    return R.read_dimension(spark, path)


@query(EPA + " SELECT season, count(*) AS plays, sum(epa) AS epa FROM epa WHERE epa IS NOT NULL AND season >= 27 GROUP BY 1")
def s17_stored_epa(spark: SparkSession, sf: str) -> DataFrame:
    """EPA of plays that have one, stored by season; a range of seasons is read."""
    path = T.shared_folder(spark, "epa")
    T.write_partitions(_epa(spark, sf).where("epa is not null").select("season", "game_id", "play_index", "ep_before", "ep_after", "epa"), path, "season")
    return T.read_seasons(spark, path).where("season >= 27").groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("plays"), F.sum("epa").alias("epa"))


@query(" SELECT game_id, CASE WHEN min(game_type) = 'regular' AND game_id % 2 = 1 THEN 'regular' ELSE min(game_type) END AS game_type, count(*) AS n FROM plays GROUP BY game_id")
def f17_game_type_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Team rows whose game type is missing take it from the games that have another one than regular."""
    rows = plays(spark, sf).withColumn("given", F.when(F.col("game_id") % 2 == 0, F.col("game_type"))).groupBy("game_id").agg(F.max("given").alias("game_type"), F.count("*").alias("n"))
    types = plays(spark, sf).where("game_type <> 'regular'").select("game_id", "game_type").distinct()
    return T.fill_game_type(rows, types)


@query(tail("te", "h6_team_epa") + " SELECT team, season, game_type, side, plays, total_epa, success_rate FROM te")
def s11_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Team EPA as CSV and back."""
    path = T.shared_folder(spark, "teams") + ".csv"
    T.export(S.team_epa(_epa(spark, sf)), path)
    kinds = {"season": "long", "plays": "long", "total_epa": "double", "success_rate": "double"}
    return spark.read.option("header", True).csv(path).select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in ("team", "season", "game_type", "side", "plays", "total_epa", "success_rate")))


@query(tail("tg", "a5_team_games") + """, b AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY team) AS k FROM tg)
 SELECT game_id, CASE WHEN k = 1 THEN 'away' ELSE 'home' END AS side, CAST(pass_yards AS INT) AS passing, CAST(pass_comp AS INT) AS comp, CASE WHEN game_id % 3 <> 0 THEN CAST(pass_att AS INT) END AS att, CAST(rush_yards AS INT) AS rushing, CAST(rush_att AS INT) AS rushes FROM b""")
def s3_box_score_files(spark: SparkSession, sf: str) -> DataFrame:
    """Team games as box-score files, with attempts that are no number in each third game, read back."""
    both = S.team_games(plays(spark, sf)).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("team", *BOX))).alias("g"))
    value = lambda n, c: F.get("g", F.lit(n)).getField(c).cast("string")
    att = lambda n: F.when(F.col("game_id") % 3 == 0, F.lit("-")).otherwise(value(n, "pass_att"))
    cols = [a for n, s in ((0, "a"), (1, "h")) for a in (value(n, "pass_yards").alias(f"{s}Passing"), value(n, "pass_comp").alias(f"{s}Comp"), att(n).alias(f"{s}Att"), value(n, "rush_yards").alias(f"{s}Rushing"), value(n, "rush_att").alias(f"{s}Rushes"))]
    path = T.shared_folder(spark, "boxes")
    both.select(F.col("game_id").alias("id"), *cols).write.json(path)
    return T.read_box_scores(spark, path, multi_line=False)


@query(" SELECT game_id, play_index, CAST(CASE WHEN down IS NOT NULL THEN coalesce(distance, 1) END AS INT) AS distance FROM plays")
def p4_filled_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("game_id", "play_index", filled_distance(F.col("t"), F.lit(None).cast("int")).alias("distance"))


@query(""" SELECT game_id, play_index, away_team AS away, play_index % 50 AS away_points, home_team AS home, game_id % 60 AS home_points FROM plays WHERE play_index % 5 <> 0 UNION ALL SELECT game_id, play_index, NULL, NULL, NULL, NULL FROM plays WHERE play_index % 5 = 0""")
def p3_score_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as the game files write them, read; each fifth text is no score."""
    text = F.expr("CASE play_index % 15 WHEN 0 THEN NULL WHEN 5 THEN '---' WHEN 10 THEN concat(home_team, ' 3') ELSE concat(away_team, ' ', play_index % 50, ' - ', home_team, ' ', game_id % 60) END")
    away, away_points, home, home_points = score(text)
    return plays(spark, sf).select("game_id", "play_index", away.alias("away"), away_points.cast("long").alias("away_points"), home.alias("home"), home_points.cast("long").alias("home_points"))


#: Texts of tries for two points, and one that only box scores count as a play.
TRY = "CASE play_index % 9 WHEN 0 THEN description || ' (2 point try good)' WHEN 1 THEN description || ' Conversion failed' WHEN 2 THEN description || ' 2 POINT' ELSE description END"


@query(f", w AS (SELECT game_id, play_index, {TRY} AS d FROM plays) SELECT game_id, play_index, lower(d) LIKE '%2 point%' OR lower(d) LIKE '%conversion%' AS for_models, d LIKE '%2 point%' OR d LIKE '%conversion%' AS for_box_scores FROM w")
def p11_two_point_tries(spark: SparkSession, sf: str) -> DataFrame:
    rows = plays(spark, sf).withColumn("d", F.expr(TRY))
    return rows.select("game_id", "play_index", is_two_point(F.col("d")).alias("for_models"), is_two_point(F.col("d"), any_case=False).alias("for_box_scores"))


#: Patterns of the text histogram, in order.
HISTOGRAM = {"touchdown": "TOUCHDOWN", "complete": ", complete to", "incomplete": "incomplete", "rush": "^Rush by", "sack": "SACKED", "kick": "^(Kickoff|Punt)"}


@query(" SELECT CASE " + " ".join(f"WHEN regexp_matches(description, '{v}') THEN '{k}'" for k, v in HISTOGRAM.items()) + " ELSE 'other' END AS pattern, count(*) AS n FROM plays GROUP BY 1")
def p13_text_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_counts(plays(spark, sf), HISTOGRAM)
