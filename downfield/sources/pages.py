"""Plays, links and game types from HTML pages, by patterns and windows over the rows of a page.

Text of a cell is that of its text nodes, decoded, each without white space around it and joined; rows and
tables are cut by the depth of their tags, so a table within a cell breaks nothing.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Links to games, logos, headers of quarters and weeks, and words that begin a play (fixed values).
GAME_LINK = r"(?:Logs/|Boxscores/|Boxscore\.html\?id=)(\d+)"
LOGO = r"(\d+)_s\.png"
QUARTERS = {"First Quarter": 1, "Second Quarter": 2, "Third Quarter": 3, "Fourth Quarter": 4, "Overtime": 5}
ACTION = r"^(Kickoff|Punt |Pass |Rush |Free Kick|Onsides? Kick)"
PRESEASON, REGULAR = r"(?i)Pre-Season\s+Week", r"(?i)^Week\s+\d+"
#: Labels of a box score's numbers (fixed values).
BOX_LABELS = {"passing": "Passing", "rushing": "Rushing", "rushes": "Rushing Attempts"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Code points by name, and those that the numbers 128 to 159 stand for.
_NAMED = ",".join(f"{name}:{point}" for name, point in sorted(name2codepoint.items()))
_SHIFTED = ",".join(f"{n}:{ord(bytes([n]).decode('cp1252', 'replace'))}" for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore"))
_UNKNOWN = 0xFFFD


def _letter(point: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    known = F.when(valid, point).otherwise(_UNKNOWN)
    return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """Text with its references replaced: names of HTML 4, decimal and hexadecimal numbers; what is none of these stays as it is."""
    named, shifted = (F.str_to_map(F.lit(x), F.lit(","), F.lit(":")) for x in (_NAMED, _SHIFTED))

    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  evaluated once, used often

    def part(p: Column) -> Column:
        def point(r: Column) -> Column:
            bare = F.rtrim(r, F.lit(";"))
            number = F.when(r.rlike("^#[xX]"), F.conv(F.substring(bare, 3, 8), 16, 10)).when(F.startswith(r, F.lit("#")), F.substring(bare, 2, 10)).cast("bigint")
            return F.when(number.isNull(), F.try_element_at(named, bare).cast("bigint")).when(number.between(128, 159), F.coalesce(F.try_element_at(shifted, number.cast("string")).cast("bigint"), number)).otherwise(number)

        written = lambda r: once(point(r), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(_letter(c), F.substring(p, F.length(r) + 1, F.length(p)))))
        return once(F.regexp_extract(p, r"^(?:#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,7};?|[A-Za-z][A-Za-z0-9]*;)", 0), written)

    parts = F.split(text, "&", -1)
    told = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), part), ""))
    return F.when(F.contains(text, F.lit("&")), told).otherwise(text)


def _text(cell: Column) -> Column:
    plain = F.when(F.contains(cell, F.lit("<!--")), F.regexp_replace(cell, r"(?s)<!--.*?-->", "")).otherwise(cell)
    nodes = F.filter(F.split(plain, r"<[^>]+>", -1), lambda n: n != "")
    return F.array_join(F.transform(nodes, lambda n: F.regexp_replace(decoded(n), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "")


def links(pages: DataFrame, key: str, html: str = "html", pattern: str = GAME_LINK) -> DataFrame:
    """Distinct first groups of ``pattern`` and the number of pages that have each; pages without html have none."""
    rows = pages.select(key, F.explode(F.array_distinct(_all(F.col(html), pattern))).alias("link"))
    return rows.groupBy("link").agg(F.count("*").alias("pages"))


def table_rows(pages: DataFrame, key: str, html: str | Column = "html") -> DataFrame:
    """One row a table row, in the order in which they begin: ``key``, pos, row, which has the row's own markup without that of rows within it."""
    source = F.col(html) if isinstance(html, str) else html
    cut = pages.select(key, F.posexplode(F.split(source, r"(?i)(?=<tr[\s>])|(?<=</tr>)", -1)).alias("pos", "row"))
    opens, closes = F.col("row").rlike(r"(?i)^<tr[\s>]").cast("int"), F.col("row").rlike(r"(?i)</tr>$").cast("int")
    page = Window.partitionBy(key).orderBy("pos")
    cut = cut.withColumn("opens", opens).withColumn("depth", F.sum("opens").over(page) - F.coalesce(F.sum(closes).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.where("depth > 0").withColumn("nth", F.sum("opens").over(Window.partitionBy(key, "depth").orderBy("pos")))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]), "")
    return cut.groupBy(key, "depth", "nth").agg(F.min("pos").alias("pos"), own.alias("row")).select(key, "pos", "row")


def titled_table(html: Column, title: str) -> Column:
    """The first table, at any depth, whose first cell says just ``title``, with what is within it; null if none."""
    pieces = F.split(html, r"(?i)(?=<table[\s>])|(?=</table\s*>)", -1)
    turn = lambda p: F.when(p.rlike(r"(?i)^<table[\s>]"), 1).when(p.rlike(r"(?i)^</table"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<text:string,turn:int,depth:int>>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        depth = (a["depth"] + turn(p)).cast("int")
        return F.struct(depth.alias("depth"), F.concat(a["done"], F.array(F.struct(p.alias("text"), turn(p).cast("int").alias("turn"), depth.alias("depth")))).alias("done"))

    placed = F.aggregate(pieces, start, step, lambda a: a["done"])

    def table(p: Column, i: Column, all_: Column) -> Column:
        after = F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0)))
        ends = F.array_position(F.transform(after, lambda x: (x["turn"] == -1) & (x["depth"] < p["depth"])), True)
        inner = F.when(ends > 0, F.slice(after, F.lit(1), (ends - 1).cast("int"))).otherwise(after)
        return F.when(p["turn"] == 1, F.concat(p["text"], F.array_join(F.transform(inner, lambda x: x["text"]), "")))

    cell = lambda t: F.regexp_extract(t, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", 1)
    tables = F.array_compact(F.get(F.transform(F.array(placed), lambda a: F.transform(a, lambda p, i: table(p, i, a))), F.lit(0)))
    return F.get(F.filter(tables, lambda t: (_text(cell(t)) == title) & ~cell(t).rlike(r"(?i)<table[\s>]")), F.lit(0))


def play_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Plays of play-by-play pages: quarter, play_index, team id, c, t, o, m and css.

    A header sets the quarter of the rows below it and is a marker row itself. Rows of fewer
    than five cells are dropped. A row without down and place that begins with no action
    goes on with the play above it in its quarter; texts are joined by a line-break tag and the
    first css class that is not empty stays.
    """
    rows = table_rows(pages, key, html)
    head = _text(F.regexp_extract("row", r"(?s)<th[^>]*>(.*?)</th>", 1))
    quarter = F.coalesce(*(F.when(head.contains(k), v) for k, v in QUARTERS.items()))
    cells = _all(F.col("row"), r"(?s)<td[^>]*>.*?</td>", 0)
    rows = rows.withColumns({"head": F.when(F.col("row").contains("<th"), head), "cells": cells})
    rows = rows.withColumn("begins", F.when(F.col("head").isNotNull(), quarter)).where(F.col("begins").isNotNull() | (F.col("head").isNull() & (F.size("cells") >= 5)))
    page = Window.partitionBy(key).orderBy("pos")
    cell = lambda n: _text(F.get("cells", F.lit(n)))
    named = F.regexp_extract(F.get("cells", F.lit(4)), r"""^<td[^>]*class=["']([^"']*)["']""", 1)
    marker = F.col("begins").isNotNull()
    pick = lambda fixed, other: F.when(marker, fixed).otherwise(other)
    rows = rows.select(
        key, "pos", marker.alias("marker"), F.coalesce(F.last("begins", ignorenulls=True).over(page), F.lit(1)).alias("quarter"),
        pick(F.lit(None).cast("int"), F.nullif(F.regexp_extract(F.get("cells", F.lit(0)), LOGO, 1), F.lit("")).try_cast("int")).alias("team_id"),
        pick(F.lit("15:00"), cell(1)).alias("c"), pick(F.lit("---"), cell(2)).alias("t"), pick(F.lit("--"), cell(3)).alias("o"), pick(F.col("head"), cell(4)).alias("m"),
        pick(F.lit(""), F.when(named.isin("c", "d", "e"), named).otherwise("")).alias("css"),
    )
    part = Window.partitionBy(key, "quarter").orderBy("pos")
    goes_on = (F.col("t") == "") & (F.col("o") == "") & ~F.col("m").rlike(ACTION) & (F.row_number().over(part) > 1)
    rows = rows.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(part))
    first = lambda c: F.min_by(c, "pos").alias(c)
    plays = rows.groupBy(key, "quarter", "island").agg(
        first("team_id"), first("c"), first("t"), first("o"), F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x.m), "<br/>").alias("m"),
        F.coalesce(F.min_by("css", F.when(F.col("css") != "", F.col("pos"))), F.lit("")).alias("css"),
    )
    index = F.row_number().over(Window.partitionBy(key).orderBy("quarter", "pos")) - 1
    return plays.withColumn("play_index", index).drop("island", "pos")


def game_types(pages: DataFrame, key: str, playoffs: DataFrame | None = None, html: str = "html") -> DataFrame:
    """(game_id, game_type) from result pages: a header of a week holds for the links below it; the last link of a game wins.

    Games linked on ``playoffs`` pages are playoff games. Links before any header are regular.
    """
    rows = table_rows(pages, key, html)
    first = _text(F.regexp_extract("row", r"(?s)<td[^>]*>(.*?)</td>", 1))
    kind = F.when(first.rlike(PRESEASON), "preseason").when(first.rlike(REGULAR), "regular")
    rows = rows.withColumn("game_type", F.coalesce(F.last(kind, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")), F.lit("regular")))
    games = rows.select(key, "pos", "game_type", F.posexplode(_all(F.col("row"), GAME_LINK)).alias("at", "link"))
    games = games.groupBy(F.col("link").cast("long").alias("game_id")).agg(F.max_by("game_type", F.struct(key, "pos", "at")).alias("game_type"))
    if playoffs is None:
        return games
    late = playoffs.select(F.explode(_all(F.col(html), GAME_LINK).cast("array<bigint>")).alias("game_id")).distinct().withColumn("__late", F.lit("playoff"))
    return games.join(late, "game_id", "left").withColumn("game_type", F.coalesce("__late", "game_type")).drop("__late")


def roster_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Players of the table 'Active Roster': team name (title without the record), name, index_player_id, position (T, C and G as OL) and overall.

    Columns are found by the first row that names Pos; rows without a name are left out.
    """
    title = F.nullif(_text(F.regexp_extract(html, r"([^<>]+?) \(\d+-\d+(?:-\d+)?\)", 1)), F.lit(""))
    named = pages.select(F.struct(F.col(key).alias("key"), title.alias("team_name")).alias("page"), titled_table(F.col(html), "Active Roster").alias("roster"))
    rows = table_rows(named, "page", "roster")
    rows = rows.withColumn("cells", F.transform(_all(F.col("row"), r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), _text))
    header = F.when(F.array_contains("cells", "Pos"), F.col("cells"))
    rows = rows.withColumn("header", F.last(header, ignorenulls=True).over(Window.partitionBy("page").orderBy("pos"))).where(F.col("header").isNotNull() & ~F.array_contains("cells", "Pos"))
    at = lambda label: F.get("cells", (F.array_position("header", F.lit(label)) - 1).cast("int"))
    position = F.when(at("Pos").isin("T", "C", "G"), "OL").otherwise(at("Pos"))
    found = F.nullif(F.regexp_extract("row", r"""href=["'][^"']*[?&;]id=(\d+)""", 1), F.lit("")).try_cast("long")
    rows = rows.select(F.col("page.key").alias(key), "page.team_name", at("Player").alias("name"), found.alias("index_player_id"), position.alias("position"), at("Ovr").try_cast("int").alias("overall"))
    return rows.where("name <> ''")


def team_stats(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Two rows a page with a table 'Team Stats': side, comp and att (from 'Comp/Att'), passing, rushing and rushes; null where a label is missing."""
    rows = table_rows(pages.select(key, titled_table(F.col(html), "Team Stats").alias("stats")), key, "stats")
    rows = rows.select(key, F.transform(_all(F.col("row"), r"(?s)<td[^>]*>(.*?)</td>"), _text).alias("cells")).where(F.size("cells") >= 3)
    side = lambda n, name: F.struct(F.lit(name).alias("side"), F.get("cells", F.lit(n)).alias("value"))
    rows = rows.select(key, F.get("cells", F.lit(0)).alias("label"), F.inline(F.array(side(1, "away"), side(2, "home"))))
    number = lambda label, part: F.max(F.when(F.col("label") == label, F.get(F.split("value", "/"), F.lit(part)).try_cast("int")))
    return rows.groupBy(key, "side").agg(number("Comp/Att", 0).alias("comp"), number("Comp/Att", 1).alias("att"), *(number(v, 0).alias(k) for k, v in BOX_LABELS.items()))
