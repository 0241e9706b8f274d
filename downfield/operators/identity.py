"""Players from the names in plays: mentions, keys, ids, aliases, duplicates, merges and rosters.

All of it is joins and groupings on names; the outcome does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from downfield.functions.names import initial_last, last_first, normalized, roster_key
from downfield.sources.refresh import key_part, read_dimension, upsert_dimension
from downfield.sources.tables import write_partitions, written

OFFENSE, DEFENSE, TEAMLESS = ("passer", "rusher", "receiver", "kicker"), ("tackler", "sacker", "interceptor", "returner"), ("fumbler", "fumble_recoverer")


def mentions(plays: DataFrame, prefix: str = "") -> DataFrame:
    """One row a name in a play: offense roles with the side in possession, defense roles and returners with the other, fumble roles with none.

    Roles without a column ``prefix + role`` are left out.
    """
    team = lambda r: F.col("possession_team") if r in OFFENSE else F.col("defense_team") if r in DEFENSE else F.lit(None).cast("string")
    roles = [F.struct(F.lit(r).alias("role"), F.col(prefix + r).alias("name"), team(r).alias("team")) for r in OFFENSE + DEFENSE + TEAMLESS if prefix + r in plays.columns]
    return plays.select("season", "game_id", "play_index", F.inline(F.filter(F.array(*roles), lambda x: x["name"].isNotNull())))


def ambiguous_names(roster: DataFrame) -> DataFrame:
    """Keys that belong to more than one roster id: such names are one player a team."""
    return roster.groupBy(normalized(F.col("name")).alias("norm")).agg(F.count_distinct("index_player_id").alias("n")).where("n > 1").select("norm")


def with_player_key(rows: DataFrame, overrides: DataFrame | None = None, roster: DataFrame | None = None, apart: DataFrame | None = None, known: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Adds player_key to rows with name and team.

    The key is the normalized name after ``overrides`` (name, canonical), with the team for
    ambiguous names of ``roster``. A 'First Last' name not in ``apart`` (name) takes the key
    of the 'Last, F.' name that is found first: all words but the first in the same team, the
    last word in the same team, itself in ``known`` (player_key), then both again in any
    team. ``stored`` (name, team, player_key) are keys given before: their 'Last, F.' names are found, too. Work on names is done once a distinct name and team, and written; what is left is
    one join of the rows with these keys.
    """
    names = rows.select("name", "team").distinct()
    if overrides is not None:
        fixed = overrides.select(normalized(F.col("name")).alias("__n"), "canonical").groupBy("__n").agg(F.min("canonical").alias("canonical"))
        names = names.withColumn("__n", normalized(F.col("name"))).join(fixed, "__n", "left").withColumn("shown", F.coalesce("canonical", "name")).drop("__n", "canonical")
    else:
        names = names.withColumn("shown", F.col("name"))
    names = names.withColumn("norm", normalized(F.col("shown")))
    own = F.col("norm")
    if roster is not None:
        names = names.join(ambiguous_names(roster).withColumn("__amb", F.lit(True)), "norm", "left")
        own = F.when(F.col("__amb") & F.col("team").isNotNull(), F.concat_ws("|", "norm", "team")).otherwise(F.col("norm"))
    names = names.withColumn("own", own).withColumn("long", last_first(F.col("shown"))).withColumn("short", initial_last(F.col("shown")))
    if apart is not None:
        names = names.join(apart.select(F.col("name"), F.lit(True).alias("__apart")).distinct(), "name", "left")
        names = names.withColumns({c: F.when(F.col("__apart").isNull(), F.col(c)) for c in ("long", "short")})
    names = written(names, "names")  # a row a distinct name and team
    comma = names.where(F.col("shown").contains(",")).select("norm", "team", "own")
    if stored is not None:
        comma = comma.unionByName(stored.where(F.col("name").contains(",")).select(normalized(F.col("name")).alias("norm"), "team", F.col("player_key").alias("own")))
    # Teams of a name are few: its keys go by team in one map.
    of_team = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("team").isNotNull(), F.struct("team", "own")))))
    comma = comma.groupBy("norm", "team").agg(F.min("own").alias("own")).groupBy("norm").agg(of_team.alias("by_team"), F.min("own").alias("any"))
    for c in ("long", "short"):
        found = comma.withColumnsRenamed({"norm": c, "by_team": f"by_team_{c}", "any": f"any_{c}"})
        names = names.join(found, c, "left").withColumn(f"team_{c}", F.try_element_at(f"by_team_{c}", F.coalesce("team", F.lit("")))).drop(f"by_team_{c}")
    names = names.withColumn("__known", F.lit(None).cast("string")) if known is None else names.join(known.select(F.col("player_key").alias("own"), F.col("player_key").alias("__known")).distinct(), "own", "left")
    keys = names.select(F.col("name").alias("__name"), F.col("team").alias("__team"), F.coalesce("team_long", "team_short", "__known", "any_long", "any_short", "own").alias("player_key"))
    keys = written(keys, "name-keys")
    return rows.join(keys, F.col("name").eqNullSafe(F.col("__name")) & F.col("team").eqNullSafe(F.col("__team"))).drop("__name", "__team")


def with_defensive_keys(keyed: DataFrame, aliases: DataFrame, roles: tuple[str, ...] = ("tackler", "sacker", "interceptor", "fumble_recoverer")) -> DataFrame:
    """Gives defenders named in ``aliases`` (name, canonical) the key of the canonical name, if a player has it; other roles keep theirs."""
    known = keyed.select(F.col("player_key").alias("__key")).distinct()
    fixed = aliases.select(normalized(F.col("name")).alias("__norm"), normalized(F.col("canonical")).alias("__key")).join(known, "__key", "left_semi").groupBy("__norm").agg(F.min("__key").alias("__key"))
    rows = keyed.withColumn("__norm", F.when(F.col("role").isin(*roles), normalized(F.col("name")))).join(fixed, "__norm", "left")
    return rows.withColumn("player_key", F.coalesce("__key", "player_key")).select(keyed.columns)


def players(keyed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a key: player_id, name (of the first mention), first and last season, number of mentions.

    Ids of ``known`` (player_key, player_id) stay; new ones follow its largest in the order of the
    first mention (season, game, play, role, key). Numbers are running sums over games, then
    seasons, so that no task holds all players. The mentions are grouped once and written.
    """
    first = F.struct("season", "game_id", "play_index", "role")
    rows = keyed.groupBy("player_key").agg(F.min(first).alias("first"), F.min_by("name", F.struct(first, "name")).alias("name"), F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("mentions"))
    if known is None:
        rows = rows.withColumn("player_id", F.lit(None).cast("long"))
    else:
        rows = rows.join(known.select("player_key", "player_id"), "player_key", "left")
    rows = written(rows, "players")
    place = [F.col("first.season").alias("__s"), F.col("first.game_id").alias("__g")]
    new = rows.where("player_id is null").select("player_key", "first", *place)
    games = new.groupBy("__s", "__g").agg(F.count("*").alias("n"))
    seasons = games.groupBy("__s").agg(F.sum("n").alias("n"))
    if known is not None:
        # The largest id counts as the first entry of the running sum.
        seasons = seasons.unionByName(known.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("n")).select(F.lit(None).cast("long").alias("__s"), "n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a season: small without a partition.
    seasons = seasons.select("__s", before(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("__s"))).alias("__a"))
    games = games.select("__s", "__g", before(Window.partitionBy("__s").orderBy("__g")).alias("__b"))
    number = F.row_number().over(Window.partitionBy("__s", "__g").orderBy("first", "player_key"))
    new = new.withColumn("__c", number).join(games, ["__s", "__g"]).join(seasons, "__s")
    new = new.select("player_key", (F.col("__a") + F.col("__b") + F.col("__c")).alias("__new"))
    out = rows.join(new, "player_key", "left").withColumn("player_id", F.coalesce("player_id", "__new").cast("long"))
    return written(out.select("player_id", "player_key", "name", "first_season", "last_season", "mentions"), "player-ids")


def name_keys(keyed: DataFrame) -> DataFrame:
    """(name, team, player_key) of each distinct name and team, to be stored: later builds resolve only what it lacks."""
    return keyed.select("name", "team", "player_key").distinct()


def extend_keys(rows: DataFrame, stored: DataFrame, **options: DataFrame) -> DataFrame:
    """Adds player_key to rows: the stored one of the name and team, else as with_player_key() finds it among the new names and the stored ones."""
    found = stored.select(F.col("name").alias("__name"), F.col("team").alias("__team"), "player_key")
    same = F.col("name").eqNullSafe(F.col("__name")) & F.col("team").eqNullSafe(F.col("__team"))
    old = rows.join(found, same).drop("__name", "__team")
    new = with_player_key(rows.join(found, same, "left_anti"), known=stored.select("player_key").distinct(), stored=stored, **options)
    return old.unionByName(new.select(old.columns))


def extend_players(spark: SparkSession, path: str, keyed: DataFrame) -> list[int]:
    """Takes later mentions into the stored players (a dimension by player_key): ids stay, those of new keys follow the largest, seasons widen, mentions add up.

    Of the table only the partitions that hold the keys are read and written; these are returned. keyed must not hold mentions that are in it.
    """
    known = read_dimension(spark, path)
    top = known.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("player_id")).select(F.lit(None).cast("string").alias("player_key"), "player_id")
    met = known.join(keyed.select("player_key").distinct(), "player_key", "left_semi")
    now = players(keyed, met.select("player_key", "player_id").unionByName(top))
    was = met.select("player_key", F.col("name").alias("__name"), F.col("mentions").alias("__mentions"))
    merged = now.join(was, "player_key", "left").withColumns({"name": F.coalesce("__name", "name"), "mentions": F.col("mentions") + F.coalesce("__mentions", F.lit(0))})
    return upsert_dimension(spark, path, merged.select(known.columns), "player_key", widen=("first_season", "last_season"))


def split_by_roster(keyed: DataFrame, roster: DataFrame) -> DataFrame:
    """Keys of names that several roster ids share become one key a player, by the evidence of team and season.

    roster: index_player_id, name, team, first_season and last_season of each stay. A mention takes the id that has its name,
    team and season, so a player who changes teams stays one; where several have, or none, the key is that of the team, and
    without a team the name's. Other names keep their keys.
    """
    named = roster.withColumn("norm", normalized(F.col("name")))
    shared = ambiguous_names(roster)
    stays = named.join(shared, "norm", "left_semi").select("norm", "team", "index_player_id", "first_season", "last_season").distinct()
    rows = keyed.withColumn("norm", normalized(F.col("name")))
    asked = rows.join(shared, "norm", "left_semi").select("norm", "team", "season").distinct()  # evidence is joined once a name, team and season
    s, a = stays.alias("s"), asked.alias("a")
    met = a.join(s, (F.col("a.norm") == F.col("s.norm")) & (F.col("a.team") == F.col("s.team")) & F.col("a.season").between(F.col("s.first_season"), F.col("s.last_season")), "left")
    told = met.groupBy("a.norm", "a.team", "a.season").agg(F.count_distinct("s.index_player_id").alias("n"), F.min("s.index_player_id").alias("id"))
    key = F.when(F.col("n") == 1, F.concat_ws("|", "norm", F.concat(F.lit("#"), F.col("id").cast("string")))).when(F.col("team").isNotNull(), F.concat_ws("|", "norm", "team")).otherwise(F.col("norm"))
    told = told.select(F.col("norm").alias("__norm"), F.col("team").alias("__team"), F.col("season").alias("__season"), key.alias("__key"))
    both = (F.col("norm") == F.col("__norm")) & F.col("team").eqNullSafe(F.col("__team")) & (F.col("season") == F.col("__season"))
    return rows.join(told, both, "left").withColumn("player_key", F.coalesce("__key", "player_key")).select(keyed.columns)


def attach_ids(plays: DataFrame, keyed: DataFrame, dimension: DataFrame, roles: tuple[str, ...] = OFFENSE + DEFENSE + ("fumble_recoverer",)) -> DataFrame:
    """Adds <role>_id to plays for the names of their roles; from with_player_key() and players(). A role without a name has no id."""
    ids = keyed.select("game_id", "play_index", "role", "player_key").join(dimension.select("player_key", "player_id"), "player_key")
    wide = ids.groupBy("game_id", "play_index").agg(*(F.max(F.when(F.col("role") == r, F.col("player_id"))).alias(f"{r}_id") for r in roles))
    return plays.join(wide, ["game_id", "play_index"], "left")


def aliases(keyed: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct (player_id, name, season, team)."""
    return keyed.select("player_key", "name", "season", "team").distinct().join(dimension.select("player_key", "player_id"), "player_key").select("player_id", "name", "season", "team").distinct()


def duplicates(people: DataFrame) -> DataFrame:
    """Normalized names with several ids: the lowest to keep, the others, and the names; from (player_id, name)."""
    rows = people.groupBy(normalized(F.col("name")).alias("norm")).agg(F.array_sort(F.collect_set("player_id")).alias("ids"), F.array_sort(F.collect_set("name")).alias("names")).where(F.size("ids") >= 2)
    return rows.select("norm", F.get("ids", F.lit(0)).alias("kept"), F.slice("ids", 2, 2**30).alias("removed"), "names")


def followed(merges: DataFrame, steps: int = 40) -> DataFrame:
    """(removed, kept) with chains followed to their ends: an id that is kept in one row and removed in another.

    Each step doubles the length of what is followed; a circle fails.
    """
    links = written(merges.select("removed", "kept").where("removed <> kept").distinct(), "merges")
    for _ in range(steps):
        onward = links.select(F.col("removed").alias("kept"), F.col("kept").alias("__next"))
        if links.join(onward, "kept", "left_semi").isEmpty():
            return links
        links = written(links.join(onward, "kept", "left").select("removed", F.coalesce("__next", "kept").alias("kept")), "merges")
        if not links.where("removed = kept").isEmpty():
            break
    raise ValueError("merges go in a circle")


def moved_rows(df: DataFrame, merges: DataFrame, *key: str) -> DataFrame:
    """Rows of player_id with removed ids replaced by those kept, as aliases and positions move; where the kept id has a row of the same ``key``, its own stays."""
    rows = df.join(merges.select(F.col("removed").alias("player_id"), "kept"), "player_id", "left")
    whole = F.struct(F.col("kept").isNotNull().cast("int").alias("__moved"), F.col("player_id").alias("__was"), *(c for c in df.columns if c not in ("player_id", *key)))
    best = rows.groupBy(F.coalesce("kept", "player_id").alias("player_id"), *key).agg(F.min(whole).alias("__row"))
    return best.select(*(c if c in ("player_id", *key) else F.col(f"__row.{c}").alias(c) for c in df.columns))


def merge_ids(df: DataFrame, merges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Replaces removed ids by those kept in all ``columns``; ``merges``: (removed, kept), one row a removed id; see followed() for chains."""
    order = df.columns
    for c in columns:
        df = df.join(merges.select(F.col("removed").alias(c), F.col("kept").alias("__kept")), c, "left").withColumn(c, F.coalesce("__kept", c)).drop("__kept")
    return df.select(order)


def without_removed(df: DataFrame, merges: DataFrame) -> DataFrame:
    """Aggregates of player_id without those of ids that a merge touches: they are stale and must be made anew."""
    touched = merges.select(F.explode(F.array("removed", "kept")).alias("player_id")).distinct()
    return df.join(touched, "player_id", "left_anti")


def merge_people(people: DataFrame, merges: DataFrame) -> DataFrame:
    """The player dimension after merges: seasons widened, mentions added, names of the kept rows."""
    moved = people.withColumn("__was", F.col("player_id"))
    moved = merge_ids(moved, merges, ("player_id",))
    own = F.col("__was") == F.col("player_id")
    return moved.groupBy("player_id").agg(F.coalesce(F.min(F.when(own, F.col("name"))), F.min("name")).alias("name"), F.min("first_season").alias("first_season"), F.max("last_season").alias("last_season"), F.sum("mentions").alias("mentions"))


def match_roster(roster: DataFrame, people: DataFrame) -> DataFrame:
    """Adds player_id to roster rows by the key with suffixes, else by the relaxed key; of equal keys the largest id is taken, null if none."""
    for n, relaxed in (("exact", False), ("relaxed", True)):
        lookup = people.select(roster_key(F.col("name"), relaxed).alias("__key"), "player_id").where("__key is not null").groupBy("__key").agg(F.max("player_id").alias(f"__{n}"))
        roster = roster.withColumn("__key", roster_key(F.col("name"), relaxed)).join(lookup, "__key", "left").drop("__key")
    return roster.withColumn("player_id", F.coalesce("__exact", "__relaxed")).drop("__exact", "__relaxed")


def roster_teams(roster: DataFrame, play_teams: DataFrame, ids: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Fills team of roster rows (player_id, team, team_id, team_name) and adds matched, whether the row has a player.

    The team of the plays (player_id, team) comes first, so that trades count; then the row's own, that of its
    team id (id, team), and that of its full name in ``names`` (team_name, team). Of several teams the last in
    alphabetical order is taken.
    """
    one = lambda df, key, to: df.where(F.col(key).isNotNull() & F.col("team").isNotNull()).groupBy(key).agg(F.max("team").alias(to))
    rows = roster.join(one(play_teams, "player_id", "__played"), "player_id", "left").join(one(ids.withColumnRenamed("id", "team_id"), "team_id", "__of_id"), "team_id", "left")
    rows = rows.join(one(names, "team_name", "__of_name"), "team_name", "left") if names is not None else rows.withColumn("__of_name", F.lit(None).cast("string"))
    team = F.coalesce("__played", F.nullif("team", F.lit("")), "__of_id", "__of_name")
    return rows.withColumn("team", team).withColumn("matched", F.col("player_id").isNotNull()).select(*roster.columns, "matched")


def search_players(people: DataFrame, names: DataFrame, name: str | None = None, season: int | None = None, limit: int | None = 20) -> DataFrame:
    """Players (player_id, name, first_season, last_season) with an alias of (player_id, name, season) that holds ``name`` in any case, in ``season`` if given.

    Without a name, those who played around ``season``. ``limit`` is the length of the list; the smallest ids come first.
    """
    if name:
        hits = names.where(F.lower("name").contains(name.lower()))
        hits = hits.where(F.col("season") == season) if season is not None else hits
        people = people.join(hits.select("player_id").distinct(), "player_id", "left_semi")
    elif season is not None:
        people = people.where(F.lit(season).between(F.col("first_season"), F.col("last_season")))
    rows = people.select("player_id", "name", "first_season", "last_season").orderBy("player_id")
    return rows.limit(limit) if limit else rows


#: Letters of a gram of the name index.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of GRAM letters of a text in lower case."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - GRAM + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM))))


def write_name_index(names: DataFrame, path: str, parts: int = 64) -> None:
    """Postings of the alias names (player_id, name, season): for each gram the distinct names that hold it, in partitions by hash of the gram."""
    rows = names.select("name").where("name is not null").distinct().select("name", F.explode(grams(F.col("name"))).alias("gram"))
    write_partitions(rows.withColumn("part", key_part(parts, "gram")), path, "part")


def search_index(spark: SparkSession, path: str, people: DataFrame, names: DataFrame, name: str, season: int | None = None, limit: int | None = 20, parts: int = 64) -> DataFrame:
    """search_players() by the name index: names that hold all grams of ``name`` are proposed by the postings, of which only the grams' partitions are read, and then looked at.

    A name shorter than a gram is searched for in all names.
    """
    if len(name) < GRAM:
        return search_players(people, names, name, season, limit)
    low = name.lower()
    asked = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    place = spark.createDataFrame([(g,) for g in asked], "gram string").select(key_part(parts, "gram").alias("part")).distinct()
    hit = sorted(r.part for r in place.collect())
    postings = spark.read.parquet(path).where(F.col("part").isin(*hit) & F.col("gram").isin(*asked))
    proposed = postings.groupBy("name").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked)).select("name")
    return search_players(people, names.join(proposed, "name", "left_semi"), name, season, limit)


def player_profiles(people: DataFrame, names: DataFrame, careers: dict[str, DataFrame], player_id: int | None = None) -> DataFrame:
    """One row a player: the columns of ``people``, aliases in order, and one struct for each of ``careers``, null without games.

    ``careers``: for each kind, one row a player_id of summed game rows. With ``player_id`` only that
    player, who must exist.
    """
    if player_id is not None:
        people = people.where(F.col("player_id") == player_id)
        if people.isEmpty():
            raise ValueError(f"no player {player_id}")
    known = names.groupBy("player_id").agg(F.array_sort(F.collect_set(F.struct("season", "name"))).alias("aliases"))
    out = people.join(known, "player_id", "left")
    for kind, rows in careers.items():
        out = out.join(rows.select("player_id", F.struct(*(c for c in rows.columns if c != "player_id")).alias(kind)), "player_id", "left")
    return out
