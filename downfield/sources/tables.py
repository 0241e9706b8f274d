"""Season tables on files: nested game files, partitions by season, reloads, refreshes, upserts and exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAY = "id INT, s STRING, c STRING, t STRING, o STRING, m STRING, css STRING"
QUARTERS = ("Q1", "Q2", "Q3", "Q4", "OT")
GAME = "id LONG, " + ", ".join(f"{q} ARRAY<STRUCT<{PLAY}>>" for q in QUARTERS)
#: Box-score files: the id and five numbers a side (fixed values), as numbers or text.
BOX = ("Passing", "Comp", "Att", "Rushing", "Rushes")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='downfield-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: what several steps read is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_games(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Files of games: a JSON array each, or with multi_line=False one game a line, which can be split."""
    return spark.read.schema(GAME).option("multiLine", multi_line).json(path)


def flatten_games(games: DataFrame) -> DataFrame:
    """One row a play: game_id, play_index over the whole game, quarter (overtime 5) and the fields of the play."""
    tagged = lambda q, n: F.transform(F.coalesce(F.col(q), F.array().cast(f"array<struct<{PLAY.replace(' ', ':').replace(',:', ',')}>>")), lambda p: F.struct(F.lit(n).alias("quarter"), p.alias("p")))
    rows = games.select(F.col("id").alias("game_id"), F.posexplode(F.concat(*(tagged(q, n + 1) for n, q in enumerate(QUARTERS)))).alias("play_index", "row"))
    return rows.select("game_id", "play_index", "row.quarter", F.col("row.p.id").alias("possession_team_id"), *(F.col(f"row.p.{c}").alias(c) for c in ("s", "c", "t", "o", "m", "css")))


def nest_games(plays: DataFrame) -> DataFrame:
    """The reverse of flatten_games(): one row a game, as the game files hold it."""
    play = F.struct("play_index", F.col("possession_team_id").cast("int").alias("id"), "s", "c", "t", "o", "m", "css")
    of = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("quarter") == n, play))), lambda p: p.dropFields("play_index"))
    return plays.groupBy(F.col("game_id").alias("id")).agg(*(of(n + 1).alias(q) for n, q in enumerate(QUARTERS)))


def read_box_scores(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Two rows a game: game_id, side and the five statistics as numbers; what is no number becomes null."""
    schema = "id LONG, " + ", ".join(f"{s}{b} STRING" for s in "ah" for b in BOX)
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    side = lambda s, name: F.struct(F.lit(name).alias("side"), *(F.col(f"{s}{b}").try_cast("int").alias(b.lower()) for b in BOX))
    return rows.select(F.col("id").alias("game_id"), F.inline(F.array(side("a", "away"), side("h", "home"))))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` by partitions; those that it holds are replaced, others stay. Rows of a partition may spread over several tasks."""
    df.hint("rebalance", *by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def read_seasons(spark: SparkSession, path: str, seasons: list[int] | None = None, league: str | None = None, preseason: bool = True) -> DataFrame:
    """A season table; only the partitions asked for are listed."""
    df = spark.read.parquet(path)
    df = df.where(F.col("season").isin(seasons)) if seasons is not None else df
    df = df.where(F.col("league") == league) if league else df
    return df if preseason else df.where("game_type <> 'preseason'")


def repeated_plays(plays: DataFrame) -> DataFrame:
    """(game_id, play_index, n) of the keys that more than one row has; a sound table has none."""
    return plays.groupBy("game_id", "play_index").agg(F.count("*").alias("n")).where("n > 1")


def season_list(season: int | None = None, season_range: str | None = None) -> list[int]:
    """The seasons of one number or of 'first-last'; exactly one of both must be given."""
    if (season is None) == (season_range is None):
        raise ValueError("give a season or a range of seasons")
    if season is not None:
        return [season]
    first, dash, last = season_range.partition("-")
    if not (dash and first.isdigit() and last.isdigit()):
        raise ValueError(f"{season_range}: a range is first-last, as in 50-59")
    return list(range(int(first), int(last) + 1))


def export(df: DataFrame, path: str) -> None:
    """CSV with a header or Parquet, by the suffix of ``path``."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"{path}: the suffix must be .csv or .parquet")


def bucket(game_id: Column) -> Column:
    """File bucket 1 to 10 of a game; a refresh rereads whole buckets."""
    return F.pmod(game_id, F.lit(10)) + 1


def upsert(old: DataFrame, new: DataFrame, *key: str, widen: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """``new`` rows replace ``old`` rows of equal key. Columns of ``widen`` (first_…, last_…) take the smallest or largest of both.

    With ``only``, just these columns of an existing row are replaced. Of equal keys on the same
    side the row with the largest values wins.
    """
    cols = [c for c in old.columns if c not in key]
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    best = F.max(F.struct("__v", *cols)).alias("__row")
    kept = F.max(F.when(F.col("__v") == 0, F.struct(*cols))).alias("__old")
    bounds = [(F.min if c.startswith("first") else F.max)(c).alias(f"__{c}") for c in widen]
    rows = both.groupBy(*key).agg(best, kept, *bounds)

    def value(c: str) -> Column:
        if c in widen:
            return F.col(f"__{c}").alias(c)
        if only is not None and c not in only:
            return F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(f"__row.{c}")).alias(c)
        return F.col(f"__row.{c}").alias(c)

    return rows.select(*key, *map(value, cols)).select(old.columns)


def fill_game_type(df: DataFrame, types: DataFrame, default: str = "regular") -> DataFrame:
    """Sets game_type from (game_id, game_type) where the table has none; ``default`` for games that are not listed."""
    has = F.col("game_type") if "game_type" in df.columns else F.lit(None).cast("string")
    found = types.groupBy("game_id").agg(F.max("game_type").alias("__type"))
    return df.join(found, "game_id", "left").withColumn("game_type", F.coalesce(has, "__type", F.lit(default))).drop("__type")
