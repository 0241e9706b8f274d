"""Changes by partition: files read again, seasons derived anew, rows of dimensions merged, each where it changed and nowhere else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.sources.store import open_store, replace_partitions, write_store
from downfield.sources.tables import bucket, upsert, write_partitions, written

#: File buckets of a season (fixed value).
FILES = 10
#: A derived table: from plays of whole seasons to rows with a season.
Derive = Callable[[DataFrame], DataFrame]


def derived_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def build_season_tables(plays: DataFrame, folder: str, derived: dict[str, Derive], buckets: int) -> None:
    """The store of plays, a partition a season and file bucket, and every derived table, a partition a season, in the folder."""
    stored = write_store(plays.withColumn("file", bucket(F.col("game_id"))), derived_path(folder, "plays"), buckets, by=("season", "file"))
    for name, derive in derived.items():
        write_partitions(derive(stored.drop("file")), derived_path(folder, name), "season")


def refresh_last(source: DataFrame, folder: str, seasons: list[int], derived: dict[str, Derive], last: int = 2) -> None:
    """Reads the last ``last`` of the seasons' file buckets again and derives anew what the seasons hold.

    source: all plays as they are now; of it only those buckets are read. Of the store just their
    partitions are replaced, of the derived tables just the seasons'; all others keep their files.
    """
    spark, path = source.sparkSession, derived_path(folder, "plays")
    rows = source.withColumn("file", bucket(F.col("game_id"))).where(F.col("season").isin(*seasons) & (F.col("file") > FILES - last))
    replace_partitions(rows, path)
    now = open_store(spark, path).where(F.col("season").isin(*seasons)).drop("file")
    for name, derive in derived.items():
        write_partitions(written(derive(now), name), derived_path(folder, name), "season")


def key_part(parts: int, *key: str) -> Column:
    """The partition of a dimension's row: a hash of its key."""
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def write_dimension(df: DataFrame, path: str, *key: str, parts: int = 32) -> None:
    """A dimension as a table with partitions by hash of its key."""
    write_partitions(df.withColumn("part", key_part(parts, *key)), path, "part")


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def upsert_dimension(spark: SparkSession, path: str, new: DataFrame, *key: str, parts: int = 32, widen: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> list[int]:
    """Merges new rows into a stored dimension as upsert() does, reading and writing just the partitions that their keys hit; returns these.

    parts must be that of write_dimension().
    """
    new = written(new.withColumn("part", key_part(parts, *key)), "changes")
    hit = sorted(r.part for r in new.select("part").distinct().collect())  # at most ``parts`` numbers
    old = spark.read.parquet(path).where(F.col("part").isin(*hit)).drop("part")
    merged = upsert(old, new.select(old.columns), *key, widen=widen, only=only)
    write_dimension(written(merged, "merged"), path, *key, parts=parts)
    return hit


