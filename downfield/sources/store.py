"""The stored table of plays: a partition a season, buckets by game, rows sorted by game and play.

A bucketed table tells Spark how its rows are dealt, so windows and groups that begin with
game_id need no exchange, and a range of seasons lists only its own files. The table is known to the
session's catalog by a name made from its path; another session opens it by its path.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket over all seasons, at most about; the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8


def store_name(path: str) -> str:
    """Name of a store in the session's catalog."""
    return "downfield_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()[:20]


def _about(path: str) -> str:
    return f"{path.rstrip('/')}.about"


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def write_store(df: DataFrame, path: str, buckets: int, by: tuple[str, ...] = ("season",), key: str = "game_id", order: str = "play_index") -> DataFrame:
    """Writes df as a new store at the path, one exchange by the key, and opens it."""
    spark = df.sparkSession
    about = {"schema": df.schema.jsonValue(), "buckets": buckets, "by": list(by), "key": key, "order": order}
    dealt = df.repartition(buckets, key)  # a bucket is written by one task, a file a partition
    dealt.write.partitionBy(*by).bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(store_name(path))
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(_about(path))
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store; raises an AnalysisException if nothing is at the path."""
    told = spark.read.text(_about(path))
    name = store_name(path)
    if not spark.catalog.tableExists(name):
        about = json.loads(told.first()[0])
        schema = T.StructType.fromJson(about["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{c}`" for c in about["by"])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({by}) CLUSTERED BY (`{about['key']}`) SORTED BY (`{about['key']}`, `{about['order']}`) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def replace_partitions(df: DataFrame, path: str) -> None:
    """The partitions that df holds are replaced by its rows, dealt and sorted as the others; these keep their files."""
    spark = df.sparkSession
    columns = open_store(spark, path).columns
    about = json.loads(spark.read.text(_about(path)).first()[0])
    dealt = df.repartition(about["buckets"], about["key"]).select(columns)
    name, mode = store_name(path), "spark.sql.sources.partitionOverwriteMode"
    given = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        dealt.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, given)
    spark.catalog.refreshTable(name)


def seasons_of(spark: SparkSession, path: str, seasons: list[int]) -> DataFrame:
    """The rows of the seasons; only their partitions are listed."""
    return open_store(spark, path).where(F.col("season").isin(*seasons))
