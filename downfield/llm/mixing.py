"""Mixing sources to target weights along a curriculum, by DataFrame operations only.

Each source's target is its weight's share of the wanted total, capped at a multiple
of its size; what exceeds caps is shared again by weight. A source's weight ramps over
the training time t in [0, 1]: density 1 + g (2 t - 1), whose integral is its demand
D(t) = t + g (t^2 - t). A document whose passes before it amount to a share q of the
target gets the position t with D(t) = q, and documents are range-sorted by position.

The order within a source is that of md5 of the id. Cumulative sizes are taken in two
steps: within (source, md5 prefix) groups, and over the groups' sums; with about the
square root of the rows as prefixes, no window holds a source. A document is taken
whole in each full pass and once more while its middle lies before the rest of the
target.

A null text has size 0; a null source is a source, the last in order; rows without an id
have the order of their text. Size 0 is never taken. Repeated rows are separate rows;
rows of one id follow in order of size and text.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import whole_row, words_of, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: one row a source (source, skey, source_size). Adds place, weight and target.

    The level that the targets fill is the largest of (total less the caps of the
    sources that fill sooner) / (weights of the others); a target is level times
    weight, at most the cap.
    """
    every = Window.partitionBy()
    sooner = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    placed = placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("total", share * F.sum("source_size").over(every))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(sooner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(sooner.rowsBetween(0, Window.unboundedFollowing))
    level = placed.withColumn("level", (F.col("total") - before) / rest)
    filled = level.withColumn("target", F.least(cap * F.col("source_size"), F.max("level").over(every) * F.col("weight")))
    return filled.select("skey", "place", "source_size", "target")


def position(q: Column, g: Column) -> Column:
    """The t with t + g (t^2 - t) = q, for q in [0, 1] and |g| <= 1."""
    b = 1 - g
    return F.when(F.abs(g) < 1e-9, q).otherwise((F.sqrt(b * b + 4 * g * q) - b) / (2 * g))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ramps: tuple[float, ...] = (-0.6, 0.0, 0.6), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions) and the columns keep, one row for each row of docs.

    positions has the place in [0, 1] of each time that the document is taken. Texts are
    read once; what is sorted and joined is narrow, so keep should be, too.
    """
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    nameless = F.concat(F.lit("null "), F.coalesce("text", F.lit("")))
    order = F.md5(F.coalesce(F.col(key).cast("string"), nameless).cast("binary"))
    narrow = docs.select(F.col(key).alias("doc_id"), "source", skey.alias("skey"), F.size(words_of(F.col("text"))).cast("long").alias("size"), order.alias("order"), F.xxhash64("text").alias("tie"), *keep)
    narrow = written(narrow, "sizes")
    by_source = narrow.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    rows = narrow.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) ** 0.5 + 1, 16)))
    narrow = narrow.withColumn("prefix", F.substring("order", 1, digits))
    groups = narrow.groupBy("skey", "prefix").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("skey").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("offset", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    groups = groups.join(source_targets(by_source, weights, share, cap), "skey")
    inner = Window.partitionBy("skey", "prefix").orderBy("order", "size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(groups, ["skey", "prefix"])
    ahead_of = F.col("offset") + F.col("inner")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    placed = placed.withColumn("ahead", ahead_of).withColumn("full", full)
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + F.when(2 * F.col("ahead") + F.col("size") <= 2 * rest, 1).otherwise(0)).cast("int")
    ramp = F.element_at(F.array(*(F.lit(float(g)) for g in ramps)), (F.col("place") % len(ramps) + 1).cast("int"))
    placed = placed.withColumn("times", times)
    share_of = lambda p: F.least((p * F.col("source_size") + F.col("ahead")) / F.col("target"), F.lit(1.0))
    spots = F.transform(F.when(F.col("times") > 0, F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array().cast("array<int>")), lambda p: position(share_of(p), ramp))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), spots.alias("positions"), *keep)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each time that a document is taken, range-sorted by position."""
    return mixed.select("*", F.explode("positions").alias("position")).drop("positions").sort("position", "doc_id")


def numbered(docs: DataFrame) -> DataFrame:
    """(file, row, doc) of each row, doc being all of its columns: file and row are the same whenever the rows are read.

    Rows as read from Parquet files have their file and place; rows from elsewhere are numbered in a written copy.
    """
    doc = whole_row(docs).alias("doc")
    if docs.inputFiles():
        try:
            return docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), doc)
        except AnalysisException:  # files without such places
            pass
    return written(docs.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"), doc), "rows")


def mixed_rows(docs: DataFrame, **options: tuple | float) -> DataFrame:
    """The rows of docs (doc_id, source, text and others), each as often as the mix takes it, range-sorted by position.

    docs: a table as read, or any rows; see numbered(). Only numbers, sizes and sources are
    mixed, and the whole rows join the positions at the end.
    """
    rows = numbered(docs)
    mixed = mix(rows.select("file", "row", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text"))), keep=("file", "row"), **options)
    spots = mixed.where("taken > 0").select("file", "row", "doc_id", F.explode("positions").alias("position"))
    return spots.join(rows, ["file", "row"]).sort("position", "doc_id", "file", "row").select("doc.*")
