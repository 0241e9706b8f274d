"""What several operators of this folder share: the shared folder, written tables, word patterns and a small logistic fit."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters that part words: [^\x20\x09-\x0D]+ is a word.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset and Spark runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='downfield-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: The paths that scratch() has given within the innermost block of cleared().
_GIVEN: ContextVar[list[str] | None] = ContextVar("_GIVEN", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/downfield/{name}-{uuid.uuid4().hex}"
    if (given := _GIVEN.get()) is not None:
        given.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to new paths of the shared folder within it: what is still needed is to be written to a path given before."""
    paths: list[str] = []
    outer = _GIVEN.set(paths)
    try:
        yield
    finally:
        _GIVEN.reset(outer)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder (a new path, or the given one) and read again: work is done once and lineage ends here."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a batch of rows holds at most, on its way to Python and when Parquet is read. Spark's own are 64 MB or 10,000 rows, and 4,096 rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches are small, for rows that carry whole texts: a worker holds a batch several times over. What the session's user has set stays."""
    for name, most in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_skewed(rows: DataFrame, unique: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with unique, which has one row a key and in count the number of rows that have it.

    Keys with more than a thousandth of all rows are fewer than 1,000: they are broadcast, so that their
    rows stay where they are; of the others none fills a task. total: the sum of count, if known.
    """
    if total is None:
        total = unique.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = F.col(count) * 1000 > int(total)
    hot, rest = F.broadcast(unique.where(often).drop(count)), unique.where(~often).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def possible(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """The rows whose key, a hash, may be one of wanted: all that are, and others by chance, so an exact join follows and shuffles fewer rows.

    A map of 2 ** bits bits is broadcast, 4 MB at most whatever the rows; n keys let about n / 2 ** bits of the others through.
    """
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    group, place = F.shiftright(slot, 15).alias("map_group"), slot.bitwiseAND(F.lit((1 << 15) - 1))
    maps = wanted.select(group, place.alias("place")).groupBy("map_group").agg(F.bitmap_construct_agg("place").alias("map_bits"))
    byte = F.conv(F.hex(F.substring("map_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("map_group", group).join(F.broadcast(maps), "map_group")
    return found.where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("map_group", "map_bits")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """crc32 of the id as text, modulo parts, is rest; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: tuple[int, int], sample_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text, label, fold) of at most per_class[c] labelled rows of each class c, those of the smallest id hash, while their texts hold sample_bytes at most.

    Bounded by per_class, so its ids are broadcast; the texts stay on the executors, whole. Of rows
    of one id the smallest text counts. fold 0 of 5 is for calibration.
    """
    ranked = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ranked = ranked.withColumn("order", F.xxhash64("doc_id"))
    picked = [ranked.where(F.col("label") == c).orderBy("order", "doc_id").limit(per_class[c]) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.first("order").alias("order"), F.min("text").alias("text")), "sample")
    before = Window.partitionBy("label").orderBy("order", "doc_id")  # a class's rows are bounded
    fits = rows.select("doc_id", "label", "order", F.sum(F.octet_length("text")).over(before).alias("held")).where(F.col("held") <= sample_bytes)
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "text", "label", F.pmod("order", F.lit(5)).cast("int").alias("fold"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, text, label, fold) of every labelled id for which usable holds and that docs have.

    Of rows of one id the smallest text counts, of its labels the largest. fold 0 of 5 is for calibration.
    """
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int"))


def class_totals(labels: DataFrame, label: str, usable: Column) -> tuple[int, int]:
    """Labelled rows of class 0 and of class 1."""
    row = labels.where(usable).agg(*(F.count(F.when(F.col(label) == c, 1)) for c in (0, 1))).first()
    return int(row[0]), int(row[1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_logistic_rows(rows: DataFrame, x: list[str], y: str, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """What fit_logistic gives with all weights 1, of rows that stay on the executors: each round takes one row of sums."""
    n = len(x) + 1
    columns = [*map(F.col, x), F.lit(1.0)]
    beta = np.zeros(n)
    keep = ridge * np.eye(n)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    for _ in range(rounds):
        at = sum((columns[i] * float(beta[i]) for i in range(1, n)), columns[0] * float(beta[0]))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))
        given = rows.select(*columns[:-1], p.alias("p"), F.col(y).alias("y"))
        slope = [F.sum(c * (F.col("y") - F.col("p"))) for c in columns]
        bend = [F.sum(columns[i] * columns[j] * F.col("p") * (1 - F.col("p"))) for i, j in upper]
        sums = np.array(given.agg(*(c.alias(f"s{k}") for k, c in enumerate(slope + bend))).first(), float)
        curve = np.zeros((n, n))
        for (i, j), v in zip(upper, sums[n:], strict=True):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + keep, sums[:n] - keep @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def whole_row(df: DataFrame, *columns: str) -> Column:
    """One struct of the columns, or of all: operators carry it beside columns of their own, whatever names it holds."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in columns or df.columns))


def scored_rows(df: DataFrame, make: Callable[[], Callable[[list], np.ndarray]], keep: list[str], text: str = "text") -> DataFrame:
    """(row, score): the columns keep of df as one struct, and a double made from the text column, batch by batch on the executors.

    make() builds the scoring function once per task.
    """
    given = df.select(whole_row(df, *keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score(b.column("body").to_pylist()), pa.float64())], names=["row", "score"])

    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())]))
