"""Target-distribution importance resampling: array-scored weights and a distributed quickselect.

Texts are bags of hashed features, runs of 1 to ``runs`` words. One pass over all documents
counts the features of every bucket, a task at a time; the tasks' counts are summed by an
aggregate. The logarithms of the target's smoothed shares over the documents' make one array
of gains, as long as there are buckets; a second pass sums the gains of each document's
features, and a Gumbel value of a hash of its id is added to draw without replacement.

The k highest are found without a sort of all rows: each round draws random pivot keys
within the range that is left and counts exactly what lies below, at and above each, which
leaves the range between two pivots that holds the k-th key. Keys are composite (score,
id, size, text hash, place) and so unique. Only what is drawn is sorted, by range, and
ranked by the sizes of the sorted files before.

Null and empty texts have no feature and weight 0. A null id hashes as an empty one and
comes after all others of its score. Of repeated rows each is a row of its own and
counts for itself. An empty table gives no row, an empty target a share of 1 a bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import scratch, written

#: Bytes between words become spaces, A-Z lower case; bytes from 128 on belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: What makes a key: descending score as its negative, then the rest ascending.
_KEY = ("down", "nameless", "ident", "n_features", "tie", "file", "row")


class _Buckets(dict):
    """Bucket of each feature; forgets all when it holds ``most``."""

    def __init__(self, buckets: int, most: int = 500_000) -> None:
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.buckets
        return b


def bucket_list(text: bytes, of: _Buckets, runs: int = 1) -> tuple[np.ndarray, int]:
    """Buckets of all features of a UTF-8 text, repeats included, and its number of words."""
    words = text.translate(_FOLD).split()
    found, many = list(map(of.__getitem__, words)), len(words)
    for n in range(2, runs + 1):
        found += [of[b" ".join(words[i : i + n])] for i in range(many - n + 1)]
    return np.array(found, np.int64), many


def _bodies(df: DataFrame, *keep: Column | str) -> DataFrame:
    return df.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("text_"))


def bucket_counts(texts: DataFrame, buckets: int, runs: int = 1) -> np.ndarray:
    """Number of features of all texts in each bucket; what comes to the driver is one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, count = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("text_"):
                count += np.bincount(bucket_list(x.as_py(), of, runs)[0], minlength=buckets)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _bodies(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Scaled logarithm, rounded down, of the target's smoothed share over the source's, of each bucket."""
    n, whole_s, whole_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (whole_s + n) / ((s + 1.0) * (whole_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(h: int, scale: int = 1000) -> int:
    """Scaled Gumbel value, rounded down, of 32 hashed bits."""
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def with_scores(docs: DataFrame, gain: np.ndarray, runs: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, tie) of each row; tie is a hash of the text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = _bodies(docs, F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(len(gain))
        for b in batches:
            found = [bucket_list(x.as_py(), of, runs) for x in b.column("text_")]
            weight = np.array([int(gain[f].sum()) for f, _ in found], np.int64)
            score = weight + np.array([gumbel(x) for x in b.column("h").to_pylist()], np.int64)
            cols = [b.column("doc_id"), pa.array([len(f) for f, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(weight), pa.array(score), b.column("tie")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_features", "n_words", "weight", "score", "tie"])

    return rows.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long, tie long")


def _key() -> Column:
    return F.struct(*_KEY)


def _literal(key: tuple[int, ...]) -> Column:
    return F.struct(*(F.lit(int(x)).cast("long").alias(c) for x, c in zip(key, _KEY, strict=True)))


def kth_key(keyed: DataFrame, k: int, pivots: int = 8, rounds: int = 200) -> tuple[int, ...]:
    """The k-th smallest key (from 1) of the columns _KEY, which no two rows share.

    A round is one aggregate over the rows left: for each part between the pivots of the round
    before, its number of rows and random keys of it, those of the smallest seeded hashes.
    """
    low = high = None  # the k-th key lies strictly between
    cuts: list[tuple[int, ...]] = []
    for turn in range(rounds):
        left = keyed.where(_key() > _literal(low)) if low else keyed
        left = left.where(_key() < _literal(high)) if high else left
        at_or_below = sum((F.when(_key() > _literal(c), 2).when(_key() == _literal(c), 1).otherwise(0) for c in cuts), F.lit(0))
        drawn = F.array(*(F.min_by(_key(), F.xxhash64(F.lit(turn * pivots + i), *_KEY)) for i in range(pivots)))
        parts = {r.part: r for r in left.groupBy(at_or_below.alias("part")).agg(F.count("*").alias("n"), drawn.alias("drawn")).collect()}
        part = 0
        while part not in parts or parts[part].n < k:  # even parts lie between pivots, odd ones are pivots
            k -= parts[part].n if part in parts else 0
            part += 1
        if part % 2:
            return cuts[part // 2]
        low = cuts[part // 2 - 1] if part else low
        high = cuts[part // 2] if part // 2 < len(cuts) else high
        cuts = sorted({tuple(x) for x in parts[part].drawn})
        if parts[part].n == 1:
            return cuts[0]
    raise RuntimeError(f"the k-th key is not found after {rounds} rounds")


def ranked(rows: DataFrame, name: str = "drawn") -> DataFrame:
    """rows and rank, their place (from 1) in order of the key: files sorted by range, a file's first rank from the sizes of those before it."""
    path = scratch(rows.sparkSession, name)
    rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).write.parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    sizes = stored.groupBy("at_file").agg(F.min(_key()).alias("first"), F.count("*").alias("held"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = sizes.select("at_file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    return stored.join(F.broadcast(starts), "at_file").withColumn("rank", F.col("start") + F.col("at_row") + 1).drop("at_file", "at_row", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, runs: int = 1, seed: int = 2024, pivots: int = 8) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; rank is null where the row is not drawn.

    Draws percent of the rows with least_words words or more, rounded down.
    """
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    scored = written(with_scores(docs, gain, runs, seed), "scored")
    places = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    keyed = scored.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("nameless"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("ident"), *places)
    able = F.col("n_words") >= least_words
    k = scored.where(able).count() * percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, none)
    drawn = able & (_key() <= _literal(kth_key(keyed.where(able), k, pivots)))
    return keyed.where(~drawn).select(*out, none).unionByName(ranked(keyed.where(drawn)).select(*out, "rank"))
