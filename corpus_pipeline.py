"""A corpus pipeline of five stages; each takes the documents that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.llm import copies, decontam, mixing, tokens, toxicity
from downfield.llm.common import cleared, held_out, scratch, small_batches, table, whole_row, written
from downfield.llm.queries import CUT, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that the toxicity model predicts."""
    small_batches(spark)
    with cleared(spark):
        model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return toxicity.score_rows(docs, model, docs.columns).where(F.col("score") < CUT).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies (5-word shingles, similarity 0.8 or more).

    Rows that are equal in id and text are one document; an id that stays does so with all of its different texts. Of a
    class without an id, one row stays.
    """
    small_batches(spark)
    path = scratch(spark, "near-copies")
    with cleared(spark):
        found = written(copies.near_copies(docs), "near-copies", path)
    least = found.groupBy("component").agg(F.min("doc_id").alias("least"))
    keep = least.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    row = docs.select(whole_row(docs).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    named = row.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"])
    alone = found.join(least.where("least is null"), "component", "left_semi").groupBy("component").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    nameless = row.where("doc_id is null").join(alone, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return named.select("row").unionByName(nameless.select("row")).select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold half of a benchmark item or more."""
    small_batches(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. Documents without a word are never taken."""
    small_batches(spark)
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids to files and returns what reading them back gives."""
    small_batches(spark)
    return tokens.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token-ids", encode_tokens),
]

#: The fit of the first stage and the tokenizer of the last can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
