"""Batches of the pipeline's stages are bounded by bytes."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from downfield.llm.common import BATCHES

SMALL = "/root/testdata/sf0.001"


def _long_texts(spark):
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(500)).alias("text"))


def test_batches_of_a_stage_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    s = spark.newSession()
    docs = _long_texts(s)
    assert corpus_pipeline.drop_benchmark(s, docs, SMALL).count() == 3000
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3000
    assert max(r.bytes for r in found) < 3 << 20


def test_a_users_batch_sizes_stay(spark):
    s = spark.newSession()
    mine = dict(zip(BATCHES, ("5m", "333"), strict=True))
    for name, most in mine.items():
        s.conf.set(name, most)
    corpus_pipeline.drop_benchmark(s, _long_texts(s), SMALL)
    assert {name: s.conf.get(name) for name in mine} == mine
