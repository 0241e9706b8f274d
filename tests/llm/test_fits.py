"""Fits that use every labelled row."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from downfield.llm import common, toxicity


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word that only toxic rows of the largest id hashes use, past the first 2,000, is known."""
    df = spark.range(2400).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("n"))
    rows = df.select("doc_id", "toxic", F.when(F.col("n") > 2000, "you zork").otherwise("you goose").alias("text"))
    rows = rows.unionByName(spark.range(10_000, 16_500).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"), F.lit("you there").alias("text")))
    model = toxicity.fit_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True))
    assert model.of_words([b"zork"])[0] > 5 and model.weights


def test_logistic_fit_of_rows_equals_that_of_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    y = (x @ [1.5, -2.0] + rng.normal(size=500) > 0.5).astype(float)
    rows = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], "a double, b double, y int")
    assert np.allclose(common.fit_logistic_rows(rows, ["a", "b"], "y"), common.fit_logistic(x, y, np.ones(500)), atol=1e-8)
