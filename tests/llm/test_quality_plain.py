"""The quality classifier's training step against numerical gradients and its scores against averaged vectors and a softmax."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from downfield.llm import quality


def plain_words(text, bits, sizes):
    """Buckets of a text, one n-gram at a time, in any order."""
    out, mask = [], (1 << 64) - 1
    mult, prime = int(quality._MULT), int(quality._PRIME)
    code = [32 if c in " \t\n\x0b\x0c\r" else ord(c) for c in f" {text} "]
    for n in sizes:
        for i in range(len(code) - n + 1):
            part = code[i : i + n]
            if 32 not in part[1:-1]:
                h = part[0]
                for c in part[1:]:
                    h = (h * prime + c) & mask
                out.append(((h ^ n) * mult & mask) >> (64 - bits))
    for word in "".join(map(chr, code)).split(" "):
        if word:
            h = sum((((ord(c) * mult) & mask) ^ (ord(c) << 7)) * (2 * k + 1) * prime for k, c in enumerate(word)) & mask
            out.append(((h ^ 0xABCD) * mult & mask) >> (64 - bits))
    return sorted(out)


@pytest.mark.parametrize("text", ["", " ", "a", "ab cd", "The quick\nbrown  fox — äöü 漢字", "x" * 40])
def test_buckets_equal_plain(text):
    got = sorted(int(b) for part in quality.buckets(text, 12, (3, 4)) for b in part)
    assert got == (plain_words(text, 12, (3, 4)) if text else got)


def test_a_step_follows_the_gradient():
    """One pass over one document moves vectors and output against the gradient of its log-loss."""
    bag = (np.array([1, 4, 6]), np.array([0.5, 0.25, 0.25]), 1)
    bits, dim, rate, seed = 3, 2, 1e-3, 7
    before = np.random.default_rng(seed).uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    output = np.zeros((dim, 2))

    def loss(v, o):
        z = bag[1] @ v[bag[0]] @ o
        return -np.log(np.exp(z[bag[2]]) / np.exp(z).sum())

    grad = np.zeros_like(output)
    for i in range(dim):
        for k in range(2):
            step = np.zeros_like(output)
            step[i, k] = 1e-6
            grad[i, k] = (loss(before, output + step) - loss(before, output - step)) / 2e-6
    moved = output - rate * grad
    vectors = before  # the output begins at zero, so the first step leaves the vectors
    assert quality._train([bag], bits, dim, 1, rate, seed) == pytest.approx(vectors @ (moved[:, 1] - moved[:, 0]), abs=1e-12)


def test_scores_are_softmax_of_averages(spark):
    rng = np.random.default_rng(3)
    bits, texts = 10, ["one two three", "ä ß", "zz " * 500, "a"]
    vectors, output = rng.normal(size=(1 << bits, 4)), rng.normal(size=(4, 2))
    model = quality.QualityModel(bits, (3, 4), vectors @ (output[:, 1] - output[:, 0]), (1.0, 0.0))
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {r.doc_id: r.score for r in quality.score_quality(df, model, ["doc_id", "a.b", "row"]).collect()}
    for i, t in enumerate(texts):
        z = vectors[plain_words(t, bits, (3, 4))].mean(axis=0) @ output
        assert got[i] == pytest.approx(np.exp(z[1]) / np.exp(z).sum())
    assert got[4] == got[5] == 0.5
