"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of the bytes within words, by the documents that hold an
n-gram. A class discounts its own counts; the mass that this frees, and a prior of
``strength`` documents, goes to one distribution that both classes share: pooled
counts, discounted in turn, then the continuation counts of shorter n-grams (before
how many different bytes do they occur), down to all bytes alike. So both are
distributions, an expression that is rare in both says little, and one that only toxic
texts use says much, even as a stem with an unseen ending. A document's evidence is
the length-normalised log-likelihood difference of the classes: over the whole text,
and over its most toxic windows of a few words (long texts with one insult). A
logistic fit on documents kept out of the counts turns these into a score.

The fit uses every usable labelled row, whole. Counts are grouped in Spark and every
n-gram stays, however rare; the logistic fit takes sums over its rows from Spark, round
by round. Only the counts of distinct n-grams come to the driver, and the model of them
is broadcast (16 bytes an n-gram, and as much a context): it grows with the n-grams
that words are made of, not with the rows. Scoring reads every whole text in one pass
without a shuffle.

Null and empty texts have no evidence; their score is the calibrated prior. With no
labelled rows of one class, every score is 0.5. Repeated rows score alike; in the fit
rows of one id count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import fit_logistic_rows, labelled_rows, scored_rows, sigmoid, written

#: Lower-cases A-Z and turns ASCII signs and digits into spaces; bytes of other letters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_START, _END = b"\x02", b"\x03"
#: What a byte may be: the models share the mass among so many.
ALPHABET = 256
_8 = np.uint64(8)


def tokens(text: str) -> list[bytes]:
    """Lower-cased words of letters, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the packed n-gram that ends there, the bytes before it in the word, and the word.

    A packed n-gram is the number whose bytes are the n-gram, so order is 8 at most;
    within ``order`` bytes of the start it begins with the start sign.
    """
    length = np.array([len(w) + 2 for w in words], np.int64)
    code = np.frombuffer(b"".join([_START + w + _END for w in words]), np.uint8).astype(np.uint64)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    packed = np.zeros(len(code), np.uint64)
    for k in range(order):
        before = np.concatenate([np.zeros(k, np.uint64), code])[: len(code)]
        packed |= np.where(place >= k, before << np.uint64(8 * k), np.uint64(0))
    real = place > 0
    return packed[real], place[real], np.repeat(np.arange(len(words)), length)[real]


def lengths(packed: np.ndarray) -> np.ndarray:
    """Number of bytes of packed n-grams."""
    return sum((packed >= np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))


def without_first(packed: np.ndarray) -> np.ndarray:
    return packed & ((np.uint64(1) << (_8 * (lengths(packed) - 1).astype(np.uint64))) - np.uint64(1))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted table, and which are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _contexts(packed: np.ndarray, counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram's context: its count, and the part of it that discounting frees."""
    _, at = np.unique(packed >> _8, return_inverse=True)
    return np.bincount(at, counts)[at], np.bincount(at, np.minimum(counts, discount))[at]


def continuation_shares(packed: np.ndarray, counts: np.ndarray, discount: float) -> np.ndarray:
    """Kneser-Ney share of each n-gram's last byte after the others, from continuation counts; packed is sorted and holds all shorter ends."""
    total, freed = _contexts(packed, counts, discount)
    size, share = lengths(packed), np.zeros(len(packed))
    for n in range(1, int(size.max(initial=0)) + 1):
        at = size == n
        lower = 1 / ALPHABET if n == 1 else share[_find(packed, without_first(packed[at]))[0]]
        share[at] = (np.maximum(counts[at] - discount, 0) + freed[at] * lower) / total[at]
    return share


@dataclass
class ToxicityModel:
    """Log-likelihood differences (toxic less ordinary): of known n-grams, and of other bytes after a known context."""

    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(0))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    other: np.ndarray = field(default_factory=lambda: np.zeros(0))
    order: int = 5
    windows: tuple[int, ...] = (1, 4)
    weights: tuple[float, ...] = ()

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Sum of the differences over each word's bytes; what follows a context that neither class has seen says nothing."""
        if not words or not len(self.grams):
            return np.zeros(len(words))
        packed, _, word = grams(words, self.order)
        at, known = _find(self.grams, packed)
        value = np.where(known, self.evidence[at], 0.0)
        at, near = _find(self.contexts, packed[~known] >> _8)
        value[~known] = np.where(near, self.other[at], 0.0)
        return np.bincount(word, value, len(words))


def class_shares(packed: np.ndarray, counts: tuple[np.ndarray, np.ndarray], lower: np.ndarray, discount: float, strength: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each class: the share of each n-gram's last byte after its context, and the weight that the context gives to the shared distribution.

    packed: full n-grams; lower: the share of their ends by continuation counts.
    """
    pooled = counts[0] + counts[1]
    total, freed = _contexts(packed, pooled, discount)
    shared = (np.maximum(pooled - discount, 0) + freed * lower) / total
    out, weight = [], []
    for own in counts:
        total, freed = _contexts(packed, own, discount)
        weight.append((freed + strength) / (total + strength))
        out.append(np.maximum(own - discount, 0) / (total + strength) + weight[-1] * shared)
    return out, weight


def build_model(packed: np.ndarray, counts: tuple[np.ndarray, np.ndarray], ends: np.ndarray, before: np.ndarray, order: int = 5, discount: float = 0.75, strength: float = 3.0) -> ToxicityModel:
    """packed, counts: full n-grams, sorted, with each class's documents; ends, before: shorter n-grams, sorted, with their continuation counts."""
    model = ToxicityModel(order=order)
    if len(packed):
        lower = continuation_shares(ends, before, discount)[_find(ends, without_first(packed))[0]]
        share, weight = class_shares(packed, counts, lower, discount, strength)
        model.grams, model.evidence = packed, np.log(share[1] / share[0])
        model.contexts, first = np.unique(packed >> _8, return_index=True)
        model.other = np.log(weight[1][first] / weight[0][first])
    return model


class _Evidence:
    """A text's features; a word's evidence is worked out once while the task keeps it."""

    def __init__(self, model: ToxicityModel, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.seen: dict[bytes, float] = {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Mean over each text, and over the window with the largest mean, for each window length."""
        out = np.zeros((len(texts), 1 + len(self.model.windows)))
        for k, text in enumerate(texts):
            words = tokens(text)
            if not words:
                continue
            new = list(set(words).difference(self.seen))
            if new:
                if len(self.seen) + len(new) > self.most:
                    self.seen.clear()
                    new = list(set(words))
                self.seen.update(zip(new, self.model.of_words(new).tolist(), strict=True))
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.seen.__getitem__, words), float, len(words)))])
            wide = [min(len(words), n) for n in self.model.windows]
            out[k] = [sums[-1] / len(words), *((sums[n:] - sums[:-n]).max() / n for n in wide)]
        return out


#: Different words whose counts a task holds before it passes them on.
WORDS = 200_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def passed() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for (w, _), _ in part], pa.binary()), pa.array([0 if y else n for (_, y), n in part], pa.int64()), pa.array([n if y else 0 for (_, y), n in part], pa.int64())], names=["item", "n0", "n1"])

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            counts.update((w, label) for w in set(tokens(text)))
            if len(counts) > WORDS:
                yield from passed()
    yield from passed()


def _count_grams(order: int) -> Callable:
    """Rows (packed, whole, n0, n1) of the n-grams of all lengths; whole: of the full order, or from the start of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("item").to_pylist()
            if not words:
                continue
            counts = [b.column(c).to_numpy() for c in ("n0", "n1")]
            for n in range(2, order + 1):
                packed, place, word = grams(words, n)
                long = place >= n - 1
                keys, at = np.unique(packed[long], return_inverse=True)
                start = keys >> np.uint64(8 * (n - 1)) == np.uint64(_START[0])
                sums = [np.bincount(at, c[word[long]], len(keys)).astype(np.int64) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(start | (n == order)), *map(pa.array, sums)], names=["packed", "whole", "n0", "n1"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", order: int = 5, discount: float = 0.75, strength: float = 3.0) -> ToxicityModel:
    """Fits on all labelled rows for which usable holds: n-grams on four folds of five, the logistic weights on the fifth."""
    known = written(labelled_rows(docs, labels, label, usable), "labelled")
    words = known.where("fold > 0").select("text", "label").mapInArrow(_count_words, "item binary, n0 long, n1 long").groupBy("item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = words.mapInArrow(_count_grams(order), "packed long, whole boolean, n0 long, n1 long").groupBy("packed").agg(F.first("whole").alias("whole"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = written(counted, "n-grams")
    end = F.expr("packed & (shiftleft(1L, CAST(floor((length(hex(packed)) - 1) / 2) * 8 AS INT)) - 1)")  # without the first byte
    ends = counted.groupBy(end.alias("packed")).agg(F.count("*").alias("before")).orderBy("packed").toArrow()
    full = counted.where("whole").select("packed", "n0", "n1").orderBy("packed").toArrow()
    column = lambda t, c, kind: t.column(c).to_numpy().astype(kind)
    model = build_model(column(full, "packed", np.uint64), (column(full, "n0", float), column(full, "n1", float)), column(ends, "packed", np.uint64), column(ends, "before", float), order, discount, strength)
    if known.where("fold = 0").agg(F.count_distinct("label")).first()[0] == 2:
        held = known.where("fold = 0")
    else:  # too few labels to keep some out
        held = known
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"x{k}" for k in range(1 + len(model.windows))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _Evidence(shared.value)
        for b in batches:
            x = evidence.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), b.column("label")], names=[*names, "label"])

    rows = written(held.select("text", "label").mapInArrow(features, ", ".join(f"{n} double" for n in names) + ", label int"), "evidence")
    if rows.agg(F.count_distinct("label")).first()[0] == 2:
        model.weights = tuple(fit_logistic_rows(rows, names, "label"))
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of df and a score from 0 to 1."""
    return score_rows(df, model, keep, text).select("row.*", "score")


def score_rows(df: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """(row, score): the columns keep of df, of any names, as one struct, and a score from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], np.ndarray]:
        evidence, weights = _Evidence(shared.value), shared.value.weights
        if not weights:
            return lambda texts: np.full(len(texts), 0.5)
        return lambda texts: sigmoid(evidence.features(texts) @ np.array(weights[:-1]) + weights[-1])

    return scored_rows(df, make, keep, text)
