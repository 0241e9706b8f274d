"""Quality by supervised subword embeddings.

Every distinct hashed word and character n-gram has a learned vector; a document is the average of its
vectors, and a softmax output over that average gives the class. Vectors and output
are trained by stochastic gradient descent in numpy on at most ``per_class`` labelled
documents a class. The output is linear in the average, so a text is scored with one
number per bucket: a table of 2 ** bits doubles is all that is broadcast.

Null and empty texts have no n-grams and score 0.5, as does every text if a class
has no labelled rows. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from downfield.llm.common import class_totals, fit_logistic, labelled_sample, scored_rows, sigmoid

_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(1099511628211)


def buckets(text: str, bits: int, sizes: tuple[int, ...], block: int = 1 << 18) -> Iterator[np.ndarray]:
    """Buckets of all words and of the character n-grams that hold no space but at an end, for blocks of the text.

    Blocks end at a space where there is one, so that no word is cut.
    """
    at = 0
    while at < len(text):
        end = min(len(text), at + block)
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in " \n\t")
            end = cut + 1 if cut > at else end
        yield _buckets(text[at:end], bits, sizes)
        at = end


def _buckets(text: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(space, np.uint64(32), code.astype(np.uint64))
    shift, out = np.uint64(64 - bits), []
    spaces = np.concatenate([[0], np.cumsum(space)])
    h = code.copy()
    grown = 1
    for n in sorted(sizes):
        while grown < n:
            h = h[:-1] * _PRIME + code[grown:]
            grown += 1
        if len(h):
            inner = spaces[n - 1 : n - 1 + len(h)] - spaces[1 : 1 + len(h)]  # spaces between the ends
            out.append(((h[inner == 0] ^ np.uint64(n)) * _MULT) >> shift)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        held = np.where(space, np.uint64(0), code)
        index = np.arange(len(code), dtype=np.uint64)
        first = np.zeros(len(code), np.uint64)
        first[starts] = starts
        place = index - np.maximum.accumulate(first)
        mixed = (held * _MULT) ^ (held << np.uint64(7))
        words = np.add.reduceat(mixed * (place * np.uint64(2) + np.uint64(1)) * _PRIME, starts)
        out.append(((words ^ np.uint64(0xABCD)) * _MULT) >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class QualityModel:
    bits: int
    sizes: tuple[int, ...]
    values: np.ndarray
    weights: tuple[float, ...] = ()


def _mean(text: str, values: np.ndarray, bits: int, sizes: tuple[int, ...]) -> float | None:
    total = count = 0
    for b in buckets(text, bits, sizes):
        total, count = total + values[b].sum(), count + len(b)
    return total / count if count else None


def _train(bags: list[tuple[np.ndarray, np.ndarray, int]], bits: int, dim: int, epochs: int, rate: float, seed: int) -> np.ndarray:
    """One number per bucket: its learned vector times the difference of the two output vectors."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    output = np.zeros((dim, 2))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            index, share, label = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[index]
            z = hidden @ output
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = output @ error
            output -= lr * np.outer(hidden, error)
            vectors[index] -= (lr * share * len(index) ** 0.5)[:, None] * back
    return vectors @ (output[:, 1] - output[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: tuple[int, int] = (1000, 1000), bits: int = 15, sizes: tuple[int, ...] = (3, 4), dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Fits on at most per_class labelled rows a class for which usable holds; the driver gets their bucket shares."""
    sample = labelled_sample(docs, labels, label, usable, per_class).select("doc_id", "text", "label", "fold")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, share = [], []
            for text in b.column("text").to_pylist():
                count = np.zeros(1 << bits)
                for x in buckets(text, bits, sizes):
                    count += np.bincount(x, minlength=1 << bits)
                at = np.flatnonzero(count)
                index.append(at.astype(np.int32))
                share.append((count[at] / max(count.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("fold"), pa.array(index, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["doc_id", "label", "fold", "index", "share"])

    got = sample.mapInArrow(bags, "doc_id long, label int, fold int, index array<int>, share array<float>").toArrow()
    cols = {c: got.column(c).combine_chunks() for c in got.column_names}
    order = np.argsort(cols["doc_id"].to_numpy(zero_copy_only=False), kind="stable")
    labels_, folds = (cols[c].to_numpy(zero_copy_only=False) for c in ("label", "fold"))
    bag = [(cols["index"][int(i)].values.to_numpy(), cols["share"][int(i)].values.to_numpy().astype(float), int(labels_[i])) for i in order]
    train, held = ([b for b, f in zip(bag, folds[order], strict=True) if (f == 0) == kept and len(b[0])] for kept in (False, True))
    if len({b[2] for b in held}) < 2:  # too few labels to keep some out
        held = train
    model = QualityModel(bits, sizes, np.zeros(1 << bits))
    if len({b[2] for b in train}) == 2 and len({b[2] for b in held}) == 2:
        model.values = _train(train, bits, dim, epochs, rate, seed)
        y = np.array([b[2] for b in held], float)
        x = np.array([[b[1] @ model.values[b[0]]] for b in held])
        n = class_totals(labels, label, usable)
        weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
        model.weights = tuple(fit_logistic(x, y, weight * len(y) / weight.sum()))
    return model


def score_quality(df: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of df and a score from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], np.ndarray]:
        m = shared.value
        values = m.values.astype(np.float64)

        def score(texts: list) -> np.ndarray:
            means = [_mean(t, values, m.bits, m.sizes) if m.weights else None for t in texts]
            return np.array([0.5 if x is None else float(sigmoid(np.array(x * m.weights[0] + m.weights[1]))) for x in means])

        return score

    return scored_rows(df, make, keep, text).select("row.*", "score")
