"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of ``seed`` words that a document and a benchmark item share. Of
each pair that shares enough of them the longest common run of words that are not yet
marked is marked, again and again (running Karp-Rabin: hashes of all windows of a
length, from prefix sums, and the longest length with a common hash by bisection). An
item's coverage is its share of marked words; as tiles may lie in any order and place,
reordered passages are caught. A pair counts from ``threshold`` on. Of equally long
runs the first in the item goes first, then the first in the document.

A pair reaches the threshold only if item words with enough seeds are in the document,
so it shares one of the item's rarest seeds: all but so many that the rest can't reach
it. Pairs are proposed by these alone. A benchmark of at most ``block_bytes`` of text is
broadcast and meets every document where it lies; a larger one is joined with the
documents' seeds on their hash. Memory is linear in a document and an item, however
often they repeat themselves. Words are lower-cased runs of letters and digits; bytes
beyond ASCII are letters.

Null and empty texts share nothing. An item of fewer than ``seed`` words has no seed
and matches nothing: a single common word says nothing of a document. Null ids are
returned as null. Repeated rows are each returned. Empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from downfield.llm.common import whole_row, written

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_CHUNK = 4 << 20  # bytes of text hashed at once
_PAIR = "coverage double, marked_words long, longest_tile long"


def tokens(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


class Runs:
    """A sequence of word ids whose windows of any length are hashed from prefix sums; marked words are in no window."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * _powers(_BASE, len(ids)), dtype=np.uint64)])
        self.back = _powers(_BACK, len(ids))
        self.marked = np.zeros(len(ids), bool)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of n words without a marked one."""
        if n > len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, length) of two sequences of word ids."""
    a, b, tiles = Runs(item), Runs(doc), []
    longest = min(len(item), len(doc))
    while longest >= seed and not a.marked.all():
        low = seed - 1
        while low < longest:  # the longest length with a common window
            n = (low + longest + 1) // 2
            if np.isin(a.windows(n)[1], b.windows(n)[1]).any():
                low = n
            else:
                longest = n - 1
        if longest >= seed:
            tiles += _mark(a, b, longest)
        longest -= 1
    return tiles


def _mark(a: Runs, b: Runs, n: int) -> list[tuple[int, int, int]]:
    """Marks the common windows of n words, in order of their places."""
    at, asked = a.windows(n)
    places, held = b.windows(n)
    order = np.argsort(held, kind="stable")
    held, places = held[order], places[order]
    first = np.searchsorted(held, asked)
    hit = np.flatnonzero(held[np.minimum(first, len(held) - 1)] == asked)
    after: dict[int, int] = {}  # next place to try for each hash: what is marked once stays so
    tiles: list[tuple[int, int, int]] = []
    for i in hit.tolist():
        x, h = int(at[i]), int(asked[i])
        if a.marked[x : x + n].any():
            continue
        k = after.get(h, int(first[i]))
        while k < len(held) and int(held[k]) == h:
            y = int(places[k])
            k += 1
            if not b.marked[y : y + n].any() and (a.ids[x : x + n] == b.ids[y : y + n]).all():
                a.marked[x : x + n] = b.marked[y : y + n] = True
                tiles.append((x, y, n))
                break
        after[h] = k
    return tiles


def seed_places(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seed hashes of a sequence and the number of its places that have each."""
    return np.unique(Runs(ids).windows(seed)[1], return_counts=True)


def places_needed(words: int, seed: int, threshold: float) -> int:
    """Places with a shared seed that a pair has at least if it reaches the threshold: a tile of n words has n - seed + 1."""
    return max(1, int(np.ceil(threshold * words / seed - 1e-9)))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Ids that are the same everywhere: hashes of the words, never 0."""
    return np.fromiter((xxhash.xxh64_intdigest(w) | 1 for w in words), np.uint64, len(words))


@dataclass
class BenchmarkBlock:
    """Items, their seeds, and of each item the rarest seeds by which pairs are proposed."""

    keys: list[int | None]
    items: list[np.ndarray]
    seeds: list[tuple[np.ndarray, np.ndarray]]
    needed: list[int]
    known: dict[bytes, int]
    all_seeds: np.ndarray
    rare: np.ndarray
    owner: np.ndarray
    seed: int


def benchmark_block(rows: list[tuple[int | None, str]], seed: int, threshold: float) -> BenchmarkBlock:
    """From (key, text) of the items."""
    keys, items, known = [], [], {}
    for key, text in rows:
        words = tokens(text.encode("utf-8", "replace"))
        if len(words) >= seed:
            ids = word_ids(words)
            known.update(zip(words, ids.tolist(), strict=True))
            keys.append(key)
            items.append(ids)
    seeds = [seed_places(x, seed) for x in items]
    needed = [places_needed(len(x), seed, threshold) for x in items]
    every, count = np.unique(np.concatenate([s for s, _ in seeds]) if seeds else np.zeros(0, np.uint64), return_counts=True)
    rare, owner = [], []
    for k, (s, n) in enumerate(seeds):
        order = np.argsort(count[np.searchsorted(every, s)], kind="stable")
        left = n.sum() - np.cumsum(n[order])  # places of the seeds that come later
        rare.append(s[order[: int(np.argmax(left < needed[k])) + 1]])
        owner.append(np.full(len(rare[-1]), k))
    rare_, owner_ = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (rare, owner))
    order = np.argsort(rare_, kind="stable")
    return BenchmarkBlock(keys, items, seeds, needed, known, every, rare_[order], owner_[order].astype(np.int64), seed)


def judge(item: np.ndarray, doc: np.ndarray, seed: int, threshold: float) -> tuple[float, int, int] | None:
    """(coverage, marked words, longest tile) if the pair reaches the threshold."""
    sizes = [t[2] for t in tile(item, doc, seed)]
    return (sum(sizes) / len(item), sum(sizes), max(sizes)) if sizes and sum(sizes) >= threshold * len(item) else None


def matches(texts: list[bytes], block: BenchmarkBlock, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, coverage, marked words, longest tile) of the pairs that reach the threshold."""
    k, get, at = block.seed, block.known.get, 0
    while at < len(texts) and len(block.items):
        ids: list[int] = []
        starts, held, begun = [], 0, at
        while at < len(texts) and (held < _CHUNK or at == begun):
            starts.append(len(ids))
            ids += [get(w, 0) for w in tokens(texts[at])]
            ids.append(0)
            held += len(texts[at])
            at += 1
        starts.append(len(ids))
        code = np.array(ids, np.uint64)
        del ids
        gaps = np.concatenate([[0], np.cumsum(code == 0)])
        whole = np.flatnonzero(gaps[k:] == gaps[: len(gaps) - k])  # windows of words that the benchmark knows
        if not len(whole):
            continue
        sums, back = np.concatenate([[np.uint64(0)], np.cumsum(code * _powers(_BASE, len(code)), dtype=np.uint64)]), _powers(_BACK, len(code))
        h = (sums[whole + k] - sums[whole]) * back[whole]
        found = np.isin(h, block.all_seeds)
        doc, h = np.searchsorted(starts, whole[found], "right") - 1, h[found]
        cut = np.searchsorted(doc, np.arange(len(starts)))
        for d in np.unique(doc).tolist():
            own = np.unique(h[cut[d] : cut[d + 1]])
            low, high = np.searchsorted(block.rare, own, "left"), np.searchsorted(block.rare, own, "right")
            near = low < high
            if not near.any():
                continue
            items = np.unique(np.concatenate([block.owner[s:e] for s, e in zip(low[near], high[near], strict=True)]))
            for m in items.tolist():
                seeds, places = block.seeds[m]
                if places[np.isin(seeds, own)].sum() >= block.needed[m]:
                    told = judge(block.items[m], code[starts[d] : starts[d + 1]], k, threshold)
                    if told:
                        yield begun + d, m, *told


def _items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    return benchmark.select(F.col(key).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("item"))


def _is_small(items: DataFrame, block_bytes: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0] <= block_bytes


def _block(items: DataFrame, seed: int, threshold: float) -> BenchmarkBlock:
    return benchmark_block([(r.item_id, r["item"]) for r in items.collect()], seed, threshold)


def _seed_rows(rows: DataFrame, number: str, body: str, seed: int) -> DataFrame:
    """(number, words, hash, places) of the distinct seeds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), b.column("body"), strict=True):
                ids = word_ids(tokens(data.as_py()))
                if len(ids) >= seed:
                    h, places = seed_places(ids, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n)), pa.array(np.full(len(h), len(ids))), pa.array(h.view(np.int64)), pa.array(places.astype(np.int64))], names=[number, "words", "hash", "places"])

    return rows.select(F.col(number).alias("n"), F.col(body).cast("binary").alias("body")).mapInArrow(run, f"{number} long, words long, hash long, places long")


def _joined(texts: DataFrame, items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """(row, item_id and the measures) of the pairs that reach the threshold, by joins on seeds; texts: (row, body)."""
    items = written(items.select("item_id", "item", F.monotonically_increasing_id().alias("number")), "items")
    seeds = written(_seed_rows(items, "number", "item", seed), "item-seeds")
    spread = seeds.join(seeds.groupBy("hash").agg(F.count("*").alias("items")), "hash")
    rarest_first = Window.partitionBy("number").orderBy("items", "hash")
    later = F.sum("places").over(Window.partitionBy("number")) - F.sum("places").over(rarest_first.rowsBetween(Window.unboundedPreceding, -1))
    needed = F.greatest(F.lit(1), F.ceil(F.col("words") * threshold / seed - 1e-9))
    rare = spread.withColumn("left", later).where(F.col("left").isNull() | (F.col("left") >= needed)).select("number", "hash")
    pairs = _seed_rows(texts, "row", "body", seed).select("row", "hash").join(rare, "hash").select("row", "number").distinct()
    both = pairs.join(items, "number").join(texts, "row").select("row", "item_id", F.col("item").cast("binary").alias("item"), F.col("body").cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, key, item, body in zip(*(b.column(c) for c in ("row", "item_id", "item", "body")), strict=True):
                told = judge(word_ids(tokens(item.as_py())), word_ids(tokens(body.as_py())), seed, threshold)
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array([r.as_py()], pa.int64()), pa.array([key.as_py()], pa.int64()), *(pa.array([x], t) for x, t in zip(told, (pa.float64(), pa.int64(), pa.int64()), strict=True))], names=["row", "item_id", "coverage", "marked_words", "longest_tile"])

    return both.mapInArrow(run, f"row long, item_id long, {_PAIR}")


def contaminations(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, marked_words, longest_tile) of every contaminated pair."""
    items = _items(benchmark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if not _is_small(items, block_bytes):
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
        found = _joined(rows.select("row", "body"), items, seed, threshold)
        return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "coverage", "marked_words", "longest_tile")
    shared = docs.sparkSession.sparkContext.broadcast(_block(items, seed, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            found = [(keys[d], b.keys[m], *rest) for d, m, *rest in matches(batch.column("body").to_pylist(), b, threshold)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "coverage", "marked_words", "longest_tile"])

    return rows.select("doc_id", F.col("body").cast("binary").alias("body")).mapInArrow(run, f"doc_id long, item_id long, {_PAIR}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that reach the threshold with no item; columns stay."""
    items = _items(benchmark)
    if not _is_small(items, block_bytes):
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole_row(docs).alias("doc")), "texts")
        found = _joined(rows.select("row", F.coalesce(F.col(f"doc.{text}"), F.lit("")).alias("body")), items, seed, threshold)
        return rows.join(found.select("row").distinct(), "row", "left_anti").select("doc.*")
    carried = docs.select(whole_row(docs).alias("row"), F.col(text).cast("binary").alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(_block(items, seed, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("body").to_pylist()]
            bad = {d for d, *_ in matches(texts, shared.value, threshold)}
            yield batch.select(["row"]).filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

    return carried.mapInArrow(run, T.StructType([carried.schema["row"]])).select("row.*")
