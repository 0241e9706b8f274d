"""Stupid-backoff scores of every document under counts of all documents.

Texts are written once to block files of a bounded size in the shared folder, with a
manifest. Each block's distinct n-grams of every order, as sorted 56-bit hashes with
their counts in the block, go to the hash partitions of the count table; there the
counts of all blocks are summed, which is the table, and joined back to the n-grams
that asked. The block then scores its documents: for each word the longest order whose
count is not zero gives count over context count, times ``backoff`` for each order that
was skipped; the logs are summed per document. A block is read from its file where it
is asked and scored, so no text is shuffled, and what was lost is read again.

A document's own counts are taken off first, so no text vouches for itself; copies
vouch for each other. A common n-gram sends one number a block, not one a document, and
repeated rows lie in many blocks, so no partition is hot. Work and rows grow with the
corpus; nothing goes to the driver but two totals.

Words are lower-cased (A-Z) runs without ASCII white space. Null and empty texts
have no words, score 0 and mean null. Repeated rows vouch for each other and get one
row each; null ids stay null. Two n-grams share a hash with a chance of 2**-56 a pair.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import scratch
from downfield.llm.warc import open_fs

BITS = 56
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RESULT = "doc_id long, n_words long, log10_score double, mean_log10 double, n_backed_off long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts, and the text that each stands in."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stops = np.flatnonzero(space & ~before)
    length = stops - starts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    power = np.cumprod(np.full(int(length.max()) + 1, _A, np.uint64))
    terms = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)])
    return _mix(np.add.reduceat(terms, starts) ^ length.astype(np.uint64)), np.searchsorted(ends, starts, "right")


def ngrams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-gram of each order that ends at each word (0 where the text has none), and the words' texts."""
    word, text = hash_words(texts)
    out, h = [_mix(word + np.uint64(1)) >> np.uint64(64 - BITS)], word
    for n in range(2, order + 1):
        h = np.concatenate([[np.uint64(0)], h[:-1]]) * _A + word
        whole = np.zeros(len(word), bool)
        whole[n - 1 :] = text[n - 1 :] == text[: len(text) - n + 1]
        h = np.where(whole, _mix(h + np.uint64(n)), np.uint64(0))
        out.append(h >> np.uint64(64 - BITS))
    return out, text


def pack(values: np.ndarray) -> bytes:
    """Sorted or small integers as bytes: differences by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _distinct(hashes: list[np.ndarray], text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: order, distinct hashes of whole n-grams in ascending order, place of each word's among them, counts."""
    for n, h in enumerate(hashes, 1):
        whole = np.ones(len(h), bool)
        if n > 1:
            whole[: n - 1] = False
            whole[n - 1 :] = text[n - 1 :] == text[: len(text) - n + 1]
        place = np.full(len(h), -1)
        values, at, count = np.unique(h[whole], return_inverse=True, return_counts=True)
        place[whole] = at
        yield n, values, place, count


def own_counts(place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, how often its n-gram (by place, -1: none) is in its text."""
    n = int(text.max()) + 1 if len(text) else 1
    _, at, count = np.unique(place.astype(np.int64) * n + text, return_inverse=True, return_counts=True)
    return count[at]


def stupid_backoff(total: list[np.ndarray], own: list[np.ndarray], words: float, text: np.ndarray, own_words: np.ndarray, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 score of each word and whether an order was skipped; total, own: counts of the n-gram of each order that ends there, -1 where there is none."""
    left = [np.where(t < 0, 0, t - o) for t, o in zip(total, own, strict=True)]
    rest = np.maximum(words - own_words, 0)
    score = np.log10(np.maximum(left[0], 1) / np.maximum(rest, 1))
    score[left[0] == 0] = -np.log10(rest[left[0] == 0] + 1)
    used = np.ones(len(score), np.int64)
    for n in range(2, len(left) + 1):
        context = np.concatenate([[0], left[n - 2][:-1]])
        has = left[n - 1] > 0
        score = np.where(has, np.log10(np.maximum(left[n - 1], 1) / np.maximum(context, 1)), score)
        used = np.where(has, n, used)
    possible = np.ones(len(score), np.int64)
    for n in range(2, len(left) + 1):
        possible += total[n - 1] >= 0
    skipped = possible - used
    return score + skipped * np.log10(backoff), skipped > 0


def write_blocks(docs: DataFrame, folder: str, block_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ids and texts to block files in the folder; the manifest (block, file, n_bytes, n_words) as read again."""
    schema = "block long, file string, n_bytes long, n_words long"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        fs, path = open_fs(folder)
        fs.create_dir(posixpath.join(path, "blocks"), recursive=True)

        def flush(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
            name = f"blocks/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.arrow"
            words = sum(len(t.as_py().split()) for b in held for t in b.column("body"))  # bytes: ASCII white space only
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with fs.open_output_stream(posixpath.join(path, name), compression=None) as out, pa.ipc.new_stream(out, held[0].schema, options=options) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([name]), pa.array([size], pa.int64()), pa.array([words], pa.int64())], names=["block", "file", "n_bytes", "n_words"])

        held, size = [], 0
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False) + 1)
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(b.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= block_bytes or at < len(ends):
                    yield flush(held, size)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush(held, size)

    rows.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def read_block(folder: str, file: str) -> pa.Table:
    fs, path = open_fs(folder)
    with fs.open_input_file(posixpath.join(path, file)) as f:
        return pa.ipc.open_stream(f.read()).read_all()


def score_documents(docs: DataFrame, order: int = 3, backoff: float = 0.4, block_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, n_words, log10_score, mean_log10, n_backed_off) of each row of docs."""
    folder = folder or scratch(docs.sparkSession, "lm")
    manifest = write_blocks(docs, folder, block_bytes, key, text)
    size, words, blocks = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    blocks = max(1, int(blocks))
    buckets = max(1, int(size // (2 * block_bytes)))
    width = -(-(1 << BITS) // buckets)  # of the hashes of a bucket

    def edges(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(values, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for block, file in zip(batch.column("block").to_pylist(), batch.column("file").to_pylist(), strict=True):
                hashes, at = ngrams(read_block(folder, file).column("body").to_pylist(), order)
                for n, values, _, count in _distinct(hashes, at):
                    cut = edges(values)
                    out = [(int(b), block, n, pack(np.diff(values[cut[b] : cut[b + 1]], prepend=np.uint64(0))), pack(count[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "block", "n", "grams", "counts"])

    def count(t: pa.Table) -> pa.Table:
        asked = list(zip(*(t.column(c).to_pylist() for c in ("block", "n", "grams", "counts")), strict=True))
        bucket, out = t.column("bucket")[0].as_py(), []
        for n in sorted({a[1] for a in asked}):
            own = [a for a in asked if a[1] == n]
            grams = [np.cumsum(unpack(a[2]), dtype=np.uint64) for a in own]
            _, at = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(at, np.concatenate([unpack(a[3]) for a in own])).astype(np.uint64)[at]
            for a, part in zip(own, np.split(total, np.cumsum([len(g) for g in grams])[:-1]), strict=True):
                out.append((a[0], bucket, n, pack(part)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "bucket", "n", "totals"])

    def score(asked: pa.Table, told: pa.Table) -> pa.Table:
        texts = read_block(folder, asked.column("file")[0].as_py())
        ids, texts = texts.column("doc_id"), texts.column("body").to_pylist()
        hashes, at = ngrams(texts, order)
        got: dict[int, list[tuple[int, bytes]]] = {}
        for b, n, x in zip(*(told.column(c).to_pylist() for c in ("bucket", "n", "totals")), strict=True):
            got.setdefault(n, []).append((b, x))
        total, own = [], []
        for n, values, place, _ in _distinct(hashes, at):
            full = np.concatenate([unpack(x) for _, x in sorted(got.get(n, []))]) if got.get(n) else np.zeros(0)
            if len(full) != len(values):
                raise ValueError(f"block {asked.column('block')[0]}: {len(values)} n-grams of order {n} asked, {len(full)} counts came back")
            full = np.append(full.astype(np.float64), -1.0)
            total.append(full[place])
            own.append(own_counts(place, at))
        length = np.bincount(at, minlength=len(texts))
        if len(at):
            each, skipped = stupid_backoff(total, own, float(words), at, length[at], backoff)
            sums, skips = np.bincount(at, each, len(texts)), np.bincount(at, skipped, len(texts)).astype(np.int64)
        else:
            sums, skips = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        mean = pa.array(sums / np.maximum(length, 1), pa.float64(), mask=length == 0)
        return pa.table([ids, pa.array(length.astype(np.int64)), pa.array(sums), mean, pa.array(skips)], names=["doc_id", "n_words", "log10_score", "mean_log10", "n_backed_off"])

    files = manifest.select("block", "file")
    requests = files.repartition(blocks).mapInArrow(ask, "bucket long, block long, n int, grams binary, counts binary")
    replies = requests.groupBy("bucket").applyInArrow(count, "block long, bucket long, n int, totals binary")
    return files.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, _RESULT)
