"""Substring dedup by fixed-block anchors.

Every document is cut into blocks of ``anchor`` words that do not overlap, at most half a
window long, so each window holds a whole block of the document it starts in. The blocks'
hashes are the index. Every rolling run of ``anchor`` words of every document probes it; a hit is
a block that another document holds at any place. Around each hit the repeat is extended word by
word: every window about it is compared, by a hash of 96 bits over all its words, with the windows
about the block, and the windows found in a document with a smaller id join to maximal exact repeats,
whose words go.

Texts lie in block files of a bounded size in the shared folder, so no text is shuffled and
what was lost is read again. Index, probes and windows travel as sorted distinct hashes of a file and
a hash bucket (delta-coded), so a passage that a third of the documents hold is one number a file:
no key is hot, no pair of documents is made, and nothing grows with the square of a group. Only
what lies about hits is compared in the second step. A bucket returns to each file what it
must know: hits first, then for each window the least id that holds it.

Windows are judged on the input. A null id counts as larger than all others, so documents
without an id never take words from those that have one, nor from each other; equal ids
take none from each other, so repeated rows stay as they are. Null and empty texts, and
those shorter than a window, keep all their words. Very long texts are read whole by the
task of their file. An empty table gives no row. Probes are compared by 48 bits, which may
only add windows to compare; two different windows share 96 bits with a chance of 2**-96 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import scratch, written
from downfield.llm.lm import pack, read_block, unpack, write_blocks

#: Bases of the two rolling hashes, odd, so that they have inverses modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
_NO_ID = np.iinfo(np.int64).max
_PROBE_BITS = 48


class _Words(dict):
    """64-bit hash of each word; forgets all when it holds ``most``."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 13)
        return h


_WORDS = _Words()


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base & (2**64 - 1), np.uint64))])[:n]


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, of those that have so many: differences of a running sum, shifted back by the base's inverse."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)])
    h = (sums[size:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Held:
    """The documents of a block file: ids (the largest number for none), words, and where each begins among all words of the file."""

    def __init__(self, table: pa.Table, window: int, anchor: int) -> None:
        self.ids, self.window, self.anchor = table.column("doc_id"), window, anchor
        self.bodies = table.column("body")
        hashes = []
        for x in self.bodies:
            split = x.as_py().split()  # bytes: ASCII white space only
            hashes.append(np.fromiter(map(_WORDS.__getitem__, split), np.uint64, len(split)))
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.order = np.array([_NO_ID if k is None else k for k in self.ids.to_pylist()], np.int64)

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from which a document of at least a window's length goes on for ``size`` words, and its number."""
        many = np.where(self.sizes >= self.window, self.sizes - size + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.starts[doc], doc

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all rolling runs of an anchor's length, their places and documents."""
        at, doc = self.places(self.anchor)
        return (rolling(self.words, self.anchor, _BASES[0])[at] if len(at) else np.zeros(0, np.uint64)) >> np.uint64(64 - _PROBE_BITS), at, doc

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct probe hashes in order; of each: 1 if it is a block of the index, plus 2 if more than one document holds it."""
        h, at, doc = self.probes()
        if not len(h):
            return h, np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h, at, doc = h[order], at[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        block = np.maximum.reduceat(((at - self.starts[doc]) % self.anchor == 0).astype(np.uint64), first)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        return h[first], block + 2 * several.astype(np.uint64)

    def windows(self, hits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes, place and document of each window; with hits (sorted) of those that hold a hit so early that a block may begin there."""
        at, doc = self.places(self.window)
        if hits is not None:
            h, near, _ = self.probes()
            found = np.zeros(len(self.words) + 1, np.int64)
            found[near[hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h] + 1] = 1
            found = np.cumsum(found)
            keep = found[at + self.anchor] > found[at]
            at, doc = at[keep], doc[keep]
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, doc
        one, two = (rolling(self.words, self.window, b)[at] for b in _BASES)
        return one, two >> np.uint64(32), at, doc


def _groups(*sorted_by: np.ndarray) -> np.ndarray:
    """First places of runs of equal rows."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _cells(t: pa.Table, *names: str) -> list[tuple]:
    return list(zip(t.column("block").to_pylist(), *([unpack(x) for x in t.column(n).to_pylist()] for n in names), strict=True))


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def repeated_passages(docs: DataFrame, window: int = 50, anchor: int = 25, block_bytes: int = 8 << 20, bucket_words: int = 2_000_000, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, n_words, repeats, kept) of each row of docs.

    repeats: array of (start, stop) in words, the maximal runs of words that lie in windows which
    a document with a smaller id holds, too; kept: the other words, joined by a space.
    """
    if not 0 < 2 * anchor - 1 <= window:
        raise ValueError("a window must hold a whole block wherever it starts: 2 * anchor - 1 <= window")
    folder = folder or scratch(docs.sparkSession, "passages")
    files = write_blocks(docs, folder, block_bytes, key, text)
    words, blocks = files.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    buckets, blocks = max(1, int(words) // bucket_words), max(1, int(blocks))
    width = np.uint64(-(-(1 << _PROBE_BITS) // buckets))
    files = files.select("block", "file")

    def held(t: pa.Table | pa.RecordBatch, i: int = 0) -> Held:
        return Held(read_block(folder, t.column("file")[i].as_py()), window, anchor)

    def parts(h: np.ndarray) -> list[tuple[int, slice]]:
        """The buckets of sorted hashes, of the first 48 bits."""
        cut = np.searchsorted(h, np.arange(buckets + 1, dtype=np.uint64) * width)
        return [(int(b), slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]

    def gaps(h: np.ndarray) -> bytes:
        return pack(np.diff(h, prepend=np.uint64(0)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                h, kinds = held(batch, i).asked()
                if rows := [(b, block, gaps(h[s]), pack(kinds[s])) for b, s in parts(h)]:
                    yield _batch(rows, "bucket", "block", "hashes", "kinds")

    def meet(t: pa.Table) -> pa.Table:
        """To each file the probes of its own that hit a block of another document."""
        bucket, cells = t.column("bucket")[0].as_py(), _cells(t, "hashes", "kinds")
        own = [np.cumsum(x, dtype=np.uint64) for _, x, _ in cells]
        h = np.concatenate(own)
        order = np.argsort(h, kind="stable")
        first = _groups(h[order])
        kinds = np.bitwise_or.reduceat(np.concatenate([k for _, _, k in cells])[order], first)
        many = np.diff(np.append(first, len(h)))
        hits = h[order][first][(kinds & np.uint64(1) > 0) & ((many > 1) | (kinds & np.uint64(2) > 0))]
        mine = [(block, bucket, x[np.isin(x, hits, assume_unique=True)]) for (block, _, _), x in zip(cells, own, strict=True)]
        return pa.Table.from_batches([_batch([(b, k, gaps(x)) for b, k, x in mine if len(x)], "block", "bucket", "hits")])

    def extend(asked: pa.Table, told: pa.Table) -> pa.Table:
        """The windows about a file's hits, distinct, with the least and largest id of the file that hold them."""
        rows: list[tuple] = []
        if len(told):
            cells = sorted(zip(told.column("bucket").to_pylist(), told.column("hits").to_pylist(), strict=True))
            hits = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for _, x in cells])
            docs_ = held(asked)
            one, two, _, doc = docs_.windows(hits)
            ident = docs_.order[doc]
            order = np.lexsort((ident, two, one))
            one, two, ident = one[order], two[order], ident[order]
            first = _groups(one, two)
            last = np.append(first, len(one))[1:] - 1
            block = asked.column("block")[0].as_py()
            one, two, least, most = one[first], two[first], ident[first], ident[last]
            rows = [(b, block, gaps(one[s]), pack(two[s]), pack(least[s]), pack((most - least)[s])) for b, s in parts(one >> np.uint64(64 - _PROBE_BITS))]
        return pa.Table.from_batches([_batch(rows, "bucket", "block", "one", "two", "least", "more")])

    def settle(t: pa.Table) -> pa.Table:
        """To each file the windows of its own that a smaller id holds than the largest there, with the least."""
        bucket, cells = t.column("bucket")[0].as_py(), _cells(t, "one", "two", "least", "more")
        own = [(np.cumsum(x, dtype=np.uint64), y, least.view(np.int64), (least + more).view(np.int64)) for _, x, y, least, more in cells]
        one, two, least, most = (np.concatenate([c[i] for c in own]) for i in range(4))
        order = np.lexsort((least, two, one))
        first = _groups(one[order], two[order])
        lowest = np.empty(len(one), np.int64)
        lowest[order] = np.repeat(least[order][first], np.diff(np.append(first, len(one))))
        out, at = [], 0
        for (block, *_), (x, y, _, m) in zip(cells, own, strict=True):
            low = lowest[at : at + len(x)]
            at += len(x)
            if (later := low < m).any():
                out.append((block, bucket, gaps(x[later]), pack(y[later]), pack(low[later])))
        return pa.Table.from_batches([_batch(out, "block", "bucket", "one", "two", "lowest")])

    def remove(asked: pa.Table, told: pa.Table) -> pa.Table:
        docs_ = held(asked)
        gone = np.zeros(len(docs_.words) + 1, np.int64)
        if len(told):
            known = sorted(zip(told.column("bucket").to_pylist(), *(told.column(c).to_pylist() for c in ("one", "two", "lowest")), strict=True))
            one, two, low = np.concatenate([np.cumsum(unpack(k[1]), dtype=np.uint64) for k in known]), np.concatenate([unpack(k[2]) for k in known]), np.concatenate([unpack(k[3]).view(np.int64) for k in known])
            a, b, at, doc = docs_.windows()
            lo, hi = np.searchsorted(one, a), np.searchsorted(one, a, "right")
            later = np.zeros(len(a), bool)
            for k in range(int((hi - lo).max(initial=0))):  # 1 but for windows that share 64 bits
                j = np.minimum(lo + k, len(one) - 1)
                later |= (lo + k < hi) & (two[j] == b) & (low[j] < docs_.order[doc])
            np.add.at(gone, at[later], 1)
            np.add.at(gone, at[later] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for body, start, n in zip(docs_.bodies, docs_.starts.tolist(), docs_.sizes.tolist(), strict=True):
            out = gone[start : start + n]
            split = body.as_py().split()
            edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            spans.append([{"start": int(x), "stop": int(y)} for x, y in edge])
            kept.append(b" ".join([w for w, x in zip(split, out, strict=True) if not x] if len(edge) else split).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table([docs_.ids, pa.array(docs_.sizes), pa.array(spans, kind), pa.array(kept)], names=["doc_id", "n_words", "repeats", "kept"])

    asked = files.repartition(blocks).mapInArrow(probe, "bucket long, block long, hashes binary, kinds binary")
    hits = asked.groupBy("bucket").applyInArrow(meet, "block long, bucket long, hits binary")
    about = files.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(extend, "bucket long, block long, one binary, two binary, least binary, more binary")
    lowest = about.groupBy("bucket").applyInArrow(settle, "block long, bucket long, one binary, two binary, lowest binary")
    lowest = written(lowest, "lowest")
    return files.groupBy("block").cogroup(lowest.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, repeats array<struct<start: long, stop: long>>, kept string")
