"""Near copies: classes of texts chained by a Jaccard similarity of their word shingles.

Texts are sets of XXH64 values of their 5-word shingles; equal sets are one node, so
exact copies never meet as pairs. Nodes are proposed in two ways. SimHash: each set has
a 64-bit fingerprint, and a table for each two of six blocks of its bits, so that
fingerprints of 4 differing bits or fewer meet surely and many further ones do; within
a bucket those of 12 bits or fewer are proposed. At a similarity of 0.8 fingerprints
differ at about 10 bits and at up to 20, which tables that are selective don't reach
surely, so what is further is proposed by MinHash bands: two sets of similarity s share
none of 24 bands of 5 values with a chance of (1 - s^5)^24, below 1e-4 at 0.8. What
either proposes is decided by the exact similarity of the whole sets, so nothing less
similar is linked.

A SimHash bucket of more than 64 nodes is treated as those of bands are:
buckets with the same members are one. Each member is compared with the
smallest of its bucket, its pivot; that settles every bucket of two and every bucket
of like texts with a pair a member. A pivot's pairs are dealt in parts of bounded
size, each with its own copy of the pivot's set. Members near the pivot are chained by
it, so in buckets of three or more only those unlike it are left, and Jaccard distance
is a metric: one that is further from the pivot than twice the distance allowed is
near no member that the pivot is near to. So the unlike are compared with each other,
and the nearer ones of them with the pivot's near ones, within tasks, through an index
of shingles. Larger sides are split into blocks that meet pairwise, so that a task
never holds more than two blocks and no pair is left out; the rows that meet grow with
the unlike members, and a bucket of copies with few of these stays linear.

Null and empty texts are equal sets; a text of fewer words than a shingle is one
shingle. Rows with a null id are linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import join_skewed, possible, written
from downfield.llm.simhash import block_masks, bucket_pairs, components, fingerprint_of, masked_buckets

#: Bands and values a band; members of a block of a large bucket.
BANDS, ROWS, MEMBERS = 24, 5, 1000
#: Differing bits of fingerprints up to which a SimHash bucket proposes a pair.
BITS = 12
_BLOCK = 1 << 12
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(data: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles."""
    w = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    found = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in found), np.uint64, len(found)))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed hash of each band's least values; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), _BLOCK):
        np.minimum(least, ((shingles[k : k + _BLOCK] ^ _XOR) * _ODD).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def with_sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, node, bands, fp) of each row; node is a hash of the whole set, fp its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, words) for x in b.column("text_").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(node), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(fp)], names=["doc_id", "text_hash", "node", "bands", "fp"])

    body = F.coalesce(F.col("text"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text_")).mapInArrow(run, f"doc_id {kind}, text_hash long, node long, bands array<long>, fp long")


def _with_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) from (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, words).view(np.int64) for x in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("binary").alias("text_")).mapInArrow(run, "node long, shingles array<long>")


def links_within(nodes: np.ndarray, sets: list[np.ndarray], at_least: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """Pairs that chain all nodes whose sets' similarity is at_least[0] / at_least[1] or more."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(flat, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    held, starts = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    ends, out, open_ = np.cumsum(sizes), [], np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first], reach = False, [first]
        while reach and open_.any():
            x = reach.pop()
            own = ids[ends[x] - sizes[x] : ends[x]]
            both = np.bincount(np.concatenate([held[starts[i] : starts[i + 1]] for i in own]), minlength=len(sets))
            near = np.flatnonzero(open_ & (at_least[1] * both >= at_least[0] * (sizes + sizes[x] - both)))
            open_[near] = False
            out += [(int(nodes[x]), int(nodes[y])) for y in near]
            reach += near.tolist()
    return out


def link_across(nodes: np.ndarray, sets: list[np.ndarray], ask: np.ndarray, at_least: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """One link of each set that asks to a set that doesn't and is near it, if there is one: the latter are chained already."""
    asked = np.flatnonzero(~ask)
    if not len(asked):
        return []
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate([sets[i] for i in asked]), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    held, starts = np.repeat(asked, sizes[asked])[order], np.searchsorted(ids[order], np.arange(len(values) + 1))
    out = []
    for x in np.flatnonzero(ask):
        own = np.searchsorted(values, sets[x])
        own = own[values[np.minimum(own, len(values) - 1)] == sets[x]]
        if len(own):
            both = np.bincount(np.concatenate([held[starts[i] : starts[i + 1]] for i in own]), minlength=len(sets))[asked]
            near = asked[at_least[1] * both >= at_least[0] * (sizes[asked] + sizes[x] - both)]
            out += [(int(nodes[x]), int(nodes[y])) for y in near[:1]]
    return out


def _judged(pairs: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """(pivot, node, near, within) of pairs with sets s and t: near as asked for; within twice that distance."""
    pairs = pairs.select("pivot", "node", (F.size("s") + F.size("t")).alias("sizes"), F.size(F.array_intersect("s", "t")).alias("both"))
    part, whole = at_least

    def least(share: int) -> Column:
        return whole * F.col("both") >= share * (F.col("sizes") - F.col("both"))

    return pairs.select("pivot", "node", least(part).alias("near"), least(2 * part - whole).alias("within"))


def _parts(count: str, members: int) -> Column:
    return F.greatest(F.ceil(F.col(count) / members), F.lit(1)).cast("int")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def meetings(proposed: DataFrame, judged: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """The nodes that meet once a bucket's pivot has judged its members, each group of two blocks at most.

    proposed: (key, node, n, pivot); judged: (pivot, node, near, within). Among the unlike of a bucket: (key, lo, hi, node).
    Between those within and the near ones: (key, lo, hi, node, ask), where ask marks the former.
    """
    ruled = proposed.where("n > 2 AND node != pivot").select("key", "node", "pivot").join(judged, ["pivot", "node"]).drop("pivot")
    count = ruled.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(~F.col("near")).alias("unlike"), F.count_if(~F.col("near") & F.col("within")).alias("middle"), F.count_if("near").alias("like"))
    count = written(count.where("unlike > 1 OR (middle > 0 AND `like` > 0)"), "unlike")
    ruled = written(join_skewed(ruled, count, "key", "rows"), "ruled")

    parts = _parts("unlike", members)
    among = ruled.where("NOT near AND unlike > 1").select("key", "node", _part(parts).alias("own"), _every(parts).alias("other"))
    among = among.select("key", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    lo, hi = _parts("like", members), _parts("middle", members)
    both = ruled.where("middle > 0 AND `like` > 0")
    asked = both.where("near").select("key", "node", _part(lo).alias("lo"), _every(hi).alias("hi"), F.lit(False).alias("ask"))
    asks = both.where("NOT near AND within").select("key", "node", _every(lo).alias("lo"), _part(hi).alias("hi"), F.lit(True).alias("ask"))
    return among, asked.unionByName(asks)


def _link_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def simhash_proposals(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the tables of fingerprints propose: pairs (pivot, node) of BITS differing bits or fewer, and (node, key) of large buckets.

    distinct: (node, fp); sets may share a fingerprint.
    """
    met = masked_buckets(distinct.select("fp", "node"), block_masks())
    pairs = bucket_pairs(met, BITS).select(F.col("b").alias("pivot"), F.col("a").alias("node")).distinct()
    return pairs, met.where("large").select("node", F.xxhash64("key").alias("key"))


def near_copies(docs: DataFrame, words: int = 5, at_least: tuple[int, int] = (4, 5), members: int = MEMBERS) -> DataFrame:
    """(doc_id, text_hash, node, component) of each row of docs (doc_id, text); rows of a component are near copies."""
    rows = written(with_sketches(docs, words), "sketches")
    distinct = rows.groupBy("node", "text_hash").agg(F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    distinct = distinct.groupBy("node").agg(F.min(F.struct("text_hash", "copies")).alias("text"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    distinct = written(distinct.where(F.size("bands") > 0).select("node", "text.*", "bands", "fp"), "distinct")
    close, crowds = simhash_proposals(distinct.select("node", "fp"))
    close = written(close, "close")
    banded = distinct.select("node", "text_hash", "copies", F.explode("bands").alias("key"))
    crowds = crowds.join(distinct.select("node", "text_hash", "copies"), "node").select("node", "text_hash", "copies", "key")
    keyed = written(banded.unionByName(crowds), "keyed")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.sum(F.xxhash64("node").cast("decimal(38, 0)")).alias("who")).where("n > 1")
    buckets = written(buckets.groupBy("n", "pivot", "who").agg(F.min("key").alias("key")).select("key", "n", "pivot", F.col("n").alias("members")), "buckets")
    proposed = written(join_skewed(possible(keyed, buckets, "key"), buckets, "key", "members"), "proposed")  # node, text_hash, copies, key, n, pivot

    either = close.select(F.explode(F.array("pivot", "node")).alias("node")).distinct()
    either = either.join(distinct, "node").select("node", "text_hash", "copies")
    chosen = written(proposed.select("node", "text_hash", "copies").unionByName(either).distinct(), "chosen")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = join_skewed(possible(texts, chosen, "text_hash"), chosen, "text_hash", "copies").groupBy("node").agg(F.min("text").alias("text"))
    sets = written(_with_sets(texts, words), "shingles")

    # A pivot's pairs in parts, by the largest bucket that a pair shares: each part has a copy of the pivot's set.
    parts = _parts("n", members)
    pairs = proposed.where("node != pivot").select("pivot", "node", "n").unionByName(close.withColumn("n", F.lit(2).cast("long"))).groupBy("pivot", "node").agg(F.max("n").alias("n")).select("pivot", "node", parts.alias("parts"), _part(parts).alias("part"))
    pairs = written(pairs, "pairs")
    # Both joins ask for the sets by node under the same names, so that these are dealt once.
    pivots = pairs.select(F.col("pivot").alias("node"), "parts", "part").distinct()
    pivots = pivots.join(sets, "node").select(F.col("node").alias("pivot"), "parts", "part", F.col("shingles").alias("s"))
    pairs = pairs.join(sets, "node").withColumnRenamed("shingles", "t").join(pivots, ["pivot", "parts", "part"])
    judged = written(_judged(pairs, at_least), "judged")

    among, across = meetings(proposed, judged, members)

    def members_of(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        return t.column("node").to_numpy(), [np.asarray(s, np.int64) for s in t.column("shingles").to_pylist()]

    def unlike(t: pa.Table) -> pa.Table:
        return _link_table(links_within(*members_of(t), at_least))

    def between(t: pa.Table) -> pa.Table:
        return _link_table(link_across(*members_of(t), t.column("ask").to_numpy(), at_least))

    links = judged.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    for met, run in ((among, unlike), (across, between)):
        links = links.unionByName(met.join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long"))
    classes = components(links)
    labels = rows.groupBy("node").agg(F.count("*").alias("copies")).join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "copies")
    return join_skewed(rows.drop("bands", "fp"), labels, "node", "copies").select("doc_id", "text_hash", "node", "component")
