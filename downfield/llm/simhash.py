"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.
For radius r, every bit position gets a non-zero vector of r + 1 bits; for each
non-zero vector v there is a mask of the positions whose vector has an odd product
with v. Two fingerprints that differ at r or fewer positions agree under at least one
mask, as r linear conditions on v leave a non-zero solution: no pair is lost.

Only distinct fingerprints go into the 2 ** (r + 1) - 1 tables, each with the smallest
id of its copies, so copies never meet as pairs. Buckets are counted by an aggregate.
In a bucket of few members these are compared by their differing bits, and only close
ones leave it. The members of larger buckets are linked exactly through the points of
Hamming distance r / 2 or less around them: two fingerprints are within r if and only
if such balls meet, and a point is in at most 1 + 64 balls (r = 2), so every group is
bounded whatever the data. Links become classes by alternating large-star and
small-star steps on DataFrames.

Nulls and empty texts have no shingle; their fingerprint is zero and is linked like
any other. Rows with a null id get the class of their fingerprint's other rows, null
if there is none; they link nothing. Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from downfield.llm.common import join_skewed, written

_BLOCK = 1 << 15
#: Fingerprints of a bucket that are compared in their table.
MEMBERS = 64


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, count: int) -> int:
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingles given by their hashes."""
    return _majority(sum((_ones(hashes[k : k + _BLOCK]) for k in range(0, len(hashes), _BLOCK)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    w = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(shingles), _BLOCK):
        part = shingles[k : k + _BLOCK]
        h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        ones += _ones(h)
    return _majority(ones, len(shingles))


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """The columns keep and fp, the fingerprint as a signed long."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column("text_").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text_")).mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask (signed) for each non-zero vector of radius + 1 bits."""
    count = (1 << (radius + 1)) - 1
    of = [1 + i % count for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if bin(of[i] & v).count("1") % 2) for v in range(1, count + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_masks(blocks: int = 6, kept: int = 2, bits: int = 64) -> list[int]:
    """One mask (signed) for each choice of kept blocks of the bits: what differs at blocks - kept positions or fewer agrees under one."""
    masks = [sum(1 << i for i in range(bits) if i * blocks // bits in chosen) for chosen in combinations(range(blocks), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips() -> Column:
    return F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)))


def _close_members(members: Column, radius: int, most: int) -> Column:
    """Array of (a, b), a > b, of the nodes in a bucket's (fp, node) that differ at radius bits or fewer."""
    def later(x: Column, i: Column) -> Column:
        near = F.filter(F.slice(members, i + 2, F.lit(most)), lambda y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)
        return F.transform(near, lambda y: F.struct(F.greatest(x["node"], y["node"]).alias("a"), F.least(x["node"], y["node"]).alias("b")))

    return F.flatten(F.transform(members, later))


def _ball_links(prints: DataFrame) -> DataFrame:
    """(a, b) that chain all fingerprints within 2 bits, through the points at most one bit away; prints: (fp, node)."""
    points = prints.select("node", F.explode(_flips()).alias("flip"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    balls = points.groupBy("point").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    chain = F.transform(F.slice("nodes", 2, 64), lambda x: F.struct(F.element_at("nodes", 1).alias("b"), x.alias("a")))
    return balls.select(F.explode(chain).alias("l")).select("l.a", "l.b")


def masked_buckets(distinct: DataFrame, masks: list[int], members: int = MEMBERS) -> DataFrame:
    """(key, fp, node, large) of the buckets of two fingerprints or more; large: of more than members. distinct: (fp, node)."""
    keyed = distinct.select("fp", "node", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("v", "mask"))
    keyed = keyed.select("fp", "node", F.struct("v", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", (F.col("n") > members).alias("large"))
    return written(join_skewed(keyed, shared, "key", "n", total=len(masks) * distinct.count()), "buckets")


def bucket_pairs(met: DataFrame, radius: int, members: int = MEMBERS) -> DataFrame:
    """(a, b), a > b, of the nodes that differ at radius bits or fewer, within the buckets that aren't large."""
    few = met.where("NOT large").groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("members"))
    return few.select(F.explode(_close_members(F.col("members"), radius, members)).alias("l")).select("l.a", "l.b")


def covering_links(distinct: DataFrame, radius: int = 2, members: int = MEMBERS) -> DataFrame:
    """(a, b) of node ids that chain all fingerprints within the radius; distinct: (fp, node), each fp once.

    Buckets of at most members fingerprints are settled in their table, larger ones by balls.
    """
    if radius != 2:
        raise ValueError("the exact step of large buckets is written for a radius of 2")
    met = masked_buckets(distinct, covering_masks(radius), members)
    return bucket_pairs(met, radius, members).unionByName(_ball_links(met.where("large").select("fp", "node").distinct())).distinct()


def components(links: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); only nodes that have a link.

    Alternating large-star and small-star steps; each round's links are written to
    the shared folder, and a round that changes nothing ends the loop. Hubs with more
    than a thousandth of all links meet their smallest neighbour by broadcast, in both
    steps.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())

    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    now = state(edges)
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_skewed(both.where("b > a"), least, "a", "n", total=2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_skewed(large, low, "a", "n", total=now[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        new = written(small, name)
        then, now = now, state(new)
        if now == then:
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = new
    raise RuntimeError(f"the classes are not settled after {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for each row of docs."""
    prints = written(with_fingerprints(docs, [key], text, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("node"), F.count("*").alias("copies")), "distinct")
    classes = components(covering_links(distinct.where("node is not null").select("fp", "node"), radius))
    labels = distinct.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "copies")
    return join_skewed(prints, labels, "fp", "copies").select(key, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
