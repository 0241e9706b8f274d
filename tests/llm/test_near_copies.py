"""The SimHash step of near copies."""

import pathlib
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from downfield.llm import copies, simhash
from downfield.llm.common import possible, shared_dir


@pytest.mark.parametrize(("blocks", "kept"), [(6, 2), (5, 3)])
def test_block_masks_meet_within_their_radius(blocks, kept):
    rng = random.Random(4)
    masks = simhash.block_masks(blocks, kept)
    assert len({*masks}) == len(masks)
    for _ in range(500):
        d = sum(1 << i for i in rng.sample(range(64), blocks - kept))
        assert any(not d & m for m in masks)


def _texts():
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(10, 390, 4)]
    return [*texts, " ".join(base), "", None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))]


def test_fingerprints_link_near_copies_without_bands(spark, monkeypatch):
    """SimHash tables alone, with a crowded bucket: what meets is decided by whole sets, and all 96 are chained."""
    sketches = copies.with_sketches
    no_band = F.when(F.size("bands") > 0, F.array("node")).otherwise(F.col("bands"))  # keys that no two nodes share
    monkeypatch.setattr(copies, "with_sketches", lambda docs, words: sketches(docs, words).withColumn("bands", no_band))
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in copies.near_copies(docs).collect()}
    assert len(got) == len(texts) and len(set(got.values())) == 3
    assert len({got[i] for i in range(96)}) == 1 and got[96] == got[97] != got[98]


def test_simhash_proposals_are_the_close_pairs(spark):
    """Fingerprints of up to 4 differing bits are all proposed, equal ones too; more than 12 never; a bucket of over 64 is handed on."""
    rng = random.Random(6)
    prints = []
    for _ in range(40):
        fp = rng.getrandbits(64)
        prints += [fp, fp, fp ^ sum(1 << i for i in rng.sample(range(64), 4)), fp ^ sum(1 << i for i in rng.sample(range(64), 14))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    crowd = [(rng.getrandbits(21) << 43) | 5 for _ in range(70)]
    rows = [(n, signed(fp)) for n, fp in enumerate([*prints, *crowd])]
    pairs, large = copies.simhash_proposals(spark.createDataFrame(rows, "node long, fp long"))
    found = {(r.pivot, r.node) for r in pairs.collect()}
    apart = lambda i, j: bin(prints[i] ^ prints[j]).count("1")
    assert {(i, j) for j in range(160) for i in range(j) if apart(i, j) <= 4} <= found
    assert all(i >= 160 or apart(i, j) <= 12 for i, j in found)
    assert {r.node for r in large.collect()} == set(range(160, 230))


def test_only_proposed_texts_are_joined(spark, monkeypatch):
    """Texts and keys that nothing proposes are passed over before the joins that shuffle them."""
    given, join = {}, copies.join_skewed

    def counted(rows, unique, key, count, **options):
        given[key] = max(given.get(key, 0), rows.count())
        return join(rows, unique, key, count, **options)

    monkeypatch.setattr(copies, "join_skewed", counted)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(300)]
    texts += [texts[0] + " more", texts[1] + " more"]
    got = copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.component for r in got}) == 300
    assert 4 <= given["text_hash"] < 20 and given["key"] < 302 * copies.BANDS / 4


def test_possible_keeps_every_wanted_key(spark):
    """Negative hashes and both ends of the map's rows; with a map of few bits some others stay, too."""
    keys = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, 7, 8, 32767, 32768, 65535, (1 << 25) - 1, 1 << 25, -32768]
    rows = spark.createDataFrame([(k + d,) for k in keys[2:] for d in (-3, 0, 3)] + [(k,) for k in keys[:2]], "key long")
    for k in keys:
        left = [r.key for r in possible(rows, spark.createDataFrame([(k,)], "key long"), "key").collect()]
        assert k in left and all((x - k) % (1 << 25) == 0 for x in left)
    assert possible(rows, spark.createDataFrame([(k,) for k in keys], "key long"), "key").where(F.col("key").isin(keys)).count() == rows.where(F.col("key").isin(keys)).count()
    assert possible(rows, rows.limit(0), "key").count() == 0


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """The tables that the model's fit and the near copies write go as soon as they aren't needed, so they don't fill the disk of later stages."""
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, " ".join(f"w{i % 9} v{j}" for j in range(40)), "a") for i in range(30)], "doc_id long, text string, source string")
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    folder = pathlib.Path(urlparse(shared_dir(spark)).path, "downfield")
    before = {p.name for p in folder.glob("*")}
    scored = C.drop_toxic(spark, docs, f"file://{tmp_path}")
    assert {p.name for p in folder.glob("*")} == before
    kept = C.drop_near_copies(spark, docs, "")
    assert [x.rpartition("-")[0] for x in {p.name for p in folder.glob("*")} - before] == ["near-copies"]
    assert scored.count() <= 30 and kept.count() == 9
