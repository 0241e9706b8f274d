"""Corpus operators: brute force, round trips, held-out accuracy, and rows with nulls, ties, repeats and clashing names."""

import hashlib
import random
import time
import zlib
from collections import Counter
from math import exp, log, log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from downfield.llm import chat, copies, decontam, lm, mixing, quality, rules, simhash, tokens, toxicity, warc
from downfield.llm.common import scratch
from downfield.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, label int"
ODD = ["", None, " \t\n", "one", "one two", "The the THE the the", "ä ß 漢字 <|im_end|> \\ <\\|", "x" * 5000, "a b c " * 3000]


def odd_docs(spark):
    """Odd texts, repeated rows, null ids and sources, and columns whose names operators use themselves."""
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 2}", 0, 0.5, 1, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "one two", None, "s1", None, None, None, None)], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = ", ".join(sorted(df.columns))
    norm = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert norm(df.select(*sorted(df.columns)).collect() and [tuple(r) for r in df.select(*sorted(df.columns)).collect()]) == norm(con.execute(f"SELECT {cols} FROM ({ORACLE_SQL[name]})").fetchall())


def test_odd_rows(spark):
    docs, empty = odd_docs(spark), odd_docs(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c a b c a b c"), (2, None), (3, "one two")], "item_id long, text string")
    for df, n in ((docs, len(ODD) + 2), (empty, 0)):
        usable = F.lit(True)
        assert toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels, usable), ["doc_id"]).where("score = 0.5").count() == n
        assert quality.score_quality(df, quality.fit_quality(df, labels, usable), ["doc_id"]).where("score = 0.5").count() == n
        assert simhash.near_duplicates(df).count() == n
        assert mixing.mix(df).count() == n
        assert rules.ledger(df).count() == n
        assert lm.score_documents(df).count() == n
        assert tokens.token_digests(df, tokenizer_path()).count() == n
        assert [r.doc_id for r in decontam.contaminations(df, bench).collect()] == [8] * (n > 0)
        assert decontam.without_contaminated(df, bench).count() == max(n - 1, 0)


def _components(prints):
    best = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and best[b] < best[a]:
                    best[a], changed = best[b], True
    return best


@pytest.mark.parametrize("members", [64, 4, 1])
def test_simhash_links_all_pairs(spark, members):
    """Settled in the tables, in part, or by balls alone, the classes are those of all pairs."""
    rng = random.Random(5)
    prints, base = {}, rng.getrandbits(64)
    for i in range(150):
        x = base if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        prints[i] = base = x
    nodes = {}
    for i, x in prints.items():
        nodes.setdefault(x, i)
    signed = [(x - (1 << 64) if x >> 63 else x, i) for x, i in nodes.items()]
    found = {r.node: r.component for r in simhash.components(simhash.covering_links(spark.createDataFrame(signed, "fp long, node long"), members=members)).collect()}
    assert {i: found.get(nodes[x], nodes[x]) for i, x in prints.items()} == _components(prints)


def test_tables_settle_small_buckets(spark, monkeypatch):
    """Only fingerprints of buckets above the bound get ball points; a bucket of thousands is one class."""
    given, balls = [], simhash._ball_links
    monkeypatch.setattr(simhash, "_ball_links", lambda prints: given.append(prints.count()) or balls(prints))
    rng = random.Random(9)
    few = [(rng.getrandbits(62), i) for i in range(300)]
    few += [(x ^ (1 << rng.randrange(62)), 1000 + i) for x, i in few[:100]]
    found = simhash.covering_links(spark.createDataFrame(few, "fp long, node long")).collect()
    assert {(1000 + i, i) for i in range(100)} <= {(r.a, r.b) for r in found} and given == [0]
    near = [(1 << i | 1 << j, 5000 + 64 * i + j) for i in range(60) for j in range(i)]
    classes = simhash.components(simhash.covering_links(spark.createDataFrame([(0, 7), *near], "fp long, node long"))).collect()
    assert len(classes) == 1 + len(near) and {r.component for r in classes} == {7} and given[1] > 64


def test_covering_masks_hold_every_pair():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m & (1 << i | 1 << j)) for m in masks)


def test_fingerprint_by_hand(spark):
    text = "B a c A b"
    got = simhash.fingerprint(text.encode())
    hashes = [r[0] % (1 << 64) for r in spark.sql("select explode(transform(array('b a c', 'a c a', 'c a b'), x -> xxhash64(x)))").collect()]
    assert got == sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_warc_round_trip(spark):
    big = "y" * 1500
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/ x", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, None, big), (-7, "n", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index, folder = warc.archive(pages)
    got = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, folder).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(k, len((h or "").encode()), sha(h), "revisit" if h == big and k != 2 else "response", 2 if h == big and k != 2 else None) for k, _, h in rows]
    assert got == sorted(want, key=str)
    few = warc.read_archives(index.where("key in (3, 5)"), folder)
    assert sorted(r.key for r in few.collect()) == [3, 5]


def test_tiles_find_reordered_passages():
    words = [f"w{i}" for i in range(40)]
    text = " ".join(["filler", *words[20:], "other things", *words[:20], "end"])
    block = decontam.benchmark_block([(9, " ".join(words)), (8, "too short")], 5, 0.5)
    found = list(decontam.matches([b"", text.encode(), " ".join(words[:12]).encode()], block, 0.5))
    assert found == [(1, 0, 1.0, 40, 20)]


def _plain_tiling(item, doc, seed):
    """Greedy string tiling by definition: all pairs of places, the longest free run first."""
    in_item, in_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not in_item[a + n] and not in_doc[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < seed:
            return out
        in_item[a : a + n], in_doc[b : b + n] = [True] * n, [True] * n
        out.append((a, b, n))


def _decontaminated(docs, bench, threshold=0.5):
    """All pairs by plain tiling."""
    out = []
    for i, t in docs:
        doc = decontam.tokens((t or "").encode())
        for k, u in bench:
            item = decontam.tokens((u or "").encode())
            tiles = _plain_tiling(item, doc, 5)
            marked = sum(x[2] for x in tiles)
            if tiles and marked >= threshold * len(item):
                out.append((i, k, round(marked / len(item), 9), marked, max(x[2] for x in tiles)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [8 << 20, 10])
def test_decontamination_equals_plain_tiling(spark, block_bytes):
    """Random repetitive texts over few words, by broadcast and by joins on seeds."""
    rng = random.Random(8)
    run = lambda n, signs: " ".join(rng.choice(signs) for _ in range(n))
    bench = [(k, run(rng.randrange(3, 30), "abc" if k % 2 else "abcdefgh")) for k in range(14)] + [(99, None), (None, "p q r s t u")]
    docs = [(i, " ".join([run(rng.randrange(10), "abcdefgh"), bench[i % 14][1], run(rng.randrange(10), "xyz"), bench[(i + 5) % 14][1][6:]])) for i in range(24)] + [(50, ""), (51, None), (52, "p q r s t")]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.item_id, round(r.coverage, 9), r.marked_words, r.longest_tile) for r in decontam.contaminations(*args, block_bytes=block_bytes).collect()]
    want = _decontaminated(docs, bench)
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20
    kept = sorted(r.doc_id for r in decontam.without_contaminated(*args, block_bytes=block_bytes).collect())
    assert kept == sorted({i for i, _ in docs} - {r[0] for r in want})


def test_tiling_equals_plain_tiling():
    rng = np.random.default_rng(3)
    for _ in range(150):
        item, doc = (rng.integers(1, rng.integers(2, 6), rng.integers(5, 40)).astype(np.uint64) for _ in range(2))
        assert decontam.tile(item, doc, 3) == _plain_tiling(item.tolist(), doc.tolist(), 3)


def test_repetitive_texts_stay_small():
    """A repetitive item and document: memory is linear in both."""
    import tracemalloc

    rng = random.Random(1)
    line = " ".join(rng.choice("ab") for _ in range(9))
    item, doc = " ".join([line] * 400), " ".join([line + " c"] * 4000)
    block = decontam.benchmark_block([(1, item)], 5, 0.5)
    tracemalloc.start()
    found = list(decontam.matches([doc.encode()], block, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][:3] == (0, 0, 1.0) and peak < 100e6


def test_lm_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(docs, block_bytes=200).collect()}
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)] for w in (t.split() for t in texts)]
    total = [sum((g[n] for g in grams), Counter()) for n in range(3)]
    size = sum(total[0].values())
    for i, t in enumerate(texts):
        w, left, want = t.split(), [total[n] - grams[i][n] for n in range(3)], 0.0
        rest = size - len(w)
        for k in range(len(w)):
            for n in range(min(k, 2), -1, -1):
                g = tuple(w[k - n : k + 1])
                if left[n][g] or n == 0:
                    base = (left[n][g] / (left[n - 1][g[:-1]] if n else rest)) if left[n][g] else 1 / (rest + 1)
                    want += log10(base) + (min(k, 2) - n) * log10(0.4)
                    break
        assert got[i].n_words == len(w) and got[i].log10_score == pytest.approx(want)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    enc, rng = tokens.CachingEncoder(tokenizer_path(), 50), random.Random(1)
    assert enc.by_piece
    signs = ["a", "Bc", " ", "  ", "\n", ".", ",", "é", "1", "'s", "\t", "!?", "<|endoftext|>", "漢", "\xa0", "end.\nNext", "ß,", "\r\n"]
    texts = ["hi <|endoftext|> x", *("".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(4000))]
    for t in texts:
        assert list(np.frombuffer(enc.encode(t), "<u4")) == fresh.encode(t, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(enc.encode(texts[0]), "<u4")
    enc.by_piece = False
    assert all(list(np.frombuffer(enc.encode(t), "<u4")) == fresh.encode(t, add_special_tokens=False).ids for t in texts[:50])


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 1 << int(b), int(n)).astype(np.uint32) for b, n in zip(rng.integers(1, 25, 30), rng.integers(0, 900, 30), strict=True)]
    held = tokens.TokenFile(tokens.encode_file([None, *range(29)], ids))
    flat = np.concatenate(ids)
    assert held.doc_ids[:2] == [None, 0]
    assert all(held.token(int(i)) == flat[i] for i in rng.integers(0, len(flat), 300))
    assert all((held.slice(int(held.starts[i]), int(held.starts[i + 1])) == ids[i]).all() for i in range(30))


def test_token_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = 0
    got = {r.doc_id: r for r in QUERIES["op9_token_ids"](spark, SF).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_classifiers_on_held_out_rows(spark):
    """Insults with unseen endings, and shouted junk, from rows that were not learned."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "sha", "le"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randrange(20, 60))]
        toxic, bad = i % 3 == 0, i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = "zork" + word()
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), int(not bad), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    usable, held = F.col("doc_id") % 5 != 0, "doc_id % 5 = 0"
    for label, fit, score in (("toxic", toxicity.fit_toxicity, toxicity.score_toxicity), ("quality", quality.fit_quality, quality.score_quality)):
        out = score(df, fit(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), usable), ["doc_id", label]).where(held)
        assert out.where((F.col("score") >= 0.7).cast("int") == F.col(label)).count() >= 0.95 * out.count()


def _kneser_ney(words, order, discount, strength):
    """By definition, over words (bytes: documents of each class): share of byte x after h in a class."""
    full, kinds = Counter(), set()
    for w, n in words.items():
        s = b"\x02" + w + b"\x03"
        for i in range(1, len(s)):
            for c in (0, 1):
                full[c, s[max(0, i + 1 - order) : i + 1]] += n[c]
            kinds |= {s[i + 1 - k : i + 1] for k in range(2, order + 1) if i + 1 >= k}
    before = Counter(k[1:] for k in kinds)

    def lower(h, x):
        own = {g: n for g, n in before.items() if g[:-1] == h}
        freed = sum(min(n, discount) for n in own.values())
        return (max(own.get(h + x, 0) - discount, 0) + freed * (lower(h[1:], x) if h else 1 / 256)) / sum(own.values())

    def share(c, h, x):
        tables = [{g: full[k, g] for k, g in list(full) if k == y and g[:-1] == h} for y in (0, 1)]
        pooled = {g: tables[0].get(g, 0) + tables[1].get(g, 0) for g in tables[0] | tables[1]}
        own = tables[c]
        freed = sum(min(n, discount) for n in pooled.values())
        both = (max(pooled.get(h + x, 0) - discount, 0) + freed * lower(h[1:], x)) / sum(pooled.values())
        freed = sum(min(n, discount) for n in own.values())
        return (max(own.get(h + x, 0) - discount, 0) + (freed + strength) * both) / (sum(own.values()) + strength)

    contexts = {g[:-1] for (_, g), n in full.items() if n}
    return share, contexts


def test_kneser_ney_equals_definition_and_sums_to_one():
    rng = random.Random(6)
    words = {}
    for _ in range(25):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
        words[w] = [rng.randrange(0, 5), rng.randrange(0, 3)]
    words = {w: n for w, n in words.items() if sum(n)}
    share, contexts = _kneser_ney(words, 3, 0.75, 3.0)
    names = sorted(words)
    table = {}
    for n in (2, 3):
        packed, place, word = toxicity.grams(names, n)
        for k, p, w in zip(packed.tolist(), place.tolist(), word.tolist(), strict=True):
            if p >= n - 1:
                whole = n == 3 or k >> 8 * (n - 1) == 2
                have = table.setdefault(k, [whole, 0, 0])
                have[1], have[2] = have[1] + words[names[w]][0], have[2] + words[names[w]][1]
    ends = Counter(int(toxicity.without_first(np.array([k], np.uint64))[0]) for k in table)
    full = sorted(k for k, v in table.items() if v[0])
    model = toxicity.build_model(np.array(full, np.uint64), tuple(np.array([table[k][c] for k in full], float) for c in (1, 2)), np.array(sorted(ends), np.uint64), np.array([ends[k] for k in sorted(ends)], float), order=3)
    unpack = lambda k: int(k).to_bytes(8, "big").lstrip(b"\0")
    for k, e in zip(model.grams, model.evidence, strict=True):
        g = unpack(k)
        assert e == pytest.approx(log(share(1, g[:-1], g[-1:]) / share(0, g[:-1], g[-1:])))
    for h, e in zip(model.contexts, model.other, strict=True):
        h = unpack(h)
        assert e == pytest.approx(log(share(1, h, b"z") / share(0, h, b"z")))
        for c in (0, 1):
            assert sum(share(c, h, bytes([x])) for x in range(256)) == pytest.approx(1)
    assert {unpack(h) for h in model.contexts} == contexts


def test_chat_is_reversible(spark):
    rows = [(1, 0, "user", "a\\|b"), (1, 1, "user", "<|im_join|>"), (1, 2, "assistant", None), (1, 3, "assistant", "x<|im_end|>\n"), (2, None, "a\nb\\n", "<"), (2, 1, None, "|>"), (None, 1, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].t] == [("user", "a\\|b"), ("user", "<|im_join|>"), ("assistant", ""), ("assistant", "x<|im_end|>\n")]
    assert out[1].formatted.count(chat.START) == 2 and out[1].loss == "x<|im_end|>\n"
    assert [tuple(t) for t in out[2].t] == [("a\nb\\n", "<"), ("", "|>")] and out[None].loss == "ok"


def test_long_chats_are_linear_and_keep_one_exchange(spark):
    rows = spark.range(20000).selectExpr("id div 100000 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    out = chat.format_conversations(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(conv_id") == 1
    got = out.select(F.size("loss_spans").alias("n"), F.element_at("loss_spans", -1).alias("last"), "formatted").collect()[0]
    assert got.n == 10000 and got.formatted[got.last.start : got.last.start + got.last.length] == "t19999"


@pytest.mark.parametrize("turns", [20_000, 80_000])
def test_long_chats_are_read_back_whole(spark, turns):
    rows = spark.range(turns).selectExpr("0L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('<|ä', id) as text")
    began = time.time()
    (got,) = chat.digests(chat.format_conversations(rows)).collect()
    assert time.time() - began < 60
    told = "".join(f"{'assistant' if i % 2 else 'user'}\n<|ä{i}\n" for i in range(turns))
    loss = "".join(f"<|ä{i}" for i in range(1, turns, 2))
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (turns, hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mix_without_ids_agrees_however_rows_lie(spark):
    rows = [(None, f"w{i} " * (i % 7), f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(mixing.mix(df.repartition(n), keep=("text",)).select("text", "size", "taken").collect()) for n in (1, 7))
    assert one == other


def test_tokens_of_many_lines():
    """Texts of one-word lines, long ones too, and lines that can't be cut alone."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain, own = Tokenizer.from_file(path), tokens.CachingEncoder(path)
    texts = ["\n".join(f"w{'abc'[i % 3]}x" for i in range(100_000)), "\n".join(["one,", "two.", "", " three", "four;", "5", "six", "seven!!"] * 300), "x\n" * 700, "\n" * 900, "a\n b\nc,\n\td", "end.\n"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_rules_ablation(spark):
    held = rules.ledger(spark.createDataFrame([(1, "a b " * 40), (2, "few"), (3, " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in rules.apply_policy(held, "v1").collect()} == {1: False, 2: False, 3: True}
    assert {r.rule: (r.failed, r.removed_alone) for r in rules.ablations(held, "v1").collect()}["few_words"] == (1, 1)


def test_mix_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s0" if i % 3 else "s1") for i in range(3000)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    for r in mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 8
    early = mixing.training_order(mixed).where("position < 0.5").groupBy("target").agg(F.sum("size").alias("n")).collect()
    assert max(r.n / r.target for r in early) > 0.55  # the first source's weight falls with time


def _plain_score(model, text):
    """Score by definition: a word at a time, all windows."""
    e = [float(model.of_words([w])[0]) for w in toxicity.tokens(text)]
    best = lambda n: max(sum(e[i : i + n]) / n for i in range(len(e) - n + 1)) if e else 0.0
    x = [sum(e) / len(e) if e else 0.0, *(best(min(n, len(e))) for n in model.windows)]
    return 1 / (1 + exp(-(sum(a * b for a, b in zip(x, model.weights[:-1], strict=True)) + model.weights[-1])))


def _plain_near_copies(docs):
    """The smallest id of each class of texts chained by a Jaccard similarity of 0.8 of their 5-word shingles, over all pairs."""
    words = [(t or "").encode().lower().split() for _, t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    return {min(docs[i][0] for i in range(len(docs)) if label[i] == v) for v in set(label)}


def _plain_mix(docs):
    """(position, doc_id) of all times that documents are taken; docs: (doc_id, text, source)."""
    size = {i: len((t or "").encode().split()) for i, t, _ in docs}
    source = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    whole = {s: sum(size[i] for i, _, o in docs if o == s) for s in source}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(source)}
    ramp = {s: (-0.6, 0.0, 0.6)[k % 3] for k, s in enumerate(source)}
    target, left, open_ = {}, 1.5 * sum(whole.values()), set(source)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * whole[s]}
        for s in full or set(open_):
            target[s] = 2.0 * whole[s] if s in full else level * weight[s]
            left -= target[s]
        open_ -= full or set(open_)
    out = []
    for s in source:
        ahead = 0
        for i in sorted((i for i, _, o in docs if o == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            passes = int(target[s] // whole[s]) if whole[s] else 0
            times = passes + (2 * ahead + size[i] <= 2 * (target[s] - passes * whole[s])) if size[i] else 0
            for p in range(times):
                q, g = min((p * whole[s] + ahead) / target[s], 1.0), ramp[s]
                out.append((q if not g else (((1 - g) ** 2 + 4 * g * q) ** 0.5 - (1 - g)) / (2 * g), i))
            ahead += size[i]
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    """Every stage in plain Python over the whole small table, each on what the one before kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from downfield.llm.common import held_out, table
    from downfield.llm.queries import CUT

    tables = {n: table(spark, SF, n) for n in ("documents", "labels", "benchmark")}
    model = toxicity.fit_toxicity(tables["documents"], tables["labels"], ~held_out(F.col("doc_id"), 3, 1))
    docs = [(r.doc_id, r.text, r.source) for r in tables["documents"].collect()]
    docs = [d for d in docs if _plain_score(model, d[1] or "") < CUT]
    stay = _plain_near_copies([d[:2] for d in docs])
    docs = [d for d in docs if d[0] in stay]
    bad, items = set(), [(r.item_id, decontam.tokens((r.text or "").encode())) for r in tables["benchmark"].collect()]
    seeds = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    seeds_of = [(w, seeds(w)) for _, w in items]
    for i, text, _ in docs:
        words = decontam.tokens((text or "").encode())
        own = seeds(words)
        for item, s in seeds_of:
            if len(s & own) * 5 >= len(item) / 2 and sum(n for *_, n in _plain_tiling(item, words, 5)) * 2 >= len(item):
                bad.add(i)
    docs = [d for d in docs if d[0] not in bad]
    mixed = _plain_mix(docs)
    lib, text, start, want = Tokenizer.from_file(tokenizer_path()), {i: t for i, t, _ in docs}, 0, []
    for i in sorted(i for _, i in mixed):
        ids = np.array([*lib.encode(text[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in C.run(spark, SF).collect())
    assert got == want and bad and len(stay) < len(tables["documents"].collect())


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns and no rows at all."""
    import corpus_pipeline as C

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "a", 1), (2, long, "a", 2), (2, long, "a", 2), (None, long, "a", 3), (None, "only here without an id", None, 4), (None, "only here without an id", None, 5), (7, None, "b", 6), (8, "", "b", 7), (9, "some other words stand here", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int").withColumns({"positions": F.lit("p"), "size": F.lit("s"), "order": F.lit("o"), "__flag": F.lit(True), "text_": F.lit("t"), "__score": F.lit(0.9), "score": F.lit("s"), "a.b": F.lit(1), "row": F.lit(2), "body": F.lit("c"), "doc": F.lit(0)})
    kept = C.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, long), (7, None), (9, "some other words stand here"), (None, "only here without an id")], key=str)
    mixed = C.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = mixed.groupBy("doc_id", "fp", "text").count().collect()
    assert all(r["count"] <= 2 * 2 and r.text for r in taken) and any(r.doc_id is None for r in taken)
    for name in ("labels", "benchmark"):
        schema = "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string"
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for stage in (C.drop_toxic, C.drop_benchmark):
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and out.count() == len(rows)
    assert C.encode_tokens(spark, docs, "").count() == len(rows)
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def _grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _noisy(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("members", [1000, 7])
def test_near_copies_equal_brute_force(spark, members):
    """All pairs of a similarity of 0.8 or more are chained, no others, with small blocks too."""
    rng = random.Random(11)
    texts = ["", None, "one two", "One  two", "one two three"]
    for _ in range(12):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300)))
        texts += [_noisy(rng, base, rng.randrange(0, 9)) for _ in range(8)]
        drift = base
        for _ in range(6):
            texts.append(drift := _noisy(rng, drift, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in copies.near_copies(docs, members=members).collect()}
    label, grams = list(range(len(texts))), list(map(_grams, texts))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    assert len({(got[i], label[i]) for i in got}) == len(set(got.values())) == len(set(label))


def _chained(nodes, links):
    label = {x: x for x in nodes}
    for a, b in links:
        old, new = label[a], label[b]
        label = {x: new if v == old else v for x, v in label.items()}
    return {frozenset(x for x in nodes if label[x] == v) for v in label.values()}


@pytest.mark.parametrize("members", [5, 1000])
def test_meetings_lose_no_link(spark, members):
    """Whatever the sets of a bucket, what its pivot leaves unlinked is found where the rest meet."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(4):
        x = rng.choice(500, 100, replace=False)
        for _ in range(14):  # drifts away from the pivot, step by step
            x = np.concatenate([rng.permutation(x)[: 100 - rng.integers(2, 14)], rng.integers(500, 10**6, rng.integers(1, 12))])
            sets.append(np.unique(x))
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]

    def share(x, y):
        both = len(np.intersect1d(x, y))
        return both / (len(x) + len(y) - both)

    n = range(len(sets))
    proposed = spark.createDataFrame([(1, i, len(sets), 0) for i in n], "key long, node long, n long, pivot long")
    pairs = spark.createDataFrame([(0, i, sets[0].tolist(), sets[i].tolist()) for i in n if i], "pivot long, node long, s array<long>, t array<long>")
    judged = copies._judged(pairs, (4, 5))
    among, across = copies.meetings(proposed, judged, members)
    links, groups = [(r.node, 0) for r in judged.where("near").collect()], {}
    for kind, met in (("among", among), ("across", across)):
        for r in met.collect():
            groups.setdefault((kind, r.lo, r.hi), []).append((r.node, r.ask if kind == "across" else None))
    for (kind, *_), rows in groups.items():
        assert len(rows) <= 4 * members
        ids, held = np.array([i for i, _ in rows]), [sets[i] for i, _ in rows]
        links += copies.links_within(ids, held) if kind == "among" else copies.link_across(ids, held, np.array([a for _, a in rows]))
    exact = [(i, j) for i in n for j in range(i) if share(sets[i], sets[j]) >= 0.8]
    assert _chained(n, links) == _chained(n, exact) and len(_chained(n, exact)) > 1
    assert {k for k, *_ in groups} == {"among", "across"}


def test_a_bucket_of_copies_with_one_unlike_member_is_linear(spark):
    n = 50_000
    proposed = spark.range(n).selectExpr("1L AS key", "id AS node", f"{n}L AS n", "0L AS pivot")
    for within, rows in ((True, n - 2 + 50), (False, 0)):
        judged = spark.range(1, n).selectExpr("0L AS pivot", "id AS node", "id != 9 AS near", f"(id != 9 OR {within}) AS within")
        among, across = copies.meetings(proposed, judged, 1000)
        assert among.count() == 0 and across.count() == rows


def test_links_reach_past_the_first_member():
    """A member that is unlike the smallest of its bucket is chained through another."""
    sets = [np.arange(0, 90), np.arange(10, 100), np.arange(20, 110), np.arange(500, 590)]
    found = copies.links_within(np.array([5, 6, 7, 8]), sets)
    assert sorted(found) == [(5, 6), (6, 7)]


def test_stage_removes_near_copies(spark):
    """Two changed words in 200 put 3-word fingerprints far more than 2 bits apart."""
    import corpus_pipeline as C

    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, _noisy(rng, t, 2)) for i, t in enumerate(base)] + [(None, _noisy(rng, base[0], 2)), (None, "no id " + base[0][::-1])]
    far = [bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") > 2 for (_, a), (_, b) in zip(rows[:20], rows[20:40], strict=True)]
    assert any(far)
    kept = C.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([*range(20), None], key=str)


def test_mixing_query_has_positions_in_order(spark):
    df = QUERIES["op4_mixing"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(first_position" in plan and "Python" not in plan
    rows = df.collect()
    first = [r.first_position for r in rows if r.taken]
    assert first and first == sorted(first) and all(0 <= r.first_position <= r.last_position <= 1 for r in rows if r.taken)
    assert all((r.first_position is None) == (r.taken == 0) for r in rows) and [bool(r.taken) for r in rows] == sorted((bool(r.taken) for r in rows), reverse=True)
    assert any(r.first_position < r.last_position for r in rows if r.taken > r.size)


def test_mixing_stage_writes_training_order(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "s0" if i % 3 else "s1") for i in range(600)], "doc_id long, text string, source string").repartition(5)
    want = sorted((p, r.doc_id) for r in mixing.mix(docs).collect() for p in r.positions)
    assert [r.doc_id for r in C.mix_sources(spark, docs, "").collect()] == [i for _, i in want]
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    read = spark.read.parquet(path)
    assert set(mixing.numbered(read).select("file", "row").distinct().collect()).__len__() == 600
    assert [r.doc_id for r in C.mix_sources(spark, read, "").collect()] == [i for _, i in want]
    both = mixing.numbered(read.unionByName(read.limit(5)))  # rows of a file that are read twice are not one row
    assert both.select("file", "row").distinct().count() == 605
