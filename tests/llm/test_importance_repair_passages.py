"""Resampling, conversation repair and substring dedup: brute force on small rows, rows of every odd kind, and small blocks that cut conversations and files."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from downfield.llm import importance, repair, substrings

DOCS = "doc_id long, text string, source string, score double, rank long, h long, tie long, file long, row long, repeats int"
ODD = [None, "", " \t\n", "one", "ä ß 漢字 <|x|>", "A-b c1 " * 3000, "w" * 5000, "a b c d e f g h i j k l m n o p q r s t u v"]


def odd_docs(spark):
    """Odd texts, a repeated row, null ids (one repeated), and columns named as the operators name theirs."""
    rows = [(i, t, None, 0.5, 1, 1, 1, 1, 1, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, ODD[7], *[None] * 8), (None, ODD[7], *[None] * 8)], DOCS)


# Resampling


def plain_resample(docs, target, percent, least, buckets, seed=2024):
    cut = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    of = lambda w: zlib.crc32(w) % buckets
    s, t = (Counter(of(w) for x in part for w in cut(x)) for part in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = cut(x)
        weight = sum(gain[of(f)] for f in w)
        out.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize("percent", [0, 10, 55, 100])
def test_resampling_equals_plain(spark, percent):
    rng = random.Random(percent)
    docs = [(i // 2 if i % 7 == 0 else None if i % 31 == 0 else i, " ".join(rng.choice("ab cd ef Gh ij kl mn é7".split()) for _ in range(rng.randrange(9)))) for i in range(300)]
    target = ["ab ab cd", None, "é7"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 3, 50, pivots=2).collect()
    rows, drawn = plain_resample(docs, target, percent, 3, 50)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(key(r[:4]) for r in got) == sorted(key(r) for r in rows)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(r[0], r[3]) for r in drawn]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))


def test_longer_runs(spark):
    of = importance._Buckets(1000)
    found, n = importance.bucket_list("A b, c".encode(), of, runs=3)
    assert n == 3 and found.tolist() == [zlib.crc32(x) % 1000 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]


def test_kth_key_is_exact_with_ties_in_all_but_the_last_column(spark):
    rows = spark.range(500).select(*(F.lit(7).cast("long").alias(c) for c in importance._KEY[:-1]), F.col("id").alias("row"))
    for k in (1, 2, 250, 499, 500):
        assert importance.kth_key(rows, k, pivots=3)[-1] == k - 1


def test_resampling_of_odd_rows(spark):
    docs, target = odd_docs(spark), spark.createDataFrame([("one",), (None,)], "text string")
    got = importance.resample(docs, target, percent=50).collect()
    assert len(got) == len(ODD) + 3 and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(ODD) + 3


# Conversation repair


def plain_repair(codes):
    """The ASCII-least cheapest edits by trying all."""
    best = (10**9, "")

    def go(i, state, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes):
            if state in (0, 3):
                best = min(best, (cost, audit))
        else:
            role, fault = divmod(codes[i], 4)
            go(i + 1, state, cost + 2, audit + "D")
            if fault not in (1, 2):
                more = 5 * (fault == 3)
                after = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}[role].get(state)
                if after is not None:
                    go(i + 1, after, cost + more, audit + "K")
                go(i + 1, 3 if state == 2 else 2, cost + more + 1, audit + "R")
        if len(audit) - audit.count("I") == i and audit[-2:] != "II":
            go(i, 3 if state == 2 else 2, cost + 5, audit + "I")

    go(0, 0, 0, "")
    return best[1]


def test_walk_is_the_least_of_all_edits():
    for n in range(5):
        for codes in product((0, 3, 4, 5, 7, 8, 11, 12), repeat=n):
            assert "".join(repair.walk(list(codes))[0]) == plain_repair(codes), codes


@pytest.mark.parametrize("seed", range(6))
def test_pieces_walk_as_one(seed):
    """Vectors and states chained over pieces give the edits of the whole."""
    rng = random.Random(seed)
    codes = [rng.choice((0, 4, 4, 8, 8, 5, 7, 11, 12, 15)) for _ in range(200)]
    whole = repair.walk(codes)[0]
    parts = [codes[i : i + 17] for i in range(0, 200, 17)]
    ends = [repair.END]
    for p in reversed(parts[1:]):
        m = repair.matrix(p)
        ends.append(tuple(min(m[4 * s + t] + ends[-1][t] for t in range(4)) for s in range(4)))
    state, out = 0, []
    for i, (p, v) in enumerate(zip(parts, reversed(ends), strict=True)):
        edits, state = repair.walk(p, v, state, last=i == len(parts) - 1)
        out += edits
    assert out == whole


def plain_report(rows):
    """Fields of a conversation by one loop over its damaged rows, sorted."""
    space, seen, codes = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        s = text.strip(space)
        fault = 1 if not s else 2 if (role, text) in seen else 0 if s[-1] in ".!?" else 3
        seen.add((role, text))
        codes.append(4 * "sua".find(role[:1] or "-") % 16 + fault if role[:1] and role[0] in "sua" else 12 + fault)
    edits = repair.walk(codes)[0]
    lines, state, cost = [], 0, 0
    for (_, role, text), code, e in zip(rows, codes, edits, strict=True):
        for x in e:
            cost += {"D": 2, "I": 5, "R": 1, "K": 0}[x] + 5 * (x in "RK" and code % 4 == 3)
            if x != "D":
                name = role if x == "K" else "assistant" if state == 2 else "user"
                lines.append(f"{name}:{'' if x == 'I' else text}")
                state = {0: 1, 1: 2, 2: 3}[code // 4] if x == "K" else 3 if state == 2 else 2
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = "".join("sua-"[c // 4] for c in codes)
    illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    return (gaps, *(sum(c % 4 == k for c in codes) for k in (1, 2, 3)), illegal, cost, "".join(edits), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_equals_plain(spark):
    rng = random.Random(3)
    conv = [None, *range(12)]
    rows = [(c, rng.choice([None, *range(40)]) if c == 5 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Fine.", "cut", " ", None, "What?", "long " * 400 + "!", f"No {t}."])) for c in conv for t in range(0 if c == 3 else 300 if c == 4 else 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("code", F.lit(1)).withColumn("n", F.lit(1))
    damaged = repair.damage(df).collect()
    by = {}
    for r in damaged:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(by.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        want[c] = plain_report(mine)
    for block_rows in (7, 1 << 13):
        got = repair.report(df, repair.damage(df), block_rows).collect()
        assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_damage(spark):
    rows = [(1, t, "assistant", "a.b!c?") for t in range(400)] + [(2, None, None, None)]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kind = lambda t: zlib.crc32(f"1:{t}".encode()) % 20
    count = Counter(r.turn for r in got if r.conv_id == 1)
    assert all(count[t] == {0: 0, 3: 2}.get(kind(t), 1) for t in range(400))
    for r in got:
        if r.conv_id == 1:
            assert (r.role, r.text) == {1: ("assistant", ""), 2: ("assistant", "abc"), 4: ("user", "a.b!c?")}.get(kind(r.turn), ("assistant", "a.b!c?"))
    assert [(r.role, r.text) for r in got if r.conv_id == 2] in ([], [(" ", " ")], [(" ", "")], [(" ", " ")] * 2, [("user", " ")])


def test_dropped_and_empty(spark):
    t = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(9, t, "user", "x")], "conv_id long, turn long, role string, text string")
    (r,) = repair.report(df, repair.damage(df)).collect()
    assert tuple(r) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(df.limit(0), repair.damage(df.limit(0))).count() == 0


def test_one_long_conversation_is_not_one_task(spark):
    """Rows of a conversation lie in many blocks; the edits are those of the whole."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), (F.col("id") % 977).cast("string"), F.when(F.col("id") % 11 == 0, "").otherwise(".")).alias("text"))
    local = sorted((r.turn, r.role, r.text) for r in rows.collect())
    (r,) = repair.report(rows, rows, block_rows=512).collect()
    assert tuple(r)[1:] == plain_report(local)


# Substring dedup


def plain_passages(docs, window):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, cut, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, math.inf), math.inf if i is None else i)
    out = []
    for (i, _), w in zip(docs, cut, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (math.inf if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_plain(spark, seed):
    """Shared runs at all offsets, copies, a common passage, repeats within a document, repeated and null ids; small files and buckets."""
    rng = random.Random(seed)
    new = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)]
    pool = [new(n) for n in (11, 12, 13, 25, 40)]
    docs = []
    for i in range(120):
        w = new(rng.randrange(12))
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) - 10)
            w += p[a : a + rng.randrange(8, 30)] + new(rng.randrange(3))
        docs.append((None if i % 17 == 0 else i // 2 if i % 13 == 0 else i, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(500 + i, docs[3][1] + " tail") for i in range(20)] + [(1, ""), (2, None), docs[7], docs[7]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(4)
    for block_bytes, bucket_words in ((500, 300), (8 << 20, 2_000_000)):
        got = substrings.repeated_passages(df, 12, 6, block_bytes, bucket_words).collect()
        assert sorted(((r.doc_id, r.n_words, sum(x.stop - x.start for x in r.repeats), r.kept) for r in got), key=str) == plain_passages(docs, 12)
        assert all(a.stop < b.start for r in got for a, b in zip(r.repeats, r.repeats[1:], strict=False))


def test_passages_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted((substrings.repeated_passages(docs).select("doc_id", "n_words", "kept")).collect(), key=str)
    assert [(r.doc_id, r.n_words) for r in got if r.kept == ODD[7]] == [(7, 22), (None, 22), (None, 22)]
    assert len(got) == len(ODD) + 3 and sum(r.n_words == 6000 and len(r.kept) > 10_000 for r in got) == 2  # repeats of its own stay, and both rows of one id
    assert substrings.repeated_passages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_passages(docs, 50, 26)


def test_passages_case_and_spaces(spark):
    """Words count as written; white space between them doesn't."""
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (1, "\n".join(["x", *words[:55]])), (2, " ".join(words).upper()), (4, " ".join(words[10:])), (5, " ".join(words[11:]))]
    got = {r.doc_id: r for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: len(r.kept.split()) for k, r in got.items()} == {1: 56, 2: 60, 3: 5, 4: 0, 5: 49}
    assert [tuple(x) for x in got[3].repeats] == [(0, 55)]
