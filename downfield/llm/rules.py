"""Quality rules as a bitmask ledger, by DataFrame operations only.

Every rule is evaluated once: the ledger holds each document's measurements and the
bits of the rules that it fails. A policy is a version with a mask of rules; applying
one, and asking what each of its rules removes alone, is bit arithmetic over the
ledger, and no text is read again.

Words within repeated 3-word windows are counted from 64-bit hashes of the windows
(two different windows of one text share a hash with a chance below 1e-9 even at a
million words). Null and empty texts have no words and fail ``few_words``. Repeated
rows have a ledger row each; a null id stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import SPACES, words_of

#: Rule names, in order of their bits, with the condition that fails them.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "word_length": "word_chars > 16 * n_words OR word_chars < 2 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
#: Versioned policies: the rules whose failure removes a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_words"), "v1": tuple(RULES)}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def repeat_words(words: str, windows: str) -> Column:
    """Words in windows of three found twice or more, from the columns of words and of window hashes."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, k: F.get(a, k)["h"]

    def covered(a: Column) -> Column:
        twice = F.filter(F.transform(a, lambda x, k: F.when((same(a, k - 1) == x["h"]) | (same(a, k + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
        at = F.array_sort(twice)
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n")), lambda s: s["n"])

    # Most texts repeat no window; only the others are sorted.
    few = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(few, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(ordered), covered), 1))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, measurements, fail_bits) and the columns keep of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key).alias("doc_id"), *keep, body.alias("body"), words_of(F.col(text)).alias("words"))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    at = lambda i: F.get("words", i)
    windows = F.when(F.size("words") > 2, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.select("doc_id", *keep, "body", F.size("words").cast("long").alias("n_words"), windows.alias("windows"), lines.alias("lines"))
    measured = cut.select(
        "doc_id",
        *keep,
        "n_words",
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("words", "windows").alias("n_repeat_words"),
    )
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, cond in enumerate(RULES.values())))
    return measured.withColumn("fail_bits", bits)


def apply_policy(held: DataFrame, policy: str) -> DataFrame:
    """Adds base_failed and kept."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return held.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


def with_ablation(held: DataFrame, policy: str) -> DataFrame:
    """Adds removed_alone: to a document that fails just one rule of the policy, the number of documents that this rule removes alone."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    alone = held.groupBy(bits.alias("__bits")).agg(F.count("*").alias("removed_alone")).where(F.bit_count("__bits") == 1)  # a row a rule at most
    return held.withColumn("__bits", bits).join(F.broadcast(alone), "__bits", "left").drop("__bits")


def ablations(held: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, removed_alone): documents that fail each rule, and that would stay without it."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    counts = held.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).alias("bit")) for r in POLICIES[policy]))
    pairs = counts.select("bits", "n", F.explode(rules).alias("r"))
    return pairs.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("removed_alone"),
    )
