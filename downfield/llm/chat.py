"""Chat formatting by relational expressions only.

A conversation's rows are collected as structs and sorted by turn; adjacent turns of
one role become one block of the output, with a joining mark between their texts, so
that the single turns can be read back. Every control string begins with ``<|``.
Inside texts and roles a backslash becomes two and ``<|`` becomes ``<\\|``, so no text
can hold a control string and the escape is undone in one pass; a line feed in a role
becomes ``\\n``. The loss mask is a list of spans (start, length) in code points of the
output, and the same in bytes of its UTF-8 form (byte_start, bytes), by which it is read in
time linear in the turns: each assistant text once, without marks.

Null texts and roles are empty; a null turn sorts first; ties sort by role and text.
Rows with a null conversation id form one conversation. Repeated rows are repeated
turns. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, JOIN, END = "<|im_start|>", "<|im_join|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    """Undoes escape_role; pairs of backslashes are set apart first, so that their halves start no escape."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): rows have conv_id, turn, role and text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    # A piece a turn: what stands before its text, the text, what stands after it.
    at = lambda i: F.get("turns", i)["role"]
    opens = lambda x, i: (i == 0) | (at(i - 1) != x["role"])
    closes = lambda x, i: (i == F.size("turns") - 1) | (at(i + 1) != x["role"])
    piece = lambda x, i: F.struct(
        F.when(opens(x, i), F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(JOIN)).alias("before"),
        escape(x["text"]).alias("body"),
        F.when(closes(x, i), F.lit(END)).otherwise(F.lit("")).alias("after"),
        (x["role"] == loss_role).alias("loss"),
    )
    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    # Places are sums over the pieces before; the exchange by conversation serves the grouping, the sums and the second grouping.
    count = lambda of, names: sum((of(F.col(f"p.{n}")).cast("long") for n in names), F.lit(0).cast("long"))
    size, octets = (lambda *names: count(F.length, names)), (lambda *names: count(F.octet_length, names))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("conv_id", F.posexplode("pieces").alias("at", "p")).withColumns({name: F.coalesce(F.sum(of("before", "body", "after")).over(before), F.lit(0)) for name, of in (("place", size), ("byte", octets))})
    part = F.struct("at", F.concat("p.before", "p.body", "p.after").alias("text"), (F.col("place") + size("before")).alias("start"), size("body").alias("length"), (F.col("byte") + octets("before")).alias("byte_start"), octets("body").alias("bytes"), F.col("p.loss").alias("loss"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    spans = F.transform(F.filter("parts", lambda x: x["loss"]), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "length", "byte_start", "bytes"))))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of two rows: by turn (null first), then role, then text."""

    def step(x: Column, y: Column, then: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(then)

    known = lambda c: c["turn"].isNotNull().cast("int")
    rest = step(a["role"], b["role"], step(a["text"], b["text"], F.lit(0)))
    return step(known(a), known(b), F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(rest))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the single turns, from the output alone."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substring(block, F.length(F.substring_index(block, "\n", 1)) + 2, F.length(block) - F.length(F.substring_index(block, "\n", 1)) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_join\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the mask, unescaped. Spans are cut out by bytes: code points would be counted from the start for each."""
    cut = lambda b, s: F.substring(b, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")
    return F.get(F.transform(F.array(formatted.cast("binary")), lambda b: F.array_join(F.transform(spans, lambda s: unescape(cut(b, s))), "")), F.lit(0))


def digests(formatted: DataFrame) -> DataFrame:
    """What op6 returns, read back from (conv_id, formatted, loss_spans)."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
