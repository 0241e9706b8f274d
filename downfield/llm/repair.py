"""Repair of the turn structure of conversations by a square-root checkpointed dynamic program.

A repaired conversation's role initials are ``(s?(ua)+)?``: an optional system turn, then
user and assistant in turn. Rows are kept (cost 0), get another role (1), are deleted (2) or
follow inserted empty turns (5); a truncated row that stays costs 5 more, blank and repeated
rows must go. Backward, a vector holds the least cost to the end from each of four states:
start, after a system turn, after a user turn, after an assistant turn. Only the vectors at
every square root of the rows are stored; walking forward, those of one stretch at a time are
computed again, and of all edits on a cheapest path that of the least letter is taken
(D, I, K, R), which gives the ASCII-least cheapest edits.

Rows are sorted by range over (conversation, turn, ...), so a conversation of any length lies in
as many files as it needs, and cut into blocks of rows. Whole conversations within a block are
done there. A piece of one that goes on in another block gives a 4 x 4 matrix of least costs;
these few matrices are chained per conversation for the vector at each piece's end, each piece
is walked from all four states, the states are chained, and then each piece is written from its
own. So no task holds more rows than a block, whatever the conversations are.

Faults, the first of a row counts: blank (no character but ASCII white space), duplicate (role and
text seen earlier in the conversation), truncated (the last such character is not . ! or ?).

Null roles and texts are one space, also in the hash that damages rows. Null turns sort first; ties
sort by role and then md5 of the text, and equal rows are alike. An empty role has no initial: it
can't be kept. Rows with a null conversation id are one conversation. A conversation without rows
(all dropped) has zeros and empty texts. Very long texts are read by one task each, never sorted by.
An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import SPACES, join_skewed, written

#: Costs of the edits (fixed values).
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: States: start, after s, after u, after a. The role that must follow, the state after it, and the state after a row that is kept, by its initial.
_ROLE, _NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
_KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
_END = (0, inf, inf, 0)
#: Code of a row: 4 * place of its initial in "sua" (3: another) + fault.
CLEAR, BLANK, DUPLICATE, TRUNCATED = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut, repeated or given to the user by crc32 of ``conv_id:turn`` modulo 20."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), m.alias("m")).where("m != 0")
    times = F.sequence(F.lit(1), F.when(F.col("m") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row, least letter first: letter, cost, state after it."""
    role, fault = divmod(code, 4)
    out = []
    for s in range(4):
        edits = [("D", DELETE, s)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT_SHORT * (fault == TRUNCATED)
            if s in _KEPT[role]:
                edits.append(("K", KEEP + more, _KEPT[role][s]))
            edits.append(("R", REROLE + more, _NEXT[s]))
        out.append(edits)
    return out


MOVES = [_moves(c) for c in range(16)]


def _with_inserts(v: list[float]) -> tuple[float, ...]:
    """Least costs if turns may be inserted first."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant


def _back(code: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """Vector before a row from the vector after it."""
    return _with_inserts([min(cost + after[t] for _, cost, t in MOVES[code][s]) for s in range(4)])


END = _with_inserts(list(_END))


def walk(codes: list[int], after: tuple[float, ...] = END, state: int = 0, last: bool = True) -> tuple[list[str], int]:
    """The edits before and at each row (for the last row of a conversation those after it, too), and the state at the end.

    after: the vector behind the rows. Holds about twice the square root of the rows in vectors.
    """
    n, step = len(codes), isqrt(len(codes)) or 1
    marks, v = {}, after
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i + 1] = v
        v = _back(codes[i], v)
    out = []
    for first in range(0, n, step):
        stop = min(first + step, n)
        held = [marks[stop]]
        for i in range(stop - 1, first - 1, -1):
            held.append(_back(codes[i], held[-1]))
        held.reverse()
        for i in range(first, stop):
            here, there, edits = held[i - first], held[i - first + 1], ""
            while True:
                tight = [(x, t) for x, cost, t in MOVES[codes[i]][state] if cost + there[t] == here[state]]
                if INSERT + here[_NEXT[state]] == here[state] and (not tight or tight[0][0] != "D"):
                    edits, state = edits + "I", _NEXT[state]
                    continue
                edits, state = edits + tight[0][0], tight[0][1]
                break
            out.append(edits)
    if last:
        while state not in (0, 3) and out:
            out[-1] += "I"
            state = _NEXT[state]
    return out, state


def matrix(codes: list[int]) -> list[float]:
    """Least costs over the rows from each state to each, row by row of a 4 x 4 matrix."""
    ends = [[0 if t == s else inf for t in range(4)] for s in range(4)]
    columns = [reduce(lambda v, c: _back(c, v), reversed(codes), tuple(e)) for e in ends]
    return [columns[t][s] for s in range(4) for t in range(4)]


def ordered(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) sorted by conversation and turn, with pos, their place over all, and same, which is equal for equal rows of a conversation; written."""
    told = lambda c: F.coalesce(c, F.lit(" "))
    rows = rows.select("conv_id", "turn", told(F.col("role")).alias("role"), told(F.col("text")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("digest")).cast("binary"))
    keys = ("conv_id", "turn", "role", "digest", "salt")
    rows = rows.withColumns({"same": same, "salt": F.monotonically_increasing_id()})  # equal rows may part
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()).drop("salt", "digest"), "turns")


def with_codes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, code) of the rows of ordered()."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(CLEAR)
    rows = turns.select("conv_id", "pos", "same", role.alias("role"), fault.alias("fault"))
    repeats = rows.where(F.col("fault") != BLANK).groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = join_skewed(rows, repeats, "same", "n", how="left")
    code = 4 * F.col("role") + F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return rows.select("conv_id", "pos", code.cast("int").alias("code"))


def _pieces(t: pa.Table) -> Iterator[tuple[int | None, list[int], list[int]]]:
    """Conversation, places and codes of each run of rows of one conversation, in order of place."""
    t = t.sort_by("pos")
    conv, pos, code = (t.column(c).to_pylist() for c in ("conv_id", "pos", "code"))
    first = 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[first]:
            yield conv[first], pos[first:i], code[first:i]
            first = i


def _table(rows: list[tuple], like: pa.Table, *cols: tuple[str, pa.DataType]) -> pa.Table:
    """Rows of a conv_id, of the type that ``like`` has, and the columns."""
    schema = pa.schema([("conv_id", like.schema.field("conv_id").type), *cols])
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def edits_of(codes: DataFrame, block_rows: int = 1 << 13) -> DataFrame:
    """(conv_id, pos, code, before, edits, state): the edits of each row, the state they begin in and before, the code of the row before it in the conversation (null for the first).

    The rows of a block lie in one file of ordered(), one after the other.
    """
    kind = codes.schema["conv_id"].dataType.simpleString()
    codes = written(codes.withColumn("block", F.floor(F.col("pos") / block_rows)), "codes")
    edge_s = (("unit", pa.int64()), ("block", pa.int64()), ("last", pa.int32()), ("costs", pa.list_(pa.float64())))

    def edges(t: pa.Table) -> pa.Table:
        block, found = t.column("block")[0].as_py(), list(_pieces(t))
        ends = [found[0], found[-1]] if len(found) > 1 else found
        return _table([(c, pos[0], block, code[-1], matrix(code)) for c, pos, code in ends], t, *edge_s)

    units = written(codes.groupBy("block").applyInArrow(edges, f"conv_id {kind}, unit long, block long, last int, costs array<double>"), "pieces")
    cut = units.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    cut = written(units.join(cut, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "cut-pieces")

    after_s = (("unit", pa.int64()), ("block", pa.int64()), ("after", pa.list_(pa.float64())), ("last", pa.bool_()), ("before", pa.int32()))

    def vectors(t: pa.Table) -> pa.Table:
        rows, v, out = t.sort_by("unit").to_pylist(), END, []
        for i in range(len(rows) - 1, -1, -1):
            r = rows[i]
            out.append((r["conv_id"], r["unit"], r["block"], list(v), i == len(rows) - 1, rows[i - 1]["last"] if i else None))
            v = tuple(min(r["costs"][4 * s + t] + v[t] for t in range(4)) for s in range(4))
        return _table(out, t, *after_s)

    told = f"conv_id {kind}, unit long, block long, after array<double>, last boolean, before int"
    after = written(cut.groupBy("conv_id").applyInArrow(vectors, told), "piece-ends")

    def states(t: pa.Table, ends: pa.Table) -> pa.Table:
        known, out = {r["unit"]: r for r in ends.to_pylist()}, []
        for c, pos, code in _pieces(t) if known else ():
            if pos[0] in known:
                v = tuple(known[pos[0]]["after"])
                out.append((c, pos[0], [walk(code, v, s, last=False)[1] for s in range(4)]))
        return _table(out, t, ("unit", pa.int64()), ("states", pa.list_(pa.int32())))

    walked = codes.groupBy("block").cogroup(after.groupBy("block")).applyInArrow(states, f"conv_id {kind}, unit long, states array<int>")

    def chain(t: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in t.sort_by("unit").to_pylist():
            out.append((r["unit"], state))
            state = r["states"][state]
        return pa.table([pa.array([u for u, _ in out], pa.int64()), pa.array([s for _, s in out], pa.int32())], names=["unit", "start"])

    starts = walked.groupBy("conv_id").applyInArrow(chain, "unit long, start int")
    given = after.drop("conv_id").join(starts, "unit")
    edit_s = (("pos", pa.int64()), ("code", pa.int32()), ("before", pa.int32()), ("edits", pa.string()), ("state", pa.int32()))

    def write(t: pa.Table, ends: pa.Table) -> pa.Table:
        known, out = {r["unit"]: r for r in ends.to_pylist()}, []
        for c, pos, code in _pieces(t) if len(t) else ():
            r = known.get(pos[0])
            state, was = (r["start"], r["before"]) if r else (0, None)
            edits = walk(code, tuple(r["after"]), state, r["last"])[0] if r else walk(code)[0]
            for p, x, e in zip(pos, code, edits, strict=True):
                out.append((c, p, x, was, e, state))
                state, was = follow(x, e, state), x
        return _table(out, t, *edit_s)

    return codes.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(write, f"conv_id {kind}, pos long, code int, before int, edits string, state int")


def follow(code: int, edits: str, state: int) -> int:
    """State after the edits of a row."""
    for e in edits:
        state = state if e == "D" else _KEPT[code // 4][state] if e == "K" else _NEXT[state]
    return state


def repair(rows: DataFrame, block_rows: int = 1 << 13) -> tuple[DataFrame, DataFrame]:
    """The edits, as edits_of() has them, and the repaired rows (conv_id, pos, place, edit, role, text): all in order of pos, place.

    rows: conv_id, turn, role and text; other columns are left aside. An inserted row has the pos of the row that it stands before (after, at the end).
    """
    turns = ordered(rows)
    edits = written(edits_of(with_codes(turns), block_rows), "edits")
    role = F.when(F.col("state") == 2, "assistant").otherwise("user")

    each = edits.select("conv_id", "pos", "code", F.posexplode(_states()).alias("place", "e")).select("conv_id", "pos", "place", F.col("e.edit").alias("edit"), F.col("e.state").alias("state"))
    each = each.where("edit != 'D'").withColumn("given", F.when(F.col("edit") != "K", role))
    stay, new = each.where("edit != 'I'"), each.where("edit = 'I'")
    stay = stay.join(turns.select("pos", "role", "text"), "pos").select("conv_id", "pos", "place", "edit", F.coalesce("given", "role").alias("role"), "text")
    return edits, stay.unionByName(new.select("conv_id", "pos", "place", "edit", F.col("given").alias("role"), F.lit("").alias("text")))


def _states() -> Column:
    """array<struct<edit, state>>: each edit of a row and the state before it."""
    kept = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(0)), (F.floor(F.col("code") / 4) + 1).cast("int"))
    follows = lambda s: F.when(s == 2, 3).otherwise(2)
    one = lambda e, s: F.struct(e.alias("edit"), s.cast("int").alias("state"))
    none = F.array().cast("array<struct<edit:string,state:int>>")
    letters = F.filter(F.split("edits", ""), lambda e: e != "")
    begin = F.struct(none.alias("done"), F.col("state").cast("int").alias("state"))
    step = lambda a, e: F.struct(F.concat(a["done"], F.array(one(e, a["state"]))).alias("done"), F.when(e == "D", a["state"]).when(e == "K", kept).otherwise(follows(a["state"])).cast("int").alias("state"))
    return F.aggregate(letters, begin, step, lambda a: a["done"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` of the rows, a line feed between.

    A hash over a whole conversation is taken in order, so its rows pass through one task, a batch at a time.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = (), None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], ids), pa.array([x for _, x in out])], names=["conv_id", "repaired_sha256"])

        ids = None
        for b in batches:
            ids = b.column("conv_id").type
            for c, line in zip(b.column("conv_id").to_pylist(), b.column("line"), strict=True):
                if now != (c,):
                    if now:
                        out.append((now[0], h.hexdigest()))
                    now, h = (c,), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.as_py().encode())
            if len(out) > 10_000:
                yield batch()
                out = []
        if now:
            out.append((now[0], h.hexdigest()))
        if out:
            yield batch()

    lines = repaired.select("conv_id", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place").select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(convs: DataFrame, rows: DataFrame, block_rows: int = 1 << 13) -> DataFrame:
    """A row for each conv_id of convs: what is wrong with its rows, the cheapest edits (audit), their cost and the digest of the repaired rows."""
    edits, repaired = repair(rows, block_rows)
    long = lambda c: c.cast("long")
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
    gaps = turns.select("conv_id", F.when(F.col("n") == 0, 0).otherwise(F.col("hi") - F.col("lo") + 1 - F.col("n")).alias("gaps"))
    fault, role, was = F.col("code") % 4, F.floor(F.col("code") / 4), F.floor(F.col("before") / 4)
    legal = ((was == 0) & (role == 1)) | ((was == 1) & (role == 2)) | ((was == 2) & (role == 1))
    count = lambda e, x: F.length("edits") - F.length(F.replace("edits", F.lit(x))) if e is None else F.count_if(e)
    cost = REROLE * count(None, "R") + DELETE * count(None, "D") + INSERT * count(None, "I") + F.when((fault == TRUNCATED) & ~F.contains(F.col("edits"), F.lit("D")), CUT_SHORT).otherwise(0)
    told = edits.groupBy("conv_id").agg(
        *(long(F.count_if(fault == k)).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))),
        long(F.count_if(F.col("before").isNotNull() & ~legal)).alias("illegal"), long(F.sum(cost)).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edits"))), lambda x: x["edits"]), "").alias("audit"),
    )
    ids = convs.select("conv_id").distinct()
    both = lambda a, b: a.join(b.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    out = both(both(both(ids, gaps), told), digests(repaired))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
