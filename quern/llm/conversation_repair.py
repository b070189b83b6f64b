"""Cheapest repair of conversations whose turns are lost, empty, repeated, cut short or out of order.

What may be done with one turn, from each of four states (nothing said yet, the
system, the user or the assistant spoke last) to each other, is a 4x4 matrix
of (cost, edits). Its product is associative: costs add, edits follow one
another, and of two ways the cheaper one counts, at equal cost the one whose
edits come first in ASCII. Of two ways of equal cost through the same turns none
begins with all of the other (that would take an insertion more), so what comes
first stays first whatever follows. A conversation is a product of its turns;
stretches of it are multiplied where they lie and then, few at a time, together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from quern.llm.common import cut_lineage

#: States: nothing yet, then who spoke last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Steps that a repaired conversation can take: an optional system turn, then user and assistant by turns.
STEPS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
LEGAL = ("su", "ua", "au")
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def _matrix(ways: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(ways.get((i, j)) for i in range(4) for j in range(4))


UNIT = _matrix({(q, q): (0, "") for q in range(4)})


def best(x: Element, y: Element) -> Element:
    return y if x is None else x if y is None else min(x, y)


def times(x: Matrix, y: Matrix) -> Matrix:
    """All ways through x and then y, the best of each kind."""
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[i + k][0] + y[4 * k + j][0], k) for k in range(4) if x[i + k] is not None and y[4 * k + j] is not None]
            least = min(ways)[0] if ways else 0
            edits = [x[i + k][1] + y[4 * k + j][1] for cost, k in ways if cost == least]
            out.append((least, min(edits)) if edits else None)
    return tuple(out)


def power(x: Matrix, n: int) -> Matrix:
    """x by itself n times, by doubling."""
    out = UNIT
    while n:
        out, x, n = times(out, x) if n & 1 else out, times(x, x) if n > 1 else x, n >> 1
    return out


def _closure() -> Matrix:
    """Any number of inserted turns; four states need three at most."""
    once = _matrix({(p, q): (INSERT, "I") for p, q in STEPS if q in (USER, ASSISTANT)})
    any_number, term = UNIT, UNIT
    for _ in range(3):
        term = times(term, once)
        any_number = tuple(map(best, any_number, term))
    return any_number


INSERTED = _closure()
DELETED = _matrix({(q, q): (DELETE, "D") for q in range(4)})


def turn_matrix(initial: str, must_go: bool, cut_short: bool) -> Matrix:
    """Insertions and then one edit of a turn whose role begins with ``initial``."""
    ways = {(q, q): (DELETE, "D") for q in range(4)}
    if not must_go:
        more = CUT_SHORT if cut_short else 0
        for p, q in STEPS:
            if STATE.get(initial) == q:
                ways[p, q] = (KEEP + more, "K")
            elif q in (USER, ASSISTANT):
                ways[p, q] = (REROLE + more, "R")
    return times(INSERTED, _matrix(ways))


TURNS = {(x, gone, cut): turn_matrix(x, gone, cut) for x in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)}
GONE_AGAIN = times(INSERTED, DELETED)


class Product:
    """The product of matrices that come in order, multiplied as a balanced tree."""

    def __init__(self):
        self._parts: list[tuple[int, Matrix]] = []

    def add(self, x: Matrix) -> None:
        size = 1
        while self._parts and self._parts[-1][0] == size:
            x, size = times(self._parts.pop()[1], x), 2 * size
        self._parts.append((size, x))

    def total(self) -> Matrix:
        out = UNIT
        for _, x in reversed(self._parts):
            out = times(x, out)
        return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of what is left of each row.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its ``.!?``, 3 makes two of it, 4 makes its role user. A null
    role or text is one space, and so is a null id or turn in the key.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")), F.lit(20).cast("bigint"))
    rows = conversations.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _lines(rows: DataFrame) -> DataFrame:
    """Equal rows as one line with its number of copies, its faults, and whether its turn is the first to say so."""
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    lines = cut_lineage(
        equal.select(
            "*",
            said.alias("said"),
            F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_short"),
        )
    )
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")  # nulls first
    firsts = cut_lineage(lines.groupBy(F.col("conv_id").alias("__conv"), F.col("said").alias("__said")).agg(F.min(place).alias("__first")))
    same = lines["conv_id"].eqNullSafe(firsts["__conv"]) & (lines["said"] == firsts["__said"])
    return lines.join(firsts, same).select(*lines.columns, F.col("turn").eqNullSafe(F.col("__first.turn")).alias("fresh"))


COUNTS = ["rows", "blank", "duplicate", "cut_short", "illegal"]
STRETCH = "first:string,last:string," + "".join(f"{c}:bigint," for c in COUNTS) + "ways:array<struct<cost:bigint,edits:string>>,pieces:array<struct<part:int,start:bigint,rows:bigint>>,open:boolean"


def _multiplied(lines: DataFrame) -> DataFrame:
    """Each line with its place (part, start), and one row for each stretch of a conversation that lies in one part.

    Lines are dealt by conversation, turn, role and content, so a long
    conversation lies in as many parts as it needs. ``open`` stretches are the
    first and the last of a part: theirs may go on in the parts beside it.
    """
    conv = lines.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "said"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"part int, start bigint, role string, text string, stretch struct<conv_id:{conv},{STRETCH}>"
    target = _arrow_schema(schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, known, is_first = TaskContext.get().partitionId(), 0, None, True
        for batch in batches:
            starts, ended = [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "initial", "copies", "blank", "cut_short", "fresh", "turn", "said")]
            for conv_id, initial, copies, blank, cut_short, fresh, *content in zip(*columns, strict=True):
                if known is None or known.conv_id != conv_id:
                    if known is not None:
                        ended.append(known.row(is_first))
                        is_first = False
                    known = _Stretch(conv_id, part, at)
                starts.append(at)
                known.add(initial, copies, blank, cut_short, not fresh)
                at += copies
            yield _batch(target, part=pa.array([part] * len(starts), pa.int32()), start=pa.array(starts, pa.int64()), role=batch.column("role"), text=batch.column("text"))
            if ended:
                yield _batch(target, stretch=pa.array(ended, target.field("stretch").type))
        if known is not None:
            yield _batch(target, stretch=pa.array([known.row(True)], target.field("stretch").type))

    return cut_lineage(dealt.select("conv_id", "turn", "role", "text", "said", "copies", "initial", "blank", "cut_short", "fresh").mapInArrow(multiply, schema))


def _arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _batch(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class _Stretch:
    """A run of lines of one conversation."""

    def __init__(self, conv_id, part: int, start: int):
        self.conv_id, self.part, self.start = conv_id, part, start
        self.first = self.last = None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.product = Product()

    def add(self, initial: str, copies: int, blank: bool, cut_short: bool, repeated: bool) -> None:
        n = self.counts
        n["rows"] += copies
        n["illegal"] += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if blank:
            n["blank"] += copies
        else:
            n["duplicate"] += copies if repeated else copies - 1
            n["cut_short"] += cut_short and not repeated
        self.product.add(TURNS[initial if initial in STATE else "", blank or repeated, cut_short])
        if copies > 1:
            self.product.add(power(GONE_AGAIN, copies - 1))

    def row(self, is_open: bool) -> dict:
        piece = {"part": self.part, "start": self.start, "rows": self.counts["rows"]}
        return {"conv_id": self.conv_id, "first": self.first, "last": self.last, **self.counts, "ways": packed(self.product.total()), "pieces": [piece], "open": is_open}


def packed(x: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "edits": e[1]} for e in x]


def unpacked(ways: list[dict | None]) -> Matrix:
    return tuple(None if e is None else (e["cost"], e["edits"]) for e in ways)


def joined(stretches: list[dict]) -> dict:
    """Neighbouring stretches of one conversation as one."""
    out, product = dict(stretches[0]), Product()
    for k, s in enumerate(stretches):
        product.add(unpacked(s["ways"]))
        if k:
            out |= {c: out[c] + s[c] for c in COUNTS}
            out["illegal"] += out["last"] + s["first"] not in LEGAL
            out["last"] = s["last"]
            out["pieces"] = out["pieces"] + s["pieces"]
    return out | {"ways": packed(product.total())}


def _whole(placed: DataFrame, together: int = 32) -> DataFrame:
    """One stretch per conversation: open ones are joined, ``together`` parts at a time, until each is whole.

    There are two open stretches a part at most; all others pass by untouched.
    """
    stretches = placed.where("stretch is not null").select("stretch.*")
    schema = stretches.schema
    target = _arrow_schema(schema)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda s: s["pieces"][0]["part"])
        return pa.Table.from_pylist([joined(rows)], schema=target)

    parts, width, still_open = placed.agg(F.max("part")).first()[0] or 0, 1, stretches.where("open")
    while width <= parts:
        width *= together
        still_open = still_open.groupBy("conv_id", F.expr(f"pieces[0].part div {width}")).applyInArrow(join, schema)
    return stretches.where("not open").unionByName(still_open)


def _outcome(whole: DataFrame) -> DataFrame:
    """Each conversation's counts, its cost and its edits (``audit``)."""
    schema = whole.select("conv_id", *COUNTS, "pieces").schema.add("cost", LongType()).add("audit", StringType())
    target = _arrow_schema(schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                ways = times(unpacked(row.pop("ways")), INSERTED)
                row["cost"], row["audit"] = best(ways[START], ways[ASSISTANT])
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in target} for r in rows], schema=target)

    return whole.mapInArrow(settle, schema)


#: Rows that a task gathers before it hands them on.
BATCH = 20_000


def _emitted(outcome: DataFrame) -> DataFrame:
    """One row for each turn of the repaired conversations: conv_id, position, edit, new_role, and the place of the row that it comes from."""
    conv = outcome.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, position bigint, edit string, new_role string, part int, start bigint"
    target = _arrow_schema(schema)

    def turns(conv_id, audit: str, pieces: list[dict]) -> Iterator[tuple]:
        length = len(audit) - audit.count("D")
        position, piece, row = 0, 0, 0
        for edit in audit:
            speaker = position - length % 2  # an odd length has a system turn first
            role = None if speaker < 0 else ("user", "assistant")[speaker % 2]
            if edit == "I":
                yield conv_id, position, edit, role, None, None
                position += 1
                continue
            while row >= pieces[piece]["rows"]:
                piece, row = piece + 1, 0
            if edit != "D":
                yield conv_id, position, edit, role if edit == "R" else None, pieces[piece]["part"], pieces[piece]["start"] + row
                position += 1
            row += 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for conv_id, audit, pieces in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "pieces")], strict=True):
                for turn in turns(conv_id, audit, pieces):
                    rows.append(turn)
                    if len(rows) >= BATCH:
                        yield _rows(target, rows)
                        rows = []
        if rows:
            yield _rows(target, rows)

    return outcome.select("conv_id", "audit", "pieces").mapInArrow(emit, schema)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repair_conversations(rows: DataFrame, original: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``original`` and its cheapest repair, and the repaired turns.

    ``rows`` has conv_id, turn, role, text and copies (1 for a plain table).
    A conversation's rows are taken by turn, nulls first; rows of one turn come
    in the order of role and of the SHA-256 of role and text, equal rows beside
    each other. A row's first fault counts: blank (nothing but white space),
    duplicate (its role and text came before in the conversation), truncated
    (its last other character is none of ``.!?``). Blank and duplicate rows are
    deleted (D, cost 2); others may be too, or are kept (K, 0), or get the role
    user or assistant (R, 1), each 5 more if truncated; empty turns of user or
    assistant may be inserted anywhere (I, 5), so that the initials of the roles
    are an optional ``s`` before any number of ``ua``, or nothing. ``audit`` has
    the edits in order; of the cheapest, the least in ASCII.

    First result: conv_id, gaps, blank, duplicate, truncated, illegal (adjacent
    rows whose initials are not su, ua or au), cost, audit; a conversation
    without rows has zeros and an empty audit. Second: conv_id, position, edit,
    role, text. A null id is a conversation of its own. Further columns are
    ignored, an empty table gives empty results.

    Edits are letters, one for each row; a conversation's are one value, and a
    task that multiplies a stretch of it holds 16 such values of its length.
    """
    lines = _lines(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies"))
    placed = _multiplied(lines)
    outcome = cut_lineage(_outcome(_whole(placed)))
    turns = lines.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("__turns")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    all_ids = original.select("conv_id").distinct()
    found = outcome.withColumnRenamed("conv_id", "__conv")
    told = all_ids.join(found, all_ids["conv_id"].eqNullSafe(found["__conv"]), "left").join(turns, all_ids["conv_id"].eqNullSafe(turns["__turns"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    summary = told.select("conv_id", count("gaps").alias("gaps"), count("blank").alias("blank"), count("duplicate").alias("duplicate"), count("cut_short").alias("truncated"), count("illegal").alias("illegal"), count("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    emitted, source = _emitted(outcome), placed.where("stretch is null").select(F.col("part").alias("__part"), F.col("start").alias("__start"), "role", "text")
    repaired = emitted.join(source, (emitted["part"] == source["__part"]) & (emitted["start"] == source["__start"]), "left")
    return summary, repaired.select("conv_id", "position", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines joined by newlines.

    A digest is taken from front to back, so a conversation's turns go through
    one task in order; it keeps the state of the digest and no turns.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, repaired_sha256 string"
    target = _arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        for batch in batches:
            done = []
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv_id != known:
                    if state is not None:
                        done.append((known, state.hexdigest()))
                    known, state = conv_id, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield _rows(target, done)
        if state is not None:
            yield _rows(target, [(known, state.hexdigest())])

    lines = turns.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "line").mapInArrow(digest, schema)


def digest_columns(summary: DataFrame, turns: DataFrame) -> DataFrame:
    """The summary with ``repaired_sha256``; a conversation of which nothing is left has that of the empty text."""
    digests = conversation_digests(turns).withColumnRenamed("conv_id", "__conv")
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return summary.join(digests, summary["conv_id"].eqNullSafe(digests["__conv"]), "left").select(*summary.columns, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
