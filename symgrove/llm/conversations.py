"""Repair of conversations by weighted interval parsing.

A conversation's rows, ordered by turn, are edited at least cost until their
role initials read ``(s?(ua)+)?``. The repair grammar is in Chomsky normal
form: a nonterminal X[p,q] derives a span of rows whose edits lead the target
language from state p to state q, X[p,q] -> X[p,r] X[r,q] joins two spans, and
terminals are the edits of one row. Insertions are closed over: a row's cell
holds the cheapest insertions before its edit. A cell keeps the least (cost,
audit). As every split of a span gives the same cell, spans of doubling length
are filled bottom up: within blocks of BLOCK neighbouring rows, then over
neighbouring blocks, until one cell spans the conversation. Rows of equal cost
never have audits of which one begins the other, so least parts join to the
least whole.

Costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert 5; a truncated
row that stays adds 5. Blank and duplicate rows must go.

Defined results: a null role or text is one space, so a null text is blank and
a null role is none of the three; null turns come first; rows equal in turn
are ordered by role and text, and rows equal in these too are alike, so any
order gives the same result. A null conversation is one of its own. Repeated
rows are duplicates of each other. Bytes that are not UTF-8 are replaced by
U+FFFD. Empty and very long texts are taken whole;
they leave their tasks only where rows are ordered and repaired, one after
another. Other columns are not carried, whatever their names; an empty table
gives no rows. An audit and a digest are one value for a conversation, so a
conversation may have up to about 10^8 rows; its texts pass through one task
in order, a batch at a time, as a digest of them demands.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symgrove.llm.order import emitted, positions, row_id, rows_in_order
from symgrove.llm.tables import stored

BLOCK = 64
JOINED = 16
_SPACES = " \t\n\v\f\r"
_TRUNCATED = 5
# States of the target language: nothing yet, after s, after u, after a.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ACCEPTING = (0, 3)
_STATES = range(4)
# A cell maps (p, q) to the least (cost, audit).
Cell = dict[tuple[int, int], tuple[int, str]]


def _spoken(state: int) -> str:
    """The initial of user or assistant that may follow a state."""
    return "a" if state == 2 else "u"


def _least(options: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    cell: Cell = {}
    for ends, found in options:
        if ends not in cell or found < cell[ends]:
            cell[ends] = found
    return cell


def join(left: Cell, right: Cell) -> Cell:
    """X[p,q] -> X[p,r] X[r,q]."""
    return _least(((p, q), (cost + more, audit + edits)) for (p, r), (cost, audit) in left.items()
                  for (middle, q), (more, edits) in right.items() if middle == r)


def _inserted() -> Cell:
    """Insertion closure: from each state on by up to two inserted rows; more never pay."""
    none = {(p, p): (0, "") for p in _STATES}
    one = {(p, _NEXT[p][_spoken(p)]): (5, "I") for p in _STATES}
    return _least(item for cell in (none, one, join(one, one)) for item in cell.items())


@functools.cache
def row_cell(initial: str, blank: bool, duplicate: bool, truncated: bool) -> Cell:
    """The edits of one row, after insertions."""
    edits = [((p, p), (2, "D")) for p in _STATES]
    if not blank and not duplicate:
        extra = _TRUNCATED if truncated else 0
        edits += [((p, following[initial]), (extra, "K")) for p, following in _NEXT.items() if initial in following]
        edits += [((p, _NEXT[p][_spoken(p)]), (1 + extra, "R")) for p in _STATES]
    return join(_inserted(), _least(iter(edits)))


def parsed(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, filled by doubling length."""
    while len(cells) > 1:
        pairs = [join(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(pairs) * 2:]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    closed = join(cell, _inserted())
    return min(closed[0, q] for q in _ACCEPTING if (0, q) in closed)


def _packed(cell: Cell) -> tuple[list[int], list[str]]:
    return [p << 40 | q << 32 | cost for (p, q), (cost, _) in cell.items()], [audit for _, audit in cell.values()]


def _unpacked(ends: list[int], audits: list[str]) -> Cell:
    return {(e >> 40, e >> 32 & 0xFF): (e & 0xFFFFFFFF, audit) for e, audit in zip(ends, audits)}


def ordered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """Rows with their places in the table and what the parser asks of each, stored.

    Columns: conv, turn, role, text, initial, blank, truncated, said (digest of
    conversation, role and text), position.
    """
    spoken = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.make_valid_utf8(F.col(role).cast("string")), F.lit(" ")).alias("role"),
        F.coalesce(F.make_valid_utf8(F.col(text).cast("string")), F.lit(" ")).alias("text"), row_id().alias("_row"))
    end = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    name = F.coalesce(F.col("conv").cast("string"), F.lit("-"))
    said = F.concat_ws(":", F.col("conv").isNull().cast("string"), F.octet_length(name), name,
                       F.octet_length("role"), "role", "text")
    facts = spoken.withColumns({
        "initial": F.left("role", F.lit(1)), "blank": end == "", "truncated": ~end.isin("", ".", "!", "?"),
        "said": F.unhex(F.sha2(said.cast("binary"), 256))})
    return positions(facts, ["conv", "turn", "role", "text", "_row"], "turns").drop("_row")


def _with_duplicates(placed: DataFrame) -> DataFrame:
    """Marks of rows, without texts; a duplicate repeats the role and text of an earlier row."""
    marks = placed.select("conv", "position", "initial", "blank", "truncated", "said")
    first = (marks.groupBy("said").agg(F.min("position").alias("first"), F.count("*").alias("times"))
             .where("times > 1").select(F.col("said").alias("_said"), "first"))
    return marks.join(first, marks["said"] == first["_said"], "left").select(
        "conv", "position", "initial", "blank", "truncated",
        F.coalesce(F.col("position") > F.col("first"), F.lit(False)).alias("duplicate"))


_SPAN = ("conv {conv}, begin bigint, ends array<bigint>, audits array<string>, first string, last string, "
         "blank bigint, duplicate bigint, truncated bigint, illegal bigint")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _groups(rows: Iterator[tuple], key) -> Iterator[list[tuple]]:
    """Neighbouring rows of one key; a group holds at most BLOCK rows or JOINED spans and a few."""
    held, of = [], None
    for row in rows:
        if held and key(row) != of:
            yield held
            held = []
        of = key(row)
        held.append(row)
    if held:
        yield held


def _spans(marks: DataFrame, schema: str) -> DataFrame:
    """One cell per conversation and block of neighbouring rows."""
    arrow = _arrow(schema)

    def parse(batches):
        def one(group):
            cells, initials, counts, illegal = [], [], [0, 0, 0], 0
            for _, _, initial, blank, truncated, duplicate in group:
                cells.append(row_cell(initial, blank, duplicate, truncated))
                if initials and not _legal(initials[-1], initial):
                    illegal += 1
                initials.append(initial)
                fault = 0 if blank else 1 if duplicate else 2 if truncated else None
                if fault is not None:
                    counts[fault] += 1
            return (group[0][0], group[0][1], *_packed(parsed(cells)), initials[0], initials[-1], *counts, illegal)

        rows = rows_in_order(batches)
        yield from emitted(map(one, _groups(rows, lambda row: (row[0], row[1] // BLOCK))), arrow)

    block = F.floor(F.col("position") / BLOCK)
    return (marks.repartition(block).sortWithinPartitions("position")
            .select("conv", "position", "initial", "blank", "truncated", "duplicate").mapInArrow(parse, schema))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _join_spans(spans: DataFrame, width: int | None, schema: str) -> DataFrame:
    """Neighbouring spans of a conversation as one: those of ``width`` rows, or all."""
    arrow = _arrow(schema)

    def merge(batches):
        def one(group):
            cell = parsed([_unpacked(row[2], row[3]) for row in group])
            sums = [sum(row[i] for row in group) for i in range(6, 10)]
            sums[3] += sum(not _legal(a[5], b[4]) for a, b in zip(group, group[1:]))
            return (group[0][0], group[0][1], *_packed(cell), group[0][4], group[-1][5], *sums)

        rows = rows_in_order(batches)
        key = (lambda row: (row[0], row[1] // width)) if width else lambda row: row[0]
        yield from emitted(map(one, _groups(rows, key)), arrow, 1 << 20, lambda row: 100 + sum(map(len, row[3])))

    keys = ["conv", F.floor(F.col("begin") / width)] if width else ["conv"]
    return spans.repartition(*keys).sortWithinPartitions("begin").mapInArrow(merge, schema)


def parses(placed: DataFrame) -> DataFrame:
    """Per conversation: conv, blank, duplicate, truncated, illegal, cost, audit. Faults count at a row's first."""
    schema = _SPAN.format(conv=placed.schema["conv"].dataType.simpleString())
    spans = _spans(_with_duplicates(placed), schema)
    # One number: rows of the longest conversation.
    longest = placed.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    width = BLOCK
    while width < longest:
        width *= JOINED
        spans = _join_spans(spans, width, schema)
    final = "conv {conv}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    final = final.format(conv=placed.schema["conv"].dataType.simpleString())
    arrow = _arrow(final)

    def close(batches):
        rows = ((row[0], *row[6:10], *cheapest(_unpacked(row[2], row[3]))) for row in rows_in_order(batches))
        yield from emitted(rows, arrow, 1 << 20, lambda row: 100 + len(row[-1]))

    return stored(_join_spans(spans, None, schema).mapInArrow(close, final), "parses")


def repaired(placed: DataFrame, parsed_: DataFrame) -> DataFrame:
    """Rows of repaired conversations, a conversation's in order in one partition: conv, place, edit, role, text.

    The edit is K, R or I. A conversation of which nothing stays has one row
    without role and text.
    """
    schema = f"conv {placed.schema['conv'].dataType.simpleString()}, place bigint, edit string, role string, text string"
    arrow = _arrow(schema)
    names = {"u": "user", "a": "assistant"}

    def edit(batches):
        def lines():
            audit, at, state, place = "", 0, 0, 0

            def inserted(conv):
                nonlocal at, state, place
                while audit[at:at + 1] == "I":
                    initial = _spoken(state)
                    yield conv, place, "I", names[initial], ""
                    at, state, place = at + 1, _NEXT[state][initial], place + 1

            # The audit comes first, then the rows, then nothing until the next conversation.
            for conv, position, given, role, text in rows_in_order(batches):
                if position < 0:
                    audit, at, state, place = given, 0, 0, 0
                    if "D" * len(audit) == audit:
                        yield conv, None, None, None, None
                    yield from inserted(conv)
                    continue
                letter, at = audit[at], at + 1
                if letter != "D":
                    initial = role[:1] if letter == "K" else _spoken(state)
                    yield conv, place, letter, role if letter == "K" else names[initial], text
                    state, place = _NEXT[state][initial], place + 1
                yield from inserted(conv)

        yield from emitted(lines(), arrow, 1 << 20, lambda row: 64 + len(row[4] or ""))

    rows = placed.select("conv", "position", F.lit(None).cast("string").alias("audit"), "role", "text").unionByName(
        parsed_.select("conv", F.lit(-1).cast("bigint").alias("position"), "audit",
                       F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    return rows.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(edit, schema)


def digests(lines: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of ``role:text`` lines, joined by line ends, of rows as ``repaired`` gives them."""
    schema = f"conv {lines.schema['conv'].dataType.simpleString()}, repaired_sha256 string"
    arrow = _arrow(schema)

    def digest(batches):
        def hashes():
            now, running = None, None
            for conv, place, role, text in rows_in_order(batches):
                if running is None or not place:
                    if running is not None:
                        yield now, running.hexdigest()
                    now, running = conv, hashlib.sha256()
                if place is not None:
                    running.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if running is not None:
                yield now, running.hexdigest()

        yield from emitted(hashes(), arrow)

    return lines.select("conv", "place", "role", "text").mapInArrow(digest, schema)


def gaps(turn: Column) -> Column:
    """Aggregate: turns missing between the least and the greatest."""
    return F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("bigint")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per conversation: conv, counts of faults, cost, audit; rows of the repaired conversations)."""
    placed = ordered(rows, conv, turn, role, text)
    found = parses(placed)
    return found, repaired(placed, found)
