"""Conversation repair against all edits, and against a full CYK table."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from symgrove.llm import conversations as c, queries

WANTED = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, label int, score double"


def symbols(rows):
    """(initial, blank, duplicate, truncated) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        blank, duplicate = not words, (role, text) in seen
        seen.add((role, text))
        out.append((role[:1], blank, duplicate, bool(words) and words[-1] not in ".!?"))
    return out


def all_edits(marks):
    """The least (cost, audit) of every way to edit a few rows, with up to three insertions."""
    best = None
    options = []
    for initial, blank, duplicate, truncated in marks:
        own = [("D", 2, "")]
        if not blank and not duplicate:
            extra = 5 if truncated else 0
            own += [("K", extra, initial)] + [("R", 1 + extra, x) for x in "ua"]
        options.append(own)
    gaps = [list(itertools.chain([""], "ua", ("ua", "au"))) for _ in range(len(marks) + 1)]
    for inserted in itertools.product(*gaps):
        if sum(map(len, inserted)) > 3:
            continue
        for edits in itertools.product(*options):
            made = inserted[0] + "".join(e[2] + i for e, i in zip(edits, inserted[1:]))
            if WANTED.match(made):
                audit = "I" * len(inserted[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(edits, inserted[1:]))
                found = (sum(e[1] for e in edits) + 5 * sum(map(len, inserted)), audit)
                best = found if best is None or found < best else best
    return best


def full_cyk(marks):
    """Every span and every split."""
    n = len(marks)
    cell = {(i, i + 1): c.row_cell(m[0], m[1], m[2], m[3]) for i, m in enumerate(marks)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            cells = [c.join(cell[i, k], cell[k, i + width]) for k in range(i + 1, i + width)]
            assert all(x == cells[0] for x in cells)         # any split gives the same cell
            cell[i, i + width] = cells[0]
    return c.cheapest(cell[0, n])


@pytest.mark.parametrize("seed", range(40))
def test_least_edits(seed):
    draw = random.Random(seed)
    marks = [(draw.choice("uuaasx"), draw.random() < 0.15, draw.random() < 0.15, draw.random() < 0.25)
             for _ in range(draw.randrange(1, 5))]
    got = c.cheapest(c.parsed([c.row_cell(*m) for m in marks]))
    assert got == all_edits(marks) == full_cyk(marks)


def test_full_table_of_longer_conversations():
    draw = random.Random(5)
    for n in (7, 16, 29):
        marks = [(draw.choice("uuaas"), draw.random() < 0.1, draw.random() < 0.1, draw.random() < 0.2) for _ in range(n)]
        assert c.cheapest(c.parsed([c.row_cell(*m) for m in marks])) == full_cyk(marks)


def plain(rows):
    """Per conversation, the result of the contract, from rows after damage."""
    convs = {}
    for r in rows:
        convs.setdefault(r["conv_id"], []).append(r)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
        marks = symbols([(r["role"], r["text"]) for r in mine])
        initials = [m[0] for m in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        blank = sum(m[1] for m in marks)
        duplicate = sum(m[2] and not m[1] for m in marks)
        truncated = sum(m[3] and not m[2] and not m[1] for m in marks)
        cost, audit = c.cheapest(c.parsed([c.row_cell(*m) for m in marks]))
        lines, at, state = [], 0, ""
        for edit in audit:
            spoken = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(spoken + ":")
                state = spoken[0]
                continue
            row = mine[at]
            at += 1
            if edit != "D":
                role = row["role"] if edit == "K" else spoken
                lines.append(f"{role}:{row['text']}")
                state = role[0]
        turns = {r["turn"] for r in mine if r["turn"] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for r in rows:
        name = ":".join(" " if r[k] is None else str(r[k]) for k in ("conv_id", "turn"))
        kind = zlib.crc32(name.encode()) % 20
        r = {**r, **{k: " " if r[k] is None else r[k] for k in ("role", "text")}}
        if kind == 1:
            r["text"] = ""
        if kind == 2:
            r["text"] = re.sub("[.!?]", "", r["text"])
        if kind == 4:
            r["role"] = "user"
        out += [r] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def result(spark, rows, tmp_path, schema=SCHEMA):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/conversations.parquet")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in queries.op13_conversation_repair(spark, path).collect()}


def expected(rows):
    found, nothing = plain(damage(rows)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {r["conv_id"]: found.get(r["conv_id"], nothing) for r in rows}


def made(draw, n, convs):
    texts = ["Hello.", "Why?", "no end", "", " \t", "Yes!", "é. ", None, "line\nbreak."]
    return [{"conv_id": draw.choice(convs), "turn": draw.choice([None, *range(12)]),
             "role": draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             "text": draw.choice(texts) if draw.random() < 0.5 else f"t {draw.random()}.", "label": 1, "score": 0.5} for _ in range(n)]


def test_odd_rows(spark, tmp_path):
    rows = made(random.Random(1), 400, [None, *range(40)])
    assert result(spark, rows, tmp_path) == expected(rows)


def test_one_conversation_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 8)
    monkeypatch.setattr(c, "JOINED", 2)
    rows = made(random.Random(2), 300, [7]) + made(random.Random(3), 40, [1, 2, 8, 9, None])
    for i, r in enumerate(rows):
        r["turn"] = i if i % 11 else None
    assert result(spark, rows, tmp_path) == expected(rows)


def test_empty_table_and_lost_conversations(spark, tmp_path):
    assert result(spark, [], tmp_path) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [{"conv_id": gone, "turn": 0, "role": "user", "text": "Hi.", "label": 1, "score": 0.5}]
    (tmp_path / "two").mkdir()
    assert result(spark, rows, tmp_path / "two") == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 0, "user", " "),
            (3, 0, "system", "Be."), (3, 1, "tool", "Q?"), (3, 2, "assistant", "A.")]
    found, lines = c.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    audits = {r.conv: (r.cost, r.audit) for r in found.collect()}
    assert audits == {1: (2, "DKK"), 2: (2, "D"), 3: (1, "KRK")}
    got = sorted((r.conv, r.place, r.edit, r.role, r.text) for r in lines.where("place IS NOT NULL").collect())
    assert got == [(1, 0, "K", "user", "And?"), (1, 1, "K", "assistant", "Yes."),
                   (3, 0, "K", "system", "Be."), (3, 1, "R", "user", "Q?"), (3, 2, "K", "assistant", "A.")]


def test_bytes_that_are_no_utf8(spark):
    row = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"),
                                F.unhex(F.lit("61FF2E")).cast("string").alias("text"))
    _, lines = c.repair(row.unionByName(row.withColumns({"turn": F.lit(1), "role": F.lit("assistant")})))
    assert [r.text for r in lines.orderBy("place").collect()] == ["a�."] * 2


def test_query_on_the_whole_table(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)
