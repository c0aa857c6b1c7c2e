"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is whole when the initials of its roles read ``(s?(ua)+)?``.  Its
rows may be kept, given the role user or assistant, or deleted, and messages
without text may be inserted.  An item ``(span, from, to)`` says that the rows of
a span can take the automaton of legal turns from one state to another.  Axioms
are the ways to edit one row; a deduction joins the items of two neighbouring
spans.  An item's weight is (cost, rows, audit), audit being the initials of its
edits.  Joining adds costs and rows and puts audits end to end, which never makes
a weight smaller and keeps the order of weights, so it is a superior function:
the agenda pops items in the order of their weights, each one is final when it is
popped, and the search ends when the goal is.

Insertions are taken just before a row that stays, or after the last row: before
a deleted row they cost the same and their audit is larger, as D is before I.  So
audits of one span all end with a row's own edit and hold as many of these, none
is the beginning of another, and putting them end to end keeps their order.

Rows are dealt by ranges of (conversation, turn), so a conversation may span
several partitions.  Then each of its fragments is summed up by the costs and the
ranks of its sixteen items.  A few numbers for each partition reach the driver,
where the same agenda joins fragments; each fragment is then repaired on its own,
between the states it was given.

Rows: null roles and texts are one space; a null conversation is one like any
other; turns are ordered by turn (nulls first), then by role and text, and equal
rows are repeated turns; an empty text is blank; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .chat import _fragments as fragments
from .common import bound_batches, cut, read

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: Which message may follow which, and which a repair may put there.
NEXT = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
MADE = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Messages to be inserted after the last row, by state.
CLOSING = ("", "II", "I", "")
FAULTS = ("", "truncated", "blank", "duplicate")
SPACE = " \t\n\x0b\x0c\r"
#: Conversations up to this many rows are looked up by their kinds of rows.
REMEMBERED_ROWS = 16
#: Bytes of a conversation's text that are handed on at once.
PIECE_BYTES = 1 << 20

INT, LONG, BOOLEAN, STRING = T.IntegerType(), T.LongType(), T.BooleanType(), T.StringType()
Weight = tuple[int, str]
Kind = tuple[int, int]
Axioms = list[tuple[int, int, int, str]]


@lru_cache(maxsize=None)
def axioms(kind: Kind) -> Axioms:
    """(from, to, cost, audit) of the ways to edit a row of an initial's state and a fault."""
    initial, fault = kind
    out = [(s, s, DELETE, "D") for s in STATES]
    if fault < 2:
        extra = TRUNCATED if fault else 0
        for s in STATES:
            for state, cost, audit in ((s, extra, ""), (MADE[s], extra + INSERT, "I")):
                if initial in NEXT[state]:
                    out.append((s, initial, cost, audit + "K"))
                out.append((s, MADE[state], cost + REROLE, audit + "R"))
    return out


def derive(rows: list[Axioms], start: int | None = None, goal: int | None = None) -> dict[tuple[int, int], Weight]:
    """The weights of items ``(from, to)`` that span all rows.

    With a ``start`` only items from there count.  The search ends when the item of
    ``start`` and ``goal`` is final, or where ``goal`` is -1, the first closed one,
    given as ``(start, -1)``; without a goal all items are found.
    """
    # Spans are the nodes of a balanced tree: (first row, last row + 1), their two halves, and what they are half of.
    above: dict[tuple[int, int], tuple[tuple[int, int], tuple[int, int], bool]] = {}
    spread = [(0, len(rows))]
    for low, high in spread:
        if high - low > 1:
            middle = (low + high) // 2
            halves = (low, middle), (middle, high)
            for half in halves:
                above[half] = (low, high), halves[half == halves[0]], half == halves[0]
            spread += halves
    root = (0, len(rows))
    agenda: list[tuple[int, int, str, tuple[int, int], int, int]] = []
    for i, ways in enumerate(rows):
        agenda += [(cost, 1, audit, (i, i + 1), s, t) for s, t, cost, audit in ways if i or start is None or s == start]
    heapq.heapify(agenda)
    done: dict[tuple[int, int], dict[tuple[int, int], Weight]] = {span: {} for span in spread}
    while agenda:
        cost, size, audit, span, s, t = heapq.heappop(agenda)
        if t < 0:
            return {(s, t): (cost, audit)}
        final = done[span]
        if (s, t) in final:
            continue
        final[s, t] = cost, audit
        if span == root:
            if t == goal:
                return final
            if goal == -1:
                heapq.heappush(agenda, (cost + INSERT * len(CLOSING[t]), size + 1, audit + CLOSING[t], span, s, -1))
            continue
        parent, other, is_left = above[span]
        size = parent[1] - parent[0]
        for (a, b), (more, rest) in done[other].items():
            if is_left and a == t:
                heapq.heappush(agenda, (cost + more, size, audit + rest, parent, s, b))
            elif not is_left and b == s:
                heapq.heappush(agenda, (more + cost, size, rest + audit, parent, a, t))
    return done[root]


@lru_cache(maxsize=1 << 14)
def _remembered(kinds: tuple[Kind, ...], start: int, goal: int) -> str:
    return derive([axioms(k) for k in kinds], start, goal)[start, goal][1]


def audit_of(kinds: list[Kind], start: int, goal: int) -> str:
    """The edits of the lightest repair that leads from one state to another, or to the end (-1)."""
    if len(kinds) <= REMEMBERED_ROWS:
        return _remembered(tuple(kinds), start, goal)
    return derive([axioms(k) for k in kinds], start, goal)[start, goal][1]


def matrix(kinds: list[Kind]) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, rank) of a fragment's items; ranks order their audits."""
    found = derive([axioms(k) for k in kinds])
    ranks = {audit: i for i, audit in enumerate(sorted({a for _, a in found.values()}))}
    return [(s, t, cost, ranks[audit]) for (s, t), (cost, audit) in found.items()]


def route(fragments_: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """The states at entry and exit of each fragment of a conversation; the last one leads to the end (-1)."""
    ways = [[(s, t, cost, chr(rank)) for s, t, cost, rank in f] for f in fragments_]
    _, told = derive(ways, START, -1)[START, -1]
    # Ranks tell items of one weight apart by their states only where their audits differ: any of the equal ones will do.
    states = {START: []}
    for way, rank in zip(ways, told, strict=False):
        after: dict[int, list[tuple[int, int]]] = {}
        for s, t, cost, mark in way:
            if s in states and mark == rank:
                path = [*states[s], (s, t, cost)]
                if t not in after or sum(x[2] for x in path) < sum(x[2] for x in after[t]):
                    after[t] = path
        states = after
    least = min(states, key=lambda t: (sum(x[2] for x in states[t]) + INSERT * len(CLOSING[t]), CLOSING[t]))
    path = [(s, t) for s, t, _ in states[least]]
    return [*path[:-1], (path[-1][0], -1)]


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


class Edit(NamedTuple):
    row: int
    edit: str
    cost: int
    new_role: str | None


def edits(kinds: list[Kind], roles: list[str], audit: str, state: int) -> list[Edit]:
    """What an audit does, in order; an insertion names the row that it comes before."""
    out, row = [], 0
    for sign in audit:
        if sign == "I":
            state = MADE[state]
            out.append(Edit(row, sign, INSERT, NAMES[state]))
            continue
        extra = TRUNCATED if kinds[row][1] == 1 else 0
        if sign == "D":
            out.append(Edit(row, sign, DELETE, None))
        elif sign == "K":
            state = kinds[row][0]
            out.append(Edit(row, sign, extra, roles[row]))
        else:
            state = MADE[state]
            out.append(Edit(row, sign, extra + REROLE, NAMES[state]))
        row += 1
    return out


def kind_of(role: str, text: str, seen: bool) -> Kind:
    """The state of a role's initial, and the first fault's place in ``FAULTS``."""
    body = text.rstrip(SPACE)
    fault = 2 if not body else 3 if seen else 1 if body[-1] not in ".!?" else 0
    return INITIALS.get(role[:1], START), fault


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, seen`` by ranges of the order; ``seen``: role and text were there before."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_id"),
    )
    conversation = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    rows = cut(rows.withColumn("_key", F.md5(F.concat(conversation, F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))))
    place = F.struct("turn", "_id")  # a null turn comes first
    twice = cut(rows.groupBy("_key").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    marked = rows.join(twice, "_key", "left").withColumn("seen", F.coalesce(place > F.col("_first"), F.lit(False)))
    order = ["conv_id", "turn", "role", "text", "_id"]
    marked = marked.select(*order, "seen")
    return cut(marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("_id"))


def _kinds(data: dict[str, list]) -> list[Kind]:
    return [kind_of(*x) for x in zip(data["role"], data["text"], data["seen"], strict=True)]


def _legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def _edges(rows: DataFrame) -> list:
    """Of each partition's first and last fragment: its items, and the roles it begins and ends with."""
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for first, last, data in fragments(batches, ["conv_id", "role", "text", "seen"]):
            if first or last:
                items = [list(x) for x in matrix(_kinds(data))]
                columns = [
                    pa.array([part], pa.int32()), pa.array([first], pa.bool_()), pa.array([items], pa.list_(pa.list_(pa.int64()))),
                    pa.array([data["role"][0][:1]], pa.string()), pa.array([data["role"][-1][:1]], pa.string()), pa.array(data["conv_id"][:1], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "items", "begins", "ends", "conv_id"])

    schema = _struct(part=INT, first=BOOLEAN, items=T.ArrayType(T.ArrayType(LONG)), begins=STRING, ends=STRING, conv_id=rows.schema["conv_id"].dataType)
    found = rows.mapInArrow(run, schema)
    return sorted(found.collect(), key=lambda r: (r.part, not r.first))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each edit, in order of ``part`` and ``place``.

    ``conv_id, part, place, turn, edit, cost, fault, illegal, role, text,
    new_role, new_text``.  ``edit`` is K, R, D or I; what it leaves of the
    conversation is ``new_role`` and ``new_text``, null where it deletes.  ``fault``
    is null or blank, duplicate or truncated; ``illegal`` says that the row may not
    follow the one before it.  An inserted row has no ``role, text, fault``.
    The rows of a partition are in order, those of a conversation together.
    """
    bound_batches(turns.sparkSession)
    rows = ordered(turns)
    spans: list[list] = []
    for edge in _edges(rows):
        if spans and edge.first and spans[-1][-1].conv_id == edge.conv_id:
            spans[-1].append(edge)
        else:
            spans.append([edge])
    # (state at entry, at exit, initial of the row before) of the fragments of conversations in several partitions.
    told: dict[tuple[int, bool], tuple[int, int, str | None]] = {}
    for span in spans:
        if len(span) > 1:
            before = None
            for edge, (s, t) in zip(span, route([[tuple(i) for i in e.items] for e in span]), strict=True):
                told[edge.part, edge.first] = s, t, before
                before = edge.ends
    kinds_of = [to_arrow_type(rows.schema[c].dataType) for c in ("conv_id", "turn")]
    names = ["conv_id", "part", "place", "turn", "edit", "cost", "fault", "illegal", "role", "text", "new_role", "new_text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, n = TaskContext.get().partitionId(), 0, [[] for _ in names], 0

        def flush() -> pa.RecordBatch:
            plain = [pa.int32(), pa.int64(), kinds_of[1], pa.string(), pa.int64(), pa.string(), pa.bool_(), *[pa.string()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, [kinds_of[0], *plain], strict=True)], names=names)

        for first, last, data in fragments(batches, ["conv_id", "turn", "role", "text", "seen"]):
            kinds, roles = _kinds(data), data["role"]
            outer = first or last
            s, t, before = told.get((part, first), (START, -1, None)) if outer else (START, -1, None)
            for e in edits(kinds, roles, audit_of(kinds, s, t), s):
                at = min(e.row, len(roles) - 1)
                if made := e.edit == "I":
                    own = (None, False, None, None, e.new_role, "")
                else:
                    previous = roles[at - 1] if at else before
                    bad = previous is not None and not _legal(previous, roles[at])
                    text = data["text"][at]
                    own = (FAULTS[kinds[at][1]] or None, bad, roles[at], text, e.new_role, None if e.edit == "D" else text)
                    n += len(text)
                row = (data["conv_id"][at], part, place, None if made else data["turn"][at], e.edit, e.cost, *own)
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                place += 1
                if n > PIECE_BYTES or len(held[0]) >= 4096:
                    yield flush()
                    held, n = [[] for _ in names], 0
        if held[0]:
            yield flush()

    schema = _struct(
        conv_id=rows.schema["conv_id"].dataType, part=INT, place=LONG, turn=rows.schema["turn"].dataType, edit=STRING, cost=LONG,
        fault=STRING, illegal=BOOLEAN, role=STRING, text=STRING, new_role=STRING, new_text=STRING,
    )
    return rows.mapInArrow(run, schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


class Report:
    """Counts, audit and digest of a conversation, or of a part of it, row by row."""

    def __init__(self) -> None:
        self.counts, self.audit, self.sha, self.any = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False

    def add(self, line: bytes) -> None:
        self.sha.update(b"\n" + line if self.any else line)
        self.any = True


def reports(edited: DataFrame) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of what ``repair`` gives.

    Conversations within a partition are summed up there.  Those at its edges may
    go on in the next one, so they travel as pieces and are summed up in order.
    """
    id_type = edited.schema["conv_id"].dataType
    kind = to_arrow_type(id_type)
    names = ["conv_id", "part", "number", *COUNTS, "audit", "sha", "piece", "lines"]
    counts = dict.fromkeys(COUNTS, LONG)
    whole = _struct(conv_id=id_type, part=INT, number=LONG, **counts, audit=STRING, sha=STRING, piece=T.BinaryType(), lines=BOOLEAN)
    columns = ["conv_id", "edit", "cost", "fault", "illegal", "new_role", "new_text"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int32(), pa.int64(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def summed(data: dict[str, list]) -> Report:
        report = Report()
        for edit, cost, fault, illegal, role, text in zip(*(data[c] for c in columns[1:]), strict=True):
            report.audit.append(edit)
            report.counts["cost"] += cost
            report.counts["illegal"] += illegal
            if fault:
                report.counts[fault] += 1
            if edit != "D":
                report.add(f"{role}:{text}".encode())
        return report

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        for first, last, data in fragments(batches, columns):
            report = summed(data)
            start = (data["conv_id"][0], part)
            facts = (*report.counts.values(), "".join(report.audit))
            if not (first or last):
                out.append((*start, 0, *facts, report.sha.hexdigest(), None, True))
            else:
                lines = [f"{r}:{t}".encode() for e, r, t in zip(data["edit"], data["new_role"], data["new_text"], strict=True) if e != "D"]
                body = b"\n".join(lines)
                for i in range(0, max(1, len(body)), PIECE_BYTES):
                    own = facts if i == 0 else (*[0] * len(COUNTS), "")
                    out.append((*start, i, *own, None, body[i : i + PIECE_BYTES], bool(lines)))
            if len(out) >= 4096 or out[-1][-2]:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, part, number, *facts, audit, _, piece, lines = row
                if now is None or now[0] != conv:
                    if now is not None:
                        yield closed(now)
                    now = (conv, part, Report())
                report = now[2]
                report.counts = {c: report.counts[c] + x for c, x in zip(COUNTS, facts, strict=True)}
                report.audit.append(audit)
                if lines and number == 0:
                    report.add(piece)
                elif lines:
                    report.sha.update(piece)
        if now is not None:
            yield closed(now)

    def closed(now: tuple) -> pa.RecordBatch:
        conv, part, report = now
        return batch_of([(conv, part, 0, *report.counts.values(), "".join(report.audit), report.sha.hexdigest(), None, True)])

    pieces = cut(edited.select(*columns).mapInArrow(run, whole))
    parts = pieces.where("sha IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    joined = pieces.where("sha IS NOT NULL").union(parts.mapInArrow(join, whole))
    return joined.select("conv_id", *COUNTS, "audit", F.col("sha").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a conversations table with faults that depend on conversation and turn."""

    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation of the whole damaged conversations table."""
    turns = read(spark, sf_dir, "conversations")
    rows = damaged(turns)
    none = turns.select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    every = none.union(rows.select("conv_id", "turn")).groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"))
    found = reports(repair(rows)).withColumnRenamed("conv_id", "_conv")
    joined = every.join(found, every.conv_id.eqNullSafe(found._conv), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    return joined.select(
        "conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
