"""Chat formatting by minimum-cost role repair.

A conversation is legal when it is an optional system message and then user and
assistant messages in turn, the last one an assistant's.  Every turn is given a
role and joined to the automaton in one of three ways: as the next message,
merged into the message before it, or after an empty message that is inserted.
Relabelling, merging and inserting have costs; dynamic programming finds the
cheapest repair, and of equally cheap ones the one whose sequence of states is
first in order (system, user, assistant).

The conversations are dealt by ranges of (conversation, turn), so one that is
longer than a task spans several.  Each such fragment is summed up as a matrix of
costs between states; a few numbers for each partition then tell every fragment
its costs to the end and its state at entry, and it is repaired on its own.

Rows: a null or unknown role may become any role for less; a null text is an
empty one; a null conversation is one like any other; turns are ordered by turn
(nulls first), then role and text, and repeated rows stay repeated turns; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, read, record_batch

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (SYSTEM, USER, ASSISTANT)
NAMES = ("", "system", "user", "assistant")
#: Spellings of the roles; any other is unknown.
ROLES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT,
}
#: Which message may follow which.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT, NAME_UNKNOWN = 1, 2, 3, 1
FAR = 10**9


class Step(NamedTuple):
    """The cheapest way to take a turn from a state to a role."""

    cost: int
    action: str
    inserted: int


def _step(kind: int, state: int, role: int) -> Step:
    cost = 0 if kind == role else RELABEL if kind else NAME_UNKNOWN
    if role in NEXT[state]:
        return Step(cost, "keep" if kind == role else "relabel", 0)
    if state == role:
        return Step(cost + MERGE, "merge" if kind == role else "relabel and merge", 0)
    return Step(FAR, "", 0)


def _inserting(kind: int, state: int, role: int) -> Step:
    between = next((x for x in NEXT[state] if x != SYSTEM and role in NEXT[x]), 0)
    if not between:
        return Step(FAR, "", 0)
    cost = (0 if kind == role else RELABEL if kind else NAME_UNKNOWN) + INSERT
    return Step(cost, "keep" if kind == role else "relabel", between)


#: STEPS[kind][state][role]: of equal costs, without insertion first.
STEPS = [
    [[min(_step(k, s, r), _inserting(k, s, r), key=lambda x: x.cost) if r else Step(FAR, "", 0) for r in range(4)] for s in range(4)]
    for k in range(4)
]
#: Messages that are inserted after the last turn, by state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END = [INSERT * len(CLOSING[s]) for s in range(4)]


def kind_of(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), 0)


def backward(kinds: list[int], after: list[int]) -> list[list[int]]:
    """Costs to the end from each state before each turn, ``after`` being those after the last."""
    togo = [after]
    for kind in reversed(kinds):
        last = togo[-1]
        togo.append([min(STEPS[kind][s][r].cost + last[r] for r in STATES) for s in range(4)])
    return togo[::-1]


def forward(kinds: list[int], togo: list[list[int]], state: int) -> list[int]:
    """The states after each turn of the first cheapest path from ``state``."""
    path = []
    for i, kind in enumerate(kinds):
        costs = [(STEPS[kind][state][r].cost + togo[i + 1][r], r) for r in STATES]
        state = min(costs)[1]
        path.append(state)
    return path


def matrix(kinds: list[int]) -> list[list[int]]:
    """Costs from each state before the turns to each state after them."""
    columns = [backward(kinds, [0 if s == end else FAR for s in range(4)])[0] for end in range(4)]
    return [[min(FAR, columns[end][s]) for end in range(4)] for s in range(4)]


def _fragments(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, bool, dict[str, list]]]:
    """(is the partition's first, is its last, columns) of each conversation's rows here."""
    held: dict[str, list] | None = None
    first = True
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in columns}
        ids, at = data["conv_id"], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if held is not None and held["conv_id"][0] == ids[at]:
                for c in columns:
                    held[c] += data[c][at:end]
            else:
                if held is not None:
                    yield first, False, held
                    first = False
                held = {c: data[c][at:end] for c in columns}
            at = end
    if held is not None:
        yield first, True, held


def _edges(rows: DataFrame, summary: Callable[[tuple[int, bool], list[int]], list[int]]) -> list:
    """A few numbers for each partition's first and last fragment, in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for first, last, data in _fragments(batches, ["conv_id", "role"]):
            if first or last:
                numbers = summary((part, first), [kind_of(r) for r in data["role"]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([first], pa.bool_()),
                        pa.array([numbers], pa.list_(pa.int64())),
                        pa.array(data["conv_id"][:1], id_type),
                    ],
                    names=["part", "first", "numbers", "conv_id"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    found = rows.select("conv_id", "role").mapInArrow(run, f"part int, first boolean, numbers array<bigint>, conv_id {kind}")
    return sorted(found.collect(), key=lambda r: (r.part, not r.first))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each message part of the repaired conversations.

    ``conv_id, turn, step, role, new_role, action, rendered``: the parts of a
    conversation in the order of (turn, step), rendered and joined, are its
    text.  An inserted message has action ``insert`` and no role.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    order = ["conv_id", "turn", "role", "text", "_row"]
    rows = cut(
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    edges = _edges(rows, lambda _, kinds: [x for line in matrix(kinds) for x in line])
    # Runs of fragments of one conversation, in consecutive partitions.
    runs: list[list] = []
    for edge in edges:
        if runs and edge.first and runs[-1][-1].conv_id == edge.conv_id:
            runs[-1].append(edge)
        else:
            runs.append([edge])
    after: dict[tuple[int, bool], list[int]] = {}
    for run in runs:
        togo = END
        for edge in reversed(run):
            after[edge.part, edge.first] = togo
            costs = [edge.numbers[4 * s : 4 * s + 4] for s in range(4)]
            togo = [min(costs[s][r] + togo[r] for r in STATES) for s in range(4)]
    entry: dict[tuple[int, bool], int] = {}
    if any(len(run) > 1 for run in runs):

        def exits(place: tuple[int, bool], kinds: list[int]) -> list[int]:
            togo = backward(kinds, after[place])
            return [forward(kinds, togo, s)[-1] for s in range(4)]

        leads = {(e.part, e.first): e.numbers for e in _edges(rows, exits)}
        for run in runs:
            state = START
            for edge in run:
                entry[edge.part, edge.first] = state
                state = leads[edge.part, edge.first][state]
    ends = {(run[-1].part, run[-1].first) for run in runs}
    types = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def mend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for first, last, data in _fragments(batches, ["conv_id", "turn", "role", "text"]):
            place = (part, first)
            inner = not (first or last)
            kinds = [kind_of(r) for r in data["role"]]
            start = START if inner else entry.get(place, START)
            path = forward(kinds, backward(kinds, END if inner else after[place]), start)
            closed = inner or place in ends
            out = _messages(kinds, path, start, data["text"], closed)
            index = pa.array([i for i, *_ in out], pa.int32())
            ids = pa.array(data["conv_id"], id_types[0]).take(index)
            numbers = pa.array(data["turn"], id_types[1]).take(index)
            roles = [None if a == "insert" else data["role"][i] for i, _, a, _ in out]
            made = record_batch(
                step=(_steps(out), pa.int32()),
                role=(roles, pa.string()),
                new_role=([NAMES[r] for _, r, _, _ in out], pa.string()),
                action=([a for _, _, a, _ in out], pa.string()),
                rendered=([t for *_, t in out], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([ids, numbers, *made.columns], names=["conv_id", "turn", *made.schema.names])

    from pyspark.sql.pandas.types import to_arrow_type

    id_types = [to_arrow_type(turns.schema[c].dataType) for c in ("conv_id", "turn")]
    schema = (
        f"conv_id {types['conv_id']}, turn {types['turn']}, step int, role string, new_role string, "
        "action string, rendered string"
    )
    return rows.drop("_row").mapInArrow(mend, schema)


def _messages(kinds: list[int], path: list[int], state: int, texts: list[str | None], closed: bool) -> list[tuple[int, int, str, str]]:
    """(turn's index, role, action, rendered part) in order, with inserted messages."""
    out = []
    for i, (kind, role, text) in enumerate(zip(kinds, path, texts, strict=True)):
        step = STEPS[kind][state][role]
        if step.inserted:
            out.append((i, step.inserted, "insert", render(step.inserted, "")))
        merged = step.action.endswith("merge")
        out.append((i, role, step.action, "\n" + (text or "") if merged else render(role, text or "")))
        state = role
    for role in CLOSING[state] if closed else ():
        out.append((len(kinds) - 1, role, "insert", render(role, "")))
    return out


def _steps(out: list[tuple[int, int, str, str]]) -> list[int]:
    """The place of each part among those of its turn."""
    steps: list[int] = []
    for n, (i, *_) in enumerate(out):
        steps.append(steps[-1] + 1 if n and out[n - 1][0] == i else 0)
    return steps


def render(role: int, text: str) -> str:
    """A message's opening mark and its text."""
    return f"\n<|{NAMES[role]}|>\n{text}"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired turns of the whole conversations table."""
    return repair(read(spark, sf_dir, "conversations"))
