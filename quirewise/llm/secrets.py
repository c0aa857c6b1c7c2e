"""Secret scans by rules and by inferred credential formats.

The base rules find assignments, access keys and hexadecimal runs.  Beyond them,
one probabilistic automaton for each kind is inferred from the credentials that
the rules label: their prefix tree moves by word characters and by each sign, and
every state keeps the shares of its character classes.  States are merged where
their frequencies of moves, ends and classes, and those of all their successors,
differ by no more than a Hoeffding bound allows; so a format's length, its fixed
beginning and its separators stay states of their own.  Every long run of
credential characters in a text is then scored by how much likelier a credential
automaton makes it than the automaton of ordinary long words; a run is a secret
where the gain per character is high enough.  Of a run that the base rules cover
in part, each other part is scored.  A part that is not a secret as a whole, or is
longer than ``DEPTH``, is scored by its windows from every character on.  Scanning
takes time in proportion to the text.

The automata are fitted on at most ``per_kind`` different labelled strings of
each kind (those of the smallest hash), and on ``DEPTH`` characters of each;
scanning covers all texts in full.

Rows: a null text counts as empty and has no spans; repeated rows are scanned
each; without labelled credentials only the base rules apply, without ordinary
long words all characters are taken to be equally likely in them; an empty table
gives an empty result; other columns are passed on where a whole row is.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.columns import extended

from .common import ASCII_LOWER, bound_batches, cut, map_batches, read, record_batch

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "format")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Shortest run that is scored as a credential.
RUN = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{RUN},}}")
#: Labelled strings of a kind that an automaton is fitted on, at most.
PER_KIND = 400
#: Characters of a labelled string that are learnt, and of the longest window that is scored.
DEPTH = 64
#: Nats that a window may lose at first.
SLACK = 3.0
#: Windows that are scored at once.
STARTS = 4096
#: Confidence of the merge test.
ALPHA = 0.5
#: Short candidates whose results a worker keeps.
REMEMBERED = 100_000
#: Gain per character, in nats, from which a run is a secret.
GAIN = 1.0

_RUNS = bytes(b"h"[0] if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_BODY = bytes(b"h"[0] if re.match(r"[A-Za-z0-9+/_=.-]", chr(b)) and b < 128 else 32 for b in range(256))
#: Classes of characters: five of word characters, by which no automaton moves apart, and the signs.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", ".", "-")
WORD_CLASSES = 5
#: Moves of an automaton: by a word character, and by each sign.
MOVES = 1 + len(CLASSES) - WORD_CLASSES
_MOVE = np.array([0] * WORD_CLASSES + list(range(1, MOVES)))
_CLASS = np.zeros(128, np.int8)
for _i, _signs in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _signs]] = _i
#: What is added to every count: a step never seen keeps a small share.
RARE = 0.05


def classes_of(text: str) -> np.ndarray:
    """The class of each character of a run."""
    return _CLASS[np.frombuffer(text.encode("ascii"), np.uint8)]


@dataclass
class Automaton:
    """A deterministic automaton with counts, by state: moves, their counts, classes of word characters, ends."""

    moves: list[dict[int, int]] = field(default_factory=list)
    counts: list[dict[int, int]] = field(default_factory=list)
    classes: list[list[int]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def new(self) -> int:
        self.moves.append({})
        self.counts.append({})
        self.classes.append([0] * WORD_CLASSES)
        self.ends.append(0)
        return len(self.ends) - 1

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.counts[state].values())

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log-probability by state and class, and of an end; a step never seen leads to the first state."""
        moves = np.zeros((len(self.ends), len(CLASSES)), np.int64)
        logs, ends = np.empty(moves.shape), np.empty(len(moves))
        for state, seen in enumerate(self.counts):
            whole = math.log(self.total(state) + RARE * (MOVES + 1))
            wordy = math.log(sum(self.classes[state]) + RARE * WORD_CLASSES)
            ends[state] = math.log(self.ends[state] + RARE) - whole
            for i, move in enumerate(_MOVE.tolist()):
                logs[state, i] = math.log(seen.get(move, 0) + RARE) - whole
                if i < WORD_CLASSES:  # the class's share is divided among its characters
                    logs[state, i] += math.log(self.classes[state][i] + RARE) - wordy - math.log(len(CLASSES[i]))
                moves[state, i] = self.moves[state].get(move, 0)
        return moves, logs, ends

    def log_likelihood(self, text: str) -> float:
        """Log-probability of a whole string."""
        moves, logs, ends = self.tables
        state, total = 0, 0.0
        for c in classes_of(text).tolist():
            total += logs[state, c]
            state = moves[state, c]
        return float(total + ends[state])


def even_automaton() -> Automaton:
    """One state, by which every character is equally likely."""
    sizes = [len(c) for c in CLASSES]
    counts = {0: sum(sizes[:WORD_CLASSES])} | dict.fromkeys(range(1, MOVES), 1)
    return Automaton([dict.fromkeys(range(MOVES), 0)], [counts], [sizes[:WORD_CLASSES]], [1])


def prefix_tree(strings: list[str]) -> Automaton:
    """The prefix tree of the strings' moves, with counts; a string beyond ``DEPTH`` does not end in it."""
    tree = Automaton()
    tree.new()
    for string in strings:
        state = 0
        for c in classes_of(string[:DEPTH]).tolist():
            move = int(_MOVE[c])
            if move not in tree.moves[state]:
                tree.moves[state][move] = tree.new()
            tree.counts[state][move] = tree.counts[state].get(move, 0) + 1
            if c < WORD_CLASSES:
                tree.classes[state][c] += 1
            state = tree.moves[state][move]
        tree.ends[state] += len(string) < DEPTH
    return tree


def _differ(a: int, n: int, b: int, m: int, bound: float) -> bool:
    return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _compatible(auto: Automaton, one: int, two: int, bound: float) -> bool:
    """Whether two states' frequencies agree, and those of all states below them."""

    def apart(a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and _differ(a, n, b, m, bound)

    todo, met = [(one, two)], set()
    while todo:
        a, b = todo.pop()
        if a == b or (a, b) in met:
            continue
        met.add((a, b))
        n, m = auto.total(a), auto.total(b)
        if not n or not m:
            continue
        if apart(auto.ends[a], n, auto.ends[b], m):
            return False
        of_a, of_b = auto.classes[a], auto.classes[b]
        if any(apart(x, sum(of_a), y, sum(of_b)) for x, y in zip(of_a, of_b, strict=True)):
            return False
        for symbol in auto.counts[a].keys() | auto.counts[b].keys():
            if _differ(auto.counts[a].get(symbol, 0), n, auto.counts[b].get(symbol, 0), m, bound):
                return False
            if symbol in auto.moves[a] and symbol in auto.moves[b]:
                todo.append((auto.moves[a][symbol], auto.moves[b][symbol]))
    return True


def _fold(auto: Automaton, into: int, state: int) -> None:
    """Add a subtree's counts to a state and its successors."""
    todo = [(into, state)]
    while todo:
        a, b = todo.pop()
        auto.ends[a] += auto.ends[b]
        auto.classes[a] = [x + y for x, y in zip(auto.classes[a], auto.classes[b], strict=True)]
        for symbol, n in auto.counts[b].items():
            auto.counts[a][symbol] = auto.counts[a].get(symbol, 0) + n
            if symbol in auto.moves[a]:
                todo.append((auto.moves[a][symbol], auto.moves[b][symbol]))
            else:
                auto.moves[a][symbol] = auto.moves[b][symbol]


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the strings' prefix tree.

    Accepted states are fixed in order of their discovery; each next state is
    folded into the first accepted one it is compatible with, or accepted.
    """
    auto = prefix_tree(strings)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [0], deque((0, s) for s in sorted(auto.moves[0]))
    while blue:
        parent, symbol = blue.popleft()
        state = auto.moves[parent][symbol]
        if state in red:
            continue
        match = next((r for r in red if _compatible(auto, r, state, bound)), None)
        if match is None:
            red.append(state)
            blue.extend((state, s) for s in sorted(auto.moves[state]))
        else:
            auto.moves[parent][symbol] = match
            _fold(auto, match, state)
            blue = deque((r, s) for r in red for s in sorted(auto.moves[r]) if auto.moves[r][s] not in red)
    place = {state: i for i, state in enumerate(red)}
    return Automaton(
        [{s: place[t] for s, t in auto.moves[r].items()} for r in red],
        [auto.counts[r] for r in red],
        [auto.classes[r] for r in red],
        [auto.ends[r] for r in red],
    )


@dataclass(frozen=True)
class Formats:
    """Automata of the credential kinds and of ordinary long words."""

    credentials: dict[str, Automaton]
    ordinary: Automaton | None

    def gain(self, text: str) -> float:
        """How much likelier per character the best credential format makes a run."""
        if not self.credentials or self.ordinary is None:
            return -math.inf
        best = max(a.log_likelihood(text) for a in self.credentials.values())
        return (best - self.ordinary.log_likelihood(text)) / len(text)

    @cached_property
    def seen(self) -> dict[tuple[str, float], list[tuple[int, int]]]:
        """Results of short candidates, which repeat a lot."""
        return {}

    def secrets(self, text: str, gain: float) -> list[tuple[int, int]]:
        """Secret parts of a candidate: all of it, or its windows of ``RUN`` to ``DEPTH`` characters that gain enough.

        A window ends where its gain beyond ``gain`` a character is largest, and
        counts where that is positive and never fell below ``-SLACK`` before.
        """
        if not self.credentials or self.ordinary is None or len(text) < RUN:
            return []
        if len(text) > DEPTH:
            return self.windows(text, gain)
        if (known := self.seen.get((text, gain))) is not None:
            return known
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        found = [(0, len(text))] if self.gain(text) >= gain else self.windows(text, gain)
        self.seen[text, gain] = found
        return found

    def windows(self, text: str, gain: float) -> list[tuple[int, int]]:
        """Stretches of windows that gain enough."""
        codes = classes_of(text)
        taken = np.zeros(len(text), bool)
        for low in range(0, len(text) - RUN + 1, STARTS):
            starts = np.arange(low, min(low + STARTS, len(text) - RUN + 1))
            depth = min(DEPTH, len(text) - low)
            at = starts + np.arange(depth)[:, None]
            symbols = codes[np.minimum(at, len(text) - 1)]

            def likelihood(auto: Automaton, symbols: np.ndarray = symbols) -> np.ndarray:
                moves, logs, _ = auto.tables
                state, out = np.zeros(symbols.shape[1], np.int64), np.empty(symbols.shape)
                for t, row in enumerate(symbols):
                    out[t] = logs[state, row]
                    state = moves[state, row]
                return out.cumsum(axis=0)

            best = np.max([likelihood(a) for a in self.credentials.values()], axis=0) - likelihood(self.ordinary)
            best -= gain * np.arange(1, depth + 1)[:, None]
            least = np.minimum.accumulate(best, axis=0)
            best[at >= len(text)] = -math.inf
            best[: RUN - 1] = -math.inf
            ends = best.argmax(axis=0)
            for i in np.flatnonzero((best.max(axis=0) >= 0) & (least[ends, np.arange(len(starts))] >= -SLACK)):
                taken[starts[i] : starts[i] + ends[i] + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], taken.view(np.int8), [0]))))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[Span, str]]:
    """Spans of the base rules and the credential in each, by start."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found: list[tuple[Span, str]] = []
    low = raw.translate(ASCII_LOWER)
    if any(word in low for word in WORDS):
        found += [(("assign", m.start(), m.end()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(("access", m.start(), m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"h" * 16 in raw.translate(_RUNS):
        found += [(("hex", m.start(), m.end()), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda x: (x[0][1], KINDS.index(x[0][0])))


def _parts(runs: Iterable[re.Match[str]], spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of runs that no span covers; both are sorted by start, and passed once."""
    reach, at = 0, 0
    for run in runs:
        start, end = run.span()
        start = max(start, min(reach, end))
        while at < len(spans) and spans[at][1] < end:
            _, s, e = spans[at]
            if start < s:
                yield start, s
            start, reach, at = max(start, min(e, end)), max(reach, e), at + 1
        if start < end:
            yield start, end


def spans_of(text: str, formats: Formats | None, gain: float = GAIN) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    base = [span for span, _ in base_spans(text, raw)]
    more: list[Span] = []
    if formats and formats.credentials and b"h" * RUN in raw.translate(_BODY):
        for start, end in _parts(CANDIDATE.finditer(text), base):
            more += [("format", start + a, start + b) for a, b in formats.secrets(text[start:end], gain)]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def _labels_of(text: str) -> Iterator[tuple[str, str]]:
    """The labelled strings of a text: credentials by kind, and ordinary long words."""
    raw = text.encode("utf-8", "surrogatepass")
    found = base_spans(text, raw)
    for (kind, _, _), value in found:
        yield kind, value[:DEPTH]
    if b"h" * RUN in raw.translate(_BODY):
        whole = {m.span() for m in CANDIDATE.finditer(text)}
        for start, end in _parts(CANDIDATE.finditer(text), [span for span, _ in found]):
            if (start, end) in whole and not any(c.isdigit() for c in text[start:end]):
                yield "ordinary", text[start:end][:DEPTH]


def _spark_hash(value: str) -> int:
    """What Spark's ``xxhash64`` gives for a string: each task keeps the strings that all tasks together would choose."""
    number = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42)
    return number - (1 << 64) if number >> 63 else number


def fit(docs: DataFrame, per_kind: int = PER_KIND) -> Formats:
    """Infer the formats from the credentials that the base rules label.

    Ordinary words are candidates without digits outside the base spans.
    """

    def labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = {kind: {} for kind in (*KINDS[:3], "ordinary")}
        for batch in batches:
            for text in filter(None, batch.column(0).to_pylist()):
                for kind, value in _labels_of(text):
                    kept[kind][value] = _spark_hash(value)
            for kind, values in kept.items():
                if len(values) > 4 * per_kind:
                    kept[kind] = dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:per_kind])
        rows = [(k, v) for k, values in kept.items() for v in sorted(values, key=lambda v: (values[v], v))[:per_kind]]
        if rows:
            yield record_batch(kind=([k for k, _ in rows], pa.string()), value=([v for _, v in rows], pa.string()))

    bound_batches(docs.sparkSession)
    rows = cut(docs.select("text").mapInArrow(labelled, "kind string, value string").distinct())
    least = lambda kind: rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(per_kind)
    chosen = least("ordinary")
    for kind in KINDS[:3]:
        chosen = chosen.unionByName(least(kind))
    by_kind: dict[str, list[str]] = {}
    for row in sorted(chosen.collect()):
        by_kind.setdefault(row.kind, []).append(row.value)
    ordinary = by_kind.pop("ordinary", [])
    credentials = {k: infer(v) for k, v in by_kind.items() if k in KINDS}
    return Formats(credentials, infer(ordinary) if ordinary else even_automaton())


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, formats: Formats | None = None, key: str = "doc_id", gain: float = GAIN) -> DataFrame:
    """``key, base, spans`` of every row: arrays of ``kind, start, end`` in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    kind = docs.schema[key].dataType.simpleString()
    items = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    record = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [spans_of(t or "", shared.value, gain) for t in batch.column(1).to_pylist()]
        columns = [pa.array([record(x[i]) for x in both], items) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "base", "spans"])

    spans = "array<struct<kind: string, start: int, end: int>>"
    return map_batches(docs.select(key, "text"), per_batch, f"`{key}` {kind}, base {spans}, spans {spans}")


def redact(docs: DataFrame, formats: Formats | None = None, gain: float = GAIN) -> DataFrame:
    """The rows of ``docs`` with every secret's characters replaced by ``[KIND]``.

    Overlapping spans become one, named after the first.  A column ``n_chars``
    is set anew; a text without secrets stays as it is, a null one too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        clean = [redact_text(t, spans_of(t, shared.value, gain)[1]) if t else t for t in texts]
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["text"] = pa.array(clean, batch.schema.field("text").type)
        if "n_chars" in columns:
            old = batch.column("n_chars").to_pylist()
            sizes = [n if c == t else len(c) for n, t, c in zip(old, texts, clean, strict=True)]
            columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(docs, per_batch, extended(docs.schema))


def redact_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans")
    )
