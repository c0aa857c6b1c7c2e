"""Structure repair by lightest derivations, against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirewise.llm import structure

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile(r"(s?(ua)+)?")
ORDER = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired lines) by a search from the end; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            for initial, name in (("u", "user"), ("a", "assistant")):
                if initial in ORDER[last]:
                    cost, audit, lines = best(i, initial, inserted + 1)
                    options.append((cost + 5, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for new, sign, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if new[:1] and new[:1] in ORDER[last]:
                        cost, audit, lines = best(i + 1, new[:1], 0)
                        options.append((cost + more + price, sign + audit, (f"{new}:{text}", *lines)))
        return min(options, key=lambda x: x[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(every, rows):
    """The contract's rows; ``every`` gives the conversations, ``rows`` what is left of them."""
    by = defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    out = []
    for conv in {r[0] for r in every}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, marked = set(), Counter(), []
        for _, _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return Counter(out)


def found(spark, tmp_path, rows, parts=3):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_id", F.lit("clash"))
    folder = tmp_path / f"{len(rows)}-{parts}"
    frame.repartition(parts).write.mode("overwrite").parquet(str(folder / "conversations.parquet"))
    got = structure.op13_structure(spark, str(folder))
    assert got.columns == COLUMNS
    return Counter(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    texts = ["Well.", "No", "", " \n", "Yes!", "Why?  ", "Ünï 日本.", None, "a: b\nc."]
    roles = ["user", "assistant", "system", "tool", None, "", "u", "Assistant"]
    out = []
    for conv in range(150):
        last = "assistant"
        for turn in range(rng.randint(1, 9)):
            last = rng.choice(roles) if rng.random() < 0.3 else "user" if last != "user" else "assistant"
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), last, rng.choice(texts) if rng.random() < 0.4 else f"text {conv} {turn}."))
    out += [(None, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(5)]
    out += [out[3], out[3], (500, 1, "system", "Alone."), (501, None, None, None)]
    return out


def test_against_brute_force(spark, tmp_path, rows):
    assert found(spark, tmp_path, rows) == brute(rows, damage(rows))


def test_conversation_over_many_partitions(spark, tmp_path):
    """One conversation holds most rows, faults and copies of rows far apart."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice([f"{t}.", f"{t}", "same.", "", "x" * 900 + "."])) for t in range(180)]
    rows += [(3, 1, "user", "a."), (3, 2, "assistant", "b."), (9, 1, "user", "c.")]
    assert found(spark, tmp_path, rows) == brute(rows, damage(rows))


def test_no_rows_left_and_empty_tables(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "a.")]
    assert found(spark, tmp_path, rows) == Counter([(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])
    assert found(spark, tmp_path, []) == Counter()


def test_edits_restore_and_are_legal(spark, rows):
    """The operator's own rows: every input row once, and what stays is legal."""
    clean = [r for r in rows if r[2] is not None]
    frame = spark.createDataFrame(clean, "conv_id long, turn long, role string, text string")
    got = structure.repair(frame).collect()
    assert sum(r.edit != "I" for r in got) == len(clean)
    by = defaultdict(str)
    for r in sorted(got, key=lambda r: (r.part, r.place)):
        by[r.conv_id] += (r.new_role or "")[:1]
    assert all(LEGAL.fullmatch(x) for x in by.values())


def test_agenda_joins_fragments_as_if_they_were_one():
    rng = random.Random(9)
    for _ in range(60):
        kinds = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(2, 24))]
        whole = structure.audit_of(kinds, structure.START, -1)
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds)) for _ in range(3))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        states = structure.route([structure.matrix(p) for p in parts])
        assert "".join(structure.audit_of(p, s, t) for p, (s, t) in zip(parts, states)) == whole


def test_inserts_win_where_deleting_costs_more(monkeypatch):
    monkeypatch.setattr(structure, "DELETE", 50)
    monkeypatch.setattr(structure, "REROLE", 50)
    structure.axioms.cache_clear()
    got = structure.derive([structure.axioms((k, 0)) for k in (structure.SYSTEM, structure.ASSISTANT, structure.ASSISTANT, structure.USER)], structure.START, -1)
    structure.axioms.cache_clear()
    assert got[structure.START, -1] == (15, "KIKIKKI")


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, structure.op13_structure(spark, SF).collect())) == brute(rows, damage(rows))
