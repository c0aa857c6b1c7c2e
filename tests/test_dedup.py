"""Near-duplicate rows against brute force over all pairs."""

from __future__ import annotations

import itertools
import random
import re
from difflib import SequenceMatcher

import pytest

from quirewise.operators import dedup, graph

MASK = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b"
UNKNOWN = ("", "-", "n/a", "none", "unknown")


def masked(text):
    return re.sub(MASK, "DATEMASK", text or "", flags=re.ASCII)


def words_of(text):
    return frozenset(re.findall("[a-z0-9]{2,}", masked(text).lower()))


def joined(n, links):
    group = list(range(n))
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    return group


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeilnorst", k=rng.randint(3, 8))) for _ in range(120)]
    rows = []
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.randint(12, 60))
        for _ in range(rng.randint(1, 7)):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 3, 8])):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(now)
            if rng.random() < 0.3:
                now.insert(rng.randrange(len(now)), f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/2024")
            rows.append((" ".join(now), rng.choice(["01/02/2024", "01/02/2024", "03/04/2024", None, "-", "N/A"])))
    long = " ".join(rng.choices(vocabulary, k=400))
    rows += [(long, "01/02/2024"), (long + " tail one", "03/04/2024"), (long + " tail two", "-"), (None, None), ("", "-"), ("!!", "-")]
    rows += rows[:3]
    rng.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


def brute(items, cross_date):
    sets = [words_of(t) for _, t, _ in items]
    dates = ["" if " ".join((d or "").lower().split()) in UNKNOWN else " ".join(d.lower().split()) for _, _, d in items]
    links = []
    for a, b in itertools.combinations(range(len(items)), 2):
        if not sets[a] or not sets[b] or len(sets[a] & sets[b]) < 0.7 * len(sets[a] | sets[b]):
            continue
        if dates[a] == dates[b]:
            links.append((a, b))
        elif cross_date is not None:
            one, two = (masked(items[i][1])[:1500] for i in (a, b))
            if SequenceMatcher(None, one, two).ratio() >= cross_date:
                links.append((a, b))
    group = joined(len(items), links)
    return {i: g for i, g in enumerate(group) if group.count(g) > 1}


@pytest.mark.parametrize("hot", [2000, 2])
def test_jaccard_pairs(spark, items, hot):
    frame = spark.createDataFrame(items, "id long, text string, date string").repartition(3)
    sets = dedup.signature_classes(frame, "id")
    names = {r.id: r.sid for r in sets.collect()}
    distinct = sets.groupBy("sid").agg({"words": "first"}).toDF("sid", "words")
    got = {(r.a, r.b): r.jaccard for r in dedup.jaccard_pairs(distinct, hot=hot).collect()}
    expected = {}
    for (a, x, _), (b, y, _) in itertools.combinations(items, 2):
        one, two = words_of(x), words_of(y)
        if one and two and one != two and len(one & two) >= 0.7 * len(one | two):
            expected[tuple(sorted((names[a], names[b])))] = len(one & two) / len(one | two)
    assert got == pytest.approx(expected) and len(expected) > 20


@pytest.mark.parametrize("cross_date", [None, 0.99, 0.9, 0.6])
def test_clusters(spark, items, cross_date):
    frame = spark.createDataFrame(items, "id long, text string, date string").repartition(3)
    got = {r.id: r.cluster for r in dedup.clusters(frame, "id", cross_date=cross_date).collect()}
    assert got == brute(items, cross_date)
    assert dedup.clusters(frame.limit(0), "id", cross_date=cross_date).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 101 + i) for i in range(50)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    group = joined(300, links)
    assert got == {x: group[x] for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lowest_ratio_and_confirmation(spark):
    texts = {1: ["same text here", "same text here"], 2: ["alpha beta gamma", "alpha beta delta", "zeta eta"], 3: ["alone"], 4: ["x" * 30, "x" * 29 + "y"], 5: ["p q", "r s"]}
    rows = [(g * 10 + i, g, t) for g, ts in texts.items() for i, t in enumerate(ts)]
    members = spark.createDataFrame(rows, "id long, grp long, text string")
    low = {r.grp: r.similarity for r in dedup.lowest_ratios(members, "grp", "id").collect()}
    for g, ts in texts.items():
        pairs = [SequenceMatcher(None, a, b).ratio() for a, b in itertools.combinations(ts, 2)]
        assert low[g] == pytest.approx(round(min(pairs), 3) if pairs else 1.0)
    facts = spark.createDataFrame([(1, True, 1.0), (2, True, 0.3), (3, True, 1.0), (4, True, 0.9), (5, False, 0.4)], "grp long, passes boolean, similarity double")
    verdicts = spark.createDataFrame([(20, True, False), (21, True, False), (22, False, False), (40, None, True), (41, False, False)], "id long, same boolean, failed boolean")
    kept = {(r.id, r.how) for r in dedup.confirmed(members, facts, verdicts, "grp", "id").collect()}
    # Group 1 needs no verdict; 22 is refused; 3 is a group of one; of 4 one is left; 5 does not pass.
    assert kept == {(10, "similarity"), (11, "similarity"), (20, "confirmed"), (21, "confirmed")}


def test_groups(spark):
    rows = [(1, 5, 9, True, False), (1, 5, 8, True, None), (1, 6, 7, True, True), (1, 6, 3, True, False), (1, 7, 1, True, False), (1, 7, 2, False, False), (2, None, 4, True, False)]
    members = spark.createDataFrame(rows, "doc long, grp long, id long, include boolean, dismissed boolean")
    assert {(r.doc, r.n) for r in dedup.unreviewed(members, "doc", "grp").collect()} == {(1, 1)}
    numbers = {r.id: r.n for r in dedup.number_groups(members.where("grp IS NOT NULL").withColumnRenamed("grp", "c"), "c", "id").withColumnRenamed("grp", "n").collect()}
    assert numbers == {1: 1, 2: 1, 3: 2, 7: 2, 8: 3, 9: 3}
    left = dedup.without_member(members, spark.createDataFrame([(9,)], "id long"), "grp", "id")
    assert {r.id: r.grp for r in left.collect()} == {9: None, 8: None, 7: 6, 3: 6, 1: 7, 2: 7, 4: None}
    stored = spark.createDataFrame([(1, 9, 0.5, True, True), (2, None, None, True, False)], "id long, dupe_group long, dupe_similarity double, dupe_dismissed boolean, dupe_primary boolean")
    new = dedup.renumbered(stored, spark.createDataFrame([(2, 1, 0.97)], "id long, grp long, similarity double"), "id")
    assert sorted(tuple(r) for r in new.collect()) == [(1, None, None, False, True), (2, 1, 0.97, False, False)]


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("hot", [20_000, 7])
def test_pairs_are_sifted_where_they_meet(spark, hot):
    """Sets of all sizes of sketches; what is shuffled grows with the sets and what is alike, not with all that share a word."""
    rng = random.Random(3)
    vocabulary = [rng.getrandbits(64) - (1 << 63) for _ in range(1500)]
    sets = [set(rng.sample(vocabulary, rng.choice((60, 64, 65, 90, 128, 130, 200, 256, 300, 700)))) for _ in range(500)]
    for base in sets[:60]:
        kept = rng.sample(sorted(base), round(len(base) * rng.choice((0.7, 0.75, 0.85, 1.0))))
        sets.append(set(kept) | set(rng.sample(vocabulary, rng.randrange(1 + len(base) // 6))))
    sets = list({frozenset(s) for s in sets})
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "sid long, words array<long>").repartition(3)
    before = shuffled_rows(spark)
    got = {(r.a, r.b): r.jaccard for r in dedup.jaccard_pairs(frame, hot=hot).collect()}
    rows = shuffled_rows(spark) - before
    pairs = {(i, j): len(s & t) / len(s | t) for (i, s), (j, t) in itertools.combinations(enumerate(sets), 2)}
    assert got == pytest.approx({k: v for k, v in pairs.items() if v >= 0.7}) and len(got) > 20
    assert hot == 7 or rows < sum(map(len, sets))


def crowded(rng):
    """Sets of two crowds around related templates, some farther off, and some of their own."""
    vocabulary = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    one = rng.sample(vocabulary, 60)
    two = one[:46] + rng.sample(vocabulary, 14)
    sets = []
    for base, changes in [(one, 4)] * 260 + [(two, 4)] * 160 + [(one, 14)] * 60 + [(two, 22)] * 60:
        kept = rng.sample(base, len(base) - rng.randrange(changes + 1))
        sets.append(frozenset(kept) | frozenset(rng.sample(vocabulary, rng.randrange(changes + 1))))
    sets += [frozenset(rng.sample(vocabulary, rng.randrange(1, 80))) for _ in range(200)]
    return sorted(set(sets), key=sorted)


@pytest.mark.parametrize("part", [3000, 90])
def test_pairs_of_crowds_are_not_shuffled(spark, monkeypatch, part):
    """Of n sets that are all alike, n times n pairs are found, while what is shuffled grows with n."""
    monkeypatch.setattr(dedup, "PART", part)
    sets = crowded(random.Random(8))
    frame = spark.createDataFrame([(f"k{i * 7919 % 1000:03d}", sorted(s)) for i, s in enumerate(sets)], "sid string, words array<long>").repartition(3)
    names = [f"k{i * 7919 % 1000:03d}" for i in range(len(sets))]
    before = shuffled_rows(spark)
    got = [(r.a, r.b, r.jaccard) for r in dedup.jaccard_pairs(frame).collect()]
    rows = shuffled_rows(spark) - before
    pairs = {tuple(sorted((names[i], names[j]))): len(s & t) / len(s | t) for (i, s), (j, t) in itertools.combinations(enumerate(sets), 2)}
    want = {k: v for k, v in pairs.items() if v >= 0.7}
    assert len(got) == len(want) > 40_000 and {(a, b): v for a, b, v in got} == pytest.approx(want)
    assert rows < 60_000, rows


@pytest.mark.parametrize("cross_date", [None, 0.97])
def test_crowds_are_clustered_by_few_links(spark, monkeypatch, cross_date):
    """Rows that are all alike are joined by as many links as rows, not by all pairs; dates keep them apart as before."""
    monkeypatch.setattr(dedup, "PART", 60)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeilnorst", k=7)) for _ in range(900)]
    base = rng.sample(vocabulary, 50)
    rows = []
    for i in range(300):
        now = list(base)
        for _ in range(rng.randrange(6)):
            now[rng.randrange(50)] = rng.choice(vocabulary)
        rows.append((i, " ".join(now), rng.choice(["-", "01/02/2020", "03/02/2020"])))
    rows += [(i, " ".join(rng.sample(vocabulary, 30)), "-") for i in range(300, 320)]
    linked = []
    plain = dedup.components
    monkeypatch.setattr(dedup, "components", lambda links: linked.append(links.count()) or plain(links))
    frame = spark.createDataFrame(rows, "id long, text string, date string").repartition(3)
    got = {r.id: r.cluster for r in dedup.clusters(frame, "id", cross_date=cross_date).collect()}
    assert got == brute(rows, cross_date) and len(got) >= 290
    assert linked[0] < 8_000, linked


@pytest.mark.parametrize("most", [200, 5])
def test_lowest_ratios_by_parts(spark, monkeypatch, most):
    """A large group's pairs are compared by many tasks, and all of them count."""
    monkeypatch.setattr(dedup, "EXCERPTS", most)
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrd", k=5)) for _ in range(60)]
    rows = [(i, f"g{i % 2}", " ".join(rng.choices(words, k=rng.randrange(6, 9)))) for i in range(50)]
    rows += [(100 + i, "g0", rows[i][2]) for i in (0, 2, 4)] + [(200, "g2", "alone")]
    members = spark.createDataFrame(rows, "id long, `group` string, text string").repartition(3)
    got = {r.group: r.similarity for r in dedup.lowest_ratios(members, "group", "id").collect()}
    want = {"g2": 1.0}
    for g in ("g0", "g1"):
        own = sorted(r for r in rows if r[1] == g)
        want[g] = round(min(SequenceMatcher(None, a[2], b[2]).ratio() for a, b in itertools.combinations(own, 2)), 3)
    assert got == pytest.approx(want)


def test_ratio_that_ends_above():
    from quirewise.functions.ratios import ratio

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcde ", k=rng.randrange(1, 60))) for _ in range(2))
        whole = SequenceMatcher(None, a, b).ratio()
        for low in (0.1, whole - 0.01, whole, whole + 0.01, 0.9):
            assert ratio(a, b, above=low) == whole if whole <= low else ratio(a, b, above=low) > low
