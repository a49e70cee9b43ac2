"""The Jaccard join against all pairs, and components against union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.llm import jaccard_join as J
from cellcast.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)]) if 0 < len(words) < 3 else frozenset(zip(words, words[1:], words[2:]))


def closure(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    """Rows are named by place; a component by its smallest id."""
    sets = [shingles(t) for _, t in rows]
    links = [
        (x, y) for x in range(len(rows)) for y in range(x)
        if sets[x] and sets[y] and 10 * len(sets[x] & sets[y]) >= 9 * len(sets[x] | sets[y])
    ]
    root = closure(range(len(rows)), links)
    ids: dict = {}
    for x, (i, _) in enumerate(rows):
        ids.setdefault(root[x], []).append(i)
    key = lambda v: -1 if v is None else v
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted((key(i), len(sets[x]), key(least[root[x]])) for x, (i, _) in enumerate(rows)), root, sets


def family(rng, n, copies, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(n)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def fixture_rows(odd_rows):
    rng = random.Random(11)
    texts = [t for n, c, e in ((12, 8, 1), (25, 8, 1), (60, 25, 2), (150, 25, 5), (300, 12, 9)) for t in family(rng, n, c, e)]
    passage = next(family(rng, 60, 1, 0))
    texts += [passage + " " + next(family(rng, 70, 1, 0)) for _ in range(20)]
    return list(odd_rows) + [(1000 + 7 * i % 499, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1024, 4])
def test_join_equals_all_pairs(spark, fixture_rows, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    df = spark.createDataFrame(fixture_rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("set", "tile", "n", "mark", "group", "component")})
    key = lambda v: -1 if v is None else v
    got = sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in J.join(df).collect())
    assert got == brute(fixture_rows)[0]


def test_one_of_each_group_stays(spark, fixture_rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in fixture_rows], "doc_id long, text string, mark string")
    out = J.keep_one(df)
    assert out.columns == ["doc_id", "text", "mark"]
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    _, root, sets = brute(fixture_rows)
    blank = sum(not s for s in sets)
    assert len(rows) == blank + len({root[x] for x, s in enumerate(sets) if s})
    kept = [i for i, t in rows if shingles(t)]
    least = {}
    for x, (i, _) in enumerate(fixture_rows):
        if sets[x]:
            least.setdefault(root[x], []).append(i)
    assert sorted(map(str, kept)) == sorted(str(min((i for i in v if i is not None), default=None)) for v in least.values())


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_share_a_tile(percent):
    rng = np.random.default_rng(percent)
    bands = J.Bands(percent)
    for _ in range(400):
        n = int(rng.integers(2, 600))
        a = np.unique(J.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        together = 2 * len(a)
        differ = together * (100 - percent) // (100 + percent)
        cut = int(rng.integers(0, differ + 1))
        fresh = J.mix(rng.integers(0, 2**62, int(rng.integers(0, differ - cut + 1))).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], fresh]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and len(b):
            same = np.array_equal(a, b)
            assert same or len(np.intersect1d(bands.tiles(a), bands.tiles(b)))
            assert J._linked(a, b, percent)


def test_few_shingles_spread_over_few_ranges():
    """Sets whose common shingles all lie in ranges that differ still meet, through their empty ranges."""
    bands = J.Bands(90)
    low = np.arange(1, 20, dtype=np.uint64)
    assert len(np.intersect1d(bands.tiles(low), bands.tiles(low[1:])))


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = closure(nodes, [(a, b) for a, b in links if a != b])
    assert got == {i: want[i] for i in nodes}


def test_empty_table(none):
    assert J.join(none).count() == 0
    assert J.keep_one(none).count() == 0


@pytest.mark.parametrize("edits", [5, 9])
def test_pairs_grow_with_the_members_of_a_cluster(spark, monkeypatch, edits):
    """Near copies on both sides of the threshold: pairs handed out and decided stay in proportion to the documents."""
    def decided(count):
        rng = random.Random(edits)
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows = []
        for i in range(count):
            words = list(base)
            for at in rng.sample(range(400), edits):
                words[at] = f"v{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        made = []
        real = J.written

        def counting(df, name):
            out = real(df, name)
            if name in ("candidates", "pairs"):
                made.append(out.count())
            return out

        monkeypatch.setattr(J, "written", counting)
        got = sorted((r["doc_id"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        monkeypatch.setattr(J, "written", real)
        assert got == sorted((i, c) for i, _, c in brute(rows)[0])
        return sum(made)

    few, many = decided(30), decided(90)
    assert many <= 6 * max(few, 30)


@pytest.mark.parametrize("percent", [80, 90])
def test_a_set_names_one_tile_more_than_a_linked_one_may_break(percent):
    """Not all ranges: the thinnest, which unlike texts share most often, stay unnamed."""
    rng = np.random.default_rng(percent)
    bands = J.Bands(percent)
    for n in (12, 40, 200, 700, 3000):
        s = np.unique(J.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        differ = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
        assert len(bands.tiles(s)) <= len(bands.bands(n)) * (differ + 1)


def test_steps_do_not_grow_with_rounds(spark, monkeypatch):
    """A cluster with most pairs just over and just under the threshold is settled in a fixed number of steps."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(400), 7):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    names, real = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(J, "BLOCK", 16)
    got = sorted((r["doc_id"], r["component_id"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, c) for i, _, c in brute(rows)[0])
    assert len(names) <= 8
