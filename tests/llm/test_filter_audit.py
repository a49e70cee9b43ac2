"""The filter audit against a chain of filters run order by order."""

import re
from itertools import permutations

import numpy as np

from cellcast.llm import filter_audit
from cellcast.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    first: dict = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and i > first[t],
        }
        out.append((i, part or "", fails))
    return out


def brute(rows, good, toxic):
    flagged = failures(rows)
    out = []
    for part in sorted({p for _, p, _ in flagged}):
        docs = [(i, f) for i, p, f in flagged if p == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[c]]
                stay = [(i, f) for i, f in left if not f[c]]
                total[c] += len(gone)
                found.append((
                    part, "".join(order), step, len(stay), len(gone), sum(f[c] for _, f in docs) - len(gone),
                    sum(f[c] and sum(f.values()) == 1 for _, f in docs), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone), c,
                ))
                left = stay
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def audited(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.cells(docs, labels)).collect())


def test_odd_rows(spark, odd, odd_rows):
    rows = [(i, t, None if k % 2 else "en") for k, (i, t) in enumerate(odd_rows)]
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (5, 1, None), (18, None, 1), (None, 1, 1), (19, 1, 1), (999, 1, 1), (20, 2, 0)],
        "doc_id long, quality int, toxic int",
    )
    assert audited(odd, labels) == brute(rows, {1, 5, 19}, {1, 18, 19})


def test_parts_by_texts_and_copies(spark):
    """Copies over several parts, with the first one in another part, under a null id and repeated."""
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (4, long, "en"), (4, long, "en"), (2, long, "de"), (9, long, None), (None, long, "en"), (7, long + " #", ""), (8, "A " * 300, "de"),
        (1, "B " * 300, "de"), (3, "A " * 300, "en"), (6, None, "fr"), (5, "", "fr"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert audited(docs, labels) == brute(rows, {1, 3, 5, 7, 9}, {0, 3, 6, 9})


def test_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(none, labels) == []


def test_walk_visits_every_subset():
    rng = np.random.default_rng(2)
    masks, counts = np.arange(16), rng.integers(0, 9, (16, 3))
    kept = filter_audit.gray_walk(masks, counts, 4)
    for s in range(16):
        assert (kept[s] == counts[masks & s == 0].sum(0)).all()


def test_query_has_all_orders(spark, small_dir):
    rows = QUERIES["op12_filter_audit"](spark, small_dir).collect()
    parts = {r["part"] for r in rows}
    assert len(rows) == 600 * len(parts) and len({r["filter_order"] for r in rows}) == 120
