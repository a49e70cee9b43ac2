"""Fill-in-the-middle against plain slicing, and round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cellcast.llm import fill_middle


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def rewritten(df, **options):
    out = fill_middle.transform(df, **options)
    back = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    return [tuple(r) for r in back.collect()]


TEXTS = ["a\nb\nc", "a\nb\n", "\n", "\n\n\n", "x<P>\ny", "x\n<M>", "<S>", "<P\n>", "<\n<\nP>", "é𝄞\n€\r\nx\x0by z\n", "<p>\n<s>\n"]


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_odd_rows(spark, odd, odd_rows, rate, spm):
    more = [(1000 + 37 * k + i, t) for i, t in enumerate(TEXTS) for k in range(6)]
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = rewritten(both, rate=rate, spm=spm)
    want = [brute(i, t, rate=rate, spm=spm) for i, t in odd_rows + more]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((r[:-1] for r in got), key=key) == sorted(want, key=key)
    texts = sorted((t or "") for _, t in odd_rows + more)
    assert sorted(r[-1] for r in got) == texts


def test_extra_columns_and_empty(odd, none):
    assert fill_middle.transform(odd).count() == odd.count()
    assert fill_middle.transform(none).collect() == []


def test_spans_give_the_same_units(monkeypatch):
    import regex

    pattern = regex.compile(f"({fill_middle.LINES})*")
    for text in ("", "\n" * 100, "ab\n" * 50 + "tail", "x" * 99, "x" * 30 + "\n" + "y" * 40 + "\nz\n"):
        want = pattern.fullmatch(text).ends(1)
        monkeypatch.setattr(fill_middle, "SPAN", 7)
        assert fill_middle.unit_ends(pattern, text) == want
        monkeypatch.undo()
        assert fill_middle.unit_ends(pattern, text) == want


def test_very_many_lines():
    import regex

    pattern = regex.compile(f"({fill_middle.LINES})*")
    assert fill_middle.unit_ends(pattern, "a\n" * 3_000_000)[-2:] == [5_999_998, 6_000_000]
