"""Fill-in-the-middle rewriting of documents, cut between lines.

One full match of ``(unit)*`` by the regex library keeps every repetition of its group, so ``ends(1)`` of one match
gives the number of units and the end of each: both cut offsets are read off by index. A text longer
than ``SPAN`` code points is matched in spans that end with a line, because the library holds all repetitions of
one match in memory; units never reach over a line end, so they are the same.

The draws depend on seed and id only: four 32-bit groups of a sha256 name both cuts, whether a document
stays plain and which order it takes.

Defined results: null text is empty; an empty text and one that holds a mark of its own stay plain; a null id
draws as the empty string; repeated rows and equal ids are rewritten one by one; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
SPAN, BATCH_CHARS = 1 << 20, 1 << 23
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(pattern, text: str) -> list[int]:
    """End offset of every unit; ``pattern`` is the compiled ``(unit)*``."""
    if len(text) <= SPAN:
        return pattern.fullmatch(text).ends(1)
    ends: list[int] = []
    at = 0
    while at < len(text):
        stop = text.find("\n", at + SPAN) + 1 or len(text)
        ends += pattern.fullmatch(text, at, stop).ends(1)
        at = stop
    return ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]


def rewrite(text: str, ends: list[int], h: list[int], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, prefix length, middle length, output) of one text."""
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    if h[3] % 100 < spm:
        return "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transform(
    df: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50,
    unit: str = LINES,
) -> DataFrame:
    """Every document with its number of units, form, cut lengths in code points and rewritten text.

    ``rate`` per cent of the documents are rewritten, ``spm`` per cent of these with the suffix first. ``unit``
    must match every text from end to end and must not reach over a line end.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(f"({unit})*")
        for batch in sliced(batches):
            rows, size = [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = value.as_py() or ""
                ends = unit_ends(pattern, content)
                form, prefix, middle, output = rewrite(content, ends, draws(seed, key), rate, spm)
                rows.append((key, len(ends), form, prefix, middle, output))
                size += len(output)
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return df.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from: a rewritten text holds no marks, so the three marks cut it."""
    part = lambda i: F.get(F.split(output, "<[PSM]>", -1), F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def oracle_sql(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """DuckDB SQL for the query's columns."""
    group = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, {group(0)} AS h1, {group(1)} AS h2,
    {group(2)} AS h3, {group(3)} AS h4 FROM d
), c AS (
  SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain'
      WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:lo], ''), '') AS p,
    coalesce(array_to_string(units[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(units[hi + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM p"""
