"""What each filter of a chain removes, in every order of the filters.

Every row gets a mask of the filters it fails; rows are counted per (part, mask), so at most 2^k cells a part leave
the tasks, whatever share of the rows a part holds. A Gray-code walk then visits all subsets of
filters, toggling one filter at a time: each cell keeps a counter of the active filters it fails, the running
survivors change by the cells whose counter leaves or reaches zero, and the survivors of each of the 2^k
subsets are stored. Any step of any order is the difference of two stored subsets.

The copy filter needs the smallest id that holds the same text. Rows are narrowed to a 256-bit hash of the text and
counted per (text, id), then per text; only the second count can meet a hot text and it is pre-aggregated in the tasks.

Defined results: null text is empty; a null part is the empty string; a null id has no labels, counts as a row and is
neither a copy nor the first of copies; rows of equal id are no copies of each other and each counts; a document is good
or toxic if any of its labels says so; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.common import full_text

BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("rows", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text."""
    words = F.filter(F.split(text, BLANKS, -1), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(conditions: Mapping[str, Column], letters: str) -> Column:
    """Bit i is set where the condition of letter i holds; a null condition does not hold."""
    mask = F.lit(0)
    for letter, condition in conditions.items():
        mask = mask + F.when(condition, F.lit(1 << letters.index(letter))).otherwise(F.lit(0))
    return mask


def cells(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang", letters: str = "ABCDE"
) -> DataFrame:
    """(part, mask, rows, good, toxic): documents counted per part and set of failed filters."""
    content = full_text(text)
    narrow = docs.select(
        F.col(doc).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("content"), mask_of(text_filters(content), letters).alias("mask"),
    )
    flag = lambda name: F.coalesce(F.max(F.when(F.col(name) == 1, 1)), F.lit(0)).alias(name)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    counted = narrow.groupBy("id", "content", "part", "mask").agg(F.count("*").alias("n"))
    rows = counted.join(marks, "id", "left").select(
        "id", "content", "part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    # Of each kind of row: how many there are, and how many bear its smallest id. Null ids are never copies.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kinds = rows.groupBy("content", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least")
    )
    first = F.min("least.id").over(Window.partitionBy("content"))
    own = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = kinds.select("part", "mask", "good", "toxic", "n", own.alias("own"))
    copy = F.lit(1 << letters.index(COPY))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
    )
    sides = split.select("part", "good", "toxic", F.explode(both).alias("side")).select("part", "good", "toxic", "side.*")
    return sides.groupBy("part", "mask").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def gray_walk(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of ``k`` filters; ``counts`` has a row per mask and a column per measure."""
    kept = np.zeros((1 << k, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    running = counts.sum(0)
    kept[0] = running
    state = 0
    for turn in range(1, 1 << k):
        bit = (turn & -turn).bit_length() - 1
        state ^= 1 << bit
        fails = (masks >> bit & 1).astype(bool)
        if state >> bit & 1:
            running = running - counts[fails & (failing == 0)].sum(0)
            failing[fails] += 1
        else:
            failing[fails] -= 1
            running = running + counts[fails & (failing == 0)].sum(0)
        kept[state] = running
    return kept


def steps(masks: np.ndarray, counts: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    k = len(letters)
    kept = gray_walk(masks, counts, k)
    fails = [int(counts[masks >> i & 1 == 1, 0].sum()) for i in range(k)]
    alone = [int(counts[masks == 1 << i, 0].sum()) for i in range(k)]
    found, total = [], [0] * k
    for order in permutations(range(k)):
        state = 0
        for at, i in enumerate(order, 1):
            after = state | 1 << i
            removed, good, toxic = (int(v) for v in kept[state] - kept[after])
            total[i] += removed
            found.append((order, at, i, int(kept[after, 0]), removed, fails[i] - removed, alone[i], good, toxic))
            state = after
    named = {order: "".join(letters[i] for i in order) for order in permutations(range(k))}
    return [(named[order], at, *rest, total[i]) for order, at, i, *rest in found]


def audit(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Every step of every order per part, from the cells; k filters give k * k! rows a part."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def walk(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        rows = steps(table["mask"].to_numpy(np.int64), table[list(MEASURES)].to_numpy(np.int64), letters)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    return counted.groupBy("part").applyInPandas(walk, SCHEMA)


def oracle_sql(letters: str = "ABCDE") -> str:
    """DuckDB SQL for the audit of documents."""
    named = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    slots = range(1, len(letters) + 1)
    joined = " ".join(
        (f"FROM letters l{s}" if s == 1 else f"JOIN letters l{s} ON l{s}.c NOT IN ({', '.join(f'l{x}.c' for x in range(1, s))})")
        for s in slots
    )
    order = " || ".join(f"l{s}.c" for s in slots)
    return f"""
WITH letters(c, b) AS (VALUES {named}),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
),
w AS (
  SELECT d.doc_id, part, d.t, lo, regexp_extract_all(d.t, '[^\\x20\\x09-\\x0D]+') AS words FROM d JOIN firsts ON d.t = firsts.t
),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > lo THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
subsets AS (
  SELECT part, s, sum(CASE WHEN mask & s = 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN mask & s = 0 THEN good ELSE 0 END) AS good,
    sum(CASE WHEN mask & s = 0 THEN bad ELSE 0 END) AS bad
  FROM cells, (SELECT unnest(range({1 << len(letters)})) AS s) GROUP BY part, s
),
single AS (
  SELECT part, c, sum(CASE WHEN mask & b <> 0 THEN n ELSE 0 END) AS fails, sum(CASE WHEN mask = b THEN n ELSE 0 END) AS alone
  FROM cells, letters GROUP BY part, c
),
orders AS (SELECT {order} AS o {joined}),
steps AS (
  SELECT o, step, substr(o, step, 1) AS c,
    (SELECT sum(b) FROM letters WHERE contains(substr(o, 1, step), c)) AS after_,
    (SELECT coalesce(sum(b), 0) FROM letters WHERE contains(substr(o, 1, step - 1), c)) AS before_
  FROM orders, (SELECT CAST(unnest(range(1, {len(letters) + 1})) AS INTEGER) AS step)
),
taken AS (
  SELECT x.part, o, step, c, y.n AS kept, x.n - y.n AS removed, x.good - y.good AS good_lost, x.bad - y.bad AS toxic_lost
  FROM steps JOIN subsets x ON x.s = before_ JOIN subsets y ON y.s = after_ AND y.part = x.part
)
SELECT taken.part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(fails - removed AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY taken.part, taken.c) AS BIGINT) AS shapley
FROM taken JOIN single ON single.part = taken.part AND single.c = taken.c"""
