"""Document fingerprints by winnowing, all in column expressions.

Words are hashed, rolled into hashes of ``K`` words in a row, and of every ``WINDOW`` of those the smallest is
kept, the rightmost of equals; a print kept by several windows stands once, with its position. Two
texts that share ``K + WINDOW - 1`` words in a row therefore share a print.

The next document is found without one global window: quantiles of the ids cut them into ranges of like
size, a window inside each range looks one row ahead, and the last row of a range takes the first row
of the following range from a join on the range number. Each text is shuffled once.

Defined results: null or empty text has no prints; a text of fewer than ``K`` words has one print of all its
words; equal texts have equal prints; two empty texts are alike (1). Rows follow each other by id and
equal ids by text, null ids first; repeated rows each get a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.common import full_text

K, WINDOW = 5, 8
#: Base and modulus of the rolling hash: products stay below 2 ** 62.
BASE, MODULUS = 1_000_003, 2**31 - 1
RANGE_ROWS, MOST_RANGES = 2048, 10_000


REACH = 2**31 - 1


def prints(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Prints of a text as long numbers that hold hash and position; ``opened`` takes them apart."""

    def rolled(h: Column) -> Column:
        # Each step takes the hashes one word further: k multiplications per word, no inner lists.
        short = F.least(F.lit(k), F.size(h))
        count = F.size(h) - short + 1

        def gram(i: Column) -> Column:
            out = F.get(h, i)
            for j in range(1, k):
                out = (out * BASE + F.coalesce(F.get(h, i + j), F.lit(0))) % MODULUS
            return out

        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), count - 1), gram)).otherwise(h)

    def coded(g: Column) -> Column:
        # The smallest number is the smallest hash, rightmost on ties.
        return F.transform(g, lambda x, i: F.shiftleft(x, 31).bitwiseOR(REACH - i))

    def winnowed(c: Column) -> Column:
        last = F.greatest(F.size(c) - window, F.lit(0))
        least = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(c, i + 1, F.lit(window))))
        # A print that several windows keep stands once.
        return F.when(F.size(c) > 0, F.array_distinct(least)).otherwise(c)

    words = F.filter(F.split(F.lower(text), r"[\x00-\x20\x7F]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS)))
    # One-element arrays: every stage is computed once however often the next one reads it.
    once = F.array(hashes)
    return F.element_at(F.transform(F.transform(F.transform(once, rolled), coded), winnowed), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints by their hashes."""
    hashes = lambda p: F.array_distinct(F.transform(p, lambda x: F.shiftright(x, 31)))
    left, right = hashes(a), hashes(b)
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def opened(p: Column) -> Column:
    """Array of (hash, position); positions are starts of k words, counted in words from 0."""
    return F.transform(
        p, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (REACH - x.bitwiseAND(REACH)).cast("int").alias("position"))
    )


def as_text(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["position"])), " ")


def _ranged(df: DataFrame) -> DataFrame:
    """``part``: number of the id's range; every range between the first and the last holds a row."""
    n = df.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    steps = [i / parts for i in range(1, parts)]
    bounds: list[int] = []
    if steps:
        found = df.agg(F.percentile_approx("doc_id", steps, 20 * parts).alias("cuts")).first()["cuts"]
        bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn("part", F.lit(0))
    # Cuts are ids that occur, so each range after the first begins with a row; the first may be empty.
    root = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[::root], F.array(*[F.lit(b) for b in bounds])
    count = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
    block = count(F.array(*[F.lit(b) for b in coarse]))
    inside = count(F.slice(fine, (F.greatest(block, F.lit(1)) - 1) * root + 1, F.lit(root)))
    part = F.when(F.col("doc_id").isNull() | (block == 0), 0).otherwise((block - 1) * root + inside)
    return df.withColumn("part", part.cast("int"))


def with_next(df: DataFrame, carried: dict[str, Column], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, carried columns, next_ of the text and of each carried column).

    The next document of the last one is the first. ``carried`` are expressions over ``text``, computed once per row.
    """
    names = ["text", *carried]
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), full_text(text).alias("text"))
    ranged = _ranged(rows)
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    # Ranges in use, at most MOST_RANGES numbers: their order closes the circle.
    used = sorted(r["part"] for r in ranged.select("part").distinct().collect())
    before = dict(zip(used[1:] + used[:1], used))
    table = F.array(*[F.lit(before.get(p, -1)) for p in range(max(used, default=0) + 1)])
    firsts = firsts.select(F.get(table, F.col("part")).alias("part"), F.col("first.text").alias("text"))
    firsts = firsts.withColumns(carried).select("part", *[F.col(n).alias(f"after_{n}") for n in names])
    # Structs order null ids first, and so does the window.
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "text")
    ahead = ranged.withColumns(carried).withColumns({f"ahead_{n}": F.lead(n).over(inside) for n in names})
    joined = ahead.join(firsts, "part", "left")
    return joined.select(
        "doc_id", *names, *[F.coalesce(f"ahead_{n}", f"after_{n}").alias(f"next_{n}") for n in names]
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def fingerprint(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: its prints, those of its edited text and of the next document."""
    chained = with_next(df, {"prints": prints(F.col("text"), k, window)}, doc, text)
    out = chained.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    out = out.withColumn("edited_prints", prints(F.col("edited_text"), k, window))
    return out.select(
        "doc_id", "text", "edited_text", opened(F.col("prints")).alias("prints"),
        opened(F.col("edited_prints")).alias("edited_prints"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
