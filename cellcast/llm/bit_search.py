"""Exact top-k inner-product search on a bit-sliced index.

Index. Components become integers floor(scale * x). Rows are dealt into blocks; in a block every attribute is a stack
of bitmaps, one per binary digit of its value above the block's smallest, with one bit per row. Each block is one row
of a table in the shared folder, its rows sorted by id.

Search. A query's weights are numbers too: digit j of weight d adds attribute d's slices, shifted by j, to the
sum. Negative weights take the complement, which shifts all sums by a constant. All slices of equal place value are
added by full adders on whole bitmaps, for all queries of a step at once. The sum is a stack of slices
again, and the best rows are selected from its most significant slice downward: rows with the digit set that still fit
into k are taken, else only they stay open. Rows open after the last slice have equal sums; this boundary is resolved
by the smaller id, and the scores of the chosen rows are read from the slices. All of it is integer arithmetic, so the
result is exact. The best of all blocks are ranked per query.

Size. Blocks hold at most ``BLOCK`` rows (in expectation), there are ``BLOCKS`` of them at least, and queries travel in
packs of ``PACK``. A task holds one block and the packs of one portion, at most ``PORTION`` queries. Nothing is
broadcast by hand and no row or query goes to the driver: only the row count does.

Defined results: a row without id, with a null vector or with a null or non-finite component takes no part; vectors of
other lengths are filled up with zeros; candidates of a query are all rows of another id, repeated rows each take a
place, and a repeated query row is answered again; with fewer than k candidates all are returned; an empty table gives
no rows; other columns are not read. Components must stay below 2^40 after scaling and scores must fit 63 bits, else the
task fails with an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.common import written

SCALE = 256
BLOCK, BLOCKS, PACK, PORTION = 1 << 18, 32, 256, 1 << 19
#: 64-bit words of one bitmap operation over the queries of a step.
STEP_WORDS = 1 << 13
INDEX = "block long, rows int, width int, digits int, low long, ids binary, slices binary"
PACKS = "portion long, query_ids binary, numbers binary, width int, weights binary"
FOUND = "query long, query_id long, vec_id long, score long"
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


LARGEST = 1.7976931348623157e308
LIMIT = 1 << 40


def quantised(df: DataFrame, vec: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x, number) of the rows that take part; ``number`` tells equal rows apart."""
    rows = df.select(
        F.col(vec).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"),
        F.monotonically_increasing_id().alias("number"),
    )
    # Spark sorts NaN above all numbers, so one bound rejects NaN and infinities.
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) <= F.lit(LARGEST), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("x"), "number"
    )


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows of equal length, filled up with zeros."""
    lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    if len(values) and not -LIMIT < int(values.min()) <= int(values.max()) < LIMIT:
        raise OverflowError("components are too large for the index")
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, first one in the lowest bit."""
    raw = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    bits = np.packbits(flags, bitorder="little")
    raw[: len(bits)] = bits
    return raw.view("<u8")


def sliced_block(x: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(smallest value, digits, bitmaps by attribute, digit and word) of a block's rows."""
    low = int(x.min(initial=0))
    digits = int(x.max(initial=0) - low).bit_length()
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], digits, words), np.uint64)
    for d in range(x.shape[1]):
        y = x[:, d] - low
        for b in range(digits):
            out[d, b] = packed_bits((y >> b & 1).astype(bool))
    return low, digits, out


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """The bit-sliced index of quantised rows: one row per block, kept in the shared folder."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(table.column("x"))[order]
        low, digits, bitmaps = sliced_block(x)
        return pa.table({
            "block": [key[0].as_py()], "rows": pa.array([len(x)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()),
            "digits": pa.array([digits], pa.int32()), "low": [low], "ids": [ids[order].tobytes()], "slices": [bitmaps.tobytes()],
        })

    dealt = rows.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"), "vec_id", "x")
    return written(dealt.groupBy("block").applyInArrow(build, INDEX), "bit-index")


def packs(rows: DataFrame, count: int) -> DataFrame:
    """Queries in packs of about ``PACK``, weights in the narrowest integers that hold them."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table.column("x"))
        ends = (int(x.min(initial=0)), int(x.max(initial=0)))
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max)
        return pa.table({
            "portion": [key[0].as_py() * PACK // PORTION], "query_ids": [table.column("vec_id").to_numpy().tobytes()],
            "numbers": [table.column("number").to_numpy().tobytes()], "width": pa.array([x.shape[1]], pa.int32()),
            "weights": [x.astype(kind).tobytes()],
        })

    pack = F.pmod(F.xxhash64("number"), F.lit(count)).alias("pack")
    return rows.select(pack, "vec_id", "x", "number").groupBy("pack").applyInArrow(build, PACKS)


def weighted_sums(bitmaps: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices (queries x words), lowest digit first, of sum |w| y: y is a value, or its complement where w < 0."""
    waiting: list[list[np.ndarray]] = []

    def add(level: int, x: np.ndarray) -> None:
        while True:
            while len(waiting) <= level:
                waiting.append([])
            held = waiting[level]
            if len(held) < 2:
                held.append(x)
                return
            a, b = held
            half = a ^ b
            waiting[level] = [half ^ x]
            x = (a & b) | (half & x)
            level += 1

    sign = np.where(weights < 0, ALL, np.uint64(0))
    size = np.abs(weights)
    places = [(j, np.where(size >> j & 1, ALL, np.uint64(0))) for j in range(int(size.max(initial=0)).bit_length())]
    for d in range(weights.shape[1]):
        used = [(j, on[:, d, None]) for j, on in places if on[:, d].any()]
        for b in range(bitmaps.shape[1]):
            base = bitmaps[d, b][None, :] ^ sign[:, d, None]
            for j, on in used:
                add(b + j, base & on)
    level = 0
    none = np.zeros((len(weights), bitmaps.shape[2]), np.uint64)
    out = []
    while level < len(waiting):
        while len(waiting[level]) > 1:
            # Two left: the third summand is zero.
            add(level, none)
        out.append(waiting[level][0] if waiting[level] else none)
        level += 1
    return out


def positions(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the bits that are set, in order."""
    return np.nonzero(np.unpackbits(bits.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"))


def chosen(sums: list[np.ndarray], open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best rows per query among ``open_``; of equal sums the first rows."""
    need = np.full(len(open_), k, np.int64)
    taken = np.zeros_like(open_)
    for digit in reversed(sums):
        hit = open_ & digit
        n = np.bitwise_count(hit).sum(1, dtype=np.int64)
        fits = (n <= need)[:, None]
        taken |= np.where(fits, hit, np.uint64(0))
        open_ = np.where(fits, open_ & ~digit, hit)
        need -= np.where(fits[:, 0], n, 0)
    query, row = positions(taken)
    at, tied = positions(open_)
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    inside = rank < need[at]
    return np.concatenate([query, at[inside]]), np.concatenate([row, tied[inside]])


def best(bitmaps: np.ndarray, low: int, ids: np.ndarray, query_ids: np.ndarray, weights: np.ndarray, k: int):
    """(query, row, score) of the k best rows of a block for each of some queries."""
    digits, words = bitmaps.shape[1:]
    top = (1 << digits) - 1
    size = [int(v) for v in np.abs(weights).sum(1)]
    if max(size, default=0) * (top + abs(low)) >= 1 << 62:
        raise OverflowError("scores of these vectors do not fit 63 bits")
    sums = weighted_sums(bitmaps, weights)
    every = packed_bits(np.ones(len(ids), bool))
    open_ = np.repeat(every[None, :], len(weights), 0)
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for i in np.flatnonzero(last > first):
        own = np.zeros(len(ids), bool)
        own[first[i] : last[i]] = True
        open_[i] &= ~packed_bits(own)
    query, row = chosen(sums, open_, k)
    score = np.zeros(len(query), np.int64)
    for place, digit in enumerate(sums):
        score += (digit[query, row >> 6] >> (row & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << place
    shift = low * weights.sum(1) - top * np.where(weights < 0, -weights, 0).sum(1)
    return query, row, score + shift[query]


def search(
    df: DataFrame, queries: DataFrame | None = None, k: int = 5, vec: str = "vec_id", embedding: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """The ``k`` best rows of ``df`` for each row of ``queries``: query_id, rank, vec_id, score.

    Without ``queries`` every row of ``df`` is a query.
    """
    rows = quantised(df, vec, embedding, scale)
    asked = rows if queries is None else quantised(queries, vec, embedding, scale)
    blocks = max(BLOCKS, -(-df.count() // BLOCK))
    count = max(1, -(-asked.count() // PACK))
    portions = -(-count * PACK // PORTION)
    left = index(rows, blocks).withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))))
    right = packs(asked, count).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    names = [c.split()[0] for c in FOUND.split(", ")]

    def find(block: pa.Table, dealt: pa.Table) -> pa.Table:
        found = [np.empty((4, 0), np.int64)]
        for b in block.to_pylist():
            words = -(-b["rows"] // 64)
            bitmaps = np.frombuffer(b["slices"], "<u8").reshape(b["width"], b["digits"], words)
            ids = np.frombuffer(b["ids"], np.int64)
            step = max(1, STEP_WORDS // words)
            for p in dealt.to_pylist():
                query_ids, numbers = (np.frombuffer(p[c], np.int64) for c in ("query_ids", "numbers"))
                cell = len(p["weights"]) // max(1, len(query_ids) * p["width"])
                weights = np.frombuffer(p["weights"], f"<i{cell or 8}").reshape(len(query_ids), p["width"]).astype(np.int64)
                common = min(b["width"], p["width"])
                for at in range(0, len(query_ids), step):
                    part = slice(at, at + step)
                    q, row, score = best(bitmaps[:common], b["low"], ids, query_ids[part], weights[part, :common], k)
                    found.append(np.stack([numbers[part][q], query_ids[part][q], ids[row], score]))
        return pa.table(dict(zip(names, np.concatenate(found, 1))))

    unit = ["block", "portion"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(find, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle_sql(every: int = 50, k: int = 5, scale: int = SCALE) -> str:
    """DuckDB SQL for queries whose id is divisible by ``every``, by all products."""
    return f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
),
parts AS (SELECT r, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM rows_),
bad AS (SELECT DISTINCT r FROM parts WHERE x IS NULL OR NOT isfinite(x)),
sound AS (SELECT r, vec_id FROM rows_ WHERE r NOT IN (SELECT r FROM bad)),
whole AS (SELECT r, i, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts WHERE r NOT IN (SELECT r FROM bad)),
pairs AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id FROM sound q JOIN sound c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % {every} = 0
),
sums AS (
  SELECT a.r AS q, b.r AS c, sum(a.v * b.v) AS score FROM whole a JOIN sound s ON s.r = a.r AND s.vec_id % {every} = 0
  JOIN whole b ON a.i = b.i GROUP BY a.r, b.r
),
ranked AS (
  SELECT query_id, vec_id, CAST(coalesce(score, 0) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY pairs.q ORDER BY coalesce(score, 0) DESC, vec_id) AS rank
  FROM pairs LEFT JOIN sums ON sums.q = pairs.q AND sums.c = pairs.c
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
