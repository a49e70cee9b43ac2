"""Helpers shared by the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.session import ensure_checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the plan ends here, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller steps: what a worker builds from one step stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def full_text(name: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_starts(lengths: Column, block: int = 128) -> Column:
    """Exclusive running sums of an array, in blocks so that the work stays near linear."""
    add = lambda acc, x: acc + x
    total = lambda a: F.aggregate(a, F.lit(0), add)
    inner = lambda a, base: F.transform(a, lambda _, i: base + total(F.slice(a, F.lit(1), i)))

    def blocked(all_: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")),
            lambda b: F.slice(all_, b * block + 1, F.lit(block)),
        )
        sums = lambda bs: F.transform(bs, total)
        # Block sums are few: their own running sums may be taken plainly.
        return bound(
            blocks,
            lambda bs: bound(
                inner_of(sums(bs)),
                lambda bases: F.flatten(F.transform(bs, lambda a, i: inner(a, F.get(bases, i)))),
            ),
        )

    def inner_of(values: Column) -> Column:
        return bound(values, lambda v: inner(v, F.lit(0)))

    def starts(all_: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.when(F.size(all_) == 0, none).when(F.size(all_) <= block, inner(all_, F.lit(0))).otherwise(blocked(all_))

    return bound(lengths, starts)


def located(text: Column, pattern: str, needed: Column | None = None, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,match,before,after[,part]>>.

    Offsets are code points, end exclusive. Spark has no match positions, so the text between
    matches gives them: split() and regexp_extract_all() walk the same matches. ``needed`` is a
    cheap test that spares both passes; ``before`` and ``after`` reach to the neighbouring match.
    """
    kind = "struct<start:int,end:int,match:string,before:string,after:string,part:string>"
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def build(x: Column) -> Column:
        gap, hit, part = x["gaps"], x["hits"], x["parts"]
        lengths = F.transform(hit, lambda h, i: F.length(F.get(gap, i)) + F.length(h))
        rows = F.arrays_zip(hit.alias("m"), running_starts(lengths).alias("s"), part.alias("p"))
        return F.transform(
            rows,
            lambda r, i: F.struct(
                (r["s"] + F.length(F.get(gap, i))).alias("start"),
                (r["s"] + F.length(F.get(gap, i)) + F.length(r["m"])).alias("end"),
                r["m"].alias("match"), F.get(gap, i).alias("before"), F.get(gap, i + 1).alias("after"),
                r["p"].alias("part"),
            ),
        )

    found = bound(F.struct(gaps.alias("gaps"), hits.alias("hits"), parts.alias("parts")), build)
    empty = F.array().cast(f"array<{kind}>")
    return found if needed is None else F.when(needed, found).otherwise(empty)


def listed(spans: Column) -> Column:
    """kind:start:end of array<struct<start,rank,end,kind,...>>, already in order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
