"""Packing of tokenised documents into fixed-length sequences.

Documents become token ids with an end mark and are cut into pieces of at most ``capacity`` ids: full
pieces fill sequences of their own, what is left of each document is packed. Pieces are
dealt into groups by a hash, so each group is a random sample of bounded expected size; inside a group they
are placed by first-fit decreasing, where a tournament tree over the free room of all sequences finds
the first that fits in logarithmic time. Groups share nothing: each is one call on a worker, and its result
depends on its pieces only.

The number of groups follows rows and bytes, so no group grows with the corpus. Copies of one document are
spread, as the hash holds the place of a row in its task besides the piece; for a table that is read from
files a repeated task sees the same places.

Defined results: null or empty text is the end mark alone; a text of any length is cut; repeated rows and
equal ids are packed one by one; a null id stays null; an empty table gives no rows; columns other than
id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import sliced

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, salt long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20
END_ID = 0


def _encoding(ranks_path: str, pattern: str, special: dict[str, int]):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(
    df: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], capacity: int = 1024, doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents; ``ids`` holds unsigned little-endian 32-bit ids.

    ``special`` names strings that are one id each where they stand in a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern, special)
        row = 0
        for batch in sliced(batches):
            docs, starts, lengths, totals, raw, salts = [], [], [], [], [], []
            size = 0

            def ready() -> pa.RecordBatch:
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip((docs, starts, lengths, totals, raw, salts), kinds)]
                return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoding.encode_to_numpy(value.as_py() or "", allowed_special="all")
                ids = np.append(ids.astype("<u4"), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    docs.append(key)
                    starts.append(at)
                    lengths.append(len(part))
                    totals.append(len(ids))
                    raw.append(part.tobytes())
                    salts.append(row)
                row += 1
                size += 4 * len(ids)
                if size > GROUP_BYTES:
                    yield ready()
                    docs, starts, lengths, totals, raw, salts = [], [], [], [], [], []
                    size = 0
            if docs:
                yield ready()

    return df.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed from long to short.

    Leaves of the tree are sequences in order of opening, untouched ones with full room; a node holds the
    most room below it, so going left wherever it suffices ends at the first sequence that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    number, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number[order[:full]] = np.arange(full)
    rest = order[full:]
    leaves = 1 << max(0, int(len(rest) - 1).bit_length()) if len(rest) else 1
    tree = [capacity] * (2 * leaves)
    for i in rest.tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        number[i], offset[i] = full + node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return number, offset


def pack(parts: DataFrame, groups: int, capacity: int = 1024) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; a sequence belongs to one group."""

    def place(key: tuple, table: pa.Table) -> pa.Table:
        # A fixed order makes a repeated task give the same sequences.
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        number, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        ids = pc.add(pa.array(number), pa.scalar(key[0].as_py() << 32, pa.int64()))
        kept = table.select(["doc_id", "start", "length", "doc_tokens", "ids"])
        return kept.append_column("sequence_id", ids).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("salt", "doc_id", "start", "doc_tokens"), F.lit(groups))
    return parts.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(place, PACKED)


def pack_documents(
    df: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], capacity: int = 1024, doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All documents packed: one row per piece with its ids and place."""
    sums = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
    groups = 1 + sums["rows"] // GROUP_ROWS + (sums["bytes"] or 0) // GROUP_BYTES
    return pack(pieces(df, ranks_path, pattern, special, capacity, doc, text), int(groups), capacity)
