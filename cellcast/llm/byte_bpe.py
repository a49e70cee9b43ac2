"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut into pieces by the vocabulary's pattern. Pieces a task has not met go into
zero-padded matrices, one per length bucket. In each round every row merges its leftmost pair of
minimum rank: pair ranks come from a hashed table, the merged cell's tail moves left, and rows
without a pair leave the matrix. Ids of known pieces come from a bounded cache.

Rows are independent: no shuffle, and a lost task repeats alone. Memory is bounded by one Arrow
batch, cut again into slices of ``SLICE`` characters, and the cache limit.

Defined results: null or empty text has no ids and decodes to zero bytes; a piece of more than ``LONG``
bytes takes the same merges from a heap, so that its cost stays near linear; a row answers for itself, so
repeated rows and equal ids need no rule; an empty table gives no rows; other columns pass through and
a column named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from cellcast.llm.common import sliced

NONE = np.int32(2**31 - 1)
LONG, SLICE, KNOWN = 256, 1_000_000, 400_000


class Vocabulary:
    """Ranks of a vocabulary file with the hashed table of all pairs that join to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file if line.strip())}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        values, slots, left = np.fromiter(self.pairs.values(), np.int32, len(keys)), self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # open addressing: the first key of a free slot stays, the others move on
            at = slots[left]
            free = left[self.keys[at] == -1]
            winners = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[winners]], self.ranks[slots[winners]] = keys[winners], values[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they join to no token or one side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        keys[(left < 0) | (right < 0)] = -2
        slot, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        open_ = np.arange(keys.size)
        flat, slots, result = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            held = self.keys[slots[open_]]
            same = held == flat[open_]
            result[open_[same]] = self.ranks[slots[open_[same]]]
            open_ = open_[~same & (held != -1)]
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
        return result.reshape(keys.shape)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def merge_matrix(vocab: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of pieces of like length."""
    rows, width = len(pieces), max(map(len, pieces))
    ids = np.full((rows, width), -1, np.int32)
    sizes = np.fromiter(map(len, pieces), np.int64, rows)
    inside = np.arange(width) < sizes[:, None]
    ids[inside] = vocab.single[np.frombuffer(b"".join(pieces), np.uint8)]
    done: list[np.ndarray | None] = [None] * rows
    row = np.arange(rows)
    ranks = vocab.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((rows, 1), NONE, np.int32)
    while True:
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(row)), at]
        ended = best == NONE
        for r in np.flatnonzero(ended):
            done[row[r]] = ids[r][ids[r] >= 0]
        if ended.all():
            return done
        live = ~ended
        ids, ranks, row, at, best = ids[live], ranks[live], row[live], at[live], best[live]
        each = np.arange(len(row))
        ids[each, at] = best
        # The tail after the merged pair moves one cell to the left.
        cell = np.arange(ids.shape[1])
        source = np.minimum(cell + (cell > at[:, None]), ids.shape[1] - 1)
        ids = np.take_along_axis(ids, source, 1)
        ids[:, -1] = np.where(at < ids.shape[1] - 1, -1, ids[:, -1])
        pair = np.arange(ranks.shape[1])
        ranks = np.take_along_axis(ranks, np.minimum(pair + (pair > at[:, None]), ranks.shape[1] - 1), 1)
        ranks[:, -1] = NONE
        width = int((ids >= 0).sum(axis=1).max())
        ids, ranks = ids[:, : max(width, 2)], ranks[:, : max(width - 1, 1)]
        inner = at < ids.shape[1] - 1
        ranks[each[inner], at[inner]] = vocab.rank(ids[each[inner], at[inner]], ids[each[inner], at[inner] + 1])
        back = at > 0
        ranks[each[back], at[back] - 1] = vocab.rank(ids[each[back], at[back] - 1], ids[each[back], at[back]])


def merge_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """The same merges for one long piece, from a heap of (rank, place)."""
    ids = vocab.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = vocab.pairs.get
    heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (r, a))
    return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes lists of texts; keeps the ids of up to ``KNOWN`` pieces."""

    def __init__(self, path: str, pattern: str):
        self.vocab, self.pattern = vocabulary(path), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        found: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG:
                found[i] = merge_long(self.vocab, b)
            else:
                buckets.setdefault((len(b) + 3) // 4 if len(b) <= 32 else 8 + len(b).bit_length(), []).append(i)
        for members in buckets.values():
            for k in range(0, len(members), 20_000):
                part = members[k : k + 20_000]
                for i, ids in zip(part, merge_matrix(self.vocab, [raw[i] for i in part])):
                    found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, *found])
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if len(self.code) > KNOWN:
            self._forget()
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.code]
        if fresh:
            self.code.update(zip(fresh, range(len(self.code), len(self.code) + len(fresh))))
            self._learn(fresh)
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[codes]
        shift = np.repeat(self.starts[codes] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))], sizes

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; short texts share a slice, a long one is taken in slices."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if held:
                ids, sizes = self.pieces(held)
                ends, at, k = np.cumsum(sizes), 0, 0
                for owner, n in owners:
                    k += n
                    end = int(ends[k - 1]) if k else 0
                    out[owner].append(ids[at:end])
                    at = end
                held.clear()
                owners.clear()

        limit = SLICE // 4
        for i, text in enumerate(texts):
            if len(text) <= SLICE:
                found = self.pattern.findall(text)
                held += found
                if found:
                    owners.append((i, len(found)))
            else:
                part: list[str] = []
                for m in self.pattern.finditer(text):
                    part.append(m.group())
                    if len(part) >= limit:
                        held += part
                        owners.append((i, len(part)))
                        flush()
                        part = []
                if part:
                    held += part
                    owners.append((i, len(part)))
            if len(held) >= limit:
                flush()
        flush()
        return [np.concatenate(p) if len(p) > 1 else p[0] if p else np.empty(0, np.int32) for p in out]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of ids, gathered from the vocabulary in slices."""
    parts = []
    for k in range(0, len(ids), SLICE):
        part = ids[k : k + SLICE]
        sizes = vocab.lengths[part]
        shift = np.repeat(vocab.starts[part] - (np.cumsum(sizes) - sizes), sizes)
        parts.append(vocab.bytes[shift + np.arange(len(shift))].tobytes())
    return b"".join(parts)


def _list_array(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _extended(df: DataFrame, drop: list[str], add: list[StructField], work) -> DataFrame:
    """``df`` less some columns and with new ones that ``work`` makes of each Arrow batch."""
    names = {f.name.lower() for f in add}
    base = df.drop(*[c for c in df.columns if c.lower() in names and c not in drop])
    kept = [f for f in base.schema.fields if f.name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in sliced(batches):
            columns = [batch.column(f.name) for f in kept] + step(batch)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [f.name for f in add])

    return base.mapInArrow(run, StructType(kept + add))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with the ids of every text."""

    def work():
        encoder = Encoder(path, pattern)
        return lambda b: [_list_array(encoder.texts([t or "" for t in b.column(text).to_pylist()]))]

    field = StructField(out, ArrayType(IntegerType(), False), False)
    return _extended(df, [] if keep else [text], [field], work)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of every id list; a null list decodes to zero bytes."""

    def work():
        vocab = vocabulary(path)

        def step(batch):
            rows = batch.column(ids)
            return [pa.array([decode_ids(vocab, np.asarray(r.values) if r.is_valid else np.empty(0, int)) for r in rows], pa.binary())]

        return step

    return _extended(df, [], [StructField(out, BinaryType(), False)], work)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``ids`` and what they decode to, in one pass through Python."""

    def work():
        encoder = Encoder(path, pattern)

        def step(batch):
            ids = encoder.texts([t or "" for t in batch.column(text).to_pylist()])
            decoded = pa.array([decode_ids(encoder.vocab, x) for x in ids], pa.binary())
            return [_list_array(ids), decoded]

        return step

    fields = [StructField("ids", ArrayType(IntegerType(), False), False), StructField("decoded", BinaryType(), False)]
    return _extended(df, [text], fields, work)
