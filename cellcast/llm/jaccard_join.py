"""Exact Jaccard join of word n-gram sets, and the groups its links form.

Sets are sorted arrays of 64-bit hashes. Equal sets are one class and are compared once.

Tiles. A size band fixes how far two linked sets can differ: at threshold p per cent, sets of together S
shingles differ in at most D = S (100 - p) / (100 + p) of them. Hash space is cut into D + SPARE ranges, the same
for all sets of a band, so two linked sets hold exactly the same shingles in SPARE ranges or more. A tile is
(band, range, content). A set whose partners differ from it in d shingles at most agrees with them in all ranges but d, so it
names only d + 1 tiles, those that hold most shingles (ties by name): in this order the first tile that two linked sets share is
named by both. Tiles of one common shingle, which many unlike texts share, so mostly stay unnamed, and a long passage that many
documents quote is seldom enough to share one. A set near a band's lower edge takes part in the band below too. Tasks send tiles
packed, eight bytes a tile and set, each set once a task; only tiles with several sets are kept.

Groups. The members of all tiles with the same smallest member are one group: (low, set) is all that is kept of the tiles. Two linked
sets share a group, so it is enough to join what is linked inside each group, and components put the groups together.

Bounds. Bits in which two parity bitmaps differ are shingles that differ, so their count bounds the overlap from above; halves of a
bitmap folded onto each other are the bitmap of half the width, so sets of neighbouring bands compare too. A narrow one (some 3 D
bits) goes with each class to its groups, and only members that may have a partner there stay (``possible``).

Trees. The texts of these travel to their groups, where wide bitmaps (some 16 D bits) and then the exact intersection of the sorted arrays
decide. Pairs of members that are joined already are not looked at, so near copies cost as much as they are many. Everything
is settled in one pass; there are no rounds. No link between different texts is lost, and no group is ever expanded into all its pairs.

Hot groups: copies are one class; a class carries its smallest document, so components need no join on their name; the last
join is salted. A large group is cut into blocks of BLOCK members or ``BLOCK_SHINGLES`` shingles in expectation. Its smallest member is compared with
every block, and only members that are apart from it then meet the other blocks. Sets are not stored or sent: texts are read again, found by a filter of ``FILTER_BITS`` bits, which
is all that is broadcast. A full filter costs time, never a result.

Defined results: null or empty text has no shingles and is linked with nothing; fewer words than the shingle's
length make one shingle; repeated rows and equal ids each get a row; a component is named by its
smallest id, null if all are null; an empty table gives no rows; columns other than id and text are not read.
Two sets count as equal when two 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import sliced, written
from cellcast.llm.components import components

SHINGLE, PERCENT = 3, 90
#: Ratio of band edges, agreeing ranges guaranteed, fewest bits of a parity bitmap, members of a block.
BAND_RATIO, SPARE, BITS, BLOCK = 0.65, 3, 256, 2048
FILTER_BITS = 1 << 25
#: Tiles of one bucket (expected) and of one packed row, fewest buckets, classes a task remembers.
BUCKET_TILES, PACK_TILES, BUCKETS, SEEN = 1 << 21, 1 << 20, 32, 1 << 20
#: Shingles of a block, salts of the last join.
BLOCK_SHINGLES, SALTS = 1 << 21, 8

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and six blanks only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < k:
        h, k = np.concatenate([np.array([n], np.uint64), h]), n + 1
    out = h[: len(h) - k + 1]
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _A + h[j : len(h) - k + 1 + j] * _B
    out = np.sort(mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


class Bands:
    """Band edges and range cuts for a threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        self.cuts: dict[int, np.ndarray] = {}
        # Smaller sets are linked to equal ones only.
        self.edges = [next((n for n in range(1, 10_000) if n * 100 // percent > n), 10_000)]

    def edge(self, band: int) -> int:
        while len(self.edges) <= band:
            self.edges.append(int(self.edges[-1] / BAND_RATIO) + 1)
        return self.edges[band]

    def differ(self, n: int, partner: int) -> int:
        """Most shingles in which a set of n differs from a linked one of at most ``partner``."""
        return (n + min(n * 100 // self.percent, partner)) * (100 - self.percent) // (100 + self.percent)

    def most(self, band: int) -> int:
        """Most shingles in which linked sets that meet in a band differ."""
        largest = self.edge(band + 1) - 1
        return self.differ(largest, largest * 100 // self.percent)

    def ranges(self, band: int) -> int:
        return self.most(band) + SPARE

    def used(self, n: int, band: int) -> int:
        """Tiles of a set of n shingles that are named: one more than the ranges in which a linked set may differ."""
        # In the band below its own it meets only sets of that band.
        return self.differ(n, self.edge(band + 1) - 1 if n >= self.edge(band + 1) else n * 100 // self.percent) + 1

    def width(self, band: int) -> int:
        """Bits of the parity bitmap: a power of two of sixteen times what linked sets may differ in, or more."""
        return max(BITS, 1 << (16 * self.most(band) - 1).bit_length())

    def slim(self, band: int) -> int:
        """Bits of a first, narrow bitmap: at least three times what linked sets may differ in, so that unlike sets exceed it."""
        return max(BITS, 1 << (3 * self.most(band) - 1).bit_length())

    def bands(self, n: int) -> list[int]:
        """Bands in which a set of n shingles looks for partners."""
        if n < self.edge(0):
            return []
        band = 0
        while n >= self.edge(band + 1):
            band += 1
        below = band > 0 and -(-self.percent * n // 100) < self.edge(band)
        return [band, band - 1] if below else [band]

    def tiles(self, shingles: np.ndarray) -> np.ndarray:
        """Names of a set's tiles; the lowest six bits are the band."""
        out = []
        for band in self.bands(len(shingles)):
            m = self.ranges(band)
            if m not in self.cuts:
                self.cuts[m] = np.array([(i << 64) // m for i in range(m)], np.uint64)
            at = np.append(np.searchsorted(shingles, self.cuts[m]), len(shingles))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ _A))])
            content = sums[at[1:]] - sums[at[:-1]]
            names = mix(content ^ mix(np.arange(m, dtype=np.uint64) + (np.uint64(band) << np.uint64(40)) + _B))
            names = names & ~np.uint64(63) | np.uint64(band)
            # Linked sets agree in all but used - 1 ranges or more: they share one of those that hold most.
            order = np.lexsort((names, at[:-1] - at[1:]))
            out.append(names[order[: self.used(len(shingles), band)]])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity(shingles: np.ndarray, width: int) -> np.ndarray:
    """Which of ``width`` cells hold an odd number of shingles, as 64-bit words."""
    cells = (mix(shingles ^ _B) >> np.uint64(16)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(cells, minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap of fewer words from a wider one (last axis)."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def class_hash(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def scanned(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, set, tiles, slim) of every (doc_id, text, mark); ``set`` is null without shingles."""
    names = ["doc_id", "mark", "n", "set", "tiles", "slim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in sliced(batches):
            sizes, keys, tiles, slim = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle)
                at = bands.bands(len(s))
                sizes.append(len(s))
                keys.append(class_hash(s) if len(s) else None)
                tiles.append(sum(bands.used(len(s), b) for b in at))
                slim.append(parity(s, bands.slim(at[0])).tobytes() if at else None)
            columns = [pa.array(v, pa.int64()) for v in (sizes, keys, tiles)] + [pa.array(slim, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, n long, `set` long, tiles long, slim binary")


def shared_tiles(docs: DataFrame, buckets: int, shingle: int, percent: int) -> DataFrame:
    """(low, set) of the classes in every tile that holds several; ``low`` is its smallest class, which has a row too.

    Equal rows of different buckets stay. A bucket's tiles are one group: ``BUCKET_TILES`` in expectation, and at eight bytes each the members of its largest tile.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        seen: set[int] = set()
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint64), [len(h) for h in held])
            place = names >> np.uint64(6)
            bucket = (place % np.uint64(buckets)).astype(np.int64)
            rest = (place // np.uint64(buckets)) & np.uint64((1 << 38) - 1)
            packed = ((rest << np.uint64(6)) | (names & np.uint64(63))) << np.uint64(20) | owner
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts, known = np.split(packed[order], cuts), np.array(keys, np.int64)
            rows = []
            for part in parts:
                used, index = np.unique(part & np.uint64((1 << 20) - 1), return_inverse=True)
                rows.append(((part >> np.uint64(20) << np.uint64(20) | index.astype(np.uint64)).tobytes(), known[used.astype(np.int64)].tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][np.append(0, cuts)]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "packed", "classes"],
            )

        for batch in sliced(batches):
            for t in batch.column(0):
                s = shingle_set(t.as_py(), shingle)
                if not bands.bands(len(s)) or (key := class_hash(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                names = bands.tiles(s)
                keys.append(key)
                held.append(names)
                size += len(names)
                if size > PACK_TILES or len(held) == 1 << 20:
                    yield flush()
                    keys, held, size = [], [], 0
        if size:
            yield flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        tile, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for packed, classes in zip(table.column("packed"), table.column("classes")):
            part = np.frombuffer(packed.as_buffer(), np.uint64)
            tile.append(part >> np.uint64(20))
            owner.append(np.frombuffer(classes.as_buffer(), np.int64)[(part & np.uint64((1 << 20) - 1)).astype(np.int64)])
        names, sets = np.concatenate(tile), np.concatenate(owner)
        order = np.lexsort((sets, names))
        names, sets = names[order], sets[order]
        once = np.append(True, (names[1:] != names[:-1]) | (sets[1:] != sets[:-1]))[: len(names)]
        names, sets = names[once], sets[once]
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
        counts = np.diff(np.append(starts, len(names)))
        several = np.repeat(counts > 1, counts)
        low = np.repeat(sets[starts], counts)
        pairs = np.unique(np.stack([low[several], sets[several]], 1), axis=0)
        return pa.table({"low": pairs[:, 0], "set": pairs[:, 1]})

    rows = docs.select("text").mapInArrow(pack, "bucket long, packed binary, classes binary")
    return rows.groupBy("bucket").applyInArrow(meet, "low long, `set` long")


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return False
    at = np.searchsorted(right, left)
    common = int((right[np.minimum(at, len(right) - 1)] == left).sum())
    return 100 * common >= percent * (len(left) + len(right) - common)


class Bounds:
    """Parity bitmaps of some sets, to bound from below in how many shingles two of them differ."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray], percent: int):
        self.n, self.percent = n, percent
        self.words = np.array([len(b) for b in bits])
        # A pair is compared in the width of the narrower bitmap.
        self.level = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words >= w)
            place = np.full(len(n), -1)
            place[at] = np.arange(len(at))
            self.level[w] = place, np.stack([folded(bits[k], w) for k in at])

    def near(self, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``y`` that may be linked with ``x``, and the least in which they differ."""
        room = (self.n[y] + self.n[x]) * (100 - self.percent)
        inside = np.abs(self.n[y] - self.n[x]) * (100 + self.percent) <= room
        y, room = y[inside], room[inside]
        fewest = np.abs(self.n[y] - self.n[x])
        width = np.minimum(self.words[y], self.words[x])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            place, bits = self.level[w]
            fewest[at] = np.maximum(fewest[at], np.bitwise_count(bits[place[y[at]]] ^ bits[place[x]]).sum(1, dtype=np.int64))
        fits = fewest * (100 + self.percent) <= room
        return y[fits], fewest[fits]


def _units(batches: Iterator[pa.RecordBatch], keys: list[str], shingle: int = 0) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal keys; a text becomes its shingle set at once."""
    unit, held = None, []
    for batch in sliced(batches, 64 if shingle else 512):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != unit and held:
                yield unit, held
                held = []
            unit = key
            if shingle:
                row["text"] = shingle_set(row["text"], shingle)
            held.append(row)
    if held:
        yield unit, held


def blocked(members: DataFrame, weight: Column) -> DataFrame:
    """``members`` with the blocks of their group and their own; a block has BLOCK members or a weight of 1 in expectation."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(weight))).alias("blocks")
    large = members.groupBy("low").agg(blocks).filter("blocks > 1")
    own = F.pmod(F.xxhash64("set"), "blocks").alias("own")
    return members.join(large, "low", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("*", own)


def possible(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (low, set) of ``members`` that may be linked with another of their group, by sizes and narrow bitmaps.

    The smallest member of a group stays with the others.
    """
    known = members.join(classes.select("set", "n", "slim"), "set")
    dealt = blocked(known, F.lit(0)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = ["low", "i", "j"]
    rows = dealt.select("low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "slim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (low, i, j), held in _units(batches, unit):
            bounds = Bounds(np.array([r["n"] for r in held]), [np.frombuffer(r["slim"], np.uint64) for r in held], percent)
            side, met = np.array([r["own"] for r in held]), np.zeros(len(held), bool)
            for x in range(len(held) - 1):
                # Once x is known to have a partner, only those without one are of interest.
                ask = ~met[x + 1 :] if met[x] else np.ones(len(held) - x - 1, bool)
                if i != j:
                    ask &= side[x + 1 :] != side[x]
                y = np.flatnonzero(ask) + x + 1
                if len(y) and len(y := bounds.near(x, y)[0]):
                    met[x] = met[y] = True
            if met.any():
                sets = np.append(np.array([r["set"] for r in held])[met], low)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), low)), pa.array(sets)], names=["low", "set"])

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "low long, `set` long").distinct()


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the text of the document of each ``mark``."""
    cell = F.pmod("mark", F.lit(FILTER_BITS))
    words = wanted.groupBy(F.shiftright(cell, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(63).cast("int"))).alias("bits")
    )
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    marks = np.zeros(FILTER_BITS // 64, np.int64)
    marks[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    packed = marks.view(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            inside = held[batch.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS]
            yield batch.filter(pa.array(inside))

    near = docs.select("mark", "text").mapInArrow(run, "mark long, text string")
    return wanted.join(near.dropDuplicates(["mark"]), "mark")


UNIT = ["low", "i", "j"]


def trees(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(low, i, a, b): links that join what is linked in every unit into trees; ``b`` is null for a member left apart.

    ``rows`` holds (low, i, j, set, text, kind) of a unit. Kind 0 is compared with all, kind 1 with kind 0 only. Members of kind 1 or 2
    are known to be one component, kind 2 is that of the group's smallest member, which in a block (j = -1) is ``low`` itself.
    """
    dealt = rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "kind", "set")

    def compare(unit: tuple, held: list[dict]) -> list[tuple]:
        low, block, other = unit
        bands = Bands(percent)
        names = [r["set"] for r in held]
        sets = [r["text"] for r in held]
        kind = np.array([r["kind"] for r in held])
        bounds = Bounds(np.array([len(s) for s in sets]), [parity(s, bands.width(bands.bands(len(s))[0])) for s in sets], percent)
        label = np.where(kind == 2, -1, np.arange(len(held)))
        out = []
        # The smallest member comes first: near copies mostly are linked with it.
        order = [names.index(low), *[x for x in range(len(held)) if names[x] != low]] if other < 0 else np.flatnonzero(kind == 0).tolist()
        done = np.zeros(len(held), bool)
        for x in order:
            done[x] = True
            y, fewest = bounds.near(x, np.flatnonzero((label != label[x]) & ~done))
            for z in y[np.argsort(fewest, kind="stable")].tolist():
                if label[z] != label[x] and _linked(sets[x], sets[z], percent):
                    out.append((low, block, names[x], names[z]))
                    label[label == label[z]] = label[x]
        if other < 0:
            out += [(low, block, names[x], None) for x in np.flatnonzero(label != label[order[0]]).tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, held in _units(batches, UNIT, shingle):
            if found := compare(unit, held):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["low", "i", "a", "b"])

    return dealt.mapInArrow(run, "low long, i long, a long, b long")


def linked(docs: DataFrame, classes: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links enough to join all linked classes of every group of ``members`` (low, set)."""
    named_ = members.join(classes.select("set", "n", F.col("first.mark").alias("mark")), "set")
    dealt = written(blocked(named_, F.col("n") / BLOCK_SHINGLES).drop("n"), "blocks")
    # The smallest member is compared with every block.
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    lows = dealt.filter("set = low AND blocks > 1").withColumn("at", at).filter("at <> own").drop("own").withColumnRenamed("at", "own")
    first = dealt.unionByName(lows).select("mark", "low", F.col("own").alias("i"), F.lit(-1).cast("long").alias("j"), "set", F.lit(0).alias("kind"))
    found = written(trees(with_texts(docs, first), shingle, percent), "pairs")
    links = found.filter("b IS NOT NULL").select("a", "b")
    large = dealt.filter("blocks > 1")
    apart = found.filter("b IS NULL").select("low", F.col("a").alias("set")).join(large, ["low", "set"])
    if apart.isEmpty():
        return links
    # What a block leaves apart is compared with all other blocks.
    asking = apart.withColumn("j", at).filter("j <> own").select("mark", "low", F.col("own").alias("i"), "j", "set", F.lit(0).alias("kind"))
    alone = apart.select("low", "set", F.lit(1).alias("kind"))
    asked = large.join(apart.select("low", F.col("own").alias("i")).distinct(), "low").filter("own <> i").join(alone, ["low", "set"], "left")
    asked = asked.select("mark", "low", "i", F.col("own").alias("j"), "set", F.coalesce("kind", F.lit(2)).alias("kind"))
    more = written(trees(with_texts(docs, asking.unionByName(asked)), shingle, percent), "pairs")
    return links.unionByName(more.select("a", "b"))


def named(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, component) of linked classes; both are structs that begin with the class's first document."""
    side = lambda x: classes.select(F.col("set").alias(x), F.struct("first.*", "set").alias(f"{x}_node"))
    nodes = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    found = components(nodes)
    return written(found.select(F.col("node.set").alias("set"), "component"), "groups")


def grouped(df: DataFrame, doc: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The scan (doc_id, mark, n, set, ...) of every row, and (set, first, copies, component) of every class.

    ``mark`` is a hash of id and text, ``first`` a class's first document (unnamed, doc_id, mark); ``component`` is the smallest
    (unnamed, doc_id, mark, set) of the classes linked with it, null for a class without links.
    """
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    scan = written(scanned(docs, shingle, percent), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    known = scan.filter("set IS NOT NULL").groupBy("set").agg(F.max("n").alias("n"), F.max("slim").alias("slim"), first, F.count("*").alias("copies"))
    classes = written(known, "classes")
    total = scan.agg(F.sum("tiles")).first()[0] or 0
    members = written(shared_tiles(docs, max(BUCKETS, total // BUCKET_TILES), shingle, percent), "tiles").distinct()
    near = written(possible(members, classes, percent), "near")
    groups = named(linked(docs, classes, near, shingle, percent), classes)
    return scan, classes.select("set", "first", "copies").join(groups, "set", "left")


def join(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id."""
    scan, classes = grouped(df, doc, text, shingle, percent)
    least = F.coalesce("component.doc_id", "first.doc_id").alias("least")
    # Only classes with copies or links need a look-up; copies of one are spread over salts.
    shared = classes.filter("copies > 1 OR component IS NOT NULL").select(
        "set", least, F.lit(True).alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    rows = scan.select("doc_id", "n", "set", F.pmod("mark", F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(shared, ["set", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("shared"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows of ``df`` less all but one of each group: the smallest id stays, null ids last.

    Rows of equal id and text are one document and one of them stays. Rows without shingles all stay.
    """
    _, classes = grouped(df, doc, text, shingle, percent)
    first = classes.filter("component IS NULL OR component.set = set").select(F.col("first.mark").alias("__mark"))
    keyed = df.withColumn("__mark", F.xxhash64(F.col(doc).cast("long"), F.col(text).cast("string")))
    # Only white space makes a text without shingles.
    blank = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # One key serves the join and the repeated rows: texts are shuffled once.
    kept = keyed.filter(~blank).join(first, "__mark", "left_semi").dropDuplicates(["__mark"])
    return kept.unionByName(keyed.filter(blank)).select(*df.columns)
