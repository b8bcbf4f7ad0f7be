"""SimHash near-duplicates: 64-bit fingerprints and tiled exact comparison.

Fingerprints are dealt into tiles by the population counts of their four 16-bit parts.  Two
fingerprints differ in at least as many bits as those counts differ in sum, so pairs of tiles
whose counts are further apart than the radius are skipped; all others are compared in full
with exclusive-or and bit counts.  The comparison is exact: no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, slices, stored
from .components import components

#: Rows of a block; a unit of work compares two blocks.  Larger tiles are split into more blocks.
BLOCK = 2048
#: Hashes whose bits are counted at a time.
STEP = 1 << 15
PLACE = np.array([17**3, 17**2, 17, 1])
TILES = 17**4


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit k is set if it is set in over half of the XXH64 hashes of the word shingles."""
    words = text.lower().split()  # bytes: A-Z and U+0020, U+0009 to U+000D only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        hashes = [h(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)))]
    v, count = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for k in range(0, len(v), STEP):
        part = v[k : k + STEP]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(v), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            view, offsets = raw_bytes(b.column("text"))
            fps = [fingerprint(view[a:z].tobytes(), shingle, seed) for a, z in itertools.pairwise(offsets.tolist())]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, fp long")


def tiles_of(fps: np.ndarray) -> np.ndarray:
    """Four population counts (0 to 16) as one number."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int64) @ PLACE


def _lower(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts within the radius, one of each opposite pair."""
    r = range(-radius, radius + 1)
    return [d for d in itertools.product(r, repeat=4) if 0 < sum(map(abs, d)) <= radius and d < (0, 0, 0, 0)]


class Layout:
    """How tiles are cut into units, from the size of each tile (at most 17^4 numbers)."""

    def __init__(self, sizes: np.ndarray, radius: int, block: int):
        self.radius, self.block, self.home = radius, block, -(-sizes // block)
        digits = np.arange(TILES)[:, None] // PLACE % 17
        guests = np.zeros(TILES, np.int64)
        for d in _lower(radius):
            to = digits + np.array(d)
            ok = ((to >= 0) & (to <= 16)).all(1)
            np.add.at(guests, (to[ok] @ PLACE), sizes[ok])
        self.guest = np.where(sizes > 0, -(-guests // block), 0)
        self.sizes = sizes

    def units(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, role, fingerprint) of all units that fingerprints take part in: unit (t, i, j)
        compares block i of tile t with block j, of the same tile or of its guests."""
        tile = tiles_of(fps)
        mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def send(rows: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, role: int) -> None:
            if len(rows):
                out.append((t << 44 | i << 22 | j, np.full(len(rows), role, np.int8), fps[rows]))

        home, guest = self.home[tile], self.guest[tile]
        own = (mixed % home.astype(np.uint64)).astype(np.int64)
        every = np.arange(len(fps))
        rows = every[(home > 1) | (self.sizes[tile] > 1)]
        rep = np.repeat(rows, home[rows])
        j = np.arange(len(rep)) - np.repeat(np.cumsum(home[rows]) - home[rows], home[rows])
        send(rep, tile[rep], np.minimum(own[rep], j), np.maximum(own[rep], j), 0)
        if len(rep):  # the later block of a unit is its second side
            out[-1] = (out[-1][0], (j < own[rep]).astype(np.int8), out[-1][2])
        rep = np.repeat(every, guest)
        j = np.arange(len(rep)) - np.repeat(np.cumsum(guest) - guest, guest)
        send(rep, tile[rep], own[rep], home[rep] + j, 0)
        digits = tile[:, None] // PLACE % 17
        for d in _lower(self.radius):
            to = digits + np.array(d)
            ok = ((to >= 0) & (to <= 16)).all(1)
            t = np.where(ok, to @ PLACE, 0)
            rows = every[ok & (self.home[t] > 0)]
            n = self.home[t[rows]]
            rep, i = np.repeat(rows, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            block = (mixed[rep] % self.guest[t[rep]].astype(np.uint64)).astype(np.int64) if len(rep) else rep
            send(rep, t[rep], i, self.home[t[rep]] + block, 1)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int8), fps[:0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks (or inside one) as a forest: each linked fingerprint with another
    of its part, fewer than there are rows, whatever the number of close pairs."""
    nodes = a if b is None else np.concatenate([a, b])
    right = a if b is None else b
    label = np.arange(len(nodes))
    for k in range(0, len(a), 256):
        x, y = np.nonzero(np.bitwise_count(a[k : k + 256, None] ^ right[None, :]) <= radius)
        x, y = x + k, y + (0 if b is None else len(a))
        if b is None:
            x, y = x[x < y], y[x < y]
        while len(x):
            lx, ly = label[x], label[y]
            low = np.minimum(lx, ly)
            if (lx == ly).all():
                break
            np.minimum.at(label, lx, low)
            np.minimum.at(label, ly, low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def link_table(fps: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """``u, v``: links of distinct fingerprints (column ``fp``) that connect exactly what all pairs
    within ``radius`` bits connect."""
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("long") * int(PLACE[k]) for k in range(4)]
    counts = fps.groupBy((part[0] + part[1] + part[2] + part[3]).alias("t")).agg(F.count("*").alias("n")).collect()  # at most 17^4 rows
    sizes = np.zeros(TILES, np.int64)
    for t, n in counts:
        sizes[t] = n
    layout = fps.sparkSession.sparkContext.broadcast((sizes, radius, block))  # 17^4 numbers

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Layout(*layout.value)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                unit, role, fp = plan.units(b.column(0).slice(k, 4096).to_numpy().view(np.uint64))
                yield pa.record_batch([pa.array(unit), pa.array(role), pa.array(fp.view(np.int64))], ["unit", "role", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            keep: tuple | None = None  # the last unit of a batch may go on in the next
            for b in batches:
                cols = tuple(b.column(k).to_numpy() for k in range(3))
                if keep is not None:
                    cols = tuple(np.concatenate(x) for x in zip(keep, cols, strict=True))
                if not len(cols[0]):
                    continue
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                keep = tuple(c[cut:] for c in cols)
                if cut:
                    yield tuple(c[:cut] for c in cols)  # type: ignore[misc]
            if keep is not None:
                yield keep  # type: ignore[misc]

        for unit, role, fp in rows():
            us, vs = [], []
            edges = np.flatnonzero(np.diff(unit)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(unit)], strict=True):
                i, j = int(unit[s]) >> 22 & 0x3FFFFF, int(unit[s]) & 0x3FFFFF
                own, r = fp[s:e].view(np.uint64), role[s:e]
                u, v = links(own, None, radius) if i == j else links(own[r == 0], own[r == 1], radius)
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    units = fps.select("fp").mapInArrow(deal, "unit long, role byte, fp long")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``: the
    smallest id among all rows whose fingerprints can be reached by links of at most ``radius``
    differing bits.

    Defined cases: a text without words (null, empty, white space) has fingerprint zero and is
    linked like any other; null ids come after all numbers, so a component is null only if all
    its ids are; repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored.

    Copies share a fingerprint and are never expanded to pairs; a hot fingerprint is one row in
    the comparison and a hot tile is cut into blocks.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(link_table(distinct, radius, block)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named")
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# wide fingerprints

#: 64-bit words of a wide fingerprint.
WORDS = 8
#: Words of it that sift pairs before the others are read.
FIRST = 2
#: Rows of a block of wide fingerprints (1 MB), and bytes of the shingle sets of a block's rows.  A
#: row is sent to each block of the tiles near its own, so larger blocks mean less shuffling.
WIDE_BLOCK, SET_BYTES = 16_384, 64 << 20
#: Sizes of sets whose similarity reaches 0.765 lie within two of these steps.
SIZE_STEP = 0.134
#: Sets compared with one set at a time.
TRIES = 256


def reach(bits: int, p: float, miss: float = 1e-9) -> int:
    """The number of differing bits that is exceeded with a likelihood under ``miss``, if each of
    ``bits`` differs with likelihood ``p``."""
    terms = [math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(bits + 1)]
    tail, k = 0.0, bits
    while tail + terms[k] < miss:
        tail, k = tail + terms[k], k - 1
    return k


#: The likelihood that a bit differs between sets of similarity 0.8 or more, at most: by the
#: binomial sums of all sizes up to 200; towards arccos(0.889) / pi = 0.151 beyond.  The largest is
#: that of 4 shingles in a set of 5.
FEW, APART_FEW, APART = 5, 0.1875, 0.1612
RADII = {few: (reach(64 * FIRST, p), reach(64 * WORDS, p)) for few, p in ((True, APART_FEW), (False, APART))}


def size_tile(size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, 1 + np.floor(np.log(np.maximum(size, 1)) / SIZE_STEP), 0).astype(np.int64)


#: The last tile whose pairs may have a set of fewer than FEW shingles.
FEW_TILE = int(size_tile(np.array([FEW]))[0])


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        seen = {h(b" ".join(words), 42)}
    else:
        seen = {h(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(shingle)))}
    return np.array(sorted(seen), np.uint64)


def wide_fingerprint(v: np.ndarray) -> bytes:
    """512 bits over a set of shingles."""
    if not len(v):
        return b"\0" * 8 * WORDS
    out = []
    for w in range(WORDS):
        x = (v + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        count = np.zeros(64, np.int64)
        for k in range(0, len(x), STEP):
            count += np.unpackbits(x[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(count * 2 > len(x), bitorder="little"))
    return np.concatenate(out).tobytes()


def wide_pairs(a: np.ndarray, b: np.ndarray | None, few: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(x, y)`` of all pairs of rows of a and b (or inside a) that may have a similarity of
    0.8, by ascending x; rows of b count after those of a."""
    right, shift = (a, 0) if b is None else (b, len(a))
    sift, radius = RADII[few]
    ones = [np.bitwise_count(m).sum(1, dtype=np.int64) for m in (a, right)]
    for k in range(0, len(a), 256):
        part = ones[0][k : k + 256]
        if part.min() - ones[1].max() > radius or ones[1].min() - part.max() > radius:
            continue
        apart = np.bitwise_count(a[k : k + 256, :1] ^ right[None, :, 0])
        for w in range(1, FIRST):
            apart += np.bitwise_count(a[k : k + 256, w : w + 1] ^ right[None, :, w])
        x, y = np.nonzero(apart <= sift)
        x = x + k
        if b is None:
            x, y = x[x < y], y[x < y]
        near = [np.bitwise_count(a[x[s : s + 65536]] ^ right[y[s : s + 65536]]).sum(1, dtype=np.int64) <= radius for s in range(0, len(x), 65536)]
        if near:
            near = np.concatenate(near)
            yield x[near], y[near] + shift


def alike(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of some sets have a Jaccard similarity of 0.8 or more with a set; none is empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 9 * both >= 4 * (len(own) + sizes)  # both / (sum - both) >= 4 / 5


def wide_links(a: np.ndarray, b: np.ndarray | None, sets: list[np.ndarray], few: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(x, y)`` of a forest over the rows of a (and of b, after those of a) that connects
    what the pairs of similarity 0.8 or more connect.  A pair that is connected already is not
    compared again, so a large group of copies costs a comparison for each row."""
    label = np.arange(len(sets))
    for x, y in wide_pairs(a, b, few):
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            continue
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            row = int(x[s])
            for t in range(s, e, TRIES):
                at = y[t : min(t + TRIES, e)]
                at = at[label[at] != label[row]]
                if len(at) and len(good := at[alike(sets[row], [sets[k] for k in at.tolist()])]):
                    old = np.unique(label[np.append(good, row)])
                    label[np.isin(label, old)] = old[0]
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return moved, label[moved]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, block: int = WIDE_BLOCK) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of the smallest id stays.

    Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
    0.8 or more; groups are what such links connect.  512-bit SimHashes name the pairs that may be
    (all but one in 10^9 of those that are), and each is decided by its sets.  Tiles are steps of
    set size, since similar sets have similar sizes; blocks are compared in full.  Sets are made
    again for the texts that some pair names, and go to the units of such pairs alone.

    Defined cases: texts without words form one group; null ids come last; of rows that repeat
    id and text one stays; an empty table gives an empty result; columns stay as they are and
    may have any names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(77), text)
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            view, offsets = raw_bytes(b.column("text"))
            sets = [shingle_set(view[a:z].tobytes(), shingle) for a, z in itertools.pairwise(offsets.tolist())]
            tile = size_tile(np.array([len(v) for v in sets], np.int64))
            same = [xxhash.xxh3_128_digest(v.tobytes()) for v in sets]
            yield pa.record_batch([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array([wide_fingerprint(v) for v in sets], pa.binary()), pa.array(same, pa.binary()), pa.array(tile)], ["doc_id", "k1", "k2", "fp", "same", "tile"])

    signed = stored(plain.mapInArrow(sign, f"doc_id {kind}, k1 long, k2 long, fp binary, same binary, tile long"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k1"), F.col("k2")))
    distinct = signed.groupBy("fp", "same", "tile").agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id())
    distinct = stored(distinct, "distinct")
    counts = {r["tile"]: r["n"] for r in distinct.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # a few hundred rows
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = shared.value
        own = {t: min(block, max(TRIES, int(SET_BYTES / 8 / np.exp(t * SIZE_STEP)))) for t in sizes}
        home = {t: -(-n // own[t]) for t, n in sizes.items()}
        guests = {t: -(-(sizes.get(t - 1, 0) + sizes.get(t - 2, 0)) // own[t]) for t in sizes}
        names = ["unit", "role", "node", "fp"]
        for b in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for node, tile, fp in zip(*(b.column(c).to_pylist() for c in ("node", "tile", "fp")), strict=True):
                mixed = node * 0x9E3779B1 >> 7
                i = mixed % home[tile]
                for j in range(home[tile]):
                    out.append((tile << 44 | min(i, j) << 22 | max(i, j), int(j < i), node, fp))
                for g in range(guests[tile]):
                    out.append((tile << 44 | i << 22 | (home[tile] + g), 0, node, fp))
                for up in (tile + 1, tile + 2):
                    if up in home and tile:
                        g = mixed % guests[up]
                        out += [(up << 44 | k << 22 | (home[up] + g), 1, node, fp) for k in range(home[up])]
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int8(), pa.int64(), pa.binary()), strict=True)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int8(), pa.int64(), pa.binary()), strict=True)], names)

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """The rows of each unit, those of its first side before those of its second."""
        now, parts = None, []
        for b in batches:
            unit = b.column("unit").to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)], strict=True):
                if s == e:
                    continue
                if now is not None and unit[s] != now:
                    yield now, pa.Table.from_batches(parts).sort_by("role")
                    parts = []
                now = int(unit[s])
                parts.append(b.slice(s, e - s))
        if now is not None:
            yield now, pa.Table.from_batches(parts).sort_by("role")

    def sides(unit: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray | None, bool]:
        """Both sides' fingerprints, and whether sets may be of few shingles."""
        f = np.frombuffer(b"".join(rows["fp"].to_pylist()), "<u8").reshape(-1, WORDS)
        cut = int((rows["role"].to_numpy() == 0).sum())
        few = unit >> 44 <= FEW_TILE
        return (f, None, few) if (unit >> 22 & 0x3FFFFF) == (unit & 0x3FFFFF) else (f[:cut], f[cut:], few)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in by_unit(batches):
            a, b, few = sides(unit, rows)
            named = np.zeros(rows.num_rows, bool)
            if len(a) and (b is None or len(b)):
                for x, y in wide_pairs(a, b, few):
                    named[x] = named[y] = True
            yield from rows.filter(pa.array(named)).to_batches()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            view, offsets = raw_bytes(b.column("text"))
            sets = [shingle_set(view[a:z].tobytes(), shingle).tobytes() for a, z in itertools.pairwise(offsets.tolist())]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in by_unit(batches):
            a, b, few = sides(unit, rows)
            n, sets = rows["node"].to_numpy(), [np.frombuffer(h, np.uint64) for h in rows["hashes"].to_pylist()]
            x, y = wide_links(a, b, sets, few)
            yield pa.record_batch([pa.array(n[x]), pa.array(n[y])], ["u", "v"])

    form = "unit long, role byte, node long, fp binary"
    units = distinct.select("node", "tile", "fp").mapInArrow(deal, form)
    named = stored(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(sift, form), "named")
    wanted = named.select("node").distinct().join(distinct.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.k1").alias("n1"), F.col("first.k2").alias("n2"))
    chosen = plain.join(wanted, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    sets = stored(chosen.mapInArrow(hashes, "node long, hashes binary").dropDuplicates(["node"]), "sets")
    edges = named.join(sets, "node").select("unit", "role", "node", "fp", "hashes").repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "u long, v long")
    roots = components(edges)
    rooted = distinct.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")), "kept")
    kept = kept.select(F.col("id").alias("\x01id"), F.col("k1").alias("\x01k1"), F.col("k2").alias("\x01k2"))
    again = stored(signed.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("\x01k1"), F.col("k2").alias("\x01k2"), F.lit(True).alias("\x01again")).distinct(), "again")
    kept = kept.join(again, ["\x01k1", "\x01k2"], "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(kept, (k1 == F.col("\x01k1")) & (k2 == F.col("\x01k2")) & F.col(id_col).eqNullSafe(F.col("\x01id")))
    once = joined.where(F.col("\x01again").isNull()).select(*names)
    return once.unionByName(joined.where("`\x01again`").dropDuplicates(["\x01k1", "\x01k2"]).select(*names))
