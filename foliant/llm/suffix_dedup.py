"""Removal of repeated byte strings with suffix arrays.

Every byte that is covered by a string of ``window`` bytes which also starts anywhere else is
removed.  Exact and distributed:

1. *Anchors.*  In each window of a text the ``gram``-byte string of smallest hash is its anchor
   (leftmost of equals).  Equal windows have equal anchors at equal places, so a window can only
   be repeated if its anchor's hash occurs in two places.  Consecutive windows share anchors:
   a run of windows is one small record.
2. *Candidates.*  Records whose hash occurs once are settled.  The others get their bytes from
   the text and are dealt to shards by hash; an anchor with very many records is dealt to
   several shards.
3. *Shards.*  Windows whose own hash occurs once in the shard are settled.  Of the stretches that
   are left the shard builds the suffix array by Larsson-Sadakane refinement: suffixes are sorted
   by 8 bytes, then groups of equals only by the ranks 8, 16, ... bytes on.  Kasai's scan, run
   over all stretches side by side, gives the common prefixes of those that are still tied; a
   window is repeated if a neighbour shares ``window`` bytes.
4. *Merging.*  For anchors that several shards hold, the shards' sorted window digests are cut
   into ranges and merged by binary search; windows found in two shards are repeated as well.
5. Texts are cut by the union of all repeated windows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, slices, stored

WINDOW, GRAM = 400, 100
#: Records of a shard; about 550 bytes each.
SHARD = 4000
#: Ranges of digests for each shard of an anchor that has several; a range is one merge.
RANGES = 64
#: Bytes of text whose anchors are found at a time.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
PLACE = np.uint64((1 << 24) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1, BASE), _powers(n + 1, pow(BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n, done = len(a) - width + 1, 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[:n], a[width - done : width - done + n])


def anchor_runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, anchor, first, last)``: for each run of windows with one anchor, the places of
    its first and last window."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return np.zeros(0, np.uint64), none, none, none
    h = gram_hashes(data, gram)
    parts, step = [], 1 << 20
    for at in range(0, len(data) - window + 1, step):  # places inside a step fit below the hash
        own = h[at : at + step + window - gram]
        key = (own & ~PLACE) | np.arange(len(own), dtype=np.uint64)
        parts.append((sliding_min(key, window - gram + 1) & PLACE).astype(np.int64) + at)
    anchor = np.concatenate(parts)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    return h[anchor[first]], anchor[first], first, last


# suffix arrays


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def suffix_array(data: np.ndarray, depth: int, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their next ``depth`` bytes, and the rank of each place: equal for equals.

    Larsson-Sadakane: after sorting by h bytes, only groups of equals are sorted again, by the
    ranks h places on.  ``usable`` marks places that are wanted in the result: a place that lies
    d after the last of them is ranked by ``depth - d`` bytes at most, as they ask no more of it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _words(data)
    if depth < 8:
        words &= np.uint64((1 << 64) - (1 << 64 - 8 * depth))
    order = np.argsort(words, kind="stable")
    words = words[order]
    fresh = np.concatenate([[True], words[1:] != words[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    after = np.zeros(n, np.int64) if usable is None else np.arange(n) - np.maximum.accumulate(np.where(usable, np.arange(n), -n - depth))
    live = np.arange(n)  # places in the order that may have to be sorted again
    h = 8
    while h < depth:
        step = min(h, depth - h)
        rows = order[live]
        live = live[after[rows] <= depth - h - step]
        own = rank[order[live]]
        same = own[1:] == own[:-1]
        live = live[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(live) else live
        if not len(live):
            break
        rows = order[live]
        key = rank[rows] << 32 | (rank[np.minimum(rows + step, n)] + 1)
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[live] = rows[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[live]] = np.maximum.accumulate(np.where(new, live, 0))
        h += step
    if usable is not None:
        order = order[usable[order]]
    return order, rank[:n]


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, limit: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each sorted place with the one before it, ``limit`` at most; if ranks are
    given, zero where they differ.

    Kasai's scan in text order: where the neighbour moves on with the place, the common prefix
    is the previous one less one and need not be read again.  (Sorting stops at ``limit`` bytes,
    so the neighbour may be another one; then it is read from the start.)  The scan runs over
    all lanes (places ``starts[k]`` to ``starts[k] + counts[k] - 1``) at once, and compares 8
    bytes at a time.
    """
    n = len(order)
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1] if rank is None else np.where(rank[order[1:]] == rank[order[:-1]], order[:-1], -1)
    words = np.concatenate([_words(data), np.zeros(limit + 8, np.uint64)])
    out = np.zeros(len(data), np.int64)
    common, neighbour = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    longest = np.argsort(-counts, kind="stable")
    starts, counts = starts[longest], counts[longest]
    for t in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -t, side="left"))  # lanes with more than t places come first
        i = starts[:live] + t
        j = before[i]
        c = np.where(j == neighbour[:live] + 1, np.maximum(common[:live] - 1, 0), 0)
        todo = np.flatnonzero((j >= 0) & (c < limit))
        while len(todo):
            x = words[i[todo] + c[todo]] ^ words[j[todo] + c[todo]]
            end = np.flatnonzero(x)
            c[todo] += 8
            more = c[todo] < limit
            if len(end):
                c[todo[end]] -= 8 - ((64 - _bits(x[end])) >> 3)
                more[end] = False
            todo = todo[more]
        c = np.minimum(c, limit)
        common[:live], neighbour[:live] = c, np.where(j < 0, -2, j)
        out[i] = c
    return out[order] if n else np.zeros(0, np.int64)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int64)


def repeated(contexts: list[bytes], window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each distinct context, which of its windows occur elsewhere among them (or twice in
    it); contexts are at least a window long.

    Equal windows have equal hashes, so only the stretches whose windows' hashes occur twice go
    into the suffix array, which decides.
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(lengths) - lengths
    counts = lengths - window + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    flag = np.zeros(len(data), bool)
    places = _spread(starts, counts)
    h = gram_hashes(data, window)[places]
    in_order = np.sort(h)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if len(twice):
        spot = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        flag[places[twice[spot] == h]] = True
        runs = _runs(flag)
        n = runs[:, 1] - runs[:, 0] + 1
        source = _spread(runs[:, 0], n + window - 1)
        flag[:] = False
        flag[source[_tied(data[source], np.cumsum(n + window - 1) - n - window + 1, n, window)]] = True
    return [flag[s : s + c] for s, c in zip(starts.tolist(), counts.tolist(), strict=True)], starts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[k]`` to ``starts[k] + counts[k] - 1`` for each k, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _tied(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Of the lanes' places, those whose window is also that of another one."""
    usable = np.zeros(len(data), bool)
    usable[_spread(starts, counts)] = True
    order, rank = suffix_array(data, window, usable)
    # a place that the sort has told from all others needs no common prefix: lanes are runs of the rest
    own = rank[order]
    same = own[1:] == own[:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    tied = np.zeros(len(data), bool)
    tied[order] = True
    lanes = _runs(tied)
    lcp = kasai(data, order, lanes[:, 0], lanes[:, 1] - lanes[:, 0] + 1, window, rank)
    twin = lcp >= window
    twin[:-1] |= lcp[1:] >= window
    return order[twin]


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


def _lane_runs(flags: list[np.ndarray], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(lane, first, last)`` of each run of true values in each lane; lanes that are ``whole``
    are one run.  None is empty."""
    sizes = np.array([len(f) for f in flags], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(flags) | np.repeat(whole, sizes)
    begin, end = flat.copy(), flat.copy()
    begin[1:] &= ~flat[:-1]
    end[:-1] &= ~flat[1:]
    begin[starts], end[starts + sizes - 1] = flat[starts], flat[starts + sizes - 1]
    first = np.flatnonzero(begin)
    lane = np.searchsorted(starts, first, side="right") - 1
    return lane, first - starts[lane], np.flatnonzero(end) - starts[lane]


def digests(context: bytes, window: int) -> np.ndarray:
    """128 bits for each window of a context."""
    return np.array([xxhash.xxh3_128_digest(context[k : k + window]) for k in range(len(context) - window + 1)], "S16")


# Spark


def _key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(77), text)


def _fields(column: pa.ListArray, names: str | list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists, and the structs' whole numbers by name."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy()), [flat.field(c).to_numpy() for c in names]


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Rows of sorted batches, all of one value of the column at a time."""
    kept: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        keys = b.column(column).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(keys):
            end = at + int(np.searchsorted(keys[at:], keys[at], side="right"))
            if kept and keys[at] != value:
                yield pa.Table.from_batches(kept)
                kept = []
            value = keys[at]
            kept.append(b.slice(at, end - at))
            at = end
    if kept:
        yield pa.Table.from_batches(kept)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, spans, texts)``: a row for each input row ``doc_id, k1, k2, n_bytes, sha, copies``
    (``k1, k2`` stand for the text); for texts that occur once the repeated spans ``k1, k2,
    spans``; and the texts of candidates ``k1, k2, text``."""
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = _key(text)
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            view, offsets = raw_bytes(b.column("text"))
            raw = [view[a:z].tobytes() for a, z in itertools.pairwise(offsets.tolist())]
            runs = []
            for x in raw:
                h, anchor, first, last = anchor_runs(np.frombuffer(x, np.uint8), window, gram)
                runs.append(np.stack([h.view(np.int64), anchor, first, last], 1) if len(h) else np.zeros((0, 4), np.int64))
            sizes = [len(r) for r in runs]
            flat = np.concatenate(runs)
            packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["h", "a", "s", "e"]))
            yield pa.record_batch([b.column(0), b.column("k1"), b.column("k2"), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), packed], ["doc_id", "k1", "k2", "n_bytes", "sha", "runs"])

    signed = stored(plain.mapInArrow(sign, f"doc_id {kind}, k1 long, k2 long, n_bytes long, sha string, runs array<struct<h:long,a:long,s:long,e:long>>"), "signed")
    copies = stored(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    records = signed.select("k1", "k2", F.inline("runs"))
    mark = F.xxhash64("k1", "k2", "a")
    hashes = stored(records.groupBy("h").agg(F.min(mark).alias("x"), F.max(mark).alias("y"), F.count("*").alias("n")).where("x <> y").select("h", "n"), "hashes")
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    found = records.join(hashes, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "n", "a", "s", "e")).alias("found"))
    wanted = stored(found.join(copies, ["k1", "k2"]).select("k1", "k2", "rep", "found"), "wanted")

    # of copies the row of the smallest id stands for all
    keyed = plain.where(F.octet_length("text") >= window)
    texts = stored(keyed.join(wanted, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("k1", "k2", "found", "text"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records with their bytes, dealt to shards."""
        for b in slices(batches, "text", CHUNK):
            row, (h, n, a, s, e) = _fields(b.column("found"), "hnase")
            k1, k2 = (b.column(c).to_numpy()[row] for c in ("k1", "k2"))
            parts = np.maximum(1, -(-n // shard))
            salt = (_mix(_mix(k1.view(np.uint64)) ^ k2.view(np.uint64) ^ a.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            view, offsets = raw_bytes(b.column("text"))
            text, at = view[offsets[0] : offsets[-1]].tobytes(), offsets[row] - offsets[0]
            cuts = [text[x:y] for x, y in zip((at + s).tolist(), (at + e + window).tolist(), strict=True)]
            yield pa.record_batch([*(pa.array(c) for c in ((h + salt * 0x9E3779B1) % shards, h, parts, salt, k1, k2, s)), pa.array(cuts, pa.binary())], ["shard", "h", "parts", "salt", "k1", "k2", "s", "bytes"])

    dealt = texts.mapInArrow(cut, "shard long, h long, parts long, salt long, k1 long, k2 long, s long, bytes binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated windows of each shard; for anchors of several shards also the digests:
        a row ``k1, k2, lo, hi`` is a span, one with ``part`` >= 0 waits for the merger."""
        for group in _groups(batches):
            h, parts, salt, k1, k2, s = (group.column(c).to_numpy() for c in ("h", "parts", "salt", "k1", "k2", "s"))
            rows = group.column("bytes").to_pylist()
            index: dict[bytes, int] = {}
            which = [index.setdefault(x, len(index)) for x in rows]
            distinct = list(index)
            flags, _ = repeated(distinct, window)
            often = np.bincount(which, minlength=len(distinct)) > 1
            lane, first, last = _lane_runs(flags, often)
            n = np.bincount(lane, minlength=len(distinct))
            runs = _spread((np.cumsum(n) - n)[which], n[which])
            rep = np.repeat(np.arange(len(which)), n[which])
            none = np.full(len(rep), -1, np.int64)
            yield pa.record_batch([pa.array(k1[rep]), pa.array(k2[rep]), pa.array(s[rep] + first[runs]), pa.array(s[rep] + last[runs] + window), pa.array(none), pa.array(none), pa.nulls(len(rep), pa.binary())], NAMES)
            wide = np.flatnonzero(parts > 1)
            here = int(group.column("shard")[0].as_py())
            for x in np.unique(h[wide]).tolist():
                own = wide[h[wide] == x]
                shared, waiting = set(), []
                for r in own[np.unique([which[r] for r in own.tolist()], return_index=True)[1]].tolist():
                    w = which[r]
                    d = [y.ljust(16, b"\0") for y in digests(distinct[w], window).tolist()]
                    if often[w]:
                        shared.update(d)
                        continue
                    for k, twice in enumerate(flags[w].tolist()):
                        if twice:
                            shared.add(d[k])
                        else:
                            waiting.append((k1[r], k2[r], s[r] + k, s[r] + k + window, d[k]))
                # a row for each window that is single here, and one for each that is settled here
                rows = waiting + [(0, 0, 0, -1, y) for y in sorted(shared)]
                cols = list(zip(*rows, strict=True))
                top = np.frombuffer(b"".join(y[:4] for y in cols[4]), ">u4").astype(np.int64)
                part = (int(x) * 31 & (1 << 60) - 1) + (top * (int(parts[own[0]]) * RANGES) >> 32)
                yield pa.record_batch([*(pa.array(np.array(c, np.int64)) for c in cols[:4]), pa.array(part), pa.array(np.full(len(rows), here)), pa.array(cols[4], pa.binary())], NAMES)

    NAMES = ["k1", "k2", "lo", "hi", "part", "shard", "digest"]
    result = stored(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "k1 long, k2 long, lo long, hi long, part long, shard long, digest binary"), "found")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted digests of the shards of one range, merged by binary search."""
        for group in _groups(batches):
            digest = np.array(group.column("digest").to_pylist(), "S16")
            shard_of, hi, lo = (group.column(c).to_numpy() for c in ("shard", "hi", "lo"))
            hit = np.zeros(len(digest), bool)
            lists = {x: np.unique(digest[shard_of == x]) for x in np.unique(shard_of).tolist()}
            merged = np.sort(np.concatenate(list(lists.values())))
            for x, own in lists.items():
                twice = own[np.searchsorted(merged, own, side="right") - np.searchsorted(merged, own, side="left") > 1]
                mine = np.flatnonzero((shard_of == x) & (hi >= 0))
                spot = np.searchsorted(twice, digest[mine])
                hit[mine] = (spot < len(twice)) & (twice[np.minimum(spot, max(len(twice) - 1, 0))] == digest[mine]) if len(twice) else False
            hit = np.flatnonzero(hit)
            yield pa.record_batch([group.column("k1").combine_chunks().take(pa.array(hit)), group.column("k2").combine_chunks().take(pa.array(hit)), pa.array(lo[hit]), pa.array(hi[hit])], ["k1", "k2", "lo", "hi"])

    waiting = result.where("part >= 0").select("part", "k1", "k2", "lo", "hi", "shard", "digest")
    merged = waiting.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "k1 long, k2 long, lo long, hi long")
    spans = result.where("part < 0").select("k1", "k2", "lo", "hi").unionByName(merged)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    single = stored(spans.join(copies.where("copies = 1"), ["k1", "k2"], "left_semi"), "spans")
    rows = signed.select("doc_id", "k1", "k2", "n_bytes", "sha").join(copies.select("k1", "k2", "copies"), ["k1", "k2"])
    return rows, single, texts.select("k1", "k2", "text")


def union(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans of each row joined; sorted by row and place, which are
    below 2^31."""
    order = np.lexsort((lo, row))
    shift = row[order] << 32
    lo, reach = lo[order] | shift, np.maximum.accumulate(hi[order] | shift)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]])) if len(lo) else order
    last = np.append(first[1:], len(lo))[: len(first)] - 1
    return lo[first] >> 32, lo[first] & 0xFFFFFFFF, reach[last] & 0xFFFFFFFF


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, keep_bytes: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and
    ``k1, k2`` with ``kept``, the bytes that stay, null where nothing was removed, on demand).

    Defined cases: null counts as empty; texts shorter than the window keep all; of texts that
    occur more than once every byte goes (if a window long), and they count as an occurrence for
    other texts; repeated rows are such copies; null ids are kept as they are; an empty table
    gives an empty result; other columns are ignored.  Bytes are judged on the input: what is
    left need not be valid UTF-8.
    """
    rows, spans, texts = repeated_spans(docs, id_col, text_col, window, gram, shard)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out = []
            row, (lo, hi) = _fields(b.column("spans"), ["lo", "hi"])
            row, lo, hi = union(row, lo, hi)
            edges = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            lo, hi = lo.tolist(), hi.tolist()
            for text, (x, y) in zip(b.column("text").cast(pa.binary()).to_pylist(), itertools.pairwise(edges), strict=True):
                kept = b"".join(text[a:z] for a, z in zip([0, *hi[x:y]], [*lo[x:y], len(text)], strict=True))
                out.append((len(text) - len(kept), y - x, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([b.column("k1"), b.column("k2"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["k1", "k2", "removed", "spans", "kept_sha", "kept"])

    done = stored(texts.join(spans, ["k1", "k2"]).mapInArrow(apply, "k1 long, k2 long, removed long, spans long, kept_sha string, kept binary"), "applied")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    out = rows.join(done, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(empty)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *(["k1", "k2", F.when(all_, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_bytes else []),
    )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated spans cut out of the texts; all rows and other columns stay.

    Bytes of a character that a span cuts through go with it.  A column ``n_chars`` of whole
    numbers, if there is one, follows the text.  Null texts stay null.
    """
    changed = remove_repeats(docs, id_col, text_col, window, gram, keep_bytes=True).where("n_removed > 0")
    changed = stored(changed.groupBy("k1", "k2").agg(F.first("kept").alias("kept")), "changed")

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    changed = changed.select(F.col("k1").alias("\x01k1"), F.col("k2").alias("\x01k2"), decoded("kept").alias("\x01kept"))
    k1, k2 = _key(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(changed, (k1 == F.col("\x01k1")) & (k2 == F.col("\x01k2")), "left")
    hit = F.col("\x01kept").isNotNull()
    out = []
    for name, kind in docs.dtypes:
        col = F.col(f"`{name}`")
        if name == text_col:
            col = F.when(hit, F.col("\x01kept")).otherwise(col)
        elif name == "n_chars" and kind in ("bigint", "int"):
            col = F.when(hit, F.length("\x01kept").cast(kind)).otherwise(col)
        out.append(col.alias(name))
    return joined.select(*out)
