"""Cost-balanced packing of token sequences.

Ids are those of the ``tokenizers`` library for the vocabulary's file: added tokens that a text
spells out are matched first, as the library does by default.  Attention over a piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``.  A document is cut
into full sequences first; the rests of a block of documents are then taken from the longest
down, each to the sequence of lowest cost so far that has room for it, whichever that is.  What
has no room in any sequence as a whole is cut to fill the room that is left, so that nothing but the end of a block is short of
a full sequence; that end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, slices

#: Model dimension 1024: projections and feed-forward 12 d^2 a token, attention 2 d a pair.
LINEAR, QUADRATIC = 12 * 1024.0, 2.0
#: Rests that are packed together.
BLOCK = 4096
MEMO = 400_000


def read_model(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of a byte-level BPE from its ``tokenizers`` file, and the ids of its added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in seen)}
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t.get(k) for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}, added


class WordEncoder:
    """Ids of whole texts.

    A space between two characters that are no white space always begins a pre-token, so ids
    of the words between such spaces can be kept and joined.  Missing words of a batch are
    encoded in one call and told apart by the lengths of their tokens.
    """

    def __init__(self, path: str, pattern: str):
        ranks, self.added = read_model(path)
        self.codec = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        self.memo: dict[str, bytes] = {}
        longest = sorted(self.added, key=len, reverse=True)
        self.spelt = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else re.compile(r"(?!)")

    def whole(self, text: str) -> bytes:
        return np.array(self.codec.encode_ordinary(text), "<u4").tobytes()

    def parted(self, text: str) -> bytes:
        """A text with added tokens in it: each is an id, and what lies between is encoded apart."""
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if k % 2 else self.whole(p) for k, p in enumerate(self.spelt.split(text)))

    def learn(self, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        ids = np.array(self.codec.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum(self.sizes[ids])
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(ends, stops) + 1
        if not np.array_equal(ends[cuts - 1], stops):
            raise AssertionError("a token crosses words")
        data, out, at = ids.tobytes(), {}, 0
        for w, cut in zip(words, (cuts * 4).tolist(), strict=True):
            out[w] = data[at:cut]
            at = cut
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, list[str]] = {}
        missing: set[str] = set()
        memo = self.memo
        for k, t in enumerate(texts):
            if self.spelt.search(t):
                out[k] = self.parted(t)
                continue
            words = t.split(" ")
            # white space beside a space, or at an end: no plain words
            if len(words) < 2 or any(not w or w[0].isspace() or w[-1].isspace() for w in set(words)):
                out[k] = self.whole(t)
            else:
                split[k] = words
                missing.update(words[1:])
        missing.difference_update(memo.keys())
        new = self.learn(sorted(missing))
        if len(memo) + len(new) > MEMO:
            room = MEMO - len(memo)
            known = memo | new if room <= 0 else None
            if room > 0:
                memo.update(new)
        else:
            known = None
            memo.update(new)
        get = (memo if known is None else known).__getitem__
        for k, words in split.items():
            out[k] = self.whole(words[0]) + b"".join(map(get, words[1:]))
        return out  # type: ignore[return-value]


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> WordEncoder:
    return WordEncoder(path, pattern)


class Rooms:
    """Sequences by the room that is left: the cheapest of those with room enough is found in a
    tree over all rooms, whose nodes have the cheapest below them."""

    NONE = (float("inf"), -1)

    def __init__(self, full: int, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree = [self.NONE] * (2 * self.half)
        self.heaps[capacity] = [(0.0, b) for b in range(full)]
        self._changed(capacity)

    def _changed(self, room: int) -> None:
        heap, tree, k = self.heaps[room], self.tree, self.half + room
        tree[k] = heap[0] if heap else self.NONE
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                return
            tree[k] = best

    def cheapest(self, need: int) -> tuple[float, int]:
        """Cost and number of the cheapest sequence with room for ``need``; number -1 if none has."""
        tree, k = self.tree, self.half + need
        best = tree[k]
        while k > 1:
            if not k & 1 and tree[k + 1] < best:
                best = tree[k + 1]
            k >>= 1
        return best

    def fill(self, sequence: int, cost: float, before: int, after: int) -> None:
        """The cheapest sequence of a room has ``cost`` and less room now."""
        assert self.heaps[before][0][1] == sequence
        heapq.heappop(self.heaps[before])
        self._changed(before)
        if after:
            heapq.heappush(self.heaps[after], (cost, sequence))
            self._changed(after)


def balanced(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pack items of ``1 <= length < capacity``: a list of ``(item, start, length)`` for each
    sequence.  All sequences are full but the last ones, whose lengths are powers of two."""
    total = sum(lengths)
    full = total // capacity
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(full)]
    room = [capacity] * full
    rooms = Rooms(full, capacity)
    left: list[tuple[int, int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        cost, b = rooms.cheapest(n)
        if b < 0:
            left.append((item, 0, n))
            continue
        bins[b].append((item, 0, n))
        rooms.fill(b, cost + LINEAR * n + QUADRATIC * n * n, room[b], room[b] - n)
        room[b] -= n
    gaps = [b for b in range(full) if room[b]]
    tail: list[tuple[int, int, int]] = []
    for item, start, n in left:
        while n and gaps:
            b = gaps[-1]
            take = min(n, room[b])
            bins[b].append((item, start, take))
            room[b] -= take
            start, n = start + take, n - take
            if not room[b]:
                gaps.pop()
        if n:
            tail.append((item, start, n))
    rest, size = total - full * capacity, 1
    while size * 2 <= rest:
        size *= 2
    while rest:
        if size <= rest:
            need, own = size, []
            while need:
                item, start, n = tail.pop()
                take = min(n, need)
                own.append((item, start, take))
                need -= take
                if n > take:
                    tail.append((item, start + take, n - take))
            bins.append(own)
            rest -= size
        size //= 2
    return bins


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (and ``ids``, binary, on demand).  Each document ends with ``end_id``.  Texts are encoded as
    the library does with ``add_special_tokens=False``; an added token that is spelt out is its id.

    There is no shuffle: each input partition packs its own documents, a block of rests at a
    time; sequence ids are the partition's number and a counter, the same on every attempt.

    Defined cases: null and empty texts have the end id alone; repeated rows are packed each;
    a null id stays null; long texts are cut; an empty table gives an empty result; other
    columns are ignored.  ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        ending = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        rests: list[tuple[object, int, bytes, int]] = []  # id, start, ids, tokens of the document
        rows: list[tuple] = []

        def add(doc, start, ids, total, sequence, offset):
            rows.append((doc, start, len(ids) // 4, crc(ids), total, sequence, offset, ids if with_ids else None))

        def flush() -> None:
            nonlocal number
            for own in balanced([len(r[2]) // 4 for r in rests], capacity):
                offset = 0
                for item, start, n in own:
                    doc, base, ids, total = rests[item]
                    add(doc, base + start, ids[4 * start : 4 * (start + n)], total, number, offset)
                    offset += n
                number += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 8
            rows.clear()
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
            return pa.record_batch(arrays, names)

        names, kind = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids, pa.int64()
        for b in slices(batches, "text", 2 << 20):
            kind = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), enc.batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += ending
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    add(doc, start, ids[4 * start : 4 * (start + capacity)], total, number, 0)
                    number += 1
                if whole < total:
                    rests.append((doc, whole, ids[4 * whole :], total))
                    if len(rests) >= block:
                        flush()
            yield out()
        flush()
        yield out()

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, {SCHEMA}" + ", ids binary" * with_ids)
