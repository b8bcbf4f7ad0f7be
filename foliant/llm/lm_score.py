"""Document log-likelihoods under a gated recurrent language model with class-factored output.

The probability of a word is that of its class times that of the word in its class, and both are
softmaxes over the network's state: in a class the most frequent words have a place each, and the
rest one together, which they share by smoothed counts.  Classes are spelling clusters times bands
of frequency; three more stand for the end, for a word never seen in training, and for the word
before once more.  Counts cover the whole training corpus; so does training: after a short start on
the driver every partition trains on its own documents and the weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, few, raw_bytes, slices, stored
from .gru import NEVER, Gru, Trainer, log_likelihood

HIDDEN, CLUSTERS, BANDS, HEAD = 16, 12, 5, 256
END, UNKNOWN, REPEAT, FIRST = 0, 1, 2, 3
CLASSES = FIRST + CLUSTERS * BANDS
#: Input ids: the classes, a start, and a row for each of the most frequent words.
START = CLASSES
INPUTS = CLASSES + 1 + HEAD
#: Words that have a place of their own in a class, at most.
PLACES = 15
#: Frequent words whose spelling makes the clusters, at most; buckets of letter pairs.
SPELT, PAIRS = 4096, 256
#: Text of a local dictionary; its words take some three times as much memory as their bytes.
CHUNK = 24 << 20
#: The start on the driver: stretches of so many tokens, taken from anywhere in all documents alike.
WARM, STRETCH, WARM_RATE, RATE = 256, 512, 0.01, 0.003
#: Tokens that a partition trains on or scores at a time.
TOKENS = 4 << 20
#: Tasks that look words up, at most; there are as many as input partitions otherwise.
MOST_TASKS = 20_000
#: An output code is a class, or CLASSES and more for a word with a place; this bit marks a word that
#: training sees once, which is an unknown one to all the rest of it and so is taught as such.
ONCE = 1 << 15


class Ids(dict):
    """Word -> place of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def letter_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of letters: its bucket, and the place of its word, in order of words; signs and
    digits are left out."""
    data = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in words), np.uint8)
    row = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    letter = (data == 0) | (data >= 97) & (data <= 122) | (data >= 128)
    data, row = data[letter].astype(np.uint16), row[letter]
    pair = ((data[:-1] * 31 + data[1:] * 7) ^ (data[:-1] << 3)) % PAIRS
    ok = (row[1:] == row[:-1]) & ((data[1:] > 0) | (data[:-1] > 0))
    return pair[ok], row[:-1][ok]


def spelling(words: list[bytes]) -> np.ndarray:
    """A unit vector of letter pairs for each word."""
    n = len(words)
    if not n:
        return np.zeros((0, PAIRS), np.float32)
    pair, row = letter_pairs(words)
    v = np.bincount(row.astype(np.int64) * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS).astype(np.float32)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-6)


def nearest(words: list[bytes], centre: np.ndarray) -> np.ndarray:
    """The centre of most spelling in common with each word, the first one if there is none: as all
    of a word's products have one length in them, its pairs' shares of the centres are added alone."""
    got = np.zeros(len(words), np.int64)
    if not words:
        return got
    pair, row = letter_pairs(words)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    if len(begin):
        got[row[begin]] = np.argmax(np.add.reduceat(centre.T.take(pair, 0), begin, axis=0), 1)
    return got


def clusters(words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Centres of spelling: weighted k-means, begun from far points."""
    v = spelling(words)
    if not len(v):
        return np.zeros((CLUSTERS, PAIRS), np.float32)
    centre = [v[0]]
    near = v @ centre[0]
    for _ in range(CLUSTERS - 1):
        k = int(np.argmax((1 - near) * np.log1p(weight)))
        centre.append(v[k])
        near = np.maximum(near, v @ v[k])
    c = np.array(centre)
    for _ in range(12):
        own = np.argmax(v @ c.T, 1)
        for k in range(CLUSTERS):
            if (own == k).any():
                s = (v[own == k] * np.log1p(weight[own == k])[:, None]).sum(0)
                c[k] = s / max(float(np.sqrt((s * s).sum())), 1e-6)
    return c.astype(np.float32)


def band(c: np.ndarray, total: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        f = -np.log10((np.maximum(c, 0) + 0.5) / max(total, 1))
    return np.clip(np.floor(f) - 2, 0, BANDS - 1).astype(np.int64)


def _class(cluster: np.ndarray, c: np.ndarray, total: int) -> np.ndarray:
    return np.where(c > 0, FIRST + cluster * BANDS + band(c, total), UNKNOWN)


class Codes:
    """Output codes: which words of which classes have a place, and how the rest is shared."""

    def __init__(self, words: list[bytes], c: np.ndarray, cls: np.ndarray):
        """From the most frequent words, in order, with their counts and classes."""
        self.code: dict[bytes, int] = {}
        self.cls, self.word = list(range(CLASSES)), [0] * CLASSES
        self.counts = np.zeros((CLASSES, PLACES + 1))
        taken = [0] * CLASSES
        for w, n, k in zip(words, c.tolist(), cls.tolist(), strict=True):
            if k >= FIRST and taken[k] < PLACES:
                taken[k] += 1
                self.code[w] = len(self.cls)
                self.cls.append(k)
                self.word.append(taken[k])
                self.counts[k, taken[k]] = n + 0.5

    def with_rest(self, rest: dict[int, float]) -> Codes:
        """Smoothed counts of the words of each class that have no place."""
        self.counts[:, 0] = 0.5
        for k, n in rest.items():
            self.counts[k, 0] = n
        return self

    def inner_bias(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(self.counts > 0, np.log(self.counts / self.counts.sum(1, keepdims=True)), NEVER)


def frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """Words of the highest counts, in order: all above a bound that ``limit`` words reach at most.
    The bound comes from counts of ranges of counts, some hundred numbers."""
    step = F.floor(F.log2("c") * 8).cast("int")
    seen = counts.where("c > 0")
    left, low = limit, None
    for r in sorted(seen.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r["n"] > left:
            break
        left, low = left - r["n"], r["s"]
    if low is None:
        return []
    found = seen.where(step >= low).select("word", "c").collect()
    return sorted(((bytes(w), c) for w, c in found), key=lambda r: (-r[1], r[0]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, chunk: int = CHUNK) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``.

    Rows with crc32(id as text) mod 5 = ``fold`` are held out: neither counts nor weights come
    from them.  Scores are base-10 logarithms for complete documents.  A word that training never
    saw is one event, as in the base score.

    Defined cases: null and empty texts have the end alone; null ids hash as an empty text;
    repeated rows count and are scored each; without training rows both scores are those of a
    model that knows only the unknown word, zero; an empty table gives an empty result; other
    columns are ignored.

    Scale: text is read once, into local dictionaries of bounded size and arrays of local ids.
    Only dictionaries are joined with the global counts (one row for a word in a chunk, so no
    hot word), and ids meet their dictionary again by chunk.  The driver sees the most frequent
    words, class totals and one set of weights: all of fixed size.
    """
    encoded, total, codes = encode(docs, id_col, text_col, fold, chunk)
    spark, kind = docs.sparkSession, encoded.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast((train(encoded, codes) if total else None, codes.cls, codes.word))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cls, word = model.value
        cls, word = np.array(cls, np.uint8), np.array(word, np.uint8)
        for b in blocks(batches, 2 * TOKENS):
            p = base = b.column("base_score").to_numpy()
            if m is not None:
                lengths, x, y = arrays(b)
                y = y & (ONCE - 1)
                p = log_likelihood(m, lengths, x, cls[y], word[y]) / np.log(10) + b.column("inner").to_numpy()
            yield pa.record_batch([*(b.column(k) for k in range(4)), pa.array(np.full(b.num_rows, total)), pa.array(base), pa.array(np.asarray(p, float))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "inner", "x", "y").mapInArrow(likelihood, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, chunk: int = CHUNK) -> tuple[DataFrame, int, Codes]:
    """``(encoded, train_tokens, codes)``: for each row its counts and base score, the inputs ``x``
    and the codes ``y`` of its words (16 bits each), and the share of those without a place in
    their classes (``inner``)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, 5) == fold).alias("held_out"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    NAMES = ["chunk", "local", "word", "n", "doc_id", "held_out", "ids"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of dictionaries (local >= 0) and of documents (local -1)."""
        number, ids, counts, held = TaskContext.get().partitionId() << 24, Ids(), np.zeros(0, np.int64), 0
        id_type = None

        def dictionary() -> pa.RecordBatch:
            n = len(ids)
            full = np.zeros(n, np.int64)
            full[: len(counts)] = counts
            return pa.record_batch([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int64)), pa.array(list(ids), pa.binary()), pa.array(full), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], NAMES)

        for b in slices(batches, "text", 2 << 20):
            id_type = b.column(0).type
            view, offsets = raw_bytes(b.column("text"))
            own, out, known = b.column("held_out").to_pylist(), [], ids.__getitem__
            parts = []
            for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                got = np.array([*map(known, view[a:z].tobytes().lower().split())], np.uint32)
                out.append(got.tobytes())
                if not own[k]:
                    parts.append(got)
            if parts:
                seen = np.bincount(np.concatenate(parts), minlength=len(counts)).astype(np.int64)
                seen[: len(counts)] += counts
                counts = seen
            n = b.num_rows
            yield pa.record_batch([pa.array(np.full(n, number)), pa.array(np.full(n, -1)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), b.column(0), b.column("held_out"), pa.array(out, pa.binary())], NAMES)
            held += int(offsets[-1] - offsets[0])
            if held >= chunk:
                yield dictionary()
                number, ids, counts, held = number + 1, Ids(), np.zeros(0, np.int64), 0
        if len(ids):
            yield dictionary()

    local = stored(plain.mapInArrow(split, f"chunk long, local long, word binary, n long, doc_id {kind}, held_out boolean, ids binary"), "local")
    words, rows = local.where("local >= 0").select("chunk", "local", "word", "n"), local.where("local < 0").select("chunk", "local", "doc_id", "held_out", "ids")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    ends = rows.where("not held_out").count()
    total, kinds = found[0] + ends, found[1] + (ends > 0)
    spark = docs.sparkSession
    top = frequent(counts, SPELT)
    words_, c_ = [w for w, _ in top], np.array([c for _, c in top], float)
    centre_ = clusters(words_, c_)
    codes = Codes(words_, c_, _class(nearest(words_, centre_), c_, total))
    centres = spark.sparkContext.broadcast(centre_)
    head = spark.sparkContext.broadcast(({w: k for k, w in enumerate(words_[:HEAD])}, codes.code))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, (first, code) = centres.value, head.value
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                part = b.slice(s, 20_000)
                w, c = part.column(0).to_pylist(), part.column(1).to_numpy()
                cls = _class(nearest(w, centre), c, total)
                x = np.array([CLASSES + 1 + first[k] if k in first else -1 for k in w], np.int64)
                y = np.array([code.get(k, -1) for k in w], np.int64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.where(y >= 0, y, cls)), pa.array(np.where(x >= 0, x, cls))], ["word", "c", "code", "x"])

    classed = stored(counts.mapInArrow(classify, "word binary, c long, code long, x long"), "classed")
    rest = classed.where(f"c > 0 AND code < {CLASSES}").groupBy("code").agg(F.sum(F.col("c") + 0.5).alias("s")).collect()
    codes.with_rest({r["code"]: r["s"] for r in rest})
    inner = np.log10(codes.counts[:, 0])
    # a local id, an input and a code are one number: there are as many of these rows as words in chunks
    entry = F.shiftleft("local", 32) + F.shiftleft("x", 16) + F.col("code")
    entries = words.select("chunk", "local", "word").join(classed, "word").select("chunk", "c", entry.alias("entry"))
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    # a chunk's dictionary comes before its documents by one number, which is all that is sorted by
    key = F.shiftleft("chunk", 1)
    both = entries.select(key.alias("key"), "entry", "c", none("doc_id", kind), none("held_out", "boolean"), none("ids", "binary")).unionByName(
        rows.select((key + 1).alias("key"), none("entry", "long"), none("c", "long"), "doc_id", "held_out", "ids")
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as inputs and classes; each chunk's dictionary comes first, in any order."""
        now, parts = None, []
        table: np.ndarray | None = None
        norm = np.log10(total + 0.5 * (kinds + 1))
        for batch in batches:
            for b in slices(iter([batch]), "ids", TOKENS * 4):
                keys = b.column("key").to_numpy()
                chunks, is_doc = keys >> 1, (keys & 1) == 1
                cuts = np.flatnonzero(np.diff(keys)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)], strict=True):
                    if s == e:
                        continue
                    part = b.slice(s, e - s)
                    if chunks[s] != now:
                        now, parts, table = chunks[s], [], None
                    if not is_doc[s]:
                        parts.append(np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "c")]))
                        continue
                    if table is None:
                        (packed, c), parts = np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64), []
                        table = np.empty((3, len(packed)), np.int64)
                        table[:, packed >> 32] = c, packed & 0xFFFF, packed >> 16 & 0xFFFF
                        c_of, code_of, x_of = table
                        base_of = np.log10(c_of + 0.5) - norm
                        shared = (c_of > 0) & (code_of < CLASSES)
                        inner_of = np.where(shared, np.log10(c_of + 0.5) - inner[np.where(shared, code_of, 0)], 0.0)
                        code_of = np.where(c_of == 1, code_of | ONCE, code_of)
                    cols: list[list] = [[] for _ in range(6)]
                    for raw in part.column("ids").to_pylist():
                        ids = np.frombuffer(raw, np.uint32)
                        c, again = c_of[ids], np.concatenate([[False], ids[1:] == ids[:-1]]) if len(ids) else np.zeros(0, bool)
                        y = np.append(np.where(again, REPEAT, code_of[ids]), END).astype(np.uint16)
                        x = np.concatenate([[START], x_of[ids]]).astype(np.uint16)
                        cols[0].append(len(ids) + 1)
                        cols[1].append(int((c > 0).sum()) + int(ends > 0))
                        cols[2].append(float(base_of[ids].sum() + np.log10(ends + 0.5) - norm))
                        cols[3].append(float(inner_of[ids][~again].sum()))
                        cols[4].append(x.tobytes())
                        cols[5].append(y.tobytes())
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                    yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *(pa.array(v, t) for v, t in zip(cols, types, strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inner", "x", "y"])

    ENCODED = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inner double, x binary, y binary"
    # a chunk is its input partition and a number: chunks are dealt in turn, so that none meets another
    # while there are tasks without one
    tasks = min(MOST_TASKS, 1 + (rows.agg(F.max(F.shiftright("chunk", 24))).first()[0] or 0))
    task = F.pmod(F.shiftright("key", 25) + F.shiftright("key", 1).bitwiseAND((1 << 24) - 1) * 7919, F.lit(tasks)).cast("int")
    dealt = both.repartitionById(tasks, task).sortWithinPartitions("key")
    return stored(dealt.mapInArrow(look_up, ENCODED), "encoded"), total, codes


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, to about ``limit`` bytes of ``x`` each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, "x", limit):
        _, offsets = raw_bytes(b.column("x"))
        held.append(b)
        size += int(offsets[-1] - offsets[0])
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document, and ``x`` and ``y`` of all of them one after another."""
    flat = []
    for name in ("x", "y"):
        view, offsets = raw_bytes(b.column(name))
        flat.append(view[offsets[0] : offsets[-1]].view(np.uint16))
    return np.diff(offsets) // 2, flat[0], flat[1]


def taught(codes: tuple[list[int], list[int]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and words to be learnt: a word that training sees once is an unknown one."""
    cls, word = np.array(codes[0], np.int64), np.array(codes[1], np.uint8)
    once, own = y >= ONCE, y & (ONCE - 1)
    return np.where(once, UNKNOWN, cls[own]), np.where(once, 0, word[own]).astype(np.uint8)


def train(encoded: DataFrame, codes: Codes) -> Gru:
    """Weights from all training documents: a start on WARM stretches of them on the driver, then
    one pass of every partition over its own, and the average by tokens."""
    rows = encoded.where("not held_out").select("n_tokens", "x", "y")
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / STRETCH)))
    every = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("at", stretch)
    at = (F.col("at") * (2 * STRETCH) + 1).cast("int")
    some = few(every, F.xxhash64("uid", "at"), WARM).select(*[F.substring(F.col(c), at, F.lit(2 * STRETCH)).alias(c) for c in "xy"]).collect()
    some.sort(key=lambda r: (bytes(r["x"]), bytes(r["y"])))
    places = (codes.cls, codes.word)
    lengths = np.array([len(r["x"]) // 2 for r in some], np.int64)
    x = np.frombuffer(b"".join(r["x"] for r in some), np.uint16)
    y, w = taught(places, np.frombuffer(b"".join(r["y"] for r in some), np.uint16))
    freq = np.bincount(np.concatenate([y, np.arange(CLASSES)]), minlength=CLASSES)
    trainer = Trainer(Gru.new(INPUTS, HIDDEN, np.log(freq / freq.sum()), codes.inner_bias()), WARM_RATE)
    for _ in range(4):
        trainer.epoch(lengths, x, y, w)
    start = encoded.sparkSession.sparkContext.broadcast((trainer.m, places))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = start.value
        own, tokens = Trainer(model.unflat(model.flat()), RATE), 0
        for b in blocks(batches, 2 * TOKENS):
            lengths, x, y = arrays(b)
            tokens += own.epoch(lengths, x, *taught(known, y))[1]
        if tokens:
            v = own.m.flat().astype(np.float64)
            yield pa.record_batch([pa.array(np.arange(len(v))), pa.array(v * tokens), pa.array(np.full(len(v), tokens))], ["k", "v", "n"])

    sums = rows.select("x", "y").mapInArrow(learn, "k long, v double, n long").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    if not sums:
        return trainer.m
    v = np.zeros(len(sums))
    for r in sums:
        v[r["k"]] = r["v"]
    return trainer.m.unflat(v)
