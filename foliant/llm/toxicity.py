"""Toxicity of texts behind obfuscation: a noisy-channel decoder and a linear model.

Tokens that mix letters with digits or signs, draw letters out, or spell words with spaces are
lattices: each character may stand for itself, for the letters it imitates, or for nothing; a
space may also stay.
Viterbi decoding under a character trigram model, learnt from all texts, restores the likeliest
letters.  Words, plain and restored, and their first letters are the features of a logistic
regression, those alone whose share of toxic rows is out of reach of chance.  Runs of single characters
are also parted into known words, those of the labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, few, slices, stored

#: Character classes of the language model: 0 is the word border, then a-z and the letters of Latin-1.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
N = len(LETTERS) + 1
CLASS = {c: k + 1 for k, c in enumerate(LETTERS)}
TABLE = np.zeros(256, np.int64)
for _c, _k in CLASS.items():
    TABLE[ord(_c)] = _k
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "§": "s", "*": "aeiou", "#": "h", "%": "", "&": ""}
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’–—…¿¡·"
OPENERS = "".join(c for c in SIGNS if c not in "$@|+")
#: Signs that imitate no letter.
JOINT = re.compile("[" + re.escape("".join(c for c in SIGNS if not LEET.get(c))) + "]+")
DRAWN = re.compile(rf"([{LETTERS}])\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+*])(?: (?:[^\W\d_]|[0-9@$!|+*])){2,}(?!\S)")
#: Log costs of the channel: a letter for a sign, a dropped sign, a dropped repetition, a dropped
#: space, a dropped digit, a space that stays; a character of a spelt run that is in no known word.
SWAP, DROP, SHORT, JOIN, DIGIT, STAY, STRAY = 1.0, 0.7, 0.5, 0.7, 8.0, 4.0, 15.0
#: First letters of a longer word that also make a feature, for inflected forms.
STEMS = (4, 5, 6)
#: Readings kept, of tokens of at most so many characters; they only save time.
MEMO, KEPT = 100_000, 80

#: Labelled rows that are learnt from, those of smallest hash; words that become features; rows that
#: a word needs, and standard deviations by which its share of toxic rows must differ from that of all.
SAMPLE, FEATURES, LEAST, SURE = 40_000, 2_000, 6, 5.0
RIDGE, STEPS = 0.1, 400

#: Bytes of text, and rows of words, that a worker holds in its own objects at a time.
CHUNK, ROWS = 1 << 19, 1000


@dataclass
class Decoder:
    """Viterbi decoding of obfuscated tokens under trigram log probabilities (N x N x N).

    All states are kept: a state is a pair of classes that characters may stand for, and a
    character stands for few, so there are a few dozen at most.
    """

    model: np.ndarray
    #: Costs of known words, which part a run of single characters.
    lexicon: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rows = self.model.reshape(N * N, N).tolist()
        self.starts = {w[:k] for w in self.lexicon for k in range(1, len(w) + 1)}

    def options(self, token: str, k: int) -> list[tuple[int, float]]:
        """Classes that a character may stand for, with costs; -1 is nothing."""
        c = token[k]
        if c in CLASS:
            out = [(CLASS[c], 0.0)]
            if token[max(0, k - 2) : k] == c * 2 or token[max(0, k - 1) : k + 2] == c * 3:
                out.append((-1, SHORT))
            return out
        out = [(CLASS[x], SWAP) for x in LEET.get(c, "")]
        if c == " ":
            out += [(-1, JOIN), (0, STAY)]
        elif not c.isalpha():
            out.append((-1, DROP if c in SIGNS else DIGIT))
        return out or [(0, 0.0)]

    def decode(self, token: str) -> tuple[str, ...]:
        """The words of the likeliest reading of a lower-case token."""
        known = self.memo.get(token)
        if known is not None:
            return known
        rows = self.rows
        # the last two classes: cost, and the classes so far as a chain, so that time is linear in the length
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for k in range(len(token)):
            new: dict[int, tuple[float, tuple | None]] = {}
            options = self.options(token, k)
            for state, (cost, said) in states.items():
                row = rows[state]
                for x, extra in options:
                    if x < 0:
                        to, total = state, cost + extra
                    else:
                        to, total = state % N * N + x, cost + extra - row[x]
                    if to not in new or total < new[to][0]:
                        new[to] = (total, said if x < 0 else (x, said))
            states = new
        chain = min(((cost - rows[state][0], state, said) for state, (cost, said) in states.items()), key=lambda s: s[:2])[2]
        letters = []
        while chain is not None:
            x, chain = chain
            letters.append(LETTERS[x - 1] if x else " ")
        best = "".join(reversed(letters))
        words = tuple(w for w in best.split() if len(w) > 1)
        if len(token) <= KEPT and len(self.memo) < MEMO:
            self.memo[token] = words
        return words

    def parted(self, run: str) -> set[str]:
        """Known words of the cheapest parting of characters that spaces part; in linear time, as a
        word is no longer than the longest that is known."""
        token = run.replace(" ", "")
        options = [[(x, cost) for x, cost in self.options(token, k) if x] for k in range(len(token))]
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(np.inf, 0, "")] * len(token)
        for i in range(len(token)):
            at = best[i][0]
            if at + STRAY < best[i + 1][0]:
                best[i + 1] = (at + STRAY, i, "")
            states, k = {"": at}, i
            while states and k < len(token):
                new: dict[str, float] = {}
                for said, cost in states.items():
                    for x, extra in options[k]:
                        to = said if x < 0 else said + LETTERS[x - 1]
                        if (to in self.starts or not to) and cost + extra < new.get(to, np.inf):
                            new[to] = cost + extra
                # a word starts with a letter; dropped characters before it are those of the word before
                states, k = {w: c for w, c in new.items() if w}, k + 1
                for w, c in states.items():
                    if w in self.lexicon and c + self.lexicon[w] < best[k][0]:
                        best[k] = (c + self.lexicon[w], i, w)
        found, k = set(), len(token)
        while k:
            _, k, w = best[k]
            found.add(w)
        return found - {""}

    def words(self, text: str) -> set[str]:
        """Words of a text, plain and restored, each once."""
        text = text.lower()
        found: set[str] = set()
        drawn = DRAWN.search(text) is not None
        for token in set(text.split()):
            if not token.isalpha():
                token = token.rstrip(SIGNS).lstrip(OPENERS)
                if not token.isalpha():
                    parts = [p for p in re.split(r"[\W\d_]+", token) if len(p) > 1]
                    found.update(parts)
                    if any(c in CLASS for c in token):
                        found.update(self.decode(token))
                    pieces = JOINT.split(token)  # words joined by signs, each by itself
                    for piece in pieces if len(pieces) > 1 else ():
                        if any(c in CLASS for c in piece) and (not piece.isalpha() or DRAWN.search(piece)):
                            found.update(self.decode(piece))
                    continue
            found.add(token)
            if drawn and DRAWN.search(token):
                found.update(self.decode(token))
        for m in SPACED.finditer(text):
            found.update(self.decode(m[0]))
            found.update(self.parted(m[0]))
        return found


def stems(words: set[str]) -> set[str]:
    return {w[:k] for k in STEMS for w in words if len(w) > k}


def trigram_model(counts: dict[int, int]) -> np.ndarray:
    """Interpolated log probabilities of a class after two others, as N x N x N."""
    c3 = np.zeros(N**3)
    for code, n in counts.items():
        c3[code] = n
    c3 = c3.reshape(N, N, N)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + N)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)).astype(np.float32)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Counts of the classes of three characters over all texts: at most N^3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for b in slices(batches, "text", CHUNK):
            joined = "\n".join([t for t in b.column(0).to_pylist() if t]).lower()
            c = TABLE[np.frombuffer(f"\n\n{joined}\n".encode("latin-1", "replace"), np.uint8)]
            total += np.bincount(c[:-2] * (N * N) + c[1:-1] * N + c[2:], minlength=N**3)
        total[0] = 0
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], ["code", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code long, n long")
    return dict(rows.groupBy("code").agg(F.sum("n").alias("n")).collect())


def positions(words: pa.ListArray, names: pa.Array) -> pa.ListArray:
    """Of each row's words, the places in ``names`` of those that are there, in order.  No word
    becomes a Python object: those of a batch would take hundreds of MB."""
    found = pc.index_in(words.flatten(), value_set=names)
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())[found.is_valid().to_numpy(zero_copy_only=False)]
    at = found.drop_null().to_numpy()
    at = at[np.lexsort((at, row))]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32()), pa.array(at, pa.int32()))


@dataclass
class Model:
    trigrams: np.ndarray
    weights: dict[str, float]
    bias: float
    lexicon: dict[str, float] = field(default_factory=dict)


def logistic(rows: list[np.ndarray], y: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression over presence features, by accelerated gradients."""
    n = len(rows)
    at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    w, b = np.zeros(features), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, vb = w.copy(), b
    # the curvature of the loss is at most a quarter of the largest eigenvalue, here by power iteration
    u, ub, top = np.ones(features), 1.0, 1.0
    for _ in range(30):
        z = np.bincount(of, u[at], minlength=n) + ub
        u, ub = np.bincount(at, z[of], minlength=features), z.sum()
        top = max(float(np.sqrt((u**2).sum() + ub**2)), 1e-9)
        u, ub = u / top, ub / top
    rate = 1 / (0.26 * top + RIDGE)
    for step in range(STEPS):
        z = np.bincount(of, v[at], minlength=n) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad, gb = np.bincount(at, g[of], minlength=features) + RIDGE * v, g.sum()
        nw, nb = v - rate * grad, vb - rate * gb
        pace = step / (step + 3)
        v, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn the character model from all texts and the classifier from at most ``sample``
    labelled rows, which the caller has chosen (see :func:`training_labels`).

    Without labelled rows every score is the prior of one half less a little: nothing is toxic.
    """
    trigrams = trigram_model(trigram_counts(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(trigrams)
    chosen = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("long").alias("y"))
    chosen = stored(few(stored(chosen, "known"), F.xxhash64("id"), sample), "labels")  # a bounded table

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in slices(batches, "text", CHUNK):
            every = (decoder.words(t or "") for t in b.column("text").to_pylist())
            found = [sorted(w | {f"^{x}" for x in stems(w)}) for w in every]
            yield pa.record_batch([b.column("y"), pa.array(found, pa.list_(pa.string()))], ["y", "words"])

    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    taught = stored(taught.groupBy("text").agg(F.max("y").alias("y")).mapInArrow(read, "y long, words array<string>"), "taught")
    total, bad = taught.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == total:
        return Model(trigrams, {}, -1.0)
    # words of at most `sample` rows that enough of them have
    known = taught.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("b"), F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()
    p = bad / total
    gain = {r["w"]: abs(r["b"] - p * r["n"]) / np.sqrt(p * (1 - p) * r["n"]) for r in known}
    top = sorted((w for w, g in gain.items() if g >= SURE), key=lambda w: (-gain[w], w))[:features]
    plain = [r for r in known if r["w"][0] != "^"]
    every = sum(r["n"] for r in plain)
    lexicon = {r["w"]: float(np.log(every / r["n"])) for r in plain if all(c in CLASS for c in r["w"])}
    index = docs.sparkSession.sparkContext.broadcast(top)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(index.value, pa.string())
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                own = b.slice(k, ROWS)
                yield pa.record_batch([own.column("y"), positions(own.column("words"), names)], ["y", "ids"])

    # at most `sample` rows of at most `features` numbers
    rows = sorted(taught.mapInArrow(project, "y long, ids array<int>").collect(), key=lambda r: (r["y"], r["ids"]))
    w, bias = logistic([np.array(r["ids"], np.int64) for r in rows], np.array([r["y"] for r in rows], float), len(top))
    return Model(trigrams, dict(zip(top, w.tolist(), strict=True)), bias, lexicon)


def training_labels(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """One label for each id outside the held-out fold (crc32 of the id, modulo 5, is 0); null
    labels and ids are left out; an id that is labelled twice takes the higher label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    return known.groupBy("doc_id").agg(F.max(label_col).alias(label_col))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the likelihood of label 1, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        decoder, words = Decoder(m.trigrams, m.lexicon), {w: x for w, x in m.weights.items() if w[0] != "^"}
        starts = {w[1:]: x for w, x in m.weights.items() if w[0] == "^"}
        for column in batches:
            out = []
            for t in column:
                own = decoder.words(t or "")
                hits = sorted([words[w] for w in words.keys() & own] + [starts[w] for w in starts.keys() & stems(own)])
                out.append(m.bias + sum(hits))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700))))

    return docs.withColumn(name, scored(F.col(text_col)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, score, predicted``.

    The score is a function of the text alone.  Defined cases: null texts count as empty and get
    the bias of the model; null ids are scored (held out by the empty text's checksum) but never
    learnt from; repeated rows each give a row; without labels all scores are equal and below one
    half; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, training_labels(labels, label_col), sample, FEATURES, id_col, text_col, label_col)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_score(plain, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``; columns stay as they are."""
    model = fit(docs, training_labels(labels), id_col=id_col, text_col=text_col)
    return with_score(docs, model, text_col, "\x01score").where(F.col("\x01score") < threshold).drop("\x01score")
