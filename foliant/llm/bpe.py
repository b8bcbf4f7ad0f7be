"""Byte-level BPE by longest match and backtracking, exact and in linear time.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton of all tokens finds
the longest token at each position.  A token may follow another only if the merge procedure
would leave that pair apart; this compatibility is memoised.  When no token fits, the last one
is taken back and a shorter prefix tried; a position that failed is never tried again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Entries of the piece memo of a worker; it only saves time.  Early entries are the frequent
#: ones, so a full memo stays as it is until RENEW further pieces were missing from it.
MEMO = 400_000
RENEW = 3_000_000
PAIRS = 400_000
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder for a vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for i, t in self.tokens.items()}
        self.machine = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.machine.add_word(t.decode("latin-1"), i)
        self.known = {t.decode("latin-1"): i for t, i in ranks.items()}.get
        self.widest = max(map(len, ranks))
        self.shorter = {i: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None) for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}
        self.missed = 0
        self.fits_memo: dict[int, bool] = {}
        for i in sorted(self.tokens):
            t, left = self.tokens[i], self.shorter[i]
            self.halves[i] = (i, i)
            while left is not None:
                right = ranks.get(t[self.size[left] :])
                if right is not None and left < i and right < i and self._apart(left, right):
                    self.joined[left << 20 | right] = i
                    self.halves[i] = (left, right)
                    break
                left = self.shorter[left]
        self.fits_memo.clear()

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b side by side: undo merges from the latest back
        and see that no earlier merge would have crossed the border."""
        joined, halves, bound = self.joined.get, self.halves, 1 << 62
        while True:
            c = joined(a << 20 | b)
            if c is not None and c < bound:
                return False
            if a > b:
                bound, a = a, halves[a][1]
                if a == bound:
                    bound, b = b + 1, halves[b][0]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, halves[b][0]
                if b + 1 == bound:
                    bound, a = a, halves[a][1]
                    if a == bound:
                        return True

    def fits(self, a: int, b: int) -> bool:
        """``_apart``, kept for later."""
        if len(self.fits_memo) >= PAIRS:
            self.fits_memo.clear()
        known = self.fits_memo[a << 20 | b] = self._apart(a, b)
        return known

    def _longest(self, text: str, at: int) -> int:
        """The longest token at a position: as deep as the trie goes, then back to a token."""
        rest = text[at : at + self.widest]
        n, known = self.machine.longest_prefix(rest), self.known
        while n:
            token = known(rest[:n])
            if token is not None:
                return token
            n -= 1
        raise ValueError("a byte is missing from the vocabulary")

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = piece.decode("latin-1")
        whole = self.known(text)
        if whole is not None:
            return [whole]
        n, size, shorter, apart, longest = len(text), self.size, self.shorter, self.fits_memo.get, self._longest
        out: list[int] = []
        failed: set[int] = set()
        at, last = 0, -1
        token: int | None = longest(text, 0)
        while True:
            end = at + size[token]
            if end not in failed and (last < 0 or (ok := apart(last << 20 | token)) or (ok is None and self.fits(last, token))):
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                token = longest(text, at)
                continue
            token = shorter[token]
            while token is None:  # take the last token back
                if last < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                failed.add(at)
                out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        found = self.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG:
            if len(self.memo) < MEMO:
                self.memo[piece] = ids
            elif (missed := self.missed + 1) > RENEW:
                self.memo = {}
                self.missed = 0
            else:
                self.missed = missed
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo, piece = self.memo.get, self._piece
        return b"".join([memo(p) or piece(p) for p in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@functools.lru_cache(4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary: little-endian unsigned 32-bit) for each row.

    Null and empty texts give no ids; repeated rows are encoded alike; ids may be null; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in slices(batches, "text", 4 << 20):
            yield pa.record_batch([b.column(0), pa.array([bpe.encode_bytes(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` (binary) for the result of :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in slices(batches, "ids", 4 << 20):
            back = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column(0), b.column("ids"), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema[0].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = tokenizer(path, pattern), hashlib.sha256
        for b in slices(batches, "text", 4 << 20):
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode_bytes(t or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                d.append(sha(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
