import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import bpe, media, packing

MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
BPE = bpe.tokenizer(MULTI, PATTERN)
REAL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
HF = Tokenizer.from_file(PLAIN)
ODD = ["", " ", "  ", "a" * 3000, "é" * 700, "!" * 900, " " * 500 + "x", "a\n\n b \t c", "中文 日本語 한국어", "😀😀‍", "\x1c x\x1d", "can't I'LL", "<|endoftext|>", "hi <|endoftext|> yo", "a<|endoftext|><|endoftext|>b  <|endoftext", "1234567890 ½²"]
EDGE = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "x" * 20_000), (5, "é中😀" * 300), (6, "hi <|endoftext|> yo")]


def edge(spark, rows=EDGE):
    df = spark.createDataFrame([(i, t, "a", 1.0) for i, t in rows], "doc_id long, text string, ids string, length double")
    return df.repartition(3)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_exact(text):
    ids = BPE.encode(text)
    assert ids == REAL.encode_ordinary(text) and BPE.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_bpe_odd_texts():
    for t in ODD:
        assert BPE.encode(t) == REAL.encode_ordinary(t), t[:20]


def test_bpe_query(spark):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge(spark), MULTI, PATTERN).collect()}
    want = set()
    for i, t in EDGE:
        ids = REAL.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    both = bpe.decode(bpe.encode(edge(spark), MULTI, PATTERN), MULTI, PATTERN)
    assert sorted(bytes(r.decoded) for r in both.collect()) == sorted((t or "").encode() for _, t in EDGE)
    assert bpe.digests(edge(spark, []), MULTI, PATTERN).count() == 0


def test_word_encoder_agrees_with_the_library():
    enc = packing.WordEncoder(PLAIN, PATTERN)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab é\n.,  1", k=rng.randint(0, 60))) for _ in range(300)]
    for _ in range(2):  # with an empty and a filled memo
        for t, ids in zip(texts, enc.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == HF.encode(t, add_special_tokens=False).ids, t[:30]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_balanced(lengths):
    bins = packing.balanced(lengths, 64)
    seen = [[0] * n for n in lengths]
    for own in bins:
        total = sum(n for _, _, n in own)
        assert total & (total - 1) == 0 and total <= 64
        for item, start, n in own:
            for k in range(start, start + n):
                seen[item][k] += 1
    assert all(all(c == 1 for c in s) for s in seen)
    assert sum(sum(n for _, _, n in b) < 64 for b in bins) <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 63), st.integers(40, 63)), max_size=150))
def test_whole_items_go_to_the_cheapest_sequence_with_room(lengths):
    """Against a search of all sequences."""
    full = sum(lengths) // 64
    bins = [[0.0, 64, []] for _ in range(full)]
    aside = set()
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = [k for k in range(full) if bins[k][1] >= n]
        if not fits:
            aside.add(item)
            continue
        b = bins[min(fits, key=lambda k: (bins[k][0], k))]
        b[0], b[1] = b[0] + packing.LINEAR * n + packing.QUADRATIC * n * n, b[1] - n
        b[2].append((item, 0, n))
    got = packing.balanced(lengths, 64)
    assert [[p for p in own if p[0] not in aside] for own in got[:full]] == [b[2] for b in bins]


def test_packing_query(spark):
    rows = packing.pack(edge(spark), PLAIN, PATTERN, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and packing.crc(bytes(r.ids)) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    for i, t in EDGE:
        ids = np.array([*HF.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(b for _, b in sorted(set(by_doc[i, len(ids) // 4]))) == ids
    assert packing.pack(edge(spark, []), PLAIN, PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge(spark), PLAIN, PATTERN, capacity=1000)


@pytest.mark.parametrize("units", [1, 2, 341, 342, 700])
def test_jpeg_round_trip(units):
    rng = np.random.default_rng(units)
    payloads = [rng.integers(0, 256, 576 * units, np.uint8).tobytes(), b"\xff" * 576 * units, bytes(576)]
    found = media.thumbnails(media.encode_jpegs(payloads))
    assert [b"".join(t.tobytes() for _, _, t in x) for x in found] == payloads
    assert found[0][0][0] == 192


def slow_jpeg(pixels, quality, restart):
    """A plain baseline encoder with AC terms, for tests: grey, 8 by 8 blocks, standard-like tables."""
    h, w = pixels.shape
    basis = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    zig = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))
    dc_syms, ac_syms = list(range(12)), [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    code = lambda syms: {s: (k, 8) for k, s in enumerate(syms)}
    dc, ac = code(dc_syms), code(ac_syms)
    table = lambda cls, syms: media._segment(0xC4, bytes([cls, *[0] * 7, len(syms), *[0] * 8, *syms]))
    out, bits, pred, dcs = bytearray(), "", 0, []

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            out.extend([b, 0] if b == 255 else [b])
        bits = ""

    def put(entry, value, s):
        nonlocal bits
        bits += f"{entry[0]:0{entry[1]}b}" + (f"{value if value >= 0 else value + (1 << s) - 1:0{s}b}" if s else "")

    blocks = [(y, x) for y in range(0, h, 8) for x in range(0, w, 8)]
    for n, (y, x) in enumerate(blocks):
        if restart and n and n % restart == 0:
            flush()
            out.extend([255, 0xD0 + (n // restart - 1) % 8])
            pred = 0
        q = np.round(basis @ (pixels[y : y + 8, x : x + 8].astype(float) - 128) @ basis.T / quality).astype(int)
        flat = [int(q[p]) for p in zig]
        dcs.append(flat[0])
        d, pred = flat[0] - pred, flat[0]
        put(dc[abs(d).bit_length()], d, abs(d).bit_length())
        run, last = 0, max([k for k in range(1, 64) if flat[k]], default=0)
        for v in flat[1 : last + 1]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(ac[0xF0], 0, 0)
                run -= 16
            put(ac[run << 4 | abs(v).bit_length()], v, abs(v).bit_length())
            run = 0
        if last < 63:
            put(ac[0], 0, 0)
    flush()
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([quality]) * 64) + media._segment(0xC0, bytes([8, h >> 8, h & 255, w >> 8, w & 255, 1, 1, 0x11, 0])) + table(0, dc_syms) + table(0x10, ac_syms)
    head += (media._segment(0xDD, bytes([0, restart])) if restart else b"") + media._segment(0xFE, b"a comment") + media._segment(0xDA, b"\1\1\0\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9", np.array(dcs).reshape(h // 8, w // 8)


@pytest.mark.parametrize("restart", [0, 1, 3, 7])
def test_other_jpegs(restart):
    rng = np.random.default_rng(restart)
    pixels = (rng.integers(0, 256, (40, 56)) * 0.5 + np.linspace(0, 127, 56)).astype(np.uint8)
    data, dcs = slow_jpeg(pixels, 10, restart)
    ((w, h, thumb),) = media.thumbnails([data])[0]
    assert (w, h) == (56, 40) and np.array_equal(thumb, np.clip((dcs * 10 + 4) // 8 + 128, 0, 255))
    assert np.abs(thumb.astype(int) - pixels.reshape(5, 8, 7, 8).mean((1, 3))).max() < 3


def test_broken_jpegs():
    data = media.encode_jpegs([bytes(range(256)) * 9])[0]
    with pytest.raises((ValueError, IndexError)):
        media.thumbnails([data[:-40]])
    with pytest.raises(ValueError):
        media.thumbnails([data.replace(b"\xff\xc0", b"\xff\xc2")])
    with pytest.raises(ValueError):
        media.encode_jpegs([b"short"])


def test_media_query(spark):
    rows = media.describe(media.store_texts(edge(spark))).collect()
    assert len(rows) == len(EDGE)
    want = {}
    for i, t in EDGE:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), media.crc(p[-32:]))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.describe(media.store_texts(edge(spark, []))).count() == 0
