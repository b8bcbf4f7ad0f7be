"""Media columns: bytes as baseline JPEG, and luminance thumbnails from DC terms alone.

:func:`encode_jpegs` stores each byte as one 8 by 8 block of even colour: with a quantiser of 8
the DC term is the byte less 128, which baseline JPEG keeps without loss.  Each row of blocks is
a restart interval.  :func:`thumbnails` reads any baseline JPEG (Huffman, 8 bits): it parses the
markers, decodes the scan and rebuilds one luminance sample for each block from its DC term; AC
terms are only skipped.  All restart intervals of a batch are decoded side by side in numpy.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, raw_bytes, slices

#: Blocks in a row; payloads are multiples of UNIT so that rows fill 8 equal bands.
WIDTH, UNIT = 24, 576
#: Rows of blocks in one image, a multiple of 24 below 65535 / 8; longer payloads take further images.
ROWS = 8184
#: Bytes of payload or media that are worked on at a time.
CHUNK = 1 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    dc = bytes([0, 0, 0, 0, 9] + [0] * 12) + bytes(range(9))  # nine categories of four bits each
    ac = bytes([0x10, 1] + [0] * 15) + b"\0"  # end of block: one bit
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\1\x11\0"),
        _segment(0xC4, dc),
        _segment(0xC4, ac),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference of DC terms, from -255: code of category, bits and end of block; its length."""
    code, size = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        bits = d if d >= 0 else d + (1 << s) - 1
        code[d + 255], size[d + 255] = (s << s | bits) << 1, 5 + s
    return code, size


CODE, SIZE = _codes()


def _pairs(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[:, ::2] << n[:, 1::2] | v[:, 1::2], n[:, ::2] + n[:, 1::2]


def _scans(x: np.ndarray, last: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows with their restart markers, and the end of each row in them."""
    d = np.empty(x.shape, np.int64)
    d[:, 0] = x[:, 0].astype(np.int64) - 128
    d[:, 1:] = x[:, 1:].astype(np.int64) - x[:, :-1]
    v, n = CODE[d + 255], SIZE[d + 255]
    v, n = _pairs(*_pairs(v, n))
    rows, words = len(x), 6
    out, at = np.zeros(rows * words + 1, np.uint64), np.zeros(rows, np.uint64)
    base = np.arange(rows, dtype=np.int64) * words
    for j in range(v.shape[1]):
        left = v[:, j] << (np.uint64(64) - n[:, j])
        k, off = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out[k] |= left >> off
        out[k + 1] |= np.where(off > 0, left << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        at += n[:, j]
    size = ((at + np.uint64(7)) >> np.uint64(3)).astype(np.int64)
    b = out[:-1].astype(">u8").view(np.uint8).reshape(rows, words * 8)
    b[np.arange(rows), size - 1] |= ((1 << ((-at.astype(np.int64)) & 7)) - 1).astype(np.uint8)  # padding is ones
    mask = np.arange(words * 8) < size[:, None]
    flat = b[mask]
    ff = flat == 255
    shift = np.cumsum(ff) - ff  # stuffed zeros before each byte
    ends = np.cumsum(size)
    stuffed = np.cumsum(ff)[ends - 1]
    marks = np.where(last, 0, 2)
    stop = ends + stuffed + np.cumsum(marks)
    res = np.zeros(int(stop[-1]), np.uint8)
    res[np.arange(len(flat)) + shift + np.repeat(np.cumsum(marks) - marks, size)] = flat
    inner = stop[~last]
    res[inner - 2], res[inner - 1] = 255, 0xD0 + (index[~last] & 7)
    return res.tobytes(), stop


def encode_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as one or more JPEG images end to end."""
    if not payloads:
        return []
    counts = np.array([len(p) // WIDTH for p in payloads])
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError(f"payloads are positive multiples of {UNIT} bytes")
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    start = np.cumsum(counts) - counts
    row = np.arange(len(x)) - np.repeat(start, counts)
    index = row % ROWS
    last = (index == ROWS - 1) | (row == np.repeat(counts, counts) - 1)
    data, stop = _scans(x, last, index)
    out, stops, at, pos = [], stop.tolist(), 0, 0
    for n in counts.tolist():
        parts = []
        for a in range(0, n, ROWS):
            k = min(ROWS, n - a)
            end = stops[at + k - 1]
            parts += [_header(k), data[pos:end], b"\xff\xd9"]
            at, pos = at + k, end
        out.append(b"".join(parts))
    return out


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser table
    quant: dict[int, int] = field(default_factory=dict)  # DC step of each table
    huff: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    tables: tuple = ()
    scan: tuple[int, int] = (0, 0)


def parse(data: bytes) -> list[Image]:
    """The baseline images in a byte string, one after another."""
    images, at, im = [], 0, Image()
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no JPEG marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
        elif marker == 0xD8:
            im = Image()
        elif marker == 0xD9:
            images.append(im)
        else:
            size = data[at] << 8 | data[at + 1]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quant[body[0] & 15] = body[1] << 8 | body[2] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    im.huff[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xC0:
                im.height, im.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
                im.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                im.restart = body[0] << 8 | body[1]
            elif marker == 0xDA:
                if body[0] != len(im.parts):
                    raise ValueError("one interleaved scan is expected")
                im.tables = tuple((body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
                end = at
                while True:  # the scan ends at the first marker that is neither stuffing nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                im.scan, at = (at, end), end
    return images


def _lookup(table: bytes) -> np.ndarray:
    """Length * 256 + symbol for each 16 bits ahead; length 0 marks no code."""
    out, code, k = np.zeros(65536, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _decode(scans: list[bytes], images: list[Image]) -> list[np.ndarray]:
    """DC terms of the first component of images with the same tables, sampling and restarts;
    an array of rows of blocks for each image."""
    first = images[0]
    hs, vs = max(p[1] for p in first.parts), max(p[2] for p in first.parts)
    across = np.array([-(-im.width // (8 * hs)) for im in images])
    mcus = across * np.array([-(-im.height // (8 * vs)) for im in images])
    raw = np.frombuffer(b"".join(s + b"\xff\xd0" for s in scans), np.uint8)  # each scan ends like an interval
    ff = np.flatnonzero(raw[:-1] == 255)
    kind = raw[ff + 1]
    ff, kind = ff[(kind == 0) | ((kind >= 0xD0) & (kind <= 0xD7))], kind[(kind == 0) | ((kind >= 0xD0) & (kind <= 0xD7))]
    keep = np.ones(len(raw), bool)
    keep[ff + 1] = False
    marks = ff[kind != 0]
    keep[marks] = False
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    before = np.cumsum(keep)
    stop = before[marks]  # end of each interval in the clean bytes
    begin = np.concatenate([[0], stop[:-1]])
    lanes_of = np.maximum(1, -(-mcus // first.restart)) if first.restart else np.ones(len(images), np.int64)
    if lanes_of.sum() != len(begin):
        raise ValueError("restart markers and image size disagree")
    image_of = np.repeat(np.arange(len(images)), lanes_of)
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    each = np.minimum(first.restart, mcus[image_of] - nth * first.restart) if first.restart else mcus
    w = clean.astype(np.uint32)
    ahead = w[:-3] << 24 | w[1:-2] << 16 | w[2:-1] << 8 | w[3:]
    top = len(ahead) - 1
    dc_t = [_lookup(first.huff[t[0]]) for t in first.tables]
    ac_t = [_lookup(first.huff[0x10 | t[1]]) for t in first.tables]
    pos = begin.astype(np.int64) * 8

    def peek(p: np.ndarray) -> np.ndarray:
        return ((ahead[np.minimum(p >> 3, top)] << (p & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)

    h0, v0 = first.parts[0][1:3]
    steps = int(each.max(initial=0))
    per = h0 * v0
    dcs = np.zeros((len(begin), steps * per), np.int32)
    pred = [np.zeros(len(begin), np.int64) for _ in first.parts]
    everyone = bool((each == steps).all())
    for m in range(steps):
        live = None if everyone else np.flatnonzero(each > m)
        for c, (_, h, v, _) in enumerate(first.parts):
            for k in range(h * v):
                p = pos if live is None else pos[live]
                hit = dc_t[c][peek(p)]
                p = p + (hit >> 8)
                s = (hit & 255).astype(np.int64)
                bits = peek(p) >> (16 - s)
                p = p + s
                diff = np.where(bits < (1 << s >> 1), bits - (1 << s) + 1, bits)
                if live is None:
                    pred[c] += diff
                    now = pred[c]
                else:
                    pred[c][live] += diff
                    now = pred[c][live]
                if (hit == 0).any():
                    raise ValueError("broken DC code")
                if c == 0:
                    if live is None:
                        dcs[:, m * per + k] = now
                    else:
                        dcs[live, m * per + k] = now
                hit = ac_t[c][peek(p)]  # nearly all blocks of our own images end here
                p = p + (hit >> 8) + (hit & 15)
                if (hit >> 8 == 0).any():
                    raise ValueError("broken AC code")
                sym = hit & 255
                if sym.any():
                    seen = np.where(sym == 0, 64, 1 + (sym >> 4) + 1)
                    open_ = np.flatnonzero(seen < 64)
                    while len(open_):
                        q = p[open_]
                        hit = ac_t[c][peek(q)]
                        if (hit >> 8 == 0).any():
                            raise ValueError("broken AC code")
                        sym = hit & 255
                        p[open_] = q + (hit >> 8) + (sym & 15)
                        seen[open_] = np.where(sym == 0, 64, seen[open_] + (sym >> 4) + 1)
                        open_ = open_[seen[open_] < 64]
                if live is None:
                    pos = p
                else:
                    pos[live] = p
    if (pos > (stop + 1) * 8).any():
        raise ValueError("a scan is cut off")
    out, lane = [], 0
    for i, im in enumerate(images):
        n = int(lanes_of[i])
        own = dcs[lane : lane + n].reshape(-1)[: int(mcus[i]) * per]  # only the last interval may be short
        lane += n
        a = int(across[i])
        grid = own.reshape(-1, a, v0, h0).transpose(0, 2, 1, 3).reshape(-1, a * h0)
        rows, cols = -(-im.height * v0 // (8 * vs)), -(-im.width * h0 // (8 * hs))
        out.append(grid[:rows, :cols])
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each byte string ``(width, height, samples)`` of its images, luminance 0 to 255."""
    found = [(k, im, data[im.scan[0] : im.scan[1]]) for k, data in enumerate(media) for im in parse(data)]
    out: list[list] = [[] for _ in media]
    same: dict[tuple, list[int]] = {}
    for j, (_, im, _) in enumerate(found):
        same.setdefault((tuple(p[1:3] for p in im.parts), im.tables, im.restart, tuple(sorted(im.huff.items()))), []).append(j)
    done: list[np.ndarray] = [np.zeros((0, 0))] * len(found)
    for own in same.values():
        for j, terms in zip(own, _decode([found[j][2] for j in own], [found[j][1] for j in own]), strict=True):
            step = found[j][1].quant[found[j][1].parts[0][3]]
            done[j] = np.clip((terms * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
    for (k, im, _), t in zip(found, done, strict=True):
        out[k].append((im.width, im.height, t))
    return out


def hashes(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Width, height, number of images, average hash and difference hash of the thumbnail,
    of 8 by 8 and 8 by 9 mean values; images one below the other count as one."""
    t = images[0][2] if len(images) == 1 else np.concatenate([x[2] for x in images])
    w, h = images[0][0], sum(x[1] for x in images)
    rows, cols = t.shape
    if rows % 8 == 0 and cols % 8 == 0:
        mean = t.reshape(8, rows // 8, 8, cols // 8).sum((1, 3), dtype=np.int64)
    else:
        ys, xs = (np.arange(9) * rows) // 8, (np.arange(9) * cols) // 8
        mean = np.array([[int(t[min(a, rows - 1) : max(b, a + 1), min(c, cols - 1) : max(d, c + 1)].mean() * 256) for c, d in zip(xs, xs[1:])] for a, b in zip(ys, ys[1:])])
    average = np.packbits(mean * 64 > mean.sum()).tobytes().hex()
    difference = np.packbits(mean > np.roll(mean, -1, 1)).tobytes().hex()
    return f"{w}x{h}/{len(images)}:{average}:{difference}"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the UTF-8 bytes of each text, padded, as JPEG images.

    Null counts as empty; an empty text has one unit of padding; repeated rows and equal texts
    have equal media; null ids stay null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            view, offsets = raw_bytes(b.column("text"))
            raw = [view[a:z].tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            media = encode_jpegs([padded(x) for x in raw])
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature`` from the stored images alone: the payload is the samples of their thumbnails.  A null medium gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", CHUNK):
            rows, stored = [], b.column("media").to_pylist()
            for data, images in zip(stored, thumbnails([x or b"" for x in stored]), strict=True):
                if data is None or not images:
                    rows.append((None,) * 6)
                    continue
                payload = b"".join([t.tobytes() for _, _, t in images])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), crc(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), hashes(images)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
