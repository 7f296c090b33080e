"""Operator 9: baseline JPEG media columns.

Writing: a payload's bytes become the quantised coefficients of a baseline JPEG of three components
without subsampling (the unit that the format keeps without loss): 192 bytes make up one MCU, each byte
less 128 one coefficient. Every MCU is a restart interval.

Reading is for any baseline file: markers are parsed, the scan's Huffman codes decoded, and the
luminance DC terms put together to a thumbnail of one pixel for each 8x8 block. Restart intervals are
independent, so all those of a batch of files are decoded in step: one numpy operation advances each by
one symbol. A file without restart markers is one interval.

MCUs are laid out in a near-square; those beyond the payload are zero. The payload's length is in a
comment segment.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, text_chunks, utf8

UNIT = 192
#: Quantisation step of all coefficients but the first, and of the first: so the thumbnail's pixels are the first bytes of the MCUs.
AC_STEP, DC_STEP = 1, 8
#: Code lengths of AC symbols without a zero run, by magnitude class: text bytes less 128 are mostly of class 5. All other symbols get the longest.
AC_LENGTHS, AC_LONGEST = {5: 1, 4: 3, 7: 3, 6: 4, 3: 4, 1: 6, 2: 6, 8: 7, 9: 7, 10: 7}, 12
DC_LENGTH = 4


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Codes by length: the counts of lengths 1 to 16, the symbols in order, and each symbol's code."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, at = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s] = code
        code += 1
        counts[at - 1] += 1
    return counts, symbols, codes


@lru_cache(1)
def own_tables():
    dc = canonical({s: DC_LENGTH for s in range(12)})
    lengths = {r << 4 | s: AC_LONGEST for r in range(16) for s in range(1, 11)} | {0x00: 7, 0xF0: AC_LONGEST} | AC_LENGTHS
    ac = canonical(lengths)
    code, length = np.zeros((2, 256), np.uint64), np.zeros((2, 256), np.int64)
    for s, c in dc[2].items():
        code[0, s], length[0, s] = c, DC_LENGTH
    for s, c in ac[2].items():
        code[1, s], length[1, s] = c, lengths[s]
    segment = lambda kind, body: b"\xff" + bytes((kind,)) + struct.pack(">H", len(body) + 2) + body
    head = segment(0xDB, bytes((0, DC_STEP, *[AC_STEP] * 63)))
    head += segment(0xC4, bytes((0x00, *dc[0], *dc[1]))) + segment(0xC4, bytes((0x10, *ac[0], *ac[1])))
    head += segment(0xDD, struct.pack(">H", 1))
    scan = segment(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0)))
    return code, length, head, scan, segment


def _size(values: np.ndarray) -> np.ndarray:
    """Magnitude classes: the bit lengths of the absolute values."""
    return np.frexp(np.abs(values).astype(np.float32))[1].astype(np.int64)


def write(payloads: list[bytes]) -> list[bytes]:
    """JPEG files of payloads whose lengths are positive multiples of 192."""
    code, length, head, scan, segment = own_tables()
    used = np.array([len(p) // UNIT for p in payloads])
    wide = np.ceil(np.sqrt(used)).astype(np.int64)
    high = -(-used // wide)
    units = wide * high
    first = np.cumsum(units) - units
    values = np.zeros((int(units.sum()), UNIT), np.int16)
    real = np.arange(len(values)) - np.repeat(first, units) < np.repeat(used, units)
    values[real] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    blocks = values.reshape(-1, 64)
    n = len(blocks)

    # symbols: for each block DC, then AC with zero runs, then end of block unless the last coefficient is there
    at = np.flatnonzero(blocks[:, 1:])
    block, k = at // 63, at % 63
    new = np.ones(len(at), bool)
    new[1:] = block[1:] != block[:-1]
    before = np.concatenate(([-1], k[:-1])) if len(k) else k
    run = k - np.where(new, -1, before) - 1
    zrl = run >> 4
    per_block = np.bincount(block, minlength=n)
    extra = np.bincount(block, weights=zrl, minlength=n).astype(np.int64) if zrl.any() else np.zeros(n, np.int64)
    last = np.full(n, -1)
    last[block] = k  # the last assignment stays
    end = last < 62
    each = 1 + per_block + extra + end
    base = np.cumsum(each) - each
    total = int(each.sum())
    is_ac, symbol, value = np.ones(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    symbol[:] = 0xF0
    dc = blocks[:, 0].astype(np.int64)
    is_ac[base], symbol[base], value[base] = 0, _size(dc), dc
    rank = np.arange(len(at)) - np.repeat(np.cumsum(per_block) - per_block, per_block)
    skip = np.cumsum(zrl) - np.repeat(np.cumsum(extra) - extra, per_block) if zrl.any() else 0
    place = base[block] + 1 + rank + skip
    ac = blocks[:, 1:].reshape(-1)[at].astype(np.int64)
    symbol[place], value[place] = (run & 15) << 4 | _size(ac), ac
    symbol[(base + each - 1)[end]] = 0

    # bits: each symbol's code and the value's magnitude bits, packed from a byte boundary at each MCU
    size = np.where(is_ac == 1, symbol & 15, symbol)
    bits = (value + np.where(value < 0, (1 << size) - 1, 0)).astype(np.uint64)
    bits |= code[is_ac, symbol] << size.astype(np.uint64)
    size += length[is_ac, symbol]
    unit_start = base[::3]
    unit_bits = np.add.reduceat(size, unit_start)
    unit_bytes = -(-unit_bits // 8)
    offset = np.cumsum(size) - size
    offset += np.repeat((np.cumsum(unit_bytes) - unit_bytes) * 8 - offset[unit_start], np.add.reduceat(each, np.arange(0, n, 3)))
    word, shift = offset >> 6, 64 - (offset & 63) - size
    words = np.zeros(int(unit_bytes.sum()) // 8 + 2, np.uint64)
    inside = np.where(shift >= 0, bits << np.maximum(shift, 0).astype(np.uint64), bits >> np.maximum(-shift, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[starts]] = np.add.reduceat(inside, starts)
    over = shift < 0
    words[word[over] + 1] |= bits[over] << (64 + shift[over]).astype(np.uint64)
    stream = words.astype(">u8").view(np.uint8)[: int(unit_bytes.sum())].copy()
    stream[np.cumsum(unit_bytes) - 1] |= ((1 << (unit_bytes * 8 - unit_bits)) - 1).astype(np.uint8)

    # stuffing after each 0xFF, and a restart marker after each MCU but a file's last
    stuffed = stream == 0xFF
    markers = np.ones(len(values), np.int64)
    markers[first + units - 1] = 0
    place = np.arange(len(stream)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.cumsum(markers) - markers, unit_bytes)
    out = np.zeros(len(stream) + int(stuffed.sum()) + 2 * int(markers.sum()), np.uint8)
    out[place] = stream
    ends = place[np.cumsum(unit_bytes) - 1] + stuffed[np.cumsum(unit_bytes) - 1] + 1
    number = np.arange(len(values)) - np.repeat(first, units)
    marked = markers == 1
    out[ends[marked]] = 0xFF
    out[ends[marked] + 1] = 0xD0 + number[marked] % 8
    edges = np.concatenate(([0], ends[first + units - 1])).tolist()
    files = []
    for i in range(len(payloads)):
        frame = segment(0xC0, struct.pack(">BHHB", 8, int(high[i]) * 8, int(wide[i]) * 8, 3) + bytes((1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0)))
        note = segment(0xFE, struct.pack(">Q", len(payloads[i])))
        files.append(b"\xff\xd8" + note + head + frame + scan + out[edges[i] : edges[i + 1]].tobytes() + b"\xff\xd9")
    return files


class Image:
    """What the markers of a baseline file say, and where its scan is."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quantisers, self.huffman, self.restart, self.note = {}, {}, 0, b""
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                self.note = body
            elif kind == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= kind <= 0xCF and kind != 0xC8:
                raise ValueError("not a baseline JPEG")
            elif kind == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.scan = at, data.rindex(b"\xff\xd9")
        if len(tables) != len(self.parts):
            raise ValueError("only one interleaved scan")
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        #: For each block of an MCU: component, DC table, AC table.
        self.blocks = [(i, tables[p[0]] >> 4, 0x10 | tables[p[0]] & 15) for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        self.key = (tuple(self.blocks), tuple(sorted(self.huffman.items())))


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length and symbol; length 0 where no code begins so."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def read(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """For each baseline file its markers and its quantised coefficients: (MCUs, blocks of an MCU, 64) in zigzag order."""
    images = [Image(f) for f in files]
    groups: dict = {}
    for i, im in enumerate(images):
        groups.setdefault(im.key, []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, c in zip(members, _read_alike([files[i] for i in members], [images[i] for i in members]), strict=True):
            out[i] = images[i], c
    return out


def _read_alike(files: list[bytes], images: list[Image]) -> list[np.ndarray]:
    scans = [f[a:b] for f, im in zip(files, images, strict=True) for a, b in [im.scan]]
    raw = np.frombuffer(b"".join(scans) + bytes(8), np.uint8)
    ends_raw = np.cumsum([len(s) for s in scans])
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    restarts = marks[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(raw), bool)
    drop[marks[after == 0] + 1] = True
    drop[restarts] = drop[restarts + 1] = True
    kept = np.cumsum(~drop)
    stream = raw[~drop]
    # intervals: each file's start, and what follows each restart marker
    file_start = np.concatenate(([0], ends_raw[:-1]))
    starts_raw = np.sort(np.concatenate((file_start, restarts + 2)))
    owner = np.searchsorted(ends_raw, starts_raw, side="right")
    starts = np.where(starts_raw > 0, kept[starts_raw - 1], 0)
    units = np.array([im.across * im.down for im in images])
    first_unit = np.cumsum(units) - units
    step = np.array([im.restart or n for im, n in zip(images, units.tolist(), strict=True)])
    number = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    unit = first_unit[owner] + number * step[owner]
    todo = np.minimum(step[owner], units[owner] - number * step[owner])
    if (todo <= 0).any() or int(todo.sum()) != int(units.sum()):
        raise ValueError("restart intervals are missing")
    im = images[0]
    per_unit = len(im.blocks)
    names = sorted(im.huffman)
    lookup = np.concatenate([_lookup(*im.huffman[h]) for h in names])
    dc_base = np.array([names.index(b[1]) << 16 for b in im.blocks])
    ac_base = np.array([names.index(b[2]) << 16 for b in im.blocks])
    coefficients = np.zeros((int(units.sum()) * per_unit, 64), np.int16)
    flat = coefficients.reshape(-1)
    ahead = np.concatenate((stream, np.zeros(16, np.uint8)))
    ahead = np.ndarray(len(ahead) - 7, ">u8", ahead, strides=(1,))
    most = 1 << 15
    for a in range(0, len(starts), most):
        position = starts[a : a + most] * 8
        block = unit[a : a + most] * per_unit  # the block that each interval is at, and its last
        stop = block + todo[a : a + most] * per_unit
        k = np.zeros(len(position), np.int64)
        within = np.zeros(len(position), np.int64)
        while len(position):
            window = ahead[position >> 3].astype(np.uint64) << (position & 7).astype(np.uint64)
            entry = lookup[np.where(k == 0, dc_base[within], ac_base[within]) + (window >> np.uint64(48)).astype(np.int64)]
            length, symbol = entry >> 8, entry & 255
            if not length.all():
                raise ValueError("a code that is in no table")
            is_dc = k == 0
            size = np.where(is_dc, symbol, symbol & 15)
            run = np.where(is_dc, 0, symbol >> 4)
            magnitude = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            magnitude -= np.where(magnitude < (1 << size >> 1), (1 << size) - 1, 0)
            position = position + length + size
            k += run
            some = size > 0
            if some.all():
                flat[(block << 6) + np.minimum(k, 63)] = magnitude
            else:
                flat[((block << 6) + np.minimum(k, 63))[some]] = magnitude[some]
            k += 1
            k[~is_dc & (symbol == 0)] = 64
            done = k >= 64
            if done.any():
                k[done] = 0
                block = block + done
                within = np.where(done, (within + 1) % per_unit, within)
                live = block < stop
                if not live.all():
                    position, block, stop, k, within = position[live], block[live], stop[live], k[live], within[live]
    # DC terms are differences within a restart interval and component
    whole = coefficients.reshape(-1, per_unit, 64)
    if (todo > 1).any() or len({b[0] for b in im.blocks}) < per_unit:
        for c in {b[0] for b in im.blocks}:
            own = [i for i, b in enumerate(im.blocks) if b[0] == c]
            d = whole[:, own, 0].astype(np.int64).reshape(-1)
            sums = np.cumsum(d)
            begin = unit * len(own)
            base = np.where(begin > 0, sums[np.maximum(begin - 1, 0)], 0)
            sums -= np.repeat(base[np.argsort(unit)], todo[np.argsort(unit)] * len(own))
            whole[:, own, 0] = sums.reshape(-1, len(own))
    return [whole[s : s + n] for s, n in zip(first_unit.tolist(), units.tolist(), strict=True)]


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance by DC terms only: a pixel from 0 to 255 for each 8x8 block of the first component."""
    _, h, v, q = image.parts[0]
    dc = coefficients[:, : h * v, 0].astype(np.int64).reshape(image.down, image.across, v, h)
    pixels = dc.transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h) * image.quantisers[q][0] // 8 + 128
    rows, columns = -(-image.height * v // (8 * image.most[1])), -(-image.width * h // (8 * image.most[0]))
    return np.clip(pixels[:rows, :columns], 0, 255).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: which of 8x8 areas are brighter than the whole, each averaged over all its pixels (an area without one takes the next)."""
    down, across = (np.arange(9) * n // 8 for n in pixels.shape)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), down[:8], axis=0), across[:8], axis=1)
    counts = np.maximum(np.diff(down), 1)[:, None] * np.maximum(np.diff(across), 1)[None, :]
    return int.from_bytes(np.packbits(sums * pixels.size > int(pixels.sum(dtype=np.int64)) * counts).tobytes(), "big")


def padded(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def _write(batches):
    for df in batches:
        texts = utf8(df["text"])
        for a, b in text_chunks(texts):
            some = texts[a:b]
            yield pd.DataFrame({"doc_id": df["doc_id"].iloc[a:b], "n_bytes": [len(t) for t in some], "media": write([padded(t) for t in some])})


def _read(batches):
    for df in batches:
        files = df["media"].tolist()
        for a, b in text_chunks(files):
            rows = []
            for (image, coefficients), media in zip(read(files[a:b]), files[a:b], strict=True):
                (size,) = struct.unpack(">Q", image.note)
                payload = (coefficients.reshape(-1)[:size] + 128).astype(np.uint8).tobytes()
                bits = average_hash(thumbnail(image, coefficients))
                rows.append((image.width, image.height, f"{bits:016x}", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()))
            names = ["width", "height", "thumbnail_hash", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
            yield pd.DataFrame({"doc_id": df["doc_id"].iloc[a:b], "n_bytes": df["n_bytes"].iloc[a:b]} | dict(zip(names, zip(*rows, strict=True), strict=True)))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: each text as a JPEG file. A null or empty text is one MCU of blanks; extra columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_write, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> dimensions, thumbnail hash, and digests of the payload read back and of the file."""
    schema = "doc_id long, n_bytes long, width long, height long, thumbnail_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return stored.mapInPandas(_read, schema)


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents."""
    found = features(store(table(spark, sf_dir, "documents", "doc_id", "text")))
    return found.withColumn("feature", F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash")).drop("width", "height", "thumbnail_hash")
