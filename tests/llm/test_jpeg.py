"""The JPEG columns: exact round trips, and the reader against a bit-by-bit reader of its own."""

import hashlib
import zlib

import numpy as np
import pytest

from docloom.llm import jpeg


def _plain(data: bytes) -> np.ndarray:
    """One symbol at a time, for files of one or more components with restart intervals or without."""
    image = jpeg.Image(data)
    a, b = image.scan
    bits, at, marker = [], a, []
    while at < b:
        if data[at] == 0xFF and data[at + 1] == 0:
            bits.append(data[at])
            at += 2
        elif data[at] == 0xFF:
            marker.append(len(bits) * 8)
            at += 2
        else:
            bits.append(data[at])
            at += 1
    stream = "".join(f"{x:08b}" for x in bits)
    codes = {}
    for name, (counts, symbols) in image.huffman.items():
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                codes[name, f"{code:0{length}b}"] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
    pos = 0

    def symbol(table):
        nonlocal pos
        for length in range(1, 17):
            if (table, stream[pos : pos + length]) in codes:
                pos += length
                return codes[table, stream[pos - length : pos]]
        raise ValueError

    def value(size):
        nonlocal pos
        v = int(stream[pos : pos + size] or "0", 2)
        pos += size
        return v if not size or v >= 1 << (size - 1) else v - (1 << size) + 1

    out = np.zeros((image.across * image.down, len(image.blocks), 64), np.int64)
    last = {}
    for m in range(len(out)):
        if image.restart and m and m % image.restart == 0:
            pos, last = marker.pop(0), {}
        for i, (c, dc, ac) in enumerate(image.blocks):
            last[c] = last.get(c, 0) + value(symbol(dc))
            out[m, i, 0], k = last[c], 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[m, i, k] = value(s & 15)
                k += 1
    return out


def test_round_trip():
    rng = np.random.default_rng(1)
    payloads = [b" " * 192, bytes(192), b"\x80" * 192, b"\xff" * 384, bytes([128] * 191 + [1]), rng.integers(0, 256, 192 * 37, dtype=np.uint8).tobytes()]
    sparse = np.full(192 * 5, 128, np.uint8)
    sparse[::41] = 7
    payloads += [sparse.tobytes(), "Größe über ñ 日本語 ".encode() * 192]
    files = jpeg.write(payloads)
    for p, f, (image, c) in zip(payloads, files, jpeg.read(files), strict=True):
        assert (c.reshape(-1)[: len(p)] + 128).astype(np.uint8).tobytes() == p
        assert (_plain(f) == c).all()
        first = np.frombuffer(p, np.uint8)[::192]
        assert (jpeg.thumbnail(image, c).reshape(-1)[: len(first)] == first).all()
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_subsampled_file(restart):
    """A 4:2:0 file, its scan put together here bit by bit: DC terms are differences, luminance has four blocks an MCU."""
    code, length, head, scan, segment = jpeg.own_tables()
    head = head[: head.index(b"\xff\xdd")] + (segment(0xDD, bytes((0, restart))) if restart else b"")
    rng = np.random.default_rng(2)
    want = np.zeros((6, 6, 64), np.int64)
    want[:, :, :9] = rng.integers(-60, 61, (6, 6, 9))
    want[2, 1, 40] = 3
    parts, bits, last = [], "", [0, 0, 0]

    def put(table, symbol, value, size):
        return f"{int(code[table, symbol]):0{length[table, symbol]}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    for m in range(6):
        if restart and m and m % restart == 0:
            parts.append(bits + "1" * (-len(bits) % 8))
            bits, last = "", [0, 0, 0]
        for i in range(6):
            c = max(0, i - 3)
            d = int(want[m, i, 0]) - last[c]
            last[c] = int(want[m, i, 0])
            bits += put(0, abs(d).bit_length(), d, abs(d).bit_length())
            run = 0
            for k in range(1, 64):
                v = int(want[m, i, k])
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + put(1, 0xF0, 0, 0), run - 16
                bits += put(1, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                run = 0
            if run:
                bits += put(1, 0, 0, 0)
    parts.append(bits + "1" * (-len(bits) % 8))
    body = b""
    for i, p in enumerate(parts):
        body += (b"\xff" + bytes((0xD0 + (i - 1) % 8,)) if i else b"") + bytes(int(p[k : k + 8], 2) for k in range(0, len(p), 8)).replace(b"\xff", b"\xff\x00")
    frame = segment(0xC0, bytes((8, 0, 30, 0, 44, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))
    data = b"\xff\xd8" + head + frame + scan + body + b"\xff\xd9"
    ((image, got),) = jpeg.read([data])
    assert (got == want).all() and (_plain(data) == want).all()
    pixels = jpeg.thumbnail(image, got)
    assert pixels.shape == (4, 6) and pixels[1, 2] == np.clip(want[1, 2, 0] + 128, 0, 255)


def test_broken_files():
    good = jpeg.write([b"x" * 192])[0]
    for bad in (b"", good[2:], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.read([bad])


def test_query(spark, sf_dir):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "x" * 192), (5, "é" * 5000), (6, "abc"), (None, "abc"), (7, "€\x00\x7f" * 100_000)]
    docs = spark.createDataFrame([(*r, b"m", 5) for r in rows], "doc_id long, text string, media binary, n_bytes int")
    got = {r.doc_id: r for r in jpeg.features(jpeg.store(docs)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.width * r.height >= len(payload) // 3
    assert got[1].media_sha256 == got[6].media_sha256 == got[None].media_sha256 and got[2].media_sha256 == got[3].media_sha256
    assert jpeg.features(jpeg.store(docs.limit(0))).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in jpeg.op9_jpeg(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and ":" in r.feature


def test_average_hash():
    """Areas averaged over all their pixels, one by one."""
    rng = np.random.default_rng(4)
    for shape in ((8, 8), (26, 26), (9, 31), (1, 1), (3, 50), (7, 8)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        bits = ""
        for i in range(8):
            for j in range(8):
                rows = range(i * shape[0] // 8, max((i + 1) * shape[0] // 8, i * shape[0] // 8 + 1))
                columns = range(j * shape[1] // 8, max((j + 1) * shape[1] // 8, j * shape[1] // 8 + 1))
                area = [int(pixels[r, c]) for r in rows for c in columns]
                bits += str(int(sum(area) * pixels.size > int(pixels.astype(int).sum()) * len(area)))
        assert jpeg.average_hash(pixels) == int(bits, 2)
