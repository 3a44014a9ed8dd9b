import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa

from sojourn.llm import jpeg, media

SCHEMA = "doc_id long, text string, media string, n_bytes string"


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        if n:
            self.s += format(value, f"0{n}b")

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def sized(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def picture(rnd, width, height, parts, restart, dq):
    """A scalar encoder of random coefficients; returns the file and the DC values of luminance."""
    dc_bits, dc_values = [0, 0, 0, 12] + [0] * 12, list(range(12))
    ac_bits, ac_values = [0] * 7 + [162] + [0] * 8, [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    dc = {s: (c, n) for s, c, n in jpeg.canonical(dc_bits, dc_values)}
    ac = {s: (c, n) for s, c, n in jpeg.canonical(ac_bits, ac_values)}
    hm, vm = max(p[0] for p in parts), max(p[1] for p in parts)
    one = len(parts) == 1
    across, down = (-(-width // 8), -(-height // 8)) if one else (-(-width // (8 * hm)), -(-height // (8 * vm)))
    h0, v0 = (1, 1) if one else parts[0]
    plane = np.zeros((down * v0, across * h0), int)
    body, bits, pred = b"", Bits(), [0] * len(parts)
    for m in range(across * down):
        if restart and m and m % restart == 0:
            body, bits, pred = body + bits.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), Bits(), [0] * len(parts)
        for c, (h, v) in enumerate(parts):
            for j in range(1 if one else v):
                for i in range(1 if one else h):
                    value = rnd.randint(-120, 120)
                    if c == 0:
                        plane[m // across * v0 + j, m % across * h0 + i] = value
                    n, extra = sized(value - pred[c])
                    pred[c] = value
                    bits.put(*dc[n])
                    bits.put(extra, n)
                    k = 1
                    while k < 64 and rnd.random() < 0.7:
                        run = rnd.choice([0, 1, 5, 15, 20])
                        while run > 15 and k + 16 < 64:
                            bits.put(*ac[0xF0])
                            run, k = run - 16, k + 16
                        run = min(run, 63 - k, 15)
                        n, extra = sized(rnd.choice([-300, -1, 1, 7, 900]))
                        bits.put(*ac[run << 4 | n])
                        bits.put(extra, n)
                        k += run + 1
                    if k < 64:
                        bits.put(*ac[0])
    body += bits.bytes()
    part = lambda mark, x: struct.pack(">BBH", 0xFF, mark, len(x) + 2) + x
    n = len(parts)
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes([0, dq] + [3] * 63)) + part(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    head += part(0xC4, bytes([0, *dc_bits, *dc_values])) + part(0xC4, bytes([0x10, *ac_bits, *ac_values])) + (part(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += part(0xDA, bytes([n, *(x for i in range(n) for x in (i + 1, 0)), 0, 63, 0]))
    rows, cols = -(-(-(-height * parts[0][1] // vm)) // 8), -(-(-(-width * parts[0][0] // hm)) // 8)
    want = np.clip(np.floor((plane[:rows, :cols] * dq + 4) / 8).astype(int) + 128, 0, 255)
    return head + body + b"\xff\xd9", want


def test_thumbnails_of_general_images():
    rnd = random.Random(3)
    kinds = [(40, 33, [(1, 1)], 0, 8), (50, 30, [(2, 2), (1, 1), (1, 1)], 0, 5), (64, 64, [(2, 1), (1, 1), (1, 1)], 3, 9), (17, 90, [(1, 1), (1, 1), (1, 1)], 2, 16), (9, 9, [(2, 2)], 1, 4)]
    made = [picture(rnd, *k) for k in kinds for _ in range(3)]
    for got, (_, want) in zip(jpeg.thumbnails([m for m, _ in made]), made, strict=True):
        assert len(got) == 1 and (got[0] == want).all()


def test_what_is_no_baseline_jpeg_is_none():
    good = picture(random.Random(1), 16, 16, [(1, 1)], 0, 8)[0]
    bad = [None, b"", b"x", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xd9", good.replace(b"\xff\xc4", b"\xff\xe4")]
    got = jpeg.thumbnails([*bad, good])
    assert got[:-1] == [None] * len(bad) and got[-1] is not None


def test_long_payload_goes_on_in_further_images():
    data = np.random.default_rng(0).integers(0, 256, jpeg.ROW * (jpeg.MOST_ROWS + 3), np.uint8)
    (one,) = jpeg.encode(data, np.array([0, len(data)]))
    (thumbs,) = jpeg.thumbnails([one])
    assert len(thumbs) == 2 and b"".join(t.tobytes() for t in thumbs) == data.tobytes()


def test_documents(spark):
    rnd = random.Random(2)
    texts = [None, "", "a", "x" * 192, "x" * 193, "é€\U0001f600" * 5000, " " * 191, "a", bytes(range(128)).decode() * 7, *("".join(rnd.choice("ab \nüz") for _ in range(rnd.randint(0, 2000))) for _ in range(40))]
    df = spark.createDataFrame([(i if i != 7 else None, t, "m", "n") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in media.store_and_read(df).collect()}
    stored = {r.doc_id: r for r in media.store(df).collect()}
    assert {r.doc_id: r for r in media.read(media.store(df)).collect()} == got
    for i, t in enumerate(texts):
        r, raw = got[i if i != 7 else None], (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        kept = bytes(stored[r.doc_id].media)
        assert (r.media_bytes, r.media_sha256) == (len(kept), hashlib.sha256(kept).hexdigest())
        assert r.feature.startswith(f"1536x{len(payload) // 24}:")
    assert got[None].feature == got[2].feature
    assert media.store_and_read(df.limit(0)).collect() == []


def test_read_of_other_media():
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([None, 2]), pa.array([b"no", None], pa.binary())], schema=media.STORED)
    first, second = media.read_media(batch).to_pylist()
    assert first["media_bytes"] == 2 and first["feature"] is None and second["media_bytes"] is None
