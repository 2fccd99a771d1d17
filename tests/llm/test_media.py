"""GIF encoder and decoder: round trips, and hand-made files against their pictures."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from fieldmerge.llm import gif
from fieldmerge.llm.queries import op1_gif_media


def made(width, height, frames, palette):
    """A GIF of frames (left, top, pixels, delay, disposal, transparent, interlaced)."""
    bits = max(2, int(np.ceil(np.log2(len(palette)))))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | bits - 1, 0, 0), bytes(sum(palette, ())).ljust(3 << bits, b"\0")]
    for left, top, pixels, delay, disposal, clear, interlaced in frames:
        h, w = pixels.shape
        rows = pixels[gif._interlaced(h)] if interlaced else pixels
        stream = gif.lzw_encode(rows.astype(np.uint8).tobytes(), bits)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0), struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 * interlaced), bytes([bits])]
        for i in range(0, len(stream), 200):
            out += [bytes([len(stream[i : i + 200])]), stream[i : i + 200]]
        out.append(b"\0")
    return b"".join([*out, b";"])


@pytest.mark.parametrize("size", range(2, 9))
def test_lzw_round_trips(size):
    rnd = np.random.default_rng(size)
    for n in (0, 1, 2, 600, 9000):
        for data in (rnd.integers(0, 1 << size, n), np.zeros(n), np.arange(n) % 3 % (1 << size)):
            samples = data.astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(samples, size), size, n) == samples


def test_full_table_without_clear_code():
    """Strings stop at 4096 codes; later codes have 12 bits."""
    rnd = np.random.default_rng(1)
    codes = [256, *rnd.integers(0, 256, 6000).tolist(), 257]
    value, at = 0, 0
    for k, c in enumerate(codes):
        width = 9 if k == 0 else int(gif._widths(k, 8)[0][k - 1])
        value |= c << at
        at += width
    stream = value.to_bytes(at // 8 + 1, "little")
    assert gif.lzw_decode(stream, 8, 6000) == bytes(codes[1:-1])


def test_disposal_transparency_and_interlace():
    palette = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)]
    base = np.zeros((4, 4), int)
    patch = np.array([[1, 3], [3, 1]])
    data = made(4, 4, [(0, 0, base, 5, 1, None, True), (1, 1, patch, 7, 3, 3, False), (0, 0, np.full((1, 4), 2), 1, 2, None, False), (3, 3, np.full((1, 1), 1), 2, 0, None, False)], palette)
    seen = [(f["start_ms"], f["delay_ms"], f["canvas"].copy()) for f in gif.decode_gif(data)]
    assert [s[:2] for s in seen] == [(0, 50), (50, 70), (120, 10), (130, 20)]
    red, green, blue = palette[:3]
    assert (seen[0][2] == red).all()
    assert (seen[1][2][1, 1] == green).all() and (seen[1][2][1, 2] == red).all()
    assert (seen[2][2][0] == blue).all() and (seen[2][2][1:] == red).all()  # the patch was taken back
    assert (seen[3][2][0] == 0).all() and (seen[3][2][3, 3] == green).all()  # the blue row was cleared


def test_frames_table(spark):
    good = gif.encode_gif(gif.padded(b"abc" * 3000))
    rows = [(1, good), (2, good[:-40]), (3, b"no gif"), (4, None)]
    out = gif.gif_frames(spark.createDataFrame(rows, "doc_id long, gif binary")).orderBy("doc_id", "frame").collect()
    by = {k: [r for r in out if r["doc_id"] == k] for k in range(1, 5)}
    assert [r["start_ms"] for r in by[1]] == [0, 40, 80] and all(sum(r["histogram"]) == r["width"] * 144 for r in by[1])
    assert by[2][0]["error"] and len(by[2]) == 3
    assert by[3][0]["error"] == by[4][0]["error"] == "no GIF header"


def test_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "Ab c" * 20000, os.urandom(3000).hex(), "a"]
    spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op1_gif_media(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + b"\xff" * ((max(1, -(-len(data) // 576)) * 576) - len(data))
        r = found[i if i else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert r["media_bytes"] > 800 and int(r["feature"].split(";")[0]) == -(-len(whole) // 3456)
    assert found[2]["feature"] == found[8]["feature"] and found[2]["media_sha256"] == found[8]["media_sha256"]


def test_empty_table(spark):
    assert gif.gif_digests(gif.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
