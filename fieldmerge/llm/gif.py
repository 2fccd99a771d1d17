"""Media columns: GIF files as binary columns, written, decoded to timed frames and summed up.

The decoder reads LZW code streams of any code size, local and global palettes, interlaced rows,
transparency and the disposal methods; each frame is the composed picture over its own time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmerge.llm.common import text_buffer

#: A payload is stored in rows of TILE_WIDTH samples, FRAME_ROWS of them a frame; a tile of 24 x 24 has 576 samples.
TILE_WIDTH, TILE_BYTES, FRAME_ROWS, DELAY_CS = 24, 576, 144, 4
#: Colours are counted in 4 x 4 x 4 bins.
BINS = 64

_BITS = np.arange(12, dtype=np.uint16)

_BIN_OF_RED, _BIN_OF_GREEN, _BIN_OF_BLUE = (((np.arange(256) >> 6) * step).astype(np.int64) for step in (16, 4, 1))

#: Sample v is shown as (v, 37 v mod 256, 255 - v); red alone gives the sample back.
SAMPLE_PALETTE = np.stack([np.arange(256), np.arange(256) * 37 % 256, 255 - np.arange(256)], 1).astype(np.uint8)


class GifError(ValueError):
    """The file breaks off or is no GIF."""


@lru_cache(maxsize=64)
def _schedule(count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    added = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    width = np.clip(np.floor(np.log2(added)).astype(np.int64) + 1, size + 1, 12)
    return width, np.concatenate(([0], np.cumsum(width)))


def _widths(count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, and of all before it: the reader has added k - 1 strings when it reads it."""
    width, before = _schedule(1 << max(13, count.bit_length()), size)
    return width[:count], before[: count + 1]


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The LZW code stream of samples below 2**size."""
    clear, limit = 1 << size, 4096 - (1 << size) - 2
    runs: list[list[int]] = []
    for first in range(0, len(samples), limit):  # so many samples can't overfill the table, so none has to be checked
        codes: list[int] = []
        emit, known, free = codes.append, {}.setdefault, clear + 2
        rest = iter(samples[first : first + limit])
        held = next(rest)
        for b in rest:
            code = known(held << 8 | b, free)
            if code == free:
                emit(held)
                free += 1
                held = b
            else:
                held = code
        emit(held)
        runs.append(codes)
    runs = runs or [[]]
    value = np.array([clear, *chain.from_iterable((*run, clear) for run in runs)], np.uint16)
    value[-1] = clear + 1
    width = np.concatenate([_widths(1, size)[0], *(_widths(len(run) + 1, size)[0] for run in runs)])
    bits = value[:, None] >> _BITS & 1
    return np.packbits(bits.astype(bool)[_BITS < width[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, bases: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of codes and how many each gives; bases: for each code, where its run between two clear codes begins.

    The string added after code j is what code j and the first sample of code j + 1 gave, so it stands in the output
    from where code j began: each code repeats earlier output, and following those places ends at single samples."""
    n = len(codes)
    single = codes < clear
    up = np.where(single, np.arange(n), codes - (clear + 2) + bases)
    origin, length = up, (~single).astype(np.int64)
    while (more := length[up]).any():
        length = length + more
        up = up[up]
    length += 1
    start = np.cumsum(length) - length
    place = np.arange(int(length.sum())) + np.repeat(start[origin] - start, length)
    while not np.array_equal(further := place[place], place):
        place = further
    literal = np.zeros(len(place), np.uint8)
    literal[start[single]] = codes[single]
    return literal[place], length


def _codes(data: np.ndarray, at: int, total: int, size: int, wanted: int) -> list[np.ndarray]:
    """The codes between clear codes of the stream in bits [at, total); data: three bytes from each byte on. Ends early
    where a code can't stand in its place or `wanted` samples are sure."""
    clear, runs, sure = 1 << size, [], 0
    while at < total and sure < wanted:
        count = min(4200, (total - at) // (size + 1))
        while True:
            width, before = _widths(count, size)
            count = int(np.searchsorted(before, total - at, "right")) - 1
            if count <= 0:
                return runs
            width, start = width[:count], at + before[:count]
            value = data[start >> 3] >> (start & 7) & (1 << width) - 1
            ends = np.flatnonzero((value & -2) == clear)
            if len(ends) or start[-1] + 2 * width[-1] > total:
                break
            count *= 4
        stop = int(ends[0]) if len(ends) else count
        codes = value[:stop]
        wrong = np.flatnonzero(codes - (clear + 2) >= np.arange(stop))
        runs.append(codes[: wrong[0]] if len(wrong) else codes)
        sure += stop
        if len(wrong) or not len(ends) or value[stop] == clear + 1:
            break
        at = int(start[stop] + width[stop])
    return runs


def lzw_decode_all(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """The samples of LZW code streams (stream, code size, samples wanted at most), worked on together; a stream that
    breaks off gives those before the break."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(streams)
    for size in {s for _, s, _ in streams}:
        own = [i for i, x in enumerate(streams) if x[1] == size]
        data = np.frombuffer(b"".join(streams[i][0] for i in own) + b"\0\0\0\0", np.uint8)
        data = data[:-2] | data[1:-1].astype(np.int64) << 8 | data[2:].astype(np.int64) << 16
        runs, share, at = [], [], 0
        for i in own:
            end = at + 8 * len(streams[i][0])
            got = _codes(data, at, end, size, streams[i][2])
            runs += got
            share.append(sum(map(len, got)))
            at = end
        codes = np.concatenate([*runs, np.zeros(0, np.int64)])
        lengths = np.array([len(x) for x in runs], np.int64)
        samples, sizes = _expand(codes, np.repeat(np.cumsum(lengths) - lengths, lengths), 1 << size)
        edges = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(share)))]
        for k, i in enumerate(own):
            out[i] = samples[edges[k] : edges[k + 1]][: streams[i][2]]
    return out


def lzw_decode(stream: bytes, size: int, wanted: int) -> bytes:
    """The samples of one LZW code stream."""
    return lzw_decode_all([(stream, size, wanted)])[0].tobytes()


def encode_gif(payload: bytes, width: int = TILE_WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames hold the payload, one byte a sample; its length is a positive multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill rows")
    height = min(rows, len(payload) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), SAMPLE_PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for first in range(0, len(payload), width * height):
        samples = payload[first : first + width * height]
        parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(samples) // width, 0), b"\x08"]
        stream = lzw_encode(samples)
        for i in range(0, len(stream), 255):
            parts += [bytes([len(stream[i : i + 255])]), stream[i : i + 255]]
        parts.append(b"\0")
    return b"".join([*parts, b";"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block breaks off")
        n = data[at]
        at += 1
        if n == 0:
            return b"".join(parts), at
        if at + n > len(data):
            raise GifError("a block breaks off")
        parts.append(data[at : at + n])
        at += n


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _parsed(data: bytes) -> tuple[int, int, list[dict], str | None]:
    """Width, height, the frames' headers with their code streams, and why the file breaks off, if it does."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return 0, 0, [], "no GIF header"
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared, found = 13, None, []
    control: dict = {"disposal": 0, "delay_ms": 0, "clear_index": None}
    try:
        if flags & 0x80:
            shared, at = _palette(data, at, flags)
        while True:
            kind = data[at]
            if kind == 0x3B:
                return width, height, found, None
            if kind == 0x21:
                label = data[at + 1]
                block, at = _sub_blocks(data, at + 2)
                if label == 0xF9 and len(block) >= 4:
                    control = {"disposal": block[0] >> 2 & 7, "delay_ms": 10 * (block[1] | block[2] << 8), "clear_index": block[3] if block[0] & 1 else None}
            elif kind == 0x2C:
                left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
                palette, at = _palette(data, at + 10, local) if local & 0x80 else (shared, at + 10)
                size = data[at]
                if palette is None or not 2 <= size <= 8:
                    raise GifError("a frame has no palette or no code size")
                stream, at = _sub_blocks(data, at + 1)
                found.append(control | {"left": left, "top": top, "w": w, "h": h, "interlaced": bool(local & 0x40), "palette": palette, "size": size, "stream": stream})
                control = {"disposal": 0, "delay_ms": 0, "clear_index": None}
            else:
                raise GifError(f"unknown block {kind}")
    except GifError as why:
        return width, height, found, str(why)
    except (IndexError, struct.error):
        return width, height, found, "the file breaks off"


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3), at + 3 * n


def _composed(width: int, height: int, headers: list[dict], pixels: list[np.ndarray], why: str | None) -> Iterator[dict]:
    canvas = np.zeros((height, width, 3), np.uint8)
    start_ms = 0
    for number, (f, samples) in enumerate(zip(headers, pixels, strict=True)):
        w, h = f["w"], f["h"]
        if len(samples) < w * h:
            raise GifError("a code stream breaks off")
        index = samples.reshape(h, w)
        if f["interlaced"]:
            rows = np.empty_like(index)
            rows[_interlaced(h)] = index
            index = rows
        y, x = min(h, max(0, height - f["top"])), min(w, max(0, width - f["left"]))
        region = canvas[f["top"] : f["top"] + y, f["left"] : f["left"] + x]
        index = index[:y, :x]
        kept = canvas.copy() if f["disposal"] == 3 else None
        colours = np.take(f["palette"], index, axis=0, mode="clip")
        region[...] = colours if f["clear_index"] is None else np.where((index == f["clear_index"])[..., None], region, colours)
        yield {"frame": number, "start_ms": start_ms, "delay_ms": f["delay_ms"], "left": f["left"], "top": f["top"], "width": x, "height": y, "disposal": f["disposal"], "canvas": canvas, "region": region}
        start_ms += f["delay_ms"]
        if f["disposal"] == 2:
            region[...] = 0
        elif f["disposal"] == 3:
            canvas = kept
    if why:
        raise GifError(why)


def decode_gifs(files: list[bytes]) -> list[Iterator[dict]]:
    """For each file its frames in order: the composed RGB picture (canvas, to be copied if kept), place and time. The
    code streams of all files are decoded together. Raises GifError where a file breaks off, after its whole frames."""
    parsed = [_parsed(x) for x in files]
    streams = [(f["stream"], f["size"], f["w"] * f["h"]) for p in parsed for f in p[2]]
    samples, at, out = lzw_decode_all(streams), 0, []
    for width, height, headers, why in parsed:
        out.append(_composed(width, height, headers, samples[at : at + len(headers)], why))
        at += len(headers)
    return out


def decode_gif(data: bytes) -> Iterator[dict]:
    """The frames of one file."""
    return decode_gifs([data])[0]


def colour_histogram(picture: np.ndarray) -> np.ndarray:
    """Pixels in each of the BINS colour bins."""
    return np.bincount(_BIN_OF_RED[picture[..., 0]].ravel() + _BIN_OF_GREEN[picture[..., 1]].ravel() + _BIN_OF_BLUE[picture[..., 2]].ravel(), minlength=BINS)


def padded(text: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of TILE_BYTES."""
    return text + b"\xff" * (max(1, -(-len(text) // TILE_BYTES)) * TILE_BYTES - len(text))


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, gif): each whole text (null: empty) as the samples of a GIF. Other columns are left out."""

    def store(batches):
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            for i in range(0, batch.num_rows, 500):
                rows = range(i, min(i + 500, batch.num_rows))
                gifs = [encode_gif(padded(data[at[r] : at[r + 1]].tobytes())) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array(np.diff(at)[i : i + len(rows)]), pa.array(gifs, pa.binary())], ["key", "n_bytes", "gif"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(store, f"key {kind}, n_bytes long, gif binary").withColumnRenamed("key", key)


def gif_frames(media: DataFrame, key: str = "doc_id", gif: str = "gif") -> DataFrame:
    """One row for each frame: key, frame, start_ms, delay_ms, left, top, width, height, disposal, rgb (composed, rows
    from the top), histogram (64 counts) and error. A file that breaks off (or is null or no GIF) gives a last row
    with null fields and the error."""
    names = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal"]

    def rows(key_, data):
        try:
            for f in decode_gif(data or b""):
                yield {"key": key_, "rgb": f["canvas"].tobytes(), "histogram": colour_histogram(f["canvas"]).tolist(), "error": None} | {n: int(f[n]) for n in names}
        except GifError as why:
            yield {"key": key_, "rgb": None, "histogram": None, "error": str(why)} | dict.fromkeys(names)

    def frames(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.schema.field(0).type)

    def _batches(found, kind):
        schema = pa.schema([("key", kind), *((n, pa.int32()) for n in names), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int32())), ("error", pa.string())])
        held, size = [], 0
        for row in found:
            held.append(row)
            size += len(row["rgb"] or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    kind = media.schema[key].dataType.simpleString()
    columns = f"key {kind}, " + ", ".join(f"{n} int" for n in names) + ", rgb binary, histogram array<int>, error string"
    return media.select(media[key].alias("key"), media[gif].alias("gif")).mapInArrow(frames, columns).withColumnRenamed("key", key)


def gif_digests(media: DataFrame, key: str = "doc_id", gif: str = "gif", n_bytes: str = "n_bytes") -> DataFrame:
    """Decode each stored GIF, read the payload back from the red samples of its frames and sum the frames up.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (frames; milliseconds; counts of the colour bins that occur over all frames), n_frames, duration_ms."""

    def digest(data, frames):
        regions, n, ms = [], 0, 0
        for f in frames:
            regions.append(f["region"].copy())
            n, ms = n + 1, f["start_ms"] + f["delay_ms"]
        picture = np.concatenate(regions)
        whole, bins = picture[..., 0].tobytes(), colour_histogram(picture)
        feature = f"{n};{ms};" + ",".join(f"{i}:{c}" for i, c in enumerate(bins.tolist()) if c)
        return len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, n, ms

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]

    def digests(batches):
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 200):
                files = batch.column(2).slice(i, 200).to_pylist()
                found += [digest(*x) for x in zip(files, decode_gifs(files), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "n_bytes", *names])

    kind = media.schema[key].dataType.simpleString()
    columns = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"
    return media.select(media[key].alias("key"), media[n_bytes].alias("n_bytes"), media[gif].alias("gif")).mapInArrow(digests, columns).withColumnRenamed("key", key)
