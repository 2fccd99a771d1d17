"""WARC archives: records written as gzip members, and a reader that salvages what follows damage.

Archives are kept as binary rows of a Parquet table, so Spark's own writers and readers carry them to any store;
files of another origin are read with Spark's binaryFile source (read_archives).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.llm.common import text_buffer, written

#: A payload that another record holds is left out if it has so many bytes.
LEAST_REVISIT = 0
ARCHIVE_BYTES = 4 << 20

#: Payloads that occur more than once are known to every task up to so many; more are joined.
MOST_SENT = 500_000
#: A member's name, comment or extra field, or a record's headers, of more bytes are taken for damage.
LONGEST_NAME, LONGEST_HEAD = 4096, 1 << 16

_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r?\n")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP head alone, whose Content-Length is the payload's."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = re.sub(r"[\x00-\x20\x7f]+", " ", url or "").strip() or "about:blank"
    name = re.sub("[\x85\u2028\u2029]", lambda c: quote(c[0]), name)  # other readers may take these for line ends
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>", f"WARC-Target-URI: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    body = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


def _one(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """The record whose version line is at `at`: headers (lower-case names), block and end. Raises ValueError if a check fails."""
    if not (line := _VERSION.match(data, at)):
        raise ValueError("no version line")
    blank = b"\r\n\r\n" if line[0].endswith(b"\r\n") else b"\n\n"  # headers end as the version line does
    stop = data.find(blank, line.end() - len(blank) // 2, line.end() + LONGEST_HEAD)
    if stop < 0:
        raise ValueError("headers break off")
    if _VERSION.match(data, line.end()):
        raise ValueError("no headers")
    gap = len(blank)
    headers, last = {}, None
    for row in re.split("\r?\n", data[line.end() : stop].decode("utf-8", "replace")) if stop > line.end() else []:
        if row[:1] in (" ", "\t") and last is not None:  # a folded line goes on with the one before
            headers[last] = f"{headers[last]} {row.strip()}".strip()
            continue
        name, colon, value = row.partition(":")
        if not colon:
            raise ValueError("a header has no colon")
        last = name.strip().lower()
        headers[last] = value.strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("no content length")
    first = stop + gap
    block = data[first : first + int(size)]
    if len(block) < int(size):
        raise ValueError("the block breaks off")
    stated = headers.get("warc-block-digest", "")
    if stated.lower().startswith("sha1:") and stated[5:] != payload_digest(block):
        raise ValueError("the block's digest differs")
    end = first + int(size)
    tail = re.compile(rb"(\r?\n){0,2}").match(data, end)
    if tail.end() < len(data) and not _VERSION.match(data, tail.end()) and not data.startswith(_MAGIC, tail.end()):
        raise ValueError("the record doesn't end where its length says")
    return headers, block, tail.end()


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict, bytes, str]]:
    """("record", start, end, headers, block, "") and ("gap", start, end, {}, b"", why) over the archive's bytes, in order.

    Gzip members (checked by their CRC) and plain records may be mixed. After a failed check the next offset is
    sought at which a whole member or record stands; the bytes between are one gap. A member that is whole but holds
    a bad record is a gap of its own, less the records found within it. Whole records before the damage of a
    member are given before its gap, with start and end at the member's first byte."""
    at, bad, why, line = 0, None, "", 0
    while at < len(data):
        found, end = [], at
        try:
            if data.startswith(_MAGIC, at):
                text, end = _member(data, at)
                found = list(_within(text))
            else:
                headers, block, end = _one(data, at)
                found = [("record", headers, block, "")]
        except (ValueError, zlib.error) as error:
            rest = _before_damage(data, at) if data.startswith(_MAGIC, at) and _has_head(data, at) else []
            if rest and bad is not None:
                yield "gap", bad, at, {}, b"", why
                bad = None
            if bad is None:
                bad, why = at, str(error)
            for headers, block in rest:
                yield "record", at, at, headers, block, ""
            # a version line that was found ahead is still the next one
            line = line if line > at else _line(data, at + 1)
            member = data.find(_MAGIC, at + 1, line)
            at = member if member >= 0 else line
            continue
        if bad is not None:
            yield "gap", bad, at, {}, b"", why
            bad = None
        for kind, headers, block, reason in found:
            yield kind, at, end, headers, block, reason
        at = end
    if bad is not None:
        yield "gap", bad, len(data), {}, b"", why


def _within(text: bytes) -> Iterator[tuple[str, dict, bytes, str]]:
    at = 0
    while at < len(text):
        try:
            headers, block, at = _one(text, at)
            yield "record", headers, block, ""
        except ValueError as error:
            yield "gap", {}, b"", f"within a member: {error}"
            later = _VERSION.search(text, at + 1)
            at = later.start() if later else len(text)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content and end of the gzip member at `at`; its CRC and length are checked."""
    if not _has_head(data, at):
        raise ValueError("no gzip header")
    reader, parts, end = zlib.decompressobj(31), [], at
    for piece in _pieces(data, at):
        parts.append(reader.decompress(piece))
        end += len(piece)
        if reader.eof:
            return b"".join(parts), end - len(reader.unused_data)
    raise ValueError("a gzip member breaks off")


def _before_damage(data: bytes, at: int) -> list[tuple[dict, bytes]]:
    """Headers and block of the whole records at the start of what a damaged gzip member still gives. What precedes a failed
    check needs a block digest that holds; what precedes the end of the data doesn't."""
    reader, parts, cut = zlib.decompressobj(31), [], True
    for piece in _pieces(data, at):
        before = reader.copy()
        try:
            parts.append(reader.decompress(piece))
        except zlib.error:
            cut = False
            while len(piece) > 1:  # halves, to the byte that fails
                half, state = piece[: len(piece) // 2], before.copy()
                try:
                    parts.append(state.decompress(half))
                    before, piece = state, piece[len(half) :]
                except zlib.error:
                    piece = half
            break
        if reader.eof:
            break
    found, text, place = [], b"".join(parts), 0
    while place < len(text):
        try:
            headers, block, place = _one(text, place)
        except ValueError:
            break
        if not text.startswith(b"WARC/", place) or not cut and not headers.get("warc-block-digest", "").lower().startswith("sha1:"):
            break  # the damage may reach a record that none follows
        found.append((headers, block))
    return found


def _line(data: bytes, at: int) -> int:
    """The offset of the next version line, or the end."""
    found = _VERSION.search(data, at)
    return found.start() if found else len(data)


def _has_head(data: bytes, at: int) -> bool:
    """Whether a gzip header may stand at `at`: known flags, and its name and comment end soon."""
    flags = data[at + 3] if at + 3 < len(data) else 0xFF
    place = at + 10
    if flags & 4:
        extra = int.from_bytes(data[place : place + 2], "little")
        place = place + 2 + extra if extra <= LONGEST_NAME else -1
    for bit in (8, 16):
        if flags & bit and place >= 0:
            place = data.find(b"\0", place, place + LONGEST_NAME) + 1 or -1
    return not flags & 0xE0 and 0 <= place <= len(data)


def _pieces(data: bytes, at: int) -> Iterator[bytes]:
    """The bytes from `at` on, a few first: most of what isn't a member fails on these."""
    end = min(at + 2048, len(data))
    while at < end:
        yield data[at:end]
        at, end = end, min(end + 65536, len(data))


def write_archives(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(archive, data): the pages (page_id long, url, html) as WARC archives of about ARCHIVE_BYTES, a written table.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least least_revisit bytes the one with
    the smallest page_id is stored and the others refer to it; rows that share that page_id as well are all stored.
    A null page_id counts as larger than any; where a payload has no other, its rows are all stored. An empty table
    gives no archives. Equal payloads meet as hashes only, summed per task first. The payloads that occur more than once
    are sent to every task, after a count, so no html is shuffled; beyond MOST_SENT of them they are joined, as Spark can
    split."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("hash"))
    counted = rows.where(F.octet_length("html") >= least_revisit).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(counted.where("n > 1 and first is not null").select("hash", "first"), "payloads")
    if first.count() <= MOST_SENT:
        first = F.broadcast(first)
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = rows.join(first, "hash", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def pack(batches):
        held, size, first = [], 0, None

        def whole():
            data = b"".join(held)  # equal names only where all bytes are equal
            name = f"pages-{first}-{hashlib.sha1(data).hexdigest()[:16]}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "data"])

        for b in batches:
            data, at = text_buffer(b.column(2))
            for i, (number, url, to) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                payload = data[at[i] : at[i + 1]].tobytes()
                first = number if not held else first
                held.append(record(number, url, payload, payload_digest(payload), to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    return written(joined.mapInArrow(pack, "archive string, data binary"), "warc")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of WARC files, plain or gzip, at a path of any store that Spark reads; a file is read whole (below 2 GB)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def salvaged(archives: DataFrame) -> DataFrame:
    """What each archive (archive, data) holds, in order of byte offsets: kind (record or gap), start, end, reason of a gap,
    headers (lower-case names) and block of a record. Bytes that aren't in a record are in a gap; null data gives no rows."""
    names = ["archive", "kind", "start", "end", "reason", "headers", "block"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()], strict=True)))

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                held, size = [], 0
                for kind, start, end, headers, block, why in salvage(data or b""):
                    held.append(dict(zip(names, (name, kind, start, end, why, list(headers.items()), block), strict=True)))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("archive", "data").mapInArrow(read, "archive string, kind string, start long, end long, reason string, headers map<string,string>, block binary")


def gaps(archives: DataFrame) -> DataFrame:
    """The log of quarantined bytes: archive, start, end, n_bytes, reason."""
    return salvaged(archives).where("kind = 'gap'").select("archive", "start", "end", (F.col("end") - F.col("start")).alias("n_bytes"), "reason")


def pages_read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of the records that write_archives wrote."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def number(urn):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def page(headers, block):
        head, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "revisit":
            length = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
            size = int(length[1]) if length else None
        else:
            size, digest = len(payload), payload_digest(payload)
        return dict(zip(fields.names, (number(headers.get("warc-record-id")), size, digest, kind, number(headers.get("warc-refers-to")), headers.get("warc-target-uri")), strict=True))

    def read(batches):
        for b in batches:
            found = [page(dict(h), x) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(found, fields)

    return salvaged(archives).where("kind = 'record'").select("headers", "block").mapInArrow(read, schema)
