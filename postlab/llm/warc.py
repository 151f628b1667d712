"""Operator 8, WARC archives as seekable Zstandard bundles.

Pages are dealt to tasks by id; each task writes one ``.warc.zst`` file into the shared folder. Records are
grouped into independent frames of about ``FRAME_BYTES``; behind the last frame stands a skippable frame with
the seek table (compressed and decompressed size of each frame), so one record is read by fetching and
decompressing one frame. The map of record ids to (file, frame, offset within the frame) is returned as rows.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest page id is a response;
the others are revisits that name it and carry no payload, only its length and digest. Equal payloads
are found by SHA-1 and length: one pre-aggregated grouping, then a join of (id, digest) rows against the written
groups that have more than one record, which Spark splits where one payload holds a third of all pages.

Reading back streams frames: every frame is one row of work, its records are parsed from the bytes.

Defined results: a null html counts as empty; rows with an id equal to the group's smallest are all
responses (repeated rows stay repeated); a null id never is the smallest while others exist; an empty table
gives an empty result; other columns are ignored, whatever their names. Files are written under a private name
and moved into place, so a lost executor's task can run again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm import storage
from postlab.llm.common import shared_path, written

#: Compressed bytes of frames that a task reads back.
READ_BYTES = 64 << 20
FRAME_BYTES = 1 << 20
LEVEL = 3
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Records carry a fixed date unless the caller gives one: archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"
INDEX = ("record_id string, page_id long, record_type string, file string, frame long, frame_start long, "
         "frame_bytes long, offset long, length long")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    digest = base32_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in (url or "") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the offset behind the record that begins at ``at``."""
    head_end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head_end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record begins here")
    headers = dict(line.split(": ", 1) if ": " in line else (line.removesuffix(":"), "") for line in lines)
    begin = head_end + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, decompressed bytes) of each frame, from the file's end."""
    size = storage.size_of(uri)
    n, flags, magic = struct.unpack("<IBI", storage.get(uri, size - 9, 9))
    if magic != SEEK_MAGIC or flags:
        raise ValueError(f"{uri}: no plain seek table")
    body = storage.get(uri, size - 9 - 8 * n, 8 * n)
    out, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", body):
        out.append((at, compressed, plain))
        at += compressed
    return out


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, first_id) of the records that repeat an earlier payload, one row per page id."""
    keyed = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload_col).alias("digest"),
                         F.length(payload_col).alias("n")).filter(F.col("n") >= min_bytes)
    groups = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.filter("copies > 1").drop("copies"), "warc-groups")
    return (keyed.join(groups, ["digest", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
            .select("page_id", "digest", "n", "first_id"))


def write_bundles(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the archives into ``out_dir`` and return the index, one row per record."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    again = revisits(rows, "page_id", "payload", min_bytes).dropDuplicates(["page_id", "digest", "n"])
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    hit = (rows.page_id.eqNullSafe(again.page_id)) & (rows.digest == again.digest) & (rows.n == again.n)
    todo = rows.join(again, hit, "left").select(rows.page_id, "url", "payload", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out_dir}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        frames, index, held, held_bytes, end = [], [], [], 0, 0

        def frame() -> bytes:
            nonlocal held, held_bytes, end
            start, at = end, 0
            packed = packer.compress(b"".join(data for *_, data in held))
            for pid, kind, data in held:
                index.append((record_id(pid), pid, kind, name, len(frames), start, len(packed), at, len(data)))
                at += len(data)
            frames.append((len(packed), at))
            held, held_bytes, end = [], 0, start + len(packed)
            return packed

        def pieces() -> Iterator[bytes]:
            nonlocal held_bytes
            for batch in batches:
                for pid, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = record_bytes(pid, url, payload, first, first is not None)
                    if held and held_bytes + len(data) > frame_bytes:
                        yield frame()
                    held.append((pid, "response" if first is None else "revisit", data))
                    held_bytes += len(data)
            if held:
                yield frame()
            if frames:
                yield seek_table(frames)

        stream = pieces()
        first_piece = next(stream, None)
        if first_piece is None:
            return

        def all_pieces() -> Iterator[bytes]:
            yield first_piece
            yield from stream

        storage.put(name, all_pieces())
        types = [pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.int64()] * 5
        for i in range(0, len(index), 10_000):
            columns = zip(*index[i:i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=[x.split()[0] for x in INDEX.split(", ")])

    return todo.mapInArrow(run, INDEX)


def read_frames(frames: DataFrame) -> DataFrame:
    """Parse all records of the frames (file, frame_start, frame_bytes) and return what the archives say of each page."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, rows, at = reader.decompress(storage.get(name, start, size)), [], 0
                while at < len(data):
                    headers, block, at = parse_record(data, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (told != base32_digest(payload) or length != len(payload)):
                        raise ValueError(f"{name}: payload of {headers['WARC-Record-ID']} is damaged")
                    refers = headers.get("WARC-Refers-To")
                    rows.append((page_of(headers["WARC-Record-ID"]), length, told, headers["WARC-Type"],
                                 page_of(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=names)

    return frames.select("file", "frame_start", "frame_bytes").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, out_dir: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives, then read every frame back."""
    out_dir = out_dir or shared_path(pages.sparkSession, "warc")
    index = written(write_bundles(pages, out_dir, min_bytes=min_bytes), "warc-index")
    frames = index.filter("offset = 0")
    n, size = frames.agg(F.count(F.lit(1)), F.coalesce(F.sum("frame_bytes"), F.lit(0))).first()
    # the rows are tiny and their frames are not: tasks by the bytes they will read, and enough for every core
    tasks = max(-(-size // READ_BYTES), min(n, 4 * pages.sparkSession.sparkContext.defaultParallelism), 1)
    return read_frames(frames.repartition(int(tasks), "file", "frame_start"))


def read_one(row) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record of one index row, from its frame alone."""
    data = zstandard.ZstdDecompressor().decompress(storage.get(row["file"], row["frame_start"], row["frame_bytes"]))
    headers, block, _ = parse_record(data, row["offset"])
    return headers, block


_HEX5 = "list_transform(range(8), lambda k: CAST('0x' || substr(sha1(p), CAST(1 + 5 * k AS INT), 5) AS BIGINT))"
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first_id, {_HEX5} AS groups FROM p)
SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(groups, lambda v: substr({_ALPHABET}, CAST(1 + (v >> 15) AS INT), 1)
    || substr({_ALPHABET}, CAST(1 + ((v >> 10) & 31) AS INT), 1) || substr({_ALPHABET}, CAST(1 + ((v >> 5) & 31) AS INT), 1)
    || substr({_ALPHABET}, CAST(1 + (v & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
