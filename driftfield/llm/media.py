"""Media columns: ISO base media files written, walked and read without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import column, sliced

#: A sample is one uncompressed 8 x 8 picture of three 8-bit channels.
SIDE, CHANNELS = 8, 3
SAMPLE = SIDE * SIDE * CHANNELS
RATE = 25
#: Every so many samples, one is listed as a sync sample; so many samples make a chunk.
GROUP, CHUNK = 25, 512
#: Fixed value: the unity matrix of the format's headers (16.16, 16.16 and 2.30 fixed point).
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with spaces appended up to a positive multiple of the sample size."""
    size = max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE)
    return data + b" " * (size - len(data))


def write(payload: bytes) -> bytes:
    """An ISO base media file of one uncompressed video track with the payload's bytes as its samples."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK)] * (chunks > 1) + [(chunks, n % CHUNK)]
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1),
        bytes(32), struct.pack(">Hh", 8 * CHANNELS, -1),
    )
    sync = np.arange(1, n + 1, GROUP)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * SAMPLE)
        wide = int(offsets[-1]) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, k, 1) for at, k in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, table)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0")
        tkhd = full(
            b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), UNITY,
            struct.pack(">II", SIDE << 16, SIDE << 16), flags=7,
        )
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    header = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))  # the same at any offset below 4 GB
    head = moov(len(ftyp) + size + header)
    if len(head) != size:
        head = moov(len(ftyp) + len(head) + header)
    return ftyp + head + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, depth first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        size = size or end - start  # 0: to the end
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*path, kind), start + head, start + size
        if kind in NESTED:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


class Track:
    """The sample tables of a file's first track."""

    def __init__(self, stored: bytes):
        self.data = memoryview(stored)
        at: dict[bytes, tuple[int, int]] = {}
        for path, start, end in walk(self.data):
            at.setdefault(path[-1], (start, end))
        unpack = lambda kind, form, skip: struct.unpack_from(form, self.data, at[kind][0] + skip)
        version = self.data[at[b"mdhd"][0]]
        self.rate, self.duration = unpack(b"mdhd", ">IQ" if version else ">II", 20 if version else 12)
        self.codec = bytes(self.data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")

        def rows(kind: bytes, skip: int, count: int, form: str, width: int = 1) -> np.ndarray:
            start = at[kind][0] + skip
            found = np.frombuffer(self.data, form, count * width, start).astype(np.int64)
            return found.reshape(count, width) if width > 1 else found

        size, n = unpack(b"stsz", ">II", 4)
        if size * n > len(self.data):
            raise ValueError("the samples are larger than the file")
        self.sizes = np.full(n, size, np.int64) if size else rows(b"stsz", 12, n, ">u4")
        kind = b"co64" if b"co64" in at else b"stco"
        chunks = rows(kind, 8, unpack(kind, ">I", 4)[0], ">u8" if kind == b"co64" else ">u4")
        runs = rows(b"stsc", 8, unpack(b"stsc", ">I", 4)[0], ">u4", 3)
        until = np.append(runs[1:, 0], len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], until - runs[:, 0])
        if per_chunk.sum() != n:
            raise ValueError("the chunks do not hold the samples")
        chunk = np.repeat(np.arange(len(chunks)), per_chunk)
        before = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        first = np.cumsum(per_chunk) - per_chunk
        self.offsets = chunks[chunk] + before - before[first][chunk]
        if n and (self.offsets + self.sizes).max() > len(self.data):
            raise ValueError("samples lie beyond the file")
        self.sync = rows(b"stss", 8, unpack(b"stss", ">I", 4)[0], ">u4") - 1 if b"stss" in at else np.arange(n)

    def payload(self) -> bytes:
        """All samples' bytes. Samples that follow each other in the file are read at once."""
        if not len(self.sizes):
            return b""
        breaks = np.flatnonzero(self.offsets[1:] != (self.offsets + self.sizes)[:-1]) + 1
        starts, ends = np.append(0, breaks), np.append(breaks, len(self.sizes)) - 1
        return b"".join(self.data[self.offsets[a] : self.offsets[b] + self.sizes[b]] for a, b in zip(starts, ends, strict=True))

    def keyframes(self) -> np.ndarray:
        """(offset, size) of each sync sample in the file."""
        return np.stack([self.offsets[self.sync], self.sizes[self.sync]], axis=1)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the samples of a media file in a binary column.

    Null text is empty, and an empty one is a sample of spaces. Null ids and
    repeated rows pass through; an empty table gives no rows; other columns are
    not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [x.as_py() or b"" for x in column(batch, "raw")]
            media = pa.array([write(padded(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "encode(cast(text as string), 'UTF-8') raw")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


COLUMNS = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "codec": "string",
    "seconds": "double", "samples": "long", "keyframes": "array<struct<offset:long,size:long>>", "error": "string",
}
KEYFRAME = pa.struct([("offset", pa.int64()), ("size", pa.int64())])
ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), COLUMNS["keyframes"]: pa.list_(KEYFRAME)}


def described(data: bytes | None) -> dict:
    """What the catalogue stores of one media file; of one that can't be read, its size, its digest and the error."""
    if data is None:
        return {"error": "no media"}
    out: dict = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        track = Track(data)
        payload, keys = track.payload(), track.keyframes()
        seconds = track.duration / track.rate
    except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    return out | {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "codec": track.codec.strip(), "seconds": seconds, "samples": len(track.sizes),
        "keyframes": [{"offset": a, "size": b} for a, b in keys.tolist()],
    }


def read_back(stored: DataFrame) -> DataFrame:
    """Walk the files of a ``media`` column (with doc_id and n_bytes) and list what the catalogue stores of them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    payload's last 16 bytes), media_bytes, media_sha256, codec, seconds, samples,
    keyframes (offset and size in the file of every sync sample) and error. A row
    per input row. Null media, and media that are cut off or lack a table, have
    an error and nulls; a track without sync samples has no keyframes. Null ids
    and repeated rows pass through; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [described(x.as_py()) for x in column(batch, "media")]
            out = [pa.array([x.get(name) for x in found], ARROW[kind]) for name, kind in COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *out], ["doc_id", "n_bytes", *COLUMNS])

    return stored.mapInArrow(run, "doc_id long, n_bytes long" + "".join(f", {name} {kind}" for name, kind in COLUMNS.items()))


def query(docs: DataFrame) -> DataFrame:
    """Both passes stream row by row: nothing is shuffled, and equal texts give equal values."""
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat(k["offset"].cast("string"), F.lit("+"), k["size"].cast("string"))), ",")
    feature = F.format_string("codec=%s;seconds=%.2f;samples=%d;keyframes=%s", "codec", "seconds", "samples", ranges)
    found = read_back(encode(docs))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


#: The columns that follow from the text alone.
ORACLE = """
with d as (select doc_id, coalesce(text, '') t, octet_length(encode(coalesce(text, '')))::bigint n from documents),
p as (select *, greatest(192, (n + 191) // 192 * 192)::bigint m from d)
select doc_id, n n_bytes, m payload_bytes, sha256(t || repeat(' ', (m - n)::int)) payload_sha256 from p
"""
