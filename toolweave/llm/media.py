"""Media columns: ISO base media containers read box by box.

``read_media`` walks the nested boxes of a file, decodes each track's sample
tables and, in fragmented files, the runs of its fragments, and reports codec,
duration and the byte ranges of key frames; sample bytes are never interpreted.
``wrap_payload`` is the matching writer: it stores a byte string losslessly as
one track of raw 8 x 8 frames of 8-bit samples.

Defined cases: a null or broken container gives a row with null values and a
message in ``error``; so does one whose boxes nest deeper than ``DEPTH`` or whose
tables claim more samples than the file has bytes, before memory is taken for
them; a file without tracks has an empty list; an empty payload is stored as one
frame of zero bytes; equal payloads give equal files, rows that repeat equal
results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches, texts_of

# Fixed values of the file format: box types that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf", b"mfra"}

#: Levels of nested boxes that are followed; real files have about eight.
DEPTH = 64
FRAME = 64  # bytes of an 8 x 8 frame of 8-bit samples
FRAMES_PER_CHUNK = 16
FRAMES_PER_KEY = 8
TIMESCALE = 25


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad_payload(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % FRAME or (0 if data else FRAME))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")


def wrap_payload(payload: bytes) -> bytes:
    """A container whose single video track holds ``payload``; its length is a positive multiple of 64."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    keys = np.arange(1, frames + 1, FRAMES_PER_KEY, dtype=">u4").tobytes()
    runs = [(1, FRAMES_PER_CHUNK)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last))
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH", 1, 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    large = len(payload) >= 1 << 31

    def moov(start: int) -> bytes:
        at = start + np.arange(chunks, dtype="u8") * (FRAME * FRAMES_PER_CHUNK)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys) // 4), keys),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", first, n, 1) for first, n in runs]),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if large else b"stco", struct.pack(">I", chunks), at.astype(">u8" if large else ">u4").tobytes()),
        )
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"payload\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIII", 0, 0, TIMESCALE, frames, 0x10000), b"\1\0", bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return b"".join((_FTYP, moov(len(_FTYP) + len(moov(0)) + head), box(b"mdat", payload)))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, body start, body end) of the boxes of one level."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box {kind!r} at {start} is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a wrong size")
        yield kind, start, start + head, start + size
        start += size
    if start != end:
        raise ValueError(f"{end - start} stray bytes at {start}")


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def seconds(self) -> float | None:
        return self.duration / self.timescale if self.timescale else None


def _numbers(data: bytes, at: int, end: int, count: int, kind: str, per: int = 1) -> np.ndarray:
    if at + count * per * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, count * per, at).astype(np.int64).reshape(-1, per)


class Room:
    """How many samples a file can still hold: each has a byte at least, and those of all its tracks lie in it."""

    def __init__(self, data: bytes):
        self.left = len(data)

    def take(self, count: int) -> int:
        self.left -= count
        if self.left < 0:
            raise ValueError("more samples than bytes in the file")
        return count


def _sample_tables(data: bytes, track: Track, room: Room) -> None:
    """Sizes, offsets and key numbers of a track's samples from its tables."""
    t = track.tables
    if b"stsd" in t and t[b"stsd"][0] + 16 <= t[b"stsd"][1]:
        track.codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
    if b"stsz" in t:
        at, end = t[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, at + 4)
        track.sizes = np.full(room.take(count), fixed, np.int64) if fixed else _numbers(data, at + 12, end, count, ">u4")[:, 0]
    elif b"stz2" in t:
        at, end = t[b"stz2"]
        bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            pairs = _numbers(data, at + 12, end, (count + 1) // 2, "u1")[:, 0]
            track.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:count]
        else:
            track.sizes = _numbers(data, at + 12, end, count, {8: "u1", 16: ">u2"}[bits])[:, 0]
    count = len(track.sizes)
    table, kind = (b"co64", ">u8") if b"co64" in t else (b"stco", ">u4")
    if table in t and b"stsc" in t and count:
        at, end = t[table]
        chunk_at = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], kind)[:, 0]
        at, end = t[b"stsc"]
        runs = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4", 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunk_at))))
        if len(per_chunk) != len(chunk_at) or per_chunk.sum() != count:
            raise ValueError("sample tables disagree on the number of samples")
        chunk = np.repeat(np.arange(len(chunk_at)), per_chunk)
        before = np.cumsum(track.sizes) - track.sizes
        first = np.cumsum(per_chunk) - per_chunk
        track.offsets = chunk_at[chunk] + before - before[np.minimum(first, count - 1)][chunk]
    if b"stss" in t:
        at, end = t[b"stss"]
        track.keys = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4")[:, 0] - 1
        if len(track.keys) and not (track.keys.min() >= 0 and track.keys.max() < count):
            raise ValueError("a key frame's number is out of range")
    else:
        track.keys = np.arange(count)
    if b"stts" in t and not track.duration:
        at, end = t[b"stts"]
        runs = _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4", 2)
        track.duration = int((runs[:, 0] * runs[:, 1]).sum())


@dataclass
class Fragment:
    """A track's part of a fragment: where its data start and what holds for samples without values of their own."""

    track: Track
    base: int
    time: int = 0
    duration: int = 0
    size: int = 0
    flags: int = 0


# Fixed values of the file format: bits that say which fields follow, and the bit of a sample that is no key frame.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
DATA_OFFSET, FIRST_FLAGS, EACH_DURATION, EACH_SIZE, EACH_FLAGS, EACH_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEY = 0x10000


def _fragment_head(data: bytes, at: int, moof: int, follows: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> Fragment:
    """A ``tfhd`` box: without an offset of its own data start at the ``moof`` or follow the fragment before."""
    flags, number = struct.unpack_from(">II", data, at)
    if number not in tracks:
        raise ValueError(f"a fragment names track {number}, which is not there")
    out, at = Fragment(tracks[number], moof if flags & BASE_IS_MOOF else follows), at + 8
    out.duration, out.size, out.flags = defaults.get(number, (0, 0, 0))
    if flags & BASE_OFFSET:
        (out.base,) = struct.unpack_from(">Q", data, at)
        at += 8
    at += 4 * bool(flags & DESCRIPTION)
    for bit, name in ((DURATION, "duration"), (SIZE, "size"), (FLAGS, "flags")):
        if flags & bit:
            setattr(out, name, struct.unpack_from(">I", data, at)[0])
            at += 4
    return out


def _fragment_run(data: bytes, at: int, end: int, of: Fragment, follows: int, room: Room) -> int:
    """A ``trun`` box: its samples join their track's; returns where their data end."""
    flags, count = struct.unpack_from(">II", data, at)
    at, start = at + 8, follows
    if flags & DATA_OFFSET:
        start = of.base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & FIRST_FLAGS:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    room.take(count)
    own = [bit for bit in (EACH_DURATION, EACH_SIZE, EACH_FLAGS, EACH_SHIFT) if flags & bit]
    table = _numbers(data, at, end, count, ">u4", len(own)) if own else np.zeros((count, 0), np.int64)
    each = lambda bit, default: table[:, own.index(bit)] if bit in own else np.full(count, default, np.int64)
    size, kind = each(EACH_SIZE, of.size), each(EACH_FLAGS, of.flags).copy()
    if count and first is not None:
        kind[0] = first
    ends = start + np.cumsum(size)
    of.track.runs.append((ends - size, size, kind & NO_KEY == 0))
    of.time += int(each(EACH_DURATION, of.duration).sum())
    of.track.duration = max(of.track.duration, of.time)
    return int(ends[-1]) if count else start


def read_media(data: bytes) -> list[Track]:
    """The tracks of a container; ``ValueError`` where its boxes don't fit together."""
    tracks: list[Track] = []
    numbered: dict[int, Track] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[bytes, int, int, int]] = []  # boxes of fragments, read after all tables
    levels = [(boxes(data), -1)]
    try:
        while levels:
            level, moof = levels[-1]
            if (found := next(level, None)) is None:
                levels.pop()
                continue
            kind, start, a, b = found
            if kind == b"trak":
                tracks.append(Track())
            if kind in CONTAINERS:
                if len(levels) > DEPTH:
                    raise ValueError(f"boxes nest deeper than {DEPTH}")
                if kind == b"moof":
                    moof = start
                    fragments.append((kind, a, b, moof))
                levels.append((boxes(data, a, b), moof))
            elif kind in (b"tfhd", b"tfdt", b"trun"):
                fragments.append((kind, a, b, moof))
            elif kind == b"trex":
                number, _, duration, size, flags = struct.unpack_from(">IIIII", data, a + 4)
                defaults[number] = duration, size, flags
            elif kind == b"mdhd" and tracks:
                wide = data[a] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"hdlr" and tracks:
                tracks[-1].handler = data[a + 8 : a + 12].decode("latin-1")
            elif kind == b"tkhd" and tracks:
                numbered[struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]] = tracks[-1]
                tracks[-1].width, tracks[-1].height = (x >> 16 for x in struct.unpack_from(">II", data, b - 8))
            elif tracks:
                tracks[-1].tables[kind] = a, b
        room = Room(data)
        for track in tracks:
            _sample_tables(data, track, room)
        own, follows = None, 0
        for kind, a, b, moof in fragments:
            if kind == b"moof":
                own, follows = None, moof
            elif kind == b"tfhd":
                own = _fragment_head(data, a, moof, follows, numbered, defaults)
                follows = own.base
            elif own is None:
                raise ValueError(f"box {kind!r} at {a} without a track")
            elif kind == b"tfdt":
                (own.time,) = struct.unpack_from(">Q" if data[a] == 1 else ">I", data, a + 4)
            else:
                follows = _fragment_run(data, a, b, own, follows, room)
        for track in tracks:
            if track.runs:
                offsets, sizes, keys = (np.concatenate(x) for x in zip(*track.runs, strict=True))
                track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(keys)])
                track.offsets, track.sizes = np.concatenate([track.offsets, offsets]), np.concatenate([track.sizes, sizes])
            if len(track.offsets) and (track.offsets.min() < 0 or (track.offsets + track.sizes).max() > len(data)):
                raise ValueError("a sample lies outside the file")
    except (struct.error, IndexError, KeyError, OverflowError) as e:
        raise ValueError(f"a box is cut off: {e}") from e
    return tracks


def sample_bytes(data: bytes, track: Track) -> bytes:
    """All samples in order, copied by the tables' ranges; adjacent ranges are copied as one."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist(), strict=True))


TRACK_FIELDS = "handler:string,codec:string,seconds:double,width:int,height:int,n_samples:bigint,key_offset:array<bigint>,key_length:array<bigint>"


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row of ``df``: the id, ``tracks`` (array of structs as TRACK_FIELDS, with key frame byte ranges) and ``error``."""
    kind = df.schema[id_col].dataType.simpleString()
    track_type = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("key_offset", pa.list_(pa.int64())), ("key_length", pa.list_(pa.int64()))]))

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    found.append([{"handler": t.handler, "codec": t.codec, "seconds": t.seconds, "width": t.width, "height": t.height, "n_samples": len(t.sizes), "key_offset": t.offsets[t.keys].tolist() if len(t.offsets) else [], "key_length": t.sizes[t.keys].tolist()} for t in read_media(data)])
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, track_type), pa.array(errors, pa.string())], ["id", "tracks", "error"])

        return work

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")), start, f"id {kind}, tracks array<struct<{TRACK_FIELDS}>>, error string")
    return out.withColumnRenamed("id", id_col)


def wrap_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``media``, the container that stores the text's padded UTF-8 bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = [wrap_payload(pad_payload(t.encode("utf-8", "surrogatepass"))) for t in texts_of(batch, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["id", "media"])

        return work

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def track_feature(track: Track) -> str:
    """Codec, frame size, seconds, samples, and number, first, last and checksum of key frame ranges."""
    at, size = track.offsets[track.keys], track.sizes[track.keys]
    ranges = np.stack([at, size], 1).astype("<i8")
    ends = f"{at[0]}+{size[0]};{at[-1]}+{size[-1]}" if len(at) else ";"
    return f"{track.handler};{track.codec.strip()};{track.width}x{track.height};{track.seconds:.3f}s;{len(track.sizes)};{len(at)};{ends};{zlib.crc32(ranges.tobytes()):08x}"


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text in a container, read the stored bytes back by their tables, and digest both.

    Writing and reading run in one pass over a row, so that the stored form never leaves the task.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = ["id", *[f.split()[0] for f in fields.split(", ")]]

    def start():
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def one(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            media = wrap_payload(pad_payload(raw))
            (track,) = read_media(media)
            back = sample_bytes(media, track)
            return len(raw), len(back), sha(back), zlib.crc32(back[-FRAME:]), len(media), sha(media), track_feature(track)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*map(one, texts_of(batch, 1)), strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(rows, types, strict=True)]], names)

        return work

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
