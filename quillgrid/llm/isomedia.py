"""Media columns: ISO base media files as a binary column.

``store`` wraps bytes losslessly as a raw-video track: 8 x 8 RGB frames of 192
bytes, 8-bit samples, a keyframe every 16 frames, chunks of 64 frames.
``describe`` walks the nested boxes of any such file, decodes the sample tables
and gives brand, codec, time scale, duration and the byte ranges of keyframes;
sample payloads are never read.  ``payload`` reads the samples back through the
decoded tables.

All steps are map-only; a task holds one slice of a batch and the file at hand.

``digests`` returns for each text what was read back, and ``tracks``: handler,
codec, time scale, duration and the byte range of every keyframe in the stored
file.  ``feature`` sums up the same, with a checksum of the keyframes' bytes.

Defined cases: null text is the empty text, stored as one frame of blanks; a null
or malformed file gives no tracks; a file without a sync table has keyframes
only; boxes of unknown kinds are stepped over; repeated rows are described alike;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

FRAME, SIDE, CHUNK, KEY_EVERY, RATE = 192, 8, 64, 16, 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of the frame size."""
    return data + b" " * ((-len(data)) % FRAME or (0 if data else FRAME))


def wrap(data: bytes) -> bytes:
    """The file for a payload that is a whole number of frames."""
    frames = len(data) // FRAME
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat = _box(b"mdat", data)
    start = len(ftyp) + len(mdat) - len(data)
    chunks = start + np.arange(0, len(data), CHUNK * FRAME, dtype=np.int64)
    wide = len(chunks) and int(chunks[-1]) >= 1 << 32
    offsets = _full(b"co64", struct.pack(">I", len(chunks)), chunks.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u4").tobytes())
    keys = np.arange(1, frames + 1, KEY_EVERY)
    last = frames % CHUNK
    runs = [(1, CHUNK)] if frames >= CHUNK else []
    runs += [(frames // CHUNK + 1, last)] if last else []
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", c, n, 1) for c, n in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        offsets,
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIHH", 0, 0, RATE, frames, 0x10000, 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


@dataclass
class Track:
    """What the boxes of one track say; offsets and sizes of all samples, and
    which of them are keyframes."""

    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, memoryview] = field(default_factory=dict)
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray | None = None

    def _numbers(self, kind: bytes, width: int, per: int = 1, head: int = 4) -> np.ndarray:
        """The whole entries of a table that begins with their count."""
        body = self.tables[kind]
        n = struct.unpack_from(">I", body, head)[0] * per
        if n * width > len(body) - head - 4:
            raise ValueError("a table is longer than its box")
        return np.frombuffer(body, f">u{width}", n, head + 4).astype(np.int64)

    def decode(self, length: int) -> None:
        """Places of samples, from stsz, stsc and stco or co64, in a file of so many
        bytes.  What contradicts itself or the file is a ValueError, before
        anything is made that is larger than the file."""
        if not {b"stsz", b"stsc"} <= self.tables.keys():
            return
        same, n = struct.unpack_from(">II", self.tables[b"stsz"], 4)
        if same and n * same > length:
            raise ValueError("samples are longer than the file")
        size = np.full(n, same, np.int64) if same else self._numbers(b"stsz", 4, head=8)
        chunks = self._numbers(b"co64", 8) if b"co64" in self.tables else self._numbers(b"stco", 4)
        runs = self._numbers(b"stsc", 4, 3).reshape(-1, 3)
        times = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if len(runs) and runs[0, 0] != 1 or (times <= 0).any() or int((runs[:, 1] * times).sum()) != n or len(runs) == 0 and n:
            raise ValueError("chunks do not hold the samples")
        chunk = np.repeat(np.arange(len(chunks)), np.repeat(runs[:, 1], times)) if n else np.zeros(0, np.int64)
        before = np.cumsum(size) - size
        first = np.searchsorted(chunk, np.arange(len(chunks)))
        at = chunks[chunk] + before - before[first[chunk]]
        if (chunks[chunk] < 0).any() or (at + size > length).any():
            raise ValueError("samples lie outside of the file")
        if b"stss" in self.tables:
            keys = self._numbers(b"stss", 4) - 1
            if (keys < 0).any() or (keys >= n).any():
                raise ValueError("keyframes that are no samples")
            self.keys = keys
        self.at, self.size = at, size

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and size of every sample."""
        return self.at, self.size

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.at, self.size) if self.keys is None else (self.at[self.keys], self.size[self.keys])


def walk(data: memoryview):
    """(kind, parent, in_track, body) of every box, containers before what they
    hold, however deep they nest.  What does not fit into its container ends it."""
    todo = [(0, len(data), b"", False)]
    while todo:
        at, end, parent, in_track = todo.pop()
        if at + 8 > end:
            continue
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = n or end - at
        if n < head or at + n > end:
            continue
        yield kind, parent, in_track, data[at + head : at + n]
        todo.append((at + n, end, parent, in_track))
        if kind in CONTAINERS:
            todo.append((at + head, at + n, kind, in_track or kind == b"trak"))


def describe(data: bytes | None) -> tuple[str, list[Track]]:
    """Brand and tracks with their sample tables; the bodies of media data boxes
    are stepped over.  A file with a malformed box or table has no tracks."""
    brand, tracks = "", []
    try:
        for kind, parent, in_track, body in walk(memoryview(data or b"")):
            if kind == b"ftyp":
                brand = bytes(body[:4]).decode("latin-1")
            elif kind == b"trak":
                tracks.append(Track())
            elif not in_track:
                continue
            elif kind == b"mdhd":
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", body, 20) if body[0] else struct.unpack_from(">II", body, 12)
                if tracks[-1].duration >> 63:
                    raise ValueError("a duration beyond 63 bits")
            elif kind == b"hdlr":
                tracks[-1].handler = bytes(body[8:12]).decode("latin-1")
            elif kind == b"stsd":
                tracks[-1].codec = bytes(body[12:16]).decode("latin-1")
                if tracks[-1].handler == "vide":
                    tracks[-1].width, tracks[-1].height = struct.unpack_from(">HH", body, 8 + 32)
            elif parent == b"stbl":
                tracks[-1].tables[kind] = body
        for track in tracks:
            track.decode(len(data or b""))
    except (struct.error, IndexError, KeyError, ValueError):
        return brand, []
    return brand, tracks


def payload(data: bytes, track: Track) -> bytes:
    """The samples in order; adjacent ones are read as one range."""
    at, size = track.samples()
    if not at.size:
        return b""
    starts = np.flatnonzero(np.r_[True, at[1:] != (at + size)[:-1]])
    ends = np.r_[starts[1:], at.size] - 1
    return b"".join(data[at[a] : at[b] + size[b]] for a, b in zip(starts, ends))


def feature(brand: str, track: Track, data: bytes) -> str:
    """Brand, track, number and hash of the keyframes' byte ranges, and a checksum
    over the bytes in these ranges."""
    at, size = track.keyframes()
    ranges = np.stack([at, size], 1).astype(">i8").tobytes()
    crc = 0
    for a, n in zip(at.tolist(), size.tolist()):
        crc = zlib.crc32(data[a : a + n], crc)
    return f"{brand};{track.handler};{track.codec};{track.width}x{track.height};{track.duration}/{track.timescale}s;keyframes={len(at)};ranges={hashlib.sha1(ranges).hexdigest()};content={crc:08x}"


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a media file."""

    def run(batches):
        for b in batches:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([wrap(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


TRACKS = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]))
TRACKS_SQL = "array<struct<handler:string,codec:string,timescale:long,duration:long,keyframes:array<struct<offset:long,length:long>>>>"


def _told(files: list[list[Track]]) -> pa.Array:
    """The tracks of each file; ranges go from numpy to Arrow without Python's objects."""
    tracks = [t for own in files for t in own]
    ranges = [t.keyframes() for t in tracks]
    offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n, dtype=np.int64))).astype(np.int32))
    flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in ranges)])) for k in (0, 1)]
    keyframes = pa.ListArray.from_arrays(offsets([len(r[0]) for r in ranges]), pa.StructArray.from_arrays(flat, fields=list(TRACKS.value_type.field("keyframes").type.value_type)))
    columns = [pa.array([getattr(t, c) for t in tracks], k) for c, k in (("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()))]
    return pa.ListArray.from_arrays(offsets([len(own) for own in files]), pa.StructArray.from_arrays([*columns, keyframes], fields=list(TRACKS.value_type)))


def media_tracks(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``tracks`` in place of the file: codec, duration and the byte
    ranges of keyframes, for selective reads of the stored file."""
    names = [c for c in df.columns if c not in (media_col, "tracks")]

    def run(batches):
        for b in batches:
            told = _told([describe(m.as_py())[1] for m in b.column(media_col)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), told], names=[*names, "tracks"])

    kinds = "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)
    return map_arrow(df, run, f"{kinds}tracks {TRACKS_SQL}")


def digests(documents: DataFrame) -> DataFrame:
    """What is read back from the stored files; see the query's contract."""

    def run(batches):
        for b in batches:
            out, found = [], []
            for t in b.column("text"):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                data = wrap(padded(raw))
                brand, tracks = describe(data)
                back = payload(data, tracks[0])
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(brand, tracks[0], data)))
                found.append(tracks)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)), _told(found)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks {TRACKS_SQL}")
