"""ISO media containers (boxes of size, type, payload): write, walk, and index them without decoding samples.

A payload is laid down as 192-byte samples of codec `raw ` (unsigned 8 bits, one channel); every 64th sample is a sync sample. Reading works on
any bytes: nested boxes are walked with bounds checks, the sample tables (stsd, mdhd, stts, stsc, stsz, stco/co64, stss) are decoded, and
byte ranges follow from them. Broken or foreign bytes give an index with `error` set, never an exception.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches

UNIT = 192
KEY_EVERY = 64
TIMESCALE = 8000

# Fixed values of the format: boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}
# The unity matrix of mvhd and tkhd.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A container with one track whose samples, in order, are the payload's units. No times of day: equal payloads, equal bytes."""
    n = len(payload) // UNIT
    wide = len(payload) >= 1 << 31
    duration = n * UNIT
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(first: int) -> bytes:
        keys = range(1, n + 1, KEY_EVERY)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64", struct.pack(">IQ", 1, first)) if wide else full(b"stco", struct.pack(">II", 1, first)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    runs: list[tuple[int, int]] = field(default_factory=list)  # stsc: first chunk, samples a chunk
    sizes: tuple[int, ...] = ()
    unit: int = 0  # stsz's common size
    count: int = 0
    chunks: tuple[int, ...] = ()
    syncs: tuple[int, ...] | None = None
    times: list[tuple[int, int]] = field(default_factory=list)

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Offset and size of each sample."""
        sample, run = 0, -1
        for k, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.runs) and self.runs[run + 1][0] <= k:
                run += 1
            for _ in range(self.runs[run][1] if run >= 0 else 0):
                if sample >= self.count:
                    return
                size = self.unit or self.sizes[sample]
                yield at, size
                at += size
                sample += 1

    def keyframes(self) -> list[tuple[int, int]]:
        """Offset and size of each sync sample; without stss, of all."""
        if self.syncs is None:
            return list(self.ranges())
        keys = set(self.syncs)
        return [r for i, r in enumerate(self.ranges(), 1) if i in keys]


@dataclass
class Index:
    boxes: int = 0
    depth: int = 0
    tracks: list[Track] = field(default_factory=list)
    error: str | None = None


def _table(data: memoryview, at: int, end: int, code: str, width: int, count: int) -> tuple[int, ...]:
    if count * width * struct.calcsize(f">{code}") > end - at:
        raise ValueError("a table is longer than its box")
    return struct.unpack_from(f">{count * width}{code}", data, at)


def _leaf(kind: bytes, data: memoryview, at: int, end: int, t: Track) -> None:
    u32 = lambda p: struct.unpack_from(">I", data, p)[0]
    if kind == b"mdhd":
        wide = data[at] == 1
        t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    elif kind == b"hdlr":
        t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd" and u32(at + 4):
        t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind == b"stts":
        v = _table(data, at + 8, end, "I", 2, u32(at + 4))
        t.times = list(zip(v[::2], v[1::2], strict=True))
    elif kind == b"stsc":
        v = _table(data, at + 8, end, "I", 3, u32(at + 4))
        t.runs = list(zip(v[::3], v[1::3], strict=True))
    elif kind == b"stsz":
        t.unit, t.count = u32(at + 4), u32(at + 8)
        t.sizes = () if t.unit else _table(data, at + 12, end, "I", 1, t.count)
    elif kind in (b"stco", b"co64"):
        t.chunks = _table(data, at + 8, end, "I" if kind == b"stco" else "Q", 1, u32(at + 4))
    elif kind == b"stss":
        t.syncs = _table(data, at + 8, end, "I", 1, u32(at + 4))


def walk(blob: bytes) -> Index:
    """Walk all boxes of a container; sample payloads are skipped, not read."""
    data, out = memoryview(blob), Index()

    def inside(at: int, end: int, depth: int, track: Track | None) -> None:
        out.depth = max(out.depth, depth)
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                raise ValueError(f"box {kind!r} at {at} leaves its parent")
            out.boxes += 1
            if kind in NESTED and depth < 16:
                own = track
                if kind == b"trak":
                    out.tracks.append(own := Track())
                inside(at + head, at + size, depth + 1, own)
            elif track is not None:
                _leaf(kind, data, at + head, at + size, track)
            at += size

    try:
        inside(0, len(data), 1, None)
    except (ValueError, struct.error, IndexError) as e:
        out.error = str(e)
    return out


def demux(blob: bytes, index: Index) -> bytes:
    """The samples of the first track, joined."""
    return b"".join(blob[at : at + size] for at, size in index.tracks[0].ranges()) if index.tracks else b""


MUX_SCHEMA = "n_bytes long, media binary"
INDEX_SCHEMA = "boxes int, codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>, error string"


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One container per row: id, n_bytes (unpadded), media. Null texts count as empty; other columns are dropped."""
    short_batches(docs.sparkSession)

    def op(batches):
        for b in batches:
            raw = [x.encode() if isinstance(x, str) else b"" for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n_bytes": [len(x) for x in raw], "media": [mux(pad(x)) for x in raw]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(src, op, MUX_SCHEMA).withColumnRenamed("id", id_col)


def index_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The first track's index per row: codec, duration, keyframe byte ranges. Null bytes give an index with error `empty`."""
    short_batches(media.sparkSession)

    def op(batches):
        for b in batches:
            rows = []
            for blob in b["media"]:
                i = walk(blob or b"")
                t = i.tracks[0] if i.tracks else Track()
                rows.append((i.boxes, t.codec, t.handler, t.timescale, t.duration, t.count, [{"offset": o, "size": s} for o, s in t.keyframes()], i.error if blob else "empty"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ("boxes", "codec", "handler", "timescale", "duration", "n_samples", "keyframes", "error")])
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    src = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return map_rows(src, op, INDEX_SCHEMA).withColumnRenamed("id", id_col)


def feature(index: Index) -> str:
    """codec/handler, duration, samples, keyframes, first and last keyframe, and a digest of all keyframe ranges."""
    t = index.tracks[0] if index.tracks else Track()
    keys = t.keyframes()
    ranges = ",".join(f"{o}+{s}" for o, s in keys)
    ends = f"{keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]}" if keys else "-"
    return f"{t.codec}/{t.handler};{t.duration}/{t.timescale};n={t.count};keys={len(keys)};{ends};{hashlib.sha256(ranges.encode()).hexdigest()[:16]}"


DIGEST_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text as a container, read the stored bytes back, and return digests of both. One pass, no shuffle.

    Null and empty texts store one unit of spaces. Repeated rows and ids give a row each; a null id stays null.
    """
    short_batches(docs.sparkSession)
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]

    def op(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                raw = text.encode() if isinstance(text, str) else b""
                blob = mux(pad(raw))
                index = walk(blob)
                back = demux(blob, index)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(index)))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(src, op, DIGEST_SCHEMA).withColumnRenamed("id", id_col)
