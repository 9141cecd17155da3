"""Media columns: Matroska files in a binary column, and their packet tables.

write_pcm() stores bytes as unsigned 8-bit samples in one audio track: an EBML header, segment information, the track, clusters
of laced blocks, and cues. read() parses any Matroska bytes: variable-length ids and sizes (unknown sizes too), SimpleBlocks and
Blocks in groups, and no, Xiph, fixed and EBML lacing, into packets with track, time and byte range.

Defined results: a null text is an empty one; payloads have a positive multiple of 64 bytes; equal texts give equal bytes, for nothing
in the file depends on time or chance; null media has no packets; bytes that end within an element raise ValueError in read(), and are a row with an error in add_packets().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, landed, read_table, utf8

# Element ids of Matroska and EBML.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, CODEC, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x86, 0x23E383
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")
#: Elements that hold others, and those of them that may have an unknown size.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
OPEN_ENDED = {SEGMENT, CLUSTER}

RATE = 8000
FRAME = 512
FRAMES_IN_BLOCK = 8
BLOCKS_IN_CLUSTER = 16
PAD = 64


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def vint(value: int) -> bytes:
    """An EBML size, as short as it goes; all ones is kept for unknown sizes."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    """A difference of sizes in EBML lacing."""
    n = 1
    while not -(1 << 7 * n - 1) < value < 1 << 7 * n - 1:
        n += 1
    return (value + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(kind: int, value: float) -> bytes:
    return element(kind, struct.pack(">d", value))


def lace(frames: list[bytes], lacing: str) -> bytes:
    """The lace header of frames and the frames."""
    body = b"".join(frames)
    if lacing == "none":
        return body
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + body


def simple_block(track: int, time: int, frames: list[bytes], lacing: str) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", time, 0x80 | LACINGS.index(lacing) << 1) + lace(frames, lacing))


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file with the payload's bytes as samples."""
    step = 1000 * FRAME // RATE  # milliseconds a frame
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    audio = element(0xE1, real(0xB5, float(RATE)) + number(0x9F, 1) + number(0x6264, 8))
    entry = number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, step * 1_000_000) + audio
    info = number(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"wayfold") + element(0x5741, b"wayfold") + real(DURATION, 1000.0 * len(payload) / RATE)
    parts, cues = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, entry))], []
    at = sum(map(len, parts))
    for first in range(0, len(frames), FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER):
        blocks = []
        for start in range(first, min(first + FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER, len(frames)), FRAMES_IN_BLOCK):
            group = frames[start : start + FRAMES_IN_BLOCK]
            lacing = "none" if len(group) == 1 else "fixed" if len(group[0]) == len(group[-1]) else "ebml"
            blocks.append(simple_block(1, (start - first) * step, group, lacing))
        parts.append(element(CLUSTER, number(CLUSTER_TIME, first * step) + b"".join(blocks)))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * step) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What read() finds. Packets are (track, time in ns, offset, size, key frame, lacing); cues (time in ns, track, offset of the
    cluster in the file)."""

    codecs: dict[int, str] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, str]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration_ns: int | None = None


def _read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next offset, whether all value bits are set)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"the data ends within byte {at}'s number")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & (1 << 7 * n) - 1
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, offset, body's start, body's end) of the elements in a range."""
    while at < end:
        kind, body, _ = _read_vint(data, at, keep_marker=True)
        size, body, unknown = _read_vint(data, body)
        stop = _open_end(data, kind, body, end) if unknown else body + size
        if stop > end:
            raise ValueError(f"the element at byte {at} goes beyond its parent")
        yield kind, at, body, stop
        at = stop


def _open_end(data: bytes, kind: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: a segment with its parent, a cluster at the next child of the segment."""
    if kind not in OPEN_ENDED:
        raise ValueError(f"an element {kind:x} of unknown size")
    while kind == CLUSTER and at < end:
        child, body, _ = _read_vint(data, at, keep_marker=True)
        if child in (CLUSTER, CUES, INFO, TRACKS, SEGMENT):
            return at
        size, body, _ = _read_vint(data, body)
        at = body + size
    return end


def _laced(data: bytes, at: int, end: int, lacing: str) -> list[tuple[int, int]]:
    """(offset, size) of a block's frames."""
    if lacing == "none":
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "xiph":
        while len(sizes) < n - 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == "ebml":
        while len(sizes) < n - 1:
            value, after, _ = _read_vint(data, at)
            sizes.append(sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1) if sizes else value)
            at = after
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"a lace goes beyond its block at byte {at}")
    starts = [at + sum(sizes[:i]) for i in range(n)]
    return list(zip(starts, sizes, strict=True))


def read(data: bytes) -> Media:
    media, state = Media(), {"scale": 1_000_000, "cluster": 0, "segment": 0, "track": 0, "duration": None, "steps": {}, "cue": (0, 0)}

    def value(body: int, end: int) -> int:
        return int.from_bytes(data[body:end], "big")

    def block(body: int, end: int, simple: bool) -> None:
        track, at, _ = _read_vint(data, body)
        time, flags = struct.unpack_from(">hB", data, at)
        lacing = LACINGS[flags >> 1 & 3]
        base = (state["cluster"] + time) * state["scale"]
        for i, (offset, size) in enumerate(_laced(data, at + 3, end, lacing)):
            media.packets.append((track, base + i * state["steps"].get(track, 0), offset, size, simple and bool(flags & 0x80), lacing))

    def walk(start: int, end: int) -> None:
        for kind, offset, body, stop in elements(data, start, end):
            if kind == SEGMENT:
                state["segment"] = body
            elif kind == CLUSTER:
                media.clusters.append(offset)
            if kind in MASTERS:
                walk(body, stop)
            elif kind == TIMESTAMP_SCALE:
                state["scale"] = value(body, stop)
            elif kind == DURATION:
                state["duration"] = struct.unpack(">d" if stop - body == 8 else ">f", data[body:stop])[0]
            elif kind == TRACK_NUMBER:
                state["track"] = value(body, stop)
            elif kind == CODEC:
                media.codecs[state["track"]] = data[body:stop].decode()
            elif kind == DEFAULT_DURATION:
                state["steps"][state["track"]] = value(body, stop)
            elif kind == CLUSTER_TIME:
                state["cluster"] = value(body, stop)
            elif kind in (SIMPLE_BLOCK, BLOCK):
                block(body, stop, kind == SIMPLE_BLOCK)
            elif kind == CUE_TIME:
                state["cue"] = (value(body, stop), 0)
            elif kind == CUE_TRACK:
                state["cue"] = (state["cue"][0], value(body, stop))
            elif kind == CUE_CLUSTER:
                media.cues.append((state["cue"][0] * state["scale"], state["cue"][1], state["segment"] + value(body, stop)))

    walk(0, len(data))
    if state["duration"] is not None:
        media.duration_ns = round(state["duration"] * state["scale"])
    return media


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join(data[offset : offset + size] for _, _, offset, size, _, _ in media.packets)


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def feature(media: Media, payload: bytes) -> str:
    """Counts of the container and loudness of the samples, from what was read back."""
    laced = [sum(p[5] == kind for p in media.packets) for kind in LACINGS]
    samples = np.frombuffer(payload, np.uint8)
    sought = sum(c[2] in set(media.clusters) for c in media.cues)
    return (
        f"codec={','.join(media.codecs.values())};clusters={len(media.clusters)};cues={sought};packets={len(media.packets)};"
        f"lacing={'/'.join(map(str, laced))};ms={(media.duration_ns or 0) // 1_000_000};last_ms={media.packets[-1][1] // 1_000_000 if media.packets else 0};"
        f"sum={int(samples.sum(dtype=np.int64))};rises={int(np.count_nonzero(samples[1:] > samples[:-1]))}"
    )


def add_media(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_bytes and media: whole texts in UTF-8, padded, as Matroska files."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            raw = utf8(batch.column(text))
            return [pa.array(map(len, raw), pa.int64()), pa.array([write_pcm(padded(x)) for x in raw], pa.binary())]

        return compute

    return append_columns(docs, [text], [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], make, keep)


PACKET = "array<struct<track:bigint,time_ns:bigint,offset:bigint,size:bigint,key:boolean,lacing:string>>"


def add_packets(files: DataFrame, *, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """`files` with packets, the packet table of each file (explode it for a row a packet), and error: what is wrong with a file whose bytes end within an element or aren't elements, and which so has no
    packets; else null."""
    kind = T._parse_datatype_string(PACKET)
    arrow = pa.list_(pa.struct([("track", pa.int64()), ("time_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.bool_()), ("lacing", pa.string())]))
    names = [f.name for f in kind.elementType]

    def make():
        def one(data: bytes | None) -> tuple[list[dict], str | None]:
            try:
                return ([] if data is None else [dict(zip(names, p, strict=True)) for p in read(data).packets]), None
            except (ValueError, IndexError) as wrong:
                return [], f"{type(wrong).__name__}: {wrong}"

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [one(x) for x in batch.column(media).to_pylist()]
            return [pa.array([p for p, _ in found], arrow), pa.array([e for _, e in found], pa.string())]

        return compute

    return append_columns(files, [media], [T.StructField("packets", kind), T.StructField("error", T.StringType())], make, keep)


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: media written to a table, read back from it, and described."""
    stored = landed(add_media(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), "media")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            columns: list[list] = [[] for _ in range(6)]
            for data in batch.column("media").to_pylist():
                media = read(data)
                payload = payload_of(data, media)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]

        return compute

    fields = [T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    return append_columns(stored, ["media"], fields, make, keep=["doc_id", "n_bytes"])
