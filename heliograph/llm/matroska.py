"""Media columns in Matroska: a writer, an EBML reader, and packet tables.

The reader takes any file built from EBML elements: it walks variable-length ids and sizes
(unknown sizes included), segments, tracks, cues, clusters, block groups and simple blocks,
and undoes all four lacings. Its packet table has a row per frame: track, timestamp, byte
range in the file. The writer stores a byte payload as 8-bit PCM samples, in laced blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from heliograph.llm.common import arrow_map, batch, table

EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, TRACK, CUES, CUE, CUE_TRACKS, CLUSTER, GROUP = (0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0xAE, 0x1C53BB6B, 0xBB, 0xB7, 0x1F43B675, 0xA0)
TIMESTAMP, SIMPLE_BLOCK, BLOCK, SCALE, DURATION, CUE_TIME, CUE_TRACK, CUE_POSITION = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0x4489, 0xB3, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING_FLAG = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
#: The levels of the elements that hold others or begin a part of the file (tags, chapters and attachments last).
LEVELS = {EBML: 0, SEGMENT: 0, SEEK_HEAD: 1, INFO: 1, TRACKS: 1, CUES: 1, CLUSTER: 1, TRACK: 2, CUE: 2, GROUP: 2, CUE_TRACKS: 3, AUDIO: 3, 0x1254C367: 1, 0x1043A770: 1, 0x1941A469: 1}
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, CUES, CUE, CUE_TRACKS, CLUSTER, GROUP, AUDIO}
HERTZ, FRAME, LACED, PER_CLUSTER = 8_000, 512, 8, 16


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    key: bool
    lacing: int
    cluster: int


class Media(NamedTuple):
    scale: int
    duration: float
    codec: dict
    cues: list
    packets: list


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size; all ones in a width mean an unknown size and so are not used for a number."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, data: bytes) -> bytes:
    return _id(i) + vint(len(data)) + data


def _uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> bytes:
    """Frames with EBML lacing: the first size, then signed differences; the last one's size is what remains."""
    out, before = [bytes([len(frames) - 1]), vint(len(frames[0]))], len(frames[0])
    for f in frames[1:-1]:
        d = len(f) - before
        width = next(w for w in range(1, 9) if -(1 << 7 * w - 1) < d < 1 << 7 * w - 1)
        out.append(vint(d + (1 << 7 * width - 1) - 1, width))
        before = len(f)
    return b"".join(out + frames)


def mux(payload: bytes) -> bytes:
    """The payload as one mono track of unsigned 8-bit samples at 8 kHz."""
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)) + element(0x4D80, b"heliograph") + element(0x5741, b"heliograph"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    step = FRAME * LACED
    for c in range(0, len(payload), step * PER_CLUSTER):
        start = c * 1000 // HERTZ
        body = [_uint(TIMESTAMP, start)]
        for b in range(c, min(len(payload), c + step * PER_CLUSTER), step):
            frames = [payload[x : min(x + FRAME, b + step)] for x in range(b, min(len(payload), b + step), FRAME)]
            flags = 0x80 | (0x06 if len(frames) > 1 else 0)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // HERTZ - start, flags) + (_laced(frames) if len(frames) > 1 else frames[0])))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE, _uint(CUE_TIME, start) + element(CUE_TRACKS, _uint(CUE_TRACK, 1) + _uint(CUE_POSITION, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, b"".join([info, tracks, *clusters, element(CUES, b"".join(cues))]))


def _number(data, at: int, end: int, keep_marker: bool = False) -> tuple[int, int] | None:
    """A variable-length number: its value (-1: unknown size) and its width. None where there is none before ``end``."""
    if at >= end or not data[at]:
        return None
    width = 9 - data[at].bit_length()
    if at + width > end:
        return None
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, data start, end) of each element, masters before what they hold.

    A master of unknown size ends where an element of its own or a higher level begins. What
    can't be read, as in a damaged file, is passed over to the end of the master that holds it; a cut
    file ends early. No input raises an error.
    """
    inside = [(end, -1, False)]
    while inside:
        stop, level, unknown = inside[-1]
        if at >= stop:
            inside.pop()
            continue
        name = _number(data, at, stop, True)
        size = _number(data, at + name[1], stop) if name else None
        if size is None or (size[0] < 0 and name[0] not in MASTERS):
            at = stop
            continue
        if unknown and LEVELS.get(name[0], 9) <= level:
            inside.pop()
            continue
        begin = at + name[1] + size[1]
        last = stop if size[0] < 0 else min(stop, begin + size[0])
        yield name[0], at, begin, last
        at = last
        if name[0] in MASTERS:
            inside.append((last, LEVELS[name[0]], size[0] < 0))
            at = begin


def _sizes(data, at: int, end: int, lacing: int) -> tuple[list[int], int] | None:
    """The sizes of a block's frames and where the first one begins. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML. None if they don't fit."""
    if not lacing:
        return [end - at], at
    if at >= end:
        return None
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        return ([(end - at) // n] * n, at) if (end - at) % n == 0 else None
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            size, more = 0, 255
            while more == 255:
                if at >= end:
                    return None
                size, more, at = size + data[at], data[at], at + 1
        else:
            found = _number(data, at, end)
            if found is None:
                return None
            v, w = found
            # in a difference all ones are a number
            v, at = (1 << 7 * w) - 1 if v < 0 else v, at + w
            size = v if not k else sizes[-1] + v - ((1 << 7 * w - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    return (sizes, at) if min(sizes) >= 0 else None


def demux(data: bytes) -> Media:
    """What can be read of a file; blocks whose frames don't fit are left out."""
    scale, duration, codec, cues, packets = 1_000_000, 0.0, {}, [], []
    track, cluster_time, cluster, cue = 0, 0, -1, [0, 0, 0]
    uint = lambda a, b: int.from_bytes(data[a : min(b, a + 8)], "big")
    for i, at, a, b in elements(data, 0, len(data)):
        if i == SCALE:
            scale = uint(a, b)
        elif i == DURATION:
            duration = struct.unpack({8: ">d", 4: ">f"}[b - a], data[a:b])[0] if b - a in (4, 8) else 0.0
        elif i == TRACK_NUMBER:
            track = uint(a, b)
        elif i == CODEC:
            codec[track] = bytes(data[a:b]).decode("utf-8", "replace")
        elif i == CLUSTER:
            cluster, cluster_time = at, 0
        elif i == TIMESTAMP:
            cluster_time = uint(a, b)
        elif i == CUE_TIME:
            cue = [uint(a, b), 0, 0]
        elif i == CUE_TRACK:
            cue[1] = uint(a, b)
        elif i == CUE_POSITION:
            cues.append((cue[0], cue[1], uint(a, b)))
        elif i in (SIMPLE_BLOCK, BLOCK):
            number = _number(data, a, b)
            head = a + number[1] if number else b
            if number is None or number[0] < 0 or head + 3 > b:
                continue
            ahead, flags = struct.unpack(">hB", data[head : head + 3])
            lacing = (flags >> 1) & 3
            found = _sizes(data, head + 3, b, lacing)
            if found is None:
                continue
            sizes, start = found
            for size in sizes:
                packets.append(Packet(number[0], cluster_time + ahead, start, size, bool(flags & 0x80), lacing, cluster))
                start += size
    return Media(scale, duration, codec, cues, packets)


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


PACKETS = pa.schema([("id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp_ms", pa.float64()), ("byte_offset", pa.int64()), ("byte_size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster_offset", pa.int64()), ("cued", pa.bool_())])


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per frame of each Matroska file in a binary column; null or empty files have no rows.

    Of a damaged or cut file come the frames that can still be read; it never fails the job. Repeated
    rows give repeated packets, null ids stay null, other columns are ignored.
    """

    def run(it):
        for b in it:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data:
                    m = demux(data)
                    cued = {t for t, _, _ in m.cues}
                    rows += [(i, k, p.track, float(p.timestamp) * m.scale / 1e6, p.offset, p.size, p.key, p.lacing, p.cluster, p.timestamp in cued) for k, p in enumerate(m.packets)]
            yield batch(PACKETS, [list(c) for c in zip(*rows)] if rows else [[] for _ in PACKETS])

    return arrow_map(df.select(df[id_col].cast("long"), media_col), run, "id long, packet int, track int, timestamp_ms double, byte_offset long, byte_size long, keyframe boolean, lacing int, cluster_offset long, cued boolean")


def feature_of(samples: bytes, media: Media) -> str:
    """Level, crossings of the middle and the packets' layout, from what was read back."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    cross = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"codec={media.codec.get(1, '')};ms={media.duration:.3f};packets={len(media.packets)};cues={len(media.cues)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={cross};peak={int(np.abs(x).max())}"


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64()), ("n_cues", pa.int64())])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a Matroska file, reads it back through the packet table and describes it.

    Null and empty texts are 64 zero bytes; rows stay rows (repeated ones too); other columns are ignored.
    """

    def run(it):
        for b in it:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, raw = padded(text)
                data = mux(raw)
                m = demux(data)
                back = payload(data, m)
                rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(back, m), len(m.packets), len(m.cues)))
            yield batch(FEATURES, [list(c) for c in zip(*rows)] if rows else [[] for _ in FEATURES])

    return arrow_map(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
