"""Media columns: Matroska files written and parsed as packet tables.

The parser walks EBML elements (variable-length ids and sizes, unknown sizes too),
and gives a row for each frame: cluster, block, lacing, track, timestamp and byte
range in the file, and the cue points with the clusters that they name.  Frames of
Xiph, EBML and fixed-size lacing are told apart, and follow their block's timestamp
by the track's default duration (none: all have the block's).

``store`` writes bytes as a track of 8-bit PCM samples (A_PCM/INT/LIT, 8 kHz, mono):
frames of 512 samples, up to eight to a laced block, eight blocks to a cluster, and
a cue point for each cluster.

Defined cases: a null text is empty; the payload of an empty one is 64 zero bytes;
a medium that is null has no packets; one that is cut off or no Matroska gives one
row with its error; a file is held by one task while it is parsed, a long text's included;
repeated rows give repeated results, and equal texts, ids tied or not, equal files; an
empty table gives no rows; extra columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the public Matroska/EBML specifications: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, TRACK_UID, FLAG_LACING, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x73C5, 0x9C, 0x23E383
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, EBML}
#: Elements that end a cluster or a segment of unknown size.
TOP_LEVEL = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME, FRAMES, BLOCKS, RATE = 512, 8, 8, 8000


def vint(value: int, length: int = 0) -> bytes:
    """A size as an EBML variable-length integer."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, uint(0x4286, 1), uint(0x42F7, 1), uint(0x42F2, 4), uint(0x42F3, 8), element(DOC_TYPE, b"matroska"), uint(0x4287, 4), uint(0x4285, 2))
DESCRIPTION = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000), element(0x4D80, b"concord"), element(0x5741, b"concord")) + element(
    TRACKS,
    element(TRACK_ENTRY, uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1), uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE), element(CODEC_ID, b"A_PCM/INT/LIT"), element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), uint(CHANNELS, 1), uint(BIT_DEPTH, 8))),
)


def laced_block(frames: list, timestamp: int, lacing: str) -> bytes:
    """A SimpleBlock of track 1 with its frames."""
    kind = LACINGS.index(lacing)
    head = b"\x81" + struct.pack(">hB", timestamp, 0x80 | kind << 1)
    if lacing != "none":
        head += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if lacing == "xiph":
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == "ebml":
            head += vint(sizes[0])
            for a, b in zip(sizes, sizes[1:-1]):
                length = next(n for n in range(1, 9) if abs(b - a) < 1 << 7 * n - 1)
                head += vint(b - a + (1 << 7 * length - 1) - 1, length)
    return element(SIMPLE_BLOCK, head, *frames)


def store(payload: bytes) -> bytes:
    """``payload`` as a Matroska file."""
    view, clusters, cues, at = memoryview(payload), [], [], len(DESCRIPTION)
    span = FRAME * FRAMES
    for first in range(0, len(view), span * BLOCKS):
        start = first * 1000 // RATE
        blocks = []
        for k in range(first, min(first + span * BLOCKS, len(view)), span):
            frames = [view[i : i + FRAME] for i in range(k, min(k + span, len(view)), FRAME)]
            lacing = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml"
            blocks.append(laced_block(frames, k * 1000 // RATE - start, lacing))
        clusters.append(element(CLUSTER, uint(CLUSTER_TIMESTAMP, start), *blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start), element(CUE_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return HEAD + element(SEGMENT, DESCRIPTION, *clusters, element(CUES, *cues))


@dataclass
class Media:
    """What a file holds: tracks {number: (type, codec)}, packets, cues (time ns, track, cluster offset), doc type."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, tuple[int, str]] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def read_vint(data, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """(value, next offset, whether all bits are ones) of the integer at ``at``."""
    first = data[at]
    length = 9 - first.bit_length()
    if not first or at + length > len(data):
        raise ValueError(f"no EBML integer at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    bits = value & ((1 << 7 * length) - 1)
    return (value if keep_marker else bits), at + length, bits == (1 << 7 * length) - 1


def block_frames(data, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, lacing, [(offset, size)]) of a block's body."""
    track, at, _ = read_vint(data, at, False)
    if at + 3 > end:
        raise ValueError(f"a block at byte {at} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = LACINGS[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, lacing, [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == "xiph":
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == "ebml":
        for k in range(count - 1):
            begin = at
            n, at, _ = read_vint(data, at, False)
            sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * (at - begin) - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"the laced sizes of a block pass its end at byte {end}")
    frames = []
    for n in sizes:
        frames.append((at, n))
        at += n
    return track, relative, flags, lacing, frames


def parse(data) -> Media:
    """Tracks, packets and cues of a Matroska file."""
    data = memoryview(data).cast("B")
    out, state = Media(), {"cluster": -1, "time": 0, "segment": 0, "block": 0}
    track: dict = {}
    durations: dict[int, int] = {}
    cue: dict = {}
    raw_packets: list[tuple] = []
    stack: list[tuple[int, int, bool]] = []  # (id, end, of unknown size)
    at = 0
    while at < len(data):
        while stack and not stack[-1][2] and at >= stack[-1][1]:
            stack.pop()
        start = at
        ident, at, _ = read_vint(data, at, True)
        size, at, unknown = read_vint(data, at, False)
        while stack and stack[-1][2] and ident in TOP_LEVEL and (stack[-1][0] == CLUSTER or ident in (SEGMENT, EBML)):
            stack.pop()
        end = stack[-1][1] if unknown and stack else len(data) if unknown else at + size
        if end > len(data):
            raise ValueError(f"element {ident:#x} at byte {start} passes the file's end")
        if ident in MASTERS:
            stack.append((ident, end, unknown))
            if ident == SEGMENT:
                state["segment"] = at
            elif ident == CLUSTER:
                state["cluster"], state["time"] = start, 0
                out.clusters.append(start)
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident in (CUE_POINT, CUE_POSITIONS):
                cue = {} if ident == CUE_POINT else {"time": cue.get("time", 0)}
            continue
        if unknown:
            raise ValueError(f"element {ident:#x} at byte {start} has no size")
        if ident in (SIMPLE_BLOCK, BLOCK):
            number, relative, flags, lacing, frames = block_frames(data, at, end)
            for k, (offset, n) in enumerate(frames):
                raw_packets.append((state["cluster"], state["block"], k, number, state["time"] + relative, lacing, bool(flags & 0x80) if ident == SIMPLE_BLOCK else None, offset, n))
            state["block"] += 1
        elif ident in (DOC_TYPE, CODEC_ID):
            text = bytes(data[at:end]).rstrip(b"\0").decode("utf-8", "replace")
            if ident == DOC_TYPE:
                out.doc_type = text
            else:
                track["codec"] = text
        elif ident in (TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CLUSTER_TIMESTAMP, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            value = int.from_bytes(data[at:end], "big")
            if ident == TIMESTAMP_SCALE:
                out.scale = value
            elif ident == CLUSTER_TIMESTAMP:
                state["time"] = value
            elif ident == CUE_TIME:
                cue["time"] = value
            elif ident == CUE_TRACK:
                cue["track"] = value
            elif ident == CUE_CLUSTER:
                out.cues.append((cue.get("time", 0), cue.get("track", 0), state["segment"] + value))
            else:
                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration"}[ident]] = value
        at = end
        if track.get("number") is not None:
            out.tracks[track["number"]] = (track.get("type", 0), track.get("codec", ""))
            durations[track["number"]] = track.get("duration", 0)
    if not out.doc_type:
        raise ValueError("no EBML header")
    out.packets = [(c, b, k, t, time * out.scale + k * durations.get(t, 0), *more) for c, b, k, t, time, *more in raw_packets]
    out.cues = [(time * out.scale, t, offset) for time, t, offset in out.cues]
    return out


PACKETS = "cluster_offset long, block int, frame int, track int, timestamp_ns long, lacing string, keyframe boolean, offset long, size long, cue boolean, error string"


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, PACKETS) of each frame of each medium; ``cue``: whether a cue point names its cluster at its time and track."""
    names = [key, *(x.split()[0] for x in PACKETS.split(", "))]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column(1)[i].is_valid:
                    continue
                try:
                    found = parse(batch.column(1)[i].as_buffer())
                    cued = set(found.cues)
                    out = [(*p, (p[4], p[3], p[0]) in cued, None) for p in found.packets]
                except (ValueError, IndexError) as e:
                    out = [(*[None] * 9, None, str(e))]
                if out:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(out), batch.schema.field(0).type), *columns], names=names)

    return media.select(key, column).mapInArrow(rows, f"`{key}` {media.schema[key].dataType.simpleString()}, {PACKETS}")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def features(payload: bytes, found: Media) -> str:
    """Counts of packets, laced packets, clusters and cues, length in ms, and mean, spread and crossings of the samples' middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    laced = sum(p[5] != "none" for p in found.packets)
    return f"packets={len(found.packets)};laced={laced};clusters={len(found.clusters)};cues={len(found.cues)};ms={len(payload) * 1000 // RATE};mean={x.mean():.4f};sd={x.std():.4f};crossings={crossings}"


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text through a Matroska file and back; see the module's text for the payload."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def through(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = bytes(value.as_buffer()) if value.is_valid else b""
                media = store(padded(raw))
                found = parse(media)
                back = b"".join(media[p[7] : p[7] + p[8]] for p in found.packets)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    return docs.select(doc_id, text).mapInArrow(through, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
