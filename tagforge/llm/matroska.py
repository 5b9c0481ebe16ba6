"""Media columns: Matroska written and parsed from bytes.

:func:`packets` reads variable-length EBML elements (known and unknown sizes), clusters, SimpleBlocks and BlockGroups with
every kind of lacing, and cues, and gives one packet per frame: track, timestamp, key flag, cluster, byte range.
:func:`write_media` stores a byte payload as 8-bit mono samples in laced blocks, losslessly; equal payloads give equal files.

Timestamps are milliseconds: ticks of a segment count its TimestampScale, wherever its Info element stands before the clusters.

Truncated or foreign bytes raise ValueError in :func:`packets`; the table operators give them zero
packets instead.  Null media gives zero packets.  A null or empty text is stored as one frame of padding.  Repeated rows and
equal texts give equal rows; a very long text is one file, held once as text, once as media.  An empty table gives an
empty result.  Columns other than id and text, or id and media, are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import blocks, map_texts, shared_dir, written

FRAME = 576
RATE = 8000
PAD = b"\xff"

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))
LACING = {"none": 0x00, "xiph": 0x02, "fixed": 0x04, "ebml": 0x06}


@dataclass
class Media:
    """Packets as parallel lists, the cues as (time, track, cluster position), and the tracks' codec ids."""

    track: list[int] = field(default_factory=list)
    timestamp: list[int] = field(default_factory=list)
    cluster: list[int] = field(default_factory=list)
    key: list[bool] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)
    frame_ms: dict[int, float] = field(default_factory=dict)
    clusters: int = 0
    scale: int = 1_000_000


def vint(value: int, width: int = 0) -> bytes:
    """A size or track number in as few bytes as hold it (the all-ones value of a width means unknown), or in ``width``."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value or -1 for unknown, next offset, width)."""
    if at >= len(data):
        raise ValueError("element cut off")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no variable-length number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width, width


def children(data: bytes, at: int, end: int, stop_ids: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) inside [at, end); stops before an id of ``stop_ids``.

    An element of unknown size ends with its parent; the caller resumes where its reading stopped by :func:`packets`.
    """
    while at < end:
        ident, body, _ = read_vint(data, at, True)
        if ident in stop_ids:
            return
        size, body, _ = read_vint(data, body, False)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError("element reaches beyond its parent")
        yield ident, at, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def packets(data: bytes) -> Media:
    """The packet table and cues of a whole file."""
    out = Media()
    ident, body, _ = read_vint(data, 0, True)
    if ident != EBML:
        raise ValueError("no EBML header")
    size, body, _ = read_vint(data, body, False)
    at = body + size
    while at < len(data):
        ident, body, _ = read_vint(data, at, True)
        size, body, _ = read_vint(data, body, False)
        end = len(data) if size < 0 else body + size
        if end > len(data):
            raise ValueError("segment cut off")
        if ident == SEGMENT:
            _segment(data, body, end, out)
        at = end
    return out


def _segment(data: bytes, at: int, end: int, out: Media) -> None:
    begin, out.scale = at, 1_000_000
    while at < end:
        ident, body, _ = read_vint(data, at, True)
        size, body, _ = read_vint(data, body, False)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError("element reaches beyond the segment")
        if ident == INFO:
            for kind, _, a, b in children(data, body, stop):
                if kind == TIMESTAMP_SCALE:
                    out.scale = _uint(data, a, b)
        elif ident == TRACKS:
            for kind, _, a, b in children(data, body, stop):
                if kind == TRACK_ENTRY:
                    _track(data, a, b, out)
        elif ident == CLUSTER:
            stop = _cluster(data, body, stop, size < 0, out)
        elif ident == CUES:
            _cues(data, body, stop, begin, out)
        at = stop


def _track(data: bytes, at: int, end: int, out: Media) -> None:
    number_, codec, duration = 0, "", 0.0
    for kind, _, a, b in children(data, at, end):
        if kind == TRACK_NUMBER:
            number_ = _uint(data, a, b)
        elif kind == CODEC_ID:
            codec = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif kind == 0x23E383:  # DefaultDuration, nanoseconds
            duration = _uint(data, a, b) / 1e6
    out.codecs[number_], out.frame_ms[number_] = codec, duration


def _cluster(data: bytes, at: int, end: int, unknown: bool, out: Media) -> int:
    time, at_end = 0, at
    out.clusters += 1
    for kind, _, a, b in children(data, at, end, TOP_LEVEL if unknown else frozenset()):
        if kind == TIMESTAMP:
            time = _uint(data, a, b)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, time, None, out)
        elif kind == BLOCK_GROUP:
            block, key = None, True
            for k, _, x, y in children(data, a, b):
                if k == BLOCK:
                    block = (x, y)
                elif k == REFERENCE_BLOCK:
                    key = False
            if block:
                _block(data, *block, time, key, out)
        at_end = b
    return at_end if unknown else end


def _block(data: bytes, at: int, end: int, time: int, key: bool | None, out: Media) -> None:
    track, at, _ = read_vint(data, at, False)
    (offset,), flags = struct.unpack_from(">h", data, at), data[at + 2]
    at += 3
    sizes = _lace_sizes(data, at, end, flags & 0x06)
    at = sizes.pop()
    ms = out.frame_ms.get(track, 0.0)
    n = len(sizes)
    out.track += [track] * n
    out.cluster += [out.clusters - 1] * n
    out.key += [bool(flags & 0x80) if key is None else key] * n
    out.size += sizes
    for i, size in enumerate(sizes):
        out.timestamp.append(round((time + offset) * out.scale / 1_000_000 + i * ms))
        out.start.append(at)
        at += size
    if at != end:
        raise ValueError("frames don't fill their block")


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> list[int]:
    """Sizes of a block's frames, and last the offset of the first frame."""
    if lacing == LACING["none"]:
        return [end - at, at]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == LACING["fixed"]:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // n] * n + [at]
    for i in range(n - 1):
        if lacing == LACING["xiph"]:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, at, width = read_vint(data, at, False)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block")
    return [*sizes, at]


def _cues(data: bytes, at: int, end: int, segment: int, out: Media) -> None:
    for kind, _, a, b in children(data, at, end):
        if kind != CUE_POINT:
            continue
        time = 0
        for k, _, x, y in children(data, a, b):
            if k == CUE_TIME:
                time = _uint(data, x, y)
            elif k == CUE_TRACK_POSITIONS:
                got = {i: _uint(data, p, q) for i, _, p, q in children(data, x, y)}
                out.cues.append((round(time * out.scale / 1_000_000), got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))


def block_body(frames: list[bytes], offset: int, lacing: str, track: int = 1) -> bytes:
    """A SimpleBlock's body: track, time offset, flags, lace, frames."""
    lacing = "none" if len(frames) == 1 else lacing
    head = vint(track) + struct.pack(">h", offset) + bytes([0x80 | LACING[lacing]])
    if lacing == "none":
        return head + frames[0]
    lace = bytes([len(frames) - 1])
    if lacing == "xiph":
        lace += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        lace += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            n = next(k for k in range(1, 9) if abs(len(b) - len(a)) < (1 << 7 * k - 1) - 1)
            lace += vint(len(b) - len(a) + (1 << 7 * n - 1) - 1, n)
    return head + lace + b"".join(frames)


def write_media(payload: bytes, frame: int = FRAME, per_block: int = 8, per_cluster: int = 64, lacing: str = "fixed") -> bytes:
    """A Matroska file with one PCM track of 8-bit samples that holds ``payload``, a multiple of ``frame`` bytes."""
    per_block = 1 if lacing == "none" else per_block
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ms = lambda i: i * frame * 1000 // RATE
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", ms(len(frames)))) + element(MUXING_APP, b"media columns") + element(WRITING_APP, b"media columns"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(0x23E383, frame * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    tracks = element(TRACKS, element(TRACK_ENTRY, entry))
    body, cues = [info, tracks], []
    position = len(info) + len(tracks)
    for start in range(0, len(frames), per_cluster):
        blocks = [element(SIMPLE_BLOCK, block_body(frames[i : min(i + per_block, start + per_cluster)], ms(i) - ms(start), lacing)) for i in range(start, min(start + per_cluster, len(frames)), per_block)]
        cluster = element(CLUSTER, number(TIMESTAMP, ms(start)) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms(start)) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, position))))
        body.append(cluster)
        position += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def to_payload(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of ``frame``, and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (frame * max(1, -(-len(raw) // frame)) - len(raw)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every text as a Matroska file."""
    fields = [T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)]
    return map_texts(docs, [id_col], text_col, fields, _stored)


def _stored(texts):
    made = [to_payload(t) for t in texts]
    return [[n for _, n in made], [write_media(p) for p, _ in made]]


def _table(data: bytes | None) -> Media:
    try:
        return packets(data or b"")
    except (ValueError, IndexError, struct.error):
        return Media()


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, timestamp_ms, is_key, cluster, byte_start, byte_size."""
    import pyarrow as pa

    source = media.select(id_col, F.col(media_col).alias("__media"))
    schema = T.StructType([source.schema.fields[0], *(T.StructField(n, T.LongType()) for n in ("packet", "track", "timestamp_ms")), T.StructField("is_key", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("cluster", "byte_start", "byte_size"))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t = _table(batch.column(1)[i].as_py())
                n = len(t.track)
                ids = batch.column(0).take(pa.array([i] * n, pa.int64()))
                columns = [ids, pa.array(range(n), pa.int64()), pa.array(t.track, pa.int64()), pa.array(t.timestamp, pa.int64()), pa.array(t.key, pa.bool_()), pa.array(t.cluster, pa.int64()), pa.array(t.start, pa.int64()), pa.array(t.size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def features(data: bytes) -> tuple[bytes, str, int]:
    """(payload read back from the packets, a text of figures on packets and samples, number of packets)."""
    t = packets(data)
    payload = b"".join([data[a : a + n] for a, n in zip(t.start, t.size, strict=True)])
    samples = np.frombuffer(payload, np.uint8)
    steps = int(np.count_nonzero(samples[1:] != samples[:-1]))
    mean = float(samples.mean(dtype=np.float64)) if len(samples) else 0.0
    figures = {"codec": ",".join(t.codecs.values()), "packets": len(t.size), "clusters": t.clusters, "cues": len(t.cues), "last_ms": t.timestamp[-1] if t.timestamp else 0, "key": sum(t.key), "mean": f"{mean:.4f}", "peak": int(samples.max()) if len(samples) else 0, "steps": steps}
    return payload, ";".join(f"{k}={v}" for k, v in figures.items()), len(t.size)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: sizes and checksums of the payload read back from its stored Matroska form, and the form's own.

    The media column is written to the shared folder, and the figures come from the bytes read there.
    """
    import pyarrow as pa

    media = written(store_texts(docs, id_col, text_col), f"{shared_dir(docs.sparkSession)}/media")
    names = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_packets", T.LongType())]
    schema = T.StructType([*media.schema.fields[:2], *(T.StructField(n, k) for n, k in names)])

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 2):
                rows = [_read_back(m.as_py()) for m in part.column(2)]
                made = zip(rows and zip(*rows, strict=True), (pa.int64() if k == T.LongType() else pa.string() for _, k in names), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(list(x), k) for x, k in made)], names=schema.names)

    return media.mapInArrow(run, schema)


def _read_back(media: bytes) -> tuple:
    back, figures, n = features(media)
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), figures, n
