"""Media columns in Matroska form.

``encode_media`` makes of each document's bytes a Matroska file with unsigned 8-bit PCM samples in a binary column, ``store_media`` writes
that column as a table; ``parse_media`` parses a stored column (variable-length EBML numbers, clusters, lacing, cues) into the packets of each
file with track, timestamp and byte range, and reads the samples by these ranges; ``packet_table`` has one row per packet;
``decode_media`` adds the feature, which comes from the packets, clusters, cues and samples.

The parser knows nothing of the writer: it handles no lacing, Xiph, EBML and fixed-size lacing, SimpleBlock and BlockGroup,
unknown-size segments and clusters, and skips elements it doesn't know. Bytes that end early raise MatroskaError.

Defined results: null text is empty; an empty text is 64 bytes 0; repeated rows and ties give equal values each, also under one doc_id; a null
doc_id stays null; an empty table gives no rows; other columns are ignored, also those named like columns made here. A very long text is one file of many
clusters: a row holds it whole, batches are cut by bytes.
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
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of, work_dir
from tessera.llm.textnum import slices

# Element numbers of the published Matroska and EBML specifications (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, MUXING_APP, WRITING_APP = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741

PAD = 64
FRAME = 1024  # bytes of a packet
LACE = 8  # packets of a block
BLOCKS = 16  # blocks of a cluster
RATE = 8000  # samples a second, so a packet of 1024 bytes lasts 128 ms


class MatroskaError(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    timestamp: int  # of the block, in units of the timestamp scale
    lace: int  # place in the block
    start: int  # byte range in the file
    end: int
    keyframe: bool


# Writing


def number_bytes(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def size_bytes(n: int) -> bytes:
    """A data size as a variable-length number. All bits 1 is reserved for unknown sizes."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, data: bytes) -> bytes:
    return number_bytes(number) + size_bytes(len(data)) + data


def unsigned(number: int, value: int) -> bytes:
    return element(number, number_bytes(value))


def lace_sizes(sizes: list[int]) -> bytes:
    """EBML lacing: the first size, then signed differences; the last size follows from the block's."""
    out = size_bytes(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        d, width = now - before, 1
        while not -(1 << 7 * width - 1) < d < 1 << 7 * width - 1:
            width += 1
        out += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return out


def write_matroska(payload: bytes) -> bytes:
    """One PCM track; clusters of up to BLOCKS laced blocks of up to LACE packets; a cue for each cluster."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    duration = len(payload) * 1000 // RATE
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", duration)) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = FRAME * LACE
    for c in range(0, len(payload), step * BLOCKS):
        time = c * 1000 // RATE
        body = [unsigned(CLUSTER_TIMESTAMP, time)]
        for b in range(c, min(len(payload), c + step * BLOCKS), step):
            data = payload[b : b + step]
            sizes = [min(FRAME, len(data) - i) for i in range(0, len(data), FRAME)]
            laced = len(sizes) > 1
            head_of = b"\x81" + (b * 1000 // RATE - time).to_bytes(2, "big", signed=True) + bytes([0x80 | 0x06 * laced])
            body.append(element(SIMPLE_BLOCK, head_of + (bytes([len(sizes) - 1]) + lace_sizes(sizes) if laced else b"") + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# Reading


def read_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length number: value, where it ends, whether all its bits are 1."""
    if at >= len(data):
        raise MatroskaError("the data end in a number")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise MatroskaError("bad variable-length number")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the data of each element in a range."""
    while at < end:
        number, at, _ = read_number(data, at, keep_marker=True)
        size, at, unknown = read_number(data, at)
        stop = end if unknown else at + size
        if stop > end:
            raise MatroskaError("an element ends beyond its parent")
        if unknown and number == CLUSTER:  # ends at the next element of the segment's level
            stop = at
            while stop < end:
                n, a, _ = read_number(data, stop, keep_marker=True)
                if n in (CLUSTER, CUES, TRACKS, INFO):
                    break
                s, a, _ = read_number(data, a)
                stop = a + s
        yield number, at, stop
        at = stop


def block_packets(data: bytes, at: int, end: int, base: int, group: bool) -> list[Packet]:
    track, at, _ = read_number(data, at)
    if at + 3 > end:
        raise MatroskaError("a block ends in its header")
    time, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing, key = flags & 0x06, group or bool(flags & 0x80)
    if not lacing:
        return [Packet(track, time, 0, at, end, key)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 0x02:  # Xiph
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 0x06:  # EBML
        for i in range(n - 1):
            before = at
            value, at, _ = read_number(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise MatroskaError("fixed-size lacing does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace is longer than its block")
    out = []
    for i, size in enumerate(sizes):
        out.append(Packet(track, time, i, at, at + size, key))
        at += size
    return out


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def read_matroska(data: bytes) -> dict:
    """Packets, clusters (start of each in the segment and its timestamp), cues and the duration."""
    packets: list[Packet] = []
    clusters: list[tuple[int, int]] = []
    cues: list[tuple[int, int, int]] = []
    duration, seen = 0.0, False
    for number, a, b in elements(data, 0, len(data)):
        if number != SEGMENT:
            continue
        seen, origin, last = True, a, a
        for n1, a1, b1 in elements(data, a, b):
            if n1 == INFO:
                for n2, a2, b2 in elements(data, a1, b1):
                    if n2 == DURATION:
                        duration = struct.unpack(">d" if b2 - a2 == 8 else ">f", data[a2:b2])[0]
            elif n1 == CLUSTER:
                base = 0
                clusters.append((last - origin, 0))
                for n2, a2, b2 in elements(data, a1, b1):
                    if n2 == CLUSTER_TIMESTAMP:
                        base = uint(data, a2, b2)
                        clusters[-1] = (clusters[-1][0], base)
                    elif n2 == SIMPLE_BLOCK:
                        packets += block_packets(data, a2, b2, base, False)
                    elif n2 == BLOCK_GROUP:
                        for n3, a3, b3 in elements(data, a2, b2):
                            if n3 == BLOCK:
                                packets += block_packets(data, a3, b3, base, True)
            elif n1 == CUES:
                for n2, a2, b2 in elements(data, a1, b1):
                    time, track, position = 0, 0, 0
                    for n3, a3, b3 in elements(data, a2, b2):
                        if n3 == CUE_TIME:
                            time = uint(data, a3, b3)
                        elif n3 == CUE_TRACK_POSITIONS:
                            for n4, a4, b4 in elements(data, a3, b3):
                                track = uint(data, a4, b4) if n4 == CUE_TRACK else track
                                position = uint(data, a4, b4) if n4 == CUE_CLUSTER_POSITION else position
                    cues.append((time, track, position))
            last = b1
    if not seen:
        raise MatroskaError("no segment")
    return {"packets": packets, "clusters": clusters, "cues": cues, "duration": duration}


# Columns


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD or PAD * (not raw))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, sizes, held = [], [], 0
        for x in batch.column(1).cast(pa.large_binary()):
            raw = x.as_py() or b""
            sizes.append(len(raw))
            media.append(write_matroska(padded(raw)))
            held += len(media[-1])
            if held > 16_000_000:
                k = len(sizes)
                yield pa.record_batch([batch.column(0).slice(0, k), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                batch, media, sizes, held = batch.slice(k), [], [], 0
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return d.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def store_media(docs: DataFrame, path: str) -> DataFrame:
    """Write the media column of ``docs`` and read it back."""
    encode_media(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


PACKET = "struct<track:long,timestamp:long,lace:int,byte_start:long,byte_end:long,keyframe:boolean>"
SAMPLES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, level long, step long, distinct int"
PARSED = f"doc_id long, n_bytes long, {SAMPLES}, packets array<{PACKET}>, clusters array<struct<position:long,timestamp:long>>, cues array<struct<timestamp:long,track:long,position:long>>, duration double"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def _rows(names: str, values: list[list[tuple]]) -> pa.Array:
    """A list of structs a row."""
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    fields = [f.split(":") for f in names.split(",")]
    flat = [x for v in values for x in v]
    cols = [pa.array([x[i] for x in flat], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(cols, [n for n, _ in fields]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [c.split(" ")[1] for c in SAMPLES.split(", ")]
    for batch in batches:
        for part in slices(batch, 2):
            rows, packets, clusters, cues, duration = [], [], [], [], []
            for x in part.column(2):
                media = x.as_py()
                found = read_matroska(media)
                payload = b"".join(media[p.start : p.end] for p in found["packets"])
                y = np.frombuffer(payload, np.uint8)
                level = int(y.sum(dtype=np.int64)) * 1000 // max(1, len(y))
                step = int(np.abs(np.diff(y.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(y))
                different = int(np.count_nonzero(np.bincount(y, minlength=256)))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), level, step, different))
                packets.append(found["packets"])
                clusters.append(found["clusters"])
                cues.append(found["cues"])
                duration.append(found["duration"])
            cols = [pa.array([r[i] for r in rows], _ARROW[k]) for i, k in enumerate(kinds)]
            nested = [_rows(PACKET[7:-1], packets), _rows("position:long,timestamp:long", clusters), _rows("timestamp:long,track:long,position:long", cues)]
            yield pa.record_batch([part.column(0), part.column(1), *cols, *nested, pa.array(duration, pa.float64())], names=[c.split(" ")[0] for c in PARSED.split(", ")])


def parse_media(media: DataFrame) -> DataFrame:
    """Per stored file: digests and levels of its samples, its packets, clusters and cues."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_parse, PARSED)


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of a (doc_id, n_bytes, media) table."""
    return parse_media(media).select("doc_id", F.explode("packets").alias("p")).select("doc_id", "p.*")


def decode_media(media: DataFrame) -> DataFrame:
    """Per document: sizes, digests and the feature, all from the stored bytes.

    feature: packets, clusters, cues that point at a cluster, tracks, duration in ms, timestamp of the last packet, mean level, mean step, distinct samples, joined by colons.
    Packets that don't add up to the text with its padding stop the job.
    """
    p = parse_media(media)
    ranges = F.aggregate("packets", F.lit(0).cast("long"), lambda n, x: n + x["byte_end"] - x["byte_start"])
    good = F.filter("cues", lambda c: F.exists("clusters", lambda k: (k["position"] == c["position"]) & (k["timestamp"] == c["timestamp"])))
    tracks = F.array_distinct(F.transform("packets", lambda x: x["track"]))
    last = F.array_max(F.transform("packets", lambda x: x["timestamp"]))
    feature = F.concat_ws(":", *[c.cast("string") for c in (F.size("packets"), F.size("clusters"), F.size(good), F.size(tracks), F.col("duration").cast("long"), last, F.col("level"), F.col("step"), F.col("distinct"))])
    sound = (ranges == F.col("payload_bytes")) & (F.col("payload_bytes") - F.col("n_bytes")).between(0, PAD)
    said = [F.col(c.split(" ")[0]) for c in SAMPLES.split(", ")[:5]]
    return p.select("doc_id", "n_bytes", *said, F.when(sound, feature).otherwise(F.raise_error(F.lit("the samples read back are not those stored"))).alias("feature"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(store_media(table(spark, sf_dir, "documents"), work_dir(spark, "media")))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_media`` that SQL can express: what was stored and read back."""
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    p AS (SELECT doc_id, b, b || unhex(repeat('00', CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END)) AS payload FROM d)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256 FROM p"""
