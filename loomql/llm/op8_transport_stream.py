"""Media columns: MPEG transport streams.

``mux`` carries a payload in 188-byte packets: a program association table, a program map table and one
elementary stream of private data.  The payload is cut into access units of ``UNIT`` bytes; each is a
packetised elementary packet (PES) with a presentation timestamp, and each ``GROUP``-th unit is a random
access point with a clock reference.  ``demux`` follows the tables to the elementary stream, checks
sections (CRC-32/MPEG-2), sync bytes and continuity counters, reassembles the PES packets and gives
their timestamps and random access points; a unit that lost a packet is left out and counted.

``media_column`` stores one stream a row together with its timestamps and random access points (packet
numbers to seek to); ``media_features`` reads stored rows back.

Limits: the first program's first stream is read; a table must fit one packet.

Defined cases: a null text is an empty one; an empty payload is 64 zero bytes; a very long text is one long stream; equal
texts have equal streams; repeated rows all stay; an empty table gives none; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.batches import bound_batches, release, runs
from loomql.plans.scratch import new_folder

PACKET, HEADER, ROOM = 188, 4, 184
SYNC, PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0x47, 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
UNIT = 16 << 10
GROUP = 8
TICKS = 3600  # of the 90 kHz clock between two units
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=1024)  # the tables of streams are few
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section_packet(pid: int, table: int, number: int, body: bytes, counter: int) -> bytes:
    """A packet with one whole section, padded with 0xFF."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


@lru_cache(maxsize=64)
def _tables(counter: int) -> bytes:
    pat = _section_packet(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"), counter)
    pmt = (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    return pat + _section_packet(PMT_PID, 2, PROGRAM, pmt, counter)


def _pts_field(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _adaptation(flags: int, clock: int | None, room: int) -> bytes:
    """An adaptation field of exactly ``room`` bytes (0: none)."""
    if room == 0:
        return b""
    if room == 1:
        return b"\x00"
    body = bytes([flags])
    if clock is not None:
        body += (clock << 15 | 0x7E00).to_bytes(6, "big")
    return bytes([room - 1]) + body + b"\xff" * (room - 1 - len(body))


def _packets(data: bytes, counter: int, pts: int, access: bool) -> bytes:
    """The packets of one PES whose bytes are ``data``."""
    lead = 8 if access else 0
    first = min(len(data), ROOM - lead)
    n_mid, rest = divmod(len(data) - first, ROOM)
    n = 1 + n_mid + (rest > 0)
    field_size = max(lead, ROOM - first)
    out = [bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, (0x30 if field_size else 0x10) | counter & 15]), _adaptation(0x50 if access else 0, pts if access else None, field_size), data[:first]]
    if n_mid:
        block = np.empty((n_mid, PACKET), dtype=np.uint8)
        block[:, :3] = (SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF)
        block[:, 3] = 0x10 | (counter + 1 + np.arange(n_mid)) & 15
        block[:, HEADER:] = np.frombuffer(data, np.uint8, n_mid * ROOM, first).reshape(n_mid, ROOM)
        out.append(block.tobytes())
    if rest:
        out += [bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter + n - 1 & 15]), _adaptation(0, None, ROOM - rest), data[-rest:]]
    return b"".join(out)


def mux_indexed(payload: bytes) -> tuple[bytes, list[int], list[int]]:
    """(transport stream, timestamps, packet numbers of random access points) for ``payload``."""
    out, counter, total, times, points = [], 0, 0, [], []
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit, access = payload[at : at + UNIT], k % GROUP == 0
        if access:
            out.append(_tables(k // GROUP & 15))
            total += 2
            points.append(total)
        pts = k * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_field(pts) + unit
        packets = _packets(pes, counter, pts, access)
        counter += len(packets) // PACKET
        total += len(packets) // PACKET
        times.append(pts)
        out.append(packets)
    return b"".join(out), times, points


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    return mux_indexed(payload)[0]


@dataclass
class Stream:
    """What ``demux`` found."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)  # program number → PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID → stream type
    packets: int = 0
    pts: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)  # packet numbers
    counter_errors: int = 0
    lost_units: int = 0


def _payload_start(packet: np.ndarray) -> int:
    return HEADER + (1 + int(packet[4]) if packet[3] & 0x20 else 0)


def _section(packet: np.ndarray, table: int) -> bytes | None:
    raw = packet.tobytes()[_payload_start(packet) :]
    raw = raw[1 + raw[0] :] if raw else raw
    if len(raw) < 12 or raw[0] != table:
        return None
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    return raw[8 : size - 4] if size <= len(raw) and crc32_mpeg(raw[:size]) == 0 else None


def _pes(unit: bytes) -> tuple[int | None, bytes] | None:
    """(timestamp, data) of a whole PES packet, None if it is cut short."""
    if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
        return None
    size, skip = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
    if size and len(unit) != 6 + size:
        return None
    p = unit[9:14]
    pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if unit[7] & 0x80 and len(p) == 5 else None
    return pts, unit[skip:]


def demux(stream: bytes) -> Stream:
    """Read a transport stream; raises ValueError where packets have no sync byte or no table leads to a stream."""
    if len(stream) % PACKET:
        raise ValueError("the stream isn't a whole number of packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(rows) == 0 or not (rows[:, 0] == SYNC).all():
        raise ValueError("a packet has no sync byte")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts = rows[:, 1] & 0x40 != 0
    found = Stream(packets=len(rows))
    for i in np.flatnonzero((pid == PAT_PID) & starts)[:1]:
        body = _section(rows[i], 0) or b""
        found.programs = {int.from_bytes(body[k : k + 2], "big"): int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(body) - 3, 4)}
    for map_pid in found.programs.values():
        for i in np.flatnonzero((pid == map_pid) & starts)[:1]:
            body = _section(rows[i], 2) or b"\x00" * 4
            k = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while k + 5 <= len(body):
                found.streams[int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF] = body[k]
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)
    if not found.streams:
        raise ValueError("no program table leads to a stream")
    mine = np.flatnonzero(pid == next(iter(found.streams)))
    own = rows[mine]
    # a packet may come twice in a row, equal but for its clock: the second one is left out
    again = np.zeros(len(own), dtype=bool)
    again[1:] = (own[1:, 3] & 0x10 != 0) & (own[1:, :4] == own[:-1, :4]).all(axis=1) & (own[1:, 12:] == own[:-1, 12:]).all(axis=1)
    mine, own = mine[~again], own[~again]
    counter = own[:, 3] & 15
    carries = own[:, 3] & 0x10 != 0
    jump = np.zeros(len(own), dtype=bool)
    jump[1:] = ((counter[1:] - counter[:-1]) & 15) != carries[1:]
    found.counter_errors = int(jump.sum())
    begin = np.flatnonzero(own[:, 1] & 0x40)
    pieces = []
    for a, b in zip(begin, [*begin[1:], len(own)]):
        if own[a, 3] & 0x20 and own[a, 4] and own[a, 5] & 0x40:
            found.access_points.append(int(mine[a]))
        part = own[a:b]
        if jump[a + 1 : b].any():
            found.lost_units += 1
            continue
        plain = part[1:-1, 3] & 0x30 == 0x10
        if plain.all():
            middle = [part[1:-1, HEADER:].tobytes()]
        else:
            middle = [x.tobytes()[_payload_start(x) :] for x in part[1:-1] if x[3] & 0x10]
        ends = [x.tobytes()[_payload_start(x) :] for x in (part[:1] if len(part) == 1 else part[[0, -1]])]
        got = _pes(b"".join([ends[0], *middle, *ends[1:]]))
        if got is None:
            found.lost_units += 1
            continue
        found.pts.append(-1 if got[0] is None else got[0])
        pieces.append(got[1])
    found.payload = b"".join(pieces)
    return found


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part, run in runs(batch, 1, 4 << 20):
            raw = [t.encode() for t in run]
            media, pts, points = zip(*(mux_indexed(x + b"\x00" * (max(1, -(-len(x) // ALIGN)) * ALIGN - len(x))) for x in raw))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), pa.array(pts, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "media", "pts", "access_points"],
            )


_STORED = "doc_id long, n_bytes long, media binary, pts array<long>, access_points array<long>"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pts, access_points): each text as a transport stream with its index."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store_batches, _STORED)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for media, pts, points in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            raw = media.as_py()
            s = demux(raw)
            same = s.pts == pts and s.access_points == points
            feature = f"packets={s.packets};units={len(s.pts)};last_pts={s.pts[-1] if s.pts else -1};access={len(s.access_points)};counter_errors={s.counter_errors};lost={s.lost_units};index={'ok' if same else 'differs'}"
            out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored streams, from their bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media", "pts", "access_points").mapInArrow(_feature_batches, schema)


def op8_transport_stream(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")).write.options(**{"compression": "zstd", "parquet.enable.dictionary#media": "false", "parquet.block.size": str(32 << 20)}).parquet(folder)
    return media_features(spark.read.schema(_STORED).parquet(folder))
