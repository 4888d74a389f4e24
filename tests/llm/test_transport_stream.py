"""Transport streams: exact round trips, structure, damaged streams."""

import hashlib
import os
import zlib

import pytest
from llm.conftest import texts_of

from loomql.llm import op8_transport_stream as op


@pytest.mark.parametrize("n", [0, 1, 64, 150, 161, 162, 163, 168, 169, 170, 171, 183, 184, 185, 353, 16383, 16384, 16385, 200_000])
def test_round_trip(n):
    payload = os.urandom(n)
    raw, times, points = op.mux_indexed(payload)
    s = op.demux(raw)
    assert s.payload == payload and s.pts == times and s.access_points == points
    assert (s.counter_errors, s.lost_units, s.packets) == (0, 0, len(raw) // 188)
    assert s.programs == {op.PROGRAM: op.PMT_PID} and s.streams == {op.STREAM_PID: op.STREAM_TYPE}
    assert times == [k * op.TICKS for k in range(max(1, -(-n // op.UNIT)))]
    assert all(raw[p * 188 + 1] & 0x40 and raw[p * 188 + 5] & 0x40 for p in points)


def test_section_checksum_is_the_standard_one():
    assert op.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_lost_packets_are_noticed():
    payload = os.urandom(100_000)
    raw = op.mux(payload)
    broken = raw[: 188 * 40] + raw[188 * 41 :]
    s = op.demux(broken)
    assert s.counter_errors == 1 and s.lost_units == 1 and len(s.payload) == 100_000 - op.UNIT


def test_random_access(rng):
    """Reading from an access point on gives the payload from that unit on."""
    payload = os.urandom(300_000)
    raw, times, points = op.mux_indexed(payload)
    k = points[1]
    s = op.demux(raw[(k - 2) * 188 :])  # the tables stand before it
    assert s.payload == payload[op.GROUP * op.UNIT :] and s.pts[0] == times[op.GROUP]


def test_other_packets_are_skipped_and_bad_streams_refused():
    raw = op.mux(b"x" * 1000)
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    assert op.demux(null + raw + null).payload == b"x" * 1000
    for bad in (raw[:-1], b"\x00" * 188, null, b""):
        with pytest.raises(ValueError):
            op.demux(bad)
    corrupt = bytearray(raw)
    corrupt[20] ^= 1  # in the first table
    with pytest.raises(ValueError):
        op.demux(bytes(corrupt))


def expected(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def test_query(spark, docs, small):
    rows = op.op8_transport_stream(spark, small).collect()
    assert {r["doc_id"]: tuple(r[1:5]) for r in rows} == {i: expected(t) for i, t in texts_of(docs)}
    assert all("counter_errors=0;lost=0;index=ok" in r["feature"] for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_awkward_rows(spark, odd, empty):
    rows = op.media_features(op.media_column(odd)).collect()
    assert sorted((repr(r["doc_id"]), *r[1:5]) for r in rows) == sorted((repr(i), *expected(t)) for i, t in texts_of(odd))
    assert op.media_features(op.media_column(empty)).count() == 0
