"""Ranges found inside capture files against a walk from the start."""

from __future__ import annotations

import random
import struct

import pytest
from flowloom.sinks.captures import write_captures
from flowloom.sources import captures, ranges


def file_of(bodies, order="<", nano=False, originals=None):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101)
    for n, body in enumerate(bodies):
        original = len(body) if originals is None else originals
        data += struct.pack(order + "IIII", 1_700_000_000 + n, n % 1000, len(body), original) + body
    return data


def fakes(count, step=16, order="<"):
    """A body that looks like a chain of records."""
    one = struct.pack(order + "IIII", 1_700_000_000, 5, step, step) + b"\1" * step
    return one * count


def serial(data, order):
    """Record places by a walk from the start, and whether the file is cut."""
    at, places = 24, []
    while at < len(data):
        size = struct.unpack(order + "I", data[at + 8 : at + 12])[0] if at + 16 <= len(data) else 0
        if at + 16 + size > len(data):
            return places, at
        places.append(at)
        at += 16 + size
    return places, None


def cases():
    draw = random.Random(4)
    some = [draw.randbytes(draw.randint(1, 300)) for _ in range(200)]
    return {
        "plain": (file_of(some), "<"),
        "big_endian": (file_of(some, ">", True), ">"),
        "zeros": (file_of([bytes(n % 50) for n in range(300)]), "<"),
        "imitation": (file_of([fakes(draw.randint(1, 40)) if n % 3 else b"ab" for n in range(80)]), "<"),
        "whole_file_inside": (file_of([b"x", file_of(some), file_of(some[:50]), b"y"]), "<"),
        "long_record": (file_of([b"x" * 40, fakes(400), draw.randbytes(20_000), *some[:20]]), "<"),
        "cut_body": (file_of(some)[:-3], "<"),
        "cut_header": (file_of(some) + b"\0" * 7, "<"),
        "cut_early": (file_of(some[:20]) + struct.pack("<IIII", 1, 1, 10**6, 10**6) + file_of(some), "<"),
        "no_records": (file_of([]), "<"),
        "no_original": (file_of(some, originals=0), "<"),
        "one": (file_of([b"abc"]), "<"),
    }


@pytest.mark.parametrize("width", [300, 4000])
def test_ranges_equal_a_walk_from_the_start(spark, tmp_path, width):
    files = cases()
    for name, (data, _) in files.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    rows = ranges.index_captures(spark, str(tmp_path), range_bytes=width).collect()
    for name, (data, order) in files.items():
        places, cut = serial(data, order)
        own = sorted((r for r in rows if r.path.endswith(f"/{name}.pcap")), key=lambda r: (r.start, r.stop))
        found, number = [], 1
        for r in own:
            if r.fault:
                assert (r.fault, r.start, r.first_packet) == ("truncated_record", cut, len(places) + 1)
                continue
            assert r.first_packet == number
            inside = [p for p in places if r.start <= p < r.stop]
            assert inside and inside[0] == r.start
            found += inside
            number += len(inside)
        assert found == places, name
        assert any(r.fault for r in own) == (cut is not None), name
        if len(places) > 100:
            assert len(own) > 3


def test_imitations_are_proposed_and_mended(spark, tmp_path):
    data = file_of([fakes(300), b"abc"] * 3)
    (tmp_path / "vpn_ssh_a.pcap").write_bytes(data)

    def piece(at, size):
        return data[at : at + size]

    places, _ = serial(data, "<")
    low = places[0] + 500
    entry = ranges.proposed_entry(piece, low, low + 2000, len(data), "<", 1_000_000)
    assert entry is not None and entry not in places
    index = ranges.index_captures(spark, str(tmp_path), range_bytes=1000)
    records = captures.capture_records(index).orderBy("packet_number").collect()
    assert [bytes(r.raw) for r in records] == [fakes(300), b"abc"] * 3
    assert [r.packet_number for r in records] == [1, 2, 3, 4, 5, 6]


def test_written_captures_are_read_back(spark, tmp_path):
    rows = [
        (f"vpn_ssh_capture{n % 3}.pcap", n, 1_700_000_000_123_456_789 + n, bytes([n % 251]) * (n % 60 + 1))
        for n in range(600)
    ]
    table = spark.createDataFrame(rows, "capture_id string, packet_number bigint, ticks bigint, raw binary")
    folder = str(tmp_path / "written")
    done = write_captures(table.repartition(5), folder).collect()
    assert sorted(r.packets for r in done) == [200, 200, 200]
    index = ranges.index_captures(spark, folder, range_bytes=777)
    assert index.where("fault IS NOT NULL").count() == 0
    got = captures.capture_records(index).collect()
    key = {(r.path.rsplit("/", 1)[1], r.packet_number): r for r in got}
    for name, n, ticks, raw in rows:
        record = key[name, n // 3 + 1]
        assert bytes(record.raw) == raw and record.timestamp_seconds == ticks / 10**9
