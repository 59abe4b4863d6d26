"""Flow assignment, expiring sessions, concurrency and capacity."""

from __future__ import annotations

import random

import pytest
from flowloom.functions.labels import flow_id
from flowloom.operators import flows
from hashlib import sha256
from pyspark.sql import functions as F

A, B, C, S = ("10.0.0.1", 1000), ("10.0.0.2", 1000), ("10.0.0.3", 1000), ("192.0.2.1", 443)


def directions(df):
    return [r["direction"] for r in df.orderBy("packet_number").collect()]


def test_two_directions_form_one_flow(make_packets):
    got = flows.assign_flows(make_packets([(1, A, S, 10), (2, S, A, 20), (3, A, S, 30)]))
    assert directions(got) == [1, 0, 1]
    assert got.select("flow_id").distinct().count() == 1


def test_first_seen_side_is_forward(make_packets):
    got = flows.assign_flows(make_packets([(1, S, A, 10), (2, A, S, 20)]))
    assert directions(got) == [1, 0]
    assert got.first()["connection"]["src"] == S[0]


def test_same_end_points_are_always_forward(make_packets):
    got = flows.assign_flows(make_packets([(1, A, A, 10), (2, A, A, 20)]))
    assert directions(got) == [1, 1]


def test_flow_id_matches_the_hash_of_the_tuple(make_packets):
    got = flows.assign_flows(make_packets([(1, A, S, 10)])).first()
    text = "\0".join([got["capture_id"], A[0], "1000", S[0], "443", "6"])
    assert got["flow_id"] == sha256(text.encode()).hexdigest()[:24]
    assert flow_id is not None


def test_flow_table_keeps_order_in_one_row(make_packets):
    assigned = flows.assign_flows(
        make_packets(
            [(i, A if i % 3 else S, S if i % 3 else A, 100 + i) for i in range(10)], first=65_530
        )
    )
    whole = flows.flow_table(assigned).collect()
    assert len(whole) == 1 and whole[0]["sizes"] == [100 + i for i in range(10)]
    assert (whole[0]["flow_order"], whole[0]["packet_count"]) == (65_530, 10)


def test_stale_flow_is_evicted_at_the_limit(make_packets):
    got = flows.assign_sessions(make_packets([(0, A, S, 1), (5, B, S, 1), (10, C, S, 1)]), 10.0)
    stats = flows.flow_concurrency(got, 10.0).first()
    assert (stats["flows_created"], stats["flows_evicted_stale"]) == (3, 1)
    assert (stats["peak_tracked_flow_count"], stats["tracked_flow_count"]) == (2, 2)


def test_orientation_flips_after_expiry(make_packets):
    got = flows.assign_sessions(make_packets([(0, A, S, 1), (10, S, A, 1)]), 10.0)
    assert directions(got) == [1, 1]
    assert flows.sessions(got).count() == 2


def test_gap_below_the_limit_keeps_the_session(make_packets):
    got = flows.assign_sessions(make_packets([(0, A, S, 1), (9.999, S, A, 1)]), 10.0)
    assert directions(got) == [1, 0]


def test_capacity_refuses_the_second_flow(make_packets):
    packets = make_packets([(0, A, S, 1), (1, S, A, 1), (2, B, S, 1), (3, A, S, 1)])
    got = flows.assign_sessions(packets, None)
    refused = flows.capacity_refusals(got, None, 1)
    assert refused.first()["refused_packet_number"] == 3
    assert flows.admit_packets(packets, refused).count() == 2


def test_bounded_churn(make_packets):
    rows = []
    for generation in range(32):
        for flow in range(128):
            host = (f"10.1.{generation}.{flow}", 5000)
            rows.append((generation * 100 + flow * 0.01, host, S, 10))
    stats = flows.flow_concurrency(
        flows.assign_sessions(make_packets(rows), 90.0), 90.0
    ).first()
    assert stats["flows_created"] == 4096
    assert stats["flows_evicted_stale"] == 3968
    assert stats["peak_tracked_flow_count"] == 128


def simulate(rows, stale, limit=None):
    """Packet-by-packet tracker: the plain meaning of the distributed operators."""
    held, found, created, evicted, peak = {}, [], 0, 0, 0
    for t, a, b, _ in rows:
        for key in [k for k, seen in held.items() if t - seen >= stale]:
            del held[key]
            evicted += 1
        if (a, b) in held:
            key, direction = (a, b), 1
        elif (b, a) in held:
            key, direction = (b, a), 0
        else:
            if limit is not None and len(held) >= limit:
                return found, created, evicted, peak, len(found) + 1
            key, direction = (a, b), 1
            created += 1
        held[key] = t
        peak = max(peak, len(held))
        found.append((key, direction))
    return found, created, evicted, peak, None


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk_rows", [3, 1_000_000])
def test_sessions_match_a_packet_loop(make_packets, seed, chunk_rows):
    source = random.Random(seed)
    ends = [(f"10.0.0.{i}", 1000 + i) for i in range(4)]
    t, rows = 1_700_000_000.0, []
    for _ in range(120):
        t += source.choice([0.0, 0.001, 0.7, 3.0, 7.0, 10.0])
        # One pair holds about a third of all packets.
        a, b = (ends[0], ends[1]) if source.random() < 0.34 else source.sample(ends, 2)
        rows.append((t, *((a, b) if source.random() < 0.5 else (b, a)), 10))
    found, created, evicted, peak, _ = simulate(rows, 10.0)
    got = flows.assign_sessions(make_packets(rows), 10.0, chunk_rows=chunk_rows)
    listed = got.orderBy("packet_number").collect()
    assert [r["direction"] for r in listed] == [d for _, d in found]
    assert [
        ((r["connection"]["src"], r["connection"]["sport"]),
         (r["connection"]["dst"], r["connection"]["dport"]))
        for r in listed
    ] == [k for k, _ in found]
    stats = flows.flow_concurrency(got, 10.0, span_seconds=5.0).first()
    assert (stats["flows_created"], stats["flows_evicted_stale"]) == (created, evicted)
    assert stats["peak_tracked_flow_count"] == peak
    for limit in (1, 2, 3):
        refused = simulate(rows, 10.0, limit)[4]
        row = flows.capacity_refusals(got, 10.0, limit, span_seconds=5.0, chunk_rows=7).first()
        assert (row["refused_packet_number"] if row else None) == refused


def test_previous_and_numbering_cross_chunks(spark):
    from flowloom.functions.ordered import number_rows, number_sorted, previous_value

    df = spark.range(50).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("k"),
        F.col("id").alias("n"),
        (F.col("id") * 7 % 11).alias("v"),
    )
    rows = [(r["k"], r["n"], r["v"]) for r in df.collect()]
    expected, seen = {}, {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        expected[n] = (seen.get(k, (0, None))[0] + 1, seen.get(k, (0, None))[1])
        seen[k] = (expected[n][0], v)
    for size in (1, 4, 1000):
        numbered = number_rows(df, ["k"], "n", "i", chunk_rows=size)
        both = previous_value(numbered, ["k"], "n", "v", "p", chunk_rows=size)
        assert {r["n"]: (r["i"], r["p"]) for r in both.collect()} == expected
    ordered = number_sorted(df, ["k"], ["v", "n"], "i", ranges=5).collect()
    for k in {r["k"] for r in ordered}:
        own = sorted((r for r in ordered if r["k"] == k), key=lambda r: (r["v"], r["n"]))
        assert [r["i"] for r in own] == list(range(1, len(own) + 1))
