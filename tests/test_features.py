"""Windows, flow statistics and wavelet features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from flowloom.operators import features, flows, validate, wavelet, windows
from flowloom.schemas import FEATURE_COLUMNS, FLOW_STATISTIC_COLUMNS, WINDOWS
from pyspark.sql import functions as F

A, B, S = ("10.0.0.1", 1000), ("10.0.0.2", 1000), ("192.0.2.1", 443)


def one_window(make_packets, times, directions, sizes, origin=1_000.0):
    """A first flow sets the origin; the flow under test follows it."""
    rows = [(origin, B, S, 1)]
    forward = directions[0] == 1
    for t, d, size in zip(times, directions, sizes, strict=True):
        a, b = (A, S) if (d == 1) == forward else (S, A)
        rows.append((origin + t, a, b, size))
    return flows.assign_flows(make_packets(rows)).where(
        (F.col("connection.src") == A[0]) | (F.col("connection.dst") == A[0])
    )


def statistics(assigned, seconds, **options):
    packed = windows.window_packets(assigned, seconds)
    return features.flow_statistics(
        packed, window_seconds=seconds, minimum_packets=1, policy="paper-literal", **options
    ).first()


@pytest.mark.parametrize("count,policy,kept", [
    (20, "release-compatible", 0), (21, "release-compatible", 1), (20, "paper-literal", 1),
])
def test_packet_threshold(make_packets, count, policy, kept):
    assigned = flows.assign_flows(make_packets([(100.0, A, S, i + 1) for i in range(count)]))
    got = windows.observation_windows(assigned, policy=policy)
    assert got.count() == kept
    if kept:
        row = got.first()
        assert row["sizes"] == [i + 1 for i in range(count)]
        assert row["packet_count"] == count
        assert [f.name for f in got.schema] == WINDOWS.names


def test_boundary_packet_is_in_the_later_window(make_packets):
    assigned = flows.assign_flows(make_packets([(0, A, S, 1), (9.5, A, S, 1), (10, A, S, 1)]))
    rows = windows.window_packets(assigned, 10.0).orderBy("packet_number").collect()
    assert [r["window_index"] for r in rows] == [0, 0, 1]
    assert rows[2]["offset_seconds"] == 0.0


def test_a_window_is_one_row_wherever_its_packet_numbers_lie(make_packets):
    packets = make_packets([(i * 0.01, A, S, i + 1) for i in range(50)], first=65_520)
    assigned = flows.assign_flows(packets)
    got = windows.observation_windows(assigned).collect()
    assert len(got) == 1 and got[0]["packet_count"] == 50
    assert got[0]["sizes"] == [i + 1 for i in range(50)]
    placed = windows.window_packets(assigned)
    table = windows.window_table(placed)
    assert [r["packet_count"] for r in table.collect()] == [50]
    rows = windows.window_packet_rows(placed, table).orderBy("position").collect()
    assert [(r["position"], r["size"]) for r in rows] == [(i, i + 1) for i in range(50)]


def test_a_packet_without_a_time_is_reported_and_moves_no_window(make_packets):
    packets = make_packets([(i * 2.0, A, S, i + 1) for i in range(30)])
    broken = packets.withColumn(
        "timestamp_seconds", F.when(F.col("packet_number") == 25, None).otherwise(F.col("timestamp_seconds"))
    )
    placed = windows.window_packets(flows.assign_flows(broken))
    counts = [r["packet_count"] for r in windows.window_table(placed, minimum_packets=1).orderBy("window_index").collect()]
    arrays = windows.observation_windows(flows.assign_flows(broken), minimum_packets=1)
    vectors = features.feature_vectors(placed, minimum_packets=1)
    assert counts == [21, 8]
    for form in (arrays, vectors):
        assert [r["packet_count"] for r in form.orderBy("window_index").collect()] == counts
    rules = {r["rule"] for r in validate.feature_input_violations(placed, 40.96).collect()}
    assert "window_key_missing" in rules
    sound, found = validate.sound_packets(broken)
    assert sound.count() == 29 and [r["rule"] for r in found.collect()] == ["timestamp_not_finite"]


def test_interarrival(make_packets):
    row = statistics(one_window(make_packets, [0, 1, 3, 6], [1, 0, 1, 0], [9] * 4), 10.0)
    values = [row[c] for c in FLOW_STATISTIC_COLUMNS[:12]]
    assert values == pytest.approx([3, 3, 3, 0, 5, 5, 5, 0, 1, 3, 2, math.sqrt(2 / 3)])


@pytest.mark.parametrize("times,expected", [
    ([0, 1, 7, 8, 20], [1, 1, 1, 0, 1, 7, 4, 3]),
    ([0, 5], [5, 5, 5, 0, 0, 0, 0, 0]),
    ([0, 6, 12], [0, 0, 0, 0, 1, 1, 1, 0]),
])
@pytest.mark.parametrize("chunk_rows", [1, 2, 1_000_000])
def test_active_and_idle(make_packets, times, expected, chunk_rows):
    assigned = one_window(make_packets, times, [1] * len(times), [9] * len(times))
    row = statistics(assigned, 30.0, chunk_rows=chunk_rows)
    assert [row[c] for c in FLOW_STATISTIC_COLUMNS[12:20]] == pytest.approx(expected)


def test_aggregates(make_packets):
    assigned = one_window(make_packets, [0, 1, 2], [1, 0, 1], [100, 200, 300])
    row = statistics(assigned, 10.0)
    two, one = math.log(2.0001), math.log(1.0001)
    assert [row[c] for c in FLOW_STATISTIC_COLUMNS[20:]] == pytest.approx(
        [math.log(60), two, one, two, one]
    )
    fixed = statistics(assigned, 10.0, byte_total_policy="corrected")
    assert [fixed[c] for c in FLOW_STATISTIC_COLUMNS[23:]] == pytest.approx(
        [math.log(400.0001), math.log(200.0001)]
    )


def test_bins(make_packets):
    assigned = one_window(
        make_packets, [0.001, 0.009, 0.010, 40.95], [0, 0, 1, 1], [10, 20, 30, 40], origin=0.0
    )
    # The first packet opens the flow forward, so directions come out flipped.
    got = features.size_bins(windows.window_packets(assigned, 40.96)).collect()
    cells = {(r["direction"], r["bin"]): r["bytes"] for r in got}
    assert cells == {(1, 0): 30, (0, 1): 30, (0, 4095): 40}


def test_empty_signal():
    values = wavelet.band_statistics(np.zeros((1, 4096)))[0]
    assert np.allclose(values[:2], 0.0)
    assert np.allclose(values[2:], math.log(1e-4))


def test_impulse_keeps_its_energy():
    signal = np.zeros((1, 4096))
    signal[0, 123] = 4.0
    bands = wavelet.haar_bands(signal)
    assert len(bands) == 13
    assert sum(float((b * b).sum()) for b in bands) == pytest.approx(16.0)
    louder = wavelet.haar_bands(signal, energy_preserving=False)
    assert np.allclose(louder[-1], bands[-1] * 2**0.5)
    assert np.allclose(louder[0], bands[0] * 2**6)


def direct_features(times, sizes, directions, seconds, timeout=5.0):
    """All 129 values by plain NumPy on one window."""

    def summary(v):
        return [v.min(), v.max(), v.mean(), v.std()] if v.size else [0.0] * 4

    t, s, d = np.asarray(times), np.asarray(sizes), np.asarray(directions)
    values = summary(np.diff(t[d == 1])) + summary(np.diff(t[d == 0])) + summary(np.diff(t))
    gaps = np.diff(t)
    cut = np.flatnonzero(gaps > timeout)
    spans = t[np.append(cut, t.size - 1)] - t[np.append(0, cut + 1)]
    values += summary(spans[spans > 0]) + summary(gaps[cut] - timeout)
    logs = [math.log(n + 1e-4) if n else 0.0 for n in ((d == 1).sum(), (d == 0).sum())]
    values += [math.log(s.sum() / seconds), *logs, *logs]
    families = []
    for side in (0, 1):
        x = np.zeros(4096)
        np.add.at(x, np.floor(t[d == side] / (seconds / 4096)).astype(int), s[d == side])
        details, a = [], x
        for level in range(12):
            b = np.roll(a, -(2**level))
            details.append((a - b) / 2)
            a = (a + b) / 2
        bands = np.stack([a, *reversed(details)])
        energy = (bands**2).sum(axis=1)
        share = np.divide(bands**2, energy[:, None], out=np.zeros_like(bands), where=energy[:, None] > 0)
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        families.append([
            energy / energy.sum() if energy.sum() else energy,
            entropy,
            np.log(np.abs(bands).mean(axis=1) + 1e-4),
            np.log(bands.std(axis=1) + 1e-4),
        ])
    for family in range(4):
        for side in (0, 1):
            values += list(families[side][family])
    return np.asarray(values)


@pytest.mark.parametrize("chunk_rows", [5, 1_000_000])
def test_feature_vector_matches_numpy(make_packets, chunk_rows):
    source = np.random.default_rng(3)
    rows, t = [], 1_700_000_000.0
    for _ in range(400):
        t += float(source.choice([0.0, 0.01, 0.2, 6.0], p=[0.1, 0.5, 0.36, 0.04]))
        ends = (A, S) if source.random() < 0.6 else (B, S)
        rows.append((t, *(ends if source.random() < 0.5 else ends[::-1]), int(source.integers(40, 1500))))
    packed = windows.window_packets(flows.assign_flows(make_packets(rows)), 40.96).cache()
    got = features.feature_vectors(packed, minimum_packets=5, chunk_rows=chunk_rows).collect()
    held = {}
    for r in packed.orderBy("packet_number").collect():
        key = f"{r['capture_id']}:{r['flow_id']}:{r['window_index']}"
        held.setdefault(key, []).append((r["offset_seconds"], r["size"], r["direction"]))
    held = {k: v for k, v in held.items() if len(v) > 5}
    assert {r["window_id"] for r in got} == set(held) and len(got) > 4
    for r in got:
        times, sizes, sides = zip(*held[r["window_id"]], strict=True)
        expected = direct_features(times, sizes, sides, 40.96)
        actual = np.array([r[c] for c in FEATURE_COLUMNS])
        assert np.allclose(actual, expected, rtol=2e-6, atol=2e-6)


def test_stored_windows_give_the_same_features(make_packets):
    rows = [(i * 0.3, A if i % 4 else S, S if i % 4 else A, 40 + i) for i in range(90)]
    assigned = flows.assign_flows(make_packets(rows))
    direct = features.feature_vectors(windows.window_packets(assigned))
    stored = features.feature_vectors(
        windows.packets_of_windows(windows.observation_windows(assigned))
    )
    assert direct.exceptAll(stored).count() == 0 and direct.count() == stored.count() > 0


def test_window_and_bin_lengths_must_fit():
    with pytest.raises(ValueError):
        features.check_bins(40.96, 0.02)
    with pytest.raises(ValueError):
        windows.check_window(0.0)


def test_few_filled_bins_are_transformed_without_the_dense_signal(monkeypatch):
    draw = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 40, wavelet._SPARSE_BINS, wavelet._SPARSE_BINS + 1, 4096]
    places = [draw.choice(4096, n, replace=False).tolist() for n in sizes] + [[0], [4095, 0, 2048]]
    amounts = [draw.integers(40, 1500, len(p)).tolist() for p in places]
    bins, sums = pa.array(places, pa.list_(pa.int32())), pa.array(amounts, pa.list_(pa.int64()))
    wanted = wavelet.band_statistics(wavelet._dense(bins, sums, 0, len(places)))
    built = []
    dense = wavelet._dense
    monkeypatch.setattr(
        wavelet, "_dense", lambda b, s, start, stop: built.append(stop) or dense(b, s, start, stop)
    )
    got = wavelet._signal_statistics(bins, sums)
    assert built == [2]  # only the signals with many filled bins
    np.testing.assert_allclose(got, wanted, rtol=1e-12, atol=1e-11)


def test_spans_are_merged_without_sorting_them_again(make_packets):
    assigned = flows.assign_flows(make_packets([(i * 0.5, A, S, i + 1) for i in range(30)]))
    found = features.flow_statistics(windows.window_packets(assigned))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Window [") == 3  # those that find the runs of a chunk


def test_merged_spans_equal_their_gaps_one_by_one():
    draw = np.random.default_rng(5)
    rows, wanted = [], []
    for _ in range(40):
        at, spans, gaps, seen = 0.0, [], [], None
        for place in range(int(draw.integers(1, 7))):
            at += float(draw.uniform(0.1, 9.0))
            times = at + np.cumsum(draw.uniform(0.0, 0.9, int(draw.integers(1, 5))))
            at = float(times[-1])
            steps = np.diff(times)
            gaps += ([] if seen is None else [times[0] - seen]) + list(steps)
            seen = at
            span = {"_chunk": place // 2, "_run": place % 2}
            for scope in ("out", "flow"):
                span |= {f"{scope}_first": float(times[0]), f"{scope}_last": at}
                span |= {f"{scope}_gap_n": len(steps)}
                if len(steps):
                    moments = (steps.min(), steps.max(), steps.mean(), len(steps) * steps.var())
                    for part, value in zip(("min", "max", "mean", "m2"), moments, strict=True):
                        span[f"{scope}_gap_{part}"] = float(value)
            spans.append({name: span.get(name) for name in features._SPAN_FIELDS} | {"in_gap_n": 0})
        rows.append(spans[::-1])
        wanted.append([min(gaps), max(gaps), np.mean(gaps), np.std(gaps)] if gaps else [0.0] * 4)
    kinds = {n: pa.int64() if n in ("_chunk", "_run") or n.endswith("_n") else pa.float64()
             for n in features._SPAN_FIELDS}
    got = features.merged_spans(pa.array(rows, pa.list_(pa.struct(list(kinds.items())))), 1.0)
    assert np.allclose(got[:, 0], wanted, atol=1e-12) and np.allclose(got[:, 2], wanted, atol=1e-12)
    assert not got[:, 1].any()  # no packet came in
