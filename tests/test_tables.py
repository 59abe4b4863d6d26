"""Sources, sinks, manifests, splits, labels and history rules."""

from __future__ import annotations

import random
import struct

import pytest
from flowloom.functions.labels import capture_labels, category_of
from flowloom.operators import flows, splits, validate, windows
from flowloom.operators.features import feature_vectors
from flowloom.operators.history import LIVE_TRANSITIONS, fail_interrupted, lifecycle_violations
from flowloom.operators.summary import dataset_summary, raw_connection_counts
from flowloom.plans import pipelines
from flowloom.schemas import APPLICATION_CATEGORY, APPLICATIONS, PARTITIONS, RAW_CONNECTIONS
from flowloom.session import scratch_path
from flowloom.sinks import tables
from flowloom.sources import artifacts, captures, messages
from flowloom.sources.packets import connection_packets
from pyspark.sql import functions as F


def ipv4(source, target, protocol, body, *, flags=0x4000, version=4, length=None):
    total = 20 + len(body) if length is None else length
    return struct.pack(
        ">BBHHHBBH4s4s", version << 4 | 5, 0, total, 1, flags, 64, protocol, 0,
        bytes(map(int, source.split("."))), bytes(map(int, target.split("."))),
    ) + body


def tcp(sport, dport, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 5 << 4, 16, 1024, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def capture(records, *, order="<", link=101, nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for seconds, part, raw in records:
        data += struct.pack(order + "IIII", seconds, part, len(raw), len(raw)) + raw
    return data


A, B = "10.0.0.1", "10.0.0.2"


def test_capture_files_in_small_ranges(spark, tmp_path):
    records = [
        (100, 250_000 + i, ipv4(A, B, 6, tcp(1000, 443, b"x" * i)) if i % 2 else ipv4(B, A, 17, udp(53, 999, b"yy")))
        for i in range(40)
    ]
    (tmp_path / "vpn_ssh_capture1.pcap").write_bytes(capture(records))
    (tmp_path / "nonvpn_scp_capture2.pcap").write_bytes(capture(records[:3], order=">", nano=True))
    packets, faults = captures.read_captures(spark, str(tmp_path), range_bytes=200)
    assert faults.count() == 0
    rows = packets.where("capture_id like 'vpn%'").orderBy("packet_number").collect()
    assert [r["packet_number"] for r in rows] == list(range(1, 41))
    assert rows[1]["timestamp_seconds"] == 100 + 250_001 / 1e6
    assert (rows[1]["source_address"], rows[1]["source_port"], rows[1]["size"]) == (A, 1000, 41)
    assert (rows[0]["protocol"], rows[0]["destination_port"], rows[0]["size"]) == (17, 999, 10)
    nano = packets.where("capture_id like 'nonvpn%'").orderBy("packet_number").first()
    assert nano["timestamp_seconds"] == (100 * 10**9 + 250_000) / 10**9
    full, _ = captures.read_captures(spark, str(tmp_path), size_policy="ip-packet")
    assert full.where("protocol = 17").first()["size"] == 30


def test_capture_faults_are_named(spark, tmp_path):
    good = ipv4(A, B, 6, tcp(1, 2))
    broken = {
        "vpn_ssh_a.pcap": b"nothing",
        "vpn_ssh_b.pcap": capture([(1, 0, good)], link=1),
        "vpn_ssh_c.pcap": capture([(1, 0, good)])[:-5],
        "vpn_ssh_d.pcap": capture([
            (1, 0, b""), (1, 1, ipv4(A, B, 6, tcp(1, 2), version=6)), (1, 2, good[:10]),
            (1, 3, ipv4(A, B, 6, tcp(1, 2), length=99)), (1, 4, ipv4(A, B, 6, tcp(1, 2), flags=0x2000)),
            (1, 5, ipv4(A, B, 47, b"abcd")), (1, 6, ipv4(A, B, 17, b"abc")), (1, 7, ipv4(A, B, 1, b"\x08\0\0\0")),
        ]),
    }
    for name, data in broken.items():
        (tmp_path / name).write_bytes(data)
    packets, faults = captures.read_captures(spark, str(tmp_path))
    found = {(r["key"], r["rule"]) for r in faults.collect()}
    d = {rule for key, rule in found if key == "vpn_ssh_d.pcap"}
    assert d == {
        "empty", "ip_version", "malformed_ipv4", "truncated", "fragmented",
        "unsupported_protocol", "malformed_transport",
    }
    assert {("vpn_ssh_a.pcap", "file_header"), ("vpn_ssh_b.pcap", "link_type"),
            ("vpn_ssh_c.pcap", "truncated_record")} <= found
    assert captures.valid_packets(packets).first()["source_port"] == 0
    with pytest.raises(validate.ContractError):
        pipelines.capture_windows(spark, str(tmp_path))


def test_capture_files_to_features(spark, tmp_path):
    records = [(100 + i // 4, i % 4 * 1000, ipv4(*((A, B) if i % 3 else (B, A)), 6, tcp(*((1, 2) if i % 3 else (2, 1)), b"z" * i))) for i in range(60)]
    (tmp_path / "vpn_ssh_capture1.pcap").write_bytes(capture(records))
    got = pipelines.capture_features(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["packet_count"] == 60 and got[0]["category"] == "C2"
    held = pipelines.capture_windows(spark, str(tmp_path)).first()
    assert held["window_id"] == got[0]["window_id"] and len(held["sizes"]) == 60


def test_raw_connections(spark):
    key = (A, 1, B, 2, 6)
    df = spark.createDataFrame(
        [(key, [102.0, 100.0, 100.0], [1, 2, 3], [0, 1, 1], "vpn_ssh_x.pcap"),
         ((B, 5, A, 6, 17), [99.0], [9], [1], "vpn_ssh_x.pcap")],
        RAW_CONNECTIONS,
    )
    assert validate.raw_connection_violations(df).count() == 0
    summary = dataset_summary(raw_connection_counts(df)).first()
    assert (summary["connections"], summary["packets"], summary["captures"]) == (2, 4, 1)
    assert summary["median_packets"] == 2.0
    rows = connection_packets(df).where("connection.proto = 6").orderBy("packet_number").collect()
    assert [(r["timestamp_seconds"], r["size"]) for r in rows] == [(100.0, 2), (100.0, 3), (102.0, 1)]
    assert {r["capture_origin"] for r in rows} == {99.0}
    bad = spark.createDataFrame(
        [(key, [1.0], [1, 2], [1], "vpn_ssh_x.pcap"), (key, [float("nan")], [-1], [2], "other.txt"),
         ((A, 70000, B, 2, 300), [], [], [], "vpn_ssh_x.pcap"), (key, [1.0], [1], [1], "vpn_ssh_x.pcap")],
        RAW_CONNECTIONS,
    )
    rules = {r["rule"] for r in validate.raw_connection_violations(bad).collect()}
    assert rules == {
        "array_length", "array_empty", "timestamp_not_finite", "size_negative", "direction_value",
        "file_name", "connection_port", "connection_protocol", "connection_duplicate",
    }


def test_connection_windows_equal_the_packet_path(spark):
    source = random.Random(8)
    rows = []
    for c in range(3):
        for k in range(4):
            n = source.randint(1, 120)
            times = [1e9 + source.choice([0, 1, 40.96, 81.92]) + round(source.random() * 60, 2) for _ in range(n)]
            rows.append((("a", k, "b", 2, 6), times, [source.randint(0, 99) for _ in range(n)],
                         [source.randint(0, 1) for _ in range(n)], f"vpn_ssh_{c}.pcap"))
    df = spark.createDataFrame(rows, RAW_CONNECTIONS)
    packets = connection_packets(df)
    whole = windows.connection_windows(df, minimum_packets=5)
    shuffled = windows.observation_windows(packets, minimum_packets=5)
    assert whole.exceptAll(shuffled).count() == 0 and whole.count() == shuffled.count() > 10


def test_flow_rows_become_raw_connections(make_packets):
    assigned = flows.assign_flows(make_packets([(1, (A, 1), (B, 2), 5), (2, (B, 2), (A, 1), 6)]))
    raw = flows.raw_connections(flows.flow_table(assigned))
    assert raw.columns == [f.name for f in RAW_CONNECTIONS]
    assert validate.raw_connection_violations(raw).count() == 0


@pytest.mark.parametrize("name,expected", [
    ("VPN_YOUTUBE_CAPTURE2.PCAP", ("vpn", "youtube", "STREAMING", None)),
    ("dir/nonvpn_skype-chat_1.pcap", ("nonvpn", "skype-chat", "CHAT", None)),
    ("vpn_ssh_1.txt", (None, None, None, "extension")),
    ("proxy_ssh_1.pcap", (None, None, None, "prefix")),
    ("vpn_mail_1.pcap", (None, None, None, "application")),
    ("vpn_ssh_sftp.pcap", (None, None, None, "application")),
])
def test_capture_names(spark, name, expected):
    row = capture_labels(spark.createDataFrame([(name,)], "file_name string")).first()
    assert (row["vpn_status"], row["application"], row["category"], row["label_fault"]) == expected
    assert row["capture_id"] == name.split("/")[-1]


def test_messages(spark):
    packet = '{"timestamp_seconds":1.5,"source_address":"a","source_port":1,"destination_address":"b","destination_port":2,"protocol":6,"size":SIZE}'
    text = '{"schema_version":"sensor-message-1","type":"packet","packet":' + packet + "}"
    lines = [
        (text.replace("SIZE", "10"), None), (text.replace("SIZE", "0"), "size"),
        (text.replace("SIZE", '"10"'), "integer"), (text.replace("SIZE", "1.0"), "integer"),
        (text.replace("SIZE", "10")[:-2], "json"),
        (text.replace("SIZE", "10").replace("message-1", "message-2"), "schema_version"),
        (text.replace("SIZE", "10").replace('"type":"packet"', '"type":"other"'), "type"),
        (text.replace("SIZE", "10").replace('"protocol":6', '"protocol":300'), "protocol"),
        (text.replace("SIZE", "10").replace('"a"', '""'), "address"),
        ('{"schema_version":"sensor-message-1","type":"ready","interface":"eth0"}', None),
        ('{"schema_version":"sensor-message-1","type":"ready","interface":" "}', "interface"),
        ('{"schema_version":"sensor-message-1","type":"error","code":"x"}', "fields"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "i int, value string")
    got = {r["i"]: r["fault"] for r in messages.parse_messages(df).collect()}
    assert got == {i: f for i, (_, f) in enumerate(lines)}
    assert messages.packet_messages(df).count() == 1


def groups(spark, without=None):
    rows = []
    for i, application in enumerate(
        a for a in APPLICATIONS for _ in range(8 if a in ("voip", "skype-chat") else 4)
    ):
        category = APPLICATION_CATEGORY[application]
        if category != without:
            rows.append((f"c{i:03d}", ("vpn", "nonvpn")[i % 2], application, category, 25 + i))
    return spark.createDataFrame(
        rows, "capture_id string, vpn_status string, application string, category string, windows bigint"
    )


def test_split_search_meets_every_constraint(spark):
    found = splits.search_split(groups(spark), seeds=32, rounds=2)
    assert found.count() == groups(spark).count()
    assert splits.split_coverage(found).where("not covered").count() == 0
    graded = splits.grade_splits(splits.candidate_splits(groups(spark), seeds=32))
    best = graded.where("violations = 0").agg(F.min("objective")).first()[0]
    assert splits.split_objective(found).first()["objective"] <= best + 1e-9
    again = splits.search_split(groups(spark), seeds=32, rounds=2)
    assert found.exceptAll(again).count() == 0


def test_split_search_grades_kinds_of_captures_as_single_captures(spark, monkeypatch):
    names = F.array(*[F.lit(a) for a in APPLICATIONS])
    many = spark.range(900).select(
        F.concat(F.lit("c"), "id").alias("capture_id"),
        F.when(F.floor(F.col("id") / 10) % 2 == 0, "vpn").otherwise("nonvpn").alias("vpn_status"),
        F.element_at(names, (F.col("id") % len(APPLICATIONS) + 1).cast("int")).alias("application"),
        (5 + F.pmod(F.xxhash64("id"), F.lit(12))).alias("windows"),
    )
    many = many.withColumn("category", category_of(F.col("application")))
    found = splits.search_split(many, seeds=2)
    # Moves are no longer looked up in literals that each round adds to the plan.
    assert "element_at" not in found._jdf.queryExecution().optimizedPlan().toString()
    start = splits.search_split(many, seeds=2, rounds=0)
    assert found.exceptAll(start).count() > 0
    holdings = splits._Holdings(splits._cells(found, []).collect())
    assert splits._best_moves(found, holdings.cells(), 20, 1) == []
    monkeypatch.setattr(splits, "MOST_MOVES", 16)
    by_kind = splits.search_split(many, seeds=2, rounds=4)
    monkeypatch.setattr(splits, "MOST_KINDS", 0)
    singly = splits.search_split(many, seeds=2, rounds=4)
    assert by_kind.exceptAll(singly).count() == 0 and by_kind.count() == 900


def test_infeasible_split_is_refused(spark):
    with pytest.raises(splits.SplitError):
        splits.search_split(groups(spark, without="VOIP"), seeds=8)


def test_published_tables_read_back(spark, make_packets):
    folder = scratch_path(spark, "published")
    packets = make_packets([(i * 0.3, (A, 1), (B, 2), 40 + i) for i in range(200)])
    quiet = make_packets([(0, (A, 1), (B, 2), 40)], capture="nonvpn_scp_capture9.pcap")
    assigned = flows.assign_flows(packets.unionByName(quiet))
    held = windows.observation_windows(assigned)
    path = f"{folder}/windows.parquet"
    tables.export_windows(held, assigned, path, window_seconds=40.96, minimum_packets=20)
    stored = artifacts.read_windows(spark, path)
    assert stored.count() == held.count() and validate.window_violations(stored).count() == 0
    manifest = artifacts.read_manifest(spark, path).first()
    assert manifest["summary"]["windows"] == held.count()
    assert manifest["summary"]["omitted_capture_count"] == 1
    omitted = spark.read.json(f"{path}.manifest/omitted_captures").first()
    assert omitted["capture_id"] == "nonvpn_scp_capture9.pcap"
    assert artifacts.require_fingerprint(spark, path, manifest["output"]["sha256"])
    with pytest.raises(validate.ContractError):
        artifacts.require_fingerprint(spark, path, "0" * 64)
    with pytest.raises(validate.ContractError):
        tables.export_windows(held, assigned, path, window_seconds=40.96, minimum_packets=20)
    with pytest.raises(validate.ContractError):
        tables.check_destination(spark, f"{folder}/windows.csv", ".parquet")
    vectors = feature_vectors(windows.packets_of_windows(stored))
    where = f"{folder}/features.parquet"
    tables.export_features(vectors, where, configuration={"window_seconds": 40.96})
    features = artifacts.read_features(spark, where)
    assert validate.feature_violations(features).count() == 0
    assert features.count() == held.count()
    labels = artifacts.read_feature_labels(spark, where)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "flow_iat_min" not in plan.split("ReadSchema")[1]
    with pytest.raises(validate.ContractError):
        artifacts.read_features(spark, path)


def test_split_manifest_and_partitioned_rows(spark):
    folder = scratch_path(spark, "split")
    found = splits.search_split(groups(spark), seeds=16, rounds=0)
    path = f"{folder}/split.json"
    tables.export_split_manifest(found, path, source_sha256="x", seeds=16)
    stored = artifacts.read_split_manifest(spark, path)
    assert stored.select(*found.columns).exceptAll(found).count() == 0
    rows = found.select("capture_id", "vpn_status", "application", "category", F.explode(F.sequence(F.lit(1), "windows")).alias("n"))
    assert splits.partition_faults(rows, stored).count() == 0
    joined = splits.join_partitions(rows, stored)
    tables.write_partitioned(joined, f"{folder}/rows")
    train = spark.read.parquet(f"{folder}/rows").where("partition = 'train'")
    assert "PartitionFilters: [isnotnull(partition" in train._jdf.queryExecution().executedPlan().toString()
    assert set(joined.select("partition").distinct().toPandas()["partition"]) == set(PARTITIONS)


def test_live_lifecycle_and_restart(spark):
    log = spark.createDataFrame(
        [("a", 1, "starting", None, None), ("a", 2, "running", None, None), ("a", 3, "completed", None, None),
         ("b", 4, "starting", None, None), ("b", 5, "failed", "x", "y")],
        "run_id string, change_seq bigint, state string, failure_code string, failure_message string",
    )
    got = lifecycle_violations(log, LIVE_TRANSITIONS, chunk_rows=2).collect()
    assert [(r["rule"], r["key"], r["detail"]) for r in got] == [("transition", "a:3", "running>completed")]
    changed = fail_interrupted(log).where("changed")
    assert changed.count() == 3 and changed.select("state").distinct().first()[0] == "failed"


def test_published_rows_hold_no_addresses():
    from flowloom.schemas import FEATURES, WINDOWS

    for schema in (WINDOWS, FEATURES):
        assert not {"src", "dst", "source_address", "connection", "raw"} & set(schema.names)
    assert not {"timestamps", "sizes", "directions"} & set(FEATURES.names)


def test_feature_input_rules(make_packets):
    packed = windows.window_packets(
        flows.assign_flows(make_packets([(i, (A, 1), (B, 2), 5) for i in range(4)])), 10.0
    )
    assert validate.feature_input_violations(packed, 10.0).count() == 0
    broken = packed.withColumns({
        "offset_seconds": F.when(F.col("packet_number") == 2, 99.0).otherwise(F.col("offset_seconds")),
        "direction": F.when(F.col("packet_number") == 3, 7).otherwise(F.col("direction")),
        "size": F.lit(0),
    })
    rules = {r["rule"] for r in validate.feature_input_violations(broken, 10.0, chunk_rows=1).collect()}
    assert rules == {"offset_outside_window", "offset_regression", "direction_value", "window_without_bytes"}


def test_float_columns_are_stored_without_dictionaries(spark, make_packets, tmp_path):
    import pyarrow.parquet as pq

    packets = make_packets([(i * 0.3, (A, 1), (B, 2), 40 + i) for i in range(200)])
    vectors = feature_vectors(windows.window_packets(flows.assign_flows(packets)))
    path = tmp_path / "features.parquet"
    tables.export_features(vectors, str(path), configuration={"window_seconds": 40.96})
    group = pq.ParquetFile(next(path.glob("part-*"))).metadata.row_group(0)
    columns = {c.path_in_schema: c for c in map(group.column, range(group.num_columns))}
    assert not columns["flow_iat_mean"].has_dictionary_page
    assert columns["capture_id"].has_dictionary_page
    assert artifacts.read_features(spark, str(path)).count() == vectors.count()
