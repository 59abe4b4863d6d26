"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowloom.session import tune

    session = (
        SparkSession.builder.master("local[8]")
        .appName("flowloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield tune(session)
    session.stop()


@pytest.fixture
def make_packets(spark):
    """Packets from ``(time, source, target, size)`` tuples in arrival order."""
    from flowloom.schemas import PACKETS

    def make(rows, capture="vpn_ssh_capture1.pcap", first=1):
        return spark.createDataFrame(
            [
                (capture, first + i, float(t), a[0], a[1], b[0], b[1], 6, size)
                for i, (t, a, b, size) in enumerate(rows)
            ],
            PACKETS,
        )

    return make
