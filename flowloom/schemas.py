"""Fixed schemas, label lists and constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Label vocabularies, in the order results are reported in.
VPN_STATUSES = ("vpn", "nonvpn")
APPLICATIONS = (
    "netflix",
    "youtube",
    "vimeo",
    "voip",
    "skype-chat",
    "ssh",
    "rdp",
    "sftp",
    "rsync",
    "scp",
)
CATEGORIES = ("STREAMING", "VOIP", "CHAT", "C2", "FILE_TRANSFER")
APPLICATION_CATEGORY = {
    "netflix": "STREAMING",
    "youtube": "STREAMING",
    "vimeo": "STREAMING",
    "voip": "VOIP",
    "skype-chat": "CHAT",
    "ssh": "C2",
    "rdp": "C2",
    "sftp": "FILE_TRANSFER",
    "rsync": "FILE_TRANSFER",
    "scp": "FILE_TRANSFER",
}
PARTITIONS = ("train", "validation", "calibration", "test")

# Window, bin and feature parameters.
WINDOW_SECONDS = 40.96
BIN_SECONDS = 0.01
MINIMUM_PACKETS = 20
SAMPLES_PER_WINDOW = 4096
WAVELET_LEVELS = 12
WAVELET_BANDS = WAVELET_LEVELS + 1
ACTIVITY_TIMEOUT_SECONDS = 5.0
LOG_EPSILON = 1e-4
FLOW_ID_HEX_LENGTH = 24

# Model and evaluation parameters.
SUPPORT_PER_CLASS = 100
SUPPORT_SEED = 17
ECE_BINS = 15
OOD_THRESHOLDS = (0.95, 0.99)
EMBEDDING_DIMENSION = 64

# Split targets and floors.
SPLIT_FRACTIONS = {"train": 0.60, "validation": 0.15, "calibration": 0.10, "test": 0.15}
MINIMUM_CATEGORY_WINDOWS = 20

# Live-session defaults.
LIVE_STALE_SECONDS = 120.0
LIVE_MAX_FLOWS = 4096
EVENT_RETENTION = 10_000

# Versions written beside every published table.
WINDOW_TABLE_VERSION = "window-table-1"
FEATURE_TABLE_VERSION = "feature-table-1"
SPLIT_MANIFEST_VERSION = "capture-split-manifest-1"
PREDICTION_EVENT_VERSION = "runtime-prediction-1"
SENSOR_MESSAGE_VERSION = "sensor-message-1"

# Rows of one ordered group that a single task may hold.  Ordered operators cut
# every group into chunks of at most this many consecutive packet numbers.
CHUNK_ROWS = 4_000_000

# Names of the 129 features, in column order.
IAT_COLUMNS = (
    "out_iat_min",
    "out_iat_max",
    "out_iat_mean",
    "out_iat_std_dev",
    "in_iat_min",
    "in_iat_max",
    "in_iat_mean",
    "in_iat_std_dev",
    "flow_iat_min",
    "flow_iat_max",
    "flow_iat_mean",
    "flow_iat_std_dev",
)
ACTIVE_IDLE_COLUMNS = (
    "active_min",
    "active_max",
    "active_mean",
    "active_std_dev",
    "idle_min",
    "idle_max",
    "idle_mean",
    "idle_std_dev",
)
AGGREGATE_COLUMNS = (
    "log_bytes_per_sec",
    "log_total_outgoing_packets",
    "log_total_incoming_packets",
    "log_total_outgoing_bytes",
    "log_total_incoming_bytes",
)
FLOW_STATISTIC_COLUMNS = IAT_COLUMNS + ACTIVE_IDLE_COLUMNS + AGGREGATE_COLUMNS
WAVELET_FAMILIES = (
    "rel_eng",
    "shannon_entropy",
    "log_mean_abs_detail_coeffs",
    "log_std_dev_detail_coeffs",
)
WAVELET_COLUMNS = tuple(
    f"{direction}_{family}_{band}"
    for family in WAVELET_FAMILIES
    for direction in ("in", "out")
    for band in range(WAVELET_BANDS)
)
FEATURE_COLUMNS = FLOW_STATISTIC_COLUMNS + WAVELET_COLUMNS

CONNECTION = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dst", T.StringType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
    ]
)

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_number", T.LongType()),
        T.StructField("timestamp_seconds", T.DoubleType()),
        T.StructField("source_address", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_address", T.StringType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("size", T.LongType()),
    ]
)

RAW_CONNECTIONS = T.StructType(
    [
        T.StructField("connection", CONNECTION),
        T.StructField("timestamps", T.ArrayType(T.DoubleType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("directions", T.ArrayType(T.ByteType())),
        T.StructField("file_names", T.StringType()),
    ]
)

# One row per window.
WINDOWS = T.StructType(
    [
        T.StructField("window_id", T.StringType(), False),
        T.StructField("capture_id", T.StringType(), False),
        T.StructField("flow_id", T.StringType(), False),
        T.StructField("window_index", T.LongType(), False),
        T.StructField("start_offset_seconds", T.DoubleType(), False),
        T.StructField("end_offset_seconds", T.DoubleType(), False),
        T.StructField("vpn_status", T.StringType(), False),
        T.StructField("application", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("packet_count", T.LongType(), False),
        T.StructField("timestamps", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("sizes", T.ArrayType(T.LongType(), False), False),
        T.StructField("directions", T.ArrayType(T.ByteType(), False), False),
    ]
)

FEATURE_IDENTITY = (
    "window_id",
    "capture_id",
    "flow_id",
    "window_index",
    "vpn_status",
    "application",
    "category",
    "packet_count",
)
FEATURES = T.StructType(
    [
        T.StructField(
            name,
            T.LongType() if name in ("window_index", "packet_count") else T.StringType(),
            False,
        )
        for name in FEATURE_IDENTITY
    ]
    + [T.StructField(name, T.FloatType(), False) for name in FEATURE_COLUMNS]
)

ASSIGNMENTS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("vpn_status", T.StringType()),
        T.StructField("application", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("windows", T.LongType()),
    ]
)
