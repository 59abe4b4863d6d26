"""Flow statistics and the 129-value feature vector of a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.labels import capture_labels, window_id
from flowloom.functions.ordered import chunk_of
from flowloom.functions.plan import with_keys
from flowloom.operators.wavelet import wavelet_features
from flowloom.operators.windows import RELEASE_COMPATIBLE, WINDOW_KEY, check_window, retained
from flowloom.schemas import (
    ACTIVITY_TIMEOUT_SECONDS,
    BIN_SECONDS,
    CHUNK_ROWS,
    FEATURE_COLUMNS,
    FEATURE_IDENTITY,
    FLOW_STATISTIC_COLUMNS,
    LOG_EPSILON,
    MINIMUM_PACKETS,
    SAMPLES_PER_WINDOW,
    WAVELET_COLUMNS,
    WINDOW_SECONDS,
)

BYTES_RELEASE_COMPATIBLE = "release-compatible"
BYTES_CORRECTED = "corrected"

# Inter-arrival scopes: outgoing packets, incoming packets, all packets.
_SCOPES = ("out", "in", "flow")


def _covers(scope: str) -> Column:
    if scope == "flow":
        return F.lit(True)
    return F.col("direction") == (1 if scope == "out" else 0)


def check_bins(window_seconds: float, bin_seconds: float) -> None:
    """Window and bin lengths must give exactly the transform's sample count."""
    check_window(window_seconds)
    if not bin_seconds > 0 or abs(window_seconds / bin_seconds - SAMPLES_PER_WINDOW) > 1e-9:
        raise ValueError(f"a window has to hold exactly {SAMPLES_PER_WINDOW} bins")


def _moments(value: Column, prefix: str) -> list[Column]:
    """Count, range, mean and centred second moment of the non-null values."""
    return [
        F.count(value).alias(f"{prefix}_n"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
        F.avg(value).alias(f"{prefix}_mean"),
        (F.var_pop(value) * F.count(value)).alias(f"{prefix}_m2"),
    ]


def in_chunks(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Window packets shuffled by window and bounded packet-number chunk."""
    if "_chunk" in packets.columns:
        return packets
    chunked = with_keys(
        packets.withColumn("_chunk", chunk_of("packet_number", chunk_rows)), *WINDOW_KEY, "_chunk"
    )
    return chunked.repartition(*WINDOW_KEY, "_chunk")


def activity_spans(
    packets: DataFrame,
    *,
    activity_timeout: float = ACTIVITY_TIMEOUT_SECONDS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Summarise each run of packets without a gap above the timeout.

    Runs are found inside ``(window, chunk)`` groups, so a run crossing a chunk
    border gives one row per chunk; a window has at most
    ``window / timeout + chunks + 1`` rows whatever its packet count.  Each row
    carries byte and packet totals and, per scope, the moments of the gaps
    between neighbouring packets of that scope inside the row.
    """
    chunk = Window.partitionBy(*WINDOW_KEY, "_chunk").orderBy("packet_number")
    upto = chunk.rowsBetween(Window.unboundedPreceding, 0)
    before = chunk.rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("offset_seconds")
    breaks = at - F.lag("offset_seconds").over(chunk) > F.lit(float(activity_timeout))
    runs = (
        in_chunks(packets, chunk_rows)
        .withColumn("_breaks", F.coalesce(breaks, F.lit(False)))
        .withColumn("_run", F.sum(F.col("_breaks").cast("bigint")).over(upto))
        .withColumns(
            {
                f"_seen_{scope}": F.last(
                    F.when(_covers(scope), F.struct("_run", "offset_seconds")), ignorenulls=True
                ).over(before)
                for scope in _SCOPES
            }
        )
    )
    gaps = {
        scope: F.when(
            _covers(scope) & (F.col(f"_seen_{scope}._run") == F.col("_run")),
            at - F.col(f"_seen_{scope}.offset_seconds"),
        )
        for scope in _SCOPES
    }
    out, inward = _covers("out"), _covers("in")
    return runs.groupBy(*WINDOW_KEY, "_chunk", "_run").agg(
        F.min(at).alias("flow_first"),
        F.max(at).alias("flow_last"),
        F.min(F.when(out, at)).alias("out_first"),
        F.max(F.when(out, at)).alias("out_last"),
        F.min(F.when(inward, at)).alias("in_first"),
        F.max(F.when(inward, at)).alias("in_last"),
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(out, 1)).alias("out_packets"),
        F.sum("size").alias("bytes"),
        F.sum(F.when(out, F.col("size")).otherwise(0)).alias("out_bytes"),
        *[column for scope in _SCOPES for column in _moments(gaps[scope], f"{scope}_gap")],
    )


#: Fields of an activity span that the merge reads; bounds and gaps are per scope.
_SPAN_FIELDS = (
    "_chunk",
    "_run",
    *[f"{scope}_{end}" for scope in _SCOPES for end in ("first", "last")],
    *[f"{scope}_gap_{part}" for scope in _SCOPES for part in ("n", "min", "max", "mean", "m2")],
)
#: Sets of gaps and spans whose least, greatest, mean and deviation are features.
_MERGED = (*[f"{scope}_iat" for scope in _SCOPES], "active", "idle")


def _largest_before(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Largest earlier value of the same owner, NaN where there is none.

    Owners come one after another.  Maxima are taken over ranks that lie above those of
    all owners before, so one running maximum serves them all and values stay exact.
    """
    held = np.where(np.isnan(values), -np.inf, values)
    order = np.argsort(held, kind="stable")
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    reached = np.maximum.accumulate(owner * len(held) + rank) - owner * len(held)
    found = np.full(len(held), np.nan)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    found[same + 1] = held[order[reached[same]]]
    found[np.isneginf(found)] = np.nan
    return found


def merged_spans(spans: pa.ListArray, timeout: float) -> np.ndarray:
    """``[windows, 5 sets, min, max, mean, deviation]`` of the spans of each window.

    A span's gaps are given as moments; the steps between spans, idle times and the
    lengths of islands of spans are single values.  Sums run in the order of the spans.
    """
    lengths = np.asarray(spans.value_lengths(), dtype=np.int64)
    rows = spans.flatten()
    owner = np.repeat(np.arange(len(spans)), lengths)
    fields = {
        name: rows.field(name).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        for name in _SPAN_FIELDS[2:]
    }
    order = np.lexsort((np.asarray(rows.field("_run")), np.asarray(rows.field("_chunk")), owner))
    fields = {name: values[order] for name, values in fields.items()}
    singles = {
        # Timestamps never decrease, so the largest earlier value is the latest.
        f"{scope}_iat": fields[f"{scope}_first"] - _largest_before(owner, fields[f"{scope}_last"])
        for scope in _SCOPES
    }
    splits = singles["flow_iat"] > timeout
    singles["idle"] = np.where(splits, singles["flow_iat"] - timeout, np.nan)
    starts = np.cumsum(lengths) - lengths
    begins = splits.copy()
    begins[starts] = True
    # An active span may cross chunks: its first row carries the whole length.
    island = np.flatnonzero(begins)
    lasting = np.maximum.reduceat(fields["flow_last"], island) - np.minimum.reduceat(
        fields["flow_first"], island
    )
    singles["active"] = np.full(len(owner), np.nan)
    singles["active"][island] = np.where(lasting > 0.0, lasting, np.nan)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, np.where(np.isnan(values), 0.0, values), len(spans))

    result = np.zeros((len(spans), len(_MERGED), 4))
    for at, name in enumerate(_MERGED):
        single = singles[name]
        one = (~np.isnan(single)).astype(np.float64)
        count, total = summed(one), summed(single)
        least = greatest = single
        scope = name.removesuffix("_iat")
        if scope != name:
            inner, mean = fields[f"{scope}_gap_n"], fields[f"{scope}_gap_mean"]
            count = count + summed(inner)
            total = total + summed(inner * mean)
            least = np.fmin(single, fields[f"{scope}_gap_min"])
            greatest = np.fmax(single, fields[f"{scope}_gap_max"])
        some = count > 0.0
        centre = np.divide(total, count, out=np.zeros_like(total), where=some)
        shifted = single - centre[owner]
        spread = summed(shifted * shifted)
        if scope != name:
            shifted = mean - centre[owner]
            spread = spread + summed(fields[f"{scope}_gap_m2"] + inner * shifted * shifted)
        result[some, at, 0] = np.fmin.reduceat(least, starts)[some]
        result[some, at, 1] = np.fmax.reduceat(greatest, starts)[some]
        result[:, at, 2] = centre
        result[some, at, 3] = np.sqrt(spread[some] / count[some])
    return result


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _merged_statistics(spans: pa.Array, timeout: pa.Array) -> pa.Array:
    """20 values per window: set, then least, greatest, mean and deviation."""
    width = len(_MERGED) * 4
    found = merged_spans(spans, timeout[0].as_py())
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (len(spans) + 1) * width, width, dtype=np.int32)),
        pa.array(found.reshape(-1)),
    )


def _logged(total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.log(total + F.lit(LOG_EPSILON)))


def flow_statistics(
    packets: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    activity_timeout: float = ACTIVITY_TIMEOUT_SECONDS,
    byte_total_policy: str = BYTES_RELEASE_COMPATIBLE,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The 25 flow statistics of every retained window, as doubles.

    Inter-arrival, active / idle and aggregate values are all merged from the
    rows of :func:`activity_spans`, so the packets are shuffled once.  A window's
    spans, of which their text gives the bound, are gathered in one row.
    """
    if byte_total_policy not in (BYTES_RELEASE_COMPATIBLE, BYTES_CORRECTED):
        raise ValueError(f"unknown byte total policy {byte_total_policy!r}")
    spans = activity_spans(packets, activity_timeout=activity_timeout, chunk_rows=chunk_rows)
    out_packets, out_bytes = F.sum("out_packets"), F.sum("out_bytes")
    in_packets = F.sum("packets") - out_packets
    in_bytes = F.sum("bytes") - out_bytes
    by_count = byte_total_policy == BYTES_RELEASE_COMPATIBLE
    merged = [f"{name}_{part}" for name in _MERGED for part in ("min", "max", "mean", "std_dev")]
    return (
        spans.groupBy(*WINDOW_KEY)
        .agg(
            F.sum("packets").alias("packet_count"),
            F.collect_list(F.struct(*_SPAN_FIELDS)).alias("_spans"),
            F.log(F.sum("bytes") / F.lit(float(window_seconds))).alias("log_bytes_per_sec"),
            _logged(out_packets).alias("log_total_outgoing_packets"),
            _logged(in_packets).alias("log_total_incoming_packets"),
            _logged(out_packets if by_count else out_bytes).alias("log_total_outgoing_bytes"),
            _logged(in_packets if by_count else in_bytes).alias("log_total_incoming_bytes"),
        )
        .where(retained(F.col("packet_count"), minimum_packets, policy))
        .withColumn("_merged", _merged_statistics("_spans", F.lit(float(activity_timeout))))
        .withColumns({name: F.col("_merged")[i] for i, name in enumerate(merged)})
        .select(*WINDOW_KEY, "packet_count", *FLOW_STATISTIC_COLUMNS)
    )


def size_bins(packets: DataFrame, *, bin_seconds: float = BIN_SECONDS) -> DataFrame:
    """Bytes per window, direction and time bin (bins without packets left out)."""
    return (
        packets.withColumn(
            "bin", F.floor(F.col("offset_seconds") / F.lit(float(bin_seconds))).cast("int")
        )
        .groupBy(*WINDOW_KEY, "direction", "bin")
        .agg(F.sum("size").alias("bytes"), F.count("packet_number").alias("packets"))
    )


def feature_vectors(
    packets: DataFrame,
    *,
    window_seconds: float = WINDOW_SECONDS,
    bin_seconds: float = BIN_SECONDS,
    activity_timeout: float = ACTIVITY_TIMEOUT_SECONDS,
    byte_total_policy: str = BYTES_RELEASE_COMPATIBLE,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
    labeled: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Identity columns plus the 129 float features of every retained window.

    Statistics and wavelets read the same shuffled packets: both need the same
    columns of them, so Spark shuffles them once.
    """
    check_bins(window_seconds, bin_seconds)
    packets = in_chunks(packets, chunk_rows)
    statistics = flow_statistics(
        packets,
        window_seconds=window_seconds,
        activity_timeout=activity_timeout,
        byte_total_policy=byte_total_policy,
        minimum_packets=minimum_packets,
        policy=policy,
        chunk_rows=chunk_rows,
    )
    wavelets = wavelet_features(
        size_bins(packets, bin_seconds=bin_seconds),
        minimum_packets=minimum_packets,
        policy=policy,
    )
    joined = statistics.join(wavelets.drop("packet_count"), WINDOW_KEY).withColumn(
        "window_id", window_id()
    )
    labels = ("vpn_status", "application", "category")
    if labeled:
        joined = capture_labels(joined, "capture_id")
    identity = [c for c in FEATURE_IDENTITY if labeled or c not in labels]
    return joined.select(
        *identity,
        *[F.col(name).cast("float").alias(name) for name in FLOW_STATISTIC_COLUMNS],
        *[
            F.col("wavelet")[i].cast("float").alias(name)
            for i, name in enumerate(WAVELET_COLUMNS)
        ],
    )


def feature_array(features: DataFrame) -> Column:
    """The feature columns of a row as one float array in schema order."""
    return F.array(*[F.col(name) for name in FEATURE_COLUMNS])
