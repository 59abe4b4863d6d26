"""Stationary Haar features of directional byte signals.

A window has at most 4096 bins per direction, so collecting its bins is bounded
by the bin count, never by the packet count.  The dense transform runs on Arrow
batches of whole windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.windows import RELEASE_COMPATIBLE, WINDOW_KEY, retained
from flowloom.schemas import (
    LOG_EPSILON,
    MINIMUM_PACKETS,
    SAMPLES_PER_WINDOW,
    WAVELET_BANDS,
    WAVELET_LEVELS,
)

# Windows transformed together: 32 x 4096 doubles are 1 MB, which stays in cache.
_BLOCK = 32

# Signals of at most this many filled bins are transformed by runs of equal values.
_SPARSE_BINS = 192


def haar_bands(signals: np.ndarray, *, energy_preserving: bool = True) -> list[np.ndarray]:
    """The 13 bands of each row: deepest approximation, then details, deepest first.

    Level ``j`` averages and differences samples ``2**(j-1)`` apart on a circle.
    The default norm scales level ``j`` by ``2**(j/2)``.
    """
    approximation = np.asarray(signals, dtype=np.float64)
    details = []
    for level in range(1, WAVELET_LEVELS + 1):
        detail, approximation = _haar_level(approximation, level)
        details.append(detail if energy_preserving else detail * 2.0 ** (level / 2))
    if not energy_preserving:
        approximation = approximation * 2.0 ** (WAVELET_LEVELS / 2)
    return [approximation, *reversed(details)]


def _haar_level(approximation: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    shifted = np.roll(approximation, -(1 << (level - 1)), axis=-1)
    return (approximation - shifted) * 0.5, (approximation + shifted) * 0.5


def band_statistics(signals: np.ndarray) -> np.ndarray:
    """``[rows, 4 families, 13 bands]`` of byte signals ``[rows, 4096]``.

    Byte sums are integers, so halving them twelve times is exact: a detail band
    sums to exactly zero on the circle and the deepest approximation is one
    constant.  Their deviations follow from the energy alone.
    """
    rows, samples = signals.shape
    result = np.zeros((rows, 4, WAVELET_BANDS))
    energy, entropy, magnitude, deviation = (result[:, family, :] for family in range(4))
    approximation = signals
    for level in range(1, WAVELET_LEVELS + 1):
        band = WAVELET_BANDS - level
        detail, approximation = _haar_level(approximation, level)
        magnitude[:, band] = np.abs(detail).mean(axis=1)
        squares = np.square(detail, out=detail)
        total = squares.sum(axis=1)
        logs = np.zeros_like(squares)
        np.log2(squares, out=logs, where=squares > 0.0)
        energy[:, band] = total
        deviation[:, band] = np.sqrt(total / samples)
        held = total > 0.0
        # -sum(p * log2(p)) with p = squares / total
        entropy[held, band] = np.log2(total[held]) - (
            np.einsum("ij,ij->i", squares[held], logs[held]) / total[held]
        )
    return _finished(result, approximation[:, 0])


def _finished(result: np.ndarray, level_mean: np.ndarray) -> np.ndarray:
    """Statistics with those of the deepest approximation, relative and in logarithms."""
    samples = SAMPLES_PER_WINDOW
    energy, entropy, magnitude = (result[:, family, :] for family in range(3))
    energy[:, 0] = samples * level_mean * level_mean
    entropy[:, 0] = np.where(level_mean != 0.0, np.log2(samples), 0.0)
    magnitude[:, 0] = np.abs(level_mean)
    whole = energy.sum(axis=1)
    energy /= np.where(whole > 0.0, whole, 1.0)[:, None]
    result[:, 2:, :] = np.log(result[:, 2:, :] + LOG_EPSILON)
    return result


def sparse_band_statistics(
    rows: int, row: np.ndarray, bins: np.ndarray, sums: np.ndarray
) -> np.ndarray:
    """:func:`band_statistics` from the filled bins: their row, bin and byte sum.

    Detail ``j`` at ``i`` is ``2**-j`` times the bytes of the ``s = 2**(j-1)`` bins from
    ``i`` less those of the ``s`` after them.  A filled bin changes it at three places
    only, so a band is runs of equal values, at most three for each filled bin and one.
    The run values are whole numbers and exact; only sums over a band round otherwise.
    """
    samples = SAMPLES_PER_WINDOW
    result = np.zeros((rows, 4, WAVELET_BANDS))
    energy, entropy, magnitude, deviation = (result[:, family, :] for family in range(4))
    amounts = sums.astype(np.int64)
    begins = np.arange(rows, dtype=np.int64) * samples
    steps = np.concatenate([-amounts, 2 * amounts, -amounts, np.zeros(rows, dtype=np.int64)])
    back = (bins + 1) % samples  # from a bin back to the last place of the circle
    for level in range(1, WAVELET_LEVELS + 1):
        band, half = WAVELET_BANDS - level, 1 << (level - 1)
        at = [row * samples + (bins + 1 - lag) % samples for lag in (2 * half, half, 0)]
        places = np.concatenate([*at, begins])
        order = np.argsort(places, kind="stable")
        places = places[order]
        owner = places // samples
        # The steps of a row add up to zero, so one running sum serves all rows.
        sign = (back < half).astype(np.int64) - ((back >= half) & (back < 2 * half))
        before = np.zeros(rows, dtype=np.int64)
        np.add.at(before, row, sign * amounts)
        value = np.cumsum(steps[order]) + before[owner]
        length = np.diff(places, append=rows * samples).astype(np.float64)
        detail = value * 2.0**-level
        squares = detail * detail
        logs = np.zeros_like(squares)
        np.log2(squares, out=logs, where=squares > 0.0)
        weighted = squares * length
        total = np.bincount(owner, weighted, rows)
        energy[:, band] = total
        magnitude[:, band] = np.bincount(owner, np.abs(detail) * length, rows) / samples
        deviation[:, band] = np.sqrt(total / samples)
        held = total > 0.0
        logged = np.bincount(owner, weighted * logs, rows)
        entropy[held, band] = np.log2(total[held]) - logged[held] / total[held]
    whole = np.zeros(rows, dtype=np.int64)
    np.add.at(whole, row, amounts)
    return _finished(result, whole / samples)


def _filled(
    bins: pa.ListArray, sums: pa.ListArray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filled bins of each row: how many, then row, bin and byte sum of each."""
    lengths = np.asarray(bins.value_lengths().fill_null(0), dtype=np.int64)
    return (
        lengths,
        np.repeat(np.arange(len(bins)), lengths),
        np.asarray(bins.flatten(), dtype=np.int64),
        np.asarray(sums.flatten(), dtype=np.int64),
    )


def _signal_statistics(bins: pa.ListArray, sums: pa.ListArray) -> np.ndarray:
    """Band statistics of signals, by runs where few bins are filled."""
    lengths, row, places, amounts = _filled(bins, sums)
    result = np.zeros((len(bins), 4, WAVELET_BANDS))
    few = lengths <= _SPARSE_BINS
    number = np.cumsum(few) - 1
    mine = few[row]
    result[few] = sparse_band_statistics(
        int(few.sum()), number[row[mine]], places[mine], amounts[mine]
    )
    full = np.flatnonzero(~few)
    for start in range(0, len(full), _BLOCK):
        some = full[start : start + _BLOCK]
        taken = pa.array(some)
        result[some] = band_statistics(_dense(bins.take(taken), sums.take(taken), 0, len(some)))
    return result


def _dense(bins: pa.ListArray, sums: pa.ListArray, start: int, stop: int) -> np.ndarray:
    """Dense signals of rows ``start:stop`` from sparse bin / sum lists."""
    signals = np.zeros((stop - start, SAMPLES_PER_WINDOW))
    part = bins.slice(start, stop - start)
    lengths = np.asarray(part.value_lengths().fill_null(0), dtype=np.int64)
    rows = np.repeat(np.arange(stop - start), lengths)
    positions = np.asarray(part.flatten(), dtype=np.int64)
    amounts = np.asarray(sums.slice(start, stop - start).flatten(), dtype=np.float64)
    signals[rows, positions] = amounts
    return signals


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _wavelet_vector(
    in_bins: pa.Array, in_bytes: pa.Array, out_bins: pa.Array, out_bytes: pa.Array
) -> pa.Array:
    """104 values per window: family, then direction, then band."""
    count = len(in_bins)
    vectors = np.empty((count, 4, 2, WAVELET_BANDS), dtype=np.float32)
    for side, (bins, sums) in enumerate(((in_bins, in_bytes), (out_bins, out_bytes))):
        vectors[:, :, side, :] = _signal_statistics(bins, sums)
    width = 4 * 2 * WAVELET_BANDS
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (count + 1) * width, width, dtype=np.int32)),
        pa.array(vectors.reshape(-1)),
    )


def window_signals(
    bins: DataFrame,
    *,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
) -> DataFrame:
    """Sparse directional signals of each retained window as bounded arrays."""
    # The transform costs far more than its bytes suggest, so the partition count
    # is fixed here instead of being coalesced by size.
    parts = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = bins.repartition(parts, *WINDOW_KEY)
    gathered = spread.groupBy(*WINDOW_KEY).agg(
        F.sum("packets").alias("packet_count"),
        F.collect_list(F.when(F.col("direction") == 0, F.struct("bin", "bytes"))).alias("inward"),
        F.collect_list(F.when(F.col("direction") == 1, F.struct("bin", "bytes"))).alias("outward"),
    )
    return gathered.where(retained(F.col("packet_count"), minimum_packets, policy)).select(
        *WINDOW_KEY,
        "packet_count",
        F.col("inward.bin").alias("in_bins"),
        F.col("inward.bytes").alias("in_bytes"),
        F.col("outward.bin").alias("out_bins"),
        F.col("outward.bytes").alias("out_bytes"),
    )


def wavelet_features(
    bins: DataFrame,
    *,
    minimum_packets: int = MINIMUM_PACKETS,
    policy: str = RELEASE_COMPATIBLE,
) -> DataFrame:
    """104 wavelet values of each retained window as a float array."""
    signals = window_signals(bins, minimum_packets=minimum_packets, policy=policy)
    return signals.select(
        *WINDOW_KEY,
        "packet_count",
        _wavelet_vector("in_bins", "in_bytes", "out_bins", "out_bytes").alias("wavelet"),
    )
