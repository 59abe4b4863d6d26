"""Quality scores from random Fourier features of document statistics.

Every text gives a fixed vector of statistics.  Standardised statistics pass
through ``cos(x W + b)`` with normal ``W``, whose inner products approximate a
Gaussian kernel.  Ridge weights come from normal equations that each task sums
over its rows and that are then added up; a monotone (isotonic) map, fitted on a
further fold from summed score bins, turns the result into a probability.

The labelled rows used for fitting and calibration are all rows outside the
held-out fold; what reaches the driver is one matrix, one vector and one row per
bin, whatever the number of documents.

Null and empty texts have the statistics of an empty text and get a score like
any other.  Repeated rows get equal scores.  Rows without a usable label are not
learned from; with no label at all every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import byte_rows, fold, slices, stored, texts

#: Byte classes counted in each text.
_CLASSES = 9
_CLASS_OF = np.zeros(256, np.uint8)
_CLASS_OF[[ord(c) for c in " \t\r\f\v"]] = 1
_CLASS_OF[ord("\n")] = 2
_CLASS_OF[ord("a") : ord("z") + 1] = 3
_CLASS_OF[ord("A") : ord("Z") + 1] = 4
_CLASS_OF[ord("0") : ord("9") + 1] = 5
_CLASS_OF[[ord(c) for c in ".,;:'\"-?()"]] = 6
_CLASS_OF[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS_OF[128:] = 8
STATISTICS = 26
BINS = 2000


def text_statistics(text: bytes) -> np.ndarray:
    """The statistics of one whole text (UTF-8)."""
    out = np.zeros(STATISTICS, np.float32)
    raw = np.frombuffer(text, np.uint8)
    size = len(raw)
    kinds = _CLASS_OF[raw]
    shares = np.bincount(kinds, minlength=_CLASSES) / max(size, 1)
    out[:_CLASSES] = np.sqrt(shares)
    out[9] = np.log1p(size)
    if not size:
        return out
    symbols = np.bincount(raw, minlength=256)
    symbols = symbols[symbols > 0] / size
    out[10] = -(symbols * np.log2(symbols)).sum()
    words = text.split()
    total = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float32, len(words))
    if len(words):
        out[11] = lengths.mean()
        out[12] = np.log1p(lengths.std())
        out[13] = np.log1p(lengths.max())
        out[14] = max(counts.values()) / total
        out[15] = (lengths <= 3).mean()
        out[16] = (lengths >= 12).mean()
    out[17] = len(counts) / total
    out[18] = np.log1p(total)
    repeated = sum(n for n in counts.values() if n > 1)
    out[19] = repeated / total
    pairs = Counter(zip(words, words[1:], strict=False))
    out[20] = sum(n for n in pairs.values() if n > 1) / total
    lines = text.split(b"\n")
    out[21] = np.log1p(len(lines))
    out[22] = sum(n for n in Counter(lines).values() if n > 1) / len(lines)
    # Words that end in a symbol, that are all capitals, and runs of one byte.
    change = kinds[1:] != kinds[:-1]
    out[23] = ((kinds[1:] == 7) & change).sum() / total
    out[24] = ((kinds[1:] == 4) & (kinds[:-1] == 4)).sum() / size
    out[25] = (raw[1:] == raw[:-1]).mean() if size > 1 else 0.0
    return out


def statistics_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [text_statistics(t) for t in byte_rows(part.column("text"))]
            yield pa.record_batch(
                [part.column("doc_id"), _vectors(np.array(rows, np.float32))],
                names=["doc_id", "stats"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, stats array<float>")


def _vectors(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class KernelRidge:
    """The fitted model: standardisation, features, weights and calibration."""

    def __init__(self, features: int = 256, scale: float = 1.5, seed: int = 7):
        draw = np.random.default_rng(seed)
        spread = 1.0 / (scale * np.sqrt(STATISTICS))
        self.directions = draw.normal(size=(STATISTICS, features)) * spread
        self.phases = draw.uniform(0, 2 * np.pi, features)
        self.mean = np.zeros(STATISTICS)
        self.scale = np.ones(STATISTICS)
        self.weights = np.zeros(features + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant column."""
        plain = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(plain @ self.directions + self.phases)
        waves *= np.sqrt(2.0 / len(self.phases))
        return np.hstack([waves, np.ones((len(waves), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores before calibration."""
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores in 0 to 1; a trace of the raw order breaks ties."""
        raw = self.raw(stats)
        level = np.interp(raw, *self.knots)
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total, square = 0.0, np.zeros(STATISTICS), np.zeros(STATISTICS)
    for batch in batches:
        if batch.num_rows:
            stats = _matrix(batch.column("stats"))
            count += len(stats)
            total += stats.sum(0)
            square += (stats**2).sum(0)
    yield pa.record_batch(
        [pa.array([0]), pa.array([np.concatenate([[count], total, square]).tolist()])],
        names=["row", "sums"],
    )


def _normal_equations(model: KernelRidge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.weights)
        sums = np.zeros((size, size + 1))
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                rows = batch.slice(part, 4096)
                waves = model.features(_matrix(rows.column("stats")))
                label = rows.column("label").to_numpy(zero_copy_only=False)
                sums[:, :size] += waves.T @ waves
                sums[:, size] += waves.T @ label
        yield pa.record_batch(
            [pa.array(np.arange(size)), _vectors(sums)], names=["row", "sums"]
        )

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    sums = np.sum(rows.column("sums").to_pylist(), axis=0)
    return pa.table([rows.column("row").slice(0, 1), pa.array([sums.tolist()])], names=["row", "sums"])


def _summed(rows: DataFrame, task) -> np.ndarray:
    """Sums of all tasks, added up by row; the result has a fixed size."""
    sums = rows.mapInArrow(task, "row long, sums array<double>")
    sums = sums.groupBy("row").applyInArrow(_add_up, "row long, sums array<double>")
    got = {r.row: r.sums for r in sums.toLocalIterator()}
    return np.array([got[k] for k in sorted(got)])


def _binned(model: KernelRidge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column("stats")))
                bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                label = batch.column("label").to_numpy(zero_copy_only=False)
                count += np.bincount(bins, minlength=BINS)
                good += np.bincount(bins, weights=label, minlength=BINS)
        seen = np.flatnonzero(count)
        yield pa.record_batch(
            [pa.array(seen), pa.array(count[seen]), pa.array(good[seen])],
            names=["bin", "n", "good"],
        )

    return run


def isotonic(count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block ends by index and non-decreasing means."""
    blocks: list[list[float]] = []
    for at, (n, g) in enumerate(zip(count, good, strict=True)):
        blocks.append([at, at, n, g])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1:] = [last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    places = np.array([b[:2] for b in blocks], float).ravel()
    levels = np.repeat([b[3] / b[2] for b in blocks], 2)
    return places, levels


def fit(stats: DataFrame, labels: DataFrame, ridge: float = 1e-2, **shape) -> KernelRidge:
    """Fit on labelled rows: ``stats`` has ``doc_id, stats``, ``labels`` has
    ``doc_id, label, calibrate`` (which fold a row belongs to)."""
    model = KernelRidge(**shape)
    rows = stored(
        stats.join(labels, "doc_id").select("stats", F.col("label").cast("double"), "calibrate"),
        "quality-fit",
    )
    first = rows.where(~F.col("calibrate"))
    moments = _summed(first, _moments)
    if not len(moments) or not moments[0][0]:
        return model
    count, total, square = moments[0][0], moments[0][1 : 1 + STATISTICS], moments[0][1 + STATISTICS :]
    model.mean = total / count
    model.scale = np.sqrt(np.maximum(square / count - model.mean**2, 0)) + 1e-3
    sums = _summed(first, _normal_equations(model))
    size = len(model.weights)
    inside = sums[:, :size] + ridge * np.eye(size)
    model.weights = np.linalg.solve(inside, sums[:, size])
    bins = (
        rows.where(F.col("calibrate"))
        .mapInArrow(_binned(model), "bin long, n double, good double")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        .orderBy("bin")
        .toPandas()
    )
    if len(bins):
        places, levels = isotonic(bins["n"].to_numpy(), bins["good"].to_numpy())
        centres = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
        model.knots = (centres[places.astype(int)], levels)
    return model


def quality_labels(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold: the id's crc32 modulo 5 is 1 to
    3 for fitting, 4 for calibration.  Null ids and labels are left out, and an
    id labelled twice counts with its higher label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    own = own.where(fold(F.col("doc_id"), 5) != 0)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    return own.withColumn("calibrate", fold(F.col("doc_id"), 5) == 4)


def score(stats: DataFrame, model: KernelRidge) -> DataFrame:
    """``doc_id, score`` for rows of ``doc_id, stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                yield pa.record_batch(
                    [rows.column("doc_id"), pa.array(model.scores(_matrix(rows.column("stats"))))],
                    names=["doc_id", "score"],
                )

    return stats.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` of all documents, learned from ``labels``."""
    stats = stored(statistics_rows(docs), "quality-stats")
    return score(stats, fit(stats, quality_labels(labels)))


def keep_good(docs: DataFrame, model: KernelRidge, threshold: float = 0.3) -> DataFrame:
    """The documents scored at least ``threshold``, with all their columns.

    Rows are judged where they are read; no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, spare):
            rows = [text_statistics(t) for t in byte_rows(part.column(spare))]
            keep = model.scores(np.array(rows, np.float64)) >= threshold
            yield part.filter(pa.array(keep)).drop_columns([spare])

    spare = max(docs.columns, key=len) + "_text"  # a name no column has
    judged = docs.withColumn(spare, F.coalesce(F.col("text"), F.lit("")))
    return judged.mapInArrow(run, docs.schema)
