"""Near duplicates by MinHash bands and sequential Bayesian verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents with one word sequence are one class, represented by the least id.
Representatives get a signature of ``bands * rows`` minima; those that share a
band are candidates.  At similarity 0.75 two sets share no band with probability
``(1 - 0.75**5)**40``, about 2e-5, and far less above it.

Signatures of a candidate pair are compared ``step`` minima at a time.  With m
of n equal, the similarity has the posterior Beta(m + 1, n - m + 1); a pair is
dropped as soon as the probability of reaching the threshold is below ``miss``.
What is left is confirmed on the full sets with integers.

Bands shared by few documents give their pairs, each once.  Bands shared by more
than ``crowd`` are joined into crowds (connected by such bands); a crowd is cut
into blocks of ``block`` documents by hash, and each pair of blocks is one group
in which all pairs run through the same comparison.  A block pair gives links
that span what it found, never its pairs, so output stays in proportion to the
documents.  Nothing is capped: every pair that shares a band is compared.

Null and empty texts and texts without words are linked with nothing.  Texts of
fewer than five words are one shingle.  Rows that repeat a doc_id are judged by
their own text.  Rows with a null id get the class of their words, represent
nothing and, without one, are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import broadcast_if_small, byte_rows, slices, stored, texts
from flowloom.llm.components import components

SHINGLE = 5
BANDS, ROWS = 40, 5
_BLANKS = bytes(32 if b in b"\t\n\x0b\x0c\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAW = np.random.default_rng(20240611)
_FACTORS = _DRAW.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of blanks."""
    return [w for w in text.translate(_BLANKS).split(b" ") if w]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words a task meets again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of five consecutive words."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    spread = np.full(len(codes) - width + 1, np.uint64(width))
    for at in range(width):
        spread = (spread ^ codes[at : at + len(spread)]) * _MIX[0]
        spread ^= spread >> np.uint64(29)
    spread *= _MIX[1]
    spread ^= spread >> np.uint64(32)
    return np.unique(spread)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the shingles under ``BANDS * ROWS`` hash functions."""
    low = ((shingles * _MIX[2]) >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for part in range(0, len(low), 1024):
        values = low[part : part + 1024, None] * _FACTORS
        values += _OFFSETS
        # Multiplication only carries upwards: bring high bits down.
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x85EBCA6B)
        np.minimum(out, values.min(axis=0), out=out)
    return out


def fewest_matches(parts: int, threshold: float, miss: float, step: int) -> list[int]:
    """For each batch end n, the fewest equal minima at which the posterior
    probability of reaching the threshold is still at least ``miss``."""
    out = []
    for n in range(step, parts + 1, step):
        fewest = next(m for m in range(n + 1) if _beta_above(threshold, m + 1, n - m + 1) >= miss)
        out.append(fewest)
    return out


def _beta_above(x: float, a: int, b: int) -> float:
    """P(Beta(a, b) > x) for whole a and b, as a binomial sum."""
    n = a + b - 1
    return sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a))


SIGNED = "doc_id long, words_hash binary, n_shingles long, bands binary, signature binary"


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    parts = minima.reshape(BANDS, ROWS).astype(np.uint64)
    spread = np.arange(BANDS, dtype=np.uint64) * _MIX[2]
    for row in range(ROWS):
        spread = (spread ^ parts[:, row]) * _MIX[0]
        spread ^= spread >> np.uint64(31)
    return spread


def signatures(docs: DataFrame) -> DataFrame:
    """Word-sequence hash, set size, band keys and signature of whole texts.

    Bands are made from 32-bit minima; the signature that is compared keeps 16
    bits of each, at which unequal minima agree once in 65,536 times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, "text"):
            hashes, sizes, keys, minima = [], [], [], []
            for text in byte_rows(part.column("text")):
                words = words_of(text)
                shingles = shingle_set(words, known)
                hashes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(shingles))
                least = signature(shingles)
                keys.append(band_keys(least).tobytes() if words else None)
                minima.append(least.astype(np.uint16).tobytes() if words else None)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(hashes, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(minima, pa.binary()),
                ],
                names=["doc_id", "words_hash", "n_shingles", "bands", "signature"],
            )

    return texts(docs).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles``: full sets as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, "text"):
            sets = [shingle_set(words_of(t), known).tobytes() for t in byte_rows(part.column("text"))]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
            )

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        ids = np.repeat(batch.column("doc_id").to_numpy(), BANDS)
        yield pa.record_batch([pa.array(keys), pa.array(ids)], names=["band", "doc_id"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _prune_pairs(fewest: list[int], step: int):
    """Keep the pairs whose signatures pass every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                left, right = (
                    np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint16).reshape(
                        -1, BANDS * ROWS
                    )
                    for c in ("sig_a", "sig_b")
                )
                alive = np.arange(len(left))
                equal = np.zeros(len(left), np.int64)
                for n, least in enumerate(fewest):
                    part = slice(n * step, (n + 1) * step)
                    equal[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                    alive = alive[equal[alive] >= least]
                yield pa.record_batch(
                    [rows.column("a").take(pa.array(alive)), rows.column("b").take(pa.array(alive))],
                    names=["a", "b"],
                )

    return run


def _confirm_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sets = (rows.column(c).to_pylist() for c in ("set_a", "set_b"))
                keep = [
                    _similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(*sets, strict=True)
                ]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_blocks(fewest: list[int], step: int, percent: int):
    """All pairs of two blocks of one crowd; the links that span the result."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        blocks = rows.column("own").to_numpy()
        order = np.lexsort((ids, blocks))
        ids, blocks = ids[order], blocks[order]
        raw = rows.column("signature").to_pylist()
        minima = np.frombuffer(b"".join(raw[i] for i in order), np.uint16).reshape(len(ids), -1)
        packed = rows.column("shingles").to_pylist()
        sets = [np.frombuffer(packed[i], np.uint64) for i in order]
        sizes = np.array([len(s) for s in sets])
        firsts = np.cumsum(sizes) - sizes
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        inside = np.zeros(len(distinct), bool)
        label = np.arange(len(ids))
        links = []
        one = blocks[0] == blocks[-1]
        border = len(ids) if one else int(np.searchsorted(blocks, blocks[-1]))
        for x in range(border):
            others = np.arange(x + 1 if one else border, len(ids))
            others = others[label[others] != label[x]]
            equal = np.zeros(len(others), np.int64)
            for n, least in enumerate(fewest):
                part = slice(n * step, (n + 1) * step)
                equal += (minima[others, part] == minima[x, part]).sum(axis=1)
                stay = equal >= least
                others, equal = others[stay], equal[stay]
            if not len(others):
                continue
            # Full sets: mark x's shingles and count them in all others at once.
            own = codes[firsts[x] : firsts[x] + sizes[x]]
            inside[own] = True
            ends = np.cumsum(sizes[others])
            places = np.arange(ends[-1]) + np.repeat(firsts[others] - ends + sizes[others], sizes[others])
            both = np.add.reduceat(inside[codes[places]], ends - sizes[others], dtype=np.int64)
            inside[own] = False
            union = sizes[x] + sizes[others] - both
            for y in others[100 * both >= percent * union]:
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    links.append((int(ids[x]), int(ids[y])))
        return pa.table(
            [pa.array([k[n] for k in links], pa.int64()) for n in (0, 1)], names=["a", "b"]
        )

    return run


def _pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of the documents of small bands."""
    listed = members.groupBy("band").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    heads = F.transform(
        F.slice("ids", 1, F.size("ids") - 1),
        lambda a, at: F.transform(
            F.slice("ids", at + 2, F.size("ids")),
            lambda b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )
    # One band list for all bands that hold the same documents.
    alike = listed.select("ids").distinct()
    return alike.select(F.inline(F.flatten(heads))).distinct()


def near_links(
    reps: DataFrame,
    docs: DataFrame,
    percent: int = 75,
    miss: float = 1e-6,
    step: int = 20,
    crowd: int = 16,
    block: int = 512,
) -> DataFrame:
    """Confirmed links ``a, b`` that connect all similar representatives."""
    fewest = fewest_matches(BANDS * ROWS, percent / 100, miss, step)
    bands = reps.select("doc_id", "bands").mapInArrow(_band_rows, "band long, doc_id long")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    members = stored(
        bands.join(sizes.where("n > 1"), "band").select("band", "doc_id", "n", "least"), "bands"
    )
    pairs = _pairs(members.where(F.col("n") <= crowd))
    signed = reps.select("doc_id", "signature")
    signed_a = signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    signed_b = signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))
    likely = stored(
        pairs.join(signed_a, "a")
        .join(signed_b, "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_prune_pairs(fewest, step), "a long, b long"),
        "likely",
    )
    crowded = components(
        members.where(F.col("n") > crowd).select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    )
    needed = stored(
        likely.select(F.col("a").alias("doc_id"))
        .unionByName(likely.select(F.col("b").alias("doc_id")))
        .unionByName(crowded.select(F.col("node").alias("doc_id")))
        .distinct(),
        "needed",
    )
    chosen = texts(docs).join(broadcast_if_small(needed), "doc_id")
    sets = stored(
        shingle_sets(chosen.select("doc_id", "text")).distinct(),
        "shingles",
    )
    sets_a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    sets_b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    confirmed = (
        likely.join(sets_a, "a")
        .join(sets_b, "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(_confirm_pairs(percent), "a long, b long")
    )
    counts = crowded.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = (
        crowded.join(counts, "root")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.col("node").alias("doc_id"),
            "root",
            "own",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
        )
    )
    crowds = (
        placed.join(signed, "doc_id")
        .join(sets, "doc_id")
        .groupBy("root", "low", "high")
        .applyInArrow(_compare_blocks(fewest, step, percent), "a long, b long")
    )
    return confirmed.unionByName(crowds)


def near_duplicates(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    signed = stored(signatures(docs), "signatures")
    classes = signed.where(F.col("doc_id").isNotNull() & F.col("words_hash").isNotNull())
    groups = stored(
        classes.groupBy("words_hash", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    firsts = groups.select(F.col("rep").alias("doc_id"), "words_hash")
    reps = stored(
        classes.join(firsts, ["doc_id", "words_hash"], "left_semi")
        .select("doc_id", "bands", "signature")
        .distinct(),
        "reps",
    )
    found = components(near_links(reps, docs, **limits))
    own = groups.join(found, F.col("rep") == F.col("node"), "left").select(
        "words_hash", F.coalesce("root", "rep").alias("component")
    )
    return (
        signed.select("doc_id", "words_hash", "n_shingles")
        .join(own, "words_hash", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
        )
    )
