"""Toxicity by a bidirectional recurrent network with attention over words.

A word enters as the sum of a hashed word vector and the mean of its hashed
character n-grams (two to five bytes, with the word's borders).  Windows of
``SPAN`` words that overlap by half run through a bidirectional gated recurrent
layer; attention weighs the states of a window, and the weighted state gives the
window's logit.  A document's score comes from its highest window, so one passage
is enough, and all windows of every whole text are scored.

Training, in NumPy by backpropagation through time, uses at most
``most_toxic`` toxic and ``most_clean`` clean labelled documents, drawn by a hash
of their ids.  Toxic documents are read whole, since the passage that made them toxic
can stand anywhere; of a clean one, which is clean throughout, at most ``most_words``
words at a hashed place are used.  At first every window carries its document's label; then only the highest window
of a toxic document does, and the highest ones of clean documents come up more
often than others.  A fifth of the sample is kept apart to turn logits
into probabilities at the labels' own ratio.

Null, empty and wordless texts get score 0, and so do all without any label.
Repeated rows get equal scores; a document labelled twice counts with the higher
label.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import byte_rows, fold, hash_share, slices, texts
from flowloom.llm.decontaminate import words_of
from flowloom.llm.recurrent import Adam, BiGru, sigmoid

SPAN, STRIDE = 32, 16
_GRAMS, _WORDS = 1 << 14, 1 << 13
_KEPT_WORDS = 150_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_inputs(words: list[bytes], most: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in a row, their counts, and word buckets.

    Some thousands of words are taken at a time, which bounds the work space.
    """
    parts = [_some_inputs(words[at : at + most]) for at in range(0, len(words), most)]
    grams, counts, buckets = (np.concatenate(p) for p in zip(*parts, strict=True))
    return grams, counts, buckets


def _some_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    spread = np.zeros(len(flat), np.uint64)
    for width in range(1, 6):
        if width > len(flat):
            break
        count = len(flat) - width + 1
        spread = (spread[:count] + flat[width - 1 :] + np.uint64(1)) * _FACTOR
        spread ^= spread >> np.uint64(29)
        if width > 1:
            inside = owner[:count] == owner[width - 1 :]
            grams.append((spread[inside] + np.uint64(width)) * _FACTOR >> np.uint64(50))
            owners.append(owner[:count][inside])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    whole = np.zeros(len(words), np.uint64)
    first = np.cumsum(sizes) - sizes
    for at in range(int(sizes.max(initial=0))):
        some = sizes > at
        whole[some] = (whole[some] + flat[first[some] + at] + np.uint64(1)) * _FACTOR
        whole[some] ^= whole[some] >> np.uint64(31)
    buckets = (whole * _FACTOR >> np.uint64(51)).astype(np.int64)
    return grams[order].astype(np.int32), counts, buckets


def window_starts(words: int) -> range:
    """First words of the overlapping windows of a text; the last one ends it."""
    return range(0, max(words - SPAN + STRIDE, 1), STRIDE)


class ToxicReader:
    """All weights of the network and its calibration."""

    def __init__(self, width: int = 12, hidden: int = 8, attend: int = 8, seed: int = 3):
        draw = np.random.default_rng(seed)

        def normal(scale, *shape):
            return draw.normal(0, scale, shape).astype(np.float32)

        self.layer = BiGru(hidden, draw)
        self.arrays = {
            "grams": normal(0.3, _GRAMS, width),
            "words": normal(0.1, _WORDS, width),
            "inputs": normal(1 / np.sqrt(width), 2, 3 * hidden, width),
            "opening": np.zeros((2, 3 * hidden, 1), np.float32),
            "weights": self.layer.weights,
            "look": normal(0.3, attend, 2 * hidden),
            "focus": normal(0.3, attend),
            "output": normal(0.3, 2 * hidden),
            "bias": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def word_vectors(self, grams, counts, buckets) -> np.ndarray:
        """``[word, width]`` vectors of distinct words."""
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.arrays["grams"][grams], ends - counts, axis=0)
        return sums / counts[:, None] + self.arrays["words"][buckets]

    def word_gates(self, vectors: np.ndarray) -> np.ndarray:
        """Input gates ``[2, 3H, word]`` of distinct words."""
        return np.matmul(self.arrays["inputs"], vectors.T) + self.arrays["opening"]

    def all_gates(self, grams, counts, buckets, most: int = 8192) -> np.ndarray:
        """Input gates of any number of words, some thousands at a time."""
        ends = np.cumsum(counts)
        parts = []
        for at in range(0, len(counts), most):
            some = slice(at, at + most)
            own = grams[ends[at] - counts[at] : ends[some][-1]]
            parts.append(self.word_gates(self.word_vectors(own, counts[some], buckets[some])))
        return np.concatenate(parts, 2)

    def _attended(self, both: np.ndarray, known: np.ndarray):
        """Attention over ``[T, 2H, B]`` states: looks, shares and the sum."""
        looks = np.tanh(np.matmul(self.arrays["look"], both))
        force = np.einsum("a,tab->tb", self.arrays["focus"], looks)
        force = np.where(known > 0, force, -1e9)
        force = np.exp(force - force.max(0))
        shares = force / force.sum(0)
        return looks, shares, np.einsum("tb,thb->hb", shares, both)

    def _read(self, gates: np.ndarray, numbers: np.ndarray, known: np.ndarray):
        """States of windows given as word numbers ``[T, B]``."""
        order = np.stack([numbers, numbers[::-1]], 1)
        mask = np.stack([known, known[::-1]], 1)[:, :, None].astype(np.float32)
        steps = np.stack([np.take(gates[d], order[:, d], axis=1).transpose(1, 0, 2) for d in (0, 1)], 1)
        states, saved = self.layer.forward(steps, mask)
        return np.concatenate([states[:, 0], states[::-1, 1]], 1), order, mask, saved

    def logits(self, gates: np.ndarray, numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Window logits."""
        both = self._read(gates, numbers, known)[0]
        pooled = self._attended(both, known)[2]
        return self.arrays["output"] @ pooled + self.arrays["bias"]

    def window_logits(
        self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> np.ndarray:
        """Logits of windows of a row of word numbers, without what training keeps.

        ``rows`` holds the input gates word by word (``[word, 2, 3H]``), and
        ``lengths`` must not grow.  Steps work in place on arrays that stay in cache.
        """
        size, width, span = self.layer.hidden, len(starts), int(lengths[0])
        heads = np.vstack([self.arrays["look"], self.arrays["output"]])
        states = np.zeros((2 * size, span, width), np.float32)
        state = np.zeros((2, size, width), np.float32)
        gates = np.empty((2, 3 * size, width), np.float32)
        inner = np.empty_like(gates)
        number = np.arange(width)
        for t in range(span):
            n = int(np.searchsorted(-lengths, -t))  # windows longer than t
            back = lengths[:n] - 1 - t
            gates[0][:, :n] = rows[flat[starts[:n] + t], 0].T
            gates[1][:, :n] = rows[flat[starts[:n] + back], 1].T
            now = state[:, :, :n]
            np.matmul(self.layer.weights, now, out=inner[:, :, :n])
            opens = gates[:, : 2 * size, :n]
            opens += inner[:, : 2 * size, :n]
            opens *= 0.5
            np.tanh(opens, out=opens)
            opens *= 0.5
            opens += 0.5
            fresh = inner[:, 2 * size :, :n]
            fresh *= opens[:, :size]
            fresh += gates[:, 2 * size :, :n]
            np.tanh(fresh, out=fresh)
            now -= fresh
            now *= opens[:, size:]
            now += fresh
            states[:size, t, :n] = now[0]
            if back[-1] == back[0]:
                states[size:, back[0], :n] = now[1]
            else:
                states[size:, back, number[:n]] = now[1]
        seen = (heads @ states.reshape(2 * size, -1)).reshape(-1, span, width)
        force = np.tensordot(self.arrays["focus"], np.tanh(seen[:-1]), 1)
        force[np.arange(span)[:, None] >= lengths] = -1e9
        force -= force.max(0)
        np.exp(force, out=force)
        return (force * seen[-1]).sum(0) / force.sum(0) + self.arrays["bias"]

    def slopes(self, inputs, numbers, known, target, weight) -> dict[str, np.ndarray]:
        """Slopes of the weighted mean logistic loss of windows."""
        size = self.layer.hidden
        grams, counts, buckets = inputs
        vectors = self.word_vectors(*inputs)
        gates = self.word_gates(vectors)
        both, order, mask, saved = self._read(gates, numbers, known)
        looks, shares, pooled = self._attended(both, known)
        logit = self.arrays["output"] @ pooled + self.arrays["bias"]
        wrong = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        by_pooled = self.arrays["output"][:, None] * wrong
        by_share = np.einsum("thb,hb->tb", both, by_pooled)
        by_force = shares * (by_share - (shares * by_share).sum(0))
        by_looks = self.arrays["focus"][:, None] * by_force[:, None] * (1 - looks * looks)
        by_both = shares[:, None] * by_pooled + np.matmul(self.arrays["look"].T, by_looks)
        moved = np.stack([by_both[:, :size], by_both[::-1, size:]], 1)
        by_steps, by_weights = self.layer.backward(moved.astype(np.float32), mask, saved)
        by_gates = np.zeros_like(gates)
        for d in (0, 1):
            flat = by_steps[:, d].transpose(0, 2, 1).reshape(-1, 3 * size)
            own = order[:, d].ravel()
            places = np.argsort(own, kind="stable")
            seen, first = np.unique(own[places], return_index=True)
            by_gates[d][:, seen] = np.add.reduceat(flat[places], first, axis=0).T
        by_vectors = np.einsum("dgv,dgw->wv", self.arrays["inputs"], by_gates)
        by_grams = _gathered(grams, np.repeat(by_vectors / counts[:, None], counts, axis=0), _GRAMS)
        by_words = _gathered(buckets, by_vectors, _WORDS)
        return {
            "grams": by_grams,
            "words": by_words,
            "inputs": np.einsum("dgw,wv->dgv", by_gates, vectors),
            "opening": by_gates.sum(2, keepdims=True),
            "weights": by_weights,
            "look": np.einsum("tab,thb->ah", by_looks, both),
            "focus": np.einsum("tb,tab->a", by_force, looks),
            "output": pooled @ wrong,
            "bias": wrong.sum(keepdims=True),
        }

    def train(self, docs: list[tuple[list[bytes], int]], steps: int = 360, seed: int = 4) -> None:
        """Fit on ``(words, label)`` pairs; half of each batch is toxic."""
        draw = np.random.default_rng(seed)
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        coded = [np.array([numbers[w] for w in words], np.int64) for words, _ in docs]
        if not numbers or len({k for _, k in docs}) < 2:
            return
        grams, counts, buckets = word_inputs(list(numbers))
        ends = np.cumsum(counts)
        windows, owner = [], []
        for n, codes in enumerate(coded):
            for at in window_starts(len(codes)) if len(codes) else ():
                windows.append(codes[at : at + SPAN])
                owner.append(n)
        owner = np.array(owner)
        label = np.array([docs[n][1] for n in owner])
        adam = Adam(self.arrays, 0.02)
        toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        hard = clean
        for step in range(steps):
            if step in (steps // 3, 2 * steps // 3):
                toxic, hard = self._highest(windows, owner, label, (grams, counts, buckets))
            some = [draw.choice(toxic, 48), draw.choice(clean, 40), draw.choice(hard, 40)]
            some = np.concatenate(some)
            codes, known = _columns([windows[i] for i in some])
            used, codes = np.unique(codes, return_inverse=True)
            own = np.concatenate([np.arange(ends[u] - counts[u], ends[u]) for u in used])
            inputs = (grams[own], counts[used], buckets[used])
            target = label[some].astype(np.float32)
            slopes = self.slopes(
                inputs, codes.reshape(known.shape), known, target, np.ones(len(some), np.float32)
            )
            adam.step(slopes, 0.5 ** (3 * step / steps))

    def _highest(self, windows, owner, label, inputs) -> tuple[np.ndarray, np.ndarray]:
        """The highest window of each document: of toxic ones, of clean ones."""
        gates = self.all_gates(*inputs)
        logit = np.concatenate(
            [
                self.logits(gates, *_columns(windows[at : at + 512]))
                for at in range(0, len(windows), 512)
            ]
        )
        order = np.lexsort((-logit, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        return best[label[best] == 1], best[label[best] == 0]

    def calibrate(self, logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Fit a logistic curve from the highest logits, with a weak prior."""
        slope, shift = 1.0, 0.0
        for _ in range(200):
            wrong = (sigmoid(slope * logit + shift) - label) * weight
            share = sigmoid(slope * logit + shift)
            bend = share * (1 - share) * weight
            pull = np.array([(wrong * logit).sum() + 0.1 * (slope - 1), wrong.sum()])
            curve = np.array(
                [
                    [(bend * logit * logit).sum() + 0.1, (bend * logit).sum()],
                    [(bend * logit).sum(), bend.sum() + 1e-3],
                ]
            )
            move = np.linalg.solve(curve, pull)
            move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
            slope, shift = slope - move[0], shift - move[1]
        self.slope, self.shift = max(float(slope), 1e-3), float(shift)

    def scores(self, logit: np.ndarray) -> np.ndarray:
        """Probabilities of documents from their highest logits."""
        return sigmoid(self.slope * logit + self.shift)


def _gathered(places: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by place."""
    sums = [np.bincount(places, weights=column, minlength=size) for column in rows.T]
    return np.array(sums, np.float32).T


def _columns(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as padded columns ``[T, B]`` and what is known of them."""
    codes = np.zeros((SPAN, len(windows)), np.int64)
    known = np.zeros((SPAN, len(windows)), np.float32)
    for n, window in enumerate(windows):
        codes[: len(window), n] = window
        known[: len(window), n] = 1
    return codes, known


class Scorer:
    """Scores texts with one model; gates of words met before are kept."""

    def __init__(self, model: ToxicReader):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.numbers = defaultdict(itertools.count().__next__)
        self.gates = np.zeros((0, 2, 3 * self.model.layer.hidden), np.float32)

    def _learn(self) -> None:
        fresh = list(itertools.islice(self.numbers, len(self.gates), None))
        if fresh:
            new = self.model.all_gates(*word_inputs(fresh)).transpose(2, 0, 1)
            self.gates = np.concatenate([self.gates, new])

    def highest(self, batch: list[bytes], columns: int = 512) -> np.ndarray:
        """Highest window logit of each text; minus infinity without words."""
        if len(self.numbers) > _KEPT_WORDS:
            self._forget()
        words = [words_of(t) for t in batch]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(
            map(self.numbers.__getitem__, itertools.chain.from_iterable(words)),
            np.int64,
            int(sizes.sum()),
        )
        self._learn()
        best = np.full(len(batch), -np.inf)
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - SPAN + STRIDE) // STRIDE), 1), 0)
        owner = np.repeat(np.arange(len(batch)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = np.cumsum(sizes) - sizes
        starts = base[owner] + nth * STRIDE
        lengths = np.minimum(SPAN, base[owner] + sizes[owner] - starts)
        logit = np.empty(len(owner))
        longest = np.argsort(-lengths, kind="stable")
        for at in range(0, len(owner), columns):
            part = longest[at : at + columns]
            logit[part] = self.model.window_logits(self.gates, flat, starts[part], lengths[part])
        np.maximum.at(best, owner, logit)
        return best


def toxic_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` outside the held-out fold (crc32 modulo 4 is 2)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    own = own.where(fold(F.col("doc_id"), 4) != 2)
    return own.groupBy("doc_id").agg(F.max("label").alias("label"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 1500,
    most_clean: int = 3000,
    most_words: int = 1000,
    **shape,
) -> ToxicReader | None:
    """Train on a bounded sample of labelled documents; ``None`` without one."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    draws = [
        labels.where(F.col("label") == k).orderBy(hash_share(F.col("doc_id"), 9), "doc_id").limit(n)
        for k, n in ((1, most_toxic), (0, most_clean))
    ]
    # At most ``most_toxic + most_clean`` rows.
    chosen = F.broadcast(draws[0].unionByName(draws[1]))
    rows = [
        (r.doc_id, words_of(r.text.encode()), int(r.label))
        for r in _cropped(texts(docs).join(chosen, "doc_id"), 8 * most_words).toLocalIterator()
    ]
    rows = sorted((i, words if k else words[:most_words], k) for i, words, k in rows if words)
    if not rows:
        return None
    model = ToxicReader(**shape)
    apart = [n % 5 == 4 for n in range(len(rows))]
    model.train([r[1:] for r, a in zip(rows, apart, strict=True) if not a])
    kept = [r for r, a in zip(rows, apart, strict=True) if a] or rows
    logit = Scorer(model).highest([b" ".join(r[1]) for r in kept])
    label = np.array([r[2] for r in kept], float)
    drawn = [max(sum(r[2] == k for r in rows), 1) for k in (0, 1)]
    weight = np.array([counts.get(r[2], 0) / drawn[r[2]] for r in kept])
    model.calibrate(logit, label, weight / weight.mean())
    return model


def _cropped(rows: DataFrame, most: int) -> DataFrame:
    """Texts of the sample, longer clean ones cut at a hashed place."""
    room = F.greatest(F.length("text") - most, F.lit(0))
    at = F.floor(hash_share(F.col("doc_id"), 8) * (room + 1)).cast("int")
    cut = F.substring(F.col("text"), at + 1, F.lit(most))
    whole = F.when(F.col("label") == 0, cut).otherwise(F.col("text"))
    return rows.select("doc_id", "label", whole.alias("text"))


def toxic_scores(docs: DataFrame, model: ToxicReader | None) -> DataFrame:
    """``doc_id, score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for part in slices(batches, "text", 1 << 20):
            score = np.zeros(part.num_rows)
            if scorer:
                logit = scorer.highest(byte_rows(part.column("text")))
                score = np.where(np.isfinite(logit), model.scores(np.maximum(logit, -1e3)), 0.0)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(score)], names=["doc_id", "score"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double")
