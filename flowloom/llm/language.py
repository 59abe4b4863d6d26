"""Language of every text by a bidirectional recurrent network over bytes.

The network reads the UTF-8 bytes of a text in runs of ``RUN`` bytes, forwards
and backwards, and gives every byte position a probability for each language.  A
document's probabilities are the means over all its positions.  It is trained in
NumPy by backpropagation through time on labelled documents, every position of a
crop carrying its document's language.

Training draws about ``per_language`` documents of each language by a hash of
their ids, and of each a crop of ``crop`` characters at a hashed place; this
bounds what reaches the driver.  Languages are learned, at most
``MOST_LANGUAGES``.  Every whole text is scored.

Text that is null or has no letter is ``und`` with score 0; so is every text
when there is nothing to learn from.  Ties go to the language that sorts first.
Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import flat_bytes, hash_share, slices
from flowloom.llm.recurrent import Adam, BiGru

RUN = 256
COLUMNS = 2048
UNKNOWN = "und"
MOST_LANGUAGES = 1000


class ByteTagger:
    """Byte embeddings folded into the input gates, the layer and its output."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.layer = BiGru(hidden, draw)
        self.inputs = draw.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
        self.output = draw.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def train(self, crops: list[tuple[bytes, int]], steps: int = 400, seed: int = 5) -> None:
        """Fit on ``(bytes, language number)`` pairs, languages equally often."""
        draw = np.random.default_rng(seed)
        length, batch = 96, 64
        arrays = {
            "inputs": self.inputs,
            "weights": self.layer.weights,
            "output": self.output,
            "bias": self.bias,
        }
        adam = Adam(arrays, 0.02)
        by_language = [[c for c, k in crops if k == n and c] for n in range(len(self.languages))]
        usable = [n for n, own in enumerate(by_language) if own]
        for step in range(steps if usable else 0):
            bytes_ = np.zeros((length, batch), np.uint8)
            known = np.zeros((length, batch), np.float32)
            target = np.zeros(batch, np.int64)
            for column in range(batch):
                target[column] = usable[draw.integers(len(usable))]
                own = by_language[target[column]]
                crop = own[draw.integers(len(own))]
                at = draw.integers(max(len(crop) - length, 0) + 1)
                part = np.frombuffer(crop[at : at + length], np.uint8)
                bytes_[: len(part), column] = part
                known[: len(part), column] = 1
            adam.step(self._slopes(bytes_, known, target), 0.5 ** (3 * step / steps))

    def _slopes(self, bytes_: np.ndarray, known: np.ndarray, target: np.ndarray) -> dict:
        """Slopes of the mean cross-entropy over all known positions."""
        size = self.layer.hidden
        order = np.stack([bytes_, bytes_[::-1]], 1)
        mask = np.stack([known, known[::-1]], 1)[:, :, None]
        gates = np.stack([self.inputs[d][:, order[:, d]].transpose(1, 0, 2) for d in (0, 1)], 1)
        states, saved = self.layer.forward(gates, mask)
        both = np.concatenate([states[:, 0], states[::-1, 1]], 1)
        wrong = np.matmul(self.output, both) + self.bias[:, None]
        wrong = np.exp(wrong - wrong.max(1, keepdims=True))
        wrong /= wrong.sum(1, keepdims=True)
        wrong[:, target, np.arange(len(target))] -= 1
        wrong *= known[:, None] / max(known.sum(), 1)
        by_both = np.matmul(self.output.T, wrong)
        slopes = np.stack([by_both[:, :size], by_both[::-1, size:]], 1)
        by_gates, by_weights = self.layer.backward(slopes, mask, saved)
        by_inputs = np.zeros_like(self.inputs)
        for d in (0, 1):
            places = (order[:, d].reshape(-1, 1) == np.arange(256)).astype(np.float32)
            by_inputs[d] = by_gates[:, d].transpose(1, 0, 2).reshape(3 * size, -1) @ places
        flat_wrong = wrong.transpose(1, 0, 2).reshape(len(self.output), -1)
        flat_both = both.transpose(1, 0, 2).reshape(2 * size, -1)
        return {
            "inputs": by_inputs,
            "weights": by_weights,
            "output": flat_wrong @ flat_both.T,
            "bias": wrong.sum((0, 2)),
        }

    def positions(self, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities ``[T, language, column]`` of each byte.

        ``lengths`` must not grow from column to column; bytes behind a column's
        length get meaningless values.
        """
        size, span, width = self.layer.hidden, len(columns), columns.shape[1]
        score = np.zeros((span, len(self.languages), width), np.float32)
        score += self.bias[:, None]
        state = np.zeros((2, size, width), np.float32)
        gates = np.empty((2, 3 * size, width), np.float32)
        inner = np.empty_like(gates)
        halves = [np.ascontiguousarray(self.output[:, d * size : (d + 1) * size]) for d in (0, 1)]
        number = np.arange(width)
        for t in range(span):
            n = int(np.searchsorted(-lengths, -t))  # columns longer than t
            back = lengths[:n] - 1 - t
            gates[0][:, :n] = np.take(self.inputs[0], columns[t, :n], axis=1)
            gates[1][:, :n] = np.take(self.inputs[1], columns[back, number[:n]], axis=1)
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
            score[t, :, :n] += halves[0] @ now[0]
            score[back, :, number[:n]] += (halves[1] @ now[1]).T
        score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score

    def documents(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities ``[document, language]`` over all positions."""
        sizes = np.diff(offsets)
        runs = -(-sizes // RUN)
        owner = np.repeat(np.arange(len(sizes)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = offsets[:-1][owner] + nth * RUN
        lengths = np.minimum(RUN, offsets[1:][owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros((len(sizes), len(self.languages)))
        for first in range(0, len(order), COLUMNS):
            part = order[first : first + COLUMNS]
            span = int(lengths[part[0]])
            places = np.minimum(starts[part] + np.arange(span)[:, None], len(flat) - 1)
            shares = self.positions(flat[places], lengths[part])
            inside = np.arange(span)[:, None] < lengths[part]
            sums = np.einsum("tlc,tc->cl", shares, inside.astype(np.float32))
            np.add.at(total, owner[part], sums)
        return total / np.maximum(sizes, 1)[:, None]

    def spans(self, text: bytes) -> list[tuple[int, int, str]]:
        """Runs of byte positions with one most likely language."""
        label = []
        for at in range(0, len(text), RUN):
            part = np.frombuffer(text[at : at + RUN], np.uint8)
            shares = self.positions(part[:, None], np.array([len(part)]))
            label += shares[:, :, 0].argmax(1).tolist()
        cuts = [0, *(i for i in range(1, len(label)) if label[i] != label[i - 1]), len(label)]
        return [(a, b, self.languages[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def fit(labelled: DataFrame, per_language: int = 400, crop: int = 600, **shape) -> ByteTagger | None:
    """Train on rows of ``doc_id, text, lang``; ``None`` without any."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    shares = F.create_map(
        *(F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"])))
    )
    room = F.greatest(F.length("text") - crop, F.lit(0))
    at = F.floor(hash_share(F.col("doc_id"), 2) * (room + 1)).cast("int")
    drawn = rows.where(hash_share(F.col("doc_id"), 1) < shares[F.col("lang")])
    cut = drawn.select("doc_id", "lang", F.substring(F.col("text"), at + 1, F.lit(crop)).alias("part"))
    languages = [r["lang"] for r in counts]
    crops = sorted((r.part.encode(), languages.index(r.lang)) for r in cut.toLocalIterator())
    model = ByteTagger(languages, **shape)
    model.train(crops)
    return model


def predict(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            lettered = part.column("lettered").to_numpy(zero_copy_only=False)
            label = [UNKNOWN] * part.num_rows
            score = np.zeros(part.num_rows)
            if model is not None and lettered.any():
                shares = model.documents(*flat_bytes(part.column("text")))
                best = shares.argmax(1)
                score = np.where(lettered, np.clip(shares.max(1), 0, 1), 0.0)
                label = [model.languages[b] if k else UNKNOWN for b, k in zip(best, lettered, strict=True)]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(label), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


