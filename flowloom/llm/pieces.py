"""Piece encoding by a table of distinct chunks, and decoding.

A piece vocabulary marks blanks: a text becomes ``marker + text`` with a marker for
every blank.  Where no piece has a marker behind another character, no merge can
cross from one marked word (a run of markers and what follows up to the next run)
to the next, so a text's ids are its marked words' ids one after another.  Each
task keeps a table of the distinct marked words it has met.  New ones of a slice
of documents are segmented in one call, and the ids of all words are joined back
by position with array lookups.  The table starts anew beyond ``most_words`` words,
which changes no ids, so memory is bounded whatever the corpus holds; nothing is
shuffled and a lost executor costs its running tasks only.  A vocabulary that
rewrites characters, or whose pieces can cross markers, has its texts segmented
whole.

Null text is empty and has only the end id.  Texts are never cut, however long;
equal texts and repeated rows are encoded as often as they occur; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import slices, texts

MARK = "▁"
CODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text string"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class PieceTable:
    """Distinct marked words of one task with their ids; see the module text.

    ``path`` names the vocabulary; ``None`` is the public piece vocabulary.
    """

    def __init__(self, path: str | None = None, most_words: int = 400_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model = SentencePieceProcessor(model_file=path)
        self.most_words = most_words
        shape = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rules = shape.normalizer_spec
        plain = not (rules.precompiled_charsmap or rules.remove_extra_whitespaces)
        inside = any(MARK in p.piece.lstrip(MARK) for p in shape.pieces)
        known = self.model.piece_to_id(MARK) != self.model.unk_id()
        behind = shape.trainer_spec.treat_whitespace_as_suffix
        self.prefixed = rules.add_dummy_prefix
        self.apart = plain and known and self.prefixed and not inside and not behind
        self._pieces(shape)
        self._clear()

    def _pieces(self, shape) -> None:
        """What each id stands for: bytes, with markers as blanks."""
        kinds = shape.SentencePiece
        spelled = []
        self.leads = np.array([p.piece.startswith(MARK) for p in shape.pieces])
        self.is_byte = np.zeros(len(shape.pieces), bool)
        for n, piece in enumerate(shape.pieces):
            if piece.type == kinds.BYTE:
                self.is_byte[n] = True
                spelled.append(bytes([int(piece.piece[3:-1], 16)]))
            elif piece.type == kinds.CONTROL:
                spelled.append(b"")
            elif piece.type == kinds.UNKNOWN:
                spelled.append(shape.trainer_spec.unk_surface.encode())
            else:
                spelled.append(piece.piece.replace(MARK, " ").encode())
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _clear(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.word_begins = self.word_sizes = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.int32)

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text, without their first marker."""
        if not text:
            return []
        if not self.apart:
            return [text]
        if "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [chunk[1:] for chunk in _MARKED.findall(marked)]

    def _learn(self) -> None:
        """Segment the marked words not met before, each once."""
        fresh = list(itertools.islice(self.number, len(self.word_begins), None))
        if not fresh:
            return
        coded = self.model.encode(fresh, num_threads=1)
        if self.apart and "" in fresh:  # a marker alone, behind a last blank
            coded[fresh.index("")] = [self.model.piece_to_id(MARK)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes.sum()))
        begins = len(self.word_ids) + np.cumsum(sizes) - sizes
        self.word_begins = np.concatenate([self.word_begins, begins])
        self.word_sizes = np.concatenate([self.word_sizes, sizes])
        self.word_ids = np.concatenate([self.word_ids, flat])

    def encode(self, batch: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin and end."""
        if len(self.number) > self.most_words:
            self._clear()
        words = [self.chunks(text) for text in batch]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(
            map(self.number.__getitem__, itertools.chain.from_iterable(words)),
            np.int64,
            int(counts.sum()),
        )
        self._learn()
        sizes = self.word_sizes[numbers]
        word_ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = _gather(self.word_ids, self.word_begins[numbers], sizes)
        bounds = word_ends[np.concatenate([[0], np.cumsum(counts)])]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids.

        Bytes that are no UTF-8 become replacement characters, one for each byte.
        """
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = _gather(self.spelled, self.begins[ids], sizes).tobytes()
        cuts = ends[bounds].tolist()
        out = []
        for n, (begin, end) in enumerate(itertools.pairwise(cuts)):
            try:
                text = flat[begin:end].decode()
            except UnicodeDecodeError:
                text = self._piecewise(ids[bounds[n] : bounds[n + 1]])
            marked = begin < end and self.leads[self._first(ids[bounds[n] : bounds[n + 1]])]
            out.append(text[1:] if self.prefixed and marked else text)
        return out

    def _first(self, ids: np.ndarray) -> int:
        """The first id that stands for anything."""
        return int(ids[0] if self.sizes[ids[0]] else ids[np.argmax(self.sizes[ids] > 0)])

    def _piecewise(self, ids: np.ndarray) -> str:
        """Decode runs of byte pieces apart from the other pieces."""
        parts = []
        for loose, run in itertools.groupby(ids.tolist(), self.is_byte.__getitem__):
            raw = b"".join(
                self.spelled[self.begins[i] : self.begins[i] + self.sizes[i]].tobytes() for i in run
            )
            parts.append(_lenient(raw) if loose else raw.decode())
        return "".join(parts)


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that fits nowhere."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as fault:
            out.append(raw[: fault.start].decode() + "�")
            raw = raw[fault.start + 1 :]
    return "".join(out)


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given runs of an array, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]


def _encode_task(path: str | None, end_id: int | None, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path, most_words)
        for part in slices(batches, "text", 2 << 20):
            ids, bounds = table.encode(part.column("text").to_pylist(), end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def _decode_task(path: str | None, most_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(path)
        for batch in batches:
            for part in _id_slices(batch, most_ids):
                lists = part.column("ids")
                bounds = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy()[bounds[0] : bounds[-1]]
                decoded = pa.array(table.decode(ids, bounds - bounds[0]), pa.string())
                yield pa.record_batch(
                    [part.column("doc_id"), lists, decoded], names=["doc_id", "ids", "text"]
                )

    return run


def _id_slices(batch: pa.RecordBatch, most_ids: int) -> Iterator[pa.RecordBatch]:
    """Ranges of rows with about ``most_ids`` ids each."""
    if not batch.num_rows:
        return
    ends = batch.column("ids").offsets.to_numpy().astype(np.int64)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + most_ids, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def encode(
    docs: DataFrame, end_id: int | None = 2, model: str | None = None, most_words: int = 400_000
) -> DataFrame:
    """``doc_id, ids`` of every document; see the module text.

    ``end_id`` is put behind each text's ids (``None``: nothing is), ``model`` is the
    path of a vocabulary that every executor can read.
    """
    return texts(docs).mapInArrow(_encode_task(model, end_id, most_words), CODED)


def decode(coded: DataFrame, model: str | None = None, most_ids: int = 1 << 20) -> DataFrame:
    """``doc_id, ids, text``: the texts of id lists; null lists are empty."""
    lists = coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"),
    )
    return lists.mapInArrow(_decode_task(model, most_ids), DECODED)
