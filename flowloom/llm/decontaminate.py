"""Benchmark phrases found through a positional inverted index.

The index is cut into segments of whole documents.  Within a segment all words
have one position axis with a gap between documents, and a row holds the sorted
positions of one word (its postings), as differences.  A further row per segment
is its directory: document ids and word counts.

A search takes test phrases of bounded total size at a time (further blocks
follow), reads the postings of their words only, and in each segment starts from
the rarest word of a phrase: its postings, moved back by the word's place in the
phrase, are intersected with those of the next rarest until no start is left or
all words agree.  Proximity search finds the spans that hold all words of a
phrase within ``slop`` further words, in any order, around the rarest word.

Words are runs of ASCII letters (lower-cased) and digits and of characters
beyond ASCII.  Null and empty texts have no words.  Every row is a document of
its own and gets a result row, also when ids repeat or are null.  Repeated
phrases are searched once and credited to all their items; an item of fewer
words than a window is one phrase.  Items without a word find nothing; those
without an id are searched with ``unnamed`` and count as one item of null id.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import byte_rows, partition_number, slices, stored, texts

WINDOW = 10
#: Free positions between documents; no phrase is longer.
_GAP = 64
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
INDEX = "segment long, word binary, positions binary, ids binary, sizes binary"
HITS = (
    "segment long, ordinal int, doc_id long, "
    "matches array<struct<item_id: string, start: int, length: int>>"
)
_HITS = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        (
            "matches",
            pa.list_(
                pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
            ),
        ),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in order."""
    return text.translate(_WORD_BYTES).split()


class _Segment:
    def __init__(self, number: int):
        self.number = number
        self.numbers = defaultdict(itertools.count().__next__)
        self.codes: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.total += len(words)

    def rows(self) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        bases = np.cumsum(sizes + _GAP) - (sizes + _GAP)
        codes = np.concatenate(self.codes)
        own = np.cumsum(sizes) - sizes
        places = np.arange(len(codes)) + np.repeat(bases - own, sizes)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(self.numbers))
        words = len(self.numbers)
        ends = np.cumsum(counts)
        steps = np.diff(places[order], prepend=0)
        firsts = (ends - counts)[counts > 0]
        steps[firsts] = places[order][firsts]
        offsets = np.concatenate([[0], ends]) * 4
        postings = pa.Array.from_buffers(
            pa.binary(),
            words,
            [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(steps.astype(np.uint32))],
        )
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        return pa.record_batch(
            [
                pa.array([self.number] * (words + 1), pa.int64()),
                pa.array([*self.numbers, None], pa.binary()),
                pa.concat_arrays([postings, pa.array([None], pa.binary())]),
                pa.array([None] * words + [ids.tobytes() + known.tobytes()], pa.binary()),
                pa.array([None] * words + [sizes.tobytes()], pa.binary()),
            ],
            names=["segment", "word", "positions", "ids", "sizes"],
        )


def _directory(ids: bytes, sizes: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    lengths = np.frombuffer(sizes, np.int64)
    raw = np.frombuffer(ids[: 8 * len(lengths)], np.int64)
    known = np.frombuffer(ids[8 * len(lengths) :], np.bool_)
    own = [int(i) if k else None for i, k in zip(raw, known, strict=True)]
    return own, np.cumsum(lengths + _GAP) - (lengths + _GAP), lengths


def build_index(docs: DataFrame, segment_words: int = 1_000_000) -> DataFrame:
    """Postings of every word of every document; written without a shuffle.

    A segment ends with the document that brings it to ``segment_words``, a
    document counting as one word more than it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = partition_number() << 32
        numbers = itertools.count(base)
        segment = _Segment(next(numbers))
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, byte_rows(part.column("text")), strict=True):
                segment.add(doc_id, words_of(text))
                if segment.total + len(segment.ids) >= segment_words:
                    yield segment.rows()
                    segment = _Segment(next(numbers))
        if segment.ids:
            yield segment.rows()

    return stored(texts(docs).mapInArrow(run, INDEX), "postings")


def document_words(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every indexed document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("segment", "ids", "sizes"))
            for segment, ids, sizes in zip(*columns, strict=True):
                own, _, lengths = _directory(ids, sizes)
                yield pa.record_batch(
                    [
                        pa.array([segment] * len(own), pa.int64()),
                        pa.array(np.arange(len(own), dtype=np.int32)),
                        pa.array(own, pa.int64()),
                        pa.array(lengths),
                    ],
                    names=["segment", "ordinal", "doc_id", "n_words"],
                )

    directory = index.where(F.col("word").isNull()).select("segment", "ids", "sizes")
    return directory.mapInArrow(run, "segment long, ordinal int, doc_id long, n_words long")


class Phrases:
    """A block of test phrases: distinct word sequences and their items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, words in items:
            for at in range(max(len(words) - window, 0) + 1 if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.phrases = sorted(owners)
        self.items = [sorted(owners[p], key=lambda i: (i is None, i or "")) for p in self.phrases]
        self.words = sorted({w for p in self.phrases for w in p})
        number = {w: n for n, w in enumerate(self.words)}
        self.codes = [np.array([number[w] for w in p]) for p in self.phrases]


def phrase_blocks(
    items: DataFrame, window: int, most_words: int, unnamed: bool = False
) -> Iterator[Phrases]:
    """The test items in blocks of about ``most_words`` words, those without an id
    if ``unnamed``."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    held: list = []
    total = 0
    if not unnamed:
        rows = rows.where(F.col("item_id").isNotNull())
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode())
        held.append((row.item_id, words))
        total += len(words)
        if total >= most_words:
            yield Phrases(held, window)
            held, total = [], 0
    if held:
        yield Phrases(held, window)


def _starts(codes: np.ndarray, counts: np.ndarray, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Positions where the words follow each other, from the rarest word on."""
    order = np.argsort(counts[codes], kind="stable")
    found = None
    for at in order:
        places = postings[int(codes[at])] - int(at)
        if found is None:
            found = places
        else:
            near = np.searchsorted(places, found)
            near[near == len(places)] = 0
            found = found[places[near] == found]
        if not len(found):
            break
    return found


def _spans(codes: np.ndarray, counts, postings, bases, sizes, reach: int) -> list[tuple]:
    """Shortest spans around the rarest word that hold all words, within a text."""
    need = dict(zip(*np.unique(codes, return_counts=True), strict=True))
    rarest = min(need, key=lambda c: (counts[c], c))
    out = set()
    for centre in postings[int(rarest)]:
        doc = np.searchsorted(bases, centre, side="right") - 1
        low = max(centre - reach + 1, bases[doc])
        high = min(centre + reach, bases[doc] + sizes[doc])
        near = []
        for code, times in need.items():
            places = postings[int(code)]
            own = places[np.searchsorted(places, low) : np.searchsorted(places, high)]
            if len(own) < times:
                break
            near.append((own, times))
        else:
            best = None
            for first in np.unique(np.concatenate([n[0] for n in near])):
                lasts = [(own, np.searchsorted(own, first) + times - 1) for own, times in near]
                if any(at >= len(own) for own, at in lasts):
                    break
                last = max(own[at] for own, at in lasts)
                span = (int(last - first + 1), int(first))
                if span[0] <= reach and first <= centre <= last and (best is None or span < best):
                    best = span
            if best:
                out.add(best[::-1])
    return sorted(out)


def _search_segment(phrases: Phrases, slop: int | None):
    lengths = np.array([len(c) for c in phrases.codes])
    widest = lengths.max(initial=1)
    grid = np.array([np.pad(c, (0, widest - len(c)), mode="edge") for c in phrases.codes])
    number = {w: n for n, w in enumerate(phrases.words)}

    def run(rows: pa.Table) -> pa.Table:
        counts = np.zeros(len(phrases.words), np.int64)
        postings: dict[int, np.ndarray] = {}
        names = ("word", "positions", "ids", "sizes")
        for word, steps, ids, sizes in zip(*(rows.column(n).to_pylist() for n in names), strict=True):
            if word is None:
                own, bases, lengths = _directory(ids, sizes)
            else:
                places = np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)
                postings[number[word]] = places
                counts[number[word]] = len(places)
        hits: dict[int, list] = {}
        possible = np.flatnonzero((counts[grid] > 0).all(axis=1)) if len(grid) else []
        for p in possible:
            codes = phrases.codes[p]
            if slop is None:
                found = [(int(s), len(codes)) for s in _starts(codes, counts, postings)]
            else:
                found = _spans(codes, counts, postings, bases, lengths, len(codes) + slop)
            for start, length in found:
                doc = int(np.searchsorted(bases, start, side="right")) - 1
                for item in phrases.items[p]:
                    match = {"item_id": item, "start": start - int(bases[doc]), "length": length}
                    hits.setdefault(doc, []).append(match)
        docs = sorted(hits)
        return pa.table(
            [
                [rows.column("segment")[0].as_py()] * len(docs),
                docs,
                [own[d] for d in docs],
                [hits[d] for d in docs],
            ],
            schema=_HITS,
        )

    return run


def _block_rows(index: DataFrame, phrases: Phrases) -> DataFrame:
    """The postings of a block's words and the directories."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(w),) for w in phrases.words], "word binary")
    # At most ``most_words`` rows by construction of the block.
    known = index.join(F.broadcast(wanted), "word", "left_semi")
    return known.unionByName(index.where(F.col("word").isNull()))


def search(
    index: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slop: int | None = None,
    most_words: int = 200_000,
    unnamed: bool = False,
) -> DataFrame:
    """Documents with matches, one row per document and block of test phrases:
    ``segment, ordinal, doc_id, matches`` (item, first word, number of words).

    Without ``slop`` matches are exact phrases; with it, the spans that hold a
    phrase's words in any order with at most that many words between them.
    ``most_words`` bounds a block; all blocks are searched.
    """
    if window > _GAP:
        raise ValueError(f"a window has at most {_GAP} words")
    found = index.sparkSession.createDataFrame([], HITS)
    for phrases in phrase_blocks(items, window, most_words, unnamed):
        if phrases.words:
            rows = _block_rows(index, phrases)
            hits = rows.groupBy("segment").applyInArrow(_search_segment(phrases, slop), HITS)
            found = found.unionByName(hits)
    return found


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, unnamed: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items``.

    ``n_hit`` counts the words inside any match, ``items`` lists the matched
    items in text order, and null last if one without an id matched (``unnamed``).
    """
    index = build_index(docs)
    hits = search(index, items, window, unnamed=unnamed).groupBy("segment", "ordinal").agg(
        F.flatten(F.collect_list("matches")).alias("matches")
    )
    inside = F.transform("matches", lambda m: F.sequence(m.start, m.start + m.length - 1))
    hits = hits.select(
        "segment",
        "ordinal",
        F.size(F.array_distinct(F.flatten(inside))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("matches.item_id")).alias("items"),
    )
    return (
        document_words(index)
        .join(hits, ["segment", "ordinal"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
