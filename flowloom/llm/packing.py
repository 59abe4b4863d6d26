"""Bounded-space packing of tokenised documents into fixed windows.

Each task reads documents one after another, tokenises them and keeps at most
``open_windows`` windows open.  A document's full windows are emitted at once;
the rest goes to the open window where it leaves the least room.  When it fits
none, a new window is opened or, at the limit, the fullest one is emitted first.
If that one still misses ``least_cut`` tokens or more, it is filled up with the
head of the piece, so an emitted window has fewer than ``least_cut`` of padding.

What a task leaves open is merged in rounds of ``fan_in`` tasks by the same rule
until one group is left.  Its last open windows are filled with one another, and
the final rest is cut into sequences whose lengths are powers of two, which need
no padding.

Result rows are pieces: ``sequence_id, offset, doc_id, start, length,
doc_tokens, ids``, with ``ids`` as little-endian unsigned 32-bit values.  The
end id belongs to its document, so null and empty texts are one piece of one id.
Equal texts and repeated rows are packed as often as they occur, in the order
they are read.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import flat_bytes, partition_number, slices, stored, texts

PIECES = (
    "round int, task long, sequence_id long, offset long, doc_id long, start long, "
    "length long, doc_tokens long, ids binary, open boolean"
)
_ARROW = pa.schema(
    [
        ("round", pa.int32()),
        ("task", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("open", pa.bool_()),
    ]
)
#: Characters whose normal form, lower case and class are beyond doubt; texts
#: with others are tokenised as a whole by the library.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-¬®-±´¶-¸»¿-ÖØ-öø-ÿ×÷]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_CACHED = 100_000
#: Bytes of a part that is merged together with others; longer ones go to the library.
_WIDEST = 64
_NONE = np.iinfo(np.int32).max
_SPREAD = np.uint32(0x9E3779B1)


class _Known:
    """Ids of the words met so far, which are numbered in order of arrival."""

    def __init__(self):
        self.number = pa.array([], pa.string())
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of distinct words, and those that are new and still to be added."""
        found = pc.index_in(words, value_set=self.number)
        new = found.is_null().to_numpy(zero_copy_only=False)
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        numbers[new] = len(self.number) + np.arange(int(new.sum()))
        return numbers, words.filter(pa.array(new))

    def add(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New words and their ids, one after another."""
        self.number = pa.concat_arrays([self.number, words])
        ends = np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered words in a row, and how many each has."""
        sizes = self.sizes[numbers]
        return _gather(self.flat, self.starts[numbers], sizes), sizes


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given runs of an array, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class _Merges:
    """Byte-pair merges of many parts at once, each as the library does it: of the
    pairs of a part the one of least rank, the first of equal ones, until none is
    left."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        signs = _byte_signs()
        self.inner = np.array([vocab[c] for c in signs], np.int32)
        self.last = np.array([vocab[c + suffix] for c in signs], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.bits = max(len(pairs).bit_length() + 2, 8)
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        keys = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs], np.uint32)
        # A pair named twice has its last rank.
        keys, at = np.unique(keys[::-1], return_index=True)
        ranks = (len(pairs) - 1 - at).astype(np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == 0xFFFFFFFF
            chosen = np.flatnonzero(free)[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[chosen]], self.ranks[slots[chosen]] = keys[chosen], ranks[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, ranks = keys[left], ranks[left]
            slots = (slots[left] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of(cls, shape: dict) -> _Merges | None:
        """The merges of a vocabulary file; ``None`` if it works in another way."""
        model = shape["model"]
        plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None}
        plain |= {"ignore_merges": False}
        if any((model.get(name) or None) != (value or None) for name, value in plain.items()):
            return None
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
        if not suffix or max(vocab.values()) >= 0xFFFF or len(model["merges"]) >= _NONE // _WIDEST:
            return None
        if not all(c in vocab and c + suffix in vocab for c in _byte_signs()):
            return None
        return cls(model)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        keys = x.astype(np.uint32) << np.uint32(16) | y.astype(np.uint32)
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], _NONE)
        at = np.flatnonzero((held != keys) & (held != 0xFFFFFFFF))
        while len(at):
            slots[at] = (slots[at] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[at]]
            same = held == keys[at]
            out[at[same]] = self.ranks[slots[at[same]]]
            at = at[~same & (held != 0xFFFFFFFF)]
        return out

    def _ordered(self, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of pairs as one number."""
        rank = self.rank(x, y)
        return np.where(rank < _NONE, rank * _WIDEST + place, _NONE).astype(np.int32)

    def encode(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of 1 to ``_WIDEST`` bytes one after another, and how many each has."""
        found, counts, order = [], [], []
        low = 0
        for high in (*range(1, 17), 20, 24, 32, 48, _WIDEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(rows), 1 << 14):
                own = rows[at : at + (1 << 14)]
                ids, count = self._encode(flat, starts[own], sizes[own], high)
                found.append(ids)
                counts.append(count)
                order.append(own)
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        counts, order = np.concatenate(counts), np.concatenate(order)
        out, begins = np.zeros((2, len(sizes)), np.int64)
        out[order], begins[order] = counts, np.cumsum(counts) - counts
        return _gather(np.concatenate(found), begins, out), out

    def _encode(self, flat, starts, sizes, width) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of parts of at most ``width`` bytes; a column is a part."""
        count, line = len(starts), np.arange(width)[:, None]
        inside = line < sizes
        raw = flat[np.where(inside, starts + line, 0)]
        ids = np.where(line == sizes - 1, self.last[raw], self.inner[raw])
        ids[~inside] = -1
        if width > 1:
            pairs = np.full((width, count), _NONE, np.int32)
            here = line[1:] < sizes
            places = np.broadcast_to(line[:-1], here.shape)
            pairs[:-1][here] = self._ordered(ids[:-1][here], ids[1:][here], places[here])
            self._merge(ids, pairs, sizes)
        kept = ids.T >= 0
        return ids.T[kept].astype(np.uint32), kept.sum(1)

    def _merge(self, ids: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> None:
        """One merge of each part at a time, in place; parts that are done are left out."""
        width, count = ids.shape
        after = np.repeat(np.arange(1, width + 1), count)
        before = after - 2
        all_ids, all_pairs = ids.reshape(-1), pairs.reshape(-1)
        rows, live = np.arange(count), pairs
        while True:
            best = live.min(0)
            some = best < _NONE
            left = int(some.sum())
            if not left:
                return
            best, own = best[some], rows[some]
            if 4 * left < 3 * len(rows):
                rows = own
            place = (best % _WIDEST).astype(np.int64)
            at = place * count + own
            right = after[at] * count + own
            following = after[right]
            new = self.merged[best // _WIDEST]
            all_ids[at], all_ids[right], all_pairs[right], all_pairs[at] = new, -1, _NONE, _NONE
            after[at] = following
            more = np.flatnonzero(following < sizes[own])
            then = following[more] * count + own[more]
            before[then] = place[more]
            all_pairs[at[more]] = self._ordered(new[more], all_ids[then], place[more])
            prior = before[at]
            more = np.flatnonzero(prior >= 0)
            back = prior[more] * count + own[more]
            all_pairs[back] = self._ordered(all_ids[back], new[more], prior[more])
            live = pairs if len(rows) == count else pairs[:, rows]


def _byte_signs() -> list[str]:
    """The character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    signs = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


#: Letter 1, digit 2, rest 0; the lead byte 0xC3 is told by the byte behind it.
_KIND = np.zeros(256, np.int8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2


def _part_starts(words: pa.Array, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the parts of lower-case words of beyond-doubt characters."""
    kind = _KIND[flat]
    behind = np.append(flat[1:], np.uint8(0))
    kind[(flat == 0xC3) & (behind >= 0x9F) & (behind != 0xB7)] = 1
    tail = (flat >= 0x80) & (flat < 0xC0)
    kind[tail] = kind[np.flatnonzero(tail) - 1]
    cut = np.ones(len(flat), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    cut[tail] = False
    # Endings with an apostrophe are parts of their own.
    for n in np.unique(np.searchsorted(bounds, np.flatnonzero(flat == ord("'")), side="right") - 1).tolist():
        at = int(bounds[n])
        cut[at : int(bounds[n + 1])] = False
        for part in _PARTS.findall(words[n].as_py()):
            cut[at] = True
            at += len(part.encode())
    return np.flatnonzero(cut)


class WordTokenizer:
    """Ids of whole texts; the ids of each distinct word are worked out once.

    The vocabulary splits a text at blanks and further into parts before it
    merges letters, so a text's ids are its parts' ids one after another.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            shape = json.load(source)
        self._whole = Tokenizer.from_file(path)
        self._merges = _Merges.of(shape)
        self._words = _Known()

    @classmethod
    def of(cls, path: str | None) -> WordTokenizer:
        """The tokenizer of this worker; ``None`` is the public word vocabulary."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _learn(self, fresh: pa.Array) -> None:
        """Work out the words not met before."""
        flat, bounds = flat_bytes(fresh)
        starts = _part_starts(fresh, flat, bounds)
        sizes = np.diff(np.append(starts, len(flat)))
        word = np.searchsorted(bounds, starts, side="right") - 1
        wide = np.unique(word[sizes > _WIDEST])
        if len(wide):
            narrow = ~np.isin(word, wide)
            starts, sizes, word = starts[narrow], sizes[narrow], word[narrow]
        ids, counts = self._merges.encode(flat, starts, sizes)
        counts = np.bincount(word, weights=counts, minlength=len(fresh)).astype(np.int64)
        begins = np.cumsum(counts) - counts
        long = [self._whole.encode(fresh[n].as_py(), add_special_tokens=False).ids for n in wide.tolist()]
        for n, own in zip(wide.tolist(), long, strict=True):
            begins[n], counts[n] = len(ids), len(own)
            ids = np.append(ids, np.array(own, np.uint32))
        self._words.add(fresh, _gather(ids, begins, counts), counts)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        if len(self._words.number) > _CACHED:
            self._words = _Known()
        plain = [i for i, t in enumerate(batch) if self._merges and "<|" not in t and _PLAIN.fullmatch(t)]
        lower = pc.utf8_lower(pa.array([batch[i] for i in plain], pa.string()))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        distinct, fresh = self._words.numbers(words.dictionary)
        if len(fresh):
            self._learn(fresh)
        flat, sizes = self._words.ids(distinct[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[split.offsets.to_numpy()]
        out: list = [None] * len(batch)
        for n, i in enumerate(plain):
            out[i] = flat[bounds[n] : bounds[n + 1]]
        for i, text in enumerate(batch):
            if out[i] is None:
                whole = self._whole.encode(text, add_special_tokens=False)
                out[i] = np.array(whole.ids, np.uint32)
        return out


class Packer:
    """Open windows of one task, and the rows of the finished ones."""

    def __init__(self, size: int, open_windows: int, least_cut: int, round_: int, task: int):
        self.size, self.limit, self.least_cut = size, open_windows, least_cut
        self.round, self.task = round_, task
        self.room: list[tuple[int, int]] = []  # (free, window), by free
        self.windows: dict[int, list] = {}
        self.sequences = itertools.count()
        self.numbers = itertools.count()
        self.rows: list[tuple] = []
        self.held_bytes = 0

    def _emit(self, pieces: list[tuple], open_: bool = False) -> None:
        sequence = self.round << 56 | self.task << 28 | next(self.sequences)
        offset = 0
        for doc_id, start, ids, total in pieces:
            row = (sequence, offset, doc_id, start, len(ids), total, ids.tobytes(), open_)
            self.rows.append((self.round, self.task, *row))
            offset += len(ids)
            self.held_bytes += 4 * len(ids) + 64

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Place a whole document."""
        full = len(ids) // self.size * self.size
        for start in range(0, full, self.size):
            self._emit([(doc_id, start, ids[start : start + self.size], len(ids))])
        if full < len(ids):
            self.place((doc_id, full, ids[full:], len(ids)))

    def place(self, piece: tuple) -> None:
        """Best fit among the open windows; see the module text."""
        doc_id, start, ids, total = piece
        at = bisect.bisect_left(self.room, (len(ids), -1))
        if at == len(self.room) and len(self.room) >= self.limit:
            free, window = self.room.pop(0)
            pieces = self.windows.pop(window)
            if free >= self.least_cut:
                pieces.append((doc_id, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            self._emit(pieces)
            at = bisect.bisect_left(self.room, (len(ids), -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            free, window = self.size, next(self.numbers)
            self.windows[window] = []
        self.windows[window].append((doc_id, start, ids, total))
        free -= len(ids)
        if free:
            bisect.insort(self.room, (free, window))
        else:
            self._emit(self.windows.pop(window))

    def leave_open(self) -> None:
        """Hand the open windows to the next round."""
        for _, window in self.room:
            self._emit(self.windows.pop(window), open_=True)
        self.room.clear()

    def finish(self) -> None:
        """Fill the open windows with one another; the rest in powers of two."""
        rest = [piece for _, window in self.room for piece in self.windows.pop(window)]
        self.room.clear()
        left = sum(len(p[2]) for p in rest)
        lengths = [self.size] * (left // self.size)
        left %= self.size
        lengths += [1 << b for b in range(self.size.bit_length(), -1, -1) if left >> b & 1]
        rest.reverse()
        for length in lengths:
            pieces = []
            while length:
                doc_id, start, ids, total = rest.pop()
                pieces.append((doc_id, start, ids[:length], total))
                if len(ids) > length:
                    rest.append((doc_id, start + length, ids[length:], total))
                length -= len(pieces[-1][2])
            self._emit(pieces)

    def table(self) -> pa.Table:
        """The finished rows so far."""
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in _ARROW]
        out = pa.table([list(c) for c in columns], schema=_ARROW)
        self.rows, self.held_bytes = [], 0
        return out


def _pack_task(size, open_windows, least_cut, end_id, path):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        packer = Packer(size, open_windows, least_cut, 0, partition_number())
        end = np.array([end_id], np.uint32)
        for part in slices(batches, "text", 2 << 20):
            ids = tokenizer.encode(part.column("text").to_pylist())
            for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                packer.document(doc_id, np.concatenate([own, end]))
                if packer.held_bytes > 8 << 20:
                    yield from packer.table().to_batches()
        packer.leave_open()
        yield from packer.table().to_batches()

    return run


def _merge_group(size, open_windows, least_cut, round_, last):
    def run(rows: pa.Table) -> pa.Table:
        task = rows.column("group")[0].as_py()
        packer = Packer(size, open_windows, least_cut, round_, task)
        names = ("length", "doc_id", "start", "doc_tokens", "ids")
        pieces = sorted(
            zip(*(rows.column(n).to_pylist() for n in names), strict=True),
            key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[4]),
        )
        for _, doc_id, start, total, ids in pieces:
            packer.place((doc_id, start, np.frombuffer(ids, np.uint32), total))
        if last:
            packer.finish()
        else:
            packer.leave_open()
        return packer.table()

    return run


def pack(
    docs: DataFrame,
    size: int = 4096,
    open_windows: int = 64,
    least_cut: int = 32,
    end_id: int = 2,
    tokenizer: str | None = None,
    fan_in: int = 32,
) -> DataFrame:
    """Pieces of all documents; see the module text for rules and columns."""
    if open_windows < 1 or least_cut < 1 or size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two, the other limits at least 1")
    source = texts(docs)
    tasks = source.rdd.getNumPartitions()
    done = stored(
        source.mapInArrow(_pack_task(size, open_windows, least_cut, end_id, tokenizer), PIECES),
        "pack",
    )
    finished = [done.where(~F.col("open"))]
    left = done.where(F.col("open"))
    round_ = 0
    while True:
        round_ += 1
        tasks = -(-tasks // fan_in)
        grouped = left.withColumn("group", F.floor(F.col("task") / fan_in))
        merge = _merge_group(size, open_windows, least_cut, round_, tasks <= 1)
        done = stored(grouped.groupBy("group").applyInArrow(merge, PIECES), "pack")
        finished.append(done.where(~F.col("open")))
        left = done.where(F.col("open"))
        if tasks <= 1:
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.drop("round", "task", "open")
