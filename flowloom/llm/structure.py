"""Repair of conversation structure by weighted interval parsing.

A legal conversation's roles, written by their first letters, are nothing or
``s?(ua)+``.  Rows may be kept, given another role or deleted, and empty messages
may be inserted; ``COSTS`` prices each edit, and a row whose fault asks for it must
go.  Of the cheapest repairs the one with the least string of edit initials (the
audit) is taken.

The grammar is in Chomsky normal form.  A symbol ``(h, t)`` stands for role letters
from ``h`` to ``t`` in which every neighbouring pair is legal, ``("", "")`` for none;
``(h, t) -> (h, p) (q, t)`` is a rule where the pair ``pq`` is legal, a single row
is a terminal.  The cell of a span holds for each symbol the least (cost, audit),
and is closed under insertion at both ends.  Cells are combined bottom-up by span
length over all splits, for at most ``FAN`` neighbouring spans at a time: rows
first, then spans of ``FAN`` rows, and so on.  That is exact, as cells hold every
symbol and combining is associative: two audits of one span and cost are never one
the beginning of the other, so the least audit stays least whatever follows.  Spans
with the same row kinds share their cell.

Rows are dealt out in ranges of conversation and turn.  A conversation inside one
range is repaired there; one that reaches over a border is repaired in parts, whose
cells are combined in rounds of ``FAN`` and whose edits then return to the parts, so
no conversation has to fit into a task.  Only its digest is worked out in one task,
which reads the repaired lines in order and holds one batch at a time.

Rows of a conversation are ordered by turn (nulls first), then role, then a hash of
the text; equal rows stay.  Null roles and texts are one space, a role without a
legal first letter cannot be kept, a null conversation id is a conversation of its
own, texts may be of any length, other columns are ignored, and an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import partition_number, runs_of, stored

COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What a truncated row costs besides, unless it is deleted.
TRUNCATED_COST = 5
LEGAL = {"su", "ua", "au"}
NOTHING = ("", "")
#: Symbols of whole conversations.
ACCEPTED = (NOTHING, ("u", "a"), ("s", "a"))
NAMES = {"s": "system", "u": "user", "a": "assistant"}
SYMBOLS = (
    NOTHING,
    *((h, t) for h in "sua" for t in "sua" if t != "s" or h == "s"),
)
FAN = 16
#: Kinds of rows: one that must go, or its first letter, where that is legal (in
#: upper case if the row is truncated).
GONE, OTHER = "x", "o"

Cell = dict[tuple[str, str], tuple[int, str]]


def _joins(left: tuple[str, str], right: tuple[str, str]) -> tuple[str, str] | None:
    """The symbol of two neighbouring ones, if a rule has them."""
    if NOTHING in (left, right):
        return right if left == NOTHING else left
    return (left[0], right[1]) if left[1] + right[0] in LEGAL else None


RULES = tuple((a, b, c) for a in SYMBOLS for b in SYMBOLS if (c := _joins(a, b)) is not None)
_INSERTIONS = tuple((c, c) for c in "ua")


def _offer(cell: Cell, symbol: tuple[str, str], found: tuple[int, str]) -> bool:
    if symbol not in cell or found < cell[symbol]:
        cell[symbol] = found
        return True
    return False


def closed(cell: Cell) -> Cell:
    """The cell with insertions at its ends, as many as make anything cheaper."""
    fresh = list(cell)
    while fresh:
        symbol = fresh.pop()
        cost, audit = cell[symbol]
        for inserted in _INSERTIONS:
            for after, edits in (
                (_joins(inserted, symbol), "I" + audit),
                (_joins(symbol, inserted), audit + "I"),
            ):
                if after is not None and _offer(cell, after, (cost + COSTS["I"], edits)):
                    fresh.append(after)
    return cell


def combined(pairs: Sequence[tuple[Cell, Cell]]) -> Cell:
    """The cell of a span from the cells of its splits."""
    out: Cell = {}
    for left, right in pairs:
        for a, b, symbol in RULES:
            if a in left and b in right:
                cost = left[a][0] + right[b][0]
                if symbol not in out or cost <= out[symbol][0]:
                    _offer(out, symbol, (cost, left[a][1] + right[b][1]))
    return closed(out)


@lru_cache(maxsize=64)
def row_cell(kind: str) -> Cell:
    """The cell of one row."""
    cell: Cell = {NOTHING: (COSTS["D"], "D")}
    if kind != GONE:
        extra = TRUNCATED_COST if kind.isupper() else 0
        letter = kind.lower()
        if letter in NAMES:
            _offer(cell, (letter, letter), (COSTS["K"] + extra, "K"))
        for target in "ua":
            _offer(cell, (target, target), (COSTS["R"] + extra, "R"))
    return closed(cell)


def parse(cells: Sequence[Cell]) -> Cell:
    """The cell of neighbouring spans, by all splits, shorter spans first."""
    table = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            j = i + length
            table[i, j] = combined([(table[i, k], table[k, j]) for k in range(i + 1, j)])
    return table[0, len(cells)]


@lru_cache(maxsize=50_000)
def span_cell(kinds: str) -> Cell:
    """The cell of at most ``FAN`` rows, whose shorter spans are shared."""
    if len(kinds) == 1:
        return row_cell(kinds)
    return combined([(span_cell(kinds[:k]), span_cell(kinds[k:])) for k in range(1, len(kinds))])


def rows_cell(kinds: str) -> Cell:
    """The cell of any number of rows (one at least)."""
    cells = [span_cell(kinds[i : i + FAN]) for i in range(0, len(kinds), FAN)]
    while len(cells) > 1:
        cells = [parse(cells[i : i + FAN]) for i in range(0, len(cells), FAN)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a legal conversation."""
    return min(cell[symbol] for symbol in ACCEPTED if symbol in cell)


_INK = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\v\f\r"


def row_kind(role: str, text: str, seen: bool) -> tuple[str, str]:
    """A row's first fault (or nothing) and its kind."""
    if not _INK.search(text):
        return "blank", GONE
    if seen:
        return "duplicate", GONE
    letter = role[:1] if role[:1] in NAMES else OTHER
    if text.rstrip(_BLANKS)[-1] in ".!?":
        return "", letter
    return "truncated", letter.upper()


FAULTS = ("blank", "duplicate", "truncated")


@dataclass
class Part:
    """What is known of neighbouring rows of a conversation."""

    kinds: list[str] = field(default_factory=list)
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(FAULTS, 0))
    illegal: int = 0
    first: str | None = None  # letters of the first and last row
    last: str | None = None
    low: int | None = None  # turns
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """The next row."""
        fault, kind = row_kind(role, text, seen)
        self.kinds.append(kind)
        if fault:
            self.faults[fault] += 1
        letter = role[:1]
        if self.last is None:
            self.first = letter
        else:
            self.illegal += self.last + letter not in LEGAL
        self.last = letter
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1


def edits(audit: str) -> Iterator[tuple[str, str]]:
    """Each edit and the role it leaves (none for a deletion)."""
    left = len(audit) - audit.count("D")
    place = -(left % 2)  # of an odd number the first is a system message
    for edit in audit:
        if edit == "D":
            yield edit, ""
        else:
            yield edit, "s" if place < 0 else "ua"[place % 2]
            place += 1


def repaired(audit: str, rows: Sequence[tuple[str, str]]) -> list[tuple[int, str, str, str]]:
    """Messages ``row, edit, role, text``; an insertion has the row it stands before."""
    out, at = [], 0
    for edit, letter in edits(audit):
        if edit == "I":
            out.append((at, edit, NAMES[letter], ""))
            continue
        role, text = rows[at]
        if edit == "K":
            out.append((at, edit, role, text))
        elif edit == "R":
            out.append((at, edit, NAMES[letter], text))
        at += 1
    return out


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SUMMARY = f"conv_id long, {_COUNTS}, digest string"
MESSAGES = "conv_id long, part int, number long, step int, edit string, role string, text string"
_BORDER = "turn long, own_role string, own_text string, text_key string"
_SUM_FIELDS = [
    ("conv_id", pa.int64()),
    ("gaps", pa.int64()),
    ("blank", pa.int64()),
    ("duplicate", pa.int64()),
    ("truncated", pa.int64()),
    ("illegal", pa.int64()),
    ("cost", pa.int64()),
    ("audit", pa.string()),
    ("digest", pa.string()),
]
_MESSAGE_FIELDS = [
    ("conv_id", pa.int64()),
    ("part", pa.int32()),
    ("number", pa.int64()),
    ("step", pa.int32()),
    ("edit", pa.string()),
    ("role", pa.string()),
    ("text", pa.string()),
]
_BORDER_FIELDS = [
    ("turn", pa.int64()),
    ("own_role", pa.string()),
    ("own_text", pa.string()),
    ("text_key", pa.string()),
]
#: The first pass: messages, rows of border conversations and summaries in one table.
_FIRST = f"kind string, {MESSAGES}, {_BORDER}, {_COUNTS}, digest string"
_FIRST_FIELDS = [("kind", pa.string()), *_MESSAGE_FIELDS, *_BORDER_FIELDS, *_SUM_FIELDS[1:]]


def _batch(rows: list[dict], fields: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([r.get(name) for r in rows], kind) for name, kind in fields]
    return pa.record_batch(arrays, names=[name for name, _ in fields])


def _column(group: pa.Table, name: str) -> list:
    return group.column(name).to_pylist()


def _counts(part: Part, cost: int, audit: str) -> dict:
    gaps = 0 if part.low is None else part.high - part.low + 1 - part.turns
    return {"gaps": gaps, **part.faults, "illegal": part.illegal, "cost": cost, "audit": audit}


def _whole(group: pa.Table, number: int, first: int) -> list[dict]:
    """Messages and summary of a conversation that one range holds."""
    rows = list(zip(_column(group, "role"), _column(group, "text"), strict=True))
    part, seen = Part(), set()
    for turn, row in zip(_column(group, "turn"), rows, strict=True):
        part.add(turn, *row, row in seen)
        seen.add(row)
    cost, audit = cheapest(rows_cell("".join(part.kinds)))
    conv = group.column("conv_id")[0].as_py()
    out, lines = [], []
    for step, (at, edit, role, text) in enumerate(repaired(audit, rows)):
        key = {"conv_id": conv, "part": number, "number": first + at, "step": step}
        out.append({"kind": "message", **key, "edit": edit, "role": role, "text": text})
        lines.append(f"{role}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    out.append({"kind": "summary", "conv_id": conv, "digest": digest, **_counts(part, cost, audit)})
    return out


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair what lies inside the range; pass on its first and last conversation."""
    number, first, held, inner, rows = partition_number(), 0, None, False, []
    size = 0

    def border(group: pa.Table) -> list[dict]:
        names = ("conv_id", "turn", "role", "text", "text_key")
        columns = zip(*(_column(group, n) for n in names), strict=True)
        return [
            {
                "kind": "border", "conv_id": conv, "part": number, "number": first + n, "turn": turn,
                "own_role": role, "own_text": text, "text_key": key,
            }
            for n, (conv, turn, role, text, key) in enumerate(columns)
        ]

    for group in runs_of(batches, ["conv_id"]):
        if held is not None:
            rows += _whole(held, number, first) if inner else border(held)
            size += held.nbytes
            inner, first = True, first + held.num_rows
            if size > 4 << 20:
                yield _batch(rows, _FIRST_FIELDS)
                rows, size = [], 0
        held = group
    if held is not None:
        rows += border(held)
    yield _batch(rows, _FIRST_FIELDS)


_CELL = "array<struct<head:string,tail:string,cost:long,audit:string>>"
_PART = (
    f"conv_id long, part int, cell {_CELL}, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, low long, high long, turns long, "
    "parts array<int>, sizes array<long>"
)
_PART_FIELDS = [
    ("conv_id", pa.int64()),
    ("part", pa.int32()),
    (
        "cell",
        pa.list_(
            pa.struct(
                [
                    ("head", pa.string()),
                    ("tail", pa.string()),
                    ("cost", pa.int64()),
                    ("audit", pa.string()),
                ]
            )
        ),
    ),
    *((name, pa.int64()) for name in (*FAULTS, "illegal")),
    ("first", pa.string()),
    ("last", pa.string()),
    ("low", pa.int64()),
    ("high", pa.int64()),
    ("turns", pa.int64()),
    ("parts", pa.list_(pa.int32())),
    ("sizes", pa.list_(pa.int64())),
]


def _listed(cell: Cell) -> list[dict]:
    return [
        {"head": h, "tail": t, "cost": cost, "audit": audit} for (h, t), (cost, audit) in cell.items()
    ]


def _unlisted(cell: list[dict]) -> Cell:
    return {(c["head"], c["tail"]): (c["cost"], c["audit"]) for c in cell}


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and cell of each part of a border conversation."""
    for group in runs_of(batches, ["conv_id", "part"]):
        part = Part()
        names = ("turn", "own_role", "own_text", "seen")
        for row in zip(*(_column(group, n) for n in names), strict=True):
            part.add(*row)
        number = group.column("part")[0].as_py()
        row = {
            "conv_id": group.column("conv_id")[0].as_py(),
            "part": number,
            "cell": _listed(rows_cell("".join(part.kinds))),
            **part.faults,
            "parts": [number],
            "sizes": [group.num_rows],
        }
        row |= {n: getattr(part, n) for n in ("illegal", "first", "last", "low", "high", "turns")}
        yield _batch([row], _PART_FIELDS)


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the neighbouring parts of a conversation, ``FAN`` at most."""
    for group in runs_of(batches, ["conv_id", "part"]):
        rows = group.to_pylist()
        out = {**rows[0], "cell": _listed(parse([_unlisted(r["cell"]) for r in rows]))}
        for row in rows[1:]:
            for name in FAULTS:
                out[name] += row[name]
            out["illegal"] += row["illegal"] + (out["last"] + row["first"] not in LEGAL)
            out["last"] = row["last"]
            if row["low"] is not None:
                out["turns"] += row["turns"] - (out["high"] == row["low"])
                out["low"] = row["low"] if out["low"] is None else out["low"]
                out["high"] = row["high"]
            out["parts"] += row["parts"]
            out["sizes"] += row["sizes"]
        yield _batch([out], _PART_FIELDS)


_SLICE = "conv_id long, part int, edits string, letters string"
_ENDS = f"{_SLICE}, {_COUNTS}"
_ENDS_FIELDS = [
    ("conv_id", pa.int64()),
    ("part", pa.int32()),
    ("edits", pa.string()),
    ("letters", pa.string()),
    *_SUM_FIELDS[1:-1],
]


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of a border conversation, and the edits of each of its parts."""
    for batch in batches:
        for row in batch.to_pylist():
            cost, audit = cheapest(_unlisted(row["cell"]))
            part = Part(faults={n: row[n] for n in FAULTS}, illegal=row["illegal"])
            part.low, part.high, part.turns = row["low"], row["high"], row["turns"]
            letters = "".join(letter or "-" for _, letter in edits(audit))
            out = [{"conv_id": row["conv_id"], **_counts(part, cost, audit)}]
            at = 0
            for n, (number, size) in enumerate(zip(row["parts"], row["sizes"], strict=True)):
                start = at
                while size:
                    size -= audit[at] != "I"
                    at += 1
                if n + 1 == len(row["parts"]):
                    at = len(audit)
                own = {"edits": audit[start:at], "letters": letters[start:at]}
                out.append({"conv_id": row["conv_id"], "part": number, **own})
            yield _batch(out, _ENDS_FIELDS)


def _message_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of each part of a border conversation."""
    for group in runs_of(batches, ["conv_id", "part"]):
        names = ("number", "own_role", "own_text")
        rows = list(zip(*(_column(group, n) for n in names), strict=True))
        key = {n: group.column(n)[0].as_py() for n in ("conv_id", "part")}
        own, letters = (group.column(n)[0].as_py() for n in ("edits", "letters"))
        out, at = [], 0
        for step, (edit, letter) in enumerate(zip(own, letters, strict=True)):
            number, role, text = rows[min(at, len(rows) - 1)]
            at += edit != "I"
            if edit == "D":
                continue
            role = role if edit == "K" else NAMES[letter]
            text = "" if edit == "I" else text
            out.append({**key, "number": number, "step": step, "edit": edit, "role": role, "text": text})
        yield _batch(out, _MESSAGE_FIELDS)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose lines come in order."""
    held, hashed, out = None, None, []
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
        for conv, role, text in zip(*columns, strict=True):
            if hashed is None or conv != held:
                if hashed is not None:
                    out.append({"conv_id": held, "digest": hashed.hexdigest()})
                held, hashed = conv, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode())
    if hashed is not None:
        out.append({"conv_id": held, "digest": hashed.hexdigest()})
    yield _batch(out, [("conv_id", pa.int64()), ("digest", pa.string())])


def _joined(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """An equi join on named columns, in which a null conversation id equals another."""
    keyed = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    match = F.lit(True)
    for name in names:
        match = match & F.col(name).eqNullSafe(F.col(f"right_{name}"))
    return left.join(keyed, match, how).drop(*(f"right_{n}" for n in names))


def repair_structure(turns: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired messages of ``conv_id, turn, role, text``.

    Summaries have ``conv_id``, counts, cost, audit and the digest of the repaired
    ``role:text`` lines; messages ``conv_id, part, number, step, edit, role, text``,
    in order by part, number and step.  ``ranges`` is the number of ranges, by
    default Spark's.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumns(
        {
            "text_key": F.sha2("text", 256),
            # Tells equal rows apart, so that even they can lie in several ranges.
            "place": F.monotonically_increasing_id(),
        }
    )
    order = ["conv_id", "turn", "role", "text_key", "place"]
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order)
    first = stored(
        ranged.sortWithinPartitions(*order).drop("place").mapInArrow(_first_pass, _FIRST), "structure"
    )
    border = first.where("kind = 'border'").select(
        "conv_id", "part", "number", "turn", "own_role", "own_text", "text_key"
    )
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    sums = [f.split()[0] for f in SUMMARY.split(", ")]
    messages = first.where("kind = 'message'").select(*names)
    summaries = first.where("kind = 'summary'").select(*sums)

    # The first of equal rows of a conversation, wherever they lie.
    texts_seen = border.groupBy("conv_id", "text_key", "own_role").agg(
        F.min(F.struct("part", "number")).alias("earliest")
    )
    seen = (
        _joined(border, texts_seen, "conv_id", "text_key", "own_role")
        .withColumn("seen", F.struct("part", "number") > F.col("earliest"))
        .select("conv_id", "part", "number", "turn", "own_role", "own_text", "seen")
        .repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "number")
    )
    parts = stored(seen.mapInArrow(_part_rows, _PART), "structure")
    least = parts.agg(F.max("part")).first()[0] or 0
    done = 1
    while done <= least:
        done *= FAN
        group = F.floor(F.col("part") / FAN).cast("int")
        grouped = parts.withColumn("lead", F.col("part")).withColumn("part", group)
        grouped = grouped.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "lead")
        parts = stored(grouped.drop("lead").mapInArrow(_merged_rows, _PART), "structure")
    ends = stored(parts.mapInArrow(_end_rows, _ENDS), "structure")
    slices = ends.where("part IS NOT NULL").select("conv_id", "part", "edits", "letters")
    edited = _joined(border.drop("turn", "text_key"), slices, "conv_id", "part")
    edited = edited.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "number")
    late = stored(edited.mapInArrow(_message_rows, MESSAGES), "structure")
    lines = late.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", "step")
    digests = lines.mapInArrow(_digest_rows, "conv_id long, digest string")
    counted = ends.where("part IS NULL").drop(*(f.split()[0] for f in _SLICE.split(", ")[1:]))
    empty = F.sha2(F.lit(""), 256)
    found = _joined(counted, digests, "conv_id", how="left").withColumn(
        "digest", F.coalesce("digest", empty)
    )
    return summaries.unionByName(found), messages.unionByName(late)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted damage, by a checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it,
    4 makes it a user's.  Nulls are one space.
    """
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    key = F.concat(plain["conv_id"], F.lit(":"), plain["turn"])
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(plain["role"]).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.regexp_replace(plain["text"], "[.!?]", ""))
        .otherwise(plain["text"])
        .alias("text"),
        kind.alias("damage"),
    ).where("damage <> 0")
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")
