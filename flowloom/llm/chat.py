"""Repair of conversation roles at least cost, and rendering.

A legal conversation has at most one system message, at its start, then user and
assistant messages in turn, and ends with an assistant.  A turn may keep its role
or be given another one, may be merged into the message before it, or may have an
empty message inserted before it; ``COSTS`` prices each.  Dynamic programming over
the automaton's states (start, after system, after user, after assistant) picks
the cheapest legal sequence; of equally cheap ones the state and role that stand
first in these lists win.

Rows are dealt out in ranges of conversation and turn.  A conversation inside
one range is repaired there.  One that reaches over a range border is repaired in
parts: a step of the program is a (min, +) matrix product, so parts are reduced to
4 x 4 matrices, whose prefixes give each part its entry costs; maps from exit to
entry state, joined from the back, give each part its exit state.  The result is
that of a single run, and no conversation has to fit into a task.

Turns are ordered by number (nulls last), then role, then a hash of the text;
equal rows stay, as equal turns.  A null or unknown role costs little to change,
null text is empty, a null conversation id is a conversation of its own.  An
empty table gives no rows.

Rows: ``conv_id, ordinal, step, role, action, rendered``.  ``ordinal`` counts the
source turns; ``step`` is 0 for a message inserted before the turn, 1 for the
turn, 2 for the end of the conversation.  A conversation's ``rendered`` strings in
order of ``(ordinal, step)`` are the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import partition_number, runs_of, stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Prices: joining the message before, an empty message, and a changed role by
#: source and target.  Sources that are no role are listed as None.
COSTS = {
    "merge": 2,
    "insert": 3,
    ("system", "user"): 3,
    ("system", "assistant"): 5,
    ("user", "system"): 8,
    ("user", "assistant"): 4,
    ("assistant", "system"): 8,
    ("assistant", "user"): 4,
    (None, "system"): 6,
    (None, "user"): 2,
    (None, "assistant"): 2,
}
#: Cost of ending in each state and the empty messages that make it legal.
ENDINGS = (
    (0, ()),
    (2 * COSTS["insert"], ("user", "assistant")),
    (COSTS["insert"], ("assistant",)),
    (0, ()),
)
_ROWS = "conv_id long, ordinal long, step int, role string, action string, rendered string"
_BORDER = ", range int, number long, own_role string, text string"


@cache
def moves(role: str | None) -> tuple:
    """For each state pair the cheapest (cost, target role, action), or None."""
    grid: list[list] = [[None] * 4 for _ in range(4)]

    def offer(state, after, cost, target, action):
        if grid[state][after] is None or cost < grid[state][after][0]:
            grid[state][after] = (cost, target, action)

    for target in ROLES:
        change = 0 if target == role else COSTS[role if role in ROLES else None, target]
        for state in range(4):
            if target == "system" and state == START:
                offer(state, SYSTEM, change, target, "open")
            elif target == "system" and state == SYSTEM:
                offer(state, SYSTEM, change + COSTS["merge"], target, "merge")
            elif target == "user":
                if state == USER:
                    offer(state, USER, change + COSTS["merge"], target, "merge")
                    offer(state, USER, change + COSTS["insert"], target, "insert")
                else:
                    offer(state, USER, change, target, "open")
            elif target == "assistant":
                if state == USER:
                    offer(state, ASSISTANT, change, target, "open")
                else:
                    if state == ASSISTANT:
                        offer(state, ASSISTANT, change + COSTS["merge"], target, "merge")
                    offer(state, ASSISTANT, change + COSTS["insert"], target, "insert")
    return tuple(tuple(row) for row in grid)


@cache
def step_costs(role: str | None) -> np.ndarray:
    """The 4 x 4 costs of one turn."""
    return np.array([[np.inf if m is None else m[0] for m in row] for row in moves(role)])


def forward(roles: list, entry: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs after the last turn, and for each turn the best state before it."""
    costs, before = entry, []
    for role in roles:
        ways = costs[:, None] + step_costs(role)
        before.append(ways.argmin(0))
        costs = ways.min(0)
    return costs, before


def transfer(roles: list) -> np.ndarray:
    """(min, +) product of the turns' cost matrices."""
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        out = (out[:, :, None] + step_costs(role)[None]).min(1)
    return out


def entry_map(before: list[np.ndarray]) -> np.ndarray:
    """For each state after the last turn, the state before the first one."""
    states = np.arange(4)
    for back in reversed(before):
        states = back[states]
    return states


def begin() -> np.ndarray:
    """Entry costs of a conversation."""
    return np.array([0.0, np.inf, np.inf, np.inf])


def last_state(costs: np.ndarray) -> int:
    """The cheapest legal end."""
    return int(np.argmin(costs + np.array([e[0] for e in ENDINGS])))


def _open(role: str, first: bool) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{role}\n"


def render(roles, texts, before, exit_state, entry_state, ordinal, ends) -> list[tuple]:
    """Rows ``ordinal, step, role, action, rendered`` of consecutive turns."""
    states = [exit_state]
    for back in reversed(before):
        states.append(int(back[states[-1]]))
    states.reverse()
    rows = []
    for n, (role, text) in enumerate(zip(roles, texts, strict=True)):
        _, target, action = moves(role)[states[n]][states[n + 1]]
        fresh = states[n] == START
        if action == "insert":
            missing = "assistant" if target == "user" else "user"
            rows.append((ordinal + n, 0, missing, "insert", _open(missing, fresh)))
            fresh = False
        # Marks inside a text must not look like message borders.
        plain = (text or "").replace("<|", "< |")
        head = "\n\n" if action == "merge" else _open(target, fresh)
        done = "keep" if target == role else "relabel"
        rows.append((ordinal + n, 1, target, "merge" if action == "merge" else done, head + plain))
    if ends:
        added = ENDINGS[exit_state][1]
        tail = "".join(_open(r, False) for r in added) + "<|im_end|>\n"
        last = added[-1] if added else None
        rows.append((ordinal + len(roles), 2, last, "insert" if added else "end", tail))
    return rows


def _known(role: str | None) -> str | None:
    plain = role.strip().lower() if role else None
    return plain if plain in ROLES else None


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair what lies inside the range; pass on its first and last conversation."""
    number = partition_number()
    held: pa.Table | None = None
    first = True
    for group in runs_of(batches, ["conv_id"]):
        if held is not None:
            yield _border_rows(held, number) if first else _whole_rows(held)
            first = False
        held = group
    if held is not None:
        yield _border_rows(held, number)


_FIRST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("ordinal", pa.int64()),
        ("step", pa.int32()),
        ("role", pa.string()),
        ("action", pa.string()),
        ("rendered", pa.string()),
        ("range", pa.int32()),
        ("number", pa.int64()),
        ("own_role", pa.string()),
        ("text", pa.string()),
    ]
)


def _batch(conv: int | None, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[conv] * len(rows), *([r[n] for r in rows] for n in range(5))]
    columns += [[None] * len(rows)] * (len(schema) - 6)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.record_batch(arrays, schema=schema)


def _whole_rows(group: pa.Table) -> pa.RecordBatch:
    roles = [_known(r) for r in group.column("role").to_pylist()]
    costs, before = forward(roles, begin())
    rows = render(
        roles, group.column("text").to_pylist(), before, last_state(costs), START, 0, True
    )
    return _batch(group.column("conv_id")[0].as_py(), rows, _FIRST)


def _border_rows(group: pa.Table, number: int) -> pa.RecordBatch:
    size = group.num_rows
    empty = [None] * size
    columns = [group.column("conv_id").to_pylist(), *[empty] * 5, [number] * size, list(range(size))]
    columns += [group.column("role").to_pylist(), group.column("text").to_pylist()]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIRST, strict=True)]
    return pa.record_batch(arrays, schema=_FIRST)


_PART = "conv_id long, range int, turns long, grid array<double>"
_ENTRY = "conv_id long, range int, first long, last boolean, entry array<double>"
_BACK = "conv_id long, range int, first long, last boolean, entry array<double>, back array<long>, costs array<double>"
_EXIT = "conv_id long, range int, first long, last boolean, entry array<double>, exit int"


def _table(rows: list[tuple], kinds: str, spark_types: dict) -> pa.RecordBatch:
    names = [f.split()[0] for f in kinds.split(", ")]
    types = [spark_types[f.split(" ", 1)[1]] for f in kinds.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch(
        [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names
    )


_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
    "array<long>": pa.list_(pa.int64()),
}


def _parts(batches):
    for group in runs_of(batches, ["conv_id", "range"]):
        grid = transfer([_known(r) for r in group.column("own_role").to_pylist()])
        key = (group.column("conv_id")[0].as_py(), group.column("range")[0].as_py())
        yield _table([(*key, group.num_rows, grid.ravel().tolist())], _PART, _TYPES)


def _entries(batches):
    """Entry costs of each part; a conversation has one row per range."""
    for group in runs_of(batches, ["conv_id"]):
        costs, first, rows = begin(), 0, []
        parts = zip(*(group.column(c).to_pylist() for c in ("conv_id", "range", "turns", "grid")), strict=True)
        for n, (conv, number, turns, grid) in enumerate(parts):
            rows.append((conv, number, first, n == group.num_rows - 1, costs.tolist()))
            costs = (costs[:, None] + np.reshape(grid, (4, 4))).min(0)
            first += turns
        yield _table(rows, _ENTRY, _TYPES)


def _backs(batches):
    for group in runs_of(batches, ["conv_id", "range"]):
        roles = [_known(r) for r in group.column("own_role").to_pylist()]
        entry = group.column("entry")[0].as_py()
        costs, before = forward(roles, np.array(entry))
        keys = [group.column(c)[0].as_py() for c in ("conv_id", "range", "first", "last")]
        yield _table([(*keys, entry, entry_map(before).tolist(), costs.tolist())], _BACK, _TYPES)


def _exits(batches):
    """Exit states, from the last part of a conversation to its first."""
    for group in runs_of(batches, ["conv_id"]):
        rows, state = [], None
        for row in reversed(group.to_pylist()):
            state = last_state(np.array(row["costs"])) if state is None else state
            rows.append((row["conv_id"], row["range"], row["first"], row["last"], row["entry"], state))
            state = row["back"][state]
        yield _table(rows[::-1], _EXIT, _TYPES)


_LAST = pa.schema(list(_FIRST)[:6])


def _second_pass(batches):
    for group in runs_of(batches, ["conv_id", "range"]):
        roles = [_known(r) for r in group.column("own_role").to_pylist()]
        value = {c: group.column(c)[0].as_py() for c in ("conv_id", "entry", "exit", "first", "last")}
        _, before = forward(roles, np.array(value["entry"]))
        texts = group.column("text").to_pylist()
        rows = render(
            roles, texts, before, value["exit"], None, value["first"], value["last"]
        )
        yield _batch(value["conv_id"], rows, _LAST)


def repair(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """Repaired and rendered conversations; see the module text.

    ``turns`` has ``conv_id, turn, role, text``; ``ranges`` is the number of
    ranges, by default Spark's.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
        F.xxhash64("text").alias("spread"),
        # Tells equal rows apart, so that even they can lie in several ranges.
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "spread", "place"]
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *order)
    done = stored(
        ranged.sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
        .mapInArrow(_first_pass, _ROWS + _BORDER),
        "chat",
    )
    border = done.where(F.col("range").isNotNull()).select(
        "conv_id", "range", "number", "own_role", "text"
    )

    def in_parts(part: DataFrame) -> DataFrame:
        return part.repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "number")

    def in_line(part: DataFrame) -> DataFrame:
        return part.repartition("conv_id").sortWithinPartitions("conv_id", "range")

    def joined(states: DataFrame) -> DataFrame:
        key = border["conv_id"].eqNullSafe(states["conv_id"]) & (border["range"] == states["range"])
        return in_parts(border.join(states, key).drop(states["conv_id"]).drop(states["range"]))

    grids = in_parts(border).select("conv_id", "range", "own_role").mapInArrow(_parts, _PART)
    entries = stored(in_line(grids).mapInArrow(_entries, _ENTRY), "chat")
    backs = joined(entries).drop("text").mapInArrow(_backs, _BACK)
    exits = stored(in_line(backs).mapInArrow(_exits, _EXIT), "chat")
    last = joined(exits).mapInArrow(_second_pass, _ROWS)
    whole = done.where(F.col("range").isNull()).select("conv_id", "ordinal", "step", "role", "action", "rendered")
    return whole.unionByName(last)
