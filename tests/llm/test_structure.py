from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import cases
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import queries, structure

LEGAL = re.compile("(s?(ua)+)?")
KINDS = "xsuaoSUAO"


def _all_repairs(kinds, most):
    """Every (cost, audit) of at most ``most`` insertions, tried one by one."""
    found = defaultdict(set)

    def go(at, roles, audit, cost, left):
        if at == len(kinds):
            found[roles].add((cost, audit))
        else:
            kind = kinds[at]
            go(at + 1, roles, audit + "D", cost + 2, left)
            if kind != "x":
                more = 5 if kind.isupper() else 0
                if kind.lower() in "sua":
                    go(at + 1, roles + kind.lower(), audit + "K", cost + more, left)
                for role in "ua":
                    go(at + 1, roles + role, audit + "R", cost + 1 + more, left)
        if left:
            for role in "ua":
                go(at, roles + role, audit + "I", cost + 5, left - 1)

    go(0, "", "", 0, most)
    return min(min(v) for k, v in found.items() if LEGAL.fullmatch(k))


@pytest.mark.parametrize("size", [1, 2, 3])
def test_cells_equal_exhaustive_search(size):
    for kinds in itertools.product(KINDS, repeat=size):
        got = structure.cheapest(structure.rows_cell("".join(kinds)))
        assert got == _all_repairs(kinds, 2), kinds


def _states(kinds):
    """A plain run over the automaton's states, with audits."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(costs):
        for _ in range(2):
            for state, (cost, audit) in list(costs.items()):
                for letter in step[state].replace("s", ""):
                    way = (cost + 5, audit + "I")
                    costs[letter] = min(costs.get(letter, way), way)
        return costs

    costs = insert({"": (0, "")})
    for kind in kinds:
        after = {}
        for state, (cost, audit) in costs.items():
            ways = [(state, 2, "D")]
            if kind != "x":
                more = 5 if kind.isupper() else 0
                ways += [(x, more, "K") for x in step[state] if x == kind.lower()]
                ways += [(x, more + 1, "R") for x in step[state] if x in "ua"]
            for target, price, edit in ways:
                way = (cost + price, audit + edit)
                after[target] = min(after.get(target, way), way)
        costs = insert(after)
    return min(costs[s] for s in ("", "a") if s in costs)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(KINDS), min_size=1, max_size=70))
def test_long_spans_equal_the_automaton(kinds):
    assert structure.cheapest(structure.rows_cell(kinds)) == _states(kinds)


def test_closure_needs_no_more_than_two_insertions_a_side():
    assert structure.cheapest(structure.rows_cell("SO")) == _states("SO")
    for cell in (structure.row_cell(k) for k in KINDS):
        assert structure.closed(dict(cell)) == cell


def _expected(turns):
    """Summary of one conversation's rows ``turn, role, text`` in order."""
    seen, kinds = set(), []
    counts = dict.fromkeys(structure.FAULTS, 0)
    for _, role, text in turns:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else ""
        fault = fault or ("truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        gone = fault in ("blank", "duplicate")
        kinds.append("x" if gone else kind.upper() if fault else kind)
    cost, audit = _states(kinds)
    letters = [r[:1] for _, r, _ in turns]
    pairs = zip(letters, letters[1:], strict=False)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    left = len(audit) - audit.count("D")
    roles = ["system"] * (left % 2) + ["user", "assistant"] * (left // 2)
    rows, lines = iter(turns), []
    for edit in audit:
        _, role, text = next(rows) if edit != "I" else (None, None, "")
        if edit != "D":
            target = roles.pop(0)
            lines.append(f"{role if edit == 'K' else target}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest)


def _ordered(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role or (" " if role is None else ""), " " if text is None else text))
    for turns in out.values():
        turns.sort(
            key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest())
        )
    return out


def _compare(spark, rows, ranges):
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows, schema)
    extra = ["part", "number", "kind", "audit", "seen", "text_key", "place", "edits", "cell"]
    from pyspark.sql import functions as F

    table = table.withColumns({n: F.lit(None).cast("string") for n in extra})
    found, messages = structure.repair_structure(table.repartition(5), ranges)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    want = {conv: _expected(turns) for conv, turns in _ordered(rows).items()}
    assert got == want
    lines = defaultdict(list)
    for m in sorted(messages.collect(), key=lambda m: (m.part, m.number, m.step)):
        lines[m.conv_id].append(f"{m.role}:{m.text}")
        assert m.edit in "KRI"
    for conv, expected in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == expected[-1]


AWKWARD = [
    (1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 5, "assistant", "x" * 50_000),
    (2, None, "user", "a."), (2, None, "assistant", "b."), (3, 0, "", ""), (3, 9, "tool", "say."),
    (4, 1, "system", "only."), (None, 1, "user", "q?"), (None, 2, "assistant", "a!\n "), (5, 2, "user", "é。"),
    (6, 0, "assistant", "first."), (6, 1, "assistant", "second."), (6, 3, "user", "last"),
]


@pytest.mark.parametrize("ranges", [1, 3, 11])
def test_awkward_rows(spark, ranges):
    _compare(spark, AWKWARD, ranges)


def test_a_conversation_over_many_ranges(spark):
    texts = ["Yes.", "No", "", "Perhaps so!", "cut off here"]
    hot = [
        (7, n // 2, ("user", "assistant", "system", "tool")[n * 7 % 4], texts[n * 3 % 5] + str(n // 9 * (n % 2)))
        for n in range(900)
    ]
    _compare(spark, hot + AWKWARD, 40)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, messages = structure.repair_structure(rows)
    assert found.collect() == [] and messages.collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(9) for t in range(9)]
    rows += [(None, None, None, None), (3, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, structure.damaged(table).collect()))) == sorted(map(repr, want))


def test_conversations_without_rows_after_damage(spark, tmp_path):
    rows = [(c, 0, "user", "a.") for c in range(60)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in queries.op13_structure(spark, str(tmp_path)).collect()}
    assert len(found) == 60
    left = {r.conv_id for r in structure.damaged(spark.createDataFrame(rows, schema)).collect()}
    gone = [r for c, r in found.items() if c not in left]
    assert gone and all(r.cost == 0 and r.audit == "" for r in gone)
    assert {r.repaired_sha256 for r in gone} == {hashlib.sha256(b"").hexdigest()}


def test_sample_table_over_many_ranges(spark):
    turns = structure.damaged(spark.read.parquet(f"{cases.SF}/conversations.parquet"))
    one, _ = structure.repair_structure(turns, 1)
    many, _ = structure.repair_structure(turns, 60)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
