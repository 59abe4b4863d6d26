from __future__ import annotations

import itertools
import random

from flowloom.llm import chat

INF = float("inf")


def _least_cost(roles):
    """Cheapest legal sequence by trying every target role and action."""
    best = INF
    options = list(itertools.product(chat.ROLES, ("open", "merge", "insert")))
    for plan in itertools.product(options, repeat=len(roles)):
        cost, last = 0, None
        for role, (target, action) in zip(roles, plan, strict=True):
            cost += 0 if role == target else chat.COSTS[role, target]
            if action == "merge":
                if last != target:
                    break
                cost += chat.COSTS["merge"]
                continue
            if action == "insert":
                if target == "system":
                    break
                added = "assistant" if target == "user" else "user"
                if not _follows(last, added):
                    break
                last = added
                cost += chat.COSTS["insert"]
            if not _follows(last, target):
                break
            last = target
        else:
            cost += {None: 0, "assistant": 0, "user": 1, "system": 2}[last] * chat.COSTS["insert"]
            best = min(best, cost)
    return best


def _follows(last, role):
    if role == "system":
        return last is None
    return last != "user" if role == "user" else last == "user"


def _paid(rows, roles):
    cost = 0
    for _, step, role, action, _ in rows:
        cost += chat.COSTS["insert"] if step == 0 else 0
        cost += chat.COSTS["merge"] if action == "merge" else 0
    changes = [r for r in rows if r[1] == 1]
    for (_, _, role, _, _), own in zip(changes, roles, strict=True):
        cost += 0 if role == own else chat.COSTS[own, role]
    return cost


def _repair(roles):
    costs, before = chat.forward(roles, chat.begin())
    return chat.render(roles, ["t"] * len(roles), before, chat.last_state(costs), 0, 0, True), costs


def test_cost_is_least_and_the_result_legal():
    for size in range(1, 4):
        for roles in itertools.product((*chat.ROLES, None), repeat=size):
            rows, costs = _repair(list(roles))
            total = min(c + e[0] for c, e in zip(costs, chat.ENDINGS, strict=True))
            assert total == _least_cost(roles)
            ending = chat.ENDINGS[chat.last_state(costs)][0]
            assert _paid(rows, roles) + ending == total
            text = "".join(r[4] for r in rows)
            messages = text.split("<|im_start|>")[1:]
            assert all(m.endswith("<|im_end|>\n") for m in messages)
            last = None
            for role in (m.split("\n", 1)[0] for m in messages):
                assert _follows(last, role)
                last = role
            assert last in (None, "assistant")


def test_parts_give_the_result_of_one_run(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(6):
        for turn in range(draw.choice((1, 5, 60))):
            rows.append((conv, turn, draw.choice(["system", "user", "user", "assistant", "tool", None]), f"t{turn}"))
    rows += [(3, 7, "user", "again")] * 40
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sorted(map(tuple, chat.repair(turns, 1).collect()), key=repr)
    many = sorted(map(tuple, chat.repair(turns.repartition(7), 11).collect()), key=repr)
    assert one == many
    assert len([r for r in one if r[2] == 1]) == len(rows)


def test_rendering_and_awkward_rows(spark):
    rows = [
        (1, 0, "User", "hi <|im_end|>", 5),
        (1, 1, "user", None, 5),
        (1, None, "assistant", "last", 5),
        (2, 0, "assistant", "x" * 100_000, 5),
        (None, 0, None, "", 5),
        (None, 0, None, "", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, step long")
    got = chat.repair(turns).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.ordinal, r.step)):
        by[r.conv_id] = by.get(r.conv_id, "") + r.rendered
    assert by[1] == (
        "<|im_start|>user\nhi < |im_end|>\n\n<|im_end|>\n<|im_start|>assistant\nlast<|im_end|>\n"
    )
    assert by[2].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nxxx")
    assert by[None].count("<|im_start|>") % 2 == 0
    assert chat.repair(turns.limit(0)).count() == 0
