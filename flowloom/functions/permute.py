"""Keyed permutations of positions, as column expressions.

A position below ``size`` is a pair of digits to the bases ``a``, the rounded-up root
of ``size``, and ``b``, the least one with ``a * b >= size``.  Four rounds add a keyed hash of one digit to
the other, which can be undone, so they permute the pairs.  A result that is no
position is permuted again until it is one; fewer than ``a`` pairs are none, so the
walk ends.  That gives the k-th draw without replacement of any key on its own: nothing
is sorted, stored or drawn one after another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.plan import bind

ROUNDS = 4
#: Steps of a walk in the expression.  Up to 4096 positions no walk is longer; above,
#: a step misses with a chance of 1 / 64 at most, and a longer walk is an error.
MOST_STEPS = 64


def _mixed(key: Column, round_: int, digit: Column) -> Column:
    """A 32-bit hash of a key, a round and a digit."""
    text = F.concat_ws(":", key, F.lit(str(round_)), digit.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def permuted(position: Column, size: Column, key: Column) -> Column:
    """Where a position (from 0) below ``size`` goes under the key's permutation."""
    high = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    low = F.ceil(size / high).cast("bigint")

    def once(place: Column) -> Column:
        state = F.struct(F.floor(place / low).alias("h"), F.pmod(place, low).alias("l"))

        def turned(pair: Column, round_: int) -> Column:
            if round_ % 2:
                added = F.pmod(pair["l"] + _mixed(key, round_, pair["h"]), low)
                return F.struct(pair["h"].alias("h"), added.alias("l"))
            added = F.pmod(pair["h"] + _mixed(key, round_, pair["l"]), high)
            return F.struct(added.alias("h"), pair["l"].alias("l"))

        def from_round(pair: Column, round_: int) -> Column:
            if round_ == ROUNDS:
                return pair["h"] * low + pair["l"]
            return bind(turned(pair, round_), lambda p: from_round(p, round_ + 1))

        return bind(state, lambda pair: from_round(pair, 0))

    first = once(position.cast("bigint"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.least(high, F.lit(MOST_STEPS)).cast("int")),
        first,
        lambda place, _: F.when(place < size, place).otherwise(once(place)),
    )
    return bind(
        walked,
        lambda place: F.when(place < size, place).otherwise(
            F.raise_error(F.lit("a walk of a permutation did not end")).cast("bigint")
        ),
    )


def permuted_sql(position: str, size: str, key: str) -> str:
    """SQL twin of :func:`permuted`."""
    high = f"CAST(ceil(sqrt({size})) AS BIGINT)"
    low = f"CAST(ceil({size} / {high}) AS BIGINT)"

    def mixed(round_: int, digit: str) -> str:
        return f"('0x' || substr(sha256({key} || ':{round_}:' || ({digit})), 1, 8))::BIGINT"

    def once(place: str) -> str:
        turns = (
            f"CASE WHEN r % 2 = 1 THEN [p[1], (p[2] + CASE r WHEN 1 THEN {mixed(1, 'p[1]')} "
            f"ELSE {mixed(3, 'p[1]')} END) % {low}] ELSE [(p[1] + CASE r WHEN 0 THEN "
            f"{mixed(0, 'p[2]')} ELSE {mixed(2, 'p[2]')} END) % {high}, p[2]] END"
        )
        pair = (
            f"list_reduce([0::BIGINT, 1, 2, 3], lambda p, r: {turns}, "
            f"[({place}) // {low}, ({place}) % {low}])"
        )
        return f"(list_transform([{pair}], lambda q: q[1] * {low} + q[2]))[1]"

    return (
        f"list_reduce(range(0, least({high}, {MOST_STEPS}) + 1), lambda x, s: "
        f"CASE WHEN s > 0 AND x < {size} THEN x ELSE {once('x')} END, ({position})::BIGINT)"
    )
