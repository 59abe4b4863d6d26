"""Column expressions over fixed-length vectors and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.plan import bind


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by the largest for stability."""

    def share(powers: Column) -> Column:
        return F.aggregate(
            powers,
            F.lit(0.0),
            lambda total, power: total + power,
            lambda total: F.transform(powers, lambda power: power / total),
        )

    return bind(
        F.array_max(logits),
        lambda top: bind(F.transform(logits, lambda z: F.exp(z - top)), share),
    )


def log_sum_exp(logits: Column) -> Column:
    """Logarithm of the summed exponentials of an array."""
    return bind(
        F.array_max(logits),
        lambda top: F.aggregate(
            logits,
            F.lit(0.0),
            lambda total, z: total + F.exp(z - top),
            lambda total: top + F.log(total),
        ),
    )


def argmax(values: Column) -> Column:
    """Zero-based position of the largest element; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


# Coefficients of the published closed form of the standard normal
# distribution function (West 2005, after Hart): rational part below 7.07...,
# continued fraction above.
_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
_SWITCH = 7.07106781186547
_ROOT_TWO_PI = 2.506628274631


def _ladder(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        total = total * x + F.lit(coefficient)
    return total


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    x = F.abs(z)
    decay = F.exp(-x * x / 2.0)
    fraction = x + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    tail = (
        F.when(x > 37.0, F.lit(0.0))
        .when(x < _SWITCH, decay * _ladder(x, _NUMERATOR) / _ladder(x, _DENOMINATOR))
        .otherwise(decay / fraction / _ROOT_TWO_PI)
    )
    return F.when(z > 0.0, F.lit(1.0) - tail).otherwise(tail)
