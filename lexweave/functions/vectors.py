"""Array arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let  # noqa: F401


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(a: Column) -> Column:
    """Shifted by the largest, so that nothing overflows."""
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total(e), lambda sum_: F.transform(e, lambda x: x / sum_)))


def clipped(a: Column, most: float) -> Column:
    """``a`` scaled down to norm ``most`` if it is longer."""
    return let(F.least(F.lit(1.0), F.lit(most) / (norm(a) + 1e-12)), lambda by: scaled(a, by))


def adam(w, g, m, v, t: Column, rate: float, first: float = 0.9, second: float = 0.999) -> Column:
    """Weights after step ``t`` with bias-corrected moments."""
    m = F.zip_with(m, g, lambda a, b: first * a + (1 - first) * b)
    v = F.zip_with(v, g, lambda a, b: second * a + (1 - second) * b * b)
    move = F.zip_with(m, v, lambda a, b: rate * (a / (1 - F.pow(F.lit(first), t))) / (F.sqrt(b / (1 - F.pow(F.lit(second), t))) + 1e-8))
    return F.zip_with(w, move, lambda a, b: a - b)


def row(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def matrix(rows) -> Column:
    """A literal matrix as the array of its columns."""
    return F.array(*[row(c) for c in zip(*rows)])


def times(a: Column, columns: Column) -> Column:
    """Row vector times matrix."""
    return F.transform(columns, lambda c: dot(a, c))


def cell(x: Column, h: Column, w: Column, u: Column, bias: Column) -> Column:
    """A recurrent step: tanh(x W + h U + b)."""
    return F.transform(added(added(times(x, w), times(h, u)), bias), F.tanh)


def attention(states: Column, now: Column, w: Column, u: Column, v: Column) -> Column:
    """Weighted sum of the states, weights by softmax of v tanh(W h + U now)."""
    def pooled(about: Column) -> Column:
        weights = softmax(F.transform(states, lambda h: dot(F.transform(added(times(h, w), about), F.tanh), v)))
        return let(weights, lambda p: F.transform(F.sequence(F.lit(1), F.size(now)), lambda j: total(F.zip_with(p, states, lambda a, h: a * F.element_at(h, j)))))

    return let(times(now, u), pooled)
