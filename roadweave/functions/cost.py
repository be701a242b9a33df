"""Traversal costs and objectives of traffic assignment, for Columns and numpy alike.

t: travel time, c: capacity, x: flow, len: length. Every function gives value, first and
second derivative and antiderivative; ``ops`` supplies where/log for the kind of argument.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Davidson's delay parameter, and the share of capacity beyond which the modified form is linear; fixed values.
DAVIDSON_J, LINEAR_FROM = 0.01, 0.95


class ColumnOps:
    where = staticmethod(lambda test, a, b: F.when(test, a).otherwise(b))
    log = staticmethod(F.log)
    least = staticmethod(F.least)


class ArrayOps:
    where = staticmethod(np.where)
    log = staticmethod(np.log)
    least = staticmethod(np.minimum)


class Bpr:
    """t (1 + alpha (x/c)^beta) with alpha 1 and beta 2 unless given."""

    def __init__(self, ops: Any = ColumnOps, alpha: float = 1.0, beta: int = 2) -> None:
        self.alpha, self.beta = alpha, beta

    def value(self, t, c, x):
        return t * (1 + self.alpha * (x / c) ** self.beta)

    def first(self, t, c, x):
        return t * self.alpha * self.beta * (x / c) ** (self.beta - 1) / c

    def second(self, t, c, x):
        return t * self.alpha * self.beta * (self.beta - 1) * (x / c) ** (self.beta - 2) / (c * c)

    def anti(self, t, c, x):
        return t * (x + self.alpha * x * (x / c) ** self.beta / (self.beta + 1))


class Davidson:
    """t (1 + J x / (c - x)), for x < c."""

    def __init__(self, ops: Any = ColumnOps) -> None:
        self.ops = ops

    def value(self, t, c, x):
        return t * (1 + DAVIDSON_J * x / (c - x))

    def first(self, t, c, x):
        return DAVIDSON_J * t * c / ((c - x) * (c - x))

    def second(self, t, c, x):
        return 2 * DAVIDSON_J * t * c / ((c - x) * (c - x) * (c - x))

    def anti(self, t, c, x):
        return t * (x - DAVIDSON_J * (c * self.ops.log(c - x) + x))


class ModifiedDavidson(Davidson):
    """Davidson up to 0.95 c, then its tangent."""

    def _parts(self, c, x):
        q = LINEAR_FROM * c
        return q, x <= q, self.ops.least(x, q)

    def value(self, t, c, x):
        q, inside, held = self._parts(c, x)
        return self.ops.where(inside, super().value(t, c, held), super().value(t, c, q) + super().first(t, c, q) * (x - q))

    def first(self, t, c, x):
        return super().first(t, c, self._parts(c, x)[2])

    def second(self, t, c, x):
        _, inside, held = self._parts(c, x)
        return self.ops.where(inside, super().second(t, c, held), 0.0 * x)

    def anti(self, t, c, x):
        q, inside, held = self._parts(c, x)
        return super().anti(t, c, held) + self.ops.where(inside, 0.0 * x, (x - q) * (self.value(t, c, x) + super().value(t, c, q)) / 2)


class Inverse:
    """len (155 / (x + 1) + 0.85); takes the length for t."""

    def __init__(self, ops: Any = ColumnOps) -> None:
        self.ops = ops

    def value(self, length, c, x):
        return length * (155 / (x + 1) + 0.85)

    def first(self, length, c, x):
        return -155 * length / ((x + 1) * (x + 1))

    def second(self, length, c, x):
        return 310 * length / ((x + 1) * (x + 1) * (x + 1))

    def anti(self, length, c, x):
        return length * (155 * self.ops.log(x + 1) + 0.85 * x)


COSTS = {"bpr": Bpr, "davidson": Davidson, "modified_davidson": ModifiedDavidson, "inverse": Inverse}


def integral(cost: Any, t: Any, c: Any, b: Any) -> Any:
    """Integral of the cost from 0 to b."""
    return cost.anti(t, c, b) - cost.anti(t, c, 0 * b)


class UserEquilibrium:
    """Sum of the integrals; the gradient is the cost itself."""

    @staticmethod
    def value(f, t, c, x):
        return integral(f, t, c, x)

    @staticmethod
    def gradient(f, t, c, x):
        return f.value(t, c, x)

    @staticmethod
    def curvature(f, t, c, x):
        return f.first(t, c, x)


class SystemOptimum:
    """Sum of x times cost; the gradient is the marginal cost."""

    @staticmethod
    def value(f, t, c, x):
        return x * f.value(t, c, x)

    @staticmethod
    def gradient(f, t, c, x):
        return f.value(t, c, x) + x * f.first(t, c, x)

    @staticmethod
    def curvature(f, t, c, x):
        return 2 * f.first(t, c, x) + x * f.second(t, c, x)


OBJECTIVES = {"ue": UserEquilibrium, "so": SystemOptimum}


def scaled_capacity(capacity: Column, period_hours: float) -> Column:
    """Vehicles in the analysis period, 1 at least."""
    return F.greatest(F.round(capacity * F.lit(period_hours)), F.lit(1)).cast("long")


def congestion_class(saturation: Column) -> Column:
    """0 to 7 by fifths of the capacity."""
    return F.least(F.floor(5 * saturation), F.lit(7)).cast("int")
