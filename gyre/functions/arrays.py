"""Statistics of short arrays held in one row (a profile, a shape): no shuffle at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def present(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def array_quantile(a: Column, q: float) -> Column:
    """Linear-interpolation quantile of the non-null elements; null when there are none."""

    def pick(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(float(q))
        lo = F.get(s, F.floor(at).cast("int"))
        hi = F.get(s, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))

    return let(F.array_sort(present(a)), lambda s: F.when(F.size(s) > 0, pick(s)))


def array_median(a: Column) -> Column:
    return array_quantile(a, 0.5)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(a: Column) -> Column:
    return let(present(a), lambda s: F.when(F.size(s) > 0, array_sum(s) / F.size(s)))


def array_std(a: Column) -> Column:
    """Population standard deviation of the non-null elements."""
    return let(
        present(a),
        lambda s: let(array_mean(s), lambda m: F.sqrt(array_sum(F.transform(s, lambda v: (v - m) * (v - m))) / F.size(s))),
    )


def robust_z(a: Column) -> Column:
    """(v - median) / max(1.4826 MAD, 0.2 std, 1e-6), null elements stay null."""

    def scaled(med: Column) -> Column:
        mad = array_median(F.transform(a, lambda v: F.abs(v - med)))
        scale = F.greatest(1.4826 * mad, 0.2 * array_std(a), F.lit(1e-6))
        return let(scale, lambda s: F.transform(a, lambda v: (v - med) / s))

    return let(array_median(a), scaled)


def smooth_reflect(a: Column, kernel: list[float]) -> Column:
    """Fixed-kernel smoothing, the array mirrored at both ends."""
    n, radius = F.size(a), len(kernel) // 2

    def at(i: Column) -> Column:
        folded = F.pmod(i, 2 * n)
        return F.get(a, F.when(folded < n, folded).otherwise(2 * n - 1 - folded).cast("int"))

    def value(_v: Column, i: Column) -> Column:
        out = F.lit(0.0)
        for offset, weight in zip(range(-radius, radius + 1), kernel):
            out = out + at(i + offset) * weight
        return out

    return F.transform(a, value)
