"""Null, zero-denominator and validity guards used by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The consistency factor of the median absolute deviation and the
# three validity levels in ascending severity.
MAD_SCALE = 1.4826
STATUSES = ("ok", "review", "unavailable")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null so they can never win a max or poison a mean."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Floating quotient, null on a zero or null denominator."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def positive(c: str | Column) -> Column:
    c = finite(c)
    return F.when(c > 0, c)


def log_positive(c: str | Column) -> Column:
    return F.ln(positive(c))


def sign_of(c: Column) -> Column:
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Aggregate: population Pearson r, null when either side is constant.

    `corr` raises on a constant column under ANSI, hence the explicit guarded form.
    Both inputs must already be null on the same rows.
    """
    a, b = col(a), col(b)
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def status_rank(c: str | Column) -> Column:
    c = col(c)
    return F.when(c == "unavailable", 2).when(c == "review", 1).otherwise(0)


def status_name(rank: Column) -> Column:
    return F.when(rank == 2, "unavailable").when(rank == 1, "review").otherwise("ok")


def worst_status(*cols: str | Column) -> Column:
    ranks = [status_rank(c) for c in cols]
    return status_name(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Ordered reason list: each condition that holds contributes its text once."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))


def joined(c: str | Column) -> Column:
    """Array of texts as one '|' separated text."""
    return F.array_join(col(c), "|")


def rounded(df, digits: int = 6):
    """All floating columns rounded; negative zero is normalised."""
    kinds = dict(df.dtypes)
    return df.select(
        [
            (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )
