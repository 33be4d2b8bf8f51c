"""Exact order statistics by range partitioning, whatever the spread of rows over the keys.

A plain grouped `percentile` keeps a whole group's value table in one buffer, and a plain
`row_number` sorts a whole group in one task. Both are fine for groups whose size the data
model bounds (the pixels of one frame, the slots of one cycle) and unusable for a key that
holds a third of all rows. Here the rows (keys, value) are put into one total order: equal values
are collapsed, a sample chosen by hash cuts the order into as many pieces as the session has shuffle
partitions, each piece is ranked on its own, and the counts of the pieces before it are added. A
key with nine tenths of the values is spread over nine tenths of the pieces, a million small
keys share one. The sample only chooses where to cut; counts, and so ranks, are exact. Cuts are a
function of the data alone, so a task that is run again places its rows as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 64  # sampled rows for each piece


def value_table(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, value) -> cnt, the pre-aggregated input of the rank functions.

    `carry` adds aggregates per value, for example the first position showing it.
    """
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    extra = [c.alias(n) for n, c in (carry or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(agg.alias("cnt"), *extra)


def _pieces(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """`df` with `__piece`, the place of a row's (order) among n - 1 cuts sampled from all rows."""
    rows = F.struct(*df.columns)  # all columns, so that the sample reads the exchange that the ranking reads
    sample = df.select(rows.alias("r"), F.xxhash64(*order).alias("h")).orderBy("h", *[F.col(f"r.{c}") for c in order]).limit(SAMPLE * n)
    at = lambda x: F.struct(*[x[c].alias(c) for c in order])
    every = sample.agg(F.sort_array(F.transform(F.collect_list("r"), at)).alias("s"))
    step = F.sequence(F.lit(1), F.lit(n - 1))
    cuts = every.select(
        F.when(F.size("s") > 0, F.transform(step, lambda i: F.element_at("s", F.floor(i * F.size("s") / n).cast("int") + 1))).alias("cuts")
    ).scalar()
    side = max(2, round(n**0.5))
    here, below = F.struct(*[F.col(c) for c in order]), lambda c: c <= F.col("__here")
    placed = df.withColumn("__here", here).withColumn("__cuts", cuts)
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, (n - 1) // side))), lambda i: F.get("__cuts", i * side - 1)), below))
    placed = placed.withColumn("__coarse", coarse)
    fine = F.size(F.filter(F.slice("__cuts", F.col("__coarse") * side + 1, F.lit(side)), below))
    return placed.withColumn("__piece", F.col("__coarse") * side + fine).drop("__here", "__cuts", "__coarse")


def ranked_values(counts: DataFrame, keys: list[str], value: str, pieces: int | None = None) -> DataFrame:
    """Add `below` (rows with a smaller value) and `total` per key to a value table."""
    n = pieces or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = _pieces(counts, [*keys, value], n) if n > 1 else counts.withColumn("__piece", F.lit(0))
    part = Window.partitionBy(*keys, "__piece")
    run = laid.withColumn("__run", F.sum("cnt").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__tot", F.sum("cnt").over(part))
    if n == 1:
        return run.select(*counts.columns, (F.col("__run") - F.col("cnt")).alias("below"), F.col("__tot").alias("total"))
    # Only a key that a cut parts needs sums of other pieces: n - 1 cuts part n - 1 keys at most,
    # and leave at most 2 (n - 1) rows, which bounds the broadcast.
    by_key = Window.partitionBy(*keys)
    offsets = (
        laid.groupBy(*keys, "__piece")
        .agg(F.sum("cnt").alias("__n"))
        .withColumn("__off", F.sum("__n").over(by_key.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("__all", F.sum("__n").over(by_key))
        .where(F.col("__all") > F.col("__n"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"), "__off", "__all")
    )
    same = F.col("__piece") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = run.join(F.broadcast(offsets), same, "left")
    return out.select(
        *counts.columns,
        (F.coalesce("__off", F.lit(0)) + F.col("__run") - F.col("cnt")).alias("below"),
        F.coalesce("__all", "__tot").alias("total"),
    )


def quantiles_of_ranked(
    ranked: DataFrame, keys: list[str], value: str, qs: dict[str, float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Linear-interpolation quantiles (numpy's default) from a ranked value table."""
    last = F.col("total") - 1
    covers = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("cnt"))
    aggs = [F.max("total").alias("n")]
    for name, q in qs.items():
        at = last * F.lit(float(q))
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when(covers(lo), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(covers(hi), F.col(value))).alias(f"__hi_{name}"),
        ]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    wide = ranked.groupBy(*keys).agg(*aggs)
    last = F.col("n") - 1
    cols = []
    for name, q in qs.items():
        at = last * F.lit(float(q))
        frac = at - F.floor(at)
        cols.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * frac).alias(name))
    return wide.select(*keys, "n", *cols, *(extra or {}))


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    qs: dict[str, float],
    extra: dict[str, Column] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Exact quantiles per key for groups of any size; null values are left out.

    `extra` aggregates run over the ranked value table (columns `value`, `cnt`).
    """
    ranked = ranked_values(value_table(df, keys, value), keys, value, pieces)
    return quantiles_of_ranked(ranked, keys, value, qs, extra)


def average_rank() -> Column:
    """Zero-based tie-averaged rank of a ranked value."""
    return F.col("below") + (F.col("cnt") - 1) / F.lit(2.0)


def bounded_quantile(value: str | Column, q: float) -> Column:
    """Aggregate for groups whose size the data model bounds (frame, cycle, array)."""
    return F.percentile(value, F.lit(float(q)))
