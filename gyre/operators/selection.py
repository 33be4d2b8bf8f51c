"""Deterministic choices: value first, then the earliest position.

Single winners are aggregates (min / max over an ordered struct), which combine before the
shuffle; only ranked lists use a window, within a bounded cycle or candidate list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity order of frame statuses.
STATUS_ORDER = {"ok": 0, "review": 1, "rejected": 2, "failed": 3}


def _rank_of(column: str, order: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for text, rank in order.items():
        out = F.when(F.col(column) == text, rank).otherwise(out)
    return out


def lexicographic_rank(
    df: DataFrame, keys: list[str], role: str, roles: dict[str, int], status: str, score: str, position: str
) -> DataFrame:
    """Rank by hard failure, role, status, descending score, position (cycle-bounded)."""
    order = [
        F.when(F.col(status).isin("rejected", "failed"), 1).otherwise(0),
        _rank_of(role, roles, 1),
        _rank_of(status, STATUS_ORDER, 4),
        F.col(score).desc(),
        F.col(position),
    ]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tiered_choice(df: DataFrame, keys: list[str], tier: str, error: str, score: str, position: str) -> DataFrame:
    """The best row of the best non-empty tier: smallest error, largest score, earliest."""
    best = F.min(F.struct(tier, error, (-F.col(score)).alias("__neg"), position))
    return (
        df.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, f"b.{tier}", f"b.{error}", (-F.col("b.__neg")).alias(score), f"b.{position}")
    )


def extreme(df: DataFrame, keys: list[str], rule: str, value: str, position: str, largest: bool, where: Column | None = None) -> DataFrame:
    """Earliest row with the largest (or smallest) non-null value."""
    rows = df.where(F.col(value).isNotNull())
    if where is not None:
        rows = rows.where(where)
    if largest:
        best = F.max(F.struct(F.col(value).alias("v"), (-F.col(position)).alias("p")))
    else:
        best = F.min(F.struct(F.col(value).alias("v"), F.col(position).alias("p")))
    at = -F.col("b.p") if largest else F.col("b.p")
    return rows.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.lit(rule).alias("rule"), at.alias(position), F.col("b.v").alias(value)
    )


def nearest(df: DataFrame, keys: list[str], value: str, position: str, targets: DataFrame, rules: list[str]) -> DataFrame:
    """Earliest row nearest each target; `targets` has one column per rule and one row per key."""
    stacked = targets.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("target")) for r in rules])).alias("z")
    ).select(*keys, "z.rule", "z.target")
    best = F.min(F.struct(F.abs(F.col(value) - F.col("target")).alias("d"), F.col(position).alias("p"), F.col(value).alias("v")))
    return (
        df.where(F.col(value).isNotNull())
        .join(stacked, keys)
        .groupBy(*keys, "rule")
        .agg(best.alias("b"))
        .select(*keys, "rule", F.col("b.p").alias(position), F.col("b.v").alias(value))
    )
