"""Interval selection, support and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.guards import ratio, status_name, status_rank
from gyre.operators.pixels import supported
from gyre.operators.sequence import CHUNK, adjacent, neighbours


def cyclic_window(df: DataFrame, center: str, size: int, period: str) -> DataFrame:
    """Odd window of source indices around a centre, modulo the sequence length."""
    if size % 2 == 0:
        raise ValueError("window size must be odd")
    half = size // 2
    offset = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    return (
        df.where((F.col(period) >= size) & F.col(center).between(0, F.col(period) - 1))
        .withColumn("__o", offset)
        .withColumn("window_position", F.col("__o") + half)
        .withColumn("source_index", F.pmod(F.col(center) + F.col("__o"), F.col(period)))
        .drop("__o")
    )


def check_consecutive(
    df: DataFrame, keys: list[str], order: str, source: str, period: int | None = None, wrap: bool = False, width: int = CHUNK
) -> DataFrame:
    """Rows whose source index does not follow the previous one (an empty result is valid)."""
    pairs = neighbours(df, keys, order, [order, source], width=width).where(F.col(f"prev_{order}").isNotNull())
    good = adjacent(F.col(f"prev_{source}"), F.col(source), "exact" if wrap else "none", period)
    return pairs.where(~good)


def first_in_group(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add the smallest `order` among equal keys.

    Pre-aggregated before the shuffle; a key copied very often is split by the adaptive
    skew join when its rows come back.
    """
    firsts = df.groupBy(*keys).agg(F.min(order).alias(name))
    return df.join(firsts, keys, "left")


def select_frames(requested: DataFrame, frames: DataFrame, keys: list[str], source: str, digest: str, accepted: str) -> DataFrame:
    """Requested positions with the reason a frame is excluded, or null.

    Ambiguous indices (several frame records) give status 'ambiguous_index'.
    """
    one = frames.groupBy(*keys, source).agg(
        F.count(F.lit(1)).alias("__n"), F.first(digest).alias(digest), F.bool_and(accepted).alias(accepted)
    )
    rows = requested.join(one, keys + [source], "left")
    usable = F.col(accepted) & F.col("__n").isNotNull() & (F.col("__n") == 1)
    earliest = rows.where(usable).groupBy(*keys, digest).agg(F.min("position").alias("__first"))
    reason = (
        F.when(F.col("__n").isNull(), "missing_frame")
        .when(F.col("__n") > 1, "ambiguous_index")
        .when(~F.col(accepted), "unaccepted_outline")
        .when(F.col("__first") < F.col("position"), "duplicate_frame")
    )
    return rows.join(earliest, keys + [digest], "left").withColumn("reason", reason).drop("__n", "__first")


def observed_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.where("observed").groupBy(*keys).agg(F.count(F.lit(1)).alias("observed_frames"))


def fixed_support(px: DataFrame, frames: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Pixels supported in every observed frame: a count per pixel, never a pixel list."""
    seen = px.where(F.col("observed") & supported()).groupBy(*keys, "y", "x", *(extra or [])).agg(
        F.count(F.lit(1)).alias("__n")
    )
    need = observed_frames(frames, keys)
    return seen.join(need, keys).where(F.col("__n") == F.col("observed_frames")).drop("__n", "observed_frames")


def support_fractions(px: DataFrame, frames: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Per frame valid / nominal, and per series persistent / union of nominal pixels."""
    per_frame = px.where("observed").groupBy(*keys, order).agg(
        ratio(F.count_if(supported()), F.count_if("in_mask")).alias("support_fraction")
    )
    union = px.where(F.col("observed") & F.col("in_mask")).groupBy(*keys, "y", "x").agg(F.count_if(supported()).alias("__n"))
    need = observed_frames(frames, keys)
    per_series = union.join(need, keys).groupBy(*keys).agg(
        F.count_if(F.col("__n") == F.col("observed_frames")).alias("persistent_pixels"),
        F.count(F.lit(1)).alias("nominal_pixels"),
        ratio(F.count_if(F.col("__n") == F.col("observed_frames")), F.count(F.lit(1))).alias("persistent_fraction"),
    )
    return per_frame, per_series


def compose_validity(cells: DataFrame, keys: list[str], order: str, status: str, reasons: str) -> DataFrame:
    """Worst status and distinct reasons in order of first appearance.

    The reasons come from a closed vocabulary, so equal reasons collapse to their first
    position before anything is collected: one short list per key, however many sources.
    """
    worst = cells.groupBy(*keys).agg(F.max(status_rank(status)).alias("__s"))
    firsts = (
        cells.select(*keys, order, F.posexplode(reasons).alias("__i", "__r"))
        .where("__r is not null and __r <> ''")
        .groupBy(*keys, "__r")
        .agg(F.min(F.struct(F.col(order).alias("o"), F.col("__i").alias("i"))).alias("__at"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__r"))).alias("__l"))
        .select(*keys, F.transform("__l", lambda e: e["__r"]).alias("reasons"))
    )
    return worst.join(firsts, keys, "left").select(
        *keys,
        status_name(F.col("__s")).alias("status"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def upstream_cells(selected: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Validity sources of a selected interval: segmentation status and exclusions.

    Columns read: `seg_status`, `seg_reasons`, `reason` (null where a frame is accepted).
    """
    failed = F.col("seg_status").isin("failed", "unavailable")
    status = F.when(failed, "unavailable").otherwise(F.coalesce("seg_status", F.lit("ok")))
    fallback = F.when(failed, F.array(F.lit("segmentation_unavailable"))).when(
        F.col("seg_status") == "review", F.array(F.lit("segmentation_review"))
    ).otherwise(F.array().cast("array<string>"))
    given = F.when(F.size("seg_reasons") > 0, F.col("seg_reasons")).otherwise(fallback)
    accepted = selected.where("reason is null").select(*keys, F.col(order).alias("order"), status.alias("status"), given.alias("reasons"))
    tail = selected.groupBy(*keys).agg(
        F.count_if(F.col("reason").isNotNull()).alias("__x"), F.count_if(F.col("reason").isNull()).alias("__k"), F.max(order).alias("__m")
    )
    last = F.col("__m") + 1
    excluded = tail.where("__x > 0 and __k > 0").select(
        *keys, last.alias("order"), F.lit("review").alias("status"), F.array(F.lit("requested_frames_excluded")).alias("reasons")
    )
    none = tail.where("__k = 0").select(
        *keys, last.alias("order"), F.lit("unavailable").alias("status"), F.array(F.lit("no_accepted_frames")).alias("reasons")
    )
    return accepted.unionByName(excluded).unionByName(none)


def mobility_validity(upstream: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Inherited validity, worsened by a series without any observed pair."""
    text = "no_observed_adjacent_pairs"
    both = upstream.join(summary.select(*keys, F.col("status").alias("__local")), keys)
    add = (F.col("__local") == "unavailable") & ~F.array_contains("reasons", text)
    return both.select(
        *keys,
        status_name(F.greatest(status_rank("status"), status_rank("__local"))).alias("status"),
        F.when(add, F.concat("reasons", F.array(F.lit(text)))).otherwise(F.col("reasons")).alias("reasons"),
    )


def representation_cells(
    representation: Column, template_status: Column, template_reason: Column, frames_unavailable: Column, frames_review: Column
) -> Column:
    """Extra validity sources of the semantic representation as an array of structs.

    Any other representation gets none, so template quality can only worsen its own cells.
    """
    def cell(status: Column, reason: Column) -> Column:
        return F.struct(status.alias("status"), F.array_compact(F.array(reason)).alias("reasons"))

    template = cell(
        F.coalesce(template_status, F.lit("unavailable")),
        F.when(template_status.isNull(), F.lit("semantic_qc_missing")).otherwise(template_reason),
    )
    frame = (
        F.when(frames_unavailable, cell(F.lit("unavailable"), F.lit("semantic_frame_unavailable")))
        .when(frames_review, cell(F.lit("review"), F.lit("semantic_frame_review")))
    )
    semantic = F.when(template_status.isNull(), F.array(template)).otherwise(F.array_compact(F.array(template, frame)))
    return F.when(representation == "semantic", semantic).otherwise(F.array().cast(
        "array<struct<status:string,reasons:array<string>>>"
    ))


def threshold_key(value: float) -> str:
    return f"{value:.2f}"


def sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Repeat the measurement rows under each unique threshold, which becomes a key.

    One explode of a literal array: one job for all thresholds, no join.
    """
    if len(set(thresholds)) != len(thresholds):
        raise ValueError("thresholds must be unique")
    options = F.array(
        *[F.struct(F.lit(threshold_key(v)).alias("threshold_key"), F.lit(float(v)).alias("threshold")) for v in thresholds]
    )
    return df.select("*", F.explode(options).alias("__t")).select("*", "__t.threshold_key", "__t.threshold").drop("__t")


def uniform_sample(frames: DataFrame, keys: list[str], position: str, size: str, n: int, minimum: int = 16) -> DataFrame:
    """Positions floor(i * size / n) of a complete cycle of at least 16 frames.

    A frame p is sampled iff some i has floor(i * size / n) = p: a per-row test, no join.
    """
    p, m = F.col(position), F.col(size)
    i = F.ceil(p * n / m)
    chosen = (F.floor(i * m / n) == p) & (i < n) & (m >= F.greatest(F.lit(minimum), F.lit(n)))
    return frames.where(chosen).withColumn("sample_no", i)
