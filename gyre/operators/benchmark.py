"""Profiles, benchmark tables, calibration links and source-quality summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import ratio, status_name, status_rank
from gyre.functions.ranking import quantiles, quantiles_of_ranked, ranked_values, value_table
from gyre.operators.sequence import spearman


def source_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, min, median, max and plain MAD for groups of any size."""
    extra = {"min": F.min(value), "max": F.max(value)}
    stats = quantiles(df, keys, value, {"median": 0.5}, extra)
    dev = value_table(df, keys, value).join(stats.select(*keys, "median"), keys).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    merged = dev.groupBy(*keys, "__d").agg(F.sum("cnt").alias("cnt"))
    mad = quantiles_of_ranked(ranked_values(merged, keys, "__d"), keys, "__d", {"mad": 0.5}).drop("n")
    return stats.join(mad, keys).withColumnRenamed("n", "count")


def sequence_contract(frames: DataFrame, key: str, index: str, digest: str, declared: str, ordering: str) -> DataFrame:
    """Duplicate indices and pixels, ordering and completeness of a sequence, as status + reasons.

    Distinct counts come from two levels of grouping, so a much repeated index or frame
    collapses before the shuffle.
    """
    repeats = lambda c, to: (
        frames.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias("__n")).groupBy(key).agg((F.sum("__n") - F.count(F.lit(1))).alias(to))
    )
    base = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.max(declared).alias("__d"), F.max(ordering).alias("__o"))
    out = base.join(repeats(index, "duplicate_indices"), key, "left").join(repeats(digest, "duplicate_pixels"), key, "left").na.fill(0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("duplicate_indices") > 0, "duplicate_source_indices"),
            F.when(F.col("duplicate_pixels") > 0, "duplicate_source_frames_detected"),
            F.when(F.col("__o") != "explicit_manifest", "ordering_not_explicit_manifest"),
            F.when(F.col("__d") != F.col("frames"), "complete_cycle_not_proven"),
        )
    )
    return out.select(
        key, "frames", "duplicate_indices", "duplicate_pixels",
        F.when(F.size(reasons) > 0, "review").otherwise("ok").alias("status"), F.array_join(reasons, "|").alias("reasons"),
    )


def pose_coverage(frames: DataFrame, key: str, status: str, role: str, preferred: str) -> DataFrame:
    """Status counts, usable and preferred-role usable frames, and the resulting status."""
    usable = F.col(status).isin("ok", "review")
    out = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(F.col(status) == s).alias(f"{s}_frames") for s in ("ok", "review", "rejected")],
        F.count_if(usable).alias("usable"),
        F.count_if(usable & (F.col(role) == preferred)).alias("preferred_usable"),
    )
    return out.withColumn(
        "status", F.when(F.col("usable") == 0, "unavailable").when(F.col("preferred_usable") == 0, "review").otherwise("ok")
    ).withColumn(
        "reason",
        F.when(F.col("usable") == 0, "no_geometry_usable_pose_frames").when(F.col("preferred_usable") == 0, "crown_view_interval_not_resolved"),
    )


def pose_extents(frames: DataFrame, key: str, status: str, role: str, preferred: str, rank: str, value: str, best: int = 16) -> DataFrame:
    """Value summary over the preferred role's usable frames, else over the best ranked ones.

    The row_number <= best filter is pushed below the shuffle as a group limit: every task
    sends at most `best` rows of a sequence, however long it is.
    """
    usable = frames.where(F.col(status).isin("ok", "review"))
    has = usable.groupBy(key).agg(F.bool_or(F.col(role) == preferred).alias("__p"))
    top = usable.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where(F.col("__k") <= best)
    rest = top.join(has.where(~F.col("__p")), key, "left_semi").select(key, value)
    chosen = usable.where(F.col(role) == preferred).select(key, value).unionByName(rest)
    stats = source_stats(chosen, [key], value)
    return stats.join(has, key).withColumn("provenance", F.when(F.col("__p"), "preferred_role").otherwise("top_ranked_usable")).drop("__p")


def physical_scale(extents: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    """Median pixels per declared millimetre and axis; missing or invalid sizes are unavailable."""
    rows = extents.join(dims, key, "left")
    good = (F.col("width_mm") > 0) & (F.col("length_mm") > 0)
    state = (
        F.when(~F.coalesce(good, F.lit(False)) | F.col("median_width").isNull(), "unavailable")
        .when(F.col("pose_status") == "ok", "ok")
        .otherwise("review")
    )
    scale = lambda px, mm: F.when(good, ratio(px, mm))
    return rows.select(
        key, scale("median_width", "width_mm").alias("px_per_mm_x"), scale("median_height", "length_mm").alias("px_per_mm_y"), state.alias("status")
    )


def trace_rates(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Transitions per pair and longest runs per observed frame, null on zero denominators."""
    return summary.select(
        *keys,
        ratio("transitions", "observed_pairs").alias("transition_rate"),
        ratio("longest_true", "observed").alias("longest_true_fraction"),
        ratio("longest_false", "observed").alias("longest_false_fraction"),
    )


def ruler_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity: status counts, mean support, median residual of supported rows, ok share."""
    base = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "review", "unavailable")],
        F.avg("support").alias("mean_support"),
        F.avg("confidence").alias("mean_confidence"),
        ratio(F.count_if(F.col("status") == "ok"), F.count(F.lit(1))).alias("ok_fraction"),
    )
    residual = quantiles(frames.where("supported"), keys, "residual", {"median_residual": 0.5}).drop("n")
    return base.join(residual, keys, "left")


def entity_support(diags: DataFrame, keys: list[str]) -> DataFrame:
    """All supported is ok, some measured is review, none is unavailable."""
    measured = F.col("z").isNotNull()
    base = diags.groupBy(*keys).agg(
        F.when(F.bool_and(F.coalesce("supported", F.lit(False))), "ok").when(F.bool_or(measured), "review").otherwise("unavailable").alias("status"),
        F.coalesce(F.min(F.when(measured, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.count_if("supported").alias("supported_count"),
        F.count(F.lit(1)).alias("required_count"),
        F.min("z").alias("minimum_z"),
    )
    residual = quantiles(diags.where("supported"), keys, "residual", {"median_residual": 0.5}).drop("n")
    return base.join(residual, keys, "left")


def build_profile(summaries: DataFrame, spec: DataFrame, fields: list[str], ident: str, criteria: list[str]) -> DataFrame:
    """One cell per object and field from the single summary row meeting the field's criteria.

    `spec` (field_id, criteria...) is joined to the rows; no or several matches, or a
    missing value, make the cell unavailable.
    """
    rows = summaries.join(spec, criteria)
    one = rows.groupBy(ident, "field_id").agg(
        F.count(F.lit(1)).alias("__n"), F.max("value").alias("value"), F.max(status_rank("status")).alias("__s"), F.max("reason").alias("__r")
    )
    every = summaries.select(ident).distinct().withColumn("field_id", F.explode(F.array(*[F.lit(f) for f in fields])))
    cells = every.join(one, [ident, "field_id"], "left")
    single = F.coalesce(F.col("__n") == 1, F.lit(False))
    lacking = F.when(~single, F.when(F.col("__n") > 1, "ambiguous_rows").otherwise("missing_row")).when(F.col("value").isNull(), "missing_value")
    return cells.select(
        ident, "field_id",
        F.when(single, F.col("value")).alias("value"),
        F.when(lacking.isNotNull(), "unavailable").otherwise(status_name(F.col("__s"))).alias("status"),
        F.array_join(F.array_compact(F.array(F.when(single, F.col("__r")), lacking)), "|").alias("reasons"),
    )


def profile_wide(cells: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """field, field__status and field__reasons columns per object; the field list is given."""
    at = lambda f, c: F.max(F.when(F.col("field_id") == f, F.col(c)))
    aggs = []
    for f in fields:
        aggs += [at(f, "value").alias(f), at(f, "status").alias(f"{f}__status"), at(f, "reasons").alias(f"{f}__reasons")]
    return cells.groupBy(ident).agg(*aggs)


def benchmark_rows(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Long object x window x measure rows."""
    return wide.unpivot(keys, measures, "measure", "value")


def window_sensitivity(rows: DataFrame, ident: list[str], window: str, core: str, wide: str) -> DataFrame:
    """Spearman of a measure under two windows, and the paired count."""
    at = lambda w: F.max(F.when(F.col(window) == w, F.col("value")))
    paired = rows.groupBy(*ident, "measure").agg(at(core).alias("core"), at(wide).alias("wide"))
    return spearman(paired, ["measure"], "core", "wide")


def redundancy_matrix(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Spearman of every metric pair: each object row yields one entry per pair of metrics."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for a, b in combinations(metrics, 2)
        ]
    )
    long = wide.select(F.explode(pairs).alias("p")).select("p.*")
    return spearman(long, ["left", "right"], "x", "y")


def object_status(objects: DataFrame, traces: DataFrame, key: str, source_status: str) -> DataFrame:
    have = traces.select(key).distinct().withColumn("__t", F.lit(True))
    return objects.join(have, key, "left").select(
        key,
        F.when(F.col("__t"), "measured").when(F.col(source_status) == "partial", "partial_source").otherwise("source_available").alias("status"),
    )


def ordered_claims(claims: DataFrame, cells: DataFrame, ident: str, strict: bool = False) -> DataFrame:
    """Whether a field rises or falls along each claim's sample list.

    `claims` (claim_id, field_id, increasing, samples array); lists are short and ordered.
    Equal neighbours support either direction unless `strict`.
    """
    rows = claims.select("claim_id", "field_id", "increasing", F.posexplode("samples").alias("i", ident)).join(cells, [ident, "field_id"], "left")
    w = Window.partitionBy("claim_id").orderBy("i")
    step = F.col("value") - F.lag("value").over(w)
    moved = rows.withColumn("__step", step).withColumn("__first", F.col("i") == 0)
    rises, falls = (F.col("__step") > 0, F.col("__step") < 0) if strict else (F.col("__step") >= 0, F.col("__step") <= 0)
    good = F.when(F.col("increasing"), rises).otherwise(falls)
    out = moved.groupBy("claim_id").agg(
        F.bool_and(F.col("__first") | good).alias("__ok"), F.max(F.col("value").isNull()).alias("__gap"), F.count(F.lit(1)).alias("samples")
    )
    return out.select(
        "claim_id", "samples",
        F.when(F.col("__gap"), "mismatch").when(F.col("__ok"), "supports").otherwise("contradicts").alias("verdict"),
    )


def family_summary(obs: DataFrame, levels: list[str]) -> DataFrame:
    """Observations, distinct objects, counts per explanation level and linked fields."""
    base = obs.groupBy("family").agg(
        F.count(F.lit(1)).alias("observations"), *[F.count_if(F.col("explanation") == x).alias(x) for x in levels]
    )
    distinct = obs.groupBy("family", "series_id").agg(F.lit(1).alias("__x")).groupBy("family").agg(F.count(F.lit(1)).alias("objects"))
    fields = obs.where("field_id is not null").groupBy("family", "field_id").agg(F.lit(1).alias("__x")).groupBy("family").agg(
        F.array_join(F.array_sort(F.collect_list("field_id")), "|").alias("fields")
    )
    return base.join(distinct, "family").join(fields, "family", "left")


def unexplained_concepts(obs: DataFrame) -> DataFrame:
    return obs.where("explanation = 'unexplained'").groupBy("concept").agg(F.count(F.lit(1)).alias("observations"))


def link_audit(links: DataFrame) -> DataFrame:
    """Links by resolution, with and without frame overlap."""
    return links.groupBy("resolution").agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(F.col("overlap") > 0).alias("with_overlap"),
        F.count_if(F.col("item_id").isNotNull() & (F.col("overlap") == 0)).alias("without_overlap"),
    )


def calibration_rows(obs: DataFrame, orders: DataFrame) -> DataFrame:
    """Observation x link rows with value and rank; one empty row where nothing is linked."""
    rows = obs.select("id", "series_id", F.explode_outer("fields").alias("field_id"))
    return rows.join(orders, ["series_id", "field_id"], "left")


def observation_trace(obs: DataFrame, trace: DataFrame, index: str) -> DataFrame:
    """Human-selected frames joined to measured rows, order kept, null where absent."""
    rows = obs.select("id", "series_id", F.posexplode("frames").alias("i", index))
    return rows.join(trace, ["series_id", index], "left")
