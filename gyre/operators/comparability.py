"""Which measurements of two sources can be compared: one-sided assessment of nine families, then pair rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.guards import joined, status_name, status_rank

# The measurement families and the clipped share of a channel from which colour needs review.
FAMILIES = (
    "geometry_topology",
    "spatial_optical_morphology",
    "physical_spatial_scale",
    "ordered_dynamics",
    "angular_persistence",
    "relative_luminance_dynamics",
    "absolute_luminance_amplitude",
    "chromatic_activity",
    "tier_edge_crispness",
)
CLIPPING_REVIEW = 0.02
FACTS = ("radiometric", "colour", "target_px", "period_deg", "physical_angle", "pipeline")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _if(condition: Column, reason: Column | str) -> Column:
    """A list of the reason where the condition holds, else an empty one; null does not hold."""
    said = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(F.coalesce(condition, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<string>"))


def _state(status: Column, reasons: Column) -> Column:
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def _reviewed(reasons: Column) -> Column:
    return _state(F.when(F.size(reasons) > 0, "review").otherwise("ok"), reasons)


def assess(profiles: DataFrame, ident: str) -> DataFrame:
    """(ident, family, status, reasons, facts) for every source and measurement family.

    `profiles`: pose_status, pose_reasons; spatial_status, spatial_reasons, transfer_status, transfer_reasons, target_px;
    ordering_status, ordering_reasons; phase_status, phase_reasons, phase_reason, period_deg, physical_angle;
    photometric_reasons, background_status, radiometric, colour, clipping_max; physical_status, physical_reasons; pipeline.
    """
    c = F.col
    lost = lambda s: F.coalesce(c(s) == "unavailable", F.lit(False))
    unique = lambda a: F.array_sort(F.array_distinct(a))
    review = (c("spatial_status") == "review") | F.coalesce(c("transfer_status") == "review", F.lit(False))
    spatial = F.when(lost("spatial_status"), _state(F.lit("unavailable"), _list("spatial_reasons"))).when(
        review, _state(F.lit("review"), F.concat(_list("spatial_reasons"), _list("transfer_reasons")))
    ).otherwise(_state(F.lit("ok"), F.array().cast("array<string>")))
    geometry = F.when(lost("pose_status"), _state(F.lit("unavailable"), _list("pose_reasons"))).when(
        lost("spatial_status"), spatial
    ).otherwise(_reviewed(F.concat(_list("pose_reasons"), spatial["reasons"])))
    phase_lost = lost("ordering_status") | lost("phase_status")
    phase_told = F.concat(_list("ordering_reasons"), _list("phase_reasons"), _if(c("phase_reason").isNotNull(), c("phase_reason")))
    phase_open = F.concat(
        _list("ordering_reasons"),
        _if(~F.coalesce(c("phase_status").isin("available", "ok"), F.lit(False)), "phase_contract_requires_review"),
        _if(lost("pose_status"), "pose_coverage_unavailable"),
    )
    angular = F.when(phase_lost, _state(F.lit("unavailable"), unique(phase_told))).otherwise(_reviewed(phase_open))
    luminance = _reviewed(unique(F.concat(_list("photometric_reasons"), _if(lost("background_status"), "source_global_photometric_stability_unresolved"))))
    absolute = _reviewed(_if(~F.coalesce("radiometric", F.lit(False)), "source_is_not_radiometrically_calibrated"))
    colour = F.concat(
        _list("photometric_reasons"),
        _if(~F.coalesce("colour", F.lit(False)), "source_is_not_colour_calibrated"),
        _if(c("clipping_max") > CLIPPING_REVIEW, "material_stone_channel_clipping"),
    )
    states = (
        geometry, spatial, _state(c("physical_status"), _list("physical_reasons")), _state(c("ordering_status"), _list("ordering_reasons")),
        angular, luminance, absolute, _reviewed(unique(colour)), spatial,
    )
    rows = F.array(*[F.struct(F.lit(name).alias("family"), state.alias("state")) for name, state in zip(FAMILIES, states)])
    return profiles.select(ident, *FACTS, F.explode(rows).alias("r")).select(ident, "r.family", "r.state.status", "r.state.reasons", *FACTS)


def can_compare(pairs: DataFrame, assessed: DataFrame, ident: str) -> DataFrame:
    """(left, right, family, status, reasons) of the requested pairs; work is linear in them.

    Reasons of a side are prefixed with it. A pair of usable sides is worsened to review where calibration
    lacks on a side, transfers, phase periods or pipelines differ; a phase that is no physical angle is only noted.
    """
    side = lambda s: assessed.select(F.col(ident).alias(s), "family", *[F.col(c).alias(f"{s}_{c}") for c in ("status", "reasons", *FACTS)])
    both = pairs.join(side("left"), "left").join(side("right"), ["right", "family"])
    rank = F.greatest(status_rank("left_status"), status_rank("right_status"))
    of = lambda *names: F.col("family").isin(*names)
    on_both = lambda fact: F.coalesce(F.col(f"left_{fact}") & F.col(f"right_{fact}"), F.lit(False))
    differ = lambda fact: ~F.col(f"left_{fact}").eqNullSafe(F.col(f"right_{fact}"))
    worse = F.concat(
        _if(of("absolute_luminance_amplitude") & ~on_both("radiometric"), "cross_source_radiometric_calibration_missing"),
        _if(of("chromatic_activity") & ~on_both("colour"), "cross_source_colour_calibration_missing"),
        _if(of("spatial_optical_morphology", "tier_edge_crispness") & differ("target_px"), "common_spatial_transfer_mismatch"),
        _if(of("angular_persistence") & differ("period_deg"), "viewer_phase_period_mismatch"),
        _if(of("relative_luminance_dynamics") & differ("pipeline"), "different_source_pipelines"),
    )
    noted = _if(of("angular_persistence") & ~on_both("physical_angle"), "viewer_sequence_phase_not_physical_angle")
    own = F.concat(F.transform("left_reasons", lambda r: F.concat(F.lit("left:"), r)), F.transform("right_reasons", lambda r: F.concat(F.lit("right:"), r)))
    told = F.when(rank == 2, own).otherwise(F.concat(own, worse, noted))
    return both.select(
        "left", "right", "family", status_name(F.when(rank == 2, rank).otherwise(F.greatest(rank, (F.size(worse) > 0).cast("int")))).alias("status"),
        joined(F.array_sort(F.array_distinct(told))).alias("reasons"),
    )
