"""Radial profiles: peaks, boundary templates, cross-fitting and shape consensus.

A profile is one row holding an array of a fixed number of samples (null where not
supported), so everything about one profile is a row expression. Profiles meet only in
aggregates over their set (frames x sectors of one series, a bounded number).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gyre.functions.arrays import array_median, array_quantile, array_sum, let, present, robust_z, smooth_reflect
from gyre.functions.guards import ratio
from gyre.operators.pixels import gaussian_kernel, periodic_interp
from gyre.session import cut_lineage

# Boundary names and windows, support rule, spacing and fallback counts.
BOUNDARIES = ("centre_inner", "inner_middle", "middle_outer")
WINDOWS = ((0.42, 0.60), (0.64, 0.82), (0.82, 0.92))
COARSE = (0.20, 0.45, 0.70)
Z_SUPPORT = 0.8
MIN_SPACING = 0.075
PEAK_SPACING = 0.095
INTERIOR = (0.16, 0.92)
SMOOTHING = 1.2
SECTORS = 8


def u_of(index: Column, n: int) -> Column:
    """Normalised radius of a sample: the first at the centre, the last at the outline."""
    return index / F.lit(float(n - 1))


def profile_arrays(long: DataFrame, keys: list[str], index: str, value: str, ok: str) -> DataFrame:
    """Long profile samples as one array per profile, null where unsupported."""
    cell = F.struct(F.col(index).alias("k"), F.when(F.col(ok), F.col(value)).alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("profile"))


def local_peak(profile: Column, z: Column, target: Column, radius: float, minimum: int, n: int) -> Column:
    """Arg-max within +-radius of the target: index, u, value, z, offset; null if too few samples."""
    near = F.filter(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.get(profile, i).isNotNull() & (F.abs(u_of(i, n) - target) <= radius),
    )

    def best(idx: Column) -> Column:
        top = F.array_max(F.transform(idx, lambda i: F.struct(F.get(profile, i).alias("v"), (-i).alias("neg"))))
        return let(
            top,
            lambda t: F.struct(
                (-t["neg"]).alias("index"),
                u_of(-t["neg"], n).alias("u"),
                t["v"].alias("value"),
                F.get(z, -t["neg"]).alias("z"),
                (u_of(-t["neg"], n) - target).alias("offset"),
            ),
        )

    return let(near, lambda idx: F.when(F.size(idx) >= minimum, best(idx)))


def peak_indices(curve: Column, n: int) -> Column:
    """Local maxima, a flat top at its middle (rounded down); tops that reach an end are none."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(-1).alias("rise"), none.alias("found"))

    def step(acc: Column, i: Column) -> Column:
        up, down = F.get(curve, i) > F.get(curve, i - 1), F.get(curve, i) < F.get(curve, i - 1)
        ends = down & (acc["rise"] >= 0)
        return F.struct(
            F.when(up, i).when(down, F.lit(-1)).otherwise(acc["rise"]).alias("rise"),
            F.when(ends, F.concat(acc["found"], F.array(F.floor((acc["rise"] + i - 1) / 2).cast("int")))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, step)["found"]


def spaced(curve: Column, candidates: Column, distance: int, start: Column | None = None) -> Column:
    """Highest first, of equal ones the outer first; drop anything closer than `distance` to a kept index."""
    order = F.transform(
        F.array_sort(F.transform(candidates, lambda i: F.struct((-F.get(curve, i)).alias("h"), (-i).alias("i")))), lambda s: -s["i"]
    )
    empty = F.array().cast("array<int>") if start is None else start
    return F.aggregate(
        order,
        empty,
        lambda acc, i: F.when(F.exists(acc, lambda k: F.abs(k - i) < distance), acc).otherwise(F.concat(acc, F.array(i))),
    )


def prominence(curve: Column, i: Column, n: int) -> Column:
    """Height above the higher of the two valleys reaching to the next higher sample."""
    h = F.get(curve, i)
    higher_left = F.array_max(F.filter(F.sequence(F.lit(0), i - 1), lambda j: F.get(curve, j) > h))
    higher_right = F.array_min(F.filter(F.sequence(i + 1, F.lit(n - 1)), lambda j: F.get(curve, j) > h))
    left = let(F.coalesce(higher_left + 1, F.lit(0)), lambda a: F.array_min(F.slice(curve, a + 1, i - a + 1)))
    right = let(F.coalesce(higher_right - 1, F.lit(n - 1)), lambda b: F.array_min(F.slice(curve, i + 1, b - i + 1)))
    return h - F.greatest(left, right)


def window_peaks(curve: Column, n: int, distance: int) -> Column:
    """Peaks that compete inside each boundary window only, on the window's own samples."""

    def peaks(first: int, size: int) -> Column:
        kept = let(F.slice(curve, first + 1, size), lambda part: spaced(part, peak_indices(part, size), distance))
        return F.transform(kept, lambda i: i + first)

    windows = [[k for k in range(n) if low <= k / (n - 1) <= high] for low, high in WINDOWS]
    found = [peaks(w[0], len(w)) for w in windows if len(w) >= 3]
    return F.array_sort(F.array_distinct(F.concat(*found))) if found else F.array().cast("array<int>")


def profile_peaks(df: DataFrame, curve: str, n: int, minimum: int = 3, fill_to: int = 6, policy: str = "global") -> DataFrame:
    """Interior peaks with prominence; fewer than `minimum` are filled from the strongest samples.

    Policy "window": peaks compete inside their boundary window only, and none is made up.
    """
    c = F.col(curve)
    distance = max(3, round(PEAK_SPACING * (n - 1)))
    if policy == "window":
        rows = df.withColumn("__kept", window_peaks(c, n, distance)).select("*", F.explode("__kept").alias("peak_index"))
        return rows.select(
            *df.columns, "peak_index", u_of(F.col("peak_index"), n).alias("peak_u"),
            F.get(c, F.col("peak_index")).alias("height"), prominence(c, F.col("peak_index"), n).alias("prominence"),
        )
    inside = lambda i: u_of(i, n).between(*INTERIOR)
    rows = df.withColumn("__kept", F.array_sort(F.filter(spaced(c, peak_indices(c, n), distance), inside)))
    samples = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), inside)
    filled = F.slice(spaced(c, samples, distance, F.col("__kept")), 1, fill_to)
    rows = rows.withColumn("__all", F.when(F.size("__kept") >= minimum, F.col("__kept")).otherwise(filled))
    return rows.select("*", F.explode("__all").alias("peak_index")).select(
        *df.columns,
        "peak_index",
        u_of(F.col("peak_index"), n).alias("peak_u"),
        F.get(c, F.col("peak_index")).alias("height"),
        F.when(F.array_contains("__kept", F.col("peak_index")), prominence(c, F.col("peak_index"), n)).otherwise(0.0).alias("prominence"),
    )


def _medians_of_sets(keys: list[str], sector: str, schema: pa.Schema):
    def medians(values: np.ndarray, valid: np.ndarray):
        """Of the columns of a matrix, and which have one; the mean of the middle two as Spark's median takes it."""
        n = valid.sum(axis=0)
        ordered = np.sort(np.where(valid, values, np.nan), axis=0)
        low, high = (np.take_along_axis(ordered, at[None, :], axis=0)[0] for at in (np.maximum(n - 1, 0) // 2, np.minimum(n // 2, len(valid) - 1)))
        return np.where(n % 2 == 1, low, 0.5 * low + 0.5 * high), n > 0

    def run(table: pa.Table) -> pa.Table:
        lists = table["profile"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
        if not size.sum():
            return schema.empty_table()
        flat = lists.flatten()
        row, place = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        values, valid = np.full((len(size), size.max()), np.nan), np.zeros((len(size), size.max()), bool)
        values[row, place] = flat.to_numpy(zero_copy_only=False)
        valid[row, place] = flat.is_valid().to_numpy(zero_copy_only=False)
        of: dict = {}
        for i, name in enumerate(table[sector].to_pylist()):
            if size[i]:
                of.setdefault(name, []).append(i)
        cells = {name: (size[rows].max(), *medians(values[rows], valid[rows])) for name, rows in of.items()}
        middle, found = medians(np.array([v for _, v, _ in cells.values()]), np.array([ok for _, _, ok in cells.values()]))
        listed = [{"s": name, "p": pa.array(v[:k], mask=~ok[:k]).to_pylist()} for name, (k, v, ok) in cells.items()]
        one = {c: table[c].slice(0, 1) for c in keys}
        return pa.table(one | {"raw": [np.where(found, middle, 0.0)], "cells": [listed]}, schema)

    return run


def consensus(profiles: DataFrame, keys: list[str], sector: str, n: int) -> DataFrame:
    """Per set: eight sector medians over frames, and their smoothed median profile.

    A set meets as a whole, one array a profile: its frames x sectors are bounded, and its medians by sample need no
    rows of their own.
    """
    whole = profiles.dropna(subset=keys).select(*keys, sector, F.col("profile").cast("array<double>").alias("profile"))
    kind = T.StructType([whole.schema[c] for c in keys]).add("raw", T.ArrayType(T.DoubleType()))
    kind = kind.add("cells", T.ArrayType(T.StructType().add("s", whole.schema[sector].dataType).add("p", T.ArrayType(T.DoubleType()))))
    sets = whole.groupBy(*keys).applyInArrow(_medians_of_sets(keys, sector, to_arrow_schema(kind)), kind)
    scored = F.transform("cells", lambda c: F.struct(c["s"].alias("s"), c["p"].alias("p"), robust_z(c["p"]).alias("z")))
    # The peaks read the curve many times over: without a cut Spark would smooth it again for every read.
    return cut_lineage(sets.select(*keys, smooth_reflect(F.col("raw"), gaussian_kernel(SMOOTHING)).alias("curve"), F.array_sort(scored).alias("sectors")))


def candidates(curves: DataFrame, n: int, policy: str = "global") -> DataFrame:
    """Peaks of the consensus with their local peak in every sector and the sector support."""
    rows = profile_peaks(curves, "curve", n, policy=policy)
    peaks = F.transform("sectors", lambda s: local_peak(s["p"], s["z"], F.col("peak_u"), 0.045, 3, n))
    rows = rows.withColumn("sector_peaks", peaks)
    held = F.size(F.filter("sector_peaks", lambda p: p["z"] >= Z_SUPPORT)) / F.lit(float(SECTORS))
    return rows.withColumn("sector_support", held).drop("sectors", "curve")


def selection_score(prominence: Column, scale: Column, support: Column) -> Column:
    return F.round(F.log1p(prominence / scale) + 1.25 * support, 12)


def _scales(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Number of candidates of a set and the median of their positive prominences."""
    return cands.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.greatest(F.coalesce(F.median(F.when(F.col("prominence") > 0, F.col("prominence"))), F.lit(0.0)), F.lit(1e-6)).alias("__scale"),
    )


def boundary_template(cands: DataFrame, keys: list[str], n: int, evidence: DataFrame | None = None) -> DataFrame:
    """Best supported candidate per window, sector controls, and the template's status.

    One row per set and boundary; a window without a candidate makes the set unavailable. `control`
    is "full" where all three boundaries were found apart from each other, "partial" for a
    boundary found beside missing or inseparable ones. With `evidence` (see `candidate_persistence`) a candidate needs
    the vote of a frame, and frame votes, supported pairs and offset come before the score.
    """
    # The few candidate rows of a set feed several aggregates: compute them once.
    cands = cut_lineage(cands)
    scale = _scales(cands, keys)
    windows = F.array(
        *[
            F.struct(F.lit(i).alias("b"), F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for i, (name, (lo, hi)) in enumerate(zip(BOUNDARIES, WINDOWS))
        ]
    )
    score = selection_score(F.col("prominence"), F.col("__scale"), F.col("sector_support"))
    rank = [score.alias("score")]
    if evidence is not None:
        cands = cands.join(evidence.select(*keys, "peak_index", "frame_votes", "supported_pairs", "median_offset"), [*keys, "peak_index"]).where("frame_votes >= 1")
        rank = ["frame_votes", "supported_pairs", F.coalesce(-F.col("median_offset"), F.lit(-1.0)).alias("near"), *rank]
    inside = cands.join(scale, keys).withColumn("w", F.explode(windows)).where(
        F.col("peak_u").between(F.col("w.lo"), F.col("w.hi")) & (F.col("sector_support") >= 0.25)
    )
    best = inside.groupBy(*keys, F.col("w.b").alias("b")).agg(
        F.max(F.struct(*rank, (-F.col("peak_index")).alias("neg"), "peak_u", "prominence", "sector_peaks", "w")).alias("c")
    )
    best = best.select(
        *keys, "b", F.col("c.w.name").alias("boundary"), F.col("c.peak_u").alias("global_u"),
        (F.least(F.col("c.peak_u") - F.col("c.w.lo"), F.col("c.w.hi") - F.col("c.peak_u")) <= 1.0 / (n - 1) + 1e-12).alias("near_edge"),
        F.posexplode("c.sector_peaks").alias("sector", "p"),
    )
    seen = F.coalesce(F.col("p.z") >= Z_SUPPORT, F.lit(False))
    rows = best.select(
        *keys, "b", "boundary", "global_u", "near_edge", "sector",
        seen.alias("observed"), F.when(seen, F.col("p.u")).otherwise(F.col("global_u")).alias("u"),
    )
    # The opposite sector is four steps away in a ring of eight.
    ring = Window.partitionBy(*keys, "b").orderBy("sector")
    across = lambda c: F.coalesce(F.lag(c, 4).over(ring), F.lead(c, 4).over(ring))
    rows = rows.withColumn("__o", across("observed")).withColumn("__u", across("u"))
    rows = rows.withColumn(
        "u", F.when(F.col("observed") & F.col("__o"), 0.8 * F.col("u") + 0.1 * (F.col("u") + F.col("__u"))).otherwise(F.col("u"))
    )
    rows = cut_lineage(rows.drop("__o", "__u"))
    at = lambda i, c: F.max(F.when(F.col("b") == i, F.col(c)))
    spread = lambda c: F.least(at(1, c) - at(0, c), at(2, c) - at(1, c)) < MIN_SPACING
    crossing = rows.groupBy(*keys, "sector").agg((spread("u") & (F.count(F.lit(1)) == 3)).alias("clash"))
    sets = rows.groupBy(*keys).agg(
        F.count_distinct("b").alias("__have"),
        spread("global_u").alias("__narrow"),
        *[F.max(F.col("b") == i).alias(f"__b{i}") for i in range(3)],
    )
    fixed = rows.join(crossing, keys + ["sector"]).withColumn("__c", F.coalesce("clash", F.lit(False)))
    fixed = fixed.groupBy(*keys, "b", "boundary").agg(
        F.max("global_u").alias("global_u"),
        F.max("near_edge").alias("near_edge"),
        F.avg((F.col("observed") & ~F.col("__c")).cast("double")).alias("sector_support"),
        F.array_sort(
            F.collect_list(F.struct("sector", F.when(F.col("__c"), F.col("global_u")).otherwise(F.col("u")).alias("u")))
        ).alias("l"),
    )
    worst = fixed.groupBy(*keys).agg(F.min("sector_support").alias("__low"), F.max("near_edge").alias("__edge"))
    names = F.explode(F.array(*[F.lit(b) for b in BOUNDARIES])).alias("boundary")
    every = scale.select(*keys, "__n", names).join(sets, keys, "left").join(worst, keys, "left").join(fixed.drop("near_edge", "b"), keys + ["boundary"], "left")
    missing = F.coalesce(*[F.when(~F.coalesce(F.col(f"__b{i}"), F.lit(False)), F.lit(BOUNDARIES[i])) for i in range(3)])
    complete = F.coalesce((F.col("__have") == 3) & (F.col("__n") >= 3), F.lit(False))
    usable = complete & ~F.coalesce("__narrow", F.lit(False))
    status = F.when(~usable | (F.col("__low") < 0.25), "unavailable").when((F.col("__low") < 0.5) | F.col("__edge"), "review").otherwise("ok")
    reason = (
        F.when(F.col("__n") < 3, "fewer_than_three_persistent_radial_edges")
        .when(~complete, F.concat(F.lit("no_supported_"), missing, F.lit("_edge")))
        .when(~usable, "semantic_boundaries_not_separable")
        .when(F.col("__low") < 0.25, "insufficient_cross_sector_support")
        .when(F.col("__edge"), "semantic_window_edge")
    )
    return every.select(
        *keys, "boundary", "global_u", F.transform("l", lambda x: x["u"]).alias("sector_u"), "sector_support",
        F.when(usable, "full").when(F.col("global_u").isNotNull(), "partial").alias("control"),
        status.alias("status"), reason.alias("reason"),
    )


def candidate_persistence(profiles: DataFrame, cands: DataFrame, keys: list[str], frame: str, n: int) -> DataFrame:
    """Frames voting for each candidate (four of eight sectors), supported pairs, median offset, its score, and
    its place among the set's candidates that a frame votes for: most votes, most pairs, nearest, best score."""
    # The few candidate rows and the votes feed several aggregates: compute them once.
    cands = cut_lineage(cands)
    scale = _scales(cands, keys)
    score = selection_score(F.col("prominence"), F.col("__scale"), F.col("sector_support")).alias("score")
    named = cands.join(scale, keys).select(*keys, "peak_index", "peak_u", score)
    rows = profiles.withColumn("z", robust_z(F.col("profile"))).join(named, keys)
    peak = local_peak(F.col("profile"), F.col("z"), F.col("peak_u"), 0.025, 3, n)
    rows = rows.withColumn("p", peak).withColumn("ok", F.coalesce(F.col("p.z") >= Z_SUPPORT, F.lit(False)))
    rows = cut_lineage(rows.select(*keys, "peak_index", frame, "ok", F.col("p.offset").alias("offset")))
    per_frame = rows.groupBy(*keys, "peak_index", frame).agg(F.count_if("ok").alias("votes"))
    vote = per_frame.groupBy(*keys, "peak_index").agg(
        F.count_if(F.col("votes") >= 4).alias("frame_votes"), F.sum("votes").alias("supported_pairs"), F.count(F.lit(1)).alias("frames")
    )
    offset = rows.groupBy(*keys, "peak_index").agg(F.median(F.when(F.col("ok"), F.abs("offset"))).alias("median_offset"))
    found = vote.join(offset, keys + ["peak_index"]).join(named.select(*keys, "peak_index", "score"), keys + ["peak_index"])
    # A set has few candidates, so one window holds them.
    best = Window.partitionBy(*keys).orderBy(
        F.desc("frame_votes"), F.desc("supported_pairs"), F.asc_nulls_last(F.round("median_offset", 12)), F.desc("score"), "peak_index"
    )
    return found.withColumn("place", F.when(F.col("frame_votes") >= 1, F.row_number().over(best)))


def boundary_alignment(profiles: DataFrame, template: DataFrame, keys: list[str], sector: str, n: int) -> DataFrame:
    """Median local maximum at detected against fixed radii, and their ratio."""
    rows = profiles.join(template.where("control = 'full'").select(*keys, "boundary", "sector_u"), keys)
    coarse = F.lit(None).cast("double")
    for name, radius in zip(BOUNDARIES, COARSE):
        coarse = F.when(F.col("boundary") == name, F.lit(radius)).otherwise(coarse)

    def strongest(target: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.abs(u_of(i, n) - target) <= 0.018)
        return F.array_max(present(F.transform(near, lambda i: F.get(F.col("profile"), i))))

    at = rows.withColumn("step", strongest(F.get("sector_u", F.col(sector).cast("int")))).withColumn("old", strongest(coarse))
    return at.groupBy(*keys, "boundary").agg(F.median("step").alias("step_edge_median"), F.median("old").alias("coarse_edge_median")).withColumn(
        "edge_ratio", ratio("step_edge_median", "coarse_edge_median")
    )


def boundary_frame(profiles: DataFrame, controls: DataFrame, keys: list[str], frame: str, ray: str, rays: int, n: int) -> DataFrame:
    """Per frame and boundary: supported rays, longest circular gap, peak strength, offsets.

    `controls` has `sector_u` per set and boundary. The rays of one frame are a fixed number.
    """
    rows = profiles.withColumn("z", robust_z(F.col("profile"))).join(controls, [k for k in keys if k in controls.columns])
    target = periodic_interp(F.col(ray) * F.lit(2 * math.pi / rays), F.col("sector_u"))
    rows = rows.withColumn("p", local_peak(F.col("profile"), F.col("z"), F.round(target, 12), 0.04, 2, n))
    cell = F.struct(F.col(ray).alias("r"), F.col("p.z").alias("z"), F.col("p.offset").alias("o"), F.coalesce(F.col("p.z") >= Z_SUPPORT, F.lit(False)).alias("ok"))
    frames = rows.groupBy(*keys, frame, "boundary").agg(F.array_sort(F.collect_list(cell)).alias("rays"))
    finite = F.filter("rays", lambda r: r["z"].isNotNull())
    frames = frames.withColumn("f", finite)
    z, o = F.transform("f", lambda r: r["z"]), F.transform("f", lambda r: r["o"])
    flags = F.transform("rays", lambda r: r["ok"])
    # Longest run of unsupported rays around the circle: walk the doubled flags.
    walk = F.aggregate(
        F.concat(flags, flags),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, ok: let(
            F.when(ok, 0).otherwise(acc["run"] + 1), lambda run: F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))
        ),
    )["best"]
    count = F.size("f")
    med = array_median(o)
    mad = let(med, lambda m: 1.4826 * array_median(F.transform(o, lambda v: F.abs(v - m))))
    status = (
        F.when(count >= max(8, round(0.5 * rays)), "ok").when(count >= max(4, round(0.25 * rays)), "review").otherwise("unavailable")
    )
    return frames.select(
        *keys,
        frame,
        "boundary",
        status.alias("status"),
        count.alias("finite_peaks"),
        F.size(F.filter(flags, lambda x: x)).alias("supported_rays"),
        (F.size(F.filter(flags, lambda x: x)) / F.size(flags)).alias("supported_fraction"),
        (F.least(walk, F.size(flags)) / F.size(flags)).alias("longest_gap_fraction"),
        array_median(z).alias("median_peak_z"),
        array_quantile(z, 0.1).alias("q10_peak_z"),
        F.round(array_median(F.transform(o, lambda v: F.abs(v))), 9).alias("median_abs_offset"),
        mad.alias("offset_mad"),
        F.round(med, 9).alias("median_signed_offset"),
    )


def boundary_summary(frames: DataFrame, keys: list[str], requested: Column) -> DataFrame:
    """Strength, continuity, worst gap and position spread per boundary over a set's frames."""
    usable = F.col("status") != "unavailable"
    val = lambda c: F.when(usable, F.col(c))
    return frames.groupBy(*keys, "boundary").agg(
        requested.alias("requested_frames"),
        F.count(F.lit(1)).alias("scored_frames"),
        F.count_if(usable).alias("usable_frames"),
        ratio(F.count(F.lit(1)), requested).alias("coverage"),
        F.when(F.count_if(usable) >= 3, "ok").otherwise("unavailable").alias("status"),
        F.median(val("median_peak_z")).alias("strength_median"),
        F.percentile(val("median_peak_z"), F.lit(0.1)).alias("strength_q10"),
        F.median(val("supported_fraction")).alias("continuity_median"),
        F.max(val("longest_gap_fraction")).alias("worst_gap"),
        F.median(val("offset_mad")).alias("position_median_mad"),
        F.percentile(val("offset_mad"), F.lit(0.9)).alias("position_q90_mad"),
    )


def crossfit(profiles: DataFrame, keys: list[str], frame: str, sector: str, n: int) -> DataFrame:
    """Template on one parity of frames, score on the other; then the summary with its status.

    The fold is a key: both templates come from one pass over the profiles.
    """
    train = profiles.withColumn("fold", F.pmod(F.col(frame) + 1, F.lit(2)).cast("int"))
    template = boundary_template(candidates(consensus(train, keys + ["fold"], sector, n), n), keys + ["fold"], n)
    held = profiles.withColumn("fold", F.pmod(frame, F.lit(2)).cast("int"))
    controls = template.where("status <> 'unavailable'").select(*keys, "fold", "boundary", "sector_u", F.col("status").alias("template_status"))
    scored = boundary_frame(held, controls.drop("template_status"), keys + ["fold"], frame, sector, SECTORS, n)
    total = profiles.groupBy(*keys).agg(F.count_distinct(frame).alias("__req"))
    folds = template.groupBy(*keys).agg(
        F.max((F.col("status") == "unavailable")).alias("__bad"), F.max((F.col("status") == "review")).alias("__rev")
    )
    summary = boundary_summary(scored.join(total, keys), keys, F.max("__req"))
    many = scored.groupBy(*keys).agg(F.count_distinct(frame).alias("__scored"))
    rows = summary.join(folds, keys).join(many, keys)
    lacking = F.col("__bad") | (F.col("__scored") < F.col("requested_frames"))
    state = F.when(F.col("__scored") < 3, "unavailable").when(lacking | F.col("__rev"), "review").otherwise("ok")
    reasons = F.array_join(
        F.array_compact(F.array(F.when(lacking, "crossfit_template_unavailable"), F.when(F.col("__rev"), "crossfit_template_review"))), "|"
    )
    return rows.select(
        *[F.when((F.col("status") != "unavailable") & (state == "review"), "review").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in summary.columns],
        state.alias("crossfit_status"),
        reasons.alias("reasons"),
    )


def peak_suppression(df: DataFrame, keys: list[str], curve: str, n: int, low: float = 0.40, high: float = 0.68) -> DataFrame:
    """Raw local maxima in a window, whether spacing kept them, and what suppressed them."""
    c = F.col(curve)
    distance = max(3, round(PEAK_SPACING * (n - 1)))
    kept = F.filter(spaced(c, peak_indices(c, n), distance), lambda i: u_of(i, n).between(*INTERIOR))
    rows = df.withColumn("__kept", kept).withColumn(
        "peak_index", F.explode(F.filter(peak_indices(c, n), lambda i: u_of(i, n).between(low, high)))
    )
    i = F.col("peak_index")
    rivals = F.filter("__kept", lambda k: (k != i) & (F.abs(k - i) < distance) & (F.get(c, k) >= F.get(c, i)))
    top = F.array_max(F.transform(rivals, lambda k: F.struct(F.get(c, k).alias("h"), (-k).alias("neg"))))
    rows = rows.withColumn("retained", F.array_contains("__kept", i)).withColumn("__s", top)
    lost = ~F.col("retained")
    return rows.select(
        *keys,
        "peak_index",
        F.get(c, i).alias("height"),
        "retained",
        F.when(lost, -F.col("__s.neg")).alias("suppressor_index"),
        F.when(lost, F.col("__s.h")).alias("suppressor_height"),
        F.when(lost, F.abs(-F.col("__s.neg") - i)).alias("suppressor_distance"),
    )


def quarter_turn_distance(a: Column, b: Column) -> Column:
    """RMS distance of two eight-sided shapes, smallest over the four quarter turns."""
    def rms(turn: int) -> Column:
        rolled = F.concat(F.slice(b, 9 - 2 * turn, 2 * turn), F.slice(b, 1, 8 - 2 * turn)) if turn else b
        return F.sqrt(array_sum(F.zip_with(a, rolled, lambda x, y: (x - y) * (x - y))) / 8)

    return F.least(*[rms(t) for t in range(4)])


def _medians_to_others():
    """Per view of a set of eight-sided shapes the median distance to the views of another place; null for a null set."""

    def one(place, shapes):
        place, x = np.asarray(place), np.array([np.asarray(v, float) for v in shapes])
        turned = [np.roll(x, 2 * t, axis=1) for t in range(4)]
        out = []
        for i, a in enumerate(x):
            sums = []
            for b in turned:
                s = np.zeros(len(x))
                for side in range(8):  # in the order of `quarter_turn_distance`
                    s += (a[side] - b[:, side]) * (a[side] - b[:, side])
                sums.append(np.sqrt(s / 8))
            d = np.sort(np.min(sums, axis=0)[place != place[i]])
            at = (len(d) - 1) * 0.5
            lo = int(at)
            out.append(d[lo] + (d[int(np.ceil(at))] - d[lo]) * (at - lo) if len(d) else None)
        return out

    def many(place: pd.Series, shapes: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else one(p, s) for p, s in zip(place, shapes)], dtype=object)

    return F.pandas_udf(many, "array<double>")


def medoid_consensus(
    shapes: DataFrame, keys: list[str], ident: str, score: str, floor: float, multiplier: float, top: int, minimum: int = 3,
    error: str | None = None, quality: str | None = None, rank: str | None = None,
) -> DataFrame:
    """Medoid by median pairwise distance, outlier threshold, then the ranked core; one row per view.

    The core is taken by highest score, lowest face-on `error`, highest `quality`, distance to the medoid, lowest `rank`,
    and identifier; the last four are optional columns. A set of fewer than `minimum` views has no medoid, and all
    its views are unavailable. The candidate shapes of one series are a short list (a bounded selection of views):
    they form one array and the distances are row expressions, so no shape pairs travel.
    """
    extra = [
        F.coalesce(F.col(error).cast("double"), F.lit(float("inf"))) if error else F.lit(0.0),
        -F.coalesce(F.col(quality).cast("double"), F.lit(0.0)) if quality else F.lit(0.0),
        F.coalesce(F.col(rank).cast("long"), F.lit(10**9)) if rank else F.lit(0),
    ]
    order = [(-F.col(score)).alias("n"), *[c.alias(n) for c, n in zip(extra, ("error", "quality", "rank"))]]
    cell = F.struct(F.col(ident).alias("id"), *order, F.col("shape").alias("shape"))
    every = shapes.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("__set"))
    few = every.where(F.size("__set") < minimum).select(*keys, F.explode("__set.id").alias(ident))
    sets = every.where(F.size("__set") >= minimum)
    sets = sets.withColumn("__ids", F.col("__set.id")).withColumn("__place", F.transform("__ids", lambda i: F.array_position("__ids", i)))
    plain = F.forall("__set.shape", lambda v: F.coalesce((F.size(v) == 8) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    others = lambda a: F.filter("__set", lambda b: b["id"] != a["id"])
    odd = F.transform("__set", lambda a: array_median(F.transform(others(a), lambda b: quarter_turn_distance(a["shape"], b["shape"]))))
    shapes_of = F.when(plain, F.transform("__set", lambda a: F.transform(a["shape"], lambda x: x.cast("double"))))
    sets = sets.withColumn("__plain", _medians_to_others()("__place", shapes_of)).withColumn("__medians", F.coalesce("__plain", odd))
    named = F.zip_with("__medians", "__set", lambda m, a: F.struct(F.round(m, 12).alias("m"), a["id"].alias("id"), a["shape"].alias("shape")))
    sets = sets.withColumn("medoid", F.array_min(named))
    sets = sets.withColumn("__far", F.transform("__set", lambda a: quarter_turn_distance(a["shape"], F.col("medoid.shape"))))
    sets = sets.withColumn(
        "__dist",
        F.zip_with("__set", "__far", lambda a, d: F.struct(*[a[c].alias(c) for c in ("n", "error", "quality")], F.round(d, 12).alias("d"), a["rank"].alias("rank"), a["id"].alias("id"), d.alias("distance"))),
    )
    dist = F.transform("__dist", lambda x: x["distance"])
    sets = sets.withColumn("__med", array_median(dist)).withColumn("__mad", array_median(F.transform(dist, lambda v: F.abs(v - F.col("__med")))))
    limit = F.greatest(F.lit(floor), F.col("__med") + multiplier * F.greatest(1.4826 * F.col("__mad"), F.lit(1e-6)))
    sets = sets.withColumn("threshold", limit)
    pool = F.array_sort(F.filter("__dist", lambda x: x["distance"] <= F.col("threshold")))
    chosen = F.transform(F.slice(pool, 1, top), lambda x: x["id"])
    rows = sets.withColumn("__chosen", chosen).select(*keys, "medoid.id", "threshold", "__chosen", F.explode("__dist").alias("x"))
    selected, out = F.array_contains("__chosen", F.col("x.id")), F.col("x.distance") > F.col("threshold")
    rows = rows.select(
        *keys, F.col("id").alias("medoid"), F.col("x.id").alias(ident), F.col("x.distance").alias("distance"), "threshold",
        F.when(selected, "selected").when(out, "rejected").otherwise("not_selected").alias("status"),
        F.when(selected, "").when(out, "outer_octagon_consensus_outlier").otherwise("outside_face_on_outer_core").alias("reason"),
    )
    few = few.withColumns({"status": F.lit("unavailable"), "reason": F.lit("insufficient_compatible_outer_views")})
    return rows.unionByName(few, allowMissingColumns=True)
