"""Sector contrast, zones, frame-pair cells and patch matching.

All groups are parts of a single frame or frame pair (sectors, zones, cells), so their
size is bounded by the canvas; series-level summaries are aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import MAD_SCALE, ratio
from gyre.functions.ranking import bounded_quantile
from gyre.operators.pixels import dilated, eroded, supported

FRAME = ["series_id", "position"]

# Tile categories, ordering states and the gates of the patch comparison.
TILE_STATES = (
    "unavailable",
    "ambiguous",
    "search_window_limited",
    "no_common_reference",
    "shared_image_shift",
    "local_residual_shift",
)
ORDERINGS = (
    "monotonic_light_to_dark_outward",
    "monotonic_dark_to_light_outward",
    "inner_local_minimum",
    "inner_local_maximum",
    "tied",
)
MIN_PEAK_NCC = 0.25
MIN_PEAK_MARGIN = 0.035
MIN_COMMON_TILES = 8
RESIDUAL_TOLERANCE = 1.5
DARK_RATIO, BRIGHT_RATIO = 0.70, 1.30


def sector_medians(px: DataFrame, sector: str, band: str) -> DataFrame:
    return px.where(F.col("observed") & supported()).groupBy(*FRAME, sector, band).agg(F.median("brightness").alias("median"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Spread over a frame's sectors: quartiles, q90, IQR and the plain MAD."""
    q = df.groupBy(*keys).agg(
        F.count(value).alias("finite_sectors"),
        *[bounded_quantile(value, p).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9))],
    )
    mad = df.join(q.select(*keys, "q50"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("q50"))).alias("mad"))
    return q.join(mad, keys).withColumn("iqr", F.col("q75") - F.col("q25"))


def sector_contrast(medians: DataFrame, sector: str, band: str, inner: str, outer: str) -> DataFrame:
    """Signed and absolute log contrast of two bands, per frame and sector."""
    side = lambda name, to: medians.where((F.col(band) == name) & (F.col("median") > 0)).select(
        *FRAME, sector, F.ln("median").alias(to)
    )
    both = side(inner, "__in").join(side(outer, "__out"), FRAME + [sector])
    signed = F.col("__in") - F.col("__out")
    return both.select(*FRAME, sector, signed.alias("signed"), F.abs(signed).alias("separation"))


def contrast_frames(contrast: DataFrame, sector: str) -> DataFrame:
    """Distribution of the separation per frame and its strongest sector (larger name on ties)."""
    top = contrast.groupBy(*FRAME).agg(F.max(F.struct("separation", sector)).alias("t"))
    return distribution(contrast, FRAME, "separation").join(top, FRAME).select(
        *FRAME, "finite_sectors", "q25", "q50", "q75", "q90", "iqr", "mad",
        F.col(f"t.{sector}").alias("strongest_sector"),
        F.col("t.separation").alias("strongest_separation"),
    )


def multiscale(scales: DataFrame, sector: str) -> DataFrame:
    """Per frame and sector: median over scales and range where at least two scales exist."""
    return scales.groupBy(*FRAME, sector).agg(
        F.median("separation").alias("separation"),
        F.median("signed").alias("signed"),
        F.when(F.count("separation") >= 2, F.max("separation") - F.min("separation")).alias("scale_spread"),
    )


def ordering_state(first: Column, second: Column) -> Column:
    return (
        F.when(first.isNull() | second.isNull(), None)
        .when((first == 0) | (second == 0), "tied")
        .when((first > 0) & (second > 0), ORDERINGS[0])
        .when((first < 0) & (second < 0), ORDERINGS[1])
        .when(first > 0, ORDERINGS[2])
        .otherwise(ORDERINGS[3])
    )


def joint_nested(first: DataFrame, second: DataFrame, sector: str) -> DataFrame:
    """Weakest link of two nested contrasts per frame, penalty, coverage gap, state shares."""
    a = first.select(*FRAME, sector, F.col("separation").alias("sa"), F.col("signed").alias("ga"))
    b = second.select(*FRAME, sector, F.col("separation").alias("sb"), F.col("signed").alias("gb"))
    rows = a.join(b, FRAME + [sector], "full").select(
        *FRAME,
        sector,
        "sa",
        "sb",
        F.when(F.col("sa").isNotNull() & F.col("sb").isNotNull(), F.least("sa", "sb")).alias("joint"),
        ordering_state(F.col("ga"), F.col("gb")).alias("state"),
    )
    out = rows.groupBy(*FRAME).agg(
        F.count("joint").alias("finite_sectors"),
        bounded_quantile("joint", 0.25).alias("q25"),
        F.median("joint").alias("q50"),
        F.median("sa").alias("first_median"),
        F.median("sb").alias("second_median"),
        *[ratio(F.count_if(F.col("state") == s), F.count("state")).alias(f"share_{s}") for s in ORDERINGS],
    )
    weakest = F.when(F.col("first_median").isNotNull() & F.col("second_median").isNotNull(), F.least("first_median", "second_median"))
    return out.withColumn("pairwise_weakest", weakest).withColumn(
        "joint_penalty", F.col("pairwise_weakest") - F.col("q50")
    ).withColumn("coverage_gap", F.col("q50") - F.col("q25"))


def fractional_spread(df: DataFrame, keys: list[str], value: str = "brightness") -> DataFrame:
    """Scaled MAD over median of a bounded group; null below three samples or a non-positive median."""
    med = df.groupBy(*keys).agg(F.median(value).alias("__m"), F.count(value).alias("__n"))
    return (
        df.join(med, keys)
        .groupBy(*keys)
        .agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("__d"), F.max("__m").alias("__m"), F.max("__n").alias("samples"))
        .select(
            *keys,
            "samples",
            F.when((F.col("samples") >= 3) & (F.col("__m") > 0), MAD_SCALE * F.col("__d") / F.col("__m")).alias("spread"),
        )
    )


def standardised(separation: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """Separation over the RMS of two spreads, and its status."""
    scale = F.sqrt((left * left + right * right) / 2.0)
    gap = separation.isNull() | left.isNull() | right.isNull()
    status = F.when(gap, "gap").when(scale <= 0, "zero_spread_scale").otherwise("ok")
    return F.when(~gap & (scale > 0), separation / scale), status


def strip_trace(px: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Per frame: median on the strip's own valid pixels and its support; per series minima."""
    rows = px.where(F.col(side).isNotNull() & F.col("in_mask"))
    ok = F.col("observed") & supported()
    frames = rows.groupBy(*FRAME, side).agg(
        F.median(F.when(ok, F.col("brightness"))).alias("value"),
        F.when(F.bool_and("observed"), F.count_if(ok)).alias("support_pixels"),
        F.when(F.bool_and("observed"), ratio(F.count_if(ok), F.count(F.lit(1)))).alias("support_fraction"),
    )
    series = frames.groupBy("series_id", side).agg(
        F.min("support_pixels").alias("min_support_pixels"), F.min("support_fraction").alias("min_support_fraction"),
        F.count("value").alias("frames"),
    )
    return frames, series


def tier_profile(frames: DataFrame) -> DataFrame:
    """Medians over a window's frames of each sector statistic, and the widest median - q25 gap."""
    gap = F.col("q50") - F.col("q25")
    best = F.max(F.when(gap.isNotNull(), F.struct(gap.alias("g"), (-F.col("position")).alias("n"))))
    return frames.groupBy("series_id").agg(
        *[F.median(c).alias(f"{c}_frame_q50") for c in ("q25", "q50", "q75", "q90", "iqr", "mad")], best.alias("b")
    ).select(
        "series_id",
        *[f"{c}_frame_q50" for c in ("q25", "q50", "q75", "q90", "iqr", "mad")],
        F.col("b.g").alias("max_coverage_gap"),
        (-F.col("b.n")).alias("max_coverage_gap_position"),
    )


def midrank_percentile(df: DataFrame, keys: list[str], value: str, name: str = "percentile") -> DataFrame:
    """(below + up to) / (2n) of each value among its frame's pixels."""
    w = Window.partitionBy(*keys)
    below = F.rank().over(w.orderBy(value)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, (2 * below + ties) / (2.0 * F.count(F.lit(1)).over(w)))


def zone_brightness(px: DataFrame, zones: Column, status: Column, confidence: Column) -> DataFrame:
    """Mean over overlapping zones; a zone whose status is unavailable keeps no pixels."""
    rows = px.withColumn("zone", F.explode(zones)).withColumn("zone_status", status).withColumn("confidence", confidence)
    use = F.col("valid") & F.col("in_mask") & (F.col("zone_status") != "unavailable")
    return rows.groupBy(*FRAME, "zone").agg(
        F.first("zone_status").alias("zone_status"),
        F.first("confidence").alias("confidence"),
        F.count_if(use).alias("pixels"),
        F.avg(F.when(use, F.col("brightness"))).alias("mean"),
    )


def zone_sensitivity(px: DataFrame, zone: Column) -> DataFrame:
    """Mean percentile of a zone against its eroded (1, 2) and dilated (1) variants."""
    active = midrank_percentile(px.where(F.col("observed") & supported()), FRAME, "brightness")
    spread = active.groupBy(*FRAME).agg(
        F.median("brightness").alias("med"),
        (bounded_quantile("brightness", 0.75) - bounded_quantile("brightness", 0.25)).alias("iqr"),
    )
    base = px.where(F.col("observed") & zone).select(*FRAME, "y", "x")
    once = eroded(base, FRAME, 4)
    variants = (
        base.withColumn("variant", F.lit("baseline"))
        .unionByName(once.withColumn("variant", F.lit("inset_1")))
        .unionByName(eroded(once, FRAME, 4).withColumn("variant", F.lit("inset_2")))
        .unionByName(dilated(base, FRAME, 4).withColumn("variant", F.lit("outset_1")))
    )
    means = (
        variants.join(active.select(*FRAME, "y", "x", "brightness", "percentile"), FRAME + ["y", "x"])
        .groupBy(*FRAME)
        .pivot("variant", ["baseline", "inset_1", "inset_2", "outset_1"])
        .agg(F.avg("percentile").alias("p"), F.avg("brightness").alias("v"))
    )
    wide = means.join(spread, FRAME)
    return wide.select(
        *FRAME,
        F.col("baseline_p").alias("baseline_percentile"),
        F.col("baseline_v").alias("baseline_mean"),
        *[(F.col(f"{v}_p") - F.col("baseline_p")).alias(f"delta_{v}") for v in ("inset_1", "inset_2", "outset_1")],
        F.when(F.col("iqr") > 1e-12, (F.col("baseline_v") - F.col("med")) / F.col("iqr")).alias("centred_over_iqr"),
    )


def zone_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity over its frames: ranges of the baseline and size of each variant's deviation."""
    spread = lambda c: F.max(c) - F.min(c)
    return frames.groupBy(*keys).agg(
        F.count("baseline_mean").alias("valid_frames"),
        spread("baseline_mean").alias("mean_range"),
        spread("baseline_percentile").alias("percentile_range"),
        *[
            f
            for v in ("inset_1", "inset_2", "outset_1")
            for f in (
                F.count(f"delta_{v}").alias(f"comparable_{v}"),
                F.median(F.abs(f"delta_{v}")).alias(f"median_abs_{v}"),
                F.max(F.abs(f"delta_{v}")).alias(f"max_abs_{v}"),
            )
        ],
    )


def frame_pairs(px: DataFrame, cols: list[str], period: int | None = None) -> DataFrame:
    """Each pixel with the same pixel of the following frame: an equi-join on pixel and position."""
    after = F.col("position") - 1 if period is None else F.pmod(F.col("position") - 1, F.lit(period))
    nxt = px.select("series_id", after.alias("position"), "y", "x", *[F.col(c).alias(f"next_{c}") for c in cols])
    return px.join(nxt, FRAME + ["y", "x"])


def grid_cell(axis: str, low: Column, high: Column, grid: int) -> Column:
    """Cell of an integer coordinate when [low, high] is cut at floor(width * c / grid)."""
    width = high - low + 1
    return (F.ceil((F.col(axis) - low + 1) * grid / width) - 1).cast("int")


def grid_transition(px: DataFrame, grid: int, minimum: int) -> DataFrame:
    """Per frame pair and grid cell: dark / bright occupancy, switches and gain-normalised change."""
    pairs = frame_pairs(px.where("observed"), ["brightness", "valid", "in_mask"]).where(
        "valid and in_mask and next_valid and next_in_mask"
    )
    frame = pairs.groupBy(*FRAME).agg(
        F.median("brightness").alias("ga"),
        F.median("next_brightness").alias("gb"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
    )
    a, b = F.col("brightness") / F.col("ga"), F.col("next_brightness") / F.col("gb")
    rows = pairs.join(frame, FRAME).select(
        *FRAME,
        grid_cell("y", F.col("y0"), F.col("y1"), grid).alias("row"),
        grid_cell("x", F.col("x0"), F.col("x1"), grid).alias("col"),
        (a < DARK_RATIO).alias("da"),
        (b < DARK_RATIO).alias("db"),
        (a > BRIGHT_RATIO).alias("ba"),
        (b > BRIGHT_RATIO).alias("bb"),
        (b - a).alias("d"),
    )
    share = lambda c: F.avg(c.cast("double"))
    da, db, ba, bb = (F.col(c) for c in ("da", "db", "ba", "bb"))
    cells = rows.groupBy(*FRAME, "row", "col").agg(
        F.count(F.lit(1)).alias("pixels"),
        share(da).alias("dark_before"),
        share(db).alias("dark_after"),
        share(ba).alias("bright_before"),
        share(bb).alias("bright_after"),
        share(da != db).alias("dark_switch"),
        share(ba != bb).alias("bright_switch"),
        share(da & bb).alias("dark_to_bright"),
        share(ba & db).alias("bright_to_dark"),
        F.median("d").alias("median_signed_change"),
        F.median(F.abs("d")).alias("median_abs_change"),
        bounded_quantile(F.abs("d"), 0.9).alias("p90_abs_change"),
    )
    measured = [c for c in cells.columns if c not in (*FRAME, "row", "col", "pixels")]
    enough = F.col("pixels") >= minimum
    return cells.select(
        *FRAME, "row", "col", "pixels",
        F.when(enough, "observed").otherwise("unavailable").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in measured],
    )


def mask_iou(px: DataFrame, mask: Column) -> DataFrame:
    """Intersection over union of a mask in neighbouring frames."""
    pairs = frame_pairs(px.where("observed").withColumn("m", mask), ["m"])
    both, either = F.count_if(F.col("m") & F.col("next_m")), F.count_if(F.col("m") | F.col("next_m"))
    return pairs.groupBy(*FRAME).agg(
        both.alias("intersection"), either.alias("union_pixels"), (both / F.greatest(either, F.lit(1))).alias("iou")
    )


def blockiness(px: DataFrame, block: int, value: str = "brightness", keys: list[str] = FRAME) -> DataFrame:
    """Median absolute step at block boundaries over the median elsewhere, both directions."""
    across = Window.partitionBy(*keys, "y").orderBy("x")
    down = Window.partitionBy(*keys, "x").orderBy("y")
    near = px.withColumn("__right", F.lead(value).over(across)).withColumn("__down", F.lead(value).over(down))
    step = lambda axis, to: F.struct(
        (F.col(axis) % block == block - 1).alias("edge"), F.abs(F.col(to) - F.col(value)).alias("s")
    )
    steps = near.select(
        *keys, F.explode(F.array(step("x", "__right"), step("y", "__down"))).alias("z")
    ).where("z.s is not null")
    return steps.groupBy(*keys).agg(
        (F.median(F.when(F.col("z.edge"), F.col("z.s"))) / F.greatest(F.median(F.when(~F.col("z.edge"), F.col("z.s"))), F.lit(1e-6))).alias("blockiness")
    )


def clipping(rgb: DataFrame, keys: list[str], channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Share of channel values at most 1 or at least 254, and the largest share."""
    low = {c: F.avg((F.col(c) <= 1).cast("double")) for c in channels}
    high = {c: F.avg((F.col(c) >= 254).cast("double")) for c in channels}
    return rgb.groupBy(*keys).agg(
        *[v.alias(f"low_{c}") for c, v in low.items()],
        *[v.alias(f"high_{c}") for c, v in high.items()],
        F.greatest(*low.values(), *high.values()).alias("max_channel_fraction"),
    )


def background_reference(rgb: DataFrame, mask: DataFrame, keys: list[str], dilations: int, min_share: float, min_pixels: int) -> DataFrame:
    """Median colour outside the dilated mask; null with a status where too little is background."""
    grown = mask
    for _ in range(dilations):
        grown = dilated(grown, keys, 4)
    total = rgb.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    back = rgb.join(grown, keys + ["y", "x"], "left_anti").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("background_pixels"), *[F.median(c).alias(f"median_{c}") for c in ("r", "g", "b")]
    )
    rows = total.join(back, keys, "left").withColumn("background_pixels", F.coalesce("background_pixels", F.lit(0)))
    rows = rows.withColumn("background_fraction", ratio("background_pixels", "__all"))
    enough = (F.col("background_fraction") >= min_share) & (F.col("background_pixels") >= min_pixels)
    return rows.select(
        *keys,
        "background_pixels",
        *[F.when(enough, F.col(f"median_{c}")).alias(f"median_{c}") for c in ("r", "g", "b")],
        "background_fraction",
        F.when(enough, "ok").otherwise("too_little_background").alias("status"),
    )


def patch_shift(px: DataFrame, grid: int, max_shift: int, minimum: int, min_std: float, texture: str = "brightness") -> DataFrame:
    """Best displacement of each grid patch between neighbouring frames by correlation.

    Both frames are read inside their common mask: the pixels that are valid in the one and in the other,
    which also give the patches their box. Each reference pixel is sent to its (2s+1)^2 displaced partners in the next frame by an
    equi-join on the shifted coordinates; correlations are plain moment sums per
    (patch, displacement). The offset table is a literal array of fixed size.
    """
    rows = px.where("observed").withColumn("ok", F.col("valid") & F.col("in_mask"))
    here = rows.where("ok").select(*FRAME, "y", "x", F.col(texture).alias("a"))
    there = rows.where("ok").select("series_id", (F.col("position") - 1).alias("position"), "y", "x", F.col(texture).alias("b"))
    common = here.join(there, [*FRAME, "y", "x"])
    box = common.groupBy(*FRAME).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    frame_box = px.groupBy(*FRAME).agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    offsets = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
            for dy in range(-max_shift, max_shift + 1)
            for dx in range(-max_shift, max_shift + 1)
        ]
    )
    ref = (
        common.join(box, FRAME)
        .join(frame_box, FRAME)
        .select(
            *FRAME,
            "y",
            "x",
            grid_cell("y", F.col("y0"), F.col("y1"), grid).alias("row"),
            grid_cell("x", F.col("x0"), F.col("x1"), grid).alias("col"),
            "a",
            "x0", "x1", "y0", "y1", "__h", "__w",
            F.explode(offsets).alias("o"),
        )
    )
    cut = lambda lo, hi, c: F.col(lo) + F.floor((F.col(hi) - F.col(lo) + 1) * c / grid)
    fits = (
        (cut("y0", "y1", F.col("row")) + F.col("o.dy") >= 0)
        & (cut("x0", "x1", F.col("col")) + F.col("o.dx") >= 0)
        & (cut("y0", "y1", F.col("row") + 1) + F.col("o.dy") <= F.col("__h") + 1)
        & (cut("x0", "x1", F.col("col") + 1) + F.col("o.dx") <= F.col("__w") + 1)
    )
    target = common.select(*FRAME, F.col("y").alias("ty"), F.col("x").alias("tx"), "b")
    moved = ref.where(fits).select(
        *FRAME, "row", "col", "a", F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx"),
        (F.col("y") + F.col("o.dy")).alias("ty"), (F.col("x") + F.col("o.dx")).alias("tx"),
    )
    a, b, n = F.col("a"), F.col("b"), F.count(F.lit(1))
    scored = (
        moved.join(target, FRAME + ["ty", "tx"])
        .groupBy(*FRAME, "row", "col", "dy", "dx")
        .agg(n.alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("c"))
        .where((F.col("n") >= minimum) & (F.col("sa") >= min_std) & (F.col("sb") >= min_std))
        .withColumn("ncc", F.round(F.col("c") / (F.col("sa") * F.col("sb")), 9))
    )
    w = Window.partitionBy(*FRAME, "row", "col").orderBy(F.col("ncc").desc(), F.col("dy").desc(), F.col("dx").desc())
    ranked = scored.withColumn("k", F.row_number().over(w))
    best = ranked.where("k = 1").select(
        *FRAME, "row", "col", F.col("ncc").alias("best_ncc"), F.col("dy").alias("bdy"), F.col("dx").alias("bdx"), F.col("n").alias("overlap_pixels")
    )
    rest = ranked.where("k > 1").join(best, FRAME + ["row", "col"])
    far = F.pow(F.col("dy") - F.col("bdy"), 2) + F.pow(F.col("dx") - F.col("bdx"), 2) >= 4
    second = rest.groupBy(*FRAME, "row", "col").agg(
        F.coalesce(F.max(F.when(far, F.col("ncc"))), F.max("ncc")).alias("second")
    )
    zero = scored.where("dy = 0 and dx = 0").select(*FRAME, "row", "col", F.col("ncc").alias("zero_shift_ncc"))
    cells = common.join(box, FRAME).select(
        *FRAME,
        grid_cell("y", F.col("y0"), F.col("y1"), grid).alias("row"),
        grid_cell("x", F.col("x0"), F.col("x1"), grid).alias("col"),
    ).distinct()
    out = cells
    for part in (best, second, zero):
        out = out.join(part, FRAME + ["row", "col"], "left")
    margin = F.coalesce(F.col("best_ncc") - F.col("second"), F.lit(1.0))
    measured = (F.col("best_ncc") >= MIN_PEAK_NCC) & (margin >= MIN_PEAK_MARGIN)
    status = F.when(F.col("best_ncc").isNull(), "unavailable").when(measured, "measured").otherwise("ambiguous")
    return out.select(
        *FRAME, "row", "col",
        status.alias("status"),
        F.when(measured, F.col("bdx")).alias("dx"),
        F.when(measured, F.col("bdy")).alias("dy"),
        "best_ncc",
        "zero_shift_ncc",
        F.when(F.col("best_ncc").isNotNull(), margin).alias("margin"),
        "overlap_pixels",
    )


def classify_tiles(tiles: DataFrame, max_shift: int, minimum: int = MIN_COMMON_TILES, tolerance: float = RESIDUAL_TOLERANCE) -> DataFrame:
    """Tile status against the pair's median unclipped shift."""
    inside = (F.abs("dx") < max_shift) & (F.abs("dy") < max_shift)
    free = F.col("status") == "measured"
    ref = tiles.groupBy(*FRAME).agg(
        F.count_if(free & inside).alias("__n"),
        F.median(F.when(free & inside, F.col("dx"))).alias("__rx"),
        F.median(F.when(free & inside, F.col("dy"))).alias("__ry"),
    )
    rows = tiles.join(ref, FRAME)
    residual = F.sqrt(F.pow(F.col("dx") - F.col("__rx"), 2) + F.pow(F.col("dy") - F.col("__ry"), 2))
    have = F.col("__n") >= minimum
    tile = (
        F.when(F.col("status") != "measured", F.col("status"))
        .when(~inside, "search_window_limited")
        .when(~have, "no_common_reference")
        .when(residual > tolerance, "local_residual_shift")
        .otherwise("shared_image_shift")
    )
    return rows.select(
        *FRAME, "row", "col", tile.alias("tile_status"),
        F.when(free & inside & have, residual).alias("residual"),
        F.when(have, F.col("__rx")).alias("reference_dx"),
        F.when(have, F.col("__ry")).alias("reference_dy"),
    )


def pair_audit(tiles: DataFrame, count: int) -> DataFrame:
    """Matched / ambiguous / unavailable shares, most frequent shift and its coherence."""
    parts = tiles.groupBy(*FRAME).agg(
        *[(F.count_if(F.col("status") == s) / F.lit(count)).alias(f"{s}_fraction") for s in ("measured", "ambiguous", "unavailable")],
        F.count_if(F.col("status") == "measured").alias("__m"),
    )
    modes = tiles.where("status = 'measured'").groupBy(*FRAME, "dx", "dy").agg(F.count(F.lit(1)).alias("c"))
    modal = modes.groupBy(*FRAME).agg(F.max(F.struct("c", (-F.col("dx")).alias("nx"), (-F.col("dy")).alias("ny"))).alias("t"))
    certainty = F.col("measured_fraction")
    return parts.join(modal, FRAME, "left").select(
        *FRAME, "measured_fraction", "ambiguous_fraction", "unavailable_fraction",
        (-F.col("t.nx")).alias("modal_dx"), (-F.col("t.ny")).alias("modal_dy"),
        ratio("t.c", "__m").alias("coherence"),
        F.when(certainty < 0.50, "low").when(certainty >= 0.75, "high").otherwise("intermediate").alias("match_class"),
    )


def tile_status_map(classified: DataFrame) -> DataFrame:
    """Counts per grid cell and status, with the published fractions."""
    wide = classified.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("observations"), *[F.count_if(F.col("tile_status") == s).alias(s) for s in TILE_STATES]
    )
    valid = F.col("local_residual_shift") + F.col("shared_image_shift")
    unresolved = F.col("unavailable") + F.col("ambiguous") + F.col("no_common_reference")
    return wide.select(
        "*",
        ratio("local_residual_shift", valid).alias("local_fraction"),
        ratio("search_window_limited", "observations").alias("limited_fraction"),
        ratio(unresolved, "observations").alias("unresolved_fraction"),
    )


def overlap_bins(pairs: DataFrame, keys: list[str], low: float = 0.95, high: float = 0.98) -> DataFrame:
    """Class by overlap, medians per class and the low - high contrast (a window's pairs)."""
    cls = F.when(F.col("iou") < low, "low").when(F.col("iou") >= high, "high").otherwise("intermediate")
    rows = pairs.withColumn("__c", cls)
    med = lambda c: F.median(F.when(F.col("__c") == c, F.col("change")))
    return rows.groupBy(*keys).agg(
        *[F.count_if(F.col("__c") == c).alias(f"{c}_pairs") for c in ("low", "intermediate", "high")],
        *[med(c).alias(f"{c}_change") for c in ("low", "intermediate", "high")],
        (med("low") - med("high")).alias("low_minus_high"),
    )
