"""Aggregated traces of pixel tables and their summaries.

Groups are a frame, a frame's region, or a frame's cell: bounded by the canvas. Summaries
over a series use `quantiles` (safe for any series length) unless the caller states that the
series is a bounded window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import MAD_SCALE, log_positive, positive, ratio
from gyre.functions.ranking import bounded_quantile, quantiles, quantiles_of_ranked, ranked_values, value_table
from gyre.operators.pixels import bright_scale, centroid_sectors, edge_of, relative_bright, relative_dark, supported
from gyre.operators.support import fixed_support

SERIES = ["series_id"]
FRAME = ["series_id", "position"]
PIXEL = ["series_id", "y", "x"]
OCTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def on_support(px: DataFrame, frames: DataFrame, mode: str, extra: list[str] | None = None) -> DataFrame:
    """Observed pixel rows inside the fixed or the per-frame (dynamic) support."""
    rows = px.where(F.col("observed") & supported())
    if mode == "dynamic":
        return rows
    if mode != "fixed":
        raise ValueError('support mode must be "fixed" or "dynamic"')
    return rows.join(fixed_support(px, frames, SERIES, extra), SERIES + ["y", "x"] + (extra or []), "left_semi")


def whole_trace(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame median on the fixed support, null for unobserved frames, and support counts."""
    g = on_support(px, frames, "fixed").groupBy(*FRAME).agg(
        F.median("brightness").alias("whole"), F.count(F.lit(1)).alias("fixed_pixels")
    )
    dynamic = px.where("observed").groupBy(*FRAME).agg(
        ratio(F.count_if(supported()), F.count_if("in_mask")).alias("support_fraction")
    )
    return frames.select(*FRAME, "observed").join(g, FRAME, "left").join(dynamic, FRAME, "left")


def with_whole(px: DataFrame, whole: DataFrame) -> DataFrame:
    return px.join(whole.select(*FRAME, "whole"), FRAME, "left")


def regional_trace(px: DataFrame, frames: DataFrame, region: str, mode: str) -> DataFrame:
    """Regional median and its log ratio to the whole-frame median."""
    whole = whole_trace(px, frames)
    med = on_support(px, frames, mode, [region]).groupBy(*FRAME, region).agg(
        F.median("brightness").alias("raw"), F.count(F.lit(1)).alias("pixels")
    )
    return med.join(whole.select(*FRAME, "whole"), FRAME, "left").withColumn(
        "relative", log_positive("raw") - log_positive("whole")
    )


def trace_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """q10/q50/q90, excursions and scaled MAD of a trace; fewer than three values is unavailable."""
    have = df.groupBy(*keys).agg(F.count(value).alias("finite"))
    q = quantiles(df, keys, value, OCTILES).drop("n")
    counts = value_table(df, keys, value).join(q, keys).withColumn("__dev", F.abs(F.col(value) - F.col("q50")))
    # Deviations keep their multiplicity: equal values stay collapsed.
    merged = counts.groupBy(*keys, "__dev").agg(F.sum("cnt").alias("cnt"))
    mad = quantiles_of_ranked(ranked_values(merged, keys, "__dev"), keys, "__dev", {"mad": 0.5}).drop("n")
    out = have.join(q, keys, "left").join(mad, keys, "left")
    ok = F.col("finite") >= 3
    keep = lambda c: F.when(ok, c)
    return out.select(
        *keys,
        "finite",
        F.when(ok, "ok").otherwise("unavailable").alias("status"),
        *[keep(F.col(c)).alias(c) for c in OCTILES],
        keep(F.col("q90") - F.col("q50")).alias("bright_excursion"),
        keep(F.col("q50") - F.col("q10")).alias("dark_excursion"),
        keep(F.col("q90") - F.col("q10")).alias("total_excursion"),
        keep(F.col("mad") * MAD_SCALE).alias("mad_scale"),
    )


def occupancy_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median and quantiles; one finite value is enough."""
    have = df.groupBy(*keys).agg(F.count(value).alias("finite"), F.avg(value).alias("mean"))
    q = quantiles(df, keys, value, OCTILES).drop("n")
    return have.join(q, keys, "left").withColumn("median", F.col("q50")).withColumn(
        "status", F.when(F.col("finite") > 0, "ok").otherwise("unavailable")
    )


def occupancy_trace(px: DataFrame, frames: DataFrame, region: str, mode: str, threshold: Column | float) -> DataFrame:
    """Dark pixels over supported pixels per frame and region."""
    whole = whole_trace(px, frames)
    rows = with_whole(on_support(px, frames, mode, [region]), whole)
    dark = F.col("brightness") < threshold * positive("whole")
    extra = ["threshold_key"] if "threshold_key" in px.columns else []
    return rows.groupBy(*FRAME, region, *extra).agg(
        F.count(F.lit(1)).alias("supported_pixels"),
        F.when(F.count(dark) > 0, F.count_if(dark)).alias("dark_pixels"),
        F.when(F.count(dark) > 0, ratio(F.count_if(dark), F.count(F.lit(1)))).alias("dark_fraction"),
    )


def dark_pixels(px: DataFrame, frames: DataFrame, threshold: float, mode: str = "fixed") -> DataFrame:
    """Supported observed pixels with their relative-dark state."""
    rows = with_whole(on_support(px, frames, mode), whole_trace(px, frames))
    return rows.withColumn("dark", relative_dark(F.col("brightness"), F.col("whole"), threshold))


def region_measure(px: DataFrame, frames: DataFrame, region: str, threshold: float = 0.65) -> DataFrame:
    """One pass per series and region: amplitude, range, dark fraction, state transitions."""
    rows = dark_pixels(px, frames, threshold)
    per_frame = rows.groupBy(*FRAME, region).agg(
        F.median("brightness").alias("median"),
        F.avg(F.col("dark").cast("double")).alias("dark_fraction"),
        F.max("whole").alias("whole"),
        F.count(F.lit(1)).alias("pixels"),
    ).withColumn("state", F.col("median") < threshold * F.col("whole"))
    # A series window holds at most its frame count of rows per region.
    w = Window.partitionBy("series_id", region).orderBy("position")
    near = per_frame.withColumn(
        "flip",
        F.when(F.lag("position").over(w) == F.col("position") - 1, (F.lag("state").over(w) != F.col("state")).cast("int")),
    )
    return near.groupBy("series_id", region).agg(
        F.max("pixels").alias("support_pixels"),
        (bounded_quantile("median", 0.9) - bounded_quantile("median", 0.1)).alias("amplitude"),
        F.min("median").alias("lowest"),
        F.max("median").alias("highest"),
        F.avg("dark_fraction").alias("mean_dark_fraction"),
        F.avg(F.col("state").cast("double")).alias("dark_occupancy"),
        F.coalesce(F.sum("flip"), F.lit(0)).alias("transitions"),
        F.count("flip").alias("observed_pairs"),
    )


def pixel_runs(rows: DataFrame, frames: DataFrame, keys: list[str] = PIXEL, state: str = "dark") -> DataFrame:
    """Runs of the state along each pixel's own sequence, with censoring reasons.

    The window key is the pixel, so even one dominating series is spread over its canvas;
    the neighbouring frame's fate (gap, invalid reference, support loss) comes from the
    short frame table joined by the run's edge positions.
    """
    w = Window.partitionBy(*keys).orderBy("position")
    valid = rows.where(F.col(state).isNotNull())
    starts = F.coalesce(
        (F.lag("position").over(w) != F.col("position") - 1) | (F.lag(state).over(w) != F.col(state)), F.lit(True)
    )
    marked = valid.withColumn("__s", starts)
    marked = marked.withColumn("__run", F.sum(F.col("__s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, "__run").agg(
        F.first(state).alias("state"), F.min("position").alias("start"), F.max("position").alias("end")
    )
    order = Window.partitionBy(*keys).orderBy("start")
    near = islands.select(
        *keys,
        "state",
        "start",
        "end",
        (F.lag("end").over(order) == F.col("start") - 1).alias("__lc"),
        (F.lead("start").over(order) == F.col("end") + 1).alias("__rc"),
    )
    fate = frames.select(
        "series_id",
        F.col("position"),
        F.when(~F.col("observed"), "gap").when(~F.col("reference_valid"), "invalid_reference").otherwise("support_loss").alias("fate"),
    )
    left = fate.select("series_id", (F.col("position") + 1).alias("start"), F.col("fate").alias("__lf"))
    right = fate.select("series_id", (F.col("position") - 1).alias("end"), F.col("fate").alias("__rf"))
    out = near.join(left, ["series_id", "start"], "left").join(right, ["series_id", "end"], "left")
    out = out.select(
        *keys,
        "state",
        "start",
        "end",
        (F.col("end") - F.col("start") + 1).alias("length"),
        F.when(F.col("__lc"), "state_change").otherwise(F.coalesce("__lf", F.lit("window_endpoint"))).alias("left_boundary"),
        F.when(F.col("__rc"), "state_change").otherwise(F.coalesce("__rf", F.lit("window_endpoint"))).alias("right_boundary"),
    )
    return out.withColumn(
        "censored", (F.col("left_boundary") != "state_change") | (F.col("right_boundary") != "state_change")
    )


def pixel_state_stats(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per pixel transitions and longest runs, then their spread over the group's pixels."""
    w = Window.partitionBy(*PIXEL).orderBy("position")
    adjacent = F.lag("position").over(w) == F.col("position") - 1
    flip = F.when(adjacent & (F.lag("dark").over(w) != F.col("dark")), 1).otherwise(0)
    starts = F.coalesce(~adjacent | (F.lag("dark").over(w) != F.col("dark")), F.lit(True)).cast("int")
    marked = rows.withColumn("__flip", flip).withColumn("__st", starts).withColumn(
        "__run", F.sum("__st").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    extra = [c for c in group if c not in PIXEL]
    islands = marked.groupBy(*PIXEL, *extra, "__run").agg(
        F.first("dark").alias("dark"), F.count(F.lit(1)).alias("length"), F.sum("__flip").alias("flips")
    )
    longest = lambda flag: F.coalesce(F.max(F.when(F.col("dark") == flag, F.col("length"))), F.lit(0))
    per_pixel = islands.groupBy(*PIXEL, *extra).agg(
        F.sum("flips").alias("transitions"), longest(True).alias("longest_dark"), longest(False).alias("longest_bright")
    )
    return per_pixel.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.avg((F.col("transitions") > 0).cast("double")).alias("fraction_with_transitions"),
        F.median("transitions").alias("transitions_median"),
        bounded_quantile("transitions", 0.9).alias("transitions_p90"),
        F.max("transitions").alias("max_transitions"),
        bounded_quantile("longest_dark", 0.9).alias("longest_dark_p90"),
        F.max("longest_dark").alias("longest_dark_max"),
        bounded_quantile("longest_bright", 0.9).alias("longest_bright_p90"),
    )


def activity_map(px: DataFrame, frames: DataFrame, dark_ratio: float = 0.65) -> DataFrame:
    """Per pixel mean, population deviation (two frames at least), dark and support fraction."""
    valid = px.where(F.col("observed") & supported())
    cut = valid.groupBy(*FRAME).agg((F.median("brightness") * dark_ratio).alias("cut"))
    count = frames.where("observed").groupBy("series_id").agg(F.count(F.lit(1)).alias("frames"))
    per_pixel = valid.join(cut, FRAME).groupBy(*PIXEL).agg(
        F.count(F.lit(1)).alias("support_count"),
        F.avg("brightness").alias("mean"),
        F.when(F.count(F.lit(1)) >= 2, F.stddev_pop("brightness")).alias("std"),
        F.avg((F.col("brightness") < F.col("cut")).cast("double")).alias("relative_dark_fraction"),
    )
    return per_pixel.join(count, "series_id").withColumn("support_fraction", ratio("support_count", "frames")).drop("frames")


def articulation(px: DataFrame, frames: DataFrame, region: str) -> DataFrame:
    """Per frame and region q90 - q10 spread, raw and scaled three ways."""
    rows = on_support(px, frames, "fixed")
    whole = rows.groupBy(*FRAME).agg(
        F.median("brightness").alias("whole"),
        (bounded_quantile("brightness", 0.9) - bounded_quantile("brightness", 0.1)).alias("whole_spread"),
    )
    q = rows.groupBy(*FRAME, region).agg(
        F.count(F.lit(1)).alias("supported_pixels"),
        *[bounded_quantile("brightness", p).alias(n) for n, p in OCTILES.items()],
    )
    ok = F.col("supported_pixels") >= 3
    spread = F.when(ok, F.col("q90") - F.col("q10"))
    out = q.join(whole, FRAME).withColumn("raw_spread", spread)
    return out.select(
        *FRAME,
        region,
        "supported_pixels",
        F.when(ok, "ok").otherwise("unavailable").alias("status"),
        "raw_spread",
        ratio("raw_spread", positive("whole")).alias("relative_to_whole_median"),
        F.when(ok, log_positive("q90") - log_positive("q10")).alias("log_spread"),
        ratio("raw_spread", positive("whole_spread")).alias("relative_to_whole_contrast"),
    )


def contrast_coverage(rows: DataFrame, keys: list[str], value: str, ratios: list[float]) -> DataFrame:
    """Dark and bright area fractions around the group median, per ratio."""
    data = rows.where(F.col(value) > 0)
    med = data.groupBy(*keys).agg(F.median(value).alias("inner_median"), F.count(F.lit(1)).alias("supported_pixels"))
    wide = data.join(med, keys)
    aggs = []
    for r in ratios:
        tag = f"{r:.2f}"
        aggs += [
            F.avg((F.col(value) < F.col("inner_median") / r).cast("double")).alias(f"dark_{tag}"),
            F.avg((F.col(value) > F.col("inner_median") * r).cast("double")).alias(f"bright_{tag}"),
        ]
    out = wide.groupBy(*keys).agg(
        F.max("supported_pixels").alias("supported_pixels"), F.max("inner_median").alias("inner_median"), *aggs
    )
    options = F.array(
        *[
            F.struct(F.lit(f"{r:.2f}").alias("ratio_key"), F.col(f"`dark_{r:.2f}`").alias("d"), F.col(f"`bright_{r:.2f}`").alias("b"))
            for r in ratios
        ]
    )
    ok = F.col("supported_pixels") >= 3
    long = out.select(*keys, "supported_pixels", "inner_median", F.explode(options).alias("z"))
    total = F.col("z.d") + F.col("z.b")
    balanced = F.least("z.d", "z.b")
    return long.select(
        *keys,
        "z.ratio_key",
        "supported_pixels",
        F.when(ok, "ok").otherwise("unavailable").alias("status"),
        F.when(ok, F.col("inner_median")).alias("inner_median"),
        F.when(ok, F.col("z.d")).alias("dark_fraction"),
        F.when(ok, F.col("z.b")).alias("bright_fraction"),
        F.when(ok, total).alias("extreme_coverage"),
        F.when(ok, balanced).alias("balanced_coverage"),
        F.when(ok, F.when(total > 0, 2 * balanced / total).otherwise(0.0)).alias("coverage_balance"),
    )


def spatial_participation(px: DataFrame, frames: DataFrame, cells: int) -> DataFrame:
    """How tonal differences spread over equal wedges of the fixed support."""
    support = centroid_sectors(fixed_support(px, frames, SERIES), cells, SERIES)
    rows = px.where(F.col("observed") & supported() & (F.col("brightness") > 0)).join(support, PIXEL)
    logs = rows.groupBy(*FRAME, "wedge").agg(F.ln(F.median("brightness")).alias("log_median"), F.count(F.lit(1)).alias("n"))
    centre = logs.groupBy(*FRAME).agg(
        F.median("log_median").alias("__c"),
        F.count(F.lit(1)).alias("valid_cells"),
        F.sum("n").alias("supported_pixels"),
        (bounded_quantile("log_median", 0.9) - bounded_quantile("log_median", 0.1)).alias("cell_log_spread"),
    )
    dev = F.abs(F.col("log_median") - F.col("__c"))
    part = logs.join(centre, FRAME).groupBy(*FRAME).agg(
        F.when(F.sum(dev * dev) > 0, F.sum(dev) * F.sum(dev) / F.sum(dev * dev) / F.count(F.lit(1))).otherwise(0.0).alias("contrast_participation")
    )
    right = logs.select(*FRAME, F.pmod(F.col("wedge") - 1, F.lit(cells)).cast("int").alias("wedge"), F.col("log_median").alias("__r"))
    beside = logs.join(right, FRAME + ["wedge"]).groupBy(*FRAME).agg(
        F.median(F.abs(F.col("log_median") - F.col("__r"))).alias("adjacent_log_contrast_median")
    )
    out = centre.join(part, FRAME).join(beside, FRAME, "left")
    enough = F.col("valid_cells") >= max(4, -(-cells // 2))
    keep = lambda c: F.when(enough, c)
    return out.select(
        *FRAME,
        "supported_pixels",
        "valid_cells",
        F.when(enough, "ok").otherwise("unavailable").alias("status"),
        keep(F.col("cell_log_spread")).alias("cell_log_spread"),
        keep(F.col("contrast_participation")).alias("contrast_participation"),
        keep(F.col("cell_log_spread") * F.col("contrast_participation")).alias("distributed_contrast"),
        keep(F.col("adjacent_log_contrast_median")).alias("adjacent_log_contrast_median"),
    )


def long_measures(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Wide measures as (keys, measure, value) rows."""
    return df.unpivot(keys, measures, "measure", "value")


def bright_state(px: DataFrame, frames: DataFrame, k: float) -> DataFrame:
    """Observed pixels with fixed-support membership, frame reference and bright state."""
    fixed = fixed_support(px, frames, SERIES).withColumn("fixed", F.lit(True))
    rows = px.where("observed").join(fixed, PIXEL, "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    whole = rows.where("fixed").groupBy(*FRAME).agg(F.median("brightness").alias("whole"))
    rows = rows.join(whole, FRAME, "left")
    scale = rows.where("fixed").groupBy(*FRAME).agg(bright_scale("brightness", "whole").alias("scale"))
    rows = rows.join(scale, FRAME, "left")
    return rows.withColumn("bright", relative_bright(F.col("brightness"), F.col("whole"), F.col("scale"), k))


def switching(px: DataFrame, frames: DataFrame, threshold: float, mode: str, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Relative-dark switches between adjacent frames: per pair, and pooled per series.

    Returns (pairs, series). `pair_local` support needs the pixel on both sides only.
    """
    extra = [region] if region else []
    whole = whole_trace(px, frames)
    rows = with_whole(on_support(px, frames, "fixed" if mode == "fixed" else "dynamic"), whole).withColumn(
        "dark", relative_dark(F.col("brightness"), F.col("whole"), threshold)
    )
    w = Window.partitionBy(*PIXEL, *extra).orderBy("position")
    flips = (
        rows.where(F.col("dark").isNotNull())
        .withColumn("__p", F.lag("position").over(w))
        .withColumn("__d", F.lag("dark").over(w))
        .where(F.col("__p") == F.col("position") - 1)
        .withColumn("switched", F.col("dark") != F.col("__d"))
    )
    pairs = flips.groupBy(*FRAME, *extra).agg(
        F.count(F.lit(1)).alias("eligible_pixels"),
        F.count_if("switched").alias("switched_pixels"),
        ratio(F.count_if("switched"), F.count(F.lit(1))).alias("switch_fraction"),
    )
    per_pixel = flips.groupBy(*PIXEL, *extra).agg(F.count(F.lit(1)).alias("eligible"), F.count_if("switched").alias("switches"))
    per_pixel = per_pixel.withColumn("rate", ratio("switches", "eligible"))
    series = per_pixel.groupBy("series_id", *extra).agg(
        F.sum("eligible").alias("eligible_pixel_pairs"),
        F.sum("switches").alias("switched_pixel_pairs"),
        ratio(F.sum("switches"), F.sum("eligible")).alias("switch_rate"),
        F.count(F.lit(1)).alias("finite_pixels"),
        *[bounded_quantile("rate", p).alias(f"rate_{n}") for n, p in OCTILES.items()],
        F.max("rate").alias("rate_max"),
        F.avg((F.col("rate") > 0).cast("double")).alias("fraction_nonzero"),
        F.min("eligible").alias("eligible_min"),
        F.max("eligible").alias("eligible_max"),
    )
    return pairs, series


def persistence_pixels(run_rows: DataFrame, available: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Longest run per pixel and state, zero where a state never occurs, with censoring."""
    longest = run_rows.groupBy(*keys, "state").agg(F.max("length").alias("longest"))
    best = (
        run_rows.join(longest, keys + ["state"])
        .where("length = longest")
        .groupBy(*keys, "state")
        .agg(F.max("longest").alias("longest"), F.bool_or("censored").alias("any_censored"), F.bool_and("censored").alias("all_censored"))
    )
    states = F.explode(F.array(F.lit(True), F.lit(False))).alias("state")
    grid = available.select(*keys).distinct().select(*keys, states)
    return grid.join(best, keys + ["state"], "left").select(
        *keys,
        "state",
        F.coalesce("longest", F.lit(0)).alias("longest"),
        F.coalesce("any_censored", F.lit(False)).alias("any_censored"),
        F.coalesce("all_censored", F.lit(False)).alias("all_censored"),
    )


def persistence(per_pixel: DataFrame, run_rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Spread of the longest runs over pixels, share of the window, and run counts."""
    spread = per_pixel.groupBy("series_id", "state").agg(
        F.count(F.lit(1)).alias("finite_pixels"),
        F.median("longest").alias("q50"),
        bounded_quantile("longest", 0.9).alias("q90"),
        F.max("longest").alias("max_length"),
        F.avg((F.col("longest") > 0).cast("double")).alias("fraction_nonzero"),
        F.avg(F.col("any_censored").cast("double")).alias("any_censored_fraction"),
        F.avg(F.col("all_censored").cast("double")).alias("all_censored_fraction"),
    )
    sides = [
        F.count_if(F.col(f"{side}_boundary") == why).alias(f"{side}_{why}")
        for side in ("left", "right")
        for why in ("gap", "invalid_reference", "support_loss", "window_endpoint")
    ]
    tally = run_rows.groupBy("series_id", "state").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if("censored").alias("censored_runs"), *sides
    )
    filled = spread.join(tally, ["series_id", "state"], "left").na.fill(0, tally.columns[2:])
    return filled.join(steps, "series_id").withColumn("q90_fraction", ratio("q90", "steps")).drop("steps")


def higher_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Quantile of method 'higher': the value at rank ceil(q (n-1)) of a pixel group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__run", F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__n", F.sum("__c").over(w))
    return run.where(F.col("__run") > F.ceil(F.lit(q) * (F.col("__n") - 1))).groupBy(*keys).agg(F.min(value).alias("chosen"))


def run_event(per_pixel: DataFrame, run_rows: DataFrame, width: int) -> DataFrame:
    """The stretch where most pixels persist together for the q90 ('higher') length.

    Every run at least that long is spread to its possible window starts (bounded by the
    window length), counted per start; the fullest, earliest start wins and is extended
    along its first pixel with the longest run (row-major order).
    """
    keys = ["series_id", "state"]
    length = higher_quantile(per_pixel, keys, "longest", 0.9)
    most = per_pixel.groupBy(*keys).agg(F.max("longest").alias("__m"))
    length = length.join(most, keys).select(
        *keys, F.when((F.col("chosen") == 0) & (F.col("__m") > 0), 1).otherwise(F.col("chosen")).alias("window_length")
    ).where("window_length > 0")
    fits = run_rows.join(length, keys).where("length >= window_length")
    spread = fits.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("end") - F.col("window_length") + 1)))
    at = spread.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("pixels"))
    best = at.groupBy(*keys).agg(F.max(F.struct("pixels", (-F.col("at")).alias("neg"))).alias("b")).select(
        *keys, (-F.col("b.neg")).alias("window_start"), F.col("b.pixels").alias("window_pixels")
    )
    inside = (
        fits.join(best, keys)
        .where((F.col("start") <= F.col("window_start")) & (F.col("end") >= F.col("window_start") + F.col("window_length") - 1))
        .join(per_pixel.select(*PIXEL, "state", "longest"), PIXEL + ["state"])
    )
    flat = F.col("y") * width + F.col("x")
    rep = inside.groupBy(*keys).agg(
        F.max(F.struct("longest", (-flat).alias("neg"), "start", "end", "left_boundary", "right_boundary", "window_start", "window_length", "window_pixels")).alias("r")
    )
    return rep.select(
        *keys,
        F.col("r.start").alias("start"),
        F.floor((F.col("r.start") + F.col("r.end")) / 2).alias("middle"),
        F.col("r.end").alias("end"),
        "r.window_start",
        "r.window_length",
        "r.window_pixels",
        (-F.col("r.neg")).alias("representative_pixel"),
        "r.left_boundary",
        "r.right_boundary",
    )


def components(active: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Connected components of active cells: (keys, y, x) -> label (row-major first cell, a struct).

    A frame becomes one row of horizontal runs in row-major order, after one shuffle. A fold
    gives every run the lowest label among the runs it touches in the row above, or its own number;
    labels that meet are noted and renamed in the two open rows only, so a run costs as much as these are long. A
    second fold over the notes, latest first, resolves renamed labels.
    """
    reach = 1 if connectivity == 8 else 0
    w = Window.partitionBy(*keys).orderBy("y", "x")
    cells = active.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    cells = cells.withColumn("__g", F.col("x") - F.row_number().over(w))
    run_rows = cells.groupBy(*keys, "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    frames = run_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    numbered = F.transform("runs", lambda r, i: F.struct(r["y"].alias("y"), r["x0"].alias("x0"), r["x1"].alias("x1"), i.alias("i")))
    open_row, notes = "array<struct<x0:int,x1:int,l:int>>", "array<struct<was:int,now:int>>"
    none = lambda kind: F.array().cast(kind)
    start = F.struct(
        F.lit(-2).alias("y"), none(open_row).alias("above"), none(open_row).alias("row"), none("array<int>").alias("labels"), none(notes).alias("notes")
    )

    def meet(acc: Column, run: Column) -> Column:
        same = run["y"] == acc["y"]
        above = F.when(same, acc["above"]).when(run["y"] == acc["y"] + 1, acc["row"]).otherwise(none(open_row))
        row = F.when(same, acc["row"]).otherwise(none(open_row))
        met = F.transform(F.filter(above, lambda p: (run["x0"] <= p["x1"] + reach) & (p["x0"] <= run["x1"] + reach)), lambda p: p["l"])
        # The next two are read several times: a one-element transform names them.
        named = F.transform(
            F.array(F.struct(above.alias("above"), row.alias("row"), met.alias("met"), F.coalesce(F.array_min(met), run["i"]).alias("l"))),
            lambda n: F.struct(n["above"].alias("above"), n["row"].alias("row"), n["l"].alias("l"), F.array_remove(F.array_distinct(n["met"]), n["l"]).alias("gone")),
        )

        def renamed(runs: Column, n: Column) -> Column:
            return F.when(F.size(n["gone"]) == 0, runs).otherwise(
                F.transform(runs, lambda p: F.struct(p["x0"].alias("x0"), p["x1"].alias("x1"), F.when(F.array_contains(n["gone"], p["l"]), n["l"]).otherwise(p["l"]).alias("l")))
            )

        return F.get(
            F.transform(
                named,
                lambda n: F.struct(
                    run["y"].alias("y"),
                    renamed(n["above"], n).alias("above"),
                    F.concat(renamed(n["row"], n), F.array(F.struct(run["x0"].alias("x0"), run["x1"].alias("x1"), n["l"].alias("l")))).alias("row"),
                    F.concat(acc["labels"], F.array(n["l"])).alias("labels"),
                    F.concat(acc["notes"], F.transform(n["gone"], lambda g: F.struct(g.alias("was"), n["l"].alias("now")))).alias("notes"),
                ),
            ),
            F.lit(0),
        )

    def settle(known: Column, note: Column) -> Column:
        now = F.coalesce(F.element_at(known, note["now"]), note["now"])
        return F.map_concat(known, F.map_from_arrays(F.array(note["was"]), F.array(now)))

    folded = frames.withColumn("fold", F.aggregate(numbered, start, meet))
    folded = folded.withColumn("final", F.aggregate(F.reverse("fold.notes"), F.create_map().cast("map<int,int>"), settle))
    root = lambda i: F.get("runs", F.coalesce(F.element_at("final", F.get("fold.labels", i)), F.get("fold.labels", i)))
    named = F.transform("runs", lambda r, i: F.struct(r.alias("r"), root(i).alias("root")))
    rows = folded.select(*keys, F.explode(named).alias("n"))
    label = F.struct(F.col("n.root.y").cast("long").alias("y"), F.col("n.root.x0").cast("long").alias("x")).alias("label")
    return rows.select(*keys, F.col("n.r.y").alias("y"), F.explode(F.sequence("n.r.x0", "n.r.x1")).alias("x"), label)


def flash_morphology(labelled: DataFrame, support: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Component count, largest share, effective count and boundary contact per frame."""
    area = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("support_pixels"))
    rim = edge_of(support, keys, connectivity).withColumn("rim", F.lit(True))
    cells = labelled.join(rim, keys + ["y", "x"], "left")
    sizes = cells.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("size"), F.count("rim").alias("rim")
    )
    shape = sizes.groupBy(*keys).agg(
        F.sum("size").alias("active_pixels"),
        F.count(F.lit(1)).alias("component_count"),
        F.max("size").alias("largest_component_pixels"),
        ratio(F.sum("size") * F.sum("size"), F.sum(F.col("size") * F.col("size"))).alias("effective_component_count"),
        F.sum("rim").alias("boundary_active_pixels"),
        F.count_if(F.col("rim") > 0).alias("components_touching_boundary"),
    )
    return area.join(shape, keys, "left").select(
        *keys,
        "support_pixels",
        F.coalesce("active_pixels", F.lit(0)).alias("active_pixels"),
        F.when(F.col("active_pixels").isNull(), "unavailable").otherwise("ok").alias("status"),
        ratio(F.coalesce("active_pixels", F.lit(0)), "support_pixels").alias("active_fraction"),
        F.coalesce("component_count", F.lit(0)).alias("component_count"),
        ratio("largest_component_pixels", "active_pixels").alias("largest_component_fraction"),
        ratio("largest_component_pixels", "support_pixels").alias("largest_component_support_fraction"),
        "effective_component_count",
        ratio("boundary_active_pixels", "active_pixels").alias("boundary_active_fraction"),
        "components_touching_boundary",
    )


def morphology_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Active-frame share and spread of the shape measures over active frames (one window)."""
    ok = F.col("status") == "ok"
    val = lambda c: F.when(ok, F.col(c))
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed_frames"),
        F.count_if(ok).alias("active_frames"),
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("active_frame_fraction"),
        F.median(val("active_fraction")).alias("median_active_fraction"),
        F.median(val("largest_component_fraction")).alias("median_largest_fraction"),
        bounded_quantile(val("largest_component_fraction"), 0.1).alias("q10_largest_fraction"),
        bounded_quantile(val("largest_component_fraction"), 0.9).alias("q90_largest_fraction"),
        F.median(val("effective_component_count")).alias("median_effective_count"),
        bounded_quantile(val("effective_component_count"), 0.9).alias("q90_effective_count"),
        F.median(val("boundary_active_fraction")).alias("median_boundary_fraction"),
    )

