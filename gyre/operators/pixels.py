"""Per-pixel projections, predicates and small-neighbourhood operators.

A pixel table holds one row per (series, position, y, x). A frame has at most canvas x
canvas pixels, so grouping by frame (or frame and region) is bounded by the data model and
uses the built-in percentile; nothing here groups a whole series in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import MAD_SCALE, positive, ratio
from gyre.functions.ranking import bounded_quantile

# Luma weights, the sRGB transfer curve, band edges and region names.
LUMA = (0.2126, 0.7152, 0.0722)
BAND_EDGES = (0.20, 0.45, 0.70)
BANDS = ("centre", "inner", "middle", "outer")
SECTOR_NAMES = ("side_E", "corner_SE", "side_S", "corner_SW", "side_W", "corner_NW", "side_N", "corner_NE")

FRAME = ["series_id", "position"]
FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def supported() -> Column:
    return F.col("valid") & F.col("in_mask") & F.col("brightness").isNotNull()


def photometry(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", gain: float = 1.0) -> DataFrame:
    """Encoded brightness, linear luminance, gained luminance and chroma range of 8-bit RGB."""
    if not 0.9 <= gain <= 1.1:
        raise ValueError("gain must lie within 0.9..1.1")
    encoded = [F.col(c) / 255.0 for c in (r, g, b)]
    linear = [F.when(e <= 0.04045, e / 12.92).otherwise(F.pow((e + 0.055) / 1.055, 2.4)) for e in encoded]

    def weighted(parts: list[Column]) -> Column:
        return parts[0] * LUMA[0] + parts[1] * LUMA[1] + parts[2] * LUMA[2]

    return df.select(
        "*",
        weighted(encoded).alias("encoded_brightness"),
        weighted(linear).alias("linear_luminance"),
        (weighted(linear) * gain).alias("gain_luminance"),
        (F.greatest(*encoded) - F.least(*encoded)).alias("chroma_range"),
    )


def frame_brightness(px: DataFrame, keys: list[str] = FRAME, value: str = "brightness") -> DataFrame:
    return px.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        bounded_quantile(value, 0.05).alias("p05"),
        bounded_quantile(value, 0.95).alias("p95"),
    )


def _offsets(size: int) -> tuple[Column, Column]:
    middle = (size - 1) / 2
    return F.col("x") - middle, F.col("y") - middle


def chebyshev(size: int, extent: int) -> Column:
    dx, dy = _offsets(size)
    return F.greatest(F.abs(dx), F.abs(dy)) / (extent / 2)


def radial_band(size: int, extent: int, edges: tuple = BAND_EDGES) -> Column:
    """Square-ring band; an edge value belongs to the outer band."""
    r = chebyshev(size, extent)
    return F.when(r < edges[0], BANDS[0]).when(r < edges[1], BANDS[1]).when(r < edges[2], BANDS[2]).otherwise(BANDS[3])


def quadrant(size: int) -> Column:
    dx, dy = _offsets(size)
    return (
        F.when((dx >= 0) & (dy < 0), "quadrant_NE")
        .when((dx >= 0) & (dy >= 0), "quadrant_SE")
        .when((dx < 0) & (dy >= 0), "quadrant_SW")
        .otherwise("quadrant_NW")
    )


def octant_index(size: int) -> Column:
    dx, dy = _offsets(size)
    return F.pmod(F.floor((F.atan2(dy, dx) + math.pi / 8) / (math.pi / 4)), F.lit(8)).cast("int")


def octant(size: int) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SECTOR_NAMES]), octant_index(size) + 1)


def strip(radius: Column, inner_width: Column, outer_width: Column, at: Column, guard: float) -> Column:
    """'inside' / 'outside' strip beside a boundary, a guard gap left free; else null."""
    return F.when(
        (at >= radius - guard - inner_width) & (at < radius - guard), "inside"
    ).when((at > radius + guard) & (at <= radius + guard + outer_width), "outside")


def boundary_strip(at: Column, radius: float | Column, width: float | Column, guard: float = 0.01) -> Column:
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    width = width if isinstance(width, Column) else F.lit(width)
    return strip(radius, width, width, at, guard)


def relative_strip(at: Column, inner: Column, boundary: Column, outer: Column, fraction: float, guard: float = 0.01) -> Column:
    """Strip widths are a fraction of the neighbouring band widths."""
    return strip(boundary, (boundary - inner) * fraction, (outer - boundary) * fraction, at, guard)


def periodic_interp(angle: Column, controls: Column, n: int = 8) -> Column:
    """Linear blend of n equally spaced control points around the circle."""
    t = F.pmod(angle, F.lit(2 * math.pi)) / (2 * math.pi / n)
    lower = F.floor(t)
    a = F.element_at(controls, (F.pmod(lower, F.lit(n)) + 1).cast("int"))
    b = F.element_at(controls, (F.pmod(lower + 1, F.lit(n)) + 1).cast("int"))
    return a + (b - a) * (t - lower)


def polar(size: int) -> tuple[Column, Column]:
    dx, dy = _offsets(size)
    return F.sqrt(dx * dx + dy * dy), F.pmod(F.atan2(dy, dx), F.lit(2 * math.pi))


def normalised_radius(px: DataFrame, size: int, bins: int, keys: list[str] = FRAME) -> DataFrame:
    """Radius over the outline radius at that angle.

    The outline is the largest mask radius per angle bin, kept as one short array per
    frame and blended around the circle.
    """
    r, theta = polar(size)
    width = 2 * math.pi / bins
    cell = F.pmod(F.round(theta / width), F.lit(bins)).cast("int")
    rims = (
        px.where("in_mask")
        .groupBy(*keys, cell.alias("__bin"))
        .agg(F.max(r).alias("__rim"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__rim"))).alias("__rims"))
    )
    outline = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("__rims", i), F.lit(0.0)))
    around = periodic_interp(theta, outline, bins)
    return (
        px.where("in_mask")
        .join(rims, keys)
        .withColumn("u", F.when(around > 0, r / around))
        .withColumn("theta", theta)
        .drop("__rims")
    )


def nested_bands(u: Column, boundaries: list[Column]) -> Column:
    """Four bands between three nested boundaries."""
    return (
        F.when(u < boundaries[0], "centre")
        .when(u < boundaries[1], "inner_step")
        .when(u < boundaries[2], "middle_step")
        .otherwise("outer_step")
    )


def centroid_sectors(px: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Equal wedges around the support centroid, wedge 0 centred east, counter-clockwise."""
    centre = px.groupBy(*keys).agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    width = 2 * math.pi / n
    angle = F.atan2(F.col("__cy") - F.col("y"), F.col("x") - F.col("__cx"))
    wedge = F.floor(F.pmod(angle + width / 2, F.lit(2 * math.pi)) / width)
    return px.join(centre, keys).withColumn("wedge", F.least(wedge, F.lit(n - 1)).cast("int")).drop("__cx", "__cy")


def _moments(places: Column) -> Column:
    """Population variances and covariance (xx, yy, xy) of x and y over `places` (y * 2^32 + x, ascending) by the running updates
    of the SQL engine; a step of its covariance rounds product and sum once."""

    def step(s, place):
        x, y = place.bitwiseAND(0xFFFFFFFF).cast("double"), F.shiftright(place, 32).cast("double")
        n, dx, dy = s.n + 1, x - s.x, y - s.y
        mean_x, mean_y = s.x + dx / n, s.y + dy / n
        fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), dy, x - mean_x, s.xy).cast("double")
        return F.struct(
            n.alias("n"), mean_x.alias("x"), mean_y.alias("y"),
            (s.xx + (x - mean_x) * dx).alias("xx"), (s.yy + (y - mean_y) * dy).alias("yy"), fused.alias("xy"),
        )

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return F.aggregate(places, start, step, lambda s: F.struct(*[(s[c] / s.n).alias(c) for c in ("xx", "yy", "xy")]))


def mask_geometry(px: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Area, centroid, box, covariance eigenvalues and orientation (null when ambiguous).

    The last bit of the moments decides where a shape is upright (-90 or 90, the same axis), at the limit of ambiguity or halfway
    between two numbers of six decimals. There they are summed in reading order, as SQL sums them.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    m = px.where("in_mask").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.struct(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy")).alias("__m"),
        (F.count(F.lit(1)) * F.sum(x * y) == F.sum(x) * F.sum(y)).alias("__even"),
        F.collect_list(F.shiftleft(y, 32) + x).alias("__places"),
    )
    xx, yy, xy = F.col("__m.xx"), F.col("__m.yy"), F.col("__m.xy")
    half, arm = (xx + yy) / 2, F.sqrt((xx - yy) / 2 * ((xx - yy) / 2) + xy * xy)
    major, minor = half + arm, half - arm
    longer = major / F.greatest(minor, F.lit(1e-12))
    halfway = [F.abs(F.pmod(v * 1e6, F.lit(1.0)) - 0.5) < 1e-4 for v in (major, minor)]
    close = (F.col("__even") & (xx < yy)) | (F.abs(longer - 1.08) < 1e-6) | halfway[0] | halfway[1]
    m = m.where("area >= 3").withColumn("__m", F.when(close, _moments(F.sort_array("__places"))).otherwise(F.col("__m")))
    angle = F.degrees(F.atan2(2 * xy, xx - yy)) / 2
    return m.withColumns(
        {"major": major, "minor": minor, "orientation": F.when(~(longer < 1.08), (angle + 90 + 180) % 180 - 90)}
    ).drop("__m", "__even", "__places")


def effective_diameter(area: Column, minimum: int = 64) -> Column:
    return F.when(area >= minimum, 2 * F.sqrt(area / math.pi))


def resample(px: DataFrame, params: DataFrame, size: int, keys: list[str] = FRAME) -> DataFrame:
    """Translate and scale onto a target grid, bilinear; valid only where all neighbours are.

    `params` has `scale`, `shift_x`, `shift_y` per frame (source = target / scale + shift).
    Each source pixel is sent to the few target cells it touches, so the work is a shuffle
    on the target cell, with no lookup of a whole frame.
    """
    src = px.join(params, keys)
    # A target cell (tx, ty) reads source position tx / scale + shift; invert to the range
    # of targets within one source pixel of this one.
    def span(axis: str, shift: str) -> Column:
        low = F.ceil((F.col(axis) - 1 - F.col(shift)) * F.col("scale"))
        high = F.floor((F.col(axis) + 1 - F.col(shift)) * F.col("scale"))
        lo, hi = F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1))
        return F.when(lo <= hi, F.sequence(lo, hi))

    spread = src.withColumn("tx", F.explode(span("x", "shift_x"))).withColumn("ty", F.explode(span("y", "shift_y")))
    wx = 1 - F.abs(F.col("tx") / F.col("scale") + F.col("shift_x") - F.col("x"))
    wy = 1 - F.abs(F.col("ty") / F.col("scale") + F.col("shift_y") - F.col("y"))
    weight = F.greatest(wx, F.lit(0.0)) * F.greatest(wy, F.lit(0.0))
    used = spread.withColumn("__w", weight).where("__w > 1e-9")
    return used.groupBy(*keys, "ty", "tx").agg(
        F.sum(F.col("__w") * F.col("brightness")).alias("value"),
        (F.bool_and(F.col("valid") & F.col("in_mask")) & (F.sum("__w") > 0.999)).alias("valid"),
    )


def eroded(px: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Cells of a mask table (keys, y, x) all of whose neighbours are in the mask."""
    return _touching(px, keys, connectivity).where(F.col("__n") == connectivity + 1).drop("__n", "__own")


def dilated(px: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """The mask plus its neighbours (not clipped to a canvas)."""
    return _touching(px, keys, connectivity).drop("__n", "__own")


def edge_of(px: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Mask cells removed by erosion."""
    return (
        _touching(px, keys, connectivity)
        .where((F.col("__n") < connectivity + 1) & F.col("__own"))
        .drop("__n", "__own")
    )


def _touching(px: DataFrame, keys: list[str], connectivity: int) -> DataFrame:
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    steps = ((0, 0),) + (FOUR if connectivity == 4 else EIGHT)
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    return (
        px.select(*keys, "y", "x", F.explode(moves).alias("m"))
        .groupBy(*keys, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.max((F.col("m.dy") == 0) & (F.col("m.dx") == 0)).alias("__own"),
        )
    )


def relative_dark(value: Column, reference: Column, threshold: float) -> Column:
    """value < threshold * reference, strict; null without a positive finite reference."""
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    return value < threshold * positive(reference)


def bright_scale(value: str, reference: str) -> Column:
    """Aggregate: scaled median absolute deviation about the frame reference."""
    scale = MAD_SCALE * F.median(F.abs(F.col(value) - F.col(reference)))
    return F.when(scale > 1e-12, scale)


def relative_bright(value: Column, reference: Column, scale: Column, k: float) -> Column:
    return value > reference + k * scale


def polar_profile(px: DataFrame, size: int, rays: int, samples: int, keys: list[str] = FRAME) -> DataFrame:
    """Brightness along rays of the normalised radius, divided by the ray median.

    Rays end at the largest mask radius of the frame's outline in their direction. Support
    is limited to 0.08 <= u <= 0.92; a ray whose median is below 0.05 loses its support.
    Only the pixels travel, one frame to a call; samples and their four corners never do.
    """
    step, middle = 2 * math.pi / rays, (size - 1) / 2
    u = np.arange(samples) / float(samples - 1)
    inside = (u >= 0.08) & (u <= 0.92)

    def sample(key: tuple, frame: pa.Table) -> pa.Table:
        y, x = frame["y"].to_numpy().astype(np.int64), frame["x"].to_numpy().astype(np.int64)
        known = ~frame["brightness"].is_null().to_numpy()
        masked, valid = (frame[c].fill_null(False).to_numpy() for c in ("in_mask", "valid"))
        y0, x0, h, w = y.min(), x.min(), np.ptp(y) + 1, np.ptp(x) + 1
        light, have, good = np.zeros((h, w)), np.zeros((h, w), bool), np.zeros((h, w), bool)
        light[y - y0, x - x0] = np.where(known, frame["brightness"].fill_null(0.0).to_numpy(), 0.0)
        have[y - y0, x - x0], good[y - y0, x - x0] = known, valid

        dy, dx = y[masked] - middle, x[masked] - middle
        ray = np.floor((np.arctan2(dy, dx) + 2 * math.pi) % (2 * math.pi) / step + 0.5).astype(np.int64) % rays
        rim = np.full(rays, -1.0)
        np.maximum.at(rim, ray, np.sqrt(dx * dx + dy * dy))
        ray = np.flatnonzero(rim >= 0)
        reach = u * rim[ray, None]
        sx = np.round(middle + reach * np.cos(ray * step)[:, None], 9)
        sy = np.round(middle + reach * np.sin(ray * step)[:, None], 9)
        raw, any_raw = np.zeros(sx.shape), np.zeros(sx.shape, bool)
        ok, any_near = np.ones(sx.shape, bool), np.zeros(sx.shape, bool)
        for a in (0, 1):
            for b in (0, 1):
                cy, cx = np.floor(sy).astype(np.int64) + a, np.floor(sx).astype(np.int64) + b
                weight = (1 - np.abs(sx - cx)) * (1 - np.abs(sy - cy))
                used = weight > 1e-9
                near = used & (np.abs(sx - cx) <= 0.5) & (np.abs(sy - cy) <= 0.5)
                held = used & (cy >= y0) & (cy < y0 + h) & (cx >= x0) & (cx < x0 + w)
                at = np.where(held, cy - y0, 0), np.where(held, cx - x0, 0)
                seen = held & have[at]
                raw += np.where(seen, weight * light[at], 0.0)
                any_raw |= seen
                ok &= ~near | (held & good[at])
                any_near |= near
        ok &= any_near & any_raw & inside
        n = ok.sum(axis=1)
        ordered = np.sort(np.where(ok, raw, np.inf), axis=1)
        row, last = np.arange(len(ray)), np.maximum(n - 1, 0)
        scale = 0.5 * ordered[row, last // 2] + 0.5 * ordered[row, (last + 1) // 2]
        scaled = ((n > 0) & ~(scale < 0.05))[:, None]
        value = np.divide(raw, scale[:, None], out=raw.copy(), where=scaled)
        columns = [pa.repeat(k, sx.size) for k in key] + [
            pa.array(np.repeat(ray, samples).astype(np.int32)), pa.array(np.tile(np.arange(samples, dtype=np.int32), len(ray))),
            pa.array(np.tile(u, len(ray))), pa.array(value.ravel(), mask=~any_raw.ravel()), pa.array((ok & scaled).ravel()),
        ]
        return pa.Table.from_arrays(columns, names=[*keys, "ray", "k", "u", "value", "supported"])

    rows = px.select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.col("brightness").cast("double"), "valid", "in_mask")
    shape = rows.select(*keys).schema.add("ray", "integer").add("k", "integer").add("u", "double").add("value", "double").add("supported", "boolean")
    return rows.groupBy(*keys).applyInArrow(sample, shape)


def edge_strength(
    profile: DataFrame, keys: list[str], index: str, value: str, ok: str, kernel: list[float], minimum: int = 8
) -> DataFrame:
    """Absolute central gradient of the gap-filled, kernel-smoothed profile, null off support.

    A profile is one ray of a fixed number of samples, so each window is bounded. Gaps are
    filled linearly between supported neighbours (held flat at the ends); a ray with fewer
    than `minimum` supported samples counts as zero. The kernel is applied with the edge
    value repeated beyond both ends.
    """
    part = Window.partitionBy(*keys)
    back = part.orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy(F.col(index).desc()).rowsBetween(Window.unboundedPreceding, 0)
    have = F.when(F.col(ok) & F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    rows = profile.withColumn("__h", have)
    rows = rows.withColumn("__a", F.last("__h", ignorenulls=True).over(back)).withColumn(
        "__b", F.last("__h", ignorenulls=True).over(ahead)
    ).withColumn("__n", F.count("__h").over(part))
    a, b = F.col("__a"), F.col("__b")
    blend = a["v"] + (b["v"] - a["v"]) * F.try_divide((F.col(index) - a["i"]).cast("double"), (b["i"] - a["i"]).cast("double"))
    filled = (
        F.when(F.col("__n") < minimum, F.lit(0.0))
        .when(F.col("__h").isNotNull(), F.col(value))
        .otherwise(F.coalesce(blend, a["v"], b["v"]))
    )
    rows = rows.withColumn("__f", filled)
    order = part.orderBy(index)
    radius = len(kernel) // 2
    first, last = F.first("__f").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("__f").over(ahead)
    rows = rows.withColumn("__first", first).withColumn("__last", last)
    smooth = F.lit(0.0)
    for offset, weight in zip(range(-radius, radius + 1), kernel):
        near = (
            F.col("__f") if offset == 0
            else F.coalesce(F.lag("__f", -offset).over(order), F.col("__first")) if offset < 0
            else F.coalesce(F.lead("__f", offset).over(order), F.col("__last"))
        )
        smooth = smooth + near * weight
    rows = rows.withColumn("__s", smooth)
    before, after = F.lag("__s").over(order), F.lead("__s").over(order)
    slope = (
        F.when(before.isNull(), after - F.col("__s"))
        .when(after.isNull(), F.col("__s") - before)
        .otherwise((after - before) / 2)
    )
    drop = ["__h", "__a", "__b", "__n", "__f", "__first", "__last", "__s"]
    return rows.withColumn("edge", F.when(F.col(ok), F.abs(slope))).drop(*drop)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]
