"""Per-pixel projections, geometry and neighbourhoods (family B)."""

from pyspark.sql import functions as F

from gyre.operators import pixels as P
from gyre.operators.support import fixed_support
from gyre.operators.traces import bright_state, whole_trace, with_whole
from gyre.plans.registry import query, r6
from gyre.plans.views import BAND, PIXELS, PROFILES, SIDE, SUPPORT

FRAME = ["series_id", "position"]
R = "greatest(abs(x - 3.5), abs(y - 3.5)) / 4"
QUADRANT = """CASE WHEN x >= 3.5 AND y < 3.5 THEN 'quadrant_NE' WHEN x >= 3.5 THEN 'quadrant_SE'
                   WHEN y >= 3.5 THEN 'quadrant_SW' ELSE 'quadrant_NW' END"""
OCTANT = "CAST((floor((atan2(y - 3.5, x - 3.5) + pi() / 8) / (pi() / 4)) + 8) AS INTEGER) % 8"
SECTORS = "['side_E', 'corner_SE', 'side_S', 'corner_SW', 'side_W', 'corner_NW', 'side_N', 'corner_NE']"


def level(shift: int):
    v = F.element_at("embedding", (F.pmod(F.col("k") + shift, F.lit(64)) + 1).cast("int")).cast("double")
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 0.5) * 255)))


@query(
    "b1_photometry",
    f"""WITH rgb AS (
      SELECT vec_id, greatest(0, least(255, floor((CAST(embedding[k + 1] AS DOUBLE) + 0.5) * 255))) AS r,
             greatest(0, least(255, floor((CAST(embedding[(k + 1) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS g,
             greatest(0, least(255, floor((CAST(embedding[(k + 2) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS b
      FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings)),
    e AS (SELECT vec_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb),
    l AS (SELECT *, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS lr,
                 CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS lg,
                 CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS lb FROM e)
    SELECT vec_id, {r6("avg(0.2126 * r + 0.7152 * g + 0.0722 * b)")} AS encoded_brightness,
           {r6("avg(0.2126 * lr + 0.7152 * lg + 0.0722 * lb)")} AS linear_luminance,
           {r6("avg((0.2126 * lr + 0.7152 * lg + 0.0722 * lb) * 1.05)")} AS gain_luminance,
           {r6("max(greatest(r, g, b) - least(r, g, b))")} AS chroma_range
    FROM l GROUP BY vec_id""",
)
def photometry(t):
    rgb = t.vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        "vec_id", level(0).alias("r"), level(1).alias("g"), level(2).alias("b")
    )
    return P.photometry(rgb, gain=1.05).groupBy("vec_id").agg(
        *[F.avg(c).alias(c) for c in ("encoded_brightness", "linear_luminance", "gain_luminance")],
        F.max("chroma_range").alias("chroma_range"),
    )


@query(
    "b2_frame_brightness",
    f"""WITH {PIXELS}
    SELECT series_id, position, {r6("avg(brightness)")} AS mean, {r6("stddev_pop(brightness)")} AS std,
           {r6("quantile_cont(brightness, 0.05)")} AS p05, {r6("quantile_cont(brightness, 0.95)")} AS p95
    FROM pixels GROUP BY 1, 2""",
)
def frame_brightness(t):
    return P.frame_brightness(t.pixels)


def _by_region(name, column, label_sql):
    @query(
        name,
        f"""WITH {PIXELS}
        SELECT series_id, {label_sql} AS region, count(*) AS n, {r6("avg(brightness)")} AS mean
        FROM pixels WHERE in_mask GROUP BY 1, 2""",
    )
    def run(t):
        return t.pixels.where("in_mask").groupBy("series_id", column().alias("region")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("brightness").alias("mean")
        )


_by_region("b3_radial_band", lambda: P.radial_band(SIDE, SIDE), BAND)
_by_region("b4_quadrant", lambda: P.quadrant(SIDE), QUADRANT)
_by_region("b5_octant", lambda: P.octant(SIDE), f"{SECTORS}[{OCTANT} + 1]")


@query(
    "b6_boundary_strips",
    f"""WITH {PIXELS}, s AS (
      SELECT *, CASE WHEN {R} >= 0.45 - 0.01 - 0.2 AND {R} < 0.45 - 0.01 THEN 'inside'
                     WHEN {R} > 0.45 + 0.01 AND {R} <= 0.45 + 0.01 + 0.2 THEN 'outside' END AS side
      FROM pixels WHERE in_mask)
    SELECT series_id, position, side, count(*) AS n, {r6("median(brightness)")} AS median
    FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3""",
)
def boundary_strips(t):
    side = P.boundary_strip(P.chebyshev(SIDE, SIDE), 0.45, 0.2)
    return t.pixels.where("in_mask").withColumn("side", side).where("side is not null").groupBy(*FRAME, "side").agg(
        F.count(F.lit(1)).alias("n"), F.median("brightness").alias("median")
    )


@query(
    "b7_relative_strips",
    f"""WITH {PIXELS}, s AS (
      SELECT *, CASE WHEN {R} >= 0.45 - 0.01 - 0.5 * (0.45 - 0.2) AND {R} < 0.45 - 0.01 THEN 'inside'
                     WHEN {R} > 0.45 + 0.01 AND {R} <= 0.45 + 0.01 + 0.5 * (0.9 - 0.45) THEN 'outside' END AS side
      FROM pixels WHERE in_mask)
    SELECT series_id, position, side, count(*) AS n, {r6("median(brightness)")} AS median
    FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3""",
)
def relative_strips(t):
    side = P.relative_strip(P.chebyshev(SIDE, SIDE), F.lit(0.2), F.lit(0.45), F.lit(0.9), 0.5)
    return t.pixels.where("in_mask").withColumn("side", side).where("side is not null").groupBy(*FRAME, "side").agg(
        F.count(F.lit(1)).alias("n"), F.median("brightness").alias("median")
    )


@query(
    "b8_periodic_interp",
    f"""WITH a AS (
      SELECT vec_id, step, embedding, (step * 0.37) % (2 * pi()) / (pi() / 32) AS t
      FROM (SELECT vec_id, embedding, unnest(range(20)) AS step FROM embeddings))
    SELECT vec_id, CAST(step AS INTEGER) AS step, {r6('''CAST(embedding[CAST(floor(t) AS INTEGER) % 64 + 1] AS DOUBLE)
           + (CAST(embedding[CAST(floor(t) + 1 AS INTEGER) % 64 + 1] AS DOUBLE)
              - CAST(embedding[CAST(floor(t) AS INTEGER) % 64 + 1] AS DOUBLE)) * (t - floor(t))''')} AS boundary
    FROM a""",
)
def periodic_interp(t):
    controls = F.transform("embedding", lambda v: v.cast("double"))
    rows = t.embeddings.select("vec_id", controls.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("step"))
    return rows.select("vec_id", "step", P.periodic_interp(F.col("step") * 0.37, F.col("c"), 64).alias("boundary"))


RIM = """,
pol AS (SELECT *, sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) AS r,
               (atan2(y - 3.5, x - 3.5) + 2 * pi()) % (2 * pi()) AS theta FROM pixels WHERE in_mask),
rim AS (SELECT series_id, position, CAST(round(theta / (2 * pi() / 16)) AS INTEGER) % 16 AS bin, max(r) AS rim
        FROM pol GROUP BY 1, 2, 3),
blend AS (
  SELECT p.*, coalesce(a.rim, 0) + (coalesce(b.rim, 0) - coalesce(a.rim, 0)) * (tt - floor(tt)) AS around
  FROM (SELECT *, theta / (2 * pi() / 16) AS tt FROM pol) p
  LEFT JOIN rim a ON a.series_id = p.series_id AND a.position = p.position AND a.bin = CAST(floor(tt) AS INTEGER) % 16
  LEFT JOIN rim b ON b.series_id = p.series_id AND b.position = p.position
                  AND b.bin = (CAST(floor(tt) AS INTEGER) + 1) % 16),
radii AS (SELECT *, CASE WHEN around > 0 THEN r / around END AS u FROM blend)"""


@query(
    "b9_normalised_radius",
    f"""WITH {PIXELS}{RIM}
    SELECT series_id, position, y, x, {r6("u")} AS u FROM radii""",
)
def normalised_radius(t):
    return P.normalised_radius(t.pixels, SIDE, 16).select(*FRAME, "y", "x", "u")


@query(
    "b10_nested_bands",
    f"""WITH {PIXELS}{RIM}
    SELECT series_id, position, CASE WHEN round(u, 9) < 0.3 THEN 'centre' WHEN round(u, 9) < 0.55 THEN 'inner_step'
             WHEN round(u, 9) < 0.8 THEN 'middle_step' ELSE 'outer_step' END AS band, count(*) AS n,
           {r6("avg(brightness)")} AS mean
    FROM radii GROUP BY 1, 2, 3""",
)
def nested_bands(t):
    u = F.round("u", 9)
    band = P.nested_bands(u, [F.lit(0.3), F.lit(0.55), F.lit(0.8)])
    return P.normalised_radius(t.pixels, SIDE, 16).groupBy(*FRAME, band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("brightness").alias("mean")
    )


@query(
    "b11_centroid_sectors",
    f"""WITH {SUPPORT}, c AS (SELECT series_id, avg(x) AS cx, avg(y) AS cy FROM fixed GROUP BY 1)
    SELECT series_id, least(CAST(floor(((atan2(cy - y, x - cx) + pi() / 8 + 2 * pi()) % (2 * pi())) / (pi() / 4)) AS INTEGER), 7)
             AS wedge, count(*) AS n, CAST(sum(y * 8 + x) AS BIGINT) AS checksum
    FROM fixed JOIN c USING (series_id) GROUP BY 1, 2""",
)
def centroid_sectors(t):
    return P.centroid_sectors(fixed_support(t.pixels, t.frames, ["series_id"]), 8, ["series_id"]).groupBy("series_id", "wedge").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 8 + F.col("x")).alias("checksum")
    )


SHAPE = """,
shape AS (
  SELECT series_id, position, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, max(x) AS x1,
         min(y) AS y0, max(y) AS y1, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy
  FROM pixels WHERE valid AND brightness > 0.45 GROUP BY 1, 2),
eig AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy) AS major,
               (xx + yy) / 2 - sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy) AS minor FROM shape WHERE area >= 3)"""


@query(
    "b12_mask_geometry",
    f"""WITH {PIXELS}{SHAPE}
    SELECT series_id, position, area, {r6("cx")} AS centroid_x, {r6("cy")} AS centroid_y, x0 AS x_min, x1 AS x_max,
           y0 AS y_min, y1 AS y_max, {r6("major")} AS major, {r6("minor")} AS minor,
           CASE WHEN major / greatest(minor, 1e-12) >= 1.08
                THEN {r6("(degrees(atan2(2 * xy, xx - yy)) / 2 + 90 + 180) % 180 - 90")} END AS orientation
    FROM eig""",
)
def mask_geometry(t):
    bright = t.pixels.withColumn("in_mask", F.col("valid") & (F.col("brightness") > 0.45))
    return P.mask_geometry(bright)


@query(
    "b13_effective_diameter",
    f"""WITH {PIXELS}
    SELECT series_id, position, count(*) AS area,
           CASE WHEN count(*) >= 40 THEN {r6("2 * sqrt(count(*) / pi())")} END AS diameter
    FROM pixels WHERE valid AND brightness > 0.45 GROUP BY 1, 2""",
)
def effective_diameter(t):
    area = t.pixels.where("valid and brightness > 0.45").groupBy(*FRAME).agg(F.count(F.lit(1)).alias("area"))
    # The published minimum of 64 pixels suits a 256-pixel canvas; 40 of 64 here.
    return area.withColumn("diameter", P.effective_diameter(F.col("area"), minimum=40))


@query(
    "b14_resample",
    f"""WITH {PIXELS}, prm AS (
      SELECT series_id, position, 1.5 AS scale, 0.25 * (position % 3) AS sx, 0.5 AS sy FROM frames),
    tgt AS (SELECT p.*, tx, ty, tx / scale + sx AS qx, ty / scale + sy AS qy
            FROM prm p, range(10) AS a(tx), range(10) AS b(ty)),
    near AS (
      SELECT t.series_id, t.position, t.tx, t.ty,
             greatest(1 - abs(qx - x), 0) * greatest(1 - abs(qy - y), 0) AS w, brightness, valid AND in_mask AS ok
      FROM tgt t JOIN pixels q ON q.series_id = t.series_id AND q.position = t.position
        AND abs(qx - x) <= 1 AND abs(qy - y) <= 1)
    SELECT series_id, position, ty, tx, {r6("sum(w * brightness)")} AS "value",
           bool_and(ok) AND sum(w) > 0.999 AS valid
    FROM near WHERE w > 1e-9 GROUP BY 1, 2, 3, 4""",
)
def resample(t):
    params = t.frames.select(
        *FRAME,
        F.lit(1.5).alias("scale"),
        (F.pmod("position", F.lit(3)) * 0.25).alias("shift_x"),
        F.lit(0.5).alias("shift_y"),
    )
    return P.resample(t.pixels, params, 10)


NEAR = """,
mask AS (SELECT series_id, position, y, x FROM pixels WHERE valid AND brightness > 0.45),
touch AS (
  SELECT series_id, position, y + dy AS y, x + dx AS x, count(*) AS n, bool_or(dy = 0 AND dx = 0) AS own
  FROM mask, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY 1, 2, 3, 4)"""


@query(
    "b15_erode_dilate_edge",
    f"""WITH {PIXELS}{NEAR}
    SELECT series_id, position, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 'eroded' AS kind FROM touch WHERE n = 9
    UNION ALL SELECT series_id, position, CAST(y AS INTEGER), CAST(x AS INTEGER), 'dilated' FROM touch
    UNION ALL SELECT series_id, position, CAST(y AS INTEGER), CAST(x AS INTEGER), 'edge' FROM touch WHERE own AND n < 9""",
)
def erode_dilate_edge(t):
    mask = t.pixels.where("valid and brightness > 0.45").select(*FRAME, "y", "x")
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return (
        tag(P.eroded(mask, FRAME), "eroded")
        .unionByName(tag(P.dilated(mask, FRAME), "dilated"))
        .unionByName(tag(P.edge_of(mask, FRAME), "edge"))
    )


@query(
    "b16_relative_dark",
    f"""WITH {SUPPORT}
    SELECT p.series_id, p.position, count(*) AS pixels, count(*) FILTER (brightness < 0.9 * g) AS dark,
           count(*) FILTER (g IS NULL) AS no_reference
    FROM pixels p LEFT JOIN whole USING (series_id, position) GROUP BY 1, 2""",
)
def relative_dark(t):
    rows = with_whole(t.pixels, whole_trace(t.pixels, t.frames))
    dark = P.relative_dark(F.col("brightness"), F.col("whole"), 0.9)
    return rows.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(dark).alias("dark"), F.count_if(dark.isNull()).alias("no_reference")
    )


BRIGHT = SUPPORT + """,
scales AS (
  SELECT series_id, position, CASE WHEN 1.4826 * median(abs(brightness - g)) > 1e-12
                                   THEN 1.4826 * median(abs(brightness - g)) END AS scale
  FROM fixed_px JOIN whole USING (series_id, position) GROUP BY 1, 2),
lit AS (
  SELECT p.*, f.y IS NOT NULL AS fixed, g, scale, brightness > g + 1.0 * scale AS bright
  FROM pixels p LEFT JOIN fixed f ON f.series_id = p.series_id AND f.y = p.y AND f.x = p.x
  LEFT JOIN whole w ON w.series_id = p.series_id AND w.position = p.position
  LEFT JOIN scales s ON s.series_id = p.series_id AND s.position = p.position
  WHERE observed)"""


@query(
    "b17_relative_bright",
    f"""WITH {BRIGHT}
    SELECT series_id, position, {r6("max(scale)")} AS scale, count(*) FILTER (bright) AS bright,
           count(*) FILTER (bright AND fixed) AS bright_on_support
    FROM lit GROUP BY 1, 2""",
)
def relative_bright(t):
    return bright_state(t.pixels, t.frames, 1.0).groupBy(*FRAME).agg(
        F.max("scale").alias("scale"),
        F.count_if("bright").alias("bright"),
        F.count_if(F.col("bright") & F.col("fixed")).alias("bright_on_support"),
    )


@query(
    "b18_polar_profile",
    f"""WITH {PIXELS}, rims AS (
      SELECT series_id, position, CAST(round(((atan2(y - 3.5, x - 3.5) + 2 * pi()) % (2 * pi())) / (2 * pi() / 16)) AS INTEGER) % 16 AS ray,
             max(sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))) AS outline
      FROM pixels WHERE in_mask GROUP BY 1, 2, 3),
    grid AS (SELECT *, k / 11.0 AS u, round(3.5 + k / 11.0::DOUBLE * outline * cos(ray * (2 * pi() / 16)), 9) AS sx,
                    round(3.5 + k / 11.0::DOUBLE * outline * sin(ray * (2 * pi() / 16)), 9) AS sy
             FROM rims, range(12) AS r(k)),
    corner AS (SELECT g.*, CAST(floor(sy) + a AS INTEGER) AS y, CAST(floor(sx) + b AS INTEGER) AS x
               FROM grid g, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
    w AS (SELECT c.*, (1 - abs(sx - c.x)) * (1 - abs(sy - c.y)) AS w,
                 abs(sx - c.x) <= 0.5 AND abs(sy - c.y) <= 0.5 AS near, q.brightness, q.valid
          FROM corner c LEFT JOIN pixels q ON q.series_id = c.series_id AND q.position = c.position AND q.y = c.y AND q.x = c.x
          WHERE (1 - abs(sx - c.x)) * (1 - abs(sy - c.y)) > 1e-9),
    s AS (SELECT series_id, position, ray, k, CAST(k AS DOUBLE) / 11 AS u, sum(w * brightness) AS raw,
                 coalesce(bool_and(CASE WHEN near THEN coalesce(valid, false) END), false)
                   AND CAST(k AS DOUBLE) / 11 BETWEEN 0.08 AND 0.92 AND sum(w * brightness) IS NOT NULL AS ok
          FROM w GROUP BY 1, 2, 3, 4),
    sc AS (SELECT series_id, position, ray, median(raw) AS scale FROM s WHERE ok GROUP BY 1, 2, 3)
    SELECT s.series_id, s.position, s.ray, CAST(k AS INTEGER) AS k, {r6("u")} AS u,
           {r6("CASE WHEN scale >= 0.05 THEN raw / scale ELSE raw END")} AS "value",
           ok AND coalesce(scale >= 0.05, false) AS supported
    FROM s LEFT JOIN sc ON sc.series_id = s.series_id AND sc.position = s.position AND sc.ray = s.ray""",
)
def polar_profile(t):
    return P.polar_profile(t.pixels, SIDE, 16, 12)


KERNEL = [0.25, 0.5, 0.25]
EDGES = PROFILES + """,
held AS (
  SELECT *, CASE WHEN supported AND value IS NOT NULL THEN k END AS hk,
         CASE WHEN supported THEN value END AS hv FROM profiles),
around AS (
  SELECT *, last_value(hk IGNORE NULLS) OVER b AS ak, last_value(hv IGNORE NULLS) OVER b AS av,
         first_value(hk IGNORE NULLS) OVER f AS bk, first_value(hv IGNORE NULLS) OVER f AS bv,
         count(hk) OVER (PARTITION BY vec_id) AS have
  FROM held WINDOW b AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   f AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT *, CASE WHEN have < 8 THEN 0.0 WHEN hk IS NOT NULL THEN value
                 WHEN ak IS NOT NULL AND bk IS NOT NULL THEN av + (bv - av) * ((k - ak) / (bk - ak)::DOUBLE)
                 ELSE coalesce(av, bv) END AS fill FROM around),
smoothed AS (
  SELECT *, 0.25 * coalesce(lag(fill) OVER w, fill) + 0.5 * fill + 0.25 * coalesce(lead(fill) OVER w, fill) AS s
  FROM filled WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
edges AS (
  SELECT *, CASE WHEN supported THEN abs(CASE WHEN lag(s) OVER w IS NULL THEN lead(s) OVER w - s
                                              WHEN lead(s) OVER w IS NULL THEN s - lag(s) OVER w
                                              ELSE (lead(s) OVER w - lag(s) OVER w) / 2 END) END AS edge
  FROM smoothed WINDOW w AS (PARTITION BY vec_id ORDER BY k))"""


def edge_profiles(t):
    return P.edge_strength(t.profiles, ["series_id", "sector", "vec_id"], "k", "value", "supported", KERNEL)


@query(
    "b19_edge_strength",
    f"""WITH {EDGES} SELECT vec_id, CAST(k AS INTEGER) AS k, {r6("edge")} AS edge FROM edges""",
)
def edge_strength(t):
    return edge_profiles(t).select("vec_id", "k", "edge")


@query(
    "b20_sector_median",
    f"""WITH {EDGES}
    SELECT sector, CAST(k AS INTEGER) AS k, series_id // 8 AS profile_set, {r6("median(edge)")} AS edge
    FROM edges GROUP BY 1, 2, 3""",
)
def sector_median(t):
    # A sector's rays in one profile set: a fixed number, so the built-in median is bounded.
    return edge_profiles(t).groupBy("sector", "k", F.floor(F.col("series_id") / 8).alias("profile_set")).agg(
        F.median("edge").alias("edge")
    )
