"""Sector, zone and frame-pair queries (families D16-D29, D35-D37, D39-D44, E1, E14-E16)."""

from pyspark.sql import functions as F

from gyre.operators import pixels as P
from gyre.operators import regions as G
from gyre.operators.evidence import weighted_quantile
from gyre.plans.pixel_queries import OCTANT, QUADRANT, R, SECTORS, level
from gyre.plans.registry import query, r6
from gyre.plans.views import BAND, PIXELS, SIDE

FRAME = ["series_id", "position"]

MED = PIXELS + f""",
oct AS (SELECT *, {SECTORS}[{OCTANT} + 1] AS sector, {BAND} AS band FROM pixels WHERE observed AND valid AND in_mask),
med AS (SELECT series_id, position, sector, band, median(brightness) AS m FROM oct GROUP BY 1, 2, 3, 4),
con AS (SELECT a.series_id, a.position, a.sector, a.band || '-' || b.band AS pair, ln(a.m) - ln(b.m) AS signed,
               abs(ln(a.m) - ln(b.m)) AS sep
        FROM med a JOIN med b ON b.series_id = a.series_id AND b.position = a.position AND b.sector = a.sector
         AND (a.band || '-' || b.band) IN ('inner-middle', 'middle-outer', 'inner-outer') WHERE a.m > 0 AND b.m > 0)"""

SPREAD = """,
dq AS (SELECT series_id, position, count(sep) AS n, quantile_cont(sep, 0.25) AS a, median(sep) AS b,
              quantile_cont(sep, 0.75) AS c, quantile_cont(sep, 0.9) AS d FROM con WHERE pair = 'inner-middle' GROUP BY 1, 2),
dm AS (SELECT series_id, position, median(abs(sep - b)) AS mad FROM con JOIN dq USING (series_id, position)
       WHERE pair = 'inner-middle' GROUP BY 1, 2)"""


def medians(t):
    px = t.pixels.withColumn("sector", P.octant(SIDE)).withColumn("band", P.radial_band(SIDE, SIDE))
    return G.sector_medians(px, "sector", "band")


def contrast(t, inner, outer):
    return G.sector_contrast(medians(t), "sector", "band", inner, outer)


@query(
    "d16_sector_distribution",
    f"""WITH {MED}{SPREAD}
    SELECT series_id, position, n AS finite_sectors, {r6("a")} AS q25, {r6("b")} AS q50, {r6("c")} AS q75, {r6("d")} AS q90,
           {r6("mad")} AS mad, {r6("c - a")} AS iqr FROM dq JOIN dm USING (series_id, position)""",
)
def sector_distribution(t):
    return G.distribution(contrast(t, "inner", "middle"), FRAME, "separation")


@query(
    "d17_sector_contrast_trace",
    f"""WITH {MED}{SPREAD}, top AS (
      SELECT series_id, position, sector, sep, row_number() OVER (PARTITION BY series_id, position ORDER BY sep DESC, sector DESC) AS k
      FROM con WHERE pair = 'inner-middle')
    SELECT series_id, position, n AS finite_sectors, {r6("a")} AS q25, {r6("b")} AS q50, {r6("c")} AS q75, {r6("d")} AS q90,
           {r6("c - a")} AS iqr, {r6("mad")} AS mad, sector AS strongest_sector, {r6("sep")} AS strongest_separation
    FROM dq JOIN dm USING (series_id, position) JOIN top USING (series_id, position) WHERE k = 1""",
)
def sector_contrast_trace(t):
    return G.contrast_frames(contrast(t, "inner", "middle"), "sector")


@query(
    "d18_multiscale_consensus",
    f"""WITH {MED}
    SELECT series_id, position, sector, {r6("median(sep)")} AS separation, {r6("median(signed)")} AS signed,
           CASE WHEN count(sep) >= 2 THEN {r6("max(sep) - min(sep)")} END AS scale_spread
    FROM con GROUP BY 1, 2, 3""",
)
def multiscale_consensus(t):
    m = medians(t)
    pairs = (("inner", "middle"), ("middle", "outer"), ("inner", "outer"))
    scales = [G.sector_contrast(m, "sector", "band", a, b) for a, b in pairs]
    return G.multiscale(scales[0].unionByName(scales[1]).unionByName(scales[2]), "sector")


@query(
    "d19_joint_nested",
    f"""WITH {MED}, j AS (
      SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.position, b.position) AS position,
             a.sep AS sa, b.sep AS sb, CASE WHEN a.sep IS NOT NULL AND b.sep IS NOT NULL THEN least(a.sep, b.sep) END AS j,
             CASE WHEN a.signed IS NULL OR b.signed IS NULL THEN NULL WHEN a.signed = 0 OR b.signed = 0 THEN 'tied'
                  WHEN a.signed > 0 AND b.signed > 0 THEN 'monotonic_light_to_dark_outward'
                  WHEN a.signed < 0 AND b.signed < 0 THEN 'monotonic_dark_to_light_outward'
                  WHEN a.signed > 0 THEN 'inner_local_minimum' ELSE 'inner_local_maximum' END AS st
      FROM (SELECT * FROM con WHERE pair = 'inner-middle') a FULL JOIN (SELECT * FROM con WHERE pair = 'middle-outer') b
        ON b.series_id = a.series_id AND b.position = a.position AND b.sector = a.sector),
    f AS (SELECT series_id, position, count(j) AS n, quantile_cont(j, 0.25) AS a, median(j) AS b, median(sa) AS ma, median(sb) AS mb,
                 {", ".join(f"count(*) FILTER (st = '{s}') / nullif(count(st), 0) AS share_{s}" for s in G.ORDERINGS)}
          FROM j GROUP BY 1, 2)
    SELECT series_id, position, n AS finite_sectors, {r6("a")} AS q25, {r6("b")} AS q50, {r6("ma")} AS first_median,
           {r6("mb")} AS second_median, {", ".join(f"{r6('share_' + s)} AS share_{s}" for s in G.ORDERINGS)},
           CASE WHEN ma IS NOT NULL AND mb IS NOT NULL THEN {r6("least(ma, mb)")} END AS pairwise_weakest,
           CASE WHEN ma IS NOT NULL AND mb IS NOT NULL THEN {r6("least(ma, mb) - b")} END AS joint_penalty,
           {r6("b - a")} AS coverage_gap
    FROM f""",
)
def joint_nested(t):
    m = medians(t)
    first = G.sector_contrast(m, "sector", "band", "inner", "middle")
    second = G.sector_contrast(m, "sector", "band", "middle", "outer")
    return G.joint_nested(first, second, "sector")


SPREADS = PIXELS + f""",
bp AS (SELECT *, {BAND} AS band FROM pixels WHERE observed AND valid AND in_mask),
bm AS (SELECT series_id, position, band, median(brightness) AS m, count(*) AS n FROM bp GROUP BY 1, 2, 3),
bs AS (SELECT series_id, position, band, max(n) AS n, max(m) AS m,
              CASE WHEN max(n) >= 3 AND max(m) > 0 THEN 1.4826 * median(abs(brightness - m)) / max(m) END AS s
       FROM bp JOIN bm USING (series_id, position, band) GROUP BY 1, 2, 3)"""


def band_spread(t):
    rows = t.pixels.where("observed and valid and in_mask").withColumn("band", P.radial_band(SIDE, SIDE))
    return rows, G.fractional_spread(rows, FRAME + ["band"])


@query(
    "d20_fractional_spread",
    f"""WITH {SPREADS} SELECT series_id, position, band, n AS samples, {r6("s")} AS spread FROM bs""",
)
def fractional_spread(t):
    return band_spread(t)[1]


@query(
    "d21_standardised_contrast",
    f"""WITH {SPREADS}, p AS (
      SELECT a.series_id, a.position, abs(ln(a.m) - ln(b.m)) AS sep, a.s AS sa, b.s AS sb,
             sqrt((a.s * a.s + b.s * b.s) / 2.0) AS sc
      FROM bs a JOIN bs b ON b.series_id = a.series_id AND b.position = a.position AND a.band = 'inner' AND b.band = 'middle')
    SELECT series_id, position, {r6("sep")} AS separation, CASE WHEN sc > 0 THEN {r6("sep / sc")} END AS standardised,
           CASE WHEN sep IS NULL OR sa IS NULL OR sb IS NULL THEN 'gap' WHEN sc <= 0 THEN 'zero_spread_scale' ELSE 'ok' END AS status
    FROM p""",
)
def standardised_contrast(t):
    rows, spread = band_spread(t)
    med = rows.groupBy(*FRAME, "band").agg(F.median("brightness").alias("m")).join(spread, FRAME + ["band"])
    side = lambda b, s: med.where(F.col("band") == b).select(*FRAME, F.ln("m").alias(f"l{s}"), F.col("spread").alias(f"s{s}"))
    both = side("inner", "a").join(side("middle", "b"), FRAME)
    both = both.withColumn("separation", F.abs(F.col("la") - F.col("lb")))
    value, status = G.standardised(F.col("separation"), F.col("sa"), F.col("sb"))
    return both.select(*FRAME, "separation", value.alias("standardised"), status.alias("status"))


@query(
    "d24_weighted_quantile",
    f"""WITH v AS (SELECT l_returnflag AS flag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem
                   WHERE l_quantity > 0 GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY flag ORDER BY x) AS cum, sum(w) OVER (PARTITION BY flag) AS tot,
                 count(*) OVER (PARTITION BY flag) AS n FROM v),
    b AS (SELECT *, lag(cum) OVER (PARTITION BY flag ORDER BY x) AS pc, lag(x) OVER (PARTITION BY flag ORDER BY x) AS px FROM c),
    q AS (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q)
    SELECT flag, q, {r6("CASE WHEN pc IS NULL THEN x ELSE px + (x - px) * (q * tot - pc) / (cum - pc) END")} AS "value"
    FROM b, q WHERE n >= 2 AND q * tot <= cum AND (pc IS NULL OR q * tot > pc)""",
)
def weighted(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    return weighted_quantile(rows, ["flag"], "x", "w", [0.1, 0.5, 0.9])


@query(
    "d25_midrank_percentile",
    f"""WITH {PIXELS}, r AS (
      SELECT *, rank() OVER (PARTITION BY series_id, position ORDER BY brightness) - 1 AS b,
             count(*) OVER (PARTITION BY series_id, position, brightness) AS c,
             count(*) OVER (PARTITION BY series_id, position) AS n FROM pixels WHERE valid AND in_mask)
    SELECT series_id, position, y, x, {r6("(2 * b + c) / (2.0 * n)")} AS percentile FROM r""",
)
def midrank(t):
    return G.midrank_percentile(t.pixels.where("valid and in_mask"), FRAME, "brightness").select(*FRAME, "y", "x", "percentile")


ZONES = f"""SELECT *, unnest([{BAND}, {QUADRANT}, 'whole']) AS zone FROM pixels"""
STATUS = """CASE WHEN zone = 'centre' AND series_id % 3 = 0 THEN 'unavailable' WHEN zone = 'outer' THEN 'review' ELSE 'ok' END"""


@query(
    "d26_zone_brightness",
    f"""WITH {PIXELS}, z AS ({ZONES}), s AS (SELECT *, {STATUS} AS st FROM z)
    SELECT series_id, position, zone, any_value(st) AS zone_status,
           {r6("any_value(CASE st WHEN 'ok' THEN 1.0 WHEN 'review' THEN 0.5 ELSE 0.0 END)")} AS confidence,
           count(*) FILTER (valid AND in_mask AND st <> 'unavailable') AS pixels,
           {r6("avg(brightness) FILTER (valid AND in_mask AND st <> 'unavailable')")} AS mean
    FROM s GROUP BY 1, 2, 3""",
)
def zone_brightness(t):
    zones = F.array(P.radial_band(SIDE, SIDE), P.quadrant(SIDE), F.lit("whole"))
    zone = F.col("zone")
    status = (
        F.when((zone == "centre") & (F.pmod("series_id", F.lit(3)) == 0), "unavailable")
        .when(zone == "outer", "review")
        .otherwise("ok")
    )
    confidence = F.when(F.col("zone_status") == "ok", 1.0).when(F.col("zone_status") == "review", 0.5).otherwise(0.0)
    return G.zone_brightness(t.pixels, zones, status, confidence)


ZONES = f"""WITH {PIXELS}, act AS (
      SELECT series_id, position, y, x, brightness,
             (2 * (rank() OVER (PARTITION BY series_id, position ORDER BY brightness) - 1)
              + count(*) OVER (PARTITION BY series_id, position, brightness))
             / (2.0 * count(*) OVER (PARTITION BY series_id, position)) AS p
      FROM pixels WHERE observed AND valid AND in_mask),
    sp AS (SELECT series_id, position, median(brightness) AS med, quantile_cont(brightness, 0.75) - quantile_cont(brightness, 0.25) AS iqr
           FROM act GROUP BY 1, 2),
    base AS (SELECT series_id, position, y, x FROM pixels WHERE observed AND {R} < 0.7),
    mv AS (SELECT unnest([0, 0, 0, 1, -1]) AS dy, unnest([0, 1, -1, 0, 0]) AS dx),
    t1 AS (SELECT series_id, position, y + dy AS y, x + dx AS x, count(*) AS n FROM base, mv GROUP BY 1, 2, 3, 4),
    e1 AS (SELECT * FROM t1 WHERE n = 5),
    t2 AS (SELECT series_id, position, y + dy AS y, x + dx AS x, count(*) AS n FROM e1, mv GROUP BY 1, 2, 3, 4),
    v AS (SELECT series_id, position, y, x, 'b' AS k FROM base UNION ALL SELECT series_id, position, y, x, 'i' FROM e1
          UNION ALL SELECT series_id, position, y, x, 'j' FROM t2 WHERE n = 5 UNION ALL SELECT series_id, position, y, x, 'o' FROM t1),
    g AS (SELECT series_id, position, avg(p) FILTER (k = 'b') AS b, avg(p) FILTER (k = 'i') AS i, avg(p) FILTER (k = 'j') AS j,
                 avg(p) FILTER (k = 'o') AS o, avg(brightness) FILTER (k = 'b') AS bv
          FROM v JOIN act USING (series_id, position, y, x) GROUP BY 1, 2)"""


@query(
    "d27_zone_sensitivity",
    f"""{ZONES}
    SELECT series_id, position, {r6("b")} AS baseline_percentile, {r6("bv")} AS baseline_mean, {r6("i - b")} AS delta_inset_1, {r6("j - b")} AS delta_inset_2,
           {r6("o - b")} AS delta_outset_1, CASE WHEN iqr > 1e-12 THEN {r6("(bv - med) / iqr")} END AS centred_over_iqr
    FROM g JOIN sp USING (series_id, position)""",
)
def zone_sensitivity(t):
    return G.zone_sensitivity(t.pixels, P.chebyshev(SIDE, SIDE) < 0.7)


@query(
    "d27_zone_summary",
    f"""{ZONES}, d AS (SELECT series_id, bv, b, i - b AS i, j - b AS j, o - b AS o FROM g JOIN sp USING (series_id, position))
    SELECT series_id, count(bv) AS valid_frames, {r6("max(bv) - min(bv)")} AS mean_range, {r6("max(b) - min(b)")} AS percentile_range,
           count(i) AS comparable_inset_1, {r6("median(abs(i))")} AS median_abs_inset_1, {r6("max(abs(i))")} AS max_abs_inset_1,
           count(j) AS comparable_inset_2, {r6("median(abs(j))")} AS median_abs_inset_2, {r6("max(abs(j))")} AS max_abs_inset_2,
           count(o) AS comparable_outset_1, {r6("median(abs(o))")} AS median_abs_outset_1, {r6("max(abs(o))")} AS max_abs_outset_1
    FROM d GROUP BY 1""",
)
def zone_summary(t):
    return G.zone_summary(G.zone_sensitivity(t.pixels, P.chebyshev(SIDE, SIDE) < 0.7), ["series_id"])


STEP = PIXELS + """,
hop AS (SELECT a.series_id, a.position, a.y, a.x, a.brightness AS va, b.brightness AS vb, a.valid AND a.in_mask AS oka,
               b.valid AND b.in_mask AS okb
        FROM pixels a JOIN pixels b ON b.series_id = a.series_id AND b.position = a.position + 1 AND b.y = a.y AND b.x = a.x
        WHERE a.observed AND b.observed)"""
MEASURES = (
    "dark_before dark_after bright_before bright_after dark_switch bright_switch dark_to_bright bright_to_dark "
    "median_signed_change median_abs_change p90_abs_change"
).split()


@query(
    "d28_grid_transition",
    f"""WITH {STEP}, fr AS (
      SELECT series_id, position, median(va) AS ga, median(vb) AS gb, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
      FROM hop WHERE oka AND okb GROUP BY 1, 2),
    c AS (SELECT series_id, position, CAST(ceil((y - y0 + 1) * 2 / (y1 - y0 + 1)) - 1 AS INTEGER) AS "row",
                 CAST(ceil((x - x0 + 1) * 2 / (x1 - x0 + 1)) - 1 AS INTEGER) AS col, va / ga < 0.7 AS da, vb / gb < 0.7 AS db,
                 va / ga > 1.3 AS ba, vb / gb > 1.3 AS bb, vb / gb - va / ga AS d
          FROM hop JOIN fr USING (series_id, position) WHERE oka AND okb),
    m AS (SELECT series_id, position, "row", col, count(*) AS pixels, avg(da::INT) AS dark_before, avg(db::INT) AS dark_after,
                 avg(ba::INT) AS bright_before, avg(bb::INT) AS bright_after, avg((da <> db)::INT) AS dark_switch,
                 avg((ba <> bb)::INT) AS bright_switch, avg((da AND bb)::INT) AS dark_to_bright, avg((ba AND db)::INT) AS bright_to_dark,
                 median(d) AS median_signed_change, median(abs(d)) AS median_abs_change, quantile_cont(abs(d), 0.9) AS p90_abs_change
          FROM c GROUP BY 1, 2, 3, 4)
    SELECT series_id, position, "row", col, pixels, CASE WHEN pixels >= 12 THEN 'observed' ELSE 'unavailable' END AS status,
           {", ".join(f"CASE WHEN pixels >= 12 THEN {r6(c)} END AS {c}" for c in MEASURES)}
    FROM m""",
)
def grid_transition(t):
    return G.grid_transition(t.pixels, 2, 12)


@query(
    "d29_mask_iou",
    f"""WITH {STEP}, m AS (SELECT *, oka AND va > 0.5 AS ma, okb AND vb > 0.5 AS mb FROM hop)
    SELECT series_id, position, count(*) FILTER (ma AND mb) AS intersection, count(*) FILTER (ma OR mb) AS union_pixels,
           {r6("count(*) FILTER (ma AND mb) / greatest(count(*) FILTER (ma OR mb), 1)")} AS iou
    FROM m GROUP BY 1, 2""",
)
def mask_iou(t):
    return G.mask_iou(t.pixels, F.col("valid") & F.col("in_mask") & (F.col("brightness") > 0.5))


@query(
    "d35_blockiness",
    f"""WITH {PIXELS}, s AS (
      SELECT series_id, position, x % 4 = 3 AS e, abs(lead(brightness) OVER (PARTITION BY series_id, position, y ORDER BY x) - brightness) AS s FROM pixels
      UNION ALL
      SELECT series_id, position, y % 4 = 3, abs(lead(brightness) OVER (PARTITION BY series_id, position, x ORDER BY y) - brightness) FROM pixels)
    SELECT series_id, position, {r6("median(s) FILTER (e) / greatest(median(s) FILTER (NOT e), 1e-6)")} AS blockiness
    FROM s WHERE s IS NOT NULL GROUP BY 1, 2""",
)
def blockiness(t):
    # The published block of 8 equals this canvas; 4 gives one inner boundary each way.
    return G.blockiness(t.pixels, 4)


RGB = """rgb AS (
  SELECT vec_id, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x,
         greatest(0, least(255, floor((CAST(embedding[k + 1] AS DOUBLE) + 0.5) * 255))) AS r,
         greatest(0, least(255, floor((CAST(embedding[(k + 1) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS g,
         greatest(0, least(255, floor((CAST(embedding[(k + 2) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS b
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings))"""


def rgb(t):
    return t.vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        "vec_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"),
        level(0).alias("r"), level(1).alias("g"), level(2).alias("b"),
    )


@query(
    "d36_clipping",
    f"""WITH {RGB}, c AS (SELECT vec_id, {", ".join(f"avg(({c} <= 1)::INT) AS low_{c}, avg(({c} >= 254)::INT) AS high_{c}" for c in "rgb")}
                         FROM rgb GROUP BY 1)
    SELECT vec_id, {", ".join(f"{r6(f'low_{c}')} AS low_{c}, {r6(f'high_{c}')} AS high_{c}" for c in "rgb")},
           {r6("greatest(low_r, low_g, low_b, high_r, high_g, high_b)")} AS max_channel_fraction FROM c""",
)
def clipping(t):
    return G.clipping(rgb(t), ["vec_id"])


@query(
    "d37_background_reference",
    f"""WITH {RGB}, m AS (SELECT vec_id, y, x FROM rgb WHERE r > 170),
    mv AS (SELECT unnest([0, 0, 0, 1, -1]) AS dy, unnest([0, 1, -1, 0, 0]) AS dx),
    d AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM m, mv),
    b AS (SELECT vec_id, count(*) AS n, median(r) AS mr, median(g) AS mg, median(b) AS mb
          FROM rgb r ANTI JOIN d USING (vec_id, y, x) GROUP BY 1)
    SELECT vec_id, n AS background_pixels, {r6("mr")} AS median_r, {r6("mg")} AS median_g, {r6("mb")} AS median_b,
           {r6("n / 64")} AS background_fraction, 'ok' AS status
    FROM b WHERE n / 64 >= 0.2 AND n >= 10
    UNION ALL SELECT vec_id, coalesce(n, 0), NULL, NULL, NULL, {r6("coalesce(n, 0) / 64")}, 'too_little_background'
    FROM (SELECT DISTINCT vec_id FROM rgb) LEFT JOIN b USING (vec_id) WHERE coalesce(n, 0) / 64 < 0.2 OR coalesce(n, 0) < 10""",
)
def background_reference(t):
    px = rgb(t)
    return G.background_reference(px, px.where("r > 170").select("vec_id", "y", "x"), ["vec_id"], 1, 0.2, 10)


STRIP = f"""CASE WHEN {R} >= 0.45 - 0.01 - 0.2 AND {R} < 0.45 - 0.01 THEN 'inside'
                 WHEN {R} > 0.45 + 0.01 AND {R} <= 0.45 + 0.01 + 0.2 THEN 'outside' END"""


@query(
    "d43_strip_trace",
    f"""WITH {PIXELS}, s AS (SELECT *, {STRIP} AS side FROM pixels WHERE in_mask),
    f AS (SELECT series_id, position, side, median(brightness) FILTER (observed AND valid) AS v,
                 CASE WHEN bool_and(observed) THEN count(*) FILTER (valid) END AS n,
                 CASE WHEN bool_and(observed) THEN count(*) FILTER (valid) / count(*) END AS fr
          FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3)
    SELECT series_id, position, side, {r6("v")} AS "value", n AS support_pixels, {r6("fr")} AS support_fraction,
           min(n) OVER (PARTITION BY series_id, side) AS min_support_pixels,
           {r6("min(fr) OVER (PARTITION BY series_id, side)")} AS min_support_fraction,
           count(v) OVER (PARTITION BY series_id, side) AS frames
    FROM f""",
)
def strip_trace(t):
    px = t.pixels.withColumn("side", P.boundary_strip(P.chebyshev(SIDE, SIDE), 0.45, 0.2))
    frames, series = G.strip_trace(px, "side")
    return frames.join(series, ["series_id", "side"])


@query(
    "d44_tier_profile",
    f"""WITH {MED}{SPREAD}, f AS (SELECT *, c - a AS iqr FROM dq JOIN dm USING (series_id, position)),
    best AS (SELECT series_id, position, b - a AS g, row_number() OVER (PARTITION BY series_id ORDER BY b - a DESC, position) AS k FROM f)
    SELECT series_id, {r6("median(a)")} AS q25_frame_q50, {r6("median(b)")} AS q50_frame_q50, {r6("median(c)")} AS q75_frame_q50,
           {r6("median(d)")} AS q90_frame_q50, {r6("median(iqr)")} AS iqr_frame_q50, {r6("median(mad)")} AS mad_frame_q50,
           {r6("max(g)")} AS max_coverage_gap, max(best.position) AS max_coverage_gap_position
    FROM f JOIN best USING (series_id) WHERE k = 1 GROUP BY 1""",
)
def tier_profile(t):
    return G.tier_profile(G.contrast_frames(contrast(t, "inner", "middle"), "sector"))


@query(
    "e1_contrast_trace",
    f"""WITH {PIXELS}, m AS (
      SELECT series_id, position, {BAND} AS band, median(brightness) FILTER (observed AND valid AND in_mask) AS v FROM pixels GROUP BY 1, 2, 3)
    SELECT a.series_id, a.position, CASE WHEN a.v > 0 AND b.v > 0 THEN 'ok' ELSE 'gap' END AS status,
           CASE WHEN a.v > 0 AND b.v > 0 THEN {r6("ln(a.v) - ln(b.v)")} END AS signed_log_contrast,
           CASE WHEN a.v > 0 AND b.v > 0 THEN {r6("abs(ln(a.v) - ln(b.v))")} END AS separation
    FROM m a JOIN m b ON b.series_id = a.series_id AND b.position = a.position AND a.band = 'inner' AND b.band = 'outer'""",
)
def contrast_trace(t):
    from gyre.operators.pairing import contrast_trace as contrast_of

    ok = F.col("observed") & F.col("valid") & F.col("in_mask")
    m = t.pixels.groupBy(*FRAME, P.radial_band(SIDE, SIDE).alias("band")).agg(
        F.median(F.when(ok, F.col("brightness"))).alias("v")
    )
    return contrast_of(m.where("band = 'inner'"), m.where("band = 'outer'"), FRAME, "v", logs=True)


TILES = STEP + """,
ok1 AS (SELECT * FROM pixels WHERE observed AND valid AND in_mask),
ok AS (SELECT p.series_id, p.position, p.y, p.x, p.brightness, n.brightness AS b FROM ok1 p JOIN ok1 n ON n.y = p.y AND n.x = p.x AND n.series_id = p.series_id AND n.position = p.position + 1),
box AS (SELECT series_id, position, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ok GROUP BY 1, 2),
ref AS (SELECT o.series_id, o.position, y, x, brightness AS a, CAST(ceil((y - y0 + 1) * 2 / (y1 - y0 + 1)) - 1 AS INTEGER) AS r,
               CAST(ceil((x - x0 + 1) * 2 / (x1 - x0 + 1)) - 1 AS INTEGER) AS c, x0, x1, y0, y1
        FROM ok o JOIN box USING (series_id, position)),
off AS (SELECT CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx FROM range(-1, 2) AS p(dy), range(-1, 2) AS q(dx)),
sc AS (SELECT f.series_id, f.position, r, c, dy, dx, count(*) AS n, stddev_pop(f.a) AS sa, stddev_pop(t.b) AS sb,
              covar_pop(f.a, t.b) AS cv
       FROM ref f, off JOIN ok t ON t.series_id = f.series_id AND t.position = f.position AND t.y = f.y + dy AND t.x = f.x + dx
       WHERE y0 + floor((y1 - y0 + 1) * r / 2) + dy >= 0 AND x0 + floor((x1 - x0 + 1) * c / 2) + dx >= 0
         AND y0 + floor((y1 - y0 + 1) * (r + 1) / 2) + dy <= 8 AND x0 + floor((x1 - x0 + 1) * (c + 1) / 2) + dx <= 8
       GROUP BY 1, 2, 3, 4, 5, 6),
gd AS (SELECT *, round(cv / (sa * sb), 9) AS ncc FROM sc WHERE n >= 8 AND sa >= 0.0015 AND sb >= 0.0015),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, position, r, c ORDER BY ncc DESC, dy DESC, dx DESC) AS k FROM gd),
bst AS (SELECT * FROM rk WHERE k = 1),
snd AS (SELECT k.series_id, k.position, k.r, k.c,
               coalesce(max(k.ncc) FILTER ((k.dy - b.dy) * (k.dy - b.dy) + (k.dx - b.dx) * (k.dx - b.dx) >= 4), max(k.ncc)) AS s
        FROM rk k JOIN bst b ON b.series_id = k.series_id AND b.position = k.position AND b.r = k.r AND b.c = k.c
        WHERE k.k > 1 GROUP BY 1, 2, 3, 4),
tl AS (SELECT DISTINCT series_id, position, r, c FROM ref),
tiles AS (
  SELECT l.series_id, l.position, l.r, l.c, b.ncc AS best, z.ncc AS zero, coalesce(b.ncc - s.s, 1.0) AS margin, b.n, b.dx, b.dy,
         CASE WHEN b.ncc IS NULL THEN 'unavailable' WHEN b.ncc >= 0.25 AND coalesce(b.ncc - s.s, 1.0) >= 0.035 THEN 'measured'
              ELSE 'ambiguous' END AS status
  FROM tl l LEFT JOIN bst b ON b.series_id = l.series_id AND b.position = l.position AND b.r = l.r AND b.c = l.c
  LEFT JOIN snd s ON s.series_id = l.series_id AND s.position = l.position AND s.r = l.r AND s.c = l.c
  LEFT JOIN gd z ON z.series_id = l.series_id AND z.position = l.position AND z.r = l.r AND z.c = l.c AND z.dy = 0 AND z.dx = 0)"""


def tiles(t):
    return G.patch_shift(t.pixels, 2, 1, 8, 0.0015)


@query(
    "e14_patch_shift",
    f"""WITH {TILES}
    SELECT series_id, position, r AS "row", c AS col, status, CASE WHEN status = 'measured' THEN dx END AS dx,
           CASE WHEN status = 'measured' THEN dy END AS dy, {r6("best")} AS best_ncc, {r6("zero")} AS zero_shift_ncc,
           CASE WHEN best IS NOT NULL THEN {r6("margin")} END AS margin, n AS overlap_pixels FROM tiles""",
)
def patch_shift(t):
    return tiles(t)


CLASSED = TILES + """,
rf AS (SELECT series_id, position, count(*) AS n, median(dx) AS rx, median(dy) AS ry FROM tiles
       WHERE status = 'measured' AND abs(dx) < 2 AND abs(dy) < 2 GROUP BY 1, 2),
cls AS (SELECT t.*, rf.n AS rn, rx, ry, sqrt((dx - rx) * (dx - rx) + (dy - ry) * (dy - ry)) AS res,
               CASE WHEN status <> 'measured' THEN status WHEN abs(dx) >= 2 OR abs(dy) >= 2 THEN 'search_window_limited'
                    WHEN coalesce(rf.n, 0) < 2 THEN 'no_common_reference'
                    WHEN sqrt((dx - rx) * (dx - rx) + (dy - ry) * (dy - ry)) > 1.0 THEN 'local_residual_shift'
                    ELSE 'shared_image_shift' END AS ts
        FROM tiles t LEFT JOIN rf ON rf.series_id = t.series_id AND rf.position = t.position)"""


def classified(t):
    return G.classify_tiles(tiles(t), 2, minimum=2, tolerance=1.0)


@query(
    "e15_classify_tiles",
    f"""WITH {CLASSED}
    SELECT series_id, position, r AS "row", c AS col, ts AS tile_status,
           CASE WHEN status = 'measured' AND rn >= 2 THEN {r6("res")} END AS residual,
           CASE WHEN rn >= 2 THEN {r6("rx")} END AS reference_dx, CASE WHEN rn >= 2 THEN {r6("ry")} END AS reference_dy
    FROM cls""",
)
def classify_tiles(t):
    return classified(t)


@query(
    "e16_pair_audit",
    f"""WITH {TILES}, pt AS (
      SELECT series_id, position, count(*) FILTER (status = 'measured') / 4.0 AS m, count(*) FILTER (status = 'ambiguous') / 4.0 AS a,
             count(*) FILTER (status = 'unavailable') / 4.0 AS u, count(*) FILTER (status = 'measured') AS k FROM tiles GROUP BY 1, 2),
    md AS (SELECT series_id, position, dx, dy, count(*) AS c,
                  row_number() OVER (PARTITION BY series_id, position ORDER BY count(*) DESC, dx, dy) AS o
           FROM tiles WHERE status = 'measured' GROUP BY 1, 2, 3, 4)
    SELECT p.series_id, p.position, {r6("m")} AS measured_fraction, {r6("a")} AS ambiguous_fraction, {r6("u")} AS unavailable_fraction,
           dx AS modal_dx, dy AS modal_dy, {r6("c / k")} AS coherence,
           CASE WHEN m < 0.5 THEN 'low' WHEN m >= 0.75 THEN 'high' ELSE 'intermediate' END AS match_class
    FROM pt p LEFT JOIN md ON md.series_id = p.series_id AND md.position = p.position AND o = 1""",
)
def pair_audit(t):
    return G.pair_audit(tiles(t), 4)


@query(
    "d39_tile_status_map",
    f"""WITH {CLASSED}, w AS (SELECT r AS "row", c AS col, count(*) AS observations,
        {", ".join(f"count(*) FILTER (ts = '{s}') AS {s}" for s in G.TILE_STATES)} FROM cls GROUP BY 1, 2)
    SELECT *, {r6("local_residual_shift / nullif(local_residual_shift + shared_image_shift, 0)")} AS local_fraction,
           {r6("search_window_limited / observations")} AS limited_fraction,
           {r6("(unavailable + ambiguous + no_common_reference) / observations")} AS unresolved_fraction FROM w""",
)
def tile_status_map(t):
    return G.tile_status_map(classified(t))


@query(
    "d40_overlap_bins",
    f"""WITH {STEP}, p AS (
      SELECT series_id, position, count(*) FILTER (oka AND va > 0.45 AND okb AND vb > 0.45)
               / greatest(count(*) FILTER ((oka AND va > 0.45) OR (okb AND vb > 0.45)), 1) AS iou,
             median(abs(vb - va)) FILTER (oka AND okb) AS ch
      FROM hop GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN iou < 0.45 THEN 'low' WHEN iou >= 0.55 THEN 'high' ELSE 'intermediate' END AS k FROM p)
    SELECT series_id, count(*) FILTER (k = 'low') AS low_pairs, count(*) FILTER (k = 'intermediate') AS intermediate_pairs,
           count(*) FILTER (k = 'high') AS high_pairs, {r6("median(ch) FILTER (k = 'low')")} AS low_change,
           {r6("median(ch) FILTER (k = 'intermediate')")} AS intermediate_change, {r6("median(ch) FILTER (k = 'high')")} AS high_change,
           {r6("median(ch) FILTER (k = 'low') - median(ch) FILTER (k = 'high')")} AS low_minus_high
    FROM c GROUP BY 1""",
)
def overlap_bins(t):
    iou = G.mask_iou(t.pixels, F.col("valid") & F.col("in_mask") & (F.col("brightness") > 0.45))
    pairs = G.frame_pairs(t.pixels.where("observed"), ["brightness", "valid", "in_mask"]).where(
        "valid and in_mask and next_valid and next_in_mask"
    )
    change = pairs.groupBy(*FRAME).agg(F.median(F.abs(F.col("next_brightness") - F.col("brightness"))).alias("change"))
    return G.overlap_bins(iou.join(change, FRAME, "left"), ["series_id"], 0.45, 0.55)
