"""Aggregated traces and their summaries (family D, with the pixel sequences F4, F6, F8)."""

from pyspark.sql import functions as F

from gyre.operators import pixels as P
from gyre.operators import traces as D
from gyre.plans.pixel_queries import BRIGHT
from gyre.plans.registry import query, r6
from gyre.plans.views import BAND, SIDE, STEPS, SUPPORT

FRAME = ["series_id", "position"]
BANDED = SUPPORT + f""",
banded AS (SELECT p.*, g, gs, {BAND} AS band FROM fixed_px p LEFT JOIN whole USING (series_id, position)),
dyn AS (SELECT p.*, g, {BAND} AS band FROM pixels p LEFT JOIN whole USING (series_id, position)
        WHERE observed AND valid AND in_mask)"""


def banded(t):
    return t.pixels.withColumn("band", P.radial_band(SIDE, SIDE))


@query(
    "d1_whole_trace",
    f"""WITH {SUPPORT}, n AS (SELECT series_id, position, count(*) AS n FROM fixed_px GROUP BY 1, 2),
    d AS (SELECT series_id, position, count(*) FILTER (valid AND in_mask) / nullif(count(*) FILTER (in_mask), 0) AS f
          FROM pixels WHERE observed GROUP BY 1, 2)
    SELECT f.series_id, f.position, f.observed, {r6("g")} AS whole, n AS fixed_pixels, {r6("d.f")} AS support_fraction
    FROM frames f LEFT JOIN whole USING (series_id, position) LEFT JOIN n USING (series_id, position)
    LEFT JOIN d USING (series_id, position)""",
)
def whole_trace(t):
    return D.whole_trace(t.pixels, t.frames)


@query(
    "d2_regional_trace",
    f"""WITH {BANDED}, u AS (
      SELECT series_id, position, band, 'fixed' AS mode, median(brightness) AS raw, count(*) AS pixels, max(g) AS g
      FROM banded GROUP BY 1, 2, 3
      UNION ALL SELECT series_id, position, band, 'dynamic', median(brightness), count(*), max(g) FROM dyn GROUP BY 1, 2, 3)
    SELECT series_id, position, band, mode, {r6("raw")} AS raw, pixels, {r6("g")} AS whole,
           {r6("CASE WHEN raw > 0 AND g > 0 THEN ln(raw) - ln(g) END")} AS relative FROM u""",
)
def regional_trace(t):
    px = banded(t)
    parts = [D.regional_trace(px, t.frames, "band", m).withColumn("mode", F.lit(m)) for m in ("fixed", "dynamic")]
    return parts[0].unionByName(parts[1])


@query(
    "d3_activation_summary",
    f"""WITH {STEPS}, q AS (
      SELECT series_id, count(value) AS n, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b,
             quantile_cont(value, 0.9) AS c FROM steps GROUP BY 1),
    m AS (SELECT series_id, median(abs(value - b)) AS m FROM steps JOIN q USING (series_id) GROUP BY 1)
    SELECT series_id, n AS finite, CASE WHEN n >= 3 THEN 'ok' ELSE 'unavailable' END AS status,
           CASE WHEN n >= 3 THEN {r6("a")} END AS q10, CASE WHEN n >= 3 THEN {r6("b")} END AS q50,
           CASE WHEN n >= 3 THEN {r6("c")} END AS q90, CASE WHEN n >= 3 THEN {r6("c - b")} END AS bright_excursion,
           CASE WHEN n >= 3 THEN {r6("b - a")} END AS dark_excursion,
           CASE WHEN n >= 3 THEN {r6("c - a")} END AS total_excursion,
           CASE WHEN n >= 3 THEN {r6("1.4826 * m")} END AS mad_scale
    FROM q JOIN m USING (series_id)""",
)
def activation_summary(t):
    return D.trace_summary(t.steps, ["series_id"], "value")


@query(
    "d4_occupancy_trace",
    f"""WITH {BANDED}
    SELECT series_id, position, band, count(*) AS supported_pixels, count(*) FILTER (brightness < 0.85 * g) AS dark_pixels,
           {r6("count(*) FILTER (brightness < 0.85 * g) / count(*)")} AS dark_fraction
    FROM banded GROUP BY 1, 2, 3""",
)
def occupancy_trace(t):
    return D.occupancy_trace(banded(t), t.frames, "band", "fixed", 0.85)


@query(
    "d5_occupancy_summary",
    f"""WITH {STEPS}, share AS (SELECT series_id, CASE WHEN value IS NOT NULL THEN value / (value + 50.0) END AS v FROM steps)
    SELECT series_id, count(v) AS finite, {r6("avg(v)")} AS mean, {r6("median(v)")} AS median,
           {r6("quantile_cont(v, 0.1)")} AS q10, {r6("quantile_cont(v, 0.5)")} AS q50, {r6("quantile_cont(v, 0.9)")} AS q90,
           CASE WHEN count(v) > 0 THEN 'ok' ELSE 'unavailable' END AS status
    FROM share GROUP BY 1""",
)
def occupancy_summary(t):
    rows = t.steps.select("series_id", (F.col("value") / (F.col("value") + 50.0)).alias("v"))
    return D.occupancy_summary(rows, ["series_id"], "v")


@query(
    "d6_region_measure",
    f"""WITH {BANDED}, f AS (
      SELECT series_id, position, band, median(brightness) AS m, avg(CASE WHEN brightness < 0.65 * g THEN 1.0 ELSE 0.0 END) AS d,
             max(g) AS g, count(*) AS n FROM banded GROUP BY 1, 2, 3),
    s AS (SELECT *, m < 0.65 * g AS state, lag(position) OVER w AS pp, lag(m < 0.65 * g) OVER w AS ps
          FROM f WINDOW w AS (PARTITION BY series_id, band ORDER BY position))
    SELECT series_id, band, max(n) AS support_pixels, {r6("quantile_cont(m, 0.9) - quantile_cont(m, 0.1)")} AS amplitude,
           {r6("min(m)")} AS lowest, {r6("max(m)")} AS highest, {r6("avg(d)")} AS mean_dark_fraction,
           {r6("avg(CASE WHEN state THEN 1.0 ELSE 0.0 END)")} AS dark_occupancy,
           count(*) FILTER (pp = position - 1 AND ps <> state) AS transitions,
           count(*) FILTER (pp = position - 1) AS observed_pairs
    FROM s GROUP BY 1, 2""",
)
def region_measure(t):
    return D.region_measure(banded(t), t.frames, "band")


FLIPS = """,
st AS (SELECT *, brightness < 0.9 * g AS dark FROM banded),
mk AS (SELECT *, lag(position) OVER w AS pp, lag(dark) OVER w AS pd
       FROM st WINDOW w AS (PARTITION BY series_id, y, x ORDER BY position)),
rn AS (SELECT *, sum(CASE WHEN pp = position - 1 AND pd = dark THEN 0 ELSE 1 END)
              OVER (PARTITION BY series_id, y, x ORDER BY position) AS run_no,
              CASE WHEN pp = position - 1 AND pd <> dark THEN 1 ELSE 0 END AS flip FROM mk),
isl AS (SELECT series_id, band, y, x, run_no, any_value(dark) AS dark, count(*) AS len, sum(flip) AS flips,
               min(position) AS s, max(position) AS e
        FROM rn GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "d7_pixel_state_stats",
    f"""WITH {BANDED}{FLIPS}, pp AS (
      SELECT series_id, band, y, x, sum(flips) AS t, coalesce(max(len) FILTER (dark), 0) AS ld,
             coalesce(max(len) FILTER (NOT dark), 0) AS lb FROM isl GROUP BY 1, 2, 3, 4)
    SELECT series_id, band, count(*) AS pixels, {r6("avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END)")} AS fraction_with_transitions,
           {r6("median(t)")} AS transitions_median, {r6("quantile_cont(t, 0.9)")} AS transitions_p90,
           CAST(max(t) AS BIGINT) AS max_transitions, {r6("quantile_cont(ld, 0.9)")} AS longest_dark_p90,
           max(ld) AS longest_dark_max, {r6("quantile_cont(lb, 0.9)")} AS longest_bright_p90
    FROM pp GROUP BY 1, 2""",
)
def pixel_state_stats(t):
    return D.pixel_state_stats(D.dark_pixels(banded(t), t.frames, 0.9), ["series_id", "band"])


@query(
    "d8_activity_map",
    f"""WITH {SUPPORT}, v AS (SELECT * FROM pixels WHERE observed AND valid AND in_mask),
    c AS (SELECT series_id, position, median(brightness) * 0.65 AS cut FROM v GROUP BY 1, 2),
    n AS (SELECT series_id, count(*) AS n FROM frames WHERE observed GROUP BY 1)
    SELECT series_id, y, x, count(*) AS support_count, {r6("avg(brightness)")} AS mean,
           CASE WHEN count(*) >= 2 THEN {r6("stddev_pop(brightness)")} END AS std,
           {r6("avg(CASE WHEN brightness < cut THEN 1.0 ELSE 0.0 END)")} AS relative_dark_fraction,
           {r6("count(*) / max(n)")} AS support_fraction
    FROM v JOIN c USING (series_id, position) JOIN n USING (series_id) GROUP BY 1, 2, 3""",
)
def activity_map(t):
    return D.activity_map(t.pixels, t.frames)


@query(
    "d9_articulation_frame",
    f"""WITH {BANDED}, q AS (
      SELECT series_id, position, band, count(*) AS n, quantile_cont(brightness, 0.1) AS a,
             quantile_cont(brightness, 0.9) AS c, max(g) AS g, max(gs) AS gs FROM banded GROUP BY 1, 2, 3)
    SELECT series_id, position, band, n AS supported_pixels, CASE WHEN n >= 3 THEN 'ok' ELSE 'unavailable' END AS status,
           CASE WHEN n >= 3 THEN {r6("c - a")} END AS raw_spread,
           CASE WHEN n >= 3 AND g > 0 THEN {r6("(c - a) / g")} END AS relative_to_whole_median,
           CASE WHEN n >= 3 AND a > 0 AND c > 0 THEN {r6("ln(c) - ln(a)")} END AS log_spread,
           CASE WHEN n >= 3 AND gs > 0 THEN {r6("(c - a) / gs")} END AS relative_to_whole_contrast
    FROM q""",
)
def articulation_frame(t):
    return D.articulation(banded(t), t.frames, "band")


@query(
    "d10_contrast_coverage",
    f"""WITH {BANDED}, m AS (SELECT series_id, position, median(brightness) AS m, count(*) AS n FROM banded
                             WHERE brightness > 0 GROUP BY 1, 2),
    c AS (SELECT series_id, position, key AS ratio_key, max(n) AS n, max(m) AS m,
                 avg(CASE WHEN brightness < m / r THEN 1.0 ELSE 0.0 END) AS d,
                 avg(CASE WHEN brightness > m * r THEN 1.0 ELSE 0.0 END) AS b
          FROM banded JOIN m USING (series_id, position), (VALUES ('1.15', 1.15::DOUBLE), ('1.25', 1.25::DOUBLE)) AS k(key, r)
          WHERE brightness > 0 GROUP BY 1, 2, 3)
    SELECT series_id, position, ratio_key, n AS supported_pixels, CASE WHEN n >= 3 THEN 'ok' ELSE 'unavailable' END AS status,
           CASE WHEN n >= 3 THEN {r6("m")} END AS inner_median, CASE WHEN n >= 3 THEN {r6("d")} END AS dark_fraction,
           CASE WHEN n >= 3 THEN {r6("b")} END AS bright_fraction, CASE WHEN n >= 3 THEN {r6("d + b")} END AS extreme_coverage,
           CASE WHEN n >= 3 THEN {r6("least(d, b)")} END AS balanced_coverage,
           CASE WHEN n >= 3 THEN {r6("CASE WHEN d + b > 0 THEN 2 * least(d, b) / (d + b) ELSE 0.0 END")} END AS coverage_balance
    FROM c""",
)
def contrast_coverage(t):
    return D.contrast_coverage(D.on_support(t.pixels, t.frames, "fixed"), FRAME, "brightness", [1.15, 1.25])


WEDGES = SUPPORT + """,
ctr AS (SELECT series_id, avg(x) AS cx, avg(y) AS cy FROM fixed GROUP BY 1),
wdg AS (SELECT series_id, y, x, least(CAST(floor(((atan2(cy - y, x - cx) + pi() / 8 + 2 * pi()) % (2 * pi())) / (pi() / 4)) AS INTEGER), 7) AS wedge
        FROM fixed JOIN ctr USING (series_id)),
lg AS (SELECT series_id, position, wedge, ln(median(brightness)) AS l, count(*) AS n
       FROM fixed_px JOIN wdg USING (series_id, y, x) WHERE brightness > 0 GROUP BY 1, 2, 3),
ce AS (SELECT series_id, position, median(l) AS c, count(*) AS k, CAST(sum(n) AS BIGINT) AS px,
              quantile_cont(l, 0.9) - quantile_cont(l, 0.1) AS spread FROM lg GROUP BY 1, 2),
pa AS (SELECT series_id, position, CASE WHEN sum(abs(l - c) * abs(l - c)) > 0
         THEN sum(abs(l - c)) * sum(abs(l - c)) / sum(abs(l - c) * abs(l - c)) / count(*) ELSE 0.0 END AS p
       FROM lg JOIN ce USING (series_id, position) GROUP BY 1, 2),
be AS (SELECT a.series_id, a.position, median(abs(a.l - b.l)) AS adj FROM lg a JOIN lg b
         ON b.series_id = a.series_id AND b.position = a.position AND b.wedge = (a.wedge + 1) % 8 GROUP BY 1, 2)"""


@query(
    "d11_spatial_participation",
    f"""WITH {WEDGES}
    SELECT series_id, position, px AS supported_pixels, k AS valid_cells,
           CASE WHEN k >= 4 THEN 'ok' ELSE 'unavailable' END AS status,
           CASE WHEN k >= 4 THEN {r6("spread")} END AS cell_log_spread,
           CASE WHEN k >= 4 THEN {r6("p")} END AS contrast_participation,
           CASE WHEN k >= 4 THEN {r6("spread * p")} END AS distributed_contrast,
           CASE WHEN k >= 4 THEN {r6("adj")} END AS adjacent_log_contrast_median
    FROM ce JOIN pa USING (series_id, position) LEFT JOIN be USING (series_id, position)""",
)
def spatial_participation(t):
    return D.spatial_participation(t.pixels, t.frames, 8)


@query(
    "d12_spatial_trace",
    f"""WITH {WEDGES}, long AS (
      SELECT series_id, position, 'cell_log_spread' AS measure, CASE WHEN k >= 4 THEN spread END AS v FROM ce
      UNION ALL SELECT series_id, position, 'contrast_participation', CASE WHEN k >= 4 THEN p END
                FROM pa JOIN ce USING (series_id, position)
      UNION ALL SELECT series_id, position, 'distributed_contrast', CASE WHEN k >= 4 THEN spread * p END
                FROM pa JOIN ce USING (series_id, position))
    SELECT series_id, measure, count(v) AS finite, {r6("quantile_cont(v, 0.1)")} AS q10, {r6("median(v)")} AS q50,
           {r6("quantile_cont(v, 0.9)")} AS q90, {r6("avg(v)")} AS mean
    FROM long GROUP BY 1, 2""",
)
def spatial_trace(t):
    rows = D.spatial_participation(t.pixels, t.frames, 8)
    long = D.long_measures(rows, FRAME, ["cell_log_spread", "contrast_participation", "distributed_contrast"])
    # A series is one window of FRAMES positions, so the built-in percentile is bounded.
    return long.groupBy("series_id", "measure").agg(
        F.count("value").alias("finite"),
        *[F.percentile("value", F.lit(p)).alias(n) for n, p in D.OCTILES.items()],
        F.avg("value").alias("mean"),
    )


COMPONENTS = BRIGHT.replace("WITH ", "") + """,
act AS (SELECT series_id, position, y, x, series_id * 100000 + position * 64 + y * 8 + x AS id
        FROM lit WHERE bright AND fixed),
reach(series_id, position, id, y, x, label) AS (
  SELECT series_id, position, id, y, x, id AS label FROM act
  UNION
  SELECT r.series_id, r.position, b.id, b.y, b.x, r.label FROM reach r JOIN act b
    ON b.series_id = r.series_id AND b.position = r.position
   AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
lab AS (SELECT series_id, position, y, x, min(label) - series_id * 100000 - position * 64 AS cell
        FROM reach GROUP BY 1, 2, 3, 4, id)"""


def flash_cells(t):
    lit = bright = D.bright_state(t.pixels, t.frames, 1.0).where("fixed")
    return D.components(bright.where("bright"), FRAME), lit.select(*FRAME, "y", "x")


@query(
    "d13_components",
    f"""WITH RECURSIVE {COMPONENTS}
    SELECT series_id, position, y, x, cell // 8 AS label_y, cell % 8 AS label_x FROM lab""",
)
def components(t):
    return flash_cells(t)[0].select(*FRAME, "y", "x", F.col("label.y").alias("label_y"), F.col("label.x").alias("label_x"))


MORPH = COMPONENTS + """,
sup AS (SELECT series_id, position, y, x FROM lit WHERE fixed),
tch AS (SELECT series_id, position, y + dy AS y, x + dx AS x, count(*) AS n
        FROM sup, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY 1, 2, 3, 4),
rimc AS (SELECT s.* FROM sup s JOIN tch USING (series_id, position, y, x) WHERE n < 9),
sz AS (SELECT l.series_id, l.position, cell, count(*) AS size, count(r.y) AS rim
       FROM lab l LEFT JOIN rimc r ON r.series_id = l.series_id AND r.position = l.position AND r.y = l.y AND r.x = l.x
       GROUP BY 1, 2, 3),
sh AS (SELECT series_id, position, CAST(sum(size) AS BIGINT) AS a, count(*) AS c, max(size) AS big,
              sum(size) * sum(size) / sum(size * size) AS eff, CAST(sum(rim) AS BIGINT) AS rim,
              count(*) FILTER (rim > 0) AS tb FROM sz GROUP BY 1, 2),
ar AS (SELECT series_id, position, count(*) AS s FROM sup GROUP BY 1, 2),
morph AS (SELECT series_id, position, s, coalesce(a, 0) AS a, CASE WHEN a IS NULL THEN 'unavailable' ELSE 'ok' END AS status,
                 coalesce(a, 0) / s AS af, coalesce(c, 0) AS c, big / a AS lf, big / s AS ls, eff, rim / a AS bf, tb
          FROM ar LEFT JOIN sh USING (series_id, position))"""


@query(
    "d14_flash_morphology",
    f"""WITH RECURSIVE {MORPH}
    SELECT series_id, position, s AS support_pixels, a AS active_pixels, status, {r6("af")} AS active_fraction,
           c AS component_count, {r6("lf")} AS largest_component_fraction, {r6("ls")} AS largest_component_support_fraction,
           {r6("eff")} AS effective_component_count, {r6("bf")} AS boundary_active_fraction,
           tb AS components_touching_boundary
    FROM morph""",
)
def flash_morphology(t):
    return D.flash_morphology(*flash_cells(t), FRAME)


@query(
    "d15_morphology_summary",
    f"""WITH RECURSIVE {MORPH}, v AS (
      SELECT series_id, status = 'ok' AS ok, CASE WHEN status = 'ok' THEN af END AS af, CASE WHEN status = 'ok' THEN lf END AS lf,
             CASE WHEN status = 'ok' THEN eff END AS eff, CASE WHEN status = 'ok' THEN bf END AS bf FROM morph)
    SELECT series_id, count(*) AS observed_frames, count(*) FILTER (ok) AS active_frames,
           {r6("count(*) FILTER (ok) / count(*)")} AS active_frame_fraction, {r6("median(af)")} AS median_active_fraction,
           {r6("median(lf)")} AS median_largest_fraction, {r6("quantile_cont(lf, 0.1)")} AS q10_largest_fraction,
           {r6("quantile_cont(lf, 0.9)")} AS q90_largest_fraction, {r6("median(eff)")} AS median_effective_count,
           {r6("quantile_cont(eff, 0.9)")} AS q90_effective_count, {r6("median(bf)")} AS median_boundary_fraction
    FROM v GROUP BY 1""",
)
def morphology_summary(t):
    return D.morphology_summary(D.flash_morphology(*flash_cells(t), FRAME), ["series_id"])


@query(
    "f4_switching",
    f"""WITH {BANDED}{FLIPS}, dynst AS (SELECT series_id, position, y, x, brightness < 0.9 * g AS dark FROM dyn WHERE g > 0),
    sw AS (
      SELECT 'fixed' AS mode, series_id, y, x, dark <> pd AS sw FROM mk WHERE pp = position - 1
      UNION ALL SELECT 'pair_local', a.series_id, a.y, a.x, a.dark <> b.dark
      FROM dynst a JOIN dynst b ON b.series_id = a.series_id AND b.y = a.y AND b.x = a.x AND b.position = a.position - 1),
    pp AS (SELECT mode, series_id, y, x, count(*) AS e, count(*) FILTER (sw) AS s FROM sw GROUP BY 1, 2, 3, 4)
    SELECT mode, series_id, CAST(sum(e) AS BIGINT) AS eligible_pixel_pairs, CAST(sum(s) AS BIGINT) AS switched_pixel_pairs,
           {r6("sum(s) / sum(e)")} AS switch_rate, count(*) AS finite_pixels, {r6("quantile_cont(s / e, 0.1)")} AS rate_q10,
           {r6("quantile_cont(s / e, 0.5)")} AS rate_q50, {r6("quantile_cont(s / e, 0.9)")} AS rate_q90,
           {r6("max(s / e)")} AS rate_max, {r6("avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)")} AS fraction_nonzero,
           min(e) AS eligible_min, max(e) AS eligible_max
    FROM pp GROUP BY 1, 2""",
)
def switching(t):
    parts = [D.switching(t.pixels, t.frames, 0.9, m)[1].withColumn("mode", F.lit(m)) for m in ("fixed", "pair_local")]
    return parts[0].unionByName(parts[1])


FATES = BANDED + FLIPS.replace("FROM banded", "FROM dyn WHERE g > 0") + """,
fate AS (SELECT f.series_id, f.position, CASE WHEN NOT observed THEN 'gap' WHEN coalesce(g, 0) <= 0 THEN 'invalid_reference'
                ELSE 'support_loss' END AS fate FROM frames f LEFT JOIN whole USING (series_id, position)),
nb AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS nsx FROM isl WINDOW w AS (PARTITION BY series_id, y, x ORDER BY s)),
pr AS (SELECT n.series_id, n.y, n.x, n.dark AS state, n.s, n.e, n.len,
              CASE WHEN pe = s - 1 THEN 'state_change' ELSE coalesce(l.fate, 'window_endpoint') END AS lb,
              CASE WHEN nsx = e + 1 THEN 'state_change' ELSE coalesce(r.fate, 'window_endpoint') END AS rb
       FROM nb n LEFT JOIN fate l ON l.series_id = n.series_id AND l.position = n.s - 1
       LEFT JOIN fate r ON r.series_id = n.series_id AND r.position = n.e + 1),
pc AS (SELECT *, lb <> 'state_change' OR rb <> 'state_change' AS cens,
              max(len) OVER (PARTITION BY series_id, y, x, state) AS longest FROM pr),
px AS (SELECT p.series_id, p.y, p.x, s.state, coalesce(max(longest), 0) AS longest,
              coalesce(bool_or(cens) FILTER (len = longest), false) AS any_c,
              coalesce(bool_and(cens) FILTER (len = longest), false) AS all_c
       FROM (SELECT DISTINCT series_id, y, x FROM st) p, (VALUES (true), (false)) AS s(state)
       LEFT JOIN pc ON pc.series_id = p.series_id AND pc.y = p.y AND pc.x = p.x AND pc.state = s.state
       GROUP BY 1, 2, 3, 4)"""


def persistence_inputs(t):
    whole = D.whole_trace(t.pixels, t.frames)
    frames = whole.select("series_id", "position", "observed", (F.coalesce("whole", F.lit(0.0)) > 0).alias("reference_valid"))
    rows = D.dark_pixels(t.pixels, t.frames, 0.9, "dynamic").where("dark is not null")
    run_rows = D.pixel_runs(rows, frames)
    return D.persistence_pixels(run_rows, rows), run_rows


@query(
    "f6_persistence",
    f"""WITH {FATES}, steps_n AS (SELECT series_id, count(*) AS n FROM frames GROUP BY 1),
    sp AS (SELECT series_id, state, count(*) AS fp, median(longest) AS q50, quantile_cont(longest, 0.9) AS q90,
                  max(longest) AS mx, avg(CASE WHEN longest > 0 THEN 1.0 ELSE 0.0 END) AS nz,
                  avg(CASE WHEN any_c THEN 1.0 ELSE 0.0 END) AS ac, avg(CASE WHEN all_c THEN 1.0 ELSE 0.0 END) AS lc
           FROM px GROUP BY 1, 2),
    ty AS (SELECT series_id, state, count(*) AS tr, count(*) FILTER (cens) AS cr,
                  {", ".join(f"count(*) FILTER ({s[0]}b = '{w}') AS {s}_{w}" for s in ("left", "right") for w in ("gap", "invalid_reference", "support_loss", "window_endpoint"))}
           FROM pc GROUP BY 1, 2)
    SELECT series_id, state, fp AS finite_pixels, {r6("q50")} AS q50, {r6("q90")} AS q90, mx AS max_length,
           {r6("nz")} AS fraction_nonzero, {r6("ac")} AS any_censored_fraction, {r6("lc")} AS all_censored_fraction,
           coalesce(tr, 0) AS total_runs, coalesce(cr, 0) AS censored_runs,
           {", ".join(f"coalesce({s}_{w}, 0) AS {s}_{w}" for s in ("left", "right") for w in ("gap", "invalid_reference", "support_loss", "window_endpoint"))},
           {r6("q90 / n")} AS q90_fraction
    FROM sp LEFT JOIN ty USING (series_id, state) JOIN steps_n USING (series_id)""",
)
def persistence(t):
    per_pixel, run_rows = persistence_inputs(t)
    steps = t.frames.groupBy("series_id").agg(F.count(F.lit(1)).alias("steps"))
    return D.persistence(per_pixel, run_rows, steps)


@query(
    "f8_run_event",
    f"""WITH {FATES}, hq AS (
      SELECT series_id, state, quantile_disc(longest, 0.9) AS ignored, max(longest) AS m,
             list(longest ORDER BY longest)[CAST(ceil(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS c FROM px GROUP BY 1, 2),
    wl AS (SELECT series_id, state, CASE WHEN c = 0 AND m > 0 THEN 1 ELSE c END AS l FROM hq),
    ft AS (SELECT pc.*, l FROM pc JOIN wl USING (series_id, state) WHERE l > 0 AND len >= l),
    cnt AS (SELECT series_id, state, a, count(*) AS n FROM (
              SELECT series_id, state, unnest(range(s, e - l + 2)) AS a FROM ft) GROUP BY 1, 2, 3),
    be AS (SELECT series_id, state, arg_max(a, (n, -a)) AS ws, max(n) AS wn FROM cnt GROUP BY 1, 2),
    ins AS (SELECT f.*, ws, wn, row_number() OVER (PARTITION BY f.series_id, f.state ORDER BY f.longest DESC, f.y * 8 + f.x) AS k
            FROM ft f JOIN be USING (series_id, state) WHERE f.s <= ws AND f.e >= ws + l - 1)
    SELECT series_id, state, s AS start, (s + e) // 2 AS middle, e AS "end", ws AS window_start, l AS window_length,
           wn AS window_pixels, y * 8 + x AS representative_pixel, lb AS left_boundary, rb AS right_boundary
    FROM ins WHERE k = 1""",
)
def run_event(t):
    return D.run_event(*persistence_inputs(t), SIDE)


