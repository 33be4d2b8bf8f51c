"""Radial profile queries (F15, F16, F22-F29, D22, D23)."""

from pyspark.sql import functions as F

from gyre.functions.arrays import robust_z as robust_z_of
from gyre.operators import profiles as R
from gyre.plans.registry import query, r6
from gyre.plans.views import PROFILES

N = 64
SET = ["set_id"]


def arrays(t):
    """One row per profile: 8 frames x 8 sectors per set, value null where unsupported."""
    v = F.transform("embedding", lambda x: F.when(F.abs(x) < F.lit(0.3).cast("float"), x.cast("double")))
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 64).alias("set_id"),
        F.pmod(F.floor(F.col("vec_id") / 8), F.lit(8)).alias("frame"),
        F.pmod("vec_id", F.lit(8)).alias("sector"),
        "vec_id",
        v.alias("profile"),
    )


ZED = PROFILES + """,
pv AS (SELECT vec_id, k, u, CASE WHEN supported THEN value END AS v FROM profiles),
pm AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS s FROM pv GROUP BY 1),
pd AS (SELECT vec_id, greatest(1.4826 * median(abs(v - m)), 0.2 * max(s), 1e-6) AS sc, max(m) AS m FROM pv JOIN pm USING (vec_id) GROUP BY 1),
pz AS (SELECT vec_id, k, u, v, (v - m) / sc AS z FROM pv JOIN pd USING (vec_id))"""


@query("f16_robust_z", f"""WITH {ZED} SELECT vec_id, CAST(k AS INTEGER) AS k, {r6("z")} AS z FROM pz""")
def robust_z(t):
    return arrays(t).select("vec_id", F.posexplode(robust_z_of(F.col("profile"))).alias("k", "z"))


@query(
    "f15_local_peak",
    f"""WITH {ZED}, w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS o, count(*) OVER (PARTITION BY vec_id) AS n
                          FROM pz WHERE v IS NOT NULL AND abs(u - 0.5) <= 0.055)
    SELECT vec_id, CAST(k AS INTEGER) AS "index", {r6("u")} AS u, {r6("v")} AS "value", {r6("z")} AS z, {r6("u - 0.5")} AS "offset"
    FROM w WHERE o = 1 AND n >= 3""",
)
def local_peak(t):
    rows = arrays(t).withColumn("z", robust_z_of(F.col("profile")))
    peak = R.local_peak(F.col("profile"), F.col("z"), F.lit(0.5), 0.055, 3, N)
    return rows.select("vec_id", peak.alias("p")).where("p is not null").select("vec_id", "p.*")


TARGETS = (0.51, 0.73, 0.87)


def fixed_controls(t):
    """The same three circular boundaries for every set."""
    sets = arrays(t).select("set_id").distinct()
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("boundary"), F.array(*[F.lit(u + 0.002 * s) for s in range(8)]).alias("sector_u"))
            for b, u in zip(R.BOUNDARIES, TARGETS)
        ]
    )
    return sets.select("set_id", F.explode(rows).alias("c")).select("set_id", "c.*")


def scored(t):
    return R.boundary_frame(arrays(t), fixed_controls(t), SET, "frame", "sector", 8, N)


FRAMES_SQL = ZED + """,
ctl(boundary, base) AS (VALUES ('centre_inner', 0.51::DOUBLE), ('inner_middle', 0.73::DOUBLE), ('middle_outer', 0.87::DOUBLE)),
tg AS (SELECT vec_id // 64 AS set_id, (vec_id // 8) % 8 AS frame, vec_id % 8 AS sector, vec_id, boundary, k, u, v, z,
              round(base + 0.002::DOUBLE * (vec_id % 8), 12) AS target FROM pz, ctl),
nr AS (SELECT *, row_number() OVER (PARTITION BY vec_id, boundary ORDER BY v DESC, k) AS o, count(*) OVER (PARTITION BY vec_id, boundary) AS n
       FROM tg WHERE v IS NOT NULL AND abs(u - target) <= 0.04),
ry AS (SELECT t.set_id, t.frame, t.sector, t.boundary, n.z AS z, n.u - n.target AS off, coalesce(n.z >= 0.8, false) AS ok
       FROM (SELECT DISTINCT set_id, frame, sector, vec_id, boundary FROM tg) t
       LEFT JOIN nr n ON n.vec_id = t.vec_id AND n.boundary = t.boundary AND n.o = 1 AND n.n >= 2),
db AS (SELECT *, sector + 8 * d AS p FROM ry, (SELECT unnest([0, 1]) AS d)),
isl AS (SELECT *, sum(ok::INT) OVER (PARTITION BY set_id, frame, boundary ORDER BY p) AS g FROM db),
gap AS (SELECT set_id, frame, boundary, max(c) AS gap FROM (
          SELECT set_id, frame, boundary, g, count(*) FILTER (NOT ok) AS c FROM isl GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
om AS (SELECT set_id, frame, boundary, median(off) AS om FROM ry GROUP BY 1, 2, 3),
fs AS (SELECT set_id, frame, boundary, count(z) AS fin, count(*) FILTER (ok) AS sup, count(*) AS n, median(z) AS mz, quantile_cont(z, 0.1) AS qz,
              median(abs(off)) AS ao, max(om) AS mo, 1.4826 * median(abs(off - om)) AS mad, max(gap) AS gap
       FROM ry JOIN om USING (set_id, frame, boundary) JOIN gap USING (set_id, frame, boundary) GROUP BY 1, 2, 3),
fr AS (SELECT *, CASE WHEN fin >= 8 THEN 'ok' WHEN fin >= 4 THEN 'review' ELSE 'unavailable' END AS st FROM fs)"""


@query(
    "d22_boundary_frame",
    f"""WITH {FRAMES_SQL}
    SELECT set_id, frame, boundary, st AS status, CAST(fin AS INTEGER) AS finite_peaks, CAST(sup AS INTEGER) AS supported_rays,
           {r6("sup / n")} AS supported_fraction, {r6("least(gap, n) / n")} AS longest_gap_fraction, {r6("mz")} AS median_peak_z,
           {r6("qz")} AS q10_peak_z, {r6("round(ao, 9)")} AS median_abs_offset, {r6("mad")} AS offset_mad, {r6("round(mo, 9)")} AS median_signed_offset
    FROM fr""",
)
def boundary_frame(t):
    return scored(t)


@query(
    "d23_boundary_summary",
    f"""WITH {FRAMES_SQL}, u AS (SELECT *, st <> 'unavailable' AS us FROM fr)
    SELECT set_id, boundary, CAST(8 AS BIGINT) AS requested_frames, count(*) AS scored_frames, count(*) FILTER (us) AS usable_frames,
           {r6("count(*) / 8")} AS coverage, CASE WHEN count(*) FILTER (us) >= 3 THEN 'ok' ELSE 'unavailable' END AS status,
           {r6("median(mz) FILTER (us)")} AS strength_median, {r6("quantile_cont(mz, 0.1) FILTER (us)")} AS strength_q10,
           {r6("median(sup / n) FILTER (us)")} AS continuity_median, {r6("max(least(gap, n) / n) FILTER (us)")} AS worst_gap,
           {r6("median(mad) FILTER (us)")} AS position_median_mad, {r6("quantile_cont(mad, 0.9) FILTER (us)")} AS position_q90_mad
    FROM u GROUP BY 1, 2""",
)
def boundary_summary(t):
    return R.boundary_summary(scored(t), SET, F.max(F.lit(8).cast("bigint")))


@query(
    "f22_medoid_consensus",
    f"""WITH side AS (SELECT vec_id, k // 8 AS o, sum(CAST(v AS DOUBLE)) AS x FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY 1, 2),
    e AS (SELECT vec_id // 16 AS series_id, vec_id, -CAST(label AS DOUBLE) AS n, abs(CAST(embedding[1] AS DOUBLE)) AS error, -CAST(embedding[2] AS DOUBLE) AS quality, vec_id % 5 AS rank,
                 count(*) OVER (PARTITION BY vec_id // 16) AS views FROM embeddings),
    d AS (SELECT a.series_id, a.vec_id, b.vec_id AS other, min(r) AS d FROM (
            SELECT a.series_id, a.vec_id, b.vec_id AS other, t, sqrt(sum(pow(x.x - y.x, 2)) / 8) AS r
            FROM e a JOIN e b ON b.series_id = a.series_id, (VALUES (0), (1), (2), (3)) v(t), side x, side y
            WHERE a.views >= 3 AND x.vec_id = a.vec_id AND y.vec_id = b.vec_id AND y.o = (x.o - 2 * t + 8) % 8 GROUP BY 1, 2, 3, 4) q
          JOIN e a ON a.vec_id = q.vec_id JOIN e b ON b.vec_id = q.other GROUP BY 1, 2, 3),
    m AS (SELECT series_id, arg_min(vec_id, (m, vec_id)) AS medoid FROM (SELECT series_id, vec_id, round(median(d), 12) AS m FROM d WHERE vec_id <> other GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT m.series_id, medoid, vec_id, d FROM m JOIN d ON d.series_id = m.series_id AND d.other = m.medoid),
    c AS (SELECT series_id, median(d) AS c FROM g GROUP BY 1),
    t AS (SELECT series_id, greatest(2.0, any_value(c) + 2.5 * greatest(1.4826 * median(abs(d - c)), 1e-6)) AS threshold FROM g JOIN c USING (series_id) GROUP BY 1),
    o AS (SELECT g.*, threshold, d > threshold AS out, row_number() OVER (PARTITION BY g.series_id ORDER BY d > threshold, n, error, quality, round(d, 12), rank, e.vec_id) AS place
          FROM g JOIN t USING (series_id) JOIN e ON e.vec_id = g.vec_id)
    SELECT series_id, medoid, vec_id, {r6("d")} AS distance, {r6("threshold")} AS threshold,
           CASE WHEN out THEN 'rejected' WHEN place <= 5 THEN 'selected' ELSE 'not_selected' END AS status,
           CASE WHEN out THEN 'outer_octagon_consensus_outlier' WHEN place <= 5 THEN '' ELSE 'outside_face_on_outer_core' END AS reason FROM o
    UNION ALL
    SELECT series_id, NULL, vec_id, NULL, NULL, 'unavailable', 'insufficient_compatible_outer_views' FROM e WHERE views < 3""",
)
def medoid_consensus(t):
    """All vectors, 16 a set; a side is the sum of eight neighbouring values."""
    value = lambda k: F.get("embedding", F.lit(k)).cast("double")
    sides = F.array(*[sum((value(8 * o + k) for k in range(1, 8)), value(8 * o)) for o in range(8)])
    shapes = t.embeddings.select(
        F.floor(F.col("vec_id") / 16).alias("series_id"), "vec_id", F.col("label").cast("double").alias("score"), sides.alias("shape"),
        F.abs(value(0)).alias("error"), value(1).alias("quality"), F.pmod("vec_id", F.lit(5)).alias("rank"),
    )
    return R.medoid_consensus(shapes, ["series_id"], "vec_id", "score", 2.0, 2.5, 5, error="error", quality="quality", rank="rank")


KERNEL = R.gaussian_kernel(R.SMOOTHING)


@query(
    "f23_consensus_profile",
    f"""WITH {PROFILES}, c AS (SELECT vec_id // 64 AS set_id, sector, k, median(CASE WHEN supported THEN value END) AS v FROM profiles GROUP BY 1, 2, 3),
    m AS (SELECT set_id, k, coalesce(median(v), 0.0) AS c FROM c GROUP BY 1, 2),
    kw(o, w) AS (VALUES {", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in zip(range(-5, 6), KERNEL))}),
    s AS (SELECT m.set_id, m.k, w, (m.k + o + 128) % 128 AS f FROM m, kw)
    SELECT s.set_id, CAST(s.k AS INTEGER) AS k, {r6("sum(w * x.c)")} AS curve
    FROM s JOIN m x ON x.set_id = s.set_id AND x.k = CASE WHEN f < 64 THEN f ELSE 127 - f END GROUP BY 1, 2""",
)
def consensus_profile(t):
    return R.consensus(arrays(t), SET, "sector", N).select("set_id", F.posexplode("curve").alias("k", "curve"))


def peaks_sql(source: str, ident: str) -> str:
    """SQL tables of the peaks of the curves in `source` (ident, k, v): kept (peaks spaced and interior) and cand (filled up)."""
    return f"""
step AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS new FROM {source} WINDOW w AS (PARTITION BY {ident} ORDER BY k)),
flat AS (SELECT *, sum(new) OVER (PARTITION BY {ident} ORDER BY k) AS f FROM step),
tops AS (SELECT {ident}, f, min(k) AS a, max(k) AS b, any_value(v) AS v FROM flat GROUP BY 1, 2),
peaks AS (SELECT {ident}, (a + b) // 2 AS k, v FROM (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM tops WINDOW w AS (PARTITION BY {ident} ORDER BY f)) WHERE pv < v AND nv < v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {ident} ORDER BY v DESC, k DESC) AS o FROM peaks),
pick({ident}, o, kept) AS (
  SELECT DISTINCT {ident}, 0::BIGINT, CAST([] AS BIGINT[]) FROM {source}
  UNION ALL
  SELECT r.{ident}, r.o, CASE WHEN len(list_filter(kept, lambda x: abs(x - r.k) < 6)) > 0 THEN kept ELSE list_append(kept, r.k) END
  FROM pick p JOIN ranked r ON r.{ident} = p.{ident} AND r.o = p.o + 1),
kept AS (SELECT {ident}, list_filter(arg_max(kept, o), lambda x: x / 63.0::DOUBLE BETWEEN 0.16 AND 0.92) AS kept FROM pick GROUP BY 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY {ident} ORDER BY v DESC, k DESC) AS o FROM {source} WHERE k / 63.0::DOUBLE BETWEEN 0.16 AND 0.92),
fill({ident}, o, kept) AS (
  SELECT {ident}, 0::BIGINT, kept FROM kept WHERE len(kept) < 3
  UNION ALL
  SELECT r.{ident}, r.o, CASE WHEN len(kept) >= 6 OR len(list_filter(kept, lambda x: abs(x - r.k) < 6)) > 0 THEN kept ELSE list_append(kept, r.k) END
  FROM fill p JOIN pool r ON r.{ident} = p.{ident} AND r.o = p.o + 1),
cand AS (SELECT {ident}, unnest(kept) AS k, true AS real FROM kept
         UNION ALL SELECT f.{ident}, unnest(list_filter(f.kept, lambda x: NOT list_contains(k.kept, x))), false FROM (SELECT {ident}, arg_max(kept, o) AS kept FROM fill GROUP BY 1) f JOIN kept k USING ({ident})),
high AS (SELECT c.{ident}, c.k, c.real, s.v FROM cand c JOIN {source} s ON s.{ident} = c.{ident} AND s.k = c.k),
ends AS (SELECT h.{ident}, h.k, any_value(h.v) AS v, any_value(h.real) AS real, coalesce(max(s.k) FILTER (s.k < h.k AND s.v > h.v), -1) AS l, coalesce(min(s.k) FILTER (s.k > h.k AND s.v > h.v), 64) AS r
         FROM high h JOIN {source} s ON s.{ident} = h.{ident} GROUP BY 1, 2),
prom AS (SELECT e.{ident}, e.k, any_value(e.v) AS height,
                CASE WHEN any_value(e.real) THEN any_value(e.v) - greatest(min(s.v) FILTER (s.k > e.l AND s.k <= e.k), min(s.v) FILTER (s.k < e.r AND s.k >= e.k)) ELSE 0.0 END AS prominence
         FROM ends e JOIN {source} s ON s.{ident} = e.{ident} GROUP BY 1, 2)"""


CURVES = PROFILES + """,
curve AS (SELECT vec_id, k, coalesce(CASE WHEN supported THEN value END, 0.0) AS v FROM profiles),""" + peaks_sql("curve", "vec_id")


@query(
    "f24_profile_peaks",
    f"""WITH RECURSIVE {CURVES}
    SELECT vec_id, CAST(k AS INTEGER) AS peak_index, {r6("k / 63.0::DOUBLE")} AS peak_u, {r6("height")} AS height, {r6("prominence")} AS prominence FROM prom""",
)
def profile_peaks(t):
    curves = arrays(t).select("vec_id", F.transform("profile", lambda v: F.coalesce(v, F.lit(0.0))).alias("curve"))
    return R.profile_peaks(curves, "curve", N).drop("curve")


def candidates(t):
    return R.candidates(R.consensus(arrays(t), SET, "sector", N), N)


def template(t):
    return R.boundary_template(candidates(t), SET, N)


@query("f25_boundary_template")
def boundary_template(t):
    text = F.array_join(F.transform("sector_u", lambda v: F.format_number(v, 6)), ",")
    return template(t).withColumn("sector_u", text)


@query("f25_temporal_template")
def temporal_template(t):
    """The template under the window-local peaks, with frame votes before the score."""
    found = R.candidates(R.consensus(arrays(t), SET, "sector", N), N, "window")
    votes = R.candidate_persistence(arrays(t), found, SET, "frame", N)
    text = F.array_join(F.transform("sector_u", lambda v: F.format_number(v, 6)), ",")
    return R.boundary_template(found, SET, N, votes).withColumn("sector_u", text)


@query("f26_candidate_persistence")
def candidate_persistence(t):
    return R.candidate_persistence(arrays(t), candidates(t), SET, "frame", N)


@query("f27_boundary_alignment")
def boundary_alignment(t):
    return R.boundary_alignment(arrays(t), template(t), SET, "sector", N)


@query("f28_crossfit")
def crossfit(t):
    return R.crossfit(arrays(t), SET, "frame", "sector", N)


@query(
    "f29_peak_suppression",
    f"""WITH RECURSIVE {CURVES}, near AS (SELECT * FROM peaks WHERE k / 63.0::DOUBLE BETWEEN 0.40 AND 0.68),
    rival AS (SELECT n.vec_id, n.k, c.k AS s, c.v AS h, row_number() OVER (PARTITION BY n.vec_id, n.k ORDER BY c.v DESC, c.k) AS o
              FROM near n JOIN kept ON kept.vec_id = n.vec_id JOIN curve c ON c.vec_id = n.vec_id AND list_contains(kept.kept, c.k) AND c.k <> n.k AND abs(c.k - n.k) < 6 AND c.v >= n.v),
    j AS (SELECT n.vec_id, n.k, n.v, list_contains(kept.kept, n.k) AS retained, s, h FROM near n JOIN kept USING (vec_id) LEFT JOIN rival r ON r.vec_id = n.vec_id AND r.k = n.k AND r.o = 1)
    SELECT vec_id, CAST(k AS INTEGER) AS peak_index, {r6("v")} AS height, retained, CASE WHEN NOT retained THEN CAST(s AS INTEGER) END AS suppressor_index,
           CASE WHEN NOT retained THEN {r6("h")} END AS suppressor_height, CASE WHEN NOT retained THEN CAST(abs(s - k) AS INTEGER) END AS suppressor_distance FROM j""",
)
def peak_suppression(t):
    curves = arrays(t).select("vec_id", F.transform("profile", lambda v: F.coalesce(v, F.lit(0.0))).alias("curve"))
    return R.peak_suppression(curves, ["vec_id"], "curve", N)
