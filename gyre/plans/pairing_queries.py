"""Joins and pairings (family E)."""

from pyspark.sql import functions as F

from gyre.operators import cycles as C
from gyre.operators import comparability as CMP
from gyre.operators import pairing as E
from gyre.operators import pixels as P
from gyre.operators import traces as D
from gyre.plans.pixel_queries import OCTANT, SECTORS
from gyre.plans.registry import query, r6
from gyre.plans.trace_queries import MORPH, flash_cells
from gyre.plans.views import BAND, CYCLES, PERIOD, SIDE, STEPS, SUPPORT

KEY = ["series_id"]
FRAME = ["series_id", "position"]


@query(
    "e2_level_correlation",
    f"""WITH {STEPS}, b AS (SELECT series_id, CASE WHEN other IS NOT NULL THEN value END AS a,
                                   CASE WHEN value IS NOT NULL THEN other END AS b FROM steps)
    SELECT series_id, count(a) AS paired, CASE WHEN count(a) >= 3 AND max(a) > min(a) AND max(b) > min(b) THEN {r6("corr(a, b)")} END AS pearson_r,
           CASE WHEN count(a) < 3 OR max(a) = min(a) OR max(b) = min(b) THEN 'unavailable' ELSE 'ok' END AS status,
           CASE WHEN count(a) < 3 THEN 'insufficient_aligned_finite_frames'
                WHEN max(a) = min(a) OR max(b) = min(b) THEN 'constant_component_trace' END AS reason
    FROM b GROUP BY 1""",
)
def level_correlation(t):
    return E.level_correlation(t.steps, KEY, "value", "other")


def traces_of(t, label, name):
    px = t.pixels.withColumn(name, label)
    return D.regional_trace(px, t.frames, name, "fixed")


def pair_sql(label, name, pairs):
    cases = " UNION ALL ".join(
        f"SELECT a.series_id, a.position, '{p}' AS pair_id, a.v AS a, b.v AS b FROM tr a JOIN tr b "
        f"ON b.series_id = a.series_id AND b.position = a.position AND a.{name} = '{x}' AND b.{name} = '{y}'"
        for p, x, y in pairs
    )
    return SUPPORT + f""",
lb AS (SELECT p.*, g, {label} AS {name} FROM fixed_px p JOIN whole USING (series_id, position)),
tr AS (SELECT series_id, position, {name}, ln(median(brightness)) - ln(max(g)) AS v FROM lb GROUP BY 1, 2, 3
       HAVING median(brightness) > 0),
pr AS ({cases}),
mv AS (SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db, lag(position) OVER w AS pp
       FROM pr WINDOW w AS (PARTITION BY series_id, pair_id ORDER BY position)),
hp AS (SELECT series_id, pair_id, CASE WHEN pp = position - 1 THEN da END AS da, CASE WHEN pp = position - 1 THEN db END AS db FROM mv)"""


@query(
    "e3_opposing_pairs",
    f"""WITH {pair_sql(f"{SECTORS}[{OCTANT} + 1]", "sector", E.OPPOSING)},
    s AS (SELECT series_id, pair_id, count(da) AS observed_pairs, count(*) FILTER (da = 0 OR db = 0) AS flat_pairs,
                 count(*) FILTER (da * db > 0) / nullif(count(*) FILTER (da <> 0 AND db <> 0), 0) AS sa FROM hp GROUP BY 1, 2)
    SELECT series_id, pair_id, count(*) AS paired,
           CASE WHEN count(*) >= 3 AND max(a) > min(a) AND max(b) > min(b) THEN {r6("corr(a, b)")} END AS correlation,
           CASE WHEN count(*) < 3 OR max(a) = min(a) OR max(b) = min(b) THEN 'unavailable' ELSE 'ok' END AS status,
           {r6("median(abs(a - b))")} AS median_absolute_difference, {r6("median(a - b)")} AS median_signed_difference,
           any_value(observed_pairs) AS observed_pairs, any_value(flat_pairs) AS flat_pairs, {r6("any_value(sa)")} AS sign_agreement
    FROM pr JOIN s USING (series_id, pair_id) GROUP BY 1, 2""",
)
def opposing_pairs(t):
    traces = traces_of(t, P.octant(SIDE), "sector")
    paired = E.paired_traces(traces, KEY, "position", "sector", "relative", E.OPPOSING)
    return E.opposing_pairs(paired, ["series_id", "pair_id"], "position")


BANDS = (("centre_inner", "centre", "inner"), ("inner_middle", "inner", "middle"), ("middle_outer", "middle", "outer"))


@query(
    "e4_band_pairs",
    f"""WITH {pair_sql(BAND, "band", BANDS)}, s AS (
      SELECT series_id, pair_id, count(da * db) AS op, count(*) FILTER (da * db > 0) AS sp, count(*) FILTER (da * db < 0) AS xp,
             count(*) FILTER (da * db = 0) AS tp FROM hp GROUP BY 1, 2)
    SELECT series_id, pair_id, count(*) AS paired,
           CASE WHEN count(*) >= 3 AND max(a) > min(a) AND max(b) > min(b) THEN {r6("corr(a, b)")} END AS pearson_r,
           any_value(sp) AS same_pairs, any_value(xp) AS opposite_pairs, any_value(tp) AS tie_pairs,
           {r6("any_value(sp) / nullif(any_value(sp) + any_value(xp), 0)")} AS same_fraction,
           CASE WHEN any_value(sp) + any_value(xp) > 0 AND NOT (count(*) < 3 OR max(a) = min(a) OR max(b) = min(b))
                THEN 'ok' ELSE 'unavailable' END AS validity
    FROM pr JOIN s USING (series_id, pair_id) GROUP BY 1, 2""",
)
def band_pairs(t):
    from gyre.functions.guards import worst_status
    from gyre.operators.sequence import direction_summary, paired_changes

    traces = traces_of(t, P.radial_band(SIDE, SIDE), "band")
    keys = ["series_id", "pair_id"]
    paired = E.paired_traces(traces, KEY, "position", "band", "relative", BANDS).withColumn("src", F.col("position"))
    levels = E.level_correlation(paired, keys, "a", "b")
    moves = direction_summary(paired_changes(paired, keys, "position", "src", "a", "b", dense=False), keys, "relationship", "tie")
    both = levels.join(moves.withColumnRenamed("status", "move_status"), keys)
    return both.select(
        *keys, "paired", "pearson_r", "same_pairs", "opposite_pairs", "tie_pairs", "same_fraction",
        worst_status("status", "move_status").alias("validity"),
    )


@query(
    "e5_next_observed",
    f"""WITH {CYCLES}, n AS (SELECT series_id, slot, coalesce(lead(slot) OVER (PARTITION BY series_id ORDER BY slot),
                                min(slot) OVER (PARTITION BY series_id)) AS to_slot FROM cycles),
    g AS (SELECT *, (to_slot - slot + {PERIOD}) % {PERIOD} AS frame_gap FROM n)
    SELECT series_id, slot, to_slot, frame_gap, frame_gap = 1 AS consecutive, frame_gap - 1 AS unsampled, frame_gap > 2 AS skipped
    FROM g WHERE frame_gap > 0""",
)
def next_observed(t):
    return C.next_observed(t.cycles, KEY, "slot", PERIOD, 2)


ANCHORS = """,
anchors AS (SELECT series_id, slot, row_number() OVER (PARTITION BY series_id ORDER BY round(peak, 6) DESC, slot) AS rank FROM cycles)"""


def anchors(t):
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy(F.round("peak", 6).desc(), "slot")
    return t.cycles.select("series_id", "slot", F.row_number().over(w).alias("rank"))


@query(
    "e6_anchor_neighbours",
    f"""WITH {CYCLES}{ANCHORS}, p AS (
      SELECT series_id, rank * 2 AS o, (slot + {PERIOD - 1}) % {PERIOD} AS a, slot AS b FROM anchors
      UNION ALL SELECT series_id, rank * 2 + 1, slot, (slot + 1) % {PERIOD} FROM anchors),
    f AS (SELECT series_id, a, b, min(o) AS o FROM p GROUP BY 1, 2, 3)
    SELECT series_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(pair_no AS INTEGER) AS pair_no FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY o) AS pair_no FROM f) WHERE pair_no <= 6""",
)
def anchor_neighbours(t):
    return C.anchor_neighbours(anchors(t), KEY, "slot", "rank", PERIOD, 6)


@query(
    "e7_cover_arc",
    f"""WITH {CYCLES}{ANCHORS}, n AS (
      SELECT series_id, slot, coalesce(lead(slot) OVER (PARTITION BY series_id ORDER BY slot), min(slot) OVER (PARTITION BY series_id)) AS nx,
             count(*) OVER (PARTITION BY series_id) AS k FROM anchors),
    g AS (SELECT *, (nx - slot + {PERIOD}) % {PERIOD} AS gap FROM n),
    w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gap DESC, slot) AS o FROM g WHERE k >= 2),
    arc AS (SELECT series_id, nx AS arc_start, slot AS arc_end, gap AS excluded_gap, (slot - nx + {PERIOD}) % {PERIOD} + 2 AS pair_count
            FROM w WHERE o = 1),
    st AS (SELECT *, unnest(CASE WHEN pair_count <= 16 THEN range(CAST(pair_count AS BIGINT)) ELSE [NULL] END) AS step FROM arc)
    SELECT series_id, arc_start, arc_end, excluded_gap, pair_count, CAST(step AS INTEGER) AS step,
           CAST((arc_start - 1 + step + {PERIOD}) % {PERIOD} AS INTEGER) AS from_slot,
           CAST((arc_start + step) % {PERIOD} AS INTEGER) AS to_slot,
           CASE WHEN step IS NULL THEN 'arc_exceeds_cap' ELSE 'ok' END AS status
    FROM st""",
)
def cover_arc(t):
    return C.cover_arc(anchors(t).drop("rank"), KEY, "slot", PERIOD, 1, 16)


BRIGHT_ROWS = """SELECT vec_id // 16 AS series_id, vec_id % 16 AS position, k, CAST(v AS DOUBLE) AS v FROM (
      SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings) WHERE v > 0.25::FLOAT"""


def strong_samples(t):
    return t.vectors.select("series_id", "position", F.posexplode("embedding").alias("k", "v")).where(
        F.col("v") > F.lit(0.25).cast("float")
    ).withColumn("v", F.col("v").cast("double"))


@query(
    "e8_proximity_pairs",
    f"""WITH o AS (SELECT series_id, position, v FROM ({BRIGHT_ROWS}))
    SELECT a.series_id, a.position AS frame_a, b.position AS frame_b, {r6("min(abs(a.v - b.v))")} AS separation,
           min(abs(a.v - b.v)) <= 0.002 AS close
    FROM o a JOIN o b ON b.series_id = a.series_id AND a.position < b.position GROUP BY 1, 2, 3""",
)
def proximity_pairs(t):
    return E.proximity_pairs(strong_samples(t), KEY, "position", "v", 0.002)


@query(
    "e9_greedy_match",
    f"""WITH RECURSIVE s AS (SELECT series_id, position, k // 16 AS family, (k + 0.5) / 64 AS fraction, v AS x, (k % 16) / 16 AS y, CAST(k AS BIGINT) AS k FROM ({BRIGHT_ROWS})),
    g AS (SELECT a.series_id, a.position, a.k AS i, b.k AS j, abs(a.fraction - b.fraction) AS r, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS e, b.fraction - a.fraction AS delta
          FROM s a JOIN s b ON b.series_id = a.series_id AND b.position = a.position + 1 AND b.family = a.family),
    o AS (SELECT *, round(0.75 * r / 0.06 + 0.25 * e / 0.3, 12) AS cost,
                 row_number() OVER (PARTITION BY series_id, position ORDER BY round(0.75 * r / 0.06 + 0.25 * e / 0.3, 12), i, j) AS n
          FROM g WHERE r <= 0.06 AND e <= 0.3),
    fold(series_id, position, n, ti, tj, taken) AS (
      SELECT DISTINCT series_id, position, 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM o
      UNION ALL
      SELECT o.series_id, o.position, o.n, CASE WHEN ok THEN list_append(ti, i) ELSE ti END, CASE WHEN ok THEN list_append(tj, j) ELSE tj END, ok
      FROM (SELECT o.*, f.ti, f.tj, NOT list_contains(f.ti, o.i) AND NOT list_contains(f.tj, o.j) AS ok
            FROM fold f JOIN o ON o.series_id = f.series_id AND o.position = f.position AND o.n = f.n + 1) o),
    m AS (SELECT o.* FROM o JOIN fold USING (series_id, position, n) WHERE taken)
    SELECT series_id, position, i, j, {r6("cost")} AS cost, {r6("delta")} AS delta, {r6("e")} AS shift, 'matched' AS kind FROM m
    UNION ALL
    SELECT series_id, position, k, NULL, NULL, NULL, NULL, 'not_redetected' FROM s ANTI JOIN (SELECT series_id, position, i AS k FROM m) USING (series_id, position, k)
    UNION ALL
    SELECT series_id, position, NULL, k, NULL, NULL, NULL, 'newly_detected' FROM (SELECT series_id, position - 1 AS position, k FROM s) ANTI JOIN (SELECT series_id, position, j AS k FROM m) USING (series_id, position, k)""",
)
def greedy_match(t):
    seg = strong_samples(t).select(
        *FRAME,
        F.floor(F.col("k") / 16).alias("family"),
        ((F.col("k") + 0.5) / 64).alias("fraction"),
        F.col("v").alias("mid_x"),
        ((F.col("k") % 16) / 16).alias("mid_y"),
        F.col("k").cast("bigint").alias("segment"),
    )
    after = seg.withColumn("position", F.col("position") - 1)
    return E.greedy_match(seg, after, FRAME, "family", "fraction", "mid_x", "mid_y", "segment", 0.06, 0.3)


@query(
    "e10_circular_nearest",
    f"""WITH a AS (SELECT DISTINCT user_id AS series_id, hour(ts) AS h FROM events WHERE event_type = 'purchase'),
    b AS (SELECT DISTINCT user_id AS series_id, hour(ts) AS h FROM events WHERE event_type = 'signup')
    SELECT series_id, CAST(min(least((a.h - b.h + {PERIOD}) % {PERIOD}, (b.h - a.h + {PERIOD}) % {PERIOD})) AS INTEGER) AS nearest,
           count(*) FILTER (a.h = b.h) AS overlap
    FROM a JOIN b USING (series_id) GROUP BY 1""",
)
def circular_nearest(t):
    side = lambda kind: t.events.where(F.col("event_type") == kind).select(
        F.col("user_id").alias("series_id"), F.hour("ts").alias("slot")
    )
    return C.circular_nearest(side("purchase"), side("signup"), KEY, "slot", PERIOD)


@query(
    "e11_distance_bins",
    f"""WITH {CYCLES}, d AS (SELECT series_id, least(slot % {PERIOD}, ({PERIOD} - slot) % {PERIOD}) AS d FROM cycles)
    SELECT CASE WHEN d BETWEEN 1 AND 2 THEN '001-002' WHEN d BETWEEN 3 AND 8 THEN '003-008' WHEN d BETWEEN 9 AND 12 THEN '009-012' END AS bin,
           count(*) AS slots FROM d GROUP BY 1""",
)
def distance_bins(t):
    d = C.circular_distance(F.col("slot"), F.lit(0), PERIOD)
    label = E.distance_bins(d, [(1, 2), (3, 8), (9, 12)])
    return t.cycles.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("slots"))


@query(
    "e12_matched_pair",
    f"""WITH {SUPPORT}, r AS (SELECT series_id, position, gs AS m, ln(g) AS b FROM whole WHERE g > 0),
    c AS (SELECT a.series_id, a.position AS f, z.position AS s, round(abs(z.m - a.m), 12) AS mg, round(abs(z.b - a.b), 12) AS bg,
                 round(abs(z.b - a.b), 12) <= ln(1.02) AS ok
          FROM r a JOIN r z ON z.series_id = a.series_id AND a.position < z.position),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ok DESC, CASE WHEN ok THEN -mg ELSE bg END,
                 CASE WHEN ok THEN bg ELSE -mg END, f, s) AS o, count(*) FILTER (ok) OVER (PARTITION BY series_id) AS n FROM c)
    SELECT series_id, f AS "first", s AS "second", {r6("mg")} AS measure_gap, {r6("bg")} AS brightness_gap, ok AS matched, n AS candidates
    FROM k WHERE o = 1""",
)
def matched_pair(t):
    rows = D.on_support(t.pixels, t.frames, "fixed").groupBy(*FRAME).agg(
        F.median("brightness").alias("level"),
        (F.percentile("brightness", F.lit(0.9)) - F.percentile("brightness", F.lit(0.1))).alias("spread"),
    )
    return E.matched_pair(rows, KEY, "position", "level", "spread")


@query(
    "e13_matched_area_pair",
    f"""WITH RECURSIVE {MORPH}, r AS (SELECT series_id, position, af AS a, lf AS s FROM morph WHERE status = 'ok'),
    c AS (SELECT x.series_id, x.position AS f, z.position AS s, round(abs(x.a - z.a), 12) AS ag, round(-abs(x.s - z.s), 12) AS n,
                 round(abs(x.a - z.a), 12) <= 0.02 AS ok
          FROM r x JOIN r z ON z.series_id = x.series_id AND x.position < z.position),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ok DESC, n, ag, f, s) AS o FROM c)
    SELECT series_id, f AS "first", s AS "second", {r6("-n")} AS shape_gap, {r6("ag")} AS area_gap, ok AS within_tolerance FROM k WHERE o = 1""",
)
def matched_area_pair(t):
    frames = D.flash_morphology(*flash_cells(t), FRAME).where("status = 'ok'")
    return E.matched_area_pair(frames, KEY, "position", "active_fraction", "largest_component_fraction")


@query(
    "e17_id_set_diff",
    """WITH r AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS o FROM customer),
    c AS (SELECT o_custkey AS id, min(o_orderkey % 25) AS o FROM orders GROUP BY 1)
    SELECT coalesce(r.id, c.id) AS id, r.o AS reference_owner, c.o AS candidate_owner,
           CASE WHEN c.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'extra' ELSE 'reassigned' END AS kind
    FROM r FULL JOIN c ON r.id = c.id WHERE r.id IS NULL OR c.id IS NULL OR r.o IS DISTINCT FROM c.o""",
)
def id_set_diff(t):
    ref = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("owner"))
    cand = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.pmod("o_orderkey", F.lit(25))).alias("owner"))
    return E.id_set_diff(ref, cand, "id", "owner")


@query(
    "e18_state_regressions",
    f"""WITH c AS (SELECT l_orderkey AS id, min(l_linestatus) AS st, avg(l_discount) AS cf FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_totalprice / 1000.0::DOUBLE AS cf FROM orders),
    b AS (SELECT r.id, r.st AS rs, c.st AS cs, r.cf AS rc, c.cf AS cc FROM r JOIN c ON r.id = c.id)
    SELECT id, rs AS reference_state, cs AS candidate_state, {r6("rc")} AS reference_confidence, {r6("cc")} AS candidate_confidence,
           CASE cs WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE -1 END
             < CASE rs WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS state_regressed,
           {r6("cc - rc")} AS confidence_delta FROM b""",
)
def state_regressions(t):
    ref = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), (F.col("o_totalprice") / 1000.0).alias("confidence")
    )
    cand = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_linestatus").alias("state"), F.avg("l_discount").alias("confidence")
    )
    return E.state_regressions(ref, cand, ["id"], {"state": {"F": 0, "P": 1, "O": 2}}, "confidence")


@query(
    "e19_before_after",
    f"""WITH m AS (SELECT l_partkey AS id, l_linestatus AS st, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2),
    l AS (SELECT id, st, 'quantity' AS metric, q AS v FROM m UNION ALL SELECT id, st, 'discount', d FROM m),
    j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.metric, b.metric) AS metric, a.v AS a, b.v AS b, a.id IS NULL AS na, b.id IS NULL AS nb
          FROM (SELECT * FROM l WHERE st = 'F') a FULL JOIN (SELECT * FROM l WHERE st = 'O') b ON a.id = b.id AND a.metric = b.metric)
    SELECT id, metric, {r6("a")} AS "before", {r6("b")} AS "after", {r6("b - a")} AS absolute_delta,
           CASE WHEN abs(a) > 1e-12 THEN {r6("(b - a) / abs(a)")} END AS relative_delta,
           CASE WHEN na THEN 'missing_before' WHEN nb THEN 'missing_after' ELSE 'ok' END AS status FROM j""",
)
def before_after(t):
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("id"), "l_linestatus").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")
    )
    long = rows.unpivot(["id", "l_linestatus"], ["quantity", "discount"], "metric", "value")
    return E.before_after(long.where("l_linestatus = 'F'"), long.where("l_linestatus = 'O'"), ["id"], "metric", "value")


@query(
    "e20_referential_check",
    """WITH c AS (SELECT user_id AS target, event_type AS tag, count(*) AS links FROM events GROUP BY 1, 2),
    p AS (SELECT s_suppkey AS target, CASE WHEN s_nationkey % 2 = 0 THEN 'click' ELSE 'view' END AS tag FROM supplier)
    SELECT c.target, c.tag, links, CASE WHEN p.target IS NULL THEN 'missing_target' ELSE 'identity_mismatch' END AS problem
    FROM c LEFT JOIN p ON p.target = c.target WHERE p.target IS NULL OR p.tag <> c.tag""",
)
def referential_check(t):
    child = t.events.select(F.col("user_id").alias("target"), F.col("event_type").alias("tag"))
    parent = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "click").otherwise("view").alias("kind"))
    return E.referential_check(child, parent, "target", "s_suppkey", "tag", "kind")


SOURCES = """src AS (SELECT s_suppkey AS id, s_suppkey AS k, s_nationkey AS n, s_acctbal AS b FROM supplier),
pro AS (
  SELECT id, CASE WHEN b < 0 THEN 'unavailable' WHEN b < 3000 THEN 'review' ELSE 'ok' END AS pose, CASE WHEN b < 0 THEN ['no_frames'] WHEN b < 3000 THEN ['few_frames'] ELSE [] END AS pose_r,
         CASE k % 11 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'review' ELSE 'ok' END AS spat, CASE k % 11 WHEN 0 THEN ['no_scale'] WHEN 1 THEN ['coarse'] ELSE [] END AS spat_r,
         k % 7 = 0 AS soft, k % 4 * 64 AS px, CASE k % 13 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'review' ELSE 'ok' END AS ord,
         CASE k % 13 WHEN 0 THEN ['unordered'] WHEN 1 THEN ['inferred_order'] ELSE [] END AS ord_r, CASE k % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'assumed' ELSE 'available' END AS pha,
         CASE WHEN k % 3 = 0 THEN 180 ELSE 360 END AS deg, k % 2 = 0 AS phys, CASE WHEN k % 6 = 0 THEN ['exposure_drift'] ELSE [] END AS pho_r, k % 9 = 0 AS nobg,
         n % 3 = 0 AS rad, n % 4 = 0 AS col, k % 10 / 100.0 AS clip, k % 8 = 0 AS nosize, n % 5 AS pipe FROM src),
sp AS (SELECT *, CASE WHEN spat = 'unavailable' THEN 'unavailable' WHEN spat = 'review' OR soft THEN 'review' ELSE 'ok' END AS ss,
              CASE WHEN spat = 'unavailable' THEN spat_r WHEN spat = 'review' OR soft THEN spat_r || CASE WHEN soft THEN ['transfer_soft'] ELSE [] END ELSE [] END AS sr FROM pro),
rs AS (
  SELECT *, CASE WHEN pose = 'unavailable' THEN pose_r WHEN ss = 'unavailable' THEN sr ELSE pose_r || sr END AS geo_r,
         CASE WHEN ord = 'unavailable' OR pha = 'unavailable' THEN list_sort(list_distinct(ord_r || CASE WHEN pha = 'unavailable' THEN ['no_phase'] ELSE [] END))
              ELSE ord_r || CASE WHEN pha <> 'available' THEN ['phase_contract_requires_review'] ELSE [] END || CASE WHEN pose = 'unavailable' THEN ['pose_coverage_unavailable'] ELSE [] END END AS ang_r,
         list_sort(list_distinct(pho_r || CASE WHEN nobg THEN ['source_global_photometric_stability_unresolved'] ELSE [] END)) AS lum_r,
         CASE WHEN rad THEN [] ELSE ['source_is_not_radiometrically_calibrated'] END AS abs_r,
         list_sort(list_distinct(pho_r || CASE WHEN col THEN [] ELSE ['source_is_not_colour_calibrated'] END || CASE WHEN clip > CLIP THEN ['material_stone_channel_clipping'] ELSE [] END)) AS chr_r FROM sp),
assessed AS (
  SELECT id, 'geometry_topology' AS family, CASE WHEN pose = 'unavailable' OR ss = 'unavailable' THEN 'unavailable' WHEN len(geo_r) > 0 THEN 'review' ELSE 'ok' END AS status, geo_r AS reasons FROM rs
  UNION ALL SELECT id, 'spatial_optical_morphology', ss, sr FROM rs UNION ALL SELECT id, 'tier_edge_crispness', ss, sr FROM rs
  UNION ALL SELECT id, 'physical_spatial_scale', CASE WHEN nosize THEN 'unavailable' ELSE 'ok' END, CASE WHEN nosize THEN ['no_size'] ELSE [] END FROM rs
  UNION ALL SELECT id, 'ordered_dynamics', ord, ord_r FROM rs
  UNION ALL SELECT id, 'angular_persistence', CASE WHEN ord = 'unavailable' OR pha = 'unavailable' THEN 'unavailable' WHEN len(ang_r) > 0 THEN 'review' ELSE 'ok' END, ang_r FROM rs
  UNION ALL SELECT id, 'relative_luminance_dynamics', CASE WHEN len(lum_r) > 0 THEN 'review' ELSE 'ok' END, lum_r FROM rs
  UNION ALL SELECT id, 'absolute_luminance_amplitude', CASE WHEN len(abs_r) > 0 THEN 'review' ELSE 'ok' END, abs_r FROM rs
  UNION ALL SELECT id, 'chromatic_activity', CASE WHEN len(chr_r) > 0 THEN 'review' ELSE 'ok' END, chr_r FROM rs)""".replace("CLIP THEN", f"{CMP.CLIPPING_REVIEW} THEN")


def sources(t):
    """A source profile for every supplier."""
    k, n, b = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    none = F.array().cast("array<string>")
    state = lambda bad, weak=None: F.when(bad, "unavailable").when(weak if weak is not None else F.lit(False), "review").otherwise("ok")
    told = lambda *said: F.coalesce(*[F.when(c, F.array(F.lit(r))) for c, r in said], none)
    return t.supplier.select(
        k.alias("id"), state(b < 0, b < 3000).alias("pose_status"), told((b < 0, "no_frames"), (b < 3000, "few_frames")).alias("pose_reasons"),
        state(k % 11 == 0, k % 11 == 1).alias("spatial_status"), told((k % 11 == 0, "no_scale"), (k % 11 == 1, "coarse")).alias("spatial_reasons"),
        F.when(k % 7 == 0, "review").otherwise("ok").alias("transfer_status"), told((k % 7 == 0, "transfer_soft")).alias("transfer_reasons"), (k % 4 * 64).alias("target_px"),
        state(k % 13 == 0, k % 13 == 1).alias("ordering_status"), told((k % 13 == 0, "unordered"), (k % 13 == 1, "inferred_order")).alias("ordering_reasons"),
        F.when(k % 5 == 0, "unavailable").when(k % 5 == 1, "assumed").otherwise("available").alias("phase_status"), none.alias("phase_reasons"),
        F.when(k % 5 == 0, "no_phase").alias("phase_reason"), F.when(k % 3 == 0, 180).otherwise(360).alias("period_deg"), (k % 2 == 0).alias("physical_angle"),
        told((k % 6 == 0, "exposure_drift")).alias("photometric_reasons"), F.when(k % 9 == 0, "unavailable").otherwise("ok").alias("background_status"),
        (n % 3 == 0).alias("radiometric"), (n % 4 == 0).alias("colour"), (k % 10 / 100.0).alias("clipping_max"),
        state(k % 8 == 0).alias("physical_status"), told((k % 8 == 0, "no_size")).alias("physical_reasons"), (n % 5).alias("pipeline"),
    )


@query("e21_assess", f"""WITH {SOURCES} SELECT id, family, status, array_to_string(reasons, '|') AS reasons FROM assessed""")
def assess(t):
    return CMP.assess(sources(t), "id").select("id", "family", "status", F.array_join("reasons", "|").alias("reasons"))


@query(
    "e21_can_compare",
    f"""WITH {SOURCES}, p AS (SELECT id AS l, id + 1 AS r FROM src),
    j AS (SELECT l, r, a.family, CASE WHEN 'unavailable' IN (a.status, b.status) THEN 'unavailable' WHEN 'review' IN (a.status, b.status) THEN 'review' ELSE 'ok' END AS st,
                 list_concat(list_transform(a.reasons, lambda x: 'left:' || x), list_transform(b.reasons, lambda x: 'right:' || x)) AS rs,
                 CASE WHEN a.family = 'absolute_luminance_amplitude' AND NOT (u.rad AND v.rad) THEN ['cross_source_radiometric_calibration_missing']
                      WHEN a.family = 'chromatic_activity' AND NOT (u.col AND v.col) THEN ['cross_source_colour_calibration_missing']
                      WHEN a.family IN ('spatial_optical_morphology', 'tier_edge_crispness') AND u.px <> v.px THEN ['common_spatial_transfer_mismatch']
                      WHEN a.family = 'angular_persistence' AND u.deg <> v.deg THEN ['viewer_phase_period_mismatch']
                      WHEN a.family = 'relative_luminance_dynamics' AND u.pipe <> v.pipe THEN ['different_source_pipelines'] ELSE [] END AS ex,
                 CASE WHEN a.family = 'angular_persistence' AND NOT (u.phys AND v.phys) THEN ['viewer_sequence_phase_not_physical_angle'] ELSE [] END AS nt
          FROM p JOIN assessed a ON a.id = l JOIN assessed b ON b.id = r AND b.family = a.family JOIN pro u ON u.id = l JOIN pro v ON v.id = r)
    SELECT l AS "left", r AS "right", family, CASE WHEN st = 'ok' AND len(ex) > 0 THEN 'review' ELSE st END AS status,
           array_to_string(list_sort(list_distinct(list_concat(rs, CASE WHEN st = 'unavailable' THEN [] ELSE ex || nt END))), '|') AS reasons
    FROM j""",
)
def can_compare(t):
    profiles = sources(t)
    pairs = profiles.select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    return CMP.can_compare(pairs, CMP.assess(profiles, "id"), "id")


HUMAN_SQL = f"""
obs AS (SELECT user_id AS series_id, user_id AS id, 'mobility' AS family, CASE WHEN user_id % 2 = 0 THEN 'score' ELSE 'none' END AS field_id,
               list_sort(list_distinct(list(CAST(hour(ts) AS INTEGER)))) AS frames FROM events WHERE event_type = 'signup' GROUP BY 1),
items AS (SELECT user_id AS series_id, event_type AS item_id, CASE WHEN event_type = 'view' THEN 'mobility' ELSE 'occupancy' END AS family,
                 CASE WHEN event_type = 'purchase' THEN ['score', 'peak'] ELSE ['peak'] END AS field_ids,
                 list_sort(list_distinct(list(CAST(hour(ts) AS INTEGER)))) AS frames
          FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)"""


@query(
    "e22_human_links",
    f"""WITH {HUMAN_SQL}, ex AS (SELECT o.*, i.item_id, i.frames AS f2, 'exact_field' AS res FROM obs o JOIN items i
                                 ON i.series_id = o.series_id AND list_contains(i.field_ids, o.field_id)),
    fa AS (SELECT o.*, i.item_id, i.frames AS f2, 'family' AS res FROM obs o JOIN items i ON i.series_id = o.series_id AND i.family = o.family
           WHERE o.id NOT IN (SELECT id FROM ex)),
    un AS (SELECT o.*, NULL AS item_id, NULL AS f2, 'unresolved' AS res FROM obs o WHERE o.id NOT IN (SELECT id FROM ex) AND o.id NOT IN (SELECT id FROM fa)),
    u AS (SELECT * FROM ex UNION ALL SELECT * FROM fa UNION ALL SELECT * FROM un)
    SELECT id, series_id, field_id, item_id, res AS resolution,
           CASE WHEN item_id IS NOT NULL THEN CAST(len(list_intersect(frames, f2)) AS INTEGER) END AS overlap,
           CAST(list_min(list_transform(frames, lambda a: list_min(list_transform(f2, lambda b: least((a - b + {PERIOD}) % {PERIOD}, (b - a + {PERIOD}) % {PERIOD}))))) AS INTEGER) AS nearest
    FROM u""",
)
def human_links(t):
    hours = F.array_sort(F.collect_set(F.hour("ts")))  # at most 24 values
    obs = (
        t.events.where("event_type = 'signup'")
        .groupBy(F.col("user_id").alias("series_id"))
        .agg(hours.alias("frames"))
        .select(
            "series_id", F.col("series_id").alias("id"), F.lit("mobility").alias("family"),
            F.when(F.col("series_id") % 2 == 0, "score").otherwise("none").alias("field_id"), "frames",
        )
    )
    items = (
        t.events.where("event_type != 'signup'")
        .groupBy(F.col("user_id").alias("series_id"), F.col("event_type").alias("item_id"))
        .agg(hours.alias("frames"))
        .select(
            "series_id", "item_id", F.when(F.col("item_id") == "view", "mobility").otherwise("occupancy").alias("family"),
            F.when(F.col("item_id") == "purchase", F.array(F.lit("score"), F.lit("peak"))).otherwise(F.array(F.lit("peak"))).alias("field_ids"),
            "frames",
        )
    )
    return E.human_links(obs, items, PERIOD)


