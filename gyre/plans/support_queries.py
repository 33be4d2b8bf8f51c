"""Interval selection, support and validity queries (family C)."""

from pyspark.sql import functions as F

from gyre.functions.guards import joined
from gyre.operators import sequence as S
from gyre.operators import support as U
from gyre.operators import traces as D
from gyre.plans.registry import query, r6
from gyre.plans.sequence_queries import PAIRS
from gyre.plans.views import CYCLES, PERIOD, PIXELS, STEPS, SUPPORT

KEY = ["series_id"]


@query(
    "c1_cyclic_window",
    f"""WITH {CYCLES}, c AS (SELECT series_id, arg_max(slot, (n, -slot)) AS center FROM cycles GROUP BY 1)
    SELECT series_id, center, CAST({PERIOD} AS INTEGER) AS period, CAST(o + 2 AS INTEGER) AS window_position,
           CAST((center + o + {PERIOD}) % {PERIOD} AS INTEGER) AS source_index FROM c, range(-2, 3) AS r(o)""",
)
def cyclic_window(t):
    c = t.cycles.groupBy(*KEY).agg(F.max(F.struct("n", (-F.col("slot")).alias("s"))).alias("m")).select(
        "series_id", (-F.col("m.s")).alias("center"), F.lit(PERIOD).alias("period")
    )
    return U.cyclic_window(c, "center", 5, "period")


@query(
    "c2_check_consecutive",
    f"""WITH {STEPS}, h AS (SELECT series_id, position, source_index, lag(source_index) OVER w AS prev_source_index,
                                   lag(position) OVER w AS pp, event_type, lag(event_type) OVER w AS pe
                            FROM steps WINDOW w AS (PARTITION BY series_id ORDER BY position)),
    v AS (SELECT 'no_wrap' AS mode, * FROM h WHERE pp IS NOT NULL AND NOT source_index = prev_source_index + 1
          UNION ALL SELECT 'wrap', * FROM h WHERE pp IS NOT NULL AND NOT (source_index = prev_source_index + 1
            OR (source_index = 0 AND prev_source_index = {PERIOD - 1})))
    SELECT mode, series_id, position, source_index, prev_source_index FROM v""",
)
def check_consecutive(t):
    modes = [
        U.check_consecutive(t.steps, KEY, "position", "source_index", PERIOD, wrap).withColumn("mode", F.lit(name))
        for wrap, name in ((False, "no_wrap"), (True, "wrap"))
    ]
    return modes[0].unionByName(modes[1]).select("mode", "series_id", "position", "source_index", "prev_source_index")


FRAMES_SQL = f"""
reqd AS (SELECT user_id AS series_id, CAST(p AS INTEGER) AS position, CAST((p * 5) % {PERIOD} AS INTEGER) AS source_index
         FROM (SELECT DISTINCT user_id FROM events), range({PERIOD}) AS r(p)),
have AS (SELECT user_id AS series_id, CAST(hour(ts) AS INTEGER) AS source_index, count(*) AS n, min(CAST(floor(value) AS BIGINT)) AS digest,
                bool_and(value > 1.0) AS ok FROM events GROUP BY 1, 2),
one AS (SELECT r.*, h.n, h.digest, h.ok FROM reqd r LEFT JOIN have h USING (series_id, source_index)),
fst AS (SELECT series_id, digest, min(position) AS f FROM one WHERE n = 1 AND ok GROUP BY 1, 2),
sel AS (SELECT o.series_id, o.position, o.source_index,
               CASE WHEN n IS NULL THEN 'missing_frame' WHEN n > 1 THEN 'ambiguous_index' WHEN NOT ok THEN 'unaccepted_outline'
                    WHEN f.f < o.position THEN 'duplicate_frame' END AS reason
        FROM one o LEFT JOIN fst f ON f.series_id = o.series_id AND f.digest = o.digest)"""


def selected(t):
    users = t.events.select(F.col("user_id").alias("series_id")).distinct()
    requested = users.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(PERIOD - 1))).alias("position")).withColumn(
        "source_index", F.pmod(F.col("position") * 5, F.lit(PERIOD))
    )
    frames = t.events.select(
        F.col("user_id").alias("series_id"),
        F.hour("ts").alias("source_index"),
        F.floor("value").alias("digest"),
        (F.col("value") > 1.0).alias("accepted"),
    )
    return U.select_frames(requested, frames, KEY, "source_index", "digest", "accepted")


@query("c3_select_frames", f"""WITH {FRAMES_SQL} SELECT * FROM sel""")
def select_frames(t):
    return selected(t).select("series_id", "position", "source_index", "reason")


@query("c4_fixed_support", f"""WITH {SUPPORT} SELECT series_id, y, x FROM fixed""")
def fixed_support(t):
    return U.fixed_support(t.pixels, t.frames, KEY)


@query(
    "c5_support_fractions",
    f"""WITH {PIXELS}, u AS (SELECT series_id, y, x, count(*) FILTER (valid) AS n FROM pixels WHERE observed AND in_mask GROUP BY 1, 2, 3),
    nf AS (SELECT series_id, count(*) AS k FROM frames WHERE observed GROUP BY 1),
    p AS (SELECT series_id, count(*) FILTER (n = k) AS pp, count(*) AS np FROM u JOIN nf USING (series_id) GROUP BY 1),
    f AS (SELECT series_id, position, count(*) FILTER (valid AND in_mask) / count(*) FILTER (in_mask) AS sf FROM pixels WHERE observed GROUP BY 1, 2)
    SELECT f.series_id, f.position, {r6("sf")} AS support_fraction, pp AS persistent_pixels, np AS nominal_pixels, {r6("pp / np")} AS persistent_fraction
    FROM f JOIN p USING (series_id)""",
)
def support_fractions(t):
    frames, series = U.support_fractions(t.pixels, t.frames, KEY, "position")
    return frames.join(series, KEY)


CELLS_SQL = """
cells AS (SELECT user_id AS series_id, event_id,
                 CASE WHEN value < 2 THEN 'unavailable' WHEN value < 10 THEN 'review' ELSE 'ok' END AS status,
                 CASE WHEN value < 2 THEN ['tiny_' || event_type] WHEN value < 10 THEN ['small', 'seen_' || event_type] ELSE [] END AS reasons
          FROM events),
rs AS (SELECT series_id, event_id, unnest(reasons) AS r, unnest(range(len(reasons))) AS i FROM cells),
fr AS (SELECT series_id, r, min((event_id, i)) AS f FROM rs GROUP BY 1, 2),
ls AS (SELECT series_id, array_to_string(list(r ORDER BY f, r), '|') AS reasons FROM fr GROUP BY 1)"""


@query(
    "c6_compose_validity",
    f"""WITH {CELLS_SQL}, w AS (SELECT series_id, max(CASE status WHEN 'unavailable' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS s FROM cells GROUP BY 1)
    SELECT w.series_id, CASE s WHEN 2 THEN 'unavailable' WHEN 1 THEN 'review' ELSE 'ok' END AS status, coalesce(reasons, '') AS reasons
    FROM w LEFT JOIN ls ON ls.series_id = w.series_id""",
)
def compose_validity(t):
    v, kind = F.col("value"), F.col("event_type")
    cells = t.events.select(
        F.col("user_id").alias("series_id"),
        "event_id",
        F.when(v < 2, "unavailable").when(v < 10, "review").otherwise("ok").alias("status"),
        F.when(v < 2, F.array(F.concat(F.lit("tiny_"), kind)))
        .when(v < 10, F.array(F.lit("small"), F.concat(F.lit("seen_"), kind)))
        .otherwise(F.array().cast("array<string>"))
        .alias("reasons"),
    )
    out = U.compose_validity(cells, KEY, "event_id", "status", "reasons")
    return out.withColumn("reasons", joined("reasons"))


def upstream(t):
    status = F.when(F.col("source_index") % 7 == 0, "review").when(F.col("source_index") == 13, "failed").otherwise("ok")
    rows = selected(t).withColumn("seg_status", status).withColumn(
        "seg_reasons", F.when(F.col("source_index") == 14, F.array(F.lit("soft_edge"))).otherwise(F.array().cast("array<string>"))
    )
    return U.compose_validity(U.upstream_cells(rows, KEY, "position"), KEY, "order", "status", "reasons")


UPSTREAM_SQL = FRAMES_SQL + """,
segs AS (SELECT series_id, position AS o, CASE WHEN source_index = 13 THEN 'unavailable' WHEN source_index % 7 = 0 THEN 'review' ELSE 'ok' END AS status,
               CASE WHEN source_index = 14 THEN 'soft_edge' WHEN source_index = 13 THEN 'segmentation_unavailable'
                    WHEN source_index % 7 = 0 THEN 'segmentation_review' END AS r FROM sel WHERE reason IS NULL
        UNION ALL SELECT series_id, 100, 'review', 'requested_frames_excluded' FROM sel GROUP BY 1
                  HAVING count(reason) > 0 AND count(reason) < count(*)
        UNION ALL SELECT series_id, 100, 'unavailable', 'no_accepted_frames' FROM sel GROUP BY 1 HAVING count(reason) = count(*)),
frr AS (SELECT series_id, r, min(o) AS o FROM segs WHERE r IS NOT NULL GROUP BY 1, 2),
lst AS (SELECT series_id, array_to_string(list(r ORDER BY o), '|') AS reasons FROM frr GROUP BY 1),
ups AS (SELECT s.series_id, max(CASE status WHEN 'unavailable' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS s,
               coalesce(any_value(l.reasons), '') AS reasons FROM segs s LEFT JOIN lst l ON l.series_id = s.series_id GROUP BY 1)"""
NAME = "CASE s WHEN 2 THEN 'unavailable' WHEN 1 THEN 'review' ELSE 'ok' END"


@query("c7_upstream_validity", f"""WITH {UPSTREAM_SQL} SELECT series_id, {NAME} AS status, reasons FROM ups""")
def upstream_validity(t):
    return upstream(t).withColumn("reasons", joined("reasons"))


@query(
    "c8_representation_validity",
    f"""WITH {CYCLES}, q AS (SELECT series_id, count(*) AS k, max(n) AS m, min(n) AS l FROM cycles GROUP BY 1),
    c AS (SELECT series_id, rep, rep = 'semantic' AND k >= 17 AS tmpl, rep = 'semantic' AND k < 17 AS none, k >= 17 AND k < 19 AS weak, m >= 7 AS fu, l <= 1 AS fr
          FROM q, (VALUES ('whole'), ('semantic')) AS v(rep))
    SELECT series_id, rep AS representation,
           CASE WHEN none THEN 'unavailable' WHEN tmpl AND fu THEN 'unavailable' WHEN tmpl AND (weak OR fr) THEN 'review' ELSE 'ok' END AS status,
           CASE WHEN none THEN 'semantic_qc_missing' WHEN NOT tmpl THEN '' ELSE
             array_to_string(list_filter([CASE WHEN weak THEN 'template_review' END, CASE WHEN fu THEN 'semantic_frame_unavailable' WHEN fr THEN 'semantic_frame_review' END],
                             lambda x: x IS NOT NULL), '|') END AS reasons
    FROM c""",
)
def representation_validity(t):
    q = t.cycles.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m"), F.min("n").alias("l"))
    rows = q.withColumn("representation", F.explode(F.array(F.lit("whole"), F.lit("semantic"))))
    template = F.when(F.col("k") >= 19, "ok").when(F.col("k") >= 17, "review")
    reason = F.when((F.col("k") >= 17) & (F.col("k") < 19), "template_review")
    cells = U.representation_cells(F.col("representation"), template, reason, F.col("m") >= 7, F.col("l") <= 1)
    local = F.array(F.struct(F.lit("ok").alias("status"), F.array().cast("array<string>").alias("reasons")))
    keys = ["series_id", "representation"]
    long = rows.select(*keys, F.posexplode(F.concat(local, cells)).alias("order", "c")).select(*keys, "order", "c.status", "c.reasons")
    return U.compose_validity(long, keys, "order", "status", "reasons").withColumn("reasons", joined("reasons"))


@query(
    "c9_mobility_validity",
    f"""WITH {STEPS}{PAIRS}, {UPSTREAM_SQL.replace("WITH ", "")}, m AS (
      SELECT series_id, count(change) FILTER (event_type = 'view') AS k FROM pairs GROUP BY 1)
    SELECT u.series_id, CASE greatest(s, CASE WHEN k > 0 THEN 0 ELSE 2 END) WHEN 2 THEN 'unavailable' WHEN 1 THEN 'review' ELSE 'ok' END AS status,
           CASE WHEN k > 0 THEN reasons WHEN reasons = '' THEN 'no_observed_adjacent_pairs' ELSE reasons || '|no_observed_adjacent_pairs' END AS reasons
    FROM ups u JOIN m ON m.series_id = u.series_id""",
)
def mobility_validity(t):
    pairs = S.adjacent_delta(t.steps, KEY, "position", "source_index", "value")
    views = pairs.withColumn("change", F.when(F.col("event_type") == "view", F.col("change")))
    summary = views.groupBy(*KEY).agg(F.when(F.count("change") > 0, "ok").otherwise("unavailable").alias("status"))
    return U.mobility_validity(upstream(t), summary, KEY).withColumn("reasons", joined("reasons"))


@query(
    "c10_threshold_sweep",
    f"""WITH {SUPPORT}, th(k, t) AS (VALUES ('0.65', 0.65::DOUBLE), ('0.75', 0.75::DOUBLE), ('0.85', 0.85::DOUBLE))
    SELECT k AS threshold_key, series_id, position, count(*) AS supported_pixels, count(*) FILTER (brightness < t * g) AS dark_pixels,
           {r6("count(*) FILTER (brightness < t * g) / count(*)")} AS dark_fraction
    FROM fixed_px JOIN whole USING (series_id, position), th GROUP BY 1, 2, 3""",
)
def threshold_sweep(t):
    rows = D.with_whole(D.on_support(t.pixels, t.frames, "fixed"), D.whole_trace(t.pixels, t.frames))
    swept = U.sweep(rows, [0.65, 0.75, 0.85])
    dark = F.count_if(F.col("brightness") < F.col("threshold") * F.col("whole"))
    return swept.groupBy("threshold_key", "series_id", "position").agg(
        F.count(F.lit(1)).alias("supported_pixels"), dark.alias("dark_pixels"), (dark / F.count(F.lit(1))).alias("dark_fraction")
    )


@query(
    "c11_uniform_sample",
    f"""WITH {STEPS}, z AS (SELECT series_id, count(*) AS size FROM steps GROUP BY 1),
    s AS (SELECT series_id, size, i AS sample_no, (i * size) // 16 AS position FROM z, range(16) AS r(i) WHERE size >= 16)
    SELECT s.series_id, s.position, s.sample_no, event_id FROM s JOIN steps t ON t.series_id = s.series_id AND t.position = s.position""",
)
def uniform_sample(t):
    size = t.steps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    return U.uniform_sample(t.steps.join(size, KEY), KEY, "position", "size", 16).select("series_id", "position", "sample_no", "event_id")
