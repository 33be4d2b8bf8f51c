"""Profiles, benchmarks, calibration (family H) and source-quality summaries (D30-D34, D38, D41, D42)."""

from pyspark.sql import functions as F

from gyre.operators import benchmark as B
from gyre.operators import rules as L
from gyre.operators import sequence as S
from gyre.plans.pairing_queries import HUMAN_SQL, human_links
from gyre.plans.registry import query, r6
from gyre.plans.views import CYCLES, RUNS

KEY = ["series_id"]


@query(
    "d30_source_stats",
    f"""WITH m AS (SELECT lang, median(n_chars) AS m FROM documents GROUP BY 1)
    SELECT d.lang, count(*) AS count, {r6("max(m)")} AS median, min(n_chars) AS min, max(n_chars) AS max, {r6("median(abs(n_chars - m))")} AS mad
    FROM documents d JOIN m ON m.lang = d.lang GROUP BY 1""",
)
def source_stats(t):
    return B.source_stats(t.documents, ["lang"], "n_chars")


@query(
    "d31_sequence_contract",
    """WITH f AS (SELECT source AS seq, n_chars % 500 AS idx, sha256(text) AS h, lang FROM documents),
    i AS (SELECT seq, count(idx) - count(DISTINCT idx) AS di, count(h) - count(DISTINCT h) AS dp, count(*) AS n, max(lang) AS o FROM f GROUP BY 1),
    r AS (SELECT *, list_filter([CASE WHEN di > 0 THEN 'duplicate_source_indices' END, CASE WHEN dp > 0 THEN 'duplicate_source_frames_detected' END,
             CASE WHEN o <> 'explicit_manifest' THEN 'ordering_not_explicit_manifest' END, CASE WHEN n <> 256 THEN 'complete_cycle_not_proven' END], lambda x: x IS NOT NULL) AS r FROM i)
    SELECT seq, n AS frames, di AS duplicate_indices, dp AS duplicate_pixels, CASE WHEN len(r) > 0 THEN 'review' ELSE 'ok' END AS status, array_to_string(r, '|') AS reasons FROM r""",
)
def sequence_contract(t):
    rows = t.documents.select(
        F.col("source").alias("seq"), (F.col("n_chars") % 500).alias("idx"), F.sha2("text", 256).alias("h"), F.lit(256).alias("declared"), "lang"
    )
    return B.sequence_contract(rows, "seq", "idx", "h", "declared", "lang")


POSE = """pose AS (SELECT o_custkey AS id, o_orderkey AS rank, o_totalprice AS width, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'review' ELSE 'rejected' END AS status,
                   CASE WHEN o_orderpriority LIKE '1%' THEN 'main' ELSE 'other' END AS role FROM orders)"""


def pose(t):
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "review").otherwise("rejected")
    role = F.when(F.col("o_orderpriority").startswith("1"), "main").otherwise("other")
    return t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("rank"), F.col("o_totalprice").alias("width"), status.alias("status"), role.alias("role")
    )


COVERAGE = """cov AS (SELECT id, count(*) AS frames, count(*) FILTER (status = 'ok') AS ok_frames, count(*) FILTER (status = 'review') AS review_frames,
    count(*) FILTER (status = 'rejected') AS rejected_frames, count(*) FILTER (status IN ('ok', 'review')) AS usable,
    count(*) FILTER (status IN ('ok', 'review') AND role = 'main') AS preferred_usable FROM pose GROUP BY 1)"""
COV_STATUS = "CASE WHEN usable = 0 THEN 'unavailable' WHEN preferred_usable = 0 THEN 'review' ELSE 'ok' END"


@query(
    "d32_pose_coverage",
    f"""WITH {POSE}, {COVERAGE} SELECT *, {COV_STATUS} AS status,
        CASE WHEN usable = 0 THEN 'no_geometry_usable_pose_frames' WHEN preferred_usable = 0 THEN 'crown_view_interval_not_resolved' END AS reason FROM cov""",
)
def pose_coverage(t):
    return B.pose_coverage(pose(t), "id", "status", "role", "main")


EXTENTS = """us AS (SELECT *, bool_or(role = 'main') OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM pose WHERE status IN ('ok', 'review')),
ch AS (SELECT * FROM us WHERE CASE WHEN p THEN role = 'main' ELSE k <= 16 END),
cm AS (SELECT id, median(width) AS m FROM ch GROUP BY 1)"""


@query(
    "d33_pose_extents",
    f"""WITH {POSE}, {EXTENTS} SELECT id, count(*) AS count, {r6("max(m)")} AS median, {r6("min(width)")} AS min, {r6("max(width)")} AS max, {r6("median(abs(width - m))")} AS mad,
        CASE WHEN bool_or(p) THEN 'preferred_role' ELSE 'top_ranked_usable' END AS provenance FROM ch JOIN cm USING (id) GROUP BY 1""",
)
def pose_extents(t):
    return B.pose_extents(pose(t), "id", "status", "role", "main", "rank", "width")


@query(
    "d34_physical_scale",
    f"""WITH {POSE}, {COVERAGE}, {EXTENTS}, x AS (SELECT cm.id, m, {COV_STATUS} AS ps, c_acctbal AS w, c_nationkey AS l FROM cm JOIN cov USING (id) LEFT JOIN customer ON c_custkey = cm.id)
    SELECT id, CASE WHEN w > 0 AND l > 0 THEN {r6("m / w")} END AS px_per_mm_x, CASE WHEN w > 0 AND l > 0 THEN {r6("m / l")} END AS px_per_mm_y,
           CASE WHEN NOT coalesce(w > 0 AND l > 0, false) THEN 'unavailable' WHEN ps = 'ok' THEN 'ok' ELSE 'review' END AS status FROM x""",
)
def physical_scale(t):
    rows = pose(t)
    cover = B.pose_coverage(rows, "id", "status", "role", "main").select("id", F.col("status").alias("pose_status"))
    extents = B.pose_extents(rows, "id", "status", "role", "main", "rank", "width").select(
        "id", F.col("median").alias("median_width"), F.col("median").alias("median_height")
    )
    dims = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("width_mm"), F.col("c_nationkey").alias("length_mm"))
    return B.physical_scale(extents.join(cover, "id"), dims, "id")


@query(
    "d38_trace_rates",
    f"""WITH {RUNS}, s AS (SELECT series_id, sum(length) AS o, count(*) FILTER (left_boundary = 'state_change') AS t,
        sum(length - 1) + count(*) FILTER (left_boundary = 'state_change') AS p, coalesce(max(length) FILTER (state), 0) AS lt, coalesce(max(length) FILTER (NOT state), 0) AS lf FROM runs GROUP BY 1)
    SELECT series_id, {r6("t / nullif(p, 0)")} AS transition_rate, {r6("lt / o")} AS longest_true_fraction, {r6("lf / o")} AS longest_false_fraction FROM s""",
)
def trace_rates(t):
    return B.trace_rates(S.state_summary(S.runs(t.states, KEY, "position", "state", "barrier"), KEY), KEY)


RULER = """rl AS (SELECT l_suppkey AS entity, CASE WHEN l_quantity > 40 THEN 'unavailable' WHEN l_quantity > 25 THEN 'review' ELSE 'ok' END AS status,
    l_discount AS support, l_tax AS confidence, l_extendedprice AS residual, l_quantity <= 25 AS supported FROM lineitem)"""


def ruler(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.when(q > 40, "unavailable").when(q > 25, "review").otherwise("ok").alias("status"),
        F.col("l_discount").alias("support"), F.col("l_tax").alias("confidence"), F.col("l_extendedprice").alias("residual"), (q <= 25).alias("supported"),
        F.when(q <= 40, q).alias("z"),
    )


@query(
    "d41_fixed_ruler_summary",
    f"""WITH {RULER} SELECT entity, count(*) AS frames, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'review') AS review,
        count(*) FILTER (status = 'unavailable') AS unavailable, {r6("avg(support)")} AS mean_support, {r6("avg(confidence)")} AS mean_confidence,
        {r6("count(*) FILTER (status = 'ok') / count(*)")} AS ok_fraction, {r6("median(residual) FILTER (supported)")} AS median_residual FROM rl GROUP BY 1""",
)
def ruler_summary(t):
    return B.ruler_summary(ruler(t), ["entity"])


@query(
    "d42_entity_support",
    f"""WITH d AS (SELECT l_orderkey AS entity, l_quantity <= 25 AS s, CASE WHEN l_quantity <= 40 THEN l_quantity END AS z, l_tax AS c, l_extendedprice AS r FROM lineitem)
    SELECT entity, CASE WHEN bool_and(s) THEN 'ok' WHEN count(z) > 0 THEN 'review' ELSE 'unavailable' END AS status, {r6("coalesce(min(c) FILTER (z IS NOT NULL), 0)")} AS confidence,
           count(*) FILTER (s) AS supported_count, count(*) AS required_count, {r6("min(z)")} AS minimum_z, {r6("median(r) FILTER (s)")} AS median_residual FROM d GROUP BY 1""",
)
def entity_support(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), (q <= 25).alias("supported"), F.when(q <= 40, q).alias("z"), F.col("l_tax").alias("confidence"),
        F.col("l_extendedprice").alias("residual"),
    )
    return B.entity_support(rows, ["entity"])


SUMMARY = """sm AS (SELECT user_id AS id, event_type AS trace_type, CASE WHEN hour(ts) BETWEEN 8 AND 15 THEN 'core' ELSE 'wide' END AS win, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3)"""


def summaries(t):
    window = F.when(F.hour("ts").between(8, 15), "core").otherwise("wide")
    return t.events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("trace_type"), window.alias("window")).agg(
        F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n")
    )


FIELDS = ["view_core", "click_core", "error_wide"]


def cells(t):
    rows = summaries(t).select(
        "id", "trace_type", "window", "value", F.when(F.col("n") < 3, "review").otherwise("ok").alias("status"),
        F.when(F.col("n") < 3, "few_frames").alias("reason"),
    )
    named = rows.withColumn("key", F.concat_ws("_", "trace_type", "window"))
    # The field specification is a short fixed list; it becomes a column, not a join.
    wanted = named.where(F.col("key").isin(*FIELDS)).withColumn("field_id", F.col("key"))
    spec = wanted.select("field_id", "trace_type", "window").distinct()
    return B.build_profile(rows, spec, FIELDS, "id", ["trace_type", "window"])


PROFILE = SUMMARY + """,
sp(field_id, trace_type, win) AS (VALUES ('view_core', 'view', 'core'), ('click_core', 'click', 'core'), ('error_wide', 'error', 'wide')),
cl AS (SELECT i.id, sp.field_id, v AS "value", CASE WHEN v IS NULL THEN 'unavailable' WHEN n < 3 THEN 'review' ELSE 'ok' END AS status,
              CASE WHEN v IS NULL THEN 'missing_row' WHEN n < 3 THEN 'few_frames' ELSE '' END AS reasons
       FROM (SELECT DISTINCT id FROM sm) i CROSS JOIN sp LEFT JOIN sm ON sm.id = i.id AND sm.trace_type = sp.trace_type AND sm.win = sp.win)"""


@query("h1_build_profile", f"""WITH {PROFILE} SELECT id, field_id, {r6('"value"')} AS "value", status, reasons FROM cl""")
def build_profile(t):
    return cells(t)


@query(
    "h2_profile_wide",
    f"""WITH {PROFILE} SELECT id, {", ".join(f"{r6(f'''max(value) FILTER (field_id = '{f}')''')} AS {f}, max(status) FILTER (field_id = '{f}') AS {f}__status, max(reasons) FILTER (field_id = '{f}') AS {f}__reasons" for f in FIELDS)} FROM cl GROUP BY 1""",
)
def profile_wide(t):
    return B.profile_wide(cells(t), "id", FIELDS)


BENCH = """bw AS (SELECT user_id AS id, w AS win, round(avg(value), 6) AS mean_value, max(value) AS top, CAST(count(*) AS DOUBLE) AS n
           FROM events, (SELECT unnest(['core', 'wide']) AS w) WHERE w = 'wide' OR hour(ts) BETWEEN 8 AND 15 GROUP BY 1, 2)"""


def windows(t):
    core = F.hour("ts").between(8, 15)
    named = F.when(core, F.array(F.lit("core"), F.lit("wide"))).otherwise(F.array(F.lit("wide")))
    return t.events.select(F.col("user_id").alias("id"), "value", F.explode(named).alias("window")).groupBy("id", "window").agg(
        F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("top"), F.count(F.lit(1)).cast("double").alias("n")
    )


MEASURES = ["mean_value", "top", "n"]


@query(
    "h3_benchmark_rows",
    f"""WITH {BENCH} SELECT id, win AS "window", m AS measure, {r6("v")} AS "value" FROM (
        SELECT id, win, 'mean_value' AS m, mean_value AS v FROM bw UNION ALL SELECT id, win, 'top', top FROM bw UNION ALL SELECT id, win, 'n', n FROM bw)""",
)
def benchmark_rows(t):
    return B.benchmark_rows(windows(t), ["id", "window"], MEASURES)


def rho_sql(source, keys, a, b):
    by = ", ".join(keys)
    return f"""rk AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {a}) + (count(*) OVER (PARTITION BY {by}, {a}) - 1) / 2 AS ra,
                      rank() OVER (PARTITION BY {by} ORDER BY {b}) + (count(*) OVER (PARTITION BY {by}, {b}) - 1) / 2 AS rb
               FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    sr AS (SELECT {by}, CAST(count(*) AS BIGINT) AS paired, CASE WHEN count(*) >= 3 AND max(ra) > min(ra) AND max(rb) > min(rb) THEN {r6("corr(ra, rb)")} END AS rho FROM rk GROUP BY {by})"""


@query(
    "h4_window_sensitivity",
    f"""WITH {BENCH}, lg AS (SELECT id, win, 'mean_value' AS measure, mean_value AS v FROM bw UNION ALL SELECT id, win, 'top', top FROM bw UNION ALL SELECT id, win, 'n', n FROM bw),
    pv AS (SELECT id, measure, max(v) FILTER (win = 'core') AS a, max(v) FILTER (win = 'wide') AS b FROM lg GROUP BY 1, 2), {rho_sql("pv", ["measure"], "a", "b")} SELECT * FROM sr""",
)
def window_sensitivity(t):
    return B.window_sensitivity(B.benchmark_rows(windows(t), ["id", "window"], MEASURES), ["id"], "window", "core", "wide")


@query(
    "h5_redundancy_matrix",
    f"""WITH {BENCH}, pr AS (SELECT 'mean_value' AS l, 'top' AS r, mean_value AS x, top AS y FROM bw UNION ALL SELECT 'mean_value', 'n', mean_value, n FROM bw UNION ALL SELECT 'top', 'n', top, n FROM bw),
    {rho_sql("pr", ["l", "r"], "x", "y")} SELECT l AS "left", r AS "right", paired, rho FROM sr""",
)
def redundancy_matrix(t):
    return B.redundancy_matrix(windows(t), MEASURES)


@query(
    "h6_object_status",
    """WITH m AS (SELECT DISTINCT user_id AS k FROM events)
    SELECT c_custkey AS id, CASE WHEN m.k IS NOT NULL THEN 'measured' WHEN c_acctbal < 0 THEN 'partial_source' ELSE 'source_available' END AS status
    FROM customer LEFT JOIN m ON m.k = c_custkey""",
)
def object_status(t):
    objects = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "partial").otherwise("complete").alias("source_status"))
    return B.object_status(objects, t.events.select(F.col("user_id").alias("id")), "id", "source_status")


@query(
    "h7_ordered_claims",
    f"""WITH {PROFILE}, c AS (SELECT DISTINCT id AS claim_id, id % 2 = 0 AS inc FROM sm),
    s AS (SELECT claim_id, inc, i, claim_id + i AS id FROM c, range(3) AS r(i)),
    j AS (SELECT s.claim_id, inc, i, "value" - lag("value") OVER (PARTITION BY s.claim_id ORDER BY i) AS st, "value" FROM s LEFT JOIN cl ON cl.id = s.id AND cl.field_id = 'view_core')
    SELECT claim_id, count(*) AS samples, CASE WHEN count("value") < 3 THEN 'mismatch' WHEN bool_and(i = 0 OR CASE WHEN inc THEN st >= 0 ELSE st <= 0 END) THEN 'supports' ELSE 'contradicts' END AS verdict
    FROM j GROUP BY 1""",
)
def ordered_claims(t):
    ids = t.events.select(F.col("user_id").alias("claim_id")).distinct()
    claims = ids.select(
        "claim_id", F.lit("view_core").alias("field_id"), (F.col("claim_id") % 2 == 0).alias("increasing"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("claim_id") + i).alias("samples"),
    )
    return B.ordered_claims(claims, cells(t), "id")


OBS = """ob AS (SELECT event_id AS id, user_id AS series_id, event_type AS family, CASE WHEN value > 60 THEN 'unexplained' WHEN value > 20 THEN 'partial' ELSE 'full' END AS explanation,
    'hour-' || hour(ts) AS concept, CASE WHEN value > 60 THEN NULL WHEN event_id % 2 = 0 THEN 'view_core' ELSE 'click_core' END AS field_id FROM events)"""


def observations(t):
    v = F.col("value")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("series_id"), F.col("event_type").alias("family"),
        F.when(v > 60, "unexplained").when(v > 20, "partial").otherwise("full").alias("explanation"),
        F.concat(F.lit("hour-"), F.hour("ts")).alias("concept"),
        F.when(v > 60, None).when(F.col("event_id") % 2 == 0, "view_core").otherwise("click_core").alias("field_id"),
    )


@query(
    "h8_family_summary",
    f"""WITH {OBS} SELECT family, count(*) AS observations, count(*) FILTER (explanation = 'full') AS "full", count(*) FILTER (explanation = 'partial') AS partial,
        count(*) FILTER (explanation = 'unexplained') AS unexplained, count(DISTINCT series_id) AS objects, string_agg(DISTINCT field_id, '|' ORDER BY field_id) AS fields FROM ob GROUP BY 1""",
)
def family_summary(t):
    return B.family_summary(observations(t), ["full", "partial", "unexplained"])


@query("h9_unexplained_concepts", f"""WITH {OBS} SELECT concept, count(*) AS observations FROM ob WHERE explanation = 'unexplained' GROUP BY 1""")
def unexplained_concepts(t):
    return B.unexplained_concepts(observations(t))


@query(
    "h10_link_audit",
    f"""WITH {HUMAN_SQL}, ex AS (SELECT o.id, i.item_id, len(list_intersect(o.frames, i.frames)) AS ov, 'exact_field' AS res FROM obs o JOIN items i
                                 ON i.series_id = o.series_id AND list_contains(i.field_ids, o.field_id)),
    fa AS (SELECT o.id, i.item_id, len(list_intersect(o.frames, i.frames)) AS ov, 'family' AS res FROM obs o JOIN items i ON i.series_id = o.series_id AND i.family = o.family WHERE o.id NOT IN (SELECT id FROM ex)),
    un AS (SELECT id, NULL AS item_id, NULL AS ov, 'unresolved' AS res FROM obs WHERE id NOT IN (SELECT id FROM ex) AND id NOT IN (SELECT id FROM fa)),
    u AS (SELECT * FROM ex UNION ALL SELECT * FROM fa UNION ALL SELECT * FROM un)
    SELECT res AS resolution, count(*) AS links, count(*) FILTER (ov > 0) AS with_overlap, count(*) FILTER (item_id IS NOT NULL AND ov = 0) AS without_overlap FROM u GROUP BY 1""",
)
def link_audit(t):
    return B.link_audit(human_links(t))


@query(
    "h11_calibration_rows",
    f"""WITH {PROFILE}, rk AS (SELECT id, field_id, "value", row_number() OVER (PARTITION BY field_id ORDER BY "value" DESC, id) AS rank_descending FROM cl WHERE "value" IS NOT NULL),
    o AS (SELECT user_id AS series_id, max(event_id) AS id FROM events GROUP BY 1),
    f AS (SELECT id, series_id, unnest(CASE WHEN series_id % 3 = 0 THEN [NULL] ELSE ['view_core', 'click_core'] END) AS field_id FROM o)
    SELECT f.id, f.series_id, f.field_id, {r6('"value"')} AS "value", rank_descending FROM f LEFT JOIN rk ON rk.id = f.series_id AND rk.field_id = f.field_id""",
)
def calibration_rows(t):
    orders = S.field_orders(cells(t).select("id", "field_id", "value"), ["field_id"], "id", "value")
    orders = orders.select(F.col("id").alias("series_id"), "field_id", "value", "rank_descending")
    none = F.array().cast("array<string>")
    obs = t.events.groupBy(F.col("user_id").alias("series_id")).agg(F.max("event_id").alias("id")).withColumn(
        "fields", F.when(F.col("series_id") % 3 == 0, none).otherwise(F.array(F.lit("view_core"), F.lit("click_core")))
    )
    return B.calibration_rows(obs, orders)


@query(
    "h12_observation_trace",
    f"""WITH {CYCLES}, o AS (SELECT DISTINCT user_id AS series_id FROM events), f AS (SELECT series_id, CAST(i AS INTEGER) AS i, CAST((series_id * 5 + i * 7) % 24 AS INTEGER) AS slot FROM o, range(4) AS r(i))
    SELECT f.series_id AS id, f.series_id, f.i, f.slot, {r6("score")} AS score FROM f LEFT JOIN cycles c ON c.series_id = f.series_id AND c.slot = f.slot""",
)
def observation_trace(t):
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.col("series_id") * 5 + i * 7, F.lit(24)).cast("int"))
    obs = t.events.select(F.col("user_id").alias("series_id")).distinct().select("series_id", F.col("series_id").alias("id"), frames.alias("frames"))
    return B.observation_trace(obs, t.cycles.select("series_id", "slot", "score"), "slot")


# What an observation breaks whose event id leaves this remainder by 24.
BROKEN = (
    (0, "role"), (1, "explanation"), (2, "summary"), (3, "frames"), (4, "frames"), (5, "unexplained_links"), (6, "explained_links"),
    (7, "link_field"), (8, "link_repeated"), (9, "link_assessment"), (10, "link_rationale"), (11, "unknown_concept"),
)
VOCABULARY = {
    "family": ("view", "click", "purchase"),
    "role": ("main", "control"),
    "explanation": ("explained", "partial", "unexplained"),
    "field_id": ("core", "wide"),
    "assessment": ("supports", "contradicts"),
}


@query(
    "h13_validate_observations",
    f"""WITH p(r, rule) AS (VALUES {", ".join(f"({r}, '{rule}')" for r, rule in BROKEN)}),
    o AS (SELECT CAST(CASE WHEN event_id % 24 = 13 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS id, event_id, user_id, event_type FROM events),
    k AS (SELECT DISTINCT user_id FROM events WHERE user_id % 9 <> 0),
    w AS (SELECT user_id, unnest(CASE WHEN user_id % 7 = 0 THEN [1, 2] ELSE [1] END) AS n FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0)
    SELECT id AS subject, rule FROM o JOIN p ON p.r = event_id % 24
    UNION ALL SELECT id, 'family' FROM o WHERE event_type NOT IN ('view', 'click', 'purchase')
    UNION ALL SELECT id, 'id_repeated' FROM o GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT id, 'unknown_object' FROM o WHERE user_id % 9 = 0
    UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'review_of_unknown_object' FROM w WHERE user_id NOT IN (SELECT user_id FROM k)
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'review_missing' FROM k WHERE user_id NOT IN (SELECT user_id FROM w)
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'review_repeated' FROM w GROUP BY 1, user_id HAVING count(*) > 1
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'review_path' FROM w WHERE user_id % 4 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), 'review_outcome' FROM w WHERE user_id % 6 = 0""",
)
def validate_observations(t):
    """An observation for every event, sound but for the rule that its id plants, and reviews of the users."""
    e, u = F.col("event_id"), F.col("user_id")
    choose = lambda usual, *special: F.coalesce(*[F.when(e % 24 == r, v) for r, v in special], usual)
    link = lambda field, assessment="supports", why="seen": F.struct(F.lit(field).alias("field_id"), F.lit(assessment).alias("assessment"), F.lit(why).alias("rationale"))
    no_link = F.array().cast("array<struct<field_id:string,assessment:string,rationale:string>>")
    whole = lambda *n: F.array(*[F.lit(x) for x in n])
    obs = t.events.select(
        choose(e, (13, e - 1)).alias("id"), u.alias("series_id"), F.col("event_type").alias("family"),
        choose(F.lit("main"), (0, F.lit("other"))).alias("role"),
        choose(F.lit("partial"), (1, F.lit("maybe")), (5, F.lit("unexplained")), (12, F.lit("unexplained"))).alias("explanation"),
        choose(F.lit("a note"), (2, F.lit(" "))).alias("summary"),
        choose(whole(0, 3), (3, whole(2, 2)), (4, whole(1, -1))).alias("frames"),
        choose(F.lit("contrast"), (11, F.lit("unlisted"))).alias("concept"),
        choose(
            F.array(link("core"), link("wide")), (6, no_link), (12, no_link), (7, F.array(link("old"))), (8, F.array(link("core"), link("core"))),
            (9, F.array(link("core", "unsure"))), (10, F.array(link("wide", "supports", " "))),
        ).alias("links"),
    )
    users = t.events.select(u.alias("series_id")).distinct()
    s = F.col("series_id")
    reviews = users.where(s % 5 != 0).select(
        "series_id", F.when(s % 4 != 0, "notes.md").alias("evaluation_path"), F.when(s % 6 != 0, "agrees").otherwise(" ").alias("outcome"),
        F.explode(F.when(s % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"),
    )
    concepts = t.region.select(F.lit("contrast").alias("concept")).distinct()
    return L.broken_observations(obs, reviews.drop("n"), users.where(s % 9 != 0), concepts, VOCABULARY)
