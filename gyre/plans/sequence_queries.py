"""Queries over ordered traces and cycles (family F)."""

from pyspark.sql import functions as F

from gyre.operators import cycles as C
from gyre.operators import sequence as S
from gyre.plans.registry import query, r6
from gyre.plans.views import CYCLES, PERIOD, RUNS, STATES, STEPS

KEY = ["series_id"]

PAIRS = """,
hops AS (
  SELECT *, lag(position) OVER w AS pp, lag(source_index) OVER w AS psi, lag(value) OVER w AS pv,
         lag(other) OVER w AS po
  FROM steps WINDOW w AS (PARTITION BY series_id ORDER BY position)),
pairs AS (
  SELECT *, CASE WHEN NOT (source_index = psi + 1) THEN 'non_adjacent_source_steps'
                 WHEN value IS NULL OR pv IS NULL THEN 'gap' ELSE 'ok' END AS status,
         CASE WHEN source_index = psi + 1 THEN abs(value - pv) END AS change
  FROM hops WHERE pp IS NOT NULL)"""

WRAPPED = """,
hops AS (
  SELECT *, lag(position) OVER w AS pp, lag(source_index) OVER w AS psi, lag(value) OVER w AS pv,
         lag(other) OVER w AS po
  FROM steps WINDOW w AS (PARTITION BY series_id ORDER BY position)),
moves AS (
  SELECT series_id, position, source_index, value - pv AS da, other - po AS db,
         source_index = psi + 1 OR (source_index = 0 AND psi > 0) AS stepped
  FROM hops WHERE pp IS NOT NULL),
pairs AS (
  SELECT series_id, position, CASE WHEN stepped AND da IS NOT NULL AND db IS NOT NULL THEN da END AS da,
         CASE WHEN stepped AND da IS NOT NULL AND db IS NOT NULL THEN db END AS db
  FROM moves)"""


@query(
    "f1_adjacent_delta",
    f"""WITH {STEPS}{PAIRS}
    SELECT series_id, count(*) AS requested_pairs, count(change) AS observed_pairs,
           count(*) FILTER (status = 'gap') AS gap_pairs,
           count(*) FILTER (status = 'non_adjacent_source_steps') AS non_adjacent_pairs,
           {r6("quantile_cont(change, 0.5)")} AS median, {r6("quantile_cont(change, 0.9)")} AS q90,
           CASE WHEN count(change) > 0 THEN 'ok' ELSE 'unavailable' END AS status
    FROM pairs GROUP BY series_id""",
)
def adjacent_delta(t):
    return S.change_summary(S.adjacent_delta(t.steps, KEY, "position", "source_index", "value"), KEY)


@query(
    "f2_direction_coordination",
    f"""WITH {STEPS}{WRAPPED}
    SELECT series_id, count(*) AS requested_pairs, count(da * db) AS observed_pairs,
           count(*) FILTER (da * db > 0) AS same_pairs, count(*) FILTER (da * db < 0) AS opposite_pairs,
           count(*) FILTER (da * db = 0) AS tie_pairs,
           {r6("count(*) FILTER (da * db > 0) / nullif(count(*) FILTER (da * db <> 0), 0)")} AS same_fraction,
           CASE WHEN count(*) FILTER (da * db <> 0) > 0 THEN 'ok' ELSE 'unavailable' END AS status
    FROM pairs GROUP BY series_id""",
)
def direction_coordination(t):
    pairs = S.paired_changes(t.steps, KEY, "position", "source_index", "value", "other", wrap="any")
    return S.direction_summary(pairs, KEY, "relationship", "tie")


@query(
    "f3_opposing_direction",
    f"""WITH {STEPS}{WRAPPED}
    SELECT series_id, count(*) AS requested_pairs, count(da) AS observed_pairs,
           count(*) FILTER (da <> 0 AND db <> 0 AND da * db > 0) AS same_pairs,
           count(*) FILTER (da <> 0 AND db <> 0 AND NOT da * db > 0) AS opposite_pairs,
           count(*) FILTER (da = 0 OR db = 0) AS flat_pairs,
           {r6("count(*) FILTER (da * db > 0) / nullif(count(*) FILTER (da <> 0 AND db <> 0), 0)")} AS same_fraction,
           CASE WHEN count(*) FILTER (da <> 0 AND db <> 0) > 0 THEN 'ok' ELSE 'unavailable' END AS status,
           {r6("max(least(abs(da), abs(db)))")} AS strongest_joint, {r6("max(abs(da - db))")} AS strongest_divergence,
           {r6("max(greatest(abs(da), abs(db)))")} AS strongest_movement
    FROM pairs GROUP BY series_id""",
)
def opposing_direction(t):
    pairs = S.paired_changes(t.steps, KEY, "position", "source_index", "value", "other", wrap="any")
    extremes = pairs.groupBy(*KEY).agg(
        F.max("joint_strength").alias("strongest_joint"),
        F.max("divergence").alias("strongest_divergence"),
        F.max("movement").alias("strongest_movement"),
    )
    return S.direction_summary(pairs, KEY, "direction", "flat").join(extremes, KEY)


@query(
    "f5_runs",
    f"""WITH {RUNS}
    SELECT *, left_boundary <> 'state_change' OR right_boundary <> 'state_change' AS censored FROM runs""",
)
def runs(t):
    return S.runs(t.states, KEY, "position", "state", "barrier")


@query(
    "f7_state_summary",
    f"""WITH {RUNS}
    SELECT series_id, CAST(sum(length) AS BIGINT) AS observed,
           {r6("sum(length) FILTER (state) / sum(length)")} AS occupancy,
           count(*) FILTER (left_boundary = 'state_change') AS transitions,
           CAST(sum(length - 1) + count(*) FILTER (left_boundary = 'state_change') AS BIGINT) AS observed_pairs,
           coalesce(max(length) FILTER (state), 0) AS longest_true,
           coalesce(max(length) FILTER (NOT state), 0) AS longest_false
    FROM runs GROUP BY series_id""",
)
def state_summary(t):
    return S.state_summary(S.runs(t.states, KEY, "position", "state", "barrier"), KEY)


RANKS = """,
both_rows AS (SELECT * FROM steps WHERE value IS NOT NULL AND other IS NOT NULL),
ranked AS (
  SELECT series_id, position, value, other,
         rank() OVER (PARTITION BY series_id ORDER BY value) - 1
           + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2 AS ra,
         rank() OVER (PARTITION BY series_id ORDER BY other) - 1
           + (count(*) OVER (PARTITION BY series_id, other) - 1) / 2 AS rb,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM both_rows)"""


@query(
    "f9_average_ranks",
    f"""WITH {STEPS}, r AS (
      SELECT series_id, value, rank() OVER (PARTITION BY series_id ORDER BY value) - 1 AS below,
             count(*) OVER (PARTITION BY series_id, value) AS cnt, count(*) OVER (PARTITION BY series_id) AS total
      FROM steps WHERE value IS NOT NULL)
    SELECT DISTINCT series_id, {r6("value")} AS value, cnt, {r6("below + (cnt - 1) / 2")} AS rank, total FROM r""",
)
def average_ranks(t):
    return S.average_ranks(t.steps, KEY, "value")


@query(
    "f10_spearman",
    f"""WITH {STEPS}{RANKS}
    SELECT series_id, CAST(count(*) AS BIGINT) AS paired,
           CASE WHEN count(*) >= 3 AND max(ra) > min(ra) AND max(rb) > min(rb)
                THEN {r6("corr(ra, rb)")} END AS rho
    FROM ranked GROUP BY series_id""",
)
def spearman(t):
    return S.spearman(t.steps, KEY, "value", "other")


@query(
    "f11_rank_disagreement",
    f"""WITH {STEPS}{RANKS}, scored AS (
      SELECT *, abs(ra - rb) / greatest(1.0, n - 1.0) AS d,
             row_number() OVER (PARTITION BY series_id ORDER BY abs(ra - rb) DESC, position) AS k
      FROM ranked WHERE n >= 2)
    SELECT series_id, n AS aligned, position, {r6("value")} AS value, {r6("other")} AS other,
           {r6("d")} AS rank_disagreement
    FROM scored WHERE k = 1""",
)
def rank_disagreement(t):
    return S.rank_disagreement(t.steps, KEY, "position", "value", "other")


@query(
    "f12_field_orders",
    f"""WITH rows AS (SELECT event_type AS field_id, event_id AS ident, value FROM events)
    SELECT field_id, ident, {r6("value")} AS value, count(*) OVER (PARTITION BY field_id) AS sample_size,
           row_number() OVER (PARTITION BY field_id ORDER BY value DESC, ident) AS rank_descending,
           count(*) OVER (PARTITION BY field_id)
             - row_number() OVER (PARTITION BY field_id ORDER BY value DESC, ident) + 1 AS rank_ascending
    FROM rows""",
)
def field_orders(t):
    rows = t.events.select(F.col("event_type").alias("field_id"), F.col("event_id").alias("ident"), "value")
    return S.field_orders(rows, ["field_id"], "ident", "value")


FULL = f""",
grid AS (SELECT s.series_id, CAST(g AS INTEGER) AS slot FROM (SELECT DISTINCT series_id FROM cycles) s,
                range({PERIOD}) AS r(g)),
full_cycle AS (
  SELECT g.series_id, g.slot, c.score, c.n, c.peak, c.slot IS NOT NULL AS seen
  FROM grid g LEFT JOIN cycles c USING (series_id, slot))"""


@query(
    "f13_circular_moving_average",
    f"""WITH {CYCLES}, spread AS (
      SELECT series_id, (slot + o) % {PERIOD} AS slot, score
      FROM cycles, (SELECT unnest([{PERIOD - 2}, {PERIOD - 1}, 0, 1, 2]) AS o))
    SELECT series_id, CAST(slot AS INTEGER) AS slot, {r6("round(avg(score), 9) + 1e-9")} AS smooth_score
    FROM spread GROUP BY series_id, slot""",
)
def circular_moving_average(t):
    smooth = C.moving_average(t.cycles, KEY, "slot", "score", 2, PERIOD)
    return smooth.withColumn("smooth_score", F.round("smooth_score", 9) + 1e-9)  # halves must not hang on the last bit


@query(
    "f14_circular_runs",
    f"""WITH {CYCLES}{FULL}, doubled AS (
      SELECT series_id, slot + {PERIOD} * d AS p, d, NOT seen AS miss, seen
      FROM full_cycle, (SELECT unnest([0, 1]) AS d)),
    isl AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY p) AS g
            FROM doubled),
    cir AS (SELECT series_id, max(c) AS c FROM (
              SELECT series_id, g, count(*) FILTER (miss) AS c FROM isl GROUP BY 1, 2) GROUP BY 1),
    lin AS (SELECT series_id, max(c) AS c FROM (
              SELECT series_id, g, count(*) FILTER (miss) AS c FROM isl WHERE d = 0 GROUP BY 1, 2) GROUP BY 1),
    off AS (SELECT *, sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY p) AS h
            FROM doubled WHERE d = 0),
    lrun AS (SELECT series_id, max(c) AS c FROM (
              SELECT series_id, h, count(*) FILTER (seen) AS c FROM off GROUP BY 1, 2) GROUP BY 1),
    comp AS (SELECT f.series_id, count(*) FILTER (f.seen) AS flagged,
                    count(*) FILTER (f.seen AND NOT b.seen) AS starts
             FROM full_cycle f JOIN full_cycle b
               ON f.series_id = b.series_id AND b.slot = (f.slot + {PERIOD - 1}) % {PERIOD} GROUP BY 1)
    SELECT series_id, least(cir.c, {PERIOD}) AS longest_circular_gap, lin.c AS longest_gap, lrun.c AS longest_run,
           flagged, CASE WHEN flagged = {PERIOD} THEN 1 ELSE starts END AS components,
           {r6(f"least(cir.c, {PERIOD}) / {PERIOD}")} AS longest_circular_gap_fraction
    FROM cir JOIN lin USING (series_id) JOIN lrun USING (series_id) JOIN comp USING (series_id)""",
)
def circular_runs(t):
    full = C.full_cycle(t.cycles.select("series_id", "slot"), KEY, "slot", PERIOD)
    return C.circular_runs(full, KEY, "slot", "seen", PERIOD)


@query(
    "f17_two_lobes",
    f"""WITH {CYCLES}{FULL}, base AS (
      SELECT series_id, slot, coalesce(score, 0.0) AS score, peak AS tie FROM full_cycle),
    spread AS (SELECT series_id, (slot + o) % {PERIOD} AS slot, score
               FROM base, (SELECT unnest([{PERIOD - 2}, {PERIOD - 1}, 0, 1, 2]) AS o)),
    smooth AS (SELECT series_id, slot, avg(score) AS s FROM spread GROUP BY 1, 2),
    p AS (SELECT series_id, arg_max(slot, (s, -slot)) AS a, max(s) AS sa FROM smooth GROUP BY 1),
    q AS (SELECT series_id, arg_max(slot, (s, -slot)) AS b, max(s) AS sb FROM smooth JOIN p USING (series_id)
          WHERE least((slot - a + {PERIOD}) % {PERIOD}, (a - slot + {PERIOD}) % {PERIOD}) >= 6 GROUP BY 1),
    sides AS (SELECT series_id, 'a' AS side, a AS c FROM p UNION ALL SELECT series_id, 'b', b FROM q),
    near AS (SELECT series_id, side, tie FROM base JOIN sides USING (series_id)
             WHERE least((slot - c + {PERIOD}) % {PERIOD}, (c - slot + {PERIOD}) % {PERIOD}) <= 2),
    med AS (SELECT series_id, side, median(tie) AS m FROM near GROUP BY 1, 2),
    mad AS (SELECT series_id, side, any_value(m) AS m, median(abs(tie - m)) AS d
            FROM near JOIN med USING (series_id, side) GROUP BY 1, 2),
    w AS (SELECT p.series_id, a, b, sa, sb, sa - sb AS gap, x.m - y.m AS diff,
                 greatest(coalesce(x.d, 0), coalesce(y.d, 0), 0.005) AS noise
          FROM p JOIN q USING (series_id)
          LEFT JOIN mad x ON x.series_id = p.series_id AND x.side = 'a'
          LEFT JOIN mad y ON y.series_id = p.series_id AND y.side = 'b'),
    c AS (SELECT *, CASE WHEN gap <= 5.0 THEN abs(diff) / noise END AS conf FROM w)
    SELECT series_id, CAST(a AS INTEGER) AS "primary", CAST(b AS INTEGER) AS secondary,
           {r6("sa")} AS primary_score, {r6("sb")} AS secondary_score, {r6("gap")} AS gap, {r6("conf")} AS confidence,
           CASE WHEN gap > 5.0 THEN 'not_needed' WHEN conf >= 1.5 THEN 'resolved' ELSE 'ambiguous' END AS status,
           CAST(CASE WHEN conf >= 1.5 AND diff > 0 THEN a WHEN conf >= 1.5 THEN b END AS INTEGER) AS preferred
    FROM c""",
)
def two_lobes(t):
    full = C.full_cycle(t.cycles, KEY, "slot", PERIOD).select(
        "series_id", "slot", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("peak").alias("tie")
    )
    # Event values run to about 500, so the score gap limit is stated in those units.
    return C.two_lobes(full, KEY, "slot", "score", "tie", PERIOD, gap_limit=5.0)


@query(
    "f18_cyclic_phase",
    f"""WITH eighths AS (
      SELECT user_id AS series_id, CAST(hour(ts) // 3 AS INTEGER) AS slot, count(*) AS n FROM events GROUP BY 1, 2),
    ref AS (SELECT series_id, arg_max(slot, (n, -slot)) AS r, count(*) AS have FROM eighths GROUP BY 1),
    f AS (SELECT series_id, slot, have, (slot - r + 8) % 8 AS fwd FROM eighths JOIN ref USING (series_id))
    SELECT series_id, slot, CAST(fwd AS INTEGER) AS offset_frames, {r6("fwd * -45.0")} AS phase_unwrapped,
           {r6("(360.0 - fwd * 45.0) % 360.0")} AS phase_0,
           {r6("((360.0 - fwd * 45.0) % 360.0 + 180.0) % 360.0 - 180.0")} AS phase_signed
    FROM f WHERE have = 8""",
)
def cyclic_phase(t):
    eighths = t.events.groupBy(
        F.col("user_id").alias("series_id"), F.floor(F.hour("ts") / 3).cast("int").alias("slot")
    ).agg(F.count(F.lit(1)).alias("n"))
    ref = eighths.groupBy(*KEY).agg(
        F.max(F.struct("n", (-F.col("slot")).alias("neg"))).alias("r"), F.count(F.lit(1)).alias("have")
    )
    # Only a complete cycle has a phase.
    whole = eighths.select("series_id", "slot").join(ref.where("have = 8"), KEY)
    return C.phase(whole, F.col("slot"), -F.col("r.neg"), 8, 360.0, -1).drop("r", "have")


@query(
    "f19_unwrap_quarter_turns",
    f"""WITH RECURSIVE {CYCLES},
    a AS (SELECT series_id, slot, x, row_number() OVER w - 1 AS i, first_value(x) OVER w AS x0, lag(x) OVER w AS prev, count(*) OVER (PARTITION BY series_id) AS n
          FROM (SELECT series_id, slot, peak * 7.0 - 360.0 * floor(peak * 7.0 / 360.0) AS x FROM cycles) WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
    c AS (SELECT *, list_transform([0, 1, 2, 3], lambda d: prev - x - 90.0 * d) AS v FROM a),
    j AS (SELECT * EXCLUDE (v), list_transform(v, lambda z: z + 180.0 - 360.0 * floor((z + 180.0) / 360.0) - 180.0) AS d FROM c),
    dp(series_id, i, best) AS (
      SELECT series_id, 0::BIGINT, [{{'c': 0::BIGINT, 'p': ''}}, {{'c': 1::BIGINT << 61, 'p': ''}}, {{'c': 1::BIGINT << 61, 'p': ''}}, {{'c': 1::BIGINT << 61, 'p': ''}}] FROM j WHERE i = 0
      UNION ALL
      SELECT j.series_id, j.i, [{", ".join("list_min([" + ", ".join(
          f"{{'c': best[{p + 1}].c + CAST(floor(d[{(s - p) % 4 + 1}] * d[{(s - p) % 4 + 1}] * 1e6 + 0.5) AS BIGINT), 'p': '{p}' || best[{p + 1}].p}}" for p in range(4)
      ) + "])" for s in range(4))}]
      FROM dp JOIN j ON j.series_id = dp.series_id AND j.i = dp.i + 1),
    f AS (SELECT series_id, list_min([{", ".join(f"{{'c': best[{r + 1}].c + CASE WHEN n > 1 THEN CAST(floor(z{r} * z{r} * 1e6 + 0.5) AS BIGINT) ELSE 0 END, 'r': {r}, 'p': '{r}' || best[{r + 1}].p}}" for r in range(4))}]) AS b
          FROM (SELECT dp.series_id, best, n, {", ".join(f"x - x0 + 90.0 * {r} + 180.0 - 360.0 * floor((x - x0 + 90.0 * {r} + 180.0) / 360.0) - 180.0 AS z{r}" for r in range(4))}
                FROM dp JOIN j USING (series_id, i) WHERE i = n - 1))
    SELECT j.series_id, j.slot, CAST(reverse(b.p)[CAST(j.i AS INTEGER) + 1] AS INTEGER) AS quarter_turn, {r6("b.c / 1e6")} AS objective FROM j JOIN f USING (series_id)""",
)
def unwrap_quarter_turns(t):
    angles = t.cycles.select("series_id", "slot", (F.col("peak") * 7.0 - 360.0 * F.floor(F.col("peak") * 7.0 / 360.0)).alias("angle"))
    return C.quarter_turns(angles, KEY, "slot", "angle")


@query(
    "f20_lexicographic_rank",
    f"""WITH {CYCLES}, k AS (
      SELECT *, CASE WHEN n <= 1 THEN 'rejected' WHEN n <= 3 THEN 'review' ELSE 'ok' END AS status,
             CASE WHEN slot < 8 THEN 'opposite' WHEN slot < 16 THEN 'outside' ELSE 'main' END AS role
      FROM cycles)
    SELECT series_id, slot, status, role, row_number() OVER (PARTITION BY series_id ORDER BY
             CASE WHEN status = 'rejected' THEN 1 ELSE 0 END,
             CASE role WHEN 'main' THEN 0 WHEN 'opposite' THEN 2 ELSE 1 END,
             CASE status WHEN 'ok' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, round(score, 6) DESC, slot) AS rank
    FROM k""",
)
def lexicographic_rank(t):
    from gyre.operators.selection import lexicographic_rank as rank

    rows = t.cycles.select(
        "series_id",
        "slot",
        F.round("score", 6).alias("score"),
        F.when(F.col("n") <= 1, "rejected").when(F.col("n") <= 3, "review").otherwise("ok").alias("status"),
        F.when(F.col("slot") < 8, "opposite").when(F.col("slot") < 16, "outside").otherwise("main").alias("role"),
    )
    return rank(rows, KEY, "role", {"main": 0, "outside": 1, "opposite": 2}, "status", "score", "slot").drop("score")


@query(
    "f21_tiered_choice",
    f"""WITH {CYCLES}, k AS (
      SELECT *, CASE WHEN n >= 6 THEN 0 WHEN n >= 4 THEN 1 ELSE 2 END AS tier, round(abs(score - 50.0), 6) AS err
      FROM cycles)
    SELECT series_id, tier, slot, {r6("err")} AS err, {r6("peak")} AS peak FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY tier, err, peak DESC, slot) AS k FROM k)
    WHERE k = 1""",
)
def tiered_choice(t):
    from gyre.operators.selection import tiered_choice as choose

    rows = t.cycles.select(
        "series_id",
        F.when(F.col("n") >= 6, 0).when(F.col("n") >= 4, 1).otherwise(2).alias("tier"),
        F.round(F.abs(F.col("score") - 50.0), 6).alias("err"),
        "peak",
        "slot",
    )
    return choose(rows, KEY, "tier", "err", "peak", "slot")


@query(
    "f30_phase_step_errors",
    f"""WITH {CYCLES}, o AS (
      SELECT series_id, slot, peak, coalesce(lead(slot) OVER w, min(slot) OVER (PARTITION BY series_id)) AS ns,
             coalesce(lead(peak) OVER w, first(peak) OVER (PARTITION BY series_id ORDER BY slot)) AS np
      FROM cycles WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
    s AS (SELECT series_id, slot, ns AS next_slot, (((np - peak) % 360.0 + 360.0) % 360.0) AS observed,
                 ((ns - slot + {PERIOD}) % {PERIOD}) * 15.0 AS expected FROM o)
    SELECT series_id, slot, next_slot, {r6("expected")} AS expected_step, {r6("observed")} AS observed_step,
           {r6("least(abs(observed - expected), 360.0 - abs(observed - expected))")} AS step_error
    FROM s""",
)
def phase_step_errors(t):
    return C.phase_step_errors(t.cycles, KEY, "slot", "peak", PERIOD, 360.0)
