"""Evidence selection, top-k and set operations (family G)."""

from pyspark.sql import functions as F

from gyre.operators import evidence as V
from gyre.operators import sequence as S
from gyre.operators import support as U
from gyre.operators import traces as D
from gyre.plans.registry import query, r6
from gyre.plans.sequence_queries import PAIRS, WRAPPED
from gyre.plans.trace_queries import BANDED, MORPH, banded, flash_cells
from gyre.plans.views import CYCLES, PERIOD, STEPS
from gyre.session import written

KEY = ["series_id"]
FRAME = ["series_id", "position"]


def nearest_sql(source, value, rules, position="position"):
    parts = " UNION ALL ".join(
        f"SELECT series_id, '{name}' AS rule, quantile_cont({value}, {q}) AS tg FROM {source} GROUP BY 1" for name, q in rules
    )
    return f"""tg AS ({parts}),
    nr AS (SELECT s.series_id, rule, {position}, {value}, row_number() OVER (PARTITION BY s.series_id, rule ORDER BY round(abs({value} - tg), 9), {position}) AS k
           FROM {source} s JOIN tg ON tg.series_id = s.series_id WHERE {value} IS NOT NULL)"""


@query(
    "g1_nearest_to_quantile",
    f"""WITH {STEPS}{WRAPPED.replace("pairs AS", "pairs2 AS")}, {nearest_sql("steps", "value", (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))},
    mv AS (SELECT series_id, position, da, row_number() OVER (PARTITION BY series_id ORDER BY da DESC, position) AS up,
                  row_number() OVER (PARTITION BY series_id ORDER BY da, position) AS dn FROM moves WHERE stepped AND da IS NOT NULL)
    SELECT series_id, rule, position, {r6("value")} AS "value" FROM nr WHERE k = 1
    UNION ALL SELECT series_id, 'largest_positive_move', position, {r6("da")} FROM mv WHERE up = 1 AND da > 0
    UNION ALL SELECT series_id, 'largest_negative_move', position, {r6("da")} FROM mv WHERE dn = 1 AND da < 0""",
)
def nearest_to_quantile(t):
    near = V.nearest_to_quantile(t.steps, KEY, "position", "value", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    moves = S.adjacent_delta(t.steps, KEY, "position", "source_index", "value", wrap="any")
    return near.unionByName(V.extreme_moves(moves, KEY, "position", "signed_delta").withColumnRenamed("signed_delta", "value"))


@query(
    "g2_extreme_rows",
    f"""WITH {STEPS}{PAIRS.replace("abs(value - pv) END AS change", "round(abs(value - pv), 6) END AS change")}, {nearest_sql("pairs", "change", (("median", 0.5), ("q90", 0.9)))},
    x AS (SELECT series_id, position, change, row_number() OVER (PARTITION BY series_id ORDER BY change DESC, position) AS hi,
                 row_number() OVER (PARTITION BY series_id ORDER BY change, position) AS lo FROM pairs WHERE change IS NOT NULL),
    nz AS (SELECT series_id, position, change, row_number() OVER (PARTITION BY series_id ORDER BY change, position) AS lo FROM pairs WHERE change > 0)
    SELECT series_id, rule, position, {r6("change")} AS change FROM nr WHERE k = 1
    UNION ALL SELECT series_id, 'largest', position, {r6("change")} FROM x WHERE hi = 1
    UNION ALL SELECT series_id, 'lowest', position, {r6("change")} FROM x WHERE lo = 1
    UNION ALL SELECT series_id, 'lowest_nonzero', position, {r6("change")} FROM nz WHERE lo = 1""",
)
def extreme_rows(t):
    # Two-decimal inputs: rounding removes the last-bit noise of the difference.
    pairs = S.adjacent_delta(t.steps, KEY, "position", "source_index", "value").withColumn("change", F.round("change", 6))
    return V.extreme_rows(pairs, KEY, "position", "change")


@query(
    "g3_pair_events",
    f"""WITH {STEPS}{WRAPPED}, d AS (SELECT series_id, position, da * db AS pr, round(least(abs(da), abs(db)), 6) AS st FROM pairs WHERE da * db <> 0),
    {nearest_sql("d", "st", (("typical_directional", 0.5),))},
    x AS (SELECT *, row_number() OVER (PARTITION BY series_id, pr > 0 ORDER BY st DESC, position) AS k FROM d)
    SELECT series_id, CASE WHEN pr > 0 THEN 'strongest_coordinated' ELSE 'strongest_divergent' END AS rule, position, {r6("st")} AS joint_strength
    FROM x WHERE k = 1
    UNION ALL SELECT series_id, rule, position, {r6("st")} FROM nr WHERE k = 1""",
)
def pair_events(t):
    pairs = S.paired_changes(t.steps, KEY, "position", "source_index", "value", "other", wrap="any")
    return V.pair_events(pairs.withColumn("joint_strength", F.round("joint_strength", 6)), KEY, "position")


@query(
    "g4_morphology_events",
    f"""WITH RECURSIVE {MORPH}, o AS (SELECT * FROM morph WHERE status = 'ok'),
    b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ls DESC, lf DESC, position) AS kb,
                 row_number() OVER (PARTITION BY series_id ORDER BY eff DESC, lf, position) AS kf FROM o)
    SELECT series_id, 'broadest' AS rule, position, {r6("ls")} AS "value" FROM b WHERE kb = 1
    UNION ALL SELECT series_id, 'most_fragmented', position, {r6("eff")} FROM b WHERE kf = 1""",
)
def morphology_events(t):
    return V.morphology_events(D.flash_morphology(*flash_cells(t), FRAME), KEY, "position")


@query(
    "g4_threshold_range",
    f"""WITH {BANDED}, sh AS (
      SELECT series_id, position, k, count(*) FILTER (brightness < k * g) / count(*) AS f FROM banded, (VALUES (0.65::DOUBLE), (0.75::DOUBLE), (0.85::DOUBLE)) AS v(k)
      GROUP BY 1, 2, 3),
    sp AS (SELECT series_id, position, max(f) - min(f) AS s FROM sh GROUP BY 1, 2)
    SELECT series_id, 'widest_threshold_range' AS rule, position, {r6("s")} AS span FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s DESC, position) AS k FROM sp) WHERE k = 1""",
)
def threshold_range(t):
    rows = D.with_whole(D.on_support(t.pixels, t.frames, "fixed"), D.whole_trace(t.pixels, t.frames))
    frames = U.sweep(rows, [0.65, 0.75, 0.85]).groupBy(*FRAME, "threshold_key").agg(
        (F.count_if(F.col("brightness") < F.col("threshold") * F.col("whole")) / F.count(F.lit(1))).alias("share")
    )
    return V.widest_range(frames, KEY, "position", "share")


@query(
    "g4_support_disagreement",
    f"""WITH {BANDED}, a AS (SELECT series_id, position, median(brightness) AS v FROM banded GROUP BY 1, 2),
    b AS (SELECT series_id, position, median(brightness) AS v FROM dyn GROUP BY 1, 2),
    d AS (SELECT a.series_id, a.position, round(abs(a.v - b.v), 12) AS d FROM a JOIN b ON b.series_id = a.series_id AND b.position = a.position),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC, position) AS hi,
                 row_number() OVER (PARTITION BY series_id ORDER BY d, position) AS lo FROM d)
    SELECT series_id, 'strongest' AS rule, position, {r6("d")} AS difference FROM k WHERE hi = 1
    UNION ALL SELECT series_id, 'control', position, {r6("d")} FROM k WHERE lo = 1""",
)
def support_disagreement(t):
    med = lambda m: D.on_support(t.pixels, t.frames, m).groupBy(*FRAME).agg(F.median("brightness").alias("v"))
    return V.mode_disagreement(med("fixed"), med("dynamic"), KEY, "position", "v")


@query(
    "g5_max_disagreement",
    f"""WITH {BANDED}, a AS (SELECT series_id, position, band, median(brightness) AS v FROM banded GROUP BY 1, 2, 3),
    b AS (SELECT series_id, position, band, median(brightness) AS v FROM dyn GROUP BY 1, 2, 3),
    d AS (SELECT a.series_id, a.band, a.position, a.v AS l, b.v AS r, round(abs(a.v - b.v), 12) AS d
          FROM a JOIN b ON b.series_id = a.series_id AND b.position = a.position AND b.band = a.band)
    SELECT series_id, band, position, {r6("l")} AS left_value, {r6("r")} AS right_value, {r6("d")} AS difference FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id, band ORDER BY d DESC, position) AS k FROM d) WHERE k = 1""",
)
def max_disagreement(t):
    px = banded(t)
    med = lambda m: D.on_support(px, t.frames, m, ["band"]).groupBy(*FRAME, "band").agg(F.median("brightness").alias("v")).withColumn("mode", F.lit(m))
    return V.max_disagreement(med("fixed").unionByName(med("dynamic")), ["series_id", "band"], "mode", "fixed", "dynamic", ["position"], "v")


# Candidates of four families from the hourly cycle of a series.
CAND = f"""
mvs AS (SELECT series_id, slot, abs(round(score, 6) - lag(round(score, 6)) OVER w) AS ch, lag(slot) OVER w AS pslot FROM cycles
        WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
adj AS (SELECT * FROM mvs WHERE pslot = slot - 1),
c1 AS (SELECT series_id, 'occupancy' AS family, 'score' AS native_id, 'highest' AS event_type, 'frame' AS kind, CAST(slot AS VARCHAR) AS idx,
              'score|peak' AS fields, score AS imp FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6) DESC, slot) AS k FROM cycles) WHERE k = 1),
c2 AS (SELECT series_id, 'occupancy', 'score', 'lowest_nonzero', 'frame', CAST(slot AS VARCHAR), 'score|peak', score FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6), slot) AS k FROM cycles WHERE score > 0) WHERE k = 1),
c3 AS (SELECT series_id, 'mobility', 'step', 'largest', 'pair', pslot || ',' || slot, 'step', ch FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ch DESC, slot) AS k FROM adj) WHERE k = 1),
c4 AS (SELECT series_id, 'activation', 'peak', 'q90', 'frame', CAST(slot AS VARCHAR), 'peak', peak FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY peak DESC, slot) AS k FROM cycles) WHERE k = 1),
cand AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4)"""


def candidates(t):
    from gyre.operators.selection import extreme

    cyc = t.cycles.withColumn("score", F.round("score", 6))
    one = F.array(F.col("slot").cast("int"))
    high = extreme(cyc, KEY, "highest", "score", "slot", True)
    low = extreme(cyc, KEY, "lowest_nonzero", "score", "slot", False, F.col("score") > 0)
    moves = S.adjacent_delta(cyc.withColumn("src", F.col("slot")), KEY, "slot", "src", "score")
    step = extreme(moves, KEY, "largest", "change", "slot", True)
    peak = extreme(cyc, KEY, "q90", "peak", "slot", True)
    pair = F.array((F.col("slot") - 1).cast("int"), F.col("slot").cast("int"))
    parts = [
        V.candidate(high, "occupancy", "score", "frame", one, ["score", "peak"], F.col("score")),
        V.candidate(low, "occupancy", "score", "frame", one, ["score", "peak"], F.col("score")),
        V.candidate(step, "mobility", "step", "pair", pair, ["step"], F.col("change")),
        V.candidate(peak, "activation", "peak", "frame", one, ["peak"], F.col("peak")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def native_steps(t):
    """The steps that all families read, kept as a table: every family would count the positions again."""
    steps = t.steps.select("series_id", "position", "source_index", "value", "other", (F.col("value") < 0.65 * F.col("other")).alias("state"))
    return written(steps)


def native_events(steps):
    """Native events of all eight families from the traces `value` and `other` of a user's events."""
    from gyre.operators.pairing import matched_area_pair
    from gyre.operators.selection import extreme

    steps = steps.withColumn("barrier", F.lit("gap"))
    index = (F.col("position") % PERIOD).alias("source_index")
    sides = [((F.col("position") - 1) % PERIOD).alias("left_source_index"), (F.col("position") % PERIOD).alias("right_source_index")]
    fields = lambda *names: F.array(*[F.lit(n) for n in names]).alias("field_ids")
    event = F.col("rule").alias("event_type")
    near = V.nearest_to_quantile(steps, KEY, "position", "value", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    moves = S.adjacent_delta(steps, KEY, "position", "source_index", "value", wrap="any").withColumn("signed_delta", F.round("signed_delta", 6))
    moves = V.extreme_moves(moves, KEY, "position", "signed_delta")
    activation = near.select("series_id", event, index, F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("double").alias("delta"), fields("core"))
    activation = activation.unionByName(moves.select("series_id", event, F.lit(None).cast("bigint").alias("source_index"), "position", F.col("signed_delta").alias("delta"), fields("core")))
    high = extreme(steps, KEY, "highest", "other", "position", True).unionByName(extreme(steps, KEY, "lowest_nonzero", "other", "position", False, F.col("other") > 0))
    occupancy = high.select("series_id", event, index, fields("wide"))
    change = lambda c: S.adjacent_delta(steps, KEY, "position", "source_index", c).withColumn("change", F.round("change", 6))
    other = change("other")
    switch = extreme(other, KEY, "highest", "change", "position", True).unionByName(extreme(other, KEY, "lowest_nonzero", "change", "position", False, F.col("change") > 0))
    switching = switch.select("series_id", event, *sides, F.col("change").alias("switch_fraction"), fields("wide"))
    mobility = V.extreme_rows(change("value"), KEY, "position", "change").select("series_id", event, *sides, F.col("change").alias("mobility"), fields("core"))
    runs = S.runs(steps, KEY, "position", "state", "barrier").where("state")
    longest = runs.groupBy(*KEY).agg(F.max(F.struct("length", (-F.col("start")).alias("s"), "end")).alias("r"))
    persistence = longest.select(
        "series_id", F.lit("dark_q90_run").alias("event_type"), (-F.col("r.s")).alias("start_position"), F.col("r.end").alias("end_position"),
        F.col("r.length").alias("run_length"), fields("dark"),
    )
    pairs = S.paired_changes(steps, KEY, "position", "source_index", "value", "other", wrap="any")
    pairs = pairs.withColumns({c: F.round(c, 6) for c in ("joint_strength", "divergence", "movement")})
    both = V.pair_events(pairs, KEY, "position").select("series_id", event, *sides, F.col("joint_strength").alias("joint_move_strength"), fields("core", "wide"))
    apart = extreme(pairs, KEY, "strongest_divergent", "divergence", "position", True, F.col("relationship") == "opposite").withColumnRenamed("divergence", "divergence_strength")
    along = extreme(pairs, KEY, "strongest_coordinated", "movement", "position", True, F.col("relationship") == "same").withColumnRenamed("movement", "movement_strength")
    opposing = apart.unionByName(along, allowMissingColumns=True).select("series_id", event, *sides, "divergence_strength", "movement_strength", fields("wide", "core"))
    whole = steps.where("value is not null and other is not null")
    broad = extreme(whole, KEY, "broadest", "value", "position", True).withColumnRenamed("value", "shape")
    split = extreme(whole, KEY, "most_fragmented", "other", "position", True).withColumnRenamed("other", "shape")
    matched = matched_area_pair(whole, KEY, "position", "value", "other", 0.5)
    none = F.lit(None).cast("bigint")
    morphology = broad.unionByName(split).select("series_id", event, index, none.alias("left_source_index"), none.alias("right_source_index"), "shape", fields("dark"))
    morphology = morphology.unionByName(
        matched.select(
            "series_id", F.lit("matched_active_area_pair").alias("event_type"), none.alias("source_index"), (F.col("first") % PERIOD).alias("left_source_index"),
            (F.col("second") % PERIOD).alias("right_source_index"), F.col("shape_gap").alias("shape"), fields("dark"),
        )
    )
    return {
        "activation": activation, "occupancy": occupancy, "switching": switching, "persistence": persistence,
        "mobility": mobility, "coordination": both, "opposing": opposing, "morphology": morphology,
    }


def native_candidates(t):
    steps = native_steps(t)
    return V.collect_candidates(native_events(steps), steps.select("series_id", "position", "source_index"))


FRAME_AT, PAIR_AT = f"CAST(position % {PERIOD} AS VARCHAR)", f"(position - 1) % {PERIOD} || ',' || position % {PERIOD}"
NATIVE = f"""{STEPS}{WRAPPED.replace("pairs AS", "pairs2 AS").replace("value - pv AS da", "round(value - pv, 6) AS da").replace("other - po AS db", "other - po AS db")},
    {nearest_sql("steps", "value", (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))},
    mv AS (SELECT series_id, position, da, row_number() OVER (PARTITION BY series_id ORDER BY da DESC, position) AS up,
                  row_number() OVER (PARTITION BY series_id ORDER BY da, position) AS dn FROM moves WHERE stepped AND da IS NOT NULL),
    ot AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY other DESC, position) AS hi, row_number() OVER (PARTITION BY series_id, other > 0 ORDER BY other, position) AS lo FROM steps WHERE other IS NOT NULL),
    ch AS (SELECT series_id, position, CASE WHEN source_index = psi + 1 THEN round(abs(value - pv), 6) END AS c, CASE WHEN source_index = psi + 1 THEN round(abs(other - po), 6) END AS o
           FROM hops WHERE pp IS NOT NULL),
    sw AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY o DESC, position) AS hi, row_number() OVER (PARTITION BY series_id, o > 0 ORDER BY o, position) AS lo FROM ch WHERE o IS NOT NULL),
    mo AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, position) AS hi, row_number() OVER (PARTITION BY series_id ORDER BY c, position) AS lo,
                  row_number() OVER (PARTITION BY series_id, c > 0 ORDER BY c, position) AS nz FROM ch WHERE c IS NOT NULL),
    mq AS (SELECT series_id, 'median' AS r, quantile_cont(c, 0.5) AS x FROM mo GROUP BY 1 UNION ALL SELECT series_id, 'q90', quantile_cont(c, 0.9) FROM mo GROUP BY 1),
    mn AS (SELECT mo.series_id, r, position, c, row_number() OVER (PARTITION BY mo.series_id, r ORDER BY round(abs(c - x), 9), position) AS k FROM mo JOIN mq ON mq.series_id = mo.series_id),
    ds AS (SELECT series_id, position, value < 0.65 * other AS state FROM steps),
    dg AS (SELECT *, sum(CASE WHEN state THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY position) AS g FROM (SELECT series_id, position, coalesce(state, false) AS state FROM ds)),
    dr AS (SELECT series_id, min(position) AS a, max(position) AS b, count(*) AS n FROM dg WHERE state GROUP BY series_id, g),
    dl AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, a) = 1),
    cp AS (SELECT series_id, position, da, db, round(least(abs(da), abs(db)), 6) AS st, round(abs(da - db), 6) AS dv, round(greatest(abs(da), abs(db)), 6) AS mm FROM pairs2 WHERE da * db <> 0),
    cs AS (SELECT *, row_number() OVER (PARTITION BY series_id, da * db > 0 ORDER BY st DESC, position) AS k, row_number() OVER (PARTITION BY series_id, da * db > 0 ORDER BY dv DESC, position) AS kd,
                  row_number() OVER (PARTITION BY series_id, da * db > 0 ORDER BY mm DESC, position) AS km FROM cp),
    ct AS (SELECT series_id, quantile_cont(st, 0.5) AS x FROM cp GROUP BY 1),
    cn AS (SELECT cp.series_id, position, st, row_number() OVER (PARTITION BY cp.series_id ORDER BY round(abs(st - x), 9), position) AS k FROM cp JOIN ct ON ct.series_id = cp.series_id),
    wh AS (SELECT * FROM steps WHERE value IS NOT NULL AND other IS NOT NULL),
    wx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, position) AS kb, row_number() OVER (PARTITION BY series_id ORDER BY other DESC, position) AS kf FROM wh),
    wp AS (SELECT a.series_id, a.position AS f, b.position AS s, round(abs(a.other - b.other), 12) AS g, row_number() OVER (PARTITION BY a.series_id ORDER BY round(abs(a.value - b.value), 12) <= 0.5 DESC,
                  round(-abs(a.other - b.other), 12), round(abs(a.value - b.value), 12), a.position, b.position) AS k FROM wh a JOIN wh b ON b.series_id = a.series_id AND a.position < b.position),
    nat AS (
      SELECT series_id, 'activation' AS family, rule AS event_type, 'frame' AS kind, {FRAME_AT} AS idx, 'core' AS fields, NULL::DOUBLE AS imp FROM nr WHERE k = 1
      UNION ALL SELECT series_id, 'activation', 'largest_positive_move', 'pair', {PAIR_AT}, 'core', da FROM mv WHERE up = 1 AND da > 0
      UNION ALL SELECT series_id, 'activation', 'largest_negative_move', 'pair', {PAIR_AT}, 'core', -da FROM mv WHERE dn = 1 AND da < 0
      UNION ALL SELECT series_id, 'occupancy', 'highest', 'frame', {FRAME_AT}, 'wide', NULL FROM ot WHERE hi = 1
      UNION ALL SELECT series_id, 'occupancy', 'lowest_nonzero', 'frame', {FRAME_AT}, 'wide', NULL FROM ot WHERE lo = 1 AND other > 0
      UNION ALL SELECT series_id, 'switching', 'highest', 'pair', {PAIR_AT}, 'wide', o FROM sw WHERE hi = 1
      UNION ALL SELECT series_id, 'switching', 'lowest_nonzero', 'pair', {PAIR_AT}, 'wide', o FROM sw WHERE lo = 1 AND o > 0
      UNION ALL SELECT series_id, 'mobility', 'largest', 'pair', {PAIR_AT}, 'core', c FROM mo WHERE hi = 1
      UNION ALL SELECT series_id, 'mobility', 'lowest', 'pair', {PAIR_AT}, 'core', c FROM mo WHERE lo = 1
      UNION ALL SELECT series_id, 'mobility', 'lowest_nonzero', 'pair', {PAIR_AT}, 'core', c FROM mo WHERE nz = 1 AND c > 0
      UNION ALL SELECT series_id, 'mobility', r, 'pair', {PAIR_AT}, 'core', c FROM mn WHERE k = 1
      UNION ALL SELECT series_id, 'persistence', 'dark_q90_run', 'run', array_to_string(list_transform(range(a, b + 1), lambda x: x % {PERIOD}), ','), 'dark', n FROM dl
      UNION ALL SELECT series_id, 'coordination', CASE WHEN da * db > 0 THEN 'strongest_coordinated' ELSE 'strongest_divergent' END, 'pair', {PAIR_AT}, 'core|wide', st FROM cs WHERE k = 1
      UNION ALL SELECT series_id, 'coordination', 'typical_directional', 'pair', {PAIR_AT}, 'core|wide', st FROM cn WHERE k = 1
      UNION ALL SELECT series_id, 'opposing', 'strongest_divergent', 'pair', {PAIR_AT}, 'wide|core', dv FROM cs WHERE kd = 1 AND da * db < 0
      UNION ALL SELECT series_id, 'opposing', 'strongest_coordinated', 'pair', {PAIR_AT}, 'wide|core', mm FROM cs WHERE km = 1 AND da * db > 0
      UNION ALL SELECT series_id, 'morphology', 'broadest', 'frame', {FRAME_AT}, 'dark', value FROM wx WHERE kb = 1
      UNION ALL SELECT series_id, 'morphology', 'most_fragmented', 'frame', {FRAME_AT}, 'dark', other FROM wx WHERE kf = 1
      UNION ALL SELECT series_id, 'morphology', 'matched_active_area_pair', 'pair', f % {PERIOD} || ',' || s % {PERIOD}, 'dark', g FROM wp WHERE k = 1)"""


@query(
    "g6_collect_candidates",
    f"""WITH {NATIVE} SELECT series_id, family, family AS native_id, event_type, kind, idx AS source_indices, fields AS field_ids, {r6("imp")} AS importance, 'ok' AS status FROM nat""",
)
def collect_candidates(t):
    return native_candidates(t).select(
        "series_id", "family", "native_id", "event_type", "kind", F.array_join("source_indices", ",").alias("source_indices"),
        F.array_join("field_ids", "|").alias("field_ids"), "importance", "status",
    )


def profile(t):
    """Three field cells per series; 'score' is missing for every fifth series."""
    size = t.cycles.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"))
    fields = size.withColumn("field_id", F.explode(F.array(F.lit("score"), F.lit("peak"), F.lit("step"))))
    rows = fields.where((F.col("field_id") != "score") | (F.col("series_id") % 5 != 0))
    weak = (F.col("field_id") == "peak") & (F.col("k") < 16)
    return rows.select(
        "series_id", "field_id",
        F.when(weak, "review").otherwise("ok").alias("status"),
        F.when(weak, F.array(F.lit("sparse_cycle"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


CONTRACT = f"""
siz AS (SELECT series_id, count(*) AS k FROM cycles GROUP BY 1),
kept AS (SELECT c.*, array_to_string(list_filter(string_split(fields, '|'), lambda f: f <> 'score' OR c.series_id % 5 <> 0), '|') AS held, k
         FROM cand c JOIN siz USING (series_id)),
ctr AS (SELECT *, CASE WHEN k < 16 AND list_contains(string_split(held, '|'), 'peak') THEN 'review' ELSE 'ok' END AS st FROM kept WHERE held <> '')"""


def contracted(t):
    return V.apply_contract(candidates(t), profile(t))


@query(
    "g7_apply_contract",
    f"""WITH {CYCLES}, {CAND}, {CONTRACT} SELECT series_id, family, native_id, event_type, kind, idx AS source_indices, held AS field_ids,
        {r6("imp")} AS importance, st AS status, CASE WHEN st = 'review' THEN 'sparse_cycle' ELSE '' END AS reasons FROM ctr""",
)
def apply_contract(t):
    return contracted(t).select(
        "series_id", "family", "native_id", "event_type", "kind", F.array_join("source_indices", ",").alias("source_indices"),
        F.array_join("field_ids", "|").alias("field_ids"), "importance", "status", F.array_join("reasons", "|").alias("reasons"),
    )


@query(
    "g8_merge_exact",
    f"""WITH {CYCLES}, {CAND}, {CONTRACT} SELECT series_id, kind, idx AS source_indices, CAST(count(*) AS INTEGER) AS claims,
        array_to_string(list(family || ':' || event_type ORDER BY family, native_id, event_type), '|') AS claim_names FROM ctr GROUP BY 1, 2, 3""",
)
def merge_exact(t):
    names = F.transform("claims", lambda c: F.concat(c["family"], F.lit(":"), c["event_type"]))
    return V.merge_exact(contracted(t)).select(
        "series_id", "kind", F.array_join("source_indices", ",").alias("source_indices"), F.size("claims").alias("claims"),
        F.array_join(names, "|").alias("claim_names"),
    )


def kept(t):
    """The contracted candidates of the hourly cycle, and the strongest pairs of either sign of two traces."""
    from gyre.operators.selection import extreme

    pairs = S.paired_changes(t.steps, KEY, "position", "source_index", "value", "other", wrap="any").withColumn("joint_strength", F.round("joint_strength", 6))
    strong = extreme(pairs, KEY, "strongest_coordinated", "joint_strength", "position", True, F.col("relationship") == "same").unionByName(
        extreme(pairs, KEY, "strongest_divergent", "joint_strength", "position", True, F.col("relationship") == "opposite")
    )
    events = strong.select(
        "series_id", F.col("rule").alias("event_type"), ((F.col("position") - 1) % PERIOD).alias("left_source_index"), (F.col("position") % PERIOD).alias("right_source_index"),
        F.col("joint_strength").alias("joint_move_strength"), F.array(F.lit("core"), F.lit("wide")).alias("field_ids"),
    )
    return contracted(t).unionByName(V.collect_candidates({"coordination": events}, t.steps))


@query("g9_near_groups")
def near_groups(t):
    groups = V.near_groups(V.merge_exact(kept(t)), PERIOD, 1)
    return groups.withColumn("source_indices", F.array_join("source_indices", ","))


def values(t):
    """Profile values of a series: how its two traces lean."""
    lean = t.steps.groupBy(*KEY).agg(F.avg(F.col("value") - F.col("other")).alias("v"))
    return lean.select("series_id", F.explode(F.array(F.lit("core"), F.lit("wide"))).alias("field_id"), F.round("v", 6).alias("value"))


def selected(t):
    return V.coverage_select(V.merge_exact(kept(t)), values=values(t))


@query("g10_coverage_select")
def coverage_select(t):
    return selected(t).withColumn("source_indices", F.array_join("source_indices", ","))


@query("g11_inventory_counts")
def inventory_counts(t):
    found = kept(t)
    items = V.merge_exact(found)
    return V.inventory(found, items, V.near_groups(items, PERIOD, 1), V.coverage_select(items, values=values(t)))


@query("g12_packet")
def packet(t):
    frames = t.events.select(F.col("user_id").alias("series_id")).distinct().withColumn("source_index", F.explode(F.sequence(F.lit(0), F.lit(PERIOD - 1))))
    return V.packet(selected(t), frames.withColumn("path", F.concat(F.lit("frame-"), F.col("source_index"))), "source_index", "path")


@query(
    "g13_filter_by_disposition",
    f"""WITH {BANDED}, tr AS (
      SELECT series_id, band, mode, count(*) AS frames FROM (
        SELECT DISTINCT series_id, position, band, 'fixed' AS mode FROM banded UNION ALL SELECT DISTINCT series_id, position, band, 'dynamic' FROM dyn)
      GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN band = 'outer' THEN 'REVISE' ELSE 'KEEP' END AS disposition,
           CASE WHEN band = 'outer' THEN 'upstream sensitivity candidate' ELSE 'primary local activation descriptor' END AS role
    FROM tr WHERE mode = 'fixed'""",
)
def filter_by_disposition(t):
    px = banded(t)
    rows = lambda m: D.on_support(px, t.frames, m, ["band"]).select(*FRAME, "band").distinct().withColumn("mode", F.lit(m))
    traces = rows("fixed").unionByName(rows("dynamic")).groupBy("series_id", "band", "mode").agg(F.count(F.lit(1)).alias("frames"))
    fixed = F.col("mode") == "fixed"
    rules = [
        (fixed & F.col("band").isin("centre", "inner", "middle"), "KEEP", "primary local activation descriptor"),
        (fixed & (F.col("band") == "outer"), "REVISE", "upstream sensitivity candidate"),
    ]
    return V.filter_by_disposition(traces, rules, ("REJECT", "not selected"))
