"""Streaming queries driven over the given tables until their input is drained (family T)."""

from pyspark.sql import functions as F

from gyre.plans.registry import query, r6
from gyre.plans.views import FRAMES, PIXELS, SIDE
from gyre.streaming import flows


@query(
    "t1_stream_activity_map",
    f"""WITH {PIXELS}, c AS (SELECT series_id, position, median(brightness) * 0.9 AS cut FROM pixels WHERE valid AND in_mask GROUP BY 1, 2)
    SELECT p.series_id, y, x, count(*) AS support_count, {r6("avg(brightness)")} AS mean, CASE WHEN count(*) >= 2 THEN {r6("stddev_pop(brightness)")} END AS std,
           {r6("count(*) FILTER (brightness < cut) / count(*)")} AS relative_dark_fraction
    FROM pixels p JOIN c ON c.series_id = p.series_id AND c.position = p.position WHERE valid AND in_mask GROUP BY 1, 2, 3""",
)
def stream_activity_map(t):
    rows = flows.table_stream(t.spark, t.sf_dir, "embeddings")
    cell = F.transform("embedding", lambda v, k: F.struct((k % SIDE).cast("int").alias("x"), F.floor(k / SIDE).cast("int").alias("y"), v.alias("v")))
    inside = F.filter(cell, lambda c: (F.abs(c["x"] - 3.5) + F.abs(c["y"] - 3.5) <= 6) & (F.abs(c["v"]) < F.lit(0.3).cast("float")))
    pixels = rows.select("vec_id", inside.alias("cells")).select(
        F.floor(F.col("vec_id") / FRAMES).alias("series_id"), F.pmod("vec_id", F.lit(FRAMES)).alias("position"),
        F.size("cells").alias("expected"), F.lit(None).cast("timestamp").alias("arrived"), F.explode("cells").alias("c"),
    ).select("series_id", "position", "c.y", "c.x", (F.lit(0.5) + F.col("c.v").cast("double")).alias("brightness"), "expected", "arrived")
    return flows.stream_activity_map(pixels, flows.fresh_folder(t.spark, "activity"), 0.9)[0]


@query(
    "t2_stream_runs",
    """WITH s AS (SELECT event_id % 64 AS series_id, event_id // 64 AS position, CASE WHEN event_type <> 'error' THEN value < 30 END AS state FROM events),
    m AS (SELECT *, lag(position) OVER w AS pp, lag(state) OVER w AS ps FROM s WHERE state IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY position)),
    n AS (SELECT *, sum(CASE WHEN pp = position - 1 AND ps = state THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY position) AS r FROM m),
    l AS (SELECT series_id, r, any_value(state) AS state, count(*) AS length FROM n GROUP BY 1, 2),
    f AS (SELECT series_id, count(*) FILTER (pp = position - 1 AND ps <> state) AS t FROM m GROUP BY 1)
    SELECT series_id, CAST(sum(length) AS BIGINT) AS observed, any_value(t) AS transitions, coalesce(max(length) FILTER (state), 0) AS longest_true,
           coalesce(max(length) FILTER (NOT state), 0) AS longest_false FROM l JOIN f USING (series_id) GROUP BY 1""",
)
def stream_runs(t):
    states = flows.table_stream(t.spark, t.sf_dir, "events").select(
        F.pmod("event_id", F.lit(64)).alias("series_id"), F.floor(F.col("event_id") / 64).alias("position"),
        F.when(F.col("event_type") != "error", F.col("value") < 30).alias("state"), F.lit(None).cast("timestamp").alias("arrived"),
    )
    return flows.stream_runs(states, flows.fresh_folder(t.spark, "runs"))[0]


@query(
    "t3_stream_upsert",
    """SELECT o_custkey AS id, arg_min(o_orderstatus, (o_orderdate, o_orderstatus)) AS status,
              arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) FILTER (o_orderpriority NOT LIKE '4%') AS priority,
              array_to_string(list_filter([CASE WHEN count(DISTINCT upper(o_orderpriority)) FILTER (o_orderpriority NOT LIKE '4%') > 1 THEN 'priority' END,
                                           CASE WHEN count(DISTINCT upper(o_orderstatus)) > 1 THEN 'status' END], lambda x: x IS NOT NULL), '|') AS conflicts
       FROM orders GROUP BY 1""",
)
def stream_upsert(t):
    def to_rows(batch):
        return batch.select(
            F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderstatus").alias("status"),
            F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("priority"),
        )

    stream = flows.table_stream(t.spark, t.sf_dir, "orders")
    merged, rejects = flows.stream_upsert(stream, to_rows, "id", "seen_at", ["status", "priority"], flows.fresh_folder(t.spark, "upsert"))
    return merged.join(rejects, "id", "left").fillna("", ["conflicts"])
