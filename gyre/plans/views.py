"""The given tables seen as sequence, cycle, pixel and profile tables.

Each view has a DataFrame form and a SQL form (a common table expression for the oracle).

steps    one series per user: dense position, cyclic source index, value null on 'error'
cycles   one series per user on a 24-slot cycle (hour of day); hours without events are gaps
pixels   one 8 x 8 frame per vector, 16 frames per series, one row per pixel
profiles one radial profile of 64 samples per vector, 8 sectors per profile set
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.functions.guards import positive
from gyre.operators.sequence import ordinal

PERIOD = 24
FRAMES = 16
SIDE = 8
SECTORS = 8


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def steps(self) -> DataFrame:
        rows = self.events.select(
            F.col("user_id").alias("series_id"),
            "event_id",
            "event_type",
            F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
            F.when(
                F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("double")
            ).alias("other"),
        )
        return ordinal(rows, ["series_id"], "event_id").withColumn(
            "source_index", F.pmod("position", F.lit(PERIOD))
        )

    @cached_property
    def states(self) -> DataFrame:
        """steps with the relative-dark state of `value` against the row's reference."""
        return self.steps.withColumn("state", F.col("value") < 0.65 * positive("other")).withColumn(
            "barrier", F.when(F.col("value").isNull(), "gap").otherwise("invalid_reference")
        )

    @cached_property
    def cycles(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("series_id"), F.hour("ts").alias("slot")).agg(
            F.avg("value").alias("score"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            "vec_id",
            "label",
            F.floor(F.col("vec_id") / FRAMES).alias("series_id"),
            F.pmod("vec_id", F.lit(FRAMES)).alias("position"),
            "embedding",
        )

    @cached_property
    def pixels(self) -> DataFrame:
        k = F.col("k")
        return (
            self.vectors.select("series_id", "position", "label", F.posexplode("embedding").alias("k", "v"))
            .withColumn("y", F.floor(k / SIDE).cast("int"))
            .withColumn("x", (k % SIDE).cast("int"))
            .withColumn("brightness", F.lit(0.5) + F.col("v").cast("double"))
            .withColumn("in_mask", (F.abs(F.col("x") - 3.5) + F.abs(F.col("y") - 3.5)) <= 6)
            .withColumn("valid", F.abs(F.col("v")) < 0.3)
            .withColumn("observed", F.col("label") != 3)
            .select("series_id", "position", "label", "y", "x", "brightness", "in_mask", "valid", "observed")
        )

    @cached_property
    def frames(self) -> DataFrame:
        return self.vectors.select("series_id", "position", "label", (F.col("label") != 3).alias("observed"))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.embeddings.select(
            F.floor(F.col("vec_id") / SECTORS).alias("series_id"),
            F.pmod("vec_id", F.lit(SECTORS)).alias("sector"),
            "vec_id",
            F.posexplode("embedding").alias("k", "v"),
        ).select(
            "series_id",
            "sector",
            "vec_id",
            "k",
            (F.col("k") / F.lit(63.0)).alias("u"),
            F.col("v").cast("double").alias("value"),
            (F.abs(F.col("v")) < 0.3).alias("supported"),
        )


STEPS = f"""
steps AS (
  SELECT user_id AS series_id, event_id, event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS other,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position,
         (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % {PERIOD} AS source_index
  FROM events)"""

STATES = STEPS + """,
states AS (
  SELECT *, CASE WHEN value IS NOT NULL AND other > 0 THEN value < 0.65 * other END AS state,
         CASE WHEN value IS NULL THEN 'gap' ELSE 'invalid_reference' END AS barrier
  FROM steps)"""

RUNS = STATES + """,
marked AS (
  SELECT *, lag(state) OVER w AS ps, lead(state) OVER w AS ns, lag(barrier) OVER w AS pb,
         lead(barrier) OVER w AS nb, lag(position) OVER w AS pp, lead(position) OVER w AS np
  FROM states WINDOW w AS (PARTITION BY series_id ORDER BY position)),
numbered AS (
  SELECT *, sum(CASE WHEN ps IS NULL OR ps <> state THEN 1 ELSE 0 END)
              OVER (PARTITION BY series_id ORDER BY position) AS run_no
  FROM marked WHERE state IS NOT NULL),
runs AS (
  SELECT series_id, any_value(state) AS state, min(position) AS "start", max(position) AS "end",
         count(*) AS length,
         arg_min(CASE WHEN pp IS NULL THEN 'window_endpoint' WHEN ps IS NULL THEN pb ELSE 'state_change' END,
                 position) AS left_boundary,
         arg_max(CASE WHEN np IS NULL THEN 'window_endpoint' WHEN ns IS NULL THEN nb ELSE 'state_change' END,
                 position) AS right_boundary
  FROM numbered GROUP BY series_id, run_no)"""

CYCLES = """
cycles AS (
  SELECT user_id AS series_id, CAST(hour(ts) AS INTEGER) AS slot, avg(value) AS score, count(*) AS n,
         max(value) AS peak
  FROM events GROUP BY 1, 2)"""

PIXELS = f"""
flat AS (
  SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings),
pixels AS (
  SELECT vec_id // {FRAMES} AS series_id, vec_id % {FRAMES} AS position, label,
         CAST(k // {SIDE} AS INTEGER) AS y, CAST(k % {SIDE} AS INTEGER) AS x,
         0.5 + CAST(v AS DOUBLE) AS brightness,
         abs(k % {SIDE} - 3.5) + abs(k // {SIDE} - 3.5) <= 6 AS in_mask, abs(v) < 0.3::FLOAT AS valid,
         label <> 3 AS observed
  FROM flat),
frames AS (
  SELECT vec_id // {FRAMES} AS series_id, vec_id % {FRAMES} AS position, label, label <> 3 AS observed
  FROM embeddings)"""

SUPPORT = PIXELS + """,
fixed AS (
  SELECT series_id, y, x FROM pixels WHERE observed AND valid AND in_mask GROUP BY 1, 2, 3
  HAVING count(*) = (SELECT count(*) FROM frames f WHERE f.observed AND f.series_id = pixels.series_id)),
fixed_px AS (SELECT p.* FROM pixels p SEMI JOIN fixed USING (series_id, y, x) WHERE observed),
whole AS (
  SELECT series_id, position, median(brightness) AS g, quantile_cont(brightness, 0.9) - quantile_cont(brightness, 0.1) AS gs
  FROM fixed_px GROUP BY 1, 2)"""

BAND = """CASE WHEN greatest(abs(x - 3.5), abs(y - 3.5)) / 4 < 0.2 THEN 'centre'
              WHEN greatest(abs(x - 3.5), abs(y - 3.5)) / 4 < 0.45 THEN 'inner'
              WHEN greatest(abs(x - 3.5), abs(y - 3.5)) / 4 < 0.7 THEN 'middle' ELSE 'outer' END"""

PROFILES = f"""
samples AS (
  SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings),
profiles AS (
  SELECT vec_id // {SECTORS} AS series_id, vec_id % {SECTORS} AS sector, vec_id, k, k / 63.0::DOUBLE AS u,
         CAST(v AS DOUBLE) AS value, abs(v) < 0.3::FLOAT AS supported
  FROM samples)"""
