"""Operator 9: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key -ln(u) / q from a hash of its id and its quality weight q
(smallest first, the same order as largest u^(1/q)). A source's word budget is first spent on complete epochs
of all its documents; the rest goes to documents in key order until the budget is full, the
last of them giving its first words only, so a source's taken words equal its rounded target.

Targets: the sources, by code point with null last, weigh `weights` in turn and share `share` times
all words; a target stops at `cap` times its source's words and the excess goes to the others by
weight (water level over one row a source).

Prefix sums run in two steps: word counts by (source, key bucket), then inside one bucket; a
source with a third of all rows is spread over `buckets` tasks. Documents never join on the source alone.
Null text has size 0 and is never taken; a null id draws as the empty id; repeated rows are documents of their
own, with ties broken by id, size and text hash. An empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm.exchange import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def letter_share(text: Column) -> Column:
    """Quality weight of a text: from 0.2 (no letters) to 1 (letters only)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.lit(0.2) + F.lit(0.8) * letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.2))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`sizes` (source_key, source, source_size) with the target of each source; a row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last(), "source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(
        "fair",
        (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("capped", F.col("fair") * F.col("weight") >= F.col("cap"))
    water = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source_key", "fair"))).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(water["fair"] * F.col("weight"))).select(
        "source_key", "source_size", "target"
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    buckets: int = BUCKETS,
    seed: str = "",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs of every row of `docs`; `quality` is a
    positive column (about 1 at most) that scales the keys."""
    text = F.col(text_col).cast("string")
    unit = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.ln(unit) / (letter_share(text) if quality is None else quality)).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn(
        "bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int")
    )
    rows = written(rows)
    cells = rows.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("words"))
    sizes = cells.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    along = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).join(targets(sizes, weights, share, cap), "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    spent = rows.join(cells.select("source_key", "bucket", "before", "source_size", "target"), ["source_key", "bucket"])
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    return (
        spent.withColumn("start", start)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).cast("long").alias("taken"),
            "epochs",
        )
    )


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mix_sql(documents: str) -> str:
    """DuckDB SQL of the mix of a relation with doc_id, text and source."""
    return rf"""
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS BIGINT) AS epochs,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (
    SELECT d.*, t.source_size, t.target FROM (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
        / coalesce(0.2 + 0.8 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) / nullif(length(text), 0), 0.2) AS key
      FROM {documents}) d
    JOIN (
      SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (min(struct_pack(r := ratio, s := rank, f := fair)) FILTER (NOT capped) OVER ()).f END AS target
      FROM (
        SELECT *, fair * weight >= cap AS capped FROM (
          SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fair
          FROM (
            SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM (
              SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM (
                SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::DOUBLE::BIGINT AS source_size,
                       row_number() OVER (ORDER BY source NULLS LAST) AS rank
                FROM {documents} GROUP BY source)))))) t
    ON d.source IS NOT DISTINCT FROM t.source))"""


QUERIES = {"op9_source_mix": op9_source_mix}
ORACLES = {"op9_source_mix": mix_sql("documents")}
