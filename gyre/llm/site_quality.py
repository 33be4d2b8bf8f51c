"""Operator 3: quality by a document classifier and empirical-Bayes priors of host and path.

Evidence: a naive Bayes log-ratio over binned text features (punctuation, digits, capitals, size, word length,
repeated lines and words), fitted by grouped counts on all labelled rows and tempered by `temper`, as the
features overlap. Priors: every document gives its host and path its label, or its posterior under the
global rate; a host's mean is shrunk towards the global mean and a path's towards its host's, with
strengths from the spread between groups (method of moments). A document's own vote is taken out of
the prior it gets. Quality is the posterior of evidence and path prior; sparse sites fall back to the global
rate by themselves.

All of it is built-in functions and grouped sums with partial aggregation; a host with a third of all rows is
pre-aggregated, and documents meet only their path's one row. Null or empty texts have
features of their own bins; null hosts and paths are groups of their own; unlabelled tables give every
document the prior 0.5; rows labelled both ways count once each; repeated rows each count and get
their row; a null id is never labelled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.exchange import written

TEMPER = 0.5
FEATURES = ("punctuation", "digits", "capitals", "size", "length", "lines", "words")
BINS = 21
BLANK = "[ \\t\\n\\r]+"


def _bins(text: Column) -> dict[str, Column]:
    """Bin numbers (0 to BINS - 1) of a non-null text."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.least(F.floor(F.regexp_count(text, F.lit(pattern)) * 20 / size), F.lit(BINS - 1))
    lines, words = F.split(text, "\n", -1), F.split(text, " ", -1)
    repeated = lambda parts: F.floor((1 - F.size(F.array_distinct(parts)) / F.size(parts)) * 10)
    n_words = F.regexp_count(text, F.lit("[^ \\t\\n\\r]+"))
    return {
        "punctuation": share("[^\\p{L}\\p{N} \\t\\n\\r]"),
        "digits": share("\\p{N}"),
        "capitals": share("\\p{Lu}"),
        "size": F.least(F.floor(F.log2((n_words + 1).cast("double"))), F.lit(BINS - 1)),
        "length": F.least(F.floor(F.length(text) / (n_words + 1)), F.lit(BINS - 1)),
        "lines": repeated(lines),
        "words": repeated(words),
    }


def _logit(p: Column) -> Column:
    return F.ln(p) - F.ln(1 - p)


def _strength(between: float, mean: float) -> float:
    """Prior rows a group is worth: large where groups hardly differ."""
    return 1000.0 if between <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / between - 1))


def _spread(groups: DataFrame, centre: Column) -> float:
    """Between-group variance of group means around `centre`, noise of small groups taken off."""
    mean = F.col("s") / F.col("n")
    noise = centre * (1 - centre) / F.col("n")
    r = groups.where("n > 1").agg(F.avg((mean - centre) * (mean - centre) - noise).alias("v")).first()
    return r["v"] or 0.0


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", temper: float = TEMPER) -> DataFrame:
    """doc_id, host, path, evidence, host_prior, path_prior, quality, keep per row of `docs`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bins = _bins(text)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-")).alias("host"),
        F.coalesce(F.concat(F.lit("="), path.cast("string")), F.lit("-")).alias("path"),
        *[bins[f].cast("int").alias(f"bin_{f}") for f in FEATURES],
    )
    rows = written(rows)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    rows = rows.join(marks, "doc_id", "left")
    counts = rows.where("label is not null").select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])).alias("x"))
    seen = {(r["f"], r["b"]): (r["good"], r["bad"]) for r in counts.groupBy("x.f", "x.b").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()}
    good = sum(g for (f, _), (g, _) in seen.items() if f == FEATURES[0])
    bad = sum(b for (f, _), (_, b) in seen.items() if f == FEATURES[0])
    evidence = F.lit(0.0)
    for f in FEATURES:
        weigh = [math.log((seen.get((f, b), (0, 0))[0] + 1) / (good + BINS)) - math.log((seen.get((f, b), (0, 0))[1] + 1) / (bad + BINS)) for b in range(BINS)]
        evidence = evidence + F.element_at(F.array(*[F.lit(w) for w in weigh]), F.col(f"bin_{f}") + 1)
    rate = (good + 1) / (good + bad + 2)
    start = math.log(rate) - math.log(1 - rate)
    rows = rows.withColumn("evidence", evidence * temper).select("doc_id", "host", "path", "label", "evidence")
    rows = rows.withColumn("vote", F.coalesce("label", 1 / (1 + F.exp(-(F.col("evidence") + start)))))

    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    every = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((every["s"] or 0.0) / max(every["n"] or 0, 1), 1e-6), 1 - 1e-6) if every["n"] else 0.5
    k_host = _strength(_spread(hosts, F.lit(mean)), mean)
    nested = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    k_path = _strength(_spread(nested, (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)), mean)

    out = rows.join(nested, ["host", "path"])
    host_prior = (F.col("host_s") - F.col("vote") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    path_prior = (F.col("s") - F.col("vote") + k_path * F.col("host_prior")) / (F.col("n") - 1 + k_path)
    bounded = F.least(F.greatest(F.col("path_prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("host_prior", host_prior).withColumn("path_prior", path_prior)
    out = out.withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(bounded)))))
    return out.select("doc_id", "host", "path", "evidence", "host_prior", "path_prior", "quality", (F.col("quality") >= 0.5).alias("keep"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under their source (host) and the source's language section (path)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = site_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", F.coalesce("lang", F.lit(""))))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_prior", "path_prior", "quality")], "keep")


QUERIES = {"op3_site_quality": op3_site_quality}
_SHARE = "least(floor(len(regexp_extract_all(x, '{}')) * 20 / greatest(length(x), 1)), 20)"
_PARTS = "floor((1 - len(list_distinct(string_split(x, '{}'))) / len(string_split(x, '{}'))) * 10)"
_WORDS = "len(regexp_extract_all(x, '[^ \\t\\n\\r]+'))"
_FEATURE_SQL = {
    "punctuation": _SHARE.format("[^\\p{L}\\p{N} \\t\\n\\r]"),
    "digits": _SHARE.format("\\p{N}"),
    "capitals": _SHARE.format("\\p{Lu}"),
    "size": f"least(floor(log2({_WORDS} + 1)), 20)",
    "length": f"least(floor(length(x) / ({_WORDS} + 1)), 20)",
    "lines": _PARTS.format("' || chr(10) || '", "' || chr(10) || '"),
    "words": _PARTS.format(" ", " "),
}
ORACLES = {
    "op3_site_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS host,
                  '=' || concat_ws('/', source, coalesce(lang, '')) AS path, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, avg(quality) AS label FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT r, doc_id, host, path, label, unnest([{", ".join(f"struct_pack(f := '{f}', b := CAST({sql} AS INT))" for f, sql in _FEATURE_SQL.items())}]) AS e
      FROM d LEFT JOIN m USING (doc_id)),
n AS (SELECT sum(label) AS good, sum(1 - label) AS bad FROM d JOIN m USING (doc_id)),
w AS (SELECT f, b, ln((coalesce(good_b, 0) + 1) / (good + {BINS})) - ln((coalesce(bad_b, 0) + 1) / (bad + {BINS})) AS w
      FROM (SELECT e.f AS f, e.b AS b, sum(label) AS good_b, sum(1 - label) AS bad_b FROM b GROUP BY ALL), n),
v AS (SELECT r, doc_id, host, path, label, {TEMPER} * sum(w.w) AS evidence, ln((any_value(good) + 1) / (any_value(good + bad) + 2)) - ln(1 - (any_value(good) + 1) / (any_value(good + bad) + 2)) AS start
      FROM b JOIN w ON b.e.f = w.f AND b.e.b = w.b, n GROUP BY r, doc_id, host, path, label),
o AS (SELECT *, coalesce(label, 1 / (1 + exp(-(evidence + start)))) AS vote FROM v),
p AS (SELECT host, path, count(*) AS n, sum(vote) AS s FROM o GROUP BY host, path),
h AS (SELECT host, sum(n) AS host_n, sum(s) AS host_s FROM p GROUP BY host),
g AS (SELECT sum(host_s) / sum(host_n) AS mean FROM h),
kh AS (SELECT mean, CASE WHEN v <= 0 THEN 1000 ELSE least(1000, greatest(1, mean * (1 - mean) / v - 1)) END AS k_host
       FROM (SELECT any_value(mean) AS mean, coalesce(avg((host_s / host_n - mean) * (host_s / host_n - mean) - mean * (1 - mean) / host_n) FILTER (host_n > 1), 0) AS v FROM h, g)),
q AS (SELECT p.*, host_n, host_s, mean, k_host, (host_s + k_host * mean) / (host_n + k_host) AS c FROM p JOIN h USING (host), kh),
kp AS (SELECT CASE WHEN v <= 0 THEN 1000 ELSE least(1000, greatest(1, mean * (1 - mean) / v - 1)) END AS k_path
       FROM (SELECT any_value(mean) AS mean, coalesce(avg((s / n - c) * (s / n - c) - c * (1 - c) / n) FILTER (n > 1), 0) AS v FROM q)),
z AS (SELECT doc_id, evidence, vote, n, s, k_path, (host_s - vote + k_host * mean) / (host_n - 1 + k_host) AS host_prior
      FROM o JOIN q USING (host, path), kp),
y AS (SELECT *, (s - vote + k_path * host_prior) / (n - 1 + k_path) AS path_prior FROM z),
u AS (SELECT *, 1 / (1 + exp(-(evidence + ln(least(greatest(path_prior, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(path_prior, 1e-6), 1 - 1e-6))))) AS quality FROM y)
SELECT doc_id, round(evidence, 6) AS evidence, round(host_prior, 6) AS host_prior, round(path_prior, 6) AS path_prior,
       round(quality, 6) AS quality, quality >= 0.5 AS keep FROM u""",
}
