import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.functions import ranking as R
from gyre.operators import sequence as S
from gyre.operators.evidence import nearest_to_quantile, weighted_quantile
from gyre.operators.traces import trace_summary
from gyre.sources.frames import natural_key, natural_order


def skewed(spark):
    """One key holds most rows; another is constant; another has two values."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(size=4000), 3)] + [("hot", 1.0)] * 900
    rows += [("flat", 2.0)] * 50 + [("two", 1.0), ("two", 4.0)] + [("small", float(v)) for v in rng.normal(size=31)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(7)


@pytest.mark.parametrize("pieces", [1, 2, 7, 40])
def test_quantiles_are_exact_for_any_number_of_pieces(spark, pieces):
    rows, df = skewed(spark)
    qs = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}
    got = {r.k: r for r in R.quantiles(df, ["k"], "v", qs, pieces=pieces).collect()}
    for key in ("hot", "flat", "two", "small"):
        data = np.array([v for k, v in rows if k == key])
        assert got[key].n == len(data)
        for name, q in qs.items():
            assert abs(got[key][name] - np.quantile(data, q)) < 1e-9


@pytest.mark.parametrize("pieces", [1, 2, 7, 40])
def test_ranks_are_tie_averaged(spark, pieces):
    rows, df = skewed(spark)
    ranked = R.ranked_values(R.value_table(df, ["k"], "v"), ["k"], "v", pieces)
    got = {(r.k, r.v): (r.below, r.cnt, r.total) for r in ranked.collect()}
    data = np.array([v for k, v in rows if k == "hot"])
    for v in np.unique(data):
        assert got[("hot", v)] == ((data < v).sum(), (data == v).sum(), len(data))


def test_pieces_share_the_hot_key(spark):
    _, df = skewed(spark)
    counts = R.value_table(df, ["k"], "v")
    sizes = [r["count"] for r in R._pieces(counts, ["k", "v"], 16).groupBy("__piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    plan = R.ranked_values(counts, ["k"], "v")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_ranks_without_keys_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {(r.k, r.v): (r.below, r.total) for r in R.ranked_values(R.value_table(df, ["k"], "v"), ["k"], "v", 5).collect()}
    assert got == {(None, 1.0): (0, 2), (None, 3.0): (1, 2), ("a", 1.0): (0, 1), ("b", 2.0): (0, 1)}
    whole = {r.v: (r.below, r.cnt, r.total) for r in R.ranked_values(R.value_table(df, [], "v"), [], "v", 3).collect()}
    assert whole == {1.0: (0, 2, 4), 2.0: (2, 1, 4), 3.0: (3, 1, 4)}
    assert R.ranked_values(R.value_table(df.where("false"), ["k"], "v"), ["k"], "v", 5).collect() == []


def test_natural_order_of_all_rows(spark):
    names = [f"{'AbC'[i % 3]}{i * 7 % 23}/{i % 5:03d}.png" for i in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").repartition(5)
    got = {r.i: r.place for r in natural_order(df.withColumn("key", natural_key(F.col("name"))), "key").collect()}
    key = [[(c.isdigit(), int(c) if c.isdigit() else 0, "" if c.isdigit() else c.lower()) for c in re.findall(r"\d+|\D+", n)] for n in names]
    assert got == {i: 1 + sum(other < key[i] for other in key) for i in range(200)}


def test_summary_matches_numpy(spark):
    rows, df = skewed(spark)
    got = {r.k: r for r in trace_summary(df, ["k"], "v").collect()}
    data = np.array([v for k, v in rows if k == "hot"])
    assert abs(got["hot"].mad_scale - 1.4826 * np.median(np.abs(data - np.median(data)))) < 1e-9
    assert got["two"].status == "unavailable" and got["two"].q50 is None


def test_nearest_row_is_the_earliest(spark):
    df = spark.createDataFrame([("a", p, v) for p, v in enumerate([3.0, 1.0, 2.0, 2.0, 5.0])], "s string, p int, v double")
    got = {r.rule: (r.p, r.v) for r in nearest_to_quantile(df, ["s"], "p", "v", {"mid": 0.5, "top": 1.0}).collect()}
    assert got == {"mid": (2, 2.0), "top": (4, 5.0)}


def test_weighted_quantile_matches_interpolation(spark):
    x, w = [1.0, 2.0, 5.0, 9.0], [1.0, 3.0, 2.0, 4.0]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(x, w)], "k string, x double, w double")
    got = {round(r.q, 2): r.value for r in weighted_quantile(df, ["k"], "x", "w", [0.05, 0.3, 0.5, 0.95]).collect()}
    for q, v in got.items():
        assert abs(v - np.interp(q * sum(w), np.cumsum(w), x)) < 1e-9


def test_spearman_and_disagreement(spark):
    df = spark.createDataFrame([("a", p, float(p), float((p * 7) % 5)) for p in range(10)] + [("c", p, 1.0, float(p)) for p in range(4)], "s string, p int, x double, y double")
    got = {r.s: r.rho for r in S.spearman(df, ["s"], "x", "y").collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() - 1) / 2 for a in v])
    x, y = np.arange(10.0), np.array([(p * 7) % 5 for p in range(10)], float)
    assert abs(got["a"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    assert got["c"] is None
    worst = S.rank_disagreement(df.where("s = 'a'"), ["s"], "p", "x", "y").first()
    gaps = np.abs(rank(x) - rank(y)) / 9
    assert worst.p == int(np.argmax(gaps)) and abs(worst.rank_disagreement - gaps.max()) < 1e-9


def test_result_does_not_depend_on_input_order(spark):
    _, df = skewed(spark)
    first = R.quantiles(df, ["k"], "v", {"m": 0.5}).orderBy("k").collect()
    again = R.quantiles(df.orderBy(F.rand(5)).repartition(3), ["k"], "v", {"m": 0.5}).orderBy("k").collect()
    assert first == again


def test_values_that_differ_when_computed_again_keep_their_ranks(spark):
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(200).repartition(4).select(F.lit("a").alias("s"), F.col("id"), draw("id").alias("x"), draw("id").alias("y"))
    assert [r.paired for r in S.spearman(df, ["s"], "x", "y").collect()] == [200]
    assert sorted(r.rank_descending for r in S.field_orders(df, ["s"], "id", "x").collect()) == list(range(1, 201))
