"""Joins and pairings of traces, frames and identifiers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import log_positive, pearson
from gyre.operators.sequence import direction_summary, paired_changes
from gyre.session import written

# Opposing sector pairs and the weights of the segment matching cost.
OPPOSING = (
    ("east_west", "side_E", "side_W"),
    ("north_south", "side_N", "side_S"),
    ("northeast_southwest", "corner_NE", "corner_SW"),
    ("northwest_southeast", "corner_NW", "corner_SE"),
)
RADIAL_WEIGHT, EUCLIDEAN_WEIGHT = 0.75, 0.25


def contrast_trace(a: DataFrame, b: DataFrame, keys: list[str], value: str, logs: bool = False) -> DataFrame:
    """Aligned difference of two traces, signed and absolute; a missing side is a gap."""
    take = log_positive(value) if logs else F.col(value)
    rows = a.select(*keys, take.alias("__a")).join(b.select(*keys, take.alias("__b")), keys)
    signed = F.col("__a") - F.col("__b")
    return rows.select(
        *keys,
        F.when(signed.isNull(), "gap").otherwise("ok").alias("status"),
        signed.alias("signed_log_contrast"),
        F.abs(signed).alias("separation"),
    )


def level_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson r over rows where both values are present; the reason when it is unavailable."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    n = F.count(x)
    constant = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    out = df.groupBy(*keys).agg(n.alias("paired"), pearson(x, y).alias("__r"), constant.alias("__c"))
    few = F.col("paired") < 3
    return out.select(
        *keys,
        "paired",
        F.when(~few, F.col("__r")).alias("pearson_r"),
        F.when(few | F.col("__c"), "unavailable").otherwise("ok").alias("status"),
        F.when(few, "insufficient_aligned_finite_frames").when(F.col("__c"), "constant_component_trace").alias("reason"),
    )


def paired_traces(traces: DataFrame, keys: list[str], order: str, name: str, value: str, pairs: list[tuple]) -> DataFrame:
    """Rows of each named pair of traces side by side: (pair_id, keys, order, a, b).

    Each trace row is labelled with the pairs it belongs to (a short literal list), so both
    sides meet in one aggregate; no join, no broadcast.
    """
    roles = []
    for pair_id, left, right in pairs:
        roles += [(left, pair_id, "a"), (right, pair_id, "b")]
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(s).alias("s")) for n, p, s in roles])
    mine = F.filter(options, lambda o: o["n"] == F.col(name))
    rows = traces.select(*keys, order, value, F.explode(mine).alias("z"))
    side = lambda s: F.max(F.when(F.col("z.s") == s, F.col(value)))
    seen = lambda s: F.max(F.col("z.s") == s)
    return (
        rows.groupBy(*keys, F.col("z.p").alias("pair_id"), order)
        .agg(side("a").alias("a"), side("b").alias("b"), seen("a").alias("__x"), seen("b").alias("__y"))
        .where("__x and __y")
        .drop("__x", "__y")
    )


def opposing_pairs(paired: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Correlation, median absolute difference and sign agreement of opposing traces.

    `paired` holds one bounded window per key (see the median over its frames).
    """
    corr = level_correlation(paired, keys, "a", "b").select(*keys, "paired", F.col("pearson_r").alias("correlation"), "status")
    diff = paired.groupBy(*keys).agg(
        F.median(F.abs(F.col("a") - F.col("b"))).alias("median_absolute_difference"),
        F.median(F.col("a") - F.col("b")).alias("median_signed_difference"),
    )
    moves = paired_changes(paired.withColumn("__src", F.col(order)), keys, order, "__src", "a", "b", dense=False)
    signs = direction_summary(moves, keys, "direction", "flat").select(
        *keys, "observed_pairs", "flat_pairs", F.col("same_fraction").alias("sign_agreement")
    )
    return corr.join(diff, keys).join(signs, keys, "left")


def proximity_pairs(obs: DataFrame, keys: list[str], frame: str, offset: str, tolerance: float) -> DataFrame:
    """Every pair of selected frames: smallest offset difference and whether it is close.

    Works on a bounded selection of frames; each frame is one row holding its short sorted
    offset list, so no observation pairs are shuffled.
    """
    frames = obs.groupBy(*keys, frame).agg(F.array_sort(F.collect_list(offset)).alias("offsets"))
    later = frames.select(*keys, F.col(frame).alias("frame_b"), F.col("offsets").alias("__b"))
    gap = F.array_min(
        F.transform("offsets", lambda a: F.array_min(F.transform("__b", lambda b: F.abs(a - b))))
    )
    return (
        frames.withColumnRenamed(frame, "frame_a")
        .join(later, keys)
        .where("frame_a < frame_b")
        .select(*keys, "frame_a", "frame_b", gap.alias("separation"))
        .withColumn("close", F.col("separation") <= tolerance)
    )


def best_pairs_first(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy one-to-one matching of `edges` (keys, i, j, cost, ...) in ascending order of (cost, i, j).

    Greedy takes an edge as soon as no cheaper edge at either of its ends is left. A round takes all
    these edges at once, each the best of its i and of its j, and drops what touches them, so edges stay
    distributed and no list of pairs exists; the cheapest edge left is always taken, so rounds end. What is left is written
    after every round, which cuts the lineage.
    """
    left, taken = written(edges), []
    rank = F.struct("cost", "i", "j")
    while not left.isEmpty():
        best = lambda end: F.min(rank).over(Window.partitionBy(*keys, end))
        won = left.withColumn("__i", best("i")).withColumn("__j", best("j")).where((F.col("__i") == F.col("__j")) & (F.col("__i") == rank))
        won = written(won.drop("__i", "__j"))
        taken.append(won)
        left = written(left.join(won.select(*keys, "i"), [*keys, "i"], "left_anti").join(won.select(*keys, "j"), [*keys, "j"], "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else left


def greedy_match(
    before: DataFrame, after: DataFrame, keys: list[str], family: str, fraction: str, x: str, y: str, ident: str,
    radial_gate: float, euclid_gate: float,
) -> DataFrame:
    """One-to-one matching of two frames' segments by ascending (cost, before, after).

    Candidates meet only within one key, family and radial bucket of the gate's width (own
    and neighbouring bucket), then pass both gates; `best_pairs_first` matches them. Returns all
    segments of both frames with `kind` matched / not_redetected / newly_detected.
    """
    bucket = F.floor(F.col(fraction) / radial_gate)
    cols = [family, fraction, x, y, ident]
    left = before.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], bucket.alias("__b"))
    right = after.select(
        *keys, *[F.col(c).alias(f"b_{c}") for c in cols],
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"),
    )
    radial = F.abs(F.col(f"a_{fraction}") - F.col(f"b_{fraction}"))
    euclid = F.sqrt(F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) + F.pow(F.col(f"a_{y}") - F.col(f"b_{y}"), 2))
    gated = (
        left.join(right.withColumnRenamed(f"b_{family}", f"a_{family}"), keys + ["__b", f"a_{family}"])
        .where((radial <= radial_gate) & (euclid <= euclid_gate))
        .withColumn("cost", F.round(RADIAL_WEIGHT * radial / radial_gate + EUCLIDEAN_WEIGHT * euclid / euclid_gate, 12))
        .withColumn("delta", F.col(f"b_{fraction}") - F.col(f"a_{fraction}"))
        .withColumn("shift", euclid)
    )
    edges = gated.select(*keys, F.col(f"a_{ident}").alias("i"), F.col(f"b_{ident}").alias("j"), "cost", "delta", "shift")
    matched = best_pairs_first(edges, keys)
    lost = before.select(*keys, F.col(ident).alias("i")).join(matched, keys + ["i"], "left_anti")
    new = after.select(*keys, F.col(ident).alias("j")).join(matched, keys + ["j"], "left_anti")
    return (
        matched.withColumn("kind", F.lit("matched"))
        .unionByName(lost.withColumn("kind", F.lit("not_redetected")), allowMissingColumns=True)
        .unionByName(new.withColumn("kind", F.lit("newly_detected")), allowMissingColumns=True)
    )


def distance_bins(distance: Column, bins: list[tuple[int, int]]) -> Column:
    """Closed integer bins labelled 003-008; outside every bin is null."""
    out = F.lit(None).cast("string")
    for low, high in reversed(bins):
        out = F.when(distance.between(low, high), f"{low:03d}-{high:03d}").otherwise(out)
    return out


def _band_best(rows: DataFrame, keys: list[str], order: str, axis: str, measure: str, width: float) -> DataFrame:
    """Per key the best pair of rows at most `width` apart on `axis`, and the number of such pairs.

    Best: largest difference of `measure`, then smallest of `axis`, then earliest rows. The partner of a row with the largest
    difference holds the smallest or largest measure of the band below the row, so running
    extremes do: over the rows before it in its own bucket of the band's width, and over those of the bucket below
    that are near enough, where the row's lower limit is sorted in as a query. Rows of equal `axis`
    are collapsed first. Work is that of sorting; no pairs are formed. Differences of `axis` count at 12 decimals, which decide what is
    near enough and which pairs tie; `axis` itself is not rounded, as equal differences would then come out 1e-12 apart.
    """
    last_step = round(width, 12)
    limit = last_step - (1e-12 if last_step > width else 0) + 5e-13  # differences below this are at most `width` at 12 decimals
    first = Window.partitionBy(*keys, axis).orderBy(order)
    two = rows.withColumn("__n", F.row_number().over(first)).where("__n <= 2").groupBy(*keys, axis).agg(F.min(order).alias("__o1"), F.max(order).alias("__o2"))
    level = rows.groupBy(*keys, axis).agg(
        F.count(F.lit(1)).alias("__c"),
        F.min(F.struct(F.col(measure).alias("m"), F.col(order).alias("o"))).alias("__lo"),
        F.min(F.struct((-F.col(measure)).alias("m"), F.col(order).alias("o"))).alias("__hi"),
    )

    def pair(gap: Column, apart: Column, a: Column, b: Column) -> Column:
        return F.struct(
            (-F.round(gap, 12) + 0.0).alias("n"), F.round(apart, 12).alias("apart"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second")
        )

    lo, hi = F.col("__lo"), F.col("__hi")
    inner = level.where("__c > 1").join(two, [*keys, axis]).select(
        *keys,
        F.when(-hi["m"] > lo["m"], pair(-hi["m"] - lo["m"], F.lit(0.0), lo["o"], hi["o"])).otherwise(pair(F.lit(0.0), F.lit(0.0), F.col("__o1"), F.col("__o2"))).alias("__p"),
        (F.col("__c") * (F.col("__c") - 1) / 2).cast("bigint").alias("__k"),
    )

    bucket = F.floor(F.col(axis) / limit)
    near = F.struct(lo["m"].alias("m"), (-F.col(axis)).alias("at"), lo["o"].alias("o"))
    far = F.struct(hi["m"].alias("m"), (-F.col(axis)).alias("at"), hi["o"].alias("o"))
    level = level.withColumn("__bucket", bucket)

    def met(found: DataFrame) -> DataFrame:
        """Pairs of each row with the extremes (low, high) found for it."""
        low, high = F.col("__low"), F.col("__high")
        options = F.array(
            pair(F.abs(-hi["m"] - low["m"]), F.col(axis) + low["at"], hi["o"], low["o"]), pair(F.abs(-high["m"] - lo["m"]), F.col(axis) + high["at"], lo["o"], high["o"])
        )
        return found.where("__low is not null").select(*keys, F.array_min(options).alias("__p"), (F.col("__c") * F.col("__k")).alias("__k"))

    before = Window.partitionBy(*keys, "__bucket").orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    own = level.withColumns({"__low": F.min(near).over(before), "__high": F.min(far).over(before), "__k": F.sum("__c").over(before)})
    asked = level.select(*keys, (F.col("__bucket") - 1).alias("__bucket"), (F.col(axis) - limit).alias("__at"), F.lit(1).alias("__ask"), F.struct(axis, "__c", "__lo", "__hi").alias("__row"))
    held = level.select(*keys, "__bucket", F.col(axis).alias("__at"), F.lit(0).alias("__ask"), F.struct(axis, "__c", "__lo", "__hi").alias("__row"))
    above = Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__at"), "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_row = F.col("__ask") == 0
    edge = lambda side: F.struct(F.col(f"__row.__{side}.m").alias("m"), (-F.col("__at")).alias("at"), F.col(f"__row.__{side}.o").alias("o"))
    below = held.unionByName(asked).withColumns(
        {
            "__low": F.min(F.when(is_row, edge("lo"))).over(above),
            "__high": F.min(F.when(is_row, edge("hi"))).over(above),
            "__k": F.sum(F.when(is_row, F.col("__row.__c"))).over(above),
        }
    )
    below = below.where("__ask = 1").select(*keys, "__row.*", "__low", "__high", "__k")
    every = inner.unionByName(met(own)).unionByName(met(below))
    return every.groupBy(*keys).agg(F.min("__p").alias("__c"), F.sum("__k").alias("__candidates"))


def _without(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys without any pair in the band: at most one row a bucket, so one task can sort a key."""
    return rows.join(found.select(*keys), keys, "left_anti")


def matched_pair(df: DataFrame, keys: list[str], order: str, level: str, measure: str, max_ratio: float = 1.02) -> DataFrame:
    """Pair of equally bright frames with the largest measure gap, else the closest pair.

    Ties: smaller brightness gap, earlier frame. Without any pair in tolerance the closest one is
    adjacent in brightness order.
    """
    rows = df.where((F.col(level) > 0) & F.col(measure).isNotNull()).select(*keys, order, F.col(measure).cast("double").alias("__m"), F.ln(level).alias("__b"))
    best = _band_best(rows, keys, order, "__b", "__m", math.log(max_ratio))
    w = Window.partitionBy(*keys).orderBy("__b", order)
    alone = _without(rows, best, keys).select(*keys, order, "__m", "__b", F.lag(F.struct(F.col(order).alias("o"), "__m", "__b")).over(w).alias("__p")).where("__p is not null")
    closest = alone.groupBy(*keys).agg(
        F.min(
            F.struct(
                F.round(F.col("__b") - F.col("__p.__b"), 12).alias("apart"),
                (-F.round(F.abs(F.col("__m") - F.col("__p.__m")), 12) + 0.0).alias("n"),
                F.least(order, "__p.o").alias("first"),
                F.greatest(order, "__p.o").alias("second"),
            )
        ).alias("__c")
    )
    out = lambda found, matched, n: found.select(
        *keys, "__c.first", "__c.second", (-F.col("__c.n")).alias("measure_gap"), F.col("__c.apart").alias("brightness_gap"), F.lit(matched).alias("matched"), n.alias("candidates")
    )
    return out(best, True, F.col("__candidates")).unionByName(out(closest, False, F.lit(0).cast("bigint")))


def matched_area_pair(df: DataFrame, keys: list[str], order: str, area: str, shape: str, tolerance: float = 0.02) -> DataFrame:
    """Pair of equal-area frames with the largest shape difference, else the widest pair.

    Without any pair in tolerance the largest shape difference joins a lowest and a highest shape; of
    these the nearest in area are neighbours among the rows that hold either.
    """
    rows = df.where(F.col(area).isNotNull() & F.col(shape).isNotNull()).select(*keys, order, F.col(area).cast("double").alias("__a"), F.col(shape).cast("double").alias("__s"))
    best = _band_best(rows, keys, order, "__a", "__s", tolerance)
    edge = rows.groupBy(*keys).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"))
    ends = _without(rows, best, keys).join(edge, keys).where("__s = __lo or __s = __hi")
    before = Window.partitionBy(*keys).orderBy("__a", order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda here: F.last(F.when(here, F.struct("__a", "__s", F.col(order).alias("o"))), ignorenulls=True).over(before)
    ends = ends.withColumns({"__low": last(F.col("__s") == F.col("__lo")), "__high": last(F.col("__s") == F.col("__hi"))})
    ends = ends.withColumn("__p", F.when(F.col("__s") == F.col("__hi"), F.col("__low")).otherwise(F.col("__high"))).where("__p is not null")
    widest = ends.groupBy(*keys).agg(
        F.min(
            F.struct(
                (-F.round(F.abs(F.col("__s") - F.col("__p.__s")), 12) + 0.0).alias("n"),
                F.round(F.col("__a") - F.col("__p.__a"), 12).alias("apart"),
                F.least(order, "__p.o").alias("first"),
                F.greatest(order, "__p.o").alias("second"),
            )
        ).alias("__c")
    )
    out = lambda found, within: found.select(
        *keys, "__c.first", "__c.second", (-F.col("__c.n")).alias("shape_gap"), F.col("__c.apart").alias("area_gap"), F.lit(within).alias("within_tolerance")
    )
    return out(best, True).unionByName(out(widest, False))


def id_set_diff(reference: DataFrame, candidate: DataFrame, ident: str, owner: str) -> DataFrame:
    """Ids missing from or extra in the candidate, and ids whose owner changed."""
    a = reference.select(ident, F.col(owner).alias("reference_owner"), F.lit(True).alias("__a"))
    b = candidate.select(ident, F.col(owner).alias("candidate_owner"), F.lit(True).alias("__b"))
    kind = (
        F.when(F.col("__b").isNull(), "missing")
        .when(F.col("__a").isNull(), "extra")
        .when(~F.col("reference_owner").eqNullSafe(F.col("candidate_owner")), "reassigned")
    )
    return a.join(b, ident, "full").withColumn("kind", kind).where("kind is not null").drop("__a", "__b")


def state_regressions(reference: DataFrame, candidate: DataFrame, keys: list[str], ranks: dict[str, dict[str, int]], confidence: str) -> DataFrame:
    """Per shared id: which ranked states fell, and the confidence change."""
    def rank(c: Column, order: dict[str, int]) -> Column:
        out = F.lit(-1)
        for text, r in order.items():
            out = F.when(c == text, r).otherwise(out)
        return out

    cols = [*ranks, confidence]
    both = reference.select(*keys, *[F.col(c).alias(f"reference_{c}") for c in cols]).join(
        candidate.select(*keys, *[F.col(c).alias(f"candidate_{c}") for c in cols]), keys
    )
    for c, order in ranks.items():
        both = both.withColumn(
            f"{c}_regressed", rank(F.col(f"candidate_{c}"), order) < rank(F.col(f"reference_{c}"), order)
        )
    return both.withColumn("confidence_delta", F.col(f"candidate_{confidence}") - F.col(f"reference_{confidence}"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """Absolute and relative delta of long metrics; a key on one side only is flagged."""
    a = before.select(*keys, metric, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = after.select(*keys, metric, F.col(value).alias("after"), F.lit(True).alias("__b"))
    delta = F.col("after") - F.col("before")
    return a.join(b, keys + [metric], "full").select(
        *keys,
        metric,
        "before",
        "after",
        delta.alias("absolute_delta"),
        F.when(F.abs("before") > 1e-12, delta / F.abs("before")).alias("relative_delta"),
        F.when(F.col("__a").isNull(), "missing_before").when(F.col("__b").isNull(), "missing_after").otherwise("ok").alias("status"),
    )


def referential_check(child: DataFrame, parent: DataFrame, link: str, ident: str, child_tag: str | None = None, parent_tag: str | None = None) -> DataFrame:
    """Links to an absent target or to one of another identity; the child side is collapsed first."""
    tags = [child_tag] if child_tag else []
    links = child.where(F.col(link).isNotNull()).groupBy(link, *tags).agg(F.count(F.lit(1)).alias("links"))
    targets = parent.select(F.col(ident).alias(link), *([F.col(parent_tag).alias("__tag")] if parent_tag else []), F.lit(True).alias("__have"))
    problem = F.when(F.col("__have").isNull(), "missing_target")
    if child_tag and parent_tag:
        problem = problem.when(~F.col(child_tag).eqNullSafe(F.col("__tag")), "identity_mismatch")
    return links.join(targets, link, "left").withColumn("problem", problem).where("problem is not null").drop("__have", "__tag")


def human_links(obs: DataFrame, items: DataFrame, period: int) -> DataFrame:
    """Each observation link to evidence by exact field, else by family; overlap and distance.

    obs: id, series_id, family, field_id, frames; items: item_id, series_id, family,
    field_ids, frames. Frame lists are short arrays, compared in place.
    """
    fields = items.select("item_id", "series_id", F.explode("field_ids").alias("field_id"), F.col("frames").alias("item_frames"))
    exact = obs.join(fields, ["series_id", "field_id"]).withColumn("resolution", F.lit("exact_field"))
    rest = obs.join(exact.select("id", "field_id").distinct(), ["id", "field_id"], "left_anti")
    family = rest.join(
        items.select("item_id", "series_id", "family", F.col("frames").alias("item_frames")), ["series_id", "family"]
    ).withColumn("resolution", F.lit("family"))
    none = rest.join(family.select("id", "field_id").distinct(), ["id", "field_id"], "left_anti").withColumn(
        "resolution", F.lit("unresolved")
    )
    rows = exact.unionByName(family).unionByName(none, allowMissingColumns=True)
    hop = lambda a, b: F.least(F.pmod(a - b, F.lit(period)), F.pmod(b - a, F.lit(period)))
    return rows.select(
        "id",
        "series_id",
        "field_id",
        "item_id",
        "resolution",
        F.size(F.array_intersect("frames", "item_frames")).alias("overlap"),
        F.array_min(
            F.transform("frames", lambda a: F.array_min(F.transform("item_frames", lambda b: hop(a, b))))
        ).alias("nearest"),
    ).withColumn("overlap", F.when(F.col("item_id").isNotNull(), F.col("overlap")))


