"""Operators on closed cycles of n slots; every window here holds at most n rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import ratio
from gyre.operators.sequence import neighbours, ordinal


def full_cycle(df: DataFrame, keys: list[str], slot: str, period: int, flag: str = "seen") -> DataFrame:
    """One row per (series, slot): unseen slots appear with nulls and flag false."""
    present = df.groupBy(*keys).agg(F.collect_set(slot).alias("__have"))  # at most n integers
    missing = present.select(
        *keys,
        F.explode(
            F.array_except(F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda s: s.cast("int")), "__have")
        ).alias(slot),
    ).withColumn(flag, F.lit(False))
    return df.withColumn(flag, F.lit(True)).unionByName(missing, allowMissingColumns=True)


def circular_distance(a: Column, b: Column, period: int) -> Column:
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)


def circular_runs(df: DataFrame, keys: list[str], slot: str, flag: str, period: int) -> DataFrame:
    """Longest circular gap, circular component count, and linear longest gap and run.

    A series is rotated to start just after its first flagged slot, so no run of unflagged
    slots crosses the seam; windows hold one cycle.
    """
    w = Window.partitionBy(*keys)
    anchor = F.min(F.when(F.col(flag), F.col(slot))).over(w)
    rows = df.select(*keys, slot, flag, anchor.alias("__anchor")).withColumn(
        "__turn", F.pmod(F.col(slot) - F.coalesce("__anchor", F.lit(0)), F.lit(period))
    )
    islands = rows.withColumn("__lin", F.sum(F.col(flag).cast("int")).over(w.orderBy(slot))).withColumn(
        "__cir", F.sum(F.col(flag).cast("int")).over(w.orderBy("__turn"))
    )
    islands = islands.withColumn("__off", F.sum((~F.col(flag)).cast("int")).over(w.orderBy(slot)))
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w.orderBy("__turn")), F.lit(False))
    sizes = islands.withColumn("__start", starts).select(
        "*",
        F.count_if(~F.col(flag)).over(Window.partitionBy(*keys, "__lin")).alias("__lingap"),
        F.count_if(~F.col(flag)).over(Window.partitionBy(*keys, "__cir")).alias("__cirgap"),
        F.count_if(F.col(flag)).over(Window.partitionBy(*keys, "__off")).alias("__linrun"),
    )
    out = sizes.groupBy(*keys).agg(
        F.max("__cirgap").alias("longest_circular_gap"),
        F.count_if("__start").alias("starts"),
        F.max("__lingap").alias("longest_gap"),
        F.max("__linrun").alias("longest_run"),
        F.count_if(flag).alias("flagged"),
    )
    # After rotation the last slot may join the first run: it starts at the anchor, so a
    # flagged final stretch belongs to the same component.
    tail = (
        rows.withColumn("__next", F.max(F.when(~F.col(flag), F.col("__turn"))).over(w))
        .groupBy(*keys)
        .agg(F.max(F.col(flag) & (F.col("__turn") == period - 1)).alias("__wraps"), F.max("__next").alias("__lastgap"))
    )
    return (
        out.join(tail, keys)
        .withColumn(
            "components",
            F.col("starts")
            - F.when(F.col("__wraps") & F.col("__lastgap").isNotNull() & (F.col("starts") > 1), 1).otherwise(0),
        )
        .withColumn("longest_circular_gap_fraction", ratio("longest_circular_gap", F.lit(period)))
        .drop("starts", "__wraps", "__lastgap")
    )


def moving_average(df: DataFrame, keys: list[str], slot: str, value: str, radius: int, period: int) -> DataFrame:
    """Mean over +-radius slots around the cycle; each row is sent to its 2r+1 slots."""
    offsets = F.array([F.lit(o) for o in range(-radius, radius + 1)])
    return (
        df.select(*keys, F.explode(F.transform(offsets, lambda o: F.pmod(F.col(slot) + o, F.lit(period)))).alias(slot), value)
        .groupBy(*keys, slot)
        .agg(F.avg(value).alias(f"smooth_{value}"))
    )


def next_observed(df: DataFrame, keys: list[str], slot: str, period: int, max_gap: int) -> DataFrame:
    """Each observed slot to the next one around the cycle; gaps beyond the limit are flagged."""
    w = Window.partitionBy(*keys)
    ahead = F.coalesce(F.lead(slot).over(w.orderBy(slot)), F.min(slot).over(w))
    gap = F.pmod(F.col("to_slot") - F.col(slot), F.lit(period))
    return (
        df.select(*keys, slot, ahead.alias("to_slot"))
        .withColumn("frame_gap", gap)
        .where("frame_gap > 0")
        .withColumn("consecutive", F.col("frame_gap") == 1)
        .withColumn("unsampled", F.col("frame_gap") - 1)
        .withColumn("skipped", F.col("frame_gap") > max_gap)
    )


def anchor_neighbours(df: DataFrame, keys: list[str], slot: str, rank: str, period: int, limit: int) -> DataFrame:
    """(a-1, a) and (a, a+1) of each anchor in rank order, deduplicated, first `limit` pairs."""
    before = F.pmod(F.col(slot) - 1, F.lit(period))
    after = F.pmod(F.col(slot) + 1, F.lit(period))
    pairs = F.array(
        F.struct((F.col(rank) * 2).alias("o"), before.alias("a"), F.col(slot).alias("b")),
        F.struct((F.col(rank) * 2 + 1).alias("o"), F.col(slot).alias("a"), after.alias("b")),
    )
    first = df.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.a", "p.b").agg(F.min("p.o").alias("__o"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("__o"))
    return first.withColumn("pair_no", n).where(F.col("pair_no") <= limit).drop("__o")


def cover_arc(df: DataFrame, keys: list[str], slot: str, period: int, pad: int, cap: int) -> DataFrame:
    """Smallest arc holding all anchors (largest gap removed, earliest on ties) as step pairs.

    An arc beyond the cap yields one error row and no pairs.
    """
    hops = next_observed(df, keys, slot, period, period)
    widest = hops.groupBy(*keys).agg(
        F.max(F.struct("frame_gap", (-F.col(slot)).alias("__neg"), "to_slot")).alias("g"), F.count(F.lit(1)).alias("anchors")
    )
    arcs = widest.where("anchors >= 2").select(
        *keys,
        F.col("g.to_slot").alias("arc_start"),
        (-F.col("g.__neg")).alias("arc_end"),
        F.col("g.frame_gap").alias("excluded_gap"),
    )
    total = F.pmod(F.col("arc_end") - F.col("arc_start"), F.lit(period)) + 2 * pad
    arcs = arcs.withColumn("pair_count", total)
    steps = F.when(F.col("pair_count") <= cap, F.sequence(F.lit(0), F.col("pair_count") - 1))
    origin = F.col("arc_start") - pad + F.col("step")
    return (
        arcs.withColumn("step", F.explode_outer(steps))
        .withColumn("from_slot", F.pmod(origin, F.lit(period)))
        .withColumn("to_slot", F.pmod(origin + 1, F.lit(period)))
        .withColumn("status", F.when(F.col("step").isNull(), "arc_exceeds_cap").otherwise("ok"))
    )


def circular_nearest(a: DataFrame, b: DataFrame, keys: list[str], slot: str, period: int) -> DataFrame:
    """Per series: smallest circular distance between two slot sets (each at most n slots)."""
    left = a.select(*keys, F.col(slot).alias("__a")).distinct()
    right = b.select(*keys, F.col(slot).alias("__b")).distinct()
    return left.join(right, keys).groupBy(*keys).agg(
        F.min(circular_distance(F.col("__a"), F.col("__b"), period)).alias("nearest"),
        F.count_if(F.col("__a") == F.col("__b")).alias("overlap"),
    )


def phase(df: DataFrame, slot: Column, reference: Column, period: int, cycle: float, sign: int) -> DataFrame:
    """Forward frames from the reference, phase in [0, cycle) and in [-cycle/2, cycle/2)."""
    step = cycle / period
    forward = F.pmod(slot - reference, F.lit(period))
    turned = F.pmod(forward * F.lit(sign * step), F.lit(float(cycle)))
    return df.select(
        "*",
        forward.alias("offset_frames"),
        (forward * F.lit(sign * step)).alias("phase_unwrapped"),
        turned.alias("phase_0"),
        (F.pmod(turned + cycle / 2, F.lit(float(cycle))) - cycle / 2).alias("phase_signed"),
    )


def two_lobes(
    df: DataFrame, keys: list[str], slot: str, score: str, tie: str, period: int, gap_limit: float = 0.10,
    noise_floor: float = 0.005, confidence_limit: float = 1.5,
) -> DataFrame:
    """Main smoothed peak, best peak a quarter cycle away and which of the two is preferred.

    `df` holds complete cycles (missing scores as 0); an incomplete cycle, or one without a second
    peak, is `unavailable`. Fixed values of the rule: quarter-cycle
    separation, smoothing radius n/32 (at least 2), gap limit, noise floor, 1.5 MAD units.
    """
    radius = max(2, round(period / 32))
    apart = max(2, round(period / 4))
    smooth = moving_average(df, keys, slot, score, radius, period)
    value = f"smooth_{score}"
    top = smooth.groupBy(*keys).agg(
        F.max(F.struct(value, (-F.col(slot)).alias("neg"))).alias("t"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") == period)
    top = top.select(*keys, (-F.col("t.neg")).alias("primary"), F.col(f"t.{value}").alias("primary_score"))
    far = smooth.join(top, keys).where(circular_distance(F.col(slot), F.col("primary"), period) >= apart)
    second = far.groupBy(*keys).agg(F.max(F.struct(value, (-F.col(slot)).alias("neg"))).alias("t"))
    lobes = top.join(
        second.select(*keys, (-F.col("t.neg")).alias("secondary"), F.col(f"t.{value}").alias("secondary_score")), keys, "left"
    )
    near = df.join(lobes, keys)

    def side(which: str) -> DataFrame:
        inside = near.where(circular_distance(F.col(slot), F.col(which), period) <= radius)
        med = inside.groupBy(*keys).agg(F.median(tie).alias(f"{which}_tie"))
        mad = inside.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(tie) - F.col(f"{which}_tie"))).alias(f"{which}_mad"))
        return med.join(mad, keys)

    out = df.select(*keys).distinct().join(lobes, keys, "left").join(side("primary"), keys, "left").join(side("secondary"), keys, "left")
    gap = F.col("primary_score") - F.col("secondary_score")
    diff = F.col("primary_tie") - F.col("secondary_tie")
    noise = F.greatest(F.coalesce("primary_mad", F.lit(0.0)), F.coalesce("secondary_mad", F.lit(0.0)), F.lit(noise_floor))
    confidence = F.when(gap <= gap_limit, F.abs(diff) / noise)
    resolved = confidence >= confidence_limit
    return out.select(
        *keys, "primary", "secondary", "primary_score", "secondary_score", gap.alias("gap"),
        confidence.alias("confidence"),
        F.when(F.col("secondary").isNull(), "unavailable").when(gap > gap_limit, "not_needed").when(resolved, "resolved").otherwise("ambiguous").alias("status"),
        F.when(resolved & (diff > 0), F.col("primary")).when(resolved, F.col("secondary")).alias("preferred"),
    )


def _turned(angle: Column) -> Column:
    """Square of a circular difference in millionths, an exact integer, so sums do not depend on their order."""
    d = angle + 180.0 - F.lit(360.0) * F.floor((angle + 180.0) / 360.0) - 180.0
    return F.floor(d * d * 1e6 + 0.5)


def quarter_turns(df: DataFrame, keys: list[str], slot: str, angle: str, chunk: int = 1024) -> DataFrame:
    """Quarter-turn branch per frame minimising the sum of squared circular jumps, as a scan.

    A step costs by the difference of the branches at its ends. The steps of `chunk` frames fold to a
    4 x 4 min-plus matrix (entry branch, exit branch) with the branches of each of its 16 best paths, so a
    long cycle is spread over tasks; the matrices of a cycle, without paths, are folded in order, and
    every chunk then looks its own path up by the entry and exit chosen. The first frame is the
    reference (branch 0) and the cycle is closed back to it. Of equally good paths the one whose last
    differing branch is the smaller is taken.
    """
    four, far = F.array(*[F.lit(k) for k in range(4)]), 1 << 61
    rows = neighbours(ordinal(df.select(*keys, slot, angle), keys, slot), keys, "position", [angle])
    costs = F.array(*[_turned(F.col(f"prev_{angle}") - F.col(angle) - 90.0 * d) for d in range(4)])
    rows = rows.withColumn("__chunk", F.floor(F.col("position") / chunk)).withColumn("__costs", costs)

    def start(entry: Column) -> Column:
        return F.transform(four, lambda s: F.struct(F.when(s == entry, F.lit(0)).otherwise(F.lit(far)).cast("bigint").alias("cost"), F.lit("").alias("path")))

    def advance(acc: Column, step: Column) -> Column:
        def into(s: Column) -> Column:
            def via(p: Column) -> Column:
                cost = F.get(acc, p)["cost"] + F.get(step["costs"], F.pmod(s - p, F.lit(4)))
                return F.struct(cost.alias("cost"), F.concat(p.cast("string"), F.get(acc, p)["path"]).alias("path"))

            return F.array_min(F.transform(four, via))

        return F.transform(four, into)

    step = F.struct("position", F.col(slot).alias("slot"), F.col("__costs").alias("costs"))
    folded = rows.where("position > 0").groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    folded = folded.withColumn("best", F.transform(four, lambda q: F.aggregate("steps", start(q), advance)))

    def place(q: Column, r: Column) -> Column:
        return F.size(F.filter("best", lambda other: F.get(other, r)["path"] < F.get(F.get("best", q), r)["path"]))

    matrix = F.transform(
        four, lambda r: F.transform(four, lambda q: F.struct(F.get(F.get("best", q), r)["cost"].alias("cost"), place(q, r).alias("place")))
    )

    def join(acc: Column, link: Column) -> Column:
        def into(r: Column) -> Column:
            def via(q: Column) -> Column:
                here = F.get(F.get(link["matrix"], r), q)
                return F.struct((F.get(acc, q)["cost"] + here["cost"]).alias("cost"), here["place"].alias("place"), q.alias("q"))

            won = F.array_min(F.transform(four, via))
            return F.struct(won["cost"].alias("cost"), F.concat(won["q"].cast("string"), F.get(acc, won["q"])["path"]).alias("path"))

        return F.transform(four, into)

    ends = rows.groupBy(*keys).agg(F.min_by(angle, "position").alias("__first"), F.max_by(angle, "position").alias("__last"))
    chain = folded.select(*keys, F.struct("__chunk", matrix.alias("matrix")).alias("link")).groupBy(*keys).agg(F.array_sort(F.collect_list("link")).alias("links"))
    chain = chain.join(ends, keys).withColumn("acc", F.aggregate("links", start(F.lit(0)), join))
    closed = F.transform(
        four, lambda r: F.struct((F.get("acc", r)["cost"] + _turned(F.col("__last") - F.col("__first") + 90.0 * r)).alias("cost"), r.alias("r"), F.get("acc", r)["path"].alias("path"))
    )
    won = chain.select(*keys, F.col("links.__chunk").alias("chunks"), F.array_min(closed).alias("won"))
    entries = F.transform("chunks", lambda c, i: F.struct(
        c.alias("chunk"),
        F.substr(F.col("won.path"), F.size("chunks") - i, F.lit(1)).cast("int").alias("entry"),
        F.when(i == F.size("chunks") - 1, F.col("won.r")).otherwise(F.substr(F.col("won.path"), F.size("chunks") - i - 1, F.lit(1)).cast("int")).alias("exit"),
    ))
    chosen = won.select(*keys, F.explode(entries).alias("e"), (F.col("won.cost") / 1e6).alias("objective")).select(
        *keys, F.col("e.chunk").alias("__chunk"), F.col("e.entry").alias("entry"), F.col("e.exit").alias("exit"), "objective"
    )
    paths = folded.join(chosen, [*keys, "__chunk"])
    digits = F.concat(F.reverse(F.get(F.get("best", F.col("entry")), F.col("exit"))["path"]), F.col("exit").cast("string"))
    turned = paths.select(*keys, "objective", F.explode(
        F.transform("steps", lambda x, i: F.struct(x["slot"].alias("slot"), F.substr(digits, i + 2, F.lit(1)).cast("int").alias("turn")))
    ).alias("z")).select(*keys, F.col("z.slot").alias(slot), F.col("z.turn").alias("quarter_turn"), "objective")
    first = rows.where("position = 0").select(*keys, slot, F.lit(0).alias("quarter_turn")).join(won.select(*keys, (F.col("won.cost") / 1e6).alias("objective")), keys, "left")
    return turned.unionByName(first.fillna(0.0, ["objective"]))


def phase_step_errors(df: DataFrame, keys: list[str], slot: str, angle: str, period: int, cycle: float) -> DataFrame:
    """|observed - expected| phase step to the next observed slot, last back to first included."""
    w = Window.partitionBy(*keys).orderBy(slot)
    whole = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(
        *keys,
        slot,
        F.coalesce(F.lead(slot).over(w), F.first(slot).over(whole)).alias("next_slot"),
        F.coalesce(F.lead(angle).over(w), F.first(angle).over(whole)).alias("__to"),
        F.col(angle).alias("__from"),
    )
    expected = F.pmod(F.col("next_slot") - F.col(slot), F.lit(period)) * F.lit(cycle / period)
    observed = F.pmod(F.col("__to") - F.col("__from"), F.lit(cycle))
    off = F.abs(F.col("observed_step") - F.col("expected_step"))
    return (
        rows.withColumn("expected_step", expected)
        .withColumn("observed_step", observed)
        .withColumn("step_error", F.least(off, F.lit(cycle) - off))
        .drop("__to", "__from")
    )
