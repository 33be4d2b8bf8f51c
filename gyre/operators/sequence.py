"""Order-aware operators on traces (series, position).

Positions are dense ordinals. Long series are cut into position chunks, so that a series
holding a third of all rows is spread over many tasks; a row at a chunk edge is sent to
the neighbouring chunk as well (a halo), which makes `previous` and `next` exact with one
shuffle. Runs crossing chunk edges are closed in a second pass over the edge rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.guards import all_of, ratio
from gyre.functions.ranking import average_rank, quantiles, ranked_values, value_table
from gyre.session import written

CHUNK = 65_536


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "position", width: int = CHUNK) -> DataFrame:
    """Dense zero-based position by a unique, non-negative integer `order` column."""
    cut = df.withColumn("__chunk", F.floor(F.col(order) / width))
    sizes = cut.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(order))
    return (
        cut.withColumn("__rn", inside)
        .join(offsets, keys + ["__chunk"])
        .withColumn(name, F.col("__off") + F.col("__rn") - 1)
        .drop("__chunk", "__rn", "__off")
    )


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    cols: list[str],
    following: bool = False,
    width: int = CHUNK,
    dense: bool = True,
) -> DataFrame:
    """Add `prev_<c>` (and `next_<c>`) of the adjacent rows; positions have no holes unless `dense` is false."""
    chunk = F.floor(F.col(order) / width)
    if not dense:
        return _neighbours_with_holes(df.withColumn("__chunk", chunk), keys, order, cols, following)
    slot = F.pmod(F.col(order), F.lit(width))
    homes = [chunk, F.when(slot == width - 1, chunk + 1)]
    if following:
        homes.append(F.when((slot == 0) & (chunk > 0), chunk - 1))
    spread = df.withColumn("__chunk", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    out = spread.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
    if following:
        out = out.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return out.where(F.col("__chunk") == chunk).drop("__chunk")


def _neighbours_with_holes(cut: DataFrame, keys: list[str], order: str, cols: list[str], following: bool) -> DataFrame:
    """The first row of a chunk follows the last row of the chunk before that has any; these edges are one row a chunk."""
    edge = lambda pick: pick(F.struct(*cols), order)
    ends = cut.groupBy(*keys, "__chunk").agg(edge(F.min_by).alias("first"), edge(F.max_by).alias("last"))
    along = Window.partitionBy(*keys).orderBy("__chunk")
    ends = ends.select(*keys, "__chunk", F.lag("last").over(along).alias("__before"), F.lead("first").over(along).alias("__after"))
    ends = ends.where("__before is not null or __after is not null")
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order)
    out = cut.withColumns({"__row": F.row_number().over(inside), "__rest": F.lead(F.lit(1)).over(inside)})
    out = out.withColumns({f"prev_{c}": F.lag(c).over(inside) for c in cols} | ({f"next_{c}": F.lead(c).over(inside) for c in cols} if following else {}))
    out = out.join(ends, [*keys, "__chunk"], "left")
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.when(F.col("__row") == 1, F.col(f"__before.{c}")).otherwise(F.col(f"prev_{c}")))
        if following:
            out = out.withColumn(f"next_{c}", F.when(F.col("__rest").isNull(), F.col(f"__after.{c}")).otherwise(F.col(f"next_{c}")))
    return out.drop("__chunk", "__row", "__rest", "__before", "__after")


def adjacent(left: Column, right: Column, wrap: str = "none", period: int | None = None) -> Column:
    """Source-step adjacency: 'none', 'any' (anything > 0 back to 0) or 'exact' (n-1 to 0)."""
    step = right == left + 1
    if wrap == "any":
        return step | ((right == 0) & (left > 0))
    if wrap == "exact":
        return step | ((right == 0) & (left == period - 1))
    return step


def adjacent_delta(
    df: DataFrame, keys: list[str], order: str, source: str, value: str, wrap: str = "none", width: int = CHUNK
) -> DataFrame:
    """Signed and absolute change between neighbouring positions, with its status."""
    pairs = neighbours(df, keys, order, [order, source, value], width=width).where(F.col(f"prev_{order}").isNotNull())
    ok_step = adjacent(F.col(f"prev_{source}"), F.col(source), wrap)
    gap = F.col(value).isNull() | F.col(f"prev_{value}").isNull()
    status = F.when(~ok_step, "non_adjacent_source_steps").when(gap, "gap").otherwise("ok")
    delta = F.when(ok_step, F.col(value) - F.col(f"prev_{value}"))
    return pairs.withColumn("status", status).withColumn("signed_delta", delta).withColumn(
        "change", F.abs("signed_delta")
    )


def change_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: requested and observed pairs, median and q90 change."""
    sizes = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requested_pairs"),
        F.count("change").alias("observed_pairs"),
        F.count_if(F.col("status") == "gap").alias("gap_pairs"),
        F.count_if(F.col("status") == "non_adjacent_source_steps").alias("non_adjacent_pairs"),
    )
    stats = quantiles(pairs, keys, "change", {"median": 0.5, "q90": 0.9}).drop("n")
    return sizes.join(stats, keys, "left").withColumn(
        "status", F.when(F.col("observed_pairs") > 0, "ok").otherwise("unavailable")
    )


def paired_changes(
    df: DataFrame, keys: list[str], order: str, source: str, a: str, b: str, wrap: str = "none", width: int = CHUNK, dense: bool = True
) -> DataFrame:
    """Aligned changes of two traces, with both published direction vocabularies."""
    pairs = neighbours(df, keys, order, [order, source, a, b], width=width, dense=dense).where(F.col(f"prev_{order}").isNotNull())
    ok_step = adjacent(F.col(f"prev_{source}"), F.col(source), wrap)
    gap = ~all_of([F.col(c).isNotNull() for c in (a, b, f"prev_{a}", f"prev_{b}")])
    pairs = pairs.withColumn(
        "status", F.when(~ok_step, "non_adjacent_source_steps").when(gap, "gap").otherwise("ok")
    )
    ok = F.col("status") == "ok"
    pairs = pairs.withColumn("delta_a", F.when(ok, F.col(a) - F.col(f"prev_{a}"))).withColumn(
        "delta_b", F.when(ok, F.col(b) - F.col(f"prev_{b}"))
    )
    product = F.col("delta_a") * F.col("delta_b")
    still = (F.col("delta_a") == 0) | (F.col("delta_b") == 0)
    return pairs.select(
        "*",
        F.when(product > 0, "same").when(product < 0, "opposite").when(product == 0, "tie").alias("relationship"),
        F.when(ok & still, "flat").when(ok & (product > 0), "same").when(ok, "opposite").alias("direction"),
        F.least(F.abs("delta_a"), F.abs("delta_b")).alias("joint_strength"),
        F.abs(F.col("delta_a") - F.col("delta_b")).alias("divergence"),
        F.greatest(F.abs("delta_a"), F.abs("delta_b")).alias("movement"),
    )


def direction_summary(pairs: DataFrame, keys: list[str], column: str, still: str) -> DataFrame:
    same, opposite = F.count_if(F.col(column) == "same"), F.count_if(F.col(column) == "opposite")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requested_pairs"),
        F.count(column).alias("observed_pairs"),
        same.alias("same_pairs"),
        opposite.alias("opposite_pairs"),
        F.count_if(F.col(column) == still).alias(f"{still}_pairs"),
        ratio(same, same + opposite).alias("same_fraction"),
        F.when(same + opposite > 0, "ok").otherwise("unavailable").alias("status"),
    )


def runs(
    df: DataFrame,
    keys: list[str],
    order: str,
    state: str,
    barrier: str | None = None,
    width: int = CHUNK,
) -> DataFrame:
    """Maximal runs of equal non-null `state`: start, end, length, boundary reasons.

    A null state breaks a run. `barrier` names the reason a position has no state
    (default 'gap'). Boundary reason: the neighbour's barrier, 'state_change', or
    'window_endpoint'. One shuffle of the rows, a second of two rows per chunk.
    """
    base = df.withColumn("__why", F.col(barrier) if barrier else F.lit("gap"))
    near = neighbours(base, keys, order, [state, "__why", order], following=True, width=width).where(
        F.col(state).isNotNull()
    )

    def reason(side: str) -> Column:
        return (
            F.when(F.col(f"{side}_{order}").isNull(), "window_endpoint")
            .when(F.col(f"{side}_{state}").isNull(), F.col(f"{side}___why"))
            .otherwise("state_change")
        )

    first = F.col(f"prev_{state}").isNull() | (F.col(f"prev_{state}") != F.col(state))
    last = F.col(f"next_{state}").isNull() | (F.col(f"next_{state}") != F.col(state))
    chunk = F.floor(F.col(order) / width)
    marked = near.select(
        *keys,
        F.col(order).alias("__at"),
        F.col(state).alias("state"),
        chunk.alias("__chunk"),
        F.when(first, F.struct(F.col(order).alias("start"), reason("prev").alias("left_boundary"))).alias("__open"),
        F.when(last, reason("next")).alias("right_boundary"),
    )
    within = Window.partitionBy(*keys, "__chunk").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        marked.withColumn("__from", F.last("__open", ignorenulls=True).over(within))
        .withColumn("__closes", F.col("right_boundary").isNotNull())
        .where(F.col("__closes") | (F.pmod(F.col("__at"), F.lit(width)) == width - 1))
    )
    # A start seen in an earlier, already closed run of the chunk cannot leak: every run
    # that begins inside the chunk sets its own start.
    done = pieces.where(F.col("__closes") & F.col("__from").isNotNull())
    edges = pieces.where(F.col("__closes") != F.col("__from").isNotNull())
    chain = Window.partitionBy(*keys).orderBy("__at")
    joined_edges = (
        edges.withColumn("__from", F.coalesce("__from", F.lag("__from").over(chain))).where("__closes")
    )
    return (
        done.unionByName(joined_edges)
        .select(
            *keys,
            "state",
            F.col("__from.start").alias("start"),
            F.col("__at").alias("end"),
            (F.col("__at") - F.col("__from.start") + 1).alias("length"),
            F.col("__from.left_boundary").alias("left_boundary"),
            "right_boundary",
        )
        .withColumn(
            "censored", (F.col("left_boundary") != "state_change") | (F.col("right_boundary") != "state_change")
        )
    )


def state_summary(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Occupancy, transitions, observed pairs and longest true / false run per series."""
    changes = F.count_if(F.col("left_boundary") == "state_change")
    longest = lambda flag: F.coalesce(F.max(F.when(F.col("state") == flag, F.col("length"))), F.lit(0))
    return run_rows.groupBy(*keys).agg(
        F.sum("length").alias("observed"),
        ratio(F.sum(F.when(F.col("state"), F.col("length")).otherwise(0)), F.sum("length")).alias("occupancy"),
        changes.alias("transitions"),
        (F.sum(F.col("length") - 1) + changes).alias("observed_pairs"),
        longest(True).alias("longest_true"),
        longest(False).alias("longest_false"),
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, value) -> zero-based tie-averaged rank and group size."""
    ranked = ranked_values(value_table(df, keys, value, weight), keys, value)
    return ranked.select(*keys, value, "cnt", average_rank().alias("rank"), "total")


def paired_ranks(df: DataFrame, keys: list[str], a: str, b: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """Ranks of both measures over rows where both are present.

    Equal (a, b) rows collapse first; `carry` aggregates (for example the first position)
    travel with the collapsed row, `cnt` is its multiplicity. The collapsed rows are kept as a table: they meet their
    ranks by value, and an average that is computed again may differ in its last digit and meet nothing.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(*keys, a, b).agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in (carry or {}).items()]
    )
    cells = written(cells)
    rank_of = lambda v: average_ranks(cells, keys, v, F.col("cnt")).select(*keys, v, F.col("rank").alias(f"rank_{v}"), F.col("total"))
    return cells.join(rank_of(a), keys + [a]).join(rank_of(b).drop("total"), keys + [b])


def weighted_pearson(x: str, y: str, w: str) -> Column:
    """Aggregate Pearson r of rows with an integer multiplicity; null when constant."""
    x, y, w = F.col(x), F.col(y), F.col(w)
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - sx * sy / n
    vx, vy = F.sum(w * x * x) - sx * sx / n, F.sum(w * y * y) - sy * sy / n
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies & (n >= 3), F.try_divide(cov, F.sqrt(vx * vy)))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman rank agreement per key; fewer than three pairs or a constant side is null."""
    ranks = paired_ranks(df, keys, a, b)
    return ranks.groupBy(*keys).agg(
        F.sum("cnt").alias("paired"), weighted_pearson(f"rank_{a}", f"rank_{b}", "cnt").alias("rho")
    )


def rank_disagreement(df: DataFrame, keys: list[str], order: str, a: str, b: str) -> DataFrame:
    """Strongest |rank a - rank b| / (n - 1) and the earliest position showing it."""
    ranks = paired_ranks(df, keys, a, b, {order: F.min(order)})
    gap = F.abs(F.col(f"rank_{a}") - F.col(f"rank_{b}")) / F.greatest(F.lit(1.0), F.col("total") - F.lit(1.0))
    scored = ranks.withColumn("rank_disagreement", gap)
    best = F.max(F.struct("rank_disagreement", (-F.col(order)).alias("__neg"), F.col(a), F.col(b)))
    return (
        scored.groupBy(*keys)
        .agg(best.alias("__b"), F.max("total").alias("aligned"))
        .where("aligned >= 2")
        .select(*keys, "aligned", (-F.col("__b.__neg")).alias(order), f"__b.{a}", f"__b.{b}", "__b.rank_disagreement")
    )


def field_orders(df: DataFrame, keys: list[str], ident: str, value: str) -> DataFrame:
    """Descending rank by (value, id), its mirror image and the sample size.

    The value table gives the offset of each value; ids sharing one exact value are ranked
    among themselves by the same cutting rank, so neither a dominating key nor a dominating
    value is sorted in one task. Text ids fall back to a window over one value's rows.
    """
    rows = written(df.where(F.col(value).isNotNull()).select(*keys, ident, value))  # rows meet their ranks by value
    ranked = ranked_values(value_table(rows, keys, value), keys, value)
    same = keys + [value]
    if dict(rows.dtypes)[ident] == "string":
        tie = F.row_number().over(Window.partitionBy(*same).orderBy(ident)) - 1
        ties = rows.withColumn("__tie", tie)
    else:
        ties = ranked_values(value_table(rows, same, ident), same, ident).select(*same, ident, F.col("below").alias("__tie"))
    return (
        ties.join(ranked, same)
        .withColumn("rank_descending", F.col("total") - F.col("below") - F.col("cnt") + F.col("__tie") + 1)
        .withColumn("rank_ascending", F.col("total") - F.col("rank_descending") + 1)
        .withColumnRenamed("total", "sample_size")
        .select(*keys, ident, value, "sample_size", "rank_descending", "rank_ascending")
    )
