"""Evidence candidates, grouping, coverage selection and packets.

A candidate: series_id, family, native_id, event_type, kind, source_indices (array),
field_ids (array), importance, status, reasons (array). Candidates are a few rows per
series and rule by construction, so lists per series are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.guards import status_name, status_rank
from gyre.functions.ranking import ranked_values, value_table
from gyre.operators.cycles import circular_distance
from gyre.operators.selection import extreme

# Coverage order, the role of each family, event preference within a role
# and the contrast partner of an event type.
COVERAGE_ORDER = (
    "activity_motion",
    "relative_dark_state",
    "dark_persistence",
    "nested_step",
    "directional",
    "flash_morphology",
)
ROLE_OF_FAMILY = {
    "activation": "activity_motion",
    "mobility": "activity_motion",
    "occupancy": "relative_dark_state",
    "switching": "relative_dark_state",
    "persistence": "dark_persistence",
    "coordination": "nested_step",
    "opposing": "directional",
    "morphology": "flash_morphology",
}
FAMILY_RANK = {"mobility": 0, "activation": 1, "switching": 0, "occupancy": 1}
EVENT_RANK = {
    "activity_motion": {
        "largest": 0,
        "q90": 1,
        "largest_positive_move": 2,
        "largest_negative_move": 2,
        "q10": 3,
        "median": 4,
        "q50": 5,
        "lowest_nonzero": 6,
    },
    "relative_dark_state": {"highest": 0, "q90": 1, "lowest_nonzero": 2, "q50": 3, "q10": 4},
    "dark_persistence": {"dark_q90_run": 0},
    "flash_morphology": {"matched_active_area_pair": 0, "broadest": 1, "most_fragmented": 2},
}
COMPLEMENT = {
    "broadest": "most_fragmented",
    "most_fragmented": "broadest",
    "strongest_coordinated": "strongest_divergent",
    "strongest_divergent": "strongest_coordinated",
    "highest": "lowest_nonzero",
    "lowest_nonzero": "highest",
    "q90": "q10",
    "q10": "q90",
}
SIGNED = ("strongest_coordinated", "strongest_divergent")
KINDS = ("frame", "pair", "run")


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """Quantile on the cumulative weight, interpolated between values; null below two points.

    Equal values collapse to one point (row order cannot matter). The brackets around each
    target are plain min / max aggregates over the ranked value table.
    """
    rows = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    ranked = ranked_values(value_table(rows, keys, value, F.col(weight)), keys, value)
    ranked = ranked.withColumn("__q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    up_to = F.col("below") + F.col("cnt")
    target = F.col("__q") * F.col("total")
    low = F.max(F.when(up_to < target, F.struct(up_to.alias("c"), F.col(value).alias("v"))))
    high = F.min(F.when(up_to >= target, F.struct(up_to.alias("c"), F.col(value).alias("v"))))
    cut = ranked.groupBy(*keys, F.col("__q").alias("q")).agg(
        low.alias("a"), high.alias("b"), F.max("total").alias("__t")
    )
    at = F.col("q") * F.col("__t")
    blend = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (at - F.col("a.c")) / (F.col("b.c") - F.col("a.c"))
    points = df.groupBy(*keys).agg(F.count_if((F.col(weight) > 0) & F.col(value).isNotNull()).alias("__n"))
    asked = points.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    found = cut.select(*keys, "q", F.coalesce(blend, F.col("b.v")).alias("value"))
    return asked.join(found, [*keys, "q"], "left").select(*keys, "q", F.when(F.col("__n") >= 2, F.col("value")).alias("value"))


def nearest_to_quantile(df: DataFrame, keys: list[str], order: str, value: str, qs: dict[str, float]) -> DataFrame:
    """Earliest row nearest each quantile, for series of any length.

    The nearest value is one of the two values bracketing the quantile, so it is read from
    the ranked value table, which carries the first position of every value.
    """
    counts = value_table(df, keys, value, carry={order: F.min(order)})
    ranked = ranked_values(counts, keys, value)
    last = F.col("total") - 1
    covers = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("cnt"))
    cell = F.struct(F.col(value).alias("v"), F.col(order).alias("p"))
    aggs = [F.max("total").alias("__n")]
    for name, q in qs.items():
        at = last * F.lit(float(q))
        aggs += [
            F.max(F.when(covers(F.floor(at)), cell)).alias(f"lo_{name}"),
            F.max(F.when(covers(F.ceil(at)), cell)).alias(f"hi_{name}"),
        ]
    wide = ranked.groupBy(*keys).agg(*aggs)
    options = []
    for name, q in qs.items():
        at = (F.col("__n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        target = lo["v"] + (hi["v"] - lo["v"]) * (at - F.floor(at))
        dist = lambda c: F.struct(F.round(F.abs(c["v"] - target), 9).alias("d"), c["p"].alias("p"), c["v"].alias("v"))
        options.append(F.struct(F.lit(name).alias("rule"), F.least(dist(lo), dist(hi)).alias("b")))
    return wide.select(*keys, F.explode(F.array(*options)).alias("z")).select(
        *keys, F.col("z.rule").alias("rule"), F.col("z.b.p").alias(order), F.col("z.b.v").alias(value)
    )


def extreme_moves(pairs: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """Biggest rise and biggest fall between neighbours, earliest on ties."""
    rise = extreme(pairs, keys, "largest_positive_move", delta, order, True, F.col(delta) > 0)
    fall = extreme(pairs, keys, "largest_negative_move", delta, order, False, F.col(delta) < 0)
    return rise.unionByName(fall)


def extreme_rows(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Largest, smallest, nearest the median and smallest non-zero rows."""
    return (
        extreme(df, keys, "largest", value, order, True)
        .unionByName(extreme(df, keys, "lowest", value, order, False))
        .unionByName(extreme(df, keys, "lowest_nonzero", value, order, False, F.col(value) > 0))
        .unionByName(nearest_to_quantile(df, keys, order, value, {"median": 0.5, "q90": 0.9}))
    )


def pair_events(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Strongest same-direction, strongest opposite and typical directional change."""
    moving = pairs.where(F.col("relationship").isin("same", "opposite"))
    strength = "joint_strength"
    return (
        extreme(moving, keys, "strongest_coordinated", strength, order, True, F.col("relationship") == "same")
        .unionByName(extreme(moving, keys, "strongest_divergent", strength, order, True, F.col("relationship") == "opposite"))
        .unionByName(nearest_to_quantile(moving, keys, order, strength, {"typical_directional": 0.5}))
    )


def morphology_events(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Broadest and most fragmented frames among those with active cells."""
    ok = frames.where("status = 'ok'")
    broad = F.max(F.struct("largest_component_support_fraction", "largest_component_fraction", (-F.col(order)).alias("n")))
    split = F.max(F.struct("effective_component_count", (-F.col("largest_component_fraction")).alias("s"), (-F.col(order)).alias("n")))
    wide = ok.groupBy(*keys).agg(broad.alias("b"), split.alias("f"))
    rows = F.array(
        F.struct(F.lit("broadest").alias("rule"), (-F.col("b.n")).alias("p"), F.col("b.largest_component_support_fraction").alias("v")),
        F.struct(F.lit("most_fragmented").alias("rule"), (-F.col("f.n")).alias("p"), F.col("f.effective_component_count").alias("v")),
    )
    return wide.select(*keys, F.explode(rows).alias("z")).select(
        *keys, F.col("z.rule").alias("rule"), F.col("z.p").alias(order), F.col("z.v").alias("value")
    )


def widest_range(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Frame whose value moves most across a sweep (two finite values at least)."""
    span = frames.where(F.col(value).isNotNull()).groupBy(*keys, order).agg(
        (F.max(value) - F.min(value)).alias("span"), F.count(value).alias("__n")
    ).where("__n >= 2")
    return extreme(span, keys, "widest_threshold_range", "span", order, True)


def mode_disagreement(a: DataFrame, b: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Strongest and weakest frame difference of the same measure under two support modes."""
    both = a.select(*keys, order, F.col(value).alias("__a")).join(b.select(*keys, order, F.col(value).alias("__b")), keys + [order])
    gap = both.select(*keys, order, F.abs(F.col("__a") - F.col("__b")).alias("difference"))
    return extreme(gap, keys, "strongest", "difference", order, True).unionByName(
        extreme(gap, keys, "control", "difference", order, False)
    )


def max_disagreement(cells: DataFrame, keys: list[str], mode: str, left: str, right: str, within: list[str], value: str) -> DataFrame:
    """Per key: the cell whose value differs most between two modes (smallest cell id on ties)."""
    side = lambda m, to: F.max(F.when(F.col(mode) == m, F.col(value))).alias(to)
    pairs = cells.groupBy(*keys, *within).agg(side(left, "left_value"), side(right, "right_value"))
    gap = F.round(-F.abs(F.col("left_value") - F.col("right_value")), 12)
    best = F.min(F.when(gap.isNotNull(), F.struct(gap.alias("n"), *within, "left_value", "right_value")))
    return pairs.groupBy(*keys).agg(best.alias("b")).where("b is not null").select(
        *keys, *[F.col(f"b.{c}").alias(c) for c in within], "b.left_value", "b.right_value", (-F.col("b.n")).alias("difference")
    )


# What a family's native events measure; the first column present gives a candidate's importance.
MEASURE_OF_FAMILY = {
    "activation": ("delta",),
    "occupancy": ("delta",),
    "switching": ("switch_fraction",),
    "persistence": ("run_length",),
    "mobility": ("mobility",),
    "coordination": ("joint_move_strength",),
    "opposing": ("movement_strength", "divergence_strength"),
    "morphology": ("shape",),
}
MOVES = ("largest_positive_move", "largest_negative_move")


def _one(index: str) -> Column:
    return F.array(F.col(index).cast("int"))


def _pair_of(left: str, right: str) -> Column:
    return F.array(F.col(left).cast("int"), F.col(right).cast("int"))


def _by_position(rows: DataFrame, order: DataFrame, start: Column, end: Column) -> DataFrame:
    """Add `kind` and `source_indices`: the source indices of the positions start..end, empty where any is missing."""
    base = [c for c in rows.columns]
    spread = rows.withColumn("__n", end - start + 1).withColumn("position", F.explode_outer(F.when(start <= end, F.sequence(start, end))))
    at = spread.join(order.select("series_id", "position", F.col("source_index").cast("int").alias("__s")), ["series_id", "position"], "left")
    held = at.groupBy(*base, "__n").agg(F.array_sort(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct("position", "__s")))).alias("__l"))
    whole = (F.col("__n") > 0) & (F.size("__l") == F.col("__n"))
    return held.withColumn("source_indices", F.when(whole, F.transform("__l", lambda x: x["__s"])).otherwise(F.array().cast("array<int>"))).drop("__n", "__l")


def adapt(family: str, events: DataFrame, order: DataFrame) -> DataFrame:
    """Candidates from the native events of a family: series_id, native_id, event_type, field_ids, status, reasons, its
    measures, and a place.

    A place is a source_index (frames), left_source_index and right_source_index (pairs), or, read through
    `order` (series_id, position, source_index), the position of a move's second frame or a run's start_position and
    end_position. Events without a place are dropped; a run or move outside the order is unavailable.
    """
    if family not in MEASURE_OF_FAMILY:
        raise ValueError(f"unknown evidence family: {family}")
    have = set(events.columns)
    rows = events
    for name, kind in (("field_ids", "array<string>"), ("reasons", "array<string>"), ("status", "string"), ("native_id", "string")):
        if name not in have:
            usual = {"status": F.lit("ok"), "native_id": F.lit(family)}.get(name, F.array())
            rows = rows.withColumn(name, usual.cast(kind))
    measures = [F.abs(F.col(m).cast("double")) for m in MEASURE_OF_FAMILY[family] if m in have]
    if family == "opposing" and {"movement_strength", "divergence_strength"} <= have:
        measures = [F.when(F.col("event_type") == "strongest_divergent", measures[1]).otherwise(measures[0])]
    rows = rows.withColumn("importance", F.coalesce(*measures, F.lit(None).cast("double")) if measures else F.lit(None).cast("double"))
    held = ["series_id", "native_id", "event_type", "field_ids", "status", "reasons", "importance"]
    parts = []
    if "source_index" in have:
        parts.append(rows.where("source_index is not null").select(*held, F.lit("frame").alias("kind"), _one("source_index").alias("source_indices")))
    if "left_source_index" in have:
        pairs = rows.where("left_source_index is not null and right_source_index is not null")
        parts.append(pairs.select(*held, F.lit("pair").alias("kind"), _pair_of("left_source_index", "right_source_index").alias("source_indices")))
    if family in ("activation", "occupancy") and "position" in have:
        moves = rows.where(F.col("event_type").isin(*MOVES) & F.col("position").isNotNull()).select(*held, F.col("position").alias("__end"))
        parts.append(_by_position(moves, order, F.col("__end") - 1, F.col("__end")).select(*held, F.lit("pair").alias("kind"), "source_indices"))
    if "start_position" in have:
        runs = rows.where("start_position is not null").select(*held, "start_position", "end_position")
        parts.append(_by_position(runs, order, F.col("start_position"), F.col("end_position")).select(*held, F.lit("run").alias("kind"), "source_indices"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    lost = F.size("source_indices") == 0
    return out.select(
        "series_id", F.lit(family).alias("family"), "native_id", "event_type", "kind", "source_indices", "field_ids", "importance",
        F.when(lost, "unavailable").otherwise(F.col("status")).alias("status"),
        F.when(lost, F.array_append("reasons", F.lit("positions_outside_order"))).otherwise(F.col("reasons")).alias("reasons"),
    )


def collect_candidates(native: dict[str, DataFrame], order: DataFrame) -> DataFrame:
    """Candidates of all families given, each from its own native events."""
    out = None
    for family, events in native.items():
        part = adapt(family, events, order)
        out = part if out is None else out.unionByName(part)
    return out


def candidate(df: DataFrame, family: str, native: str, kind: str, indices: Column, fields: list[str], importance: Column) -> DataFrame:
    """Common evidence schema from rows with `series_id` and `rule`."""
    return df.select(
        "series_id",
        F.lit(family).alias("family"),
        F.lit(native).alias("native_id"),
        F.col("rule").alias("event_type"),
        F.lit(kind).alias("kind"),
        indices.alias("source_indices"),
        F.array(*[F.lit(f) for f in fields]).alias("field_ids"),
        importance.cast("double").alias("importance"),
        F.lit("ok").alias("status"),
        F.array().cast("array<string>").alias("reasons"),
    )


def apply_contract(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """Keep candidates with a retained profile field; profile validity can only worsen them."""
    ident = ["series_id", "family", "native_id", "event_type", "kind", "source_indices"]
    fields = candidates.select("*", F.posexplode("field_ids").alias("__i", "field_id"))
    held = fields.join(
        cells.select("series_id", "field_id", F.col("status").alias("__ps"), F.col("reasons").alias("__pr")), ["series_id", "field_id"]
    )
    return held.groupBy(*ident).agg(
        F.first("importance").alias("importance"),
        F.max(F.greatest(status_rank("status"), status_rank("__ps"))).alias("__s"),
        F.array_sort(F.collect_list(F.struct("__i", "field_id", "reasons", "__pr"))).alias("__f"),
    ).select(
        *ident,
        F.transform("__f", lambda f: f["field_id"]).alias("field_ids"),
        "importance",
        status_name(F.col("__s")).alias("status"),
        F.array_distinct(F.concat(F.col("__f")[0]["reasons"], F.flatten(F.transform("__f", lambda f: f["__pr"])))).alias("reasons"),
    )


def merge_exact(candidates: DataFrame) -> DataFrame:
    """One item per (series, kind, ordered indices), all its claims kept in order."""
    claim = F.struct("family", "native_id", "event_type", "importance", "status", "field_ids")
    return candidates.groupBy("series_id", "kind", "source_indices").agg(
        F.array_sort(F.collect_list(claim)).alias("claims")
    )


def _item_key(i: Column) -> Column:
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), i["kind"])
    return F.struct(kind.alias("k"), i["source_indices"].alias("s"))


def near_groups(items: DataFrame, period: int, distance: int) -> DataFrame:
    """Complete-link first-fit groups of items by circular distance, in item order.

    The fold runs over one series' short item list; series are independent.
    """
    entry = F.struct("kind", "source_indices")
    lists = items.groupBy("series_id").agg(F.collect_list(entry).alias("l"))
    ordered = F.transform(
        F.array_sort(F.transform("l", lambda i: F.struct(_item_key(i).alias("key"), i.alias("item")))), lambda e: e["item"]
    )
    kind = "array<array<struct<kind:string,source_indices:array<int>>>>"

    def near(a: Column, b: Column) -> Column:
        return (
            F.array_min(
                F.transform(
                    a["source_indices"],
                    lambda x: F.array_min(F.transform(b["source_indices"], lambda y: circular_distance(x, y, period))),
                )
            )
            <= distance
        )

    def place(groups: Column, item: Column) -> Column:
        fits = F.transform(groups, lambda g: F.forall(g, lambda other: near(item, other)))
        at = F.array_position(fits, F.lit(True))
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(item))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.array(item)))).cast(kind)

    folded = lists.select("series_id", F.aggregate(ordered, F.array().cast(kind), place).alias("g"))
    return folded.select("series_id", F.posexplode("g").alias("near_group", "members")).select(
        "series_id", "near_group", F.explode("members").alias("m")
    ).select("series_id", "near_group", "m.kind", "m.source_indices")


def _ranked_by(column: Column, order: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for text, rank in order.items():
        out = F.when(column == text, rank).otherwise(out)
    return out


def _signed(claims: DataFrame, values: DataFrame | None) -> DataFrame:
    """Add `__mean`, the mean profile value of a claim's fields (null without any)."""
    if values is None:
        return claims.withColumn("__mean", F.lit(None).cast("double"))
    rows = claims.where(F.col("event_type").isin(*SIGNED)).select("series_id", "field_ids").distinct()
    rows = rows.select("series_id", "field_ids", F.explode("field_ids").alias("field_id"))
    mean = rows.join(values.select("series_id", "field_id", "value"), ["series_id", "field_id"]).groupBy("series_id", "field_ids").agg(F.avg("value").alias("__mean"))
    return claims.join(mean, ["series_id", "field_ids"], "left")


def claim_roles(items: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Claims as rows with role, preference tier and item sort key.

    Nested steps and directional pairs prefer the event of the sign that the profile's `values` (series_id,
    field_id, value) show: divergent below zero, else coordinated; without a value neither is preferred.
    """
    claims = items.select("series_id", "kind", "source_indices", F.explode("claims").alias("c")).select(
        "series_id", "kind", "source_indices", "c.family", "c.native_id", "c.event_type", "c.importance", "c.status", "c.field_ids"
    )
    claims = _signed(claims, values)
    expected = F.when(F.col("__mean") < 0, SIGNED[1]).when(F.col("__mean").isNotNull(), SIGNED[0])
    signed = F.when(F.col("event_type") == expected, 0).when(F.col("event_type").isin(*SIGNED), 1).otherwise(2)
    role = F.create_map(*[F.lit(x) for pair in ROLE_OF_FAMILY.items() for x in pair])[F.col("family")]
    claims = claims.withColumn("role", role)
    event = F.lit(20)
    for name, order in EVENT_RANK.items():
        default = 10 if name == "dark_persistence" else 20
        event = F.when(F.col("role") == name, _ranked_by(F.col("event_type"), order, default)).otherwise(event)
    event = F.when(F.col("role").isin("nested_step", "directional"), signed).otherwise(event)
    return claims.withColumn(
        "tier",
        F.struct(status_rank("status").alias("s"), _ranked_by(F.col("family"), FAMILY_RANK, 0).alias("f"), event.alias("e")),
    ).withColumn("item_key", _item_key(F.struct("kind", "source_indices")))


def coverage_select(items: DataFrame, minimum: int = 4, maximum: int = 6, values: DataFrame | None = None) -> DataFrame:
    """Coverage-first selection: one best-tier item per role in fixed order, then contrasts.

    A series has a handful of items (one per rule), so its items form one short array that
    is folded over the six roles and then over at most `minimum` contrast rounds. All
    series are independent rows of one aggregate.
    """
    claims = claim_roles(items, values)
    best = claims.groupBy("series_id", "role").agg(F.min("tier").alias("__best"))
    claims = claims.join(best, ["series_id", "role"]).withColumn("__top", F.col("tier") == F.col("__best"))
    by_role = claims.groupBy("series_id", "item_key", "role").agg(
        F.max("__top").alias("covers"),
        (-F.count(F.lit(1))).alias("n"),
        F.min(
            F.struct(
                F.col("tier.f").alias("f"), F.col("tier.e").alias("e"), "native_id", "event_type",
                (-F.coalesce("importance", F.lit(0.0))).alias("i"),
            )
        ).alias("claim"),
        F.max(status_rank("status")).alias("s"),
        F.collect_set(F.struct("family", "native_id", "event_type")).alias("events"),
    )
    wanted = F.create_map(*[F.lit(x) for pair in COMPLEMENT.items() for x in pair])
    per_item = by_role.groupBy("series_id", "item_key").agg(
        F.max("s").alias("s"),
        F.collect_list(F.struct("role", "covers", "n", "claim")).alias("roles"),
        F.flatten(F.collect_list("events")).alias("events"),
    )
    per_item = per_item.select(
        "series_id",
        F.struct(
            F.col("item_key").alias("key"),
            F.col("s"),
            F.col("roles"),
            F.transform(F.filter("roles", lambda r: r["covers"]), lambda r: r["role"]).alias("covers"),
            F.col("events"),
            F.transform(
                F.filter("events", lambda e: F.map_contains_key(wanted, e["event_type"])),
                lambda e: F.struct(e["family"].alias("family"), e["native_id"].alias("native_id"), wanted[e["event_type"]].alias("event_type")),
            ).alias("partners"),
        ).alias("item"),
    )
    lists = per_item.groupBy("series_id").agg(F.collect_list("item").alias("items"))
    item_type = lists.schema["items"].dataType.elementType
    chosen_type = f"array<struct<selected_for:string,item:{item_type.simpleString()}>>"
    taken = lambda acc, i: F.exists(acc, lambda c: c["item"]["key"] == i["key"])

    def cover(acc: Column, role: Column) -> Column:
        open_items = F.filter(
            F.col("items"), lambda i: F.array_contains(i["covers"], role) & ~taken(acc, i)
        )
        ranked = F.transform(
            open_items,
            lambda i: F.struct(
                i["s"].alias("s"),
                F.filter(i["roles"], lambda r: r["role"] == role)[0]["n"].alias("n"),
                F.filter(i["roles"], lambda r: r["role"] == role)[0]["claim"].alias("claim"),
                i["key"].alias("key"),
                i.alias("item"),
            ),
        )
        done = F.exists(acc, lambda c: F.array_contains(c["item"]["covers"], role)) | (F.size(acc) >= maximum)
        pick = F.struct(role.alias("selected_for"), F.array_min(ranked)["item"].alias("item"))
        return F.when(done | (F.size(open_items) == 0), acc).otherwise(F.concat(acc, F.array(pick))).cast(chosen_type)

    def contrast(acc: Column, _round: Column) -> Column:
        have = F.flatten(F.transform(acc, lambda c: c["item"]["events"]))
        open_items = F.filter(F.col("items"), lambda i: ~taken(acc, i) & F.arrays_overlap(i["partners"], have))
        ranked = F.transform(open_items, lambda i: F.struct(i["s"].alias("s"), i["key"].alias("key"), i.alias("item")))
        pick = F.struct(F.lit("contrast_fill").alias("selected_for"), F.array_min(ranked)["item"].alias("item"))
        full = F.size(acc) >= min(minimum, maximum)
        return F.when(full | (F.size(open_items) == 0), acc).otherwise(F.concat(acc, F.array(pick))).cast(chosen_type)

    roles = F.array(*[F.lit(r) for r in COVERAGE_ORDER])
    covered = lists.withColumn("chosen", F.aggregate(roles, F.array().cast(chosen_type), cover))
    filled = covered.withColumn("chosen", F.aggregate(F.sequence(F.lit(1), F.lit(minimum)), F.col("chosen"), contrast))
    return filled.select("series_id", F.posexplode("chosen").alias("i", "c")).select(
        "series_id",
        (F.col("i") + 1).alias("rank"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("c.item.key.k").cast("int")).alias("kind"),
        F.col("c.item.key.s").alias("source_indices"),
        F.col("c.selected_for").alias("selected_for"),
    )


def inventory(candidates: DataFrame, items: DataFrame, groups: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts per series, and which available roles the selection covers."""
    role = F.create_map(*[F.lit(x) for pair in ROLE_OF_FAMILY.items() for x in pair])
    order = F.array(*[F.lit(r) for r in COVERAGE_ORDER])
    n = candidates.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.collect_set(role[F.col("family")]).alias("__available")
    )
    m = items.groupBy("series_id").agg(F.count(F.lit(1)).alias("exact_items"))
    g = groups.groupBy("series_id").agg((F.max("near_group") + 1).alias("near_groups"))
    covers = selected.join(claim_roles(items).select("series_id", "kind", "source_indices", "role").distinct(), ["series_id", "kind", "source_indices"])
    c = covers.groupBy("series_id").agg(F.collect_set("role").alias("__covered"))
    out = n.join(m, "series_id").join(g, "series_id").join(c, "series_id", "left")
    inside = lambda have: F.filter(order, lambda r: F.array_contains(have, r))
    covered = F.coalesce("__covered", F.array().cast("array<string>"))
    return out.select(
        "series_id", "candidates", "exact_items", "near_groups",
        F.array_join(inside(F.col("__available")), "|").alias("available"),
        F.array_join(inside(covered), "|").alias("covered"),
        F.array_join(inside(F.array_except("__available", covered)), "|").alias("uncovered"),
    )


def packet(selected: DataFrame, frames: DataFrame, index: str, ref: str) -> DataFrame:
    """Selected items with their original frame refs; long runs show first, middle, last.

    An index without a frame gives status 'missing_frame' instead of a silent drop.
    """
    idx = F.col("source_indices")
    shown = F.when(
        (F.col("kind") == "run") & (F.size(idx) > 3),
        F.array(idx[0], F.element_at(idx, (F.floor(F.size(idx) / 2) + 1).cast("int")), F.element_at(idx, -1)),
    ).otherwise(idx)
    rows = selected.select("series_id", "rank", "kind", shown.alias("shown"), F.posexplode("source_indices").alias("i", index))
    refs = rows.join(frames.select("series_id", index, ref), ["series_id", index], "left")
    return refs.groupBy("series_id", "rank", "kind").agg(
        F.array_join(F.first("shown"), ",").alias("render_indices"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", ref))), lambda r: r[ref]), ",").alias("frame_refs"),
        F.when(F.count(ref) < F.count(F.lit(1)), "missing_frame").otherwise("ok").alias("status"),
    )


def filter_by_disposition(traces: DataFrame, rules: list[tuple[Column, str, str]], default: tuple[str, str]) -> DataFrame:
    """Tag each trace with the first matching (disposition, role) and drop the rejected ones."""
    disposition, role = F.lit(default[0]), F.lit(default[1])
    for condition, d, r in reversed(rules):
        disposition = F.when(condition, d).otherwise(disposition)
        role = F.when(condition, r).otherwise(role)
    return traces.withColumn("disposition", disposition).withColumn("role", role).where(F.col("disposition") != "REJECT")
