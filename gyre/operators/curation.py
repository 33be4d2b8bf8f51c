"""Flag changes guarded by a digest of the whole state, and that digest as a hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 4  # hexadecimal digits of a leaf's name: a fan-out of 16 on each level


def _hash(*columns: str) -> Column:
    """Hash of named values; names and quoting keep different rows apart."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ""), 256)


def leaf_of(ident: list[str], depth: int = DEPTH) -> Column:
    return F.substring(_hash(*ident), 1, depth)


def state_leaves(state: DataFrame, ident: list[str], content: list[str], depth: int = DEPTH) -> DataFrame:
    """(leaf, digest, rows): rows go to a leaf by the hash of their identity, and a leaf hashes its
    rows in the order of their hashes. A leaf holds 1 in 16 ** depth of all rows."""
    rows = state.select(leaf_of(ident, depth).alias("leaf"), _hash(*content).alias("h"))
    return rows.groupBy("leaf").agg(_joined(F.col("h")).alias("digest"), F.count(F.lit(1)).alias("rows"))


def digest_of_leaves(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row (digest, rows): every level hashes its at most 16 children with their names."""
    nodes = leaves
    part = F.concat("leaf", "digest")
    for level in range(depth - 1, 0, -1):
        nodes = nodes.groupBy(F.substring("leaf", 1, level).alias("up")).agg(_joined(part).alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("up", "leaf")
    return nodes.agg(_joined(part).alias("digest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def state_digest(state: DataFrame, ident: list[str], content: list[str], depth: int = DEPTH) -> DataFrame:
    """One digest of a whole state, the same for any order and partitioning of its rows."""
    return digest_of_leaves(state_leaves(state, ident, content, depth), depth)


def updated_leaves(leaves: DataFrame, state: DataFrame, changed: DataFrame, ident: list[str], content: list[str], depth: int = DEPTH) -> DataFrame:
    """Leaves of the new `state`, where only rows whose identity is in `changed` differ from the
    old one: other leaves are taken over."""
    touched = changed.select(leaf_of(ident, depth).alias("leaf")).distinct()
    fresh = state_leaves(state.join(touched, leaf_of(ident, depth) == F.col("leaf"), "left_semi"), ident, content, depth)
    return leaves.join(touched, "leaf", "left_anti").unionByName(fresh)


def request_outcomes(state: DataFrame, changes: DataFrame, known: DataFrame, digest: DataFrame) -> DataFrame:
    """What becomes of each request: (request, outcome).

    `state` holds the true flags (id, field, value), `known` the ids of the catalogue, `digest` one row
    with the state's digest; `changes` are (request, baseline, id, field, before, after). A request is all
    or nothing: invalid (a change of nothing, or a flag named twice), unknown_id, conflict (a current value that is
    neither before nor after), no_change (applied before, whatever its baseline), stale_baseline (the
    state is not the one it was made for), or applied. Requests act in their order, so of those that
    were made for the current state only the first applies; without a baseline a request is not guarded.
    """
    current = F.coalesce("value", F.lit(False))
    at = changes.join(state.select("id", "field", "value"), ["id", "field"], "left").join(known.select("id", F.lit(True).alias("__known")).distinct(), "id", "left")
    seen = at.groupBy("request").agg(
        F.max("baseline").alias("baseline"),
        (F.bool_or(F.col("before") == F.col("after")) | (F.count(F.lit(1)) > F.count_distinct("id", "field"))).alias("invalid"),
        F.bool_or(F.col("__known").isNull()).alias("unknown"),
        F.bool_or((current != F.col("before")) & (current != F.col("after"))).alias("conflict"),
        F.bool_and(current == F.col("after")).alias("done"),
    )
    outcome = (
        F.when(F.col("invalid"), "invalid")
        .when(F.col("unknown"), "unknown_id")
        .when(F.col("conflict"), "conflict")
        .when(F.col("done"), "no_change")
        .when(F.col("baseline") != digest.select("digest").scalar(), "stale_baseline")
        .otherwise("applied")
    )
    seen = seen.select("request", "baseline", outcome.alias("outcome"))
    first = seen.where("outcome = 'applied'").agg(F.min("request")).scalar()
    late = (F.col("outcome") == "applied") & F.col("baseline").isNotNull() & (F.col("request") > first)
    return seen.select("request", F.when(late, "stale_baseline").otherwise(F.col("outcome")).alias("outcome"))


def apply_changes(state: DataFrame, changes: DataFrame, known: DataFrame, digest: DataFrame) -> DataFrame:
    """The state after all applied requests; of several unguarded ones on a flag the last counts. Only true flags are kept."""
    outcomes = request_outcomes(state, changes, known, digest).where("outcome = 'applied'").select("request")
    applied = changes.join(outcomes, "request", "left_semi").groupBy("id", "field").agg(F.max(F.struct("request", "after"))["after"].alias("after"))
    both = state.select("id", "field", "value").join(applied, ["id", "field"], "full")
    return both.select("id", "field", F.coalesce("after", "value").alias("value")).where("value")
