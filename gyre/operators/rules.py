"""Rules over nested records: a table of named conditions, compiled to one projection for each table.

A rule is a name and a condition that must hold; null counts as broken. Rules that need another
table are joins beside the projection. Every broken rule of a row is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.operators.catalogue import object_key

# Closed vocabularies, limits and patterns of the records.
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
CARAT = r"^(0|[1-9][0-9]*)(\.[0-9]+)?\z"
DIGEST = r"^[a-f0-9]{64}\z"
IDENTITY_STATUSES = ("unverified", "reported", "linked")
MEDIA_KINDS = ("viewer", "still", "video")
EVIDENCE_KINDS = ("certificate", "still", "rotation", "video")
EVIDENCE_STATUSES = ("success", "extraction_failed")
ATTEMPT_STATUSES = (
    "success", "unsupported", "missing", "download_failed", "processing_failed", "extraction_failed",
    "invalid_payload", "resolution_failed", "resolution_limit", "resolved", "duplicate", "not_requested",
)
ROTATION_FRAMES = 256
MOST_ATTEMPTS = 3000


def broken(df: DataFrame, ident: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(ident, rule): one row for every rule that a row of `df` breaks."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return df.select(ident, F.explode(names).alias("rule"))


def text_ok(c: Column, limit: int) -> Column:
    """Some visible character, not too long, no control characters but tab and line feed."""
    return c.rlike(r"\S") & (F.length(c) <= limit) & ~c.rlike(r"[\x00-\x08\x0B-\x1F]")


def absent_or(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def url_ok(c: Column) -> Column:
    """A public https address: a named host with a dot, no user, no other port, no number as host."""
    place = F.regexp_extract(c, r"^https://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(place, r":(443)?$", ""))
    named = host.rlike(r"^[^.:\[\]@][^:\[\]@]*\.[^:\[\]@]*$") & ~host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return text_ok(c, 2048) & ~c.rlike(r"[\s\x7F]") & c.startswith("https://") & named & ~host.rlike(r"(^localhost|\.local|\.internal)$")


def unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def every(a: Column, ok) -> Column:
    return F.forall(a, lambda x: F.coalesce(ok(x), F.lit(False)))


def items(a: Column) -> Column:
    return F.coalesce(a, F.array())


def reference_rules(schema: str) -> list[tuple[str, Column]]:
    """Rules of one reference record: schema, id, file_id, label, commentary, identity (status, lab, report_number),
    linked_id, metadata (shape, colour, clarity, origin, carat, dimensions), source_links (kind, url, note),
    media_sources (kind, url, provider, status), topics, evidence (kind, status, record_key, asset, frames (source_index, asset)),
    attempts (reference, kind, status, locator). An asset is a struct of sha256, byte_count and url."""
    c = F.col
    status, lab, report = c("identity.status"), c("identity.lab"), c("identity.report_number")
    key = object_key(lab, report)[2]
    meta = lambda name: c(f"metadata.{name}")
    links, media, evidence, attempts = items(c("source_links")), items(c("media_sources")), items(c("evidence")), items(c("attempts"))
    stored = lambda a: a["sha256"].rlike(DIGEST) & (a["byte_count"] > 0) & absent_or(a["url"], url_ok(a["url"]))
    rotation = lambda e: e["kind"] == "rotation"
    indices = lambda e: F.array_sort(F.transform(items(e["frames"]), lambda f: f["source_index"]))
    whole = F.sequence(F.lit(0), F.lit(ROTATION_FRAMES - 1))
    pairs = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["url"].alias("url")))
    return [
        ("schema", c("schema") == schema),
        ("id", text_ok(c("id"), 96) & c("id").rlike(SLUG) & ~c("id").startswith("ref-")),
        ("file_id", absent_or(c("file_id"), c("file_id") == c("id"))),
        ("label", text_ok(c("label"), 180)),
        ("commentary", text_ok(c("commentary"), 8000)),
        ("identity_status", status.isin(*IDENTITY_STATUSES)),
        ("identity_lab", absent_or(lab, text_ok(lab, 100))),
        ("identity_report", absent_or(report, text_ok(report, 100))),
        ("certificate_complete", report.isNull() | (lab.isNotNull() & (status != "unverified"))),
        ("certificate_missing", report.isNotNull() | (status == "unverified")),
        ("link_identity", absent_or(c("linked_id"), (status == "linked") & (c("linked_id") == key))),
        ("link_missing", (status != "linked") | c("linked_id").isNotNull()),
        ("metadata_text", F.forall(F.array(*[meta(n) for n in ("shape", "colour", "clarity", "origin")]), lambda x: absent_or(x, text_ok(x, 90)))),
        ("carat", absent_or(meta("carat"), meta("carat").rlike(CARAT) & (meta("carat").try_cast("double") > 0))),
        ("dimensions", absent_or(meta("dimensions"), (F.size(meta("dimensions")) >= 2) & every(meta("dimensions"), lambda x: (x > 0) & (x < 100)))),
        ("source_links", F.size(links) > 0),
        ("link_kind", every(F.concat(links["kind"], media["kind"]), lambda x: text_ok(x, 60))),
        ("link_url", every(F.concat(links["url"], media["url"]), url_ok)),
        ("link_repeated", unique(pairs(links)) & unique(pairs(media))),
        ("link_note", F.forall(links, lambda x: absent_or(x["note"], text_ok(x["note"], 500)))),
        ("media_kind", every(media, lambda x: x["kind"].isin(*MEDIA_KINDS))),
        ("media_provider", every(media, lambda x: text_ok(x["provider"], 80))),
        ("media_status", every(media, lambda x: x["status"] == "linked_unverified")),
        ("topics_repeated", unique(items(c("topics")))),
        ("topic", every(items(c("topics")), lambda x: (F.length(x) <= 70) & x.rlike(SLUG))),
        ("evidence_kind", every(evidence, lambda e: e["kind"].isin(*EVIDENCE_KINDS) & e["status"].isin(*EVIDENCE_STATUSES))),
        ("evidence_key", every(evidence, lambda e: e["record_key"].rlike(DIGEST))),
        ("rotation_frames", every(evidence, lambda e: ~rotation(e) | ((e["status"] == "success") & (indices(e) == whole)))),
        ("rotation_bundle", every(evidence, lambda e: ~rotation(e) | e["asset"].isNull())),
        ("rotation_assets", every(evidence, lambda e: ~rotation(e) | every(items(e["frames"]), lambda f: stored(f["asset"])))),
        ("stored_asset", every(evidence, lambda e: rotation(e) | stored(e["asset"]))),
        ("attempt_count", F.size(attempts) <= MOST_ATTEMPTS),
        ("attempt_reference", every(attempts, lambda a: text_ok(a["reference"], 180))),
        ("attempt_kind", every(attempts, lambda a: a["kind"].isin(*EVIDENCE_KINDS))),
        ("attempt_status", every(attempts, lambda a: a["status"].isin(*ATTEMPT_STATUSES))),
        ("attempt_locator", F.forall(attempts, lambda a: absent_or(a["locator"], text_ok(a["locator"], 2048)))),
    ]


def broken_references(refs: DataFrame, certified: DataFrame, schema: str) -> DataFrame:
    """(id, rule) of all broken rules, with those across tables: ids are unique, and a linked object exists in
    `certified` (id, lab, report_number) under the same identity."""
    inside = broken(refs, "id", reference_rules(schema))
    repeated = refs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("id_repeated").alias("rule"))
    named = refs.where("linked_id is not null").select("id", "linked_id", F.struct(*object_key(F.col("identity.lab"), F.col("identity.report_number"))).alias("key"))
    there = certified.select(F.col("id").alias("linked_id"), F.struct(*object_key(F.col("lab"), F.col("report_number"))).alias("key"))
    lost = named.join(there, ["linked_id", "key"], "left_anti").select("id", F.lit("link_target").alias("rule"))
    return inside.unionByName(repeated).unionByName(lost)


def observation_rules(vocabulary: dict[str, tuple[str, ...]]) -> list[tuple[str, Column]]:
    """Rules of one observation: id, family, role, explanation, summary, frames, links (field_id, assessment, rationale);
    `vocabulary` has the allowed family, role, explanation, field_id and assessment values."""
    c = F.col
    links, frames = items(c("links")), items(c("frames"))
    told = c("explanation").isin("explained", "partial")
    return [
        ("id", F.length("id") > 0),
        ("family", c("family").isin(*vocabulary["family"])),
        ("role", c("role").isin(*vocabulary["role"])),
        ("explanation", c("explanation").isin(*vocabulary["explanation"])),
        ("summary", c("summary").rlike(r"\S")),
        ("frames", unique(frames) & every(frames, lambda x: x >= 0)),
        ("unexplained_links", (c("explanation") != "unexplained") | (F.size(links) == 0)),
        ("explained_links", ~told | (F.size(links) > 0)),
        ("link_field", every(links, lambda x: x["field_id"].isin(*vocabulary["field_id"]))),
        ("link_repeated", unique(F.transform(links, lambda x: x["field_id"]))),
        ("link_assessment", every(links, lambda x: x["assessment"].isin(*vocabulary["assessment"]))),
        ("link_rationale", every(links, lambda x: x["rationale"].rlike(r"\S"))),
    ]


def broken_observations(obs: DataFrame, reviews: DataFrame, known: DataFrame, concepts: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """(subject, rule) of all broken rules of observations and reviews, with those across tables.

    Ids are unique, objects (series_id) are `known`, concepts are listed; every known object has one review
    (series_id, evaluation_path, outcome), with a path and an outcome, and no other object has one.
    """
    text = F.col("id").cast("string").alias("subject")
    inside = broken(obs.withColumn("id", F.col("id").cast("string")), "id", observation_rules(vocabulary)).select(text, "rule")
    repeated = obs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(text, F.lit("id_repeated").alias("rule"))
    stranger = obs.join(known.select("series_id").distinct(), "series_id", "left_anti").select(text, F.lit("unknown_object").alias("rule"))
    concept = obs.join(concepts.select("concept").distinct(), "concept", "left_anti").select(text, F.lit("unknown_concept").alias("rule"))
    series = F.col("series_id").cast("string").alias("subject")
    per = reviews.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    cover = known.select("series_id").distinct().withColumn("there", F.lit(True)).join(per, "series_id", "full")
    covered = broken(
        cover.withColumn("subject", series),
        "subject",
        [("review_of_unknown_object", F.col("there")), ("review_missing", F.col("n").isNotNull()), ("review_repeated", F.coalesce("n", F.lit(1)) == 1)],
    )
    review = broken(
        reviews.withColumn("subject", series), "subject", [("review_path", F.length("evaluation_path") > 0), ("review_outcome", F.col("outcome").rlike(r"\S"))]
    )
    parts = [inside, repeated, stranger, concept, covered, review]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
