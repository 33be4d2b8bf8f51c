"""Catalogue jobs: identity, comparison, merge, index, search, curation and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.arrays import let
from gyre.functions.guards import all_of, any_of

# Alias tables, grade orders, closed vocabularies and text patterns.
LAB_ALIASES = {"INTERNATIONAL GEMOLOGICAL INSTITUTE": "IGI", "GEMOLOGICAL INSTITUTE OF AMERICA": "GIA"}
ORIGINS = {
    "LAB GROWN": "LAB-GROWN",
    "LABORATORY GROWN": "LAB-GROWN",
    "LAB CREATED": "LAB-GROWN",
    "LABORATORY CREATED": "LAB-GROWN",
    "NATURAL": "NATURAL",
    "NATURAL DIAMOND": "NATURAL",
    "MINED": "NATURAL",
    "EARTH MINED": "NATURAL",
}
SHAPES = {
    "ROUND": "ROUND",
    "ROUND BRILLIANT": "ROUND",
    "ROUND BRILLIANT CUT": "ROUND",
    "OVAL": "OVAL",
    "OVAL BRILLIANT": "OVAL",
    "OVAL MODIFIED BRILLIANT": "OVAL",
    "EMERALD": "EMERALD",
    "EMERALD CUT": "EMERALD",
    "ASSCHER": "ASSCHER",
    "ASSCHER CUT": "ASSCHER",
    "CUSHION": "CUSHION",
    "CUSHION BRILLIANT": "CUSHION",
    "CUSHION MODIFIED BRILLIANT": "CUSHION",
    "PEAR": "PEAR",
    "PEAR BRILLIANT": "PEAR",
    "PRINCESS": "PRINCESS",
    "PRINCESS CUT": "PRINCESS",
    "RADIANT": "RADIANT",
    "RADIANT CUT": "RADIANT",
    "MARQUISE": "MARQUISE",
    "MARQUISE BRILLIANT": "MARQUISE",
    "HEART": "HEART",
    "HEART BRILLIANT": "HEART",
}
COLOUR_GRADES = tuple("DEFGHIJKLMNOPQRSTUVWXYZ")
CLARITY_GRADES = ("FL", "IF", "VVS1", "VVS2", "VS1", "VS2", "SI1", "SI2", "I1", "I2", "I3")
REPORT_PATTERN = r"(?i)(?:REPORT\s+(?:NUMBER|NO\.?|#)|REPORT\s*#)\s*:?[ ]*([A-Z]{0,3}\d{6,})"
MEASURE_PATTERN = r"(?i)MEASUREMENTS\s*:?[ ]*([0-9.]+)\s*(?:mm)?\s*[xX×-]\s*([0-9.]+)\s*(?:mm)?\s*[xX×-]\s*([0-9.]+)"
CARAT_PATTERN = r"(?i)CARAT\s+WEIGHT\s*:?[ ]*([0-9.]+)"
COLOUR_PATTERN = r"(?i)COL(?:O|OU)R\s+GRADE\s*:?[ ]*([A-Z]+)"
CLARITY_PATTERN = r"(?i)CLARITY\s+GRADE\s*:?[ ]*(FL|IF|VVS1|VVS2|VS1|VS2|SI1|SI2|I1|I2|I3)"
SHAPE_PATTERN = r"(?im)^[ \t]*SHAPE(?:[ \t]+AND[ \t]+(?:CUTTING[ \t]+STYLE|CUT))?[ \t]*:?[ \t]*(?:\r?\n\s*)?([^\r\n]*)$"
# On text in lower case; a pattern begins with its plain label, so that the search jumps from label to label.
TABLE_PATTERN = r"table(?<=\btable)\s*%?\s*:?\s*([0-9]+(?:\.[0-9]+)?)\s*%"
DEPTH_PATTERN = r"depth(?<=\bdepth)\s*%?\s*:?\s*([0-9]+(?:\.[0-9]+)?)\s*%"
RATIO_PATTERN = r"ratio(?<=\bratio)\s*:?\s*([0-9]+(?:\.[0-9]+)?)\b"  # L/W Ratio, too
# Words and abbreviations of a grade, of fluorescence, of the girdle and of the culet.
GRADES = {
    "ideal": "Ideal",
    "id": "Ideal",
    "excellent": "Excellent",
    "ex": "Excellent",
    "very good": "Very Good",
    "vg": "Very Good",
    "good": "Good",
    "gd": "Good",
    "g": "Good",
    "fair": "Fair",
    "f": "Fair",
    "poor": "Poor",
    "pr": "Poor",
    "p": "Poor",
}
FLUORESCENCE = {
    "none": "None",
    "nil": "None",
    "non": "None",
    "no": "None",
    "faint": "Faint",
    "very slight": "Very Slight",
    "slight": "Slight",
    "medium": "Medium",
    "med": "Medium",
    "strong": "Strong",
    "very strong": "Very Strong",
    "vs": "Very Strong",
    "negligible": "Negligible",
}
GIRDLE = ("extremely thin", "very thin", "slightly thin", "thin", "medium", "slightly thick", "thick", "very thick", "extremely thick")
CULET = ("none", "pointed", "very small", "small", "medium", "slightly large", "large", "very large")
EXCERPT = 180
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CERT_FIELDS = ("shape", "origin", "colour", "clarity", "carat")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.upper(c)), r"\s+", " ")


def object_key(lab: Column, report: Column) -> tuple[Column, Column, Column]:
    """Canonical lab, report and `lab-report` id; null where the pair is unusable."""
    name = F.coalesce(lookup(LAB_ALIASES, squeezed(lab)), squeezed(lab))
    number = F.regexp_replace(F.upper(report), r"[\s-]", "")
    ok = name.rlike("^[A-Z0-9]+$") & number.rlike("^[A-Z0-9]+$") & number.rlike("[0-9]")
    return F.when(ok, name), F.when(ok, number), F.when(ok, F.lower(F.concat_ws("-", name, number)))


def canonical(value: Column) -> Column:
    """Plain decimals without leading and trailing zeros, of any length; other text trimmed upper-case."""
    text = F.trim(value.cast("string"))
    digits = F.regexp_replace(text, "^[+-]?0*", "")
    digits = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)
    digits = F.when(digits == "", "0").when(digits.startswith("."), F.concat(F.lit("0"), digits)).otherwise(digits)
    signed = F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), signed).otherwise(F.upper(text))


def normalise_field(field: Column, value: Column) -> Column:
    """Canonical text of an identity value under its field's narrow equivalences."""
    shape = squeezed(F.translate(value, "-", " "))
    origin = F.trim(F.regexp_replace(F.upper(value), r"[^A-Z]+", " "))
    sizes = F.regexp_extract_all(value, F.lit(r"([0-9]+\.?[0-9]*|\.[0-9]+)"), F.lit(1))
    dimensions = F.when(F.size(sizes) > 0, F.array_join(F.transform(sizes, canonical), " x ")).otherwise(F.upper(F.trim(value)))
    return (
        F.when(field == "report_number", F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""))
        .when(field == "lab", F.coalesce(lookup(LAB_ALIASES, squeezed(value)), squeezed(value)))
        .when(field == "origin", F.coalesce(lookup(ORIGINS, origin), origin))
        .when(field == "shape", F.coalesce(lookup(SHAPES, shape), shape))
        .when(field == "carat", canonical(value))
        .when(field == "dimensions", dimensions)
        .otherwise(F.upper(F.trim(value)))
    )


def identity_compare(obs: DataFrame, keys: list[str], field: str, side: str, value: str) -> DataFrame:
    """Per field: conflict on more than one normalised value, agreement if both sides, else missing.

    Counting distinct values needs no list: minimum and maximum differ exactly when there
    is more than one.
    """
    rows = obs.where(F.col(value).isNotNull()).withColumn("__v", normalise_field(F.col(field), F.col(value)))
    out = rows.groupBy(*keys, field).agg(
        (F.min("__v") != F.max("__v")).alias("__x"),
        F.bool_or(F.col(side) == "listing").alias("__l"),
        F.bool_or(F.col(side) == "evidence").alias("__e"),
        F.count(F.lit(1)).alias("observations"),
    )
    outcome = F.when(F.col("__x"), "conflict").when(F.col("__l") & F.col("__e"), "agreement").otherwise("missing")
    return out.select(*keys, field, "observations", outcome.alias("outcome"))


def completion(evidence: DataFrame, attempts: DataFrame, outcomes: DataFrame, listings: DataFrame, key: str, failures: list[str]) -> DataFrame:
    """Complete or partial, with reasons in their fixed order, for every object of any table.

    `outcomes` (key, field, outcome, on_certificate) is one row per compared field; `listings`
    (key, lab) tells whether a listing names a lab, without which none has to match.
    """
    success = F.col("status") == "success"
    have = evidence.groupBy(key).agg(
        F.bool_or((F.col("kind") == "certificate") & success).alias("cert"),
        F.bool_or(F.col("kind").isin("rotation", "video") & success).alias("motion"),
    )
    failed = attempts.groupBy(key).agg(F.bool_or(F.col("status").isin(*failures)).alias("failed"))
    agreed = lambda f: F.bool_or((F.col("field") == f) & (F.col("outcome") == "agreement") & F.col("on_certificate"))
    ids = outcomes.groupBy(key).agg(agreed("report_number").alias("report_ok"), agreed("lab").alias("lab_ok"))
    labs = listings.groupBy(key).agg(F.count("lab").alias("labs"))
    every = have.select(key).union(failed.select(key)).union(ids.select(key)).union(labs.select(key)).distinct()
    rows = every.join(have, key, "left").join(failed, key, "left").join(ids, key, "left").join(labs, key, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(no("cert"), "missing successful certificate evidence"),
            F.when(~no("cert") & no("report_ok"), "certificate report number was not parsed and matched"),
            F.when(~no("cert") & no("lab_ok") & (F.coalesce("labs", F.lit(0)) > 0), "certificate lab identity was not parsed and matched"),
            F.when(no("motion"), "missing successful motion evidence"),
            F.when(F.coalesce("failed", F.lit(False)), "one or more requested evidence assets failed"),
        )
    )
    return rows.select(key, (F.size(reasons) == 0).alias("complete"), F.array_join(reasons, "|").alias("reasons"))


def equivalent(a: Column, b: Column) -> Column:
    """Equal as decimals where both read as numbers, else as trimmed upper-case text."""
    return canonical(a) == canonical(b)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fill null fields from the incoming row, keep older values, reject conflicting rows.

    Returns (merged, rejected): a rejected key keeps its existing row untouched.
    """
    a = existing.select(key, *[F.col(f).alias(f"__o_{f}") for f in fields], F.lit(True).alias("__have"))
    b = incoming.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields])
    both = a.join(b, key, "full")
    clash = [F.coalesce(~equivalent(F.col(f"__o_{f}"), F.col(f"__n_{f}")), F.lit(False)) for f in fields]
    names = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in zip(clash, fields)])), "|")
    both = both.withColumn("__c", names)
    bad = F.col("__c") != ""
    merged = both.select(
        key,
        *[F.when(bad, F.col(f"__o_{f}")).otherwise(F.coalesce(f"__o_{f}", f"__n_{f}")).alias(f) for f in fields],
        F.when(bad, "kept").when(F.col("__have").isNull(), "inserted").otherwise("merged").alias("action"),
    )
    return merged, both.where(bad).select(key, F.col("__c").alias("conflicts"))


def merge_map(old: Column, new: Column) -> tuple[Column, Column]:
    """(merged map with missing keys added, keys on which both disagree)."""
    joint = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(a, b))
    clash = F.map_keys(
        F.map_filter(
            F.map_zip_with(old, new, lambda k, a, b: F.coalesce(~equivalent(a, b), F.lit(False))), lambda k, v: v
        )
    )
    return F.coalesce(joint, old, new), F.coalesce(clash, F.array().cast("array<string>"))


def unique_children(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """One row per logical key; a key with different contents is flagged as a conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return (
        df.withColumn("__d", digest)
        .groupBy(*key)
        .agg(
            F.min(F.struct("__d", *content)).alias("__r"),
            (F.min("__d") != F.max("__d")).alias("conflict"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(*key, *[F.col(f"__r.{c}").alias(c) for c in content], "conflict", "copies")
    )


def catalogue_index(listings: DataFrame, retrievals: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Latest listing and retrieval status, motion flag and the first still else rotation."""
    latest = listings.groupBy(key).agg(F.max(F.struct("observed_at", "url", "price")).alias("l"))
    state = retrievals.groupBy(key).agg(F.max(F.struct("retrieved_at", "listing_url", "status")).alias("r"))
    ok = (F.col("status") == "success") & F.col("asset_url").isNotNull()
    tier = F.when(F.col("kind") == "still", 0).when(F.col("kind") == "rotation", 1)
    media = evidence.groupBy(key).agg(
        F.bool_or(ok & F.col("kind").isin("rotation", "video")).alias("has_motion"),
        F.min(F.when(ok & tier.isNotNull(), F.struct(tier.alias("t"), "ordinal", "asset_url"))).alias("m"),
    )
    return latest.join(state, key, "full").join(media, key, "left").select(
        key,
        F.col("l.url").alias("source_url"),
        F.col("l.price").alias("price"),
        F.coalesce("r.status", F.lit("unknown")).alias("retrieval_status"),
        F.coalesce("has_motion", F.lit(False)).alias("has_motion"),
        F.col("m.asset_url").alias("thumbnail_url"),
    )


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids occurring more than once (an empty result is valid)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def grade_order(value: Column, grades: tuple[str, ...]) -> Column:
    pos = F.array_position(F.array(*[F.lit(g) for g in grades]), F.upper(F.trim(F.coalesce(value, F.lit("")))))
    return F.when(pos > 0, pos - 1).otherwise(len(grades))


def search_rows(index: DataFrame, text: str, fields: list[str], status: str = "all") -> DataFrame:
    """Rows containing the text in any field (case-blind), of one status or all."""
    needle = text.lower()
    hit = any_of([F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(needle) for f in fields])
    rows = index.where(hit)
    return rows if status == "all" else rows.where(F.col("retrieval_status") == status)


def sort_keys(sort: str) -> list[Column]:
    """Order of a view; unknown grades and missing numbers last, ties by id."""
    by = {
        "carat": [F.col("carat").asc_nulls_last()],
        "price": [F.col("currency"), F.col("price").asc_nulls_last()],
        "colour": [grade_order(F.col("colour"), COLOUR_GRADES)],
        "clarity": [grade_order(F.col("clarity"), CLARITY_GRADES)],
        "report": [F.col("report_number")],
    }
    return [*by[sort], F.col("id")]


def curation_view(rows: DataFrame, published: DataFrame, draft: DataFrame, show_archived: bool = False, starred_only: bool = False) -> DataFrame:
    """Draft flags over published ones; archived rows hidden unless asked for."""
    p = published.select("id", F.col("starred").alias("__ps"), F.col("archived").alias("__pa"))
    d = draft.select("id", F.col("starred").alias("__ds"), F.col("archived").alias("__da"))
    out = rows.join(p, "id", "left").join(d, "id", "left").select(
        *rows.columns,
        F.coalesce("__ds", "__ps", F.lit(False)).alias("starred"),
        F.coalesce("__da", "__pa", F.lit(False)).alias("archived"),
    )
    if not show_archived:
        out = out.where(~F.col("archived"))
    return out.where("starred") if starred_only else out


# The rows of a comparison in their order, and the signs of currencies written before the amount.
COMPARED = (
    ("carat", "Carat"), ("colour", "Colour"), ("clarity", "Clarity"), ("shape", "Shape"), ("origin", "Origin"), ("dimensions", "Dimensions (mm)"),
    ("depth", "Reported depth"), ("table", "Reported table"), ("ratio", "L/W ratio"), ("polish", "Polish"), ("symmetry", "Symmetry"),
    ("fluorescence", "Fluorescence"), ("price", "Observed price"), ("tax", "Tax basis"), ("retrieval", "Retrieval status"), ("motion", "Motion evidence"),
)
SIGNS = {"GBP": "\u00a3", "EUR": "\u20ac", "USD": "US$"}
UNKNOWN = "Unknown"


def shown(value: Column, suffix: str = "") -> Column:
    """Text of a value with its unit; Unknown where there is none."""
    text = value.cast("string")
    return F.when(F.trim(text) != "", F.concat(text, F.lit(suffix))).otherwise(UNKNOWN)


def price_text(price: Column, currency: Column) -> Column:
    """An amount with two decimals and its currency, in groups of thousands where the currency has a sign."""
    code = F.upper(F.coalesce(currency, F.lit("")))
    plain = F.regexp_replace(F.format_number(price, 2), ",", "")
    sign = lookup(SIGNS, code)
    named = F.when(code == "", F.concat(plain, F.lit(" (currency unknown)"))).otherwise(F.concat_ws(" ", plain, code))
    return F.when(price.isNull(), "Price unavailable").when(sign.isNotNull(), F.concat(sign, F.format_number(price, 2))).otherwise(named)


def latest(df: DataFrame, key: str, at: str, *fields: str) -> DataFrame:
    """The fields of every key's latest row; of rows of one time the one with the largest fields."""
    last = F.max(F.struct(F.col(at).alias("__at"), *fields)).alias("__l")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"__l.{f}").alias(f) for f in fields])


def motion_text(evidence: DataFrame, key: str) -> DataFrame:
    """(key, motion): validated rotations with their frames, a video, an incomplete rotation, or nothing."""
    rotation = F.col("kind") == "rotation"
    valid = F.coalesce(rotation & (F.col("status") == "success") & F.col("complete") & (F.col("frames") > 0) & F.col("asset_url").isNotNull(), F.lit(False))
    video = F.coalesce((F.col("kind") == "video") & (F.col("status") == "success") & F.col("asset_url").isNotNull(), F.lit(False))
    said = evidence.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(valid, F.struct("ordinal", "frames")))), lambda x: x["frames"]).alias("f"),
        F.bool_or(video).alias("v"),
        F.bool_or(rotation).alias("r"),
    )
    n = F.size("f")
    whole = F.concat(
        n.cast("string"), F.when(n == 1, " validated sequence (").otherwise(" validated sequences ("), F.array_join(F.transform("f", lambda x: x.cast("string")), ", "),
        F.lit(" frames); ordinal, not angle-calibrated"),
    )
    text = F.when(n > 0, whole).when(F.col("v"), "Video available; no validated frame sequence").when(F.col("r"), "Rotation missing, failed or incomplete")
    return said.select(key, text.otherwise("No recovered rotation").alias("motion"))


def comparison_values(objects: DataFrame, listings: DataFrame, retrievals: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, place, attribute, label, value): the 16 rows that a comparison shows of every object.

    `objects` has the reported properties (dimensions as an array), `listings` observed_at, price, currency, tax,
    `retrievals` retrieved_at and retrieval, `evidence` kind, status, complete, frames, ordinal, asset_url. Price,
    tax and retrieval are the latest ones.
    """
    rows = (
        objects.join(latest(listings, key, "observed_at", "price", "currency", "tax"), key, "left")
        .join(latest(retrievals, key, "retrieved_at", "retrieval"), key, "left")
        .join(motion_text(evidence, key), key, "left")
    )
    sizes = F.array_join(F.transform("dimensions", lambda x: F.coalesce(x.cast("string"), F.lit("?"))), " \u00d7 ")
    values = {
        "carat": shown(F.col("carat"), " ct"),
        "dimensions": F.when(F.size("dimensions") >= 2, F.concat(sizes, F.lit(" mm"))).otherwise(UNKNOWN),
        "depth": shown(F.col("depth"), "%"),
        "table": shown(F.col("table"), "%"),
        "price": price_text(F.col("price"), F.col("currency")),
        "motion": F.coalesce("motion", F.lit("No recovered rotation")),
    }
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("place"), F.lit(name).alias("attribute"), F.lit(label).alias("label"), values.get(name, shown(F.col(name))).alias("value"))
            for i, (name, label) in enumerate(COMPARED)
        ]
    )
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def comparison(long: DataFrame, ids: list, attribute: str, ident: str, value: str) -> DataFrame:
    """Side-by-side attribute table of chosen ids with Unknown for null."""
    picked = long.where(F.col(ident).isin(*ids))
    return picked.groupBy(attribute).agg(
        *[F.coalesce(F.max(F.when(F.col(ident) == i, F.col(value))), F.lit(UNKNOWN)).alias(f"object_{i}") for i in ids]
    )


def motion_class(evidence: DataFrame, key: str) -> DataFrame:
    """Validated sequence, video, incomplete rotation or none."""
    rotation = F.col("kind") == "rotation"
    valid = rotation & (F.col("status") == "success") & F.col("complete") & (F.col("frames") > 0)
    video = (F.col("kind") == "video") & (F.col("status") == "success") & F.col("asset_url").isNotNull()
    return evidence.groupBy(key).agg(
        F.when(F.bool_or(valid), "validated_sequence")
        .when(F.bool_or(video), "video")
        .when(F.bool_or(rotation), "incomplete")
        .otherwise("none")
        .alias("motion"),
        F.coalesce(F.sum(F.when(valid, F.col("frames"))), F.lit(0)).alias("valid_frames"),
    )


def asset_plan(evidence: DataFrame, digest: str, media: str, size: str) -> DataFrame:
    """One asset per content hash; different media types of the same bytes are flagged."""
    return evidence.groupBy(digest).agg(
        F.min(media).alias("media_type"),
        F.max(size).alias("byte_count"),
        F.count(F.lit(1)).alias("references"),
        (F.min(media) != F.max(media)).alias("conflict"),
    )


def record_key(*material: str) -> Column:
    """Hash of the named values; names and quoting keep different records apart."""
    return F.sha2(F.to_json(F.struct(*material)), 256)


def finalise(plan: DataFrame, published: DataFrame, digest: str) -> DataFrame:
    """Planned assets that block publication, with the reason."""
    done = published.select(digest, F.col("byte_count").alias("__bytes"), F.col("url").alias("__url"), F.lit(True).alias("__have"))
    why = (
        F.when(F.col("__have").isNull(), "not_published")
        .when(F.col("byte_count") != F.col("__bytes"), "size_mismatch")
        .when(~F.coalesce(F.col("__url").startswith("https://"), F.lit(False)), "no_https_locator")
    )
    return plan.join(done, digest, "left").withColumn("problem", why).where("problem is not null").drop("__bytes", "__url", "__have")


def reference_index(refs: DataFrame, evidence: DataFrame, certified: DataFrame) -> DataFrame:
    """Index rows with excerpt, motion flag and collision flag against certified ids."""
    motion = evidence.where("status = 'success' and kind in ('rotation', 'video')").select("id").distinct().withColumn("has_motion", F.lit(True))
    taken = certified.select(F.col("id").alias("selection_id")).distinct().withColumn("collides", F.lit(True))
    return (
        refs.withColumn("selection_id", F.concat(F.lit("ref-"), F.col("id").cast("string")))
        .withColumn("commentary_excerpt", F.substring("commentary", 1, EXCERPT))
        .join(motion, "id", "left")
        .join(taken, "selection_id", "left")
        .withColumn("has_motion", F.coalesce("has_motion", F.lit(False)))
        .withColumn("collides", F.coalesce("collides", F.lit(False)))
        .drop("commentary")
    )


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text or null; the pattern runs once."""
    return let(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))


def extract_certificate_fields(df: DataFrame, text: str) -> DataFrame:
    """Certificate fields of a whole text; unrecognised values stay null."""
    t = F.col(text)
    known = list(SHAPES)
    shape = squeezed(extracted(t, SHAPE_PATTERN))
    # The measurement phrase is found once; its numbers are read from the short match.
    sizes = F.regexp_extract_all(F.regexp_extract(t, MEASURE_PATTERN, 0), F.lit(r"([0-9.]+)"), F.lit(1))
    return df.select(
        *[c for c in df.columns if c != text],
        F.upper(extracted(t, REPORT_PATTERN)).alias("report_number"),
        F.when(t.rlike(r"(?i)INTERNATIONAL\s+GEMOLOGICAL\s+INSTITUTE"), "IGI").alias("lab"),
        F.when(shape.isin(*known), shape).alias("shape"),
        *[F.get(sizes, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("length_mm", "width_mm", "depth_mm"))],
        extracted(t, CARAT_PATTERN).try_cast("double").alias("carat"),
        F.upper(extracted(t, COLOUR_PATTERN)).alias("colour"),
        F.upper(extracted(t, CLARITY_PATTERN)).alias("clarity"),
        F.when(t.rlike(r"(?i)LABORATORY\s+GROWN|LAB\s+GROWN"), "lab-grown").when(t.rlike(r"(?i)NATURAL\s+DIAMOND"), "natural").alias("origin"),
    )


def extract_proportions(df: DataFrame, text: str) -> DataFrame:
    """Table, depth and ratio within their ranges, and the closed vocabularies of grades, fluorescence,
    girdle (one level or a range) and culet; placeholders are no grade and stay null."""
    t = F.col("__lower")
    names = [c for c in df.columns if c != text]
    # Only A-Z are lowered; one byte a character means that no other letters are there.
    plain = F.octet_length(text) == F.char_length(text)
    df = df.withColumn("__lower", F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower())))

    def number(pattern: str, limit: float) -> Column:
        v = extracted(t, pattern).try_cast("double")
        return F.when((v > 0) & (v <= limit), v)

    def word(label: str, words, tail: str = "", after: str = "") -> Column:
        one_of = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True))
        found = extracted(t, rf"{label}(?<=\b{label}){after}\s*:?\s*((?:{one_of}){tail.format(one_of)})\b")
        return F.regexp_replace(found, r"\s+", " ")

    grade = lambda label, after="": lookup(GRADES, word(label, GRADES, after=after))
    return df.select(
        *names,
        number(TABLE_PATTERN, 100).alias("table_percent"),
        number(DEPTH_PATTERN, 100).alias("depth_percent"),
        number(RATIO_PATTERN, 10).alias("length_width_ratio"),
        grade("cut", r"(?:\s+grade)?").alias("cut"),
        grade("polish").alias("polish"),
        grade("symmetry").alias("symmetry"),
        lookup(FLUORESCENCE, word("fluorescence", FLUORESCENCE)).alias("fluorescence"),
        F.replace(F.initcap(word("girdle", GIRDLE, r"(?:\s+to\s+(?:{}))?")), F.lit(" To "), F.lit(" to ")).alias("girdle"),
        F.initcap(word("culet", CULET)).alias("culet"),
    )


def dedupe_attempts(attempts: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """One kept asset per retrieval key, its distinct provenance, and how many repeats it had.

    Sources come from a closed set, so equal ones collapse before they are listed.
    """
    steps = attempts.groupBy(key, source).agg(F.min(order).alias("__o"), F.count(F.lit(1)).alias("__n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__o", source))), lambda s: s[source])
    return steps.groupBy(key).agg(
        F.min("__o").alias("kept"), (F.sum("__n") - 1).alias("duplicates"), F.array_join(listed, "|").alias("provenance")
    )


def batch_targets(refs: DataFrame, media: DataFrame, evidence: DataFrame, key: str, frames: int) -> DataFrame:
    """References with an exact certificate or a supported viewer, still lacking motion."""
    viewer = media.where("kind = 'viewer' and supported").select(key).distinct().withColumn("__v", F.lit(True))
    moving = evidence.where((F.col("kind") == "rotation") & (F.col("status") == "success") & (F.col("frames") >= frames)).select(key).distinct()
    exact = all_of([F.col("identity_status").isin("reported", "linked"), F.col("lab").isNotNull(), F.col("report_number").isNotNull()])
    return refs.join(viewer, key, "left").where(F.coalesce(exact, F.lit(False)) | F.coalesce("__v", F.lit(False))).drop("__v").join(moving, key, "left_anti")


def lesson_examples(lessons: DataFrame, valid: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """All examples in editorial order, or none if too many, unknown or repeated."""
    rows = lessons.select(key, F.posexplode("examples").alias("i", "id"))
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("__d"))
    small = size.where(F.col("n").between(2, limit) & (F.col("n") == F.col("__d"))).select(key)
    known = rows.join(small, key, "left_semi").join(valid.select("id").distinct().withColumn("__k", F.lit(True)), "id", "left")
    return known.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda e: e["id"].cast("string")), ",").alias("examples"),
        F.bool_and(F.coalesce("__k", F.lit(False))).alias("__all"),
    ).where("__all").drop("__all")


