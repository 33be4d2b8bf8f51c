"""Texts, orders and assessments against hand-made cases."""

import datetime as dt

from gyre.operators import catalogue as K
from gyre.operators import comparability as P
from gyre.sources import frames as A
from pyspark.sql import functions as F


def test_price_texts(spark):
    cases = [
        (1234.5, "gbp", "£1,234.50"), (0.0, "USD", "US$0.00"), (1234567.891, "EUR", "€1,234,567.89"), (1234.5, "CHF", "1234.50 CHF"),
        (1234.5, "", "1234.50 (currency unknown)"), (12.0, None, "12.00 (currency unknown)"), (None, "GBP", "Price unavailable"),
    ]
    df = spark.createDataFrame([(p, c) for p, c, _ in cases], "p double, c string")
    assert [r[0] for r in df.select(K.price_text(F.col("p"), F.col("c"))).collect()] == [t for _, _, t in cases]


def test_latest_row_and_motion(spark):
    day = lambda d: dt.date(2024, 1, d)
    listings = spark.createDataFrame([(1, day(2), 5.0), (1, day(9), 7.0), (1, day(9), 6.0), (2, None, 3.0)], "id int, at date, price double")
    assert {(r.id, r.price) for r in K.latest(listings, "id", "at", "price").collect()} == {(1, 7.0), (2, 3.0)}
    rows = [
        (1, "rotation", "success", True, 256, 2, "u"), (1, "rotation", "success", True, 64, 1, "u"), (2, "rotation", "success", True, 64, 1, "u"), (3, "rotation", "success", True, 64, 1, None),
        (3, "video", "success", None, None, 2, "u"), (4, "rotation", "failed", True, 64, 1, "u"), (5, "still", "success", None, None, 1, "u"), (6, "rotation", "success", False, 9, 1, "u"),
    ]
    evidence = spark.createDataFrame(rows, "id int, kind string, status string, complete boolean, frames long, ordinal long, asset_url string")
    assert {r.id: r.motion for r in K.motion_text(evidence, "id").collect()} == {
        1: "2 validated sequences (64, 256 frames); ordinal, not angle-calibrated",
        2: "1 validated sequence (64 frames); ordinal, not angle-calibrated",
        3: "Video available; no validated frame sequence",
        4: "Rotation missing, failed or incomplete",
        5: "No recovered rotation",
        6: "Rotation missing, failed or incomplete",
    }


def test_dimensions_are_one_identity_value(spark):
    texts = ["[6.10, 6.1, 3.50]", "6.1 x 06.1 x 3.5 mm", "6.1 x 6.2 x 3.5", "unknown "]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(K.normalise_field(F.lit("dimensions"), F.col("v"))).collect()] == ["6.1 x 6.1 x 3.5"] * 2 + ["6.1 x 6.2 x 3.5", "UNKNOWN"]


def test_scrambled_levels(spark):
    counts = (4, 4, 8, 16, 32, 64, 128)
    rows = [(level, i, (i * 3 + level) % n) for level, n in enumerate(counts, 1) for i in range(n)]
    levels = spark.createDataFrame(rows, "level int, i int, value int")
    assert A.scramble_problems(levels, 256).collect() == []
    moved = {r.serial: r.shuffled for r in A.scramble_map(levels).collect()}
    assert sorted(moved) == sorted(moved.values()) == list(range(1, 257))
    assert moved[1] == 2 and moved[5] == 4 + 2 + 1 and moved[129] == 128 + 7 + 1
    files = spark.range(1, 257).select(F.col("id").alias("serial"), F.lit(1).alias("k"))
    out = A.reorder_by_permutation(files, ["k"], "serial", 256, A.scramble_map(levels))
    assert A.is_permutation(out, ["k"], "final_position").first().bijective
    bad = [r for r in rows if r[0] != 3 and r[:2] != (2, 1)] + [(4, 0, 5), (9, 0, 0)]
    found = {(r.level, r.problem) for r in A.scramble_problems(spark.createDataFrame(bad, "level int, i int, value int"), 256).collect()}
    assert found == {(2, "not_a_permutation"), (3, "missing_level"), (4, "not_a_permutation"), (9, "unknown_level")}


def test_nulls_in_a_source_profile(spark):
    """A profile that says nothing: what needs a calibration is open, what has no reason against it is usable."""
    names = "pose_status spatial_status transfer_status ordering_status phase_status phase_reason background_status physical_status pipeline".split()
    lists = "pose_reasons spatial_reasons transfer_reasons ordering_reasons phase_reasons photometric_reasons physical_reasons".split()
    shape = ["id int", *(f"{n} string" for n in names), *(f"{n} array<string>" for n in lists), "target_px int", "period_deg int", "physical_angle boolean", "radiometric boolean", "colour boolean", "clipping_max double"]
    df = spark.createDataFrame([(1, *[None] * (len(shape) - 1))], ", ".join(shape))
    found = {r.family: (r.status, list(r.reasons)) for r in P.assess(df, "id").collect()}
    assert set(found) == set(P.FAMILIES)
    assert found["geometry_topology"] == ("ok", []) and found["chromatic_activity"] == ("review", ["source_is_not_colour_calibrated"])
    assert found["angular_persistence"] == ("review", ["phase_contract_requires_review"])
    pairs = spark.createDataFrame([(1, 1)], "left int, right int")
    rows = {r.family: (r.status, r.reasons) for r in P.can_compare(pairs, P.assess(df, "id"), "id").collect()}
    assert rows["geometry_topology"] == ("ok", "") and rows["relative_luminance_dynamics"] == ("ok", "")
    assert rows["absolute_luminance_amplitude"][0] == "review" and "cross_source_radiometric_calibration_missing" in rows["absolute_luminance_amplitude"][1]


def test_proportions_are_searched_by_plain_labels(spark):
    for pattern in (K.TABLE_PATTERN, K.DEPTH_PATTERN, K.RATIO_PATTERN):
        assert pattern[:5].isalpha() and pattern[:5].islower()
    rows = [
        (1, "xTable 3% TABLE: 58.5% é l/w RATIO 1.25 cut GRADE: vg GIRDLE Thin TO very  THICK Culet NONE"),
        (2, "Girdle: thicK Tables 5% Ratio: 12 Polish İdeal Symmetry: EX"),
        (3, None),
    ]
    found = {r.id: r for r in K.extract_proportions(spark.createDataFrame(rows, "id long, text string"), "text").collect()}
    one, two = found[1], found[2]
    assert (one.table_percent, one.length_width_ratio, one.cut, one.girdle, one.culet) == (58.5, 1.25, "Very Good", "Thin to Very Thick", "None")
    assert (two.table_percent, two.length_width_ratio, two.girdle, two.polish, two.symmetry) == (None, None, None, None, "Excellent")
    assert set(found[3][1:]) == {None}
