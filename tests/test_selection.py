import itertools
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.operators import benchmark as B
from gyre.operators import catalogue as K
from gyre.operators import cycles as C
from gyre.operators import evidence as V
from gyre.operators import pairing as E
from gyre.operators import profiles as R
from gyre.sources import frames as A
from gyre.streaming import flows

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_greedy_match_equals_the_plain_loop(spark):
    rng = random.Random(11)
    seg = lambda frame, n: [(frame, rng.randrange(3), rng.randrange(100) / 100, rng.random(), rng.random(), i) for i in range(n)]
    before, after = [r for f in range(4) for r in seg(f, 12)], [r for f in range(4) for r in seg(f, 10)]
    shape = "f int, fam int, fr double, x double, y double, id long"
    got = E.greedy_match(
        spark.createDataFrame(before, shape), spark.createDataFrame(after, shape), ["f"], "fam", "fr", "x", "y", "id", 0.2, 0.6
    ).where("kind = 'matched'")
    want = set()
    for f in range(4):
        options = []
        for a, b in itertools.product([r for r in before if r[0] == f], [r for r in after if r[0] == f]):
            radial, euclid = abs(a[2] - b[2]), ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5
            if a[1] == b[1] and radial <= 0.2 and euclid <= 0.6:
                options.append((round(0.75 * radial / 0.2 + 0.25 * euclid / 0.6, 12), a[5], b[5]))
        left, right = set(), set()
        for _, i, j in sorted(options):
            if i not in left and j not in right:
                left.add(i), right.add(j), want.add((f, i, j))
    assert {(r.f, r.i, r.j) for r in got.collect()} == want and want


def test_near_groups_do_not_chain(spark):
    items = spark.createDataFrame([(1, "frame", [i]) for i in (0, 1, 2, 3, 9, 23)], "series_id long, kind string, source_indices array<int>")
    groups = {}
    for r in V.near_groups(items, 24, 1).collect():
        groups.setdefault(r.near_group, set()).add(r.source_indices[0])
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2, 3], [9], [23]]


def claim(family, event, indices, importance=1.0, native="n"):
    return (1, family, native, event, "frame" if len(indices) == 1 else "pair", indices, ["f"], importance, "ok", [])


def test_coverage_comes_before_contrast(spark):
    shape = "series_id long, family string, native_id string, event_type string, kind string, source_indices array<int>, field_ids array<string>, importance double, status string, reasons array<string>"
    rows = [
        claim("mobility", "largest", [3, 4]),
        claim("activation", "q90", [3]),
        claim("switching", "highest", [7]),
        claim("switching", "lowest_nonzero", [9]),
        claim("morphology", "broadest", [7]),
        claim("morphology", "matched_active_area_pair", [1, 2]),
    ]
    picked = V.coverage_select(V.merge_exact(spark.createDataFrame(rows, shape))).orderBy("rank").collect()
    assert [(r.selected_for, r.source_indices) for r in picked] == [
        ("activity_motion", [3, 4]),
        ("relative_dark_state", [7]),
        ("flash_morphology", [1, 2]),
        ("contrast_fill", [9]),
    ]


@pytest.mark.parametrize("cap,status", [(16, "ok"), (3, "arc_exceeds_cap")])
def test_arc_around_the_seam(spark, cap, status):
    df = spark.createDataFrame([("a", i) for i in (22, 1, 3)], "s string, slot int")
    out = C.cover_arc(df, ["s"], "slot", 24, 1, cap).collect()
    assert {r.status for r in out} == {status}
    if status == "ok":
        assert [(r.from_slot, r.to_slot) for r in sorted(out, key=lambda r: r.step)] == [(i % 24, (i + 1) % 24) for i in range(21, 28)]


def test_quarter_turns_equal_the_exhaustive_search(spark):
    rng = random.Random(2)
    angles = [rng.uniform(0, 360) for _ in range(5)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(angles)], "s string, slot int, v double")
    jump = lambda a, b: ((a - b + 180) % 360 - 180) ** 2
    best = min(
        sum(jump(angles[i] + 90 * t[i], angles[i + 1] + 90 * t[i + 1]) for i in range(4)) + jump(angles[4] + 90 * t[4], angles[0])
        for t in ((0, *rest) for rest in itertools.product(range(4), repeat=4))
    )
    for chunk in (1, 2, 1024):
        out = C.quarter_turns(df, ["s"], "slot", "v", chunk).orderBy("slot").collect()
        turn = [r.quarter_turn for r in out]
        assert abs(out[0].objective - best) < 1e-5 and len(out) == 5 and turn[0] == 0
        cost = sum(jump(angles[i] + 90 * turn[i], angles[i + 1] + 90 * turn[i + 1]) for i in range(4)) + jump(angles[4] + 90 * turn[4], angles[0])
        assert abs(cost - best) < 1e-5


def test_a_long_cycle_is_unwrapped_in_chunks(spark):
    """The same branches for any cut, ties included, and a single frame stays as it is."""
    rng = random.Random(5)
    rows = [("a", i, float(rng.choice([0, 45, 90, 135, 200]))) for i in range(300)] + [("one", 3, 10.0)]
    df = spark.createDataFrame(rows, "s string, slot int, v double").repartition(3)
    found = [sorted((r.s, r.slot, r.quarter_turn, r.objective) for r in C.quarter_turns(df, ["s"], "slot", "v", chunk).collect()) for chunk in (7, 64, 1024)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 301
    assert ("one", 3, 0, 0.0) in found[0]


def test_peaks_equal_a_plain_search(spark):
    n, rng = 64, np.random.default_rng(4)
    curve = rng.normal(size=n)
    df = spark.createDataFrame([("a", [float(v) for v in curve])], "s string, curve array<double>")
    peaks = [i for i in range(1, n - 1) if curve[i - 1] < curve[i] > curve[i + 1]]
    kept = []
    for i in sorted(peaks, key=lambda i: -curve[i]):
        if all(abs(i - k) >= 6 for k in kept):
            kept.append(i)
    kept = [i for i in kept if 0.16 <= i / (n - 1) <= 0.92]

    def prominence(i):
        left = next((j for j in range(i, -1, -1) if curve[j] > curve[i]), -1)
        right = next((j for j in range(i, n) if curve[j] > curve[i]), n)
        return curve[i] - max(min(curve[left + 1 : i + 1]), min(curve[i:right]))

    got = {r.peak_index: r.prominence for r in R.profile_peaks(df, "curve", n).collect()}
    assert set(got) == set(kept) and all(abs(got[i] - prominence(i)) < 1e-9 for i in kept)


def test_medoid_rejects_the_odd_shape(spark):
    base = [1.0, 0.4, 1.0, 0.4, 1.0, 0.4, 1.0, 0.3]
    rows = [("a", i, 1.0, [v + 0.001 * i * (k % 3) for k, v in enumerate(base)]) for i in range(6)]
    rows += [("a", 6, 1.0, base[2:] + base[:2]), ("a", 7, 9.0, [0.1] * 8)]
    df = spark.createDataFrame(rows, "s string, id int, score double, shape array<double>")
    got = {r.id: r.status for r in R.medoid_consensus(df, ["s"], "id", "score", 0.02, 2.5, 5).collect()}
    assert got[7] == "rejected" and got[6] != "rejected" and list(got.values()).count("selected") == 5


def test_medoids_of_whole_and_odd_sets(spark):
    rng = np.random.default_rng(5)
    sets = {s: [[float(x) for x in rng.normal(size=8)] for _ in range(n)] for s, n in (("a", 3), ("b", 9), ("odd", 6))}
    sets["odd"][2][5] = None  # a shape without one side is at no distance from any other

    def far(a, b):
        if None in a or None in b:
            return None
        return min(float(np.sqrt(np.mean((np.array(a) - np.roll(b, 2 * t)) ** 2))) for t in range(4))

    rows = [(s, i, 1.0, v) for s, views in sets.items() for i, v in enumerate(views)]
    df = spark.createDataFrame(rows, "s string, id int, score double, shape array<double>")
    found = R.medoid_consensus(df, ["s"], "id", "score", 9.0, 2.5, 5)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()  # no nested row expressions over pairs of whole shapes
    got = {(r.s, r.id): r for r in found.collect()}
    for s in ("a", "b"):
        med = [np.median([far(a, b) for j, b in enumerate(sets[s]) if j != i]) for i, a in enumerate(sets[s])]
        best = int(np.argmin(np.round(med, 12)))
        for i, a in enumerate(sets[s]):
            assert got[s, i].medoid == best and got[s, i].distance == pytest.approx(far(a, sets[s][best]))
    assert got["odd", 0].medoid == 2  # a null median is the smallest, as before


def golden():
    rows = []
    for line in (ROOT / "FIXTURES.md").read_text().splitlines():
        hit = re.match(r"\| (LG\d+) \| (core|wide) \| (\w+) \| ([\d.]+) \| ([\d.]+) \| ([\d.]+) \| ([\d.]+) \|", line)
        if hit:
            rows.append((*hit.groups()[:3], *map(float, hit.groups()[3:])))
    return rows


def test_published_agreement_figures(spark):
    df = spark.createDataFrame(golden(), "id string, window string, region string, support double, amplitude double, dark double, switching double")
    names = ["support", "amplitude", "dark", "switching"]
    rows = B.benchmark_rows(df, ["id", "window", "region"], names)
    got = {r.measure: r.rho for r in B.window_sensitivity(rows, ["id", "region"], "window", "core", "wide").collect()}
    for name, value in {"amplitude": 0.7853, "dark": 0.7794, "switching": 0.7971, "support": 0.9451}.items():
        assert abs(got[name] - value) < 5e-4
    pairs = {(r.left, r.right): r.rho for r in B.redundancy_matrix(df.where("window = 'core'"), names[1:]).collect()}
    assert abs(pairs[("dark", "switching")] - 0.8735) < 5e-4
    assert abs(pairs[("amplitude", "dark")] - 0.1206) < 5e-4


def test_progressive_slots_are_a_permutation(spark):
    df = spark.range(1, 257).withColumnRenamed("id", "serial").withColumn("k", F.lit(1))
    out = A.reorder_by_permutation(df, ["k"], "serial", 256)
    assert A.is_permutation(out, ["k"], "final_position").first().bijective
    assert [r.final_position for r in out.where("serial <= 6").orderBy("serial").collect()] == [0, 64, 128, 192, 32, 96]


def test_natural_order_and_trailing_index(spark):
    df = spark.createDataFrame([(n,) for n in ("f10.jpg", "F2.jpg", "f1.jpg", "g.png")], "n string")
    assert [r.n for r in df.orderBy(A.natural_key(F.col("n"))).collect()] == ["f1.jpg", "F2.jpg", "f10.jpg", "g.png"]
    assert [r[0] for r in df.select(A.trailing_index(F.col("n"))).collect()] == [10, 2, 1, None]



def test_stream_upsert_does_not_depend_on_batches_or_arrival(spark, tmp_path):
    shape = "id long, at int, colour string, cut string"
    rows = [(1, 1, "D", None), (2, 1, "E", "good"), (1, 2, None, "fair"), (2, 2, "F", "good"), (3, 2, "G", None), (2, 3, None, "1.50"), (3, 4, "g", None)]
    want = {1: ("D", "fair", None), 2: ("E", "good", "colour|cut"), 3: ("G", None, None)}
    cuts = {"one": [rows], "time": [rows[:2], rows[2:5], rows[5:]], "reverse": [rows[5:], rows[2:5], rows[:2]]}
    for name, batches in cuts.items():
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        run = lambda: flows.stream_upsert(
            spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source), lambda b: b, "id", "at", ["colour", "cut"], out  # noqa: B023
        )
        spark.createDataFrame([], shape).write.parquet(source)
        for batch in batches:  # each file is a batch of its own, and the flow restarts in between
            spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(source)
            merged, rejects = run()
        assert {r.id: (r.colour, r.cut, r.conflicts) for r in merged.join(rejects, "id", "left").collect()} == want


def test_suppressors_equal_a_plain_search(spark):
    n, rng = 64, np.random.default_rng(9)
    curve = rng.normal(size=n)
    df = spark.createDataFrame([("a", [float(v) for v in curve])], "s string, curve array<double>")
    peaks = [i for i in range(1, n - 1) if curve[i - 1] < curve[i] > curve[i + 1]]
    kept = []
    for i in sorted(peaks, key=lambda i: -curve[i]):
        if all(abs(i - k) >= 6 for k in kept):
            kept.append(i)
    kept = [i for i in kept if 0.16 <= i / (n - 1) <= 0.92]
    want = {}
    for i in (i for i in peaks if 0.40 <= (i + 0.5) / n <= 0.68):
        rivals = [k for k in kept if k != i and abs(k - i) < 6 and curve[k] >= curve[i]]
        best = max(rivals, key=lambda k: curve[k]) if rivals and i not in kept else None
        want[i] = (i in kept, best)
    got = {r.peak_index: (r.retained, r.suppressor_index) for r in R.peak_suppression(df, ["s"], "curve", n).collect()}
    assert got == want and any(not kept for kept, _ in want.values())


def test_packet_and_inventory(spark):
    shape = "series_id long, rank int, kind string, source_indices array<int>, selected_for string"
    picked = spark.createDataFrame([(1, 1, "run", [0, 1, 2, 3, 4], "x"), (1, 2, "frame", [9], "y")], shape)
    frames = spark.createDataFrame([(1, i, f"f{i}") for i in range(5)], "series_id long, source_index int, path string")
    got = {r["rank"]: r for r in V.packet(picked, frames, "source_index", "path").collect()}
    assert (got[1].render_indices, got[1].frame_refs, got[1].status) == ("0,2,4", "f0,f1,f2,f3,f4", "ok")
    assert got[2].status == "missing_frame"
    schema = "series_id long, family string, native_id string, event_type string, kind string, source_indices array<int>, field_ids array<string>, importance double, status string, reasons array<string>"
    cands = spark.createDataFrame([claim("mobility", "largest", [3]), claim("switching", "highest", [3]), claim("opposing", "typical", [8])], schema)
    items = V.merge_exact(cands)
    row = V.inventory(cands, items, V.near_groups(items, 24, 1), V.coverage_select(items)).first()
    assert (row.candidates, row.exact_items, row.near_groups) == (3, 2, 2)
    assert row.available == row.covered == "activity_motion|relative_dark_state|directional" and row.uncovered == ""


def test_equal_neighbours_support_both_directions(spark):
    cells = spark.createDataFrame([(i, "f", v) for i, v in enumerate([1.0, 1.0, 2.0])], "id long, field_id string, value double")
    claims = spark.createDataFrame([(1, "f", True, [0, 1, 2]), (2, "f", False, [2, 1, 0]), (3, "f", False, [0, 1, 2])], "claim_id long, field_id string, increasing boolean, samples array<long>")
    verdicts = {r.claim_id: r.verdict for r in B.ordered_claims(claims, cells, "id").collect()}
    assert verdicts == {1: "supports", 2: "supports", 3: "contradicts"}
    assert {r.verdict for r in B.ordered_claims(claims, cells, "id", strict=True).collect()} == {"contradicts"}


def test_completion_needs_a_lab_only_where_listed(spark):
    evidence = spark.createDataFrame([(i, k, "success") for i in (1, 2) for k in ("certificate", "video")], "id long, kind string, status string")
    outcomes = spark.createDataFrame([(i, "report_number", "agreement", True) for i in (1, 2)], "id long, field string, outcome string, on_certificate boolean")
    attempts = spark.createDataFrame([(3, "failed")], "id long, status string")
    listings = spark.createDataFrame([(1, None), (2, "GIA")], "id long, lab string")
    got = {r.id: (r.complete, r.reasons) for r in K.completion(evidence, attempts, outcomes, listings, "id", ["failed"]).collect()}
    assert got[1] == (True, "") and got[2] == (False, "certificate lab identity was not parsed and matched")
    assert not got[3][0] and got[3][1].startswith("missing successful certificate evidence|")


def test_canonical_values_of_any_length(spark):
    df = spark.createDataFrame([("1.50", "1.5"), ("1.5000001", "1.5"), ("-0.0", "0"), ("007", "7"), (" abc", "ABC"), (".5", "0.50"), ("1.", "1")], "a string, b string")
    assert [r[0] for r in df.select(K.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, True, True, True]


def test_record_keys_keep_parts_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None)], "x string, y string")
    assert df.select(K.record_key("x", "y").alias("k")).distinct().count() == 4


def test_weighted_quantile_counts_points(spark):
    df = spark.createDataFrame([("one", 5.0, 1.0), ("two", 5.0, 1.0), ("two", 5.0, 2.0), ("none", 1.0, 0.0)], "k string, v double, w double")
    assert {r.k: r.value for r in V.weighted_quantile(df, ["k"], "v", "w", [0.5]).collect()} == {"one": None, "two": 5.0, "none": None}


def test_native_candidates_count_positions_once(spark, tmp_path):
    from gyre.plans.evidence_queries import native_candidates
    from gyre.plans.views import Tables

    rows = [(i, i % 3, "click" if i % 7 else "error", float(i * i % 17), '{"k": %d}' % (i % 5 + 1)) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = native_candidates(Tables(spark, str(tmp_path)))
    assert "events.parquet" not in " ".join(found.inputFiles())
    assert {r.series_id for r in found.select("series_id").distinct().collect()} == {0, 1, 2}
