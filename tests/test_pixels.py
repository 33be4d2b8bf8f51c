import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gyre.operators import pixels as P
from gyre.operators import support as U
from gyre.operators import traces as D


def cells(spark, text, frame=0):
    rows = [(0, frame, y, x) for y, line in enumerate(text.split("/")) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "series_id long, position long, y int, x int")


KEYS = ["series_id", "position"]


@pytest.mark.parametrize("connectivity,count", [(8, 1), (4, 3)])
def test_diagonal(spark, connectivity, count):
    labels = D.components(cells(spark, "#../.#./..#"), KEYS, connectivity)
    assert labels.select("label").distinct().count() == count


def test_long_winding_shape_is_one_component(spark):
    spiral = "#########/........#/#######.#/#.....#.#/#.###.#.#/#.#...#.#/#.#####.#/#.......#/#########"
    assert D.components(cells(spark, spiral), KEYS, 4).select("label").distinct().count() == 1


def test_block_and_bars(spark):
    full = cells(spark, "/".join(["#######"] * 7))
    for text, count, largest, effective in (
        ("......./......./..###../..###../..###../......./.......", 1, 1.0, 1.0),
        (".###.../......./.###.../......./.###.../......./.......", 3, 1 / 3, 3.0),
    ):
        out = D.flash_morphology(D.components(cells(spark, text), KEYS), full, KEYS).first()
        assert out.component_count == count
        assert abs(out.largest_component_fraction - largest) < 1e-12
        assert abs(out.effective_component_count - effective) < 1e-12


def sequence(spark, brightness, valid=None):
    valid = valid or [[True] * len(b) for b in brightness]
    rows = [
        (0, p, 0, x, v, True, ok, v is not None)
        for p, (line, oks) in enumerate(zip(brightness, valid))
        for x, (v, ok) in enumerate(zip(line, oks))
    ]
    px = spark.createDataFrame(rows, "series_id long, position long, y int, x int, brightness double, in_mask boolean, valid boolean, observed boolean")
    frames = px.groupBy("series_id", "position").agg(F.bool_and("observed").alias("observed"))
    return px, frames


def test_one_flickering_pixel(spark):
    px, frames = sequence(spark, [[v, 0.8, 0.8, 0.8] for v in (0.1, 0.8, 0.1, 0.8)])
    out = D.pixel_state_stats(D.dark_pixels(px, frames, 0.65), ["series_id"]).first()
    assert (out.fraction_with_transitions, out.max_transitions, out.longest_dark_max) == (0.25, 3, 1)
    region = D.region_measure(px.withColumn("r", F.lit("all")), frames, "r").first()
    assert region.transitions == 0


@pytest.mark.parametrize("n", [5, 17])
def test_alternation_switches_every_pair(spark, n):
    rows = [[5.0 if p % 2 else 8.0, 10.0, 10.0] for p in range(n)]
    px, frames = sequence(spark, rows)
    _, series = D.switching(px, frames, 0.65, "fixed")
    out = series.first()
    assert out.switched_pixel_pairs == n - 1 and out.rate_max == 1.0


def persistence(spark, states, support=None):
    rows = [(0, p, 0, 0, s == "D") for p, s in enumerate(states) if s in "DN"]
    px = spark.createDataFrame(rows, "series_id long, position long, y int, x int, dark boolean")
    fate = {"G": (False, True), "R": (True, False)}
    frames = spark.createDataFrame(
        [(0, p, *fate.get(s, (True, True))) for p, s in enumerate(states)], "series_id long, position long, observed boolean, reference_valid boolean"
    )
    runs = D.pixel_runs(px, frames)
    return {r.state: r for r in D.persistence(D.persistence_pixels(runs, px), runs, frames.groupBy("series_id").agg(F.count(F.lit(1)).alias("steps"))).collect()}


def test_persistence_reasons(spark):
    whole = persistence(spark, "DDDD")
    assert whole[True].q90 == 4 and whole[True].q90_fraction == 1.0 and whole[False].q90 == 0
    assert whole[True].left_window_endpoint == 1 and whole[True].right_window_endpoint == 1
    ring = persistence(spark, "DNDND")
    assert ring[True].max_length == 1 and ring[False].max_length == 1  # ends are not joined
    gap = persistence(spark, "DDGDN")
    assert gap[True].max_length == 2 and gap[True].right_gap == 1
    lost = persistence(spark, "DDSDD")
    assert lost[True].max_length == 2 and lost[True].right_support_loss == 1 and lost[True].q90_fraction == 0.4
    assert persistence(spark, "DRD")[True].right_invalid_reference == 1


def test_dark_is_strict_and_guarded(spark):
    df = spark.createDataFrame([(6.49, 10.0), (6.50, 10.0), (6.51, 10.0), (5.0, None), (5.0, -1.0)], "v double, g double")
    got = [r[0] for r in df.select(P.relative_dark(F.col("v"), F.col("g"), 0.65)).collect()]
    assert got == [True, False, False, None, None]


def test_sweep_keys_and_window(spark):
    got = U.sweep(spark.range(1), [0.6, 0.65, 0.7]).select("threshold_key").collect()
    assert [r[0] for r in got] == ["0.60", "0.65", "0.70"]
    window = U.cyclic_window(spark.createDataFrame([(1, 8)], "c int, n int"), "c", 5, "n").orderBy("window_position")
    assert [r.source_index for r in window.collect()] == [7, 0, 1, 2, 3]


@pytest.mark.parametrize(
    "indices,wrap,bad", [([254, 255, 0, 1], True, 0), ([254, 0, 1], True, 1), ([255, 0], False, 1), ([0, 1, 0], True, 1), ([1, 0], True, 1)]
)
def test_consecutive(spark, indices, wrap, bad):
    df = spark.createDataFrame([("a", p, i) for p, i in enumerate(indices)], "s string, p int, i int")
    assert U.check_consecutive(df, ["s"], "p", "i", 256, wrap).count() == bad


def test_validity_order(spark):
    rows = [("a", 2, "review", ["x", "y"]), ("a", 1, "ok", ["y"]), ("a", 3, "unavailable", ["x", "z"]), ("b", 1, "ok", [])]
    df = spark.createDataFrame(rows, "k string, o int, status string, reasons array<string>")
    got = {r.k: (r.status, r.reasons) for r in U.compose_validity(df, ["k"], "o", "status", "reasons").collect()}
    assert got == {"a": ("unavailable", ["y", "x", "z"]), "b": ("ok", [])}


def test_polar_profile_of_an_incomplete_frame_sends_pixels_only(spark):
    light = {(y, x): 1.0 + 0.1 * y + 0.01 * x for y in range(8) for x in range(8) if (y, x) != (3, 6)}
    rows = [(1, 0, y, x, None if (y, x) == (6, 3) else v, (y, x) != (0, 3), True) for (y, x), v in light.items()]
    px = spark.createDataFrame(rows, "series_id long, position long, y int, x int, brightness double, valid boolean, in_mask boolean")
    profile = P.polar_profile(px, 8, 4, 8)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
    got = {(r.ray, r.k): r for r in profile.collect()}
    assert len(got) == 32
    steps = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}
    reach = {a: max(math.hypot(y - 3.5, x - 3.5) for y, x in light if int((math.atan2(y - 3.5, x - 3.5) + 2 * math.pi) % (2 * math.pi) / (math.pi / 2) + 0.5) % 4 == a) for a in steps}
    for a, (dy, dx) in steps.items():
        raw, ok = {}, {}
        for k in range(8):
            sy, sx = (round(3.5 + k / 7 * reach[a] * d, 9) for d in (dy, dx))
            corners = [(y, x, (1 - abs(sy - y)) * (1 - abs(sx - x))) for y in (math.floor(sy), math.floor(sy) + 1) for x in (math.floor(sx), math.floor(sx) + 1)]
            corners = [c for c in corners if c[2] > 1e-9]
            seen = [w * light[y, x] for y, x, w in corners if (y, x) in light and (y, x) != (6, 3)]
            near = [(y, x) for y, x, _ in corners if abs(sy - y) <= 0.5 and abs(sx - x) <= 0.5]
            raw[k] = sum(seen) if seen else None
            ok[k] = bool(near) and all(c in light and c != (0, 3) for c in near) and 0.08 <= k / 7 <= 0.92 and bool(seen)
        scale = float(np.median([raw[k] for k in raw if ok[k]])) if any(ok.values()) else None
        for k in range(8):
            r = got[a, k]
            assert r.supported == (ok[k] and scale is not None and scale >= 0.05), (a, k)
            assert (r.value is None) == (raw[k] is None)
            assert raw[k] is None or r.value == pytest.approx(raw[k] / scale if scale and scale >= 0.05 else raw[k])


def test_orientation_of_upright_shapes_is_that_of_sql(spark):
    rng = np.random.default_rng(3)
    rows = []
    for frame in range(300):
        mask = rng.random((8, 8)) < 0.6
        mask[:, 4:] = mask[:, 3::-1]
        mask[0, 3] = mask[0, 4] = mask[7, 3] = mask[7, 4] = True
        rows += [(0, frame, int(y), int(x), True) for y, x in np.argwhere(mask)]
    pixels = pa.table(dict(zip(("series_id", "position", "y", "x", "in_mask"), zip(*rows))))
    con = duckdb.connect()
    con.register("pixels", pixels)
    sql = """SELECT position, CASE WHEN xx < yy / 1.08 THEN round((degrees(atan2(2 * xy, xx - yy)) / 2 + 90 + 180) % 180 - 90, 6) END FROM (
        SELECT position, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM pixels GROUP BY 1)"""
    expected = {k: v for k, v in con.execute(sql).fetchall() if v is not None}
    found = P.mask_geometry(spark.createDataFrame(rows, "series_id int, position int, y int, x int, in_mask boolean").repartition(3))
    found = {r.position: round(r.orientation, 6) for r in found.collect() if r.position in expected}
    assert {-90.0, 90.0} <= set(expected.values())
    assert found == expected
