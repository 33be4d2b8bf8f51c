"""Pairs, matchings, components and neighbours against plain Python."""

import itertools
import math
import os
import random
import subprocess
import sys

import pytest
from gyre.operators import evidence as V
from gyre.operators import pairing as E
from gyre.operators import sequence as S
from gyre.operators import traces as D


@pytest.mark.parametrize("seed", range(3))
def test_matching_takes_the_cheapest_edges_first(spark, seed):
    rng = random.Random(seed)
    edges = [(k, i, j, float(rng.choice([1, 2, 3, rng.random()]))) for k in range(3) for i in range(12) for j in range(12) if rng.random() < 0.4]
    edges += [(9, i, i, 10.0 - i) for i in range(9)] + [(9, i, i + 1, 9.5 - i) for i in range(8)]  # a chain: one edge a round
    want, used = set(), set()
    for k, i, j, c in sorted(edges, key=lambda e: (e[0], e[3], e[1], e[2])):
        if (k, "i", i) not in used and (k, "j", j) not in used:
            want.add((k, i, j))
            used |= {(k, "i", i), (k, "j", j)}
    df = spark.createDataFrame(edges, "k int, i long, j long, cost double").repartition(4)
    assert {(r.k, r.i, r.j) for r in E.best_pairs_first(df, ["k"]).collect()} == want


def test_matching_without_edges(spark):
    assert E.best_pairs_first(spark.createDataFrame([], "k int, i long, j long, cost double"), ["k"]).collect() == []


def best_pair(rows, tolerance):
    """(found in tolerance, first, second, gap, apart, candidates) of rows (order, axis, measure)."""
    pairs = [(round(abs(a[2] - b[2]), 12), round(abs(a[1] - b[1]), 12), *sorted((a[0], b[0])), round(abs(a[1] - b[1]), 12) <= tolerance) for a, b in itertools.combinations(rows, 2)]
    near = [p for p in pairs if p[4]]
    return near, pairs


@pytest.mark.parametrize("seed", range(4))
def test_matched_pair_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    series = {
        "dense": [(i, rng.choice([1.0, 1.005, 1.01, 1.5, 2.0]), float(rng.randint(0, 4))) for i in range(40)],
        "same": [(i, 3.0, 7.0) for i in range(25)],
        "spread": [(i, 1.05 ** (3 * i), rng.random()) for i in range(12)],
        "smooth": [(i, math.exp(rng.random() * 0.2), rng.random()) for i in range(60)],
        "one": [(0, 1.0, 1.0)],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows], "k string, p int, level double, m double").repartition(3)
    got = {r.k: r for r in E.matched_pair(df, ["k"], "p", "level", "m").collect()}
    assert "one" not in got
    for k, rows in series.items():
        if len(rows) < 2:
            continue
        near, pairs = best_pair([(p, math.log(b), m) for p, b, m in rows], math.log(1.02))
        r = got[k]
        assert r.matched == bool(near) and r.candidates == len(near)
        want = min((-g, d, a, b) for g, d, a, b, _ in near) if near else min((d, -g, a, b) for g, d, a, b, _ in pairs)
        assert (r.first, r.second) == want[2:4], k


@pytest.mark.parametrize("seed", range(4))
def test_matched_area_pair_equals_all_pairs(spark, seed):
    rng = random.Random(10 + seed)
    series = {
        "dense": [(i, rng.choice([0.1, 0.11, 0.115, 0.5]), float(rng.randint(0, 3))) for i in range(30)],
        "spread": [(i, 0.05 * i, float(rng.randint(0, 2))) for i in range(12)],
        "flat": [(i, 0.07 * i, 1.0) for i in range(6)],
        "smooth": [(i, rng.random(), rng.random()) for i in range(50)],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows], "k string, p int, a double, s double").repartition(3)
    got = {r.k: r for r in E.matched_area_pair(df, ["k"], "p", "a", "s").collect()}
    for k, rows in series.items():
        near, pairs = best_pair(rows, 0.02)
        want = min((-g, d, a, b) for g, d, a, b, _ in (near or pairs))
        assert got[k].within_tolerance == bool(near) and (got[k].first, got[k].second) == want[2:4], k


@pytest.mark.parametrize("parts", [54, 53, 51, 7])
def test_equal_area_gaps_of_fractions_tie(spark, parts):
    rng = random.Random(parts)
    series = {str(k): [(i, rng.randint(1, parts) / parts, rng.choice([3, 5, 10]) / 10) for i in range(12)] for k in range(25)}
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows], "k string, p int, a double, s double").repartition(3)
    got = {r.k: (r.first, r.second) for r in E.matched_area_pair(df, ["k"], "p", "a", "s", 2.5 / parts).collect()}
    for k, rows in series.items():
        near, pairs = best_pair(rows, 2.5 / parts)
        assert got[k] == min((-g, d, a, b) for g, d, a, b, _ in (near or pairs))[2:4], k


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_flooding(spark, connectivity):
    rng = random.Random(connectivity)
    frames = {f: {(y, x) for y in range(9) for x in range(11) if rng.random() < p} for f, p in enumerate((0.2, 0.45, 0.5, 0.6, 0.75, 1.0))}
    frames[6] = {(y, x) for y in range(9) for x in range(11) if x % 2 == 0 or y == 8}  # a comb joins at the last row
    frames[7] = {(y, x) for y in range(0, 9, 2) for x in range(11)}  # rows that never touch
    df = spark.createDataFrame([(f, y, x) for f, cells in frames.items() for y, x in cells], "f int, y int, x int").repartition(3)
    got = {(r.f, r.y, r.x): (r.label.y, r.label.x) for r in D.components(df, ["f"], connectivity).collect()}
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not (dy and dx))]
    for f, cells in frames.items():
        left = set(cells)
        while left:
            first = min(left)
            reach, todo = {first}, [first]
            while todo:
                y, x = todo.pop()
                for dy, dx in steps:
                    n = (y + dy, x + dx)
                    if n in left and n not in reach:
                        reach.add(n)
                        todo.append(n)
            left -= reach
            assert all(got[f, y, x] == first for y, x in reach)
    assert len(got) == sum(map(len, frames.values()))


def test_neighbours_across_holes(spark):
    rows = [("a", p, float(p)) for p in (0, 1, 9, 10, 35, 36, 37, 90)] + [("b", 50, 1.0)]
    df = spark.createDataFrame(rows, "k string, p long, v double")
    got = {(r.k, r.p): (r.prev_p, r.next_p) for r in S.neighbours(df, ["k"], "p", ["p", "v"], following=True, width=10, dense=False).collect()}
    at = [p for k, p, _ in rows if k == "a"]
    want = {("a", p): (at[i - 1] if i else None, at[i + 1] if i + 1 < len(at) else None) for i, p in enumerate(at)} | {("b", 50): (None, None)}
    assert got == want


def test_sign_of_the_profile_prefers_an_event(spark):
    shape = "series_id long, kind string, source_indices array<int>, claims array<struct<family:string,native_id:string,event_type:string,importance:double,status:string,field_ids:array<string>>>"
    claim = lambda event: ("coordination", "pair", event, 1.0, "ok", ["f"])
    rows = [(s, "pair", [1, 2], [claim("strongest_coordinated")]) for s in (1, 2, 3)] + [(s, "pair", [5, 6], [claim("strongest_divergent")]) for s in (1, 2, 3)]
    items = spark.createDataFrame(rows, shape)
    values = spark.createDataFrame([(1, "f", -0.4), (2, "f", 0.2)], "series_id long, field_id string, value double")
    picked = {r.series_id: r.source_indices for r in V.coverage_select(items, values=values).where("rank = 1").collect()}
    assert picked == {1: [5, 6], 2: [1, 2], 3: [1, 2]}


def test_unknown_family_is_refused(spark):
    with pytest.raises(ValueError):
        V.adapt("shine", spark.range(1), spark.range(1))


def test_runs_outside_the_order_are_unavailable(spark):
    order = spark.createDataFrame([(1, p, (p + 20) % 24) for p in range(6)], "series_id long, position long, source_index long")
    events = spark.createDataFrame([(1, "dark_q90_run", 2, 5, 4), (1, "late", 4, 8, 5)], "series_id long, event_type string, start_position long, end_position long, run_length long")
    got = {r.event_type: (list(r.source_indices), r.status, r.importance) for r in V.adapt("persistence", events, order).collect()}
    assert got == {"dark_q90_run": ([22, 23, 0, 1], "ok", 4.0), "late": ([], "unavailable", 5.0)}


def test_a_session_without_a_shared_folder(tmp_path):
    """No folder is preset: local sessions write to one of their own, and delete it when asked."""
    program = """
from gyre.session import local_session, written, cut_lineage, scratch_dir, scratch_scope, drop_scratch
import os
spark = local_session(1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = spark.range(10)
assert cut_lineage(df).count() == 10 and written(df).count() == 10
folder = scratch_dir(spark)
with scratch_scope(spark):
    inner = scratch_dir(spark)
    assert written(df).count() == 10 and os.path.isdir(inner)
assert not os.path.exists(inner) and os.path.isdir(folder)
drop_scratch(spark)
assert not os.path.exists(folder)
spark.stop()
"""
    (tmp_path / "conf").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", program], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
