"""Planted radial boundaries: the template, its scoring and the cross-fit against numpy."""

import numpy as np
import pytest

from gyre.operators import profiles as R
from pyspark.sql import functions as F

N = 64
U = np.arange(N) / (N - 1)
CENTRES = (0.51, 0.73, 0.87)


def planted(centres=CENTRES, seed=1):
    """frames x sectors x samples: narrow bumps at the boundaries, shifted a little per sector."""
    rng = np.random.default_rng(seed)
    data = np.abs(rng.normal(0, 0.01, size=(8, 8, N)))
    for s in range(8):
        for c in centres:
            data[:, s, :] += np.exp(-(((U - c - 0.004 * (s % 3 - 1)) / 0.018) ** 2))
    return data


def table(spark, data):
    rows = [(0, f, s, [float(v) for v in data[f, s]]) for f in range(8) for s in range(8)]
    return spark.createDataFrame(rows, "set_id long, frame long, sector long, profile array<double>").repartition(3)


def robust_z(v):
    med = np.median(v)
    return (v - med) / max(1.4826 * np.median(np.abs(v - med)), 0.2 * np.std(v), 1e-6)


def peak(v, target, radius):
    near = np.flatnonzero(np.abs(U - target) <= radius)
    i = near[np.argmax(v[near])]
    return U[i], robust_z(v)[i]


@pytest.fixture(scope="module")
def fitted(spark):
    data = planted()
    profiles = table(spark, data)
    cands = R.candidates(R.consensus(profiles, ["set_id"], "sector", N), N)
    return data, profiles, cands, R.boundary_template(cands, ["set_id"], N)


def test_template_finds_the_planted_boundaries(fitted):
    data, _, _, template = fitted
    rows = {r.boundary: r for r in template.collect()}
    sectors = np.median(data, axis=0)
    for name, centre in zip(R.BOUNDARIES, CENTRES):
        row = rows[name]
        assert (row.status, row.reason, row.sector_support) == ("ok", None, 1.0)
        assert abs(row.global_u - centre) < 1.5 / N
        raw = np.array([peak(sectors[s], row.global_u, 0.045)[0] for s in range(8)])
        opposite = np.roll(raw, 4)
        assert np.allclose(row.sector_u, 0.8 * raw + 0.2 * (raw + opposite) / 2)


def test_missing_boundary_is_named(spark):
    cands = R.candidates(R.consensus(table(spark, planted((0.30, 0.51, 0.87))), ["set_id"], "sector", N), N)
    rows = R.boundary_template(cands, ["set_id"], N).collect()
    assert len(rows) == 3 and {r.status for r in rows} == {"unavailable"}
    assert {r.reason for r in rows} == {"no_supported_inner_middle_edge"}
    by = {r.boundary: r for r in rows}
    assert {b: r.control for b, r in by.items()} == {"centre_inner": "partial", "inner_middle": None, "middle_outer": "partial"}
    assert by["inner_middle"].global_u is None and abs(by["centre_inner"].global_u - 0.51) < 1.5 / N and len(by["middle_outer"].sector_u) == 8


def flat_peaks(v):
    """Tops of equal samples that are higher than both sides, at their middle."""
    out, i = [], 1
    while i < len(v) - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if j < len(v) - 1 and v[j + 1] < v[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def test_flat_tops_and_ties(spark):
    rng = np.random.default_rng(6)
    curves = [[float(x) for x in rng.integers(0, 4, N)] for _ in range(40)] + [[0.0] * N, [1.0] * 10 + [0.0] * (N - 10), [float(min(k, 40)) for k in range(N)]]
    df = spark.createDataFrame(list(enumerate(curves)), "i int, curve array<double>")
    got = {r.i: r.p for r in df.select("i", R.peak_indices(F.col("curve"), N).alias("p")).collect()}
    assert got == {i: flat_peaks(c) for i, c in enumerate(curves)}
    kept = {r.i: r.k for r in df.select("i", R.spaced(F.col("curve"), R.peak_indices(F.col("curve"), N), 6).alias("k")).collect()}
    for i, c in enumerate(curves):
        want = []
        for p in sorted(flat_peaks(c), key=lambda p: (-c[p], -p)):
            if all(abs(p - k) >= 6 for k in want):
                want.append(p)
        assert kept[i] == want


def test_window_peaks_compete_inside_their_window_only(spark):
    """A tall peak between the windows suppresses nothing, and no peak is made up."""
    curve = [0.0] * N
    curve[36], curve[39], curve[42], curve[45] = 0.7, 9.0, 2.0, 1.5
    df = spark.createDataFrame([(curve,)], "curve array<double>")
    assert {r.peak_index for r in R.profile_peaks(df, "curve", N, policy="window").collect()} == {36, 42}
    assert 36 not in {r.peak_index for r in R.profile_peaks(df, "curve", N).where("prominence > 0").collect()}


def test_temporal_priority_prefers_votes_to_prominence(spark):
    data = planted((0.45, 0.73, 0.87))
    extra = np.exp(-(((U - 0.56) / 0.018) ** 2))
    data[:2, :, :] += 40 * extra  # a strong edge in two frames of eight
    profiles = table(spark, data)
    cands = R.candidates(R.consensus(profiles, ["set_id"], "sector", N), N, policy="window")
    votes = R.candidate_persistence(profiles, cands, ["set_id"], "frame", N)
    ranked = [r for r in votes.orderBy("place").collect() if r.place]
    assert [r.frame_votes for r in ranked] == sorted((r.frame_votes for r in ranked), reverse=True)
    rows = {r.boundary: r for r in R.boundary_template(cands, ["set_id"], N, votes).collect()}
    assert abs(rows["centre_inner"].global_u - 0.45) < 1.5 / N and rows["centre_inner"].control == "full"


def test_candidate_votes(fitted):
    data, profiles, cands, _ = fitted
    got = {r.peak_index: r for r in R.candidate_persistence(profiles, cands, ["set_id"], "frame", N).collect()}
    assert set(got) == {r.peak_index for r in cands.collect()}
    for index, row in got.items():
        hits = [[peak(data[f, s], U[index], 0.025) for s in range(8)] for f in range(8)]
        ok = np.array([[z >= 0.8 for _, z in line] for line in hits])
        assert row.frame_votes == int((ok.sum(axis=1) >= 4).sum()) and row.supported_pairs == int(ok.sum())
        offsets = [abs(u - U[index]) for line in hits for u, z in line if z >= 0.8]
        if offsets:
            assert abs(row.median_offset - np.median(offsets)) < 1e-9


def test_alignment_prefers_detected_boundaries(fitted):
    data, profiles, _, template = fitted
    controls = {r.boundary: r.sector_u for r in template.collect()}
    for row in R.boundary_alignment(profiles, template, ["set_id"], "sector", N).collect():
        best = lambda f, s, t: data[f, s][np.abs(U - t) <= 0.018].max()
        found = np.median([best(f, s, controls[row.boundary][s]) for f in range(8) for s in range(8)])
        fixed = np.median([best(f, s, R.COARSE[R.BOUNDARIES.index(row.boundary)]) for f in range(8) for s in range(8)])
        assert abs(row.step_edge_median - found) < 1e-9 and abs(row.coarse_edge_median - fixed) < 1e-9
        assert abs(row.edge_ratio - found / fixed) < 1e-9 and row.edge_ratio > 1


def test_crossfit_scores_every_frame_once(fitted):
    _, profiles, _, _ = fitted
    rows = R.crossfit(profiles, ["set_id"], "frame", "sector", N).collect()
    by = {}
    for r in rows:
        by.setdefault(r.boundary, []).append(r)
    assert set(by) == set(R.BOUNDARIES) and all(len(v) == 1 for v in by.values())
    for (r,) in by.values():
        assert (r.scored_frames, r.requested_frames, r.crossfit_status, r.status, r.reasons) == (8, 8, "ok", "ok", "")
        assert r.continuity_median == 1.0 and r.worst_gap == 0.0


def test_consensus_reads_a_set_once_and_takes_plain_medians(spark):
    data = [(s, f, r, [None if (s + f + r + k) % 5 == 0 or (s == 1 and k == 7) else float((7 * s + 3 * f + 5 * r + k * k) % 11) for k in range(N)]) for s in range(3) for f in range(4) for r in range(8)]
    rows = spark.createDataFrame([*data, (3, 0, 0, None)], "set_id long, frame int, sector int, profile array<double>")
    found = R.consensus(rows, ["set_id"], "sector", N)
    # The curve is a stored column: its readers do not smooth it again.
    assert "Scan ExistingRDD" in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    for row in found.collect():
        for sector in row.sectors:
            for k, got in enumerate(sector.p):
                seen = [p[k] for s, f, r, p in data if s == row.set_id and r == sector.s and p[k] is not None]
                assert got == (float(np.median(seen)) if seen else None)
    assert {r.set_id for r in found.collect()} == {0, 1, 2}
