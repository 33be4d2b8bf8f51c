import numpy as np
from gyre.llm.vectors import near_vectors


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 32))
    near = base[:120] + 0.04 * rng.normal(size=(120, 32))
    hub = base[200] + 0.03 * rng.normal(size=(60, 32))
    x = np.concatenate([base, near, hub, base[:5], base[5:10] * 3])
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [1.0, 2.0], [2.0, 4.0], [float("inf")] * 32]
    rows += [(2000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(None, rows[0][1], 1, "x"), (3, rows[3][1], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, cls string")
    found = near_vectors(table, slot=50).collect()
    valid = [(i, v) for i, v, *_ in rows if v and len(v) == 32 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = np.array([v for _, v in valid])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    true = link.sum() - len(valid)
    got = sum(r.n_links for r in found if r.vec_id not in (2005, 2006))
    assert got <= true and got >= 0.99 * true
    by = {r.vec_id: r for r in found}
    assert len(found) == len(rows)
    assert all(by[2000 + i].n_links == 0 and by[2000 + i].component_id == 2000 + i for i in (0, 1, 2, 3, 4, 7))
    assert by[2006].component_id == 2005 and by[2005].n_links == 1
    assert by[900].component_id == 0 and not by[900].kept and by[0].kept
    assert next(r for r in found if r.vec_id is None).component_id == 0
    assert len({by[i].component_id for i in range(1020, 1080)}) == 1


def test_recall_with_many_more_cells_than_probes(spark):
    """500 cells, 12 of them read; pairs just above the threshold, between random vectors and in clusters."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 32))
    base = np.concatenate([rng.normal(size=(1000, 32)), centres[rng.integers(0, 20, 1000)] + 0.6 * rng.normal(size=(1000, 32))])
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.95001, 0.96, len(base))[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in near_vectors(table, cell_rows=8).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.95).sum()) - len(x)
    assert true >= 4000 and 0.99 * true <= got <= true


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
