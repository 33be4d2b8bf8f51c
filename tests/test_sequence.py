import random

import pytest
from pyspark.sql import functions as F

from gyre.operators import sequence as S

K = ["s"]


def trace(spark, values, indices=None):
    indices = indices or list(range(len(values)))
    rows = [("a", p, i, v) for p, (v, i) in enumerate(zip(values, indices))]
    return spark.createDataFrame(rows, "s string, p int, i int, v double")


def changes(df, wrap="none", width=S.CHUNK):
    return S.change_summary(S.adjacent_delta(df, K, "p", "i", "v", wrap, width), K).first()


def test_step_changes(spark):
    assert changes(trace(spark, [0.0, 1.0, 2.0, 3.0, 4.0])).median == 1
    assert changes(trace(spark, [0.0, 4.0, 0.0, 4.0, 0.0])).median == 4
    gap = changes(trace(spark, [0.0, None, 2.0]))
    assert (gap.observed_pairs, gap.gap_pairs, gap.median, gap.status) == (0, 2, None, "unavailable")
    assert changes(trace(spark, [0.0, 2.0], [0, 2])).non_adjacent_pairs == 1


@pytest.mark.parametrize("wrap,observed", [("none", 0), ("any", 1)])
def test_wrap_is_a_choice(spark, wrap, observed):
    assert changes(trace(spark, [0.0, 1.0], [255, 0]), wrap).observed_pairs == observed


def test_directions(spark):
    rows = [("a", p, p, a, b) for p, (a, b) in enumerate(zip([0.0, 1.0, 0.0, 0.0, 2.0], [0.0, 2.0, 3.0, 3.0, 1.0]))]
    df = spark.createDataFrame(rows, "s string, p int, i int, a double, b double")
    out = S.direction_summary(S.paired_changes(df, K, "p", "i", "a", "b"), K, "relationship", "tie").first()
    assert (out.same_pairs, out.opposite_pairs, out.tie_pairs) == (1, 2, 1)
    assert abs(out.same_fraction - 1 / 3) < 1e-12


def states(spark, text, key="a"):
    value = {"T": True, "F": False, ".": None}
    return [(key, p, value[c]) for p, c in enumerate(text)]


@pytest.mark.parametrize(
    "text,transitions,longest,observed",
    [("FTFTFT", 5, 1, 6), ("FFFTTT", 1, 3, 6), ("TT.FF", 0, 2, 4)],
)
def test_state_summary(spark, text, transitions, longest, observed):
    df = spark.createDataFrame(states(spark, text), "s string, p int, state boolean")
    out = S.state_summary(S.runs(df, K, "p", "state"), K).first()
    assert (out.transitions, out.longest_true, out.observed) == (transitions, longest, observed)


def brute_runs(text):
    out, p = set(), 0
    while p < len(text):
        if text[p] == ".":
            p += 1
            continue
        q = p
        while q + 1 < len(text) and text[q + 1] == text[p]:
            q += 1
        left = "window_endpoint" if p == 0 else "gap" if text[p - 1] == "." else "state_change"
        right = "window_endpoint" if q == len(text) - 1 else "gap" if text[q + 1] == "." else "state_change"
        out.add((text[p] == "T", p, q, left, right))
        p = q + 1
    return out


@pytest.mark.parametrize("width", [2, 3, 5, 1000])
def test_runs_do_not_depend_on_chunks(spark, width):
    rng = random.Random(7)
    texts = {"k%d" % i: "".join(rng.choices("TTTTTTF.", k=40)) for i in range(6)} | {"all": "T" * 23, "none": "." * 9}
    rows = [r for k, t in texts.items() for r in states(spark, t, k)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, p int, state boolean").repartition(5)
    got = {}
    for r in S.runs(df, K, "p", "state", width=width).collect():
        got.setdefault(r.s, set()).add((r.state, r.start, r.end, r.left_boundary, r.right_boundary))
    assert got == {k: brute_runs(t) for k, t in texts.items() if set(t) != {"."}}


@pytest.mark.parametrize("width", [3, 1000])
def test_neighbours_and_ordinal_across_chunks(spark, width):
    df = spark.range(0, 50).select((F.col("id") % 2).alias("s"), (F.col("id") * 3).alias("o"))
    out = S.neighbours(S.ordinal(df, K, "o", width=width), K, "position", ["o"], following=True, width=width).collect()
    by = {(r.s, r.position): r for r in out}
    assert len(by) == len(out) == 50
    for (s, p), r in by.items():
        assert r.o == (2 * p + s) * 3
        assert r.prev_o == (r.o - 6 if p else None)
        assert r.next_o == (r.o + 6 if p < 24 else None)
