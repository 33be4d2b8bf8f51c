import pytest
from gyre.operators import curation as C
from gyre.operators import rules as L
from pyspark.sql import functions as F

STATE = "id string, field string, value boolean"
CHANGE = "request int, baseline string, id string, field string, before boolean, after boolean"


def digest(spark, rows, depth=2, parts=1):
    df = spark.createDataFrame(rows, STATE).repartition(parts)
    return C.state_digest(df, ["id"], ["id", "field", "value"], depth)


def test_digest_depends_on_content_only(spark):
    rows = [(f"igi-{i}", f, True) for i in range(60) for f in ("starred", "archived") if (i + len(f)) % 3]
    base = digest(spark, rows).first()
    assert base.rows == len(rows) and len(base.digest) == 64
    assert digest(spark, rows[::-1], parts=5).first() == base
    assert digest(spark, rows[1:]).first().digest != base.digest
    assert digest(spark, [("other", *rows[0][1:]), *rows[1:]]).first().digest != base.digest
    empty = digest(spark, []).first()
    assert empty.rows == 0 and len(empty.digest) == 64


def test_changed_leaves_give_the_digest_of_the_new_state(spark):
    old = spark.createDataFrame([(f"igi-{i}", "starred", True) for i in range(80)], STATE)
    new = old.where("id <> 'igi-7'").unionByName(spark.createDataFrame([("igi-9", "archived", True), ("igi-500", "starred", True)], STATE))
    changed = spark.createDataFrame([("igi-7",), ("igi-9",), ("igi-500",)], "id string")
    args = (["id"], ["id", "field", "value"], 2)
    leaves = C.updated_leaves(C.state_leaves(old, *args), new, changed, *args)
    assert C.digest_of_leaves(leaves, 2).first() == C.state_digest(new, *args).first()


@pytest.fixture(scope="module")
def curated(spark):
    state = spark.createDataFrame([("a", "starred", True), ("b", "archived", True)], STATE)
    known = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    return state, known, C.state_digest(state, ["id"], ["id", "field"], 2)


def outcome(spark, curated, *changes):
    state, known, tree = curated
    df = spark.createDataFrame(changes, CHANGE)
    found = {r.request: r.outcome for r in C.request_outcomes(state, df, known, tree).collect()}
    return found, sorted((r.id, r.field) for r in C.apply_changes(state, df, known, tree).collect())


def test_requests_are_guarded(spark, curated):
    now = curated[2].first().digest
    before = [("a", "starred"), ("b", "archived")]
    assert outcome(spark, curated, (1, now, "a", "starred", True, False)) == ({1: "applied"}, before[1:])
    assert outcome(spark, curated, (1, "0" * 64, "a", "starred", True, False)) == ({1: "stale_baseline"}, before)
    assert outcome(spark, curated, (1, "0" * 64, "a", "starred", False, True)) == ({1: "no_change"}, before)  # a retry
    assert outcome(spark, curated, (1, now, "z", "starred", False, True)) == ({1: "unknown_id"}, before)
    assert outcome(spark, curated, (1, now, "c", "starred", True, True)) == ({1: "invalid"}, before)
    both = ((1, now, "c", "starred", False, True), (1, now, "c", "starred", False, True))
    assert outcome(spark, curated, *both) == ({1: "invalid"}, before)
    mixed = ((1, now, "c", "starred", False, True), (1, now, "z", "starred", False, True))
    assert outcome(spark, curated, *mixed) == ({1: "unknown_id"}, before)


def test_of_requests_for_one_state_only_the_first_applies(spark, curated):
    now = curated[2].first().digest
    rows = ((1, now, "c", "starred", False, True), (2, now, "d", "starred", False, True), (3, None, "d", "archived", False, True))
    assert outcome(spark, curated, *rows) == (
        {1: "applied", 2: "stale_baseline", 3: "applied"}, [("a", "starred"), ("b", "archived"), ("c", "starred"), ("d", "archived")],
    )


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://a.example.org/x?y=1#z", True), ("https://a.example.org", True), ("https://a.example.org:443/x", True), ("HTTPS://a.example.org", False),
        ("http://a.example.org", False), ("https://a.example.org:8443/", False), ("https://user@a.example.org/", False), ("https://localhost/x", False),
        ("https://box.local/x", False), ("https://db.internal", False), ("https://10.1.2.3/x", False), ("https://[::1]/x", False), ("https://host/x", False),
        ("https://.org/x", False), ("https://a.example.org/a b", False), ("https:///x", False), ("", False), (None, False), ("https://a.b/" + "x" * 2048, False),
    ],
)
def test_public_addresses(spark, url, ok):
    df = spark.createDataFrame([(url,)], "u string")
    assert bool(df.select(F.coalesce(L.url_ok(F.col("u")), F.lit(False))).first()[0]) is ok


def test_null_breaks_a_rule(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "i int, v int")
    found = L.broken(df, "i", [("positive", F.col("v") > 0), ("small", F.col("v") < 3)]).collect()
    assert sorted((r.i, r.rule) for r in found) == [(1, "positive"), (1, "small"), (2, "small"), (3, "positive")]
