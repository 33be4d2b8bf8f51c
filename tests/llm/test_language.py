import numpy as np
from gyre.llm.language import STEEPNESS, WIDTH, Duels, identify, op7_language, svm
from llm_helpers import documents
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in op7_language(spark, folder).collect() if r.held_out]
    assert len(rows) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_edges(spark):
    texts = ["the house and the dog", "das Haus und der Hund", "the cat is on the mat", "die Katze und das Kind", None, "", "12 !!", "über das Haus", "x", "the " * 9000]
    docs = documents(spark, texts, lang={1: "de", 3: "de", 7: None, 8: None})
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in identify(docs, learn=F.col("doc_id") < 4).collect()}
    assert [found[i][0] for i in (0, 1, 2, 3)] == ["en", "de", "en", "de"]
    assert all(found[i] == ("und", 0.0) for i in (4, 5, 6))
    assert found[7][0] == "de" and found[9][0] == "en" and all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in identify(docs, learn=F.col("doc_id") < 0).collect()} == {"und"}
    assert identify(docs.limit(0)).collect() == []


def test_solver_reaches_the_least_loss():
    """Gradient of the plain loss (half |w|^2 plus cost times squared hinge, bias included) vanishes at the solution."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0, 1.0, -1.0)
    w = svm(x, y, cost=1.0, rounds=3000)
    full = np.column_stack([x, np.ones(120)])

    def loss(v):
        return 0.5 * v @ v + (np.maximum(0, 1 - y * (full @ v)) ** 2).sum()

    plain = np.zeros(13)
    for _ in range(4000):
        slack = np.maximum(0, 1 - y * (full @ plain))
        plain -= 0.002 * (plain - 2 * (y * slack) @ full)
    assert loss(w) <= loss(plain) * (1 + 1e-3) and np.allclose(w, plain, atol=2e-2)


def test_duels_equal_plain_votes():
    rng = np.random.default_rng(3)
    names = ["da", "de", "en", "nl"]
    label = np.array([names[i % 4] for i in range(80)], dtype=object)
    x = np.zeros((80, WIDTH))
    x[:, :16] = rng.normal(size=(80, 16)) + 2 * np.eye(4)[np.arange(80) % 4].repeat(4, axis=1)
    duels = Duels(names, x, label)
    best, chance = duels.decide(x)
    for row, b, c in zip(x, best, chance):
        won, total, margins = [0] * 4, [0.0] * 4, {}
        for k, (i, j) in enumerate(duels.pairs):
            m = margins[i, j] = float(row @ duels.weights[:-1, k] + duels.weights[-1, k])
            won[i if m > 0 else j] += 1
            total[i] += m
            total[j] -= m
        want = max(range(4), key=lambda i: (won[i] + 1e-3 * np.tanh(total[i]), -i))
        assert b == want
        closest = min(m if i == want else -m for (i, j), m in margins.items() if want in (i, j))
        assert abs(c - 1 / (1 + np.exp(-STEEPNESS * closest))) < 1e-9
    assert (np.array(names)[best] == label).mean() > 0.95


def test_ties_and_repeated_rows(spark):
    texts = ["aa bb", "cc dd", "aa bb", "cc dd", "zz", "zz", "aa bb cc dd", "aa bb cc dd"]
    docs = documents(spark, texts, lang={i: "en" if i % 2 == 0 else "xx" for i in range(8)})
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in identify(docs, learn=F.col("doc_id") < 4).collect()}
    assert found[0][0] == "en" and found[1][0] == "xx" and found[4] == found[5] and found[6] == found[7]
