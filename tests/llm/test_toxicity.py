import pickle
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from gyre.llm import text as X
from gyre.llm import toxicity as module
from gyre.llm.toxicity import BlockMaxIndex, fit, toxicity
from llm_helpers import documents, sentence


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    m = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    m[rng.random(300) < 0.2] = m[0]
    m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    index = BlockMaxIndex(m, 16)
    for q in m[:60]:
        term = np.flatnonzero(q)
        if len(term):
            example, cosine = index.nearest(term, q[term], 7)
            best = np.sort(m @ q)[::-1][:7]
            assert np.allclose(cosine, best[best > 0])
            assert np.allclose((m @ q)[example], cosine)


def test_planted_toxic_documents(spark):
    rng = random.Random(5)
    bad = ["vilest", "Grubling", "snarlhound"]
    texts, toxic = [], {}
    for i in range(400):
        t = sentence(rng, 60).split()
        if i % 5 == 0:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
        toxic[i] = int(i % 5 == 0)
    texts += ["", None, "VILEST grubling!"]
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(200)] + [(None, 1), (3, None), (900, 1)], "doc_id long, toxic int")
    rows = {r.row.doc_id: r for r in toxicity(documents(spark, texts), labels).collect()}
    assert sum(rows[i].predicted != toxic[i] for i in range(200, 400)) <= 2
    assert rows[402].predicted == 1 and rows[400].score == rows[401].score < 0.5
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_without_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(documents(spark, ["a b", None]), labels).collect()] == [0.0, 0.0]
    assert toxicity(documents(spark, []).limit(0), labels).collect() == []


def test_rare_toxic_words_of_a_large_lexicon(spark):
    """400 abusive words, each in 1 to 5 labelled rows: no word is frequent enough to stand out alone."""
    rng = random.Random(11)
    bad = ["".join(rng.choice("pqrstuvwxyz") for _ in range(9)) for _ in range(400)]
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts, toxic = [], {}
    for i in range(900):
        t = [rng.choice(plain) for _ in range(50)]
        if i % 5 == 0:
            for w in rng.sample(bad, 6):
                t.insert(rng.randrange(len(t)), w)
        texts.append(" ".join(t))
        toxic[i] = int(i % 5 == 0)
    held = [sum(w in texts[i].split() for i in range(0, 600, 5)) for w in bad]
    bad_seen = {w for w, n in zip(bad, held) if 1 <= n <= 5}
    assert len(bad_seen) > 300
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(600)], "doc_id long, toxic int")
    rows = {r.row.doc_id: r for r in toxicity(documents(spark, texts), labels).collect()}
    found = [rows[i].predicted for i in range(600, 900) if toxic[i] and bad_seen & set(texts[i].split())]
    assert sum(found) >= 0.9 * len(found) and len(found) >= 55
    assert sum(rows[i].predicted for i in range(600, 900) if not toxic[i]) <= 5
    one = sum(n == 1 for n in held)
    assert one > 50 and all(0 <= r.score <= 1 for r in rows.values())


def test_every_shared_term_counts(spark):
    texts = ["zorgle one two", "mild one four", "zorgle", "mild", "unseen"]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    rows = {r.row.doc_id: r for r in toxicity(documents(spark, texts), labels).collect()}
    assert rows[2].nearest > 0 and rows[3].nearest > 0 and rows[4].nearest == 0
    assert rows[2].score > rows[3].score


def test_index_with_common_terms_is_exact():
    """Most terms are held by most examples, so bounds and blocks decide what is read."""
    rng = np.random.default_rng(8)
    m = rng.random((400, 30)) ** 4 * (rng.random((400, 30)) < 0.6)
    m[:, 20:] *= rng.random((400, 10)) < 0.05
    m[rng.integers(0, 400, 60)] = m[7]
    m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    index = BlockMaxIndex(m, 16)
    assert index.dense.shape[1] >= 20
    queries = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in m[:150] if q.any()]
    for skip in (-1, 3):
        for (term, weight), (example, cosine) in zip(queries, index.nearest_many(queries, 9, skip)):
            q = np.zeros(30)
            q[term] = weight
            every = np.round(m @ q, 12)
            if skip >= 0:
                every[skip] = 0
            best = np.lexsort((np.arange(400), -every))[:9]
            best = best[every[best] > 0]
            assert list(example) == list(best) and np.allclose(cosine, every[best], atol=1e-11)


def plain_scores(texts, labelled, model):
    """Scores by whole cosines over dictionaries of features; the two calibration figures are the model's."""
    import math
    import re
    from collections import Counter

    from gyre.llm.toxicity import BEGINNINGS, NEIGHBOURS, NO_EVIDENCE

    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return Counter([(0, w) for w in words] + [(n, w[:n]) for w in words for n in BEGINNINGS if len(w) > n])

    found = [features(t) for t in texts]
    df = Counter(f for c in found for f in c)
    held = {x: Counter(f for i, label in labelled.items() if label == x for f in found[i]) for x in (0, 1)}
    size = {x: sum(label == x for label in labelled.values()) for x in (0, 1)}

    def ratio(f):
        total, out = held[0][f] + held[1][f], 0.0
        for x in (0, 1):
            for seen, share in ((held[x][f], total / sum(size.values())), (size[x] - held[x][f], 1 - total / sum(size.values()))):
                out += 2 * seen * math.log(seen / (size[x] * share)) if seen else 0.0
        return max(out, 0.0)

    known = set(held[0]) | set(held[1])
    scale = {f: math.log1p(len(texts) / df[f]) * math.sqrt(NO_EVIDENCE + ratio(f)) for f in known}

    def vector(c):
        v = {f: (1 + math.log(n)) * scale[f] for f, n in c.items() if f in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if v else {}

    examples = [(label, vector(found[i])) for i, label in labelled.items() if vector(found[i])]
    out = []
    for c in found:
        v = vector(c)
        near = sorted(((sum(x * e.get(f, 0.0) for f, x in v.items()), label) for label, e in examples), key=lambda x: -x[0])
        near = [(cos, label) for cos, label in near[:NEIGHBOURS] if round(cos, 12) > 0]
        votes, strength = [cos**2 * model.stands_for[label] for cos, label in near], 0.25 * min(model.stands_for)
        raw = (sum(w for w, (_, label) in zip(votes, near) if label) + strength * model.base) / (sum(votes) + strength) if v else model.blank_raw
        out.append(1 / (1 + math.exp(-(model.slope * math.log(raw / (1 - raw)) + model.shift))))
    return out


def test_whole_scores_equal_plain_cosines(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 11))) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + (" Grubling" if i % 4 == 0 else "") for i in range(160)]
    texts += ["", None, "zzz yyy", "Grubling " * 2000, texts[0], texts[0]]
    labelled = {i: int(i % 4 == 0) for i in range(90)}
    docs = documents(spark, texts).repartition(3)
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, toxic int")
    model = fit(docs.select("doc_id", "text"), labels)
    want = plain_scores(texts, labelled, model)
    rows = {r.row.doc_id: r.score for r in toxicity(docs, labels).collect()}
    assert max(abs(rows[i] - want[i]) for i in range(len(texts))) < 1e-6
    assert rows[0] == rows[164] == rows[165]


def test_workers_give_memory_back_after_every_batch(spark, monkeypatch):
    docs = documents(spark, [f"plain words {i} and more" if i % 2 else f"vile words {i} and more" for i in range(40)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    model, calls = fit(docs, labels), []
    monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    batches = [pa.array(["vile words", "plain words"]), pa.array([None, "and more"])]
    found = list(module._scorer(SimpleNamespace(value=model)).func(iter(batches)))
    assert [len(x) for x in found] == [2, 2] and len(calls) >= 1 + len(batches)


def test_only_postings_travel_and_make_the_same_index(spark):
    texts = [" ".join(f"w{(i * j) % 37}common{j % 5}" for j in range(30)) + (" vile" if i % 2 else "") for i in range(60)]
    model = fit(documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    sent = pickle.loads(pickle.dumps(model))
    opened = sent.opened()
    assert sent.index is None and model.index is not None
    for name in ("examples", "weights", "first", "dense", "common", "tops"):
        assert np.array_equal(getattr(opened.index, name), getattr(model.index, name))
    dense = np.zeros((60, len(model.terms)))
    index, held = opened.index, np.diff(opened.index.first)
    dense[index.examples, np.repeat(np.arange(len(held)), held)] = index.weights
    dense[:, index.common >= 0] = index.dense
    assert index.dense.shape[1] and len(index.weights) and np.allclose((dense * dense).sum(1), 1)


def test_beginnings_have_the_hashes_of_spans():
    data = np.frombuffer("a abcd abcde abcdefghijkl ünlängst 1234567890".encode(), np.uint8)
    starts, ends, _ = X.word_spans(data, np.array([0, len(data)]), X.ALNUM)
    sums = X.prefix_hash(data)
    for size, long, found in X.beginning_hashes(data, starts, ends, (4, 5, 6, 7, 8)):
        assert list(long) == list(np.flatnonzero(ends - starts > size)) and len(long) >= 3
        assert np.array_equal(found, X.span_hash(sums, starts[long], starts[long] + size))


def test_example_rows_give_memory_back_after_every_block(monkeypatch):
    calls = []
    monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch({"toxic": pa.array([1, 0], pa.int32()), "text": ["bad worded words", None]}), pa.record_batch({"toxic": pa.array([0], pa.int32()), "text": ["mild"]})]
    found = list(module._example_rows(iter(batches)))
    assert [x.num_rows for x in found] == [2, 1] and found[0]["toxic"].to_pylist() == [1, 0] and len(calls) == 4
    assert [len(b.as_py()) // 8 for b in found[0]["feature"]] == [5, 0]
