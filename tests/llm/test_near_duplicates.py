import itertools

import pyarrow as pa
from gyre.llm import exchange, near_duplicates
from gyre.llm.components import components
from gyre.llm.exchange import PIECE_BYTES, buckets_for
from gyre.llm.near_duplicates import jaccard_components
from llm_helpers import documents, edge_texts, words


def expected(texts, size=5, percent=75):
    sets = []
    for t in texts:
        w = words(t, rb"[^\x20\x09-\x0D]+")
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]))
    low = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in enumerate(sets)}


def test_equals_brute_force(spark):
    texts = edge_texts()
    rows = jaccard_components(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected(texts)


def test_many_near_copies_are_one_component(spark):
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 120, 3)]
    texts += [" ".join(base[:60] + [f"other{k}_{j}" for j in range(60)]) for k in range(10)]
    rows = jaccard_components(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected(texts)


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "q r s t u v", "q r s t u v", None], ids={0: None, 1: 5, 2: None, 3: None, 4: 5})
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert found == sorted([(None, 2, 5), (5, 2, 5), (None, 2, None), (None, 2, None), (5, 0, 5)], key=str)


def test_empty_table(spark):
    assert jaccard_components(documents(spark, []).limit(0)).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)] + [(200, 200 + k) for k in range(1, 30)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{200 + k: 200 for k in range(30)}}


def test_rows_between_chunks_and_buckets_grow_with_the_texts(spark, monkeypatch):
    for size, chunks in ((0, 12), (54_592_527, 211), (863_738_755, 204), (30 * 10**9, 9000)):
        assert 1 <= buckets_for(size, chunks) <= max(1, chunks)
        assert chunks * buckets_for(size, chunks) <= max(chunks, size // PIECE_BYTES)
    asked, was = [], near_duplicates.answers
    monkeypatch.setattr(near_duplicates, "answers", lambda asks: asked.append(asks) or was(asks))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        texts = edge_texts()
        rows = jaccard_components(documents(spark, texts)).collect()
        assert asked[0].count() <= max(40, sum(len((t or "").encode()) for t in texts) // PIECE_BYTES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected(texts)


def test_dealing_gives_memory_back_after_every_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(exchange, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch({"chunk": pa.array([2, 1, 2], pa.int64()), "text": ["a", None, "c"]}), pa.record_batch({"chunk": pa.array([5], pa.int64()), "text": ["d"]})]
    got = [(k, pa.ipc.open_stream(p).read_all()["text"].to_pylist()) for b in exchange._payloads(iter(batches)) for k, p in zip(b["chunk"].to_pylist(), b["payload"].to_pylist())]
    assert got == [(1, [None]), (2, ["a", "c"]), (5, ["d"])] and len(calls) == 1 + len(batches)


def test_steps_give_memory_back_when_done(monkeypatch):
    calls = []
    monkeypatch.setattr(exchange, "give_back", lambda: calls.append(1))
    dealt = next(exchange._payloads(iter([pa.record_batch({"chunk": pa.array([3], pa.int64()), "doc_id": pa.array([1], pa.int64()), "text": ["a b c d e f"]})])))
    table = pa.Table.from_batches([dealt])
    calls.clear()
    asked = near_duplicates._asks(5, 1)(table)
    assert asked["chunk"].to_pylist() == [3] and len(calls) == 2  # before the texts are unpacked and after the names are made
    near_duplicates._classes(5, 75)(table, exchange._reply.empty_table())
    assert len(calls) == 4
