import random
import zlib
from collections import Counter, defaultdict

import pytest
from gyre.llm.sharding import OVERHEAD, op12_histogram_shards, sharded, write_shards
from llm_helpers import documents, edge_texts, sentence


def check_law(rows, shards, law, tolerance=0.01):
    size = lambda t: len((t or "").encode()) + OVERHEAD
    held = defaultdict(list)
    for r in rows:
        assert r["size"] == size(r.row.text) and 0 <= r.shard < shards
        held[r.shard].append(r)
    for rows_of in held.values():
        assert sorted(r.slot for r in rows_of) == list(range(len(rows_of)))
    weight = [sum(r["size"] if law == "bytes" else 1 for r in held[s]) for s in range(shards)]
    if law == "rows":
        assert max(weight) - min(weight) <= 1
    else:
        mean = sum(weight) / shards
        assert max(abs(w - mean) for w in weight) <= 2 * tolerance * mean + max(r["size"] for r in rows)
    return held


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_edge_rows_keep_the_law(spark, law):
    texts = edge_texts(3) * 3
    docs = documents(spark, texts, ids={0: None, 1: None, 5: 7})
    rows = sharded(docs, shards=7, law=law).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.sig) for r in rows) == Counter((r.doc_id, r.text, r.sig) for r in docs.collect())
    held = check_law(rows, 7, law)
    order = [t for s in range(7) for t in (r.row.text for r in sorted(held[s], key=lambda r: r.slot))]
    starts = [t for i, t in enumerate(order) if i == 0 or order[i - 1] != t]
    assert len(starts) == len(set(starts))  # equal texts are neighbours in the order of shards and slots


def test_a_group_of_a_third_of_all_rows_is_cut_and_others_stay_whole(spark):
    rng = random.Random(4)
    texts = ["hot " * 40] * 700 + [t for t in (sentence(rng, 30) for _ in range(350)) for _ in range(4)]
    rows = sharded(documents(spark, texts).repartition(3), shards=10, tolerance=0.05).collect()
    held = check_law(rows, 10, "bytes", 0.05)
    of = defaultdict(set)
    for s, some in held.items():
        for r in some:
            of[r.row.text].add(s)
    assert len(of.pop(texts[0])) >= 3
    assert all(len(x) == 1 for x in of.values())


def test_rows_equal_in_every_column(spark):
    docs = documents(spark, ["same words"] * 90, ids={i: 1 for i in range(90)})
    check_law(sharded(docs, shards=9).collect(), 9, "rows")


def test_fewer_rows_than_shards_and_none(spark):
    docs = documents(spark, ["a", "b", None])
    check_law(sharded(docs, shards=40, law="rows").collect(), 40, "rows")
    assert len(sharded(docs).collect()) == 3
    assert sharded(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharded(docs, law="colour")


def test_written_shards_hold_the_texts(spark, tmp_path):
    docs = documents(spark, edge_texts(5))
    write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_query_on_given_table(spark):
    rows = op12_histogram_shards(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.text_crc32 for r in rows} == {i: zlib.crc32(t.encode()) for i, t in docs.items()}
    assert len(rows) == len(docs) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
