import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet
import pytest
from gyre.llm import ranked_search as S
from llm_helpers import documents, edge_texts, sentence, words

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def expected(rows, items, top=20):
    """(item, rank, doc_id, score) by reading every document; rows are (doc_id, text)."""
    counts = [Counter(words(t, TERM)) for _, t in rows]
    n = sum(bool(c) for c in counts)
    length = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(words(text, TERM)), []
        for (doc, _), c in zip(rows, counts):
            m = 75 + (25 * sum(c.values()) * n) // length if length else 0
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(found[:top])]
    return sorted(out, key=str)


def searched(spark, rows, items, range_bytes=S.RANGE_BYTES, **options):
    docs = documents(spark, [t for _, t in rows], ids={i: d for i, (d, _) in enumerate(rows)}).repartition(3)
    index, n = S.build_index(docs, range_bytes=range_bytes)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in S.search(index, n, asked, **options).collect()), key=str)


@pytest.mark.parametrize("range_bytes", [300, 5000, S.RANGE_BYTES])
def test_equals_reading_every_document(spark, range_bytes):
    rng = random.Random(6)
    texts = edge_texts(6) + [" ".join(rng.choice("the of and zebra lion tiger bear ant".split()) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(None, "zebra lion"), (None, "zebra lion"), (5, "zebra lion"), (5, "zebra lion")]
    items = [(1, "the Zebra of the lion"), (2, "ANT ant ant bear"), (3, None), (4, ""), (5, "unknownword"), (6, texts[0]), (7, "größe été"), (7, "bear"), (None, "tiger")]
    assert searched(spark, rows, items, range_bytes) == expected(rows, items)


def test_items_in_blocks_and_a_shorter_top(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 25)) for i in range(300)]
    items = [(i, sentence(rng, 12)) for i in range(23)]
    assert searched(spark, rows, items, 2000, top=5, block=4) == expected(rows, items, 5)


def test_equal_scores_go_by_id(spark):
    rows = [(i, "same words here") for i in range(60)] + [(100 + i, "other text") for i in range(5)]
    found = searched(spark, rows, [(1, "words")], 200)
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(20))


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "word")]) == []
    assert searched(spark, [(1, "word")], []) == []
    assert searched(spark, [(1, None), (2, "  ")], [(1, "word")]) == []


def long_batch(n=400, size=200):
    rng = random.Random(8)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([sentence(rng, size) for _ in range(n)])], names=["doc_id", "text"])


def test_a_batch_is_read_range_by_range(monkeypatch):
    batch, read, given = long_batch(), [], []
    limit = batch.column("text").nbytes // 5
    terms = S._terms
    monkeypatch.setattr(S, "_terms", lambda column: read.append(column.slice(0).nbytes) or terms(column))
    monkeypatch.setattr(S, "give_back", lambda: given.append(1), raising=False)
    rows = list(S._indexed(400, 80000, limit)(iter([batch])))
    assert len(rows) > 4 and max(read) <= limit + 4 * 401
    assert len(given) > len(rows)


def test_index_leaves_the_worker_smaller_than_its_texts():
    rng = random.Random(9)
    common = sentence(rng, 3000).split()
    texts = pa.array([" ".join(common[int(3000 * rng.random() ** 3)] for _ in range(400)) for _ in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), texts], names=["doc_id", "text"])
    (row,) = S._indexed(300, 120000, S.RANGE_BYTES)(iter([batch]))
    assert row.nbytes < 0.8 * texts.nbytes


def test_index_is_cut_into_row_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 4000, raising=False)
    docs = documents(spark, [sentence(random.Random(i), 60) for i in range(90)]).coalesce(1)
    index, _ = S.build_index(docs, range_bytes=2000)
    (file,) = index.inputFiles()
    meta = pa.parquet.ParquetFile(file.removeprefix("file://")).metadata
    assert meta.num_rows > 6
    assert meta.num_row_groups >= meta.num_rows // 2
