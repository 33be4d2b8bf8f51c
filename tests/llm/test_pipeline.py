"""Stage by stage against plain Python, each on its own input."""

import random

import corpus_pipeline as P
import pytest
from llm_helpers import edge_texts, sentence
from pyspark.sql import functions as F
from test_decontamination import expected as contaminated
from test_near_duplicates import expected as linked
from test_substrings import expected as cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("corpus"))
    texts = [t if t is None else t[:5000] for t in edge_texts(9)]
    clean, bad = [sentence(rng, 70) for _ in range(120)], []
    for _ in range(60):
        t = sentence(rng, 60).split()
        for _ in range(5):
            t.insert(rng.randrange(60), rng.choice(["vilest", "grubling", "snarlhound"]))
        bad.append(" ".join(t))
    item = sentence(rng, 25)
    texts += clean + bad + [f"{sentence(rng, 30)} {item} {sentence(rng, 30)}"]
    first = len(texts) - 61
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", None, None, 5), (None, None, None, None, None), (None, clean[3], "en", "s1", 1), (None, clean[4] + " tail", "de", None, None)]
    rows += [(rows[30][0], sentence(rng, 70), "en", "s1", 3)]  # two texts of one id
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(first <= i < first + 60)) for i in range(len(texts)) if i % 10]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, set(range(first, first + 60)), len(texts) - 1


def test_every_stage(spark, folder, tmp_path):
    path, toxic, leaked = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before = docs.collect()
        made = stage(spark, docs, path)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
        kept[name] = (before, docs.collect())
    ids = lambda rows: {r.doc_id for r in rows}

    before, after = kept["toxicity"]
    assert len((ids(before) - ids(after)) & toxic) >= 58 and len(ids(before) - ids(after) - toxic) <= 1
    before, after = kept["ngram_jaccard_join"]
    named = sorted({tuple(r) for r in before}, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    low = linked([r[1] for r in named])
    assert sorted(map(str, (tuple(r) for r in after))) == sorted(str(named[i]) for i in range(len(named)) if low[i][1] == i)
    assert sum(r.doc_id is None for r in after) == 2  # the copies of named documents go
    before, after = kept["suffix_array_dedup"]
    want = cut([r.text for r in before], 200)
    assert sorted((str(r.doc_id), w[0] - w[1]) for r, w in zip(before, want.values())) == sorted((str(r.doc_id), len(r.text.encode())) for r in after)
    before, after = kept["benchmark_decontamination"]
    item = [(1, spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first().text)]
    hits = contaminated([r.text for r in before], item)
    assert sorted(str(r.doc_id) for r, h in zip(before, hits.values()) if not h[1]) == sorted(str(r.doc_id) for r in after)
    assert leaked in ids(before) - ids(after)
    before, after = kept["source_mix"]
    assert len(before) == len(after) and all(r.taken <= 2 * r["size"] for r in after)
    assert abs(sum(r.taken for r in after) - 1.5 * sum(r["size"] for r in after)) < 3


def test_run_on_given_tables(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert 100 < rows.n == rows.d <= 200
