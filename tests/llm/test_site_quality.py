from gyre.llm.site_quality import site_quality
from llm_helpers import documents, edge_texts
from pyspark.sql import functions as F


def test_sites_shift_sparse_documents(spark):
    good, junk = "Some plain words make a calm sentence here", "$$$ *** 111 !!! ### 222 %%% ***"
    texts = [good] * 60 + [junk] * 60 + ["middle words 12 !"] * 2 + edge_texts()
    source = {i: "clean" if i < 60 else "dirty" for i in range(120)} | {120: "clean", 121: "dirty"} | {i: None for i in range(122, 130)}
    docs = documents(spark, texts, source=source)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (1, None), (4, 0), (4, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in site_quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(rows) == len(texts) and all(0 < r.quality < 1 for r in rows.values())
    assert all(rows[i].keep for i in range(60)) and not any(rows[i].keep for i in range(60, 120))
    assert rows[120].evidence == rows[121].evidence and rows[120].quality > rows[121].quality


def test_unlabelled_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = site_quality(documents(spark, ["a b", None]), none, F.col("source"), F.col("lang")).collect()
    assert all(abs(r.quality - 0.5) < 1e-9 for r in rows)
    assert site_quality(documents(spark, []).limit(0), none, F.col("source"), F.col("lang")).collect() == []
