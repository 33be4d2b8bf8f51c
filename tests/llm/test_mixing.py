import math
import re

from gyre.llm.mixing import mixed
from llm_helpers import documents, edge_texts


def test_targets_and_budgets(spark):
    texts = edge_texts(7) * 2
    source = {i: [None, "a", "b", "ä", "c"][i % 5] for i in range(len(texts))}
    rows = mixed(documents(spark, texts, source=source)).collect()
    size = {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in rows} == size
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    weight = dict(zip(["a", "b", "c", "ä", None], [5, 2, 1, 5, 2]))
    left, capped = 1.5 * sum(total.values()), set()
    while True:
        level = left / sum(weight[s] for s in total if s not in capped)
        over = {s for s in total if s not in capped and level * weight[s] >= 2 * total[s]}
        if not over:
            break
        capped |= over
        left -= sum(2 * total[s] for s in over)
    for s in total:
        own = [r for r in rows if source[r.doc_id] == s]
        target = 2 * total[s] if s in capped else level * weight[s]
        assert all(math.isclose(r.target, target) and r.source_size == total[s] for r in own)
        assert sum(r.taken for r in own) == round(target)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    again = {r.doc_id: r.taken for r in mixed(documents(spark, texts, source=source).repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_heavier_documents_come_first(spark):
    texts = ["w " * 10] * 400
    from pyspark.sql import functions as F

    docs = documents(spark, texts, source={i: "s" if i < 300 else "t" for i in range(400)})
    rows = mixed(docs, quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2), share=0.5).collect()
    heavy, light = (sum(r.taken for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert heavy > 2 * light


def test_empty_and_wordless(spark):
    assert mixed(documents(spark, []).limit(0)).collect() == []
    assert [(r["size"], r.taken, r.target) for r in mixed(documents(spark, ["", None])).collect()] == [(0, 0, 0.0), (0, 0, 0.0)]
