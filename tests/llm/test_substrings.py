import hashlib
from collections import Counter

import pytest
from gyre.llm.substrings import remove_repeats
from llm_helpers import documents, edge_texts


def expected(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = {}
    for i, b in enumerate(raw):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [200, 40])
def test_equals_brute_force(spark, length):
    texts = [t if t is None else t[:6000] for t in edge_texts(3)]
    rows = remove_repeats(documents(spark, texts), length=length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected(texts, length)


def test_text_and_columns_are_carried(spark):
    texts = ["é" * 150, "Z" + "é" * 150, "unique", None]
    rows = sorted(remove_repeats(documents(spark, texts), with_text=True).collect(), key=lambda r: r.doc_id)
    assert [r.kept_text for r in rows] == ["", "Z", "unique", ""]
    assert all(r.row.doc_id == r.doc_id and r.row.key == "k" and r.row.row == "x" for r in rows)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, []).limit(0)).collect() == []
