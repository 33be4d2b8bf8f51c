import hashlib

from gyre.llm.decontamination import contamination
from llm_helpers import documents, edge_texts, words

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def expected(texts, items):
    windows = []
    for item, t in items:
        w = words(t, WORD)
        n = min(10, len(w))
        windows += [(tuple(w[k : k + n]), item) for k in range(len(w) - n + 1) if n]
    out = {}
    for i, t in enumerate(texts):
        w, hit, names = words(t, WORD), set(), set()
        for window, item in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names |= {str(item)} if item is not None else set()
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out


def test_equals_brute_force_in_one_block_or_many(spark):
    texts = edge_texts(5)
    w = texts[3].split()
    items = [(1, " ".join(w[10:35]).upper()), (10, " ".join(w[20:32])), (2, "ONE... two"), (3, ""), (4, None), (None, " ".join(w[50:61])), (5, "größe"), (1, texts[4])]
    items += [(7, "a b c"), (8, texts[12])]
    texts += [" ".join(["pad"] * 5 + w[15:40] + ["pad"] + w[15:40]), "one two one two one", " ".join(w[10:19])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (100_000, 40):
        rows = contamination(documents(spark, texts), benchmark, block_windows=block).collect()
        assert {r.row.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows} == expected(texts, items)
        assert all(r.contaminated == (r.n_hit > 0) and r.row.key == "k" for r in rows)


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(documents(spark, []).limit(0), benchmark).collect() == []
    rows = contamination(documents(spark, ["a b", None]), benchmark.limit(0)).collect()
    assert [(r.n_hit, r.n_items) for r in rows] == [(0, 0), (0, 0)]
