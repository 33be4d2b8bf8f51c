import random
import re
from collections import Counter

import pytest
from gyre.llm.collocations import collocations
from llm_helpers import LOWER, documents, edge_texts


def expected(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from all n-grams; rows are (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {key: a for key, a in counts.items() if a >= least}
    found = {}
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        inside = max((b for (other, longer), b in often.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))), default=0)
        if 100 * inside >= 80 * a:
            continue
        score, k = min((2000000 * a // (often[lang, words[:k]] + often[lang, words[k:]]), k) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, b" ".join(words), often[lang, words[:k]], often[lang, words[k:]]))
    out = []
    for lang, some in found.items():
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(some)[:top])]
    return sorted(out)


def mined(spark, rows, **options):
    docs = documents(spark, [t for _, t in rows], lang={i: x for i, (x, _) in enumerate(rows)}).repartition(3)
    return sorted(tuple(r) for r in collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = "new york stock exchange of the and größe Été x y z".split() + [f"w{k}" for k in range(300)]
    weights = [30] * 12 + [1] * 300
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 8)):
            parts.append(rng.choice(["New York Stock Exchange", "new york", "the  of\tthe", " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 9)))]))
        out.append("".join(p + rng.choice([" ", ". ", ",", "\n", "!", "\r\n", " ; "]) for p in parts))
    return out


@pytest.mark.parametrize("least", [2, 30])
def test_equals_counting_every_phrase(spark, least):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), t) for t in texts(9, 250)] + [("en", t) for t in edge_texts(2)]
    rows += rows[:40]
    got, want = mined(spark, rows, least=least), expected(rows, least)
    assert got == want and len(want) > 5


def test_top_and_ties(spark):
    rows = [("en", f"a{k % 10} b{k % 10}") for k in range(100)]
    assert mined(spark, rows, least=5, top=4) == expected(rows, 5, 4)
    assert [r[2] for r in mined(spark, rows, least=5, top=4)] == ["a0 b0", "a1 b1", "a2 b2", "a3 b3"]


def test_no_words(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, ""), ("en", " .,\t")]) == []
    assert mined(spark, [("en", "one two")]) == []
