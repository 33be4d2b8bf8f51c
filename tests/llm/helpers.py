"""Small frames and plain-Python counterparts shared by the tests of the text operators."""

import random
import re

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, row string, chunk int, n_words int, key string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(spark, texts, **columns):
    rows = []
    for i, t in enumerate(texts):
        lang, source = columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, f"s{i % 3}")
        rows.append((columns.get("ids", {}).get(i, i), t, lang, source, None if t is None else len(t), 1, "x", 2, None, "k"))
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts(seed=1):
    """Copies, near copies, shared passages, empty, blank, null, tiny and very long texts."""
    rng = random.Random(seed)
    base = [sentence(rng, 80) for _ in range(6)]
    passage = sentence(rng, 60)
    near = base[0].split()
    near[5] = "changed"
    far = base[0].split()
    far[::6] = ["x"] * len(far[::6])
    texts = [*base, base[0], base[0], " ".join(near), " ".join(far), f"{base[1]} {passage}", f"{passage} {base[2]}", passage]
    texts += ["", None, "   \n\t", "one two", "One TWO", "one two three", "é" * 300, "a" * 450, "!!! ***", "x " * 3000]
    texts += [f"{sentence(rng, 2500)} {passage}", "Größe ÉTÉ naïve", None, ""]
    return texts


def words(text, pattern):
    return re.findall(pattern, (text or "").encode().translate(LOWER))
