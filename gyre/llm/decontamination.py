"""Operator 6: benchmark decontamination as a prefix-filtered set join on item-sized windows.

A window is `size` consecutive words of an item, or all words of a shorter item. Its set is its
shingles of up to `shingle` words, ordered by how many documents hold them; full containment makes
the necessary prefix one token, the rarest shingle. Documents are probed for these tokens only; a hit gives
the window's one possible place (position bound), which must lie inside the document (length
bound), and every word of the window is compared there.

Windows are sent to the tasks in blocks of at most `block_windows`; a larger benchmark takes more
scans, whose findings are merged by document, never a larger broadcast. Rarity is counted over
all documents. Texts are read whole, in blocks of about a MB, and never shuffled.

Null and empty texts have no words, hits or items. Items without words have no windows. Items of
null id hit words but have no name. Rows of the same item id count as one item; repeated
document rows each get their row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm import text as X
from gyre.llm.exchange import give_back
from gyre.session import cut_lineage

SIZE = 10
SHINGLE = 3
BLOCK_WINDOWS = 100_000


def _words(column):
    """(first row, word hashes, first word of each document) of blocks of a batch."""
    data, offsets = X.batch_bytes(column)
    for lo, hi in X.blocks(offsets):
        part = X.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = X.word_spans(part, offsets[lo : hi + 1] - offsets[lo], X.ALNUM)
        yield lo, X.word_hashes(part, starts, ends), first


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    n = max(len(words) - size + 1, 0)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(size):
        out += words[j : j + n] * np.uint64(factor)
        factor = factor * X.BASE & (2**64 - 1)
    return X.salted(out, size)


def _windows(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            out = []
            for lo, words, first in _words(batch.column("text")):
                for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    length = min(size, int(b - a))
                    for k in range(a, b - length + 1) if length else ():
                        out.append((X.packed(words[k : k + length]), ids[lo + i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.int64())], names=["words", "item_id"]
            )

    return run


class _Probe:
    """Ascending tokens by shingle length with a bit table before the search."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        self.by = {}
        for s in np.unique(lengths):
            own = np.flatnonzero(lengths == s)
            own = own[np.argsort(tokens[own])]
            maybe = np.zeros(1 << 20, bool)
            maybe[tokens[own] >> np.uint64(44)] = True
            self.by[int(s)] = (tokens[own], own, maybe)

    def find(self, words: np.ndarray, first: np.ndarray):
        """(word position, token number) of every token in the documents of a block."""
        stop = np.repeat(first[1:], np.diff(first))
        for s, (tokens, own, maybe) in self.by.items():
            rolled = _rolled(words, s)
            at = np.flatnonzero(maybe[rolled >> np.uint64(44)])
            at = at[at + s <= stop[at]]
            place = np.searchsorted(tokens, rolled[at])
            place[place == len(tokens)] = 0
            good = tokens[place] == rolled[at]
            yield at[good], own[place[good]]


def _shingles_of(window: np.ndarray, shingle: int) -> tuple[np.ndarray, int]:
    s = min(shingle, len(window))
    return _rolled(window, s), s


def _frequency(shared):
    def run(batches):
        tokens, lengths = shared.value
        probe, total = _Probe(tokens, lengths), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, words, first in _words(batch.column("text")):
                for at, token in probe.find(words, first):
                    doc = np.searchsorted(first, at, "right") - 1
                    seen = np.unique(doc * len(tokens) + token)
                    np.add.at(total, seen % len(tokens), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["token", "df"])

    return run


def _find(shared, text_col: str):
    """Spans and items of every row; the text is a column of its own or a field of `row`."""

    def run(batches):
        tokens, lengths, window_of, offset_of, begin, matrix, size_of, items_of = shared.value
        probe = _Probe(tokens, lengths)
        for batch in batches:
            give_back()
            n = batch.num_rows
            n_words, spans, items = np.zeros(n, np.int64), [b""] * n, [None] * n
            text = batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text_col)
            for lo, words, first in _words(text):
                n_words[lo : lo + len(first) - 1] = np.diff(first)
                hits = []
                for at, token in probe.find(words, first):
                    fan = begin[token + 1] - begin[token]
                    if not fan.sum():
                        continue
                    entry = np.repeat(begin[token], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                    window, start = window_of[entry], np.repeat(at, fan) - offset_of[entry]
                    doc = np.repeat(np.searchsorted(first, at, "right") - 1, fan)
                    inside = (start >= first[doc]) & (start + size_of[window] <= first[doc + 1])
                    window, start, doc = window[inside], start[inside], doc[inside]
                    for k in range(matrix.shape[1]):
                        long = size_of[window] > k
                        same = ~long
                        same[long] = words[start[long] + k] == matrix[window[long], k]
                        window, start, doc = window[same], start[same], doc[same]
                    hits.append((doc, start - first[doc], window))
                if not hits:
                    continue
                doc, start, window = (np.concatenate(x) for x in zip(*hits))
                order = np.lexsort((start, doc))
                doc, start, window = doc[order], start[order], window[order]
                for d in np.unique(doc):
                    a, b = np.searchsorted(doc, [d, d + 1])
                    both = np.unique(np.stack([start[a:b], start[a:b] + size_of[window[a:b]]], 1), axis=0)
                    spans[lo + d] = X.packed(both.astype(np.int64))
                    items[lo + d] = sorted({i for w in np.unique(window[a:b]) for i in items_of[w]})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(n_words), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))],
                names=[*(c for c in batch.schema.names if c != "text"), "n_words", "spans", "items"],
            )
        batch = text = words = hits = probe = None
        give_back()

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    shingle: int = SHINGLE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """`row` (a struct of all columns of `docs`), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    given = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    windows = given.mapInArrow(_windows(size), "words binary, item_id long").groupBy("words").agg(F.collect_set("item_id").alias("items"))
    windows = cut_lineage(windows)
    blocks = max(1, -(-windows.count() // block_windows))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"))
    if blocks > 1:  # findings of several scans meet by text, and only those of texts with hits
        keyed = texts.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("row"), "text")
    found = []
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).orderBy("words").collect()
        rows = [np.frombuffer(r["words"], np.uint64) for r in part]
        made = [_shingles_of(w, shingle) for w in rows]
        tokens, place = np.unique(np.concatenate([t for t, _ in made]) if made else np.zeros(0, np.uint64), return_inverse=True)
        lengths = np.zeros(len(tokens), np.int64)
        lengths[place] = np.concatenate([np.full(len(t), s) for t, s in made]) if made else []
        df = np.zeros(len(tokens), np.int64)
        counted = texts.mapInArrow(_frequency(spark.sparkContext.broadcast((tokens, lengths))), "token int, df long")
        for r in counted.groupBy("token").agg(F.sum("df").alias("df")).collect():
            df[r["token"]] = r["df"]
        chosen, offset, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
        for i, (own, _) in enumerate(made):
            mine = place[at : at + len(own)]
            best = int(np.lexsort((tokens[mine], df[mine]))[0])
            chosen[i], offset[i], at = mine[best], best, at + len(own)
        order = np.argsort(chosen, kind="stable")
        begin = np.searchsorted(chosen[order], np.arange(len(tokens) + 1))
        matrix = np.zeros((len(rows), size), np.uint64)
        for i, w in enumerate(rows):
            matrix[i, : len(w)] = w
        used = np.unique(chosen)
        used_begin = np.append(begin[used], len(order)) if len(used) else np.zeros(1, np.int64)
        shared = spark.sparkContext.broadcast(
            (tokens[used], lengths[used], order, offset[order], used_begin, matrix, np.array([len(w) for w in rows], np.int64), [r["items"] for r in part])
        )
        schema = T.StructType([keyed.schema["row"]]).add("n_words", "long").add("spans", "binary").add("items", T.ArrayType(T.LongType()))
        found.append(keyed.mapInArrow(_find(shared, text_col), schema))
    if blocks == 1:
        lists = found[0].select("row", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        hit = [f.where("items is not null").dropDuplicates(["row"]).drop("n_words") for f in found]
        grouped = reduce(DataFrame.union, hit).groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        all_rows = docs.select(F.struct(*docs.columns).alias("own"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("row"))
        sizes = found[0].select("row", "n_words").dropDuplicates(["row"])
        lists = all_rows.join(sizes, "row").join(grouped, "row", "left").select(F.col("own").alias("row"), "n_words", "spans", "items")
    done = T.StructType([lists.schema["row"]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")
    out = lists.mapInArrow(_union_hits, done)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _union_hits(batches):
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            both = np.concatenate([X.unpacked(s, np.int64).reshape(-1, 2) for s in spans or [b""]])
            both = both[np.argsort(both[:, 0], kind="stable")]
            ends = np.maximum.accumulate(both[:, 1]) if len(both) else both[:, 1]
            before = np.concatenate([[0], ends[:-1]]) if len(both) else ends
            n_hit.append(int(np.maximum(ends - np.maximum(both[:, 0], before), 0).sum()))
            names = sorted({str(i) for part in items or [] for i in part or []})
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest)],
            names=["row", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {SIZE}) AS size,
              array_to_string(w[k:k + least(len(w), {SIZE}) - 1], ' ') AS win
       FROM i, unnest(range(1, greatest(len(w) - {SIZE} + 1, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT r, k, size, item_id FROM dw JOIN iw USING (size, win)),
hw AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, size)) AS u(j) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
       FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""",
}
QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
