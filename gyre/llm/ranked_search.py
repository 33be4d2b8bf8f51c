"""Operator 11: ranked lexical search in K2-treaps over the term-document grid.

Index: a range of documents is a grid with a row for each of its terms and a column for each document. Its points
are the (term, document) pairs; quadrants are split level by level, empty ones take no space, and every cell holds the largest
impact below it (rounded up to 16 bits). A range is one row of the index table: child masks of the cells in breadth-first
order, their maxima, the term frequencies at the leaves, and the hashes of its terms. Rows are ordered by document
frequency and columns by which frequent terms they hold, so that cells are alike inside. Ranges are cut by
bytes inside each scan task; texts are never shuffled, and no range grows with the corpus. Arrays are compressed before they leave
the worker, and the table's row groups hold a range or two: Spark reads a row group of such rows at once, whatever its size.

Search: an item follows the rows of its terms, all at once. A stretch of documents at some depth is bounded by the sum
of weight times maximum over the cells where the rows meet it; the stretches with the highest bounds are opened
first, and what cannot reach the item's lowest kept score is left closed. A task carries the kept scores from range to range. Equal scores
are ordered by id, so a stretch whose bound equals the lowest kept score is still opened. Leaves are scored
exactly in 64-bit integers. Items are taken in blocks of `BLOCK_ITEMS`, which bounds what a task is sent.

The impact of a term in a document is (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; the weight of a term, floor(1000 ln((2N+2) / (2df+1)))
from the whole corpus, is applied by the search. Terms are known by 64-bit hashes of their bytes: with 10^4 terms asked and 10^9
in the corpus, the expected number of wrong meetings is 10^13 / 2^64, under 10^-6.

Null or blank texts have no term and are in no range; a null id ranks behind other ids of the same score; repeated rows are documents of
their own. An item without text, or whose terms no document holds, has no rows; repeated items are
answered each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm.exchange import give_back, written
from gyre.llm.text import ALNUM, LOWER, batch_bytes, blocks, word_hashes, word_spans

TOP = 20
RANGE_BYTES = 8 << 20  # text of a range; a longer document is a range of its own
GROUP_BYTES = 4 << 20  # a row group of the index ends behind the range that reaches this
BLOCK_ITEMS = 2000
FREQUENT = 24  # terms whose presence orders the documents of a range
STEP = 32  # stretches opened at a time
INDEX = "ids binary, null_ids binary, norms binary, terms binary, term_rows binary, df binary, height int, masks binary, maxima binary, tf binary"
_index = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in INDEX.split(", ")])
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)
_ZSTD = pa.Codec("zstd", 3)
_NO_ID = np.iinfo(np.int64).max


def _blob(x: np.ndarray, kind) -> bytes:
    """The values as their number of bytes and a compressed block."""
    raw = np.ascontiguousarray(x.astype(kind)).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _values(blob: pa.Buffer, kind) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(blob[8:], int.from_bytes(blob[:8].to_pybytes(), "little")), kind)


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, in order, and the first of each text (n + 1 values)."""
    data, offsets = batch_bytes(column)
    hashes, firsts, seen = [], [np.zeros(1, np.int64)], 0
    for a, b in blocks(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], ALNUM)
        hashes.append(word_hashes(part, starts, ends))
        firsts.append(first[1:] + seen)
        seen += len(starts)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(firsts)


def _sizes(batches):
    """Documents with a term, and terms, of a task."""
    n, total = 0, 0
    for batch in batches:
        data, offsets = batch_bytes(batch.column("text"))
        for a, b in blocks(offsets):
            part = data[offsets[a] : offsets[b]]
            counts = np.diff(word_spans(part, offsets[a : b + 1] - offsets[a], ALNUM)[2])
            n, total = n + int((counts > 0).sum()), total + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^32 at every second place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _treap(ids: np.ndarray, null_ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The index row of a range: `counts` terms of each document, one after the other in `hashes`."""
    norms = 75 + (25 * counts * n_docs) // n_terms
    terms, inverse = np.unique(hashes, return_inverse=True)
    docs = len(ids)
    pairs, tf = np.unique(inverse.astype(np.int64) * docs + np.repeat(np.arange(docs), counts), return_counts=True)
    term, doc = pairs // docs, pairs % docs
    df = np.bincount(term, minlength=len(terms))
    rows = np.empty(len(terms), np.int64)
    order = np.argsort(-df, kind="stable")
    rows[order] = np.arange(len(terms))
    near = rows[term] < FREQUENT
    holds = np.zeros(docs, np.int64)
    np.bitwise_or.at(holds, doc[near], np.int64(1) << (FREQUENT - 1 - rows[term[near]]))
    columns = np.empty(docs, np.int64)
    by_likeness = np.lexsort((norms, holds))
    columns[by_likeness] = np.arange(docs)
    height = max(1, int(max(len(terms) - 1, docs - 1)).bit_length())
    cells = (_spread(rows[term]) << np.uint64(1)) | _spread(columns[doc])
    leaf = np.argsort(cells)
    cells, tf = cells[leaf], tf[leaf].astype(np.int64)
    highest = (impact(tf, norms[doc[leaf]]) + 15) >> 4
    masks, maxima = [], []
    for _ in range(height):
        parents = cells >> np.uint64(2)
        cuts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (cells & np.uint64(3)).astype(np.uint8), cuts))
        highest = np.maximum.reduceat(highest, cuts)
        maxima.append(highest.astype(np.uint16))
        cells = parents[cuts]
    row = (
        _blob(ids[by_likeness], np.int64),
        _blob(null_ids[by_likeness], bool),
        _blob(norms[by_likeness], np.int64),
        _blob(terms, np.uint64),
        _blob(rows, np.uint32),
        _blob(df, np.uint32),
        height,
        _blob(np.concatenate(masks[::-1]), np.uint8),
        _blob(np.concatenate(maxima[::-1]), np.uint16),
        _blob(tf, np.uint32),
    )
    return pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip(row, _index)], schema=_index)


def _indexed(n_docs: int, n_terms: int, range_bytes: int):
    def run(batches):
        kept, size = [], 0

        def full():
            nonlocal kept, size
            columns, kept, size = list(zip(*kept)), [], 0
            row = _treap(*(np.concatenate(x) for x in columns), n_docs, n_terms)
            del columns
            give_back()
            return row

        give_back()
        for batch in batches:
            column, texts = batch.column("doc_id"), batch.column("text")
            nulls, ids = np.asarray(column.is_null()), np.asarray(column.fill_null(_NO_ID))
            length, begin = np.diff(batch_bytes(texts)[1]), 0
            while begin < len(ids):
                room = np.searchsorted(np.cumsum(length[begin:]), max(range_bytes - size, 0), "right")
                end = min(len(ids), begin + max(int(room), 0 if kept else 1))
                hashes, first = _terms(texts.slice(begin, end - begin))
                counts = np.diff(first)
                have = np.flatnonzero(counts)
                if len(have):
                    kept.append((ids[begin + have], nulls[begin + have], hashes, counts[have]))
                del hashes
                size += int(length[begin:end].sum())
                begin = end
                if begin < len(ids):
                    if kept:
                        yield full()
                    size = 0
            del batch, column, texts
        if kept:
            yield full()
        give_back()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """The index table, written to the shared folder, and the number of documents that hold a term."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    n, total = texts.select("text").mapInArrow(_sizes, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    index = texts.mapInArrow(_indexed(n or 0, total or 1, range_bytes), INDEX)
    return written(index, **{"compression": "uncompressed", "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1}), n or 0


class _Range:
    """A row of the index, unpacked."""

    def __init__(self, row: dict):
        take = lambda c, kind: _values(row[c], kind)
        self.ids, self.null_ids, self.norms = take("ids", np.int64), take("null_ids", bool), take("norms", np.int64)
        self.terms, self.term_rows, self.height = take("terms", np.uint64), take("term_rows", np.uint32), row["height"]
        self.masks, self.maxima, self.tf = take("masks", np.uint8), take("maxima", np.uint16), take("tf", np.uint32)
        bits = _BITS[self.masks]
        self.child = np.cumsum(bits, dtype=np.int32 if len(bits) < 1 << 29 else np.int64)
        self.child -= bits
        self.child += 1

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term, -1 where the range does not hold it."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.term_rows[at].astype(np.int64), -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, top: int, kept: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """`kept` (scores, ids, null ids; best first) with this range's documents."""
        bound, depth, column = np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        nodes, step = np.zeros((1, len(rows)), np.int64), 4
        while len(bound):
            floor = kept[0][-1] if len(kept[0]) == top else 1
            alive = bound >= floor
            if not alive.all():
                bound, depth, column, nodes = bound[alive], depth[alive], column[alive], nodes[alive]
                if not len(bound):
                    break
            if len(bound) > step:
                order = np.argpartition(-bound, step)
                now, later = order[:step], order[step:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            step = min(STEP, 2 * step)
            at, level, begin = nodes[now], depth[now], column[now]
            row_bit = (rows[None, :] >> (self.height - 1 - level)[:, None]) & 1
            there = at >= 0
            mask, child = np.where(there, self.masks[at], 0), self.child[at]
            last = level == self.height - 1
            parts = [(bound[later], depth[later], column[later], nodes[later])]
            for bit in (0, 1):
                quarter = 2 * row_bit + bit
                has = (mask >> quarter) & 1 == 1
                below = np.where(has, child + _BITS[mask & ((1 << quarter) - 1)], -1)
                ahead = 2 * begin + bit
                some = has.any(axis=1)
                inner, leaves = np.flatnonzero(some & ~last), np.flatnonzero(some & last)
                if len(inner):
                    limit = np.where(has[inner], self.maxima[below[inner]].astype(np.int64) << 4, 0) @ weights
                    parts.append((limit, level[inner] + 1, ahead[inner], below[inner]))
                if len(leaves):
                    doc = ahead[leaves]
                    tf = self.tf[np.where(has[leaves], below[leaves] - len(self.masks), 0)].astype(np.int64)
                    score = np.where(has[leaves], impact(tf, self.norms[doc][:, None]), 0) @ weights
                    found = score > 0
                    merged = [np.concatenate(x) for x in zip(kept, (score[found], self.ids[doc[found]], self.null_ids[doc[found]]))]
                    order = np.lexsort((merged[1], merged[2], -merged[0]))[:top]
                    kept = tuple(x[order] for x in merged)
            bound, depth, column, nodes = (np.concatenate(x) for x in zip(*parts))
        return kept


def _rows_of(batches, columns):
    """Rows as views of their batch; nothing is copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            cells = {c: batch.column(c)[i] for c in columns}
            yield {c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c, x in cells.items()}


def _frequencies(asked: np.ndarray):
    def run(batches):
        for row in _rows_of(batches, ("terms", "df")):
            terms, df = _values(row["terms"], np.uint64), _values(row["df"], np.uint32)
            at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
            here = np.flatnonzero(terms[at] == asked)
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(df[at[here]].astype(np.int64))], names=["term", "df"])

    return run


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], top: int):
    def run(batches):
        give_back()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        kept = {no: none for no, _, _ in items}
        for row in _rows_of(batches, _index.names):
            index = _Range(row)
            for no, terms, weights in items:
                rows = index.rows(terms)
                here = rows >= 0
                if here.any():
                    kept[no] = index.best(rows[here], weights[here], top, kept[no])
            del index, row
            give_back()
        for no, (score, ids, nulls) in kept.items():
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), no), pa.int64()), pa.array(ids, mask=nulls), pa.array(score)], names=["item", "doc_id", "score"]
                )

    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of every row of `items`."""
    spark, out = index.sparkSession, []
    schema = "item long, doc_id long, score long"
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    for rows in batched(asked.toLocalIterator(), block):
        hashes, first = _terms(pa.array([r["text"] for r in rows], pa.large_string()))
        terms, inverse = np.unique(hashes, return_inverse=True)
        if not len(terms):
            continue
        df = np.zeros(len(terms), np.int64)
        for r in index.select("terms", "df").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        plan = []
        for no, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            term, times = np.unique(inverse[a:b], return_counts=True)
            gain = weights[term] * times
            plan.append((no, terms[term][gain > 0], gain[gain > 0]))
        found = index.mapInArrow(_searched([x for x in plan if len(x[1])], top), schema)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(no, r["item_id"]) for no, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, n, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS d, {_TERMS} AS terms FROM documents),
sizes AS (SELECT d, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, big_n),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT i, item_id, d, s.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes s USING (d), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": SQL}
