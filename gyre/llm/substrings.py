"""Operator 2: removal of repeated 200-byte strings by prefix-free parsing.

A rolling hash over `CONTEXT` bytes triggers phrase cuts, so equal texts are cut alike wherever
they stand. Corpus order to depth `length` is needed only where neighbours agree in `length` bytes,
and the order of a corpus suffix is that of (rest of its phrase, parse suffix after it):

1. Dictionary and parse: every phrase and, for every phrase, the parse suffix that holds all
   windows starting in it (that phrase and the next ones, at least length - 1 bytes further) get
   fingerprint names; the corpus says which names occur again. A repeated parse suffix settles all
   windows that start in its phrase at once; so long copies cost one name a phrase.
2. Dictionary suffixes: a window holding a phrase that occurs once is unique. The other windows
   not yet settled are the edges of repeats and places with hardly any trigger: each is named by
   its own bytes. One text of every repeated parse suffix adds its windows too, so that edges
   meet them. Equal names are neighbours in corpus order with a common prefix of `length`.
3. Bytes under repeated windows go; everything is judged on the input.

Suffixes are ordered by fingerprint, not alphabet: only the adjacency of equal prefixes counts.
Equal 56-bit names count as equal strings. Null text is the empty text; texts shorter than `length`
lose nothing; repeated rows and null ids are texts of their own. Matches never cross documents.
Memory is bounded by a chunk of texts (some MB) or the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gyre.llm import text as X
from gyre.llm.exchange import ASK, answers, ask_rows, chunk_rows, giving_back, in_chunks, looked_up, partitions, reply_arrays

LENGTH = 200
RESULT = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"))
CONTEXT = 8
PHRASE = 28
PARSED = 1 << 18  # bytes parsed at once, or one longer text
_TRIGGER = np.uint64(2**64 // PHRASE)
_STIR = np.uint64(0xD6E8FEB86659FD93)


class Parse:
    """Phrases of a block of documents; positions are bytes of the block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.offsets, self.length = offsets, length
        self.sums = X.prefix_hash(data)
        at = np.arange(CONTEXT, len(data))
        rolled = (self.sums[CONTEXT : len(data)] - self.sums[: max(len(data) - CONTEXT, 0)]) * X.powers(len(data) + 1)[1][: max(len(data) - CONTEXT, 0)]
        cuts = at[rolled * _STIR < _TRIGGER]
        doc = np.searchsorted(offsets, cuts, "right") - 1
        cuts = cuts[cuts - offsets[doc] >= CONTEXT]
        heads = offsets[:-1][np.diff(offsets) > 0]
        self.start = np.concatenate([heads, cuts])
        order = np.argsort(self.start, kind="stable")
        self.start = self.start[order]
        real = (np.arange(len(order)) >= len(heads))[order]
        doc = np.searchsorted(offsets, self.start, "right") - 1
        self.head, self.tail = offsets[doc], offsets[doc + 1]
        self.next = np.minimum(np.append(self.start[1:], len(data)), self.tail)
        self.whole = real & (self.next < self.tail)
        self.last = np.minimum(self.next, self.tail - length + 1)  # window starts are in [start, last)
        self.holds = self.start < self.last

    def phrase_names(self) -> np.ndarray:
        a, b = self.start[self.whole], self.next[self.whole]
        return X.salted(X.span_hash(self.sums, a, b) + (b - a).astype(np.uint64), 1) >> np.uint64(8)

    def suffix_names(self) -> np.ndarray:
        a = self.start[self.holds]
        place = np.searchsorted(self.start, self.next[self.holds] + self.length - 1)
        b = np.minimum(np.append(self.start, np.iinfo(np.int64).max)[place], self.tail[self.holds])
        return X.salted(X.span_hash(self.sums, a, b) + (b - a).astype(np.uint64), 2) >> np.uint64(8)

    def window_names(self, at: np.ndarray) -> np.ndarray:
        return X.salted(X.span_hash(self.sums, at, at + self.length), 3) >> np.uint64(8)

    def judged(self, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts as flags a byte: settled as repeated, standing for others, still open."""
        n = len(self.sums)
        found, place = looked_up(self.suffix_names(), known)
        settled = _ranges(n, self.start[self.holds][found], self.last[self.holds][found])
        standing = found.copy()
        standing[found] = first[place[found]] > 0
        standing = _ranges(n, self.start[self.holds][standing], self.last[self.holds][standing])
        single = ~looked_up(self.phrase_names(), known)[0]
        a, b = self.start[self.whole][single], self.next[self.whole][single]
        low, high = np.maximum(b - self.length + 1, self.head[self.whole][single]), a - CONTEXT + 1
        dead = _ranges(n, low[low < high], high[low < high])
        able = _ranges(n, self.start[self.holds], self.last[self.holds])
        return settled, standing, able & ~dead & ~settled


def _ranges(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions below n - 1 inside any range [start, end)."""
    if not len(starts):
        return np.zeros(n - 1, bool)
    steps = np.bincount(starts, minlength=n) - np.bincount(ends, minlength=n)
    return np.cumsum(steps[: n - 1]) > 0


def _parses(column, length: int):
    data, offsets = X.batch_bytes(column)
    for lo, hi in X.blocks(offsets, PARSED):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, part, Parse(part, at, length)


def _asks(table: pa.Table, chunk: int, names: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> pa.Table:
    if not names:
        return ask_rows(chunk, np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets)
    every, weight = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    cuts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
    return ask_rows(chunk, every[cuts], np.add.reduceat(weight, cuts) if len(cuts) else weight, buckets)


def _parse_asks(length: int, buckets: int):
    @giving_back
    def run(table: pa.Table) -> pa.Table:
        names = []
        for _, _, parse in _parses(chunk_rows(table)["text"], length):
            names += [parse.phrase_names(), parse.suffix_names()]
        return _asks(table, table["chunk"][0].as_py(), names, [np.ones(len(x), np.int64) for x in names], buckets)

    return run


def _window_asks(length: int, buckets: int):
    @giving_back
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _asks(texts, 0, [], [], buckets)
        known, _, first = reply_arrays(replies)
        names, counts = [], []
        for _, _, parse in _parses(chunk_rows(texts)["text"], length):
            _, standing, open_ = parse.judged(known, first)
            for flags, weight in ((standing, 2), (open_, 1)):
                at = np.flatnonzero(flags)
                names.append(parse.window_names(at))
                counts.append(np.full(len(at), weight, np.int64))
        return _asks(texts, texts["chunk"][0].as_py(), names, counts, buckets)

    return run


def _removal(length: int, carried: list[str], empty: pa.Table, with_text: bool):
    """Per document: counts, digest and, if asked for, the kept bytes as text."""

    @giving_back
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        if with_text:
            fields.append(("kept_text", pa.string()))
        docs = chunk_rows(texts)
        if docs is None:
            return empty
        known, _, first = reply_arrays(replies.filter(pa.compute.equal(replies["step"], 1)))
        again, _, _ = reply_arrays(replies.filter(pa.compute.equal(replies["step"], 2)))
        rows: list[list] = [[] for _ in fields]
        for _, data, parse in _parses(docs["text"], length):
            settled, _, open_ = parse.judged(known, first)
            at = np.flatnonzero(open_)
            at = at[looked_up(parse.window_names(at), again)[0]]
            starts = np.flatnonzero(settled)
            starts = np.concatenate([starts, at])
            gone = _ranges(len(data) + 1, starts, starts + length)
            for a, b in zip(parse.offsets[:-1], parse.offsets[1:]):
                lost = gone[a:b]
                kept = data[a:b][~lost].tobytes()
                rows[0].append(int(b - a))
                rows[1].append(int(lost.sum()))
                rows[2].append(int(np.count_nonzero(lost[1:] & ~lost[:-1]) + (b > a and lost[0])))
                rows[3].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    rows[4].append(kept.decode("utf-8", "ignore"))
        made = {f[0]: pa.array(r, f[1]) for f, r in zip(fields, rows)}
        return pa.table({c: docs[c] for c in carried} | made)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; `with_text` also kept_text (the kept bytes
    as text, without characters that a cut went through) and `row`, a struct of all other columns."""
    text = F.col(text_col).cast("string").alias("text")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    if with_text:
        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    chunks = in_chunks(chosen)
    buckets = partitions(docs)
    parse = answers(chunks.groupBy("chunk").applyInArrow(_parse_asks(length, buckets), ASK))
    asks = chunks.groupBy("chunk").cogroup(parse.groupBy("chunk")).applyInArrow(_window_asks(length, buckets), ASK)
    replies = parse.withColumn("step", F.lit(1)).unionByName(answers(asks).withColumn("step", F.lit(2)))
    carried = [c for c in chosen.columns if c != "text"]
    schema = T.StructType([chosen.schema[c] for c in carried])
    for name, kind in RESULT + ((("kept_text", "string"),) if with_text else ()):
        schema = schema.add(name, kind)
    out = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return out.applyInArrow(_removal(length, carried, to_arrow_schema(schema).empty_table(), with_text), schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES: dict[str, str] = {}
