"""Operator 8: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit: up to `per_class` labelled rows of each label (lowest hashes of id) are examples. Terms are all
their words and word beginnings of 4 to 8 bytes, none left out, so their number is bounded by the
examples' texts; inverse document frequencies are counted over all documents. A term's weight is also
multiplied by the root of one tenth plus its log-likelihood ratio between the labels: terms without evidence
weigh little, but every shared term counts. The cosine is taken over these terms. Each document that
shares any term finds its `k` nearest examples in a block-max inverted index: postings of the rarer terms are summed, for terms
held by more than one in `COMMON` examples the largest weight of every block of examples bounds what they can add, and
blocks are read, for `BATCH` documents at once, only where a bound reaches a k-th best cosine, so the result is the exact one. Votes weigh
cosine squared times the number of labelled rows an example stands for; a logistic map fitted on
leave-one-out votes of the examples turns them into probabilities. Ids, languages, sources and labels are no
inputs of a score.

Null and empty texts, and texts that share no term, get the calibrated share of toxic examples without terms. Without
labelled rows every score is 0. A row labelled both ways counts as toxic; null labels are ignored;
repeated rows score alike. Texts are read whole; only sums and bounded samples are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm import text as X
from gyre.llm.exchange import give_back

PER_CLASS = 2000
NEIGHBOURS = 15
BLOCK_EXAMPLES = 32
COMMON = 8  # terms of more than 1 / COMMON of the examples are bounded first and read last
BATCH = 64  # documents that are searched together
NO_EVIDENCE = 0.1
BEGINNINGS = (4, 5, 6, 7, 8)


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids have none."""
    return F.crc32(id_col.cast("string")) % by


def _features(data: np.ndarray, offsets: np.ndarray):
    """(features, document of each) of a block: whole words, then each kind of beginning."""
    part = X.LOWER[data]
    starts, ends, first = X.word_spans(part, offsets, X.ALNUM)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield X.word_hashes(part, starts, ends), doc
    sums = X.prefix_hash(part)
    for size in BEGINNINGS:
        long = ends - starts > size
        yield X.salted(X.span_hash(sums, starts[long], starts[long] + size), size), doc[long]


def _blocks(column):
    data, offsets = X.batch_bytes(column)
    for lo, hi in X.blocks(offsets):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


class Vocabulary:
    """Places of features in the ascending `terms`, through a table of their leading bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = len(terms).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((terms >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def places(self, features: np.ndarray) -> np.ndarray:
        """Place of every feature, -1 for unknown ones."""
        out = np.full(len(features), -1, np.int64)
        slot = (features >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.terms[at[live]] == features[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def counts(self, column):
        """(first row, row after the last, (row, term, count) of all occurrences, rows ascending) of each
        block of a batch; memory is that of one block."""
        for lo, hi, data, offsets in _blocks(column):
            row, term, count = self._block(data, offsets)
            yield lo, hi, row + lo, term, count

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features are made and looked up once for each distinct word of the block."""
        part = X.LOWER[data]
        starts, ends, first = X.word_spans(part, offsets, X.ALNUM)
        names, one, which = np.unique(X.word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[one], ends[one]
        words, places = [np.arange(len(names))], [self.places(names)]
        for size, long, found in X.beginning_hashes(part, starts, ends, BEGINNINGS):
            words.append(long)
            places.append(self.places(X.salted(found, size)))
        words, places = np.concatenate(words), np.concatenate(places)
        known = np.flatnonzero(places >= 0)
        known = known[np.argsort(words[known], kind="stable")]
        places, held = places[known], np.bincount(words[known], minlength=len(names))
        begin = np.cumsum(held) - held
        pair, times = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(first)) * max(len(names), 1) + which, return_counts=True)
        doc, word = pair // max(len(names), 1), pair % max(len(names), 1)
        size = held[word]
        at = np.repeat(begin[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        width = max(len(self.terms), 1)
        key, times = np.repeat(doc, size) * width + places[at], np.repeat(times, size)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        return key[cuts] // width, key[cuts] % width, np.add.reduceat(times[order], cuts) if len(cuts) else times


def _document_frequency(shared):
    def run(batches):
        give_back()
        vocabulary = Vocabulary(shared.value)
        df, n = np.zeros(len(vocabulary.terms), np.int64), 0
        for batch in batches:
            for _, _, _, term, _ in vocabulary.counts(batch.column("text")):
                df += np.bincount(term, minlength=len(df))
            n += batch.num_rows
            give_back()
        held = np.flatnonzero(df)
        del vocabulary
        yield pa.RecordBatch.from_arrays([pa.array([*held, -1], pa.int32()), pa.array([*df[held], n], pa.int64())], names=["term", "df"])
        give_back()

    return run


def _example_block(toxic: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *_features(data, offsets)]
    names, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    width = max(len(names), 1)
    key, count = np.unique(np.concatenate([x for _, x in found]) * width + place, return_counts=True)
    row, feature = key // width, names[key % width]
    cut = np.searchsorted(row, np.arange(len(toxic) + 1))
    return pa.RecordBatch.from_arrays(
        [
            toxic,
            pa.array([X.packed(feature[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            pa.array([X.packed(count[a:b].astype(np.int32)) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        ],
        names=["toxic", "feature", "count"],
    )


def _example_rows(batches):
    """Distinct features of an example and their counts."""
    give_back()
    for batch in batches:
        for lo, hi, data, offsets in _blocks(batch.column("text")):
            yield _example_block(batch.column("toxic").slice(lo, hi - lo), data, offsets)
            give_back()
        del batch
    give_back()


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of every term held by `toxic` and `clean` examples."""

    def part(seen, of, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / (of * share)), 0.0) + np.where(of > seen, (of - seen) * np.log((of - seen) / (of * (1 - share))), 0.0)

    share = (toxic + clean) / max(n_toxic + n_clean, 1)
    return np.maximum(2 * (part(toxic, n_toxic, share) + part(clean, n_clean, share)), 0.0)


def _weights(term: np.ndarray, count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w = (1 + np.log(count)) * scale[term]
    return w / np.sqrt(w @ w)


class BlockMaxIndex:
    """Exact k nearest examples; `matrix` holds a row of unit weights an example."""

    def __init__(self, matrix: np.ndarray, block: int = BLOCK_EXAMPLES):
        row, term = np.nonzero(matrix)
        self._build(row, term, matrix[row, term], *matrix.shape, block)

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, width: int, block: int = BLOCK_EXAMPLES) -> BlockMaxIndex:
        """The index of `n` examples given as (row, term, weight) triples."""
        index = cls.__new__(cls)
        index._build(row, term, weight, n, width, block)
        return index

    def _build(self, row, term, weight, n: int, width: int, block: int) -> None:
        order = np.lexsort((row, term))
        self._fill(row[order].astype(np.int32), np.bincount(term, minlength=width), weight[order].astype(float), n, block)

    def _fill(self, row, held, weight, n: int, block: int) -> None:
        """`held` postings of every term, those of a term one after the other and by row."""
        common = held * COMMON > n
        self.n, self.common = n, np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self.dense = np.zeros((n, int(common.sum())))
        often = np.repeat(common, held)
        self.dense[row[often], np.repeat(self.common[common], held[common])] = weight[often]
        self.examples, self.weights = row[~often], weight[~often]
        self.first = np.concatenate([[0], np.cumsum(np.where(common, 0, held))])
        self.starts = np.arange(0, n, block)
        self.block_of = np.arange(n) // block
        self.tops = np.maximum.reduceat(self.dense, self.starts, axis=0).T.copy() if n else np.zeros((self.dense.shape[1], 0))

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each query (terms, unit weights), in falling order; cosines have 12
        decimals, ties go to the lower place in the index.

        Postings of the rarer terms are summed. What the common ones can add to a block of examples is bounded by the
        block's largest weights, and only blocks that can reach some query's k-th best sum are read.
        """
        if not self.n or not queries:
            return [(np.zeros(0, int), np.zeros(0))] * len(queries)
        score, heavy = np.empty((len(queries), self.n)), np.zeros((len(queries), self.dense.shape[1]))
        for i, (term, weight) in enumerate(queries):
            start = self.first[term]
            size = self.first[term + 1] - start
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            score[i] = np.bincount(self.examples[at], self.weights[at] * np.repeat(weight, size), minlength=self.n)
            column = self.common[term]
            heavy[i, column[column >= 0]] = weight[column >= 0]
        if heavy.shape[1]:
            reach = np.maximum.reduceat(score, self.starts, axis=1) + heavy @ self.tops
            least = k + (skip >= 0)
            floor = np.partition(score, self.n - least, axis=1)[:, self.n - least] if self.n > least else np.zeros(len(queries))
            wanted = (reach * (1 + 1e-9) >= floor[:, None] * (1 - 1e-9)).any(axis=0)[self.block_of]
            if wanted.all():
                score += heavy @ self.dense.T
            else:
                score[:, wanted] += heavy @ self.dense[wanted].T
        score = np.round(score, 12)
        if skip >= 0:
            score[:, skip] = 0.0
        out = []
        for s in score:
            lowest = np.partition(s, self.n - k)[self.n - k] if self.n > k else 0.0
            place = np.flatnonzero((s >= lowest) & (s > 0))
            place = place[np.lexsort((place, -s[place]))[:k]]
            out.append((place, s[place]))
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(term, weight)], k, skip)[0]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Postings:
    """The examples of every term with their counts: a third of the index in bytes, which is made from them
    without sorting. `row`, `term` and `count` ascend by row; `norm` is the length of each example's vector."""

    def __init__(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, norm: np.ndarray, width: int):
        order = np.lexsort((row, term))
        self.held, self.norm = _small(np.bincount(term, minlength=width)), norm
        self.examples, self.counts = _small(row[order]), _small(count[order])

    def index(self, scale: np.ndarray, block: int = BLOCK_EXAMPLES) -> BlockMaxIndex:
        held = self.held.astype(np.int64)
        weight = (1 + np.log(np.arange(1.0, int(self.counts.max(initial=0)) + 2)))[self.counts - 1]
        weight *= np.repeat(scale, held)
        weight /= self.norm[self.examples]
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        index._fill(self.examples, held, weight, len(self.norm), block)
        return index


class Model:
    """Index, votes and calibration; fitted on the driver from bounded samples. Only its postings travel:
    `opened` makes the index again, for as long as a task needs it."""

    def __init__(self, terms: np.ndarray, scale: np.ndarray, labels: np.ndarray, first: np.ndarray, term: np.ndarray, count: np.ndarray, stands_for: dict[int, float], k: int):
        """Examples as one list of (term, count), those of example i from first[i] on."""
        self.terms, self.scale, self.k = terms, scale, k
        size = np.diff(first)
        full = size > 0
        blank = [stands_for.get(x, 0.0) * int((labels[~full] == x).sum()) for x in (0, 1)]
        weight = (1 + np.log(count)) * scale[term]
        norm = np.sqrt(np.add.reduceat(weight * weight, first[:-1][full])) if full.any() else np.zeros(0)
        weight /= np.repeat(norm, size[full])
        self.labels = labels[full].astype(np.int64)
        self.stands_for = np.array([stands_for.get(x, 1.0) for x in (0, 1)])
        n = int(full.sum())
        self.postings = Postings(np.repeat(np.arange(n, dtype=np.int32), size[full]), term, count, norm, len(terms))
        self.index = self.postings.index(scale)
        everyone = np.array(blank) + [self.stands_for[x] * (self.labels == x).sum() for x in (0, 1)]
        self.base = (everyone[1] + 0.5) / (everyone.sum() + 1.0)
        self.blank_raw = (blank[1] + 0.5 * self.base) / (sum(blank) + 0.5)
        self.slope, self.shift = 1.0, 0.0
        self.known = len(labels) > 0
        if len(set(self.labels)) == 2:
            cut = np.concatenate([[0], np.cumsum(size[full])]).tolist()
            raw = [self.raw(term[a:b], weight[a:b], i) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
            self._calibrate(np.array([*raw, self.blank_raw, self.blank_raw]), np.array([*self.labels, 0, 1]), np.array([*self.stands_for[self.labels], *blank]))

    def __getstate__(self) -> dict:
        return {**vars(self), "index": None}

    def opened(self) -> Model:
        """This model with its index, which is kept by what is returned alone."""
        out = copy(self)
        out.index = self.index or self.postings.index(self.scale)
        return out

    def raw(self, term: np.ndarray, weight: np.ndarray, skip: int = -1) -> float:
        return self.vote(*self.index.nearest(term, weight, self.k, skip))

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        vote = cosine**2 * self.stands_for[self.labels[example]]
        strength = 0.25 * min(self.stands_for)
        return float((vote @ self.labels[example] + strength * self.base) / (vote.sum() + strength))

    def _calibrate(self, raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Logistic map of the vote's logit, Newton steps with a small ridge towards identity."""
        x, w = self._logit(raw), weight / weight.sum() * len(weight)
        theta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(theta[0] * x + theta[1])))
            gradient = np.array([(w * (p - label)) @ x + theta[0] - 1, (w * (p - label)).sum() + theta[1]])
            s = w * p * (1 - p)
            hessian = np.array([[s @ x**2 + 1, s @ x], [s @ x, s.sum() + 1]])
            step = np.linalg.solve(hessian, gradient)
            theta = theta - step
            if np.abs(step).max() < 1e-9:
                break
        if theta[0] > 0:
            self.slope, self.shift = theta

    @staticmethod
    def _logit(p):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self._logit(raw) + self.shift)))) if self.known else 0.0


def _scores(model: Model, vocabulary: Vocabulary, blank: float, column: pa.Array) -> pa.StructArray:
    n = len(column)
    score, nearest, votes = np.full(n, blank), np.zeros(n), np.zeros(n, np.int64)
    for lo, hi, row, term, count in vocabulary.counts(column):
        rows, cut = np.unique(row, return_index=True)
        cut = np.append(cut, len(row)).tolist()
        for first in range(0, len(rows), BATCH):
            asked = [(term[a:b], _weights(term[a:b], count[a:b], model.scale)) for a, b in zip(cut[first : first + BATCH], cut[first + 1 : first + BATCH + 1])]
            for i, (example, cosine) in zip(rows[first : first + BATCH].tolist(), model.index.nearest_many(asked, model.k)):
                score[i] = model.score(model.vote(example, cosine))
                votes[i] = model.labels[example].sum()
                nearest[i] = cosine[0] if len(cosine) else 0.0
        del row, term, count
    return pa.StructArray.from_arrays([pa.array(score), pa.array(nearest), pa.array(votes)], names=["score", "nearest", "toxic_votes"])


def _scorer(shared):
    @F.arrow_udf("score double, nearest double, toxic_votes long")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        model = shared.value.opened()
        vocabulary = Vocabulary(model.terms)
        blank = model.score(model.blank_raw)
        give_back()
        for column in texts:
            give_back()
            found = _scores(model, vocabulary, blank, column)
            del column
            yield found
        del model, vocabulary
        give_back()

    return scored


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> Model:
    """`docs` (doc_id, text) and `labels` (doc_id, toxic), the rows to learn from."""
    spark = docs.sparkSession
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    picked = [rows.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for x in (0, 1)]
    sample = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, toxic int")
    examples = docs.join(F.broadcast(sample), "doc_id").select("toxic", "text")
    have = {x: min(per_class, totals.get(x, 0)) for x in (0, 1)}
    # As columns, not rows: a few large arrays, which leave no holes in the driver's memory.
    seen = examples.mapInArrow(_example_rows, "toxic int, feature binary, count binary").toArrow()
    digests = [blake2b(f.as_buffer().to_pybytes() + c.as_buffer().to_pybytes()).digest() for f, c in zip(seen["feature"], seen["count"])]
    labels = seen["toxic"].to_numpy()
    order = sorted(range(len(labels)), key=lambda i: (digests[i], labels[i]))
    give_back()
    labels, seen = labels[order], seen.take(pa.array(order, pa.int64())).combine_chunks()
    data, at = X.batch_bytes(seen["feature"])
    terms, term = np.unique(data.view(np.uint64), return_inverse=True)
    term, first, count = term.astype(np.int32), at // 8, X.batch_bytes(seen["count"])[0].view(np.int32).copy()
    del seen, data
    give_back()
    of = np.repeat(labels, np.diff(first))
    held = [np.bincount(term[of == x], minlength=len(terms)) for x in (0, 1)]  # a row holds a term once
    shared = spark.sparkContext.broadcast(terms)
    counts = docs.select("text").mapInArrow(_document_frequency(shared), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    shared.destroy()
    known, df = counts["term"].to_numpy(), counts["df"].to_numpy()
    n, df_of = df[known < 0].sum(), np.ones(len(terms), np.int64)
    df_of[known[known >= 0]] = df[known >= 0]
    evidence = _evidence(held[1], held[0], int((labels == 1).sum()), int((labels == 0).sum()))
    scale = np.log1p(n / df_of) * np.sqrt(NO_EVIDENCE + evidence)
    return Model(terms, scale, labels, first, term, count, {x: totals.get(x, 0) / max(have[x], 1) for x in (0, 1)}, k)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, **parameters) -> DataFrame:
    """`row` (a struct of all columns of `docs`), score, nearest, toxic_votes, predicted; labels of
    rows where `learn` (a condition on `labels`) does not hold are never read."""
    known = (labels if learn is None else labels.where(learn)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
    model = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), known, **parameters)
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    found = docs.select(F.struct(*docs.columns).alias("row"), scored(F.col(text_col).cast("string")).alias("found"))
    return found.select("row", "found.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=remainder(F.col("doc_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("row.doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("row.doc_id", held, "score", "predicted", "nearest", "toxic_votes")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
