"""Operator 7: language by family first, then by one-versus-one linear SVMs inside the family.

Features are hashed 1- to 3-grams of lower-cased bytes (everything but letters is a blank), square roots
of counts, of length 1. At most `per_language` rows of each language, and `most_rows` in all, are learnt from
(lowest hashes of id); their feature vectors are the only thing gathered. Every pair of families, and every
pair of languages of one family, gets a linear support vector machine (dual coordinate descent).
A text goes to the family with most won duels, then to its language with most won duels; ties go to the larger
sum of margins, then to the lower name. The score is the chance of the duel that was won least.

A null text or one without any letter is `und` with score 0. With one known language all others are
that one; with none all texts are `und`. Rows of null language are never learnt from. Repeated rows
predict alike; texts are read whole, in blocks of about a MB.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm import text as X

WIDTH = 4096
PER_LANGUAGE = 400
MOST_ROWS = 4000
STEEPNESS = 4.0
# Families by language code; any other code is a family of its own.
FAMILY = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILY.items() for code in codes.split()}
_PLAIN = np.where(X.LETTER, X.LOWER, np.uint8(32)).astype(np.int64)


def features(column):
    """(first row, matrix) of blocks of a batch."""
    data, offsets = X.batch_bytes(column)
    first = 0
    for lo, hi in X.blocks(offsets):
        for first in range(lo, hi, 128):
            last = min(first + 128, hi)
            at = offsets[first : last + 1] - offsets[first]
            part = _PLAIN[data[offsets[first] : offsets[last]]]
            doc = np.repeat(np.arange(last - first), np.diff(at))
            out = np.zeros((last - first) * WIDTH)
            gram = np.zeros(len(part), np.int64)
            for size in (1, 2, 3):
                n = len(part) - size + 1
                if n <= 0:
                    break
                gram = gram[:n] * 257 + part[size - 1 :]
                inside = doc[:n] == doc[size - 1 :]
                slot = ((gram * 0x9E3779B1 + size) >> 7) % WIDTH
                out += np.bincount(doc[:n][inside] * WIDTH + slot[inside], minlength=len(out))
            x = np.sqrt(out.reshape(-1, WIDTH), dtype=np.float64)
            yield first, (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = (x * x).sum(1) + 0.5 / cost
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Duels:
    """All pairwise machines of some names."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray):
        self.names = sorted(names)
        self.pairs = [(i, j) for i in range(len(self.names)) for j in range(i + 1, len(self.names))]
        self.weights = np.zeros((WIDTH + 1, len(self.pairs)))
        for k, (i, j) in enumerate(self.pairs):
            own = (label == self.names[i]) | (label == self.names[j])
            self.weights[:, k] = svm(x[own], np.where(label[own] == self.names[i], 1.0, -1.0))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the winner, chance of its closest duel)."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        won, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            won[:, i] += margin[:, k] > 0
            won[:, j] += margin[:, k] <= 0
            total[:, i] += margin[:, k]
            total[:, j] -= margin[:, k]
        best = np.argmax(won + 1e-3 * np.tanh(total), axis=1)
        close = np.full(len(x), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            close = np.where(best == i, np.minimum(close, margin[:, k]), np.where(best == j, np.minimum(close, -margin[:, k]), close))
        return best, 1 / (1 + np.exp(-STEEPNESS * np.where(np.isinf(close), 5.0, close)))


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([FAMILY_OF.get(c, f"only {c}") for c in lang], dtype=object)
        self.families = Duels(sorted(set(family)), x, family)
        self.inside = [Duels(sorted(set(lang[family == f])), x[family == f], lang[family == f]) for f in self.families.names]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        chosen, score = self.families.decide(x)
        names = [""] * len(x)
        for f, duels in enumerate(self.inside):
            own = np.flatnonzero(chosen == f)
            if len(own):
                best, chance = duels.decide(x[own])
                score[own] = np.minimum(score[own], chance)
                for i, b in zip(own, best):
                    names[i] = duels.names[b]
        return names, score


def _training(batches):
    for batch in batches:
        rows = [r for _, x in features(batch.column("text")) for r in x]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """Learn from `docs` (doc_id, text, lang); None if there is nothing to learn from."""
    usable = docs.where("lang is not null and doc_id is not null and text is not null")
    names = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not names:
        return None
    each = max(1, min(per_language, most_rows // len(names)))
    picked = [usable.where(F.col("lang") == n).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for n in names]
    sample = docs.sparkSession.createDataFrame(reduce(DataFrame.union, picked).dropDuplicates(["doc_id"]).collect(), "doc_id long, lang string")
    chosen = usable.select("doc_id", "text", "lang").join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["x"])) for r in chosen.mapInArrow(_training, "lang string, x binary").collect())
    return Model(np.array([np.frombuffer(x, np.float32) for _, x in rows]), np.array([n for n, _ in rows], dtype=object))


def _predict(shared, text_col: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            names, score = ["und"] * n, np.zeros(n)
            if model is not None:
                for first, x in features(batch.column("row").field(text_col)):
                    own, chance = model.predict(x)
                    names[first : first + len(own)] = own
                    score[first : first + len(own)] = chance
            carried = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names, pa.string()), pa.array(score)], names=[*carried, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, **parameters) -> DataFrame:
    """`row` (a struct of all columns of `docs`), lang_pred, score; languages of rows where `learn`
    does not hold are never read."""
    known = docs if learn is None else docs.where(learn)
    model = fit(known.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = T.StructType([rows.schema["row"]]).add("letters", "boolean").add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(_predict(shared, text_col), schema)
    return out.select(
        "row", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, learn=remainder != 2)
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return found.select("row.doc_id", held, "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
