"""Operator 10: near-duplicate vectors by product quantisation.

Equal vectors form one class. A coarse quantiser and residual codebooks (`PARTS` subspaces) are fitted on at
most `sample` classes; every class is indexed: its cell, its residual codes and the length of what
the codes miss. Every class queries its `probes` nearest cells; the asymmetric table-lookup
distance plus the missed length bounds the cosine from above, so the lookup drops no pair within a
probed cell, and what is left is compared exactly in double precision. Only the choice of cells can miss a
pair (recall measured in the tests), and a pair has two chances, from either side.

Cells are cut into slots of about `slot` index rows and `slot` queries, so a cell with a third of
all rows is many tasks. All pairs at the threshold are kept: their number is the result's.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different length do not link. Repeated rows are vectors of their own. A
null id takes part, but its component is named by the smallest other id (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.components import components
from gyre.llm.exchange import written

THRESHOLD = 0.95
SAMPLE = 16384
CELL_ROWS = 128
MOST_CELLS = 1024
PROBES = 12
PARTS = 8
CODES = 256
SLOT = 2048
SLACK = 1e-9


def _packed_vectors(batches):
    """Finite, non-zero vectors as packed doubles of length 1; null for all others."""
    for batch in batches:
        out = []
        for v in batch.column("vector"):
            x = np.array(v.as_py() or [], dtype=object)
            if not len(x) or any(c is None for c in x):
                out.append(None)
                continue
            x = x.astype(np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or top == 0:
                out.append(None)
                continue
            x = x / top
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centres and residual codebooks; vectors are padded with zeros to `width`."""

    def __init__(self, vectors: list[np.ndarray], n_rows: int, cell_rows: int, most_cells: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.width = -(-max((len(v) for v in vectors), default=1) // PARTS) * PARTS
        x = self.padded(vectors) if vectors else np.zeros((1, self.width))
        self.centres = _k_means(x, int(np.clip(n_rows // cell_rows, 1, most_cells)), rng)
        rest = (x - self.centres[_nearest(x, self.centres)]).reshape(len(x), PARTS, -1)
        self.books = [_k_means(rest[:, p], CODES, rng) for p in range(PARTS)]

    def padded(self, vectors: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            m = min(len(v), self.width)
            out[i, :m] = v[:m]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), PARTS, -1)
        codes = np.stack([_nearest(rest[:, p], self.books[p]) for p in range(PARTS)], 1).astype(np.uint8)
        near = np.stack([self.books[p][codes[:, p]] for p in range(PARTS)], 1)
        return cell, codes, np.sqrt(((rest - near) ** 2).sum((1, 2)))


INDEX = "cell int, cls long, unit binary, codes binary, missed double"
QUERY = "cell int, cls long, unit binary, home int"


def _index(shared):
    def run(batches):
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = [np.frombuffer(b, np.float64) for b in batch.column("unit").to_pylist()]
            cell, codes, missed = q.encode(q.padded(vectors))
            missed = missed + [np.sqrt(max(0.0, 1 - (v[: q.width] @ v[: q.width]))) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), batch.column("cls"), batch.column("unit"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)],
                names=["cell", "cls", "unit", "codes", "missed"],
            )

    return run


def _queries(shared, probes: int):
    def run(batches):
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = q.padded([np.frombuffer(b, np.float64) for b in batch.column("unit").to_pylist()])
            near = np.argsort(-(x @ q.centres.T - 0.5 * (q.centres**2).sum(1)), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            home = np.repeat(near[:, 0], near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel().astype(np.int32)), batch.column("cls").take(row), batch.column("unit").take(row), pa.array(home.astype(np.int32))],
                names=["cell", "cls", "unit", "home"],
            )

    return run


def _compare(shared, threshold: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if index.num_rows and queries.num_rows:
            q = shared.value
            cell = index["cell"][0].as_py()
            theirs = [np.frombuffer(x, np.float64) for x in index["unit"].to_pylist()]
            y, y_size = q.padded(theirs), np.array([len(v) for v in theirs])
            codes = np.array([np.frombuffer(c, np.uint8) for c in index["codes"].to_pylist()])
            missed, y_cls = index["missed"].to_numpy(), index["cls"].to_numpy()
            mine = [np.frombuffer(x, np.float64) for x in queries["unit"].to_pylist()]
            x, x_size = q.padded(mine), np.array([len(v) for v in mine])
            x_cls, home = queries["cls"].to_numpy(), queries["home"].to_numpy()
            for lo in range(0, len(x), 128):
                part = x[lo : lo + 128]
                about = np.repeat((part @ q.centres[cell])[:, None], len(y), 1)
                for p in range(PARTS):
                    table = part.reshape(len(part), PARTS, -1)[:, p] @ q.books[p].T
                    about += table[:, codes[:, p]]
                i, j = np.nonzero(about + missed[None, :] >= threshold - SLACK)
                fine = (x_size[lo + i] == y_size[j]) & (x_cls[lo + i] != y_cls[j])
                fine &= (home[lo + i] != cell) | (x_cls[lo + i] < y_cls[j])
                i, j = i[fine], j[fine]
                for start in range(0, len(i), 65536):
                    u, v = i[start : start + 65536], j[start : start + 65536]
                    exact = np.array([mine[lo + s] @ theirs[t] for s, t in zip(u, v)]) if q.width < max(x_size.max(), y_size.max()) else np.einsum("ij,ij->i", part[u], y[v])
                    good = exact >= threshold
                    left, right = x_cls[lo + u[good]], y_cls[v[good]]
                    a.append(np.minimum(left, right))
                    b.append(np.maximum(left, right))
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return run


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    most_cells: int = MOST_CELLS,
    probes: int = PROBES,
    slot: int = SLOT,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `table`."""
    spark = table.sparkSession
    given = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    units = written(given.mapInArrow(_packed_vectors, "vec_id long, unit binary").withColumn("cls", F.xxhash64("unit")))
    classes = units.where("unit is not null").groupBy("cls").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    classes = written(classes)
    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("unit").collect()
    shared = spark.sparkContext.broadcast(Quantiser([np.frombuffer(r["unit"], np.float64) for r in chosen], n, cell_rows, most_cells))
    rows = classes.select("cls", "unit")
    index = written(rows.mapInArrow(_index(shared), INDEX))
    asked = written(rows.mapInArrow(_queries(shared, probes), QUERY))
    size = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / slot).cast("int").alias(name))
    slots = F.broadcast(size(index, "islots").join(size(asked, "qslots"), "cell"))  # at most a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(slots, "cell").withColumn("islot", F.pmod(F.xxhash64("cls"), F.col("islots"))).withColumn("qslot", every("qslots"))
    right = asked.join(slots, "cell").withColumn("qslot", F.pmod(F.xxhash64("cls"), F.col("qslots"))).withColumn("islot", every("islots"))
    key = lambda df: df.groupBy("cell", F.col("islot").cast("int"), F.col("qslot").cast("int"))
    found = key(left.drop("islots", "qslots")).cogroup(key(right.drop("islots", "qslots"))).applyInArrow(_compare(shared, threshold), "a long, b long")
    links = written(found.distinct())
    joined = components(links).withColumnRenamed("node", "cls")

    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("cls").alias("b"), "n"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    known = classes.select("cls", "n", "low").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "component").join(degree, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = units.where("unit is not null").join(known, "cls").select("vec_id", "n_links", "component_id")
    out = out.union(units.where("unit is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_vector_near_duplicates": op10_vector_near_duplicates}
ORACLES = {
    "op10_vector_near_duplicates": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
link AS (SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
comp AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY 1),
n AS (SELECT x AS r, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)""",
}
