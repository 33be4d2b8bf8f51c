"""Operator 12: sharding by histogram sort.

Every row gets a key of 192 bits: hash of the text, hash of the id, and a number that tells equal rows
apart. A round counts, in every partition at once, the exact rows and bytes below a sorted list of
probe keys, and brings the ends of the keys that lie between two probes; only these sums, one row a
probe, reach the driver. Targets without a probe inside the tolerance get new probes between the two
that enclose them, until every splitter is settled. Then the rows move once, to pieces finer than a
shard, so that no task sorts a whole shard; a row's slot is the counted number of rows before its
piece in the shard plus its place inside the piece.

Equal texts are neighbours: while a probe between two texts meets the tolerance a splitter does not
cut a group of equal texts; a group too large for that is cut between its rows, so a text that a
third of all rows hold spreads over the shards like any other rows.

The size of a row is its text's UTF-8 bytes plus `OVERHEAD`; null text has no bytes and is a group of its own,
apart from the empty text. Null ids are one id; rows equal in all columns stay rows of their own, whose order
among each other is that of the written table. A table of fewer rows than shards leaves shards empty, an
empty table gives no rows. Other columns travel along; those whose names clash with the operator's
are returned under their own names inside the struct `row`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm.exchange import partitions, written

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.01  # of a shard's mean weight
PIECE_BYTES = 128 << 20  # aim for a piece, the unit that one task sorts
PROBES = 64  # new probes for a target in a round
KEY = ("_h1", "_h2", "_h3")
_SIGN = np.uint64(1 << 63)
_GROUP = 1 << 128  # keys of one text differ below this bit
_SPACE = 1 << 192


def _keys(columns) -> np.ndarray:
    """Keys as 24 bytes whose order is that of the columns as signed numbers."""
    parts = [np.asarray(c).astype(np.int64, copy=False).view(np.uint64) ^ _SIGN for c in columns]
    return np.ascontiguousarray(np.stack(parts, axis=1).astype(">u8")).view("S24").ravel()


def _packed(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(24, "big") for k in keys), "S24")


def _full(key: bytes) -> bytes:
    return key.ljust(24, b"\0")


def _histogram(probes: np.ndarray):
    """Counts rows and weight between the probes, and the smallest and largest key there; one row for
    each stretch that holds rows, once a task."""

    def run(batches):
        n = len(probes) + 1
        rows, weight, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {}
        for batch in batches:
            keys = _keys(batch.column(c) for c in KEY)
            place = np.searchsorted(probes, keys, side="right")
            order = np.lexsort((keys, place))
            place, keys = place[order], keys[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(cuts[1:], len(place))
            rows[place[cuts]] += ends - cuts
            weight[place[cuts]] += np.add.reduceat(np.asarray(batch.column("_weight"))[order], cuts) if len(cuts) else 0
            for a, b in zip(cuts.tolist(), ends.tolist()):
                at, lo, hi = int(place[a]), _full(bytes(keys[a])), _full(bytes(keys[b - 1]))
                low[at], high[at] = min(low.get(at, lo), lo), max(high.get(at, hi), hi)
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seen, pa.int64()),
                pa.array(rows[seen]),
                pa.array(weight[seen]),
                pa.array([low[i] for i in seen.tolist()], pa.binary()),
                pa.array([high[i] for i in seen.tolist()], pa.binary()),
            ],
            names=["place", "n", "weight", "low", "high"],
        )

    return run


def _counted(keyed: DataFrame, probes: list[int]) -> list:
    """(rows, weight, smallest key, largest key) of each stretch between the probes."""
    found = keyed.select(*KEY, "_weight").mapInArrow(_histogram(_packed(probes)), "place long, n long, weight long, low binary, high binary")
    sums = found.groupBy("place").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for r in sums.collect():
        out[r["place"]] = (r["n"], r["weight"], int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big"))
    return out


def _between(low: int, high: int, n: int) -> set[int]:
    """At most n + 2 probes that part the keys low..high: between texts while there are several."""
    if low >> 128 != high >> 128:
        a, b = (low >> 128) + 1, high >> 128
        return {(a + (b - a) * j // n) * _GROUP for j in range(n + 1)}
    return {low + 1 + (high - low - 1) * j // n for j in range(n + 1)}


def splitters(keyed: DataFrame, wanted: list[tuple[float, float]], total: tuple[int, int], first: int, per_target: int = PROBES) -> list[tuple[int, int, int]]:
    """For each (weight below, tolerance) of `wanted`, in ascending order, a key with the exact rows and
    weight below it: as near as asked, or the nearest edge of a single row."""
    below = {0: (0, 0), _SPACE: total}
    probes = sorted({j * (1 << 64) // first * _GROUP for j in range(1, first)})
    settled: dict[int, int] = {}
    while True:
        counts, rows, weight, stretch = _counted(keyed, probes), 0, 0, {}
        for j, probe in enumerate(probes):
            rows, weight = rows + counts[j][0], weight + counts[j][1]
            below[probe] = (rows, weight)
        for j, (n, _, low, high) in enumerate(counts):
            if n:
                stretch[j] = (low, high)
        keys = sorted(below)
        sums, new = [below[k][1] for k in keys], set()
        for i, (aim, tolerance) in enumerate(wanted):
            if i in settled:
                continue
            at = min(max(bisect_left(sums, aim), 1), len(keys) - 1)
            lo, hi = keys[at - 1], keys[at]
            best = lo if aim - below[lo][1] <= below[hi][1] - aim else hi
            low, high = stretch.get(bisect_right(probes, lo), (lo, hi - 1))
            finer = _between(max(low, lo), min(high, hi - 1), per_target) - below.keys()
            if abs(below[best][1] - aim) <= tolerance or below[hi][0] - below[lo][0] <= 1 or not finer:
                settled[i] = best
            else:
                new |= finer
        if len(settled) == len(wanted):
            cuts, last = [], 0
            for i in range(len(wanted)):
                last = max(last, settled[i])
                cuts.append((last, *below[last]))
            return cuts
        probes = sorted(new)


def _placed(cuts: np.ndarray, shard: np.ndarray, base: np.ndarray):
    @F.pandas_udf("piece int, shard int, base long")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(cuts, _keys((a, b, c)), side="right")
        return pd.DataFrame({"piece": at.astype(np.int32), "shard": shard[at], "base": base[at]})

    return place


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, law: str = "bytes", tolerance: float = TOLERANCE) -> DataFrame:
    """(row: the columns of `docs`, size, shard, slot). `law` bytes: shards of near equal size, at most
    `tolerance` of the mean off where rows are small enough; rows: counts at most one apart."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size")
    keyed = written(
        docs.select(
            F.xxhash64(F.isnull(text), text).alias("_h1"),
            F.xxhash64(F.col(id_col), F.lit("id")).alias("_h2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("_h3"),
            size,
            (size if law == "bytes" else F.lit(1).cast("long")).alias("_weight"),
            F.struct(*docs.columns).alias("row"),
        )
    )
    n, weight, size_sum = keyed.agg(F.count("*"), F.sum("_weight"), F.sum("size")).first()
    weight, pieces = weight or 0, max(4 * partitions(docs), (size_sum or 0) // PIECE_BYTES)
    exact = 0.5 if law == "rows" else tolerance * weight / shards
    shard_aims = [((weight * i // shards if law == "rows" else weight * i / shards), exact) for i in range(1, shards)]
    piece_aims = [(weight * i / pieces, 0.25 * weight / pieces) for i in range(1, pieces)]
    wanted = sorted([*((a, t, 1) for a, t in shard_aims), *((a, t, 0) for a, t in piece_aims)])
    found = splitters(keyed, [(a, t) for a, t, _ in wanted], (n, weight), first=4 * (pieces + shards)) if n else []
    shard_cuts = [cut for cut, (_, _, of_shard) in zip(found, wanted) if of_shard]
    starts = sorted(({0: 0} | {key: rows for key, rows, _ in found if key < _SPACE}).items())
    shard_keys, shard_rows = [key for key, _, _ in shard_cuts], [0, *(rows for _, rows, _ in shard_cuts)]
    shard = [bisect_right(shard_keys, key) for key, _ in starts]
    base = [rows - shard_rows[s] for (_, rows), s in zip(starts, shard)]
    place = _placed(_packed([key for key, _ in starts[1:]]), np.array(shard, np.int32), np.array(base, np.int64))
    inside = Window.partitionBy("piece").orderBy(*KEY)
    dealt = keyed.withColumn("place", place(*KEY)).select(*KEY, "size", "row", "place.*")
    slot = (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    return dealt.select("row", "size", "shard", slot)


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """The shards as Parquet folders shard=0.. of `folder`, each row with its slot."""
    out = sharded(docs, **options)
    out.select("row.*", "size", "slot", "shard").write.partitionBy("shard").parquet(folder)


def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce(F.col("row.text"), F.lit("")), "UTF-8"))
    return sharded(docs).select(
        "row.doc_id", "size", crc.cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op12_histogram_shards": op12_histogram_shards}
ORACLES: dict = {}  # the splitters follow from probe rounds; tests compare with a plain sort
