"""Streaming forms: frames, states and observations that arrive over time.

Frames and runs are kept as keyed state until they are whole; how rows are cut into batches, and in which
order they arrive, changes nothing. Every flow writes its micro-batch results under a folder named by the batch
id, so a replayed batch overwrites itself (exactly once), and keeps only mergeable results.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gyre.functions.guards import ratio
from gyre.operators.catalogue import canonical
from gyre.session import scratch_dir


def table_stream(spark: SparkSession, folder: str, table: str, schema: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Stream one table of a folder, a parquet file or a folder of them; the schema is declared, not inferred."""
    named = f"{folder}/{table}.parquet"
    shape = schema or spark.read.parquet(named).schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return rows.parquet(named)
    return rows.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(stream: DataFrame, each_batch, folder: str, mode: str = "append") -> None:
    """Process all available input and stop; progress and state are kept under `folder`."""
    query = (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_state(stream: DataFrame) -> DataFrame:
    """Keyed state lives in RocksDB, on the executors' disks and in the checkpoint folder."""
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    return stream


def passed(timers, at: int) -> bool:
    """Whether the watermark has reached a timer."""
    return timers.getCurrentWatermarkInMs() >= at


class FrameStates(StatefulProcessor):
    """Holds the pixels of one frame until it is whole, then emits them with their dark state.

    A frame is whole with its expected number of pixels, or when the watermark has passed its last
    arrival by `patience_ms`. What arrives for an emitted frame is late; a pixel sent twice counts once.
    """

    def __init__(self, dark_ratio: float, patience_ms: int | None):
        self.dark_ratio, self.patience_ms = dark_ratio, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pixels = handle.getMapState("pixels", "y int, x int", "brightness double")
        self.emitted = handle.getValueState("emitted", "pixels int")
        self.timer = handle.getValueState("timer", "at long")

    def _out(self, key, rows: list, cut: float | None):
        n = len(rows)
        return pd.DataFrame(
            {
                "kind": ["late" if cut is None else "pixel"] * n, "series_id": [key[0]] * n, "position": [key[1]] * n,
                "y": [r[0] for r in rows], "x": [r[1] for r in rows], "brightness": [r[2] for r in rows],
                "dark": [None if cut is None else bool(r[2] < cut) for r in rows],
            }
        )

    def _held(self) -> dict:
        return {(k[0], k[1]): v[0] for k, v in self.pixels.iterator()} if self.pixels.exists() else {}

    def _emit(self, key, held: dict):
        rows = sorted((y, x, v) for (y, x), v in held.items())
        self.pixels.clear()
        self.emitted.update((len(rows),))
        if rows:
            yield self._out(key, rows, float(np.median([r[2] for r in rows])) * self.dark_ratio)

    def handleInputRows(self, key, rows, timerValues):
        expected, arrived, late, new = None, [], [], {}
        gone = self.emitted.exists()
        if not gone and self.timer.exists() and passed(timerValues, self.timer.get()[0]):
            yield from self._emit(key, self._held())  # its timer would fire only after these rows
            gone = True
        held = {} if gone else self._held()
        for batch in rows:
            if gone:
                late += list(zip(batch["y"], batch["x"], batch["brightness"]))
                continue
            for y, x, v in zip(batch["y"], batch["x"], batch["brightness"]):
                if (int(y), int(x)) not in held:
                    new.setdefault((int(y), int(x)), float(v))
            known = batch["expected"].dropna()
            expected = int(known.max()) if len(known) else expected
            arrived += list(batch["arrived"].dropna())
        if late:
            yield self._out(key, late, None)
        if gone:
            return
        if expected is not None and len(held) + len(new) >= expected:
            yield from self._emit(key, held | new)
            return
        for at, v in new.items():  # what arrives with the rest of its frame never becomes state
            self.pixels.updateValue(at, (v,))
        if self.patience_ms is not None and arrived:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = int(max(arrived).timestamp() * 1000) + self.patience_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.emitted.exists():
            yield from self._emit(key, self._held())

    def close(self) -> None:
        pass


FRAME_STATES = "kind string, series_id long, position long, y int, x int, brightness double, dark boolean"


def frame_states(pixels: DataFrame, dark_ratio: float, patience: str | None = None) -> DataFrame:
    """Pixels of whole frames of a stream (series_id, position, y, x, brightness, expected, arrived), with `dark` against the
    frame's median; kind `late` for what came after its frame. With `patience` (an interval), `arrived` drives the watermark."""
    rows = with_state(pixels)
    if patience is not None:
        rows = rows.withWatermark("arrived", patience)
    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)
    return rows.groupBy("series_id", "position").transformWithStateInPandas(
        FrameStates(dark_ratio, wait), FRAME_STATES, "append", "None" if patience is None else "EventTime"
    )


def activity_partials(states: DataFrame) -> DataFrame:
    """Per pixel count, sum, sum of squares and dark count."""
    v = F.col("brightness")
    return states.where("kind = 'pixel'").groupBy("series_id", "y", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count_if("dark").alias("dark")
    )


def merge_activity(partials: DataFrame) -> DataFrame:
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return partials.groupBy("series_id", "y", "x").agg(
        n.alias("support_count"),
        mean.alias("mean"),
        F.when(n >= 2, F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0)))).alias("std"),
        ratio(F.sum("dark"), n).alias("relative_dark_fraction"),
    )


def stream_activity_map(pixels: DataFrame, folder: str, dark_ratio: float = 0.65, patience: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(activity map, late pixels) of a stream of pixels; a frame may be spread over batches."""
    spark = pixels.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        activity_partials(batch).write.mode("overwrite").parquet(f"{folder}/partials/batch={batch_id}")
        batch.where("kind = 'late'").drop("kind", "dark").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        batch.unpersist()

    drain(frame_states(pixels, dark_ratio, patience), each, folder)
    return merge_activity(spark.read.parquet(f"{folder}/partials")), spark.read.parquet(f"{folder}/late").drop("batch")


CHUNK = 65_536


class RunStates(StatefulProcessor):
    """Which positions of one chunk of a series are known, and true; emits the chunk's runs in short after every batch.

    Two bits a position are the whole state, so arrival order and batches leave no trace, and a position sent with
    both states is unknown. When the watermark has passed the last arrival by `patience_ms` the chunk is closed, its
    bits are dropped, and later positions are late.
    """

    def __init__(self, chunk: int, patience_ms: int | None):
        self.chunk, self.patience_ms = chunk, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bits = handle.getValueState("bits", "true_bits binary, false_bits binary")
        self.closed = handle.getValueState("closed", "closed boolean")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def _late(key, positions, states):
        n = len(positions)
        return pd.DataFrame({"kind": ["late"] * n, "series_id": [key[0]] * n, "chunk": [key[1]] * n, "position": positions, "state": states} | {c: [None] * n for c in SHORT})

    def handleInputRows(self, key, rows, timerValues):
        bits, arrived = np.zeros((2, self.chunk), bool), []
        if self.timer.exists() and not self.closed.exists() and passed(timerValues, self.timer.get()[0]):
            self._close()  # its timer would fire only after these rows
        if not self.closed.exists() and self.bits.exists():
            bits = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=self.chunk).astype(bool) for b in self.bits.get()])
        for batch in rows:
            batch = batch[batch["state"].notna()]
            if self.closed.exists():
                if len(batch):
                    yield self._late(key, list(batch["position"]), [bool(s) for s in batch["state"]])
                continue
            at, state = batch["position"].to_numpy(np.int64) - key[1] * self.chunk, batch["state"].to_numpy(bool)
            bits[0, at[state]] = True
            bits[1, at[~state]] = True
            arrived += list(batch["arrived"].dropna())
        if self.closed.exists():
            return
        self.bits.update(tuple(np.packbits(b).tobytes() for b in bits))
        if self.patience_ms is not None and arrived:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            last = int(max(arrived).timestamp() * 1000) + self.patience_ms
            self.handle.registerTimer(last)
            self.timer.update((last,))
        short = short_runs(bits[0], bits[1])
        if short is not None:
            first = key[1] * self.chunk
            short["head"], short["tail"] = short["head"] + first, short["tail"] + first
            yield pd.DataFrame([{"kind": "runs", "series_id": key[0], "chunk": key[1], "position": None, "state": None} | short])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._close()
        return iter(())

    def _close(self) -> None:
        self.closed.update((True,))
        self.bits.clear()

    def close(self) -> None:
        pass


SHORT = ("observed", "transitions", "longest_true", "longest_false", "head", "head_state", "head_length", "tail", "tail_state", "tail_length")
RUN_STATES = (
    "kind string, series_id long, chunk long, position long, state boolean, observed long, transitions long, longest_true long, longest_false long, "
    "head long, head_state boolean, head_length long, tail long, tail_state boolean, tail_length long"
)


def short_runs(true: np.ndarray, false: np.ndarray) -> dict | None:
    """Counts of the runs of a chunk, its longest ones, and the first and last run, which may go on outside."""
    at = np.flatnonzero(true ^ false)
    if not len(at):
        return None
    state = true[at]
    touch = np.diff(at) == 1
    edges = np.flatnonzero(~(touch & (state[1:] == state[:-1])))
    start, end = np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(at) - 1]])
    length, kind = end - start + 1, state[start]
    longest = lambda s: int(length[kind == s].max(initial=0))
    return {
        "observed": len(at), "transitions": int((touch & (state[1:] != state[:-1])).sum()), "longest_true": longest(True), "longest_false": longest(False),
        "head": int(at[0]), "head_state": bool(kind[0]), "head_length": int(length[0]), "tail": int(at[-1]), "tail_state": bool(kind[-1]), "tail_length": int(length[-1]),
    }


def merge_runs(shorts: DataFrame, keys: list[str]) -> DataFrame:
    """Run summary of every series from the latest short form of its chunks, which a fold joins at their edges;
    a series has one row a chunk here."""
    latest = shorts.groupBy(*keys, "chunk").agg(F.max_by(F.struct(*SHORT), "batch").alias("s"))
    chunks = latest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("c"))
    zero = lambda: F.lit(0).cast("bigint")
    start = F.struct(
        zero().alias("observed"), zero().alias("transitions"), zero().alias("t"), zero().alias("f"),
        F.lit(None).cast("boolean").alias("state"), zero().alias("length"), F.lit(-2).cast("bigint").alias("end"),
    )

    def join(acc: Column, chunk: Column) -> Column:
        s = chunk["s"]
        touch = acc["end"] + 1 == s["head"]
        goes_on = touch & F.coalesce(acc["state"] == s["head_state"], F.lit(False))
        head = s["head_length"] + F.when(goes_on, acc["length"]).otherwise(zero())
        one = s["head"] + s["head_length"] - 1 == s["tail"]
        best = lambda flag, kept, own: F.greatest(acc[kept], s[own], F.when(s["head_state"] == flag, head).otherwise(zero()))
        return F.struct(
            (acc["observed"] + s["observed"]).alias("observed"),
            (acc["transitions"] + s["transitions"] + (touch & ~goes_on).cast("bigint")).alias("transitions"),
            best(True, "t", "longest_true").alias("t"),
            best(False, "f", "longest_false").alias("f"),
            s["tail_state"].alias("state"),
            F.when(one, head).otherwise(s["tail_length"]).alias("length"),
            s["tail"].alias("end"),
        )

    m = F.aggregate("c", start, join)
    done = chunks.select(*keys, m.alias("m"))
    return done.select(*keys, "m.observed", "m.transitions", F.col("m.t").alias("longest_true"), F.col("m.f").alias("longest_false"))


def run_states(states: DataFrame, patience: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Short runs of every chunk of a stream (series_id, position, state, arrived) that got rows, and late positions."""
    rows = with_state(states).withColumn("chunk", F.floor(F.col("position") / chunk))
    if patience is not None:
        rows = rows.withWatermark("arrived", patience)
    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)
    return rows.groupBy("series_id", "chunk").transformWithStateInPandas(
        RunStates(chunk, wait), RUN_STATES, "update", "None" if patience is None else "EventTime"
    )


def stream_runs(states: DataFrame, folder: str, patience: str | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(run summary of every series, late positions) of a stream of states in any order of arrival.

    A series is cut into chunks of positions, each with a state of its own, so a hot series is spread over tasks; the sink keeps the
    short forms by batch, and the latest of every chunk are joined.
    """
    spark = states.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("kind = 'runs'").drop("kind", "position", "state").write.mode("overwrite").parquet(f"{folder}/runs/batch={batch_id}")
        batch.where("kind = 'late'").select("series_id", "position", "state").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        batch.unpersist()

    drain(run_states(states, patience, chunk), each, folder, "update")
    return merge_runs(spark.read.parquet(f"{folder}/runs"), ["series_id"]), spark.read.parquet(f"{folder}/late").drop("batch")


def upsert_partials(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key and field the earliest (order, value) and the range of canonical values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = rows.select(key, F.col(order).alias("seen"), F.explode(pairs).alias("p")).select(key, "seen", "p.field", "p.value")
    form = canonical(F.col("value"))
    earliest = F.min(F.when(F.col("value").isNotNull(), F.struct("seen", "value")))
    return long.groupBy(key, "field").agg(earliest.alias("first"), F.min(form).alias("low"), F.max(form).alias("high"))


def merge_upserts(partials: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, rejects): the earliest value of every field, and the keys and fields whose
    observations disagree. Minima and maxima merge alike in any order and any cut into batches."""
    per = partials.groupBy(key, "field").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    clash = F.col("low") != F.col("high")
    merged = per.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("first.value"))).alias(f) for f in fields])
    rejects = per.where(clash).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("field")), "|").alias("conflicts"))
    return merged, rejects


def stream_upsert(stream: DataFrame, to_rows, key: str, order: str, fields: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Idempotent merge of arriving observations: every batch appends partials under its id (a
    replay overwrites itself), and the merged table does not depend on batches or arrival."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_partials(to_rows(batch), key, order, fields).write.mode("overwrite").parquet(f"{folder}/partials/batch={batch_id}")

    drain(stream, each, folder)
    return merge_upserts(spark.read.parquet(f"{folder}/partials"), key, fields)
