"""Ask the whole corpus how often names occur.

A name is a 56-bit hash. Texts are dealt out once into chunks; a chunk asks for its distinct names
(counted inside the chunk first, so a name that a third of all texts hold is sent once a chunk),
names meet in buckets, and every chunk is told which of its names occur at least twice. Both
ways the rows carry packed arrays, and no name table is ever broadcast or collected.
"""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gyre.llm.text import packed, unpacked
from gyre.session import written  # noqa: F401  the operators here take it from this module

CHUNK_BYTES = 16 << 20
PIECE_BYTES = 2 << 10  # text behind what one chunk asks of one bucket, at least
ASK = "chunk long, bucket int, names binary, counts binary"
REPLY = "chunk long, names binary, counts binary, first binary"
_ask = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])
_reply = pa.schema([("chunk", pa.int64()), ("names", pa.binary()), ("counts", pa.binary()), ("first", pa.binary())])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def coded(names: np.ndarray) -> bytes:
    """Ascending names as differences, byte plane by byte plane, which compresses well."""
    steps = np.diff(names, prepend=np.uint64(0))
    return packed(steps.view(np.uint8).reshape(-1, 8).T)


def decoded(blob) -> np.ndarray:
    planes = np.frombuffer(blob or b"", np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    chunk = batch.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    rows = pa.Table.from_batches([batch]).drop_columns("chunk")
    chunk = chunk[order]
    cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
    blobs = []
    for a, b in zip(cuts, np.append(cuts[1:], len(chunk))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.take(pa.array(order[a:b])).combine_chunks())
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(chunk[cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "payload"])


def _payloads(batches):
    """Rows of a batch by chunk, each chunk's rows as one compressed arrow stream."""
    give_back()
    for batch in batches:
        dealt = _packed_rows(batch)
        del batch
        yield dealt
        del dealt
        give_back()


def total_bytes(df: DataFrame, size: Column) -> int:
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def chunks_for(df: DataFrame, size: Column, chunk_bytes: int = CHUNK_BYTES) -> int:
    """So many chunks that one holds about `chunk_bytes`, one a shuffle partition at least."""
    return max(partitions(df), -(-total_bytes(df, size) // chunk_bytes))


def buckets_for(size: int, chunks: int) -> int:
    """Buckets for the names of `chunks` chunks of `size` bytes together: half as many as chunks, but only as many as leave
    each pair of them `PIECE_BYTES`. A pair is a row of `ASK`, so the rows grow with the texts, however many chunks there are."""
    return max(1, min(-(-chunks // 2), size // (chunks * PIECE_BYTES)))


def in_chunks(docs: DataFrame, by: tuple[str, ...] | None = ("doc_id", "text"), per_partition: int = 1, chunks: int | None = None) -> DataFrame:
    """`docs` as rows (chunk, payload), dealt by a hash of the columns `by` (None: of the row's number, for
    tables in files, where equal rows have to spread). The exchange is the same wherever this frame is
    used in a plan, so Spark writes it once."""
    n = chunks or partitions(docs)
    key = F.xxhash64(*by) if by else F.xxhash64(F.monotonically_increasing_id())
    chunk = F.pmod(key, F.lit(n * per_partition)).alias("chunk")
    return docs.select(chunk, *docs.columns).mapInArrow(_payloads, "chunk long, payload binary").repartition(n, "chunk")


def give_back() -> None:
    """Free memory that this worker keeps from chunks and stages before goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def giving_back(step):
    """`step` of one or two tables, for applyInArrow; what it worked in goes back when it is done, as its worker may idle
    while others run."""

    def one(table: pa.Table) -> pa.Table:
        found = step(table)
        give_back()
        return found

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        found = step(left, right)
        give_back()
        return found

    return one if len(inspect.signature(step).parameters) == 1 else two


def chunk_rows(table: pa.Table) -> pa.Table | None:
    """The rows packed in a chunk, or None for an empty chunk."""
    if not table.num_rows:
        return None
    give_back()
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table["payload"]])


def ask_rows(chunk: int, names: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """One row a bucket for the distinct, ascending `names` of a chunk."""
    place = ((names >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
    counts, ends = counts.astype(np.uint32), np.append(cuts[1:], len(place))
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(cuts), pa.int64()),
            "bucket": pa.array(place[cuts].astype(np.int32)),
            "names": pa.array([coded(names[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([packed(counts[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        },
        _ask,
    )


def _answer(table: pa.Table, least: int = 2) -> pa.Table:
    names = [decoded(b) for b in table["names"].to_pylist()]
    sizes = np.array([len(x) for x in names], np.int64)
    names = np.concatenate(names)
    counts = np.concatenate([unpacked(b, np.uint32) for b in table["counts"].to_pylist()]).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.asarray(table["chunk"])[row], names))
    names, counts, row = names[order], counts[order], row[order]
    cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    totals = np.add.reduceat(counts, cuts) if len(cuts) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(cuts, len(names)))
    total = np.repeat(totals, lengths)
    first = np.zeros(len(names), np.uint8)
    first[cuts] = 1
    keep = total >= least
    names, total, first, row = names[keep], np.minimum(total[keep], 2**32 - 1).astype(np.uint32), first[keep], row[keep]
    order = np.argsort(row, kind="stable")
    names, total, first, row = names[order], total[order], first[order], row[order]
    cuts = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(cuts[1:], len(row))
    chunks = np.asarray(table["chunk"])
    return pa.table(
        {
            "chunk": pa.array(chunks[row[cuts]], pa.int64()),
            "names": pa.array([coded(names[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([packed(total[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
            "first": pa.array([packed(first[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        },
        _reply,
    )


def answers(asks: DataFrame, least: int = 2) -> DataFrame:
    """Rows of `ASK` to rows of `REPLY`: names with a total of `least` or more, `first` marking the
    one chunk (the lowest) that stands for the name."""

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        return _answer(table, least)

    return asks.groupBy("bucket").applyInArrow(run, REPLY)


def reply_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names ascending, counts, first) of a chunk's replies."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    names = np.concatenate([decoded(b) for b in table["names"].to_pylist()])
    counts = np.concatenate([unpacked(b, np.uint32) for b in table["counts"].to_pylist()])
    first = np.concatenate([unpacked(b, np.uint8) for b in table["first"].to_pylist()])
    order = np.argsort(names, kind="stable")
    return names[order], counts[order], first[order]


def counted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(names, return_counts=True)


def looked_up(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of `names` in the ascending array `known`."""
    if not len(known):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    place = np.searchsorted(known, names)
    place[place == len(known)] = 0
    return known[place] == names, place


def _kept_rows(id_col: str, text_col: str, empty: pa.Table):
    @giving_back
    def run(texts: pa.Table, ids: pa.Table) -> pa.Table:
        rows = chunk_rows(texts)
        if rows is None or not ids.num_rows:
            return empty
        wanted = np.flatnonzero(pa.compute.is_in(rows[id_col], ids["kept_id"].combine_chunks()).to_numpy())
        seen, take = set(), []
        for i in wanted:
            row = (rows[id_col][i].as_py(), rows[text_col][i].as_py())
            if row not in seen:
                seen.add(row)
                take.append(i)
        return rows.take(pa.array(take, pa.int64()))

    return run


def rows_with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` whose id is in the first column of `ids`, one for equal (id, text). Texts go
    through the shuffle compressed."""
    chunks = in_chunks(docs, by=(id_col,))
    ids = ids.select(F.col(ids.columns[0]).alias("kept_id")).where("kept_id is not null")
    ids = ids.select(F.pmod(F.xxhash64("kept_id"), F.lit(partitions(docs))).alias("chunk"), "kept_id")
    empty = to_arrow_schema(docs.schema).empty_table()
    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_kept_rows(id_col, text_col, empty), docs.schema)
