"""Operator 13: phrase collocation mining by top-order marginalisation.

Every word of a text opens one window: the word and the words after it in its piece, `ORDER` at most, padded
where the piece ends. An occurrence of a phrase is the beginning of exactly one window, so only these longest windows
are counted, and Spark's ROLLUP over (w1, .., w4) sums them to the counts of all shorter phrases; no shorter n-gram
is ever exploded.

A phrase below `LEAST` occurrences is neither a candidate nor a part of one, and no phrase that holds it
reaches `LEAST`. So windows are padded from there on: first at words below `LEAST`, which a word count over all texts finds
and numbers (a number stands for a word of one language), then, when the windows of all chunks meet in buckets, at the longest
beginning that is frequent. What leaves a bucket are few windows, and ROLLUP sums these exactly.

Hot keys: windows are summed inside a chunk of texts first. A bucket holds all windows of its word pairs; a pair occurs at most
as often as its rarer word, so a pair whose words are both more frequent than a bucket's share of all words is spread by its third
word, and likewise by its fourth. Spread beginnings are not cut; the ROLLUP and its final filter settle them.

Text: A-Z in lower case, pieces end at `.,;:!?` and line ends, words at space and tab. Null text has no words; null lang
is `und`. Ids play no part, repeated rows count each time, tables without words give no rows. Columns of other
names are ignored. Counts are longs, products decimals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm.exchange import chunk_rows, chunks_for, in_chunks, written
from gyre.llm.text import LOWER, batch_bytes, mix, word_spans

LEAST = 30
ORDER = 4
TOP = 2000
SCALE = 2_000_000
CHUNK_BYTES = 6 << 20  # text of a chunk; a task holds some forty times that
ABSORBED = 80  # percent of a phrase's occurrences inside a longer candidate
UNKNOWN = "und"
WORDS = tuple(f"w{k + 1}" for k in range(ORDER))
COUNTED = "chunk long, lang string, word string, n long"
PACKED = "bucket int, payload binary"
WINDOW = ", ".join(f"{w} int" for w in WORDS) + ", n long"
_counted = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_packed = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_windows = pa.schema([*((w, pa.int32()) for w in WORDS), ("n", pa.int64())])
_inner = pa.schema([*((w, pa.uint32()) for w in WORDS), ("n", pa.uint32()), ("keep", pa.uint8())])
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False


class _Words:
    """Words of a chunk's texts in order: language, place in the dictionary, and how many are left in the piece."""

    def __init__(self, rows: pa.Table):
        data, offsets = batch_bytes(rows["text"])
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, _WORD)
        lang = rows["lang"].combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        self.langs = lang.dictionary
        of = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.diff(first))
        doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
        piece = np.cumsum(_PIECE_END[data], dtype=np.int32)[starts] if len(starts) else starts
        new = np.ones(len(starts) + 1, bool)
        new[1:-1] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        edges = np.flatnonzero(new)
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(starts)) if len(starts) else starts
        self.left = np.minimum(left, ORDER).astype(np.int8)
        del doc, piece, new, left
        letters = data[_WORD[data]]
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        self.words = words.dictionary.cast(pa.string())
        self.entry = of.astype(np.int64) * max(len(self.words), 1) + words.indices.to_numpy()  # tells language and word

    def entries(self, entry: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(languages, words) of entries."""
        width = max(len(self.words), 1)
        return self.langs.take(pa.array(entry // width)), self.words.take(pa.array(entry % width))


def _count_words(texts: pa.Table) -> pa.Table:
    rows = chunk_rows(texts)
    if rows is None:
        return _counted.empty_table()
    words = _Words(rows)
    entry, counts = np.unique(words.entry, return_counts=True)
    lang, word = words.entries(entry)
    return pa.table([pa.array(np.full(len(entry), texts["chunk"][0].as_py()), pa.int64()), lang.cast(pa.string()), word, pa.array(counts, pa.int64())], schema=_counted)


def _blob(columns: list[np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _inner, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(columns, _inner)], schema=_inner))
    return sink.getvalue().to_pybytes()


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct rows of `columns` in order, sums of `n`, place of the first of each)."""
    one, two = columns[0] << np.int64(32) | columns[1], columns[2] << np.int64(32) | columns[3]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    cuts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else order
    first = order[cuts]
    return [c[first] for c in columns], np.add.reduceat(n[order], cuts) if len(cuts) else n[:0], first


def _windows_of(buckets: int, hot: int):
    """Distinct windows of frequent words of a chunk with their number, packed by bucket."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        rows = chunk_rows(texts)
        if rows is None or not known.num_rows:
            return _packed.empty_table()
        words = _Words(rows)
        entry = np.unique(words.entry)
        join = lambda lang, word: pa.compute.binary_join_element_wise(lang, word, pa.scalar("\n", pa.large_string()))  # noqa: E731  no word holds a line end
        found = pa.compute.index_in(join(*(x.cast(pa.large_string()) for x in words.entries(entry))), join(*(known[c].combine_chunks().cast(pa.large_string()) for c in ("lang", "word"))))
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        place = np.searchsorted(entry, words.entry).astype(np.int32)
        words.entry = None
        number = np.where(at >= 0, known["id"].to_numpy()[at], 0).astype(np.int32)[place]
        common = np.where(at >= 0, known["f"].to_numpy()[at] >= hot, False)[place]
        del place
        parts, much, alive = [number], [common], number > 0
        for k in range(1, ORDER):
            alive = alive & (words.left > k)
            follows = np.zeros_like(number)
            follows[: len(number) - k] = number[k:]
            parts.append(np.where(alive, follows, 0))
            alive &= parts[-1] > 0
            shifted = np.zeros_like(common)
            shifted[: len(number) - k] = common[k:]
            much.append(much[-1] & shifted & alive)
        keep = 1 + much[1].astype(np.int8) + much[2]
        open_ = np.flatnonzero(number)
        columns = [p[open_].astype(np.int64) for p in parts]
        del parts, much, alive, follows, shifted, number, common
        columns, n, first = _summed(columns, np.ones(len(open_), np.int64))
        keep = keep[open_][first]
        pair = mix((columns[0] << np.int64(32) | columns[1]).view(np.uint64))
        third = mix(pair ^ columns[2].view(np.uint64))
        bucket = np.where(keep == 1, pair, np.where(keep == 2, third, mix(third ^ columns[3].view(np.uint64)))) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(bucket))
        columns = [c[order] for c in (*columns, n, keep)]
        blobs = [_blob([c[a:b] for c in columns]) for a, b in zip(cuts.tolist(), ends.tolist())]
        return pa.table([pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary())], schema=_packed)

    return run


def _cut_windows(least: int):
    """Windows of a bucket summed over all chunks, each padded after its longest frequent beginning."""

    def run(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table["payload"]])
        columns = [rows[w].to_numpy().astype(np.int64) for w in WORDS]
        columns, n, first = _summed(columns, rows["n"].to_numpy().astype(np.int64))
        keep, length, whole = rows["keep"].to_numpy()[first], np.ones(len(n), np.int64), np.ones(len(n), bool)
        new = np.zeros(len(n), bool)
        new[:1] = True
        new[1:] = columns[0][1:] != columns[0][:-1]
        for k in range(1, ORDER):
            new[1:] |= columns[k][1:] != columns[k][:-1]
            group = np.cumsum(new) - 1
            often = np.bincount(group, n, minlength=0)[group] >= least
            whole &= (columns[k] > 0) & (often | (keep > k))
            length += whole
        columns = [np.where(length > k, c, 0) for k, c in enumerate(columns)]
        columns, n, _ = _summed(columns, n)
        return pa.table([*(pa.array(c, pa.int32()) for c in columns), pa.array(n, pa.int64())], schema=_windows)

    return run


def numbered(words: DataFrame) -> DataFrame:
    """`words` (lang, word, f) with `id`, from 1 by falling frequency; one number a partition reaches the driver."""
    rows = written(words.orderBy(F.desc("f"), "lang", "word").withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.concatenate([[1], 1 + np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    start = F.get(F.array(*[F.lit(int(s)).cast("long") for s in starts]), part.cast("int"))
    return rows.select("lang", "word", "f", (start + place).cast("int").alias("id"))


def windows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((w1..w4, n): padded longest windows of word numbers, 0 pads; the dictionary (lang, word, f, id);
    the words of each language (lang, n))."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    n = chunks_for(texts, F.octet_length("text"), CHUNK_BYTES)
    chunks = in_chunks(texts, by=None, chunks=n)
    counted = written(chunks.groupBy("chunk").applyInArrow(_count_words, COUNTED))
    totals = written(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    every = totals.agg(F.sum("n")).first()[0] or 0
    sums = counted.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    dictionary = written(numbered(sums))
    known = counted.join(dictionary, ["lang", "word"]).select("chunk", "lang", "word", "f", "id")
    hot = max(least, every // n)
    packed = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_windows_of(n, hot), PACKED)
    return packed.groupBy("bucket").applyInArrow(_cut_windows(least), WINDOW), dictionary, totals


def phrase_counts(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """(words, f): ROLLUP of the windows to all phrases of `least` occurrences, as arrays of word numbers."""
    level = F.lit(ORDER) - F.bit_count(F.grouping_id())
    sums = counted.rollup(*WORDS).agg(F.sum("n").alias("f"), level.alias("level")).where((F.col("level") > 0) & (F.col("f") >= least))
    return sums.select(F.slice(F.array(*WORDS), F.lit(1), F.col("level")).alias("words"), "f").where(F.element_at("words", -1) != 0)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of every language."""
    counted, dictionary, totals = windows(docs, text_col, lang_col, least)
    counts = written(phrase_counts(counted, least))
    candidates = counts.where(F.size("words") >= 2).withColumnRenamed("f", "a")
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits

    cuts = candidates.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumns({"wide_a": wide("a") * F.lit(SCALE).cast("decimal(10,0)"), "parts": wide("l") + wide("r")})
    worst = cuts.groupBy("words", "a").agg(F.min(F.struct(F.expr("wide_a div parts").alias("score"), "k", "l", "r")).alias("cut"))

    size = F.size("words")
    parts = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)))
    )
    inner = candidates.where(size >= 3).select(F.col("a").alias("longer"), F.explode(parts).alias("words"))
    inner = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = worst.join(inner, "words", "left").where(
        F.col("longer").isNull() | (wide("longer") * F.lit(100).cast("decimal(3,0)") < wide("a") * F.lit(ABSORBED).cast("decimal(3,0)"))
    )
    kept = kept.select("words", "a", "cut.score", "cut.l", "cut.r")
    for k in range(ORDER):
        names = dictionary.select(F.col("id").alias("__id"), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 0 else []))
        kept = kept.join(names, F.get("words", F.lit(k)) == F.col("__id"), "left").drop("__id")
    phrase = F.array_join(F.array(*[F.col(f"t{k}") for k in range(ORDER)]), " ").alias("phrase")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", phrase, "a", "score", "l", "r").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, ws[i : i + k - 1] AS words, count(*) AS f FROM places, (VALUES (1), (2), (3), (4)) s(k)
          WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.f) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM grams WHERE len(words) >= 2) c
  JOIN grams x ON x.lang = c.lang AND x.words = c.words[1 : k]
  JOIN grams y ON y.lang = c.lang AND y.words = c.words[k + 1 :]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT lang, words[i : i + m - 1] AS words, max(f) AS longer
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(words))) AS m FROM grams WHERE len(words) >= 3))
  GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.words, ' ') AS phrase, a, l, r, score FROM worst w
  LEFT JOIN inside s ON s.lang = w.lang AND s.words = w.words
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT k.lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k JOIN totals USING (lang)
WHERE rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": SQL}
