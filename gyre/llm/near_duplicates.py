"""Operator 5: exact n-gram Jaccard join by prefix filters under several global token orders.

1. Every text becomes its set of distinct word shingles; equal sets form one class.
2. Chunks of texts ask the corpus which of their shingles occur in two or more chunks' sets, and
   how often. A shingle that occurs once matches nothing and stands first in every order, so only
   shared shingles are carried on.
3. Under each of `ORDERS` total orders (rarity class first, then a hash of its own) two sets of
   Jaccard similarity >= t share one of their first |x| - ceil(t |x|) + 1 tokens, lie within the
   length bound, and the shared token's place leaves room for the overlap (position bound).
4. Round one verifies each set against `CENTRES` sets per prefix token and length band: linear in
   the postings, and enough to join large groups of near copies.
5. Round two meets the sets of different components that share a prefix token and are in bounds. They are
   dealt into blocks by their commonest such token, and pairs of blocks are worked off in one grouped step: a candidate shares
   prefix tokens under all orders, only candidates are verified, and a link is emitted only where it joins
   components that are still apart, so what leaves the step is linear in the sets.

Texts are compared by 56-bit hashes of shingles: a pair of sets of 1000 is miscounted with a probability
under 10^6 / 2^56, about 10^-11. Null and empty texts, and texts without words,
have the empty set and link with nothing. Repeated rows are separate rows of one class. A null id
gets its class's smallest id, or null if there is none. Memory is bounded by a chunk of texts or two blocks of sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm import text as X
from gyre.llm.components import components
from gyre.llm.exchange import (
    ASK,
    answers,
    ask_rows,
    buckets_for,
    chunk_rows,
    coded,
    counted,
    decoded,
    give_back,
    giving_back,
    in_chunks,
    looked_up,
    partitions,
    reply_arrays,
    total_bytes,
    written,
)

ORDERS = 3
CENTRES = 3
PERCENT = 75
CHUNK_BYTES = 5 << 20
BLOCK_TOKENS = 1 << 18  # shingles of a block of sets; a larger set is a block of its own


def _sets(column, size: int):
    """(row, distinct shingles ascending) of every text of a batch."""
    data, offsets = X.batch_bytes(column)
    for lo, hi in X.blocks(offsets):
        part = X.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = X.word_spans(part, offsets[lo : hi + 1] - offsets[lo], X.NOT_BLANK)
        shingles, at = X.shingle_hashes(X.word_hashes(part, starts, ends), first, size)
        for i in range(hi - lo):
            yield lo + i, np.unique(shingles[at[i] : at[i + 1]] >> np.uint64(8))


def _signature(shingles: np.ndarray) -> int:
    total = X.mix(np.add.reduce(X.salted(shingles, 7), dtype=np.uint64, keepdims=True) + np.uint64(len(shingles)))
    return int(total.view(np.int64)[0])


def _first_tokens(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _asks(size: int, buckets: int):
    @giving_back
    def run(table: pa.Table) -> pa.Table:
        seen, parts = set(), []
        for _, shingles in _sets(chunk_rows(table)["text"], size):
            signature = _signature(shingles)
            if len(shingles) and signature not in seen:
                seen.add(signature)
                parts.append(shingles)
        names, counts = counted(np.concatenate(parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return ask_rows(table["chunk"][0].as_py(), names, counts, buckets)

    return run


_CLASS = pa.schema(
    [("sig", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("tokens", pa.binary()), ("rank", pa.binary())]
)
CLASS = "sig long, n int, ids array<long>, tokens binary, rank binary"


def _classes(size: int, percent: int):
    """Rows of one chunk: the sets in it with their ids, and their shared tokens with rarity."""

    @giving_back
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        known, counts, _ = reply_arrays(replies)
        rarity = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)
        rows = chunk_rows(texts)
        ids = rows["doc_id"].to_pylist() if rows else []
        found: dict[int, list] = {}
        for row, shingles in _sets(rows["text"], size) if rows else ():
            signature, n = _signature(shingles), len(shingles)
            if signature in found:
                found[signature][1].append(ids[row])
                continue
            shared, place = looked_up(shingles, known)
            tokens, rank = shingles[shared], rarity[place[shared]]
            if _first_tokens(np.int64(n), percent) - (n - len(tokens)) <= 0:
                tokens, rank = tokens[:0], rank[:0]
            found[signature] = [n, [ids[row]], coded(tokens), X.packed(rank)]
        rows = list(found.items())
        return pa.table(
            {
                "sig": pa.array([k for k, _ in rows], pa.int64()),
                "n": pa.array([v[0] for _, v in rows], pa.int32()),
                "ids": pa.array([v[1] for _, v in rows], pa.list_(pa.int64())),
                "tokens": pa.array([v[2] for _, v in rows], pa.binary()),
                "rank": pa.array([v[3] for _, v in rows], pa.binary()),
            },
            _CLASS,
        )

    return run


POSTING = "token long, sig long, n int, place int"


def _prefix(n: int, tokens: np.ndarray, rank: np.ndarray, percent: int, order_no: int) -> np.ndarray:
    """Shared tokens among the first |x| - ceil(t |x|) + 1 of a set under one order."""
    take = int(_first_tokens(np.int64(n), percent)) - (n - len(tokens))
    return tokens[np.lexsort((X.salted(tokens, 100 + order_no), rank))[: max(take, 0)]]


def _postings(percent: int):
    """Prefix tokens under the first order; `place` counts the tokens before, unshared ones too."""

    def run(batches):
        give_back()
        for batch in batches:
            out = ([], [], [], [])
            for sig, n, tokens, rank in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "tokens", "rank"))):
                tokens, rank = decoded(tokens), X.unpacked(rank, np.uint8)
                chosen = _prefix(n, tokens, rank, percent, 0)
                out[0].append(chosen.view(np.int64))
                out[1].append(np.full(len(chosen), sig, np.int64))
                out[2].append(np.full(len(chosen), n, np.int32))
                out[3].append(np.arange(n - len(tokens), n - len(tokens) + len(chosen), dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "sig", "n", "place"])

    return run


def _verify(percent: int):
    """Pairs that share a prefix token under the other orders too, then the exact similarity."""

    def run(batches):
        give_back()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "ta", "tb", "ra", "rb")]
            keep_a, keep_b = [], []
            for a, b, na, nb, ta, tb, ra, rb in zip(*columns):
                ta, tb, ra, rb = decoded(ta), decoded(tb), X.unpacked(ra, np.uint8), X.unpacked(rb, np.uint8)
                if not all(
                    np.isin(_prefix(na, ta, ra, percent, k), _prefix(nb, tb, rb, percent, k)).any() for k in range(1, ORDERS)
                ):
                    continue
                both = len(np.intersect1d(ta, tb, assume_unique=True))
                if 100 * both >= percent * (na + nb - both):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that reach the threshold."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("rank").alias("ra"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("rank").alias("rb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb", "ra", "rb")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _overlap(percent: int, *sizes: str):
    """Smallest intersection of two sets of the given sizes that reaches the threshold."""
    return F.ceil(sum(F.col(s) for s in sizes) * percent / (100.0 + percent) - 1e-9)


def _units(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, block, sig, comp, n, tokens, rank): the sets of a pair of blocks that have to meet.

    A block holds sets of one leader, the commonest prefix token of a set among those at which
    different components still meet, and about `BLOCK_TOKENS` shingles, so the many sets of a large group
    lie in a few blocks. A set is sent to another block if both hold one of its tokens: once for
    a whole block, not once for every partner. `room` is what is left of a set from a token on and bounds
    the overlap; in every pair the smaller set needs room for an overlap with one of its own size, so
    tokens where no set has it (strong) are left out.
    """
    rows = postings.withColumn("strong", F.col("n") - F.col("place") >= _overlap(percent, "n", "n"))
    shared = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("strong").alias("s"), F.count(F.lit(1)).alias("held"))
    rows = rows.join(shared.where("s and c0 != c1").select("token", "held"), "token").select("token", "sig", "comp", "n", "held")
    rows = written(rows)
    leaders = rows.groupBy("sig", "comp", "n").agg(F.max(F.struct("held", "token"))["token"].alias("leader"))
    weight = leaders.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).alias("blocks"))
    blocks = leaders.join(weight, "leader").select("sig", "comp", F.xxhash64("leader", F.pmod(F.xxhash64("sig"), F.col("blocks"))).alias("block"))
    at = rows.select("token", "sig").join(blocks, "sig")
    seats = at.groupBy("token").agg(F.collect_set("block").alias("others"))
    meets = at.join(seats, "token").groupBy("sig", "comp", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    meets = meets.select("sig", "comp", "block", F.explode("others").alias("other"))
    meets = meets.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "sig", "comp")
    return meets.join(sets, "sig").select("a", "b", "block", "sig", "comp", "n", "tokens", "rank")


class _Postings:
    """Which of `n` sets hold a token, for token lists of the sets."""

    def __init__(self, lists: list[np.ndarray], width: int):
        flat = np.concatenate([np.zeros(0, np.int64), *lists])
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        self.sets, self.first, self.n = of[order], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=width))]), len(lists)

    def holders(self, tokens: np.ndarray) -> np.ndarray:
        start, size = self.first[tokens], self.first[tokens + 1] - self.first[tokens]
        out = np.zeros(self.n, bool)
        out[self.sets[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return out


def _unit_links(percent: int):
    """Links between the sets of two blocks that join components not joined before: candidates share prefix
    tokens under every order, and only these are verified."""

    def run(table: pa.Table) -> pa.Table:
        sig, block, n = (np.asarray(table[c]) for c in ("sig", "block", "n"))
        n = n.astype(np.int64)
        label = np.unique(np.asarray(table["comp"]), return_inverse=True)[1]
        names = [decoded(t) for t in table["tokens"].to_pylist()]
        known, flat = np.unique(np.concatenate(names), return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        ranks = [X.unpacked(r, np.uint8) for r in table["rank"].to_pylist()]
        prefix = [[np.searchsorted(known, _prefix(int(m), t, r, percent, k)) for m, t, r in zip(n, names, ranks)] for k in range(ORDERS)]
        one = table["a"][0].as_py() == table["b"][0].as_py()
        here = np.arange(len(sig)) if one else np.flatnonzero(block == table["a"][0].as_py())
        there = np.arange(len(sig)) if one else np.flatnonzero(block != table["a"][0].as_py())
        held = [_Postings([p[i] for i in there], len(known)) for p in prefix]
        left, right, seen = [], [], np.zeros(len(known), bool)
        for i in here.tolist():
            alive = (label[there] != label[i]) & (100 * np.minimum(n[there], n[i]) >= percent * np.maximum(n[there], n[i]))
            if one:
                alive[: i + 1] = False
            for postings, p in zip(held, prefix):
                if alive.any():
                    alive &= postings.holders(p[i])
            found = there[alive]
            if not len(found):
                continue
            own = flat[at[i] : at[i + 1]]
            seen[own] = True
            for j in found.tolist():
                if label[j] != label[i]:
                    both = int(seen[flat[at[j] : at[j + 1]]].sum())
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        left.append(sig[i])
                        right.append(sig[j])
                        label[label == label[j]] = label[i]
            seen[own] = False
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_rows) per row of `docs`; see the module's notes."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size_sum, n = total_bytes(chosen, F.octet_length("text")), partitions(docs)
    per_partition = max(1, -(-size_sum // (n * CHUNK_BYTES)))
    chunks, buckets = in_chunks(chosen, per_partition=per_partition), buckets_for(size_sum, n * per_partition)
    replies = answers(chunks.groupBy("chunk").applyInArrow(_asks(size, buckets), ASK))
    local = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_classes(size, percent), CLASS)
    local = written(local)
    ids = local.select("sig", "n", F.explode("ids").alias("doc_id"))
    sets = local.where("length(tokens) > 0").groupBy("sig").agg(
        F.first("n").alias("n"), F.max(F.struct(F.length("tokens"), "tokens", "rank")).alias("best")
    )
    sets = written(sets.select("sig", "n", "best.tokens", "best.rank"))
    postings = written(sets.mapInArrow(_postings(percent), POSTING))

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).alias("band")
    first = postings.select("token", "sig", band)
    lowest_by = lambda k: F.min(F.struct(F.xxhash64("sig", F.lit(k)).alias("h"), "sig"))["sig"]
    centre = first.groupBy("token", "band").agg(F.array_distinct(F.array(*[lowest_by(k) for k in range(CENTRES)])).alias("centres"), F.count(F.lit(1)).alias("held"))
    star = first.join(centre.where("held > 1").drop("held"), ["token", "band"]).select("sig", F.explode("centres").alias("a"))
    star = star.where("sig != a").select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct()
    star = written(star)
    links = written(_links(star, sets, percent))
    joined = components(links)

    with_comp = postings.join(joined.withColumnRenamed("node", "sig"), "sig", "left")
    with_comp = written(with_comp.select("token", "sig", "n", "place", F.coalesce("component", "sig").alias("comp")))
    more = written(_units(with_comp, sets, percent).groupBy("a", "b").applyInArrow(_unit_links(percent), "a long, b long"))
    known = joined.select(F.col("node").alias("sig"), "component")
    side = lambda c: known.select(F.col("sig").alias(c), F.col("component").alias(f"of_{c}"))
    bridge = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")
    )
    wider = components(bridge).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    alone = more.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(known, "sig", "left_anti").select("sig", F.col("sig").alias("component"))
    whole = known.union(alone).join(wider, "component", "left").select(F.col("sig").alias("node"), F.coalesce("wider", "component").alias("component"))

    classes = ids.groupBy("sig").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("class_rows"))
    group = classes.join(whole.withColumnRenamed("node", "sig"), "sig", "left").withColumn("group", F.coalesce("component", "sig"))
    lowest = group.groupBy("group").agg(F.min("low").alias("component_id"))
    named = group.join(lowest, "group").select("sig", "class_rows", "component_id")
    return ids.join(named, "sig").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "class_rows",
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLES = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
c AS (SELECT list_sort(list(g)) AS l, r FROM s GROUP BY r),
same AS (SELECT r, min(r) OVER (PARTITION BY l) AS rep, len(l) AS n, count(*) OVER (PARTITION BY l) AS class_rows FROM c),
rare AS (SELECT g FROM s JOIN same USING (r) WHERE r = rep GROUP BY g HAVING count(*) > 1),
p AS (SELECT r, g FROM s JOIN rare USING (g) JOIN same USING (r) WHERE r = rep),
inter AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM p a JOIN p b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM inter JOIN same u ON u.r = x JOIN same v ON v.r = y WHERE 100 * common >= 75 * (u.n + v.n - common)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT r, r FROM same WHERE r = rep UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y),
low AS (SELECT rep, min(doc_id) AS doc_id FROM same JOIN d USING (r) GROUP BY rep),
comp AS (SELECT reach.x AS rep, min(low.doc_id) AS component_id FROM reach JOIN low ON low.rep = reach.y GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       CAST(coalesce(class_rows, (SELECT count(*) FROM d WHERE len(w) = 0)) AS BIGINT) AS class_rows
FROM d LEFT JOIN same USING (r) LEFT JOIN comp USING (rep)""",
}
