"""Corpus cleaning in five stages, each reading what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`, but for the last,
which returns the mix. `run` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.decontamination import contamination
from gyre.llm.exchange import rows_with_ids
from gyre.llm.mixing import mixed
from gyre.llm.near_duplicates import jaccard_components
from gyre.llm.substrings import remove_repeats
from gyre.llm.toxicity import remainder, toxicity
from gyre.session import scratch_dir, scratch_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs.select(*COLUMNS), labels, learn=remainder(F.col("doc_id"), 5) != 0)
    return scored.where("predicted = 0").select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (null last) of every group linked by shingle similarity stays. Rows are
    told apart by a hash of all their columns, so null and repeated ids take part; rows equal in all
    columns count once."""
    row = F.xxhash64(*[c for name in COLUMNS for c in (F.isnull(name), F.col(name))]).alias("row_key")
    docs = docs.select(*COLUMNS, row)
    groups = jaccard_components(docs.select("row_key", "text"), id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    named = groups.join(docs.select("row_key", "doc_id").distinct(), "row_key")
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_key"))["row_key"].alias("row_key")
    keep = named.groupBy("component_id").agg(first).select("row_key")
    return rows_with_ids(docs, keep, id_col="row_key").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 200-byte strings that start elsewhere too are cut from every text."""
    cut = remove_repeats(docs.select(*COLUMNS), with_text=True)
    text = F.col("kept_text")
    return cut.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of every document under the source weights."""
    rows = mixed(docs.select(*COLUMNS))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]
ORACLE_SQL = None  # toxicity and repeated strings have no SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that a stage made on its way are deleted when its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
