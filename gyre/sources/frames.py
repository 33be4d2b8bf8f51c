"""Frame and catalogue sources, their checks, orderings and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.functions.guards import finite
from gyre.functions.ranking import ranked_values, value_table

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("lab", T.StringType()),
        T.StructField("report_number", T.StringType()),
        T.StructField(
            "listings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("observed_at", T.TimestampType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("price", T.DecimalType(12, 2)),
                        T.StructField("currency", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "evidence",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("record_key", T.StringType()),
                        T.StructField("kind", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField(
                            "frames",
                            T.ArrayType(T.StructType([T.StructField("source_index", T.IntegerType()), T.StructField("sha256", T.StringType())])),
                        ),
                    ]
                )
            ),
        ),
    ]
)


def read_frames(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,tif,tiff}") -> DataFrame:
    """List frame files with size and SHA-256; the bytes do not travel past the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return frame_records(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "content")


def frame_records(df: DataFrame, content: str) -> DataFrame:
    c = F.col(content)
    return df.withColumn("bytes", F.octet_length(c)).withColumn("sha256", F.sha2(c.cast("binary"), 256)).drop(content)


def explode_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """Decoded image struct (height, width, nChannels, data in BGR) to one row per pixel."""
    i = F.col("__i")
    at = lambda c: F.conv(F.hex(F.substring(F.col("image.data"), i * F.col("image.nChannels") + c + 1, F.lit(1))), 16, 10).cast("int")
    area = F.col("image.height") * F.col("image.width")
    return images.select(*keys, "image", F.explode(F.sequence(F.lit(0), area - 1)).alias("__i")).select(
        *keys,
        F.floor(i / F.col("image.width")).cast("int").alias("y"),
        (i % F.col("image.width")).alias("x"),
        at(2).alias("r"),
        at(1).alias("g"),
        at(0).alias("b"),
    )


def validate_sequence(frames: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Violation rows: bad or repeated indices, hash format or mismatch, unlisted or absent
    files, and an incomplete declared cycle."""
    m = manifest.select(key, "name", F.col("source_index"), F.lower("sha256").alias("declared"))
    f = frames.select(key, "name", F.col("sha256").alias("actual"))
    both = m.withColumn("__m", F.lit(True)).join(f.withColumn("__f", F.lit(True)), [key, "name"], "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("__f").isNull(), "listed_file_absent"),
            F.when(F.col("__m").isNull(), "file_not_listed"),
            F.when(F.col("__m") & (F.col("source_index").isNull() | (F.col("source_index") < 0)), "invalid_index"),
            F.when(F.col("declared").isNotNull() & ~F.col("declared").rlike("^[0-9a-f]{64}$"), "invalid_hash_format"),
            F.when(F.col("declared").rlike("^[0-9a-f]{64}$") & (F.col("declared") != F.col("actual")), "hash_mismatch"),
        )
    )
    rows = both.select(key, "name", F.explode(problems).alias("problem"))
    repeated = m.groupBy(key, "source_index").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(
        key, F.col("source_index").cast("string").alias("name"), F.lit("repeated_index").alias("problem")
    )
    # Complete means the indices are exactly 0 .. n-1: unique, starting at 0, ending at n-1.
    whole = m.groupBy(key, "source_index").agg(F.count(F.lit(1)).alias("__c")).groupBy(key).agg(
        F.count(F.lit(1)).alias("__d"), F.min("source_index").alias("__lo"), F.max("source_index").alias("__hi")
    )
    gaps = whole.where((F.col("__lo") != 0) | (F.col("__hi") != F.col("__d") - 1)).select(
        key, F.lit(None).cast("string").alias("name"), F.lit("incomplete_cycle").alias("problem")
    )
    return rows.unionByName(repeated).unionByName(gaps)


def natural_key(name: Column) -> Column:
    """Sort key: digit runs compare as numbers (padded), text case-folded and before digits' kind."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        parts,
        lambda s: F.struct(
            s.rlike(r"^\d").cast("int").alias("isnum"),
            F.when(s.rlike(r"^\d"), F.length(F.regexp_replace(s, "^0+", ""))).otherwise(0).alias("width"),
            F.when(s.rlike(r"^\d"), F.regexp_replace(s, "^0+", "")).otherwise(F.lower(s)).alias("text"),
        ),
    )


def natural_order(df: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """Add `place`, the 1-based rank of `key` among all rows (of `keys`), equal keys sharing the lowest.

    Ranks come from range pieces of the whole order, so neither the table nor a hot key is sorted in one task.
    """
    keys = keys or []
    ranked = ranked_values(value_table(df, keys, key), keys, key)
    return df.join(ranked.select(*keys, key, (F.col("below") + 1).alias("place")), [*keys, key])


def trailing_index(name: Column) -> Column:
    """Trailing integer of the file stem, or null."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def reading_order(files: DataFrame, order: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Explicit order over file order: (ordered rows, violation rows)."""
    listed = order.groupBy(key, "name").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("__n"))
    both = files.select(key, "name").withColumn("__f", F.lit(True)).join(listed, [key, "name"], "full")
    why = (
        F.when(F.col("__n") > 1, "repeated_in_order")
        .when(F.col("__f").isNull(), "ordered_file_missing")
        .when(F.col("__n").isNull(), "file_not_in_order")
    )
    marked = both.withColumn("problem", why)
    return (
        marked.where("problem is null").select(key, "name", "position"),
        marked.where("problem is not null").select(key, "name", "problem"),
    )


def progressive_slot(serial: Column, total: int) -> Column:
    """Final 1-based slot of a 1-based progressive serial: four quarter slots, then halvings.

    Serials 2^m + 1 .. 2^(m+1) fill the odd multiples of total / 2^(m+1); serials up to 4
    take the quarters in order. Pure arithmetic, so the whole mapping is a projection.
    """
    level = F.floor(F.log2((serial - 1).cast("double")))
    first = F.pow(F.lit(2.0), level)
    inner = (F.lit(float(total)) / (first * 2)) * (2 * (serial - 1 - first) + 1) + 1
    quarter = (F.lit(total) / 4) * (serial - 1) + 1
    return F.when(serial <= 4, quarter).otherwise(inner).cast("bigint")


def level_start(level: Column) -> Column:
    """Serials before a progressive level: levels hold 4, 4, 8, 16, .. frames."""
    return F.when(level == 1, F.lit(0)).otherwise(F.pow(F.lit(2.0), level)).cast("bigint")


def scramble_map(levels: DataFrame) -> DataFrame:
    """(serial, shuffled) from per-level permutations (level, i, value), each counted from 0."""
    return levels.select((level_start(F.col("level")) + F.col("i") + 1).alias("serial"), (level_start(F.col("level")) + F.col("value") + 1).alias("shuffled"))


def scramble_problems(levels: DataFrame, total: int) -> DataFrame:
    """(level, problem): levels of `total` frames that are absent, incomplete or no permutation, and ones too many."""
    wanted = [(1, 4)]
    while sum(n for _, n in wanted) < total:
        wanted.append((len(wanted) + 1, sum(n for _, n in wanted)))
    size = F.create_map(*[F.lit(x) for pair in wanted for x in pair])
    every = F.explode(F.array(*[F.lit(level) for level, _ in wanted]))
    seen = levels.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("i").alias("places")
    )
    both = levels.sparkSession.range(1).select(every.alias("level")).join(seen, "level", "full")
    whole = (F.col("n") == size[F.col("level")]) & (F.col("values") == F.col("n")) & (F.col("places") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    why = F.when(size[F.col("level")].isNull(), "unknown_level").when(F.col("n").isNull(), "missing_level").when(~whole, "not_a_permutation")
    return both.select("level", why.alias("problem")).where("problem is not null")


def reorder_by_permutation(df: DataFrame, keys: list[str], serial: str, total: int, scramble: DataFrame | None = None) -> DataFrame:
    """Stored serial to final position; `scramble` (serial, shuffled; see `scramble_map`) is applied first."""
    rows = df
    if scramble is not None:
        rows = df.join(scramble.select(F.col("serial").alias(serial), "shuffled"), serial).withColumn("__s", F.col("shuffled")).drop("shuffled")
    else:
        rows = df.withColumn("__s", F.col(serial))
    return rows.withColumn("final_position", progressive_slot(F.col("__s"), total) - 1).drop("__s")


def is_permutation(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Per key: whether positions are exactly 0 .. n-1."""
    once = df.groupBy(*keys, position).agg(F.count(F.lit(1)).alias("__c"))
    return once.groupBy(*keys).agg(
        ((F.max("__c") == 1) & (F.min(position) == 0) & (F.max(position) == F.count(F.lit(1)) - 1)).alias("bijective"),
        F.sum("__c").alias("rows"),
    )


def mark_duplicates(df: DataFrame, name: str, order: str, byte_hash: str, pixel_hash: str, keys: list[str] | None = None) -> DataFrame:
    """First frame with the same bytes, else with the same pixels.

    The first of each hash is a pre-aggregated minimum; only hashes seen more than once
    come back to the rows, so unique frames never meet a partner.
    """
    keys = keys or []
    first = lambda h, to: (
        df.groupBy(*keys, h)
        .agg(F.min(F.struct(order, name)).alias("__m"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(*keys, h, F.col(f"__m.{order}").alias(f"{to}_order"), F.col(f"__m.{name}").alias(f"{to}_name"))
    )
    rows = df.join(first(byte_hash, "__b"), keys + [byte_hash], "left").join(first(pixel_hash, "__p"), keys + [pixel_hash], "left")
    later = lambda s: F.col(f"{s}_order") < F.col(order)
    return rows.select(
        *df.columns,
        F.when(later("__b"), F.col("__b_name")).alias("duplicate_of"),
        F.when(~F.coalesce(later("__b"), F.lit(False)) & later("__p"), F.col("__p_name")).alias("pixel_duplicate_of"),
    )


def catalogue_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """Listing, evidence and frame tables of nested manifests."""
    listings = manifests.select("id", F.explode("listings").alias("l")).select("id", "l.*")
    evidence = manifests.select("id", F.posexplode("evidence").alias("ordinal", "e"))
    frames = evidence.select("id", "e.record_key", F.posexplode("e.frames").alias("position", "f"))
    return {
        "listings": listings,
        "evidence": evidence.select("id", "ordinal", "e.record_key", "e.kind", "e.status"),
        "frames": frames.select("id", "record_key", "position", "f.source_index", "f.sha256"),
    }


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Child tables of the manifests under a path: a document a file, or a document a line."""
    return catalogue_tables(spark.read.schema(MANIFEST).option("multiLine", str(not lines).lower()).json(path))


def parse_manifests(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.from_json(text, MANIFEST).alias("m")).select("m.*")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities never reach a file: they are written as null."""
    return df.select([finite(c).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def write_table(df: DataFrame, folder: str, kind: str = "csv") -> str:
    """Write to a fresh sub-folder (never over an existing one) and return its path."""
    path = f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    writer = without_nan(df).write.mode("error")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def sequence_warnings(frames: DataFrame, key: str, declared: str) -> DataFrame:
    """Invalid frames, mixed sizes and sparse selections in one aggregate per sequence."""
    out = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("status") != "valid").alias("invalid"),
        (F.min(F.struct("width", "height")) != F.max(F.struct("width", "height"))).alias("__mixed"),
        F.max(declared).alias("__d"),
    )
    texts = F.array_compact(
        F.array(
            F.when(F.col("invalid") > 0, "invalid_images_excluded"),
            F.when(F.col("__mixed"), "mixed_dimensions"),
            F.when(F.col("__d") != F.col("frames"), "sparse_selection"),
        )
    )
    return out.select(key, "frames", "invalid", F.array_join(texts, "|").alias("warnings"))
