"""Sources, sinks and their checks (family A)."""

from pyspark.sql import functions as F

from gyre.plans.registry import query, r6
from gyre.session import scratch_dir
from gyre.sources import frames as A


@query("a1_frame_records", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, sha256(text) AS sha256 FROM documents")
def frame_records(t):
    return A.frame_records(t.documents.select("doc_id", "text"), "text")


@query(
    "a2_explode_pixels",
    """WITH b AS (SELECT vec_id, unnest(range(66)) AS i, embedding FROM embeddings),
    v AS (SELECT vec_id, i, CASE WHEN i < 64 THEN CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) ELSE 0 END AS v FROM b)
    SELECT vec_id, CAST(i // 3 // 11 AS INTEGER) AS y, CAST(i // 3 % 11 AS INTEGER) AS x, max(v) FILTER (i % 3 = 2) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 0) AS b
    FROM v GROUP BY vec_id, i // 3""",
)
def explode_pixels(t):
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255)))
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(level(v)), 2, "0")), ""))
    data = F.concat(data, F.unhex(F.lit("0000")))  # two blank bytes fill the last pixel
    image = F.struct(F.lit(2).alias("height"), F.lit(11).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return A.explode_pixels(t.embeddings.select("vec_id", image.alias("image")), ["vec_id"])


@query(
    "a3_validate_sequence",
    """WITH f AS (SELECT source AS seq, doc_id AS name, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 0),
    m AS (SELECT source AS seq, doc_id AS name, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id - doc_id % 2 END AS idx,
                 CASE WHEN doc_id % 17 = 0 THEN 'zz' WHEN doc_id % 19 = 0 THEN sha256('x') ELSE upper(sha256(text)) END AS decl FROM documents WHERE doc_id % 7 <> 0),
    j AS (SELECT coalesce(m.seq, f.seq) AS seq, coalesce(m.name, f.name) AS name, m.name IS NOT NULL AS hm, f.name IS NOT NULL AS hf, idx, lower(decl) AS decl, sha
          FROM m FULL JOIN f ON m.seq = f.seq AND m.name = f.name),
    p AS (SELECT seq, CAST(name AS VARCHAR) AS name, unnest(list_filter([CASE WHEN NOT hf THEN 'listed_file_absent' END, CASE WHEN NOT hm THEN 'file_not_listed' END,
           CASE WHEN hm AND idx < 0 THEN 'invalid_index' END, CASE WHEN NOT regexp_full_match(decl, '[0-9a-f]{64}') THEN 'invalid_hash_format' END,
           CASE WHEN regexp_full_match(decl, '[0-9a-f]{64}') AND decl <> sha THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS problem FROM j),
    c AS (SELECT seq, idx, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT * FROM p UNION ALL SELECT seq, CAST(idx AS VARCHAR), 'repeated_index' FROM c WHERE n > 1
    UNION ALL SELECT seq, NULL, 'incomplete_cycle' FROM c GROUP BY 1 HAVING min(idx) <> 0 OR max(idx) <> count(*) - 1""",
)
def validate_sequence(t):
    d = F.col("doc_id")
    docs = t.documents.withColumn("seq", F.col("source")).withColumn("name", d.cast("string")).withColumn("sha256", F.sha2("text", 256))
    files = docs.where(d % 11 != 0).select("seq", "name", "sha256")
    manifest = docs.where(d % 7 != 0).select(
        "seq", "name", F.when(d % 13 == 0, -1).otherwise(d - d % 2).alias("source_index"),
        F.when(d % 17 == 0, "zz").when(d % 19 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper("sha256")).alias("sha256"),
    )
    return A.validate_sequence(files, manifest, "seq")


@query(
    "a4_natural_order",
    """WITH p AS (SELECT page_id, url, regexp_extract_all(url, '([0-9]+|[^0-9]+)', 1) AS parts FROM pages),
    k AS (SELECT page_id, list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '^[0-9]')
             THEN (1, CAST(length(regexp_replace(s, '^0+', '')) AS INTEGER), regexp_replace(s, '^0+', '')) ELSE (0, 0, lower(s)) END) AS k FROM p)
    SELECT page_id, CAST(rank() OVER (ORDER BY k) AS BIGINT) AS place FROM k""",
)
def natural_order(t):
    """Place of every page in the natural order of all of them."""
    keyed = t.pages.select("page_id", A.natural_key(F.col("url")).alias("key"))
    return A.natural_order(keyed, "key").select("page_id", "place")


@query(
    "a5_trailing_index",
    r"""SELECT page_id, CAST(nullif(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '([0-9]+)$', 1), '') AS BIGINT) AS source_index FROM pages""",
)
def trailing_index(t):
    return t.pages.select("page_id", A.trailing_index(F.col("url")).alias("source_index"))


@query(
    "a6_reading_order",
    """WITH o AS (SELECT doc_id AS name, source AS seq, n_chars AS position FROM documents WHERE doc_id % 4 <> 0
                  UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE doc_id % 9 = 1),
    l AS (SELECT seq, name, min(position) AS position, count(*) AS n FROM o GROUP BY 1, 2), f AS (SELECT source AS seq, doc_id AS name FROM documents WHERE doc_id % 5 <> 0),
    j AS (SELECT coalesce(f.seq, l.seq) AS seq, coalesce(f.name, l.name) AS name, position,
                 CASE WHEN n > 1 THEN 'repeated_in_order' WHEN f.name IS NULL THEN 'ordered_file_missing' WHEN n IS NULL THEN 'file_not_in_order' END AS problem
          FROM f FULL JOIN l ON f.seq = l.seq AND f.name = l.name)
    SELECT seq, name, CASE WHEN problem IS NULL THEN position END AS position, problem FROM j""",
)
def reading_order(t):
    d = F.col("doc_id")
    base = t.documents.select(F.col("source").alias("seq"), d.alias("name"), F.col("n_chars").alias("position"))
    order = base.where("name % 4 <> 0").unionByName(base.where("name % 9 = 1").withColumn("position", F.col("position") + 1))
    good, bad = A.reading_order(base.where("name % 5 <> 0").select("seq", "name"), order, "seq")
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "a7_reorder_by_permutation",
    """WITH RECURSIVE lv(m, serial, slot) AS (
      SELECT * FROM (VALUES (2, 1, 1), (2, 2, 5), (2, 3, 9), (2, 4, 13)) AS v(m, serial, slot)),
    p AS (SELECT serial, slot FROM lv UNION ALL SELECT 5 + j, 2 * (2 * j + 1) + 1 FROM range(4) AS r(j)
          UNION ALL SELECT 9 + j, 1 * (2 * j + 1) + 1 FROM range(8) AS r(j))
    SELECT vec_id // 16 AS series_id, vec_id % 16 + 1 AS serial, CAST(slot - 1 AS BIGINT) AS final_position FROM embeddings JOIN p ON p.serial = vec_id % 16 + 1""",
)
def reorder_by_permutation(t):
    rows = t.vectors.select("series_id", (F.col("position") + 1).alias("serial"))
    return A.reorder_by_permutation(rows, ["series_id"], "serial", 16)


# Per-level permutations of three levels (4, 4 and 8 frames) from the keys of `nation`.
LEVELS = """lv AS (SELECT CASE WHEN n_nationkey < 4 THEN 1 WHEN n_nationkey < 8 THEN 2 ELSE 3 END AS level, CASE WHEN n_nationkey < 8 THEN n_nationkey % 4 ELSE n_nationkey - 8 END AS i FROM nation WHERE n_nationkey < 16),
sm AS (SELECT *, (i * 3 + 1) % CASE WHEN level < 3 THEN 4 ELSE 8 END AS "value", CASE level WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 8 END AS first FROM lv)"""


def scrambles(t):
    k = F.col("n_nationkey")
    level = F.when(k < 4, 1).when(k < 8, 2).otherwise(3)
    i = F.when(k < 8, k % 4).otherwise(k - 8)
    return t.nation.where(k < 16).select(level.alias("level"), i.alias("i"), ((i * 3 + 1) % F.when(k < 8, 4).otherwise(8)).alias("value"))


@query(
    "a7_scrambled_order",
    f"""WITH {LEVELS}, p(serial, slot) AS (
      SELECT * FROM (VALUES (1, 1), (2, 5), (3, 9), (4, 13)) AS v(serial, slot) UNION ALL SELECT 5 + j, 2 * (2 * j + 1) + 1 FROM range(4) AS r(j)
      UNION ALL SELECT 9 + j, 1 * (2 * j + 1) + 1 FROM range(8) AS r(j)),
    m AS (SELECT first + i + 1 AS serial, first + "value" + 1 AS shuffled FROM sm)
    SELECT vec_id // 16 AS series_id, vec_id % 16 + 1 AS serial, CAST(slot - 1 AS BIGINT) AS final_position
    FROM embeddings JOIN m ON m.serial = vec_id % 16 + 1 JOIN p ON p.serial = m.shuffled""",
)
def scrambled_order(t):
    rows = t.vectors.select("series_id", (F.col("position") + 1).alias("serial"))
    return A.reorder_by_permutation(rows, ["series_id"], "serial", 16, A.scramble_map(scrambles(t)))


@query(
    "a8_mark_duplicates",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, sha256(lower(text)) AS p FROM documents),
    f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS fh, min(doc_id) OVER (PARTITION BY p) AS fp FROM d)
    SELECT doc_id, CASE WHEN fh < doc_id THEN fh END AS duplicate_of, CASE WHEN NOT fh < doc_id AND fp < doc_id THEN fp END AS pixel_duplicate_of FROM f""",
)
def mark_duplicates(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.lower("text"), 256).alias("p"))
    return A.mark_duplicates(rows.withColumn("name", F.col("doc_id")), "name", "doc_id", "h", "p").select("doc_id", "duplicate_of", "pixel_duplicate_of")


@query(
    "a9_read_catalogue",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS listings, count(*) FILTER (o_orderstatus = 'F') AS evidence, count(*) FILTER (o_orderstatus = 'F') * 2 AS frames
       FROM orders GROUP BY 1""",
)
def read_catalogue(t):
    frame = lambda i: F.struct(F.lit(i).alias("source_index"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    listing = F.struct(
        F.col("o_orderdate").alias("observed_at"), F.concat(F.lit("https://x/"), F.col("o_orderkey")).alias("url"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.lit("GBP").alias("currency"),
    )
    item = F.when(
        F.col("o_orderstatus") == "F",
        F.struct(F.col("o_orderkey").cast("string").alias("record_key"), F.lit("rotation").alias("kind"), F.lit("success").alias("status"), F.array(frame(0), frame(1)).alias("frames")),
    )
    # One manifest document per retrieval, so no document grows with its object's history.
    docs = t.orders.select(
        F.col("o_custkey").cast("string").alias("id"), F.array(listing).alias("listings"), F.array_compact(F.array(item)).alias("evidence")
    )
    tables = A.catalogue_tables(A.parse_manifests(docs.select(F.to_json(F.struct("id", "listings", "evidence")).alias("text")), "text"))
    count = lambda name: tables[name].groupBy("id").agg(F.count(F.lit(1)).alias(name))
    return count("listings").join(count("evidence"), "id", "left").join(count("frames"), "id", "left").na.fill(0)


@query(
    "a9_read_files",
    """SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS listings, sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS total, count(*) FILTER (o_orderstatus = 'F') AS evidence,
              count(*) FILTER (o_orderstatus = 'F') * 2 AS frames FROM orders GROUP BY 1""",
)
def read_files(t):
    """Manifests of many listings, one for every object and month, written as files and read again."""
    frame = lambda i: F.struct(F.lit(i).alias("source_index"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    listing = F.struct(
        F.col("o_orderdate").alias("observed_at"), F.concat(F.lit("https://x/"), F.col("o_orderkey")).alias("url"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.lit("GBP").alias("currency"),
    )
    item = F.struct(F.col("o_orderkey").cast("string").alias("record_key"), F.lit("rotation").alias("kind"), F.lit("success").alias("status"), F.array(frame(0), frame(1)).alias("frames"))
    docs = t.orders.groupBy(F.col("o_custkey").cast("string").alias("id"), F.trunc("o_orderdate", "month").alias("month")).agg(
        F.collect_list(listing).alias("listings"), F.collect_list(F.when(F.col("o_orderstatus") == "F", item)).alias("evidence")
    )
    path = A.write_table(docs.drop("month"), scratch_dir(t.spark), "json")
    tables = A.read_catalogue(t.spark, path, lines=True)
    count = lambda name: tables[name].groupBy("id").agg(F.count(F.lit(1)).alias(name))
    sums = tables["listings"].groupBy("id").agg(F.count(F.lit(1)).alias("listings"), F.sum("price").cast("decimal(38,2)").alias("total"))
    return sums.join(count("evidence"), "id", "left").join(count("frames"), "id", "left").na.fill(0, ["evidence", "frames"])


@query(
    "a10_write_trace",
    f"""SELECT user_id AS series_id, count(*) AS "rows", count(CASE WHEN value < 400 THEN value END) AS finite_rows, {r6("sum(CASE WHEN value < 400 THEN value END)")} AS total FROM events GROUP BY 1""",
)
def write_trace(t):
    rows = t.events.select(
        F.col("user_id").alias("series_id"), "event_id", F.when(F.col("value") < 400, F.col("value")).otherwise(F.lit(float("nan"))).alias("value")
    )
    path = A.write_table(rows, scratch_dir(t.spark), "csv")
    back = t.spark.read.schema("series_id bigint, event_id bigint, value double").option("header", "true").csv(path)
    return back.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("finite_rows"), F.sum("value").alias("total"))


@query(
    "a11_sequence_warnings",
    """WITH f AS (SELECT l_orderkey AS seq, l_returnflag = 'R' AS bad, l_linenumber AS w, CAST(l_quantity AS BIGINT) AS h FROM lineitem),
    a AS (SELECT seq, count(*) AS n, count(*) FILTER (bad) AS i, min((w, h)) <> max((w, h)) AS mx FROM f GROUP BY 1)
    SELECT seq, n AS frames, i AS invalid, array_to_string(list_filter([CASE WHEN i > 0 THEN 'invalid_images_excluded' END, CASE WHEN mx THEN 'mixed_dimensions' END,
           CASE WHEN n <> 4 THEN 'sparse_selection' END], lambda x: x IS NOT NULL), '|') AS warnings FROM a""",
)
def sequence_warnings(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "invalid").otherwise("valid").alias("status"),
        F.col("l_linenumber").alias("width"), F.col("l_quantity").cast("bigint").alias("height"), F.lit(4).alias("declared"),
    )
    return A.sequence_warnings(rows, "seq", "declared")
