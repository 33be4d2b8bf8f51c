"""Catalogue jobs (family K)."""

from pyspark.sql import functions as F

from gyre.operators import catalogue as K
from gyre.operators import curation as C
from gyre.operators import rules as L
from gyre.plans.registry import query, r6

LABS = """CASE c_nationkey % 4 WHEN 0 THEN ' International  Gemological Institute' WHEN 1 THEN 'gia' WHEN 2 THEN 'L@B' ELSE 'igi' END"""


def parties(t):
    lab = (
        F.when(F.col("c_nationkey") % 4 == 0, " International  Gemological Institute")
        .when(F.col("c_nationkey") % 4 == 1, "gia")
        .when(F.col("c_nationkey") % 4 == 2, "L@B")
        .otherwise("igi")
    )
    return t.customer.select("c_custkey", lab.alias("lab"), F.translate("c_name", "#", "-").alias("report"))


@query(
    "k1_object_key",
    f"""WITH c AS (SELECT c_custkey, regexp_replace(trim(upper({LABS})), '\\s+', ' ', 'g') AS l,
                          regexp_replace(upper(replace(c_name, '#', '-')), '[\\s-]', '', 'g') AS r FROM customer),
    a AS (SELECT c_custkey, CASE l WHEN 'INTERNATIONAL GEMOLOGICAL INSTITUTE' THEN 'IGI' ELSE l END AS l, r FROM c),
    k AS (SELECT *, regexp_full_match(l, '[A-Z0-9]+') AND regexp_full_match(r, '[A-Z0-9]+') AND regexp_matches(r, '[0-9]') AS ok FROM a)
    SELECT c_custkey, CASE WHEN ok THEN l END AS lab, CASE WHEN ok THEN r END AS report, CASE WHEN ok THEN lower(l || '-' || r) END AS object_id FROM k""",
)
def object_key(t):
    lab, report, ident = K.object_key(F.col("lab"), F.col("report"))
    return parties(t).select("c_custkey", lab.alias("lab"), report.alias("report"), ident.alias("object_id"))


OBS = """
obs AS (
  SELECT p_partkey AS id, 'listing' AS side, 'shape' AS field, CASE p_size % 3 WHEN 0 THEN 'Round-Brilliant' WHEN 1 THEN 'oval' ELSE 'Asscher cut' END AS v FROM part
  UNION ALL SELECT p_partkey, 'evidence', 'shape', CASE p_size % 5 WHEN 0 THEN 'ROUND' WHEN 1 THEN 'OVAL BRILLIANT' ELSE 'ASSCHER' END FROM part WHERE p_size % 7 <> 0
  UNION ALL SELECT p_partkey, 'listing', 'origin', 'Lab-Grown' FROM part
  UNION ALL SELECT p_partkey, 'evidence', 'origin', CASE WHEN p_size % 2 = 0 THEN 'laboratory grown' ELSE 'mined' END FROM part
  UNION ALL SELECT p_partkey, 'listing', 'dimensions', '[' || p_size || '.50, 0' || p_size % 9 || '.0, ' || p_size // 10 || ']' FROM part
  UNION ALL SELECT p_partkey, 'evidence', 'dimensions', p_size || '.5 x ' || (p_size + p_partkey % 2) % 9 || ' x ' || p_size // 10 || '.00 mm' FROM part),
nrm AS (SELECT *, CASE WHEN field = 'dimensions' THEN (SELECT p_size || '.5 x ' || CASE WHEN side = 'listing' THEN p_size % 9 ELSE (p_size + p_partkey % 2) % 9 END || ' x ' || p_size // 10 FROM part WHERE p_partkey = id)
                    WHEN field = 'shape' THEN CASE upper(replace(v, '-', ' ')) WHEN 'ROUND BRILLIANT' THEN 'ROUND' WHEN 'ASSCHER CUT' THEN 'ASSCHER'
                    WHEN 'OVAL BRILLIANT' THEN 'OVAL' ELSE upper(replace(v, '-', ' ')) END
                    ELSE CASE WHEN upper(v) IN ('LAB-GROWN', 'LABORATORY GROWN') THEN 'LAB-GROWN' ELSE 'NATURAL' END END AS n FROM obs)"""


def identity_obs(t):
    size = F.col("p_size")
    listing = t.part.select(
        F.col("p_partkey").alias("id"), F.lit("listing").alias("side"), F.lit("shape").alias("field"),
        F.when(size % 3 == 0, "Round-Brilliant").when(size % 3 == 1, "oval").otherwise("Asscher cut").alias("v"),
    )
    evidence = t.part.where(size % 7 != 0).select(
        F.col("p_partkey").alias("id"), F.lit("evidence").alias("side"), F.lit("shape").alias("field"),
        F.when(size % 5 == 0, "ROUND").when(size % 5 == 1, "OVAL BRILLIANT").otherwise("ASSCHER").alias("v"),
    )
    origin = t.part.select(
        F.col("p_partkey").alias("id"),
        F.explode(
            F.array(
                F.struct(F.lit("listing").alias("side"), F.lit("Lab-Grown").alias("v")),
                F.struct(F.lit("evidence").alias("side"), F.when(size % 2 == 0, "laboratory grown").otherwise("mined").alias("v")),
            )
        ).alias("z"),
    ).select("id", "z.side", F.lit("origin").alias("field"), "z.v")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tenth = F.floor(size / 10)
    sizes = t.part.select(
        F.col("p_partkey").alias("id"),
        F.explode(
            F.array(
                F.struct(F.lit("listing").alias("side"), text("[", size, ".50, 0", size % 9, ".0, ", tenth, "]").alias("v")),
                F.struct(F.lit("evidence").alias("side"), text(size, ".5 x ", (size + F.col("p_partkey") % 2) % 9, " x ", tenth, ".00 mm").alias("v")),
            )
        ).alias("z"),
    ).select("id", "z.side", F.lit("dimensions").alias("field"), "z.v")
    return listing.unionByName(evidence).unionByName(origin).unionByName(sizes)


@query("k2_normalise_field", f"""WITH {OBS} SELECT id, side, field, v AS "value", n AS normalised FROM nrm""")
def normalise_field(t):
    return identity_obs(t).select("id", "side", "field", F.col("v").alias("value"), K.normalise_field(F.col("field"), F.col("v")).alias("normalised"))


@query(
    "k3_identity_compare",
    f"""WITH {OBS} SELECT id, field, count(*) AS observations, CASE WHEN count(DISTINCT n) > 1 THEN 'conflict'
        WHEN bool_or(side = 'listing') AND bool_or(side = 'evidence') THEN 'agreement' ELSE 'missing' END AS outcome FROM nrm GROUP BY 1, 2""",
)
def identity_compare(t):
    return K.identity_compare(identity_obs(t), ["id"], "field", "side", "v")


EVID = """
ev AS (SELECT l_orderkey AS id, CASE l_linenumber % 4 WHEN 0 THEN 'certificate' WHEN 1 THEN 'rotation' WHEN 2 THEN 'still' ELSE 'video' END AS kind,
              CASE WHEN l_returnflag = 'R' THEN 'download_failed' ELSE 'success' END AS status, l_partkey AS ordinal,
              CASE WHEN l_quantity > 5 THEN 'https://x/' || l_suppkey END AS url, CAST(l_quantity AS BIGINT) AS frames, l_linestatus = 'F' AS complete
       FROM lineitem)"""


def evidence(t):
    n = F.col("l_linenumber") % 4
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.when(n == 0, "certificate").when(n == 1, "rotation").when(n == 2, "still").otherwise("video").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "download_failed").otherwise("success").alias("status"),
        F.col("l_partkey").alias("ordinal"),
        F.when(F.col("l_quantity") > 5, F.concat(F.lit("https://x/"), F.col("l_suppkey"))).alias("asset_url"),
        F.col("l_quantity").cast("bigint").alias("frames"),
        (F.col("l_linestatus") == "F").alias("complete"),
    )


@query(
    "k4_completion",
    f"""WITH {EVID}, h AS (SELECT id, bool_or(kind = 'certificate' AND status = 'success') AS c, bool_or(kind IN ('rotation', 'video') AND status = 'success') AS m,
                                  bool_or(status = 'download_failed') AS f FROM ev GROUP BY 1),
    j AS (SELECT coalesce(h.id, o.o_orderkey) AS id, coalesce(c, false) AS c, coalesce(m, false) AS m, coalesce(f, false) AS f, coalesce(o.o_orderstatus = 'O', false) AS ro,
            coalesce(o.o_orderstatus IN ('O', 'F'), false) OR coalesce(o.o_orderpriority LIKE '5%', true) AS lo FROM h FULL JOIN orders o ON o.o_orderkey = h.id),
    r AS (SELECT id, list_filter([CASE WHEN NOT c THEN 'missing successful certificate evidence' END,
        CASE WHEN c AND NOT ro THEN 'certificate report number was not parsed and matched' END,
        CASE WHEN c AND NOT lo THEN 'certificate lab identity was not parsed and matched' END,
        CASE WHEN NOT m THEN 'missing successful motion evidence' END, CASE WHEN f THEN 'one or more requested evidence assets failed' END], lambda x: x IS NOT NULL) AS r FROM j)
    SELECT id, len(r) = 0 AS complete, array_to_string(r, '|') AS reasons FROM r""",
)
def completion(t):
    status = F.col("o_orderstatus")
    outcome = F.explode(
        F.array(
            F.struct(F.lit("report_number").alias("field"), F.when(status == "O", "agreement").otherwise("missing").alias("outcome")),
            F.struct(F.lit("lab").alias("field"), F.when(status.isin("O", "F"), "agreement").otherwise("conflict").alias("outcome")),
        )
    )
    outcomes = t.orders.select(F.col("o_orderkey").alias("id"), outcome.alias("z")).select("id", "z.field", "z.outcome", F.lit(True).alias("on_certificate"))
    ev = evidence(t)
    listings = t.orders.select(F.col("o_orderkey").alias("id"), F.when(~F.col("o_orderpriority").startswith("5"), F.lit("GIA")).alias("lab"))
    return K.completion(ev, ev.select("id", "status"), outcomes, listings, "id", ["download_failed"])


@query(
    "k5_upsert",
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS shape, p_brand AS colour FROM part WHERE p_partkey % 5 <> 0),
    n AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'OTHER' ELSE lower(p_type) END AS shape, p_brand AS colour FROM part WHERE p_partkey % 3 <> 0),
    j AS (SELECT coalesce(e.id, n.id) AS id, e.shape AS es, n.shape AS ns, e.colour AS ec, n.colour AS nc, e.id IS NULL AS fresh,
                 coalesce(upper(e.shape) <> upper(n.shape), false) AS bad FROM e FULL JOIN n ON e.id = n.id)
    SELECT id, CASE WHEN bad THEN es ELSE coalesce(es, ns) END AS shape, CASE WHEN bad THEN ec ELSE coalesce(ec, nc) END AS colour,
           CASE WHEN bad THEN 'kept' WHEN fresh THEN 'inserted' ELSE 'merged' END AS action, CASE WHEN bad THEN 'shape' ELSE '' END AS conflicts FROM j""",
)
def upsert(t):
    old = t.part.where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("shape"), F.col("p_brand").alias("colour")
    )
    new = t.part.where("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "OTHER").otherwise(F.lower("p_type")).alias("shape"), F.col("p_brand").alias("colour")
    )
    merged, rejected = K.upsert(old, new, "id", ["shape", "colour"])
    return merged.join(rejected, "id", "left").na.fill("", ["conflicts"])


@query(
    "k6_merge_map",
    f"""WITH m AS (SELECT p_partkey AS id, p_size AS s, p_retailprice AS r FROM part)
    SELECT id, 'depth=' || CASE WHEN s % 2 = 0 THEN '61.50' ELSE '61.5' END || '|polish=' || 'Good' || '|table=' || CAST(s AS VARCHAR) AS merged,
           CASE WHEN s % 4 = 3 THEN 'polish' ELSE '' END AS conflicts FROM m""",
)
def merge_map(t):
    s = F.col("p_size")
    old = F.create_map(F.lit("depth"), F.when(s % 2 == 0, "61.50").otherwise("61.5"), F.lit("polish"), F.lit("Good"))
    new = F.create_map(
        F.lit("depth"), F.lit("61.5"), F.lit("table"), s.cast("string"), F.lit("polish"), F.when(s % 4 == 3, "Fair").otherwise(" good")
    )
    merged, clash = K.merge_map(old, new)
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(entries, "|").alias("merged"), F.array_join(clash, "|").alias("conflicts"))


@query(
    "k7_unique_children",
    """SELECT l_orderkey, l_linenumber, count(*) > 1 AND (min(l_partkey) <> max(l_partkey) OR min(l_quantity) <> max(l_quantity)) AS conflict,
              count(*) AS copies FROM lineitem GROUP BY 1, 2""",
)
def unique_children(t):
    return K.unique_children(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"]).drop("l_partkey", "l_quantity")


@query(
    "k8_catalogue_index",
    f"""WITH {EVID}, l AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderpriority, o_totalprice)) AS k, max((o_orderdate, o_orderpriority, o_totalprice)) AS m FROM orders GROUP BY 1),
    r AS (SELECT o_custkey AS id, max((o_orderdate, o_orderpriority, o_orderstatus)) AS m FROM orders GROUP BY 1),
    d AS (SELECT id % 1000 AS id, bool_or(kind IN ('rotation', 'video') AND status = 'success' AND url IS NOT NULL) AS hm,
                 min(CASE WHEN status = 'success' AND url IS NOT NULL AND kind IN ('still', 'rotation') THEN (CASE kind WHEN 'still' THEN 0 ELSE 1 END, ordinal, url) END) AS t
          FROM ev GROUP BY 1)
    SELECT l.id, l.m[2] AS source_url, {r6("l.m[3]")} AS price, r.m[3] AS retrieval_status, coalesce(hm, false) AS has_motion, d.t[3] AS thumbnail_url
    FROM l JOIN r USING (id) LEFT JOIN d ON d.id = l.id""",
)
def catalogue_index(t):
    o = t.orders.withColumn("id", F.col("o_custkey"))
    listings = o.select("id", F.col("o_orderdate").alias("observed_at"), F.col("o_orderpriority").alias("url"), F.col("o_totalprice").alias("price"))
    retrievals = o.select("id", F.col("o_orderdate").alias("retrieved_at"), F.col("o_orderpriority").alias("listing_url"), F.col("o_orderstatus").alias("status"))
    ev = evidence(t).withColumn("id", F.pmod("id", F.lit(1000)))
    return K.catalogue_index(listings, retrievals, ev, "id")


@query(
    "k9_unique_ids",
    """SELECT c_mktsegment || '-' || c_nationkey AS id, count(*) AS copies FROM customer GROUP BY 1 HAVING count(*) > 1""",
)
def unique_ids(t):
    return K.duplicate_ids(t.customer.select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("id")), "id")


INDEX = """idx AS (SELECT p_partkey AS id, p_name AS report_number, p_brand AS retailer, p_type AS shape, p_retailprice AS price,
                   CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size END AS carat, CASE WHEN p_size % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency,
                   chr(CAST(65 + p_size % 26 AS INTEGER)) AS colour, CASE WHEN p_size % 3 = 0 THEN 'complete' ELSE 'partial' END AS retrieval_status FROM part)"""


@query(
    "k10_search_rows",
    f"""WITH {INDEX}, f AS (SELECT * FROM idx WHERE retrieval_status = 'complete'
          AND (contains(lower(report_number), 'red') OR contains(lower(retailer), 'red') OR contains(lower(shape), 'red')))
    SELECT id, report_number, retailer, currency, {r6("price")} AS price, colour, carat FROM f""",
)
def search_rows(t):
    size = F.col("p_size")
    index = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("report_number"), F.col("p_brand").alias("retailer"), F.col("p_type").alias("shape"),
        F.col("p_retailprice").alias("price"), F.when(size % 6 != 0, size).alias("carat"),
        F.when(size % 2 == 0, "GBP").otherwise("USD").alias("currency"), F.char(65 + size % 26).alias("colour"),
        F.when(size % 3 == 0, "complete").otherwise("partial").alias("retrieval_status"),
    )
    found = K.search_rows(index, "Red", ["report_number", "retailer", "shape"], "complete")
    return found.orderBy(*K.sort_keys("price")).select("id", "report_number", "retailer", "currency", "price", "colour", "carat")


@query(
    "k11_curation_view",
    """WITH f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN true END AS ps, CASE WHEN s_suppkey % 5 = 0 THEN true END AS pa,
                         CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 = 0 END AS ds, CASE WHEN s_suppkey % 10 = 0 THEN false END AS da FROM supplier)
    SELECT id, coalesce(ds, ps, false) AS starred, coalesce(da, pa, false) AS archived FROM f WHERE NOT coalesce(da, pa, false)""",
)
def curation_view(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.alias("id"))
    published = t.supplier.select(k.alias("id"), F.when(k % 4 == 0, True).alias("starred"), F.when(k % 5 == 0, True).alias("archived"))
    draft = t.supplier.select(k.alias("id"), F.when(k % 3 == 0, k % 2 == 0).alias("starred"), F.when(k % 10 == 0, False).alias("archived"))
    return K.curation_view(rows, published, draft)


def digest_sql(rows: str, depth: int) -> str:
    """SQL tables of the hash tree over `rows` (name: hash of the identity, h: hash of the content); the last is root (digest, n)."""
    out = f"t{depth} AS (SELECT substr(name, 1, {depth}) AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM {rows} GROUP BY 1)"
    for level in range(depth - 1, 0, -1):
        out += f", t{level} AS (SELECT substr(leaf, 1, {level}) AS leaf, sha256(string_agg(leaf || d, '' ORDER BY leaf)) AS d, sum(n) AS n FROM t{level + 1} GROUP BY 1)"
    return out + ", root AS (SELECT sha256(coalesce(string_agg(leaf || d, '' ORDER BY leaf), '')) AS digest, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM t1)"


REQUESTS = f"""s AS (SELECT s_suppkey AS id, 'starred' AS field FROM supplier WHERE s_suppkey % 2 = 0),
    hs AS (SELECT sha256('{{"id":' || id || '}}') AS name, sha256('{{"id":' || id || ',"field":"' || field || '"}}') AS h FROM s), {digest_sql("hs", 2)},
    c AS (SELECT s_suppkey // 4 AS request, s_suppkey AS id, 'starred' AS field, s_suppkey % 24 >= 12 AS a,
                 CASE WHEN s_suppkey % 40 = 5 THEN s_suppkey % 24 >= 12 ELSE s_suppkey % 24 < 12 END AS b,
                 CASE s_suppkey // 4 % 3 WHEN 0 THEN root.digest WHEN 1 THEN 'stale' END AS base FROM supplier, root WHERE s_suppkey % 4 < 3),
    k AS (SELECT c.*, s.id IS NOT NULL AS cur, c.id % 17 = 0 AS unknown FROM c LEFT JOIN s ON s.id = c.id),
    q AS (SELECT request, max(base) AS base, bool_or(a = b) AS invalid, bool_or(unknown) AS unknown, bool_or(cur <> b AND cur <> a) AS clash, bool_and(cur = a) AS done FROM k GROUP BY 1),
    w AS (SELECT request, base, CASE WHEN invalid THEN 'invalid' WHEN unknown THEN 'unknown_id' WHEN clash THEN 'conflict' WHEN done THEN 'no_change'
                                     WHEN base <> (SELECT digest FROM root) THEN 'stale_baseline' ELSE 'applied' END AS outcome FROM q),
    o AS (SELECT request, CASE WHEN outcome = 'applied' AND base IS NOT NULL AND request > (SELECT min(request) FROM w WHERE outcome = 'applied') THEN 'stale_baseline' ELSE outcome END AS outcome FROM w)"""


def requests(t):
    """(state, changes, known ids, digest): three flags a request, guarded by the right, a wrong or no digest."""
    k, suppliers = F.col("s_suppkey"), t.supplier
    state = suppliers.where(k % 2 == 0).select(k.alias("id"), F.lit("starred").alias("field"), F.lit(True).alias("value"))
    digest = C.state_digest(state, ["id"], ["id", "field"], 2)
    after = k % 24 >= 12
    request = F.floor(k / 4)
    changes = suppliers.where(k % 4 < 3).select(
        request.alias("request"), F.when(request % 3 == 0, digest.select("digest").scalar()).when(request % 3 == 1, "stale").alias("baseline"),
        k.alias("id"), F.lit("starred").alias("field"), F.when(k % 40 == 5, after).otherwise(~after).alias("before"), after.alias("after"),
    )
    return state, changes, suppliers.where(k % 17 != 0).select(k.alias("id")), digest


@query(
    "k12_apply_changes",
    f"""WITH {REQUESTS}, n AS (SELECT k.id, a FROM k JOIN o USING (request) WHERE outcome = 'applied')
    SELECT coalesce(s.id, n.id) AS id, 'starred' AS field, true AS "value" FROM s FULL JOIN n ON n.id = s.id WHERE coalesce(n.a, s.id IS NOT NULL)""",
)
def apply_changes(t):
    return C.apply_changes(*requests(t))


@query("k12_request_outcomes", f"WITH {REQUESTS} SELECT request, outcome FROM o")
def request_outcomes(t):
    return C.request_outcomes(*requests(t))


@query(
    "k13_state_digest",
    f"""WITH r AS (SELECT sha256('{{"c_custkey":' || c_custkey || '}}') AS name,
                          sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}') AS h FROM customer), {digest_sql("r", 4)}
    SELECT digest, n AS "rows" FROM root""",
)
def state_digest(t):
    return C.state_digest(t.customer, ["c_custkey"], ["c_custkey", "c_mktsegment"])


@query(
    "k14_comparison",
    """WITH l AS (SELECT p_brand AS attribute, p_size % 3 AS o, max(p_name) AS v FROM part GROUP BY 1, 2)
    SELECT attribute, coalesce(max(v) FILTER (o = 0), 'Unknown') AS object_0, coalesce(max(v) FILTER (o = 1), 'Unknown') AS object_1 FROM l WHERE o IN (0, 1) GROUP BY 1""",
)
def comparison(t):
    long = t.part.groupBy(F.col("p_brand").alias("attribute"), (F.col("p_size") % 3).alias("o")).agg(F.max("p_name").alias("v"))
    return K.comparison(long, [0, 1], "attribute", "o", "v")


@query(
    "k14_comparison_values",
    f"""WITH {EVID}, li AS (SELECT ps AS id, arg_max(CAST(o_totalprice AS DECIMAL(15, 2)), (o_orderdate, o_totalprice, cur, tax)) AS price, arg_max(cur, (o_orderdate, o_totalprice, cur, tax)) AS cur,
           arg_max(tax, (o_orderdate, o_totalprice, cur, tax)) AS tax, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS ret
         FROM (SELECT o_custkey AS ps, o_orderdate, o_totalprice, o_orderstatus, CASE o_orderkey % 5 WHEN 0 THEN 'gbp' WHEN 1 THEN 'USD' WHEN 2 THEN '' WHEN 3 THEN 'CHF' ELSE 'EUR' END AS cur,
                      substr(o_orderpriority, 1, 1) AS tax FROM orders) GROUP BY 1),
    mo AS (SELECT id, list(frames ORDER BY ordinal, frames) FILTER (kind = 'rotation' AND status = 'success' AND complete AND frames > 0 AND url IS NOT NULL) AS f,
                  bool_or(kind = 'video' AND status = 'success' AND url IS NOT NULL) AS v, bool_or(kind = 'rotation') AS r FROM ev GROUP BY 1),
    ob AS (SELECT c_custkey AS id, c_custkey % 7 AS k, c_mktsegment AS seg, li.*, mo.f, mo.v, mo.r FROM customer LEFT JOIN li ON li.id = c_custkey LEFT JOIN mo ON mo.id = c_custkey),
    vals AS (SELECT id, unnest([
      CASE WHEN k = 0 THEN 'Unknown' ELSE k || '.25 ct' END, CASE WHEN k = 1 THEN 'Unknown' ELSE seg END, 'VS1', 'Round', 'Unknown',
      CASE WHEN k < 2 THEN 'Unknown' WHEN k = 2 THEN '2 \u00d7 ? mm' ELSE k || ' \u00d7 ' || (k + 1) || ' mm' END, k || '%', 'Unknown', '1.0', 'EX', 'Unknown', 'NON',
      CASE WHEN price IS NULL THEN 'Price unavailable' WHEN upper(cur) = 'GBP' THEN '\u00a3' || format('{{:,.2f}}', CAST(price AS DOUBLE)) WHEN cur = 'EUR' THEN '\u20ac' || format('{{:,.2f}}', CAST(price AS DOUBLE))
           WHEN cur = 'USD' THEN 'US$' || format('{{:,.2f}}', CAST(price AS DOUBLE)) WHEN cur = '' THEN format('{{:.2f}}', CAST(price AS DOUBLE)) || ' (currency unknown)' ELSE format('{{:.2f}}', CAST(price AS DOUBLE)) || ' CHF' END,
      coalesce(tax, 'Unknown'), coalesce(ret, 'Unknown'),
      CASE WHEN len(f) > 0 THEN len(f) || CASE WHEN len(f) = 1 THEN ' validated sequence (' ELSE ' validated sequences (' END || array_to_string(f, ', ') || ' frames); ordinal, not angle-calibrated'
           WHEN v THEN 'Video available; no validated frame sequence' WHEN r THEN 'Rotation missing, failed or incomplete' ELSE 'No recovered rotation' END]) AS "value",
      unnest(range(16)) AS place FROM ob)
    SELECT vals.id, CAST(place AS INTEGER) AS place, attribute, label, "value" FROM vals JOIN (VALUES {", ".join(f"({i}, '{n}', '{x}')" for i, (n, x) in enumerate(K.COMPARED))}) n(p, attribute, label) ON p = place""",
)
def comparison_values(t):
    k = F.col("c_custkey") % 7
    number = lambda c: c.cast("string")
    objects = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(k > 0, F.concat(number(k), F.lit(".25"))).alias("carat"), F.when(k != 1, F.col("c_mktsegment")).alias("colour"), F.lit("VS1").alias("clarity"),
        F.lit("Round").alias("shape"), F.lit(" ").alias("origin"), F.when(k == 0, F.array(k)).when(k == 2, F.array(k, F.lit(None).cast("bigint"))).when(k > 2, F.array(k, k + 1)).alias("dimensions"),
        k.alias("depth"), F.lit(None).cast("string").alias("table"), F.lit("1.0").alias("ratio"), F.lit("EX").alias("polish"), F.lit("").alias("symmetry"), F.lit("NON").alias("fluorescence"),
    )
    code = F.col("o_orderkey") % 5
    listings = t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("observed_at"), F.col("o_totalprice").alias("price"),
        F.when(code == 0, "gbp").when(code == 1, "USD").when(code == 2, "").when(code == 3, "CHF").otherwise("EUR").alias("currency"), F.substring("o_orderpriority", 1, 1).alias("tax"),
    )
    retrievals = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("retrieved_at"), F.col("o_orderstatus").alias("retrieval"))
    return K.comparison_values(objects, listings, retrievals, evidence(t), "id")


@query(
    "k15_motion_class",
    f"""WITH {EVID}, v AS (SELECT *, kind = 'rotation' AND status = 'success' AND complete AND frames > 0 AS ok FROM ev)
    SELECT id, CASE WHEN bool_or(ok) THEN 'validated_sequence' WHEN bool_or(kind = 'video' AND status = 'success' AND url IS NOT NULL) THEN 'video'
                    WHEN bool_or(kind = 'rotation') THEN 'incomplete' ELSE 'none' END AS motion, CAST(coalesce(sum(frames) FILTER (ok), 0) AS BIGINT) AS valid_frames
    FROM v GROUP BY 1""",
)
def motion_class(t):
    return K.motion_class(evidence(t), "id")


ASSETS = """as1 AS (SELECT sha256(text) AS sha, lang AS media_type, n_chars AS bytes FROM documents),
plan AS (SELECT sha, min(media_type) AS media_type, max(bytes) AS byte_count, count(*) AS "references", min(media_type) <> max(media_type) AS conflict FROM as1 GROUP BY 1)"""


def planned(t):
    rows = t.documents.select(F.sha2("text", 256).alias("sha"), F.col("lang").alias("media"), "n_chars")
    return K.asset_plan(rows, "sha", "media", "n_chars")


@query("k16_asset_plan", f"""WITH {ASSETS} SELECT *, sha256('{{"sha":"' || sha || '","media_type":"' || media_type || '"}}') AS record_key FROM plan""")
def asset_plan(t):
    return planned(t).withColumn("record_key", K.record_key("sha", "media_type"))


@query(
    "k17_finalise",
    f"""WITH {ASSETS}, pub AS (SELECT DISTINCT ON (sha) sha256(text) AS sha, CASE WHEN n_chars % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS b,
                              CASE WHEN n_chars % 7 = 0 THEN 'http://x' ELSE 'https://x' END AS url FROM documents WHERE n_chars % 3 <> 0)
    SELECT p.*, CASE WHEN u.sha IS NULL THEN 'not_published' WHEN byte_count <> b THEN 'size_mismatch' ELSE 'no_https_locator' END AS problem
    FROM plan p LEFT JOIN pub u ON u.sha = p.sha WHERE u.sha IS NULL OR byte_count <> b OR url NOT LIKE 'https://%'""",
)
def finalise(t):
    n = F.col("n_chars")
    published = t.documents.where(n % 3 != 0).select(
        F.sha2("text", 256).alias("sha"), F.when(n % 5 == 0, n + 1).otherwise(n).alias("byte_count"),
        F.when(n % 7 == 0, "http://x").otherwise("https://x").alias("url"),
    ).dropDuplicates(["sha"])
    return K.finalise(planned(t), published, "sha")


@query(
    "k18_reference_index",
    """WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), c AS (SELECT 'ref-' || doc_id AS s FROM labels WHERE toxic = 1)
    SELECT d.doc_id AS id, 'ref-' || d.doc_id AS selection_id, substring(text, 1, 180) AS commentary_excerpt, e.doc_id IS NOT NULL AS has_motion,
           'ref-' || d.doc_id IN (SELECT s FROM c) AS collides FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""",
)
def reference_index(t):
    refs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("commentary"))
    ev = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "success").otherwise("missing").alias("status"), F.lit("rotation").alias("kind"))
    certified = t.labels.where("toxic = 1").select(F.concat(F.lit("ref-"), F.col("doc_id").cast("string")).alias("id"))
    return K.reference_index(refs, ev, certified)


# The rules that a document breaks whose id leaves this remainder by 40; 12 and 39 are sound.
PLANTED = (
    (0, "schema"), (1, "id"), (2, "file_id"), (3, "label"), (4, "identity_status"), (4, "certificate_missing"), (5, "identity_lab"), (6, "identity_report"),
    (7, "certificate_complete"), (8, "certificate_missing"), (9, "link_identity"), (9, "link_target"), (10, "link_missing"), (11, "link_target"),
    (13, "metadata_text"), (14, "carat"), (15, "dimensions"), (16, "source_links"), (17, "link_kind"), (18, "link_url"), (19, "link_url"),
    (20, "link_repeated"), (21, "link_note"), (22, "media_kind"), (23, "media_provider"), (24, "media_status"), (25, "topics_repeated"), (26, "topic"),
    (27, "evidence_kind"), (28, "evidence_key"), (29, "rotation_frames"), (30, "rotation_bundle"), (31, "rotation_assets"), (32, "stored_asset"),
    (33, "attempt_count"), (34, "attempt_reference"), (35, "attempt_kind"), (36, "attempt_status"), (38, "attempt_locator"),
)


def references(t):
    """A reference record for every document, sound but for the rule that its id plants, with its own text as commentary."""
    d = F.col("doc_id")
    at = lambda r: d % 40 == r
    choose = lambda usual, *special: F.coalesce(*[F.when(at(r), v) for r, v in special], usual)
    text = lambda v: F.lit(v).cast("string")
    asset = lambda size: F.struct(F.sha2(F.lit("x"), 256).alias("sha256"), F.lit(size).cast("long").alias("byte_count"), F.lit("https://media.example.org/a").alias("url"))
    no_asset = F.when(F.lit(False), asset(1))
    link = lambda kind, url, note=None: F.struct(text(kind).alias("kind"), text(url).alias("url"), text(note).alias("note"))
    media = lambda kind, provider, status: F.struct(text(kind).alias("kind"), text("https://view.example.org:443/v?id=1").alias("url"), text(provider).alias("provider"), text(status).alias("status"))
    frames = lambda n, size: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("source_index"), asset(size).alias("asset")))
    none = F.when(F.lit(False), frames(1, 1))
    record = lambda kind, key, its, its_frames: F.struct(text(kind).alias("kind"), text("success").alias("status"), key.alias("record_key"), its.alias("asset"), its_frames.alias("frames"))
    key = F.sha2(F.lit("record"), 256)
    attempt = lambda reference, kind, status, locator: F.struct(text(reference).alias("reference"), text(kind).alias("kind"), text(status).alias("status"), text(locator).alias("locator"))
    good, seen = link("page", "https://shop.example.org/x"), attempt("r1", "still", "missing", None)
    linked = (9, "linked"), (10, "linked"), (11, "linked"), (12, "linked")
    return t.documents.select(
        choose(F.lit("reference/1"), (0, F.lit("other"))).alias("schema"),
        choose(F.concat(F.lit("d-"), d), (1, F.concat(F.lit("D_"), d)), (37, F.concat(F.lit("d-"), d - 1))).alias("id"),
        F.when(at(2), "elsewhere").alias("file_id"),
        choose(F.concat(F.lit("Stone "), d), (3, F.lit("  "))).alias("label"),
        F.col("text").alias("commentary"),
        F.struct(
            choose(F.lit("unverified"), (4, F.lit("bogus")), *[(r, F.lit("reported")) for r in (6, 7, 8)], *[(r, F.lit(v)) for r, v in linked]).alias("status"),
            choose(text(None), (5, F.lit("L" * 101)), *[(r, F.lit("igi")) for r in (6, 9, 10, 11, 12)]).alias("lab"),
            choose(text(None), (6, F.lit("9" * 101)), (11, F.lit("777777")), *[(r, F.lit("123456")) for r in (7, 9, 10, 12)]).alias("report_number"),
        ).alias("identity"),
        choose(text(None), (9, F.lit("igi-999")), (11, F.lit("igi-777777")), (12, F.lit("igi-123456"))).alias("linked_id"),
        F.struct(
            choose(F.lit("Round"), (13, F.lit(""))).alias("shape"), text(None).alias("colour"), text("VS1").alias("clarity"), text(None).alias("origin"),
            choose(F.lit("1.25"), (14, F.lit("01.5"))).alias("carat"),
            choose(F.array(F.lit(6.1), F.lit(6.2)), (15, F.array(F.lit(5.0)))).alias("dimensions"),
        ).alias("metadata"),
        choose(
            F.array(good), (16, F.array().cast("array<struct<kind:string,url:string,note:string>>")), (17, F.array(link("", "https://shop.example.org/x"))),
            (18, F.array(link("page", "http://shop.example.org"))), (19, F.array(link("page", "https://10.0.0.1/x"))), (20, F.array(good, good)),
            (21, F.array(link("page", "https://shop.example.org/x", ""))),
        ).alias("source_links"),
        choose(
            F.array(media("viewer", "p", "linked_unverified")), (22, F.array(media("sound", "p", "linked_unverified"))),
            (23, F.array(media("still", None, "linked_unverified"))), (24, F.array(media("video", "p", "ok"))),
        ).alias("media_sources"),
        choose(F.array(F.lit("cut"), F.lit("light-return")), (25, F.array(F.lit("a"), F.lit("a"))), (26, F.array(F.lit("Bad Tag")))).alias("topics"),
        choose(
            F.array(record("still", key, asset(5), none)), (27, F.array(record("audio", key, asset(5), none))), (28, F.array(record("still", F.lit("xyz"), asset(5), none))),
            (29, F.array(record("rotation", key, no_asset, frames(255, 1)))), (30, F.array(record("rotation", key, asset(5), frames(256, 1)))),
            (31, F.array(record("rotation", key, no_asset, frames(256, 0)))), (32, F.array(record("still", key, no_asset, none))),
            (39, F.array(record("rotation", key, no_asset, frames(256, 1)))),
        ).alias("evidence"),
        choose(
            F.array(seen), (33, F.array_repeat(seen, 3001)), (34, F.array(attempt("", "still", "missing", None))), (35, F.array(attempt("r", "", "missing", None))),
            (36, F.array(attempt("r", "video", "x", None))), (38, F.array(attempt("r", "video", "missing", ""))),
        ).alias("attempts"),
    )


@query(
    "k19_validate_references",
    rf"""WITH p(r, rule) AS (VALUES {", ".join(f"({r}, '{rule}')" for r, rule in PLANTED)}),
    d AS (SELECT doc_id, text, CASE doc_id % 40 WHEN 1 THEN 'D_' || doc_id WHEN 37 THEN 'd-' || (doc_id - 1) ELSE 'd-' || doc_id END AS id FROM documents)
    SELECT id, rule FROM d JOIN p ON p.r = d.doc_id % 40
    UNION ALL SELECT id, 'id_repeated' FROM d GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT id, 'commentary' FROM d WHERE NOT coalesce(regexp_matches(text, '\S') AND length(text) <= 8000 AND NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F]'), false)""",
)
def validate_references(t):
    certified = t.region.where("r_regionkey = 0").select(F.lit("igi-123456").alias("id"), F.lit("IGI").alias("lab"), F.lit("123456").alias("report_number"))
    return L.broken_references(references(t), certified, "reference/1")


# Page text with the given row's numbers in certificate wording, so extraction has work to do.
CERT_TEXT = """ct AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'Report Number: LG' || (l_orderkey + 100000000) || chr(10) || 'Shape and Cutting Style' || chr(10)
   || CASE l_returnflag WHEN 'A' THEN 'ASSCHER CUT' WHEN 'N' THEN 'Style' ELSE 'Round  Brilliant' END || chr(10) || 'Measurements: ' || CAST(l_quantity AS INTEGER) || '.5 x '
   || CAST(l_linenumber AS INTEGER) || '.25 x 3.1' || chr(10) || 'CARAT WEIGHT ' || CAST(l_linenumber AS INTEGER) || '.02' || chr(10) || 'COLOR GRADE ' || l_linestatus || chr(10)
   || 'Clarity Grade VS' || (1 + l_partkey % 2) || chr(10) || CASE WHEN l_suppkey % 2 = 0 THEN 'Laboratory Grown' ELSE 'x' END || ' Table: '
   || CAST(l_quantity * 3 AS INTEGER) || '% Depth 61.5 % Ratio: ' || CAST(l_linenumber AS INTEGER) || '.01 Polish: very good Cut and set Symmetry EX Fluorescence: '
   || CASE l_returnflag WHEN 'A' THEN 'VS' WHEN 'N' THEN 'n/a' ELSE 'Very  Slight' END || ' Girdle: very thin to THICK Culet None' AS txt FROM lineitem)"""


def certificate_text(t):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber").cast("string")
    text = F.concat(
        F.lit("Report Number: LG"), (F.col("l_orderkey") + 100000000).cast("string"), F.lit("\nShape and Cutting Style\n"),
        F.when(F.col("l_returnflag") == "A", "ASSCHER CUT").when(F.col("l_returnflag") == "N", "Style").otherwise("Round  Brilliant"),
        F.lit("\nMeasurements: "), q, F.lit(".5 x "), n, F.lit(".25 x 3.1\nCARAT WEIGHT "), n, F.lit(".02\nCOLOR GRADE "), F.col("l_linestatus"),
        F.lit("\nClarity Grade VS"), (1 + F.col("l_partkey") % 2).cast("string"), F.lit("\n"),
        F.when(F.col("l_suppkey") % 2 == 0, "Laboratory Grown").otherwise("x"), F.lit(" Table: "),
        (F.col("l_quantity") * 3).cast("int").cast("string"), F.lit("% Depth 61.5 % Ratio: "), n,
        F.lit(".01 Polish: very good Cut and set Symmetry EX Fluorescence: "),
        F.when(F.col("l_returnflag") == "A", "VS").when(F.col("l_returnflag") == "N", "n/a").otherwise("Very  Slight"),
        F.lit(" Girdle: very thin to THICK Culet None"),
    )
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))


@query(
    "k20_extract_certificate_fields",
    f"""WITH {CERT_TEXT}, x AS (SELECT id, txt, regexp_replace(trim(upper(regexp_extract(txt, '(?i)Style\\n([^\\n]*)', 1))), '\\s+', ' ', 'g') AS sh FROM ct)
    SELECT id, upper(regexp_extract(txt, '(?i)REPORT\\s*NUMBER\\s*:?[ ]*([A-Z]{{0,3}}[0-9]{{6,}})', 1)) AS report_number, CAST(NULL AS VARCHAR) AS lab,
           CASE WHEN sh IN ('ASSCHER CUT', 'ROUND BRILLIANT') THEN sh END AS shape,
           {r6("regexp_extract(txt, '(?i)MEASUREMENTS: ([0-9.]+) x ([0-9.]+) x ([0-9.]+)', 1)")} AS length_mm,
           {r6("regexp_extract(txt, '(?i)MEASUREMENTS: ([0-9.]+) x ([0-9.]+) x ([0-9.]+)', 2)")} AS width_mm,
           {r6("regexp_extract(txt, '(?i)MEASUREMENTS: ([0-9.]+) x ([0-9.]+) x ([0-9.]+)', 3)")} AS depth_mm,
           {r6("regexp_extract(txt, '(?i)CARAT WEIGHT ([0-9.]+)', 1)")} AS carat, regexp_extract(txt, 'COLOR GRADE ([A-Z]+)', 1) AS colour,
           regexp_extract(txt, 'Clarity Grade (VS1|VS2)', 1) AS clarity, CASE WHEN contains(txt, 'Laboratory Grown') THEN 'lab-grown' END AS origin
    FROM x""",
)
def extract_certificate_fields(t):
    return K.extract_certificate_fields(certificate_text(t), "text")


@query(
    "k21_extract_proportions",
    f"""WITH {CERT_TEXT}, x AS (SELECT id, CAST(regexp_extract(txt, 'Table: ([0-9]+)%', 1) AS DOUBLE) AS t, CAST(regexp_extract(txt, 'Ratio: ([0-9.]+)', 1) AS DOUBLE) AS r, txt FROM ct)
    SELECT id, CASE WHEN t > 0 AND t <= 100 THEN {r6("t")} END AS table_percent, 61.5::DOUBLE AS depth_percent, CASE WHEN r <= 10 THEN {r6("r")} END AS length_width_ratio,
           CAST(NULL AS VARCHAR) AS cut, 'Very Good' AS polish, 'Excellent' AS symmetry,
           CASE WHEN contains(txt, ': VS Girdle') THEN 'Very Strong' WHEN contains(txt, 'Very  Slight') THEN 'Very Slight' END AS fluorescence, 'Very Thin to Thick' AS girdle, 'None' AS culet FROM x""",
)
def extract_proportions(t):
    return K.extract_proportions(certificate_text(t), "text")


@query(
    "k22_dedupe_attempts",
    """WITH s AS (SELECT user_id AS k, event_type AS src, min(event_id) AS o, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT k AS retrieval_key, min(o) AS kept, CAST(sum(n) - 1 AS BIGINT) AS duplicates, string_agg(src, '|' ORDER BY o) AS provenance FROM s GROUP BY 1""",
)
def dedupe_attempts(t):
    return K.dedupe_attempts(t.events.withColumnRenamed("user_id", "retrieval_key"), "retrieval_key", "event_id", "event_type")


@query(
    "k23_batch_targets",
    f"""WITH {EVID}, r AS (SELECT o_orderkey AS id, o_orderstatus = 'O' AND o_custkey % 3 <> 0 AS exact FROM orders),
    v AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_discount > 0.09), m AS (SELECT DISTINCT id FROM ev WHERE kind = 'rotation' AND status = 'success' AND frames >= 20)
    SELECT id FROM r WHERE (exact OR id IN (SELECT id FROM v)) AND id NOT IN (SELECT id FROM m)""",
)
def batch_targets(t):
    refs = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "reported").otherwise("unverified").alias("identity_status"),
        F.lit("IGI").alias("lab"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("report_number"),
    )
    media = t.lineitem.select(F.col("l_orderkey").alias("id"), F.lit("viewer").alias("kind"), (F.col("l_discount") > 0.09).alias("supported"))
    return K.batch_targets(refs, media, evidence(t), "id", 20).select("id")


@query(
    "k24_lesson_examples",
    """WITH x AS (SELECT conv_id, turn, conv_id * 7 + turn AS id FROM conversations), n AS (SELECT conv_id, count(*) AS n, count(DISTINCT id) AS d FROM x GROUP BY 1),
    ok AS (SELECT x.conv_id, bool_and(x.id IN (SELECT doc_id FROM documents)) AS a, string_agg(x.id, ',' ORDER BY turn) AS e FROM x GROUP BY 1)
    SELECT conv_id, e AS examples FROM ok JOIN n USING (conv_id) WHERE a AND n BETWEEN 2 AND 10 AND n = d""",
)
def lesson_examples(t):
    rows = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("id"))
    # Longer lessons are refused by the operator anyway: only short ones are ever listed.
    short = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 10")
    lessons = rows.join(short, "conv_id", "left_semi").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda s: s["id"]).alias("examples"))
    return K.lesson_examples(lessons, t.documents.select(F.col("doc_id").alias("id")), "conv_id")
