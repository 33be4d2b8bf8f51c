"""Operator 1: licence scan by sparse TF-IDF cosine to templates, inherited along directories.

Built-in functions only. A page's mark-up is cut at tags and blank lines into segments; those with a cue word are
tokenised, without copyright lines, and compared with the licence templates (titles, SPDX ids, statements, notices and the leading
paragraphs of licence texts) by the cosine of their TF-IDF vectors over all words, with document frequencies over all pages: a word
that no template has lengthens the vector, so a restricting word keeps a statement away from the licence
without the restriction. A segment states the licence of the most similar template when the cosine reaches `least_cosine`.
Licence files (named so, or the front page of a directory) speak for
their directory; failing those, at least `agreeing` pages of a directory that all state the same licence
do. A page without its own statement takes the nearest ancestor directory's licence by joins of the distinct
directories' ancestor paths.

Only statements, word counts and directories are shuffled, not pages' texts; broadcasts are bounded by the
templates. Equal cosines go to the earlier template; several statements of a page to the best one, then the
first. Null or empty texts state nothing; a null address has no directory and inherits nothing; repeated rows get equal
rows and count each in the document frequencies. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.exchange import written

# Statements, titles, identifiers, notices and opening paragraphs that stand for a licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "GNU GPL, version 3 or later"),
    ("GPL-3.0-or-later", "GNU General Public License, version 3 or later"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "GNU GPL, version 2 or later"),
    ("GPL-2.0-or-later", "GNU General Public License, version 2 or later"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, all copyright is waived under CC0 1.0 public domain dedication"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
)
CUES = "licen[sc]e|copyright|spdx|permission (is hereby|to use)|redistribution and use|neither the name of|public domain|creative commons|rights reserved|free software|\\bgnu\\b|\\bcc[ -]by|\\bcc0"
COPYRIGHT_LINE = "copyright *(\\(c\\)|\u00a9|&copy;)? *[0-9][^.\n]*\\.?"
CUT = "\n[ \t\r]*\n+"
TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
FILE_NAME = "^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
FRONT_NAME = "^(index\\.[a-z]+)?$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _idf(df: Column, n: int) -> Column:
    return F.ln((F.lit(n) + 1.0) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def _template_weights(spark: SparkSession, df: DataFrame, n: int) -> DataFrame:
    """(token, template, unit weight), bounded by the templates."""
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEMPLATES)], "template int, text string")
    rows = texts.select("template", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("template", "token").agg(F.count(F.lit(1)).alias("tf"))
    known = df.join(F.broadcast(rows.select("token").distinct()), "token", "left_semi")
    weighed = rows.join(known, "token", "left").withColumn("w", (1 + F.ln("tf")) * _idf(F.col("df"), n))
    size = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighed.join(size, "template").select("template", "token", (F.col("w") / F.col("size")).alias("tw"))


def statements(pages: DataFrame, least_cosine: float) -> DataFrame:
    """(key, licence, cosine) of the pages (key, text) that state a licence; a row a key."""
    plain = F.regexp_replace("text", "<[^>]*>", "\n\n")
    cut = written(pages.select("key", F.filter(F.split(plain, CUT), lambda s: F.lower(s).rlike(CUES)).alias("segments"), F.array_distinct(_tokens(plain)).alias("held")))
    n = cut.count()
    df = written(cut.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    unit = _template_weights(pages.sparkSession, df, n)
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])

    stating = cut.where(F.size("segments") > 0).select("key", "segments").dropDuplicates(["key"])
    words = _tokens(F.regexp_replace(F.lower("segment"), COPYRIGHT_LINE, " "))
    tokens = stating.select("key", F.posexplode("segments").alias("place", "segment")).select("key", "place", F.explode(words).alias("token"))
    tf = tokens.groupBy("key", "place", "token").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(df, "token", "left").withColumn("w", (1 + F.ln("tf")) * _idf(F.col("df"), n))
    weighed = written(weighed.select("key", "place", "token", "w"))
    size = weighed.groupBy("key", "place").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dot = weighed.join(F.broadcast(unit), "token").groupBy("key", "place", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    met = dot.join(size, ["key", "place"]).withColumn("cosine", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("cosine") >= least_cosine)
    best = met.groupBy("key").agg(F.max(F.struct("cosine", (-F.col("template")).alias("t"), (-F.col("place")).alias("p"))).alias("best"))
    return best.select("key", F.element_at(names, 1 - F.col("best.t")).alias("licence"), F.col("best.cosine").alias("cosine"))


def _address(url: Column) -> Column:
    """Host and path of an address, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")


def licences(table: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html", least_cosine: float = 0.8, agreeing: int = 2) -> DataFrame:
    """page_id, licence, basis (own, inherited or none), cosine, directory per row of `table`."""
    address = _address(F.col(path_col).cast("string"))
    rows = table.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.xxhash64(F.col(path_col).cast("string"), F.col(text_col).cast("string")).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        F.when(address.contains("/"), F.regexp_extract(address, "^(.*/)", 1)).otherwise(F.concat(address, F.lit("/"))).alias("dir"),
        F.when(address.contains("/"), F.lower(F.regexp_extract(address, "([^/]*)$", 1))).otherwise("").alias("name"),
    )
    own = written(statements(rows.select("key", "text"), least_cosine))
    narrow = rows.select("page_id", "key", "dir", "name")
    stated = narrow.dropDuplicates(["key"]).join(own, "key").where("dir is not null")
    rank = F.when(F.col("name").rlike(FILE_NAME), 2).when(F.col("name").rlike(FRONT_NAME), 1).otherwise(0)
    speaks = stated.groupBy("dir").agg(
        F.max(F.struct(rank.alias("rank"), "cosine", "licence")).alias("best"), F.min("licence").alias("lo"), F.max("licence").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    speaks = speaks.where((F.col("best.rank") > 0) | ((F.col("lo") == F.col("hi")) & (F.col("n") >= agreeing))).select(
        F.col("dir").alias("above"), F.col("best.licence").alias("licence")
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    dirs = narrow.select("dir").where("dir is not null").distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = dirs.join(speaks, "above").groupBy("dir").agg(F.max(F.struct("depth", "licence", "above")).alias("near"))
    out = narrow.join(own, "key", "left").join(nearest, "dir", "left")
    return out.select(
        "page_id",
        F.coalesce("licence", "near.licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "cosine",
        F.when(F.col("licence").isNull(), F.col("near.above")).alias("directory"),
    )


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_licence_scan": op1_licence_scan}
_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
ORACLES = {
    "op1_licence_scan": f"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) AS v(template, name, text)),
a AS (SELECT row_number() OVER () AS r, page_id, regexp_replace(html, '<[^>]*>', chr(10) || chr(10), 'g') AS plain,
             regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS address FROM pages),
p AS (SELECT r, page_id, plain, CASE WHEN contains(address, '/') THEN regexp_extract(address, '^(.*/)', 1) ELSE address || '/' END AS dir,
             CASE WHEN contains(address, '/') THEN lower(regexp_extract(address, '([^/]*)$', 1)) ELSE '' END AS file FROM a),
tt AS (SELECT template, token, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM t) GROUP BY 1, 2),
held AS (SELECT token, count(*) AS df FROM (SELECT r, unnest(list_distinct(regexp_extract_all(lower(plain), '{TOKEN}'))) AS token FROM p) GROUP BY 1),
seg AS (SELECT r, generate_subscripts(s, 1) AS place, unnest(s) AS segment FROM (SELECT r, string_split_regex(plain, '{CUT}') AS s FROM p)),
tok AS (SELECT r, place, token, count(*) AS tf FROM (
          SELECT r, place, unnest(regexp_extract_all(regexp_replace(lower(segment), '{COPYRIGHT_LINE}', ' ', 'g'), '{TOKEN}')) AS token FROM seg WHERE regexp_matches(lower(segment), '{CUES}'))
        GROUP BY 1, 2, 3),
idf AS (SELECT token, ln(((SELECT count(*) FROM p) + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT token FROM tt UNION SELECT token FROM tok) LEFT JOIN held USING (token)),
tw AS (SELECT template, token, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY template)) AS tw FROM tt JOIN idf USING (token)),
w AS (SELECT r, place, token, (1 + ln(tf)) * idf AS w FROM tok JOIN idf USING (token)),
sz AS (SELECT r, place, sqrt(sum(w * w)) AS size FROM w GROUP BY 1, 2),
dot AS (SELECT r, place, template, sum(w * tw) AS dot FROM w JOIN tw USING (token) GROUP BY 1, 2, 3),
met AS (SELECT r, place, template, round(dot / size, 9) AS cosine FROM dot JOIN sz USING (r, place) WHERE round(dot / size, 9) >= 0.8),
own AS (SELECT r, name AS licence, cosine FROM met JOIN t USING (template) QUALIFY row_number() OVER (PARTITION BY r ORDER BY cosine DESC, template, place) = 1),
st AS (SELECT DISTINCT dir, file, plain, licence, cosine, CASE WHEN regexp_matches(file, '{FILE_NAME}') THEN 2 WHEN regexp_matches(file, '{FRONT_NAME}') THEN 1 ELSE 0 END AS rank
       FROM own JOIN p USING (r) WHERE dir IS NOT NULL),
sp AS (SELECT dir, arg_max(licence, (rank, cosine, licence)) AS licence FROM st GROUP BY dir HAVING max(rank) > 0 OR (min(licence) = max(licence) AND count(*) >= 2)),
up AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') || '/' AS above
       FROM (SELECT DISTINCT dir, unnest(range(1, len(string_split(dir, '/')))) AS depth FROM p WHERE dir IS NOT NULL)),
near AS (SELECT up.dir, arg_max(sp.licence, depth) AS near_licence, arg_max(above, depth) AS near_dir FROM up JOIN sp ON sp.dir = up.above GROUP BY 1)
SELECT page_id, coalesce(licence, near_licence) AS licence, CASE WHEN licence IS NOT NULL THEN 'own' WHEN near_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       cosine, CASE WHEN licence IS NULL THEN near_dir END AS directory
FROM p LEFT JOIN own USING (r) LEFT JOIN near ON near.dir = p.dir""",
}
