"""Licence scans: notices and licence files against templates, then inheritance from directories.

Compared are the whole text of a licence file, every block (lines without a blank one between) that has a trigger word, such as a
header, and the single lines that have one and all of them together.  Each is a sparse TF-IDF vector over the templates' terms, with document frequencies counted
over all texts of the table, and takes the licence of the template with the greatest cosine if that
reaches a threshold.  The whole text decides before blocks, and these before lines: a line of a licence that is like another
one's doesn't outweigh it.  A file without a licence inherits that of the nearest directory above it that has a licence file.

Weights are whole numbers (term count times thousandths of the inverse frequency), so that sums don't depend on
their order; only the cosine itself is a fraction.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.llm.common import cut

#: (licence, words that mark it): short notices, identifiers and characteristic terms; whole texts are added below.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; to deal in the Software without restriction; use, copy, modify, merge, publish, distribute, sublicense, sell"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License; www.apache.org licenses LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted; neither the name nor contributors may endorse or promote products"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3, GPLv3."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License version 2, GPLv2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, LGPL version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, AGPL version 3."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0. MPL was not distributed with this file, mozilla.org MPL 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Unlicense unlicense.org"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal, Creative Commons."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential, unauthorized copying prohibited."),
]

TRIGGER = "(?i)licen[cs]e|copyright|rights reserved|spdx|public domain|permission|redistribut"
#: Between blocks of lines.
BLANK_LINE = r"\n[ \t]*\n"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"
_SPLIT = "[^a-z0-9]+"


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


#: Whole licence texts, a file for each licence; only their tokens count, so that they stand in SQL without quotes.
#: The text of AGPL-3.0 is made from that of GPL-3.0 with its own section 13, as it was not at hand.
TEMPLATES += [(p.stem, " ".join(_tokens(p.read_text(encoding="utf-8")))) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]

VOCABULARY = sorted({t for _, text in TEMPLATES for t in _tokens(text)})


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _weights(docs: DataFrame) -> dict[str, int]:
    """Thousandths of 1 + ln((N + 1) / (df + 1)) of each template term, over all rows with a text."""
    known = F.array(*[F.lit(t) for t in VOCABULARY])
    texts = docs.select("text").filter("text is not null")
    rows = texts.select(F.explode(F.array_append(F.array_intersect(tokens(F.col("text")), known), F.lit(""))).alias("t"))
    counts = {r[0]: r[1] for r in rows.groupBy("t").count().collect()}  # one row for each template term, and "" for all
    n = counts.pop("", 0)
    return {t: 1000 + round(1000 * math.log((n + 1) / (counts.get(t, 0) + 1))) for t in VOCABULARY}


def scan(docs: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(path, licence, origin, directory, score) for every path.

    ``origin`` is own, inherited or none; ``directory`` is where an inherited licence's file lies ('' is the root);
    ``score`` is the cosine in millionths, of the directory's licence file if inherited.

    - A null text has no licence of its own but may inherit; an empty one likewise; a null path has one row and inherits nothing.
    - Rows that repeat a path are one file that has all their notices.
    - Of units of one kind the greatest cosine counts, ties go to the first licence by name; of several licence files in a directory the greatest cosine counts.
    - No rows in, no rows out.  Other columns are ignored, whatever their names.  Texts are scanned whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    weights = _weights(docs)
    name = F.element_at(F.split("path", "/"), -1)
    is_licence = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(TRIGGER))
    blocks = F.filter(F.split("text", BLANK_LINE), lambda x: x.rlike(TRIGGER))
    ranked = lambda rank, units: F.transform(units, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("unit")))
    together = F.concat("lines", F.array(F.array_join("lines", "\n")))
    own_text = F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = docs.filter("text is not null").select("path", "text", is_licence.alias("whole"), lines.alias("lines"), blocks.alias("blocks")).filter("whole or size(lines) > 0")
    units = units.select("path", F.explode(F.concat(ranked(0, own_text), ranked(1, F.col("blocks")), ranked(2, together))).alias("x")).select("path", "x.unit", "x.rank")
    units = units.groupBy("path", "unit").agg(F.min("rank").alias("rank")).select("path", F.xxhash64("unit").alias("u"), "rank", F.explode(tokens(F.col("unit"))).alias("t"))
    scale = spark.createDataFrame([(t, w) for t, w in weights.items()], "t string, w bigint")
    vectors = units.join(F.broadcast(scale), "t").groupBy("path", "u", "rank", "t", "w").count().select("path", "u", "rank", "t", (F.col("count") * F.col("w")).alias("x"))
    entries, norms = [], []
    for k, (_, text) in enumerate(TEMPLATES):
        terms = _tokens(text)
        entries += [(k, t, terms.count(t) * weights[t]) for t in sorted(set(terms))]
        norms.append((k, TEMPLATES[k][0], sum(v * v for i, _, v in entries if i == k)))
    # the templates are a constant of this module, some thousand rows
    terms = spark.createDataFrame(entries, "k int, t string, y bigint")
    norms = spark.createDataFrame(norms, "k int, licence string, ny bigint")
    length = vectors.groupBy("path", "u", "rank").agg(F.sum(F.col("x") * F.col("x")).alias("nx"))
    dots = vectors.join(F.broadcast(terms), "t").groupBy("path", "u", "k").agg(F.sum(F.col("x") * F.col("y")).alias("dot")).join(F.broadcast(norms), "k")
    cosine = F.col("dot").cast("double") / F.sqrt(F.col("nx").cast("double") * F.col("ny").cast("double"))
    scored = dots.join(length, (dots["path"].eqNullSafe(length["path"])) & (dots["u"] == length["u"])).select(dots["path"], "rank", "licence", cosine.alias("c")).filter(F.col("c") >= threshold)
    own = scored.groupBy("path").agg(F.min(F.struct("rank", (-F.col("c")).alias("c"), "licence")).alias("best"))
    own = cut(own.select("path", F.col("best.licence").alias("licence"), F.floor(-F.col("best.c") * 1_000_000).cast("bigint").alias("score")))

    parent = F.regexp_replace("path", r"/?[^/]*\z", "")
    homes = own.filter(is_licence).select(parent.alias("directory"), F.struct((-F.col("score")).alias("score"), "licence").alias("best")).groupBy("directory").agg(F.min("best").alias("best"))
    paths = docs.select("path").distinct()
    directories = paths.filter("path is not null").select(parent.alias("home")).distinct()
    depth = F.when(F.col("home") == "", 0).otherwise(F.size(F.split("home", "/")))
    above = directories.select("home", F.explode(F.sequence(F.lit(0), depth)).alias("n")).select("home", "n", F.expr("substring_index(home, '/', n)").alias("directory"))
    nearest = above.join(homes, "directory").groupBy("home").agg(F.max_by(F.struct("directory", "best"), "n").alias("near"))
    files = paths.withColumn("home", parent).join(own.withColumnRenamed("path", "own_path"), F.col("path").eqNullSafe(F.col("own_path")), "left")
    files = files.join(nearest, "home", "left")
    mine, theirs = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return files.select(
        "path",
        F.coalesce("licence", "near.best.licence").alias("licence"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near.directory")).alias("directory"),
        F.coalesce("score", -F.col("near.best.score")).alias("score"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(path, text): documents laid out as files under their sources; every 16th is a licence file, half of these one directory higher."""
    directory = F.concat(F.col("source"), F.lit("/d"), F.floor(F.col("doc_id") / 512))
    sub = F.concat(directory, F.lit("/s"), F.floor(F.col("doc_id") / 64) % 8)
    path = F.when(F.col("doc_id") % 32 == 0, F.concat(directory, F.lit("/LICENSE."), "doc_id")).when(F.col("doc_id") % 16 == 0, F.concat(sub, F.lit("/LICENSE."), "doc_id")).otherwise(F.concat(sub, F.lit("/doc_"), "doc_id", F.lit(".txt")))
    return docs.select(path.alias("path"), "text")


def sql(threshold: float = 0.5) -> str:
    values = ", ".join(f"({k}, '{licence}', '{text}')" for k, (licence, text) in enumerate(TEMPLATES))
    trigger, split, licence_file = TRIGGER.replace("(?i)", ""), _SPLIT, LICENCE_FILE.replace("(?i)", "")
    cut_ = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '{split}'), lambda t: t <> '')"
    return f"""
with f as (select case when doc_id % 32 = 0 then source || '/d' || (doc_id // 512) || '/LICENSE.' || doc_id
        when doc_id % 16 = 0 then source || '/d' || (doc_id // 512) || '/s' || ((doc_id // 64) % 8) || '/LICENSE.' || doc_id
        else source || '/d' || (doc_id // 512) || '/s' || ((doc_id // 64) % 8) || '/doc_' || doc_id || '.txt' end as path, text from documents),
m(k, licence, body) as (values {values}),
mt as (select k, licence, unnest({cut_("body")}) as t from m),
voc as (select distinct t from mt),
df as (select t, count(*) as n from (select distinct path, unnest({cut_("text")}) as t from f) where t in (select t from voc) group by t),
w as (select voc.t, 1000 + round(1000 * ln(((select count(*) from f where text is not null) + 1) / (coalesce(n, 0) + 1)))::bigint as w from voc left join df on voc.t = df.t),
tv as (select k, licence, mt.t, count(*) * any_value(w) as y from mt join w on mt.t = w.t group by k, licence, mt.t),
tn as (select k, licence, sum(y * y)::bigint as ny from tv group by k, licence),
l as (select path, text, regexp_matches(string_split(path, '/')[-1], '{licence_file}', 'i') as whole, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{trigger}', 'i')) as lines,
    list_filter(regexp_split_to_array(text, '{BLANK_LINE}'), lambda x: regexp_matches(x, '{trigger}', 'i')) as blocks from f),
k as (select path, unnest(case when whole then [text] else [] end) as unit, 0 as rank from l union all select path, unnest(blocks), 1 from l where len(lines) > 0
    union all select path, unnest(list_concat(lines, [array_to_string(lines, chr(10))])), 2 from l where whole or len(lines) > 0),
u as (select path, unit, min(rank) as rank from k group by path, unit),
uv as (select path, unit, x.t, count(*) * any_value(w) as x from (select path, unit, unnest({cut_("unit")}) as t from u) x join w on x.t = w.t group by path, unit, x.t),
un as (select path, unit, sum(x * x)::bigint as nx from uv group by path, unit),
d as (select path, unit, k, sum(x * y)::bigint as dot from uv join tv on uv.t = tv.t group by path, unit, k),
c as (select d.path, u.rank, tn.licence, dot::double / sqrt(nx::double * ny::double) as c from d join un on d.path = un.path and d.unit = un.unit join u on d.path = u.path and d.unit = u.unit join tn on d.k = tn.k),
o as (select path, min({{'r': rank, 'c': -c, 'l': licence}}) as b from c where c >= {threshold} group by path),
own as (select path, b.l as licence, floor(-b.c * 1000000)::bigint as score from o),
homes as (select regexp_replace(path, '/[^/]*$', '') as directory, min({{'s': -score, 'l': licence}}) as b from own where regexp_matches(string_split(path, '/')[-1], '{licence_file}', 'i') group by 1),
p as (select distinct path, regexp_replace(path, '/[^/]*$', '') as home from f),
near as (select p.home, max({{'n': length(directory), 'd': directory, 's': b.s, 'l': b.l}}) as x from (select distinct home from p) p join homes on p.home = directory or starts_with(p.home, directory || '/') group by p.home)
select p.path, coalesce(own.licence, x.l) as licence, case when own.licence is not null then 'own' when x is not null then 'inherited' else 'none' end as origin,
    case when own.licence is null then x.d end as directory, coalesce(own.score, -x.s) as score
from p left join own on p.path = own.path left join near on p.home = near.home
"""
