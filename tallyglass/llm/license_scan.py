"""License scans: MinHash bands over overlapping text windows retrieve license templates.

Words are lower-cased runs of letters, marks and digits; a shingle is five words (a template of
fewer words is one shingle of all its words). A template is found in a window that holds 80 of
100 or more of its distinct shingles.

Templates fall into size classes. The windows of a class hold twice as many shingles as its
largest template and step by half of that, so a passage as long as a template lies whole in one
window. Templates of up to four shingles must be there whole at that similarity, so for them
every single shingle is a window: the first shingle retrieves the template for certain.

The signature is one-permutation MinHash: a shingle's hash names one of BINS bins, and each bin
keeps its smallest hash; a bin is a band of one row. A template's shingle that a window holds is
the minimum of its bin on both sides with a probability of 0.4 or more (0.88 in the smallest
class), and 80 of 100 shingles have to fail at once for a miss: 1.3e-5 at worst, for 4 of 5
shingles; below 1e-9 from 17 shingles on. Retrieved templates are confirmed by exact containment
of the shingles (strings) in the windows of the document.

A window whose band collides holds the template's minimum of that bin. So the minima are looked up
among all shingles first, which loses nothing, and signatures are made of the windows around the
hits only. Only built-in functions run.

Defined results: null and empty texts hold nothing; a template found in several windows of a
document is reported once, at the first window of highest overlap; repeated rows of a doc_id
count once; rows with a null id are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import table, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
BINS = 256
#: Largest number of shingles of the size classes that the built-in templates fall into.
CLASSES = (4, 16, 64, 256)
#: Classes go on by powers of four for given templates; no license text comes near to the last.
MOST_SHINGLES = 4**7
#: Templates are broadcast: more than so many are refused.
MOST_TEMPLATES = 5000

#: Notices that public licenses ask to be placed in a work.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-short": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _hash_at(words: str, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col(words), i + k) for k in range(n)])


def _hashes(words: str, n: int) -> Column:
    """Hashes of the n-word shingles in order; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: _hash_at(words, i, n))).otherwise(F.array().cast("array<bigint>"))


def _strings(words: Column, n: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def template_index(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """_template, _len, _strings, _class (upper size of the class), _minima."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates are over {MOST_TEMPLATES}")
    own = spark.createDataFrame(sorted(templates.items()), "_template string, _text string")
    own = own.select("_template", words_of(F.col("_text")).alias("_words")).where(F.size("_words") > 0)
    own = own.withColumn("_len", F.least(F.size("_words"), F.lit(SHINGLE)))
    own = own.withColumn("_strings", _strings(F.col("_words"), F.col("_len")))
    hashed = reduce(lambda out, n: F.when(F.col("_len") == n, _hashes("_words", n)).otherwise(out), range(1, SHINGLE + 1), F.lit(None).cast("array<bigint>"))
    own = own.withColumn("_hashes", F.sort_array(F.array_distinct(hashed)))
    size = F.size("_strings")
    classes = [4**k for k in range(1, 10) if 4**k <= MOST_SHINGLES]
    upper = reduce(lambda out, c: F.when(size <= c, c).otherwise(out), reversed(classes), F.lit(None).cast("int"))
    own = own.withColumn("_class", upper)
    one = F.slice("_hashes", 1, 1)
    return own.withColumn("_minima", F.when(F.col("_class") == CLASSES[0], one).otherwise(_bin_minima("_hashes"))).drop("_words", "_hashes")


def _bin_minima(ordered: str) -> Column:
    """Of a sorted array of hashes the first of each bin (the high bits)."""
    shift = 64 - (BINS - 1).bit_length()
    return F.expr(f"filter({ordered}, (h, i) -> i = 0 or shiftright(h, {shift}) <> shiftright(get({ordered}, i - 1), {shift}))")


def found_templates(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _template, first_word (of the best window), n_shared, n_template."""
    spark = docs.sparkSession
    index = written(template_index(spark, TEMPLATES if templates is None else templates), "templates")
    shapes = [tuple(r) for r in index.select("_class", "_len").distinct().orderBy("_class", "_len").collect()]  # at most 7 + 4
    if any(c is None for c, _ in shapes):
        raise ValueError(f"a template has more than {MOST_SHINGLES} shingles")
    source = docs.select(F.col(f"`{doc_id}`").alias("_doc"), words_of(F.col(f"`{text}`")).alias("_words")).where("_doc is not null")
    keys = F.broadcast(written(index.select("_template", "_class", "_len", F.explode("_minima").alias("_h")), "minima"))

    # a window can only collide with a template whose minimum it holds: find such shingles first
    hits = []
    for n in sorted({n for _, n in shapes}):
        single = source.where(F.size("_words") >= n).select("_doc", "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - n)).alias("_i"))
        own = F.broadcast(keys.where(F.col("_len") == n).select("_h", "_class").distinct())
        hits.append(single.select("_doc", "_i", _hash_at("_words", F.col("_i"), n).alias("_h")).join(own, "_h"))
    if not hits:
        hits = [source.select("_doc", F.lit(0).alias("_i"), F.lit(0).cast("long").alias("_h"), F.lit(0).alias("_class")).where(F.lit(False))]
    hits = written(reduce(DataFrame.unionByName, hits), "hits")
    parts = [hits.where(F.col("_class") == CLASSES[0]).join(keys, ["_h", "_class"]).select("_doc", "_template")]
    # then the signature of the windows around them, and its bands
    at = F.floor(F.col("_i") / F.col("_class")).cast("int")
    near = hits.where(F.col("_class") != CLASSES[0]).select("_doc", "_class", F.explode(F.array(at, at - 1)).alias("_j")).where("_j >= 0").distinct()
    held = near.groupBy("_doc").agg(F.collect_list(F.struct("_class", "_j")).alias("_windows"))
    held = held.join(source, "_doc").select("_doc", _hashes("_words", SHINGLE).alias("_hashes"), "_windows")
    held = held.select("_doc", "_hashes", F.explode("_windows").alias("_w")).select("_doc", F.col("_w._class").alias("_class"), F.sort_array(F.slice("_hashes", F.col("_w._j") * F.col("_w._class") + 1, 2 * F.col("_w._class"))).alias("_window"))
    bands = held.select("_doc", "_class", F.explode(_bin_minima("_window")).alias("_h"))
    parts.append(bands.join(keys, ["_h", "_class"]).select("_doc", "_template"))
    candidates = written(reduce(DataFrame.unionByName, parts).distinct(), "candidates")

    # exact: the windows of the document once more, as strings
    wanted = candidates.select("_doc").distinct()
    pairs = candidates.join(source.join(wanted, "_doc", "left_semi"), "_doc").join(F.broadcast(index.select("_template", "_class", "_len", "_strings")), "_template")
    pairs = pairs.withColumn("_starts", F.sequence(F.lit(0), F.greatest(F.floor((F.size("_words") - F.col("_len")) / F.col("_class")).cast("int"), F.lit(0))))
    shared = lambda j: F.size(F.array_intersect("_strings", _strings(F.slice(F.col("_words"), j * F.col("_class") + 1, 2 * F.col("_class") + F.col("_len") - 1), F.col("_len"))))
    best = F.array_max(F.transform("_starts", lambda j: F.struct(shared(j).alias("n"), (-j).alias("j"))))
    out = pairs.select("_doc", "_template", best.alias("_best"), F.size("_strings").cast("long").alias("n_template"), "_class")
    out = out.select("_doc", "_template", (-F.col("_best.j") * F.col("_class")).cast("long").alias("first_word"), F.col("_best.n").cast("long").alias("n_shared"), "n_template")
    out = out.where(F.col("n_shared") * DENOMINATOR >= F.col("n_template") * NUMERATOR)
    return out.groupBy("_doc", "_template").agg(F.max_by(F.struct("first_word", "n_shared", "n_template"), F.struct("n_shared", (-F.col("first_word")).alias("w"))).alias("b")).select("_doc", "_template", "b.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_templates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_doc").alias("doc_id"), F.col("_template").alias("template"), "first_word", "n_shared", "n_template")


def _oracle() -> str:
    rows = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
    split = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"
    size = "case " + " ".join(f"when n_template <= {c} then {c}" for c in CLASSES) + " end"
    return f"""
with t as (select template, {split.format('t')} w from (values {rows}) v(template, t)),
t2 as (select template, w, least(len(w), {SHINGLE}) m from t),
s as (select distinct template, m, array_to_string(w[k:k + m - 1], ' ') s from (select *, unnest(range(1, len(w) - m + 2)) k from t2)),
n as (select template, m, count(*) n_template from s group by all),
n2 as (select *, {size} c from n),
d as (select doc_id, {split.format('text')} w from documents),
p as (select doc_id, m, k, array_to_string(w[k + 1:k + m], ' ') s from (select doc_id, w, m, unnest(range(0, len(w) - m + 1)) k from d, (select distinct m from t2) where len(w) >= m)),
h as (select doc_id, template, m, k, s from p join s using (m, s)),
x as (select doc_id, template, n_template, c, s, unnest(case when k // c > 0 then [k // c - 1, k // c] else [0] end) j from h join n2 using (template)),
g as (select doc_id, template, n_template, c, j, count(distinct s) n_shared from x group by all having 100 * n_shared >= 80 * n_template)
select doc_id, template, j * c first_word, n_shared, n_template from g
qualify row_number() over (partition by doc_id, template order by n_shared desc, j) = 1
"""


ORACLE = _oracle()
