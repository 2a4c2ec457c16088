"""License scan: MinHash bands over overlapping windows, then exact containment, in DataFrame functions alone.

Texts and templates are lower-cased words of a-z and 0-9, and five-word
shingles of them as 64-bit hashes. A text matches a template if it holds at
least `percent` of the template's distinct shingles.

Windows of WINDOW consecutive shingles start at each shingle. A band is one
MinHash: the smallest of a window's hashes under a band's own permutation
(exclusive or with a seed). Two equal windows agree in all BANDS bands. A text
that holds 80 % of the m shingles of a template lacks at most m / 5 of them, so
WINDOW = 4 neighbours in the template are all there as soon as m >= LEAST = 16
(more than 3 for each gap). Where the text has these side by side, as any copy
with words changed, left out or put in has, retrieval is certain. Where it has
every shingle in a place of its own, the least of the seven shingles in a
window of either side is the common one with probability 1/7 or more in each band
of each shingle, so all of 13 shingles and BANDS bands miss with less than
(6/7)^52 < 0.0004. For other values of `percent`, LEAST is set so that the
four neighbours are there as well.

A template of fewer shingles goes by windows of one shingle, whose MinHash is
the shingle: of m shingles, any m - ceil(percent * m) + 1 include one that the text
holds, and of those that the fewest templates share so many are looked for. That
is certain, wherever the notice stands.

Retrieval runs within the row: a Bloom filter of fixed size, folded into the plan,
leaves a text's few bands that some template has. These are joined to the table
of templates' bands, and the shingles of those templates are counted. The
templates are rows of tables, not parts of the plan. Texts are not shuffled.

Contract: null texts match nothing. Each input row gives one output row.
Columns of other names are ignored. Texts of fewer than five words match
nothing; so templates have five words at least.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.quality import let

BANDS, WINDOW, SHINGLE = 4, 4, 5
#: Longs of the Bloom filter; two probes a band.
BLOOM = 1 << 14
#: Most templates a scan takes: their shingles and bands are collected to build the tables and the filter.
MOST_TEMPLATES = 5000
# Names of public licenses by SPDX identifier.
NAMES = {
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "AGPL-3.0 license"],
    "Apache-1.1": ["Apache License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"],
    "APSL-2.0": ["Apple Public Source License 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1"],
    "CPL-1.0": ["Common Public License 1.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public License 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-2.0": ["GNU General Public License version 2", "GPL-2.0 license"],
    "GPL-3.0": ["GNU General Public License version 3", "GPL-3.0 license"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "LGPL-2.1 license"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "LGPL-3.0 license"],
    "LPPL-1.3c": ["LaTeX Project Public License version 1.3c"],
    "MIT": ["MIT License", "MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0 license"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License v1.0", "Open Data Commons Open Database License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "QPL-1.0": ["Q Public License 1.0"],
    "Ruby": ["Ruby License"],
    "Unlicense": ["The Unlicense"],
    "UPL-1.0": ["Universal Permissive License v1.0"],
    "Vim": ["Vim License"],
    "W3C": ["W3C Software Notice and License"],
    "WTFPL": ["Do What The F*ck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "ZPL-2.1": ["Zope Public License 2.1"],
}
# How notices name a license.
PHRASES = ("Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}")
# Notices and parts of public licenses.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-SA-3.0": ["Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY'],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
}


def all_templates() -> dict[str, list[str]]:
    """Notices, and each phrase with each name that gives five words or more."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for spdx, names in NAMES.items():
        for phrase in PHRASES:
            for name in names:
                if len(plain_words(text := phrase.format(name))) >= SHINGLE:
                    out.setdefault(spdx, []).append(text)
    return {k: list({" ".join(plain_words(t)): t for t in reversed(v)}.values())[::-1] for k, v in out.items()}


def plain_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


TEMPLATES = all_templates()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _zip(x: Column, shift: int, n: Column, f) -> Column:
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + shift), n), f)


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; empty for fewer words."""
    pair = lambda a, b: F.xxhash64(a, b)
    none = F.array().cast("array<bigint>")

    def of_words(h: Column) -> Column:
        n = F.size(h)
        four = lambda two: _zip(two, 2, n - 3, pair)
        five = lambda q: F.zip_with(F.slice(q, F.lit(1), n - 4), F.slice(h, F.lit(5), n - 4), pair)
        return F.when(n < SHINGLE, none).otherwise(let(_zip(h, 1, n - 1, pair), lambda two: let(four(two), five)))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of_words)


def bands(g: Column, seeds: list[int]) -> Column:
    """All windows' MinHashes; none for fewer shingles than a window. Seeds keep the bands' values apart."""

    def of_band(seed: int) -> Column:
        n = F.size(g)
        two = lambda x: _zip(x, 1, n - 1, lambda a, b: F.least(a, b))
        window = lambda x: _zip(x, 2, n - 3, lambda a, b: F.least(a, b))
        return let(let(F.transform(g, lambda x: x.bitwiseXOR(F.lit(seed))), two), window)

    none = F.array().cast("array<bigint>")
    return F.when(F.size(g) >= WINDOW, F.concat(*[of_band(x) for x in seeds])).otherwise(none)


def least_size(percent: int) -> int:
    """From so many shingles on, WINDOW neighbours of a template are in every text that matches it."""
    m = 1
    while m <= 10_000 and any(-(-percent * n // 100) <= (WINDOW - 1) * (n - -(-percent * n // 100) + 1) for n in range(m, m + 100)):
        m += 1
    return m


def template_rows(spark: SparkSession, templates: dict[str, list[str]], seeds: list[int], percent: int) -> list[dict]:
    """number, license, shingles (distinct), bands to look for, of each template."""
    notices = [(name, text) for name, texts in templates.items() for text in texts]
    if len(notices) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if short := [t for _, t in notices if len(plain_words(t)) < SHINGLE]:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    table = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(notices)], "number int, license string, text string")
    ready = table.withColumn("g", shingles(F.col("text"))).select("number", "license", F.array_distinct("g").alias("shingles"), F.array_distinct(bands(F.col("g"), seeds)).alias("bands"))
    rows = [r.asDict() for r in ready.orderBy("number").collect()]  # MOST_TEMPLATES rows at most
    held = Counter(x for r in rows for x in r["shingles"])
    least = least_size(percent)
    for r in rows:
        m = len(r["shingles"])
        if m < least:  # windows of one shingle
            r["bands"] = sorted(r["shingles"], key=lambda x: (held[x], x))[: m - -(-percent * m // 100) + 1]
    return rows


def bloom(values: list[int]) -> list[int]:
    bits = np.zeros(64 * BLOOM, np.uint8)
    for v in values:
        for shift in (0, 20):
            bits[v >> shift & (64 * BLOOM - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def _passes(v: Column, bits: Column) -> Column:
    probe = lambda shift: F.getbit(F.get(bits, F.shiftright(v, shift + 6).bitwiseAND(F.lit(BLOOM - 1)).cast("int")), F.shiftright(v, shift).bitwiseAND(F.lit(63)).cast("int")) == 1
    return probe(0) & probe(20)


def seeds_for(seed: int) -> list[int]:
    return [((seed + k + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(BANDS)]


def license_report(docs: DataFrame, percent: int = 80, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, licenses (sorted, joined by commas), n_licenses, best_percent; one row per input row. No shuffle of texts."""
    spark, seeds = docs.sparkSession, seeds_for(seed)
    known = template_rows(spark, templates, seeds, percent)
    wanted = spark.createDataFrame([(b, r["number"]) for r in known for b in r["bands"]], "band bigint, number int")
    of_number = spark.createDataFrame([(r["number"], r["license"], r["shingles"]) for r in known], "number int, license string, own array<bigint>")
    # one literal of fixed size, whatever the templates
    bits = F.split(F.lit(",".join(map(str, bloom([b for r in known for b in r["bands"]])))), ",").cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), shingles(F.coalesce(F.col(text_col), F.lit(""))).alias("g"))
    hits = rows.select("doc_id", "row", let(F.col("g"), lambda g: F.struct(g.alias("g"), F.array_distinct(F.filter(F.concat(g, bands(g, seeds)), lambda v: _passes(v, bits))).alias("b"))).alias("h"))
    hit = F.size("h.b") > 0
    one = hits.select("doc_id", "row", F.when(hit, F.col("h.g")).alias("g"), F.explode_outer("h.b").alias("band"))
    found = one.join(wanted, "band", "left").join(of_number, "number", "left")
    share = (100 * F.size(F.array_intersect("g", "own")) / F.size("own").cast("double")).cast("double")
    found = found.select("doc_id", "row", "license", F.when(F.col("own").isNotNull(), share).alias("share"))
    good = F.col("share") >= percent
    out = found.groupBy("row", "doc_id").agg(F.collect_set(F.when(good, F.col("license"))).alias("names"), F.max(F.when(good, F.col("share"))).alias("best"))
    return out.select("doc_id", F.array_join(F.array_sort("names"), ",").alias("licenses"), F.size("names").cast("long").alias("n_licenses"), F.coalesce("best", F.lit(0.0)).alias("best_percent"))


def oracle_sql(percent: int = 80, templates: dict[str, list[str]] = TEMPLATES) -> str:
    """The same result from containment alone, by joins of shingles."""
    rows = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate((n, t) for n, ts in templates.items() for t in ts))
    return f"""
        WITH t(number, license, text) AS (VALUES {rows}),
        tw AS (SELECT number, license, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM t),
        ts AS (SELECT DISTINCT number, license, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM tw)),
        tn AS (SELECT number, count(*) AS n FROM ts GROUP BY number),
        dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
        ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM dw)),
        m AS (SELECT doc_id, ts.number, license, 100.0::DOUBLE * count(*) / any_value(n) AS percent FROM ds JOIN ts USING (s) JOIN tn ON tn.number = ts.number GROUP BY doc_id, ts.number, license),
        k AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n_licenses, max(percent) AS best_percent FROM m WHERE percent >= {percent} GROUP BY doc_id)
        SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0) AS n_licenses, coalesce(best_percent, 0.0)::DOUBLE AS best_percent FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""
