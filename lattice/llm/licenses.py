"""License scans, in DataFrame functions alone.

Texts become words of [a-z0-9]; three consecutive words make a shingle. Overlapping windows
at the scale of each template's length are sketched by BANDS minima of one hash each. A run
of up to s words lies whole within a window of 1.25 s words, so that a template of five words or more
of which 80 % occurs there has a resemblance of at least 0.29 with it (of four words, 0.25) and shares
a band with a probability above 1 - (1 - 0.25) ** 32, or 0.9998. Shorter templates are refused.
Shared bands retrieve templates; the exact share of a template's shingles within the window then
decides.

A template's name is a license and, after a slash, the part of it that it states: notice, header, a
clause, the whole text. Licenses that differ in a version or a word share most of their shingles;
templates of other licenses that hold half of a template's shingles or more are its rivals, and the
wanted share of those that a rival lacks must be in the window too. So a notice of one version is
no match of another, and text that holds both notices matches both.

Only windows with an anchor are sketched. Of each template just more than the share that a match
may lack are anchor shingles, those of the rarest words: a window without any of them cannot match, and
none is lost. Nor is a window with fewer shingles than any match needs. Texts are only cut into words if
they hold one of a few anchor words, chosen in the same way.

Null, empty and short texts match nothing. The best window of each document and license is
returned, of equals the first; rows that share an id are one document.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import prepare, table

SHINGLE, BANDS, CONTAINMENT = 3, 32, 0.8
#: The fewest words of a template; the share of a template that makes another one its rival.
LEAST_WORDS, RIVAL = 4, 0.5
#: Templates up to this number are broadcast; more are joined by a shuffle.
BROADCAST_TEMPLATES = 2048

# Notices of public licenses.
NOTICES = {
    "MIT/released": "Released under the MIT License.",
    "MIT/notice": "This project is licensed under the MIT License",
    "MIT/permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT/warranty": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0/as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD/redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause/name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD/warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC/permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "EPL-2.0/header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0/text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "all-rights-reserved/notice": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}


@functools.cache
def templates() -> dict[str, str]:
    """The notices, and the whole texts of the files in ``license_texts``, named by license."""
    return NOTICES | {f"{p.stem}/text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


#: Words too common to be anchors.
_COMMON = frozenset("""a additional all and any application as be been but by conditions could do does each even every for free from general give granted have hereby if in include including into is it its made make may means more must new no not of on one only or
original other own part people permission permitted person product provided public reproduced right rights same shall should so some such terms than that the their them then there these they this those to under use used version was which who will with without work works would you your""".split())


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


TEMPLATES = templates()


def scale_of(n_words: int) -> int:
    """The power of two, 8 at least, that holds a template."""
    return max(8, 1 << (n_words - 1).bit_length())


def shingle_sets(templates: dict[str, str]) -> dict[str, dict[tuple[str, ...], None]]:
    """The distinct shingles of each template, in order."""
    out = {}
    for k, t in templates.items():
        w = template_words(t)
        if len(w) < LEAST_WORDS:
            raise ValueError(f"{k}: a template has {LEAST_WORDS} words or more")
        out[k] = dict.fromkeys(tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1))
    return out


def license_of(name: str) -> str:
    return name.split("/")[0]


def rivals(templates: dict[str, str]) -> dict[str, list[list[str]]]:
    """Of each template the shingles that each of its rivals lacks."""
    sets = shingle_sets(templates)
    out: dict[str, list[list[str]]] = {}
    for k, s in sets.items():
        lacking = [[g for g in s if g not in r] for j, r in sets.items() if license_of(j) != license_of(k)]
        lists = [[" ".join(g) for g in x] for x in lacking if 0 < len(x) <= (1 - RIVAL) * len(s)]
        out[k] = [list(x) for x in dict.fromkeys(map(tuple, lists))]
    return out


def anchors(templates: dict[str, str], share: float = CONTAINMENT) -> list[str]:
    """Few words such that in every template the shingles without any are less than ``share``."""
    sets = shingle_sets(templates)
    chosen: list[str] = []
    free = {k: list(s) for k, s in sets.items()}  # the shingles without an anchor so far
    while open_ := [k for k, f in free.items() if len(f) >= share * len(sets[k])]:
        gain: Counter[str] = Counter()
        for k in open_:
            held = Counter(w for g in free[k] for w in set(g))
            for word in [w for w in held if w not in _COMMON and len(w) > 3 and not w.isdigit()] or held:
                gain[word] += min(1.0, held[word] / len(sets[k]) / (1 - share)) * len(word)
        chosen.append(max(gain, key=lambda w: (gain[w], w)))
        free = {k: [g for g in f if chosen[-1] not in g] for k, f in free.items()}
    return chosen


def anchor_shingles(templates: dict[str, str], share: float = CONTAINMENT) -> list[str]:
    """Of each template the shingles with most letters outside common words, just more of them than a match may lack."""
    out: dict[str, None] = {}
    for s in shingle_sets(templates).values():
        rare = sorted(s, key=lambda g: (-sum(len(w) for w in g if w not in _COMMON and not w.isdigit()), g))
        out.update(dict.fromkeys(" ".join(g) for g in rare[: math.floor((1 - share) * len(s) + 1e-9) + 1]))
    return list(out)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _shingles(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def _starts(place: Column, scale: Column) -> Column:
    """The windows of a scale that hold a place: they start every quarter scale and are five quarters long."""
    step = (scale / 4).cast("int")
    last = F.floor(place / step).cast("int")
    return F.transform(F.sequence(F.greatest(last - 4, F.lit(0)), last), lambda k: F.struct(scale.alias("scale"), (k * step).alias("start")))


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(template, __scale, __band, __min) for each band, and (template, license, __ts, __rivals) with hashed shingles."""
    lacking = rivals(templates)
    rows = [(k, license_of(k), scale_of(len(template_words(t))), t, lacking[k]) for k, t in templates.items()]
    t = spark.createDataFrame(rows, "template string, license string, __scale int, __t string, __r array<array<string>>")
    hashed = F.transform("__r", lambda r: F.transform(r, lambda g: F.xxhash64(g)))
    # explode(array(x)), as in the scan, keeps x from being evaluated anew for each of its words
    t = t.select("template", "license", "__scale", hashed.alias("__rivals"), F.explode(F.array(_words(F.col("__t")))).alias("__w"))
    t = t.select("template", "license", "__scale", "__rivals", F.explode(F.array(F.array_distinct(_shingles(F.col("__w"))))).alias("__ts"))
    return t.select("template", "__scale", F.posexplode(_bands(F.col("__ts"))).alias("__band", "__min")), t.drop("__scale")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", share: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, containment, first_word and n_words of the best window of each match."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    if not templates:
        return spark.createDataFrame([], f"doc_id {source.schema[0].dataType.simpleString()}, license string, template string, containment double, first_word long, n_words long")
    bands, shingles = template_tables(spark, templates)
    fewest = _fewest(templates, share)
    words = anchors(templates, share)
    likely = F.lit(False)
    lower = F.lower("__text")
    for a in words:
        likely = likely | F.contains(lower, F.lit(a))
    # explode(array(x)) keeps x from being evaluated anew wherever it is used
    cut = source.where(likely).select("doc_id", F.explode(F.array(_words(F.col("__text")))).alias("__w"))
    shingled = cut.select("doc_id", F.size("__w").alias("__n"), F.explode(F.array(_shingles(F.col("__w")))).alias("__s"))
    held = [r[0] for r in spark.createDataFrame([(g,) for g in anchor_shingles(templates, share)], "g string").select(F.xxhash64("g")).collect()]
    places = F.filter(F.transform("__s", lambda x, i: F.when(x.isin(held), i)), lambda i: i.isNotNull())
    shingled = shingled.select("*", F.explode(F.array(places)).alias("__p")).where(F.size("__p") > 0)
    # scales of which no template can match a text of this length are left out at once
    scales = F.filter(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in fewest.items())), lambda x: x["n"] <= F.size("__s"))
    around = F.flatten(F.transform("__p", lambda p: F.flatten(F.transform(scales, lambda x: _starts(p, x["s"])))))
    least = F.element_at(F.create_map(*(F.lit(v) for pair in fewest.items() for v in pair)), F.col("__scale"))
    windows = shingled.select("doc_id", "__n", "__s", F.explode(F.array_distinct(around)).alias("__at")).select(
        "doc_id", F.col("__at.scale").alias("__scale"), F.col("__at.start").alias("__start"),
        F.least((F.col("__at.scale") * 5 / 4).cast("int"), F.col("__n") - F.col("__at.start")).alias("__len"),
        F.explode(F.array(F.slice("__s", F.col("__at.start") + 1, (F.col("__at.scale") * 5 / 4).cast("int") - (SHINGLE - 1)))).alias("__ws"),
    ).where(F.size("__ws") >= least)
    banded = windows.select("*", F.posexplode(_bands(F.col("__ws"))).alias("__band", "__min"))
    small = len(templates) <= BROADCAST_TEMPLATES
    matched = banded.join(F.broadcast(bands) if small else bands, ["__scale", "__band", "__min"])
    matched = matched.join(F.broadcast(shingles) if small else shingles, "template")
    sure = F.forall("__rivals", lambda r: F.size(F.array_intersect(r, "__ws")) >= F.lit(share) * F.size(r))
    exact = matched.select("doc_id", "license", "template", "__start", "__len", (F.size(F.array_intersect("__ts", "__ws")) / F.size("__ts")).alias("c"), "__rivals", "__ws").where(F.col("c") >= share)
    best = exact.where(sure).groupBy("doc_id", "license").agg(F.max(F.struct("c", (-F.col("__start")).alias("s"), "__len", "template")).alias("__b"))
    return best.select("doc_id", "license", "__b.template", F.col("__b.c").alias("containment"), (-F.col("__b.s")).cast("long").alias("first_word"), F.col("__b.__len").cast("long").alias("n_words"))


def _fewest(templates: dict[str, str], share: float) -> dict[int, int]:
    """By scale, the fewest shingles with which a window matches one of its templates."""
    out: dict[int, int] = {}
    sets = shingle_sets(templates)
    for k, t in templates.items():
        s = scale_of(len(template_words(t)))
        out[s] = min(out.get(s, 1 << 30), max(1, math.ceil(share * len(sets[k]) - 1e-9)))
    return dict(sorted(out.items()))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    lacking = rivals(TEMPLATES)
    text = lambda x: f"[{', '.join(map(repr, x))}]"
    rows = ", ".join(
        f"('{k}', '{license_of(k)}', {scale_of(len(template_words(t)))}, {text(' '.join(g) for g in s)}, [{', '.join(map(text, lacking[k]))}]::VARCHAR[][])"
        for (k, t), s in zip(TEMPLATES.items(), shingle_sets(TEMPLATES).values(), strict=True)
    )
    return f"""
WITH t(template, license, scale, ts, rivals) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS s FROM w WHERE len(w) >= 3),
k AS (SELECT DISTINCT scale FROM t),
a AS (SELECT list_distinct(flatten(list(ts))) AS every FROM t),
o AS (SELECT doc_id, scale, n, s, unnest(range(0, n, scale // 4)) AS start FROM s, k WHERE list_has_any(s, (SELECT every FROM a))),
v AS (SELECT doc_id, scale, start, least(scale * 5 // 4, n - start) AS len, s[start + 1 : start + scale * 5 // 4 - 2] AS ws FROM o),
e AS (SELECT doc_id, license, template, rivals, ws, start, len, len(list_intersect(ts, ws))::DOUBLE / len(ts) AS c FROM v JOIN t USING (scale) WHERE len(ws) > 0 AND list_has_any(ts, ws)),
f AS (SELECT * FROM e WHERE c >= {CONTAINMENT} AND len(list_filter(rivals, lambda r: len(list_intersect(r, ws)) < {CONTAINMENT} * len(r))) = 0)
SELECT doc_id, license, arg_max(template, (c, -start, len, template)) AS template, arg_max(c, (c, -start, len, template)) AS containment,
  arg_max(start, (c, -start, len, template))::BIGINT AS first_word, arg_max(len, (c, -start, len, template))::BIGINT AS n_words
FROM f GROUP BY doc_id, license"""
