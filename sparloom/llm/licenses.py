"""License scan with MinHash bands over overlapping windows, in DataFrame functions only (operator 9).

Words are runs of a-z and 0-9 of the lower-case text, shingles are five words (for a template of fewer words, as many as it
has). A template
matches a text if a window holds at least `CONTAINED` (0.8) of its shingles.

Windows: a template of n words belongs to the smallest length L >= n of a row of lengths that grow by a seventh. Windows of
2L words start at every multiple of L, so any n words in a row lie inside one of them. Bands: one MinHash each; their number
for a length is set from the smallest Jaccard similarity that a matching window can have, so that a match misses all bands
with a probability of at most `MISS`. Windows that meet a template in a band are verified by exact containment of shingles.

Only windows with an anchor are hashed: a template's anchors are words without which fewer than 0.8 of its shingles can be
there, so no match lies elsewhere. A text without any anchor has no license.

Defined cases: a null text is empty and has no license. Rows with the same doc_id, and equal rows, each get a row. An empty
table gives an empty result. A template without words is left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import free_name, materialize, row_key

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-6
FEW_TEMPLATES = 5_000  # a table of templates up to this number is broadcast

#: Wording of license notices. Those of one family are so short that a word that differs leaves less than CONTAINED.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (notice)": "Released under the MIT License",
    "MIT (permission)": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD (conditions of 2 and 3 clauses)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense (grant)": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT (warranty)": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD (warranty)": 'ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL",
    "Apache-1.1": "This product includes software developed by the Apache Software Foundation",
    "Artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "Perl": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    "X11": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization",
}
#: Parts of the wording of GNU headers and notices, and of Creative Commons notices.
GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
GNU_VERSIONS = (("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _short, _version in GNU_VERSIONS:
    _name = f"GNU {GNU[_short]} Public License"
    TEMPLATES[f"{_short}-{_version} (or later)"] = f"the terms of the {_name} as published by the Free Software Foundation, either version {_version} of the License, or (at"
    TEMPLATES[f"{_short}-{_version} (only)"] = f"under the terms of the {_name}, version {_version}, as published by the Free Software Foundation"
for _short, _kind in CC_KINDS.items():
    for _version, _area in CC_VERSIONS.items():
        TEMPLATES[f"CC-{_short}-{_version}"] = f"This work is licensed under a Creative Commons {_kind} {_version} {_area} License"
del _short, _version, _name, _kind, _area


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    return sorted({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})


def length_for(n: int) -> int:
    size = min(n, SHINGLE)
    while size < n:
        size = max(size + 1, size * 8 // 7)
    return size


def bands_for(shingles: int, length: int) -> int:
    """Bands that keep the probability of a miss within MISS for a template of so many shingles."""
    least = math.ceil(CONTAINED * shingles)
    window = 2 * length - min(length, SHINGLE) + 1
    similarity = least / (window + shingles - least)
    return max(1, math.ceil(math.log(MISS) / math.log1p(-similarity))) if similarity < 1 else 1


def anchors_of(words: list[str]) -> set[str]:
    """Words of a template, long ones first, without which less than CONTAINED of its shingles can be there."""
    grams, chosen = shingles_of(words), set()
    least = math.ceil(CONTAINED * len(grams))
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(not chosen & set(g.split()) for g in grams) < least:
            break
        chosen.add(w)
    return chosen


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, licenses: array of (name, containment, first_word, n_words of the best window), ordered by name."""
    spark = docs.sparkSession
    known = [(name, w) for name, t in (TEMPLATES if templates is None else templates).items() if (w := words_of(t))]
    ident, key, text = (free_name(docs, x) for x in ("_doc", "_key", "_text"))
    rows = docs.select(F.col(id_col).alias(ident), row_key(docs).alias(key), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(text))
    found = F.array().cast("array<struct<name:string,containment:double,first_word:bigint,n_words:bigint>>")
    if not known:
        return rows.select(F.col(ident).alias("doc_id"), found.alias("licenses"))
    by: dict[int, list] = {}
    for name, w in known:
        by.setdefault(length_for(len(w)), []).append((name, w))
    bands = {size: max(bands_for(len(shingles_of(w)), size) for _, w in group) for size, group in by.items()}
    anchors = {size: sorted(set().union(*(anchors_of(w) for _, w in group))) for size, group in by.items()}

    every = "|".join(sorted(set().union(*map(set, anchors.values()))))
    held = rows.where(F.rlike(F.col(text), F.lit(every))).select(key, F.regexp_extract_all(F.col(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = [
        F.expr(
            f"transform(array_distinct(flatten(transform(filter(transform(w, (x, i) -> if(array_contains(array({', '.join(repr(a) for a in anchors[size])}), x), i, -1)), i -> i >= 0),"
            f" i -> array(i div {size}, greatest(i div {size} - 1, 0))))), k -> named_struct('size', {size}, 'bands', {bands[size]}, 'at', k * {size}))"
        )
        for size in sorted(by)
    ]
    windows = held.select(key, "w", F.explode(F.concat(*starts)).alias("x")).select(key, F.col("x.size").alias("size"), F.col("x.bands").alias("bands"), F.col("x.at").alias("at"), F.expr("slice(w, x.at + 1, 2 * x.size)").alias("w"))
    grams = F.expr(f"array_distinct(transform(sequence(0, greatest(size(w) - least(size, {SHINGLE}), 0)), i -> xxhash64(array_join(slice(w, i + 1, least(size, {SHINGLE})), ' '))))")
    hashed = windows.select(key, "size", "bands", "at", F.size("w").alias("n"), grams.alias("grams"))
    signed = hashed.select("*", F.posexplode(F.expr("transform(sequence(0, bands - 1), j -> array_min(transform(grams, g -> xxhash64(g, j))))")).alias("band", "low"))

    table = spark.createDataFrame([(size, name, g) for size, group in by.items() for name, w in group for g in shingles_of(w)], "size int, name string, gram string")
    table = table.groupBy("size", "name").agg(F.collect_set(F.xxhash64("gram")).alias("wanted"))
    table = table.join(spark.createDataFrame(list(bands.items()), "size int, bands int"), "size")
    table = table.select("size", "name", "wanted", F.posexplode(F.expr("transform(sequence(0, bands - 1), j -> array_min(transform(wanted, g -> xxhash64(g, j))))")).alias("band", "low"))
    table = F.broadcast(table) if len(known) <= FEW_TEMPLATES else table
    met = signed.join(table, ["size", "band", "low"])
    share = F.size(F.array_intersect("grams", "wanted")) / F.size("wanted")
    sure = met.select(key, "name", share.alias("share"), "at", "n").where(F.col("share") >= CONTAINED)
    best = sure.groupBy(key, "name").agg(F.max(F.struct(F.col("share"), (-F.col("at")).alias("before"), F.col("n"))).alias("b"))
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("b.share").alias("containment"), (-F.col("b.before")).cast("long").alias("first_word"), F.col("b.n").cast("long").alias("n_words")))).alias("licenses"))
    listed = materialize(listed, "licenses")
    return rows.select(ident, key).join(listed, key, "left").select(F.col(ident).alias("doc_id"), F.coalesce("licenses", found).alias("licenses"))
