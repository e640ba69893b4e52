"""Licence scans: normalised text compared to licence templates, in DataFrame functions alone.

Two things are compared to a template: single lines, and windows of as many words as the template has,
across line breaks and within longer lines, that begin with one of its bigrams. A line or window and a
template are bags of word bigrams; their Dice coefficient is twice the bigrams they share,
repeats counted, over the bigrams of both. Line lengths bound it: a line of a bigrams can reach t with a
template of b only if t / (2 - t) <= a / b <= (2 - t) / t, so each number of bigrams has a short list of
candidate templates. A line must also hold one of a few words of its candidates that more than the
allowed share of the template's bigrams contain; lines and texts without any such word can't reach t.
Of the other texts only the places of bigrams that some template has are kept; a window is compared if as
many of its template's bigrams follow its begin closely enough. Windows that overlap make one span.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient.
THRESHOLD = 0.8

#: Texts of public licences, the notices that they ask for, and how they are commonly named.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    licence: str
    number: int
    words: tuple[str, ...]

    @property
    def bigrams(self) -> list[str]:
        return [f"{a} {b}" for a, b in zip(self.words, self.words[1:], strict=False)]


def normal(text: str) -> tuple[str, ...]:
    """Lower-cased words of ASCII letters, digits and all beyond ASCII."""
    return tuple(re.findall(WORD, text.lower()))


def templates(named: dict[str, tuple[str, ...]]) -> list[Template]:
    found = [Template(name, i, normal(t)) for name, texts in sorted(named.items()) for i, t in enumerate(texts)]
    short = [t for t in found if len(t.words) < 2]
    if short:
        raise ValueError(f"templates need two words: {short}")
    return found


def sizes(b: int, threshold: float) -> range:
    """The numbers of bigrams with which a line can reach the threshold against b bigrams."""
    return range(max(1, math.ceil(b * threshold / (2 - threshold) - 1e-9)), math.floor(b * (2 - threshold) / threshold + 1e-9) + 1)


def anchors(all_: list[Template], threshold: float) -> list[str]:
    """Words so chosen that a line without any of them shares too few bigrams with every template.

    A line that reaches the threshold shares at least threshold / (2 - threshold) of a template's
    bigrams; once those that hold a chosen word are so many that fewer remain, any such line holds a
    chosen word. Rarer words in running text, and words that serve several templates, are taken first.
    """
    common = set("a all and any are as be by for in is it of on or that the this to under with you".split())
    serves: dict[str, int] = {}
    for t in all_:
        for w in set(t.words):
            serves[w] = serves.get(w, 0) + 1
    out: dict[str, None] = {}
    for t in all_:
        need = math.ceil(len(t.bigrams) * threshold / (2 - threshold) - 1e-9)
        left = [g for g in t.bigrams if not any(w in out for w in g.split())]
        while len(left) >= need:
            counts: dict[str, int] = {}
            for gram in left:
                for w in dict.fromkeys(gram.split()):
                    counts[w] = counts.get(w, 0) + 1
            best = max(counts, key=lambda w: (len(w) > 6, w not in common and not w.isdigit(), counts[w], serves[w], len(w), w))
            out[best] = None
            left = [g for g in left if best not in g.split()]
    return sorted(out)


def _bag(grams: Column) -> Column:
    """Bigrams, each numbered among its equals, so that shared ones can be counted as a set's."""
    ordered = F.array_sort(grams)
    return F.transform(ordered, lambda g, i: F.concat_ws("\x01", g, (i - F.array_position(ordered, g) + 1).cast("string")))


def _lit_bag(grams: list[str]) -> Column:
    ordered = sorted(grams)
    return F.array(*(F.lit(f"{g}\x01{i - ordered.index(g)}") for i, g in enumerate(ordered)))


def scan(docs: DataFrame, named: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_license_lines, n_license_spans, licenses (sorted, comma-joined), best_dice, matches and spans.

    Every \\n-separated line of the whole text is compared to its candidate templates; of a line's
    templates the highest coefficient wins, then the licence's name. ``matches`` lists line number
    (from 0), licence and coefficient. ``spans`` lists the licence, the first word, the word after the
    last and the highest coefficient of every run of overlapping windows of one template; words are
    counted over the whole text, and a text of fewer words than the template is one window. licenses
    and best_dice are over both. Null and empty texts have one empty line and no match; lines and texts
    of fewer than two words match nothing. Nothing is shuffled: hot keys, repeated rows and null ids
    make no difference. An empty table gives no rows; other columns are ignored.
    """
    all_ = templates(named or TEMPLATES)
    by_size: dict[int, list[int]] = {}
    for i, t in enumerate(all_):
        for n in sizes(len(t.bigrams), threshold):
            by_size.setdefault(n, []).append(i)
    longest = max(by_size)
    words = anchors(all_, threshold)

    def holds(x: Column) -> Column:
        return functools.reduce(Column.__or__, (x.contains(w) for w in words))

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.lower(body).alias("body"))
    none = F.array().cast("array<struct<line:int,body:string>>")
    some = F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("body"))), lambda x: holds(x["body"]))
    n_lines = (F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("long")
    all_words = F.when(holds(F.col("body")), F.regexp_extract_all("body", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    slim = slim.select("doc_id", n_lines.alias("n_lines"), F.when(holds(F.col("body")), some).otherwise(none).alias("found"), all_words.alias("all_words"))
    slim = _windows(slim, all_, threshold)
    grams = F.transform(
        F.col("found"),
        lambda x: F.struct(x["line"].alias("line"), F.regexp_extract_all(x["body"], F.lit(WORD), F.lit(0)).alias("words")),
    )
    grams = F.filter(grams, lambda x: (F.size(x["words"]) >= 2) & (F.size(x["words"]) <= longest + 1))
    bags = F.transform(
        grams,
        lambda x: F.struct(
            x["line"].alias("line"),
            _bag(F.transform(F.slice(x["words"], F.lit(1), F.size(x["words"]) - 1), lambda w, i: F.concat_ws(" ", w, F.get(x["words"], i + 1)))).alias("bag"),
        ),
    )
    slim = slim.withColumn("bags", F.when(F.size("found") > 0, bags).otherwise(F.array().cast("array<struct<line:int,bag:array<string>>>"))).drop("found")

    # one compiled expression per template: each line of a fitting size against it
    def against(i: int, t: Template, bag: Column) -> Column:
        n = len(t.bigrams)
        fits = sizes(n, threshold)
        dice = 2.0 * F.size(F.array_intersect(bag, _lit_bag(t.bigrams))) / (F.size(bag) + n)
        return F.when(F.size(bag).between(fits.start, fits.stop - 1), dice).otherwise(F.lit(0.0))

    best = F.transform(
        F.col("bags"),
        lambda x: F.struct(
            x["line"].alias("line"),
            F.array_max(F.array(*(F.struct(against(i, t, x["bag"]).alias("dice"), F.lit(-i).alias("order"), F.lit(t.licence).alias("license")) for i, t in enumerate(all_)))).alias("best"),
        ),
    )
    hits = F.transform(F.filter(best, lambda x: x["best"]["dice"] >= threshold - 1e-12), lambda x: F.struct(x["line"].alias("line"), x["best"]["license"].alias("license"), x["best"]["dice"].alias("dice")))
    out = slim.withColumn("matches", F.when(F.size("bags") > 0, hits).otherwise(F.array().cast("array<struct<line:int,license:string,dice:double>>")))
    every = lambda name: F.concat(F.transform("matches", lambda m: m[name]), F.transform("spans", lambda m: m[name]))
    return out.select(
        "doc_id", "n_lines", F.size("matches").cast("long").alias("n_license_lines"), F.size("spans").cast("long").alias("n_license_spans"),
        F.array_join(F.array_sort(F.array_distinct(every("license"))), ",").alias("licenses"), F.coalesce(F.array_max(every("dice")), F.lit(0.0)).alias("best_dice"), "matches", "spans",
    )


SPANS = "array<struct<license:string,start:int,end:int,dice:double>>"


def _windows(docs: DataFrame, all_: list[Template], threshold: float) -> DataFrame:
    """Adds ``spans`` to rows with ``all_words``: runs of windows that reach the threshold, by first word, last word and licence."""
    n = F.size("all_words")
    gram = F.transform(F.slice("all_words", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("all_words", i + 1)))
    docs = docs.withColumn("grams", gram)
    named = sorted({g for t in all_ for g in t.bigrams})
    hits = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda x: x["gram"].isin(named))
    docs = docs.withColumn("hits", hits)
    # of each template the places of its bigrams, the fewest that a window needs, and what it is compared with
    def places_of(t: Template) -> Column:
        return F.transform(F.filter("hits", lambda x: x["gram"].isin(sorted(set(t.bigrams)))), lambda x: x["at"])

    places = F.array(*map(places_of, all_))
    sizes_ = F.array(*(F.lit(len(t.bigrams)) for t in all_))
    licences = F.array(*(F.lit(t.licence) for t in all_))
    bags = F.array(*(_lit_bag(t.bigrams) for t in all_))
    total = F.size("grams")

    def windows(at: Column, k: Column) -> Column:
        size = F.get(sizes_, k)
        wide = F.least(size, total)  # bigrams of a window
        need = F.ceil(F.lit(threshold) * (wide + size) / 2 - 1e-9).cast("int")
        begin = lambda p: F.least(p, total - wide)
        starts = F.transform(at, lambda p, i: F.when(F.get(at, i + need - 1) < begin(p) + wide, begin(p)))
        dice = lambda s: 2.0 * F.size(F.array_intersect(_bag(F.slice("grams", s + 1, wide)), F.get(bags, k))) / (wide + size)
        found = F.transform(F.array_distinct(F.filter(starts, lambda s: s.isNotNull())), lambda s: F.struct(F.get(licences, k).alias("license"), s.alias("start"), (s + wide + 1).alias("end"), dice(s).alias("dice")))
        return F.filter(found, lambda x: x["dice"] >= threshold - 1e-12)

    def merged(found: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            joined = F.struct(x["license"].alias("license"), last["start"].alias("start"), x["end"].alias("end"), F.greatest(last["dice"], x["dice"]).alias("dice"))
            return F.when((F.size(done) > 0) & (last["end"] > x["start"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(found, F.array().cast(SPANS), add)

    docs = docs.withColumn("places", F.when(F.size("hits") > 0, places).otherwise(F.array().cast("array<array<int>>")))
    spans = F.flatten(F.transform("places", lambda at, k: merged(windows(at, k))))
    order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["license"].alias("license"), x["dice"].alias("dice")))
    spans = F.transform(F.array_sort(order), lambda x: F.struct(x["license"].alias("license"), x["start"].alias("start"), x["end"].alias("end"), x["dice"].alias("dice")))
    return docs.withColumn("spans", F.coalesce(spans, F.array().cast(SPANS))).drop("all_words", "grams", "hits", "places")
