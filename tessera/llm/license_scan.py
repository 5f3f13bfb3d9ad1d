"""Licence notices and texts in documents, in DataFrame operations only.

Texts and licence templates are normalised to lower-case words of letters and digits and compared by the Dice
coefficient of their sets of word bigrams: twice the common ones over the sum of both sizes. What is compared are
windows of consecutive words of the whole text, across line breaks. A window consists of whole runs of bigrams that the
template has, and what is between them: one that began or ended elsewhere would be less like the template. A window
whose size can't reach the threshold is not compared: a template of m bigrams needs t / (2 - t) * m of them at least,
within (2 - t) / t * m at most.

Templates are constants of the query's expressions, so documents aren't joined with anything and never shuffled. Their
bigrams are looked up by hash in a table of two places for each, which takes the same time for any number of them.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
#: Name and text of whole licences without the copyright line, then of notices; equal likeness goes to the first.
TEMPLATES = [
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("boost-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("gpl-full-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(bigrams: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """How many bigrams a window has in common with a template at least, and how many places it has at most: twice the largest set, as a window may hold each bigram twice."""
    return math.ceil(threshold / (2 - threshold) * bigrams - 1e-9), 2 * math.floor((2 - threshold) / threshold * bigrams + 1e-9)


def _hash(x: str, y: str) -> int:
    """Spark's xxhash64 of two strings."""
    h = xxhash.xxh64_intdigest(y.encode(), xxhash.xxh64_intdigest(x.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'cast({v} as bigint)' if v == -(1 << 63) else f'{v}L' for v in values)})")


class _Table:
    """Bigrams' hashes in two arrays; each is in one of its two places, beside the mask of the templates that have it."""

    def __init__(self, masks: dict[int, int]):
        self.bits = max(4, (4 * len(masks)).bit_length())
        while not self._placed(masks):
            self.bits += 1

    def _place(self, h: int, which: int) -> int:
        return (h >> (self.bits * which)) & ((1 << self.bits) - 1)

    def _placed(self, masks: dict[int, int]) -> bool:
        slots: list[dict[int, int]] = [{}, {}]
        for h in masks:
            which = 0
            for _ in range(500):
                at = self._place(h, which)
                h, slots[which][at] = slots[which].get(at), h
                if h is None:
                    break
                which = 1 - which
            else:
                return False
        size = range(1 << self.bits)
        self.hashes = [_longs([s.get(i, 0) for i in size]) for s in slots]
        self.masks = [_longs([masks.get(s.get(i), 0) for i in size]) for s in slots]
        return True

    def _at(self, h: Column, which: int) -> Column:
        return F.shiftright(h, self.bits * which).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")

    def has(self, h: Column) -> Column:
        return (F.get(self.hashes[0], self._at(h, 0)) == h) | (F.get(self.hashes[1], self._at(h, 1)) == h)

    def mask(self, h: Column) -> Column:
        first = self._at(h, 0)
        return F.when(F.get(self.hashes[0], first) == h, F.get(self.masks[0], first)).otherwise(F.get(self.masks[1], self._at(h, 1)))


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is worked out once: an array of one element binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _rest(a: Column, first: int) -> Column:
    return F.slice(a, first, F.greatest(F.size(a) - 1, F.lit(0)))


_WINDOW = "struct<dice:double,template:int,start:int,stop:int>"


def _windows(b: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """(dice, template, start, stop) of the windows of the hashed bigrams b that are like a template; places from 0."""
    grams = [{_hash(*x) for x in zip(w, w[1:])} for w in (template_words(t) for _, t in templates)]
    if len(templates) > 62:
        raise ValueError("at most 62 templates at once")
    table = _Table({h: sum(1 << i for i, g in enumerate(grams) if h in g) for h in sorted(set().union(*grams))})
    bounds = [size_bounds(len(g), threshold) for g in grams]
    sizes, leasts, spans = (_longs(list(x)) for x in ([len(g) for g in grams], [x for x, _ in bounds], [x for _, x in bounds]))

    def of_template(hits: Column, t: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), t)
        size, least, span = F.get(sizes, t), F.get(leasts, t).cast("int"), F.get(spans, t).cast("int")

        def of_places(at: Column) -> Column:
            k = F.sequence(F.lit(0), F.size(at) - 1)
            starts = F.filter(k, lambda i: ((i == 0) | (F.get(at, i - 1) != F.get(at, i) - 1)) & (F.get(at, i + least - 1) - F.get(at, i) < span))

            def of_start(i: Column) -> Column:
                near = F.filter(F.sequence(i + least - 1, F.least(i + span, F.size(at)) - 1), lambda j: (F.get(at, j) - F.get(at, i) < span) & ((j == F.size(at) - 1) | (F.get(at, j + 1) != F.get(at, j) + 1)))

                def like(j: Column) -> Column:
                    whole = F.size(F.array_distinct(F.slice(b, F.get(at, i) + 1, F.get(at, j) - F.get(at, i) + 1)))
                    common = F.size(F.array_distinct(F.transform(F.slice(at, i + 1, j - i + 1), lambda x: F.get(b, x))))
                    return F.struct((common * F.lit(2.0) / (whole + size)).alias("dice"), t.cast("int").alias("template"), F.get(at, i).alias("start"), F.get(at, j).alias("stop"))

                return F.filter(F.transform(near, like), lambda w: w["dice"] >= threshold)

            return F.flatten(F.transform(starts, of_start))

        def checked(at: Column) -> Column:
            return F.when(F.size(at) >= least, of_places(at)).otherwise(F.array().cast(f"array<{_WINDOW}>"))

        return _let(F.transform(F.filter(hits, lambda x: x["mask"].bitwiseAND(bit) != 0), lambda x: x["at"]), checked)

    fewest = min(x for x, _ in bounds)
    every = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: table.has(F.get(b, i)))

    def of_hits(at: Column) -> Column:
        hits = F.transform(at, lambda i: F.struct(i.alias("at"), table.mask(F.get(b, i)).alias("mask")))
        found = _let(hits, lambda h: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: of_template(h, t))))
        return F.when(F.size(at) >= fewest, found).otherwise(F.array().cast(f"array<{_WINDOW}>"))

    return F.when(F.size(b) > 0, _let(every, of_hits)).otherwise(F.array().cast(f"array<{_WINDOW}>"))


def _chosen(windows: Column) -> Column:
    """The most alike first (then the earlier template, start, stop), without those that overlap one chosen before."""
    order = F.array_sort(F.transform(windows, lambda w: F.struct((-w["dice"]).alias("less"), w["template"].alias("template"), w["start"].alias("start"), w["stop"].alias("stop"))))
    return _let(order, lambda o: F.aggregate(o, F.slice(o, 1, 0), lambda acc, w: F.when(F.exists(acc, lambda x: (x["start"] <= w["stop"]) & (w["start"] <= x["stop"])), acc).otherwise(F.concat(acc, F.array(w)))))


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with an array of (line, license, dice): the windows of the text like a template, none of which overlap, with the line (from 1) of the first word.

    Of overlapping windows the most alike stays; equal likeness goes to the earlier template, then the earlier window.
    Null, empty and one-word texts hold none; very long ones are scanned whole. Repeated rows are scanned alike; an
    empty table gives an empty result. An added column replaces one of the same name. At most 62 templates.
    """
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    names = F.array(*(F.lit(n) for n, _ in templates))

    def scanned(text: Column) -> Column:
        words = F.filter(F.split(text, "[ \n]+"), lambda w: w != "")
        bigrams = _let(words, lambda w: F.zip_with(_rest(w, 1), _rest(w, 2), lambda x, y: F.xxhash64(x, y)))
        numbers = F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w: (i + 1).cast("long"))))

        def placed(found: Column) -> Column:
            rows = _let(numbers, lambda n: F.transform(found, lambda w: F.struct(F.get(n, w["start"]).alias("line"), F.get(names, w["template"]).alias("license"), (-w["less"]).alias("dice"))))
            return F.when(F.size(found) > 0, F.array_sort(rows)).otherwise(F.array().cast("array<struct<line:bigint,license:string,dice:double>>"))

        return _let(_let(bigrams, lambda b: _chosen(_windows(b, templates, threshold))), placed)

    return docs.withColumn(out_col, _let(text, scanned))


def best_license(found: DataFrame, id_col: str = "doc_id", licenses_col: str = "licenses") -> DataFrame:
    """(doc_id, license, dice, line, n_matches): of each row the match most like its template, the first of equal ones; nulls and 0 where there is none."""
    best = F.array_max(F.transform(licenses_col, lambda x: F.struct(x["dice"].alias("dice"), (-x["line"]).alias("back"), x["license"].alias("license"))))
    return found.select(F.col(id_col).alias("doc_id"), best.alias("b"), F.size(licenses_col).cast("long").alias("n_matches")).select("doc_id", F.col("b.license").alias("license"), F.col("b.dice").alias("dice"), (-F.col("b.back")).alias("line"), "n_matches")


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, template_bigrams(t)))}], {size_bounds(len(template_bigrams(t)))[0]}, {size_bounds(len(template_bigrams(t)))[1]})" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH t(i, license, b, least, span) AS (VALUES {values}),
g AS (SELECT i, len(b) AS m, least, span, unnest(b) AS gram FROM t),
l AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS line FROM (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)) AS s FROM documents)),
w AS (SELECT doc_id, list(word ORDER BY line, j) AS w, list(line ORDER BY line, j) AS n FROM (SELECT doc_id, line, unnest(x) AS word, unnest(range(len(x))) AS j FROM (SELECT doc_id, line, list_filter(string_split(s, ' '), lambda y: y <> '') AS x FROM l)) GROUP BY doc_id),
b AS (SELECT doc_id, n, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS b FROM w WHERE len(w) > 1),
p AS (SELECT doc_id, unnest(b) AS gram, unnest(range(len(b))) AS pos FROM b),
h AS (SELECT doc_id, i, m, least, span, pos, gram, pos - row_number() OVER (PARTITION BY doc_id, i ORDER BY pos) AS run FROM p JOIN g USING (gram)),
r AS (SELECT doc_id, i, m, least, span, run, min(pos) AS start, max(pos) AS stop FROM h GROUP BY ALL),
c AS (SELECT x.doc_id, x.i, x.m, x.least, x.start, y.stop FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.i = y.i AND y.stop >= x.start AND y.stop - x.start < x.span AND y.stop - x.start + 1 >= x.least),
e AS (SELECT c.doc_id, c.i, c.m, c.least, c.start, c.stop, count(DISTINCT h.gram) AS common FROM c JOIN h ON h.doc_id = c.doc_id AND h.i = c.i AND h.pos BETWEEN c.start AND c.stop GROUP BY ALL),
d AS (SELECT e.doc_id, e.i, e.start, e.stop, 2.0::DOUBLE * common / (len(list_distinct(list_slice(b.b, e.start + 1, e.stop + 1))) + e.m) AS dice FROM e JOIN b USING (doc_id) WHERE common >= e.least),
s AS (SELECT doc_id, list({{'dice': dice, 'i': i, 'start': start, 'stop': stop}} ORDER BY dice DESC, i, start, stop) AS s FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.start <= x[1].stop AND x[1].start <= y.stop)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM s),
u AS (SELECT doc_id, unnest(k) AS x, len(k) AS n_matches FROM k),
f AS (SELECT u.doc_id, t.license, x.dice AS dice, b.n[x.start + 1] AS line, n_matches, row_number() OVER (PARTITION BY u.doc_id ORDER BY x.dice DESC, b.n[x.start + 1], t.license DESC) AS first FROM u JOIN t ON t.i = x.i JOIN b ON b.doc_id = u.doc_id)
SELECT documents.doc_id, license, dice, CAST(line AS BIGINT) AS line, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id AND first = 1
"""
