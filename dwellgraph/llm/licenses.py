"""License scans: Dice coefficient over word bigrams against templates, in DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match, in hundredths.
PERCENT = 80

_FREE = "you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
_SIMPLE_BSD = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_END = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_CREATIVE = {"CC-BY-4.0": ("BY", "Attribution"), "CC-BY-SA-4.0": ("BY-SA", "Attribution-ShareAlike"), "CC-BY-ND-4.0": ("BY-ND", "Attribution-NoDerivatives"), "CC-BY-NC-4.0": ("BY-NC", "Attribution-NonCommercial"), "CC-BY-NC-SA-4.0": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "CC-BY-NC-ND-4.0": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}


def _gnu(kind: str, name: str, version: str) -> list[str]:
    start = f"This {kind} is free software" + (":" if version.startswith("3") else ";")
    notice = f"{start} {_FREE.format(name=name)}, either version {version} of the License, or (at your option) any later version."
    return [f"This work is licensed under the {name}, version {version}.", notice, f"{notice} This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."]


#: Texts by which works state a licence: one-line notices, the paragraphs that tell it apart, and whole texts.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", _MIT, f"{_MIT} {_MIT_END}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, f"{_APACHE} {_APACHE_END}"],
    "GPL-2.0": _gnu("program", "GNU General Public License", "2"),
    "GPL-3.0": _gnu("program", "GNU General Public License", "3"),
    "LGPL-2.1": _gnu("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "GNU Lesser General Public License", "3") + _gnu("program", "GNU Lesser General Public License", "3")[1:],
    "AGPL-3.0": _gnu("program", "GNU Affero General Public License", "3"),
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", " ".join(_SIMPLE_BSD), " ".join([_BSD, *_SIMPLE_BSD]), " ".join([_BSD, *_SIMPLE_BSD, _BSD_END])],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _ENDORSE, " ".join([*_SIMPLE_BSD, _ENDORSE]), " ".join([_BSD, *_SIMPLE_BSD, _ENDORSE]), " ".join([_BSD, *_SIMPLE_BSD, _ENDORSE, _BSD_END])],
    "ISC": [_ISC, f"{_ISC} {_ISC_END}"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_END}"],
    **{name: [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License."] for name, (short, long) in _CREATIVE.items()},
}


def _bigrams(words):
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _units(text):
    """A text's lines, its paragraphs and itself, lower-cased, of a-z, 0-9, spaces and line feeds."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9 \n]+", " ")
    return F.array_distinct(F.concat(F.split(plain, "\n"), F.split(plain, "\n *\n"), F.array(plain)))


def telling_words(templates: dict[str, list[str]], percent: int) -> list[tuple[str, ...]]:
    """Groups of words; every text with a unit that can match some template holds all words of a group.

    A match may lack m - percent * m / (200 - percent) of a template's m bigrams at most. For each
    template words are taken, long ones first, until a text without any of them lacks more than that;
    where it lacks just so many, it must hold all the words that are left.
    """
    out: set[tuple[str, ...]] = set()
    for t in sorted((t for texts in templates.values() for t in texts), key=len):
        words = re.findall("[a-z0-9]+", t.lower())
        left = list(zip(words, words[1:], strict=False))
        slack = len(left) - -(-percent * len(left) // (200 - percent))
        while slack >= 0 and left:
            rest = {word for pair in left for word in pair}
            word = min(rest, key=lambda x: ((x,) not in out or len(x) < 5, -min(len(x), 8), x))
            if len(word) < 5 and slack == 0:
                out.add(tuple(sorted(rest)))
                break
            out.add((word,))
            slack -= sum(word in pair for pair in left)
            left = [pair for pair in left if word not in pair]
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, *, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, license, dice) of the licences that a line, a paragraph or the whole of each text states.

    Each unit states the licence of the template with the greatest Dice coefficient of the bags of word
    bigrams of both, of equal ones the first by name, if it is percent hundredths or more; dice is the
    greatest of a licence's units. Words are runs of a-z and 0-9 after
    lower-casing. Texts without any of the words that a match must hold, then units whose number of bigrams
    no template can reach at that coefficient, are passed over before bigrams are made, and pairs with
    such sizes before they are counted. Units of fewer than two
    words, null and empty texts match nothing. Rows with the same key are one document; a null key is one
    too. Several licences are several rows. Other columns are not looked at; an empty table or no
    templates give no rows. The templates are sent to the tasks: they are fixed, not grown from the data.
    """
    spark = docs.sparkSession
    flat = [(i, name, t) for i, (name, t) in enumerate((n, t) for n, texts in sorted(templates.items()) for t in texts)]
    known = spark.createDataFrame(flat, "template int, license string, t string")
    known = known.withColumn("w", F.filter(F.split(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " "), " "), lambda x: x != ""))
    known = known.select("template", "license", _bigrams(F.col("w")).alias("g")).withColumn("m", F.size("g"))
    sizes = [r.m for r in known.select("m").collect()] or [0]
    low, high = min(sizes) * percent / (200 - percent), max(sizes) * (200 - percent) / percent
    index = known.select("template", "license", "m", F.explode("g").alias("gram")).groupBy("template", "license", "m", "gram").agg(F.count("*").alias("times"))

    words_of = lambda unit: F.filter(F.split(F.translate(unit, "\n", " "), " "), lambda x: x != "")
    low_text = F.lower(F.col(text))
    telling = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low_text, F.lit(x)) for x in group]) for group in telling_words(templates, percent)], F.lit(False))
    words = docs.where(telling).select(F.col(key), F.explode(F.transform(_units(F.col(text)), words_of)).alias("w"))
    sized = words.where(F.size("w").between(F.lit(max(2.0, low + 1)), F.lit(high + 1)))
    grams = sized.select(key, F.monotonically_increasing_id().alias("u"), (F.size("w") - 1).alias("n"), _bigrams(F.col("w")).alias("g"))
    hits = grams.select(key, "u", "n", F.explode("g").alias("gram")).join(F.broadcast(index), "gram")
    fits = (percent * F.greatest("n", "m")) <= ((200 - percent) * F.least("n", "m"))
    unit = ["u", "template", "license", "n", "m"]
    both = hits.where(fits).groupBy(key, *unit, "gram", "times").agg(F.count("*").alias("here"))
    both = both.groupBy(key, *unit).agg(F.sum(F.least("here", "times")).alias("both"))
    matched = both.where(200 * F.col("both") >= percent * (F.col("n") + F.col("m")))
    dice = 2 * F.col("both") / (F.col("n") + F.col("m"))
    best = matched.groupBy(key, "u").agg(F.min(F.struct((-dice).alias("low"), "license")).alias("best"))
    return best.groupBy(key, F.col("best.license").alias("license")).agg(F.max(F.round(-F.col("best.low"), 6)).alias("dice"))


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same over documents in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    flat = [(name, t) for name, texts in sorted(templates.items()) for t in texts]
    values = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(flat))
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with templates(template, license, t) as (values {values}),
known as (select template, license, {grams} g from (select template, license, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') w from templates)),
plain as (select doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') p from documents),
units as (select distinct doc_id, unnest(list_concat(list_concat(string_split(p, chr(10)), regexp_split_to_array(p, '\\n *\\n')), [p])) u from plain),
words as (select doc_id, u, list_filter(regexp_split_to_array(u, '[ \\n]+'), lambda x: x <> '') w from units),
grams as (select doc_id, u, {grams} g from words where len(w) >= 2),
here as (select doc_id, u, n, gram, count(*) here from (select doc_id, u, len(g) n, unnest(g) gram from grams) group by all),
there as (select template, license, m, gram, count(*) times from (select template, license, len(g) m, unnest(g) gram from known) group by all),
hits as (select doc_id, u, template, license, n, m, sum(least(here, times)) c from here join there using (gram) group by all),
best as (select doc_id, u, license, 2 * c / (n + m) dice, row_number() over (partition by doc_id, u order by 2 * c / (n + m) desc, license) place from hits where 200 * c >= {percent} * (n + m))
select doc_id, license, max(round(dice, 6)) dice from best where place = 1 group by doc_id, license"""
