"""License scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance along paths.

1. A file's header units are its lines, sentences, paragraphs and blocks with a
   licence word, wherever they stand, and the whole text of what looks like a
   licence file.  A block ends at a blank line, or where comments begin or end; a
   paragraph at an empty comment line too.
2. Units and templates are sparse TF-IDF vectors of their words, with document
   frequencies over all units and templates.  Lines and sentences are held against
   statements, the others against notices and full texts; a unit has the licence
   of the template with the greatest cosine, if that is LEAST or LEAST_LONG or more.
   An SPDX identifier or expression is taken as it is declared, with all its names.
3. A file's own licence is that of its best unit.  A file whose words are to
   MOSTLY per cent in licence units of one kind, or whose name says so, is a
   licence file of its directory.
4. A file without a licence inherits that of its nearest ancestor directory which
   has a licence file, found by joining its ancestors to the directories.

Defined cases: null and empty texts have no header; a null path is a file without
a directory; equal cosines go to lines before longer units, then to the first unit and template by name;
of several licence files in a directory the best match counts, then the first
path; repeated rows are judged alike.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.text import WORD, require
from kelpline.plans.checkpoints import checkpointed

#: Licence statements by SPDX name.  Fixed values.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 OR MIT", "Dual-licensed under the Apache License, Version 2.0 or the MIT License, at your option."),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0 OR MIT", "Dual licensed under the MIT and GPL licenses."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain, Unlicense."),
)

GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
GNU_ONLY = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License version {2} as published by the Free Software Foundation."
GNU_MORE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details. You should have received a copy of the GNU {1} Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_MORE = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
NOTICE = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
GNU_KINDS = (("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3"))
#: Notices and full texts by SPDX name, besides those in licence_texts.  Fixed values.
NOTICES = (
    ("Apache-2.0", APACHE), ("Apache-2.0", APACHE + APACHE_MORE),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0" + APACHE[47:] + APACHE_MORE),
    ("BSD-2-Clause", BSD), ("BSD-2-Clause", BSD + BSD_AS_IS), ("BSD-3-Clause", BSD + BSD_NAMES), ("BSD-3-Clause", BSD + BSD_NAMES + BSD_AS_IS), ("ISC", ISC), ("ISC", ISC + ISC_AS_IS),
    ("MIT", GRANT), ("MIT", GRANT + NOTICE), ("MIT", "MIT License " + GRANT + NOTICE + AS_IS), ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE + " " + AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, text.format(*of)) for name, *of in GNU_KINDS for text in (GNU, GNU_ONLY, f"{GNU} {GNU_MORE}", f"{GNU_ONLY} {GNU_MORE}")),
)
FULL = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
NAMES = tuple(sorted({name for name, _ in TEMPLATES + NOTICES if " " not in name}))

#: Words that make a line, or a longer unit, a header.
KEYS = r"(?i)(licen[sc]e|licensed|copyright|creative commons|public domain|spdx|permission is hereby granted|redistribution and use|free software|general public)"
#: A declared identifier, an expression of several, what of a name is left out, and what is none.
SPDX_NAME, SPDX_ENDS, SPDX_NONE = r"[a-z0-9][a-z0-9.+-]*", r"(?i)(-only|-or-later|\+)$", r"(?i)^(none|noassertion)?$"
SPDX = rf"(?i)spdx-license-identifier:?[ \t]*(\(*{SPDX_NAME}(?:[ \t)]+(?-i:AND|OR|WITH)[ \t(]+{SPDX_NAME})*)"
#: What comment lines begin with.
MARK = r"[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)"
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: Cosine that a line needs, and words of a licence file in licence units, in per cent.
LEAST, MOSTLY = 0.6, 20
#: Cosine that paragraphs, blocks and whole texts need: their common words make any two alike.
LEAST_LONG = 0.8
#: Terms of templates, and those that one unit in so many has, are sent to the units with their weights: at most so many times a unit's
#: mean number of terms, however many units there are.  To the weights of others only the terms of units that may match are shuffled.
RARE = 300
#: Kinds of units; the first two are short.
LINE, SENTENCE, PARAGRAPH, BLOCK, WHOLE = range(5)
NAMED = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"


def header_units(files: DataFrame) -> DataFrame:
    """(path, text_id, scope, line_no, line) of (path, text): each text's units with a licence word, numbered by kind."""
    # Repeated rows are left out before texts are cut, so that each text is shuffled once, not all its units.
    texts = files.where(F.col("text").rlike(KEYS)).withColumn("text_id", F.xxhash64("path", "text")).repartition("text_id").dropDuplicates(["text_id"])
    texts = texts.select("path", "text_id", F.regexp_replace("text", "\r", "").alias("text"))
    # Blank lines where comments end and begin.
    cut = F.regexp_replace(F.regexp_replace("text", rf"(?m)^({MARK}[^\n]*)\n(?!{MARK})", "$1\n\n"), rf"(?m)^(?!{MARK})([^\n]+)\n(?={MARK})", "$1\n\n")
    texts = texts.withColumn("cut", cut).withColumns({"blocks": F.split("cut", r"\n(?:[ \t]*\n)+"), "paragraphs": F.split("cut", rf"\n(?:(?:{MARK})?[ \t]*\n)+")})
    joined = F.transform("paragraphs", lambda p: F.regexp_replace(p, rf"\n(?:{MARK})?[ \t]*", " "))
    sentences = F.flatten(F.transform(joined, lambda p: F.split(p, r"(?<=[.!?;])[ \t]+")))
    keyed = lambda scope, c: F.filter(F.transform(c, lambda x, i: F.struct(F.lit(scope).alias("scope"), i.cast("int").alias("line_no"), x.alias("line"))), lambda u: u["line"].rlike(KEYS))
    texts = texts.withColumns({"long": keyed(PARAGRAPH, F.col("paragraphs")), "lines": keyed(LINE, F.split("text", "\n"))})
    mostly = F.aggregate("long", F.lit(0).cast("long"), lambda n, u: n + F.length(u["line"])) * 100 >= F.length("text") * MOSTLY
    whole = F.when(mostly | F.coalesce(F.col("path").rlike(NAMED), F.lit(False)), keyed(WHOLE, F.array("text"))).otherwise(keyed(WHOLE, F.array().cast("array<string>")))
    units = F.concat("lines", keyed(SENTENCE, sentences), "long", keyed(BLOCK, F.array_except("blocks", "paragraphs")), whole)
    return texts.select("path", "text_id", F.explode(units).alias("u")).select("path", "text_id", "u.*")


def _let(value: Column, of) -> Column:
    """``of(value)``, with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _terms(lines: DataFrame, *ids: str) -> DataFrame:
    """(ids..., term, tf) of each line, counted in its row: equal words are a run of the sorted ones."""

    def counted(words):
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(words))
        runs = _let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (end(at, k) - i).cast("long").alias("tf"))))
        return F.when(F.size(words) > 0, runs)

    words = F.array_sort(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))
    return lines.select(*ids, F.explode(_let(words, counted)).alias("run")).select(*ids, "run.term", "run.tf")


def given_templates(spark: SparkSession) -> DataFrame:
    """(template, name, short, line)"""
    folder = resources.files("kelpline.llm").joinpath("licence_texts")
    titled = [(name, f"License: {name}") for name in sorted({*NAMES, *(name for name, _ in TEMPLATES)})]
    full = [(name, folder.joinpath(f"{name}.txt").read_text(encoding="utf-8")) for name in FULL]
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [(name, True, text) for name, text in (*TEMPLATES, *titled)] + [(name, False, text) for name, text in (*NOTICES, *full)]
    values = ", ".join(f"({i}, {quoted(name)}, {str(short).lower()}, {quoted(text)})" for i, (name, short, text) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, name, short, line)")


def matches(units: DataFrame) -> DataFrame:
    """(text_id, scope, line_no, licence, cosine): the best template of each unit whose cosine is high enough."""
    given = given_templates(SparkSession.active())
    unit, template = ("text_id", "scope", "line_no"), ("template", "name", "short")
    mine, theirs = _terms(units, *unit), checkpointed(_terms(given, *template))
    # Counted by term over distinct units; combined before the shuffle.
    count = lambda t, c: t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max(c).alias("given"))
    df = count(mine, F.lit(False)).unionByName(count(theirs, F.lit(True))).groupBy("term").agg(F.sum("n").alias("df"), F.max("given").alias("given"))
    total = units.count() + theirs.select("template").distinct().count()
    weight = lambda df: F.log((F.lit(total) + 1.0) / (df + 1.0)) + 1.0
    idf = checkpointed(df.select("term", "given", (F.col("given") | (F.col("df") * RARE >= total)).alias("sent"), weight(F.col("df")).alias("idf")))
    sent = F.broadcast(idf.where("sent").select("term", "given", "idf"))
    square, need = F.col("w") * F.col("w"), F.when(F.col("scope") <= SENTENCE, LEAST).otherwise(LEAST_LONG)
    b = theirs.join(sent, "term").select(*template, "term", (F.col("tf") * F.col("idf")).alias("w"))
    b = checkpointed(b.join(b.groupBy("template").agg(F.sqrt(F.sum(square)).alias("nb")), "template"))
    # A cosine is at most the part of a unit's length that lies in terms of templates: other units are left out, first those that are
    # too long even if all their rare terms weigh as little as a rare term can, of which no term is shuffled.
    weighed = lambda t: _terms(t, *unit).join(sent, "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
    part = F.sqrt(F.sum(F.when(F.col("given"), square))).alias("part")
    lightest = F.coalesce("w", F.col("tf") * weight(F.lit(total / RARE)))
    bound = weighed(units).groupBy(*unit).agg(F.sqrt(F.sum(lightest * lightest)).alias("na"), part)
    far_enough = F.col("part") >= F.col("na") * (need - 1e-5)
    a = weighed(units.join(bound.where(far_enough).select(*unit), [*unit], "left_semi"))
    rare = a.where("idf is null").select(*unit, "term", "tf").join(idf.where("not sent").select("term", "idf"), "term")
    rare = rare.withColumn("w", F.col("tf") * F.col("idf")).groupBy(*unit).agg(F.sum(square).alias("rest"))
    a = a.where("idf is not null").groupBy(*unit).agg(F.sum(square).alias("most"), part, F.collect_list(F.when(F.col("given"), F.struct("term", "w"))).alias("terms"))
    a = a.join(rare, [*unit], "left").withColumn("na", F.sqrt(F.col("most") + F.coalesce("rest", F.lit(0.0))))
    a = a.where(far_enough).select(*unit, "na", (F.col("scope") <= SENTENCE).alias("short"), F.explode("terms").alias("t")).select(*unit, "na", "short", "t.*")
    # Templates are a fixed list of some thousands of terms.
    dots = a.join(F.broadcast(b.select(*template, "nb", "term", F.col("w").alias("v"))), ["short", "term"]).groupBy(*unit, "template", "name", "na", "nb").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.select(*unit, "name", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))
    enough = F.col("cosine") >= need
    best = scored.where(enough).groupBy(*unit).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("b"))
    return best.select(*unit, F.col("b.name").alias("licence"), (-F.col("b.c")).alias("cosine"))


def declared(line) -> Column:
    """The SPDX expression that a line declares, or null: its names and operators in their order, without brackets."""
    known = F.create_map(*[F.lit(x) for n in NAMES for x in (n.lower(), n)])

    def one(x):
        name = F.regexp_replace(x, SPDX_ENDS, "")
        return F.when(x.isin("AND", "OR", "WITH"), x).otherwise(F.coalesce(F.element_at(known, F.lower(name)), name))

    names = F.regexp_extract_all(F.regexp_extract(line, SPDX, 1), F.lit("(?i)" + SPDX_NAME), F.lit(0))
    said = F.array_join(F.transform(names, one), " ")
    return F.when(~said.rlike(SPDX_NONE), said)


def scan(df: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., path, own_licence, cosine, is_licence_file, licence, origin) for each row; origin is header, directory or
    none.  ``licence`` is the own or inherited one.

    Runs jobs while it is called: header units, and files without their texts, are kept in the shared checkpoint folder.
    """
    require(df, path_col, text_col, *keep)
    src = df.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n = lambda c: F.regexp_count(c, F.lit(WORD))
    spdx = F.when(F.col("scope") == LINE, declared(F.col("line")))
    units = checkpointed(header_units(src.select("path", "text")).withColumns({"spdx": spdx, "words": n("line")}))
    # Units' words are counted before, so that no unit's text is shuffled to its match.
    found = units.drop("line").join(matches(units.select("text_id", "scope", "line_no", "line")), ["text_id", "scope", "line_no"], "left")
    found = found.withColumns({"licence": F.coalesce("spdx", "licence"), "cosine": F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.col("cosine"))}).where("licence is not null")
    own = found.groupBy("text_id", "scope").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("scope"), F.col("line_no"), F.col("licence"))).alias("b"), F.sum("words").alias("licence_words"))
    own = own.groupBy("text_id").agg(F.min("b").alias("b"), F.max("licence_words").alias("licence_words"))
    files = src.select("*", F.xxhash64("path", "text").alias("id"), n(F.coalesce("text", F.lit(""))).alias("n_words")).drop("text")
    files = files.join(own, F.col("id") == F.col("text_id"), "left").withColumns({"own_licence": F.col("b.licence"), "cosine": -F.col("b.c")})
    is_file = F.col("own_licence").isNotNull() & (F.coalesce(F.col("path").rlike(NAMED), F.lit(False)) | (F.col("licence_words") * 100 >= F.col("n_words") * MOSTLY))
    files = checkpointed(files.withColumn("is_licence_file", is_file).drop("b", "text_id", "id", "n_words", "licence_words"))
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licensed = files.where("is_licence_file and path is not null").groupBy(parent.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("own_licence").alias("licence"))).alias("d"))
    licensed = licensed.select("dir", F.col("d.licence").alias("dir_licence"))
    # Each open file's ancestors, as many as its path is deep.
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    open_files = files.where("own_licence is null and path is not null").select("path").distinct()
    ancestors = open_files.select("path", F.explode(ups).alias("u")).select("path", "u.*")
    nearest = ancestors.join(licensed, "dir").groupBy("path").agg(F.max_by("dir_licence", "depth").alias("inherited"))
    out = files.join(nearest.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "left")
    licence = F.coalesce("own_licence", "inherited")
    origin = F.when(F.col("own_licence").isNotNull(), "header").when(F.col("inherited").isNotNull(), "directory").otherwise("none")
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "path", "own_licence", "cosine", "is_licence_file", licence.alias("licence"), origin.alias("origin"))
