"""Licences of files: TF-IDF against templates, then inheritance from directories (DataFrame operations only).

One pass over the texts keeps, of each file that names a licence at all, the
blocks of words around its cues; a licence file (by its name) is kept whole as
well. Where a block holds the words that a notice needs, a window of the notice's
length is cut so that the notice's rarest word falls where the notice has it:
notices inside lines, over several lines and beside each other each get windows of
their own, and a notice word for word scores 1; a window after "not" is none. Where a licence's own
text begins, a window of that text's length is cut as well, so that licences which share their first
sentences are told apart in source files too. Each identifier of an expression after "License:" is a
passage of its own. Passages and whole licence files are
sparse vectors of words weighted ``(1 + ln tf) * idf``, with idf over the templates (a
word that no template has gets the largest); equal ones are scored once, by
joining their words with the templates' postings. The best cosine of at least
``threshold`` names the file's licence, ties going to the first name; a file or window that
is close to a licence's own text (``CLOSE``) takes that licence whatever its parts say, and
"all rights reserved" names a licence only if nothing else does. ``licenses`` lists the best one and all others of
at least ``ALSO``, as files may offer a choice.

A file without a licence takes that of the nearest directory above it, or its
own, that holds a licence file: directories are listed once, each joined to its
ancestors by path, and files join their directory.

Edge cases: files are told apart by a number of their own, so null and repeated
ids are files like any other; null or empty texts have no licence of their own; a
null path has no directory and inherits nothing; extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

GNU = "{} under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
FREE = "This program is free software: you can redistribute it and/or modify it"
SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
#: Licence, notice (standard headers, titles, key clauses, SPDX ids), and the words that a window must hold to be tried.
NOTICES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3", "affero 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2.0"),
    ("Apache-2.0", "SPDX License Identifier Apache 2.0", "apache 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("BSD-3-Clause", "Released under the BSD License", "bsd"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "cc by 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY NC 4.0", "cc by nc 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY SA 4.0", "cc by sa 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0", "cc0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3", "lesser 3"),
    ("MIT", "Released under the MIT License", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission granted charge"),
    ("MIT", "SPDX License Identifier MIT", "spdx mit"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mozilla 2.0"),
    ("Proprietary", "All rights reserved", "all rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    *((name, f"SPDX License Identifier {name}", f"spdx {name}") for name in SPDX),
    ("AGPL-3.0", GNU.format(FREE, "Affero General", 3), "affero 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "affero 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd"),
    ("BSD-3-Clause", "Licensed under the BSD License", "bsd"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither contributors"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International", "commons attribution 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "commons noncommercial 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "commons sharealike 4.0"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal", "cc0"),
    ("GPL-2.0", GNU.format(FREE, "General", 2), "gnu 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "gnu 2"),
    ("GPL-3.0", GNU.format(FREE, "General", 3), "gnu 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "gnu 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee"),
    ("LGPL-2.1", GNU.format(FREE, "Lesser General", 2.1), "lesser 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "lesser 2.1"),
    ("LGPL-3.0", GNU.format(FREE, "Lesser General", 3), "lesser 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "lesser 3"),
    ("MIT", "Licensed under the MIT License", "mit"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mozilla 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla 2.0"),
    *((name, f"{verb} under the {short}", need) for verb in ("Available", "Licensed", "Distributed") for name, short, need in (
        ("MIT", "MIT license", "mit"), ("ISC", "ISC license", "isc license"), ("Apache-2.0", "Apache 2.0 license", "apache 2.0"), ("GPL-2.0", "GPLv2", "gplv2"), ("GPL-3.0", "GPLv3", "gplv3"),
        ("LGPL-2.1", "LGPLv2.1", "lgplv2.1"), ("LGPL-3.0", "LGPLv3", "lgplv3"), ("AGPL-3.0", "AGPLv3", "agplv3"), ("MPL-2.0", "MPL 2.0", "mpl 2.0"), ("Unlicense", "Unlicense", "unlicense"),
    )),
)
#: Identifiers of the SPDX list that expressions may name; -only and -or-later are the same licence here.
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear "
    "BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 "
    "ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IPL-1.0 ISC LGPL-2.0 LGPL-2.0-only "
    "LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP "
    "OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
EXPRESSION = r"(?i)licen[sc]e(?:-identifier)?[ \t]*:[ \t]*[\"']?([(]*[a-z0-9.+-]+(?:[ \t()]+(?:or|and|with)[ \t()]+[a-z0-9.+-]+)*)"
#: Words that turn a notice into its opposite, and how far before its anchor's place they do.
NEGATIONS, REACH = ("not", "never", "isn", "wasn", "aren", "nor"), 3
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: licences' own texts, for licence files. Others are compared by ``NOTICES`` alone, or by texts given as a parameter.
TEXTS = (
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {TWO} {AS_IS}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS}"),
    ("ISC", """ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""),
)
#: Words of a block, no fewer than the longest notice's.
BLOCK = 64
CUE_WORD = r"licen[sc]e|copyright|spdx|^(?:rights|reserved|domain|commons|hereby|redistribution)$"
CUE = r"(?i)licen[sc]e|copyright|spdx|rights reserved|public domain|creative commons|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|unlicense|copying|notice)(?:\.[a-z]+)?$"
THRESHOLD = 0.6
#: Cosine from which a whole licence file, or a window of a licence's own text, takes the licence of the text that it is near to; and from which a second licence is listed.
CLOSE, ALSO = 0.9, 0.8
#: Words with which the licences' own texts begin, after what may stand before them.
OPENINGS = ("redistribution and use in source", "permission to use copy modify", "permission is hereby granted free", "this is free and unencumbered")


def identifiers() -> tuple[tuple[str, str], ...]:
    """Licence and template of each SPDX identifier."""
    return tuple((i.removesuffix("-only").removesuffix("-or-later"), f"SPDX License Identifier {i}") for i in SPDX_IDS)


def openings(texts: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int]]:
    """(opening, words before it, length) of each text that has one."""
    out = []
    for _, text in texts:
        ws = words(text)
        out += [(o, k, len(ws)) for o in OPENINGS for k in range(len(ws)) if ws[k : k + len(o.split())] == o.split()][:1]
    return out


def words(text: str) -> list[str]:
    """The words of a template, as ``bare`` makes them of a passage."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in text).lower().split()
    return [w for w in (x.rstrip(".") for x in kept) if w]


def bare(text: Column) -> Column:
    """ASCII letters and digits in lower case, single spaces, dots only inside words."""
    one = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9.]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"\.+(?: |$)", " "), " +", " "))


@lru_cache(maxsize=4)
def template_vectors(texts: tuple[tuple[str, str], ...] = TEXTS) -> tuple[dict[str, float], list[tuple[str, int, str, float]], float]:
    """Idf of each word of the notices and texts, their postings (word, template, licence, weight in its unit-length vector), and the idf of any other word."""
    templates = [(name, words(text)) for name, text, *_ in (*NOTICES, *texts, *identifiers())]
    counts = [Counter(ws) for _, ws in templates]
    seen = Counter(w for c in counts for w in c)
    idf = {w: 1 + math.log((1 + len(templates)) / (1 + n)) for w, n in seen.items()}
    postings = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in weights.values()))
        postings += [(w, k, name, x / size) for w, x in weights.items()]
    return idf, postings, 1 + math.log(1 + len(templates))


def anchors() -> list[tuple[str, list[int], int, list[str]]]:
    """Of each notice the rarest of the words that it needs, its places, the notice's length, and the words."""
    split = [(words(text), words(need)) for _, text, need in NOTICES]
    rare = Counter(w for ws, _ in split for w in set(ws))
    out = []
    for ws, need in split:
        anchor = min(need, key=lambda w: (rare[w], w))
        out.append((anchor, [i for i, w in enumerate(ws) if w == anchor], len(ws), need))
    return out


def marked(files: DataFrame, id_col: str, path_col: str, text_col: str, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """``row``, ``id``, ``path``, ``blocks`` (words around cues, each with the stretches of ``BLOCK`` words beside it), ``whole`` (a licence file's words),
    ``longs`` (windows of the length of a licence's own text, from where it begins), ``named`` (passages of identifiers in expressions).

    At most three times the text of files with cues everywhere; null or empty for all others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    is_file = F.coalesce(F.col(path_col).rlike(LICENCE_FILE), F.lit(False))
    picked = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(path_col).alias("path"), is_file.alias("is_file"),
        F.when(text.rlike(CUE) | is_file, bare(text)).alias("bare"), F.when(text.rlike(CUE), F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1))).alias("expressions"),
    ).withColumn("ws", F.split("bare", " "))

    def long(opening: str, before: int, length: int) -> Column:
        first, *rest = opening.split()
        at = F.filter(F.transform("ws", lambda w, i: F.when((w == first) & (F.array_join(F.slice("ws", i + 2, F.lit(len(rest))), " ") == " ".join(rest)), i)), lambda i: i.isNotNull())
        cut = F.transform(at, lambda i: F.array_join(F.slice("ws", F.greatest(i - before, F.lit(0)) + 1, F.lit(length)), " "))
        return F.when(F.col("bare").contains(opening), F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))

    known = F.array(*[F.lit(i.lower()) for i in SPDX_IDS])
    ids = F.filter(F.flatten(F.transform("expressions", lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9.+-]+"), F.lit(0)))), lambda x: F.array_contains(known, x))
    named = F.array_distinct(F.transform(ids, lambda i: bare(F.concat(F.lit("SPDX License Identifier "), i))))
    longs = F.array_distinct(F.concat(*[long(*x) for x in openings(texts)])) if openings(texts) else F.array().cast("array<string>")
    cues = F.filter(F.transform("ws", lambda w, i: F.when(w.rlike(CUE_WORD), F.floor(i / BLOCK).cast("int"))), lambda x: x.isNotNull())
    cut = lambda b: F.array_join(F.slice("ws", F.greatest((b - 1) * BLOCK, F.lit(0)) + 1, F.when(b > 0, 3 * BLOCK).otherwise(2 * BLOCK)), " ")
    return picked.select("row", "id", "path", F.transform(F.array_distinct(cues), cut).alias("blocks"), F.when(F.col("is_file") & (F.col("bare") != ""), F.col("bare")).alias("whole"), longs.alias("longs"), named.alias("named"))


def windows(blocks: DataFrame) -> DataFrame:
    """``block_key``, ``passage``: windows of the distinct blocks (``block_key``, ``block``), one for each way to lay a notice's anchor on a word."""
    known = anchors()
    spark = blocks.sparkSession
    table = spark.createDataFrame(known, "word string, offsets array<int>, length int, need array<string>")  # some seventy rows
    listed = F.array(*map(F.lit, sorted({a for a, *_ in known})))
    once = blocks.groupBy("block_key").agg(F.first("block").alias("block")).select("block_key", F.split("block", " ").alias("ws"))
    places = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(listed, x["word"]))
    laid = once.select("block_key", "ws", F.explode(places).alias("x")).select("block_key", "ws", "x.at", "x.word").join(F.broadcast(table), "word")
    laid = laid.select("block_key", "ws", "length", "need", "at", F.explode("offsets").alias("offset"))
    start = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
    denied = F.slice("ws", F.greatest(start - REACH, F.lit(0)) + 1, F.col("at") - F.greatest(start - REACH, F.lit(0)))
    cut = laid.where(~F.arrays_overlap(denied, F.array(*map(F.lit, NEGATIONS)))).select("block_key", "need", F.slice("ws", start + 1, F.col("length")).alias("w"))
    return cut.where(F.size(F.array_except("need", "w")) == 0).select("block_key", F.array_join("w", " ").alias("passage")).distinct()


def scored(passages: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``license``, ``score`` of distinct ``passage``s that reach the threshold; words travel with the key only."""
    idf, postings, unseen = template_vectors(texts)
    spark = passages.sparkSession
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))  # the templates' words
    posted = F.broadcast(spark.createDataFrame(postings, "word string, k int, license string, weight double"))
    once = passages.groupBy("key").agg(F.first("passage").alias("passage"))
    terms = once.select("key", F.explode(F.split("passage", " ")).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
    terms = terms.join(weights, "word", "left").select("key", "word", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen))).alias("w"))
    terms = staged(terms, "license-terms")
    sizes = terms.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = terms.join(posted, "word").groupBy("key", "k", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    both = dots.join(sizes, "key").select("key", F.struct((-F.round(F.col("dot") / F.col("size"), 6)).alias("minus"), "license").alias("rank"))
    best = both.groupBy("key").agg(F.min("rank").alias("best"))
    return best.select("key", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score")).where(F.col("score") >= threshold)


def _rank(close: Column | None = None) -> Column:
    """What sorts the best licence first."""
    first = F.lit(1) if close is None else F.when(close, 0).otherwise(1)
    return F.struct(first.alias("first"), (F.col("license") == "Proprietary").alias("last"), (-F.col("score")).alias("minus"), "license")


def scan(
    files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, texts: tuple[tuple[str, str], ...] = TEXTS
) -> DataFrame:
    """``id``, ``path``, ``license``, ``score``, ``origin`` (own, inherited or null), ``of`` (the directory inherited from), ``licenses`` (of its own, by name)."""
    rows = staged(marked(files, id_col, path_col, text_col, texts), "license-rows")
    around = rows.select("row", F.explode("blocks").alias("block")).select("row", "block", F.sha2("block", 256).alias("block_key"))
    cut = windows(around).select(F.col("block_key").alias("of"), "passage")
    cut = staged(cut.withColumn("key", F.sha2("passage", 256)), "license-windows")
    # whole files and windows of whole texts may be close to one; passages of identifiers are as windows
    whole = rows.select("row", F.explode(F.concat(F.filter(F.array("whole"), lambda x: x.isNotNull()), "longs")).alias("passage")).withColumn("may", F.lit(True))
    whole = whole.unionByName(rows.select("row", F.explode("named").alias("passage")).withColumn("may", F.lit(False))).withColumn("key", F.sha2("passage", 256))
    named = staged(scored(cut.select("key", "passage").unionByName(whole.select("key", "passage")), texts, threshold), "license-scores")
    # a block's best licences, one row each: there are no more than licences
    of_block = cut.select("of", "key").join(named, "key").groupBy("of", "license").agg(F.min(_rank()).alias("rank"))
    found = around.select("row", F.col("block_key").alias("of")).join(of_block, "of").select("row", "license", "rank")
    found = found.unionByName(whole.select("row", "key", "may").join(named, "key").select("row", "license", _rank(F.col("may") & (F.col("score") >= CLOSE)).alias("rank")))
    per_licence = found.groupBy("row", "license").agg(F.min("rank").alias("rank"))
    second = F.when((-F.col("rank.minus") >= ALSO) & (F.col("license") != "Proprietary"), F.col("license"))
    best = per_licence.groupBy("row").agg(F.min("rank").alias("best"), F.collect_set(second).alias("more"))
    close = F.col("best.first") == 0  # a whole text names its licence alone
    listed = F.array_sort(F.when(close, F.array("best.license")).otherwise(F.array_union("more", F.array("best.license"))))
    own = staged(best.select("row", F.col("best.license").alias("own"), (-F.col("best.minus")).alias("own_score"), listed.alias("licenses")), "license-own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    placed = rows.select("row", "id", "path", F.when(F.col("path").isNotNull(), folder).alias("folder"))
    # as the licence files have licences of their own, they are few
    of_folder = placed.where(F.col("path").rlike(LICENCE_FILE)).join(own, "row").groupBy("folder")
    of_folder = of_folder.agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own").alias("license"))).alias("best"))
    of_folder = of_folder.select(F.col("folder").alias("above"), F.col("best.license").alias("given"), (-F.col("best.minus")).alias("given_score"))
    folders = placed.select("folder").where("folder IS NOT NULL").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = above.select("folder", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = above.join(of_folder, "above").groupBy("folder").agg(F.max_by(F.struct("above", "given", "given_score"), "depth").alias("near"))
    out = placed.join(own, "row", "left").join(nearest, "folder", "left")
    return out.select(
        "id", "path", F.coalesce("own", "near.given").alias("license"), F.coalesce("own_score", "near.given_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.above")).alias("of"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``path``, ``text``: documents laid out as a tree of files.

    ``source/thousands/hundreds/doc_id.txt``; a document whose first line is a
    licence notice takes the place of its folder's licence file.
    """
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0)
    name = F.when(first.rlike(CUE), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), (F.floor(F.col("doc_id") / 100) % 10).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def oracle() -> str:
    """DuckDB SQL for ``scan`` of ``documents_as_files``; documents are told apart by row number."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)}, {quoted(rest[0]) if rest else 'NULL'})" for k, (name, text, *rest) in enumerate((*NOTICES, *TEXTS, *identifiers())))
    opened = ", ".join(f"({[*o.split()]}, {k}, {n})" for o, k, n in openings(TEXTS))
    laid = ", ".join(f"({k}, {quoted(anchor)})" for k, (anchor, *_) in enumerate(anchors()))
    n = len(NOTICES) + len(TEXTS) + len(identifiers())
    bare_sql = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9.]+', ' ', 'g')), '\.+( |$)', ' ', 'g'), ' +', ' ', 'g'))"
    folder = "concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 % 10 AS VARCHAR))"
    return f"""
    WITH RECURSIVE templates(k, license, notice, need) AS (VALUES {rows}),
    laid(k, anchor) AS (VALUES {laid}),
    tws AS (SELECT k, license, need, string_split({bare_sql.format('notice')}, ' ') AS ws FROM templates),
    tt AS (SELECT k, license, word, count(*) AS tf FROM (SELECT k, license, unnest(ws) AS word FROM tws) GROUP BY ALL),
    idf AS (SELECT word, 1 + ln((1.0 + {n}) / (1 + count(DISTINCT k))) AS idf FROM tt GROUP BY word),
    tw AS (SELECT k, license, word, (1 + ln(tf)) * idf AS w FROM tt JOIN idf USING (word)),
    tn AS (SELECT k, sqrt(sum(w * w)) AS size FROM tw GROUP BY k),
    tried AS (SELECT anchor, unnest(list_filter(generate_series(1, len(ws)), lambda i: ws[i] = anchor)) AS shift, len(ws) AS length,
              string_split({bare_sql.format('need')}, ' ') AS need FROM tws JOIN laid USING (k)),
    files AS (SELECT row_number() OVER () AS r, doc_id, {folder} AS folder, coalesce(text, '') AS text,
              regexp_matches(regexp_extract(coalesce(text, ''), '^[^\\n]*'), '{CUE}') AS is_file FROM documents),
    opened(words, before, length) AS (VALUES {opened}),
    ids AS (SELECT DISTINCT r, {bare_sql.format("'SPDX License Identifier ' || id")} AS passage FROM (
            SELECT r, unnest(regexp_extract_all(lower(x), '[a-z0-9.+-]+')) AS id FROM (SELECT r, unnest(regexp_extract_all(text, '{EXPRESSION.replace("'", "''")}', 1)) AS x FROM files WHERE regexp_matches(text, '{CUE}')))
            WHERE id IN ({', '.join(quoted(i.lower()) for i in SPDX_IDS)})),
    cued AS (SELECT r, is_file, {bare_sql.format('text')} AS bare FROM files WHERE is_file OR regexp_matches(text, '{CUE}')),
    ws AS (SELECT r, string_split(bare, ' ') AS ws FROM cued),
    near AS (SELECT DISTINCT r, (i - 1) // {BLOCK} AS b FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws) WHERE regexp_matches(w, '{CUE_WORD}')),
    block AS (SELECT r, b, ws[greatest(b - 1, 0) * {BLOCK} + 1 : (b + 2) * {BLOCK}] AS ws FROM near JOIN ws USING (r)),
    hit AS (SELECT r, ws, unnest(ws) AS anchor, generate_subscripts(ws, 1) AS pos FROM block),
    cut AS (SELECT r, ws[greatest(pos - shift, 0) + 1 : greatest(pos - shift, 0) + length] AS w, need FROM hit JOIN tried USING (anchor)
            WHERE NOT list_has_any(ws[greatest(greatest(pos - shift, 0) - {REACH}, 0) + 1 : pos - 1], {[*NEGATIONS]})),
    long AS (SELECT DISTINCT r, array_to_string(ws[greatest(pos - 1 - before, 0) + 1 : greatest(pos - 1 - before, 0) + length], ' ') AS passage
             FROM (SELECT r, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM ws) JOIN opened ON w = words[1] AND ws[pos : pos + len(words) - 1] = words),
    found AS (SELECT DISTINCT r, array_to_string(w, ' ') AS passage, false AS whole FROM cut WHERE list_has_all(w, need)
              UNION ALL SELECT r, bare, true FROM cued WHERE is_file AND bare <> '' UNION ALL SELECT r, passage, true FROM long UNION ALL SELECT r, passage, false FROM ids),
    pt AS (SELECT passage, word, count(*) AS tf FROM
           (SELECT passage, unnest(string_split(passage, ' ')) AS word FROM (SELECT DISTINCT passage FROM found)) GROUP BY ALL),
    pw AS (SELECT passage, word, (1 + ln(tf)) * coalesce(idf, 1 + ln(1.0 + {n})) AS w FROM pt LEFT JOIN idf USING (word)),
    pn AS (SELECT passage, sqrt(sum(w * w)) AS size FROM pw GROUP BY passage),
    cosine AS (SELECT pw.passage, tw.license, round(sum(pw.w * tw.w) / any_value(pn.size) / any_value(tn.size), 6) AS score
               FROM pw JOIN tw USING (word) JOIN pn ON pn.passage = pw.passage JOIN tn ON tn.k = tw.k GROUP BY pw.passage, tw.k, tw.license),
    named AS (SELECT passage, arg_min(license, (-score, license)) AS license, max(score) AS score FROM cosine WHERE score >= {THRESHOLD} GROUP BY passage),
    ranked AS (SELECT r, license, score, whole AND score >= {CLOSE} AS close, row_number() OVER (PARTITION BY r ORDER BY CASE WHEN whole AND score >= {CLOSE} THEN 0 ELSE 1 END,
               license = 'Proprietary', score DESC, license) AS place FROM found JOIN named USING (passage)),
    own AS (SELECT r, max(license) FILTER (WHERE place = 1) AS own, max(score) FILTER (WHERE place = 1) AS own_score,
            array_to_string(list_sort(list_distinct(list(license) FILTER (WHERE place = 1 OR (score >= {ALSO} AND license <> 'Proprietary' AND NOT first_close)))), ',') AS licenses
            FROM (SELECT *, bool_or(close) OVER (PARTITION BY r) AS first_close FROM ranked) GROUP BY r),
    given AS (SELECT folder, arg_min(own, (-own_score, own)) AS given, max(own_score) AS given_score
              FROM files JOIN own USING (r) WHERE is_file GROUP BY folder),
    up AS (SELECT DISTINCT folder, folder AS above, 0 AS steps FROM files
           UNION ALL
           SELECT folder, CASE WHEN contains(above, '/') THEN regexp_replace(above, '/[^/]*$', '') ELSE '' END, steps + 1 FROM up WHERE above <> ''),
    closest AS (SELECT up.folder, arg_min(above, steps) AS above, arg_min(given, steps) AS given, arg_min(given_score, steps) AS given_score
             FROM up JOIN given ON given.folder = up.above GROUP BY up.folder)
    SELECT doc_id, coalesce(own, given) AS license, coalesce(own_score, given_score) AS score,
           CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS origin,
           CASE WHEN own IS NULL THEN closest.above END AS "of", coalesce(licenses, '') AS licenses
    FROM files LEFT JOIN own USING (r) LEFT JOIN closest USING (folder)"""
