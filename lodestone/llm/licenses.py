"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Passages are the lines of a text that hold a word without which no template can reach the threshold and their
sentences, the blocks of comment or text lines around them, up to an empty line and, of comments, up to the comment's
end; and, for files named like licence files, the whole text. Each is a sparse TF-IDF vector over
its words; document frequencies of the templates' words come from all documents, words outside the templates
weigh as much as the commonest of them. The template of highest cosine names the passage if it is at least
`threshold`. A file takes its best passage; one without takes the licence of the licence file in the nearest
directory above it, found by joining the directories of all paths, each once, with those above it.

Defined results: null and empty texts hold no passage but inherit; texts of any length are read whole. A null path has
no directory, so it inherits nothing. Ties of cosines go to the first template by name, ties of licence files in one
directory to the higher cosine, then the first path. Files without a licence give no row; repeated rows give equal rows.
An empty table gives an empty result. The result has its own columns only, whatever the names of others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import small, written

FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:[-.][^/]*)?$"
COMMENT = re.compile(r"^\s*(?://+|#+|\*+/?|/\*+|--+|;+|<!--|%+|\"\"\"|''')\s?|\s*(?:\*/|-->)\s*$")

_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
_MIT_REST = ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(what: str, name: str, version: str, stop: str) -> str:
    return f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version."


#: Titles, headers and grants of common licences; several for each. Licences of one family share most words, so each has
#: the texts in which they differ, and a text goes to the one it is most like.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        _gnu("This program", "Affero General Public License", "3", ","),
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "Artistic-2.0": ("The Artistic License 2.0", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"),
    "BSD-2-Clause": ("Licensed under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD, f"{_BSD} {_AS_IS}", "BSD 2-Clause License", "The Simplified BSD License"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the 3-Clause BSD License.",
        f"{_BSD} {_THIRD}",
        "SPDX-License-Identifier: BSD-3-Clause",
        f"{_BSD} {_THIRD} {_AS_IS}",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _THIRD,
    ),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _gnu("This program", "General Public License", "2", ";"),
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _gnu("This program", "General Public License", "3", ","),
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": ("Released under the ISC License.", _ISC, f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        _gnu("This library", "Lesser General Public License", "2.1", ";"),
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _gnu("This library", "Lesser General Public License", "3", ","),
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Licensed under the MIT license.",
        _MIT,
        "SPDX-License-Identifier: MIT",
        _MIT + _MIT_REST,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "SPDX-License-Identifier: Zlib",
        "Licensed under the zlib License.",
    ),
}
_WORD = re.compile(r"[^\W_]+")
#: Passages of fewer characters are remembered.
MEMO = 300


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passages(text: str, whole: bool, cue: frozenset[str]) -> list[str]:
    """The lines with a cue, the blocks of adjacent non-empty lines and the comments around them, and the whole text if
    asked."""
    out, block, hit = [], [], False
    comment, cued = [], False
    for line in [*text.split("\n"), ""]:
        bare = COMMENT.sub("", line).strip()
        if bare == line.strip():  # no comment
            if cued and len(comment) > 1:
                out.append(" ".join(comment))
            comment, cued = [], False
        elif bare:
            comment.append(bare)
            cued = cued or not cue.isdisjoint(words(bare))
        if bare:
            block.append(bare)
            if not cue.isdisjoint(words(bare)):
                hit = True
                out.append(bare)
                out += [s for s in re.split(r"(?<=[.!?])\s+", bare) if s != bare and not cue.isdisjoint(words(s))]
        else:
            if hit and len(block) > 1:
                out.append(" ".join(block))
            block, hit = [], False
    return [*dict.fromkeys(out), *([text] if whole and text.strip() else [])]


class Scanner:
    """The templates as unit vectors under the weights of words."""

    def __init__(self, idf: dict[str, float], templates: dict[str, tuple[str, ...]]):
        self.idf, self.floor = idf, min(idf.values(), default=1.0)
        self.rows = [(name, self.vector(words(t))) for name in sorted(templates) for t in templates[name]]
        self.by: dict[str, list[tuple[int, float]]] = {}
        for k, (_, v) in enumerate(self.rows):
            for word, x in v.items():
                self.by.setdefault(word, []).append((k, x))

    def vector(self, text: list[str]) -> dict[str, float]:
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.floor) for w, n in Counter(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    def cue(self, threshold: float) -> frozenset[str]:
        """Words of which every passage with a cosine of at least `threshold` holds one. A cosine is at most the root
        of the squared weights that the template has in shared words, so of each template the heaviest words are
        taken until the rest are too light to reach the threshold."""
        out: set[str] = set()
        for _, v in self.rows:
            rest = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if rest < max(threshold - 1e-5, 0) ** 2:
                    break
                out.add(w)
                rest -= v[w] ** 2
        return frozenset(out)

    def best(self, passage: str) -> tuple[float, str] | None:
        score: dict[int, float] = {}
        for w, x in self.vector(words(passage)).items():
            for k, y in self.by.get(w, ()):
                score[k] = score.get(k, 0) + x * y
        if not score:
            return None
        value, k = max((round(x, 6), -k) for k, x in score.items())
        return value, self.rows[-k][0]


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of rows and, for each word, of rows that hold it; over all rows and whole texts."""
    probe = K.Words(pa.array([" ".join(vocabulary)], pa.large_string()))
    order = np.argsort(probe.hash)
    hashes, names = probe.hash[order], [vocabulary[k] for k in order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            texts = K.strings(batch.column(0))
            total += len(texts)
            for lo, hi in K.chunks(texts):
                w = K.Words(texts[lo:hi])
                at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                hit = hashes[at] == w.hash
                seen += np.bincount(np.unique(w.doc[hit] * len(hashes) + at[hit]) % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([total, *seen])], ["word", "n"])

    rows = docs.select(docs[text].cast("string").alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word: r.n for r in rows}
    return got.get("", 0), {w: got.get(w, 0) for w in vocabulary}


def scanned(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, path, license, score, via, source_path): via is header, file or inherited."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for group in templates.values() for t in group for w in words(t)})
    n, df = frequencies(docs, vocabulary, text)
    held = docs.sparkSession.sparkContext.broadcast((({w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}), templates))  # the templates' words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, memo = Scanner(*held.value), {}
        cue = scanner.cue(threshold)
        any_cue = "(?i)(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, sorted(cue))) + ")(?:[^a-z0-9]|$)" if cue else "$^x"
        for batch in batches:
            texts = K.strings(batch.column(2))
            named = pc.fill_null(pc.match_substring_regex(batch.column(1), FILE), False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(pc.match_substring_regex(texts, any_cue).to_numpy(zero_copy_only=False) | named)
            name, score, file = [None] * len(texts), [None] * len(texts), [False] * len(texts)
            for r, t in zip(rows, texts.take(pa.array(rows)).to_pylist()):
                best = None
                for p in passages(t, bool(named[r]), cue):
                    got = memo.get(p) if len(p) < MEMO else None
                    if got is None:
                        got = scanner.best(p) or (0.0, "")
                        if len(p) < MEMO and len(memo) < 100_000:
                            memo[p] = got
                    if got[0] >= threshold and (best is None or (-got[0], got[1]) < (-best[0], best[1])):
                        best = got
                if best:
                    score[r], name[r], file[r] = best[0], best[1], bool(named[r])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(file)], ["doc_id", "path", "license", "score", "is_file"])

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("path", T.StringType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("is_file", T.BooleanType())])
    found = written(docs.select(docs[doc_id].alias("i"), docs[path].cast("string").alias("p"), docs[text].cast("string").alias("t")).mapInArrow(scan, schema))
    own = found.where("license is not null").select("doc_id", "path", "license", "score", F.when(F.col("is_file"), "file").otherwise("header").alias("via"), F.col("path").alias("source_path"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    first = Window.partitionBy("dir").orderBy(F.col("score").desc(), "path")
    roots = found.where("is_file and license is not null and path is not null").select(folder.alias("dir"), "license", "score", "path").withColumn("k", F.row_number().over(first)).where("k = 1").select("dir", F.col("license").alias("up"), F.col("score").alias("up_score"), F.col("path").alias("source_path"))
    bare = found.where("license is null and path is not null").select("doc_id", "path", folder.alias("dir"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = bare.select("dir").distinct().select(F.col("dir").alias("of"), F.explode(F.array_distinct(above)).alias("dir")).join(small(roots), "dir")
    dirs = dirs.groupBy("of").agg(F.max_by(F.struct("up", "up_score", "source_path"), F.length("dir")).alias("r")).select(F.col("of").alias("dir"), "r.*")
    near = bare.join(small(written(dirs)), "dir").select("doc_id", "path", F.col("up").alias("license"), F.col("up_score").alias("score"), F.lit("inherited").alias("via"), "source_path")
    return own.unionByName(near)
