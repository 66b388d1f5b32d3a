"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are the statements of every licence (titles and identifiers, bare and in frames such as "released
under the ... "), the notices that licences ask for in source files, and the texts of the short licences. The
passages of a file are its lines, their sentences, its paragraphs (comment marks taken off), its blocks between blank
lines and the file as a whole; each distinct passage is scored once against all templates, as sparse TF-IDF
vectors. Document frequencies are of the template terms, over all files. A title of the GNU family
without a version means any version, as these licences say. A file's own licence is that of its best passage of
at least MATCH.

What can't reach MATCH isn't scored, by two bounds that lose nothing: a passage must hold one of some template's
telling terms, those without which the rest of the template is too short; and its own terms that no
template has must not outweigh the others.

A licence file (named so, or one whose first line with a word declares a licence) speaks for its directory; a directory takes the licence that most of its licence files name; a file without a
licence of its own inherits from the nearest ancestor directory that has one, by joining directories with
their ancestors' paths: directories, not files, are expanded. All of it is native; a passage or a directory
that very many files share is aggregated before it moves.

Defined cases: a null or empty text has no passages and can only inherit; a null path lies in no
directory; of passages that tie the longest counts, then the alphabetically first licence; repeated rows come back each; a very long text is cut
into the same passages as any; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, stage, table

MATCH = 0.8
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)(\.[a-z]+)?$"
SENTENCE_END = r"(?<=[.;!?])\s+"
TERM = r"[a-z0-9.+-]*[a-z0-9+]"
#: What comment lines begin with.
COMMENT = r"(?m)^[\t ]*(?:(?:/?\*+|//+|#+|--+|;+|%+|<!--)(?=[\t\r ]|$))?[\t ]*"

#: Public licences by SPDX identifier, with the names that statements use.
LICENSES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal public domain dedication"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License, version 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "GPL-1.0-or-later": ["GNU General Public License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
#: Other titles, and the identifiers that say which later versions hold, where a licence has them.
TITLES = {"AGPL-3.0": ["GNU Affero General Public License"], "Apache-2.0": ["Apache License"], "MPL-2.0": ["Mozilla Public License"]}
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
FRAMES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "SPDX-License-Identifier: {}")
TITLE_FRAMES = ("{}", "License: {}")


#: Notices and short licence texts, as their publishers give them, in paragraphs.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
)
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details.",
    "You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>.",
)
_GNU_TITLE = "GNU {} Version {}, {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_KINDS = {
    "AGPL-3.0": ("program", "Affero General Public License", "3", "19 November 2007", "2007"),
    "GPL-2.0": ("program", "General Public License", "2", "June 1991", "1989, 1991"),
    "GPL-3.0": ("program", "General Public License", "3", "29 June 2007", "2007"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    "LGPL-3.0": ("library", "Lesser General Public License", "3", "29 June 2007", "2007"),
}
#: A text of several paragraphs is a template as a whole, and so is each paragraph that no other licence has.
TEXTS: dict[str, list[str]] = {
    "Apache-2.0": [" ".join(_APACHE), _APACHE[0], _APACHE[2], "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": [" ".join((*_BSD[:3], _BSD[4])), " ".join(_BSD[:3])],
    "BSD-3-Clause": [" ".join(_BSD), " ".join(_BSD[:4]), _BSD[3]],
    "BSL-1.0": [_BOOST, "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": [" ".join(_ISC), _ISC[0]],
    "MIT": [" ".join(_MIT), _MIT[0]],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": [" ".join(_ZLIB), _ZLIB[1]],
} | {
    name: [
        " ".join((_GNU[0].format(what, title, version), *(p.format(what, title) for p in _GNU[1:]))),
        _GNU[0].format(what, title, version),
        _GNU_TITLE.format(title, version, dated, years),
        f"GNU {title} Version {version}, {dated}",
    ]
    for name, (what, title, version, dated, years) in _GNU_KINDS.items()
}


def _statements() -> list[tuple[str, str]]:
    """(license, statement) of every form in every frame, and of all texts; an identifier alone is no statement."""
    out = []
    for name, forms in LICENSES.items():
        titles = [*forms, *TITLES.get(name, [])]
        ids = [name, *(f"{name}-{v}" for v in ("only", "or-later") if name in VERSIONED)]
        out += [(name, frame.format(t)) for t in titles for frame in (*FRAMES, *TITLE_FRAMES)]
        out += [(name, frame.format(i)) for i in ids for frame in (*FRAMES, TITLE_FRAMES[1], "{} License")]
        out += [(name, t) for t in TEXTS.get(name, [])]
    return list(dict.fromkeys(out))


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def templates() -> list[tuple[str, dict[str, int]]]:
    out = []
    for name, statement in _statements():
        counts: dict[str, int] = {}
        for t in terms(statement):
            counts[t] = counts.get(t, 0) + 1
        out.append((name, counts))
    return out


def vocabulary() -> list[str]:
    return sorted({t for _, counts in templates() for t in counts})


def term_frequencies(files: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each template term (one row a term)."""
    known = vocabulary()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))
    held = F.filter(F.transform(words, lambda w: F.rtrim(w, F.lit(".,;:!?\"'()"))), lambda w: w.isin(known))
    per_file = files.select(F.array_distinct(held).alias("held"))
    counts = per_file.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    return files.count(), {r["term"]: r["n"] for r in counts}


def weights(n_files: int, n_with: dict[str, int]) -> dict[str, float]:
    return {t: math.log((n_files + 1) / (n_with.get(t, 0) + 1)) + 1 for t in vocabulary()}


def telling(idf: dict[str, float], match: float = MATCH) -> list[str]:
    """Of each template the terms that fewest files hold, so many that the rest is shorter than `match` of it.

    The cosine to a passage without any of them is below `match`: it is no more than the rest's share of the length.
    """
    out: set[str] = set()
    for _, counts in templates():
        left = {t: (n * idf[t]) ** 2 for t, n in counts.items()}
        bound = (match - 1e-6) ** 2 * sum(left.values())
        for t in sorted(left, key=lambda t: (-round(idf[t], 9), -left[t], t)):
            if sum(left.values()) < bound:
                break
            out.add(t)
            del left[t]
    return sorted(out)


_total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
_tf = lambda ts, t: F.size(F.filter(ts, lambda x: x == t)).cast("double")
_terms = lambda text: F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _squared(known: Column, idf: dict[str, float]) -> Column:
    """The square of the length that a passage's terms of templates have."""
    weight = F.from_json(F.lit(json.dumps(idf)), "map<string,double>")
    return _total(F.transform(F.array_distinct(known), lambda t: F.pow(_tf(known, t) * F.element_at(weight, t), F.lit(2.0))))


def _within_reach(ts: Column, idf: dict[str, float], n_files: int, match: float) -> Column:
    """Whether terms that no template has leave room for a cosine of `match`: each adds its weight's square or more."""
    share = (match - 1e-6) ** 2
    rest = (math.log(n_files + 1) + 1) ** 2 * share
    known = F.filter(ts, lambda t: t.isin(sorted(idf)))
    return let(known, lambda ks: (F.size(ts) - F.size(ks)) * F.lit(rest) <= _squared(ks, idf) * F.lit(1 - share))


def _score(passage: Column, idf: dict[str, float], n_files: int) -> Column:
    """The best (cosine, license) of a passage, the alphabetically first of equals, and the number of its terms that templates have.

    Templates and weights enter as two constants of the plan.
    """
    unknown = math.log(n_files + 1) + 1  # a term of no template weighs as one that no file holds
    rows = []
    for name, counts in sorted(templates(), key=lambda x: x[0]):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows.append({"name": name, "terms": [{"term": t, "w": n * idf[t] ** 2 / length} for t, n in sorted(counts.items())]})
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,terms:array<struct<term:string,w:double>>>>")

    def best(ts: Column, ks: Column) -> Column:
        others = F.filter(ts, lambda t: ~t.isin(sorted(idf)))
        rest = let(others, lambda us: _total(F.transform(F.array_distinct(us), lambda t: F.pow(_tf(us, t) * F.lit(unknown), F.lit(2.0)))))
        dots = F.transform(known, lambda k: F.struct(_total(F.transform(k["terms"], lambda e: _tf(ks, e["term"]) * e["w"])).alias("dot"), k["name"].alias("name")))
        top = F.reduce(
            dots,
            F.struct(F.lit(-1.0).alias("dot"), F.lit("").alias("name")),
            lambda a, x: F.when(x["dot"] > a["dot"], F.struct(x["dot"].alias("dot"), x["name"].alias("name"))).otherwise(a),
        )
        norm = F.greatest(F.sqrt(_squared(ks, idf) + rest), F.lit(1e-9))
        return let(top, lambda x: F.struct((x["dot"] / norm).alias("cosine"), x["name"].alias("license"), F.size(ks).alias("terms")))

    return let(_terms(passage), lambda ts: let(F.filter(ts, lambda t: t.isin(sorted(idf))), lambda ks: best(ts, ks)))


def _passages(text: Column, near) -> Column:
    """Of a text in lower case: array of (first, line), passages that are `near` a template; first: what speaks for a directory if it matches."""
    of = lambda parts, first=F.lit(False): F.transform(parts, lambda x: F.struct(first.alias("first"), F.trim(x).alias("line")))
    plain = F.regexp_replace(text, COMMENT, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    parts = lambda line: F.concat(F.array(line), F.split(line, SENTENCE_END))
    in_lines = F.flatten(F.transform(lines, lambda line, i: of(parts(line), i == 0)))
    blocks = F.transform(F.split(text, r"\n[\t\r ]*\n"), lambda x: F.regexp_replace(x, COMMENT, ""))
    wider = F.concat(F.split(plain, r"\n[\t\r ]*\n"), blocks, F.array(plain))
    return F.filter(F.array_distinct(F.concat(in_lines, of(wider))), lambda p: near(p["line"]))


def scan(files: DataFrame, path: str = "path", text: str = "text", match: float = MATCH) -> DataFrame:
    """`files`' rows (all columns but the text) with `own`, `cosine`, `license`, `from_dir` and `how` (own, inherited or none)."""
    n_files, n_with = term_frequencies(files, text)
    idf = weights(n_files, n_with)
    keep = [c for c in files.columns if c != text]
    lowered = files.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_file"), F.col(path).alias("_path"), F.lower(text).alias("_text"))
    tells = telling(idf, match)
    held = lambda ts: F.exists(ts, lambda t: t.isin(tells))
    near = lambda line: let(_terms(line), lambda ts: held(ts) & _within_reach(ts, idf, n_files, match))
    numbered = lowered.withColumn("_passages", F.when(held(_terms(F.col("_text"))), _passages(F.col("_text"), near)))
    rows = stage(numbered.select("_row", "_file", "_path", "_passages"), "license-files")
    seen = rows.select("_row", F.explode("_passages").alias("p")).select("_row", "p.first", "p.line")
    scored = seen.groupBy("line").agg(F.lit(1).alias("_")).select("line", _score(F.col("line"), idf, n_files).alias("s"))
    hits = seen.join(scored.where(F.col("s.cosine") >= match), "line")
    best = hits.groupBy("_row").agg(
        F.min(F.struct((-F.round("s.cosine", 9)).alias("least"), (-F.col("s.terms")).alias("short"), F.col("s.license").alias("license"))).alias("b"),
        F.bool_or("first").alias("_declares"),
    )
    own = rows.join(best, "_row", "left").select(
        "_file",
        F.regexp_extract("_path", r"^(.*)/[^/]*$", 1).alias("_dir"),
        F.col("b.license").alias("own"),
        (-F.col("b.least")).alias("cosine"),
        (F.col("b.license").isNotNull() & F.col("_path").isNotNull() & (F.coalesce("_declares", F.lit(False)) | F.col("_path").rlike(LICENSE_FILE))).alias("_speaks"),
    )
    own = stage(own, "license-own")
    votes = own.where("_speaks").groupBy("_dir", "own").agg(F.count(F.lit(1)).alias("n"))
    declared = votes.groupBy("_dir").agg(F.min(F.struct((-F.col("n")).alias("most"), "own")).alias("v")).select(F.col("_dir").alias("from_dir"), F.col("v.own").alias("given"))
    steps = F.split("_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("from_dir")))
    dirs = own.select("_dir").where("_dir is not null").distinct().select("_dir", F.explode(ancestors).alias("a")).select("_dir", "a.depth", "a.from_dir")
    nearest = dirs.join(declared, "from_dir").groupBy("_dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("near"))
    # written, so that the join deals both sides anew and adaptive execution can split a large directory
    out = own.join(stage(nearest, "license-directories"), "_dir", "left")
    has_own = F.col("own").isNotNull()
    return out.select(
        *[F.col(f"_file.`{c}`").alias(c) for c in keep],
        "own",
        "cosine",
        F.when(has_own, F.col("own")).otherwise(F.col("near.given")).alias("license"),
        F.when(~has_own, F.col("near.from_dir")).alias("from_dir"),
        F.when(has_own, "own").when(F.col("near.given").isNotNull(), "inherited").otherwise("none").alias("how"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: directory source/lang, name doc_id."""
    files = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"
    )
    return scan(files).select("doc_id", "path", "own", F.round("cosine", 6).alias("cosine"), "license", "from_dir", "how")


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL: dict[str, str] = {}
