"""License scans: sparse TF-IDF cosine of headers and license files to license templates, then inheritance from the nearest ancestor directory.

A file has these units: every line; every paragraph (two lines or more in a row that have a term); every comment block (two lines or more in a row
that begin with a comment mark, blank comment lines included), which is what a header is; and, if the file is named like a license, its
whole text. A unit is a sparse vector of (1 + ln count) * IDF over its terms, with the IDF of the templates and, for terms that no template
has, the highest one. A license has several templates (tag, notice, header, title, full text), each a vector of the same kind;
its score for a unit is the best cosine. A file declares the license of its best unit at COSINE or above; ties go to the
first license by name. A file that is mostly such units (SHARE of its words) or is named like a license file speaks for its directory; a file that declares nothing
takes the license of the nearest directory above it that has one (of several files of a directory, the best score, then the first path).

Units that provably stay below the cosine are dropped where the text is read (see able()); the bound follows the templates that are
given. The templates are a parameter of the scan, not data: their terms travel in the plan. Directory licenses are joined by path equality on
the ancestors of each different directory (as many as the path is deep), never by prefix comparison.

Nulls and odd input: a null or empty text declares nothing; a null path has no directory and inherits nothing; repeated rows
are scored row for row; an empty table gives an empty result; a very long text is held by its task as its array of terms, and only units that can reach
the cosine leave it. Extra columns are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import materialize, with_defaults
from sonolith.llm.linededup import let

COSINE, SHARE = 0.6, 0.5
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|<!--|%)"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
# Public license notices, headers, titles and short full texts, by SPDX identifier.
MIT_TEXT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit "
    "persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the software. the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
    "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
BSD_HEAD = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business "
    "interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the "
    "use of this software, even if advised of the possibility of such damage."
)
ISC_TEXT = (
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
    "of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from "
    "loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
APACHE_HEADER = (
    "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at "
    "http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, "
    "without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."
)
MPL_HEADER = (
    "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at "
    "https://mozilla.org/mpl/2.0/."
)


def gnu_notice(name: str, version: str) -> str:
    """The notice that GNU licenses ask for."""
    return (
        f"this program is free software: you can redistribute it and/or modify it under the terms of the gnu {name} as published by the free software foundation, either version {version} of "
        f"the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
        f"merchantability or fitness for a particular purpose. see the gnu {name} for more details. you should have received a copy of the gnu {name} along with this program. if not, see "
        "<https://www.gnu.org/licenses/>."
    )


TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "spdx license identifier apache 2.0", "apache license version 2.0 january 2004 http www.apache.org licenses", APACHE_HEADER],
    "BSD-2-Clause": ["spdx license identifier bsd 2 clause", "bsd 2 clause license", BSD_HEAD + BSD_TAIL],
    "BSD-3-Clause": ["redistribution and use in source and binary forms with or without modification are permitted bsd license", "spdx license identifier bsd 3 clause", "bsd 3 clause license", BSD_HEAD + BSD_NAMES + BSD_TAIL],
    "CC-BY-4.0": ["licensed under cc by 4.0 creative commons attribution", "spdx license identifier cc by 4.0"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "spdx license identifier cc by nc 4.0"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3.0 or later only", "gnu general public license version 3 29 june 2007", gnu_notice("general public license", "3")],
    "ISC": ["spdx license identifier isc", "isc license", ISC_TEXT],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 or later only", "gnu lesser general public license version 3 29 june 2007", gnu_notice("lesser general public license", "3")],
    "MIT": ["released under the mit license", "spdx license identifier mit", "the mit license mit", MIT_TEXT],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "spdx license identifier mpl 2.0", "mozilla public license version 2.0", MPL_HEADER],
}
Templates = dict[str, list[str]] | dict[str, str]


def forms(templates: Templates) -> list[tuple[str, Counter]]:
    """(license, counts of terms) of each template."""
    return [(name, Counter(re.findall(TERM, text.lower()))) for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)]


def template_weights(templates: Templates = TEMPLATES) -> tuple[list[tuple[int, str, str, float, float]], float]:
    """(template, license, term, unit weight, IDF) of each template's terms, and the IDF of an unknown term."""
    every = forms(templates)
    found_in = Counter(t for _, c in every for t in c)
    idf = {t: math.log((1 + len(every)) / (1 + n)) + 1 for t, n in found_in.items()}
    out = []
    for form, (name, count) in enumerate(every):
        weight = {t: (1 + math.log(n)) * idf[t] for t, n in sorted(count.items())}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out += [(form, name, t, w / norm, idf[t]) for t, w in weight.items()]
    return out, math.log(1 + len(every)) + 1


def able(templates: Templates, cosine: float) -> Callable[[Column], Column]:
    """Whether an array of terms can reach the cosine with a template; false only where it provably can't.

    The cosine is at most the norm of the unit's known terms over its whole norm. Of k known terms, d different, none occurs more than
    k - d + 1 times, which bounds the former; each different unknown term adds unknown ** 2 at least to the square of the
    latter. And it is at most the norm of the template's weights (of length one) of the terms that the unit shares with it."""
    weights, unknown = template_weights(templates)
    least = max(cosine - 1e-6, 0.0) ** 2
    by_idf: dict[float, set[str]] = {}
    by_form: dict[int, dict[str, float]] = {}
    for form, _, term, w, idf in weights:
        by_idf.setdefault(idf, set()).add(term)
        by_form.setdefault(form, {})[term] = w * w
    known_terms = [t for terms in by_idf.values() for t in sorted(terms)]

    def square(term: Column) -> Column:
        out = F.lit(0.0)
        for idf, terms in by_idf.items():
            out = F.when(term.isin(sorted(terms)), idf * idf).otherwise(out)
        return out

    def by_norm(terms: Column, known: Column, own: Column) -> Column:
        most = 1 + F.log((F.size(known) - F.size(own) + 1).cast("double"))
        strange = F.size(F.array_distinct(terms)) - F.size(own)
        return F.aggregate(own, F.lit(0.0), lambda s, t: s + square(t)) * most * most * (1 - least) >= least * unknown**2 * strange

    def by_share(own: Column) -> Column:
        def shared(terms: dict[str, float]) -> Column:
            of = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
            return F.aggregate(own, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(of, t), F.lit(0.0)))

        return F.greatest(F.lit(0.0), *map(shared, by_form.values())) >= least

    def check(terms: Column) -> Column:
        return let(
            F.filter(terms, lambda t: t.isin(known_terms)),
            lambda known: F.when(F.size(known) > 0, let(F.array_distinct(known), lambda own: F.when(by_norm(terms, known, own), by_share(own)).otherwise(F.lit(False)))).otherwise(F.lit(False)),
        )

    return check


def units(text: Column, path: Column, templates: Templates = TEMPLATES, cosine: float = COSINE) -> Column:
    """array<struct<kind, first (line, from 0), n_lines, terms>> of a file's units that can reach the cosine."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.struct(F.regexp_extract_all(x, F.lit("(" + TERM + ")"), 1).alias("terms"), x.rlike(COMMENT).alias("comment")))
    reaches = able(templates, cosine)

    def unit(kind: str, first: Column, n_lines: Column, terms: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.cast("int").alias("first"), n_lines.cast("int").alias("n_lines"), terms.alias("terms"))

    def of(parts: Column) -> Column:
        def runs(kind: str, inside: Callable[[Column], Column]) -> Column:
            """Units of two lines or more in a row that are inside."""
            at = lambda i: F.coalesce(inside(F.get(parts, i)), F.lit(False))
            starts = F.array_compact(F.transform(parts, lambda x, i: F.when(inside(x) & ~at(i - 1) & at(i + 1), i)))
            ends = F.array_compact(F.transform(parts, lambda x, i: F.when(inside(x) & ~at(i + 1) & at(i - 1), i + 1)))
            return let(ends, lambda e: F.transform(starts, lambda a, i: unit(kind, a, F.get(e, i) - a, F.flatten(F.transform(F.slice(parts, a + 1, F.get(e, i) - a), lambda x: x["terms"])))))

        whole = F.when(F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)), F.array(unit("file", F.lit(0), F.size(parts), F.flatten(F.transform(parts, lambda x: x["terms"])))))
        single = F.transform(parts, lambda x, i: unit("line", i, F.lit(1), x["terms"]))
        blocks = F.concat(runs("paragraph", lambda x: F.size(x["terms"]) > 0), runs("comment", lambda x: x["comment"]), F.coalesce(whole, F.array().cast("array<struct<kind:string,first:int,n_lines:int,terms:array<string>>>")))
        return F.concat(F.filter(single, lambda u: reaches(u["terms"])), F.filter(blocks, lambda u: reaches(u["terms"])))

    return let(lines, of)


def unit_scores(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """docs(row, units) -> row, kind, first, n_lines, n_terms, license, score of the best license for each unit."""
    weights, unknown = template_weights(templates)
    table = docs.sparkSession.createDataFrame(weights, "form int, license string, term string, weight double, idf double")
    each = docs.select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.first", "u.n_lines", "u.terms").withColumn("n_terms", F.size("terms").cast("long"))
    unit = ["row", "kind", "first", "n_lines", "n_terms"]
    counted = each.select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("n"))
    per_term = table.groupBy("term").agg(F.max("idf").alias("idf"), F.collect_list(F.struct("form", "license", "weight")).alias("per"))
    if len(weights) <= 100_000:  # rows of some 50 bytes
        per_term = F.broadcast(per_term)
    weighed = counted.join(per_term, "term", "left").withColumn("w", (1 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.lit(unknown)))
    scored = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*unit))))
    pairs = scored.where("per is not null").select(*unit, "norm", "w", F.explode("per").alias("p"))
    cosine = pairs.groupBy(*unit, "p.form", "p.license").agg(F.round(F.sum(F.col("w") * F.col("p.weight")) / F.max("norm"), 9).alias("score"))
    best = cosine.groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return best.select(*unit, F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: Templates = TEMPLATES, cosine: float = COSINE, share: float = SHARE) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, path, license, score, origin (declared, inherited or none), from_dir."""
    n_words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).cast("long")
    rows = with_defaults(files, doc_id="long", path="string", text="string")
    # one pass over the texts; only units that can reach the cosine go on
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", n_words.alias("n_words"), units(F.col("text"), F.col("path"), templates, cosine).alias("units")), "license-units")
    found = unit_scores(rows.where(F.size("units") > 0).select("row", "units"), templates).where(F.col("score") >= cosine)
    by_kind = found.groupBy("row", "kind").agg(F.sum("n_terms").alias("terms"), F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    declared = by_kind.groupBy("row").agg(F.min("best").alias("best"), F.max("terms").alias("notice_terms")).select("row", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), "notice_terms")
    slim = rows.select("row", "doc_id", "path", "n_words")
    speaks = F.col("license").isNotNull() & ((F.col("notice_terms") >= share * F.col("n_words")) | F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)))
    own = slim.join(declared, "row", "left").select("doc_id", "path", F.element_at(ancestors(F.col("path")), 1).alias("dir"), "license", "score", F.coalesce(speaks, F.lit(False)).alias("speaks"))
    own = materialize(own, "licenses")
    dirs = own.where("speaks and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "doc_id", "license")).alias("best"))
    dirs = materialize(dirs.select(F.col("dir").alias("up_dir"), F.col("best.license").alias("dir_license"), (-F.col("best.s")).alias("dir_score")), "license-dirs")
    needy = own.where("license is null and path is not null").select("dir").distinct()
    steps = needy.select("dir", F.posexplode(F.concat(F.array("dir"), F.when(F.col("dir") != "", ancestors(F.col("dir"))).otherwise(F.array().cast("array<string>")))).alias("up", "up_dir"))
    nearest = steps.join(dirs, "up_dir").groupBy("dir").agg(F.min(F.struct("up", "up_dir", "dir_license", "dir_score")).alias("near"))
    nearest = materialize(nearest.select(F.col("dir").alias("of_dir"), "near"), "license-nearest")
    return own.join(nearest, F.col("license").isNull() & (F.col("dir") == F.col("of_dir")), "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("score", "near.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "declared").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("near.up_dir").alias("from_dir"),
    )
