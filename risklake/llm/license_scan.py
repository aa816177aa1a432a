"""Licence scan: normalised lines, whole texts and runs of words against licence notices by the Dice coefficient of their word bigrams.

Single pass inside each row, in DataFrame operations only: no shuffle, no join. A Dice value of t or more needs
set sizes within a factor (2 - t)/t of each other, so a unit meets only the templates its size allows. A run of words can reach t
only if the text shares t/(2 - t) of the template's bigrams: templates below that are dropped before any run is looked at.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.session import tune

THRESHOLD = 0.8

#: fixed values: usual notice wordings, licence id -> texts
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def _neighbours(words: Column) -> Column:
    """Hashes of neighbouring words in order; none for fewer than two."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_neighbours(words))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, int, list[int]]]:
    """Licence ids with the number of words and the bigram hashes of each notice (a fixed list of a few dozen, hashed by Spark itself)."""
    rows = spark.createDataFrame([(k, t) for k, texts in templates.items() for t in texts], "license string, text string").select("license", _words(F.lower("text")).alias("w"))
    return sorted((r.license, r.m, sorted(r.b)) for r in rows.select("license", F.size("w").alias("m"), _bigrams(F.col("w")).alias("b")).collect() if r.b)


_NOTICE = "array<struct<license: string, notices: array<struct<m: int, lo: int, hi: int, g: array<bigint>>>>>"


def licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, hits)``, one row per input row; ``hits`` is an array of (line, license, dice).

    Lines count from 0, -1 is the whole text where it has several lines, -2 the best run of words, wherever it begins and however it is
    wrapped: as many words as the notice has (fewer at the end of the text). Of the notices of one licence the best counts. Several licences
    for one line, for the whole text, or for runs that overlap are decided by their Dice values; with equal values all stay. Null and empty texts, and lines of fewer than
    two words, have no bigrams and no hits. A very long text is one row of hashes; only notices that it shares enough bigrams with are
    looked for in it. Repeated rows and null ids are rows like any other; other columns are ignored.
    """
    table = template_table(docs.sparkSession, templates)
    ratio = Fraction(str(threshold)) / (2 - Fraction(str(threshold)))  # exact: a bound must not cut off a Dice value of just the threshold
    by_license: dict[str, list[dict]] = {}
    for name, m, grams in table:
        by_license.setdefault(name, []).append({"m": m, "lo": math.ceil(len(grams) * ratio), "hi": math.floor(len(grams) / ratio), "g": grams})
    notices = [x for v in by_license.values() for x in v]
    least, most = min(x["lo"] for x in notices), max(x["hi"] for x in notices)
    known = F.from_json(F.lit(json.dumps([{"license": k, "notices": v} for k, v in by_license.items()])), _NOTICE)  # folded into one literal
    all_grams = F.from_json(F.lit(json.dumps(sorted({g for x in notices for g in x["g"]}))), "array<bigint>")
    dice = lambda have, grams: 2 * F.size(F.array_intersect(have, grams)) / (F.size(have) + F.size(grams))

    rows = docs.select("doc_id", F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n"), _words).alias("lines"))
    rows = rows.withColumn("run", _neighbours(F.flatten("lines")))
    units = F.transform("lines", lambda w, i: F.struct(i.alias("line"), _bigrams(w).alias("b")))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("line"), F.array_distinct("run").alias("b")))).otherwise(F.array().cast("array<struct<line:int,b:array<bigint>>>"))
    rows = rows.select("doc_id", "run", F.array_intersect("run", all_grams).alias("shared"), F.filter(F.concat(units, whole), lambda u: F.size(u["b"]).between(least, most)).alias("units"))

    def against(unit: Column) -> Column:
        def best(notices: Column) -> Column:
            fit = F.filter(notices, lambda t: F.size(unit["b"]).between(t["lo"], t["hi"]))
            return F.coalesce(F.array_max(F.transform(fit, lambda t: dice(unit["b"], t["g"]))), F.lit(0.0))

        return F.transform(known, lambda x: F.struct(unit["line"].alias("line"), x["license"].alias("license"), best(x["notices"]).alias("dice")))

    def nearest(hits: Column) -> Column:
        top = F.array_max(F.transform(hits, lambda x: x["dice"]))
        return F.filter(hits, lambda x: (x["dice"] >= threshold) & (x["dice"] == top))

    def runs(notices: Column) -> Column:
        """The best run of one licence's notices: (dice, -first bigram, length); a run that begins outside the notice is never better."""
        near = F.filter(notices, lambda t: F.when(F.size("shared") >= t["lo"], F.size(F.array_intersect("shared", t["g"])) >= t["lo"]).otherwise(False))
        starts = lambda t: F.filter(F.sequence(F.lit(0), F.size("run") - 1), lambda i: F.array_contains(t["g"], F.get("run", i)))
        each = F.transform(near, lambda t: F.array_max(F.transform(starts(t), lambda i: F.struct(
            dice(F.array_distinct(F.slice(F.col("run"), i + 1, t["m"] - 1)), t["g"]).alias("dice"), (-i).alias("first"), t["m"].alias("m")))))
        return F.array_max(each)

    found = F.filter(F.transform(known, lambda x: F.struct(x["license"].alias("license"), runs(x["notices"]).alias("r"))), lambda x: x["r"]["dice"] >= threshold)
    rows = rows.withColumn("found", F.when(F.size("shared") >= least, found))
    crosses = lambda x, y: (-x["r"]["first"] < -y["r"]["first"] + y["r"]["m"]) & (-y["r"]["first"] < -x["r"]["first"] + x["r"]["m"])
    clear = F.filter("found", lambda x: ~F.exists("found", lambda y: (y["r"]["dice"] > x["r"]["dice"]) & crosses(x, y)))
    spread = F.transform(clear, lambda x: F.struct(F.lit(-2).alias("line"), x["license"].alias("license"), x["r"]["dice"].alias("dice")))
    none = F.array().cast("array<struct<line:int,license:string,dice:double>>")
    return rows.select("doc_id", F.concat(F.flatten(F.transform(F.transform("units", against), nearest)), F.coalesce(spread, none)).alias("hits"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["license"])))
    best = F.round(F.array_max(F.transform("hits", lambda x: x["dice"])), 6)
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join(names, ",").alias("licenses"), F.coalesce(best, F.lit(0.0)).alias("best_dice"))


def _sql_templates() -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, texts in TEMPLATES.items() for t in texts)


_SQL_WORDS = "list_filter(string_split_regex({t}, '[^a-z0-9]+'), lambda x: x <> '')"
_SQL_RUN = "[{w}[i] || ' ' || {w}[i + 1] for i in range(1, len({w}))]"
_SQL_GRAMS = f"list_distinct({_SQL_RUN})"
OP7_SQL = f"""
WITH t(license, text) AS (VALUES {_sql_templates()}),
tb AS MATERIALIZED (SELECT row_number() OVER () AS tid, license, len(w) AS m, {_SQL_GRAMS.format(w='w')} AS b FROM (SELECT license, {_SQL_WORDS.format(t='lower(text)')} AS w FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
u AS (SELECT rid, j AS line, ls[j] AS l FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS j FROM d) UNION ALL SELECT rid, -1, array_to_string(ls, ' ') FROM d WHERE len(ls) > 1),
ub AS (SELECT rid, line, {_SQL_GRAMS.format(w='w')} AS b FROM (SELECT rid, line, {_SQL_WORDS.format(t='l')} AS w FROM u)),
h AS (SELECT rid, line, license, max(2e0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b))) AS dice
      FROM ub JOIN tb ON len(ub.b) BETWEEN ceil(len(tb.b) * {THRESHOLD} / {2 - THRESHOLD}) AND floor(len(tb.b) * {2 - THRESHOLD} / {THRESHOLD}) GROUP BY rid, line, license QUALIFY dice = max(dice) OVER (PARTITION BY rid, line)),
a AS (SELECT rid, {_SQL_RUN.format(w='w')} AS run FROM (SELECT rid, {_SQL_WORDS.format(t="array_to_string(ls, ' ')")} AS w FROM d)),
tg AS (SELECT tid, license, m, b, unnest(b) AS g FROM tb),
p AS (SELECT rid, unnest(run) AS g, generate_subscripts(run, 1) AS i FROM a),
n AS (SELECT rid, tid, any_value(license) AS license, any_value(m) AS m, list(DISTINCT i) AS starts
      FROM p JOIN tg USING (g) GROUP BY rid, tid HAVING count(DISTINCT g) >= ceil(any_value(len(b)) * {THRESHOLD} / {2 - THRESHOLD})),
s AS (SELECT rid, tid, unnest(starts) AS i FROM n),
v AS (SELECT s.rid, s.tid, i, list_distinct(run[i:i + tb.m - 2]) AS v FROM s JOIN a USING (rid) JOIN tb USING (tid)),
w AS (SELECT rid, license, m, i, 2e0 * len(list_intersect(v, b)) / (len(v) + len(b)) AS dice FROM v JOIN tb USING (tid)),
r AS (SELECT * FROM w WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY rid, license ORDER BY dice DESC, i, m DESC) = 1),
c AS (SELECT rid, license, dice FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.rid = x.rid AND y.dice > x.dice AND x.i < y.i + y.m AND y.i < x.i + x.m)),
g AS (SELECT rid, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS ids, max(dice) AS best FROM
      (SELECT rid, license, dice FROM h WHERE dice >= {THRESHOLD} UNION ALL SELECT rid, license, dice FROM c) GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_hits, coalesce(ids, '') AS licenses, coalesce(round(best, 6), 0e0) AS best_dice FROM d LEFT JOIN g USING (rid)"""
