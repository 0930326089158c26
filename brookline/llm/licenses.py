"""License scans: TF-IDF cosine of passages to templates, and inheritance from ancestor directories.
DataFrame functions only."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import broken, written

#: SPDX identifiers and the notices by which files state them, and opening words of the licence texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole texts of the short licences, and the whole notices and opening paragraphs of the long ones, without names and years.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
)
TEMPLATES += [
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License. Copyright (c). All rights reserved. " + _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License. Copyright (c). All rights reserved. " + _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/"),
    ("Apache-2.0", "Copyright. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", _GPL_NOTICE.format("General Public License")),
    ("LGPL-3.0", _GPL_NOTICE.format("Lesser General Public License")),
    ("AGPL-3.0", _GPL_NOTICE.format("Affero General Public License")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Passages without any of these are not compared: no template lacks them.
CUE = r"(?i)licen[sc]|permission|redistribut|public domain|copyright|SPDX"
TOKEN = r"[a-z]+|\d+(?:\.\d+)*"
NAMES = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
TAG = "SPDX-License-Identifier"
#: How a line of a leading comment begins; blank lines do not end it.
MARKER = r"(?:#|//|/\*|\*|--|;|<!--|%)"
COMMENT = r"^\s*(?:" + MARKER + r"|$)"


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def token_column(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def passages(text: Column) -> Column:
    """Sentences and lines of a text that hold a cue, as an array."""
    return F.filter(F.split(text, r"(?<=[.!?;:])\s+|[\r\n]+"), lambda s: s.rlike(CUE))


def header(text: Column) -> Column:
    """The comment that a text begins with, without its markers, as one string; null if it doesn't begin with one."""
    lines = F.split(text, r"\r?\n")
    # The first line that isn't part of the comment; a text of comments alone has none.
    end = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), F.lit(True))
    own = F.slice(lines, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(lines)).cast("int"))
    return F.when(text.rlike(r"^\s*" + MARKER), F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"^\s*" + MARKER + r"+|\*/|-->", "")), " "))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "id", least: float = 0.75, file_share: float = 0.9) -> DataFrame:
    """One row per file: id, path, license, score, origin ("own", "inherited" or "none"), license_path.

    Compared are the comment that a file begins with, license files (by name) as a whole, and all sentences and lines that hold a cue word.
    They become sparse TF-IDF vectors, with document frequencies counted over all of them, and are held against every
    template. The best template at or above `least` is the file's own license; an SPDX tag (the first of a file) is one with score 1. A license file has
    such a name (LICENSE, COPYING, ...) or consists of license passages by at least `file_share` of its characters; its license holds for
    its directory and all below. A file without its own takes that of the nearest ancestor directory; of several files in a directory the
    best score, then the least path.

    Null text has no own license; a null path has no directory. Repeated rows each get a row; ties
    between templates go to the identifier that sorts first. Empty table: no rows. Very long texts and passages cost in proportion to their words.
    Extra columns are not read.

    Scale: only the words of what is compared are shuffled, counted by task before. The template side is a fixed list. Only distinct directories
    are joined to directories with license files, one row per directory and depth; files join their directory's answer on a key that AQE may split.
    """
    cut = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("t"))
    none = F.array().cast("array<string>")
    found, named = F.coalesce(passages(F.col("t")), none), F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    tag = F.when(F.contains("t", F.lit(TAG)), F.regexp_extract("t", TAG + r":\s*([A-Za-z0-9.+-]+)", 1))
    cut = cut.select("id", "path", found.alias("s"), F.coalesce(F.length("t"), F.lit(0)).alias("size"), F.nullif(tag, F.lit("")).alias("tag"), F.array_compact(F.array(header(F.col("t")), F.when(named, F.col("t")))).alias("more"))
    share = F.when(F.col("size") > 0, F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)) / F.col("size")).otherwise(0.0)
    # Rows are written once, so that their numbers stay.
    each = written(cut.select("id", "path", "tag", F.concat("s", "more").alias("s"), share.alias("share"), F.monotonically_increasing_id().alias("row")), "license-passages")
    words = each.select("row", F.posexplode("s").alias("unit", "s")).select("row", "unit", F.explode(token_column(F.col("s"))).alias("w"))
    words = written(words.groupBy("row", "unit", "w").agg(F.count(F.lit(1)).alias("c")), "license-words")

    # Document frequencies of the templates' words, a fixed list.
    vectors = [(name, Counter(_tokens(t))) for name, t in sorted(TEMPLATES)]
    known = sorted({w for _, v in vectors for w in v})
    seen = {r["w"]: r["n"] for r in words.filter(F.col("w").isin(known)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = words.select("row", "unit").distinct().count() + len(TEMPLATES)
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + sum(w in v for _, v in vectors) + 1)) + 1 for w in known}
    rare = math.log(n + 1) + 1
    norms = [math.sqrt(sum((c * idf[w]) ** 2 for w, c in v.items())) for _, v in vectors]
    rows = [{"w": w, "idf": idf[w], "v": [v[w] * idf[w] ** 2 / norm for (_, v), norm in zip(vectors, norms, strict=True)]} for w in known]
    weights = F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<w: string, idf: double, v: array<double>>>")).alias("r")
    weights = F.broadcast(files.sparkSession.range(1).select(weights).select("r.*"))  # one row for each word of the templates
    many = F.sum(F.pow(F.col("c") * F.coalesce("idf", F.lit(rare)), F.lit(2.0)))
    dots = [F.coalesce(F.sum(F.col("c") * F.col("v")[k]), F.lit(0.0)) for k in range(len(vectors))]
    scored = words.join(weights, "w", "left").groupBy("row", "unit").agg(many.alias("norm"), F.array(*dots).alias("d"))
    best = [F.struct((-F.col("d")[k] / F.sqrt("norm")).alias("s"), F.lit(name).alias("license")) for k, (name, _) in enumerate(vectors)]
    scored = scored.select("row", F.array_min(F.array(*best)).alias("b")).filter(F.col("b.s") <= -least)
    mine = scored.groupBy("row").agg(F.min("b").alias("b")).select("row", F.col("b.license").alias("license"), F.least(F.lit(1.0), -F.col("b.s")).alias("score"))
    rows = each.join(mine, "row", "left").select("id", "path", "share", F.coalesce("tag", "license").alias("license"), F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"), F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*/)[^/]*$", 1).alias("dir"))
    rows = written(rows.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir"))), "license-own")

    holder = rows.filter(F.col("license").isNotNull() & F.col("dir").isNotNull() & (F.col("path").rlike(NAMES) | (F.col("share") >= file_share)))
    holder = holder.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select(F.col("dir").alias("up"), "b.license", "b.path", (-F.col("b.s")).alias("score"))
    dirs = rows.filter("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")).select("dir", "depth", F.array_join(F.concat(F.slice(parts, F.lit(1), F.col("depth")), F.array(F.lit(""))), "/").alias("up"))
    nearest = ups.join(holder, "up").groupBy("dir").agg(F.max_by(F.struct("license", "path", "score"), "depth").alias("b"))
    nearest = nearest.select(broken(F.col("dir")).alias("key"), F.col("b.license").alias("l2"), F.col("b.path").alias("p2"), F.col("b.score").alias("s2"))
    out = rows.withColumn("key", F.when(F.col("license").isNull(), F.col("dir"))).join(nearest, "key", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("l2").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("license", "l2").alias("license"), F.coalesce("score", "s2").alias("score"), origin.alias("origin"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("p2")).alias("license_path"))
