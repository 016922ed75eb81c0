"""Licence notices in texts: Dice coefficient over word bigrams, in DataFrame functions only.

Text is normalised (lower case, runs of anything but letters, digits and line feeds become one space).
Its units are lines, and paragraphs of several lines (parted by lines without letters and digits).  A unit and a template
are compared by ``2 |A & B| / (|A| + |B|)`` over their sets of word bigrams.  Since the shared
part is no larger than either set, a template of m bigrams can only match units of
m t / (2 - t) to m (2 - t) / t bigrams: units outside all templates' bounds are dropped before
bigrams are made, and templates outside a unit's bounds before anything is counted.

A match shares at least m t / (2 - t) of a template's bigrams, so it holds one of any m - m t / (2 - t) + 1
of them: texts, then units, without any of these (a regular expression over the longest bigrams of each
template) are left before they are cut into words.  The templates are a fixed table (a few hundred
bigrams) and are broadcast.

Definitions.  Each unit gets its best template (ties: the first name).  Null or empty texts and
units without bigrams match nothing.  Ids may be null or repeat: matches are counted per row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: (licence, notice): short notices and headers in common use, and the short licences whole.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
    # the paragraphs of whole licences; "BSD" where the two and the three clause licence share them
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed."),
    ("Apache-2.0", "4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:"),
    ("Apache-2.0", "7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License."),
    ("Apache-2.0", "8. Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or consequential damages of any character arising as a result of this License or out of the use or inability to use the Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any and all other commercial damages or losses), even if such Contributor has been advised of the possibility of such damages."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too."),
    ("GPL-3.0", "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too."),
    ("GPL-2.0", "0. This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License. The \"Program\", below, refers to any such program or work, and a \"work based on the Program\" means either the Program or any derivative work under copyright law: that is to say, a work containing the Program or a portion of it, either verbatim or with modifications and/or translated into another language. (Hereinafter, translation is included without limitation in the term \"modification\".) Each licensee is addressed as \"you\"."),
    ("GPL-2.0", "11. BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM \"AS IS\" WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION."),
    ("GPL-2.0", "12. IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER, OR ANY OTHER PARTY WHO MAY MODIFY AND/OR REDISTRIBUTE THE PROGRAM AS PERMITTED ABOVE, BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL, SPECIAL, INCIDENTAL OR CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM (INCLUDING BUT NOT LIMITED TO LOSS OF DATA OR DATA BEING RENDERED INACCURATE OR LOSSES SUSTAINED BY YOU OR THIRD PARTIES OR A FAILURE OF THE PROGRAM TO OPERATE WITH ANY OTHER PROGRAMS), EVEN IF SUCH HOLDER OR OTHER PARTY HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGES."),
    ("MPL-2.0", "6. Disclaimer of Warranty Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing. The entire risk as to the quality and performance of the Covered Software is with You. Should any Covered Software prove defective in any respect, You (not any Contributor) assume the cost of any necessary servicing, repair, or correction. This disclaimer of warranty constitutes an essential part of this License. No use of any Covered Software is authorized under this License except under this disclaimer."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:"),
]

OTHER = r"[^\p{L}\p{N}\n]+"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a normalised notice."""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(m: int, percent: int) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``percent`` with a template of m."""
    return -(-m * percent // (200 - percent)), m * (200 - percent) // percent


def necessary(b: list[str], percent: int) -> list[str]:
    """So many of a template's bigrams (the longest) that every match holds one of them."""
    m = len(b)
    least = -(-percent * (m + size_bounds(m, percent)[0]) // 200)
    return sorted(b, key=lambda x: (-len(x), x))[: m - least + 1]


def trie(words: list[str]) -> str:
    """A regular expression for any of these, branching by character."""
    if len(words) == 1:
        return re.escape(words[0])
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    end = heads.pop("", None)
    body = "|".join(re.escape(h) + (trie(rest) if rest != [""] else "") for h, rest in sorted(heads.items()))
    return f"(?:{body})" + ("?" if end is not None else "")


class LicenseScan:
    """``run`` returns ``id, unit, number, license, dice, n_bigrams``, a row for each matching unit."""

    def __init__(self, percent: int = 80, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < percent <= 100:
            raise ValueError("percent: 1 to 100")
        self.percent, self.id_col, self.text_col = percent, id_col, text_col
        self.templates = [(name, k, bigrams(text)) for k, (name, text) in enumerate(templates or TEMPLATES)]
        if not all(b for _, _, b in self.templates):
            raise ValueError("a template needs two words at least")

    def _template_sql(self) -> str:
        rows = [f"('{name}', {k}, {len(b)}, '{x}')" for name, k, b in self.templates for x in b]
        return f"SELECT * FROM VALUES {', '.join(rows)} AS t(license, template, m, bigram)"

    def run(self, docs: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        bounds = [size_bounds(len(b), self.percent) for _, _, b in self.templates]
        low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
        # some bigram of a match stands between spaces, line feeds or ends; its words may be parted by a line feed
        signs = trie(sorted({x for _, _, b in self.templates for x in necessary(b, self.percent)})).replace(r"\ ", r"[ \n]+")
        sign = F.lit(r"(?:^|[ \n])" + signs + r"(?:$|[ \n])")
        body = F.regexp_replace(F.lower(F.col(self.text_col).cast("string")), OTHER, " ")
        texts = docs.select(F.col(self.id_col).alias("id"), body.alias("body")).where(F.rlike("body", sign))
        numbered = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), x.alias("body")))
        lines = numbered("line", F.split("body", "\n", -1))
        paragraphs = F.filter(numbered("paragraph", F.split("body", r"\n(?: ?\n)+", -1)), lambda x: F.contains(x["body"], F.lit("\n")))
        units = texts.select("id", F.explode(F.concat(lines, paragraphs)).alias("u")).select("id", "u.unit", "u.number", F.trim(F.regexp_replace("u.body", r"[ \n]+", " ")).alias("body"))
        units = units.where(F.rlike("body", sign))
        units = units.select("id", "unit", "number", F.split("body", " ").alias("w")).where(F.size("w") > low)
        pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        units = units.withColumn("b", F.array_distinct(pairs)).where(F.size("b").between(low, high)).select("id", "unit", "number", F.size("b").alias("n"), "b")
        each = units.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "unit", "number", "n", F.explode("b").alias("bigram"))
        near = F.expr(f"n * {self.percent} <= m * {200 - self.percent} and m * {self.percent} <= n * {200 - self.percent}")
        hits = each.join(F.broadcast(spark.sql(self._template_sql())), "bigram").where(near)
        scored = hits.groupBy("row", "id", "unit", "number", "n", "license", "template", "m").agg(F.count("*").alias("shared"))
        scored = scored.where(200 * F.col("shared") >= self.percent * (F.col("n") + F.col("m"))).withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("m")))
        best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("dice"), "license", "template"))
        scored = scored.withColumn("nth", best).where("nth = 1")
        return scored.select(F.col("id").alias(self.id_col), "unit", F.col("number").cast("long").alias("number"), "license", "dice", F.col("n").cast("long").alias("n_bigrams"))

    def oracle(self, source: str = "documents") -> str:
        """The same query in SQL for DuckDB (ids must be distinct)."""
        rows = ", ".join(f"('{name}', {k}, {len(b)}, '{x}')" for name, k, b in self.templates for x in b)
        p = self.percent
        return rf"""
        WITH t(license, template, m, bigram) AS (VALUES {rows}),
        x AS (SELECT {self.id_col} AS id, regexp_replace(lower({self.text_col}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS body FROM {source}),
        u AS (SELECT id, 'line' AS unit, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS number FROM x
              UNION ALL SELECT * FROM (SELECT id, 'paragraph', unnest(regexp_split_to_array(body, '\n(?: ?\n)+')) AS body, generate_subscripts(regexp_split_to_array(body, '\n(?: ?\n)+'), 1) - 1 FROM x) WHERE contains(body, chr(10))),
        w AS (SELECT id, unit, number, string_split(trim(regexp_replace(body, '[ \n]+', ' ', 'g')), ' ') AS w FROM u),
        b AS (SELECT DISTINCT id, unit, number, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT id, unit, number, w, unnest(range(1, len(w))) AS i FROM w)),
        n AS (SELECT id, unit, number, count(*) AS n FROM b GROUP BY ALL),
        s AS (SELECT id, unit, number, n, license, template, m, count(*) AS shared FROM b JOIN t USING (bigram) JOIN n USING (id, unit, number) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY id, unit, number ORDER BY 2 * shared / (n + m) DESC, license, template) AS nth FROM s WHERE 200 * shared >= {p} * (n + m))
        SELECT id AS {self.id_col}, unit, CAST(number AS BIGINT) AS number, license, 2 * shared / (n + m) AS dice, CAST(n AS BIGINT) AS n_bigrams FROM r WHERE nth = 1"""
