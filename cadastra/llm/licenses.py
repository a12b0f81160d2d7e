"""Licence scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, list marks, equivalent
spellings) and the digest of the *whole* result is joined to a table of the digests of
known licences: a hash join, whose build side is broadcast if it is small.  Lines are
looked up likewise among the few one-line notices under which texts stand."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Public licence texts and notices, without copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = """.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT),
    "ISC": (_ISC_GRANT + _ISC_NOTICE[:-1] + _ISC_TAIL, "ISC License\n" + _ISC_GRANT + _ISC_NOTICE[:-1] + _ISC_TAIL),
    "0BSD": (_ISC_GRANT + _ISC_TAIL, "BSD Zero Clause License\n" + _ISC_GRANT + _ISC_TAIL),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "Zlib": (_ZLIB, "zlib License\n" + _ZLIB),
    "Unlicense": (_UNLICENSE,),
    "Apache-2.0": (_APACHE_HEADER,),
}
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "CC0-1.0": ("Released under CC0 1.0", "Dedicated to the public domain under CC0 1.0"),
    "all-rights-reserved": ("All rights reserved",),
}
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "http": "https", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "maximise": "maximize", "modelled": "modeled", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
PHRASES = (("sub license", "sublicense"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"))

#: SHA-256 of long licences' normalised texts, whole and without what follows
#: their terms.
DIGESTS = {
    "Apache-2.0": ("7b571b8565095b87bb5ed8f67791b3c731f9a3ef97358bee998034dbea1c7bcc", "45df9a8c8175e1f3d96df434dfa66a6607395771eb52baf9c7cef88e58ab9477", "af110ac32e282715feaba8a911c700bbf71cdaca12855507d998ea999ab6bf4f"),
    "Artistic-1.0-Perl": ("b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49",),
    "CC0-1.0": ("888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c",),
    "GFDL-1.2": ("66c938a4f3d2114cc3d60f4233a4f26e8c730064aa767788d4745dedea334da1",),
    "GFDL-1.3": ("3c375c0e780727eaa9ddb17a7fa022a4b0b7ed527f12a3da106f47b622a3b3f1",),
    "GPL-1.0": ("ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746", "0460830f1601ab5f615dd93818221b48820590af661686bdf540c70fe3d696a4", "e865a0dda2da3969652b87fd53fdbacbc9c971447325f465df48971826e5f97c"),
    "GPL-2.0": ("2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee", "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39", "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc"),
    "GPL-3.0": ("1d853c80efe5ceb4de7b2f36ad97f5659946947afc9c6c75fa3fa50e20368ef2", "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1", "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e"),
    "LGPL-2.0": ("4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2", "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e", "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806"),
    "LGPL-2.1": ("f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98", "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3", "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89"),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MPL-1.1": ("b5fc2798ec24fca87e412725b368714138a3081d89f9c0aed70b6df92dd9db66",),
    "MPL-2.0": ("3693d0f300437bad55b29627761506ebba14142328cf40f43ed3d46ce72d04b4",),
}
#: A table of known digests of no more rows than this is broadcast (some 100 bytes a row).
BROADCAST_ROWS = 200_000

_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"(?im)^[^\w\n(©]*(?:copyright\s*(?:\(c\)|©|\d)|\(c\)\s|©)[^\n]*$")
_MARK = re.compile(r"(?m)^[ \t]*(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)]|[*•-])[ \t]+")


def normalise(text: str | None) -> str:
    """Lower-case words with one space between, equivalent spellings made one, lines
    that state a copyright and marks of lists left out."""
    if not text:
        return ""
    words = _WORD.findall(_MARK.sub("", _COPYRIGHT.sub("", text)).lower())
    out = " " + " ".join([SPELLINGS.get(w, w) for w in words])
    for a, b in PHRASES:
        out = out.replace(f" {a}", f" {b}")
    return out[1:]


def digest(normal: str) -> str:
    return hashlib.sha256(normal.encode("utf-8", "surrogatepass")).hexdigest()


def known(spark: SparkSession) -> DataFrame:
    """``(digest, license)`` of the known whole texts."""
    rows = {digest(normalise(t)): name for table in (NOTICES, TEXTS) for name, texts in table.items() for t in texts}
    return spark.createDataFrame(sorted((rows | {d: name for name, found in DIGESTS.items() for d in found}).items()), "digest string, license string")


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, notices, digest)`` per row: the licence that the whole text is
    (null if none), the sorted licences that its lines state and the digest of the
    whole normalised text.  ``texts(digest, license)`` are further known digests.

    Nulls: a null text is an empty one, which is no licence; null ids are carried.  Of
    several licences of one digest the first by name is taken.  Very long texts are
    normalised whole.  Repeated rows get equal results; an empty table gives no rows;
    other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    table = known(spark) if texts is None else known(spark).union(texts.select("digest", "license"))
    table = table.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))
    if texts is None or table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)

    def run(batches):
        lines = {normalise(t): name for name, notices in NOTICES.items() for t in notices}
        for b in batches:
            notices, digests = [], []
            for text in b.column(1).to_pylist():
                digests.append(digest(normalise(text)))
                said = {lines[x] for line in set((text or "").split("\n")) if (x := normalise(line)) in lines}
                notices.append(sorted(said))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(notices, pa.list_(pa.string())), pa.array(digests, pa.string())], names=["id", "notices", "digest"])

    coded = shared.map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, notices array<string>, digest string")
    return coded.join(table, "digest", "left").select("id", "license", "notices", "digest")


def oracle_sql() -> str:
    """DuckDB SQL over ``documents`` for the query: texts, lines and the known texts as
    they are written are all normalised there."""
    def literal(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    def values(table: dict) -> str:
        return ", ".join(f"({literal(t)}, '{name}')" for name, texts in table.items() for t in texts)

    def normal(x: str) -> str:
        out = f"regexp_replace({x}, '(?im)^[^\\w\\n(©]*(copyright\\s*(\\(c\\)|©|\\d)|\\(c\\)\\s|©)[^\\n]*$', '', 'g')"
        out = f"regexp_replace({out}, '(?m)^[ \\t]*(\\(?([0-9]{{1,2}}|[a-zA-Z])[.)]|[*•-])[ \\t]+', '', 'g')"
        out = f"string_split(trim(regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
        spelt = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())
        out = f"' ' || array_to_string(list_transform({out}, lambda w: CASE w {spelt} ELSE w END), ' ')"
        for a, b in PHRASES:
            out = f"replace({out}, ' {a}', ' {b}')"
        return f"substr({out}, 2)"

    long = " UNION ".join(f"SELECT '{d}', '{name}'" for name, found in DIGESTS.items() for d in found)
    return f"""
    WITH notice(raw, name) AS (VALUES {values(NOTICES)}), whole(raw, name) AS (SELECT * FROM notice UNION ALL SELECT * FROM (VALUES {values(TEXTS)}) v(raw, name)),
    line_of AS (SELECT {normal('raw')} AS t, name FROM notice), text_of AS (SELECT d, min(name) AS license FROM (SELECT sha256({normal('raw')}) AS d, name FROM whole UNION ALL ({long})) GROUP BY d),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    said AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM lines JOIN line_of ON line_of.t = {normal('line')} GROUP BY doc_id),
    digests AS (SELECT doc_id, sha256({normal("coalesce(text, '')")}) AS digest FROM documents)
    SELECT doc_id, license, coalesce(notices, '') AS notices, digest FROM digests LEFT JOIN said USING (doc_id) LEFT JOIN text_of ON d = digest"""
