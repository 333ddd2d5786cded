"""License scan by digest lookup: texts are brought to a canonical form, and whole canonical texts are hash-joined to known digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import narrow, read, row_key, same_row, saved
from rasterloom.llm.license_digests import DIGESTS

# Public licence texts and notices (SPDX identifier, text).
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
# The usual wrappings of the ISC text, of which a line that starts with "copyright" is taken for a copyright line.
_ISC = KNOWN[1][1]
_ISC_WRAPPED = _ISC.replace(" copyright notice and this permission notice appear in all copies.", "")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TERMS = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"]
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _bsd(terms: int) -> list[str]:
    """The text with its terms numbered or not, for one holder or several."""
    lists = ["".join(f"{i + 1}. {t}" if numbered else t for i, t in enumerate(_BSD_TERMS[:terms])) for numbered in (True, False)]
    return [_BSD_HEAD + x + _BSD_TAIL.format(who) for x in lists for who in ("HOLDER", "HOLDERS", "OWNER")]


# Texts that stand below a title or none (SPDX identifier, texts, titles).
TITLED = [
    ("MIT", [KNOWN[0][1]], ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"]),
    ("ISC", [_ISC, _ISC_WRAPPED], ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"]),
    ("BSD-2-Clause", _bsd(2), ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"]),
    ("BSD-3-Clause", _bsd(3), ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"]),
]
# Spellings that licence matching treats as equal (left becomes right).
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("https", "http")]

COPYRIGHT_LINE = r"(?im)^[ \t#*/;-]*(copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Without copyright lines, lower case, one space for each run of other than letters and digits, one spelling for each word."""
    x = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    x = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")
    x = F.concat(F.lit(" "), F.trim(x), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(x)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """The table of known digests: KNOWN, TITLED with each title, and the long texts' DIGESTS. It has some hundred rows, so it can be broadcast."""
    titled = [(name, f"{title}\n{rights}\n{text}") for name, texts, titles in TITLED for text in texts for title in ["", *titles] for rights in ("", "All rights reserved.")]
    short = spark.createDataFrame(KNOWN + titled, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    return short.union(spark.createDataFrame(DIGESTS, "license string, digest string")).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, line_licenses, n_license_lines) for each row of docs (doc_id, text).

    license: the licence whose known text is the entire text of the document; line_licenses: those whose known
    text is an entire line, each once, sorted and comma-joined. A null text counts as empty; an empty canonical
    text matches nothing. Repeated rows give repeated results; null ids stay. Other columns are left out.
    """
    known = F.broadcast(known_digests(docs.sparkSession) if known is None else known)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(*row_key(), "text")
    lines = d.select("doc_id", "text_key", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "text_key", digest(F.col("line")).alias("digest"))
    hits = lines.join(known, "digest").groupBy("doc_id", "text_key", "license").agg(F.count("*").alias("n"))
    hits = hits.groupBy("doc_id", "text_key").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"), F.sum("n").alias("n_license_lines"))
    # Lines of equal rows were counted together.
    hits = saved(hits, "license-lines")
    whole = d.select("doc_id", "text_key", digest(F.col("text")).alias("digest"))
    times = whole.groupBy("doc_id", "text_key").agg(F.count("*").alias("times")).where("times > 1")
    whole = whole.join(known, "digest", "left")
    out = whole.join(narrow(hits), same_row(whole, hits), "left").drop(hits["doc_id"]).drop(hits["text_key"])
    times = narrow(saved(times, "repeated-rows"))
    out = out.join(times, same_row(out, times), "left").drop(times["doc_id"]).drop(times["text_key"])
    return out.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce((F.col("n_license_lines") / F.coalesce("times", F.lit(1))).cast("long"), F.lit(0)).alias("n_license_lines"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its canonical digest and the licences that its whole text or whole lines are."""
    return scan(read(spark, sf_dir, "documents"))


def _duck(x: str) -> str:
    x = f"regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g')"
    x = f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        x = f"replace({x}, ' {old} ', ' {new} ')"
    return f"sha256(trim({x}))"


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, {_duck("text")} AS digest FROM (VALUES {rows}) k(license, text)),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM (SELECT doc_id, {_duck("line")} AS digest FROM l) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, d.digest, license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM (SELECT doc_id, {_duck("coalesce(text, '')")} AS digest FROM documents) d LEFT JOIN known ON d.digest = known.digest LEFT JOIN h USING (doc_id)
"""
