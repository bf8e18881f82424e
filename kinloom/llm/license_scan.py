"""Licence scans by canonical digests (native).

A text is put in a canonical form: lower case, copyright lines dropped, equivalent spellings made equal, punctuation and white space
reduced to single spaces. The md5 of that form is looked up among the digests of known licence texts and notices. Whole texts are
looked up, and each line of a text as a text of its own. The known digests are a fixed table of some tens of rows, so that side is
broadcast; only lines that match are shuffled.

Defined results: a null text counts as empty, and an empty canonical form matches nothing; repeated rows of a doc_id share their
matches, each row counting its own lines once per distinct line text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, the second of each pair being canonical.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("https", "http"),
)

# Known licence notices and short texts.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)

# Title lines that short texts have in files; numbered lists also come with bullets, which the canonical form drops.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause"),
}


def _known() -> tuple[tuple[str, str], ...]:
    """Notices, the whole texts of the folder licenses, and the short texts also with titles and, where they number their clauses, with bullets."""
    files = sorted((f for f in resources.files("kinloom.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    rows = list(NOTICES) + [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files]
    rows += [(name, re.sub(r"(?m)^\d\. ", "* ", text)) for name, text in rows if name.startswith("BSD-")]
    return tuple(rows + [(name, f"{title}\n\n{text}") for name, text in rows if len(text) > 500 for title in TITLES.get(name, ())])


KNOWN = _known()

# What a copyright line looks like, after lower-casing. A year, a sign or "by" must follow, so that licences' own sentences about notices stay.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|:|[ \t][0-9]{4}|[ \t]by[ \t])|(\(c\)|©)[ \t]*(copyright|[0-9]{4})|all rights reserved)[^\n]*$"


#: A longer table of known texts is joined by shuffle.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Words with a space on either side of each, so that spellings are replaced as words and never inside one."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "))
    out = F.when(out == "", out).otherwise(F.concat(F.lit(" "), out, F.lit(" ")))
    for variant, standard in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(variant)), F.lit(_spaced(standard)))
    return out


def _spaced(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def known_digests(spark, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(documents: DataFrame, known=KNOWN) -> DataFrame:
    """One row per document: (doc_id, digest, license of the whole text or null, n_license_lines, line_licenses joined by commas)."""
    digests = known_digests(documents.sparkSession, known)
    if len(known) <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", F.md5("form").alias("digest"), (F.col("form") != "").alias("filled"))
    whole = whole.join(digests, "digest", "left").select("doc_id", "digest", F.when(F.col("filled"), F.col("license")).alias("license"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "line", canonical(F.col("line")).alias("form")).where("form <> ''").select("doc_id", "line", F.md5("form").alias("digest"))
    hits = lines.join(digests, "digest").groupBy("doc_id").agg(F.count_distinct("line").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("found"))
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    out = whole.join(hits, whole["doc_id"].eqNullSafe(hits["hit_id"]), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("found", F.lit("")).alias("line_licenses"))
