"""Licence scan by canonical digests of whole texts.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings, white space) and its
sha256 is looked up among the digests of known licences.  A unit of lookup is a whole text, or each of its lines, which
finds notices that stand in a text of another kind.

A null text is an empty one. A text without any word has a digest but never a licence. Texts that share a digest, and
repeated rows, get the same answer, whatever their ids; texts of any length are read whole; an empty table gives an empty
result. Where two known licences share a digest, all their names are given, sorted. Further
columns are kept; those with the name of a result give way. An empty list of licences finds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm.shared import fresh

#: Spellings that count as the same (fixed values, after the public SPDX matching guidelines).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
)
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Known notices and short licence texts (fixed values, from the public texts of these licences).
KNOWN = {
    "CC-BY-NC-4.0-notice": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "MIT-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0-notice": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-notice": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "CC-BY-4.0-notice": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_2 + _BSD_END],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_2 + _BSD_3 + _BSD_END],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ],
}

#: Canonical digests of full licence texts, with and without what follows their terms.
KNOWN_DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "420688ab3b3c728afdd8a34d106b4a988d12871784d9885bb0fdcaa75461a4b5",
        "a95fa0a05edb269713306c2717cefb588335995f52a6bd587fdf3b5b754c25d9",
        "b59d5561c6b77e3936431d05aeedd0011c17342a8c1265454cc94a6a64c8f284",
    ],
    "Artistic-1.0-Perl": [
        "0f24cb79dc351638292314915bf3264ea4c59f0d7f48ef78970e3b66ddbfa969",
    ],
    "BSD-3-Clause": [
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ],
    "CC0-1.0": [
        "92a2fdd680bdd28569892506860e7129333338885122ec2ad2757c247cdae515",
    ],
    "GFDL-1.2": [
        "df343c50a36f39ba5304b6a87cb8b27709d721c05001a9fe656f27765b04dd68",
    ],
    "GFDL-1.3": [
        "31ef4b24b7d9d0b4c0c8c1b0a352cadbba89f4156aa0e710ed3deefc030ae5f7",
    ],
    "GPL-1.0": [
        "5eb8407c6ee1e7041984f0106a1a562778e28094800f4304b3cb7dda821cd721",
        "92e81bc4d13de9fabf3bfbd77d63b8718f75c0108778e6370beb14f52df6f748",
        "e1bf9b48b9a8a7088fda4e4f92b2362957834e89f81e8e812d797dbd51bdd887",
    ],
    "GPL-2.0": [
        "11abb0ac03412ac9949f7f16d0e2fec5f1e653d11fa2a75e756de9761582233b",
        "1b309efb9478ba5d872d3db37d291f086f017bd9ef752dcf6b26dead2a932e94",
        "68afa109ae004f9e91dd5ff80f9c4caea55a72677a7f4217b9af9ba88a775a8e",
    ],
    "GPL-3.0": [
        "9cbb2d79df456d6714eb5e172f6c0a679c173c7e4c53ed613c2d7d14740a8b57",
        "c4257965ceeeb0e8f143cd8bffdffc91e0afb5c273ced4c29415abd87c6f11c6",
        "cc2146c329a458b4e36771d965eff45351fdc42da366a2dc8392c3fca3bdad2c",
    ],
    "LGPL-2.0": [
        "5b7bbd26c192d8fbf0811ec1ed6ff634f4c2627e130a8e5d49c364b382491abd",
        "6a60b3199eeaf64f13c101c1b34c3a2265fc678598cea627aae65a03b1a67b63",
        "dd68df3a5df41b2a151fe04b6b603a062d59fb6d39b70e9bb0d379d68e343df7",
    ],
    "LGPL-2.1": [
        "2b273a008299da4bd449e43b2e207b22d1f196e11c114e0241c09499d509dc03",
        "51d7d5bbcdcac2f30a56919a0b877dd376850641a5966851b07cdf8878a89679",
        "e23f5d9a44cd5d1e7c16b775cb99c62a95c0ea9aa1741cf9bc59f16d90b37cd2",
    ],
    "LGPL-3.0": [
        "bf5bfec7ab21554b41cc64143a0a81495ead362672df030cd61628c0bb4dfa02",
    ],
    "MPL-1.1": [
        "0f09639e02d936b7dd660398d8f7a339540409238d3d5498b3d6780ee5239bf6",
        "5e88d3b3c281699815eebfefdfd6e2a12fd90c90e0aa1aaeeb88bfc84c651b0c",
    ],
    "MPL-2.0": [
        "4d19c03862394ef19cbfff6ac79a30702dffec69df420e052df5a0b1b12135ad",
        "dc980ed3eb96bebe8b779b2919093853340b3629110b6e210891bb8cf6ddf03e",
    ],
}

#: Title lines before a licence, in lower case.
_TITLE = (
    r"(?:the\s+)?(?:mit|expat|isc|zlib|(?:new |modified |revised |simplified )?bsd(?:[- ][0234][- ]clause)?|[0234][- ]clause bsd)"
    r"(?: \W?[\w -]+\W)? licen[cs]e(?: \([^()\n]*\))?"
    r"|bsd[- ][0234][- ]clause|apache licen[cs]e(?:,? version 2\.0)?(?:, january 2004)?|version 2\.0, january 2004|https?://www\.apache\.org/licenses/?"
    r"|gnu (?:(?:lesser|library|affero) )?general public licen[cs]e|gnu free documentation licen[cs]e"
    r"|version \d(?:\.\d)?,? (?:\d+ )?(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{4}"
    r"|mozilla public licen[cs]e(?:,? version [12]\.[01])?|version [12]\.[01]|creative commons legal code|cc0 1\.0 universal|the \W?artistic licen[cs]e\W?"
)
#: Title and copyright lines that a text begins with; something must follow.
_HEADER = rf"\A(?:[^\p{{L}}\p{{N}}(©]*(?:(?:{_TITLE})[^\p{{L}}\p{{N}}\n]*|(?:copyright|\(c\)|©)[^\n]*|all rights reserved[^\w\n]*)\n){{1,20}}"
#: Copyright lines further down, which a line of the terms that is broken before "copyright" is not; and the last line.
_COPYRIGHT = (
    r"(?m)^[^\w\n]*(?:copyright\b[^\n]*(?:\(c\)|©|\b(?:19|20)\d\d\b|<year>|\[yyyy\])|\(c\)\W*(?:copyright|(?:19|20)\d\d)|©)[^\n]*$"
    r"|^[^\w\n]*(?:copyright|\(c\)|©)[^\n]*\s*\z|all\s+rights\s+reserved\.?"
)

#: Known digests up to which their table is broadcast; a longer list is joined by shuffle.
BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words, one space between, copyright lines and title lines of licences left out."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, _HEADER, ""), _COPYRIGHT, "")
    t = F.regexp_replace(t, r"(?<=\p{L})-(?=\p{L})", "")
    words = F.array_remove(F.split(t, r"[^\p{L}\p{N}]+"), "")
    same = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")


def known_licenses(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """Rows (license, text, digest): the built-in ones, which have a text or a digest, and ``more`` (license, text)."""
    rows = [(n, t, None) for n, ts in KNOWN.items() for t in ts] + [(n, None, d) for n, ds in KNOWN_DIGESTS.items() for d in ds]
    own = spark.createDataFrame(rows, "license string, text string, digest string")
    return own if more is None else own.union(more.select("license", "text", F.lit(None).cast("string")))


def digests(known: DataFrame) -> DataFrame:
    """Rows (digest, licenses): each canonical digest once; ``known`` may give digests in place of texts."""
    given = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    form = known.where("license is not null").select("license", given.alias("given"), canonical(F.col("text")).alias("form"))
    form = form.where("given is not null or form <> ''")
    named = form.select(F.coalesce("given", F.sha2("form", 256)).alias("digest"), "license")
    return named.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else table


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``digest`` of the whole canonical text and ``license``, the known licence it is, else null."""
    own = docs.select([c for c in docs.columns if c not in ("digest", "license")])
    marked = own.withColumn("digest", F.sha2(canonical(F.col(text)), 256))
    table = _sized(digests(known).select("digest", F.col("licenses").alias("license")))
    return marked.join(table, "digest", "left").select(*own.columns, "digest", "license")


def notices(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, line, license): lines (from 0) whose canonical digest is that of a known licence."""
    line, at = fresh(docs, "line", "at")
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias(at, line))
    lines = lines.where(F.col(line).rlike(r"[\p{L}\p{N}]"))
    marked = lines.select("doc_id", F.col(at).alias("line"), F.sha2(canonical(F.col(line)), 256).alias("digest"))
    return marked.join(_sized(digests(known)), "digest").select("doc_id", "line", F.col("licenses").alias("license"))
