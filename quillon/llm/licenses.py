"""Licence texts by canonical digest lookup, with DataFrame functions only.

A text's canonical form: lower case; copyright lines removed (lines that begin with a copyright notice or "all rights reserved", up to
COPYRIGHT_CHARS characters after it; a text of nothing else keeps them); punctuation and white space turned into single blanks; equivalent spellings
turned into one.  Its SHA-256 is hash-joined with the digests of known licence texts, so a document is a licence
if its entire text is.  Documents also carry notices: lines that are, in canonical form, a known notice.

The known texts are a fixed table: the short ones and the notices here, long ones in known_texts/ (verbatim copies,
named by SPDX id).  A few thousand rows of digest and id bound what is broadcast.  The text of a GNU licence does
not say "only" or "or later"; it counts as "only".  A notice without "licen" in its line is known only as an entire
text.  A null text counts as empty and is no licence.  Each row is treated alone.  Extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as words of canonical text.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "licencee": "licensee",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "organisations": "organizations",
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "whilst": "while",
    "wilful": "willful",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "https": "http",
}

COPYRIGHT_CHARS = 160
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]{0,16}(?:©|\(c\) (?:copyright|[0-9]{4})|copyright (?:\(c\)|©|[0-9]{4})|all rights reserved)[^\n]{0,%d}$" % COPYRIGHT_CHARS
NOT_WORD = r"[^\p{L}\p{N}]+"

_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_THREE = _BSD_TWO + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""

_REGENTS = (_BSD_THREE + "\n" + _BSD_END).replace("name of the copyright holder nor", "name of the University nor")
_REGENTS = _REGENTS.replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_MIT_BODY = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_DISCLAIMER}"""

_TERMS_END = "END OF TERMS AND CONDITIONS"


def _long_texts() -> list[tuple[str, str]]:
    """The files of known_texts, each also without what follows the end of its terms (how to apply them)."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("known_texts").iterdir(), key=lambda x: x.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        out.append((name, text))
        if _TERMS_END in text:
            terms = text[: text.index(_TERMS_END)]
            out += [(name, terms), (name, terms + _TERMS_END)]
    return out


def _unnumbered(text: str) -> str:
    """The same with bullets for numbers, which the canonical form drops."""
    return text.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")


# Known licence texts (from the public SPDX list), with and without their title.
TEXTS = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("BSD-2-Clause", f"{_BSD_TWO}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_TWO}\n{_BSD_END}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_END}"),
    ("BSD-3-Clause", f"{_BSD_THREE}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_THREE}\n{_BSD_END}"),
    ("BSD-3-Clause", f"The BSD 3-Clause License\n{_BSD_THREE}\n{_BSD_END}"),
    ("BSD-3-Clause", _REGENTS),
]
TEXTS += [(name, _unnumbered(text)) for name, text in TEXTS if name.startswith("BSD")]
TEXTS += _long_texts()

# Known one-line notices.  Each holds "licen" in any spelling, which picks the lines to look at.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

# The names of each licence in notices, without "the" and a final "License".
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT (MIT)", "Expat"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"],
    "ISC": ["ISC"],
    "0BSD": ["0BSD", "Zero-Clause BSD"],
    "MPL-1.1": ["MPL-1.1", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1"],
    "MPL-2.0": ["MPL-2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["zlib"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"],
}
for _short, _long, _versions in (
    ("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
    ("LGPL", "GNU Library General Public License", ("2.0",)),
    ("AGPL", "GNU Affero General Public License", ("3.0",)),
    ("GFDL", "GNU Free Documentation License", ("1.2", "1.3")),
):
    for _version in _versions:
        _told = [x for v in dict.fromkeys((_version, _version.removesuffix(".0"))) for x in (f"{_short}-{v}", f"{_short}v{v}", f"GNU {_short} v{v}", f"{_long} v{v}", f"{_long}, version {v}")]
        NAMES[f"{_short}-{_version}-only"] = _told
        NAMES[f"{_short}-{_version}-or-later"] = [x + " or later" for x in _told]  # not "+", which is no word of the canonical form
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_PORTS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _kind, _version in product(("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), _PORTS):
    _name, _port = "-".join(_PARTS[x] for x in _kind.split("-")), _PORTS[_version]
    _told = [f"CC {_kind} {_version}", f"CC {_kind} {_version} {_port}", f"Creative Commons {_kind} {_version}", f"Creative Commons {_name} {_version}", f"Creative Commons {_name} {_version} {_port}"]
    if "ND" in _kind:
        _told += [x.replace("NoDerivatives", "NoDerivs") for x in _told if "NoDerivatives" in x]
    NAMES[f"CC-{_kind}-{_version}"] = _told

# Usual wordings around a name, for any licence and for CC ones only.
WORDINGS = [
    *(f"{a} under {b}" for a in ("Licensed", "This work is licensed") for b in ("{}", "the {}", "{} License", "the {} License")),
    *(f"This {a} is licensed under the {{}} License" for a in ("project", "software", "program", "file")),
    *(f"{a} under the {{}} License" for a in ("Released", "Distributed", "Available")),
    "License: {}",
]
CC_WORDINGS = [
    *(f"{a}icensed under a {{}} License" for a in ("L", "This work is l")),
    *(f"This {a} is licensed under {b}" for a in ("document", "article", "page", "content", "text") for b in ("{}", "a {} License")),
]


def _worded() -> list[tuple[str, str]]:
    """Notices made of names, SPDX ids and wordings, and the deed addresses of CC licences."""
    told = []
    for key, names in NAMES.items():
        told.append((key, f"SPDX-License-Identifier: {key}"))
        for name in dict.fromkeys((*names, key)):
            for form in [*WORDINGS, *CC_WORDINGS] if key.startswith("CC") else WORDINGS:
                told.append((key, (form.replace(" License", "") if "icense" in name and form.endswith("{} License") else form).format(name)))
        if key.startswith("CC-"):
            kind, version = key[3:].lower().rsplit("-", 1)
            at = f"http://creativecommons.org/licenses/{kind}/{version}/"
            told += [(key, a + at + b) for a in ("", "License: ", "To view a copy of this license, visit ") for b in ("", "deed.en", "legalcode")]
            told.append((key, f"To view a copy of this license, visit {at} or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."))
    return [x for x in dict.fromkeys(told) if "licen" in x[1].lower()]


NOTICES += _worded()


def canonical(text: Column | str) -> Column:
    """The canonical form, as words between single blanks."""
    text = F.lower(text)
    words = lambda x: F.regexp_replace(x, NOT_WORD, "  ")
    kept = words(F.regexp_replace(text, "(?md)" + COPYRIGHT_LINE, " "))
    # Few texts hold a copyright notice at all; the others go through one pattern only.
    noted = text.contains("copyright") | text.contains("©") | text.contains("(c)") | text.contains("all rights reserved")
    return _spelt(F.when(noted & (F.trim(kept) != ""), kept).otherwise(words(text)))


def _spelt(words: Column) -> Column:
    """Words have two blanks between them, so each has both of its own and neighbours are exchanged alike."""
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.regexp_replace(F.trim(out), " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(known, "license_id string, text string")
    return rows.select("license_id", digest(F.col("text")).alias("sha")).groupBy("sha").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (the entire text is a licence or notice), n_notices and notices."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.lower(text), "\n", -1), lambda x: x.contains("licen"))
    told = F.when(F.lower(text).contains("licen"), F.transform(lines, digest)).otherwise(F.array().cast("array<string>"))
    table = {r["sha"]: r["license_id"] for r in known_digests(spark, NOTICES).collect()}  # the fixed table above
    # As one literal, which the plan folds to a map: thousands of literals are slow to plan.
    known = F.str_to_map(F.lit(",".join(f"{sha}:{key}" for sha, key in table.items())), F.lit(","), F.lit(":"))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("canonical_sha256"), told.alias("told"))
    notices = F.filter(F.transform("told", lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())
    whole = F.broadcast(known_digests(spark, TEXTS + NOTICES).withColumnRenamed("sha", "canonical_sha256"))  # the fixed tables above
    return found.join(whole, "canonical_sha256", "left").select(
        "doc_id",
        "canonical_sha256",
        "license_id",
        F.size(notices).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(notices)), ",").alias("notices"),
    )


def scan_sql() -> str:
    """The same in DuckDB SQL, over the view documents."""

    one = {old: new for old, new in SPELLINGS.items() if " " not in old}
    two = {old: new for old, new in SPELLINGS.items() if " " in old}
    pairs = ", ".join(f"'{old}': '{new}'" for old, new in one.items())

    def canon(x: str) -> str:
        """Split into words, exchange them by a map, join what belongs together."""
        bare = f"regexp_replace(lower({x}), '(?m){COPYRIGHT_LINE}', ' ', 'g')"
        kept = f"CASE WHEN regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]') THEN {bare} ELSE lower({x}) END"
        out = f"' ' || array_to_string(list_transform(regexp_extract_all({kept}, '[\\p{{L}}\\p{{N}}]+'), lambda w: coalesce(element_at(MAP {{{pairs}}}, w)[1], w)), '  ') || ' '"
        for old, new in two.items():
            out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return f"replace(trim({out}), '  ', ' ')"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda known: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    lookup = lambda known: f"SELECT sha256({canon('text')}) AS sha, min(license_id) AS license_id FROM (VALUES {rows(known)}) AS v(license_id, text) GROUP BY 1"
    return f"""
WITH whole AS ({lookup(TEXTS + NOTICES)}),
notice AS ({lookup(NOTICES)}),
docs AS (SELECT row_number() OVER () AS nth, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT nth, unnest(string_split(lower(text), chr(10))) AS line FROM docs),
told AS (
  SELECT l.nth, count(*) AS n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM (SELECT nth, sha256({canon("line")}) AS sha FROM lines WHERE contains(line, 'licen')) l JOIN notice k USING (sha) GROUP BY 1
)
SELECT d.doc_id, sha256({canon("d.text")}) AS canonical_sha256, w.license_id,
  coalesce(t.n, 0)::BIGINT AS n_notices, coalesce(t.ids, '') AS notices
FROM docs d LEFT JOIN whole w ON w.sha = sha256({canon("d.text")}) LEFT JOIN told t ON t.nth = d.nth
"""
