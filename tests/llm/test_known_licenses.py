"""Notices and texts of common licences, in lines and whole, in both engines."""

import pytest

from quillon.llm import licenses

CASES = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "CC-BY-NC-ND-3.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Licensed under the GNU Affero General Public License v3.0 or later.", "AGPL-3.0-or-later"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1-only"),
    ("Released under the BSD 3-Clause Licence", "BSD-3-Clause"),
    ("This project is licensed under the 3-Clause BSD License.", "BSD-3-Clause"),
    ("Distributed under the Mozilla Public License, version 2.0", "MPL-2.0"),
    ("Licensed under CC BY-NC 4.0 except the pictures.", None),
]
WHOLE = {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"}


@pytest.fixture(scope="module")
def got(spark):
    told = [f"Some text.\n{line}\nMore." for line, _ in CASES] + [text for _, text in licenses.TEXTS]
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    return docs, [tuple(r) for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_notices(got):
    for (line, key), row in zip(CASES, got[1], strict=False):
        assert row[2:] == (None, int(key is not None), key or ""), line


def test_whole_texts(got):
    found = [r[2] for r in got[1][len(CASES) :]]
    assert found == [key for key, _ in licenses.TEXTS] and set(found) >= WHOLE


def test_engines_agree(got):
    import duckdb

    documents = got[0].toPandas()  # noqa: F841  the view that the SQL reads
    assert sorted(map(str, duckdb.sql(licenses.scan_sql()).fetchall())) == sorted(map(str, got[1]))


def test_a_notice_names_one_licence(spark):
    seen = {}
    rows = spark.createDataFrame(licenses.NOTICES, "id string, text string").select("id", licenses.canonical("text").alias("words")).collect()
    assert all(seen.setdefault(words, key) == key for key, words in rows)
