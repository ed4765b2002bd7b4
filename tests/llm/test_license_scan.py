import pytest

from postflow.llm import license_scan
from postflow.llm.license_scan import SENTENCES


def scanned(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return [(r.licenses, r.unmatched) for r in license_scan.scan(docs).orderBy("doc_id").collect()]


def text(*ids):
    return "\n".join(SENTENCES[i] for i in ids)


MIT = ("MIT-GRANT", "MIT-NOTICE", "MIT-WARRANTY", "MIT-LIABILITY")


def test_licences(spark):
    wrapped = text(*MIT).replace(", ", ",\n * ")
    cases = {
        text(*MIT): ("MIT", ""),
        "Some prose without a stop\n" + wrapped + "\nMore prose.": ("MIT", ""),
        text(*MIT[:2]): ("", "MIT-GRANT|MIT-NOTICE"),
        text("BSD-GRANT") + "\n\n1. " + text("BSD-SOURCE") + "\n2. " + text("BSD-BINARY", "BSD-WARRANTY"): ("BSD-2-Clause", ""),
        text("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "BSD-WARRANTY"): ("BSD-3-Clause", ""),
        text("APACHE-HEADER", "APACHE-USE", "APACHE-WARRANTY"): ("Apache-2.0", ""),
        text("GPL3-GRANT"): ("GPL-3.0-or-later", ""),
        "x.\nLicensed under CC BY-NC 4.0.\ny. All rights reserved.": ("CC-BY-NC-4.0|LicenseRef-All-Rights-Reserved", ""),
        "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0", ""),
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ("MIT|Apache-2.0", ""),
        "// SPDX-License-Identifier: GPL-2.0-or-later": ("GPL-2.0-or-later", ""),
        text("MPL-FORM"): ("MPL-2.0", ""),
        "Licensed under the Made Up License.": ("", ""),
        "The licence of poets": ("", ""),
        "": ("", ""),
    }
    assert scanned(spark, *cases) == list(cases.values())


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, "x"), (1, "Released under the MIT License. " * 3, "y"), (1, "word " * 200_000 + "Released under the MIT License.", "z")],
        "doc_id BIGINT, text STRING, licenses STRING",
    )
    rows = license_scan.scan(docs).collect()
    assert sorted((r.licenses, r.sentence_ids.count("|")) for r in rows) == [("", 0), ("MIT", 0), ("MIT", 2)]
    assert license_scan.scan(docs.where("false")).collect() == []


@pytest.mark.parametrize("name", SENTENCES)
def test_every_sentence_is_its_own_identifier(spark, name):
    normal = license_scan.identifiers()
    assert name in normal.values()
