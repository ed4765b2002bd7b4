"""Licences whose clauses name their holder, and further conditions between clauses."""

import pytest
from test_license_scan import MIT, scanned, text

from postflow.llm.license_scan import SENTENCES

NAMES, WARRANTY = SENTENCES["BSD-NAMES"], SENTENCES["BSD-WARRANTY"]
TWO = text("BSD-GRANT") + "\n\n1. " + text("BSD-SOURCE") + "\n2. " + text("BSD-BINARY") + "\n"
HOLDERS = ["Google Inc.", "the University of California, Berkeley", "the <ORGANIZATION>", "Acme Co.,\n * Ltd."]


@pytest.fixture(scope="module")
def found(spark):
    cases = {}
    for holder in HOLDERS:
        names = NAMES.replace("the copyright holder", holder)
        cases[f"{TWO}3. {names}\n\n{WARRANTY}"] = "BSD-3-Clause"
        warranty = WARRANTY.replace("the copyright holders and contributors", holder).upper()
        cases[f"{TWO}\n{warranty}"] = "BSD-2-Clause"
        cases[f"{TWO}3. {names} {warranty}"] = "BSD-3-Clause"
        cases[text("ISC-GRANT") + "\n\n" + SENTENCES["ISC-WARRANTY"].replace("the author", holder).upper()] = "ISC"
    cases[text("ISC-GRANT") + "\n" + SENTENCES["ISC-WARRANTY"].replace("the author disclaims", "THE AUTHOR(S) DISCLAIM")] = "ISC"
    cases[text(*MIT).replace("the authors or copyright holders", "THE AUTHOR(S)")] = "MIT"
    # further conditions: neither of the shorter licences
    cases[f"{TWO}3. All advertising materials must display an acknowledgement.\n{WARRANTY}"] = ""
    cases[f"{TWO}3. All advertising materials must display an acknowledgement.\n4. {NAMES}\n{WARRANTY}"] = ""
    cases[f"Some words before it. {TWO}{WARRANTY}\nSome words behind it. {text(*MIT)}"] = "MIT|BSD-2-Clause"
    return list(cases.items()), [licenses for licenses, _ in scanned(spark, *cases)]


def test_holders_and_further_conditions(found):
    cases, licenses = found
    assert [(c, got) for (c, want), got in zip(cases, licenses) if got != want] == []
