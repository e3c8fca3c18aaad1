import re

import pytest

from placewise.llm import licenses as L


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(df):
    for r in L.license_scan(df).join(df.select("doc_id", df.text.alias("t")).distinct(), "doc_id").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_documents(documents):
    check(documents)


def test_odd_rows(spark, odd, none):
    check(odd)
    assert L.license_scan(odd).count() == odd.count()
    assert L.license_scan(none).count() == 0
    texts = ["MIT license mit LICENSE; mit.license", "apache\x00license apachelicense apache licenseé", None,
             "General Public License general public license", "the mit " * 3000 + "license", "mit license " * 3000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.mark.parametrize("text, permissive, spelled", [
    ("mit", True, "mit"), ("mit or gpl-2.0-only", True, "(mit or gpl-2.0-only)"),
    ("gpl-2.0-only with classpath-exception-2.0 or mit and isc", True,
     "((gpl-2.0-only with classpath-exception-2.0) or (mit and isc))"),
    ("(mit or gpl-3.0) and gpl-2.0", False, "((mit or gpl-3.0) and gpl-2.0)"),
    ("a and b and c", False, "((a and b) and c)")])
def test_expressions(text, permissive, spelled):
    assert (L.evaluate(text).permissive, L.evaluate(text).text) == (permissive, spelled)


@pytest.mark.parametrize("text", ["", "mit or", "(mit", "mit)", "mit mit", "or", "()", "mit; isc", "mit (isc)", "(mit or) isc"])
def test_malformed_expressions(text):
    assert L.evaluate(text) is None


def test_tags_and_notices(spark):
    texts = ["// SPDX-License-Identifier: (MIT OR Apache-2.0) */ code", "SPDX-License-Identifier: MIT OR",
             "Licensed under the Apache License, Version 2.0.", "spdx license identifier without a colon", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.expressions, r.permissive) for r in L.license_scan(df).collect()}
    assert got == {0: ("apache-2.0,mit", 1.0, "(mit or apache-2.0)", True), 1: ("", 0.0, "", None),
                   2: ("apache,apache-2.0", 0.9, "", True), 3: ("", 0.0, "", None), 4: ("", 0.0, "", None)}


@pytest.mark.parametrize("text, spelled", [
    ("SPDX-License-Identifier: MIT This file is part of it", "mit"),
    ("SPDX-License-Identifier: Apache-2.0, see LICENSE", "apache-2.0"),
    ("(SPDX-License-Identifier: MIT)", "mit"), ("'SPDX-License-Identifier: MIT'", "mit"),
    ('{"SPDX-License-Identifier": "MIT OR ISC", "a": 1}', "(mit or isc)"),
    ("It says SPDX-License-Identifier: MIT.", "mit"), ("SPDX-License-Identifier: GPL-2.0+. More text", "gpl-2.0+"),
    ("SPDX-License-Identifier: (MIT OR ISC) AND Zlib; more", "((mit or isc) and zlib)"),
    ("SPDX-License-Identifier: MIT OR, see below", "mit"),
    ("a SPDX-License-Identifier: MIT b SPDX-License-Identifier: ISC SPDX-License-Identifier: Zlib", "isc;mit;zlib"),
    ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: (MIT\nSPDX-License-Identifier: MIT AND\nSPDX-License-Identifier:\n", ""),
    ("SPDX-License-Identifier: (MIT this file", ""), ("SPDX-License-Identifier: mité and more", ""),
    ("SPDX-License-Identifier: MIT */ x SPDX-License-Identifier: ISC -->", "isc;mit")])
def test_tags_among_other_text(text, spelled):
    found = L.scan(text.encode(), L.automaton(L.BASE, L.NOTICES))
    assert found[7] == spelled and found[6] == (1.0 if spelled else 0.0)


def test_long_lines_are_read_once():
    text = b"SPDX-License-Identifier: MIT and so on, " * 20000 + b"x " * 500000
    assert L.scan(text, L.automaton(L.BASE, L.NOTICES))[7] == "mit"
    text = b"SPDX-License-Identifier: " + b"mit and " * 200000 + b"isc"
    assert L.scan(text, L.automaton(L.BASE, L.NOTICES))[5] == "isc,mit"


@pytest.mark.parametrize("text, labels, score, spelled, permissive", [
    ("SPDX-License-Identifier: MIT\nGNU General Public License version 3", "gpl,gpl-3.0,mit", 1.0, "mit", False),
    ("SPDX-License-Identifier: GPL-2.0-only OR MIT\nMIT License", "gpl-2.0-only,mit", 1.0, "(gpl-2.0-only or mit)", True),
    ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MPL-2.0", "mit,mpl-2.0", 1.0, "mit;mpl-2.0", False),
    ("SPDX-License-Identifier: see license", "unknown", 0.3, "unknown", False),
    ("SPDX-License-Identifier: see license. MIT license", "mit,unknown", 0.6, "unknown", False),
    ("SPDX-License-Identifier: MIT AND Acme-1.0", "mit,unknown", 1.0, "(mit and unknown)", False),
    ("SPDX-License-Identifier: MIT AND proprietary", "mit,unknown", 1.0, "(mit and unknown)", False),
    ("SPDX-License-Identifier: MIT or so they say", "mit", 1.0, "mit", True),
    ("SPDX-License-Identifier: LicenseRef-Acme OR ISC", "isc,licenseref-acme", 1.0, "(licenseref-acme or isc)", True),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "classpath-exception-2.0,gpl-2.0+", 1.0,
     "(gpl-2.0+ with classpath-exception-2.0)", False)])
def test_findings_together(text, labels, score, spelled, permissive):
    found = L.scan(text.encode(), L.automaton(L.BASE, L.NOTICES))
    assert found[5:] == (labels, score, spelled, permissive)
