import random
import re
import textwrap

import pytest

from askloom.llm import licenses

SCHEMA = "doc_id long, text string, block string, license int, begin string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "c") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_template_finds_itself(name):
    for number, wording in enumerate(licenses.TEMPLATES[name]):
        for text in (wording, wording.upper(), "  " + re.sub(" ", "\n ", wording) + " "):
            got = licenses.identify(text)
            assert (got["license"], got["variant"], got["exact"], got["confirmed"]) == (name, number, True, True)


def test_versions_and_variants_are_told_apart():
    assert licenses.identify("licensed under the GNU General Public License, version 2")["license"] == "GPL-2.0"
    assert not licenses.identify("licensed under the GNU General Public License, version 4")["confirmed"]
    assert not licenses.identify("Licensed under CC BY-NC-SA 3.0.")["confirmed"]
    assert not licenses.identify("Copyright 2020 by the author. All rights reserved.")["confirmed"]
    changed = licenses.identify(licenses.TEMPLATES["MIT"][3].replace("substantial portions", "large portions"))
    assert changed["license"] == "MIT" and changed["confirmed"] and not changed["exact"] and changed["n_missing"] == 1


def test_blocks_are_found_where_they_stand(spark):
    prose = "Plain words that say nothing of the kind. " * 50
    mit = licenses.TEMPLATES["MIT"][3]
    rows = [
        (1, prose + "\nReleased under the MIT License.\n" + prose + "Licensed under CC BY 4.0. " + prose),
        (2, mit), (3, prose), (4, None), (5, ""), (6, "word " * 100_000 + "Licensed under the Apache License, Version 2.0."),
        (7, "Released under the MIT License."), (7, "Released under the MIT License."), (None, "SPDX-License-Identifier: ISC"),
    ]
    got = licenses.scan(table(spark, rows)).collect()
    found = sorted(((r.doc_id, r.block, r.license, r.confirmed) for r in got), key=str)
    assert found == sorted(
        [(1, 0, "MIT", True), (1, 1, "CC-BY-4.0", True), (2, 0, "MIT", True), (6, 0, "Apache-2.0", True),
         (7, 0, "MIT", True), (7, 0, "MIT", True), (None, 0, "ISC", True)], key=str,
    )
    at = next(r.begin for r in got if r.doc_id == 6)
    assert at == 0  # its unit is the whole line
    assert licenses.scan(table(spark, [])).count() == 0


def test_all_lines_planted_in_the_documents_are_confirmed(spark):
    """Brute force: the documents that hold a short notice as a line of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    short = {v[0]: name for name, v in licenses.TEMPLATES.items()}
    want = {(r.doc_id, short[line]) for r in docs.collect() for line in r.text.split("\n") if line in short}
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).where("confirmed").collect()}
    assert want and want == got


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_whole_notices_pass_the_scan_verbatim_and_wrapped(spark, name):
    prose = "Plain words that say nothing of the kind.\n" * 30
    texts, want = [], []
    for number, wording in enumerate(licenses.TEMPLATES[name]):
        wrapped = textwrap.fill(wording, 72, break_on_hyphens=False, break_long_words=False)
        for text in (wording, wrapped, prose + "\n".join("# " + x for x in wrapped.split("\n")) + "\n" + prose):
            texts.append(text)
            want.append([(name, number, True)])
    got = [[(r["license"], r["variant"], r["exact"]) for r in licenses.rows_of(t) if r["confirmed"]] for t in texts]
    assert got == want
    rows = licenses.scan(table(spark, list(enumerate(texts)))).where("confirmed and exact").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))


def confirmed(text):
    return [r["license"] for r in licenses.rows_of(text) if r["confirmed"]]


def test_neighbouring_notices_are_rows_of_their_own():
    mit, isc = licenses.TEMPLATES["MIT"][3], licenses.TEMPLATES["ISC"][1]
    assert confirmed("Released under the MIT License.\nLicensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    assert confirmed("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert confirmed(f"{mit}\nLicensed under CC BY 4.0.\n{isc}\n{mit}") == ["MIT", "CC-BY-4.0", "ISC", "MIT"]
    assert confirmed("SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    listing = [licenses.TEMPLATES[name][0] for name in licenses.TEMPLATES]
    assert confirmed("\n".join(listing * 20)) == list(licenses.TEMPLATES) * 20


def test_other_names_are_not_confirmed():
    program = licenses.TEMPLATES["GPL-3.0"][2]
    assert confirmed(program) == ["GPL-3.0"]
    assert confirmed(program.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0"]
    assert confirmed(program.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0"]
    assert confirmed(licenses.TEMPLATES["GPL-2.0"][2].replace("GNU General", "GNU Library General")) == []
    cc = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."
    assert confirmed(cc.format("NonCommercial-ShareAlike")) == ["CC-BY-NC-SA-4.0"]
    assert confirmed(cc.format("NonCommercial-NoDerivatives")) == ["CC-BY-NC-ND-4.0"]
    assert confirmed(cc.format("ShareAlike-Sampling")) == []
    assert confirmed("Released under the ISC License.") == []
    # the third clause, in a licensor's own words, still makes it the three-clause license
    clause = licenses.TEMPLATES["BSD-3-Clause"][2].replace("the copyright holder nor", "Example Corporation nor")
    assert confirmed(clause) == ["BSD-3-Clause"]


def test_terms_are_found_over_any_line_break(spark):
    texts = [wording.replace(" ", "\n") for variants in licenses.TEMPLATES.values() for wording in variants]
    got = licenses.scan(table(spark, list(enumerate(texts)))).where("confirmed and exact").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))


def test_denied_notices_are_not_confirmed():
    assert confirmed("This is not released under the MIT License.") == []
    assert confirmed("It isn't released under the MIT License.") == []
    assert confirmed("Do not copy this. Released under the MIT License.") == ["MIT"]
    assert confirmed("Do not copy this\nReleased under the MIT License.") == ["MIT"]


def test_identifiers_of_versions_and_one_line_wordings():
    lines = {
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
        "SPDX-License-Identifier: EPL-2.0": "EPL-2.0", "License: MIT": "MIT", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "Licensed under the Apache License 2.0": "Apache-2.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    }
    for line, name in lines.items():
        assert confirmed(line) == [name], line
    assert confirmed("SPDX-License-Identifier: GPL-4.0-only") == []


def test_the_dictionaries_decide_what_is_compared(monkeypatch):
    """Without the dictionaries no template saves a byte, and nothing is confirmed."""
    texts = [v for variants in licenses.TEMPLATES.values() for v in variants]
    assert all(confirmed(t) for t in texts)
    compared = []
    real = licenses.aligned
    monkeypatch.setattr(licenses, "aligned", lambda *a: compared.append(a) or real(*a))
    monkeypatch.setattr(licenses, "templates", lambda known=licenses.templates(): [(n, k, w, licenses.plain()) for n, k, w, _ in known])
    assert [confirmed(t) for t in texts] == [[]] * len(texts) and not compared


def test_against_all_templates_at_all_places(monkeypatch):
    """Brute force: every window of every template's size is a candidate block."""
    rng = random.Random(5)
    names = list(licenses.TEMPLATES)
    texts = []
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(licenses.TEMPLATES[rng.choice(names)]).split()
            for _ in range(rng.choice([0, 0, 1, 2]) * (len(words) > 8)):
                words[rng.randrange(len(words))] = rng.choice(["word", "the", "free"])
            parts += ["plain"] * rng.randint(0, 6) + words
        texts.append(" ".join(parts))
    got = [confirmed(t) for t in texts]

    def every(words):
        sizes = {(len(w), int(licenses.MAX_DIFFERENCE * len(w))) for _, _, w, _ in licenses.templates()}
        return {(low, min(low + 2 * slack + size, len(words))) for size, slack in sizes for low in range(len(words))}

    monkeypatch.setattr(licenses, "proposed", every)
    assert [confirmed(t) for t in texts] == got and sum(map(len, got)) > 6
