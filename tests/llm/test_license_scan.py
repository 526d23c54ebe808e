import re

from conftest_llm import ODD, frame
from normlake.llm.license_scan import BASE, STEMS, rules, scan


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text):
    w = words(text)
    body = " " + "  ".join(w) + " "
    found = []
    for number, label, priority, _, regex, base in rules():
        for m in re.finditer(regex, body):
            first = body[: m.start()].count(" ") // 2
            found.append((first, first + m[0].count(" ") // 2, priority, number, label, base))
    stays = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[3] < d[3])) for e in found)]
    base = [d for d in found if d[5]]
    return (len(w), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})),
            ",".join(sorted({d[4] for d in base} | {d[4] for d in stays})), max((d[2] for d in stays), default=0) / 5)


TEXTS = [
    "Licensed under the Apache License, Version 2.0", "MIT license mit-License MIT\nlicense", "SPDX-License-Identifier: GPL v3", "gnu lesser general public licence version 3 and the GNU General Public License",
    "This work is licensed under CC BY-NC 4. Creative   Commons: attribution!", "all rights reserved. Copyright (c) 2020", "nothing here", "emit license", "mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit license " * 300, "ümit license mit ólicense",
]


def test_against_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_rules():
    made = rules()
    assert len(made) > 300 and [r[5] for r in made[: len(BASE)]] == [True] * len(BASE) and len({r[0] for r in made}) == len(made)
    for *_, regex, _ in made:
        re.compile(regex)


def test_prefilter_loses_nothing():
    stems = re.compile("(?i)" + "|".join(STEMS))
    for text in TEXTS:
        assert not brute(text)[5] or stems.search(text), text


def test_empty_table(nothing):
    assert scan(nothing).collect() == []


def shortest(regex):
    """A text that a rule's regex matches, with optional words left out and the first of alternatives."""
    while (left := re.sub(r"\(\?:[^()]*\)[?*]", "", regex)) != regex:
        regex = left
    while (left := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", regex)) != regex:
        regex = left
    return re.sub(r"\[(.)[^\]]*\]\+?", r"\1", regex.replace("v?", "")).strip()


def test_gate_lets_the_shortest_text_of_every_rule_through():
    gate = re.compile("(?i)" + "|".join(STEMS))
    for *_, regex, _ in rules():
        text = re.sub(" +", "-", shortest(regex)).upper()
        body = " " + "  ".join(words(text)) + " "
        assert re.search(regex, body), (regex, text)
        assert gate.search(text) and gate.search(f"see {text}."), text


def test_names_without_the_word_license(spark):
    texts = {"Released under BSD-3-Clause.": "bsd-3", "BSD 2-Clause": "bsd-2", "two clause BSD": "bsd-2", "MIT No Attribution": "mit-0"}
    got = {r.doc_id: r.labels for r in scan(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


TAGS = [("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: Apache-2.0 */", "apache"), ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: EPL-2.0", "epl"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: LGPL-2.1+", "lgpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("GPLv3", "gpl"), ("LGPLv2.1 or later", "lgpl"), ("under AGPLv3", "agpl"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache,mit"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT AND ISC OR BSD-2-Clause", "bsd-2,gpl,isc,mit"), ("mit Rat und Tat or mit Kaffee, isc", "")]


def test_identifiers_in_tags(spark):
    rows = [(i, text, "en", "s") for i, (text, _) in enumerate(TAGS)]
    got = {r.doc_id: r.labels for r in scan(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        assert got[i] == brute(text)[5], text
    assert [got[i] for i in range(len(TAGS))] == [labels for _, labels in TAGS]
