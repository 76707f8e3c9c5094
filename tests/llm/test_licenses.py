"""License detections against a plain scan of all rules at all places."""

import random
import re

import pytest
from conftest import az, sentence

from tabulon.llm import license_rules as lr
from tabulon.llm.license_scan import scan_licenses

RULES = lr.rules()
COMPILED = [re.compile(r.pattern) for r in RULES]
GOT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]


def brute(text):
    """Every rule at every word that is its keyword, on the whole text; then all pairs of detections."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", az(text))
    known, found = {r.keyword for r in RULES}, []
    for i, word in enumerate(words):
        if word not in known:
            continue
        before, after = words[max(0, i - 60) : i], words[i + 1 : i + 61]
        around = " " + "".join(w + " " for w in before) + "@" + " ".join([word, *after]) + " "
        for place, (rule, pattern) in enumerate(zip(RULES, COMPILED)):
            if rule.keyword == word and (m := pattern.search(around)):
                start = i - m[0].split("@")[0].count(" ") + 1
                found.append((start, start + m[0].count(" ") - 1, rule.priority, place, rule.label, rule.weight))
    kept = [
        a for a in found
        if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[0], -b[1], -b[2], b[3]) < (a[0], -a[1], -a[2], a[3]) for b in found)
    ]
    base = [f for f in found if f[2] == lr.BASE]
    labels = {f[4] for f in kept} | {f[4] for f in base}
    starts = [f[0] for f in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({f[4] for f in base})), ",".join(sorted(labels)),
        max((f[5] for f in kept), default=0.0), len(kept),
    )


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in GOT) for r in scan_licenses(df).collect()}
    return [got[i] for i in range(len(texts))]


def sample_of(rng, pattern):
    """Words that the pattern matches, with optional parts at random."""
    p = pattern.replace("@", "").replace("licen[sc]e", rng.choice(["license", "licence"])).replace("(?:[^ ]+ ){1,8}", "acme inc ")
    while m := re.search(r"\(\?:([^()]*)\)(\?)?", p):
        p = p[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + p[m.end() :]
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", p).strip()


def test_every_rule_finds_its_own_words(spark):
    rng = random.Random(2)
    texts = [sample_of(rng, r.pattern) for r in RULES]
    got = scanned(spark, texts)
    for rule, text, pattern, row in zip(RULES, texts, COMPILED, got):
        at = " " + re.sub(rf"(^| ){rule.keyword}(?= |$)", rf"\1@{rule.keyword}", text, count=0) + " "
        assert pattern.search(at) or at.count("@") > 1, (rule, text)
        assert row[6] >= rule.weight, (rule, text, row)
    for text, row in zip(texts[::9], got[::9]):
        assert row == brute(text), text


def test_rules_fit_their_windows():
    """No rule reaches farther than the windows, with every optional part there."""
    for rule in RULES:
        longest = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m[1].split("|"), key=lambda s: s.count(" ")), rule.pattern.replace("(?:[^ ]+ ){1,8}", "w " * 8))
        longest = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m[1].split("|"), key=lambda s: s.count(" ")), longest)
        longest = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m[1].split("|"), key=lambda s: s.count(" ")), longest).replace(" ?", " ")
        left, _, right = longest.strip().partition("@")
        assert "(" not in longest and left.count(" ") <= lr.LEFT and right.count(" ") <= lr.RIGHT, rule
        assert re.match("[0-9a-z]+( |$)", rule.pattern.split("@")[1].replace("(?:", " ").strip()), rule


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2", 0.95),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", 0.9),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later", 0.95),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later", 1.0),
        ("SPDX-License-Identifier: MIT", "mit", 1.0),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4", 0.95),
        ("a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4", 0.95),
        ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3", 1.0),
        ("Released under the MIT License or GPLv3", "gpl-3,mit", 0.95),
        ("mit der Lizenz", "", 0.0),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", 0.95),
        ("BSD 3-Clause", "bsd-3-clause", 0.9),
        ("All rights reserved.", "proprietary", 0.4),
        ("", "", 0.0),
        (None, "", 0.0),
    ],
)
def test_examples(spark, text, labels, score):
    (row,) = scanned(spark, [text])
    assert (row[5], row[6]) == (labels, score) and row == brute(text)


def test_against_a_plain_scan(spark, texts):
    rng = random.Random(6)
    mixed = []
    for _ in range(120):
        parts = [rng.choice([sentence(rng, rng.randint(0, 5)), sample_of(rng, rng.choice(RULES).pattern), "under the mit license", "cc by nc", "apache license version 2"]) for _ in range(rng.randint(1, 9))]
        mixed.append(rng.choice([" ", ", ", "\n", "-"]).join(parts))
    mixed += ["under the mit license " * 3, "cc by nc cc by nc cc-by-nc", "under the MİT license", "apache license version 20", "UNDER THE MIT LICENSE", "mit " * 4000 + "license"]
    mixed += texts
    for text, row in zip(mixed, scanned(spark, mixed)):
        assert row == brute(text), text


def test_very_long_text_and_awkward_rows(spark, awkward, nothing):
    text = "under the mit license, gnu general public license version 3 or later and more\n" * 60_000
    (row,) = scanned(spark, [text])
    assert row == (14 * 60_000, 60_000, 0, 14 * 59_999, "mit", "gpl-3-or-later,mit", 0.95, 120_000)
    rows = scan_licenses(awkward).collect()
    assert sorted(map(str, ((r["doc_id"], *(r[c] for c in GOT)) for r in rows))) == sorted(str((r["doc_id"], *brute(r["text"]))) for r in awkward.collect())
    assert scan_licenses(nothing).count() == 0
