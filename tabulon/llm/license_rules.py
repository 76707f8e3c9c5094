"""Ordered signature rules of licenses.

A rule is a regular expression over lower-cased words with one blank between them. ``@`` stands
before its keyword: the word that must be there before the rule is tried at all. Most rules are
templates filled in with the names and versions of a family. Patterns keep to what Java's and
RE2's expressions have in common, and reach at most LEFT words back and RIGHT words ahead.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

LEFT, RIGHT = 16, 32

# What a rule rests on, from the weakest: a bare name, a name called a license, a version, a
# condition on versions or a text only this license has, an identifier. A base phrase outranks all.
NAME, LICENSE, VERSION, CONDITION, IDENTIFIER, BASE = range(6)
# How sure each of them is.
WEIGHTS = (0.4, 0.7, 0.9, 0.95, 1.0, 0.95)


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


LEAD = "(?:(?:licensed |released |distributed |available |provided |published |covered )?(?:under |by )(?:the )?(?:terms of the )?)?"
LICENSED = " (?:public )?licen[sc]e"
V = "(?: version| v| ver| release)?"
SINCE = "(?: of the licen[sc]e)?(?: or| and)?(?: at your option)?(?: any)? (?:later|newer)(?: version)?"
ISSUED = "(?: as published by the free software foundation)?(?: either)?"

# Label, spelled-out names after an optional lead, identifiers, versions.
FAMILIES = (
    ("gpl", ("@gnu general",), ("@gpl",), ("1", "2", "3")),
    ("lgpl", ("@gnu lesser general", "@gnu library general"), ("@lgpl",), ("2", "2.1", "3")),
    ("agpl", ("@gnu affero general", "@affero general"), ("@agpl",), ("1", "3")),
    ("gfdl", ("@gnu free documentation",), ("@gfdl",), ("1.1", "1.2", "1.3")),
    ("apache", ("@apache", "@apache software"), ("@asl", "@apache"), ("1", "1.1", "2")),
    ("mpl", ("@mozilla",), ("@mpl",), ("1", "1.1", "2")),
    ("epl", ("@eclipse",), ("@epl",), ("1", "2")),
    ("cddl", ("common @development and distribution",), ("@cddl",), ("1", "1.1")),
    ("cpl", ("@common",), ("@cpl",), ("0.5", "1")),
    ("eupl", ("@european union",), ("@eupl",), ("1", "1.1", "1.2")),
    ("cecill", ("@cecill free software",), ("@cecill",), ("1", "1.1", "2", "2.1")),
    ("afl", ("@academic free",), ("@afl",), ("1.1", "1.2", "2", "2.1", "3")),
    ("osl", ("@open software",), ("@osl",), ("1", "2", "2.1", "3")),
    ("artistic", ("@artistic", "perl @artistic"), ("@artistic",), ("1", "2")),
    ("bsl", ("@boost software",), ("@bsl",), ("1",)),
    ("ofl", ("sil open @font", "@sil open font"), ("@ofl",), ("1", "1.1")),
    ("php", ("@php",), ("@php",), ("3", "3.01")),
    ("python", ("@python software foundation", "@psf"), ("@psf", "@python"), ("2",)),
    ("zpl", ("@zope",), ("@zpl",), ("1.1", "2", "2.1")),
    ("lppl", ("@latex project",), ("@lppl",), ("1", "1.1", "1.2", "1.3")),
    ("ecl", ("@educational community",), ("@ecl",), ("1", "2")),
    ("sspl", ("@server side",), ("@sspl",), ("1",)),
    ("odbl", ("open @database", "@odc open database"), ("@odbl",), ("1",)),
    ("upl", ("@universal permissive",), ("@upl",), ("1",)),
    ("mulan", ("@mulan permissive software", "@mulan psl"), ("@mulan psl",), ("1", "2")),
)
# Licenses without versions.
PLAIN = (
    ("mit", "@mit(?: x11)?"), ("mit", "@expat"), ("isc", "@isc"), ("zlib", "@zlib"), ("zlib", "@zlib libpng"), ("ncsa", "@ncsa"),
    ("bsd-2-clause", "@simplified bsd"), ("bsd-2-clause", "@freebsd"), ("bsd-3-clause", "@modified bsd"), ("bsd-3-clause", "new @bsd"),
    ("bsd-3-clause", "revised @bsd"), ("bsd-4-clause", "original @bsd"), ("bsd", "@bsd(?: style)?"), ("wtfpl", "do what the fuck you want to @public"),
    ("ms-pl", "@microsoft(?: public)?"), ("ms-rl", "@microsoft reciprocal"), ("postgresql", "@postgresql"), ("curl", "@curl"), ("openssl", "@openssl"),
    ("vim", "@vim"), ("ruby", "@ruby"), ("json", "@json"), ("x11", "@x11"), ("hpnd", "historical @permission notice and disclaimer"),
    ("intel", "@intel open source"), ("libtiff", "@libtiff"), ("info-zip", "@info zip"), ("ijg", "independent @jpeg group"),
)
# The conditions of attribution licenses, short and spelled out.
CONDITIONS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:s|atives)"), ("by-nc", "attribution non ?commercial"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
)
CC_VERSIONS = ("1", "2", "2.5", "3", "4")
# Texts and notices that point to one license or kind of license.
TEXTS = (
    ("mit", "@permission is hereby granted free of charge to any person obtaining a copy", CONDITION),
    ("mit", "the software is provided as is without @warranty of any kind express or implied including but not limited to", LICENSE),
    ("isc", "@permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", CONDITION),
    ("bsd", "@redistribution and use in source and binary forms with or without modification are permitted", CONDITION),
    ("bsd-3-clause", "@neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|his|her|their) contributors", CONDITION),
    ("bsd-4-clause", "all @advertising materials mentioning features or use of this software must display", CONDITION),
    ("zlib", "any express or @implied warranty in no event will the authors be held liable", CONDITION),
    ("unlicense", "this is free and @unencumbered software released into the public domain", CONDITION),
    ("unlicense", "the @unlicense", LICENSE), ("unlicense", "@unlicense org", LICENSE),
    ("wtfpl", "@wtfpl", NAME),
    ("gpl", "this program is free software you can @redistribute it and or modify it", LICENSE),
    ("gpl", "gnu @copyleft", NAME), ("copyleft", "@copyleft", NAME),
    ("public-domain", "(?:in|into|to) the @public domain", LICENSE), ("public-domain", "@public domain dedication", CONDITION),
    ("cc0", "@cc0(?: 1(?: 0)?)?", VERSION), ("cc0", "@creative commons zero(?: 1(?: 0)?)?", VERSION), ("pddl", "@pddl(?: 1(?: 0)?)?", VERSION),
    ("proprietary", "all @rights reserved", NAME), ("proprietary", "@proprietary and confidential", LICENSE),
    ("proprietary", "@unauthorized (?:copying|use|reproduction)(?: or (?:copying|use|reproduction|distribution))? (?:of this (?:file|software|material) )?is (?:strictly )?prohibited", LICENSE),
    ("commercial", "@commercial licen[sc]e", LICENSE), ("noncommercial", "for non @commercial use only", LICENSE),
    ("noncommercial", "@noncommercial use only", LICENSE), ("research-only", "for research @purposes only", LICENSE),
    ("eula", "end user licen[sc]e @agreement", LICENSE),
)
# The phrases of the contract.
BASE_PHRASES = (("mit", "under the @mit license"), ("apache-2", "@apache license version 2"), ("cc-by-nc", "@cc by nc"))


def _words(version: str) -> str:
    """A version as words: 2 or 2 0, 2 1, 3 01."""
    head, _, tail = version.partition(".")
    return f"{head} {tail}" if tail else f"{head}(?: 0)?"


def _versions() -> Iterator[tuple[str, str, int]]:
    for family, names, shorts, versions in FAMILIES:
        for name in names:
            yield family, f"{LEAD}{name}{LICENSED}", LICENSE
        for short in shorts:
            if short.count(" ") or family not in ("apache", "php", "python", "artistic", "cecill"):
                yield family, f"{LEAD}{short}", NAME
        for v in versions:
            label, words = f"{family}-{v}", _words(v)
            for name in names:
                yield label, f"{LEAD}{name}{LICENSED}{ISSUED}{V} {words}", VERSION
                yield f"{label}-or-later", f"{LEAD}{name}{LICENSED}{ISSUED}{V} {words}{SINCE}", CONDITION
            for short in shorts:
                yield label, f"{LEAD}{short}{V} {words}", VERSION
                yield f"{label}-or-later", f"{LEAD}{short}{V} {words}(?: plus|{SINCE})", CONDITION
                yield label, f"{LEAD}{short}{V} {words} only", CONDITION
                if " " not in short:
                    # Written as one word: gplv2, gpl3.
                    for glued in (f"{short}v{v.replace('.', ' ')}", f"{short}{v.replace('.', ' ')}"):
                        yield label, f"{LEAD}{glued}(?: 0)?", VERSION
                        yield f"{label}-or-later", f"{LEAD}{glued}(?: 0)?{SINCE}", CONDITION
            yield label, f"@spdx licen[sc]e identifier {family} {words}(?: only)?", IDENTIFIER
            yield f"{label}-or-later", f"@spdx licen[sc]e identifier {family} {words} or later", IDENTIFIER


def _plain() -> Iterator[tuple[str, str, int]]:
    for label, name in PLAIN:
        yield label, f"{LEAD}{name}{LICENSED}", LICENSE
    for label in sorted({label for label, _ in PLAIN}):
        yield label, f"@spdx licen[sc]e identifier {label.replace('-', ' ')}", IDENTIFIER
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        yield f"bsd-{n}-clause", f"{LEAD}@bsd (?:{n}|{word}) clause(?: licen[sc]e)?", VERSION
        yield f"bsd-{n}-clause", f"{LEAD}(?:{n}|{word}) clause @bsd(?: licen[sc]e)?", VERSION


def _attribution() -> Iterator[tuple[str, str, int]]:
    for short, spelled in CONDITIONS:
        words, label = short.replace("-", " "), f"cc-{short}"
        for lead in (f"{LEAD}@cc {words}", f"{LEAD}(?:an? )?@creative commons {spelled}"):
            yield label, lead, LICENSE
            for v in CC_VERSIONS:
                yield f"{label}-{v}", f"{lead}{V} {_words(v)}", VERSION
                yield f"{label}-{v}", f"{lead}{V} {_words(v)} (?:international|unported|generic)(?: licen[sc]e)?", CONDITION
        for v in CC_VERSIONS:
            yield f"{label}-{v}", f"@creativecommons org licenses {words} {_words(v)}", IDENTIFIER
            yield f"{label}-{v}", f"@spdx licen[sc]e identifier cc {words} {_words(v)}", IDENTIFIER
    yield "cc", f"{LEAD}@creative commons(?: licen[sc]e)?", NAME
    yield "cc0", "@creativecommons org publicdomain zero(?: 1(?: 0)?)?", IDENTIFIER


def rules() -> list[Rule]:
    """All rules, the order of equals being that of this list."""
    base = ((label, pattern, BASE) for label, pattern in BASE_PHRASES)
    every = dict.fromkeys([*base, *_versions(), *_plain(), *_attribution(), *TEXTS])
    return [Rule(label, re.search("@([0-9a-z]+)", p)[1], f" {p} ", priority, WEIGHTS[priority]) for label, p, priority in every]
