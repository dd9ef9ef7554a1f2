"""Signature rules of the license scan, written on texts reduced to lower-case words.

A license gives its label, a regex for its name, its identifiers, the words of its usual web address, and
passages of its text. ``rules()`` turns each license into its ordered rules. What a text must hold before a
regex is tried is read off the regex, for each of its alternatives, and so is ``GATE``.
"""

from __future__ import annotations

import re._parser as sre
from collections.abc import Callable, Iterator

V = r"(?: version)?(?: v)? ?"
LICENSES = [
    # label, name, identifiers, address words, passages
    ("mit", r"(?:the )?(?:mit|expat|x11) license", "mit|expat|x11", "opensource org licenses mit",
     [r"permission is hereby granted free of charge to any person obtaining a copy of this software and"
      r" associated documentation files"]),
    ("mit-0", r"mit no attribution(?: license)?", "mit 0", "opensource org licenses mit 0",
     []),
    ("apache-2.0", rf"apache(?: software)? license{V}2(?: 0)?", "apache 2 0",
     "apache org licenses license 2 0",
     [r"unless required by applicable law or agreed to in writing software distributed under the license",
      r"you may not use this file except in compliance with the license"]),
    ("apache-1.1", rf"apache(?: software)? license{V}1 1", "apache 1 1", "apache org licenses license 1 1",
     [r"this product includes software developed by the apache software foundation"]),
    ("apache-1.0", rf"apache(?: software)? license{V}1 0", "apache 1 0", "apache org licenses license 1 0",
     []),
    ("gpl-1.0", rf"gnu general public license{V}1(?: 0)?", "gpl 1 0(?: only| or later)?",
     "gnu org licenses old licenses gpl 1 0", []),
    ("gpl-2.0", rf"(?:gnu )?(?:(?:general public license|gpl){V}|gplv)2(?: 0)?",
     "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0",
     [r"either version 2 of the license or at your option any later version"]),
    ("gpl-3.0", rf"(?:gnu )?(?:(?:general public license|gpl){V}|gplv)3(?: 0)?",
     "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0",
     [r"either version 3 of the license or at your option any later version"]),
    ("lgpl-2.0", rf"gnu library general public license(?:{V}2(?: 0)?)?",
     "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0", []),
    ("lgpl-2.1", rf"(?:gnu )?(?:(?:lesser general public license|lgpl){V}|lgplv)2 1",
     "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1",
     [r"either version 2 1 of the license or at your option any later version"]),
    ("lgpl-3.0", rf"(?:gnu )?(?:(?:lesser general public license|lgpl){V}|lgplv)3(?: 0)?",
     "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0", []),
    ("lgpl", r"(?:gnu )?lesser general public license", "lgpl",
     "gnu org copyleft lesser", [r"gnu lesser general public license for more details"]),
    ("agpl-3.0", rf"gnu affero general public license(?:{V}3(?: 0)?)?|(?:gnu )?(?:agpl{V}|agplv)3(?: 0)?",
     "agpl 3 0(?: only| or later)?", "gnu org licenses agpl(?: 3 0)?",
     [r"gnu affero general public license for more details"]),
    ("gpl", r"gnu general public license", "gpl", "gnu org copyleft gpl",
     [r"gnu general public license for more details"]),
    ("gfdl", rf"gnu free documentation license(?:{V}1 [123])?",
     "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl",
     [r"permission is granted to copy distribute and or modify this document under the terms of the gnu free"
      r" documentation license"]),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause license",
     "bsd 2 clause", "opensource org licenses bsd 2 clause", []),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause license",
     "bsd 3 clause", "opensource org licenses bsd 3 clause",
     [r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote"]),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd license|bsd 4 clause license",
     "bsd 4 clause", "directory fsf org wiki license bsd 4clause",
     [r"all advertising materials mentioning features or use of this software must display"]),
    ("0bsd", r"(?:zero clause|0 clause) bsd license|bsd zero clause license", "0bsd",
     "opensource org licenses 0bsd", []),
    ("bsd", r"bsd(?: style)? license|berkeley software distribution license", "bsd",
     "opensource org licenses bsd license",
     [r"redistribution and use in source and binary forms with or without modification are permitted"]),
    ("isc", r"isc license|internet systems consortium license", "isc", "opensource org licenses isc",
     [r"permission to use copy modify and or distribute this software for any purpose with or without fee"]),
    ("mpl-1.1", rf"mozilla public license{V}1 [01]", "mpl 1 [01]",
     "mozilla org mpl 1 1", [r"subject to the mozilla public license version 1 1"]),
    ("mpl-2.0", rf"mozilla public license{V}2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0",
     [r"this source code form is subject to the terms of the mozilla public license"]),
    ("epl-1.0", rf"eclipse public license{V}1(?: 0)?", "epl 1 0",
     "eclipse org legal epl v10", []),
    ("epl-2.0", rf"eclipse public license{V}2(?: 0)?", "epl 2 0",
     "eclipse org legal epl 2 0", []),
    ("cddl-1.0", rf"common development and distribution license(?:{V}1 [01])?",
     "cddl 1 [01]", "opensource org licenses cddl",
     [r"subject to the terms of the common development and distribution license"]),
    ("cpl-1.0", rf"common public license(?:{V}1 0)?", "cpl 1 0",
     "opensource org licenses cpl1 0", []),
    ("ipl-1.0", rf"ibm public license(?:{V}1 0)?", "ipl 1 0",
     "opensource org licenses ibmpl", []),
    ("artistic-1.0", rf"artistic license(?:{V}1 0)?", "artistic 1 0",
     "opensource org licenses artistic license 1 0", []),
    ("artistic-2.0", rf"artistic license{V}2(?: 0)?", "artistic 2 0",
     "perlfoundation org artistic license 2 0", []),
    ("zlib", r"zlib(?: libpng)? license", "zlib", "opensource org licenses zlib",
     [r"this software is provided as is without any express or implied warranty in no event will the authors be"
      r" held liable"]),
    ("bsl-1.0", rf"boost software license(?:{V}1 0)?", "bsl 1 0",
     "boost org license 1 0", [r"permission is hereby granted free of charge to any person or organization"]),
    ("unlicense", r"the unlicense|unlicense license", "unlicense", "unlicense org (?=.*licen)unlicense",
     [r"this is free and unencumbered software released into the public domain"]),
    ("wtfpl", r"do what the \S+ you want to public license", "wtfpl",
     "wtfpl net (?:about )?license", []),
    ("cc0-1.0", rf"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?= public domain| license| 1 0)",
     "cc0 1 0", "creativecommons org publicdomain zero 1 0",
     [r"waived all copyright and related or neighboring rights"]),
    ("cc-by-4.0", r"creative commons attribution 4 0(?: international)?",
     "cc by 4 0", "creativecommons org licenses by 4 0", []),
    ("cc-by-3.0", r"creative commons attribution 3 0(?: unported)?", "cc by 3 0",
     "creativecommons org licenses by 3 0", []),
    ("cc-by-sa-4.0", r"creative commons attribution share ?alike 4 0(?: international)?",
     "cc by sa 4 0", "creativecommons org licenses by sa 4 0", []),
    ("cc-by-sa-3.0", r"creative commons attribution share ?alike 3 0(?: unported)?",
     "cc by sa 3 0", "creativecommons org licenses by sa 3 0", []),
    ("cc-by-nc-4.0", r"creative commons attribution non ?commercial 4 0(?: international)?",
     "cc by nc 4 0", "creativecommons org licenses by nc 4 0", []),
    ("cc-by-nc-sa-4.0", r"creative commons attribution non ?commercial share ?alike 4 0(?: international)?",
     "cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0", []),
    ("cc-by-nd-4.0", r"creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?",
     "cc by nd 4 0", "creativecommons org licenses by nd 4 0", []),
    ("cc-by-nc-nd-4.0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?",
     "cc by nc nd 4 0", "creativecommons org licenses by nc nd 4 0", []),
    ("cc-by", r"creative commons attribution(?: license)?", "cc by",
     "creativecommons org licenses by", []),
    ("odbl-1.0", rf"open data commons open database license(?:{V}1 0)?|open database license",
     "odbl 1 0", "opendatacommons org licenses odbl", []),
    ("ofl-1.1", rf"sil open font license(?:{V}1 1)?", "ofl 1 1",
     "scripts sil org ofl(?= .*licen)", [r"this font software is licensed under the sil open font license"]),
    ("eupl-1.2", rf"european union public licen[cs]e(?:{V}1 [012])?", "eupl 1 2",
     "joinup ec europa eu licen[cs]e eupl", []),
    ("ms-pl", r"microsoft public license", "ms pl", "opensource org licenses ms pl", []),
    ("ms-rl", r"microsoft reciprocal license", "ms rl",
     "opensource org licenses ms rl", []),
    ("ncsa", r"university of illinois (?:ncsa )?open source license", "ncsa",
     "opensource org licenses uoi ncsa", []),
    ("python-2.0", rf"python(?: software foundation)? license(?:{V}2)?", "python 2 0|psf 2 0",
     "opensource org licenses python 2 0",
     [r"python software foundation is making python available to licensee on an as is basis"]),
    ("php-3.01", rf"php license{V}3 01?", "php 3 01", "php net license 3 01",
     [r"this source file is subject to version 3 01 of the php license"]),
    ("w3c", r"w3c software (?:notice and )?license", "w3c", "w3 org consortium legal copyright", []),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql",
     [r"permission to use copy modify and distribute this software and its documentation for any purpose"
      r" without fee"]),
    ("openssl", r"openssl license", "openssl", "openssl org source license",
     [r"this product includes software developed by the openssl project"]),
    ("vim", r"vim license", "vim", "vim org (?:about )?license", []),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain dedication",
     "public domain", "creativecommons org licenses publicdomain", []),
    ("proprietary", r"all rights reserved(?= .*copyright)|proprietary and confidential(?= .*licen)|commercial license",
     "proprietary", "end user license agreement",
     [r"unauthorized copying of this file via any medium is strictly prohibited"]),
]

#: Base phrases of the contract and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Kind: priority (1 comes first) and confidence.
KINDS = {"text": (1, 1.0), "identifier": (1, 0.95), "notice": (2, 0.9), "address": (2, 0.8), "name": (3, 0.7),
         "base": (4, 0.5)}

NOTICE = (r"(?:dual |re)?(?:licen[cs]ed|released|distributed|published|provided|available|redistributed)(?: \S+){0,4}?"
          r" under(?: the)?(?: terms and conditions of| terms of| conditions of)?(?: the)? ")
BOUND = (r"(?<= )(?:", r")(?= )")


#: Substrings that are in most notices; ``GATE`` adds what is needed for the others.
COMMON = ("licen", "copyright", "spdx", "warrant", "permission", "redistribut", "domain", "commons", "copyleft")


def _needed(items, rank: Callable) -> Iterator[list[str]]:
    """Lists of literals of which any match (with what it looks ahead to) holds at least one."""
    run = [""]
    for op, value in items:
        if op is sre.LITERAL:
            run = [r + chr(value) for r in run]
            continue
        if op is sre.SUBPATTERN and (plain := _plain(value[3])):
            run = [r + p for r in run for p in plain]
            continue
        if op is sre.BRANCH and (plain := _plain([(op, value)])):
            run = [r + p for r in run for p in plain]
            continue
        yield run
        if op is sre.SUBPATTERN:
            yield from _needed(value[3], rank)
        elif op is sre.BRANCH:  # the parser puts what alternatives begin with before them
            yield [k for r in run for part in value[1] for k in max(_needed(
                [(sre.LITERAL, ord(c)) for c in r] + list(part), rank), key=rank)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            yield from _needed(value[2], rank)
        elif op is sre.ASSERT and value[0] > 0:
            yield from _needed(value[1], rank)
        run = [""]
    yield run


def _plain(items) -> list[str] | None:
    """All texts that match, if these are alternatives without repeats, classes or conditions."""
    out = [""]
    for op, value in items:
        if op is sre.LITERAL:
            more = [chr(value)]
        elif op is sre.SUBPATTERN:
            more = _plain(value[3])
        elif op is sre.BRANCH:
            parts = [_plain(part) for part in value[1]]
            more = None if None in parts else [p for part in parts for p in part]
        else:
            more = None
        if not more:
            return None
        out = [a + b for a in out for b in more]
    return out


def keywords(regex: str) -> list[str]:
    """Literals of which any match holds at least one, the rarest that the regex has."""
    def rank(found):
        return min(len(k.replace("license", "").strip()) for k in found)

    return sorted(set(max(_needed(sre.parse(regex), rank), key=rank)))


def gates(regex: str) -> list[str]:
    """Substrings within words of which any match holds at least one, the common ones if they do."""
    def of(literal):
        return next((g for g in COMMON if g in literal), None) or max(literal.split() or [""], key=len)

    def rank(found):
        return all(of(k) in COMMON for k in found), min(len(of(k)) for k in found)

    return sorted({of(k) for k in max(_needed(sre.parse(regex), rank), key=rank)})


def rules() -> list[dict]:
    """All rules in a fixed order: regex, keywords of which one must be present (by |), priority, label, confidence."""
    out = []

    def add(kind, label, regex, needed=None):
        priority, confidence = KINDS[kind]
        out.append({"id": len(out), "kind": kind, "label": label, "keyword": "|".join(keywords(needed or regex)),
                    "gates": gates(needed or regex), "regex": BOUND[0] + regex + BOUND[1],
                    "priority": priority, "confidence": confidence})

    for label, name, identifiers, address, passages in LICENSES:
        add("identifier", label, rf"spdx license identifier (?:{identifiers})", "spdx license identifier")
        add("notice", label, rf"{NOTICE}(?:{name})", name)
        add("name", label, name)
        add("address", label, address)
        for passage in passages:
            add("text", label, passage)
    for phrase, label in BASE:
        add("base", label, phrase)
    return out


#: Substrings of which any text that a rule matches holds at least one.
GATE = tuple(sorted({g for r in rules() for g in r["gates"]}))
