"""License scans by ordered signature rules.

Hundreds of regular expressions: hand-written ones for the wording of notices and license texts, and ones made
from tables of license families and forms of words for names, versions and identifiers. Each is gated by a keyword:
a rule runs only on texts that hold it. Overlapping detections are resolved by priority and
containment: one that lies inside another of the same or a higher priority goes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

#: Phrases (consecutive words) and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword, names as regular expressions, and versions (none: the license has no versions).
FAMILIES = (
    ("apache", "apache", r"apache(?: software)? license|asl", ("1.0", "1.1", "2.0")),
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0")),
    ("gpl", "general public", r"(?:gnu )?general public license|gnu gpl", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) general public license", ("2", "2.1", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public license", ("1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license|gfdl", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", r"mozilla public license", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public license", ("1.0", "2.0")),
    ("epl", "epl", r"epl", ("1.0", "2.0")),
    ("cddl", "common development", r"common development and distribution license", ("1.0", "1.1")),
    ("cddl", "cddl", r"cddl", ("1.0", "1.1")),
    ("cpl", "common public", r"common public license", ("1.0",)),
    ("eupl", "european union", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", r"eupl", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", r"artistic license", ("1.0", "2.0")),
    ("osl", "open software", r"open software license", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", "academic free", r"academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("ofl", "open font", r"(?:sil )?open font license", ("1.0", "1.1")),
    ("lppl", "latex project", r"latex project public license", ("1.0", "1.1", "1.2", "1.3")),
    ("psf", "python software", r"python software foundation license", ("2",)),
    ("php", "php license", r"php license", ("3.0", "3.01")),
    ("zpl", "zope", r"zope public license", ("1.1", "2.0", "2.1")),
    ("cecill", "cecill", r"cecill(?:-[bc])?", ("1.0", "1.1", "2.0", "2.1")),
    ("mspl", "microsoft public", r"microsoft public license", ()),
    ("msrl", "microsoft reciprocal", r"microsoft reciprocal license", ()),
    ("bsl", "boost", r"boost software license", ("1.0",)),
    ("upl", "universal permissive", r"universal permissive license", ("1.0",)),
    ("isc", "isc", r"isc license", ()),
    ("zlib", "zlib", r"zlib(?:/libpng)? license", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("bsd-4-clause", "bsd", r"(?:4|four)[- ]clause bsd(?: license)?|bsd[- ]4[- ]clause|original bsd license", ()),
    ("bsd-3-clause", "bsd", r"(?:3|three)[- ]clause bsd(?: license)?|bsd[- ]3[- ]clause|(?:new|modified) bsd license", ()),
    ("bsd-2-clause", "bsd", r"(?:2|two)[- ]clause bsd(?: license)?|bsd[- ]2[- ]clause|simplified bsd license", ()),
    ("bsd", "bsd", r"bsd license", ()),
    ("mit", "mit", r"mit license|mit/x11 license", ()),
    ("expat", "expat", r"expat license", ()),
    ("cc0", "cc0", r"cc0", ("1.0",)),
    *((f"cc-{k}", "cc", rf"cc[- ]{k.replace('-', '[- ]')}", ("1.0", "2.0", "2.5", "3.0", "4.0")) for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    *(
        (f"cc-{k}", "creative commons", rf"creative commons {words}", ("1.0", "2.0", "2.5", "3.0", "4.0"))
        for k, words in (
            ("by", "attribution"),
            ("by-sa", "attribution[- ]share[- ]?alike"),
            ("by-nc", "attribution[- ]non[- ]?commercial"),
            ("by-nd", "attribution[- ]no[- ]?deriv(?:ative)?s"),
            ("by-nc-sa", "attribution[- ]non[- ]?commercial[- ]share[- ]?alike"),
            ("by-nc-nd", "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s"),
        )
    ),
)

#: What stands in an SPDX identifier for a family, before the version, where that isn't the label.
SPDX = {
    "psf": "psf|python", "cecill": "cecill(?:-[bc])?", "mspl": "ms-pl", "msrl": "ms-rl", "bsd": "0bsd|bsd(?:-1-clause)?", "unlicense": "(?:the )?unlicense",
}

#: Passages that stand for a license without naming it.
PASSAGES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistributions? and use in source and binary forms,? with or without modification"),
    ("zlib", "as-is", r"this software is provided 'as-is',? without any express or implied warranty"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the", r"do what the \w+ you want to public license"),
    ("apache", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an"),
    ("apache", "each contributor hereby", r"each contributor hereby grants to you a perpetual,? worldwide,? non-exclusive,? no-charge"),
    ("gpl", "this program is free software", r"this program is free software[;:,]? you can redistribute it and/?(?: ?or)? modify it under the terms of the gnu general public license"),
    ("gpl-2", "either version 2", r"gnu general public license as published by the free software foundation[;:,]? either version 2(?:\.0)?(?: of the license)?"),
    ("gpl-3", "either version 3", r"gnu general public license as published by the free software foundation[;:,]? either version 3(?:\.0)?(?: of the license)?"),
    ("gpl", "should have received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "take away your freedom", r"the licenses for most software are designed to take away your freedom"),
    ("gpl-3", "copyleft license for", r"the gnu general public license is a free, copyleft license for software"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed"),
    ("lgpl", "this library is free", r"this library is free software[;:,]? you can redistribute it and/?(?: ?or)? modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "either version 2.1", r"gnu lesser general public license as published by the free software foundation[;:,]? either version 2\.1(?: of the license)?"),
    ("lgpl", "should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "affero", r"modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "affero", r"the gnu affero general public license is a free, copyleft license for software"),
    ("gfdl", "free documentation", r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsd", "retain the above copyright", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "reproduce the above copyright", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of [^.]{1,120} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "express or implied warranties", r"""this software is provided by [^.]{1,80} ["'`]*as is["']* and any express or implied warranties"""),
    ("mit", "this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "without warranty of any kind", r"""the software is provided ["'`]*as is["']*,? without warranty of any kind"""),
    ("mit", "shall not be used in advertising", r"except as contained in this notice,? the names? of [^.]{1,120} shall not be used in advertising"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("json", "not evil", r"the software shall be used for good,? not evil"),
    ("isc", "disclaims all warranties", r"""the software is provided ["'`]*as is["']* and the author disclaims all warranties"""),
    ("hpnd", "its documentation", r"permission to use,? copy,? modify,? (?:and )?distribute(?:,? and sell)? this software and its documentation for any purpose"),
    ("postgresql", "written agreement", r"for any purpose,? without fee,? and without a written agreement is hereby granted"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "person or organization", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("upl-1.0", "larger works", r"subject to the condition set forth below,? permission is hereby granted to any person obtaining a copy"),
    ("unlicense", "anyone is free", r"anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software"),
    ("wtfpl", "changing it is allowed", r"changing it is allowed as long as the name is changed"),
    ("beerware", "whatever you want", r"as long as you retain this notice,? you can do whatever you want with this stuff"),
    ("public-domain", "public domain", r"(?:has been |is )?(?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("cc0-1.0", "waived all copyright", r"to the extent possible under law,? [^.]{1,120} waived all copyright"),
    ("cc0-1.0", "this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-1.0", "a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "given free software package", r"this license establishes the terms under which a given free software package may be copied"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "worldwide development", r"the goals of the open font license \(ofl\) are to stimulate worldwide development"),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation"),
    ("php-3.01", "php license", r"this source file is subject to version 3\.01 of the php license"),
    ("php-3.0", "php license", r"this source file is subject to version 3\.0 of the php license"),
    ("zpl", "zope", r"this software is subject to the provisions of the zope public license"),
    ("mspl", "accompanying software", r"this license governs use of the accompanying software\. if you use the software,? you accept this license"),
    ("openssl", "openssl", r"this product includes (?:cryptographic )?software (?:developed|written) by (?:the openssl project|eric young)"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("lppl", "maintenance status", r"this work has the lppl maintenance status"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)"),
    ("proprietary", "prior written", r"without the (?:express )?prior written (?:permission|consent) of"),
)

#: Keeps a name or number whole: no letter, digit or sign of a longer token beside it.
_A, _Z = r"(?<![a-z0-9])", r"(?![a-z0-9])"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    trust: float


def _version(v: str) -> str:
    return re.escape(v) + (r"(?:\.0)?" if "." not in v else "") + r"(?![0-9]|\.[0-9])"


def rules() -> list[Rule]:
    """All rules, highest priority first: an identifier or notice with a version, a name with a version, a
    passage, a notice, a name."""
    found = []

    def add(label: str, keyword: str, pattern: str, priority: int, trust: float) -> None:
        found.append(Rule(label, keyword, re.compile(pattern), priority, trust))

    for label, keyword, names, versions in FAMILIES:
        name = f"(?:{names})"
        ids = f"(?:{SPDX.get(label, label)}|{names})"
        for v in versions:
            full = f"{label}-{v}"
            add(full, "spdx-license-identifier", rf"spdx-license-identifier: ?{ids}[- ]{_version(v)}(?:-only|-or-later)?", 6, 1.0)
            add(full, keyword, rf"{_A}(?:licensed|released|distributed|available)(?: \w+)? under (?:the )?(?:terms of (?:the )?)?{name},? (?:version |v\.? ?)?{_version(v)}", 5, 1.0)
            add(full, keyword, rf"{_A}{name},? ?-?(?:version |v\.? ?)?{_version(v)}", 4, 0.9)
        add(label, "spdx-license-identifier", rf"spdx-license-identifier: ?{ids}(?:-[0-9.]+)?(?:-only|-or-later)?{_Z}", 5, 1.0)
        add(label, keyword, rf"{_A}(?:licensed|released|distributed|available)(?: \w+)? under (?:the )?(?:terms of (?:the )?)?{name}{_Z}", 2, 0.8)
        if "license" in names or "creative commons" in names:
            add(label, keyword, rf"{_A}{name}{_Z}", 1, 0.6)
    for label, keyword, pattern in PASSAGES:
        add(label, keyword, rf"{_A}{pattern}", 3, 0.95 if label != "proprietary" else 0.4)
    return sorted(found, key=lambda r: -r.priority)


#: White space other than a single space, with the comment marks at the start of a line or between spaces.
_GAP = re.compile(r"(?:[^\S ]| (?=[\s*#/;%>!|]|--))(?:\s++|(?<=\s)(?:[*#/;%>!|]++|--++))*+")


def unwrapped(text: str) -> tuple[str, list[int], list[int]]:
    """The text with each gap as one space (a blank line as a line feed), so that wrapped phrases match; places
    in it after which the offset changes, and how far the original is ahead from there on."""
    out, places, ahead, last, n = [], [0], [0], 0, 0
    for m in _GAP.finditer(text):
        out += text[last : m.start()], "\n" if m[0].count("\n") > 1 else " "
        n += m.start() - last + 1
        last = m.end()
        places.append(n)
        ahead.append(last - n)
    return "".join([*out, text[last:]]), places, ahead


def detect(text: str, every: list[Rule]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in lower-case text, after suppression: in order of place."""
    text, places, ahead = unwrapped(text)

    def original(at: int) -> int:
        return at + ahead[bisect_right(places, at) - 1]

    held: dict[str, bool] = {}
    found = []
    for rule in every:
        if rule.keyword not in held:
            held[rule.keyword] = rule.keyword in text
        if held[rule.keyword]:
            found += [(original(m.start()), original(m.end() - 1) + 1, rule) for m in rule.pattern.finditer(text)]
    # what contains another comes before it: an earlier start, a later end; then the higher priority. Of each
    # priority the kept detection that reaches furthest is all that can contain a later one.
    kept: list[tuple[int, int, Rule]] = []
    reach: dict[int, int] = {}
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], -x[2].priority, x[2].label)):
        if not any(far >= end and priority >= rule.priority for priority, far in reach.items()):
            kept.append((start, end, rule))
            reach[rule.priority] = max(end, reach.get(rule.priority, 0))
    return kept


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: ASCII letters in lower case, digits and bytes beyond ASCII stay; anything else parts words.
_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def places(tokens: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of every place where the words of a base phrase stand one after another."""
    joined, out = b" " + b" ".join(tokens) + b" ", []
    for phrase, label in BASE:
        sought, at = f" {phrase} ".encode(), -1
        word, last = 0, 0
        while (at := joined.find(sought, at + 1)) >= 0:
            word += joined.count(b" ", last, at)
            last = at
            out.append((word, label))
    return sorted(out)


_every: list[Rule] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    detections: start and end in code points of the text, label and trust of what the rules find. Null counts
    as an empty text: no words, nulls for places, empty labels, score 0. score is the largest trust of a
    detection, at least 0.5 if there is a base place. One row per row of docs, also for repeated ones and null ids;
    other columns aren't read. Texts are scanned whole, also very long ones, one at a time. Detections of equal
    priority at one place: the longer one. An empty table gives an empty result.
    """
    detection = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("trust", pa.float64())])

    def row(text: str) -> tuple:
        tokens = words(text)
        lower = text.encode().translate(_LOWER).decode()
        base = places(tokens) if "license" in lower else []
        found = detect(lower, _every)
        labels = {label for _, label in base}
        at = [k for k, _ in base]
        score = max([0.5 * bool(base), *(r.trust for _, _, r in found)])
        spans = [{"start": a, "end": b, "label": r.label, "trust": r.trust} for a, b, r in found]
        return (
            len(tokens), len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for _, _, r in found})), score, spans,
        )

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(detection))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not _every:
            _every.extend(rules())
        out = [row(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        per_batch(make, 1),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<start: int, end: int, label: string, trust: double>>",
    )
