"""License scans (operator 9): sentence rules.

Texts are unwrapped (comment marks go, line breaks within a paragraph are blanks) and cut
into sentences at full stops, blank lines, list marks and lines that declare a licence.
Sentences are normalised to words; each becomes the identifiers of the known licence
sentences that it is or holds, the longest from each place on, and references to a licence by name are such
sentences too. The sequence of identifiers is matched against ordered rules, the most
specific first, and every match uses up its sentences.

Defined results for odd input: null and empty texts have no licence; long texts are
scanned whole; rows are independent, so repeated rows agree and a null doc_id is passed
on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import text_of

#: Ways to refer to a licence, and what may stand between them and its name.
REFERENCES = (
    "available under", "covered by", "covered under", "distributed under", "governed by", "licensed under", "made available under", "offered under", "provided under", "published under",
    "redistributed under", "released under", "subject to", "used under",
)
ARTICLES = ("", "a ", "an ", "the ", "terms of the ", "the terms of the ", "the terms of ", "the terms and conditions of the ", "the conditions of the ")
#: Names of licences, normalised; those that say "license" or a version are also found after a plain "under".
NAMES = {
    "0BSD": ("0bsd", "bsd zero clause license", "zero clause bsd license"),
    "Apache-2.0": ("apache 2", "apache 2 0", "apache 2 0 license", "apache license 2 0", "apache license v2", "apache license v2 0", "apache license version 2", "apache license version 2 0", "apache software license 2 0", "apache software license version 2 0"),
    "BSD-2-Clause": ("2 clause bsd license", "bsd 2 clause", "bsd 2 clause license", "freebsd license", "simplified bsd license", "two clause bsd license"),
    "BSD-3-Clause": ("3 clause bsd license", "bsd 3 clause", "bsd 3 clause license", "modified bsd license", "new bsd license", "revised bsd license", "three clause bsd license"),
    "BSL-1.0": ("boost software license", "boost software license 1 0", "boost software license version 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license"),
    "CC0-1.0": ("cc0", "cc0 1 0", "cc0 1 0 universal", "cc0 license", "creative commons zero v1 0 universal"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license version 2 0", "epl 2 0"),
    "ISC": ("isc", "isc license"),
    "MIT": ("expat license", "mit", "mit license", "mit x11 license"),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license version 2 0", "mpl 2 0", "mpl v2", "mplv2"),
    "Unlicense": ("unlicense", "unlicense license"),
    "Zlib": ("zlib", "zlib license", "zlib libpng license"),
}
#: Licences with versions that a later one may replace, as (id, full name, short name, versions).
VERSIONED = (
    ("AGPL", "affero general public license", "agpl", ("3.0",)),
    ("GPL", "general public license", "gpl", ("1.0", "2.0", "3.0")),
    ("LGPL", "lesser general public license", "lgpl", ("2.1", "3.0")),
)
#: What after a version allows later ones, or forbids them.
LATER = ("or later", "or newer", "or any later version", "or at your option any later version", "or later version", "or above")
#: Sentences of licence texts by identifier, normalised; subjects and owners that vary are left out.
SENTENCES = {
    "apache-title": "apache license version 2 0 january 2004",
    "apache-definition": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache-grant": "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-redistribution": "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "apache-language": "see the license for the specific language governing permissions and limitations under the license",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsd-forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-accept": "you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license",
    "cc-by-nc-accept": "you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license",
    "cc-by-sa-accept": "you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license",
    "cc0-purpose": "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s",
    "epl-program": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "gpl-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl2-freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl3-copyleft": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "agpl3-copyleft": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl3-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-title": "mozilla public license version 2 0",
    "mpl-contributor": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense-public": "this is free and unencumbered software released into the public domain",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}


@dataclass(frozen=True)
class Rule:
    """Sentences that must follow each other in this order, with at most gap other sentences between two of them; those of also belong to it where they follow."""

    name: str
    licence: str
    sequence: tuple[str, ...]
    also: tuple[str, ...] = ()
    gap: int = 3


def _versions() -> Iterator[tuple[str, str, str, str]]:
    """(licence without a suffix, full name, short name, version as words) of each versioned licence."""
    for licence, full, short, versions in VERSIONED:
        for v in versions:
            yield f"{licence}-{v}", full, short, v.removesuffix(".0").replace(".", " ")


_GNU_ALSO = ("gpl-warranty", "gpl-details", "gpl-copy")
_FREE = [(f"{licence}{end}", f"free:{licence}{end}") for licence, *_ in _versions() for end in ("-or-later", "-only")]
#: Ordered rules: whole texts before headers, headers before single references.
RULES = (
    Rule("apache-2.0-text", "Apache-2.0", ("apache-title", "apache-definition", "apache-licensor", "apache-grant", "apache-redistribution"), gap=40),
    Rule("agpl-3.0-text", "AGPL-3.0", ("agpl3-title", "gpl-verbatim", "agpl3-copyleft"), gap=6),
    Rule("gpl-3.0-text", "GPL-3.0", ("gpl3-title", "gpl-verbatim", "gpl3-copyleft"), gap=6),
    Rule("gpl-2.0-text", "GPL-2.0", ("gpl2-title", "gpl-verbatim", "gpl2-freedom"), gap=6),
    Rule("lgpl-3.0-text", "LGPL-3.0", ("lgpl3-title", "gpl-verbatim", "lgpl3-incorporates"), gap=6),
    Rule("lgpl-2.1-text", "LGPL-2.1", ("lgpl21-title", "gpl-verbatim"), gap=6),
    Rule("mpl-2.0-text", "MPL-2.0", ("mpl-title", "mpl-contributor"), gap=6),
    Rule("cc-by-nc-4.0-text", "CC-BY-NC-4.0", ("cc-by-nc-accept",)),
    Rule("cc-by-sa-4.0-text", "CC-BY-SA-4.0", ("cc-by-sa-accept",)),
    Rule("cc-by-4.0-text", "CC-BY-4.0", ("cc-by-accept",)),
    Rule("cc0-1.0-text", "CC0-1.0", ("cc0-purpose",)),
    Rule("epl-2.0-text", "EPL-2.0", ("epl-program",)),
    Rule("boost-1.0-text", "BSL-1.0", ("boost-grant",)),
    Rule("zlib-text", "Zlib", ("zlib-warranty", "zlib-grant")),
    Rule("unlicense-text", "Unlicense", ("unlicense-public", "unlicense-free")),
    Rule("bsd-3-clause-text", "BSD-3-Clause", ("bsd-forms", "bsd-source", "bsd-binary", "bsd-names"), ("bsd-warranty",)),
    Rule("bsd-2-clause-text", "BSD-2-Clause", ("bsd-forms", "bsd-source", "bsd-binary"), ("bsd-warranty",)),
    Rule("mit-titled-text", "MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty"), ("mit-liability",)),
    Rule("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty"), ("mit-liability",)),
    Rule("isc-text", "ISC", ("isc-grant", "isc-warranty"), ("isc-liability",)),
    Rule("0bsd-text", "0BSD", ("zero-bsd-grant", "isc-warranty"), ("isc-liability",)),
    Rule("apache-2.0-header", "Apache-2.0", ("apache-header", "apache-use"), ("apache-copy", "apache-basis", "apache-language")),
    *(Rule(f"{licence.lower()}-header", licence, (free, "gpl-warranty"), _GNU_ALSO[1:]) for licence, free in _FREE),
    Rule("mit-grant", "MIT", ("mit-grant",)),
    Rule("isc-grant", "ISC", ("isc-grant",)),
    Rule("apache-2.0-notice", "Apache-2.0", ("apache-header",), ("apache-copy",)),
    *(Rule(f"{licence.lower()}-notice", licence, (free,), ("gpl-copy",)) for licence, free in _FREE),
    Rule("mpl-2.0-notice", "MPL-2.0", ("mpl-form",), ("mpl-copy",)),
    Rule("unlicense-notice", "Unlicense", ("unlicense-public",)),
)

_OTHER = regex.compile(r"[^a-z0-9]+")
_COMMENT = regex.compile(r"(?mi)^[ \t]*(?:/\*+!?|\*+/|\*+(?!\w)|#+|//+!?|--+|;+|%+|<!--+|dnl\b|rem\b)[ \t]*")
#: Sentences end at full stops (but not that of "v. 2.0"), blank lines, and before a list mark after a colon, semicolon or full stop.
_BREAK = regex.compile(r"(?<=[.!?][\"')\]]*)(?<!\bv\.)(?<!\bver\.)\s+|\n[ \t]*\n\s*|(?<=[:;.,]|\band|\bor)\s*\n\s*(?=(?:\d+|[a-z])[.)]\s|\([a-z0-9]+\)\s|[*•-]\s)", regex.IGNORECASE)
#: A line that declares a licence: an SPDX tag, or a field of a package's description.
_DECLARED = regex.compile(r"""(?im)(?:SPDX-License-Identifier|^[ \t"'{,]*licen[sc]e(?:[-_ ](?:expression|id|identifier))?)["']?[ \t]*(?::+|=)[ \t]*(\S[^\r\n]*)""")
_TERM = regex.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def normalise(sentence: str) -> str:
    """Lower-case letters and digits with single spaces; the British spelling folded."""
    return _OTHER.sub(" ", sentence.lower()).strip().replace("licence", "license")


@lru_cache(1)
def licence_names() -> dict[str, str]:
    """Every name, normalised, with its licence; names of versioned licences come with or without "or later" and "only"."""
    out = {name: licence for licence, names in NAMES.items() for name in names}
    for licence, full, short, v in _versions():
        forms = [f"{short}v{v}", f"{short} {v}", f"{short}v{v} 0", f"{short} {v} 0"]
        for name in (f"gnu {full}", full, f"gnu {short}", short):
            forms += [f"{name} version {v}", f"{name} v{v}", f"{name} v {v}", f"{name} version {v} 0", f"{name} v{v} 0", f"version {v} of the {name}"]
        for form in forms:
            out[form] = licence
            out |= {f"{form} {later}": f"{licence}-or-later" for later in LATER} | {f"{form} only": f"{licence}-only"}
    return out


def _ways(name: str) -> tuple[str, ...]:
    return (*REFERENCES, "under") if "license" in name or any(c.isdigit() for c in name) else REFERENCES


@lru_cache(1)
def text_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: SENTENCES and the notices of the GNU licences."""
    out = {}
    for licence, full, _, v in _versions():
        start = f"is free software you can redistribute it and or modify it under the terms of the gnu {full}"
        foundation = "as published by the free software foundation"
        for words in {v, f"{v} 0"} if " " not in v else {v}:
            out[f"{start} {foundation} either version {words} of the license or at your option any later version"] = f"free:{licence}-or-later"
            out |= {f"{start} {x}": f"free:{licence}-only" for x in (f"{foundation} version {words}", f"version {words} {foundation}")}
        out[f"see the gnu {full} for more details"] = "gpl-details"
    return out | {s: i for i, s in SENTENCES.items()}


def known_sentences() -> Iterator[tuple[str, str]]:
    """All known sentences with their identifiers: text_sentences(), and each way to refer to each name."""
    yield from text_sentences().items()
    for name, licence in licence_names().items():
        yield from ((f"{way} {article}{name}", f"ref:{licence}") for way in _ways(name) for article in ARTICLES)


@lru_cache(1)
def _matcher() -> ahocorasick.Automaton:
    """Sentences and names, between spaces, so that only whole words match; each with its identifier, names also with the pattern of what must stand before them."""
    entries: dict[str, list[tuple[str, regex.Pattern | None]]] = {s: [(identifier, None)] for s, identifier in text_sentences().items()}
    referred = {ways: regex.compile(rf" (?:{'|'.join(ways)}) (?:{'|'.join(ARTICLES)})$") for ways in {_ways(name) for name in licence_names()}}
    for name, licence in licence_names().items():
        entries.setdefault(name, []).append((f"ref:{licence}", referred[_ways(name)]))
    automaton = ahocorasick.Automaton()
    for s, known in entries.items():
        automaton.add_word(f" {s} ", (len(s) + 1, known))
    automaton.make_automaton()
    return automaton


def _held(sentence: str) -> Iterator[tuple[int, int, str]]:
    """(begin, -length, identifier) of every known sentence within a normalised one that has a space at both ends."""
    for end, (size, known) in _matcher().iter(sentence):
        for identifier, referred in known:
            begin = end - size
            if referred is None:
                yield begin, -size, identifier
            elif m := referred.search(sentence, max(0, begin - 80), begin + 1):
                yield m.start(), m.start() - end, identifier


@lru_cache(1)
def _spdx() -> dict[str, str]:
    """Lower-case SPDX identifiers; a plus sign stands for later versions."""
    ids = {*licence_names().values()}
    return {i.lower(): i for i in ids} | {f"{licence}+".lower(): f"{licence}-or-later" for licence, *_ in _versions()}


def declared(value: str) -> list[str]:
    """The licences of an SPDX expression, in order, or of a name in a package's description."""
    value = regex.split(r"\*/|-->|[\"',;]", value.strip(" \t\"'[{("))[0]
    terms, out, skip = _TERM.findall(value), [], False
    for t in terms:
        if t.lower() in ("and", "or", "with"):
            skip = t.lower() == "with"
        elif not skip and (found := _spdx().get(t.lower().rstrip("."))):
            out.append(found)
    words = normalise(value.rpartition("::")[2]).removeprefix("the ")
    return out or [x for x in (licence_names().get(words),) if x]


#: Every known sentence has one of these, so a text without any has no licence sentence.
TRIGGER = regex.compile(r"(?i)licen[sc]|permission|provided\W+as\W+is|as\W+is\b|redistribut|free\W+software|distributed\W+in\W+the\W+hope|endorse|liable|unencumbered|under\b|covered\W+by|governed\W+by|subject\W+to|jurisdiction|verbatim|free\W+to\W+copy|contributor|if\W+a\W+copy|received\W+a\W+copy")


def sentences(text: str) -> list[tuple[str, list[str] | None]]:
    """The sentences of a text; for a line that declares licences they come with it (None for all others)."""
    text, out, at = _COMMENT.sub("", text), [], 0

    def cut(part: str) -> None:
        out.extend((s, None) for s in _BREAK.split(part) if s and not s.isspace())

    for m in _DECLARED.finditer(text):
        if found := declared(m[1]):
            cut(text[at : m.start()])
            out.append((m[0], found))
            at = m.end()
    cut(text[at:])
    return out


def known_places(text: str) -> list[tuple[int, str]]:
    """(number of the sentence, identifier) of each known sentence in a text: from left to right the longest, none within another."""
    places = []
    for number, (sentence, licences) in enumerate(sentences(text)):
        if licences is not None:
            places += [(number, f"ref:{x}") for x in licences]
            continue
        at = -1
        for begin, size, identifier in sorted(_held(f" {normalise(sentence)} ")):
            if begin >= at:
                places.append((number, identifier))
                at = begin - size
    return places


def scan(text: str) -> list[tuple[str, str, int]]:
    """(licence, rule, place of its first sentence) for each rule match, in order of place."""
    if not TRIGGER.search(text):
        return []
    places = known_places(text)
    matches, used = [], set()
    present = {name for _, name in places}
    for rule in RULES:
        if not present.issuperset(rule.sequence):
            continue
        for start in range(len(places)):
            run, want = [], 0
            for i in range(start, len(places)):
                if run and places[i][0] - places[run[-1]][0] > rule.gap + 1:
                    break
                if i in used:
                    continue
                if want < len(rule.sequence) and places[i][1] == rule.sequence[want]:
                    run.append(i)
                    want += 1
                elif want == len(rule.sequence) and places[i][1] in rule.also:
                    run.append(i)
                elif not run or places[i][1] == rule.sequence[0]:
                    break  # no start, or the start of another copy
            if want == len(rule.sequence):
                matches.append((rule.licence, rule.name, places[run[0]][0]))
                used.update(run)
    matches += [(name[4:], f"{name[4:].lower()}-reference", place) for i, (place, name) in enumerate(places) if i not in used and name.startswith("ref:")]
    return sorted(matches, key=lambda m: (m[2], m[1]))


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_licenses (rule matches), licenses (distinct, sorted), rules and places of the matches in order. The tables of sentences and rules are constants; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n_licenses": pa.array([len(f) for f in found], pa.int64()), "licenses": pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())),
                "rules": pa.array([[m[1] for m in f] for f in found], pa.list_(pa.string())), "places": pa.array([[m[2] for m in f] for f in found], pa.list_(pa.int32())),
            })

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_licenses long, licenses array<string>, rules array<string>, places array<int>")
