"""License detection: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases of the contract and their labels (fixed values).
BASE_PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: label, SPDX ids, names (a space stands for any separators), addresses.
LICENSES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("mit", ["MIT"], ["mit licen[sc]e", "mit x11 licen[sc]e", "expat licen[sc]e"], [r"opensource\.org/licenses?/mit\b"]),
    ("mit-0", ["MIT-0"], ["mit no attribution"], [r"opensource\.org/licenses?/mit-0"]),
    ("x11", ["X11"], ["x11 licen[sc]e", "x consortium licen[sc]e"], []),
    ("apache-1.1", ["Apache-1.1"], ["apache(?: software)? licen[sc]e,? version 1\\.1"], [r"apache\.org/licenses/license-1\.1"]),
    ("apache-2.0", ["Apache-2.0"], ["apache(?: software)? licen[sc]e,?(?: \\(?version| v\\.?)? ?2(?:\\.0)?", "apache 2\\.0 licen[sc]e", "apache v2 licen[sc]e"], [r"apache\.org/licenses/license-2\.0"]),
    ("apache", [], ["apache(?: software)? licen[sc]e"], [r"apache\.org/licenses?\b"]),
    ("bsd-2-clause", ["BSD-2-Clause", "BSD-2-Clause-Views"], ["(?:simplified|freebsd|2.clause|two.clause) bsd licen[sc]e", "bsd 2.clause(?: licen[sc]e)?"], [r"opensource\.org/licenses?/bsd-2-clause"]),
    ("bsd-3-clause", ["BSD-3-Clause", "BSD-3-Clause-Clear"], ["(?:new|modified|revised|3.clause|three.clause) bsd licen[sc]e", "bsd 3.clause(?: licen[sc]e)?"], [r"opensource\.org/licenses?/bsd-3-clause"]),
    ("bsd-4-clause", ["BSD-4-Clause"], ["(?:original|4.clause|four.clause) bsd licen[sc]e"], []),
    ("0bsd", ["0BSD"], ["(?:zero.clause|0.clause) bsd licen[sc]e", "bsd zero clause licen[sc]e"], [r"opensource\.org/licenses?/0bsd"]),
    ("bsd", [], ["bsd.style licen[sc]e", "bsd licen[sc]e", "berkeley software distribution licen[sc]e"], []),
    ("isc", ["ISC"], ["isc licen[sc]e"], [r"opensource\.org/licenses?/isc"]),
    ("gpl-1.0", ["GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later"], ["general public licen[sc]e,? (?:version|v) ?1(?:\\.0)?"], []),
    ("gpl-2.0", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], ["general public licen[sc]e,?(?: as published by the free software foundation[;,])? (?:either )?(?:version|v) ?2(?:\\.0)?", "gnu gpl,? (?:version |v) ?2", "gpl ?v2"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"]),
    ("gpl-3.0", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], ["general public licen[sc]e,?(?: as published by the free software foundation[;,])? (?:either )?(?:version|v) ?3(?:\\.0)?", "gnu gpl,? (?:version |v) ?3", "gpl ?v3"], [r"gnu\.org/licenses/gpl-3\.0"]),
    ("gpl", [], ["gnu general public licen[sc]e", "general public licen[sc]e", "gnu gpl"], [r"gnu\.org/(?:copyleft/gpl|licenses/gpl)\b"]),
    ("lgpl-2.0", ["LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later"], ["library general public licen[sc]e,? (?:version|v) ?2(?:\\.0)?"], []),
    ("lgpl-2.1", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], ["lesser general public licen[sc]e,? (?:version|v) ?2\\.1", "lgpl ?v?2\\.1"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"]),
    ("lgpl-3.0", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], ["lesser general public licen[sc]e,? (?:version|v) ?3(?:\\.0)?", "lgpl ?v?3"], [r"gnu\.org/licenses/lgpl-3\.0"]),
    ("lgpl", [], ["gnu (?:lesser|library) general public licen[sc]e", "(?:lesser|library) general public licen[sc]e", "gnu lgpl"], [r"gnu\.org/licenses/lgpl\b"]),
    ("agpl-3.0", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], ["affero general public licen[sc]e,? (?:version|v) ?3(?:\\.0)?", "agpl ?v?3"], [r"gnu\.org/licenses/agpl-3\.0"]),
    ("agpl", [], ["gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl"], [r"gnu\.org/licenses/agpl\b"]),
    ("gfdl", ["GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GFDL-1.3-only", "GFDL-1.3-or-later"], ["gnu free documentation licen[sc]e", "free documentation licen[sc]e"], [r"gnu\.org/(?:copyleft/fdl|licenses/fdl)"]),
    ("mpl-1.1", ["MPL-1.1"], ["mozilla public licen[sc]e,? (?:version|v) ?1\\.1"], [r"mozilla\.org/mpl/mpl-1\.1"]),
    ("mpl-2.0", ["MPL-2.0"], ["mozilla public licen[sc]e,? (?:version |v\\.? ?)?2(?:\\.0)?"], [r"mozilla\.org/(?:mpl|en-us/mpl)/2\.0"]),
    ("mpl", [], ["mozilla public licen[sc]e"], [r"mozilla\.org/mpl\b"]),
    ("epl-1.0", ["EPL-1.0"], ["eclipse public licen[sc]e,?(?: -)? (?:version |v) ?1(?:\\.0)?"], [r"eclipse\.org/legal/epl-v10"]),
    ("epl-2.0", ["EPL-2.0"], ["eclipse public licen[sc]e,?(?: -)? (?:version |v)? ?2(?:\\.0)?"], [r"eclipse\.org/legal/epl-(?:2\.0|v20)"]),
    ("epl", [], ["eclipse public licen[sc]e"], []),
    ("eupl-1.2", ["EUPL-1.2", "EUPL-1.1"], ["european union public licen[sc]e"], [r"joinup\.ec\.europa\.eu/\S*eupl"]),
    ("cddl-1.0", ["CDDL-1.0", "CDDL-1.1"], ["common development and distribution licen[sc]e"], [r"opensource\.org/licenses?/cddl"]),
    ("cpl-1.0", ["CPL-1.0"], ["common public licen[sc]e"], [r"opensource\.org/licenses?/cpl"]),
    ("ipl-1.0", ["IPL-1.0"], ["ibm public licen[sc]e"], []),
    ("artistic-1.0", ["Artistic-1.0", "Artistic-1.0-Perl"], ["artistic licen[sc]e,? (?:version |v)? ?1(?:\\.0)?"], []),
    ("artistic-2.0", ["Artistic-2.0"], ["artistic licen[sc]e,? (?:version |v)? ?2(?:\\.0)?"], [r"opensource\.org/licenses?/artistic-2\.0"]),
    ("artistic", [], ["artistic licen[sc]e"], []),
    ("unlicense", ["Unlicense"], ["the unlicense", "released under the unlicense"], [r"unlicense\.org"]),
    ("wtfpl", ["WTFPL"], ["do what the f\\w* you want to public licen[sc]e"], [r"wtfpl\.net"]),
    ("zlib", ["Zlib", "zlib-acknowledgement"], ["zlib licen[sc]e", "zlib/libpng licen[sc]e"], [r"opensource\.org/licenses?/zlib"]),
    ("bsl-1.0", ["BSL-1.0"], ["boost software licen[sc]e"], [r"boost\.org/license_1_0"]),
    ("busl-1.1", ["BUSL-1.1"], ["business source licen[sc]e"], [r"mariadb\.com/bsl11"]),
    ("sspl-1.0", ["SSPL-1.0"], ["server side public licen[sc]e"], [r"mongodb\.com/licensing/server-side-public-license"]),
    ("elastic-2.0", ["Elastic-2.0"], ["elastic licen[sc]e"], [r"elastic\.co/licensing/elastic-license"]),
    ("ncsa", ["NCSA"], ["university of illinois/ncsa open source licen[sc]e", "ncsa open source licen[sc]e"], [r"opensource\.org/licenses?/ncsa"]),
    ("psf-2.0", ["PSF-2.0", "Python-2.0"], ["python software foundation licen[sc]e"], [r"docs\.python\.org/\S{0,200}?license"]),
    ("php-3.01", ["PHP-3.0", "PHP-3.01"], ["php licen[sc]e,? (?:version |v)? ?3"], [r"php\.net/license"]),
    ("postgresql", ["PostgreSQL"], ["postgresql licen[sc]e"], [r"opensource\.org/licenses?/postgresql"]),
    ("openssl", ["OpenSSL"], ["openssl licen[sc]e"], [r"openssl\.org/source/license"]),
    ("ofl-1.1", ["OFL-1.0", "OFL-1.1"], ["sil open font licen[sc]e", "open font licen[sc]e"], [r"scripts\.sil\.org/ofl"]),
    ("ms-pl", ["MS-PL"], ["microsoft public licen[sc]e"], []),
    ("ms-rl", ["MS-RL"], ["microsoft reciprocal licen[sc]e"], []),
    ("osl-3.0", ["OSL-1.0", "OSL-2.0", "OSL-2.1", "OSL-3.0"], ["open software licen[sc]e"], [r"opensource\.org/licenses?/osl"]),
    ("afl-3.0", ["AFL-2.1", "AFL-3.0"], ["academic free licen[sc]e"], [r"opensource\.org/licenses?/afl"]),
    ("upl-1.0", ["UPL-1.0"], ["universal permissive licen[sc]e"], [r"opensource\.org/licenses?/upl"]),
    ("vim", ["Vim"], ["vim licen[sc]e"], []),
    ("w3c", ["W3C"], ["w3c software (?:notice and )?licen[sc]e"], [r"w3\.org/consortium/legal/\S{0,200}?copyright-software"]),
    ("zpl-2.1", ["ZPL-2.0", "ZPL-2.1"], ["zope public licen[sc]e"], []),
    ("ecl-2.0", ["ECL-2.0"], ["educational community licen[sc]e"], []),
    ("mulan-psl-2.0", ["MulanPSL-2.0"], ["mulan permissive software licen[sc]e"], [r"license\.coscl\.org\.cn/mulanpsl2"]),
    ("blueoak-1.0.0", ["BlueOak-1.0.0"], ["blue oak model licen[sc]e"], [r"blueoakcouncil\.org/license"]),
    ("cecill", ["CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C"], ["cecill(?:.[bc])? (?:free software )?licen[sc]e"], [r"cecill\.info"]),
    ("odbl-1.0", ["ODbL-1.0"], ["open (?:data commons open )?database licen[sc]e"], [r"opendatacommons\.org/licenses/odbl"]),
    ("odc-by-1.0", ["ODC-By-1.0"], ["open data commons attribution licen[sc]e"], [r"opendatacommons\.org/licenses/by"]),
    ("pddl-1.0", ["PDDL-1.0"], ["public domain dedication and licen[sc]e"], [r"opendatacommons\.org/licenses/pddl"]),
    ("ogl-uk-3.0", ["OGL-UK-1.0", "OGL-UK-2.0", "OGL-UK-3.0"], ["open government licen[sc]e"], [r"nationalarchives\.gov\.uk/doc/open-government-licence"]),
    ("etalab-2.0", ["etalab-2.0"], ["licence ouverte"], [r"etalab\.gouv\.fr/\S{0,200}?licence-ouverte"]),
    ("cc0-1.0", ["CC0-1.0"], ["cc0(?: 1\\.0)?(?: universal)?(?: public domain dedication)? licen[sc]e", "creative commons zero", "licen[sc]ed under cc0", "cc0 1\\.0"], [r"creativecommons\.org/publicdomain/zero"]),
    ("openrail", [], ["open rail.?m licen[sc]e", "bigscience open rail", "creativeml open rail"], []),
    ("llama-community", [], ["llama \\d(?:\\.\\d)? community licen[sc]e"], []),
    ("json", ["JSON"], ["json licen[sc]e"], [r"json\.org/license"]),
    ("beerware", ["Beerware"], ["beer.?ware licen[sc]e"], []),
]

#: Parts of the Creative Commons family and their long names; each is made for these versions.
CC_PARTS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Passages of license texts: label, a word the pattern cannot match without, pattern.
PASSAGES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", "permission to use copy modify and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("gpl", "foundation", "under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl", "foundation", "under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[sc]e"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "warranty", "this software is provided as.is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[sc]e"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", "(?:released|dedicated|placed|is) (?:in|into|to|in to) the public domain"),
    ("all-rights-reserved", "reserved", "(?:copyright|\u00a9|\\(c\\))[\\W_]{1,80}+.{0,80}?all rights reserved"),
    ("proprietary", "proprietary", "(?:proprietary and confidential|this is proprietary software)"),
]

#: Runs of separators are taken whole and never given back, so that no pattern splits one in
#: more than one way; what stands between two of them is bounded.
SEPARATORS = r"[\W_]++"
EDGE = r"(?<![0-9a-z])"
GRANT = re.compile(rf"{EDGE}(?:licen[sc]ed|released|distributed|available|published){SEPARATORS}under{SEPARATORS}")
TAG = re.compile(rf"{EDGE}spdx-license-identifier:\s*+(?:\(\s*+)?")
TAG_WORD, TAG_AND = re.compile(r"[\w.+-]++"), re.compile(r"\s++(?:or|and)\s++")


#: Priorities of rules that begin with GRANT; they are tried only where it occurs.
GRANTS = (60, 61)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern[str]


def _spaced(pattern: str) -> str:
    return pattern.replace(" ?", "\0").replace(" ", SEPARATORS).replace("\0", r"[\W_]*+")


def _from_edge(body: str) -> str:
    """A pattern that begins at an edge: its first letter, if it has one, goes first and is searched fast."""
    if not re.match(r"[a-z0-9](?![?*+{])", body):
        return EDGE + body
    return rf"{body[0]}(?<![0-9a-z]{body[0]}){body[1:]}"


def literal_runs(parsed) -> list[str]:
    """Runs of letters and digits that a parsed pattern cannot match without."""
    runs = [""]
    for kind, value in parsed:
        if kind is _constants.LITERAL and re.match(r"[a-z0-9]", chr(value)):
            runs[-1] += chr(value)
            continue
        if kind in (_constants.ASSERT_NOT, _constants.AT):  # between two letters it takes nothing
            continue
        if kind is _constants.SUBPATTERN:
            runs += literal_runs(value[3])
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0]:
            runs += literal_runs(value[2])
        runs.append("")
    return [x for x in runs if x]


def _keyword(pattern: str) -> str:
    """The longest literal run a pattern cannot match without; ``licen`` only if alone."""
    runs = literal_runs(_parser.parse(pattern))
    return max([x for x in runs if not x.startswith("licen")] or runs, key=len)


def _tag_pattern(identifier: str) -> str:
    return rf"{TAG.pattern}(?:[\w.+-]++\s++(?:or|and)\s++)*{re.escape(identifier)}(?![\w.+-])"


@cache
def _table() -> list[tuple[str, list[str], list[str], list[str]]]:
    """Licenses and the Creative Commons family: label, identifiers, names, addresses."""
    table = [(label, spdx, names, urls) for label, spdx, names, urls in LICENSES]
    for part, long_name in CC_PARTS:
        short = part.replace("-", " ")
        for v in CC_VERSIONS:
            number = re.escape(v)
            table.append((f"cc-{part}-{v}", [f"CC-{part.upper()}-{v}"], [f"cc {short} {number}", f"creative commons {long_name} {number}"], [rf"creativecommons\.org/licenses/{part}/{number}"]))
        table.append((f"cc-{part}", [], [f"cc {short} licen[sc]e", f"creative commons {long_name}"], []))
    return table


@cache
def rules() -> list[Rule]:
    """All rules, the surest kind first: tags, passages, addresses, grants, names."""
    made: list[Rule] = []
    for label, spdx, names, urls in _table():
        versioned = bool(re.search(r"\d", label))
        for s in spdx:
            made.append(Rule(label, 90, 1.0, "spdx", re.compile(_tag_pattern(s.lower()))))
        for u in urls:
            made.append(Rule(label, 70 + versioned, 0.9, _keyword(u), re.compile(u)))
        for n in names:
            body = rf"{_spaced(n)}(?![0-9a-z])"
            made.append(Rule(label, 60 + versioned, 0.95, _keyword(_spaced(n)), re.compile(rf"{GRANT.pattern}(?:the{SEPARATORS})?(?:terms{SEPARATORS}of{SEPARATORS}(?:the{SEPARATORS})?)?(?:gnu{SEPARATORS})?{body}")))
            made.append(Rule(label, 40 + versioned, 0.8, _keyword(_spaced(n)), re.compile(_from_edge(body))))
    for label, keyword, pattern in PASSAGES:
        made.append(Rule(label, 80, 0.9, keyword, re.compile(_spaced(pattern), re.DOTALL)))
    return sorted(made, key=lambda r: -r.priority)


@cache
def _identifiers() -> dict[str, Rule]:
    """Rules of tags by the identifier they look for."""
    own = {s.lower(): label for label, spdx, _, _ in _table() for s in spdx}
    by_pattern = {r.pattern.pattern: r for r in rules() if r.keyword == "spdx"}
    return {s: by_pattern[_tag_pattern(s)] for s in own}


def tagged(lowered: str) -> list[tuple[int, int, Rule]]:
    """What the rules of tags find, each tag read once and its identifiers looked up."""
    found = []
    for tag in TAG.finditer(lowered):
        at, ends = tag.end(), {}
        while word := TAG_WORD.match(lowered, at):
            if rule := _identifiers().get(word[0]):
                ends[rule] = word.end()
            if not (more := TAG_AND.match(lowered, word.end())):
                break
            at = more.end()
        found += [(tag.start(), end, rule) for rule, end in ends.items()]
    return found


@cache
def _automaton():
    import ahocorasick

    by_keyword: dict[str, list[Rule]] = {}
    for r in rules():
        by_keyword.setdefault(r.keyword, []).append(r)
    a = ahocorasick.Automaton()
    for k, found in by_keyword.items():
        a.add_word(k, (k, found))
    a.make_automaton()
    return a


def detections(lowered: str) -> list[tuple[int, int, Rule]]:
    """Places of rules that stand after suppression, in text order.

    Rules are tried only where their keyword occurs. By priority, then length, then
    place, a place is dropped if a kept one of another or the same rule contains it: if
    the furthest end of kept places that start no later reaches its end. Those furthest
    ends are prefix maxima in a tree over starts, so time grows with hits * log(hits).
    """
    gated = {k: found for _, (k, found) in _automaton().iter(lowered)}
    granted = GRANT.search(lowered) is not None
    hits = [(m.start(), m.end(), r) for k, found in gated.items() if k != "spdx" for r in found if granted or r.priority not in GRANTS for m in r.pattern.finditer(lowered)]
    if "spdx" in gated:
        hits += tagged(lowered)
    hits.sort(key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label))
    place = {start: k + 1 for k, start in enumerate(sorted({h[0] for h in hits}))}
    furthest = [-1] * (len(place) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in hits:
        k, reach = place[start], -1
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= end:
            continue
        kept.append((start, end, rule))
        k = place[start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], end)
            k += k & -k
    return sorted(kept, key=lambda h: (h[0], h[1]))


_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(w.encode() for w in words) + rb"(?![0-9a-z\x80-\xff])"), label) for words, label in BASE_PHRASES.items()]


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    raw = (text or "").encode("utf-8").lower()
    is_word = _IS_WORD[np.frombuffer(raw, dtype=np.uint8)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    n_words = int(np.count_nonzero(starts))
    places, base = [], set()
    if b"license" in raw:
        for pattern, label in _BASE:
            found = [m.start() for m in pattern.finditer(raw)]
            if found:
                places += found
                base.add(label)
    places = [int(np.count_nonzero(starts[:p])) for p in sorted(places)] if len(places) < 16 else list(np.cumsum(starts)[np.array(sorted(places))] - 1)
    kept = detections(raw.decode("utf-8"))
    labels = base | {r.label for _, _, r in kept}
    score = max([0.8 * bool(base), *(r.confidence for _, _, r in kept)])
    return n_words, len(places), (int(places[0]) if places else None), (int(places[-1]) if places else None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


def scan_licenses(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """License findings of every row, from its whole text.

    Null or empty text: no words, no labels, score 0. Phrases are matched on words, so
    any characters between words do. Rows are independent; repeated rows repeat.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches):
        for batch in batches:
            rows = [scan_text(v.as_py()) for v in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(row_id).cast("long"), F.col(text).cast("string")).mapInArrow(scan, schema)
