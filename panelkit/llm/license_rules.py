"""License scans with ordered signature rules.

A rule is a regex over the lower-cased text, a label, a priority, a
confidence and the keyword that any match must contain. ``RULES`` holds a few
hundred, hand-written per license and per place a license is named in: an SPDX
tag, a manifest field, a grant sentence, a title, an address, a notice text.
One Aho-Corasick pass over the normalised words finds the keywords; only rules
whose keyword occurs are tried. Detections are taken by priority, then length,
then start; one whose span lies inside an accepted span of another is
suppressed.

Base places (``PHRASES`` in consecutive words) are counted on the words alone
and their labels always stay.

Score: the highest confidence among base places and accepted detections, 0
without any.

Cases: a null text is empty (no words, null first and last word, empty
labels, score 0); rows are independent, so ties, repeats and extra columns
need nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table

#: A-Z to a-z; every other byte outside words (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``) to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: As ``WORDS``, for the gate: bytes from 0x80 up to a space, as the borders and white space of the rules have it.
GATE_WORDS = bytes(b if b < 128 else 32 for b in WORDS)
PHRASES = ((b" mit license ", "mit"), (b" apache license ", "apache"), (b" general public license ", "gpl"))
BASE_CONFIDENCE = 0.7


class Rule(NamedTuple):
    label: str
    regex: re.Pattern
    keyword: str  # words that stand consecutively in the text of any match
    priority: int
    confidence: float


#: label; SPDX ids (regex); names as they stand in titles and grants (regex); keyword of the names; addresses (regex); keyword of the addresses
LICENSES = (
    ("mit", r"mit", r"(?:the )?mit(?:/x11| \(expat\))? licen[sc]e", "mit", r"opensource\.org/licenses?/mit", "opensource org"),
    ("apache-2.0", r"apache-2\.0", r"apache(?: software)? licen[sc]e,? (?:version )?2(?:\.0)?|apache 2(?:\.0)? licen[sc]e", "apache", r"apache\.org/licenses/license-2\.0", "apache org"),
    ("apache-1.1", r"apache-1\.1", r"apache(?: software)? licen[sc]e,? (?:version )?1\.1", "apache", r"apache\.org/licenses/license-1\.1", "apache org"),
    ("apache-1.0", r"apache-1\.0", r"apache(?: software)? licen[sc]e,? (?:version )?1\.0", "apache", r"apache\.org/licenses/license-1\.0", "apache org"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public licen[sc]e,? (?:\(gpl\) )?(?:version |v)3(?:\.0)?|gplv3|gnu gpl,? (?:version |v)?3", "3", r"gnu\.org/licenses/gpl-3\.0", "gnu org"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public licen[sc]e,? (?:\(gpl\) )?(?:version |v)2(?:\.0)?|gplv2|gnu gpl,? (?:version |v)?2", "2", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gnu org"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public licen[sc]e,? (?:version |v)1(?:\.0)?|gplv1", "1", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0", "gnu org"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?lesser general public licen[sc]e,? (?:\(lgpl\) )?(?:version |v)3(?:\.0)?|lgplv3", "3", r"gnu\.org/licenses/lgpl-3\.0", "gnu org"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?lesser general public licen[sc]e,? (?:\(lgpl\) )?(?:version |v)2\.1|lgplv2\.1", "1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "gnu org"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?library general public licen[sc]e,? (?:version |v)2(?:\.0)?", "library general public", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0", "gnu org"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?affero general public licen[sc]e,? (?:version |v)3(?:\.0)?|agplv3", "3", r"gnu\.org/licenses/agpl-3\.0", "gnu org"),
    ("agpl-1.0", r"agpl-1\.0", r"affero general public licen[sc]e,? (?:version |v)1(?:\.0)?", "affero general public", r"affero\.org/oagpl", "affero org"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu free documentation licen[sc]e,? (?:version |v)1\.3", "free documentation", r"gnu\.org/licenses/fdl-1\.3", "gnu org"),
    ("gfdl-1.2", r"gfdl-1\.2(?:-only|-or-later)?", r"gnu free documentation licen[sc]e,? (?:version |v)1\.2", "free documentation", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2", "gnu org"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd 2-clause", "bsd", r"opensource\.org/licenses?/bsd-2-clause", "opensource org"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd 3-clause", "bsd", r"opensource\.org/licenses?/bsd-3-clause", "opensource org"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|old|4-clause|four-clause) bsd licen[sc]e|bsd 4-clause", "bsd", r"spdx\.org/licenses/bsd-4-clause", "spdx org"),
    ("0bsd", r"0bsd", r"zero-clause bsd|bsd zero[- ]clause licen[sc]e", "bsd", r"opensource\.org/licenses?/0bsd", "opensource org"),
    ("isc", r"isc", r"isc licen[sc]e", "isc", r"opensource\.org/licenses?/isc", "opensource org"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[sc]e,? (?:version |v)?2(?:\.0)?", "mozilla public", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla org"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[sc]e,? (?:version |v)?1\.1", "mozilla public", r"mozilla\.org/(?:en-us/)?mpl/1\.1", "mozilla org"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[sc]e,? (?:- )?(?:version |v)?2(?:\.0)?", "eclipse public", r"eclipse\.org/legal/epl-(?:v?2)", "eclipse org"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[sc]e,? (?:- )?(?:version |v)?1(?:\.0)?", "eclipse public", r"eclipse\.org/legal/epl-(?:v?1)", "eclipse org"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[sc]e,? (?:\(cddl\) )?(?:version |v)?1\.0", "common development", r"opensource\.org/licenses?/cddl-1\.0", "opensource org"),
    ("cddl-1.1", r"cddl-1\.1", r"common development and distribution licen[sc]e,? (?:\(cddl\) )?(?:version |v)?1\.1", "common development", r"spdx\.org/licenses/cddl-1\.1", "spdx org"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[sc]e,? (?:version |v)?1\.0", "common public", r"opensource\.org/licenses?/cpl1?\.0", "opensource org"),
    ("cpal-1.0", r"cpal-1\.0", r"common public attribution licen[sc]e", "common public attribution", r"opensource\.org/licenses?/cpal", "opensource org"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[sc]e,? (?:version |v)?2(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-2", "opensource org"),
    ("artistic-1.0", r"artistic-1\.0(?:-perl|-cl8)?", r"artistic licen[sc]e,? (?:version |v)?1(?:\.0)?", "artistic", r"opensource\.org/licenses?/artistic-1", "opensource org"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[sc]e", "boost software", r"boost\.org/license_1_0", "boost org"),
    ("busl-1.1", r"busl-1\.1", r"business source licen[sc]e,? (?:version |v)?1\.1", "business source", r"mariadb\.com/bsl11", "mariadb com"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[sc]e,? (?:version |v)?2(?:\.0)?", "elastic", r"elastic\.co/licensing/elastic-license", "elastic co"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[sc]e", "server side public", r"mongodb\.com/licensing/server-side-public-license", "mongodb com"),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", r"opensource\.org/licenses?/zlib", "opensource org"),
    ("libpng", r"libpng(?:-2\.0)?", r"(?:png reference library|libpng) licen[sc]e", "license", r"libpng\.org/pub/png/src/libpng-license", "libpng org"),
    ("unlicense", r"unlicense", r"the unlicense", "the unlicense", r"unlicense\.org", "unlicense org"),
    ("wtfpl", r"wtfpl", r"do what the f\w* you want to public licen[sc]e", "you want to public", r"wtfpl\.net", "wtfpl net"),
    ("cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", "c", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons org"),
    ("pdm-1.0", r"(?:pdm-1\.0|cc-pddc)", r"public domain mark(?: 1\.0)?", "public domain mark", r"creativecommons\.org/publicdomain/mark/1\.0", "creativecommons org"),
    ("cc-by-4.0", r"cc-by-4\.0", r"cc[- ]by[- ]4\.0|creative commons attribution 4\.0", "4 0", r"creativecommons\.org/licenses/by/4\.0", "creativecommons org"),
    ("cc-by-3.0", r"cc-by-3\.0", r"cc[- ]by[- ]3\.0|creative commons attribution 3\.0", "3 0", r"creativecommons\.org/licenses/by/3\.0", "creativecommons org"),
    ("cc-by-2.5", r"cc-by-2\.5", r"cc[- ]by[- ]2\.5|creative commons attribution 2\.5", "2 5", r"creativecommons\.org/licenses/by/2\.5", "creativecommons org"),
    ("cc-by-2.0", r"cc-by-2\.0", r"cc[- ]by[- ]2\.0|creative commons attribution 2\.0", "2 0", r"creativecommons\.org/licenses/by/2\.0", "creativecommons org"),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"cc[- ]by[- ]sa[- ]4\.0|creative commons attribution-sharealike 4\.0", "4 0", r"creativecommons\.org/licenses/by-sa/4\.0", "creativecommons org"),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"cc[- ]by[- ]sa[- ]3\.0|creative commons attribution-sharealike 3\.0", "3 0", r"creativecommons\.org/licenses/by-sa/3\.0", "creativecommons org"),
    ("cc-by-sa-2.5", r"cc-by-sa-2\.5", r"cc[- ]by[- ]sa[- ]2\.5|creative commons attribution-sharealike 2\.5", "2 5", r"creativecommons\.org/licenses/by-sa/2\.5", "creativecommons org"),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"cc[- ]by[- ]nc[- ]4\.0|creative commons attribution-noncommercial 4\.0", "4 0", r"creativecommons\.org/licenses/by-nc/4\.0", "creativecommons org"),
    ("cc-by-nc-3.0", r"cc-by-nc-3\.0", r"cc[- ]by[- ]nc[- ]3\.0|creative commons attribution-noncommercial 3\.0", "3 0", r"creativecommons\.org/licenses/by-nc/3\.0", "creativecommons org"),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"cc[- ]by[- ]nd[- ]4\.0|creative commons attribution-noderivatives 4\.0", "4 0", r"creativecommons\.org/licenses/by-nd/4\.0", "creativecommons org"),
    ("cc-by-nd-3.0", r"cc-by-nd-3\.0", r"cc[- ]by[- ]nd[- ]3\.0|creative commons attribution-noderivs 3\.0", "3 0", r"creativecommons\.org/licenses/by-nd/3\.0", "creativecommons org"),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"cc[- ]by[- ]nc[- ]sa[- ]4\.0|creative commons attribution-noncommercial-sharealike 4\.0", "4 0", r"creativecommons\.org/licenses/by-nc-sa/4\.0", "creativecommons org"),
    ("cc-by-nc-sa-3.0", r"cc-by-nc-sa-3\.0", r"cc[- ]by[- ]nc[- ]sa[- ]3\.0|creative commons attribution-noncommercial-sharealike 3\.0", "3 0", r"creativecommons\.org/licenses/by-nc-sa/3\.0", "creativecommons org"),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"cc[- ]by[- ]nc[- ]nd[- ]4\.0|creative commons attribution-noncommercial-noderivatives 4\.0", "4 0", r"creativecommons\.org/licenses/by-nc-nd/4\.0", "creativecommons org"),
    ("cc-by-nc-nd-3.0", r"cc-by-nc-nd-3\.0", r"cc[- ]by[- ]nc[- ]nd[- ]3\.0|creative commons attribution-noncommercial-noderivs 3\.0", "3 0", r"creativecommons\.org/licenses/by-nc-nd/3\.0", "creativecommons org"),
    ("odbl-1.0", r"odbl-1\.0", r"open database licen[sc]e", "open database", r"opendatacommons\.org/licenses/odbl", "opendatacommons org"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[sc]e", "open data commons", r"opendatacommons\.org/licenses/by", "opendatacommons org"),
    ("pddl-1.0", r"pddl-1\.0", r"open data commons public domain dedication", "open data commons", r"opendatacommons\.org/licenses/pddl", "opendatacommons org"),
    ("ogl-uk-3.0", r"ogl-uk-3\.0", r"open government licen[sc]e(?:,? (?:version |v)?3(?:\.0)?)?", "open government", r"nationalarchives\.gov\.uk/doc/open-government-licence/version/3", "nationalarchives gov uk"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil )?open font licen[sc]e", "open font", r"scripts\.sil\.org/ofl", "sil org"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[sc]e,? (?:version |v)?\.? ?1\.2", "european union public", r"joinup\.ec\.europa\.eu/[\w/-]*eupl", "europa eu"),
    ("eupl-1.1", r"eupl-1\.1", r"european union public licen[sc]e,? (?:version |v)?\.? ?1\.1", "european union public", r"ec\.europa\.eu/idabc/eupl", "europa eu"),
    ("cecill-2.1", r"cecill-2\.1", r"cecill(?: free software)? licen[sc]e", "cecill", r"cecill\.info/licences", "cecill info"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[sc]e", "microsoft public", r"opensource\.org/licenses?/ms-pl", "opensource org"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft reciprocal", r"opensource\.org/licenses?/ms-rl", "opensource org"),
    ("python-2.0", r"(?:python-2\.0|psf-2\.0)", r"python software foundation licen[sc]e|psf licen[sc]e", "license", r"docs\.python\.org/[\w./]*license", "docs python org"),
    ("php-3.01", r"php-3\.01", r"php licen[sc]e,? (?:version |v)?3\.01", "php", r"php\.net/license/3_01", "php net"),
    ("ruby", r"ruby", r"ruby licen[sc]e", "ruby", r"ruby-lang\.org/[\w/]*license", "ruby lang org"),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e", "postgresql", r"postgresql\.org/about/licence", "postgresql org"),
    ("openssl", r"openssl", r"openssl licen[sc]e", "openssl", r"openssl\.org/source/license", "openssl org"),
    ("ncsa", r"ncsa", r"university of illinois/ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa", r"opensource\.org/licenses?/ncsa", "opensource org"),
    ("ecl-2.0", r"ecl-2\.0", r"educational community licen[sc]e", "educational community", r"opensource\.org/licenses?/ecl-2", "opensource org"),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[sc]e", "academic free", r"opensource\.org/licenses?/afl-3", "opensource org"),
    ("osl-3.0", r"osl-3\.0", r"open software licen[sc]e", "open software", r"opensource\.org/licenses?/osl-3", "opensource org"),
    ("upl-1.0", r"upl-1\.0", r"universal permissive licen[sc]e", "universal permissive", r"oss\.oracle\.com/licenses/upl", "oss oracle com"),
    ("blueoak-1.0.0", r"blueoak-1\.0\.0", r"blue oak model licen[sc]e", "blue oak model", r"blueoakcouncil\.org/license", "blueoakcouncil org"),
    ("mulanpsl-2.0", r"mulanpsl-2\.0", r"mulan permissive software licen[sc]e", "mulan permissive", r"license\.coscl\.org\.cn/mulanpsl2", "coscl org"),
    ("openrail", r"(?:bigscience-)?openrail(?:-m|\+\+)?", r"(?:creativeml )?open ?rail(?:-m)?(?: licen[sc]e)?", "rail", r"huggingface\.co/spaces/bigscience/license", "huggingface co"),
)

#: label, regex, keyword, confidence: licenses named without a version, and notices told by their wording
NOTICES = (
    ("apache", r"apache licen[sc]e", "apache", 0.7),
    ("gpl", r"(?:gnu )?general public licen[sc]e", "general public", 0.7),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", 0.75),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero general public", 0.75),
    ("gpl", r"gnu gpl\b", "gnu gpl", 0.7),
    ("bsd", r"bsd(?:-style)? licen[sc]e", "bsd", 0.65),
    ("mpl", r"mozilla public licen[sc]e", "mozilla public", 0.7),
    ("epl", r"eclipse public licen[sc]e", "eclipse public", 0.7),
    ("artistic", r"artistic licen[sc]e", "artistic", 0.65),
    ("creative-commons", r"creative commons(?: [\w-]+){0,3} licen[sc]e", "creative commons", 0.6),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted", 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "above copyright notice", 0.9),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use", 0.95),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use", 0.9),
    ("bsd-3-clause", r"neither the name of [^.]{1,200} may be used to endorse or promote products", "neither the name of", 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials", 0.95),
    ("gpl", r"this program is free software[;:,] you can redistribute it and/or modify", "this program is free software", 0.9),
    ("lgpl", r"this library is free software[;:,] you can redistribute it and/or modify", "this library is free software", 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. 2\.0", "source code form", 0.98),
    ("bsl-1.0", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy", "person or organization", 0.95),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "as is without any express", 0.85),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered", 0.98),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "the public domain", 0.7),
    ("proprietary", r"all rights reserved", "all rights reserved", 0.4),
    ("copyright", r"copyright (?:\(c\) |© )?(?:19|20)\d\d", "copyright", 0.3),
)

GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|made available|is) (?:\w+ ){0,2}?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def _compile(pattern: str) -> re.Pattern:
    """Spaces stand for any white space, " ?" also for none; no match begins or ends in a word."""
    return re.compile(r"(?<![0-9a-z])(?:" + pattern.replace(" ?", r"\s*").replace(" ", r"\s+") + r")(?![0-9a-z])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    out = []
    for label, spdx, name, name_key, address, address_key in LICENSES:
        out += [
            Rule(label, _compile(r"spdx-license-identifier: ?" + spdx + r"(?![.+-]\w)"), "spdx license identifier", 100, 1.0),
            Rule(label, _compile(r"licen[sc]e[\"']? ?[:=] ?[\"']?" + spdx + r"(?![.+-]\w)"), "", 90, 0.95),
            Rule(label, _compile(GRANT + "(?:" + name + ")"), "under", 80, 0.95),
            Rule(label, _compile(address), address_key, 70, 0.9),
            Rule(label, _compile(name), name_key, 60, 0.85),
        ]
    out += [Rule(label, _compile(name), key, 40, c) for label, name, key, c in NOTICES]
    return tuple(out)


@lru_cache(maxsize=1)
def _gate() -> ahocorasick.Automaton:
    """Keyword to the rules that need it; manifest rules need "license"."""
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for key in ([r.keyword] if r.keyword else ["license", "licence"]):
            by_key.setdefault(key, []).append(i)
    auto = ahocorasick.Automaton()
    for key, found in by_key.items():
        auto.add_word(key, found)
    auto.make_automaton()
    return auto


#: Every match of every rule holds one of these in its padded gate words. Few texts
#: do, so most stop here.
ANCHORS = (b"license", b"licence", b"spdx", b"copyright", b"domain", b"reserved", b"software", b"permission",
           b"redistribution", b"neither", b"advertising", b"without any express", b"unencumbered", b"source code",
           b"gpl", b" cc", b"rail", b"commons", b"zero", b"bsd", b" org ", b" com ", b" net ", b" info ", b" co ",
           b" gov ", b" eu ")


def detections(low: str, gate: bytes, gated: bool = True) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of every rule match, in rule order. ``gate``: the
    ASCII words, padded."""
    every = rules()
    if gated:
        if not any(a in gate for a in ANCHORS):
            return []
        tried = sorted({i for _, found in _gate().iter(gate.decode("ascii")) for i in found})
    else:
        tried = range(len(every))
    return [(m.start(), m.end(), every[i]) for i in tried for m in every[i].regex.finditer(low)]


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no accepted one of higher rank contains.

    What contains a dropped detection is itself contained in an accepted one,
    so any detection of higher rank will do; of one priority, longer ones rank
    higher. So one sweep per priority with the furthest end so far, and one
    search in the starts of the higher priorities."""
    kept: list = []
    starts: list[int] = []
    furthest: list[int] = []  # of the detections of higher priority up to each start
    above: list[tuple[int, int]] = []
    for _, level in groupby(sorted(found, key=lambda x: -x[2].priority), key=lambda x: -x[2].priority):
        end, mine = -1, []
        for a, b, r in sorted(level, key=lambda x: (x[0], -x[1], x[2].label)):
            at = bisect_right(starts, a)
            if end < b and not (at and furthest[at - 1] >= b):
                mine.append((a, b, r))
            end = max(end, b)
        kept += mine
        above = sorted(above + [(a, b) for a, b, _ in mine])
        starts, furthest = [a for a, _ in above], list(accumulate((b for _, b in above), max))
    return kept


def base_places(padded: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every base phrase in ``b' word word ... '``."""
    out = []
    for phrase, label in PHRASES:
        words, last, at = 0, 0, padded.find(phrase)
        while at >= 0:
            words, last = words + padded.count(b" ", last, at), at
            out.append((words, label))
            at = padded.find(phrase, at + 1)
    return out


def scan_text(text: str, gated: bool = True) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    raw = text.encode("utf-8", "replace")
    words = raw.translate(WORDS).split()
    padded = b" %b " % b" ".join(words)
    places = base_places(padded) if b"license" in padded else []
    gate = padded if padded.isascii() else b" %b " % b" ".join(padded.translate(GATE_WORDS).split())
    kept = resolve(detections(raw.lower().decode("utf-8"), gate, gated))
    starts = [w for w, _ in places]
    base = {x for _, x in places}
    labels = base | {r.label for _, _, r in kept}
    best = max([r.confidence for _, _, r in kept] + [BASE_CONFIDENCE] * bool(places), default=0.0)
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), best, ",".join(f"{r.label}:{a}:{b}" for a, b, r in sorted(kept, key=lambda x: x[:2])))


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, " \
    "score double, spans string"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id and the fields of ``scan_text``."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([scan_text(t) for t in pdf["text"].fillna("")], columns=names)
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, "id", pdf["id"].array)
            yield out

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, f"id long, {FIELDS}").withColumnRenamed("id", id_col)


@register("op6_license_rules")
def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places, labels and score of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")
