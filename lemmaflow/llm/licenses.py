"""License scans by ordered signature rules.

Signature rules are regular expressions over a text of normalised words (lower case, one space between
words): hand-written sentences of the licenses' texts, notices and headers (the phrases of LICENSES, SENTENCES), and for the
hand-written names of each license the four KINDS of mention. A rule runs only where literals occur that
every match of its pattern contains (`gates`, read off the pattern itself, so none is lost); all literals are found by one
pass of an automaton.
Detections that overlap are resolved by priority: kinds rank from full grants over notices to bare
names, a longer match ranks before a shorter one, and a match inside the interval of a better one is
suppressed. Labels are those of the detections left and of the four base phrases, which always stay.

Ties: of detections of one priority and length the earlier one ranks first, of equal intervals the license with the longer label, then the smaller one.

Edge cases: null text is the empty text: no words, no labels, score 0. Very long texts are read whole; base phrases are
counted in one pass. Rows are independent: repeated rows repeat, null doc_ids are carried, an empty table stays empty,
extra columns are not carried.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: License: (names as words, phrases of its grant or notice). Words are lower-case letters and digits.
LICENSES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (r"mit|expat|mit x11", (r"permission is hereby granted free of charge to any person obtaining a copy of this software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software")),
    "mit-0": (r"mit 0|mit no attribution", (r"mit no attribution",)),
    "apache": (r"apache(?: software)?", (r"apache software license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance")),
    "apache-2.0": (r"apache(?: license)?(?: version)? 2(?: 0)?", (r"www apache org licenses license 2 0",)),
    "apache-1.1": (r"apache(?: software)?(?: license)?(?: version)? 1 1", (r"the names apache server and apache group must not be used",)),
    "gpl": (r"gpl|gnu gpl|gnu general public", (r"terms of the gnu general public license", r"received a copy of the gnu general public license")),
    "gpl-2.0": (r"gpl ?v?2(?: 0)?(?: only)?|gnu general public license(?: version)? v?2", (r"gnu general public license as published by the free software foundation either version 2",)),
    "gpl-3.0": (r"gpl ?v?3(?: 0)?(?: only)?|gnu general public license(?: version)? v?3", (r"gnu general public license as published by the free software foundation either version 3",)),
    "lgpl": (r"lgpl|gnu lgpl|gnu lesser general public|gnu library general public", (r"terms of the gnu (?:lesser|library) general public license",)),
    "lgpl-2.1": (r"lgpl ?v?2 1|gnu lesser general public license(?: version)? v?2 1", (r"lesser general public license as published by the free software foundation either version 2 1",)),
    "lgpl-3.0": (r"lgpl ?v?3(?: 0)?|gnu lesser general public license(?: version)? v?3", (r"lesser general public license as published by the free software foundation either version 3",)),
    "agpl": (r"agpl ?v?3?(?: 0)?|gnu agpl|gnu affero general public|affero general public", (r"terms of the gnu affero general public license",)),
    "bsd": (r"bsd|bsd style|berkeley software distribution", (r"bsd style license",)),
    "bsd-2-clause": (r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd", (r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",)),
    "bsd-3-clause": (r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", (r"neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote",)),
    "bsd-4-clause": (r"bsd 4 clause|4 clause bsd|original bsd", (r"all advertising materials mentioning features or use of this software must display",)),
    "isc": (r"isc", (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided",)),
    "mpl": (r"mpl|mozilla public", (r"subject to the terms of the mozilla public license",)),
    "mpl-2.0": (r"mpl 2(?: 0)?|mozilla public license(?: version)? v?2(?: 0)?", (r"this source code form is subject to the terms of the mozilla public license v 2 0",)),
    "epl": (r"epl|eclipse public", (r"made available under the terms of the eclipse public license",)),
    "epl-2.0": (r"epl 2(?: 0)?|eclipse public license(?: version)? v?2(?: 0)?", (r"www eclipse org legal epl 2 0",)),
    "cddl": (r"cddl(?: 1 [01])?|common development and distribution", (r"subject to the terms of the common development and distribution license",)),
    "cpl": (r"cpl(?: 1 0)?|common public", (r"accompanying program is provided under the terms of this common public license",)),
    "eupl": (r"eupl(?: v?1 [012])?|european union public", (r"licensed under the eupl",)),
    "artistic": (r"artistic(?: 2 0)?|perl artistic", (r"terms of the artistic license",)),
    "zlib": (r"zlib|zlib libpng", (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",)),
    "libpng": (r"libpng(?: 2)?", (r"the png reference library is supplied as is",)),
    "boost": (r"boost(?: software)?|bsl 1 0", (r"distributed under the boost software license version 1 0",)),
    "unlicense": (r"unlicense", (r"this is free and unencumbered software released into the public domain",)),
    "public-domain": (r"public domain", (r"(?:released|placed|dedicated) (?:in|into|to) the public domain", r"public domain dedication", r"is in the public domain")),
    "wtfpl": (r"wtfpl|do what the fuck you want to public", (r"you just do what the fuck you want to",)),
    "beerware": (r"beerware|beer ware", (r"you can buy me a beer in return",)),
    "cc0": (r"cc0(?: 1 0)?|cc zero|creative commons zero", (r"creative commons cc0 1 0 universal", r"creativecommons org publicdomain zero")),
    "cc-by": (r"cc by(?: [1234] [05])?|creative commons attribution(?: [1234] [05])?", (r"creativecommons org licenses by [1234] [05]",)),
    "cc-by-sa": (r"cc by sa(?: [1234] [05])?|creative commons attribution share ?alike(?: [1234] [05])?", (r"creativecommons org licenses by sa",)),
    "cc-by-nc": (r"cc by nc(?: [1234] [05])?|creative commons attribution non ?commercial(?: [1234] [05])?", (r"creativecommons org licenses by nc [1234]",)),
    "cc-by-nd": (r"cc by nd(?: [1234] [05])?|creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?", (r"creativecommons org licenses by nd",)),
    "cc-by-nc-sa": (r"cc by nc sa(?: [1234] [05])?|creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", (r"creativecommons org licenses by nc sa",)),
    "cc-by-nc-nd": (r"cc by nc nd(?: [1234] [05])?|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?", (r"creativecommons org licenses by nc nd",)),
    "gfdl": (r"gfdl(?: 1 [0123])?|gnu free documentation", (r"terms of the gnu free documentation license",)),
    "odbl": (r"odbl(?: 1 0)?|open database", (r"open data commons open database license",)),
    "odc-by": (r"odc by|open data commons attribution", (r"open data commons attribution license",)),
    "pddl": (r"pddl|open data commons public domain dedication", (r"public domain dedication and license",)),
    "ofl": (r"ofl(?: 1 [01])?|sil open font|open font", (r"licensed under the sil open font license",)),
    "psf": (r"psf(?: 2 0)?|python software foundation|python(?: 2 0)?", (r"python software foundation license version 2",)),
    "php": (r"php(?: 3 0(?: 1)?)?", (r"redistributions of any form whatsoever must retain the following acknowledgment this product includes php",)),
    "ruby": (r"ruby", (r"you may make and give away verbatim copies of the source form of the software",)),
    "openssl": (r"openssl", (r"this product includes software developed by the openssl project",)),
    "postgresql": (r"postgresql", (r"postgresql license",)),
    "ncsa": (r"ncsa|university of illinois ncsa", (r"university of illinois ncsa open source license",)),
    "afl": (r"afl(?: 3 0)?|academic free", (r"licensed under the academic free license",)),
    "osl": (r"osl(?: 3 0)?|open software", (r"licensed under the open software license",)),
    "ms-pl": (r"ms pl|microsoft public", (r"microsoft public license ms pl",)),
    "ms-rl": (r"ms rl|microsoft reciprocal", (r"microsoft reciprocal license",)),
    "apsl": (r"apsl(?: 2 0)?|apple public source", (r"subject to the apple public source license",)),
    "qpl": (r"qpl(?: 1 0)?|q public", (r"terms of the q public license",)),
    "sleepycat": (r"sleepycat", (r"sleepycat license",)),
    "w3c": (r"w3c(?: software)?", (r"w3c software notice and license",)),
    "unicode": (r"unicode(?: dfs)?", (r"unicode license agreement data files and software",)),
    "bsl-business": (r"business source(?: 1 1)?", (r"business source license 1 1",)),
    "sspl": (r"sspl(?: 1 0)?|server side public", (r"server side public license version 1",)),
    "elastic": (r"elastic(?: 2 0)?", (r"elastic license 2 0",)),
    "openrail": (r"openrail(?: m)?|bigscience rail|creativeml openrail m", (r"responsible ai license",)),
    "proprietary": (r"proprietary|commercial", (r"all rights reserved", r"proprietary and confidential", r"no part of (?:\w+ ){1,8}may be reproduced")),
}

#: Further sentences of the licenses' own texts, notices and headers, each written by hand for one license.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit": (
        r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        r"except as contained in this notice the name of (?:\w+ ){1,8}shall not be used in advertising",
    ),
    "mit-0": (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:\w+ ){1,40}the software is provided as is",),
    "apache-2.0": (
        r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated in this section patent) license",
        r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        r"see the license for the specific language governing permissions and limitations under the license",
        r"you must give any other recipients of the work or derivative works a copy of this license",
    ),
    "apache-1.1": (r"this product includes software developed by the apache software foundation", r"products derived from this software may not be called apache"),
    "gpl": (
        r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability",
        r"(?:it|this program) (?:\w+ )?free software you can redistribute it and or modify it under the terms of the gnu general public license",
        r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    "gpl-2.0": (
        r"this general public license applies to most of the free software foundation s software",
        r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium",
        r"gnu general public license version 2 june 1991",
    ),
    "gpl-3.0": (
        r"the gnu general public license is a free copyleft license for software and other kinds of works",
        r"to convey a work means any kind of propagation that enables other parties to make or receive copies",
        r"gnu general public license version 3 29 june 2007",
    ),
    "lgpl": (r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    "lgpl-3.0": (r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3",),
    "agpl": (r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation", r"remote network interaction use with the gnu general public license"),
    "bsd": (r"copyright c (?:\w+ ){1,12}the regents of the university of california",),
    "bsd-2-clause": (r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", r"the views and conclusions contained in the software and documentation are those of the authors"),
    "bsd-3-clause": (r"neither the name of the copyright holder nor the names of its contributors", r"neither the name of the university nor the names of its contributors"),
    "bsd-4-clause": (r"this product includes software developed by the university of california berkeley and its contributors",),
    "0bsd": (r"(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    "isc": (r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "mpl-2.0": (r"if a copy of the mpl was not distributed with this file you can obtain one at", r"covered software is provided under this license on an as is basis", r"mozilla org mpl 2 0"),
    "mpl": (r"the contents of this file are subject to the mozilla public license version 1 [01]",),
    "epl": (r"this program and the accompanying materials are made available under the terms of the eclipse public license", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    "epl-2.0": (r"secondary licenses when the conditions for such availability set forth in the eclipse public license",),
    "cddl": (r"you can obtain a copy of the license at (?:\w+ ){1,12}cddl", r"covered software includes modifications the original software or the combination of modifications and original software"),
    "eupl": (r"the work or software which is provided under the terms of this (?:european union public )?licence",),
    "artistic": (r"the copyright holder maintains some semblance of artistic control over the development of the package", r"you may apply bug fixes portability fixes and other modifications derived from the public domain"),
    "zlib": (r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    "libpng": (r"the contributing authors and group 42 inc disclaim all warranties", r"this code is released under the libpng license"),
    "boost": (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", r"www boost org license 1 0"),
    "unlicense": (r"anyone is free to copy modify publish use compile sell or distribute this software", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", r"unlicense org"),
    "public-domain": (r"no copyright is claimed", r"has been (?:released|placed|dedicated) (?:in|into|to) the public domain by (?:the|its) authors?", r"the author disclaims copyright to this source code"),
    "wtfpl": (r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "beerware": (r"as long as you retain this notice you can do whatever you want with this stuff",),
    "cc0": (r"the person who associated a work with this deed has dedicated the work to the public domain", r"to the extent possible under law (?:\w+ ){1,12}waived all copyright and related or neighboring rights"),
    "cc-by": (r"you are free to share copy and redistribute the material in any medium or format", r"you must give appropriate credit provide a link to the license and indicate if changes were made", r"this work is licensed under a creative commons attribution [1234] [05] international license"),
    "cc-by-sa": (r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", r"this work is licensed under a creative commons attribution share ?alike [1234] [05] international license"),
    "cc-by-nc": (r"you may not use the material for commercial purposes", r"this work is licensed under a creative commons attribution non ?commercial [1234] [05] international license"),
    "cc-by-nd": (r"if you remix transform or build upon the material you may not distribute the modified material",),
    "gfdl": (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", r"with no invariant sections no front cover texts and no back cover texts"),
    "odbl": (r"this database is made available under the open database license", r"any rights in individual contents of the database are licensed under the database contents license"),
    "odc-by": (r"this (?:\w+ ){1,6}is made available under the open data commons attribution license",),
    "ofl": (r"the font software may be modified altered or added to", r"this font software is licensed under the sil open font license", r"scripts sil org ofl"),
    "psf": (r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly", r"this license agreement is between the python software foundation"),
    "php": (r"this source file is subject to version 3 0(?: |1 )?(?:\w+ )?of the php license", r"the name php must not be used to endorse or promote products derived from this software"),
    "ruby": (r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", r"ruby is copyrighted free software"),
    "openssl": (r"the names openssl toolkit and openssl project must not be used to endorse or promote products", r"this product includes cryptographic software written by eric young"),
    "postgresql": (r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",),
    "ncsa": (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction",),
    "osl": (r"licensed under the open software license version 3 0",),
    "ms-pl": (r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution",),
    "apsl": (r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license",),
    "sleepycat": (r"redistributions in any form must be accompanied by information on how to obtain complete source code",),
    "w3c": (r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted",),
    "unicode": (r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files",),
    "bsl-business": (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", r"change date (?:\w+ ){0,8}change license"),
    "sspl": (r"if you make the functionality of the program or a modified version available to third parties as a service",),
    "elastic": (r"you may not provide the software to third parties as a hosted or managed service",),
    "openrail": (r"use based restrictions as referenced in paragraph 5", r"you agree not to use the model or derivatives of the model"),
    "proprietary": (
        r"unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|material|document) (?:\w+ ){0,8}(?:is )?(?:strictly )?prohibited", r"this (?:software|document|material) is the (?:confidential|proprietary) (?:and proprietary )?(?:property|information) of",
        r"without the prior written (?:permission|consent) of the (?:publisher|copyright owner|author)", r"alle rechte vorbehalten", r"tous droits réservés", r"todos los derechos reservados",
    ),
    "llama": (r"llama [234](?: [0-9])? community license(?: agreement)?", r"built with (?:meta )?llama"),
    "gemma": (r"gemma terms of use", r"gemma prohibited use policy"),
    "cecill": (r"cecill(?: b| c)?(?: free software)? licen[sc]e(?: agreement)?", r"licence cecill"),
    "hippocratic": (r"hippocratic license(?: [0-9] [0-9])?",),
    "polyform": (r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license(?: 1 0 0)?",),
    "commons-clause": (r"commons clause (?:license )?condition", r"the license does not grant to you the right to sell the software"),
    "etalab": (r"licence ouverte(?: open licence)?(?: version)? 2 0", r"etalab 2 0"),
    "dl-de-by": (r"datenlizenz deutschland namensnennung(?: version)? 2 0",),
    "ogl-uk": (r"open government licen[cs]e(?: v| version )?(?: ?[123] 0)?", r"contains public sector information licensed under the open government licence"),
}

#: Kinds of mention by falling priority: what stands around a name. {n} is the license's names.
KINDS = (
    ("identifier", r"spdx license identifier (?:{n})(?: or later| only)?"),
    ("grant", r"(?:licensed|released|distributed|available|published|provided|redistributed|shared) (?:\w+ ){{0,3}}?(?:under|with|by) (?:the terms of )?(?:the |a |an )?(?:{n})(?: license| licence)?(?: version [0-9]+(?: [0-9])?)?"),
    ("notice", r"(?:license|licence|lizenz|licencia) (?:is |type |name |the )?(?:the )?(?:{n})"),
    ("name", r"(?:{n}) (?:license|licence|lizenz|licencia)(?: version [0-9]+(?: [0-9])?)?"),
)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Most strings that stand for a part of a pattern at once.
STRINGS = 200


def _shortest(strings: set) -> frozenset:
    """The strings without those that contain another of them."""
    return frozenset(x for x in strings if not any(y != x and y in x for y in strings))


def _literals(tree) -> tuple[set | None, list]:
    """All strings that a parsed pattern matches (None if they are too many), and sets of which every match contains a string."""
    now, whole, out = {""}, True, []
    for op, arg in tree:
        name, strings, inner = str(op), None, []
        if name == "LITERAL":
            strings = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            strings = {chr(c) for _, c in arg}
        elif name == "SUBPATTERN":
            strings, inner = _literals(arg[3])
        elif name == "BRANCH":
            parts = [_literals(x) for x in arg[1]]
            if all(x is not None for x, _ in parts):
                strings = set().union(*(x for x, _ in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] <= 1:
            strings, inner = _literals(arg[2])
            if arg[1] != 1:
                strings = None
            if arg[0] == 0:
                strings, inner = (None if strings is None else strings | {""}), []
        out += inner
        if strings is not None and len(now) * len(strings) <= STRINGS:
            now = {x + y for x in now for y in strings}
        else:
            out.append(now)
            now, whole = strings or {""}, False
    return (now, out) if whole else (None, [*out, now])


def gates(pattern: str) -> tuple[frozenset, ...]:
    """Sets of literals: every match of the pattern contains one of each set."""
    from re import _parser

    whole, parts = _literals(_parser.parse(pattern))
    sets = {_shortest(x) for x in ([whole] if whole is not None else parts)}
    return tuple(x for x in sets if all(len(y.strip()) > 1 for y in x))


@lru_cache(maxsize=1)
def rules() -> tuple:
    """(priority, label, gates, pattern) in order of priority; grants' own phrases come first."""
    out = []
    around = [gates(form.format(n=r"\w+")) for _, form in KINDS]
    out += [(0, label, gates(p), p) for label, sentences in SENTENCES.items() for p in sentences]
    for label, (names, phrases) in LICENSES.items():
        out += [(0, label, gates(p), p) for p in phrases]
        own = gates(names)
        out += [(rank, label, (*own, *around[rank - 1]), form.format(n=names)) for rank, (_, form) in enumerate(KINDS, 1)]
    out.sort(key=lambda r: (r[0], -len(r[3])))
    return tuple((rank, label, sets, re.compile(rf"(?<![^ ]){p}(?![^ ])")) for rank, label, sets, p in out)


@lru_cache(maxsize=1)
def gate():
    """The automaton that finds the literals of all rules' gates in one pass."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for x in {x for _, _, sets, _ in rules() for one in sets for x in one}:
        found.add_word(x, x)
    found.make_automaton()
    return found


def detect(normal: str, gated: bool = True) -> list[tuple[int, int, int, str]]:
    """(priority, start, end, label) of the detections that stay, by start; `normal` has words with one space between."""
    here = {x for _, x in gate().iter(normal)} if gated else set()
    if gated and not here:
        return []
    found = []
    for rank, label, sets, pattern in rules():
        if not gated or not any(here.isdisjoint(one) for one in sets):
            found += [(rank, m.start(), m.end(), label) for m in pattern.finditer(normal)]
    found.sort(key=lambda d: (d[0], d[1] - d[2], d[1], -len(d[3]), d[3]))  # of equal intervals the more specific license
    return sorted(outermost(found), key=lambda d: (d[1], d[2], d[3]))


def outermost(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of detections, best first, those that don't lie inside the interval of a better one that stays.

    A detection lies inside one that stays if, of those that begin at its start or before, one ends at its end or behind it: a tree of
    running maxima over the starts tells that in a logarithm of their number.
    """
    starts = {x: i for i, x in enumerate(sorted({d[1] for d in found}), 1)}
    reach, kept = [-1] * (len(starts) + 1), []
    for d in found:
        i, best = starts[d[1]], -1
        while i and best < d[2]:
            best = max(best, reach[i])
            i -= i & -i
        if best >= d[2]:
            continue
        kept.append(d)
        i = starts[d[1]]
        while i < len(reach):
            reach[i] = max(reach[i], d[2])
            i += i & -i
    return kept


def _word_numbers(padded: bytes | str, at: list[int], space: bytes | str = b" ") -> list[int]:
    """Words before each of the rising places."""
    out, start, n = [], 0, 0
    for x in at:
        n += padded.count(space, start, x)
        start = x
        out.append(n)
    return out


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, detections."""
    words = (text or "").encode().translate(_WORD).split()
    normal = b" ".join(words)
    padded = b" " + normal + b" "
    places, base = [], set()
    for phrase, label in BASE:
        needle, found = f" {phrase} ".encode(), []
        at = padded.find(needle)
        while at >= 0:
            found.append(at)
            at = padded.find(needle, at + 1)
        if found:
            base.add(label)
            places += _word_numbers(padded, found)
    shown = normal.decode()
    found = detect(shown)
    labels = base | {d[3] for d in found}
    strength = {0: 0.95, 1: 0.95, 2: 0.85, 3: 0.6, 4: 0.6}
    miss = 1.0
    for d in found:
        miss *= 1 - strength[d[0]]
    for _ in base:
        miss *= 0.3
    bounds = sorted({x for d in found for x in d[1:3]})
    number = dict(zip(bounds, _word_numbers(shown, bounds, " ")))  # noqa: B905
    spans = [{"label": d[3], "priority": d[0], "first_word": number[d[1]], "last_word": number[d[2]]} for d in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, spans


_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def _scan(texts, state):
    rows = [scan_text(t) for t in texts]
    return {k: [r[i] for r in rows] for i, k in enumerate(_NAMES)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base columns, labels, score and detections array<struct<label, priority, first_word, last_word>>."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,first_word:long,last_word:long>>"
    return map_text(plain, "text", _scan, added).drop("text")
