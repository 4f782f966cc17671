"""License scans by ordered signature rules.

A rule, of the notices, grants, clauses and exceptions below or a name in a form of mention, is a regular expression over the text's words (lower-cased, single blanks between them), with a label, a
weight and a keyword that any match must hold. Most texts hold none of the gate's words and are done after one
search. In the others the keywords are looked up once, and only rules whose keyword occurs are run. Detections are
then swept from left to right: one that lies inside another of the same or a higher rank is dropped, and so is the
later in rank of two with one extent. Beside the rules, three fixed phrases are counted wherever they stand.

Only DataFrame functions are used; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All characters but those of ASCII that are neither letter nor digit.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
GAP = WORD.replace("[", "[^") + "+"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_PHRASES = "|".join(p.replace(" ", GAP) for p in BASE)
BASE_PATTERN = f"(?i)(?<!{WORD})(?:{_PHRASES})(?!{WORD})"

# (label, name as it appears among words, keywords of which any match holds one)
NAMES = [
    ("mit", "mit(?: expat)?", "mit"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("bsd", "bsd(?: style)?", "bsd"),
    ("apache-2.0", "apache(?: software)?(?: license| licence)?(?: version| v)?(?: 2 0| 2|v2)", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license| licence)?(?: version| v)? 1 1", "apache"),
    ("apache", "apache(?: software)?", "apache"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license|general public licence)(?: version| v)?(?: 3 0| 3|v3)", "gpl|general public"),
    ("gpl-2.0", "(?:gnu )?(?:gpl|general public license|general public licence)(?: version| v)?(?: 2 0| 2|v2)", "gpl|general public"),
    ("gpl", "(?:gnu )?(?:gpl|general public)", "gpl|general public"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)?(?: 3 0| 3|v3)", "lgpl|lesser general|library general"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)?(?: 2 1|v2 1)", "lgpl|lesser general|library general"),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", "lgpl|lesser general|library general"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license)(?: version| v)?(?: 3 0| 3|v3)", "agpl|affero"),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", "agpl|affero"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation)", "gfdl|free documentation"),
    ("mpl-2.0", "(?:mpl|mozilla public license|mozilla public)(?: version| v)?(?: 2 0| 2|v2)", "mpl|mozilla"),
    ("mpl-1.1", "(?:mpl|mozilla public license|mozilla public)(?: version| v)? 1 1", "mpl|mozilla"),
    ("mpl", "(?:mpl|mozilla public)", "mpl|mozilla"),
    ("epl-2.0", "(?:epl|eclipse public license)(?: version| v)? 2(?: 0)?", "epl|eclipse"),
    ("epl-1.0", "(?:epl|eclipse public license)(?: version| v)? 1(?: 0)?", "epl|eclipse"),
    ("epl", "(?:epl|eclipse public)", "epl|eclipse"),
    ("cddl", "(?:cddl|common development and distribution)", "cddl|common development"),
    ("cpl", "(?:cpl|common public)", "cpl|common public"),
    ("artistic-2.0", "artistic(?: license)?(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", "(?:perl )?artistic", "artistic"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost-1.0", "(?:bsl|boost(?: software)?)(?: license)?(?: version)? 1(?: 0)?", "bsl|boost"),
    ("boost", "boost(?: software)?", "boost"),
    ("eupl", "(?:eupl|european union public)", "eupl|european union"),
    ("ofl", "(?:ofl|sil open font|open font)", "ofl|open font"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql"),
    ("python", "(?:psf|python(?: software foundation)?)", "psf|python"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("ncsa", "(?:ncsa|university of illinois)", "ncsa|illinois"),
    ("odbl", "(?:odbl|open database)", "odbl|open database"),
    ("odc-by", "(?:odc by|open data commons attribution)", "odc by|open data"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", "cc0|cc zero|commons zero"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", "cc by|commons attribution"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by|commons attribution"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv[a-z]+)", "cc by|commons attribution"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", "cc by|commons attribution"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv[a-z]+)", "cc by|commons attribution"),
    ("cc-by", "(?:cc by|creative commons attribution)", "cc by|commons attribution"),
    ("creative-commons", "creative commons", "creative commons"),
]
# Notices, grants, clauses and exceptions, ahead of the forms in rank as they hold shorter mentions: (label, pattern, keyword, weight)
_ANY = "(?: [a-z0-9]+)"
_GNU = "free software you can redistribute it and or modify it under the terms of the gnu"
_FSF = "as published by the free software foundation"
_LATER = "or at your option any later version"
_WORK = "this work is licensed under (?:a|the) creative commons attribution"
_URL = "creativecommons org licenses"
NOTICES = [
    # header notices
    ("apache-2.0", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license", "in compliance with the license", 0.99),
    ("apache-2.0", "you may obtain a copy of the license at https? www apache org licenses license 2 0", "apache org licenses", 0.99),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache software foundation", 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license", 0.9),
    ("apache-1.1", "this product includes software developed by the apache (?:software foundation|group)", "software developed", 0.8),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "software developed", 0.9),
    ("gpl-2.0-or-later", f"{_GNU} general public license {_FSF} either version 2 of the license {_LATER}", "free software foundation", 0.99),
    ("gpl-3.0-or-later", f"{_GNU} general public license {_FSF} either version 3 of the license {_LATER}", "free software foundation", 0.99),
    ("lgpl-2.1-or-later", f"{_GNU} lesser general public license {_FSF} either version 2 1 of the license {_LATER}", "free software foundation", 0.99),
    ("lgpl-2.0-or-later", f"{_GNU} library general public license {_FSF} either version 2 of the license {_LATER}", "free software foundation", 0.99),
    ("lgpl-3.0-or-later", f"{_GNU} lesser general public license {_FSF} either version 3 of the license {_LATER}", "free software foundation", 0.99),
    ("agpl-3.0-or-later", f"{_GNU} affero general public license {_FSF} either version 3 of the license {_LATER}", "free software foundation", 0.99),
    ("gpl-2.0-only", f"under the terms of the gnu general public license version 2(?: only)? {_FSF}", "free software foundation", 0.95),
    ("gpl-3.0-only", f"under the terms of the gnu general public license version 3(?: only)? {_FSF}", "free software foundation", 0.95),
    ("gpl", "you should have received a copy of the gnu general public license along with", "you should have received a copy", 0.9),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", "you should have received a copy", 0.9),
    ("agpl", "you should have received a copy of the gnu affero general public license along with", "you should have received a copy", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 [123]", "free documentation", 0.99),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 0.99),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not", 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file", 0.99),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file", 0.99),
    ("gpl-2.0-or-later", "alternatively the contents of this file may be used under the terms of(?: either)? the gnu general public license version 2 or later", "contents of this file", 0.9),
    ("epl-2.0", f"this program and the accompanying materials are made{_ANY}{{0,3}} under the terms of the eclipse public license v ?(?:ersion )?2 0", "accompanying materials", 0.99),
    ("epl-1.0", f"this program and the accompanying materials are made{_ANY}{{0,3}} under the terms of the eclipse public license v ?(?:ersion )?1 0", "accompanying materials", 0.99),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license", 0.95),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "font software", 0.99),
    ("eupl", "licensed under the eupl version 1 [12](?: only| or later)?", "eupl", 0.95),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "source code is governed", 0.95),
    ("mit", "use of this source code is governed by an mit style license that can be found in the license file", "source code is governed", 0.95),
    ("perl", "free software you can redistribute it and or modify it under the same terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?", "same terms as", 0.9),
    ("dual-license", f"licensed under either of(?: the)? apache license version 2 0{_ANY}{{0,12}} mit license", "licensed under either of", 0.9),
    ("dual-license", "dual licensed under", "dual licensed", 0.6),
    # grants
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction", "obtaining a copy", 0.99),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction", "obtaining a copy", 0.95),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "obtaining a copy", 0.99),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "permission to use copy modify", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", "permission to use copy modify", 0.99),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use copy modify", 0.99),
    ("hpnd", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee", "permission to use copy modify", 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone", 0.95),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "hereby grants to you", 0.95),
    ("patent-grant", f"hereby grants to you a{_ANY}{{1,10}} patent license", "patent license", 0.7),
    ("python", "psf hereby grants licensee a non ?exclusive royalty free world ?wide license", "grants licensee", 0.95),
    ("cc0", f"to the extent possible under law{_ANY}{{1,10}} waived all copyright and related or neighbou?ring rights", "waived all copyright", 0.99),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", 0.95),
    ("unlicense", "dedicate any and all copyright interest in the software to the public domain", "copyright interest", 0.95),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "everyone is permitted", 0.95),
    ("gnu", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "everyone is permitted", 0.9),
    ("wtfpl", "do what the fuck you want to public license", "you want to public", 0.95),
    ("perl", f"you (?:may|can) distribute this{_ANY}{{0,4}} under the same terms as perl itself", "same terms as", 0.8),
    ("public-domain", f"works? of the (?:united states|u s|us) government{_ANY}{{0,10}} public domain", "public domain", 0.8),
    # clauses
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", "permission notice", 0.9),
    ("x11", f"except as contained in this notice the names? of{_ANY}{{1,8}} shall not be used in advertising or otherwise{_ANY}{{1,14}} without prior written (?:authorization|authorisation) from{_ANY}{{0,8}} copyright holder", "used in advertising", 0.9),
    ("bsd", "redistributions of source code must retain(?: the)?(?: above)? copyright notice", "redistributions of source", 0.8),
    ("bsd", "redistributions in binary form must reproduce(?: the)?(?: above)? copyright notice", "redistributions in binary", 0.8),
    ("bsd-3-clause", f"neither the names? of{_ANY}{{1,16}} may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed", "advertising materials", 0.95),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission notice", 0.8),
    ("ofl", "with reserved font names?", "reserved font", 0.9),
    ("copyleft", "you must(?: also)? (?:license|release|distribute) (?:it|the derivative work|your contributions|the modified work) under the same licen[sc]e", "under the same licen", 0.6),
    ("commons-clause", f"commons clause{_ANY}{{0,3}} licen[sc]e", "commons clause", 0.8),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition", "by the licensor", 0.9),
    ("or-later", "licen[sc]e(?: version| v)? [1-9](?: [0-9])? or(?: at your option)?(?: any)? later(?: version)?", "later", 0.5),
    ("license-reference", "see the license for the specific language governing permissions and limitations under the license", "specific language governing", 0.5),
    ("license-reference", "(?:see|read) (?:the )?(?:accompanying |included )?licen[sc]e(?: file| md| txt)? for(?: more| full)?(?: licensing)? (?:details|information|terms)", "licen", 0.3),
    ("contributor-agreement", "contributor licen[sc]e agreement", "contributor licen", 0.4),
    # exceptions
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library thus the terms", "combined work based on", 0.95),
    ("classpath-exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", "special exception", 0.95),
    ("gcc-exception", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception", "gcc runtime library", 0.95),
    ("openssl-exception", f"permission to link{_ANY}{{1,10}} with the openssl(?: project s)?(?: openssl)? library", "permission to link", 0.9),
    ("autoconf-exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", "special exception", 0.95),
    ("font-exception", "as a special exception if you create a document which uses this font and embed this font or unaltered portions of this font into the document this font does not by itself cause the resulting document to be covered by the gnu general public license", "special exception", 0.95),
    ("llvm-exception", "apache license v2 0 with llvm exceptions", "llvm exceptions", 0.95),
    ("syscall-note", "this copyright does not cover user programs that use kernel services by normal system calls", "this copyright does not", 0.95),
    # open content and data
    ("cc-by-nc-nd-4.0", f"{_WORK} non ?commercial no ?deriv(?:ative)?s 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-nc-sa-4.0", f"{_WORK} non ?commercial share ?alike 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-nc-4.0", f"{_WORK} non ?commercial 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-sa-4.0", f"{_WORK} share ?alike 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-nd-4.0", f"{_WORK} no ?deriv(?:ative)?s 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-4.0", f"{_WORK} 4 0 international (?:public )?license", "this work is licensed", 0.99),
    ("cc-by-nc-sa", f"{_URL} by nc sa(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc-by-nc-nd", f"{_URL} by nc nd(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc-by-nc", f"{_URL} by nc(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc-by-sa", f"{_URL} by sa(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc-by-nd", f"{_URL} by nd(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc-by", f"{_URL} by(?: [1-4] [05])?", "creativecommons org", 0.95),
    ("cc0", "creativecommons org publicdomain zero(?: 1 0)?", "creativecommons org", 0.95),
    ("cc-by-nc", "this is an open access article distributed under the terms of the creative commons attribution non ?commercial license", "open access article", 0.95),
    ("cc-by", "this is an open access article distributed under the terms of the creative commons attribution license", "open access article", 0.95),
    ("odbl", "made available under the open database license", "open database license", 0.95),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license", "database contents license", 0.95),
    ("pddl", "(?:open data commons )?public domain dedication and licen[sc]e", "public domain dedication", 0.9),
    ("ogl", "(?:licensed under the )?open government licen[sc]e(?: version| v)?(?: [123](?: 0)?|v[123] 0)?", "open government licen", 0.9),
    ("crown-copyright", "crown copyright(?: [0-9]{4})?", "crown copyright", 0.7),
    ("no-known-copyright", "no known copyright restrictions", "no known copyright", 0.6),
    # source available, models, sold software
    ("busl-1.1", "business source licen[sc]e(?: version)?(?: 1 1)?", "business source", 0.9),
    ("sspl", "server side public licen[sc]e(?: version| v)?(?: 1)?", "server side public", 0.9),
    ("elastic", "elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", "elastic licen", 0.9),
    ("polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) licen[sc]e", "polyform", 0.9),
    ("rail", "(?:responsible ai|open ?rail(?: m)?) licen[sc]es?", "licen", 0.8),
    ("llama-community", "llama(?: [0-9])* community licen[sc]e(?: agreement)?", "community licen", 0.9),
    ("eula", "end user licen[sc]e agreement", "end user licen", 0.7),
    ("eula", f"by (?:installing|downloading|copying|using|accessing){_ANY}{{1,8}} you (?:agree|accept|consent){_ANY}{{0,8}} terms", "terms", 0.5),
    ("noncommercial", "(?:licensed|permitted) (?:only |solely )?for (?:personal |private )?(?:and )?non ?commercial (?:use|purposes?)", "commercial", 0.6),
    ("exclusive-license", "under exclusive licen[sc]e (?:to|from)", "exclusive licen", 0.6),
    ("with-permission", "(?:reprinted|reproduced|used) (?:with|by) (?:the )?(?:kind )?permission", "permission", 0.4),
    ("proprietary", f"may not be (?:copied|reproduced|distributed|redistributed|republished){_ANY}{{0,10}} without{_ANY}{{0,6}} permission", "may not be", 0.6),
    ("proprietary", "(?:confidential and )?proprietary (?:information|property|software) of", "proprietary", 0.6),
    ("open-source", "(?:under|with) an? (?:open source|free software|permissive|copyleft) licen[sc]e", "licen", 0.5),
    # disclaimers
    ("warranty-disclaimer", "distributed in the hope that it will be useful but without any warranty", "in the hope that it", 0.5),
    ("warranty-disclaimer", "without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty", 0.5),
    ("warranty-disclaimer", f"(?:software|work|material) is provided(?: by{_ANY}{{1,8}})? as is(?: and)?{_ANY}{{0,3}} express(?:ed)? or implied warrant[a-z]+", "implied warrant", 0.5),
]
# (form of a mention, its keyword, weight); forms are ranked in this order, names within a form as above.
FORMS = [
    ("spdx license identifier {}(?: only| or later)?", "spdx", 0.99),
    ("(?:is |are )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{}(?: international| unported)?(?: licen[sc]e)?", "licen", 0.9),
    ("(?:released|distributed|published|available|provided) under the terms of (?:the )?{}(?: licen[sc]e)?", "terms of", 0.85),
    ("{} licen[sc]e(?: version| v)?(?: [0-9]+)*", "licen", 0.8),
    ("licen[sc]e {}(?: [0-9]+)*", "licen", 0.6),
]
# Rules of their own, behind the forms in rank: (label, pattern, keyword, weight)
OWN = [
    ("unlicense", "the unlicense", "unlicense", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.9),
    ("public-domain", "(?:released|placed|dedicated)(?: [a-z]+){0,3} (?:into|in|to) the public domain", "domain", 0.8),
    ("public-domain", "public domain(?: dedication)?", "domain", 0.5),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission", 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "permitted", 0.9),
    ("gpl", "free software you can redistribute it and or modify it under the terms", "redistribute it", 0.8),
    ("warranty-disclaimer", "(?:without warranty of any kind|without any warranty|as is without warrant[a-z]+)", "warrant", 0.4),
    ("proprietary", "proprietary and confidential", "proprietary", 0.6),
    ("proprietary", "(?:unauthorized|unauthorised) (?:copying|use|reproduction)(?: [a-z]+){0,6} prohibited", "prohibited", 0.6),
    ("copyleft", "copyleft", "copyleft", 0.4),
    ("copyright", "copyright(?: c)?(?: (?:19|20)[0-9]{2})+", "copyright", 0.5),
    ("copyright", "copyright", "copyright", 0.2),
    ("reserved", "(?:all|some|no) rights reserved", "reserved", 0.5),
]
# Every match of a rule holds one of these.
GATE = [
    "licen", "spdx", "terms", "domain", "permi", "warrant", "proprietary", "prohibited", "copy", "reserved", "copied", "software developed",
]
BASE_WEIGHT = 0.5
# Items folded into one array before the arrays are put together.
RUN = 128
RULE = "array<struct<rank:int,label:string,pattern:string,word:string,keys:array<string>,weight:double>>"
SPANS = "array<struct<start:int,end:int,rank:int,label:string,weight:double>>"


def rules() -> list[tuple[str, str, str, list[str], float]]:
    """(label, pattern, keyword, further keywords of which one is needed, weight) of every rule, by rank."""
    made = [
        (label, form.format(name), word, key.split("|"), weight)
        for form, word, weight in FORMS
        for label, name, key in NAMES
    ]
    alone = lambda own: [(label, pattern, word, [word], weight) for label, pattern, word, weight in own]
    return alone(NOTICES) + made + alone(OWN)


def _rules_column() -> Column:
    """All rules as one constant: a text that is parsed once, when the plan is made."""
    rows = [
        {"rank": rank, "label": label, "pattern": f"(?<= )(?:{pattern})(?= )", "word": word, "keys": keys, "weight": weight}
        for rank, (label, pattern, word, keys, weight) in enumerate(rules())
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def _folded(items: Column, state: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` gives for each item in turn: (next state, an array of results), the results end to end.

    An array that grows by an item is copied for it, so results are gathered in runs of ``RUN`` items, and runs in one
    array: the work grows with the number of items, and with its square only divided by that of a run.
    """

    def one(acc: Column, x: Column) -> Column:
        after, found = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], found).alias("out"))

    def run(acc: Column, items_of_run: Column) -> Column:
        walked = F.aggregate(items_of_run, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        # Bound to a name, so that a run is walked once although it is used twice.
        return F.transform(
            F.array(walked),
            lambda w: F.struct(w["state"].alias("state"), F.concat(acc["out"], F.array(w["out"])).alias("out")),
        )[0]

    starts = F.sequence(F.lit(1), F.size(items), F.lit(RUN))
    runs = F.transform(starts, lambda i: F.slice(items, i, F.lit(RUN)))
    none = F.filter(F.array(empty), lambda _: F.lit(False))
    whole = F.aggregate(runs, F.struct(state.alias("state"), none.alias("out")), run, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) > 0, whole).otherwise(empty)


def _spans(words: Column, rule: Column) -> Column:
    """(start, end, rank, label, weight) of each match of a rule."""
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    ahead = F.transform(F.split(words, rule["pattern"], -1), F.char_length)
    pairs = F.filter(F.arrays_zip(ahead.alias("gap"), F.transform(hits, F.char_length).alias("size")), lambda p: p["size"].isNotNull())

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + p["gap"]
        end = start + p["size"]
        one = F.struct(start.alias("start"), end.alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return end, F.array(one)

    return F.transform(F.array(pairs), lambda own: _folded(own, F.lit(0), F.array().cast(SPANS), step))[0]


def _suppressed(hits: Column) -> Column:
    """Detections that stay, by start: none inside a single other one of the same or a smaller rank.

    What holds a detection comes before it in this order. Of the kept ones, the state has those that reach beyond the
    present start, as no other can hold this detection or a later one.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["end"]).alias("back"), h["rank"].alias("rank"), h["label"].alias("label"),
        h["weight"].alias("weight"), h["end"].alias("end"))))
    empty = F.array().cast(SPANS)

    def step(open_: Column, h: Column) -> tuple[Column, Column]:
        inside = F.exists(open_, lambda k: (k["end"] >= h["end"]) & (k["rank"] <= h["rank"]))
        one = F.struct(h["start"].alias("start"), h["end"].alias("end"), h["rank"].alias("rank"), h["label"].alias("label"), h["weight"].alias("weight"))
        reach = F.struct(h["end"].alias("end"), h["rank"].alias("rank"))
        still = F.filter(open_, lambda k: k["end"] > h["start"])
        return F.when(inside, open_).otherwise(F.concat(still, F.array(reach))), F.when(inside, empty).otherwise(F.array(one))

    start = F.array().cast("array<struct<end:int,rank:int>>")
    return F.transform(F.array(ordered), lambda own: _folded(own, start, empty, step))[0]


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("bigint")


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds what a text says about its license.

    ``n_words``; ``n_base``, the places of base phrases; ``first_word`` and ``last_word``, the first and last word at
    which one starts (null without any); ``base_labels``; ``detections``, the rules' matches that stay, with places in
    the text's words joined by blanks (one blank ahead); ``labels``, base labels and the detections' ones; ``score``,
    one minus the product of what the distinct labels leave open. A text without words has no place and score 0. The time
    a text takes grows in proportion to its length and its mentions. The input's other columns come back whatever they are
    called.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    pattern = F.lit(BASE_PATTERN)
    low = F.col("_low")
    lowered = docs.select(own.alias("own"), body.alias("_body"), F.lower(body).alias("_low"))
    near = (low.contains("cc") & low.contains("by")) | low.contains("general") | low.contains("reserved")
    gate = low.contains(GATE[0])
    for word in GATE[1:]:
        gate = gate | low.contains(word)
    counted = lowered.select(
        "own",
        "_body",
        _word_count(F.col("_body")).alias("n_words"),
        F.when(near, F.regexp_count("_body", pattern)).otherwise(0).cast("bigint").alias("n_base"),
        F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))).alias("_words"),
    )
    held = F.col("n_base") > 0
    found = F.transform(F.regexp_extract_all("_body", pattern, F.lit(0)), lambda m: F.lower(F.regexp_replace(m, GAP, " ")))
    keywords = F.split(F.lit("|".join(sorted({k for r in rules() for k in (r[2], *r[3])}))), "[|]")
    parts = counted.withColumns(
        {
            "_found": F.when(held, found),
            "_parts": F.when(held, F.split("_body", pattern, -1)),
            "_keys": F.filter(keywords, lambda k: F.contains(F.col("_words"), k)),
        }
    )
    run = F.filter(_rules_column(), lambda r: F.array_contains("_keys", r["word"]) & F.arrays_overlap("_keys", r["keys"]))
    parts = parts.withColumn("_rules", F.when(F.size("_keys") > 0, run))
    hits = F.flatten(F.transform("_rules", lambda r: _spans(F.col("_words"), r)))
    none = F.array().cast(SPANS)
    # The row number keeps a filter on the result from being pushed below, where all of this would run again.
    kept = F.coalesce(F.when(F.size("_rules") > 0, _suppressed(hits)), none)
    parts = parts.withColumns({"detections": kept, "_row": F.monotonically_increasing_id()})
    base = F.array_sort(F.array_distinct(F.transform("_found", lambda m: _label_of(m))))
    parts = parts.withColumn("_base", F.coalesce(base, F.array().cast("array<string>")))
    both = F.array_sort(F.array_union("_base", F.transform("detections", lambda d: d["label"])))
    open_ = F.aggregate(
        F.transform(F.array_distinct(F.transform("detections", lambda d: F.struct(d["label"], d["weight"]))), lambda d: d["weight"]),
        F.when(F.size("_base") > 0, F.lit(1 - BASE_WEIGHT)).otherwise(F.lit(1.0)),
        lambda acc, w: acc * (F.lit(1.0) - w),
    )
    last = F.element_at("_found", -1)
    done = parts.select(
        "own",
        "n_words",
        "n_base",
        F.when(held, _word_count(F.element_at("_parts", 1))).alias("first_word"),
        F.when(held, F.col("n_words") - _word_count(F.element_at("_parts", -1)) - _word_count(last)).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        "detections",
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("_row") >= 0, F.round(F.lit(1.0) - open_, 6)).alias("score"),
    )
    return done.select("own.*", *added)


def _label_of(phrase: Column) -> Column:
    return F.coalesce(*[F.when(phrase == p, F.lit(v)) for p, v in BASE.items()])
