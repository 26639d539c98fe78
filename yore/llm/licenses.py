"""License detection by ordered signature rules.

A text is normalised to its words (lower-cased ASCII letters, digits, anything beyond ASCII) with one space around
each. A rule is a regular expression over that form with the words that must be present for it to be tried (all of some,
and one of others), a priority and a label. The keyword prefilter is one intersection of the text's words with all
keywords; only rules whose keywords are there run. Detections are word ranges; one that lies within another's range is suppressed unless its
priority is higher (a smaller number), and at equal priority the longer and then the earlier rule wins. Base phrases
are reported besides and never suppressed.

All is computed within the row by SQL functions, so no text moves. Null and empty texts have no words, no detections
and score 0; repeated rows and ties get the same result each; an empty table gives an empty table. Very long texts are
read whole; positions are running sums, so that very many places in one text take little longer than their number.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.llm.common import ascii_lower, let, running, table

#: Phrase -> label: the base, fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

EXACT, NAMED, FAMILY, HINT = 1, 2, 3, 4

#: Licenses by identifier: (label, its name as alternatives of words, keywords of which every alternative has one).
NAMES = [
    ("mit", "mit", "mit"), ("mit-0", "mit 0|mit no attribution", "mit"), ("x11", "x11", "x11"), ("isc", "isc", "isc"),
    ("apache-1.0", "apache (?:software )?license (?:v(?:ersion )?)?1 0|apache 1 0", "apache"), ("apache-1.1", "apache (?:software )?license (?:v(?:ersion )?)?1 1|apache 1 1", "apache"),
    ("apache-2.0", "apache (?:software )?license (?:v(?:ersion )?)?2(?: 0)?|apache (?:v(?:ersion )?)?2(?: 0)?|al2 0", "apache al2"),
    ("bsd-0-clause", "0 ?bsd|bsd zero clause|bsd 0 clause", "bsd 0bsd"), ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", "bsd freebsd"),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", "bsd"), ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", "bsd"),
    ("gpl-1.0", "(?:gnu )?gpl (?:v(?:ersion )?)?1(?: 0)?|gnu general public license (?:v(?:ersion )?)?1(?: 0)?|gplv1", "gpl gplv1 general"), ("gpl-2.0", "(?:gnu )?gpl (?:v(?:ersion )?)?2(?: 0)?|gplv2", "gpl gplv2"), ("gpl-3.0", "(?:gnu )?gpl (?:v(?:ersion )?)?3(?: 0)?|gplv3", "gpl gplv3"),
    ("lgpl-2.0", "(?:gnu )?lgpl (?:v(?:ersion )?)?2(?: 0)?|lgplv2", "lgpl lgplv2"), ("lgpl-2.1", "(?:gnu )?lgpl (?:v(?:ersion )?)?2 1|lgplv2 1", "lgpl lgplv2"), ("lgpl-3.0", "(?:gnu )?lgpl (?:v(?:ersion )?)?3(?: 0)?|lgplv3", "lgpl lgplv3"),
    ("agpl-3.0", "(?:gnu )?agpl (?:v(?:ersion )?)?3(?: 0)?|agplv3", "agpl agplv3"), ("gfdl", "gnu free documentation license|gfdl", "gfdl documentation"),
    ("mpl-1.0", "mozilla public license (?:v(?:ersion )?)?1 0|mpl (?:v(?:ersion )?)?1 0", "mpl mozilla"), ("mpl-1.1", "mozilla public license (?:v(?:ersion )?)?1 1|mpl (?:v(?:ersion )?)?1 1", "mpl mozilla"), ("mpl-2.0", "mozilla public license (?:v(?:ersion )?)?2(?: 0)?|mpl (?:v(?:ersion )?)?2(?: 0)?", "mpl mozilla"),
    ("epl-1.0", "eclipse public license (?:v(?:ersion )?)?1(?: 0)?|epl (?:v(?:ersion )?)?1(?: 0)?", "epl eclipse"), ("epl-2.0", "eclipse public license (?:v(?:ersion )?)?2(?: 0)?|epl (?:v(?:ersion )?)?2(?: 0)?", "epl eclipse"),
    ("cddl-1.0", "cddl (?:v(?:ersion )?)?1(?: 0)?", "cddl"), ("cddl-1.1", "cddl (?:v(?:ersion )?)?1 1", "cddl"), ("cpl-1.0", "common public license|cpl 1 0", "cpl common"),
    ("eupl-1.1", "eupl (?:v(?:ersion )?)?1 1", "eupl"), ("eupl-1.2", "eupl (?:v(?:ersion )?)?1 2", "eupl"), ("artistic-1.0", "artistic license (?:v(?:ersion )?)?1(?: 0)?", "artistic"), ("artistic-2.0", "artistic license (?:v(?:ersion )?)?2(?: 0)?", "artistic"),
    ("bsl-1.0", "boost software license(?: version)?(?: 1 0)?", "boost"), ("busl-1.1", "business source license(?: 1 1)?|busl 1 1", "busl business"), ("sspl-1.0", "server side public license|sspl", "sspl server"),
    ("unlicense", "the unlicense|unlicense", "unlicense"), ("wtfpl", "wtfpl|do what the fuck you want to public license", "wtfpl fuck"), ("zlib", "zlib(?: libpng)? license|zlib", "zlib"), ("libpng", "libpng license", "libpng"),
    ("openssl", "openssl license", "openssl"), ("ofl-1.1", "sil open font license(?: version)?(?: 1 1)?|ofl 1 1", "ofl font"), ("odbl-1.0", "open database license|odbl(?: 1 0)?", "odbl database"), ("odc-by-1.0", "odc by|open data commons attribution", "odc commons"), ("pddl-1.0", "pddl|public domain dedication and license", "pddl dedication"),
    ("python-2.0", "python software foundation license|psf 2 0|python 2 0", "python psf"), ("php-3.01", "php license(?: version)? 3 01|php 3 01", "php"), ("ruby", "ruby license", "ruby"), ("postgresql", "postgresql license|postgresql", "postgresql"), ("ncsa", "ncsa open source license|ncsa", "ncsa"),
    ("ms-pl", "microsoft public license|ms pl", "ms microsoft"), ("ms-rl", "microsoft reciprocal license|ms rl", "ms microsoft"), ("vim", "vim license", "vim"), ("tcl", "tcl tk license|tcl", "tcl"), ("curl", "curl license", "curl"), ("ijg", "independent jpeg group|ijg", "ijg jpeg"), ("unicode", "unicode license", "unicode"),
    ("w3c", "w3c software notice and license|w3c", "w3c"), ("zpl-2.1", "zope public license(?: 2 1)?|zpl 2 1", "zpl zope"), ("elastic-2.0", "elastic license(?: 2 0)?", "elastic"), ("bsd-protection", "bsd protection license", "bsd"), ("afl-3.0", "academic free license(?: version)?(?: 3 0)?|afl 3 0", "afl academic"), ("osl-3.0", "open software license(?: 3 0)?|osl 3 0", "osl software"),
    ("cecill-2.1", "cecill(?: 2 1)?", "cecill"), ("mulan-2.0", "mulan psl(?: v2)?", "mulan"), ("rail", "openrail(?: m)?|open rail|responsible ai license", "openrail rail responsible"), ("cdla-permissive-2.0", "cdla permissive(?: 2 0)?", "cdla"), ("cdla-sharing-1.0", "cdla sharing(?: 1 0)?", "cdla"),
]

#: Signatures written out: (label, priority, keywords that must all be present, regular expression).
WRITTEN = [
    ("mit", EXACT, "permission granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", NAMED, "software provided warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", EXACT, "permission copy distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", EXACT, "redistribution binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd-3-clause", EXACT, "neither endorse promote", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", EXACT, "advertising materials acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", EXACT, "licensed apache compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-1.0", NAMED, "general public", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?1"),
    ("gpl-2.0", NAMED, "general public", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2"),
    ("gpl-3.0", NAMED, "general public", "gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3"),
    ("gpl-2.0+", EXACT, "general public later", "general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0+", EXACT, "general public later", "general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", FAMILY, "general public", "gnu general public license"),
    ("lgpl-2.1", NAMED, "lesser public", "gnu lesser general public license (?:version|v) ?2 1"),
    ("lgpl-3.0", NAMED, "lesser public", "gnu lesser general public license (?:version|v) ?3"),
    ("lgpl", FAMILY, "lesser public", "(?:gnu )?lesser general public license"),
    ("lgpl-2.0", NAMED, "library public", "gnu library general public license (?:version|v) ?2"),
    ("agpl-3.0", NAMED, "affero public", "gnu affero general public license (?:version|v) ?3"),
    ("agpl", FAMILY, "affero public", "(?:gnu )?affero general public license"),
    ("mpl-2.0", EXACT, "source subject mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", FAMILY, "mozilla public", "mozilla public license"),
    ("epl", FAMILY, "eclipse public", "eclipse public license"),
    ("apache", FAMILY, "apache license", "apache (?:software )?license"),
    ("artistic", FAMILY, "artistic license", "artistic license"),
    ("boost", FAMILY, "boost license", "boost software license"),
    ("unlicense", EXACT, "free unencumbered public", "this is free and unencumbered software released into the public domain"),
    ("zlib", EXACT, "software origin misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("wtfpl", EXACT, "you just want", "you just do what the fuck you want to"),
    ("ofl-1.1", EXACT, "font sil open", "this font software is licensed under the sil open font license"),
    ("cc0-1.0", NAMED, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", EXACT, "creative commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("public-domain", FAMILY, "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", NAMED, "dedicated public domain", "dedicated to the public domain"),
    ("proprietary", NAMED, "proprietary confidential", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", NAMED, "unauthorized prohibited", "unauthorized (?:copying|use|reproduction|distribution) (?:\\S+ ){0,12}is (?:strictly )?prohibited"),
    ("reserved", NAMED, "rights reserved", "(?:all|some|no) rights reserved"),
    ("reserved", NAMED, "droits réservés", "tous droits réservés"),
    ("reserved", NAMED, "rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", NAMED, "derechos reservados", "todos los derechos reservados"),
    ("copyright", FAMILY, "copyright", "copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("mit", NAMED, "substantial portions software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", NAMED, "merchantability noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", NAMED, "authors holders liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", NAMED, "author disclaims warranties", "the (?:software is provided as is and the )?author disclaims all warranties with regard to this software"),
    ("isc", NAMED, "negligence tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", NAMED, "redistributions source retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", NAMED, "redistributions binary reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", NAMED, "contributors express warranties", "this software is provided by the (?:\\S+ ){1,8}and contributors as is and any express or implied warranties"),
    ("bsd", NAMED, "procurement substitute", "procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-3-clause", NAMED, "endorse promote derived", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", EXACT, "express implied patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", NAMED, "unless applicable agreed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", NAMED, "apache licenses", "(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", NAMED, "perpetual worldwide irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", EXACT, "includes developed apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", EXACT, "free redistribute modify", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", NAMED, "hope useful warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", NAMED, "received general public", "you should have received a copy of the gnu general public license along with this"),
    ("gpl-2.0", NAMED, "franklin boston", "51 franklin st(?:reet)? fifth floor boston ma 02110 1301"),
    ("gpl-2.0", NAMED, "temple place boston", "59 temple place suite 330 boston ma 02111 1307"),
    ("gpl-3.0", NAMED, "copyleft kinds works", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", NAMED, "guarantee freedom share", "the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("lgpl", EXACT, "redistribute lesser", "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1+", EXACT, "lesser later", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0+", EXACT, "lesser later", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0", EXACT, "library redistribute general", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("agpl-3.0+", EXACT, "affero later", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", NAMED, "affero network server", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", EXACT, "copy distribute document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", NAMED, "mpl obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", EXACT, "contents subject mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", EXACT, "contents subject mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-2.0", EXACT, "accompanying eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", EXACT, "accompanying eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cpl-1.0", EXACT, "accompanying common", "this program and the accompanying materials are made available under the terms of the common public license v1 0"),
    ("cddl-1.0", EXACT, "contents common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", NAMED, "common development distribution", "common development and distribution license"),
    ("eupl-1.1", EXACT, "eupl european", "licensed under the eupl version 1 1 or as soon they will be approved by the european commission"),
    ("eupl-1.2", EXACT, "eupl licensed", "licensed under the eupl version 1 2"),
    ("artistic-1.0", NAMED, "intent artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", NAMED, "everyone verbatim permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("perl", NAMED, "perl itself", "you (?:can|may) redistribute it and or modify it under the same terms as perl itself"),
    ("bsl-1.0", EXACT, "boost distributed", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", NAMED, "machine executable object", "such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("busl-1.1", EXACT, "licensor grants licensed", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", EXACT, "functionality third service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", EXACT, "hosted managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", EXACT, "commons clause", "commons clause license condition"),
    ("commons-clause", NAMED, "grant sell", "the license does not grant to you the right to sell the software"),
    ("unlicense", NAMED, "dedication heirs", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", NAMED, "everyone permitted verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("zlib", NAMED, "express implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", NAMED, "altered plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("openssl", EXACT, "openssl toolkit project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", EXACT, "cryptographic eric young", "this product includes cryptographic software written by eric young"),
    ("ofl-1.1", NAMED, "font reserved name", "no modified version of the font software may use the reserved font name"),
    ("odbl-1.0", EXACT, "database made available", "made available under the open database license"),
    ("cc0-1.0", NAMED, "waived related neighboring", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", NAMED, "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", NAMED, "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc", FAMILY, "creative commons", "creative commons (?:public )?licen[sc]e"),
    ("python-2.0", EXACT, "psf licensee", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php-3.01", EXACT, "subject php version", "this source file is subject to version 3 01 of the php license"),
    ("ruby", EXACT, "redistribute bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("postgresql", EXACT, "written fee granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", EXACT, "deal with software", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("ms-pl", EXACT, "contributor grants worldwide", "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("vim", EXACT, "vim charityware", "vim is charityware"),
    ("curl", EXACT, "daniel stenberg", "copyright (?:c )?(?:\\S+ ){1,4}daniel stenberg"),
    ("ijg", EXACT, "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("unicode", EXACT, "unicode data files", "a copy of the unicode data files and any associated documentation"),
    ("w3c", EXACT, "royalty granted modification", "permission to copy modify and distribute this (?:work|software) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("x11", EXACT, "consortium advertising", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale"),
    ("hpnd", EXACT, "advertising publicity pertaining", "(?:not )?be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("beerware", EXACT, "beer return", "you can buy me a beer in return"),
    ("cecill-2.1", EXACT, "cecill governed", "this software is governed by the cecill license under french law"),
    ("mulan-2.0", EXACT, "mulan psl", "is licensed under mulan psl v2"),
    ("llama", NAMED, "llama community license", "llama (?:2|3|3 1|3 2|3 3) community license(?: agreement)?"),
    ("rail", NAMED, "restrictions paragraph", "use based restrictions as referenced in paragraph 5"),
    ("json", EXACT, "good evil", "the software shall be used for good not evil"),
    ("proprietary", EXACT, "property", "this (?:software|document|file) (?:is|contains) (?:the )?(?:proprietary|confidential) (?:\\S+ ){0,8}property of"),
    ("proprietary", NAMED, "internal use only", "for internal use only"),
    ("proprietary", NAMED, "part without", "no part of this (?:publication|document|work|book) may be (?:\\S+ ){0,12}without (?:the )?(?:express |prior )?(?:\\S+ ){0,4}(?:permission|consent)"),
    ("non-commercial", NAMED, "non commercial only", "(?:for )?non commercial (?:use|purposes) only"),
    ("non-commercial", NAMED, "noncommercial only", "(?:for )?noncommercial (?:use|purposes) only"),
    ("research-only", NAMED, "research only", "for research (?:use|purposes) only"),
    ("reserved", NAMED, "diritti riservati", "tutti i diritti riservati"),
    ("reserved", NAMED, "direitos reservados", "todos os direitos reservados"),
    ("reserved", NAMED, "rechten voorbehouden", "alle rechten voorbehouden"),
    ("license", HINT, "licensed under", "licensed under (?:the )?(?:terms of )?\\S+"),
    ("license", HINT, "released under", "released under (?:the )?(?:terms of )?\\S+"),
    ("license", HINT, "distributed under", "distributed under (?:the )?(?:terms of )?\\S+"),
    ("license", HINT, "spdx license identifier", "spdx license identifier \\S+"),
]


def rules() -> list[tuple[str, int, list[str], list[str], str]]:
    """All rules in order: (label, priority, keywords that must all be there, keywords of which one must, regular expression over the words).

    Besides the written ones, each named license gives five: its name in a declaration (SPDX, "licensed under"), its
    name with the word license where the name has none; and the Creative Commons all elements in all versions.
    """
    out = [(label, priority, words.split(), [], pattern) for label, priority, words, pattern in WRITTEN]
    for label, name, words in NAMES:
        for lead in ("spdx license identifier", "licensed under", "released under", "distributed under"):
            out.append((label, EXACT, lead.split(), words.split(), f"{lead} (?:the )?(?:terms of the )?(?:{name})(?: license)?"))
        # a name says license, or the word follows it: mit, zlib and their like are plain words too
        whole = "|".join(x if re.search(r"\blicense\b", x) else f"(?:{x}) license" for x in name.split("|"))
        out.append((label, NAMED, ["license"], words.split(), f"(?:the )?(?:{whole})"))
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label, name = "cc-" + parts.replace(" ", "-"), {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
        spelled = " ".join(name[x] for x in parts.split())
        out.append((label, FAMILY, ["cc", *parts.split()], [], f"cc {parts}"))
        out.append((label, FAMILY, ["creative", "commons", *spelled.split()], [], f"creative commons {spelled}"))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            versioned = f"{label}-{version.replace(' ', '.')}"
            out.append((versioned, NAMED, ["cc", *parts.split(), version.split()[0]], [], f"cc {parts} {version}"))
            out.append((versioned, NAMED, ["creative", "commons", version.split()[0]], [], f"creative commons {spelled} {version}"))
            out.append((versioned, NAMED, ["licenses", version.split()[0]], [], f"creativecommons org licenses {parts} {version}"))
    return out


def normal(text: Column) -> Column:
    """The words with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def places(said: Column, pattern: Column) -> Column:
    """array<struct<start,end>> of the word ranges where the pattern matches whole words, left to right without overlap."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    n_words = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")

    def walk(found: Column) -> Column:
        def told(pieces: Column) -> Column:
            sizes = F.transform(found, lambda x, i: n_words(F.get(pieces, i)) + n_words(x))
            place = lambda before: F.transform(
                found, lambda x, i: F.struct((F.get(before, i) + n_words(F.get(pieces, i)) - 1).alias("start"), F.get(before, i + 1).alias("end"))
            )
            return let(running(sizes, lambda a, b: a + b, F.lit(0).cast("long")), place)

        return let(F.split(said, whole), told)

    return let(F.regexp_extract_all(said, whole, F.lit(0)), lambda found: F.when(F.size(found) > 0, walk(found)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))


FOUND = "array<struct<start:bigint,end:bigint,priority:int,rule:int,label:string>>"


def _suppress(found: Column) -> Column:
    """What is left when a range within another of no lower priority goes: over the ranges by start and then by length, the furthest end so far of each priority."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label"))))

    def left(xs: Column, far: list[Column]) -> Column:
        # the same range with a better priority sorts first, so what covers x and may suppress it is before it
        over = lambda x, i: F.coalesce(*[F.when((x["priority"] >= p) & (F.get(f, i) >= -x["back"]), True) for p, f in enumerate(far, 1)], F.lit(False))
        kept = F.filter(xs, lambda x, i: ~over(x, i))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))

    def furthest(xs: Column, p: int) -> Column:
        return running(F.transform(xs, lambda x: F.when(x["priority"] == p, -x["back"]).otherwise(F.lit(-1).cast("long"))), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))

    def with_all(xs: Column, far: tuple[Column, ...]) -> Column:
        return left(xs, [*far]) if len(far) == HINT else let(furthest(xs, len(far) + 1), lambda f: with_all(xs, (*far, f)))

    return F.when(F.size(found) > 1, let(ordered, lambda xs: with_all(xs, ()))).otherwise(found)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (array of start, end, label, in the order of the text) and detections (array of start, end, priority, rule, label). Columns of these names are replaced."""
    table_of = rules()
    # as one text each, which Spark reads once: a literal for every word of every rule takes a driver 20 s
    told = [{"rule": i, "label": label, "priority": p, "words": words, "some": some, "pattern": pattern} for i, (label, p, words, some, pattern) in enumerate(table_of)]
    signed = F.from_json(F.lit(json.dumps(told)), "array<struct<rule:int,label:string,priority:int,words:array<string>,some:array<string>,pattern:string>>")
    keys = F.split(F.lit(" ".join(sorted({w for _, _, words, some, _ in table_of for w in words + some}))), " ")

    def per_rule(said: Column) -> Column:
        def tried(present: Column) -> Column:
            gate = lambda r: (F.size(F.array_except(r["words"], present)) == 0) & ((F.size(r["some"]) == 0) | F.arrays_overlap(r["some"], present))
            hits = lambda r: F.transform(places(said, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))
            return F.when(F.size(present) > 0, let(F.flatten(F.transform(F.filter(F.col("rules__"), gate), hits)), _suppress)).otherwise(F.array().cast(FOUND))

        return let(F.array_intersect(keys, F.split(said, " ")), tried)

    def based(phrase: str, label: str) -> Column:
        named = F.transform(places(F.col("said__"), F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains(F.col("said__"), F.lit(f" {phrase} ")), named).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,label:string>>"))

    said = docs.withColumn("said__", normal(F.col(text))).withColumn("rules__", signed)
    return said.withColumns(
        {
            "n_words": F.when(F.col("said__") == "  ", 0).otherwise(F.length("said__") - F.length(F.replace(F.col("said__"), F.lit(" "), F.lit(""))) - 1).cast("long"),
            "base": F.array_sort(F.concat(*[based(*x) for x in BASE.items()])),
            "detections": per_rule(F.col("said__")),
        }
    ).drop("said__", "rules__")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("base.start")
    # 1 for a license by its whole text or declaration, less for each step down to a mere hint
    best = F.array_min(F.col("detections.priority"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("detections.label"))), ",").alias("labels"),
        F.coalesce((5 - best) / 4.0, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
