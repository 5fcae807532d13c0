"""Rule table of the license scan: word-level regexes with keyword gates.

A rule is (label, priority, weight, keyword, regex).  Regexes run on the
normalised text, lower-cased words joined by single spaces, and must start and
end at word borders.  A lower priority number wins; the weight is the score of
a detection.
"""

from __future__ import annotations

#: Phrases whose places are counted as base detections: (label, words).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: (label, regex of the name, keyword that every spelling of it contains).
NAMES = [
    ("apache-1.1", r"apache (?:software )?(?:license )?(?:version |v ?)?1 1", "apache"),
    ("apache-2.0", r"apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?", "apache"),
    ("artistic-1.0", r"artistic (?:license )?(?:version )?1 0", "artistic"),
    ("artistic-2.0", r"artistic (?:license )?(?:version )?2(?: 0)?", "artistic"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("bsl-1.0", r"(?:bsl 1 0|boost software)", "bo"),
    ("busl-1.1", r"(?:busl 1 1|business source)", "bus"),
    ("cddl-1.0", r"(?:cddl(?: 1 0)?|common development and distribution)", "d"),
    ("cecill-2.1", r"cecill(?: 2 1)?", "cecill"),
    ("cpl-1.0", r"(?:cpl 1 0|common public)", "c"),
    ("epl-1.0", r"(?:epl 1 0|eclipse public (?:license )?(?:version |v )?1 0)", "e"),
    ("epl-2.0", r"(?:epl 2 0|eclipse public (?:license )?(?:version |v )?2 0)", "e"),
    ("eupl-1.2", r"(?:eupl(?: 1 2)?|european union public)", "eu"),
    ("gpl-1.0", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?1(?: 0)?", "g"),
    ("gpl-2.0", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?2(?: 0)?", "g"),
    ("gpl-3.0", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?3(?: 0)?", "g"),
    ("lgpl-2.0", r"(?:gnu )?(?:lgpl|(?:library|lesser) general public license) ?(?:version |v ?)?2(?: 0)?", "l"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?2 1", "l"),
    ("lgpl-3.0", r"(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?3(?: 0)?", "l"),
    ("agpl-3.0", r"(?:gnu )?(?:agpl|affero general public license) ?(?:version |v ?)?3(?: 0)?", "a"),
    ("gfdl-1.3", r"(?:gfdl|gnu free documentation license) ?(?:version |v ?)?1 3", "g"),
    ("isc", r"isc", "isc"),
    ("mit", r"(?:mit|expat)", "t"),
    ("mit-0", r"(?:mit 0|mit no attribution)", "mit"),
    ("mpl-1.1", r"(?:mpl|mozilla public license) ?(?:version |v ?)?1 1", "m"),
    ("mpl-2.0", r"(?:mpl|mozilla public license) ?(?:version |v ?)?2 0", "m"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "m"),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", "m"),
    ("ncsa", r"(?:ncsa|university of illinois ncsa)", "ncsa"),
    ("odbl-1.0", r"(?:odbl(?: 1 0)?|open database)", "o"),
    ("odc-by-1.0", r"odc by(?: 1 0)?", "odc"),
    ("pddl-1.0", r"pddl(?: 1 0)?", "pddl"),
    ("ofl-1.1", r"(?:ofl(?: 1 1)?|sil open font)", "o"),
    ("openssl", r"openssl", "openssl"),
    ("osl-3.0", r"(?:osl 3 0|open software license (?:version |v )?3 0)", "o"),
    ("afl-3.0", r"(?:afl 3 0|academic free license (?:version |v )?3 0)", "a"),
    ("php-3.01", r"php (?:license )?(?:version |v )?3 0?1", "php"),
    ("postgresql", r"postgresql", "postgresql"),
    ("psf-2.0", r"(?:psf 2 0|python software foundation)", "p"),
    ("python-2.0", r"python 2 0", "python"),
    ("qpl-1.0", r"(?:qpl 1 0|q public)", "q"),
    ("ruby", r"ruby", "ruby"),
    ("sspl-1.0", r"(?:sspl(?: 1 0)?|server side public)", "s"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("upl-1.0", r"(?:upl 1 0|universal permissive)", "u"),
    ("vim", r"vim", "vim"),
    ("w3c", r"w3c(?: software)?(?: notice and)?", "w3c"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "w"),
    ("x11", r"x11", "x11"),
    ("zlib", r"(?:zlib|libpng)", "lib"),
    ("zpl-2.1", r"(?:zpl 2 1|zope public)", "z"),
    ("elastic-2.0", r"elastic (?:license )?(?:version |v )?2(?: 0)?", "elastic"),
    ("polyform-nc-1.0", r"polyform noncommercial(?: 1 0 0)?", "polyform"),
    ("json", r"json", "json"),
    ("curl", r"curl", "curl"),
    ("ijg", r"(?:ijg|independent jpeg group)", "i"),
    ("beerware", r"beer ?ware", "beer"),
    ("openrail", r"(?:open ?rail(?: m)?|creativeml open ?rail m)", "rail"),
    ("llama", r"llama (?:2|3|3 1) community", "llama"),
]

#: The ways a license is named: (priority, weight, text before, text after, keyword).
FORMS = [
    (10, 1.0, r"spdx license identifier ", r"(?: only| or later)?", "spdx"),
    (20, 0.95, r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?", r"(?: licen[sc]e)?", "under"),
    (30, 0.8, r"(?:the )?", r" (?:public )?licen[sc]e", "licen"),
    (35, 0.75, r"licen[sc]e (?:is )?(?:the )?", r"", "licen"),
]

#: Names that stand for their license without any word around them.
COPYLEFT = ("gpl", "lgpl", "agpl")

#: Creative Commons: (label part, words, spelled-out words).
CREATIVE = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]

#: Whole clauses and notices.
TEXTS = [
    ("mit", 5, 1.0, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 5, 1.0, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 6, 1.0, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 5, 1.0, "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote"),
    ("apache-2.0", 5, 1.0, "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl", 5, 1.0, "free software you can redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 5, 1.0, "free software you can redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl-or-later", 8, 0.9, "any later version", r"either version \d of the license or at your option any later version"),
    ("mpl-2.0", 5, 1.0, "mozilla public", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("unlicense", 5, 1.0, "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 5, 1.0, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", 5, 1.0, "boost software", r"boost software license version 1 0"),
    ("cc0-1.0", 8, 0.95, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 9, 0.9, "creative commons", r"creative commons (?:zero|0)(?: v?1 0)?(?: universal)?"),
    ("public-domain", 15, 0.9, "public domain", r"(?:dedicated to|released into|placed in|in|is) the public domain"),
    ("public-domain", 40, 0.6, "public domain", r"public domain"),
    ("public-domain-mark", 15, 0.9, "public domain mark", r"public domain mark(?: 1 0)?"),
    ("no-warranty", 45, 0.4, "warrant", r"(?:without|no) (?:any )?(?:express or implied )?warrant(?:y|ies)(?: of any kind)?"),
    ("no-warranty", 44, 0.5, "as is", r"provided as is without (?:any )?warrant(?:y|ies)"),
    ("merchantability", 45, 0.4, "merchantability", r"implied warrant(?:y|ies) of merchantability"),
    ("copyright", 50, 0.4, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?"),
    ("copyright", 51, 0.3, "copyright", r"copyright"),
    ("copyleft", 50, 0.4, "copyleft", r"copyleft"),
    ("reserved", 49, 0.5, "reserved", r"(?:all|some|no) rights? reserved"),
    ("proprietary", 25, 0.8, "proprietary", r"proprietary (?:and confidential|licen[sc]e|software)"),
    ("proprietary", 24, 0.9, "unauthorized copying", r"unauthorized copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited"),
    ("commercial", 25, 0.8, "commercial licen", r"commercial licen[sc]e(?: agreement)?"),
    ("non-commercial", 26, 0.7, "non commercial", r"for non commercial (?:use|purposes) only"),
    ("non-commercial", 26, 0.7, "noncommercial", r"for noncommercial (?:use|purposes) only"),
    ("no-redistribution", 26, 0.7, "redistribut", r"(?:may not be|no) redistribut(?:ed|ion)(?: permitted)?"),
    ("reprint-permission", 26, 0.6, "permission", r"(?:reprinted|reproduced|used) (?:by|with) permission"),
    ("permission-required", 26, 0.6, "permission", r"without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("generic-license", 60, 0.3, "licensed under", r"licensed under"),
    ("generic-license", 61, 0.3, "terms of", r"under the terms of (?:the|this) licen[sc]e"),
    ("generic-license", 62, 0.2, "see licen", r"see licen[sc]e(?: file| txt| md)?"),
    ("eula", 25, 0.8, "end user licen", r"end user licen[sc]e agreement"),
    ("gpl", 47, 0.6, "gpl", r"(?:gnu )?gpl"),
    ("lgpl", 46, 0.6, "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", 46, 0.6, "agpl", r"(?:gnu )?agpl"),
    ("gpl", 47, 0.6, "general public licen", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl", 46, 0.7, "lesser general public", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl", 46, 0.7, "affero general public", r"(?:gnu )?affero general public licen[sc]e"),
    ("ogl-uk-3.0", 15, 0.9, "open government licen", r"open government licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?"),
    ("etalab-2.0", 15, 0.9, "etalab", r"(?:licence ouverte )?etalab(?: 2 0)?"),
    ("cdla-permissive", 15, 0.9, "cdla", r"cdla permissive(?: (?:1|2) 0)?"),
    ("mit", 7, 0.9, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 9, 0.8, "the software is provided", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 4, 0.9, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software .{1,200}? without restriction .{1,200}? to whom the software is furnished to do so the software is provided"),
    ("bsd-2-clause", 7, 0.9, "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 7, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", 5, 1.0, "all advertising materials", r"all advertising materials mentioning features or use of this software must display .{1,200}? acknowledge?ment (?:this product includes software developed by|.{0,40}copyright)"),
    ("bsd-source-code", 8, 0.7, "retain the above copyright", r"must retain the above copyright notice"),
    ("hpnd", 6, 0.9, "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("ntp", 6, 0.9, "permission to use copy modify", r"permission to use copy modify and distribute this software .{1,80}? for any purpose with(?:out)? (?:or without )?fee is hereby granted provided that"),
    ("apache-2.0", 6, 0.95, "apache license", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 8, 0.8, "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 8, 0.8, "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("agpl", 5, 1.0, "free software you can redistribute", r"(?:it|this program) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 6, 0.9, "received a copy of the gnu general", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 6, 0.9, "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("agpl", 6, 0.9, "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl", 9, 0.8, "fitness for a particular purpose", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero )?general public license"),
    ("gpl-classpath", 7, 0.9, "classpath exception", r"(?:gpl(?:v2| 2 0)? with (?:the )?classpath exception|subject to the classpath exception .{1,80}? license)"),
    ("gpl-linking-exception", 7, 0.8, "special exception", r"as a special exception the copyright holders? .{0,40}gives? (?:you )?permission to link"),
    ("gpl-only", 8, 0.8, "version", r"under the terms of (?:version [23] of the gnu general public license|the gnu general public license version [23]) only"),
    ("gpl-2.0", 6, 0.95, "general public license", r"gnu general public license as published by the free software foundation version 2"),
    ("gpl-2.0", 6, 0.95, "general public license", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", 6, 0.95, "general public license", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", 6, 0.95, "lesser general public", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", 6, 0.95, "lesser general public", r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", 6, 0.95, "affero general public", r"gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gfdl", 6, 0.95, "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 8, 0.7, "invariant sections", r"with no invariant sections .{0,80}(?:free documentation|license)"),
    ("mpl-2.0", 7, 0.9, "mozilla org mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at .{0,30}mozilla org mpl 2 0 .{0,60}licen[sc]e"),
    ("mpl-1.1", 5, 1.0, "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", 6, 0.95, "eclipse public", r"made available under the terms of the eclipse public license"),
    ("cddl", 6, 0.95, "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("cpal-1.0", 6, 0.95, "common public attribution", r"common public attribution license(?: version)? 1 0"),
    ("ms-pl", 6, 0.9, "microsoft public", r"microsoft public license(?: ms pl)?"),
    ("eupl", 6, 0.9, "eupl", r"licensed under the eupl(?: version)? 1 [12]"),
    ("cecill", 6, 0.9, "cecill", r"governed by the cecill(?: b| c)? license"),
    ("unlicense", 6, 0.95, "free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software .{1,200}? for any purpose commercial or non commercial"),
    ("public-domain", 12, 0.9, "public domain", r"(?:has been|is hereby|hereby) (?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", 12, 0.8, "copyright", r"(?:authors?|copyright holders?) disclaims? copyright"),
    ("public-domain", 16, 0.8, "public domain", r"(?:authors?|copyright holders?) .{1,60}? public domain"),
    ("cc0-1.0", 7, 0.95, "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("cc-by", 16, 0.7, "creative commons", r"(?:licensed|available|released|distributed) under (?:a|the) creative commons licen[sc]e"),
    ("cc-by-sa", 13, 0.9, "share alike", r"creative commons attribution share alike (?:licen[sc]e|[1-4] [05])"),
    ("zlib", 6, 0.9, "origin of this software", r"the origin of this software must not be misrepresented you must not claim .{0,80}(?:altered source|warranty|copyright|commercial)?"),
    ("zlib", 6, 0.9, "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("beerware", 6, 0.9, "beer in return", r"beer ware license .{1,300}? buy me a beer in return"),
    ("wtfpl", 6, 0.9, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("gpl", 8, 0.8, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("openssl", 6, 0.9, "openssl project", r"this product includes software developed by the openssl project .{1,120}?redistribut(?:ion|ions|ed|e)"),
    ("python-2.0", 6, 0.9, "python software foundation", r"python software foundation license(?: version 2)?"),
    ("php-3.01", 6, 0.9, "php license", r"subject to version 3 01 of the php license"),
    ("artistic", 7, 0.8, "artistic license", r"under the artistic license(?: 2 0)?"),
    ("perl", 7, 0.8, "same terms as perl", r"under the same terms as perl(?: \d)?(?: itself)?"),
    ("ofl-1.1", 6, 0.95, "sil open font", r"font software is licensed under the sil open font license"),
    ("odbl", 6, 0.9, "open data commons", r"open data commons (?:open database licen[sc]e|attribution licen[sc]e|public domain dedication and licen[sc]e)"),
    ("odbl-osm", 8, 0.8, "openstreetmap", r"copyright (?:c )?openstreetmap contributors"),
    ("elastic-2.0", 7, 0.9, "elastic license", r"licensed under the elastic license(?: 2 0)?"),
    ("sspl-1.0", 6, 0.9, "server side public", r"terms of the server side public license(?: version 1)?"),
    ("busl-1.1", 6, 0.9, "business source", r"business source license 1 1 .{0,120}change date"),
    ("commons-clause", 6, 0.9, "commons clause", r"commons clause license condition"),
    ("anti-996", 8, 0.8, "anti 996", r"anti 996 license"),
    ("hippocratic", 8, 0.8, "hippocratic", r"hippocratic license(?: version)?(?: \d \d)?"),
    ("prosperity", 8, 0.8, "prosperity public", r"prosperity public license"),
    ("parity", 8, 0.8, "parity public", r"parity public license"),
    ("blueoak-1.0.0", 8, 0.9, "blue oak model", r"blue oak model license(?: 1 0 0)?"),
    ("mulan-psl-2.0", 8, 0.9, "mulan", r"mulan permissive software license(?: v?2)?"),
    ("openrail", 8, 0.9, "rail", r"(?:bigscience |creativeml )?(?:open )?rail(?: m)? licen[sc]e"),
    ("openrail", 8, 0.9, "responsible ai", r"(?:open )?responsible ai licen[sc]e"),
    ("gemma", 8, 0.8, "gemma", r"gemma (?:is provided under .{0,40})?terms of use"),
    ("no-derivatives", 26, 0.7, "derivative works", r"no derivative works (?:are |is )?(?:permitted|allowed)(?: without .{0,40}permission)?"),
    ("no-ai-training", 26, 0.8, "train", r"(?:may not be used|not licensed|no permission .{0,30}) (?:for|to) train(?:ing)? .{0,40}(?:ai|models?|machine learning).{0,60}(?:permission|licen[sc]e|copyright)"),
    ("text-and-data-mining", 26, 0.8, "text and data mining", r"(?:all rights|rights) (?:are )?reserved including (?:those )?for text and data mining"),
    ("text-and-data-mining", 25, 0.8, "text and data mining", r"text and data mining (?:is )?(?:prohibited|not permitted|reserved)(?: without .{0,30}permission)?"),
    ("personal-use", 26, 0.7, "use only", r"for personal (?:and non commercial )?use only .{0,80}(?:copyright|licen[sc]e|permission|commercial)"),
    ("educational-use", 26, 0.7, "educational", r"for educational (?:and research )?(?:use|purposes) only .{0,80}(?:copyright|licen[sc]e|permission|commercial)"),
    ("research-only", 26, 0.7, "research", r"(?:for research purposes only|research only licen[sc]e|academic research licen[sc]e)"),
    ("evaluation", 26, 0.7, "evaluation", r"evaluation licen[sc]e(?: agreement)?"),
    ("trial", 26, 0.6, "trial", r"(?:free )?trial licen[sc]e"),
    ("site-license", 26, 0.6, "site licen", r"site licen[sc]e"),
    ("royalty-free", 27, 0.6, "royalty free", r"(?:worldwide |perpetual |non exclusive |irrevocable )*royalty free (?:copyright )?licen[sc]e"),
    ("perpetual", 28, 0.6, "perpetual", r"perpetual (?:worldwide |non exclusive |no charge |irrevocable )+(?:copyright |patent )?licen[sc]e"),
    ("patent-grant", 28, 0.6, "patent licen", r"(?:hereby )?grants? .{0,100}patent licen[sc]e"),
    ("sublicense", 46, 0.4, "sublicens", r"(?:right to )?sublicens(?:e|ed|able|ing)"),
    ("trademark", 46, 0.4, "trademark", r"(?:registered )?trademarks? .{0,60}(?:used under licen[sc]e|used with permission|all rights reserved)"),
    ("confidential", 25, 0.7, "confidential", r"confidential and proprietary"),
    ("trade-secret", 25, 0.8, "trade secret", r"(?:trade secrets? .{0,60}proprietary|proprietary .{0,60}trade secrets?)"),
    ("liability", 45, 0.4, "liable", r"in no event shall the (?:authors?|copyright holders?|regents)(?: or (?:copyright holders?|contributors))? be liable .{0,200}?(?:copyright|warrant(?:y|ies)|licen[sc]e|software)"),
    ("us-government", 27, 0.7, "government", r"(?:work of the (?:u s|united states) government|u s government works?) .{0,80}(?:public domain|copyright|licen[sc]e)"),
    ("crown-copyright", 24, 0.8, "crown copyright", r"crown copyright"),
    ("fair-use", 46, 0.4, "fair use", r"fair use .{0,60}copyright(?:ed)?"),
    ("syndication", 27, 0.6, "redistributed", r"(?:this material|this content|this article) may not be published broadcast rewritten or redistributed"),
    ("reproduction-reserved", 27, 0.7, "reproduced", r"no part of this (?:publication|book|work|document|site) may be reproduced .{0,160}?permission"),
    ("quotation", 46, 0.4, "permission of the", r"(?:with|by) (?:the )?(?:kind )?permission of the (?:author|publisher|copyright holder|editor)s?"),
    ("copyright-notice", 48, 0.5, "copyright", r"copyright (?:c )?(?:19|20)\d\d .{1,60}? all rights reserved"),
    ("licensed-to", 59, 0.3, "licensed to", r"licensed to .{1,40}? by"),
    ("licensor", 59, 0.3, "licensor", r"(?:the )?licensors?"),
    ("license-terms", 59, 0.3, "licen", r"(?:licen[sc]e terms|terms of (?:the )?licen[sc]e|licen[sc]ing terms)"),
    ("dual-license", 27, 0.7, "dual licen", r"dual licen[sc]ed?(?: under)?"),
    ("open-source", 58, 0.3, "open source licen", r"(?:osi approved )?open source licen[sc]e"),
    ("free-license", 58, 0.3, "free licen", r"(?:under a )?free licen[sc]e"),
    ("permissive", 58, 0.3, "permissive", r"permissive (?:software |open source )?licen[sc]e"),
    ("share-alike", 46, 0.5, "share alike", r"share alike (?:licen[sc]e|terms of use|terms of)"),
]


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules in order: texts, named forms, Creative Commons, base phrases."""
    out = [(label, priority, weight, keyword, regex) for label, priority, weight, keyword, regex in TEXTS]
    for label, name, keyword in NAMES:
        for priority, weight, before, after, form in FORMS:
            out.append((label, priority, weight, form if len(keyword) < 3 else keyword, before + name + after))
        if label.startswith(COPYLEFT):
            out.append((label, 38, 0.7, keyword, name))
    for part, short, spelled in CREATIVE:
        for version in ("4 0", "3 0", "2 5", "2 0", "1 0"):
            out.append((f"cc-{part}-{version.replace(' ', '.')}", 12, 0.95, "cc", f"cc {short} {version}"))
        out.append((f"cc-{part}", 14, 0.9, "cc", f"cc {short}"))
        out.append((f"cc-{part}", 13, 0.9, "creative commons", f"creative commons {spelled}(?: (?:[1-4] [05]|international|unported|licen[sc]e))*"))
    out += [(label, 48, 0.5, words, words) for label, words in BASE]
    return out
