"""License scans with ordered signature rules, in built-in functions only.

A text is lower-cased (A-Z), cut into words and laid out as words with single spaces. Keywords found in
it gate the signature rules: a rule runs over the stretches of ``REACH`` words on either side of its own
keyword, stretches that meet being one. Hits are walked in order of start (longer, then higher priority
first): a hit that lies inside one of equal or higher priority is suppressed. What survives gives the
method's labels and the score; phrases of the base list always keep theirs.

Rules are of three kinds: notices, clauses and addresses written out one by one; names of licences in
the forms in which licences are named; and names that stand alone.

Everything is one projection: no shuffle, no row is copied. No word lies in two stretches of a keyword,
places of hits are read off in one pass, and suppression keeps one end a priority, so the cost is linear
in the words of a text, however long and however full of keywords.

Defined cases: a null text counts as empty (no words, no labels, score 0, null positions). Repeated
rows and null ids are kept as they are; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words on either side of a gating keyword; the longest signature has fewer.
REACH = 24
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Keyword, label and name of each family (names are regular expressions over spaced words).
FAMILIES = [
    ("gnu", "agpl", "gnu affero general public license|agpl|affero gpl"),
    ("agpl", "agpl", "agpl"),
    ("affero", "agpl", "affero general public license|affero gpl"),
    ("gnu", "lgpl", "gnu (?:lesser|library) general public license|lesser gpl"),
    ("lesser", "lgpl", "lesser general public license|lesser gpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("gnu", "gfdl", "gnu free documentation license|gfdl"),
    ("gfdl", "gfdl", "gfdl"),
    ("gnu", "gpl", "gnu general public license|gnu gpl"),
    ("gpl", "gpl", "gpl"),
    ("apache", "apache", "apache software license|apache license|apache"),
    ("mit", "mit", "mit license|mit x11 license|mit"),
    ("expat", "mit", "expat license|expat"),
    ("bsd", "bsd-2-clause", "bsd 2 clause|simplified bsd|2 clause bsd|freebsd"),
    ("freebsd", "bsd-2-clause", "freebsd"),
    ("bsd", "bsd-3-clause", "bsd 3 clause|new bsd|modified bsd|3 clause bsd"),
    ("bsd", "bsd-4-clause", "bsd 4 clause|original bsd|4 clause bsd"),
    ("bsd", "bsd", "bsd license|bsd"),
    ("mozilla", "mpl", "mozilla public license"),
    ("mpl", "mpl", "mpl"),
    ("eclipse", "epl", "eclipse public license"),
    ("epl", "epl", "epl"),
    ("cddl", "cddl", "cddl"),
    ("common", "cddl", "common development and distribution license"),
    ("common", "cpl", "common public license"),
    ("cc", "cc-by-nc-nd", "cc by nc nd"),
    ("cc", "cc-by-nc-sa", "cc by nc sa"),
    ("cc", "cc-by-nc", "cc by nc"),
    ("cc", "cc-by-nd", "cc by nd"),
    ("cc", "cc-by-sa", "cc by sa"),
    ("cc", "cc-by", "cc by"),
    ("cc0", "cc0", "cc0"),
    ("creative", "cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("creative", "cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
    ("creative", "cc-by-nc", "creative commons attribution non ?commercial"),
    ("creative", "cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?"),
    ("creative", "cc-by-sa", "creative commons attribution share ?alike"),
    ("creative", "cc-by", "creative commons attribution"),
    ("creative", "cc0", "creative commons zero"),
    ("isc", "isc", "isc license|isc"),
    ("zlib", "zlib", "zlib libpng license|zlib license|zlib"),
    ("boost", "bsl", "boost software license"),
    ("artistic", "artistic", "artistic license"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", "psf", "python software foundation license|python license"),
    ("php", "php", "php license"),
    ("ruby", "ruby", "ruby license"),
    ("openssl", "openssl", "openssl license"),
    ("postgresql", "postgresql", "postgresql license"),
    ("european", "eupl", "european union public licen[cs]e"),
    ("eupl", "eupl", "eupl"),
    ("microsoft", "ms-pl", "microsoft public license"),
    ("microsoft", "ms-rl", "microsoft reciprocal license"),
    ("sil", "ofl", "sil open font license"),
    ("ofl", "ofl", "ofl"),
    ("open", "odbl", "open database license"),
    ("open", "odc-by", "open data commons attribution license"),
    ("open", "ogl", "open government licen[cs]e"),
    ("server", "sspl", "server side public license"),
    ("business", "busl", "business source license"),
    ("academic", "afl", "academic free license"),
    ("open", "osl", "open software license"),
    ("open", "opl", "open publication license"),
    ("latex", "lppl", "latex project public license"),
    ("lppl", "lppl", "lppl"),
    ("qt", "qpl", "q public license|qt public license"),
    ("ibm", "ipl", "ibm public license"),
    ("nasa", "nasa", "nasa open source agreement"),
    ("x11", "x11", "x11 license"),
    ("beerware", "beerware", "beerware license|beerware"),
    ("cecill", "cecill", "cecill"),
    ("mulan", "mulanpsl", "mulan permissive software license|mulan psl"),
    ("elastic", "elastic", "elastic license"),
    ("universal", "upl", "universal permissive license"),
    ("w3c", "w3c", "w3c software (?:notice and )?license|w3c license"),
    ("zope", "zpl", "zope public license"),
    ("sleepycat", "sleepycat", "sleepycat license|sleepycat"),
    ("vim", "vim", "vim license"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license|ncsa open source license"),
    ("apple", "apsl", "apple public source license"),
    ("attribution", "cpal", "common public attribution license"),
    ("reciprocal", "rpl", "reciprocal public license"),
    ("hpnd", "hpnd", "hpnd"),
    ("historical", "hpnd", "historical permission notice and disclaimer"),
    ("0bsd", "0bsd", "0bsd"),
    ("blueoak", "blueoak", "blueoak|blue oak model license"),
    ("cern", "cern-ohl", "cern open hardware licen[cs]e|cern ohl"),
    ("unicode", "unicode", "unicode license agreement|unicode license"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|perimeter) license"),
]
#: Names that mean other things too: no licence without a word that says so.
AMBIGUOUS = {"apache", "mit", "expat", "bsd", "freebsd", "isc", "zlib", "mpl", "epl", "ofl"}
#: Form, priority, score and whether the version joins the label. {n} is the name, {v} a version, {s} a name that
#: doesn't end in license, {b} one that stands alone.
VERSION = r"(?:version |v ?)?([0-9]+)(?: ([0-9]+))?"
FORMS = [
    (r"(?:licensed|released|distributed|published|available|provided|offered|shared) under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[cs]e)?,? {v}", 3, 1.0, True),
    (r"(?:licensed|released|distributed|published|available|provided|offered|shared) under (?:the )?(?:terms of (?:the )?)?(?:{n})(?: licen[cs]e)?", 3, 0.95, False),
    (r"spdx license identifier (?:{n}) {v}", 3, 1.0, True),
    (r"spdx license identifier (?:{n})", 3, 1.0, False),
    (r"spdx license identifier(?: [^ ]+){{1,10}}? (?:or|and|with) (?:{n}) {v}", 3, 1.0, True),
    (r"spdx license identifier(?: [^ ]+){{1,10}}? (?:or|and|with) (?:{n})", 3, 1.0, False),
    (r"(?:{n})(?: licen[cs]e)? {v}", 2, 0.9, True),
    (r"(?:subject to|governed by|under) the (?:terms of the )?(?:{n})", 2, 0.85, False),
    (r"licen[cs]e(?: is| type| name| id)?(?: the)? (?:{n}) {v}", 2, 0.9, True),
    (r"licen[cs]e(?: is| type| name| id)?(?: the)? (?:{n})", 2, 0.85, False),
    (r"(?:{s}) licen[cs]e", 1, 0.8, False),
    (r"(?:{b})", 1, 0.75, False),
]
#: Notices, clauses and addresses, each written out: keyword, label, pattern, priority, score.
NOTICES = [
    ("rights", "all-rights-reserved", "all rights reserved", 1, 0.6),
    ("domain", "public-domain", "(?:dedicated to|released into|in) the public domain", 2, 0.9),
    ("proprietary", "proprietary", "proprietary and confidential", 2, 0.8),
    ("warranty", "warranty-disclaimer", "without warranty of any kind", 1, 0.5),
    ("permission", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("redistribution", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("verbatim", "copyleft", "you may copy and distribute verbatim copies", 2, 0.7),
    ("gnu", "gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", 3, 1.0),
    ("gnu", "lgpl", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 3, 1.0),
    ("gnu", "agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 3, 1.0),
    ("gnu", "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 3, 1.0),
    ("writing", "apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 3, 1.0),
    ("mozilla", "mpl", "this source code form is subject to the terms of the mozilla public license", 3, 1.0),
    ("eclipse", "epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 3, 1.0),
    ("common", "cddl", "the contents of this file are subject to the terms of the common development and distribution license", 3, 1.0),
    ("common", "cpl", "the accompanying program is provided under the terms of this common public license", 3, 1.0),
    ("permission", "isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 3, 1.0),
    ("permission", "bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 3, 1.0),
    ("permission", "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 3, 1.0),
    ("liable", "zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 3, 1.0),
    ("endorse", "bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 3, 1.0),
    ("advertising", "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 3, 1.0),
    ("unencumbered", "unlicense", "this is free and unencumbered software released into the public domain", 3, 1.0),
    ("fuck", "wtfpl", "do what the fuck you want to public license", 3, 1.0),
    ("deed", "cc0", "the person who associated a work with this deed has dedicated the work to the public domain", 3, 1.0),
    ("sil", "ofl", "this font software is licensed under the sil open font license", 3, 1.0),
    ("python", "psf", "psf is making python available to licensee on an as is basis", 3, 1.0),
    ("php", "php", "this product includes php software freely available from", 3, 1.0),
    ("ruby", "ruby", "ruby is copyrighted free software by yukihiro matsumoto", 3, 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 3, 1.0),
    ("licensor", "busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 3, 1.0),
    # apache
    ("compliance", "apache", "you may not use this file except in compliance with the license", 3, 1.0),
    ("licensor", "apache", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license", 3, 1.0),
    ("contributor", "apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 3, 1.0),
    ("patent", "apache", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 3, 1.0),
    ("prominent", "apache", "you must cause any modified files to carry prominent notices stating that you changed the files", 3, 1.0),
    ("apache", "apache", "this product includes software developed (?:by|at) the apache software foundation", 3, 0.9),
    ("www", "apache-2.0", "www apache org licenses license 2 0", 3, 1.0),
    # mit and its kin
    ("substantial", "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3, 1.0),
    ("sublicense", "mit", "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 3, 1.0),
    ("noninfringement", "mit", "warranties of merchantability fitness for a particular purpose and noninfringement", 2, 0.7),
    ("dealings", "mit", "arising from out of or in connection with the software or the use or other dealings in the software", 3, 0.9),
    ("except", "x11", "except as contained in this notice the name of(?: [^ ]+){1,8} shall not be used in advertising", 3, 1.0),
    ("evil", "json", "the software shall be used for good not evil", 3, 1.0),
    ("opensource", "mit", "opensource org licenses? mit(?: license)?", 3, 1.0),
    ("mit", "mit", "dual licensed under (?:the )?(?:mit and|mit or)", 3, 0.9),
    ("choosealicense", "mit", "choosealicense com licenses mit", 3, 1.0),
    # bsd
    ("redistributions", "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 1.0),
    ("redistributions", "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 3, 1.0),
    ("neither", "bsd-3-clause", "neither the name of(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote", 3, 1.0),
    ("regents", "bsd", "the regents of the university of california", 2, 0.7),
    ("contributors", "bsd", "this software is provided by the copyright holders and contributors as is", 3, 0.9),
    ("procurement", "bsd", "including but not limited to procurement of substitute goods or services loss of use data or profits", 3, 0.9),
    ("negligence", "bsd", "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software", 3, 0.9),
    ("opensource", "bsd-2-clause", "opensource org licenses? bsd 2 clause", 3, 1.0),
    ("opensource", "bsd-3-clause", "opensource org licenses? bsd 3 clause", 3, 1.0),
    # isc, zlib, boost
    ("disclaims", "isc", "the author disclaims all warranties with regard to this software", 3, 1.0),
    ("disclaims", "isc", "(?:isc|internet systems consortium(?: inc)?) disclaims all warranties with regard to this software", 3, 1.0),
    ("opensource", "isc", "opensource org licenses? isc(?: license)?", 3, 1.0),
    ("misrepresented", "zlib", "the origin of this software must not be misrepresented", 3, 1.0),
    ("plainly", "zlib", "altered source versions must be plainly marked as such", 3, 1.0),
    ("opensource", "zlib", "opensource org licenses? zlib(?: license)?", 3, 1.0),
    ("entire", "bsl", "the copyright notices in the software and this entire statement including the above license grant", 3, 1.0),
    ("boost", "bsl-1.0", "www boost org license 1 0 txt", 3, 1.0),
    # gpl, lgpl, agpl
    ("gnu", "gpl", "you should have received a copy of the gnu general public license along with", 3, 1.0),
    ("gnu", "lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 3, 1.0),
    ("gnu", "agpl", "you should have received a copy of the gnu affero general public license along with", 3, 1.0),
    ("hope", "gnu-notice", "is distributed in the hope that it will be useful but without any warranty", 2, 0.9),
    ("later", "or-later", "either version [0-9]+(?: [0-9]+)? of the license or at your option any later version", 2, 0.9),
    ("freedom", "gpl", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 3, 1.0),
    ("propagate", "gpl", "you may not propagate or modify a covered work except as expressly provided under this license", 3, 1.0),
    ("convey", "gpl", "you may convey a work based on the program", 3, 0.95),
    ("library", "lgpl", "work that uses the library", 2, 0.8),
    ("library", "lgpl", "you may copy and distribute verbatim copies of the library s complete source code", 3, 1.0),
    ("remotely", "agpl", "all users interacting with it remotely through a computer network", 3, 1.0),
    ("library", "linking-exception", "as a special exception the copyright holders of this library give you permission to link this library", 3, 0.9),
    ("classpath", "classpath-exception", "classpath exception(?: 2 0)?", 3, 0.9),
    ("gnu", "gpl", "www gnu org licenses gpl(?: [0-9]+ [0-9]+)?", 3, 0.95),
    ("gnu", "lgpl", "www gnu org licenses lgpl(?: [0-9]+ [0-9]+)?", 3, 0.95),
    ("gnu", "agpl", "www gnu org licenses agpl(?: [0-9]+ [0-9]+)?", 3, 0.95),
    ("gnu", "gfdl", "www gnu org licenses fdl(?: [0-9]+ [0-9]+)?", 3, 0.95),
    ("gnu", "gnu", "www gnu org licenses", 1, 0.7),
    ("invariant", "gfdl", "with no invariant sections no front cover texts and no back cover texts", 3, 1.0),
    ("royalty", "gnu-all-permissive", "are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 3, 1.0),
    # mpl, epl, cddl, other weak copyleft
    ("mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 3, 1.0),
    ("mozilla", "mpl-2.0", "mozilla org mpl 2 0", 3, 1.0),
    ("covered", "mpl", "covered software is provided under this license on an as is basis", 3, 1.0),
    ("incompatible", "mpl", "this source code form is incompatible with secondary licenses", 3, 1.0),
    ("eclipse", "epl-2.0", "www eclipse org legal epl 2 0", 3, 1.0),
    ("eclipse", "epl-1.0", "www eclipse org legal epl v10", 3, 1.0),
    ("recipient", "epl", "constitutes recipient s acceptance of this agreement", 3, 1.0),
    ("cddl", "cddl", "you can obtain a copy of the license at(?: [^ ]+){1,12} cddl", 3, 0.9),
    ("artistic", "artistic", "the artistic license or the gnu general public license", 3, 0.95),
    ("perl", "artistic", "under the same terms as perl itself", 3, 0.95),
    ("intent", "artistic", "the intent of this document is to state the conditions under which a package may be copied", 3, 1.0),
    ("perlfoundation", "artistic", "www perlfoundation org artistic license 2 0", 3, 1.0),
    # creative commons and data
    ("appropriate", "cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", 3, 1.0),
    ("adapt", "cc-by", "adapt remix transform and build upon the material for any purpose even commercially", 3, 1.0),
    ("contributions", "cc-by-sa", "you must distribute your contributions under the same license as the original", 3, 1.0),
    ("purposes", "cc-by-nc", "you may not use the material for commercial purposes", 3, 1.0),
    ("modified", "cc-by-nd", "you may not distribute the modified material", 3, 1.0),
    ("redistribute", "cc", "you are free to share copy and redistribute the material in any medium or format", 2, 0.8),
    ("waived", "cc0", "has waived all copyright and related or neighbou?ring rights to this work", 3, 1.0),
    ("affirmer", "cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 3, 1.0),
    ("creativecommons", "cc-by", "creativecommons org licenses by", 3, 1.0),
    ("creativecommons", "cc-by-sa", "creativecommons org licenses by sa", 3, 1.0),
    ("creativecommons", "cc-by-nc", "creativecommons org licenses by nc", 3, 1.0),
    ("creativecommons", "cc-by-nd", "creativecommons org licenses by nd", 3, 1.0),
    ("creativecommons", "cc-by-nc-sa", "creativecommons org licenses by nc sa", 3, 1.0),
    ("creativecommons", "cc-by-nc-nd", "creativecommons org licenses by nc nd", 3, 1.0),
    ("creativecommons", "cc0", "creativecommons org publicdomain zero", 3, 1.0),
    ("creativecommons", "public-domain", "creativecommons org publicdomain mark", 3, 1.0),
    ("opendatacommons", "odbl", "opendatacommons org licenses odbl", 3, 1.0),
    ("opendatacommons", "odc-by", "opendatacommons org licenses by", 3, 1.0),
    ("opendatacommons", "pddl", "opendatacommons org licenses pddl", 3, 1.0),
    ("nationalarchives", "ogl", "nationalarchives gov uk doc open government licen[cs]e", 3, 1.0),
    ("etalab", "etalab", "licence ouverte|etalab open license", 3, 0.9),
    # fonts, public domain, odd ones
    ("reserved", "ofl", "with reserved font name", 3, 0.95),
    ("scripts", "ofl", "scripts sil org ofl", 3, 1.0),
    ("anyone", "unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 3, 1.0),
    ("unlicense", "unlicense", "for more information please refer to https? unlicense org", 3, 1.0),
    ("everyone", "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 3, 1.0),
    ("verbatim", "copyleft", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 3, 0.9),
    ("beer", "beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 3, 1.0),
    ("stuff", "beerware", "as long as you retain this notice you can do whatever you want with this stuff", 3, 1.0),
    ("whatsoever", "openssl", "redistributions of any form whatsoever must retain the following acknowledge?ment", 3, 1.0),
    ("cryptographic", "openssl", "this product includes cryptographic software written by eric young", 3, 1.0),
    ("forgiveness", "blessing", "may you find forgiveness for yourself and forgive others", 3, 1.0),
    ("disclaim", "public-domain", "the authors of this (?:source code|software|work) disclaim copyright", 3, 0.9),
    ("disclaims", "public-domain", "the authors? disclaims copyright to this source code", 3, 1.0),
    ("domain", "public-domain", "placed in(?:to)? the public domain|this (?:file|work|code|software) is (?:in the )?public domain", 2, 0.9),
    # source available and closed
    ("commons", "commons-clause", "commons clause license condition", 3, 1.0),
    ("noncommercial", "polyform", "polyform noncommercial license", 3, 1.0),
    ("managed", "elastic", "you may not provide the software to third parties as a hosted or managed service", 3, 1.0),
    ("service", "sspl", "if you make the functionality of the program or a modified version available to third parties as a service", 3, 1.0),
    ("confidential", "proprietary", "this (?:document|software|file) is confidential|strictly confidential", 2, 0.7),
    ("unauthorized", "proprietary", "unauthorized copying of this (?:file|software|document|program)", 3, 0.9),
    ("eula", "proprietary", "end user licen[cs]e agreement eula|eula", 2, 0.7),
    ("user", "proprietary", "end user licen[cs]e agreement", 2, 0.7),
    ("reproduced", "all-rights-reserved", "no part of this (?:publication|book|work) may be reproduced", 2, 0.8),
    ("trademarks", "trademark-notice", "(?:are|is a) (?:registered )?trademarks? of", 1, 0.4),
    ("evaluation", "proprietary", "for evaluation purposes only", 2, 0.6),
    # gnu, clause by clause
    ("hope", "gpl", "this program is distributed in the hope that it will be useful but without any warranty", 3, 0.95),
    ("merchantability", "gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.7),
    ("copy", "gpl", "you should have received a copy of the gnu general public license along with this program", 3, 1.0),
    ("received", "lgpl", "you should have received a copy of the gnu lesser general public license along with this library", 3, 1.0),
    ("received", "agpl", "you should have received a copy of the gnu affero general public license", 3, 1.0),
    ("franklin", "gpl", "free software foundation inc 51 franklin st(?:reet)? fifth floor boston", 3, 0.9),
    ("temple", "gpl", "free software foundation inc 59 temple place", 3, 0.9),
    ("freedom", "gpl", "guarantee your freedom to share and change", 3, 0.95),
    ("conveying", "gpl", "basic permissions all rights granted under this license|conveying (?:verbatim copies|modified source versions|non source forms)", 3, 0.9),
    ("installation", "gpl", "installation information for a user product means any methods procedures authorization keys", 3, 1.0),
    ("corresponding", "gpl", "accompany it with the complete corresponding machine readable source code", 3, 0.95),
    ("combined", "lgpl", "you may convey a combined work under terms of your choice", 3, 1.0),
    ("library", "lgpl", "a work that uses the library", 3, 0.8),
    ("remotely", "agpl", "users interacting with it remotely through a computer network", 3, 1.0),
    ("linking", "gpl-exception", "linking this library statically or dynamically with other modules is making a combined work", 3, 0.95),
    ("classpath", "gpl-exception", "classpath exception", 2, 0.9),
    ("bison", "gpl-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 3, 1.0),
    ("runtime", "gpl-exception", "gcc runtime library exception", 3, 1.0),
    # artistic, perl and their kin
    ("perl", "artistic", "under the same terms as perl(?: itself)?", 3, 0.95),
    ("artistic", "artistic", "semblance of artistic control over the development of the package", 3, 1.0),
    ("freely", "artistic", "make your modifications freely available such as by posting said modifications to usenet", 3, 1.0),
    ("bsdl", "ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", 3, 1.0),
    # fonts
    ("reserved", "ofl", "reserved font name", 3, 0.9),
    ("bundled", "ofl", "may be bundled redistributed and or sold with any software provided that each copy contains the above copyright notice", 3, 1.0),
    ("bitstream", "bitstream-vera", "bitstream vera is a trademark of bitstream", 3, 1.0),
    ("ubuntu", "ubuntu-font", "ubuntu font licen[cs]e", 3, 1.0),
    ("freetype", "ftl", "portions of this software are copyright(?: [^ ]+){1,4} the freetype project", 3, 1.0),
    ("freetype", "ftl", "the freetype project licen[cs]e", 3, 1.0),
    # images, compression and other libraries
    ("png", "libpng", "the png reference library is supplied as is", 3, 1.0),
    ("jpeg", "ijg", "this software is based in part on the work of the independent jpeg group", 3, 1.0),
    ("independent", "ijg", "the independent jpeg group s software", 2, 0.8),
    ("silicon", "libtiff", "the names of sam leffler and silicon graphics may not be used", 3, 1.0),
    ("leffler", "libtiff", "copyright c(?: [^ ]+){1,4} sam leffler", 3, 0.9),
    ("zip", "info-zip", "info zip licen[cs]e|this is version(?: [^ ]+){1,6} of the info zip licen[cs]e", 3, 1.0),
    ("plainly", "zlib", "altered source versions must be plainly marked as such and must not be misrepresented", 3, 1.0),
    ("haxx", "curl", "curl haxx se docs copyright|curl se docs copyright", 3, 1.0),
    ("stenberg", "curl", "copyright(?: c)?(?: [^ ]+){1,4} daniel stenberg", 3, 0.9),
    ("expat", "mit", "copyright(?: c)?(?: [^ ]+){1,4} expat maintainers", 3, 0.9),
    ("icu", "icu", "icu licen[cs]e icu 1 8 1 and later", 3, 1.0),
    ("unicode", "unicode", "unicode inc licen[cs]e agreement data files and software", 3, 1.0),
    ("unicode", "unicode", "distributed under the terms of use in (?:http|https) www unicode org copyright html", 3, 1.0),
    ("disclaims", "public-domain", "disclaims copyright to this (?:source code|software|work)", 3, 1.0),
    ("blessing", "blessing", "in place of a legal notice here is a blessing", 3, 1.0),
    ("sleepycat", "sleepycat", "sleepycat software inc|the sleepycat licen[cs]e", 3, 0.9),
    ("berkeley", "bsd", "this product includes software developed by the university of california berkeley and its contributors", 3, 1.0),
    ("regents", "bsd", "copyright c(?: [^ ]+){1,6} the regents of the university of california", 3, 0.9),
    ("netbsd", "bsd", "this code is derived from software contributed to the netbsd foundation", 3, 1.0),
    ("openbsd", "isc", "permission to use copy modify and distribute this software(?: [^ ]+){1,4} openbsd", 2, 0.7),
    ("ssl", "ssleay", "this package is an ssl implementation written by eric young", 3, 1.0),
    # permissive odds and ends
    ("beerware", "beerware", "the beerware licen[cs]e", 3, 1.0),
    ("beer", "beerware", "the beer ware licen[cs]e", 3, 1.0),
    ("oak", "blue-oak", "blue oak model licen[cs]e", 3, 1.0),
    ("contributor", "blue-oak", "each contributor licenses you to do everything with this software", 3, 1.0),
    ("instrument", "fair", "usage of the works is permitted provided that this instrument is retained with the works", 3, 1.0),
    ("usage", "fair", "usage of the works is permitted", 2, 0.8),
    ("miros", "miros", "the miros licence", 3, 1.0),
    ("ntp", "ntp", "permission to use copy modify and distribute this software and its documentation for any purpose(?: [^ ]+){1,6} ntp", 2, 0.7),
    ("ncsa", "ncsa", "university of illinois ncsa open source licen[cs]e", 3, 1.0),
    ("illinois", "ncsa", "neither the names of(?: [^ ]+){1,6} university of illinois", 3, 0.9),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e", 3, 1.0),
    ("consortium", "w3c", "copyright c(?: [^ ]+){1,4} world wide web consortium", 3, 0.9),
    ("vim", "vim", "vim is charityware you can use and copy it as much as you like", 3, 1.0),
    ("charityware", "vim", "charityware", 2, 0.8),
    ("cern", "cern-ohl", "cern open hardware licen[cs]e", 3, 1.0),
    ("solderpad", "solderpad", "solderpad hardware licen[cs]e", 3, 1.0),
    ("mulan", "mulan-psl", "mulan psl v2|mulan permissive software licen[cs]e", 3, 1.0),
    ("zope", "zpl", "zope public licen[cs]e", 3, 1.0),
    ("academic", "afl", "academic free licen[cs]e", 3, 1.0),
    ("open", "osl", "licensed under the open software licen[cs]e", 3, 1.0),
    ("educational", "ecl", "educational community licen[cs]e", 3, 1.0),
    ("latex", "lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 3, 1.0),
    ("maintenance", "lppl", "this work has the lppl maintenance status", 3, 1.0),
    # makers' licences
    ("microsoft", "ms-pl", "microsoft public licen[cs]e", 3, 1.0),
    ("microsoft", "ms-rl", "microsoft reciprocal licen[cs]e", 3, 1.0),
    ("microsoft", "proprietary", "microsoft software licen[cs]e terms", 3, 0.9),
    ("oracle", "proprietary", "oracle binary code licen[cs]e agreement", 3, 1.0),
    ("universal", "upl", "the universal permissive licen[cs]e upl", 3, 1.0),
    ("ibm", "ipl", "ibm public licen[cs]e", 3, 1.0),
    ("netscape", "npl", "netscape public licen[cs]e", 3, 1.0),
    ("nokia", "nokia", "nokia open source licen[cs]e", 3, 1.0),
    ("nvidia", "proprietary", "nvidia software licen[cs]e agreement|nvidia end user licen[cs]e agreement", 3, 1.0),
    ("intel", "intel", "intel simplified software licen[cs]e|intel open source licen[cs]e", 3, 1.0),
    ("apple", "apsl", "apple public source licen[cs]e", 3, 1.0),
    ("sgi", "sgi-b", "sgi free software licen[cs]e b", 3, 1.0),
    ("trolltech", "qpl", "q public licen[cs]e|trolltech", 2, 0.8),
    ("sybase", "sybase", "sybase open watcom public licen[cs]e", 3, 1.0),
    ("realnetworks", "rpsl", "realnetworks public source licen[cs]e", 3, 1.0),
    ("lucent", "lpl", "lucent public licen[cs]e", 3, 1.0),
    ("nasa", "nasa", "nasa open source agreement", 3, 1.0),
    # europe
    ("european", "eupl", "licensed under the eupl(?: [^ ]+){1,12} european commission|european union public licen[cs]e", 3, 1.0),
    ("eupl", "eupl", "licensed under the eupl", 3, 1.0),
    ("cecill", "cecill", "this software is governed by the cecill(?: [bc])? licen[cs]e", 3, 1.0),
    ("french", "cecill", "governed by the cecill(?: [bc])? licen[cs]e under french law", 3, 1.0),
    # works, data and models
    ("attribution", "cc-by-sa", "creative commons attribution share ?alike", 3, 1.0),
    ("noncommercial", "cc-by-nc", "creative commons attribution noncommercial", 3, 1.0),
    ("commercial", "cc-by-nc", "creative commons attribution non commercial", 3, 1.0),
    ("noderivs", "cc-by-nd", "creative commons attribution noderivs", 3, 1.0),
    ("derivs", "cc-by-nd", "creative commons attribution no derivs", 3, 1.0),
    ("noderivatives", "cc-by-nd", "creative commons attribution noderivatives", 3, 1.0),
    ("creativecommons", "cc", "to view a copy of this licen[cs]e visit (?:http|https) creativecommons org licenses", 3, 0.9),
    ("waived", "cc0", "has waived all copyright and related or neighboring rights to", 3, 1.0),
    ("odbl", "odbl", "open database licen[cs]e odbl|made available under the open database licen[cs]e", 3, 1.0),
    ("database", "odbl", "any rights in individual contents of the database are licensed under the database contents licen[cs]e", 3, 1.0),
    ("dedication", "pddl", "public domain dedication and licen[cs]e", 3, 1.0),
    ("cdla", "cdla", "community data licen[cs]e agreement|cdla (?:permissive|sharing)", 3, 1.0),
    ("community", "cdla", "community data licen[cs]e agreement", 3, 1.0),
    ("government", "ogl", "contains public sector information licensed under the open government licen[cs]e", 3, 1.0),
    ("openrail", "rail", "openrail m licen[cs]e|creativeml openrail", 3, 1.0),
    ("responsible", "rail", "responsible ai licen[cs]e", 3, 1.0),
    ("llama", "llama", "llama(?: [0-9]+)?(?: [0-9]+)? community licen[cs]e(?: agreement)?", 3, 1.0),
    ("commons", "commons-clause", "commons clause licen[cs]e condition", 3, 1.0),
    ("sell", "commons-clause", "the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software", 3, 1.0),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e", 3, 1.0),
    ("prosperity", "prosperity", "the prosperity public licen[cs]e", 3, 1.0),
    ("parity", "parity", "the parity public licen[cs]e", 3, 1.0),
    ("confluent", "confluent", "confluent community licen[cs]e", 3, 1.0),
    ("timescale", "timescale", "timescale licen[cs]e agreement", 3, 1.0),
    ("redis", "rsal", "redis source available licen[cs]e", 3, 1.0),
]


@dataclass(frozen=True)
class Signature:
    number: int
    keyword: str
    label: str
    pattern: str
    priority: int
    score: float
    versioned: bool


def signatures() -> list[Signature]:
    """The ordered rules: every family in every form that has a name for it, then the notices."""
    made = []
    for k, label, name in FAMILIES:
        names = re.split(r"\|(?![^(]*\))", name)
        short = "|".join(n for n in names if not n.endswith((" license", " licen[cs]e")))
        bare = "|".join(n for n in names if n not in AMBIGUOUS)
        made += [(k, label, form.format(n=name, v=VERSION, s=short, b=bare), p, s, v) for form, p, s, v in FORMS if (short or "{s}" not in form) and (bare or "{b}" not in form)]
    made += [(*notice, False) for notice in NOTICES]
    return [Signature(i, k, label, f"(?<= )(?:{pattern})(?= )", p, s, v) for i, (k, label, pattern, p, s, v) in enumerate(made)]


def lowered(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` may touch other letters but never makes or breaks an ASCII word, save for two letters."""
    rare = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(rare, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


RULE_MAP = "map<string,array<struct<number:int,label:string,pattern:string,priority:int,score:double,versioned:boolean>>>"
HITS = "array<struct<start:int,end:int,priority:int,number:int,label:string,score:double>>"
MARK = "\x01"  # no word holds it


def _rule_map(rules: list[Signature]) -> Column:
    """Keyword to its rules, as a constant."""
    held: dict[str, list[dict]] = {}
    for r in rules:
        held.setdefault(r.keyword, []).append({k: v for k, v in vars(r).items() if k != "keyword"})
    return F.from_json(F.lit(json.dumps(held)), RULE_MAP)


def _places(words: Column, keywords: list[str]) -> Column:
    """Each keyword of the text with the places where it stands."""
    found = F.filter(F.transform(words, lambda x, i: F.when(x.isin(keywords), F.struct(x.alias("k"), i.alias("i")))), lambda p: p.isNotNull())
    each = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda p: p["k"])), lambda k: F.struct(k.alias("keyword"), F.transform(F.filter(all_, lambda p: p["k"] == k), lambda p: p["i"]).alias("own")))
    return F.element_at(F.transform(F.array(found), each), 1)


def _windows(words: Column, places: Column) -> Column:
    """Stretches of ``REACH`` words on either side of a keyword's places, one where they meet; a signature that holds it lies within."""

    def of(p: Column) -> Column:
        own, gap = p["own"], 2 * REACH
        first = F.filter(own, lambda x, i: (i == 0) | (x - F.get(own, i - 1) > gap))
        last = F.filter(own, lambda x, i: (i == F.size(own) - 1) | (F.get(own, i + 1) - x > gap))
        cut = lambda a, b: F.concat(F.lit(" "), F.array_join(F.slice(words, a + 1, b - a + REACH + 1), " "), F.lit(" "))
        stretch = lambda a, b: F.struct(p["keyword"].alias("keyword"), a.alias("at"), cut(a, b).alias("s"))
        return F.zip_with(F.transform(first, lambda a: F.greatest(a - REACH, F.lit(0))), last, stretch)

    return F.flatten(F.transform(places, of))


def _hits(window: Column, rule: Column) -> Column:
    """Each match of a rule: start, negative end, negative priority, number, label, score (positions in words)."""
    found = F.regexp_extract_all(window["s"], rule["pattern"], F.lit(0))
    marked = F.split(F.regexp_replace(window["s"], rule["pattern"], F.lit(MARK + "$0")), F.lit(" "))
    starts = F.filter(F.transform(marked, lambda x, i: F.when(F.startswith(x, F.lit(MARK)), i - 1)), lambda i: i.isNotNull())

    def hit(m: Column, i: Column) -> Column:
        at = window["at"] + i
        number = F.regexp_extract(m, r" (?:version |v ?)?([0-9]+)(?: [0-9]+)?$", 1)
        minor = F.regexp_extract(m, r" [0-9]+ ([0-9]+)$", 1)
        version = F.when(number == "", "").when(minor == "", F.concat(F.lit("-"), number)).otherwise(F.concat(F.lit("-"), number, F.lit("."), minor))
        label = F.when(rule["versioned"], F.concat(rule["label"], version)).otherwise(rule["label"])
        return F.struct(at.alias("start"), (-(at + spaces(m) + 1)).alias("end"), (-rule["priority"]).alias("priority"), rule["number"].alias("number"), label.alias("label"), rule["score"].alias("score"))

    return F.when(F.size(found) > 0, F.zip_with(found, starts, hit)).otherwise(F.array().cast(HITS))


def _surviving(hits: Column, levels: int) -> Column:
    """Labels and best score of the hits that no earlier hit of equal or higher priority contains (ends are negative)."""
    state = F.struct(F.array(*[F.lit(0)] * levels).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(s: Column, h: Column) -> Column:
        inside = F.exists(F.slice(s["ends"], -h["priority"], levels), lambda e: e <= h["end"])
        ends = F.transform(s["ends"], lambda e, i: F.when(i + 1 == -h["priority"], F.least(e, h["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, s["labels"]).otherwise(F.array_union(s["labels"], F.array(h["label"]))).alias("labels"), F.when(inside, s["score"]).otherwise(F.greatest(s["score"], h["score"])).alias("score"))

    return F.aggregate(F.array_sort(hits), state, step)


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rules = signatures() if rules is None else rules
    keywords = sorted({r.keyword for r in rules})
    text = lowered(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    spaced = F.trim(F.regexp_replace(text, SEPARATORS, " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(" "), spaced, F.lit(" ")).alias("spaced"))
    w = F.col("spaced")
    rows = rows.select("doc_id", "spaced", F.when(w == "  ", F.array().cast("array<string>")).otherwise(F.split(F.trim(w), F.lit(" "))).alias("words"))
    rows = rows.select(
        "doc_id",
        "spaced",
        F.size("words").cast("long").alias("n_words"),
        "words",
        F.when(F.arrays_overlap("words", F.lit(keywords)), _places(F.col("words"), keywords)).alias("places"),
        *[F.when(F.contains(w, F.lit(f" {p} ")), F.split(w, F.lit(f"(?<= ){p}(?= )"), -1)).alias(f"cut{i}") for i, p in enumerate(BASE)],
    )
    base = []
    for i, (phrase, label) in enumerate(BASE.items()):
        pieces = F.col(f"cut{i}")
        last = F.substring(w, F.lit(1), F.length(w) - F.length(F.element_at(pieces, -1)) - len(phrase))
        base.append(F.when(pieces.isNotNull(), F.struct((F.size(pieces) - 1).alias("n"), (spaces(F.element_at(pieces, 1)) - 1).alias("first"), (spaces(last) - 1).alias("last"), F.lit(label).alias("label"))))
    rows = rows.select("doc_id", "n_words", F.filter(F.array(*base), lambda b: b.isNotNull()).alias("base"), F.when(F.size("places") > 0, _windows(F.col("words"), F.col("places"))).alias("windows"))
    by_keyword = _rule_map(rules)
    hits = F.flatten(F.flatten(F.transform("windows", lambda x: F.transform(F.element_at(by_keyword, x["keyword"]), lambda r: _hits(x, r)))))
    rows = rows.select("doc_id", "n_words", "base", F.when(F.size("windows") > 0, hits).alias("hits"))
    kept = F.when(F.size("hits") > 0, _surviving(F.col("hits"), max((r.priority for r in rules), default=1)))
    rows = rows.select("doc_id", "n_words", "base", kept.alias("kept"))
    named = F.transform("base", lambda b: b["label"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).cast("long").alias("last_word"),
        join(named).alias("base_labels"),
        join(F.concat(named, F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce(F.col("kept.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
