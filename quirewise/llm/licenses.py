"""License scans by ordered signature rules.

A text becomes its words: lower-case ASCII letters and digits and anything
beyond ASCII, joined by one blank.  A rule is a label, a keyword and a regular
expression over those words; it runs only on texts where words begin as its
keyword does.
Rules are ordered by priority: exact identifiers, named versions, grants, names,
sentences of the licenses' own texts, then general notices.  Of the detections those of higher priority stand first, and a
detection within the interval of one that stands is suppressed.

Rows: a null text counts as empty, with no labels and score 0; repeated rows are
scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, text_or_empty

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Fixed phrases, each place of which counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keyword, name, versions: a license by its name, with the versions that exist.
NAMED = (
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1 0|3|3 0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "2 1|3|3 0"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e", "2|2 0"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "1|1 0|2|2 0|3|3 0"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", "1 1|1 2|1 3"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", "1 0|1 1|2|2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "1 0|1 1|2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "1 0|2 0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", "1 0"),
    ("eupl", "european", r"european union public licen[cs]e", "1 0|1 1|1 2"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "1 0|1 1"),
    ("cpl", "common public", r"common public licen[cs]e", "0 5|1 0"),
    ("ipl", "ibm public", r"ibm public licen[cs]e", "1 0"),
    ("cpal", "attribution", r"common public attribution licen[cs]e", "1 0"),
    ("afl", "academic", r"academic free licen[cs]e", "1 1|1 2|2 0|2 1|3 0"),
    ("osl", "open software", r"open software licen[cs]e", "1 0|1 1|2 0|2 1|3 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", "1 0|2 0"),
    ("bsl", "boost", r"boost software licen[cs]e", "1 0"),
    ("busl", "business source", r"business source licen[cs]e", "1 0|1 1"),
    ("sspl", "server side", r"server side public licen[cs]e", "1|1 0"),
    ("elastic", "elastic", r"elastic licen[cs]e", "1 0|2 0"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1 0|1 1"),
    ("lppl", "latex", r"latex project public licen[cs]e", "1 0|1 1|1 2|1 3a|1 3c"),
    ("psf", "python", r"python(?: software foundation)? licen[cs]e", "2|2 0"),
    ("php", "php licen", r"php licen[cs]e", "3 0|3 01"),
    ("zope", "zope", r"zope public licen[cs]e", "1 1|2 0|2 1"),
    ("openldap", "openldap", r"openldap public licen[cs]e", "2 0 1|2 8"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ""),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e", ""),
    ("isc", "isc licen", r"(?:the )?isc licen[cs]e", ""),
    ("x11", "x11 licen", r"x11 licen[cs]e", ""),
    ("bsd-4-clause", "bsd", r"(?:4 clause bsd|bsd 4 clause|original bsd)(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd)(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "bsd", r"(?:2 clause bsd|bsd 2 clause|simplified bsd)(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "freebsd", r"freebsd(?: documentation)? licen[cs]e", ""),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", ""),
    ("0bsd", "0bsd", r"0bsd", ""),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", ""),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ""),
    ("libpng", "libpng", r"libpng licen[cs]e", "2 0"),
    ("openssl", "openssl", r"openssl licen[cs]e", ""),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ""),
    ("ruby", "ruby licen", r"ruby licen[cs]e", ""),
    ("vim", "vim licen", r"vim licen[cs]e", ""),
    ("curl", "curl licen", r"curl licen[cs]e", ""),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", ""),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1|2"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public licen[cs]e", "2"),
    ("cecill", "cecill", r"cecill(?: free software licen[cs]e(?: agreement)?)?", "1 0|1 1|2 0|2 1|b|c"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1 0"),
    ("qpl", "q public", r"q public licen[cs]e", "1 0"),
    ("nposl", "non profit", r"non profit open software licen[cs]e", "3 0"),
    ("odbl", "open database", r"open(?: data commons)? ?(?:open )?database licen[cs]e", "1 0"),
    ("odc-by", "commons attribution", r"open data commons attribution licen[cs]e", "1 0"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", "1 0"),
    ("ogl", "open government", r"open government licen[cs]e", "1 0|2 0|3 0"),
    ("etalab", "licence ouverte", r"licence ouverte", "1 0|2 0"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland", "2 0"),
    ("openrail", "openrail", r"openrail(?: m)?(?: licen[cs]e)?", ""),
    ("openrail", "open rail", r"open rail(?: m)?(?: licen[cs]e)?", ""),
    ("llama", "llama", r"llama(?: \d)? community licen[cs]e", ""),
)

#: label, identifier in words: short identifiers whose versions follow.
IDENTIFIED = (
    ("agpl", "agpl", "1 0|3 0"),
    ("lgpl", "lgpl", "2 0|2 1|3 0"),
    ("gpl", "gpl", "1 0|2 0|3 0"),
    ("gfdl", "gfdl", "1 1|1 2|1 3"),
    ("apache", "apache", "1 0|1 1|2 0"),
    ("mpl", "mpl", "1 0|1 1|2 0"),
    ("epl", "epl", "1 0|2 0"),
    ("eupl", "eupl", "1 0|1 1|1 2"),
    ("cddl", "cddl", "1 0|1 1"),
    ("afl", "afl", "1 1|2 0|2 1|3 0"),
    ("osl", "osl", "1 0|2 0|2 1|3 0"),
    ("bsl", "bsl", "1 0"),
    ("busl", "busl", "1 1"),
    ("ofl", "ofl", "1 0|1 1"),
    ("lppl", "lppl", "1 0|1 1|1 2|1 3a|1 3c"),
    ("odbl", "odbl", "1 0"),
    ("cc0", "cc0", "1 0"),
)

#: Creative Commons elements in short and in full, and the versions.
COMMONS = (
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by", "by", "attribution"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label, keyword, expression: sentences of permissive licenses' own texts.
PERMISSIVE = (
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "mit no", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "disclaims all", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "copyright holders and", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote"),
    ("bsd-3-clause-clear", "no express or implied", r"no express or implied licen[cs]es to any party s patent rights are granted"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-protection", "bsd protection", r"bsd protection licen[cs]e"),
    ("apache", "apache", r"apache org licenses license 2 0"),
    ("apache-2.0", "terms and conditions for", r"terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "unless required by", r"unless required by applicable law or agreed to in writing software"),
    ("apache-2.0", "you may not use", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-1.1", "end user documentation", r"the end user documentation included with the redistribution"),
    ("apache", "apache software foundation", r"licen[cs]ed to the apache software foundation(?: asf)? under one or more contributor"),
    ("zlib", "express or implied", r"provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost org", r"boost org license 1 0 txt"),
    ("bsl-1.0", "machine executable", r"machine executable object code generated by a source language processor"),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do", r"you just do what the fuck you want to"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained"),
    ("libtiff", "silicon graphics", r"the names of sam leffler and silicon graphics may not be used"),
    ("libpng", "png reference", r"the png reference library is supplied as is"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"(?:the )?freetype project licen[cs]e"),
    ("freetype", "portions of this software", r"portions of this software are copyright (?:c )?(?:\S+ ){0,4}the freetype project"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("bsd-original-uc", "university of california", r"the regents of the university of california all rights reserved"),
    ("bsd-original-uc", "berkeley", r"developed by the university of california berkeley and its contributors"),
    ("cmu-mach", "carnegie mellon", r"carnegie mellon requests users of this software to return"),
    ("mit-cmu", "the name of cmu", r"the name of cmu(?: and \S+)? not be used in advertising"),
    ("ntp", "no representations", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("tcl", "the authors hereby", r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software"),
    ("python", "psf is making", r"psf is making python available to licen[cs]ee on an as is basis"),
    ("python", "beopen", r"beopen python open source licen[cs]e agreement"),
    ("php", "php software", r"this product includes php software freely available from"),
    ("vim", "you can distribute", r"you can distribute copies of (?:\S+ )?vim without restriction"),
    ("curl", "daniel stenberg", r"copyright (?:c )?(?:\S+ ){1,4}daniel stenberg"),
    ("sqlite-blessing", "may you do good", r"may you do good and not evil"),
    ("sqlite-blessing", "may you find", r"may you find forgiveness for yourself and forgive others"),
    ("json", "used for good", r"the software shall be used for good not evil"),
    ("unicode", "unicode", r"unicode inc licen[cs]e agreement data files and software"),
    ("unicode", "unicode", r"unicode licen[cs]e v ?3"),
    ("icu", "icu licen", r"icu licen[cs]e(?: icu 1 8 1 and later)?"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and document)?(?: notice and)? licen[cs]e"),
    ("naist", "nara institute", r"nara institute of science and technology"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("mulan-psl", "mulan", r"mulan p(?:ermissive|sl)(?: software licen[cs]e)?(?: v ?[12])?"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: version)? 2 0"),
    ("ms-pl", "bring a patent claim", r"if you bring a patent claim against any contributor over patents that you claim"),
    ("upl-1.0", "lrgrwrks", r"any piece of software and or hardware listed in the lrgrwrks txt"),
    ("artistic-2.0", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed preamble this licen[cs]e establishes"),
    ("artistic-1.0", "artistic control", r"some semblance of artistic control over the development of the package"),
    ("zpl", "zope", r"names of the copyright holders must not be used to endorse or promote products derived from this software without prior written permission from zope"),
)

#: The same, of licenses that ask for the same terms again.
COPYLEFT = (
    ("gpl-or-later", "later version", r"either version \d(?: \d)? of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl", "redistribute it", r"free software you can redistribute it and or modify it under the terms"),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-2.0", "59 temple", r"59 temple place suite 330 boston ma"),
    ("gpl-2.0", "51 franklin", r"51 franklin st(?:reet)? fifth floor boston ma"),
    ("gpl", "gnu org", r"(?:www )?gnu org licenses gpl(?: \d 0)?(?: html| txt)?"),
    ("lgpl", "gnu org", r"(?:www )?gnu org licenses lgpl(?: \d [01])?(?: html| txt)?"),
    ("agpl", "gnu org", r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-3.0", "convey verbatim", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "anti circumvention", r"protecting users legal rights from anti circumvention law"),
    ("gpl-2.0", "activities other than", r"activities other than copying distribution and modification are not covered by this licen[cs]e"),
    ("agpl-3.0", "remote network", r"remote network interaction use with the gnu general public licen[cs]e"),
    ("lgpl-2.1", "work that uses", r"work that uses the library"),
    ("lgpl-3.0", "combined work", r"you may convey a combined work under terms of your choice"),
    ("gpl-classpath-exception", "classpath", r"(?:with(?: the)? )?classpath exception"),
    ("gpl-classpath-exception", "independent modules", r"link this library with independent modules to produce an executable"),
    ("gpl-bison-exception", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gcc-runtime-exception", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-font-exception", "font exception", r"(?:with(?: the)? )?font exception"),
    ("linux-syscall-note", "user programs", r"this copyright does not cover user programs that use kernel services"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licen[cs]es"),
    ("npl", "netscape public", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public"),
    ("epl-2.0", "secondary licen", r"this source code may also be made available under the following secondary licen[cs]es"),
    ("cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution"),
    ("cpl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the common public"),
    ("osl", "licensed under the open", r"licen[cs]ed under the open software licen[cs]e version \d 0"),
    ("afl", "licensed under the academic", r"licen[cs]ed under the academic free licen[cs]e version \d [01]"),
    ("eupl", "licensed under the eupl", r"licen[cs]ed under the eupl(?: version)?(?: 1 [0-2])?"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? licen[cs]e under french law"),
    ("sleepycat", "redistributions in any form", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sspl", "make the functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e(?: version)?(?: 1 [15])?"),
    ("nasa", "nasa open source", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("apsl", "apple public", r"apple public source licen[cs]e(?: version)?(?: [12] [0-2])?"),
    ("rpsl", "realnetworks public", r"realnetworks public source licen[cs]e"),
    ("spl", "sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    ("nokia", "nokia open", r"nokia open source licen[cs]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[cs]e"),
    ("simpl", "simple public", r"simple public licen[cs]e(?: 2 0)?"),
    ("watcom", "sybase open", r"sybase open watcom public licen[cs]e"),
    ("oclc", "oclc research", r"oclc research public licen[cs]e"),
    ("cua-opl", "cua office", r"cua office public licen[cs]e"),
    ("ricoh", "ricoh source", r"ricoh source code public licen[cs]e"),
    ("lpl", "lucent public", r"lucent public licen[cs]e(?: version)?(?: 1 0\d?)?"),
    ("parity", "parity public", r"(?:the )?parity public licen[cs]e(?: \d 0 0)?"),
    ("copyleft-next", "copyleft next", r"copyleft next(?: 0 3 [01])?"),
)

#: The same, of licenses of data, media, models and fonts, and of those that restrict use.
OTHER_TERMS = (
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("public-domain", "public domain", r"this (?:work|file|software|document|program) is in the public domain"),
    ("public-domain", "public domain mark", r"public domain mark(?: 1 0)?"),
    ("us-government", "united states government", r"works? of the united states government"),
    ("cc0", "cc0", r"cc0(?: universal)?"),
    ("cc0", "cc zero", r"cc zero"),
    ("cc0", "to the extent", r"to the extent possible under law (?:\S+ ){1,8}waived all copyright and related or neighboring rights"),
    ("cc", "creativecommons org", r"creativecommons org licenses \S+ \d \d"),
    ("cc", "some rights", r"some rights reserved creative commons"),
    ("cc-devnations", "developing nations", r"creative commons developing nations licen[cs]e"),
    ("cc-sampling", "sampling plus", r"creative commons sampling plus(?: 1 0)?"),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org", r"opendatacommons org licenses by"),
    ("pddl", "opendatacommons org", r"opendatacommons org licenses pddl"),
    ("cdla-permissive", "community data", r"community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", "community data", r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl", "contains public sector", r"contains public sector information licen[cs]ed under the open government licen[cs]e"),
    ("open-parliament", "open parliament", r"open parliament licen[cs]e(?: v ?\d 0)?"),
    ("norwegian-licence", "norwegian", r"norwegian licen[cs]e for open government data"),
    ("iodl", "italian open", r"italian open data licen[cs]e(?: v?[12] 0)?"),
    ("etalab", "licence ouverte", r"licence ouverte open licence"),
    ("free-art", "licence art libre", r"licence art libre(?: 1 [123])?"),
    ("free-art", "free art", r"free art licen[cs]e(?: 1 [123])?"),
    ("design-science", "design science", r"design science licen[cs]e"),
    ("open-publication", "open publication", r"open publication licen[cs]e(?: v ?\d 0)?"),
    ("open-content", "open content", r"open ?content licen[cs]e(?: opl)?"),
    ("cdl", "common documentation", r"common documentation licen[cs]e"),
    ("ofl", "reserved font name", r"with reserved font names? \S+"),
    ("ofl", "scripts sil", r"scripts sil org ofl"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: 1 0)?"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera(?: fonts)?(?: is a trademark| copyright| licen[cs]e)"),
    ("arphic", "arphic public", r"arphic public licen[cs]e"),
    ("ipa-font", "ipa font", r"ipa font licen[cs]e(?: agreement)?(?: v ?1 0)?"),
    ("cern-ohl", "cern open", r"cern open hardware licen[cs]e(?: version)?(?: [12](?: \d)?)?"),
    ("tapr-ohl", "tapr open", r"tapr open hardware licen[cs]e"),
    ("solderpad", "solderpad", r"solderpad hardware licen[cs]e"),
    ("openmdw", "openmdw", r"openmdw(?: licen[cs]e)?(?: agreement)?"),
    ("openrail", "responsible ai", r"responsible ai (?:source code |end user )?licen[cs]e"),
    ("openrail", "use based restrictions", r"use based restrictions as (?:referenced|set forth) in paragraph"),
    ("llama", "llama", r"meta llama \d(?: \d)? is licen[cs]ed under"),
    ("gemma", "gemma terms", r"gemma terms of use"),
    ("research-only", "research purposes", r"for (?:non commercial )?research purposes only"),
    ("research-only", "academic use", r"for academic use only"),
    ("non-commercial", "non commercial", r"(?:for )?non commercial use only"),
    ("non-commercial", "for personal", r"for personal(?: and)? non commercial use"),
    ("non-commercial", "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?"),
    ("polyform", "polyform", r"polyform (?:small business|strict|shield|perimeter|free trial|internal use) licen[cs]e"),
    ("busl", "change date", r"(?:effective )?on the change date the licensor hereby grants you rights under the terms of the change licen[cs]e"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?(?: v ?1 0)?"),
    ("fair-source", "fair source", r"fair source licen[cs]e"),
    ("functional-source", "functional source", r"functional source licen[cs]e(?: 1 [01])?"),
    ("confluent", "confluent community", r"confluent community licen[cs]e"),
    ("timescale", "timescale", r"timescale licen[cs]e(?: agreement)?"),
    ("redis-source", "redis source", r"redis source available licen[cs]e"),
    ("anti-996", "anti 996", r"anti 996 licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e(?: \d \d)?"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "proprietary", r"proprietary licen[cs]e"),
    ("proprietary", "trade secret", r"contains (?:\S+ ){0,4}trade secrets?"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)"),
    ("proprietary", "no part of", r"no part of this (?:publication|book|document|work|website) may be reproduced"),
    ("proprietary", "prior written", r"without(?: the)? prior written (?:permission|consent) of the (?:publisher|copyright (?:owner|holder)|author)"),
    ("proprietary", "rewritten or redistributed", r"may not be published broadcast rewritten or redistributed"),
    ("eula", "end user licen", r"end user licen[cs]e agreement"),
    ("eula", "by installing", r"by installing (?:or using )?(?:the|this) software you agree"),
)

#: The same, of notices that name no license.
NOTICES = (
    ("warranty-disclaimer", "without warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("warranty-disclaimer", "implied warranties", r"implied warranties of merchantability(?: and| or)?(?: fitness for a particular purpose)?"),
    ("warranty-disclaimer", "without even", r"without even the implied warranty of merchantability"),
    ("warranty-disclaimer", "at your own", r"use (?:it )?at your own risk"),
    ("liability-disclaimer", "in no event", r"in no event shall (?:\S+ ){1,10}be liable for any"),
    ("reserved", "rights", r"(?:all|some|no) rights reserved"),
    ("reserved", "rechte", r"alle rechte vorbehalten"),
    ("reserved", "droits", r"tous droits r\S*serv\S*"),
    ("reserved", "derechos", r"todos los derechos reservados"),
    ("reserved", "diritti", r"tutti i diritti riservati"),
    ("reserved", "direitos", r"todos os direitos reservados"),
    ("reserved", "rechten", r"alle rechten voorbehouden"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", "spdx filecopyrighttext", r"spdx filecopyrighttext"),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|by)"),
    ("licensed", "licen", r"(?:is |are )?licen[cs]ed under(?: the)?(?: terms of(?: the)?)?"),
    ("licensed", "dual licen", r"dual licen[cs]ed"),
    ("licensed", "lizenz", r"lizenziert unter(?: der)?"),
    ("licensed", "sous licen", r"sous licen[cs]e"),
    ("licensed", "bajo", r"bajo(?: una| la)? licencia"),
    ("license-notice", "licen", r"(?:see|read) the licen[cs]e(?: file)?"),
    ("license-notice", "found in the", r"licen[cs]e that can be found in the licen[cs]e file"),
    ("license-notice", "obtain a copy", r"you may obtain a copy of the licen[cs]e at"),
    ("spdx", "spdx", r"spdx licen[cs]e identifier"),
    ("trademark", "registered trademark", r"(?:is a|are) registered trademarks? of"),
)


@dataclass(frozen=True)
class Rule:
    """A signature; rules come in order of priority."""

    label: str
    keyword: str
    pattern: re.Pattern[str]


def _version(words: str) -> str:
    return words.replace(" ", ".")


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: identifiers, named versions, grants, plain names, wordings."""
    made: list[tuple[str, str, str]] = []
    version = r"(?: ?,? ?(?:version|v|ver))?"
    for label, name, versions in IDENTIFIED:
        for v in versions.split("|"):
            for tail, mark in (("or later", "-or-later"), ("only", "-only"), ("", "")):
                body = rf"(?:spdx licen[cs]e identifier )?{name} ?v?{v}" + (f" {tail}" if tail else "")
                made.append((f"{label}-{_version(v)}{mark}", name, body))
    for label, short, full in COMMONS:
        for v in COMMONS_VERSIONS:
            made.append((f"cc-{label}-{_version(v)}", "cc by", rf"cc {short} {v}"))
            made.append((f"cc-{label}-{_version(v)}", "creative commons", rf"creative commons {full}(?: \S+){{0,4}} {v}"))
    for label, keyword, name, versions in NAMED:
        for v in filter(None, versions.split("|")):
            made.append((f"{label}-{_version(v)}-or-later", keyword, rf"(?:{name}){version} {v} or(?: any)? later(?: version)?"))
        for v in sorted(filter(None, versions.split("|")), key=len, reverse=True):
            made.append((f"{label}-{_version(v)}", keyword, rf"(?:{name}){version} {v}"))
    for label, keyword, name, _ in NAMED:
        made.append((label, keyword, rf"(?:licen[cs]ed|released|distributed|available|published) under(?: the)?(?: terms of(?: the)?)? (?:{name})"))
    for label, short, full in COMMONS:
        made.append((f"cc-{label}", "cc by", rf"cc {short}"))
        made.append((f"cc-{label}", "creative commons", rf"creative commons {full}"))
    for label, keyword, name, _ in NAMED:
        made.append((label, keyword, rf"(?:{name})"))
    made += PERMISSIVE + COPYLEFT + OTHER_TERMS + NOTICES
    return tuple(Rule(label, keyword, re.compile(rf"(?<!\S)(?:{body})(?!\S)")) for label, keyword, body in made)


@functools.lru_cache(maxsize=1)
def by_keyword() -> tuple[tuple[str, tuple[int, ...]], ...]:
    """The rules' numbers under each keyword."""
    grouped: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        grouped.setdefault(rule.keyword, []).append(i)
    return tuple((k, tuple(v)) for k, v in grouped.items())


def normal_words(raw: bytes) -> str:
    """The words of a UTF-8 text, joined by one blank."""
    return b" ".join(raw.translate(_WORD_BYTES).split(b" ")).decode("utf-8", "replace")


Detection = tuple[str, int, int]


def detect(words: str) -> list[Detection]:
    """Standing detections of a normalised text: label, first word, word after the last."""
    framed = f" {words}"
    due = sorted(i for keyword, numbers in by_keyword() if f" {keyword}" in framed for i in numbers)
    places = [(i, *m.span()) for i in due for m in rules()[i].pattern.finditer(words)]
    if not places:
        return []
    blanks = [m.start() for m in re.finditer(" ", words)]
    found = [(i, bisect_left(blanks, a), bisect_left(blanks, b) + 1) for i, a, b in places]
    standing: list[Detection] = []
    # The widest intervals that stand: both their starts and their ends ascend.
    starts, ends = [], []
    for i, first, end in sorted(found):
        at = bisect_right(starts, first)
        if at and ends[at - 1] >= end:
            continue
        standing.append((rules()[i].label, first, end))
        low, high = bisect_left(starts, first), bisect_right(ends, end)
        starts[low : max(low, high)], ends[low : max(low, high)] = [first], [end]
    return sorted(standing, key=lambda d: (d[1], d[2], d[0]))


def base_places(words: str) -> list[tuple[int, str]]:
    """Every place of a base phrase: its first word and its label."""
    found, framed = [], f" {words} "
    for phrase, label in BASE:
        word, counted, at = 0, 0, framed.find(f" {phrase} ")
        while at >= 0:
            word, counted = word + framed.count(" ", counted, at), at
            found.append((word, label))
            at = framed.find(f" {phrase} ", at + 1)
    return sorted(found)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_words, base, detections`` of every row.

    ``base`` holds the places of base phrases (word, label), ``detections`` the
    standing ones of the rules (label, first_word, end_word).
    """
    kind = docs.schema[key].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, base, found = [], [], []
        for raw in batch.column(1).to_pylist():
            parts = raw.translate(_WORD_BYTES).split()
            sizes.append(len(parts))
            words = b" ".join(parts).decode("utf-8", "replace")
            base.append([{"word": w, "label": x} for w, x in base_places(words)])
            found.append([{"label": x, "first_word": a, "end_word": b} for x, a, b in detect(words)])
        columns = [pa.array(sizes, pa.int64()), pa.array(base, place), pa.array(found, span)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_words", "base", "detections"])

    schema = (
        f"`{key}` {kind}, n_words bigint, base array<struct<word: bigint, label: string>>, "
        "detections array<struct<label: string, first_word: bigint, end_word: bigint>>"
    )
    return map_batches(docs.select(key, text_or_empty().cast("binary").alias("_raw")), per_batch, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of the whole documents table.

    The score is one less half for each distinct label: 0 without any, near 1 with many.
    """
    found = scan(read(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x.label)))
    labels = F.array_sort(F.array_union(base, F.transform("detections", lambda x: x.label)))
    words = F.transform("base", lambda x: x.word)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.size(labels))).alias("score"),
    )
