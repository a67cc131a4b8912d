"""Hand-written signatures of license texts, as regular expressions over a text's words joined by blanks.

A line is one rule: the more telling the passage, the higher its priority. Words are lower-case runs of letters and digits,
so "and/or" is `and or` and "2.0" is `2 0`. `W` stands for one word.
"""

from __future__ import annotations

# Label -> signatures of priority 3 (passages of the text or of the notice that grants it).
SIGNATURES = {
    "mit": r"""
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
the above copyright notice and this permission notice shall be included in all copies or substantial portions
the above copyright notice and this permission notice shall be included in all
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
in no event shall the authors or copyright holders be liable for any claim damages or other liability
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
except as contained in this notice the names? of (?:the )?(?:W ){1,6}shall not be used in advertising or otherwise to promote the sale
distributed under the (?:terms of the )?mit(?: x11)? licen[cs]e
(?:see|found in) the (?:included )?(?:file )?licen[cs]e mit
""",
    "mit-0": r"""
mit no attribution
permission is hereby granted free of charge to any person obtaining a copy of this software (?:W ){0,30}without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
""",
    "isc": r"""
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
permission to use copy modify and or distribute this software for any purpose
the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall the author be liable for any special direct indirect or consequential damages
loss of use data or profits whether in an action of contract negligence or other tortious action
""",
    "0bsd": r"""
bsd zero clause licen[cs]e
zero clause bsd licen[cs]e
free public licen[cs]e 1 0 0
""",
    "bsd": r"""
redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
redistributions of source code must retain the (?:above )?copyright notice
redistributions in binary form must reproduce the (?:above )?copyright notice
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
neither the names? of (?:W ){1,12}nor the names of (?:its|his|any|the|their) contributors may be used to endorse or promote
neither the name of (?:W ){1,12}nor the names of its contributors may be used
this software is provided by (?:the )?(?:W ){1,8}as is and any express or implied warranties
all advertising materials mentioning features or use of this software must display the following acknowledge?ment
in no event shall (?:the )?(?:W ){1,8}be liable for any direct indirect incidental special exemplary or consequential damages
this product includes software developed by (?:the )?university of california
use of this source code is governed by a bsd style licen[cs]e
licen[cs]ed under the (?:new |modified |simplified |revised )?bsd
(?:two|three|four|2|3|4) clause bsd licen[cs]e
bsd (?:2|3|4) clause(?: W)? licen[cs]e
neither the views and conclusions contained in the software and documentation are those of the authors
the views and conclusions contained in the software and documentation are those of the authors
""",
    "apache": r"""
licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
licen[cs]ed under the apache licen[cs]e(?: version 2 0)?(?: the licen[cs]e)?(?: you may not use this file)?
you may obtain a copy of the licen[cs]e at https? www apache org licenses licen[cs]e 2 0
unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements
the asf licenses this file to you under the apache licen[cs]e
each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
you must cause any modified files to carry prominent notices stating that you changed the files
this product includes software developed by the apache software foundation
http www apache org licenses(?: licen[cs]e 2 0)?
""",
    "gpl": r"""
you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation
you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
under the terms of the gnu general public licen[cs]e(?: version [123](?: 0)?)?
you should have received a copy of the gnu general public licen[cs]e along with this
see the gnu general public licen[cs]e for more details
the licenses for most software are designed to take away your freedom to share and change it
the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gnu general public licen[cs]e is intended to guarantee your freedom to share and change
everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
either version [123](?: 0)? of the licen[cs]e or at your option any later version
if your program incorporates a subroutine library you may consider it more useful to permit linking proprietary applications
this program comes with absolutely no warranty
covered by the gnu general public licen[cs]e
gpl v?[23](?: 0)? (?:or later|only|compatible)
released under (?:the )?gpl(?: v?[23](?: 0)?)?
as a special exception (?:W ){1,20}gives? you (?:unlimited )?permission to (?:copy distribute|link)
""",
    "lgpl": r"""
you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation
you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
see the gnu (?:lesser|library) general public licen[cs]e for more details
under the terms of the gnu (?:lesser|library) general public licen[cs]e
the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3
a program that contains no derivative of any portion of the library but is designed to work with the library
as the lesser general public licen[cs]e permits more lax criteria for linking
""",
    "agpl": r"""
you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
you should have received a copy of the gnu affero general public licen[cs]e
see the gnu affero general public licen[cs]e for more details
under the terms of the gnu affero general public licen[cs]e
specifically designed to ensure cooperation with the community in the case of network server software
remote network interaction use with the gnu general public licen[cs]e
""",
    "fdl": r"""
permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
with no invariant sections no front cover texts and no back cover texts
the purpose of this licen[cs]e is to make a manual textbook or other functional and useful document free
under the terms of the gnu free documentation licen[cs]e
""",
    "mpl": r"""
this source code form is subject to the terms of the mozilla public licen[cs]e
if a copy of the mpl was not distributed with this file you can obtain one at
the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]
this source code form is incompatible with secondary licenses
under the terms of the mozilla public licen[cs]e
the initial developer of the original code is
alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e
http mozilla org mpl 2 0
""",
    "epl": r"""
this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
the accompanying program is provided under the terms of this eclipse public licen[cs]e
any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
this source code may also be made available under the following secondary licenses
http www eclipse org legal epl(?: v10| 2 0| v20)?
""",
    "edl": r"""
eclipse distribution licen[cs]e(?: v(?:ersion)? ?1 0)?
""",
    "cpl": r"""
the accompanying program is provided under the terms of this common public licen[cs]e
made available under the terms of the common public licen[cs]e
""",
    "cddl": r"""
the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl header start
you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e
""",
    "eupl": r"""
licen[cs]ed under the eupl(?: version 1 [012])?
european union public licen[cs]e v ?1 [012]
european union public licence as published by the european commission
""",
    "cc-by": r"""
this work is licen[cs]ed under (?:a|the) creative commons attribution (?:[1234] [05] )?(?:international|unported|generic)? ?licen[cs]e
creative commons attribution [1234] [05] (?:international|unported|generic)
(?:https? )?creativecommons org licenses by [1234] [05]
you are free to share copy and redistribute the material in any medium or format
you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
""",
    "cc-by-sa": r"""
creative commons attribution share ?alike [1234] [05] (?:international|unported|generic)
licen[cs]ed under (?:a|the) creative commons attribution share ?alike
(?:https? )?creativecommons org licenses by sa [1234] [05]
if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
text is available under the creative commons attribution share ?alike licen[cs]e
""",
    "cc-by-nc": r"""
creative commons attribution non ?commercial [1234] [05] (?:international|unported|generic)
licen[cs]ed under (?:a|the) creative commons attribution non ?commercial
(?:https? )?creativecommons org licenses by nc [1234] [05]
you may not use the material for commercial purposes
""",
    "cc-by-nd": r"""
creative commons attribution no ?derivatives [1234] [05] (?:international|unported|generic)
(?:https? )?creativecommons org licenses by nd [1234] [05]
if you remix transform or build upon the material you may not distribute the modified material
""",
    "cc-by-nc-sa": r"""
creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
(?:https? )?creativecommons org licenses by nc sa [1234] [05]
cc by nc sa(?: [1234] [05])?
""",
    "cc-by-nc-nd": r"""
creative commons attribution non ?commercial no ?derivatives(?: [1234] [05])?
(?:https? )?creativecommons org licenses by nc nd [1234] [05]
cc by nc nd(?: [1234] [05])?
""",
    "cc0": r"""
(?:https? )?creativecommons org publicdomain zero 1 0
to the extent possible under law (?:W ){1,10}(?:has|have) waived all copyright and related or neighboring rights
the person who associated a work with this deed has dedicated the work to the public domain
cc0 1 0 universal
creative commons zero v1 0 universal
""",
    "public-domain": r"""
(?:released|placed|dedicated) (?:in)?to the public domain
this (?:file|work|software|code) is in the public domain
(?:is|are) hereby (?:placed|released) (?:in|into|to) the public domain
(?:https? )?creativecommons org publicdomain mark 1 0
no copyright is claimed in the united states
the author disclaims copyright to this source code
""",
    "blessing": r"""
in place of a legal notice here is a blessing
may you do good and not evil may you find forgiveness for yourself and forgive others
""",
    "unlicense": r"""
this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software
we make this dedication for the benefit of the public at large
for more information please refer to https? (?:www )?unlicense org
""",
    "wtfpl": r"""
do what the fuck you want to public licen[cs]e terms and conditions
everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed
you just do what the fuck you want to
""",
    "zlib": r"""
this software is provided as is without any express or implied warranty in no event will the authors be held liable
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
the origin of this software must not be misrepresented you must not claim that you wrote the original software
altered source versions must be plainly marked as such
this notice may not be removed or altered from any source distribution
""",
    "libpng": r"""
this code is released under the libpng licen[cs]e
the png reference library is supplied as is
libpng licen[cs]e(?: version 2)?
""",
    "bsl": r"""
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
permission is hereby granted free of charge to any person or organization obtaining a copy
distributed under the boost software licen[cs]e(?: version 1 0)?
see accompanying file licen[cs]e 1 0 txt
""",
    "busl": r"""
business source licen[cs]e(?: 1 1)?
the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
effective on the change date
""",
    "sspl": r"""
server side public licen[cs]e(?: v(?:ersion)? ?1)?
if you make the functionality of the program or a modified version available to third parties as a service
""",
    "elastic": r"""
elastic licen[cs]e(?: v(?:ersion)? ?[12](?: 0)?)?
you may not provide the software to third parties as a hosted or managed service
""",
    "commons-clause": r"""
commons clause licen[cs]e condition v1 0
the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software
""",
    "polyform": r"""
polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e(?: 1 0 0)?
""",
    "artistic": r"""
the intent of this document is to state the conditions under which a package may be copied
under the same terms as perl itself
you may distribute this package under the terms of (?:either the gnu general public licen[cs]e or )?the artistic licen[cs]e
this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed
""",
    "psf": r"""
psf licen[cs]e agreement for python
python software foundation licen[cs]e version 2
psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e
cnri licen[cs]e agreement for python 1 6 1
beopen com licen[cs]e agreement for python 2 0
""",
    "php": r"""
this source file is subject to version [23] 0[01]? of the php licen[cs]e
this product includes php software freely available from
products derived from this software may not be called php
""",
    "ruby": r"""
you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)(?: W){0,8} or the conditions below
same (?:terms|licen[cs]e) as ruby(?: itself)?
""",
    "postgresql": r"""
permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
postgresql licen[cs]e
""",
    "openssl": r"""
this product includes software developed by the openssl project for use in the openssl toolkit
this product includes cryptographic software written by eric young
the names openssl toolkit and openssl project must not be used to endorse
openssl licen[cs]e
""",
    "curl": r"""
permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
curl licen[cs]e
""",
    "ntp": r"""
permission to use copy modify and distribute this software and its documentation for any purpose (?:with or without|without) fee is hereby granted
""",
    "hpnd": r"""
historical permission notice and disclaimer
suitability of this software for any purpose it is provided as is without express or implied warranty
""",
    "x11": r"""
x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings
x window system is a trademark of x consortium
mit x11 licen[cs]e
""",
    "ncsa": r"""
university of illinois open source licen[cs]e
to deal with the software without restriction including without limitation the rights to use
neither the names of (?:W ){1,20}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided
""",
    "llvm-exception": r"""
apache licen[cs]e v2 0 with llvm exceptions
llvm exceptions to the apache 2 0 licen[cs]e
""",
    "w3c": r"""
this work is being provided by the copyright holders under the following licen[cs]e
w3c software and document notice and licen[cs]e
permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
""",
    "ofl": r"""
this font software is licen[cs]ed under the sil open font licen[cs]e
the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects
neither the font software nor any of its individual components in original or modified versions may be sold by itself
""",
    "ms-pl": r"""
this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
microsoft public licen[cs]e ms pl
""",
    "ms-rl": r"""
microsoft reciprocal licen[cs]e ms rl
for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file
""",
    "odbl": r"""
this database is made available under the terms of the open database licen[cs]e
(?:https? )?opendatacommons org licenses odbl 1 0
any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e
openstreetmap contributors
""",
    "odc-by": r"""
open data commons attribution licen[cs]e
(?:https? )?opendatacommons org licenses by 1 0
""",
    "pddl": r"""
made available under the public domain dedication and licen[cs]e
(?:https? )?opendatacommons org licenses pddl 1 0
""",
    "cdla": r"""
community data licen[cs]e agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
cdla (?:permissive|sharing) [12] 0
""",
    "ogl": r"""
open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?
contains public sector information licen[cs]ed under the open government licen[cs]e
""",
    "etalab": r"""
licence ouverte(?: open licence)?(?: etalab)?
etalab open licen[cs]e
""",
    "dl-de": r"""
datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?
data licen[cs]e germany (?:attribution|zero)(?: version)?(?: 2 0)?
""",
    "openrail": r"""
(?:creativeml |bigscience |bigcode )?open rail m?(?: licen[cs]e)?
creativeml openrail m
bigscience (?:bloom )?rail (?:licen[cs]e )?(?:v)?1 0
you agree not to use the model or derivatives of the model
""",
    "llama": r"""
llama [23](?: [123])? community licen[cs]e agreement
built with (?:meta )?llama(?: [23])?
""",
    "gemma": r"""
gemma is provided under and subject to the gemma terms of use
gemma terms of use
""",
    "json": r"""
the software shall be used for good not evil
""",
    "beerware": r"""
as long as you retain this notice you can do whatever you want with this stuff
if we meet some day and you think this stuff is worth it you can buy me a beer
the beer ?ware licen[cs]e(?: revision 42)?
""",
    "cecill": r"""
ce logiciel est (?:un programme informatique )?(?:regi|régi) par la licence cecill
this software is governed by the cecill(?: [abc])? licen[cs]e
""",
    "osl": r"""
licen[cs]ed under the open software licen[cs]e version [123] [01]
""",
    "afl": r"""
licen[cs]ed under the academic free licen[cs]e version [123] [012]
""",
    "upl": r"""
the universal permissive licen[cs]e upl(?: version)?(?: 1 0)?
subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
""",
    "vim": r"""
there are no restrictions on distributing unmodified copies of vim
""",
    "lppl": r"""
this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
the current maintainer of this work is
this work has the lppl maintenance status
""",
    "unicode": r"""
unicode inc licen[cs]e agreement data files and software
permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode licen[cs]e (?:agreement|v3)
""",
    "freetype": r"""
portions of this software are copyright (?:W ){1,6}the freetype project
the freetype project licen[cs]e
freetype licen[cs]e
""",
    "ijg": r"""
this software is based in part on the work of the independent jpeg group
""",
    "info-zip": r"""
this software is provided as is without warranty of any kind express or implied in no event shall info zip
info zip licen[cs]e
""",
    "bzip2": r"""
this program bzip2 the associated library libbzip2 and all documentation are copyright
""",
    "naist": r"""
nara institute of science and technology
""",
    "intel": r"""
intel (?:simplified software|open source) licen[cs]e
""",
    "nvidia": r"""
nvidia (?:source code|software) licen[cs]e(?: agreement)?
licen[cs]e agreement for nvidia software development kits
""",
    "oracle": r"""
oracle (?:technology network|binary code|free use terms and conditions) licen[cs]e(?: agreement)?
oracle no fee terms and conditions
""",
    "ibm": r"""
ibm public licen[cs]e(?: version)?(?: 1 0)?
international program licen[cs]e agreement
""",
    "apsl": r"""
apple public source licen[cs]e(?: version)?(?: [12] [012])?
this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e
""",
    "npl": r"""
netscape public licen[cs]e(?: version)?(?: 1 [01])?
the contents of this file are subject to the netscape public licen[cs]e
""",
    "sleepycat": r"""
redistributions in any form must be accompanied by information on how to obtain complete source code
sleepycat licen[cs]e
""",
    "qpl": r"""
q public licen[cs]e(?: version)?(?: 1 0)?
may be distributed under the terms of the q public licen[cs]e
""",
    "cpal": r"""
common public attribution licen[cs]e(?: version)?(?: 1 0)?
""",
    "mulan": r"""
mulan (?:psl|permissive software licen[cs]e)(?: v(?:ersion)? ?[12])?
""",
    "hippocratic": r"""
hippocratic licen[cs]e(?: version)?(?: [123] [01])?
""",
    "parity": r"""
parity public licen[cs]e(?: [67] 0 0)?
""",
    "prosperity": r"""
prosperity public licen[cs]e(?: [23] 0 0)?
""",
    "blueoak": r"""
blue oak model licen[cs]e(?: 1 0 0)?
""",
    "ecl": r"""
licen[cs]ed under the educational community licen[cs]e version [12] 0
""",
    "proprietary": r"""
all rights reserved
proprietary and confidential
unauthori[sz]ed copying of this file via any medium is strictly prohibited
this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential|trade secret)
no part of this (?:publication|work|document|book) may be reproduced
may not be reproduced (?:or distributed )?without (?:the )?(?:prior |express |written ){1,3}(?:permission|consent)
reproduction (?:in whole or in part )?without (?:written )?permission is (?:strictly )?prohibited
for internal use only
alle rechte vorbehalten
tous droits réservés
todos los derechos reservados
by (?:installing|downloading|using) (?:or using |or installing )?(?:this|the) software you agree to (?:be bound by )?the terms of this (?:licen[cs]e )?agreement
end user licen[cs]e agreement
you may not (?:reverse engineer|decompile) (?:decompile )?(?:or )?(?:disassemble )?the software
""",
}

# What no one says of a text by chance only -> weight of the evidence; others have 1.
WEAK = {"all rights reserved": 0.5, "for internal use only": 0.4, "openstreetmap contributors": 0.6, "nara institute of science and technology": 0.5, "this program comes with absolutely no warranty": 0.5}

# SPDX identifiers in words -> label.
SPDX = {
    "0bsd": "0bsd", "afl": "afl", "agpl": "agpl", "apache": "apache", "apsl": "apsl", "artistic": "artistic", "beerware": "beerware", "blueoak": "blueoak", "bsd": "bsd", "bsl": "bsl", "busl": "busl",
    "bzip2": "bzip2", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "cddl": "cddl",
    "cdla permissive": "cdla", "cdla sharing": "cdla", "cecill": "cecill", "cpal": "cpal", "cpl": "cpl", "curl": "curl", "ecl": "ecl", "elastic": "elastic", "epl": "epl", "etalab": "etalab", "eupl": "eupl",
    "ftl": "freetype", "gfdl": "fdl", "gpl": "gpl", "hpnd": "hpnd", "ijg": "ijg", "info zip": "info-zip", "intel": "intel", "ipl": "ibm", "isc": "isc", "json": "json", "lgpl": "lgpl", "libpng": "libpng",
    "lppl": "lppl", "mit": "mit", "mit 0": "mit-0", "mpl": "mpl", "ms pl": "ms-pl", "ms rl": "ms-rl", "mulanpsl": "mulan", "ncsa": "ncsa", "npl": "npl", "ntp": "ntp", "odbl": "odbl", "odc by": "odc-by",
    "ofl": "ofl", "ogl uk": "ogl", "openssl": "openssl", "osl": "osl", "pddl": "pddl", "php": "php", "postgresql": "postgresql", "psf": "psf", "python": "psf", "qpl": "qpl", "ruby": "ruby",
    "sleepycat": "sleepycat", "sspl": "sspl", "unicode": "unicode", "unlicense": "unlicense", "upl": "upl", "vim": "vim", "w3c": "w3c", "wtfpl": "wtfpl", "x11": "x11", "zlib": "zlib", "zpl": "zpl",
}
