"""Hand-written signatures of licences, in order. A line is ``priority ; licence ; keyword ; regular expression``.

Priorities: 5 a tag made for machines, 4 sentences of a licence's own text, 3 a notice that names licence and version, 2 a licence's name
where something is put under it, 1 a bare name or address, 0 words that only claim rights. A space stands for any white space. A rule is tried
only on texts that hold its keyword (lower case, a hyphen or any white space being one space). Of equal priority, the earlier and more special rule stands first.
"""

SPDX_IDS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0
Artistic-1.0-Perl Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause-Patent BSD-2-Clause BSD-3-Clause-Clear BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CATOSL-1.1
CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0
CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-1.0 ECL-2.0
EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 HPND ICU IJG IPL-1.0 ISC
LGPL-2.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 Libpng LPL-1.02 LPPL-1.3c MIT-0 MIT MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0
OFL-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-1.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1
""".split()

RULES = r"""
4 ; MIT ; permission is hereby granted, free of charge ; permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
4 ; MIT-0 ; without restriction, including ; to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.
4 ; MIT ; the above copyright notice and this permission ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
4 ; X11 ; except as contained in this notice ; except as contained in this notice, the names? of .{1,80}? shall not be used in advertising
4 ; BSD-4-Clause ; all advertising materials ; all advertising materials mentioning features or use of this software must display
4 ; BSD-3-Clause ; neither the name ; neither the names? of .{1,120}? nor the names of (its|their) contributors may be used to endorse or promote
4 ; BSD-3-Clause-Clear ; no express or implied licenses ; no express or implied licenses to any party's patent rights are granted
4 ; BSD-2-Clause ; redistribution and use in source ; redistribution and use in source and binary forms, with or without modification, are permitted
4 ; ISC ; permission to use, copy, modify ; permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted
4 ; HPND ; permission to use, copy, modify ; permission to use, copy, modify,? and distribute this software and its documentation for any purpose
4 ; Zlib ; altered source versions ; altered source versions must be plainly marked as such
4 ; Zlib ; provided 'as-is' ; this software is provided 'as-is', without any express or implied warranty\. in no event
4 ; Unlicense ; released into the public domain ; this is free and unencumbered software released into the public domain
4 ; BSL-1.0 ; obtaining a copy of the software and accompanying ; any person or organization obtaining a copy of the software and accompanying documentation covered by this license
4 ; WTFPL ; do what the fuck ; (you just )?do what the fuck you want to( public license)?
4 ; Apache-2.0 ; www.apache.org/licenses ; you may not use this file except in compliance with the license\. you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0
4 ; Apache-2.0 ; grant of patent license ; grant of patent license\. subject to the terms and conditions of this license, each contributor hereby grants
4 ; Apache-1.1 ; apache software foundation ; this product includes software developed by the apache software foundation
4 ; GPL-2.0-or-later ; either version 2 ; under the terms of the gnu general public license as published by the free software foundation[;,] either version 2
4 ; GPL-3.0-or-later ; either version 3 ; under the terms of the gnu general public license as published by the free software foundation[;,] either version 3
4 ; LGPL-2.1-or-later ; either version 2.1 ; under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1
4 ; LGPL-2.0-or-later ; gnu library general ; under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2
4 ; LGPL-3.0-or-later ; gnu lesser ; under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3
4 ; AGPL-3.0-or-later ; gnu affero ; under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3
4 ; GPL-2.0-only ; version 2 of the license ; gnu general public license as published by the free software foundation[;,] version 2 of the license
4 ; GPL-3.0 ; free, copyleft license ; the gnu general public license is a free, copyleft license for software
4 ; GPL-2.0 ; guarantee your freedom to share ; the gnu general public license is intended to guarantee your freedom to share and change free software
4 ; GPL-1.0-or-later ; without even the implied warranty ; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license
4 ; LGPL-2.1-or-later ; without even the implied warranty ; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu lesser general public license
4 ; AGPL-3.0-or-later ; without even the implied warranty ; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu affero general public license
4 ; AGPL-3.0 ; remote network interaction ; remote network interaction; use with the gnu general public license
4 ; MPL-2.0 ; subject to the terms of the mozilla ; this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
4 ; MPL-1.1 ; subject to the mozilla public ; the contents of this file are subject to the mozilla public license version 1\.1
4 ; MPL-1.0 ; subject to the mozilla public ; the contents of this file are subject to the mozilla public license version 1\.0
4 ; NPL-1.1 ; netscape public ; the contents of this file are subject to the netscape public license version 1\.1
4 ; EPL-1.0 ; eclipse public ; terms of the eclipse public license v ?1\.0 which accompanies this distribution
4 ; EPL-2.0 ; eclipse public ; terms of the eclipse public license v?\.? ?2\.0 which (is available|accompanies)
4 ; CDDL-1.0 ; common development and distribution ; the contents of this file are subject to the terms of the common development and distribution license
4 ; CPL-1.0 ; common public ; terms of the common public license v?(ersion)? ?1\.0
4 ; Artistic-2.0 ; artistic ; everyone is permitted to copy and distribute verbatim copies of this license document.{1,200}?artistic license 2\.0
4 ; OFL-1.1 ; sil open font ; this font software is licensed under the sil open font license, version 1\.1
4 ; CC0-1.0 ; waived all copyright ; has waived all copyright and related or neighboring rights
4 ; CC0-1.0 ; dedicated to the public domain ; dedicated to the public domain by waiving all of (his|her|their) rights
4 ; SSPL-1.0 ; third parties as a service ; making the functionality of the program .{0,40}?available to third parties as a service
4 ; SSPL-1.0 ; server side public ; server side public license, version 1
4 ; BUSL-1.1 ; the licensor hereby grants ; the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use
4 ; Elastic-2.0 ; hosted or managed service ; you may not provide the software to third parties as a hosted or managed service
4 ; Commons-Clause ; without limiting other conditions ; without limiting other conditions in the license, the grant of rights .{0,80}?does not include.{0,60}?the right to sell
4 ; OpenSSL ; openssl project ; this product includes software developed by the openssl project
4 ; Python-2.0 ; beopen ; beopen python open source license agreement
4 ; PSF-2.0 ; psf is making python ; psf is making python available to licensee on an "as is" basis
4 ; PHP-3.01 ; php ; this product includes php software, freely available from
4 ; PostgreSQL ; without a written agreement ; for any purpose, without fee, and without a written agreement is hereby granted
4 ; NCSA ; with the software without restriction ; to deal with the software without restriction, including without limitation
4 ; Sleepycat ; redistributions in any form ; redistributions in any form must be accompanied by information on how to obtain complete source code
4 ; Beerware ; if we meet some day ; if we meet some day, and you think this stuff is worth it, you can buy me a beer
4 ; JSON ; shall be used for good ; the software shall be used for good, not evil
4 ; ICU ; permission notice appear in all copies ; provided that the above copyright notice\(?s?\)? and this permission notice appear in all copies of the software
4 ; Libpng ; the png reference library ; the png reference library is supplied "as is"
4 ; IJG ; independent jpeg group ; this software is based in part on the work of the independent jpeg group
4 ; FTL ; freetype ; portions of this software are copyright .{0,40}?the freetype project
4 ; Vim ; vim ; there are no restrictions on distributing unmodified copies of vim
4 ; curl ; daniel stenberg ; copyright \(c\) .{0,40}?daniel stenberg.{0,60}?and many contributors
4 ; Unicode-DFS ; unicode ; permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
4 ; UPL-1.0 ; universal permissive ; universal permissive license
4 ; MS-PL ; microsoft public ; microsoft public license \(ms-pl\)
4 ; MS-RL ; microsoft reciprocal ; microsoft reciprocal license \(ms-rl\)
4 ; EUPL-1.2 ; eupl ; licensed under the eupl,? version 1\.2
4 ; CECILL ; cecill ; governed by the cecill[- ]?[bc]? license under french law
4 ; ODbL-1.0 ; open database ; made available under the open database license
4 ; PDDL-1.0 ; public domain dedication and license ; made available under the public domain dedication and license v?1\.0
4 ; GFDL-1.3 ; gnu free documentation ; under the terms of the gnu free documentation license, version 1\.3
4 ; GFDL-1.2 ; gnu free documentation ; under the terms of the gnu free documentation license, version 1\.2
4 ; GFDL-1.1 ; gnu free documentation ; under the terms of the gnu free documentation license, version 1\.1
4 ; W3C ; w3c ; permission to copy, modify, and distribute this software .{0,40}?w3c
4 ; Proprietary ; confidential ; (proprietary and confidential|confidential and proprietary)( information)?( of)?
4 ; Proprietary ; unauthorized copying ; unauthorized copying of this (file|software|document),? via any medium,? is strictly prohibited
4 ; Proprietary ; no part of this ; no part of this (publication|work|document|book) may be reproduced
3 ; Apache-2.0 ; apache ; (licensed|released|distributed|available|made available|published) under (the )?(terms of )?(the )?apache (software )?license,?( version| v\.?)? ?2(\.0)?
3 ; Apache-1.1 ; apache ; (licensed|released|distributed|available) under (the )?apache (software )?license,?( version| v\.?)? ?1\.1
3 ; Apache-1.0 ; apache ; (licensed|released|distributed|available) under (the )?apache (software )?license,?( version| v\.?)? ?1\.0
3 ; MIT ; mit licen ; (licensed|released|distributed|available|made available|published) under (the )?(terms of )?(the )?mit[- ]licen[cs]e
3 ; MIT ; mit-licen ; (is|are) mit[- ]licen[cs]ed
3 ; X11 ; x11 licen ; (licensed|released|distributed|available) under (the )?x11 licen[cs]e
3 ; AGPL-3.0 ; affero ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu affero general public licen[cs]e,?( version| v\.?)? ?3(\.0)?
3 ; AGPL-3.0 ; agpl ; (licensed|released|distributed|available) under (the )?agpl[- ]?v?\.? ?3
3 ; LGPL-3.0 ; lesser general ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu lesser general public licen[cs]e,?( version| v\.?)? ?3(\.0)?
3 ; LGPL-2.1 ; lesser general ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu lesser general public licen[cs]e,?( version| v\.?)? ?2\.1
3 ; LGPL-2.0 ; library general ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu library general public licen[cs]e,?( version| v\.?)? ?2(\.0)?
3 ; LGPL ; lgpl ; (licensed|released|distributed|available) under (the )?lgpl( ?v?[23](\.[01])?)?
3 ; GPL-3.0 ; general public ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu general public licen[cs]e,?( version| v\.?)? ?3(\.0)?
3 ; GPL-2.0 ; general public ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu general public licen[cs]e,?( version| v\.?)? ?2(\.0)?
3 ; GPL-3.0 ; gpl ; (licensed|released|distributed|available) under (the )?gpl[- ]?v?\.? ?3(\.0)?
3 ; GPL-2.0 ; gpl ; (licensed|released|distributed|available) under (the )?gpl[- ]?v?\.? ?2(\.0)?
3 ; GPL-1.0-or-later ; general public ; (licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu general public licen[cs]e
3 ; BSD-4-Clause ; bsd ; (licensed|released|distributed|available) under (the |a )?(4|four)[- ]clause bsd( licen[cs]e)?
3 ; BSD-3-Clause ; bsd ; (licensed|released|distributed|available) under (the |a )?((3|three)[- ]clause bsd|new bsd|modified bsd|revised bsd|bsd 3[- ]clause)( licen[cs]e)?
3 ; BSD-2-Clause ; bsd ; (licensed|released|distributed|available) under (the |a )?((2|two)[- ]clause bsd|simplified bsd|freebsd|bsd 2[- ]clause)( licen[cs]e)?
3 ; 0BSD ; bsd ; (licensed|released|distributed|available) under (the )?(zero[- ]clause bsd|0bsd)( licen[cs]e)?
3 ; BSD ; bsd ; (licensed|released|distributed|available) under (the |a )?bsd([- ]style)? licen[cs]e
3 ; ISC ; isc licen ; (licensed|released|distributed|available) under (the )?isc licen[cs]e
3 ; MPL-2.0 ; mozilla public ; (licensed|released|distributed|available) under (the )?mozilla public licen[cs]e,?( version| v\.?)? ?2(\.0)?
3 ; MPL-1.1 ; mozilla public ; (licensed|released|distributed|available) under (the )?mozilla public licen[cs]e,?( version| v\.?)? ?1\.1
3 ; EPL-2.0 ; eclipse public ; (licensed|released|distributed|available) under (the )?eclipse public licen[cs]e,?( version| v\.?|[ -])? ?2(\.0)?
3 ; EPL-1.0 ; eclipse public ; (licensed|released|distributed|available) under (the )?eclipse public licen[cs]e,?( version| v\.?|[ -])? ?1(\.0)?
3 ; CDDL-1.1 ; cddl ; (licensed|released|distributed|available) under (the )?cddl[- ,]?(version |v)?1\.1
3 ; CDDL-1.0 ; cddl ; (licensed|released|distributed|available) under (the )?cddl[- ,]?(version |v)?1\.0
3 ; EUPL-1.1 ; european union public ; (licensed|released|distributed|available) under (the )?european union public licen[cs]e,?( version| v\.?)? ?1\.1
3 ; EUPL-1.2 ; european union public ; (licensed|released|distributed|available) under (the )?european union public licen[cs]e,?( version| v\.?)? ?1\.2
3 ; CC-BY-NC-ND-4.0 ; cc by-nc-nd ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]nd[- ]?4\.0
3 ; CC-BY-NC-ND-3.0 ; cc by-nc-nd ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]nd[- ]?3\.0
3 ; CC-BY-NC-SA-4.0 ; cc by-nc-sa ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]sa[- ]?4\.0
3 ; CC-BY-NC-SA-3.0 ; cc by-nc-sa ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]sa[- ]?3\.0
3 ; CC-BY-NC-4.0 ; cc by-nc ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]?4\.0
3 ; CC-BY-NC-3.0 ; cc by-nc ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nc[- ]?3\.0
3 ; CC-BY-ND-4.0 ; cc by-nd ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]nd[- ]?4\.0
3 ; CC-BY-SA-4.0 ; cc by-sa ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]sa[- ]?4\.0
3 ; CC-BY-SA-3.0 ; cc by-sa ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]sa[- ]?3\.0
3 ; CC-BY-4.0 ; cc by ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]?4\.0
3 ; CC-BY-3.0 ; cc by ; (licensed|released|distributed|available) under (a |the )?cc[- ]by[- ]?3\.0
3 ; CC0-1.0 ; cc0 ; (licensed|released|distributed|available|dedicated) (under|with|to) (the )?cc0( 1\.0)?( universal)?
3 ; CC-BY-NC-ND-4.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial[- ]no-?deriv(ative)?s?( works)? 4\.0( international)?
3 ; CC-BY-NC-ND-3.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial[- ]no-?deriv(ative)?s?( works)? 3\.0( unported)?
3 ; CC-BY-NC-SA-4.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0( international)?
3 ; CC-BY-NC-SA-3.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial[- ]share-?alike 3\.0( unported)?
3 ; CC-BY-NC-4.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial 4\.0( international)?
3 ; CC-BY-NC-3.0 ; creative commons attribution ; creative commons attribution[- ]non-?commercial 3\.0( unported)?
3 ; CC-BY-SA-4.0 ; creative commons attribution ; creative commons attribution[- ]share-?alike 4\.0( international)?
3 ; CC-BY-SA-3.0 ; creative commons attribution ; creative commons attribution[- ]share-?alike 3\.0( unported)?
3 ; CC-BY-4.0 ; creative commons attribution ; creative commons attribution 4\.0( international)?
3 ; CC-BY-3.0 ; creative commons attribution ; creative commons attribution 3\.0( unported)?
3 ; Artistic-2.0 ; artistic ; (licensed|released|distributed|available) under (the )?artistic licen[cs]e,?( version| v\.?)? ?2(\.0)?
3 ; Artistic-1.0 ; artistic ; (licensed|released|distributed|available) under (the )?artistic licen[cs]e
3 ; Perl ; same terms as perl ; under the same terms as perl itself
3 ; Ruby ; same terms as ruby ; under the same terms as ruby( itself)?
3 ; BSL-1.0 ; boost software ; (licensed|released|distributed|available) under (the )?boost software licen[cs]e,?( version| -)? ?1\.0
3 ; OFL-1.1 ; open font ; (licensed|released|distributed|available) under (the )?(sil )?open font licen[cs]e,?( version| v\.?)? ?1\.1
3 ; Zlib ; zlib ; (licensed|released|distributed|available) under (the )?zlib(/libpng)? licen[cs]e
3 ; Unlicense ; unlicense ; (licensed|released|distributed|available) under (the )?unlicense
3 ; WTFPL ; wtfpl ; (licensed|released|distributed|available) under (the )?wtfpl
3 ; PSF-2.0 ; python software foundation ; (licensed|released|distributed|available) under (the )?python software foundation licen[cs]e
3 ; PSF-2.0 ; psf licen ; (licensed|released|distributed|available) under (the )?psf licen[cs]e
3 ; PostgreSQL ; postgresql licen ; (licensed|released|distributed|available) under (the )?postgresql licen[cs]e
3 ; BUSL-1.1 ; business source ; (licensed|released|distributed|available) under (the )?business source licen[cs]e,?( version| v\.?)? ?1\.1
3 ; SSPL-1.0 ; sspl ; (licensed|released|distributed|available) under (the )?sspl( ?v?1(\.0)?)?
3 ; Elastic-2.0 ; elastic licen ; (licensed|released|distributed|available) under (the )?elastic licen[cs]e( 2\.0)?
3 ; MulanPSL-2.0 ; mulan ; (licensed|released|distributed|available) under (the )?mulan psl v2
3 ; OGL-UK-3.0 ; open government ; under the open government licen[cs]e v?(ersion )?3\.0
3 ; ODbL-1.0 ; open database ; (licensed|released|distributed|available) under (the )?open (data commons open )?database licen[cs]e
3 ; ODC-By-1.0 ; open data commons ; (licensed|released|distributed|available) under (the )?open data commons attribution licen[cs]e
3 ; GFDL ; free documentation ; (licensed|released|distributed|available) under (the )?gnu free documentation licen[cs]e
3 ; LPPL-1.3c ; latex project ; (distributed|modified) under (the )?(conditions of )?the latex project public licen[cs]e
3 ; AFL-3.0 ; academic free ; (licensed|released|distributed|available) under (the )?academic free licen[cs]e,?( version| v\.?)? ?3\.0
3 ; OSL-3.0 ; open software ; (licensed|released|distributed|available) under (the )?open software licen[cs]e,?( version| v\.?)? ?3\.0
3 ; NCSA ; illinois ; (licensed|released|distributed|available) under (the )?university of illinois/ncsa open source licen[cs]e
3 ; LLAMA ; llama ; llama ?[23]?(\.[0-9])? community licen[cs]e( agreement)?
3 ; OpenRAIL ; rail ; (open)?rail(\+\+)?-[ms]? licen[cs]e|bigscience (open)?rail[- ][ms]
2 ; MIT ; mit licen ; (the )?mit licen[cs]e( \(mit\))?
2 ; Apache-2.0 ; apache ; apache (software )?license,?( version| v\.?) ?2\.0
2 ; Apache-2.0 ; apache-2.0 ; \bapache-2\.0\b
2 ; Apache ; apache ; apache (software |public )?license
2 ; AGPL-3.0 ; affero ; gnu affero general public licen[cs]e( v(ersion)? ?3)?
2 ; LGPL ; lesser general ; gnu lesser general public licen[cs]e
2 ; LGPL ; library general ; gnu library general public licen[cs]e
2 ; GPL-3.0 ; general public ; gnu general public licen[cs]e,?( version| v\.?) ?3(\.0)?
2 ; GPL-2.0 ; general public ; gnu general public licen[cs]e,?( version| v\.?) ?2(\.0)?
2 ; GPL ; general public ; gnu general public licen[cs]e
2 ; BSD-3-Clause ; bsd ; \b(bsd[- ]3[- ]clause|3[- ]clause bsd|new bsd licen[cs]e)\b
2 ; BSD-2-Clause ; bsd ; \b(bsd[- ]2[- ]clause|2[- ]clause bsd|simplified bsd licen[cs]e)\b
2 ; BSD ; bsd licen ; \bbsd licen[cs]e\b
2 ; ISC ; isc licen ; \bisc licen[cs]e\b
2 ; MPL-2.0 ; mozilla public ; mozilla public licen[cs]e,?( version| v\.?) ?2\.0
2 ; MPL ; mozilla public ; mozilla public licen[cs]e
2 ; EPL ; eclipse public ; eclipse public licen[cs]e
2 ; CDDL ; common development and distribution ; common development and distribution licen[cs]e
2 ; CPL ; common public ; common public licen[cs]e
2 ; EUPL ; european union public ; european union public licen[cs]e
2 ; BSL-1.0 ; boost software ; boost software licen[cs]e
2 ; OFL-1.1 ; open font ; (sil )?open font licen[cs]e
2 ; Artistic ; artistic licen ; \bartistic licen[cs]e\b
2 ; AFL ; academic free ; academic free licen[cs]e
2 ; OSL ; open software licen ; open software licen[cs]e
2 ; Unlicense ; the unlicense ; \bthe unlicense\b
2 ; Zlib ; zlib licen ; \bzlib licen[cs]e\b
2 ; GFDL ; free documentation ; gnu free documentation licen[cs]e
2 ; CC-BY-NC-ND ; by-nc-nd ; \bcc[- ]by[- ]nc[- ]nd\b
2 ; CC-BY-NC-SA ; by-nc-sa ; \bcc[- ]by[- ]nc[- ]sa\b
2 ; CC-BY-NC ; by-nc ; \bcc[- ]by[- ]nc\b
2 ; CC-BY-ND ; by-nd ; \bcc[- ]by[- ]nd\b
2 ; CC-BY-SA ; by-sa ; \bcc[- ]by[- ]sa\b
2 ; CC-BY ; cc by ; \bcc by\b
2 ; CC-BY ; cc-by ; \bcc-by\b
2 ; CC0-1.0 ; cc0 ; \bcc0\b
2 ; CC-BY-SA ; creative commons attribution ; creative commons attribution[- ]share-?alike
2 ; CC-BY-NC ; creative commons attribution ; creative commons attribution[- ]non-?commercial
2 ; CC-BY ; creative commons attribution ; creative commons attribution
2 ; CC ; creative commons ; creative commons( licen[cs]e)?
2 ; public-domain ; public domain ; (placed|released|dedicated|is|are) (in|into|to) the public domain
2 ; BUSL-1.1 ; business source licen ; business source licen[cs]e
2 ; SSPL-1.0 ; server side public ; server side public licen[cs]e
2 ; Elastic-2.0 ; elastic licen ; elastic licen[cs]e
2 ; MS-PL ; ms-pl ; \bms-pl\b
2 ; MS-RL ; ms-rl ; \bms-rl\b
2 ; LPPL ; latex project public ; latex project public licen[cs]e
2 ; OGL-UK ; open government ; open government licen[cs]e
2 ; ODbL ; odbl ; \bodbl\b
2 ; ODbL ; open database licen ; open database licen[cs]e
2 ; Proprietary ; proprietary licen ; proprietary licen[cs]e
2 ; Commercial ; commercial licen ; commercial licen[cs]e
1 ; Apache-2.0 ; apache.org/licenses ; https?://(www\.)?apache\.org/licenses/license-2\.0(\.txt|\.html)?
1 ; MIT ; opensource.org/licenses/mit ; https?://(www\.)?opensource\.org/licenses/mit(-license\.php)?
1 ; BSD-3-Clause ; opensource.org/licenses/bsd-3 ; https?://(www\.)?opensource\.org/licenses/bsd-3-clause
1 ; BSD-2-Clause ; opensource.org/licenses/bsd-2 ; https?://(www\.)?opensource\.org/licenses/bsd-2-clause
1 ; ISC ; opensource.org/licenses/isc ; https?://(www\.)?opensource\.org/licenses/isc
1 ; GPL ; gnu.org/licenses/gpl ; https?://(www\.)?gnu\.org/licenses/gpl(-[23]\.0)?
1 ; GPL ; gnu.org/licenses ; https?://(www\.)?gnu\.org/licenses/?
1 ; LGPL ; gnu.org/licenses/lgpl ; https?://(www\.)?gnu\.org/licenses/lgpl(-[23]\.[01])?
1 ; AGPL-3.0 ; gnu.org/licenses/agpl ; https?://(www\.)?gnu\.org/licenses/agpl(-3\.0)?
1 ; MPL-2.0 ; mozilla.org/mpl ; https?://(www\.)?mozilla\.org/mpl/2\.0
1 ; CC0-1.0 ; creativecommons.org/publicdomain/zero ; https?://(www\.)?creativecommons\.org/publicdomain/zero/1\.0
1 ; CC-BY-NC-ND ; creativecommons.org/licenses/by-nc-nd ; https?://(www\.)?creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
1 ; CC-BY-NC-SA ; creativecommons.org/licenses/by-nc-sa ; https?://(www\.)?creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
1 ; CC-BY-NC ; creativecommons.org/licenses/by-nc ; https?://(www\.)?creativecommons\.org/licenses/by-nc/[1-4]\.[05]
1 ; CC-BY-ND ; creativecommons.org/licenses/by-nd ; https?://(www\.)?creativecommons\.org/licenses/by-nd/[1-4]\.[05]
1 ; CC-BY-SA ; creativecommons.org/licenses/by-sa ; https?://(www\.)?creativecommons\.org/licenses/by-sa/[1-4]\.[05]
1 ; CC-BY ; creativecommons.org/licenses/by ; https?://(www\.)?creativecommons\.org/licenses/by/[1-4]\.[05]
1 ; Unlicense ; unlicense.org ; https?://(www\.)?unlicense\.org
1 ; WTFPL ; wtfpl.net ; https?://(www\.)?wtfpl\.net
1 ; OFL-1.1 ; scripts.sil.org/ofl ; https?://scripts\.sil\.org/ofl
1 ; BSL-1.0 ; boost.org/license ; https?://(www\.)?boost\.org/license_1_0\.txt
1 ; EPL ; eclipse.org/legal/epl ; https?://(www\.)?eclipse\.org/legal/epl-(v10|v20|2\.0)(\.html)?
1 ; AGPL-3.0 ; agpl ; \bagpl(-?v?3(\.0)?)?\b
1 ; LGPL ; lgpl ; \blgpl(-?v?[23](\.[01])?)?\b
1 ; GPL-3.0 ; gpl ; \bgpl-?v?3(\.0)?\b
1 ; GPL-2.0 ; gpl ; \bgpl-?v?2(\.0)?\b
1 ; WTFPL ; wtfpl ; \bwtfpl\b
0 ; All-rights-reserved ; all rights reserved ; all rights reserved\.?
0 ; All-rights-reserved ; tous droits ; tous droits réservés\.?
0 ; All-rights-reserved ; alle rechte ; alle rechte vorbehalten\.?
0 ; All-rights-reserved ; todos los derechos ; todos los derechos reservados\.?
0 ; Copyright ; copyright ; \bcopyright (\(c\)|©)? ?(19|20)\d\d( ?[-–] ?((19|20)\d\d|present))?
0 ; Copyright ; © ; © ?(19|20)\d\d( ?[-–] ?((19|20)\d\d|present))?
""".strip()


def rules() -> list[tuple[str, int, str, str, str]]:
    """(rule, priority, licence, keyword, expression), in order."""
    out = [(f"spdx-{i}", 5, i, "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?\s*{i.replace('.', '[.]')}(?![\w.-])") for i in SPDX_IDS]
    for n, line in enumerate(RULES.split("\n")):
        priority, licence, keyword, expr = (x.strip() for x in line.split(" ; ", 3))
        out.append((f"r{n:03d}-{licence}", int(priority), licence, keyword, expr.replace(" ", r"\s+").replace(r"\s+?", r"\s*")))
    return out
