"""Signature rules of licences, written by hand.

A line is `label | priority | keyword | phrase`. A blank in a phrase stands for
any run of characters that belong to no word; a phrase starts and ends at word
bounds; the rest is regular-expression syntax over lower-cased text. A rule is
tried only where its keyword occurs, so every match must contain it. Priorities: 5 identifier lines, 4 texts
peculiar to one licence, 3 a name with its version, 2 a name, 1 a mere hint.
"""

RULES = r"""
apache-2.0 | 4 | apache | licensed under the apache license version 2(?: 0)?
apache-2.0 | 4 | apache | apache license version 2 0 january 2004
apache-2.0 | 3 | apache | apache (?:software )?licen[cs]e,? (?:version |v )?2(?: 0)?
apache-2.0 | 3 | apache | apache 2(?: 0)? licen[cs]e
apache-1.1 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.0 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache | 2 | apache | apache (?:software )?licen[cs]e
mit | 4 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | copyright | the above copyright notice and this permission notice shall be included in all copies
mit | 3 | mit | (?:the )?mit licen[cs]e
mit | 3 | mit | (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?mit
mit | 2 | expat | expat licen[cs]e
mit-0 | 3 | mit | mit no attribution(?: licen[cs]e)?
mit-0 | 3 | mit | mit 0 licen[cs]e
x11 | 3 | x11 | x11 licen[cs]e
bsd | 4 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 4 | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-4-clause | 4 | advertising | all advertising materials mentioning features or use of this software must display
bsd-2-clause | 3 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-0-clause | 3 | bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
bsd | 2 | bsd | bsd(?: style| type)? licen[cs]e
gpl-3.0-or-later | 4 | either | either version 3 of the license or at your option any later version
gpl-2.0-or-later | 4 | either | either version 2 of the license or at your option any later version
gpl-3.0 | 3 | general public | gnu general public licen[cs]e (?:version |v )?3(?: 0)?
gpl-2.0 | 3 | general public | gnu general public licen[cs]e (?:version |v )?2(?: 0)?
gpl-1.0 | 3 | general public | gnu general public licen[cs]e (?:version |v )?1(?: 0)?
gpl-3.0 | 3 | gpl | (?:gnu )?gpl ?v?(?:ersion)? ?3(?: 0)?
gpl-2.0 | 3 | gpl | (?:gnu )?gpl ?v?(?:ersion)? ?2(?: 0)?
gpl | 2 | gpl | (?:gnu )?gpl(?:ed)?
gpl | 2 | general public | (?:gnu )?general public licen[cs]e
lgpl-3.0 | 3 | lesser | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?
lgpl-2.1 | 3 | lesser | gnu lesser general public licen[cs]e (?:version |v )?2 1
lgpl-2.0 | 3 | library | gnu library general public licen[cs]e (?:version |v )?2(?: 0)?
lgpl-3.0 | 3 | lgpl | lgpl ?v?(?:ersion)? ?3(?: 0)?
lgpl-2.1 | 3 | lgpl | lgpl ?v?(?:ersion)? ?2 1
lgpl | 2 | lgpl | (?:gnu )?lgpl
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | library | (?:gnu )?library general public licen[cs]e
agpl-3.0 | 3 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3.0 | 3 | agpl | agpl ?v?(?:ersion)? ?3(?: 0)?
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl
gfdl-1.3 | 3 | free documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 3
gfdl-1.2 | 3 | free documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 2
gfdl-1.1 | 3 | free documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?1 1
gfdl | 2 | free documentation | (?:gnu )?free documentation licen[cs]e
gfdl | 1 | gfdl | gfdl
mpl-2.0 | 4 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?1 0
mpl | 2 | mozilla | mozilla public licen[cs]e
mpl-2.0 | 2 | mpl | mpl ?v?2(?: 0)?
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 3 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl-1.1 | 3 | common development | common development and distribution licen[cs]e (?:version |v )?1 1
cddl-1.0 | 3 | common development | common development and distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl | 2 | cddl | cddl
cpl-1.0 | 3 | common public | common public licen[cs]e(?: (?:version |v )?1 0)?
cpal-1.0 | 3 | attribution | common public attribution licen[cs]e(?: (?:version |v )?1 0)?
ipl-1.0 | 3 | ibm | ibm public licen[cs]e(?: (?:version |v )?1 0)?
apsl-2.0 | 3 | public source | apple public source licen[cs]e(?: (?:version |v )?2 0)?
npl-1.1 | 3 | netscape | netscape public licen[cs]e(?: (?:version |v )?1 [01])?
spl-1.0 | 3 | sun public | sun public licen[cs]e
isc | 4 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 3 | isc | isc licen[cs]e
zlib | 4 | as is | this software is provided as is without any express or implied warranty in no event
zlib | 3 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 3 | png | (?:the )?(?:libpng|png reference library) licen[cs]e
boost-1.0 | 3 | boost | boost software licen[cs]e(?: (?:version |v )?1 0)?
unlicense | 4 | public domain | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | (?:the )?unlicense
wtfpl | 4 | what the | do what the f[a-z*]+ you want to public licen[cs]e
wtfpl | 3 | wtfpl | wtfpl
artistic-2.0 | 3 | artistic | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic-1.0 | 3 | artistic | artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic | 2 | artistic | (?:the )?artistic licen[cs]e
perl | 3 | perl | (?:under the )?same terms as perl(?: itself)?
python-2.0 | 3 | python | python software foundation licen[cs]e(?: (?:version |v )?2)?
python-2.0 | 3 | psf | psf licen[cs]e(?: agreement)?
php-3.01 | 3 | php | php licen[cs]e(?: (?:version |v )?3 0?1)?
ruby | 3 | ruby | (?:the )?ruby(?: s)? licen[cs]e
w3c | 3 | w3c | w3c (?:software|document)(?: notice and)? licen[cs]e
w3c | 2 | w3c | w3c licen[cs]e
openssl | 3 | openssl | openssl licen[cs]e
ofl-1.1 | 3 | open font | (?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?
ofl-1.1 | 2 | ofl | sil ofl(?: 1 1)?
eupl-1.2 | 3 | european union | european union public licen[cs]e (?:version |v )?1 2
eupl-1.1 | 3 | european union | european union public licen[cs]e (?:version |v )?1 1
eupl | 2 | european union | european union public licen[cs]e
eupl | 2 | eupl | eupl(?: v? ?1 [12])?
cecill-2.1 | 3 | cecill | cecill (?:version |v )?2 1
cecill | 2 | cecill | cecill(?: [bc])?
ms-pl | 3 | microsoft | microsoft public licen[cs]e
ms-rl | 3 | microsoft | microsoft reciprocal licen[cs]e
ncsa | 3 | illinois | university of illinois (?:ncsa )?open source licen[cs]e
ncsa | 3 | ncsa | ncsa open source licen[cs]e
postgresql | 3 | postgresql | postgresql licen[cs]e
vim | 3 | vim | vim licen[cs]e
tcl | 3 | tcl | tcl(?: tk)? licen[cs]e
curl | 3 | curl | curl licen[cs]e
sleepycat | 3 | sleepycat | sleepycat licen[cs]e
jasper | 3 | jasper | jasper licen[cs]e
qpl-1.0 | 3 | q public | q public licen[cs]e
zpl-2.1 | 3 | zope | zope public licen[cs]e(?: (?:version |v )?2 [01])?
upl-1.0 | 3 | universal permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
bsl-1.1 | 3 | business source | business source licen[cs]e(?: (?:version |v )?1 1)?
sspl-1.0 | 3 | server side | server side public licen[cs]e(?: (?:version |v )?1)?
elastic-2.0 | 3 | elastic | elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?
commons-clause | 3 | commons | commons clause(?: licen[cs]e condition)?
polyform | 3 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e
openrail | 3 | rail | (?:creativeml |bigscience )?open ?rail(?: (?:m|s|d))?(?: licen[cs]e)?
openrail | 3 | responsible | responsible ai licen[cs]e
odbl-1.0 | 3 | open database | open database licen[cs]e(?: (?:version |v )?1 0)?
odbl-1.0 | 2 | odbl | odbl
odc-by-1.0 | 3 | open data commons | open data commons attribution licen[cs]e
pddl-1.0 | 3 | public domain | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive-2.0 | 3 | community data | community data licen[cs]e agreement permissive(?: (?:version |v )?2 0)?
cdla-sharing-1.0 | 3 | community data | community data licen[cs]e agreement sharing(?: (?:version |v )?1 0)?
ogl-3.0 | 3 | open government | open government licen[cs]e(?: (?:version |v )?[123](?: 0)?)?
etalab-2.0 | 3 | etalab | (?:licence ouverte )?etalab(?: (?:version |v )?2 0)?
dl-de-by-2.0 | 3 | datenlizenz | datenlizenz deutschland(?: namensnennung)?(?: 2 0)?
cc-by-nc-nd | 3 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 3 | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc | 3 | creative commons | creative commons attribution non ?commercial
cc-by-nd | 3 | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | 3 | creative commons | creative commons attribution share ?alike
cc-by | 3 | creative commons | creative commons attribution
cc0 | 3 | creative commons | creative commons (?:zero|cc0|public domain dedication)
cc0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc | 2 | creative commons | creative commons(?: licen[cs]e)?
cc-by-nc-nd | 3 | cc | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 3 | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 3 | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | 3 | cc | cc by nd(?: [1-4] [05])?
cc-by-sa | 3 | cc | cc by sa(?: [1-4] [05])?
cc-by-4.0 | 3 | cc | cc by 4 0
cc-by-3.0 | 3 | cc | cc by 3 0
cc-by-2.5 | 3 | cc | cc by 2 5
cc-by-2.0 | 3 | cc | cc by 2 0
cc-by | 2 | cc | cc by
cc-by-nc-nd | 4 | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 4 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 4 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 4 | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | 4 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | 4 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc0 | 4 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
public-domain | 3 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 2 | public domain | public domain
proprietary | 4 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 3 | unauthori | unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: of this file)?
proprietary | 3 | reserved | some rights reserved
proprietary | 3 | license agreement | end user license agreement
proprietary | 2 | eula | eula
proprietary | 2 | may not be | may not be (?:reproduced|copied|distributed|republished)
proprietary | 2 | permission | without (?:the )?(?:prior |express )?(?:written )?permission
reserved | 3 | reserved | all rights reserved
reserved | 3 | droits | tous droits r..?serv..?s
reserved | 3 | rechte | alle rechte vorbehalten
reserved | 3 | derechos | todos los derechos reservados
no-warranty | 2 | warrant | (?:without|absolutely no) (?:any )?warrant(?:y|ies)(?: of any kind)?
no-warranty | 2 | as is | provided (?:by .{1,60}? )?as is
copyright | 1 | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | 1 | copyrighted | copyrighted(?: material| work)?
copyright | 1 | copy | copy (?:19|20)[0-9][0-9]
licensed | 1 | licensed | licensed under (?:the )?(?:terms of )?(?:the )?
licensed | 1 | licen | (?:see|read) (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?
licensed | 1 | licen | (?:terms|conditions) of (?:the|this) licen[cs]e
licensed | 1 | licen | subject to (?:the|this) licen[cs]e
licensed | 1 | permissive | permissive(?:ly)? licen[cs]ed?
copyleft | 2 | copyleft | copyleft
dual-licensed | 2 | dual | dual licen[cs](?:ed|ing|e)
"""

# Licence identifiers as standing in an identifier line; each gives one rule of the highest priority.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later APSL-2.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUDatagrid
EUPL-1.1 EUPL-1.2 Elastic-2.0 FTL Fair GFDL-1.2-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later
GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC Intel JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c Libpng MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MirOS MulanPSL-2.0
NASA-1.3 NCSA NTP Naumen ODC-By-1.0 ODbL-1.0 OFL-1.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.01 PSF-2.0 PostgreSQL QPL-1.0
Ruby SISSL SSPL-1.0 Sleepycat UPL-1.0 Unicode-3.0 Unlicense VSL-1.0 Vim W3C WTFPL X11 Xnet ZPL-2.1 Zlib
""".split()
