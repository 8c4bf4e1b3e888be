"""Signatures of licenses, written by hand over a text's lowered words with single spaces between.

``~n`` stands for up to n words of any kind. Each line holds a label, the keyword without
which the signature can't match, and the pattern.
"""

from __future__ import annotations

#: Words of license texts, by how sure a match is. The more telling a text, the earlier it comes.
WHOLE = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~60 the above copyright notice and this permission notice ~12 shall be included in all copies or substantial portions of the software(?: the software is provided as is ~90 dealings in the software)?
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~40 to permit persons to whom the software is furnished to do so the software is provided as is(?: ~90 dealings in the software)?
boost | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation(?: ~90 machine executable object code generated by a source language processor)?
isc | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies(?: ~80 performance of this software)?
0bsd | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is(?: ~80 performance of this software)?
postgresql | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | documentation for any purpose | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee| is hereby granted without fee) ~4 (?:hereby granted )?provided that
bsd-4 | redistribution and use | redistribution and use in source and binary forms ~120 all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: ~160 possibility of such damage)?
bsd-3 | redistribution and use | redistribution and use in source and binary forms ~110 neither the names? of ~14 may be used to endorse or promote products derived from this software(?: ~160 possibility of such damage)?
bsd-2 | redistribution and use | redistribution and use in source and binary forms ~70 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution(?: this software is provided by ~160 possibility of such damage)?
zlib | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable ~100 altered source versions must be plainly marked as such ~20 this notice may not be removed or altered from any source distribution
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain(?: ~240 unlicense org)?
apache-2 | apache license | licensed under the apache license version 2 0 the license you may not use this ~3 except in compliance with the license(?: you may obtain a copy of the license at ~10 (?:license 2 0|license) ~45 limitations under the license)?
gpl-3-or-later | general public license | (?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 ~4 or at your option any later version
gpl-2-or-later | general public license | (?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 ~4 or at your option any later version
gpl-1-or-later | general public license | (?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1 ~4 or at your option any later version
gpl-3 | general public license | you can redistribute it and or modify it under the terms of the gnu general public license(?: version 3)? as published by the free software foundation(?: either)? version 3(?: of the license)?(?! or at your option| of the license or at your option)
gpl-2 | general public license | you can redistribute it and or modify it under the terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: either)? version 2(?: of the license)?(?! or at your option| of the license or at your option)
lgpl-2.1-or-later | lesser general public license | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 ~4 or at your option any later version
lgpl-3-or-later | lesser general public license | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 ~4 or at your option any later version
lgpl-2-or-later | library general public license | you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 ~4 or at your option any later version
agpl-3-or-later | affero general public license | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 ~4 or at your option any later version
gfdl-1.3-or-later | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version
gfdl-1.2-or-later | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version
gfdl-1.1-or-later | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1 or any later version
mpl-2 | mozilla public license | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0(?: if a copy of the mpl was not distributed with this file you can obtain one at ~8 mpl 2 0)?
mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license
mpl-1.0 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 0 the license you may not use this file except in compliance with the license
"""

BODIES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission notice | the above copyright notice and this permission notice ~12 shall be included in all copies or substantial portions of the software
x11 | contained in this notice | except as contained in this notice the names? of ~12 shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
isc | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted(?: provided that)?
bsd | redistributions of source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3 | neither the name | neither the names? of ~14 may be used to endorse or promote products derived from this software
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-clear | patent rights | no express or implied licenses to any ~4 patent rights are granted by this license
bsd-patent | patent license | subject to the terms and conditions of this license each copyright holder and contributor hereby grants ~16 patent license
apache-2 | terms and conditions for use | terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions
apache-2 | each contributor hereby grants | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | as is basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | apache group | this product includes software developed by the apache group for use in the apache http server project
gpl | without even the implied warranty | this (?:program|software|file|package) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | along with this | you should have received a copy of the gnu general public license along with this
lgpl | along with this | you should have received a copy of the gnu (?:lesser|library) general public license along with this
agpl | along with this | you should have received a copy of the gnu affero general public license along with this
gpl-1 | take away | the license agreements of most software companies try to keep users at the mercy of those companies
gpl-2 | take away | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license
gpl-3 | free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
lgpl-2.1 | take away | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses ~70 lesser general public license
lgpl-3 | general public license | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3 | free copyleft license | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 | incompatible with secondary | this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
epl-1 | eclipse public license | accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2 | eclipse public license | accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0
epl | eclipse public license | the accompanying program is provided under the terms of this eclipse public license
cpl-1 | common public license | the accompanying program is provided under the terms of this common public license
ipl-1 | ibm public license | the accompanying program is provided under the terms of this ibm public license
cddl-1 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
eupl-1.2 | european union | this european union public licence the eupl applies to the work
artistic-1 | intent of this document | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2 | establishes the terms | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | same terms as perl | (?:redistribute it and or modify it |used and distributed )?under the same terms as (?:the )?perl ~3 itself
ruby | same terms as ruby | under the same terms as ruby(?: itself)?
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | png reference library | the png reference library is supplied as is
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
wtfpl | public license | do what the fuck you want to public license
psf-2 | psf hereby grants | subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | font software | the font software may be modified altered or added to and in particular the designs of glyphs or characters
cc0 | to the extent possible under law | to the extent possible under law ~16 (?:has|have) (?:waived|dedicated) all copyright
cc0 | statement of purpose | the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights
odbl | open database license | this ~4 is made available under the open database license
pddl | public domain dedication | this ~4 is made available under the public domain dedication and license
ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license
ncsa | ncsa open source | university of illinois ncsa open source license
php-3.01 | php license | this source file is subject to version 3 01 of the php license
php-3 | php license | this source file is subject to version 3 0 of the php license
php | includes php | this product includes php software freely available from
zend-2 | zend license | this source file is subject to version 2 00 of the zend license
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software | this product includes cryptographic software written by eric young
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation
ijg | jpeg group | this software is based in part on the work of the independent jpeg group
ftl | freetype | portions of this software are copyright ~6 the freetype project
bzip2 | bzip2 | this program bzip2 the associated library libbzip2 and all documentation are copyright
tcl | regents of the university | this software is copyrighted by the regents of the university of california sun microsystems inc
w3c | notice and license | w3c (?:software|document) (?:notice and license|and document notice and license)
json | good not evil | the software shall be used for good not evil
beerware | buy me a beer | as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer
cecill | cecill | this software is governed by the cecill(?: [bc])? license under french law
qpl | q public license | the q public license version 1 0
sleepycat | complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
osl-3 | open software license | licensed under the open software license version 3 0
afl-3 | academic free license | licensed under the academic free license version 3 0
lppl-1.3c | latex project public license | this work may be distributed and or modified under the conditions of the latex project public license(?: either version 1 3c?)?
upl | universal permissive license | the universal permissive license upl version 1 0
vim | unmodified copies of vim | there are no restrictions on distributing unmodified copies of vim
curl | hereby granted | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is ~40 third party rights
ntp | university of delaware | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted ~30 university of delaware
bsl-1.1 | change date | effective on the change date or the fourth anniversary of the first publicly available distribution
elastic-2 | elastic license | by using the software you agree to all of the terms and conditions below ~60 elastic license
sspl-1 | functionality of the program | if you make the functionality of the program or a modified version available to third parties as a service
commons-clause | right to sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
llama | llama | llama [0-9]+(?: [0-9]+)? (?:is licensed under|community license agreement)
openrail | use based restrictions | you (?:shall|may|can) not use the model ~12 use based restrictions|use based restrictions as referenced in paragraph 5
proprietary | strictly prohibited | unauthorized (?:copying|use|distribution|reproduction) of this ~8 (?:is|are) strictly prohibited
proprietary | confidential and proprietary | this (?:software|document|file) (?:is|contains) the confidential and proprietary information of
proprietary | proprietary and confidential | proprietary and confidential
proprietary | may be reproduced | no part of this ~6 may be reproduced ~24 without ~4 (?:prior )?(?:written )?(?:permission|consent)
public-domain | public domain | (?:is|are|was|has been|have been)(?: hereby)? (?:placed|released|dedicated|put)? ?(?:in|into|to) the public domain
public-domain | no rights reserved | no (?:copyright|rights) (?:is claimed|reserved)
"""

NOTICES = """
mit | mit licen | (?:the )?mit license mit
mit | mit licen | (?:is|are) mit licen[cs]ed
mit | licen | (?:expat|mit) (?:style )?licen[cs]e terms
mit | opensource org | opensource org licenses? mit(?: license)?(?: php)?
mit | licenses mit | (?:spdx|choosealicense) (?:org|com) licenses mit
isc | opensource org | opensource org licenses? isc
bsd-2 | opensource org | opensource org licenses? bsd 2 clause
bsd-3 | opensource org | opensource org licenses? bsd 3 clause
bsd | bsd style licen | bsd style licen[cs]e
bsd | bsd style licen | use of this source code is governed by a bsd style license that can be found in the license file
apache-2 | apache | apache license version 2 0 january 2004
apache-2 | apache org licenses | (?:www )?apache org licenses license 2 0
apache-2 | opensource org | opensource org licenses? apache 2 0
apache-1.1 | apache | (?:the )?apache software license version 1 1
gpl-1 | general public license | gnu general public license version 1 february 1989
gpl-2 | general public license | gnu general public license version 2 june 1991
gpl-3 | general public license | gnu general public license version 3 29 june 2007
lgpl-2 | library general public license | gnu library general public license version 2 june 1991
lgpl-2.1 | lesser general public license | gnu lesser general public license version 2 1 february 1999
lgpl-3 | lesser general public license | gnu lesser general public license version 3 29 june 2007
agpl-3 | affero general public license | gnu affero general public license version 3 19 november 2007
gpl-2 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu org licenses | gnu org licenses gpl 3 0
gpl | gnu org | gnu org (?:licenses|copyleft) gpl
lgpl-2.1 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | gnu org licenses | gnu org licenses lgpl 3 0
lgpl | gnu org | gnu org (?:licenses|copyleft) (?:lgpl|lesser)
agpl-3 | gnu org licenses | gnu org licenses agpl 3 0
gfdl | gnu org | gnu org (?:licenses|copyleft) fdl
classpath-exception | classpath | (?:gnu )?classpath exception
classpath-exception | making a combined work | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception | runtime library exception | gcc runtime library exception
autoconf-exception | configuration script generated | as a special exception ~40 configuration script generated by autoconf
bison-exception | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
openssl-exception | permission to link | (?:gives|give) permission to link (?:the|this) ~20 openssl
font-exception | embed this font | as a special exception if you create a document which uses this font and embed this font
mpl-2 | mozilla org | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla org | mozilla org mpl mpl 1 1
mpl-2 | mozilla public license | mozilla public license version 2 0
epl-1 | eclipse org | eclipse org legal epl v10
epl-2 | eclipse org | eclipse org legal epl 2 0
epl-2 | eclipse org | eclipse org legal epl v20
cddl-1 | cddl | cddl 1 [01]
cddl-1 | opensolaris | opensolaris org os licensing
cpl-1 | opensource org | opensource org licenses? cpl1 0
eupl-1.2 | eupl | (?:licensed under the )?eupl (?:version |v ?)?1 2
eupl-1.1 | eupl | (?:licensed under the )?eupl (?:version |v ?)?1 1
artistic-2 | artistic license | (?:the )?artistic license 2 0
boost | boost org | boost org license 1 0
boost | boost software license | (?:distributed under the )?boost software license version 1 0
zlib | zlib libpng | zlib libpng licen[cs]e
unlicense | unlicense org | (?:http |https )?unlicense org
wtfpl | wtfpl | wtfpl net
psf-2 | python software foundation | python software foundation license version 2
ofl-1.1 | ofl | scripts sil org ofl
ofl-1.1 | open font license | sil open font license version 1 1
cc0 | creativecommons org | creativecommons org publicdomain zero 1 0
cc0 | cc0 | cc0 1 0 universal
cc-pdm | creativecommons org | creativecommons org publicdomain mark 1 0
cc-by | creativecommons org | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons org | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons org | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd [1-4] [05]
cc-by | attribution | attribution [1-4] [05] (?:international|generic|unported)
cc-by-sa | attribution | attribution share ?alike [1-4] [05] (?:international|generic|unported)
cc-by-nd | attribution | attribution no ?deriv(?:ative)?s [1-4] [05] (?:international|generic|unported)
cc-by-nc | attribution | attribution non ?commercial [1-4] [05] (?:international|generic|unported)
cc-by-nc-sa | attribution | attribution non ?commercial share ?alike [1-4] [05] (?:international|generic|unported)
cc-by-nc-nd | attribution | attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05] (?:international|generic|unported)
odbl | opendatacommons | opendatacommons org licenses odbl
odc-by | opendatacommons | opendatacommons org licenses by
pddl | opendatacommons | opendatacommons org licenses pddl
ogl-uk-3 | open government | open government licence v(?:ersion )?3 0
etalab-2 | etalab | (?:licence ouverte|etalab open licen[cs]e)(?: version)? 2 0
ms-pl | microsoft public license | microsoft public license ms pl
ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
php-3.01 | php net | php net license 3 01
openssl | openssl | (?:the )?openssl license
beerware | beer ware | the beer ware license(?: revision 42)?
cecill-2.1 | cecill | cecill ~5 version 2 1
osl-3 | osl 3 0 | osl 3 0
afl-3 | afl 3 0 | afl 3 0
lppl | latex project public license | latex project public license
ncsa | ncsa open source | (?:uiuc|illinois) ~2 ncsa open source license
upl | oss oracle com | oss oracle com licenses upl
bsl-1.1 | business source license | business source license(?: version)? 1 1
elastic-2 | elastic license | elastic license (?:version )?2 0
sspl-1 | server side public license | server side public license(?: version 1)?
commons-clause | commons clause | commons clause license condition v1 0
polyform | polyform | polyform (?:non ?commercial|small business|shield|strict|internal use|free trial|perimeter) license(?: 1 0 [01])?
openrail | rail | (?:bigscience|creativeml|bigcode) ~2 (?:open )?rail(?: ?[ms])?(?: license)?
gemma | gemma terms | gemma terms of use
llama | llama | llama [0-9]+(?: [0-9]+)? community license
gpl-2 | dual licensed | dual licensed under ~10 gpl ?(?:version |v ?)?2(?: 0)?(?: licen[cs]es?)?
gpl-3 | dual licensed | dual licensed under ~10 gpl ?(?:version |v ?)?3(?: 0)?(?: licen[cs]es?)?
gpl | dual licensed | dual licensed under ~10 gpl(?! ?(?:version |v ?)?[23] )(?: licen[cs]es?)?
mit | dual licensed | dual licensed under ~10 mit(?: licen[cs]es?)?
apache-2 | dual licensed | dual licensed under ~10 apache(?: licen[cs]es?)?(?: version)?(?: 2(?: 0)?)?
"""

LATER = """
gpl-2-or-later | general public license | (?:gnu )?(?:gpl|general public license) (?:version |v ?)?2(?: 0)? or (?:any )?(?:later|newer|above)
gpl-3-or-later | general public license | (?:gnu )?(?:gpl|general public license) (?:version |v ?)?3(?: 0)? or (?:any )?(?:later|newer|above)
gpl-2-or-later | gpl | gpl ?(?:version |v ?)?2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3-or-later | gpl | gpl ?(?:version |v ?)?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
lgpl-2.1-or-later | lgpl | lgpl ?(?:version |v ?)?2 1 or (?:any )?(?:later|newer)(?: version)?
lgpl-3-or-later | lgpl | lgpl ?(?:version |v ?)?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
agpl-3-or-later | agpl | agpl ?(?:version |v ?)?3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
"""

#: SPDX identifiers as words, with their labels; an expression joins them by and, or and with.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "x11": "x11", "isc": "isc", "0bsd": "0bsd", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "hpnd": "hpnd",
    "apache 1 0": "apache-1.0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2",
    "gpl 1 0 only": "gpl-1", "gpl 1 0 or later": "gpl-1-or-later", "gpl 2 0": "gpl-2", "gpl 2 0 only": "gpl-2", "gpl 2 0 or later": "gpl-2-or-later", "gpl 3 0": "gpl-3", "gpl 3 0 only": "gpl-3", "gpl 3 0 or later": "gpl-3-or-later",
    "lgpl 2 0 only": "lgpl-2", "lgpl 2 0 or later": "lgpl-2-or-later", "lgpl 2 1": "lgpl-2.1", "lgpl 2 1 only": "lgpl-2.1", "lgpl 2 1 or later": "lgpl-2.1-or-later", "lgpl 3 0": "lgpl-3", "lgpl 3 0 only": "lgpl-3", "lgpl 3 0 or later": "lgpl-3-or-later",
    "agpl 3 0": "agpl-3", "agpl 3 0 only": "agpl-3", "agpl 3 0 or later": "agpl-3-or-later", "gfdl 1 3 or later": "gfdl-1.3-or-later", "gfdl 1 3 only": "gfdl", "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2",
    "epl 1 0": "epl-1", "epl 2 0": "epl-2", "cddl 1 0": "cddl-1", "cddl 1 1": "cddl-1", "cpl 1 0": "cpl-1", "ipl 1 0": "ipl-1", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "artistic 1 0": "artistic-1", "artistic 2 0": "artistic-2",
    "bsl 1 0": "boost", "busl 1 1": "bsl-1.1", "zlib": "zlib", "libpng 2 0": "libpng", "unlicense": "unlicense", "wtfpl": "wtfpl", "psf 2 0": "psf-2", "python 2 0": "psf-2", "postgresql": "postgresql", "ofl 1 1": "ofl-1.1", "ncsa": "ncsa",
    "cc0 1 0": "cc0", "cc by 3 0": "cc-by", "cc by 4 0": "cc-by", "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nd 4 0": "cc-by-nd", "cc by nc 4 0": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd",
    "odbl 1 0": "odbl", "odc by 1 0": "odc-by", "pddl 1 0": "pddl", "ms pl": "ms-pl", "ms rl": "ms-rl", "php 3 01": "php-3.01", "openssl": "openssl", "json": "json", "beerware": "beerware", "cecill 2 1": "cecill-2.1", "qpl 1 0": "qpl", "sleepycat": "sleepycat",
    "osl 3 0": "osl-3", "afl 3 0": "afl-3", "lppl 1 3c": "lppl-1.3c", "upl 1 0": "upl", "vim": "vim", "curl": "curl", "ntp": "ntp", "elastic 2 0": "elastic-2", "sspl 1 0": "sspl-1",
    "classpath exception 2 0": "classpath-exception", "gcc exception 3 1": "gcc-exception", "autoconf exception 3 0": "autoconf-exception", "bison exception 2 2": "bison-exception", "linux syscall note": "linux-syscall-note", "llvm exception": "llvm-exception",
}


def read(table: str) -> list[tuple[str, str, str]]:
    """``(label, keyword, pattern)`` of each line."""
    return [tuple(part.strip() for part in line.split(" | ", 2)) for line in table.strip().splitlines()]
