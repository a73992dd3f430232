"""Signatures of licenses, written one by one: label | keyword | pattern.

Patterns are regular expressions over the words of a text (lower case, joined by single
spaces, without punctuation); the keyword is literal text that every match contains. The
order is the priority: whole sentences first, then identifiers and titles.
"""

from __future__ import annotations

SENTENCES = """
mit-0 | free of charge | permission is hereby granted free of charge (?:\\S+ ){1,60}?to whom the software is furnished to do so the software is provided
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | merge publish | without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | this permission notice shall | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | dealings in the software | out of or in connection with the software or the use or other dealings in the software
mit-advertising | advertising or otherwise | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
icu | permission notice appear in all copies | provided that the above copyright notice s and this permission notice appear in all copies of the software
isc | for any purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | for any purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc | tortious action | whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software
hpnd | without fee | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
ntp | without fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
postgresql | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
smlnj | without fee | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both the copyright notice
bsd-4-clause | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause-uc | university of california berkeley | this product includes software developed by the university of california berkeley and its contributors
bsd-3-clause | endorse or promote | neither the name of (?:\\S+ ){1,16}?nor the names of (?:its|the) contributors may be used to endorse or promote
bsd-3-clause | endorse or promote | the names? of the (?:author|authors|contributors) may not be used to endorse or promote products derived from this software
bsd-3-clause-clear | express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
bsd-3-clause-lbnl | enhancements | you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code enhancements
bsd-3-clause-no-nuclear | nuclear facility | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
bsd-2-clause-patent | no charge royalty free | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free
bsd-2-clause-views | official policies | should not be interpreted as representing official policies either expressed or implied
bsd-1-clause | source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided by
bsd-2-clause | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-protection | bsd protection license | terms and conditions for copying distribution and modification of the bsd protection license
bsd-source-code | source code form | redistribution of source code form must retain the above copyright notice
apache-2.0 | in compliance with the license | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | www apache org licenses license 2 0 | www apache org licenses license 2 0
apache-2.0 | limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | terms and conditions for use reproduction | apache license version 2 0 january 2004 (?:\\S+ ){0,8}?terms and conditions for use reproduction and distribution
apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | apache group | this product includes software developed by the apache group for use in the apache http server project
agpl-3.0 | affero | remote network interaction use with the gnu affero general public license|gnu affero general public license version 3 19 november 2007
agpl | affero | is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl | affero | you should have received a copy of the gnu affero general public license
lgpl | under the terms of the gnu | is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl-2.1 | lesser general public license version 2 1 | gnu lesser general public license version 2 1 february 1999
lgpl-2.0 | library general public license version 2 | gnu library general public license version 2 june 1991
lgpl-3.0 | lesser general public license version 3 | gnu lesser general public license version 3 29 june 2007
lgpl | derivative work of the library | such a work in isolation is not a derivative work of the library
gpl-1.0 | general public license version 1 | gnu general public license version 1 february 1989
gpl-2.0 | general public license version 2 | gnu general public license version 2 june 1991
gpl-3.0 | general public license version 3 | gnu general public license version 3 29 june 2007
gpl-2.0-or-later | either version 2 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 | version 2 as published | gnu general public license version 2 as published by the free software foundation
gpl-3.0 | version 3 as published | gnu general public license version 3 as published by the free software foundation
gpl | under the terms of the gnu general | is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received | you should have received a copy of the gnu general public license
gpl | absolutely no warranty | comes with absolutely no warranty (?:\\S+ ){0,12}?this is free software and you are welcome to redistribute it
gpl-with-classpath-exception | independent modules | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-with-classpath-exception | linking this library | linking this library statically or dynamically with other modules
gpl-with-gcc-exception | runtime library exception | gcc runtime library exception
gpl-with-autoconf-exception | configure script | as a special exception the (?:\\S+ ){1,8}?gives unlimited permission to copy distribute and modify the configure scripts?
gpl-with-bison-exception | bison | you may create a larger work that contains part or all of the bison parser skeleton
gpl-with-font-exception | embed this font | if you create a document which uses this font and embed this font or unaltered portions of this font
linux-syscall-note | system calls | this copyright does not cover user programs that use kernel services by normal system calls
gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
fsfap | without royalty | copying and distribution of this file with or without modification are permitted in any medium without royalty provided
fsful | unlimited permission | this configure script is free software the free software foundation gives unlimited permission
fsfullr | unlimited permission | gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla public license version 1 0 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape public license version 1 1 | the contents of this file are subject to the netscape public license version 1 1
npl-1.0 | netscape public license version 1 0 | the contents of this file are subject to the netscape public license version 1 0
mpl-1.1 | alternatively the contents | alternatively the contents of this file may be used under the terms of either
epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
epl-1.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0
epl-2.0 | 2 0 available at | eclipse public license 2 0 available at https? www eclipse org legal epl 2 0
edl-1.0 | eclipse distribution license | terms of the eclipse distribution license (?:v |version )?1 0
cpl-1.0 | common public license | this program and the accompanying materials are made available under the terms of the common public license v1 0
ipl-1.0 | ibm public license | the accompanying program is provided under the terms of this ibm public license
cddl | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
cddl | opensolaris license | usr src opensolaris license or https? www opensolaris org os licensing
eupl | european union public lice | licen[cs]ed under the european union public licen[cs]e
eupl | under the eupl | licensed under the eupl
cecill | governed by the cecill | this software is governed by the cecill (?:[bc] )?licen[cs]e under french law
osl-3.0 | open software license version 3 0 | licensed under the open software license version 3 0
afl-3.0 | academic free license version 3 0 | licensed under the academic free license version 3 0
artistic-1.0 | artistic control | the copyright holder maintains some semblance of artistic control over the development of the package
artistic-2.0 | artistic license 2 0 | the artistic license 2 0
clartistic | clarified artistic | the clarified artistic license
perl-5 | same terms as perl | (?:redistribute|modify) it (?:and or modify it )?under the same terms as perl itself
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | any damages arising | in no event will the authors be held liable for any damages arising from the use of this software
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib-acknowledgement | acknowledgment | an acknowledgment see the following in the product documentation is required
libpng | png reference library | the png reference library is supplied as is
libpng-2.0 | png reference library license | png reference library license version 2
libtiff | sam leffler | the names of sam leffler and silicon graphics may not be used in any advertising
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group
bsl-1.0 | object code generated | machine executable object code generated by a source language processor
bsl-1.0 | boost software license | distributed under the boost software license version 1 0|boost software license version 1 0 august 17th 2003
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedicate any and all copyright | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | what the fuck | (?:do )?what the fuck you want to public license|you just do what the fuck you want to
cc0-1.0 | waive | waive all copyright and related or neighboring rights
cc0-1.0 | cc0 | to the extent possible under law (?:\\S+ ){1,12}?(?:has|have) (?:waived|dedicated) all copyright (?:\\S+ ){0,12}?cc0
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-4.0 | by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-2.0 | by nc sa 2 0 | creativecommons org licenses by nc sa 2 0
cc-by-nc-4.0 | by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-sa-4.0 | by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | by sa 2 5 | creativecommons org licenses by sa 2 5
cc-by-sa-2.0 | by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-4.0 | by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | by 3 0 | creativecommons org licenses by 3 0
cc-by-2.0 | by 2 0 | creativecommons org licenses by 2 0
cc-by-4.0 | attribution 4 0 | licensed under (?:a|the) creative commons attribution 4 0 international license
cc-by-sa-4.0 | sharealike 4 0 | licensed under (?:a|the) creative commons attribution sharealike 4 0 international license
cc-by-sa-3.0 | sharealike 3 0 | licensed under (?:a|the) creative commons attribution sharealike 3 0 (?:unported )?license
cc-by-nc-4.0 | noncommercial 4 0 | licensed under (?:a|the) creative commons attribution noncommercial 4 0 international license
cc-by-nc-sa-4.0 | noncommercial sharealike 4 0 | licensed under (?:a|the) creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd-4.0 | noncommercial noderiv | licensed under (?:a|the) creative commons attribution noncommercial noderiv(?:ative)?s 4 0 international license
public-domain | public domain | (?:dedicated|released|placed|donated) (?:to|into|in) the public domain
public-domain | public domain | (?:this|the) (?:software|file|code|work|document) is (?:hereby )?(?:in|released into|placed in) the public domain
us-government-work | title 17 | pursuant to title 17 section 105 of the united states code
us-government-work | united states government | (?:is a|as a) work of the united states government (?:\\S+ ){0,12}?not subject to copyright
nist-pd | national institute of standards | this software was developed at the national institute of standards and technology by employees of the federal government
blessing | good and not evil | may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely
odbl-1.0 | open database license | (?:made available|licensed) under the open database license
odc-by-1.0 | open data commons attribution | (?:made available|licensed) under the open data commons attribution license
pddl-1.0 | public domain dedication and license | (?:made available|licensed) under the public domain dedication and license
dl-de-by-2.0 | datenlizenz deutschland | datenlizenz deutschland namensnennung version 2 0
etalab-2.0 | licence ouverte | licence ouverte (?:v |version )?2 0
ogl-uk-3.0 | open government licence | open government licence v3 0
ogl-uk | open government licence | contains public sector information licensed under the open government licence
cdla-permissive-2.0 | community data license agreement | community data license agreement permissive version 2 0
cdla-sharing-1.0 | community data license agreement | community data license agreement sharing version 1 0
ofl-1.1 | sil open font license version 1 1 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved font name | with reserved font name
ubuntu-font-1.0 | ubuntu font licence | ubuntu font licence version 1 0
bitstream-vera | bitstream vera | copyright c 2003 by bitstream inc all rights reserved bitstream vera is a trademark
arphic-1999 | arphic public license | arphic public license
gust-font | gust font license | gust font license
beerware | beer in return | you can buy me a beer in return
json | used for good not evil | the software shall be used for good not evil
curl | copyright holder shall not be used | except as contained in this notice the name of a copyright holder shall not be used in advertising
python-2.0 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
python-2.0 | python software foundation license version 2 | python software foundation license version 2
cnri-python | cnri hereby grants | cnri hereby grants licensee a nonexclusive royalty free world wide license
php-3.01 | php software | this product includes php software freely available from
php-3.0 | php license version 3 0 | the php license version 3 0
ruby | 2 clause bsdl | you can redistribute it and or modify it under either the terms of the 2 clause bsdl
ruby | ruby s license | ruby s license
vim | vim is charityware | vim is charityware
tcl | originating in | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose (?:\\S+ ){0,60}?originating in|this software is copyrighted by the regents of the university of california sun microsystems inc (?:\\S+ ){0,30}?originating in
w3c | world wide web consortium | (?:copyright|by) (?:c )?(?:\\S+ ){0,4}?world wide web consortium (?:\\S+ ){0,20}?all rights reserved
w3c | this work is being provided | this work is being provided by the copyright holders under the following license
unicode-dfs-2016 | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode-tou | unicode terms of use | unicode terms of use
ncsa | illinois | university of illinois ncsa open source license
sleepycat | accompanying software that uses | information on how to obtain complete source code for the db software and any accompanying software that uses the db software
openldap-2.8 | openldap public license version 2 8 | the openldap public license version 2 8
ms-pl | microsoft public license | this license governs use of the accompanying software (?:\\S+ ){0,40}?microsoft public license|microsoft public license ms pl
ms-rl | reciprocal grants | reciprocal grants for any file you distribute that contains code from the software
ms-lpl | windows platform | the software is licensed as is (?:\\S+ ){0,60}?only run on a microsoft windows platform
ms-lpl | microsoft limited | microsoft limited public license
lppl-1.3c | latex project public license | this work may be distributed and or modified under the conditions of the latex project public license
lppl | status maintained | this work has the lppl maintenance status maintained
qpl-1.0 | q public license | the q public license version 1 0
nosl | netizen open source | netizen open source license
nasa-1.3 | nasa open source agreement | nasa open source agreement version 1 3
naumen | naumen | this product includes software developed by naumen
nokia | nokia open source | nokia open source license
intel | intel open source | intel open source license
jasper-2.0 | jasper license version 2 0 | jasper license version 2 0
info-zip | info zip | this is version (?:\\S+ ){1,6}?of the info zip (?:copyright and )?license
ftl | freetype project | portions of this software are copyright (?:\\S+ ){0,6}?the freetype project
mulan-psl-2.0 | mulan psl v2 | (?:licensed under|you can use this software according to the terms and conditions of the) mulan psl v2
mulan-psl-1.0 | mulan psl v1 | (?:licensed under|you can use this software according to the terms and conditions of the) mulan psl v1
zpl-2.1 | zope public license | subject to the provisions of the zope public license version 2 1
apsl-2.0 | apple public source license | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license version 2 0
rpl-1.5 | reciprocal public license | unless explicitly acquired and licensed from licensor under another license the contents of this file are subject to the reciprocal public license
sspl-1.0 | server side public license | it under the terms of the server side public license version 1
busl-1.1 | business source license | (?:use of this software is governed by|licensed under) the business source license
busl-1.1 | change license | change date (?:\\S+ ){1,12}?change license
elastic-2.0 | elastic license 2 0 | elastic license 2 0
confluent-community-1.0 | confluent community license | confluent community license (?:agreement )?version 1 0
commons-clause | commons clause | commons clause license condition v1 0|without limiting other conditions in the license the grant of rights under the license will not include (?:\\S+ ){0,12}?commons clause
polyform-noncommercial-1.0.0 | polyform noncommercial | polyform noncommercial license 1 0 0
polyform-shield-1.0.0 | polyform shield | polyform shield license 1 0 0
parity-7.0.0 | parity public license | the parity public license 7 0 0
blueoak-1.0.0 | blue oak model license | blue oak model license (?:version )?1 0 0
hippocratic-2.1 | hippocratic license | hippocratic license (?:version )?2 1
fair | this instrument | usage of the works is permitted provided that this instrument is retained with the works
upl-1.0 | universal permissive license | universal permissive license (?:upl )?version 1 0
ecl-2.0 | educational community license | licensed under the educational community license version 2 0
eudatagrid | eu datagrid | this software includes voluntary contributions made to the eu datagrid
entessa | openseal | this product includes open source software developed by openseal
condor | condor public license | condor public license
condor | condor software program | the condor software program
cube | cube game engine | cube game engine source code
cua-opl-1.0 | cua office public license | cua office public license version 1 0
sissl | sun industry standards source license | sun industry standards source license
spl-1.0 | sun public license | sun public license version 1 0
watcom-1.0 | sybase open watcom | sybase open watcom public license
xnet | x net | x net inc license|x net license
gsoap-1.3b | gsoap public license | gsoap public license version 1 3
motosoto | motosoto open source | motosoto open source license
multics | multics | this edition of the multics software materials and documentation provided and donated
oclc-2.0 | oclc research public license | oclc research public license 2 0
ogtsl | open group test suite | the open group test suite license
phorum-2.0 | phorum license | phorum license
rscpl | ricoh source code public license | ricoh source code public license
vsl-1.0 | vovida software license | vovida software license
vostrom | vostrom | vostrom public license for open source
rail | responsible ai license | (?:open|creative ml|bigscience) (?:\\S+ ){0,3}?responsible ai license
rail | openrail | openrail m
llama-2 | llama 2 community license | llama 2 community license agreement
llama-3 | llama 3 community license | (?:meta )?llama 3 community license agreement
gemma | gemma terms of use | gemma is provided under and subject to the gemma terms of use|gemma terms of use
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary) (?:\\S+ ){0,12}?(?:unauthorized copying|do not distribute|property of)
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | trade secret | contains (?:\\S+ ){0,6}?trade secrets? (?:\\S+ ){0,6}?(?:dissemination|reproduction|disclosure)
proprietary | end user license agreement | by (?:installing|using|downloading) (?:\\S+ ){1,10}?you agree to (?:\\S+ ){0,8}?end user license agreement
"""

#: Identifiers that stand in a file's head, and titles of licenses.
IDENTIFIERS = """
mit | license identifier mit | spdx license identifier mit
mit-0 | license identifier mit 0 | spdx license identifier mit 0
isc | license identifier isc | spdx license identifier isc
0bsd | license identifier 0bsd | spdx license identifier 0bsd
apache-2.0 | license identifier apache 2 0 | spdx license identifier apache 2 0
bsd-2-clause | license identifier bsd 2 clause | spdx license identifier bsd 2 clause
bsd-3-clause | license identifier bsd 3 clause | spdx license identifier bsd 3 clause
gpl-2.0-only | license identifier gpl 2 0 | spdx license identifier gpl 2 0 only
gpl-2.0-or-later | license identifier gpl 2 0 | spdx license identifier gpl 2 0 or later
gpl-3.0-only | license identifier gpl 3 0 | spdx license identifier gpl 3 0 only
gpl-3.0-or-later | license identifier gpl 3 0 | spdx license identifier gpl 3 0 or later
lgpl-2.1-or-later | license identifier lgpl 2 1 | spdx license identifier lgpl 2 1 or later
lgpl-3.0-or-later | license identifier lgpl 3 0 | spdx license identifier lgpl 3 0 or later
agpl-3.0-or-later | license identifier agpl 3 0 | spdx license identifier agpl 3 0 or later
mpl-2.0 | license identifier mpl 2 0 | spdx license identifier mpl 2 0
epl-2.0 | license identifier epl 2 0 | spdx license identifier epl 2 0
bsl-1.0 | license identifier bsl 1 0 | spdx license identifier bsl 1 0
zlib | license identifier zlib | spdx license identifier zlib
unlicense | license identifier unlicense | spdx license identifier unlicense
cc0-1.0 | license identifier cc0 1 0 | spdx license identifier cc0 1 0
cc-by-4.0 | license identifier cc by 4 0 | spdx license identifier cc by 4 0
cc-by-sa-4.0 | license identifier cc by sa 4 0 | spdx license identifier cc by sa 4 0
mit | osi approved mit license | license osi approved mit license
apache-2.0 | osi approved apache software license | license osi approved apache software license
bsd | osi approved bsd license | license osi approved bsd license
gpl | osi approved gnu general public license | license osi approved gnu general public license
lgpl | osi approved gnu lesser | license osi approved gnu lesser general public license
mpl-2.0 | osi approved mozilla | license osi approved mozilla public license 2 0
isc | osi approved isc license | license osi approved isc license
psf-2.0 | osi approved python software | license osi approved python software foundation license
"""


def rows(table: str) -> list[tuple[str, str, str]]:
    """(label, keyword, pattern) of each line."""
    return [tuple(part.strip() for part in line.split(" | ")) for line in table.strip().splitlines()]
