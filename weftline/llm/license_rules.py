"""The ordered license signature rules: label, priority (less wins), keyword, regex, weight."""

from __future__ import annotations

import re

#: label | keyword that a document must hold (lower case) | how the license is named in prose.
NAMES = r"""
gpl-3.0|gnu|gnu\s+(?:general\s+public\s+licen[sc]e|gpl)[\s,(]*(?:version\s*|v\.?\s*)?3(?:\.0)?
gpl-2.0|gnu|gnu\s+(?:general\s+public\s+licen[sc]e|gpl)[\s,(]*(?:version\s*|v\.?\s*)?2(?:\.0)?
gpl-1.0|gnu|gnu\s+(?:general\s+public\s+licen[sc]e|gpl)[\s,(]*(?:version\s*|v\.?\s*)1(?:\.0)?
gpl|gnu|gnu\s+general\s+public\s+licen[sc]e
lgpl-3.0|gnu|gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?3(?:\.0)?
lgpl-2.1|gnu|gnu\s+lesser\s+general\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?2\.1
lgpl-2.0|gnu|gnu\s+library\s+general\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?2(?:\.0)?
lgpl|gnu|gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e
agpl-3.0|affero|(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?3(?:\.0)?
agpl|affero|(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e
gfdl-1.3|gnu|gnu\s+free\s+documentation\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.3
gfdl-1.2|gnu|gnu\s+free\s+documentation\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.2
gfdl|gnu|gnu\s+free\s+documentation\s+licen[sc]e
apache-2.0|apache|apache\s+(?:software\s+)?licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?2(?:\.0)?
apache-1.1|apache|apache\s+(?:software\s+)?licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.1
apache-1.0|apache|apache\s+(?:software\s+)?licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)1\.0
apache|apache|apache\s+(?:software\s+)?licen[sc]e
mit|mit|\bmit\s+licen[sc]e
mit|mit|\bmit/x11\s+licen[sc]e
mit|expat|\bexpat\s+licen[sc]e
mit-0|mit|\bmit\s+no\s+attribution\s+licen[sc]e
x11|x11|\bx11\s+licen[sc]e
bsd-2-clause|bsd|(?:simplified|freebsd|2[\s-]clause|two[\s-]clause)\s+bsd\s+licen[sc]e
bsd-2-clause|bsd|bsd[\s-](?:2|two)[\s-]clause(?:\s+licen[sc]e)?
bsd-3-clause|bsd|(?:modified|revised|new|3[\s-]clause|three[\s-]clause)\s+bsd\s+licen[sc]e
bsd-3-clause|bsd|bsd[\s-](?:3|three)[\s-]clause(?:\s+licen[sc]e)?
bsd-4-clause|bsd|(?:original|4[\s-]clause|four[\s-]clause)\s+bsd\s+licen[sc]e
bsd|bsd|\bbsd\s+licen[sc]e
0bsd|bsd|(?:zero[\s-]clause\s+bsd|bsd\s+zero[\s-]clause)(?:\s+licen[sc]e)?
isc|isc|\bisc\s+licen[sc]e
mpl-2.0|mozilla|mozilla\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?2(?:\.0)?
mpl-1.1|mozilla|mozilla\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.1
mpl-1.0|mozilla|mozilla\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.0
mpl|mozilla|mozilla\s+public\s+licen[sc]e
epl-2.0|eclipse|eclipse\s+public\s+licen[sc]e[\s,(-]*(?:version\s*|v\.?\s*)?2(?:\.0)?
epl-1.0|eclipse|eclipse\s+public\s+licen[sc]e[\s,(-]*(?:version\s*|v\.?\s*)?1(?:\.0)?
epl|eclipse|eclipse\s+public\s+licen[sc]e
edl-1.0|eclipse|eclipse\s+distribution\s+licen[sc]e
cddl-1.1|common|common\s+development\s+and\s+distribution\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.1
cddl-1.0|common|common\s+development\s+and\s+distribution\s+licen[sc]e
cpl-1.0|common|common\s+public\s+licen[sc]e
cpal-1.0|common|common\s+public\s+attribution\s+licen[sc]e
eupl-1.2|european|european\s+union\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.2
eupl-1.1|european|european\s+union\s+public\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.1
eupl|european|european\s+union\s+public\s+licen[sc]e
bsl-1.0|boost|boost\s+software\s+licen[sc]e
busl-1.1|business|business\s+source\s+licen[sc]e
sspl-1.0|server|server\s+side\s+public\s+licen[sc]e
elastic-2.0|elastic|elastic\s+licen[sc]e(?:\s+(?:version\s*|v\.?\s*)?2(?:\.0)?)?
artistic-2.0|artistic|artistic\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?2(?:\.0)?
artistic-1.0|artistic|artistic\s+licen[sc]e[\s,(]*(?:version\s*|v\.?\s*)?1\.0
artistic|artistic|artistic\s+licen[sc]e
zlib|zlib|\bzlib(?:/libpng)?\s+licen[sc]e
libpng|libpng|\blibpng\s+licen[sc]e
unlicense|unlicen|the\s+unlicen[sc]e
wtfpl|want|do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[sc]e
psf-2.0|python|python\s+software\s+foundation\s+licen[sc]e
php-3.01|php|\bphp\s+licen[sc]e
ruby|ruby|\bruby\s+licen[sc]e
postgresql|postgresql|\bpostgresql\s+licen[sc]e
openssl|openssl|\bopenssl\s+licen[sc]e
ms-pl|microsoft|microsoft\s+public\s+licen[sc]e
ms-rl|microsoft|microsoft\s+reciprocal\s+licen[sc]e
ofl-1.1|font|(?:sil\s+)?open\s+font\s+licen[sc]e
osl-3.0|open|open\s+software\s+licen[sc]e
afl-3.0|academic|academic\s+free\s+licen[sc]e
ecl-2.0|educational|educational\s+community\s+licen[sc]e
ncsa|ncsa|\bncsa\s+open\s+source\s+licen[sc]e
upl-1.0|universal|universal\s+permissive\s+licen[sc]e
vim|vim|\bvim\s+licen[sc]e
w3c|w3c|\bw3c\s+software\s+(?:notice\s+and\s+)?licen[sc]e
cecill-2.1|cecill|cecill(?:[\s-]free\s+software)?[\s-]licen[sc]e
odbl-1.0|database|open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e
odc-by-1.0|data|open\s+data\s+commons\s+attribution\s+licen[sc]e
cc0-1.0|cc0|\bcc0(?:[\s-]1\.0)?(?:\s+universal)?
cc-by-nc-nd|cc|\bcc[\s-]by[\s-]nc[\s-]nd(?:[\s-][1-4]\.0)?
cc-by-nc-sa|cc|\bcc[\s-]by[\s-]nc[\s-]sa(?:[\s-][1-4]\.0)?
cc-by-nc|cc|\bcc[\s-]by[\s-]nc(?:[\s-][1-4]\.0)?
cc-by-nd|cc|\bcc[\s-]by[\s-]nd(?:[\s-][1-4]\.0)?
cc-by-sa|cc|\bcc[\s-]by[\s-]sa(?:[\s-][1-4]\.0)?
cc-by|cc|\bcc[\s-]by(?:[\s-][1-4]\.0)?
cc-by-nc-nd|creative|creative\s+commons\s+attribution[\s-]non-?commercial[\s-]no-?deriv\w*
cc-by-nc-sa|creative|creative\s+commons\s+attribution[\s-]non-?commercial[\s-]share-?alike
cc-by-nc|creative|creative\s+commons\s+attribution[\s-]non-?commercial
cc-by-nd|creative|creative\s+commons\s+attribution[\s-]no-?deriv\w*
cc-by-sa|creative|creative\s+commons\s+attribution[\s-]share-?alike
cc-by|creative|creative\s+commons\s+attribution
openrail|rail|(?:open|big\w*)[\s-]*(?:&\s*)?rail(?:[\s-]*[+]?[+]?-?m)?\s+licen[sc]e
llama|llama|\bllama\s+[234](?:\.\d)?\s+community\s+licen[sc]e
proprietary|proprietary|proprietary\s+(?:and\s+confidential|licen[sc]e)
"""

#: Texts and addresses that show a license by themselves.
TEXTS = r"""
mit|permission|permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy
isc|permission|permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose
bsd|redistribution|redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms
bsd-3-clause|endorse|neither\s+the\s+name\s+of\s+.{1,80}?\s+nor\s+the\s+names\s+of\s+its\s+contributors\s+may\s+be\s+used\s+to\s+endorse
bsd-4-clause|advertising|all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software
gpl|redistribute|you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+licen[sc]e
lgpl|redistribute|you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+licen[sc]e
agpl|redistribute|you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+licen[sc]e
apache-2.0|compliance|you\s+may\s+not\s+use\s+this\s+(?:file|work)\s+except\s+in\s+compliance\s+with\s+the\s+licen[sc]e
mpl-2.0|mozilla|this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[sc]e
unlicense|public|this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
zlib|warranty|this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty
bsl-1.0|boost|distributed\s+under\s+the\s+boost\s+software\s+licen[sc]e
public-domain|public|(?:released|placed|dedicated|put)\s+(?:in)?to\s+the\s+public\s+domain
public-domain|public|(?:is|are)\s+in\s+the\s+public\s+domain
all-rights-reserved|rights|all\s+rights\s+reserved
gpl-3.0|gnu|gnu\.org/licen[sc]es/gpl-3\.0
gpl-2.0|gnu|gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0
gpl|gnu|gnu\.org/licen[sc]es/gpl
lgpl|gnu|gnu\.org/licen[sc]es/lgpl
agpl|gnu|gnu\.org/licen[sc]es/agpl
apache-2.0|apache|apache\.org/licen[sc]es/license-2\.0
mit|opensource|opensource\.org/licen[sc]es?/mit
bsd-3-clause|opensource|opensource\.org/licen[sc]es?/bsd-3-clause
bsd-2-clause|opensource|opensource\.org/licen[sc]es?/bsd-2-clause
isc|opensource|opensource\.org/licen[sc]es?/isc
mpl-2.0|mozilla|mozilla\.org/(?:en-us/)?mpl/2\.0
epl-2.0|eclipse|eclipse\.org/legal/epl-(?:2\.0|v20)
epl-1.0|eclipse|eclipse\.org/legal/epl-v10
bsl-1.0|boost|boost\.org/license_1_0
unlicense|unlicen|unlicen[sc]e\.org
cc0-1.0|creative|creativecommons\.org/publicdomain/zero/1\.0
public-domain|creative|creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd|creative|creativecommons\.org/licen[sc]es/by-nc-nd/[1-4]\.0
cc-by-nc-sa|creative|creativecommons\.org/licen[sc]es/by-nc-sa/[1-4]\.0
cc-by-nc|creative|creativecommons\.org/licen[sc]es/by-nc/[1-4]\.0
cc-by-nd|creative|creativecommons\.org/licen[sc]es/by-nd/[1-4]\.0
cc-by-sa|creative|creativecommons\.org/licen[sc]es/by-sa/[1-4]\.0
cc-by|creative|creativecommons\.org/licen[sc]es/by/[1-4]\.0
wtfpl|wtf|\bwtfpl\b
ofl-1.1|sil.org|scripts\.sil\.org/ofl
"""

#: Sentences by which license texts, headers and notices are told apart; a space stands for any white space.
SENTENCES = r"""
mit|permission|the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|sublicense|rights to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell
mit-0|permission|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{0,40}to deal in the software without restriction, including without limitation
x11|advertising|shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software
isc|permission|provided that the above copyright notice and this permission notice appear in all copies
0bsd|permission|permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
hpnd|permission|permission to use, copy, modify,? and distribute this software and its documentation for any purpose
bsd-2-clause|binary|redistributions in binary form must reproduce the above copyright notice
bsd|redistribut|redistributions of source code must retain the above copyright notice
bsd-3-clause|endorse|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause-clear|patent|no express or implied licenses to any party's patent rights are granted by this license
bsd-source-code|endorse|nor the names of its contributors may be used to endorse
apache-2.0|compliance|except in compliance with the license\. you may obtain a copy of the license at
apache-2.0|conditions|distributed on an "as is" basis, without warranties or conditions of any kind
apache-2.0|perpetual|perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
apache-2.0|litigation|if you institute patent litigation against any entity
apache-2.0|attribution|readable copy of the attribution notices contained within such notice file
apache-1.1|apache|this product includes software developed by the apache software foundation
apache-1.1|apache|products derived from this software may not be called "?apache
bsd-4-clause|acknowledg|must display the following acknowledg(?:e)?ment: this product includes software developed by
gpl|warranty|this program comes with absolutely no warranty
gpl|redistribute|this is free software, and you are welcome to redistribute it under certain conditions
gpl-2.0|option|either version 2 of the license, or \(at your option\) any later version
gpl-3.0|option|either version 3 of the license, or \(at your option\) any later version
gpl|received|you should have received a copy of the gnu general public license
lgpl|received|you should have received a copy of the gnu lesser general public license
lgpl|received|you should have received a copy of the gnu library general public license
agpl|received|you should have received a copy of the gnu affero general public license
gpl-3.0|copyleft|the gnu general public license is a free, copyleft license for software and other kinds of works
gpl-2.0|freedom|the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0|freedom|the licenses for most software and other practical works are designed to take away your freedom
agpl-3.0|network|remote network interaction; use with the gnu general public license
lgpl-2.1|successor|this is the first released version of the lesser gpl\. it also counts as the successor of the gnu library public license
lgpl-3.0|incorporates|this version of the gnu lesser general public license incorporates the terms and conditions of version 3
gpl-exception|exception|as a special exception,? (?:the copyright holders? (?:of|give)|you may use|if you link|linking)
gpl-classpath|linking|linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-font|exception|as a special exception, if you create a document which uses this font
gcc-exception|exception|gcc runtime library exception
llvm-exception|exception|llvm exceptions to the apache 2\.0 license
gfdl|permission|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
mpl-1.1|contents|the contents of this file are subject to the mozilla public license
mpl-2.0|incompatible|this source code form is "?incompatible with secondary licenses
npl-1.1|netscape|subject to the netscape public license
epl-2.0|accompanying|this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0|contents|the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0|header|include this cddl header notice in each file
cpl-1.0|common|made available under the terms of the common public license
ipl-1.0|ibm|subject to the ibm public license|ibm public license version 1\.0
eupl|eupl|licensed under the eupl
eupl-1.2|commission|as soon they will be approved by the european commission - subsequent versions of the eupl
ms-pl|accept|if you use the software, you accept this license\. if you do not accept the license, do not use the software
bsl-1.0|permission|permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0|accompanying|see accompanying file license_1_0\.txt
busl-1.1|production|the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use
busl-1.1|change|on the change date, or the fourth anniversary of the first publicly available distribution
sspl-1.0|service|if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0|hosted|you may not provide the software to third parties as a hosted or managed service
commons-clause|commons|"?commons clause"? license condition
commons-clause|sell|the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software
polyform-nc|polyform|polyform noncommercial license
polyform-sb|polyform|polyform small business license
parity-7.0|parity|parity public license
prosperity-3.0|prosperity|prosperity public license
blueoak-1.0.0|blue|blue oak model license
artistic-1.0|artistic|the "?artistic license"?
artistic-2.0|modified|this license establishes the terms under which a given free software package may be copied, modified, distributed
zlib|misrepresented|the origin of this software must not be misrepresented
zlib|altered|altered source versions must be plainly marked as such
zlib|permission|permission is granted to anyone to use this software for any purpose, including commercial applications
libpng|contributing|the contributing authors and group 42, inc\. disclaim all warranties
ijg|independent|this software is based in part on the work of the independent jpeg group
unlicense|anyone|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
unlicense|jurisdictions|in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
cc0-1.0|waive|to the extent possible under law,? .{1,60}? has waived all copyright and related or neighboring rights
cc0-1.0|waive|affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
cc-by-4.0|attribution|this work is licensed under a creative commons attribution 4\.0 international license
cc-by-3.0|attribution|this work is licensed under a creative commons attribution 3\.0 unported license
cc-by-sa-4.0|alike|this work is licensed under a creative commons attribution-sharealike 4\.0 international license
cc-by-sa-3.0|alike|this work is licensed under a creative commons attribution-sharealike 3\.0 unported license
cc-by-nc-4.0|commercial|this work is licensed under a creative commons attribution-noncommercial 4\.0 international license
cc-by-nc-nd-4.0|deriv|this work is licensed under a creative commons attribution-noncommercial-noderivatives 4\.0 international license
cc-sampling|sampling|creative commons sampling plus
pddl-1.0|dedication|public domain dedication and licen[sc]e
odbl-1.0|database|made available under the open database license
ofl-1.1|font|this font software is licensed under the sil open font license
ofl-1.1|reserved|no modified version of the font software may use the reserved font name
ubuntu-font-1.0|ubuntu|ubuntu font licen[sc]e
bitstream-vera|vera|bitstream vera is a trademark
openssl|openssl|this product includes software developed by the openssl project
ssleay|cryptographic|this product includes cryptographic software written by eric young
curl|permission|permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
ntp|permission|permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted
python-2.0|psf|psf is making python available to licensee on an "as is" basis
python-2.0|beopen|beopen python open source license agreement
ruby|verbatim|you may make and give away verbatim copies of the source form of the software without restriction
php-3.01|php|this product includes php software, freely available from
vim|charityware|vim is charityware
beerware|beer|"?the beer-?ware license"?
json|evil|the software shall be used for good, not evil
postgresql|hereby|permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
unicode-dfs|unicode|unicode,? inc\. license agreement
w3c|w3c|w3c software (?:and document )?notice and license
icu|icu|icu license - icu
intel-simplified|intel|intel simplified software license
nvidia|nvidia|nvidia (?:source code|software|proprietary) license
oracle-bcl|oracle|oracle binary code license agreement
openrail|restrictions|use-based restrictions as referenced in paragraph 5
llama|llama|built with (?:meta )?llama|llama [234](?:\.\d)? is licensed under the llama
proprietary|unauthorized|unauthorized copying of this file,? via any medium,? is strictly prohibited
proprietary|confidential|this software is the confidential and proprietary information of
proprietary|permission|no part of this (?:publication|document|work|software) may be reproduced, .{1,80}? without the prior written permission
noncommercial|commercial|for (?:personal|academic|research) and non-?commercial use only
noncommercial|evaluation|licen[sc]ed for evaluation purposes only
"""

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|shared|offered)\s+under\s+(?:the\s+|an?\s+)?(?:terms\s+of\s+(?:the\s+)?)?"

#: A document without one of these, in either case, is matched by no rule (tests hold every branch of every rule against them).
SIGNS = r"licen[sc]e|licen[sc]ing|public\s+domain|all\s+rights\s+reserved|permission|redistribut|gnu\s+gpl|creative\s*commons|cc[\s-]by|cc0|bsd[\s-]+(?:\d|two|three|zero)[\s-]clause|zero[\s-]clause\s+bsd|advertising\s+materials|endorse|spdx|wtfpl|copyright|warranty|special\s+exception|library\s+exception|llvm\s+exceptions|this\s+library\s+statically|eupl|cddl|public\s+licen|bitstream\s+vera|charityware|beer-?ware|not\s+evil|group\s+42|independent\s+jpeg|this\s+product\s+includes|ibm\s+public|origin\s+of\s+this|altered\s+source|derived\s+from\s+this|anyone\s+is\s+free|extent\s+possible|affirmer|unauthorized\s+copying|is\s+the\s+confidential|commercial\s+use\s+only|remote\s+network|lesser\s+gpl|change\s+date|to\s+third\s+parties|attribution\s+notices|patent\s+litigation|verbatim\s+copies|built\s+with|in\s+paragraph\s+5|advertising\s+or\s+otherwise|written\s+permission|as\s+is.\s+basis|font\s+software|mozilla\.org|eclipse\.org|boost\.org|sil\.org|without\s+any\s+express|proprietary\s+and"


def _by_first_letter(branches: list[str]) -> str:
    """The same branches, which all begin with a letter, grouped by it: at most places in a text only one letter is compared with each group's."""
    by: dict[str, list[str]] = {}
    for b in branches:
        by.setdefault(b[0], []).append(b[1:])
    return f"(?=[{''.join(by)}])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by.items()) + ")"


#: Finds the SIGNS; no | but those between them stands outside of brackets.
GATE = "(?i)" + _by_first_letter(re.split(r"\|(?![^(]*\))", SIGNS))


def _lines(table: str) -> list[list[str]]:
    return [x.split("|", 2) for x in table.strip().splitlines()]


def rules() -> list[dict]:
    """All rules in order: identifier tags, license texts and addresses, sentences, grants, plain names.

    Written by hand are those of NAMES, TEXTS and SENTENCES (tests count them); tags and grants are made from the names.
    """
    out = []
    for label in dict.fromkeys(x[0] for x in _lines(NAMES)):
        tag = label.replace(".", r"\.")
        out.append((label, "spdx", rf"spdx-licen[sc]e-identifier:\s*\(?{tag}(?![\w.])(?:-only|-or-later|\+)?", 1.0))
    out += [(label, word, regex, 0.95) for label, word, regex in _lines(TEXTS)]
    out += [(label, word, regex.replace(" ", r"\s+"), 0.95) for label, word, regex in _lines(SENTENCES)]
    out += [(label, word, GRANT + regex.removeprefix(r"\b"), 0.9) for label, word, regex in _lines(NAMES)]
    out += [(label, word, regex, 0.6) for label, word, regex in _lines(NAMES)]
    # \b means other things to other regex engines beyond ASCII
    edges = lambda r: re.sub(r"\\b$", "(?![A-Za-z0-9_])", r.replace(r"\b", "(?<![A-Za-z0-9_])", 1) if r.startswith(r"\b") else r)
    return [{"label": label, "priority": i, "keyword": word, "regex": f"(?is){edges(regex)}", "weight": weight} for i, (label, word, regex, weight) in enumerate(out)]
