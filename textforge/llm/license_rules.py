"""Signature rules of the license scan, in order: of two rules of one class the
earlier wins where both match the same words.

A line is ``class label | keyword | pattern``. Patterns are regular expressions
over normalised words (ASCII lower case, one blank between words, so "2.0" reads
``2 0``); the keyword is a phrase that every match holds. Classes, the most
important first: 0 license body or tag, 1 notice, 2 reference or address, 3 name,
4 clue.
"""

from __future__ import annotations

#: How sure a detection of each class is.
CONFIDENCE = (1.0, 0.95, 0.8, 0.6, 0.3)

LINES = """
0 mit | spdx license identifier | spdx license identifier mit
0 mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
0 apache-2.0 | spdx license identifier apache | spdx license identifier apache 2 0
0 apache-1.1 | spdx license identifier apache | spdx license identifier apache 1 1
0 bsd-2-clause | spdx license identifier bsd | spdx license identifier bsd 2 clause
0 bsd-3-clause | spdx license identifier bsd | spdx license identifier bsd 3 clause
0 bsd-4-clause | spdx license identifier bsd | spdx license identifier bsd 4 clause
0 0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
0 gpl-1.0-only | spdx license identifier gpl | spdx license identifier gpl 1 0(?: only)?
0 gpl-2.0-only | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only)?
0 gpl-2.0-or-later | spdx license identifier gpl | spdx license identifier gpl 2 0 or later
0 gpl-3.0-only | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only)?
0 gpl-3.0-or-later | spdx license identifier gpl | spdx license identifier gpl 3 0 or later
0 lgpl-2.0-only | spdx license identifier lgpl | spdx license identifier lgpl 2 0(?: only)?
0 lgpl-2.0-or-later | spdx license identifier lgpl | spdx license identifier lgpl 2 0 or later
0 lgpl-2.1-only | spdx license identifier lgpl | spdx license identifier lgpl 2 1(?: only)?
0 lgpl-2.1-or-later | spdx license identifier lgpl | spdx license identifier lgpl 2 1 or later
0 lgpl-3.0-only | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only)?
0 lgpl-3.0-or-later | spdx license identifier lgpl | spdx license identifier lgpl 3 0 or later
0 agpl-3.0-only | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only)?
0 agpl-3.0-or-later | spdx license identifier agpl | spdx license identifier agpl 3 0 or later
0 mpl-1.1 | spdx license identifier mpl | spdx license identifier mpl 1 1
0 mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0
0 epl-1.0 | spdx license identifier epl | spdx license identifier epl 1 0
0 epl-2.0 | spdx license identifier epl | spdx license identifier epl 2 0
0 cddl-1.0 | spdx license identifier cddl | spdx license identifier cddl 1 0
0 eupl-1.2 | spdx license identifier eupl | spdx license identifier eupl 1 2
0 isc | spdx license identifier isc | spdx license identifier isc
0 zlib | spdx license identifier zlib | spdx license identifier zlib
0 bsl-1.0 | spdx license identifier bsl | spdx license identifier bsl 1 0
0 unlicense | spdx license identifier unlicense | spdx license identifier unlicense
0 wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
0 artistic-2.0 | spdx license identifier artistic | spdx license identifier artistic 2 0
0 cc0-1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
0 cc-by-4.0 | spdx license identifier cc by | spdx license identifier cc by 4 0
0 cc-by-sa-4.0 | spdx license identifier cc by | spdx license identifier cc by sa 4 0
0 cc-by-nc-4.0 | spdx license identifier cc by | spdx license identifier cc by nc 4 0
0 cc-by-nc-sa-4.0 | spdx license identifier cc by | spdx license identifier cc by nc sa 4 0
0 ofl-1.1 | spdx license identifier ofl | spdx license identifier ofl 1 1
0 postgresql | spdx license identifier postgresql | spdx license identifier postgresql
0 python-2.0 | spdx license identifier python | spdx license identifier python 2 0
0 ncsa | spdx license identifier ncsa | spdx license identifier ncsa
0 odbl-1.0 | spdx license identifier odbl | spdx license identifier odbl 1 0
0 unicode-3.0 | spdx license identifier unicode | spdx license identifier unicode (?:3 0|dfs 2016)
0 mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
0 mit | to deal in the software without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
0 mit-0 | to deal in the software without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
0 mit | all copies or substantial portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
0 isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0 0bsd | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0 hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
0 postgresql | without a written agreement is hereby granted | without fee and without a written agreement is hereby granted
0 bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
0 bsd-2-clause | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
0 bsd-3-clause | may be used to endorse or promote products | (?:neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their) contributors|the names? of [^ ]+(?: [^ ]+){0,8}) may be used to endorse or promote products derived from this software
0 bsd-4-clause | all advertising materials mentioning features or use | all advertising materials mentioning features or use of this software must display the following acknowledgement
0 zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
0 zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
0 apache-2.0 | terms and conditions for use reproduction and distribution | apache license version 2 0 january 2004 (?:http www apache org licenses )?terms and conditions for use reproduction and distribution
0 apache-2.0 | each contributor hereby grants to you | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
0 apache-1.1 | products derived from this software may not be called apache | products derived from this software may not be called apache nor may apache appear in their name
0 gpl-2.0-only | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
0 gpl-3.0-only | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
0 gpl-1.0-only | gnu general public license version 1 february 1989 | gnu general public license version 1 february 1989
0 lgpl-2.1-only | gnu lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
0 lgpl-3.0-only | gnu lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
0 lgpl-2.0-only | gnu library general public license version 2 june 1991 | gnu library general public license version 2 june 1991
0 agpl-3.0-only | gnu affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
0 gfdl-1.3 | gnu free documentation license version 1 3 3 november 2008 | gnu free documentation license version 1 3 3 november 2008
0 gpl | the licenses for most software | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
0 mpl-2.0 | mozilla public license version 2 0 1 definitions | mozilla public license version 2 0 1 definitions
0 mpl-2.0 | this source code form is | this source code form is subject to the terms of the mozilla public license v 2 0
0 mpl-1.1 | the contents of this file are | the contents of this file are subject to the mozilla public license version 1 1
0 epl-1.0 | eclipse public license v 1 0 the accompanying program | eclipse public license v 1 0 the accompanying program is provided under the terms
0 epl-2.0 | eclipse public license v 2 0 the accompanying program | eclipse public license v 2 0 the accompanying program is provided under the terms
0 unlicense | this is free and unencumbered software | this is free and unencumbered software released into the public domain
0 unlicense | anyone is free to copy modify publish | anyone is free to copy modify publish use compile sell or distribute this software
0 wtfpl | do what the fuck you want to | (?:you just )?do what the fuck you want to(?: public license)?
0 bsl-1.0 | boost software license version 1 0 | boost software license version 1 0 17(?:th)? august 2003
0 cc0-1.0 | creative commons legal code cc0 1 0 universal | creative commons legal code cc0 1 0 universal
0 cc0-1.0 | to the extent possible under law | to the extent possible under law (?:the person who associated cc0 with this work|[^ ]+(?: [^ ]+){0,6}) has waived all copyright
0 cc-by-4.0 | creative commons attribution 4 0 international public license | creative commons attribution 4 0 international public license
0 cc-by-sa-4.0 | 4 0 international public license | creative commons attribution share ?alike 4 0 international public license
0 cc-by-nc-4.0 | 4 0 international public license | creative commons attribution non ?commercial 4 0 international public license
0 cc-by-nd-4.0 | 4 0 international public license | creative commons attribution no ?derivatives 4 0 international public license
0 cc-by-nc-sa-4.0 | 4 0 international public license | creative commons attribution non ?commercial share ?alike 4 0 international public license
0 cc-by-nc-nd-4.0 | 4 0 international public license | creative commons attribution non ?commercial no ?derivatives 4 0 international public license
0 ofl-1.1 | sil open font license version 1 1 26 february 2007 | sil open font license version 1 1 26 february 2007
0 artistic-2.0 | everyone is permitted to copy and distribute verbatim copies | the artistic license 2 0 (?:[^ ]+ ){0,12}everyone is permitted to copy and distribute verbatim copies
0 ncsa | to deal with the software without restriction | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
0 python-2.0 | python software foundation license version 2 | python software foundation license version 2
0 vim | vim license | vim license(?: i)? there are no restrictions on distributing unmodified copies
0 beerware | you can buy me a beer | (?:we meet some day and you think this stuff is worth it )?you can buy me a beer in return
0 json | the software shall be used for good | the software shall be used for good not evil
0 sspl-1.0 | server side public license version 1 | server side public license version 1 october 16 2018
0 busl-1.1 | business source license 1 1 | business source license 1 1 (?:parameters|terms|license text)
0 elastic-2.0 | elastic license 2 0 acceptance | elastic license 2 0 acceptance
0 bigscience-rail | rail license dated | bigscience (?:open )?rail license dated
1 apache-2.0 | licensed under the apache license | licensed under the apache license version 2 0(?: the license)?
1 apache-2.0 | licensed under apache | licensed under apache(?: license)?(?: version| v)? 2 0
1 apache-2.0 | license for the specific language governing permissions | see the license for the specific language governing permissions and limitations under the license
1 apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license
1 apache-1.1 | licensed under the apache | licensed under the apache software license version 1 1
1 mit | licensed under the mit license | (?:is |are |be )?licensed under the mit license
1 mit | released under the mit license | (?:is |are )?released under the mit license
1 mit | distributed under the mit license | (?:is |are )?distributed under the mit license
1 mit | available under the mit license | (?:is |are )?(?:made )?available under the mit license
1 mit | under the terms of the mit license | under the terms of the mit license
1 mit | licensed under mit | licensed under mit
1 mit-0 | mit no attribution | (?:licensed|released|distributed) under the mit no attribution license
1 bsd-3-clause | under the bsd 3 clause | (?:licensed|released|distributed) under the bsd 3 clause license
1 bsd-2-clause | under the bsd 2 clause | (?:licensed|released|distributed) under the bsd 2 clause license
1 bsd | governed by a bsd style license | use of this source code is governed by a bsd style license
1 bsd | under the bsd license | (?:licensed|released|distributed) under the bsd license
1 bsd-3-clause | under the new bsd license | (?:licensed|released|distributed) under the new bsd license
1 bsd-2-clause | under the simplified bsd license | (?:licensed|released|distributed) under the simplified bsd license
1 gpl-3.0 | licensed under the gnu general public license version 3 | (?:this work is )?licensed under the gnu general public license version 3(?: 0)?
1 gpl-2.0 | licensed under the gnu general public license version 2 | (?:this work is )?licensed under the gnu general public license version 2(?: 0)?
1 gpl | licensed under the gnu general public license | (?:this work is )?licensed under the gnu general public license
1 gpl | under the terms of the gnu general public license | (?:redistribute it and or modify it )?under the terms of the gnu general public license(?: as published by the free software foundation)?
1 gpl-2.0-or-later | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 gpl-3.0-or-later | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gpl-2.0-only | gnu general public license version 2 as published | gnu general public license version 2 as published by the free software foundation
1 gpl-3.0-only | gnu general public license version 3 as published | gnu general public license version 3 as published by the free software foundation
1 gpl | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with
1 lgpl | you should have received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with
1 agpl | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with
1 lgpl | gnu lesser general public license | under the terms of the gnu lesser general public license(?: as published by the free software foundation)?
1 lgpl-2.1-or-later | either version 2 1 of the license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 lgpl-3.0-or-later | either version 3 of the license | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 lgpl | gnu library general public license | under the terms of the gnu library general public license
1 agpl | gnu affero general public license | under the terms of the gnu affero general public license(?: as published by the free software foundation)?
1 agpl-3.0-or-later | either version 3 of the license | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gfdl | gnu free documentation license | under the terms of the gnu free documentation license
1 mpl-2.0 | mozilla public license | under the (?:terms of the )?mozilla public license(?: version| v)? 2 0
1 mpl-1.1 | mozilla public license | under the (?:terms of the )?mozilla public license(?: version| v)? 1 1
1 mpl | mozilla public license | under the (?:terms of the )?mozilla public license
1 epl-1.0 | eclipse public license | under the (?:terms of the )?eclipse public license(?: version| v)? 1 0
1 epl-2.0 | eclipse public license | under the (?:terms of the )?eclipse public license(?: version| v)? 2 0
1 epl | eclipse public license | under the (?:terms of the )?eclipse public license
1 cddl | common development and distribution license | under the (?:terms of the )?common development and distribution license
1 eupl | european union public licence | under the (?:terms of the )?european union public licence
1 artistic | artistic license | under the (?:terms of the |same terms as perl itself and the )?artistic license
1 perl | under the same terms as perl | under the same terms as perl itself
1 python | python software foundation license | under the (?:terms of the )?python software foundation license
1 bsl-1.0 | boost software license | (?:distributed|licensed|released) under the boost software license version 1 0
1 isc | isc license | (?:distributed|licensed|released) under the (?:terms of the )?isc license
1 zlib | zlib license | (?:distributed|licensed|released) under the (?:terms of the )?zlib license
1 zlib | zlib libpng license | (?:distributed|licensed|released) under the (?:terms of the )?zlib libpng license
1 unlicense | unlicense | (?:distributed|licensed|released) under the unlicense
1 wtfpl | wtfpl | (?:distributed|licensed|released) under the wtfpl
1 cc-by-4.0 | creative commons attribution 4 0 | licensed under (?:a |the )?creative commons attribution 4 0 international license
1 cc-by-3.0 | creative commons attribution 3 0 | licensed under (?:a |the )?creative commons attribution 3 0(?: unported)? license
1 cc-by-sa-4.0 | 4 0 international license | licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international license
1 cc-by-sa-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution share ?alike 3 0(?: unported)? license
1 cc-by-nc-4.0 | 4 0 international license | licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international license
1 cc-by-nc-sa-4.0 | 4 0 international license | licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international license
1 cc-by-nc-nd-4.0 | 4 0 international license | licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative|atives|s) 4 0 international license
1 cc-by-nd-4.0 | 4 0 international license | licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative|atives|s) 4 0 international license
1 cc-by | licensed under | (?:is |are )?licensed under cc by
1 cc-by-sa | licensed under | (?:is |are )?licensed under cc by sa
1 cc-by-nc | licensed under | (?:is |are )?licensed under cc by nc
1 cc-by-nc-sa | licensed under | (?:is |are )?licensed under cc by nc sa
1 cc0-1.0 | cc0 | (?:dedicated|released|placed) (?:to|in|into) the public domain (?:under|using|via) cc0
1 public-domain | the public domain | (?:dedicated|released|placed) (?:to|in|into) the public domain
1 ofl-1.1 | sil open font license | licensed under the sil open font license(?: version 1 1)?
1 odbl-1.0 | open database license | (?:made )?available under the open database license
1 pddl-1.0 | public domain dedication and license | (?:under the )?open data commons public domain dedication and license
1 odc-by-1.0 | open data commons attribution license | (?:under the )?open data commons attribution license
1 proprietary | may not be reproduced | (?:no part of )?this (?:publication|work|document|software|material) may not be reproduced(?: in any form)?
1 proprietary | confidential and proprietary | (?:this (?:software|document|material) is )?confidential and proprietary
1 proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited
1 openrail | openrail | (?:distributed|licensed|released) under the (?:creativeml |bigcode )?openrail m(?: license)?
1 llama-community | community license | (?:licensed|released) under the llama [0-9]+(?: [0-9]+)? community license(?: agreement)?
1 busl-1.1 | business source license | (?:licensed|released) under the business source license(?: 1 1)?
1 sspl-1.0 | server side public license | (?:licensed|released) under the server side public license
2 apache-2.0 | www apache org licenses license 2 0 | (?:https? )?www apache org licenses license 2 0(?: txt| html)?
2 mit | opensource org licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
2 bsd-3-clause | opensource org licenses bsd 3 clause | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
2 bsd-2-clause | opensource org licenses bsd 2 clause | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
2 gpl | www gnu org licenses gpl | (?:https? )?www gnu org licenses gpl(?: [23] 0)?(?: html| txt)?
2 lgpl | www gnu org licenses lgpl | (?:https? )?www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
2 agpl | www gnu org licenses agpl | (?:https? )?www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
2 gfdl | www gnu org licenses fdl | (?:https? )?www gnu org licenses fdl(?: 1 [23])?(?: html| txt)?
2 gnu-unknown | www gnu org licenses | (?:https? )?www gnu org licenses
2 mpl-2.0 | mozilla org mpl 2 0 | (?:https? )?(?:www )?mozilla org mpl 2 0
2 epl | www eclipse org legal epl | (?:https? )?www eclipse org legal epl(?: v?[12]0?)?(?: html)?
2 cc-by | creativecommons org licenses by | (?:https? )?(?:www )?creativecommons org licenses by(?: [1-4] [05])?
2 cc-by-sa | creativecommons org licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa(?: [1-4] [05])?
2 cc-by-nc | creativecommons org licenses by nc | (?:https? )?(?:www )?creativecommons org licenses by nc(?: [1-4] [05])?
2 cc-by-nd | creativecommons org licenses by nd | (?:https? )?(?:www )?creativecommons org licenses by nd(?: [1-4] [05])?
2 cc-by-nc-sa | creativecommons org licenses by nc sa | (?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [1-4] [05])?
2 cc-by-nc-nd | creativecommons org licenses by nc nd | (?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [1-4] [05])?
2 cc0-1.0 | creativecommons org publicdomain zero 1 0 | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
2 public-domain | creativecommons org publicdomain mark 1 0 | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
2 bsl-1.0 | www boost org license 1 0 | (?:https? )?www boost org license 1 0 txt
2 unlicense | unlicense org | (?:https? )?(?:www )?unlicense org
2 wtfpl | www wtfpl net | (?:https? )?www wtfpl net
2 ofl-1.1 | scripts sil org ofl | (?:https? )?scripts sil org ofl
2 odbl-1.0 | opendatacommons org licenses odbl | (?:https? )?(?:www )?opendatacommons org licenses odbl
2 see-license | see the license file | see the license file(?: for (?:more )?details)?
2 see-license | see license file | see license file(?: for (?:more )?details)?
2 see-license | license terms | see (?:the )?license terms
3 gpl-3.0 | gnu general public license | gnu general public license(?: version| v)? 3(?: 0)?
3 gpl-2.0 | gnu general public license | gnu general public license(?: version| v)? 2(?: 0)?
3 gpl | gnu general public license | gnu general public license
3 gpl | gnu gpl | gnu gpl(?: v?[123])?
3 gpl | gplv2 | gplv2
3 gpl | gplv3 | gplv3
3 lgpl | gnu lesser general public license | gnu lesser general public license
3 lgpl | gnu library general public license | gnu library general public license
3 lgpl | gnu lgpl | gnu lgpl(?: v?[23](?: [01])?)?
3 agpl | gnu affero general public license | gnu affero general public license
3 agpl | gnu agpl | gnu agpl(?: v?3)?
3 gfdl | gnu free documentation license | gnu free documentation license
3 apache-2.0 | apache license | (?:the )?apache license(?: version| v)? 2 0
3 apache-2.0 | apache license | (?:the )?apache license(?: version| v)? 2
3 apache | apache license | apache license
3 apache | apache software license | apache software license
3 mit | mit license | (?:the )?mit license
3 mit | mit licence | (?:the )?mit licence
3 mit | expat license | (?:the )?expat license
3 mit | x11 license | (?:the )?x11 license
3 bsd-3-clause | 3 clause bsd license | (?:the )?3 clause bsd license
3 bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
3 bsd-2-clause | 2 clause bsd license | (?:the )?2 clause bsd license
3 bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
3 bsd | bsd license | (?:the )?bsd license
3 isc | isc license | (?:the )?isc license
3 zlib | zlib license | (?:the )?zlib license
3 mpl-2.0 | mozilla public license | mozilla public license(?: version| v)? 2 0
3 mpl | mozilla public license | mozilla public license
3 epl | eclipse public license | eclipse public license(?: v?[12] 0)?
3 cddl | common development and distribution license | common development and distribution license
3 eupl | european union public licence | european union public licence(?: v?1 [0-9])?
3 artistic | artistic license | artistic license(?: 2 0)?
3 bsl-1.0 | boost software license | boost software license
3 ofl-1.1 | open font license | (?:sil )?open font license
3 odbl-1.0 | open database license | open database license
3 python | python software foundation license | python software foundation license
3 cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
3 cc0-1.0 | creative commons zero | creative commons zero
3 cc-by-4.0 | cc by 4 0 | cc by 4 0
3 cc-by-3.0 | cc by 3 0 | cc by 3 0
3 cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
3 cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
3 cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
3 cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
3 cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
3 cc-by-nc-nd | cc by nc nd | cc by nc nd
3 cc-by-nc-sa | cc by nc sa | cc by nc sa
3 cc-by-nc | cc by nc | cc by nc
3 cc-by-nd | cc by nd | cc by nd
3 cc-by-sa | cc by sa | cc by sa
3 cc-by | cc by | cc by
3 cc-by-sa | creative commons attribution | creative commons attribution share ?alike(?: license)?
3 cc-by-nc | creative commons attribution | creative commons attribution non ?commercial(?: license)?
3 cc-by | creative commons attribution | creative commons attribution(?: license)?
3 cc-unknown | creative commons license | creative commons license
3 public-domain | public domain | (?:in )?the public domain
3 sspl-1.0 | server side public license | server side public license
3 busl-1.1 | business source license | business source license
4 all-rights-reserved | all rights reserved | all rights reserved
4 unknown-license | licensed under | (?:is |are )?licensed under
4 unknown-license | under the terms of the | under the terms of the (?:[^ ]+ ){0,4}licen[cs]e
4 unknown-license | open source license | open source license
4 unknown-license | open source licenses | open source licenses
4 warranty-disclaimer | without warranty of any kind | (?:provided )?(?:as is )?without warranty of any kind
4 warranty-disclaimer | without warranties or conditions of any kind | without warranties or conditions of any kind
4 warranty-disclaimer | merchantability or fitness | (?:implied )?(?:warranty|warranties) of merchantability or fitness for a particular purpose
4 copyright-notice | copyright c | copyright c [0-9]{4}(?: [0-9]{4}){0,20}
"""

#: Every keyword holds one of these; a text without any of them is not searched further.
GATES = (
    "licen", "software", "domain", "cc by", "cc0", "creative", "gnu", "gplv", "bsd", "attribution", "reserved",
    "advertising", "source", "copy", "proprietary", "contributor", "org ", "wtfpl", "openrail", "reproduced",
    "merchantability", "permission", "distribution", "compliance", "extent possible", "same terms", "under the terms",
    "written agreement", "warrant", "used to endorse", "do what the", "this file", "buy me a beer",
)
