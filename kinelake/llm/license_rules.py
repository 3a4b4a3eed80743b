"""Signature rules for licence detection, one per line.

Columns: priority (1 strongest), label, keyword, pattern.  Patterns are matched
against the text's words: lower case, runs of ASCII punctuation and white space
as one space.  ``$V`` is an optional "version", ``$GAP`` up to 12 words, ``$ANY`` up
to 30, ``$BSD`` up to 120 without an advertising clause.  The keyword is a literal that any match contains; rules whose keyword does not occur
in a text are not tried.
"""

RULES = r"""
1 mit|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit|without restriction|deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
2 mit|mit license|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
2 mit|mit licence|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licence
2 mit|spdx|spdx license identifier mit
3 mit|mit license|the mit license
3 mit|mit licence|the mit licence
3 mit|mit licensed|mit licensed
4 mit|mit license|mit license
4 mit|license mit|license mit
4 mit|licenses mit|opensource org licenses mit
2 mit-0|mit no attribution|mit no attribution(?: license)?
2 mit-0|spdx|spdx license identifier mit 0
3 x11|x11 license|x11 license
3 expat|expat license|expat license
1 apache-2|apache license|licensed under the apache license $V2(?: 0)?
1 apache-2|you may not use this file|you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
1 apache-2|apache license|apache license version 2 0 january 2004
2 apache-2|apache license|(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache license $V2(?: 0)?
2 apache-2|spdx|spdx license identifier apache 2 0
3 apache-2|apache license|apache license $V2(?: 0)?
3 apache-2|apache 2 0|apache 2 0(?: license| licence| licensed)?
3 apache-2|license 2 0|apache org licenses license 2 0
3 apache-2|apache software license|apache software license $V2(?: 0)?
3 apache-2|asl 2 0|asl 2 0
2 apache-1.1|apache|apache (?:software )?license $V1 1
2 apache-1|apache|apache (?:software )?license $V1 0
4 apache|apache license|apache license
4 apache|apache licensed|apache licensed
1 bsd-3|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted $BSDneither the name
1 bsd-3|neither the name|neither the name of $ANYnor the names of its contributors may be used to endorse or promote products
2 bsd|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted
2 bsd-3|spdx|spdx license identifier bsd 3 clause
2 bsd-2|spdx|spdx license identifier bsd 2 clause
2 bsd-4|all advertising materials|all advertising materials mentioning features or use of this software must display
3 bsd-3|bsd 3 clause|bsd 3 clause(?: license| licence)?
3 bsd-2|bsd 2 clause|bsd 2 clause(?: license| licence)?
3 bsd-4|bsd 4 clause|bsd 4 clause(?: license| licence)?
3 bsd-3|3 clause bsd|3 clause bsd(?: license| licence)?
3 bsd-2|2 clause bsd|2 clause bsd(?: license| licence)?
3 bsd-3|three clause bsd|three clause bsd(?: license| licence)?
3 bsd-2|two clause bsd|two clause bsd(?: license| licence)?
3 bsd-3|new bsd|new bsd license
3 bsd-3|modified bsd|modified bsd license
3 bsd-3|revised bsd|revised bsd license
3 bsd-2|simplified bsd|simplified bsd license
3 bsd-2|freebsd license|freebsd license
3 0bsd|zero clause bsd|zero clause bsd(?: license)?
3 0bsd|0bsd|0bsd
3 bsd|bsd license|under (?:the |a )?bsd license
4 bsd|bsd license|bsd license
4 bsd|bsd licensed|bsd licensed
4 bsd|bsd style|bsd style license
1 gpl-3|gnu general public license|free software you can redistribute it and or modify it under the terms of the gnu general public license $GAPversion 3
1 gpl-2|gnu general public license|free software you can redistribute it and or modify it under the terms of the gnu general public license $GAPversion 2
1 gpl-3|29 june 2007|gnu general public license version 3 29 june 2007
1 gpl-2|june 1991|gnu general public license version 2 june 1991
2 gpl|gnu general public license|under the terms of (?:the )?gnu general public license
2 gpl-3|gnu general public license|gnu general public license (?:as published by the free software foundation (?:inc )?)?(?:either )?$V3(?: 0)?
2 gpl-2|gnu general public license|gnu general public license (?:as published by the free software foundation (?:inc )?)?(?:either )?$V2(?: 0)?
2 gpl-3|spdx|spdx license identifier gpl 3 0(?: only| or later)?
2 gpl-2|spdx|spdx license identifier gpl 2 0(?: only| or later)?
3 gpl-3|gplv3|gplv3(?: or later)?
3 gpl-2|gplv2|gplv2(?: or later)?
3 gpl-3|gpl|gpl (?:$V3|v3)(?: 0)?
3 gpl-2|gpl|gpl (?:$V2|v2)(?: 0)?
3 gpl|gnu gpl|gnu gpl
3 gpl|gnu general public|gnu general public licen[cs]e
4 gpl|general public license|general public license
4 gpl|gpl licensed|gpl licensed
4 gpl|gpl license|gpl license
1 lgpl-2.1|february 1999|gnu lesser general public license version 2 1 february 1999
1 lgpl-3|29 june 2007|gnu lesser general public license version 3 29 june 2007
2 lgpl|gnu lesser general public license|under the terms of (?:the )?gnu lesser general public license
2 lgpl|gnu library general public license|gnu library general public license
2 lgpl-3|gnu lesser general public license|gnu lesser general public license (?:as published by the free software foundation (?:inc )?)?(?:either )?$V3(?: 0)?
2 lgpl-2.1|gnu lesser general public license|gnu lesser general public license (?:as published by the free software foundation (?:inc )?)?(?:either )?$V2 1
2 lgpl-3|spdx|spdx license identifier lgpl 3 0(?: only| or later)?
2 lgpl-2.1|spdx|spdx license identifier lgpl 2 1(?: only| or later)?
3 lgpl-3|lgplv3|lgplv3(?: or later)?
3 lgpl-2.1|lgplv2|lgplv2(?: 1)?(?: or later)?
3 lgpl-3|lgpl|lgpl (?:$V3|v3)(?: 0)?
3 lgpl-2.1|lgpl|lgpl (?:$V2|v2) 1
3 lgpl|lesser general public|lesser general public licen[cs]e
4 lgpl|gnu lgpl|gnu lgpl
4 lgpl|lgpl license|lgpl license
1 agpl-3|19 november 2007|gnu affero general public license version 3 19 november 2007
2 agpl-3|gnu affero general public license|gnu affero general public license (?:as published by the free software foundation (?:inc )?)?(?:either )?$V3(?: 0)?
2 agpl|gnu affero general public license|gnu affero general public license
2 agpl-3|spdx|spdx license identifier agpl 3 0(?: only| or later)?
3 agpl-3|agplv3|agplv3(?: or later)?
3 agpl-3|agpl|agpl (?:$V3|v3)(?: 0)?
3 agpl|affero general public|affero general public licen[cs]e
4 agpl|gnu agpl|gnu agpl
2 gfdl|gnu free documentation license|under the terms of the gnu free documentation license
3 gfdl|gnu free documentation|gnu free documentation licen[cs]e
3 gfdl|gfdl|gfdl(?: 1 [0-9])?
1 mpl-2|mozilla public license|this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2|mozilla public license|mozilla public license (?:$V|v )2(?: 0)?
2 mpl-1.1|mozilla public license|mozilla public license (?:$V|v )1 1
2 mpl-2|spdx|spdx license identifier mpl 2 0
3 mpl-2|mpl 2 0|mpl 2 0
3 mpl-2|mplv2|mplv2
4 mpl|mozilla public license|mozilla public license
1 epl-2|eclipse public license|made available under the terms of the eclipse public license (?:$V|v )2 0
2 epl-2|eclipse public license|eclipse public license (?:$V|v )?2(?: 0)?
2 epl-1|eclipse public license|eclipse public license (?:$V|v )?1(?: 0)?
2 epl-2|spdx|spdx license identifier epl 2 0
3 epl-2|epl 2 0|epl 2 0
3 epl-1|epl 1 0|epl 1 0
4 epl|eclipse public license|eclipse public license
3 edl|eclipse distribution license|eclipse distribution license(?: 1 0| v 1 0)?
2 cddl-1|common development and distribution license|common development and distribution license (?:cddl )?(?:$V|v )?1 0
3 cddl-1|cddl 1 0|cddl 1 0
4 cddl|common development and distribution license|common development and distribution license
4 cddl|cddl license|cddl license
3 cpl|common public license|common public license(?: $V1 0)?
3 ipl|ibm public license|ibm public license(?: $V1 0)?
1 isc|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc|spdx|spdx license identifier isc
3 isc|isc license|isc license
3 isc|isc licence|isc licence
1 unlicense|free and unencumbered|this is free and unencumbered software released into the public domain
3 unlicense|the unlicense|the unlicense
4 unlicense|unlicense org|unlicense org
1 zlib|altered source versions|altered source versions must be plainly marked as such
3 zlib|zlib|zlib(?: libpng)? license
3 libpng|libpng license|libpng license
1 bsl-1|boost software license|boost software license version 1 0 august 17th 2003
2 bsl-1|boost software license|distributed under the boost software license
3 bsl-1|boost software license|boost software license(?: $V1 0)?
3 wtfpl|do what the fuck|do what the fuck you want to public license
3 wtfpl|wtfpl|wtfpl
1 artistic-2|artistic license|the artistic license 2 0
3 artistic-2|artistic license|artistic license (?:$V|v )?2(?: 0)?
4 artistic|artistic license|artistic license
3 perl|same terms as perl|under the same terms as perl(?: itself)?
2 python|python software foundation license|python software foundation license(?: agreement)?(?: $V2)?
3 python|psf license|psf license(?: agreement)?
3 ruby|ruby license|ruby license
3 php|php license|php license(?: $V3(?: 01)?)?
3 ofl|sil open font license|sil open font license(?: $V1 1)?
4 ofl|open font license|open font license
4 ofl|ofl 1 1|ofl 1 1
2 eupl|european union public licence|european union public licence(?: (?:$V|v )?1 [0-2])?
3 eupl|eupl|eupl(?: (?:v )?1 [0-2])?
3 cecill|cecill|cecill(?: [abc])?(?: license)?(?: 2 [01])?
3 ms-pl|microsoft public license|microsoft public license
3 ms-rl|microsoft reciprocal license|microsoft reciprocal license
3 ncsa|ncsa open source license|(?:university of illinois )?ncsa open source license
3 openssl|openssl|openssl(?: ssleay)? license
3 postgresql|postgresql licen|postgresql licen[cs]e
3 afl-3|academic free license|academic free license(?: (?:$V|v )?3(?: 0)?)?
3 osl-3|open software license|open software license(?: (?:$V|v )?3(?: 0)?)?
3 upl|universal permissive license|universal permissive license(?: (?:$V|v )?1(?: 0)?)?
3 blueoak|blue oak model license|blue oak model license(?: 1 0 0)?
3 mulan|mulan permissive software license|mulan permissive software license(?: (?:$V|v )?2)?
3 json|the software shall be used for good|the software shall be used for good not evil
3 beerware|beer ware license|beer ware license
3 w3c|w3c software|w3c software (?:notice and |and document )?license
3 unicode|unicode license|unicode license(?: agreement)?
3 vim|vim license|vim license
3 tcl|tcl tk license|tcl tk license
3 qpl|q public license|q public license
3 sleepycat|sleepycat license|sleepycat license
3 curl|curl license|curl license
3 ftl|freetype|freetype (?:project )?license
3 ijg|independent jpeg group|this software is based in part on the work of the independent jpeg group
3 naist|naist license|naist license
3 intel|intel open source license|intel open source license
3 lppl|latex project public license|latex project public license
1 cc0|cc0 1 0|cc0 1 0 universal
2 cc0|creative commons zero|creative commons zero(?: (?:$V|v )?1 0)?
2 cc0|spdx|spdx license identifier cc0 1 0
3 cc0|publicdomain zero|creativecommons org publicdomain zero
3 cc0|cc0|cc0(?: license| licence| licensed)?
2 cc-by-nc-nd|attribution noncommercial noderiv|creative commons attribution noncommercial noderiv(?:s|atives)(?: [1-4] [05])?
2 cc-by-nc-nd|attribution non commercial no deriv|creative commons attribution non commercial no deriv(?:s|atives)(?: works)?(?: [1-4] [05])?
2 cc-by-nc-sa|attribution noncommercial sharealike|creative commons attribution noncommercial sharealike(?: [1-4] [05])?
2 cc-by-nc-sa|attribution non commercial share alike|creative commons attribution non commercial share alike(?: [1-4] [05])?
2 cc-by-nc|attribution noncommercial|creative commons attribution noncommercial(?: [1-4] [05])?
2 cc-by-nc|attribution non commercial|creative commons attribution non commercial(?: [1-4] [05])?
2 cc-by-nd|attribution noderiv|creative commons attribution noderiv(?:s|atives)(?: [1-4] [05])?
2 cc-by-sa|attribution sharealike|creative commons attribution sharealike(?: [1-4] [05])?
2 cc-by-sa|attribution share alike|creative commons attribution share alike(?: [1-4] [05])?
3 cc-by|creative commons attribution|creative commons attribution(?: [1-4] [05])?
2 cc-by-nc-nd|cc by nc nd|cc by nc nd(?: [1-4] [05])?
2 cc-by-nc-sa|cc by nc sa|cc by nc sa(?: [1-4] [05])?
2 cc-by-nc|cc by nc|(?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nc(?: [1-4] [05])?
3 cc-by-nc|cc by nc|cc by nc(?: [1-4] [05])?
3 cc-by-nd|cc by nd|cc by nd(?: [1-4] [05])?
3 cc-by-sa|cc by sa|cc by sa(?: [1-4] [05])?
4 cc-by|cc by|cc by [1-4] [05]
3 cc-by-nc-nd|licenses by nc nd|creativecommons org licenses by nc nd(?: [1-4] [05])?
3 cc-by-nc-sa|licenses by nc sa|creativecommons org licenses by nc sa(?: [1-4] [05])?
3 cc-by-nc|licenses by nc|creativecommons org licenses by nc(?: [1-4] [05])?
3 cc-by-nd|licenses by nd|creativecommons org licenses by nd(?: [1-4] [05])?
3 cc-by-sa|licenses by sa|creativecommons org licenses by sa(?: [1-4] [05])?
4 cc-by|licenses by|creativecommons org licenses by(?: [1-4] [05])?
4 cc|creative commons licen|creative commons licen[cs]e
4 cc|some rights reserved|some rights reserved
3 odbl|open database license|open database license(?: odbl)?(?: (?:v )?1 0)?
3 odc-by|open data commons attribution|open data commons attribution(?: license)?(?: (?:v )?1 0)?
3 pddl|public domain dedication and license|(?:open data commons )?public domain dedication and license
3 cdla|community data license agreement|community data license agreement(?: permissive| sharing)?(?: 1 0| 2 0)?
3 ogl|open government licence|open government licence(?: v ?[123](?: 0)?)?
3 dbcl|database contents license|database contents license
3 openrail|rail|(?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?
3 bigscience|bigscience rail|bigscience rail license
3 llama|community license|llama(?: [23])?(?: [0-9])? community license(?: agreement)?
3 elastic-2|elastic license|elastic license(?: (?:v )?2(?: 0)?)?
3 sspl|server side public license|server side public license(?: $V1)?
3 busl|business source license|business source license(?: 1 1)?
3 commons-clause|commons clause|commons clause(?: license condition)?
3 public-domain|released into the public domain|released into the public domain
3 public-domain|dedicated to the public domain|(?:has been )?dedicated to the public domain
3 public-domain|placed in the public domain|(?:has been |is hereby )?placed in the public domain
4 public-domain|in the public domain|(?:is|are) in the public domain
2 proprietary|strictly prohibited|unauthorized (?:copying|reproduction|distribution) $ANYstrictly prohibited
3 proprietary|proprietary and confidential|proprietary and confidential
3 proprietary|may not be reproduced|may not be reproduced $ANYwithout (?:the )?(?:prior )?written permission
3 proprietary|end user license agreement|end user license agreement
4 all-rights-reserved|all rights reserved|all rights reserved
4 copyright|copyright c|copyright c (?:19|20)[0-9][0-9]
4 free|free for personal use|free for personal use(?: only)?
4 free|for non commercial use|for non commercial use only
4 open-source|open source licen|(?:an )?open source licen[cs]e
5 unknown|licensed under|licensed under (?:the |a )?[^ ]+(?: [^ ]+)? licen[cs]e
5 unknown|released under|released under (?:the |a )?[^ ]+(?: [^ ]+)? licen[cs]e
5 unknown|distributed under|distributed under (?:the |a )?[^ ]+(?: [^ ]+)? licen[cs]e
5 unknown|available under|available under (?:the |a )?[^ ]+(?: [^ ]+)? licen[cs]e
5 unknown|license|see (?:the )?license(?: file)? for (?:details|more information)
5 unknown|license file|see the license file
"""

MACROS = {"$V": "(?:version )?", "$ANY": "(?:[^ ]+ ){0,30}?", "$GAP": "(?:[^ ]+ ){0,12}?", "$BSD": "(?:(?!all advertising materials)[^ ]+ ){0,120}?"}
