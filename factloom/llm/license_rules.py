"""Signatures of licenses, ordered: what stands earlier has priority.

A line is ``weight label: pattern``. Patterns match folded words with single spaces
between them, so "CC BY-NC 4.0" is ``cc by nc 4 0``; a pattern begins and ends at
the bounds of words. The weight is how surely the words alone mean the license.
"""

RULES = r"""
0.99 spdx:agpl-3.0-or-later: spdx license identifier agpl 3 0 or later
0.99 spdx:agpl-3.0-only: spdx license identifier agpl 3 0(?: only)?
0.99 spdx:gpl-2.0-or-later: spdx license identifier gpl 2 0 or later
0.99 spdx:gpl-2.0-only: spdx license identifier gpl 2 0(?: only)?
0.99 spdx:gpl-3.0-or-later: spdx license identifier gpl 3 0 or later
0.99 spdx:gpl-3.0-only: spdx license identifier gpl 3 0(?: only)?
0.99 spdx:lgpl-2.1-or-later: spdx license identifier lgpl 2 1 or later
0.99 spdx:lgpl-2.1-only: spdx license identifier lgpl 2 1(?: only)?
0.99 spdx:lgpl-3.0-or-later: spdx license identifier lgpl 3 0 or later
0.99 spdx:lgpl-3.0-only: spdx license identifier lgpl 3 0(?: only)?
0.99 spdx:apache-2.0-with-llvm: spdx license identifier apache 2 0 with llvm exception
0.99 spdx:apache-2.0: spdx license identifier apache 2 0
0.99 spdx:apache-1.1: spdx license identifier apache 1 1
0.99 spdx:mit-0: spdx license identifier mit 0
0.99 spdx:mit: spdx license identifier mit
0.99 spdx:bsd-2-clause: spdx license identifier bsd 2 clause
0.99 spdx:bsd-3-clause: spdx license identifier bsd 3 clause
0.99 spdx:bsd-4-clause: spdx license identifier bsd 4 clause
0.99 spdx:0bsd: spdx license identifier 0bsd
0.99 spdx:isc: spdx license identifier isc
0.99 spdx:mpl-1.1: spdx license identifier mpl 1 1
0.99 spdx:mpl-2.0: spdx license identifier mpl 2 0
0.99 spdx:epl-1.0: spdx license identifier epl 1 0
0.99 spdx:epl-2.0: spdx license identifier epl 2 0
0.99 spdx:cddl-1.0: spdx license identifier cddl 1 0
0.99 spdx:cddl-1.1: spdx license identifier cddl 1 1
0.99 spdx:eupl-1.2: spdx license identifier eupl 1 2
0.99 spdx:bsl-1.0: spdx license identifier bsl 1 0
0.99 spdx:busl-1.1: spdx license identifier busl 1 1
0.99 spdx:cc0-1.0: spdx license identifier cc0 1 0
0.99 spdx:cc-by-4.0: spdx license identifier cc by 4 0
0.99 spdx:cc-by-sa-4.0: spdx license identifier cc by sa 4 0
0.99 spdx:cc-by-nc-4.0: spdx license identifier cc by nc 4 0
0.99 spdx:unlicense: spdx license identifier unlicense
0.99 spdx:zlib: spdx license identifier zlib
0.99 spdx:wtfpl: spdx license identifier wtfpl
0.99 spdx:artistic-2.0: spdx license identifier artistic 2 0
0.99 spdx:sspl-1.0: spdx license identifier sspl 1 0
0.99 spdx:psf-2.0: spdx license identifier psf 2 0
0.99 spdx:ofl-1.1: spdx license identifier ofl 1 1
0.99 spdx:odbl-1.0: spdx license identifier odbl 1 0
0.97 mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
0.97 mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
0.95 mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
0.97 isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0.97 bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
0.95 bsd: redistributions of source code must retain the above copyright notice
0.95 bsd: redistributions in binary form must reproduce the above copyright notice
0.97 bsd-3-clause: neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
0.97 bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement
0.95 bsd: this software is provided by the copyright holders and contributors as is
0.97 gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
0.97 gpl-2.0-or-later: gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
0.97 gpl-3.0-or-later: gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.97 lgpl-2.1-or-later: gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
0.97 lgpl-3.0-or-later: gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.97 agpl-3.0-or-later: gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.95 gpl: you should have received a copy of the gnu general public license along with this program
0.95 lgpl: you should have received a copy of the gnu lesser general public license along with this library
0.95 agpl: you should have received a copy of the gnu affero general public license along with this program
0.95 gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
0.97 apache-2.0: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
0.95 apache-2.0: you may obtain a copy of the license at http www apache org licenses license 2 0
0.95 apache: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
0.95 apache: licensed to the apache software foundation asf under one or more contributor license agreements
0.97 mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
0.95 mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
0.97 epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
0.97 epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )? ?1 0
0.95 cddl: the contents of this file are subject to the terms of the common development and distribution license
0.97 bsl-1.0: distributed under the boost software license version 1 0
0.97 bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
0.97 unlicense: this is free and unencumbered software released into the public domain
0.95 unlicense: anyone is free to copy modify publish use compile sell or distribute this software
0.97 zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
0.95 zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
0.97 wtfpl: do what the fuck you want to public license
0.95 artistic-2.0: this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0
0.95 perl: it under the same terms as perl itself
0.95 python-2.0: python software foundation license version 2
0.95 cc0-1.0: to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
0.95 ofl-1.1: this font software is licensed under the sil open font license version 1 1
0.95 beerware: if we meet some day and you think this stuff is worth it you can buy me a beer
0.95 json: the software shall be used for good not evil
0.95 sspl-1.0: under the terms of the server side public license version 1
0.95 busl-1.1: use of this software is governed by the business source license
0.95 elastic-2.0: you may not provide the software to third parties as a hosted or managed service
0.95 commons-clause: the software is provided to you by the licensor under the license as defined below subject to the following condition
0.93 agpl-3.0-or-later: gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?(?: of the license)? or(?: at your option)? any later version
0.93 agpl-3.0: gnu affero general public license(?: as published by the free software foundation)? v(?:ersion )?3(?: 0)?
0.93 agpl-1.0: affero general public license version 1(?: 0)?
0.93 lgpl-2.1-or-later: gnu lesser general public license(?: either)? version 2 1(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
0.93 lgpl-3.0-or-later: gnu lesser general public license(?: either)? version 3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
0.93 lgpl-2.1: gnu lesser general public license v(?:ersion )?2 1
0.93 lgpl-3.0: gnu lesser general public license v(?:ersion )?3(?: 0)?
0.93 lgpl-2.0-or-later: gnu library general public license(?: either)? version 2(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
0.93 lgpl-2.0: gnu library general public license v(?:ersion )?2(?: 0)?
0.93 gpl-2.0-or-later: gnu general public license(?: either)? version 2(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
0.93 gpl-3.0-or-later: gnu general public license(?: either)? version 3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
0.93 gpl-2.0-with-classpath-exception: gnu general public license version 2(?: only)? with the classpath exception
0.93 gpl-2.0-only: gnu general public license version 2(?: 0)? only
0.93 gpl-3.0-only: gnu general public license version 3(?: 0)? only
0.92 gpl-1.0: gnu general public license v(?:ersion )?1(?: 0)?
0.92 gpl-2.0: gnu general public license v(?:ersion )?2(?: 0)?
0.92 gpl-3.0: gnu general public license v(?:ersion )?3(?: 0)?
0.92 gfdl-1.1: gnu free documentation license version 1 1
0.92 gfdl-1.2: gnu free documentation license version 1 2
0.92 gfdl-1.3: gnu free documentation license version 1 3
0.92 gpl-2.0-or-later: gpl(?:v)? ?2(?: 0)? or later
0.92 gpl-3.0-or-later: gpl(?:v)? ?3(?: 0)? or later
0.92 lgpl-2.1-or-later: lgpl(?:v)? ?2 1 or later
0.92 lgpl-3.0-or-later: lgpl(?:v)? ?3(?: 0)? or later
0.92 agpl-3.0-or-later: agpl(?:v)? ?3(?: 0)? or later
0.9 gpl-2.0: gpl 2 0
0.9 gpl-3.0: gpl 3 0
0.9 lgpl-2.1: lgpl 2 1
0.9 lgpl-3.0: lgpl 3 0
0.9 agpl-3.0: agpl 3 0
0.9 gpl-2.0: gplv2
0.9 gpl-3.0: gplv3
0.9 lgpl-2.1: lgplv2 1
0.9 lgpl-2.0: lgplv2
0.9 lgpl-3.0: lgplv3
0.9 agpl-3.0: agplv3
0.93 apache-2.0: licensed under the apache license version 2 0
0.93 apache-1.1: apache software license version 1 1
0.93 apache-1.0: apache software license version 1 0
0.92 apache-2.0: apache license(?: version)? 2 0
0.92 apache-2.0: apache license v2(?: 0)?
0.92 apache-2.0: apache software license(?: version)? 2 0
0.92 apache-1.1: apache license(?: version)? 1 1
0.92 apache-1.0: apache license(?: version)? 1 0
0.9 apache-2.0: apache 2 0 license
0.9 apache-2.0: apache 2 0
0.93 mit: released under the mit license
0.93 mit: licensed under the mit license
0.93 mit: distributed under the mit license
0.93 mit: available under the mit license
0.92 mit-0: mit no attribution license
0.92 mit-modern: modern variant of the mit license
0.92 x11: mit x11 license
0.92 x11: x11 license
0.9 mit: expat license
0.92 bsd-2-clause: bsd 2 clause(?: [^ ]+){0,2} license
0.92 bsd-3-clause: bsd 3 clause(?: [^ ]+){0,2} license
0.92 bsd-4-clause: bsd 4 clause(?: [^ ]+){0,2} license
0.92 bsd-2-clause: 2 clause bsd
0.92 bsd-3-clause: 3 clause bsd
0.92 bsd-4-clause: 4 clause bsd
0.92 bsd-2-clause: simplified bsd license
0.92 bsd-3-clause: new bsd license
0.92 bsd-3-clause: modified bsd license
0.92 bsd-3-clause: revised bsd license
0.92 bsd-2-clause: freebsd license
0.92 bsd-3-clause-clear: clear bsd license
0.92 0bsd: zero clause bsd
0.92 0bsd: bsd zero clause license
0.92 bsd-protection: bsd protection license
0.9 bsd-style: bsd style license
0.9 mit-style: mit style license
0.93 cc-by-nc-sa-4.0: cc by nc sa 4 0
0.93 cc-by-nc-sa-3.0: cc by nc sa 3 0
0.93 cc-by-nc-sa-2.0: cc by nc sa 2 0
0.93 cc-by-nc-nd-4.0: cc by nc nd 4 0
0.93 cc-by-nc-nd-3.0: cc by nc nd 3 0
0.93 cc-by-nc-nd-2.0: cc by nc nd 2 0
0.93 cc-by-nc-4.0: cc by nc 4 0
0.93 cc-by-nc-3.0: cc by nc 3 0
0.93 cc-by-nc-2.0: cc by nc 2 0
0.93 cc-by-nd-4.0: cc by nd 4 0
0.93 cc-by-nd-3.0: cc by nd 3 0
0.93 cc-by-nd-2.0: cc by nd 2 0
0.93 cc-by-sa-4.0: cc by sa 4 0
0.93 cc-by-sa-3.0: cc by sa 3 0
0.93 cc-by-sa-2.5: cc by sa 2 5
0.93 cc-by-sa-2.0: cc by sa 2 0
0.93 cc-by-4.0: cc by 4 0
0.93 cc-by-3.0: cc by 3 0
0.93 cc-by-2.5: cc by 2 5
0.93 cc-by-2.0: cc by 2 0
0.9 cc-by-nc-sa: cc by nc sa
0.9 cc-by-nc-nd: cc by nc nd
0.9 cc-by-nc: cc by nc
0.9 cc-by-nd: cc by nd
0.9 cc-by-sa: cc by sa
0.93 cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
0.93 cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
0.93 cc-by-nc: creative commons attribution non ?commercial(?: [1-4] [05])?
0.93 cc-by-nd: creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
0.93 cc-by-sa: creative commons attribution share ?alike(?: [1-4] [05])?
0.92 cc-by-4.0: creative commons attribution 4 0
0.92 cc-by-3.0: creative commons attribution 3 0
0.9 cc-by: creative commons attribution
0.9 cc0-1.0: creative commons zero
0.9 cc0-1.0: cc0 1 0
0.9 cc-pdm-1.0: creative commons public domain mark
0.92 cc-by-nc-sa: creativecommons org licenses by nc sa
0.92 cc-by-nc-nd: creativecommons org licenses by nc nd
0.92 cc-by-nc: creativecommons org licenses by nc
0.92 cc-by-nd: creativecommons org licenses by nd
0.92 cc-by-sa: creativecommons org licenses by sa
0.92 cc-by: creativecommons org licenses by
0.92 cc0-1.0: creativecommons org publicdomain zero
0.92 apache-2.0: apache org licenses license 2 0
0.92 mit: opensource org licenses mit
0.92 bsd-3-clause: opensource org licenses bsd 3 clause
0.92 gpl: gnu org licenses gpl
0.92 lgpl: gnu org licenses lgpl
0.92 agpl: gnu org licenses agpl
0.92 gfdl: gnu org licenses fdl
0.92 mpl-2.0: mozilla org mpl 2 0
0.92 mpl-1.1: mozilla org mpl mpl 1 1
0.92 epl: eclipse org legal epl
0.92 bsl-1.0: boost org license 1 0
0.92 unlicense: unlicense org
0.92 wtfpl: wtfpl net
0.92 mpl-2.0: mozilla public license(?: version| v)? 2 0
0.92 mpl-1.1: mozilla public license(?: version| v)? 1 1
0.92 mpl-1.0: mozilla public license(?: version| v)? 1 0
0.92 epl-2.0: eclipse public license(?: version| v)? 2 0
0.92 epl-1.0: eclipse public license(?: version| v)? 1 0
0.92 cddl-1.0: common development and distribution license(?: version| v)? 1 0
0.92 cddl-1.1: common development and distribution license(?: version| v)? 1 1
0.92 eupl-1.1: european union public licen[cs]e(?: version| v)? 1 1
0.92 eupl-1.2: european union public licen[cs]e(?: version| v)? 1 2
0.92 artistic-1.0: artistic license 1 0
0.92 artistic-2.0: artistic license 2 0
0.92 afl-3.0: academic free license(?: version| v)? 3 0
0.92 osl-3.0: open software license(?: version| v)? 3 0
0.92 odbl-1.0: open database license
0.92 odc-by-1.0: open data commons attribution license
0.92 pddl-1.0: public domain dedication and license
0.92 ofl-1.1: sil open font license
0.92 ms-pl: microsoft public license
0.92 ms-rl: microsoft reciprocal license
0.92 openssl: openssl license
0.92 php-3.01: php license(?: version)? 3 01
0.92 ruby: ruby license
0.92 ncsa: university of illinois ncsa open source license
0.92 postgresql: postgresql licen[cs]e
0.92 upl-1.0: universal permissive license
0.92 cecill-2.1: cecill free software license agreement
0.92 vim: vim license
0.92 ibm-ipl-1.0: ibm public license version 1 0
0.92 cpl-1.0: common public license version 1 0
0.92 cpal-1.0: common public attribution license version 1 0
0.92 lppl-1.3c: latex project public license
0.92 sleepycat: sleepycat license
0.92 mulan-psl-2.0: mulan permissive software license
0.92 blueoak-1.0.0: blue oak model license
0.92 elastic-2.0: elastic license 2 0
0.92 sspl-1.0: server side public license
0.92 busl-1.1: business source license
0.92 commons-clause: commons clause license condition
0.92 openrail: responsible ai license
0.92 llama: llama (?:[^ ]+ ){0,2}community license agreement
0.75 agpl: gnu affero general public license
0.75 lgpl: gnu lesser general public license
0.75 lgpl: gnu library general public license
0.75 gpl: gnu general public license
0.75 gfdl: gnu free documentation license
0.75 apache: apache license
0.75 apache: apache software license
0.75 mit: mit license
0.75 bsd: bsd license
0.75 isc: isc license
0.75 mpl: mozilla public license
0.75 epl: eclipse public license
0.75 cddl: common development and distribution license
0.75 bsl-1.0: boost software license
0.75 artistic: artistic license
0.75 zlib: zlib license
0.75 cc0-1.0: cc0
0.75 cc-by: cc by
0.6 creative-commons: creative commons license
0.5 proprietary: proprietary and confidential
0.5 proprietary: unauthorized copying of this file
0.5 proprietary: may not be reproduced(?: [^ ]+){0,6} without(?: the)?(?: prior)?(?: express)?(?: written)? permission
0.5 evaluation-only: for evaluation purposes only
0.5 no-commercial-use: for non ?commercial use only
0.5 no-commercial-use: for personal use only
0.5 no-training: may not be used to train(?: [^ ]+){0,4} models?
0.4 public-domain: released into the public domain
0.4 public-domain: dedicated to the public domain
0.4 public-domain: in the public domain
0.3 all-rights-reserved: all rights reserved
"""
