"""Signature rules of the license scan, as text.

Each line of NAMES is `label | keyword | regex`: the regex matches the name of a license in
normalised text (lower-case words joined by one space), and is only tried where the keyword
occurs as a whole word. A form that joins name and version ("gpl3", "gplv3") is a word of its own,
so it has its own line. Every name yields three rules: a grant ("licensed under the <name>"), a name behind the
identifier's marker ("spdx license identifier <name>") and a bare mention. IDENTIFIERS yields the rules
of the SPDX ids behind that marker. NOTICES are rules of their own, with a
weight. Smaller priority wins where two rules match the same words.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Signature(NamedTuple):
    rule: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


NAMES = r"""
afl-3.0 | academic | academic free licen[cs]e( version| v)?( 3( 0)?)?
agpl-1.0 | affero | affero general public licen[cs]e( version| v)? 1( 0)?
agpl-3.0 | affero | (gnu )?affero general public licen[cs]e( version| v)? 3( 0)?( or later| only)?
agpl-3.0 | agpl | (gnu )?agpl( version)?( v)? ?3( 0)?( or later| only)?
agpl-3.0 | agpl3 | (gnu )?agpl3( 0)?( or later| only)?
agpl-3.0 | agplv3 | (gnu )?agplv3( 0)?( or later| only)?
agpl | affero | (gnu )?affero general public licen[cs]e
agpl | agpl | (gnu )?agpl( licen[cs]e)?
apache-1.0 | apache | apache (software )?licen[cs]e( version| v)? 1 0
apache-1.1 | apache | apache (software )?licen[cs]e( version| v)? 1 1
apache-2.0 | apache | apache (software )?licen[cs]e( version| v)? ?2( 0)?
apache-2.0 | apache | apache 2( 0)?( licen[cs]e)?
apache | apache | apache (software )?licen[cs]e
apsl-2.0 | apple | apple public source licen[cs]e( version)?( 2 0)?
artistic-1.0 | artistic | (perl )?artistic licen[cs]e( version)? 1 0
artistic-2.0 | artistic | (perl )?artistic licen[cs]e( version)? 2 0
artistic | artistic | (perl )?artistic licen[cs]e
beerware | beerware | (the )?beerware licen[cs]e
blueoak-1.0.0 | blue | blue oak model licen[cs]e( 1 0 0)?
bsd-1-clause | bsd | (1|one) clause bsd( licen[cs]e)?
bsd-2-clause | bsd | (2|two) clause bsd( licen[cs]e)?
bsd-2-clause | bsd | bsd (2|two) clause( licen[cs]e)?
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-2-clause | simplified | simplified bsd( licen[cs]e)?
bsd-3-clause | bsd | (3|three) clause bsd( licen[cs]e)?
bsd-3-clause | bsd | bsd (3|three) clause( licen[cs]e)?
bsd-3-clause | bsd | (new|modified|revised) bsd( licen[cs]e)?
bsd-4-clause | bsd | (4|four) clause bsd( licen[cs]e)?
bsd-4-clause | bsd | bsd (4|four) clause( licen[cs]e)?
bsd-0-clause | bsd | (0|zero) clause bsd( licen[cs]e)?
bsd | bsd | bsd( style)? licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e( version)?( 1 0)?
busl-1.1 | business | business source licen[cs]e( version)?( 1 1)?
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?( public domain dedication)?
cc-by-1.0 | cc | cc by( licen[cs]e)? 1 0
cc-by-2.0 | cc | cc by( licen[cs]e)? 2 0
cc-by-2.5 | cc | cc by( licen[cs]e)? 2 5
cc-by-3.0 | cc | cc by( licen[cs]e)? 3 0
cc-by-4.0 | cc | cc by( licen[cs]e)? 4 0
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc-2.5 | cc | cc by nc 2 5
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc | cc | cc by nc
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 0
cc-by-nc-sa-2.5 | cc | cc by nc sa 2 5
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd | cc | cc by nd
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa | cc | cc by sa
cc-by-4.0 | creative | creative commons attribution( 4 0)( international)?( public)?( licen[cs]e)?
cc-by-3.0 | creative | creative commons attribution( 3 0)( unported)?( licen[cs]e)?
cc-by-sa | creative | creative commons attribution share ?alike( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc | creative | creative commons attribution non ?commercial( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by-nd | creative | creative commons attribution no ?deriv(ative)?s( [1-4] [05])?( international| unported)?( licen[cs]e)?
cc-by | creative | creative commons attribution( [1-4] [05])?( international| unported| generic)?( public)?( licen[cs]e)?
cc0-1.0 | creative | creative commons zero( v?1 0)?( universal)?
cddl-1.0 | cddl | cddl( version| v)?( 1 0)?
cddl-1.0 | distribution | common development and distribution licen[cs]e( version)?( 1 0)?
cddl-1.1 | distribution | common development and distribution licen[cs]e( version)? 1 1
cecill-2.1 | cecill | cecill( free software)?( licen[cs]e)?( agreement)?( v?2 1)?
cpl-1.0 | common | common public licen[cs]e( version)?( 1 0)?
ecl-2.0 | educational | educational community licen[cs]e( version)?( 2 0)?
epl-1.0 | eclipse | eclipse public licen[cs]e( version| v)? 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e( version| v)? 2 0
epl | eclipse | eclipse public licen[cs]e
elastic-2.0 | elastic | elastic licen[cs]e( version)?( 2 0)?
eupl-1.1 | eupl | eupl( version| v)? ?1 1
eupl-1.2 | eupl | eupl( version| v)? ?1 2
eupl-1.1 | eupl1 | eupl1 1
eupl-1.2 | eupl1 | eupl1 2
eupl-1.1 | euplv1 | euplv1 1
eupl-1.2 | euplv1 | euplv1 2
eupl | european | european union public licen[cs]e( v?1 [12])?
gfdl-1.2 | documentation | (gnu )?free documentation licen[cs]e( version)? 1 2
gfdl-1.3 | documentation | (gnu )?free documentation licen[cs]e( version)? 1 3
gfdl | documentation | (gnu )?free documentation licen[cs]e
gpl-1.0 | gpl | (gnu )?gpl( version| v)? ?1( 0)?( or later| only)?
gpl-2.0 | gpl | (gnu )?gpl( version| v)? ?2( 0)?( or later| only)?
gpl-3.0 | gpl | (gnu )?gpl( version| v)? ?3( 0)?( or later| only)?
gpl-1.0 | gpl1 | (gnu )?gpl1( 0)?( or later| only)?
gpl-2.0 | gpl2 | (gnu )?gpl2( 0)?( or later| only)?
gpl-3.0 | gpl3 | (gnu )?gpl3( 0)?( or later| only)?
gpl-1.0 | gplv1 | (gnu )?gplv1( 0)?( or later| only)?
gpl-2.0 | gplv2 | (gnu )?gplv2( 0)?( or later| only)?
gpl-3.0 | gplv3 | (gnu )?gplv3( 0)?( or later| only)?
gpl-1.0 | general | (gnu )?general public licen[cs]e( version| v)? 1( 0)?
gpl-2.0 | general | (gnu )?general public licen[cs]e( version| v)? 2( 0)?
gpl-3.0 | general | (gnu )?general public licen[cs]e( version| v)? 3( 0)?
gpl | general | gnu general public licen[cs]e
gpl | gpl | (gnu )?gpl( licen[cs]e)?
hpnd | historical | historical permission notice and disclaimer
ibm-public-1.0 | ibm | ibm public licen[cs]e( version)?( 1 0)?
isc | isc | isc licen[cs]e
lgpl-2.0 | lesser | (gnu )?(library|lesser) general public licen[cs]e( version| v)? 2( 0)?
lgpl-2.1 | lesser | (gnu )?lesser general public licen[cs]e( version| v)? 2 1
lgpl-3.0 | lesser | (gnu )?lesser general public licen[cs]e( version| v)? 3( 0)?
lgpl-2.0 | library | (gnu )?library general public licen[cs]e( version| v)?( 2( 0)?)?
lgpl | lesser | (gnu )?lesser general public licen[cs]e
lgpl | lgpl | (gnu )?lgpl( licen[cs]e)?
lgpl-2.1 | lgpl | (gnu )?lgpl( version| v)? ?2 1( or later| only)?
lgpl-3.0 | lgpl | (gnu )?lgpl( version| v)? ?3( 0)?( or later| only)?
lgpl-2.0 | lgpl2 | (gnu )?lgpl2( 0)?( or later| only)?
lgpl-2.1 | lgpl2 | (gnu )?lgpl2 1( or later| only)?
lgpl-3.0 | lgpl3 | (gnu )?lgpl3( 0)?( or later| only)?
lgpl-2.0 | lgplv2 | (gnu )?lgplv2( 0)?( or later| only)?
lgpl-2.1 | lgplv2 | (gnu )?lgplv2 1( or later| only)?
lgpl-3.0 | lgplv3 | (gnu )?lgplv3( 0)?( or later| only)?
lppl-1.3 | latex | latex project public licen[cs]e( v?1 3c?)?
mit | mit | (the )?(x11 |expat )?mit( style)? licen[cs]e
mit | expat | expat licen[cs]e
mit-0 | mit | mit (no attribution|0)( licen[cs]e)?
mpl-1.0 | mozilla | mozilla public licen[cs]e( version| v)? 1 0
mpl-1.1 | mozilla | mozilla public licen[cs]e( version| v)? 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e( version| v)? 2( 0)?
mpl | mozilla | mozilla public licen[cs]e
mpl-2.0 | mpl | mpl( version| v)? ?2 0
mpl-1.1 | mpl1 | mpl1 1
mpl-1.1 | mplv1 | mplv1 1
mpl-2.0 | mpl2 | mpl2( 0)?
mpl-2.0 | mplv2 | mplv2( 0)?
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
ncsa | ncsa | (university of illinois )?ncsa( open source)? licen[cs]e
odbl-1.0 | database | open (data commons )?(open )?database licen[cs]e( v?1 0)?
odc-by-1.0 | commons | open data commons attribution licen[cs]e( v?1 0)?
ofl-1.1 | ofl | (sil )?ofl( version)?( 1 1)?
ofl-1.1 | font | (sil )?open font licen[cs]e( version)?( 1 1)?
openssl | openssl | openssl licen[cs]e
osl-3.0 | open | open software licen[cs]e( version| v)?( 3 0)?
php-3.01 | php | php licen[cs]e( version)?( 3 01?)?
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | python | python software foundation licen[cs]e( version)?( 2)?
python-2.0 | python | python licen[cs]e( version)?( 2 0)?
qpl-1.0 | q | q public licen[cs]e( version)?( 1 0)?
rpl-1.5 | reciprocal | reciprocal public licen[cs]e( version)?( 1 5)?
ruby | ruby | ruby( s)? licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
sspl-1.0 | server | server side public licen[cs]e( v(ersion)? ?1)?
unicode-dfs-2016 | unicode | unicode (inc )?licen[cs]e( agreement)?
unlicense | unlicense | (the )?unlicense
upl-1.0 | universal | universal permissive licen[cs]e( v(ersion)? ?1 0)?
vim | vim | vim licen[cs]e
w3c | w3c | w3c( software( notice)?( and)?)?( document)? licen[cs]e
wtfpl | wtfpl | wtfpl( version)?( 2)?
zlib | zlib | (the )?zlib( libpng)? licen[cs]e
zpl-2.1 | zope | zope public licen[cs]e( version)?( 2 1)?
"""

#: label | weight | keyword | regex
NOTICES = r"""
all-rights-reserved | 0.7 | reserved | all rights reserved
copyright-notice | 0.5 | copyright | copyright( c)? (19|20)\d\d
public-domain | 0.8 | domain | (released |dedicated |placed )?(in|into|to) the public domain
proprietary | 0.7 | proprietary | proprietary and confidential
proprietary | 0.7 | redistribution | redistribution is (strictly )?prohibited
bsd | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
mit | 0.95 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | 0.9 | permission | permission to use copy modify and or distribute this software for any purpose
gpl | 0.9 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 0.9 | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
agpl | 0.9 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
zlib | 0.9 | provided | this software is provided as is without any express or implied warranty
unlicense | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 0.9 | public | do what the fuck you want to public licen[cs]e
apache-2.0 | 0.95 | compliance | you may not use this file except in compliance with the licen[cs]e
apache | 0.8 | apache | licen[cs]ed to the apache software foundation
bsd | 0.9 | bsd | (the )?use of this source code is governed by a bsd style licen[cs]e
mpl | 0.9 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
epl | 0.9 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cc0-1.0 | 0.9 | waived | has waived all copyright and related or neighbo(u)?ring rights
dual-license | 0.6 | dual | dual licen[cs]ed( under)?
no-derivatives | 0.5 | derivative | no derivative works
non-commercial | 0.5 | commercial | non commercial use only
"""

#: label: SPDX identifiers, as they stand behind "SPDX-License-Identifier:"; a final + means that
#: "-only", "-or-later" and "+" may follow.
IDENTIFIERS = """
afl-1.1: AFL-1.1
afl-1.2: AFL-1.2
afl-2.0: AFL-2.0
afl-2.1: AFL-2.1
afl-3.0: AFL-3.0
agpl-1.0: AGPL-1.0+
agpl-3.0: AGPL-3.0+
apache-1.0: Apache-1.0
apache-1.1: Apache-1.1
apache-2.0: Apache-2.0
apsl-1.0: APSL-1.0
apsl-1.1: APSL-1.1
apsl-1.2: APSL-1.2
apsl-2.0: APSL-2.0
artistic-1.0: Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8
artistic-2.0: Artistic-2.0
beerware: Beerware
blueoak-1.0.0: BlueOak-1.0.0
bsd-0-clause: 0BSD
bsd-1-clause: BSD-1-Clause
bsd-2-clause: BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-2-Clause-FreeBSD BSD-2-Clause-NetBSD
bsd-3-clause: BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Attribution BSD-3-Clause-Modification
bsd-4-clause: BSD-4-Clause BSD-4-Clause-UC
bsl-1.0: BSL-1.0
busl-1.1: BUSL-1.1
cc-by-1.0: CC-BY-1.0
cc-by-2.0: CC-BY-2.0
cc-by-2.5: CC-BY-2.5
cc-by-3.0: CC-BY-3.0
cc-by-4.0: CC-BY-4.0
cc-by-nc-1.0: CC-BY-NC-1.0
cc-by-nc-2.0: CC-BY-NC-2.0
cc-by-nc-2.5: CC-BY-NC-2.5
cc-by-nc-3.0: CC-BY-NC-3.0
cc-by-nc-4.0: CC-BY-NC-4.0
cc-by-nc-nd-1.0: CC-BY-NC-ND-1.0
cc-by-nc-nd-2.0: CC-BY-NC-ND-2.0
cc-by-nc-nd-2.5: CC-BY-NC-ND-2.5
cc-by-nc-nd-3.0: CC-BY-NC-ND-3.0
cc-by-nc-nd-4.0: CC-BY-NC-ND-4.0
cc-by-nc-sa-1.0: CC-BY-NC-SA-1.0
cc-by-nc-sa-2.0: CC-BY-NC-SA-2.0
cc-by-nc-sa-2.5: CC-BY-NC-SA-2.5
cc-by-nc-sa-3.0: CC-BY-NC-SA-3.0
cc-by-nc-sa-4.0: CC-BY-NC-SA-4.0
cc-by-nd-1.0: CC-BY-ND-1.0
cc-by-nd-2.0: CC-BY-ND-2.0
cc-by-nd-2.5: CC-BY-ND-2.5
cc-by-nd-3.0: CC-BY-ND-3.0
cc-by-nd-4.0: CC-BY-ND-4.0
cc-by-sa-1.0: CC-BY-SA-1.0
cc-by-sa-2.0: CC-BY-SA-2.0
cc-by-sa-2.5: CC-BY-SA-2.5
cc-by-sa-3.0: CC-BY-SA-3.0
cc-by-sa-4.0: CC-BY-SA-4.0
cc0-1.0: CC0-1.0
cddl-1.0: CDDL-1.0
cddl-1.1: CDDL-1.1
cecill-1.0: CECILL-1.0
cecill-2.0: CECILL-2.0
cecill-2.1: CECILL-2.1
cecill-b: CECILL-B
cecill-c: CECILL-C
cpl-1.0: CPL-1.0
cpal-1.0: CPAL-1.0
curl: curl
ecl-1.0: ECL-1.0
ecl-2.0: ECL-2.0
efl-2.0: EFL-2.0
elastic-2.0: Elastic-2.0
epl-1.0: EPL-1.0
epl-2.0: EPL-2.0
eupl-1.0: EUPL-1.0
eupl-1.1: EUPL-1.1
eupl-1.2: EUPL-1.2
ftl: FTL
gfdl-1.1: GFDL-1.1+
gfdl-1.2: GFDL-1.2+
gfdl-1.3: GFDL-1.3+
gpl-1.0: GPL-1.0+
gpl-2.0: GPL-2.0+
gpl-3.0: GPL-3.0+
hpnd: HPND
ibm-public-1.0: IPL-1.0
icu: ICU
ijg: IJG
imagemagick: ImageMagick
isc: ISC
json: JSON
lgpl-2.0: LGPL-2.0+
lgpl-2.1: LGPL-2.1+
lgpl-3.0: LGPL-3.0+
libpng: Libpng libpng-2.0
lppl-1.0: LPPL-1.0
lppl-1.1: LPPL-1.1
lppl-1.2: LPPL-1.2
lppl-1.3: LPPL-1.3a LPPL-1.3c
mit: MIT MIT-feh MIT-Modern-Variant
mit-0: MIT-0
mpl-1.0: MPL-1.0
mpl-1.1: MPL-1.1
mpl-2.0: MPL-2.0 MPL-2.0-no-copyleft-exception
ms-pl: MS-PL
ms-rl: MS-RL
mulanpsl-2.0: MulanPSL-2.0
ncsa: NCSA
odbl-1.0: ODbL-1.0
odc-by-1.0: ODC-By-1.0
ofl-1.0: OFL-1.0
ofl-1.1: OFL-1.1
openssl: OpenSSL
osl-1.0: OSL-1.0
osl-2.0: OSL-2.0
osl-2.1: OSL-2.1
osl-3.0: OSL-3.0
pddl-1.0: PDDL-1.0
php-3.01: PHP-3.0 PHP-3.01
postgresql: PostgreSQL
psf-2.0: PSF-2.0
python-2.0: Python-2.0 Python-2.0.1
qpl-1.0: QPL-1.0
rpl-1.5: RPL-1.5
ruby: Ruby
sissl: SISSL
sleepycat: Sleepycat
sspl-1.0: SSPL-1.0
unicode-3.0: Unicode-3.0
unicode-dfs-2016: Unicode-DFS-2015 Unicode-DFS-2016
unlicense: Unlicense
upl-1.0: UPL-1.0
vim: Vim
w3c: W3C W3C-20150513
wtfpl: WTFPL
x11: X11
zlib: Zlib zlib-acknowledgement
zpl-2.0: ZPL-2.0
zpl-2.1: ZPL-2.1
"""

GRANT = (
    r"(?:released|licen[cs]ed|distributed|published|available|provided|covered|governed) "
    r"(?:under|by|with)(?: the)?(?: terms of(?: the)?)? "
)
IDENTIFIER = r"spdx licen[cs]e identifier "


def _identifiers() -> list[tuple[str, str]]:
    """Label and regex of each identifier as it stands in normalised text."""
    lines = [line.split(": ") for line in IDENTIFIERS.strip().splitlines()]
    return [
        (label, " ".join(re.findall("[a-z0-9]+", x.lower())) + ("( or later| only)?" if x.endswith("+") else ""))
        for label, ids in lines for x in ids.split()
    ]


def signatures() -> tuple[Signature, ...]:
    """All rules in order: grants, identifiers, names behind the identifier's marker, notices, bare mentions; within each, as listed."""
    names = [[x.strip() for x in line.split("|", 2)] for line in NAMES.strip().splitlines()]
    notes = [[x.strip() for x in line.split("|", 3)] for line in NOTICES.strip().splitlines()]
    rows = [(f"grant-{i}", a, k, GRANT + r, 1.0) for i, (a, k, r) in enumerate(names)]
    rows += [(f"identifier-{i}", a, "spdx", IDENTIFIER + r, 1.0) for i, (a, r) in enumerate(_identifiers())]
    rows += [(f"marked-name-{i}", a, "spdx", IDENTIFIER + r, 1.0) for i, (a, k, r) in enumerate(names)]
    rows += [(f"notice-{i}", a, k, r, float(w)) for i, (a, w, k, r) in enumerate(notes)]
    rows += [(f"mention-{i}", a, k, r, 0.8) for i, (a, k, r) in enumerate(names)]
    return tuple(Signature(n, a, k, f"(?<= )(?:{r})(?= )", p, w) for p, (n, a, k, r, w) in enumerate(rows))
