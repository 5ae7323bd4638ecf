"""Signature rules of licenses, written by hand, in order of priority: of overlapping detections the earlier rule wins.

A line is a label, a weight and a pattern over lower-case words with one space between them; the keyword that the
prefilter looks for stands in angle brackets, and a fixed number of words precedes it.
"""

RULES = r"""
agpl 1.0 licensed under the <gnu> affero general public license(?: version 3| v3)?(?: or (?:any )?later)?
agpl 1.0 terms of the <gnu> affero general public license(?: as published by the free software foundation)?
agpl 0.9 <gnu> affero general public license(?: version 3| v3)?(?: 0)?(?: or (?:any )?later)?
agpl 1.0 spdx license identifier <agpl> [13] 0(?: only| or later)?
agpl 0.9 <agpl> ?v?3(?: 0)?(?: or later| only)?
agpl 0.8 <agplv3>(?: or later)?
agpl 0.8 <affero> general public license
agpl 0.7 under the <agpl>
lgpl 1.0 licensed under the <gnu> lesser general public license(?: version [23](?: [01])?| v[23](?: [01])?)?(?: or (?:any )?later(?: version)?)?
lgpl 1.0 licensed under the <gnu> library general public license(?: version 2(?: 0)?)?
lgpl 1.0 terms of the <gnu> lesser general public license(?: as published by the free software foundation)?
lgpl 1.0 terms of the <gnu> library general public license(?: as published by the free software foundation)?
lgpl 0.9 <gnu> lesser general public license(?: version [23](?: [01])?| v[23](?: [01])?)?(?: or (?:any )?later(?: version)?)?
lgpl 0.9 <gnu> library general public license(?: version 2(?: 0)?)?
lgpl 1.0 spdx license identifier <lgpl> [23] [01](?: only| or later)?
lgpl 0.9 <lgpl> ?v?[23](?: [01])?(?: or later| only)?
lgpl 0.8 <lgplv3>(?: or later)?
lgpl 0.8 <lgplv2>(?: 1)?(?: or later)?
lgpl 0.8 <lesser> general public license
lgpl 0.7 under the <lgpl>
gfdl 1.0 under the terms of the <gnu> free documentation license(?: version 1 [123])?
gfdl 0.9 <gnu> free documentation license(?: version 1 [123])?(?: or any later version)?
gfdl 1.0 spdx license identifier <gfdl> 1 [123](?: only| or later)?
gfdl 0.8 <gfdl>(?: 1 [123])?
gpl 1.0 licensed under the <gnu> general public license(?: version [23]| v[23])?(?: or (?:any )?later(?: version)?)?
gpl 1.0 licensed under the terms of the <gnu> general public license(?: version [23]| v[23])?
gpl 1.0 released under the <gnu> general public license(?: version [23]| v[23])?
gpl 1.0 distributed under the terms of the <gnu> general public license
gpl 1.0 redistribute it and or modify it under the terms of the <gnu> general public license
gpl 1.0 terms of the <gnu> general public license(?: version [23])?(?: as published by the free software foundation)?
gpl 1.0 covered by the <gnu> general public license
gpl 0.9 copy of the <gnu> general public license
gpl 0.9 <gnu> general public license(?: version [123]| v[123])(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl 0.8 <gnu> general public license(?: as published by the free software foundation)?
gpl 0.9 <gnu> gpl(?: ?v?[123])?(?: 0)?(?: or (?:any )?later| only)?
gpl 1.0 spdx license identifier <gpl> [123] 0(?: only| or later)?(?: with [a-z]+ exception(?: [0-9] [0-9])?)?
gpl 1.0 licensed under the <gpl>(?: ?v?[123])?(?: 0)?
gpl 0.9 licensed under <gpl>(?: ?v?[123])?(?: 0)?
gpl 0.9 released under the <gpl>(?: ?v?[123])?
gpl 0.8 <gpl> compatible license
gpl 0.9 <gpl> version [123](?: or (?:any )?later)?
gpl 0.8 <gpl> ?v?[123](?: 0)?(?: or later| only)?
gpl 0.8 <gplv2>(?: or later)?
gpl 0.8 <gplv3>(?: or later)?
gpl 0.7 under the <gpl>
gpl 0.6 <gpl> licensed?
gpl-exception 0.8 <classpath> exception
gpl-exception 0.8 gcc <runtime> library exception(?: 3 1)?
gpl-exception 0.7 bison <exception>(?: 2 2)?
apache 1.0 licensed under the <apache> license(?: version)?(?: 2(?: 0)?)?
apache 1.0 licensed under the <apache> 2(?: 0)? license
apache 1.0 licensed under <apache>(?: license)?(?: version)? 2(?: 0)?
apache 1.0 released under the <apache> license(?: version)?(?: 2(?: 0)?)?
apache 1.0 distributed under the <apache> license(?: version)?(?: 2(?: 0)?)?
apache 1.0 terms of the <apache> license(?: version)?(?: 2(?: 0)?)?
apache 1.0 spdx license identifier <apache> [12] [01]
apache 0.9 copy of the <apache> license
apache 0.9 <apache> software license(?: version)?(?: [12](?: [01])?)?
apache 0.9 <apache> license(?: version)? [12](?: [01])?
apache 0.8 <apache> license
apache 0.9 <apache> public license(?: [12] [01])?
apache 0.8 <apache> [12](?: [01])?(?: licensed?)?
apache 0.8 <apachev2>
apache 0.9 http www <apache> org licenses(?: license 2 0)?
apache 0.7 www apache org <licenses> license 2 0
mit 1.0 licensed under the <mit> license
mit 1.0 licensed under the terms of the <mit> license
mit 1.0 licensed under <mit>
mit 1.0 released under the <mit> license
mit 1.0 released under <mit>
mit 1.0 distributed under the <mit> license
mit 1.0 available under the <mit> license
mit 1.0 governed by the <mit> license
mit 1.0 terms of the <mit> license
mit 1.0 spdx license identifier <mit>(?: 0)?
mit 0.9 under an <mit> style license
mit 0.8 <mit> style license
mit 0.8 <mit> licensed
mit 0.8 the <mit> license mit
mit 0.8 <mit> license
mit 0.8 <mit> x11(?: license)?
mit 0.9 <x11> license
mit 0.9 <expat> license
mit 0.9 permission is hereby granted free of charge to any person <obtaining> a copy of this software
mit 0.8 the software is provided as is without <warranty> of any kind
mit 0.7 opensource org <licenses> mit
mit-0 0.9 <mit> no attribution
bsd 1.0 licensed under the <bsd> license
bsd 1.0 licensed under the <bsd> [234] clause(?: license)?
bsd 1.0 licensed under a <bsd> style license
bsd 1.0 released under the <bsd> license
bsd 1.0 terms of the <bsd> license
bsd 1.0 governed by a <bsd> style license
bsd 1.0 spdx license identifier <bsd> [01234] clause(?: [a-z]+)?
bsd 0.9 new or revised <bsd> license
bsd 0.9 simplified <bsd> license
bsd 0.9 modified <bsd> license
bsd 0.9 new <bsd> license
bsd 0.9 original <bsd> license
bsd 0.9 three clause <bsd>(?: license)?
bsd 0.9 two clause <bsd>(?: license)?
bsd 0.9 [234] clause <bsd>(?: license)?
bsd 0.9 <bsd> [01234] clause(?: clear)?(?: license)?
bsd 0.9 <bsd> zero clause(?: license)?
bsd 0.8 <bsd> style license
bsd 0.8 <bsd> license
bsd 0.7 <bsd> licensed
bsd 0.9 redistribution and use in source and <binary> forms with or without modification are permitted
bsd 0.8 neither the name of the <copyright> holder nor the names of its contributors
bsd 0.8 redistributions of source code must <retain> the above copyright notice
isc 1.0 licensed under the <isc> license
isc 1.0 spdx license identifier <isc>
isc 0.9 <isc> license
isc 0.9 permission to use copy modify and or distribute this software for any <purpose> with or without fee is hereby granted
mpl 1.0 subject to the terms of the <mozilla> public license(?: v(?:ersion)?)?(?: ?[12](?: [01])?)?
mpl 1.0 licensed under the <mozilla> public license(?: version)?(?: [12](?: [01])?)?
mpl 1.0 spdx license identifier <mpl> [12] [01](?: no copyleft exception)?
mpl 0.9 <mozilla> public license(?: version| v)?(?: [12](?: [01])?)?
mpl 0.8 <mpl> [12](?: [01])?
mpl 0.8 <mpl2>
mpl 0.7 under the <mpl>
epl 1.0 terms of the <eclipse> public license(?: v)?(?: [12] 0)?
epl 1.0 spdx license identifier <epl> [12] 0
epl 0.9 <eclipse> public license(?: version| v)?(?: [12](?: 0)?)?
epl 0.9 <eclipse> distribution license(?: v)?(?: 1 0)?
epl 0.8 <epl> [12] 0
cddl 0.9 common development and <distribution> license(?: version)?(?: 1 [01])?
cddl 1.0 spdx license identifier <cddl> 1 [01]
cddl 0.8 <cddl>(?: 1 [01])?
cpl 0.9 <common> public license(?: version| v)?(?: 1 0)?
cpal 0.9 common public <attribution> license(?: version)?(?: 1 0)?
eupl 1.0 licensed under the <eupl>(?: v?(?:ersion)?(?: ?1 [012])?)?
eupl 0.9 <european> union public licen[cs]e(?: v)?(?: 1 [012])?
eupl 0.8 <eupl> ?v?1 [012]
zlib 1.0 spdx license identifier <zlib>
zlib 0.9 <zlib> license
zlib 0.9 <zlib> libpng license
libpng 0.9 <libpng> license(?: version 2)?
artistic 1.0 terms of the <artistic> license(?: [12] 0)?
artistic 0.9 <artistic> license(?: version)?(?: [12] 0)?
artistic 0.9 same terms as <perl> itself
bsl 1.0 distributed under the <boost> software license(?: version)?(?: 1 0)?
bsl 1.0 spdx license identifier <bsl> 1 0
bsl 0.9 <boost> software license(?: version)?(?: 1 0)?
busl 0.9 <business> source license(?: 1 1)?
unlicense 1.0 spdx license identifier <unlicense>
unlicense 0.9 the <unlicense>
unlicense 0.9 free and unencumbered software released into the <public> domain
wtfpl 0.9 do what the fuck you want to public <license>
wtfpl 0.9 <wtfpl>(?: v(?:ersion)? ?2)?
ofl 1.0 licensed under the <sil> open font license(?: version)?(?: 1 1)?
ofl 0.9 <sil> open font license(?: version)?(?: 1 [01])?
ofl 0.8 <ofl> 1 [01]
psf 0.9 <python> software foundation license(?: version 2)?
psf 0.8 <psf> license(?: agreement)?
python 0.8 <python> license(?: 2 0)?
ruby 0.8 <ruby> license
php 0.9 <php> license(?: version)?(?: 3 01?)?
openssl 0.9 <openssl> license
curl 0.8 <curl> license
postgresql 0.9 <postgresql> licen[cs]e
ncsa 0.9 university of illinois <ncsa> open source license
ncsa 0.8 <ncsa> license
ms-pl 0.9 <microsoft> public license(?: ms pl)?
ms-rl 0.9 <microsoft> reciprocal license(?: ms rl)?
osl 0.9 <open> software license(?: version| v)?(?: [123] 0)?
afl 0.9 <academic> free license(?: version| v)?(?: [123] [01])?
upl 0.9 <universal> permissive license(?: v)?(?: 1 0)?
vim 0.8 <vim> license
w3c 0.9 <w3c> software(?: and document)?(?: notice and)? license
sspl 0.9 server side <public> license(?: v1)?
elastic 0.9 <elastic> license(?: 2 0)?
commons-clause 0.9 <commons> clause(?: license)?(?: condition)?
openrail 0.9 <creativeml> open rail m(?: license)?
openrail 0.8 <openrail> ?m?(?: license)?
llama 0.9 <llama> ?[234]?(?: [0-9])? community license(?: agreement)?
odbl 0.9 open <database> license(?: odbl)?(?: v1 0)?
odbl 0.8 <odbl>(?: 1 0)?
odc-by 0.9 open data <commons> attribution license
pddl 0.9 public domain <dedication> and license
cdla 0.9 community data <license> agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
ogl 0.9 open <government> licen[cs]e(?: v(?:ersion)?)?(?: ?[123] 0)?
cc-by-nc-sa 1.0 licensed under <cc> by nc sa(?: [1-4] [05])?
cc-by-nc-sa 1.0 <creative> commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa 0.9 <cc> by nc sa(?: [1-4] [05])?
cc-by-nc-nd 1.0 licensed under <cc> by nc nd(?: [1-4] [05])?
cc-by-nc-nd 1.0 <creative> commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc-nd 0.9 <cc> by nc nd(?: [1-4] [05])?
cc-by-nc 1.0 licensed under <cc> by nc(?: [1-4] [05])?
cc-by-nc 1.0 <creative> commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc 0.9 <cc> by nc(?: [1-4] [05])?
cc-by-sa 1.0 licensed under <cc> by sa(?: [1-4] [05])?
cc-by-sa 1.0 <creative> commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa 0.9 <cc> by sa(?: [1-4] [05])?
cc-by-nd 1.0 <creative> commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nd 0.9 <cc> by nd(?: [1-4] [05])?
cc-by 1.0 licensed under <cc> by(?: [1-4] [05])?
cc-by 1.0 licensed under a <creative> commons attribution(?: [1-4] [05])?(?: international)?(?: license)?
cc-by 0.9 <creative> commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by 0.8 <cc> by(?: [1-4] [05])?
cc-by 0.7 <creativecommons> org licenses by(?: [1-4] [05])?
cc0 1.0 dedicated to the public domain under <cc0>(?: 1 0)?
cc0 0.9 <cc0>(?: 1 0)?(?: universal)?
cc0 0.9 <cc> zero(?: 1 0)?
cc 0.8 <creative> commons licen[cs]e
public-domain 0.9 released into the public <domain>
public-domain 0.9 dedicated to the public <domain>
public-domain 0.7 public <domain>
proprietary 0.8 all rights <reserved>
proprietary 0.9 <proprietary> and confidential
"""
