"""License scans by ordered signature rules, in DataFrame functions only.

A text's words are the runs of digits, letters and non-ASCII characters after
A-Z is lower-cased.  A rule is a hand-written regular expression over words
joined by single blanks; the word in braces is its keyword.  A gap is written in
words (``(?:\\S+ ){1,40}?``), so that every rule spans a known number of words
and no window can cut what a rule allows.  The scan

1. passes over texts that hold none of the keyword stems (substring tests),
2. finds the keywords among the words of the others,
3. tries the rules of a keyword on the words around each place of it, as many as
   the longest of these rules can span, after a test for the rule's longest
   literal word (the prefilter), and
4. drops a detection that lies inside another one of the same or a higher
   priority that is longer, or as long and earlier in (priority, order), and a mere mention
   ("released under the X license") that a stronger detection lies inside of.

Everything happens inside a document's row: no shuffle, so one source or
license that holds a third of all rows does no harm.  Step 4 compares a
detection only with those of the keywords close enough to contain it.

Nulls: a null text is an empty one; a null doc_id is kept.  Repeated rows each
get their result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import ascii_lower, let

MENTION = 40  # priority of rules that name no license themselves

# The phrases whose every place is counted (never suppressed).
BASE_RULES = """
mit    | 100 | mit {license}
apache | 100 | apache {license}
gpl    | 100 | general public {license}
"""

# label | priority (90 tags, 80 names, 70 texts, 60 addresses, 40 mentions) | rule
MORE_RULES = """
mit            | 90 | {spdx} license identifier mit
mit-0          | 90 | {spdx} license identifier mit 0
apache-2.0     | 90 | {spdx} license identifier apache 2 0
apache-1.1     | 90 | {spdx} license identifier apache 1 1
gpl-2.0        | 90 | {spdx} license identifier gpl 2 0(?: only)?
gpl-2.0+       | 90 | {spdx} license identifier gpl 2 0 or later
gpl-3.0        | 90 | {spdx} license identifier gpl 3 0(?: only)?
gpl-3.0+       | 90 | {spdx} license identifier gpl 3 0 or later
lgpl-2.0       | 90 | {spdx} license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1       | 90 | {spdx} license identifier lgpl 2 1(?: only)?
lgpl-2.1+      | 90 | {spdx} license identifier lgpl 2 1 or later
lgpl-3.0       | 90 | {spdx} license identifier lgpl 3 0(?: only)?
lgpl-3.0+      | 90 | {spdx} license identifier lgpl 3 0 or later
agpl-3.0       | 90 | {spdx} license identifier agpl 3 0(?: only)?
agpl-3.0+      | 90 | {spdx} license identifier agpl 3 0 or later
gfdl-1.3       | 90 | {spdx} license identifier gfdl 1 3(?: only| or later)?
bsd-2          | 90 | {spdx} license identifier bsd 2 clause
bsd-3          | 90 | {spdx} license identifier bsd 3 clause
bsd-4          | 90 | {spdx} license identifier bsd 4 clause
0bsd           | 90 | {spdx} license identifier 0bsd
bsl-1.0        | 90 | {spdx} license identifier bsl 1 0
bsl-1.1        | 90 | {spdx} license identifier busl 1 1
mpl-1.1        | 90 | {spdx} license identifier mpl 1 1
mpl-2.0        | 90 | {spdx} license identifier mpl 2 0
epl-1.0        | 90 | {spdx} license identifier epl 1 0
epl-2.0        | 90 | {spdx} license identifier epl 2 0
cddl-1.0       | 90 | {spdx} license identifier cddl 1 0
cddl-1.1       | 90 | {spdx} license identifier cddl 1 1
eupl-1.2       | 90 | {spdx} license identifier eupl 1 2
isc            | 90 | {spdx} license identifier isc
zlib           | 90 | {spdx} license identifier zlib
unlicense      | 90 | {spdx} license identifier unlicense
wtfpl          | 90 | {spdx} license identifier wtfpl
cc0-1.0        | 90 | {spdx} license identifier cc0 1 0
cc-by-3.0      | 90 | {spdx} license identifier cc by 3 0
cc-by-4.0      | 90 | {spdx} license identifier cc by 4 0
cc-by-sa-3.0   | 90 | {spdx} license identifier cc by sa 3 0
cc-by-sa-4.0   | 90 | {spdx} license identifier cc by sa 4 0
cc-by-nc-4.0   | 90 | {spdx} license identifier cc by nc 4 0
cc-by-nd-4.0   | 90 | {spdx} license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | 90 | {spdx} license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 90 | {spdx} license identifier cc by nc nd 4 0
artistic-2.0   | 90 | {spdx} license identifier artistic 2 0
psf-2.0        | 90 | {spdx} license identifier psf 2 0
python-2.0     | 90 | {spdx} license identifier python 2 0
ofl-1.1        | 90 | {spdx} license identifier ofl 1 1
odbl-1.0       | 90 | {spdx} license identifier odbl 1 0
ms-pl          | 90 | {spdx} license identifier ms pl
ms-rl          | 90 | {spdx} license identifier ms rl
upl-1.0        | 90 | {spdx} license identifier upl 1 0
postgresql     | 90 | {spdx} license identifier postgresql
openssl        | 90 | {spdx} license identifier openssl
ruby           | 90 | {spdx} license identifier ruby
php-3.01       | 90 | {spdx} license identifier php 3 01
vim            | 90 | {spdx} license identifier vim
x11            | 90 | {spdx} license identifier x11
ncsa           | 90 | {spdx} license identifier ncsa
afl-3.0        | 90 | {spdx} license identifier afl 3 0
osl-3.0        | 90 | {spdx} license identifier osl 3 0
cecill-2.1     | 90 | {spdx} license identifier cecill 2 1
mulan-2.0      | 90 | {spdx} license identifier mulanpsl 2 0
spdx-other     | 40 | {spdx} license identifier \\S+
mit            | 80 | (?:the )?(?:mit|expat) {license}
mit            | 80 | mit {licensed}
mit            | 80 | {licensed} under (?:the )?(?:terms of the )?mit
mit            | 80 | {license} (?:type )?mit
mit            | 80 | (?:the )?mit {licence}
mit-0          | 80 | mit no attribution {license}
x11            | 80 | x11 {license}
x11            | 80 | mit x11 {license}
apache-2.0     | 80 | (?:the )?apache {license} (?:version |v)?2(?: 0)?
apache-2.0     | 80 | (?:the )?apache software {license} (?:version |v)?2(?: 0)?
apache-2.0     | 80 | (?:the )?apache {licence} (?:version |v)?2(?: 0)?
apache-2.0     | 80 | {licensed} under (?:the )?apache 2(?: 0)?
apache-1.1     | 80 | apache (?:software )?{license} (?:version |v)?1 1
apache-1.0     | 80 | apache (?:software )?{license} (?:version |v)?1 0
gpl-1.0        | 80 | gnu general public {license} (?:version |v)?1(?: 0)?
gpl-2.0        | 80 | (?:the )?(?:gnu )?general public {license} (?:version |v)2(?: 0)?
gpl-3.0        | 80 | (?:the )?(?:gnu )?general public {license} (?:version |v)3(?: 0)?
gpl-2.0+       | 80 | (?:the )?(?:gnu )?general public {license} (?:version |v)2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0+       | 80 | (?:the )?(?:gnu )?general public {license} (?:version |v)3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0        | 80 | gnu {gpl} (?:version |v)?2(?: 0)?
gpl-3.0        | 80 | gnu {gpl} (?:version |v)?3(?: 0)?
gpl-2.0        | 80 | {gplv2}
gpl-2.0+       | 80 | {gplv2} or (?:any )?later
gpl-3.0        | 80 | {gplv3}
gpl-3.0+       | 80 | {gplv3} or (?:any )?later
gpl-2.0        | 80 | {gpl} (?:version )?2 0
gpl-3.0        | 80 | {gpl} (?:version )?3 0
gpl            | 80 | gnu general public {licence}
gpl            | 80 | {licensed} under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl-exception  | 80 | {gpl} with (?:the )?(?:classpath|linking|runtime library) exception
gpl-exception  | 80 | {gpl} v?[23](?: 0)? with (?:the )?(?:classpath|linking|gcc runtime library) exception
lgpl           | 80 | (?:the )?(?:gnu )?lesser general public {license}
lgpl           | 80 | (?:gnu )?library general public {license}
lgpl-2.0       | 80 | (?:the )?(?:gnu )?library general public {license} (?:version |v)?2(?: 0)?
lgpl-2.1       | 80 | (?:the )?(?:gnu )?lesser general public {license} (?:version |v)?2 1
lgpl-3.0       | 80 | (?:the )?(?:gnu )?lesser general public {license} (?:version |v)?3(?: 0)?
lgpl-2.1       | 80 | {lgpl} (?:version |v)?2 1
lgpl-3.0       | 80 | {lgpl} (?:version |v)?3(?: 0)?
lgpl-2.1       | 80 | {lgplv2} 1
lgpl-3.0       | 80 | {lgplv3}
agpl           | 80 | (?:gnu )?affero general public {license}
agpl-3.0       | 80 | (?:the )?(?:gnu )?affero general public {license} (?:version |v)?3(?: 0)?
agpl-3.0       | 80 | {agpl} (?:version |v)?3(?: 0)?
agpl-3.0       | 80 | {agplv3}
gfdl           | 80 | (?:gnu )?free documentation {license}
gfdl-1.2       | 80 | (?:the )?(?:gnu )?free documentation {license} (?:version |v)?1 2
gfdl-1.3       | 80 | (?:the )?(?:gnu )?free documentation {license} (?:version |v)?1 3
bsd            | 80 | {bsd} (?:style )?license
bsd            | 80 | {bsd} licensed
bsd            | 80 | {licensed} under (?:the |a )?bsd
bsd-2          | 80 | {bsd} 2 clause
bsd-2          | 80 | (?:2|two) clause {bsd}(?: license)?
bsd-2          | 80 | simplified {bsd}(?: license)?
bsd-2          | 80 | freebsd {license}
bsd-3          | 80 | {bsd} 3 clause
bsd-3          | 80 | (?:3|three) clause {bsd}(?: license)?
bsd-3          | 80 | (?:new|modified|revised) {bsd}(?: license)?
bsd-4          | 80 | (?:4|four) clause {bsd}(?: license)?
bsd-4          | 80 | (?:original|old) {bsd}(?: license)?
0bsd           | 80 | zero clause {bsd}(?: license)?
0bsd           | 80 | free public {license} 1 0 0
isc            | 80 | (?:the )?isc {license}
mpl            | 80 | mozilla public {license}
mpl-1.0        | 80 | mozilla public {license} (?:version |v)?1 0
mpl-1.1        | 80 | mozilla public {license} (?:version |v)?1 1
mpl-2.0        | 80 | mozilla public {license} (?:version |v)?2 0
epl            | 80 | eclipse public {license}
epl-1.0        | 80 | eclipse public {license} (?:version |v)?1 0
epl-2.0        | 80 | eclipse public {license} (?:version |v)?2 0
edl-1.0        | 80 | eclipse distribution {license}(?: (?:version |v)?1 0)?
cpl-1.0        | 80 | common public {license}(?: (?:version |v)?1 0)?
ipl-1.0        | 80 | ibm public {license}(?: (?:version |v)?1 0)?
cddl           | 80 | common development and distribution {license}
cddl-1.0       | 80 | common development and distribution {license} (?:version |v)?1 0
cddl-1.1       | 80 | common development and distribution {license} (?:version |v)?1 1
eupl           | 80 | european union public {licence}
eupl           | 80 | european union public {license}
eupl-1.2       | 80 | european union public {licence} (?:version |v)?1 2
bsl-1.0        | 80 | boost software {license}(?: (?:version |v)?1 0)?
bsl-1.1        | 80 | business source {license}(?: (?:version |v)?1 1)?
sspl-1.0       | 80 | server side public {license}(?: (?:version |v)?1)?
elastic-2.0    | 80 | elastic {license}(?: (?:version |v)?2 0)?
zlib           | 80 | zlib(?: libpng)? {license}
libpng         | 80 | libpng {license}
unlicense      | 80 | (?:the )?{unlicense}
wtfpl          | 80 | do what the fuck you want to public {license}
wtfpl          | 80 | {wtfpl}
artistic-1.0   | 80 | artistic {license} 1 0
artistic-2.0   | 80 | artistic {license} (?:version |v)?2 0
artistic       | 80 | artistic {license}
psf-2.0        | 80 | python software foundation {license}(?: (?:version |v)?2)?
psf-2.0        | 80 | psf {license}
ofl-1.1        | 80 | (?:sil )?open font {license}(?: (?:version |v)?1 1)?
odbl-1.0       | 80 | open database {license}(?: (?:version |v)?1 0)?
odc-by-1.0     | 80 | open data commons attribution {license}
pddl-1.0       | 80 | public domain dedication and {license}
ogl-3.0        | 80 | open government {licence}(?: (?:version |v)?3 0)?
ms-pl          | 80 | microsoft public {license}
ms-rl          | 80 | microsoft reciprocal {license}
upl-1.0        | 80 | universal permissive {license}(?: (?:version |v)?1 0)?
postgresql     | 80 | postgresql {license}
openssl        | 80 | openssl {license}
ruby           | 80 | ruby {license}
php-3.01       | 80 | php {license}(?: (?:version |v)?3 01)?
vim            | 80 | vim {license}
ncsa           | 80 | (?:university of illinois )?ncsa (?:open source )?{license}
afl-3.0        | 80 | academic free {license}(?: (?:version |v)?3 0)?
osl-3.0        | 80 | open software {license}(?: (?:version |v)?3 0)?
qpl-1.0        | 80 | q public {license}(?: (?:version |v)?1 0)?
zpl-2.1        | 80 | zope public {license}(?: (?:version |v)?2 1)?
lppl-1.3c      | 80 | latex project public {license}(?: (?:version |v)?1 3c?)?
cecill-2.1     | 80 | cecill {license}
mulan-2.0      | 80 | mulan (?:psl|permissive software) {license}(?: (?:version |v)?2)?
npl-1.1        | 80 | netscape public {license}(?: (?:version |v)?1 [01])?
spl-1.0        | 80 | sun public {license}(?: (?:version |v)?1 0)?
apsl-2.0       | 80 | apple public source {license}(?: (?:version |v)?2 0)?
rpl-1.5        | 80 | reciprocal public {license}(?: (?:version |v)?1 5)?
w3c            | 80 | w3c (?:software (?:notice and )?)?{license}
json           | 80 | json {license}
beerware       | 80 | beer ?ware {license}
openrail-m     | 80 | openrail(?: m)? {license}
cc0-1.0        | 80 | creative commons zero(?: v?1 0)?(?: universal)? {license}
cc0-1.0        | 80 | cc0 (?:v?1 0 )?(?:universal )?{license}
cc-by          | 80 | creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?{license}
cc-by-sa       | 80 | creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported |generic )?{license}
cc-by-nc       | 80 | creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international |unported |generic )?{license}
cc-by-nd       | 80 | creative commons attribution no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international |unported |generic )?{license}
cc-by-nc-sa    | 80 | creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?{license}
cc-by-nc-nd    | 80 | creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] [05] )?{license}
cc-by-4.0      | 80 | cc by 4 0 {license}
cc-by-sa-4.0   | 80 | cc by sa 4 0 {license}
cc             | 80 | creative commons {license}
cc             | 80 | {licensed} under (?:a |the )?creative commons
mit            | 70 | {permission} is hereby granted free of charge to any person obtaining a copy of this software
mit            | 70 | {copyright} notice and this permission notice shall be included in all copies or substantial portions
isc            | 70 | {permission} to use copy modify and(?: or)? distribute this software for any purpose with or without fee
ofl-1.1        | 70 | {permission} is hereby granted free of charge to any person obtaining a copy of the font software
bsl-1.0        | 70 | {permission} is hereby granted free of charge to any person or organization obtaining a copy of the software
ntp            | 70 | {permission} to use copy modify and distribute this software and its documentation
bsd            | 70 | {redistribution} and use in source and binary forms with or without modification are permitted
bsd            | 70 | {redistributions} of source code must retain the above copyright notice
bsd            | 70 | {redistributions} in binary form must reproduce the above copyright notice
bsd-3          | 70 | neither the name of (?:\\S+ ){1,40}?nor the names of its {contributors} may be used to endorse
bsd-4          | 70 | all {advertising} materials mentioning features or use of this software must display
apache-2.0     | 70 | {licensed} under the apache license version 2 0 the license
apache-2.0     | 70 | you may not use this file except in compliance with the {license}
apache-2.0     | 70 | distributed under the {license} is distributed on an as is basis
apache-2.0     | 70 | subject to the terms and conditions of this {license} each contributor hereby grants
gpl            | 70 | under the terms of the gnu general public {license} as published by the free software foundation
gpl-2.0+       | 70 | {license} as published by the free software foundation either version 2 of the license or
gpl-3.0+       | 70 | {license} as published by the free software foundation either version 3 of the license or
gpl            | 70 | you should have received a copy of the gnu general public {license}
lgpl           | 70 | you should have received a copy of the gnu lesser general public {license}
agpl           | 70 | you should have received a copy of the gnu affero general public {license}
gpl            | 70 | without even the implied {warranty} of merchantability or fitness for a particular purpose
mpl-2.0        | 70 | subject to the terms of the mozilla public {license} v 2 0
epl            | 70 | made available under the terms of the eclipse public {license}
zlib           | 70 | provided as is without any express or implied {warranty}
zlib           | 70 | the origin of this software must not be {misrepresented}
unlicense      | 70 | this is free and {unencumbered} software released into the public domain
public-domain  | 70 | (?:released|placed|dedicated) (?:in ?to|in|to) the public {domain}
public-domain  | 70 | (?:this work|this software|this file) is in the public {domain}
proprietary    | 70 | {copyright} (?:\\S+ ){1,30}?all rights reserved
proprietary    | 70 | all rights {reserved}
proprietary    | 70 | {proprietary} and confidential
proprietary    | 70 | unauthorized copying of this {file}
beerware       | 70 | you can buy me a {beer} in return
apache-2.0     | 60 | apache org {licenses} license 2 0
gpl            | 60 | gnu org {licenses} gpl(?: html)?
gpl-2.0        | 60 | gnu org {licenses} (?:old licenses )?gpl 2 0
gpl-3.0        | 60 | gnu org {licenses} gpl 3 0
lgpl           | 60 | gnu org {licenses} lgpl(?: html)?
agpl           | 60 | gnu org {licenses} agpl(?: html)?
mit            | 60 | opensource org {licenses} mit(?: license)?
bsd-3          | 60 | opensource org {licenses} bsd 3 clause
bsd-2          | 60 | opensource org {licenses} bsd 2 clause
isc            | 60 | opensource org {licenses} isc
cc-by          | 60 | creativecommons org {licenses} by [1-4] [05]
cc-by-sa       | 60 | creativecommons org {licenses} by sa [1-4] [05]
cc-by-nc       | 60 | creativecommons org {licenses} by nc [1-4] [05]
cc-by-nc-sa    | 60 | creativecommons org {licenses} by nc sa [1-4] [05]
cc0-1.0        | 60 | creativecommons org publicdomain zero 1 0 {license}
mpl-2.0        | 60 | {mozilla} org mpl(?: 2 0)?
epl            | 60 | eclipse org legal {epl}(?: v\\d+)?
reference      | 40 | (?:released|distributed|licensed|available|provided) under (?:the |a |an )?(?:\\S+ ){0,3}{license}
reference      | 40 | see (?:the )?{license}(?: file)?(?: for details)?
reference      | 40 | {license} agreement
reference      | 40 | {license} terms
reference      | 40 | {copyleft}
"""

# Substrings one of which every keyword holds; a text without them is passed over.
STEMS = ("licen", "spdx", "gpl", "bsd", "wtfpl", "permission", "copyright", "copyleft", "redistribution",
         "contributors", "advertising", "warranty", "misrepresented", "unencumbered", "domain", "reserved",
         "proprietary", "file", "beer", "mozilla", "epl")


def max_words(pattern: str) -> int:
    """Upper bound of the words that a rule's side matches: its words, repeated groups at their highest count."""
    plain = re.sub(r"\(\?:([^()]*)\)\{\d+,(\d+)\}\??", lambda m: m.group(1) * int(m.group(2)), pattern)
    if re.search(r"(?<!\\)\.|\)[+*{]|\s[+*{]|\\[sWDB]|\[\^", plain):
        raise ValueError(f"a rule's gap must be a bounded group of words: {pattern!r}")
    return len(plain.split())


def parse_rules(base: str = BASE_RULES, more: str = MORE_RULES) -> list[dict]:
    """Rules in order: label, priority, base flag, keyword, patterns before and after it, literal word needed."""
    rules = []
    for is_base, block in ((True, base), (False, more)):
        for line in filter(None, map(str.strip, block.splitlines())):
            label, priority, text = (x.strip() for x in line.split("|", 2))
            before, keyword, after = re.fullmatch(r"(.*?)\{(\w+)\}(.*)", text).groups()
            sides = [x for x in (before, after) if not re.search(r"[|(?\\\[]", x)]
            literal = max((w for x in sides for w in x.split()), key=len, default="")
            rules.append({
                "label": label, "priority": int(priority), "rank": len(rules), "base": is_base, "keyword": keyword,
                "before": f"(?:^| )((?:{before}))$" if before else "",
                # the blank beside the keyword is part of an optional group or of the pattern, on either side
                "after": f"^((?:{after}))(?: |$)" if after else "", "needs": literal,
                "left": max_words(before), "right": max_words(after)})
    return rules


RULES = parse_rules()
_SCHEMA = ("map<string,struct<left:int,right:int,rules:array<struct<label:string,priority:int,rank:int,base:boolean,"
           "before:string,after:string,needs:string>>>>")


def _n_words(joined: Column) -> Column:
    """Words of a blank-joined string without blanks at its ends."""
    s = F.trim(joined)
    return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)


def _try_rule(r: Column, at: Column, left: Column, right: Column) -> Column:
    """The detection of one rule at a keyword's place, or null."""
    b = F.when(r["before"] == "", F.lit("")).otherwise(F.call_function("regexp_extract", left, r["before"], F.lit(1)))
    a = F.when(r["after"] == "", F.lit("")).otherwise(F.call_function("regexp_extract", right, r["after"], F.lit(1)))

    def made(ba: Column) -> Column:
        ok = ((r["before"] == "") | (ba["b"] != "") | F.regexp(left, r["before"])) \
            & ((r["after"] == "") | (ba["a"] != "") | F.regexp(right, r["after"]))
        return F.when(ok, F.struct(
            r["label"].alias("label"), r["priority"].alias("priority"), r["rank"].alias("rank"),
            r["base"].alias("base"), (at - _n_words(ba["b"])).alias("start"),
            (at + 1 + _n_words(ba["a"])).alias("end")))

    return let(F.struct(b.alias("b"), a.alias("a")), made)


def _covers(o: Column, d: Column) -> Column:
    longer = (o["end"] - o["start"]) > (d["end"] - d["start"])
    first = (o["priority"] > d["priority"]) | ((o["priority"] == d["priority"]) & (o["rank"] < d["rank"]))
    inside = (o["start"] <= d["start"]) & (o["end"] >= d["end"]) & (o["priority"] >= d["priority"]) & (longer | first)
    names = (d["priority"] <= MENTION) & (o["priority"] > d["priority"]) \
        & (o["start"] >= d["start"]) & (o["end"] <= d["end"])
    return inside | names


def _detections(w: Column, rules: list[dict]) -> Column:
    by_word: dict[str, dict] = {}
    for r in rules:
        of_word = by_word.setdefault(r["keyword"], {"left": 0, "right": 0, "rules": []})
        of_word["left"], of_word["right"] = max(of_word["left"], r["left"]), max(of_word["right"], r["right"])
        of_word["rules"].append({k: v for k, v in r.items() if k not in ("keyword", "left", "right")})
    table = F.from_json(F.lit(json.dumps(by_word)), _SCHEMA)
    places = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"))),
                      lambda s: s["word"].isin(*by_word))

    def at_place(p: Column) -> Column:
        def tried(k: Column) -> Column:
            left = F.concat(F.array_join(F.slice(w, F.greatest(p["at"] - k["left"] + 1, F.lit(1)),
                                                 F.least(p["at"], k["left"])), " "), F.lit(" "))
            right = F.concat(F.lit(" "), F.array_join(F.slice(w, p["at"] + 2, k["right"]), " "))
            return let(F.struct(left.alias("l"), right.alias("r")), lambda s: F.filter(F.transform(
                F.filter(k["rules"], lambda r: (r["needs"] == "") | s["l"].contains(r["needs"])
                         | s["r"].contains(r["needs"])),
                lambda r: _try_rule(r, p["at"], s["l"], s["r"])), lambda d: d.isNotNull()))

        return let(table[p["word"]], tried)

    found = F.filter(F.transform(places, at_place), lambda ds: F.size(ds) > 0)
    # a keyword at each word: so many places away at most starts what contains a detection
    reach = max(r["left"] + 1 + r["right"] for r in rules)

    def unsuppressed(ds: Column, j: Column, hits: Column) -> Column:
        return let(F.flatten(F.slice(hits, F.greatest(j - reach + 1, F.lit(1)), 2 * reach + 1)),
                   lambda near: F.filter(ds, lambda d: d["base"] | ~F.exists(near, lambda o: _covers(o, d))))

    return let(found, lambda hits: F.flatten(F.transform(hits, lambda ds, j: unsuppressed(ds, j, hits))))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  rules: list[dict] | None = None) -> DataFrame:
    """``(doc_id, n_words, detections)``: kept detections (label, priority, rank, base, start, end), by place.

    ``start`` and ``end`` count words from 0, ``end`` exclusive.
    """
    rules = rules or RULES
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("low", F.lower("t"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains("low", F.lit(stem))
    d = d.select("doc_id", "t", gate.alias("gate"),
                 F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint").alias("n_words"))
    words = F.filter(F.split(F.regexp_replace(ascii_lower(F.col("t")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "),
                     lambda x: x != "")
    kept = let(words, lambda w: _detections(w, rules))
    none = F.from_json(F.lit("[]"), "array<struct<label:string,priority:int,rank:int,base:boolean,start:int,end:int>>")
    return d.select("doc_id", "n_words", F.when(F.col("gate"), kept).otherwise(none).alias("detections"))


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: the base phrases' places, all labels, and the best kept priority as a score."""
    s = scan_licenses(docs)
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    labels = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return s.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / F.lit(100.0)).alias("score"))


def oracle() -> str:
    """DuckDB twin of ``license_report`` over the same rules, on twice the words that any rule can span."""
    span = 2 * max(r["left"] + 1 + r["right"] for r in RULES)
    values = ",\n".join("('{label}',{priority},{rank},{base},'{keyword}','{before}','{after}')".format(**r) for r in RULES)
    return rf"""
WITH rules(label, priority, rank, base, keyword, before, after) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
k AS (SELECT rid, w, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
c AS (SELECT rid, p, label, priority, rank, base, before, after,
        array_to_string(w[greatest(p-{span - 1},1):p],' ') || ' ' AS l,
        ' ' || array_to_string(w[p+2:p+{span + 1}],' ') AS r
      FROM k JOIN rules ON word = keyword),
m AS (SELECT *, CASE WHEN before='' THEN '' ELSE regexp_extract(l, before, 1) END AS mb,
        CASE WHEN after='' THEN '' ELSE regexp_extract(r, after, 1) END AS ma FROM c
      WHERE (before='' OR regexp_matches(l, before)) AND (after='' OR regexp_matches(r, after))),
h AS (SELECT rid, label, priority, rank, base,
        p - CASE WHEN trim(mb)='' THEN 0 ELSE len(string_split(trim(mb),' ')) END AS s,
        p + 1 + CASE WHEN trim(ma)='' THEN 0 ELSE len(string_split(trim(ma),' ')) END AS e FROM m),
kept AS (SELECT * FROM h AS x WHERE base OR NOT EXISTS (SELECT 1 FROM h AS o WHERE o.rid = x.rid
        AND ((o.s <= x.s AND o.e >= x.e AND o.priority >= x.priority AND (o.e-o.s > x.e-x.s OR o.priority > x.priority
          OR (o.priority = x.priority AND o.rank < x.rank)))
          OR (x.priority <= {MENTION} AND o.priority > x.priority AND o.s >= x.s AND o.e <= x.e)))),
g AS (SELECT rid, count(*) FILTER (base) AS n, min(s) FILTER (base) AS f, max(s) FILTER (base) AS t,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl,
        string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(priority)/100.0 AS sc FROM kept GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n,0)::BIGINT AS n_base, f::BIGINT AS first_word, t::BIGINT AS last_word,
  coalesce(bl,'') AS base_labels, coalesce(al,'') AS labels, coalesce(sc,0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid)"""
