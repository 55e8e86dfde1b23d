"""License scans by ordered signature rules.

Rules are regular expressions over the words of a text, hundreds of them, written by hand in RULES. Each has a keyword that all its matches hold; the words
of a text are looked up among the keywords, and a rule only runs where its own is there, so a text without any costs no more than cutting it into words.
Where one is, the words are put into a line with their numbers, from which a match tells its place. Detections overlap ("gnu lesser general
public license" holds "general public license"); a detection that lies within another of the same or a higher priority is suppressed.
All of it is SQL expressions on one row, linear in the matches but for their sorting: nothing is shuffled.

Edge cases: a null or empty text has no words, no labels and score 0; a very long text is one row, whose words, matches and numbered line
are held at once; other columns pass, but for those of the added names (use prefix to keep them); repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbframe.llm.common import table, unused

#: A word: letters and digits of ASCII, and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases that always count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, priority, confidence: rule. A rule is a regular expression for each word; a word that ends in ? may be absent. Priorities: 6 an SPDX
# identifier, 5 the words of a license or its address, 4 a sentence that grants it, 3 its full name, 2 a short name, 1 a bare one. Names without a version
# hold no words before them, so that they lie within the detections that have one.
RULES = """
mit 6 1.0: spdx license identifier mit
mit 5 1.0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 4 0.95: licen[cs]ed under the? terms? of? the? mit licen[cs]e
mit 4 0.95: released|distributed|published|available|provided under the? terms? of? the? mit licen[cs]e
mit 4 0.9: this|the software|project|library|code is mit licen[cs]ed
mit 3 0.9: under the? mit licen[cs]e
mit 3 0.9: under the? expat licen[cs]e
mit 3 0.85: mit x11 licen[cs]e
mit 2 0.7: the? mit licen[cs]e
mit 2 0.7: the? expat licen[cs]e
mit 2 0.6: licen[cs]e mit
mit 2 0.6: mit licen[cs]ed
mit-0 6 1.0: spdx license identifier mit 0
mit-0 4 0.95: under the? mit no attribution licen[cs]e?
mit-0 3 0.85: mit no attribution
mit-0 3 0.85: mit 0 licen[cs]e
mit-0 3 0.85: licen[cs]e mit 0
apache-1 6 1.0: spdx license identifier apache 1 [01]
apache-1 4 0.95: licen[cs]ed under the apache software? licen[cs]e version 1 [01]
apache-1 3 0.85: apache software? licen[cs]e version? 1 [01]
apache-2 6 1.0: spdx license identifier apache 2 0
apache-2 5 1.0: you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 5 0.95: http|https www apache org licenses license 2 0
apache-2 4 0.95: licen[cs]ed under the? terms? of? the? apache licen[cs]e v?|version? 2|v2 0?
apache-2 4 0.95: released|distributed|published|available|provided under the? terms? of? the? apache licen[cs]e version? 2|v2 0?
apache-2 4 0.95: licen[cs]ed under the? apache 2 0? licen[cs]e?
apache-2 4 0.9: subject to the? terms? of? the? apache licen[cs]e version? 2|v2 0?
apache-2 3 0.9: under the? apache licen[cs]e version? 2|v2 0?
apache-2 3 0.9: apache licen[cs]e version 2 0?
apache-2 3 0.85: apache software licen[cs]e version? 2|v2 0?
apache-2 2 0.7: apache licen[cs]e v2 0?
apache-2 2 0.7: apache 2 0? licen[cs]ed?
apache-2 2 0.7: apache 2 0? licen[cs]e
apache-2 2 0.6: licen[cs]e apache 2 0?
apache-2 2 0.6: apache2 licen[cs]ed?
apache-2 1 0.5: apache2
apache 1 0.5: apache licen[cs]e
bsd-2-clause 6 1.0: spdx license identifier bsd 2 clause
bsd-2-clause 4 0.95: under the? terms? of? the? bsd 2 clause licen[cs]e?
bsd-2-clause 4 0.95: under the? terms? of? the? simplified|freebsd bsd? licen[cs]e
bsd-2-clause 3 0.85: bsd 2 clause
bsd-2-clause 3 0.85: 2|two clause bsd licen[cs]e?
bsd-2-clause 3 0.85: simplified bsd licen[cs]e?
bsd-2-clause 2 0.7: freebsd licen[cs]e
bsd-3-clause 6 1.0: spdx license identifier bsd 3 clause
bsd-3-clause 5 0.95: nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause 4 0.95: under the? terms? of? the? bsd 3 clause licen[cs]e?
bsd-3-clause 4 0.95: under the? terms? of? the? new|revised|modified bsd licen[cs]e
bsd-3-clause 3 0.85: bsd 3 clause
bsd-3-clause 3 0.85: 3|three clause bsd licen[cs]e?
bsd-3-clause 3 0.85: new|revised|modified bsd licen[cs]e?
bsd-4-clause 6 1.0: spdx license identifier bsd 4 clause
bsd-4-clause 5 0.95: all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment
bsd-4-clause 3 0.85: bsd 4 clause
bsd-4-clause 3 0.85: 4|four clause bsd licen[cs]e?
bsd-4-clause 3 0.85: original|old bsd licen[cs]e
bsd-0 6 1.0: spdx license identifier 0bsd
bsd-0 3 0.85: bsd zero clause licen[cs]e?
bsd-0 2 0.7: 0bsd licen[cs]e
bsd 5 0.95: redistribution and use in source and binary forms with or without modification are permitted
bsd 4 0.9: licen[cs]ed under the? terms? of? the|a bsd style? licen[cs]e
bsd 3 0.85: under the|a bsd style? licen[cs]e
bsd 2 0.7: the? bsd licen[cs]e
bsd 2 0.6: bsd style licen[cs]e
bsd 2 0.6: bsd licen[cs]ed
bsd 2 0.6: licen[cs]e bsd
isc 6 1.0: spdx license identifier isc
isc 5 1.0: permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
isc 4 0.95: licen[cs]ed under the? terms? of? the? isc licen[cs]e
isc 3 0.9: under the? isc licen[cs]e
isc 2 0.7: the? isc licen[cs]e
isc 2 0.7: internet systems consortium licen[cs]e
isc 2 0.6: licen[cs]e isc
zlib 6 1.0: spdx license identifier zlib
zlib 5 0.95: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 3 0.9: under the? zlib libpng? licen[cs]e
zlib 2 0.7: zlib libpng? licen[cs]e
boost-1 6 1.0: spdx license identifier bsl 1 0
boost-1 5 0.95: http|https www boost org license 1 0 txt
boost-1 4 0.95: distributed under the boost software license version? 1? 0?
boost-1 3 0.85: boost software license version? 1? 0?
boost-1 2 0.7: boost licen[cs]e
gpl-1 6 1.0: spdx license identifier gpl 1 0 only|or?
gpl-1 4 0.95: gnu general public license version 1
gpl-1 3 0.85: gpl version? 1|v1
gpl-2 6 1.0: spdx license identifier gpl 2 0 only|or?
gpl-2 5 1.0: under the terms of the gnu general public license as published by the free software foundation either? version 2
gpl-2 4 0.95: licen[cs]ed under the? terms? of? the? gnu? gpl version? 2|v2|gplv2
gpl-2 4 0.95: under the? terms? of? the? gnu? gplv2
gpl-2 4 0.95: gnu? general public licen[cs]e version? 2|v2
gpl-2 3 0.85: gnu? gpl version? 2|v2
gpl-2 2 0.7: licen[cs]e gpl 2|v2
gpl-2 2 0.7: gplv2
gpl-3 6 1.0: spdx license identifier gpl 3 0 only|or?
gpl-3 5 1.0: under the terms of the gnu general public license as published by the free software foundation either? version 3
gpl-3 4 0.95: licen[cs]ed under the? terms? of? the? gnu? gpl version? 3|v3|gplv3
gpl-3 4 0.95: under the? terms? of? the? gnu? gplv3
gpl-3 4 0.95: gnu? general public licen[cs]e version? 3|v3
gpl-3 3 0.85: gnu? gpl version? 3|v3
gpl-3 2 0.7: licen[cs]e gpl 3|v3
gpl-3 2 0.7: gplv3
gpl 5 0.9: you should have received a copy of the gnu general public license along with this program
gpl 3 0.85: gnu general public licen[cs]e
gpl 2 0.7: gnu gpl
gpl 2 0.6: general public licen[cs]e
gpl 1 0.5: gpl
gpl 2 0.6: gpl licen[cs]ed?
gpl 2 0.6: gpl licen[cs]e
gpl 2 0.6: licen[cs]e gpl
lgpl-2.1 6 1.0: spdx license identifier lgpl 2 1 only|or?
lgpl-2.1 5 1.0: under the terms of the gnu lesser general public license as published by the free software foundation either? version 2 1
lgpl-2.1 4 0.95: gnu? lesser general public licen[cs]e version? 2|v2 1
lgpl-2.1 4 0.95: under the? terms? of? the? gnu? lgpl version? 2|v2 1
lgpl-2.1 3 0.85: lgpl version? 2|v2 1
lgpl-2.1 2 0.7: lgplv2 1
lgpl-3 6 1.0: spdx license identifier lgpl 3 0 only|or?
lgpl-3 5 1.0: under the terms of the gnu lesser general public license as published by the free software foundation either? version 3
lgpl-3 4 0.95: gnu? lesser general public licen[cs]e version? 3|v3
lgpl-3 4 0.95: under the? terms? of? the? gnu? lgpl version? 3|v3
lgpl-3 3 0.85: lgpl version? 3|v3
lgpl-3 2 0.7: lgplv3
lgpl-2 4 0.95: gnu? library general public licen[cs]e version? 2|v2
lgpl 2 0.7: gnu? lesser general public licen[cs]e
lgpl 2 0.7: gnu library general public licen[cs]e
lgpl 2 0.6: gnu lgpl
lgpl 1 0.5: lgpl
lgpl 2 0.6: lgpl licen[cs]ed?
lgpl 2 0.6: licen[cs]e lgpl
agpl-3 6 1.0: spdx license identifier agpl 3 0 only|or?
agpl-3 5 1.0: under the terms of the gnu affero general public license as published by the free software foundation either? version 3
agpl-3 4 0.95: gnu? affero general public licen[cs]e version? 3|v3
agpl-3 3 0.85: agpl version? 3|v3
agpl-3 2 0.7: agplv3
agpl 3 0.85: gnu? affero general public licen[cs]e
agpl 2 0.7: gnu agpl
agpl 1 0.5: agpl
agpl 2 0.6: agpl licen[cs]e
agpl 2 0.6: licen[cs]e agpl
mpl-1.1 6 1.0: spdx license identifier mpl 1 1
mpl-1.1 4 0.95: mozilla public license version? 1 1
mpl-1.1 3 0.85: mpl version? 1|v1 1
mpl-2 6 1.0: spdx license identifier mpl 2 0
mpl-2 5 1.0: this source code form is subject to the terms of the mozilla public license v|version? 2 0?
mpl-2 5 0.95: http|https mozilla org mpl 2 0
mpl-2 4 0.95: mozilla public license v|version? 2|v2 0?
mpl-2 3 0.85: mpl version? 2|v2 0?
mpl 2 0.7: mozilla public licen[cs]e
mpl 2 0.6: licen[cs]e mpl
epl-1 6 1.0: spdx license identifier epl 1 0
epl-1 4 0.95: eclipse public license v|version? 1|v1 0?
epl-2 6 1.0: spdx license identifier epl 2 0
epl-2 4 0.95: eclipse public license v|version? 2|v2 0?
epl 2 0.7: eclipse public licen[cs]e
epl 2 0.6: licen[cs]e epl
cddl-1 6 1.0: spdx license identifier cddl 1 0
cddl-1 4 0.95: common development and distribution license version? 1? 0?
cddl-1 2 0.6: cddl licen[cs]e
cddl-1 2 0.6: cddl version? 1|v1 0?
cpl-1 6 1.0: spdx license identifier cpl 1 0
cpl-1 3 0.85: common public license version? 1? 0?
artistic-1 6 1.0: spdx license identifier artistic 1 0
artistic-1 3 0.85: artistic licen[cs]e version? 1 0?
artistic-2 6 1.0: spdx license identifier artistic 2 0
artistic-2 3 0.85: artistic licen[cs]e version? 2 0?
artistic 4 0.9: under the same terms as perl itself
artistic 2 0.7: the? perl? artistic licen[cs]e
unlicense 6 1.0: spdx license identifier unlicense
unlicense 5 1.0: this is free and unencumbered software released into the public domain
unlicense 4 0.95: under|with the unlicense
unlicense 2 0.7: the unlicense
unlicense 2 0.6: licen[cs]e unlicense
wtfpl 6 1.0: spdx license identifier wtfpl
wtfpl 4 0.95: do what the fuck you want to public licen[cs]e
wtfpl 2 0.6: wtfpl licen[cs]e?
cc0-1 6 1.0: spdx license identifier cc0 1 0
cc0-1 5 0.95: creativecommons org publicdomain zero 1 0
cc0-1 4 0.95: creative commons zero v1|version? 1? 0? universal?
cc0-1 4 0.9: cc0 1 0 universal
cc0-1 3 0.85: dedicated to the public domain under cc0
cc0-1 2 0.7: cc0 1? 0? licen[cs]e
cc0-1 2 0.6: licen[cs]e cc0
cc0-1 1 0.5: cc0 1 0
cc-by 6 1.0: spdx license identifier cc by [1-4] [05]
cc-by 5 0.95: creativecommons org licenses by [1-4] [05]
cc-by 4 0.95: creative commons attribution [1-4]? [05]? international? licen[cs]e
cc-by 3 0.85: creative commons attribution [1-4] [05]
cc-by 3 0.85: under the? a? cc by [1-4] [05]
cc-by 3 0.85: under the? a? cc by licen[cs]e
cc-by 2 0.7: cc by [1-4] [05]
cc-by 2 0.6: cc by licen[cs]e
cc-by-sa 6 1.0: spdx license identifier cc by sa [1-4] [05]
cc-by-sa 5 0.95: creativecommons org licenses by sa [1-4] [05]
cc-by-sa 4 0.95: creative commons attribution share alike [1-4]? [05]? international? unported? licen[cs]e?
cc-by-sa 4 0.95: creative commons attribution sharealike [1-4]? [05]? international? unported? licen[cs]e?
cc-by-sa 3 0.85: cc by sa [1-4] [05]
cc-by-sa 3 0.8: cc by sa licen[cs]e?
cc-by-nc 6 1.0: spdx license identifier cc by nc [1-4] [05]
cc-by-nc 5 0.95: creativecommons org licenses by nc [1-4] [05]
cc-by-nc 4 0.95: creative commons attribution non commercial [1-4]? [05]? international? licen[cs]e?
cc-by-nc 4 0.95: creative commons attribution noncommercial [1-4]? [05]? international? licen[cs]e?
cc-by-nc 3 0.85: cc by nc [1-4] [05]
cc-by-nc 3 0.8: cc by nc licen[cs]e?
cc-by-nd 6 1.0: spdx license identifier cc by nd [1-4] [05]
cc-by-nd 5 0.95: creativecommons org licenses by nd [1-4] [05]
cc-by-nd 4 0.95: creative commons attribution no derivatives [1-4]? [05]? international? licen[cs]e?
cc-by-nd 4 0.95: creative commons attribution noderivatives|noderivs [1-4]? [05]? international? licen[cs]e?
cc-by-nd 3 0.85: cc by nd [1-4] [05]
cc-by-nd 3 0.8: cc by nd licen[cs]e?
cc-by-nc-sa 6 1.0: spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa 5 0.95: creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa 5 0.95: creative commons attribution noncommercial sharealike [1-4]? [05]? international? licen[cs]e?
cc-by-nc-sa 4 0.85: cc by nc sa [1-4]? [05]? licen[cs]e?
cc-by-nc-nd 6 1.0: spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd 5 0.95: creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd 5 0.95: creative commons attribution noncommercial noderivatives|noderivs [1-4]? [05]? international? licen[cs]e?
cc-by-nc-nd 4 0.85: cc by nc nd [1-4]? [05]? licen[cs]e?
cc 2 0.6: under a creative commons licen[cs]e
cc 1 0.5: creative commons licen[cs]e
odbl-1 6 1.0: spdx license identifier odbl 1 0
odbl-1 4 0.95: open data commons open database licen[cs]e
odbl-1 3 0.85: open database licen[cs]e version? 1? 0?
odbl-1 2 0.6: odbl licen[cs]e
ofl-1.1 6 1.0: spdx license identifier ofl 1 1
ofl-1.1 4 0.95: sil open font licen[cs]e version? 1? 1?
ofl-1.1 3 0.85: open font licen[cs]e version? 1? 1?
eupl-1.2 6 1.0: spdx license identifier eupl 1 2
eupl-1.2 4 0.95: european union public licen[cs]e version? 1|v1 2
eupl-1.2 3 0.8: eupl version? 1 2
ms-pl 6 1.0: spdx license identifier ms pl
ms-pl 4 0.95: microsoft public licen[cs]e
ms-rl 6 1.0: spdx license identifier ms rl
ms-rl 4 0.95: microsoft reciprocal licen[cs]e
postgresql 6 1.0: spdx license identifier postgresql
postgresql 3 0.85: under the? postgresql licen[cs]e
postgresql 2 0.7: postgresql licen[cs]e
python-2 6 1.0: spdx license identifier psf|python 2 0
python-2 4 0.95: python software foundation licen[cs]e version? 2?
python-2 2 0.7: psf licen[cs]e
openssl 6 1.0: spdx license identifier openssl
openssl 5 0.95: this product includes software developed by the openssl project
openssl 2 0.7: openssl licen[cs]e
ncsa 6 1.0: spdx license identifier ncsa
ncsa 4 0.95: university of illinois ncsa open source licen[cs]e
afl-3 6 1.0: spdx license identifier afl 3 0
afl-3 3 0.85: academic free licen[cs]e version? 3? 0?
osl-3 6 1.0: spdx license identifier osl 3 0
osl-3 3 0.85: open software licen[cs]e version? 3? 0?
gfdl 6 1.0: spdx license identifier gfdl 1 [123] only|or?
gfdl 4 0.95: gnu free documentation licen[cs]e version? 1? [123]?
public-domain 4 0.9: released|placed|dedicated in|into|to the public domain
public-domain 2 0.6: this work is in the public domain
proprietary 6 1.0: spdx license identifier licenseref proprietary
proprietary 5 0.9: unauthorized copying of this file via any medium is strictly prohibited
proprietary 4 0.9: proprietary and confidential
proprietary 4 0.9: under the? terms? of? a|the proprietary|commercial licen[cs]e
proprietary 2 0.7: proprietary licen[cs]e
proprietary 2 0.6: all rights reserved proprietary
"""

#: Words that tell little; only a rule that has no others takes one for its keyword.
COMMON = set("a an all and any as by copy distribute distributed domain either fee file for foundation free from general granted hereby http https identifier in into is it its license licence licensed licenced licenses made may name names new no not nor of old open or org original permission public published project provided purpose received released source software terms that the this to under use used version via was with www you".split())

#: Detections that one step of suppression takes together.
TOGETHER = 256

def expansions(word: str) -> list[str]:
    """All that a word of a rule stands for."""
    out = []
    for choice in word.removesuffix("?").split("|"):
        parts = re.split(r"\[([^\]]*)\]", choice)
        kinds = ["".join(chr(c) for a, b in re.findall("(.)-(.)", p) for c in range(ord(a), ord(b) + 1)) or p if i % 2 else [p] for i, p in enumerate(parts)]
        out += ["".join(x) for x in itertools.product(*kinds)]
    return out


def pattern(rule: str, mark: str = "") -> str:
    """A regular expression over words that each have a space before and, after the mark, behind them."""
    return "".join(f"(?: (?:{w.removesuffix('?')}){mark} )" + ("?" if w.endswith("?") else "") for w in rule.split())


def keywords(rule: str) -> list[str]:
    """The words of which every match of a rule holds one: what its most telling word stands for."""
    needed = [expansions(w) for w in rule.split() if not w.endswith("?")]
    return max(needed, key=lambda ws: min(0 if w in COMMON or w.isdigit() else len(w) for w in ws))


def rules() -> list[tuple[str, int, float, str]]:
    """(label, priority, confidence, rule) in order; the first of two equal detections stays."""
    out = []
    for line in RULES.strip().splitlines():
        head, _, rule = line.partition(": ")
        label, priority, sure = head.split()
        out.append((label, int(priority), float(sure), rule))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _suppressed(found: Column) -> Column:
    """Of detections (start, -stop, -priority, rule) those that lie in no other of the same or a higher priority."""
    kind = "struct<start:bigint,stop:bigint,priority:int,rule:int>"

    # In the order of start, longest first, highest priority first, a detection lies within an earlier one of the same or a higher
    # priority if the furthest end of those is no less than its own.
    def step(acc: Column, d: Column) -> Column:
        stop, p = -d.stop, -d.priority
        inside = F.array_max(F.slice(acc.ends, p, 7 - p)) >= stop
        ends = F.transform(acc.ends, lambda e, i: F.when(i + 1 == p, F.greatest(e, stop)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, acc.kept).otherwise(F.array_append(acc.kept, d)).alias("kept"))

    # Appending copies an array, so a few are gathered at a time.
    def steps(acc: Column, some: Column) -> Column:
        begin = F.struct(acc.ends.alias("ends"), F.array().cast(f"array<{kind}>").alias("kept"))
        return let(F.aggregate(some, begin, step), lambda x: F.struct(x.ends.alias("ends"), F.array_append(acc.kept, x.kept).alias("kept")))

    begin = F.struct(F.array(*[F.lit(-1).cast("long")] * 6).alias("ends"), F.array().cast(f"array<array<{kind}>>").alias("kept"))
    parts = lambda f: F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / TOGETHER).cast("int")), lambda i: F.slice(f, i * TOGETHER + 1, TOGETHER))
    kept = let(F.array_sort(found), lambda f: F.aggregate(parts(f), begin, steps, lambda acc: F.flatten(acc.kept)))
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(f"array<{kind}>"))


def scan_licenses(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with <prefix>n_words, <prefix>base (places of base phrases: label, start) and <prefix>detections
    (label, rule, priority, confidence, start, stop) after suppression."""
    every = rules()
    needed = [keywords(rule) for *_, rule in every]
    telling = sorted({w for ws in needed for w in ws} | {w for p in BASE for w in keywords(p)})
    cut, held, line, found = (unused(docs.columns, n) for n in ("_lic_cut", "_lic_held", "_lic_line", "_lic_found"))
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() may make ASCII letters of others, never a gap, so words are as many, and no keyword of the exact words is missed.
    rough = docs.withColumn(cut, F.split(F.lower(t), GAP, -1))
    c = F.col(cut)
    empty = (F.element_at(c, 1) == "").cast("long") + ((F.size(c) > 1) & (F.element_at(c, -1) == "")).cast("long")
    counted = rough.withColumn(f"{prefix}n_words", F.size(c).cast("long") - empty).withColumn(held, F.array_intersect(c, F.array(*map(F.lit, telling)))).drop(cut)
    words = F.split(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), GAP, -1)
    numbered = F.transform(F.array_remove(words, ""), lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(" ")))
    lined = counted.withColumn(line, F.when(F.size(held) > 0, F.array_join(numbered, "")).otherwise(F.lit("")))
    none = "CAST(array() AS array<struct<rule:int,m:string>>)"
    one = lambda i, ws, rule: f"IF({' OR '.join(f'array_contains(`{held}`, {w!r})' for w in ws)}, transform(regexp_extract_all(`{line}`, '{pattern(rule, '#[0-9]+')}', 0), m -> named_struct('rule', {i}, 'm', m)), {none})"
    # Base phrases have the numbers below 0.
    parts = [one(i, ws, rule) for i, (ws, (*_, rule)) in enumerate(zip(needed, every, strict=True))] + [one(-1 - i, keywords(p), p) for i, p in enumerate(BASE)]
    # As SQL, since there are hundreds; each pattern is a literal, compiled once a task.
    matched = lined.withColumn(found, F.expr(f"IF(size(`{held}`) > 0, flatten(array({', '.join(parts)})), {none})"))
    number = lambda s: F.substring_index(s, " ", 1).cast("long")
    start = lambda x: number(F.substring_index(F.substring_index(x.m, "#", 2), "#", -1))
    stop = lambda x: number(F.substring_index(x.m, "#", -1)) + 1
    of_rules = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    labels, base_labels = of_rules([r[0] for r in every], "string"), of_rules(BASE.values(), "string")
    priority = of_rules([r[1] for r in every], "int")
    sure = of_rules([r[2] for r in every], "double")
    base = F.transform(F.filter(found, lambda x: x.rule < 0), lambda x: F.struct(F.get(base_labels, -1 - x.rule).alias("label"), start(x).alias("start")))
    spans = F.transform(F.filter(found, lambda x: x.rule >= 0), lambda x: F.struct(start(x).alias("start"), (-stop(x)).alias("stop"), (-F.get(priority, x.rule)).alias("priority"), x.rule.alias("rule")))
    detections = F.transform(_suppressed(spans), lambda d: F.struct(F.get(labels, d.rule).alias("label"), d.rule.alias("rule"), (-d.priority).alias("priority"), F.get(sure, d.rule).alias("confidence"), d.start.alias("start"), (-d.stop).alias("stop")))
    return matched.withColumn(f"{prefix}base", base).withColumn(f"{prefix}detections", detections).drop(held, line, found)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs)
    base, labels = F.transform("base", lambda b: b.label), F.transform("detections", lambda d: d.label)
    starts = F.transform("base", lambda b: b.start)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, labels)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d.confidence)), F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL: every rule on every text, without looking for keywords first."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    rule_rows = ", ".join(f"({i}, {quoted(label)}, {p}, {c}::DOUBLE, {quoted(pattern(x))})" for i, (label, p, c, x) in enumerate(rules()))
    base_rows = ", ".join(f"({quoted(label)}, {quoted(pattern(phrase))})" for phrase, label in BASE.items())
    # Places: of the k-th match the words between and in all matches before it, and the words before it.
    places = "list_transform(range(1, len(found) + 1), lambda k: struct_pack(start := (list_sum(list_transform(between[1:k], lambda x: len(x) - len(replace(x, ' ', '')))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x) - len(replace(x, ' ', '')))), 0))::BIGINT // 2, stop := (list_sum(list_transform(between[1:k], lambda x: len(x) - len(replace(x, ' ', '')))) + list_sum(list_transform(found[1:k], lambda x: len(x) - len(replace(x, ' ', '')))))::BIGINT // 2))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
n AS (SELECT *, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS line FROM w),
base_rules(label, pattern) AS (VALUES {base_rows}),
base_found AS (SELECT id, label, regexp_extract_all(line, pattern) AS found, string_split_regex(line, pattern) AS between FROM n, base_rules WHERE regexp_matches(line, pattern)),
base AS (SELECT id, label, unnest({places}).start AS start FROM base_found),
per_base AS (SELECT id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY id),
rules(rule, label, priority, confidence, pattern) AS (VALUES {rule_rows}),
hit AS (SELECT id, rule, label, priority, confidence, regexp_extract_all(line, pattern) AS found, string_split_regex(line, pattern) AS between FROM n, rules WHERE regexp_matches(line, pattern)),
spans AS (SELECT id, rule, label, priority, confidence, unnest({places}) AS s FROM hit),
det AS (SELECT id, rule, label, priority, confidence, s.start AS start, s.stop AS stop FROM spans),
kept AS (SELECT * FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE a.id = b.id AND b.start <= a.start AND b.stop >= a.stop AND b.priority >= a.priority
         AND (b.start, -b.stop, -b.priority, b.rule) < (a.start, -a.stop, -a.priority, a.rule))),
per_doc AS (SELECT id, list(DISTINCT label) AS labels, max(confidence) AS score FROM kept GROUP BY id)
SELECT n.doc_id, len(n.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word, b.last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(p.labels, [])))), ','), '') AS labels,
       coalesce(p.score, CASE WHEN b.n_base > 0 THEN 0.5::DOUBLE END, 0.0::DOUBLE) AS score
FROM n LEFT JOIN per_base b ON n.id = b.id LEFT JOIN per_doc p ON n.id = p.id
"""
