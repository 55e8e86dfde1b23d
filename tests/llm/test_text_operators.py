"""Mixing, token counts and license scans on small tables."""

import random
import re
import time

import pytest

from plumbframe.llm import bpe, licenses, mixing
from plumbframe.llm.common import running_totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_rounds(sizes):
    """Shares by weight; what is above the cap is taken off and shared again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        all_weight = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / all_weight > 2 * sizes[s]]
        if not over:
            out |= {s: budget * weight[s] / all_weight for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            open_.remove(s)
    return out


def test_mixing(spark, tables):
    rnd = random.Random(1)
    docs = [(i, " ".join("w" * 1 for _ in range(rnd.randint(0, 30))), "en", rnd.choice(["b", "a", "é", "Z", None, "", "big", "big", "big"])) for i in range(600)]
    docs += [(1000, None, "en", "a"), (1001, "", "en", None), (None, "no id here", "en", "a"), (5, docs[5][1], "en", docs[5][3]), (1002, "x " * 30000, "en", "big")]
    d = tables(documents=docs)
    rows = mixing.op1_mix(spark, d).collect()
    again = mixing.op1_mix(spark, d).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(docs)
    size = lambda t: len(WORD.findall(t or ""))
    per, source_of = {}, {}
    for i, t, _, s in docs:
        per[s] = per.get(s, 0) + size(t)
        source_of[i] = s
    want = targets_by_rounds(per)
    taken = {}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == per[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in ("a", "b", "Z"):
        assert taken[s] == pytest.approx(want[s], rel=0.25)
    mixed = mixing.mix_sources(spark.read.parquet(f"{d}/documents.parquet"), prefix="m_")
    assert mixing.emit(mixed, prefix="m_").count() == sum(r[0] for r in mixed.select("m_copies").collect())
    assert mixing.op1_mix(spark, tables(documents=[])).collect() == []


def test_running_totals(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 5), rnd.randint(1, 9)) for i in range(300)]
    got = running_totals(spark.createDataFrame(rows, "i long, g int, v long"), ["g", "i"], ["v"]).collect()
    total, want = 0, {}
    for i, g, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += v
    assert {r.i: r.before_v for r in got} == want


def test_token_counts(spark, tables):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    texts = ["", None, " ", "Hello, World!", "don't WE'LL 's", "a<|endoftext|>b<|startoftext|>", "Σίσυφος ΟΔΟΣ", "İI ſ K Å é", "x²½Ⅷ 12345", "🙂🙂!!!", "a" * 4000, "ab " * 9000, "\x1c\x85​　", "<|endoftext", "ｆｕｌｌ"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(160, 0x250), rnd.randrange(0x250, 0x3000), rnd.randrange(0x4E00, 0x4F00)])) for _ in range(40)) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "Hello"), (3, texts[3])]
    got = bpe.op5_bpe_counts(spark, tables(documents=docs)).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        n = len(reference.encode(t or "", add_special_tokens=False).ids)
        assert (by_id[i].n_tokens, by_id[i].n_bytes, by_id[i].over_limit) == (n, len((t or "").encode()), n > 2048), repr((t or "")[:50])
    assert bpe.op5_bpe_counts(spark, tables(documents=[])).collect() == []


def test_every_code_point_counts_as_in_the_library():
    """Between letters, numbers and signs, where merges tell classes apart; above the second plane every 61st."""
    P = pytest.importorskip("public_tokenizers")
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("word_bpe_49k.json"))
    count = bpe.counter(bpe.Merges.read(P.path("word_bpe_49k.json")))
    some = [chr(c) for c in [*range(1, 0x20000), *range(0x20000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a1{c}!{c}\u0301\u0316 " for c in some[i : i + 64]) for i in range(0, len(some), 64)]
    for i, (t, e) in enumerate(zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert count(t) == len(e.ids), [hex(ord(c)) for c in some[64 * i : 64 * i + 64] if count(c2 := f"a{c}a1{c}!{c}\u0301\u0316 ") != len(reference.encode(c2, add_special_tokens=False).ids)]
    rnd = random.Random(6)
    mixed = ["".join(rnd.choice(some) for _ in range(30)) for _ in range(4000)]
    assert [count(t) for t in mixed] == [len(e.ids) for e in reference.encode_batch(mixed, add_special_tokens=False)]


def test_other_tokenizer_files_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="no byte-level BPE"):
        bpe.Merges.read(P.path("byte_bpe_50k.json"))


def test_merging_takes_the_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("bc", "bc"): 3}

    def slow(symbols):
        symbols = list(symbols)
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not found:
                return len(symbols)
            _, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rnd = random.Random(4)
    for _ in range(300):
        s = [rnd.choice("abc") for _ in range(rnd.randint(0, 12))]
        assert bpe.merged_count(s, ranks) == slow(s)


def base_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(found)


def test_licenses(spark, tables):
    texts = ["Under the MIT License. under-the-mit-license", "CC BY-NC cc.by/nc", "under the mİt license", "under the mit license2", "Apache License, Version 2.0 and Apache License Version 2", "", None, "mit mit mit", "é cc by nc é", "The the mit under the mit license " * 400, "x " * 30000 + "CC BY NC", "SPDX-License-Identifier: Apache-2.0", "GNU Lesser General Public License version 3", "Licensed under the Apache License, Version 2.0."]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by nc"), (0, texts[0])]
    got = licenses.op10_licenses(spark, tables(documents=docs)).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        n, found = base_places(t)
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0 or not r.labels)
    # The longer name suppresses the one inside it.
    assert by_id[12].labels == "lgpl-3" and by_id[11].labels == "apache-2" and by_id[13].labels == "apache-2"
    assert by_id[7].labels == "" and by_id[6].score == 0.0
    assert len(licenses.rules()) > 200 and licenses.op10_licenses(spark, tables(documents=[])).collect() == []


# Written by hand, without a look at the rules: what each sentence is about.
EXPECTED = {
    "This project is licensed under the MIT License.": "mit",
    "Released under the terms of the MIT licence": "mit",
    "the software is MIT licensed": "mit",
    "License: MIT": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: MIT-0": "mit-0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": "mit",
    "under the Expat license": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
    "SPDX-License-Identifier: Apache-2.0": "apache-2",
    "Apache License 1.1": "apache-1",
    "an Apache licence": "apache",
    "BSD 3-Clause": "bsd-3-clause",
    "three clause BSD license": "bsd-3-clause",
    "the Simplified BSD License": "bsd-2-clause",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
    "distributed under a BSD-style license": "bsd",
    "ISC License": "isc",
    "zlib/libpng license": "zlib",
    "Distributed under the Boost Software License, Version 1.0.": "boost-1",
    "GNU GPL version 2 or later": "gpl-2",
    "licensed under the GPLv3": "gpl-3",
    "GNU General Public License v3": "gpl-3",
    "You should have received a copy of the GNU General Public License along with this program": "gpl",
    "GNU Lesser General Public License version 2.1": "lgpl-2.1",
    "licensed under the LGPL v3": "lgpl-3",
    "GNU Library General Public License": "lgpl",
    "GNU Affero General Public License version 3": "agpl-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Eclipse Public License - v 2.0": "epl-2",
    "Common Development and Distribution License": "cddl-1",
    "under the same terms as Perl itself": "artistic",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1",
    "Creative Commons Attribution 4.0 International License": "cc-by",
    "https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa",
    "Creative Commons Attribution NonCommercial": "cc-by-nc",
    "CC BY-ND 4.0": "cc-by-nd",
    "under the CC BY-NC-ND licence": "cc-by-nc,cc-by-nc-nd",  # the phrase cc by nc always counts
    "license: cc-by-nc-sa 4.0": "cc-by-nc,cc-by-nc-sa",
    "SIL Open Font License 1.1": "ofl-1.1",
    "European Union Public Licence v1.2": "eupl-1.2",
    "Microsoft Public License (Ms-PL)": "ms-pl",
    "PostgreSQL License": "postgresql",
    "the Python Software Foundation License": "python-2",
    "GNU Free Documentation License, Version 1.3": "gfdl",
    "proprietary and confidential": "proprietary",
    "released to the public domain": "public-domain",
    "no such thing, I submit to the committee": "",
    "a limited license to drive": "",
    "general software, version 2, for the public": "",
    "the creative commons of the village": "",
    "he has a mit and an apache": "",
}


def test_license_labels(spark, tables):
    texts = list(EXPECTED)
    got = {r.doc_id: r.labels for r in licenses.op10_licenses(spark, tables(documents=list(enumerate(texts)))).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == EXPECTED


def test_license_keywords_lose_nothing(spark):
    """Against every rule on every text, without looking for keywords first."""
    rnd = random.Random(5)
    full = lambda rule: " ".join(rnd.choice(licenses.expansions(w)) for w in rule.split())
    least = lambda rule: " ".join(rnd.choice(licenses.expansions(w)) for w in rule.split() if not w.endswith("?"))
    every = licenses.rules()
    texts = [f"it is {make(rule)} {'x ' * (i % 3)}{least(every[(i * 7) % len(every)][3])}." for i, (*_, rule) in enumerate(every) for make in (full, least)] + [*EXPECTED, ""]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "i int, text string, _lic_line string")).collect()
    compiled = [(i, label, p, re.compile(licenses.pattern(rule))) for i, (label, p, _, rule) in enumerate(every)]
    for r in got:
        words = re.findall(r"[a-z0-9]+", r.text.lower())
        line = "".join(f" {w} " for w in words)
        found = sorted((m.start(), -m.end(), -p, i, label) for i, label, p, x in compiled for m in x.finditer(line))
        kept = []
        for d in found:
            if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[: found.index(d)]):
                kept.append((d[4], d[3], line[: d[0]].count(" ") // 2, line[: -d[1]].count(" ") // 2))
        assert [(d.label, d.rule, d.start, d.stop) for d in r.detections] == kept and r.n_words == len(words) and r["_lic_line"] == "mine", r.text


def test_many_license_matches(spark):
    """330 KB of matches: places and suppression are no square of them."""
    text = "Under the MIT License. CC BY-NC 4.0 applies. " * 8000
    df = spark.createDataFrame([(text,)], "text string")
    licenses.scan_licenses(df.limit(0)).collect()
    began = time.perf_counter()
    (r,) = licenses.scan_licenses(df).collect()
    took = time.perf_counter() - began
    assert len(r.base) == 16000 and r.n_words == 80000 and [(d.start, d.stop) for d in r.detections] == [x for i in range(8000) for x in ((10 * i, 10 * i + 4), (10 * i + 4, 10 * i + 9))]
    assert took < 20, took
