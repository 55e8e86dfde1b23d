"""Jaccard join, decontamination, top-k search and archives against brute force."""

import collections
import hashlib
import base64
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbframe.llm import decontam, hashing, jaccard, topk, warc
from plumbframe.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(low(t))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    ids = {i for i, _ in rows if i is not None}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rnd, seed_words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(seed_words)
        for _ in range(rnd.randint(0, edits)):
            p = rnd.randrange(len(w))
            rnd.choice([lambda p=p: w.__setitem__(p, f"e{rnd.randrange(10**6)}"), lambda p=p: w.pop(p), lambda p=p: w.insert(p, f"i{rnd.randrange(10**6)}")])()
        out.append(" ".join(w))
    return out


def near_corpus(seed=1):
    rnd = random.Random(seed)
    texts = [" ".join(prose(rnd, rnd.randint(1, 80))) for _ in range(120)]
    hot = prose(rnd, 60)
    texts += family(rnd, hot, 90, 6)  # dense near copies
    shared = " ".join(prose(rnd, 30))
    texts += [shared + " " + " ".join(prose(rnd, rnd.randint(2, 30))) for _ in range(60)]  # one passage in many documents
    texts += [" ".join(hot)] * 40  # exact copies
    for _ in range(15):
        texts += family(rnd, prose(rnd, rnd.randint(4, 60)), 4, 2)
    texts += ["", None, "  ", "a", "A", "a b", "A  b", "a b c d", "a b c d e", "the " * 500, "the " * 499, "x y " * 12000]
    rnd.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, None), (0, texts[0])]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, tables, words, percent):
    rows = near_corpus()
    d = tables(documents=rows)
    got = jaccard.op8_jaccard(spark, d).collect() if words == 4 else jaccard.jaccard_components(table(spark, d, "documents"), words=words, percent=percent).collect()
    want = components(rows, words, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert collections.Counter(r.n_shingles for r in got) == collections.Counter(len(shingles(t, words)) for _, t in rows)


def test_jaccard_with_small_groups_and_tasks(spark, tables, monkeypatch):
    """Groups and tasks are split; the links are the same."""
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", 200)
    rows = near_corpus(2)
    got = jaccard.op8_jaccard(spark, tables(documents=rows)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == components(rows, 4, 85)


def test_jaccard_beyond_the_broadcast(spark, tables, monkeypatch):
    """Texts are shuffled to where sets go; the links are the same."""
    monkeypatch.setattr(jaccard, "ROUTES_BYTES", 0)
    rows = near_corpus(3)
    got = jaccard.op8_jaccard(spark, tables(documents=rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == components(rows, 4, 85)


def thue_morse(n, swap=False):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b ^ swap] for b in bits[:n])


def test_words_that_collide_in_polynomials_stay_apart(spark, tables):
    rows = [(2 * i + s, thue_morse(n, s)) for i, n in enumerate((8, 16, 33, 1024, 2048, 4096, 8192)) for s in (0, 1)]
    rows.append((100, thue_morse(8192)))
    got = {r.doc_id: r.component_id for r in jaccard.op8_jaccard(spark, tables(documents=rows)).collect()}
    assert got == {i: i for i, _ in rows} | {100: 12}


def test_word_hashes_follow_bytes_and_key():
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("aé🙂bcdefghB") for _ in range(rnd.randint(1, 40))).lower() for _ in range(20000)})
    of = lambda text, key=0: np.concatenate([hashing.words(data, offsets, hashing.SPACED, key=key)[0] for _, data, offsets in hashing.chunks(pa.array([None, text, ""]))])
    here = of(" ".join(words))
    assert len(np.unique(here)) == len(words)
    assert (here == of("\t".join(w.replace("b", "B") for w in reversed(words)))[::-1]).all()
    assert not np.isin(of("z" * 10**6), here).any() and not np.isin(of(" ".join(words), key=1), here).any()


def test_jaccard_edges(spark, tables):
    assert jaccard.op8_jaccard(spark, tables(documents=[])).collect() == []
    # Rows of equal id are one document, with the links of both.
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t"), (4, "z")]
    assert {r.doc_id: r.component_id for r in jaccard.op8_jaccard(spark, tables(documents=rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = jaccard.one_of_each(table(spark, tables(documents=[*rows, (None, "a b c d e"), (None, None), (9, "z z"), (9, "z z")]), "documents")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 4, 9]
    assert "node" in kept[0].asDict()


def test_jaccard_of_near_copies_with_repeated_ids(spark, tables):
    """A document of several rows asks a group with each of its sets, and is found with each."""
    rnd = random.Random(1)
    rows = []
    for f in range(300):
        t = family(rnd, [f"{f}_{x}" for x in prose(rnd, rnd.randint(20, 60))], rnd.randint(3, 6), 3)
        rows += [(f * 10 + rnd.randrange(max(2, len(t) - 1)), x) for x in t]
    got = jaccard.op8_jaccard(spark, tables(documents=rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == components(rows, 4, 85)


def test_jaccard_of_rows_without_words_and_with_repeated_ids(spark, tables):
    """All rows of an id have its component, also those that have no shingles themselves."""
    one, two, three = "a b c d e", "p q r s t", "k l m n o"
    rows = [(1, one), (2, one), (2, None), (3, "  "), (3, two), (4, two), (4, ""), (5, None), (5, ""), (6, None), (7, "\t"), (7, three), (9, one), (9, two), (9, ""), (None, ""), (None, three)]
    got = jaccard.op8_jaccard(spark, tables(documents=rows)).collect()
    want = components(rows, 4, 85)
    assert want == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 9: 1}
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter((i, len(shingles(t, 4)), want.get(i)) for i, t in rows)


def test_bounds_of_very_large_sets(spark):
    sizes = [(20, 0), (20, 3), (11_607_943, 0), (11_607_944, 0), (30_000_000, 1_000)]
    got = spark.createDataFrame(sizes, "n int, place int").select(jaccard.furthest(85).alias("f")).collect()
    assert [r.f for r in got] == [185 * (n - p) // 85 - n for n, p in sizes]


def test_chains_become_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.component for r in jaccard.connected(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert jaccard.connected(spark.createDataFrame([], "a long, b long")).collect() == []


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def leaks(docs, items):
    out = {}
    for item, t in items:
        w = NORMAL.findall((t or "").lower())
        m, k = len(w), min(5, len(w))
        if not m:
            continue
        want = collections.Counter(tuple(w[i : i + k]) for i in range(m - k + 1))
        for d, x in docs:
            v = NORMAL.findall((x or "").lower())
            for s in range(max(1, len(v) - m + 1)):
                p = v[s : s + m]
                have = collections.Counter(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
                if have and 100 * sum((have & want).values()) >= 80 * sum((have | want).values()):
                    out.setdefault((d, x), set()).add(item)
    return out


def test_decontamination(spark, tables):
    rnd = random.Random(5)
    items = [(i, " ".join(prose(rnd, rnd.randint(6, 60), 5000))) for i in range(25)] + [(25, None), (26, ""), (27, "only three words"), (28, "one"), (3, "again " * 9), (29, "the the the the the the the the")]
    docs = [(i, " ".join(prose(rnd, rnd.randint(0, 150), 5000))) for i in range(60)]
    for j in range(150):
        w = items[j % 25][1].split()
        p = rnd.randrange(len(w))
        [lambda: w.pop(0), lambda: w.__setitem__(p, "zzz"), lambda: w.insert(p, "qqq"), lambda: w.pop(p), lambda: w.append("more"), lambda: None][j % 6]()
        docs.append((1000 + j, " ".join(prose(rnd, 20, 5000) + w + prose(rnd, 20, 5000)).upper() + "!!"))
    docs += [(2000, None), (2001, ""), (2002, "only three words"), (2003, "x only three words y"), (2004, "one"), (None, items[0][1]), (2005, "the " * 4000), (1000, docs[60][1])]
    d = tables(documents=docs, benchmark=items)
    rows = decontam.op3_decontam(spark, d).collect()
    want = leaks(docs, items)
    assert len(rows) == len(docs)
    assert collections.Counter(r.doc_id for r in rows if r.contaminated) == collections.Counter(i for i, t in docs if (i, t) in want)
    per = {(i, t): len(v) for (i, t), v in want.items()}
    assert {r.doc_id: r.n_items for r in rows if r.doc_id not in (None, 1000)} == {i: per.get((i, t), 0) for i, t in docs if i not in (None, 1000)}
    kept = decontam.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    assert kept.count() == sum((i, t) not in want for i, t in docs) and "key" in kept.columns
    # In several passes over the benchmark the result is the same.
    again = decontam.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), block_shingles=100)
    assert sorted(map(str, again.collect())) == sorted(map(str, decontam.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).collect()))
    empty = decontam.op3_decontam(spark, tables(documents=docs[:3], benchmark=[])).collect()
    assert len(empty) == 3 and not any(r.contaminated for r in empty)
    assert decontam.op3_decontam(spark, tables(documents=[], benchmark=items)).collect() == []


def test_hamming_blocks_meet_within_the_radius(spark):
    rnd = random.Random(6)
    pairs = []
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 20):
            b ^= 1 << bit
        pairs.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    common = F.size(F.array_intersect(decontam.blocks_of(F.col("a"), 20), decontam.blocks_of(F.col("b"), 20)))
    assert df.filter(common == 0).count() == 0 and df.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) != 20).count() == 0


def test_top_k(spark, tables):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 0.3) + (i % 5) * 0.1 for _ in range(8)], 0) for i in range(700)]
    rows += [(700 + i, rows[50][1], 0) for i in range(60)]  # ties
    rows += [(900, None, 0), (950, [math.nan] * 8, 0), (951, [math.inf] + [0.0] * 7, 0), (952, [None] * 8, 0), (None, [0.1] * 8, 0), (1000, [], 0), (1001, [3.0], 0), (1050, [1e30] * 8, 0)]
    rows += [(1100, [-1e30] * 8, 0), (1150, [1e17] * 8, 0), (1151, [float(2**23)] * 8, 0)]
    d = tables(embeddings=rows)
    import struct

    whole = lambda x: math.floor(256 * struct.unpack("f", struct.pack("f", x))[0])
    vs = {i: [whole(x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in vs if i % 50 == 0):
        s = sorted((-min(max(sum(a * b for a, b in zip(vs[q], vs[c])), -(2**63)), 2**63 - 1), c) for c in vs if c != q)[:5]
        want |= {(q, r): (c, -x) for r, (x, c) in enumerate(s, 1)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op6_topk(spark, d).collect()}
    assert got == want
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vs.items()], "vec_id long, vector array<double>")
    small = topk.top_k(vectors, queries=F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=4)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in small.collect()} == want
    assert topk.op6_topk(spark, tables(embeddings=[])).collect() == []
    assert [tuple(r) for r in topk.op6_topk(spark, tables(embeddings=[(0, [1.0], 0), (1, [-1.0], 0)])).collect()] == [(0, 1, 1, -65536)]


def test_large_components_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, [float(2**31)] * 2), (1, [float(2**31), 1.0]), (2, [float(2**31), 0.0]), (3, [-1.0, -1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), queries=F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**62 + 2**31), (2, 2**62)]


def test_archives(spark, tables):
    rnd = random.Random(8)
    rows = [(i, f"http://x/{i}", f"<p>{'é🙂a' * rnd.randint(0, 6000)}</p>\r\n\r\n{i % 40}") for i in range(120)]
    rows += [(200 + i, None, "same") for i in range(30)] + [(300, "u\r\nx: y", None), (301, "u", ""), (None, "u", "alone"), (None, "u", "same"), (400, "u", "twice"), (400, "u", "twice")]
    rows.append((500, "u", "long " * 60000))
    d = tables(pages=rows)
    got = warc.op4_warc(spark, d).collect()
    newest = {}
    for p, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        raw, top = (h or "").encode(), newest[h or ""]
        back = top >= 0 and (p is None or p < top)
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if back else "response", top if back else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.op4_warc(spark, tables(pages=[])).collect() == []


def test_repeated_long_pages(spark, tables, tmp_path):
    long, other = "long é " * 4000, "other " * 4000
    rows = [(7, "u", long), (7, "u", long), (7, "v", long), (3, "u", long), (3, "u", long), (None, "u", long), (None, "u", other), (None, "u", other)]
    got = warc.op4_warc(spark, tables(pages=rows)).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = [(p, len(h.encode()), digest(h), "response" if p == 7 or h == other else "revisit", None if p == 7 or h == other else 7) for p, _, h in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    path = f"file://{tmp_path}/repeated"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    ids = [r.record_id for r in warc.read_records(spark, path).collect()]
    assert len(ids) == len(set(ids))


def test_revisits_of_a_repeated_long_page(spark, tables):
    """Many equal rows of one id, none of which are numbered in one place, and revisits that find their bytes."""
    rows = [(9, "u", "body " * 3000)] * 60 + [(i % 5, "u", "body " * 3000) for i in range(30)] + [(None, None, None)] * 50
    got = warc.op4_warc(spark, tables(pages=rows)).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == {(9, 15000, "response", None): 60, (None, 0, "response", None): 50} | {(i, 15000, "revisit", 9): 6 for i in range(5)}


def test_segments(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 5000), (2, "u", "x")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, segment_bytes=700, chunk_bytes=300, records_per_file=3)
    records = warc.read_records(spark, path)
    assert records.filter("segment > 1").count() > 10
    ok = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(ok[1].payload).decode() == "é" * 5000 and ok[1].complete and bytes(ok[2].payload) == b"x"
    cut = {r.page_id: r for r in warc.reassemble(records.filter("segment <> 4")).collect()}
    assert not cut[1].complete and cut[1].block is None and cut[2].complete
    short = {r.page_id: r for r in warc.reassemble(records.withColumn("total", records["total"] + 1)).collect()}
    assert not short[1].complete
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(warc.chunked(b"", 5)) == b""
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    data = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse_records(data * 2)] == [b"ab"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(data[:-2]))
