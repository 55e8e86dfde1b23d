"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item of m words has a SimHash fingerprint of its word shingles. Of the documents, windows of m words are fingerprinted
the same way where they can matter: a window that shares no shingle with any item has similarity 0, so windows are laid
where a shingle of some item stands, aligned as in the item.

The index is kept in two levels. A window that is similar enough to an item holds at least one of the item's rarest shingles (of n, the n - ceil(percent % of n) + 1
that fewest items hold), so windows and items only meet in the bucket of such a shingle. Within it fingerprints meet by Hamming blocks: cut into radius + 1 blocks,
any two within the radius agree in one at least. With a radius as wide as a similarity of 0.8 asks for, blocks of 2 or 3 bits alone would let nearly all pairs
through; the buckets bound the candidates. Items of fewer than direct shingles, whose fingerprints scatter most, are compared without fingerprints.
Candidates are then compared exactly: the shingles of both with their numbers of occurrence, as sum of minima over sum of maxima.

All of it is DataFrame code. The shingles of the benchmark are broadcast in blocks of at most block_shingles (a count is taken first), so what is
broadcast has a fixed size; more shingles mean more passes. Documents are never shuffled but for those that hold a rare shingle of an item.

Edge cases: null and empty texts or items match nothing; an item of fewer words than a shingle has its whole sequence as its only shingle; a document
shorter than an item is one window; a very long text gives its windows, each a row of its own; rows of equal id and text have the same result, and are told
from others by 128 bits of hash; ties go to the smaller item, then the earlier window; without items or documents the result is empty, or nothing is
dropped; other columns pass, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbframe.llm.common import discard, durable, table
from plumbframe.llm.licenses import GAP, let

BITS = 64


def word_array(text: Column) -> Column:
    """Lower-case words: letters and digits of ASCII, and all that isn't ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def shingle_hashes(words: Column, k: Column | int) -> Column:
    """Hashes of all runs of k words (k of 1 to 5 is a column or a number), in order."""
    k = F.lit(k) if isinstance(k, int) else k
    runs = F.transform(words, lambda w, i: F.xxhash64(k, w, *[F.when(k > j, F.get(words, i + j)) for j in range(1, 5)]))
    return F.slice(runs, 1, F.greatest(F.size(words) - k + 1, F.lit(0)))


def fixed_hashes(words: Column, k: int) -> Column:
    """shingle_hashes for a known k, with less work for a word."""
    runs = F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(runs, 1, F.greatest(F.size(words) - k + 1, F.lit(0)))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over the hashes, repeats counted."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    ones = F.transform(bits, lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b).cast("int")))
    half = F.size(hashes) / 2
    return F.aggregate(F.transform(ones, lambda n, b: F.when(n > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def occurrences(hashes: Column) -> Column:
    """Each hash together with how many times it came before: sets of these are the multisets of the hashes. One sort, else linear."""

    def of_runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        begins = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        lengths = let(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda i, j: F.struct(F.get(s, i).alias("h"), (j - i).alias("n"))))
        return F.flatten(F.transform(lengths, lambda r: F.transform(F.sequence(F.lit(1), r.n), lambda k: F.xxhash64(r.h, k))))

    return F.when(F.size(hashes) > 0, let(F.array_sort(hashes), of_runs)).otherwise(F.array().cast("array<bigint>"))


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """radius + 1 structs (block, bits) that make up the fingerprint."""
    n = radius + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell a row by its id and text."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("plumbframe"), text, doc_id).alias("b"))


def _rarest(items: DataFrame, percent: int) -> DataFrame:
    """m, h, item, ifp, n: the rarest shingles of each item, one of which every window holds that is similar enough to it."""
    held = items.select("item", "m", "n", "fp", F.explode("sh").alias("h"))
    holders = held.groupBy("h").agg(F.countDistinct("item").alias("holders"))
    # Of a shingle that an item has several times, each occurrence counts as one.
    ranked = held.join(holders, "h").groupBy("item", "m", "n", "fp").agg(F.array_sort(F.collect_list(F.struct("holders", "h"))).alias("order"))
    enough = F.col("n") - F.ceil(F.col("n") * percent / 100.0).cast("int") + 1
    return ranked.select("item", "m", "n", F.col("fp").alias("ifp"), F.explode(F.array_distinct(F.transform(F.slice("order", 1, enough), lambda x: x.h))).alias("h"))


def candidates(windows: DataFrame, rare: DataFrame, *, radius: int, direct: int) -> DataFrame:
    """key, start, m, item of the windows and items that meet in the bucket of a rare shingle, and there by a Hamming block and the radius."""
    seen = windows.select("key", "start", "m", "fp", F.explode(F.array_distinct("sh")).alias("h"))
    agree = F.arrays_overlap(blocks_of(F.col("fp"), radius), blocks_of(F.col("ifp"), radius))
    near = agree & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    return seen.join(rare, ["m", "h"]).filter((F.col("n") < direct) | near).select("key", "start", "m", "item").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 80, radius: int = 24, direct: int = 12, block_shingles: int = 500_000) -> DataFrame:
    """The leaks: key (row_key of the document), item_id, start (in words, from 0), similarity; one row for each document and item, the best."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), word_array(F.col(item_text)).alias("w")).withColumn("m", F.size("w")).filter("m > 0").withColumn("k", F.least("m", F.lit(words)))
    items = items.withColumn("sh", shingle_hashes(F.col("w"), F.col("k"))).withColumn("item", F.monotonically_increasing_id())
    items = durable(items.select("item", "item_id", "m", "k", "sh", F.size("sh").alias("n"), simhash(F.col("sh")).alias("fp"), occurrences(F.col("sh")).alias("items")), "items")
    rare = durable(_rarest(items, percent), "rare")
    # Equal places of equal shingles in items of equal length are one row.
    anchors = items.select("m", "k", F.posexplode("sh").alias("at", "h")).distinct()
    anchors = durable(anchors.join(rare.select("m", "h", F.lit(True).alias("rare")).distinct(), ["m", "h"], "left").select("m", "k", "at", "h", F.coalesce("rare", F.lit(False)).alias("rare")), "anchors")
    n, sizes = anchors.count(), sorted(r[0] for r in anchors.select("k").distinct().collect())  # at most five numbers
    key = row_key(F.col(doc_id), F.col(text))
    if not n:
        return spark.createDataFrame([], T.StructType().add("key", docs.select(key.alias("key")).schema["key"].dataType).add("item_id", items.schema["item_id"].dataType).add("start", "integer").add("similarity", "double"))
    passes = math.ceil(n / block_shingles)
    # All lengths of shingles in one reading of the documents.
    runs = F.concat(*[F.transform(fixed_hashes(F.col("w"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in sizes])
    runs = docs.select(key.alias("key"), word_array(F.col(text)).alias("w")).select("key", F.size("w").alias("words"), F.explode(runs).alias("r")).select("key", "words", "r.pos", "r.h")
    if sizes == [words]:
        runs = docs.select(key.alias("key"), word_array(F.col(text)).alias("w")).select("key", F.size("w").alias("words"), F.posexplode(fixed_hashes(F.col("w"), words)).alias("pos", "h"))
    found = []
    for p in range(passes):
        some = anchors if passes == 1 else anchors.filter(F.pmod(F.xxhash64("h"), F.lit(passes)) == p)
        # Broadcast: about block_shingles rows.
        hits = runs.join(F.broadcast(some.select("h", "at", "m", "rare")), "h")
        found.append(hits.select("key", "m", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("words") - F.col("m"))).alias("start"), "rare"))
    laid = found[0]
    for f in found[1:]:
        laid = laid.unionByName(f)
    # A length is of use in a document only where a rare shingle of some item of it stands.
    laid = laid.groupBy("key", "m").agg(F.collect_set("start").alias("starts"), F.max("rare").alias("rare")).filter("rare")
    laid = durable(laid.groupBy("key").agg(F.collect_list(F.struct("m", "starts")).alias("laid")), "windows")
    texts = docs.select(key.alias("key"), F.col(text).alias("t")).join(laid, "key").dropDuplicates(["key"])
    # Windows are cut out before they become rows, so no row carries all the words of a long text.
    cut = F.flatten(F.transform("laid", lambda x: F.transform(x.starts, lambda s: F.struct(s.alias("start"), x.m.alias("m"), F.slice("w", s + 1, x.m).alias("w")))))
    windows = texts.select("key", word_array(F.col("t")).alias("w"), "laid").select("key", F.explode(cut).alias("x")).select("key", "x.*")
    windows = windows.withColumn("sh", shingle_hashes(F.col("w"), F.least("m", F.lit(words)))).filter(F.size("sh") > 0)
    windows = durable(windows.select("key", "start", "m", "sh", simhash(F.col("sh")).alias("fp"), occurrences(F.col("sh")).alias("seen")), "fingerprints")
    pairs = candidates(windows, rare, radius=radius, direct=direct).join(items.select("item", "item_id", "items"), "item").join(windows.select("key", "start", "m", "seen"), ["key", "start", "m"])
    shared, both = F.size(F.array_intersect("seen", "items")), F.size(F.array_union("seen", "items"))
    good = pairs.select("key", "item_id", "start", shared.alias("shared"), both.alias("both")).filter(100 * F.col("shared") >= percent * F.col("both"))
    good = good.withColumn("similarity", F.col("shared") / F.col("both"))
    best = good.groupBy("key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("b"))
    out = durable(best.select("key", "item_id", F.col("b.start").alias("start"), (-F.col("b.s")).alias("similarity")), "leaks")
    discard(items, rare, anchors, laid, windows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without a leak."""
    leaks = durable(find_leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select("key").distinct(), "leaks")
    return docs.join(leaks, row_key(docs[doc_id], docs[text]) == leaks["key"], "left_anti")


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, and the best item with its similarity and the window's start (null without)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    per_doc = leaks.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct((-F.col("similarity")).alias("s"), "item_id", "start")).alias("b"))
    per_doc = durable(per_doc.select("key", "n_items", F.col("b.item_id").alias("item_id"), (-F.col("b.s")).alias("similarity"), F.col("b.start").cast("long").alias("first_word")), "leaks")
    joined = docs.join(per_doc, row_key(docs["doc_id"], docs["text"]) == per_doc["key"], "left")
    return joined.select("doc_id", F.col("key").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "similarity", "first_word")


#: All windows of a document and item that share any shingle, without fingerprints, buckets or aligned places.
ORACLE = r"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
it AS (SELECT *, len(w) AS m, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT item, item_id, m, k, list_transform(range(1, m - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')) AS sh FROM it),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM it),
dsh AS (SELECT r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS x FROM d, ks),
ix AS (SELECT item, k, unnest(sh) AS x FROM ish),
hit AS (SELECT DISTINCT dsh.r, ix.item FROM dsh JOIN ix ON dsh.k = ix.k AND dsh.x = ix.x),
win AS (SELECT h.r, h.item, item_id, m, k, unnest(range(0, greatest(1, len(d.w) - m + 1))) AS start FROM hit h JOIN ish USING (item) JOIN d USING (r)),
wsh AS (SELECT win.*, unnest(list_transform(range(1, least(m, len(d.w) - start) - k + 2), lambda p: array_to_string(d.w[start + p:start + p + k - 1], ' '))) AS x FROM win JOIN d USING (r)),
wc AS (SELECT r, item, item_id, start, x, count(*) AS n FROM wsh GROUP BY ALL),
ic AS (SELECT item, x, count(*) AS n FROM ix GROUP BY ALL),
sums AS (SELECT r, item, item_id, start, sum(n) AS size FROM wc GROUP BY ALL),
overlap AS (SELECT wc.r, wc.item, wc.start, sum(least(wc.n, ic.n)) AS shared FROM wc JOIN ic USING (item, x) GROUP BY ALL),
sim AS (SELECT s.r, s.item_id, s.start, b.shared::DOUBLE / (s.size + len(ish.sh) - b.shared) AS similarity FROM sums s JOIN overlap b USING (r, item, start) JOIN ish USING (item)
        WHERE 100 * b.shared >= 80 * (s.size + len(ish.sh) - b.shared)),
best AS (SELECT r, item_id, min(struct_pack(s := -similarity, start := start)) AS b FROM sim GROUP BY r, item_id),
per AS (SELECT r, count(*)::BIGINT AS n_items, min(struct_pack(s := b.s, item_id := item_id, start := b.start)) AS b FROM best GROUP BY r)
SELECT d.doc_id, p.r IS NOT NULL AS contaminated, coalesce(p.n_items, 0)::BIGINT AS n_items, p.b.item_id AS item_id, -p.b.s AS similarity, p.b.start::BIGINT AS first_word
FROM d LEFT JOIN per p USING (r)
"""
