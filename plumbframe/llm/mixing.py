"""Mixing sources to target weights.

Sizes are summed for each source, targets follow from weights under a repetition cap, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability, where
rate = target / source size. All of it is DataFrame code: the documents are only scanned, and what is shuffled is one
partial sum for each source and task.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a null id is replaced by the text
in the seed; equal ids share one decision, so repeated rows are all taken as often; a very long text is counted whole; an empty table gives an empty result.
Other columns of the input keep their place; one of the name of an added column is an error, as prefix can rename those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbframe.llm.common import durable, hash_unit, running_totals, table, unused, word_count

SEED = "plumbframe-mix-1"

#: Names of the added columns, after the prefix.
ADDED = ("size", "source_size", "target", "copies", "copy")


def source_targets(docs: DataFrame, *, size: Column, source: str = "source", weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources in code point order (null last) weigh weights[0], weights[1], ... in turn. Together they get budget times
    the total size, by weight; a target stops at max_repeats times its source's size, and what is left over goes to the
    others by weight until none is above. That fixed point is least(cap, level * weight): with the sources ordered
    by cap / weight, level is the largest of (budget - caps before) / (weights from here on).
    """
    per_source = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = running_totals(per_source.select("source", "source_size", F.col("source").isNull().alias("_null"), F.lit(1).cast("long").alias("one")), ["_null", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", "_null", weight.cast("long").alias("weight")).withColumns({"cap": F.col("source_size") * max_repeats})
    filled = running_totals(weighed.withColumn("_ratio", F.col("cap") / F.col("weight")), ["_ratio", "_null", "source"], ["cap", "weight"])
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_total"), F.sum("weight").alias("_weights"))
    level = filled.crossJoin(F.broadcast(whole)).agg(F.max((budget * F.col("_total") - F.col("before_cap")) / (F.col("_weights") - F.col("before_weight"))).alias("_level"))
    # level is one row; this is a scalar, not a product of tables.
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2, seed: str = SEED, prefix: str = "") -> DataFrame:
    """docs with <prefix>size, <prefix>source_size, <prefix>target and <prefix>copies (0 or more)."""
    clash = {f"{prefix}{n}" for n in ADDED} & set(docs.columns)
    if clash:
        raise ValueError(f"there are columns {', '.join(sorted(clash))} already; name another prefix")
    targets = source_targets(docs, size=word_count(F.col(text)), source=source, weights=weights, budget=budget, max_repeats=max_repeats)
    name, of_source, goal = (unused(docs.columns, c) for c in ("_mix_source", "_mix_size", "_mix_target"))
    targets = targets.select(F.col("source").alias(name), F.col("source_size").alias(of_source), F.col("target").alias(goal))
    # Written out, so that its size is known when the join is planned: below the broadcast threshold the sources are broadcast and the
    # texts stay where they are; beyond it both sides are shuffled and adaptive execution splits a hot source.
    targets = durable(targets, "targets")
    joined = docs.join(targets, F.col(source).eqNullSafe(F.col(name)), "left")
    rate = F.when(F.col(of_source) > 0, F.col(goal) / F.col(of_source)).otherwise(F.lit(0.0))
    coin = hash_unit(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.col(text)))
    copies = F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], word_count(F.col(text)).alias(f"{prefix}size"), F.col(of_source).alias(f"{prefix}source_size"), F.col(goal).alias(f"{prefix}target"), copies.cast("long").alias(f"{prefix}copies"))


def emit(mixed: DataFrame, *, prefix: str = "") -> DataFrame:
    """Each row of mix_sources as often as its copies say, numbered from 1 in <prefix>copy."""
    copies = F.col(f"{prefix}copies")
    return mixed.filter(copies > 0).withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('plumbframe-mix-1' || chr(31) || coalesce(doc_id::VARCHAR, text, chr(30))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight FROM s),
r AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight::DOUBLE AS ratio FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER q, 0)::DOUBLE AS before_cap, coalesce(sum(weight) OVER q, 0)::DOUBLE AS before_weight FROM r
      WINDOW q AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - before_cap) / ((SELECT sum(weight) FROM w)::DOUBLE - before_weight)) AS level FROM b),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM v) * weight) AS target FROM r)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (CASE WHEN t.source_size > 0 THEN floor(target / source_size) + (CASE WHEN coin < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
