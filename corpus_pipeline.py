"""A corpus pipeline of five of the training-data operators. Each stage takes and returns documents; the last one emits the mix.

Edge cases, for every stage: null and empty texts pass as documents without words, and very long ones are read whole; repeated rows are kept or dropped together,
but by the second stage, which keeps one; rows without an id stay; an empty table gives an empty one; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbframe.llm import common, decontam, jaccard, mixing, secrets, toxicity


@common.configured
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.3 or more go. Without labels, or toxic ones among them, all stay."""
    model = toxicity.fit_toxicity(docs, toxicity.training_labels(common.table(spark, sf_dir, "labels")))
    score = common.unused(docs.columns, "_toxicity")
    return toxicity.score_toxicity(docs, model, score=score).filter(F.col(score) < 0.3).drop(score)


@common.configured
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: five-word shingles, Jaccard similarity of 0.8 or more.
    Documents without words, or without an id, are no duplicates; of rows of equal id one stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


@common.configured
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go. Without items all stay."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


@common.configured
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; all documents stay, and those without a secret as they are."""
    findings, redacted = (common.unused(docs.columns, c) for c in ("_findings", "_redacted"))
    found = secrets.scan_secrets(docs, secrets.train_forest(), path="source", findings=findings, redacted=redacted)
    hit = F.exists(findings, lambda f: f.secret)
    new = {"text": F.col(redacted), "n_chars": F.when(hit, F.length(redacted).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


@common.configured
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with mix_copy (from 1) and the mix_size, mix_target and mix_source_size that decided it; where documents
    have a column of such a name, the prefix gets more underscores. Documents of no words are taken at the rate of their source, too."""
    prefix = "mix_"
    while {f"{prefix}{n}" for n in mixing.ADDED} & set(docs.columns):
        prefix += "_"
    return mixing.emit(mixing.mix_sources(docs, prefix=prefix), prefix=prefix)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: The trained classifiers have no SQL; the test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written out and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
