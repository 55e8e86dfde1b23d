"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained with numpy from confirmed toxic texts (P) and unlabelled ones (U). With the class
prior p, the risk of calling unlabelled text clean is corrected for the toxic texts in it:

    p * mean_P loss(+) + max(0, mean_U loss(-) - p * mean_P loss(-))

Where the second part falls below 0 the classifier has begun to fit single texts; the step then goes the other way.
The training rows are a bounded sample (max_positive and max_unlabelled, by smallest hash of the id); their words are hashed on the
executors, and only bucket numbers reach the driver. Scores cover every row and whole texts.

Edge cases: null and empty texts get the score of no words; a very long text is scored whole, with its distinct words; labels without text are ignored; without any positive
example every score is the prior; repeated rows are scored each; an empty table gives an empty result; other columns pass, but one of the name
of the score is an error: name another.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbframe.llm import hashing
from plumbframe.llm.common import sampled_ids, table, unused

BUCKETS = 1 << 17
SEED = "plumbframe-pu-1"

#: Bytes of a word's beginning that are inputs too, so that unseen words of a known stem count.
PREFIXES = (4, 5, 6)


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float

    def scores(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        z = np.bincount(row, weights=self.weights[bucket], minlength=rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def hashed_rows(batch: pa.RecordBatch, text: str, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket) of each chunk of a batch: its words, and the beginnings of its words."""
    for at, data, offsets in hashing.chunks(batch.column(text)):
        h, _, _, row, begin, begin_row = hashing.words(data, offsets, prefixes=PREFIXES)
        yield at, len(offsets) - 1, *hashing.distinct_buckets(np.concatenate((h, begin)), np.concatenate((row, begin_row)), buckets)


def buckets_of(rows: DataFrame, ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[np.ndarray]:
    """The distinct buckets of each row whose id is among ids, a bounded sample; the texts stay on the executors."""
    # Broadcast: sampled_ids bounds the ids.
    some = rows.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull() & (F.col("_text") != "")).join(F.broadcast(ids), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for _, rows_here, row, bucket in hashed_rows(b, "_text", buckets):
                cut = np.searchsorted(row, np.arange(rows_here + 1))
                # Differences of ascending numbers are small, so they come to a quarter on their way to the driver.
                out += [zlib.compress(np.diff(bucket[cut[i] : cut[i + 1]], prepend=0).astype(np.uint32).tobytes(), 1) for i in range(rows_here)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.binary())], ["_id", "buckets"])

    got = some.mapInArrow(run, f"_id {some.schema['_id'].dataType.simpleString()}, buckets binary").dropDuplicates(["_id"]).orderBy("_id").collect()
    return [np.cumsum(np.frombuffer(zlib.decompress(r[1]), np.uint32), dtype=np.uint32) for r in got]


def _sums(values: np.ndarray, at: np.ndarray, begin: np.ndarray, together: int = 1 << 20) -> np.ndarray:
    """Of each run of at, from begin[i] to begin[i + 1], the sum of the values there; runs are gathered a part at a time."""
    out, i, runs = np.empty(len(begin) - 1), 0, len(begin) - 1
    while i < runs:
        j = min(max(i + 1, int(np.searchsorted(begin, begin[i] + together, "right")) - 1), runs)
        out[i:j] = np.add.reduceat(values[at[begin[i] : begin[j]]], begin[i:j] - begin[i])
        i = j
    return out


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, buckets: int = BUCKETS, steps: int = 300, rate: float = 0.05, l1: float = 0.01) -> LinearModel:
    """Adam with a proximal L1 step on the non-negative risk with the logistic loss. The penalty of a bucket is l1 over the root of the number of positive texts times
    the number that hold it: the fewer tell of a word, the more it must tell. Only buckets of positive texts have weights: no other can speak for a text being one."""
    prior = float(min(max(prior, 1e-4), 0.9))
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return LinearModel(np.zeros(buckets), bias)
    known = np.unique(np.concatenate(positive))
    d, n_p, n_u = len(known), len(positive), len(unlabelled)
    place = np.full(buckets, -1, np.int32)
    place[known] = np.arange(d)
    # Each row and each column ends in one more entry, the bias, so none is empty: sums over rows and columns are sums of runs. What is as long as all
    # texts together decides the driver's memory: two arrays of 4 bytes a number, filled and sorted where they stand.
    sizes = np.array([np.count_nonzero(place[t] >= 0) + 1 for t in itertools.chain(positive, unlabelled)])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    column = np.full(begin[-1], d, np.int32)
    for i, t in enumerate(itertools.chain(positive, unlabelled)):
        p = place[t]
        column[begin[i] : begin[i + 1] - 1] = p[p >= 0]
    del positive, unlabelled
    n = n_p + n_u
    by_column = column.astype(np.uint32 if (d + 1) * n < 2**32 else np.uint64)
    by_column *= by_column.dtype.type(n)
    for i in range(n):
        by_column[begin[i] : begin[i + 1]] += by_column.dtype.type(i)
    by_column.sort()
    by_column %= by_column.dtype.type(n)
    held = sum(np.bincount(column[i : i + (1 << 20)], minlength=d + 1) for i in range(0, len(column), 1 << 20))
    column_begin = np.concatenate(([0], np.cumsum(held)))
    penalty = l1 / np.sqrt(n_p * np.bincount(column[: begin[n_p]], minlength=d + 1)[:d])
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = bias
    for t in range(1, steps + 1):
        z = _sums(w, column, begin)
        z_p, z_u = z[:n_p], z[n_p:]
        up, down, u = nnpu_slopes(z_p, z_u, prior)
        g = _sums(np.concatenate((up + down, u)), by_column, column_begin)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - scale * (m / (1 - 0.9**t))
        w[:d] = np.sign(w[:d]) * np.maximum(np.abs(w[:d]) - np.minimum(scale[:d] * penalty, rate), 0)
    weights = np.zeros(buckets)
    weights[known] = w[:d]
    return LinearModel(weights, float(w[d]))


def nnpu_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of positive texts called clean, and of unlabelled ones called toxic, less the share of positive ones in them."""
    soft = lambda z: np.logaddexp(0, z)
    return prior * float(soft(-z_p).mean()), float(soft(z_u).mean() - prior * soft(z_p).mean())


def nnpu_slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How the step's risk changes with each output: of positive texts by the first part and by the second, of unlabelled ones. Where the second
    part is negative the step goes up on it, and on it alone."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    up, down, u = -prior * sigmoid(-z_p) / len(z_p), -prior * sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
    return (up, down, u) if nnpu_risk(z_p, z_u, prior)[1] >= 0 else (np.zeros(len(z_p)), -down, -u)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 12000, prior: float | None = None) -> LinearModel:
    """Train from the labels given (leave held-out rows out of them). prior: the toxic share; None: that of the labels."""
    known = labels.select(F.col(doc_id).alias("_label_id"), F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & F.col("_label_id").isNotNull())
    if prior is None:
        n, ones = known.agg(F.count(F.lit(1)), F.sum((F.col("_label") == 1).cast("long"))).first()
        prior = (ones or 0) / n if n else 0.0
    confirmed = known.filter(F.col("_label") == 1).select("_label_id").distinct()
    of = lambda ids: buckets_of(docs, ids, doc_id=doc_id, text=text)
    # Unlabelled: any text, whatever its label; the correction by the prior is for just that.
    samples = [of(sampled_ids(confirmed, "_label_id", max_positive, SEED)), of(sampled_ids(docs, doc_id, max_unlabelled, SEED + "u"))]
    # Training is Python's alone: what the driver's JVM holds of the collected rows is free, and so are the lists once they are laid out.
    docs.sparkSession.sparkContext._jvm.System.gc()
    return train_nnpu(samples.pop(0), samples.pop(), prior)


def score_toxicity(docs: DataFrame, model: LinearModel, *, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default all) and the score of each row."""
    keep = docs.columns if keep is None else keep
    if score in keep:
        raise ValueError(f"there is a column {score} already; name another for the score")
    read = text if text in keep else unused(keep, "_tox_text")
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(text).alias(read)]))
    # 1 MB, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LinearModel(**sent.value)
        for b in batches:
            out = [m.scores(row, bucket, rows) for _, rows, row, bucket in hashed_rows(b, read)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*keep, score])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score, "double")
    return inputs.mapInArrow(run, schema)


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id"), 4, 2))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
