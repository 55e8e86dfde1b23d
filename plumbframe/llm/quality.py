"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): low-rank weights for every pair of inputs, in time
linear in the inputs that a text has. Inputs are the distinct words of the text (hashed, of length 1 together), its statistics
cut into ranges, and the ranges of the metadata columns given. Ranges are quantiles of the training rows.

Training rows are a bounded sample of the labelled ones (max_rows, by smallest hash of the id, as many of the rarer label as
half); their inputs are computed on the executors and collected. Scores cover every row and whole texts.

Edge cases: null and empty texts are scored from their statistics (all 0); a very long text is scored whole; null metadata has a range of its own; labels without text
are ignored; with one label only, or none, every score is the share of label 1 (0.5 without labels); repeated rows
are scored each; an empty table gives an empty result; other columns pass, but one of the name of the score is an error: name another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbframe.llm import hashing
from plumbframe.llm.common import sampled_ids, table, unused
from plumbframe.llm.toxicity import held_out

WORD_BUCKETS = 1 << 14
RANGES = 8
SEED = "plumbframe-fm-1"

# The statistics of a text, in order.
STATS = ["log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "spaces", "distinct", "repeats", "lines", "short_lines", "stops", "bars"]


def statistics(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each of STATS."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per_byte = np.repeat(np.arange(rows), np.diff(offsets))
    of = lambda mask: np.bincount(per_byte[mask], minlength=rows).astype(float)
    some, n_words = np.maximum(size, 1), np.bincount(row, minlength=rows).astype(float)
    some_words = np.maximum(n_words, 1)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    line = data == 10
    length = (end - start).astype(float)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=rows)
    lines = of(line) + 1
    return np.stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            np.bincount(row, weights=length, minlength=rows) / some_words,
            np.bincount(row, weights=length > 12, minlength=rows) / some_words,
            of(upper) / np.maximum(of(letter), 1),
            of(digit) / some,
            of(~(letter | digit | space)) / some,
            of(space) / some,
            distinct / some_words,
            np.bincount(row, weights=same, minlength=rows) / some_words,
            lines / some_words,
            size / lines / 100,
            of(data == 46) / some_words,
            of(data == 124) / some,
        ],
        axis=1,
    )


@dataclass
class FactorisationMachine:
    cuts: np.ndarray  # inner bounds of the ranges, a row for each statistic and metadata column
    w0: float
    w: np.ndarray
    v: np.ndarray
    meta: tuple[str, ...] = field(default=())

    def inputs(self, numbers: np.ndarray) -> np.ndarray:
        """Positions of the ranges; a missing number has the last one."""
        n, k = numbers.shape
        out = np.empty((n, k), np.int64)
        for j in range(k):
            out[:, j] = np.where(np.isnan(numbers[:, j]), RANGES, np.searchsorted(self.cuts[j], numbers[:, j], "right"))
        return WORD_BUCKETS + np.arange(k) * (RANGES + 1) + out

    def scores(self, numbers: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        i, x, r = with_ranges(self.inputs(numbers), row, bucket)
        return 1 / (1 + np.exp(-np.clip(machine(self.w0, self.w, self.v, i, x, r, len(numbers))[0], -40, 40)))


def with_ranges(ranges: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input, value, row): words have length 1 together, ranges count 1 each."""
    rows, k = ranges.shape
    share = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
    return np.concatenate((bucket, ranges.ravel())), np.concatenate((share[row], np.ones(rows * k))), np.concatenate((row, np.repeat(np.arange(rows), k)))


def machine(w0: float, w: np.ndarray, v: np.ndarray, i: np.ndarray, x: np.ndarray, r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The output of each row before the sigmoid, and the sums over its inputs of v * x."""
    linear = np.bincount(r, weights=w[i] * x, minlength=rows)
    s = np.stack([np.bincount(r, weights=v[i, f] * x, minlength=rows) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(r, weights=(v[i] ** 2).sum(axis=1) * x * x, minlength=rows)
    return w0 + linear + 0.5 * ((s * s).sum(axis=1) - squares), s


def train_machine(numbers: np.ndarray, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, *, factors: int = 6, steps: int = 1000, batch: int = 64, rate: float = 0.03, l2: float = 1e-4, meta: tuple[str, ...] = (), seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss: as many steps for any number of rows, each over a batch of them, in fixed random orders one after the other."""
    rng = np.random.default_rng(seed)
    filled = [np.sort(c[~np.isnan(c)]) for c in numbers.T]
    cuts = np.stack([np.quantile(c, np.arange(1, RANGES) / RANGES) if len(c) else np.zeros(RANGES - 1) for c in filled])
    d = WORD_BUCKETS + numbers.shape[1] * (RANGES + 1)
    share = float(np.average(label, weights=weight)) if len(label) else 0.5
    fm = FactorisationMachine(cuts, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(d), rng.normal(0, 0.01, (d, factors)), meta)
    if len(label) == 0 or share in (0.0, 1.0):
        fm.v[:] = 0
        return fm
    ranges = fm.inputs(numbers)
    g_w, g_v = np.full(d, 1e-6), np.full((d, factors), 1e-6)
    done = 0
    while done < steps:
        for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch))[: steps - done]:
            done += 1
            row = np.repeat(np.arange(len(part)), [len(texts[j]) for j in part])
            i, x, r = with_ranges(ranges[part], row, np.concatenate([texts[j] for j in part]) if len(row) else np.zeros(0, np.int64))
            z, s = machine(fm.w0, fm.w, fm.v, i, x, r, len(part))
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[part]) * weight[part] / weight[part].sum()
            used, where = np.unique(i, return_inverse=True)
            gw = np.bincount(where, weights=e[r] * x) + l2 * fm.w[used]
            gv = np.stack([np.bincount(where, weights=e[r] * x * (s[r, f] - fm.v[i, f] * x)) for f in range(factors)], axis=1) + l2 * fm.v[used]
            g_w[used] += gw * gw
            g_v[used] += gv * gv
            fm.w[used] -= rate * 3 * gw / np.sqrt(g_w[used])
            fm.v[used] -= rate * gv / np.sqrt(g_v[used])
            fm.w0 -= rate * e.sum()
    return fm


def _inputs(b: pa.RecordBatch, text: str, meta: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, row, bucket) of each chunk of a batch."""
    extra = [np.asarray(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in meta]
    for at, data, offsets in hashing.chunks(b.column(text)):
        h, start, end, row = hashing.words(data, offsets)
        rows = len(offsets) - 1
        numbers = np.column_stack([statistics(data, offsets, h, start, end, row), *[e[at : at + rows] for e in extra]])
        yield numbers, *hashing.distinct_buckets(h, row, WORD_BUCKETS)


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", meta: tuple[str, ...] = (), max_rows: int = 8000) -> FactorisationMachine:
    """Train from the labels given (leave held-out rows out of them)."""
    known = labels.select(F.col(doc_id).alias("_label_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1)).dropDuplicates(["_label_id"])
    counts = dict(known.groupBy("_label").count().collect())  # two rows
    ids = [sampled_ids(known.filter(F.col("_label") == y), "_label_id", max_rows // 2, SEED) for y in (0, 1)]
    chosen = ids[0].withColumn("_label", F.lit(0)).unionByName(ids[1].withColumn("_label", F.lit(1)))
    # Broadcast: sampled_ids bounds the ids.
    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_meta{i}") for i, c in enumerate(meta)]).filter(F.col("_text").isNotNull()).join(F.broadcast(chosen), "_id")
    names = tuple(f"_meta{i}" for i in range(len(meta)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, buckets = [], []
            for n, row, bucket in _inputs(b, "_text", names):
                cut = np.searchsorted(row, np.arange(len(n) + 1))
                numbers += [x.tobytes() for x in n]
                buckets += [bucket[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(numbers, pa.binary()), pa.array(buckets, pa.binary())], ["_id", "label", "numbers", "buckets"])

    got = some.mapInArrow(run, f"_id {some.schema['_id'].dataType.simpleString()}, label int, numbers binary, buckets binary").dropDuplicates(["_id"]).orderBy("_id").drop("_id").collect()  # max_rows at most
    k = len(STATS) + len(meta)
    label_of = np.array([r[0] for r in got], float)
    numbers = np.array([np.frombuffer(r[1], float) for r in got]).reshape(len(got), k)
    texts = [np.frombuffer(r[2], np.uint32).astype(np.int64) for r in got]
    # Each label counts as in all labels, however many of its rows were taken.
    taken = np.bincount(label_of.astype(int), minlength=2)
    weight = np.array([counts.get(int(y), 0) / max(taken[int(y)], 1) for y in label_of])
    return train_machine(numbers, texts, label_of, weight, meta=meta)


def score_quality(docs: DataFrame, fm: FactorisationMachine, *, text: str = "text", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default all) and the score of each row."""
    keep = docs.columns if keep is None else keep
    if score in keep:
        raise ValueError(f"there is a column {score} already; name another for the score")
    names, read = [unused(keep, f"_fm_meta{i}") for i in range(len(fm.meta))], unused(keep, "_fm_text")
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(read), *[F.col(c).alias(n) for c, n in zip(fm.meta, names, strict=True)])
    # 1 MB, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(vars(fm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(**sent.value)
        for b in batches:
            out = [m.scores(*x) for x in _inputs(b, read, tuple(names))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*keep, score])

    return inputs.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(score, "double"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    fm = fit_quality(docs, labels, meta=("n_chars",))
    scored = score_quality(docs, fm, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
