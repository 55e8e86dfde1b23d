"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

A node's bound is q.c + |q| r for its centre c and radius r. Of a tree, nodes whose bound is below a query's kth score are left out with all below
them, and the leaves left are opened in the order of their bound, as long as that is no less than the kth score so far. Shards are searched in
rounds of a sixteenth, three sixteenths and the rest: within a task the kth scores go from tree to tree, between rounds from all tasks to all.

Trees are planted where the rows lie, at most shard_rows each, and written once; no vector is shuffled. Queries come through the driver in blocks of a fixed size,
each of which is broadcast and searched for in numpy, a leaf at a time for all queries that need it. What a task gives back is k rows a query at most.

Scores are exact: whole numbers below 2**53 in floating point, else Python integers. Those beyond 64 bits count as the end of that range.

Edge cases: vectors that are null or hold a null, a NaN or an infinity take no part (op6_topk; top_k expects whole numbers); shorter vectors count as
filled up with 0; ties go to the smaller id; rows without an id take no part; equal ids stand for different rows, but a query never meets its own id, and
queries of equal id are ranked together; without queries or other rows the result is empty; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbframe.llm.common import discard, durable, fresh_path, table

LEAF = 128
BLOCK_BYTES = 8 << 20
LEAST, MOST = -(2**63), 2**63 - 1
ROUNDS = 3


@dataclass
class BallTree:
    """Rows of a node are points[lo:hi]; children of node i are first[i] and first[i] + 1 (0: a leaf)."""

    ids: np.ndarray
    points: np.ndarray
    largest: float
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        spans, centres, radii, first = [(0, len(ids))], [], [], []
        at = 0
        while at < len(spans):
            lo, hi = spans[at]
            x = points[order[lo:hi]]
            c = x.mean(axis=0)
            away = np.sqrt(((x - c) ** 2).sum(axis=1))
            centres.append(c)
            radii.append(away.max())
            if hi - lo <= leaf:
                first.append(0)
            else:
                # Along the line through the row furthest from the centre and the one furthest from that.
                a = x[away.argmax()]
                b = x[((x - a) ** 2).sum(axis=1).argmax()]
                order[lo:hi] = order[lo:hi][np.argsort(x @ (b - a), kind="stable")]
                mid = (lo + hi) // 2
                first.append(len(spans))
                spans += [(lo, mid), (mid, hi)]
            at += 1
        largest = float(np.abs(points).max(initial=0))
        kind = np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64
        spans_ = np.array(spans)
        return cls(ids[order], points[order].astype(kind), largest, spans_[:, 0], spans_[:, 1], np.array(centres), np.array(radii), np.array(first))


class Block:
    """Some queries and the k best that each has met so far; floor is the score below which nothing counts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.vectors, self.k, self.floor = ids, vectors, k, floor
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.largest = float(np.abs(vectors).max(initial=0))
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = floor.copy()

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, and never overflows
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        full = rank == self.k - 1
        self.kth[q[full]] = np.maximum(self.floor[q[full]], s[full])

    def search(self, tree: BallTree) -> None:
        """Offer the rows of a tree that can be among the k best."""
        width = tree.points.shape[1]
        q = np.zeros((len(self.ids), width))
        q[:, : self.vectors.shape[1]] = self.vectors[:, :width]
        exact = tree.largest * self.largest * width < 2**53
        slack = 1e-9 * (self.norm * float(np.abs(tree.centre).max(initial=0)) * math.sqrt(width + 1) + self.norm * float(tree.radius[0])) + 1e-6
        bound = lambda node, some: np.maximum(q[some] @ tree.centre[node] + self.norm[some] * tree.radius[node] + slack[some], float(LEAST))
        open_, found = [(0, np.arange(len(q)))], []
        while open_:
            node, some = open_.pop()
            at_most = bound(node, some)
            hold = at_most >= self.kth[some]
            some = some[hold]
            if not len(some):
                continue
            if child := int(tree.first[node]):
                open_ += [(child, some), (child + 1, some)]
            else:
                found.append((np.full(len(some), node), some, at_most[hold]))
        if not found:
            return
        leaf, query, at_most = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-at_most, query))
        leaf, query, at_most = leaf[order], query[order], at_most[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        begin, end = 0, 1
        while begin <= rank.max():
            # The best leaf of every query, then its second best, then the next two, four, ...
            now = np.flatnonzero((rank >= begin) & (rank < end) & (at_most >= self.kth[query]))
            now = now[np.argsort(leaf[now], kind="stable")]
            offers = [self._open(tree, int(leaf[part[0]]), q, query[part], exact) for part in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1) if len(part)]
            if offers:
                self.offer(*(np.concatenate(c) for c in zip(*offers, strict=True)))
            begin, end = end, 2 * end

    def _open(self, tree: BallTree, leaf: int, q: np.ndarray, some: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, points = tree.ids[tree.lo[leaf] : tree.hi[leaf]], tree.points[tree.lo[leaf] : tree.hi[leaf]]
        if exact:
            scores = (q[some] @ points.T.astype(np.float64)).astype(np.int64)
        else:
            whole = np.frompyfunc(int, 1, 1)
            scores = np.frompyfunc(lambda s: min(max(s, LEAST), MOST), 1, 1)(whole(q[some]) @ whole(points.T)).astype(np.int64)
        other = ids[None, :] != self.ids[some][:, None]
        least = self.kth[some]
        if len(ids) > self.k:
            # Only the k best of a leaf count, and what ties with the last of them.
            least = np.maximum(least, np.partition(np.where(other, scores, LEAST), -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(other & (scores >= least[:, None]))
        return some[row], scores[row, column], ids[column]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, filled up with 0 to the longest."""
    size = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.asarray(vectors.flatten(), float)
    return out


def _blocks(asked: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of blocks of at most that many queries and about BLOCK_BYTES; one partition is fetched at a time."""
    ids, vectors, size = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        return np.array(ids, np.int64), _matrix(pa.array(vectors, pa.list_(pa.float64())))

    for i, v in asked.toLocalIterator():
        ids.append(i)
        vectors.append(v)
        size = max(size, len(v))
        if len(ids) == rows or len(ids) * size * 8 >= BLOCK_BYTES:
            yield made()
            ids, vectors, size = [], [], 0
    if ids:
        yield made()


def top_k(vectors: DataFrame, *, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "vector", shard_rows: int = 16384, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that the condition queries picks, against all rows. vector: array of whole numbers as doubles."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asked")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, planted = [], 0

        def tree(n: int) -> pa.RecordBatch:
            nonlocal waiting, planted
            every = pa.Table.from_batches(waiting).combine_chunks()
            now, waiting = every.slice(0, n), every.slice(n).to_batches()
            part = TaskContext.get().partitionId()
            turn = 0 if part % 16 == 0 and not planted else 1 if part % 4 == 0 else 2
            planted += 1
            made = pickle.dumps(vars(BallTree.build(np.asarray(now.column("id")), _matrix(now.column("v").combine_chunks()))))
            return pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([made], pa.binary())], ["turn", "tree"])

        for b in batches:
            waiting.append(b)
            while sum(w.num_rows for w in waiting) >= shard_rows:
                yield tree(shard_rows)
        if left := sum(w.num_rows for w in waiting):
            yield tree(left)

    trees = durable(rows.select("id", "v").mapInArrow(plant, "turn int, tree binary"), "trees")
    asked = durable(rows.filter("asked").select("id", "v"), "queries")
    turns = sorted(r[0] for r in trees.select("turn").distinct().collect())  # ROUNDS at most
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    path, waves = fresh_path(spark, "found"), 0
    for ids, q in _blocks(asked, block_rows):
        # Broadcast: a block of block_rows queries or BLOCK_BYTES.
        sent = spark.sparkContext.broadcast((ids, q))
        floor = np.full(len(ids), LEAST, np.int64)
        here = f"{path}/wave={waves}"
        for turn in turns:

            def search(batches: Iterator[pa.RecordBatch], floor: np.ndarray = floor, sent=sent) -> Iterator[pa.RecordBatch]:
                block = Block(*sent.value, k, floor)
                for b in batches:
                    for t in b.column("tree"):
                        block.search(BallTree(**pickle.loads(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(block.query), pa.array(block.ids[block.query]), pa.array(block.id), pa.array(block.score)], ["query", "query_id", "vec_id", "score"])

            trees.filter(F.col("turn") == turn).select("tree").mapInArrow(search, "query long, query_id long, vec_id long, score long").write.mode("append").parquet(here)
            if turn != turns[-1]:
                kth = spark.read.parquet(here).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query", "score").collect()  # one row a query of the block
                floor = floor.copy()
                floor[[r[0] for r in kth]] = [r[1] for r in kth]
        sent.unpersist()
        waves += 1
    discard(trees, asked)
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path) if waves and turns else spark.createDataFrame([], "query_id long, vec_id long, score long")
    of_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of_id)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(x: Column) -> Column:
    """floor(256 * x) as double; from 2**53 on every double is whole, and Spark's floor would stop at 64 bits."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def op6_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))), F.lit(False))
    vectors = rows.filter(finite).select("vec_id", F.transform(x, whole).alias("vector"))
    return top_k(vectors, queries=F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
