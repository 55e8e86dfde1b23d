"""What the operators share: tables, the shared folder, global running totals."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import plumbframe

# Functions sent to executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(plumbframe)

#: A word: a run of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows for Python, where the session names none.
BATCH_BYTES = "8m"

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a local one, if master is local; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbframe-")
        _written[folder] = spark
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it is deleted by discard, clean or at the end of the program."""
    path = f"{shared_folder(spark)}/plumbframe/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._plumbframe_path = path
    return out


def remove(path: str) -> None:
    """Delete what was written to a path of fresh_path."""
    spark = _written.pop(path, None)
    with contextlib.suppress(Exception):  # a folder left behind costs space, not results
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return
    if path.startswith("file:/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of durable that nothing reads any more."""
    for t in tables:
        remove(t._plumbframe_path)


@atexit.register
def clean() -> None:
    """Delete all that was written into the shared folder and not discarded. Results that still read from it end here too."""
    for path in list(_written):
        remove(path)


def configure(spark: SparkSession) -> None:
    """Batches for Python are bounded in bytes, where the session doesn't set a bound: texts are long, and both sides hold a batch or more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def configured(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, or the stage, in a session that is configured. The operators themselves leave the session as it is."""

    @wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        configure(spark)
        return query(spark, *args)

    return run


def unused(columns: Sequence[str], name: str) -> str:
    """name, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words of a text as SPACED_WORD has them; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Add before_<c> for each c of totals: its exact sum over all rows that come earlier in the global order.

    Rows are range-partitioned and summed within each partition; only one row for each partition meets in a
    single task. The order must be total (no two equal rows).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written out, since two evaluations of a range partitioning need not cut at the same places.
    cut = durable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Broadcast: one row for each range partition, at most spark.sql.shuffle.partitions of them.
    out = cut.join(F.broadcast(offsets), "_part").withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_off_{c}") for c in totals})
    return out.drop("_part", *[f"_off_{c}" for c in totals])


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts: the first 52 bits of their MD5."""
    key = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def sampled_ids(rows: DataFrame, doc_id: str, n: int, seed: str) -> DataFrame:
    """The n distinct ids of smallest hash (fewer, if there are fewer), in a column _id: n rows at most, whatever the input.

    Rows far above the nth smallest hash are filtered out before anything is ordered, so no task sends much more than its share of n. Where
    repeated ids leave too few, the bound is raised.
    """
    ids = rows.select(F.col(doc_id).alias("_id")).filter(F.col("_id").isNotNull())
    ids = ids.withColumn("_u", hash_unit(F.lit(seed), F.col("_id")))
    below = (1.5 * n + 100) / max(ids.count(), 1)
    while True:
        found = durable(ids.filter(F.col("_u") <= min(1.0, below)).distinct().orderBy("_u", "_id").limit(n).select("_id"), "ids")
        if below >= 1 or found.count() == n:
            return found
        discard(found)
        below *= 8
