"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where unset, one machine (a local master, as in tests) gets
    a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/daftar-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise wrote and nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._written_to)


def release(spark: SparkSession) -> None:
    """Remove every table that materialise wrote in this application, once its results are saved."""
    _remove(spark, f"{shared_dir(spark).rstrip('/')}/daftar-{spark.sparkContext.applicationId}")


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those that an operator adds."""
    return docs.select(*(docs[n] for n in names))


def fold(key: str, modulus: int):
    """The fixed fold of a row: crc32 of the key as text, modulo."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, the first by a hash of the keys. From a larger table a bound on the hash first leaves little more than n, so
    tasks hand on about n rows in all, not n each."""
    total, order = df.count(), F.xxhash64(*keys)
    if total > n:
        df = df.where(F.pmod(order, F.lit(1 << 40)) < int((n + 8 * n**0.5 + 8) / total * (1 << 40)))
    return df.orderBy(F.pmod(order, F.lit(1 << 40)), *keys).limit(n)


def running(df: DataFrame, group: list[str], order: list, value: str | None = None) -> DataFrame:
    """df, written in the order of group and `order`, plus `before`: the sum of `value` (long; else the number) of the rows of the
    same group that come earlier. Rows that tie in `order` follow as they lie.

    group: long columns without nulls. Rows are range-partitioned and sorted by group and order, so a group of any size lies in many
    tasks; each sums along its own rows, and only what a partition's first group has in earlier partitions (a row a partition) is added.
    """

    def along(it):
        last, total, first = None, 0, True
        part = TaskContext.get().partitionId()
        for b in it:
            if not b.num_rows:
                continue
            keys = [b.column(g).to_numpy() for g in group]
            v = b.column(value).to_numpy() if value else np.ones(b.num_rows, np.int64)
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = last is not None and last != tuple(int(k[0]) for k in keys)
            sums = np.cumsum(v) - v
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
            before = np.where(start < 0, sums + total, sums - sums[start])
            lead = (start < 0) & first
            first = first and bool(lead[-1])
            last, total = tuple(int(k[-1]) for k in keys), int(before[-1] + v[-1])
            extra = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(lead), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "_part", "_lead", "before"])

    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_lead", T.BooleanType()), T.StructField("before", T.LongType())])
    by = [*group, *order]
    rows = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(along, schema))
    leads = rows.where("_lead").select(*group).distinct()  # at most one a partition
    summed = rows.join(F.broadcast(leads), group).groupBy(*group, "_part").agg(F.sum(value or F.lit(1)).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = summed.select("_part", *(F.col(g).alias(f"_{g}") for g in group), F.sum("_sum").over(earlier).alias("_start")).where("_start > 0")
    same = [F.col(g) == F.col(f"_{g}") for g in group]
    met = rows.join(F.broadcast(starts.withColumnRenamed("_part", "_p")), [F.col("_part") == F.col("_p"), *same], "left")
    return met.withColumn("before", F.col("before") + F.coalesce("_start", F.lit(0))).select(*df.columns, "before")
