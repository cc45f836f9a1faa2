"""Operator 8: proportional stratified interleaving into shards.

The seeded shuffle of a source ranks rows by a cell of the text's digest first, then by the row's own digest. A text's copies, in
whatever source, so have about the same fractional rank and come to one shard, unless a cut runs through their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import doc_columns, materialise


def _unit(digest: Column) -> Column:
    """A hexadecimal digest as a number from 0 to below 1 (52 bits)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Cells of the text digest: three hexadecimal digits of it.
CELLS = 4_096


def _numbered(df: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str) -> DataFrame:
    """A running number from 0 (`name`) by group along bucket and order: each (group, bucket) is sorted alone, and starts at the count of
    the group's rows in earlier buckets. So a group of any size is sorted by many tasks, and no row order depends on where rows lie."""
    counts = df.groupBy(*group, *bucket).agg(F.count("*").alias("_n"))
    # one row for each (group, bucket): a group's rows divide by the bucket size
    earlier = W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, *bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    inside = W.partitionBy(*group, *bucket).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(inside)).join(starts, [*group, *bucket]).withColumn(name, F.col("_s") + F.col("_r") - 1).drop("_r", "_s")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_rows: int = 10_000) -> DataFrame:
    """Deal all rows into shards so that each has the sources' mixture, under the law `rows`: counts at most one apart.

    docs: doc_id, text, source. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), source.
    Within its source each row gets a seeded random rank; (rank + the source's seeded phase) / the source's rows is its
    fractional rank, and the row order by it is cut into equal runs. Groups of equal texts: the law fixes every shard's count, so
    a group larger than a shard, or one that a cut runs through, can't stay whole. The others mostly do: the rank goes by cells of
    the text's digest, so copies within a source lie side by side, and those in several sources as near as the sources' ranks
    agree, which is the closer the more rows they have. Null source is a source of its own; null text has
    size 1 and the checksum of no bytes; repeated rows are dealt each for itself; rows that tie in every column are
    interchangeable. An empty table gives no rows.
    """
    keyed = doc_columns(docs, "doc_id", "text", "source").select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("stratum"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    cell = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("text_crc32").cast("string"), F.col("size").cast("string"))), 1, 3), 16, 10).cast("int")
    rows = materialise(keyed.withColumn("digest", digest).withColumn("cell", cell))
    strata = rows.groupBy("stratum").agg(F.count("*").alias("of_source")).withColumn("phase", _unit(F.md5(F.concat(F.lit(f"{seed}/"), "stratum"))))
    total = rows.count()
    # a large cell is sorted in several runs of its rows' digests
    runs = rows.groupBy("cell").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("runs"))
    cut = rows.join(F.broadcast(runs), "cell").withColumn("run", F.floor(_unit(F.col("digest")) * F.col("runs")).cast("int")).drop("runs")
    ranked = _numbered(cut, ["stratum"], ["cell", "run"], ["digest", "doc_id", "size"], "rank")
    placed = ranked.join(strata, "stratum").withColumn("fraction", (F.col("rank") + F.col("phase")) / F.col("of_source"))
    buckets = max(1, -(-total // bucket_rows))
    placed = placed.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    ordered = _numbered(placed, [], ["bucket"], ["fraction", "stratum", "rank"], "position")
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    slot = F.col("position") - F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    source = F.when(F.col("stratum") != "\u0000", F.col("stratum"))
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), source.alias("source")
    )
