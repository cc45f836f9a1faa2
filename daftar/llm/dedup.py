"""Operator 5: exact deduplication by two-pass Bloom filtering.

Pass one finds the filter cells that two or more rows set. Pass two probes it: a row with a cell that only it set is unique and
passes straight through; the others, real repeats and a few false ones, shuffle and are settled exactly by their digest. More rows
than one filter holds are divided by hash among several, so that at any size unique rows pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_columns, materialise

#: Cells of one segment of the filter.
SEGMENT = 1 << 20


def normalised(column):
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return h & np.uint64(cells - 1), (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (cells - 1).bit_length())


class RepeatFilter:
    """Bits of the cells that at least two rows set. might_repeat never denies a repeated hash."""

    def __init__(self, hashes: DataFrame, max_cells: int):
        """hashes: one column `h` long. Cells: 16 for each row, a power of two, at most max_cells (8 cells a byte): that bounds what
        the driver gathers and broadcasts."""
        spark = hashes.sparkSession
        rows = hashes.count()
        cells = self.cells = min(max_cells, max(SEGMENT, 1 << (16 * rows).bit_length()))

        def part(it):
            found = [b.column(0).to_numpy() for b in it]
            h = np.concatenate(found) if found else np.empty(0, np.int64)
            # a hash that comes twice in this task marks its cells as full
            for start in range(0, len(h), 4_000_000):
                cell, times = np.unique(np.concatenate([x for x in _cells(h[start : start + 4_000_000], cells)]), return_counts=True)
                segment = (cell // np.uint64(SEGMENT)).astype(np.int64)
                inner, edges = (cell % np.uint64(SEGMENT)).astype("<u4"), np.flatnonzero(np.diff(segment, prepend=-1))
                stops = np.append(edges[1:], len(segment))
                rows = [(int(segment[a]), inner[a:b].tobytes(), inner[a:b][times[a:b] > 1].tobytes()) for a, b in zip(edges, stops, strict=True)]
                if rows:
                    s, one, two = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["segment", "once", "twice"])

        def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            for b in groups:
                for one, two in zip(b.column("once").to_pylist(), b.column("twice").to_pylist(), strict=True):
                    at = np.frombuffer(one, "<u4")
                    twice[at[once[at]]] = True
                    once[at] = True
                    twice[np.frombuffer(two, "<u4")] = True
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

        cellwise = hashes.select("h").mapInArrow(part, "segment long, once binary, twice binary")
        bits = np.zeros(cells // 8, np.uint8)
        for segment, packed in cellwise.groupBy("segment").applyInArrow(merge, "segment long, bits binary").collect():
            bits[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(packed, np.uint8)
        self._bits = spark.sparkContext.broadcast(bits.tobytes())

    def might_repeat(self, column):
        cells, bits = self.cells, self._bits

        @F.pandas_udf("boolean")
        def probe(h: pd.Series) -> pd.Series:
            table, hit = np.frombuffer(bits.value, np.uint8), np.ones(len(h), bool)
            for c in _cells(h.to_numpy(np.int64), cells):
                hit &= (table[c >> np.uint64(3)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1 == 1
            return pd.Series(hit)

        return probe(column)


def _part(parts: int):
    """Which of the filters a hash belongs to."""
    return F.pmod(F.xxhash64("h", F.lit("part")), F.lit(parts)).cast("int")


def marked(rows: DataFrame, hashes: DataFrame, max_cells: int) -> DataFrame:
    """rows (with a hash `h` each) and `again`: whether a row might repeat one of hashes (h, all rows' hashes, a written table). Filters
    are as many as give every row 8 cells at least, so that at most one unique row in 20 is taken for a repeated one."""
    parts = max(1, -(-8 * hashes.count() // max_cells))
    if parts == 1:
        return rows.withColumn("again", RepeatFilter(hashes, max_cells).might_repeat(F.col("h")))
    out = None
    for k in range(parts):
        own = rows.where(_part(parts) == k)
        own = own.withColumn("again", RepeatFilter(hashes.where(_part(parts) == k), max_cells).might_repeat(F.col("h")))
        out = own if out is None else out.unionByName(own)
    return out


#: A group is hot from HOT_ROWS rows on, or more in a large table: at most HOT_GROUPS groups are, and those are broadcast.
HOT_ROWS, HOT_GROUPS = 1_000, 100_000


def exact_groups(docs: DataFrame, max_cells: int = 1 << 30) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are equal when their normalised forms have one SHA-256. The smallest doc_id of a group
    stays (a null doc_id only if the group has no other); of repeated rows with that doc_id exactly one is kept. An empty table
    gives no rows. Only digests move: texts are read once and never shuffle. Rows of hot groups meet their group's result where
    they are. max_cells bounds one filter's memory (128 MB).
    """
    text = normalised(F.col("text"))
    digests = materialise(
        doc_columns(docs, "doc_id", "text").select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")).withColumn("row", F.monotonically_increasing_id())
    )
    probed = marked(digests, digests.select("h"), max_cells)
    alone = probed.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = materialise(probed.where("again").select("doc_id", "text_sha256", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = materialise(maybe.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")))
    hot = max(HOT_ROWS, -(-maybe.count() // HOT_GROUPS))
    large = F.broadcast(groups.where(F.col("group_size") >= hot))
    columns = ("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    in_hot = maybe.join(large, "text_sha256").select(*columns)
    others = maybe.join(large, "text_sha256", "left_anti").join(groups.where(F.col("group_size") < hot), "text_sha256").select(*columns)
    return alone.unionByName(in_hot).unionByName(others)


def drop_copies(docs: DataFrame, max_cells: int = 1 << 30) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns. Unique rows pass straight through without a shuffle; of
    possibly repeated ones the aggregation keeps the first before and after the shuffle, so a hot group costs one row a task."""
    sha = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), sha.alias("sha"), docs["doc_id"].alias("id"))
    hashed = rows.withColumn("h", F.xxhash64("sha"))
    probed = marked(hashed, materialise(hashed.select("h")), max_cells)
    settled = probed.where("again").groupBy("sha").agg(F.min_by("whole", F.struct(F.col("id").isNull(), "id")).alias("whole"))
    return probed.where("not again").select("whole.*").unionByName(settled.select("whole.*"))
