"""Operator 10: best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches, encoder
from .shared import doc_columns, materialise

#: Documents that one packing group holds on average; groups are packed apart, which costs a few open sequences each.
GROUP_ROWS = 200_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise and cut. Per piece: doc_id, piece, start, length, ids_crc32. Only documents over capacity are cut; their first
    piece is the short one, and all others are full."""

    def run(it):
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches(it):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.encode(text or "") + end
                n, start, k = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1)
                    for column, value in zip(rows, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, k = stop, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order.

    State: the count of open bins by residual gap. An item of length s may open a bin (gap capacity - s) or go into a bin of
    gap g >= s (gap g becomes g - s; a full bin leaves). It goes where the sum of the squared counts becomes smallest; of
    equal choices, into the smallest gap that fits.
    """
    count = np.zeros(capacity + 1, np.int64)  # by gap, 1 to capacity - 1; 0 and capacity stay 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            bins[i], offsets[i], n_bins = n_bins, 0, n_bins + 1
            continue
        # Change of the sum: a bin leaves gap g (-2 c[g] + 1) and one comes to gap g - s (+2 c[g - s] + 1, none at gap 0).
        change = count[: capacity - s] - count[s:capacity] + 1.0  # half of it, at index g - s for g from s to capacity - 1
        change[0] -= 0.5
        change[count[s:capacity] == 0] = np.inf
        at = int(change.argmin())
        if change[at] <= count[capacity - s] + 0.5:
            b = open_bins[at + s].pop()
            count[at + s] -= 1
            gap = at + s
        else:
            b, gap, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack all documents into as few sequences of at most capacity tokens as the rule reaches.

    docs: doc_id, text. Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    one end token. Repeated rows are packed apart, each with pieces of its own. An empty table gives no rows. Pieces are dealt
    into groups by a hash of their place in the written pieces, about group_rows documents each, so no group grows with the input,
    however many rows are alike; lengths alone decide, longest first, and ties follow doc_id and piece.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, capacity, end_id))
    n = cut.where("piece = 0").count()
    groups = max(1, -(-n // group_rows))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        group = t.column("g")[0].as_py()
        bins, offsets = sum_of_squares(t.column("length").to_numpy(), capacity)
        t = t.drop_columns(["g"]).append_column("sequence_id", pa.array(bins + (group << 36)))
        return t.append_column("offset", pa.array(offsets))

    if groups == 1 and n == 0:
        return spark.createDataFrame([], schema)
    # full pieces need no search; they are spread evenly and stay out of the groups
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity).withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return full.unionByName(rest.groupBy("g").applyInArrow(place, schema))
