"""Batch retrieval: a table of queries against a table of points (chunks with vectors)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from daftar.functions import arabic as A
from daftar.functions import vectors as V

from .laws import FEMININE_NUMBERS, LAWS, alternation, canonical_law_names, lookup

FILTERS = ("law_number", "law_year", "book_number", "article_number", "article_type")
#: Bytes of queries that go to the points at once, and of scores that a task makes at a time.
BROADCAST_BYTES, SCORE_BYTES = 64 << 20, 16 << 20


def ranked(hits: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """Adds rank by score rounded to 9 places, then chunk_id, within each query; keeps `limit`. Becomes a window group limit."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def filter_by(points: DataFrame, ranges: dict[str, tuple] | None = None, **equals) -> DataFrame:
    """V10 for a whole job: AND of equalities and of ranges (column to least and largest value, both included); None is no filter."""
    tests = [F.col(c) == v for c, v in equals.items() if v is not None]
    for c, (least, largest) in (ranges or {}).items():
        tests += ([F.col(c) >= least] if least is not None else []) + ([F.col(c) <= largest] if largest is not None else [])
    return points.where(reduce(lambda a, b: a & b, tests)) if tests else points


def filter_only(points: DataFrame, limit: int, **equals) -> DataFrame:
    """A filtered scan of `limit` rows in chunk_id order."""
    return filter_by(points, **equals).orderBy("chunk_id").limit(limit)


def _parts(queries: DataFrame, query_bytes: Column) -> Iterator[DataFrame]:
    """The queries in parts of at most about BROADCAST_BYTES, as measured, one after the other; every part goes to all points, which
    never move. The queries are made once for both the measure and the parts."""
    queries = queries.persist()
    n, size = queries.select(F.count("*"), F.coalesce(F.sum(query_bytes + 64), F.lit(0))).first()
    parts = -(-size // BROADCAST_BYTES) if n else 0
    for i in range(parts):
        yield queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
    queries.unpersist()


def _one_of(frames: list[DataFrame], spark, kind: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else spark.createDataFrame([], kind)


class _Filters:
    """Filter columns of queries as small codes; null filters say nothing."""

    def __init__(self, asked: pd.DataFrame, columns):
        self.codes = {c: {v: i for i, v in enumerate(asked[c].dropna().unique())} for c in columns}
        self.wanted = {c: np.array([-2 if pd.isna(v) else self.codes[c][v] for v in asked[c]], np.int64) for c in columns}
        sets = np.zeros(len(asked), np.int64)
        for i, w in enumerate(self.wanted.values()):
            sets |= (w != -2).astype(np.int64) << i
        self.kinds = []  # of queries that set the same columns: these, and the queries by what they want there
        for kind in np.unique(sets).tolist():
            rows, used = np.flatnonzero(sets == kind), [c for i, c in enumerate(self.wanted) if kind >> i & 1]
            keys = self._key({c: w[rows] for c, w in self.wanted.items()}, used, len(rows))
            order = np.argsort(keys, kind="stable")
            values, starts = np.unique(keys[order], return_index=True)
            self.kinds.append((used, values, np.split(rows[order], starts[1:])))

    def _key(self, codes: dict[str, np.ndarray], used: list[str], n: int) -> np.ndarray:
        """One value for each combination of codes; -1 where one of them is of no query."""
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for c in used:
            key = key * len(self.codes[c]) + codes[c]
            known &= codes[c] >= 0
        return np.where(known, key, -1)

    def held(self, column: str, values) -> np.ndarray:
        codes = self.codes[column]
        return np.array([codes.get(v, -1) for v in values], np.int64)

    def groups(self, held: dict[str, np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and those of n points (codes by column) that each of them admits, both in rising order."""
        for used, values, rows in self.kinds:
            if not used:
                yield rows[0], np.arange(n)
                continue
            keys = self._key(held, used, n)
            order = np.argsort(keys, kind="stable")
            present, starts = np.unique(keys[order], return_index=True)
            points = np.split(order, starts[1:])
            for _, i, j in zip(*np.intersect1d(values, present, assume_unique=True, return_indices=True), strict=True):
                yield rows[i], points[j]


def _fresh(df: DataFrame, *columns: str) -> DataFrame:
    """Columns under new references: queries may come from points themselves."""
    return df.select(*(F.col(c).alias(c) for c in columns))


def _reached(hits: DataFrame, k: int, names: pd.Series) -> np.ndarray:
    """Of each query, in the order of names, the rounded score of rank k; minus infinity where there are fewer hits."""
    reached = hits.where(F.col("rank") == k).select("query_id", F.round("score", 9).alias("least")).toPandas()
    return names.map(reached.set_index("query_id")["least"]).fillna(-np.inf).to_numpy(np.float64)


#: Points that meet queries in one product.
DENSE_POINTS = 8_192


class _Nearest:
    """The k best points of each query so far. Products in single precision, with room for its error, name the few points that can be
    among these; only they are scored in double precision."""

    def __init__(self, vectors: np.ndarray, k: int, least: np.ndarray):
        self.vectors, self.k, self.least = vectors, k, least
        self.small = vectors.astype(np.float32)
        self.slack = 2 * (vectors.shape[1] + 8) * 2.0**-23 + 1e-8
        self.full = np.full(len(vectors), -np.inf)  # the k-th best, rounded, of queries that have k
        self.best, self.at = np.full((len(vectors), k), -np.inf), np.full((len(vectors), k), -1, np.int64)

    def add(self, rows: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
        """Points x with the numbers at, which rise from call to call: of equal scores the first stays."""
        small = np.ascontiguousarray(x.astype(np.float32).T)
        step = max(1, SCORE_BYTES // (4 * max(1, len(x))))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            scores = self.small[some] @ small
            floor = np.maximum(self.least[some], self.full[some])
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and len(x) > self.k:
                floor[new] = np.partition(scores[new], len(x) - self.k, axis=1)[:, len(x) - self.k]
            near = np.flatnonzero(scores >= (floor - self.slack).astype(np.float32)[:, None])
            width = max(1, SCORE_BYTES // (16 * x.shape[1]))
            for j in range(0, len(near), width):
                r, c = np.divmod(near[j : j + width], len(x))
                self._keep(some[r], np.round(np.einsum("ij,ij->i", self.vectors[some[r]], x[c]), 15), at[c])

    def _keep(self, rows: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        few = np.round(scores, 9)
        keep = (few >= self.least[rows]) & (few > self.full[rows])
        if not keep.any():
            return
        touched, owner = np.unique(rows[keep], return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), owner])
        scores, at = np.concatenate([self.best[touched].ravel(), scores[keep]]), np.concatenate([self.at[touched].ravel(), at[keep]])
        order = np.lexsort((at, -np.round(scores, 9), owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(touched)))[owner]
        order, owner, place = order[place < self.k], owner[place < self.k], place[place < self.k]
        self.best[touched[owner], place], self.at[touched[owner], place] = scores[order], at[order]
        self.full[touched] = np.round(self.best[touched, -1], 9)


def dense_top_k(queries: DataFrame, points: DataFrame, k: int, filters=()) -> DataFrame:
    """V3: query_id, chunk_id, score, rank by cosine. queries: query_id, dense, filter columns; points: chunk_id, dense, the same.
    Zero vectors score 0; rows without a vector are no candidates.

    A task holds its part of the queries, the k best points of each so far, and SCORE_BYTES of scores at a time, however many
    points there are. Points come in the order of their ids within a partition, so the earlier one of equal scores is the smaller.
    Where a task could pass on more than HITS rows, one of SAMPLE points is searched first: the k-th best score there is what a
    point must reach in the search of all. So what the tasks pass on follows the queries and not the number of tasks.
    """

    def unit(rows) -> np.ndarray:
        x = np.stack(rows.to_numpy()).astype(np.float64)
        largest = np.abs(x).max(1, keepdims=True, initial=0)
        x = x / np.where(largest > 0, largest, 1)  # so that squares of very small or large numbers stay numbers
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    kind = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(points.dtypes)['chunk_id']}, score double"
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(points.schema["chunk_id"].dataType), pa.float64()]
    every = _fresh(points, "chunk_id", "dense", *filters).where("dense is not null")
    spark, found = points.sparkSession, []
    for part in _parts(_fresh(queries, "query_id", "dense", *filters).where("dense is not null"), F.size("dense") * 8):
        asked_here = part.toPandas()

        def search(held: DataFrame, least: np.ndarray, asked_here=asked_here) -> DataFrame:
            shared = spark.sparkContext.broadcast((asked_here, least))

            def over_points(it):
                asked, least = shared.value
                if not len(asked):
                    return
                vectors, tests = unit(asked["dense"]), _Filters(asked, filters)
                valid = np.isfinite(vectors).all(1)
                nearest, ids = _Nearest(np.where(valid[:, None], vectors, 0), k, least), []
                for batch in it:
                    for start in range(0, len(batch), DENSE_POINTS):
                        corpus = batch.iloc[start : start + DENSE_POINTS]
                        x = unit(corpus["dense"])
                        good = np.flatnonzero(np.isfinite(x).all(1))  # others have no score
                        x = x[good]
                        for rows, columns in tests.groups({c: tests.held(c, corpus[c])[good] for c in filters}, len(x)):
                            rows = rows[valid[rows]]
                            if len(rows) and len(columns):
                                nearest.add(rows, x[columns], good[columns] + len(ids))
                        ids += corpus["chunk_id"].tolist()
                row, column = np.nonzero(nearest.best > -np.inf)
                asked_ids = asked["query_id"].tolist()
                for i in range(0, len(row), 100_000):
                    r, c = row[i : i + 100_000], column[i : i + 100_000]
                    columns = [[asked_ids[x] for x in r], [ids[x] for x in nearest.at[r, c]], nearest.best[r, c]]
                    yield pd.DataFrame({name: pd.array(pa.array(v, t).to_pandas()) for name, v, t in zip(("query_id", "chunk_id", "score"), columns, types, strict=True)})

            return held.sortWithinPartitions("chunk_id").mapInPandas(over_points, kind)

        least = np.full(len(asked_here), -np.inf)
        if len(asked_here) * k >= HITS:
            sample = every.where(F.pmod(F.xxhash64("chunk_id"), F.lit(SAMPLE)) == 0)
            least = _reached(ranked(search(sample, least), k), k, asked_here["query_id"])
        found.append(search(every, least))
    return ranked(_one_of(found, spark, kind), k)


def terms_of(text: str) -> Column:
    """The terms of a normalised text, with repeats."""
    return F.filter(F.split(A.normalize_for_embedding(F.lower(F.coalesce(text, F.lit("")))), "[ \n]+"), lambda t: t != "")


def _slices(rows: pa.Array, n: int = 1_024) -> Iterator[pa.Array]:
    """An Arrow batch (up to 10,000 whole texts) in slices, so that a function's intermediate values are those of few rows."""
    for i in range(0, len(rows), n):
        yield rows.slice(i, n)


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The lengths of lists and their values, one after the other, as codes of a dictionary."""
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64), lists.flatten().dictionary_encode()


def term_counts(terms: pa.ListArray) -> pa.StructArray:
    """The distinct terms of each list, in order, and how often each occurs."""
    lengths, coded = _coded(terms)
    size = max(1, len(coded.dictionary))
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(size, np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    found, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + place[np.asarray(coded.indices)], return_counts=True)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(found // size, minlength=len(lengths)))]), pa.int32())
    names = coded.dictionary.take(order).take(pa.array(found % size))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(n, pa.float64()))], ["indices", "values"])


def with_sparse(df: DataFrame, text: str = "text") -> DataFrame:
    """V2's arrays beside a text: df with `indices` and `values`, those it has (of any encoder), else the counts of its text's terms. No row
    moves; `postings` and `sparse_vectors` make the same from a table of terms."""
    if "indices" in df.columns:
        return df

    @F.arrow_udf("indices array<string>, values array<double>")
    def counts(terms: pa.Array) -> pa.Array:
        return pa.concat_arrays([term_counts(few) for few in _slices(terms)] or [term_counts(terms)])

    once = counts.asNondeterministic()  # else each of the two columns, and filters on them, would run it again
    return df.withColumn("_s", once(terms_of(text))).withColumns({"indices": F.col("_s.indices"), "values": F.col("_s.values")}).drop("_s")


#: Points of a block of the sparse index, its postings at most (or one point's), and the postings of each term that a search reads first;
#: a query with at most FULL_READ postings in a block has them all summed up, which costs less than choosing.
SPARSE_POINTS, SPARSE_POSTINGS, FIRST_READ, FULL_READ = 4_096, 1_000_000, 64, 65_536
#: One of so many blocks is searched first, for each query's shared threshold.
SAMPLE = 16
INDEX = "block long, chunk_id array<{0}>, terms array<string>, row_starts binary, row_terms binary, row_weights binary, starts binary, points binary, weights binary"


#: Hits that a search holds before it passes them on.
HITS = 100_000


def _indexed(points: DataFrame, filters) -> tuple[DataFrame, T.StructType, Callable]:
    """What sparse_index reads of the points, the index's schema, and the function of batches that makes its rows, one a batch."""
    kind = dict(points.dtypes)
    schema = T.StructType.fromDDL(INDEX.format(kind["chunk_id"]) + "".join(f", filter_{c} array<{kind[c]}>" for c in filters))
    arrow = to_arrow_schema(schema)
    held = _fresh(points, "chunk_id", "indices", "values", *filters).where("indices is not null and values is not null")

    def made(block: pa.Table, number: int) -> pa.RecordBatch:
        indices, values = block.column("indices").combine_chunks(), block.column("values").combine_chunks()
        lengths = np.array(pc.list_value_length(indices), np.int64)
        coded = indices.flatten().dictionary_encode()
        terms, weight = np.asarray(coded.indices, np.int32), np.asarray(values.flatten(), np.float64)
        row = np.repeat(np.arange(block.num_rows, dtype=np.int32), lengths)
        if len(terms) != len(weight) or np.isnan(weight).any() or len(np.unique(row.astype(np.int64) * (len(coded.dictionary) + 1) + terms)) != len(terms):
            raise ValueError("a sparse vector has unequal arrays, a repeated term or a weight that is no number")
        order = np.lexsort((-weight, terms))
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(coded.dictionary)))]).astype(np.int64)
        arrays = [np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), terms, weight, starts, row[order], weight[order]]
        columns = [[number], [block.column("chunk_id").to_pylist()], [coded.dictionary.to_pylist()], *([a.tobytes()] for a in arrays), *([block.column(c).to_pylist()] for c in filters)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(it):
        part, number, waiting, rows, postings = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in it:
            for i in range(0, b.num_rows, 32):
                few = b.slice(i, 32)
                more = pc.sum(pc.list_value_length(few.column("indices"))).as_py() or 0
                if rows and (rows + few.num_rows > SPARSE_POINTS or postings + more > SPARSE_POSTINGS):
                    block = made(pa.Table.from_batches(waiting), (part << 32) + number)
                    number, waiting, rows, postings = number + 1, [], 0, 0
                    yield block
                waiting.append(few)
                rows, postings = rows + few.num_rows, postings + more
        if rows:
            yield made(pa.Table.from_batches(waiting), (part << 32) + number)

    return held, schema, run


def sparse_index(points: DataFrame, filters=()) -> DataFrame:
    """V4's stored form of points (chunk_id, indices, values, filter columns): one row a block of up to SPARSE_POINTS points, made where they
    lie. A block has each term's postings in falling order of weight, every point's own terms, and its points' filters. Weights may be of
    any sign; nulls, NaN and repeated terms of a point are an error. Write it to Parquet once and search it many times."""
    held, schema, run = _indexed(points, filters)
    return held.mapInArrow(run, schema)


class SparseBlock:
    """A block of the index in memory."""

    def __init__(self, row: dict):
        self.ids, self.terms = row["chunk_id"], pa.array(row["terms"], pa.string())
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.row_starts, self.row_terms, self.row_weights = of("row_starts", np.int64), of("row_terms", np.int32), of("row_weights", np.float64)
        self.starts, self.points, self.weights = of("starts", np.int64), of("points", np.int32), of("weights", np.float64)
        self.asked = np.zeros(len(self.terms))  # a query's weights by term
        self._rank = None

    def keep(self, known: np.ndarray) -> None:
        """Leaves out of the points' own terms those that no query has. known: of each word of the queries its number here, or -1."""
        word = np.full(len(self.terms), -1, np.int64)
        word[known[known >= 0]] = np.flatnonzero(known >= 0)
        stay = word[self.row_terms] >= 0
        self.row_starts = np.concatenate([[0], np.cumsum(stay)])[self.row_starts]
        self.row_terms, self.row_weights = self.row_terms[stay], self.row_weights[stay]
        self.row_words = word[self.row_terms]
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.row_starts))
        self.norms = np.sqrt(np.bincount(self.row, self.row_weights**2, len(self.ids)))
        self.falling = np.argsort(-self.norms, kind="stable")

    def rank(self) -> np.ndarray:
        """The place of each point in the order of ids."""
        if self._rank is None:
            self._rank = np.empty(len(self.ids), np.int64)
            self._rank[np.asarray(pc.array_sort_indices(self.ids))] = np.arange(len(self.ids))
        return self._rank

    def best(self, points: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of these by rounded score, then id."""
        if len(scores) <= k:
            return points, scores
        few = np.lexsort((self.rank()[points], -np.round(scores, 9)))[:k]
        return points[few], scores[few]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """The inner products of `asked` with these points."""
        n = self.row_starts[rows + 1] - self.row_starts[rows]
        if n.sum() > 256 * len(rows):  # long ones by themselves, without lists of places
            return np.array([self.asked[self.row_terms[a:b]] @ self.row_weights[a:b] for a, b in zip(self.row_starts[rows].tolist(), self.row_starts[rows + 1].tolist(), strict=True)])
        firsts = np.cumsum(n) - n
        at = np.repeat(self.row_starts[rows] - firsts, n) + np.arange(n.sum())
        return np.add.reduceat(self.asked[self.row_terms[at]] * self.row_weights[at], firsts)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float, admitted: np.ndarray | None, first: int = FIRST_READ, full: int = FULL_READ) -> tuple[np.ndarray, np.ndarray, int]:
        """Points, their scores and the postings read: all admitted points that may be among the k best and reach `least`.

        Postings are read in falling order of what they add, some of every term at a time, and each point met is scored exactly. No point
        that is still unmet can have more than the next postings' sum; once that is below the k-th best score (or `least`), the rest is
        skipped.
        """
        low, high = self.starts[terms], self.starts[terms + 1]
        total = int((high - low).sum())
        if total <= full:
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
            sums = np.bincount(self.points[at], np.repeat(weights, n) * self.weights[at], len(self.ids))
            met = np.bincount(self.points[at], minlength=len(self.ids)) > 0
            points = np.flatnonzero(met if admitted is None else met & admitted)
            scores = np.round(sums[points], 15)
            floor = least
            if len(points) > k:
                few = np.round(scores, 9)
                floor = max(least, np.partition(few, len(few) - k)[len(few) - k])
            keep = np.round(scores, 9) >= floor
            return points[keep], scores[keep], total
        self.asked[terms] = weights
        done, step, read = np.zeros(len(terms), np.int64), first, 0
        met = np.zeros(len(self.ids), bool)
        points, scores = [], []
        best = np.empty(0)
        while True:
            n = np.minimum(high - low - done, step)
            if not n.any():
                break
            owner = np.repeat(np.arange(len(terms)), n)
            off = np.repeat(done, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.where(weights[owner] >= 0, low[owner] + off, high[owner] - 1 - off)
            done, read = done + n, read + len(at)
            new = np.unique(self.points[at])
            new = new[~met[new]]
            met[new] = True
            if admitted is not None:
                new = new[admitted[new]]
            if len(new):
                exact = np.round(self.exact(new), 15)
                points.append(new), scores.append(exact)
                best = np.concatenate([best, np.round(exact, 9)])
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[-k:]
            left = done < high - low
            following = np.where(weights >= 0, low + done, high - 1 - done)[left]
            bound = np.maximum(weights[left] * self.weights[following], 0).sum()
            reached = max(least, best.min()) if len(best) == k else least
            if np.round(bound, 9) + 1e-9 < reached:
                break
            step *= 2
        self.asked[terms] = 0
        if not points:
            return np.empty(0, np.int32), np.empty(0), read
        points, scores = np.concatenate(points), np.concatenate(scores)
        floor = max(least, best.min()) if len(best) == k else least
        keep = np.round(scores, 9) >= floor
        return points[keep], scores[keep], read


#: Terms of queries that are counted in a matrix product, at most, groups of the other terms there, and the bytes of a part's queries in that form.
HEAD_TERMS, TAIL_GROUPS, HEAD_BYTES = 1_024, 64, 64 << 20


class _Heads:
    """A part's queries for products with blocks: the weights of their most common terms as rows of a matrix, beside them the norms of the
    others, in groups.

    A score is the product over the common terms plus what the others add, and that is at most the product of their norms in each group, and at
    most the sum of each of them times its largest weight in the block. So one product in single precision, with room for its error, names
    the few points that can reach a query's floor; only they are scored exactly. Points whose norm is too small to reach any floor
    (no score is larger than the product of norms) stay out of the product.
    """

    def __init__(self, lengths: np.ndarray, words: pa.DictionaryArray, weight: np.ndarray):
        n, code = len(lengths), np.asarray(words.indices)
        often = np.bincount(code, minlength=len(words.dictionary))
        order = np.argsort(-often, kind="stable")[: max(1, min(HEAD_TERMS, HEAD_BYTES // (4 * max(1, n)) - TAIL_GROUPS))]
        order = order[often[order] >= max(2, n // 500)]
        self.place, self.size = np.full(len(words.dictionary), -1, np.int64), len(order)
        self.place[order] = np.arange(len(order))
        owner, head = np.repeat(np.arange(n), lengths), self.place[code]
        inside = head >= 0
        self.rows = np.zeros((n, self.size + TAIL_GROUPS), np.float32)
        self.rows[owner[inside], head[inside]] = weight[inside]
        self.owner, self.code, self.weight = owner[~inside], code[~inside], weight[~inside]
        self.norms = np.sqrt(np.bincount(owner, weight**2, n))
        self.rest = np.sqrt(np.bincount(self.owner, self.weight**2, n))
        self.rows[:, self.size :] = np.sqrt(np.bincount(self.owner * TAIL_GROUPS + self.code % TAIL_GROUPS, self.weight**2, n * TAIL_GROUPS)).reshape(n, -1)
        self.signed = bool((weight < 0).any())
        self.sound = np.isfinite(self.rows).all(1) & np.isfinite(self.norms)

    def near(self, block: SparseBlock, known: np.ndarray, groups, least: np.ndarray, k: int) -> tuple[list, np.ndarray]:
        """Of a block, for each query that has a positive floor there, the points that can reach it: (query, points); and the queries
        without such a floor. known: the block's number of each of the dictionary's terms, or -1. groups: queries and points that may meet,
        these as places in the falling order of norms."""
        m, size = len(block.ids), self.size
        row, word, order = block.row, block.row_words, block.falling
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        norms, head = block.norms[order], self.place[word]
        inside = head >= 0
        held = np.zeros((m, size + TAIL_GROUPS), np.float32)
        held[place[row[inside]], head[inside]] = block.row_weights[inside]
        squares = np.bincount(place[row[~inside]] * TAIL_GROUPS + word[~inside] % TAIL_GROUPS, block.row_weights[~inside] ** 2, m * TAIL_GROUPS).reshape(m, -1)
        held[:, size:], rest = np.sqrt(squares), np.sqrt(squares.sum(1))
        every = [rows for rows, _ in groups]
        if not np.isfinite(held).all() or not np.isfinite(norms).all():
            return [], np.concatenate([*every, np.empty(0, np.int64)])
        signed = self.signed or bool((block.row_weights < 0).any())
        at = known[self.code]
        met = at >= 0
        first, last = block.weights[block.starts[:-1]], block.weights[block.starts[1:] - 1]
        adds = self.weight[met] * first[at[met]]
        if signed:
            adds = np.maximum(np.maximum(adds, self.weight[met] * last[at[met]]), 0)
        most = np.bincount(self.owner[met], adds, len(self.norms))  # what the other terms can add in this block
        error = (size + TAIL_GROUPS + 8) * 2.0**-22
        out, without = [], []
        for rows, columns in groups:
            without.append(rows[~self.sound[rows]])
            rows = rows[self.sound[rows] & (self.norms[rows] > 0)]
            floor = least[rows]
            need = np.where(floor > 0, floor / self.norms[rows] * (1 - 1e-6) - 1e-8, -np.inf)
            reach = np.searchsorted(-norms[columns], -need, side="right")
            rows, floor, reach = rows[reach > 0], floor[reach > 0], reach[reach > 0]
            by = np.argsort(-reach, kind="stable")
            rows, floor, reach = rows[by], floor[by], reach[by]
            i = 0
            while i < len(rows):
                width = int(reach[i])
                j = min(len(rows), i + max(1, min(1_024, SCORE_BYTES // (4 * width))))
                j = i + max(1, int(np.searchsorted(-reach[i:j], -(width // 2), side="right")))  # of a like reach
                some, low, points = rows[i:j], floor[i:j].copy(), columns[:width]
                i = j
                tail, slack = self.rest[some], error * self.norms[some] * norms[points[0]] + 1e-8
                summed = (most[some] < tail * np.median(rest[points])) | ~(low > 0)  # queries whose other terms are bounded by their sum
                left = self.rows[some]
                left[summed, size:] = 0
                scores = left @ held[points].T
                new = np.flatnonzero(~(low > 0))
                if len(new) and width >= k:
                    sure = np.partition(scores[new], width - k, axis=1)[:, width - k] - slack[new]
                    if signed:
                        sure = sure - tail[new] * rest[points].max()
                    low[new] = np.where(sure > 0, sure, low[new])
                lacking = ~(low > 0)
                without.append(some[lacking])
                limit = np.where(lacking, np.inf, low - slack - np.where(summed, most[some], 0))
                hits = np.flatnonzero(scores >= np.nextafter(limit.astype(np.float32), np.float32(-np.inf))[:, None])
                r, c = np.divmod(hits, width)
                bound = scores.ravel()[hits] + np.where(summed[r], np.minimum(tail[r] * rest[points[c]], most[some[r]]), 0)
                keep = (bound >= low[r] - 2 * slack[r]) & (norms[points[c]] > 0)
                r, c = r[keep], c[keep]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True) if len(r) else ():
                    out.append((int(some[r[a]]), order[points[c[a:b]]]))
        return out, np.concatenate([*without, np.empty(0, np.int64)])


def sparse_search(queries: DataFrame, index: DataFrame, k: int, filters=(), sampled: bool = True) -> DataFrame:
    """V4 over an index as of sparse_index: query_id, chunk_id, score, rank by the inner product of weights; points without a shared term
    are no candidates. queries: query_id, indices, values, filter columns.

    Some of the blocks of a stored index are searched first (sampled); the k-th best score there is a query's threshold in all others,
    which so skip most of their points. Within a task the threshold rises as blocks fill it. Results are those of scoring every point. A
    task holds a part of the queries (BROADCAST_BYTES, as codes of its distinct terms, and HEAD_BYTES), a batch of the index (64 MB or one
    row), SCORE_BYTES of scores and HITS hits.
    """
    first = F.pmod(F.xxhash64("block"), F.lit(SAMPLE)) == 0
    stages = [first, ~first] if sampled and index.select("block").count() >= 2 * SAMPLE else [F.lit(True)]
    return _sparse_hits(queries, [index.where(stage) for stage in stages], index.schema["chunk_id"].dataType.elementType, lambda it: it, k, filters)


def _sparse_hits(queries: DataFrame, stages: list[DataFrame] | Callable, id_type: T.DataType, blocks: Callable, k: int, filters) -> DataFrame:
    """sparse_search over stages, of two the first for thresholds; `blocks` makes batches of the index of a task's rows. stages may be a
    function of the number of hits that a task could pass on."""
    asked = _fresh(queries, "query_id", "indices", "values", *filters).where("size(indices) > 0")
    spark = queries.sparkSession
    kind = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {id_type.simpleString()}, score double"
    id_arrow = to_arrow_type(id_type)
    found = []
    for part in _parts(asked, F.expr("size(indices) * 16L")):
        part = part.toArrow().combine_chunks()
        names = pa.concat_arrays(part.column("query_id").chunks) if part.num_rows else part.column("query_id").combine_chunks()
        table = (names, part.select(list(filters)).to_pandas(), *_coded(part.column("indices").combine_chunks()), np.asarray(part.column("values").combine_chunks().flatten(), np.float64))
        least = np.full(part.num_rows, -np.inf)
        if callable(stages):
            stages = stages(part.num_rows * k)
        for stage in stages:
            shared = spark.sparkContext.broadcast((table, least))

            def over_blocks(it, shared=shared):
                (names, wanted_of, lengths, words, weight), given = shared.value
                if not len(names):
                    return
                least, tests, heads = given.copy(), _Filters(wanted_of, filters), _Heads(lengths, words, weight)
                ends, code, tops = np.cumsum(lengths), np.asarray(words.indices), np.full((len(names), k), -np.inf)
                for b in blocks(it):
                    for i in range(b.num_rows):
                        row = {c: v[i].as_buffer() if pa.types.is_binary(v.type) else v[i].values if pa.types.is_list(v.type) else v[i] for c, v in zip(b.schema.names, b.columns, strict=True)}
                        block = SparseBlock(row)
                        ids = pa.array(block.ids, id_arrow)
                        known = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=block.terms), -1))
                        held = {c: tests.held(c, row[f"filter_{c}"].to_pylist()) for c in filters}
                        out: tuple[list, list, list] = ([], [], [])
                        n = 0

                        def passed(out=out, ids=ids):
                            asked_of = np.repeat(np.array(out[0], np.int64), [len(p) for p in out[1]])
                            return pa.RecordBatch.from_arrays([names.take(pa.array(asked_of)), ids.take(pa.array(np.concatenate(out[1]))), pa.array(np.concatenate(out[2]), pa.float64())], ["query_id", "chunk_id", "score"])

                        for q, points, scores in _block_hits(block, heads, tests, held, known, code, ends, lengths, weight, least, tops, k):
                            out[0].append(q), out[1].append(points), out[2].append(scores)
                            n += len(scores)
                            if n >= HITS:
                                yield passed()
                                n = 0
                                for column in out:
                                    column.clear()
                        if n:
                            yield passed()

            hits = ranked(stage.mapInArrow(over_blocks, kind), k)
            if len(stages) > 1 and stage is stages[0]:
                hits = hits.persist(StorageLevel.DISK_ONLY)  # k rows a query at most, read for the thresholds and as results
                least = _reached(hits, k, names.to_pandas())
            found.append(hits.drop("rank"))
    return ranked(_one_of(found, spark, kind), k)


def _block_hits(block: SparseBlock, heads: _Heads, tests: _Filters, held: dict, known: np.ndarray, code: np.ndarray, ends: np.ndarray, lengths: np.ndarray, weight: np.ndarray, least: np.ndarray, tops: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, points, scores) of a block, at most the k best of each query. These go into `tops`, its k best scores of all blocks so far,
    and the last of these is its threshold in `least`."""
    block.keep(known)
    groups = list(tests.groups({c: v[block.falling] for c, v in held.items()}, len(block.ids)))

    def kept(q: int, points: np.ndarray, scores: np.ndarray):
        points, scores = block.best(points, scores, k)
        every = np.concatenate([tops[q], np.round(scores, 9)])
        tops[q] = np.partition(every, len(every) - k)[len(every) - k :]
        least[q] = max(least[q], tops[q].min())
        return q, points, scores

    near, without = heads.near(block, known, groups, least, k)
    for q, points in near:
        of = slice(ends[q] - lengths[q], ends[q])
        terms = known[code[of]]
        here = terms >= 0
        terms = terms[here]
        block.asked[terms] = weight[of][here]
        scores = np.round(block.exact(points), 15)
        block.asked[terms] = 0
        reach = (scores > 0) & (np.round(scores, 9) >= least[q])
        if reach.any():
            yield kept(q, points[reach], scores[reach])
    if not len(without):
        return
    admitted_of = {}
    for rows, columns in groups:
        if len(columns) < len(block.ids):
            admits = np.zeros(len(block.ids), bool)
            admits[block.falling[columns]] = True
            admitted_of |= dict.fromkeys(np.intersect1d(rows, without).tolist(), admits)
    for q in np.sort(without).tolist():
        of = slice(ends[q] - lengths[q], ends[q])
        terms = known[code[of]]
        if (terms >= 0).any():
            points, scores, _ = block.search(terms[terms >= 0], weight[of][terms >= 0], k, least[q], admitted_of.get(q))
            if len(scores):
                yield kept(q, points, scores)


def sparse_top_k(queries: DataFrame, points: DataFrame, k: int, filters=()) -> DataFrame:
    """V4 over points in place: their sparse vectors (`indices`, `values`), or else the term counts of their `text`. Each block of an index is
    made, searched and dropped by the task that reads its points. Where a task could pass on more than HITS rows, the longest of SAMPLE
    points are searched before the others, for the queries' thresholds there."""
    schema, run = _indexed(with_sparse(points), filters)[1:]

    def stages(hits: int) -> list[DataFrame]:
        long = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x) if "indices" in points.columns else F.octet_length("text")
        cut = points.select(F.percentile_approx(long, 1 - 1 / SAMPLE)).first()[0] if hits >= HITS else None
        if cut is None:
            return [_indexed(with_sparse(points), filters)[0]]
        first = F.coalesce(long >= F.lit(cut), F.lit(False))
        return [_indexed(with_sparse(points.where(some)), filters)[0] for some in (first, ~first)]

    return _sparse_hits(with_sparse(queries), stages, schema["chunk_id"].dataType.elementType, run, k, filters)


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """V2: key, term, weight: how often each term of the normalised text occurs."""
    terms = texts.select(key, F.explode(F.split(A.normalize_for_embedding(F.lower(text)), "[ \n]+")).alias("term"))
    return terms.where("term <> ''").groupBy(key, "term").agg(F.count("*").cast("double").alias("weight"))


def sparse_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """V2 in the other layout: parallel arrays of terms, in order, and their weights."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    grouped = weighted.groupBy(key).agg(pairs.alias("p"))
    return grouped.select(key, F.transform("p", lambda p: p["term"]).alias("indices"), F.transform("p", lambda p: p["weight"]).alias("values"))


def rrf(lists: list[DataFrame], limit: int, constant: int = 60) -> DataFrame:
    """V5: fuses ranked lists (query_id, chunk_id, rank from 1) by the sum of 1 / (constant + rank)."""
    every = reduce(lambda a, b: a.unionByName(b), [x.select("query_id", "chunk_id", "rank") for x in lists])
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))
    return ranked(fused, limit)


def hybrid_search(queries: DataFrame, points: DataFrame, limit: int = 10, prefetch: int = 30, filters=("law_number",), index: DataFrame | None = None) -> DataFrame:
    """V6: dense and sparse lists of `prefetch` each, filtered before their cuts, fused. queries: query_id, dense, text, filters;
    points: chunk_id, dense, text, filters. Sparse vectors (`indices`, `values`) of either side take the place of its text. index: the points'
    stored sparse_index with these filters, which then is searched instead."""
    asked = with_sparse(queries).persist()  # read for both lists
    sparse = sparse_top_k(asked, points, prefetch, filters) if index is None else sparse_search(asked, index, prefetch, filters)
    lists = [dense_top_k(asked, points, prefetch, filters), sparse]
    asked.unpersist()
    return rrf(lists, limit)


def late_interaction(pairs: DataFrame, query_text: str, passage_text: str, cap: int = 256, encoder=V.hashed_token_vectors) -> DataFrame:
    """V7: query_id, chunk_id, score: for each of a query's tokens (first `cap`) the best cosine among the passage's, averaged.

    Only for the few candidates of each query. Each pair is one product of two small matrices, in Arrow batches; `encoder` makes
    unit vectors of a list of tokens and may hold a model.
    """
    tokens = lambda c: F.slice(F.filter(F.split(A.normalize_for_embedding(F.lower(c)), "[ \n]+"), lambda t: t != ""), 1, cap)

    @F.arrow_udf(T.DoubleType())
    def best_match(asked: pa.Array, held: pa.Array) -> pa.Array:
        made: dict[tuple, np.ndarray] = {}

        def matrix(words) -> np.ndarray:
            key = tuple(words)
            if key not in made:
                if len(made) >= 512:
                    made.clear()
                made[key] = encoder(list(words))
            return made[key]

        scores = []
        for some, few in zip(_slices(asked, 256), _slices(held, 256), strict=True):
            scores += [float((matrix(a) @ matrix(b).T).max(1).mean()) if a and b else None for a, b in zip(some.to_pylist(), few.to_pylist(), strict=True)]
        return pa.array(scores, pa.float64())

    once = best_match.asNondeterministic()  # else the filter below would run it again
    scored = pairs.select("query_id", "chunk_id", once(tokens(F.col(query_text)), tokens(F.col(passage_text))).alias("score"))
    return scored.where("score is not null")


def token_vectors(texts: DataFrame, key: str, text: str, cap: int = 256, encoder=V.hashed_token_vectors) -> DataFrame:
    """V7's stored form: key, n_tokens, vectors (the unit vectors of a text's first `cap` tokens, one after the other). Write it once
    beside the chunks; searches then encode no passage."""
    kind = dict(texts.dtypes)[key]
    tokens = texts.select(F.col(key).alias("_key"), F.slice(terms_of(text), 1, cap).alias("_terms"))

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256)
                words = rows.column("_terms").to_pylist()
                sizes = [len(w) for w in words]
                flat = np.asarray(encoder([t for w in words for t in w]), np.float64)
                width = flat.shape[1] if len(flat) else 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column("_key"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], [key, "n_tokens", "vectors"])

    return tokens.mapInArrow(run, f"{key} {kind}, n_tokens int, vectors array<double>")


def score_candidates(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """V7 over stored vectors: query_id, chunk_id, score of pairs (query_id, chunk_id); asked and held are token_vectors of queries and
    chunks. All candidates of a query meet it in one product. Pairs with an empty side have no score."""
    kinds = {**dict(asked.dtypes), **dict(held.dtypes)}
    met = pairs.select("query_id", "chunk_id").join(held.where("n_tokens > 0"), "chunk_id")
    types = [to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(held.schema["chunk_id"].dataType), pa.float64()]

    def product(query: pa.Table, passages: pa.Table) -> pa.Table:
        columns: list = [[], [], []]
        if query.num_rows and passages.num_rows:
            n = query.column("n_tokens")[0].as_py()
            one = np.asarray(query.column("vectors").combine_chunks().flatten(), np.float64).reshape(n, -1)
            every = np.asarray(passages.column("vectors").combine_chunks().flatten(), np.float64).reshape(-1, one.shape[1])
            sizes = passages.column("n_tokens").to_numpy()
            best = np.maximum.reduceat(one @ every.T, np.cumsum(sizes) - sizes, axis=1).mean(0)
            columns = [[query.column("query_id")[0].as_py()] * len(best), passages.column("chunk_id").to_pylist(), best]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query_id", "chunk_id", "score"), columns, types, strict=True)})

    sides = asked.where("n_tokens > 0").groupBy("query_id").cogroup(met.groupBy("query_id"))
    return sides.applyInArrow(product, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")


def rerank(scores: DataFrame, top_k: int, cap: int = 50) -> DataFrame:
    """V8: scores in descending order per query; more than `cap` passages of one query are an error."""
    n = F.count("*").over(W.partitionBy("query_id"))
    checked = scores.withColumn("_n", n).withColumn("score", F.when(F.col("_n") > cap, F.raise_error(F.lit("too many passages")).cast("double")).otherwise(F.col("score")))
    return ranked(checked.drop("_n"), top_k)


def search_articles(queries: DataFrame, points: DataFrame, top_k: int = 5, candidate_k: int = 20, stored: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """V9: hybrid candidates, reranked by late interaction on the display text; queries without candidates have no rows. stored:
    token_vectors of the points; without them the candidates' passages are encoded pair by pair. index: as in hybrid_search."""
    found = hybrid_search(queries, points, candidate_k, candidate_k, index=index).select("query_id", "chunk_id")
    if stored is not None:
        return rerank(score_candidates(found, token_vectors(queries, "query_id", "text"), stored), top_k)
    texts = points.select("chunk_id", F.coalesce("text_for_display", "body_faithful").alias("passage"))
    pairs = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(texts, "chunk_id")
    return rerank(late_interaction(pairs, "query", "passage"), top_k)


def lookup_article(refs: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, chunk_id, rank by chunk_id. refs: query_id, number, article_type (null: either), and law_number, law_year,
    book_number filters. Issuance and substantive numbers are apart; either is a lookup of its own, never an OR."""
    common = ("law_number", "law_year", "book_number")
    sides = []
    for kind, column in (("substantive", "article_number"), ("issuance", "issuance_number")):
        asked = refs.where(F.col("article_type").isNull() | (F.col("article_type") == kind))
        held = chunks.where(F.col(column).isNotNull()).select("chunk_id", F.col(column).alias("number"), "article_type", *common)
        sides.append(smallest_chunks(asked, held, ("number",), ("article_type", *common), limit))
    return in_order(sides[0].unionByName(sides[1]), limit)


def smallest_chunks(asked: DataFrame, held: DataFrame, exact, optional, limit: int) -> DataFrame:
    """query_id, chunk_id: for each query the `limit` smallest chunk ids (copies of an id once) whose `exact` columns equal its own, and those of
    `optional` that it sets.

    What a query gets depends on its values alone. So of every combination of values that points have, in the columns that some
    query sets, the first ids are found once, where points lie, and queries join these few: no query meets all points of its number.
    """
    keys = [*exact, *optional]
    bits = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(optional)])
    asked = asked.select("query_id", *keys).withColumn("_set", bits)
    every = F.explode(F.array(*map(F.lit, range(1 << len(optional))))).alias("_set")
    points = held.select("chunk_id", *keys, every).join(F.broadcast(asked.select("_set").distinct()), "_set")
    points = points.select("chunk_id", "_set", *exact, *(F.when(F.col("_set").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).alias(c) for i, c in enumerate(optional)))
    place = F.dense_rank().over(W.partitionBy("_set", *keys).orderBy("chunk_id"))
    first = points.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n").distinct()
    same = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in ("_set", *exact)] + [F.col(f"q.{c}").eqNullSafe(F.col(f"p.{c}")) for c in optional]
    return asked.alias("q").join(first.alias("p"), reduce(lambda a, b: a & b, same)).select("q.query_id", "p.chunk_id")


def in_order(found: DataFrame, limit: int) -> DataFrame:
    """The `limit` smallest chunk ids of each query, with their ranks."""
    ids = F.slice(F.array_sort(F.collect_set("chunk_id")), 1, limit)
    return found.groupBy("query_id").agg(ids.alias("_ids")).select("query_id", F.posexplode("_ids").alias("_i", "chunk_id")).select("query_id", "chunk_id", (F.col("_i") + 1).alias("rank"))


def article_by_number(queries: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, chunk_id, rank for raw numbers (query_id, raw, law_number or null). A repeated (mukarrar) number matches nothing."""
    asked = queries.select("query_id", "law_number", A.article_number(F.col("raw")).alias("n")).where("n.number is not null and not n.is_mukarrar")
    asked = asked.select("query_id", "law_number", F.col("n.number").alias("number"))
    held = chunks.where("article_number is not null").select("chunk_id", F.col("article_number").alias("number"), "law_number")
    return in_order(smallest_chunks(asked, held, ("number",), ("law_number",), limit), limit)


def article_reference(c: Column) -> Column:
    """struct(number, article_type, law_number, law_year) that a query names; number null where it names no article."""
    text = A.arabic_to_ascii(A.normalize_for_match(c))
    found = lambda pattern: F.regexp_extract(text, pattern, 1)
    number = lambda pattern: found(pattern).try_cast("int")
    named = [law[:3] for law in LAWS]
    folded = lambda s: s.translate(str.maketrans("أإآٱى", "ااااي"))
    by_name = lambda i: F.coalesce(*(F.when(text.contains(folded(x[0])), x[i]) for x in named))
    ordinal = lookup(found(f"(?:ال)?ماد[ةه]\\s+({alternation(FEMININE_NUMBERS)})(?![ء-ي0-9])"), FEMININE_NUMBERS)
    digits = number(r"(?:ال)?ماد[ةه]\s*(?:رقم)?\s*[()]*\s*([0-9]+)\s*[()]*")
    return F.struct(
        F.coalesce(ordinal, digits).alias("number"),
        F.when(ordinal.isNotNull(), "issuance").when(digits.isNotNull(), "substantive").alias("article_type"),
        F.coalesce(number(r"قانون[\s\S]{0,60}?رقم\s*[()]*\s*([0-9]+)"), by_name(1)).alias("law_number"),
        F.coalesce(number(r"لسنة\s*[()]*\s*([0-9]+)"), by_name(2)).alias("law_year"),
    )


def routed(queries: DataFrame) -> DataFrame:
    """V14's first half: adds ref and route: ranked where the caller filters by article_number or no article is named, else lookup."""
    q = queries.withColumn("ref", article_reference(F.col("text")))
    return q.withColumn("route", F.when(F.col("article_number").isNotNull() | F.col("ref.number").isNull(), "ranked").otherwise("lookup"))


def smart_search(queries: DataFrame, points: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, route, chunk_id, rank. The caller's filters take the place of parsed ones."""
    q = routed(queries)
    refs = q.where("route = 'lookup'").select(
        "query_id", F.col("ref.number").alias("number"), F.coalesce("article_type", "ref.article_type").alias("article_type"),
        F.coalesce("law_number", "ref.law_number").alias("law_number"), F.coalesce("law_year", "ref.law_year").alias("law_year"), "book_number",
    )
    direct = lookup_article(refs, points, limit).select("query_id", F.lit("lookup").alias("route"), "chunk_id", "rank")
    semantic = hybrid_search(q.where("route = 'ranked'"), points, limit, filters=FILTERS).select("query_id", F.lit("ranked").alias("route"), "chunk_id", "rank")
    return direct.unionByName(semantic)


def typed_hits(payload: DataFrame) -> DataFrame:
    """Missing payload fields get their defaults; law names are canonical."""
    filled = payload.select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_id", "citation_label", "article_type", "body_faithful", "header")),
        F.coalesce("law_number", F.lit(0)).alias("law_number"), F.coalesce("law_year", F.lit(0)).alias("law_year"), "article_number",
        F.coalesce("article_status", F.lit("active")).alias("article_status"), F.coalesce("part_kind", F.lit("normal")).alias("part_kind"), F.col("law_name").alias("payload_name"),
    )
    return canonical_law_names(filled, "payload_name").withColumnRenamed("body_faithful", "clean_text").drop("payload_name", "is_known")


REPEALED = "⚠ ملغاة — هذه المادة لم تعد سارية"


def context_block(ancestry: bool) -> Column:
    """A hit as text: label, its ancestry (or its header), a warning if repealed, and the body."""
    some = lambda c: F.nullif(c, F.lit(""))
    part = F.when(F.col("part_kind") == "preamble", "الباب التمهيدي").otherwise(some(F.col("part_title"))) if ancestry else None
    above = (
        some(F.concat_ws(" ▸ ", some(F.col("division_title")), some(F.col("book_title")), part, some(F.col("chapter_title")), some(F.col("section_title")), some(F.col("subsection_title"))))
        if ancestry
        else F.col("header")
    )
    return F.concat_ws("\n", F.concat(F.lit("["), "citation_label", F.lit("]")), above, F.when(F.col("article_status") == "repealed", REPEALED), F.col("body_faithful"))


def dense_of(text: str, size: int = 64) -> Column:
    """V1 as a column: a hashed bag of a text's terms with unit length, null without terms. Rows stay where they are."""

    def vectors(terms: pa.ListArray) -> pa.Array:
        lengths, coded = _coded(terms)
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        digests = np.frombuffer(b"".join([hashlib.md5(t).digest()[:3] for t in words]), np.uint8).reshape(-1, 3).astype(np.int64)
        slot, sign = (digests[:, 0] * 256 + digests[:, 1]) % size, np.where(digests[:, 2] < 128, 1.0, -1.0)
        of = np.asarray(coded.indices, np.int64)
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths) * size + slot[of], sign[of], len(lengths) * size).reshape(-1, size).astype(np.float64)  # of no term at all, whole numbers
        sums /= np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * size, pa.int32()), pa.array(sums.ravel(), pa.float64()), mask=pa.array(lengths == 0))

    @F.arrow_udf("array<double>")
    def hashed(terms: pa.Array) -> pa.Array:
        return pa.concat_arrays([vectors(few) for few in _slices(terms, 4_096)] or [vectors(terms)])

    return hashed.asNondeterministic()(terms_of(text))  # else filters on it would run it again


def encode(texts: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """V1: key, dense: the default encoder's vectors of the texts that have terms, one a row. Another encoder (a model held by
    each Python worker) goes in by mapInPandas with the same columns."""
    return texts.select(key, dense_of(text, size).alias("dense")).where("dense is not null")


def with_dense(texts: DataFrame, text: str, size: int = 64) -> DataFrame:
    """V1 beside each text: those without terms have the zero vector."""
    return texts.withColumn("dense", F.coalesce(dense_of(text, size), F.array_repeat(F.lit(0.0), size)))


def encode_all(texts: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """V1 with a row for every text."""
    return with_dense(texts, text, size).select(key, "dense")


#: Models that this Python worker has loaded, by name.
_LOADED: dict = {}


def encode_in_workers(texts: DataFrame, key: str, text: str, name: str, load: Callable[[], Callable], limit: int = 1_536, batch_tokens: int = 16_384, window: int = 2_048) -> DataFrame:
    """V1 with a model: key, dense, indices, values of every text, dense and sparse out of one call.

    load() makes an encoder, once in each Python worker and name; that takes a list of token lists, each cut after `limit` tokens, and
    gives as many (dense vector, {term: weight}). A window of texts is put in the order of their lengths and called in batches whose longest
    text times their number stays within batch_tokens, so short texts are not padded to long ones. Null texts have no tokens.
    Rows keep their number; nothing else of them is held than a window.
    """
    kind = dict(texts.dtypes)[key]
    tokens = texts.select(F.col(key).alias("_key"), F.slice(terms_of(text), 1, limit).alias("_terms"))

    def run(it):
        from daftar.operators import retrieval as home  # the worker's own module; a global of this function would travel with each task

        if name not in home._LOADED:
            home._LOADED[name] = load()
        model = home._LOADED[name]
        for batch in it:
            for at in range(0, batch.num_rows, window):
                rows = batch.slice(at, window)
                words = rows.column("_terms").to_pylist()
                order = sorted(range(len(words)), key=lambda i: len(words[i]))
                made: list = [None] * len(words)
                while order:
                    n = 1
                    while n <= len(order) and n * len(words[order[n - 1]]) <= batch_tokens:
                        n += 1
                    n = max(1, n - 1)
                    now, order = order[:n], order[n:]
                    for i, v in zip(now, model([words[i] for i in now]), strict=True):
                        made[i] = v
                sparse = [sorted(s.items()) for _, s in made]
                columns = [rows.column("_key"), pa.array([[float(x) for x in d] for d, _ in made], pa.list_(pa.float64())), pa.array([[t for t, _ in s] for s in sparse], pa.list_(pa.string())), pa.array([[float(w) for _, w in s] for s in sparse], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [key, "dense", "indices", "values"])

    return tokens.mapInArrow(run, f"{key} {kind}, dense array<double>, indices array<string>, values array<double>")
