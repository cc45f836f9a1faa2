"""Operator 7: approximate nearest neighbours by additive quantisation, then exact reranking.

A vector is the sum of one word from each of several codebooks of full dimension. Books are fitted to the residuals of a bounded
sample; codes come by beam search; the norm of the sum is stored. A query meets codes through a table of its products with all
words: the sum of the looked-up products over the stored norm approximates the cosine. The best by that, one list for each query
over all rows, are scored exactly. Only codes and norms meet all queries; vectors move to the queries whose lists they are in.

The angle between a vector and its sum is stored too: no vector is nearer to a query than the angle between query and sum less that
angle. Where this bound lets a row outside the lists be among the nearest, the row is scored exactly as well, so results are those of
scoring every pair, however well the codes fit the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import hash_sample, materialise


#: Bytes of a block's vectors in double precision, at most; the entry of the row that stands for all that are not listed.
BLOCK_BYTES, NOT_LISTED = 64 << 20, np.int64(0)


def fit_codebooks(sample: np.ndarray, books: int, words: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimension): k-means on what the books before leave of the sample."""
    rng, residual, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        k = min(words, len(residual))
        book = residual[rng.choice(len(residual), k, replace=False)].copy()
        for _ in range(rounds):
            nearest = (residual @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            sums, counts = np.zeros_like(book), np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, residual)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        residual -= book[(residual @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
        out.append(np.pad(book, ((0, words - k), (0, 0)), constant_values=1e9))
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) and norms of the sums. Beam search: the `beam` best partial sums go on from book to book."""
    n = len(x)
    codes, sums = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, x.shape[1]), np.float32)
    for book in books:
        residual = x[:, None, :] - sums
        error = (residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        from_, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, from_], word[:, :, None].astype(np.uint8)], axis=2)
        sums = sums[rows, from_] + book[word]
    last = ((x[:, None, :] - sums) ** 2).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, last], np.sqrt((sums[rows, last] ** 2).sum(1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part: neither null nor zero nor with null or non-finite components, of the dimension that most
    of those have (of two as common, the larger); of several vectors of one vec_id the least."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null").where(ok)
    dimension = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (dimension["d"] if dimension else 0))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def strays(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The sine of the angle between each unit row and the sum of its words, rounded up; 2 from a right angle on."""
    sums = np.zeros(x.shape)
    for m, book in enumerate(books):
        sums += book[codes[:, m]]
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    along = (x * sums).sum(1, keepdims=True)
    return np.where(along[:, 0] > 0, np.linalg.norm(x - along * sums, axis=1) + 1e-6, 2).astype(np.float32)


def largest(near: np.ndarray, stray: np.ndarray) -> np.ndarray:
    """The largest cosine that an entry (row) can have with a query (column): the angles' difference, with room for single precision."""
    sine = np.minimum(stray, 1)[:, None]
    cosine = np.sqrt(1 - sine * sine)
    b = np.clip(near + np.float32(1e-5), -1, 1)
    return np.where((b >= cosine) | (stray[:, None] > 1), np.float32(1), b * cosine + np.sqrt(1 - b * b) * sine + np.float32(1e-6))


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, books: int = 24, words: int = 256, beam: int = 4, rerank: int = 128, fit_rows: int = 8_192, block_rows: int = 131_072, query_rows: int = 4_096, whole: bool = False
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by `every`, the k rows of largest cosine but itself.

    vectors: vec_id, embedding. The books are fitted to at most fit_rows rows chosen by a hash; every row is encoded. Equal vectors
    are one entry of the index, that of their smallest id, and stand for their k + 1 smallest ids, the most that can be in a
    result; queries with equal vectors are one search. Searches and entries are dealt into blocks of query_rows and block_rows on
    average (smaller where the table is small); a pair of blocks is one task's work and finds `rerank` entries for each search by
    lookup tables. The `rerank` best of all blocks are scored exactly in double precision; ties go to the smaller vec_id. Fewer
    than k candidates give fewer rows; rows that take no part (see `usable`), as queries too, give none.

    whole: every entry that its bound (see `largest`) lets be among a search's nearest is scored exactly too. A block's vectors then
    come to the searches that its bounds leave open, and k + 1 rows a search and block leave it; blocks are smaller where vectors are long.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    sample = hash_sample(rows, fit_rows, "vec_id").toPandas()
    if not len(sample):
        return spark.createDataFrame([], schema)
    fitted = np.stack(sample["v"].to_numpy()).astype(np.float64)
    fitted = (fitted / np.linalg.norm(fitted, axis=1, keepdims=True)).astype(np.float32)
    shared = spark.sparkContext.broadcast(fit_codebooks(fitted, books, words))

    def index(it):
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                codes, norms = encode(_matrix(part.column(3)).astype(np.float32), shared.value, beam)
                stray = strays(_matrix(part.column(3)), codes, shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(stray)], ["vec_id", "h", "g", "code", "norm", "stray"])

    # two 64-bit hashes name a vector, so that equal ones meet without moving
    named = rows.select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("second"), "v").alias("g"), "v")
    encoded = materialise(named.mapInArrow(index, "vec_id long, h long, g long, code binary, norm float, stray float"))
    entries = materialise(encoded.groupBy("h", "g").agg(F.min(F.struct("vec_id", "code", "norm", "stray")).alias("e")).select("h", "g", F.col("e.vec_id").alias("entry"), "e.code", "e.norm", "e.stray"))
    place = F.row_number().over(W.partitionBy("h", "g").orderBy("vec_id"))
    least = encoded.select("h", "g", "vec_id").withColumn("i", place).where(F.col("i") <= k + 1).groupBy("h", "g").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("entry"))
    queries = materialise(encoded.where(F.col("vec_id") % every == 0).select("h", "g", F.col("vec_id").alias("query_id")).join(entries.select("h", "g", "entry"), ["h", "g"]).select("query_id", F.col("entry").alias("ask")))
    asks = materialise(queries.select("ask").distinct().join(rows, F.col("ask") == F.col("vec_id")).select("ask", "v"))

    n, n_asks = entries.count(), asks.count()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * fitted.shape[1])))
    n_blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, -(-n // 4_096)))
    n_parts = max(1, -(-n_asks // query_rows))
    deal = lambda c, m: F.pmod(F.xxhash64(c, F.lit(c)), F.lit(m)).cast("int")
    dealt = entries.select("entry", "code", "norm", "stray").withColumn("block", deal("entry", n_blocks))
    left = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    asks_dealt = asks.withColumn("part", deal("ask", n_parts))
    right = asks_dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def looked_up(rows: pa.Table, q: np.ndarray):
        """Parts of the queries with their approximate cosines to all rows, by the tables."""
        norms = np.maximum(rows.column("norm").to_numpy(), 1e-6)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        for start in range(0, len(q), 128):
            tables = np.einsum("mwd,qd->mwq", shared.value, q[start : start + 128].astype(np.float32))
            near = np.zeros((rows.num_rows, tables.shape[2]), np.float32)
            for m, t in enumerate(tables):
                near += t[codes[:, m]]
            near /= norms[:, None]
            yield start, near

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.float32)], [np.empty(0, np.float32)]]
        if rows.num_rows and asked.num_rows:
            ids, stray, block = rows.column("entry").to_numpy(), rows.column("stray").to_numpy(), rows.column("block")[0].as_py()
            q_ids, q = asked.column("ask").to_numpy(), _matrix(asked.column("v"))
            take = min(rerank, len(ids))
            for start, near in looked_up(rows, q):
                best = np.argpartition(-near, take - 1, axis=0)[:take]
                few, columns = np.take_along_axis(near, best, 0), np.arange(near.shape[1])
                found[0].append(np.repeat(q_ids[start : start + 128], take))
                found[1].append(ids[best.T.reshape(-1)])
                found[3].append(few.T.reshape(-1))
                if whole:
                    found[4].append(np.stack([largest(few[:, [i]], stray[best[:, i]])[:, 0] for i in columns]).reshape(-1))
                    np.put_along_axis(near, best, -np.inf, 0)  # one row with the largest bound of all that are not listed
                    rest = np.full(near.shape[1], -np.inf, np.float32)
                    for at in range(0, len(ids) if take < len(ids) else 0, 8_192):
                        part = near[at : at + 8_192]
                        rest = np.maximum(rest, np.where(part == -np.inf, part, largest(part, stray[at : at + 8_192])).max(0))
                    found[0].append(q_ids[start : start + 128])
                    found[1].append(np.full(len(rest), NOT_LISTED))
                    found[3].append(np.full(len(rest), -np.inf, np.float32))
                    found[4].append(rest)
                else:
                    found[4].append(found[3][-1])
            found[2].append(np.full(sum(map(len, found[0])), block, np.int32))
        return pa.table({c: np.concatenate(x) for c, x in zip(("ask", "entry", "block", "near", "most"), found, strict=True)})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "ask long, entry long, block int, near float, most float")
    met = materialise(met) if whole else met  # read for the lists and for what they leave open
    by_near = W.partitionBy("ask").orderBy(F.desc("near"), "entry")
    placed = met.where(F.col("near") > float("-inf")).withColumn("i", F.row_number().over(by_near))
    listed = placed.where(F.col("i") <= rerank).select("ask", "entry")
    listed = listed.where("ask <> entry").unionByName(asks.select("ask", F.col("ask").alias("entry")))  # its own copies always

    def exact(it):
        for b in it:
            if b.num_rows:
                score = (_matrix(b.column(2)) * _matrix(b.column(3))).sum(1)  # summed in one order for every pair
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["ask", "entry", "score"])

    def scores(pairs: DataFrame) -> DataFrame:
        finalists = pairs.join(rows.withColumnRenamed("vec_id", "entry"), "entry").join(asks.withColumnRenamed("v", "w"), "ask").select("ask", "entry", "v", "w")
        return finalists.mapInArrow(exact, "ask long, entry long, score double")

    def nearest(scored: DataFrame) -> DataFrame:
        """ask, score, vec_id, i: the k + 1 first ids of each search."""
        by_score = W.partitionBy("ask").orderBy(F.desc("score"), "entry")
        best = scored.withColumn("i", F.row_number().over(by_score)).where(F.col("i") <= k + 1)
        ids = best.join(least.select("entry", "ids"), "entry").select("ask", "score", F.explode("ids").alias("vec_id"))
        by_id = W.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        return ids.withColumn("i", F.row_number().over(by_id)).where(F.col("i") <= k + 1)

    def visit(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The k + 1 best of a block's entries for each search, of those that their bounds leave open."""
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if rows.num_rows and asked.num_rows:
            ids, stray, x = rows.column("entry").to_numpy(), rows.column("stray").to_numpy(), _matrix(rows.column("v"))
            q_ids, q, reach = asked.column("ask").to_numpy(), _matrix(asked.column("v")), asked.column("reach").to_numpy()
            for start, near in looked_up(rows, q):
                part = range(start, start + near.shape[1])
                maybe = [largest(near[at : at + 8_192], stray[at : at + 8_192]) >= reach[start : part.stop] for at in range(0, len(ids), 8_192)]
                maybe = np.concatenate(maybe)
                for i in part:
                    of = np.flatnonzero(maybe[:, i - start])
                    score = np.concatenate([np.empty(0), *((x[of[at : at + 8_192]] * q[i]).sum(1) for at in range(0, len(of), 8_192))])
                    if len(of) > k + 1:  # all that tie with the last one come into the choice
                        few = score >= np.partition(score, len(of) - k - 1)[len(of) - k - 1]
                        of, score = of[few], score[few]
                    order = np.lexsort((ids[of], -score))[: k + 1]
                    found[0].append(np.full(len(order), q_ids[i])), found[1].append(ids[of[order]]), found[2].append(score[order])
        return pa.table({c: np.concatenate(x) for c, x in zip(("ask", "entry", "score"), found, strict=True)})

    scored = scores(listed)
    if whole:
        scored = materialise(scored)
        reached = nearest(scored).groupBy("ask").agg(F.when(F.count("*") == k + 1, F.min("score")).otherwise(-2.0).alias("reach"))
        reached = materialise(reached)
        late = placed.where(F.col("i") > rerank).join(reached, "ask").where("most >= reach and ask <> entry").select("ask", "entry")
        pairs = materialise(met.where(F.col("near") == float("-inf")).join(reached, "ask").where("most >= reach").select("ask", "block", "reach"))
        sides = asks_dealt.join(pairs, "ask")
        wanted = sides.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
        held = dealt.join(rows.withColumnRenamed("vec_id", "entry"), "entry").join(F.broadcast(wanted), "block")  # a row for each pair of blocks
        visited = held.groupBy("block", "part").cogroup(sides.groupBy("block", "part")).applyInArrow(visit, "ask long, entry long, score double")
        every_score = scored.unionByName(scores(late))
        if not pairs.isEmpty():
            every_score = every_score.unionByName(visited)
        scored = every_score.groupBy("ask", "entry").agg(F.max("score").alias("score"))  # of listed ones that a visit found again, one
    ids = nearest(scored)
    answers = ids.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id", "score"))).alias("found"))  # k + 1 a search
    own = queries.join(answers, "ask").select("query_id", F.slice(F.expr("filter(found, x -> x.vec_id <> query_id)"), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
