"""Quality, evaluation and monitoring (Q1-Q18)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import vectors as V

SCORES = ("hallucinated_citations_count", "citations_verified_count", "inline_unverified_count", "used_fallback")
LEVELS = ("division_number", "book_number", "part_number", "chapter_number", "section_number")


def guard_scores(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Q1: four rows for each trace (conv_id, turn): name, value, of the attempt that decided."""
    last = results.groupBy("conv_id", "turn").agg(F.max("attempt").alias("_last"))
    of = decisions.join(last, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce("chosen_attempt", "_last").alias("attempt"), "used_fallback")
    rows = results.join(of, ["conv_id", "turn", "attempt"]).select(
        "conv_id", "turn", F.col("n_hallucinated").cast("double").alias(SCORES[0]), F.col("n_valid").cast("double").alias(SCORES[1]), F.col("n_unverified_inline").cast("double").alias(SCORES[2]), F.col("used_fallback").cast("double").alias(SCORES[3])
    )
    return rows.unpivot(["conv_id", "turn"], list(SCORES), "name", "value")


def accept_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Q2: adds accepted: rating 0 or 1 on a trace (trace_id, user_id) of the same user."""
    owned = traces.select("trace_id", "user_id").distinct().withColumn("_ok", F.lit(True))
    joined = feedback.join(owned, ["trace_id", "user_id"], "left")
    return joined.withColumn("accepted", F.coalesce("_ok", F.lit(False)) & F.col("rating").isin(0, 1)).drop("_ok")


def rates(scores: DataFrame, *by: str) -> DataFrame:
    """Q3: mean of each score by the given columns and all their leading groups (rollup); null marks a total."""
    return scores.groupBy(*by, "trace").pivot("name", list(SCORES)).agg(F.first("value")).rollup(*by).agg(F.count("*").alias("n"), *(F.avg(s).alias(s) for s in SCORES))


def _cell(value: str) -> Column:
    """A coarse place of a number that never falls as the number grows: 512 to each factor of e. NaN is the largest, as in sorting."""
    v = F.col(value).cast("double")
    size = F.least(F.floor(F.least(F.log1p(F.abs(v) * 1000.0), F.lit(1e6)) * 512), F.lit(10**9))
    return F.when(F.isnan(v), F.lit(10**10)).otherwise(F.signum(v).cast("long") * size)


def index_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Q4: p50 and p95 at the indexes n // 2 and min(n - 1, int(0.95 n)) of the sorted values, and the mean.

    Selection in two passes: a histogram of every group (cells summed where rows lie) names the cells that hold the two indexes; of the
    values in those cells alone the distinct ones are counted and numbered. So no window holds a group's values, only its cells, or the
    values of two narrow ones.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(by).alias("g")).alias("_g"), F.col(value).alias("_v")).withColumn("_c", _cell("_v"))
    cells = known.groupBy("_g", "_c").agg(F.count("*").alias("n"), F.sum("_v").alias("_sum"))
    group = W.partitionBy("_g")
    placed = cells.withColumn("_until", F.sum("n").over(group.orderBy("_c"))).withColumn("_total", F.sum("n").over(group)).withColumn("_sum", F.sum("_sum").over(group))
    p95 = F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(0.95)))
    wanted = placed.withColumn("_i", F.explode(F.array(F.struct(F.lit("p50").alias("name"), F.floor(F.col("_total") / 2).alias("at")), F.struct(F.lit("p95").alias("name"), p95.alias("at")))))
    wanted = wanted.where((F.col("_i.at") < F.col("_until")) & (F.col("_i.at") >= F.col("_until") - F.col("n")))
    targets = wanted.select("_g", "_c", F.col("_i.name").alias("_name"), (F.col("_i.at") - F.col("_until") + F.col("n")).alias("_at"), "_total", "_sum")
    counts = known.join(targets.select("_g", "_c").distinct(), ["_g", "_c"], "left_semi").groupBy("_g", "_c", "_v").agg(F.count("*").alias("n"))
    numbered = counts.withColumn("_until", F.sum("n").over(W.partitionBy("_g", "_c").orderBy("_v")))
    found = numbered.join(targets, ["_g", "_c"]).where((F.col("_at") < F.col("_until")) & (F.col("_at") >= F.col("_until") - F.col("n")))
    one = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name)
    return found.groupBy(F.col("_g.g").alias(by)).agg(F.max("_total").alias("n"), one("p50"), one("p95"), (F.max("_sum") / F.max("_total")).alias("mean"))


def span_summary(spans: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Q5: for each trace the names it has, whether all required are there, and the largest latency of each required one."""
    grouped = spans.groupBy("trace_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n"), *(F.max(F.when(F.col("name") == r, F.col("latency_ms"))).alias(f"{r}_ms") for r in required))
    return grouped.withColumn("complete", F.forall(F.array(*map(F.lit, required)), lambda r: F.array_contains("names", r)))


def integrity(articles: DataFrame) -> DataFrame:
    """Q6: for each law total, distinct, least and largest number, missing and repeated ones, and whether it is complete.

    Missing numbers come from gaps between successive distinct numbers, so nothing of the whole range is built but the gaps.
    """
    counts = articles.where("article_number is not null").groupBy("law_number", "article_number").agg(F.count("*").alias("n"))
    before = F.lag("article_number").over(W.partitionBy("law_number").orderBy("article_number"))
    gaps = counts.withColumn("_b", before).withColumn("_gap", F.when(F.col("article_number") - F.col("_b") > 1, F.sequence(F.col("_b") + 1, F.col("article_number") - 1)))
    return gaps.groupBy("law_number").agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_numbers"), F.min("article_number").alias("least"), F.max("article_number").alias("largest"),
        F.array_sort(F.flatten(F.collect_list("_gap"))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("article_number")))).alias("repeated"),
    ).withColumn("is_complete", (F.size("missing") == 0) & (F.size("repeated") == 0))


def gap_ranges(articles: DataFrame, least: int = 1) -> DataFrame:
    """Q6: gaps of at least so many numbers as ranges."""
    numbers = articles.where("article_number is not null").select("law_number", "article_number").distinct()
    after = numbers.withColumn("_next", F.lead("article_number").over(W.partitionBy("law_number").orderBy("article_number")))
    return after.where(F.col("_next") - F.col("article_number") > least).select("law_number", (F.col("article_number") + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def hierarchy(articles: DataFrame) -> DataFrame:
    """Q7: for each node of the tree the span and count of its articles, descendants included. depth counts its levels."""
    levels = ("law_number", *LEVELS)
    grouped = articles.rollup(*levels).agg(F.grouping_id().alias("_g"), F.min("article_number").alias("least"), F.max("article_number").alias("largest"), F.count("*").alias("n"))
    depth = len(levels) - F.length(F.replace(F.bin("_g"), F.lit("0"), F.lit("")))
    return grouped.withColumn("depth", depth.cast("long")).drop("_g").where("depth > 0")


def structure_counts(articles: DataFrame) -> DataFrame:
    """Q8: distinct nodes by partial keys (the first names) and by full paths (with _full)."""
    some = lambda *c: F.when(F.col(c[-1]).isNotNull(), F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c)))
    n = lambda *c: F.count_distinct(some(*c))
    d, b, p, c, s = LEVELS
    kinds = {"substantive": "article_type = 'substantive'", "issuance": "article_type = 'issuance'", "repealed": "article_status = 'repealed'"}
    return articles.groupBy("law_number").agg(
        n(d).alias("divisions"), n(b).alias("books"), n(b, "part_kind", p).alias("parts"), n(b, p, c).alias("chapters"), n(c, s).alias("sections"), n(d, b, p, c, s).alias("sections_full"), n(d, b).alias("books_full"),
        F.count_distinct("subsection_title").alias("labels"), *(F.count_if(F.expr(e)).alias(k) for k, e in kinds.items()),
    )


def repealed_ranges(articles: DataFrame) -> DataFrame:
    """Q9: distinct ranges and how many rows name them."""
    return articles.where("repealed_range is not null").groupBy("law_number", "repealed_range").agg(F.count("*").alias("n"))


def preview_stats(articles: DataFrame) -> DataFrame:
    """Q10."""
    return articles.groupBy("law_number", "article_type").agg(F.count("*").alias("n"), F.min("article_number").alias("least"), F.max("article_number").alias("largest"), F.count_if(F.col("page_end") > F.col("page_start")).alias("over_pages"))


def evaluate(hits: DataFrame, expected: DataFrame, top_k: int = 5) -> DataFrame:
    """Q11: query_id, route, found_rank (null: none), hit. expected: query_id, route, expected (array of chunk ids)."""
    wanted = expected.select("query_id", F.explode("expected").alias("chunk_id"))
    found = hits.where(F.col("rank") <= top_k).join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("found_rank"))
    return expected.select("query_id", "route").join(found, "query_id", "left").withColumn("hit", F.col("found_rank").isNotNull())


def evaluate_groups(hits: DataFrame, asked: DataFrame, held: DataFrame, top_k: int = 5) -> DataFrame:
    """Q11 where a query's expected chunks are all of its group but its own: the same columns, and no list of expected chunks is made. asked:
    query_id, route, group, own; held: chunk_id, group, own. Queries of null groups, or alone in theirs, expect nothing and have no row."""
    groups = held.groupBy("group").agg(F.min("own").alias("_least"), F.max("own").alias("_largest"))
    asked = asked.join(groups, "group").where((F.col("_least") != F.col("own")) | (F.col("_largest") != F.col("own"))).select("query_id", "route", "group", "own").distinct()
    met = hits.where(F.col("rank") <= top_k).select("query_id", "chunk_id", "rank").join(held.select("chunk_id", F.col("group").alias("_group"), F.col("own").alias("_own")), "chunk_id")
    met = met.join(asked, "query_id").where((F.col("_group") == F.col("group")) & (F.col("_own") != F.col("own")))
    found = met.groupBy("query_id").agg(F.min("rank").alias("found_rank"))
    return asked.select("query_id", "route").distinct().join(found, "query_id", "left").withColumn("hit", F.col("found_rank").isNotNull())


def hit_rates(results: DataFrame) -> DataFrame:
    """Q11: hit rate by route and over all (null route)."""
    return results.rollup("route").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def embedding_consistency(stored: DataFrame, live: DataFrame, least_cosine: float = 0.999, least_overlap: float = 0.9) -> DataFrame:
    """Q13: chunk_id, cosine, overlap, passed. Both sides: chunk_id, dense, indices."""
    both = stored.alias("s").join(live.alias("l"), "chunk_id")
    both = both.select("chunk_id", V.cosine(F.col("s.dense"), F.col("l.dense")).alias("cosine"), V.overlap(F.col("s.indices"), F.col("l.indices")).alias("overlap"))
    return both.withColumn("passed", (F.col("cosine") >= least_cosine) & (F.col("overlap") >= least_overlap))


def compare_copies(source: DataFrame, copy: DataFrame, key: str, columns: tuple[str, ...], vector: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """Q14: key, status (equal, missing, extra, payload, vector) of every row of either side. Payloads compare null-safely by column."""
    left = source.select(key, F.struct(*columns).alias("_p"), F.lit(True).alias("_in"), *([F.col(vector).alias("_v")] if vector else []))
    right = copy.select(key, F.struct(*columns).alias("_q"), F.lit(True).alias("_out"), *([F.col(vector).alias("_w")] if vector else []))
    both = left.join(right, key, "full_outer")
    far = V.cosine(F.col("_v"), F.col("_w")) < 1 - tolerance if vector else F.lit(False)
    status = F.when(F.col("_out").isNull(), "missing").when(F.col("_in").isNull(), "extra").when(~F.col("_p").eqNullSafe(F.col("_q")), "payload").when(far, "vector").otherwise("equal")
    return both.select(key, status.alias("status"))


def bucket_digests(rows: DataFrame, key: str, columns: tuple[str, ...], buckets: int) -> DataFrame:
    """bucket, n, one, two: per bucket of the key its rows and two sums of their digests, whatever their order. Nulls count as values."""
    parts = [x for c in (key, *columns) for x in (F.col(c).isNull(), F.col(c))]
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), digest(1).alias("one"), digest(2).alias("two"))


def copy_differences(source: DataFrame, copy: DataFrame, key: str, columns: tuple[str, ...], vector: str | None = None, tolerance: float = 1e-4, buckets: int = 4_096) -> DataFrame:
    """Q14 for copies that mostly agree: key, status of the rows that are not equal.

    Both sides are digested by buckets of the key, where their rows lie; a row a bucket and task moves. Only rows of buckets whose counts
    or digests differ are joined (a bucket number is all that is broadcast, at most `buckets`), so equal copies cost two
    scans and no payload moves. Columns must be of one type on both sides. The digests are 128 bits of a hash that no one works against.
    """
    of = (*columns, *([vector] if vector else []))
    a, b = (bucket_digests(df, key, of, buckets) for df in (source, copy))
    same = a.alias("a").join(b.alias("b"), "bucket", "full_outer")
    unlike = same.where(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.one").eqNullSafe(F.col("b.one")) & F.col("a.two").eqNullSafe(F.col("b.two")))).select("bucket")
    unlike = F.broadcast(unlike.withColumnRenamed("bucket", "_bucket"))
    some = lambda df: df.join(unlike, F.pmod(F.xxhash64(df[key]), F.lit(buckets)) == F.col("_bucket"), "left_semi")
    return compare_copies(some(source), some(copy), key, columns, vector, tolerance).where("status <> 'equal'")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Q15: n rows by a seeded digest of the key, over all rows (the size is the operator); each task hands on n rows at most."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def event_order(events: DataFrame) -> DataFrame:
    """Q16: for each turn flags of what is out of order, and the tokens' text. events: turn_id, seq, event, data."""
    at = lambda e, f: f(F.when(F.col("event") == e, F.col("seq")))
    some = lambda e: F.count_if(F.col("event") == e)
    text = F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("seq", "data"))))
    g = events.groupBy("turn_id").agg(
        F.count("*").alias("n"), at("token", F.max).alias("_lt"), at("citations", F.min).alias("_fc"), at("done", F.max).alias("_d"), F.max("seq").alias("_l"),
        some("withdrawn").alias("_w"), some("citations").alias("_c"), some("error").alias("_e"), F.array_join(F.transform(text, lambda x: x["data"]), "").alias("text"),
    )
    return g.select(
        "turn_id", "n", F.coalesce(F.col("_lt") > F.col("_fc"), F.lit(False)).alias("token_after_citations"), F.coalesce(F.col("_d") != F.col("_l"), F.col("_e") == 0).alias("done_not_last"),
        ((F.col("_w") > 0) & (F.col("_c") > 0)).alias("withdrawn_with_citations"), ((F.col("_e") > 0) & (F.col("n") > 1)).alias("error_not_alone"), "text",
    )


def attempts_in_window(requests: DataFrame, seconds: int = 600) -> DataFrame:
    """Q17, simple form: adds n: attempts of the key in the trailing window, this one included, all counted."""
    at = F.unix_micros("ts")
    window = W.partitionBy("key").orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("n", F.count("*").over(window))


def independent_runs(requests: DataFrame, seconds: int) -> DataFrame:
    """key, id, ts, start: each key's attempts cut where none came for `seconds`, named by the run's first time. What is before a cut has left
    every window after it, so runs are decided apart.

    A key is looked through in slices of time, so one that has a third of all rows lies in many tasks; of each slice only its last
    attempt and last cut go to the later ones.
    """
    micros = seconds * 1_000_000
    rows = requests.select("key", "id", "ts", F.unix_micros("ts").alias("_t")).withColumn("_s", F.floor(F.col("_t") / (64 * micros)))
    inside, slices = W.partitionBy("key", "_s").orderBy("_t", "id"), W.partitionBy("key").orderBy("_s")
    ends = rows.groupBy("key", "_s").agg(F.max("_t").alias("_m")).withColumn("_before", F.lag("_m").over(slices)).select("key", "_s", "_before")
    met = lambda df, other, *names: df.join(other.select(F.col("key").alias("_k"), F.col("_s").alias("_z"), *names), F.col("key").eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_z")), "left").drop("_k", "_z")
    rows = met(rows, ends, "_before")
    before = F.coalesce(F.lag("_t").over(inside), "_before")
    rows = rows.withColumn("_cut", F.when(before.isNull() | (F.col("_t") - before >= micros), F.col("_t")))
    last = W.partitionBy("key").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    cuts = rows.groupBy("key", "_s").agg(F.max("_cut").alias("_x")).withColumn("_earlier", F.last("_x", ignorenulls=True).over(last))
    rows = met(rows, cuts, "_earlier")
    start = F.coalesce(F.last("_cut", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_earlier")
    return rows.select("key", "id", "ts", start.alias("start"))


def accept(times: Iterable[int], held: deque, limit: int, width: int) -> list[bool]:
    """Whether each time, in order, has under `limit` accepted ones in the window before it; held: the last accepted ones."""
    out = []
    for t in times:
        while held and t - held[0] >= width:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def rate_limited(requests: DataFrame, limit: int = 5, seconds: int = 600) -> DataFrame:
    """Q17, exact: adds accepted: under `limit` accepted attempts of the key in the trailing window; rejected ones don't count.

    The decision depends on each earlier one since the key last paused for a window's length. Keys are cut there, and each run passes a
    task in order, of which only the last `limit` accepted times are held.
    """
    kind = dict(requests.dtypes)

    def run(batches):
        now, held = None, deque()
        for b in batches:
            keys, starts, times = b.column("key").to_pylist(), b.column("start").to_pylist(), b.column("_t").to_pylist()
            out, i = [], 0
            for (key, start), group in groupby(zip(keys, starts, strict=True)):
                n = sum(1 for _ in group)
                if (key, start) != now:
                    now, held = (key, start), deque()
                out += accept(times[i : i + n], held, limit, seconds * 1_000_000)
                i += n
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("ts"), pa.array(out, pa.bool_())], ["key", "id", "ts", "accepted"])

    runs = independent_runs(requests, seconds).withColumn("_t", F.unix_micros("ts"))
    dealt = runs.repartition("key", "start").sortWithinPartitions("key", "start", "_t", "id")
    return dealt.mapInArrow(run, f"key {kind['key']}, id {kind['id']}, ts timestamp, accepted boolean")


def persistence_checks(messages: DataFrame, least: int) -> DataFrame:
    """Q18: for each conversation whether messages are in time order, enough, and assistants' contexts are there."""
    before = F.lag("created_at").over(W.partitionBy("conv_id").orderBy("pos"))
    rows = messages.withColumn("_late", F.coalesce(before > F.col("created_at"), F.lit(False)))
    return rows.groupBy("conv_id").agg((F.count_if("_late") == 0).alias("in_order"), (F.count("*") >= least).alias("enough"), (F.count_if((F.col("role") == "assistant") & F.col("trace_id").isNull()) == 0).alias("has_context"))


