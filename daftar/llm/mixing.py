"""Operator 11: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; a source's documents lie in the order of their keys, so
better ones tend to come first. The source's target is met by complete epochs of all its documents and, for what is left, by the
first documents of that order, up to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import doc_columns, materialise, running

#: White space that parts words, as a class of a pattern.
SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 1/16 to 17/16: the squared share of letters (all that is no ASCII control, digit or sign) in what is no space."""
    solid = F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    share = F.when(solid > 0, letters / solid).otherwise(0.0)
    return F.coalesce(share * share, F.lit(0.0)) + 0.0625


def sample_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """An exponential variate of rate `weight`, fixed by seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(unit) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, budget: int | None = None) -> DataFrame:
    """sizes (source, source_size; one row a source) with source_rank (from 0 by code point, null last), target.

    Targets share the budget (default: all sizes) by the weights, which repeat along source_rank. A target stops at `most` times its
    source's size and the excess goes to the others by weight, until none is above (all stop, where the budget exceeds that). One window over
    the sources finds the level: in the order of size a weight, a source stops while its limit is below its share of what earlier ones
    leave.
    """
    ranked = sizes.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * most)
    line = W.orderBy(F.col("_limit") / F.col("_w"), "source_rank")
    before, ahead = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(0, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.partitionBy()) if budget is None else F.lit(budget)
    level = (everything - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_w").over(ahead)
    rows = rows.withColumn("_level", level)
    final = F.min(F.when(F.col("_limit") > F.col("_level") * F.col("_w"), F.struct(F.col("_limit") / F.col("_w"), "source_rank", "_level"))).over(W.partitionBy())
    open_ = F.coalesce(F.col("_limit") / F.col("_w") >= final["col1"], F.lit(False))
    return rows.withColumn("target", F.when(open_, F.least(final["_level"] * F.col("_w"), F.col("_limit").cast("double"))).otherwise(F.col("_limit").cast("double"))).drop("_w", "_limit", "_level")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, budget: int | None = None, weight: Column | None = None, seed: int = 11, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How many words the mixture takes of each row of docs (doc_id, text, source): the columns of `keep`, then size, source_size,
    target, taken, source, key, epochs, rank_before (the words of its source before it in the sample's order).

    weight: a positive column of docs, else `quality` of the text. A source takes floor(target / source_size) complete epochs, then
    documents in the order of their keys; the one in which the target ends gives its first words only, so a source's taken words equal its
    target rounded. Ties of the key follow doc_id (nulls first), then size; equal rows take as they lie, which no other column tells. A null
    text has size 0 and takes 0; a null source is a source of its own; ids may repeat or be null. A source without words has target 0.
    An empty table gives no rows. Sources are few (a table of the mixture); documents are sorted by range, so a source of any size
    lies in many tasks, and neither texts nor keys pass through one.
    """
    given = docs.select(F.struct(*(docs[c] for c in keep)).alias("_row"), docs["doc_id"].cast("long").alias("_id"), docs["text"].alias("_text"), docs["source"].cast("string").alias("source"), (quality(docs["text"]) if weight is None else weight).alias("_weight"))
    rows = materialise(given.select("_row", "_id", "source", words(F.col("_text")).alias("size"), sample_key(F.col("_id"), F.col("_text"), F.col("_weight"), seed).alias("key")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, budget)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialise(targets.withColumn("epochs", epochs).withColumn("_rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    named = targets.select(F.col("source").alias("_source"), "source_rank", "source_size", "target", "epochs", "_rest")
    if targets.count() <= 100_000:
        named = F.broadcast(named)
    met = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("source_rank", F.col("source_rank").cast("long"))
    placed = running(met, ["source_rank"], ["key", "_id", "size"], "size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    return placed.select("_row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source", "key", "epochs", F.col("before").alias("rank_before"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: doc_id, source, epoch (from 0), key, text. A text comes once for each epoch that takes it, the last time
    possibly cut after the words that are taken. Options as of `mix`. Texts travel with their rows through the sort by key."""
    taken = mix(doc_columns(docs, "doc_id", "text", "source"), keep=("doc_id", "text"), **options).where("taken > 0")
    left = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs") + F.when(left > 0, 1).otherwise(0)
    each = taken.withColumn("_left", left).withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    cut = F.regexp_extract("text", f"^[{SPACE}]*", 0)
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0)), 1, F.col("_left").cast("int")), "")
    text = F.when((F.col("epoch") < F.col("epochs")) | (F.col("_left") == F.col("size")), F.col("text")).otherwise(F.concat(cut, some))
    return each.select("doc_id", "source", "epoch", "key", text.alias("text"))


def mix_sql(seed: int = 11) -> str:
    """The query's rows in DuckDB's SQL."""
    return rf"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters,
         (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS unit FROM documents),
k AS (SELECT *, -ln(unit) / (CASE WHEN solid > 0 THEN (letters / solid) * (letters / solid) ELSE 0.0 END + 0.0625) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][(r % 3 + 1)::INT] AS w, 3 * source_size AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
             / (sum(w) OVER (ORDER BY most / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, (most / w, r)) AS level, min((most / w, r)) AS at FROM l WHERE most > level * w),
t AS (SELECT l.source, source_size, CASE WHEN f.at IS NOT NULL AND most / w >= struct_extract(f.at, 1) THEN least(f.level * w, most::DOUBLE) ELSE most::DOUBLE END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest, k.source, k.key,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - before)) AS taken FROM p"""
