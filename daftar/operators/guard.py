"""Citation audit over tables of recorded answers.

context: conv_id, turn, chunk_id, law_name, article_number, citation_label: articles retrieved at a turn.
attempts: conv_id, turn, attempt, raw: recorded answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import arabic as A

ANSWER_KEY = ("conv_id", "turn", "attempt")
#: What stands for an answer whose attempts both failed; the wording is a parameter of decide().
FALLBACK = "لا يمكن تقديم إجابة موثقة من المواد المسترجعة"
# The pattern of an article named in a text, the reasons of a check, and the lines of a report.
INLINE = r"(?:ال)?ماد[ةه]\s*(?:رقم)?\s*[()]*\s*[0-9٠-٩۰-۹]+\s*[()]*(?:\s*مكرر)?"

NO_LABEL, NO_NUMBER, NOT_RETRIEVED = "no retrieved article matches this citation_label", "unparseable article_number", "article not retrieved in this conversation"
COUNTED, REVIEW = "citations: %d valid, %d hallucinated", "inline refs not in retrieved set (review-level): %d"


def snapshot(messages: DataFrame) -> DataFrame:
    """The context rows of messages with retrieved_context array<struct>."""
    return messages.select("conv_id", "turn", F.explode("retrieved_context").alias("c")).select("conv_id", "turn", "c.*")


def first_per_turn(calls: DataFrame) -> DataFrame:
    """Of repeated retrievals in one turn the first call's row stays."""
    order = W.partitionBy("conv_id", "turn", "chunk_id").orderBy("call_seq")
    return calls.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def allowed_numbers(context: DataFrame) -> DataFrame:
    """conv_id, law_key, number, since: an article counts as retrieved from its first turn on. So "retrieved so far" is a
    comparison after an equi-join, not a range join."""
    rows = context.where("article_number is not null").withColumn("law_key", A.normalize_law_name(F.col("law_name")))
    return rows.groupBy("conv_id", "law_key", F.col("article_number").alias("number")).agg(F.min("turn").alias("since"))


def allowed_labels(context: DataFrame) -> DataFrame:
    return context.groupBy("conv_id", "citation_label").agg(F.min("turn").alias("since"))


def parsed(attempts: DataFrame) -> DataFrame:
    """G1."""
    return attempts.withColumn("_a", A.parse_answer(F.col("raw"))).select(*attempts.columns, "_a.answer_text", "_a.citations")


def check_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """One row for each structured citation. Labels of numbered citations are not looked at."""
    c = answers.select(*ANSWER_KEY, F.posexplode("citations").alias("pos", "c")).select(*ANSWER_KEY, "pos", "c.*")
    c = c.withColumn("n", A.article_number(F.col("article_number"))).withColumn("law_key", A.normalize_law_name(F.col("law_name")))
    c = c.withColumn("number", F.col("n.number")).withColumn("label", F.coalesce("citation_label", F.lit(""))).withColumn("is_mukarrar", F.col("n.is_mukarrar")).drop("n")
    numbers = allowed_numbers(context).withColumnRenamed("since", "since_number")
    labels = allowed_labels(context).withColumnRenamed("since", "since_label").withColumnRenamed("citation_label", "label")
    c = c.join(numbers, ["conv_id", "law_key", "number"], "left").join(labels, ["conv_id", "label"], "left")
    no_number, unreadable = F.col("article_number").isNull(), F.col("article_number").isNotNull() & F.col("number").isNull()
    by_label = F.coalesce(F.col("since_label") <= F.col("turn"), F.lit(False))
    by_number = F.coalesce((F.col("since_number") <= F.col("turn")) & ~F.col("is_mukarrar"), F.lit(False))
    valid = F.when(no_number, by_label).when(unreadable, False).otherwise(by_number)
    reason = (
        F.when(valid, "").when(no_number, NO_LABEL).when(unreadable, NO_NUMBER).otherwise(NOT_RETRIEVED)
    )
    return c.select(*ANSWER_KEY, "pos", F.coalesce("law_name", F.lit("")).alias("law_name"), F.col("number").alias("article_number"), F.col("label").alias("citation_label"), valid.alias("is_valid"), reason.alias("reason"))


def inline_references(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Every article that a text mentions; verified if any law's article of that number was retrieved so far."""
    found = answers.select(*ANSWER_KEY, F.posexplode(F.regexp_extract_all("answer_text", F.lit(f"({INLINE})"), F.lit(1))).alias("pos", "raw_match"))
    found = found.withColumn("n", A.article_number(F.col("raw_match"))).where("n.number is not null").select(*ANSWER_KEY, "pos", "raw_match", F.col("n.number").alias("number"), "n.is_mukarrar")
    numbers = allowed_numbers(context).groupBy("conv_id", "number").agg(F.min("since").alias("since"))
    verified = F.coalesce((F.col("since") <= F.col("turn")) & ~F.col("is_mukarrar"), F.lit(False))
    return found.join(numbers, ["conv_id", "number"], "left").select(*ANSWER_KEY, "pos", "raw_match", "number", "is_mukarrar", verified.alias("is_verified"))


def verify(answers: DataFrame, context: DataFrame) -> DataFrame:
    """One row for each answer: counts, verdict (no hallucinated citation) and report. Inline findings don't fail it."""
    checks, inline = check_citations(answers, context), inline_references(answers, context)
    bad = F.concat(F.lit("  HALLUCINATED: law='"), "law_name", F.lit("' article="), F.coalesce(F.col("article_number").cast("string"), F.lit("None")), F.lit(" ("), "reason", F.lit(")"))
    soft = F.concat(F.lit("  UNVERIFIED INLINE: '"), "raw_match", F.lit("'"))

    def lines(test, text):
        listed = F.array_sort(F.collect_list(F.when(test, F.struct("pos", text.alias("line")))))
        return F.transform(listed, lambda x: x["line"])

    by_check = checks.groupBy(*ANSWER_KEY).agg(F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_hallucinated"), lines(~F.col("is_valid"), bad).alias("_bad"))
    by_inline = inline.groupBy(*ANSWER_KEY).agg(F.count_if(~F.col("is_verified")).alias("n_unverified_inline"), lines(~F.col("is_verified"), soft).alias("_soft"))
    rows = answers.select(*ANSWER_KEY, "answer_text", "citations").join(by_check, list(ANSWER_KEY), "left").join(by_inline, list(ANSWER_KEY), "left")
    rows = rows.fillna(0, ["n_valid", "n_hallucinated", "n_unverified_inline"])
    nothing = F.array().cast("array<string>")
    first = F.format_string(COUNTED, "n_valid", "n_hallucinated")
    second = F.when(F.col("n_unverified_inline") > 0, F.array(F.format_string(REVIEW, "n_unverified_inline"))).otherwise(nothing)
    report = F.array_join(F.concat(F.array(first), F.coalesce("_bad", nothing), second, F.coalesce("_soft", nothing)), "\n")
    return rows.select(*ANSWER_KEY, "answer_text", "citations", "n_valid", "n_hallucinated", "n_unverified_inline", (F.col("n_hallucinated") == 0).alias("is_valid"), report.alias("report"))


def decide(results: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """conv_id, turn, chosen_attempt (null: fallback), answer_text, used_fallback, n_hallucinated of the deciding attempt.
    The first valid of attempts 1 and 2 is taken."""
    tried = results.where("attempt in (1, 2)")
    valid = F.when(F.col("is_valid"), F.col("attempt"))
    grouped = tried.groupBy("conv_id", "turn").agg(
        F.min(valid).alias("chosen_attempt"), F.min_by("answer_text", valid).alias("_text"), F.max_by("n_hallucinated", "attempt").alias("_last"), F.min_by("n_hallucinated", valid).alias("_chosen")
    )
    failed = F.col("chosen_attempt").isNull()
    return grouped.select(
        "conv_id", "turn", "chosen_attempt", F.when(failed, fallback).otherwise(F.col("_text")).alias("answer_text"), failed.alias("used_fallback"), F.coalesce("_chosen", "_last").alias("n_hallucinated")
    )


def verified_citations(decisions: DataFrame, checks: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """The valid citations of each turn's chosen answer; none where the text is the fallback."""
    chosen = decisions.where(F.col("answer_text") != fallback).select("conv_id", "turn", F.col("chosen_attempt").alias("attempt"))
    return checks.where("is_valid").join(chosen, list(ANSWER_KEY)).select("conv_id", "turn", "pos", "law_name", "article_number", "citation_label")
