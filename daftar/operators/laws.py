"""The laws that are known by number and year, and what their names and article labels look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import arabic as A

# Name, number, year, style of the enacting articles' labels.
LAWS = (("قانون الإجراءات الجنائية", 174, 2025, "feminine_ordinal"), ("القانون المدني", 131, 1948, "cardinal"))
# Ordinal words from 1 on, masculine and feminine.
ORDINALS = (
    "الأول,الثاني,الثالث,الرابع,الخامس,السادس,السابع,الثامن,التاسع,العاشر,الحادي عشر,الثاني عشر,الثالث عشر,الرابع عشر,الخامس عشر,السادس عشر,السابع عشر,الثامن عشر,التاسع عشر,العشرون"
).split(",")
FEMININE = "الأولى,الثانية,الثالثة,الرابعة,الخامسة,السادسة,السابعة,الثامنة,التاسعة,العاشرة".split(",")


def laws_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAWS), "law_name string, law_number int, law_year int, issuance_style string")


def _folded(word: str) -> str:
    return word.translate(str.maketrans("أإآٱى", "ااااي"))


ORDINAL_NUMBERS = {_folded(w): i for i, w in enumerate(ORDINALS, 1)}
FEMININE_NUMBERS = {_folded(w): i for i, w in enumerate(FEMININE, 1)}


def alternation(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def lookup(c: Column, table: dict[str, int]) -> Column:
    """L4: a folded ordinal word's number, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def ordinal_word(c: Column, words: list[str]) -> Column:
    """The word of a number; null beyond the list."""
    return F.get(F.array(*map(F.lit, words)), c.cast("int") - 1)


def numbered_name(name: Column, number: Column, year: Column) -> Column:
    return F.concat(name, F.lit(" رقم "), A.ascii_to_arabic(number), F.lit(" لسنة "), A.ascii_to_arabic(year))


def canonical_law_names(rows: DataFrame, payload: str) -> DataFrame:
    """Adds law_name and is_known. Rows that are neither known nor named get a null name."""
    known = F.broadcast(laws_table(rows.sparkSession).select(F.col("law_name").alias("_known"), "law_number", "law_year"))
    joined = rows.join(known, ["law_number", "law_year"], "left")
    name = numbered_name(F.coalesce("_known", F.nullif(F.col(payload), F.lit(""))), F.col("law_number"), F.col("law_year"))
    return joined.withColumn("law_name", name).withColumn("is_known", F.col("_known").isNotNull()).drop("_known")
