"""Literal cases of Arabic text."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from daftar.functions import arabic as A
from daftar.operators import retrieval as R
from daftar.sources import stores as S


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "x string").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (A.space_boundaries, "٥٤مكرر", "٥٤ مكرر"),
        (A.space_boundaries, "المادة٣٠٨", "المادة ٣٠٨"),
        (A.space_boundaries, "العمد،ومشايخ", "العمد، ومشايخ"),
        (A.space_boundaries, "٤ب٣", "٤ ب ٣"),
        (A.reattach, "نافذ ًا", "نافذًا"),
        (A.normalize_for_match, "الأول", "الاول"),
        (A.repair_pua, "ا", "اًلمج"),
        (A.format_clause_structure, ") أ ( نص", "(أ) نص"),
        (A.format_clause_structure, ") (2", "(2)"),
        (A.format_clause_structure, "هي: .١ أعضاء", "هي:\n١- أعضاء"),
        (A.format_clause_structure, ".١ أعضاء", "١- أعضاء"),
        (A.format_clause_structure, "نص. - بند: - ثان", "نص.\n- بند:\n- ثان"),
        (A.format_clause_structure, "نص. (أولًا) بند", "نص.\n(أولًا) بند"),
        (A.repair_glyphs, "آان المحاآم آخر بآي", "كان المحاكم آخر باي"),
        (A.collapse, " a\t b \n\n\n\n c \n", "a b\n\nc"),
        (A.nfkc, "ﻻ x", unicodedata.normalize("NFKC", "ﻻ x")),
        (A.normalize_law_name, "القانون  المدنىّ ـ", "القانون المدنيّ"),
        (A.strip_code_fence, "```json\n{}\n```", "{}"),
        (A.content_text, '["a", {"type": "text", "text": "b"}, {"type": "x"}]', "ab"),
        (A.preview, "a " * 200, ("a " * 119).strip() + " …"),
    ],
)
def test_literal(spark, function, given, wanted):
    assert one(spark, function, given) == wanted


def test_article_number(spark):
    found = [tuple(one(spark, A.article_number, x)) for x in ("163", "163 مكرر", "١٦٣", "none")]
    assert found == [(163, False), (163, True), (163, False), (None, False)]


def test_answer_that_is_no_object_stays_raw(spark):
    for raw in ("garbage", "5", "[]", ""):
        got = one(spark, A.parse_answer, raw)
        assert (got["answer_text"], got["citations"]) == (raw, [])
    got = one(spark, A.parse_answer, '{"answer_text": "x", "citations": [{"law_name": "a", "article_number": 5, "citation_label": "l"}]}')
    assert got["citations"][0]["article_number"] == "5"


def test_reference(spark):
    found = one(spark, R.article_reference, "المادة 5 من القانون المدني")
    assert tuple(found) == (5, "substantive", 131, 1948)
    assert tuple(one(spark, R.article_reference, "المادة الثانية"))[:2] == (2, "issuance")
    assert one(spark, R.article_reference, "ما هي العقوبة")["number"] is None


def test_normalisation_is_idempotent(spark):
    text = "ﻻ أإآ  ٥٤مكرر ـ\n\n\n\n نافذ ًا"
    for f in (A.clean_text, A.normalize_for_embedding, A.normalize_law_name):
        once = one(spark, f, text)
        assert one(spark, f, once) == once


def test_point_id_is_a_version_5_uuid(spark):
    assert one(spark, S.point_id, "174-2025-art-5") == str(uuid.uuid5(uuid.UUID(S.NAMESPACE), "174-2025-art-5"))
