"""Queries of chunk building (C1-C9) over article records derived from documents."""

from __future__ import annotations


from daftar.operators import chunks as C
from daftar.operators.laws import FEMININE, ORDINALS
from daftar.sources import pages as P

from . import duck_text as D
from .base import query
from .queries_text import RAW

LAWS = """SELECT CAST(174 AS INT) AS law_number, CAST(2025 AS INT) AS law_year, 'قانون الإجراءات الجنائية' AS law_name, 'feminine_ordinal' AS issuance_style
  UNION ALL SELECT 131, 1948, 'القانون المدني', 'cardinal'"""
ARTICLES = """SELECT CAST(CASE WHEN lang = 'en' THEN 174 ELSE 131 END AS INT) AS law_number, CASE WHEN doc_id % 50 = 0 THEN 'issuance' ELSE 'substantive' END AS article_type,
  CASE WHEN doc_id % 50 = 0 OR doc_id % 47 = 1 THEN NULL ELSE CAST(doc_id AS INT) END AS article_number, CASE WHEN doc_id % 50 = 0 THEN CAST(doc_id % 9 + 1 AS INT) END AS issuance_number, text AS body,
  CASE WHEN doc_id % 47 = 1 AND doc_id % 50 <> 0 THEN 'repealed' ELSE 'active' END AS article_status, CASE WHEN doc_id % 47 = 1 AND doc_id % 50 <> 0 THEN concat(CAST(doc_id * 20 AS STRING), '-', CAST(doc_id * 20 + 5 AS STRING)) END AS repealed_range,
  CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 4 AS INT) END AS division_number, CASE WHEN doc_id % 3 = 0 THEN concat('division ', lang) END AS division_title, CAST(doc_id % 22 AS INT) AS book_number, concat('book ', source) AS book_title,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS INT) END AS part_number, concat('part ', lang) AS part_title, CASE WHEN doc_id % 23 = 0 THEN 'preamble' ELSE 'normal' END AS part_kind,
  CASE WHEN doc_id % 7 < 4 THEN CAST(doc_id % 7 + 1 AS INT) END AS chapter_number, CASE WHEN doc_id % 7 < 4 THEN 'chapter' END AS chapter_title, CASE WHEN doc_id % 11 = 0 THEN CAST(doc_id % 13 + 1 AS INT) END AS section_number,
  CASE WHEN doc_id % 11 = 0 THEN 'section' END AS section_title, CASE WHEN doc_id % 13 = 0 THEN 'label' END AS subsection_title, CAST(doc_id % 30 AS INT) AS page_start, CAST(doc_id % 30 + doc_id % 3 AS INT) AS page_end,
  CAST(length(text) AS INT) AS char_count FROM {documents}"""
_AR = D.ascii_to_arabic
_LOW, _HIGH = "CAST(split_part(repealed_range, '-', 1) AS INT)", "CAST(split_part(repealed_range, '-', 2) AS INT)"
_RANGE_BODY = f"concat('ملغاة (ضمن المواد من ', {_AR(_LOW)}, ' إلى ', {_AR(_HIGH)}, ')')"


def expanded(articles: str) -> str:
    return f"""SELECT * FROM ({articles}) WHERE repealed_range IS NULL UNION ALL SELECT * EXCLUDE (n) REPLACE (CAST(n AS INT) AS article_number, {_RANGE_BODY} AS body, CAST(length({_RANGE_BODY}) AS INT) AS char_count)
  FROM (SELECT *, unnest(range({_LOW}, {_HIGH} + 1)) AS n FROM ({articles}) WHERE repealed_range IS NOT NULL)"""


EXPANDED = expanded(ARTICLES)


def _word(n: str, words: list[str]) -> str:
    return f"[{', '.join(map(D.q, words))}][{n}]"


_LABEL = f"CASE WHEN issuance_style = 'cardinal' THEN 'مادة ' || {_AR('issuance_number')} ELSE 'المادة ' || {_word('issuance_number', FEMININE)} END"
_LAW_LINE = f"law_name || ' رقم (' || {_AR('law_number')} || ') لسنة (' || {_AR('law_year')} || ')'"


def _level(name: str, word: str) -> str:
    line = f"CASE WHEN {name}_number BETWEEN 1 AND 20 THEN '{word} ' || {_word(name + '_number', ORDINALS)} || ': ' || coalesce({name}_title, '') END"
    return f"CASE WHEN part_kind = 'preamble' THEN 'الباب التمهيدي: ' || coalesce(part_title, '') ELSE {line} END" if name == "part" else line


_HEADER = f"""CASE WHEN article_type = 'issuance' THEN concat_ws(chr(10), {_LAW_LINE}, 'من مواد الإصدار', {_LABEL}) ELSE concat_ws(chr(10), {_LAW_LINE}, {", ".join(_level(*x) for x in C.LEVELS)},
  CASE WHEN section_number <> 0 THEN {_AR("section_number")} || '- ' || coalesce(section_title, '') END, nullif(subsection_title, ''), 'مادة (' || {_AR("article_number")} || ')') END"""
_NAME = f"law_name || ' رقم ' || {_AR('law_number')} || ' لسنة ' || {_AR('law_year')}"
_CITE = f"CASE WHEN article_type = 'issuance' THEN {_LABEL} || ' من مواد إصدار ' || {_NAME} ELSE 'المادة (' || {_AR('article_number')} || ') من ' || {_NAME} || CASE WHEN part_kind = 'preamble' THEN ' (الباب التمهيدي)' ELSE '' END END"
_ID = "concat_ws('-', law_number, law_year, CASE WHEN article_type = 'issuance' THEN concat_ws('-', 'issuance', issuance_number) ELSE concat_ws('-', 'art', article_number) END)"


def chunks_of(rows: str, laws: str) -> str:
    return f"""SELECT *, header || chr(10) || chr(10) || body AS text_for_display, {D.normalize("header || chr(10) || body")} AS text_for_embedding, CAST(round_even(char_count / 1.8, 0) AS BIGINT) AS approx_tokens
  FROM (SELECT *, {_HEADER} AS header, {_CITE} AS citation_label, {_ID} AS chunk_id FROM ({rows}) JOIN ({laws}) USING (law_number))"""


CHUNKS = chunks_of(EXPANDED, LAWS)


def _chunks(t):
    return C.build_chunks(t.sql(ARTICLES), t.sql(LAWS))


@query(f"SELECT law_number, article_number, issuance_number, body, char_count, repealed_range FROM ({EXPANDED})")
def c1_expand_repealed(t):
    """C1."""
    return C.expand_repealed(t.sql(ARTICLES)).select("law_number", "article_number", "issuance_number", "body", "char_count", "repealed_range")


@query(f"SELECT chunk_id, header FROM ({CHUNKS})")
def c2_header(t):
    """C2."""
    return _chunks(t).select("chunk_id", "header")


@query(f"SELECT chunk_id, citation_label FROM ({CHUNKS})")
def c3_citation(t):
    """C3 and C4."""
    return _chunks(t).select("chunk_id", "citation_label")


@query(f"SELECT chunk_id, issuance_number, {_LABEL} AS label FROM ({CHUNKS}) WHERE article_type = 'issuance'")
def c4_issuance_label(t):
    """C4."""
    return _chunks(t).where("article_type = 'issuance'").select("chunk_id", "issuance_number", C.issuance_label().alias("label"))


@query(f"SELECT chunk_id, text_for_display, text_for_embedding FROM ({CHUNKS})")
def c6_dual_text(t):
    """C5 and C6."""
    return _chunks(t).select("chunk_id", "text_for_display", "text_for_embedding")


_META = "law_name law_number law_year article_type article_number issuance_number article_status repealed_range division_number division_title book_number book_title part_number part_title part_kind chapter_number chapter_title section_number section_title subsection_title page_start page_end char_count approx_tokens".split()


@query(f"SELECT chunk_id, {', '.join(_META)} FROM ({CHUNKS})")
def c7_metadata(t):
    """C7."""
    return _chunks(t).select("chunk_id", *_META)


@query(f"SELECT chunk_id, header, citation_label, body AS body_faithful, text_for_display, text_for_embedding, approx_tokens FROM ({CHUNKS})")
def c8_build_chunks(t):
    """C8."""
    return _chunks(t).select("chunk_id", "header", "citation_label", "body_faithful", "text_for_display", "text_for_embedding", "approx_tokens")


@query(
    f"""SELECT law_number, count(*) AS n, count(*) FILTER (article_type = 'substantive') AS substantive, count(*) FILTER (article_type = 'issuance') AS issuance, count(*) FILTER (article_status = 'repealed') AS repealed,
    max(approx_tokens) AS most_tokens, arg_max(chunk_id, (char_count, chunk_id)) AS longest_chunk FROM ({CHUNKS}) GROUP BY law_number"""
)
def c9_build_summary(t):
    """C9."""
    return C.summary(_chunks(t))


@query(
    f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(raw, '[{D.A.TOKEN_LETTERS}]+')) AS token FROM ({RAW})) WHERE contains(token, 'آ') AND token NOT IN ({', '.join(map(D.q, D.A.KEEP_MADDA + D.A.MADDA_TO_ALEF))}) GROUP BY token ORDER BY n DESC, token LIMIT 10"
)
def c9_top_tokens(t):
    """The ten most frequent unreviewed tokens (the limit is the report)."""
    return C.top_tokens(P.unreviewed_tokens(t.sql(RAW), "raw", D.A.KEEP_MADDA + D.A.MADDA_TO_ALEF))
