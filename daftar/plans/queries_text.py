"""Queries of the sources and of text normalisation (S1-S3, S8, T1-T18) over texts derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.functions import arabic as A
from daftar.sources import pages as P

from . import duck_text as D
from .base import query

#: Latin letters become Arabic ones, so that marks, glyphs, digits and punctuation fall beside letters and spaces.
_FROM = "abcdefghijklmnopqrstuvwxyz"
_TO = "\u0622\u0628\ue823\u062f\u0629\u200f\u0640\u0649\u064a\u06a9\u0643\u0644\u0645\u0646\u0623\u060c\u0642\u0631\u0633\u062a\u064f\ue123\u0648\u0664\u0663\uf001"
RAW = f"SELECT doc_id, translate(lower(text), '{_FROM}', '{_TO}') AS raw FROM {{documents}}"


def _text_query(name: str, spark_function, duck_function, out: str = "cleaned"):
    def run(t):
        return t.sql(RAW).select("doc_id", spark_function(F.col("raw")).alias(out))

    run.__name__, run.__doc__ = name, spark_function.__doc__
    query(f"SELECT doc_id, {duck_function('raw')} AS {out} FROM ({RAW})" if duck_function else None)(run)


_text_query("t1_repair_pua", A.repair_pua, D.repair_pua)
_text_query("t2_nfkc", A.nfkc, None)
_text_query("t3_strip_directional", A.strip_directional, D.strip_directional)
_text_query("t4_reattach_marks", A.reattach, D.reattach)
_text_query("t5_boundary_spacing", A.space_boundaries, D.space_boundaries)
_text_query("t6_collapse_whitespace", A.collapse, D.collapse)
_text_query("t7_clean_text", A.clean_text, None)
_text_query("t7_clean_text_without_nfkc", lambda c: A.clean_text(c, with_nfkc=False), D.clean_text)
_text_query("t8_normalize_for_embedding", A.normalize_for_embedding, D.normalize)
_text_query("t9_normalize_for_match", A.normalize_for_match, D.normalize)
_text_query("t11_format_clauses", lambda c: A.format_clause_structure(F.translate(c, "أم", ")(")), lambda x: D.format_clause_structure(D.tr(x, "أم", ")(")))
_text_query("t12_repair_glyphs", A.repair_glyphs, D.repair_glyphs)
_text_query("t13_normalize_law_name", A.normalize_law_name, D.law_name)
_text_query("t18_preview", A.preview, D.preview)


@query(f"SELECT doc_id, {D.digits_to_ascii('raw')} AS ascii_text, {D.ascii_to_arabic('doc_id')} AS arabic_id FROM ({RAW})")
def t10_digits(t):
    """Digit maps both ways."""
    return t.sql(RAW).select("doc_id", A.digits_to_ascii(F.col("raw")).alias("ascii_text"), A.ascii_to_arabic(F.col("doc_id")).alias("arabic_id"))


@query(
    f"""SELECT glyph, count(*) AS n FROM (SELECT unnest(regexp_extract_all(raw, '[{A.PUA_RANGE}]')) AS glyph FROM ({RAW}))
    WHERE strpos('{"".join(A.PUA_MARKS) + A.PUA_DROPPED + A.PUA_LIGATURE[0]}', glyph) = 0 GROUP BY glyph"""
)
def t1b_unknown_glyphs(t):
    """Private-use glyphs that no map covers, counted over the corpus."""
    known = "".join(A.PUA_MARKS) + A.PUA_DROPPED + A.PUA_LIGATURE[0]
    glyphs = t.sql(RAW).select(F.explode(F.regexp_extract_all("raw", F.lit(f"([{A.PUA_RANGE}])"), F.lit(1))).alias("glyph"))
    return glyphs.where(~F.col("glyph").isin(list(known))).groupBy("glyph").agg(F.count("*").alias("n"))


@query(
    f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(raw, '[{A.TOKEN_LETTERS}]+')) AS token FROM ({RAW}))
    WHERE contains(token, 'آ') AND token NOT IN ({", ".join(map(D.q, A.KEEP_MADDA + A.MADDA_TO_ALEF))}) GROUP BY token"""
)
def t12b_unreviewed_tokens(t):
    """Tokens with madda outside the reviewed sets, counted over the corpus. Reviewed sets are a parameter of the job."""
    return P.unreviewed_tokens(t.sql(RAW), "raw", A.KEEP_MADDA + A.MADDA_TO_ALEF)


NUMBERS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('مادة ', translate(CAST(doc_id AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩')) WHEN 1 THEN concat(CAST(doc_id AS STRING), ' مكرر') WHEN 2 THEN 'بلا رقم' WHEN 3 THEN concat('۴', CAST(doc_id AS STRING), ' و 7') ELSE CAST(doc_id AS STRING) END AS raw FROM {documents}"


@query(f"SELECT doc_id, {D.number_of('raw')} AS number, contains(raw, 'مكرر') AS is_mukarrar FROM ({NUMBERS})")
def t14_article_number(t):
    """Number and whether it is a repeated (mukarrar) one; null where none can be read."""
    return t.sql(NUMBERS).select("doc_id", A.article_number(F.col("raw")).alias("x")).select("doc_id", "x.number", "x.is_mukarrar")


LAWS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 174 WHEN 1 THEN 131 ELSE 10 + doc_id % 7 END AS law_number, CASE doc_id % 3 WHEN 0 THEN 2025 WHEN 1 THEN 1948 ELSE 2000 END AS law_year, concat('قانون ', source) AS payload_name FROM {documents}"


@query(
    f"""SELECT doc_id, concat(CASE WHEN law_number = 174 AND law_year = 2025 THEN 'قانون الإجراءات الجنائية' WHEN law_number = 131 AND law_year = 1948 THEN 'القانون المدني' ELSE payload_name END,
    ' رقم ', {D.ascii_to_arabic('law_number')}, ' لسنة ', {D.ascii_to_arabic('law_year')}) AS law_name, (law_number = 174 AND law_year = 2025) OR (law_number = 131 AND law_year = 1948) AS is_known FROM ({LAWS})"""
)
def t15_canonical_law_name(t):
    """A known law's own name, else the payload's, with number and year in Arabic digits."""
    from daftar.operators.laws import canonical_law_names

    return canonical_law_names(t.sql(LAWS), "payload_name").select("doc_id", "law_name", "is_known")


FENCED = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('```json', chr(10), '{{"answer_text": "', role, '", "citations": []}}', chr(10), '```') WHEN 1 THEN concat('{{"answer_text": "', role, '"}}') WHEN 2 THEN concat('```', role, '```') ELSE concat('  ', role, ' ') END AS raw FROM {conversations}""".replace("{{", "{").replace("}}", "}")


@query(
    """SELECT conv_id, turn, CASE WHEN cleaned LIKE '{%' AND json_valid(cleaned) THEN coalesce(json_extract_string(cleaned, '$.answer_text'), '') ELSE raw END AS answer_text FROM (
    SELECT *, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', ''), ' ' || chr(10)) ELSE trim(raw) END AS cleaned FROM ("""
    + FENCED
    + "))"
)
def t16_parse_answer(t):
    """Fences stripped, the answer of a JSON object; anything else stays raw."""
    return t.sql(FENCED).select("conv_id", "turn", A.parse_answer(F.col("raw"))["answer_text"].alias("answer_text"))


PARTS = """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN concat('["a ", {"type": "text", "text": "', role, '"}, {"type": "image", "url": "x"}]') ELSE '[]' END AS content FROM {conversations}"""


@query(
    """SELECT conv_id, turn, CASE WHEN content LIKE '[%' THEN coalesce(array_to_string(list_transform(CAST(content AS JSON[]), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN p->>'$' WHEN p->>'$.type' = 'text' THEN p->>'$.text' END), ''), '') ELSE content END AS text FROM ("""
    + PARTS
    + ")"
)
def t17_content_text(t):
    """Text of a message whose content is a string or a list of parts."""
    return t.sql(PARTS).select("conv_id", "turn", A.content_text(F.col("content")).alias("text"))


FEEDS = "SELECT doc_id, concat(replace(text, chr(10), chr(12)), CASE WHEN doc_id % 2 = 0 THEN chr(12) ELSE '' END) AS raw FROM {documents}"
_PAGES = f"""SELECT doc_id, i AS page_number, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN trim(parts[-1]) = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, string_split(raw, chr(12)) AS parts FROM ({FEEDS}))))"""


@query(f"SELECT doc_id, page_number, {D.clean_text('text')} AS text FROM ({_PAGES})")
def s1_extract_pages(t):
    """Raw text to numbered clean pages; one blank page at the end goes, others stay."""
    return P.extract_pages(t.sql(FEEDS), with_nfkc=False)


@query(f"SELECT doc_id, page_number, {D.clean_text('text')} AS text FROM ({_PAGES}) WHERE page_number = 2")
def s2_extract_page(t):
    """One page of each document."""
    return P.extract_pages(t.sql(FEEDS), with_nfkc=False).where("page_number = 2")


@query(f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM (SELECT doc_id, page_number, {D.clean_text('text')} AS text FROM ({_PAGES})) WHERE text <> '' GROUP BY doc_id")
def s3_document_text(t):
    """S3: non-blank pages joined with a blank line."""
    return P.document_text(P.extract_pages(t.sql(FEEDS), with_nfkc=False))
