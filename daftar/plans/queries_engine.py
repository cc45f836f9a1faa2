"""The engine from raw pages to search results in one query: each customer is a law whose pages hold the lines of queries_structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.operators import engine as E
from daftar.sources import stores as S

from . import queries_chunks as QC
from . import queries_retrieval as QR
from . import queries_structure as QS
from .base import folder, query

LAWS = """SELECT c_custkey AS doc_id, CAST(c_custkey AS INT) AS law_number, CAST(1950 + c_custkey % 70 AS INT) AS law_year, concat('قانون المعاملات ', CASE WHEN c_custkey % 3 = 0 THEN 'التجارية' ELSE 'المدنية' END) AS law_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'cardinal' ELSE 'feminine_ordinal' END AS issuance_style FROM {customer}"""
#: Five kinds of question, each to a law: by number, for an enacting article, for a repealed one, in words within the law, and in words.
ASKED = """SELECT c_custkey AS query_id, CASE c_custkey % 25 WHEN 0 THEN concat('ما نص المادة رقم ', CAST(c_custkey % 3 + 1 AS STRING), ' من قانون رقم ', CAST(c_custkey AS STRING), ' لسنة ', CAST(1950 + c_custkey % 70 AS STRING))
  WHEN 1 THEN concat('المادة الأولى من قانون رقم ', CAST(c_custkey AS STRING)) WHEN 2 THEN concat('هل ألغيت المادة ', CAST(c_custkey % 4 + 40 AS STRING), ' من قانون رقم ', CAST(c_custkey AS STRING))
  WHEN 3 THEN 'قسم جديد في أعضاء المجلس' ELSE concat('الأشخاص الاعتبارية هي الدولة رقم ', CAST(c_custkey AS STRING)) END AS text, CASE WHEN c_custkey % 25 = 3 THEN CAST(c_custkey AS INT) END AS law_number FROM {customer} WHERE c_custkey % 25 < 5"""

_REFS = f"SELECT a.query_id, r.number, r.article_type, coalesce(a.law_number, r.law_number) AS law_number, r.law_year, CAST(NULL AS INT) AS book_number FROM ({ASKED}) a JOIN ({QR.reference(ASKED)}) r USING (query_id)"
_SCORED = "SELECT q.query_id, p.chunk_id, list_dot_product(q.dense, p.dense) AS score FROM ranked q JOIN pts p ON (q.law_number IS NULL OR q.law_number = p.law_number)"
_SHARED = """SELECT a.query_id, b.chunk_id, sum(a.weight * b.weight) AS score FROM asked_terms a JOIN ranked q USING (query_id) JOIN held_terms b USING (term) JOIN pts p USING (chunk_id)
  WHERE q.law_number IS NULL OR q.law_number = p.law_number GROUP BY ALL"""
_FUSED = QR.top(f"SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM ({QR.top(_SCORED, 30)}) UNION ALL SELECT query_id, chunk_id, rank FROM ({QR.top(_SHARED, 30)})) GROUP BY ALL", 10)
SEARCHED = f"""WITH laws AS MATERIALIZED ({LAWS}), articles_of_laws AS MATERIALIZED (SELECT * FROM ({QS.ARTICLES}) JOIN (SELECT doc_id, law_number FROM laws) USING (doc_id)),
  chunks AS MATERIALIZED (SELECT *, text_for_embedding AS text FROM ({QC.chunks_of(QC.expanded("SELECT * FROM articles_of_laws"), "SELECT law_number, law_year, law_name, issuance_style FROM laws")}) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos DESC) = 1),
  refs AS MATERIALIZED ({_REFS}), held_terms AS MATERIALIZED ({QR.terms("SELECT chunk_id, text FROM chunks", "chunk_id")}), asked_terms AS MATERIALIZED ({QR.terms(ASKED, "query_id")}),
  pts AS MATERIALIZED (SELECT chunk_id, law_number, dense FROM chunks JOIN ({QR.encoded("SELECT * FROM held_terms", "chunk_id")}) USING (chunk_id)),
  ranked AS MATERIALIZED (SELECT a.query_id, a.law_number, e.dense FROM ({ASKED}) a JOIN ({QR.encoded("SELECT * FROM asked_terms", "query_id")}) e USING (query_id) WHERE query_id IN (SELECT query_id FROM refs WHERE number IS NULL))
  SELECT query_id, route, rank, chunk_id, citation_label, article_status FROM (SELECT query_id, 'lookup' AS route, chunk_id, rank FROM ({QR.LOOKUP % ("SELECT * FROM refs WHERE number IS NOT NULL", "SELECT *, CAST(book_number AS INT) AS b FROM chunks", 10)})
  UNION ALL SELECT query_id, 'ranked', chunk_id, rank FROM ({_FUSED})) JOIN chunks USING (chunk_id)"""


def raw_documents(t):
    """doc_id, raw: the lines as a PDF's text gives them, with direction marks and loose blanks; law 131 has its glyph fault."""
    noisy = F.concat(F.lit("  ‏"), F.regexp_replace("line", " ", "  "), F.lit("‎ \t"))
    faulty = F.when(F.col("doc_id") == 131, F.translate(noisy, "ك", "آ")).otherwise(noisy)
    pages = QS.law_lines(t).withColumn("line", faulty).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    pages = pages.select("doc_id", "page_number", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
    whole = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("x"))
    return whole.select("doc_id", F.concat(F.array_join(F.transform("x", lambda x: x["text"]), "\f"), F.lit("\f")).alias("raw"))


@query(SEARCHED)
def e1_pages_to_search(t):
    """Raw pages cleaned, repaired, cut into articles, chunked, stored, encoded, stored as points and searched by all kinds of question."""
    chunks, points = folder(t), folder(t)
    S.write_records(E.statute_chunks(raw_documents(t), t.sql(LAWS)), chunks, "parquet")
    S.write_records(E.points(t.spark.read.parquet(chunks)), points, "parquet")
    return E.answers(t.sql(ASKED), t.spark.read.parquet(points)).withColumn("rank", F.col("rank").cast("long"))
