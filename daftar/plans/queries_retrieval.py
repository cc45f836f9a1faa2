"""Queries of vectors and retrieval (V1-V20, S12) over points derived from documents and embeddings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from daftar.functions import vectors as V
from daftar.operators import retrieval as R
from daftar.operators.laws import FEMININE_NUMBERS

from . import duck_text as D
from .base import folder, query

CHUNKS = """SELECT doc_id, concat('c', lpad(CAST(doc_id AS STRING), 9, '0')) AS chunk_id, CASE WHEN lang = 'en' THEN 174 WHEN lang = 'fr' THEN 131 ELSE 7 END AS law_number,
  CASE WHEN lang = 'en' THEN 2025 WHEN lang = 'fr' THEN 1948 ELSE 2001 END AS law_year, CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE concat('law ', lang) END AS law_name, CAST(doc_id % 4 + 1 AS INT) AS book_number,
  CASE WHEN doc_id % 50 = 0 THEN NULL ELSE CAST(n AS INT) END AS article_number, CASE WHEN doc_id % 50 = 0 THEN CAST(n % 10 + 1 AS INT) END AS issuance_number,
  CASE WHEN doc_id % 50 = 0 THEN 'issuance' ELSE 'substantive' END AS article_type, CASE WHEN doc_id % 17 = 0 THEN 'repealed' ELSE 'active' END AS article_status,
  CASE WHEN doc_id % 23 = 0 THEN 'preamble' ELSE 'normal' END AS part_kind, CASE WHEN doc_id % 3 = 0 THEN concat('division ', lang) END AS division_title, concat('book ', CAST(doc_id % 4 + 1 AS STRING)) AS book_title,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('part ', source) END AS part_title, CASE WHEN doc_id % 7 < 3 THEN 'chapter' END AS chapter_title, CASE WHEN doc_id % 11 = 0 THEN 'section' END AS section_title,
  CASE WHEN doc_id % 13 = 0 THEN 'label' END AS subsection_title, concat('header ', source) AS header, concat('article ', CAST(n AS STRING), ' of ', lang) AS citation_label, text AS body_faithful, text,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat(source, ' ', text) END AS text_for_display
  FROM (SELECT *, doc_id % 400 + 1 AS n FROM {documents})"""
POINTS = f"SELECT c.*, e.embedding AS dense FROM ({CHUNKS}) c JOIN {{embeddings}} e ON c.doc_id = e.vec_id"
QUERIES = f"""SELECT doc_id AS query_id, dense, text, CASE WHEN doc_id % 40 = 0 THEN law_number END AS law_number, CAST(NULL AS INT) AS law_year, CAST(NULL AS INT) AS book_number,
  CAST(NULL AS INT) AS article_number, CAST(NULL AS STRING) AS article_type FROM ({POINTS}) WHERE doc_id % 20 = 0"""
_PASS = "(q.law_number IS NULL OR q.law_number = p.law_number)"
_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


def top(rows: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ({rows})) WHERE rank <= {k}"


def dense(k: int, test: str = _PASS, queries: str = QUERIES) -> str:
    return top(f"SELECT q.query_id, p.chunk_id, {_COS.format(a='q.dense', b='p.dense')} AS score FROM ({queries}) q JOIN ({POINTS}) p ON {test}", k)


def terms(rows: str, key: str) -> str:
    return f"SELECT {key}, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT {key}, unnest(regexp_split_to_array({D.normalize('lower(text)')}, '[ \n]+')) AS term FROM ({rows})) WHERE term <> '' GROUP BY ALL"


def sparse(k: int, test: str = _PASS, queries: str = QUERIES, weight: str = "1") -> str:
    """weight: what a term's count on the points' side is multiplied by."""
    return top(
        f"SELECT query_id, chunk_id, score FROM (SELECT a.query_id, b.chunk_id, sum(a.weight * b.weight * {weight}) AS score FROM ({terms(queries, 'query_id')}) a JOIN ({terms(POINTS, 'chunk_id')}) b USING (term) GROUP BY ALL) s JOIN ({queries}) q USING (query_id) JOIN ({POINTS}) p USING (chunk_id) WHERE {test}",
        k,
    )


def fused(k: int, prefetch: int, test: str = _PASS, queries: str = QUERIES) -> str:
    return top(f"SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM ({dense(prefetch, test, queries)}) UNION ALL SELECT query_id, chunk_id, rank FROM ({sparse(prefetch, test, queries)})) GROUP BY ALL", k)


def published(hits):
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def published_sql(rows: str) -> str:
    return f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({rows})"


def points(t, rows: str = POINTS):
    """Points dealt to as many tasks as the session has: their texts are few bytes but much work."""
    return t.sql(rows).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id")


def stored_index(t):
    """V2's sparse vectors of the points, indexed and stored: texts are dealt and read once, however many parts the queries come in."""
    path = folder(t)
    R.sparse_index(R.with_sparse(points(t)), ("law_number",)).write.parquet(path)
    return t.spark.read.parquet(path)


@query(published_sql(dense(30)))
def v3_dense_top_k(t):
    """V3: cosine top 30 with each query's law filter applied first."""
    return published(R.dense_top_k(t.sql(QUERIES), t.sql(POINTS), 30, ("law_number",)))


@query(f"SELECT chunk_id, term, weight FROM ({terms(POINTS, 'chunk_id')})")
def v2_sparse_postings(t):
    """V2: term weights."""
    return R.postings(t.sql(POINTS), "chunk_id", "text")


@query(f"SELECT chunk_id, len(list(term)) AS n, array_to_string(list(term ORDER BY term), ' ') AS terms FROM ({terms(POINTS, 'chunk_id')}) GROUP BY chunk_id")
def v2_sparse_arrays(t):
    """V2: the parallel-array layout."""
    found = R.sparse_vectors(R.postings(t.sql(POINTS), "chunk_id", "text"), "chunk_id")
    return found.select("chunk_id", F.size("values").cast("long").alias("n"), F.array_join("indices", " ").alias("terms"))


@query(published_sql(sparse(30)))
def v4_sparse_top_k(t):
    """V4: inner product over shared terms, filtered before the cut: V2's vectors of the points, indexed, stored, read back and searched."""
    return published(R.sparse_search(R.with_sparse(t.sql(QUERIES)), stored_index(t), 30, ("law_number",)))


_SIGNED = "CASE WHEN md5(term) < '4' THEN -0.5 ELSE 1.25 END"


@query(published_sql(sparse(5, weight=_SIGNED)))
def v4_signed_weights(t):
    """V4 with stored weights of either sign."""
    weighted = R.postings(t.sql(POINTS), "chunk_id", "text").withColumn("weight", F.col("weight") * F.expr(_SIGNED).cast("double"))
    held = t.sql(POINTS).select("chunk_id", "law_number").join(R.sparse_vectors(weighted, "chunk_id"), "chunk_id")
    return published(R.sparse_top_k(t.sql(QUERIES), held, 5, ("law_number",)))


@query(published_sql(fused(20, 10)))
def v5_rrf_fusion(t):
    """V5: two lists of 10 fused."""
    return published(R.hybrid_search(t.sql(QUERIES), t.sql(POINTS), 20, 10, index=stored_index(t)))


@query(published_sql(fused(10, 30)))
def v6_hybrid_search(t):
    """Prefetch 30 each, fuse, keep 10; the points bring V2's sparse vectors."""
    return published(R.hybrid_search(t.sql(QUERIES), R.with_sparse(points(t))))


def flagship(t):
    return published(R.hybrid_search(t.sql(QUERIES), t.sql(POINTS), 5))


_TOKENS = "list_filter(regexp_split_to_array(" + D.normalize("lower({x})") + ", '[ \n]+'), lambda w: w <> '')[:256]"
_VEC = "list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(md5({t}), i, 1)) - 1) - 7.5)"
_UNIT = f"list_transform({_VEC}, lambda v: CAST(v AS DOUBLE) / sqrt(list_dot_product(CAST({_VEC} AS DOUBLE[]), CAST({_VEC} AS DOUBLE[]))))"


def maxsim(pairs: str) -> str:
    return f"""SELECT query_id, chunk_id, avg(best) AS score FROM (SELECT query_id, chunk_id, pos, max(list_dot_product(qv, pv)) AS best FROM
      (SELECT query_id, pos, {_UNIT.format(t='tok')} AS qv FROM (SELECT query_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM (SELECT DISTINCT query_id, {_TOKENS.format(x='query')} AS toks FROM ({pairs})))) a
      JOIN (SELECT DISTINCT query_id, chunk_id FROM ({pairs})) USING (query_id)
      JOIN (SELECT chunk_id, {_UNIT.format(t='tok')} AS pv FROM (SELECT DISTINCT chunk_id, unnest(toks) AS tok FROM (SELECT DISTINCT chunk_id, {_TOKENS.format(x='passage')} AS toks FROM ({pairs})))) b USING (chunk_id)
      GROUP BY ALL) GROUP BY ALL"""


_PAIRS = f"""SELECT f.query_id, f.chunk_id, q.text AS query, coalesce(p.text_for_display, p.body_faithful) AS passage FROM ({fused(20, 20)}) f JOIN ({QUERIES}) q USING (query_id) JOIN ({POINTS}) p USING (chunk_id)"""


@query(published_sql(top(maxsim(_PAIRS), 5)))
def v9_search_articles(t):
    """V7, V8 and V9: hybrid candidates reranked by late interaction over token vectors that are stored once, top 5."""
    path, held = folder(t), t.sql(POINTS)
    R.token_vectors(points(t).withColumn("passage", F.coalesce("text_for_display", "body_faithful")), "chunk_id", "passage").write.parquet(path)
    return published(R.search_articles(t.sql(QUERIES), held, stored=t.spark.read.parquet(path), index=stored_index(t)))


@query(published_sql(top(maxsim(f"SELECT * FROM ({_PAIRS}) WHERE query_id % 3 = 0"), 3)))
def v7_late_interaction(t):
    """V7 and V8 without stored vectors: every pair encoded, for a third of the queries."""
    q = t.sql(QUERIES).where("query_id % 3 = 0")
    return published(R.search_articles(q, t.sql(POINTS), top_k=3))


@query(f"SELECT chunk_id, law_number, book_number FROM ({CHUNKS}) WHERE law_number = 174 AND book_number = 2")
def v10_filter_by(t):
    """AND of equalities; a filter left out says nothing."""
    return R.filter_by(t.sql(CHUNKS), law_number=174, book_number=2, law_year=None).select("chunk_id", "law_number", "book_number")


@query(f"SELECT chunk_id, article_number FROM ({CHUNKS}) WHERE law_number = 174 AND article_number BETWEEN 1 AND 120 AND book_number <= 3")
def v10_filter_ranges(t):
    """Ranges beside equalities."""
    return R.filter_by(t.sql(CHUNKS), {"article_number": (1, 120), "book_number": (None, 3)}, law_number=174).select("chunk_id", "article_number")


@query(f"SELECT chunk_id, article_number FROM ({CHUNKS}) WHERE law_number = 131 ORDER BY chunk_id LIMIT 50")
def s12_filter_only(t):
    """The first 50 rows of a filter in id order (the limit is the operator)."""
    return R.filter_only(t.sql(CHUNKS), 50, law_number=131).select("chunk_id", "article_number")


REFS = """SELECT doc_id AS query_id, CAST(doc_id % 30 + 1 AS INT) AS number, CASE doc_id % 3 WHEN 0 THEN 'substantive' WHEN 1 THEN 'issuance' END AS article_type, CASE WHEN doc_id % 4 < 2 THEN 174 END AS law_number, CAST(NULL AS INT) AS law_year,
  CASE WHEN doc_id % 9 = 0 THEN CAST(1 AS INT) END AS book_number FROM {documents}"""
LOOKUP = """SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT q.query_id, p.chunk_id FROM (%s) q JOIN (%s) p
  ON ((p.article_number = q.number AND (q.article_type IS NULL OR q.article_type = 'substantive') AND p.article_type = 'substantive') OR (p.issuance_number = q.number AND (q.article_type IS NULL OR q.article_type = 'issuance') AND p.article_type = 'issuance'))
  AND (q.law_number IS NULL OR q.law_number = p.law_number) AND (q.law_year IS NULL OR q.law_year = p.law_year) AND (q.book_number IS NULL OR q.book_number = p.book_number))) WHERE rank <= %d"""


@query(LOOKUP % (REFS, CHUNKS, 5))
def v11_lookup_article(t):
    """Exact lookup with disjoint number spaces."""
    return R.lookup_article(t.sql(REFS), t.sql(CHUNKS)).withColumn("rank", F.col("rank").cast("long"))


RAW_NUMBERS = """SELECT doc_id AS query_id, CASE WHEN doc_id % 10 = 0 THEN concat(CAST(doc_id % 40 AS STRING), ' مكرر') WHEN doc_id % 10 = 1 THEN 'none' ELSE translate(CAST(doc_id % 40 AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') END AS raw,
  CASE WHEN doc_id % 2 = 0 THEN 131 END AS law_number FROM {documents}"""


@query(
    f"""SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT q.query_id, p.chunk_id FROM
    (SELECT *, {D.number_of('raw')} AS number FROM ({RAW_NUMBERS}) WHERE NOT contains(raw, 'مكرر')) q JOIN ({CHUNKS}) p ON q.number = p.article_number AND (q.law_number IS NULL OR q.law_number = p.law_number))) WHERE rank <= 10"""
)
def v12_article_by_number(t):
    """By raw number; repeated numbers and unreadable ones match nothing."""
    return R.article_by_number(t.sql(RAW_NUMBERS), t.sql(CHUNKS)).withColumn("rank", F.col("rank").cast("long"))


ASKED = """SELECT doc_id AS query_id, CASE doc_id % 7 WHEN 0 THEN concat('ما نص المادة رقم ', CAST(doc_id % 40 AS STRING), ' من قانون العمل رقم ', CAST(doc_id % 5 + 170 AS STRING), ' لسنة 2025')
  WHEN 1 THEN concat('مادة (', translate(CAST(doc_id % 40 AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩'), ') من القانون المدني') WHEN 2 THEN 'المادة الثانية من قانون الإجراءات الجنائية' WHEN 3 THEN 'المادة الأولى' WHEN 4 THEN 'ماده ٧'
  WHEN 5 THEN 'القانون المدني لسنة ١٩٩٩ المادة 3' ELSE text END AS text FROM {documents}"""
_ORDINAL = "CASE " + " ".join(f"WHEN ord = '{w}' THEN {n}" for w, n in FEMININE_NUMBERS.items()) + " END"
_ALT = "|".join(sorted(FEMININE_NUMBERS, key=lambda w: (-len(w), w)))


def reference(rows: str) -> str:
    x = D.tr(D.normalize("text"), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    number = lambda p: f"TRY_CAST(nullif(regexp_extract(x, '{p}', 1), '') AS INTEGER)"
    named = lambda a, b: f"CASE WHEN contains(x, 'قانون الاجراءات الجنائية') THEN {a} WHEN contains(x, 'القانون المدني') THEN {b} END"
    return f"""SELECT query_id, coalesce(o, d) AS number, CASE WHEN o IS NOT NULL THEN 'issuance' WHEN d IS NOT NULL THEN 'substantive' END AS article_type, law_number, law_year FROM (
      SELECT query_id, {_ORDINAL} AS o, d, law_number, law_year FROM (SELECT query_id, regexp_extract(x, '(?:ال)?ماد[ةه]\\s+({_ALT})(?:[^ء-ي0-9]|$)', 1) AS ord,
      {number('(?:ال)?ماد[ةه]\\s*(?:رقم)?\\s*[()]*\\s*([0-9]+)')} AS d, coalesce({number('(?s)قانون.{0,60}?رقم\\s*[()]*\\s*([0-9]+)')}, {named(174, 131)}) AS law_number,
      coalesce({number('لسنة\\s*[()]*\\s*([0-9]+)')}, {named(2025, 1948)}) AS law_year FROM (SELECT *, {x} AS x FROM ({rows}))))"""


@query(reference(ASKED))
def v13_article_reference(t):
    """The article, kind and law that a query's text names."""
    return t.sql(ASKED).select("query_id", R.article_reference(F.col("text")).alias("r")).select("query_id", "r.*")


SMART = f"SELECT a.query_id, a.text, q.dense, CASE WHEN a.query_id % 7 = 0 THEN 131 END AS law_number, CAST(NULL AS INT) AS law_year, CAST(NULL AS INT) AS book_number, CASE WHEN a.query_id % 60 = 0 THEN 4 END AS article_number, CAST(NULL AS STRING) AS article_type FROM ({ASKED}) a JOIN ({POINTS}) q ON a.query_id = q.doc_id WHERE a.query_id % 20 = 0"
_ROUTED = f"SELECT s.*, r.number, r.article_type AS ref_type, r.law_number AS ref_law, r.law_year AS ref_year, CASE WHEN s.article_number IS NOT NULL OR r.number IS NULL THEN 'ranked' ELSE 'lookup' END AS route FROM ({SMART}) s JOIN ({reference(SMART)}) r USING (query_id)"
_SMART_LOOKUP = LOOKUP % (f"SELECT query_id, number, coalesce(article_type, ref_type) AS article_type, coalesce(law_number, ref_law) AS law_number, coalesce(law_year, ref_year) AS law_year, book_number FROM ({_ROUTED}) WHERE route = 'lookup'", CHUNKS, 10)
_ALL = " AND ".join(f"(q.{c} IS NULL OR q.{c} = p.{c})" for c in R.FILTERS)
_SMART_RANKED = fused(10, 30, _ALL, f"SELECT query_id, text, dense, law_number, law_year, book_number, article_number, article_type FROM ({_ROUTED}) WHERE route = 'ranked'")


@query(f"SELECT query_id, 'lookup' AS route, chunk_id, rank FROM ({_SMART_LOOKUP}) WHERE chunk_id IN (SELECT chunk_id FROM ({POINTS})) UNION ALL SELECT query_id, 'ranked', chunk_id, rank FROM ({_SMART_RANKED})")
def v14_smart_search(t):
    """Lookup where a query names an article, ranked search elsewhere."""
    return R.smart_search(t.sql(SMART), points(t)).withColumn("rank", F.col("rank").cast("long"))


PAYLOAD = f"SELECT chunk_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE citation_label END AS citation_label, article_type, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'body' END AS body_faithful, header, law_number, law_year, article_number, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE article_status END AS article_status, CAST(NULL AS STRING) AS part_kind, law_name FROM ({CHUNKS})"


@query(
    f"""SELECT chunk_id, coalesce(citation_label, '') AS citation_label, article_type, coalesce(body_faithful, '') AS clean_text, header, law_number, law_year, article_number, coalesce(article_status, 'active') AS article_status, 'normal' AS part_kind,
    concat(CASE law_number WHEN 174 THEN 'قانون الإجراءات الجنائية' WHEN 131 THEN 'القانون المدني' ELSE law_name END, ' رقم ', {D.ascii_to_arabic('law_number')}, ' لسنة ', {D.ascii_to_arabic('law_year')}) AS law_name FROM ({PAYLOAD})"""
)
def v16_typed_hits(t):
    """Defaults of missing payload fields."""
    return R.typed_hits(t.sql(PAYLOAD))


_ANC = "nullif(concat_ws(' ▸ ', nullif(division_title, ''), nullif(book_title, ''), CASE WHEN part_kind = 'preamble' THEN 'الباب التمهيدي' ELSE nullif(part_title, '') END, nullif(chapter_title, ''), nullif(section_title, ''), nullif(subsection_title, '')), '')"
_WARN = f"CASE WHEN article_status = 'repealed' THEN '{R.REPEALED}' END"


@query(f"SELECT chunk_id, concat_ws(chr(10), '[' || citation_label || ']', {_ANC}, {_WARN}, body_faithful) AS with_ancestry, concat_ws(chr(10), '[' || citation_label || ']', header, {_WARN}, body_faithful) AS with_header FROM ({CHUNKS})")
def v17_context_block(t):
    """Both renderings of a hit."""
    return t.sql(CHUNKS).select("chunk_id", R.context_block(True).alias("with_ancestry"), R.context_block(False).alias("with_header"))


@query(f"SELECT chunk_id, citation_label, law_number, law_year, article_number, article_type, article_status, body_faithful AS clean_text FROM ({CHUNKS})")
def v18_tool_projection(t):
    """The fields that a tool result shows."""
    return t.sql(CHUNKS).select("chunk_id", "citation_label", "law_number", "law_year", "article_number", "article_type", "article_status", F.col("body_faithful").alias("clean_text"))


NEIGHBOURS = "SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1"


@query(f"SELECT vec_id, round({_COS.format(a='a', b='b')}, 6) AS cosine FROM ({NEIGHBOURS})".replace("{embeddings}", "embeddings"))
def v19_cosine(t):
    """Cosine of neighbouring vectors."""
    return t.sql(NEIGHBOURS).select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


OVERLAPS = "SELECT doc_id, split(lower(text), ' ') AS a, split(lower(replace(text, 'e', 'a')), ' ') AS b FROM {documents}"


@query(
    "SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM (SELECT doc_id, string_split(lower(text), ' ') AS a, string_split(lower(replace(text, 'e', 'a')), ' ') AS b FROM {documents})"
)
def v20_sparse_overlap(t):
    """Jaccard similarity of index lists."""
    return t.sql(OVERLAPS).select("doc_id", F.round(V.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def encoded(weighted: str, key: str) -> str:
    """The default encoder over (key, term, weight)."""
    slots = f"SELECT {key}, CAST('0x' || substr(md5(term), 1, 4) AS BIGINT) % 64 AS slot, sum(weight * CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1.0 ELSE -1.0 END) AS x FROM ({weighted}) GROUP BY ALL"
    return f"SELECT {key}, list_transform(range(64), lambda i: coalesce(m[i], 0.0) / greatest(n, 1e-300)) AS dense FROM (SELECT {key}, map_from_entries(list((slot, x))) AS m, sqrt(sum(x * x)) AS n FROM ({slots}) GROUP BY {key})"


ENCODED = encoded(terms(CHUNKS, "chunk_id"), "chunk_id")


@query(f"SELECT chunk_id, array_to_string(list_transform(dense, lambda x: CAST(CAST(round(x * 100000) AS BIGINT) AS VARCHAR)), ',') AS dense FROM ({ENCODED})")
def v1_encode(t):
    """V1: the default hashed encoder over every chunk."""
    vectors = R.encode(t.sql(CHUNKS), "chunk_id", "text")
    return vectors.select("chunk_id", F.array_join(F.transform("dense", lambda x: F.round(x * 100000).cast("long").cast("string")), ",").alias("dense"))


_V15_POINTS = f"SELECT c.chunk_id, c.doc_id, c.text, c.law_number, e.dense FROM ({CHUNKS}) c JOIN ({ENCODED}) e USING (chunk_id)"
_V15_QUERIES = f"SELECT doc_id AS query_id, dense, text, CASE WHEN doc_id % 40 = 0 THEN law_number END AS law_number FROM ({_V15_POINTS}) WHERE doc_id % 20 = 0"


@query(published_sql(top(f"SELECT q.query_id, p.chunk_id, list_dot_product(q.dense, p.dense) AS score FROM ({_V15_QUERIES}) q JOIN ({_V15_POINTS}) p ON {_PASS}", 10)))
def v15_encoded_search(t):
    """Texts normalised and encoded alike on both sides, then searched with each query's filter."""
    path = folder(t)  # texts are encoded once, where they lie, and neither they nor their vectors are dealt again
    t.sql(CHUNKS).select("chunk_id", "doc_id", "law_number", R.dense_of("text").alias("dense")).where("dense is not null").write.parquet(path)
    points = t.spark.read.parquet(path)
    law = F.when(F.col("doc_id") % 40 == 0, F.col("law_number"))
    queries = points.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "dense", law.alias("law_number"))
    return published(R.dense_top_k(queries, points, 10, ("law_number",)))


def _shape_encoder():
    """A second encoder, as a worker loads it: numbers of a text's terms, distinct terms and signs, and the square roots of term counts."""

    def encode(texts):
        counts = [Counter(t) for t in texts]
        return [((len(t), len(c), sum(map(len, t))), {k: n**0.5 for k, n in c.items()}) for t, c in zip(texts, counts, strict=True)]

    return encode


_CUT_TERMS = f"SELECT chunk_id, list_filter(regexp_split_to_array({D.normalize('lower(text)')}, '[ \n]+'), lambda w: w <> '')[:400] AS toks FROM ({CHUNKS})"


@query(
    f"""SELECT chunk_id, n, n_distinct, n_signs, coalesce(round(w, 6), 0) AS weights FROM (SELECT chunk_id, len(toks)::DOUBLE AS n, len(list_distinct(toks))::DOUBLE AS n_distinct, coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0)::DOUBLE AS n_signs FROM ({_CUT_TERMS}))
    LEFT JOIN (SELECT chunk_id, sum(sqrt(n)) AS w FROM (SELECT chunk_id, tok, count(*) AS n FROM (SELECT chunk_id, unnest(toks) AS tok FROM ({_CUT_TERMS})) GROUP BY ALL) GROUP BY chunk_id) USING (chunk_id)"""
)
def v1_worker_encoder(t):
    """V1: an encoder that workers load, dense and sparse in one call, texts cut at 400 tokens (the limit is the feature)."""
    made = R.encode_in_workers(t.sql(CHUNKS), "chunk_id", "text", "shapes", _shape_encoder, limit=400)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return made.select("chunk_id", *(F.col("dense")[i].alias(c) for i, c in enumerate(("n", "n_distinct", "n_signs"))), F.round(total, 6).alias("weights"))
