"""Queries of the citation audit (G1-G9) over answers derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.operators import guard as G

from . import duck_text as D
from .base import query

CALLS = """SELECT conv_id, turn, call_seq, concat('c', CAST(n AS STRING)) AS chunk_id, CASE WHEN n % 2 = 0 THEN 'القانون المدني رقم ١٣١ لسنة ١٩٤٨' ELSE 'قانون الإجراءات الجنائية رقم ١٧٤ لسنة ٢٠٢٥' END AS law_name,
  CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n AS INT) END AS article_number, concat('المادة ', CAST(n AS STRING)) AS citation_label
  FROM (SELECT conv_id, turn, j AS call_seq, (conv_id * 3 + turn + j % 3) % 40 AS n FROM {conversations}, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE role = 'assistant')"""
CONTEXT = f"SELECT conv_id, turn, chunk_id, law_name, article_number, citation_label FROM ({CALLS}) WHERE call_seq < 3"
_ONE = """concat('{"law_name": "القانون المدنى رقم ١٣١ لسنة ١٩٤٨", "article_number": ', CASE WHEN n % 5 = 0 THEN 'null' WHEN n % 11 = 0 THEN concat('"', CAST(n AS STRING), ' مكرر"') WHEN n % 6 = 0 THEN '"بلا"' ELSE CAST(n AS STRING) END, ', "citation_label": "المادة ', CAST(n AS STRING), '"}')"""
_TWO = """'{"law_name": "قانون الإجراءات الجنائية رقم ١٧٤ لسنة ٢٠٢٥", "article_number": 999, "citation_label": "x"}'"""
ATTEMPTS = f"""SELECT conv_id, turn, attempt, CASE WHEN conv_id % 9 = 0 THEN concat('garbage مادة ', CAST(n AS STRING)) WHEN conv_id % 2 = 1 THEN concat('```json', chr(10), body, chr(10), '```') ELSE body END AS raw FROM (
  SELECT conv_id, turn, attempt, n, concat('{{"answer_text": "تنص المادة ', CAST(n AS STRING), ' و المادة رقم (', CAST(n + 30 AS STRING), ') والمادة ', CAST(n AS STRING), ' مكرر", "citations": [', {_ONE}, CASE WHEN conv_id % 4 = 0 AND (attempt = 1 OR conv_id % 8 = 0) THEN concat(', ', {_TWO}) ELSE '' END, ']}}') AS body
  FROM (SELECT conv_id, turn, attempt, (conv_id * 3 + turn) % 40 AS n FROM {{conversations}}, (SELECT CAST(1 AS INT) AS attempt UNION ALL SELECT CAST(2 AS INT)) WHERE role = 'assistant'))""".replace("{{", "{").replace("}}", "}")
_CLEAN = "CASE WHEN starts_with(raw, '```') THEN trim(regexp_replace(regexp_replace(raw, '^```(?:json)?\\s*', ''), '\\s*```$', ''), ' ' || chr(10)) ELSE raw END"
PARSED = f"""SELECT conv_id, turn, attempt, CASE WHEN ok THEN coalesce(json_extract_string(x, '$.answer_text'), '') ELSE raw END AS answer_text, CASE WHEN ok THEN CAST(json_extract(x, '$.citations') AS JSON[]) ELSE [] END AS citations
  FROM (SELECT *, json_valid(x) AND x LIKE '{{%' AS ok FROM (SELECT *, {_CLEAN} AS x FROM ({ATTEMPTS})))""".replace("{{", "{")
NUMBERS = f"SELECT conv_id, {D.law_name('law_name')} AS law_key, article_number AS number, min(turn) AS since FROM ({CONTEXT}) WHERE article_number IS NOT NULL GROUP BY ALL"
_V = "CASE WHEN raw_number IS NULL THEN coalesce(l.since <= c.turn, false) WHEN c.number IS NULL THEN false ELSE coalesce(n.since <= c.turn AND NOT is_mukarrar, false) END"
CHECKS = f"""SELECT *, CASE WHEN is_valid THEN '' WHEN raw_number IS NULL THEN 'no retrieved article matches this citation_label' WHEN article_number IS NULL THEN 'unparseable article_number' ELSE 'article not retrieved in this conversation' END AS reason FROM (
  SELECT c.conv_id, c.turn, c.attempt, c.pos, c.law_name, c.number AS article_number, c.citation_label, c.raw_number, {_V} AS is_valid FROM (
    SELECT *, {D.number_of("raw_number")} AS number, contains(raw_number, 'مكرر') AS is_mukarrar, {D.law_name("law_name")} AS law_key FROM (
      SELECT conv_id, turn, attempt, pos, json_extract_string(c, '$.law_name') AS law_name, json_extract_string(c, '$.article_number') AS raw_number, json_extract_string(c, '$.citation_label') AS citation_label
      FROM (SELECT conv_id, turn, attempt, CAST(generate_subscripts(citations, 1) - 1 AS INT) AS pos, unnest(citations) AS c FROM ({PARSED})))) c
  LEFT JOIN ({NUMBERS}) n ON n.conv_id = c.conv_id AND n.law_key = c.law_key AND n.number = c.number
  LEFT JOIN (SELECT conv_id, citation_label, min(turn) AS since FROM ({CONTEXT}) GROUP BY ALL) l ON l.conv_id = c.conv_id AND l.citation_label = c.citation_label)"""
INLINE = f"""SELECT i.conv_id, i.turn, i.attempt, i.pos, i.raw_match, i.number, i.is_mukarrar, coalesce(n.since <= i.turn AND NOT i.is_mukarrar, false) AS is_verified FROM (
  SELECT *, {D.number_of("raw_match")} AS number, contains(raw_match, 'مكرر') AS is_mukarrar FROM (SELECT conv_id, turn, attempt, CAST(generate_subscripts(m, 1) - 1 AS INT) AS pos, unnest(m) AS raw_match FROM (
    SELECT conv_id, turn, attempt, regexp_extract_all(answer_text, {D.q(G.INLINE)}) AS m FROM ({PARSED})))) i
  LEFT JOIN (SELECT conv_id, number, min(since) AS since FROM ({NUMBERS}) GROUP BY ALL) n ON n.conv_id = i.conv_id AND n.number = i.number"""
RESULTS = f"""SELECT *, n_hallucinated = 0 AS is_valid, concat_ws(chr(10), 'citations: ' || n_valid || ' valid, ' || n_hallucinated || ' hallucinated', bad, CASE WHEN n_unverified_inline > 0 THEN 'inline refs not in retrieved set (review-level): ' || n_unverified_inline END, soft) AS report FROM (
  SELECT a.conv_id, a.turn, a.attempt, a.answer_text, coalesce(c.n_valid, 0) AS n_valid, coalesce(c.n_bad, 0) AS n_hallucinated, coalesce(i.n_soft, 0) AS n_unverified_inline, c.bad, i.soft FROM ({PARSED}) a
  LEFT JOIN (SELECT conv_id, turn, attempt, count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (NOT is_valid) AS n_bad, string_agg('  HALLUCINATED: law=''' || law_name || ''' article=' || coalesce(CAST(article_number AS VARCHAR), 'None') || ' (' || reason || ')', chr(10) ORDER BY pos) FILTER (NOT is_valid) AS bad FROM ({CHECKS}) GROUP BY ALL) c USING (conv_id, turn, attempt)
  LEFT JOIN (SELECT conv_id, turn, attempt, count(*) FILTER (NOT is_verified) AS n_soft, string_agg('  UNVERIFIED INLINE: ''' || raw_match || '''', chr(10) ORDER BY pos) FILTER (NOT is_verified) AS soft FROM ({INLINE}) GROUP BY ALL) i USING (conv_id, turn, attempt))"""
DECIDED = f"""SELECT conv_id, turn, min(attempt) FILTER (is_valid) AS chosen_attempt, coalesce(arg_min(answer_text, attempt) FILTER (is_valid), '{G.FALLBACK}') AS answer_text, count(*) FILTER (is_valid) = 0 AS used_fallback,
  coalesce(arg_min(n_hallucinated, attempt) FILTER (is_valid), arg_max(n_hallucinated, attempt)) AS n_hallucinated FROM ({RESULTS}) GROUP BY conv_id, turn"""


def results_of(t):
    return G.verify(G.parsed(t.sql(ATTEMPTS)), t.sql(CONTEXT))


@query(f"SELECT conv_id, turn, attempt, answer_text, len(citations) AS n_citations FROM ({PARSED})")
def g1_parse_answers(t):
    """G1: answers out of fences and JSON; what can't be parsed is its own text."""
    return G.parsed(t.sql(ATTEMPTS)).select("conv_id", "turn", "attempt", "answer_text", F.size("citations").cast("long").alias("n_citations"))


@query(NUMBERS)
def g2_allowed_set(t):
    """Articles retrieved in a conversation, each from its first turn."""
    return G.allowed_numbers(t.sql(CONTEXT))


@query(f"SELECT conv_id, turn, attempt, pos, law_name, article_number, citation_label, is_valid, reason FROM ({CHECKS})")
def g3_citation_check(t):
    """G3."""
    return G.check_citations(G.parsed(t.sql(ATTEMPTS)), t.sql(CONTEXT))


@query(INLINE)
def g4_inline_references(t):
    """G4."""
    return G.inline_references(G.parsed(t.sql(ATTEMPTS)), t.sql(CONTEXT))


@query(f"SELECT conv_id, turn, attempt, n_valid, n_hallucinated, n_unverified_inline, is_valid, report FROM ({RESULTS})")
def g5_verify(t):
    """Verdict and report."""
    return results_of(t).drop("answer_text", "citations")


@query(DECIDED)
def g6_guarded_decision(t):
    """First valid attempt, else the fallback."""
    return G.decide(results_of(t))


@query(f"SELECT conv_id, turn, chunk_id, min(call_seq) AS call_seq FROM ({CALLS}) GROUP BY ALL")
def g7_first_per_turn(t):
    """Retrieved articles once per turn, in call order."""
    return G.first_per_turn(t.sql(CALLS)).select("conv_id", "turn", "chunk_id", "call_seq")


@query(f"SELECT c.conv_id, c.turn, c.pos, c.law_name, c.article_number, c.citation_label FROM ({CHECKS}) c JOIN ({DECIDED}) d ON c.conv_id = d.conv_id AND c.turn = d.turn AND c.attempt = d.chosen_attempt WHERE c.is_valid")
def g8_verified_citations(t):
    """G8."""
    answers, context = G.parsed(t.sql(ATTEMPTS)), t.sql(CONTEXT)
    return G.verified_citations(G.decide(G.verify(answers, context)), G.check_citations(answers, context))


@query(f"SELECT conv_id, turn, chunk_id, law_name, article_number, citation_label FROM ({CONTEXT})")
def g9_context_snapshot(t):
    """Contexts stored with their message and read back row by row."""
    fields = ["chunk_id", "law_name", "article_number", "citation_label"]
    stored = t.sql(CONTEXT).groupBy("conv_id", "turn").agg(F.collect_list(F.struct(*fields)).alias("retrieved_context"))
    return G.snapshot(stored)


