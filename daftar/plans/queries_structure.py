"""Queries of structure detection and article slicing (L1-L22): each customer is a law, its orders are articles, lineitems are lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import arabic as A
from daftar.operators import structure as S
from daftar.operators.laws import FEMININE_NUMBERS, ORDINAL_NUMBERS, ORDINALS

from . import duck_text as D
from .base import query

_WORD = "CASE {n} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(ORDINALS, 1)) + " END"
_N = "SELECT o_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n FROM {orders}"
_w = lambda n: _WORD.format(n=n).replace("CASE", "CASE CAST(", 1).replace(" WHEN", " AS INT) WHEN", 1)
_PARTS = [
    ("0", "n = 1 AND c % 3 = 0", "'المادة الأولى'"),
    ("1", "n = 1 AND c % 3 = 0", "'يعمل بهذا القانون.'"),
    ("2", "n = 1 AND c % 5 = 0", "'باب تمهيدي - أحكام عامة'"),
    ("3", "n % 12 = 2", f"concat('القسم ', {_w('floor(n / 12) + 1')}, ' - قسم إعدادي')"),
    ("4", "n % 6 = 2", f"concat('الكتاب ', {_w('floor(n / 6) + 1')})"),
    ("5", "n % 6 = 2", "'عنوان الكتاب الأصلي'"),
    ("6", "n % 6 = 2 AND c % 2 = 0", "'على سطرين'"),
    ("7", "n % 3 = 2", f"concat('الباب ', {_w('floor((n % 6) / 3) + 1')}, ' – باب إضافي')"),
    ("8", "n % 7 = 3", f"concat('الكتاب ', {_w('floor(n / 6) + 1')}, ' - الباب ', {_w('2')}, ' - عنوان ثان')"),
    ("9", "n % 2 = 0", f"concat('الفصل ', {_w('floor((n % 6) / 2) + 1')}, ' حق الملكية')"),
    ("10", "n % 8 = 5", "'الفصل الثالث'"),
    ("11", "n % 8 = 5", "'عنوان الفصل'"),
    ("12", "n % 4 = 1", "concat('-', CAST(n % 3 + 1 AS STRING), ' البيع بوجه عام')"),
    ("13", "n % 5 = 1", "'التزامات البائع :'"),
    ("14", "n % 4 <> 0", "concat('مادة (', translate(CAST(n AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩'), ')')"),
    ("15", "n % 8 = 0", "concat('مادة – ', CAST(n AS STRING), 'يلغى كل نص، مخالف')"),
    ("16", "n % 8 = 4", "concat('مادة (1) – ', CAST(n AS STRING), 'تسري الأحكام')"),
    ("900", "n % 9 = 4", "'الجمعيات'"),
    ("901", "n % 9 = 4", "concat('المواد من ', CAST(n * 10 AS STRING), ' إلى ', CAST(n * 10 + 3 AS STRING), ' ملغاة')"),
    ("902", "n % 6 = 0", "'الجريدة الرسمية - العدد ٤٥'"),
    ("903", "n % 6 = 0", "CAST(n AS STRING)"),
]
_BODY = """CASE WHEN l.l_linenumber = 2 AND n % 3 = 0 THEN concat('الأشخاص الاعتبارية هي ', CAST(l.l_partkey AS STRING), ' :') WHEN l.l_linenumber = 3 AND n % 3 = 0 THEN concat('-1 الدولة رقم ', CAST(l.l_partkey AS STRING))
  WHEN l.l_linenumber = 3 AND n % 7 = 1 THEN '2- قسم جديد' WHEN l.l_linenumber % 4 = 0 THEN concat('نص: .', translate(CAST(l.l_linenumber AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩'), ' أعضاء المجلس') ELSE concat('نص البند ', CAST(l.l_partkey AS STRING), CASE WHEN l.l_linenumber % 2 = 0 THEN '.' ELSE '' END) END"""
_KS = " UNION ALL ".join(f"SELECT {k} AS k" for k, _, _ in _PARTS)
_TESTS, _LINES = (" ".join(f"WHEN {p[0]} THEN {p[i]}" for p in _PARTS) for i in (1, 2))
RAW_LINES = f"SELECT c, n, k, 0 AS j, CASE k {_LINES} END AS line FROM ({_N}), ({_KS}) WHERE CASE k {_TESTS} END"
RAW_LINES += f" UNION ALL SELECT c, n, 100 AS k, CAST(dense_rank() OVER (PARTITION BY c, n ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS INT) AS j, {_BODY} AS line FROM ({_N}) x JOIN {{lineitem}} l ON l.l_orderkey = x.o"
LAW_LINES = f"SELECT c AS doc_id, CAST(floor((n + 3) / 4) AS INT) AS page_number, n * 1000000 + k * 1000 + j AS pos, line FROM (SELECT DISTINCT c, n, k, j, line FROM ({RAW_LINES}))"
_x = D.q
_ord = lambda w: "CASE " + w + " " + " ".join(f"WHEN {_x(k)} THEN {v}" for k, v in ORDINAL_NUMBERS.items()) + " END"
_fem = lambda w: "CASE " + w + " " + " ".join(f"WHEN {_x(k)} THEN {v}" for k, v in FEMININE_NUMBERS.items()) + " END"
_num = lambda w: f"TRY_CAST(nullif({w}, '') AS INTEGER)"
_m = lambda x, p: f"regexp_matches({x}, {_x(p)})"
_g = lambda x, p, i=1: f"regexp_extract({x}, {_x(p)}, {i})"
_asc = lambda x: D.tr(x, A.ARABIC_DIGITS, A.ASCII_DIGITS)
_any = lambda x, ks: f"{x} IN ({', '.join(map(_x, ks))})"
_wc = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
_bare = "|".join(S.BARE.values())
_tail = lambda dashes, words: (
    f"CASE WHEN len(regexp_split_to_array(line, '{S.DASH}')) > {dashes} THEN array_to_string(regexp_split_to_array(line, '{S.DASH}')[{dashes} + 1:], '-') WHEN {words} > 0 THEN array_to_string(regexp_split_to_array(line, '\\s+')[{words} + 1:], ' ') ELSE '' END"
)
_level_word = "CASE " + " ".join(f"WHEN kind IN ({ks}) THEN {_g('norm', '^' + S.KEYWORDS[k] + chr(92) + 's+' + S.ORD)}" for k, ks in (("division", "'division'"), ("book", "'book', 'banner'"), ("part", "'part'"), ("chapter", "'chapter'"))) + " END"
CTES = f"""WITH raw AS ({LAW_LINES}),
l0 AS (SELECT *, {D.normalize("line")} AS norm, lead(line) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS following FROM raw),
l1 AS (SELECT *, {_asc("norm")} AS na, {_asc("line")} AS al, {_asc(D.normalize("coalesce(following, '')"))} AS nn, (contains(norm, 'الجريدة الرسمية') AND contains(norm, 'العدد')) OR {_m(_asc("line"), "^[0-9]+$")} AS furniture FROM l0),
l2 AS (SELECT *, CASE WHEN {_m("norm", S.INLINE["division"])} OR {_m("norm", S.BARE["division"])} THEN 'division' WHEN {_m("norm", S.BANNER)} THEN CASE WHEN {_g("norm", S.BANNER, 2)} <> '' THEN 'banner' ELSE 'book' END
  WHEN {_m("norm", S.BARE["book"])} THEN 'book' WHEN {_m("norm", S.INLINE["part"])} OR {_m("norm", S.BARE["part"])} THEN 'part' WHEN {_m("norm", S.PREAMBLE)} THEN 'preamble' WHEN {_m("norm", S.CHAPTER)} THEN 'chapter'
  WHEN {_m("norm", S.ISSUANCE)} THEN 'ordinal' WHEN {_m("na", S.ARTICLE)} THEN 'article' WHEN {_m("na", S.GLUED)} THEN 'glued' WHEN {_m("na", S.RANGE)} THEN 'range' WHEN {_m("al", S.SECTION)} AND length(line) < 80 AND NOT {_m("line", "^[()]")} THEN 'section'
  WHEN {_m("line", S.LABEL)} AND NOT {_m("line", "^[()]")} AND ({_m("nn", S.ARTICLE)} OR {_m("nn", S.GLUED)}) AND NOT {_any(_g(D.normalize(_g("line", S.LABEL)), "([^ ]+) *$"), S.FORWARD)} AND {_wc(_g("line", S.LABEL))} <= 6 THEN 'subsection'
  WHEN NOT {_m("line", "[:：]$")} AND {_wc("line")} <= 6 AND length(line) < 60 AND {_m("nn", S.RANGE)} THEN 'label' ELSE 'body' END AS shape FROM l1 WHERE NOT furniture),
l3 AS (SELECT *, CASE WHEN shape IN ('ordinal', 'glued') AND NOT seen THEN 'issuance' WHEN shape = 'glued' THEN 'article' WHEN shape = 'ordinal' THEN 'body' ELSE shape END AS kind0 FROM (
  SELECT *, coalesce(bool_or({_any("shape", S.STRUCTURAL)}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM l2)),
l4 AS (SELECT *, {_any("kind0", S.STRUCTURAL)} AND ({_m("norm", _bare)} OR (kind0 = 'preamble' AND {_g("norm", S.PREAMBLE)} = '') OR (kind0 = 'chapter' AND trim({_g("norm", S.CHAPTER, 2)}) = '')) AS bare, sum(CAST(kind0 <> 'body' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l3),
l5 AS (SELECT *, CASE WHEN kind0 = 'body' AND first_value(bare) OVER r AND first_value(page_number) OVER r = page_number THEN 'title' ELSE kind0 END AS kind FROM l4 WINDOW r AS (PARTITION BY doc_id, run ORDER BY pos ROWS UNBOUNDED PRECEDING)),
l6 AS (SELECT *, coalesce(string_agg(line, ' ') FILTER (kind = 'title') OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS below, {_level_word} AS word FROM l5),
l7 AS (SELECT *, CASE WHEN kind IN ('division', 'book', 'banner', 'part', 'chapter') THEN {_ord("word")} WHEN kind IN ('article', 'issuance') THEN coalesce({_fem(_g("norm", S.ISSUANCE))}, {_num(_g("na", S.ARTICLE))}, {_num(_g("na", S.GLUED, 2))}) WHEN kind = 'range' THEN {_num(_g("na", S.RANGE))}
   WHEN kind = 'section' THEN coalesce({_num(_g("al", S.SECTION, 1))}, {_num(_g("al", S.SECTION, 2))}) END AS number,
  CASE WHEN kind = 'banner' THEN {_ord(_g("norm", S.BANNER, 2))} WHEN kind = 'range' THEN {_num(_g("na", S.RANGE, 2))} END AS number2,
  CASE WHEN bare THEN below WHEN kind = 'banner' THEN trim({_tail("2", "0")}) WHEN kind = 'chapter' THEN trim({_tail("1", "(1 + len(string_split(word, ' ')))")}) WHEN kind = 'preamble' THEN trim({_tail("1", "2")}) WHEN {_any("kind", S.STRUCTURAL)} THEN trim({_tail("1", "0")})
   WHEN kind = 'section' THEN trim({_g("al", S.SECTION, 3)}) WHEN kind = 'subsection' THEN trim({_g("line", S.LABEL)}) WHEN kind = 'label' THEN line END AS title,
  nullif(CASE WHEN kind IN ('article', 'issuance') AND {_m("na", S.GLUED)} THEN trim(CASE WHEN {_g("line", S.RAW_GLUED)} <> '' THEN '(' || {_g("line", S.RAW_GLUED)} || ') ' || ltrim({_g("line", S.RAW_GLUED, 2)}) ELSE {_g("line", S.RAW_GLUED, 2)} END) END, '') AS seed,
  CAST(sum(CAST(kind IN ('article', 'issuance') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l6),
l8 AS (SELECT *, CASE WHEN kind = 'body' THEN line WHEN kind IN ('article', 'issuance') THEN seed END AS txt FROM l7),
l9 AS (SELECT *, min(CASE WHEN {_m("rtrim(txt)", "[.:：؟]$")} THEN pos END) OVER s AS e, min(CASE WHEN {_any("kind", S.CLOSING)} THEN pos END) OVER s AS c,
  arg_min({_m("rtrim(txt)", "[:：]$")} AND coalesce({_m(_asc("following"), S.SECTION)}, false), CASE WHEN {_m("rtrim(txt)", "[.:：؟]$")} THEN pos END) OVER s AS opens FROM l8 WINDOW s AS (PARTITION BY doc_id, session)),
l10 AS (SELECT *, coalesce(session > 0 AND opens AND (c IS NULL OR e < c), false) AS flagged FROM l9),
classified AS (SELECT doc_id, page_number, pos, line, CASE WHEN flagged AND {_any("kind", S.CLOSING)} THEN 'body' ELSE kind END AS kind, CASE WHEN NOT (flagged AND {_any("kind", S.CLOSING)}) THEN number END AS number, CASE WHEN NOT (flagged AND {_any("kind", S.CLOSING)}) THEN number2 END AS number2,
  CASE WHEN NOT (flagged AND {_any("kind", S.CLOSING)}) THEN title END AS title, seed, session, session = 0 OR coalesce(NOT flagged AND pos >= c, false) AS closed FROM l10),
"""


def _carry() -> str:
    """The context windows, level by level."""
    marks = {
        "division": ("CASE WHEN kind = 'division' THEN number WHEN kind = 'preamble' THEN 0 END", "CASE WHEN kind = 'division' THEN title END"),
        "book": ("CASE WHEN kind IN ('book', 'banner') THEN number WHEN kind = 'preamble' THEN 0 END", "CASE WHEN kind = 'book' THEN title END"),
        "part": ("CASE WHEN kind = 'part' THEN number WHEN kind = 'banner' THEN number2 WHEN kind = 'preamble' THEN 0 END", "CASE WHEN kind IN ('part', 'banner', 'preamble') THEN title END"),
        "chapter": ("CASE WHEN kind = 'chapter' THEN number END", "CASE WHEN kind = 'chapter' THEN title END"),
        "section": ("CASE WHEN kind = 'section' THEN number END", "CASE WHEN kind = 'section' THEN title END"),
    }
    out, source, keys = "", "classified", ["doc_id"]
    for level, (number, title) in marks.items():
        k = ", ".join(keys)
        w = f"(PARTITION BY {k} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        out += f"{level}_a AS (SELECT *, last_value({number} IGNORE NULLS) OVER {w} AS n_{level} FROM {source}),\n"
        out += f"{level}_b AS (SELECT *, CAST(n_{level} IS DISTINCT FROM lag(n_{level}) OVER (PARTITION BY {k} ORDER BY pos) AS INT) AS d_{level} FROM {level}_a),\n"
        out += f"{level}_c AS (SELECT *, sum(d_{level}) OVER {w} AS v_{level} FROM {level}_b),\n"
        keys.append(f"v_{level}")
        w = f"(PARTITION BY {', '.join(keys)} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        out += f"{level}_d AS (SELECT *, first_value(nullif({title}, '') IGNORE NULLS) OVER {w} AS {level}_title FROM {level}_c),\n"
        source = f"{level}_d"
    numbers = ", ".join(f"nullif(n_{x}, 0) AS {x}_number" for x in marks)
    return out + f"context AS (SELECT *, {numbers}, CASE WHEN n_part = 0 THEN 'preamble' ELSE 'normal' END AS part_kind, last_value(CASE WHEN kind IN ('subsection', 'label') THEN title END IGNORE NULLS) OVER {w} AS subsection_title FROM {source})\n"


_CTX = ", ".join(S.CONTEXT)
_OPENC = ", ".join(f"max({c}) FILTER (kind IN ('article', 'issuance')) AS {c}" for c in S.CONTEXT)
CONTEXT = CTES + _carry()
ARTICLES = f"""{CONTEXT}, sessions AS (SELECT doc_id, session, max(kind) FILTER (kind IN ('article', 'issuance')) AS k, max(number) FILTER (kind IN ('article', 'issuance')) AS n, min(pos) FILTER (kind IN ('article', 'issuance')) AS pos, {_OPENC},
  max(page_number) FILTER (kind IN ('article', 'issuance')) AS page_start, max(page_number) FILTER (kind IN ('article', 'issuance') OR (kind = 'body' AND NOT closed)) AS page_end,
  coalesce(string_agg(CASE WHEN kind = 'body' THEN line ELSE seed END, ' ' ORDER BY pos) FILTER ((kind = 'body' AND NOT closed) OR seed IS NOT NULL), '') AS b FROM context WHERE session > 0 GROUP BY doc_id, session),
articles AS (SELECT doc_id, pos, CASE WHEN k = 'issuance' THEN 'issuance' ELSE 'substantive' END AS article_type, CASE WHEN k <> 'issuance' THEN n END AS article_number, CASE WHEN k = 'issuance' THEN n END AS issuance_number, {D.format_clause_structure("b")} AS body,
  'active' AS article_status, NULL AS repealed_range, {_CTX}, page_start, page_end FROM sessions
  UNION ALL SELECT doc_id, pos, 'substantive', NULL, NULL, 'المواد من ' || number || ' إلى ' || number2 || ' ملغاة', 'repealed', number || '-' || number2, {_CTX}, page_number, page_number FROM context WHERE kind = 'range')
SELECT *, CASE WHEN repealed_range IS NULL THEN length(body) ELSE 0 END AS char_count FROM articles"""


_ITEM = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice".split(", ")
_PART = ", ".join(f"CASE WHEN {test} THEN named_struct('k', {k}, 'j', 0, 'line', {line}) END" for k, test, line in _PARTS)
#: Of an order's first row the lines of _PARTS that are its own, and of the first of equal items theirs.
_LINES_OF = f"""concat(CASE WHEN _row = 1 THEN filter(array({_PART}), x -> x IS NOT NULL) ELSE array() END,
  CASE WHEN l.l_orderkey IS NOT NULL AND _rank = _row THEN array(named_struct('k', 100, 'j', _j, 'line', {_BODY})) ELSE array() END)"""


def law_lines(t):
    """The rows of LAW_LINES, dealt by doc_id: orders with their items are exchanged as numbers, and their lines are written behind that."""
    items = t["lineitem"].select("l_orderkey", *_ITEM)
    rows = t.sql(_N).join(items, F.col("o") == F.col("l_orderkey"), "left").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c")
    order = W.partitionBy("c", "n").orderBy(*_ITEM)
    rows = rows.withColumns({"_j": F.dense_rank().over(order), "_rank": F.rank().over(order), "_row": F.row_number().over(order)}).alias("l")
    rows = rows.select("c", "n", F.expr(_LINES_OF).alias("lines")).select("c", "n", F.inline_outer("lines")).where("k is not null")
    return rows.select(F.col("c").alias("doc_id"), F.floor((F.col("n") + 3) / 4).cast("int").alias("page_number"), F.expr("n * 1000000 + k * 1000 + j").alias("pos"), "line")


def _rows(t):
    return S.normalised(law_lines(t), dealt=True)


def _classified(t, **only):
    return S.classify(_rows(t), **only)


def articles_of(t):
    return S.slice_articles(S.with_context(_classified(t)))


@query(f"SELECT doc_id, page_number, pos, line, {D.normalize('line')} AS norm, (contains({D.normalize('line')}, 'الجريدة الرسمية') AND contains({D.normalize('line')}, 'العدد')) OR {_m(_asc('line'), '^[0-9]+$')} AS furniture, lead(line) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS following FROM ({LAW_LINES})")
def l1_lines(t):
    """L1, L2: the line stream with its normal form, page furniture and what follows on the page."""
    return _rows(t).select("doc_id", "page_number", "pos", "line", "norm", "furniture", "following")


@query(f"SELECT doc_id, i AS pos, trim(part, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {{documents}})) WHERE trim(part, ' ' || chr(9) || chr(13)) <> ''".replace("{{", "{").replace("}}", "}"))
def l1_document_lines(t):
    """L1 over documents as pages of one."""
    pages = t["documents"].select("doc_id", F.lit(0).alias("page_number"), "text")
    return S.lines(pages).select("doc_id", "pos", "line")


#: The same with title lines joined in the order of their place, which a window's own order does not promise to string_agg.
TITLED = CTES.replace("string_agg(line, ' ') FILTER", "string_agg(line, ' ' ORDER BY pos) FILTER")


@query(TITLED.rstrip().rstrip(",") + " SELECT doc_id, page_number, pos, line, kind, number, number2, title, seed, session, closed FROM classified")
def l11_classification(t):
    """Every line's kind, number, title, seed and session."""
    return _classified(t).drop(*S.CONTEXT)


_DETECT = " ".join(f"WHEN {_m('norm', p)} THEN '{k}'" for k, p in S.BARE.items())


@query(
    CTES.rstrip().rstrip(",")
    + f""" SELECT doc_id, page_number, pos, level, number, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM (SELECT *, CASE {_DETECT} WHEN {_m("na", S.ARTICLE)} THEN 'article' END AS level,
    coalesce({", ".join(_ord(_g("norm", p)) for p in S.BARE.values())}, {_num(_g("na", S.ARTICLE))}) AS number FROM l1) WHERE level IS NOT NULL"""
)
def l14_detect_structure(t):
    """Bare headers and article headers alone, in order."""
    return S.detect_structure(_rows(t))


@query(f"{CONTEXT} SELECT doc_id, pos, {_CTX} FROM context")
def l15_context_carry(t):
    """The hierarchy in force at every line."""
    return S.with_context(_classified(t)).select("doc_id", "pos", *S.CONTEXT)


@query(f"{CTES.rstrip().rstrip(',')} SELECT doc_id, session, min(pos) FILTER (kind IN ('article', 'issuance')) AS pos, count(*) FILTER (kind = 'body' AND NOT closed) AS n_lines FROM classified WHERE session > 0 GROUP BY ALL")
def l16_sessions(t):
    """Articles as sessions and the lines that are theirs."""
    opening = F.col("kind").isin(*S.OPENING)
    lines = _classified(t, columns=("doc_id", "pos", "kind", "session", "closed"))
    return lines.where("session > 0").groupBy("doc_id", "session").agg(F.min(F.when(opening, F.col("pos"))).alias("pos"), F.count_if((F.col("kind") == "body") & ~F.col("closed")).alias("n_lines"))


@query(f"{CONTEXT} SELECT doc_id, pos, number, number2, {_CTX} FROM context WHERE kind = 'range'")
def l20_repealed_ranges(t):
    """Repealed ranges with their place."""
    return S.with_context(_classified(t, kinds=("range",), columns=("doc_id", "pos", "number", "number2", *S.CONTEXT)))


@query(f"{CTES.rstrip().rstrip(',')} SELECT doc_id, pos, line, kind FROM classified WHERE kind IN ('subsection', 'label') OR (kind = 'body' AND closed)")
def l21_diagnostics(t):
    """Labels, and lines outside any article."""
    labels, loose = S.diagnostics(_classified(t))
    labels = labels.select("doc_id", "pos", "line", F.when(F.col("has_colon"), "subsection").otherwise("label").alias("kind"))
    return labels.unionByName(loose.select("doc_id", "pos", "line", F.lit("body").alias("kind")))


@query(ARTICLES)
def l22_slice_articles(t):
    """Article records."""
    return articles_of(t)


def _of_kinds(name: str, doc: str, kinds: tuple[str, ...], columns: str, ctes: str = CTES):
    """A query of the classified lines of some kinds."""

    def run(t):
        return _classified(t, kinds=kinds, columns=tuple(columns.split(", ")))

    run.__name__, run.__doc__ = name, doc
    query(f"{ctes.rstrip().rstrip(',')} SELECT {columns} FROM classified WHERE {_any('kind', kinds)}")(run)


_of_kinds("l3_structural_headers", "L3, L4, L5: headers of every level with their ordinals as numbers.", S.STRUCTURAL, "doc_id, pos, kind, number, number2")
_of_kinds("l6_article_headers", "L6, L18: article headers alone or glued to their text, with the text that follows.", ("article",), "doc_id, pos, number, seed")
_of_kinds("l7_issuance_headers", "L7: enacting articles, before the first structural header.", ("issuance",), "doc_id, pos, number, seed")
_of_kinds("l8_range_lines", "L8: repealed ranges.", ("range",), "doc_id, pos, number, number2")
_of_kinds("l9_sections", "L9: sections and labels before articles.", ("section", "subsection"), "doc_id, pos, kind, number, title")
_of_kinds("l10_labels", "L10: labels before repealed ranges.", ("label",), "doc_id, pos, title")
_of_kinds("l12_titles", "L12, L13: titles of headers, from the lines below or the line itself.", S.STRUCTURAL, "doc_id, pos, title", TITLED)


@query(f"SELECT doc_id, pos, body, char_count FROM ({ARTICLES})")
def l19_bodies(t):
    """Bodies with their clauses on lines of their own."""
    return articles_of(t).select("doc_id", "pos", "body", "char_count")


@query(f"SELECT doc_id, session, coalesce(bool_or(flagged), false) AS open_list FROM (SELECT doc_id, session, kind = 'body' AND NOT closed AND {_m(_asc('line'), S.SECTION)} AS flagged FROM ({CTES.rstrip().rstrip(',')} SELECT * FROM classified) WHERE session > 0) GROUP BY ALL")
def l17_open_lists(t):
    """Articles whose opening sentence announces a list, as seen from section-shaped lines that stay theirs."""
    kept = (F.col("kind") == "body") & ~F.col("closed") & A.arabic_to_ascii(F.col("line")).rlike(S.SECTION)
    return _classified(t).where("session > 0").groupBy("doc_id", "session").agg(F.bool_or(kept).alias("open_list"))
