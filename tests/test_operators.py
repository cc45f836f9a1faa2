"""Operators against small cases, folds and themselves."""

import os
import re
import time
import weakref
from collections import Counter, deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import arabic as A
from daftar.functions import vectors as V
from daftar.operators import engine as E
from daftar.operators import guard as G
from daftar.operators import laws as L
from daftar.operators import quality as Q
from daftar.operators import retrieval as R
from daftar.operators import structure as ST
from daftar import plans
from daftar.plans import queries_engine as QE
from daftar.plans import queries_quality as QQ
from daftar.plans import queries_retrieval as QR
from daftar.plans import queries_stores as QS
from daftar.plans import queries_structure as QSt
from daftar.plans.base import Tables
from daftar.sources import stores as S

from .conftest import SF


def statute(spark, *lines):
    text = "\n".join(lines)
    return ST.classify(ST.lines(spark.createDataFrame([("law", 1, text)], "doc_id string, page_number int, text string")))


def articles(spark, *lines):
    return ST.slice_articles(ST.with_context(statute(spark, *lines))).orderBy("pos").collect()


def test_hierarchy_resets_below_and_repeats_fill_titles(spark):
    got = articles(
        spark, "الكتاب الأول", "الباب الأول – أول", "الفصل الأول - فصل", "مادة 1", "نص.", "الكتاب الأول", "عنوان متأخر", "مادة 2", "نص.", "الكتاب الثاني - ثان", "مادة 3", "نص."
    )
    assert [(a.book_number, a.book_title, a.part_number, a.chapter_number) for a in got] == [(1, None, 1, 1), (1, "عنوان متأخر", 1, 1), (2, "ثان", None, None)]


def test_cross_references_are_no_headers(spark):
    kinds = [r.kind for r in statute(spark, "الباب الرابع", "الباب الرابع من الكتاب الثاني من قانون العقوبات", "المادة، 864 فإن", "مادة (1) – 1تسري").orderBy("pos").collect()]
    assert kinds == ["part", "title", "title", "article"]


def test_glued_header_keeps_its_clause(spark):
    got = articles(spark, "الكتاب الأول - ك", "مادة (1) – 1تسري النصوص")
    assert (got[0].article_number, got[0].body) == (1, "(1) تسري النصوص")


def test_open_list_stays_in_its_article(spark):
    got = articles(spark, "الكتاب الأول - ك", "مادة 52", "الأشخاص الاعتبارية هي :", "-1 الدولة", "-2 الهيئات", "مادة 53", "نص.", "-1 البيع بوجه عام", "مادة 54", "نص.")
    assert "الدولة" in got[0].body and [a.section_number for a in got] == [None, None, 1]


def test_issuance_only_before_structure(spark):
    got = articles(spark, "المادة الأولى", "يعمل به.", "الكتاب الأول - ك", "المادة الثانية", "مادة 1", "نص.")
    assert [(a.article_type, a.issuance_number, a.article_number) for a in got] == [("issuance", 1, None), ("substantive", None, 1)]


def test_range_expands_to_complete_numbers(spark):
    from daftar.operators.chunks import expand_repealed

    got = ST.slice_articles(ST.with_context(statute(spark, "الكتاب الأول - ك", "مادة 53", "نص.", "المواد من 54إلى 80ملغاة", "مادة 81", "نص.")))
    rows = expand_repealed(got).withColumn("law_number", F.lit(1))
    found = Q.integrity(rows).first()
    assert (found.total, found.least, found.largest, found.is_complete) == (29, 53, 81, True)


def test_fusion_ignores_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    assert sorted(R.rrf([a, b], 5).collect()) == sorted(R.rrf([b, a], 5).collect())
    assert R.rrf([a, b], 1).first()["chunk_id"] == "y"


def test_rerank_rejects_too_many(spark):
    rows = spark.range(3).select(F.lit(1).alias("query_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("double").alias("score"))
    assert R.rerank(rows, 2, 3).count() == 2
    with pytest.raises(Exception, match="too many passages"):
        R.rerank(rows, 2, 2).collect()


def test_guard_flags_an_article_that_was_not_retrieved(spark):
    context = spark.createDataFrame([(1, 1, "c", "القانون المدني رقم ١٣١ لسنة ١٩٤٨", 5, "المادة 5")], "conv_id int, turn int, chunk_id string, law_name string, article_number int, citation_label string")
    raw = '{"answer_text": "المادة 999", "citations": [{"law_name": "القانون المدنى رقم ١٣١ لسنة ١٩٤٨", "article_number": %d, "citation_label": "x"}]}'
    answers = spark.createDataFrame([(1, 1, 1, raw % 999), (1, 1, 2, raw % 5), (1, 0, 1, raw % 5)], "conv_id int, turn int, attempt int, raw string")
    results = G.verify(G.parsed(answers), context)
    assert {(r.turn, r.attempt): (r.is_valid, r.n_unverified_inline) for r in results.collect()} == {(1, 1): (False, 1), (1, 2): (True, 1), (0, 1): (False, 1)}
    assert {r.turn: (r.chosen_attempt, r.used_fallback) for r in G.decide(results).collect()} == {1: (2, False), 0: (None, True)}


def test_upsert_twice_is_once(spark):
    stored = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, seq int, v string")
    batch = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "id int, seq int, v string")
    once = S.upsert(stored, batch, "id", "seq")
    assert sorted(S.upsert(once, batch, "id", "seq").collect()) == sorted(once.collect()) == [(1, 0, "a"), (2, 2, "d"), (3, 1, "e")]


def test_empty_chunk_folder_is_an_error(spark, tmp_path):
    S.write_records(spark.createDataFrame([], S.CHUNK_SCHEMA), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no chunks"):
        S.read_chunks(spark, str(tmp_path / "c"))


def fold(rows, limit, seconds):
    out, held = {}, {}
    for key, id_, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        h = held.setdefault(key, deque())
        while h and (ts - h[0]).total_seconds() >= seconds:
            h.popleft()
        out[id_] = len(h) < limit
        if out[id_]:
            h.append(ts)
    return out


def test_rate_limit_of_runs_over_many_slices(spark):
    """A key with a third of the rows, with and without pauses: several runs in several tasks, the same decisions."""
    rng, start = np.random.default_rng(4), datetime(2024, 1, 1)
    seconds = np.cumsum(rng.choice([1, 20, 59, 60, 61, 700], 3000))
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, start + timedelta(seconds=int(x), microseconds=i % 2)) for i, x in enumerate(seconds)] + [("hot", 9000 + i, start + timedelta(seconds=5)) for i in range(9)]
    given = spark.createDataFrame(rows, "key string, id int, ts timestamp").repartition(5)
    for limit, width in ((1, 60), (3, 90), (2, 1)):
        assert {r.id: r.accepted for r in Q.rate_limited(given, limit, width).collect()} == fold(rows, limit, width)
    runs = Q.independent_runs(given, 60).where("key = 'hot'").groupBy("start").count()
    assert runs.count() > 100
    lone = Q.rate_limited(spark.createDataFrame([(None, 1, start), (None, 2, start)], "key string, id int, ts timestamp"), 1, 60)
    assert sorted(r.accepted for r in lone.collect()) == [False, True]


def test_copies_are_compared_by_digests(spark):
    a = spark.createDataFrame([(i, "x" if i % 7 else None, [float(i), 1.0]) for i in range(500)] + [(600, "twice", [1.0]), (600, "twice", [1.0])], "k int, p string, v array<double>")
    assert Q.copy_differences(a, a.repartition(3), "k", ("p",), "v").count() == 0
    near = F.transform("v", lambda x: F.when(F.col("k") == 9, x + 1e-9).when(F.col("k") == 11, -x).otherwise(x))
    b = a.where("k <> 5").withColumn("p", F.when(F.col("k") == 14, "filled").when(F.col("k") == 15, None).otherwise(F.col("p"))).withColumn("v", near)
    b = b.unionByName(spark.createDataFrame([(-1, "new", [1.0])], a.schema))
    for buckets in (1, 64, 4096):
        got = {r.k: r.status for r in Q.copy_differences(a, b, "k", ("p",), "v", buckets=buckets).collect()}
        assert got == {5: "missing", -1: "extra", 14: "payload", 15: "payload", 11: "vector"}
    plan = Q.copy_differences(a, a, "k", ("p",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_percentiles_by_force(spark):
    rng = np.random.default_rng(5)
    values = [("a", float(x)) for x in rng.exponential(50, 4000)] + [("b", 7.0)] * 1000 + [("c", float(x)) for x in rng.integers(-5, 6, 500)] + [("d", None), ("e", -0.0), (None, 3.0), (None, 4.0)]
    values += [("f", x) for x in (float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 0.0, 5e-324)]
    got = {r.g: (r.n, r.p50, r.p95) for r in Q.index_percentiles(spark.createDataFrame(values, "g string, v double").repartition(4), "g", "v").collect()}
    for g in ("a", "b", "c", "e", None, "f"):
        mine = sorted((v for k, v in values if k == g), key=lambda v: (v != v, v if v == v else 0))
        n = len(mine)
        wanted = (n, mine[n // 2], mine[min(n - 1, int(0.95 * n))])
        assert [repr(x) for x in got[g]] == [repr(x) for x in wanted] or g == "e" and got[g][1] == 0, g
    assert "d" not in got


def test_an_encoder_is_built_once_a_worker(spark, tmp_path):
    def load():
        (tmp_path / f"{os.getpid()}-{time.time_ns()}").touch()

        def encode(texts):
            assert len(texts) * max(map(len, texts)) <= 40 or len(texts) == 1
            return [((len(t),), dict.fromkeys(t, 1.0)) for t in texts]

        return encode

    rows = [(i, " ".join(f"w{k}" for k in range(i % 23))) for i in range(400)] + [(400, None)]
    made = R.encode_in_workers(spark.createDataFrame(rows, "k int, text string").repartition(12), "k", "text", "counted", load, limit=20, batch_tokens=40, window=50).collect()
    assert {r.k: (r.dense, r.indices) for r in made} == {i: ([float(min(20, len((t or "").split())))], sorted(set((t or "").split()[:20]))) for i, t in rows}
    built = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(built) == len(set(built))


def test_law_lines_are_written_behind_one_exchange_of_numbers(spark):
    """The same rows as the SQL's, of orders without items and items that are equal too; no text is exchanged, and no
    generated method is too long for the JVM to compile."""
    orders = spark.range(60).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey")
    items = spark.range(300).where("id % 60 % 7 <> 2").selectExpr("id % 60 AS l_orderkey", "id % 4 AS l_partkey", "1L AS l_suppkey", "CAST(id % 5 % 3 AS INT) AS l_linenumber", "1.0D AS l_quantity", "2.0D AS l_extendedprice")

    class Given(Tables):
        def __getitem__(self, name):
            return {"orders": orders, "lineitem": items}[name]

    t = Given(spark, "")
    assert sorted(QSt.law_lines(t).collect()) == sorted(t.sql(QSt.LAW_LINES).collect())
    t = Tables(spark, SF)
    found = QSt._classified(t, kinds=("section",), columns=("doc_id", "line"))
    assert sorted(found.collect()) == sorted(QSt._classified(t).where("kind = 'section'").select("doc_id", "line").collect())
    plan = found._jdf.queryExecution()
    code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    assert not re.search(r"hashpartitioning\([^)]*(line#|doc_id)", plan.executedPlan().treeString())


def test_a_sentence_after_title_lines_of_the_page_before_ends_an_articles_first(spark):
    """title lines end sentences too, but say nothing of the article's first sentence, which a later page ends."""
    rows = [("d", 1, 1, "مادة (1)"), ("d", 1, 2, "الفصل الثالث"), ("d", 1, 3, "عنوان."), ("d", 2, 4, "الأشخاص هي:"), ("d", 2, 5, "-1 الدولة"), ("d", 2, 6, "نص.")]
    given = spark.createDataFrame(rows, "doc_id string, page_number int, pos int, line string")
    kinds = [r.kind for r in sorted(ST.classify(ST.normalised(given)).collect(), key=lambda r: r.pos)]
    assert kinds == ["article", "chapter", "title", "body", "body", "body"]


@pytest.mark.parametrize("per_block", [1, 3])
def test_a_document_in_blocks_of_pages_reads_as_in_one(spark, per_block):
    """Each document of the given lines, and all of them as one document, with its pages in blocks."""
    t = Tables(spark, SF)
    lines = t.sql(QSt.LAW_LINES)
    long_ = lines.select(F.lit("all").alias("doc_id"), (F.dense_rank().over(W.orderBy("doc_id", "page_number"))).cast("int").alias("page_number"), F.row_number().over(W.orderBy("doc_id", "pos")).cast("long").alias("pos"), "line")
    for given in (lines, long_):
        whole = ST.classify(ST.normalised(given))
        parts = ST.classify(ST.normalised(given, per_block))
        order = sorted(whole.columns)
        one, other = (sorted(map(repr, df.select(*order).collect())) for df in (whole, parts))
        assert len(one) > 100 and one == other


def test_rate_limit_matches_a_fold(spark):
    start = datetime(2024, 1, 1)
    rows = [("a" if i % 3 else "b", i, start + timedelta(seconds=i * 37 % 4000)) for i in range(300)]
    got = Q.rate_limited(spark.createDataFrame(rows, "key string, id int, ts timestamp"), 5, 600)
    assert {r.id: r.accepted for r in got.collect()} == fold(rows, 5, 600)


def test_streamed_rate_flags_match_the_batch(spark):
    from daftar import plans

    batch = {r.id: r.accepted for r in Q.rate_limited(Tables(spark, SF).sql(QQ.REQUESTS), 2, 86_400).collect()}
    stream = {r.id: r.accepted for r in plans.queries()["st3_rate_flags"](spark, SF).collect()}
    assert stream == batch


def test_a_chunk_without_a_vector_is_an_error(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    stored = spark.createDataFrame([], "chunk_id string, text string, dense array<double>, point_id string")
    some = lambda c: c.where("chunk_id = 'a'").select("chunk_id", F.array(F.lit(1.0)).alias("dense"))
    with pytest.raises(Exception, match="no vector for b"):
        S.ingest(chunks, stored, some).collect()
    assert S.ingest(chunks, stored, lambda c: R.encode_all(c.withColumn("text", F.lit("")), "chunk_id", "text")).count() == 2


def test_plans_push_filters_and_columns_to_the_scan(spark):
    t = Tables(spark, SF)
    plan = t["documents"].where("doc_id = 5").select("lang")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "text" not in plan
    context = ST.with_context(ST.classify(ST.normalised(spark.createDataFrame([("d", 1, 1, "x")], "doc_id string, page_number int, pos long, line string"))))
    assert context._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_monitored_rows_are_written_by_as_many_tasks_as_the_table_has_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(QS, "folder", lambda t: f"file://{tmp_path}/st4")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    rates = QS.st4_score_rates(Tables(spark, f"file://{tmp_path}"))
    parts = lambda name: len(list((tmp_path / "st4" / name).glob("part-*.parquet")))
    assert parts("scores") >= 3 and parts("rates") >= 1
    assert rates.where("name <> 'close'").agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("top_k", [R.dense_top_k, R.sparse_top_k])
def test_large_query_tables_come_in_parts(spark, monkeypatch, top_k):
    t = Tables(spark, SF)
    queries, points = t.sql(QR.QUERIES), t.sql(QR.POINTS)
    whole = sorted(top_k(queries, points, 7, ("law_number",)).collect())
    monkeypatch.setattr(R, "BROADCAST_BYTES", 20_000), monkeypatch.setattr(R, "SCORE_BYTES", 1_000)
    found = sorted(top_k(queries, points, 7, ("law_number",)).collect())
    assert [(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in found] == [(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in whole]
    assert top_k(queries.limit(0), points, 7).count() == top_k(queries, points.limit(0), 7).count() == 0


@pytest.mark.parametrize("name", ["v3_dense_top_k", "v4_sparse_top_k", "v6_hybrid_search", "v9_search_articles", "v11_lookup_article", "v12_article_by_number", "v14_smart_search", "v15_encoded_search"])
def test_retrieval_plans_list_no_pairs(spark, name):
    plan = plans.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_golden_questions_through_the_whole_engine(spark):
    """Two laws from raw pages on; questions by number (one of a repealed article), and two in words."""
    civil = [
        "المادة الأولى", "يعمل بهذا القانون.", "باب تمهيدي - أحكام عامة", "مادة 5", "يخضع استعمال الحق لحسن النية.", "تنازع القوانين من حيث الزمان:", "مادة 6", "النصوص المتعلقة بالأهلية تسري عند تنازع القوانين من حيث الزمان.",
        "مادة 7", "تسري النصوص الجديدة المتعلقة بالتقادم.", "\f", "الكتاب الأول - الالتزامات", "مادة 53", "الشخص الاعتباري يتمتع بجميع الحقوق.", "المواد من 54إلى 80ملغاة", "مادة 81", "كل شيء غير خارج عن التعامل يصح أن يكون محلا.",
    ]
    criminal = [
        "الكتاب الثاني - المحاكم", "الفصل الثالث - تنازع الاختصاص", "مادة (٢٢٢)", "إذا قدمت دعوى إلى جهتين كان تنازع الاختصاص وتتخذ الاجراءات أمام المحكمة.", "مادة (٢٢٣)", "إذا صدر حكمان متناقضان.", "\f", "الكتاب الثالث - الطعن",
        "مادة (٥٠٠)", "ميعاد الطعن ستون يوما.",
    ]
    raw = spark.createDataFrame([("civil", "\n".join(civil).replace("كل", "آل")), ("criminal", "\n".join(criminal)), ("lost", "مادة 1\nنص.")], "doc_id string, raw string")
    laws = L.laws_table(spark).withColumn("doc_id", F.when(F.col("law_number") == 131, "civil").otherwise("criminal"))
    chunks = E.statute_chunks(raw, laws).cache()
    found = {r.chunk_id: r for r in chunks.collect()}
    assert found["131-1948-art-81"].body_faithful.startswith("كل شيء")  # the glyph fault of that law is mended
    assert found["131-1948-issuance-1"].body_faithful == "يعمل بهذا القانون." and found["131-1948-art-6"].subsection_title == "تنازع القوانين من حيث الزمان"
    assert len(found) == 1 + 3 + 1 + 27 + 1 + 3 and found["174-2025-art-222"].chapter_title == "تنازع الاختصاص"
    asked = [
        (1, "المادة 5 من القانون المدني", "lookup", "131-1948-art-5"), (2, "كيف يتعامل القانون المصري مع تنازع القوانين عبر الزمان", "ranked", "131-1948-art-6"),
        (3, "ايه الاجراءات الماخوذة في حالة تنازع الاختصاص", "ranked", "174-2025-art-222"), (4, "ما هو نص المادة 500 من قانون الاجراءات الجنائية؟", "lookup", "174-2025-art-500"),
        (5, "ما هو نص المادة 70 من القانون المدني؟", "lookup", "131-1948-art-70"),
    ]
    queries = spark.createDataFrame([r[:2] for r in asked], "query_id int, text string")
    hits = E.answers(queries, E.points(chunks).cache(), 5).collect()
    for query_id, _, route, chunk_id in asked:
        mine = {r.chunk_id: r for r in hits if r.query_id == query_id}
        assert chunk_id in mine and {r.route for r in mine.values()} == {route}
        assert route == "ranked" or len(mine) == 1
    assert {r.article_status for r in hits if r.query_id == 5} == {"repealed"}


def sparse_rows(seed, n, signed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        terms = rng.choice(400, rng.integers(0, 25), replace=False)
        weights = rng.exponential(1.0, len(terms)) * (rng.choice([1, -1], len(terms)) if signed else 1)
        if i % 9 == 0 and rows:
            terms, weights = rows[-1][1:3]  # ties
        rows.append((i, terms, weights, int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("signed, full", [(False, 0), (True, 0), (True, 65_536)])
def test_sparse_search_by_force(spark, monkeypatch, signed, full):
    """Small blocks, so that thresholds come from a first pass; ties, filters, empty vectors, both signs."""
    monkeypatch.setattr(R, "SPARSE_POINTS", 32)
    search = R.SparseBlock.search
    monkeypatch.setattr(R.SparseBlock, "search", lambda self, *a, **o: search(self, *a, **{"full": full} | o))
    points, asked = sparse_rows(1, 3000, signed), sparse_rows(2, 40, signed)
    frame = lambda rows, key: spark.createDataFrame([(i, [f"t{x}" for x in t], [float(x) for x in w], None if key == "query_id" and i % 2 else f) for i, t, w, f in rows], f"{key} int, indices array<string>, values array<double>, f int")
    index = R.sparse_index(frame(points, "chunk_id").coalesce(4), ("f",))
    assert index.count() >= 90
    got = {}
    for r in R.sparse_search(frame(asked, "query_id"), index, 6, ("f",)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, round(r.score, 9))
    dense = np.zeros((len(points), 400))
    has = np.zeros((len(points), 400), bool)
    for i, t, w, _ in points:
        dense[i, t], has[i, t] = w, True
    for q, t, w, f in asked:
        scores, shares = np.round(dense[:, t] @ w, 9), has[:, t].any(1)
        ok = [i for i in range(len(points)) if shares[i] and (q % 2 or points[i][3] == f)]
        best = sorted(ok, key=lambda i: (-scores[i], i))[:6]
        assert [c for _, (c, _) in sorted(got.get(q, {}).items())] == best
        assert [s for _, (_, s) in sorted(got.get(q, {}).items())] == pytest.approx([scores[i] for i in best])


def test_fewer_postings_are_read_for_fewer_results(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"t{x}" for x in rng.choice(50, 10, replace=False)], [float(x) for x in rng.exponential(1.0, 10) ** 3]) for i in range(4000)]
    index = R.sparse_index(spark.createDataFrame(rows, "chunk_id int, indices array<string>, values array<double>").coalesce(1)).collect()
    assert len(index) == 1
    block = R.SparseBlock(index[0].asDict())
    terms, weights = np.arange(8), np.ones(8)
    of = int((block.starts[terms + 1] - block.starts[terms]).sum())
    read = [block.search(terms, weights, k, -np.inf, None, full=0)[2] for k in (1, 10, 100, 4000)]
    assert read == sorted(read) and read[0] < 0.35 * of and read[-1] == of
    points, scores, _ = block.search(terms, weights, 10, -np.inf, None, full=0)
    whole = block.search(terms, weights, 10, -np.inf, None)
    assert whole[2] == of and sorted(zip(whole[0], whole[1].round(9))) == sorted(zip(points, scores.round(9)))
    tenth = np.sort(scores)[-10]
    assert block.search(terms, weights, 10, round(float(tenth), 9), None, full=0)[2] <= read[1]


def test_bad_sparse_vectors_are_errors(spark):
    for indices, values in ((["a", "a"], [1.0, 2.0]), (["a"], [1.0, 2.0]), (["a"], [float("nan")])):
        with pytest.raises(Exception, match="sparse vector"):
            R.sparse_index(spark.createDataFrame([(1, indices, values)], "chunk_id int, indices array<string>, values array<double>")).collect()


def test_many_short_queries_stay_small(spark):
    """200,000 queries in one part: a task's scores stay near SCORE_BYTES."""
    queries = spark.range(200_000).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("dense"))
    points = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(F.cos(F.col("id") / 8), F.sin(F.col("id") / 8)).alias("dense")).coalesce(1)
    got = R.dense_top_k(queries, points, 1).select("query_id", "chunk_id").collect()
    assert len(got) == 200_000
    x = np.arange(200_000)
    angle = np.abs((x[:, None] - np.arange(50)[None, :] / 8 + np.pi) % (2 * np.pi) - np.pi)
    near = angle.min(1)
    assert all(angle[r.query_id, r.chunk_id] < near[r.query_id] + 1e-4 for r in got)


def test_texts_are_encoded_where_they_lie(spark):
    """The default encoder moves no row and no term; points carry their vectors without a join."""
    chunks = spark.createDataFrame([("a", "الدولة مسؤولة الدولة"), ("b", ""), ("c", None)], "chunk_id string, text_for_embedding string")
    held = E.points(chunks)
    for plan in (R.encode(chunks, "chunk_id", "text_for_embedding"), held):
        assert "Exchange" not in plan._jdf.queryExecution().toString()
    found = {r.chunk_id: r.dense for r in held.collect()}
    assert len(found) == 3 and found["b"] == found["c"] == [0.0] * 64 and abs(sum(x * x for x in found["a"]) - 1) < 1e-12
    assert [r.chunk_id for r in R.encode(chunks, "chunk_id", "text_for_embedding").collect()] == ["a"]


def test_blocks_are_searched_where_points_lie(spark):
    """The points' postings never travel as an index between two workers, and no step makes a whole batch's terms into Python strings."""
    t = Tables(spark, SF)
    plan = R.sparse_top_k(t.sql(QR.QUERIES), t.sql(QR.POINTS), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "row_weights" not in plan
    words = ["b", "a", "b", "\ufb01", "\U0001f600", "م"]
    lists = [words, [], words * 3, ["a"]]
    counted = R.term_counts(pa.array(lists, pa.list_(pa.string()))).to_pylist()
    assert [list(zip(r["indices"], r["values"], strict=True)) for r in counted] == [sorted(Counter(x).items()) for x in lists]


def test_hits_leave_a_block_in_parts(spark, monkeypatch):
    t = Tables(spark, SF)
    whole = sorted(R.sparse_top_k(t.sql(QR.QUERIES), t.sql(QR.POINTS), 7, ("law_number",)).collect())
    monkeypatch.setattr(R, "HITS", 5)
    assert sorted(R.sparse_top_k(t.sql(QR.QUERIES), t.sql(QR.POINTS), 7, ("law_number",)).collect()) == whole


def test_vectors_of_a_batch_in_slices(spark):
    """F8: 2,500 texts in one batch, more than a slice: each text's own vector, null without terms."""
    texts = spark.createDataFrame([(i, None if i % 7 == 0 else f"w{i % 11} w{i % 5} w{i % 11}") for i in range(2_500)], "id int, t string").coalesce(1)
    got = {r.id: r.v for r in texts.select("id", R.dense_of("t").alias("v")).collect()}
    few = {r.id: r.v for r in texts.where("id >= 1000 and id < 1056").select("id", R.dense_of("t").alias("v")).collect()}
    for i in range(2_500):
        assert (got[i] is None) if i % 7 == 0 else abs(sum(x * x for x in got[i]) - 1) < 1e-12
    assert all(got[i] == v for i, v in few.items())


def test_lookups_meet_the_first_articles_only(spark):
    """300 questions for one number that 400 articles have make no 120,000 pairs; results as by force, with nulls and copies of ids."""
    numbers = lambda n: None if n % 9 == 0 else n % 2
    points = [(f"c{i % 390:04}", numbers(i), None if i % 4 else 0, "issuance" if i % 4 == 0 else "substantive", i % 3 or None, 2000 + i % 2, i % 5) for i in range(400)]
    refs = [(q, q % 2, (None, "substantive", "issuance")[q % 3], (None, 1, 2)[q % 5 % 3], None if q % 7 else 2001, None if q % 4 else q % 5) for q in range(300)]
    held = spark.createDataFrame(points, "chunk_id string, article_number int, issuance_number int, article_type string, law_number int, law_year int, book_number int")
    asked = spark.createDataFrame(refs, "query_id int, number int, article_type string, law_number int, law_year int, book_number int")
    found = R.lookup_article(asked, held)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, number, kind, law, year, book in refs:
        fits = {
            c for c, a, i, k, l_, y, b in points
            if ((a == number and kind in (None, "substantive")) or (i == number and kind in (None, "issuance"))) and kind in (None, k) and law in (None, l_) and year in (None, y) and book in (None, b)
        }
        assert got.get(q, []) == sorted(fits)[:5]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan
    met = R.smallest_chunks(asked.where("article_type = 'substantive'"), held.select("chunk_id", F.col("article_number").alias("number"), "article_type", "law_number"), ("number",), ("article_type", "law_number"), 5)
    assert 0 < met.count() <= 5 * 100


def test_nfkc_in_slices(spark):
    """more texts than a slice, nulls among them, are normalised each by itself."""
    texts = spark.createDataFrame([(i, None if i % 5 == 0 else f"\ufefb{i}\ufb01") for i in range(300)], "id int, t string").coalesce(1)
    got = {r.id: r.n for r in texts.select("id", A.nfkc(F.col("t")).alias("n")).collect()}
    assert got == {i: None if i % 5 == 0 else f"لا{i}fi" for i in range(300)}


def test_few_texts_are_encoded_at_a_time(spark):
    """of a batch of 1,500 pairs no more than some 500 texts' vectors are alive at once; scores as pair by pair."""
    alive = [0]

    def encoder(tokens):
        made = V.hashed_token_vectors(tokens)
        alive[0] += 1
        if alive[0] > 600:
            raise MemoryError("too many texts")
        weakref.finalize(made, lambda: alive.__setitem__(0, alive[0] - 1))
        return made

    pairs = spark.createDataFrame([(i, i, f"a{i} b{i % 3}", f"b{i % 2} c{i}") for i in range(1_500)], "query_id int, chunk_id int, q string, p string").coalesce(1)
    got = {r.query_id: r.score for r in R.late_interaction(pairs, "q", "p", encoder=encoder).collect()}
    one = lambda i: (V.hashed_token_vectors([f"a{i}", f"b{i % 3}"]) @ V.hashed_token_vectors([f"b{i % 2}", f"c{i}"]).T).max(1).mean()
    assert len(got) == 1_500 and all(abs(got[i] - one(i)) < 1e-12 for i in range(0, 1_500, 13))


def test_few_points_are_scored_in_double_precision(monkeypatch):
    """Single precision names the points that can be among the nearest: few of all pairs, and none is missed, ties and copies included."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x[1::50] = x[0]  # copies
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    asked, scored = x[::40], []
    keep = R._Nearest._keep
    monkeypatch.setattr(R._Nearest, "_keep", lambda self, rows, *a: (scored.append(len(rows)), keep(self, rows, *a))[1])
    nearest = R._Nearest(asked, 5, np.full(len(asked), -np.inf))
    for i in range(0, len(x), 500):
        nearest.add(np.arange(len(asked)), x[i : i + 500], np.arange(i, i + 500))
    want = np.argsort(-np.round(asked @ x.T, 9), axis=1, kind="stable")[:, :5]
    assert (nearest.at == want).all() and sum(scored) < 0.1 * len(x) * len(asked)


def test_thresholds_of_a_first_search_change_no_result(spark, monkeypatch):
    """Dense and sparse, with filters: the k-th best of a sample, or of the longest points, only spares work."""
    t = Tables(spark, SF)
    queries, held = t.sql(QR.QUERIES), QR.points(t)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    plain_ = [rows(f(queries, held, 4, ("law_number",))) for f in (R.dense_top_k, R.sparse_top_k)]
    reached = []
    given = R._reached
    monkeypatch.setattr(R, "_reached", lambda *a: reached.append(given(*a)) or reached[-1])
    monkeypatch.setattr(R, "HITS", 1)
    assert [rows(f(queries, held, 4, ("law_number",))) for f in (R.dense_top_k, R.sparse_top_k)] == plain_
    assert len(reached) == 2 and all(np.isfinite(x).any() for x in reached)


def test_a_sparse_threshold_rises_from_block_to_block():
    """Of later blocks only points that can enter a query's best are scored."""
    rng = np.random.default_rng(6)
    texts = [rng.zipf(1.4, int(n)) % 3000 for n in rng.integers(5, 200, 2400)]
    vectors = [dict(zip(*np.unique(x, return_counts=True))) for x in texts]
    words = [f"t{t}" for v in vectors[::60] for t in v]
    lengths, weight = np.array([len(v) for v in vectors[::60]]), np.array([float(n) for v in vectors[::60] for n in v.values()])
    coded = pa.array(words).dictionary_encode()
    heads, tests = R._Heads(lengths, coded, weight), R._Filters(pd.DataFrame({"_": range(len(lengths))}), ())
    least, tops, scored, got = np.full(len(lengths), -np.inf), np.full((len(lengths), 5), -np.inf), [], {}


    rows = pa.table({"chunk_id": pa.array(range(len(vectors))), "indices": [[f"t{t}" for t in v] for v in vectors], "values": [[float(n) for n in v.values()] for v in vectors]})
    for i in range(0, len(vectors), 300):
        block = R.SparseBlock(_block_of(rows.slice(i, 300)))
        exact = block.exact
        block.exact = lambda points, exact=exact: (scored.append((i, len(points))), exact(points))[1]  # noqa: B023
        known = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=block.terms), -1))
        for q, points, scores in R._block_hits(block, heads, tests, {}, known, np.asarray(coded.indices), np.cumsum(lengths), lengths, weight, least, tops, 5):
            got.setdefault(q, []).extend((-round(s, 9), i + int(p)) for p, s in zip(points, scores, strict=True))
    for q, v in enumerate(vectors[::60]):
        scores = [(-sum(n * w.get(t, 0) for t, n in v.items()), i) for i, w in enumerate(vectors)]
        assert sorted(got[q])[:5] == sorted(scores)[:5]
    late = sum(n for i, n in scored if i >= 1200)
    assert late < 0.1 * 1200 * len(lengths)


def _block_of(rows: pa.Table) -> dict:
    """A block of the index, as a search reads it."""
    indices = rows.column("indices").combine_chunks()
    coded, weight = indices.flatten().dictionary_encode(), np.asarray(rows.column("values").combine_chunks().flatten())
    lengths, terms = np.asarray(pc.list_value_length(indices), np.int64), np.asarray(coded.indices, np.int32)
    order, row = np.lexsort((-weight, terms)), np.repeat(np.arange(rows.num_rows, dtype=np.int32), lengths)
    arrays = {"row_starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "row_terms": terms, "row_weights": weight, "starts": np.concatenate([[0], np.cumsum(np.bincount(terms))]).astype(np.int64), "points": row[order], "weights": weight[order]}
    return {"chunk_id": rows.column("chunk_id").combine_chunks(), "terms": coded.dictionary} | {k: v.tobytes() for k, v in arrays.items()}


def test_expected_chunks_are_never_listed(spark):
    """Q11 by groups gives what lists of expected chunks give; its plan holds no list that grows with a group."""
    t = Tables(spark, SF)
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "a", 6), (3, "c", 1), (4, "d", 1)], "query_id long, chunk_id string, rank int")
    held = spark.createDataFrame([("a", 7, 1), ("b", 7, 2), ("c", 8, 3), ("d", None, 4)], "chunk_id string, group int, own long")
    asked = held.select(F.col("own").alias("query_id"), F.lit("open").alias("route"), "group", "own")
    expected = spark.createDataFrame([(1, "open", ["b"]), (2, "open", ["a"])], "query_id long, route string, expected array<string>")
    key = lambda df: sorted(map(str, df.select("query_id", "route", "found_rank", "hit").collect()))
    assert key(Q.evaluate_groups(hits, asked, held)) == key(Q.evaluate(hits, expected))
    plan = plans.queries()["q11_hit_rates"](t.spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_stored_vectors_are_searched_without_their_texts(spark):
    """V15 encodes texts where they lie, once: its search reads neither texts nor documents."""
    plan = plans.queries()["v15_encoded_search"](spark, SF)._jdf.queryExecution().toString()
    assert "documents" not in plan and "text" not in plan.replace("Context", "")


def test_raw_pages_are_put_together_where_their_lines_are_written(spark):
    """E1's lines are written behind the one exchange by law; pages and documents of them need none."""
    plan = QE.raw_documents(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(c#" in plan and "Exchange hashpartitioning(doc_id" not in plan
