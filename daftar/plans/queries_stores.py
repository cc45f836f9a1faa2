"""Queries of stores and streams (S4-S11, ST1-ST4). Streams read the given tables to their end and write where the session's
checkpoint folder is."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.sources import stores as S
from daftar.sources.ledger import Ledger
from daftar.streaming import jobs as J

from . import queries_guard as QG
from . import queries_quality as QQ
from . import queries_retrieval as QR
from .base import folder, query


_FIELDS = "chunk_id, law_number, article_number, citation_label, body_faithful"


@query(f"SELECT {_FIELDS} FROM ({QR.CHUNKS})")
def s4_chunk_scan(t):
    """Chunks written as JSON and read back with a declared schema."""
    chunks = t.sql(f"SELECT {_FIELDS} FROM ({QR.CHUNKS})")
    path = folder(t)
    S.write_records(chunks, path)
    return S.read_chunks(t.spark, path, chunks.schema)


@query(f"SELECT law_number, count(*) AS n, min(article_number) AS least, max(article_number) AS largest FROM ({QR.CHUNKS}) GROUP BY law_number")
def s4_array_scan(t):
    """S4, array form: files that hold one JSON array each, a file a law."""
    chunks = t.sql(f"SELECT chunk_id, law_number, article_number FROM ({QR.CHUNKS})")
    path = folder(t)
    record = F.to_json(F.struct("chunk_id", "law_number", "article_number"))
    # arrays of about a thousand records, so that no array grows with the table
    arrays = chunks.groupBy("law_number", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, chunks.count() // 1_000))).alias("_a")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    arrays.withColumn("file", F.concat_ws("-", "law_number", "_a")).select("value", "file").write.partitionBy("file").text(path)
    return S.read_chunks(t.spark, f"{path}/*", chunks.schema, arrays=True).groupBy("law_number").agg(F.count("*").alias("n"), F.min("article_number").alias("least"), F.max("article_number").alias("largest"))


@query(f"SELECT law_number, count(*) AS n FROM ({QR.CHUNKS}) GROUP BY law_number")
def s6_collection(t):
    """A table made if missing, partitioned by law; making it again keeps its rows."""
    chunks, path = t.sql(f"SELECT {_FIELDS} FROM ({QR.CHUNKS})"), folder(t)
    S.ensure_collection(t.spark, path, chunks.schema)
    S.write_records(chunks, path, "parquet", "law_number")
    S.ensure_collection(t.spark, path, chunks.schema)
    return t.spark.read.parquet(path).groupBy("law_number").agg(F.count("*").alias("n"))


BATCH = "SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1000000 END AS id, doc_id AS seq, source AS value FROM {documents} UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id + 1000000 END, doc_id + 5000000, concat(source, '!') FROM {documents}"
STORED = "SELECT doc_id AS id, doc_id AS seq, lang AS value FROM {documents}"


@query(f"WITH b AS (SELECT id, max(seq) AS seq, arg_max(value, seq) AS value FROM ({BATCH}) GROUP BY id) SELECT * FROM b UNION ALL SELECT * FROM ({STORED}) s WHERE id NOT IN (SELECT id FROM b)")
def s7_upsert(t):
    """Merged twice, which changes nothing."""
    batch = t.sql(BATCH)
    once = S.upsert(t.sql(STORED), batch, "id", "seq")
    return S.upsert(once, batch, "id", "seq")


@query(f"WITH b AS (SELECT id, max(seq) AS seq, arg_max(value, seq) AS value FROM ({BATCH}) GROUP BY id) SELECT * FROM b UNION ALL SELECT * FROM ({STORED}) s WHERE id NOT IN (SELECT id FROM b)")
def s7_ledger_upsert(t):
    """S7 as commits: a stored table, a batch, and the batch's replay, which its source's number passes over."""
    ledger = Ledger(t.spark, folder(t))
    ledger.upsert({"points": (t.sql(STORED), "id", "seq")})
    for _ in range(2):
        ledger.upsert({"points": (t.sql(BATCH), "id", "seq")}, "loader", 0)
    return ledger.read("points", t.sql(BATCH).schema)


@query("SELECT doc_id AS id, lang AS value FROM {documents} WHERE doc_id % 3 = 0")
def s6_recreate(t):
    """A collection that is made, filled, recreated empty, and filled anew."""
    ledger = Ledger(t.spark, folder(t))
    rows = t["documents"].select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    ledger.ensure("points")
    ledger.upsert({"points": (rows, "id", "value")})
    ledger.ensure("points")
    ledger.ensure("points", recreate=True)
    ledger.upsert({"points": (rows.where("id % 3 = 0"), "id", "value")})
    return ledger.read("points", rows.schema)


@query(
    f"""SELECT chunk_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id
    FROM (SELECT chunk_id, sha1(unhex('{S.NAMESPACE}') || encode(chunk_id)) AS d FROM ({QR.CHUNKS}))"""
)
def s8_point_id(t):
    """S8."""
    return t.sql(QR.CHUNKS).select("chunk_id", S.point_id(F.col("chunk_id")).alias("point_id"))


@query(f"SELECT count(*) AS given, count(*) AS stored, true AS complete, count(*) + count(*) FILTER (doc_id % 3 = 0) AS total, 64 * (count(*) + count(*) FILTER (doc_id % 3 = 0)) AS numbers, count(*) FILTER (doc_id % 3 = 0) AS old FROM ({QR.CHUNKS})")
def s9_ingest(t):
    """Chunks encoded, merged into a table that holds other points and old versions of some, and reconciled by count."""
    from daftar.operators.retrieval import encode_all

    chunks = t.sql(f"SELECT chunk_id, text FROM ({QR.CHUNKS})")
    vector = F.array_repeat(F.lit(0.5), 64).alias("dense")
    before = t.sql(f"SELECT chunk_id, doc_id, 'old' AS text FROM ({QR.CHUNKS})")
    before = before.where("doc_id % 5 = 0").unionByName(before.where("doc_id % 3 = 0").withColumn("chunk_id", F.concat(F.lit("other-"), "chunk_id")))
    before = before.select("chunk_id", "text", vector, S.point_id(F.col("chunk_id")).alias("point_id"))
    stored = S.ingest(chunks, before, lambda c: encode_all(c, "chunk_id", "text"))
    counts = stored.agg(F.count("*").alias("total"), F.sum(F.size("dense")).cast("long").alias("numbers"), F.count_if(F.col("text") == "old").alias("old"))
    return S.reconcile(chunks, stored, "chunk_id").join(counts)


@query("SELECT vec_id, label, len(embedding) AS dimension FROM {embeddings}")
def s10_copy_points(t):
    """A verbatim copy with its counts checked."""
    path = folder(t)
    S.copy_points(t.spark, f"{t.sf_dir}/embeddings.parquet", path)
    return t.spark.read.parquet(path).select("vec_id", "label", F.size("embedding").cast("long").alias("dimension"))


_CUT = "CASE WHEN vec_id % 7 = 0 THEN len(embedding) - 1 ELSE len(embedding) END"


@query(
    f"""SELECT 'same' AS given, min(len(embedding)) AS least_a, max(len(embedding)) AS largest_a, min(len(embedding)) AS least_b, max(len(embedding)) AS largest_b, true AS same_schema, true AS matches FROM {{embeddings}}
    UNION ALL SELECT 'cut', min(len(embedding)), max(len(embedding)), min({_CUT}), max({_CUT}), true, min(len(embedding)) = min({_CUT}) AND max(len(embedding)) = max({_CUT}) FROM {{embeddings}}
    UNION ALL SELECT 'other type', min(len(embedding)), max(len(embedding)), min(len(embedding)), max(len(embedding)), false, false FROM {{embeddings}}"""
)
def s11_same_configuration(t):
    """A table against itself, against one with some shorter vectors, and against one of another element type."""
    e = t["embeddings"]
    cut = e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")))
    other = e.withColumn("embedding", F.col("embedding").cast("array<double>"))
    one = lambda name, b: S.same_configuration(e, b, "embedding").withColumn("given", F.lit(name))
    return one("same", e).unionByName(one("cut", cut)).unionByName(one("other type", other))


@query("SELECT doc_id, lower(source) AS lang, length(text) AS n FROM documents UNION ALL SELECT 1000000000 + doc_id, upper(lang), length(text) FROM documents WHERE doc_id % 2 = 0")
def st1_incremental_ingest(t):
    """ST1: documents as a stream, merged into a table in two batches, then all again after the checkpoint is lost, with other values: each
    document's later row, and those rows of the first run that the second does not name."""
    path = folder(t)
    schema = T.StructType.fromDDL("doc_id long, lang string, n long")
    even = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id"), F.col("doc_id") + 1_000_000_000)).otherwise(F.array("doc_id"))
    n = F.length("text").cast("long").alias("n")
    source = lambda: t.spark.readStream.schema(t["documents"].schema).option("maxFilesPerTrigger", 4).parquet(f"{t.sf_dir}/documents.parquet*")
    first = J.incremental_ingest(source(), lambda b: b.select(F.explode(even).alias("doc_id"), F.upper("lang").alias("lang"), n), f"{path}/store", f"{path}/offsets", "doc_id", "doc_id")
    first.awaitTermination()
    again = J.incremental_ingest(source(), lambda b: b.select("doc_id", F.lower("source").alias("lang"), n), f"{path}/store", f"{path}/new-offsets", "doc_id", "doc_id")
    again.awaitTermination()
    return Ledger(t.spark, f"{path}/store").read("points", schema)


@query(f"SELECT conv_id, turn, attempt, n_valid, n_hallucinated, n_unverified_inline, is_valid, report FROM ({QG.RESULTS})")
def st2_online_audit(t):
    """ST2: answers as a stream, and again after the checkpoint is lost, with the batch verdicts as the expected rows."""
    path = folder(t)
    t.sql(QG.ATTEMPTS).repartition(3).write.parquet(f"{path}/answers")
    answers = t.spark.readStream.schema(t.sql(QG.ATTEMPTS).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/answers")
    for offsets in ("offsets", "new-offsets"):
        J.online_audit(answers, t.sql(QG.CONTEXT), f"{path}/store", f"{path}/{offsets}").awaitTermination()
    schema = T.StructType.fromDDL("conv_id long, turn long, attempt int, n_valid long, n_hallucinated long, n_unverified_inline long, is_valid boolean, report string")
    return Ledger(t.spark, f"{path}/store").read("verdicts", schema)


def _finished(t, stream, path: str):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(QQ.accepted_sql(2, 86_400))
def st3_rate_flags(t):
    """ST3 over all events, two a day."""
    path = folder(t)
    t.sql(QQ.REQUESTS).write.parquet(f"{path}/requests")
    return _finished(t, J.rate_flags(t.spark.readStream.schema(t.sql(QQ.REQUESTS).schema).parquet(f"{path}/requests"), 2, 86_400), path)


MONITORED = "SELECT CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'hallucinated_citations_count' WHEN 'view' THEN 'citations_verified_count' WHEN 'click' THEN 'used_fallback' ELSE 'inline_unverified_count' END AS name, value FROM {events} UNION ALL SELECT CAST('2030-01-01 00:00:00' AS TIMESTAMP), 'close', 0.0"


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, name, count(*) AS n, round(avg(value), 6) AS rate FROM ({MONITORED}) WHERE name <> 'close' GROUP BY ALL")
def st4_score_rates(t):
    """ST4: daily rates; the windows are complete when the stream has come to its end."""
    path = folder(t)
    t.sql(MONITORED).write.parquet(f"{path}/scores")
    stream = J.score_rates(t.spark.readStream.schema(t.sql(MONITORED).schema).parquet(f"{path}/scores"))

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rates")

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rates").withColumn("rate", F.round("rate", 6))


