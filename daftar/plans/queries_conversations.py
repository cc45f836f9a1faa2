"""Queries of conversation tables (M1-M10, S13) over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.operators import conversations as M
from daftar.sources.ledger import Ledger

from .base import folder, query

MESSAGES = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, turn, role, text AS content, CASE WHEN role = 'assistant' THEN concat('t', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) END AS trace_id,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + turn * INTERVAL '1' MINUTE AS created_at FROM {conversations} WHERE role <> 'system'"""
CONVERSATIONS = f"SELECT conv_id, CAST(conv_id % 7 AS INT) AS user_id, concat('title ', CAST(conv_id AS STRING)) AS title, CASE WHEN conv_id % 3 = 0 THEN 'summary' END AS summary, CAST(conv_id % 3 AS INT) AS summarized_through_turn, max(created_at) AS updated_at FROM ({MESSAGES}) GROUP BY conv_id"
REQUESTS = f"SELECT conv_id, CAST(CASE WHEN conv_id % 4 = 0 THEN 6 - conv_id % 7 ELSE conv_id % 7 END AS INT) AS user_id, concat('t', CAST(conv_id AS STRING), '-1') AS trace_id FROM ({CONVERSATIONS}) UNION ALL SELECT -1, 0, 't-none'"
#: Conversations of equal conv_id % 10 laid end to end, so that compaction's own thresholds are reached.
LONG = "SELECT conv_id % 10 AS conv_id, CAST(row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS INT) AS pos, role FROM {conversations} WHERE role <> 'system'"
LONG_CONVERSATIONS = f"SELECT DISTINCT conv_id, CAST(conv_id % 4 * 6 AS INT) AS summarized_through_turn FROM ({LONG})"
COMPACT = """SELECT conv_id, turns, 2 * s AS first, 2 * (s + {b}) AS last, s + {b} AS new_summarized FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS turns FROM ({m}) GROUP BY conv_id) JOIN (SELECT conv_id, summarized_through_turn AS s FROM ({c})) USING (conv_id) WHERE turns >= {t} AND turns - s >= {t}"""


@query(f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id) AS rank FROM ({CONVERSATIONS})")
def m1_list_conversations(t):
    """M1."""
    return M.list_conversations(t.sql(CONVERSATIONS))


@query(f"SELECT user_id, conv_id, (user_id, conv_id) IN (SELECT (user_id, conv_id) FROM ({CONVERSATIONS})) AS found FROM ({REQUESTS})")
def m2_ownership(t):
    """M2: found and not found requests."""
    r, c = t.sql(REQUESTS).select("user_id", "conv_id"), t.sql(CONVERSATIONS)
    return M.owned(r, c).withColumn("found", F.lit(True)).unionByName(M.not_found(r, c).withColumn("found", F.lit(False)))


@query(f"SELECT r.trace_id, r.user_id, m.conv_id, m.pos, m.content FROM ({REQUESTS}) r JOIN ({MESSAGES}) m USING (trace_id) JOIN ({CONVERSATIONS}) c ON c.conv_id = m.conv_id AND c.user_id = r.user_id")
def m3_owned_by_trace(t):
    """M3."""
    return M.owned_by_trace(t.sql(REQUESTS).select("trace_id", "user_id"), t.sql(MESSAGES), t.sql(CONVERSATIONS)).select("trace_id", "user_id", "conv_id", "pos", "content")


@query(f"SELECT conv_id, summary, n, first_role, contents FROM ({CONVERSATIONS}) JOIN (SELECT conv_id, count(*) AS n, arg_min(role, pos) AS first_role, string_agg(content, '|' ORDER BY pos) AS contents FROM ({MESSAGES}) GROUP BY conv_id) USING (conv_id)")
def m4_load_conversation(t):
    """M4."""
    loaded = M.load(t.sql(CONVERSATIONS), t.sql(MESSAGES))
    return loaded.select("conv_id", "summary", F.size("messages").cast("long").alias("n"), F.col("messages")[0]["role"].alias("first_role"), F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("contents"))


@query(f"SELECT conv_id, pos, role FROM ({MESSAGES}) JOIN ({CONVERSATIONS}) USING (conv_id) WHERE pos >= 2 * summarized_through_turn")
def m5_working_memory(t):
    """M5."""
    return M.working_memory(t.sql(MESSAGES), t.sql(CONVERSATIONS)).select("conv_id", "pos", "role")


@query(COMPACT.replace("{b}", "6").replace("{t}", "12").replace("{m}", LONG).replace("{c}", LONG_CONVERSATIONS))
def m6_compaction(t):
    """M6: thresholds 12 and 6 over conversations laid end to end."""
    return M.compaction(t.sql(LONG), t.sql(LONG_CONVERSATIONS))


@query(COMPACT.replace("{b}", "2").replace("{t}", "4").replace("{m}", MESSAGES).replace("{c}", CONVERSATIONS))
def m6_compaction_small(t):
    """M6 with thresholds 4 and 2."""
    return M.compaction(t.sql(MESSAGES), t.sql(CONVERSATIONS), 4, 2)


@query(f"SELECT conv_id, turns, CASE WHEN turns < 12 THEN 0 ELSE 6 * ((turns - 12) // 6 + 1) END AS summarized FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS turns FROM ({LONG}) GROUP BY conv_id)")
def m6_compaction_closed_form(t):
    """M6: where one call a turn has come to."""
    turns = t.sql(LONG).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
    return turns.withColumn("summarized", M.summarized_after(F.col("turns")))


@query(f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'المستخدم' ELSE 'المساعد' END || ': ' || content, chr(10) ORDER BY pos) AS text FROM ({MESSAGES}) GROUP BY conv_id")
def m7_render_turns(t):
    """M7."""
    return M.render(t.sql(MESSAGES))


@query(f"SELECT conv_id, pos, CASE WHEN role = 'user' THEN 'human' ELSE 'assistant' END AS kind, content FROM ({MESSAGES})")
def m8_history(t):
    """M8."""
    return M.history(t.sql(MESSAGES)).select("conv_id", "pos", "kind", "content")


@query(f"SELECT 'conversation' AS kind, conv_id, count(*) AS n FROM ({CONVERSATIONS}) WHERE user_id NOT IN (2, 5) GROUP BY conv_id UNION ALL SELECT 'message', conv_id, count(*) FROM ({MESSAGES}) WHERE conv_id % 7 NOT IN (2, 5) GROUP BY conv_id")
def m9_cascade_delete(t):
    """M9: users 2 and 5 go, with all that is theirs."""
    conversations = t.sql(CONVERSATIONS)
    users = conversations.select("user_id").distinct()
    _, kept, messages = M.cascade_delete(users, conversations, t.sql(MESSAGES), users.where("user_id in (2, 5)"))
    count = lambda df, kind: df.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "conv_id", "n")
    return count(kept, "conversation").unionByName(count(messages, "message"))


CITED = f"SELECT *, CASE WHEN pos % 4 = 1 THEN split(content, ' ') ELSE slice(split(content, ' '), 1, 0) END AS citations, content AS retrieved_context FROM ({MESSAGES})"


@query(f"SELECT conv_id, pos, role, content, trace_id, CASE WHEN pos % 4 = 1 THEN len(string_split(content, ' ')) END AS n_citations FROM ({MESSAGES})")
def m10_detail(t):
    """M10."""
    shown = M.detail(t.sql(CITED))
    assert "retrieved_context" not in shown.columns
    return shown.select("conv_id", "pos", "role", "content", "trace_id", F.size("citations").cast("long").alias("n_citations")).withColumn("n_citations", F.when(F.col("n_citations") >= 0, F.col("n_citations")))


TURNS = "SELECT doc_id % 100 AS conv_id, CAST(doc_id AS INT) AS turn, text AS question, source AS answer, CAST('2024-02-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' SECOND AS created_at FROM {documents}"


@query(f"SELECT conv_id, 2 * turn AS pos, 'user' AS role, question AS content, NULL AS n_citations FROM ({TURNS}) UNION ALL SELECT conv_id, 2 * turn + 1, 'assistant', answer, CASE WHEN turn % 2 = 0 THEN 1 END FROM ({TURNS})")
def s13_append_turns(t):
    """The rows that turns append."""
    cited = F.when(F.col("turn") % 2 == 0, F.array("question")).otherwise(F.array().cast("array<string>"))
    rows = M.append_turns(t.sql(TURNS).withColumn("citations", cited))
    return rows.select("conv_id", "pos", "role", "content", F.when(F.col("citations").isNotNull(), F.size("citations")).alias("n_citations"))


@query(f"SELECT conv_id, greatest(c.updated_at, m.at) AS updated_at FROM ({CONVERSATIONS}) c LEFT JOIN (SELECT conv_id, max(created_at) AS at FROM ({TURNS}) GROUP BY conv_id) m USING (conv_id)")
def s13_updated_at(t):
    """updated_at follows."""
    return M.bumped(t.sql(CONVERSATIONS), t.sql(TURNS)).select("conv_id", "updated_at")


@query(
    f"""SELECT c.conv_id, coalesce(m.n, 0) AS n_messages, m.n_cited, greatest(c.updated_at, m.at) AS updated_at FROM ({CONVERSATIONS}) c LEFT JOIN
    (SELECT conv_id, 2 * count(*) AS n, count(*) FILTER (turn % 2 = 0) AS n_cited, max(created_at) AS at FROM ({TURNS}) GROUP BY conv_id) m USING (conv_id)"""
)
def s13_commit_turns(t):
    """Turns committed in two batches, the second twice, over both tables at once."""
    ledger = Ledger(t.spark, folder(t))
    cited = F.when(F.col("turn") % 2 == 0, F.array("question")).otherwise(F.array().cast("array<string>"))
    turns = t.sql(TURNS).withColumn("citations", cited)
    known = t.sql(CONVERSATIONS).select("conv_id", "updated_at")
    ledger.upsert({"conversations": (known, "conv_id", "updated_at")})
    held = lambda: ledger.read("conversations", known.schema)
    for batch in (0, 1, 1):
        M.commit_turns(ledger, turns.where(F.col("turn") % 2 == batch), held(), "chat", batch)
    schema = T.StructType.fromDDL("conv_id long, pos int, citations array<string>")
    messages = ledger.read("messages", schema).groupBy("conv_id").agg(F.count("*").alias("n"), F.count("citations").alias("n_cited"))
    return held().join(messages, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n_messages"), "n_cited", "updated_at")
