"""Operator 13: conversation structure repair by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, state of the grammar `(s?(ua)+)?` of role initials). Each edit is an edge; from a node no two edges
have the same letter, so a path is its audit. One heap searches from the start, one from the ends; when the sum of their least
entries passes the best meeting, every cheapest path crosses from settled to settled nodes, and the walk along the least letters
of those paths gives the least audit. Long conversations are cut into blocks: the costs from each state to each state of a block
compose, so blocks are searched apart and only 16 numbers a block meet in one place.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import batches
from .prefix_trie import EMPTY_SHA, streamed_sha256
from .shared import materialise, running

#: Rows of a block.
BLOCK = 256
INFINITE = 1 << 60
# States: nothing yet, after s, after u, after a. What a user or assistant turn leads to from each, and who has it.
THEN, WHO = (2, 2, 3, 2), ("user", "user", "assistant", "user")
ACCEPTED = (0, INFINITE, INFINITE, 0)
#: States from which a user or assistant turn leads to a state.
FROM = ((), (), (0, 1, 3), (2,))
# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row as a letter: by initial (s, u, a, other) sound, truncated, or to be deleted.
SYMBOLS = "suaxSUAXdddd"


def _next(rows: str, last: bool, v: int):
    """(letter, cost, node) of each edit at node v = 4 * rows consumed + state; letters in ASCII order."""
    i, q = v >> 2, v & 3
    if i < len(rows):
        yield "D", DELETE, v + 4
        yield "I", INSERT, 4 * i + THEN[q]
        c = rows[i]
        if c != "d":
            more = TRUNCATED if c < "a" else 0
            role = c.lower()
            if role == WHO[q][0]:
                yield "K", more, 4 * i + 4 + THEN[q]
            elif role == "s" and q == 0:
                yield "K", more, 4 * i + 5
            yield "R", REROLE + more, 4 * i + 4 + THEN[q]
    elif last:
        yield "I", INSERT, 4 * i + THEN[q]


def _before(rows: str, last: bool, v: int):
    """(cost, node) of each edit that leads to node v."""
    i, q = v >> 2, v & 3
    if i < len(rows) or last:
        for p in FROM[q]:
            yield INSERT, 4 * i + p
    if i:
        c = rows[i - 1]
        yield DELETE, v - 4
        if c != "d":
            more = TRUNCATED if c < "a" else 0
            for p in FROM[q]:
                yield more + (0 if c.lower() == WHO[p][0] else REROLE), 4 * i - 4 + p
            if q == 1 and c.lower() == "s":
                yield more, 4 * i - 4


def search(rows: str, entry: int = 0, exits: tuple = ACCEPTED, last: bool = True) -> tuple[int, str, int]:
    """Least cost, least audit of that cost, and the state it ends in; exits: what follows costs from each end state. Inserts at
    the end belong to the next block, unless this is the last."""
    start, end = entry, 4 * len(rows)
    ahead, behind = {start: 0}, {end + q: c for q, c in enumerate(exits) if c < INFINITE}
    forth, back = [(0, start)], sorted((c, v) for v, c in behind.items())
    done_f: dict[int, int] = {}
    done_b: dict[int, int] = {}
    best = min([behind[start]] if start in behind else [INFINITE])
    while forth and back and forth[0][0] + back[0][0] <= best:
        if forth[0][0] <= back[0][0]:
            d, v = heappop(forth)
            if v in done_f:
                continue
            done_f[v] = d
            for _, w, x in _next(rows, last, v):
                if d + w < ahead.get(x, INFINITE):
                    ahead[x] = d + w
                    heappush(forth, (d + w, x))
                    best = min(best, d + w + behind.get(x, INFINITE))
        else:
            d, v = heappop(back)
            if v in done_b:
                continue
            done_b[v] = d
            for w, x in _before(rows, last, v):
                if d + w < behind.get(x, INFINITE):
                    behind[x] = d + w
                    heappush(back, (d + w, x))
                    best = min(best, d + w + ahead.get(x, INFINITE))
    if best >= INFINITE:
        return INFINITE, "", -1
    # forward nodes of cheapest paths: those at the end or with an edge to the settled other side, and what leads to them
    good = [u for u, d in done_f.items() if (u >= end and d + exits[u & 3] == best) or d + done_b.get(u, INFINITE) == best or any(d + w + done_b.get(x, INFINITE) == best for _, w, x in _next(rows, last, u))]
    marked = set(good)
    while good:
        u = good.pop()
        for w, p in _before(rows, last, u):
            if p not in marked and p in done_f and done_f[p] + w == done_f[u]:
                marked.add(p)
                good.append(p)
    v, cost, audit = start, 0, []
    while True:
        if v >= end and cost + exits[v & 3] == best:
            return best, "".join(audit), v & 3
        for letter, w, x in _next(rows, last, v):
            if (x in marked and cost + w == done_f[x]) or cost + w + done_b.get(x, INFINITE) == best:
                audit.append(letter)
                v, cost = x, cost + w
                break
        else:
            raise AssertionError("no cheapest edge")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by the checksum of id and turn."""
    c = conversations
    of = F.crc32(F.concat_ws(":", *(F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = F.coalesce(c["role"], F.lit(" ")), F.coalesce(c["text"], F.lit(" "))
    text = F.when(of == 1, F.lit("")).when(of == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.when(of == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), of.alias("_of"))
    times = F.when(F.col("_of") == 0, 0).when(F.col("_of") == 3, 2).otherwise(1)
    return rows.withColumn("_i", F.explode(F.array_repeat(F.lit(0), times))).drop("_of", "_i")


def faults(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns (conv_id, turn, role, text, without null roles and texts) in order: `_n`, `_c` (conversation), before, block, turn,
    role, text, fault (blank, duplicate, truncated, or empty), symbol."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = turns.select(
        F.col("conv_id").isNull().cast("long").alias("_n"),
        F.coalesce("conv_id", F.lit(0)).alias("_c"),
        "turn",
        "role",
        "text",
        F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))).alias("digest"),
        F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("_fault"),
    )
    numbered = running(rows, ["_n", "_c"], ["turn", "digest"])
    repeated = materialise(numbered.groupBy("_n", "_c", "digest").agg(F.min("before").alias("_first"), F.count("*").alias("_k")).where("_k > 1").drop("_k"))
    if repeated.count() <= 500_000:
        repeated = F.broadcast(repeated)
    met = numbered.join(repeated, ["_n", "_c", "digest"], "left").withColumn("fault", F.when((F.col("_fault") != "blank") & (F.col("before") > F.col("_first")), "duplicate").otherwise(F.col("_fault")))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)) * F.when(F.col("role") == "", 0).otherwise(1), F.lit(0)), F.lit(4))
    kind = F.when(F.col("fault") == "", 0).when(F.col("fault") == "truncated", 4).otherwise(8)
    # the initial stays beside the symbol, as rows to be deleted hide theirs
    return met.select("_n", "_c", "before", F.floor(F.col("before") / block).alias("block"), "turn", "role", "text", "fault", F.concat(F.substring(F.lit("suax"), initial, F.lit(1)), F.substring(F.lit(SYMBOLS), kind + initial, F.lit(1))).alias("symbol"))


def audits(rows: DataFrame) -> DataFrame:
    """Per block of rows as of `faults`: _n, _c, block, entry (state), audit, cost (of the block), illegal (pairs within the block), first and
    last initial."""
    thin = rows.groupBy("_n", "_c", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("before", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
    thin = materialise(thin.withColumn("last", F.max("block").over(W.partitionBy("_n", "_c")) == F.col("block")))
    schema = "_n long, _c long, block long, entry int, audit string, cost long, illegal long, first string, last_initial string"

    def found(rows_of):
        """Blocks with their entries and exits to the schema's columns."""
        out = []
        for n, c, block, symbols, entry, exits, last in rows_of:
            initials, kinds = symbols[::2], symbols[1::2]
            cost, audit, state = search(kinds, entry, exits, last)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
            out.append((n, c, block, entry, audit, cost - exits[state], illegal, initials[0], initials[-1]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    def single(it):
        for b in batches(it, 1024):
            yield found((r["_n"], r["_c"], r["block"], r["symbols"], 0, ACCEPTED, True) for r in b.to_pylist())

    one = thin.where("last and block = 0").mapInArrow(single, schema)
    many = thin.where("not (last and block = 0)")
    if not many.limit(1).count():
        return one

    def costs(it):
        for b in batches(it, 64):
            out = []
            for symbols, last in zip(b.column("symbols").to_pylist(), b.column("last").to_pylist(), strict=True):
                ends = [[0 if p == q else INFINITE for p in range(4)] for q in range(4)]
                out.append([search(symbols[1::2], p, tuple(ends[q]), last)[0] for p in range(4) for q in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("_n"), b.column("_c"), b.column("block"), pa.array(out, pa.list_(pa.int64()))], ["_n", "_c", "block", "costs"])

    def exits_of(t: pa.Table) -> pa.Table:
        """What follows each block costs from each state: the blocks' costs composed from the last one back."""
        after, out = ACCEPTED, []
        rows_of = sorted(t.to_pylist(), key=lambda r: -r["block"])
        for r in rows_of:
            out.append(list(after))
            after = tuple(min(min(INFINITE, r["costs"][4 * p + q] + after[q]) for q in range(4)) for p in range(4))
        return pa.table({"_n": [r["_n"] for r in rows_of], "_c": [r["_c"] for r in rows_of], "block": [r["block"] for r in rows_of], "exits": pa.array(out, pa.list_(pa.int64()))})

    matrices = many.mapInArrow(costs, "_n long, _c long, block long, costs array<long>")
    exits = matrices.groupBy("_n", "_c").applyInArrow(exits_of, "_n long, _c long, block long, exits array<long>")
    ready = materialise(many.join(exits, ["_n", "_c", "block"]))

    def states(it):
        """The state in which a block ends, for each in which it may begin."""
        for b in batches(it, 64):
            out = [[search(r["symbols"][1::2], q, tuple(r["exits"]), r["last"])[2] for q in range(4)] for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_n"), b.column("_c"), b.column("block"), pa.array(out, pa.list_(pa.int32()))], ["_n", "_c", "block", "ends"])

    def entries(t: pa.Table) -> pa.Table:
        now, out = 0, []
        rows_of = sorted(t.to_pylist(), key=lambda r: r["block"])
        for r in rows_of:
            out.append(now)
            now = r["ends"][now]
        return pa.table({"_n": [r["_n"] for r in rows_of], "_c": [r["_c"] for r in rows_of], "block": [r["block"] for r in rows_of], "entry": pa.array(out, pa.int32())})

    def several(it):
        for b in batches(it, 64):
            yield found((r["_n"], r["_c"], r["block"], r["symbols"], r["entry"], tuple(r["exits"]), r["last"]) for r in b.to_pylist())

    ends = ready.select("_n", "_c", "block", "symbols", "exits", "last").mapInArrow(states, "_n long, _c long, block long, ends array<int>")
    entry = ends.groupBy("_n", "_c").applyInArrow(entries, "_n long, _c long, block long, entry int")
    return one.unionByName(ready.join(entry, ["_n", "_c", "block"]).mapInArrow(several, schema))


def _edited(plan: str, entry: int, rows):
    """(edit, row or None, role, text) of each edit of a block, in order; rows are (turn, role, text)."""
    state = entry
    for letter in plan:
        row = None if letter == "I" else next(rows)
        if letter == "D":
            yield "D", row, None, None
            continue
        role = row[1] if letter == "K" else WHO[state]
        yield letter, row, role, row[2] if row else ""
        state = 1 if letter == "K" and role[:1] == "s" else THEN[state]


def _with_plans(rows: DataFrame, plans: DataFrame, write, schema: str) -> DataFrame:
    """Each block's rows behind its plan, to batches of write(n, c, block, edits)."""
    head = plans.select("_n", "_c", "block", F.lit(-1).cast("long").alias("before"), F.col("entry").cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select(*head.columns).unionByName(head).repartition("_n", "_c", "block").sortWithinPartitions("_n", "_c", "block", "before")

    def run(it):
        lines = (r for b in batches(it, 1024) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, block in groupby(lines, key=lambda r: r[:3]):
            *_, entry, _, audit = next(block)
            yield from write(*key, _edited(audit, entry, (r[4:] for r in block)))

    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[f.split(" ")[1]] for f in schema.split(", ")]

    def packed(it):
        held: list[tuple] = []
        for row in run(it):
            held.append(row)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return both.mapInArrow(packed, schema)


def _whole(turns: DataFrame) -> DataFrame:
    return turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), *(F.coalesce(turns[c], F.lit(" ")).alias(c) for c in ("role", "text")))


def _conv() -> Column:
    return F.when(F.col("_n") == 0, F.col("_c")).alias("conv_id")


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, place (of the edit in its conversation's audit is `block`, place), edit, turn, role, text. Deleted
    rows have null role and text; inserted ones null turn."""
    rows = materialise(faults(_whole(turns), block))
    plans = materialise(audits(rows))

    def write(n, c, block, edits):
        for i, (letter, row, role, text) in enumerate(edits):
            yield n, c, block, i, letter, row[0] if row else None, role, text

    out = _with_plans(rows, plans, write, "_n long, _c long, block long, place long, edit string, turn long, role string, text string")
    return out.select(_conv(), "block", "place", "edit", "turn", "role", "text")


def repair(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per conversation of `conversations` (default: turns): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, of the rows of `turns` (conv_id, turn, role, text).

    Rows go by turn (nulls first), then by a digest of role and text; null roles and texts are one space; null conv_ids are one
    conversation. Equal rows are duplicates. A conversation without rows has zeros and the empty string's hash. An empty table gives no
    rows. Rows are numbered over range-sorted partitions and searched in blocks, so a conversation of any length spreads over tasks;
    texts pass by once, row by row, into the hash.
    """
    rows = materialise(faults(_whole(turns), block))
    plans = materialise(audits(rows))

    def write(n, c, block, edits):
        text = "\n".join(f"{role}:{text}" for letter, _, role, text in edits if letter != "D")
        yield n, c, block, text

    chunks = _with_plans(rows, plans, write, "_n long, _c long, block long, text string").where("text <> ''")
    long_ = plans.where("block > 0").select("_n", "_c").distinct()
    conv = ["_n", "_c"]
    if plans.where("block > 0").limit(1).count():
        chunks = materialise(chunks)
        several = chunks.join(long_, conv, "left_semi").withColumn("key", F.concat_ws("/", *conv))
        shas = streamed_sha256(several, "key", ["block"], between=b"\n").select(*(F.split("key", "/")[i].cast("long").alias(c) for i, c in enumerate(conv)), "sha256")
        shas = shas.unionByName(chunks.join(long_, conv, "left_anti").select(*conv, F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))
    else:
        shas = chunks.select(*conv, F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    border = F.concat(F.lag("last_initial").over(W.partitionBy(*conv).orderBy("block")), "first")
    planned = plans.withColumn("illegal", F.col("illegal") + F.coalesce((~border.isin("su", "ua", "au")).cast("long"), F.lit(0)))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    planned = planned.groupBy(*conv).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    turn_sets = rows.where("turn is not null").groupBy(*conv, "turn").count().groupBy(*conv).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counted = rows.groupBy(*conv).agg(*(F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")))
    given = turns if conversations is None else conversations
    every = given.select(given["conv_id"].isNull().cast("long").alias("_n"), F.coalesce(given["conv_id"].cast("long"), F.lit(0)).alias("_c")).distinct()
    out = every.join(counted, conv, "left").join(turn_sets, conv, "left").join(planned, conv, "left").join(shas, conv, "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(_conv(), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def repair_sql() -> str:
    """The query's rows in DuckDB's SQL: damage, then costs and least audits of the four states from the last row back."""
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    option = lambda cost, letter, to: f"{{'c': f{to}.c + {cost}, 'a': '{letter}' || f{to}.a}}"
    edits = lambda q: (
        f"list_min([{option(3, 'D', q)}] || CASE WHEN dead THEN [] ELSE [{option('2 + late', 'R', THEN[q])}] END"
        f" || CASE WHEN NOT dead AND initial = '{WHO[q][0]}' THEN [{option('late', 'K', THEN[q])}] ELSE [] END" + (f" || CASE WHEN NOT dead AND initial = 's' THEN [{option('late', 'K', 1)}] ELSE [] END" if q == 0 else "") + f") AS g{q}"
    )
    insert = lambda n, to: f"{{'c': g{to}.c + {2 * n}, 'a': '{'I' * n}' || g{to}.a}}"
    with_inserts = lambda q: f"list_min([g{q}, {insert(1, THEN[q])}, {insert(2, THEN[THEN[q]])}, {insert(3, THEN[THEN[THEN[q]]])}]) AS f{q}"
    return rf"""WITH RECURSIVE o AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, coalesce(conv_id::VARCHAR, '') AS cid FROM conversations),
h AS (SELECT cid, turn, {crc} % 20 AS d, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM o),
d AS (SELECT cid, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS i FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS pos, right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS final FROM d),
q AS (SELECT *, left(role, 1) AS initial, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS dead, (fault = 'truncated')::INT AS late, lag(initial) OVER (PARTITION BY cid ORDER BY pos) || initial AS pair FROM q),
x AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY cid),
dp AS (SELECT cid, n AS i, {{'c': 0::BIGINT, 'a': ''}} AS f0, {{'c': 4::BIGINT, 'a': 'II'}} AS f1, {{'c': 2::BIGINT, 'a': 'I'}} AS f2, {{'c': 0::BIGINT, 'a': ''}} AS f3 FROM x
  UNION ALL SELECT cid, i, {", ".join(map(with_inserts, range(4)))} FROM (SELECT dp.cid, dp.i - 1 AS i, {", ".join(map(edits, range(4)))} FROM dp JOIN r ON r.cid = dp.cid AND r.pos = dp.i)),
best AS (SELECT cid, f0.c AS cost, f0.a AS audit FROM dp WHERE i = 0),
e AS (SELECT *, substr(audit, j, 1) AS letter FROM (SELECT cid, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
f AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS out FROM e WINDOW w AS (PARTITION BY cid ORDER BY j)),
g AS (SELECT f.cid, f.j, f.letter, f.out, r.role, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, bool_or(f.out = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY f.cid) AS begins FROM f LEFT JOIN r ON r.cid = f.cid AND r.pos = f.pos WHERE letter <> 'D'),
t AS (SELECT cid, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - begins::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS text FROM g GROUP BY cid)
SELECT CASE WHEN a.cid <> '' THEN a.cid::BIGINT END AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT cid FROM o) a LEFT JOIN x ON x.cid = a.cid LEFT JOIN best b ON b.cid = a.cid LEFT JOIN t ON t.cid = a.cid"""
