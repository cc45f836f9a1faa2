"""Operator 12: the trie of conversations that begin alike.

Turns become ids of a dictionary, conversations become sequences of ids, cut into segments of a bounded length. Segments are sorted by
range; every run of the sort (a range shard) is a ternary search tree, filled from the median outward so that its branches are
balanced, and walked once from its last node to its first, which adds members, leaves and savings up. Only nodes on a shard's first and
last path can lie in its neighbours too: those boundary nodes, a path's length for each cut, are merged afterwards.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, running

#: Turns of a segment, and turns of a shard from which on the next row begins another.
SEGMENT, SHARD = 256, 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

ROWS = "conv_id long, seg long, root binary, ids array<long>, sizes array<long>, ended boolean, next binary, tail_leaves long, tail_saved long"
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "boundary boolean, key binary, parent_key binary, size long, next binary, ends string, shard long, seg long, root binary"
)


class _Trie:
    """A ternary search tree over one shard's part of one sub-trie. Node 0 is its root; a node's number is above its parent's. `low`,
    `high`: siblings of smaller and larger ids; `equal`: the first child."""

    def __init__(self):
        self.id, self.low, self.high, self.equal = [-1], [0], [0], [0]
        self.up, self.size, self.members, self.conv = [-1], [0], [0], [None]
        self.end: dict[int, tuple] = {}  # of nodes where rows end: their run

    def add(self, run) -> None:
        """A run of equal rows: ids, sizes, members, smallest member, ..."""
        ids, sizes, members, conv = run[:4]
        at = 0
        self._count(0, members, conv)
        for turn, size in zip(ids, sizes, strict=True):
            here = self.equal[at]
            branch, last = self.equal, at
            while here and self.id[here] != turn:
                branch, last = (self.low, here) if turn < self.id[here] else (self.high, here)
                here = branch[here]
            if not here:
                here = branch[last] = len(self.id)
                for column, value in zip((self.id, self.low, self.high, self.equal, self.up, self.size, self.members, self.conv), (turn, 0, 0, 0, at, size, 0, None), strict=True):
                    column.append(value)
            self._count(here, members, conv)
            at = here
        self.end[at] = run

    def _count(self, at: int, members: int, conv: int) -> None:
        self.members[at] += members
        if self.conv[at] is None or conv < self.conv[at]:
            self.conv[at] = conv

    def path(self, ids) -> list[int]:
        """The nodes of a row that is in the tree, the root first."""
        out = [0]
        for turn in ids:
            here = self.equal[out[-1]]
            while self.id[here] != turn:
                here = self.low[here] if turn < self.id[here] else self.high[here]
            out.append(here)
        return out


def _medians(n: int):
    """0 to n - 1, every range's median before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            ranges += [(m + 1, b), (a, m)]


def _nodes(rows: list[dict], left: bool, right: bool, shard: int, segment: int):
    """The nodes of one shard's part of one sub-trie, from its sorted rows. left, right: whether the sub-trie may go on in the
    neighbouring shard, so that nodes on the first or last path are its boundary."""
    seg, root = rows[0]["seg"], rows[0]["root"]
    runs = []
    for ids, same in groupby(rows, key=lambda r: r["ids"]):
        same = list(same)
        ends = [r["conv_id"] for r in same if r["ended"]]
        next_ = next((r["next"] for r in same if r["next"] is not None), None)
        runs.append((ids, same[0]["sizes"], len(same), min(r["conv_id"] for r in same), ends, next_, sum(r["tail_leaves"] for r in same), sum(r["tail_saved"] for r in same)))
    trie = _Trie()
    for i in _medians(len(runs)):
        trie.add(runs[i])
    key: dict[int, bytes] = {}
    for ids in ([runs[0][0]] if left else []) + ([runs[-1][0]] if right else []):
        at = hashlib.md5(b"%d/" % seg + (root or b"")).digest()
        for n, (node, turn) in enumerate(zip(trie.path(ids), [None, *ids], strict=True)):
            at = hashlib.md5(at + turn.to_bytes(8, "big", signed=True)).digest() if n else at
            key[node] = at
    n = len(trie.id)
    leaves, saved, children, depth = [0] * n, [0] * n, [0] * n, [seg * segment] * n
    for v in range(1, n):
        depth[v] = depth[trie.up[v]] + 1
    for v in range(n - 1, -1, -1):
        run = trie.end.get(v)
        if run:
            leaves[v] += run[6]
            saved[v] += run[7]
        if v not in key:
            if not children[v] and not (run and run[5] is not None):
                leaves[v] += 1
            saved[v] += (trie.members[v] - 1) * trie.size[v]
            if v:
                up = trie.up[v]
                leaves[up] += leaves[v]
                saved[up] += saved[v]
                children[up] += 1
    for v in range(n):
        run, up = trie.end.get(v), trie.up[v]
        text = ",".join(map(str, run[4])) if run and run[4] else None
        inner = v not in key
        yield (
            trie.conv[v], depth[v], trie.conv[up] if v else None, trie.members[v], children[v], leaves[v], saved[v], (hashlib.sha256(text.encode()).hexdigest() if text else EMPTY_SHA) if inner else None,
            not inner, key.get(v), key.get(up) if v else None, trie.size[v], run[5] if run else None, None if inner else text, shard, seg, root,
        )


def _shard(it, segment: int, shard: int):
    """Sorted rows to nodes: rows are held until they have `shard` turns, then make a shard's trees, one for each sub-trie."""
    names = [f.strip().split(" ")[0] for f in NODES.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in NODES.split(", ")])
    part, count = TaskContext.get().partitionId(), 0
    held: list[dict] = []
    turns, begins = 0, True

    def made(left: bool, right: bool):
        """left, right: whether the first and the last sub-trie may go on outside."""
        parts = [list(g) for _, g in groupby(held, key=lambda r: (r["seg"], r["root"]))]
        out: list[tuple] = []
        for i, rows in enumerate(parts):
            out += _nodes(rows, left and i == 0, right and i == len(parts) - 1, (part << 32) + count, segment)
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[i : i + 10_000], strict=True), schema, strict=True)], names)

    for b in it:
        for i in range(0, b.num_rows, 1024):
            for row in b.slice(i, 1024).to_pylist():
                if turns >= shard:
                    yield from made(True, True)
                    held.clear()
                    turns, count = 0, count + 1
                held.append(row)
                turns += len(row["ids"]) + 1
    if held:
        yield from made(True, True)


def _climb(t: pa.Table) -> pa.Table:
    """Adds what boundary nodes hold to their boundary ancestors, the deepest first: one sub-trie's boundary, a path for each cut."""
    rows = sorted(t.to_pylist(), key=lambda r: -r["depth"])
    at = {r["key"]: r for r in rows}
    for r in rows:
        if not r["n_children"] and r["next"] is None:
            r["n_leaves"] += 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        up = at.get(r["parent_key"])
        r["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            up["n_children"] += 1
    return pa.Table.from_pylist(rows, t.schema)


def streamed_sha256(chunks: DataFrame, key: str, order: list[str], text: str = "text", between: bytes = b"") -> DataFrame:
    """key, sha256: of a key's chunks joined in order. Chunks stream through the hash, so no key's text is held."""

    def run(it):
        now, digest = None, None
        for b in it:
            keys, texts = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        keys.append(now), texts.append(digest.hexdigest())
                    now, digest = k, hashlib.sha256()
                else:
                    digest.update(between)
                digest.update(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(texts, pa.string())], ["key", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["key", "sha256"])

    kind = chunks.schema[key].dataType.simpleString().replace("bigint", "long")
    return chunks.repartition(key).sortWithinPartitions(key, *order).select(key, text).mapInArrow(run, f"key {kind}, sha256 string")


def _nodes_of(rows: DataFrame, segment: int, shard: int) -> DataFrame:
    """All nodes of the sub-tries of segments, their roots included: boundary nodes merged, `next` still to be joined."""
    by = ["seg", "root", "ids", "conv_id"]
    raw = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(partial(_shard, segment=segment, shard=shard), NODES))
    edge = raw.where("boundary")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = edge.groupBy("seg", "root", "key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("parent_key").alias("parent_key"), F.max("size").alias("size"), F.max("next").alias("next"), F.lit(None).cast("long").alias("parent_conv_id"))
    climbed = materialise(merged.groupBy("seg", "root").applyInArrow(_climb, merged.schema))
    shas = streamed_sha256(edge.where("ends is not null").select("key", "shard", F.col("ends").alias("text")), "key", ["shard"], between=b",")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "next", "seg", "root"]
    edges = climbed.join(shas, "key", "left").withColumn("ends_sha256", F.coalesce("sha256", F.lit(EMPTY_SHA))).select(*columns)
    parents = climbed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    if parents.count() <= 500_000:
        parents = F.broadcast(parents)
    inner = raw.where("not boundary").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id"))
    return edges.unionByName(inner.select(*columns))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """The query's damage: conv_id, depth (from 1), turn digest, size: the first h turns of conversation c - c % 5, then c's own after
    its first h, h = crc32(c) % 9. Turnless conversations have one row of null depth."""
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    numbered = running(turns, ["conv_id"], ["turn", "digest"]).select("conv_id", "before", "digest", "size")
    lens = materialise(numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5))
    bases = lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = materialise(lens.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))))
    own = numbered.join(plan.select("conv_id", "h", "k"), "conv_id").where("before >= h").select("conv_id", (F.col("k") + F.col("before") - F.col("h") + 1).alias("depth"), "digest", "size")
    first = numbered.where("before < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")  # at most 8 turns of each base
    lent = first.join(plan.select("conv_id", "base", "k"), "base").where("before < k").select("conv_id", (F.col("before") + 1).alias("depth"), "digest", "size")
    none = plan.where("k = 0 and n <= h").select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("size"))
    return own.unionByName(lent).unionByName(none)


def trie(turns: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row a trie node of turns (conv_id, depth, digest, size; a turnless conversation has one row of null depth): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The digest stands for the turn; the dictionary gives each distinct one an id. Conversations longer than `segment` turns are
    cut into segments, each a row of the sub-trie of all that share the turns before it; what a sub-trie adds up to is lent to
    the segment before through its smallest member, so a conversation of any length lies in many tasks. Members are told by
    conv_id; copies of a conversation are sorted by it, so they spread over shards too. An empty table gives no rows.
    """
    turns = materialise(turns)
    words = materialise(turns.where("depth is not null").select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("id")))
    coded = turns.where("depth is not null").join(words, "digest").withColumn("seg", F.floor((F.col("depth") - 1) / segment))
    packed = coded.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("depth", "id", "size"))).alias("_t"))
    none = turns.where("depth is null").select("conv_id", F.lit(0).cast("long").alias("seg"), F.array().cast("array<struct<depth:bigint,id:bigint,size:bigint>>").alias("_t"))
    parts = materialise(packed.unionByName(none).select("conv_id", "seg", F.transform("_t", lambda x: x["id"]).alias("ids"), F.transform("_t", lambda x: x["size"]).alias("sizes")))
    # what stands before a segment: an order-bound digest of each earlier one, xor-ed
    # (at most a row for each `segment` turns of a conversation in one window)
    one = F.md5(F.concat_ws("/", F.col("seg").cast("string"), F.array_join("ids", ",")).cast("binary"))
    half = lambda i: F.conv(F.substring(one, i, 15), 16, 10).cast("long")
    whole = W.partitionBy("conv_id").orderBy("seg")
    parts = parts.withColumn("_a", half(1)).withColumn("_b", half(16))
    xor = lambda c, frame: F.bit_xor(c).over(frame).cast("string")
    upto = whole.rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("_after", F.concat_ws("/", F.col("seg").cast("string"), xor("_a", upto), xor("_b", upto)).cast("binary"))
    parts = parts.withColumn("root", F.coalesce(F.lag("_after").over(whole), F.lit(b""))).withColumn("ended", F.lead("seg").over(whole).isNull())
    rows = materialise(parts.select("conv_id", "seg", "root", "ids", "sizes", "ended", F.when(~F.col("ended"), F.col("_after")).alias("next"), F.lit(0).cast("long").alias("tail_leaves"), F.lit(0).cast("long").alias("tail_saved")))
    deep = rows.where("seg > 0")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not deep.limit(1).count():
        return _nodes_of(rows, segment, shard).select(*columns)
    roots = _nodes_of(deep, segment, shard).where(F.col("depth") == F.col("seg") * segment).select("conv_id", "seg", "n_leaves", "saved_tokens")
    after = whole.rowsBetween(1, W.unboundedFollowing)
    lent = rows.drop("tail_leaves", "tail_saved").join(roots, ["conv_id", "seg"], "left")
    lent = lent.withColumn("tail_leaves", F.coalesce(F.sum("n_leaves").over(after), F.lit(0))).withColumn("tail_saved", F.coalesce(F.sum("saved_tokens").over(after), F.lit(0)))
    nodes = materialise(_nodes_of(materialise(lent.select(*rows.columns)), segment, shard))
    is_root = (F.col("seg") > 0) & (F.col("depth") == F.col("seg") * segment)
    below = nodes.where(is_root).select(F.col("root").alias("next"), F.col("n_children").alias("_more"), F.col("conv_id").alias("_least"))
    # a sub-trie's own root is the last node of the segment before: the top nodes of the sub-trie hang below that one
    tops = nodes.where((F.col("seg") > 0) & (F.col("depth") == F.col("seg") * segment + 1)).join(nodes.where("next is not null").select(F.col("next").alias("root"), F.col("conv_id").alias("_up")), "root")
    rest = nodes.where(~is_root & ~((F.col("seg") > 0) & (F.col("depth") == F.col("seg") * segment + 1)))
    every = rest.unionByName(tops.withColumn("parent_conv_id", F.col("_up")).select(*rest.columns)).join(below, "next", "left")
    return every.withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).select(*columns)


def trie_sql() -> str:
    """The query's rows in DuckDB's SQL: nodes are told by the digests of their turns, joined."""
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    return f"""WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS p,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS size
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS n, {crc} % 9 AS h, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
k AS (SELECT l.*, least(l.h, coalesce(b.n, 0)) AS k FROM l LEFT JOIN l b ON b.conv_id = l.base),
r AS (SELECT t.conv_id, k.k + t.p - k.h + 1 AS depth, digest, size FROM t JOIN k USING (conv_id) WHERE p >= h
      UNION ALL SELECT k.conv_id, t.p + 1, digest, size FROM t JOIN k ON t.conv_id = k.base WHERE p < k.k),
x AS (SELECT conv_id, depth, size, md5(string_agg(digest, ',') OVER w) AS node, md5(string_agg(digest, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS up FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
      UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM l),
y AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM x),
n AS (SELECT depth, node, any_value(CASE WHEN depth = 1 THEN 'root' ELSE up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends FROM y GROUP BY depth, node),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.node AND m.depth = n.depth + 1) AS n_children FROM n),
s AS (SELECT y.conv_id, y.depth, y.node, c.conv_id = y.conv_id AS own, (c.n_convs - 1) * c.size AS saved, c.n_children = 0 AS leaf FROM y JOIN c USING (depth, node)),
z AS (SELECT *, coalesce(sum(CASE WHEN own THEN saved ELSE 0 END) OVER v, 0) AS saved_below, coalesce(sum((own AND leaf)::INT) OVER v, 0) AS leaves_below FROM s WINDOW v AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
a AS (SELECT depth, node, sum(saved_below)::BIGINT AS saved_tokens, sum(leaves_below)::BIGINT AS n_leaves FROM z GROUP BY depth, node)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves, a.saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM c JOIN a USING (depth, node) LEFT JOIN c p ON p.node = c.up AND p.depth = c.depth - 1"""
