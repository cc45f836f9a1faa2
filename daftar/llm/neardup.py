"""Operator 1: n-gram Jaccard join by a MinHash LSH forest and exact verification.

A text's signature holds, for each of `trees` trees, a path of `depth` minima. Each tree's paths are sorted into a prefix trie. A text
meets the others of a trie node at the shortest prefix whose node is small; where many texts share a prefix it stays long, up to the
whole path, or the tree is passed over. If the prefixes that a text has been given so do not promise the target recall for a pair at the
threshold, its prefixes are shortened further, into large nodes too, until they do. Texts that meet are compared by their whole
signatures, in trie order, and those near the threshold are chained into families. A family's shingle sets then come together once,
and every pair in it is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import batches
from .components import components
from .shared import discard, doc_columns, materialise

#: Members of a family, and bytes of their texts, of which one task holds two blocks; members of a trie node whose signatures one task
#: holds. Larger ones are cut into blocks, and each pair of blocks is a piece of work.
FAMILY_BLOCK, FAMILY_BYTES, NODE_BLOCK = 1_024, 32 << 20, 16_384
#: Texts of a trie node up to which it is small.
SMALL_NODE = 64
#: Family members up to which they are broadcast (under 80 bytes each, so 20 MB); beyond it texts and families meet by a shuffle.
BROADCAST_ROWS = 250_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs between white space."""
    return (text or "").lower().split()


def digest_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def _with_key(it):
    for b in batches(it, 256):
        keys = [digest_of(words_of(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1).cast(pa.string())], ["id", "key", "text"])


class Shingles:
    """64-bit hashes of the runs of n words of a text (of all words, if fewer; none, if there is none), with a memo of words."""

    def __init__(self, n: int, memo: int = 1_000_000):
        self.factors = np.random.default_rng(5).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        class Memo(dict):
            def __missing__(self, word):
                key = xxhash.xxh3_64_intdigest(word)
                if len(self) < memo:
                    self[word] = key
                return key

        self.memo = Memo()

    def __call__(self, words: list[str]) -> np.ndarray:
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = min(len(self.factors), len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            x = sum(h[i : len(h) - n + 1 + i] * f for i, f in enumerate(self.factors[:n])) + np.uint64(n)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def stop_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix, shortened from `depth`, at which a pair at the threshold meets in some tree with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= target:
            return d
    raise ValueError("too few trees for this recall even at depth 1")


def signatures(docs: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, key (128-bit digest of the words), n_bytes (of the text), sig (size minima of 32 bits; null without words) of every
    row."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(sets: list[np.ndarray]) -> np.ndarray:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), size), "<u4")
        with np.errstate(over="ignore"):
            for k, f in enumerate(factors):
                out[:, k] = np.minimum.reduceat((flat * f) >> np.uint64(32), starts)
        return out

    def run(it):
        shingles = Shingles(n)
        for b in batches(it, 256):
            keys, sets, sigs, n_bytes = [], [], [None] * b.num_rows, []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                keys.append(digest_of(words))
                sets.append(shingles(words))
                n_bytes.append(len(text.encode("utf-8", "replace")) if text else 0)
            at, held, n_held = [], [], 0
            for i, s in enumerate([*sets, None]):
                if held and (s is None or n_held >= 32_768):
                    for j, row in zip(at, minima(held), strict=True):
                        sigs[j] = row.tobytes()
                    at, held, n_held = [], [], 0
                if s is not None and len(s):
                    at.append(i), held.append(s)
                    n_held += len(s)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n_bytes", "sig"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key binary, n_bytes long, sig binary")


def _runs(it, key_columns: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys from a stream sorted by them; each yielded table holds one or more whole groups, and the
    last column `run` numbers them."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int):
        return tuple(b.column(c)[i].as_py() for c in key_columns)

    def made(parts):
        t = pa.Table.from_batches(parts)
        new = np.zeros(len(t), bool)
        for c in key_columns:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return t.append_column("run", pa.array(np.cumsum(new)))

    for b in it:
        if not b.num_rows:
            continue
        last = key(b, b.num_rows - 1)
        cut = b.num_rows
        while cut and key(b, cut - 1) == last:
            step = 1
            while cut - step * 2 >= 0 and key(b, cut - step * 2) == last:
                step *= 2
            cut -= step
        if held and cut == 0 and key(held[-1], held[-1].num_rows - 1) == last:
            held.append(b)
            continue
        whole = [*held, b.slice(0, cut)] if cut or held else []
        if whole:
            yield made(whole)
        held = [b.slice(cut)]
    if held:
        yield made(held)


def blocked(rows: DataFrame, group: str, blocks: Column, by: str) -> DataFrame:
    """Columns own, i and j: a group of one block is one piece (0, 0); a larger one is cut into `blocks`, and each row goes to every
    pair of blocks that holds its own. A piece with i < j compares only across its two blocks."""
    own = F.pmod(F.xxhash64(by), F.col("_m").cast("long")).cast("int")
    rows = rows.withColumn("_m", blocks.cast("int")).withColumn("own", own)
    rows = rows.withColumn("_j", F.explode(F.expr("CASE WHEN _m = 1 THEN array(0) ELSE sequence(0, _m - 1) END")))
    return rows.withColumn("i", F.least("own", "_j")).withColumn("j", F.greatest("own", "_j")).drop("_m", "_j")


def _chain(sig: np.ndarray, own: np.ndarray, across: bool, cut: int, asks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of those components of the graph of rows whose signatures agree in at least `cut` places that hold an asking row:
    breadth first, each visited row compared with the rows not reached yet, so tight groups cost little more than their size."""
    left, seeds, edges = np.arange(len(sig)), np.flatnonzero(asks), []
    while len(seeds):
        queue, left = [seeds[0]], left[left != seeds[0]]
        while queue and len(left):
            at = queue.pop()
            hit = (sig[left] == sig[at]).sum(1) >= cut
            if across:
                hit &= own[left] != own[at]
            found = left[hit]
            edges += [(at, x) for x in found]
            queue += found.tolist()
            left = left[~hit]
        seeds = left[asks[left]]
    return edges


def _mixed(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + more.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def paths(nodes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """base, rest, node: of each text and tree the hash of the first `least` minima of its path, and the other ones as bytes that sort
    as they do."""

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, trees, depth)
            base = np.tile(np.arange(1, trees + 1, dtype=np.uint64), (len(sig), 1))
            for k in range(least):
                base = _mixed(base, sig[:, :, k])
            rest = np.ascontiguousarray(sig[:, :, least:]).astype(">u4").tobytes()
            width = 4 * (depth - least)
            rests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(sig) * trees, [None, pa.py_buffer(rest)]).cast(pa.binary()) if width else pa.array([b""] * (len(sig) * trees), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(base.reshape(-1).view(np.int64)), rests, pa.array(np.repeat(b.column(0).to_numpy(), trees))], ["base", "rest", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "base long, rest binary, node long")


def descend(sorted_paths: Iterator[pa.RecordBatch], depth: int, least: int, stop: int, small: int) -> Iterator[pa.RecordBatch]:
    """node, taken, at, wide of each path of a sorted stream that shares its first `least` minima with another one.

    taken: the shortest prefix whose node has at most `small` paths (0: not even the whole path has), and `at` that node's key, if
    it has more than one; wide: the key of the node at prefix `stop`, if that is a large one. Nodes are only counted up to `small`,
    so of a node of any size little more than that is held.
    """
    levels = depth - least + 1
    keys = [np.empty((levels, 0), np.uint64)]
    nodes, past = [np.empty(0, np.int64)], [0] * levels

    def step(final: bool):
        key, node = np.concatenate(keys, axis=1), np.concatenate(nodes)
        n = key.shape[1]
        size, end = np.empty((levels, n), np.int64), n if final else max(n - 1, 0)
        last, open_ = [], True
        for k in range(levels):
            starts = np.flatnonzero(np.concatenate([[True], key[k, 1:] != key[k, :-1]])) if n else np.empty(0, np.int64)
            lengths = np.diff(np.append(starts, n))
            lengths[:1] += past[k]
            size[k] = np.repeat(lengths, np.diff(np.append(starts, n)))
            last.append(int(starts[-1]) if n else 0)
            if not final and open_ and n and lengths[-1] <= small:  # the last node may still grow
                end, open_ = min(end, last[k]), False
        for k in range(levels):
            past[k] = (past[k] if last[k] == 0 else 0) + max(0, end - last[k])
        keys[:], nodes[:] = [key[:, end:]], [node[end:]]
        key, node, size = key[:, :end], node[:end], size[:, :end]
        use = size[0] > 1 if end else np.empty(0, bool)
        key, node, size = key[:, use], node[use], size[:, use]
        fits = size <= small
        level, any_ = fits.argmax(0), fits.any(0)
        column = np.arange(len(node))
        at, alone = key[level, column], size[level, column] == 1
        taken = np.where(any_, level + least, 0).astype(np.int32)
        large = size[stop - least] > small
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(taken), pa.array(at.view(np.int64), mask=alone | ~any_), pa.array(key[stop - least].view(np.int64), mask=~large)], ["node", "taken", "at", "wide"]
        )

    for b in sorted_paths:
        if b.num_rows:
            rest = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(b.num_rows, levels - 1)
            now = [np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint64)]
            for k in range(levels - 1):
                now.append(_mixed(now[-1], rest[:, k] + np.uint64(1)))
            keys.append(np.stack(now)), nodes.append(b.column(2).to_numpy())
            out = step(False)
            if out.num_rows:
                yield out
    out = step(True)
    if out.num_rows:
        yield out


def meetings(nodes: DataFrame, threshold: float, trees: int, depth: int, stop: int, recall: float) -> DataFrame:
    """at, node, asks: which texts (node, sig) meet in which trie nodes. Of a large node's texts only those ask whose small nodes do not
    promise the recall; it is left out if none does."""
    least = max(1, stop - 1)

    def run(it):
        yield from descend(it, depth, least, stop, SMALL_NODE)

    sorted_paths = paths(nodes, trees, depth, least).repartition("base").sortWithinPartitions("base", "rest")
    places = materialise(sorted_paths.mapInArrow(run, "node long, taken int, at long, wide long"))
    # a text alone in a tree's prefix of `least` minima has that prefix, and no row here
    missed = lambda d: F.log(1 - F.pow(F.lit(threshold), d))
    changed = F.when(F.col("taken") > 0, missed(F.col("taken"))).otherwise(0.0) - missed(F.lit(least))
    short = places.groupBy("node").agg((F.sum(changed) + trees * missed(F.lit(least))).alias("log")).where(F.col("log") > float(np.log(1 - recall) + 1e-9))
    asking = materialise(short.select("node", F.lit(True).alias("asks")))
    wide = places.where("wide is not null").select(F.col("wide").alias("at"), "node").join(asking, "node", "left")
    open_ = wide.where("asks").select("at").distinct()
    large = wide.join(open_, "at", "left_semi").select("at", "node", F.coalesce("asks", F.lit(False)).alias("asks"))
    return places.where("at is not null").select("at", "node", F.lit(True).alias("asks")).unionByName(large)


def candidate_edges(nodes: DataFrame, threshold: float, trees: int, depth: int, stop: int, recall: float, near: float) -> DataFrame:
    """a, b: edges that chain texts which meet in a trie node and agree in `near` of their signatures."""
    size = trees * depth
    met = materialise(meetings(nodes, threshold, trees, depth, stop, recall))
    shared = met.groupBy("at").agg(F.count("*").alias("n"))
    rows = met.join(shared, "at").join(nodes.select("node", "sig"), "node")
    pieces = blocked(rows, "at", F.ceil(F.col("n") / NODE_BLOCK), "node").select("at", "i", "j", "own", "node", "asks", "sig")
    least = int(np.ceil(near * size))

    def run(it):
        for t in _runs(it, ["at", "i", "j"]):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, size)
            node, own, group = (t.column(c).to_numpy() for c in ("node", "own", "run"))
            asks = t.column("asks").to_numpy()
            across = t.column("i").to_numpy() != t.column("j").to_numpy()
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            sizes = np.diff(np.append(starts, len(group)))
            edges: list[tuple[int, int]] = []
            for n in np.unique(sizes[sizes <= 16]).tolist():
                one, two = np.triu_indices(n, 1)
                first = starts[sizes == n]
                for k in range(0, len(first), max(1, 20_000 // max(1, len(one)))):
                    f = first[k : k + max(1, 20_000 // max(1, len(one))), None]
                    a, b = (f + one).reshape(-1), (f + two).reshape(-1)
                    hit = ((sig[a] == sig[b]).sum(1) >= least) & (~across[a] | (own[a] != own[b]))
                    edges += zip(a[hit].tolist(), b[hit].tolist(), strict=True)
            for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
                edges += [(s + x, s + y) for x, y in _chain(sig[s : s + n], own[s : s + n], bool(across[s]), least, asks[s : s + n])]
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["a", "b"])

    sorted_pieces = pieces.repartition("at", "i", "j").sortWithinPartitions("at", "i", "j", "sig")
    return sorted_pieces.mapInArrow(run, "a long, b long").distinct()


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have exactly the similarity: shared shingles counted by products of the incidence matrix, column chunk by chunk,
    over the shingles that two sets or more hold."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.append(False, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    held = np.bincount(column)
    several = held > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    column, owner = number[column[keep]], owner[keep]
    shared, width = np.zeros((n, n), np.float64), 4_096
    for start in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        shared += m @ m.T
    union = sizes[:, None] + sizes[None, :] - shared
    out = (shared >= threshold * union - 1e-9) & (union > 0)
    np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    root, seen = np.arange(len(linked)), np.zeros(len(linked), bool)
    for i in range(len(linked)):
        if not seen[i]:
            seen[i], queue = True, [i]
            while queue:
                found = np.flatnonzero(linked[queue.pop()] & ~seen)
                seen[found], root[found] = True, i
                queue += found.tolist()
    return root


def _classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 6, recall: float = 0.9999, margin: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, key) and one row per key, the digest of the words: key, class_id, n_links, copies, first_copy, and
    class_key, the key of its class's first row by (doc_id is null, doc_id, key)."""
    size, stop = trees * depth, stop_depth(threshold, trees, depth, recall)
    rows = materialise(signatures(docs, n, size))
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    nodes = materialise(firsts.withColumn("node", F.monotonically_increasing_id()))
    edges = candidate_edges(nodes.where("sig is not null"), threshold, trees, depth, stop, recall, threshold - margin)
    families = materialise(components(edges).join(nodes.select("node", "key", "first_copy", "copies", "n_bytes"), "node"))
    blocks = F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n_bytes") / FAMILY_BYTES, F.lit(1)))
    members = families.join(families.groupBy("root").agg(blocks.alias("blocks")), "root").select("root", "blocks", "node", "key", "first_copy", "copies")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"])
    if families.count() <= BROADCAST_ROWS:
        ids = F.broadcast(members.select("first_copy").distinct())
        texts = texts.join(ids, F.expr("id <=> first_copy"), "left_semi")
        members = F.broadcast(members)
    keyed = texts.mapInArrow(_with_key, "id long, key binary, text string")  # ids repeat, so a text meets its family by its words
    found = keyed.alias("t").join(members.alias("m"), F.expr("t.key = m.key AND t.id <=> m.first_copy")).select("m.root", "m.blocks", "m.node", "m.copies", "t.text")
    pieces = blocked(found, "root", F.col("blocks"), "node").select("root", "i", "j", "own", "node", "copies", "text")

    def verify(it):
        shingles = Shingles(n)
        for t in _runs(it, ["root", "i", "j"]):
            group = t.column("run").to_numpy()
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                part = t.slice(a, b - a)
                sets: dict[int, np.ndarray] = {}
                info: dict[int, tuple[int, int]] = {}
                for node, text, own, copies in zip(*(part.column(c).to_pylist() for c in ("node", "text", "own", "copies")), strict=True):
                    if node not in sets:  # rows of one doc_id may have the same words
                        sets[node], info[node] = np.unique(shingles(words_of(text))), (own, copies)
                linked = _links(list(sets.values()), threshold)
                own, copies = np.array(list(info.values()), np.int64).T
                if part.column("i")[0].as_py() != part.column("j")[0].as_py():
                    linked &= own[:, None] != own[None, :]
                node = np.array(list(sets), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((linked * copies[None, :]).sum(1)), pa.array(node[_roots(linked)])], ["node", "links", "other"])

    placed = pieces.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = materialise(placed.mapInArrow(verify, "node long, links long, other long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = nodes.select("node", "key", "first_copy", "copies").join(links, "node", "left").join(roots, "node", "left")
    classes = materialise(classes.withColumn("root", F.coalesce("root", "node")))
    discard(nodes, families, verified)
    first = F.min(F.struct(F.col("first_copy").isNull().alias("none"), "first_copy", "key"))
    of_class = classes.groupBy("root").agg(first.alias("first")).select("root", F.col("first.first_copy").alias("class_id"), F.col("first.key").alias("class_key"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return rows.select("doc_id", "key"), classes.join(of_class, "root").select("key", "class_id", links, "copies", "first_copy", "class_key")


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, depth: int = 6, recall: float = 0.9999, margin: float = 0.15) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, copies, first_copy.

    Texts are sets of hashes of n successive words (lower case, parted by white space; all words if fewer than n). Two rows link
    if their sets' Jaccard similarity is at least `threshold`, or if they have the same words (so also without any word: null
    and empty texts are one class). n_links counts the other rows that a row links to, copies included; class_id is the
    smallest doc_id of all rows that links connect, copies counts the rows with the same words, first_copy is their smallest
    doc_id. Similarities are verified exactly; a pair at the threshold meets in the forest with the target recall, pairs above it
    with a higher one (of those that meet one in 40,000 at the threshold differs from it by more than `margin` in its signature
    and is not compared), and within a family all pairs are. Repeated rows are copies. An empty table gives no rows; null doc_ids
    count last.
    """
    rows, per_key = _classes(docs, n, threshold, trees, depth, recall, margin)
    return rows.join(per_key, "key").select("doc_id", "class_id", "n_links", "copies", "first_copy")


def keep_first_of_class(docs: DataFrame, **parameters) -> DataFrame:
    """Of each class of jaccard_classes exactly one row of docs, the first by (doc_id is null, doc_id, digest of the words), with all
    its columns. Rows are told apart by their words, not by doc_id, so repeated and null doc_ids do no harm.

    A row whose words no other row has, first of its class, passes straight through. Of rows that repeat the words of a class's
    first one, the aggregation keeps one before and after the shuffle, so a hot group costs one row a task.
    """
    _, per_key = _classes(docs, **parameters)
    touched = materialise(per_key.where("copies > 1 or key <> class_key").select(F.col("key").alias("_key"), (F.col("key") == F.col("class_key")).alias("_first")))
    if touched.count() <= BROADCAST_ROWS:
        touched = F.broadcast(touched)

    @F.pandas_udf("binary")
    def digest(text):
        return text.map(lambda t: digest_of(words_of(t)))

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_whole"), docs["doc_id"].alias("_id"), digest(docs["text"]).alias("_key"))
    marked = rows.join(touched, "_key", "left")
    repeated = marked.where("_first").groupBy("_key").agg(F.min_by("_whole", F.struct(F.col("_id").isNull(), "_id")).alias("_whole"))
    return marked.where("_first is null").select("_whole.*").unionByName(repeated.select("_whole.*"))
