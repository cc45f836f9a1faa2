"""Operator 9: language-model scoring by deleted interpolation of n-gram, unigram and uniform estimates.

Texts become blocks of word numbers, written once. Each block asks for the counts of its distinct n-grams of every length: sorted
64-bit keys in cells of a key range; the range's task adds up the training counts of all blocks and answers every cell in its
own order, so answers carry counts alone. Mixture weights come by bucket of the context's frequency from expectation-
maximisation on training rows set aside, whose events reach the driver only as histograms of bounded size. Bigram, unigram and
uniform estimates are mixed at once; each longer n-gram is then mixed with the mixture below it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches
from .shared import doc_columns, fold, materialise

#: The key of the end of a text, which also stands before its first word. Words hash to other keys but for one chance in 2^64.
END = 0x9E3779B97F4A7C15
BLOCK_TOKENS = 1_000_000
#: The longest n-grams that are counted.
ORDER = 2
#: Every eighth training row, by a hash, is set aside for the mixture weights; its counts join the others for the scores.
ASIDE = 8
#: Buckets of a context's frequency: 0, 1, 2, 3-4, 5-8, ... by powers of two.
BUCKETS = 26
#: Steps of the histogram's logarithmic axes, by factor 2^(1/4): 0 is "no count", then from 1 down to 2^-40.
STEPS = 162


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words
        return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _gram_keys(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each word, for n from 2 to order; words hold END at each text's end. Before a text stand ENDs."""
    first = np.concatenate([[True], words[:-1] == np.uint64(END)])
    shorter, begun, out = words, np.array([END], np.uint64), []
    for _ in range(2, order + 1):
        out.append(_pair(np.where(first, begun, np.roll(shorter, 1)), words))
        shorter, begun = out[-1], _pair(begun, np.array([END], np.uint64))
    return out


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys as differences, by byte planes."""
    return _pack(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(x, "u1").reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


BLOCK = "block long, docs binary, ends binary, part binary, vocabulary binary, words binary"


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of about block_tokens tokens: doc ids, where each text ends, its part (0 training, 1 set aside, 2 held out), the sorted
    distinct word keys, and the words as numbers into them."""

    def cut(ids, part, texts):
        words = np.concatenate(texts)
        vocabulary, numbers = np.unique(words, return_inverse=True)
        ends = np.cumsum([len(t) for t in texts])
        return uuid.uuid4().int >> 65, _pack(np.array([np.iinfo(np.int64).min if i is None else i for i in ids], "<i8")), _pack(ends.astype("<i8")), _pack(np.array(part, "u1")), _pack_keys(vocabulary), _pack(numbers.astype("<u4"))

    def emit(row):
        kinds = [pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    def run(it):
        class Memo(dict):
            def __missing__(self, word):
                key = xxhash.xxh3_64_intdigest(word)
                if len(self) < 400_000:
                    self[word] = key
                return key

        memo, ids, part, texts, n = Memo(), [], [], [], 0
        for b in batches(it, 256):
            for i, p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = text.lower().split()  # of bytes: ASCII alone
                found = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
                ids.append(i), part.append(p), texts.append(np.append(found, np.uint64(END)))
                n += len(found) + 1
                if n >= block_tokens:
                    yield emit(cut(ids, part, texts))
                    ids, part, texts, n = [], [], [], 0
        if ids:
            yield emit(cut(ids, part, texts))

    held = fold("doc_id", 7) == 2
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("aside")), F.lit(ASIDE)) == 0
    part = F.when(held, 2).when(aside, 1).otherwise(0)
    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), part.cast("int"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.mapInArrow(run, BLOCK)


class _Block:
    """A block's texts, and for each kind (0 words, 1 bigrams, ...) its distinct keys and every token's number among them."""

    def __init__(self, row: dict, order: int):
        self.docs, self.ends = _unpack(row["docs"], "<i8"), _unpack(row["ends"], "<i8")
        self.part, vocabulary, numbers = _unpack(row["part"], "u1"), _unpack_keys(row["vocabulary"]), _unpack(row["words"], "<u4")
        self.token_part = np.repeat(self.part, np.diff(self.ends, prepend=0))
        self.end = int(np.searchsorted(vocabulary, np.uint64(END)))
        self.grams = [(vocabulary, numbers), *(np.unique(keys, return_inverse=True) for keys in _gram_keys(vocabulary[numbers], order))]

    def asked(self, kind: int):
        """Distinct keys of a kind, and how often they occur in each part of training."""
        keys, at = self.grams[kind]
        return keys, [np.bincount(at[self.token_part == p], minlength=len(keys)).astype("<u4") for p in (0, 1)]


CELL = "kind int, range int, block long, keys binary, counts binary"


def cells(table: DataFrame, ranges: int, order: int) -> DataFrame:
    """What the blocks ask: sorted keys and their training counts, by kind and key range."""

    def run(it):
        for b in it:
            for row in b.to_pylist():
                block = _Block(row, order)
                for kind in range(order):
                    keys, counts = block.asked(kind)
                    at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(at, prepend=-1))  # only ranges with keys: cells never outnumber keys
                    bounds = zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)
                    out = [(kind, int(at[x]), row["block"], _pack_keys(keys[x:y]), _pack(np.stack([c[x:y] for c in counts]))) for x, y in bounds]
                    for i in range(0, len(out), 256):
                        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 256], strict=True), kinds, strict=True)], [c.split()[0] for c in CELL.split(", ")])

    return table.mapInArrow(run, CELL)


ANSWER = "kind int, range int, block long, counts binary, seen binary, types long, aside_types long"


def _answer(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a key range and answers each of its cells: `counts` without what was set aside, only for keys that the cell's block
    has among its set-aside tokens, and `seen` with it, for all."""
    names, keys, counts = [], [], []
    for b in groups:
        names += b.column("block").to_pylist()
        keys += [_unpack_keys(x) for x in b.column("keys").to_pylist()]
        counts += [_unpack(x, "<u4").reshape(2, -1) for x in b.column("counts").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.stack([np.bincount(at, np.concatenate([c[p] for c in counts]), len(every)).astype("<u8") for p in (0, 1)])
    types, start = (int((total.sum(0) > 0).sum()), int((total[0] > 0).sum())), 0
    for i, (name, k) in enumerate(zip(names, keys, strict=True)):
        own, aside = total[:, at[start : start + len(k)]], counts[i][1] > 0
        start += len(k)
        first = types if i == 0 else (0, 0)
        row = [key[0].as_py(), key[1].as_py(), name, _pack(own[0][aside]), _pack(own.sum(0)), *first]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in ANSWER.split(", ")])


def _counts_of(answers: pa.Table, column: str, order: int) -> list[np.ndarray]:
    out = []
    for kind in range(order):
        rows = sorted((r["range"], r[column]) for r in answers.select(["kind", "range", column]).to_pylist() if r["kind"] == kind)
        out.append(np.concatenate([_unpack(x, "<u8") for _, x in rows]).astype(np.float64))
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(context, 0.5))) + 1, BUCKETS - 1).astype(np.int64)


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-4 * np.log2(np.where(p > 0, p, 1))), 1, STEPS - 1), 0).astype(np.int64)


def _estimates(counts: list[np.ndarray], grams: list[np.ndarray], end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind from bigrams on: every token's context count, and the n-gram's share of it. A text's first context has been seen
    as often as texts end."""
    first = np.concatenate([[True], grams[0][:-1] == end])
    seen = [c[g] for c, g in zip(counts, grams, strict=True)]
    out = []
    for shorter, n in zip(seen, seen[1:], strict=False):
        h = np.where(first, counts[0][end], np.roll(shorter, 1))
        out.append((h, n / np.maximum(h, 1)))
    return out


def _mixed(estimates, unigram: np.ndarray, types: int, mixtures: list[np.ndarray]) -> np.ndarray:
    """The mixture of as many kinds as have weights."""
    p = unigram
    for i, ((h, share), mixture) in enumerate(zip(estimates, mixtures, strict=False)):
        mix = mixture[_bucket(h)]
        p = mix[:, 0] * share + mix[:, 1] * p + (mix[:, 2] / (types + 1) if i == 0 else 0)
    return p


def set_aside(table: DataFrame, order: int) -> DataFrame:
    """block, grams, end: each block's set-aside tokens, by kind numbered among its set-aside n-grams. END's number is end."""

    def run(it):
        for b in it:
            for row in b.to_pylist():
                block = _Block(row, order)
                use = block.token_part == 1
                if use.any():
                    numbered = [np.unique(numbers[use], return_inverse=True) for _, numbers in block.grams]
                    grams = [_pack(at.astype("<u4")) for _, at in numbered]
                    columns = [pa.array([row["block"]], pa.int64()), pa.array([grams], pa.list_(pa.binary())), pa.array([int(np.searchsorted(numbered[0][0], block.end))], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "grams", "end"])

    return table.mapInArrow(run, "block long, grams array<binary>, end long")


def histogram(aside: DataFrame, answers: DataFrame, tokens: int, types: int, order: int, mixtures: list[np.ndarray]) -> DataFrame:
    """Events set aside by (context bucket, step of the next kind's estimate, step of the mixture below it), from counts without them.
    The next kind is the one after those with mixtures; below bigrams is the unigram estimate."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        kinds = [("bucket", pa.int64()), ("own", pa.int64()), ("below", pa.int64()), ("n", pa.int64())]
        found = np.empty((0, 2), np.int64)
        if rows:
            grams, counts = [_unpack(x, "<u4") for x in rows[0]["grams"]], _counts_of(right, "counts", order)
            estimates, unigram = _estimates(counts, grams, rows[0]["end"]), counts[0][grams[0]] / max(tokens, 1)
            h, share = estimates[len(mixtures)]
            code = (_bucket(h) * STEPS + _step(share)) * STEPS + _step(_mixed(estimates, unigram, types, mixtures))
            found = np.column_stack(np.unique(code, return_counts=True))
        code = found[:, 0]
        columns = (code // STEPS**2, code // STEPS % STEPS, code % STEPS, found[:, 1])
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds, columns, strict=True)})

    asked = answers.select("kind", "range", "block", "counts")
    cogrouped = aside.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, "bucket long, own long, below long, n long")
    return cogrouped.groupBy("bucket", "own", "below").agg(F.sum("n").alias("n"))


def weights(events: np.ndarray, types: int | None, rounds: int = 60) -> np.ndarray:
    """Per context bucket the weights of a kind's own estimate, of what is below it, and (where types are given) of the uniform one:
    expectation-maximisation over the histogram's events (bucket, own, below, n), with one event of each as prior so that no weight is 0."""
    estimate = lambda s: np.where(s > 0, 2.0 ** (-(s - 1) / 4), 0.0)
    uniform, out = types is not None, np.zeros((BUCKETS, 3))
    for b in range(BUCKETS):
        mine = events[events[:, 0] == b]
        p = np.column_stack([estimate(mine[:, 1]), estimate(mine[:, 2]), np.full(len(mine), 1 / (types + 1) if uniform else 0.0)])
        prior = np.array([float(b > 0), 1.0, float(uniform)])  # an unseen context has no estimate of its own
        out[b] = prior / prior.sum()
        for _ in range(rounds):
            share = p * out[b]
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            got = (share * mine[:, 3:4]).sum(0) + prior
            out[b] = got / got.sum()
    return out


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    A-Z lower-cased; words are runs without ASCII white space, and each text ends in one end token. Learned from all rows whose
    crc32(doc_id) mod 7 is not 2. score: sum over tokens of log10 of the mixture of c(before, word) / c(before), c(word) / N and
    1 / (V + 1), and for an order above 2 of the shares of longer contexts with it. Null and empty texts are one end token; repeated rows count each time; an empty table gives no rows. Memory of
    a task: one block, or one key range; both are of fixed size on average, as ranges follow the number of input partitions.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    table = materialise(blocks(docs, block_tokens))
    n_blocks = table.count()
    out = "doc_id long, part int, n_tokens long, n_known long, base_score double, score double"
    final = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not n_blocks:
        return spark.createDataFrame([], final)
    ranges = max(8, n_blocks)
    answers = materialise(cells(table, ranges, order).groupBy("kind", "range").applyInArrow(_answer, ANSWER))
    types, rest_types = answers.where("kind = 0").agg(F.sum("types"), F.sum("aside_types")).first()

    def tally(it):
        for b in it:
            for row in b.to_pylist():
                lengths, part = np.diff(_unpack(row["ends"], "<i8"), prepend=0), _unpack(row["part"], "u1")
                yield pa.RecordBatch.from_pydict({"part": pa.array([0, 1, 2], pa.int32()), "n": pa.array([int(lengths[part == p].sum()) for p in range(3)], pa.int64())})

    tokens = {r["part"]: r["n"] for r in table.select("ends", "part").mapInArrow(tally, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    rest, train = tokens.get(0, 0), tokens.get(0, 0) + tokens.get(1, 0)
    aside, mixtures = set_aside(table, order), []
    if order > 2:
        aside = materialise(aside)
    for _ in range(1, order):
        events = histogram(aside, answers, rest, rest_types or 0, order, mixtures).select("bucket", "own", "below", "n").toPandas().to_numpy(np.int64).reshape(-1, 4)
        mixtures.append(weights(events, None if mixtures else rest_types or 0))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        kinds = [(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in out.split(", ")]
        if not rows:
            return pa.table({k: pa.array([], t) for k, t in kinds})
        block, counts = _Block(rows[0], order), _counts_of(right, "seen", order)
        grams = [numbers for _, numbers in block.grams]
        c = counts[0][grams[0]]
        p = _mixed(_estimates(counts, grams, block.end), c / max(train, 1), types, mixtures)
        base = np.log10((c + 1) / (train + 1.0 * (types + 1)))
        starts = np.concatenate([[0], block.ends[:-1]])
        over = lambda x: np.add.reduceat(x, starts)
        ids = pa.array(block.docs, mask=block.docs == np.iinfo(np.int64).min)
        columns = (ids, block.part.astype(np.int32), np.diff(block.ends, prepend=0), over((c > 0).astype(np.int64)), over(base), over(np.log10(p)))
        return pa.table({k: pa.array(v, t) if not isinstance(v, pa.Array) else v for (k, t), v in zip(kinds, columns, strict=True)})

    scored = table.groupBy("block").cogroup(answers.select("kind", "range", "block", "seen").groupBy("block")).applyInArrow(run, out)
    return scored.select("doc_id", (F.col("part") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
