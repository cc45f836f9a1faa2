"""Operator 2: byte-level BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words are compiled with their ids into one shared-suffix automaton. The automaton's paths are numbered (each arc
carries the count of words that sort before it), and the number leads to the word's ids. Its arrays live in one flat buffer
that each Python worker maps into memory. Words that are not in it are merged exactly by the merge ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_columns, materialise

#: The pattern that parts a text into words before byte-level merges (a fixed value of this kind of vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells of the sieve of word checksums that lies beside the automaton.
SIEVE = 1 << 19
#: Entries that a worker's memo of resolved chunks may hold; bounds memory, not results.
MEMO = 600_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merge ranks of a tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * n
        for k, v in self.ids.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        made = [m[1] for m in sorted(self.merges.values())]
        self.core = None  # merges by id: the same as by rank where ids follow the merges
        if made == sorted(made) and made and max(self.single) < made[0]:
            self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={})._core_bpe

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: again and again the pair of least rank, leftmost first."""
        return self.core.encode_single_piece(word) if self.core else self.merge_by_rank(word)

    def merge_by_rank(self, word: bytes) -> list[int]:
        ids, merges = [self.single[b] for b in word], self.merges
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at, made = 1 << 60, -1, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and m[0] < best:
                    best, made, at = m[0], m[1], i
            if at < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions: n log n for words of any length."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (m := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over words as bytes; a word's number among the sorted words leads to its ids."""

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """One flat buffer: a header, then the arrays of states, arcs and outputs."""
        register: dict[tuple, int] = {}
        arcs_of: list[tuple] = []  # by state: (final, ((label, target), ...))
        counts: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs_of)
                arcs_of.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in key[1]))
            return state

        path: list[list] = [[0, []]]  # open nodes along the last word: [final, [[label, target]...]]
        last = b""
        order = sorted(words)
        for word in order:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            path += [[0, []] for _ in word[same:]]
            path[-1][0], last = 1, word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        root = freeze(path[0])
        first, final, label, target, skip = [0], [], [], [], []
        for is_final, arcs in arcs_of:
            before = is_final
            for b, t in arcs:
                label.append(b), target.append(t), skip.append(before)
                before += counts[t]
            first.append(len(label)), final.append(is_final)
        at, ids = [0], []
        for word in order:
            ids += words[word]
            at.append(len(ids))
        bits = np.zeros(SIEVE, "u1")
        bits[[zlib.crc32(w) % SIEVE for w in order]] = 1
        parts = [np.array(first, "<u4"), np.array(target, "<u4"), np.array(skip, "<u4"), np.array(at, "<u4"), np.array(ids, "<u4"), np.array(final, "u1"), bits, np.array(label, "u1")]
        head = np.array([root, *map(len, parts)], "<u4")
        return head.tobytes() + b"".join(p.tobytes() for p in parts)

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u4", 9)
        self.root, at, arrays = int(head[0]), head.nbytes, []
        for n, kind in zip(head[1:].tolist(), ["<u4"] * 5 + ["u1"] * 3, strict=True):
            arrays.append(memoryview(np.frombuffer(buffer, kind, n, at)))
            at += n * np.dtype(kind).itemsize
        self.first, self.target, self.skip, self.at, self.ids, self.final, self.sieve, self.label = arrays
        self.find, self.base = buffer.find, at - len(self.label)  # the labels lie at the end

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None."""
        if not self.sieve[zlib.crc32(word) % SIEVE]:  # most words that are not in it need no walk
            return None
        state, number = self.root, 0
        first, find, base = self.first, self.find, self.base
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number, state = number + self.skip[arc], self.target[arc]
        return self.ids[self.at[number] : self.at[number + 1]].tolist() if self.final[state] else None


_WORD = regex.compile(PATTERN)
#: A space before white space (or at the end): there a cut before each space could part a run of white space.
_RUNS = re.compile(r" \s")


def _mapped(buffer: bytes) -> mmap.mmap:
    """The buffer as a mapped file of the executor's scratch folder, which all its Python workers share."""
    path = os.path.join(tempfile.gettempdir(), f"daftar-lexicon-{hashlib.sha1(buffer).hexdigest()}")
    if not os.path.exists(path):
        handle, draft = tempfile.mkstemp(dir=tempfile.gettempdir())
        with os.fdopen(handle, "wb") as file:
            file.write(buffer)
        os.replace(draft, path)
    with open(path, "rb") as file:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


class Encoder:
    """Text to ids, little-endian unsigned 32-bit. Built once per Python worker."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = None
        if lexicon is not None:
            self.lexicon = Transducer(_mapped(lexicon))
        self.look = self.lexicon.get if self.lexicon is not None else lambda word: None
        self.merge = self.vocabulary.core.encode_single_piece if self.vocabulary.core else self.vocabulary.merge
        encoder = self

        class Memo(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = encoder.resolve(chunk)
                made = struct.pack(f"<{len(ids)}I", *ids)
                if len(self) < MEMO:
                    self[chunk] = made
                return made

        self.memo = Memo()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None

    def resolve(self, chunk: str) -> list[int]:
        """The ids of a chunk: the lexicon's for its words, else merged."""
        ids: list[int] = []
        look, merge = self.look, self.merge
        for w in _WORD.findall(chunk):
            word = w.encode()
            ids += look(word) or merge(word)
        return ids

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.lexicon is None and self.vocabulary.core:
            return array("I", self.vocabulary.core.encode_ordinary(text)).tobytes()
        if text[-1] == " " or _RUNS.search(text):
            return b"".join(map(self.memo.__getitem__, _WORD.findall(text)))
        chunks = text.split(" ")
        first = self.memo[chunks[0]] if chunks[0] else b""
        return first + b"".join([self.memo[" " + c] for c in chunks[1:]])

    def encode(self, text: str) -> bytes:
        """Special tokens in the text become their ids; the rest is cut before spaces, and each chunk is resolved once."""
        if self.split is None or not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}
        return b"".join(special[p] if p in special else self._plain(p) for p in self.split.split(text))

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False): the tokens' bytes joined, invalid UTF-8 replaced."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, lexicon=None) -> Encoder:
    """The worker's encoder for a vocabulary and a broadcast lexicon (None: without)."""
    key = (path, None if lexicon is None else lexicon.id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, None if lexicon is None else lexicon.value)
    return _encoders[key]


class Lexicon:
    """A broadcast buffer with a name of its own."""

    def __init__(self, spark, buffer: bytes):
        self.id, self._broadcast = hashlib.sha1(buffer).hexdigest(), spark.sparkContext.broadcast(buffer)

    @property
    def value(self) -> bytes:
        return self._broadcast.value


def batches(it: Iterable[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most size rows, so that a batch of long texts stays small in Python."""
    for b in it:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


#: Distinct chunks that a task counts before it hands the counts on (some 50 MB).
CHUNKS_HELD = 300_000


def frequent_words(docs: DataFrame, size: int, least: int = 8) -> list[str]:
    """The words that occur most often over all texts, at least `least` times in all, at most size. Tasks hand on every count, so the
    words don't depend on how texts are dealt out."""

    def count(it):
        seen: Counter = Counter()
        for b in batches(it, 64):
            for t in b.column(0).to_pylist():
                seen.update(t.split(" "))
            if len(seen) >= CHUNKS_HELD:
                yield words_in(seen)
                seen = Counter()
        yield words_in(seen)

    def words_in(seen):
        words: Counter = Counter()
        for chunk, n in seen.items():
            if chunk:
                for w in _WORD.findall(" " + chunk):
                    words[w] += n
        return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    texts = docs.select(F.col("text")).where(F.length("text") > 0)
    found = materialise(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    # a histogram of counts tells from which count on at most `size` words remain, so only those come to the driver
    step = F.floor(F.log2("n") * 8).cast("int")
    kept, least_step = 0, None
    for s, n in sorted(found.groupBy(step.alias("s")).agg(F.count("*")).collect(), reverse=True):
        kept += n
        if kept > size:
            break
        least_step = s
    return [] if least_step is None else [r[0] for r in found.where(step >= least_step).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, size: int = 32_768) -> Lexicon:
    """Compile the most frequent words with their ids. size bounds what reaches the driver and what is broadcast (a few MB)."""
    vocabulary = Vocabulary(path)
    words = {w.encode(): vocabulary.merge(w.encode()) for w in frequent_words(docs, size)}
    return Lexicon(docs.sparkSession, Transducer.compile(words))


def encode_documents(docs: DataFrame, path: str, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id long, ids binary (little-endian unsigned 32-bit). Null text: no ids. Repeated rows stay. No shuffle."""

    def run(it):
        e = encoder(path, lexicon)
        for b in batches(it):
            ids = [e.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_ids(ids: DataFrame, path: str) -> DataFrame:
    """doc_id long, text string of a table with doc_id and ids."""

    def run(it):
        e = encoder(path)
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return doc_columns(ids, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, lexicon_size: int = 32_768) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    docs: doc_id, text (other columns are ignored). Null and empty texts have no ids. Repeated rows give repeated rows; an
    empty table gives none. Very long texts take memory in proportion to their own length only.
    """
    lexicon = build_lexicon(docs, path, lexicon_size)

    def run(it):
        e = encoder(path, lexicon)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches(it, 256):
            rows = []
            for t in b.column(1).to_pylist():
                ids = e.encode(t or "")
                rows.append((len(ids) // 4, sha(ids), sha(e.decode(ids).encode())))
            n, x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
