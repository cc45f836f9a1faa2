"""Operator 3: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text, with exception phrases."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import batches
from .shared import doc_columns, fold, hash_sample, materialise

# Letters of other alphabets that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝαορτυνικɑɡ", "aeopcyxijsdhlqwaoptuvikag", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))


def _folding() -> dict[int, str]:
    """Every sign of ASCII and Latin-1 that is no letter parts words; look-alikes, full-width forms and digits become letters."""
    out = {i: " " for i in range(0x100) if not chr(i).isalpha()}
    out |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {ord(k): v for k, v in {**HOMOGLYPHS, **DIGITS}.items()}
    out |= {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # unseen signs within words
    return out | {i: " " for i in range(0x2010, 0x2028)}


FOLDING = _folding()


def folded(text: str) -> str:
    """Lower case, folded, words parted by one space, with one before and after."""
    return f" {' '.join(text.lower().translate(FOLDING).split())} "


@dataclass
class Lexicon:
    """Folded word beginnings (" trash") and whole words (" trash ") with weights, exception phrases, and a logistic over the
    length-normalised sum. Its size is bounded by the learner's parameters."""

    weights: dict[str, float]
    exceptions: dict[str, str] = field(default_factory=dict)  # folded phrase to the entry that it excuses
    model: tuple[float, float, float] = (-4.0, 2.0, 2.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (x, len(w)))
        for phrase, w in self.exceptions.items():
            if w in self.weights:
                a.add_word(phrase, (-self.weights[w], len(phrase)))
        if len(a):
            a.make_automaton()
        return a


def measures(text: str, automaton) -> tuple[float, int, int]:
    """Weight, hits and words of a text."""
    t = folded(text)
    total, hits = 0.0, 0
    if len(automaton):
        for _, (x, _) in automaton.iter(t):
            total += x
            hits += 1 if x > 0 else -1
    return max(total, 0.0), max(hits, 0), len(t.split())


def _inputs(total: float, words: int) -> tuple[float, float]:
    return total / np.sqrt(words + 1.0), np.log1p(total)


def _features(words: list[str], shortest: int, longest: int) -> set[str]:
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def _counts(texts: DataFrame, features_of) -> DataFrame:
    """In how many texts each feature lies: partial counts by task, then one sum."""

    def run(it):
        seen: Counter = Counter()
        for b in batches(it):
            for t in b.column(0).to_pylist():
                seen.update(features_of(folded(t or "").split()))
        yield pa.RecordBatch.from_pydict({"f": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return texts.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, of_each: int, folds: int = 5) -> DataFrame:
    """doc_id, text, toxic of at most `of_each` rows of either label outside fold 0, chosen by a hash of doc_id. `of_each` is the
    documented bound of what the classifier is fitted on, so the chosen labels can be broadcast and only their texts shuffle; of rows
    with one doc_id the least text counts."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold("doc_id", folds) != 0).dropna().distinct()
    chosen = None
    for label in (0, 1):
        part = hash_sample(usable.where(F.col("toxic") == label), of_each, "doc_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    return doc_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def independent(sample: DataFrame) -> DataFrame:
    """The rows of sample (doc_id, text, toxic) that have the smallest doc_id among those of their label with the same least hash of
    five-word shingles, for each of three orders of the hashes: equal texts, and nearly all near copies, are one piece of evidence.
    At most `of_each` ids of either label are written and broadcast; no text shuffles."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 5, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i + 1, 5)))
    hashed = sample.select("doc_id", "toxic", words.alias("words")).select("doc_id", "toxic", hashes.alias("h"))
    orders = [0, 0x5555555555555555, 0x3C3C3C3C3C3C3C3C]
    least = [F.expr(f"array_min(transform(h, x -> x ^ {c}L))").alias(f"least{i}") for i, c in enumerate(orders)]
    ids = hashed.select("doc_id", "toxic", *least)
    for i in range(len(orders)):
        ids = ids.withColumn(f"first{i}", F.min("doc_id").over(W.partitionBy("toxic", f"least{i}")))
    alone = ids.where(" and ".join(f"doc_id = first{i}" for i in range(len(orders)))).select("doc_id", "toxic")
    return sample.join(F.broadcast(materialise(alone)), ["doc_id", "toxic"])


def _evidence(n: int, m: int, share: float) -> float:
    """Minus the logarithm of Chernoff's bound on the chance that n or more of n + m texts are toxic, where `share` of all are."""
    of = n / (n + m)
    return n * np.log(of / share) + (m * np.log((1 - of) / (1 - share)) if m else 0.0) if of > share else 0.0


def learn(docs: DataFrame, labels: DataFrame, of_each: int = 20_000, size: int = 4_000, chance: float = 1e-9, ratio: float = 5.0, shortest: int = 4, longest: int = 10) -> Lexicon:
    """Learn the lexicon from labelled rows outside fold 0 (at most of_each of either label), copies counted once (`independent`).

    Entries are word beginnings of `shortest` to `longest` letters and whole words of any length. One must be `ratio` times as frequent
    in toxic texts as in clean ones (add-half; its weight is the logarithm), and so unevenly spread that texts without regard to
    their label would spread it so with probability below `chance` at most. A beginning gives way to longer entries that have nearly
    all its toxic texts and fewer clean ones; of what remains, the shorter entry covers those that begin with it, and is lengthened as
    far as nearly all its toxic texts go on alike. Two-word phrases around an entry that five clean texts, and one in a thousand of
    them, and no toxic one hold excuse it. The logistic's inputs are the weight over the root of the words, and the weight's
    logarithm. Without rows of both labels the lexicon is empty.
    """
    drawn = labelled_sample(docs, labels, of_each).cache()  # bounded, and recomputable if an executor is lost
    sample = independent(drawn)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        drawn.unpersist()
        return Lexicon({})
    share, enough = toxic / (toxic + clean), -np.log(chance)
    bad = _counts(sample.where("toxic = 1"), lambda w: _features(w, shortest, longest)).where(F.col("n") >= enough / -np.log(share))
    found = {r["f"]: r["n"] for r in bad.collect()}  # many texts each, so bounded as the sample is
    names = sample.sparkSession.sparkContext.broadcast(frozenset(found))
    good = _counts(sample.where("toxic = 0"), lambda w: _features(w, shortest, longest) & names.value)
    held = {r["f"]: r["n"] for r in good.collect()}  # at most the features found above
    weights = dict(sorted(entries(found, held, toxic, clean, enough, ratio, shortest).items(), key=lambda x: (-found[x[0]] * x[1], x[0]))[:size])
    exceptions = _learn_exceptions(sample, weights, max(5, int(np.ceil(0.001 * clean))))
    lexicon = Lexicon(weights, exceptions)
    lexicon.model = _fit(drawn, lexicon)
    drawn.unpersist()
    return lexicon


def entries(found: dict[str, int], held: dict[str, int], toxic: int, clean: int, enough: float, ratio: float, shortest: int) -> dict[str, float]:
    """Of features in `found` toxic and `held` clean texts, those that `learn` describes, with weights."""
    odds = {f: (n + 0.5) / (toxic + 1) * (clean + 1) / (held.get(f, 0) + 0.5) for f, n in found.items()}
    share = toxic / (toxic + clean)
    pure = {f for f, x in odds.items() if x >= ratio and _evidence(found[f], held.get(f, 0), share) >= enough}
    beginnings = lambda f: (f[:k] for k in range(shortest + 1, len(f)))
    purer = {b for f in pure for b in beginnings(f) if b in pure and found[f] >= 0.9 * found[b] and held.get(f, 0) < held.get(b, 0)}
    kept: set[str] = set()
    for f in sorted(pure - purer, key=lambda f: (len(f), f)):
        if not any(b in kept for b in beginnings(f)):
            kept.add(f)
    longer: dict[str, str] = {}
    for f in found:
        if not f.endswith(" ") and f[:-1] in found and found[f] >= 0.95 * found[f[:-1]]:
            longer[f[:-1]] = f
    out = {}
    for f in kept:
        while f in longer:
            f = longer[f]
        out[f] = float(np.log(odds[f]))
    return out


def _learn_exceptions(sample: DataFrame, weights: dict[str, float], least: int) -> dict[str, str]:
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def around(words: list[str]) -> set[str]:
        out = set()
        for i, w in enumerate(words):
            entry = f" {w} " if f" {w} " in shared.value else next((f" {w[:k]}" for k in range(1, len(w) + 1) if f" {w[:k]}" in shared.value), None)
            if entry:
                out.update(f"{entry}\t {' '.join(words[a : a + 2])} " for a in (i - 1, i) if 0 <= a and a + 2 <= len(words))
        return out

    good = {r["f"] for r in _counts(sample.where("toxic = 0"), around).where(F.col("n") >= least).collect()}  # bounded likewise
    if not good:
        return {}
    bad = {r["f"] for r in _counts(sample.where("toxic = 1"), lambda w: around(w) & good).collect()}
    return {f.split("\t")[1]: f.split("\t")[0] for f in good - bad}


def _fit(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """A ridge logistic regression of the labels on the two inputs; the sample's bound also bounds what comes to the driver."""

    def run(it):
        a = lexicon.automaton()
        for b in batches(it):
            rows = [_inputs(m[0], m[2]) for m in (measures(t or "", a) for t in b.column(0).to_pylist())]
            x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), b.column(1).cast(pa.int32())], ["x", "y", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x double, y double, toxic int").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["x"], rows["y"]])
    t, w, ridge = rows["toxic"].to_numpy(float), np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (t - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5), hits, words of every row of docs (doc_id, text), over the whole text.

    Null text counts as empty; an empty text has the score of a text without hits. Repeated rows stay; an empty table gives no
    rows. The lexicon is bounded and goes with the code; no shuffle.
    """

    def run(it):
        a, (bias, by_length, by_sum) = lexicon.automaton(), lexicon.model
        for b in batches(it):
            found = [measures(t or "", a) for t in b.column(1).to_pylist()]
            x = np.array([_inputs(m[0], m[2]) for m in found]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(bias + x @ np.array([by_length, by_sum]), -30, 30)))
            columns = [b.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([m[1] for m in found], pa.int32()), pa.array([m[2] for m in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "hits", "words"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, hits int, words int")


def score_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """learn, then score every row; held_out marks fold 0, from which nothing is learned."""
    scored = score(docs, learn(docs, labels, **parameters))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "hits", "words")


def drop_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; decided in place, without a join."""
    lexicon = learn(docs, labels, **parameters)

    @F.pandas_udf("boolean")
    def rejected(text):
        a, (bias, by_length, by_sum) = lexicon.automaton(), lexicon.model
        rows = [_inputs(m[0], m[2]) for m in (measures(t or "", a) for t in text)]
        return text.__class__([bias + by_length * x + by_sum * y >= 0 for x, y in rows], dtype=bool)

    return docs.where(~rejected(docs["text"]))
