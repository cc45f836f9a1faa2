"""The numbered operators against brute force, round trips and held-out labels, and on awkward rows."""

import collections
import hashlib
import html as entities
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from daftar.llm import ann, bpe, dedup, html, lm, neardup, packing, queries, sharding, toxicity, urls
from daftar.llm.components import components
from tests.conftest import SF, same_rows

VOCABULARY = queries.vocabulary()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, node long, score double"
LONG = "lorem ipsum dolor " * 20_000


def docs(spark, *rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, "k", 1, 2, 3.0) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "same text here", "a"), (4, "same text here", "a"), (5, "same  text\nhere", "a"), (6, LONG, "b"), (7, LONG, "b"), (None, "no id", "a"), (8, "x", "c"), (9, "<|endoftext|> \x00 é 🎉", "c")]
    return docs(spark, *rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# 1


def jaccard_by_force(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        n = min(5, len(w))
        sets.append((tuple(w), {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()))
    link = [[i != j and (a[0] == b[0] or (len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]) - 1e-9 and bool(a[1] & b[1]))) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    seen, root = set(), {}
    for i in range(len(rows)):
        if i not in seen:
            queue, members = [i], set()
            while queue:
                x = queue.pop()
                if x not in members:
                    members.add(x)
                    queue += [y for y in range(len(rows)) if link[x][y]]
            seen |= members
            least = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
            root |= dict.fromkeys(members, least)
    return sorted(((r[0], root[i], sum(link[i])) for i, r in enumerate(rows)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_classes(df).collect()), key=str)


def test_jaccard_on_real_and_awkward_rows(spark, real, awkward, empty):
    for df in (real, awkward):
        assert joined(df) == jaccard_by_force([(r.doc_id, r.text) for r in df.collect()])
    assert joined(empty) == []


def test_jaccard_cuts_large_families_and_nodes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 1000, 60)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.integers(0, 60)] = f"new{i}"
        rows.append((i, " ".join(words), "a"))
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 16)
    monkeypatch.setattr(neardup, "NODE_BLOCK", 16)
    assert joined(docs(spark, *rows)) == jaccard_by_force([r[:2] for r in rows])
    monkeypatch.setattr(neardup, "SMALL_NODE", 4)  # so that texts ask in large nodes
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 1_000), monkeypatch.setattr(neardup, "FAMILY_BYTES", 4_000)
    assert joined(docs(spark, *rows)) == jaccard_by_force([r[:2] for r in rows])


def test_sizes_of_trie_nodes_over_batches():
    rng = np.random.default_rng(4)
    rows = sorted((int(rng.integers(0, 3)), *rng.integers(0, 3, 2).tolist()) for _ in range(500))
    counts = [collections.Counter(r[: k + 1] for r in rows) for k in range(3)]
    for small, batch in ((3, 7), (20, 1), (64, 90), (400, 500)):
        parts = [rows[i : i + batch] for i in range(0, 500, batch)]
        made = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([np.array(r[1:], ">u4").tobytes() for r in p]), pa.array(range(i * batch, i * batch + len(p)))], ["base", "rest", "node"]) for i, p in enumerate(parts)]
        got = {r["node"]: r for b in neardup.descend(iter(made), 5, 3, 4, small) for r in b.to_pylist()}
        groups = collections.defaultdict(set)
        for i, r in enumerate(rows):
            sizes = [counts[k][r[: k + 1]] for k in range(3)]
            if sizes[0] == 1:
                assert i not in got
                continue
            taken = next((k for k in range(3) if sizes[k] <= small), None)
            assert got[i]["taken"] == (0 if taken is None else taken + 3)
            assert (got[i]["wide"] is not None) == (sizes[1] > small)
            assert (got[i]["at"] is not None) == (taken is not None and sizes[taken] > 1)
            if got[i]["at"] is not None:
                groups[got[i]["at"]].add(r[: taken + 1])
        assert all(len(g) == 1 for g in groups.values())


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_recall_of_pairs_near_the_threshold(spark):
    rng, rows, wanted, shared = np.random.default_rng(8), [], set(), [f"s{i}" for i in range(30)]
    for i in range(3_000):
        base = [f"w{x}" for x in rng.integers(0, 50_000, rng.integers(60, 250))]
        if i % 3 == 0:  # a passage that a third of the texts have
            base[10:40] = shared
        other = list(base)
        places = rng.choice(len(base), max(1, round(len(base) * rng.uniform(0.018, 0.026))), replace=False)
        for p in places:
            other[p] = f"x{i}"
        one, two = " ".join(base), " ".join(other)
        x, y = shingle_set(one), shingle_set(two)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(2 * i, one, "a"), (2 * i + 1, two, "a")]
            wanted.add((2 * i, 2 * i + 1))
    links = {r.doc_id: r.n_links for r in neardup.jaccard_classes(docs(spark, *rows)).collect()}
    found = sum(links[a] == links[b] == 1 for a, b in wanted)
    print(f"recall of {len(wanted)} pairs at 0.80 to 0.85: {found / len(wanted):.5f}")
    assert len(wanted) > 800 and found >= 0.999 * len(wanted) and sum(links.values()) == 2 * found


def test_a_passage_that_all_texts_share_costs_in_proportion(spark):
    rng, times = np.random.default_rng(9), {}
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [(i, shared + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 70)), "a") for i in range(20_000)]
    frame = docs(spark, *texts).repartition(8).persist()
    for n in (20_000, 5_000, 20_000):
        began = time.time()
        sigs = neardup.signatures(frame.where(f"doc_id < {n}"), 5, 120).selectExpr("doc_id AS node", "sig")
        met = neardup.meetings(sigs, 0.8, 20, 6, 4, 0.9999)
        pairs = sum(r.n * r.n for r in met.groupBy("at").agg(F.count("*").alias("n")).collect())
        times[n] = (pairs, time.time() - began)
    print(times)
    assert times[20_000][0] <= 64 * 20 * 20_000 and times[20_000][1] < 4 * times[5_000][1] + 20
    assert neardup.jaccard_classes(frame).where("n_links > 0").count() == 0
    frame.unpersist()


def test_one_row_of_each_class_stays_under_shared_and_null_ids(spark):
    def text(k, swap=None):
        return " ".join("swapped" if i == swap else f"k{k}w{i}" for i in range(80))

    rows = [(3, text(0), "a"), (None, text(0, 40), "a"), (None, text(1), "a"), (None, text(2), "a"), (None, text(2, 40), "a"), (5, text(3), "a"), (5, text(0, 20), "a"), (5, text(4), "a"), (6, text(4, 40), "a"), (None, text(5), "a"), (None, text(5).upper(), "a"), (7, text(6), "x"), (7, text(6), "x")]
    kept = neardup.keep_first_of_class(docs(spark, *rows)).collect()
    topics = sorted(((r.text.lower()[: r.text.index("w" if r.text.islower() else "W")], r.doc_id) for r in kept), key=str)
    assert topics == [("k0", 3), ("k1", None), ("k2", None), ("k3", 5), ("k4", 5), ("k5", None), ("k6", 7)]


def test_texts_under_one_id_meet_only_their_own_family_member(spark, monkeypatch):
    rows = [(i, " ".join("swapped" if w == k else f"{i}{w}" for w in range(80)), "a") for i in (None, 5) for k in range(20 if i else 10)]
    met, blocked = [], neardup.blocked

    def counted(df, group, *rest):
        if group == "root":
            met.append(df.count())
        return blocked(df, group, *rest)

    monkeypatch.setattr(neardup, "blocked", counted)
    for limit in (neardup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", limit)
        assert joined(docs(spark, *rows)) == jaccard_by_force([r[:2] for r in rows])
    assert met == [30, 30]


def test_stop_depth_and_components(spark):
    d = neardup.stop_depth(0.8, 20, 6, 0.9999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 20
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


# 2


def test_bpe_matches_the_library(real, awkward, empty):
    library = Tokenizer.from_file(VOCABULARY)
    for df in (real, awkward):
        wanted = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            wanted.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trip(df, VOCABULARY).collect()), key=str) == sorted(wanted, key=str)
    assert bpe.round_trip(empty, VOCABULARY).count() == 0


def test_transducer_and_merges():
    v = bpe.Vocabulary(VOCABULARY)
    words = {w.encode(): v.merge(w.encode()) for w in " the the thing things king kings sing é 🎉".split()} | {b" the": [1, 2]}
    t = bpe.Transducer(bpe.Transducer.compile(words))
    assert all(t.get(w) == ids for w, ids in words.items()) and t.get(b"th") is None and t.get(b"zzz") is None
    assert bpe.Transducer(bpe.Transducer.compile({})).get(b"a") is None
    for w in ("hello", " antidisestablishmentarianism" * 5, "zzzzzzzz" * 40, "é🎉"):
        assert v.merge_by_rank(w.encode()) == v.merge(w.encode())
    e = bpe.Encoder(VOCABULARY, bpe.Transducer.compile(words))
    library = Tokenizer.from_file(VOCABULARY)
    for text in ("a  b \n \n c\n\n  d ", "a\n b", "\n \n", " x", "it's 12'3 we'll !!'s", "a \xa0 b", "\x1c \x1c a", "ab " * 3):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lexicon_counts_words_over_all_tasks(spark, monkeypatch):
    for held in (bpe.CHUNKS_HELD, 1):
        monkeypatch.setattr(bpe, "CHUNKS_HELD", held)
        for tasks in (4, 1):
            df = spark.range(0, 4, 1, tasks).selectExpr("repeat(concat('zebra q', char(97 + id), ' '), 7) AS text")
            assert bpe.frequent_words(df, 10) == [" zebra"]


# 3


def test_toxicity_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"  # some 350 toxic labels to learn from
    d, found = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.score_documents(d, found).join(found, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.985 * len(rows)
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.predicted)


def test_toxicity_learns_words_stems_and_exceptions_but_no_copies(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3))
    prose = lambda n: [word() for _ in range(n)]
    texts = []
    for i in range(80):  # a word, a stem with several endings, a short word
        texts.append((1, prose(30) + ["blorgish", "zwick" + word(), "ugx"] + prose(20)))
    copied = prose(60) + ["quaxel"]
    for i in range(120):
        near = list(copied)
        near[draw.randrange(50)] = word()
        texts.append((1, near))
    texts += [(0, prose(50)) for _ in range(400)] + [(0, prose(20) + ["blorgish", "fish"] + prose(20)) for _ in range(12)]
    rows = [(i, " ".join(w), label) for i, (label, w) in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert set(lexicon.weights) == {" blorgish", " zwick", " ugx "} and lexicon.exceptions == {" blorgish fish ": " blorgish"}
    sample = toxicity.independent(toxicity.labelled_sample(docs, labels, 20_000)).collect()
    toxic, clean = [r.text for r in sample if r.toxic], [r.text for r in sample if not r.toxic]
    assert sum("quaxel" in t for t in toxic) <= 4 and sum("blorgish" in t for t in toxic) >= 50
    for entry, weight in lexicon.weights.items():
        n, m = (sum(entry in toxicity.folded(t) for t in part) for part in (toxic, clean))
        assert weight == pytest.approx(math.log((n + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (m + 0.5)))
    judged = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    assert all(judged[i] == 1 for i in range(80)) and all(judged[i] == 0 for i in range(200, len(rows)))


def test_toxicity_entries():
    found = {" idio": 50, " idiot": 50, " idiot ": 45, " path": 60, " pathe": 50, " hell": 40, " hell ": 40, " hello": 2, " few ": 8}
    held = {" path": 3, " hell": 300, " hell ": 1}
    got = toxicity.entries(found, held, 100, 900, -math.log(1e-9), 5.0, 4)
    assert set(got) == {" idiot", " hell ", " path"}  # as far as evidence goes on; the whole word where its beginning is common; none by chance
    assert toxicity.entries({" path": 60, " pathe": 58}, {" path": 3}, 100, 900, -math.log(1e-9), 5.0, 4).keys() == {" pathe"}


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idio": 9.0, " clown": 9.0}, {" clown fish ": " clown"})
    a = lexicon.automaton()
    assert toxicity.measures("what an 1d10t", a)[:2] == (9.0, 1)
    assert toxicity.measures("an іdіоt and ID​IOT", a)[:2] == (18.0, 2)
    assert toxicity.measures("the clown fish swims", a)[:2] == (0.0, 0)
    assert toxicity.measures("the clown", a)[:2] == (9.0, 1)


def test_toxicity_on_awkward_rows(spark, awkward, empty, labels):
    assert toxicity.score_documents(awkward, labels).count() == awkward.count()
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(awkward, labels.limit(0)).count() == awkward.count()


def test_toxicity_scores_by_brute_force(spark, real, awkward):
    lexicon = toxicity.Lexicon({" the": 1.5, " clown ": 4.0, " same": 2.0}, {" clown fish ": " clown ", " same text ": " same"}, (-3.0, 2.5, 1.25))
    more = docs(spark, (1, "clown, fish", "a"), (2, "a clown  fish; clown", "a"), (3, "The  7he cl0wn", "a"))
    for df in (real, awkward, more):
        wanted = []
        for r in df.collect():
            words = toxicity.folded(r.text or "").split()
            text = " " + " ".join(words) + " "
            count = lambda x: sum(text.startswith(x, i) for i in range(len(text)))
            total = max(0.0, sum(w * count(e) for e, w in lexicon.weights.items()) - sum(lexicon.weights[e] * count(p) for p, e in lexicon.exceptions.items()))
            p = 1 / (1 + math.exp(-(-3.0 + 2.5 * total / math.sqrt(len(words) + 1) + 1.25 * math.log1p(total))))
            wanted.append((r.doc_id, pytest.approx(p, rel=1e-9), int(p >= 0.5), len(words)))
        got = [(r.doc_id, r.score, r.predicted, r.words) for r in toxicity.score(df, lexicon).collect()]
        assert got == wanted
    assert [round(toxicity.measures(t, lexicon.automaton())[0], 6) for t in ("clown, fish", "clown  fish", "clown")] == [0.0, 0.0, 4.0]


# 4


def test_html_on_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", "\0", article)).split("\0")
        assert got[r.page_id] == " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def test_html_elements_and_differencing(spark):
    frame = "<div>Home of news</div><p>{}</p><div>All rights reserved</div>"
    rows = [
        (1, "http://a.org/x/1", frame.format("First &amp; own")),
        (2, "http://a.org/x/2", frame.format("Second  \n own")),
        (3, "http://b.org/1", "<main><h1>T</h1><p>one<br>two</p><div class='comments'>c</div><nav>n</nav></main><p>out</p><script>if(a<b){}</script>"),
        (4, "http://b.org/1", None),
        (5, None, ""),
        (6, "http://c.org/1", "<p>copy</p><p>of all</p>"),
        (7, "http://c.org/1", "<p>copy</p><p>of all</p>"),
        (8, "http://d.org/1", "<p>unclosed <b>bold &lt;i&gt; <!-- x --> <div id=cookie-notice>no</div> end"),
    ]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, row int")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {1: "First & own", 2: "Second own", 3: "T one two", 4: "", 5: "", 6: "copy of all", 7: "copy of all", 8: "unclosed bold <i> end"}
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("named", ["site-notice", "promo-box", "share-buttons", "related-posts-list", "signup-form"])
def test_html_named_blocks_inside_main_elements_go(named):
    for main in ("main", "article"):
        page = f"<{main}><p>One.</p><div class='x {named}'><p>Buy it</p><div>now</div></div><p class='{named}'>Two.</p></{main}>"
        assert " ".join(html._main(html.lines_of(page), set())) == "One. Two."


def test_differencing_decides_on_pages_without_main_elements(spark):
    """The same pages with and without a neighbour: frames go only where two pages share them."""
    page = "<div>Home of news</div><p>Words of page {0} alone</p><div>All rights reserved</div>"
    many = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(i)) for i in range(5)], "page_id long, url string, html string")
    lone = spark.createDataFrame([(i, f"http://{i}.org/", page.format(i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(many).collect()} == {f"Words of page {i} alone" for i in range(5)}
    assert {r.text for r in html.extract(lone).collect()} == {f"Home of news Words of page {i} alone All rights reserved" for i in range(5)}


def test_html_comments_teasers_and_headings():
    text = lambda page: " ".join(html._main(html.lines_of(page), set()))
    assert text("<article><header><h1>Title</h1></header><p>Body</p><article class='reader comment'><p>me too</p></article></article>") == "Title Body"
    assert text("<article class='comment'>first!</article><article>The text</article>") == "The text"
    assert text("<article>Teaser</article><div class=content><p>The real text is longer</p></div>") == "The real text is longer"
    assert text("<article><div class=related-work>A</div><div class='search'>B</div><div class='related-posts'>C</div><div class='ad'>D</div></article>") == "A B"
    assert text("<header>Site</header><main><p>a < b &amp; c<br>d</p><form>f</form></main><div class=search>s</div>") == "a < b & c d"
    assert text("<main>x <a title='1 > 0'>y</a> <!-- <p>no</p> --> z</main><![CDATA[ q ]]>") == "x y z"


@pytest.mark.parametrize("piece", ['<a "', '<a x="', "<p ", "<", "<!-- ", "<nav><p>", "</p", '<a x=">', "<script ", "<div class='", "&amp", "<div class=ad><div>x</p>"])
def test_html_time_grows_with_length(piece):
    page = "<p>start</p>" + piece * (2_000_000 // len(piece))
    began = time.time()
    assert html.lines_of(page)[0] == ("start", html.OPEN)
    assert time.time() - began < 20


def test_html_long_unclosed_quotes_and_many_lines():
    began = time.time()
    html.lines_of('<a "' * 1_250_000)
    assert time.time() - began < 5
    rng = np.random.default_rng(0)
    a = rng.permutation(50_000)
    began = time.time()
    assert html.shared_lines(a, np.roll(a, 7)).sum() == 49_993
    html.shared_lines(np.concatenate([[-1], np.zeros(20_000, int), [-2]]), np.concatenate([[-3], np.zeros(25_000, int)]))
    assert time.time() - began < 30


def test_differencing_acts_on_pages_with_articles(spark):
    page = "<div>Home of news</div><p>All you need</p><nav>m{0}</nav><article><p>Own words of page {0}</p><p>quoted</p></article><div>All rights reserved</div>"
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(i)) for i in range(9)] * 2, "page_id long, url string, html string")
    rows = html.extract(pages).collect()
    assert len(rows) == 18 and {r.lines_shared for r in rows} >= {3} and all(r.text == f"Own words of page {r.page_id} quoted" for r in rows)
    given = html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert given.where("lines_shared > 0").count() > 0


def test_longest_common_subsequence():
    def force(a, b):
        if not a or not b:
            return 0
        return force(a[1:], b[1:]) + 1 if a[0] == b[0] else max(force(a[1:], b), force(a, b[1:]))

    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        hit = html.shared_lines(a, b)
        rest = iter(b.tolist())
        assert hit.sum() == force(a.tolist(), b.tolist()) and all(v in rest for v in a[hit].tolist())
    for n in (200, 500):  # over several kept rows
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        table = np.zeros((n + 1, n + 1), int)
        for i in range(n):
            for j in range(n):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        hit = html.shared_lines(a, b)
        rest = iter(b.tolist())
        assert hit.sum() == table[n, n] and all(v in rest for v in a[hit].tolist())


# 5


def dedup_by_force(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return least, groups


def test_exact_dedup(spark, duck, real, awkward, empty):
    same_rows(dedup.exact_groups(real), duck.execute(queries.DEDUP_SQL))
    rows = dedup.exact_groups(awkward).collect()
    least, groups = dedup_by_force([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted((r.keep_id, r.group_size) for r in rows if r.kept and r.keep_id is not None) == sorted((least[k], len(v)) for k, v in groups.items() if least[k] is not None)
    assert sum(r.kept for r in rows) == len(groups)
    assert dedup.exact_groups(empty).count() == dedup.drop_copies(empty).count() == 0
    kept = dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)


def test_several_repeat_filters_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SEGMENT", 64), monkeypatch.setattr(dedup, "HOT_ROWS", 3)
    rows = docs(spark, *[(i, f"t{min(i % 150, 140)}", "a") for i in range(300)])
    for cells in (1_024, 1 << 20):
        got = dedup.exact_groups(rows, max_cells=cells).collect()
        assert len(got) == 300 and all(r.group_size == (20 if r.doc_id % 150 >= 140 else 2) for r in got) and sum(r.kept for r in got) == 141
        assert dedup.drop_copies(rows, max_cells=cells).count() == 141
    many = spark.range(4_000).selectExpr("xxhash64(id) AS h").persist()
    for cells in (4_096, 8_192):  # several filters: few unique rows are held back, whatever the number of rows
        assert dedup.marked(many, many, cells).where("again").count() < 0.08 * 4_000


# 6


def test_url_rules(spark, duck):
    same_rows(urls.judge(spark.read.parquet(f"{SF}/pages.parquet")), duck.execute(urls.judge_sql()))
    cases = {
        "https://EN.example.ORG/en/12?x": ("en.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://a.com/de/x#y": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com/fr/?u=http://b.org/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://cheap-pills.example.net/": ("cheap-pills.example.net", "/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(cases)], "page_id long, url string, host string, path string")
    got = urls.judge(rows).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(cases.values())
    assert urls.judge(rows.limit(0)).count() == 0
    urls.check_rules()


def test_many_url_rules_match_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(60)]
    word = lambda: names[min(59, int(rng.geometric(0.08)))]
    hosts = {(f"{word()}.{word()}" if rng.random() < 0.5 else word(), "/" + "/".join(word() for _ in range(rng.integers(0, 3)))[: rng.integers(0, 7)]): str(rng.choice(["allow", "block"])) for _ in range(3_000)}
    host_rules = [urls.HostRule(h, p, v) for (h, p), v in hosts.items()]
    patterns = [urls.PatternRule(f"p{i:04}", (a, b), rf"(^|[^a-z0-9]){a}[^a-z0-9](.*[^a-z0-9])?{b}([^a-z0-9]|$)") for i, (a, b) in enumerate(zip([word() for _ in range(400)], [word() for _ in range(400)], strict=True))]
    given = [f"http://{word()}.{word()}.{word()}/{word()}/{word()}?{word()}" for _ in range(300)] + ["http://w1." + "v." * 5_000 + "w3/" + "v/" * 50_000, "HTTP://W1.W2/w1"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.pattern) for r in urls.judge(pages, host_rules, patterns).collect()}
    for i, url in enumerate(given):
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups()
        host = host.lower()
        fits = [(len(r.host + r.path), len(r.host), r.verdict, r.host + r.path) for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, default=(0, 0, None, None))
        pattern = min((r.name for r in patterns if re.search(r.pattern, url.lower())), default=None)
        assert got[i] == (best[3], best[2] or ("block" if pattern else "allow"), pattern)
    assert any(v[2] for v in got.values()) and any(v[0] for v in got.values())
    with pytest.raises(ValueError):
        urls.judge(pages, host_rules, [urls.PatternRule("x", (), "x")])


def test_time_of_url_rules_does_not_follow_their_number(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    times = {}
    for n in (10, 10, 100_000):
        host_rules = spark.range(n).selectExpr("concat('h', id % 5000, '.example.net') AS host", "concat('/d', id div 5000, '/') AS path", "'block' AS verdict")
        patterns = spark.range(n).selectExpr("concat('p', id) AS name", "array(concat('bad', id), 'com') AS tokens", "concat('[./-]bad', id, '[./-]') AS pattern")
        began = time.time()
        assert urls.judge(pages, host_rules, patterns).where("rule is null and pattern is null").count() == pages.count()
        times[n] = time.time() - began
    print(times)
    assert times[100_000] < 2 * times[10] + 5
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert sorted(urls.judge(pages).collect()) == sorted(urls.judge(pages).collect())
    plan = urls.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# 7


def neighbours_by_force(ids, v, every=50, k=5):
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(ids % every == 0).tolist():
        score = (x * x[at]).sum(1)
        order = np.lexsort((ids, -score))
        out[int(ids[at])] = [int(ids[j]) for j in order if j != at][:k]
    return out


def recall(found, wanted):
    got = collections.defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    return sum(len(got[q] & set(w)) for q, w in wanted.items()) / sum(map(len, wanted.values()))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[101:140] = v[100]  # equal vectors
    v[200:400:50] = v[150]  # of queries
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] * 16, 0), (1, v[1].tolist(), 0), (1200, [1.0] * 15, 0), (2, [9e9] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v[2] = min(tuple(v[2]), (9e9,) * 16)
    wanted = neighbours_by_force(np.arange(600), v)
    for parameters in ({}, {"block_rows": 200, "query_rows": 4, "rerank": 600}):
        got = collections.defaultdict(list)
        for r in ann.search(df, **parameters).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(wanted) and [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
        assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) and len(x) == 5 for x in got.values())
        assert [i for i, _ in got[150]][:4] == [200, 250, 300, 350] and [i for i, _ in got[250]][:4] == [150, 200, 300, 350]
    assert {q: [i for i, _ in x] for q, x in got.items()} == wanted  # every entry is scored exactly
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id < 3")).count() == 2


def test_recall_of_neighbours_by_codes(spark):
    """On the given table, a rerank list of 2 % of the rows; codes that say nothing find next to nothing in such a list."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    given = df.dropna().toPandas()
    given = given[[bool(np.isfinite(e).all() and np.any(e)) for e in given["embedding"]]]
    wanted = neighbours_by_force(given["vec_id"].to_numpy(), np.stack(given["embedding"].to_numpy()))
    at = {n: recall(ann.search(df, rerank=n).collect(), wanted) for n in (40, 128)}
    print("recall at 5 by rerank:", at)
    assert at[40] >= 0.97 and at[128] >= 0.99
    assert recall(ann.search(df, rerank=40, books=1, words=2).collect(), wanted) < 0.7


def test_neighbours_that_codes_do_not_tell_apart(spark, tmp_path):
    """Rows much closer to one another than codes can tell, beside rows far apart, and rows of one direction but for small parts: the
    query finds all that are nearest, also where the lists of the codes' best miss them."""
    rng = np.random.default_rng(11)
    crowd = rng.normal(size=64) + 1e-3 * rng.normal(size=(1_500, 64))
    v = np.concatenate([rng.normal(size=(1_500, 64)), crowd, 5 + 0.02 * rng.normal(size=(1_000, 64))]).astype(np.float32)
    ids = rng.permutation(len(v))
    rows = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = neighbours_by_force(ids, v)
    assert recall(ann.search(rows, rerank=8).collect(), wanted) < 0.9
    got = collections.defaultdict(list)
    for r in queries.op7_nearest_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == wanted
    for parameters in ({"rerank": 8}, {"rerank": 8, "block_rows": 500, "query_rows": 20}):
        assert recall(ann.search(rows, whole=True, **parameters).collect(), wanted) == 1
    print("recall without the rows that bounds leave open:", recall(ann.search(rows).collect(), wanted))


# 8


def test_shards(spark, real, awkward, empty):
    for df in (real, awkward):
        rows, n = sharding.interleave(df).collect(), df.count()
        shards = collections.defaultdict(list)
        for r in rows:
            shards[r.shard].append(r)
        assert len(rows) == n and sum(map(len, shards.values())) == n
        counts = [len(shards[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    sizes = collections.Counter(r.source for r in real.collect())
    shards = collections.Counter((r.source, r.shard) for r in sharding.interleave(real).collect())
    assert all(abs(shards[s, k] - n / 8) <= 2 for s, n in sizes.items() for k in range(8))
    wanted = {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in awkward.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in sharding.interleave(awkward).collect()} == wanted
    assert sharding.interleave(empty).count() == 0
    assert sorted(sharding.interleave(real, bucket_rows=50).collect()) == sorted(sharding.interleave(real, bucket_rows=100).collect())


def shards_by_force(rows, n_shards=8, seed=17):
    md5 = lambda *x: hashlib.md5("".join(x).encode()).hexdigest()
    unit = lambda d: int(d[:13], 16) / 2**52
    by_source = collections.defaultdict(list)
    for i, text, source in rows:
        data = (text or "").encode()
        crc, size = zlib.crc32(data), len(data) + 1
        by_source["\0" if source is None else source].append((int(md5(f"{seed}/{crc}/{size}")[:3], 16), md5(f"{seed}:{'' if i is None else i}:{crc}"), i, size))
    order = []
    for s, v in by_source.items():
        order += [((rank + unit(md5(f"{seed}/{s}"))) / len(v), s, rank, i) for rank, (_, _, i, _) in enumerate(sorted(v, key=lambda x: x[:2]))]
    out, n, seen = {}, len(rows), collections.Counter()
    for position, (_, _, _, i) in enumerate(sorted(order, key=lambda x: x[:3])):
        shard = position * n_shards // n
        out[i] = (shard, seen[shard])
        seen[shard] += 1
    return out


def test_order_of_shards_by_brute_force_and_groups(spark, real):
    df = real.dropDuplicates(["doc_id"])
    wanted = shards_by_force([(r.doc_id, r.text, r.source) for r in df.collect()])
    for size in (10_000, 3):
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, bucket_rows=size).collect()} == wanted
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    groups = collections.defaultdict(set)
    for r in sharding.interleave(rows).collect():
        groups[r.text_crc32, r.size].add((r.doc_id, r.shard))
    shared = [len({k for _, k in g}) == 1 for g in groups.values() if len(g) > 1]
    print(f"{sum(shared)} of {len(shared)} groups of equal texts lie in one shard")
    assert sum(shared) >= 0.7 * len(shared)


# 9


def lm_by_force(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    train = [(i, tok(t)) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    one = collections.Counter(w for _, ws in train for w in ws)
    two = collections.Counter(p for _, ws in train for p in zip([None, *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in rows:
        ws = tok(t)
        out[i] = (len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), [(two[b, w], one[b], one[w]) for b, w in zip([None, *ws], ws, strict=False)])
    return out, n, v


def test_lm(spark, real, awkward, empty):
    for df in (real, awkward.dropDuplicates(["doc_id"])):
        wanted, n, v = lm_by_force([(r.doc_id, r.text) for r in df.collect()])
        for size in (1_000, 10**6):
            for r in lm.score(df, size).collect():
                tokens, known, total, base, events = wanted[r.doc_id]
                assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
                assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
    rows = lm.score(real).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score(empty).count() == 0 and lm.score(awkward).count() == awkward.count()


def test_lm_mixture_is_a_distribution_and_scores_follow_it(monkeypatch, real):
    mixture = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1))
    mixture[0] = 0, 0.6, 0.4
    monkeypatch.setattr(lm, "weights", lambda *a, **k: mixture)
    wanted, n, v = lm_by_force([(r.doc_id, r.text) for r in real.collect()])
    for r in lm.score(real).collect():
        score = 0.0
        for two, before, one in wanted[r.doc_id][4]:
            m = mixture[int(lm._bucket(np.array([float(before)]))[0])]
            score += math.log10(m[0] * two / max(before, 1) + m[1] * one / n + m[2] / (v + 1))
        assert r.score == pytest.approx(score, rel=1e-9)


def test_lm_of_longer_ngrams_follows_its_mixtures(monkeypatch, real, awkward):
    lower, upper = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1)), np.tile([0.4, 0.6, 0.0], (lm.BUCKETS, 1))
    lower[0], upper[0] = (0, 0.6, 0.4), (0, 1, 0)
    monkeypatch.setattr(lm, "weights", lambda events, types: upper if types is None else lower)
    for df in (real, awkward.dropDuplicates(["doc_id"])):
        texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in df.collect()}
        train = [ws for i, ws in texts.items() if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
        grams = [collections.Counter(tuple([None] * (k - 1) + ws)[j : j + k] for ws in train for j in range(len(ws))) for k in (1, 2, 3, 4)]
        contexts = [collections.Counter(tuple([None] * (k - 1) + ws)[j : j + k - 1] for ws in train for j in range(len(ws))) for k in (1, 2, 3, 4)]
        n, v = sum(grams[0].values()), len(grams[0])
        for r in lm.score(df, 1_000, order=4).collect():
            padded, score = [None, None, None, *texts[r.doc_id]], 0.0
            for j in range(3, len(padded)):
                p = grams[0][(padded[j],)] / n
                for k in (2, 3, 4):
                    h, c = contexts[k - 1][tuple(padded[j - k + 1 : j])], grams[k - 1][tuple(padded[j - k + 1 : j + 1])]
                    m = (lower if k == 2 else upper)[int(lm._bucket(np.array([float(h)]))[0])]
                    p = m[0] * c / max(h, 1) + m[1] * p + (m[2] / (v + 1) if k == 2 else 0)
                score += math.log10(p)
            assert r.score == pytest.approx(score, rel=1e-9)


def test_lm_trigrams_learn_weights(real):
    scored = {order: {r.doc_id: r for r in lm.score(real, 20_000, order=order).collect()} for order in (2, 3)}
    assert all(scored[3][i].base_score == r.base_score and scored[3][i].n_known == r.n_known for i, r in scored[2].items())
    assert sum(r.score for r in scored[3].values() if r.held_out) > sum(r.base_score for r in scored[3].values() if r.held_out)
    with pytest.raises(ValueError, match="order"):
        lm.score(real, order=1)


def test_mixture_weights_learn():
    events = np.array([[3, 1, 100, 1000], [3, 0, 40, 10], [5, 0, 40, 1000]])
    w = lm.weights(events, 1000)
    assert np.allclose(w.sum(1), 1) and (w[1:] > 0).all() and w[3, 0] > 0.9 > w[5, 0]


# 10


def check_packing(df, capacity=1024):
    library, wanted = Tokenizer.from_file(VOCABULARY), collections.Counter()
    rows = packing.pack(df, VOCABULARY, capacity).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = 0
    for r in df.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first, start, k = (len(ids) - 1) % capacity + 1, 0, 0
        while start < len(ids):
            stop = first if k == 0 else start + capacity
            wanted[r.doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, k = stop, k + 1
    assert wanted == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_packing(real, awkward, empty):
    used, least = check_packing(real)
    assert used <= 1.1 * least
    check_packing(awkward)
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_sum_of_squares_by_force():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 13, 200), 12
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def cost(change):
            c = collections.Counter(g for g in {**gaps, **change}.values() if 0 < g < capacity)
            return sum(n * n for n in c.values())

        options = [cost({k: g - s}) for k, g in gaps.items() if g >= s] + [cost({-1: capacity - s})]
        assert o == capacity - gaps.get(b, capacity)
        assert cost({b: gaps.get(b, capacity) - s}) == min(options)
        gaps[b] = gaps.get(b, capacity) - s
        assert gaps[b] >= 0


def test_packing_groups_of_equal_rows(spark):
    """A third of all rows without id and text: groups stay even."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("word "), "id")).alias("text"))
    packed = packing.pack(rows, VOCABULARY, group_rows=500)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 36)).count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 12 and max(sizes) <= 2 * 500


# pipeline


def test_pipeline_stages(spark, real, labels):
    now = real
    toxic = {r.doc_id for r in toxicity.score_documents(real, labels).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()} if name != "packing" else None
        after = stage(spark, now, SF)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in now.collect()}
            break
        assert after.columns == real.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            assert kept == set(before) - toxic
        elif name == "exact_dedup":
            assert kept == set(dedup_by_force(list(before.items()))[0].values())
        else:
            assert kept == {c for _, c, _ in jaccard_by_force(list(before.items()))}
        now = spark.createDataFrame(after.collect(), real.schema)


def test_pipeline_on_awkward_rows(spark, awkward, empty):
    for now in (awkward, empty, awkward.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
