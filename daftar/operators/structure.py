"""Lines of statutes to articles with their hierarchy (L1-L22), over one exchange on doc_id.

A line is marked by patterns in the JVM; what depends on its place (enacting articles, titles of bare headers, lists that an article
opens, the hierarchy) follows from one pass with a small state, which also starts in the middle of a document. Two choices of ours: title lines of a bare header belong to no body, and a glued header's first
text is cut from the line as it stands.
"""

from __future__ import annotations

import json
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import arabic as A

from .laws import FEMININE_NUMBERS, ORDINAL_NUMBERS, alternation, lookup

# Level keywords, and the patterns of headers over normalised lines (digits in ASCII).
KEYWORDS = {"division": "القسم", "book": "الكتاب", "part": "الباب", "chapter": "الفصل"}
ORD, FEM, DASH = f"({alternation(ORDINAL_NUMBERS)})", f"({alternation(FEMININE_NUMBERS)})", "[-–—]"
BARE = {k: f"^{w}\\s+{ORD}$" for k, w in KEYWORDS.items()}
INLINE = {k: f"^{KEYWORDS[k]}\\s+{ORD}\\s*{DASH}\\s*(.+)$" for k in ("division", "part")}
BANNER = f"^{KEYWORDS['book']}\\s+{ORD}\\s*{DASH}\\s*(?:{KEYWORDS['part']}\\s+{ORD}\\s*{DASH}\\s*)?(.+)$"
CHAPTER = f"^{KEYWORDS['chapter']}\\s+{ORD}\\s*(?:{DASH}\\s*)?(.*)$"
PREAMBLE = f"^باب\\s*تمهيدي\\s*(?:{DASH}\\s*(.+))?$"
ISSUANCE = f"^[()]*\\s*المادة\\s+{FEM}\\s*[()]*$"
ARTICLE = r"^(?:ال)?مادة\s*[()]*\s*([0-9]+)\s*[()]*\s*$"
GLUED = rf"^(?:ال)?ماد[ةه]\s*(?:\(([0-9]+)\)\s*{DASH}?|{DASH})\s*([0-9]+)(.*)$"
RAW_GLUED = rf"^[^\s()\-–—]+\s*(?:\(([0-9٠-٩]+)\)\s*{DASH}?|{DASH})\s*[0-9٠-٩]+(.*)$"
RANGE = r"^المواد\s+من\s*([0-9]+)\s*الي\s*([0-9]+)\s*ملغاة"
SECTION = r"^(?:[-.]\s*([0-9]+)|([0-9]+)\s*[-.])\s*([^0-9\s].*)$"
LABEL = r"^([^:：]{1,40})\s*[:：]\s*$"
FORWARD = ("الاتية", "التالية")
STRUCTURAL = ("division", "book", "banner", "part", "preamble", "chapter")
OPENING, CLOSING = ("article", "issuance"), ("section", "subsection", "label", "range")


def lines(pages: DataFrame) -> DataFrame:
    """L1 and L2: doc_id, page_number, pos, line (not blank), norm, na, furniture, following (the next line of the page)."""
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("_i", "raw"))
    rows = rows.select("doc_id", "page_number", (F.shiftleft(F.col("page_number").cast("long"), 31) + F.col("_i")).alias("pos"), A.strip(F.col("raw")).alias("line")).where("line <> ''")
    return normalised(rows)


def normalised(rows: DataFrame, pages_per_block: int | None = None, dealt: bool = False) -> DataFrame:
    """The derived columns for rows of doc_id, page_number, pos, line. What follows a line is looked up within its page; the one exchange
    is on doc_id, or, with pages_per_block, on blocks of so many pages, so that a document of any length lies in many tasks. Their work is
    patterns over few bytes, so the number of tasks is the session's and not fitted to bytes. dealt: the rows come from such an exchange on
    doc_id, and none is made."""
    keys = ["doc_id"] + ["block"] * bool(pages_per_block)
    if pages_per_block:
        rows = rows.withColumn("block", F.floor(F.col("page_number") / pages_per_block))
    norm = A.normalize_for_match(F.col("line"))
    if not dealt:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = rows.withColumn("norm", norm).withColumn("na", F.when(F.col("norm").rlike(f"[{A.ARABIC_DIGITS[0]}-{A.ARABIC_DIGITS[-1]}]"), A.arabic_to_ascii(F.col("norm"))).otherwise(F.col("norm")))
    furniture = (F.col("norm").contains("الجريدة الرسمية") & F.col("norm").contains("العدد")) | F.col("line").rlike(f"^[{A.ASCII_DIGITS}{A.ARABIC_DIGITS}]+$")
    page = W.partitionBy(*keys, "page_number").orderBy("pos")
    return rows.withColumn("furniture", furniture).withColumn("following", F.lead("line").over(page)).withColumn("following_na", F.lead("na").over(page))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def shapes() -> Column:
    """L3 to L11 as far as a line and its follower tell: the first kind that fits. A test of how a line begins or ends stands before each
    pattern, as few lines are of any kind."""
    norm, na, line, next_na = F.col("norm"), F.col("na"), F.col("line"), F.coalesce("following_na", F.lit(""))
    begins = lambda *words: reduce(lambda a, b: a | b, [norm.startswith(w) for w in words])
    of = lambda level: norm.startswith(KEYWORDS[level])
    numbered = F.substring(line, 1, 1).isin("-", ".", *A.ASCII_DIGITS, *A.ARABIC_DIGITS)
    article = na.startswith("ال") | na.startswith("ماد")
    no_paren = ~line.rlike("^[()]")
    colon = line.endswith(":") | line.endswith("：")
    title = F.regexp_extract(line, LABEL, 1)
    last_word = F.regexp_extract(A.normalize_for_match(title), r"(\S+)\s*$", 1)
    return (
        F.when(of("division") & (norm.rlike(INLINE["division"]) | norm.rlike(BARE["division"])), "division")
        .when(of("book") & norm.rlike(BANNER), F.when(F.regexp_extract(norm, BANNER, 2) != "", "banner").otherwise("book"))
        .when(of("book") & norm.rlike(BARE["book"]), "book")
        .when(of("part") & (norm.rlike(INLINE["part"]) | norm.rlike(BARE["part"])), "part")
        .when(begins("باب") & norm.rlike(PREAMBLE), "preamble")
        .when(of("chapter") & norm.rlike(CHAPTER), "chapter")
        .when(begins("ال", "(", ")", " ") & norm.rlike(ISSUANCE), "ordinal")
        .when(article & na.rlike(ARTICLE), "article")
        .when(article & na.rlike(GLUED), "glued")
        .when(begins("المواد") & na.rlike(RANGE), "range")
        .when(numbered & A.arabic_to_ascii(line).rlike(SECTION) & (F.length(line) < 80) & no_paren, "section")
        .when(colon & line.rlike(LABEL) & no_paren & (next_na.rlike(ARTICLE) | next_na.rlike(GLUED)) & ~last_word.isin(*FORWARD) & (_words(title) <= 6), "subsection")
        .when(next_na.startswith("المواد") & ~colon & (F.length(line) < 60) & (_words(line) <= 6) & next_na.rlike(RANGE), "label")
        .otherwise("body")
    )


def faithful_tail(line: Column, dashes: Column, words: Column) -> Column:
    """What follows the line's nth dash, else what follows its first words."""
    parts = F.split(line, DASH)
    after_dash = F.array_join(F.filter(parts, lambda _, i: i >= dashes), "-")
    after_words = F.array_join(F.filter(F.split(line, r"\s+"), lambda _, i: i >= words), " ")
    return A.strip(F.when(F.size(parts) > dashes, after_dash).when(words > 0, after_words).otherwise(""))


def marked(rows: DataFrame) -> DataFrame:
    """What a line says by itself, whatever stands before it (L3 to L13, L17): shape, number, number2, title, seed, bare (its title is on the
    lines below), ends (its text ends a sentence), opens (and announces a list that follows)."""
    rows = rows.where("not furniture").withColumn("shape", shapes())
    norm, na, line, shape = F.col("norm"), F.col("na"), F.col("line"), F.col("shape")
    pick = lambda pattern, group, source=norm: F.regexp_extract(source, pattern, group)
    number_of = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    bare = norm.rlike("|".join(BARE.values())) | ((shape == "preamble") & (pick(PREAMBLE, 1) == "")) | ((shape == "chapter") & (F.trim(pick(CHAPTER, 2)) == ""))
    headers = {"division": ("division",), "book": ("book", "banner"), "part": ("part",), "chapter": ("chapter",)}
    word = F.coalesce(*(F.when(shape.isin(*kinds), pick(f"^{KEYWORDS[level]}\\s+{ORD}", 1)) for level, kinds in headers.items()))
    opening, ascii_line = shape.isin("ordinal", "article", "glued"), A.arabic_to_ascii(line)
    number = (
        F.when(shape.isin("division", "book", "banner", "part", "chapter"), lookup(word, ORDINAL_NUMBERS))
        .when(opening, F.coalesce(lookup(pick(ISSUANCE, 1), FEMININE_NUMBERS), number_of(pick(ARTICLE, 1, na)), number_of(pick(GLUED, 2, na))))
        .when(shape == "range", number_of(pick(RANGE, 1, na)))
        .when(shape == "section", F.coalesce(number_of(pick(SECTION, 1, ascii_line)), number_of(pick(SECTION, 2, ascii_line))))
    )
    number2 = F.when(shape == "banner", lookup(pick(BANNER, 2), ORDINAL_NUMBERS)).when(shape == "range", number_of(pick(RANGE, 2, na)))
    words = F.when(shape == "chapter", 1 + F.size(F.split(word, " "))).when(shape == "preamble", 2).otherwise(0)
    title = (
        F.when(shape.isin(*STRUCTURAL), faithful_tail(line, F.when(shape == "banner", 2).otherwise(1), words))
        .when(shape == "section", A.strip(pick(SECTION, 3, ascii_line)))
        .when(shape == "subsection", A.strip(pick(LABEL, 1, line)))
        .when(shape == "label", line)
    )
    clause, rest = pick(RAW_GLUED, 1, line), pick(RAW_GLUED, 2, line)
    seed = F.when(opening & na.rlike(GLUED), A.strip(F.when(clause != "", F.concat(F.lit("("), clause, F.lit(") "), F.ltrim(rest))).otherwise(rest)))
    rows = rows.withColumn("seed", F.nullif(seed, F.lit("")))
    last = F.substring(F.rtrim(F.when(shape.isin("body", "ordinal"), line).when(opening, F.col("seed"))), -1, 1)
    opens = last.isin(":", "：") & F.coalesce(A.arabic_to_ascii(F.col("following")).rlike(SECTION), F.lit(False))
    block = "block" if "block" in rows.columns else F.lit(0).cast("long").alias("block")
    return rows.select(
        "doc_id", block, "page_number", "pos", "line", "shape", number.alias("number"), number2.alias("number2"), title.alias("title"), "seed", F.coalesce(shape.isin(*STRUCTURAL) & bare, F.lit(False)).alias("bare"),
        F.coalesce(last.isin(".", ":", "：", "؟"), F.lit(False)).alias("ends"), F.coalesce(opens, F.lit(False)).alias("opens"),
    )


LEVELS = ("division", "book", "part", "chapter", "section")
#: Levels whose number a kind gives (by the column it is in; 0: cleared), and the one whose title it gives.
MARKS = {
    "division": ({0: "number"}, 0), "book": ({1: "number"}, 1), "banner": ({1: "number", 2: "number2"}, 2), "part": ({2: "number"}, 2),
    "preamble": ({0: None, 1: None, 2: None}, 2), "chapter": ({3: "number"}, 3), "section": ({4: "number"}, 4),
}


class Reader:
    """What the lines so far leave in force: the state of the one pass over a document."""

    def __init__(self, saved: str | None = None):
        self.seen, self.session, self.end, self.closing, self.flagged = False, 0, None, False, False
        self.numbers, self.titles, self.label = [None] * 5, [None] * 5, None
        if saved:
            self.__dict__.update(json.loads(saved))
        self.context = self._context()

    def saved(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "context"})

    def _context(self) -> tuple:
        pairs = [x for n, t in zip(self.numbers, self.titles, strict=True) for x in (n or None, t)]
        return (*pairs, "preamble" if self.numbers[2] == 0 else "normal", self.label)

    def kind(self, shape: str) -> str:
        """Enacting articles stand before the first header."""
        if shape == "ordinal":
            return "body" if self.seen else "issuance"
        if shape == "glued":
            return "article" if self.seen else "issuance"
        return shape

    def text(self, ends: bool, opens: bool) -> None:
        """Whether an article's first sentence announces a list."""
        if ends and self.end is None:
            self.end = opens

    def header(self, kind: str, number, number2, title, seed, ends: bool, opens: bool) -> str:
        """A line that is no body; its kind, which is body for what an announced list holds."""
        if kind in OPENING:
            self.session += 1
            self.end, self.closing, self.flagged = None, False, False
            if seed is not None:
                self.text(ends, opens)
            return kind
        if kind in CLOSING:
            if not self.closing:
                self.closing, self.flagged = True, self.session > 0 and self.end is True
            if self.flagged:
                return "body"
        elif kind in STRUCTURAL:
            self.seen = True
        if kind in MARKS:
            self._mark(*MARKS[kind], {"number": number, "number2": number2, None: 0}, title)
        elif kind != "range" and title is not None:
            self.label = title
        else:
            return kind
        self.context = self._context()
        return kind

    def _mark(self, levels: dict, titled: int, given: dict, title) -> None:
        """A changed number clears all below it; a repeated one may fill a missing title."""
        above = False
        for i in range(5):
            before = None if above else self.numbers[i]
            after = given[levels[i]] if i in levels and given[levels[i]] is not None else before
            changed = above or after != before
            if changed:
                self.titles[i] = None
            self.numbers[i] = after
            if i == titled and title and self.titles[i] is None:
                self.titles[i] = title
            above = changed
        if above:
            self.label = None

    @property
    def closed(self) -> bool:
        return self.session == 0 or (self.closing and not self.flagged)


def _titled(c: dict, line, i: int, n: int) -> int:
    """Where the title lines of the bare header i end: body lines of its page."""
    j = i + 1
    while j < n and c["shape"][j] in ("body", "ordinal") and c["page_number"][j] == c["page_number"][i] and c["doc_id"][j] == c["doc_id"][i]:
        j += 1
    return j


GIVEN = ("doc_id", "page_number", "pos", "line")
_TOLD = ["doc_id", "block", "page_number", "shape", "number", "number2", "title", "seed", "bare", "ends", "opens"]


def _whole_titles(it):
    """Batches as tables cut where no bare header's title lines can go on."""
    left = None
    for b in it:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        bare = np.flatnonzero(t.column("bare").to_numpy())
        cut = n = t.num_rows
        if len(bare):
            tail = t.slice(int(bare[-1])).select(["shape", "page_number", "doc_id"]).to_pydict()
            if all(s in ("body", "ordinal") for s in tail["shape"][1:]) and len(set(zip(tail["page_number"], tail["doc_id"], strict=True))) == 1:
                cut = int(bare[-1])
        if cut:
            yield t.slice(0, cut)
        left = t.slice(cut) if cut < n else None
    if left is not None:
        yield left


def _differs(a: pa.Array) -> np.ndarray:
    """Where a value is not the one before it; nulls are one value."""
    one, two = a.slice(1), a.slice(0, max(len(a) - 1, 0))
    other = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
    return other | (one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False))


def _listed(a: pa.ChunkedArray) -> list:
    """A column as Python values, by way of numpy, which is faster than Arrow's own."""
    if pa.types.is_integer(a.type):
        return [v if ok else None for v, ok in zip(pc.fill_null(a, 0).to_numpy().tolist(), a.is_valid().to_numpy().tolist(), strict=True)]
    return (pc.fill_null(a, False) if pa.types.is_boolean(a.type) else a).to_numpy().tolist()


def _spread(values: list, type_: pa.DataType, at: np.ndarray) -> pa.Array:
    return pa.array(values, type_).take(pa.array(at))


def _parse(it, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None):
    """L12 to L18 in one pass: every line's kind and what is in force at it. A line of shape `state` brings a block's beginning.

    The pass stops at lines that can change something: a block's first, those that are no body, and body lines that end a sentence after
    one of these. What it finds there is then laid over the lines up to the next stop. Lines of other kinds and columns that were not asked
    for are not made.
    """
    reader, now = Reader(), None
    for t in _whole_titles(it):
        n, line = t.num_rows, t.column("line")
        shape_codes = t.column("shape").combine_chunks().dictionary_encode()
        names, codes = shape_codes.dictionary.to_pylist(), shape_codes.indices.to_numpy(zero_copy_only=False)
        coded = lambda *of: np.isin(codes, [i for i, s in enumerate(names) if s in of])  # noqa: B023, E731
        body, plain = coded("body"), coded("body", "ordinal")
        moved = lambda k: np.concatenate([[True], _differs(t.column(k).combine_chunks())])  # noqa: B023, E731
        first = moved("doc_id") | moved("block")
        # where title lines that begin at a line end
        breaks = np.where(~plain | moved("doc_id") | moved("page_number"), np.arange(n), n)
        ends_at = np.append(np.minimum.accumulate(breaks[::-1])[::-1], n)
        stops = np.flatnonzero(first | ~body | pc.fill_null(t.column("ends"), False).to_numpy())
        # a body line that ends a sentence says nothing new after another of its page; on other pages the other may be a title
        said, page = (body & ~first)[stops], np.cumsum(first | moved("page_number"))[stops]
        stops = stops[~(said & np.concatenate([[False], said[:-1] & (page[1:] == page[:-1])]))]
        c = {k: _listed(t.column(k).take(pa.array(stops))) for k in ("number", "number2", "title", "seed", "bare", "ends", "opens")}
        stop_shapes, fresh = [names[k] for k in codes[stops].tolist()], first[stops].tolist()
        found, title_runs = ["body"] * len(stops), []
        numbers, numbers2, titles, seeds = ([None] * len(stops) for _ in range(4))
        begins, sessions, closed, contexts, at_context, done = [], [], [], [], [], 0
        for e, i in enumerate(stops.tolist()):
            if i < done:
                continue  # a title line
            if fresh[e] and (i or (t.column("doc_id")[0].as_py(), t.column("block")[0].as_py()) != now):
                reader = Reader()
            shape = stop_shapes[e]
            if shape == "state":
                reader = Reader(c["title"][e])
            elif (kind := shape if shape == "body" else reader.kind(shape)) == "body":
                reader.text(c["ends"][e], c["opens"][e])
            else:
                title = c["title"][e]
                if c["bare"][e]:
                    done = int(ends_at[i + 1])
                    title = " ".join(line[k].as_py() for k in range(i + 1, done))
                    title_runs.append((i + 1, done))
                found[e] = reader.header(kind, c["number"][e], c["number2"][e], title, c["seed"][e], c["ends"][e], c["opens"][e])
                if found[e] == kind:
                    numbers[e], numbers2[e], titles[e], seeds[e] = c["number"][e], c["number2"][e], title, c["seed"][e]
            if not contexts or contexts[-1] is not reader.context:
                contexts.append(reader.context)
            begins.append(i)
            sessions.append(reader.session)
            closed.append(reader.closed)
            at_context.append(len(contexts) - 1)
        now = (t.column("doc_id")[-1].as_py(), t.column("block")[-1].as_py())
        own = np.full(n, len(stops))  # the stop that a line is, else one that says nothing
        own[stops] = np.arange(len(stops))
        table = [*found, "body", "title"]
        kind_at = own.copy()
        for i, j in title_runs:
            kind_at[i:j], own[i:j] = len(stops) + 1, len(stops)
        keep = ~coded("state")
        if kinds:
            keep &= np.array([k in kinds for k in table])[kind_at]
        keep = np.flatnonzero(keep)
        own, kind_at, since = own[keep], kind_at[keep], np.searchsorted(np.array(begins), keep, side="right") - 1
        in_force = np.array(at_context)[since]
        rows = pa.array(keep)
        made = {
            "kind": lambda: _spread(table, pa.string(), kind_at),  # noqa: B023
            "number": lambda: _spread([*numbers, None], pa.int32(), own),  # noqa: B023
            "number2": lambda: _spread([*numbers2, None], pa.int32(), own),  # noqa: B023
            "title": lambda: _spread([*titles, None], pa.string(), own),  # noqa: B023
            "seed": lambda: _spread([*seeds, None], pa.string(), own),  # noqa: B023
            "session": lambda: _spread(sessions, pa.int64(), since),  # noqa: B023
            "closed": lambda: _spread(closed, pa.bool_(), since),  # noqa: B023
        }
        wanted = columns or (*GIVEN, *made, *CONTEXT)
        held = lambda k: _spread([x[CONTEXT.index(k)] for x in contexts], pa.int32() if k.endswith("_number") else pa.string(), in_force)  # noqa: B023, E731
        out = [t.column(k).take(rows).combine_chunks() if k in GIVEN else made[k]() if k in made else held(k) for k in wanted]
        if len(keep):
            yield pa.RecordBatch.from_arrays(out, list(wanted))


def _events(it):
    """Of each block the lines that can change a state, and one of shape `start`: headers with their titles, and of the other lines the
    first that ends a sentence after each."""
    now, ended = None, False
    for t in _whole_titles(it):
        c, line = {k: t.column(k).to_pylist() for k in _TOLD}, t.column("line")
        keep, shapes_, titles, i, n, seen = [], list(c["shape"]), list(c["title"]), 0, t.num_rows, False
        while i < n:
            key = (c["doc_id"][i], c["block"][i])
            if key != now:
                now, ended, seen = key, False, False
                keep.append((i, "start", None))
            shape, j = shapes_[i], i + 1
            if c["bare"][i]:
                j = _titled(c, line, i, n)
                titles[i] = " ".join(line[k].as_py() for k in range(i + 1, j))
            if shape != "body":
                keep.append((i, shape, titles[i]))
                ended = False
            elif c["ends"][i] and not ended:
                keep.append((i, shape, None))
                ended = True
            i = j
        if keep:
            at = pa.array([k[0] for k in keep])
            part = t.take(at).combine_chunks().to_batches()[0]
            swap = {"shape": pa.array([k[1] for k in keep], pa.string()), "title": pa.array([k[2] for k in keep], pa.string())}
            names = [k for k in part.schema.names if k != "line"]
            yield pa.RecordBatch.from_arrays([swap[k] if k in swap else part.column(k) for k in names], names)


def _beginnings(t: pa.Table) -> pa.Table:
    """The state before each block of one document, by a pass over its events."""
    rows = t.to_pylist()
    rows.sort(key=lambda r: (r["block"], r["pos"], r["shape"] != "start"))
    reader, out = Reader(), []
    for r in rows:
        if r["shape"] == "start":
            out.append((r["doc_id"], r["block"], reader.saved()))
        elif (kind := reader.kind(r["shape"])) == "body":
            reader.text(r["ends"], r["opens"])
        else:
            reader.header(kind, r["number"], r["number2"], r["title"], r["seed"], r["ends"], r["opens"])
    return pa.Table.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((t.schema.field("doc_id").type, pa.int64(), pa.string()))], ["doc_id", "block", "state"])


def classify(rows: DataFrame, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The lines without furniture with kind, number, number2, title, seed, session, closed, and the CONTEXT in force at each;
    with kinds and columns, all lines are read but only those are made.

    Lines are marked in the JVM and read once, in order, where the exchange of `normalised` has put them. Rows that came in blocks of
    pages are read twice: first each block alone, for the few lines that can change a state; these, without their texts, are
    folded document by document into the state before each block, with which the blocks are then read apart.
    """
    lines_ = marked(rows)
    types = dict(lines_.dtypes)
    order = ["doc_id", "block", "pos"]
    out = {k: types[k] for k in GIVEN} | {"kind": "string", "number": "int", "number2": "int", "title": "string", "seed": "string", "session": "long", "closed": "boolean"}
    out |= {c: "int" if c.endswith("_number") else "string" for c in CONTEXT}
    schema = ", ".join(f"{k} {out[k]}" for k in columns or out)
    parse = partial(_parse, kinds=kinds, columns=columns)
    if "block" not in rows.columns:
        return lines_.sortWithinPartitions(*order).mapInArrow(parse, schema)
    lines_ = lines_.persist(StorageLevel.DISK_ONLY)  # read twice; lost parts are made again
    told = ", ".join(f"{k} {v}" for k, v in lines_.dtypes if k != "line")
    events = lines_.sortWithinPartitions(*order).mapInArrow(_events, told)
    states = events.groupBy("doc_id").applyInArrow(_beginnings, f"doc_id {types['doc_id']}, block long, state string")
    empty = {k: F.lit(None).cast(v) for k, v in types.items()} | {"pos": F.lit(-1).cast(types["pos"]), "shape": F.lit("state"), "line": F.lit(""), "title": F.col("state"), "bare": F.lit(False), "doc_id": F.col("doc_id"), "block": F.col("block")}
    both = lines_.unionByName(states.select(*(v.alias(k) for k, v in empty.items())))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "doc_id", "block").sortWithinPartitions(*order).mapInArrow(parse, schema)


def with_context(rows: DataFrame) -> DataFrame:
    """The division, book, part, chapter, section and label in force at each line, which `classify` has carried along."""
    return rows.select("*")


CONTEXT = [f"{k}_{x}" for k in ("division", "book", "part", "chapter", "section") for x in ("number", "title")] + ["part_kind", "subsection_title"]


def slice_articles(rows: DataFrame) -> DataFrame:
    """One row for each article and repealed range, from lines with context."""
    opening, ranges = F.col("kind").isin(*OPENING), F.col("kind") == "range"
    text = F.when(opening, F.col("seed")).when((F.col("kind") == "body") & ~F.col("closed"), F.col("line"))
    # a range is a record of its own beside the session that it ends; one aggregation over the same partitioning makes both
    own = rows.where((F.col("session") > 0) | ranges).withColumn("_t", text).withColumn("_r", F.when(ranges, F.col("pos")))
    head = opening | ranges
    at_head = lambda c: F.max(F.when(head, F.col(c))).alias(c)
    body_lines = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("pos", "_t"))))
    records = own.groupBy("doc_id", "session", "_r").agg(
        *map(at_head, ("kind", "number", "number2", *CONTEXT)), F.max(F.when(head, F.col("page_number"))).alias("page_start"), F.max(F.when(F.col("_t").isNotNull() | head, F.col("page_number"))).alias("page_end"),
        F.min(F.when(head, F.col("pos"))).alias("pos"), F.array_join(F.transform(body_lines, lambda x: x["_t"]), " ").alias("_body"),
    )
    issuance, whole = F.col("kind") == "issuance", F.col("_r").isNotNull()
    note = F.format_string("المواد من %d إلى %d ملغاة", "number", "number2")
    return records.select(
        "doc_id", "pos", F.when(issuance, "issuance").otherwise("substantive").alias("article_type"), F.when(~issuance & ~whole, F.col("number")).alias("article_number"), F.when(issuance, F.col("number")).alias("issuance_number"),
        F.when(whole, note).otherwise(A.format_clause_structure(F.col("_body"))).alias("body"), F.when(whole, "repealed").otherwise("active").alias("article_status"), F.when(whole, F.concat_ws("-", "number", "number2")).alias("repealed_range"),
        *CONTEXT, "page_start", "page_end", whole.alias("_w"),
    ).withColumn("char_count", F.when(F.col("_w"), 0).otherwise(F.length("body"))).drop("_w")


def diagnostics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels found, and body lines outside any article."""
    labels = rows.where(F.col("kind").isin("subsection", "label")).select("doc_id", "page_number", "pos", "line", "title", (F.col("kind") == "subsection").alias("has_colon"))
    return labels, rows.where("kind = 'body' and closed").select("doc_id", "page_number", "pos", "line")


def detect_structure(rows: DataFrame) -> DataFrame:
    """Bare headers and article headers that stand alone, in order. rows: normalised lines."""
    kind = F.coalesce(*(F.when(F.col("norm").rlike(p), k) for k, p in BARE.items()), F.when(F.col("na").rlike(ARTICLE), "article"))
    number = F.coalesce(*(lookup(F.nullif(F.regexp_extract("norm", p, 1), F.lit("")), ORDINAL_NUMBERS) for p in BARE.values()), F.nullif(F.regexp_extract("na", ARTICLE, 1), F.lit("")).try_cast("int"))
    found = rows.withColumn("level", kind).where("level is not null").withColumn("number", number)
    return found.select("doc_id", "page_number", "pos", "level", "number", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("ord"))
