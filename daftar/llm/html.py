"""Operator 4: main text of web pages by nearest-URL page differencing, ranked by structure.

A page becomes text lines, one for each block, each with what its elements say of it: left out (menu, header, footer, advert and so
on), inside a marked main element, or open. Pages of one host are set in the order of their paths; every page is differenced with
its nearest neighbour over all its lines: those that the two share, aligned by longest common subsequence, belong to the site's frame
and are deleted. What a main element holds is the page's own, also where a copy of the article or a quoted passage lies next door, so
a shared line inside one stays. Structure then ranks what is left: marked text, or the open text where that is the longer.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import batches
from .shared import materialise
from .urls import host_of, path_of

# Elements by what HTML makes of them.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp")
OUTSIDE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
#: Words of a class, id or role that name, wherever they stand, what is not the article.
_NEVER = r"(?:ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popups?|nav|navigation|navbar|menus?|breadcrumbs?|sidebars?|footer|masthead|comments?|disqus|replies|newsletter|pagination|pager|contentinfo|complementary)"
#: Words that name it as the whole of a class, or outside main elements, where they do not name a part of the text.
_OFTEN = r"(?:promo\w*|banners?|notices?|alerts?|modal|overlay|header|respond|related|recommend\w*|share|sharing|social|subscribe|signup|login|search|widgets?|toolbar|copyright)"
NEVER = re.compile(rf"(?:^|[\s_-]){_NEVER}(?:$|[\s_-])|(?:^|\s)(?:notices?|alerts?|banners?|share|sharing|social|promo|related[_-](?:posts?|articles?|links?|stories|news))(?:$|\s)", re.I)
OFTEN = re.compile(rf"(?:^|[\s_-])(?:{_NEVER}|{_OFTEN})(?:$|[\s_-])", re.I)
#: Words, as a part of a class, of blocks inside main elements that are not the article's (a paragraph or heading may be called so and stays).
_BLOCK = r"(?:promo\w*|banners?|notices?|alerts?|modal|overlay|related-(?:posts?|articles?|links?|stories|news)|recommend\w*|share|sharing|social|subscribe|signup|login|widgets?|toolbar)"
BLOCK = re.compile(rf"(?:^|[\s_-]){_BLOCK}(?:$|[\s_-])", re.I)
BLOCKS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "fieldset"}
#: Main elements that are no article: reader comments, adverts, teasers.
NO_ARTICLE = re.compile(r"(?:^|\s)(?:(?:user-|reader-)?(?:comments?|reply|replies)(?:-(?:item|body|entry|list|thread|content|\d+))?|advert\w*|ads?|ad-\w+|sponsored|promo|promoted|teasers?|teaser-\w+|related|related-\w+)(?:$|\s)", re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>/]|$)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"""[>"']""")
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")

OPEN, INSIDE, LEFT_OUT = 0, 1, 2


class _Markup:
    """Tags of a page in one pass. A quote counts only after "=", as in HTML; from the first one that never closes on, none does, and
    a tag without end is text. So no part of a page is searched more than twice."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`; -1 without an end."""
        page, start = self.page, at
        while self.quotes:
            m = _STOP.search(page, at)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                at = m.end()
                before = at - 2
                while before >= start and page[before].isspace():
                    before -= 1
                if page[before] == "=":
                    at = page.find(m[0], at) + 1
                    self.quotes = at > 0
        return page.find(">", start) + 1 or -1

    def __iter__(self):
        """(text before, closes, name, attributes, end) of each tag, then the text that is left with name None. Comments and
        declarations have no name either."""
        page, at, text = self.page, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                yield page[text:], False, None, "", len(page)
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at) + 3
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1
            else:
                m = _NAME.match(page, at)
                if m is None:
                    at += 1
                    continue
                end = self._end(m.end())
                if end < 0:
                    yield page[text:], False, None, "", len(page)
                    return
                name = m[1].lower()
                closes = page[at + 1] == "/"
                skip = yield page[text:at], closes, name, page[m.end() : end - 1], end
                at = text = skip or end
                continue
            end = end if end > 2 else len(page)
            yield page[text:at], False, None, "", end
            at = text = end

    def raw_end(self, name: str, at: int) -> int:
        m = _RAW_END[name].search(self.page, at)
        return (self.page.find(">", m.end()) + 1 if m else 0) or len(self.page)


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's blocks in order: text with references decoded and white space as one space, and OPEN, INSIDE or LEFT_OUT. Time
    grows with the page's length, whatever its markup."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # element and the state before it
    standing: Counter = Counter()  # names on the stack
    state = OPEN

    def close() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, state))

    def judged(name: str, attributes: str) -> int:
        if state == LEFT_OUT:
            return state
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        if attributes and _HIDDEN.search(attributes):
            return LEFT_OUT
        if name in MAIN:
            return LEFT_OUT if named and NO_ARTICLE.search(named) else INSIDE
        if name in OUTSIDE and not (name == "header" and state == INSIDE):  # an article's own header holds its title
            return LEFT_OUT
        if named and name not in ("body", "html") and (NEVER if state == INSIDE else OFTEN).search(named):
            return LEFT_OUT
        if named and state == INSIDE and name in BLOCKS and BLOCK.search(named):
            return LEFT_OUT
        return INSIDE if re.search(r"(?:^|\s)main(?:$|\s)", named) else state

    markup = _Markup(page)
    tags = iter(markup)
    found = next(tags)
    while found is not None:
        before, closes, name, attributes, end = found
        skip = None
        if before:
            text.append(before)
        if name is None:
            pass
        elif closes:
            if name not in INLINE:
                close()
            if standing[name]:
                close()
                while True:
                    top, state_before = stack.pop()
                    standing[top] -= 1
                    if top == name:
                        break
                state = state_before
        elif name in RAW:
            if (name != "title" or state != INSIDE) and not attributes.endswith("/"):
                skip = markup.raw_end(name, end)
        else:
            if name not in INLINE:
                close()
            if name not in VOID and not attributes.endswith("/"):
                new = judged(name, attributes)
                if new != state:
                    close()
                if new != state or standing[name]:  # so that an end tag doesn't close an outer element of its name
                    stack.append((name, state))
                    standing[name] += 1
                state = new
        try:
            found = tags.send(skip)
        except StopIteration:
            found = None
    close()
    return out


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a lie in a longest common subsequence of a and b (hashes of lines). Common ends first; then a bit-parallel
    table, one row of len(b) bits for each entry of a, of which some are kept and the others are made again on the way back."""
    hit = np.zeros(len(a), bool)
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    hit[:lo] = True
    hit[len(a) - hi :] = True if hi else hit[len(a) - hi :]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    in_x, in_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))  # other lines can't align
    x, y = x[in_x].tolist(), y[in_y].tolist()
    if not x or not y:
        return hit
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    full, often = (1 << len(y)) - 1, {}

    def mask(v: int) -> int:
        at = places[v]
        if len(at) == 1:
            return 1 << at[0]
        if v in often:
            return often[v]
        bits = bytearray(len(y) // 8 + 1)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        made = int.from_bytes(bits, "little")
        if len(at) * 64 >= len(y):  # at most 64 such values
            often[v] = made
        return made

    def rows(start: int, row: int, stop: int):
        """The table's rows start + 1 to stop after `row`: a zero bit is where the common length grows by one."""
        for v in x[start:stop]:
            both = row & mask(v)
            row = ((row + both) | (row - both)) & full
            yield row

    step, kept, row = max(64, int(len(x) ** 0.5)), [full], full
    for i, row in enumerate(rows(0, full, len(x))):
        if (i + 1) % step == 0:
            kept.append(row)
    i, j, table, base = len(x), len(y), [], len(x) + 1
    while i and j:
        if i - 1 < base:
            base = (i - 1) // step * step
            table = [kept[base // step], *rows(base, kept[base // step], i)]
        if table[i - base] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - base] >> (j - 1) & 1:
                hit[lo + in_x[i]] = True
                j -= 1
    return hit


def nearest_pages(pages: DataFrame) -> DataFrame:
    """key, partner: for each page (host, path, key) the neighbour in its host's path order whose path shares more leading characters
    (ties: the one before). Pages alone on their host have no row.

    Pages are range-partitioned and sorted by host, path and key, so a host of any size spreads over many tasks; each partition's
    ends look over to the next partition through a table of two rows a partition.
    """
    keys = pages.select("host", "path", "key")
    placed = keys.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed)
    inner = W.partitionBy("part").orderBy("at")
    here = F.struct("host", "path", "key")
    seen = placed.withColumn("before", F.lag(here).over(inner)).withColumn("after", F.lead(here).over(inner))
    ends = placed.groupBy("part").agg(F.min_by(here, "at").alias("first"), F.max_by(here, "at").alias("last"))
    order = W.orderBy("part")  # two rows a partition
    ends = ends.select("part", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    seen = seen.join(F.broadcast(ends), "part").select("host", "path", "key", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))

    @F.pandas_udf("int")
    def common(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([len(os.path.commonprefix((p, q))) if isinstance(q, str) else -1 for p, q in zip(one, two, strict=True)], dtype="int32")

    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.path"))
    seen = seen.withColumn("b", common("path", same("before"))).withColumn("a", common("path", same("after")))
    partner = F.when(F.greatest("a", "b") >= 0, F.when(F.col("b") >= F.col("a"), F.col("before.key")).otherwise(F.col("after.key")))
    return seen.select("key", partner.alias("partner")).where("partner is not null")


def _main(lines: list[tuple[str, int]], gone: set[int]) -> list[str]:
    """The lines of the main text, once those numbered `gone` are deleted: marked ones, or open ones if they are the longer."""
    inside = [t for t, s in lines if s == INSIDE]
    open_ = [t for i, (t, s) in enumerate(lines) if s == OPEN and i not in gone]
    return inside if sum(map(len, inside)) >= sum(map(len, open_)) else open_


#: Pages with shared lines up to which their lists of deleted lines are broadcast, and the deleted lines they may hold in all.
BROADCAST_ROWS, BROADCAST_LINES = 250_000, 2_500_000


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points), lines_shared.

    lines_shared: the lines that differencing with the nearest neighbour deletes, of all lines outside main elements. If it would
    delete all of several open lines of a page without marked text, the pages are copies of one another and its open lines stay. Of
    the rest the text has, in page order, the lines inside main elements, or, if those are shorter (a teaser beside the text), the
    open lines. Lines left out by their elements never return. A null or empty html gives an empty text; a null url has an empty
    host and path. Repeated rows stay and fare alike; an empty table gives no rows. A page of any length stays in one task, in time
    that grows with its length; between pages only hashes of lines move, and pages are parsed again where the results meet them.
    """
    url = F.coalesce(pages["url"], F.lit(""))
    key = F.unhex(F.md5(F.to_json(F.struct(pages["page_id"].cast("string").alias("i"), pages["url"].cast("string").alias("u"), F.md5(pages["html"].cast("binary")).alias("h")))))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"], key.alias("key"))

    def parse(it):
        for b in batches(it, 256):
            states, hashes = [], []
            for page in b.column(1).to_pylist():
                lines = lines_of(page or "")
                states.append(bytes(s for _, s in lines))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(t) for t, _ in lines], "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.binary()), pa.array(hashes, pa.binary()), b.column(2), b.column(3)], ["key", "states", "hashes", "host", "path"])

    urls = rows.select("key", "html", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = materialise(urls.mapInArrow(parse, "key binary, states binary, hashes binary, host string, path string").dropDuplicates(["key"]))
    near = nearest_pages(parsed).join(parsed.select(F.col("key").alias("partner"), F.col("hashes").alias("other")), "partner").select("key", "other")

    def difference(it):
        for b in batches(it, 256):
            keys, gone = [], []
            for k, states, hashes, other in zip(*(b.column(c).to_pylist() for c in ("key", "states", "hashes", "other")), strict=True):
                state = np.frombuffer(states, np.uint8)
                shared = shared_lines(np.frombuffer(hashes, "<u8"), np.frombuffer(other, "<u8")) & (state != INSIDE)
                if shared[state == OPEN].all() and not (state == INSIDE).any():
                    shared[state == OPEN] = False
                if shared.any():
                    keys.append(k), gone.append(np.flatnonzero(shared).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    deleted = materialise(parsed.select("key", "states", "hashes").join(near, "key").mapInArrow(difference, "key binary, gone array<int>"))
    n, n_lines = deleted.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and n_lines <= BROADCAST_LINES:
        deleted = F.broadcast(deleted)

    def write(it):
        for b in batches(it, 256):
            texts, counts = [], []
            for page, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                texts.append(" ".join(_main(lines_of(page or ""), set(gone or ()))))
                counts.append(len(gone or ()))
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "lines_shared"])

    met = rows.join(deleted, "key", "left").select("page_id", "url", "html", "gone")
    return met.mapInArrow(write, "page_id long, url string, text string, n_chars long, lines_shared int")
