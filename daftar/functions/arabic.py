"""Normalisation of Arabic statute text as column expressions; all but NFKC stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that a cleaned text must not hold, and what stands for them.
PUA_MARKS = {"\ue823": "\u064b", "\ue821": "\u064f", "\ue825": "\u0651", "\ue82c": "\u0651", "\ue820": "\u0651"}
PUA_LIGATURE = ("\uf001", "\u0644\u0645\u062c")
PUA_DROPPED = "\uf220"
DIRECTIONAL = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u061c\u200b\u200c\u200d\ufeff"
MARKS = "".join(map(chr, [*range(0x64B, 0x656), 0x670]))
PUA_RANGE = "\ue000-\uf8ff"
ARABIC_DIGITS, EASTERN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
#: White space as Python's strip sees it, without and with the newline.
BLANKS = " \t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = BLANKS + "\n"
_BLANK_SIGNS = " \t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LETTERS = "\u0621-\u064a"
#: Letters that make up one token of the glyph repair.
TOKEN_LETTERS = "\u0621-\u063a\u0640-\u064a\u0671-\u06d3"
# Words whose madda is genuine, and those where it stands for a plain alef.
KEEP_MADDA = (
    "آثار", "آخر", "الآبار", "الآتي", "الآتية", "الآتيتين", "الآثار", "الآخر", "الآخرون", "الآخرين",
    "الآداب", "الآلات", "المنشآت", "بالآثار", "لآخرين", "للآبار", "للآخر", "للآداب", "منشآت", "منشآته",
    "والآبار", "والآثار", "والآلات", "والمنشآت",
)
MADDA_TO_ALEF = ("آي", "بآت", "بآي")
AFFECTED_LAWS = (131,)
# Ordinal words that open a clause.
CLAUSE_ORDINALS = ("أولا", "ثانيا", "ثالثا", "رابعا", "خامسا", "سادسا", "سابعا", "ثامنا", "تاسعا", "عاشرا")


def strip(c: Column) -> Column:
    """Trims by a set of signs: no regular expression looks at the text between the ends."""
    return F.btrim(c, F.lit(_BLANK_SIGNS + "\n"))


def repair_pua(c: Column) -> Column:
    """Known private-use glyphs become letters and marks, others go; texts without any are only looked through."""
    given = c
    c = F.replace(c, F.lit(PUA_LIGATURE[0]), F.lit(PUA_LIGATURE[1]))
    c = F.translate(c, "".join(PUA_MARKS) + PUA_DROPPED, "".join(PUA_MARKS.values()))
    return F.when(given.rlike(f"[{PUA_RANGE}]"), F.regexp_replace(c, f"[{PUA_RANGE}]", "")).otherwise(given)


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """A batch's texts, 64 at a time: of the others none is a Python string."""
    normal = lambda few: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in few.to_pylist()], pa.string())
    return pa.concat_arrays([normal(texts.slice(i, 64)) for i in range(0, max(1, len(texts)), 64)])


def nfkc(c: Column) -> Column:
    """Spark has no such function; only texts beyond ASCII go through Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def strip_directional(c: Column) -> Column:
    """T3."""
    return F.regexp_replace(c, f"[{DIRECTIONAL}]+", "")


def reattach(c: Column) -> Column:
    """T4: no space before a combining mark or before Arabic punctuation."""
    return F.regexp_replace(c, f"[ \t]++([{MARKS}،؛؟])", "$1")


def space_boundaries(c: Column) -> Column:
    """T5: a space between Arabic digits and letters, and after a comma or semicolon glued to a letter."""
    between = f"(?<=[٠-٩])(?=[{LETTERS}])|(?<=[{LETTERS}])(?=[٠-٩])|(?<=[،؛])(?=[{LETTERS}])"
    return F.when(c.rlike("[٠-٩،؛]"), F.regexp_replace(c, between, " ")).otherwise(c)


def one_space(c: Column) -> Column:
    """Runs of spaces and tabs become one space; single spaces are not touched."""
    return F.regexp_replace(c, "[ \t]{2,}|\t", " ")


def collapse(c: Column) -> Column:
    """Runs of blanks, runs of newlines, then each line's ends."""
    c = F.regexp_replace(one_space(c), "\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, f"[{BLANKS}]*+\n[{BLANKS}]*+", "\n"))


def clean_text(c: Column, with_nfkc: bool = True) -> Column:
    """The faithful copy. Without NFKC it has a SQL equivalent."""
    c = repair_pua(c)
    return collapse(space_boundaries(reattach(strip_directional(nfkc(c) if with_nfkc else c))))


def normalize_for_embedding(c: Column, fold_alef=True, fold_yaa=True, fold_taa_marbuta=False, strip_harakat=True) -> Column:
    """Letter folds in one translate; newlines survive."""
    pairs = {"\u06cc": "\u064a", "\u06a9": "\u0643"}
    if fold_alef:
        pairs |= dict.fromkeys("\u0623\u0625\u0622\u0671", "\u0627")
    if fold_yaa:
        pairs |= {"ى": "ي"}
    if fold_taa_marbuta:
        pairs |= {"ة": "ه"}
    gone = "ـ" + (MARKS if strip_harakat else "")
    return strip(one_space(F.translate(c, "".join(pairs) + gone, "".join(pairs.values()))))


def normalize_for_match(c: Column) -> Column:
    """For both sides of every comparison."""
    return normalize_for_embedding(c)


def digits_to_ascii(c: Column) -> Column:
    """T10, Arabic-Indic and Eastern digits."""
    return F.translate(c, ARABIC_DIGITS + EASTERN_DIGITS, ASCII_DIGITS * 2)


def arabic_to_ascii(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, ASCII_DIGITS)


def ascii_to_arabic(c: Column) -> Column:
    return F.translate(c.cast("string"), ASCII_DIGITS, ARABIC_DIGITS)


def clause_steps() -> list[tuple[str, str, str]]:
    """T11's ordered rewrites: pattern after the boundary, replacement's tail, group count of the tail's text."""
    digits, harakat = "٠-٩", "[\u064b-\u0652\u0670]*"
    flexible = "|".join(harakat.join(w) + harakat for w in CLAUSE_ORDINALS)
    return [
        (f"\\s*[.\\-]\\s*([{digits}]+)\\s*[-.]?\\s+", "- ", ""),
        (f"\\s*[()]+\\s*([0-9{digits}]+)\\s*[()]*\\s+", ") ", "("),
        (f"\\s*[()]*\\s*({flexible})\\s*[()]*\\s+", ") ", "("),
        (f"\\s*\\(\\s*([ء-ي])ـ?{harakat}\\s*\\)\\s+", ") ", "("),
    ]


def format_clause_structure(c: Column) -> Column:
    """Every clause on a line of its own with its marker in canonical form; a newline only after a boundary sign."""
    harakat = "[\u064b-\u0652\u0670]*"
    c = F.regexp_replace(c, f"\\)\\s*([ء-ي])ـ?{harakat}\\s*\\(", "($1)")
    c = F.regexp_replace(c, "\\)\\s*\\(\\s*([0-9٠-٩]+)", "($1) ")
    for pattern, after, before in clause_steps():
        c = F.regexp_replace(c, "^" + pattern, f"{before}$1{after}")
        c = F.regexp_replace(c, "([.:؛])" + pattern, f"$1\n{before}$2{after}")
    bullet = "\\s*-\\s*(?=[^0-9\\s٠-٩])"
    c = F.regexp_replace(F.regexp_replace(c, "^" + bullet, "- "), "([.:؛])" + bullet, "$1\n- ")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n[ \t]+", "\n"))


def madda_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([{TOKEN_LETTERS}]+|[^{TOKEN_LETTERS}]+)"), F.lit(1))


def repair_glyphs(c: Column) -> Column:
    """In each token with madda keep it, or put alef, or put kaf."""

    def fix(t: Column) -> Column:
        return (
            F.when(~t.contains("آ") | t.isin(*KEEP_MADDA), t).when(t.isin(*MADDA_TO_ALEF), F.translate(t, "آ", "ا")).when(t.rlike(f"^[{TOKEN_LETTERS}]"), F.translate(t, "آ", "ك")).otherwise(t)
        )

    return F.array_join(F.transform(madda_tokens(c), fix), "")


def normalize_law_name(c: Column) -> Column:
    """Folds ta marbuta too; null and empty are ''."""
    c = F.translate(F.coalesce(c, F.lit("")), "\u0623\u0625\u0622\u0671\u0649\u06cc\u0629\u0640", "\u0627\u0627\u0627\u0627\u064a\u064a\u0647")
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def article_number(c: Column) -> Column:
    """struct(number, is_mukarrar); number null where there is none."""
    ascii_ = digits_to_ascii(c)
    number = F.regexp_extract(ascii_, "[0-9]+", 0)
    return F.struct(F.when(number != "", number.try_cast("int")).alias("number"), ascii_.contains("مكرر").alias("is_mukarrar"))


def strip_code_fence(c: Column) -> Column:
    """T16, first half."""
    s = strip(c)
    inner = F.regexp_replace(F.regexp_replace(s, f"^```(?:json)?[{SPACE}]*", ""), f"[{SPACE}]*```\\z", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


ANSWER = "answer_text string, citations array<struct<law_name:string,article_number:string,citation_label:string>>"


def parse_answer(c: Column) -> Column:
    """The answer of a JSON object; of anything else the raw text without citations."""
    cleaned = strip_code_fence(c)
    good = F.try_parse_json(cleaned).isNotNull() & cleaned.startswith("{")
    parsed = F.from_json(cleaned, ANSWER)
    none = F.array().cast("array<struct<law_name:string,article_number:string,citation_label:string>>")
    return F.when(good, F.struct(F.coalesce(parsed["answer_text"], F.lit("")).alias("answer_text"), F.coalesce(parsed["citations"], none).alias("citations"))).otherwise(
        F.struct(c.alias("answer_text"), none.alias("citations"))
    )


def content_text(c: Column) -> Column:
    """A string as it is; of a JSON list of parts the strings and the text parts, joined."""
    parts = F.from_json(c, "array<string>")
    kind = lambda p: F.get_json_object(p, "$.type")
    text = lambda p: F.when(p.startswith("{"), F.when(kind(p) == "text", F.coalesce(F.get_json_object(p, "$.text"), F.lit("")))).otherwise(p)
    joined = F.array_join(F.transform(parts, text), "")
    return F.when(c.startswith("[") & F.try_parse_json(c).isNotNull(), joined).otherwise(c)


def preview(c: Column, width: int = 240) -> Column:
    """White space collapsed, cut at a word's end with an ellipsis."""
    s = strip(F.regexp_replace(c, f"[{SPACE}]+", " "))
    head = F.regexp_extract(F.substring(s, 1, width - 1), "(?s)^(.*) ", 1)
    return F.when(F.length(s) <= width, s).otherwise(F.concat(head, F.lit(" …")))
