"""The functions of functions/arabic.py as DuckDB SQL text, for oracles. Each takes and returns SQL text."""

from __future__ import annotations

from daftar.functions import arabic as A


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def tr(x: str, of: str, to: str) -> str:
    return f"translate({x}, {q(of)}, {q(to)})"


def strip(x: str) -> str:
    return sub(x, f"^[{A.SPACE}]+|[{A.SPACE}]+$", "")


def repair_pua(x: str) -> str:
    x = f"replace({x}, {q(A.PUA_LIGATURE[0])}, {q(A.PUA_LIGATURE[1])})"
    return sub(tr(x, "".join(A.PUA_MARKS) + A.PUA_DROPPED, "".join(A.PUA_MARKS.values())), f"[{A.PUA_RANGE}]", "")


def strip_directional(x: str) -> str:
    return tr(x, A.DIRECTIONAL, "")


def reattach(x: str) -> str:
    return sub(sub(x, f"[ \t]+([{A.MARKS}])", r"\1"), "[ \t]+([،؛؟])", r"\1")


def space_boundaries(x: str) -> str:
    x = sub(x, f"([٠-٩])([{A.LETTERS}])", r"\1 \2")
    x = sub(x, f"([{A.LETTERS}])([٠-٩])", r"\1 \2")
    return sub(x, f"([،؛])([{A.LETTERS}])", r"\1 \2")


def collapse(x: str) -> str:
    x = sub(sub(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(sub(x, f"(?m)^[{A.BLANKS}]+|[{A.BLANKS}]+$", ""))


def clean_text(x: str) -> str:
    return collapse(space_boundaries(reattach(strip_directional(repair_pua(x)))))


def normalize(x: str) -> str:
    of = "\u06cc\u06a9\u0623\u0625\u0622\u0671\u0649"
    to = "\u064a\u0643\u0627\u0627\u0627\u0627\u064a"
    return strip(sub(tr(x, of + "\u0640" + A.MARKS, to), "[ \t]+", " "))


def digits_to_ascii(x: str) -> str:
    return tr(x, A.ARABIC_DIGITS + A.EASTERN_DIGITS, A.ASCII_DIGITS * 2)


def ascii_to_arabic(x: str) -> str:
    return tr(f"CAST({x} AS VARCHAR)", A.ASCII_DIGITS, A.ARABIC_DIGITS)


def format_clause_structure(x: str) -> str:
    harakat = "[\u064b-\u0652\u0670]*"
    x = sub(x, f"\\)\\s*([ء-ي])ـ?{harakat}\\s*\\(", r"(\1)")
    x = sub(x, "\\)\\s*\\(\\s*([0-9٠-٩]+)", r"(\1) ")
    for pattern, after, before in A.clause_steps():
        x = sub(x, "^" + pattern, f"{before}\\1{after}")
        x = sub(x, "([.:؛])" + pattern, f"\\1\n{before}\\2{after}")
    bullet = "\\s*-\\s*([^0-9\\s٠-٩])"
    x = sub(x, "^" + bullet, r"- \1")
    for _ in range(2):  # the sign after one bullet may open the next
        x = sub(x, "([.:؛])" + bullet, "\\1\n- \\2")
    return strip(sub(sub(x, "[ \t]+\n", "\n"), "\n[ \t]+", "\n"))


def repair_glyphs(x: str) -> str:
    items = lambda words: "(" + ", ".join(map(q, words)) + ")"
    token = f"CASE WHEN NOT contains(t, 'آ') OR t IN {items(A.KEEP_MADDA)} THEN t WHEN t IN {items(A.MADDA_TO_ALEF)} THEN replace(t, 'آ', 'ا') ELSE replace(t, 'آ', 'ك') END"
    tokens = f"regexp_extract_all({x}, {q(f'[{A.TOKEN_LETTERS}]+|[^{A.TOKEN_LETTERS}]+')})"
    return f"coalesce(array_to_string(list_transform({tokens}, lambda t: {token}), ''), '')"


def law_name(x: str) -> str:
    x = tr(f"coalesce({x}, '')", "\u0623\u0625\u0622\u0671\u0649\u06cc\u0629\u0640", "\u0627\u0627\u0627\u0627\u064a\u064a\u0647")
    return strip(sub(x, f"[{A.SPACE}]+", " "))


def number_of(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({digits_to_ascii(x)}, '[0-9]+'), '') AS INTEGER)"


def preview(x: str, width: int = 240) -> str:
    s = strip(sub(x, f"[{A.SPACE}]+", " "))
    return f"CASE WHEN length({s}) <= {width} THEN {s} ELSE regexp_extract(substring({s}, 1, {width - 1}), '(?s)^(.*) ', 1) || ' …' END"
