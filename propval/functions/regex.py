"""Column helpers for text rules.

Rule patterns are written in Python ``re`` syntax (Unicode classes, ``.`` that
stops only at ``\\n``). Java regex gets the same semantics with the ``(?Ud)``
flag group (UNICODE_CHARACTER_CLASS + UNIX_LINES), which every helper adds.
All helpers return native Column expressions: no Python UDF is involved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PY_SEMANTICS = "(?Ud)"

# The characters of Python's str.isspace().
_PY_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
             + "\u2028\u2029\u202f\u205f\u3000")

_ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
_EXT_ARABIC_INDIC = "۰۱۲۳۴۵۶۷۸۹"


_UNICODE_CLASSES = re.compile(r"\\[bBwWsSdD]")
_LINE_SENSITIVE = re.compile(r"(?<!\\)[.^$]")


def java(p: str) -> str:
    """Pattern with Python-like semantics for Java regex.

    UNICODE_CHARACTER_CLASS changes only \\b \\w \\s \\d (and negations) and
    UNIX_LINES only '.', '^' and '$'; each flag is added where the pattern
    uses those constructs, since the Unicode class checks cost match time.
    """
    flags = ("U" if _UNICODE_CLASSES.search(p) else "") + ("d" if _LINE_SENSITIVE.search(p) else "")
    return f"(?{flags}){p}" if flags else p


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_META = set("\\.^$*+?()[]{}|")


def split_alternation(p: str) -> list[str]:
    """Top-level branches of a regex alternation (not inside groups or classes)."""
    parts, cur, depth, in_class, esc = [], [], 0, False, False
    for ch in p:
        if esc:
            cur.append(ch)
            esc = False
            continue
        if ch == "\\":
            cur.append(ch)
            esc = True
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
            continue
        cur.append(ch)
    parts.append("".join(cur))
    return parts


def sql_str(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return sql_str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def required_word(branch: str) -> str:
    """The longest plain text that every match of ``branch`` holds; empty where none is certain.

    Only characters outside of groups, classes and optional or repeated places count.
    """
    if re.search(r"\(\?[^=!<:]|\\[QEux0-9ckpP]|^\?|\[[^\]]*\[", branch) or len(split_alternation(branch)) > 1:
        return ""
    best = cur = ""
    i, depth = 0, 0
    while i < len(branch):
        ch, step, plain = branch[i], 1, False
        if ch == "\\":
            step = 2
            plain = branch[i + 1:i + 2] in _META
            ch = branch[i + 1:i + 2]
        elif ch == "[":
            step = branch.index("]", i + 2) + 1 - i
        elif ch == "{":
            step = branch.index("}", i) + 1 - i
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        else:
            plain = ch not in _META
        i += step
        if plain and not depth and branch[i:i + 1] not in ("?", "*", "{"):
            cur += ch
            if branch[i:i + 1] != "+":
                best = max(best, cur, key=len)
                continue
        best, cur = max(best, cur, key=len), ""
    return best


# Shorter texts occur in most rows, so that looking for them first saves nothing.
MIN_REQUIRED = 3


def _required_words(branches: Sequence[str]) -> list[str]:
    """Words of which every match of the alternation holds one; empty where some branch requires none."""
    found = list(dict.fromkeys(required_word(b) for b in branches))
    return found if all(len(w) >= MIN_REQUIRED for w in found) else []


def has_sql(name: str, p: str) -> str:
    """SQL text of :func:`has` for a named column (built in one expression, no per-call round trips)."""
    branches = split_alternation(p)
    words = [b for b in branches if b and not (set(b) & _META)]
    rest = [b for b in branches if b not in words]
    terms = [f"contains(`{name}`, {sql_str(w)})" for w in words]
    if rest or not terms:
        rx = f"`{name}` RLIKE {sql_str(java('|'.join(rest) if rest else p))}"
        first = " OR ".join(f"contains(`{name}`, {sql_str(w)})" for w in _required_words(rest))
        terms.append(f"(({first}) AND {rx})" if first else rx)
    return f"coalesce(({' OR '.join(terms)}), false)"


def has(c, p: str) -> Column:
    """Boolean 'pattern found anywhere'; NULL input counts as no match.

    Branches of the top-level alternation that are plain words are tested
    with ``contains`` (a byte search); one regex covers the remaining
    branches, and is tried where the text holds a word that one of them
    requires. For a search anywhere in the text this is the same predicate.
    A column given by name is compiled from one SQL expression string.
    """
    if isinstance(c, str):
        return F.expr(has_sql(c, p))
    col = col_of(c)
    branches = split_alternation(p)
    words = [b for b in branches if b and not (set(b) & _META)]
    rest = [b for b in branches if b not in words]
    out = None
    for w in words:
        out = col.contains(w) if out is None else out | col.contains(w)
    if rest or out is None:
        rx = col.rlike(java("|".join(rest) if rest else p))
        required = [col.contains(w) for w in _required_words(rest)]
        if required:
            rx = reduce(Column.__or__, required) & rx
        out = rx if out is None else out | rx
    return F.coalesce(out, F.lit(False))


def flag(c, p: str) -> Column:
    return has(c, p).cast("int")


def count(c, p: str) -> Column:
    """Number of non-overlapping matches (Python ``str.count`` with a regex)."""
    return F.coalesce(F.regexp_count(col_of(c), F.lit(java(p))), F.lit(0))


def extract(c, p: str, group: int = 1) -> Column:
    """First match's group, NULL when there is no match (not the empty string)."""
    return F.nullif(F.regexp_extract(col_of(c), java(p), group), F.lit(""))


def last_wins(c, rules: Sequence[tuple[str, object]], default=None) -> Column:
    """Value of the *last* rule whose pattern matches (sequential overwrites)."""
    if isinstance(c, str):
        whens = " ".join(f"WHEN {has_sql(c, p)} THEN {_sql_value(v)}" for p, v in reversed(list(rules)))
        return F.expr(f"CASE {whens} ELSE {_sql_value(default)} END")
    expr = None
    for pat, value in reversed(list(rules)):
        expr = (F.when(has(c, pat), F.lit(value)) if expr is None
                else expr.when(has(c, pat), F.lit(value)))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def first_wins(c, rules: Sequence[tuple[str, object]], default=None) -> Column:
    """Value of the first rule whose pattern matches."""
    if isinstance(c, str):
        whens = " ".join(f"WHEN {has_sql(c, p)} THEN {_sql_value(v)}" for p, v in rules)
        return F.expr(f"CASE {whens} ELSE {_sql_value(default)} END")
    expr = None
    for pat, value in rules:
        expr = (F.when(has(c, pat), F.lit(value)) if expr is None
                else expr.when(has(c, pat), F.lit(value)))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def literal_alternation(words: Iterable[str]) -> str:
    """One regex matching any of the literal substrings."""
    return "|".join(re.escape(w) for w in words)


def contains_any(c, words: Iterable[str]) -> Column:
    """Substring test for a list of literals (NULL -> False).

    Plain ``contains`` per literal is a byte search on the UTF-8 text, which
    is cheaper than a regex alternation tried at every position.
    """
    words = list(words)
    if not words:
        return F.lit(False)
    if isinstance(c, str):
        return F.expr("coalesce((" + " OR ".join(f"contains(`{c}`, {sql_str(w)})" for w in words) + "), false)")
    col = col_of(c)
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return F.coalesce(out, F.lit(False))


def ascii_digits(c) -> Column:
    """Map Arabic-Indic digits to ASCII, as Python's float()/int() accept them."""
    return F.translate(col_of(c), _ARABIC_INDIC + _EXT_ARABIC_INDIC, "0123456789" * 2)


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace, not just spaces."""
    return F.btrim(col_of(c), F.lit(_PY_SPACE))


def py_round(c, ndigits: int) -> Column:
    """Python ``round(x, n)``: half-even on the exact binary value.

    ``format_number`` formats through java.text.DecimalFormat, which rounds the
    exact binary value half-even, i.e. the same result as CPython.
    """
    s = F.format_number(col_of(c), ndigits)
    return F.regexp_replace(s, ",", "").cast("double")


def py_str(c) -> Column:
    """``str(x)`` of a possibly-missing text value as pandas sees it ('nan')."""
    return F.coalesce(col_of(c), F.lit("nan"))
