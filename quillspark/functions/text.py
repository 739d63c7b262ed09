"""Column builders shared by the operators. Patterns are written with ASCII word boundaries, as JavaScript and RE2
have them; Java's are Unicode-aware, so ``pattern`` spells them out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _begins_with_word(parsed) -> bool:
    """Whether all that a parsed pattern matches begins with a letter, digit or underscore of ASCII."""
    word = lambda n: n < 128 and (chr(n).isalnum() or n == 95)
    for op, of in parsed:
        name = str(op)
        if name == "LITERAL":
            return word(of)
        if name == "IN":
            return all(str(o) == "LITERAL" and word(x) or str(o) == "RANGE" and all(map(word, range(x[0], x[1] + 1))) or str(o) == "CATEGORY" and str(x) in ("CATEGORY_DIGIT", "CATEGORY_WORD") for o, x in of)
        if name == "BRANCH":
            return all(map(_begins_with_word, of[1]))
        if name == "SUBPATTERN":
            return _begins_with_word(of[-1])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            if not _begins_with_word(of[2]):
                return False
            if of[0]:
                return True
            continue  # may be left out, and what follows begins the match then
        return False
    return False


def _parsed(p: str):
    """The parts of a pattern as Python reads it, or none where Python doesn't know it."""
    try:
        return list(re._parser.parse(p))
    except re.error:
        return []


@cache
def spelled(p: str) -> str:
    """The pattern with its word borders spelled out. A border that begins it, before what begins with a word's letter,
    needs to look back only, which is tried at every place of a text."""
    if p.isascii() and p.startswith(r"\b") and _begins_with_word(_parsed(p[2:])):
        return r"(?<!\w)" + p[2:].replace(r"\b", BOUNDARY)
    return p.replace(r"\b", BOUNDARY)


@cache
def needed(p: str) -> str | None:
    """A sign, neither letter nor digit, that is in all that the pattern matches; texts without it needn't be searched."""
    for op, of in _parsed(p):
        if str(op) == "LITERAL" and chr(of) in "@%=|#°":
            return chr(of)
    return None


def pattern(p: str, ignore_case: bool = False) -> str:
    """A pattern for Java; letters beyond ASCII are folded only where the pattern has some."""
    return ("(?i)" if p.isascii() else "(?iu)") * ignore_case + spelled(p)


def has(c: Column, p: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(pattern(p, ignore_case)), F.lit(False))


def has_any(c: Column, ps: Iterable[str], ignore_case: bool = True) -> Column:
    """Whether some pattern matches, in one scan (two, where some have letters beyond ASCII)."""
    ps, out = list(ps), F.lit(False)
    for some in ([p for p in ps if p.isascii()], [p for p in ps if not p.isascii()]):
        if some:
            back = all(spelled(p).startswith(r"(?<!\w)") for p in some)  # what all begin with stands before them once
            every = "|".join(f"(?:{spelled(p)[7 * back:]})" for p in some)
            flags = ("(?i)" if some[0].isascii() else "(?iu)") * ignore_case
            out = out | F.coalesce(c.rlike(flags + (f"(?<!\\w)(?:{every})" if back else every)), F.lit(False))
    return out


def hits(c: Column, ps: Iterable[str]) -> Column:
    """How many of the patterns match."""
    return sum((has(c, p).cast("int") for p in ps), F.lit(0))


def find_all(c: Column, p: str, group: int = 0, ignore_case: bool = True) -> Column:
    none = F.array().cast("array<string>")
    found = F.coalesce(F.regexp_extract_all(c, F.lit(pattern(p, ignore_case)), F.lit(group)), none)
    return F.when(F.contains(c, F.lit(sign)), found).otherwise(none) if (sign := needed(p)) else found


def count_of(c: Column, p: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern(p))), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lines(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: inside a lambda an expression from outside is computed for every element."""
    return F.transform(F.array(c), f)[0]


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def cascade(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)
