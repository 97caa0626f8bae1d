"""Text functions as column expressions. Positions and lengths count code points; blanks are Unicode's, with U+001C-001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[\\s\\x1C-\\x1F]"
# Code points that normalisation folds, and those that it drops.
FOLD_FROM = "\u0670\u0622\u0623\u0625\u0629\u0649"
FOLD_TO = "\u0627\u0627\u0627\u0627\u0647\u064a"
DROPPED = "[\u064b-\u065f\u06d6-\u06dc]"
# Digits of a verse marker.
DIGITS = "[\u0660-\u0669\u06f0-\u06f9]"
MARKER = f"\\A{DIGITS}+\\z"
# How spelled-out letter names begin.
LETTER_NAMES = ["\u0621\u064e\u0644\u0650\u0641", "\u0644\u064e\u0627\u0627", "\u0645\u0650\u06e6", "\u0645\u0645\u0645", "\u0631\u064e\u0627\u0627", "\u0635\u064e\u0627\u0627", "\u0637\u064e\u0627\u0627", "\u0647\u064e\u0627\u0627", "\u0633\u0650\u06e6", "\u064a\u064e\u0627\u0627", "\u062d\u064e\u0627\u0627", "\u0639\u064e\u064a\u064a", "\u0642\u064e\u0627\u0627", "\u0646\u064f\u06e5", "\u0643\u064e\u0627\u0627"]
# Letters of short opening words, and the two signs that mark one by themselves.
OPENING_LETTERS = "[\u0627\u062d\u0631\u0633\u0635\u0637\u0639\u0642\u0643\u0644\u0645\u0646\u0647\u064a\u0653\u06da]*"
OPENING_SIGNS = "[\u0653\u06da]"


def normalize(c: Column) -> Column:
    """Folds letter variants and drops vowel and recitation signs."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), DROPPED, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{BLANK}+|{BLANK}+\\z", "")


def tokens(c: Column) -> Column:
    """Words between blanks; no empty ones."""
    return F.regexp_extract_all(c, F.lit("(?U)[^\\s\\x1C-\\x1F]+"), F.lit(0))


def is_marker(c: Column) -> Column:
    """Whether nothing but digits is left once the text is stripped; one anchored pattern, which most words fail at their first sign."""
    return F.coalesce(c.rlike(f"(?U)\\A{BLANK}*{DIGITS}+{BLANK}*\\z"), F.lit(False))


def has_sign(c: Column) -> Column:
    """Whether anything is left of a text once it is stripped."""
    return c.rlike("(?U)[^\\s\\x1C-\\x1F]")


def is_opening(c: Column) -> Column:
    """Whether a chapter's first word may be one of the spelled-out openings."""
    return c.rlike(OPENING_SIGNS) | ((F.length(c) <= 6) & c.rlike(f"\\A{OPENING_LETTERS}\\z"))


def has_prefix(c: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(c, p))


def chars(c: Column) -> Column:
    """Characters as an array; none for an empty text."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def find(text: Column, part: Column, start: Column) -> Column:
    """0-based place of part from start on, -1 if there is none."""
    return F.when(part == "", F.when(start <= F.length(text), start).otherwise(-1)).otherwise(F.call_function("locate", part, text, start + 1) - 1)


def key_parts(c: Column, n: int) -> tuple[Column, list[Column]]:
    """A test that a `:`-joined key has n parts, and the parts as integers (a part that isn't a number raises)."""
    parts = F.split(c, ":", -1)
    return F.size(parts) == n, [parts[i].cast("int") for i in range(n)]


def merge_leading(toks: Column, prefixes: list[str]) -> Column:
    """Leading tokens that begin with a prefix become one word, if there are two or more; the rest follows, by blanks."""
    flags = F.transform(toks, lambda t: has_prefix(t, prefixes))
    first = F.array_position(flags, F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.size(toks)).cast("int")
    head = F.array_join(F.slice(toks, 1, F.greatest(n, F.lit(0))), "")
    rest = F.slice(toks, n + 1, F.greatest(F.size(toks), F.lit(1)))
    return F.when(n <= 1, F.array_join(toks, " ")).otherwise(F.array_join(F.concat(F.array(head), rest), " "))
