"""Text and lookup expressions."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.constants.parsing import DOTTED_QUAD, PRIVATE_ADDRESS, SEVERITY_RANK

# Every code point that counts as white space when a line is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends; most texts have none, which their end characters tell."""
    ends = (F.ascii(text), F.ascii(F.substring(text, -1, 1)))
    clean = ends[0].between(33, 126) & ends[1].between(33, 126)
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def lookup(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a small constant table, else ``default``."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def severity_rank(severity: Column) -> Column:
    """CRITICAL 4 … INFO 0; anything else 0."""
    return lookup(severity, SEVERITY_RANK, 0)


def contains_any(text: Column, words) -> Column:
    """True if any of the words occurs in ``text`` (plain substring search)."""
    return reduce(lambda left, right: left | right, [text.contains(word) for word in words])


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes; a dot stops only at a newline."""
    return text.rlike(f"(?diU)(?:{pattern})")


def first_address(text: Column) -> Column:
    """First dotted quad in ``text``, else the word ``unknown``."""
    # A look at the next character is cheaper than a word boundary and leaves most places out.
    pattern = DOTTED_QUAD.replace(r"\b", r"(?=\d)\b", 1)
    return F.coalesce(empty_to_null(F.regexp_extract(text, pattern, 1)), F.lit("unknown"))


def is_external(address: Column) -> Column:
    """1 for a routable address, 0 for internal, unknown or empty ones."""
    internal = address.isNull() | address.isin("unknown", "") | address.rlike(PRIVATE_ADDRESS)
    return F.when(internal, 0).otherwise(1)


# Letters that a case-insensitive search treats as "s" and "i" but lower() keeps.
_ODD_LETTERS = ("ſıİ", "sii")

#: A repetition, greedy, lazy or possessive.
_REPEATED = r"(?:(?:[?*+]|\{[^}]*\})[?+]?)"
_ESCAPED_PLAIN = re.compile(r"\\([^\w\s])")


def fold_case(text: Column) -> Column:
    """Lower case such that a plain search finds what a case-insensitive search finds."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, *_ODD_LETTERS)))


def required_literal(pattern: str) -> tuple[str, bool]:
    """Longest plain text every match of ``pattern`` contains, and whether it is the whole pattern.

    Groups, classes and quantified characters end a run; an alternation has no required text.
    """
    # Anything this reading does not cover (nesting, flags, escapes by name or number) has no shortcut.
    if "|" in pattern or "(?" in pattern or re.search(r"\([^)]*\(|\\[ac-rtuvx-zABCE-RT-VX-Z0-9]", pattern.replace(r"\d", "")):
        return "", False
    plain = _ESCAPED_PLAIN.sub(lambda m: f"\0{m.group(1)}", pattern)
    # Classes before groups, as a class may hold parentheses; "\0" marks a plain character.
    text = re.sub(rf"(?<!\0)\[\^?\]?(?:\0.|[^\]\0])*\]{_REPEATED}?", "\n", plain)
    text = re.sub(rf"(?<!\0)\((?:\0.|[^)\0])*\){_REPEATED}?", "\n", text)
    text = re.sub(rf"(?<!\0)\\.{_REPEATED}?", "\n", text)
    text = re.sub(r"(\0?[^\n\0])\+[?+]?", r"\1\n", text)
    text = re.sub(rf"\0?[^\n\0]{_REPEATED}|(?<!\0)[.^$]", "\n", text)
    runs = [run.replace("\0", "") for run in text.split("\n")]
    best = max(runs, key=len)
    return best, best == plain.replace("\0", "")


# Characters of folded log text, the most frequent first; all others are rarer.
_FREQUENT = " 0123456e78a9ionrst.-:dlcup/hm\"gfw,=ybv"
# Shorter texts are in too many rows to rule any out.
_SHORTEST = 3


def rarest_suffix(literal: str) -> str:
    """The end of ``literal`` that starts with its rarest character; three characters at least, or all of it."""

    def rarity(start: int) -> int:
        place = _FREQUENT.find(literal[start])
        return len(_FREQUENT) if place < 0 else place

    starts = range(max(len(literal) - _SHORTEST, 0) + 1)
    return literal[max(starts, key=rarity):] if literal else literal


def plain_search(folded: Column, literal: str) -> Column:
    """``folded.contains(literal)``, but asks first for the end of ``literal`` that starts with its rarest character.

    A search compares at every place that has the first character, which is most of its cost: a frequent
    one costs several times a rare one.
    """
    rare = rarest_suffix(literal)
    found = folded.contains(rare)
    return found if rare == literal else found & folded.contains(literal)


def search(text: Column, folded: Column, pattern: str) -> Column:
    """``matches(text, pattern)``, but tries the pattern's required text on ``folded`` first.

    ``folded`` is ``fold_case(text)``. A plain search costs about a tenth of a regular expression,
    and most patterns are absent from most rows.
    """
    literal, is_whole = required_literal(pattern)
    if is_whole:
        return plain_search(folded, literal.lower())
    if literal:
        return plain_search(folded, literal.lower()) & matches(text, pattern)
    return matches(text, pattern)
