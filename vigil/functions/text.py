"""Column functions over text: portable patterns, trimming, and the six normalisers, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the posts' source counts it (more than Java's \\s): the inside of a character class.
SPACE = "\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_S = f"[{SPACE}]"


def rx(pattern: str, dotall: bool = False) -> str:
    """A pattern that folds case for all letters; \\s stands for SPACE."""
    return f"(?iu{'s' if dotall else ''})" + pattern.replace("\\s", _S)


def plain(pattern: str, dotall: bool = False) -> str:
    """The same pattern for a text that is in lower case already: no folding while matching."""
    return ("(?s)" if dotall else "") + pattern.replace("\\s", _S)


def tidy(c: Column) -> Column:
    """Trimmed, with single blanks inside."""
    return _blanks(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_S}+|{_S}+\\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{_S}+", " ")


def _blanks(c: Column, others: str = "") -> Column:
    """Runs of white space and of the other characters as one blank, none at the edges: one pass, and only blanks are left to trim."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}{others}]+", " "))


def _unquoted(c: Column) -> Column:
    for quote in "\"'`":
        c = F.replace(c, F.lit(quote), F.lit(""))
    return c


def _lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def _alnum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")


def norm_geo(c: Column) -> Column:
    """NRM-1: letters and digits only, single spaces."""
    return F.trim(_alnum(_lower(c)))


def norm_lookup(c: Column) -> Column:
    """NRM-2: trimmed first, so that punctuation at an edge leaves a space."""
    return _alnum(trim(_lower(c)))


def norm_merge(c: Column) -> Column:
    """NRM-3: punctuation stays."""
    return _blanks(_lower(c))


def norm_region(c: Column) -> Column:
    """NRM-4: no quotes, parentheses as spaces."""
    return _blanks(_unquoted(_lower(c)), "()")


def region_haystack(c: Column) -> Column:
    """NRM-4 for the text that is searched: punctuation as spaces too; hyphen and slash stay."""
    return _blanks(_unquoted(_lower(c)), ",;:.!?()\\[\\]{}«»–—−")


def norm_city(c: Column) -> Column:
    """NRM-5: underscores and hyphens as spaces."""
    return _blanks(_unquoted(_lower(c)), "_\\-")


def city_haystack(c: Column) -> Column:
    return _blanks(_unquoted(_lower(c)), r"_\-,;:.!?()\[\]")


def norm_place(c: Column) -> Column:
    """NRM-5 as places are deduplicated: hyphens stay."""
    return _blanks(_unquoted(_lower(c)))


def norm_alias(c: Column) -> Column:
    """NRM-6: lower and trim only."""
    return trim(F.lower(c))


def preview(c: Column, lines: int = 3) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, lines), " | ")
