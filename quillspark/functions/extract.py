"""Score extraction from free-text completions, as Spark column expressions.

Search semantics: the leftmost match wins; alternation order only breaks ties at one position.
A value outside the domain is null; there is no fall-through to a later match.

Each function returns the *unchecked* value; range checks reference the value twice, so the
operators in ``quillspark.operators.traits`` bind it in its own projection first (Catalyst does not
collapse a projection that would evaluate a regex twice).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import UNICODE, _col


def _match(c, pattern: str) -> Column:
    return F.regexp_extract(_col(c), UNICODE + pattern, 0)


#: Decimal digits of all scripts, and the ASCII digit of each: Python reads both as numbers.
DIGITS = [c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def _to_double(s: Column) -> Column:
    return F.nullif(F.translate(s, "".join(DIGITS), ASCII_DIGITS), F.lit("")).try_cast("double")


def first_number(c, pattern: str = C.TRAIT_SCORE_PATTERN) -> Column:
    """First number inside the leftmost match of ``pattern`` (null if no match)."""
    return _to_double(F.regexp_extract(_match(c, pattern), UNICODE + C.NUMBER_PATTERN, 0))


def fraction_parts(c) -> Column:
    """Numbers of the leftmost fraction match (``Score: a/b``, ``a out of b``, ``a score of a/b``).

    In every alternative the first two numbers of the matched span are numerator and denominator,
    so one regex pass over the text and one over the short span suffice.
    """
    return F.regexp_extract_all(_match(c, C.FRACTION_PATTERN), F.lit(UNICODE + C.NUMBER_PATTERN), 0)


def absolute_integer(c) -> Column:
    """Integer part of the leftmost absolute-score match (``Score: 4.9`` -> 4)."""
    return _to_double(F.regexp_extract(_match(c, C.ABSOLUTE_PATTERN), UNICODE + C.INTEGER_PATTERN, 0))


def category(c) -> Column:
    """low / medium / high from the leftmost category match, lower-cased; null if none."""
    word = F.regexp_extract(_match(c, C.CATEGORY_PATTERN), C.CATEGORY_WORD_PATTERN, 0)
    return F.nullif(F.lower(word), F.lit(""))


def in_range(v, lo, hi) -> Column:
    """``v`` if ``lo <= v <= hi`` else null (null stays null)."""
    v = _col(v)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when((v >= lo) & (v <= hi), v)
