"""Corpus cleaning as Spark column expressions (no UDF).

The steps run in a fixed order: strip, entity placeholders, URL mask, then collapse runs of
``...``, ``??`` and ``!!``. Python's ``\\d``/``\\s`` are Unicode-aware, Java's are not, so the
Java patterns carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

UNICODE = "(?U)"

#: The characters of Python's ``\\s``, spelled out: Java's class lacks U+001C..U+001F.
SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in C.PY_WHITESPACE) + "]"


def python_spaces(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE_CLASS)


# The host-name run cannot be followed by its own characters ('.' is outside the class), so giving
# characters back can never produce a match: a possessive run matches the same spans and spares
# Java's backtracking at every letter of every word.
URL_PATTERN_JAVA = C.URL_PATTERN.replace("([a-zA-Z0-9]+)", "([a-zA-Z0-9]++)")
assert URL_PATTERN_JAVA != C.URL_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guarded(c, needles, rewrite) -> Column:
    """Apply ``rewrite`` only where the text holds one of ``needles``.

    Each pattern needs one of these literal substrings to match, so the result is the same; a fast
    substring search spares the regex scan on texts that cannot match.
    """
    x = _col(c)
    hit = None
    for n in needles:
        h = x.contains(n)
        hit = h if hit is None else (hit | h)
    return F.when(hit, rewrite(x)).otherwise(x)


def py_strip(c) -> Column:
    """``str.strip()``: remove Python whitespace (Unicode) from both ends."""
    return F.btrim(_col(c), F.lit(C.PY_WHITESPACE))


def mask_entities(c) -> Column:
    """``@PERSON1`` -> ``{PERSON}`` for the fixed entity tag list."""
    pattern = UNICODE + "@(" + "|".join(C.ENTITY_TAGS) + r")\d+"
    return _guarded(c, ["@"], lambda x: F.regexp_replace(x, pattern, "{$1}"))


def mask_urls(c) -> Column:
    """Host names ending in .com, .com.cn or .org become ``<url>``; the path tail stays."""
    return _guarded(c, [".com", ".org"], lambda x: F.regexp_replace(x, URL_PATTERN_JAVA, C.URL_REPLACEMENT))


def collapse_ellipses(c) -> Column:
    return _guarded(c, ["..."], lambda x: F.regexp_replace(x, python_spaces(C.ELLIPSIS_PATTERN), "..."))


def collapse_questions(c) -> Column:
    return _guarded(c, ["??"], lambda x: F.regexp_replace(x, python_spaces(C.QUESTION_PATTERN), "?"))


def collapse_exclaims(c) -> Column:
    return _guarded(c, ["!!"], lambda x: F.regexp_replace(x, python_spaces(C.EXCLAIM_PATTERN), "!"))


def collapse_punct(c) -> Column:
    return collapse_exclaims(collapse_questions(collapse_ellipses(c)))


CLEAN_STEPS = (py_strip, mask_entities, mask_urls, collapse_ellipses, collapse_questions, collapse_exclaims)


def clean_text(df, src: str, out: str | None = None):
    """DataFrame operator: ``out`` (default: ``src``) = cleaned ``src``."""
    out = out or src
    tmp = f"__clean_{out}"
    d = df.withColumn(tmp, CLEAN_STEPS[0](src))
    for step in CLEAN_STEPS[1:]:
        d = d.withColumn(tmp, step(tmp))
    return d.withColumn(out, F.col(tmp)).drop(tmp)
