"""Counts over the words, lines and characters of one text, for the quality operators."""

from __future__ import annotations

from collections import Counter

SYMBOLS = b"#*$%&|<>"
UPPERCASE, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"
#: Bytes that begin no character of a word: white space, and bytes that go on with a character.
NOT_CHARS = bytes([32, *range(9, 14), *range(128, 192)])

#: Name and meaning of each count; words are runs of anything but space and \\x09-\\x0D, as ``bytes.split`` cuts them.
COUNTS = (
    "n_words",
    "word_chars",  # characters in words
    "n_symbols",  # characters of SYMBOLS
    "n_lines",  # \\n-split lines with a word
    "n_dup_lines",  # of these, lines equal to an earlier line
    "n_repeat_words",  # words in 3-word windows that the text has twice or more
    "n_distinct",  # distinct words
    "n_upper",  # A-Z
    "n_digits",  # 0-9
    "n_marks",  # characters of MARKS
    "n_runs",  # words equal to the word before
    "n_bare",  # words without a letter or digit (no byte of 0-9, A-Z, a-z or beyond ASCII)
)
BARE = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more, their first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def count(text: bytes, repeats: bool = True) -> tuple[int, ...]:
    """The counts of COUNTS, in order; without ``repeats``, the dearest one, n_repeat_words, is 0."""
    n, words = len(text), text.split()
    without = lambda chars: n - len(text.translate(None, chars))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    distinct = set(words)
    bare = {w for w in distinct if w.translate(None, BARE) == w}
    return (
        len(words), len(text.translate(None, NOT_CHARS)), without(SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat_words(words) if repeats else 0,
        len(distinct), without(UPPERCASE), without(DIGITS), without(MARKS), sum(map(bytes.__eq__, words, words[1:])),
        sum(map(bare.__contains__, words)) if bare else 0,
    )
