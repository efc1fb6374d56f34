"""Scoring configuration.

Dataset differences (score domains, label sets, extraction patterns, chat formats) are plain
values here, so one operator implementation serves every corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Fixed values. These must stay equal to the published scoring setup for results to agree.
# ---------------------------------------------------------------------------------------------

# Score domain per prompt of the rated-essay corpus: prompt_id -> (s_min, s_max).
ASAP_SCORE_RANGES = {1: (2, 12), 2: (1, 6), 3: (0, 3), 4: (0, 3), 5: (0, 4), 6: (0, 4), 7: (0, 30), 8: (0, 60)}

# Score domain shared by every prompt of the proficiency corpus.
TOEFL_SCORE_RANGE = (1, 5)

# Ordered proficiency labels and the bucket edges on the mapped score: < 2.25 low, < 3.75 medium.
LEVEL_LABELS = ("low", "medium", "high")
LEVEL_EDGES = (2.25, 3.75)

# Domain of a trait score read from a completion.
TRAIT_DOMAIN = (0, 10)

# Outlier fences: q1 - 1.5 iqr and q3 + 1.5 iqr.
IQR_WIDTH = 1.5

# Number of traits scored per essay.
N_TRAITS = 4

# Point fix of one record's missing overall score in the rated corpus: (essay_id, score).
ASAP_SCORE_OVERRIDES = ((10534, 3.0),)

# Prompt whose overall score is recomputed from the raters' trait scores (trait 1 counts twice).
RESCORED_PROMPT = 7

# Entity tags of anonymised essays: @PERSON1 -> {PERSON}.
ENTITY_TAGS = (
    "PERSON", "ORGANIZATION", "LOCATION", "DATE", "TIME", "MONEY", "PERCENT", "MONTH",
    "EMAIL", "NUM", "CAPS", "DR", "CITY", "STATE",
)
URL_REPLACEMENT = "<url>"

# Regular expressions (Python / Java syntax; `\d`, `\s` are made Unicode-aware in Spark).
URL_PATTERN = r"(http[s]?://)?((www)\.)?([a-zA-Z0-9]+)\.{1}((com)(\.(cn))?|(org))"
ELLIPSIS_PATTERN = r"\.{3,}(\s+\.{3,})*"
QUESTION_PATTERN = r"\?{2,}(\s+\?{2,})*"
EXCLAIM_PATTERN = r"\!{2,}(\s+\!{2,})*"

# Trait-score pattern (first number of the leftmost match is the score).
TRAIT_SCORE_PATTERN = (
    r"[sS]core: \d+\.?\d*|score of \d+\.?\d*/?\d*\.?\d*|\d+\.?\d* out of \d+\.?\d*"
    r"|as a \d+\.?\d*|at \d+\.?\d*|Score: <score>\d+\.?\d*</score>"
)
# Same with the extra alternative seen in the proficiency corpus.
TRAIT_SCORE_PATTERN_ALT = TRAIT_SCORE_PATTERN + r"|Score: <7>\d+\.?\d*</score>"
NUMBER_PATTERN = r"\d+\.?\d*"

# Overall-score patterns: a fraction (3 alternatives of numerator/denominator), else an absolute score.
FRACTION_PATTERN = (
    r"Score:\n* *(\d+\.?\d*)/(\d+\.?\d*)|(\d+\.?\d*) out of (\d+\.?\d*)|a score of (\d+\.?\d*)/(\d+\.?\d*)"
)
ABSOLUTE_PATTERN = r"Score:\n* *\d+\.?\d*|<score>\d+\.?\d*</score>"
INTEGER_PATTERN = r"\d+"

# Category pattern; the label is the first of low/medium/high in the match, lower-cased.
CATEGORY_PATTERN = (
    r'(Score:|score of|as)[\n ]*"? *([Ll]ow|[Mm]edium|[Hh]igh) *"?|([Ll]ow|[Mm]edium|[Hh]igh) score'
)
CATEGORY_WORD_PATTERN = r"[Ll]ow|[Mm]edium|[Hh]igh"

# Single-turn and two-turn chat prompts with their placeholders.
SINGLE_TURN_TEMPLATE = "[INST] <<SYS>>\n@msg_system\n<</SYS>>\n\n@msg_user_instruction [/INST]"
RETRIEVAL_TEMPLATE = "<s>[INST] <<SYS>>\n@msg_system\n<</SYS>>\n\n@msg_user_retrieval [/INST]"
TWO_TURN_TEMPLATE = (
    "<s>[INST] <<SYS>>\n@msg_system\n<</SYS>>\n\n@msg_user_retrieval [/INST] @msg_assistant_retrieval "
    "</s></s>[INST] @msg_user_score [/INST]"
)

# Sampling defaults.
SAMPLE_FRACTION = 0.1
SAMPLE_SEED = 41
SAMPLE_N = 4

# Two-sided 5% critical value of the standard normal.
Z_CRITICAL_05 = 1.959963984540054

# Characters Python's str.strip() removes: exactly those for which str.isspace() is true.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoreDomain:
    """Where scores live for one corpus.

    ``ranges`` maps prompt_id -> (s_min, s_max); ``default`` applies to prompts not listed.
    ``labels`` (ordered) turns the domain into an ordinal label set instead of integers.
    """

    ranges: dict = field(default_factory=dict)
    default: tuple | None = None
    labels: tuple | None = None

    def key(self):
        """Hashable identity of the domain."""
        return tuple(self.range_rows()), self.default, self.labels

    def range_rows(self):
        """``(prompt_id, s_min, s_max)`` of the listed prompts."""
        return [(int(pid), int(lo), int(hi)) for pid, (lo, hi) in self.ranges.items()]


ASAP = ScoreDomain(ranges=dict(ASAP_SCORE_RANGES))
TOEFL = ScoreDomain(default=TOEFL_SCORE_RANGE, labels=LEVEL_LABELS)
