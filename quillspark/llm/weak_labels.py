"""Quality classifier from weak labels (operator 3).

Heuristic labellers vote good, bad or nothing on each document. All documents' votes are counted by pattern (a bounded
table, three to the number of labellers), and expectation-maximisation on those counts estimates how often each labeller
votes what on good documents and on each latent kind of fault. The posteriors of a bounded sample then train a linear scorer over hashed words
and hashed buckets of text statistics, and the scorer judges every document.

The scorer is fitted on at most ``SAMPLE`` documents (smallest hash of id and text); the accuracies on all.

Defined results: a null text counts as empty; where no labeller votes, the posterior is the estimated share of good
documents. A document is kept if its score is at least ``KEEP``. Repeated rows are judged alike. Other columns are kept
as they are by :func:`keep_good`. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_stats
from .common import LOWER_TABLE, documents, map_batches, text_bytes

SAMPLE, WIDTH, KEEP = 4_000, 1 << 13, 0.4
GOOD, BAD, NONE = 1, 0, 2


def ratios(counts: tuple[int, ...]) -> dict[str, float]:
    c = dict(zip(text_stats.COUNTS, counts))
    chars, words, lines = max(c["word_chars"], 1), max(c["n_words"], 1), max(c["n_lines"], 1)
    return {
        "symbols": c["n_symbols"] / chars,
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "marks": c["n_marks"] / chars,
        "length": c["word_chars"] / words,
        "copies": c["n_dup_lines"] / lines,
        "distinct": c["n_distinct"] / words * math.sqrt(words) / 10,  # long texts repeat words
        "runs": c["n_runs"] / words,
        "bare": c["n_bare"] / words,
        "line": c["n_words"] / lines,
        "words": float(c["n_words"]),
    }


def _vote(name: str, bad_from: float | None, bad_to: float | None, good: tuple[float, float] | None = None, least: int = 1):
    """Votes bad at or beyond ``bad_from`` (below) or ``bad_to`` (above), good inside ``good`` if given, else nothing;
    nothing on texts of fewer than ``least`` words, whose ratios say little."""
    def vote(r: dict[str, float]) -> int:
        x = r[name]
        if r["words"] < least:
            return NONE
        if bad_from is not None and x <= bad_from or bad_to is not None and x >= bad_to:
            return BAD
        return GOOD if good and good[0] <= x <= good[1] else NONE

    return vote


#: Labellers by name. Most know one fault and say nothing without it; some also know the shape of running prose.
LABELLERS = {
    "symbols": _vote("symbols", None, 0.06),
    "bare": _vote("bare", None, 0.2),
    "upper": _vote("upper", None, 0.5),
    "runs": _vote("runs", None, 0.15, least=10),
    "distinct": _vote("distinct", 0.12, None, least=50),
    "copies": _vote("copies", None, 0.5, least=30),
    "digits": _vote("digits", None, 0.3, least=20),
    "marks": _vote("marks", None, 0.2, (0.003, 0.1), least=20),
    "length": _vote("length", 2.2, 14.0, (3.2, 9.0)),
    "line": _vote("line", 1.5, None, (6.0, 400.0), least=20),
}
#: Bucket edges of the statistics that the scorer sees.
EDGES = {
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.12, 0.25), "bare": (0.01, 0.05, 0.15, 0.3), "upper": (0.002, 0.05, 0.15, 0.3, 0.5, 0.8),
    "marks": (0.003, 0.02, 0.06, 0.1, 0.2, 0.35), "runs": (0.005, 0.03, 0.1, 0.3), "distinct": (0.12, 0.25, 0.35, 0.6),
    "length": (2.2, 3.2, 4.5, 6.0, 9.0, 14.0), "digits": (0.01, 0.05, 0.15, 0.3), "copies": (0.05, 0.2, 0.5), "line": (1.5, 4.0, 8.0, 40.0, 400.0),
}


def slot(token: bytes) -> int:
    return crc32(token) & (WIDTH - 1)


def buckets(r: dict[str, float]) -> list[int]:
    return [slot(f"\x00{name}:{bisect(edges, r[name])}".encode()) for name, edges in EDGES.items()]


def pattern(r: dict[str, float]) -> int:
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(r)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """A row of votes for each pattern number."""
    k = len(LABELLERS)
    return patterns[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


#: Pseudo-votes (bad, good, none) that each share starts from, on good documents and on documents with a fault.
PRIOR_GOOD, PRIOR_BAD = np.array([0.05, 1.0, 1.0]), np.array([0.5, 0.5, 0.5])
#: Most kinds of fault that are told apart.
MOST_FAULTS = 6
#: Share of bad votes on good documents of a labeller whose share needs no estimate of its own: where the votes can't tell a
#: fault from a false alarm, alarms are believed until the votes as a whole speak against them.
USUAL_ERROR = 1e-3


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, for each labeller, how often it votes bad, good and nothing on good documents; the same
    for each kind of fault. Kinds of fault are latent classes: within one, labellers vote independently. A labeller that
    knows only a fault says something by its silence; one that knows good as well abstains, and shares are of its votes."""

    good: float
    on_good: np.ndarray  # a row for each labeller: shares of bad, good, no vote
    kinds: np.ndarray  # share of documents with each kind of fault
    on_kind: np.ndarray  # by kind, labeller, vote
    abstains: np.ndarray  # of each labeller: is silence no evidence

    @property
    def on_bad(self) -> np.ndarray:
        """Shares of votes on documents with any fault."""
        return np.tensordot(self.kinds / self.kinds.sum(), self.on_kind, 1)

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Logarithms of share times likelihood, by row of votes, for good and each kind of fault."""
        rates = np.log(np.concatenate([self.on_good[None], self.on_kind]))
        rates[:, self.abstains, NONE] = 0.0
        each = rates[:, np.arange(votes.shape[1]), votes].sum(2)
        return (np.log(np.concatenate([[self.good], self.kinds]))[:, None] + each).T

    def responsibilities(self, votes: np.ndarray) -> np.ndarray:
        j = self.joint(votes)
        j = np.exp(j - j.max(1, keepdims=True))
        return j / j.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.responsibilities(votes)[:, 0] if len(votes) else np.zeros(0)

    def fit_of(self, votes: np.ndarray, counts: np.ndarray) -> float:
        """Logarithm of the likelihood of all votes."""
        j = self.joint(votes)
        top = j.max(1)
        return float((counts * (top + np.log(np.exp(j - top[:, None]).sum(1)))).sum())


def _estimate(votes: np.ndarray, counts: np.ndarray, share: np.ndarray, wrong: np.ndarray) -> LabelModel:
    """Shares of classes and votes from the share of each pattern in each class (the M step); the labellers ``wrong`` have
    their share of bad votes on good documents estimated."""
    weight = share * counts[:, None]
    abstains = (votes == GOOD).any(0)
    by_vote = np.stack([np.einsum("pc,pk->ck", weight, votes == v) for v in (BAD, GOOD, NONE)], 2)
    by_vote[:, abstains, NONE] = 0.0
    by_vote += np.concatenate([PRIOR_GOOD[None], np.tile(PRIOR_BAD, (share.shape[1] - 1, 1))])[:, None, :]
    rates = by_vote / by_vote.sum(2, keepdims=True)
    rates[0, ~wrong] *= ((1 - USUAL_ERROR) / (1 - rates[0, ~wrong, BAD]))[:, None]
    rates[0, ~wrong, BAD] = USUAL_ERROR
    of = weight.sum(0) + np.concatenate([[8.0], np.full(share.shape[1] - 1, 2.0 / (share.shape[1] - 1))])
    of /= of.sum()
    return LabelModel(float(of[0]), rates[0], of[1:], rates[1:], abstains)


def _first_guess(votes: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """Patterns with an alarm go to the nearest of ``kinds`` frequent sets of alarms, others are called good."""
    alarms = votes == BAD
    some = alarms.any(1)
    sets, at = np.unique(alarms[some], axis=0, return_inverse=True)
    often = np.bincount(at.ravel(), counts[some], minlength=len(sets))
    seeds = [int(often.argmax())]
    while len(seeds) < min(kinds, len(sets)):
        away = (sets[:, None, :] != sets[seeds][None]).mean(2).min(1)
        seeds.append(int((often * away).argmax()))
    share = np.full((len(votes), kinds + 1), 0.05 / kinds)
    share[~some, 0] = 0.95
    share[some, 0] = 0.05
    nearest = (sets[at.ravel()][:, None, :] != sets[seeds][None]).mean(2).argmin(1)
    share[np.flatnonzero(some), 1 + nearest] = 0.95
    return share / share.sum(1, keepdims=True)


def _expect(votes: np.ndarray, counts: np.ndarray, share: np.ndarray, wrong: np.ndarray, rounds: int) -> tuple[float, LabelModel]:
    """EM from the given shares of classes: the Bayesian information criterion of the model found, and the model."""
    model = _estimate(votes, counts, share, wrong)
    for _ in range(rounds):
        new = _estimate(votes, counts, model.responsibilities(votes), wrong)
        change = abs(new.good - model.good) + np.abs(new.on_good - model.on_good).max() + np.abs(new.on_kind - model.on_kind).max()
        model = new
        if change < 1e-6:
            break
    free = votes.shape[1] * (1 + 2 * len(model.kinds)) + wrong.sum() + len(model.kinds)
    return -2 * model.fit_of(votes, counts) + free * math.log(counts.sum()), model


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 300, most_kinds: int = MOST_FAULTS) -> LabelModel:
    """Expectation-maximisation over vote patterns weighted by their counts: shares of bad, good and no votes of each
    labeller in each class, from a few pseudo-votes each.

    It starts with one kind of fault and all labellers rarely wrong. As long as the Bayesian information criterion falls, the
    better of two steps is taken: one more kind (faults that exclude each other fit one kind badly), or one more labeller
    whose errors on good documents are estimated. So a labeller that often cries where all others see nothing is found to
    be wrong, while alarms that the kinds of fault explain are believed.
    """
    nobody = np.zeros(votes.shape[1], bool)
    if not counts.sum() or not (votes == BAD).any():
        return _estimate(votes, counts, np.tile([0.95, 0.05], (len(votes), 1)), nobody)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    n = np.bincount(at.ravel(), counts, minlength=len(patterns))
    kinds, wrong = 1, nobody
    cost, model = _expect(patterns, n, _first_guess(patterns, n, kinds), wrong, rounds)
    while True:
        steps = []
        for j in np.flatnonzero(~wrong & (patterns == BAD).any(0)):
            also = wrong | (np.arange(len(wrong)) == j)
            calm = model.responsibilities(patterns)
            alone = (patterns[:, j] == BAD) & ((patterns == BAD).sum(1) == 1)
            calm[alone] = np.concatenate([[0.5], np.full(len(model.kinds), 0.5 / len(model.kinds))])
            steps.append((*_expect(patterns, n, calm, also, rounds), kinds, also))
        if kinds < most_kinds:
            steps.append((*_expect(patterns, n, _first_guess(patterns, n, kinds + 1), wrong, rounds), kinds + 1, wrong))
        best = min(steps, key=lambda s: s[0], default=None)
        if best is None or best[0] >= cost:
            return model
        cost, model, kinds, wrong = best


@dataclass(frozen=True)
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit_scorer(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by AdaGrad over all rows; ``rows, slots, values`` are the nonzero features."""
    weights, bias = np.zeros(WIDTH), 0.0
    sums, bias_sum = np.full(WIDTH, 1e-6), 1e-6
    n = max(len(target), 1)
    for _ in range(rounds):
        z = np.bincount(rows, values * weights[slots], minlength=len(target)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        slope = np.bincount(slots, values * error[rows], minlength=WIDTH) / n + decay * weights / n
        sums += slope**2
        bias_sum += error.mean() ** 2
        weights -= 0.3 * slope / np.sqrt(sums)
        bias -= 0.3 * error.mean() / math.sqrt(bias_sum)
    return weights, bias


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("h"), text_bytes().alias("text"))


def pattern_counts(docs: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> list:
            seen = Counter(pattern(ratios(text_stats.count(t, repeats=False))) for t in batch.column("text").to_pylist())
            return [list(seen), list(seen.values())]

        return work

    return map_batches(_texts(docs).select("text"), "pattern long, n long", make).groupBy("pattern").agg(F.sum("n").alias("n"))


def sample_features(docs: DataFrame, total: int, most: int) -> DataFrame:
    """``h, pattern, slots, values`` of at most ``most`` documents."""
    space = 1 << 40
    cut = space if total <= most else math.ceil(space * 1.2 * most / total)
    picked = _texts(docs).where(F.pmod("h", F.lit(space)) < cut)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = [[], [], []]
            for text in batch.column("text").to_pylist():
                r = ratios(text_stats.count(text, repeats=False))
                words = text.translate(LOWER_TABLE).split()
                found = Counter(map(slot, words))
                got = {s: c / len(words) for s, c in found.items()}
                for s in buckets(r):
                    got[s] = got.get(s, 0.0) + 1.0
                for column, x in zip(out, (pattern(r), list(got), list(got.values()))):
                    column.append(x)
            return [batch.column("h"), *out]

        return work

    return map_batches(picked, "h long, pattern long, slots array<int>, values array<float>", make).orderBy(F.pmod("h", F.lit(space)), "pattern").limit(most)


def fit(docs: DataFrame, most: int = SAMPLE) -> Scorer:
    counted = pattern_counts(docs).toArrow()  # at most 3 ** len(LABELLERS) rows
    patterns, counts = counted["pattern"].to_numpy(), counted["n"].to_numpy()
    labels = fit_labels(votes_of(patterns), counts)
    sample = sample_features(docs, int(counts.sum()) if len(counts) else 0, most).toArrow()
    if not len(sample):
        return Scorer(labels, np.zeros(WIDTH), 0.0)
    slots = sample["slots"].combine_chunks()
    rows = np.repeat(np.arange(len(sample)), slots.value_lengths().to_numpy())
    target = labels.posterior(votes_of(sample["pattern"].to_numpy()))
    weights, bias = fit_scorer(rows, slots.flatten().to_numpy(), sample["values"].combine_chunks().flatten().to_numpy().astype(float), target)
    return Scorer(labels, weights, bias)


class WordWeights(dict):
    """Weight of each word met, by its slot."""

    def __init__(self, weights: list[float]) -> None:
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 100_000:
            self.clear()
        w = self[word] = self.weights[slot(word)]
        return w


def judge(scorer: Scorer):
    """A function from a text to ``(pattern, score)``."""
    weights = scorer.weights.tolist()
    known = WordWeights(weights)

    def run(text: bytes) -> tuple[int, float]:
        r = ratios(text_stats.count(text, repeats=False))
        words = text.translate(LOWER_TABLE).split()
        z = scorer.bias + sum(weights[s] for s in buckets(r)) + (math.fsum(map(known.__getitem__, words)) / len(words) if words else 0.0)
        return pattern(r), 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    return run


def classify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, posterior, score, kept`` of every row."""
    def make():
        run = judge(scorer)

        def work(batch: pa.RecordBatch) -> list:
            got = [run(t) for t in batch.column("text").to_pylist()]
            posterior = scorer.labels.posterior(votes_of(np.array([p for p, _ in got], np.int64))) if got else []
            return [batch.column("doc_id"), list(posterior), [s for _, s in got], [s >= KEEP for _, s in got]]

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_batches(rows, "doc_id long, posterior double, score double, kept boolean", make)


def keep_good(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    scorer = scorer or fit(docs)

    def run(batches):
        one = judge(scorer)
        for batch in batches:
            yield batch.filter(pa.array([one((t or "").encode("utf-8", "surrogatepass"))[1] >= KEEP for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs))
