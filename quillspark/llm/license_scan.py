"""Licence scans by template matching (operator 2).

Licence texts are templates with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;min=a;max=b>>`` stands for a to b words of any kind, ``<<var;match=x|y>>`` for one of the wordings listed
(``license_texts``: whole licence texts and notices, and names). All templates are compiled into one automaton over word
tokens; a place is accepted where every mandatory word follows exactly. Transitions between sets of states are worked
out when first met and remembered, so each start costs one table step per word until no state is left.

Defined results: a null text has no words, no labels and score 0; repeated rows give repeated results; other columns are
ignored; an empty table gives an empty table. Overlapping places count one by one, but of the method's own templates that
begin at one word only the longest counts (ties: all), so that "cc by nc sa" isn't also "cc by nc". ``score`` is the share
of a text's words that lie inside accepted places; ``text_labels`` are the labels of whole texts and notices alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, documents, map_batches, text_bytes
from .license_texts import names, texts


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  # a phrase of the contract, counted place by place
    whole: bool = False  # a whole licence text or notice, not just a name


TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    *(Template(label, text) for label, text in names()),
    *(Template(label, text, whole=True) for label, text in texts()),
)

MARK = re.compile(r"<<(.*?)>>")
#: Sets of states that are remembered before the table starts anew.
MOST_SETS = 20_000


class Automaton:
    """All templates as one automaton; ``places`` gives ``(template, start, end)`` of each accepted place."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.templates = templates
        self.on: list[dict[bytes | None, int]] = []  # word, or None for any, to state
        self.skip: list[list[int]] = []  # states reached without a word
        self.done: dict[int, int] = {}
        first = [self._chain(k, t.text) for k, t in enumerate(templates)]
        self.begin = self._closed(first)
        self.firsts = frozenset(w for s in self.begin for w in self.on[s] if w is not None)
        if any(None in self.on[s] for s in self.begin) or any(s in self.done for s in self.begin):
            raise ValueError("a template must begin with a mandatory or optional word and can't be empty")
        self._forget()

    def _state(self) -> int:
        self.on.append({})
        self.skip.append([])
        return len(self.on) - 1

    def _chain(self, k: int, text: str) -> int:
        first = at = self._state()
        opened: list[int] = []
        for i, part in enumerate(MARK.split(text)):
            if i % 2 == 0:
                for word in part.encode().translate(ALNUM_TABLE).split():
                    at = self._arc(at, word)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                self.skip[opened.pop()].append(at := self._joined(at))
            else:
                options = dict(x.split("=") for x in part.split(";")[1:] if "=" in x)
                if "match" in options:
                    at = self._one_of(at, options["match"].split("|"))
                    continue
                least, most = int(options["min"]), int(options["max"])
                ends = [at] if least == 0 else []
                for n in range(1, most + 1):
                    at = self._arc(at, None)
                    ends += [at] if n >= least else []
                end = self._state()
                for s in ends:
                    self.skip[s].append(end)
                at = end
        self.done[at] = k
        return first

    def _one_of(self, at: int, wordings: list[str]) -> int:
        end = self._state()
        for wording in wordings:
            begin = self._state()
            self.skip[at].append(begin)
            for word in wording.encode().translate(ALNUM_TABLE).split():
                begin = self._arc(begin, word)
            self.skip[begin].append(end)
        return end

    def _arc(self, at: int, word: bytes | None) -> int:
        if word in self.on[at]:  # another way out of the same state, such as an optional region's
            self.skip[at].append(at := self._state())
        self.on[at][word] = to = self._state()
        return to

    def _joined(self, at: int) -> int:
        end = self._state()
        self.skip[at].append(end)
        return end

    def _closed(self, states) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in out:
                out.add(s)
                todo += self.skip[s]
        return frozenset(out)

    def _forget(self) -> None:
        self.ids = {self.begin: 0}
        self.sets, self.accepts, self.table, self.named = [self.begin], [()], [{}], [self._words(self.begin)]

    def _words(self, states: frozenset[int]) -> frozenset[bytes | None]:
        return frozenset(w for s in states for w in self.on[s])

    def _step(self, now: int, word: bytes) -> int:
        """The set after ``word``, -1 if none; remembered by the word if some state names it, else under None."""
        named = word in self.named[now]
        key = word if named else None
        if key in self.table[now]:
            return self.table[now][key]
        to = self._closed({self.on[s][w] for s in self.sets[now] for w in ((word, None) if named else (None,)) if w in self.on[s]})
        n = self.ids.get(to, -1) if to else -1
        if to and n < 0:
            n = self.ids[to] = len(self.sets)
            self.sets.append(to)
            self.accepts.append(tuple(sorted(self.done[s] for s in to if s in self.done)))
            self.table.append({})
            self.named.append(self._words(to))
        self.table[now][key] = n
        return n

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        if self.firsts.isdisjoint(words):
            return []
        if len(self.sets) > MOST_SETS:
            self._forget()
        out = []
        for start in (i for i, w in enumerate(words) if w in self.firsts):
            now, longest = 0, {}
            for end in range(start, len(words)):
                now = self._step(now, words[end])
                if now < 0:
                    break
                for k in self.accepts[now]:
                    longest[k] = end + 1
            most = max((end for k, end in longest.items() if not self.templates[k].base), default=0)
            out += [(k, start, end) for k, end in longest.items() if end == most or self.templates[k].base]
        return out


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, matches array<struct<label, base, whole, start, end>>`` of every text."""
    schema = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,whole:boolean,start:int,end:int>>"

    def make():
        machine = Automaton(templates)

        def work(batch: pa.RecordBatch) -> list:
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                words = text.translate(ALNUM_TABLE).split()
                counts.append(len(words))
                kinds = ((templates[k], a, b) for k, a, b in machine.places(words))
                found.append([{"label": t.label, "base": t.base, "whole": t.whole, "start": a, "end": b} for t, a, b in kinds])
            return [batch.column("doc_id"), counts, found]

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), schema, make)


def report(scanned: DataFrame) -> DataFrame:
    """The contract's columns from the matches."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    inside = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(m["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], m["end"]).alias("upto")),
        lambda s: s["n"],
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        labels(F.filter("matches", lambda m: m["whole"])).alias("text_labels"),
        F.when(F.col("n_words") > 0, inside / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))
