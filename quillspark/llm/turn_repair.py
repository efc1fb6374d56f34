"""Conversation structure repair by bidirectional Dijkstra over the edit lattice (operator 13).

A node of the lattice is (rows consumed, what the output ends with: nothing, system, user, assistant); an edge is an edit.
Keep costs 0, Rerole 2, Insert 2, Delete 3, and an undeleted truncated row 1 more. One heap grows from the start, one from
the accepting nodes; they go on until no cheaper or equally cheap crossing is possible, and of all crossings the least
concatenated audit is walked. What an edit makes of a row follows from the audit, so the audit names the repair.

Rows are laid out by range partitions of (conversation, turn, role, text), so one conversation may spread over many tasks,
and cut into blocks of at most ``BLOCK`` rows. A conversation of one block is repaired at once. Of a longer one, each block
gives its cheapest cost between each state before and after it, with the order of the audits; a lattice of blocks is
searched the same way, and every block is then repaired between its own two states. Only the audit, which has a character
for each row, and the repaired text meet in one row, being the result itself.

Defined results: null conv_id, role and text become one space (conv_id stays null in the result: those rows are one
conversation). Rows stand by turn (nulls first), then role, then text. ``damage`` deletes, empties, strips, repeats or
reroles rows by a checksum of conversation and turn. A row's role counts by its first character; rows of equal role and
text are equal by SHA-256. Conversations without rows after damage have zeros and empty strings. Other columns are ignored.
Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import read_table

from .common import broadcast_rows, map_batches, saved

#: Rows of one block.
BLOCK = 512
SPACE = " \t\n\x0b\x0c\r"

# What the output ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (NOTHING, ASSISTANT)
#: State after one more turn of the role that the state asks for, and the name of that role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
COMES_FROM = ((), (), (NOTHING, SYSTEM, ASSISTANT), (USER,))
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1


@dataclass(frozen=True)
class Lattice:
    """``layers`` layers of four states; node = 4 * layer + state. ``out`` and ``into`` list (label, cost, other node)."""

    layers: int
    out: Callable
    into: Callable


def row_lattice(rows: list, tail: bool) -> Lattice:
    """The edits of ``rows`` (role initial, must go, truncated); with ``tail``, inserts may follow the last row."""
    n = len(rows)

    def kept(state: int, initial: str) -> int:
        to = INITIAL.get(initial, NOTHING)
        return to if to and (to == FOLLOWS[state] or (to == SYSTEM and state == NOTHING)) else NOTHING

    def out(node: int) -> list:
        i, state = divmod(node, 4)
        to = FOLLOWS[state]
        edges = [("I", INSERT, 4 * i + to)] if i < n or tail else []
        if i < n:
            initial, must_go, truncated = rows[i]
            after = 4 * i + 4
            edges.append(("D", DELETE, after + state))
            if not must_go:
                edges.append(("R", REROLE + truncated, after + to))
                if same := kept(state, initial):
                    edges.append(("K", truncated * TRUNCATED, after + same))
        return edges

    def into(node: int) -> list:
        i, state = divmod(node, 4)
        sources = COMES_FROM[state]
        edges = [("I", INSERT, 4 * i + s) for s in sources] if i < n or tail else []
        if i:
            initial, must_go, truncated = rows[i - 1]
            before = 4 * i - 4
            edges.append(("D", DELETE, before + state))
            if not must_go:
                edges += [("R", REROLE + truncated, before + s) for s in sources]
                for s in (NOTHING,) if state == SYSTEM else sources:
                    if kept(s, initial) == state:
                        edges.append(("K", truncated * TRUNCATED, before + s))
        return edges

    return Lattice(n, out, into)


def block_lattice(costs: list, ranks: list) -> Lattice:
    """Blocks as layers: ``costs[b][4 * before + after]`` (-1: no way), labels in the order of the blocks' audits."""
    n = len(costs)

    def out(node: int) -> list:
        b, state = divmod(node, 4)
        if b == n:
            return [("I", INSERT, 4 * b + FOLLOWS[state])]
        return [(str(ranks[b][4 * state + t]), costs[b][4 * state + t], 4 * b + 4 + t) for t in range(4) if costs[b][4 * state + t] >= 0]

    def into(node: int) -> list:
        b, state = divmod(node, 4)
        edges = [("I", INSERT, 4 * b + s) for s in COMES_FROM[state]] if b == n else []
        if b:
            edges += [(str(ranks[b - 1][4 * s + state]), costs[b - 1][4 * s + state], 4 * b - 4 + s) for s in range(4) if costs[b - 1][4 * s + state] >= 0]
        return edges

    return Lattice(n, out, into)


class Front:
    """One heap of the search. Equal costs are settled in layer order, so free edges never reach a settled node."""

    def __init__(self, starts: list, edges: Callable, turn: int) -> None:
        self.cost, self.settled, self.edges, self.turn = {}, set(), edges, turn
        self.heap = []
        for s in starts:
            self.cost[s] = 0
            heappush(self.heap, (0, turn * (s >> 2), s))

    def least(self) -> float:
        while self.heap and (self.heap[0][2] in self.settled or self.heap[0][0] > self.cost[self.heap[0][2]]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> int:
        cost, _, node = heappop(self.heap)
        self.settled.add(node)
        for _, w, other in self.edges(node):
            if cost + w < self.cost.get(other, float("inf")):
                self.cost[other] = cost + w
                heappush(self.heap, (cost + w, self.turn * (other >> 2), other))
        return node


def cheapest(lattice: Lattice, start: int, ends: list) -> tuple[int, list] | None:
    """Least cost from ``start`` to any of ``ends`` and, of the paths with it, the least audit as (label, node) steps."""
    ahead, back = Front([start], lattice.out, 1), Front(ends, lattice.into, -1)
    best, turn = float("inf"), 0
    while (a := ahead.least()) + (b := back.least()) <= best and a + b < float("inf"):
        turn ^= 1
        front, other = (ahead, back) if a < b or (a == b and turn) else (back, ahead)
        node = front.settle()
        if node in other.cost:
            best = min(best, front.cost[node] + other.cost[node])
    if best == float("inf"):
        return None
    closed = set(ends)
    there = {n: c for n, c in back.cost.items() if n in back.settled or n in closed}
    here = {n: ahead.cost[n] for n in ahead.settled} or {start: 0}
    here.setdefault(start, 0)
    # crossings of least cost, and the settled nodes that lead to one
    marked = {n for n in here if n in closed and here[n] == best}
    marked |= {n for n in here if any(here[n] + w + there.get(m, best + 1) == best for _, w, m in lattice.out(n))}
    todo = list(marked)
    while todo:
        n = todo.pop()
        for _, w, m in lattice.into(n):
            if m in here and m not in marked and here[m] + w == here[n]:
                marked.add(m)
                todo.append(m)
    steps, at, spent = [], start, 0
    while not (at in closed and spent == best):
        choices = []
        for label, w, m in lattice.out(at):
            total = spent + w
            if (m in marked and here[m] == total) or (m in there and total + there[m] == best):
                choices.append((label, m, total))
        label, at, spent = min(choices)
        steps.append((label, at))
    return best, steps


def repaired(rows: list, names: list, steps: list) -> tuple[str, list]:
    """Audit and lines of the repaired rows (role, text) for the edits ``steps``."""
    audit, lines, i = [], [], 0
    for label, node in steps:
        audit.append(label)
        if label == "I":
            lines.append(NAMES[node & 3] + ":")
            continue
        role, text = names[i]
        if label != "D":
            lines.append((role if label == "K" else NAMES[node & 3]) + ":" + text)
        i += 1
    return "".join(audit), lines


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``: ``conv, turn, role, text``, nulls as one space."""
    conv, blank = F.col("conv_id").cast("string"), F.lit(" ")
    key = F.concat_ws(":", F.coalesce(conv, blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(F.coalesce(conv, blank).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
                        F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, part, chunk, rows``: each conversation's rows in order, in blocks; a row is (place, role, text, fault)."""
    order = ["conv", "turn", "role", "text"]
    dealt = saved(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id()), "turns")
    placed = saved(dealt.withColumn("place", F.row_number().over(Window.partitionBy("part", "conv").orderBy("turn", "role", "text", "row"))), "placed-turns")
    first = placed.groupBy("conv", "role", F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("part", "place")).alias("at"))
    first = first.select("conv", "at.part", "at.place", F.lit(True).alias("is_first"))
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(last == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated")
    marked = placed.join(first, ["conv", "part", "place"], "left").withColumn("fault", fault).withColumn("chunk", F.floor((F.col("place") - 1) / block))
    return saved(marked.groupBy("conv", "part", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "fault"))).alias("rows")), "turn-blocks")


WHOLE = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SUMMARY = "conv string, part int, chunk long, costs array<int>, ranks array<int>, faults array<long>, first string, last string"
ROUTE = "conv string, cost long, tail string, tail_lines string, faults array<long>, way array<struct<part:int,chunk:long,before:int,after:int>>"
PIECE = "conv string, part int, chunk long, audit string, lines string"


def _read(block: list) -> tuple[list, list, list]:
    """(initial, must go, truncated) and (role, text) of each row, and the counts blank, duplicate, truncated, illegal."""
    rows = [(r["role"][:1], r["fault"] in ("blank", "duplicate"), int(r["fault"] == "truncated")) for r in block]
    counts = [sum(r["fault"] == f for r in block) for f in ("blank", "duplicate", "truncated")]
    return rows, [(r["role"], r["text"]) for r in block], [*counts, sum(illegal(a[0], b[0]) for a, b in zip(rows, rows[1:]))]


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _by_row(one: Callable) -> Callable:
    """A worker for ``map_batches`` that gets one row as a dict and gives a tuple of columns."""

    def make() -> Callable:
        def work(batch: pa.RecordBatch) -> list:
            return list(zip(*map(one, batch.to_pylist())))

        return work

    return make


def repair_whole(blocks: DataFrame) -> DataFrame:
    """The result of conversations that are one block."""

    def one(row: dict) -> tuple:
        rows, names, counts = _read(row["rows"])
        cost, steps = cheapest(row_lattice(rows, tail=True), 0, [4 * len(rows) + s for s in ACCEPTING])
        audit, lines = repaired(rows, names, steps)
        return row["conv"], *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()

    return map_batches(blocks.select("conv", "rows"), WHOLE, _by_row(one))


def summarise(blocks: DataFrame) -> DataFrame:
    """Cost and audit order of each block between each two states; its faults; its outer role initials."""

    def one(row: dict) -> tuple:
        rows, _, counts = _read(row["rows"])
        lattice, costs, ranks = row_lattice(rows, tail=False), [], []
        for before in range(4):
            ways = [cheapest(lattice, before, [4 * len(rows) + after]) for after in range(4)]
            audits = ["".join(label for label, _ in w[1]) if w else "" for w in ways]
            costs += [w[0] if w else -1 for w in ways]
            ranks += [sorted(audits).index(x) for x in audits]
        return row["conv"], row["part"], row["chunk"], costs, ranks, counts, rows[0][0], rows[-1][0]

    return map_batches(blocks.select("conv", "part", "chunk", "rows"), SUMMARY, _by_row(one))


def route(summaries: DataFrame) -> DataFrame:
    """The states between the blocks of each conversation, its cost and the inserts after its last block."""
    whole = summaries.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "costs", "ranks", "faults", "first", "last"))).alias("blocks"))

    def one(row: dict) -> tuple:
        blocks = row["blocks"]
        n = len(blocks)
        cost, steps = cheapest(block_lattice([b["costs"] for b in blocks], [b["ranks"] for b in blocks]), 0, [4 * n + s for s in ACCEPTING])
        states = [0, *(node & 3 for _, node in steps[:n])]
        way = [{"part": b["part"], "chunk": b["chunk"], "before": x, "after": y} for b, x, y in zip(blocks, states, states[1:])]
        tail = [NAMES[node & 3] + ":" for _, node in steps[n:]]
        faults = [sum(x) for x in zip(*(b["faults"] for b in blocks))]
        faults[3] += sum(illegal(a["last"], b["first"]) for a, b in zip(blocks, blocks[1:]))
        return row["conv"], cost, "I" * len(tail), "\n".join(tail), faults, way

    return map_batches(whole, ROUTE, _by_row(one))


def repair_split(blocks: DataFrame) -> DataFrame:
    """The result of conversations of several blocks."""
    routes = saved(route(summarise(blocks)), "routes")
    ways = routes.select("conv", F.inline("way"))

    def one(row: dict) -> tuple:
        rows, names, _ = _read(row["rows"])
        _, steps = cheapest(row_lattice(rows, tail=False), row["before"], [4 * len(rows) + row["after"]])
        audit, lines = repaired(rows, names, steps)
        return row["conv"], row["part"], row["chunk"], audit, "\n".join(lines) if lines else None

    pieces = map_batches(blocks.join(ways, ["conv", "part", "chunk"]).select("conv", "part", "chunk", "rows", "before", "after"), PIECE, _by_row(one))
    joined = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "audit", "lines"))).alias("p"))
    texts = F.concat(F.transform("p", lambda p: p["lines"]), F.array(F.when(F.col("tail") != "", F.col("tail_lines"))))
    out = routes.join(joined, "conv")
    return out.select(
        "conv", *[F.col("faults")[i].alias(c) for i, c in enumerate(("blank", "duplicate", "truncated", "illegal"))], "cost",
        F.concat(F.array_join(F.transform("p", lambda p: p["audit"]), ""), "tail").alias("audit"),
        F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for rows ``conv, turn, role, text``."""
    blocks = blocks_of(rows, block)
    # conversations of several blocks: the long ones and those that a range partition ends in
    many = saved(blocks.groupBy("conv").count().where("count > 1").select("conv"), "split-conversations")
    hinted = broadcast_rows(many)
    return repair_whole(blocks.join(hinted, "conv", "left_anti")).unionByName(repair_split(blocks.join(hinted, "conv", "left_semi")))


def turn_gaps(rows: DataFrame) -> DataFrame:
    """``conv, gaps``: missing numbers between the least and the greatest turn."""
    return rows.where("turn IS NOT NULL").groupBy("conv", "turn").count().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def report(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's row for every conv_id of ``turns``, damaged first."""
    rows = saved(damage(turns), "damaged")
    every = turns.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    got = every.join(repair(rows, block), "conv", "left").join(turn_gaps(rows), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# In SQL: the cheapest way from each row on, from the last row back, as text of nine digits of cost, audit, chr(1), lines.
def _add(x: str, cost: str, edit: str, line: str | None = None) -> str:
    rest = f"substr({x}, strpos({x}, chr(1)) + 1)"
    lines = rest if line is None else f"{line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"
    return f"lpad(cast(cast(substr({x}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({x}, 10, strpos({x}, chr(1)) - 10) || chr(1) || {lines}"


def _edits(state: str, asks: str, name: str) -> str:
    kept = f"CASE WHEN NOT gone AND ini = '{asks}' THEN {_add(asks, 'cut', 'K', 'own')} END"
    opening = f", CASE WHEN NOT gone AND ini = 's' THEN {_add('s', 'cut', 'K', 'own')} END" if state == "z" else ""
    rerole = "'" + name + ":' || text"
    return f"least({_add(state, '3', 'D')}, CASE WHEN NOT gone THEN {_add(asks, '2 + cut', 'R', rerole)} END, {kept}{opening})"


_IN_USER, _IN_BOTH = _add("bu", "2", "I", "'user:'"), _add("i2", "2", "I", "'user:'")
SQL = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
o AS (SELECT conv_id, coalesce(cast(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT k, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: cast(ascii(x) AS BIGINT))),
                                lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 20 AS d FROM (SELECT DISTINCT k FROM o), tab),
m AS (SELECT conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy,
             CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM o JOIN c USING (k) WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
g AS (SELECT *, count(*) OVER (PARTITION BY conv) AS n, left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cutoff,
             lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM n),
f AS (SELECT *, blank OR again AS gone, cast(NOT blank AND NOT again AND cutoff AS INTEGER) AS cut, role || ':' || text AS own FROM g),
v AS (SELECT DISTINCT conv, n + 1 AS i, '000000000' || chr(1) AS z, '000000004II' || chr(1) || 'user:' || chr(10) || 'assistant:' AS s,
             '000000002I' || chr(1) || 'assistant:' AS u, '000000000' || chr(1) AS a FROM f
      UNION ALL
      SELECT conv, i, least(bz, {_IN_USER}, {_IN_BOTH}), least(bs, {_IN_USER}, {_IN_BOTH}), least(bu, i2), least(ba, {_IN_USER})
      FROM (SELECT *, {_add("ba", "2", "I", "'assistant:'")} AS i2 FROM (
            SELECT f.conv, f.i, {_edits("z", "u", "user")} AS bz, {_edits("s", "u", "user")} AS bs,
                   {_edits("u", "a", "assistant")} AS bu, {_edits("a", "u", "user")} AS ba
            FROM v JOIN f ON f.conv = v.conv AND f.i = v.i - 1))),
e AS (SELECT conv, cast(substr(z, 1, 9) AS BIGINT) AS cost, substr(z, 10, strpos(z, chr(1)) - 10) AS audit, sha256(substr(z, strpos(z, chr(1)) + 1)) AS sha FROM v WHERE i = 1),
h AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (NOT blank AND again) AS duplicate, cast(sum(cut) AS BIGINT) AS truncated,
             count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT conv_id, cast(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) LEFT JOIN e USING (conv) LEFT JOIN h USING (conv)
"""
