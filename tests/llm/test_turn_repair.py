import hashlib
import random
import zlib
from itertools import product

import pytest

from quillspark.llm import turn_repair as T

from .conftest import rows_of


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 0:
            continue
        r, x = "user" if d == 4 else r, "" if d == 1 else "".join(ch for ch in x if ch not in ".!?") if d == 2 else x
        out += [(c, t, r, x)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """Forward search over all edits by cost and audit, rows (role, text) in order: counts, cost, audit, lines."""
    seen, faults = set(), []
    for r, x in rows:
        last = x.rstrip(T.SPACE)
        faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((r, x))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    counts.append(sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])))
    ways = {"": (0, "", ())}  # what the output ends with -> cost, audit, lines

    def add(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def insert(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                name = "assistant" if state == "u" else "user"
                add(ways, name[0], (cost + 2, audit + "I", (*lines, name + ":")))
        return ways

    for (r, x), f in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in insert(ways).items():
            add(after, state, (cost + 3, audit + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            cut, name = int(f == "truncated"), "assistant" if state == "u" else "user"
            add(after, name[0], (cost + 2 + cut, audit + "R", (*lines, f"{name}:{x}")))
            if r[:1] == name[0] or (r[:1] == "s" and state == ""):
                add(after, r[0], (cost + cut, audit + "K", (*lines, f"{r}:{x}")))
        ways = after
    best = min(w for s, w in insert(ways).items() if s in ("", "a"))
    return counts, *best


def brute(rows):
    kept, out = brute_damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in kept if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts, cost, audit, lines = brute_repair([r[1:] for r in mine])
        out.append((conv, gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


ROLES = ["user", "assistant", "system", "tool", None, "", "unknown", "user", "assistant"]
TEXTS = ["Hello there.", "What is it?", "no end", "", None, " \t\n", "Done! \x0b", "é.", "x\x85", "Hello there."]


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(convs) for t in range(rnd.randrange(0, most))]
    rows += [(None, t, rnd.choice(ROLES), rnd.choice(TEXTS)) for t in (3, 3, None, None, 9)]
    return rows + rows[:5] + [(-5, None, None, None), (10_000, 7, "user", "y " * 20_000)]


SCHEMA = "conv_id long, turn long, role string, text string, part int, place int, d int"


@pytest.mark.parametrize(("block", "convs", "most"), [(512, 120, 9), (3, 25, 40), (1, 12, 14)])
def test_equals_brute_force(spark, block, convs, most):
    rows = random_rows(block, convs, most)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert rows_of(T.report(df, block)) == brute(rows)


def test_one_conversation_of_many_rows(spark):
    rnd = random.Random(1)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"turn {t % 900}.") for t in range(6000)]
    got = T.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=100)
    assert rows_of(got) == brute(rows)


def test_all_short_conversations():
    """Every conversation of up to four rows over the roles and faults: least cost and least audit."""
    for n in range(5):
        for kinds in product("sua-", repeat=n):
            rows = [(k, bool((i * 7 + n) % 5 == 4), (i + n) % 3 == 1) for i, k in enumerate(kinds)]
            cost, steps = T.cheapest(T.row_lattice([(a, b, int(c)) for a, b, c in rows], tail=True), 0, [4 * n + s for s in T.ACCEPTING])
            ways = {0: (0, "")}
            for layer in range(n + 1):
                for _ in range(3):
                    for s, (c, a) in list(ways.items()):
                        ways[T.FOLLOWS[s]] = min(ways.get(T.FOLLOWS[s], (99, "")), (c + 2, a + "I"))
                if layer == n:
                    break
                after = {}
                for s, (c, a) in ways.items():
                    k, gone, cut = rows[layer]
                    options = [(s, c + 3, "D")]
                    if not gone:
                        options.append((T.FOLLOWS[s], c + 2 + cut, "R"))
                        if T.INITIAL.get(k) == T.FOLLOWS[s] or (k == "s" and s == 0):
                            options.append((T.INITIAL[k], c + cut, "K"))
                    for to, cost_to, label in options:
                        after[to] = min(after.get(to, (99, "")), (cost_to, a + label))
                ways = after
            assert (cost, "".join(label for label, _ in steps)) == min(w for s, w in ways.items() if s in T.ACCEPTING)


def test_empty_table(spark):
    assert rows_of(T.report(spark.createDataFrame([], SCHEMA))) == []
