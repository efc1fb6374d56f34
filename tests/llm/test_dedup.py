import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import line_dedup as L
from quillspark.llm import phrase_dedup as P
from quillspark.llm import simhash as S
from quillspark.llm.components import components
from quillspark.llm.key_filter import KeyFilter, may_hold

from .conftest import messy_rows, prose, rows_of


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- helpers ----


@pytest.mark.parametrize("local", [500_000, 40])
def test_components_equal_union_find(spark, local):
    rnd = random.Random(0)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1), (2000, 2001), (2000, 2001)]
    edges += [(3000, 3001 + i) for i in range(200)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_key_filter_never_loses_a_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000)
    held, bits = KeyFilter(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k").tester()
    bitmap = np.frombuffer(held.value, np.uint64)
    assert may_hold(bitmap, bits, keys).all()
    assert may_hold(bitmap, bits, rng.integers(-(1 << 63), 1 << 63, 3000)).mean() < 0.2
    held, bits = KeyFilter(spark.createDataFrame([], "k long"), "k").tester()
    assert not may_hold(np.frombuffer(held.value, np.uint64), bits, keys).any()


# ---- simhash ----


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    u = Union()
    for i in range(len(rows)):
        u.find(i)
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[u.find(i)] = min(d, least.get(u.find(i), d))
    return [(d, f"{prints[i]:016x}", least.get(u.find(i))) for i, (d, _) in enumerate(rows)], u


def simhash_rows(df):
    from pyspark.sql import functions as F

    return rows_of(S.near_classes(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"))


def test_simhash_equals_brute_force(messy, nothing):
    want, _ = plain_components(messy_rows())
    assert simhash_rows(messy) == sorted(want, key=repr)
    assert simhash_rows(nothing) == []


@pytest.mark.parametrize("block", [3, 1000])
def test_links_of_close_fingerprints(spark, block):
    """Fingerprints around a few centres: many share keys, and blocks of a hot key must still join all of them."""
    rng = random.Random(4)
    prints = set()
    for centre in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(60):
            f = centre
            for bit in rng.sample(range(64), rng.randrange(0, 5)):
                f ^= 1 << bit
            prints.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    u = Union()
    for i, a in enumerate(signed):
        u.find(a)
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                u.join(a, b)
    links = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 64 for r in links.collect())
    got = {r.node: r.component for r in components(links).collect()}
    assert {f: got.get(f, f) for f in signed} == {f: u.find(f) for f in signed}


def test_keep_one(messy, nothing):
    rows = messy_rows()
    _, u = plain_components(rows)
    kept = S.keep_one(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len({u.find(i) for i in range(len(rows))})
    assert S.keep_one(nothing).collect() == []


# ---- lines ----


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def plain_removed(rows):
    """Removed line numbers by (doc_id, text), by comparing all pairs of lines."""
    def key(i, t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (i is not None, i, h - (1 << 64) if h >> 63 else h)

    places = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.encode().split():
                places.setdefault(line, set()).add((*key(i, t), n))
    lines = sorted(places)
    sets = [shingles(x) for x in lines]
    u = Union()
    for a in range(len(lines)):
        u.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    order = lambda p: (p[0], p[1] if p[0] else 0, p[2], p[3])
    first = {}
    for a, line in enumerate(lines):
        best = min(places[line], key=order)
        r = u.find(a)
        first[r] = min(first.get(r, best), best, key=order)
    gone = {}
    for a, line in enumerate(lines):
        for p in places[line]:
            if p != first[u.find(a)]:
                gone.setdefault(p[:3], set()).add(p[3])
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(key(i, t), ()))) for i, t in rows]


def line_rows():
    rnd = random.Random(9)
    base = [prose(rnd, rnd.randrange(3, 30)) for _ in range(40)]
    rows = []
    for i in range(40):
        text = [rnd.choice(base) for _ in range(4)]
        text.append(rnd.choice(base) + " x")
        text.append(rnd.choice(base).replace("alpha", "alphas"))
        rows.append((i, "\n".join(text)))
    return rows + [(100, "ab\n\nab\n \nab"), (101, None), (102, ""), (103, "é😀"), (None, base[0]), (104, base[1] + "\n" + base[1]), (104, base[2]), (105, base[3]), (105, base[3])]


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, text_hash int, removed string")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert rows_of(out.select("doc_id", "text")) == sorted(plain_removed(rows), key=repr)


def test_lines_in_small_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    sets = [components(L.line_links(df, block)).agg(F.count("*"), F.countDistinct("component")).first() for block in (2, 500)]
    assert sets[0] == sets[1]


def test_large_buckets_of_few_and_of_many_components(spark):
    """Blocks of three lines: variants of one line, and unlike lines that one bucket holds."""
    rnd = random.Random(12)
    base = "this is a rather long footer line that very many documents share, number"
    lines = [f"{base} {i:03d}" for i in range(60)] + ["".join(rnd.choices("abcdefgh ", k=40)) for _ in range(20)]
    names = {i: L.shingle_sets([x])[0] for i, x in enumerate(lines)}
    known = spark.createDataFrame([(i, 0) for i in range(60)], "node long, component long")
    buckets = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(50, 80)], "key long, h1 long")
    met = set()
    for r in L.left_apart(buckets, known, 3).collect():
        met |= {frozenset((x, y)) for x, p in zip(r.ids, r.left) for y, q in zip(r.ids, r.left) if x != y and (all(r.left) or p != q)}
    assert met >= {frozenset((x, y)) for x in range(60, 80) for y in range(50, 80) if x != y} and min(map(min, met)) >= 50
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    u = Union()
    for x in names:
        u.find(x)
        for y in range(x):
            if L.similar(names[x], names[y]):
                u.join(x, y)
    sizes = sorted(Counter(map(u.find, names)).values())
    for block in (3, 500):
        got = components(L.line_links(df, block)).groupBy("component").count().collect()
        assert sorted(r["count"] for r in got) == [n for n in sizes if n > 1]


def test_lines_of_messy_and_empty_tables(messy, nothing):
    assert rows_of(L.dedup_lines(messy).select("doc_id", "text")) == sorted(plain_removed(messy_rows()), key=repr)
    assert L.dedup_lines(nothing).collect() == []


def test_own_columns_of_the_query(spark, monkeypatch):
    """``op8``'s rows against the texts that brute force leaves."""
    rows = line_rows()
    monkeypatch.setattr(L, "documents", lambda spark, sf_dir: spark.createDataFrame(rows, "doc_id long, text string"))
    want = []
    for (i, t), (_, left) in zip(rows, plain_removed(rows)):
        lines, keep, gone = (t or "").split("\n") if t is not None else [], (left or "").split("\n") if left is not None else [], []
        for n, x in enumerate(lines):  # removed lines are the ones that the remaining text skips
            if keep and x == keep[0] and len(lines) - n >= len(keep) and not _skipped(lines, n, keep):
                keep = keep[1:]
            else:
                gone.append(n)
        want.append((i, sum(bool(x.strip()) for x in lines), len(gone)))
    got = L.op8(spark, "")
    assert got.columns == ["doc_id", "n_lines", "n_removed", "removed"]
    assert rows_of(got.select("doc_id", "n_lines", "n_removed")) == sorted(want, key=repr)
    assert all(len(r.removed.split(",")) == r.n_removed for r in got.collect() if r.n_removed)


def _skipped(lines, n, keep):
    """Whether the remaining lines can't be a subsequence of what follows line ``n``."""
    it = iter(lines[n + 1 :])
    return not all(any(x == k for x in it) for k in keep[1:])


def test_many_lines_of_one_text(spark):
    """100,000 lines of one text, half of them repeated: removed in linear time, names that clash are kept."""
    text = "\n".join(hashlib.md5(str(i // 2).encode()).hexdigest() for i in range(100_000))
    df = spark.createDataFrame([(1, text, 5), (2, text, 6), (2, text, 6)], "doc_id long, text string, gone int")
    out = df.select("doc_id", L.lines_left(F.col("text"), F.array_distinct(F.sequence(F.lit(1), F.lit(99_999), F.lit(2)))).alias("left"))
    for r in out.collect():
        assert r["left"].split("\n") == text.split("\n")[::2]
    got = {(r["doc_id"], r["gone"]): r["text"] for r in L.dedup_lines(df).collect()}
    assert got[(2, 6)] == "" and got[(1, 5)].split("\n") == text.split("\n")[::2]


def test_repeated_rows_make_no_large_bucket(spark):
    df = spark.createDataFrame([(1, "the very same line of text")] * 3000 + [(2, "the very same line of texts")], "doc_id long, text string").repartition(4)
    lines = L.lines_of(df)
    keys = L.distinct_keys(lines, L.KeyFilter(L.repeated_lines(lines).select("h1").distinct(), "h1"))
    assert keys.count() == 2
    assert {(r["doc_id"], r["text"]) for r in L.dedup_lines(df).collect()} == {(1, "the very same line of text"), (2, "")}


def test_hashed_sets_have_the_exact_similarity():
    rnd = random.Random(5)
    for _ in range(500):
        a = "".join(rnd.choices("abc é", k=rnd.randrange(1, 40)))
        b = a[rnd.randrange(3) :] + rnd.choice(["", "z", "abc"])
        x, y = shingles(a), shingles(b)
        got = L.similar(*L.shingle_sets([a, b or "q"]))
        assert got == (5 * len(x & y) >= 4 * len(x | y)) or not b


def test_minhash_estimates_similarity_and_finds_near_lines():
    rnd = random.Random(2)
    found, errors = 0, []
    for _ in range(200):
        a = "".join(rnd.choices("abcdefgh ", k=rnd.randrange(20, 300)))
        b = list(a)
        b[rnd.randrange(len(b))] = "z"
        b = "".join(b)
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        sign = L.signatures([a, b])
        errors.append((sign[0] == sign[1]).mean() - j)
        keys = L.band_keys([a, b])
        if j >= 0.8:
            found += 1 - (keys[0] == keys[1]).any()
    assert abs(np.mean(errors)) < 0.04 and found <= 1


def test_empty_bins_take_the_value_that_their_tries_come_to_first(monkeypatch):
    rnd = random.Random(3)
    lines = ["a", "abcdefg", "é😀", *("".join(rnd.choices("abcdefgh ", k=k)) for k in (5, 6, 9, 20, 60, 200, 900))]
    want = []
    for line in lines:
        full = {}
        for h in L.shingle_hashes([line])[0].tolist():
            b = (h >> 32) * 192 >> 32
            full[b] = min(h, full.get(b, h))
        row = []
        for b in range(192):
            tries, at = 0, b
            while at not in full:
                tries += 1
                at = int(L.mixed(np.array([b * 65_537 + tries], np.uint64))[0]) % 192
            row.append(full[at])
        want.append(row)
    assert L.signatures(lines).tolist() == want and L.signatures([]).shape == (0, 192)
    calls, mixed = [], L.mixed
    monkeypatch.setattr(L, "mixed", lambda x: calls.append(len(x)) or mixed(x))
    L.signatures(lines)  # one try after the other took more than a thousand rounds for a line of one shingle
    assert len(calls) == 1


@pytest.mark.parametrize("union", [5, 10, 20, 40, 100])
def test_lines_at_the_threshold_share_a_bucket(union):
    rnd = random.Random(union)
    n, a, b = 1000, [], []
    while len(a) < n:  # a text without its last and without its first characters
        text, differ = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=union + 4)), union // 5
        i = rnd.randrange(differ + 1)
        x, y = text[: len(text) - differ + i], text[i:]
        if len(shingles(text)) == union and len(shingles(x) & shingles(y)) * 5 == 4 * union:
            a.append(x)
            b.append(y)
    lost = n - (L.band_keys(a) == L.band_keys(b)).any(1).sum()
    assert lost <= 3


def test_bucket_counts_equal_plain_counts(spark, monkeypatch):
    rnd = random.Random(4)
    keys = [[rnd.randrange(-60, 60) for _ in range(L.BANDS)] for _ in range(50)]
    monkeypatch.setattr(L, "GATHER", 100)
    got = L.bucket_counts(spark.createDataFrame([(k,) for k in keys], "keys array<int>"), 300).collect()
    plain = Counter((band << 32) | (k & 0xFFFFFFFF) for row in keys for band, k in enumerate(row))
    assert sorted(map(tuple, got)) == sorted((k, n) for k, n in plain.items() if n > 1)


# ---- phrases ----


def plain_phrases(rows):
    rows = sorted({(i is not None, i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or 0, xxhash.xxh64_intdigest((r[2] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[2] or "").encode(), 42) >> 63) if r[2] is not None else 42))
    seen, out = set(), {}
    for has, i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, t)] = (i, len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def phrase_rows():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    common = fresh(25)
    rows = [(i, f"{fresh(rnd.randrange(0, 40))} {common} {fresh(rnd.randrange(0, 40))}") for i in range(30)]
    rows += [(100 + i, rows[i][1].replace("w1 ", "w399 ")) for i in range(10)] + [(200, common[: common.rindex(" ")]), (201, common + " " + common)]
    return rows + [(300, "a " * 200), (301, "a b " * 100), (302, None), (303, "x y z")]


@pytest.mark.parametrize(("shard", "spread"), [(4000, 1000), (7, 2)])
def test_phrases_equal_brute_force(spark, shard, spread):
    rows = phrase_rows() + messy_rows()
    want = plain_phrases(rows)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, kept string")
    got = P.dedup(df, shard, spread).drop("kept")
    assert rows_of(got) == sorted((want[r] for r in rows), key=repr)


def test_copies_of_few_and_of_many_places(spark):
    rows = phrase_rows()
    want = plain_phrases(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 8):  # no passage, or the commonest passages, are looked up without a shuffle
        assert rows_of(P.dedup(df, parts=parts).drop("kept")) == sorted((want[r] for r in rows), key=repr)


def test_passages_of_several_texts_equal_those_of_each():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 30, n).astype(np.uint64) for n in (0, 5, 19, 20, 21, 0, 300, 7, 20, 64)]
    lengths = np.array([len(t) for t in texts])
    anchor, first, n, phrases = P.passages(np.concatenate(texts), lengths)
    names, want, at = P.passage_hash(phrases, first, n), [], 0
    for t in texts:
        a, f, k, p = P.passages(t)
        want += zip(a.tolist(), (f + at).tolist(), k.tolist(), P.passage_hash(p, f, k).tolist() if len(f) else [])
        at += len(t)
    assert list(zip(anchor.tolist(), first.tolist(), n.tolist(), names.tolist())) == want
    assert len(P.passages(np.concatenate(texts[:3] + texts[7:8]), np.array([0, 5, 19, 7]))[0]) == 0


def test_phrases_of_empty_table(nothing):
    assert P.dedup(nothing).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    other = np.concatenate([rng.integers(0, 1 << 63, 37).astype(np.uint64), codes[50:120], rng.integers(0, 1 << 63, 11).astype(np.uint64)])
    def by_window(c):
        anchor, first, n, _ = P.passages(c)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(c) - 19 and n.max() <= 13
        return np.repeat(anchor, n)
    assert (by_window(codes)[50:101] == by_window(other)[37:88]).all()


def test_keys_of_lines_are_stored_as_one_value(spark):
    docs = spark.createDataFrame([(1, "a first line\nanother one\na first line"), (2, None), (3, "")], "doc_id long, text string")
    lines = L.lines_of(docs)
    assert dict(lines.dtypes)["keys"] == "binary"
    got = {r.line_no: r["keys"] for r in lines.collect()}
    want = L.band_keys(["a first line", "another one"])
    assert [bytes(got[0]), bytes(got[1]), got[2]] == [want[0].tobytes(), want[1].tobytes(), None]
    packed = L.packed_keys(want.reshape(-1), np.array([True, False, True]))
    assert packed.is_valid().to_pylist() == [True, False, True]
    assert (L.key_values(packed.drop_null()) == want.reshape(-1)).all()
    assert L.packed_keys(np.zeros(0, np.int32), np.zeros(0, bool)).to_pylist() == []


def test_unlike_lines_of_a_block_are_passed_over(monkeypatch):
    rnd = random.Random(3)
    lines = ["".join(rnd.choices("abcdefghijklmnop ", k=rnd.randint(250, 300))) for _ in range(30)]
    lines += [x[:40] + "#" + x[40:] for x in lines[:5]]
    sets, names, seen = L.shingle_sets(lines), list(range(len(lines))), []
    assert [x.tolist() for x in sets] == [sorted({*L.shingle_hashes([x])[0].tolist()}) for x in lines] and L.shingle_sets([]) == []
    exact = L.similar
    monkeypatch.setattr(L, "similar", lambda a, b, s: seen.append(1) or exact(a, b, s))
    assert sorted(L.block_links(names, sets, None)) == [(30 + i, i) for i in range(5)]
    assert len(seen) == 5  # of 595 pairs
    left = [i < 30 for i in names]
    assert sorted(L.block_links(names, sets, left)) == [(30 + i, i) for i in range(5)]
    assert L.block_links([7, 9], [sets[0], sets[30]], None) == [(9, 7)] and L.block_links([7, 9], sets[:2], None) == []
    assert L.block_links([7, 9], [sets[0], sets[30]], [True, True]) == []


def test_steps_leave_neither_tables_nor_shuffles_behind(spark):
    import glob
    import os
    import time

    from quillspark.session import checkpoint_root, discard

    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{passage} only{i} {passage}") for i in range(8)] + [(9, None)], "doc_id long, text string").repartition(2)
    assert P.dedup(docs).count() == 9
    assert {x.rpartition("-")[0] for x in {*os.listdir(root)} - before} == {"repeats"}

    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {x for d in held for x in glob.glob(f"{d}/*/shuffle_*.data")}
    had = files()
    kept = P.saved(spark.range(100_000).selectExpr("id % 50000 AS k").groupBy("k").count(), "kept")
    for _ in range(50):
        if not files() - had:
            break
        time.sleep(0.1)
    assert not files() - had
    assert kept.count() == 50_000
    outside = spark.createDataFrame([(1,)], "a int")
    discard(kept, outside)
    assert not [x for x in os.listdir(root) if x.startswith("kept-") and x not in before]
