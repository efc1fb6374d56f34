"""Fuzzy line dedup by MinHash (operator 8).

Lines are the \\n-split parts of a text that hold a word. Equal lines are one class from the start. Each line's character
shingles give a one-permutation MinHash signature; bands of it are bucket keys. Lines that share a bucket are compared
by the exact Jaccard similarity of their shingle sets, and a distributed union-find makes components of the links. Of
each component one line stays, the first by (doc_id, line number); the others are taken out of their texts.

Large buckets are dealt out in blocks. Each block is compared together with the bucket's first block, which joins most
of a group of near copies by rows in proportion to the bucket. What this leaves apart is compared in a second step, block
by block: the lines outside a bucket's largest component with all others. Both give a spanning forest of the links.
In a block, a line is compared with the lines of other components only, so a large group of copies costs little.

Defined results: a null text has no lines and stays null. Lines without a word always stay. Lines shorter than a shingle
have one shingle, the whole line. Several rows of one doc_id are ordered by the hash of their text; equal rows (same id
and text) count as one and are all edited alike. A null doc_id comes before all others. Rows are never dropped, a text
may become empty. Other columns are kept as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_rows, documents, map_batches, saved, text_bytes
from .components import components
from .key_filter import KeyFilter, may_hold

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS signature values: a pair at the threshold shares a bucket with probability 0.99994; unrelated lines, of
#: similarity 0.1, with 3e-5.
BANDS, ROWS = 32, 6
BLOCK = 500
#: Bucket keys that a task gathers before it sends them on, and that one shard of the bucket counts holds on average.
GATHER, SHARD = 500_000, 500_000
#: Bytes of lines whose shingle sets are compared at a time (one group may be larger).
VERIFY = 1 << 19
#: Groups of at most so many lines are compared together with the other small groups of their least line.
SMALL = 32
#: Bytes of lines that are hashed at once: arrays that fit a core's cache.
CHUNK = 1 << 17

#: Tries of an empty bin of a signature that are made for all lines at once.
TRIES = 12

#: Low bits of a shingle's hash by which two lines are compared first.
_LOW = np.uint64((1 << 17) - 1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit touches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, one line after the other, and how many each line has; a line shorter
    than a shingle has one, itself."""
    count = len(lines)
    lengths = np.fromiter(map(len, lines), np.int64, count)
    if (lengths < size).any():  # room for the whole line's hash
        lines = [x if len(x) >= size else x.ljust(size, "\U0010ffff") for x in lines]
        lengths = np.maximum(lengths, size)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(chars) - size + 1, 0)
    rolled = chars[:n].copy()
    for j in range(1, size):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += chars[j : j + n]
    ends, inside = np.cumsum(lengths), np.ones(len(chars), bool)
    for j in range(size - 1):  # the last places of a line begin no shingle
        inside[ends - 1 - j] = False
    return mixed(rolled[inside[:n]]), lengths - size + 1


@cache
def densification(values: int, tries: int = TRIES) -> tuple[np.ndarray, np.ndarray]:
    """The bins that an empty bin turns to: a row with each bin's choice for each of the first ``tries``, and for each bin
    the number of the try at which it first comes to each bin."""
    never = np.iinfo(np.int32).max
    own, first, done, donors = np.arange(values), np.full((values, values), never, np.int32), 0, None
    while (first == never).any():
        numbers = np.arange(done + 1, done + 1 + max(tries, 8 * values))
        some = (mixed((own * 65_537 + numbers[:, None]).astype(np.uint64)) % np.uint64(values)).astype(np.int64)
        np.minimum.at(first, (np.broadcast_to(own, some.shape), some), numbers[:, None].astype(np.int32))
        donors = some[:tries] if donors is None else donors
        done = int(numbers[-1])
    return donors, first


def signatures(lines: list[str], size: int = SHINGLE, values: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation MinHash: each shingle hash falls in one of ``values`` bins by its high bits, and the least hash of
    a bin counts. An empty bin takes the value of a bin that depends on its own number and the try only (densification).
    """
    count = len(lines)
    hashes, each = shingle_hashes(lines, size)
    bins = ((hashes >> np.uint64(32)) * np.uint64(values) >> np.uint64(32)).view(np.int64)
    bins += np.repeat(np.arange(count) * values, each)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(count * values, none)
    np.minimum.at(table, bins, hashes)
    out = table.copy()
    donors, first = densification(values)
    empty = np.nonzero(table == none)[0]
    line, own = np.divmod(empty, values)
    for of in donors:
        found = table[line * values + of[own]]
        out[empty] = found
        left = found == none
        empty, line, own = empty[left], line[left], own[left]
    # a line of few shingles would take very many tries: of its full bins, the one that the tries come to first
    table, ends = table.reshape(count, values), np.nonzero(np.diff(line, append=-1))[0] + 1
    for i, j in zip([0, *ends.tolist()], ends.tolist()):
        of = table[line[i]]
        full = np.nonzero(of != none)[0]
        out[empty[i:j]] = of[full[first[own[i:j, None], full].argmin(1)]]
    return out.reshape(count, values)


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of BANDS keys (32 bits each) for each line."""
    sign = signatures(lines).reshape(len(lines), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(lines), BANDS)).copy()
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, r])
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bucket_numbers(keys: np.ndarray) -> np.ndarray:
    """The bucket of each key of whole rows of keys: band and key in one integer."""
    return np.tile(np.arange(BANDS) << 32, len(keys) // BANDS) | keys.view(np.uint32).astype(np.int64)


def packed_keys(keys: np.ndarray, there: np.ndarray) -> pa.Array:
    """A binary value, the bytes of a row of ``keys``, for each true entry of ``there``, and null for the others. Spark copies
    and stores such a value at once, an array of integers one by one."""
    ends = pa.array(np.concatenate([[0], np.cumsum(there) * (4 * BANDS)]), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(there), [pa.array(there).buffers()[1], ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(keys))])


def key_values(packed: pa.Array) -> np.ndarray:
    """The keys of packed rows, or of arrays of integers, one row after the other."""
    if pa.types.is_list(packed.type):
        return packed.flatten().to_numpy()
    return np.frombuffer(b"".join(packed.to_pylist()), np.int32)


def bucket_counts(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """``key, count`` of the buckets that several lines share. Keys go to shards as sorted arrays, equal ones of a task as
    one, and are counted there."""
    shards = np.uint64(distinct.count() * BANDS // shard + 1)

    def deal(batches):
        def send():
            keys, counts = np.unique(bucket_numbers(np.concatenate(gathered)), return_counts=True)
            to = (mixed(keys.view(np.uint64)) % shards).astype(np.int64)
            order = np.argsort(to, kind="stable")
            keys, counts = keys[order], counts[order]
            there, begin = np.unique(to[order], return_index=True)
            ends = [*begin[1:].tolist(), len(order)]
            packed = [(np.diff(keys[i:j], prepend=0).tobytes(), counts[i:j].astype(np.uint32).tobytes()) for i, j in zip(begin.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(2))], ["shard", "keys", "counts"])

        gathered, size = [], 0
        for batch in batches:
            gathered.append(key_values(batch.column("keys")))
            size += len(gathered[-1])
            if size >= GATHER:
                yield send()
                gathered, size = [], 0
        if size:
            yield send()

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table.column("keys").to_pylist()])
        each = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        known, begin = np.unique(keys[order], return_index=True)
        counts = np.add.reduceat(each[order], begin)
        return pa.table({"key": known[counts > 1], "count": counts[counts > 1]})

    dealt = distinct.select("keys").mapInArrow(deal, "shard long, keys binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(count, "key long, count long")


def shingle_sets(lines: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of shingles of each line, as sorted distinct 64-bit hashes."""
    hashes, each = shingle_hashes(lines, size)
    if not lines:
        return []
    ends = np.cumsum(each)
    begin = ends - each
    for i, j in zip(begin.tolist(), ends.tolist()):
        hashes[i:j].sort()
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    first[begin] = True
    hashes, ends = hashes[first], np.cumsum(np.add.reduceat(first, begin, dtype=np.int64)).tolist()
    return [hashes[i:j] for i, j in zip([0, *ends], ends)]


def has_word(line: bytes) -> bool:
    return bool(line) and not line.isspace()


def line_hash(line: bytes) -> tuple[int, int]:
    """The identity of a line, 128 bits as two signed integers."""
    return tuple(line_hashes([line])[0].tolist())


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """A row of two integers, its identity, for each line."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)


ROW = "doc_id long, text_hash long"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_bytes().alias("text"))


def text_chunks(lines: list):
    """Lines in runs of about CHUNK bytes or characters."""
    run, size = [], 0
    for line in lines:
        run.append(line)
        size += len(line)
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, h1, h2, keys`` of every line that holds a word, from one scan of the texts. Of equal
    lines of a part of a batch one has its bucket keys, the others null."""
    def make():
        def work(batch: pa.RecordBatch) -> list:
            owner, number, which, seen = [], [], [], {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, line in enumerate(text.split(b"\n")):
                    if has_word(line):
                        owner.append(i)
                        number.append(n)
                        which.append(seen.setdefault(line, len(seen)))
            distinct = list(seen)
            hashes = line_hashes(distinct)
            keys = [band_keys([x.decode("utf-8", "surrogatepass") for x in run]) for run in text_chunks(distinct)]
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int32)
            at, rows = np.array(which, np.int64), pa.array(owner, pa.int64())
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True  # lines are numbered as they come, and so are their keys
            return [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), number, hashes[at, 0], hashes[at, 1], packed_keys(flat, first)]

        return work

    return map_batches(_rows(docs), f"{ROW}, line_no int, h1 long, h2 long, keys binary", make)


def wanted_lines(docs: DataFrame, wanted: KeyFilter) -> DataFrame:
    """``h1, h2, line`` of the lines whose ``h1`` the filter may hold, each once per batch of texts."""
    held, bits = wanted.tester()

    def make():
        bitmap = np.frombuffer(held.value, np.uint64)

        def work(batch: pa.RecordBatch) -> list:
            distinct = [x for x in {x for text in batch.column("text").to_pylist() for x in text.split(b"\n")} if has_word(x)]
            hashes = line_hashes(distinct)
            pick = np.nonzero(may_hold(bitmap, bits, np.ascontiguousarray(hashes[:, 0])))[0]
            return [hashes[pick, 0], hashes[pick, 1], [distinct[i].decode("utf-8", "surrogatepass") for i in pick.tolist()]]

        return work

    return map_batches(_rows(docs).select("text"), "h1 long, h2 long, line string", make)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    merged = np.concatenate((a, b))
    merged.sort()
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return both >= similarity * (len(a) + len(b) - both)


def block_links(names: list[int], sets: list[np.ndarray], left: list[bool] | None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the components of a block, or of two blocks: every pair that the links so far leave apart is
    compared. ``left`` marks the lines of the first of two blocks; pairs within a block are another task's.

    How many shingles of a line have low bits that the other line has as well is never less than what they share, so most
    pairs that aren't similar are passed over without a look at their sets.
    """
    if len(names) == 2:
        return [(names[1], names[0])] if (left is None or left[0] != left[1]) and similar(sets[1], sets[0], similarity) else []
    groups: list[list[int]] = []
    found = []
    low = [(x & _LOW).view(np.int64) for x in sets]
    sizes, marked = [len(x) for x in sets], np.zeros(int(_LOW) + 1, bool)
    for i in range(len(names)):
        joined, size = [], sizes[i]
        marked[low[i]] = True
        for g in groups:
            for j in g:
                if left is not None and left[i] == left[j]:
                    continue
                most = min(np.count_nonzero(marked[low[j]]), size)
                if most >= similarity * (size + sizes[j] - most) and similar(sets[i], sets[j], similarity):
                    found.append((names[i], names[j]))
                    joined.append(g)
                    break
        marked[low[i]] = False
        merged = [i]
        for g in joined:
            merged += g
            groups.remove(g)
        groups.append(merged)
    return found


PLACE = ("doc_id", "text_hash", "line_no")


def maybe(rows: DataFrame, wanted: KeyFilter, keep: bool = True) -> DataFrame:
    """The rows whose ``h1`` the filter may hold, or (``keep`` false) the others."""
    held, bits = wanted.tester()

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bitmap, bits, batch.column("h1").to_numpy()) == keep))

    return rows.mapInArrow(run, rows.schema)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """``h1, h2, first`` of the lines that come up twice or more and their first place."""
    counted = lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"))
    return saved(counted.where("copies > 1").drop("copies"), "repeated-lines")


def distinct_keys(lines: DataFrame, several: KeyFilter) -> DataFrame:
    """``h1, keys`` of every distinct line. Most lines come up once and stay where they are; only the others are grouped."""
    with_keys = lines.where("keys IS NOT NULL").select("h1", "h2", "keys")
    again = maybe(with_keys, several).groupBy("h1", "h2").agg(F.first("keys").alias("keys"))
    return saved(maybe(with_keys, several, keep=False).select("h1", "keys").unionByName(again.select("h1", "keys")), "line-keys")


def group_members(groups: DataFrame) -> DataFrame:
    """``g1, g2, h1, left``: the members of groups ``ids, left``; equal groups, of several bands, become one."""
    once = groups.groupBy(F.xxhash64("ids", "left").alias("g1"), F.hash("ids", "left").alias("g2")).agg(F.first("ids").alias("ids"), F.first("left").alias("left"))
    once = once.select("g1", F.when(F.col("g2") == 0, 1).otherwise(F.col("g2")).alias("g2"), F.explode(F.arrays_zip("ids", "left")).alias("m"))
    return once.select("g1", "g2", F.col("m.ids").alias("h1"), F.col("m.left").alias("left"))


def left_apart(buckets: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """``ids, left``: pairs of blocks of each bucket (``key, h1``) in which every line outside the bucket's largest component
    of ``known`` meets all other lines of the bucket. A bucket of one component has none."""
    of = saved(buckets.join(known, buckets.h1 == known.node, "left").select("key", "h1", F.coalesce("component", "h1").alias("c")), "bucket-components")
    sizes = of.groupBy("key", "c").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")).where("n > n_main")
    blocks = [F.ceil(n / block).cast("int") for n in (F.col("n") - F.col("n_main"), F.col("n_main"))]
    most = saved(most.select("key", "main", blocks[0].alias("rest"), blocks[1].alias("mains")), "largest-components")
    is_rest = F.col("c") != F.col("main")
    own = F.when(is_rest, F.pmod(F.xxhash64("h1"), "rest")).otherwise(F.col("rest") + F.pmod(F.xxhash64("h1"), "mains")).cast("int")
    others = F.when(is_rest, F.expr("sequence(0, rest + mains - 1)")).otherwise(F.expr("sequence(0, rest - 1)"))
    dealt = of.join(broadcast_rows(most), "key").select("key", "h1", own.alias("own"), F.explode(others).alias("other"))
    pairs = dealt.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.sort_array(F.collect_list(F.struct("own", "h1"))).alias("members"))
    pairs = pairs.where((F.size("members") > 1) & ((F.col("lo") == F.col("hi")) | (F.col("members")[0]["own"] != F.element_at("members", -1)["own"])))
    return pairs.select(F.transform("members", lambda m: m["h1"]).alias("ids"), F.transform("members", lambda m: (m["own"] == F.col("lo")) | (F.col("lo") == F.col("hi"))).alias("left"))


def compared(docs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of the lines of each group (``g1, g2, h1, left``) by the exact similarity of their shingle sets."""
    members = saved(members, "line-members")
    texts = wanted_lines(docs, KeyFilter(members.select("h1").distinct(), "h1")).groupBy("h1", "h2").agg(F.first("line").alias("line")).select("h1", "line")
    together = members.join(texts, "h1").groupBy("g1", "g2").agg(F.collect_list(F.struct("h1", "line", "left")).alias("members")).select("members")

    def verify():
        def work(batch: pa.RecordBatch) -> list:
            found, members = [], batch.column("members")
            sizes = members.value_lengths().to_pylist()
            names, lines, left = (members.flatten().field(k) for k in range(3))
            begin = end = done = 0
            for i, n in enumerate(sizes):
                end += n
                # some groups at a time, so that the sets of a whole batch never lie in memory
                if pc.sum(pc.binary_length(lines.slice(begin, end - begin))).as_py() < VERIFY and i + 1 < len(sizes):
                    continue
                part = [x.slice(begin, end - begin).to_pylist() for x in (names, lines, left)]
                sets, at = [x for run in text_chunks(part[1]) for x in shingle_sets(run)], 0
                for size in sizes[done : i + 1]:
                    k, at = at, at + size
                    found += block_links(part[0][k:at], sets[k:at], None if all(part[2][k:at]) else part[2][k:at], similarity)
                begin, done = end, i + 1
            return [[a for a, _ in found], [b for _, b in found]]

        return work

    return map_batches(together, "a long, b long", verify)


def line_links(docs: DataFrame, block: int = BLOCK, similarity: float = SIMILARITY, distinct: DataFrame | None = None) -> DataFrame:
    """``a, b``: ids of lines (``h1``) that are similar, enough of them to join each component. ``distinct``: the lines' keys,
    if they are known."""
    if distinct is None:
        lines = saved(lines_of(docs), "lines")
        distinct = distinct_keys(lines, KeyFilter(repeated_lines(lines).select("h1").distinct(), "h1"))
    counts = saved(bucket_counts(distinct).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "line-buckets")
    held, bits = KeyFilter(counts, "key").tester()

    def shared():
        bitmap = np.frombuffer(held.value, np.uint64)

        def work(batch: pa.RecordBatch) -> list:
            keys = bucket_numbers(key_values(batch.column("keys")))
            pick = may_hold(bitmap, bits, keys)
            return [np.repeat(batch.column("h1").to_numpy(), BANDS)[pick], keys[pick]]

        return work

    several = map_batches(distinct, "h1 long, key long", shared).join(counts, "key")
    # each block with the first one: no more than two rows for each line of a bucket
    own = F.pmod(F.xxhash64("h1"), "blocks").cast("int")
    part = F.when(own == 0, F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1)))).otherwise(F.array(own))
    dealt = several.withColumn("part", F.explode(part)).groupBy("key", "part").agg(F.sort_array(F.collect_list("h1")).alias("ids"), F.max("blocks").alias("blocks"))
    groups = dealt.where("size(ids) > 1").select("key", "ids", ((F.col("blocks") == 1) & (F.size("ids") <= SMALL)).alias("small"), (F.col("blocks") > 2).alias("parted"))
    groups = saved(groups, "line-groups")
    # near copies share many bands: the small groups of a line, at most one for each band, are one comparison
    small = groups.where("small").select(F.col("ids")[0].alias("g1"), F.lit(0).alias("g2"), F.explode("ids").alias("h1"), F.lit(True).alias("left")).distinct()
    large = groups.where("NOT small").select("ids", F.transform("ids", lambda x: F.lit(True)).alias("left"))
    found = saved(compared(docs, small.unionByName(group_members(large)), similarity), "line-links")
    parted = saved(groups.where("parted").select("key", F.explode("ids").alias("h1")).distinct(), "parted-buckets")
    if parted.isEmpty():
        return found
    known = saved(components(found), "known-links")
    apart = left_apart(parted, known, block)
    return known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(compared(docs, group_members(apart), similarity))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, removed array<int>`` of every text that loses lines: their numbers.

    Most lines are like no other: only lines that come up twice, or are in a component, are named and joined.
    """
    lines = saved(lines_of(docs), "lines")
    repeated = repeated_lines(lines)
    distinct = distinct_keys(lines, KeyFilter(repeated.select("h1").distinct(), "h1"))
    joined = saved(components(line_links(docs, similarity=similarity, distinct=distinct)), "line-components")
    places = lines.select(*PLACE, "h1", "h2")
    alone = repeated.join(joined, repeated.h1 == joined.node, "left_anti").select("h1", "h2", F.col("h1").alias("component"), F.col("h2").alias("alone"), "first")
    # lines of a component: their first places, from the few that the filter lets through
    firsts = maybe(places, KeyFilter(joined.select("node"), "node")).groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"))
    firsts = firsts.join(joined, F.col("h1") == F.col("node"))
    named = saved(alone.unionByName(firsts.select("h1", "h2", "component", F.lit(None).cast("long").alias("alone"), "first")), "named-lines")
    least = named.groupBy("component", "alone").agg(F.min("first").alias("kept"))
    kept = named.join(least, (named.component == least.component) & named.alone.eqNullSafe(least.alone)).select("h1", "h2", "kept")
    found = maybe(places, KeyFilter(named.select("h1").distinct(), "h1")).join(kept, ["h1", "h2"])
    judged = found.where(~F.struct(*PLACE).eqNullSafe(F.col("kept")))
    return judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def lines_left(text: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers, in time linear in both."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    both = F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda s: F.transform(s["k"], lambda i: F.get(s["l"], i)))
    return F.array_join(F.element_at(both, 1), "\n")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text of every row cut down to the lines that stay; all rows and columns are kept."""
    found = removed_lines(docs.select("doc_id", "text"), similarity)
    gone = found.select(F.struct("doc_id", "text_hash", "removed").alias(unused_name("gone", docs)))
    name = gone.columns[0]
    own = gone[name]
    joined = docs.join(gone, docs.doc_id.cast("long").eqNullSafe(own["doc_id"]) & (F.xxhash64(docs.text) == own["text_hash"]), "left")
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(lines_left(F.col("text"), F.col(name)["removed"]))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def unused_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no column of it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed`` of every document and the line numbers that were taken out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = removed_lines(docs)
    with_word = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^ \t\n\x0B\f\r]")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(with_word), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    joined = rows.join(found.withColumnRenamed("doc_id", "found_id"), rows.doc_id.eqNullSafe(F.col("found_id")) & (rows.text_hash == found.text_hash), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))
