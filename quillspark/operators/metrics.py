"""Agreement metrics per prompt: confusion counts, quadratic weighted kappa, Kendall tau-b.

Kappa is computed from five integer sums per prompt in one aggregation (no confusion matrix):
for contiguous integer labels the index distance equals the value distance, so

    kappa = 1 - n * sum((a-b)^2) / (n * sum(a^2) + n * sum(b^2) - 2 * sum(a) * sum(b))

Products use DECIMAL(38,0): BIGINT would overflow near 1e8 rows per prompt on a 0..60 scale.
Tau-b uses the contingency table (one row per distinct (a, b) pair) and 2-D prefix sums over a grid of its values where
they are few (labels, scores). Where they are many (real numbers) values are put into blocks: pairs of different blocks are
counted bit by bit of the block number, the others block by block, so no task sees more than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..sources.tables import score_range, with_range

DEC = "decimal(38,0)"
#: Distinct values of a side up to which tau-b's grid holds the values themselves; beyond, blocks of values.
GRID_VALUES = 1_000
#: Contingency cells of one block of values, and most blocks of a side (beyond that many cells, blocks grow).
BLOCK_CELLS, MOST_BLOCKS = 100_000, 2_000


def ordinal(c, labels=C.LEVEL_LABELS):
    """Label -> 0-based position in ``labels`` (null if absent)."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for i, lab in enumerate(labels):
        out = F.when(c == F.lit(lab), F.lit(i)) if out is None else out.when(c == F.lit(lab), F.lit(i))
    return out


def contingency(df: DataFrame, y1: str, y2: str, group: str = "prompt_id", labels=None) -> DataFrame:
    """``(group, a, b, c)``: count of rows per value pair, rows with a null group or value left out.

    The one data-sized shuffle of the metrics (with map-side partial counts); kappa, tau-b and the
    confusion counts are all computed from this table, whose size is bounded by the value domains.
    ``labels`` maps ordinal labels to their 0-based positions first.
    """
    a = ordinal(y1, labels) if labels is not None else F.col(y1)
    b = ordinal(y2, labels) if labels is not None else F.col(y2)
    pairs = df.select(group, a.alias("a"), b.alias("b")).where(
        F.col(group).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("c"))


def confusion_counts(df: DataFrame, y1: str, y2: str, group: str = "prompt_id") -> DataFrame:
    return contingency(df, y1, y2, group).select(group, F.col("a").alias("y1"), F.col("b").alias("y2"), F.col("c").alias("n"))


def qwk_from_cells(cells: DataFrame, spark: SparkSession, domain: C.ScoreDomain, group: str = "prompt_id",
                   digits: int = 3) -> DataFrame:
    """``(group, n, qwk)`` from a contingency table, over pairs whose both values are labels."""
    if domain.labels is None:
        cells = with_range(cells, spark, domain, group).where(
            F.col("a").between(F.col("s_min"), F.col("s_max")) & F.col("b").between(F.col("s_min"), F.col("s_max")))
    a, b, c = F.col("a").cast("bigint"), F.col("b").cast("bigint"), F.col("c")
    sums = cells.groupBy(group).agg(
        F.sum(c).alias("n"),
        F.sum(c * a).alias("sa"), F.sum(c * b).alias("sb"),
        F.sum(c * a * a).alias("saa"), F.sum(c * b * b).alias("sbb"),
        F.sum(c * (a - b) * (a - b)).alias("sdd"),
    )
    n = F.col("n").cast(DEC)
    num = n * F.col("sdd").cast(DEC)
    den = n * F.col("saa").cast(DEC) + n * F.col("sbb").cast(DEC) - F.lit(2).cast(DEC) * F.col("sa").cast(DEC) * F.col("sb").cast(DEC)
    kappa = F.lit(1.0) - F.try_divide(num.cast("double"), F.nullif(den, F.lit(0).cast(DEC)).cast("double"))
    return sums.select(group, "n", F.bround(kappa, digits).alias("qwk"))


def qwk(df: DataFrame, spark: SparkSession, y1: str, y2: str, domain: C.ScoreDomain,
        group: str = "prompt_id", digits: int = 3) -> DataFrame:
    """``(group, n, qwk)`` per group present after the domain filter; qwk rounded half-even."""
    return qwk_from_cells(contingency(df, y1, y2, group, domain.labels), spark, domain, group, digits)


def macro_report(per_group: DataFrame, group: str = "prompt_id", metric: str = "qwk", digits: int = 3) -> DataFrame:
    """Per-group rows plus an ``average`` row: mean of the already rounded values, rounded again.

    The average is null if any group's value is null. Group keys become strings.
    """
    # A rollup over the per-group table (one row per group) yields the group rows and the total row
    # in one pass, so the upstream pipeline is not evaluated twice as a union would do.
    r = per_group.rollup(group).agg(
        F.grouping_id().alias("__gid"),
        F.sum("n").alias("n"),
        F.when(F.count(metric) == F.count(F.lit(1)), F.bround(F.avg(metric), digits)).alias(metric),
    )
    key = F.when(F.col("__gid") == 1, F.lit("average")).otherwise(F.col(group).cast("string"))
    return r.select(key.alias(group), F.col("n").cast("bigint").alias("n"), metric)


def kendall_tau_b(df: DataFrame, y1: str, y2: str, group: str = "prompt_id", digits: int = 3) -> DataFrame:
    """``(group, n, kendall_tau)``: tau-b with tie correction, rounded half-even.

    S = concordant - discordant is summed over contingency cells:
    S = sum_c n_c * (P_c - Q_c), with P_c (Q_c) the count of observations with a smaller ``a``
    and a smaller (larger) ``b``. Values may be labels, scores or real numbers of any count; the result is exact.
    """
    return tau_from_cells(contingency(df, y1, y2, group), group, digits)


def tau_from_cells(cells: DataFrame, group: str = "prompt_id", digits: int = 3, grid_values: int = GRID_VALUES,
                   block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Tau-b from a contingency table ``(group, a, b, c)``, written once: it is read several times."""
    from ..sources.sinks import materialize

    cells = materialize(cells.sparkSession, cells.where(F.col(group).isNotNull() & (F.col("c") > 0)), "contingency")
    sizes = cells.groupBy(group).agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.count("*").alias("n"))
    most = sizes.agg(F.max(F.greatest("na", "nb")), F.max("n")).first()
    if (most[0] or 0) <= grid_values:
        score = grid_score(cells, group)
    else:
        score = blocked_score(cells, group, min(MOST_BLOCKS, max(2, -(-most[1] // block_cells))))
    counted = cells.groupBy(group).agg(F.sum("c").alias("n")).join(tied_pairs(cells, "a", group, "xtie"), group).join(tied_pairs(cells, "b", group, "ytie"), group)
    out = counted.join(score, group)
    tot = F.col("n").cast(DEC) * (F.col("n") - 1).cast(DEC) / 2
    dx = (tot - F.col("xtie")).cast("double")
    dy = (tot - F.col("ytie")).cast("double")
    out = out.withColumn("__tau", F.when((dx > 0) & (dy > 0), F.col("S").cast("double") / F.sqrt(dx) / F.sqrt(dy)))
    # clamp to [-1, 1] keeping null (greatest/least would turn null into a bound)
    tau = F.when(F.col("__tau") > 1.0, F.lit(1.0)).when(F.col("__tau") < -1.0, F.lit(-1.0)).otherwise(F.col("__tau"))
    return out.select(group, "n", F.bround(tau, digits).alias("kendall_tau"))


def tied_pairs(cells: DataFrame, side: str, group: str, out: str) -> DataFrame:
    """``(group, out)``: pairs of observations that share their value of one side."""
    t = F.col("t").cast(DEC)
    return cells.groupBy(group, side).agg(F.sum("c").alias("t")).groupBy(group).agg((F.sum(t * (t - 1)) / 2).alias(out))


def grid_score(cells: DataFrame, group: str) -> DataFrame:
    """``(group, S)`` by 2-D prefix sums over the dense grid of the group's distinct a-values x distinct b-values, with
    running-sum windows whose partitions are one grid column or row."""
    # the group's distinct values (bounded by its value domain or its blocks, not by rows), crossed by two explodes
    values = cells.groupBy(group).agg(F.collect_set("a").alias("__as"), F.collect_set("b").alias("__bs"))
    grid = values.select(group, F.explode("__as").alias("a"), "__bs").select(group, "a", F.explode("__bs").alias("b"))
    grid = grid.join(cells, [group, "a", "b"], "left").fillna(0, subset=["c"])
    col = Window.partitionBy(group, "b").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("colcum", F.coalesce(F.sum("c").over(col), F.lit(0)))
    row = Window.partitionBy(group, "a").orderBy("b")
    grid = grid.select(
        "*",
        F.coalesce(F.sum("colcum").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("P"),
        F.coalesce(F.sum("colcum").over(row.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("Q"),
    )
    return grid.groupBy(group).agg(F.sum(F.col("c").cast(DEC) * (F.col("P") - F.col("Q")).cast(DEC)).alias("S"))


def blocked_score(cells: DataFrame, group: str, blocks: int) -> DataFrame:
    """``(group, S)`` for many values: pairs of different a-blocks and b-blocks by ``prefix_score``, the others inside.

    Cut points are approximate quantiles of each side, counted in cells; a cut point is a block of its own, so a value with
    very many cells never shares one (it ties with itself and needs no count). Pairs of the same a-block plus pairs of the
    same b-block, less those that share both, are counted block by block, one call a block. Approximate cuts change block
    sizes, never results.
    """
    from ..sources.sinks import materialize

    shares = [i / blocks for i in range(1, blocks)]
    cuts = cells.groupBy(group).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(side, shares, 10_000))).alias(f"cuts_{side}") for side in "ab"])
    d = cells.join(cuts, group)  # one row per group; the planner broadcasts it if it is small
    d = d.select(group, "a", "b", "c", *[block_number(F.col(f"cuts_{side}"), F.col(side), blocks).alias(f"block_{side}") for side in "ab"])
    d = materialize(cells.sparkSession, d, "blocked-cells")
    parts = [prefix_score(d.groupBy(group, F.col("block_a").alias("a"), F.col("block_b").alias("b")).agg(F.sum("c").alias("c")), group)]
    parts.append(_inside(d.where("block_a % 2 = 0"), group, "block_a", "block_b"))  # odd blocks hold one value: ties only
    parts.append(_inside(d.where("block_b % 2 = 0"), group, "block_b"))
    out = parts[0].select(group, F.col("S").cast(DEC).alias("S"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(group).agg(F.sum("S").alias("S"))


def block_number(cuts, value, blocks: int):
    """Twice the number of cut points below the value, one more if it is a cut point, by bisection."""
    steps = [1 << k for k in reversed(range(max(blocks, 2).bit_length()))]
    below = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))
    both = F.transform(F.array(below), lambda at: 2 * at + F.coalesce(F.get(cuts, at) == value, F.lit(False)).cast("int"))
    return both[0]


def prefix_score(cells: DataFrame, group: str) -> DataFrame:
    """``(group, S)`` of cells whose ``a`` and ``b`` are small numbers, without a grid: by bits of ``b``, from the highest on,
    two cells are told apart at one bit, and there the counts of bit 0 with smaller and greater ``a`` are summed for each ``a``.

    Cells times bits are grouped; a window holds at most one row for each ``a``.
    """
    bits = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("most"), F.lit(1)))).cast("int")))
    most = cells.groupBy(group).agg(F.max("b").alias("most"))
    d = cells.join(most, group).select(group, "a", "b", "c", bits.alias("bit"))
    one = F.expr("shiftright(b, bit) & 1") == 1
    d = d.groupBy(group, "bit", F.expr("shiftright(b, bit + 1)").alias("prefix"), "a").agg(
        F.sum(F.when(~one, F.col("c")).otherwise(0)).alias("zeros"), F.sum(F.when(one, F.col("c")).otherwise(0)).alias("ones"))
    w = Window.partitionBy(group, "bit", "prefix").orderBy("a")
    less = F.coalesce(F.sum("zeros").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.coalesce(F.sum("zeros").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    d = d.select(group, "ones", (less - more).alias("gain"))
    return d.groupBy(group).agg(F.sum(F.col("ones").cast(DEC) * F.col("gain").cast(DEC)).alias("S"))


def _inside(d: DataFrame, group: str, by: str, apart: str | None = None) -> DataFrame:
    """``(group, S)`` of the pairs of cells inside each block, but for those that share their block ``apart`` as well."""
    schema = d.select(group).schema.fields[0]

    def count(key, table):
        import pyarrow as pa

        points = [table.column(c).to_numpy() for c in ("a", "b", "c")]
        s = pair_score(*points)
        if apart:
            s -= pair_score(*points, table.column(apart).to_numpy())
        return pa.Table.from_arrays([pa.array([key[0].as_py()], table.column("g").type), pa.array([str(s)])], names=["g", "S"])

    kept = [by, *([apart] if apart else [])]
    rows = d.select(F.col(group).alias("g"), *kept, "a", "b", "c").groupBy("g", by).applyInArrow(count, f"g {schema.dataType.simpleString()}, S string")
    return rows.select(F.col("g").alias(group), F.col("S").cast(DEC).alias("S"))


def pair_score(a, b, c, part=None) -> int:
    """Concordant less discordant pairs of weighted points: by bits of the rank of b, from the highest on, two points are
    told apart at one bit, and there the points of bit 0 with smaller and greater a are counted for each point of bit 1.
    With ``part``, pairs of the same part only."""
    import numpy as np

    ra, rb = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (a, b))
    part = np.zeros(len(ra), np.int64) if part is None else np.unique(part, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(ra, kind="stable")
    ra, rb, c, part = ra[order], rb[order], np.asarray(c)[order].astype(np.int64), part[order]
    wide = int(c.sum()) ** 2 >= 1 << 62
    width, total = int(ra.max()) + 1 if len(ra) else 1, 0
    bits = int(rb.max()).bit_length() if len(rb) else 0
    for bit in range(bits):
        prefix = part << bits | rb >> (bit + 1)
        at = np.argsort(prefix, kind="stable")  # by prefix, then by a
        key, one, w = prefix[at] * width + ra[at], (rb[at] >> bit) & 1, c[at]
        before = np.concatenate([[0], np.cumsum(w * (1 - one))])
        high = np.flatnonzero(one)
        first, last = (np.searchsorted(key, (key[high] // width + e) * width) for e in (0, 1))
        less = before[np.searchsorted(key, key[high], "left")] - before[first]
        more = before[last] - before[np.searchsorted(key, key[high], "right")]
        gain = less - more
        total += sum(int(x) * int(y) for x, y in zip(w[high], gain)) if wide else int((w[high] * gain).sum())
    return total


def eval_report(df: DataFrame, spark: SparkSession, y1: str, y2: str, domain: C.ScoreDomain,
                group: str = "prompt_id") -> DataFrame:
    """``(prompt_id, qwk, kendall_tau)``: one row per listed prompt (empty ones get nulls), or per prompt present if the
    domain lists none."""
    return report_from_cells(contingency(df, y1, y2, group), spark, domain, group)


def cells_of(counted: DataFrame, y1: str, y2: str, group: str = "prompt_id", labels=None, count: str = "c") -> DataFrame:
    """``(group, a, b, c)`` from a table whose rows stand for ``count`` rows each (see ``contingency``)."""
    a = ordinal(y1, labels) if labels is not None else F.col(y1)
    b = ordinal(y2, labels) if labels is not None else F.col(y2)
    pairs = counted.select(group, a.alias("a"), b.alias("b"), F.col(count).alias("c")).where(
        F.col(group).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    return pairs.groupBy(group, "a", "b").agg(F.sum("c").alias("c"))


def report_from_cells(cells: DataFrame, spark: SparkSession, domain: C.ScoreDomain, group: str = "prompt_id") -> DataFrame:
    """``eval_report`` from a contingency table."""
    q = qwk_from_cells(cells, spark, domain, group).select(group, "qwk")
    t = tau_from_cells(cells, group).select(group, "kendall_tau")
    prompts = score_range(spark, domain).select(group) if domain.ranges else cells.select(group).distinct()
    return prompts.join(q, group, "left").join(t, group, "left")


def dropped_report(df: DataFrame, value: str, group: str = "prompt_id", count: str | None = None) -> DataFrame:
    """Rows, kept rows (non-null ``value``) and dropped rows, per group, of rows without a group (``none``, if there are
    any) and overall (``all``: every row of ``df``). ``count``: how many rows each row of ``df`` stands for."""
    times = F.col(count) if count else F.lit(1).cast("bigint")
    per = df.groupBy(group).agg(F.sum(times).alias("n_rows"), F.coalesce(F.sum(F.when(F.col(value).isNotNull(), times)), F.lit(0)).alias("n_kept"))
    r = per.rollup(group).agg(F.grouping_id().alias("__gid"), F.sum("n_rows").alias("n_rows"), F.sum("n_kept").alias("n_kept"))
    key = F.when(F.col("__gid") == 1, F.lit("all")).otherwise(F.coalesce(F.col(group).cast("string"), F.lit("none")))
    return r.select(key.alias(group), F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_kept").cast("bigint").alias("n_kept"),
                    (F.col("n_rows") - F.col("n_kept")).cast("bigint").alias("n_dropped"))


def sample_ztest(full: DataFrame, sample: DataFrame, value: str = "score", group: str = "prompt_id",
                 critical: float = C.Z_CRITICAL_05) -> DataFrame:
    """Per group: is the sample mean of ``value`` consistent with the population (two-sided z)?

    ``z = (mean_sample - mean_pop) / (sd_pop / sqrt(n_sample))``.
    """
    pop = full.groupBy(group).agg(F.count(value).alias("n_pop"), F.avg(value).alias("mean_pop"),
                                  F.stddev_pop(value).alias("sd_pop"))
    smp = sample.groupBy(group).agg(F.count(value).alias("n_sample"), F.avg(value).alias("mean_sample"))
    j = pop.join(smp, group)
    z = F.try_divide(F.col("mean_sample") - F.col("mean_pop"),
                     F.try_divide(F.col("sd_pop"), F.sqrt(F.col("n_sample").cast("double"))))
    return j.select(group, "n_pop", "n_sample", "mean_pop", "mean_sample", "sd_pop", z.alias("z"),
                    (F.abs(z) > F.lit(critical)).alias("reject"))
