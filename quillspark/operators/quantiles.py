"""Exact per-group quantiles (linear interpolation) without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here:

1. a histogram ``(group, value, count)`` is built with map-side partial counts;
2. ``percentile_approx`` (a bounded sketch) gives each group ``n_buckets - 1`` cut points; a
   histogram row's bucket is ``#cuts < value``, so equal values share a bucket;
3. bucket totals (at most ``n_buckets`` rows per group) turn the wanted ranks
   ``lo = floor((n - 1) p)`` and ``lo + 1`` into (bucket, rank inside the bucket); only the values of
   those buckets get their rank range, from a running count inside their (group, bucket) partition;
4. a join with those few targets picks the two values, interpolated as numpy does
   (``a + (b - a) t`` for ``t < 0.5``, else ``b - (b - a)(1 - t)``).

The cut points only balance the work; the result is exact for any cut points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, group: str, value: str, probs, n_buckets: int = 64,
                    accuracy: int = 10000, names=None, with_min_max: bool = False, count: str | None = None) -> DataFrame:
    """``(group, n, q_0 .. q_k[, min, max])`` over the non-null ``value`` rows of each group.

    ``count`` names a column that says how many rows each row of ``df`` stands for.
    """
    names = names or [f"q_{i}" for i in range(len(probs))]
    # the group filter is stated here so that the histogram's plan is the same in all of its uses
    times = F.col(count) if count else F.lit(1)
    vals = df.select(group, F.col(value).cast("double").alias("__v"), times.cast("bigint").alias("__c")).where(
        F.col("__v").isNotNull() & F.col(group).isNotNull())
    hist = vals.groupBy(group, "__v").agg(F.sum("__c").alias("__c"))

    # per group: size, extremes and cut points that deal the distinct values out evenly
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    sketch = F.percentile_approx("__v", cuts, accuracy) if cuts else F.array().cast("array<double>")
    meta = hist.groupBy(group).agg(F.sum("__c").alias("__n"), sketch.alias("__cuts"),
                                   F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    hb = hist.join(meta.select(group, "__cuts"), group).select(
        group, "__v", "__c", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__bk"))

    # rank offset of each bucket (at most n_buckets rows per group)
    totals = hb.groupBy(group, "__bk").agg(F.sum("__c").alias("__bc"))
    upto = Window.partitionBy(group).orderBy("__bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(group, "__bk", "__bc", (F.sum("__bc").over(upto) - F.col("__bc")).alias("__before"))

    # the two ranks around every requested position, as (bucket, rank inside the bucket)
    n = F.col("__n")
    arms = []
    for i, p in enumerate(probs):
        lo = F.floor((n - 1).cast("double") * F.lit(float(p))).cast("bigint")
        arms += [F.struct(F.lit(i).alias("__pi"), F.lit(0).alias("__side"), lo.alias("__r")),
                 F.struct(F.lit(i).alias("__pi"), F.lit(1).alias("__side"), F.least(lo + 1, n - 1).alias("__r"))]
    targets = meta.select(group, "__n", "__min", "__max", F.explode(F.array(*arms)).alias("__t")).select(
        group, "__n", "__min", "__max", "__t.*")
    targets = targets.join(offsets, group).where(
        (F.col("__r") >= F.col("__before")) & (F.col("__r") < F.col("__before") + F.col("__bc")))
    targets = targets.select(group, "__bk", "__n", "__min", "__max", "__pi", "__side",
                             (F.col("__r") - F.col("__before")).alias("__rl"))

    # rank range [first, last] of every distinct value of the buckets that hold a target
    within = Window.partitionBy(group, "__bk").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = hb.join(targets.select(group, "__bk").distinct(), [group, "__bk"], "left_semi")
    ranked = wanted.select(group, "__bk", "__v", (F.sum("__c").over(within) - 1).alias("__last"), "__c")
    ranked = ranked.withColumn("__first", F.col("__last") - F.col("__c") + 1)

    hit = ranked.join(targets, [group, "__bk"]).where(
        (F.col("__rl") >= F.col("__first")) & (F.col("__rl") <= F.col("__last")))
    aggs = []
    for i in range(len(probs)):
        for side in (0, 1):
            aggs.append(F.max(F.when((F.col("__pi") == i) & (F.col("__side") == side), F.col("__v"))).alias(f"__v{i}_{side}"))
    pairs = hit.groupBy(group, "__n", "__min", "__max").agg(*aggs)

    cols = [group, F.col("__n").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        t = h - F.floor(h)
        a, b = F.col(f"__v{i}_0"), F.col(f"__v{i}_1")
        cols.append(F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (F.lit(1.0) - t)).alias(names[i]))
    if with_min_max:
        cols += [F.col("__min").alias("min"), F.col("__max").alias("max")]
    return pairs.select(*cols)
