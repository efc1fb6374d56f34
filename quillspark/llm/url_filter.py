"""URL filters by a sort-merge range join (operator 11), in DataFrame expressions only.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's. Its key is the
reversed host, a slash and the path (``org.example//es/``): the urls that it fits at its own host level are exactly the keys
that start with it, one interval of the sort order. A url has one key for each of its host's levels that rules use. Rules
and url keys are sorted together by range partitions; the sweep keeps the stack of rules that are open at the last rule
passed, and each url key takes the deepest of them that is still open there. Over a url's levels the longest rule wins.

Prefix intervals are nested or apart, so the stack of a rule is what the rule before left open, and the rule itself. Rules
are folded in blocks of ``BLOCK``; what a block leaves open is handed on from the block summaries. Url keys that are equal
spread over range partitions by row, and each partition starts with the last rule before it, so no key gathers in a task.

Defined results: host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path goes on
from there up to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty. The longest rule is the one
with most characters of host and path; of equally long ones the one with the longer host. Rules that repeat host and path
count once, ``block`` before ``allow``. Rules with a null host or path are no rules; an empty host fits every url. Without a
fitting rule the verdict is ``default`` and the rule null. Repeated rows and repeated or null page_ids are rows of their own.
Other columns are ignored. Empty tables: no pages give no rows, no rules give the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import local_table, read_table

from .common import broadcast_rows, lower_ascii, saved

#: Rules folded in one row.
BLOCK = 1024
OPEN = "array<struct<key:string,total:int,host_len:int,rule:string,verdict:string>>"
FIXED_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """``host, path`` of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    """Labels of a host from the last to the first; none of an empty one."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.", -1)))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, host_key, levels, stack`` of each rule: the rules open at its key, itself last."""
    host, path = lower_ascii(F.col("host")), F.col("path")
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    labels = _labels(F.col("host"))
    fields = [
        _key(labels, F.col("path")).alias("key"), (F.length("host") + F.length("path")).alias("total"), F.length("host").alias("host_len"),
        F.concat("host", "path").alias("rule"), F.col("verdict"),
    ]
    keyed = known.select(F.array_join(labels, ".").alias("host_key"), F.size(labels).alias("levels"), *fields)
    dealt = saved(saved(keyed, "rules").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "rules-by-key")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    chunks = dealt.withColumn("chunk", F.floor((place - 1) / block))
    one = F.struct("key", "total", "host_len", "rule", "verdict", "host_key", "levels")
    blocks = chunks.groupBy("part", "chunk").agg(F.sort_array(F.collect_list(one)).alias("r"))

    def still_open(stack: Column, key: Column) -> Column:
        return F.filter(stack, lambda e: key.startswith(e["key"]))

    def push(state: Column, r: Column) -> Column:
        entry = F.struct(r["key"], r["total"], r["host_len"], r["rule"], r["verdict"])
        now = F.concat(still_open(state["open"], r["key"]), F.array(entry)).cast(OPEN)
        return F.struct(now.alias("open"), F.concat(state["each"], F.array(now)).alias("each"))

    nothing = F.array().cast(OPEN)
    start = F.struct(nothing.alias("open"), F.array().cast(f"array<{OPEN}>").alias("each"))
    folded = saved(blocks.withColumn("s", F.aggregate("r", start, push)), "rule-blocks")

    # what the blocks before leave open at each block's start
    ends = folded.agg(F.sort_array(F.collect_list(F.struct("part", "chunk", F.element_at("r", -1)["key"].alias("last"), F.col("s.open").alias("open")))).alias("b"))

    def hand_on(state: Column, b: Column) -> Column:
        here = F.struct(b["part"].alias("part"), b["chunk"].alias("chunk"), state["open"].alias("before"))
        return F.struct(F.concat(still_open(state["open"], b["last"]), b["open"]).cast(OPEN).alias("open"), F.concat(state["each"], F.array(here)).alias("each"))

    begin = F.struct(nothing.alias("open"), F.array().cast(f"array<struct<part:int,chunk:bigint,before:{OPEN}>>").alias("each"))
    before = ends.select(F.inline(F.aggregate("b", begin, hand_on)["each"]))
    each = folded.join(before, ["part", "chunk"]).select("before", F.explode(F.arrays_zip("r", F.col("s.each").alias("each"))).alias("x"))
    stack = F.concat(still_open(F.col("before"), F.col("x.r.key")), F.col("x.each"))
    return saved(each.select("x.r.key", "x.r.host_key", "x.r.levels", stack.alias("stack")), "rule-stacks")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url)."""
    host, path = url_parts(F.col("url"))
    rows = saved(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path")), "urls")
    stacks = rule_stacks(rules)
    low, high = stacks.agg(F.min("levels"), F.max("levels")).first()
    if high is None:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # one key for each level of the host that rules use
    split = rows.withColumn("labels", _labels(F.col("host"))).withColumn("top", F.least(F.size("labels"), F.lit(high)))
    levels = split.where(F.col("top") >= low).select("rid", "path", "labels", F.explode(F.sequence(F.lit(low), "top")).alias("level"))
    host_keys = stacks.select("host_key").distinct()
    keyed = levels.withColumn("host_key", F.array_join(F.slice("labels", F.lit(1), F.col("level")), "."))
    hinted = broadcast_rows(host_keys)
    if hinted is not host_keys:  # else the sweep alone finds that no rule has this host
        keyed = keyed.join(hinted, "host_key", "left_semi")
    urls = keyed.select(F.concat("host_key", F.lit("/"), "path").alias("key"), F.lit(1).alias("kind"), "rid", F.lit(None).cast(OPEN).alias("stack"))

    # one sort of rules and url keys; a rule stands before the urls of the same key
    events = stacks.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("rid"), "stack").unionByName(urls)
    dealt = saved(events.repartitionByRange("key", "kind", "rid").withColumn("part", F.spark_partition_id()), "sweep")
    last = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))
    # one row for each range partition
    passed = last.select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    upto = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("here", F.last("stack", ignorenulls=True).over(upto)).where("kind = 1").join(broadcast_rows(passed), "part")
    fitting = F.filter(F.coalesce("here", "before"), lambda e: F.col("key").startswith(e["key"]))
    found = swept.select("rid", F.try_element_at(fitting, F.lit(-1)).alias("e")).where("e IS NOT NULL")
    best = found.groupBy("rid").agg(F.max(F.struct("e.total", "e.host_len", "e.rule", "e.verdict")).alias("e"))
    return rows.join(best, "rid", "left").select("page_id", "host", "path", F.col("e.rule").alias("rule"), F.coalesce("e.verdict", F.lit(default)).alias("verdict"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), local_table(spark, FIXED_RULES, ["host", "path", "verdict"]))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in FIXED_RULES)
SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT r, arg_max(v.host || v.path, length(v.host || v.path)) AS rule, arg_max(verdict, length(v.host || v.path)) AS verdict
      FROM p JOIN (VALUES {_RULES}) v(host, path, verdict) ON (p.host = v.host OR ends_with(p.host, '.' || v.host)) AND starts_with(p.path, v.path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""
