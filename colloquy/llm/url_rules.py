"""URL filtering as a sort-merge range join, with DataFrame functions only.

The canonical key of a host is its labels in reverse, each followed by a dot, so a host and all its
subdomains fill one interval of keys and intervals of rules are nested or apart. URLs and rules are
sorted together by that key over range partitions. A sweep along the keys carries the stack of the
last rule host that was passed, namely the rules of that host and of all hosts around it; those
whose interval has ended by a URL's key are popped by a prefix test. Each partition starts from the
stack at the end of those before it, of which there is one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, pick

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STACK = "array<struct<size:int,verdict:string,rule:string,key:string,path:string>>"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    path = F.regexp_extract(F.regexp_replace(after, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), path).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """key -> the rules of the host and of the hosts around it, longest first.

    ``rules`` has rule (``host/path``) and verdict. Of equal rules, block wins.
    """
    host, path = F.regexp_extract("rule", r"^[^/]*", 0), F.regexp_replace("rule", r"^[^/]*", "")
    own = rules.where("rule is not null").select("rule", "verdict", F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path"))
    own = own.where("host <> ''").withColumn("key", host_key(F.col("host")))
    entry = F.struct(F.length("rule").alias("size"), "verdict", "rule", "key", "path")
    per_host = own.groupBy("key").agg(F.collect_list(entry).alias("entries"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    around = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    nested = per_host.select("key", F.explode(around).alias("outer")).join(per_host.select(F.col("key").alias("outer"), "entries"), "outer")
    return nested.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("entries")), asc=False).cast(_STACK).alias("stack"))


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: the id, host, path, rule (null where none fits) and verdict (the rule's or ``default``).

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest
    wins, and of equally long ones block. A null URL or one without ``://`` has an empty host and path, which no rule fits. Ids may
    be null or repeat; an empty table gives no rows, an empty rule table only defaults. Other
    columns are not read.
    """
    spark = pages.sparkSession
    urls = pick(pages, page_id=(id_col, None), url=(url_col, "string")).select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", F.xxhash64("page_id").alias("tie"), "page_id", "host", F.lit(None).cast(_STACK).alias("stack"))
    starts = rule_stacks(rules).select("key", F.lit(0).alias("kind"), F.lit("").alias("path"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), "stack")
    order = ["key", "kind", "path", "tie"]
    events = urls.unionByName(starts).repartitionByRange(4 * partitions(spark), *order).withColumn("part", F.spark_partition_id())
    events = materialise(events, "url-events")

    ends = events.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    every = events.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "part", "left").withColumn("open", F.coalesce("top", "carried"))
    hit = F.filter("open", lambda x: F.startswith(F.col("key"), x["key"]) & F.startswith(F.col("path"), x["path"]))
    return swept.withColumn("hit", F.try_element_at(hit, F.lit(1))).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
