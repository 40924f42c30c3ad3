"""URL rules by a sort-merge range join: the longest rule that fits each url.

A host's labels are reversed (``www.a.com`` -> ``com.a.www.``), so the hosts
that a rule covers are the keys that start with the rule's key: an interval
[key, key + 0xFF). Intervals of one rule list are nested or apart. A sweep in
key order meets the interval ends and the urls; the last end before a url
carries the stack of rules active there. One sweep runs over hosts; a second
one over the paths of every rule host found active, where the top of the stack
is the longest rule path.

All of it is DataFrame expressions: the sweep is ``last(..., ignorenulls)`` in
a window over (zone, salt) in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import column, materialize, shuffle_tasks

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AFTER = b"\xff"                     # no UTF-8 text holds this byte: it sorts behind every continuation
_URL = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _sweep(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """``points`` (row, zone, key, ...) with the ``state`` of the last of
    ``bounds`` (zone, key, state) at or before each point's key in its zone.

    A zone with over 1 / (2 * shuffle tasks) of the points is dealt over salts
    and only its own bounds are copied to them. There are fewer than 2 * shuffle
    tasks such zones, which bounds the broadcast table.
    """
    share = 2 * shuffle_tasks(points.sparkSession)
    total = points.count()
    hot = F.broadcast(points.groupBy("zone").count().where(F.col("count") * share > total).select(
        "zone", F.ceil(F.col("count") * share / F.lit(max(total, 1))).alias("salts")))
    dealt = points.join(hot, "zone", "left").withColumn(
        "salt", F.pmod("row", F.coalesce("salts", F.lit(1)))).withColumn("kind", F.lit(1)).drop("salts")
    copied = bounds.join(hot, "zone", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))) \
        .withColumn("kind", F.lit(0)).drop("salts")
    order = Window.partitionBy("zone", "salt").orderBy("key", "kind")
    return dealt.unionByName(copied, allowMissingColumns=True) \
        .withColumn("state", F.last("state", ignorenulls=True).over(order)) \
        .where("kind = 1").drop("kind", "salt", "key", "zone")


def _interval(frame: DataFrame, inside: str, outside: str) -> DataFrame:
    """The two bounds of each interval: its start carries ``inside``, its end ``outside``."""
    return frame.select("zone", "key", F.col(inside).alias("state")).unionByName(
        frame.select("zone", F.concat("key", F.lit(_AFTER)).alias("key"), F.col(outside).alias("state")))


def _host_bounds(rules: DataFrame) -> DataFrame:
    """Bounds of the rule hosts of two or more labels; the state is the stack of active rule hosts.

    A stack is as deep as a host has labels at most. It is found by joining each
    host's shorter keys with the hosts of the list.
    """
    hosts = rules.select("host").distinct().withColumn("labels", _labels(F.col("host"))).where(F.size("labels") > 1) \
        .select("host", "labels", _key(F.col("labels")).alias("text_key"))
    outer = hosts.select("host", "labels", "text_key", F.explode(F.sequence(F.lit(2), F.size("labels"))).alias("n")) \
        .select("host", "labels", "text_key", _key(F.slice("labels", 1, F.col("n"))).alias("outer_key"))
    stacks = outer.join(hosts.select(F.col("text_key").alias("outer_key"), F.col("host").alias("outer")), "outer_key") \
        .groupBy("host", "labels", "text_key").agg(F.collect_set("outer").alias("stack"))
    return _interval(stacks.select(
        _zone(F.col("labels")).alias("zone"), F.encode("text_key", "UTF-8").alias("key"), "stack",
        F.array_remove("stack", F.col("host")).alias("below")), "stack", "below")


def _zone(labels: Column) -> Column:
    return _key(F.slice(labels, 1, 2))


def _path_bounds(rules: DataFrame) -> DataFrame:
    """Bounds of the rule paths of each rule host; the state is the longest active rule."""
    own = rules.withColumn("state", F.struct(F.length("path").alias("length"), "path", "verdict"))
    shorter = rules.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")) \
        .where(F.col("n") < F.length("path")) \
        .select("host", "path", F.expr("left(path, n)").alias("outer_path"))
    below = shorter.join(own.select("host", F.col("path").alias("outer_path"), "state"), ["host", "outer_path"]) \
        .groupBy("host", "path").agg(F.max("state").alias("below"))
    none = F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("path"),
                    F.lit(None).cast("string").alias("verdict"))
    return _interval(own.join(below, ["host", "path"], "left").select(
        F.col("host").alias("zone"), F.encode("path", "UTF-8").alias("key"), "state",
        F.coalesce("below", none).alias("below")), "state", "below")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) from pairs like ``("block", "example.com/en/")``."""
    rows = [(rule[:rule.find("/")] if "/" in rule else rule, rule[rule.find("/"):] if "/" in rule else "", verdict)
            for verdict, rule in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, row_id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``row_id``, host, path, rule, verdict.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains
    if the url's path starts with the rule's path; of the rules that fit, the
    longest (host and path together; then the longer host) decides. If one host
    and path has several verdicts, the alphabetically last one holds, so
    ``block`` beats ``allow``. Rules without a host are ignored.
    Where no rule fits, rule is null and the verdict ``default``. A null url, or
    one without ``://``, has an empty host and path. Repeated rows and null ids
    keep a row each; other columns are not read.
    """
    known = rules.where("host <> '' and verdict is not null") \
        .groupBy(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path")) \
        .agg(F.max("verdict").alias("verdict"))
    link = column(pages, url)
    urls = materialize(pages.select(
        F.monotonically_increasing_id().alias("row"), column(pages, row_id).alias("id"),
        url_host(link).alias("host"), url_path(link).alias("path")), "urls")
    labels = _labels(F.col("host"))
    stacked = _sweep(urls.withColumn("zone", _zone(labels)).withColumn("key", F.encode(_key(labels), "UTF-8")),
                     _host_bounds(known))
    # one-label rule hosts (``net``) cover whole zones: the last label always goes on to the second sweep
    active = F.array_union(F.coalesce("state", F.array().cast("array<string>")), F.array(F.element_at(labels, 1)))
    candidates = stacked.withColumn("zone", F.explode(active)).drop("state") \
        .withColumn("key", F.encode("path", "UTF-8")).withColumn("rule_host", F.col("zone"))
    found = _sweep(candidates, _path_bounds(known))
    fits = F.when(F.col("state.path").isNotNull(), F.struct(
        (F.length("rule_host") + F.col("state.length")).alias("length"), F.length("rule_host").alias("host_length"),
        F.concat("rule_host", "state.path").alias("rule"), F.col("state.verdict").alias("verdict")))
    best = found.groupBy("row").agg(F.max(fits).alias("best"), F.first("id").alias("id"),
                                    F.first("host").alias("host"), F.first("path").alias("path"))
    return best.select(F.col("id").alias(row_id), "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
