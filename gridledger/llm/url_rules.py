"""URL filters: a sorted sweep of rule intervals over reversed hosts, then over paths.

A host becomes a canonical key: its labels reversed, each ended by a dot (``net.example.``).
All subdomains of a rule's host share its key as a prefix, so the rule is the interval from the
key to the key followed by byte FF, which no UTF-8 text holds. Intervals of prefixes nest. The
interval ends become events that carry the stack of rules active from there on: an open event has
its ancestors and itself, a close event its ancestors. In key order, the last event before a url
is its stack. A second sweep does the same for the paths of each host on the stack.

The sweeps run once per salt: urls are dealt out by a hash, the few events go to every salt. No
host, however common, meets in one task, and urls need no join. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES = "host string, path string, verdict string"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict) triples; paths begin with ``/``."""
    return spark.createDataFrame(rules, RULES)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _SMALL)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def _after(key: Column) -> Column:
    return F.concat(key, F.unhex(F.lit("FF")))


def _host_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): the rule hosts active from each interval end on, outermost first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))).alias("level", "up"))
    chain = (above.join(hosts.withColumnRenamed("host", "up"), "up").groupBy("host")
             .agg(F.sort_array(F.collect_list(F.struct("level", "up")))["up"].alias("stack")))
    key = host_key(F.col("host"))
    opens = chain.select(key.alias("key"), F.lit(0).alias("kind"), "stack")
    closes = chain.select(_after(key).alias("key"), F.lit(0).alias("kind"), F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    return opens.unionByName(closes)


def _path_events(rules: DataFrame) -> DataFrame:
    """(rule_host, key, kind, top): the innermost rule active from each interval end on."""
    own = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    rows = rules.select("host", "path", own.alias("top"))
    length = F.length("path")
    shorter = rows.filter(length > 0).select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(0), length - 1), lambda i: F.substring("path", F.lit(1), i))).alias("up"))
    parents = (shorter.join(rows.select("host", F.col("path").alias("up"), F.col("top").alias("parent")), ["host", "up"])
               .groupBy("host", "path").agg(F.max_by("parent", F.length("up")).alias("parent")))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    key = F.col("path").cast("binary")
    opens = rows.select(F.col("host").alias("rule_host"), key.alias("key"), F.lit(0).alias("kind"), "top")
    closes = (rows.join(parents, ["host", "path"], "left")
              .select(F.col("host").alias("rule_host"), _after(key).alias("key"), F.lit(0).alias("kind"), F.coalesce("parent", none).alias("top")))
    return opens.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
               salts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest
    rule (host and path) wins, of equal lengths the longer host. Rules with a null are left out; two
    rules of one host and path block if one of them blocks. A url that is null or has no ``://`` has
    an empty host and path, fits no rule and gets ``default``, as does an empty rule table's every
    url. Repeated rows come back as often as they came in; other columns are not read.
    """
    spark = pages.sparkSession
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    rules = (rules.select(F.translate("host", _UPPER, _SMALL).alias("host"), "path", "verdict").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    urls = (pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url")).groupBy("page_id", "_url").agg(F.count(F.lit(1)).alias("copies"))
            .select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), "copies",
                    F.pmod(F.xxhash64("page_id", "_url"), F.lit(salts)).cast("int").alias("salt")))
    stack = F.last("stack", ignorenulls=True).over(Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    hosts = (urls.withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(1))
             .unionByName(_host_events(rules).withColumn("salt", every), allowMissingColumns=True)
             .withColumn("stack", stack).filter("kind = 1"))
    nested = hosts.select("salt", "page_id", "host", "path", "copies", F.explode_outer("stack").alias("rule_host"), F.col("path").cast("binary").alias("key"), "kind")
    top = F.last("top", ignorenulls=True).over(
        Window.partitionBy("salt").orderBy("rule_host", "key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = nested.unionByName(_path_events(rules).withColumn("salt", every), allowMissingColumns=True).withColumn("top", top).filter("kind = 1")
    fits = F.when(F.col("rule_host").isNotNull() & F.col("top.rule").isNotNull(),
                  F.struct(F.length("top.rule"), F.length("rule_host"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))
    best = found.groupBy("salt", "page_id", "host", "path", "copies").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                       F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
