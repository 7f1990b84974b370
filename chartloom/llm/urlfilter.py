"""URL filters by a sort-merge range join, in DataFrame functions alone.

A rule is a host and a path; it fits urls of that host and its subdomains whose path starts with the rule's. The canonical key
of a rule is its host with the labels reversed, then its path (``net.example./en/``); as bytes, all keys that continue
it lie between the key and the key followed by 0xFF, a byte that UTF-8 never holds. A url has one key for each of its host's endings that is the
host of some rule (its *owners*), so a fitting rule is an interval around one of its keys. Keys and interval ends of an owner are
sorted together and swept once: a start pushes its rule on a stack of active nested rules, an end pops it, and a key takes the rule on
top, the longest one of that owner. Sweeping the rules alone first finds which rule lies below each on the stack, so
the state that the sweep carries is one rule. Of a url's owners the longest rule wins (host and path counted together; equal
length: the longer host).

Before anything is shuffled, urls are reduced to distinct hosts and path beginnings no longer than the longest rule's path, counted by
the tasks that scan them. An owner with more than ``SWEEP_ROWS`` keys is swept in parts that each see all its rules, and
the join back to the urls cuts hot keys into parts. Intervals of one owner meet in one task when the rules alone are sorted.

Cases: the host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered, ports and all; the path
follows, up to ``?``, ``#`` or the end. A null url, or one without ``://``, has empty host and path. Only whole labels count: ``xnet`` is no subdomain of ``net``. An
empty path starts with no ``/``. Urls without a fitting rule have a null rule and the default verdict. Of rules with equal host and path ``block`` wins;
rules that are null, have no verdict or no host are left out. Repeated rows and null ids each give their row. Empty tables
and extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chartloom.llm.common import only, table
from chartloom.operators.skew import skewed_join

#: The fixed rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SWEEP_ROWS = 1_000_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_START, _KEY = 0, 1  # order of events at one place; an interval's end is at a place of its own


def lowered(text: Column) -> Column:
    """Only A-Z are lowered."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def canonical(host: Column, path: Column) -> Column:
    """Reversed host labels, each followed by a period, then the path, as bytes."""
    return F.concat(F.concat_ws(".", F.reverse(labels(host))), F.lit("."), path).cast("binary")


def rule_table(rules: DataFrame) -> DataFrame:
    """``owner, path, rule, verdict, key``: each host and path once."""
    owner = lowered(F.substring_index("rule", "/", 1))
    return (
        only(rules, "rule", "verdict")
        .filter(F.col("verdict").isNotNull() & (owner != ""))
        .select(owner.alias("owner"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "verdict")
        .groupBy("owner", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("owner", "path", F.concat("owner", "path").alias("rule"), "verdict", canonical(F.col("owner"), F.col("path")).alias("key"))
    )


def _place(key: str, end: bool) -> Column:
    return F.concat(key, F.lit(bytearray(b"\xff"))) if end else F.col(key)


def stack_events(rules: DataFrame) -> DataFrame:
    """``owner, at, kind, top``: every start and end of a rule's interval, with the rule on top of the stack after it."""
    both = F.array(F.struct(_place("key", False).alias("at"), F.lit(1).alias("step")), F.struct(_place("key", True).alias("at"), F.lit(-1).alias("step")))
    top = F.struct("rule", "verdict")
    swept = rules.select("owner", top.alias("own"), F.inline(both)).withColumn(
        "depth", F.sum("step").over(Window.partitionBy("owner").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    # What lies below a rule is the last one that started a level above it. An end's depth is already that of the rule below.
    starts = swept.filter("step = 1")
    level = Window.partitionBy("owner", "depth").orderBy("at", "below").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = swept.filter("step = -1").select("owner", "depth", "at", F.lit(False).alias("below"), F.lit(None).cast(top_type(rules)).alias("own"))
    pops = (
        starts.select("owner", "depth", "at", F.lit(True).alias("below"), "own")
        .unionByName(ends)
        .withColumn("top", F.last(F.when(F.col("below"), F.col("own")), ignorenulls=True).over(level))
        .filter(~F.col("below"))
    )
    return starts.select("owner", "at", F.col("own").alias("top")).unionByName(pops.select("owner", "at", "top"))


def top_type(rules: DataFrame) -> str:
    return rules.select(F.struct("rule", "verdict")).schema[0].dataType.simpleString()


def fitting_rules(keys: DataFrame, rules: DataFrame, most_labels: int, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``host, prefix, best`` (``rule``, ``verdict``) of each distinct host and path beginning that some rule fits."""
    size = F.size(labels(F.col("host")))
    endings = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(most_labels))), lambda n: F.concat_ws(".", F.slice(labels(F.col("host")), size - n + 1, n)))
    candidates = keys.select("host", "prefix", F.explode(endings).alias("owner"))
    counts = candidates.groupBy("owner").count()
    parts = rules.select("owner").distinct().join(counts, "owner").select("owner", F.ceil(F.col("count") / F.lit(float(sweep_rows))).cast("int").alias("parts"))
    spread = ["host", "prefix"]
    asked = skewed_join(candidates, parts, ["owner"], spread_by=spread, freq=counts, hot_rows=sweep_rows).select(
        "owner",
        F.pmod(F.xxhash64(*spread), "parts").cast("int").alias("part"),
        canonical(F.col("owner"), F.col("prefix")).alias("at"),
        F.lit(_KEY).alias("kind"),
        F.struct(*spread).alias("asked"),
    )
    events = stack_events(rules).join(parts, "owner").select(
        "owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at", F.lit(_START).alias("kind"), F.struct("top").alias("state")
    )
    order = Window.partitionBy("owner", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(events, allowMissingColumns=True).withColumn("top", F.last("state", ignorenulls=True).over(order)["top"])
    best = F.max(F.struct(F.length("top.rule").alias("n"), F.length("owner").alias("n_host"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))
    return swept.filter((F.col("kind") == _KEY) & F.col("top").isNotNull()).groupBy("asked.host", "asked.prefix").agg(best.alias("best"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``) by ``rules`` (``rule, verdict``)."""
    known = rule_table(rules)
    longest, most_labels = known.agg(F.max(F.length("path")), F.max(F.size(labels(F.col("owner"))))).first()
    pages = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not most_labels:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pages = pages.withColumn("prefix", F.substring("path", 1, longest))
    counts = pages.groupBy("host", "prefix").count()
    fitting = fitting_rules(counts.select("host", "prefix"), known, most_labels, sweep_rows)
    return skewed_join(pages, fitting, ["host", "prefix"], "left", spread_by=["page_id", "path"], freq=counts, hot_rows=sweep_rows).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)
    return judge(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, rule)"))
