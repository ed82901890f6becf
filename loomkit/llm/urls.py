"""URL filters: captures against list entries active when they were fetched, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, stored

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"
BLOCK, ALLOW, WITHDRAW = "block", "allow", "withdraw"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a dot at the end; "" where there is none."""
    authority = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1))
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


_NUMERIC_HOST = r"^(\d+(\.\d+)*|\[.*\]?)$"


def keys(url: Column) -> Column:
    """The list keys that cover a URL, with their rank: its host and the domains above it down to two labels (their number), host and first part of the path (1000). An address of numbers has no domains above it."""
    own = host(url)
    labels = F.split(own, r"\.")
    n = F.size(labels)
    part = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")),
    )
    path = F.array(F.struct(F.concat_ws("/", own, part).alias("key"), F.lit(1000).alias("rank")))
    domains = F.when(own.rlike(_NUMERIC_HOST), F.array(F.struct(own.alias("key"), n.alias("rank")))).otherwise(domains)
    return F.when(own == "", F.array().cast("array<struct<key:string,rank:int>>")).when(part == "", domains).otherwise(F.concat(path, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """One row for each key: its validity intervals, an array of (since, until, action), by date.

    entries: key string, listed int (a day), action string, entry_id long. An entry holds from its day until the next
    entry of its key; of entries of one key and day the one with the largest entry_id counts. Entries without key,
    day or action are left out. A key's array is bounded by the number of days.
    """
    whole = entries.filter(F.col("key").isNotNull() & F.col("listed").isNotNull() & F.col("action").isNotNull())
    daily = whole.groupBy("key", "listed").agg(F.max(F.struct("entry_id", "action")).alias("last"))
    dated = daily.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("listed", F.col("last.action").alias("action")))).alias("dated"))
    later = F.concat(F.slice("dated.listed", 2, F.size("dated")), F.array(F.lit(None).cast("int")))
    spans = F.zip_with("dated", F.slice(later, 1, F.size("dated")), lambda e, until: F.struct(e["listed"].alias("since"), until.alias("until"), e["action"].alias("action")))
    return dated.select("key", spans.alias("spans"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with key, listed and verdict: block, allow or none.

    captures: capture_id, url string, fetched int (a day), others. Of the keys that cover a URL and have an entry
    active on the day of the fetch that isn't withdrawn, the one of highest rank decides. Null or broken URLs and
    captures without a date or capture_id get none. Columns named like the result's are replaced. Rows that repeat a capture_id must repeat its url and day, or get one verdict.
    The keys' side has one row for each key; a frequent host meets it in a join that Spark may split.
    """
    captures = captures.select(*others(captures, "key", "listed", "verdict"))
    lists = stored(intervals(entries), "lists")
    asked = captures.select("capture_id", "fetched", F.explode(keys(F.col("url"))).alias("k")).select("capture_id", "fetched", "k.key", "k.rank")
    active = F.filter("spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (F.col("fetched") < s["until"])))
    met = asked.join(lists, "key").select("capture_id", "rank", "key", F.try_element_at(active, F.lit(1)).alias("now"))
    valid = met.filter(F.col("now").isNotNull() & (F.col("now.action") != WITHDRAW))
    best = valid.groupBy("capture_id").agg(F.max(F.struct("rank", "key", F.col("now.since").alias("listed"), F.col("now.action").alias("action"))).alias("best"))
    best = best.select("capture_id", F.col("best.key").alias("key"), F.col("best.listed").alias("listed"), F.col("best.action").alias("verdict"))
    return captures.join(best, "capture_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))
