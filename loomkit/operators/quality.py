"""Checks of submissions and tables before use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.config import LabelSet


def submission_problems(sub: DataFrame, sizes: DataFrame, labels: LabelSet) -> DataFrame:
    """(rule, id, detail) for everything wrong with a submission (id, labels); no row means that it passes.

    sizes: id, n of the reference. Rules: missing_id, labels_missing, invalid_label, unknown_id, wrong_length,
    duplicate_id, missing_record, record_count.
    """
    has_id = F.coalesce(F.col("id").cast("string"), F.lit("")) != ""
    named = sub.filter(has_id)
    joined = named.join(sizes.select("id", "n"), "id", "left")
    bad = F.filter("labels", lambda x: x.isNull() | ~x.isin(*labels.labels))
    say = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"), detail.cast("string").alias("detail"))
    counts = sub.agg(F.count("*").alias("_s")).crossJoin(sizes.agg(F.count_distinct("id").alias("_r"))).filter("_s <> _r")
    rules = [
        say(sub.filter(~has_id), "missing_id", F.lit(None)),
        say(named.filter("labels is null"), "labels_missing", F.lit(None)),
        say(named.filter(F.size(bad) > 0), "invalid_label", F.size(bad)),
        say(joined.filter("n is null"), "unknown_id", F.lit(None)),
        say(joined.filter("n is not null and labels is not null and size(labels) <> n"), "wrong_length", F.size("labels")),
        say(named.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1"), "duplicate_id", F.col("k")),
        say(sizes.join(named.select("id"), "id", "left_anti"), "missing_record", F.lit(None)),
        counts.select(F.lit("record_count").alias("rule"), F.lit(None).cast("string").alias("id"), F.concat_ws(" != ", F.col("_s").cast("string"), F.col("_r").cast("string")).alias("detail")),
    ]
    return reduce(DataFrame.unionByName, rules)


def require_rows(df: DataFrame, n: int, name: str) -> DataFrame:
    """df; raises at once if it hasn't exactly n rows."""
    found = df.count()
    if found != n:
        raise ValueError(f"{name} has {found} rows, not {n}")
    return df


def aligned(members: DataFrame) -> DataFrame:
    """Members whose cells differ in number or ids from most others': member, cells, groups; none if all agree."""
    by = members.groupBy("member").agg(F.count("*").alias("cells"), F.count_distinct("id").alias("groups"), F.sum(F.xxhash64("id", "sent_index").cast("decimal(38,0)")).alias("_h"))
    common = by.groupBy("cells", "groups", "_h").agg(F.count("*").alias("_k")).agg(F.max_by(F.struct("cells", "groups", "_h"), "_k").alias("_c"))  # one row
    return by.crossJoin(F.broadcast(common)).filter("cells <> _c.cells or groups <> _c.groups or _h <> _c._h").select("member", "cells", "groups")


def _lacking(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """(member, cells): how many of gold's cells each member has without a label or not at all; 0 where none."""
    need = gold.agg(F.count("*").alias("_n"))  # one row
    have = preds.filter("label is not null").join(gold.select("id", "sent_index"), ["id", "sent_index"], "left_semi").groupBy("member").agg(F.count_distinct("id", "sent_index").alias("_h"))
    every = preds.select("member").distinct().join(have, "member", "left").crossJoin(F.broadcast(need))
    return every.select("member", (F.col("_n") - F.coalesce("_h", F.lit(0))).alias("cells"))


def covered(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Cells of gold that a member lacks or has without a label: member, cells; gold has a cell once."""
    return _lacking(preds, gold).filter("cells > 0")


def complete_members(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Cells of gold of the members that have a label for every one; incomplete members go whole."""
    whole = _lacking(preds, gold).filter("cells = 0").select("member")
    return preds.join(gold.select("id", "sent_index"), ["id", "sent_index"], "left_semi").join(whole, "member", "left_semi")


def pool_warnings(pools: dict[str, DataFrame], least: dict[str, int] | None = None) -> DataFrame:
    """(pool, warning) for pools of groups (id, minority): empty, no_hard_groups, or few_groups where `least` asks for more."""
    def of(name: str, pool: DataFrame) -> DataFrame:
        seen = pool.agg(F.count("*").alias("n"), F.count_if(F.col("minority") > 0).alias("hard"))
        found = F.array(F.when(F.col("n") == 0, "empty"), F.when(F.col("hard") == 0, "no_hard_groups"), F.when((F.col("n") > 0) & (F.col("n") < (least or {}).get(name, 0)), "few_groups"))
        return seen.select(F.lit(name).alias("pool"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))

    return reduce(DataFrame.unionByName, [of(*x) for x in pools.items()])
