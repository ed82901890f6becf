"""Splits and samples of groups that don't leak, and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a distributed running total at least, and rows for each beyond that.
BUCKETS, BUCKET_ROWS = 1024, 100_000


def running_total(df: DataFrame, order: Column, size: Column, store, keys: tuple[str, ...] = (), ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """df with `before`, the sum of sizes of rows of its key that come earlier in order, and `total`, that of all.

    order is a number in [0, 1); ties go by columns. Rows fall into buckets by order, whose number follows that of the
    rows; the buckets' sums are added up first, the rows of each bucket after, so no task holds all rows of a key.
    """
    keyed = store(df.withColumns({"_o": order, "_s": size.cast("long")}), "ordered")
    keyed = keyed.withColumn("_b", F.floor(F.col("_o") * max(BUCKETS, -(-keyed.count() // BUCKET_ROWS))).cast("int"))
    buckets = keyed.groupBy(*keys, "_b").agg(F.sum("_s").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*keys, "_b", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(offsets, [*keys, "_b"])
    return out.withColumn("before", F.col("_off") + F.coalesce(F.sum("_s").over(inside), F.lit(0))).select(*df.columns, "before", "total")


def spread_order(values: DataFrame, value: str, parts: int = 256) -> Column:
    """An order in [0, 1) for running_total() that deals distinct values evenly, whatever their distribution; ties=(value,) goes with it."""
    cuts = values.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []  # parts numbers
    return F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x <= F.col(value))) / F.lit(float(parts)) if cuts else F.lit(0.0)


def quota_pick(df: DataFrame, stratum: str, order: Column, ratio: float, store, least: int = 1) -> DataFrame:
    """df with `picked`: in each stratum the first max(least, ratio of its rows, halves to even) by order."""
    summed = running_total(df, order, F.lit(1), store, (stratum,))
    quota = F.greatest(F.bround(F.col("total") * F.lit(float(ratio))), F.lit(least))
    return summed.withColumn("picked", F.col("before") < quota).drop("before", "total")


def stratified_split(groups: DataFrame, order: Column, ratio: float, store) -> DataFrame:
    """(id, split): dev gets its share of groups with and without minority labels; groups: id, hard."""
    return quota_pick(groups, "hard", order, ratio, store).select("id", F.when(F.col("picked"), "dev").otherwise("train").alias("split"))


def component_split(members: DataFrame, order: Column, ratio: float, store) -> DataFrame:
    """(id, split) that keeps components whole; members: id, component.

    Components go to dev in order while dev is smaller than its share; the last may overshoot.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    summed = running_total(sizes, order, F.col("size"), store, ties=("component",))
    dev = F.col("before") < F.bround(F.col("total") * F.lit(float(ratio)))
    side = summed.select("component", F.when(dev, "dev").otherwise("train").alias("split"))
    return members.join(side, "component").select("id", "split")


def shared_key_edges(links: DataFrame) -> DataFrame:
    """Edges (a, b) from each group to the smallest group with the same key; links: id, key. Linear in the links."""
    least = links.groupBy("key").agg(F.min("id").alias("a"))
    return links.join(least, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def leaks(links: DataFrame, splits: DataFrame) -> DataFrame:
    """Keys that occur in groups on both sides."""
    return links.join(splits, "id").groupBy("key").agg(F.min("split").alias("x"), F.max("split").alias("y"), F.count_distinct("id").alias("groups")).filter("x <> y").select("key", "groups")


def assert_empty(df: DataFrame, message: str) -> DataFrame:
    """df, which must have no row: the first one fails the job that reads it."""
    return df.withColumn("_e", F.raise_error(F.lit(message)).cast("string")).drop("_e") if df.isEmpty() else df.select(F.raise_error(F.lit(message)).alias("error"))


def within_side(rows: DataFrame, splits: DataFrame, side: str) -> DataFrame:
    """rows, whose ids must all be of one side of the split; any other fails the job that reads them."""
    known = rows.join(splits.select("id", F.col("split").alias("_side")), "id", "left")
    checked = F.when(F.col("_side").eqNullSafe(F.lit(side)), True).otherwise(F.raise_error(F.concat(F.lit(f"not of the side {side}: "), F.col("id").cast("string"))).cast("boolean"))
    return known.filter(checked).drop("_side")


def downsample_default(groups: DataFrame, keep: float, chance: Column) -> DataFrame:
    """Drops groups without minority labels whose chance is `keep` or more; others always stay."""
    return groups if keep >= 1 else groups.filter(F.col("hard") | (chance < keep))


def holdout(ids: DataFrame, order: Column, share: float, store) -> DataFrame:
    """(id, split): the first floor(n * share) ids by order are validation."""
    summed = running_total(ids, order, F.lit(1), store)
    return summed.select("id", F.when(F.col("before") < F.floor(F.col("total") * F.lit(float(share))), "validation").otherwise("train").alias("split"))


def audit_selection(units: DataFrame, default: str, order: Column, share: float, store) -> DataFrame:
    """All units of minority classes, and a share of the default class's, one at least."""
    picked = quota_pick(units.withColumn("_d", F.col("target_label") == default), "_d", order, share, store)
    return picked.filter(~F.col("_d") | F.col("picked")).drop("_d", "picked")


def densest(groups: DataFrame, share: float, order: Column, store, least: int = 0) -> DataFrame:
    """All groups with minority labels and the longest others until the share of the former falls to `share`.

    groups: id, n, minority; `least` first drops shorter groups. At least one other group stays beside any.
    """
    pool = groups.filter(F.col("n") >= least).withColumn("hard", F.col("minority") >= 1)
    hard = pool.agg(F.count_if("hard").alias("_h"))
    if share >= 1:
        keep = F.lit(0)
    elif share <= 0:
        keep = F.lit(2**62)
    else:
        raw = F.bround(F.col("_h") * F.lit((1.0 - share) / share))
        keep = F.when((F.col("_h") > 0) & (raw == 0), 1).otherwise(raw)
    by = pool.filter("not hard").groupBy("n").agg(F.count("*").alias("_c"))  # a row for each length
    above = by.select("n", "_c", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    easy = pool.filter("not hard").join(F.broadcast(above), "n").crossJoin(F.broadcast(hard)).withColumn("_k", keep).filter(F.col("_above") < F.col("_k"))
    whole, cut = easy.filter("_above + _c <= _k"), easy.filter("_above + _c > _k")
    cut = running_total(cut, order, F.lit(1), store).filter(F.col("before") < F.col("_k") - F.col("_above"))
    return pool.filter("hard").unionByName(whole.select(pool.columns)).unionByName(cut.select(pool.columns))


def guaranteed_sample(groups: DataFrame, order: Column, n: int, floor: int, store) -> DataFrame:
    """The first n groups in order, of which the poorest in minority labels give way to richer ones further on until `floor` labels are reached.

    groups: id, minority, others; order is a number in [0, 1), ties go by id. Groups beyond the first n come up in order;
    one that has more labels than the poorest sampled takes its place (of equal ones the first place's), as long as
    labels are missing. `met` tells whether the floor was reached; if it wasn't, no group left has more labels than one
    sampled. While the poorest sampled have v labels the rule is a prefix: of the groups with more than v as many as there are such
    poorest, or as the missing labels need. So there is a distributed running total for each v, and no walk over rows.
    """
    ranked = store(running_total(groups, order, F.lit(1), store).withColumnsRenamed({"before": "_place", "total": "_all"}), "ranked")
    chosen, rest = ranked.filter(F.col("_place") < n), ranked.filter((F.col("_place") >= n) & (F.col("minority") > 0))
    many = {r["minority"]: r["count"] for r in chosen.groupBy("minority").count().collect()}  # a row for each number of labels
    total, after = sum(v * k for v, k in many.items()), -1
    along = lambda df, size: running_total(df, F.col("_place") / F.col("_all"), size, store, ties=("_place",)).drop("total")
    while many and total < floor:
        least = min(many)
        richer = along(rest.filter((F.col("_place") > after) & (F.col("minority") > least)), F.lit(1)).withColumnRenamed("before", "_k")
        richer = along(richer, F.col("minority") - least).withColumnRenamed("before", "_gain")
        taken = store(richer.filter((F.col("_k") < many[least]) & (F.col("_gain") < floor - total)).drop("_gain"), "taken")
        gained = {r["minority"]: (r["count"], r["last"]) for r in taken.groupBy("minority").agg(F.count("*").alias("count"), F.max("_place").alias("last")).collect()}
        k = sum(c for c, _ in gained.values())
        if not k:
            break
        poorest = along(chosen.filter(F.col("minority") == least), F.lit(1)).filter(F.col("before") < k).select(F.col("before").alias("_k"), F.col("_place").alias("_to"))
        moved = taken.join(poorest, "_k").withColumn("_place", F.col("_to")).select(ranked.columns)
        chosen = store(chosen.join(poorest.select(F.col("_to").alias("_place")), "_place", "left_anti").select(ranked.columns).unionByName(moved), "chosen")
        after, total = max(last for _, last in gained.values()), total + sum((v - least) * c for v, (c, _) in gained.items())
        spent, many = many[least] - k, {**many, **{v: many.get(v, 0) + c for v, (c, _) in gained.items()}}
        if spent:
            break
        del many[least]
    return chosen.select(*groups.columns, F.lit(total >= floor).alias("met"))


def hard_subset(gold: DataFrame, preds: DataFrame, default: str, least: int) -> tuple[DataFrame, DataFrame]:
    """gold (id, types, ...) and preds of groups with `least` sentences and more and a minority label."""
    minority = F.count_if(F.exists("types", lambda t: t != default))
    chosen = gold.groupBy("id").agg(F.count("*").alias("_n"), minority.alias("_m")).filter((F.col("_n") >= least) & (F.col("_m") > 0)).select("id")
    return gold.join(chosen, "id", "left_semi"), preds.join(chosen, "id", "left_semi")


def split_summary(gold: DataFrame, splits: DataFrame, default: str) -> DataFrame:
    """For each side: groups, sentences and hard groups (label null), and those of each first label, or of none."""
    rows = gold.join(splits, "id").select("split", "id", F.coalesce(F.get("types", F.lit(0)), F.lit("none")).alias("label"))
    hard = F.count_distinct(F.when(~F.col("label").isin(default, "none"), F.col("id")))
    return rows.groupingSets([["split"], ["split", "label"]], "split", "label").agg(F.count_distinct("id").alias("groups"), F.count("*").alias("sentences"), hard.alias("hard"))
