"""How members disagree, and how groups are shaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.config import LabelSet
from loomkit.functions.labels import length_range

CELL = ["id", "sent_index"]


def call_rate(preds: DataFrame, labels: LabelSet) -> DataFrame:
    """Share of each member's positions with a minority label."""
    return preds.groupBy("member").agg(F.avg((F.col("label") != labels.default).cast("double")).alias("rate"), F.count("*").alias("n"))


def conflicts(preds: DataFrame, labels: LabelSet, least: int = 5) -> DataFrame:
    """Cells with `least` valid votes or more: category, votes, disagreement (votes beside the plurality), n_minority."""
    n = [F.count_if(F.col("label") == x).alias(f"v{i}") for i, x in enumerate(labels.labels)]
    votes = preds.filter(F.col("label").isin(*labels.labels)).groupBy(*CELL).agg(*n, F.count("*").alias("votes")).filter(F.col("votes") >= least)
    each = {x: F.col(f"v{i}") for i, x in enumerate(labels.labels)}
    default = each[labels.default]
    kinds = sum((F.when(each[x] > 0, 1).otherwise(0) for x in labels.minority), F.lit(0))
    category = (
        F.when((default > 0) & (kinds == 0), "unanimous_SUP").when((default == 0) & (kinds == 1), "unanimous_minority")
        .when((default > 0) & (kinds == 1), "SUP_vs_one_minority").when((default > 0) & (kinds > 1), "SUP_vs_multi_minority")
        .otherwise("minority_only_disagree")
    )
    distinct = F.filter(F.array_sort(F.array(*[F.when(c > 0, F.lit(x)) for x, c in each.items()])), lambda x: x.isNotNull())
    return votes.select(*CELL, category.alias("category"), "votes", (F.col("votes") - F.greatest(*each.values())).alias("disagreement"), (F.col("votes") - default).alias("n_minority"), distinct.alias("distinct_labels"))


def label_pairs(cells: DataFrame, column: str = "distinct_labels") -> DataFrame:
    """Counts of unordered pairs of distinct labels that occur in one cell."""
    one = cells.select(F.col(column).alias("ls"), F.posexplode(column).alias("i", "a"))
    two = one.select("a", F.explode(F.slice("ls", F.col("i") + 2, F.size("ls"))).alias("b"))
    return two.groupBy("a", "b").agg(F.count("*").alias("n"))


def top_cases(conflict_cells: DataFrame, labels: LabelSet, quotas=(("SUP_vs_one_minority", 3), ("SUP_vs_multi_minority", 6), ("minority_only_disagree", 5), ("unanimous_minority", 3))) -> DataFrame:
    """Cases of each category for review: by minority label where there is one, the most contested first; once each."""
    bucket = F.when(F.col("category") == "SUP_vs_one_minority", F.concat_ws(":", "category", F.array_join(F.array_remove("distinct_labels", labels.default), ","))).otherwise(F.col("category"))
    key = F.when(F.col("category") == "SUP_vs_multi_minority", F.col("disagreement")).when(F.col("category") == "minority_only_disagree", F.lit(0)).otherwise(F.col("n_minority"))
    quota = F.coalesce(*[F.when(F.col("category") == c, F.lit(k)) for c, k in quotas], F.lit(0))
    # a bucket lies within one category, so what has no quota, as nearly all cells, needn't be ranked
    ranked = conflict_cells.filter(quota > 0).withColumns({"bucket": bucket, "_k": key}).withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("_k"), *CELL)))
    most = max(k for _, k in quotas)  # a fixed bound lets Spark keep the first rows of each bucket only
    return ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= quota).drop("_k").dropDuplicates(CELL)


def group_histogram(preds: DataFrame, labels: LabelSet) -> DataFrame:
    """(minority, groups): how many groups have so many minority labels."""
    per = preds.groupBy("id").agg(F.count_if(F.col("label") != labels.default).alias("minority"))
    return per.groupBy("minority").agg(F.count("*").alias("groups"))


def shapes(gold: DataFrame, labels: LabelSet) -> DataFrame:
    """One row for each group of gold (id, types): n, minority (sentences whose gold has a minority label)."""
    return gold.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.exists("types", lambda t: t != labels.default)).alias("minority"))


def summary(groups: DataFrame) -> DataFrame:
    """Records, sentences, mean, median and maximum length, and percentages; zeros for no groups."""
    pct = lambda c: F.coalesce(100 * F.avg(c.cast("double")), F.lit(0.0))
    return groups.agg(
        F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_len"),
        F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_len"), F.coalesce(F.max("n"), F.lit(0)).alias("max_len"), pct(F.col("n") >= 8).alias("pct_len8"),
        pct(F.col("minority") >= 1).alias("pct_minority"), F.coalesce(F.avg("minority"), F.lit(0.0)).alias("mean_minority"), pct(F.col("minority") >= 2).alias("pct_multi"),
    )


def length_histogram(groups: DataFrame, bins) -> DataFrame:
    """Percentage of groups in each length bin that has any."""
    by = groups.withColumn("bin", length_range(F.col("n"), bins)).groupBy("bin").agg(F.count("*").alias("groups"))
    total = groups.agg(F.greatest(F.count("*"), F.lit(1)).alias("_t"))
    return by.filter("bin is not null").crossJoin(F.broadcast(total)).select("bin", "groups", (100.0 * F.col("groups") / F.col("_t")).cast("double").alias("pct"))


def any_of_counts(gold: DataFrame) -> DataFrame:
    """Sentences that carry each label."""
    return gold.select(F.explode(F.array_distinct("types")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def primary_counts(gold: DataFrame) -> DataFrame:
    """Sentences by their first label."""
    return gold.filter(F.size("types") > 0).groupBy(F.get("types", F.lit(0)).alias("label")).agg(F.count("*").alias("n"))


def domain_share(records: DataFrame, dataset: str, domain: str) -> DataFrame:
    """Share of each domain among a dataset's records."""
    by = records.groupBy(dataset, domain).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(dataset)))
