"""Steps that deal rows once: the same rows as the plainer operators, and the shuffles that their plans hold."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomkit.config import SENTENCES
from loomkit.operators import densify, score
from loomkit.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"
SUP, UCM, UE, SO, CON = SENTENCES.labels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


def odd(spark):
    gold = spark.createDataFrame([(1, 0, [SUP]), (1, 1, [UE, SO]), (2, 0, []), (3, 0, None), (4, 0, ["other"]), (5, 0, [UE, None])], "id long, sent_index int, types array<string>")
    raw = spark.createDataFrame(
        [(1, 1, 0, UE, -0.1, 2), (1, 1, 0, SUP, None, 1), (1, 1, 1, SO, -0.2, 5), (1, 1, 1, CON, -0.3, None), (2, 1, 1, "unknown", -0.4, 0), (2, 2, 0, UE, -0.5, 0), (2, 3, 0, UE, -0.6, 0),
         (1, 4, 0, UE, -0.7, 0), (1, 5, 0, UE, -0.8, 0), (2, 5, 0, SO, None, 0), (1, 5, 1, SO, -0.9, 0), (1, -1, 0, SO, -0.9, 0), (2, None, 0, SO, -0.9, 0), (3, 1, 0, CON, -0.9, 0), (1, 2, 0, None, -0.1, 0)],
        "member int, id long, sent_index int, label string, conf double, seq int",
    )
    return gold, raw


def test_spread_gives_the_rows_of_assemble(spark):
    gold, raw = odd(spark)
    cells = gold.select("id", "sent_index").crossJoin(spark.createDataFrame([(1,), (2,)], "member int"))
    plain = densify.assemble(raw, cells, SENTENCES, keys=("member",))
    dealt = densify.named(densify.spread(raw, gold, SENTENCES, [1, 2]), SENTENCES)
    assert rows(dealt.select(plain.columns)) == rows(plain)
    scored = score.credited(gold, plain, SENTENCES)
    coded = score.credited_members(gold, raw, SENTENCES, [1, 2])
    for f in (score.report, score.per_label):
        assert rows(f(coded, SENTENCES, ("member",))) == rows(f(scored, SENTENCES, ("member",)))
    told = densify.suppress_uncertain(plain, SENTENCES, 0.5).groupBy("member", "label").agg(F.count("*").alias("n"))
    assert rows(densify.certain_counts(plain, SENTENCES, 0.5, ("member",))) == rows(told)
    bare = plain.withColumn("conf", F.lit(None).cast("double"))
    assert rows(densify.certain_counts(bare, SENTENCES, 0.5, ("member",))) == rows(bare.groupBy("member", "label").agg(F.count("*").alias("n")))


def test_dense_scores_deal_predictions_once(spark):
    for name in ("member_scores", "anchored_metrics", "member_ranking", "uncertainty_bias"):
        text = plan(entry.queries()[name](spark, DATA))
        assert text.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in text and text.count("WindowGroupLimit") == 0, name


def test_anchored_fails_without_any_anchor(spark):
    import pytest

    from loomkit.operators import rank

    metrics = spark.createDataFrame([(1, 0.5), (2, 0.6)], "member int, macro_f1 double")
    known = spark.createDataFrame([(1, 10.0), (2, 20.0)], "member int, external double")
    assert rows(rank.anchored(metrics, known, 2)) == [("1", "0.5", "10.0", "2"), ("2", "0.6", "20.0", "2")]
    for anchors in (known.filter("member = 1"), known.limit(0)):
        with pytest.raises(Exception, match="fewer than 2 anchors"):
            rank.anchored(metrics, anchors, 2).collect()


def test_rank_correlation_reads_its_input_once(spark):
    text = plan(entry.queries()["rank_correlation"](spark, DATA))
    assert "lineitem" not in text and "pairs-" in text


def test_members_without_a_row_are_left_out(spark):
    gold, raw = odd(spark)
    one = raw.filter("seq is not null and not (member = 1 and id = 1 and seq = 1)")
    plain = score.credited(gold, one, SENTENCES)
    coded = score.credited_members(gold, one, SENTENCES, [1, 2], missing=False)
    assert rows(coded.groupBy("member", "id").agg(F.count("*"), F.count_if("hit"))) == rows(plain.filter("member < 3").groupBy("member", "id").agg(F.count("*"), F.count_if("hit")))


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    from loomkit.sources import records

    for name, n in (("a", 5000), ("b", 1), ("c", 0), ("d", 3000)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = records.numbered_lines(spark, str(tmp_path))
        text = plan(lines)
        got = {(r.file[-1], r.value): r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, f"{name}{i}"): i for name, n in (("a", 5000), ("b", 1), ("d", 3000)) for i in range(n)}
    assert "SortMergeJoin" not in text and text.count("Window") == text.count("windowspecdefinition(file")


def test_strict_lines_are_parsed_once(spark, tmp_path):
    from loomkit.sources import records

    (tmp_path / "a").write_text('{"id": "x", "labels": ["p"]}\n\n{broken\n[]\n{"id": "y"}\n')
    good, bad = records.scan_strict(spark, str(tmp_path / "a"), records.SUBMISSION)
    assert plan(good).count("from_json") == 1
    assert sorted((r.line, r.value) for r in bad.collect()) == [(2, "{broken"), (3, "[]")]
    assert [(r.line, r.id, r.labels) for r in good.orderBy("line").collect() if r.id] == [(0, "x", ["p"]), (4, "y", None)]


def test_members_files_are_written_by_all_tasks(spark):
    text = entry.queries()["last_submissions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    files = [f for f in entry.queries()["last_submissions"](spark, DATA).inputFiles()]
    assert text.count("from_json") == 1 and len({f.rsplit("/", 2)[1] for f in files}) == 5 and all("/name=m" in f for f in files)


def test_cases_without_quota_are_not_ranked(spark):
    text = plan(entry.queries()["top_cases"](spark, DATA))
    assert "Filter" in text.split("WindowGroupLimit")[-1].split("Exchange")[0]


def test_what_is_in_no_pack_is_found_once(spark):
    from loomkit.operators import synthesize
    from loomkit.sources.store import stored

    g = spark.createDataFrame([(1, 3, 1, ["a"]), (2, 3, 1, ["a", "b"]), (3, 15, 1, ["a"]), (4, 2, 1, None), (5, 2, 0, ["a"])], "id long, n int, minority int, stems array<string>")
    none = spark.createDataFrame([], "synthetic string, position int, id long")
    left = synthesize.fitting_groups(g, none, store=stored)
    assert rows(left) == rows(synthesize.fitting_groups(g, none)) and not left.isEmpty()
    assert "left_anti" not in plan(left).lower() and "leftanti" not in plan(left).lower() and "left-" in plan(left)
