"""Remaining operators, and properties of unions and copies over random tables."""

import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomkit.config import SENTENCES
from loomkit.operators import curate, densify, ensemble, quality, rank, render, split, synthesize
from loomkit.plans import catalog
from loomkit.functions import labels as L
from loomkit.functions import normalize as N
from loomkit.sources import sinks
from loomkit.sources.records import per_target
from loomkit.sources.store import stored

SUP, UCM, UE, SO, CON = SENTENCES.labels


def test_unions_contain_what_they_must(spark):
    rng = random.Random(3)
    rows = [(m, g, s, rng.choice(SENTENCES.labels) if rng.random() < 0.4 else SUP, -rng.random()) for m in range(4) for g in range(30) for s in range(rng.randint(1, 5)) if rng.random() < 0.95]
    p = spark.createDataFrame(rows, "member int, id int, sent_index int, label string, conf double")
    cells = p.select("id", "sent_index").distinct()
    fired = {(r.id, r.sent_index) for r in p.filter(F.col("label") != SUP).collect()}
    minority = lambda df: {(r.id, r.sent_index) for r in df.filter(F.col("label") != SUP).collect()}
    assert minority(ensemble.pooled_union(cells, p, SENTENCES, 1)) == fired
    base, sources = p.filter("member = 0"), p.filter("member > 0")
    kept = {(r.id, r.sent_index, r.label) for r in base.filter(F.col("label") != SUP).collect()}
    for out in (ensemble.asymmetric_union(cells, base, sources, SENTENCES, {}, 2), ensemble.confident_union(cells, base, sources, SENTENCES, {CON: -0.5})):
        assert kept <= {(r.id, r.sent_index, r.label) for r in out.collect()} and out.count() == cells.count()
    one = ensemble.pooled_union(cells.repartition(1), p.repartition(1), SENTENCES, 2).orderBy("id", "sent_index").collect()
    assert one == ensemble.pooled_union(cells.repartition(7), p.repartition(7), SENTENCES, 2).orderBy("id", "sent_index").collect()


def test_blend_and_agreement(spark):
    main = spark.createDataFrame([(1, 0, "r", "a", 0.6), (1, 0, "r", "b", 0.4), (2, 0, "q", "a", 0.6), (2, 0, "q", "b", 0.4)], "id int, sent_index int, regime string, label string, p double")
    aux = spark.createDataFrame([(1, 0, "b", 1.0), (2, 0, "b", 1.0)], "id int, sent_index int, label string, p double")
    assert {r.id: r.label for r in ensemble.blend(main, aux, {"r": 1.0}).collect()} == {1: "b", 2: "a"}


def test_ranks_of_families_and_anchors(spark):
    m = spark.createDataFrame([("a", "f", 0.5), ("b", "f", 0.7), ("c", "f", None), ("d", "g", 0.1)], "member string, family string, score double")
    assert rank.family_place(m, "family", "score", "a").first().place == 2
    assert [r.member for r in rank.ordered(m).orderBy("place").collect()] == ["b", "a", "d", "c"]
    known = spark.createDataFrame([("a", 1.0), ("b", None), ("x", 2.0)], "member string, external double")
    with pytest.raises(Exception, match="fewer than 3 anchors"):
        rank.anchored(m, known).collect()
    assert rank.anchored(m, known, 1).first().member == "a"


def test_curation_tables(spark):
    sentences = spark.createDataFrame([("r", 0, SUP), ("r", 1, CON)], "record_id string, sent_idx int, target_label string")
    accepted = spark.createDataFrame([("r", 0, "blind", "t", 2), ("r", 0, "blind", "t", 1), ("r", 1, "gold", "u", 3), ("z", 0, "gold", "u", 4)], "record_id string, sent_idx int, source string, rationale string, seq int")
    units = curate.build_units(accepted, sentences)
    assert sorted((r.record_id, r.sent_idx, r.seq) for r in units.collect()) == [("r", 0, 1), ("r", 1, 3)]
    assert all(r.unit_key.count("|") == 3 and len(r.unit_key.split("|")[3]) == 10 for r in units.collect())
    now = sentences.withColumn("target_label", F.lit(SUP))
    assert [r.sent_idx for r in curate.consistent_units(units, now).collect()] == [0]
    audit = units.select("unit_key", F.lit(1).alias("seq"), F.lit("verify").alias("phase"), F.when(F.col("sent_idx") == 0, "PASS").otherwise("FAIL").alias("verdict"))
    later = audit.withColumns({"seq": F.lit(2), "verdict": F.lit("PASS")})
    got = {r.target_label: r.passed for r in curate.first_verdicts(audit.unionByName(later), units).collect()}
    assert got == {SUP: 1.0, CON: 0.0}
    judged = curate.judged_entries(spark.createDataFrame([("it is plainly so and well shown", SUP, [SUP])], "entry string, target_label string, gold_types array<string>"), SENTENCES, F.lit(SUP))
    assert tuple(curate.acceptance_by_class(judged).first()) == (SUP, 1, 1, 1, 1)
    rows = spark.createDataFrame([("r", 0, "train"), ("r", 1, "dev")], "id string, sent_index int, split string")
    out = {r.sent_index: r.rationales for r in render.attach_rationales(rows, units).collect()}
    assert out == {0: ["t"], 1: None}


def test_records_of_one_side_and_few_images(spark):
    recs = spark.createDataFrame([("a", "c"), ("b", "d")], "id string, claim_text string").withColumns({"evidence_bundle": F.array(), "sentence_label": F.array()})
    sides = spark.createDataFrame([("a", "dev"), ("b", "train")], "id string, split string")
    assert [r.id for r in render.gold_export(recs, sides).collect()] == ["a"]
    corpus = spark.createDataFrame([(1, ["x"] * 3), (2, ["x"]), (3, None)], "k int, images array<string>")
    assert sorted(r.k for r in render.few_images(corpus).collect()) == [2, 3]


def test_joined_records(spark):
    e = "array<struct<img_path:string>>"
    recs = spark.createDataFrame([("a", "ca", ["1", "2"], [("x",), ("",), ("y",)]), ("b", "cb", ["3"], [("y",), ("z",)])], f"id string, claim_text string, sentences array<string>, evidence {e}")
    packed = spark.createDataFrame([("s", 0, "b"), ("s", 1, "a")], "synthetic string, position int, id string")
    r = synthesize.joined_records(packed, recs).first()
    assert (r.claim_text, r.sentences, [x.img_path for x in r.evidence]) == ("cb ca", ["3", "1", "2"], ["y", "z", "x"])


def test_hard_groups_and_targets(spark):
    gold = spark.createDataFrame([(1, 0, [UE, SO, UE]), (1, 1, [SUP]), (2, 0, [UE]), (3, 0, [SUP]), (3, 1, [])], "id int, sent_index int, types array<string>")
    g, p = split.hard_subset(gold, gold.select("id", "sent_index"), SUP, 2)
    assert {r.id for r in g.collect()} == {1} == {r.id for r in p.collect()}
    out = [(r.id, r.sent_index, r.target) for r in per_target(gold, F.lit(SUP)).orderBy("id", "sent_index", "target_index").collect()]
    assert out == [(1, 0, UE), (1, 0, SO), (1, 1, SUP), (2, 0, UE), (3, 0, SUP), (3, 1, SUP)]
    recs = gold.groupBy("id").agg(F.collect_list(F.struct("types")).alias("s"))
    assert {r.id: r.h for r in recs.select("id", L.is_hard(F.col("s"), SENTENCES).alias("h")).collect()} == {1: True, 2: True, 3: False}
    s = {(r.split, r.label): (r.groups, r.sentences, r.hard) for r in split.split_summary(gold, spark.createDataFrame([(1, "dev"), (2, "train"), (3, "train")], "id int, split string"), SUP).collect()}
    assert s["train", None] == (2, 3, 1) and s["dev", UE] == (1, 1, 1)


def test_hash_is_uniform_and_stable(spark):
    df = spark.range(4000).select("id", L.hash01(7, "id").alias("h"))
    assert 0.47 < df.agg(F.avg("h")).first()[0] < 0.53 and df.filter("h < 0 or h >= 1").isEmpty()
    assert df.repartition(5).orderBy("id").collect() == df.orderBy("id").collect()
    assert densify.keep_one(df.withColumn("k", F.lit(1)), ["k"], ["id"], last=True).first().id == 3999


def test_nouns_of_documents_are_those_of_whole_texts(spark, tmp_path):
    rows = [(1, "en", "a head\nand then Berlin"), (2, "de", "ein Kopf\nund dann Berlin"), (3, "en", "a head\nand Paris"), (4, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.nouns for r in catalog._documents_with_marks(spark, str(tmp_path)).collect()} == {1: ["Berlin"], 2: ["Kopf", "Berlin"], 3: ["Paris"], 4: None}
    assert [tuple(r) for r in catalog.donor_matches(spark, str(tmp_path)).collect()] == [(3, 2)]


def test_captions_of_records_without_items_and_further_fields(spark):
    item = "struct<type:string,img_path:string,image_caption:array<string>,table_caption:array<string>,caption:string>"
    df = spark.createDataFrame([(1, [("table", "a", None, ["t"], "own")]), (2, []), (3, None)], f"id int, evidence array<{item}>")
    cache = spark.createDataFrame([("a", "seen")], "img_path string, text string")
    got = {r.id: r for r in render.enrich_captions(df, cache).collect()}
    assert got[1].evidence[0].table_caption == ["t", "[OCR] seen"] and got[1].evidence[0].caption == "own" and got[1].changed == 1
    assert got[2].evidence == [] and got[3].evidence is None and got[2].changed == got[3].changed == 0


def test_rows_of_another_side_fail(spark):
    splits = spark.createDataFrame([("a", "train"), ("b", "dev")], "id string, split string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert split.within_side(rows.filter("id = 'a'"), splits, "train").count() == 1
    for bad in ("b", "c"):
        with pytest.raises(Exception, match="not of the side train"):
            split.within_side(rows.filter(f"id in ('a', '{bad}')"), splits, "train").collect()


def test_incomplete_members_go(spark):
    gold = spark.createDataFrame([(1, 0), (1, 1)], "id int, sent_index int")
    p = spark.createDataFrame([("x", 1, 0, "S"), ("x", 1, 1, "S"), ("y", 1, 0, "S"), ("z", 1, 0, "S"), ("z", 1, 1, None), ("w", 9, 0, "S")], "member string, id int, sent_index int, label string")
    assert {r.member for r in quality.complete_members(p, gold).collect()} == {"x"}
    assert {(r.member, r.cells) for r in quality.covered(p, gold).collect()} == {("y", 1), ("z", 1), ("w", 2)}


def test_running_total_over_one_hot_place(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 90 else float(i)) for i in range(100)], "id int, x double")
    out = split.running_total(df, split.spread_order(df, "x"), F.lit(1), stored, ties=("x", "id")).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.before)] == sorted(range(100), key=lambda i: (5.0 if i < 90 else i, i))
    assert sorted(r.before for r in out) == list(range(100))


def plain_tail(t):
    """Cuts tails off the end by hand, one at a time."""
    names = [x.lower() for x in SENTENCES.labels]
    while True:
        before, t = t, t.strip()
        low = t.lower().rstrip(" ).\"'")
        name = next((x for x in names if low.endswith(x)), None)
        if name is not None:
            head, rest = t[: len(low) - len(name)].rstrip(" "), t[len(low) :]
            mark = head[:-1].rstrip(" ") if head.endswith(":") else head
            word = next((w for w in ("verdict", "label") if mark.lower().endswith(w) and not re.search(r"\w$", mark[: -len(w)])), None)
            arrow = next((a for a in ("->", "→", "=>", "⇒", "—", "–") if head.endswith(a)), None)
            if word:
                t = mark[: -len(word)].rstrip(";,. ")
            elif arrow:
                t = head[: -len(arrow)].rstrip(";,. ")
            elif head.endswith("(") and re.fullmatch(r" *\)[ .\"']*", rest):
                t = head[:-1].rstrip(";,. ")
        head, colon, said = t.rpartition(":")
        head, said = head.rstrip(" "), said.lstrip(" ")
        spoken = colon and len(said) <= 35 and said.isascii() and (said.replace(" ", "") or "x").isalpha()
        if spoken and head.lower().endswith("verdict") and not re.search(r"\w$", head[:-7]):
            t = head[:-7].rstrip(";,. ")
        t = t.strip()
        arrow = next((a for a in ("->", "→", "=>") if t.endswith(a)), None)
        t = (t[: -len(arrow)] if arrow else t).rstrip("([ ")
        if t == before:
            return t.rstrip(";,. ")


def test_tails_go_to_the_fixed_point(spark):
    rng = random.Random(12)
    bits = [*SENTENCES.labels, "verdict", "Label", "verdict:", ":", "->", "→", "=>", "⇒", "—", "(", ")", "[", ".", ";", ",", '"', "so", "it is", "x1", "é", "verdicts", "mylabel", "a" * 30]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts = [re.sub(r"\s+", " ", "Well, " + t).strip() for t in texts] + ["so" + " -> Supported; (Contradiction) verdict: no" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", N.clean_rationale(F.col("t"), SENTENCES).alias("c")).collect()}
    assert [(texts[i], got[i], plain_tail(t)) for i, t in enumerate(texts) if got[i] != plain_tail(t)] == []


def test_samples_swap_as_one_by_one(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, 1, 2, 5]), rng.randrange(50) / 50) for i in range(700)]
    g = spark.createDataFrame(rows, "id long, minority int, o double")
    for n, floor in ((40, 60), (40, 120), (40, 10_000), (900, 10), (0, 5)):
        order = sorted(rows, key=lambda r: (r[2], r[0]))
        chosen, left = order[:n], order[n:]
        for r in left:
            if not chosen or sum(x[1] for x in chosen) >= floor:
                break
            worst = min(range(len(chosen)), key=lambda k: chosen[k][1])
            if chosen[worst][1] < r[1]:
                chosen[worst] = r
        got = split.guaranteed_sample(g, F.col("o"), n, floor, stored).collect()
        assert sorted(r.id for r in got) == sorted(r[0] for r in chosen), (n, floor)
        assert {r.met for r in got} <= {sum(x[1] for x in chosen) >= floor}


def test_two_writers_and_an_old_reader(spark, tmp_path):
    path, df = str(tmp_path / "table"), lambda k: spark.range(k).repartition(2)
    assert sinks.replace_table(df(5), path) == 1
    reader = sinks.read_table(spark, path)
    done, lock = [], threading.Barrier(4)

    def write(k):
        lock.wait()
        try:
            done.append(sinks.replace_table(df(10 + k), path, base=1))
        except sinks.Conflict:
            done.append(None)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(x or 0 for x in done) == [0, 0, 0, 2] and reader.count() == 5 and sinks.read_table(spark, path).count() >= 10
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("version")]) == 2  # the losers' files are gone
    (tmp_path / "table" / "version-dead").mkdir()
    assert sinks.vacuum(spark, path, 3600) == 0 and reader.count() == 5
    time.sleep(1.1)
    assert sinks.vacuum(spark, path, 1) == 2 and sinks.read_table(spark, path).count() >= 10
    with pytest.raises(ValueError):
        sinks.read_table(spark, path, 1)
    assert sinks.replace_table(df(3), path) == 3 and sinks.read_table(spark, path).count() == 3


def test_matching_with_repeated_rows_and_hot_nouns(spark):
    rng = random.Random(7)
    nouns = lambda i: ["All"] * (i % 7 != 0) + ["Most"] * (i % 3 != 0) + rng.sample([f"N{k}" for k in range(30)], rng.randint(0, 9))
    rows = [(i, rng.choice(["en", "en", "en", "fr", "de"]), nouns(i)) for i in range(500)]
    rows += [(i, d, n) for i, d, n in rows[:40]]
    df = spark.createDataFrame(rows, "id long, domain string, nouns array<string>")
    donor, anchor = df.filter("id % 2 = 1").withColumn("donor_id", F.col("id")), df.filter("id % 2 = 0")
    pairs = stored(synthesize.match(donor, anchor, stored, block=64), "pairs")
    info, used = {i: (d, set(n)) for i, d, n in rows}, {x for p in pairs.collect() for x in (p.donor_id, p.anchor_id)}
    fits = lambda a, b: info[a][0] != info[b][0] and not info[a][1] & info[b][1]
    assert len(used) == 2 * pairs.count() > 0 and all(fits(p.donor_id, p.anchor_id) for p in pairs.collect())
    assert not [(a, b) for a in info if a % 2 and a not in used for b in info if not b % 2 and b not in used and fits(a, b)]
    assert synthesize.fitting_donors(donor, anchor, pairs, stored).isEmpty()


def test_session_functions_agree_with_the_columns(spark):
    from loomkit.functions.sql import register
    from loomkit.plans import further

    names = register(spark, SENTENCES)
    assert names == register(spark, SENTENCES)  # again, over the first
    texts = ['{"label": "Contradiction"}', "so: {\"label\": \"unsupported  entity\"} ok", 'x "label": "Supported"', "the scope overgeneralization, or Contradiction", "nothing", "", None, '{"label": 3}']
    df = spark.createDataFrame([(t, [UE, SO], {SO: 3, UE: 3}, [0.2, 1.0, 0.25]) for t in texts], "raw string, types array<string>, counts map<string,bigint>, losses array<double>")
    both = df.select("raw", F.expr("single_label(raw)").alias("a"), N.single_label(F.col("raw"), SENTENCES).alias("b"), F.expr("rarest_label(types, counts)").alias("r"), F.expr("soft_bottleneck(losses, 5)").alias("s"), F.expr("soft_bottleneck(array(), 5)").alias("none"), F.expr("soft_bottleneck(losses, 0)").alias("mean"))
    for r in both.collect():
        assert r.a == r.b and r.r == UE and r.s == pytest.approx(0.788474, abs=1e-6) and r.none is None and r.mean == pytest.approx(1.45 / 3), r
    plan = further.QUERIES["session_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rationales_are_cleaned_once_in_one_pass(spark):
    df = spark.createDataFrame([("six words are said in it -> " + SUP,), ("x" * 80 + " so they say; verdict: it is near scope (" + UE + ")",), (None,)], "t string")
    plan = df.select(N.conditioned_output(F.col("t"), SENTENCES).alias("o"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("batch(") == 1
    assert [r.c for r in df.select(N.clean_rationale(F.col("t"), SENTENCES).alias("c")).collect()] == ["six words are said in it", "x" * 80 + " so they say", None]
    long = ["y " * 40 + "Unsupported " * 6 + "Entity", "z " * 50 + ("-> " + SUP + "; (" + UE + ") verdict: no ") * 30]
    got = spark.createDataFrame([(x,) for x in long], "t string").select(N.clean_rationale(F.col("t"), SENTENCES).alias("c")).collect()
    assert [r.c for r in got] == [long[0], ("z " * 50).strip()]


def test_numbered_lines_hold_no_arrays_of_steps(spark):
    text = "said before\r\n 2)  b \r\n\r\n  more \n1)\n a\t\n  final : x ||| y \nFINAL: no"
    rows = curate.numbered_lines(spark.createDataFrame([(1, text), (2, "1) a\nFINAL: x"), (3, "1) a"), (4, "1) a\n3) b\nFINAL: x|||y")], "id int, text string"), "id", "text")
    assert sorted(map(tuple, rows.collect())) == [(1, 1, " a\t", "x"), (1, 2, "b more", "y")]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_constant_is_scored_without_a_join(spark):
    from loomkit.operators import score

    got = score.constant(spark.createDataFrame([(1, 0, [SUP]), (1, 1, [UE, SO])], "id long, sent_index int, types array<string>"), SENTENCES)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.label, r.hit, r.y_true) for r in got.orderBy("sent_index").collect()] == [(SUP, True, SUP), (SUP, False, UE)]


def test_a_member_of_many_files(spark, tmp_path):
    from loomkit.sources import records

    path = str(tmp_path / "raw")
    sinks.write_jsonl(spark.range(40).selectExpr("cast(id as string) AS id", "0 AS sent_index", "'Supported' AS label", "0.5D AS min_logprob").repartition(4), path)
    got = records.members(spark, path, records.PREDICTION, stem=r"/part-\d+-([^/]+?)-c\d+(?:\.[^./]*)?$")
    assert got.count() == 40 and got.select("member").distinct().count() == 1


def test_session_functions_read_outputs_once(spark):
    from loomkit.plans import further

    plan = further.QUERIES["session_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3  # outputs, gold, the labels' counts
