"""Ensembles, scores, splits and tables on small literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomkit.config import SENTENCES
from loomkit.operators import components, conflict, curate, densify, ensemble, quality, rank, render, resample, score, split, synthesize
from loomkit.sources import records, sinks
from loomkit.sources.store import stored

SUP, UCM, UE, SO, CON = SENTENCES.labels
PRED = "member int, id long, sent_index int, label string, conf double"


def preds(spark, *cells):
    """cells: for each sentence of group 1 the members' (label, conf) or label."""
    rows = []
    for i, votes in enumerate(cells):
        rows += [(m, 1, i, *(v if isinstance(v, tuple) else (v, -0.1))) for m, v in enumerate(votes, 1) if v]
    return spark.createDataFrame(rows, PRED)


def labels(df):
    return [r.label for r in df.orderBy("id", "sent_index").collect()]


def grid(spark, n):
    return densify.grid(spark.createDataFrame([(1, n), (2, 0)], "id long, n int"))


def test_unions_break_ties_by_their_own_orders(spark):
    p = preds(spark, [SO, UE], [UCM, SO], [UE, SO], [UE], [SUP, SUP], [CON, CON, UE])
    assert labels(ensemble.pooled_union(grid(spark, 7), p, SENTENCES, 1)) == [SO, SO, SO, UE, SUP, CON, SUP]
    assert labels(ensemble.pooled_union(grid(spark, 7), p, SENTENCES, 2)) == [SO, SO, SO, SUP, SUP, CON, SUP]
    assert labels(ensemble.class_union(grid(spark, 7), p, SENTENCES, {}, 1)) == [UE, UCM, UE, UE, SUP, CON, SUP]
    assert labels(ensemble.class_union(grid(spark, 7), p, SENTENCES, {CON: 3, UE: 0}, 2)) == [UE, SUP, UE, UE, SUP, UE, SUP]
    with pytest.raises(ValueError, match="at least 1"):
        ensemble.pooled_union(grid(spark, 1), p, SENTENCES, 0)


def test_overlays_keep_the_base(spark):
    base = preds(spark, [UE], [SUP], [SUP]).filter("sent_index < 3")
    sources = preds(spark, [CON, CON], [CON, SO], [(SO, -0.9), (CON, None)], [CON, CON])
    out = ensemble.asymmetric_union(grid(spark, 4), base, sources, SENTENCES, {CON: 2}, 1)
    assert [(r.label, r.origin) for r in out.orderBy("sent_index").collect()] == [(UE, "kept"), (SO, "added"), (SO, "added"), (CON, "added")]
    out = ensemble.confident_union(grid(spark, 3), base, sources, SENTENCES, {SO: -0.5, CON: -1.0})
    assert labels(out) == [UE, CON, SUP]
    assert {(r.label, r.kept, r.added) for r in ensemble.overlay_counts(out, SENTENCES).collect()} == {(UE, 1, 0), (CON, 0, 1)}


def test_vetoes_and_trims(spark):
    p = preds(spark, [(UE, None)], [SUP], [SUP])
    assert labels(ensemble.veto_lone(p, SENTENCES)) == [SUP] * 3
    assert labels(ensemble.veto_lone(p, SENTENCES, gate=-0.05)) == [UE, SUP, SUP]
    assert labels(ensemble.suppress(preds(spark, [(UE, None)], [(UE, -0.5)], [(UE, -0.4)]), SENTENCES, -0.4)) == [UE, SUP, UE]
    m = preds(spark, [UE, UE], [UE], [SO])
    assert labels(ensemble.trim(m.filter("member = 1"), m, SENTENCES, {UE: 1})) == [UE, SUP, SO]


def test_uncertainty_bias_needs_some_confidence(spark):
    p = preds(spark, [(UE, None)], [(UE, -0.6)], [(UE, -0.4)], [(SUP, None)])
    assert labels(densify.suppress_uncertain(p, SENTENCES, 0.5)) == [SUP, SUP, UE, SUP]
    assert labels(densify.suppress_uncertain(p.withColumn("conf", F.lit(None).cast("double")), SENTENCES, 0.5)) == [UE, UE, UE, SUP]
    assert labels(densify.suppress_uncertain(p, SENTENCES, 0.0)) == [UE, UE, UE, SUP]


def test_percentiles_round_halves_to_even(spark):
    p = preds(spark, *[[(UE, -float(i))] for i in range(1, 8)])  # places 1.5, 3 and 4.5
    got = {r.percent: r.tau for r in ensemble.confidence_percentiles(p, SENTENCES, stored).collect()}
    assert got == {25: -5.0, 50: -4.0, 75: -3.0}


def test_assembly_keeps_the_first_row_and_lists_rejects(spark):
    raw = spark.createDataFrame([(1, 0, UE, -0.1, 1), (1, 0, SO, -0.1, 0), (1, 1, "odd", None, 2), (1, -1, UE, None, 3), (1, 9, UE, None, 4), (7, 0, UE, None, 5)], "id long, sent_index int, label string, conf double, seq int")
    sizes = spark.createDataFrame([(1, 3)], "id long, n int")
    out = densify.assemble(raw, densify.grid(sizes), SENTENCES).orderBy("sent_index").collect()
    assert [(r.label, r.origin) for r in out] == [(SO, "given"), (SUP, "invalid"), (SUP, "missing")]
    assert sorted(r.reason for r in densify.rejects(raw, sizes).collect()) == ["index_out_of_range", "index_out_of_range", "unknown_id"]
    sub = densify.to_submission(densify.assemble(raw, densify.grid(sizes), SENTENCES))
    assert sub.first().labels == [SO, SUP, SUP] and densify.from_submission(sub).count() == 3


def test_scores(spark):
    gold = spark.createDataFrame([(1, 0, [UE, SO]), (1, 1, [SUP]), (2, 0, [CON])], "id long, sent_index int, types array<string>")
    p = spark.createDataFrame([(1, 0, SO), (1, 1, SUP), (2, 0, "odd")], "id long, sent_index int, label string")
    scored = score.credited(gold, p, SENTENCES)
    r = score.report(scored, SENTENCES).first()
    assert r.pem == 0.5 and r.sentence_accuracy == pytest.approx(2 / 3)
    assert r.macro_f1 == pytest.approx((2 / 3 + 1) / 5) and r.score == pytest.approx((r.macro_f1 + 0.5) / 2)
    assert {x.kind: x.n for x in score.errors(scored, SENTENCES).collect()} == {"MISSED_MINORITY": 1}
    assert score.report(score.credited(gold.limit(0), p, SENTENCES), SENTENCES).count() == 1
    row = sinks.ledger_row(score.report(scored, SENTENCES), score.per_label(scored, SENTENCES), "t", SENTENCES).first()
    assert row.tag == "t" and row.f1_scope_overgeneralization == 1.0 and row.f1_contradiction == 0.0


def test_soft_bottleneck(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 1.0), ("a", 0.25), ("b", 300.0)], "g string, l double")
    got = {r.g: r.s for r in score.soft_bottleneck(df, "l", ["g"], 5.0).collect()}
    assert got["a"] == pytest.approx(0.788474, abs=1e-6) and got["b"] == 300.0
    assert {r.g: r.s for r in score.soft_bottleneck(df, "l", ["g"], 0).collect()}["a"] == pytest.approx(1.45 / 3)
    assert score.blended_loss(df.filter("g = 'a'"), "l", ["g"], 5.0, 1.0).first().loss == pytest.approx(0.788474, abs=1e-6)
    t = "array<struct<tok:string,loss:double,is_resp:boolean>>"
    rows = [([("p", 9.0, False), ("a", 1.0, True), ("{", 3.0, True), ("x", 5.0, True)],), ([("a", 1.0, True), ("b", 2.0, True)],), ([("p", 9.0, False)],)]
    assert [r[0] for r in spark.createDataFrame(rows, f"t {t}").select(score.masked_mean(F.col("t"))).collect()] == [4.0, 1.5, 0.0]


def test_rank_correlation(spark):
    df = spark.createDataFrame([("u", 1.0, 1.0), ("u", 2.0, 3.0), ("u", 2.0, 2.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("o", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 2.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in rank.gate(rank.spearman(df, "x", "y", ("k",))).collect()}
    assert got["u"].rho == pytest.approx(0.8660254) and got["u"].decision == "trustworthy"
    assert math.isnan(got["c"].rho) and math.isnan(got["o"].rho) and got["c"].decision == "undefined"
    assert got["d"].rho == pytest.approx(-1) and got["d"].decision == "abandon"


def test_components_do_not_depend_on_order_or_partitions(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(5, 5), (None, 3)] + [(100, k) for k in range(101, 140)]
    want = {**{i: i - i % 20 for i in range(60)}, 60: 40, **{k: 100 for k in range(100, 140)}}
    want[60] = 40 if (59, 60) in edges else 60
    for n in (1, 5):
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges[::-1], "a long, b long").repartition(n)).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 99
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_splits_keep_components_apart(spark):
    links = spark.createDataFrame([(i, f"k{i // 3}") for i in range(60)] + [(0, "k9")], "id long, key string")
    found = components.connected_components(split.shared_key_edges(links))
    members = links.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sides = split.component_split(members, split_order("component"), 0.3, stored)
    assert split.leaks(links, sides).count() == 0 and 18 <= sides.filter("split = 'dev'").count() <= 24
    bad = sides.withColumn("split", F.when(F.col("id") == 0, "dev").when(F.col("id") == 1, "train").otherwise(F.col("split")))
    assert split.leaks(links, bad).count() >= 1


def split_order(key):
    return F.pmod(F.col(key) * 7919, F.lit(1000003)) / F.lit(1000003.0).cast("double")


def test_quotas_and_density(spark):
    g = spark.createDataFrame([(i, 3 + i % 5, 1 if i < 6 else 0) for i in range(40)], "id long, n int, minority int")
    s = split.stratified_split(g.select("id", (F.col("minority") > 0).alias("hard")), split_order("id"), 0.25, stored)
    assert s.filter("split = 'dev' and id < 6").count() == 2 and s.filter("split = 'dev' and id >= 6").count() == 8
    out = split.densest(g, 0.6, split_order("id"), stored)
    assert out.filter("minority > 0").count() == 6 and [r.n for r in out.filter("minority = 0").collect()] == [7] * 4
    assert split.densest(g, 1.0, split_order("id"), stored).count() == 6 and split.densest(g, 0.0, split_order("id"), stored).count() == 40
    assert split.densest(g.filter("id in (0, 7)"), 0.99, split_order("id"), stored).count() == 2
    assert split.guaranteed_sample(g, split_order("id"), 10, 4, stored).agg(F.sum("minority")).first()[0] >= 4
    assert split.assert_empty(g.filter("id < 0"), "none").count() == 0
    with pytest.raises(Exception, match="rows are left"):
        split.assert_empty(g, "rows are left").collect()


@pytest.mark.parametrize(("rate", "low", "high"), [(1.0, 0, 0), (2.0, 40, 40), (2.5, 50, 70), (0.5, 0, 0)])
def test_oversampling(spark, rate, low, high):
    s = spark.createDataFrame([(f"c{i // 2}", i % 2, UE, ["a", "b", "c"]) for i in range(40)] + [("d", 0, SUP, ["a"])], "channel string, sent_index int, label string, rationales array<string>")
    out = resample.oversample(s, SENTENCES, rate, F.pmod(F.xxhash64("channel", "sent_index"), F.lit(1000)) / F.lit(1000.0)).collect()
    copies = [r for r in out if r.copy]
    assert low <= len(copies) <= high and len({r.channel for r in copies}) == len(copies)
    assert sum(not r.copy for r in out) == 41 and all(r.rationale == "abc"[r.copy % 3] for r in copies)


def test_shards_and_holdout(spark):
    g = spark.range(23).withColumn("hard", F.lit(True))
    out = resample.shards(g, split_order("id"), 5, stored).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in out} == {i: 4 for i in range(5)}
    assert split.holdout(g.select("id"), split_order("id"), 0.15, stored).filter("split = 'validation'").count() == 3


def test_injection_matching_and_packing(spark):
    a = spark.createDataFrame([(i, "d1" if i % 2 else "d2", [f"N{i % 3}"]) for i in range(30)], "id long, domain string, nouns array<string>")
    pairs = synthesize.match(a.filter("id < 15").withColumn("donor_id", F.col("id")), a, stored).collect()
    info = {r.id: r for r in a.collect()}
    assert len({p.anchor_id for p in pairs}) == len(pairs) == len({p.donor_id for p in pairs}) and len(pairs) >= 12
    assert all(info[p.anchor_id].domain != info[p.donor_id].domain and not set(info[p.anchor_id].nouns) & set(info[p.donor_id].nouns) for p in pairs)
    anchor = spark.createDataFrame([(1, [("a.", [SUP]), ("b.", [UE])], [("x",)])], "id long, sentences array<struct<sentence:string,types:array<string>>>, evidence array<struct<img_path:string>>")
    donor = spark.createDataFrame([(9, "new.", CON, [("y",)])], "donor_id long, sentence string, label string, evidence array<struct<img_path:string>>")
    for place, want in ((1, "a. new. b."), (2, "a. b. new."), (7, "a. b. new.")):
        r = synthesize.inject(anchor, donor, spark.createDataFrame([(9, 1)], "donor_id long, anchor_id long"), F.lit(place)).first()
        assert r.claim_text == want and len(r.evidence) == 2
    g = spark.createDataFrame([(i, 5, 1 + i % 2, [f"s{i % 4}"]) for i in range(12)] + [(99, 40, 3, ["z"]), (98, 5, 0, ["s0"]), (97, 5, None, ["s0"]), (96, None, 1, None)], "id long, n int, minority int, stems array<string>")
    packs = synthesize.pack_all(g, stored).collect()
    by = {}
    for r in packs:
        by.setdefault(r.synthetic, []).append(r.id)
    assert len({r.id for r in packs}) == len(packs) and all(2 <= len(v) <= 3 for v in by.values()) and not {96, 97, 98, 99} & {r.id for r in packs}


def test_matching_is_maximal_where_few_pairs_fit(spark):
    # a hot domain on both sides and a noun that nearly all share: each of a few donors fits a few anchors only
    rows = [(i, "hot", ["All"]) for i in range(400)] + [(400 + i, "rare", ["All"]) for i in range(20)] + [(420 + i, "hot", [f"N{i}"]) for i in range(4)]
    df = spark.createDataFrame([(2 * i + side, d, n) for side in (0, 1) for i, d, n in rows] + [(2000, None, ["X"]), (2001, "other", None)], "id long, domain string, nouns array<string>")
    donor, anchor = df.filter("id % 2 = 1").withColumn("donor_id", F.col("id")), df.filter("id % 2 = 0")
    info = {r.id: r for r in df.collect()}
    fits = lambda a, b: a.domain is not None and b.domain is not None and a.nouns is not None and b.nouns is not None and a.domain != b.domain and not set(a.nouns) & set(b.nouns)
    for options in ({}, {"block": 50}):
        found = synthesize.match(donor, anchor, stored, **options)
        assert synthesize.fitting_donors(donor, anchor, found, stored).isEmpty()
        able = sum(any(fits(info[a], info[b]) for b in info if b % 2 == 0) for a in info if a % 2)
        assert sum(r.donors for r in synthesize.fitting_donors(donor, anchor, found.limit(0), stored).collect()) == able == 24
        pairs = [(p.donor_id, p.anchor_id) for p in found.collect()]
        used = {x for p in pairs for x in p}
        assert pairs and len(used) == 2 * len(pairs) and all(fits(info[a], info[b]) for a, b in pairs)
        assert not [(a, b) for a in info if a % 2 and a not in used for b in info if not b % 2 and b not in used and fits(info[a], info[b])]
    assert synthesize.match(donor.limit(0), anchor, stored).count() == 0


def compatible(a, b):
    return a.n + b.n <= 16 and len({*a.stems} | {*b.stems}) <= 4


def test_packing_goes_on_until_no_two_groups_fit(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 16), rng.randint(0, 2), sorted(rng.sample([f"s{k}" for k in range(40)], rng.randint(0, 6))) + ["hot"] * (i % 3 == 0)) for i in range(600)]
    g = spark.createDataFrame(rows, "id long, n int, minority int, stems array<string>")
    info = {r.id: r for r in g.collect()}
    for block in (2000, 30):
        by, packs = {}, stored(synthesize.pack_all(g, stored, block=block), "packs")
        assert synthesize.fitting_groups(g, packs).isEmpty() and not synthesize.fitting_groups(g, packs.filter("position > 0")).isEmpty()
        for r in packs.orderBy("position").collect():
            by.setdefault(r.synthetic, []).append(info[r.id])
        used = [r.id for p in by.values() for r in p]
        assert by and len(set(used)) == len(used)
        assert all(len(p) > 1 and sum(r.n for r in p) <= 16 and sum(r.minority for r in p) >= 2 and len({x for r in p for x in r.stems}) <= 4 for p in by.values())
        rest = [r for r in info.values() if r.minority and r.id not in used]
        assert not [(a.id, b.id) for k, a in enumerate(rest) for b in rest[:k] if compatible(a, b)]
    assert synthesize.pack_all(g.limit(0), stored).count() == 0


def test_packed_orders_count_all_their_suppliers(spark):
    from loomkit.plans import catalog, fixtures

    held = {}
    for r in fixtures.sentences(spark, "/root/testdata/sf0.001").select("id", "l_suppkey").collect():
        held.setdefault(r.id, set()).add(r.l_suppkey)
    packs = {}
    for r in catalog.packed_groups(spark, "/root/testdata/sf0.001").collect():
        packs.setdefault(r.synthetic, set()).update(held[r.id])
    assert packs and all(len(x) <= 4 for x in packs.values())


def test_corpora(spark):
    ev = "array<struct<type:string,img_path:string,image_caption:string,table_caption:string>>"
    rows = spark.createDataFrame([("p#1", 0, "claim", "sent", SUP, [("image", "a.jpg", '["c"]', None), ("table", "", None, "t")], "why {x}")], f"channel string, sent_index int, claim_text string, sentence string, label string, evidence {ev}, r string")
    r = render.sentence_corpus(rows, render.Template(root="/d/"), "r").first()
    assert r.messages[1].content == "Labels and their meaning.\n\nEvidence:\n[IMAGE 1] <image>\nCaption: c\n[TABLE 2]\nCaption: t\n\nClaim paragraph:\nclaim\n\nTARGET sentence to classify:\nsent"
    assert r.messages[2].content == '<analysis>why (x)</analysis>\n{"label": "Supported"}' and r.images == ["/d/a.jpg"]
    recs = spark.createDataFrame([("p", "claim", ["s1", None], [SUP, CON], [CON], [])], f"id string, claim_text string, sentences array<string>, labels array<string>, candidates array<string>, evidence {ev}")
    r = render.group_corpus(recs, render.Template()).first()
    assert r.messages[2].content == '{"labels": ["Supported", "Contradiction"]}' and r.images is None and r.messages[1].content.endswith("1. s1\n2. ")
    r = render.corrector_corpus(recs, render.Template(), SUP).first()
    assert "1. s1 [candidate: Contradiction]" in r.messages[1].content
    p = render.prompts_only(render.group_corpus(recs, render.Template()), F.lit(SUP)).first()
    assert [m.role for m in p.messages] == ["system", "user"]
    ec = "array<struct<type:string,img_path:string,image_caption:array<string>,table_caption:array<string>>>"
    recs = spark.createDataFrame([(1, [("image", "a", ["x"], None), ("table", "b", None, None)]), (2, [("table", "a", [], ["t"])]), (3, [])], f"id long, evidence {ec}")
    cache = spark.createDataFrame([("a", "seen"), ("b", " ")], "img_path string, text string")
    out = {r.id: r for r in render.enrich_captions(recs, cache).collect()}
    assert out[1].evidence[0].image_caption == ["x", "[OCR] seen"] and out[1].changed == 1 and out[1].evidence[1].table_caption is None
    assert out[2].evidence[0].image_caption == ["[OCR] seen"] and out[3].changed == 0


def test_curation(spark):
    units = spark.createDataFrame([("r", i, f"text {i}", i, "k%d" % i, SUP) for i in range(4)], "record_id string, sent_idx int, rationale string, seq int, unit_key string, target_label string")
    audit = spark.createDataFrame([("k0", 1, "final", "dropped", "n", None), ("k0", 2, "final", "pass", None, None), ("k1", 1, "final", "rewritten", None, "new"), ("k2", 1, "final", "dropped", "bad", None), ("k3", 1, "verify", None, None, None)], "unit_key string, seq int, phase string, outcome string, note string, new_rationale string")
    merged = curate.merge_audit(units, audit)
    got = {r.unit_key: (r.outcome, r.verified, r.rationale) for r in merged.collect()}
    assert got == {"k0": ("pass", True, "text 0"), "k1": ("rewritten", True, "new"), "k2": ("dropped", False, "text 2"), "k3": ("unverified", False, "text 3")}
    sentences = spark.createDataFrame([("r", i, SUP) for i in range(7)], "record_id string, sent_idx int, target_label string")
    log = spark.createDataFrame([("r", 4, "cannot_justify"), ("r", 5, "gave_up"), ("r", 4, "gave_up")], "record_id string, sent_idx int, status string")
    rest = {r.sent_idx: r.reason for r in curate.label_only(sentences, merged, log).collect()}
    assert rest == {2: "bad", 4: "cannot_justify", 5: "gave_up", 6: "no_unit"}
    assert {r.sent_idx for r in curate.todo(sentences, log, ["record_id", "sent_idx"], ["gave_up"]).collect()} == {0, 1, 2, 3, 6}
    assert curate.throughput(log.withColumn("ts", F.lit(1.0)), "ts").first().per_minute is None
    c = curate.coverage(merged.filter("outcome <> 'dropped'"), sentences).first()
    assert (c.sentences, c.covered, c.many) == (7, 3, 0)
    e = spark.createDataFrame([("so it is very plainly shown verdict: Contradiction", CON, [CON]), ("short verdict: Contradiction", CON, [CON]), ("x", SUP, [SUP])], "entry string, target_label string, gold_types array<string>")
    assert sorted(str(r.reason) for r in curate.judged_entries(e, SENTENCES, F.lit(UE)).collect()) == ["None", "too_short", "verdict!=target"]


def test_submission_checks(spark):
    sizes = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "id string, n int")
    sub = spark.createDataFrame([("a", [SUP, "odd"]), ("a", [SUP, SUP]), ("b", [SUP, SUP]), ("", [SUP]), ("z", [SUP]), ("c", None)], "id string, labels array<string>")
    got = sorted((r.rule, r.id) for r in quality.submission_problems(sub, sizes, SENTENCES).collect())
    assert got == [("duplicate_id", "a"), ("invalid_label", "a"), ("labels_missing", "c"), ("missing_id", ""), ("record_count", None), ("unknown_id", "z"), ("wrong_length", "b")]
    ok = spark.createDataFrame([("a", [SUP, SUP]), ("b", [SUP]), ("c", [SUP])], "id string, labels array<string>")
    assert quality.submission_problems(ok, sizes, SENTENCES).isEmpty()
    p = spark.createDataFrame([(1, "a", 0, SUP), (2, "a", 0, SUP), (3, "a", 0, SUP), (3, "a", 1, SUP)], "member int, id string, sent_index int, label string")
    assert [r.member for r in quality.aligned(p).collect()] == [3]
    assert {r.member: r.cells for r in quality.covered(p, p.select("id", "sent_index").distinct()).collect()} == {1: 1, 2: 1}
    with pytest.raises(ValueError, match="has 3 rows"):
        quality.require_rows(ok, 4, "sub")


def test_conflict_shapes_of_nothing(spark):
    g = spark.createDataFrame([], "id long, n int, minority int")
    r = conflict.summary(g).first()
    assert r.records == 0 and r.mean_len == 0 and r.pct_multi == 0


def test_files(spark, tmp_path):
    good = '{"id": "x", "claim_text": "c", "sentence_label": [{"sentence": "é", "types": ["Supported"]}]}\n\n{"claim_text": "d", "evidence_bundle": [{"type": "image", "image_caption": ["a", "b"]}]}\n{"id": "", "claim_text": "e"}\n'
    (tmp_path / "r.jsonl").write_text(good)
    (tmp_path / "bad.jsonl").write_text(good + "{broken\n")
    df = records.scan(spark, str(tmp_path / "r.jsonl"), records.RECORD)
    assert df.count() == 3 and df.filter("claim_text = 'd'").first().evidence_bundle[0].image_caption == '["a", "b"]'
    with pytest.raises(Exception):
        records.scan(spark, str(tmp_path / "bad.jsonl"), records.RECORD).collect()
    assert records.scan_log(spark, str(tmp_path / "bad.jsonl"), records.RECORD).select("claim_text").collect().__len__() == 3
    assert records.scan_log(spark, str(tmp_path / "none.jsonl"), records.RECORD).count() == 0
    rows, broken = records.scan_strict(spark, str(tmp_path / "bad.jsonl"), records.RECORD)
    assert [r.line for r in broken.collect()] == [4]
    ids = [r.id for r in records.with_ids(rows).orderBy("line").collect()]
    assert ids == ["x", "track1-000002", "track1-000003"]
    assert records.sentences(df, SUP).first().sentence == "é"
    (tmp_path / "split.json").write_text('{"x": "train", "y": "dev"}')
    splits = records.split_map(spark, str(tmp_path / "split.json"))
    assert {(r.id, r.split) for r in splits.collect()} == {("x", "train"), ("y", "dev")}
    assert records.evaluation_records(df, splits, "train").first().sentences == ["é"]
    for name in ("m1", "m2"):
        (tmp_path / f"{name}.member").write_text('{"id": "a", "labels": ["Supported"]}\n{"id": "a", "labels": ["Contradiction"]}\n')
    assert {r.member for r in records.members(spark, str(tmp_path / "*.member"), records.SUBMISSION, {"m2": "second"}).collect()} == {"m1", "second"}
    lines = records.scan_strict(spark, str(tmp_path / "m1.member"), records.SUBMISSION)[0]
    assert records.last_of(lines, ["id"]).first().labels == [CON] and records.duplicate_ids(lines).first().n == 2 and records.first_n(lines, "line", 1).first().labels == [SUP]
    sinks.write_jsonl(lines.select("id", "labels"), str(tmp_path / "out"))
    assert records.scan(spark, str(tmp_path / "out"), records.SUBMISSION).count() == 2
    table = str(tmp_path / "table")
    sinks.replace_table(lines.select("id"), table)
    sinks.replace_table(lines.select("id").limit(1), table)
    assert sinks.read_table(spark, table).count() == 1
    with pytest.raises(ValueError, match="nothing was written"):
        sinks.replace_table(lines, table, bad=lines)
    assert sinks.read_table(spark, table).count() == 1
    sinks.write_split_map(splits, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    row = splits.select("id")
    sinks.append_ledger(row, str(tmp_path / "ledger"))
    sinks.append_ledger(row, str(tmp_path / "ledger"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ledger")).count() == 4
