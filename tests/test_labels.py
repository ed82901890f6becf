"""Normalisation of labels and model output on literal cases."""

import pytest
from pyspark.sql import functions as F

from loomkit.config import SENTENCES
from loomkit.functions import labels as L
from loomkit.functions import normalize as N
from loomkit.operators import curate

SUP, UCM, UE, SO, CON = SENTENCES.labels


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [
    ('{"label": "Contradiction"}', (CON, True)), ('well {"label": "unsupported  ENTITY"} so', (UE, True)), ("unsupported entity", (UE, True)),
    ("first Supported, then Unsupported Entity", (SUP, True)), ("the Unsupported Entity is Supported", (UE, True)), ('{"label": "nonsense"}', (SUP, False)),
    ("", (SUP, False)), (None, (SUP, False)), ('{a {"label": "Contradiction"', (CON, True)), ('"label" : "Scope Overgeneralization" }{', (SO, True)),
])
def test_single_label(spark, text, want):
    r = one(spark, text, lambda x: N.single_label(x, SENTENCES))
    assert (r.label, r.parsed_ok) == want


@pytest.mark.parametrize(("text", "n", "want"), [
    ('{"labels": ["Supported", "contradiction"]}', 2, ([SUP, CON], True)), ('{"labels": ["Supported", "odd", "Contradiction"]}', 2, ([SUP, SUP], False)),
    ('so "Supported" and "x" and "Unsupported Entity"', 2, ([SUP, UE], True)), ('{"labels": ["Contradiction"]}', 3, ([CON, SUP, SUP], False)), (None, 2, ([SUP, SUP], False)), ('{"labels": []}', 1, ([SUP], False)),
])
def test_label_list(spark, text, n, want):
    r = one(spark, text, lambda x: N.label_list(x, F.lit(n), SENTENCES))
    assert (r.labels, r.parsed_ok) == want


def test_last_label_and_reward(spark):
    last = lambda t: one(spark, t, lambda x: N.last_label(x, SENTENCES))
    assert last('{"label": "Supported"}\n{"label": "Contradiction"}\n\n') == CON
    assert last('"label": "Supported" "label": "Unsupported Entity" end') == UE
    assert last("Supported") is None and last(None) is None
    reward = lambda t, gold: one(spark, t, lambda x: N.reward(x, F.array(*[F.lit(g) for g in gold]), SENTENCES))
    assert reward('{"label": "Contradiction"}', [CON, SO]) == 4.5
    assert reward('{"label": "Contradiction"}', [SUP]) == 0.0
    assert reward("none", [SUP]) == -1.0
    assert reward("<analysis>" + "w " * 81 + '</analysis>\n{"label": "Supported"}', [SUP]) == -1.0


def test_free_text_and_final_line(spark):
    for t, want in (("It CONTRADICTs", CON), ("a causal claim", UCM), ("entity", UE), ("over-general", SO), ("fine", SUP), (None, SUP)):
        assert one(spark, t, N.free_text_label) == want
    final = lambda t, n: one(spark, t, lambda x: N.final_line(x, F.lit(n), SENTENCES))
    assert final("x\nFINAL: contradiction ||| supported\nmore", 2) == [CON, SUP]
    assert final("FINAL: a ||| b\nThen Unsupported Entity.", 3) == [UE, SUP, SUP]
    assert final("Contradiction, Supported and Contradiction", 2) == [CON, SUP]


def test_verdicts_and_rationales(spark):
    cut = lambda t: tuple(one(spark, t, N.verdict_split))
    assert cut("the verdict is clear. Verdict: Contradiction") == ("the verdict is clear.", CON)
    assert cut("no mark") == ("no mark", None)
    assert cut("the verdict is " + "long " * 12) == (("the verdict is " + "long " * 12).strip(), None)
    clean = lambda t: one(spark, t, lambda x: N.clean_rationale(x, SENTENCES))
    assert clean("RATIONALE: it  fails -> Contradiction") == "it fails"
    assert clean("Claim: so it is; verdict: Supported.") == "claim so it is"
    assert clean("it is an unsupported entity") == "it is an unsupported entity"
    assert clean("so (Contradiction) verdict: no") == "so"
    assert clean("so -> Contradiction (→ Supported) label: Unsupported Entity. => [(") == "so"
    assert clean("a (b) is so -> of no label") == "a (b) is so -> of no label"
    assert clean("(" * 20000 + "x") == "(" * 20000 + "x"
    assert clean("so" + " -> Supported" * 5000) == "so"
    assert one(spark, "<Analysis>a {b}\n c</analysis>", N.sanitized) == "a (b) c"
    assert tuple(one(spark, "cannot_justify this", lambda x: N.conditioned_output(x, SENTENCES))) == ("cannot_justify", "")
    assert tuple(one(spark, "too few", lambda x: N.conditioned_output(x, SENTENCES))) == ("bad_output", "too_short(2w)")
    assert tuple(one(spark, "one two three four five", lambda x: N.conditioned_output(x, SENTENCES))) == ("ok", "one two three four five")
    assert tuple(one(spark, "verdict: pass\nREASON: fine\nmore", N.audit_output)) == ("PASS", "fine")
    assert tuple(one(spark, "nothing", N.audit_output)) == (None, "")


def test_confidences_and_gold(spark):
    kind = "array<struct<token:string,logprob:double>>"
    r = one(spark, [("a", -9.0), ("{", -0.1), ("x", -0.5), ("y{", -0.2), ("}", -0.3), ("z", None)], N.confidences, kind)
    assert (r["first"], r["least"], r["n"]) == (-9.0, -0.3, 5) and r["sum"] == pytest.approx(-0.5)
    assert tuple(one(spark, [], N.confidences, kind)) == (None, None, None, None)
    gold = lambda t: one(spark, t, lambda x: N.gold_list(x, SENTENCES))
    assert gold('["supported", "x", "Contradiction"]') == [SUP, CON] and gold("contradiction") == [CON] and gold(None) == []


def test_numbered_lines(spark):
    text = "intro\n1) first\ngoes on\n\n2) second verdict: supported\nFINAL: Supported ||| Contradiction\n3) late"
    bad = ["1) a\n1) b\nFINAL: x ||| y", "1) a\nFINAL: x", "1) a\n3) b\nFINAL: x ||| y", "1) a"]
    df = spark.createDataFrame([(0, text), *enumerate(bad, 1)], "k int, t string")
    out = curate.numbered_lines(df, "k", "t").orderBy("index").collect()
    assert [(r.k, r["index"], r.entry, r.final) for r in out] == [(0, 1, "first goes on", "Supported"), (0, 2, "second verdict: supported", "Contradiction")]


def test_label_columns(spark):
    df = spark.createDataFrame([([SO, UE],), ([UE, SO],), ([],), ([CON, "new"],)], "t array<string>")
    freq = F.create_map(*[v for k, n in ((SO, 3), (UE, 3), (CON, 1)) for v in (F.lit(k), F.lit(n))])
    assert [r[0] for r in df.select(L.rarest_label(F.col("t"), freq, SUP)).collect()] == [SO, UE, SUP, "new"]
    assert [r[0] for r in df.select(L.first_by_priority(F.col("t"), SENTENCES.by_class, SUP)).collect()] == [UE, UE, SUP, CON]
    ev = spark.createDataFrame([([("image",), (None,)],), ([("table",)],), ([("table",), ("image",)],), ([],), (None,)], "e array<struct<type:string>>")
    assert [r[0] for r in ev.select(L.evidence_bucket(F.col("e"))).collect()] == ["all-image", "all-table", "mixed", "mixed", "mixed"]
    cap = spark.createDataFrame([(("[]", '["t", "u"]'),), (("plain", None),), ((None, None),), (('["a "]', "x"),)], "c struct<image_caption:string,table_caption:string>")
    assert [r[0] for r in cap.select(L.captions(F.col("c"), "image_caption", "table_caption")).collect()] == ["t u", "plain", "", "a"]
    assert one(spark, "See Fig. 3 and NASA-x of Ab", L.proper_nouns) == ["See", "Fig", "NASA-x"]
    assert one(spark, "images/a.b/c.d.jpg", L.stem) == "c.d" and one(spark, "", L.stem) is None
    assert one(spark, "rights heat heat", lambda x: L.domain(x, {"a": ["rights"], "b": ["heat"]})) == "b"
    assert one(spark, "Heat rights", lambda x: L.domain(x, {"a": ["rights"], "b": ["heat"]})) == "a"
