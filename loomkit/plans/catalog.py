"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.config import LENGTH_BINS, SENTENCES, LabelSet
from loomkit.functions import labels as L
from loomkit.functions import normalize as N
from loomkit.sources.store import stored
from loomkit.operators import components, conflict, curate, densify, ensemble, quality, rank, render, resample, score, split, synthesize
from loomkit.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MEMBERS = 5
CELL = ["id", "sent_index"]
DOMAINS = {"law": ["reserved", "licensed", "rights"], "care": ["heat", "the", "and"], "trade": ["por", "que", "der"]}

_SENT = """s AS (SELECT l_orderkey AS id, l_partkey, l_suppkey,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS int) AS sent_index FROM lineitem),
sent AS (SELECT id, sent_index, l_partkey, l_suppkey,
  CASE WHEN c < 86 THEN ['Supported'] WHEN c < 90 THEN ['Scope Overgeneralization'] WHEN c < 93 THEN ['Unsupported Entity', 'Scope Overgeneralization']
   WHEN c < 96 THEN ['Unsupported Causal Mechanistic'] WHEN c < 98 THEN ['Contradiction'] ELSE ['Unsupported Entity'] END AS types
  FROM (SELECT *, (l_partkey * 31 + id * 17 + sent_index * 13) % 100 AS c FROM s))"""
_PRED = (
    _SENT
    + """,
pred AS (SELECT member, id, sent_index,
  CASE WHEN e < 15 THEN types[1] WHEN e < 18 THEN 'Supported' WHEN q = 0 THEN 'Contradiction' WHEN q = 1 THEN 'Scope Overgeneralization'
   WHEN q = 2 THEN 'Unsupported Causal Mechanistic' ELSE 'Unsupported Entity' END AS label,
  CASE WHEN r < 950 THEN -r / CAST(1000 AS double) END AS conf
  FROM (SELECT *, (id * (m * 2 + 1) + sent_index * 7 + m * 11) % 20 AS e, (l_suppkey + m) % 4 AS q, (id + m * 37 + sent_index * 3) % 1000 AS r, CAST(m AS int) AS member
    FROM sent CROSS JOIN range(1, 6) x(m)) WHERE (id + m + sent_index) % 97 <> 0)"""
)
_DIRTY = (
    _PRED
    + """,
raw AS (SELECT member, id, sent_index, CASE WHEN id % 107 = 0 THEN 'unknown' ELSE label END AS label, conf, 0 AS seq FROM pred
  UNION ALL SELECT member, id, sent_index, 'Contradiction', conf, 1 FROM pred WHERE (id + sent_index) % 89 = 0
  UNION ALL SELECT member, id, sent_index + 1000, label, conf, 2 FROM pred WHERE id % 101 = 0
  UNION ALL SELECT member, -id, sent_index, label, conf, 3 FROM pred WHERE id % 103 = 0),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member, id, sent_index ORDER BY seq) AS n FROM raw) WHERE n = 1),
dense AS (SELECT m.member, s.id, s.sent_index, s.types, f.conf,
  CASE WHEN f.label IN ('Supported', 'Unsupported Causal Mechanistic', 'Unsupported Entity', 'Scope Overgeneralization', 'Contradiction') THEN f.label ELSE 'Supported' END AS label
  FROM sent s CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS int) AS member) m LEFT JOIN first f ON f.member = m.member AND f.id = s.id AND f.sent_index = s.sent_index)"""
)
_LABELS = "lab AS (SELECT unnest(['Supported', 'Unsupported Causal Mechanistic', 'Unsupported Entity', 'Scope Overgeneralization', 'Contradiction']) AS label)"
_VOTES = (
    _PRED
    + """,
v AS (SELECT id, sent_index, label, count(*) AS n FROM pred WHERE label <> 'Supported' GROUP BY ALL)"""
)
_BY_CLASS = "CASE label WHEN 'Contradiction' THEN 0 WHEN 'Unsupported Causal Mechanistic' THEN 1 WHEN 'Unsupported Entity' THEN 2 ELSE 3 END"
_POOLED = "CASE label WHEN 'Contradiction' THEN 0 WHEN 'Scope Overgeneralization' THEN 1 WHEN 'Unsupported Causal Mechanistic' THEN 2 ELSE 3 END"
_SCORED = (
    _PRED
    + """,
sc AS (SELECT p.member, s.id, s.sent_index, s.types, p.label, list_contains(s.types, p.label) AS hit,
  CASE WHEN list_contains(s.types, p.label) THEN p.label ELSE s.types[1] END AS y_true, s.l_suppkey FROM sent s JOIN pred p USING (id, sent_index))"""
)
_GROUPS = (
    _SENT
    + """,
g AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE types[1] <> 'Supported') AS minority FROM sent GROUP BY id)"""
)
_LINKS = "k AS (SELECT DISTINCT doc_id AS id, trim(line) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) >= 20)"


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL after WITH; without SQL, tests hold it against a plain version."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {sql}"
        return f

    return add


def _order(key: str = "id", factor: int = 7919) -> Column:
    """An order in [0, 1) that SQL can express."""
    return F.pmod(F.col(key) * factor, F.lit(1000003)) / F.lit(1000003.0).cast("double")


def _round(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _cells(spark, d) -> DataFrame:
    return densify.grid(fx.sizes(spark, d))


def _dense(spark, d) -> DataFrame:
    return densify.named(densify.spread(fx.dirty_predictions(spark, d), _cells(spark, d), SENTENCES, list(range(1, MEMBERS + 1))), SENTENCES)


def _dense_scored(spark, d, members: int = MEMBERS) -> DataFrame:
    return score.credited_members(fx.sentences(spark, d), fx.dirty_predictions(spark, d), SENTENCES, list(range(1, members + 1)))


def _scored(spark, d) -> DataFrame:
    return score.credited(fx.sentences(spark, d), fx.predictions(spark, d), SENTENCES)


def _groups(spark, d) -> DataFrame:
    return conflict.shapes(fx.sentences(spark, d), SENTENCES)


_PER_LABEL = """,
x AS (SELECT {keys} l.label, count(*) FILTER (WHERE y_true = l.label AND t.label = l.label) AS tp, count(*) FILTER (WHERE y_true <> l.label AND t.label = l.label) AS fp,
  count(*) FILTER (WHERE y_true = l.label AND t.label <> l.label) AS fn FROM {t} t CROSS JOIN lab l GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS double) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS double) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS double) END AS f1 FROM x)"""
_DENSE_SCORED = f"{_DIRTY}, {_LABELS}, d AS (SELECT member, id, sent_index, label, list_contains(types, label) AS hit, CASE WHEN list_contains(types, label) THEN label ELSE types[1] END AS y_true FROM dense)" + _PER_LABEL.format(keys="member,", t="d")


@query("member_scores", _DENSE_SCORED + """,
a AS (SELECT member, avg(f1) AS macro_f1 FROM f GROUP BY member),
gr AS (SELECT member, id, bool_and(hit) AS whole, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM d GROUP BY member, id),
b AS (SELECT member, avg(CAST(whole AS int)) AS pem, sum(hits) / CAST(sum(n) AS double) AS acc, count(*) AS num_samples, CAST(sum(n) AS bigint) AS num_sentences FROM gr GROUP BY member)
SELECT member, round((macro_f1 + pem) / 2, 6) AS score, round(macro_f1, 6) AS macro_f1, round(pem, 6) AS pem, round(acc, 6) AS sentence_accuracy, num_samples, num_sentences FROM a JOIN b USING (member)""")
def member_scores(spark, d):
    scored = _dense_scored(spark, d)
    out = score.report(scored, SENTENCES, ("member",))
    return out.select("member", *[_round(c) for c in ("score", "macro_f1", "pem", "sentence_accuracy")], "num_samples", "num_sentences")


@query("label_scores", _DENSE_SCORED + " SELECT member, label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def label_scores(spark, d):
    scored = _dense_scored(spark, d)
    return score.per_label(scored, SENTENCES, ("member",)).select("member", "label", "tp", "fp", "fn", _round("precision"), _round("recall"), _round("f1"))


@query("dense_submissions", _DIRTY + " SELECT member, id, string_agg(label, '|' ORDER BY sent_index) AS labels FROM dense GROUP BY member, id")
def dense_submissions(spark, d):
    return densify.to_submission(_dense(spark, d), ("member",)).select("member", "id", F.array_join("labels", "|").alias("labels"))


@query("placement_rejects", _DIRTY + """, z AS (SELECT id, count(*) AS n FROM sent GROUP BY id)
SELECT raw.member, CASE WHEN z.n IS NULL THEN 'unknown_id' ELSE 'index_out_of_range' END AS reason, count(*) AS n FROM raw LEFT JOIN z ON raw.id = z.id
WHERE z.n IS NULL OR raw.sent_index < 0 OR raw.sent_index >= z.n GROUP BY ALL""")
def placement_rejects(spark, d):
    return densify.rejects(fx.dirty_predictions(spark, d), fx.sizes(spark, d)).groupBy("member", "reason").agg(F.count("*").alias("n"))


@query("uncertainty_bias", _DIRTY + """
SELECT member, CASE WHEN label <> 'Supported' AND (conf IS NULL OR -conf > 0.5) THEN 'Supported' ELSE label END AS label, count(*) AS n FROM dense GROUP BY ALL""")
def uncertainty_bias(spark, d):
    return densify.certain_counts(_dense(spark, d), SENTENCES, 0.5, ("member",))


def _pooled_sql(k: int, where: str = "") -> str:
    return _VOTES.replace("FROM pred WHERE label", f"FROM pred WHERE {where} label") + f""",
b AS (SELECT id, sent_index, sum(n) AS votes, arg_max(label, n * 10 - {_POOLED}) AS label FROM v GROUP BY ALL)
SELECT s.id, s.sent_index, CASE WHEN b.votes >= {k} THEN b.label ELSE 'Supported' END AS label, CAST(coalesce(b.votes, 0) AS bigint) AS votes FROM sent s LEFT JOIN b USING (id, sent_index)"""


@query("pooled_union", _pooled_sql(2))
def pooled_union(spark, d):
    return ensemble.pooled_union(_cells(spark, d), fx.predictions(spark, d), SENTENCES, 2)


@query("self_consistency", _pooled_sql(1, "member <= 3 AND"))
def self_consistency(spark, d):
    """Samples of one model stand for members; any minority vote counts."""
    return ensemble.pooled_union(_cells(spark, d), fx.predictions(spark, d).filter("member <= 3"), SENTENCES, 1)


THRESHOLDS = {"Contradiction": 1, "Unsupported Entity": 3}
_K = "CASE label WHEN 'Contradiction' THEN 1 WHEN 'Unsupported Entity' THEN 3 ELSE 2 END"
_CLASS = f"b AS (SELECT id, sent_index, arg_max(label, n * 10 - {_BY_CLASS}) AS label FROM v WHERE n >= {_K} GROUP BY ALL)"


@query("class_union", f"{_VOTES}, {_CLASS} SELECT s.id, s.sent_index, coalesce(b.label, 'Supported') AS label FROM sent s LEFT JOIN b USING (id, sent_index)")
def class_union(spark, d):
    return ensemble.class_union(_cells(spark, d), fx.predictions(spark, d), SENTENCES, THRESHOLDS, 2)


_OVERLAY = """
SELECT s.id, s.sent_index, CASE WHEN p.label <> 'Supported' THEN p.label ELSE coalesce(b.label, 'Supported') END AS label,
  CASE WHEN p.label <> 'Supported' THEN 'kept' WHEN b.label IS NOT NULL THEN 'added' ELSE 'none' END AS origin
FROM sent s LEFT JOIN b USING (id, sent_index) LEFT JOIN (SELECT * FROM pred WHERE member = 1) p USING (id, sent_index)"""


def _asymmetric(spark, d):
    p = fx.predictions(spark, d)
    return ensemble.asymmetric_union(_cells(spark, d), p.filter("member = 1"), p.filter("member > 1"), SENTENCES, THRESHOLDS, 2)


_ASYM = f"{_VOTES.replace('FROM pred WHERE label', 'FROM pred WHERE member > 1 AND label')}, {_CLASS}"


@query("asymmetric_union", _ASYM + _OVERLAY)
def asymmetric_union(spark, d):
    return _asymmetric(spark, d)


@query("overlay_counts", f"{_ASYM}, o AS ({_OVERLAY}) SELECT label, count(*) FILTER (WHERE origin = 'kept') AS kept, count(*) FILTER (WHERE origin = 'added') AS added FROM o WHERE label <> 'Supported' GROUP BY label")
def overlay_counts(spark, d):
    return ensemble.overlay_counts(_asymmetric(spark, d), SENTENCES)


FLOORS = {"Contradiction": -0.3, "Unsupported Entity": -0.1, "Scope Overgeneralization": -0.5}


@query("confident_union", _PRED + f""",
c AS (SELECT id, sent_index, label, max(coalesce(conf, '-infinity')) AS c FROM pred WHERE member > 1 AND label <> 'Supported'
  AND coalesce(conf, '-infinity') >= CASE label WHEN 'Contradiction' THEN -0.3 WHEN 'Unsupported Entity' THEN -0.1 WHEN 'Scope Overgeneralization' THEN -0.5 ELSE CAST('-infinity' AS double) END GROUP BY ALL),
b AS (SELECT id, sent_index, label FROM (SELECT *, row_number() OVER (PARTITION BY id, sent_index ORDER BY c DESC, {_BY_CLASS}) AS k FROM c) WHERE k = 1)""" + _OVERLAY)
def confident_union(spark, d):
    p = fx.predictions(spark, d)
    return ensemble.confident_union(_cells(spark, d), p.filter("member = 1"), p.filter("member > 1"), SENTENCES, FLOORS)


@query("trimmed", _PRED + """, a AS (SELECT id, sent_index, label, count(*) AS support FROM pred WHERE member > 1 GROUP BY ALL)
SELECT p.id, p.sent_index, CASE WHEN coalesce(support, 0) <= k THEN 'Supported' ELSE p.label END AS label, p.label AS was, coalesce(support, 0) AS support, coalesce(support, 0) <= k AS flipped
FROM (SELECT *, CASE label WHEN 'Unsupported Entity' THEN 1 WHEN 'Contradiction' THEN 2 ELSE -1 END AS k FROM pred WHERE member = 1) p LEFT JOIN a USING (id, sent_index, label)""")
def trimmed(spark, d):
    p = fx.predictions(spark, d)
    return ensemble.trim(p.filter("member = 1"), p.filter("member > 1"), SENTENCES, {"Unsupported Entity": 1, "Contradiction": 2})


@query("lone_vetoed", _PRED + """, l AS (SELECT *, count(*) FILTER (WHERE label <> 'Supported') OVER (PARTITION BY member, id) = 1 AND label <> 'Supported' AS lone FROM pred)
SELECT member, count(*) FILTER (WHERE lone) AS vetoed_all, count(*) FILTER (WHERE lone AND conf < -0.4) AS vetoed_gated FROM l GROUP BY member""")
def lone_vetoed(spark, d):
    p = fx.predictions(spark, d)
    every = ensemble.veto_lone(p, SENTENCES, keys=("member",)).groupBy("member").agg(F.count_if("vetoed").alias("vetoed_all"))
    gated = ensemble.veto_lone(p, SENTENCES, gate=-0.4, keys=("member",)).groupBy("member").agg(F.count_if("vetoed").alias("vetoed_gated"))
    return every.join(gated, "member")


_PCT = _PRED + """, o AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS i, count(*) OVER () AS n FROM pred WHERE label <> 'Supported' AND conf IS NOT NULL),
t AS (SELECT p.percent, o.conf AS tau FROM (SELECT CAST(unnest([25, 50, 75]) AS int) AS percent) p JOIN o ON o.i = round_even(p.percent / 100.0 * (o.n - 1), 0))"""


@query("confidence_percentiles", _PCT + " SELECT percent, tau FROM t")
def confidence_percentiles(spark, d):
    return ensemble.confidence_percentiles(fx.predictions(spark, d), SENTENCES, stored)


@query("threshold_sweep", _PCT + """, w AS (SELECT 'base' AS variant, NULL AS tau UNION ALL SELECT 'p' || percent, tau FROM t)
SELECT variant, CASE WHEN label <> 'Supported' AND conf < tau THEN 'Supported' ELSE label END AS label, count(*) AS n, count(*) FILTER (WHERE label <> 'Supported' AND conf < tau) AS suppressed FROM pred CROSS JOIN w GROUP BY ALL""")
def threshold_sweep(spark, d):
    p = fx.predictions(spark, d)
    taus = stored(ensemble.confidence_percentiles(p, SENTENCES, stored), "taus").select(F.concat(F.lit("p"), "percent").alias("name"), "tau")
    swept = ensemble.threshold_sweep(p, SENTENCES, taus)
    return swept.groupBy("variant", "label").agg(F.count("*").alias("n"), F.count_if("suppressed").alias("suppressed"))


_EMB = """p AS (SELECT vec_id AS id, 0 AS sent_index, label AS regime, i - 1 AS label, exp(embedding[i]) AS a, exp(embedding[i + 10]) AS b FROM embeddings CROSS JOIN range(1, 11) r(i)),
q AS (SELECT id, regime, label, a / sum(a) OVER (PARTITION BY id) AS p, b / sum(b) OVER (PARTITION BY id) AS aux FROM p)"""


def _probabilities(spark, d, shift: int) -> DataFrame:
    e = fx.read(spark, d, "embeddings")
    z = F.transform(F.slice("embedding", 1 + shift, 10), lambda x: F.exp(x.cast("double")))
    total = F.aggregate("z", F.lit(0.0).cast("double"), lambda a, x: a + x)
    rows = e.select(F.col("vec_id").alias("id"), F.lit(0).alias("sent_index"), F.col("label").alias("regime"), z.alias("z")).withColumn("t", total)
    return rows.select("id", "sent_index", "regime", "t", F.posexplode("z").alias("label", "v")).select("id", "sent_index", "regime", "label", (F.col("v") / F.col("t")).alias("p"))


@query("blended_labels", _EMB + """
SELECT id, 0 AS sent_index, CAST(arg_max(label, {'s': p + CASE regime WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END * aux, 'l': label}) AS int) AS label FROM q GROUP BY id""")
def blended_labels(spark, d):
    main, aux = _probabilities(spark, d, 0), _probabilities(spark, d, 10)
    return ensemble.blend(main, aux, {0: 0.5, 1: 2.0}, otherwise=1.0).select("id", "sent_index", F.col("label").cast("int").alias("label"))


@query("anchor_agreement", _PRED + " SELECT p.member, round(avg(CAST(p.label = a.label AS int)), 6) AS agreement, count(*) AS cells FROM pred p JOIN pred a ON a.member = 1 AND p.id = a.id AND p.sent_index = a.sent_index GROUP BY p.member")
def anchor_agreement(spark, d):
    p = fx.predictions(spark, d)
    return ensemble.agreement(p, p.filter("member = 1")).select("member", _round("agreement"), "cells")


@query("label_counts", f"{_PRED}, {_LABELS} SELECT m.member, l.label, count(p.id) AS n FROM lab l CROSS JOIN (SELECT DISTINCT member FROM pred) m LEFT JOIN pred p ON p.member = m.member AND p.label = l.label GROUP BY ALL")
def label_counts(spark, d):
    return score.label_counts(fx.predictions(spark, d), SENTENCES, ("member",))


@query("vote_tally", _PRED + """ SELECT id, sent_index, count(*) FILTER (WHERE label = 'Unsupported Causal Mechanistic') AS v0, count(*) FILTER (WHERE label = 'Unsupported Entity') AS v1,
 count(*) FILTER (WHERE label = 'Scope Overgeneralization') AS v2, count(*) FILTER (WHERE label = 'Contradiction') AS v3 FROM pred GROUP BY ALL""")
def vote_tally(spark, d):
    return ensemble.tally(fx.predictions(spark, d), SENTENCES)


@query("support_histogram", _PRED + """, a AS (SELECT id, sent_index, label, count(*) AS support FROM pred WHERE member > 1 GROUP BY ALL)
SELECT p.label, coalesce(a.support, 0) AS support, count(*) AS n FROM pred p LEFT JOIN a USING (id, sent_index, label) WHERE p.member = 1 GROUP BY ALL""")
def support_histogram(spark, d):
    p = fx.predictions(spark, d)
    return ensemble.support(p.filter("member = 1"), p.filter("member > 1")).groupBy("label", "support").agg(F.count("*").alias("n"))


@query("call_rates", _PRED + " SELECT member, round(avg(CAST(label <> 'Supported' AS int)), 6) AS rate, count(*) AS n FROM pred GROUP BY member")
def call_rates(spark, d):
    return conflict.call_rate(fx.predictions(spark, d), SENTENCES).select("member", _round("rate"), "n")


_CONFLICT = _PRED + """,
c AS (SELECT id, sent_index, count(*) AS votes, count(*) FILTER (WHERE label = 'Supported') AS sup, count(DISTINCT label) AS kinds, list_sort(list_distinct(list(label))) AS ls FROM pred GROUP BY ALL HAVING count(*) >= 5),
top AS (SELECT id, sent_index, max(n) AS top FROM (SELECT id, sent_index, label, count(*) AS n FROM pred GROUP BY ALL) GROUP BY ALL),
cc AS (SELECT c.id, c.sent_index, ls, votes - top AS disagreement, votes - sup AS n_minority,
  CASE WHEN kinds = 1 AND sup > 0 THEN 'unanimous_SUP' WHEN kinds = 1 THEN 'unanimous_minority' WHEN sup > 0 AND kinds = 2 THEN 'SUP_vs_one_minority' WHEN sup > 0 THEN 'SUP_vs_multi_minority' ELSE 'minority_only_disagree' END AS category FROM c JOIN top USING (id, sent_index))"""


def _conflicts(spark, d):
    return conflict.conflicts(fx.predictions(spark, d), SENTENCES)


@query("conflict_categories", _CONFLICT + " SELECT category, disagreement, n_minority, count(*) AS n FROM cc GROUP BY ALL")
def conflict_categories(spark, d):
    return _conflicts(spark, d).groupBy("category", "disagreement", "n_minority").agg(F.count("*").alias("n"))


@query("conflict_pairs", _CONFLICT + " SELECT a, b, count(*) AS n FROM (SELECT x.a, y.b FROM cc, unnest(ls) x(a), unnest(ls) y(b) WHERE x.a < y.b) GROUP BY ALL")
def conflict_pairs(spark, d):
    return conflict.label_pairs(_conflicts(spark, d))


@query("top_cases", _CONFLICT + """,
r AS (SELECT *, CASE category WHEN 'SUP_vs_one_minority' THEN category || ':' || array_to_string(list_filter(ls, lambda x: x <> 'Supported'), ',') ELSE category END AS bucket,
  CASE category WHEN 'SUP_vs_multi_minority' THEN disagreement WHEN 'minority_only_disagree' THEN 0 ELSE n_minority END AS k,
  CASE category WHEN 'SUP_vs_one_minority' THEN 3 WHEN 'SUP_vs_multi_minority' THEN 6 WHEN 'minority_only_disagree' THEN 5 WHEN 'unanimous_minority' THEN 3 ELSE 0 END AS quota FROM cc),
z AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k DESC, id, sent_index) AS rank FROM r)
SELECT id, sent_index, category, bucket, CAST(rank AS int) AS rank FROM z WHERE rank <= quota""")
def top_cases(spark, d):
    return conflict.top_cases(_conflicts(spark, d), SENTENCES).select(*CELL, "category", "bucket", "rank")


@query("minority_histogram", _PRED + " SELECT minority, count(*) AS groups FROM (SELECT id, count(*) FILTER (WHERE label <> 'Supported') AS minority FROM pred WHERE member = 1 GROUP BY id) GROUP BY minority")
def minority_histogram(spark, d):
    return conflict.group_histogram(fx.predictions(spark, d).filter("member = 1"), SENTENCES)


@query("confusion_matrix", f"""{_SCORED}, {_LABELS} SELECT l.label AS gold, count(*) FILTER (WHERE sc.label = 'Supported') AS "Supported", count(*) FILTER (WHERE sc.label = 'Unsupported Causal Mechanistic') AS "Unsupported Causal Mechanistic",
 count(*) FILTER (WHERE sc.label = 'Unsupported Entity') AS "Unsupported Entity", count(*) FILTER (WHERE sc.label = 'Scope Overgeneralization') AS "Scope Overgeneralization", count(*) FILTER (WHERE sc.label = 'Contradiction') AS "Contradiction"
 FROM lab l LEFT JOIN sc ON l.label = CASE WHEN list_contains(types, 'Contradiction') THEN 'Contradiction' WHEN list_contains(types, 'Unsupported Causal Mechanistic') THEN 'Unsupported Causal Mechanistic'
  WHEN list_contains(types, 'Unsupported Entity') THEN 'Unsupported Entity' WHEN list_contains(types, 'Scope Overgeneralization') THEN 'Scope Overgeneralization' ELSE 'Supported' END GROUP BY l.label""")
def confusion_matrix(spark, d):
    return score.confusion(_scored(spark, d), SENTENCES, L.first_by_priority(F.col("types"), SENTENCES.by_class, SENTENCES.default))


@query("diagnostic_scores", f"""{_SCORED}, {_LABELS}, x AS (SELECT l.label, count(*) FILTER (WHERE list_contains(types, l.label) AND sc.label = l.label) AS tp, count(*) FILTER (WHERE NOT list_contains(types, l.label) AND sc.label = l.label) AS fp,
 count(*) FILTER (WHERE list_contains(types, l.label) AND sc.label <> l.label AND NOT hit) AS fn FROM sc CROSS JOIN lab l GROUP BY l.label)
SELECT label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS double) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS double) END, 6) AS recall FROM x""")
def diagnostic_scores(spark, d):
    return score.diagnostic(_scored(spark, d), SENTENCES).select("label", "tp", "fp", "fn", _round("precision"), _round("recall"))


@query("error_kinds", _SCORED + """ SELECT member, CASE WHEN types[1] = 'Supported' THEN 'FALSE_ALARM' WHEN label = 'Supported' THEN 'MISSED_MINORITY' ELSE 'WRONG_MINORITY' END AS kind, count(*) AS n FROM sc WHERE NOT hit GROUP BY ALL""")
def error_kinds(spark, d):
    return score.errors(_scored(spark, d), SENTENCES, ("member",))


@query("recall_by_length", _SCORED + """, z AS (SELECT id, count(*) AS n FROM sent GROUP BY id),
m AS (SELECT CASE WHEN n <= 5 THEN '<=5' WHEN n <= 8 THEN '6-8' ELSE '>=9' END AS bucket, count(*) AS support, count(*) FILTER (WHERE NOT hit) AS misses FROM sc JOIN z USING (id) WHERE types[1] <> 'Supported' GROUP BY ALL)
SELECT bucket, support, misses, round(1 - misses / CAST(support AS double), 6) AS recall, round(misses / CAST(sum(misses) OVER () AS double), 6) AS share FROM m""")
def recall_by_length(spark, d):
    scored = _scored(spark, d).join(fx.sizes(spark, d), "id")
    return score.recall_by(scored, SENTENCES, L.length_bin(F.col("n"))).select("bucket", "support", "misses", _round("recall"), _round("share"))


@query("group_summary", _GROUPS + """ SELECT count(*) AS records, CAST(sum(n) AS bigint) AS sentences, round(avg(n), 6) AS mean_len, quantile_cont(n, 0.5) AS median_len, max(n) AS max_len,
 round(100 * avg(CAST(n >= 8 AS int)), 6) AS pct_len8, round(100 * avg(CAST(minority >= 1 AS int)), 6) AS pct_minority, round(avg(minority), 6) AS mean_minority, round(100 * avg(CAST(minority >= 2 AS int)), 6) AS pct_multi FROM g""")
def group_summary(spark, d):
    out = conflict.summary(_groups(spark, d))
    return out.select("records", "sentences", _round("mean_len"), "median_len", "max_len", *[_round(c) for c in ("pct_len8", "pct_minority", "mean_minority", "pct_multi")])


@query("length_histogram", _GROUPS + """ SELECT bin, count(*) AS groups, round(100.0 * count(*) / (SELECT count(*) FROM g), 6) AS pct FROM (SELECT CASE WHEN n BETWEEN 2 AND 5 THEN '[2-5]' WHEN n BETWEEN 6 AND 7 THEN '[6-7]'
 WHEN n BETWEEN 8 AND 9 THEN '[8-9]' WHEN n BETWEEN 10 AND 13 THEN '[10-13]' WHEN n >= 14 THEN '[14+]' END AS bin FROM g) WHERE bin IS NOT NULL GROUP BY bin""")
def length_histogram(spark, d):
    return conflict.length_histogram(_groups(spark, d), LENGTH_BINS).select("bin", "groups", _round("pct"))


@query("any_of_counts", _SENT + " SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(types)) AS label FROM sent) GROUP BY label")
def any_of_counts(spark, d):
    return conflict.any_of_counts(fx.sentences(spark, d))


@query("primary_counts", _SENT + " SELECT types[1] AS label, count(*) AS n FROM sent GROUP BY ALL")
def primary_counts(spark, d):
    return conflict.primary_counts(fx.sentences(spark, d))


@query("gold_pairs", _SENT + " SELECT a, b, count(*) AS n FROM (SELECT x.a, y.b FROM sent, unnest(types) x(a), unnest(types) y(b) WHERE x.a < y.b) GROUP BY ALL")
def gold_pairs(spark, d):
    return conflict.label_pairs(fx.sentences(spark, d).withColumn("ls", F.array_sort(F.array_distinct("types"))), "ls")


@query("constant_baseline", f"{_SENT}, {_LABELS}, d AS (SELECT id, 'Supported' AS label, types[1] = 'Supported' AS hit, types[1] AS y_true FROM sent)" + _PER_LABEL.format(keys="", t="d") + """
SELECT round(((SELECT avg(f1) FROM f) + pem) / 2, 6) AS score, round((SELECT avg(f1) FROM f), 6) AS macro_f1, round(pem, 6) AS pem, round(acc, 6) AS sentence_accuracy, num_samples, num_sentences
FROM (SELECT avg(CAST(whole AS int)) AS pem, sum(hits) / CAST(sum(n) AS double) AS acc, count(*) AS num_samples, CAST(sum(n) AS bigint) AS num_sentences FROM (SELECT id, bool_and(hit) AS whole, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM d GROUP BY id))""")
def constant_baseline(spark, d):
    out = score.report(score.constant(fx.sentences(spark, d), SENTENCES), SENTENCES)
    return out.select(*[_round(c) for c in ("score", "macro_f1", "pem", "sentence_accuracy")], "num_samples", "num_sentences")


_ORD = "(id * 7919 % 1000003) / CAST(1000003 AS double)"
_DENSEST = """, h AS (SELECT count(*) AS h FROM g WHERE minority >= 1{and_}), e AS (SELECT *, row_number() OVER (ORDER BY n DESC, {o}, id) AS k FROM g WHERE minority = 0{and_}),
w AS (SELECT id, n, minority FROM g WHERE minority >= 1{and_} UNION ALL SELECT id, n, minority FROM e, h WHERE k <= CASE WHEN h.h > 0 AND round_even(h.h * (0.4 / 0.6), 0) = 0 THEN 1 ELSE round_even(h.h * (0.4 / 0.6), 0) END)
SELECT id, n, minority FROM w"""


@query("density_matched", _GROUPS + _DENSEST.format(o=_ORD, and_=""))
def density_matched(spark, d):
    return split.densest(_groups(spark, d), 0.6, _order(), stored).select("id", "n", "minority")


@query("density_reshaped", _GROUPS + _DENSEST.format(o=_ORD, and_=" AND n >= 6"))
def density_reshaped(spark, d):
    return split.densest(_groups(spark, d), 0.6, _order(), stored, least=6).select("id", "n", "minority")


@query("rank_correlation", _SCORED + """, a AS (SELECT member, id, count(*) AS x, count(*) FILTER (WHERE hit) AS y FROM sc GROUP BY ALL),
r AS (SELECT member, rank() OVER (PARTITION BY member ORDER BY x) + (count(*) OVER (PARTITION BY member, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY member ORDER BY y) + (count(*) OVER (PARTITION BY member, y) - 1) / 2.0 AS ry FROM a),
c AS (SELECT member, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY member)
SELECT member, n, round(rho, 6) AS rho, CASE WHEN rho >= 0.8 THEN 'trustworthy' WHEN rho >= 0.6 THEN 'coarse' WHEN rho >= 0.5 THEN 'weak' ELSE 'abandon' END AS decision FROM c""")
def rank_correlation(spark, d):
    """Whether a group's length ranks as its hits do, for each member."""
    p = fx.predictions(spark, d).withColumn("seq", F.lit(0))
    scored = score.credited_members(fx.sentences(spark, d), p, SENTENCES, list(range(1, MEMBERS + 1)), missing=False)
    by = scored.groupBy("member", "id").agg(F.count("*").alias("x"), F.count_if("hit").alias("y"))
    return rank.gate(rank.spearman(by, "x", "y", ("member",))).select("member", "n", _round("rho"), "decision")


@query("member_ranking", _DENSE_SCORED + ", a AS (SELECT member, avg(f1) AS m FROM f GROUP BY member) SELECT member, round(m, 6) AS macro_f1, CAST(row_number() OVER (ORDER BY m DESC, member) AS int) AS place FROM a")
def member_ranking(spark, d):
    scored = _dense_scored(spark, d)
    return rank.ordered(score.macro_f1(scored, SENTENCES, ("member",)), "macro_f1").select("member", _round("macro_f1"), "place")


@query("soft_bottleneck", _PRED + ", p AS (SELECT id, -conf AS l FROM pred WHERE member = 1 AND conf IS NOT NULL), m AS (SELECT id, max(l) AS m FROM p GROUP BY id) SELECT id, round(any_value(m) + ln(avg(exp(5 * (l - m)))) / 5, 6) AS s FROM p JOIN m USING (id) GROUP BY id")
def soft_bottleneck(spark, d):
    p = fx.predictions(spark, d).filter("member = 1 and conf is not null").select("id", (-F.col("conf")).alias("l"))
    return score.soft_bottleneck(p, "l", ["id"], 5.0).select("id", _round("s"))


@query("rarest_targets", _SENT + """, f AS (SELECT types[1] AS label, count(*) AS n FROM sent GROUP BY ALL)
SELECT id, sent_index, arg_min(t, coalesce(n, 0) * 100 + i) AS target FROM (SELECT id, sent_index, unnest(types) AS t, unnest(range(len(types))) AS i FROM sent) LEFT JOIN f ON f.label = t GROUP BY ALL""")
def rarest_targets(spark, d):
    s = fx.sentences(spark, d)
    freq = conflict.primary_counts(s).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("freq"))  # a row, as wide as there are labels
    return s.crossJoin(F.broadcast(freq)).select(*CELL, L.rarest_label(F.col("types"), F.col("freq"), SENTENCES.default).alias("target"))


@query("multi_targets", _SENT + " SELECT target, count(*) AS n, CAST(sum(i) AS bigint) AS places FROM (SELECT unnest(types) AS target, unnest(range(len(types))) AS i FROM sent) GROUP BY target")
def multi_targets(spark, d):
    from loomkit.sources.records import per_target

    return per_target(fx.sentences(spark, d), F.lit(SENTENCES.default)).groupBy("target").agg(F.count("*").alias("n"), F.sum("target_index").alias("places"))


@query("text_marks", r"""a AS (SELECT doc_id, regexp_replace(text, '[À-ɏ]', '_', 'g') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '\b[A-Z][A-Za-z0-9\-]{2,}\b') AS nouns, regexp_matches(t, '(?i)\b(?:Table|Figure|Fig|Tab)\.?\s*\d') AS figure FROM a)
SELECT doc_id, len(list_distinct(nouns)) AS nouns, figure FROM d""")
def text_marks(spark, d):
    docs = fx.read(spark, d, "documents")
    return docs.select("doc_id", F.size(L.proper_nouns(F.col("text"))).cast("long").alias("nouns"), L.refers_to_figure(F.col("text")).alias("figure"))


_OCC = " + ".join
_DOMAIN_SQL = "l AS (SELECT doc_id, lang, lower(text) AS t FROM documents), c AS (SELECT doc_id, lang, " + ", ".join(
    _OCC(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + f" AS {name}" for name, words in DOMAINS.items()
) + " FROM l), g AS (SELECT lang, CASE WHEN greatest(law, care, trade) = 0 THEN 'other' WHEN law >= care AND law >= trade THEN 'law' WHEN care >= trade THEN 'care' ELSE 'trade' END AS domain FROM c)"


@query("domain_shares", _DOMAIN_SQL + " SELECT lang, domain, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS double), 6) AS share FROM g GROUP BY lang, domain")
def domain_shares(spark, d):
    docs = fx.read(spark, d, "documents").select("lang", L.domain(F.col("text"), DOMAINS).alias("domain"))
    return conflict.domain_share(docs, "lang", "domain").select("lang", "domain", "n", _round("share"))


@query("path_stems", r"p AS (SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS x FROM pages) SELECT page_id, nullif(x, '') AS stem FROM p")
def path_stems(spark, d):
    return fx.read(spark, d, "pages").select("page_id", L.stem(F.col("url")).alias("stem"))


@query("parsed_labels", _PRED + """ SELECT member, id, sent_index, CASE WHEN id % 7 IN (4, 5) THEN 'Supported' ELSE label END AS parsed, id % 7 NOT IN (4, 5) AS parsed_ok FROM pred""")
def parsed_labels(spark, d):
    raw = fx.raw_outputs(spark, d).withColumn("_p", N.single_label(F.col("raw"), SENTENCES))
    return raw.select("member", *CELL, F.col("_p.label").alias("parsed"), F.col("_p.parsed_ok").alias("parsed_ok"))


@query("parse_quality", _PRED + " SELECT member, count(*) AS n, count(*) FILTER (WHERE id % 7 IN (4, 5)) AS fallbacks, count(*) FILTER (WHERE id % 7 NOT IN (4, 5) AND label <> 'Supported') AS minority FROM pred GROUP BY member")
def parse_quality(spark, d):
    p = parsed_labels(spark, d)
    return p.groupBy("member").agg(F.count("*").alias("n"), F.count_if(~F.col("parsed_ok")).alias("fallbacks"), F.count_if(F.col("parsed") != SENTENCES.default).alias("minority"))


@query("rewards", _PRED + """, r AS (SELECT p.member, p.id, p.sent_index, CASE WHEN id % 7 IN (0, 1, 6) THEN label END AS l, s.types FROM pred p JOIN sent s USING (id, sent_index))
SELECT member, reward, count(*) AS n FROM (SELECT member, CASE WHEN l IS NULL THEN -1.0 WHEN NOT list_contains(types, l) THEN 0.0 ELSE CASE l WHEN 'Supported' THEN 1.0 WHEN 'Unsupported Causal Mechanistic' THEN 5.0 WHEN 'Contradiction' THEN 4.5 WHEN 'Unsupported Entity' THEN 4.0 ELSE 3.5 END END AS reward FROM r) GROUP BY ALL""")
def rewards(spark, d):
    raw = fx.raw_outputs(spark, d).join(fx.sentences(spark, d).select(*CELL, "types"), CELL)
    return raw.select("member", N.reward(F.col("raw"), F.col("types"), SENTENCES).alias("reward")).groupBy("member", "reward").agg(F.count("*").alias("n"))


_ECOMP = _LINKS + """, m AS (SELECT key, min(id) AS a FROM k GROUP BY key), e AS (SELECT DISTINCT m.a, k.id AS b FROM k JOIN m USING (key) WHERE k.id <> m.a),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), """
_COMP = "RECURSIVE " + _ECOMP + """w AS (SELECT DISTINCT id AS node, id AS seen FROM k UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen),
c AS (SELECT node AS id, min(seen) AS component FROM w GROUP BY node)"""


def _members(spark, d) -> DataFrame:
    links = stored(fx.links(spark, d), "links")
    edges = split.shared_key_edges(links)
    found = components.connected_components(edges)
    return links.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("shared_line_components", _COMP + " SELECT id, component FROM c")
def shared_line_components(spark, d):
    return _members(spark, d)


@query("leak_safe_split", _COMP + """, z AS (SELECT component, count(*) AS size FROM c GROUP BY component),
b AS (SELECT component, coalesce(sum(size) OVER (ORDER BY component * 7919 % 1000003, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM z)
SELECT c.id, CASE WHEN before < round_even(total * 0.2, 0) THEN 'dev' ELSE 'train' END AS split FROM c JOIN b USING (component)""")
def leak_safe_split(spark, d):
    return split.component_split(_members(spark, d), _order("component"), 0.2, stored)


@query("leaked_keys", _LINKS + """, s AS (SELECT DISTINCT id, CASE WHEN id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM k)
SELECT md5(key) AS key, count(*) AS groups FROM k JOIN s USING (id) GROUP BY k.key HAVING count(DISTINCT split) > 1""")
def leaked_keys(spark, d):
    links = fx.links(spark, d)
    splits = links.select("id", F.when(F.col("id") % 5 == 0, "dev").otherwise("train").alias("split")).distinct()
    return split.leaks(links, splits).select(F.md5("key").alias("key"), "groups")


@query("stratified_split", _GROUPS + f""", r AS (SELECT id, minority > 0 AS hard, row_number() OVER (PARTITION BY minority > 0 ORDER BY {_ORD}, id) AS k, count(*) OVER (PARTITION BY minority > 0) AS n FROM g)
SELECT id, CASE WHEN k <= greatest(round_even(n * 0.1, 0), 1) THEN 'dev' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return split.stratified_split(_groups(spark, d).select("id", (F.col("minority") > 0).alias("hard")), _order(), 0.1, stored)


@query("default_downsampled", _GROUPS + f" SELECT id FROM g WHERE minority > 0 OR {_ORD} < 0.3")
def default_downsampled(spark, d):
    return split.downsample_default(_groups(spark, d).withColumn("hard", F.col("minority") > 0), 0.3, _order()).select("id")


_RATE = "CASE types[1] WHEN 'Contradiction' THEN 3.0 ELSE 2.5 END"


@query("oversampled", _SENT + f""", c AS (SELECT id, sent_index, types[1] AS label, CASE WHEN types[1] = 'Supported' THEN 0 ELSE floor({_RATE} - 1) + CAST(((id * 31 + sent_index) * 7919 % 1000003) / CAST(1000003 AS double) < {_RATE} - 1 - floor({_RATE} - 1) AS int) END AS k FROM sent),
e AS (SELECT id, sent_index, label, CAST(unnest(range(CAST(k AS int) + 1)) AS int) AS copy FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY id, copy > 0 ORDER BY sent_index, copy) - 1 AS j FROM e)
SELECT CASE WHEN copy = 0 THEN CAST(id AS varchar) ELSE id || '#aug' || j END AS channel, sent_index, label, copy FROM n""")
def oversampled(spark, d):
    s = fx.sentences(spark, d).select(F.col("id").alias("channel"), "id", "sent_index", F.get("types", F.lit(0)).alias("label"))
    chance = F.pmod((F.col("id") * 31 + F.col("sent_index")) * 7919, F.lit(1000003)) / F.lit(1000003.0).cast("double")
    return resample.oversample(s, SENTENCES, 2.5, chance, {"Contradiction": 3.0}).select("channel", "sent_index", "label", "copy")


@query("groups_oversampled", _GROUPS + f""", c AS (SELECT id, CASE WHEN minority > 0 THEN 1 + CAST({_ORD} < 0.5 AS int) ELSE 0 END AS k FROM g), e AS (SELECT id, unnest(range(k + 1)) AS copy FROM c)
SELECT id, CASE WHEN copy = 0 THEN CAST(id AS varchar) ELSE id || '#dup' || (copy - 1) END AS channel FROM e""")
def groups_oversampled(spark, d):
    return resample.oversample_groups(_groups(spark, d).withColumn("hard", F.col("minority") > 0), 2.5, _order()).select("id", "channel")


@query("worker_shards", _GROUPS + f", r AS (SELECT id, row_number() OVER (ORDER BY {_ORD}, id) - 1 AS k, count(*) OVER () AS n FROM g) SELECT id, CAST(k % 7 AS int) AS rank FROM r WHERE k < 7 * (n // 7)")
def worker_shards(spark, d):
    return resample.shards(_groups(spark, d), _order(), 7, stored)


@query("id_holdout", _GROUPS + f", r AS (SELECT id, row_number() OVER (ORDER BY {_ORD}, id) - 1 AS k, count(*) OVER () AS n FROM g) SELECT id, CASE WHEN k < floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM r")
def id_holdout(spark, d):
    return split.holdout(_groups(spark, d).select("id"), _order(), 0.15, stored)


@query("audit_sample", _SENT + f""", u AS (SELECT id * 100 + sent_index AS id, types[1] AS target_label FROM sent), r AS (SELECT *, row_number() OVER (PARTITION BY target_label = 'Supported' ORDER BY {_ORD}, id) AS k, count(*) OVER (PARTITION BY target_label = 'Supported') AS n FROM u)
SELECT id, target_label FROM r WHERE target_label <> 'Supported' OR k <= greatest(round_even(n * 0.05, 0), 1)""")
def audit_sample(spark, d):
    units = fx.sentences(spark, d).select((F.col("id") * 100 + F.col("sent_index")).alias("id"), F.get("types", F.lit(0)).alias("target_label"))
    return split.audit_selection(units, SENTENCES.default, _order(), 0.05, stored)


_LOG = "l AS (SELECT user_id AS task, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'api_error' WHEN 'view' THEN 'misaligned' WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'cannot_justify' ELSE 'gave_up' END AS status FROM events)"
TERMINAL = ["ok", "cannot_justify", "gave_up"]


@query("open_tasks", _LOG + " SELECT DISTINCT task FROM l WHERE task NOT IN (SELECT task FROM l WHERE status IN ('ok', 'cannot_justify', 'gave_up'))")
def open_tasks(spark, d):
    log = fx.attempts(spark, d)
    return curate.todo(log.select("task").distinct(), log, ["task"], TERMINAL)


@query("attempt_throughput", _LOG + ", t AS (SELECT status, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS s FROM l GROUP BY status) SELECT status, n, round(CASE WHEN n >= 2 AND s > 0 THEN n / (s / 60.0) END, 6) AS per_minute FROM t")
def attempt_throughput(spark, d):
    log = fx.attempts(spark, d).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6).cast("double"))
    return curate.throughput(log, "ts", ("status",)).select("status", "n", _round("per_minute"))


@query("last_statuses", _LOG + " SELECT task, arg_max(status, seq) AS status FROM l WHERE status IN ('ok', 'cannot_justify', 'gave_up') GROUP BY task")
def last_statuses(spark, d):
    return curate.last_terminal(fx.attempts(spark, d), ["task"], TERMINAL, "seq")


@query("status_mix", _LOG + " SELECT status, count(*) AS n FROM l GROUP BY status")
def status_mix(spark, d):
    return curate.status_counts(fx.attempts(spark, d))


@query("submission_problems", _PRED + """, sub AS (SELECT id, list(CASE WHEN id % 211 = 0 THEN 'odd' ELSE label END ORDER BY sent_index) AS labels FROM pred WHERE member = 1 AND id % 97 <> 5 GROUP BY id UNION ALL SELECT -1, ['Supported']),
z AS (SELECT id, count(*) AS n FROM sent GROUP BY id)
SELECT 'invalid_label' AS rule, CAST(id AS varchar) AS id, CAST(len(list_filter(labels, lambda x: x = 'odd')) AS varchar) AS detail FROM sub WHERE list_contains(labels, 'odd')
UNION ALL SELECT 'unknown_id', CAST(id AS varchar), NULL FROM sub WHERE id NOT IN (SELECT id FROM z)
UNION ALL SELECT 'wrong_length', CAST(id AS varchar), CAST(len(labels) AS varchar) FROM sub JOIN z USING (id) WHERE len(labels) <> n
UNION ALL SELECT 'missing_record', CAST(id AS varchar), NULL FROM z WHERE id NOT IN (SELECT id FROM sub)
UNION ALL SELECT 'record_count', NULL, a || ' != ' || b FROM (SELECT (SELECT count(*) FROM sub) AS a, (SELECT count(*) FROM z) AS b) WHERE a <> b""")
def submission_problems(spark, d):
    p = fx.predictions(spark, d).filter("member = 1 and id % 97 <> 5").withColumn("label", F.when(F.col("id") % 211 == 0, "odd").otherwise(F.col("label")))
    sub = densify.to_submission(p)
    extra = sub.limit(0).unionByName(spark.range(1).select(F.lit(-1).cast(sub.schema["id"].dataType).alias("id"), F.array(F.lit("Supported")).alias("labels")))
    return quality.submission_problems(sub.unionByName(extra), fx.sizes(spark, d), SENTENCES)


@query("conversation_corpus", "c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role <> 'assistant') AS kept, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id) SELECT conv_id, n, kept, digest FROM c")
def conversation_corpus(spark, d):
    c = render.conversations(fx.read(spark, d, "conversations"))
    rest = F.size(F.filter("messages", lambda m: m["role"] != "assistant"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return c.select("conv_id", F.size("messages").cast("long").alias("n"), rest.cast("long").alias("kept"), F.md5(text).alias("digest"))


@query("rendered_sentences", _SENT + r""" SELECT id, sent_index, md5('Labels and their meaning.' || chr(10) || chr(10) || 'Evidence:' || chr(10) || '[TABLE 1] <image>' || chr(10) || 'Caption: part ' || l_partkey || chr(10) || chr(10) || 'Claim paragraph:' || chr(10) || 'order ' || id || chr(10) || chr(10) || 'TARGET sentence to classify:' || chr(10) || 'line ' || sent_index) AS user,
 '{"label": "' || types[1] || '"}' AS answer FROM sent""")
def rendered_sentences(spark, d):
    s = fx.sentences(spark, d)
    item = F.struct(F.lit("table").alias("type"), F.concat(F.lit("images/"), "l_suppkey", F.lit(".jpg")).alias("img_path"), F.lit("[]").alias("image_caption"), F.to_json(F.array(F.concat(F.lit("part "), "l_partkey"))).alias("table_caption"))
    rows = s.select(F.col("id").alias("channel"), "sent_index", F.concat(F.lit("order "), "id").alias("claim_text"), F.concat(F.lit("line "), "sent_index").alias("sentence"), F.get("types", F.lit(0)).alias("label"), F.array(item).alias("evidence"))
    out = render.sentence_corpus(rows, render.Template())
    return out.select(F.col("channel").alias("id"), "sent_index", F.md5(F.col("messages")[1]["content"]).alias("user"), F.col("messages")[2]["content"].alias("answer"))


@query("injection_pools", _SENT + """, f AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE types[1] <> 'Supported') AS m, count(*) FILTER (WHERE types[1] IN ('Contradiction', 'Unsupported Causal Mechanistic') AND len(types) = 1) AS k FROM sent GROUP BY id)
SELECT 'anchor' AS pool, count(*) AS n FROM f WHERE n >= 5 AND m = 1 AND k = 1 UNION ALL SELECT 'donor', count(*) FROM sent WHERE len(types) = 1 AND types[1] IN ('Contradiction', 'Unsupported Causal Mechanistic')""")
def injection_pools(spark, d):
    s = fx.sentences(spark, d).withColumn("sentence", F.concat(F.lit("line "), "sent_index"))
    classes = ["Contradiction", "Unsupported Causal Mechanistic"]
    a = synthesize.anchors(s, SENTENCES, classes, 5).agg(F.count("*").alias("n")).select(F.lit("anchor").alias("pool"), "n")
    return a.unionByName(synthesize.donors(s, classes).agg(F.count("*").alias("n")).select(F.lit("donor").alias("pool"), "n"))


def _documents_with_marks(spark, d) -> DataFrame:
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text")
    return docs.select("id", "domain", L.proper_nouns(F.col("text")).alias("nouns"))


@query("donor_matches")
def donor_matches(spark, d):
    """Odd documents as donors, even ones as anchors: one-to-one, of other language, without a common noun in their whole texts (FIXTURES.md has the first line only)."""
    docs = _documents_with_marks(spark, d)
    return synthesize.match(docs.filter("id % 2 = 1").withColumn("donor_id", F.col("id")), docs.filter("id % 2 = 0"), stored)


def packable(spark, d) -> DataFrame:
    """(id, n, minority, stems): orders with their lines, minority lines and suppliers, all of them, which stand for figures."""
    s = fx.sentences(spark, d)
    return s.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.get("types", F.lit(0)) != SENTENCES.default).cast("int").alias("minority"), F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("stems"))


@query("packed_groups")
def packed_groups(spark, d):
    """Orders with minority lines packed together until no two fit."""
    return synthesize.pack_all(packable(spark, d), stored)


@query("quality_scores", "d AS (SELECT toxic AS gold, quality AS said FROM labels), lab AS (SELECT unnest([0, 1]) AS label), x AS (SELECT l.label, count(*) FILTER (WHERE gold = l.label AND said = l.label) AS tp, count(*) FILTER (WHERE gold <> l.label AND said = l.label) AS fp, count(*) FILTER (WHERE gold = l.label AND said <> l.label) AS fn FROM d CROSS JOIN lab l GROUP BY l.label) SELECT CAST(label AS varchar) AS label, tp, fp, fn FROM x")
def quality_scores(spark, d):
    """Another label set: quality as a prediction of toxicity."""
    two = LabelSet(("0", "1"), "0", ("1",), ("1",))
    rows = fx.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(0).alias("sent_index"), F.array(F.col("toxic").cast("string")).alias("types"), F.col("quality").cast("string").alias("label"))
    return score.per_label(score.credited(rows.drop("label"), rows.drop("types"), two), two).select("label", "tp", "fp", "fn")


_JOINT = _PRED + """, j AS (SELECT member, id, list(label ORDER BY sent_index) AS ls, count(*) AS n FROM pred GROUP BY member, id)"""


def _joint(spark, d) -> DataFrame:
    by = densify.to_submission(fx.predictions(spark, d), ("member",))
    quoted = F.transform("labels", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    shape = F.col("id") % 4
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"labels": ['), F.array_join(quoted, ", "), F.lit("]}"))).when(shape == 1, F.concat(F.lit("I say "), F.array_join(quoted, " then ")))
        .when(shape == 2, F.concat(F.lit("so\nFINAL: "), F.array_join("labels", " ||| "), F.lit("\nend"))).otherwise("no answer")
    )
    return by.select("member", "id", "labels", F.size("labels").alias("n"), raw.alias("raw"))


@query("joint_labels", _JOINT + " SELECT member, id, CASE WHEN id % 4 < 2 THEN array_to_string(ls, '|') ELSE array_to_string(list_transform(ls, lambda x: 'Supported'), '|') END AS labels, id % 4 < 2 AS parsed_ok FROM j")
def joint_labels(spark, d):
    out = _joint(spark, d).withColumn("_p", N.label_list(F.col("raw"), F.col("n"), SENTENCES))
    return out.select("member", "id", F.array_join("_p.labels", "|").alias("labels"), F.col("_p.parsed_ok").alias("parsed_ok"))


@query("final_line_labels", _JOINT + " SELECT member, id, CASE WHEN id % 4 < 3 AND NOT (id % 4 = 2 AND n = 1) THEN array_to_string(ls, '|') WHEN id % 4 = 2 THEN ls[1] ELSE array_to_string(list_transform(ls, lambda x: 'Supported'), '|') END AS labels FROM j")
def final_line_labels(spark, d):
    return _joint(spark, d).select("member", "id", F.array_join(N.final_line(F.col("raw"), F.col("n"), SENTENCES), "|").alias("labels"))


@query("token_confidences", _PRED + " SELECT member, id, sent_index, -2.0 AS first, least(-0.25, conf) AS least, round(-0.25 + coalesce(conf, 0), 6) AS sum, CAST(CASE WHEN conf IS NULL THEN 2 ELSE 3 END AS int) AS n FROM pred")
def token_confidences(spark, d):
    token = lambda t, p: F.struct(F.lit(t).alias("token"), p.cast("double").alias("logprob"))
    rows = fx.predictions(spark, d).withColumn("c", N.confidences(F.array(token("why", F.lit(-2.0)), token('{"', F.lit(-0.25)), token("x", F.col("conf")))))
    return rows.select("member", *CELL, F.col("c.first").alias("first"), F.col("c.least").alias("least"), _round("c.sum", "sum"), F.col("c.n").alias("n"))


@query("enriched_captions", """e AS (SELECT DISTINCT l_orderkey AS id, l_suppkey FROM lineitem), c AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0),
x AS (SELECT id, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'image' ELSE 'table' END AS kind, s_suppkey IS NOT NULL AS hit FROM e LEFT JOIN c ON s_suppkey = l_suppkey)
SELECT id, count(*) FILTER (WHERE hit) AS changed, md5(string_agg(kind || ':' || 's' || l_suppkey || CASE WHEN hit THEN ' [OCR] seen ' || l_suppkey ELSE '' END, ';' ORDER BY l_suppkey)) AS digest FROM x GROUP BY id""")
def enriched_captions(spark, d):
    """Suppliers of an order as its evidence; every third supplier has a cached text."""
    lines = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").distinct()
    own = F.array(F.concat(F.lit("s"), "l_suppkey"))
    image = F.col("l_suppkey") % 2 == 0
    item = F.struct(F.when(image, "image").otherwise("table").alias("type"), F.concat(F.lit("i/"), "l_suppkey").alias("img_path"), F.when(image, own).alias("image_caption"), F.when(~image, own).alias("table_caption"))
    records = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", item.alias("e")))), lambda x: x["e"]).alias("evidence"))
    cache = fx.read(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("i/"), "s_suppkey").alias("img_path"), F.concat(F.lit("seen "), "s_suppkey").alias("text"))
    out = render.enrich_captions(records, cache)
    text = F.array_join(F.transform("evidence", lambda e: F.concat(e["type"], F.lit(":"), F.array_join(F.coalesce(e["image_caption"], e["table_caption"]), " "))), ";")
    return out.select("id", "changed", F.md5(text).alias("digest"))


_UNITS = _PRED + """, u AS (SELECT CAST(id AS varchar) AS record_id, sent_index AS sent_idx, label AS target_label, 'reason ' || id AS rationale, CAST(id AS varchar) || '-' || sent_index AS unit_key FROM pred WHERE member = 1 AND label <> 'Supported'),
m AS (SELECT u.*, CASE sent_idx % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'rewritten' WHEN 2 THEN 'dropped' ELSE 'unverified' END AS outcome FROM u)"""


def _merged(spark, d) -> DataFrame:
    p = fx.predictions(spark, d).filter((F.col("member") == 1) & (F.col("label") != SENTENCES.default))
    units = p.select(F.col("id").cast("string").alias("record_id"), F.col("sent_index").alias("sent_idx"), F.col("label").alias("target_label"), F.concat(F.lit("reason "), "id").alias("rationale"), F.concat_ws("-", F.col("id").cast("string"), F.col("sent_index").cast("string")).alias("unit_key"))
    k = F.col("sent_idx") % 4
    last = units.filter(k < 3).select("unit_key", F.lit(2).alias("seq"), F.lit("final").alias("phase"), F.when(k == 0, "pass").when(k == 1, "rewritten").otherwise("dropped").alias("outcome"), F.lit("bad").alias("note"), F.lit("new text").alias("new_rationale"))
    early = units.filter(k < 3).select("unit_key", F.lit(1).alias("seq"), F.lit("final").alias("phase"), F.lit("dropped").alias("outcome"), F.lit("old").alias("note"), F.lit(None).cast("string").alias("new_rationale"))
    return curate.merge_audit(units, last.unionByName(early))


@query("merged_units", _UNITS + " SELECT record_id, sent_idx, outcome, CASE outcome WHEN 'rewritten' THEN 'new text' ELSE rationale END AS rationale, outcome IN ('pass', 'rewritten') AS verified FROM m")
def merged_units(spark, d):
    return _merged(spark, d).select("record_id", "sent_idx", "outcome", "rationale", "verified")


@query("label_only_residue", _UNITS + """ SELECT CAST(s.id AS varchar) AS record_id, s.sent_index AS sent_idx, CASE WHEN m.outcome = 'dropped' THEN 'bad' ELSE 'no_unit' END AS reason FROM sent s LEFT JOIN m ON m.record_id = CAST(s.id AS varchar) AND m.sent_idx = s.sent_index
WHERE s.types[1] <> 'Supported' AND (m.outcome IS NULL OR m.outcome = 'dropped')""")
def label_only_residue(spark, d):
    s = fx.sentences(spark, d).filter(F.get("types", F.lit(0)) != SENTENCES.default).select(F.col("id").cast("string").alias("record_id"), F.col("sent_index").alias("sent_idx"))
    log = spark.createDataFrame([], "record_id string, sent_idx int, status string")
    return curate.label_only(s, _merged(spark, d), log).select("record_id", "sent_idx", "reason")


@query("unit_coverage", _UNITS + """, gold AS (SELECT CAST(id AS varchar) AS record_id, sent_index AS sent_idx, types[1] AS target_label FROM sent WHERE types[1] <> 'Supported')
SELECT gold.target_label, count(*) AS sentences, count(m.outcome) AS covered FROM gold LEFT JOIN (SELECT * FROM m WHERE outcome <> 'dropped') m USING (record_id, sent_idx) GROUP BY gold.target_label""")
def unit_coverage(spark, d):
    s = fx.sentences(spark, d).filter(F.get("types", F.lit(0)) != SENTENCES.default).select(F.col("id").cast("string").alias("record_id"), F.col("sent_index").alias("sent_idx"), F.get("types", F.lit(0)).alias("target_label"))
    return curate.coverage(_merged(spark, d).filter("outcome <> 'dropped'"), s).select("target_label", "sentences", "covered")


@query("rolling_mix", "l AS (SELECT date_trunc('hour', ts) AS start, CAST(user_id % 3 AS int) AS member, event_type FROM events) SELECT CAST(epoch(start) AS bigint) AS start, member, count(*) AS n, count(*) FILTER (WHERE event_type <> 'view') AS minority FROM l GROUP BY ALL")
def rolling_mix(spark, d):
    """The windows that the streaming job keeps, over the whole table."""
    from loomkit.streaming.attempts import rolling_mix as mix

    kinds = LabelSet(("view", "click", "purchase", "signup", "error"), "view", ("click",), ("click",))
    e = fx.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).cast("int").alias("member"), F.col("event_type").alias("label"))
    return mix(e, kinds).select(F.unix_timestamp("start").alias("start"), "member", "n", "minority")


@query("split_summary", _SENT + """, r AS (SELECT CASE WHEN id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, id, types[1] AS label FROM sent)
SELECT split, label, count(DISTINCT id) AS groups, count(*) AS sentences, count(DISTINCT CASE WHEN label <> 'Supported' THEN id END) AS hard FROM r GROUP BY GROUPING SETS ((split), (split, label))""")
def split_summary(spark, d):
    s = fx.sentences(spark, d)
    splits = fx.sizes(spark, d).select("id", F.when(F.col("id") % 10 == 0, "dev").otherwise("train").alias("split"))
    return split.split_summary(s, splits, SENTENCES.default)


@query("hard_subset", _PRED + """, g AS (SELECT id FROM sent GROUP BY id HAVING count(*) >= 6 AND count(*) FILTER (WHERE types[1] <> 'Supported') > 0)
SELECT p.member, count(*) AS cells, count(DISTINCT p.id) AS groups FROM pred p WHERE p.id IN (SELECT id FROM g) GROUP BY p.member""")
def hard_subset(spark, d):
    _, p = split.hard_subset(fx.sentences(spark, d), fx.predictions(spark, d), SENTENCES.default, 6)
    return p.groupBy("member").agg(F.count("*").alias("cells"), F.count_distinct("id").alias("groups"))


_INJECTED = _SENT + """, f AS (SELECT id, count(*) AS n, min(l_suppkey) AS supplier, list('line ' || id || '-' || sent_index ORDER BY sent_index) AS ls, count(*) FILTER (WHERE types[1] <> 'Supported') AS m,
  count(*) FILTER (WHERE types[1] IN ('Contradiction', 'Unsupported Causal Mechanistic') AND len(types) = 1) AS k FROM sent GROUP BY id),
p AS (SELECT l_suppkey AS supplier, min({'i': id, 's': sent_index}) AS d FROM sent WHERE len(types) = 1 AND types[1] IN ('Contradiction', 'Unsupported Causal Mechanistic') GROUP BY l_suppkey),
j AS (SELECT f.id, d.i AS di, d.s AS ds, ls, n, greatest(1, least(f.id % 9, n)) AS p FROM f JOIN p USING (supplier) WHERE f.n >= 5 AND f.m = 1 AND f.k = 1 AND d.i <> f.id)"""


@query("injected_groups", _INJECTED + " SELECT id AS anchor_id, di || '-' || ds AS donor_id, array_to_string(list_concat(list_concat(ls[1:p], ['line ' || di || '-' || ds]), ls[p + 1:n]), ' ') AS claim_text, n + 1 AS sentences FROM j")
def injected_groups(spark, d):
    """Every anchor takes the first donor sentence of its smallest supplier, unless that is its own."""
    classes = ["Contradiction", "Unsupported Causal Mechanistic"]
    s = fx.sentences(spark, d).withColumn("sentence", F.concat(F.lit("line "), "id", F.lit("-"), "sent_index"))
    evidence = F.array(F.struct(F.concat(F.lit("i/"), "id").alias("img_path"))).alias("evidence")
    pool = synthesize.donors(s, classes).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.min(F.struct("id", "sent_index", "sentence", F.get("types", F.lit(0)).alias("label"))).alias("d"))
    donors = pool.select("supplier", F.col("d.id").alias("id"), F.concat_ws("-", F.col("d.id").cast("string"), F.col("d.sent_index").cast("string")).alias("donor_id"), "d.sentence", "d.label").select("*", evidence)
    ordered = F.array_sort(F.collect_list(F.struct("sent_index", F.struct("sentence", "types").alias("s"))))
    groups = s.join(synthesize.anchors(s, SENTENCES, classes, 5), "id", "left_semi").groupBy("id").agg(F.min("l_suppkey").alias("supplier"), F.transform(ordered, lambda x: x["s"]).alias("sentences")).select("*", evidence)
    pairs = groups.select(F.col("id").alias("anchor_id"), "supplier").join(donors.select("supplier", "donor_id", "id"), "supplier").filter("id <> anchor_id").select("anchor_id", "donor_id")
    out = synthesize.inject(groups.drop("supplier"), donors.drop("supplier", "id"), pairs, F.col("anchor_id") % 9)
    return out.select("anchor_id", "donor_id", "claim_text", F.size("sentences").cast("long").alias("sentences"))
