"""A stream gives what a batch gives after all input is read."""

import dataclasses
from datetime import datetime

from loomkit.config import SENTENCES
from loomkit.operators.densify import keep_one
from loomkit.streaming import attempts
from pyspark.sql import functions as F

SCHEMA = "member int, id long, sent_index int, seq long, raw string"


def test_ingest_equals_batch(spark, tmp_path):
    rows = [(m, i, s, 10 * k + m, '{"label": "%s"}' % SENTENCES.labels[(i + s + k) % 5]) for k in range(2) for m in (1, 2) for i in range(6) for s in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(2):
        df.filter(F.col("seq") >= 0).filter(F.floor(F.col("seq") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = attempts.ingest(stream, SENTENCES, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    got = {tuple(r) for r in attempts.outputs(spark, str(tmp_path / "out")).select("member", "id", "sent_index", "label").collect()}
    want = {tuple(r) for r in keep_one(attempts.normalized(df, SENTENCES), attempts.CELL, ["seq"]).select("member", "id", "sent_index", "label").collect()}
    assert got == want and len(got) == 36


def test_rolling_mix(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", 1 + m % 2, SENTENCES.labels[m % 5]) for h in (0, 1, 5) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, member int, label string").select(F.to_timestamp("t").alias("ts"), "member", "label")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, attempts.rolling_mix(df, SENTENCES).collect()))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = attempts.rolling_mix(stream, SENTENCES).writeStream.outputMode("update").format("memory").queryName("mix").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("mix").collect())) == want and len(want) == 6


def test_the_least_seq_wins_though_it_comes_later(spark, tmp_path):
    label = lambda k: '{"label": "%s"}' % SENTENCES.labels[k]
    for ts in (None, "ts"):
        folder = tmp_path / str(ts)
        # three runs: cell 0 gets smaller seqs each time, cell 1 larger ones, cell 2 comes once; day 1 comes again after day 20
        runs = [[(1, 0, 0, 9, 1, 2), (1, 1, 0, 1, 1, 2), (1, 2, 0, 5, 0, 2)], [(1, 0, 0, 4, 2, 2), (1, 1, 0, 3, 3, 2), (1, 0, 0, 6, 3, 2)], [(1, 7, 0, 0, 4, 20), (1, 0, 0, 3, 0, 2)], [(1, 8, 0, 0, 1, 1), (1, 0, 0, 0, 4, 1)]]
        late = 0
        for rows in runs:
            df = spark.createDataFrame(rows, "member int, id long, sent_index int, seq long, k int, day int")
            df = df.select("member", "id", "sent_index", "seq", F.element_at(F.array(*[F.lit(label(k)) for k in range(5)]), F.col("k") + 1).alias("raw"), F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(3), F.lit(0), F.lit(0)).alias("ts"))
            df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = spark.readStream.schema(df.schema).parquet(str(folder / "in"))
            query = attempts.ingest(stream, SENTENCES, str(folder / "out"), str(folder / "check"), ts=ts)
            query.awaitTermination(120)
            late += attempts.late_rows(query)
        got = {r.id: (r.seq, r.label) for r in attempts.outputs(spark, str(folder / "out")).collect()}
        names = SENTENCES.labels
        if ts is None:
            assert got == {0: (0, names[4]), 1: (1, names[1]), 2: (5, names[0]), 7: (0, names[4]), 8: (0, names[1])} and late == 0
        else:  # what comes after the watermark of day 19 is dropped and counted
            assert got == {0: (3, names[0]), 1: (1, names[1]), 2: (5, names[0]), 7: (0, names[4])} and late == 2


def test_state_lies_on_disk_and_settings_come_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomkit.config import SENTENCES
    from loomkit.streaming.attempts import ingest

    rows = spark.range(9).select(F.lit(1).alias("member"), "id", F.lit(0).alias("sent_index"), F.lit(0).alias("seq"), F.lit("Supported").alias("raw"), F.lit("2024-01-01 12:00:00").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    query = ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), SENTENCES, str(tmp_path / "out"), str(tmp_path / "state"), ts="ts")
    query.awaitTermination()
    assert any("rocksdb" in k for p in query.recentProgress for s in p["stateOperators"] for k in s["customMetrics"])
    assert spark.conf.get(key) == before


def _run(spark, folder, rows, schema, **how):
    """Adds rows to the input below folder and streams them to the end."""
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    query = attempts.ingest(spark.readStream.schema(df.schema).parquet(str(folder / "in")), how.pop("labels", SENTENCES), str(folder / "out"), str(folder / "check"), **how)
    query.awaitTermination(120)
    return query


def test_state_is_aggregated_by_hash(spark, tmp_path):
    query = _run(spark, tmp_path, [(1, i, 0, i % 3, "Contradiction", datetime(2024, 1, 1)) for i in range(9)], SCHEMA + ", ts timestamp", ts="ts")
    plan = query._jsq.explainInternal(False)
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    key = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    assert not spark.conf.get(key, None) and len(attempts.outputs(spark, str(tmp_path / "out")).collect()) == 9


def test_rows_stay_whole_and_null_seq_is_least(spark, tmp_path):
    schema = "member int, id long, sent_index int, seq long, raw string, note string, _w int, ts timestamp"
    names, day = SENTENCES.labels, datetime(2024, 1, 1)
    # cell 0: one seq twice with other contents; 1: null seq; 2: seqs at both ends; 3: null contents; 4: an unreadable text
    first = [(1, 0, 0, 5, names[1], "a", 1, day), (1, 0, 0, 5, names[2], "b", 2, day), (1, 1, 0, -9, names[1], "a", 1, day), (1, 2, 0, (1 << 63) - 1, names[1], "a", 1, day), (1, 3, 0, 7, None, None, None, day), (1, 4, 0, 0, "?", "a", 1, day)]
    later = [(1, 1, 0, None, names[3], "c", 3, day), (1, 2, 0, -(1 << 62), names[4], "d", 4, day), (1, 3, 0, 8, names[1], "a", 1, day), (1, 4, 0, 1, names[1], "b", 1, day)]
    for ts in (None, "ts"):
        folder = tmp_path / str(ts)
        for rows in (first, later):
            _run(spark, folder, rows, schema, ts=ts)
        got = {r.id: (r.seq, r.label, r.parsed_ok, r.note, r["_w"]) for r in attempts.outputs(spark, str(folder / "out")).collect()}
        assert got.pop(0) in ((5, names[1], True, "a", 1), (5, names[2], True, "b", 2))
        assert got == {1: (None, names[3], True, "c", 3), 2: (-(1 << 62), names[4], True, "d", 4), 3: (7, SENTENCES.default, False, None, None), 4: (0, SENTENCES.default, False, "a", 1)}


def test_labels_keep_their_names_when_the_set_is_ordered_anew(spark, tmp_path):
    turned = dataclasses.replace(SENTENCES, labels=(*reversed(SENTENCES.labels), "Other"))
    day = datetime(2024, 1, 1)
    rows = [(1, i, 0, 1, x, day) for i, x in enumerate(SENTENCES.labels)]
    _run(spark, tmp_path, rows, SCHEMA + ", ts timestamp", ts="ts")
    _run(spark, tmp_path, [(1, i, 0, 2, "Other", day) for i in range(6)], SCHEMA + ", ts timestamp", ts="ts", labels=turned)
    got = {r.id: r.label for r in attempts.outputs(spark, str(tmp_path / "out")).collect()}
    assert got == {**dict(enumerate(SENTENCES.labels)), 5: "Other"}


def test_a_batch_does_not_read_the_table(spark, tmp_path):
    _run(spark, tmp_path, [(1, 0, 0, 2, "Contradiction"), (1, 1, 0, 0, "Supported")], SCHEMA)
    old = {f: f.read_bytes() for f in (tmp_path / "out").rglob("*.parquet")}
    for f in old:
        f.write_bytes(b"unreadable")
    _run(spark, tmp_path, [(1, 0, 0, 1, "Supported"), (1, 1, 0, 3, "Contradiction")], SCHEMA)
    for f, data in old.items():
        f.write_bytes(data)
    assert {r.id: (r.seq, r.label) for r in attempts.outputs(spark, str(tmp_path / "out")).collect()} == {0: (1, "Supported"), 1: (0, "Supported")}


def test_outputs_hold_no_rows_before_they_are_dealt(spark, tmp_path):
    _run(spark, tmp_path, [(1, i, 0, i % 3, "Contradiction") for i in range(9)], SCHEMA)
    plan = attempts.outputs(spark, str(tmp_path / "out"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("Exchange")[0] and "Aggregate" not in plan.split("Exchange")[1]
    assert not any(x in plan for x in ("Sort", "Window"))


def test_usual_objects_are_read_as_all_others(spark):
    import random

    from loomkit.functions.normalize import single_label

    names, draw = SENTENCES.labels, random.Random(5)
    whole = [f'{{"label":{by}"{n}"}}' for by in ("", " ") for n in names]
    bits = [*whole, *names, *[n.lower() for n in names], "{", "}", '"', "label", '"label"', ":", ' "', '"}', '{"label": "', '{"LABEL": "Supported"}', "\n", "\\", "\t", "  ", "İ", ","]
    texts = [*whole, *[x + " " for x in whole], *["".join(draw.choices(bits, k=draw.randint(1, 7))) for _ in range(4000)]]
    # a space before the last brace, where none belongs to a string, leaves the object as it is but isn't the usual spelling
    rows = [(i, t, t.rstrip(" ")[:-1] + " }") for i, t in enumerate(texts) if t.rstrip(" ").endswith('"}')]
    df = spark.createDataFrame(rows, "i int, raw string, spaced string").select("raw", single_label(F.col("raw"), SENTENCES).alias("a"), single_label(F.col("spaced"), SENTENCES).alias("b"))
    assert df.filter("not (a <=> b)").collect() == []
    assert [r.a.label for r in df.limit(10).collect()] == [*names, *names] and len(rows) > 400
