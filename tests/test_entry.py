"""The registry, and a sample of its queries against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["member_scores", "pooled_union", "confident_union", "leak_safe_split", "oversampled", "submission_problems", "top_cases", "density_reshaped", "injected_groups", "cleaned_rationales", "judged_entries", "consistent_units", "corrector_corpus", "strict_lines", "last_submissions", "guaranteed_sample", "streamed_outputs", "streamed_by_time", "streamed_mix", "swapped_table", "session_functions", "one_to_one_matches", "variant_captions", "caption_shapes"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(same(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(same(r[c]) for c in columns) for r in df.collect()) == want
