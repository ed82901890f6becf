"""The registered queries over the smallest tables, whole, against plain versions."""

import math
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loomkit.llm import pieces
from loomkit.llm.tokens import public_path

from .test_documents import WORD, lower, plain_ids, plain_model, plain_repeats, plain_shingles
from .test_others import library

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


def collected(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def test_repeated_strings(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in collected(spark, "op1_repeated_strings")}
    assert got == plain_repeats([(i, t, "") for i, t in texts.items()])


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_url_lists"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in collected(spark, name))


def test_packing(spark, texts):
    ids = {i: plain_ids(t) for i, t in texts.items()}
    rows, used = collected(spark, "op3_packing"), {}
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows) == sorted((i, a, min(1024, len(x) - a), len(x)) for i, x in ids.items() for a in range(0, len(x), 1024))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024 and 1024 * len(used) < 1.1 * sum(used.values())


def test_near_duplicates(spark, texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in collected(spark, "op5_near_duplicates")}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_pages(spark):
    rows = collected(spark, "op6_html_extraction")
    pages = dict(duckdb.sql(f"select page_id, html from '{DATA}/pages.parquet'").fetchall())
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) and "<" not in r.text.replace("< ", "") for r in rows) and sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)


def test_pieces(spark, texts):
    lib = library()
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.n_chars, r.round_trip) for r in collected(spark, "op7_pieces")}
    want = {i: np.asarray(lib.encode(t or ""), "<u4") for i, t in texts.items()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes()), len(texts[i] or ""), True) for i, x in want.items()}
    assert pieces.by_merging(public_path("piece_bpe_32k.model"))


def test_nearest_vectors(spark):
    v = {i: np.asarray(x, float) for i, x in duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()}
    names = np.asarray(sorted(v))
    unit = np.stack([v[i] / np.linalg.norm(v[i]) for i in names])
    got, hits, total = {}, 0, 0
    for r in collected(spark, "op8_nearest_vectors"):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in v if i % 50 == 0}
    for q, rows in got.items():
        s = unit @ unit[np.searchsorted(names, q)]
        s[names == q] = -9
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(abs(r.score - s[names == r.vec_id][0]) < 1e-12 for r in rows)
        hits, total = hits + len({r.vec_id for r in rows} & set(names[np.argsort(-s)[:5]].tolist())), total + 5
    assert hits >= 0.9 * total


def test_token_files(spark, texts):
    start, want = 0, {}
    for i in sorted(texts):
        ids = plain_ids(texts[i])
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in collected(spark, "op9_token_files")} == want


def test_language_model(spark, texts):
    words = {i: [lower(w) for w in WORD.findall(t or "")] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [w for i, w in words.items() if not held[i]]
    count = {}
    for t in train:
        for w in t:
            count[w] = count.get(w, 0) + 1
    n, v, p = sum(count.values()), len(count), plain_model(train, 2)
    for r in collected(spark, "op10_kneser_ney"):
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *w], ["<s>", *w], w)))
