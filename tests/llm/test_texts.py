"""Spot signatures, ranked search and collocations against plain versions, and their edges."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from loomkit.llm import phrases, search, spots
from loomkit.llm.quality import STOP_WORDS as COMMON
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .test_documents import lower

DATA = "/root/testdata/sf0.001"
STOP_WORDS = set(COMMON)
ODD = ("SCORE", "Rank", "_key", "run", "guest", "next_text", "spots", "Fingerprint", "n", "f", "phrase", "a`b", "part", "_w")


def odd():
    return {c: F.lit("x") for c in ODD}


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


# Spot signatures.


def plain_spots(text, chain=2):
    words, out, at = re.findall(r"\w+", (text or "").lower().replace("_", " ")), set(), []
    content = [w for w in words if w not in STOP_WORDS]
    k = 0
    for w in words:
        if w in STOP_WORDS:
            at.append((w, k))
        else:
            k += 1
    sign = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    out = {sign(" ".join([w, *content[k : k + chain]])) for w, k in at if k + chain <= len(content)}
    return sorted(out or ({sign(" ".join(words))} if words else set()))


def plain_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_edited(texts):
    """texts: (doc_id, text) with distinct ids."""
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, following = plain_spots(text), plain_spots(changed), plain_spots(after)
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(own), "".join(other), plain_likeness(own, other), plain_likeness(own, following), len(own))
    return out


SPOT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"]


def same_edits(df, texts):
    got, want = {r.doc_id: tuple(r)[1:] for r in df.select(*SPOT).collect()}, plain_edited(texts)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:6] == pytest.approx(w[4:6]) and got[i][6] == w[6], i


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    words = ["the", "of", "and", "le", "Das", "hend", "stible", "ñadobo", "été", "x1", "Ærø", "🙂", "wh--at", "a", "\t", "und", "thnd,", "12.5"]
    some = [(7 * i - 40, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 40, 200])))) for i in range(900)]
    return [*some, (None, "the last one of all in order"), (10**17, None), (-(2**62), "the the the of of"), (10**18, "content only here"), (5 * 10**17, " \n.,")]


def test_edits_of_odd_texts(spark, odd_texts):
    df = spark.createDataFrame(odd_texts, "doc_id long, text string")
    same_edits(spots.edited(df), odd_texts)
    assert rows(spots.edited(df.withColumns(odd()).repartition(7)).select(*SPOT)) == rows(spots.edited(df).select(*SPOT))


def test_edits_of_small_tables(spark):
    df = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    assert spots.edited(df([])).count() == 0
    same_edits(spots.edited(df([(4, "the end of the day")])), [(4, "the end of the day")])
    same_edits(spots.edited(df([(4, None), (9, "one of these words here")])), [(4, None), (9, "one of these words here")])
    twice = spots.edited(df([(1, "the same old words of mine")] * 3 + [(0, "b")])).collect()
    assert len(twice) == 4 and len({r.fingerprint for r in twice}) == 2 and sorted(r.near_next for r in twice) == [0, 0, 1, 1]


def test_a_very_long_text_is_read_once(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "of", "abc", "defg", "h"]) + str(rng.randint(0, 3000)) * rng.randint(0, 1) for _ in range(150_000))
    texts = [(1, long), (2, "the " * 200_000), (3, "word " * 200_000 + "of")]
    same_edits(spots.edited(spark.createDataFrame(texts, "doc_id long, text string")), texts)


def test_whole_edits_query(spark):
    texts = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    same_edits(entry.queries()["op11_spot_signatures"](spark, DATA), texts)


def test_near_pairs_are_all_found(spark):
    rng = random.Random(8)
    crowd = [f"c{k}" for k in range(30)]
    sets = []
    for i in range(300):
        if i % 3 == 0:  # a crowd whose members are nearly as alike as near pairs
            own = crowd + [f"{i}-{k}" for k in range(rng.randint(3, 8))]
        elif i % 3 == 1:
            own = rng.sample([f"w{k}" for k in range(60)], rng.randint(1, 40))
        else:
            own = [x for x in sets[rng.randrange(len(sets))][1] if rng.random() < 0.9] + [f"{i}"]
        sets.append((i, sorted(set(own))))
    sets += [(1000, []), (1001, []), (1002, None)]
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in spots.near_pairs(spark.createDataFrame(sets, "name long, spots array<string>")).collect()}
    pure = [(i, set(s)) for i, s in sets if s]
    want = {(i, k) for n, (i, a) in enumerate(pure) for k, b in pure[n + 1 :] if 100 * len(a & b) >= 75 * len(a | b)}
    assert got == want and len(want) > 50


def test_length_partitions_hold_near_sets(spark):
    size = spark.range(1, 4000).select(spots.length_partition(F.col("id")).alias("p"), "id").collect()
    p = {r.id: r.p for r in size}
    for n in range(1, 2900):
        most = n * 100 // 75
        assert p[n] <= p[most] <= p[n] + 1


# Ranked search.

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def plain_rank(texts, items, top=50):
    docs = [(i, Counter(lower(w) for w in TERM.findall(t or ""))) for i, t in texts]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        terms = {lower(w) for w in TERM.findall(text or "")} & set(df)
        weight = {w: math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) for w in terms}
        found = []
        for i, c, n in docs:
            m = 50 + 50 * n * count // total
            found.append((-sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w]), i is None, i))
        found = sorted((x for x in found if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:top])]
    return sorted(map(repr, out))


def test_ranks_against_all_documents(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 400}" for _ in range(4000)] + ["Été", "ÉTÉ", "x_y", "Z9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, text(rng.choice([0, 1, 3, 20, 200]))) for i in range(3000)] + [(None, text(30)), (None, None), (-5, None), (7000, "w1 w1!" * 5000)]
    texts += [(10_000 + i, texts[5][1] or "w1") for i in range(300)]  # more ties than ranks
    items = [(k, text(rng.choice([1, 5, 40]))) for k in range(25)] + [(90, None), (91, "  "), (None, text(9)), (92, texts[5][1] or "w1"), (93, "unheardof")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain_rank(texts, items)
    assert rows(search.rank(df, asked)) == want
    assert rows(search.rank(df.withColumns(odd()), asked.withColumn("RANK", F.lit(1)))) == want
    monkeypatch.setattr(search, "ITEM_TERMS", 50)  # several parts of items
    assert rows(search.rank(df, asked)) == want


def test_ranks_of_small_tables(spark):
    docs, items = (lambda t: spark.createDataFrame(t, "doc_id long, text string")), (lambda t: spark.createDataFrame(t, "item_id long, text string"))
    assert search.rank(docs([]), items([(1, "a")])).count() == 0 and search.rank(docs([(1, "a")]), items([])).count() == 0
    texts, asked = [(2, "a b"), (2, "a b"), (1, "c")], [(1, "A a"), (1, "A a"), (2, "c")]
    assert rows(search.rank(docs(texts), items(asked))) == plain_rank(texts, asked)


def test_skipping_gives_what_all_sums_give():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(1, 9000))
        lists = []
        for _ in range(int(rng.integers(1, 14))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.002, 0.05, 0.3, 0.9])).astype(np.int32)
            if len(docs):
                parts = rng.integers(1, int(rng.choice([3, 50, 900])), len(docs))
                lists.append((docs, parts, int(parts.max())))
        ids, known = rng.permutation(n).astype(np.int64), np.ones(n, bool)
        best = search.Best(7)
        search.search_block(lists, n, best, ids, known)
        sums = np.zeros(n, np.int64)
        for docs, parts, _ in lists:
            sums[docs] += parts
        want = sorted((-int(s), int(i)) for s, i in zip(sums, ids, strict=True) if s)[:7]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want, trial


@pytest.mark.parametrize("name", ["op11_spot_signatures", "op12_ranked_search", "op13_collocations"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = entry.queries()[name](spark, DATA).collect()
    assert got and sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got)


# Collocations.


def plain_collocations(texts, least, longest=5, top=2000):
    out, by = [], {}
    for lang, text in texts:
        by.setdefault("und" if lang is None else lang, []).append(lower(text or ""))
    for lang, own in by.items():
        f, n = Counter(), 0
        for text in own:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        many = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inner = {}
        for g, a in many.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inner[g[i : i + k]] = max(a, inner.get(g[i : i + k], 0))
        found = []
        for g, a in many.items():
            if inner.get(g, 0) < a:
                score, k = min((math.floor(Fraction(1000 * a * n, f[g[:k]] * f[g[k:]])), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(map(repr, out))


def test_collocations_against_all_phrases(spark, monkeypatch):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(30)] + ["É", "é", "{}", "A'b"]
    chains = [" ".join(rng.choice(common) for _ in range(k)) for k in (2, 3, 4, 5, 6, 7)] + ["so so so so so so"]

    def text(n):
        return "".join(rng.choice([rng.choice(common), rng.choice(common).upper(), rng.choice(chains), f"rare{rng.random()}"]) + rng.choice([" ", " ", "\t ", ", ", ".\n", ";"]) for _ in range(n))

    texts = [(rng.choice(["en", "en", "en", "fr", None, ""]), text(rng.choice([0, 5, 100]))) for _ in range(500)] + [("de", None), ("zz", "alone"), ("en", text(3000)), ("xx", "so " * 400)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(6)
    want = plain_collocations(texts, 20)
    assert rows(phrases.collocations(df, 20)) == want and len(want) > 100
    assert rows(phrases.collocations(df.withColumns(odd()), 20)) == want
    assert rows(phrases.collocations(df, 20, top=3)) == plain_collocations(texts, 20, top=3)
    monkeypatch.setattr(phrases, "SIDE", 4)  # a few dense tiles beside many sparse ones, in this process
    monkeypatch.setattr(phrases, "DENSE", 50)
    i, j = (np.asarray([int(rng.paretovariate(0.7)) % 90 for _ in range(5000)]) for _ in range(2))
    codes, counts = phrases.tiled(i, j)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == Counter((a << 32) | b for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert len(codes) == len(set(codes.tolist())) and not len(phrases.tiled(i[:0], j[:0])[0])


def test_collocations_of_small_tables(spark):
    df = lambda t: spark.createDataFrame(t, "lang string, text string")
    assert phrases.collocations(df([])).count() == 0 and phrases.collocations(df([(None, None), ("en", "a b")])).count() == 0
    texts = [("en", "a b")] * 100 + [(None, "a b c. " * 100)]
    assert rows(phrases.collocations(df(texts))) == plain_collocations(texts, 100)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big, few = 9 * 10**15, spark.createDataFrame([("en", "a b", 2, 3 * 10**15), ("en", "a", 1, 5 * 10**15), ("en", "b", 1, 4 * 10**15)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (few, spark.createDataFrame([("en", big)], "lang string, n long")))
    r = phrases.collocations(few.select("lang", F.lit("").alias("text"))).first()
    assert r.score == 1000 * r.a * big // (5 * 10**15 * 4 * 10**15)
