"""Operators on documents against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm import kneser, near, packing, quality, repeats, tokenfile
from loomkit.llm.common import filesystem
from loomkit.llm.tokens import encoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, extra string"
BPE = public_path("byte_bpe_50k.json")


def lower(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", *("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 9))) for _ in range(400))]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randint(5, 300)) for _ in range(40)]
    passage = text(40)
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:20]):
        words = t.split()
        words[len(words) // 2] = "changed"
        out += [(100 + i, " ".join(words)), (200 + i, t), (300 + i, passage + "\n" + t[: rng.randint(0, 200)])]
    out += [(400, None), (401, ""), (402, "   \n\t "), (403, "a" * 3000), (404, "ab" * 900), (405, "one two three"), (406, "One TWO three"), (407, "é ü ß " * 300), (408, "日本語 テキスト▁ x"), (409, "x\n" * 500), (410, "the  double   spaces\n \n end "), (None, "a null id " * 20)]
    out += [(411, base[0]), (411, base[0])]
    return [(i, t, f"e{k}") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, rows):
    got = repeats.remove_repeats(docs).select("doc_id", "extra", "n_bytes", F.expr("n_bytes - length(kept)"), F.size("spans"), F.sha2("kept", 256)).collect()
    want = plain_repeats(rows)
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[2:] for r in got} == want


def test_repeats_of_an_empty_table(docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_does_not_depend_on_partitions(docs):
    a, b = (repeats.remove_repeats(docs.repartition(n)).select("doc_id", "extra", "kept").orderBy("extra").collect() for n in (1, 7))
    assert a == b


def plain_quality(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    held = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(held) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(held), failed


def test_quality(docs, rows):
    got = {r["extra"]: r for r in quality.judge(docs).collect()}
    for _, t, e in rows:
        r = got[e]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t)
        assert not (r.kept and r.base_failed) and r.kept == (not r.failed_rules)


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = " ".join(f"the word{i} of a story{i}" for i in range(60))
    junk = [prose.replace(" ", "%%% "), " | ".join(f"cell{i}" for i in range(90)), " ".join(f"SHOUT{i}!!" for i in range(90)), "the same of it\n" * 60]
    out = quality.judge(spark.createDataFrame([(0, prose), *enumerate(junk, 1)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in out] == [True, False, False, False, False]


def plain_shingles(t):
    w = [lower(x) for x in WORD.findall(t or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, rows):
    sets = {(i, t): plain_shingles(t) for i, t, _ in rows}
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[root(k)] = min(least.get(root(k), 10**9), k[0])
    got = near.near_duplicates(docs).collect()
    want = collections.Counter((k[0], len(sets[k]), least.get(root(k)) if sets[k] else k[0]) for i, t, _ in rows for k in [(i, t)])
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_an_empty_table(docs):
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    made = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(words)))
    sets = [plain_shingles(t) for _, t in made]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(300):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(300)}


def plain_ids(t):
    return np.asarray([*encoder(BPE).tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_files(spark, docs, rows):
    manifest = tokenfile.write_tokens(docs, BPE, frame_ids=500)
    got = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = plain_ids(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_token_files_give_single_documents(docs, rows):
    texts = {i: t for i, t, _ in rows}
    found = {}
    for row in tokenfile.write_tokens(docs, BPE, frame_ids=500).collect():
        fs, path = filesystem(row["path"])
        reader = tokenfile.FrameReader(fs.open_input_file(path))
        assert len(reader.index) + 1 == len(reader.entries)
        found |= {i: ids for i, ids in reader.documents([3, 105, 403, 9999])}
    assert set(found) == {3, 105, 403}
    assert all((found[i] == plain_ids(texts[i])).all() for i in found)


def test_a_broken_frame_is_noticed(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x")
    with fs.LocalFileSystem().open_output_stream(path) as out:
        writer = tokenfile.FrameWriter(out, 2, 10)
        for i in range(5):
            writer.add(i, np.arange(20, dtype="<u4"))
        writer.close()
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        tokenfile.FrameReader(fs.LocalFileSystem().open_input_file(path)).frame(0)


@pytest.mark.parametrize("merge", [4096, 5])
def test_packing(docs, rows, merge, monkeypatch):
    """With `merge` 5 leftover windows are merged in several tasks."""
    monkeypatch.setattr(packing, "MERGE", merge)
    got = packing.pack(docs, BPE, size=256, windows=4, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert sum(r.length for r in pieces) <= 256
    want = collections.Counter(plain_ids(t).tobytes() for _, t, _ in rows)
    sizes = collections.Counter((i, len(plain_ids(t))) for i, t, _ in rows)
    tiles = collections.Counter((r.doc_id, r.doc_tokens, r.start, r.length) for r in got)
    assert tiles == collections.Counter({(i, n, a, min(256, n - a)): k for (i, n), k in sizes.items() for a in range(0, n, 256)})
    pieces_of = collections.Counter((i, plain_ids(t)[a : a + 256].tobytes()) for i, t, _ in rows for a in range(0, len(plain_ids(t)), 256))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == pieces_of
    texts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        texts[r.doc_id].append(bytes(r.ids))
    assert sum(r.length for r in got) == sum(len(k) // 4 * n for k, n in want.items())
    assert b"".join(texts[3]) == plain_ids(dict((i, t) for i, t, _ in rows)[3]).tobytes()
    assert sum(256 - sum(r.length for r in p) for p in by.values()) < 0.1 * sum(r.length for r in got)


def test_packing_of_an_empty_table(docs):
    assert packing.pack(docs.limit(0), BPE).count() == 0


def plain_model(texts, order):
    """p(a, b, w) of an interpolated modified Kneser-Ney model, from plain counts."""
    triple = collections.Counter(x for w in texts for x in zip(["<s>", "<s>", *w], ["<s>", *w], w))
    pair, follows = collections.Counter(), collections.Counter()
    for (_, b, w), k in triple.items():
        pair[b, w] += k if b == "<s>" or order == 2 else 1
    for _, w in pair:
        follows[w] += 1
    vocabulary = len(follows)
    cut = lambda k, d: 0 if not k else d[min(k, 3) - 1]
    tally = lambda c: kneser.discounts([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)])
    levels = []
    for counts in (pair, triple)[: order - 1]:
        total, some, d = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), tally(counts)
        for key, k in counts.items():
            total[key[:-1]] += k
            some[key[:-1]][min(k, 3) - 1] += 1
        levels.append((counts, total, some, d))
    low = tally(follows)
    rest = sum(cut(k, low) for k in follows.values()) / len(pair)

    def p(a, b, w):
        out = max(follows[w] - cut(follows[w], low), 0) / len(pair) + rest / (vocabulary + 1)
        for context, (counts, total, some, d) in zip(((b,), (a, b)), levels):
            k = counts[(*context, w)]
            if total[context]:
                out = max(k - cut(k, d), 0) / total[context] + sum(x * y for x, y in zip(d, some[context])) / total[context] * out
        return out

    return p


@pytest.mark.parametrize(("times", "order"), [(1, 2), (4, 2), (1, 3), (4, 3)])
def test_kneser_ney(spark, docs, rows, times, order, monkeypatch):
    """Also where every text comes four times, so that counts of one never occur; and with words frequent enough to be spread."""
    monkeypatch.setattr(kneser, "LEAST_PIECES", 16)
    monkeypatch.setattr(kneser, "HELD", 3000)
    monkeypatch.setattr(kneser, "AT_A_TIME", 4000)
    model = kneser.train(docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))), order=order)
    got = {r["extra"]: r for r in kneser.score(docs, model).collect()}
    texts = [[lower(w) for w in WORD.findall(t or "")] + [None] for _, t, _ in rows]
    p = plain_model(texts * times, order)
    count = collections.Counter(w for t in texts * times for w in t)
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.vocabulary) == (n, v) and max(count.values()) > model.spread()
    for (_, _, e), w in zip(rows, texts):
        assert got[e].score == pytest.approx(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *w], ["<s>", *w], w)))
        assert got[e].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    for a, b in (("<s>", "<s>"), ("<s>", "one"), ("one", "two"), ("the", "the"), ("never seen", "the"), ("the", "never seen")):
        assert sum(p(a, b, w) for w in count) + p(a, b, "another") == pytest.approx(1)
    new = kneser.score(spark.createDataFrame([(1, "unheard of words"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert (new[0].n_tokens, new[0].n_known, new[1].n_tokens) == (4, 2, 1)
    unseen = ["unheard", "of", "words", None]
    assert new[0].score == pytest.approx(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *unseen], ["<s>", *unseen], unseen)))
    assert all(math.isfinite(r.score) for r in (*got.values(), *new))


def test_discounts_leave_something_to_every_word():
    assert all(0 < x <= k + 1 for counts in ([1, 1, 1, 1], [5, 100, 3, 9], [100, 1, 1, 50], [3, 2, 1, 0], [0, 9, 9, 9]) for k, x in enumerate(kneser.discounts(counts)))


def test_kneser_ney_without_texts(docs):
    out = kneser.score(docs, kneser.train(docs.limit(0))).first()
    assert out.train_tokens == 0 and out.n_known == 0


CLASHING = ["doc", "ord", "found", "spans", "kept", "n_words", "base_failed", "_words", "_row", "_whole", "_text", "score", "n_tokens", "Perplexity", "component_id", "own", "node", "sequence_id", "ids", "open", "start", "held_out", "part"]


def test_columns_with_clashing_names(spark):
    """Columns named like a result's are replaced, others of any name stay where the operator keeps columns."""
    texts = [(1, "the one of two and three " * 20), (2, "the one of two and three " * 20), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    odd = df.withColumns({c: F.lit("x") for c in CLASHING})
    rows = lambda out: sorted(map(repr, out.collect()))
    model = kneser.train(odd.select("text"))
    for run, kept in (
        (repeats.remove_repeats, {"_words", "score"}), (quality.judge, {"_words", "_row", "spans"}), (quality.passing, {"kept", "_row", "_whole", "n_words"}), (near.near_duplicates, set()),
        (lambda x: packing.pack(x, BPE), set()), (lambda x: tokenfile.read_tokens(tokenfile.write_tokens(x, BPE)), set()), (lambda x: kneser.score(x, model), {"kept", "_row"}),
    ):
        plain, out = run(df), run(odd)
        assert rows(out.select(*plain.columns)) == rows(plain) and kept <= set(out.columns)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r.held_out for r in kneser.held_out(odd).collect()} <= {True, False}


def test_least_and_null_doc_ids_are_told_apart(spark):
    texts = [(None, "some words that come twice here " * 10), (-(2**63), "some words that come twice here " * 10), (-(2**63), "b"), (5, "c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): len(r.kept) for r in repeats.remove_repeats(df).collect()}
    size = len(texts[0][1])
    assert len(got) == 4 and got[(None, size)] > 0 and got[(-(2**63), size)] == 0
    filed = tokenfile.read_tokens(tokenfile.write_tokens(df, BPE)).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in filed)) == [(False, 0), (True, -(2**63)), (True, -(2**63)), (True, 5)]
    assert all(bytes(r.ids) in {plain_ids(t).tobytes() for i, t in texts if i == r.doc_id} for r in filed)


def test_very_long_texts(spark):
    """Texts beyond what a task looks at together: parts of 512 KB in op1, 2 MB in op5, 6 MB in op10."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(30000)]
    long = " ".join(rng.choice(words) for _ in range(1_100_000))
    other = long[:3_000_000] + " changed " + long[3_000_000:]
    df = spark.createDataFrame([(1, long), (2, other), (3, long[100_000:800_000]), (4, "short words here")], "doc_id long, text string")
    got = {r.doc_id: r for r in near.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1].n_shingles == len(plain_shingles(long))
    out = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df).collect()}
    assert out[1] == long.encode() and out[3] == b"" and out[4] == b"short words here"
    assert out[2] and out[2] in b" changed "
    model = kneser.train(df)
    scored = {r.doc_id: r for r in kneser.score(df, model).collect()}
    counts = collections.Counter(w for _, t in [(1, long), (2, other), (3, long[100_000:800_000]), (4, "short words here")] for w in [*t.split(), None])
    assert model.tokens == sum(counts.values()) and model.vocabulary == len(counts)
    base = sum(math.log10((counts[w] + 1) / (model.tokens + len(counts) + 1)) for w in [*long.split(), None])
    assert scored[1].n_tokens == 1_100_001 and scored[1].base_score == pytest.approx(base) and all(math.isfinite(r.score) for r in scored.values())


def test_crowds_of_near_copies_and_of_unlike_texts(spark, monkeypatch):
    """Regions with more rows than meet at a time are deepened; all links of a brute-force search are found."""
    monkeypatch.setattr(near, "CROWD", 24)
    monkeypatch.setattr(near, "HELD", 150)
    monkeypatch.setattr(near, "deepened", lambda prefix, n, own=near.deepened: own(prefix, n, 24))
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(100)]
    made = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = word()
        made.append(words)
    for i in range(120):  # one passage in all of them, then pairs of near copies
        words = passage + [word() for _ in range(60)]
        made += [words, [*words[:130], word(), *words[131:]]]
    made = [(i, " ".join(w)) for i, w in enumerate(made)]
    sets = [plain_shingles(t) for _, t in made]
    parent = list(range(len(made)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(made)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root(i) for i in range(len(made))}


def test_groups_of_a_deepened_region():
    prefix = np.asarray([0, 3, 3, 5, 5, 4, 0, 60, 60, 60])
    n = np.ones(10, np.int64)
    assert near.deepened(prefix, n, crowd=10).tolist() == [0, 6]
    assert near.deepened(prefix, n, crowd=3).tolist() == [0, 1, 2, 5, 6, 8]
    assert near.deepened(prefix, n * 10, crowd=10, shingles=30).tolist() == [0, 1, 2, 5, 6, 8]
