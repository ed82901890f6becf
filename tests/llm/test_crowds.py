"""Links within crowds that are nearly as alike as the links."""

import random

import numpy as np
from loomkit.llm import crowds, near

from .test_documents import plain_shingles


def crowd(size, pairs, rng):
    """(texts, planted pairs): documents of 500 common and 94 own words, any two alike by 0.725, the planted ones by 0.753."""
    word = iter(range(10**9))
    own = lambda n: [f"w{next(word)}" for _ in range(n)]
    template = own(500)
    texts = [template + own(94) for _ in range(size)]
    ends = rng.sample(range(size), 2 * pairs)
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        texts[b][500:511] = texts[a][500:511]
    return [" ".join(t) for t in texts], [tuple(sorted(p)) for p in zip(ends[::2], ends[1::2], strict=True)]


def test_no_link_of_a_crowd_is_lost(spark):
    texts, planted = crowd(1500, 80, random.Random(4))
    sets = [plain_shingles(texts[x]) for p in planted[:3] for x in p] + [plain_shingles(texts[k]) for k in range(2)]
    likeness = lambda a, b: len(a & b) / len(a | b)
    assert all(0.75 <= likeness(sets[2 * k], sets[2 * k + 1]) < 0.76 for k in range(3)) and 0.72 < likeness(sets[0], sets[2]) < 0.74
    # beside them a group of copies that is linked as a whole, one of whose words changes in each
    base = [f"c{k}" for k in range(400)]
    for k in range(700):
        texts.append(" ".join([*base[: k % 400], f"x{k}", *base[k % 400 + 1 :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()}
    want = {i: i if i < 1500 else 1500 for i in range(len(texts))} | {b: a for a, b in planted}
    assert got == want


def test_links_join_what_is_linked(spark, monkeypatch):
    monkeypatch.setattr(crowds, "ASK", 7)
    monkeypatch.setattr(crowds, "MET", 20)
    rng = random.Random(5)
    common = [rng.getrandbits(62) for _ in range(60)]
    sets, of = [], []
    for i in range(260):
        if i % 4 == 3:
            own = [x for x in sets[rng.randrange(len(sets))] if rng.random() < 0.93] + [rng.getrandbits(62) for _ in range(2)]
        else:
            own = rng.sample(common, rng.randint(40, 60)) + [rng.getrandbits(62) for _ in range(rng.randint(6, 19))]
        sets.append(sorted(set(own)))
        of.append(rng.choice([i, i, i, 7]))
    df = spark.createDataFrame([(i, c, bytearray(np.asarray(s, np.int64).tobytes())) for i, (s, c) in enumerate(zip(sets, of, strict=True))], "node long, component long, shingles binary")
    got = {tuple(sorted((r.a, r.b))) for r in crowds.cross_links(df, 75).collect()}
    pure = [set(s) for s in sets]
    want = {(a, b) for b in range(len(pure)) for a in range(b) if of[a] != of[b] and 100 * len(pure[a] & pure[b]) >= 75 * len(pure[a] | pure[b])}
    assert got <= want and len(want) > 40

    def joined(links):
        parent = {c: c for c in of}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = sorted((root(of[a]), root(of[b])))
            parent[y] = x
        return [root(c) for c in of]

    assert joined(got) == joined(want) and len(set(joined(want))) > 5
    assert crowds.cross_links(df.limit(0), 75).count() == 0
