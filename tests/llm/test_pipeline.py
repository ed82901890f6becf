"""The pipeline's stages on a small corpus, each against a plain version of its step."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomkit.llm.common import stored
from loomkit.llm.tokens import encoder, public_path

from .test_documents import plain_quality, plain_repeats, plain_shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["the", "of", "and", "to", *("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 9))) for _ in range(900))]
    text = lambda n: " ".join(rng.choice(words[:4]) if rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    passage = text(30)
    rows = [(i, text(120)) for i in range(20)]
    rows += [(20 + i, t + " " + text(3)) for i, t in rows[:6]]
    rows += [(40 + i, passage + " " + text(90)) for i in range(5)] + [(50, "too short"), (51, text(80).replace(" ", "%%% ")), (52, None), (53, "é" * 60 + text(100))]
    out = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{out}/documents.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
            kept.append(set(after))
        if name == "quality_rules":
            assert not {50, 51, 52} & set(after) and all(not plain_quality(t)[5] for t in after.values()) and set(range(50)) & set(before) <= set(after) | {50}
        elif name == "near_duplicates":
            assert {20 + i for i in range(6)} & set(after) == set() and set(range(20)) <= set(after) and after == {i: before[i] for i in after}
        elif name == "repeated_passages":
            want = plain_repeats([(i, t, "") for i, t in before.items()])
            assert {i: len(t.encode()) for i, t in after.items()} == {i: w[0] - w[1] for i, w in want.items() if w[0] > w[1]}
            assert sum(len(before[i]) - len(after[i]) for i in after) > 300
        else:
            pieces = collections.defaultdict(list)
            for r in sorted(docs.collect(), key=lambda r: r.start):
                assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
                pieces[r.doc_id].append(bytes(r.ids))
            own = encoder(public_path("byte_bpe_50k.json"))
            assert {i: b"".join(p) for i, p in pieces.items()} == {i: own.ids(t) + np.asarray([0], "<u4").tobytes() for i, t in after.items()}
    assert kept[0] > kept[1] >= kept[2]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 10
    assert plain_shingles("a b") == {("a", "b")}
