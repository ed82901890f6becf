"""Pieces, vectors, pages and URL lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.llm import html, neighbours, packing, pieces, tokenfile, urls
from loomkit.llm.tokens import encoder, public_path

MODEL = public_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b", "Hello  world é\n\tx", "日本語 ok", "🙂 ok", "a" * 300, "the the  the\n\n  and", "under takings, naïve.", "x1 2y 3 " * 30]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("text", [*TEXTS, "▁ x", "aaa aaaa aaaaa", "ab" * 500, "\u2028 x\ty"])
def test_streaming_search_gives_the_ids_of_the_library(text):
    own = pieces.pieces(MODEL)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == library().encode(text)
    if text:
        assert [i for run in own.search(pieces.SPACE + text.replace(" ", pieces.SPACE)) for i in run] == library().encode(text)


def test_ids_of_random_texts_are_the_library_s():
    import random

    rng, own, lib = random.Random(4), pieces.pieces(MODEL), library()
    parts = ["a", "th", "ing", "é", "ü", "日", "🙂", " ", "  ", "\n", ".", "1", "zq", "tion", "A", "'s", "▁", "aa", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert np.frombuffer(own.ids(t), "<u4").tolist() == lib.encode(t)


def test_search_commits_early():
    runs = list(pieces.pieces(MODEL).search(pieces.SPACE + "the quick brown fox and so on".replace(" ", pieces.SPACE) * 20))
    assert len(runs) > 50 and max(map(len, runs)) < 20


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    ids = pieces.encode(docs, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode(ids, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, None])}
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_byte_pairs_by_words_are_those_of_whole_texts():
    own = encoder(public_path("byte_bpe_50k.json"))
    for t in [*TEXTS, "don't it's", "a b", "<|endoftext|> x", "ª º é. 10% .5 ... !!a", "a \n b"]:
        assert own.ids(t) == np.asarray(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_added_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  c\n<|endoftext|>", "<|endoftext |> one <|endoftext|", "one two"]
    want = [np.asarray(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert want[0] == np.asarray([505, 220, 50256, 734], "<u4").tobytes()
    assert [encoder(path).ids(t) for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    end = np.asarray([0], "<u4").tobytes()
    packed = {r.doc_id: bytes(r.ids) for r in packing.pack(docs, path, with_ids=True).collect()}
    filed = {r.doc_id: bytes(r.ids) for r in tokenfile.read_tokens(tokenfile.write_tokens(docs, path)).collect()}
    assert packed == filed == {i: x + end for i, x in enumerate(want)}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16))
    v[700:720] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        s = unit @ unit[q]
        s[q] = -9
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()))
    assert hits >= 0.9 * 150
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 700), key=lambda r: r.rank)]
    assert ties == [3, 701, 702, 703, 704]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


PAGE = """<html><head><title>t</title></head><body><header>Site</header><div id="cookie-notice">We use cookies, ok, fine, yes, we do</div>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="wrap"><div class="content"><h2>Title</h2><p>First para, with commas, and more words to make it long enough, ok.</p>
<ul><li>one item</li><li>two <a href=x>link</a></li></ul><table><tr><td>a<td>b</table><p>Second&nbsp;para &eacute; &#39;q&#39;,   more
words, more words, more.</div><div class="sidebar"><p>Related, stuff, here, there, everywhere, long enough text</p></div></div>
<section id="comments"><p>I disagree, totally, with, this, it is a long comment, yes it is indeed</p></section><form>Search</form><footer>(c)</footer></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words, that have no tags at all, but go on"), (5, "u", "<article><h1>A</h1><p><b>A<br><p>B</article>"), (5, "u", "<p>x")], "page_id long, url string, html string")
    out = html.extract(df.withColumn("text", F.lit("old"))).orderBy("page_id", "text").collect()
    assert [r.page_id for r in out] == [1, 2, 3, 4, 5, 5]
    assert out[0].text == "Title\nFirst para, with commas, and more words to make it long enough, ok.\none item\ntwo link\na\nb\nSecond para é 'q', more words, more words, more."
    assert [r.text for r in out[1:4]] == ["", "", "plain words, that have no tags at all, but go on"]
    assert {r.text for r in out[4:]} == {"A\nA\nB", "x"}


def test_short_parts_of_pages_without_article_stay():
    text = "Four paragraphs without a comma " * 9
    four = f"<div>{f'<p>{text}</p>' * 4}</div>"
    want = "\n".join(["Short title", *[text.strip()] * 4, "A short closing section of forty letters."])
    close = "<div><p>A short closing section of forty letters.</p></div>"
    menu = '<div><a href="/a">Some other page</a> <a href="/b">And one more page</a></div>'
    assert html.main_text(f"<body><div><h1>Short title</h1>{four}{close}</div></body>") == want
    assert html.main_text(f"<body>{menu}<div>{menu}<h1>Short title</h1>{four}{close}</div></body>") == want
    assert html.main_text(f"<body><div><h1>Short title</h1><div>{four}</div>{close}</div></body>") == want
    assert html.main_text(f"<body><h1>Short title</h1>{four}{close}<nav>Menu</nav></body>") == want
    assert html.main_text(f'<body><div><h1><a href="/t">Short title</a></h1>{four}{close}{menu}</div></body>') == want


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("bad.example", 10, "block", 1), ("bad.example", 20, "withdraw", 2), ("bad.example", 30, "block", 3), ("bad.example", 30, "allow", 4), ("example", 5, "block", 5), ("ok.example/free", 0, "allow", 6), (None, 1, "block", 7), ("x", None, "block", 8)],
        "key string, listed int, action string, entry_id long",
    )
    captures = spark.createDataFrame(
        [(1, "http://bad.example/x", 9), (2, "http://a.bad.example/x", 10), (3, "HTTP://u@BAD.example:80?q", 20), (4, "http://bad.example", 30), (5, "http://ok.example/free/y", 7), (6, None, 50), (7, "no url", 50), (8, "http://bad.example/x", None), (9, "http://bad.example/x", 1)],
        "capture_id long, url string, fetched int",
    )
    out = {r.capture_id: (r.verdict, r.key, r.listed) for r in urls.judge(captures, entries).collect()}
    assert out == {
        1: ("none", None, None), 2: ("block", "bad.example", 10), 3: ("none", None, None), 4: ("allow", "bad.example", 30),
        5: ("allow", "ok.example/free", 0), 6: ("none", None, None), 7: ("none", None, None), 8: ("none", None, None), 9: ("none", None, None),
    }
    assert urls.judge(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in urls.judge(captures, entries.limit(0)).collect()} == {"none"}


def test_neighbours_in_several_blocks_and_at_any_magnitude(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 24))
    size = np.where(np.arange(400) % 3 == 0, 1e-200, np.where(np.arange(400) % 3 == 1, 1e200, 1.0))
    tiny = [float(x) for x in np.full(24, 5e-324)]
    df = spark.createDataFrame([(i, [float(y) for y in x * size[i]]) for i, x in enumerate(v)] + [(1000, tiny)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    v = np.concatenate([v, np.ones((1, 24))])
    ids = [*range(400), 1000]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in (*range(0, 400, 50), 1000):
        s = unit @ unit[ids.index(q)]
        s[ids.index(q)] = -9
        own = [r for r in got if r.query_id == q]
        assert len(own) == 5 and all(abs(r.score - s[ids.index(r.vec_id)]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & {ids[i] for i in np.argsort(-s)[:5]})
    assert hits >= 0.9 * 45
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours.nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 0.0)]


def unigram_model(path, pieces):
    """A model file of the unigram kind with the given (piece, score) besides the special ones and all bytes."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, raw: number(k << 3 | 2) + number(len(raw)) + raw
    flag = lambda k, n: number(k << 3) + number(n)
    entry = lambda text, score, kind: field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + flag(3, kind))
    special = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))]
    body = b"".join([*(entry(t, 0.0, k) for t, k in special), *(entry(t, s, 1) for t, s in pieces)])
    trainer, normalizer = flag(3, 1) + flag(35, 1), field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1)
    path.write_bytes(body + field(2, trainer) + field(3, normalizer))
    return str(path)


def test_ids_of_a_unigram_model_are_the_library_s(tmp_path):
    """With scores that are log probabilities, as the method is for, the search gives the ids that the library gives."""
    import random

    import sentencepiece

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["abc" * 400, "日本 語 x", "a  b   c ", " a", "🙂", "ab\ncd\te"]
    found = {"▁", *"abcdé"}
    while len(found) < 400:
        t = "▁" + rng.choice(texts).replace(" ", "▁")
        a = rng.randrange(len(t))
        found.add(t[a : a + rng.randint(2, 7)])
    model = unigram_model(tmp_path / "own.model", [(p, -rng.uniform(2, 12)) for p in sorted(found)])
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Pieces(model)
    for t in texts:
        ids = np.frombuffer(own.ids(t), "<u4").tolist()
        assert ids == library.encode(t) and own.text(own.ids(t)) == t
        assert [i for run in own.search("▁" + t.replace(" ", "▁")) for i in run] == ids


def plain_main_text(page):
    """The scoring rule over a parsed tree of a well-formed page, ancestor by ancestor."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.now = {"tag": "", "up": None, "kids": [], "names": ""}

        def handle_starttag(self, tag, attrs):
            self.now = {"tag": tag, "up": self.now, "kids": [], "names": dict(attrs).get("class", "")}
            self.now["up"]["kids"].append(self.now)

        def handle_endtag(self, tag):
            self.now = self.now["up"]

        def handle_data(self, data):
            self.now["kids"].append(data)

    tree = Tree()
    tree.feed(page)
    above = lambda x: [x, *above(x["up"])] if x is not None else []
    found, run = [], []

    def flush(x):
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            chain = above(x)
            home = next(y for y in chain if y["tag"] == "" or (y["tag"] in html.BLOCK and y["tag"] not in ("p", "h2", "li-")))
            found.append({"text": text, "linked": sum(len(t.strip()) for t, l in run if l), "home": home, "heading": any(y["tag"] == "h2" for y in chain)})
        run.clear()

    def walk(x):
        chain = above(x)
        inside = any(y["tag"] in ("article", "main") or html.WANTED.search(y["names"]) for y in chain[1:])
        if x["tag"] in html.BOILERPLATE or (x["tag"] not in ("html", "body", "main", "article") and (html.UNWANTED.search(x["names"]) or (not inside and html.UNWANTED_OUTSIDE.search(x["names"])))):
            return
        for k in x["kids"]:
            if isinstance(k, str):
                run.append((k, any(y["tag"] == "a" for y in chain)))
            elif k["tag"] in html.BLOCK:
                flush(x)
                walk(k)
                flush(k)
            else:
                walk(k)

    walk(tree.root)
    flush(tree.root)
    score, total, linked, nodes = {}, {}, {}, {}
    for b in found:
        for depth, x in enumerate(above(b["home"])):
            nodes[id(x)] = x
            total[id(x)], linked[id(x)] = total.get(id(x), 0) + len(b["text"]), linked.get(id(x), 0) + b["linked"]
            if len(b["text"]) >= 25 and depth < html.LEVELS:
                own = (1 - min(1, b["linked"] / len(b["text"]))) * (1 + b["text"].count(",") + min(len(b["text"]) / 100, 3)) / (depth + 1)
                score[id(x)] = score.get(id(x), 0) + own
    if not score:
        return None
    good = lambda x: 5 if html.WANTED.search(x["names"]) else 0
    value = lambda k: -1 if nodes[k]["tag"] in ("", "html") else (score[k] + (25 if nodes[k]["tag"] in ("article", "main") else 0) + good(nodes[k])) * (1 - linked[k] / max(1, total[k]))
    best = nodes[max(score, key=value)]
    best = next((x for x in above(best) if x["tag"] in ("article", "main")), best)
    top = value(id(best))
    if best["tag"] == "article":
        own = lambda k: score[k] * (1 - linked[k] / max(1, total[k]))
        beside = [best] + [nodes[k] for k in score if nodes[k]["up"] is best["up"] and nodes[k]["tag"] == "article" and own(k) >= 0.2 * own(id(best)) > 0]
        return "\n".join(b["text"] for b in found if any(x is y for x in above(b["home"]) for y in beside))
    if best["tag"] in ("main", "body", ""):
        return "\n".join(b["text"] for b in found if any(x is best for x in above(b["home"])))
    chosen = [best] + [nodes[k] for k in score if nodes[k]["up"] is best["up"] and nodes[k]["tag"] != "li" and value(k) >= 0.2 * top and top > 0]
    frame = best["up"]
    while total[id(frame)] == total[id(best)] and frame["up"] is not None and frame["up"]["tag"] not in ("", "html", "body"):
        frame = frame["up"]
    within = lambda b, x: any(y is x for y in above(b["home"]))
    return "\n".join(b["text"] for b in found if any(within(b, x) for x in chosen) or (within(b, frame) and (b["heading"] or b["linked"] < 0.25 * len(b["text"]))))


def test_main_text_against_a_parsed_tree():
    import random

    rng = random.Random(8)
    words = ["one", "word,", "more", "commas, here,", "and", "there", "it's", "a &amp; b"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 12, 40])))

    def inline():
        return text() if rng.random() < 0.7 else f"{text()} <a href='x'>{text()}</a> <b>{text()}</b>"

    def block(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return f"<p>{inline()}</p>"
        if kind < 0.5:
            return f"<h2>{text()}</h2>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        tag = rng.choice(["div", "div", "section", "aside", "nav", "article" if rng.random() < 0.2 else "div"])
        name = rng.choice(["", "", " class='content'", " class='sidebar'", " class='box'", " class='more'", " class='notice-bar'"])
        return f"<{tag}{name}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 5))) + (inline() if rng.random() < 0.2 else "") + f"</{tag}>"

    checked = 0
    for _ in range(400):
        page = "<html><body>" + "".join(block(4) for _ in range(rng.randint(1, 4))) + "</body></html>"
        want = plain_main_text(page)
        if want is not None:
            checked += 1
            assert html.main_text(page) == want
    assert checked > 300


def test_broken_and_very_long_pages():
    import time

    lost = "<article><p>one is here, it's fine</p><p title=it's>two is here</p><p>three, ok</p><p class='x'>four's here</p></article>"
    assert html.main_text(lost) == "one is here, it's fine\ntwo is here\nthree, ok\nfour's here"
    assert html.main_text('<article><p title="a > b" data-x=\'<p>\'>one</p><p title="unclosed>two</p></article>') == "one\ntwo"
    assert html.main_text("<main><p>1 < 2 and <3, but 4 > 3 <") == "1 < 2 and <3, but 4 > 3 <"
    prose = "words, and some more of them, so that this block counts"
    assert html.main_text(f"<div class='page-with-sidebar hidden-menu'><article><h1>T</h1><p>{prose}</p></article></div>") == f"T\n{prose}"
    assert html.main_text(f"<article><p>{prose}</p><div class='notice'>{prose}</div></article>") == prose
    for page in ("<a " * 350_000, '<a x="' * 170_000, "<div>" * 200_000, f"<div>{prose}" * 20_000, "<b>" * 100_000 + "</i>" * 200_000, "<" * 1_000_000, f"<p>{prose}" * 20_000, "<a" + " " * 1_000_000, "<ul><li>" * 100_000, "<i>x" * 200_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 15  # a second or two; quadratic work would take hours


def test_wrapped_and_divided_pages():
    """Wanted texts are written by hand, whatever the operator's lists are."""
    import time

    one, two = "The first paragraph, which is prose, goes on for a while and says some things.", "A second paragraph, as long, says other things about the same matter, calmly."
    form = f"<body><form id='aspnetForm'><div class='content'><h2>Title</h2><p>{one}</p><p>{two}</p></div><div class='footer'>(c) us</div></form></body>"
    assert html.main_text(form) == f"Title\n{one}\n{two}"
    assert html.main_text(f"<body><form action='q'>Search the site</form><div><p>{one}</p><p>{two}</p></div></body>") == f"{one}\n{two}"
    assert html.main_text(f"<body><div><article><p>{one}</p></article><article><p>{two}</p></article><article>Read on</article></div></body>") == f"{one}\n{two}"
    assert html.main_text("<form>Name Send</form>") == "Name Send" and html.main_text("<form></form>") == html.main_text("<p> </p>") == ""
    for page in ("<table><tr><td>x" * 60_000, "<div>x" * 150_000, f"<form><div>{one}" * 8_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 15


def test_clashing_names_of_pages_urls_pieces_and_vectors(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomkit.llm import neighbours, pieces, urls

    odd = {c: F.lit("x") for c in ("Text", "IDS", "RANK", "Score", "vec_ID", "Verdict", "LISTED", "a`b", "node")}
    rows = lambda df, names: sorted(map(repr, df.select(*names).collect()))
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>one</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    for run, df, names in (
        (html.extract, pages, ["page_id", "text"]),
        (lambda x: pieces.encode(x, "/opt/tokenizers/piece_bpe_32k.model", "html"), pages, ["page_id", "ids"]),
        (lambda x: urls.judge(x.withColumnRenamed("page_id", "capture_id").withColumn("fetched", F.lit(3)), spark.createDataFrame([(1, "a.b", 1, "block")], "entry_id long, key string, listed int, action string")), pages, ["capture_id", "verdict"]),
    ):
        out = run(df.withColumns({c: x for c, x in odd.items() if c != "a`b" or "verdict" not in names}))
        assert rows(out, names) == rows(run(df), names) and len({c.lower() for c in out.columns}) == len(out.columns)
        assert run(df.limit(0)).count() == 0
    vectors = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    own = odd.keys() - {"vec_ID", "a`b"}
    clash = vectors.withColumns({c: odd[c] for c in own})
    want = rows(neighbours.nearest(vectors, vectors.filter("vec_id < 3")), ["query_id", "rank", "vec_id"])
    assert rows(neighbours.nearest(clash, clash.filter("vec_id < 3")), ["query_id", "rank", "vec_id"]) == want
