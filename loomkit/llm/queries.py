"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, kneser, near, neighbours, packing, phrases, pieces, quality, repeats, search, spots, tokenfile, urls
from .common import table
from .tokens import public_path

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )  # fmt: skip


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(docs).select("doc_id", *counts, "base_failed", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return packing.pack(docs, public_path(TOKENIZER))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, with days drawn from page_id; every third page also yields a dated list entry."""
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", (F.col("page_id") * 37 % 360).cast("int").alias("fetched"))
    own, part = urls.host(F.col("url")), F.regexp_extract("url", urls.PATH, 1)
    kind = F.col("page_id") % 4
    key = F.when(kind == 0, own).when(kind == 1, F.concat_ws("/", own, part)).otherwise(F.regexp_replace(own, r"^[^.]*\.", ""))
    action = F.element_at(F.array(F.lit(urls.BLOCK), F.lit(urls.ALLOW), F.lit(urls.WITHDRAW)), (F.col("page_id") * 7 % 11 % 3 + 1).cast("int"))
    entries = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("entry_id"), key.alias("key"), (F.col("page_id") * 13 % 360).cast("int").alias("listed"), action.alias("action"))
    return urls.judge(captures, entries).select(F.col("capture_id").alias("page_id"), "fetched", "key", "listed", "verdict")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumn("own", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = pieces.encode(docs, public_path(PIECES)).withColumns({"n_tokens": (F.length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")})
    back = pieces.decode(ids, public_path(PIECES))
    return back.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), (F.sha2("text", 256) == F.col("own")).alias("round_trip"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, public_path(TOKENIZER))).drop("ids")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kneser.held_out(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return kneser.score(docs, kneser.train(docs.filter("not held_out"))).drop("perplexity")


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", ["lang", "text"]))


QUERIES = {
    "op1_repeated_strings": op1_repeated_strings,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_url_lists": op4_url_lists,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_html_extraction": op6_html_extraction,
    "op7_pieces": op7_pieces,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_token_files": op9_token_files,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_spot_signatures": op11_spot_signatures,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}


def _passes(rule: quality.Rule) -> str:
    scale, unit = ("", "1") if rule.bottom is None else ("100 * ", rule.bottom)
    parts = [f"{scale}{rule.top} >= {rule.low} * {unit}"] * (rule.low is not None) + [f"{scale}{rule.top} <= {rule.high} * {unit}"] * (rule.high is not None)
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_ALPHABET.upper()}', '{_ALPHABET}')"


def _terms(column: str) -> str:
    return rf"regexp_extract_all({_lower(column)}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d CROSS JOIN range(0, 3) t(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, len(ls) AS n_lines, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
    len(list_filter(ws, lambda x: lower(x) <> x AND upper(x) = x AND length(x) > 1)) AS n_upper_words, len(list_filter(ws, lambda x: suffix(x, '!!'))) AS n_exclaimed,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({" AND ".join(map(_passes, quality.BASE_RULES))}) AS base_failed,
  {" AND ".join(map(_passes, (*quality.BASE_RULES, *quality.RULES)))} AS kept FROM m
""",
    "op4_url_lists": """
WITH p AS (
  SELECT page_id, url, CAST(page_id * 37 % 360 AS int) AS fetched,
    regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host,
    regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS part
  FROM pages),
e AS (
  SELECT page_id AS entry_id, CAST(page_id * 13 % 360 AS int) AS listed,
    CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN concat_ws('/', host, part) ELSE regexp_replace(host, '^[^.]*\\.', '') END AS key,
    CASE page_id * 7 % 11 % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'withdraw' END AS action
  FROM p WHERE page_id % 3 = 0),
l AS (SELECT page_id, fetched, host, part, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (
  SELECT page_id, fetched, host || '/' || part AS key, 1000 AS rank FROM l WHERE part <> ''
  UNION ALL
  SELECT page_id, fetched, array_to_string(labels[i:len(labels)], '.') AS key, len(labels) - i + 1 AS rank
  FROM (SELECT *, unnest(range(1, greatest(len(labels), 2))) AS i FROM l)),
a AS (
  SELECT k.page_id, k.rank, k.key, e.listed, e.action,
    row_number() OVER (PARTITION BY k.page_id, k.key ORDER BY e.listed DESC, e.entry_id DESC) AS n
  FROM k JOIN e ON k.key = e.key AND e.listed <= k.fetched),
b AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, key DESC) AS m
  FROM a WHERE n = 1 AND action <> 'withdraw')
SELECT p.page_id, p.fetched, b.key, b.listed, coalesce(b.action, 'none') AS verdict
FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.m = 1
""",
    "op11_spot_signatures": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
e AS (SELECT o.*, substr(o.text, 1, o.n_chars - o.n_chars // 2) || substr(x.text, 1, o.n_chars // 2) AS edited FROM o JOIN d x ON x.doc_id = o.next_id),
t AS (
  SELECT doc_id, side, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, 'own' AS side, text AS body FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e)),
w AS (SELECT doc_id, side, word, i, word IN ({_STOP}) AS anchor FROM (SELECT doc_id, side, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t)),
m AS (SELECT *, sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, side ORDER BY i) AS c FROM w),
s AS (
  SELECT DISTINCT a.doc_id, a.side, substr(md5(a.word || ' ' || x.word || ' ' || y.word), 1, 8) AS spot
  FROM m a JOIN m x ON x.doc_id = a.doc_id AND x.side = a.side AND NOT x.anchor AND x.c = a.c + 1 JOIN m y ON y.doc_id = a.doc_id AND y.side = a.side AND NOT y.anchor AND y.c = a.c + 2
  WHERE a.anchor),
l AS (SELECT doc_id, side, list(spot ORDER BY spot) AS spots FROM s GROUP BY doc_id, side),
f AS (
  SELECT t.doc_id, t.side, coalesce(l.spots, CASE WHEN len(ws) > 0 THEN [substr(md5(array_to_string(ws, ' ')), 1, 8)] ELSE [] END) AS spots
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id AND l.side = t.side),
p AS (
  SELECT e.doc_id, e.n_chars, e.edited, a.spots AS own, b.spots AS other, c.spots AS next,
    len(list_intersect(a.spots, b.spots)) AS with_edited, len(list_intersect(a.spots, c.spots)) AS with_next
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.side = 'own' JOIN f b ON b.doc_id = e.doc_id AND b.side = 'edited' JOIN f c ON c.doc_id = e.next_id AND c.side = 'own')
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
  CASE WHEN len(own) + len(other) = 0 THEN 1.0::double ELSE with_edited / (len(own) + len(other) - with_edited)::double END AS near_edited,
  CASE WHEN len(own) + len(next) = 0 THEN 1.0::double ELSE with_next / (len(own) + len(next) - with_next)::double END AS near_next,
  len(own) AS n_spots, CASE WHEN len(own) = 0 THEN 0 ELSE floor(ln(len(own)) / ln(100.0 / {spots.PER_CENT}) + 1e-9)::int + 1 END AS length_partition
FROM p
""",
    "op12_ranked_search": rf"""
WITH d AS (SELECT doc_id, {_terms("text")} AS ts FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
s AS (SELECT count(*) AS docs, sum(len(ts))::bigint AS total FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint AS w FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term) CROSS JOIN s),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(ts) * docs) // total) AS m FROM d CROSS JOIN s),
r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM o WHERE rank <= {search.TOP}
""",
    "op13_collocations": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, regexp_split_to_array({_lower("text")}, '[.,;:!?
-]') AS ps FROM documents),
p AS (SELECT id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::bigint AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws[i:i + size - 1] AS g FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w CROSS JOIN (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS size) WHERE len(ws) >= size)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= {phrases.LEAST}),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
x AS (
  SELECT DISTINCT lang, g[i:i + size - 1] AS g, a
  FROM (SELECT lang, g, a, size, unnest(range(1, len(g) - size + 2)) AS i FROM c CROSS JOIN (SELECT unnest(range(2, {phrases.LONGEST})) AS size) WHERE size < len(g))),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.g = c.g AND 100 * x.a >= 100 * c.a)),
u AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
v AS (
  SELECT u.lang, u.g, u.a, u.k, l.f AS l, r.f AS r, n.n, ((1000::hugeint * u.a * n.n) // (l.f::hugeint * r.f))::bigint AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.g = u.g[1:u.k] JOIN f r ON r.lang = u.lang AND r.g = u.g[u.k + 1:] JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, rank::int AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= {phrases.TOP}
""",
}
