"""Document fingerprints: chains of content words that follow common words, compared as sets, by DataFrame functions only."""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, stored
from .quality import STOP_WORDS

#: Content words of a chain, and the per cent of likeness from which two sets are near.
CHAIN, PER_CENT = 2, 75
#: Rows whose neighbours in the order of doc_id meet in a window, and the windows at the most.
RUN, RUNS = 256, 1 << 16
#: What joins an anchor to the word after it.
_ANCHOR = "\x01"
_WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def spots(text: Column, anchors: tuple[str, ...] = tuple(STOP_WORDS), chain: int = CHAIN) -> Column:
    """The distinct spot signatures of a text, array<string>, in ascending order.

    An anchor is a common word; its signature is eight digits of the MD5 of it and of the next `chain` words that are no
    anchors. Words are runs of letters, marks and digits in lower case. A text with words but without a whole chain has one signature,
    of all its words; a null or blank text has none.
    """
    # "the end of a long day": anchors are joined to the content word after them, so that each stretch that begins with
    # anchors and runs to the chain's end is found by one search, in which no word is read more than chain + 2 times
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _WORD_BREAK, " "))
    unit = f"(?:[^ {_ANCHOR}]++{_ANCHOR})"
    stretch = f"(?:^| )(?=({unit}++[^ {_ANCHOR}]++(?: {unit}*+[^ {_ANCHOR}]++){{{chain - 1}}}))"

    def signed(stretch: Column) -> Column:
        units = F.split(stretch, " ")
        content = F.array_join(F.transform(units, lambda u: F.substring_index(u, _ANCHOR, -1)), " ")
        before = F.split(F.get(units, F.lit(0)), _ANCHOR)
        return F.transform(F.slice(before, 1, F.size(before) - 1), lambda a: _signature(F.concat_ws(" ", a, content)))

    def found(plain: Column) -> Column:
        joined = F.regexp_replace(plain, f"(?<![^ ])({_any_of(anchors)})(?: |$)", f"$1{_ANCHOR}")
        own = F.flatten(F.transform(F.regexp_extract_all(joined, F.lit(stretch), F.lit(1)), signed))
        whole = F.when(plain != "", F.array(_signature(plain))).otherwise(F.array().cast("array<string>"))
        return _let(own, lambda x: F.when(F.size(x) > 0, F.sort_array(F.array_distinct(x))).otherwise(whole))

    return _let(plain, found)


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern of the words, those that begin with the same letter together."""
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in group)})" for c, group in groupby(sorted(words), key=lambda w: w[0]))


def _signature(words: Column) -> Column:
    return F.substring(F.md5(words), 1, 8)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(spots: Column) -> Column:
    """A set as a string: its signatures in the set's order, 8 hexadecimal digits each."""
    return F.array_join(spots, "")


def bound(a: Column, b: Column) -> Column:
    """The most that sets of sizes a and b can be alike."""
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """The likeness of two sets; 0 without looking at them where their sizes rule `least` out. Two empty sets are alike: 1."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    exact = _let(common.cast("double"), lambda c: c / (n + m - c))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (bound(n, m) < least), 0.0).otherwise(exact)


def length_partition(size: Column, per_cent: int = PER_CENT) -> Column:
    """The partition of a set's size: each begins at the least size that `per_cent` of sets of the one before can't reach.

    So sets that are near lie in one partition or in two that follow each other. 0 is that of empty sets.
    """
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / per_cent)) + 1e-9) + 1).otherwise(0).cast("int")


def near_pairs(sets: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """(a, b, likeness) of the distinct sets that are near, by their names; sets: name long, spots array<string>, one row each.

    Signatures are ordered by how many sets hold them, rarest first. Two near sets share one of their rarest
    size - ceil(size * per_cent / 100) + 1 signatures, so only these are dealt, by partition of length and signature, and
    to the next partition, where larger sets look for smaller ones. A pair meets at the first signature that both deal;
    it is compared if its sizes and what is left behind the places of that signature allow per_cent. Empty and null sets are near nothing.
    """
    sets = sets.select("name", "spots", F.size("spots").alias("n")).filter("n > 0")
    each = sets.select("name", "n", F.explode("spots").alias("s"))
    held = each.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("name").orderBy("df", "s")
    dealt = each.join(held, "s").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1)
    dealt = stored(dealt.select("name", "n", "s", "place", length_partition(F.col("n"), per_cent).alias("p")), "spots")
    side = lambda x, p: dealt.select("s", p.alias("p"), *[F.col(c).alias(f"{x}_{c}") for c in ("name", "n", "place")])
    p = F.col("p")
    smaller = F.explode(F.array(p, p + 1))
    both = side("a", smaller).join(side("b", p), ["s", "p"])
    first = F.struct("a_n", "a_name") < F.struct("b_n", "b_name")
    left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) + 1
    # a pair shares `common` signatures at least up to here; what lies behind can add min(rest) at the most
    possible = (100 * F.col("a_n") >= per_cent * F.col("b_n")) & ((100 + per_cent) * (left + F.least("a_place", "b_place") - 1) >= per_cent * (F.col("a_n") + F.col("b_n")))
    pairs = both.filter(first & possible).select("a_name", "b_name").distinct()
    of = lambda x: sets.select(F.col("name").alias(f"{x}_name"), F.col("spots").alias(f"{x}_spots"))
    alike = pairs.join(of("a"), "a_name").join(of("b"), "b_name").withColumn("likeness", jaccard(F.col("a_spots"), F.col("b_spots"), per_cent / 100))
    near = F.size(F.array_intersect("a_spots", "b_spots")) * (100 + per_cent) >= per_cent * (F.size("a_spots") + F.size("b_spots"))
    return alike.filter(near).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "likeness")


def with_next(docs: DataFrame, key: str, columns: list[str], use) -> DataFrame:
    """use(docs with next_<c> of each column: the row's that follows by descending key), after the last the first's.

    Rows are dealt by key into runs of about RUN rows between keys that quantiles name. The row at a run's lower end goes
    to the run below as well, before all others; there it finds its successor, and in its own run it only is one. So
    each row is shuffled once, but for one of each run. A null key counts as the smallest; rows that repeat a key go by
    their columns' hash. use may ask for next_ columns that it makes, by later(name).
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    facts = docs.agg(F.count("*").alias("n"), F.min(order).alias("least")).first()
    runs = max(1, min(RUNS, facts["n"] // RUN))
    cuts = docs.agg(F.percentile_approx(order, [k / runs for k in range(1, runs)], max(10_000, 20 * runs))).first()[0] if runs > 1 else []
    cuts = sorted({facts["least"] or 0, *(cuts or [])})
    side = max(1, round(len(cuts) ** 0.5))
    tables = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    up_to = lambda a, x: F.size(F.filter(a, lambda c: c <= x))
    row = docs.withColumns({"_key": order, "_tie": F.xxhash64(*columns), "_cuts": F.from_json(F.lit(json.dumps(tables)), "array<array<bigint>>")})
    row = row.withColumn("_part", F.greatest(up_to(F.transform("_cuts", lambda t: t[0]), F.col("_key")), F.lit(1)))
    row = row.withColumn("_own", F.element_at("_cuts", F.col("_part")))
    row = row.withColumn("_in", up_to(F.col("_own"), F.col("_key")))
    run = (F.col("_part") - 1) * side + F.col("_in")
    lowest = F.element_at("_own", F.greatest(F.col("_in"), F.lit(1))) == F.col("_key")
    copy = lambda run, guest: F.struct(run.cast("int").alias("run"), F.lit(guest).alias("guest"))
    below = F.when(run == 1, F.lit(len(cuts))).otherwise(run - 1)
    copies = F.when(lowest, F.array(copy(run, False), copy(below, True))).otherwise(F.array(copy(run, False)))
    dealt = row.select(*docs.columns, "_key", "_tie", lowest.alias("_low"), F.explode(copies).alias("_copy")).select(*docs.columns, "_key", "_tie", "_low", "_copy.*")
    over = Window.partitionBy("run").orderBy(F.desc("guest"), F.desc("_key"), "_tie")
    later = lambda name: F.lead(name).over(over)
    out = use(dealt.withColumns({f"next_{c}": later(c) for c in columns}), later)
    return out.filter(F.col("guest") | ~F.col("_low")).drop("_key", "_tie", "_low", "run", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with spots, fingerprint and length_partition of each text; columns so named are replaced.

    docs: text string (null: empty) and others. Equal texts have equal fingerprints; a blank text's is "".
    """
    out = docs.select(*others(docs, "spots", "fingerprint", "length_partition")).withColumn("spots", spots(F.col("text")))
    return out.withColumns({"fingerprint": fingerprint(F.col("spots")), "length_partition": length_partition(F.size("spots"))})


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots, length_partition) of every row.

    docs: doc_id long, text string (null: empty). A text is edited by putting the next document's beginning, as long as
    its own second half or all of it, in the place of that half; next is by descending doc_id, a null one last, after
    the last comes the first. near_edited and near_next are likenesses of the text's set to the edited text's and to the
    next document's. A table of one row has itself as next; rows repeated whole follow each other; other columns are
    not returned.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def use(rows: DataFrame, later) -> DataFrame:
        half = F.floor(F.length("text") / 2).cast("int")
        whole = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
        rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "edited": whole})
        rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), spots(F.col("text")).alias("spots"), spots(F.col("edited")).alias("_edited"), "_key", "_tie", "_low", "run", "guest")
        rows = rows.withColumn("_next", later("spots"))
        return rows.withColumns({"near_edited": jaccard(F.col("spots"), F.col("_edited")), "near_next": jaccard(F.col("spots"), F.col("_next"))})

    out = with_next(body, "doc_id", ["text"], use)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.size("spots").cast("long").alias("n_spots"), length_partition(F.size("spots")).alias("length_partition"),
    )
