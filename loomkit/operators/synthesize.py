"""New groups from old ones: sentences injected into others' groups, and groups packed together."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.config import LabelSet
from loomkit.functions.labels import hash01, refers_to_figure
from loomkit.operators.split import running_total
from loomkit.sources.store import forget

#: Rows of a matching block, and the tokens that give a row its shape.
BLOCK, HOT = 4096, 8


def donors(sentences: DataFrame, classes: list[str]) -> DataFrame:
    """Sentences with one gold label, of the given classes, that don't refer to a figure or table."""
    return sentences.filter((F.size("types") == 1) & F.get("types", F.lit(0)).isin(*classes) & ~refers_to_figure(F.col("sentence")))


def anchors(sentences: DataFrame, labels: LabelSet, classes: list[str], least: int) -> DataFrame:
    """(id, n): groups of `least` sentences and more with one minority sentence alone, single-labelled, of the classes."""
    minority = F.exists("types", lambda t: t != labels.default)
    fit = minority & (F.size("types") == 1) & F.get("types", F.lit(0)).isin(*classes)
    by = sentences.groupBy("id").agg(F.count("*").alias("n"), F.count_if(minority).alias("_m"), F.count_if(fit).alias("_f"))
    return by.filter((F.col("n") >= least) & (F.col("_m") == 1) & (F.col("_f") == 1)).select("id", "n")


def match(donor: DataFrame, anchor: DataFrame, store, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(donor_id, anchor_id): a maximal one-to-one matching of other domain, disjoint nouns and other group.

    donor: donor_id, id, domain, nouns; anchor: id, domain, nouns. A pair fits if it has no token in common: its nouns,
    its domain and its group are tokens, as 64-bit hashes. A null in id, domain or nouns fits nothing; of rows that repeat a
    donor_id or an anchor's id one counts. In each round the HOT tokens that most of both sides hold give every row a
    shape, which of them it has, and two small tables of counts tell how many rows of the other side each shape leaves:

    1. Rows whose shape fits no shape of the other side can never be matched and go.
    2. A plan of whole numbers gives the rows of each shape to shapes that fit, the most constrained first, and rows are
       dealt by hash into blocks of the plan's pairs of shapes. In a block every donor takes the first free anchor that
       fits. So a round is linear in the rows, and what the hot tokens forbid never meets.
    3. Once a round matches few and drops none, every two blocks of shapes that fit meet in one job; donors propose, an
       anchor takes one. When no donor has a proposal, no pair that fits is left, and that ends it.

    Only step 3 looks at pairs of blocks, of the rows that hot tokens can't rule out; its rounds count the tokens anew.
    """
    kinds = (donor.schema["donor_id"].dataType.simpleString(), anchor.schema["id"].dataType.simpleString())
    side = lambda df, name: df.dropna(subset=["id", "domain", "nouns", name]).select(F.col(name).alias("name"), _tokens().alias("tokens")).groupBy("name").agg(F.min("tokens").alias("tokens"))
    left, right = store(side(donor, "donor_id"), "donors"), store(side(anchor, "id"), "anchors")
    found, whole = [], False
    while True:
        salt = seed + 1000 * len(found)
        hot = _hot_tokens(left, right)
        left, right = (x.withColumn("shape", _shape(hot)) for x in (left, right))
        nl, nr = ({r["shape"]: r["count"] for r in x.groupBy("shape").count().collect()} for x in (left, right))  # 2 ** HOT rows at most
        before = sum(nl.values()) + sum(nr.values())
        nl, nr = {x: n for x, n in nl.items() if any(not x & y for y in nr)}, {y: n for y, n in nr.items() if any(not x & y for x in nl)}
        if not nl or not nr:
            break
        left, right = left.filter(F.col("shape").isin(*nl)), right.filter(F.col("shape").isin(*nr))
        dropped = before - sum(nl.values()) - sum(nr.values())
        pairs = store(_meet(left, right, nl, nr, block, salt, kinds) if whole else _deal(left, right, nl, nr, block, salt, kinds), "pairs")
        n = pairs.count()
        if n:
            found.append(pairs)
        elif whole:
            break
        whole = whole or (not dropped and 16 * n < min(sum(nl.values()), sum(nr.values())))
        left = store(left.join(pairs.select(F.col("donor_id").alias("name")), "name", "left_anti").select("name", "tokens"), "donors")
        right = store(right.join(pairs.select(F.col("anchor_id").alias("name")), "name", "left_anti").select("name", "tokens"), "anchors")
    empty = donor.sparkSession.createDataFrame([], f"donor_id {kinds[0]}, anchor_id {kinds[1]}")
    return reduce(DataFrame.unionByName, found) if found else empty


def _tokens() -> Column:
    """What a row must not share with its partner, as hashes."""
    nouns = F.transform(F.filter("nouns", lambda x: x.isNotNull()), lambda x: F.xxhash64(F.lit("noun"), x))
    return F.array_distinct(F.concat(nouns, F.array(F.xxhash64(F.lit("domain"), F.col("domain").cast("string")), F.xxhash64(F.lit("group"), F.col("id").cast("string")))))


def _hot_tokens(left: DataFrame, right: DataFrame) -> list[int]:
    """The HOT tokens with most pairs of rows that share them."""
    count = lambda x, name: x.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias(name))
    both = count(left, "l").join(count(right, "r"), "t").withColumn("pairs", F.col("l").cast("double") * F.col("r"))
    return [r.t for r in both.orderBy(F.desc("pairs"), "t").limit(HOT).collect()]


def _shape(hot: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.array_contains("tokens", F.lit(t)), 1 << k).otherwise(0) for k, t in enumerate(hot)], F.lit(0)).cast("int")


def _plan(nl: dict[int, int], nr: dict[int, int]) -> list[tuple[int, int, int]]:
    """(left shape, right shape, rows of each): shapes that fit, those with the fewest partners first."""
    room = {x: sum(n for y, n in nr.items() if not x & y) for x in nl}
    left_for = {y: sum(n for x, n in nl.items() if not x & y) for y in nr}
    rest, out = dict(nr), []
    for x in sorted(nl, key=lambda x: (room[x], x)):
        n = nl[x]
        for y in sorted((y for y in nr if not x & y and rest[y]), key=lambda y: (left_for[y], y)):
            if not n:
                break
            m = min(n, rest[y])
            out.append((x, y, m))
            n, rest[y] = n - m, rest[y] - m
    return out


def _deal(left: DataFrame, right: DataFrame, nl: dict[int, int], nr: dict[int, int], block: int, salt: int, kinds: tuple[str, str]) -> DataFrame:
    """Pairs of the blocks that the plan names; a row falls into one by its hash, or into none."""
    plan, used = _plan(nl, nr), [dict.fromkeys(nl, 0), dict.fromkeys(nr, 0)]
    lots: tuple[list, list] = ([], [])
    for lot, (x, y, m) in enumerate(plan):
        for k, (shape, total) in enumerate(((x, nl[x]), (y, nr[y]))):
            a = used[k][shape]
            used[k][shape] = a + m
            lots[k].append((shape, a / total, (a + m) / total, lot, -(-m // block)))

    def dealt(df: DataFrame, k: int) -> DataFrame:
        table = df.sparkSession.createDataFrame(lots[k], "shape int, low double, high double, lot int, parts int")  # 2 ** (HOT + 1) rows at most
        at = hash01(salt + 2 * k, "name")
        rows = df.withColumn("_at", at).join(F.broadcast(table), "shape").filter((F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high")))
        return rows.select("name", "tokens", F.col("lot").alias("_lot"), F.pmod(F.xxhash64(F.lit(salt + 2 * k + 1), "name"), "parts").alias("_part"))

    return dealt(left, 0).groupBy("_lot", "_part").cogroup(dealt(right, 1).groupBy("_lot", "_part")).applyInPandas(_greedy, f"donor_id {kinds[0]}, anchor_id {kinds[1]}")


def _meet(left: DataFrame, right: DataFrame, nl: dict[int, int], nr: dict[int, int], block: int, salt: int, kinds: tuple[str, str]) -> DataFrame:
    """Pairs from all blocks of shapes that fit: proposals of every two blocks, of which each donor keeps one and each anchor takes one."""
    parts = [{x: -(-n // block) for x, n in own.items()} for own in (nl, nr)]

    def dealt(df: DataFrame, k: int) -> DataFrame:
        own, other = parts[k], parts[1 - k]
        fits = [(x, own[x], y, p) for x in own for y in other if not x & y for p in range(other[y])]
        table = df.sparkSession.createDataFrame(fits, "shape int, parts int, _s int, _p int")
        rows = df.withColumn("_o", F.xxhash64(F.lit(salt + k), "name")).join(table, "shape")
        mine, theirs = F.struct("shape", F.pmod("_o", "parts").cast("int")), F.struct("_s", "_p")
        return rows.select("name", "tokens", (mine if k == 0 else theirs).cast("struct<s:int,p:int>").alias("_l"), (theirs if k == 0 else mine).cast("struct<s:int,p:int>").alias("_r"))

    asked = dealt(left, 0).groupBy("_l", "_r").cogroup(dealt(right, 1).groupBy("_l", "_r")).applyInPandas(_greedy, f"donor_id {kinds[0]}, anchor_id {kinds[1]}")
    draw = F.xxhash64(F.lit(salt + 2), "donor_id", "anchor_id")
    kept = asked.groupBy("donor_id").agg(F.min_by("anchor_id", draw).alias("anchor_id"))
    return kept.groupBy("anchor_id").agg(F.min_by("donor_id", draw).alias("donor_id")).select("donor_id", "anchor_id")


def _greedy(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Every donor of a block with the first free anchor of another that fits; sets of anchors are bits of a number."""
    left, right = left.sort_values("name"), right.sort_values("name")
    asked = {x for tokens in left["tokens"] for x in tokens.tolist()}
    names, holders = right["name"].tolist(), {}
    for k, tokens in enumerate(right["tokens"]):
        for x in asked.intersection(tokens.tolist()):
            holders[x] = holders.get(x, 0) | 1 << k
    out, free = {}, (1 << len(names)) - 1
    for donor, tokens in zip(left["name"].tolist(), left["tokens"], strict=True):
        bad = 0
        for x in tokens.tolist():
            bad |= holders.get(x, 0)
        if fit := free & ~bad:
            k = (fit & -fit).bit_length() - 1
            out[donor] = names[k]
            free ^= 1 << k
    return pd.DataFrame({"donor_id": list(out), "anchor_id": list(out.values())})


def inject(anchor: DataFrame, donor: DataFrame, pairs: DataFrame, place: Column) -> DataFrame:
    """The anchors with the donor's sentence put in after `place` sentences (from 1 to all of them).

    anchor: id, sentences array<struct<sentence, types>>, evidence array; donor: donor_id, sentence, label, evidence.
    """
    a = anchor.withColumnRenamed("id", "anchor_id")
    d = donor.select("donor_id", "sentence", "label", F.col("evidence").alias("_e"))
    both = pairs.join(a, "anchor_id").join(d, "donor_id")
    new = F.array(F.struct(F.col("sentence").alias("sentence"), F.array("label").alias("types")))
    both = both.withColumn("_at", F.greatest(F.lit(1), F.least(place.cast("int"), F.size("sentences"))))
    merged = F.concat(F.slice("sentences", F.lit(1), F.col("_at")), new, F.slice("sentences", F.col("_at") + 1, F.size("sentences")))
    return both.select(
        "anchor_id", "donor_id", merged.alias("sentences"),
        F.array_join(F.transform(merged, lambda s: s["sentence"]), " ").alias("claim_text"), F.concat("evidence", "_e").alias("evidence"),
    )


def pack_all(groups: DataFrame, store, seed: int = 0, block: int = BLOCK, minorities: int = 2, target: int = 12, most: int = 16, figures: int = 4) -> DataFrame:
    """(synthetic, position, id): groups with minority labels packed into longer ones, until no two that fit are left.

    groups: id, n, minority, stems array<string> (null: none). A pack has two groups and more, `minorities` labels at
    least, `most` sentences and `figures` stems at most; its densest group comes first and it is closed at `minorities`
    labels and `target` sentences. Groups beyond these limits, without minority or with a null there are in no pack; of
    rows that repeat an id one counts.

    Two groups fit if their sentences do and, for the k stems they share, the stems beside those do. So groups meet by
    the sets of k of their stems, first for the largest k, at last all for k = 0. What counts within such a set is a
    group's shape: its further stems, its sentences, its labels. A set's shapes, counted, give a plan of packs as shapes
    and times, and groups are dealt to the plan's places by their rank within set and shape. No groups are compared with
    each other, and no task holds the groups of a large set. Rounds for each k:

    1. Every group goes to one of its sets, the one of least hash, large sets are cut into parts of about `block` groups,
       and the plans are carried out; again by another hash as long as a round packs half of those that could meet.
    2. Every group goes to all its sets. It keeps one of the packs that ask for it, a pack stands if all its groups keep
       it, and the others ask again, until no set has a plan.

    With more than two `minorities` asked for, packs of three and more groups may be missed.
    """
    stems = F.array_sort(F.array_distinct(F.coalesce("stems", F.array().cast("array<string>"))))
    able = groups.select("id", "n", "minority", stems.alias("stems")).filter(F.col("id").isNotNull() & (F.col("minority") > 0) & (F.col("n") <= most) & (F.size("stems") <= figures))
    able = able.groupBy("id").agg(F.min(F.struct("n", "minority", "stems")).alias("g")).select("id", "g.*")
    left, found = store(able, "groups"), []
    for shared in range(figures, -1, -1):
        whole = shared == 0
        while True:
            salt = seed + len(found)
            keyed = store(_keyed(left, shared) if whole else _one_key(_keyed(left, shared), salt, block), "keyed")
            packs = _planned(keyed, store, salt, f"{shared}-{len(found)}", figures - shared, minorities, target, most, bounded=not whole)
            if packs is None and whole:
                break
            if packs is not None:
                found.append(store(_agreed(packs, salt) if whole and shared else packs.select("synthetic", "position", "id"), "packs"))
                left, before = store(left.join(found[-1], "id", "left_anti"), "groups"), left
                forget(before)
            if shared == 0:
                break
            whole = whole or packs is None or 2 * found[-1].count() < keyed.count()
            forget(keyed)
    kind = groups.schema["id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, found) if found else groups.sparkSession.createDataFrame([], f"synthetic string, position int, id {kind}")


def _one_key(keyed: DataFrame, salt: int, block: int) -> DataFrame:
    """keyed with one key for each id, and keys of many groups cut into parts."""
    one = keyed.groupBy("id").agg(F.min_by(F.struct("key", "c", "n", "m"), F.xxhash64(F.lit(salt), "key")).alias("k")).select("id", "k.*")
    parts = one.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key", F.ceil(F.col("_n") / block).alias("_parts"))
    part = F.pmod(F.xxhash64(F.lit(salt), "id"), "_parts").cast("string")
    return one.join(parts, "key").select("id", F.concat("key", F.array(part)).alias("key"), "c", "n", "m")


def _keyed(groups: DataFrame, shared: int) -> DataFrame:
    """(id, key, c, n, m): every group once for each set of `shared` of its stems, with its shape there; sets of one group are left out."""
    masks = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("stems")) - 1), lambda k: F.bit_count(k) == shared)
    sets = F.transform(masks, lambda k: F.filter("stems", lambda x, i: F.getbit(k, i) == 1))
    keyed = groups.filter(F.size("stems") >= shared).select("id", F.explode(sets).alias("key"), (F.size("stems") - shared).alias("c"), "n", F.col("minority").alias("m"))
    if shared == 0:
        return keyed
    several = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    return keyed.join(several, "key", "left_semi").select("id", "key", "c", "n", "m")


def _planned(keyed: DataFrame, store, salt: int, name: str, room: int, minorities: int, target: int, most: int, bounded: bool) -> DataFrame | None:
    """(synthetic, position, id, size) of the packs that the sets' plans name; None if no set has a plan. bounded: a set's groups fit one task."""
    shape = ["key", "c", "n", "m"]

    def run(parts):
        for rows in parts:
            out = [(key, *r) for key, shapes in zip(rows["key"], rows["shapes"], strict=True) for r in _recipes([(x["c"], x["n"], x["m"], x["k"]) for x in shapes], room, minorities, target, most)]
            yield pd.DataFrame(out, columns=[*shape, "recipe", "position", "size", "start", "times"])

    counts = keyed.groupBy(*shape).agg(F.count("*").alias("k"))
    shapes = counts.groupBy("key").agg(F.collect_list(F.struct("c", "n", "m", "k")).alias("shapes"), F.sum("k").alias("all")).filter(F.col("all") > 1)
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    plan = store(shapes.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in shape), "recipe int, position int, size int, start long, times long"])), "plans")
    if plan.isEmpty():
        return None
    asked, draw = keyed.join(plan.select(*shape).distinct(), shape, "left_semi"), hash01(salt, "id")
    if bounded:
        ranked = asked.withColumn("before", F.row_number().over(Window.partitionBy(*shape).orderBy(draw, "id")) - 1)
    else:
        ranked = running_total(asked, draw, F.lit(1), store, tuple(shape))
    at = F.col("before") - F.col("start")
    placed = ranked.join(plan, shape).filter((at >= 0) & (at < F.col("times")))
    synthetic = F.concat_ws("-", F.lit(name), F.lower(F.hex(F.xxhash64("key"))), F.col("recipe").cast("string"), at.cast("string"))
    return placed.select(synthetic.alias("synthetic"), "position", "id", "size")


def _recipes(shapes: list[tuple[int, int, int, int]], room: int, minorities: int, target: int, most: int) -> list[tuple]:
    """(c, n, m, recipe, position, size, start, times): which ranks of each shape (c, n, m, count) go to which place of which recipe.

    The densest shape left begins a recipe, the densest that fits follows; a recipe is used as often as its shapes last.
    """
    free = {(c, n, m): k for c, n, m, k in shapes}
    used, out, recipe = dict.fromkeys(free, 0), [], 0
    order = sorted(free, key=lambda x: (-x[2], -x[1], x[0]))
    for seed in order:
        while free[seed]:
            chosen, (c, n, m) = [seed], seed
            while not (m >= minorities and n >= target):
                fit = next((x for x in order if free[x] > chosen.count(x) and n + x[1] <= most and c + x[0] <= room), None)
                if fit is None:
                    break
                chosen.append(fit)
                c, n, m = c + fit[0], n + fit[1], m + fit[2]
            if len(chosen) < 2 or m < minorities or c > room:
                break
            times = min(free[x] // chosen.count(x) for x in chosen)
            for position, x in enumerate(chosen):
                out.append((*x, recipe, position, len(chosen), used[x], times))
                used[x] += times
                free[x] -= times
            recipe += 1
    return out


def _agreed(packs: DataFrame, salt: int) -> DataFrame:
    """The packs that all their groups keep, of those that ask for them: the one of least hash."""
    own = F.struct(F.xxhash64(F.lit(salt), "synthetic").alias("h"), F.col("synthetic").alias("s"))
    kept = packs.groupBy("id").agg(F.min(own).alias("o"), F.min_by(F.struct("position", "size"), own).alias("p")).select("id", F.col("o.s").alias("synthetic"), "p.*")
    whole = kept.groupBy("synthetic").agg(F.count("*").alias("k"), F.max("size").alias("_all")).filter(F.col("k") == F.col("_all"))
    return kept.join(whole.select("synthetic"), "synthetic", "left_semi").select("synthetic", "position", "id")


def fitting_groups(groups: DataFrame, packed: DataFrame, most: int = 16, figures: int = 4, store=None) -> DataFrame:
    """(key, c, n): shapes of groups in no pack that still fit another such group, by the stems they share; empty after pack_all().

    Counted from shapes: of two different ones that fit each is named, of one that fits itself only if two groups have it.
    With `store` what is in no pack is found once, not for each number of shared stems.
    """
    left = groups.join(packed, "id", "left_anti").filter((F.col("minority") > 0) & (F.col("n") <= most) & (F.size("stems") <= figures)).select("id", "n", "minority", "stems")
    left, out = store(left, "left") if store else left, []
    for shared in range(figures + 1):
        shapes = _keyed(left, shared).groupBy("key", "c", "n").agg(F.count("*").alias("k"))
        other = shapes.select("key", F.col("c").alias("_c"), F.col("n").alias("_n"))
        both = shapes.join(other, "key").filter((F.col("c") + F.col("_c") <= figures - shared) & (F.col("n") + F.col("_n") <= most))
        out.append(both.filter((F.col("k") > 1) | (F.col("c") != F.col("_c")) | (F.col("n") != F.col("_n"))).select("key", "c", "n").distinct())
    return reduce(DataFrame.unionByName, out)


def fitting_donors(donor: DataFrame, anchor: DataFrame, pairs: DataFrame, store) -> DataFrame:
    """(tokens, donors, anchors): donors in no pair, by their tokens, and how many anchors in no pair still fit them; empty after match().

    An inverted index has a bitmap of the anchors with each token, 32,768 to a bitmap; what a donor's bitmaps leave
    together are the anchors that fit it.
    """
    side = lambda df, name, free: df.dropna(subset=["id", "domain", "nouns", name]).join(free, name, "left_anti").select(F.col(name).alias("id"), _tokens().alias("tokens"))
    left = side(donor, "donor_id", pairs.select("donor_id")).groupBy("tokens").agg(F.count("*").alias("donors"))
    right = side(anchor, "id", pairs.select(F.col("anchor_id").alias("id")))
    numbered = running_total(right, hash01(0, "id"), F.lit(1), store).select("tokens", F.expr("bitmap_bucket_number(before)").alias("bucket"), F.expr("bitmap_bit_position(before)").alias("bit"))
    numbered = store(numbered, "anchors")
    index = numbered.select(F.explode("tokens").alias("t"), "bucket", "bit").groupBy("t", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("held"))
    total = numbered.agg(F.count("*").alias("anchors"))
    met = left.select("tokens", F.explode("tokens").alias("t")).join(index, "t").groupBy("tokens", "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(held))").alias("barred"))
    barred = met.groupBy("tokens").agg(F.sum("barred").alias("barred"))
    return left.join(barred, "tokens", "left").crossJoin(total).withColumn("anchors", F.col("anchors") - F.coalesce("barred", F.lit(0))).filter("anchors > 0").drop("barred")


def joined_records(packed: DataFrame, records: DataFrame) -> DataFrame:
    """The packs as records: sentences in order, claims joined, evidence once for each path (the first)."""
    rows = packed.join(records, "id")
    by = rows.groupBy("synthetic").agg(F.sort_array(F.collect_list(F.struct("position", "claim_text", "sentences", "evidence"))).alias("_r"))
    evidence = F.flatten(F.transform("_r", lambda r: r["evidence"]))
    first = F.filter(evidence, lambda e, i: (e["img_path"] != "") & ~F.exists(F.slice(evidence, F.lit(1), i), lambda x: x["img_path"] == e["img_path"]))
    return by.select("synthetic", F.array_join(F.transform("_r", lambda r: r["claim_text"]), " ").alias("claim_text"), F.flatten(F.transform("_r", lambda r: r["sentences"])).alias("sentences"), first.alias("evidence"))
