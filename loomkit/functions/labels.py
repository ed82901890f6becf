"""Column builders for labels, groups and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomkit.config import LabelSet


def hash01(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(1 << 53)) / F.lit(float(1 << 53))


def rarest_label(types: Column, frequency: Column, default: str) -> Column:
    """Of several labels the one with the least count in a map of counts; ties go to the first, unknown ones count 0."""
    ranked = F.transform(types, lambda t, i: F.struct(F.coalesce(F.try_element_at(frequency, t), F.lit(0)).cast("long").alias("n"), i.alias("i"), t.alias("t")))
    return F.coalesce(F.array_min(ranked)["t"], F.lit(default))


def first_by_priority(types: Column, priority: tuple[str, ...], default: str) -> Column:
    """The first label of priority that types contains, else the default."""
    return F.coalesce(*[F.when(F.array_contains(types, p), F.lit(p)) for p in priority], F.lit(default))


def is_hard(sentences: Column, labels: LabelSet) -> Column:
    """Whether any sentence of a record has a gold label beside the default."""
    return F.exists(sentences, lambda s: F.exists(s["types"], lambda t: t != labels.default))


def evidence_bucket(evidence: Column) -> Column:
    """all-image, all-table or mixed; a missing type counts as image, no evidence as mixed."""
    kinds = F.array_distinct(F.transform(F.coalesce(evidence, F.array()), lambda e: F.coalesce(e["type"], F.lit("image"))))
    return F.when(F.size(kinds) != 1, "mixed").when(kinds[0] == "image", "all-image").when(kinds[0] == "table", "all-table").otherwise("mixed")


def length_bin(n: Column) -> Column:
    return F.when(n <= 5, "<=5").when(n <= 8, "6-8").otherwise(">=9")


def refers_to_figure(text: Column) -> Column:
    # fixed value: the pattern is the definition
    return text.rlike(r"(?iU)\b(?:Table|Figure|Fig|Tab)\.?\s*\d")


def proper_nouns(text: Column) -> Column:
    """Distinct capitalised words of three characters and more; letters of any script next to one are part of a word."""
    # fixed value: the pattern is the definition
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Za-z0-9\-]{2,}\b"), F.lit(0)))


def occurrences(text: Column, word: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def domain(text: Column, keywords: dict[str, list[str]], other: str = "other") -> Column:
    """The domain whose keywords occur most in the lower-cased text; the first of equals; `other` without a hit."""
    low = F.lower(text)
    scored = [F.struct(sum((occurrences(low, w) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise(other)


def stem(path: Column) -> Column:
    """A path's last part without its ending; null for an empty path."""
    return F.nullif(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(""))


def captions(item: Column, *fields: str) -> Column:
    """The first caption field that isn't empty, as one string. Fields hold a JSON array of strings or plain text."""
    def parsed(name: str) -> Column:
        raw = item[name]
        parts = F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        return F.nullif(F.trim(F.array_join(parts, " ")), F.lit(""))

    return F.coalesce(*[parsed(f) for f in fields], F.lit(""))


def variant_caption(item: Column, *fields: str) -> Column:
    """The first caption field of a variant that isn't empty, as one string: a list's parts joined, anything else as text; "" without one."""
    def read(name: str) -> Column:
        parts = F.try_variant_get(item, f"$.{name}", "array<string>")
        return F.nullif(F.trim(F.coalesce(F.array_join(parts, " "), F.try_variant_get(item, f"$.{name}", "string"))), F.lit(""))

    return F.coalesce(*[read(f) for f in fields], F.lit(""))


def length_range(n: Column, bins) -> Column:
    """The name of the bin (low, high) that holds n; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high in reversed(bins):
        out = F.when((n >= low) & (F.lit(high is None) | (n <= (high or 0))), f"[{low}+]" if high is None else f"[{low}-{high}]").otherwise(out)
    return out
