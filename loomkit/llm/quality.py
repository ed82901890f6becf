"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others

# Frequent words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not are this at from or have an "
    "le la les de des du et un une que qui dans en est pour pas sur avec au ce il elle "
    "der die das und ist von zu den mit ein eine nicht im auf für dem des sich "
    "el los las del y que es por con para una su se lo como más al no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= 100 * top / bottom <= high, as integers; an end that is None is open.

    bottom is None for plain counts, which are compared as they are.
    """

    name: str
    top: str
    bottom: str | None = None
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        scale = 1 if self.bottom is None else 100
        value, unit = F.col(self.top) * scale, F.lit(1) if self.bottom is None else F.col(self.bottom)
        ok = F.lit(True)
        if self.low is not None:
            ok &= value >= unit * self.low
        if self.high is not None:
            ok &= value <= unit * self.high
        return ok


#: What every document must meet before the other rules count.
BASE_RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
#: The threshold table. Per cent of bottom, or counts.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("stop_word_share", "n_stop_words", "n_words", low=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=60),
    Rule("shouted_words", "n_upper_words", "n_words", high=30),
    Rule("exclaimed_words", "n_exclaimed", "n_words", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)


COUNTS = (
    "n_words", "n_lines", "n_dup_lines", "n_stop_words", "n_upper_words", "n_exclaimed", "n_bullet_lines", "n_ellipsis_lines", "word_chars", "n_symbols", "n_repeat_words",
)


def _covered(words: Column, n: Column) -> tuple[Column, Column]:
    """(hash and place of each window of three words, sorted; what counts the words in windows found twice)."""
    m = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hashes = F.zip_with(pairs, F.slice(words, 3, m), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), F.col("windows")


def _repeated(windows: Column) -> Column:
    m = F.greatest(F.size(windows) - 1, F.lit(0))
    same = F.zip_with(F.slice(windows, 1, m), F.slice(windows, 2, m), lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b)
    return F.sort_array(F.filter(F.zip_with(windows, either, lambda w, f: F.when(f, w["i"])), lambda i: i.isNotNull()))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use, by built-in functions only.

    Null text has no words and no lines with a word. n_repeat_words compares windows of three words by a
    64-bit hash within one document (chance of a false match below 1e-10 for 50,000 words). Columns of docs
    with a count's name are replaced, all others kept, whatever their names.
    """
    body = F.coalesce(F.col("_row").getField(text), F.lit(""))
    split = docs.select(F.struct(*docs.columns).alias("_row")).withColumns({
        "_words": F.filter(F.split(body, "[ \\t-\\r]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
    })
    words, lines = F.col("_words"), F.col("_lines")
    n = F.size(words)
    counted = split.withColumns({
        "_windows": _covered(words, n)[0],
        "_joined": F.array_join(words, ""),
        "n_words": n.cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_upper_words": F.size(F.filter(words, lambda w: (F.lower(w) != w) & (F.upper(w) == w) & (F.length(w) > 1))).cast("long"),
        "n_exclaimed": F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!!")))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike("^\\s*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("long"),
    })
    placed = counted.withColumn("_places", _repeated(F.col("_windows")))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    joined = F.col("_joined")
    measured = placed.withColumns({
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": (F.length(joined) - F.length(F.translate(joined, "#*$%&|<>", ""))).cast("long"),
        "n_repeat_words": F.aggregate("_places", start, step, lambda acc: acc["n"]).cast("long"),
    })
    return measured.select(*[F.col("_row").getField(c).alias(c) for c in others(docs, *COUNTS)], *COUNTS)


def judge(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """docs with counts, base_failed, kept and failed_rules (names, in the tables' order).

    Nulls and empty texts have no words and fail the base; repeated rows get the same verdict each. Columns of docs
    named like a count or a verdict are replaced.
    """
    every = lambda some: reduce(Column.__and__, [r.passes() for r in some], F.lit(True))
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    out = measure(docs.select(*others(docs, "base_failed", "kept", "failed_rules")), text)
    return out.withColumns({"base_failed": ~every(base), "kept": every((*base, *rules)), "failed_rules": failed})


def passing(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """The rows of docs that every rule passes, with their own columns.

    The verdict drops rows by a generator that gives nothing for a failed one: a plain filter would be pushed below
    the projections, with every count worked out anew for each rule that names it.
    """
    row = F.struct(*docs.columns)
    judged = judge(docs.select(row.alias("_whole"), F.col(text).alias("_text")), "_text", base, rules)
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array("_whole"))).alias("_whole"))
    return kept.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
