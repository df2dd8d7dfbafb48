"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table: a name, the measure that it bounds, and its lowest and highest allowed value.
``quality_rules`` turns it into column expressions only (no user functions); the document's text is split
once and every measure is taken from that array.

Defined results: null and empty texts have no words and fail the base rule; repeated rows each get their
own verdict; extra columns stay untouched; an empty table gives an empty result. A column of the input
named like a measure is replaced by the measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relata.llm.exprs import ratio, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by this are at from "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les en un du que une dans il au par pour est sur qui pas avec "
    "el los las y del se una su con lo al como"
).split()

#: (measure, lowest, highest); None is unbounded.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 3.0, 10.0),
    ("symbol_ratio", None, 0.1),
    ("exclamation_ratio", None, 0.3),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
)

MIN_WORDS = 50


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; grams has one hash a window.

    The windows are sorted by (hash, place), those equal to a neighbour keep their places, and each place
    adds as many words as lie before the next one, three at most.
    """
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda p, j: (p["g"] == F.get(s, j + 1)["g"]) | (p["g"] == F.get(s, j - 1)["g"])
        return F.sort_array(F.transform(F.filter(s, lambda p, j: F.coalesce(same(p, j), F.lit(False))), lambda p: p["i"]))

    found = F.element_at(F.transform(F.array(pairs), places), 1)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    covered = F.aggregate(found, start, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures of RULES."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step is used more than once by the next, so the optimizer keeps it a projection of its own. And each
    # reads the row's number, which isn't deterministic, so that no filter above is pushed below it, where the
    # text would be split again for each word.
    held = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    base = docs.withColumns({"__t": t, "__w": held(words_of(F.col(text))), "__l": held(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))})
    gram = lambda x, i: F.xxhash64(x, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2))
    base = base.withColumn("__g", held(F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))), gram)))
    n = F.size("__w").cast("long")
    stop = F.size(F.filter("__w", lambda x: x.isin([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)])))
    out = base.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__w"), F.col("__g")),
        "stop_word_ratio": ratio(stop, n),
        "exclamation_ratio": ratio(F.length("__t") - F.length(F.replace(F.col("__t"), F.lit("!"), F.lit(""))), n),
        "__n_lines": F.size("__l"),
    })
    return out.withColumns({
        "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("__n_lines")),
    }).drop("__t", "__w", "__l", "__g", "__n_lines")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, float | None, float | None], ...] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all measures, base_failed and kept."""
    within = [F.col(m).between(lo if lo is not None else float("-inf"), hi if hi is not None else float("inf")) for m, lo, hi in rules]
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, within, F.lit(True)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that the rules reject, in their own columns.

    The condition also reads a column that isn't deterministic (and always true), so that the optimizer leaves
    the filter above the measures instead of taking them twice.
    """
    ruled = quality_rules(docs, text).withColumn("__row", F.monotonically_increasing_id())
    return ruled.where(F.col("kept") & (F.col("__row") >= 0)).select(*docs.columns)
