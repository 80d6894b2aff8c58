"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a few figures of a text and votes good, bad or abstains. Expectation maximisation over
the vote patterns estimates how reliable the rules are, and the posterior probability of good quality
decides, instead of demanding that all rules pass. Texts are read once: their figures are written as a
narrow table to the shared folder, from which the patterns are counted and the verdicts made. No
texts are shuffled; only pattern counts are.

Repeated three-word windows are found inside the row: their hashes are compared by one distinct, and
only for texts with a repeat sorted with their positions, so long texts cost n log n.

Defined results: a null, empty or blank text has no words, fails the base rules and is not kept; a null
``doc_id`` is passed on; repeated rows give a row each (and count as often in the estimate); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import votes as V
from attesta.llm.common import SPACES, cut, text_or_empty

GAP = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Very common words of some languages.
STOP_WORDS = (
    "the of and to in is that it for was on are be with as by at this from or "
    "der die und das den von zu mit ist im für auf nicht ein eine dem des sich auch "
    "le la les et des du en un une que qui est dans pour par au sur "
    "el los las de y a con una es por para del se no al lo"
).split()


@dataclass(frozen=True)
class Settings:
    """Bounds of the rules, as shares of words or letters; ``keep`` is the posterior a kept text needs."""

    base_words: int = 50
    base_repeat_percent: int = 50
    keep: float = 0.5
    prior: float = 0.85


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``words``."""
    long = lambda c: c.cast("long")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(3)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            return F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))

        places = F.sort_array(F.transform(let(placed, repeats), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        add = lambda a, i: F.struct(
            (a["n"] + long(i) + 3 - F.greatest(a["end"], long(i))).alias("n"), (long(i) + 3).alias("end")
        )
        return F.aggregate(places, start, add, lambda a: a["n"])

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def figures(docs: DataFrame) -> DataFrame:
    """The figures of every text that the rules look at."""
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.array_intersect(w, F.array(*[F.lit(s) for s in STOP_WORDS]))).cast("long").alias("n_stop"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"), count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_upper"), count("[.!?]").alias("n_ends"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_ends")


def rules() -> dict[str, Column]:
    """Votes of all rules: 1 good, -1 bad, 0 abstains."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        chosen = F.when(bad, -1)
        return (chosen if good is None else chosen.when(good, 1)).otherwise(0)

    mean = chars / words
    return {
        "v_length": vote(c("n_words") < 20, c("n_words") >= 100),
        "v_word_length": vote((mean < 2.5) | (mean > 12)),
        "v_symbols": vote(c("n_symbols") > 0.1 * words),
        "v_dup_lines": vote((c("n_dup_lines") > 0.3 * c("n_lines")) & (c("n_lines") > 3)),
        "v_repeats": vote(c("n_repeat_words") > 0.3 * words),
        "v_stop_words": vote((c("n_stop") < 2) & (c("n_words") >= 50), c("n_stop") >= 5),
        "v_upper": vote(c("n_upper") > 0.3 * chars),
        "v_distinct": vote((c("n_distinct") < 0.1 * words) & (c("n_distinct") < 300)),
        "v_sentences": vote((c("n_words") >= 50) & ((c("n_ends") < 0.005 * words) | (c("n_ends") > 0.6 * words)),
                            (c("n_ends") >= 0.02 * words) & (c("n_ends") < 0.4 * words)),
    }


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All figures and votes with ``posterior``, ``base_failed`` and ``kept``."""
    made = cut(figures(docs))
    named = rules()
    voted = made.select("*", *[vote.alias(name) for name, vote in named.items()])
    found = V.fit_frame(voted, list(named), prior=settings.prior)
    failed = (F.col("n_words") < settings.base_words) | (
        100 * F.col("n_repeat_words") > settings.base_repeat_percent * F.col("n_words")
    )
    return voted.select("*", V.posterior(found, list(named)).alias("posterior"), failed.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= settings.keep)
    )


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"),
    )
