"""Quality rules as a short-circuit cascade: cheap rules that reject much come first.

Every rule is a DataFrame expression. A bounded sample of the rows gives each rule's cost (seconds of a job that evaluates
it alone) and its selectivity; rules are ordered by rejection per cost and nested in one CASE, so that a row that an early
rule rejects never evaluates the later ones. The order changes the time only: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import words

BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a row that has to go."""
    name: str
    rejects: Column


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeated_words(w: Column) -> Column:
    """Words inside windows of three words that occur twice or more, found by sorting the windows of the text.

    The hash comes first in the sort key and nearly always decides; the words follow, so equal neighbours are equal windows."""
    places = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"),
        F.get(w, i + 2).alias("c"), i.alias("i")))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(starts, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    found = let(F.sort_array(windows), lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))
    return F.when(F.size(w) >= 4, found).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the words and the measures that the rules read, under names that begin with ``q_``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (docs.withColumn("q_words", words(text))
            .withColumn("q_n_words", F.size("q_words").cast("long"))
            .withColumn("q_word_chars", word_chars(F.col("q_words")))
            .withColumn("q_n_symbols", n_symbols(t))
            .withColumn("q_n_dup_lines", n_duplicate_lines(t))
            .withColumn("q_n_repeat_words", n_repeated_words(F.col("q_words"))))


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < 50) | (100 * repeated > 50 * n)


def rules(text: str = "text", max_symbol_ratio: float = 0.1, max_duplicate_lines: float = 0.4, max_upper: float = 0.6,
          max_shouts: float = 0.2, max_word_chars: float = 20.0, max_same_as_previous: float = 0.2, measured: bool = False,
          w: Column | None = None) -> list[Rule]:
    """The rules, over a text column and its words ``w`` (the column ``q_words`` if none is given); every limit is a share of words, lines or letters.

    Each computes what it needs itself, so a rule that is not reached costs nothing. ``measured``: the columns of
    ``features`` are there and are read instead."""
    t, w = F.coalesce(F.col(text), F.lit("")), F.col("q_words") if w is None else w
    n = F.size(w)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    repeats = F.aggregate(F.transform(w, lambda x, i: F.when(x == F.get(w, i - 1), 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    chars, symbols, same_lines, same_windows = ((F.col(f"q_{c}") for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) if measured
                                                else (word_chars(w), n_symbols(t), n_duplicate_lines(t), n_repeated_words(w)))
    return [
        Rule("few_words", n < 50),
        Rule("long_words", chars > max_word_chars * n),
        Rule("symbols", symbols > max_symbol_ratio * n),
        Rule("shouts", F.regexp_count(t, F.lit(r"!!")) > max_shouts * n),
        Rule("upper_case", F.regexp_count(t, F.lit(r"\p{Lu}")) > max_upper * letters),
        Rule("duplicate_lines", same_lines > max_duplicate_lines * F.size(lines)),
        Rule("stutter", repeats > max_same_as_previous * n),
        Rule("repeated_windows", 100 * same_windows > 50 * n),
    ]


def cascade_order(docs: DataFrame, given: list[Rule], sample_rows: int = 2000, seed: int = 17, text: str = "text") -> list[Rule]:
    """``given`` by rejected rows per second, measured on about ``sample_rows`` rows that a seeded draw spreads over the table.

    The sample bounds the measurement only. An empty sample leaves the order as given."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.select(text).sample(share, seed).withColumn("q_words", words(text)).cache()
    try:
        rows = sample.count()
        if not rows:
            return list(given)
        rejected = sample.agg(*[F.sum(F.coalesce(r.rejects, F.lit(False)).cast("long")).alias(r.name) for r in given]).first()
        scored = []
        for place, r in enumerate(given):
            began = time.perf_counter()
            sample.agg(F.sum(F.coalesce(r.rejects, F.lit(False)).cast("long"))).first()
            seconds = max(time.perf_counter() - began, 1e-3)
            scored.append((-(rejected[r.name] or 0) / seconds, place, r))
        return [r for _, _, r in sorted(scored, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def first_rejection(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(ordered):
        out = F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept). Null, empty and blank texts have no words and are rejected; equal rows get
    equal verdicts; other columns pass through (columns named ``q_words`` or ``rejected_by`` are replaced). An empty table stays empty."""
    ordered = cascade_order(docs, rules(text), sample_rows, text=text)
    return docs.withColumn("q_words", words(text)).withColumn("rejected_by", first_rejection(ordered)).drop("q_words")


def measure(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``features`` and the verdict in ``rejected_by``, each measure computed once; rows as in ``judge``."""
    place = {r.name: r for r in rules(text, measured=True)}
    ordered = [place[r.name] for r in cascade_order(docs, rules(text), sample_rows, text=text)]
    return features(docs, text).withColumn("rejected_by", first_rejection(ordered))


def keep(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``.

    The words are bound inside the condition: as a column they would be split anew wherever the pushed-down filter names them."""
    order = [r.name for r in cascade_order(docs, rules(text), sample_rows, text=text)]

    def rejected(w: Column) -> Column:
        own = {r.name: r for r in rules(text, w=w)}
        return first_rejection([own[name] for name in order]).isNotNull()
    return docs.filter(~let(words(text), rejected))
