"""Mixing sources to target weights by hash thresholds.

Every row has a 64-bit hash. Tokens are summed by source and hash bucket; the bucket in which a source's budget runs out
is the only one that is looked at again, at the next bits of the hash, until one hash value remains. Rows below the
threshold are taken once more than rows above it. No row is sorted, and only histograms are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.text import n_words, stored, unused

#: Bits of the hash that one histogram resolves, and how many histograms cover 64 bits.
BITS, LEVELS = 16, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, size`` (one row a source) with ``weight`` and ``target``.

    Weights repeat over the sources by code point order, null last. All sources share the total size by weight; a target
    stops at ``most`` times its source's size and the rest is shared by weight among the others until none is above. That
    ends at target = min(most * size, level * weight) with one level for all, which sorting by size / weight finds at once.
    The table has one row a source, so its windows are as small as the list of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("cap", most * F.col("size").cast("double")).withColumn("total", F.sum("size").over(everything).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source, by cap per weight, that isn't capped at its own level sets the level of all that follow
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    return w.select("source", "size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def row_hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def bucket(h: Column, level: int) -> Column:
    """The bits of the hash that the histogram of this level resolves, most significant first."""
    return F.shiftrightunsigned(h, 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def prefix(h: Column, level: int) -> Column:
    """The bits above those of this level."""
    return F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned(h, 64 - BITS * level)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of ``budgets`` (source key ``s``, ``budget``) the hash prefix at which its budget runs out.

    ``rows``: s, h, size. Result: s, path (the whole hash that holds the end of the budget), rest (what is left for the rows
    with that hash), ties (their size). A source without a row there has a null path: all its rows are below."""
    # states are written, so that Spark knows their size and broadcasts them only while they are small
    state = stored(budgets.select("s", F.lit(0).cast("long").alias("path"), F.col("budget").cast("double").alias("rest")), "mix-state")
    for level in range(LEVELS):
        inside = rows.join(state.select("s", "path"), "s").filter(prefix(F.col("h"), level) == F.col("path"))
        sums = inside.groupBy("s", bucket(F.col("h"), level).alias("b")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("s").orderBy("b")
        run = sums.withColumn("upto", F.sum("n").over(w))
        hit = (run.join(state, "s").filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
               .select("s", (F.shiftleft("path", BITS) if level else F.lit(0).cast("long")).bitwiseOR(F.col("b").cast("long")).alias("path"),
                       (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("n").alias("ties")))
        state = stored(hit, f"mix-level{level}")
    return state


def unsigned(h: Column) -> Column:
    """A signed value that sorts as the hash does without its sign."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 29, source: str = "source", text: str = "text",
        key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, size (words), source_size, target, taken.

    A row is taken whole floor(target / source_size) times, and once more if its hash lies below its source's threshold. The rows
    that share the threshold hash (normally one) take what is left of the budget in proportion to their size, so a source's taken
    words miss its target by less than one word for each of them. Equal rows have equal hashes and fare alike; hashes depend on the
    seed, key and text only, so reruns agree. Null or blank texts have size 0 and are taken 0 times; a null source is a source of
    its own, the last. Empty tables give no rows."""
    rows = stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"),
                              F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    goal = stored(targets(sizes, weights, most).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))
                  .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")), "mix-targets")
    keyed = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))
    budgets = goal.select("s", (F.col("target") - F.col("whole") * F.col("size")).alias("budget"))
    at = thresholds(keyed.filter("size > 0").select("s", "h", "size"), budgets)
    plan = stored(goal.select("s", F.col("size").alias("source_size"), "target", "whole").join(at, "s", "left"), "mix-plan")
    out = keyed.join(plan, "s")
    below = unsigned(F.col("h")) < unsigned(F.col("path"))
    extra = (F.when(F.col("path").isNull(), F.col("size") * (F.col("target") > F.col("whole") * F.col("source_size")).cast("long"))
             .when(below, F.col("size")).when(F.col("h") == F.col("path"), F.floor(F.col("rest") * F.col("size") / F.col("ties")))
             .otherwise(F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "h")


def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 29, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mix as rows of ``docs``: each as many times as it is taken, a part of half a document or more counting as one.

    Rows are matched by key and hash, so equal rows share one decision."""
    m_key, m_h, m_times, m_own, m_copy = unused(docs, "m_key", "m_h", "m_times", "m_own", "m_copy")
    taken = mix(docs, weights, most, seed, source, text, key).filter("size > 0")
    times = taken.select(F.col("doc_id").alias(m_key), F.col("h").alias(m_h), F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias(m_times)).filter(F.col(m_times) > 0).distinct()
    named = docs.withColumn(m_own, F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    out = named.join(times, F.col(key).eqNullSafe(F.col(m_key)) & (F.col(m_own) == F.col(m_h)))
    return out.withColumn(m_copy, F.explode(F.sequence(F.lit(1), F.col(m_times)))).select(*docs.columns)
