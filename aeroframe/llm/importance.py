"""Importance resampling of documents towards a target collection, on hashed word n-grams.

A text is UTF-8 bytes: one 256-byte table lower-cases A-Z and turns every separator into a space, ``bytes.split`` yields the
words, and crc32 seeded with the crc32 of the words before extends an n-gram by one word. Counters reduce each batch to its
different words before anything is hashed, and each task sends one count a bucket. The log ratios of the buckets weigh the
documents; Gumbel noise from a hash of the key makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.text import small_batches, stored

#: Digits, lower-case letters and all bytes of characters beyond ASCII stay; everything else is a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Different words whose crc32 a worker keeps before it starts anew.
KEPT = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def stretches(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes of it at a time, so that a very long one never is a list as a whole."""
    blank, at = text.translate(TABLE), 0
    while at < len(blank):
        end = blank.find(b" ", at + size)
        yield blank[at:end if end >= 0 else None].split()
        at = end if end >= 0 else len(blank)


def extended(words: list[bytes], n: int) -> Iterator[list[int]]:
    """For each length up to ``n`` the crc32 of every n-gram of that length, words joined by one space."""
    last = [zlib.crc32(w) for w in words]
    yield last
    for size in range(2, n + 1):
        last = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(last, words[size - 1:], strict=False)]
        yield last


class Buckets(dict):
    """Bucket of a word; computed once for each different word that a worker keeps."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        b = self[word] = zlib.crc32(word) % self.buckets
        return b


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _counts(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in batches:
            seen: Counter = Counter()
            for text in text_bytes(batch.column(0)):
                if text and n == 1:
                    for words in stretches(text):
                        seen.update(words)
                elif text:
                    for grams in extended(words_of(text), n):
                        np.add.at(total, np.fromiter(grams, np.int64, len(grams)) % buckets, 1)
            if seen:
                np.add.at(total, np.fromiter(map(of.__getitem__, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts. The driver gets one number a bucket."""
    sums = docs.select(F.col(text).alias("text")).mapInArrow(_counts(n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Scaled log ratio of each bucket's share in the target and in the source, one added to every count."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def gumbel(key: int | str | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weights(n: int, buckets: int, gain: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets)
        gain_of = gain.__getitem__
        for batch in batches:
            n_words, n_features, weight, score = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                features, total = 0, 0
                if n == 1:
                    for words in stretches(text or b""):
                        features += len(words)
                        total += sum(map(gain_of, map(of.__getitem__, words)))
                    n_words.append(features)
                else:
                    grams = list(extended(words_of(text or b""), n))
                    features, total = sum(map(len, grams)), sum(gain[g % buckets] for level in grams for g in level)
                    n_words.append(len(grams[0]))
                n_features.append(features)
                weight.append(total // features if features else 0)
                score.append(weight[-1] + gumbel(key, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def ranked(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... for the floor(percent * n / 100) highest scores of the n eligible rows, else null.

    A histogram of the scores gives the lowest score that can be drawn; only rows from there on are sorted, by ranges, and numbered
    from the counts of the ranges before theirs. Scores are sums of two bounded logarithms in thousandths, so the histogram has
    some 200,000 lines at most. Ties go to the smaller id, null ids last; equal rows follow each other in any order."""
    spark = rows.sparkSession
    hist = stored(rows.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "draw-scores")
    n = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = percent * n // 100
    above = Window.orderBy(F.col("score").desc())
    edge = hist.withColumn("upto", F.sum("n").over(above)).filter(F.col("upto") >= drawn).agg(F.max("score")).first()[0] if drawn else None
    rest = rows.withColumn("rank", F.lit(None).cast("long"))
    if edge is None:
        return rest
    near = eligible & (F.col("score") >= edge)
    # equal rows, also with one id, may be very many: a hash of the row's place spreads them over ranges
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.filter(near).withColumn("w_tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("w_tie").asc()]
    placed = stored(spread.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("w_place", F.monotonically_increasing_id()), "draw-order")
    part = F.shiftright("w_place", 33)
    sizes = placed.groupBy(part.alias("w_part")).agg(F.count(F.lit(1)).alias("w_n"))
    starts = sizes.select("w_part", (F.sum("w_n").over(Window.orderBy("w_part")) - F.col("w_n")).alias("w_start"))      # one row a range
    rank = F.col("w_start") + F.col("w_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = placed.withColumn("w_part", part).join(F.broadcast(starts), "w_part").withColumn("rank", F.when(rank <= drawn, rank))
    return numbered.select(*rest.columns).unionByName(rest.filter(~near))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
             text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    Features are the n-grams of one to ``n`` words, repeats counted; a word is a run of digits, letters and characters beyond ASCII,
    A-Z lower-cased. ``weight`` is the floored mean of the gains of a document's features, ``score`` adds Gumbel noise from the key.
    Null, empty and wordless texts have no feature, weight 0 and a score, and are never drawn; a null key hashes as nothing between
    colon and end. Repeated rows and rows of one id are drawn by themselves (their noise is the same). An empty target has zero
    counts; an empty ``docs`` gives no rows. Other columns are ignored. Texts of any length are counted whole."""
    small_batches(docs.sparkSession)
    source, wanted = (bucket_counts(t, text, n, buckets) for t in (docs, target))
    gain = gains(source, wanted)
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = named.schema["doc_id"].dataType.simpleString()
    rows = stored(named.mapInArrow(_weights(n, buckets, gain, seed), f"doc_id {key_type}, n_words long, n_features long, weight long, score long"), "draw-rows")
    return ranked(rows, F.col("n_words") >= least_words, percent)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose key is drawn, in their own columns (rows that share a drawn key all stay)."""
    keys = resample(docs, target, key=key, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    named = docs.join(keys.withColumnRenamed(key, "w_key"), docs[key].eqNullSafe(F.col("w_key")), "left_semi")
    return named.select(*docs.columns)
