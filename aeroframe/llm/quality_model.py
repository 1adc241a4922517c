"""Quality scores by a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators say which n-grams a text has: n-grams of character classes, of words (hashed), and of two word marks, "equals the
word before" and "ends three words that stood earlier in the text", in runs of 1, 2, 4, ... words. Each indicator counts as much
as its log-count ratio between the classes; a linear hinge-loss model is fitted on the scaled indicators by dual coordinate
descent, and its margin becomes a score by a logistic fit on margins of rows left out of the model that gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import flat, mix, seeded_sample, small_batches

WORD_BITS = 18
RUNS = (1, 2, 4, 8, 16, 32, 64)
SIGNS = b"#*$%&|<>!?.,;:-+=@/\"'()"


def _classes() -> np.ndarray:
    """Class of every byte: each sign its own, then lower case, upper case, digit, space, line feed, other ASCII, bytes above ASCII."""
    table = np.full(256, len(SIGNS) + 5, np.int64)
    for k, c in enumerate(SIGNS):
        table[c] = k
    n = len(SIGNS)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = n, n + 1, n + 2
    table[[9, 11, 12, 13, 32]], table[10], table[128:] = n + 3, n + 4, n + 6
    return table


CLASS = _classes()
N_CLASSES = len(SIGNS) + 7
N_CHARS = N_CLASSES + N_CLASSES ** 2 + N_CLASSES ** 3
N_DENSE = N_CHARS + 2 * len(RUNS)
N_FEATURES = N_DENSE + (1 << WORD_BITS)
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, ascending, joined, and where each text's begin. A null text has none."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    raw, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw, at = raw[at[0]:at[-1]], at - at[0]
    doc = np.repeat(np.arange(n), np.diff(at))
    seen = np.zeros((n, N_DENSE), bool)
    c = CLASS[raw]
    seen[doc, c] = True
    if len(c) > 1:
        two = doc[1:] == doc[:-1]
        pair = c[:-1] * N_CLASSES + c[1:]
        seen[doc[1:][two], N_CLASSES + pair[two]] = True
        if len(c) > 2:
            three = doc[2:] == doc[:-2]
            seen[doc[2:][three], N_CLASSES + N_CLASSES ** 2 + (pair[:-1] * N_CLASSES + c[2:])[three]] = True
    ink = ~np.isin(raw, np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
    first = ink.copy()
    first[1:] &= ~(ink[:-1] & (doc[1:] == doc[:-1]))
    last = ink.copy()
    last[:-1] &= ~(ink[1:] & (doc[1:] == doc[:-1]))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keys = np.zeros(0, np.int64)
    if len(starts):
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(P, len(raw)), dtype=np.uint64)])
            words = mix((run[ends] - run[starts]) * _powers(P_INVERSE, len(raw))[starts])
            of = doc[starts]
            pairs = mix(words[:-1] * np.uint64(3) + words[1:])
            triples = mix(pairs[:-1] * np.uint64(3) + words[2:])
        inside2, inside3 = of[1:] == of[:-1], of[2:] == of[:-2]
        same = np.concatenate([[False], (words[1:] == words[:-1]) & inside2])
        again = np.zeros(len(words), bool)
        if inside3.any():
            spot = np.flatnonzero(inside3)
            h = triples[spot] ^ mix(of[spot].astype(np.uint64))
            _, firsts = np.unique(h, return_index=True)
            late = np.ones(len(spot), bool)
            late[firsts] = False
            again[spot[late] + 2] = True
        for k, flags in enumerate((same, again)):
            _mark_runs(flags, of, seen, N_CHARS + k * len(RUNS))
        shift = np.uint64(64 - WORD_BITS)
        keys = np.unique(np.concatenate([(of.astype(np.int64) << WORD_BITS) | (words >> shift).astype(np.int64),
                                         (of[1:][inside2].astype(np.int64) << WORD_BITS) | (pairs[inside2] >> shift).astype(np.int64)]))
    row, col = np.nonzero(seen)
    row = np.concatenate([row, keys >> WORD_BITS])
    col = np.concatenate([col, N_DENSE + (keys & ((1 << WORD_BITS) - 1))])
    order = np.argsort(row, kind="stable")
    return col[order].astype(np.int32), np.searchsorted(row[order], np.arange(n + 1))


def _mark_runs(flags: np.ndarray, of: np.ndarray, seen: np.ndarray, base: int) -> None:
    on = np.flatnonzero(flags)
    if not len(on):
        return
    cut = np.flatnonzero((np.diff(on) > 1) | (of[on[1:]] != of[on[:-1]])) + 1
    begin, end = on[np.concatenate([[0], cut])], on[np.concatenate([cut - 1, [len(on) - 1]])]
    for k, n in enumerate(RUNS):
        seen[of[begin[end - begin + 1 >= n]], base + k] = True


@dataclass
class Model:
    """Scaled weights of the indicators, squared scale (for the length of a row), bias, and the logistic fit of the margin."""
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, col: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        length = np.sqrt(np.bincount(row, self.square[col], len(at) - 1))
        return np.bincount(row, self.weight[col], len(at) - 1) / np.maximum(length, 1e-12) + self.bias

    def scores(self, col: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(col, at) + self.offset, -40, 40)))


def ratios(col: np.ndarray, at: np.ndarray, y: np.ndarray, least: int = 3, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of every indicator between the classes; 0 for those in fewer than ``least`` rows."""
    row = np.repeat(np.arange(len(y)), np.diff(at))
    good, bad = np.bincount(col[y[row] > 0], minlength=N_FEATURES) + smooth, np.bincount(col[y[row] <= 0], minlength=N_FEATURES) + smooth
    r = np.log((good / ((y > 0).sum() + 2 * smooth)) / (bad / ((y <= 0).sum() + 2 * smooth)))
    r[good + bad - 2 * smooth < least] = 0.0
    return r


def hinge(col: np.ndarray, at: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, weights and bias: the dual of the hinge loss, one coordinate (row) at a time; rows of the rarer class cost more.

    y is 1 or -1."""
    r = ratios(col, at, y)
    n = len(y)
    value = r[col].astype(np.float64)
    rows = [(col[at[i]:at[i + 1]], value[at[i]:at[i + 1]]) for i in range(n)]
    rows = [(c[v != 0], v[v != 0]) for c, v in rows]
    rows = [(c, v / max(np.sqrt((v * v).sum()), 1e-12)) for c, v in rows]
    upper = cost * n / (2.0 * np.array([max(1, (y == s).sum()) for s in y]))
    w, bias, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(n)
    norm = np.array([(v * v).sum() + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            c, v = rows[i]
            gradient = y[i] * (w[c] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[c] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return r, w, bias


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), with the targets drawn in from 0 and 1 as the class sizes allow; Newton steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        step = min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - step * d[0], b - step * d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(col: np.ndarray, at: np.ndarray, y: np.ndarray, folds: int = 3) -> Model:
    """y: 1 or -1 for each row. One class alone, or no row, gives that class's share (a half if none) as every score."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    if not n1 or not n0 or min(n1, n0) < folds:
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))))

    def model(take: np.ndarray) -> Model:
        sizes = np.diff(at)[take]
        own = np.concatenate([col[at[i]:at[i + 1]] for i in take])
        r, w, bias = hinge(own, np.concatenate([[0], np.cumsum(sizes)]), y[take])
        return Model(w * r, r * r, bias, 1.0, 0.0)
    fold = np.zeros(len(y), int)
    for s in (1, -1):       # each fold gets its part of either class
        fold[y == s] = np.arange((y == s).sum()) % folds
    left_out = np.zeros(len(y))
    for k in range(folds):
        m = model(np.flatnonzero(fold != k))
        left_out[fold == k] = m.margins(col, at)[fold == k]
    whole = model(np.arange(len(y)))
    whole.slope, whole.offset = logistic(left_out, y)
    return whole


def held_out(key: Column) -> Column:
    """Rows whose key, as text, has a crc32 that leaves 2 when divided by 4; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col, at = indicators(b.column("body"))
        yield pa.RecordBatch.from_arrays([b.column("o"), b.column("y"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(col))], ["o", "y", "f"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, at = indicators(b.column("body"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.scores(col, at))], ["doc_id", "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 4000, seed: int = 23) -> Model:
    """A model of the labelled rows that are not held out; of more than ``sample_rows`` those that come first by a seeded hash of the key.

    The sample of labels is broadcast, as its size is bounded, and only its texts' features reach the driver."""
    known = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("l_key"), F.col(label).cast("int").alias("y"))
             .distinct().withColumn("l_order", F.xxhash64(F.lit(seed), "l_key")))
    taken = seeded_sample(known, "l_order", sample_rows, "l_key", "y")
    named = docs.select(F.col(key).alias("d_key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = named.join(F.broadcast(taken), F.col("d_key") == F.col("l_key")).select("d_key", "y", "body")
    # a key that many rows share counts once for each different text, and a sample never exceeds its bound by it
    rows = seeded_sample(rows.select("y", "body", F.xxhash64(F.lit(seed), "d_key", "body").alias("o")), "o", sample_rows, "y", "body")
    got = rows.select("o", "y", "body").mapInArrow(_features, "o long, y int, f array<int>").toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    got = got.sort_by([("o", "ascending"), ("y", "ascending")])      # the fit goes through the rows in this order
    col, at = flat(got.column("f"))
    return fit(col, at, np.where(got.column("y").to_numpy() > 0, 1, -1))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: float = 0.7, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= limit).

    Only the text is scored, whole. Null texts count as empty; a text without n-grams gets the score of the bias. Equal texts get
    equal scores; null and repeated keys pass through; extra columns are ignored. Without labels of both classes all scores are
    their share; an empty table gives no rows. Texts are independent: nothing but the training sample is moved."""
    small_batches(docs.sparkSession, 500)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label, **options))
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
