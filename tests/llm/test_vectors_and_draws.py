"""Vector codes, importance draws and the coordinate join against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.llm import ball_codes, coordinate_join, importance, queries

# --- op11 -------------------------------------------------------------------------------------------


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    """rows (id, ints): codes and errors by full search, and the codebooks."""
    width = len(vectors[0][1]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    order = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[list(cut(v)[p]) for _, v in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v in vectors:
            best = [min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
            out.append(([i for _, i in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v), (c, _) in zip(vectors, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    return assign(), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("spread, entries", [(0.3, 16), (0.02, 16), (3.0, 5)])
def test_codes_equal_full_search(spark, spread, entries):
    """Clustered and even vectors, repeated vectors and ids, ties, null labels, extra columns."""
    rng = np.random.default_rng(entries)
    centres = rng.normal(size=(7, 8))
    x = centres[rng.integers(0, 7, 400)] + spread * rng.normal(size=(400, 8))
    x[100:130] = x[5]
    x[130:140] = 0
    rows = [(int(i) if i != 17 else None, [float(np.float32(c)) for c in v], None if i % 11 == 0 else int(i % 3), "x") for i, v in enumerate(x)]
    rows[41] = (40, *rows[41][1:])
    bad = [(1000, None, 1, "x"), (1001, [1.0, None] + [0.0] * 6, 1, "x"), (1002, [float("nan")] + [0.0] * 7, 1, "x"), (1003, [float("inf")] + [0.0] * 7, None, "x"), (1004, [], 1, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = ball_codes.encode(df, entries=entries).collect()
    ints = [(r[0], [math.floor(1024 * c) for c in r[1]]) for r in rows]
    want, digest = plain_codes(ints, entries=entries)
    per_label = Counter()
    for r, (_, e) in zip(rows, want):
        per_label[r[2]] += e
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], "".join(f"{c:02x}" for c in codes), e, per_label[r[2]], digest) for r, (codes, e) in zip(rows, want)], key=str)


def test_balls_skip_and_still_agree():
    """With the codes of entries before they moved, stable parts stay, and the others find what a full search finds."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (40, 6))
    parts = centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 6))
    old = ball_codes.Balls(centres, None)
    code, far = old.full_search(parts)
    radius = np.sqrt(np.array([far[code == e].max(initial=0) for e in range(40)]))
    moved = centres + rng.integers(-20, 20, centres.shape)
    moved[3] = moved[2]
    new = ball_codes.Balls(moved, radius + np.sqrt(((moved - centres) ** 2).sum(axis=1)))
    assert new.reach.mean() < 4         # well apart: hardly any neighbours
    got, want = new.move(parts, code), new.full_search(parts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label string"
    nothing = spark.createDataFrame([(1, None, "a")], kind)
    assert ball_codes.encode(nothing).collect() == [] and ball_codes.encode(nothing.filter("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    one = ball_codes.encode(spark.createDataFrame([(1, [0.5, -0.5, 0.25, -0.001], "a")], kind)).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00000000", 0, 0)] and one[0].codebooks_sha256 == hashlib.sha256(b"512,-512,256,-2").hexdigest()
    for vectors in ([[1.0] * 6], [[1.0] * 8, [1.0] * 4], [[1e30] * 8]):
        with pytest.raises(Exception, match="components|lengths"):
            ball_codes.encode(spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], kind)).collect()


def test_codes_of_the_table(spark, sf):
    got = queries.op11_ball_codes(spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, digest = plain_codes([(r.vec_id, [math.floor(1024 * c) for c in r.embedding]) for r in table], rounds=1)
    one = {r.vec_id: (r.code, r.error) for r in ball_codes.encode(spark.read.parquet(f"{sf}/embeddings.parquet"), rounds=1).collect()}
    assert one == {r.vec_id: ("".join(f"{c:02x}" for c in codes), e) for r, (codes, e) in zip(table, want)} and got.count() == len(table)


# --- op12 -------------------------------------------------------------------------------------------

def features_of(text, n):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_draw(docs, target, n, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features_of(text, n)[1]))
    for text in target:
        t.update(map(bucket, features_of(text, n)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for key, text in docs:
        words, features = features_of(text, n)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("n, percent", [(1, 10), (3, 40)])
def test_draw_as_plain_python(spark, sf, documents, n, percent):
    docs = [(int(d.doc_id), d.text) for d in documents.itertuples()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = importance.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), n=n, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain_draw(docs, target, n, percent=percent)


def test_draw_of_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for n in (1, 2):
        got = importance.resample(odd.withColumn("weight", F.lit(1)).repartition(3), odd.limit(2), n=n, percent=100)
        assert sorted(map(tuple, got.collect()), key=str) == plain_draw(docs, [r.text for r in odd.limit(2).collect()], n, percent=100)
    assert importance.resample(nothing, odd).collect() == []
    none = importance.resample(odd, nothing)
    assert none.count() == odd.count() and sorted(map(tuple, none.collect()), key=str) == plain_draw(docs, [], 1)
    assert importance.drawn(odd, odd, percent=100).columns == odd.columns and sorted(r.doc_id for r in importance.drawn(odd, odd, percent=100).collect()) == [8, 9]


def test_draw_with_many_equal_rows(spark):
    """Ranks have no gap or repeat where a third of all rows share one id and score."""
    rows = [(7 if i % 3 == 0 else i, " ".join(f"w{j}" for j in range(20 + i % 4 * (i % 3 > 0)))) for i in range(3000)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("w1 w2",)], "text string"), percent=90)
    ranked = sorted(got.filter("rank is not null").collect(), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, 2701))
    assert all((-a.score, a.doc_id) <= (-b.score, b.doc_id) for a, b in zip(ranked, ranked[1:]))


def test_words_in_stretches():
    text = ("Ab9 c'd É中x\x7f{z}" * 50).encode()
    assert [w for s in importance.stretches(text, 7) for w in s] == importance.words_of(text) == [w.encode() for w in features_of(text.decode(), 1)[0]]


# --- op13 -------------------------------------------------------------------------------------------

def plain_components(docs, width=4, percent=80):
    """rows (id, text): one (id, size, component, kept) a row."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None and (find(i) not in least or least[find(i)] > key):
            least[find(i)] = key
    return sorted(((key, len(sets[i]), (c := least.get(find(i))), key == c) for i, (key, _) in enumerate(docs)), key=str)


def test_components_of_the_table(spark, sf, documents):
    docs = [(int(d.doc_id), d.text) for d in documents.itertuples()]
    got = queries.op13_near_dedup(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(docs)


def test_components_of_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, coordinate_join.near_components(odd).collect()), key=str) == plain_components(docs)
    assert coordinate_join.near_components(nothing).collect() == []
    kept = coordinate_join.first_of_components(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 1, 3, 4, 5, 6, 7, 8, 10]


def chains(rng, groups, members, words=60):
    """Groups in which texts drift from copy to copy, around a base, or share only half of their words."""
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        text = list(base)
        for m in range(members):
            if g % 3 == 0:
                text = list(text)
                text[rng.integers(words)] = f"g{g}m{m}"
                rows.append(" ".join(text))
            elif g % 3 == 1:
                near = list(base)
                near[int(rng.integers(words))] = f"g{g}m{m}"
                rows.append(" ".join(near))
            else:
                rows.append(" ".join(base[:words // 2] + [f"g{g}m{m}w{i}" for i in range(words // 2)]))
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("rounds, block_rows", [(1, 4), (3, 256)])
def test_components_with_drifting_groups(spark, rounds, block_rows):
    """Central members, chains that only the block tasks complete, and groups that share postings without links."""
    docs = chains(np.random.default_rng(8), 6, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = coordinate_join.near_components(df, rounds=rounds, block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(docs)


def test_match_threshold():
    assert coordinate_join.least_collisions(0.8, 48, 1e-6) == 24 and coordinate_join.least_collisions(1.0, 48, 1e-6) == 48 and coordinate_join.least_collisions(0.1, 8, 1e-6) == 1
    a = np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4, 5])
    assert coordinate_join.alike(*a, 80) and not coordinate_join.alike(*a, 81)
