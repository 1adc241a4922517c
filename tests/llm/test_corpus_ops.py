"""Rules, mixing, sharding, near copies and repeated windows against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from aeroframe.llm import components, mixing, ngram_join, quality_rules, queries, sharding, substring


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_of(t):
    t, w = t or "", words_of(t)
    lines = [x for x in t.split("\n") if words_of(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_rules_measure_as_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    assert len(got) == len(documents)
    for d in documents.itertuples():
        n, chars, symbols, dup, rep = base_of(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)
    assert {r.kept for r in got.values()} == {True, False}


def test_rules_odd_rows_and_order(spark, odd, nothing):
    out = quality_rules.features(quality_rules.judge(odd))
    for r in out.collect():
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == base_of(r.text)
        assert (r.rejected_by is None) == (r.doc_id in (8, 9))
    assert quality_rules.keep(odd).columns == odd.columns and sorted(r.doc_id for r in quality_rules.keep(odd).collect()) == [8, 9]
    assert quality_rules.keep(nothing).count() == 0
    given = quality_rules.rules()
    want = odd.withColumn("q_words", F.split("text", " "))
    a = want.select(quality_rules.first_rejection(given).isNull().alias("x")).collect()
    assert a == want.select(quality_rules.first_rejection(given[::-1]).isNull().alias("x")).collect()
    first = quality_rules.cascade_order(odd, given, 100)
    assert {r.name for r in first} == {r.name for r in given}


def shares(sizes):
    """Targets by repeated resharing, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > 3 * sizes[s]]
        if not over:
            return {**now, **capped}
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words_of(text))
    goal = shares(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(goal[r.source]), rel=1e-12) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 3, (s, n, float(goal[s]))


def test_mix_meets_its_targets(spark, sf, documents, odd, nothing):
    from aeroframe.llm.queries import table
    rows = mixing.mix(table(spark, sf, "documents")).collect()
    assert len(rows) == len(documents)
    check_mix(rows, documents[["doc_id", "text", "source"]].itertuples(index=False))
    again = mixing.mix(table(spark, sf, "documents").repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert mixing.mix(nothing).count() == 0 and mixing.repeat(nothing).columns == odd.columns
    skew = spark.createDataFrame([(i, "one two three four", "a" if i < 4 else None) for i in range(300)] + [(999, "w " * 7, "b")] * 40, "doc_id long, text string, source string")
    check_mix(mixing.mix(skew).collect(), [(r.doc_id, r.text, r.source) for r in skew.collect()])


def test_repeat_follows_the_mix(spark, sf):
    docs = queries.table(spark, sf, "documents")
    want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mixing.mix(docs).filter("size > 0").collect()}
    got = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_shards_hold_every_row_once(spark, sf, documents, odd, nothing, tmp_path):
    rows = queries.op6_shuffle_shards(spark, sf).collect()
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = sharding.shard_documents(odd, 4, bucket_bytes=2000, path=str(tmp_path / "a")).collect()
    assert Counter((r.doc_id, r.text) for r in small) == Counter((r.doc_id, r.text) for r in odd.collect()) and len({r.shard for r in small if r.doc_id == 1}) == 1
    assert sharding.shard_documents(nothing, 4, path=str(tmp_path / "b")).count() == 0
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 3]
    assert order != sorted(order)


def grams(t, k=5):
    w = words_of(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(docs, limit=Fraction(4, 5)):
    sets = [(i, t or "", grams(t)) for i, t in docs]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            (x, tx, sx), (y, ty, sy) = sets[a], sets[b]
            both = len(sx & sy)
            if tx == ty or both and both >= limit * (len(sx) + len(sy) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for a in range(len(sets)):
        ids[find(a)].append(sets[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((sets[a][0], least[find(a)], links[a]) for a in range(len(sets)))


def found_classes(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_near_copies_as_brute_force(spark, sf, documents, odd, nothing):
    got = found_classes(queries.op5_ngram_jaccard(spark, sf))
    assert got == brute_classes(list(documents[["doc_id", "text"]].itertuples(index=False)))
    assert any(n for _, _, n in got)
    assert found_classes(ngram_join.jaccard_classes(odd)) == brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.jaccard_classes(nothing).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, "a b c d e f g"), (3, ""), (5, " \n\t "), (0, "no id here at all"), (6, "x"), (7, "the same line\nthe same line\nthe same line"), (8, " ".join(f"w{i}" for i in range(3000))), (10, "é中 \U0001f600 café")])


def test_large_group_in_blocks(spark):
    base = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1:])) for i in range(0, 60)] + [(100 + i, " ".join(base)) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_classes(ngram_join.jaccard_classes(df, block_rows=8)) == brute_classes(docs)


def test_banding_reaches_its_recall():
    for s in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(s, 0.99)
        assert 1 - (1 - s ** rows) ** bands >= 0.99 and bands * rows <= 128


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(docs, width):
    ws = [words_of(t) for _, t in docs]
    seen = Counter(tuple(w[i:i + width]) for w in ws for i in range(len(w) - width + 1))
    out = Counter()
    for (i, _), w in zip(docs, ws, strict=True):
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k:k + width])] > 1 for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_repeats_as_brute_force(spark, sf, documents, odd, nothing):
    docs = list(documents[["doc_id", "text"]].itertuples(index=False))
    got = Counter(tuple(r) for r in queries.op7_remove_repeats(spark, sf).collect())
    assert got == brute_cut(docs, 35) and any(k[2] for k in got)
    for width, piece in ((6, 2), (5, 5)):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(odd, width, piece=piece).collect())
        assert got == brute_cut([(r.doc_id, r.text) for r in odd.collect()], width)
    assert substring.remove_repeats(nothing).count() == 0
