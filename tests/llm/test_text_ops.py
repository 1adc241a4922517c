"""Extraction, token files, leaks, personal data, scores and the pipeline against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aeroframe.llm import decontaminate, html_text, private_spans, quality_model, queries, token_store
from aeroframe.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# pages

@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<!-- never closed", "a"), ("a < b & c &am", "a < b & c &am"), ("<p>one<p>two", "one\n\ntwo"),
    ("<nav>menu here</nav><article><h1>Title &amp; more</h1><p>Text  with\n <b>bold<br>parts</b>.</p><div class='ad box'>Buy, now.</div><p>End.</p></article><footer>x</footer>", "Title & more\n\nText with bold parts.\n\nEnd."),
    ("<header>Site</header><main><header><h1>Head</h1></header><p>Body text, long enough.</p><form>Name</form><section id=comments><p>Nice, one!</p></section></main>", "Head\n\nBody text, long enough."),
    ("<div class='cookie-notice'>We use cookies.</div><div><p>Words, and more words, here.</p><script>if (a<b) '</p>'</script><aside>See also.</aside></div>", "Words, and more words, here."),
    ("<div class='content-sidebar-wrap has-comments'><p>Text, here it is.</p><div id=adBox2>Buy.</div><div class=page-header>Site</div><div class=user_comments>Hm.</div></div>", "Text, here it is."),
    ("<article><p>cut off in a <b>tag</b> <a hre", "cut off in a tag"), ("<p hidden>no</p><p>yes, really.</p>", "yes, really."), ("<article><ul><li>one<li>two</ul></article>", "one\n\ntwo"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_link_lists_are_no_content():
    page = "<body><div><ul>" + "<li><a href=x>Go there</a></li>" * 12 + "</ul></div><div>" + "<p>This is a sentence, and it is long enough, so it counts as prose.</p>" * 6 + "</div></body>"
    assert "Go there" not in html_text.main_text(page) and html_text.main_text(page).count("prose") == 6


def test_pages_of_the_table(spark, sf):
    import pandas as pd
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id").html
    rows = queries.op1_extract_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1])
        import html
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>|</?div[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a, b.</p>", "x"), (2, "u", "<p>" + "long text, " * 50_000 + "</p>", "x")], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.n_chars) for r in html_text.extract(df).collect())
    assert got == Counter({(1, 0): 2, (None, 5): 1, (2, 50_000 * 11 - 1): 1}) and html_text.extract(df.filter("false")).count() == 0


# token files

TEXTS = ["", "plain words, and. more", "a  b   c    d", " \n x\n\ny\t z ", "it's we'll don't", "x y  z", "line one.\nLine two.\r\nThree", "1,234.5 km/h #tag $$$ ###", "é中 \U0001f600 café. Ünï", "a\x01b c", "<|endoftext|> x", "end. ", "\n\nA", "Wort.\nÜber, alles!", "a\x0bb c", "   "]


def test_cached_pieces_give_the_ids_of_whole_texts():
    e = Encoder(BPE, most=5)
    for _ in range(2):
        ids, at = e.encode(pa.array(TEXTS))
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(TEXTS))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def brute_tokens(docs):
    e, start, out = Encoder(BPE), 0, Counter()
    for i, t in docs:
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    return out


def test_token_files_round_trip(spark, sf, documents, odd, nothing, tmp_path):
    got = Counter(tuple(r) for r in queries.op4_token_store(spark, sf).collect())
    assert got == brute_tokens(list(documents.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False)))
    folder = str(tmp_path / "store")
    out = token_store.token_digests(odd, BPE, folder=folder, shard_bytes=3000, bucket_keys=3).collect()
    assert len(out) == odd.count() and len({(r.doc_id, r.copy) for r in out}) == len(out)
    want = defaultdict(list)
    for (i, _, n, crc), m in brute_tokens([(r.doc_id, r.text) for r in odd.collect()]).items():
        want[i] += [(n, crc)] * m
    have = defaultdict(list)
    for r in out:
        have[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    place = sorted((r.start, r.n_tokens, r.doc_id) for r in out)
    assert all(a[0] + a[1] == b[0] for a, b in zip(place, place[1:])) and [p[2] for p in place if p[2] is not None] == sorted(p[2] for p in place if p[2] is not None)
    missing = token_store.lookup(spark, folder, spark.createDataFrame([(1, 0), (1, 1), (1, 2), (77, 0)], "doc_id long, copy long")).collect()
    assert sorted((r.doc_id, r.copy) for r in missing) == [(1, 0), (1, 1)]
    assert token_store.token_digests(nothing, BPE).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 50, 3000):
        h1, h2 = rng.integers(-2**62, 2**62, m), rng.integers(-2**62, 2**62, m)
        shift, slot = token_store.build(h1, h2)
        assert sorted(slot) == list(range(m)) and (token_store.find(h1, h2, shift, m) == slot).all()


# leaks

def test_leaks_as_brute_force(spark, sf, documents):
    import pandas as pd
    items = {r.item_id: r.text.split() for r in pd.read_parquet(f"{sf}/benchmark.parquet").itertuples()}
    where = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 5):
            where[tuple(w[k:k + 6])].add((i, k))
    want = set()
    for d in documents.itertuples():
        w, seen = (d.text or "").split(), defaultdict(set)
        for k in range(len(w) - 5):
            for i, p in where.get(tuple(w[k:k + 6]), ()):
                seen[i].update(range(p, p + 6))
        want |= {(d.doc_id, i) for i, c in seen.items() if 2 * len(c) >= len(items[i])}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf).collect()}
    assert want <= got and len(got - want) <= len(want) // 20 and want


def test_templates_and_slots(spark, odd, nothing):
    bench = spark.createDataFrame([
        (1, "A train leaves Paris at 10 with 40 people and reaches Lyon after 2 hours so how fast did it go from Paris to Lyon", "z"),
        (2, "short item", "z"), (3, None, "z"), (4, "", "z"), (None, "the item without any id is here to be found too", "z"),
        (5, "short item", "z"), (5, "short item", "z")], "item_id long, text string, tk string")
    docs = spark.createDataFrame([
        (10, "intro words here. A train leaves Rome at 11 with 35 people and reaches Milan after 3 hours so how fast did it go from Rome to Milan and then some more"),
        (11, "a train leaves Rome at 11 with 35 people and reaches Milan after 3 hours so how fast did it go from Turin to Bari"),
        (12, "nothing of this kind, only a train that leaves"), (13, "short item"), (14, "a short item inside"), (None, "xx the item without any id is here to be found too yy"), (15, None), (16, ""),
        (10, "intro words here. A train leaves Rome at 11 with 35 people and reaches Milan after 3 hours so how fast did it go from Rome to Milan and then some more")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench)
    rows = sorted(((r.doc_id or 0), (r.item_id or 0), r.changed, r.n_covered == r.n_item) for r in got.collect())
    assert rows == [(0, 0, False, True), (10, 1, True, True), (10, 1, True, True), (11, 1, True, False), (13, 2, False, True), (13, 5, False, True)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [12, 14, 15, 16]
    assert decontaminate.drop_contaminated(nothing, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.filter("false")).count() == odd.count()
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_slots_that_change_value_are_dropped():
    keep = decontaminate.consistent([[("Paris", "Rome"), ("to", "to")], [("Paris", "Rome")], [("Paris", "Bari")], [("Lyon", "Rome")]], [False] * 4)
    assert keep == [True, True, False, False]
    assert decontaminate.consistent([[("A", "B")]], [True]) == [False]


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else False, "card": 14 <= len(digits) <= 19 and private_spans.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_as_brute_force(spark, sf, documents):
    tricky = ["a@b", "x@y.z", "..@a.b@c.d", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1.2.3", "+1 (2) 3-4.5 67 89 01 2", "4111 1111 1111 1111", "@a.b", "a@b.c.", "00001.2.3.004", "a@b.c@d.e", "x.y@z.w-1@q.r.s", "٣.1.2.3.4", ""]
    assert [private_spans.base_spans(t) for t in tricky] == [brute_spans(t) for t in tricky]
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    rows = queries.op9_private_data(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(private_spans.joined(base).encode()).hexdigest()
        assert set(filter(None, private_spans.joined(base).split(","))) <= set(r.spans.split(","))


def test_field_follows_repeated_values(spark, odd, nothing):
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} or write bob{i}@mail.example.org from 10.0.{i % 250}.7 in version 2.{i} of 19{i:02d}" for i in range(60)] + ["pay 4111 1111 1111 1111 now"] * 5
    field = private_spans.fit(texts)
    t = "Call +1 (974) 555-3436 now. Later 974-555-3436 again, but not 123-456-7890 alone, version 2.0"
    base = private_spans.base_spans(t)
    assert [t[s:e] for s, _, e in private_spans.added_spans(t, base, field)] == ["974-555-3436"]
    assert private_spans.added_spans("no such thing, 12 of 40 in 2024", [], field) == []
    empty = private_spans.fit([])
    assert private_spans.added_spans(t, base, empty) == []
    assert private_spans.find_private(odd).count() == odd.count() and {r.spans for r in private_spans.find_private(odd).collect()} == {""} and private_spans.find_private(nothing).count() == 0


# scores

def test_scores_on_held_out_rows(spark, documents):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op10_quality_model(spark, sf)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_odd_rows_get_scores(spark, sf, odd, nothing):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality_model.score(odd, labels).count() == odd.count() and quality_model.score(nothing, labels).count() == 0
    assert {r.score for r in quality_model.score(odd, labels.filter("false")).collect()} == {0.5}


def test_dual_descent_separates():
    rng = np.random.default_rng(4)
    y = np.where(rng.random(400) < 0.3, -1, 1)
    rows = [sorted(set(rng.integers(100, 400, 20)) | ({5} if s < 0 else {6})) for s in y]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    m = quality_model.fit(np.array([x for r in rows for x in r]), at, y)
    s = m.scores(np.array([x for r in rows for x in r]), at)
    assert ((s >= 0.5) == (y > 0)).mean() > 0.98


# pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_corpus_ops import base_of, brute_classes
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and all(base_of(given[i].text)[0] >= 50 for i in ids) and len(ids) > 100
    kept = spark.createDataFrame([given[i] for i in ids], docs.schema)
    one = stages["near copies"](spark, kept, sf)
    assert {r.doc_id for r in one.collect()} == {c for _, c, _ in brute_classes([(i, given[i].text) for i in ids])} and one.columns == docs.columns
    clean = stages["benchmark leaks"](spark, one, sf)
    bad = {r.doc_id for r in queries.op8_decontaminate(spark, sf).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    last = stages["sharding"](spark, stages["source weights"](spark, clean, sf), sf)
    assert last.columns == [*docs.columns, "shard", "slot"] and {r.doc_id for r in last.collect()} <= {r.doc_id for r in clean.collect()}
    done = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in done.collect()) == Counter(r.doc_id for r in last.collect())
