"""N-gram Jaccard self join by MinHash banding, verified on full n-gram sets.

1. Every text gets MinHash bands; equal texts are one class from here on, with a count of copies.
2. Band hashes are shuffled; only buckets with two or more texts go on, and of buckets with the same members only one.
3. A bucket is split into blocks and every pair of blocks is one small task, so no group is unbounded. A task compares
   n-gram sets exactly, in matrix products, and returns one row per text: how many links it found and the smallest text
   of its component, never the pairs.
4. Components of those rows are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.components import components
from aeroframe.llm.text import flat, in_document, mix, owner, small_batches, stored, tables, unused, window_hashes, word_hashes


def banding(similarity: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows a band: the most rows for which a pair at ``similarity`` shares a band with probability ``recall`` or more."""
    best = None
    for rows in range(1, most_hashes + 1):
        p = similarity ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most_hashes:
            break       # fewer hits a band ask for more bands: later rows need more hashes still
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding within the number of hashes")
    return best


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each document and the document of each; a document of fewer words has one n-gram of them all."""
    doc = owner(starts)
    inside = in_document(starts, width)
    out, of = [window_hashes(hashes, width)[inside]], [doc[inside]]
    sizes = np.diff(starts)
    for n in range(1, width):
        short = np.flatnonzero(sizes == n)
        if len(short):
            out.append(window_hashes(hashes, n, 0x1000 + n)[starts[short]])
            of.append(short)
    order = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(out)[order], np.concatenate(of)[order]


def _bands(width: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mult = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for t in tables(batches):
            hashes, starts = flat(t.column("w"))
            grams, of = shingles(hashes, starts, width)
            full = np.unique(of)
            firsts = np.searchsorted(of, full)
            out = np.zeros((len(full), bands), np.int64)
            with np.errstate(over="ignore"):
                for j in range(bands) if len(full) else ():
                    h = np.full(len(full), j, np.uint64)
                    for k in range(j * rows, (j + 1) * rows):
                        h = mix(h * np.uint64(31) + np.minimum.reduceat(grams * mult[k] + add[k], firsts))
                    out[:, j] = h.view(np.int64)
            sizes = np.zeros(t.num_rows + 1, np.int32)
            sizes[full + 1] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("tk").combine_chunks(), lists], ["doc_id", "tk", "bands"])
    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text key and task: copies of a text within a task are the same text."""
    seen: set[bytes] = set()
    for b in batches:
        keys = b.column("tk").to_pylist()
        take = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                take.append(i)
        if take:
            yield b.take(pa.array(take, pa.int64()))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by key."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        k = t.column(key).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over the values that occur twice or more."""
    m = len(sets)
    values = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    uniq, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(uniq), -1, np.int64)
    place[shared] = np.arange(len(shared))
    col = place[inverse]
    of, col = of[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    out = np.zeros((m, m), np.float32)
    for at in range(0, len(shared), columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        x = np.zeros((m, min(columns, len(shared) - at)), np.float32)
        x[of[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _links(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _runs(batches, "g"):
            g = whole.column("g").to_numpy()
            cuts = np.flatnonzero(np.diff(g)) + 1
            found = []
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(g)]]), strict=True):
                t = whole.slice(lo, hi - lo)
                tid = t.column("tid").to_numpy()
                _, first = np.unique(tid, return_index=True)
                if len(first) < 2:
                    continue
                t, tid = t.take(pa.array(first)), tid[first]
                found.append(_group(t, tid, width, similarity))
            found = [f for f in found if f is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["tid", "other", "links"])
    return run


def _group(t: pa.Table, tid: np.ndarray, width: int, similarity: float):
    hashes, starts = flat(t.column("w"))
    grams, of = shingles(hashes, starts, width)
    sets = [np.unique(x) for x in np.split(grams, np.searchsorted(of, np.arange(1, len(tid))))]
    sizes = np.array([len(s) for s in sets], np.float64)
    block, key, i, j = (t.column(c).to_numpy() for c in ("block", "key", "i", "j"))
    both = _intersections(sets)
    # exactly: both / union >= similarity
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    if i[0] != j[0]:
        near &= block[:, None] != block[None, :]     # pairs inside a block are compared where the block meets itself
    # a pair that shares an earlier bucket was compared there
    earlier = [np.asarray([k for k in ks if k < key[0]], np.int64) for ks in t.column("keys").to_pylist()]
    if any(len(e) for e in earlier):
        u, inv = np.unique(np.concatenate(earlier), return_inverse=True)
        m = np.zeros((len(tid), len(u)), np.float32)
        m[np.repeat(np.arange(len(tid)), [len(e) for e in earlier]), inv] = 1
        near &= ~((m @ m.T) > 0)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    links = near @ t.column("copies").to_numpy().astype(np.float64)
    label = tid.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    return tid[rows], label[rows], links[rows].astype(np.int64)


def text_classes(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tk, bands) of all documents, and one row per different text: tid, tk, bands, copies. Both are written."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("tk"), word_hashes(text).alias("w"))
    rowset = stored(named.mapInArrow(_bands(width, bands, rows, seed), "doc_id long, tk binary, bands array<long>"), "join-rows")
    texts = rowset.groupBy("tk").agg(F.max("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    return rowset, stored(texts.withColumn("tid", F.monotonically_increasing_id()), "join-texts")


def jaccard_links(docs: DataFrame, texts: DataFrame, text: str, width: int, similarity: float, block_rows: int) -> DataFrame:
    """tid, other, links: one row for each text and task in which it has a link."""
    buckets = texts.select("tid", F.posexplode("bands").alias("p", "h")).select("tid", F.xxhash64("p", "h").alias("key"))
    sums = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("f1"),
                                      F.sum(F.xxhash64("tid", F.lit(1)).cast("decimal(38,0)")).alias("f2")).filter("n > 1")
    kept = sums.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key", "n")
    members = stored(buckets.join(kept, "key").withColumn("n_blocks", F.ceil(F.col("n") / block_rows).cast("int")), "join-members")
    active = members.groupBy("tid").agg(F.collect_list(F.struct("key", "n_blocks")).alias("at"))    # no more entries than bands
    small = texts.select("tid", "tk", "copies").join(active, "tid")
    pieces = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("tk"), F.col(text).alias("body")).mapInArrow(_first_of_each, "tk binary, body string")
    whole = (pieces.join(small, "tk").withColumn("keys", F.col("at")["key"]).select("tid", "copies", "body", "keys", F.explode("at").alias("b"))
             .select("tid", "copies", "body", "keys", F.col("b.key").alias("key"), F.col("b.n_blocks").alias("n_blocks"))
             .withColumn("block", F.pmod(F.xxhash64("tid", F.lit(7)), F.col("n_blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    tasks = (whole.withColumn("g", F.xxhash64("key", "i", "j")).repartition("g").sortWithinPartitions("g")
             .select("g", "key", "i", "j", "block", "tid", "copies", "keys", word_hashes("body").alias("w")))
    return tasks.mapInArrow(_links(width, similarity), "tid long, other long, links long")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.9995,
                    most_hashes: int = 128, block_rows: int = 256, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of all documents joined by links), n_links, n_copies, tk.

    Two documents are linked if the sets of their ``width``-word n-grams have a Jaccard similarity of ``similarity`` or more; equal
    texts always are. n_links counts the other documents linked with this one, n_copies those among them with equal text. Words
    are runs of non-space characters, unchanged; a text of fewer than ``width`` words has one n-gram. Null, empty and blank texts
    have none and link to nothing but texts equal to them (null counts as empty). Null ids take part; a class of null ids only has a null class_id.
    Extra columns are ignored; an empty table gives no rows. Links are verified exactly, up to equal 64-bit n-gram hashes; a pair at
    the limit is found with probability ``recall``, more alike pairs with more."""
    small_batches(docs.sparkSession)
    bands, rows = banding(similarity, recall, most_hashes)
    rowset, texts = text_classes(docs, key, text, width, bands, rows, seed)
    links = stored(jaccard_links(docs, texts, text, width, similarity, block_rows), "join-links")
    roots = components(links.select(F.col("tid").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("tid").agg(F.sum("links").alias("links"))
    nodes = (texts.select("tk", "tid", "copies").join(roots.withColumnRenamed("id", "tid"), "tid", "left").join(counted, "tid", "left")
             .select("tk", F.coalesce("root", "tid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")))
    every = stored(rowset.select("doc_id", "tk").join(nodes, "tk"), "join-nodes")
    # written, so that a class of very many documents is a skewed join that Spark can split
    named = stored(every.groupBy("root").agg(F.min("doc_id").alias("class_id")), "join-classes")
    return every.join(named, "root").select("doc_id", "class_id", "n_links", "n_copies", "tk", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest key (null last), once."""
    classes = jaccard_classes(docs, key, text, **options)
    n_dk, n_tk = unused(docs, "j_dk", "j_tk")
    dk = F.coalesce(F.col(key).cast("string"), F.lit("~"))
    first = (classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("k"))
             .select(F.coalesce(F.col("k.doc_id").cast("string"), F.lit("~")).alias(n_dk), F.col("k.tk").alias(n_tk)))
    named = docs.withColumn(n_dk, dk).withColumn(n_tk, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return named.join(first, [n_dk, n_tk], "left_semi").dropDuplicates([n_dk, n_tk]).select(*docs.columns)
