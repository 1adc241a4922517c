"""Near-duplicate components by an inverted join on MinHash signature coordinates.

1. A text becomes the set of its word shingles; equal sets are one node. A node's signature has one minimum a coordinate.
2. A posting is a coordinate and its value. Two sets of similarity s agree in about s of all coordinates, so a pair with fewer
   than ``least`` collisions is no link. Ordered from rare to common, two nodes with ``least`` collisions share a posting
   within their first ``coordinates - least + 1`` ones: only that prefix of each node is posted, and values that no other node
   has fill it first. Postings with the same members are merged into one.
3. Nodes of a posting meet its most central member, then the next ones. Collisions are counted in stretches of coordinates,
   and a pair is skipped once the rest can't lift it to ``least``; pairs that pass are confirmed on full sets. A posting whose members
   are all in one component is done. This makes one pair a member and round, never all pairs.
4. What is left of larger postings is cut into blocks of bounded rows and shingles; two blocks are one task, which compares members
   of different components only, tile by tile, and returns one link for each union it makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.components import components
from aeroframe.llm.ngram_join import _intersections as intersections
from aeroframe.llm.ngram_join import shingles
from aeroframe.llm.text import flat, mix, range_hashes, small_batches, stored, tables, unused

#: Nodes whose texts are fetched by a broadcast of their keys; more are joined by a shuffle.
SENT_NODES = 500_000


def least_collisions(similarity: float, coordinates: int, miss: float) -> int:
    """The most collisions that a pair at ``similarity`` reaches but for a chance of ``miss``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def text_key(text: str) -> list[Column]:
    """Two hashes and the length of a text: equal texts have equal keys."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.shiftleft(F.crc32(F.encode(whole, "UTF-8")), 31).bitwiseXOR(F.octet_length(whole).cast("long")).alias("k2")]


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lower-cased, and the starts of the texts; each different word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))      # the six characters that end a word
    words, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
    words, starts = words.slice(starts[0], starts[-1] - starts[0]), starts - starts[0]
    keep = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)      # empty strings at the ends of a text
    coded = words.dictionary_encode()
    names = coded.dictionary
    if not len(names):
        return np.zeros(0, np.uint64), starts
    at = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1].astype(np.int64)
    raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    own = range_hashes(raw, at[:-1] - at[0], at[1:] - at[0])
    return own[coded.indices.to_numpy()][keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _unique(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each document, sorted, and the document of each."""
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def _signatures(width: int, coordinates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mult = rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for t in tables(batches):
            grams, of = _unique(*shingles(*word_values(t.column("body").combine_chunks()), width))
            full, firsts, sizes = np.unique(of, return_index=True, return_counts=True)
            n, s1, s2 = (np.zeros(t.num_rows, np.int64) for _ in range(3))
            sig = np.zeros((len(full), coordinates), np.int64)
            if len(full):
                with np.errstate(over="ignore"):
                    n[full] = sizes
                    s1[full] = np.add.reduceat(mix(grams + np.uint64(1)), firsts).view(np.int64)
                    s2[full] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), firsts).view(np.int64)
                    for c in range(coordinates):
                        # a product by an odd number permutes, its high bits depend on all lower ones: the shift keeps equal minima rare
                        h = grams * mult[c]
                        sig[:, c] = mix(np.minimum.reduceat(h ^ (h >> np.uint64(29)), firsts) + np.uint64(c + 1)).view(np.int64)
            counts = np.zeros(t.num_rows + 1, np.int32)
            counts[full + 1] = coordinates
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "k1", "k2")), pa.array(n), pa.array(s1), pa.array(s2), lists],
                                             ["doc_id", "k1", "k2", "n", "s1", "s2", "sig"])
    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node and task: a node's copies in a task have the same shingles."""
    seen: set[int] = set()
    for b in batches:
        take = []
        for i, k in enumerate(b.column("tid").to_pylist()):
            if k not in seen:
                seen.add(k)
                take.append(i)
        if take:
            yield b.take(pa.array(take, pa.int64()))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            grams, of = _unique(*shingles(*word_values(t.column("body").combine_chunks()), width))
            starts = np.searchsorted(of, np.arange(t.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.column("tid").combine_chunks(), pa.ListArray.from_arrays(pa.array(starts), pa.array(grams.view(np.int64)))], ["tid", "grams"])
    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, given as arrays of different values, have that similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            (x, at), (y, to) = flat(t.column("x")), flat(t.column("y"))
            good = [i for i in range(t.num_rows) if alike(x[at[i]:at[i + 1]], y[to[i]:to[i + 1]], percent)]
            yield t.select(["a", "b"]).take(pa.array(good, pa.int64())).combine_chunks().to_batches()[0] if good else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    return run


def collide(x: str, y: str, coordinates: int, least: int, stretch: int = 16) -> Column:
    """Whether two signatures have ``least`` collisions; the next stretch is only counted for pairs that it can lift so far."""
    ok = F.lit(True)
    for end in [*range(stretch, coordinates, stretch), coordinates]:
        ok = ok & (F.size(F.array_intersect(F.slice(x, 1, end), F.slice(y, 1, end))) + (coordinates - end) >= least)
    return ok


def postings(nodes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """key, tid, central: prefix postings of two or more nodes, of those with the same members one; written.

    ``central`` sums over all of a node's coordinates how many nodes share them."""
    values = nodes.select("tid", F.explode("sig").alias("key"))
    often = stored(values.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-counts")
    # at most ``coordinates`` entries a node
    own = values.join(often, "key").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("at"), F.sum("n").alias("central"))
    single = F.lit(coordinates) - F.size("at")
    shared = stored(own.select("tid", "central", F.explode(F.slice("at", F.lit(1), F.greatest(F.lit(0), F.lit(coordinates - least + 1) - single))).alias("p"))
                    .select(F.col("p.key").alias("key"), "tid", "central"), "near-prefixes")
    return stored(shared.join(alone(shared), "key", "left_semi"), "near-postings")


def alone(members: DataFrame) -> DataFrame:
    """Keys of postings with two or more members, one for all postings with the same members."""
    sums = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("f1"),
                                      F.sum(F.xxhash64("tid", F.lit(1)).cast("decimal(38,0)")).alias("f2")).filter("n > 1")
    return sums.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.select(F.col("id").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def _blocks(coordinates: int, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            found = list(_unions(t, coordinates, least, percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one task group each, from batches sorted by group."""
    rest: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        g = t.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if rest and rest[0].column("g")[0].as_py() != g[lo]:
                yield pa.concat_tables(rest).combine_chunks()
                rest = []
            rest.append(t.slice(lo, hi - lo))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


class Labels:
    """Union of components within a task."""

    def __init__(self, root: np.ndarray):
        self.names, self.of = np.unique(root, return_inverse=True)
        self.parent = np.arange(len(self.names))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def current(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent[self.of]

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(self.of[x]), self.find(self.of[y])
        self.parent[a] = b
        return a != b


def _unions(t: pa.Table, coordinates: int, least: int, percent: int, tile: int = 512) -> Iterator[tuple[int, int]]:
    """Links between components of a task's nodes, one for each union, tile by tile.

    Collisions of all pairs of a tile are counted first; only pairs that reach ``least`` and are not yet in one component go on, and
    the sizes of their intersections are exact products of 0/1 matrices. A pair that shares an earlier posting is compared there."""
    tid, block, key = (t.column(c).to_numpy() for c in ("tid", "block", "key"))
    labels = Labels(t.column("root").to_numpy())
    sig = flat(t.column("sig"))[0].reshape(-1, coordinates)
    grams, at = flat(t.column("grams"))
    across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    keys, to = flat(t.column("keys"))
    tiles = [np.arange(lo, min(lo + tile, len(tid))) for lo in range(0, len(tid), tile)]
    for n, rows in enumerate(tiles):
        for cols in tiles[n:]:
            now = labels.current()
            may = now[rows][:, None] != now[cols][None, :]
            if across:
                may &= block[rows][:, None] != block[cols][None, :]     # pairs inside a block are compared where the block meets itself
            if not may.any():
                continue
            hits = np.zeros(may.shape, np.uint8 if coordinates < 256 else np.uint16)
            for c in range(coordinates):
                hits += sig[rows, c][:, None] == sig[cols, c][None, :]
            may &= hits >= least
            use = np.unique(np.concatenate([rows[may.any(axis=1)], cols[may.any(axis=0)]]))
            if not len(use):
                continue
            may = may[np.ix_(np.isin(rows, use), np.isin(cols, use))]
            x, y = np.flatnonzero(np.isin(use, rows)), np.flatnonzero(np.isin(use, cols))
            mine = [keys[to[i]:to[i + 1]] for i in use]
            earlier = [k[k < key[0]] for k in mine]
            names, place = np.unique(np.concatenate(earlier), return_inverse=True)
            if len(names):
                m = np.zeros((len(use), len(names)), np.float32)
                m[np.repeat(np.arange(len(use)), [len(e) for e in earlier]), place] = 1
                may &= m[x] @ m[y].T == 0
                if not may.any():
                    continue
            sets = [grams[at[i]:at[i + 1]] for i in use]
            sizes = np.array([len(g) for g in sets], np.int64)
            both = np.rint(intersections(sets)[np.ix_(x, y)]).astype(np.int64)
            near = may & (100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both))
            for p, q in zip(*np.nonzero(near), strict=True):
                if labels.join(use[x[p]], use[y[q]]):
                    yield int(tid[use[x[p]]]), int(tid[use[y[q]]])


def node_roots(nodes: DataFrame, sets_of, coordinates: int, least: int, percent: int, rounds: int, block_rows: int, block_shingles: int) -> DataFrame:
    """id, root of every node that has a link; ``sets_of`` gives the full sets of a table of nodes."""
    members = postings(nodes, coordinates, least)
    sets = stored(sets_of(nodes.join(members.select("tid").distinct(), "tid").select("tid", "k1", "k2")), "near-sets")
    sig = nodes.select("tid", "n", "sig")
    left = lambda side, df: df.select(*[F.col(c).alias({"tid": side}.get(c, f"{side}_{c}")) for c in df.columns])
    members = members.withColumn("root", F.col("tid"))
    links, roots = None, None
    for _ in range(rounds):
        head = F.max(F.struct("central", (-F.col("tid")).alias("m"), "root"))
        lead = (members.groupBy("key").agg(head.alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
                .select("key", (-F.col("head.m")).alias("lead"), F.col("head.root").alias("lead_root")))
        met = stored(members.join(lead, "key").filter("tid <> lead"), "near-met")
        pairs = met.filter("root <> lead_root").select(F.least("tid", "lead").alias("a"), F.greatest("tid", "lead").alias("b")).distinct()
        sized = (pairs.join(left("a", sig), "a").join(left("b", sig), "b")
                 .filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")).filter(collide("a_sig", "b_sig", coordinates, least)).select("a", "b"))
        full = stored(sized, "near-pairs").join(sets.select(F.col("tid").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("tid").alias("b"), F.col("grams").alias("y")), "b")
        new = stored(full.mapInArrow(_confirm(percent), "a long, b long"), "near-links")
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        members = stored(rooted(met.select("key", "tid", "central"), roots), "near-members")
        if members.isEmpty():
            return roots
    # pairs of the members that have led a posting are all compared; whoever is left there in different components meets in blocks
    open_keys = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rest = members.join(open_keys, "key", "left_semi")
    rest = stored(rest.join(alone(rest), "key", "left_semi").join(nodes.select("tid", "n"), "tid"), "near-rest")
    if rest.isEmpty():
        return roots
    counts = rest.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    own = rest.groupBy("tid").agg(F.collect_list("key").alias("keys"))      # no more than a node's prefix
    dealt = (rest.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(7)), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("g", F.xxhash64("key", "i", "j")))
    bodies = own.join(sig.drop("n"), "tid").join(sets, "tid")
    tasks = dealt.join(bodies, "tid").repartition("g").sortWithinPartitions("g").select("g", "key", "i", "j", "block", "tid", "root", "keys", "sig", "grams")
    last = stored(tasks.mapInArrow(_blocks(coordinates, least, percent), "a long, b long"), "near-links")
    return components(links.unionByName(last))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, coordinates: int = 48, miss: float = 1e-6,
                    rounds: int = 2, block_rows: int = 4096, block_shingles: int = 4_000_000, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; A-Z count as lower case,
    a text of fewer words has one shingle of them all. component_id is the smallest id among the documents reached by links, kept
    tells whether it is the row's own. Null, empty and blank texts have no shingle and no link, and stay. Null ids take part; a
    component of null ids only has a null component_id and keeps its rows. Repeated rows are linked like other equal texts, and rows of
    one id are all kept if it is the smallest. Extra columns are ignored; no rows give no rows. Links are confirmed on full sets, up to
    equal 64-bit word and shingle hashes; a pair at the limit is missed with a chance of ``miss`` in its signature, more alike pairs less."""
    small_batches(docs.sparkSession)
    least = least_collisions(percent / 100, coordinates, miss)
    named = docs.select(F.col(key).alias("doc_id"), *text_key(text), F.col(text).alias("body"))
    kind = named.schema["doc_id"].dataType.simpleString()
    rows = stored(named.mapInArrow(_signatures(width, coordinates, seed), f"doc_id {kind}, k1 long, k2 long, n long, s1 long, s2 long, sig array<long>"), "near-rows")
    same = ["s1", "s2", "n"]
    # any of the texts of a node has its shingles
    nodes = rows.filter("n > 0").groupBy(*same).agg(F.min(F.struct("k1", "k2")).alias("k"), F.max("sig").alias("sig"))
    nodes = stored(nodes.select(*same, "k.k1", "k.k2", "sig").withColumn("tid", F.monotonically_increasing_id()), "near-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = stored(wanted, "near-wanted")
        few = F.broadcast(wanted) if wanted.count() <= SENT_NODES else wanted
        bodies = docs.select(*text_key(text), F.col(text).alias("body")).join(few, ["k1", "k2"]).select("tid", "body")
        one = bodies.mapInArrow(_first_of_each, "tid long, body string").dropDuplicates(["tid"])
        return one.mapInArrow(_sets(width), "tid long, grams array<long>")

    roots = node_roots(nodes, sets_of, coordinates, least, percent, rounds, block_rows, block_shingles)
    of = nodes.select(*same, "tid").join(roots.withColumnRenamed("id", "tid"), "tid", "left").select(*same, F.coalesce("root", "tid").alias("root"))
    every = stored(rows.filter("n > 0").select("doc_id", *same).join(of, same), "near-classes")
    smallest = stored(every.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-smallest")
    linked = every.join(smallest, "root").select("doc_id", "n", "component_id")
    bare = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, in their own columns; null ids stay."""
    (n_id,) = unused(docs, "n_id")
    keep = near_components(docs, key, text, **options).filter("kept").select(F.col("doc_id").alias(n_id)).distinct()
    return docs.join(keep, docs[key].eqNullSafe(F.col(n_id)), "left_semi").select(*docs.columns)
