"""Documents that contain benchmark items, also with other numbers, names and units.

Words become template words: a word with a digit, a capitalised word and a unit are typed placeholders, any other word is
itself without the punctuation at its end. Windows of template words are hash-joined with those of the benchmark. On one
diagonal (document place minus item place) every slot value of the item has to stand for one value of the document and the
reverse; windows that break this are dropped. A document is contaminated by an item if the windows left cover a share of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import in_document, owner, range_hashes, small_batches, stored, tables, unused, window_hashes, words

#: Unit words that a re-parameterised question may swap.
UNITS = ("mm cm m km in ft yd mi g mg kg t lb oz s ms min h hr hrs ml l w kw v a hz khz mhz ghz kb mb gb tb usd eur gbp "
         "percent meters metres meter metre miles feet inches hours minutes seconds days weeks years grams kilograms pounds ounces "
         "liters litres gallons dollars euros cents degrees").split()
UNIT_SET = frozenset(UNITS)
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Words that a short item has at least to be found inside a longer document, and words that are no placeholders that it needs there unless all are equal.
INSIDE_WORDS, INSIDE_FREE = 3, 3
INK = r"[^\x20\x09-\x0D]"
WORD = re.compile(rf"{INK}+")


PUNCTUATION = ".,;:!?)\"'"
NUMBER = re.compile("[0-9]")


def template_word(word: str) -> str:
    """A typed placeholder, or the word without the punctuation at its end."""
    if NUMBER.search(word):
        return NUM
    letter = next((c for c in word if c.isalpha()), "")
    if letter.isupper():
        return NAME
    bare = word.rstrip(PUNCTUATION) if letter else word
    return UNIT if bare in UNIT_SET else bare


def template_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of ``template_word`` of each word, by Arrow kernels over the whole array."""
    number = pc.match_substring_regex(words, "[0-9]")
    letter = pc.match_substring_regex(words, r"\p{L}")
    name = pc.match_substring_regex(words, r"^\P{L}*\p{Lu}")
    bare = pc.if_else(letter, pc.utf8_rtrim(words, characters=PUNCTUATION), words)
    typed = pc.if_else(pc.is_in(bare, value_set=pa.array(UNITS)), pa.scalar(UNIT), bare)
    out = pc.if_else(number, pa.scalar(NUM), pc.if_else(name, pa.scalar(NAME), typed))
    at = np.frombuffer(out.buffers()[1], np.int32)[out.offset:out.offset + len(out) + 1].astype(np.int64)
    raw = np.frombuffer(out.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return range_hashes(raw, at[:-1] - at[0], at[1:] - at[0])


class Templates:
    """64-bit hashes of template words of whole batches; a word is templated once for each batch that has it."""

    def hashes(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.ascii_split_whitespace(texts)        # the six ASCII white-space characters, as the word pattern has them
        flat_words, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
        flat_words, starts = flat_words.slice(starts[0], starts[-1] - starts[0]), starts - starts[0]
        coded = flat_words.dictionary_encode()
        own = template_hashes(coded.dictionary) if len(coded.dictionary) else np.zeros(0, np.uint64)
        keep = pc.not_equal(pc.binary_length(flat_words), 0).to_numpy(zero_copy_only=False)     # empty strings at the ends of a text
        before = np.concatenate([[0], np.cumsum(keep)])
        return own[coded.indices.to_numpy()][keep], before[starts]


def _windows(width: int):
    """Benchmark: one row for each window; items of fewer words have one window of all words, marked by place -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for t in tables(batches):
            hashes, starts = templates.hashes(t.column("body"))
            sizes = np.diff(starts)
            at = np.flatnonzero(in_document(starts, width))
            doc = owner(starts)[at]
            pos = at - starts[doc]
            h = window_hashes(hashes, width)[at]
            short = np.flatnonzero((sizes > 0) & (sizes < width))
            own = np.array([window_hashes(hashes[starts[i]:starts[i + 1]], int(sizes[i]), 0x77 + int(sizes[i]))[0] for i in short], np.uint64)
            doc, pos, h = np.concatenate([doc, short]), np.concatenate([pos, np.full(len(short), -1)]), np.concatenate([h, own])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), t.column("item_id").combine_chunks().take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(sizes[doc].astype(np.int32))],
                                             ["h", "item_id", "ipos", "n_item"])
    return run


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for b in batches:
            out[b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], ["bits"])
    return run


def _hits(width: int, bits: int, known, lengths: tuple[int, ...] = ()):
    """Documents: windows whose hash may be one of the benchmark's, with the words that stand there.

    ``lengths``: sizes of short items that are looked for inside longer documents; such a window at place p has place -2 - p."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, templates = np.frombuffer(known.value, np.uint8), Templates()
        for t in tables(batches):
            hashes, starts = templates.hashes(t.column("body"))
            sizes = np.diff(starts)
            at = np.flatnonzero(in_document(starts, width))
            h = window_hashes(hashes, width)[at]
            short = np.flatnonzero((sizes > 0) & (sizes < width))
            own = np.array([window_hashes(hashes[starts[i]:starts[i + 1]], int(sizes[i]), 0x77 + int(sizes[i]))[0] for i in short], np.uint64)
            doc = np.concatenate([owner(starts)[at], short])
            pos = np.concatenate([at - starts[owner(starts)[at]], np.full(len(short), -1)])
            h, size = np.concatenate([h, own]), np.concatenate([np.full(len(h), width), sizes[short]])
            for n in lengths:
                inner = np.flatnonzero(in_document(starts, n))
                inner = inner[sizes[owner(starts)[inner]] > n]
                place = owner(starts)[inner]
                doc, pos = np.concatenate([doc, place]), np.concatenate([pos, -2 - (inner - starts[place])])
                h, size = np.concatenate([h, window_hashes(hashes, n, 0x77 + n)[inner]]), np.concatenate([size, np.full(len(inner), n)])
            cell = (h >> np.uint64(64 - bits)).astype(np.int64)
            ok = np.flatnonzero((table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
            if not len(ok):
                continue
            doc, pos, h, size = doc[ok], pos[ok], h[ok], size[ok]
            split = {i: WORD.findall(t.column("body")[int(i)].as_py()) for i in np.unique(doc)}
            first = np.where(pos < -1, -2 - pos, np.maximum(pos, 0))
            stand = [split[d][p:p + n] for d, p, n in zip(doc, first, size, strict=True)]
            if lengths:      # a short item that stands in a document again with the same words says nothing new
                seen, new = set(), []
                for i in range(len(doc)):
                    k = (doc[i], h[i], *stand[i]) if pos[i] < -1 else i
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                doc, pos, h, stand = doc[new], pos[new], h[new], [stand[i] for i in new]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), t.column("row").combine_chunks().take(pa.array(doc)), t.column("doc_id").combine_chunks().take(pa.array(doc)),
                                              t.column("tk").combine_chunks().take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(stand, pa.list_(pa.string()))],
                                             ["h", "row", "doc_id", "tk", "dpos", "dwords"])
    return run


def _slots(mine: list[str], theirs: list[str]) -> list[tuple[str, str]]:
    """Pairs of values at the places where the two windows show different words; equal template words need no slot."""
    return [(_value(a), _value(b)) for a, b in zip(mine, theirs, strict=True)]


def _value(word: str) -> str:
    return word.strip(".,;:!?()\"'")


def consistent(pairs: list[list[tuple[str, str]]], strict: list[bool]) -> list[bool]:
    """Which windows of one diagonal keep one document value for every item value, and the reverse, by majority of the windows.

    ``strict`` windows have fewer than two words that are no placeholders; they need equal words."""
    seen = Counter(p for window in pairs for p in window)
    to, back = {}, {}
    for (a, b), _ in sorted(seen.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0])):
        if a not in to and b not in back:
            to[a], back[b] = b, a
    return [all(to.get(a) == b for a, b in window) and (not s or all(a == b for a, b in window)) for window, s in zip(pairs, strict, strict=True)]


def _placeholder(word: str) -> bool:
    return template_word(word) in (NUM, NAME, UNIT)


def _decide(width: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out = []
        for b in batches:
            for r in b.to_pylist():
                if (k := (r["row"], r["item_id"])) != now:
                    if rows:
                        out.append(verdict(rows, width, coverage))
                    now, rows = k, []
                rows.append(r)
        if rows:
            out.append(verdict(rows, width, coverage))
        out = [o for o in out if o]
        yield pa.RecordBatch.from_pylist(out, SCHEMA)
    return run


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_covered", pa.int64()), ("n_item", pa.int64()), ("changed", pa.bool_()), ("tk", pa.binary())])


def inside(item: list[str], pairs: list[tuple[str, str]]) -> bool:
    """Whether a short item counts where it stands inside a longer document."""
    return all(a == b for a, b in pairs) or sum(not _placeholder(w) for w in item) >= INSIDE_FREE


def verdict(rows: list[dict], width: int, coverage: float) -> dict | None:
    """Windows of one document and one item: the contaminated row, or None."""
    n = rows[0]["n_item"]
    diagonals = defaultdict(list)
    for r in rows:
        if (r["ipos"] < 0) == (r["dpos"] < 0):
            diagonals[r["dpos"] - r["ipos"]].append(r)
    covered, windows, changed = set(), 0, False
    for own in diagonals.values():
        pairs = [_slots(r["iwords"], r["dwords"]) for r in own]
        free = [sum(not _placeholder(a) for a in r["iwords"]) for r in own]
        for r, p, ok in zip(own, pairs, consistent(pairs, [f < 2 for f in free]), strict=True):
            if ok and (r["dpos"] >= -1 or inside(r["iwords"], p)):
                windows += 1
                covered.update(range(max(r["ipos"], 0), min(n, max(r["ipos"], 0) + width)))
                changed |= any(a != b for a, b in p)
    if len(covered) < coverage * n:
        return None
    return {"doc_id": rows[0]["doc_id"], "item_id": rows[0]["item_id"], "n_windows": windows, "n_covered": len(covered), "n_item": n, "changed": changed, "tk": rows[0]["tk"]}


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, coverage: float = 0.5, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", most_bits: int = 28) -> DataFrame:
    """One row for each document row and benchmark item that it contains: doc_id, item_id, n_windows, n_covered, n_item, changed, tk.

    An item is contained if consistent template windows of ``width`` words cover ``coverage`` of its words or more; ``changed``
    tells that slot values differ. Items of fewer words match documents whose whole template equals theirs; those of three words or more
    also match inside longer documents, where the words have to be equal or three of them no placeholders. Null, empty and blank
    texts contain nothing and are contained nowhere; null keys take part. Repeated documents each get their rows; an empty table on
    either side gives no rows; extra columns are ignored.

    ``most_bits`` bounds the bitmap of known window hashes that every task gets, 32 MB by default; with a larger benchmark more
    windows pass it and the join behind it decides alone, with the same result. The join's sides are Spark's to choose."""
    small_batches(docs.sparkSession, 500)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("body")).distinct()
    plain = items.select("item_id", "body").mapInArrow(_windows(width), "h long, item_id long, ipos int, n_item int")
    known = stored(plain.join(items.withColumnRenamed("item_id", "i_id"), F.col("item_id").eqNullSafe(F.col("i_id")))
                   .withColumn("iwords", F.when(F.col("ipos") < 0, words("body")).otherwise(F.slice(words("body"), F.col("ipos") + 1, width)))
                   .select("h", "item_id", "ipos", "n_item", "iwords"), "bench-windows")
    bits = int(min(most_bits, max(10, math.ceil(math.log2(16 * max(1, known.count()))))))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in known.select("h").coalesce(4).mapInArrow(_bitmap(bits), "bits binary").collect():
        table |= np.frombuffer(r["bits"], np.uint8)
    lengths = tuple(sorted(r["n_item"] for r in known.filter((F.col("ipos") < 0) & (F.col("n_item") >= INSIDE_WORDS)).select("n_item").distinct().collect()))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    hashed = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body", F.unhex(F.sha2("body", 256)).alias("tk"))
    hits = hashed.mapInArrow(_hits(width, bits, spark.sparkContext.broadcast(table.tobytes()), lengths), "h long, row long, doc_id long, tk binary, dpos int, dwords array<string>")
    pairs = hits.join(known, "h").withColumn("g", F.xxhash64("row", "item_id"))
    return (pairs.repartition("g").sortWithinPartitions("g", "row", "item_id")
            .mapInArrow(_decide(width, coverage), "doc_id long, item_id long, n_windows long, n_covered long, n_item long, changed boolean, tk binary"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark``, with the columns of ``docs``."""
    (name,) = unused(docs, "d_tk")
    bad = contaminated(docs, benchmark, key=key, text=text, **options).select(F.col("tk").alias(name)).distinct()
    named = docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return named.join(bad, name, "left_anti").select(*docs.columns)
