"""Removal of word windows that occur more than once, behind a count-min prefilter.

Pass one. Every 35-word window is represented by one of its k-word pieces, the one with the smallest hash; equal windows
choose equal pieces, at equal offsets. Each task counts the places of its pieces in cells of a count-min sketch; the
sketches of all tasks are merged by cell range. A cell's count is at least the number of starts of every window whose piece
falls into it, so the sketch overestimates window counts and a window with a cell below two occurs once.
Pass two. Only windows whose cells all reach two are grouped, by a 96-bit hash of all their words; those found twice are
repeated. Windows found twice within a task are known there and sent once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.text import flat, in_document, mix, n_words, owner, small_batches, stored, tables, window_hashes, word_hashes

#: Cells that one merging task holds: 2 ** SEGMENT_BITS.
SEGMENT_BITS = 22


def piece_places(hashes: np.ndarray, starts: np.ndarray, width: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows that fit into their document: their places, and the place and hash of the piece that represents each."""
    at = np.flatnonzero(in_document(starts, width))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    h = window_hashes(hashes, piece, 0xC2B2AE3D27D4EB4F)
    n = width - piece + 1
    # the leftmost smallest hash of every run of n places, by doubling; ties go to the left
    best, size = np.arange(len(h)), 1
    while size * 2 <= n:
        best = _lower(h, best, size)
        size *= 2
    if size < n:
        best = _lower(h, best, n - size)
    place = best[at]
    return at, place, h[place]


def _lower(h: np.ndarray, best: np.ndarray, shift: int) -> np.ndarray:
    other = np.concatenate([best[shift:], np.full(min(shift, len(best)), len(best) - 1)])
    return np.where(h[other] < h[best], other, best)


def cells(h: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """depth x len(h) cell numbers below 2 ** bits."""
    return np.stack([mix(h + np.uint64(0x9E3779B9 * (d + 1))) >> np.uint64(64 - bits) for d in range(depth)])


def _sketch(width: int, piece: int, depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            hashes, starts = flat(t.column("w"))
            _, place, h = piece_places(hashes, starts, width, piece)
            _, first = np.unique(place, return_index=True)
            for d, c in enumerate(cells(h[first], depth, bits)):
                own, counts = np.unique(c, return_counts=True)
                segment = own >> np.uint64(SEGMENT_BITS)
                cuts = np.flatnonzero(np.diff(segment)) + 1
                parts = [(int(s[0]), (o & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4").tobytes(), np.minimum(k, 2).astype(np.uint8).tobytes())
                         for s, o, k in zip(np.split(segment, cuts), np.split(own, cuts), np.split(counts, cuts), strict=True) if len(o)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()),
                                                      pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["d", "segment", "cells", "counts"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (d, segment): adds the sketches of a segment, cell by cell, and returns which cells reach two."""
    now, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["d", "segment", "bits"])
    for b in batches:
        for d, s, c, k in zip(*(b.column(x).to_pylist() for x in ("d", "segment", "cells", "counts")), strict=True):
            if (d, s) != now:
                if now is not None:
                    yield done()
                now, total = (d, s), np.zeros(1 << SEGMENT_BITS, np.uint8)
            own = np.frombuffer(c, "<u4")
            total[own] = np.minimum(total[own] + np.frombuffer(k, np.uint8), 2)
    if now is not None:
        yield done()


def sketch_bits(n_pieces: int, most_bits: int) -> int:
    """About four cells for every counted piece, within what a task can hold."""
    return int(min(most_bits, max(SEGMENT_BITS, math.ceil(math.log2(max(1, n_pieces) * 4)))))


NAMES = ["h1", "h2", "row", "pos", "more"]


def _candidates(width: int, piece: int, depth: int, bits: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = [np.frombuffer(b, np.uint8) for b in sketch.value]
        for t in tables(batches):
            hashes, starts = flat(t.column("w"))
            at, place, h = piece_places(hashes, starts, width, piece)
            if not len(at):
                continue
            pieces, which = np.unique(place, return_inverse=True)
            hp = window_hashes(hashes, piece, 0xC2B2AE3D27D4EB4F)[pieces]
            ok = np.ones(len(pieces), bool)
            for d, c in enumerate(cells(hp, depth, bits)):
                c = c.astype(np.int64)
                ok &= (twice[d][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            at = at[ok[which]]
            if not len(at):
                continue
            h1, h2 = window_hashes(hashes, width, 0x165667B19E3779F9)[at], window_hashes(hashes, width, 0x27D4EB2F165667C5)[at]
            order = np.lexsort((h2, h1))
            new = np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])
            run_of = np.cumsum(new) - 1
            many, head = np.empty(len(order), bool), np.zeros(len(order), bool)
            many[order] = np.bincount(run_of)[run_of] > 1
            head[order[new]] = True
            doc = owner(starts)[at]
            row = t.column("row").to_numpy()[doc]
            pos = (at - starts[doc]).astype(np.int32)
            # one row for each different window of the batch, in text order; its place is negative if the batch has the window twice
            n = int(head.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h1[head].view(np.int64)), pa.array(h2[head].astype(np.uint32).view(np.int32)), pa.array(row[head]),
                                              pa.array(np.where(many, -1 - pos, pos)[head]), pa.nulls(n, pa.list_(pa.int32()))], NAMES)
            # the other places of such windows are settled: one row for each document, under a key of its own
            if n < len(order):
                rest = np.flatnonzero(~head)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(row[rest])) + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([cuts, [len(rest)]]).astype(np.int32)), pa.array(pos[rest]))
                own = row[rest][cuts]
                yield pa.RecordBatch.from_arrays([pa.array(mix(own.astype(np.uint64)).view(np.int64)), pa.nulls(len(own), pa.int32()), pa.array(own), pa.nulls(len(own), pa.int32()), lists], NAMES)
    return run


def repeated_starts(numbered: DataFrame, width: int = 35, piece: int = 12, depth: int = 3, most_bits: int = 31) -> DataFrame:
    """row and places (pos, or more than one in ``more``) of every window of ``numbered`` (row, n_words, w) whose words also start anywhere else."""
    spark = numbered.sparkSession
    n = numbered.agg(F.sum(F.greatest(F.lit(0), F.col("n_words") - width + 1).cast("long")).alias("n")).first()["n"] or 0
    bits = sketch_bits(math.ceil(2 * n / (width - piece + 2)), most_bits)
    merged = (numbered.select("w").mapInArrow(_sketch(width, piece, depth, bits), "d int, segment int, cells binary, counts binary")
              .repartition("d", "segment").sortWithinPartitions("d", "segment").mapInArrow(_merge, "d int, segment int, bits binary"))
    size = 1 << (SEGMENT_BITS - 3)
    sketch = [bytearray(size << (bits - SEGMENT_BITS)) for _ in range(depth)]
    for r in merged.collect():      # as large as the sketch, whose size most_bits bounds
        sketch[r["d"]][r["segment"] * size:(r["segment"] + 1) * size] = r["bits"]
    found = numbered.select("row", "w").mapInArrow(_candidates(width, piece, depth, bits, spark.sparkContext.broadcast([bytes(s) for s in sketch])), "h1 long, h2 int, row long, pos int, more array<int>")
    # a window comes once from each batch at most, so no key has more rows than there are batches
    counted = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2")))
    return counted.filter((F.col("n") > 1) | (F.col("pos") < 0) | F.col("pos").isNull()).select("row", F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "more")


def row_marks(at: DataFrame, most_bits: int = 27) -> bytes:
    """A bitmap, 16 MB at most, of the hashes of the rows that lose words: rows it does not mark need no join. A full one marks more rows, never fewer."""
    bits = int(min(most_bits, max(10, math.ceil(math.log2(16 * max(1, at.count()))))))
    out = np.zeros(1 << (bits - 3), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            own[b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])
    for r in at.select(F.xxhash64("row").alias("h")).coalesce(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _on(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Which rows of a batch (hash ``h`` of the row) the bitmap marks."""
    bits = (len(table) * 8).bit_length() - 1
    cell = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return ((table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1) == 1


def _marked(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(_on(b, table))).select(["row", "doc_id", "text"])
    return run


OUT = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]


def _results(keys: pa.Array, n: list[int], removed: list[int], kept: list[bytes]) -> pa.RecordBatch:
    texts = pc.cast(pa.array(kept, pa.binary()), pa.string(), safe=False)
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), texts, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], OUT)


def _untouched(marks):
    """Texts of rows that the bitmap doesn't mark lose nothing: their words, counted and joined, byte by byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(~_on(b, table)))
            # white space of byte strings is the six characters that end a word
            split = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield _results(b.column("doc_id"), [len(w) for w in split], [0] * len(split), [b" ".join(w) for w in split])
    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, at in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("at").to_pylist(), strict=True):
                ws = (text or b"").split()
                gone = np.zeros(len(ws) + 1, np.int64)
                if at:
                    p = np.asarray(at, np.int64)
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + width, -1)
                keep = np.cumsum(gone)[:-1] == 0
                n.append(len(ws))
                removed.append(int(len(ws) - keep.sum()))
                kept.append(b" ".join(compress(ws, keep.tolist()) if at else ws))
            yield _results(b.column("doc_id"), n, removed, kept)
    return run


def remove_repeats(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", piece: int = 12, depth: int = 3, most_bits: int = 31) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.

    A word goes if a window of ``width`` words that covers it also starts anywhere else, in the same text or another one. Windows
    are judged on the input. Texts of fewer words, null, empty and blank texts lose nothing; repeated rows count as other places.
    Extra columns are ignored; keys may be null or repeated; an empty table gives no rows.

    ``most_bits`` bounds the sketch: depth * 2 ** (most_bits - 3) bytes, at most 768 MB by default. A corpus that outgrows it fills
    the cells, more windows go to the exact pass, and the result stays the same."""
    small_batches(docs.sparkSession, 500)
    numbered = stored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), n_words(text).alias("n_words")).withColumn("row", F.monotonically_increasing_id()), "substring-rows")
    hashed = numbered.select("row", "n_words", word_hashes("text").alias("w"))
    starts = repeated_starts(hashed, width, piece, depth, most_bits)
    at = stored(starts.groupBy("row").agg(F.collect_list("pos").alias("one"), F.collect_list("more").alias("more"))       # no more than the words of one document
                .select("row", F.concat("one", F.flatten("more")).alias("at")), "substring-places")
    kind = docs.schema[key].dataType.simpleString()
    marked = docs.sparkSession.sparkContext.broadcast(row_marks(at))
    given = numbered.select("row", "doc_id", "text", F.xxhash64("row").alias("h"))
    out = "doc_id {}, n_words long, n_removed long, kept_text string, kept_sha256 string".format(kind)
    hit = given.mapInArrow(_marked(marked), f"row long, doc_id {kind}, text string").join(at, "row", "left").select("doc_id", "text", "at")
    return hit.mapInArrow(_cut(width), out).unionByName(given.mapInArrow(_untouched(marked), out))
