"""Raw id files with a minimal perfect hash index from document keys to shard and offset.

A store is a folder: ``ids/shard-NNNNN.bin`` holds nothing but ids, little endian, two bytes each if the vocabulary allows it
and four if not, documents in ascending key order, each closed by the end id; ``index`` is a Parquet table with one row for
each bucket of keys. A bucket's row holds the displacements of its hash function and, for each slot, the key's fingerprint,
shard, offset and length, so a key needs its bucket, one displacement and one slot, whatever the size of the store.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroframe.llm.text import mix, shared_folder, small_batches

SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u8")])
STEP = 0xD6E8FEB86659FD93


def filesystem(path: str):
    """The file system of a path or URI, and the path in it, for a Python worker."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _write(folder: str, tokenizer: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from aeroframe.llm.tokens import encoder
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        files, root = filesystem(folder)
        draft, out, start, last, copies = f"{root}/ids/_draft-{shard:05d}-{uuid.uuid4().hex}", None, 0, object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                files.create_dir(f"{root}/ids", recursive=True)
                out = files.open_output_stream(draft)
            ids, at = encode(pa.array(b.column("body").to_pylist(), pa.string()) if b.column("body").null_count else b.column("body").cast(pa.string()))
            n = np.diff(at) + 1
            closed = np.full(int(n.sum()), end_id, kind)
            closed[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            out.write(closed.tobytes())
            copy = np.zeros(len(n), np.int64)
            for i, k in enumerate(b.column("doc_id").to_pylist()):
                copies = copies + 1 if k == last else 0
                copy[i], last = copies, k
            starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(copy), pa.array(np.full(len(n), shard, np.int32)), pa.array(starts), pa.array(n)], ["doc_id", "copy", "shard", "start", "n"])
        if out is not None:     # whole files only get their name; a task that runs again writes the same bytes
            out.close()
            files.move(draft, f"{root}/ids/shard-{shard:05d}.bin")
    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """``copy`` counted over shards: rows with one key that runs over the end of a shard go on counting."""
    edges = rows.groupBy("shard").agg(F.min(F.struct("start", "doc_id")).alias("a"), F.max(F.struct("start", "doc_id")).alias("z"))
    twice = edges.select(F.explode(F.array_distinct(F.array("a.doc_id", "z.doc_id"))).alias("k")).groupBy("k").count().filter("count > 1").select("k")
    runs = rows.join(twice, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi").groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select(F.col("doc_id").alias("c_id"), F.col("shard").alias("c_shard"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("carry")).filter("carry > 0")
    return (rows.join(carry, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("shard") == F.col("c_shard")), "left")
            .select("doc_id", (F.col("copy") + F.coalesce("carry", F.lit(0))).alias("copy"), "shard", "start", "n"))


def hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Two hashes of (doc_id, copy) and the bucket."""
    cols = [F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("copy")]
    return keys.withColumn("h1", F.xxhash64(*cols)).withColumn("h2", F.xxhash64(F.lit(5), *cols)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(9), *cols), F.lit(buckets)).cast("int"))


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of different keys: displacements by group, and the slot of every key.

    Groups of about four keys, large ones first, try displacements until their slots are free; a group of one key gets a free
    slot by its number, stored below zero."""
    m = len(h1)
    n_groups = max(1, -(-m // 4))
    group = (h1.view(np.uint64) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n_groups + 1))
    sizes = np.diff(cuts)
    shift, slot, free = np.zeros(n_groups, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    for g in np.argsort(-sizes, kind="stable"):
        own = order[cuts[g]:cuts[g + 1]]
        if len(own) < 2:
            break
        at = 0
        while True:
            tries = places(h1[own][None, :], h2[own][None, :], np.arange(at, at + 32)[:, None], m)
            good = free[tries].all(axis=1)
            for d in np.flatnonzero(good):
                if len(np.unique(tries[d])) == len(own):
                    shift[g], slot[own] = at + d, tries[d]
                    free[tries[d]] = False
                    break
            else:
                at += 32
                continue
            break
    rest = iter(np.flatnonzero(free))
    for g in np.flatnonzero(sizes == 1):
        s = next(rest)
        shift[g], slot[order[cuts[g]]] = -1 - s, s
    return shift, slot


def places(h1: np.ndarray, h2: np.ndarray, shift: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.astype(np.int64).view(np.uint64) ^ mix(h2.astype(np.int64).view(np.uint64) + shift.astype(np.uint64) * np.uint64(STEP))
    return (mix(x) % np.uint64(m)).astype(np.int64)


def find(h1: np.ndarray, h2: np.ndarray, shift: np.ndarray, m: int) -> np.ndarray:
    """The slot of each key; of a key that is not in the index any slot."""
    s = shift[(h1.view(np.uint64) % np.uint64(len(shift))).astype(np.int64)]
    return np.where(s < 0, -1 - s, places(h1, h2, np.maximum(s, 0), m))


def mark(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1.view(np.uint64) ^ (h2.view(np.uint64) << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64)
    shift, slot = build(h1, h2)
    rows = np.zeros(len(pdf), SLOT)
    rows["mark"][slot], rows["shard"][slot], rows["start"][slot], rows["n"][slot] = mark(h1, h2), pdf["shard"], pdf["start"], pdf["n"]
    return pd.DataFrame({"bucket": [pdf.bucket.iloc[0]], "size": [len(pdf)], "shift": [shift.astype("<i8").tobytes()], "slots": [rows.tobytes()]})


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_bytes: int = 32 << 20, bucket_keys: int = 10_000) -> None:
    """Encodes every text of ``docs`` into a new store in ``folder``, on a file system that all workers reach."""
    spark = docs.sparkSession
    small_batches(spark)
    from tokenizers import Tokenizer
    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    named = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = named.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("body").asc(), F.col("body").asc()]
    ranged = named.repartitionByRange(max(1, math.ceil(total / shard_bytes)), *order[:2]).sortWithinPartitions(*order)
    kept = docs.schema[key].dataType.simpleString()
    ranged.mapInArrow(_write(folder, tokenizer, end_id, kind), f"doc_id {kept}, copy long, shard int, start long, n long").write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows") if total or docs.limit(1).count() else spark.createDataFrame([], f"doc_id {kept}, copy long, shard int, start long, n long")
    shards = rows.groupBy("shard").agg(F.sum("n").alias("n"))
    # one row a shard: the window is as small as the list of files
    shards.select("shard", "n", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lit(kind).alias("kind")).write.parquet(f"{folder}/shards")
    buckets = max(1, math.ceil(rows.count() / bucket_keys))
    (hashed(_numbered(rows), buckets).select("bucket", "h1", "h2", "shard", "start", "n").groupBy("bucket")
     .applyInPandas(_bucket, "bucket int, size long, shift binary, slots binary").withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index"))


INDEX = "bucket int, size long, shift binary, slots binary, buckets int"


def _lookup(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = keys[["doc_id", "copy"]].copy()
    out["shard"], out["start"], out["n"] = -1, np.int64(0), np.int64(0)
    if len(index) and len(keys):
        rows = np.frombuffer(index.slots.iloc[0], SLOT)
        h1, h2 = keys.h1.to_numpy(np.int64), keys.h2.to_numpy(np.int64)
        got = rows[find(h1, h2, np.frombuffer(index["shift"].iloc[0], "<i8"), len(rows))]
        there = got["mark"] == mark(h1, h2)
        out["shard"], out["start"], out["n"] = np.where(there, got["shard"].astype(np.int64), -1), got["start"].astype(np.int64), got["n"].astype(np.int64)
    return out[out.shard >= 0]


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, copy, shard, start, n of the different keys (doc_id, copy) of ``keys`` that the index has, by keyed access.

    A key that was never written is taken for another with probability 2 ** -32."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    first = index.select("buckets").first()
    asked = hashed(keys.select("doc_id", F.col("copy").cast("long")).distinct(), first["buckets"] if first else 1)
    kept = keys.schema["doc_id"].dataType.simpleString()
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup, f"doc_id {kept}, copy long, shard int, start long, n long")


def _read(folder: str, kind: str):
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        now, file = None, None
        for b in batches:
            raw = []
            for shard, start, n in zip(*(b.column(c).to_pylist() for c in ("shard", "start", "n")), strict=True):
                if shard != now:
                    if file:
                        file.close()
                    now, file = shard, files.open_input_file(f"{root}/ids/shard-{shard:05d}.bin")
                file.seek(start * size)
                raw.append(np.frombuffer(file.read(n * size), kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), b.column("shard"), b.column("start"), b.column("n"), pa.array(raw, pa.binary())], ["doc_id", "copy", "shard", "start", "n", "ids"])
        if file:
            file.close()
    return run


def read_ids(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The documents of ``keys`` (doc_id, copy) from the id files: doc_id, copy, start (ids of all documents before), n, ids (four bytes each, little endian)."""
    small_batches(spark)
    shards = spark.read.schema("shard int, n long, base long, kind string").parquet(f"{folder}/shards")
    first = shards.select("kind").first()
    kept = keys.schema["doc_id"].dataType.simpleString()
    found = lookup(spark, folder, keys).withColumn("part", F.floor(F.col("start") / (1 << 22)))
    raw = (found.repartition("shard", "part").sortWithinPartitions("shard", "start").select("doc_id", "copy", "shard", "start", "n")
           .mapInArrow(_read(folder, first["kind"] if first else "<u4"), f"doc_id {kept}, copy long, shard int, start long, n long, ids binary"))
    return raw.join(shards.select("shard", "base"), "shard").select("doc_id", "copy", (F.col("start") + F.col("base")).alias("start"), "n", "ids")


def document_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, copy) for every row: rows with one key are numbered from 0."""
    counted = docs.groupBy(F.col(key).alias("doc_id")).agg(F.count(F.lit(1)).alias("m"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy"))


def token_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, folder: str | None = None, **options) -> DataFrame:
    """Writes a store and reads every document back by its key: doc_id, copy, start, n_tokens, ids_crc32.

    Documents lie in ascending key order, null keys first; rows with one key lie by text and are its copies 0, 1, ... Null texts are
    empty and have the end id only. Extra columns are ignored. An empty table gives no rows."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    write_store(docs, folder, tokenizer, end_id, key, text, **options)
    back = read_ids(docs.sparkSession, folder, document_keys(docs, key))
    return back.select("doc_id", "copy", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
