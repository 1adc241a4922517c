"""Two-pass external shuffle: seeded hashes scatter rows into memory-sized buckets, each bucket is shuffled and written.

Pass one sends every row to a shard and to one of the shard's buckets, both by seeded hashes, so that a bucket is a uniform
draw of a known expected size. Pass two gathers a bucket, which fits in memory, and permutes it with Spark's ``shuffle``
(a Fisher-Yates permutation), seeded. A row's slot is its bucket's offset in the shard plus its place in the bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from aeroframe.llm.text import shared_folder, stored, unused


def shard_of(key: Column, shards: int, seed: int = 41) -> Column:
    """Shard by key and shard count alone: the shard whose seeded hash with the key is the largest.

    With one more shard a row either stays or moves into the new shard, as only the new shard's hash can become the largest."""
    scored = F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(scored)["s"]


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def scatter(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 41, bucket_bytes: int = 4 << 20) -> None:
    """Writes ``docs`` below ``path`` with shard, bucket and the place after the bucket's permutation, under names of ``own_names``.

    The number of buckets follows from the table's bytes. Rows with one key share a shard, as the law asks, but are spread over
    its buckets by the hash of the text and by their place in the input, so equal rows are spread too."""
    shard, bucket, place, _, _ = own_names(docs.schema)
    total = docs.agg(F.sum(row_size(F.col(text))).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes / shards))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(buckets))
    packed = docs.select(shard_of(F.col(key), shards, seed).alias("s"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), salt), F.lit(buckets)).cast("int").alias("b"),
                         F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    gathered = packed.groupBy("s", "b").agg(F.collect_list("row").alias("rows")).withColumn("rows", F.shuffle(F.sort_array("rows"), seed))
    (gathered.select(F.col("s").alias(shard), F.col("b").alias(bucket), F.posexplode("rows").alias("p", "row"))
     .select(shard, bucket, F.col("p").alias(place), "row.*").write.partitionBy(shard).parquet(path))


def own_names(schema: StructType) -> list[str]:
    """Column names of the files that the rows' own columns leave free: shard, bucket, place, and two for reading."""
    return unused(schema, "s_shard", "s_bucket", "s_place", "s_offset", "s_n")


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The written shards, rows of ``schema``, with ``shard`` and ``slot``; slots of a shard run from 0 without gaps."""
    shard, bucket, place, offset, n = own_names(schema)
    at = spark.read.schema(StructType([*schema.fields, *[StructField(c, IntegerType()) for c in (bucket, place, shard)]])).parquet(path)
    sizes = at.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark knows its size and joins it as it fits: one row a bucket
    offsets = stored(sizes.select(shard, bucket, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(offset)), "shard-offsets")
    return (at.join(offsets, [shard, bucket])
            .select(*[F.col(c) for c in schema.names], F.col(shard).alias("shard"), (F.col(offset) + F.col(place)).cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 41, bucket_bytes: int = 4 << 20, path: str | None = None) -> DataFrame:
    """Shards ``docs`` into Parquet files at ``path`` (a new shared folder if none) and returns them with ``shard`` and ``slot``.

    Null keys are one key; null texts count as no bytes. Repeated rows each get a slot of their own. Columns named ``shard`` or
    ``slot`` are replaced. An empty table gives no rows."""
    docs = docs.drop("shard", "slot")
    path = path or shared_folder(docs.sparkSession, "shards")
    scatter(docs, path, shards, key, text, seed, bucket_bytes)
    return read_shards(docs.sparkSession, path, docs.schema)
