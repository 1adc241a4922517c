"""Sharded sample tables: completeness of the shard set, global row numbers, nested samples to long tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeroframe.operators.ordering import lookup_join

SHARD_TOTAL = r"-of-(\d+)\.parquet$"


def resolve_folder(given: str | None = None, env: str = "AEROFRAME_DATA", default: str | None = None) -> str:
    """Data folder: the argument, else the environment, else the default."""
    folder = given or os.environ.get(env) or default
    if not folder:
        raise FileNotFoundError(f"no data folder: pass one or set {env}")
    return folder


def shard_names(spark: SparkSession, folder: str, glob: str = "*-of-*.parquet") -> DataFrame:
    """File names of the shards; the files are listed, their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length"))


def check_shards(names: DataFrame) -> DataFrame:
    """One row: declared total, files found, and whether the set is complete (one total, equal to the count)."""
    total = F.nullif(F.regexp_extract("file_name", SHARD_TOTAL, 1), F.lit("")).try_cast("int")
    out = names.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct(total).alias("n_totals"), F.max(total).alias("declared"))
    return out.withColumn("complete", (F.col("n_totals") == 1) & (F.col("declared") == F.col("n_files")))


def read_shards(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, glob: str = "*-of-*.parquet") -> DataFrame:
    """Shards of a complete set, pruned to ``columns``, with file name and row position in the file."""
    found = check_shards(shard_names(spark, folder, glob)).first()
    if not found.n_files or not found.complete:
        raise FileNotFoundError(f"expected {found.declared or 'some'} shards under {folder}, found {found.n_files}")
    df = spark.read.option("pathGlobFilter", glob).parquet(folder)
    cols = [F.col(c) for c in (columns or df.columns)]
    return df.select(*cols, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def group_starts(sizes: DataFrame, group: str, n: str, out: str = "start") -> DataFrame:
    """Prefix sum of group sizes in name order: one row per file, so one small window."""
    return sizes.withColumn(out, F.sum(n).over(Window.orderBy(group)) - F.col(n))


def global_row_index(df: DataFrame, out: str = "sample_id", file: str = "_file", row: str = "_row") -> DataFrame:
    """Row number across name-sorted files: the file's start plus the row's own position in it."""
    sizes = df.groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    # one row per file; the largest files are looked up by broadcast, so none of them becomes one task
    starts = group_starts(sizes, file, "_n", "_start")
    return lookup_join(df, starts, [file], "_n").withColumn(out, F.col("_start") + F.col(row)).drop("_start", file, row)


def ragged_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Start and end of each key's block when all blocks are laid end to end, in key order."""
    from aeroframe.operators.ordering import add_bucket, running_sum, value_splits
    cut = value_splits(counts, [key])[key]
    return (running_sum(add_bucket(counts, key, cut), [], "_b", [key], F.col(n).cast("long"), "stop")
            .withColumn("start", F.col("stop") - F.col(n)).drop("_b"))


def ragged_slice(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], out: str = "block") -> DataFrame:
    """Each key's rows as one ordered array of structs."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(out))


def nodes_of(samples: DataFrame, flow: bool = True) -> DataFrame:
    """Long node table of nested samples; without ``flow`` the field columns are never read."""
    fields = ["x", "y", "implicit_distance", *(["p", "ux", "uy", "nut"] if flow else [])]
    return samples.select("sample_id", F.posexplode("nodes").alias("node_id", "_n")).select("sample_id", F.col("node_id").cast("long").alias("node_id"), *[F.col(f"_n.{c}").alias(c) for c in fields])


def triangles_of(samples: DataFrame) -> DataFrame:
    rows = samples.select("sample_id", F.posexplode("triangles").alias("tri_id", "_t"))
    return rows.select("sample_id", F.col("tri_id").cast("long").alias("tri_id"), "_t.n0", "_t.n1", "_t.n2")


def scalars_of(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    """Named scalars as columns: ``names`` maps a new column to its key in the scalar map."""
    return samples.select("sample_id", *[F.try_element_at("scalars", F.lit(k)).alias(c) for c, k in names.items()])


def pick_samples(samples: DataFrame, ids: DataFrame | Sequence[int] | None) -> DataFrame:
    """Subset by ids: a short list is pushed to the scan, a table is a semi join."""
    if ids is None:
        return samples
    if isinstance(ids, DataFrame):
        return samples.join(ids.select("sample_id"), "sample_id", "left_semi")
    return samples.filter(F.col("sample_id").isin([int(i) for i in ids]))


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """Named id lists from JSON (name -> array of ids) to rows (name, ids)."""
    document = spark.read.option("wholetext", True).text(path)
    return document.select(F.explode(F.from_json("value", "MAP<STRING, ARRAY<INT>>")).alias("name", "ids"))


def latest_path(files: DataFrame, key: Column, time: Column, path: str = "path") -> DataFrame:
    """Path with the largest numeric time per key; a name that is no number counts as -1."""
    return files.select(key.alias("key"), F.col(path).alias("_p"), F.coalesce(time.try_cast("double"), F.lit(-1.0)).alias("_t")) \
        .groupBy("key").agg(F.max_by("_p", F.struct("_t", "_p")).alias(path))
