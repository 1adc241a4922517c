"""Case folders: discovery, parameters, manifests, nested metadata, and the clean dataset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.functions.text import id_range
from aeroframe.operators.quality import convergence
from aeroframe.tables import CASE_METADATA, PARAMS

# Fixed value: columns of the clean dataset.
CLEAN_COLUMNS = ("case_id", "regime", "alpha_deg", "Re", "thickness", "Cl_mean", "Cl_std", "Cd_mean", "Cd_std", "L_over_D", "y_plus_mean", "iterations", "runtime_s", "validated")


def case_of(path: Column) -> Column:
    """Case folder name in a path."""
    return F.nullif(F.regexp_extract(path, r"/(case_[^/]+)/", 1), F.lit(""))


def read_params(spark: SparkSession, root: str, name: str = "params.json", schema: str = PARAMS) -> DataFrame:
    """One row per case folder with a parameter file; a missing regime counts as A."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return df.select(case_of(F.col("_metadata.file_path")).alias("case_id"), "*").withColumn("regime", F.coalesce("regime", F.lit("A")))


def expand_ids(items: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """(ids, errors): "3" and "3-7" items to sorted distinct ids; bad items apart."""
    parsed = items.withColumn("_r", id_range(F.col(item)))
    good = parsed.filter(F.col("_r.error").isNull()).select(F.explode(F.sequence("_r.start", "_r.stop")).alias("case_number")).distinct().orderBy("case_number")
    return good, parsed.filter(F.col("_r.error").isNotNull()).select(item, F.col("_r.error").alias("error"))


def missing_cases(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.select("case_id").join(found.select("case_id"), "case_id", "left_anti")


def first_file_of(files: DataFrame, names: Sequence[str], path: str = "path") -> DataFrame:
    """Per case the first existing file of an ordered list of names."""
    tail = F.element_at(F.split(path, "/"), -1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), tail)
    return files.withColumn("_rank", rank).filter(F.col("_rank") > 0).groupBy(case_of(F.col(path)).alias("case_id")).agg(F.min_by(path, "_rank").alias(path))


#: Files above this are hashed in blocks of BLOCK_BYTES instead of as one value of a row.
WHOLE_BYTES, BLOCK_BYTES = 256 << 20, 8 << 20


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sums = []
        for path in pdf["path"]:
            # Spark's paths of local and mounted files keep spaces as they are, so they are no URIs
            store, name = (pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_stream(name) as source:
                while block := source.read(BLOCK_BYTES):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "sha256": sums, "size": pdf["length"]})


def file_digests(files: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, SHA-256 and size of each file of a ``binaryFile`` table.

    Small files are hashed where Spark reads them. Of larger ones only path and length are listed, and a task reads such a file block by
    block (through pyarrow's file systems), so a file of any size takes bounded memory. Spark's scan skips files
    without a byte: they have no row."""
    small = files.filter(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").cast("long").alias("size"))
    large = files.select("path", "length").filter(F.col("length") > whole_bytes)
    parts = files.sparkSession.sparkContext.defaultParallelism
    return small.unionByName(large.repartition(parts, "path").mapInPandas(_stream_digests, "path string, sha256 string, size long"))


def file_manifest(expected: DataFrame, files: DataFrame, root: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Expected files (relpath, url) with status, SHA-256 and size; hashing runs where the file is read."""
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    found = file_digests(files, whole_bytes).select(relative.alias("relpath"), "sha256", "size")
    return expected.join(found, "relpath", "left").withColumn("status", F.when(F.col("sha256").isNull(), "missing").otherwise("present"))


def content_manifest(expected: DataFrame, rows: DataFrame, key: str, content: str) -> DataFrame:
    """The same over a table of contents: status, SHA-256 and byte size per expected key."""
    found = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))
    return expected.join(found, key, "left").withColumn("status", F.when(F.col("sha256").isNull(), "missing").otherwise("present"))


def validation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Declared cases with their references and tolerances."""
    docs = spark.read.schema(CASE_METADATA).option("multiLine", True).json(path)
    return docs.select(F.explode("validation_cases").alias("_c"), "tolerances").select("_c.*", F.col("tolerances.delta_Cl_pct").alias("Cl_tol"), F.col("tolerances.delta_Cd_pct").alias("Cd_tol"))


def mesh_records(metadata: DataFrame, key: str = "case_id", nested: str = "mesh") -> DataFrame:
    """Flat mesh-quality rows of nested case metadata."""
    return metadata.select(key, f"{nested}.*")


def clean_dataset(cases: DataFrame, stats: DataFrame, logs: DataFrame, y_plus: DataFrame, unvalidated: Sequence[str] = ()) -> DataFrame:
    """Converged cases (and listed unvalidated ones) as the fixed clean columns, with the reason kept apart.

    ``cases``: case_id, regime, alpha_deg, Re, thickness, y_plus_target; the others are keyed by case_id.
    A case with too short a history counts as unreadable.
    """
    usable = stats.filter(F.col("error").isNull()).drop("error")
    joined = cases.join(usable, "case_id", "left").join(logs, "case_id", "left").join(y_plus, "case_id", "left")
    ran = joined.filter(F.col("n_iters").isNotNull() | F.col("fatal").isNotNull())
    judged = convergence(ran, unvalidated).filter("include")
    return judged.withColumn("L_over_D", F.try_divide("Cl_mean", "Cd_mean")).withColumn("iterations", F.col("n_iters")).select(*CLEAN_COLUMNS)


def harvest_counts(cases: DataFrame, runs: DataFrame, clean: DataFrame) -> DataFrame:
    """Cases per outcome: not_run, converged (kept), failed."""
    marked = (cases.select("case_id").join(runs.select("case_id").distinct().withColumn("_ran", F.lit(True)), "case_id", "left")
              .join(clean.select("case_id").withColumn("_kept", F.lit(True)), "case_id", "left"))
    status = F.when(F.col("_kept"), "converged").when(F.col("_ran"), "failed").otherwise("not_run")
    return marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def table_lookup(entries: Mapping[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in entries.items() for x in (k, float(v))])[key]
