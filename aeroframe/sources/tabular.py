"""CSV, JSON and frozen tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.functions.text import significant


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a given schema; only an empty field is null, text such as NA stays text."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("nanValue", "NaN").csv(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None, mode: str = "errorifexists") -> None:
    """Header CSV; floating columns to ``digits`` significant digits when given."""
    if digits:
        df = df.select(*[significant(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_optional(spark: SparkSession, path: str, schema: str, where: Mapping[str, str] | None = None) -> DataFrame:
    """Parquet table, or an empty one of the same schema if it is not there; equality filters are pushed down."""
    df = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    for c, v in (where or {}).items():
        df = df.filter(F.col(c) == v)
    return df


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, counted as a multiset: one aggregate over both sides."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    return both.groupBy(*cols).agg(F.sum("_s").alias("copies")).filter(F.col("copies") != 0)


def write_frozen(df: DataFrame, path: str) -> bool:
    """Write once: a second write must hold the same rows, else it is refused.  True if written now."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        if sorted(old.columns) != sorted(df.columns) or difference(df, old).limit(1).count():
            raise ValueError(f"{path} exists with other contents; it is frozen")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-document JSON with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def merge_columns(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """New columns laid over old ones if both hold the same keys; otherwise the new table alone.

    Columns only the old table has (other families) are kept.
    """
    if old is None or difference(old.select(key), new.select(key)).limit(1).count():
        return new
    kept = [c for c in old.columns if c not in new.columns]
    return new.join(old.select(key, *kept), key)


def overlay_entries(old: DataFrame | None, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of ``new`` replace those of ``old`` with the same keys; the others stay."""
    if old is None:
        return new
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
