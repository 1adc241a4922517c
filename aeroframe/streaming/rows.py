"""Row-wise operators on arriving files.

The source data is a growing folder of finished samples.  Everything that needs one row only (unit
columns, bands, warnings, model scores) runs unchanged on a stream; ordered and grouped work stays batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aeroframe.session import checkpoint_dir


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_arriving(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, name: str) -> StreamingQuery:
    """Append scored rows to Parquet; progress is kept in the shared checkpoint folder, one per ``name``."""
    place = f"{checkpoint_dir(stream.sparkSession)}/{name}"
    return (score(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", place)
            .outputMode("append").trigger(availableNow=True).start())
