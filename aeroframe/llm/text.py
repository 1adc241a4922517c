"""Words, their hashes and the shared folder, as the operators of this subpackage use them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aeroframe.session import checkpoint_dir

#: The characters that end a word: space and U+0009 to U+000D.
SPACE = "\t\n\x0b\x0c\r "


def body(text: str | Column) -> Column:
    """The text, empty for null, without white space at its ends."""
    return F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SPACE))


def words(text: str | Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; none for null, empty and blank texts."""
    kept = body(text)
    return F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, r"[\x20\x09-\x0D]+"))


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def word_hashes(text: str | Column) -> Column:
    """64-bit hash of every word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/aeroframe-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs start from the files, whatever executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Vectors over a whole Arrow batch: documents lie one after the other in a flat array, ``starts`` has one entry more than documents.

def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts of a list column without nulls inside."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(starts[0], starts[-1] - starts[0]).to_numpy(zero_copy_only=False), starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def window_hashes(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the ``width`` values that begin at each place of the flat array; windows over a document's end are the caller's to drop.

    Doubling: a window of 2k values is made of two of k, so a window costs log2(width) steps."""
    h, n = hashes.astype(np.uint64, copy=False), len(hashes)
    out, have, size, power, todo = None, h, 1, np.uint64(base | 1), width
    made, made_size = None, 0
    with np.errstate(over="ignore"):
        while todo:
            if todo & 1:
                if made is None:
                    made, made_size = have.copy(), size
                else:
                    shifted = np.zeros(n, np.uint64)
                    shifted[: n - made_size or None] = have[made_size:] if made_size < n else 0
                    made, made_size = made * power + shifted, made_size + size
            todo >>= 1
            if todo:
                shifted = np.zeros(n, np.uint64)
                if size < n:
                    shifted[: n - size] = have[size:]
                have, size, power = mix(have * power + shifted), size * 2, power * power + np.uint64(2)
    out = mix(made)
    return out


def in_document(starts: np.ndarray, width: int) -> np.ndarray:
    """True at each place of the flat array where a window of ``width`` stays inside its document."""
    sizes = np.diff(starts)
    ends = np.repeat(starts[1:], sizes)
    return np.arange(starts[-1]) + width <= ends


def owner(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        if b.num_rows:
            yield pa.Table.from_batches([b])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of this session get ``rows`` rows at most, so that a batch of long texts stays small in a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


#: An odd multiplier and its inverse modulo 2 ** 64: hashes of byte ranges come from one running sum over a whole buffer.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """64-bit hash of each byte range."""
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(raw.astype(np.uint64) + np.uint64(salt * 256)) * powers(P, len(raw)), dtype=np.uint64)])
        return mix((run[ends] - run[starts]) * powers(P_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def unused(df: DataFrame | StructType, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name already (case aside, as Spark compares them)."""
    taken = {c.lower() for c in (df.names if isinstance(df, StructType) else df.columns)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def seeded_sample(df: DataFrame, order: str, rows: int, *ties: str) -> DataFrame:
    """At most ``rows`` rows: those that come first by ``order``, a column of 64-bit hashes.

    The hash range is cut so that about twice as many rows remain before they are ordered; no task or driver sees more."""
    n = df.count()
    if n > 2 * rows:
        df = df.filter(F.col(order) < F.lit(int(-(1 << 63) + (1 << 64) * (2 * rows / n))))
    return df.orderBy(order, *ties).limit(rows)
