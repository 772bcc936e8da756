"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import discard, forget, scratch_folder, ship_package  # noqa: F401

_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers, once per Spark context.

    Rows hold whole texts and sets, so batches to and from Python workers are bounded by
    bytes, unless the session has a bound of its own.
    """
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, "4m")
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of a value's decimal text, modulo ``folds`` (null ids fall in fold of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def give_back() -> None:
    """Return memory that this Python worker no longer uses, before it waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def row_batches(frames, budget: int = 1_000_000, column: str = "text"):
    """Split pandas frames into pieces of about ``budget`` characters of text."""
    for frame in frames:
        texts = frame[column]
        start = used = 0
        for i, text in enumerate(texts):
            size = len(text) if isinstance(text, str) else 0
            if used and used + size > budget:
                yield frame.iloc[start:i]
                start, used = i, 0
            used += size
        if start < len(frame):
            yield frame.iloc[start:]
    give_back()


BLOOM_BITS = 1 << 26


def bloom(ids: DataFrame, column: str, bits: int = BLOOM_BITS) -> DataFrame:
    """A Bloom filter of a column of longs, of a fixed size whatever the data: at most bits / 32768 rows of 4 KB.

    It only spares work ahead of a join: fuller filters let more rows through.
    """
    hashed = ids.select(F.explode(F.array(*_spots(column, bits))).alias("bit"))
    blocks = hashed.groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map"))
    return written(blocks, "bloom")


def _spots(column: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(2)]


def in_bloom(df: DataFrame, column: str, blocks: DataFrame, flag: str, bits: int = BLOOM_BITS) -> DataFrame:
    """``df`` with a boolean column ``flag``: whether the filter holds the value. No Python worker is needed."""
    hit = F.lit(True)
    for k, at in enumerate(_spots(column, bits)):
        df, one = _bit(df, at, blocks, f"{flag}{k}")
        hit = hit & one
    return df.withColumn(flag, hit).drop(*(f"{flag}{x}{k}" for k in range(2) for x in ("", "map")))


def _bit(df: DataFrame, at: Column, blocks: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """``df`` beside its block of 32768 bits, and whether the bit ``at`` is set."""
    held = f"{name[:-1]}map{name[-1]}"
    df = df.join(F.broadcast(blocks.toDF(name, held)), F.floor(at / 32768).cast("long") == F.col(name), "left")
    byte = F.conv(F.hex(F.substring(held, F.floor(at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df, F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1, F.lit(False))


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written, with a new column that tells its rows apart, and that column's name."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows", compression="zstd"), name


def numbered_in(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of :func:`numbered` whose numbers the one column of ``kept`` holds.

    Numbers become a table of bits, 4 KB for each 32768 rows of a partition, that goes to the
    tasks, so that no row is shuffled with its text.
    """
    number = kept.columns[0]
    blocks = written(kept.groupBy(F.shiftright(number, 15).alias("block")).agg(F.bitmap_construct_agg(F.col(number) % 32768).alias("map")), "kept")
    forget(rows.sparkSession)
    df, hit = _bit(rows, F.col(row), blocks, f"{row}_0")
    return df.where(hit).drop(f"{row}_0", f"{row}_map0")
