"""Helpers shared by the training-data operators: reading, lineage cuts, Arrow batches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one broadcast side may hold.  A side beyond it is joined by shuffle instead.
BROADCAST_ROWS = 2_000_000
#: Words that each Python worker may hold of a broadcast table.
WORKER_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only on one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "granthika-shared")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut: writes the rows once as a table in the shared folder and reads them back.

    The table outlives lost executors and is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/granthika-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that one broadcast side may hold.
BROADCAST_BYTES = 64 << 20


def light(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, counted by the bytes of their strings and 32 for each row and further column, may be broadcast."""
    strings = [F.octet_length(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if t == "string" else F.lit(32) for c, t in df.dtypes]
    return (df.agg(F.sum(reduce(add, strings) + 32).alias("n")).first()["n"] or 0) <= most


#: Steps behind which a plan has partitions of its own.
_WIDE = re.compile(r"^[\s:+\-]*(?:Join|Aggregate|Repartition|Sort|Window|Deduplicate|Union|GlobalLimit|LocalLimit)", re.MULTILINE)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where a few large files would leave half of them idle or more; else as they are.

    Only a plan without a shuffle is asked for its partitions: asking another one would run it."""
    if _WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000) -> DataFrame:
    """df.mapInArrow with a function of one slice of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, rows):
                out = fn(s)
                if out is not None and out.num_rows:
                    yield out

    return spread(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Small slices of a batch, so that Python objects of few rows live at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
