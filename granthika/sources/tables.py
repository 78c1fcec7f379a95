"""Sources and sinks: typed scans, partitioned and unified sinks, line-wise JSON, CSV, nested JSON columns, score caches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columnar scan; filters and columns reach the files through the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new place in the folder that the cluster shares; a local folder only on one machine.  It is removed at the end."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or os.path.join(tempfile.gettempdir(), "granthika-shared")
    path = f"{base}/{kind}-{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Rows written once and read back, where several steps go on from them."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """One folder for each value, read back as one table whose folders prune."""
    df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def union_files(spark: SparkSession, *paths: str) -> DataFrame:
    """S3: union of files whose columns may differ; unreadable files are left out."""
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(*paths)


def json_lines(df: DataFrame, path: str) -> DataFrame:
    """Written as one JSON object a line and read back with the same types."""
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def csv_round(df: DataFrame, path: str) -> DataFrame:
    """Flat columns to CSV with a header and back."""
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def block_meta(blocks: DataFrame) -> DataFrame:
    """JSON columns parsed once at ingest: title and page count of the file, first font."""
    meta = F.from_json("pdf_meta", "title string, page_count int")
    fonts = F.from_json("font_stats", "array<struct<font: string, size: double>>")
    return blocks.select("block_id", meta["title"].alias("title"), meta["page_count"].cast("long").alias("page_count"), F.get(fonts, F.lit(0))["font"].alias("font"), F.get(fonts, F.lit(0))["size"].alias("size"))


def with_cached_scores(pairs: DataFrame, cache: DataFrame, default: float = 0.5) -> DataFrame:
    """Scores by key from an earlier run, a neutral one where there is none."""
    return pairs.join(cache, "cache_key", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def append_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)
