"""Measures of retrieval, citations, faithfulness and language, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as K


def graded(authority: Column, matched: Column) -> Column:
    """A16."""
    return F.when(matched, 1.0).when(authority == "authoritative", 0.8).when(authority == "wikipedia", 0.3).otherwise(0.0)


def ndcg(df: DataFrame, k: int = 10) -> DataFrame:
    """By query, over the first k by rank; the ideal order sorts the same k."""
    top = df.filter(F.col("rank") <= k).withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")))
    dcg, best = F.sum(F.col("rel") / F.log2(F.col("rank") + 1)), F.sum(F.col("rel") / F.log2(F.col("ideal") + 1))
    return top.groupBy("query_id").agg(F.when(best > 0, dcg / best).otherwise(0.0).alias("ndcg"))


def recall(df: DataFrame, k: int = 10) -> DataFrame:
    """Hits in the first k by hits in all that was retrieved."""
    hit = F.sum(F.when(F.col("rel") > 0, 1).otherwise(0))
    first = F.sum(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1).otherwise(0))
    return df.groupBy("query_id").agg(F.when(hit > 0, first / hit).otherwise(0.0).alias("recall"))


def diversity(df: DataFrame, k: int = 10) -> DataFrame:
    """Distinct documents and pages in the first k, and their share of all retrieved."""
    top = F.col("rank") <= k
    docs, pages = F.countDistinct(F.when(top, F.col("doc_id"))), F.countDistinct(F.when(top, F.col("page_id")))
    return df.groupBy("query_id").agg(docs.alias("docs"), pages.alias("pages"), ((docs / F.countDistinct("doc_id") + pages / F.countDistinct("page_id")) / 2).alias("coverage"))


def slices(df: DataFrame, least: int = 3) -> DataFrame:
    """Recall share and authority share by value of each slice, where a slice has at least three rows of a query."""
    conf = F.when(F.col("conf_mean").isNull(), "None").when(F.col("conf_mean") >= 80, "high").when(F.col("conf_mean") >= 60, "medium").otherwise("low")
    parts = F.array(
        F.struct(F.lit("ocr").alias("field"), F.coalesce(F.col("source_page_is_ocr").cast("string"), F.lit("null")).alias("value")),
        F.struct(F.lit("type").alias("field"), F.col("chunk_type").alias("value")),
        F.struct(F.lit("confidence").alias("field"), conf.alias("value")),
        F.struct(F.lit("watermark").alias("field"), F.when(F.col("has_watermark"), "has").otherwise("no").alias("value")),
    )
    s = df.select("query_id", "source_authority", "rel", F.explode(parts).alias("s"))
    return s.groupBy("query_id", F.col("s.field").alias("field"), F.col("s.value").alias("value")).agg(F.count("*").alias("n"), F.avg((F.col("source_authority") == "authoritative").cast("double")).alias("purity"), F.avg("rel").alias("mean_rel")).filter(F.col("n") >= least)


def summary(df: DataFrame, *cols: str) -> DataFrame:
    """Mean and population deviation of each column over the queries."""
    return df.agg(*[f for c in cols for f in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))])


def span_iou(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """Best overlap of a citation with the true spans of its document and page; 0 without any."""
    j = cited.join(truth, ["doc_id", "page_num"], "left").withColumn("iou", F.coalesce(K.interval_iou(F.col("start_char"), F.col("end_char"), F.col("t_start"), F.col("t_end")), F.lit(0.0)))
    return j.groupBy("cite_id").agg(F.max("iou").alias("char_iou"))


def histogram(df: DataFrame, col: str, bins: int = 5) -> DataFrame:
    """Equal-width bins over the column's range by their labels, empty ones too, the last one closed; of bins of one label the last stays."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).filter("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    above = sum(((F.col(col) >= F.col("lo") + i * width).cast("int") for i in range(1, bins)), F.lit(0))
    n = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(r)).groupBy(F.when(F.col("hi") > F.col("lo"), above).otherwise(0).alias("bin")).agg(F.count("*").alias("n"))
    places = r.withColumn("bin", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    # Two decimals of the number as it is stored (0.365 is a little less); there is a row for each bin only.
    two = F.pandas_udf(lambda x: x.map(lambda v: f"{v:.2f}"), "string")
    label = F.when(F.col("hi") > F.col("lo"), F.concat(two(F.col("lo") + F.col("bin") * width), F.lit("-"), two(F.col("lo") + (F.col("bin") + 1) * width))).otherwise(two(F.col("lo")))
    return places.join(n, "bin", "left").select(label.alias("label"), "bin", F.coalesce("n", F.lit(0)).alias("n")).groupBy("label").agg(F.max_by("n", "bin").alias("n"))


def shares(df: DataFrame, col: str) -> DataFrame:
    """Share of each value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def faithfulness(df: DataFrame) -> DataFrame:
    """1 for refusals, 0 without citations, else the authoritative share of citations; claims supported by them."""
    claims = F.size(F.filter(F.split("answer", r"\."), lambda x: F.trim(x) != ""))
    return df.select("query_id", F.when(F.col("is_refusal"), 1.0).when(F.col("n_cites") == 0, 0.0).otherwise(F.col("n_auth") / F.col("n_cites")).alias("faithfulness"), claims.cast("long").alias("claims"), F.least(claims, F.col("n_auth")).cast("long").alias("supported"))


def refusals_at(df: DataFrame, k: int) -> Column:
    """Refusals among the first k results of a run, by min(k, n)."""
    return F.sum(F.when((F.col("ordinal") <= k) & F.col("is_refusal"), 1).otherwise(0)) / F.least(F.lit(k), F.count("*"))
