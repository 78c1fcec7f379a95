"""From blocks to chunks: filters, token windows, numbering, table text, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as K
from ..functions import text as T


def nonempty(blocks: DataFrame) -> DataFrame:
    """F1."""
    return blocks.filter((F.col("block_type") != "empty") & (F.length(T.trimmed(F.col("text"))) > 0))


def windows(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Overlapping token windows; a text of one window stays verbatim, others are joined by single spaces."""
    step = size - overlap
    df = df.withColumn("_tok", T.tokens(F.col(text))).withColumn("_n", F.size("_tok"))
    count = F.when(F.col("_n") <= size, 1).otherwise(1 + F.ceil((F.col("_n") - size) / step)).cast("int")
    df = df.withColumn("window_no", F.explode(F.sequence(F.lit(0), count - 1)))
    body = F.array_join(F.slice("_tok", F.col("window_no") * step + 1, size), " ")
    return df.withColumn("window_text", F.when(F.col("_n") <= size, F.col(text)).otherwise(body)).withColumn("token_count", F.least(F.lit(size), F.col("_n") - F.col("window_no") * step).cast("long")).drop("_tok", "_n")


def upload_windows(df: DataFrame, text: str, size: int = 1000, step: int = 800) -> DataFrame:
    """Windows for uploads: one at each step, without an early stop."""
    df = df.withColumn("_tok", T.tokens(F.col(text))).filter(F.size("_tok") > 0)
    df = df.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("_tok") - 1, F.lit(step))))
    return df.withColumn("window_text", F.array_join(F.slice("_tok", F.col("start") + 1, size), " ")).drop("_tok")


def numbered(df: DataFrame, doc: str, page: str, order: str, n: str) -> DataFrame:
    """First number of each row's chunks: a running count over the rows before it in its document.

    Pages are summed first, so that only one row a page is ordered within a document."""
    pages = df.groupBy(doc, page).agg(F.sum(n).alias("_m"))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    within = Window.partitionBy(doc, page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(pages, [doc, page]).withColumn("first_chunk", F.col("_before") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("_before")


def table_text(c: Column, most: int = 2000) -> Column:
    """A JSON table as tab-separated rows under its size; what is no JSON is cut to `most` characters."""
    data = F.from_json(c, "data array<array<string>>")["data"]
    head = F.concat(F.lit("[TABLE: "), F.size(data), F.lit(" rows × "), F.size(F.get(data, F.lit(0))), F.lit(" cols]\n"))
    full = F.concat(head, F.array_join(F.transform(data, lambda r: F.array_join(r, "\t")), "\n"))
    cut = F.when(F.length(full) > most, F.concat(F.substring(full, 1, most), F.lit("...[TRUNCATED]"))).otherwise(full)
    return F.when(c.isNull(), "[TABLE]").when(data.isNull() | (F.size(data) == 0), F.concat(F.lit("[TABLE]\n"), F.substring(c, 1, most))).otherwise(cut)


def with_quality(chunks: DataFrame) -> DataFrame:
    """K1-K3 on chunk rows."""
    c = F.col
    block = K.block_quality(F.coalesce(c("source_page_is_ocr"), F.lit(False)), c("conf_mean"), c("source_authority"), F.coalesce(c("is_distractor"), F.lit(False)), F.coalesce(c("language"), F.lit("")), F.coalesce(c("has_watermark"), F.lit(False)))
    q = K.chunk_quality(block, F.coalesce(c("language_confidence"), F.lit(0.5)))
    return chunks.withColumn("block_q", block).withColumn("chunk_q", q).withColumn("tier", K.quality_tier(F.coalesce(c("language_confidence"), F.lit(0.0)), q, F.coalesce(c("is_reconstructed"), F.lit(False)), F.coalesce(c("reconstruction_score"), F.lit(0.0))))


def ocr_lines(pages: DataFrame) -> DataFrame:
    """one block for each line of a recognised page that isn't blank, numbered with the blank ones."""
    line = pages.select("block_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return line.filter(F.length(T.trimmed(F.col("line"))) > 0).select("block_id", F.concat("block_id", F.lit("_ocr_"), F.lpad(F.col("line_no").cast("string"), 3, "0")).alias("line_id"), F.trim("line").alias("line"))


def dispatched(blocks: DataFrame) -> DataFrame:
    """What becomes of a page by its type: text, recognised image, or nothing."""
    kind = F.when(F.coalesce(F.col("source_page_is_ocr"), F.lit(False)), "image").otherwise("text")
    way = F.when(kind == "image", F.when(F.col("ocr_engine").isNotNull(), "ocr_blocks").otherwise("empty")).otherwise(F.when(F.col("block_type") == "table", "table").otherwise("text_blocks"))
    return blocks.select("block_id", kind.alias("page_type"), way.alias("way"))


def spans_of_blocks(blocks: DataFrame) -> DataFrame:
    """Spans of a block joined, with the hull of their boxes."""
    s = blocks.select("block_id", F.explode("char_span").alias("s"))
    return s.groupBy("block_id").agg(F.count("*").alias("n_spans"), F.min(F.get("s.bbox", F.lit(0))).alias("x0"), F.min(F.get("s.bbox", F.lit(1))).alias("y0"), F.max(F.get("s.bbox", F.lit(2))).alias("x1"), F.max(F.get("s.bbox", F.lit(3))).alias("y1"), F.sum(F.length("s.text")).alias("n_chars"))
