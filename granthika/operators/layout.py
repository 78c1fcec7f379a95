"""Pages and objects: signatures, repeated objects, reasons, page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_objects(blocks: DataFrame) -> DataFrame:
    """Objects of a page from its spans, with the first font of the block."""
    fonts = F.from_json("font_stats", "array<struct<font: string, size: double>>")
    return blocks.select("block_id", "doc_id", "page_id", fonts[0]["font"].alias("font"), fonts[0]["size"].alias("size"), F.posexplode("char_span").alias("pos", "s")).select("block_id", "doc_id", "page_id", "pos", "font", "size", F.col("s.text").alias("text"), F.col("s.bbox").alias("bbox"))


#: Page size in points where the source gives none.
WIDTH, HEIGHT = 595.0, 842.0
#: Thresholds and texts of watermarks.
AREA, OFTEN, LARGE, MICRO, TURNED, FAINT = 0.25, 0.3, 24.0, 6.0, 10.0, 0.5
MARKS = (
    r"(?i)\b(confidential|draft|copy|duplicate|sample|watermark|preview)\b",
    r"(?i)\b(not for distribution|internal use|preliminary)\b",
    r"(?i)\b(copyright|©|\(c\))\b",
    r"(?i)\b(proprietary|restricted|classified)\b",
)


def rotation_and_alpha(flags: Column, colour: Column) -> tuple[Column, Column]:
    """15 degrees for italic spans, else none; opacity from the colour, black being whole."""
    return F.when(flags.bitwiseAND(F.lit(64)) != 0, 15.0).otherwise(0.0), F.when(colour == 0, 1.0).otherwise(F.least(F.lit(1.0), colour / 16777215.0))


def turned(objects: DataFrame) -> DataFrame:
    """Objects with rotation and alpha: from their flags and colour where they have them, else from a font that is named italic, in black."""
    flags = F.col("flags") if "flags" in objects.columns else F.when(F.lower("font").rlike("italic|oblique"), 64).otherwise(0)
    rotation, alpha = rotation_and_alpha(flags, F.col("colour") if "colour" in objects.columns else F.lit(0))
    return objects.withColumn("rotation", rotation).withColumn("alpha", alpha)


def signature(text: Column, font: Column, size: Column, bbox: Column) -> Column:
    """What makes an object the same on another page: text, font, size and place."""
    place = F.concat(F.format_number(bbox[0] / WIDTH, 2), F.lit(","), F.format_number(bbox[1] / HEIGHT, 2))
    return F.concat_ws("|", F.trim(text), font, F.format_number(size, 1), place)


def signature_frequency(objects: DataFrame) -> DataFrame:
    """Occurrences of a signature in a document by the document's pages; may exceed 1."""
    o = objects.withColumn("sig", signature(F.col("text"), F.col("font"), F.col("size"), F.col("bbox")))
    pages = o.groupBy("doc_id").agg(F.countDistinct("page_id").alias("pages"))
    return o.groupBy("doc_id", "sig").agg(F.count("*").alias("n")).join(pages, "doc_id").withColumn("frequency", F.col("n") / F.col("pages"))


def drop_reasons(objects: DataFrame) -> DataFrame:
    """Why an object may be a watermark, by rotation, opacity, size, frequency, text, font and place."""
    o = turned(objects).withColumn("sig", signature(F.col("text"), F.col("font"), F.col("size"), F.col("bbox")))
    o = o.join(signature_frequency(objects).select("doc_id", "sig", "frequency"), ["doc_id", "sig"])
    b, size, marked = F.col("bbox"), F.col("size"), F.lit(False)
    for m in MARKS:
        marked = marked | F.col("text").rlike(m)
    x, y = (b[0] + b[2]) / 2 / WIDTH, (b[1] + b[3]) / 2 / HEIGHT
    reasons = F.array(
        F.when(F.abs("rotation") > TURNED, "rotation"),
        F.when(F.col("alpha") < FAINT, "alpha"),
        F.when((b[2] - b[0]) * (b[3] - b[1]) / (WIDTH * HEIGHT) > AREA, "large_area"),
        F.when(F.col("frequency") >= OFTEN, "frequent"),
        F.when(marked, "text_pattern"),
        F.when((size > LARGE) & F.contains(F.lower("font"), F.lit("bold")), "large_bold_font"),
        F.when(F.lower("font").rlike("script|display|decorative"), "decorative_font"),
        F.when(size < MICRO, "micro_text"),
        F.when((x > 0.3) & (x < 0.7) & (y > 0.3) & (y < 0.7) & (size > LARGE), "centred_large"),
        F.when(((y < 0.1) | (y > 0.9)) & (F.col("frequency") >= OFTEN / 2), "edge_frequent"),
    )
    return o.withColumn("reasons", F.array_compact(reasons))


def page_metrics(blocks: DataFrame) -> DataFrame:
    """Text measures of a page from its blocks; zero area gives zeros."""
    b = F.col("bbox")
    area = F.when(F.size(b) >= 4, (b[2] - b[0]) * (b[3] - b[1])).otherwise(0.0)
    t = F.when(F.col("block_type").isin("text", "table"), F.coalesce("text", F.lit(""))).otherwise("")
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    p = blocks.groupBy("doc_id", "page_id").agg(F.sum(F.length(t)).alias("n_chars"), F.sum(words).alias("n_words"), F.count("*").alias("n_blocks"), F.sum(area).alias("area"))
    page = 595.0 * 842.0
    return p.withColumn("density", F.col("n_chars") / page).withColumn("coverage", F.col("area") / page)


def page_type(p: DataFrame) -> DataFrame:
    """Text where two or more of four measures pass."""
    votes = (F.col("density") >= 0.001).cast("int") + (F.col("n_chars") >= 50).cast("int") + (F.col("coverage") >= 0.01).cast("int") + (F.col("n_blocks") > 0).cast("int")
    return p.withColumn("page_type", F.when(votes >= 2, "text").otherwise("image"))


def first_qualifying(df: DataFrame, key: str, order: str, least: int = 100) -> DataFrame:
    """First row of each key with more than so many characters."""
    w = Window.partitionBy(key).orderBy(order)
    return df.filter(F.length("text") > least).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
