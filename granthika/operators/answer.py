"""Answers from candidates: authority, language preference, evidence, citations, refusals, synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Parts of document ids that count as authoritative, and the forms of refusals.
AUTHORITY_IDS = ("constitution", "health", "covid", "heoc", "ministry")
REFUSALS_EN = ("don't have enough authoritative evidence", "insufficient evidence", "cannot answer", "not enough information")
REFUSALS_NE = ("पर्याप्त आधिकारिक प्रमाण नहुँदा", "जवाफ दिन असमर्थ", "पर्याप्त जानकारी छैन")
DOMAIN_WORDS = {
    "constitution": ("संविधान", "constitution", "कानून", "law", "अधिकार", "rights"),
    "health": ("स्वास्थ्य", "health", "चिकित्सा", "medical", "उपचार", "treatment"),
    "emergency": ("आपातकाल", "emergency", "संकट", "crisis", "विपद्", "disaster"),
    "government": ("सरकार", "government", "मन्त्रालय", "ministry", "प्रशासन", "administration"),
    "covid": ("कोभिड", "COVID", "कोरोना", "corona", "महामारी", "pandemic"),
}
#: Words of a domain that make a span better evidence.
QUALITY_WORDS = {
    "constitution": ("constitution", "संविधान", "law", "कानून", "rights", "अधिकार"),
    "health": ("health", "स्वास्थ्य", "medical", "चिकित्सा", "hospital", "अस्पताल"),
    "covid": ("covid", "कोभिड", "corona", "कोरोना", "pandemic", "महामारी"),
    "emergency": ("emergency", "आपातकाल", "disaster", "विपद्", "crisis", "संकट"),
}
TABLE_WORDS = ("table", "टेबल", "तालिका", "chart", "चार्ट")
CITATION = r"\[\[doc:([^|]+)\|page:(\d+)\|span:(\d+):(\d+)\]\]"


def is_authority(flag: Column, authority: Column, doc_id: Column, text: Column) -> Column:
    """F7."""
    named = F.lit(False)
    for w in AUTHORITY_IDS:
        named = named | F.contains(F.lower(doc_id), F.lit(w))
    return (F.coalesce(flag, F.lit(False)) | (F.coalesce(authority, F.lit("")) == "authoritative") | named) & (F.length(T.trimmed(text)) >= 30)


def spans(df: DataFrame) -> DataFrame:
    """one row a span; the whole text where a row has no span or an empty one."""
    s = df.withColumn("s", F.explode_outer(F.when(F.size("char_spans") > 0, F.col("char_spans"))))
    start, end = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    ok = F.col("s").isNotNull() & (end > start)
    return s.withColumn("start_char", F.when(ok, start).otherwise(0).cast("long")).withColumn("end_char", F.when(ok, F.least(end, F.length("text"))).otherwise(F.length("text")).cast("long")).withColumn("span_text", F.when(ok, F.substring("text", start + 1, end - start)).otherwise(F.col("text"))).drop("s")


def preferred(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """rows in the query's language; where they are too few a share and others exist, the first two others too."""
    q = Window.partitionBy("query_id")
    same = F.coalesce(F.col("language"), F.lit("unknown")) == F.col("query_lang")
    cross = ~same & (F.coalesce(F.col("language"), F.lit("unknown")) != "unknown")
    df = df.withColumn("same", same).withColumn("share", F.avg(same.cast("double")).over(q)).withColumn("others", F.sum(cross.cast("int")).over(q))
    df = df.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", cross).orderBy("rank")))
    fallback = (F.col("share") < threshold) & (F.col("others") > 0)
    return df.withColumn("fallback_used", fallback).filter(F.col("same") | (fallback & cross & (F.col("nth") <= 2))).drop("others", "nth")


def round_robin(df: DataFrame, most: int = 5) -> DataFrame:
    """Longest span of each page in turn, pages in the order they were first seen; all spans where there are few."""
    page = Window.partitionBy("query_id", "doc_id", "page_id").orderBy(F.desc(F.length("span_text")), "rank")
    seen = Window.partitionBy("query_id", "doc_id", "page_id")
    order = Window.partitionBy("query_id").orderBy("turn", "first_seen", "rank")
    df = df.withColumn("turn", F.row_number().over(page)).withColumn("first_seen", F.min("rank").over(seen))
    return df.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= most)


def domain_of(question: Column) -> Column:
    """The first domain a word of which stands in the question, else general."""
    low, out = F.lower(F.coalesce(question, F.lit(""))), None
    for name, words in DOMAIN_WORDS.items():
        named = F.lit(False)
        for w in words:
            named = named | F.contains(low, F.lit(w.lower()))
        out = F.when(named, name) if out is None else out.when(named, name)
    return out.otherwise("general")


def domain_hits(text: Column, domain: Column, of: dict[str, tuple[str, ...]] = DOMAIN_WORDS) -> Column:
    """How many of the domain's words a text holds; none in general."""
    low, out = F.lower(text), None
    for name, words in of.items():
        hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
        out = F.when(domain == name, hits) if out is None else out.when(domain == name, hits)
    return out.otherwise(0)


def domain_order(df: DataFrame, domain: Column) -> DataFrame:
    """Stable order by how many of the domain's words a span holds; table flag."""
    t = F.lower("span_text")
    table = F.lit(False)
    for w in TABLE_WORDS:
        table = table | F.contains(t, F.lit(w))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "pick")
    return df.withColumn("hits", domain_hits(F.col("span_text"), domain)).withColumn("is_table", table).withColumn("place", F.row_number().over(w))


def evidence_quality(text: Column, language: Column, target: Column, domain: Column) -> Column:
    """Length, language and the domain's words, a twentieth each up to four."""
    s = 0.5 + F.least(F.lit(0.3), F.length(text) / 1000.0) + F.when(language == target, 0.2).when(language.isin("en", "ne"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), s + F.least(F.lit(0.2), domain_hits(text, domain, QUALITY_WORDS) * F.lit(0.05)))


def one_per_document(df: DataFrame, most: int = 3, least: float = 0.3) -> DataFrame:
    """Spans of enough quality, the best of each document, the first three."""
    df = df.filter(F.col("quality") >= least)
    doc = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("quality"), "rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("quality"), "rank")
    return df.withColumn("_d", F.row_number().over(doc)).filter("_d = 1").withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= most).drop("_d")


def token(doc: Column, page: Column, start: Column, end: Column) -> Column:
    """X13."""
    return F.concat(F.lit("[[doc:"), doc, F.lit("|page:"), page.cast("string"), F.lit("|span:"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("]]"))


def page_of(page_id: Column) -> Column:
    return F.regexp_extract(page_id, r"_page_(\d+)", 1).cast("int")


def synthesised(df: DataFrame) -> DataFrame:
    """Answers as lines of evidence cut to 200 characters, each with its citation, in order."""
    text = F.when(F.length("span_text") > 200, F.concat(F.substring("span_text", 1, 197), F.lit("..."))).otherwise(F.col("span_text"))
    line = F.concat(F.lit("• "), text, F.lit(" "), token(F.col("doc_id"), page_of(F.col("page_id")), F.col("start_char"), F.col("end_char")))
    rows = df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pick", line.alias("line")))).alias("lines"), F.count("*").alias("evidence_count"))
    return rows.select("query_id", F.array_join(F.col("lines.line"), "\n").alias("answer"), "evidence_count")


def answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """F16: synthesised answers, and a refusal in the query's language where there is no evidence."""
    done = queries.select("query_id", "query_lang").join(synthesised(evidence), "query_id", "left")
    refusal = F.when(F.col("query_lang") == "ne", "पर्याप्त प्रमाण छैन।").otherwise("There is not enough evidence in the documents.")
    return done.select("query_id", F.coalesce("answer", refusal).alias("answer"), F.col("answer").isNull().alias("is_refusal"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def is_refusal(text: Column) -> Column:
    """X14."""
    out = F.lit(False)
    for w in REFUSALS_EN:
        out = out | F.contains(F.lower(text), F.lit(w))
    for w in REFUSALS_NE:
        out = out | F.contains(text, F.lit(w))
    return out


def citations(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """All citation tokens of a text."""
    parts = [F.regexp_extract_all(F.col(text), F.lit(CITATION), k) for k in range(1, 5)]
    c = df.select(id_col, F.posexplode(F.arrays_zip(*parts)).alias("pos", "z"))
    names = c.schema["z"].dataType.names
    return c.select(id_col, "pos", F.col(f"z.{names[0]}").alias("doc_id"), F.col(f"z.{names[1]}").cast("long").alias("page_num"), F.col(f"z.{names[2]}").cast("long").alias("start_char"), F.col(f"z.{names[3]}").cast("long").alias("end_char"))
