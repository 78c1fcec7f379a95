"""Question-answer-citation sets: source filter, text quality, key terms, extracted answers, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that are no key terms, by language.
STOP = {
    "en": ["the", "and", "for", "are", "was", "with", "this", "that", "have", "from", "they", "been", "said", "what", "were"],
    "ne": ["र", "को", "का", "की", "ले", "मा", "लाई", "बाट", "सँग", "छ", "हो", "भए", "गर्न"],
}


def qa_sources(blocks: DataFrame, least_conf: float = 45.0, least_length: int = 50) -> DataFrame:
    """authoritative English or Nepali text of enough length and confidence; an unknown confidence is rejected."""
    return blocks.filter((F.col("source_authority") == "authoritative") & F.col("language").isin("ne", "en") & (F.length("text") >= least_length) & (F.col("conf_mean") >= least_conf))


#: Signs and digits that count as noise of a text.
SIGNS = r"[\p{Nd}!@#$%^&*()_+\-={}\[\]|\\:;\"<>,.?/]"


def _measures(c: Column) -> tuple[Column, Column, Column, Column]:
    """Words, shares of letters (with Devanagari signs) and of noise in the length, and of coherent words."""
    w = T.tokens(c)
    n = F.greatest(F.length(c), F.lit(1))
    whole = F.size(F.filter(w, lambda x: (F.length(x) >= 3) & (x.rlike(r"^\p{L}+$") | x.rlike(T.DEVANAGARI))))
    return w, T.count_of(c, r"[\p{L}ऀ-ॿ]") / n, T.count_of(c, SIGNS) / n, whole / F.greatest(F.size(w), F.lit(1))


def text_quality(c: Column, conf: Column) -> Column:
    """0 where length, words, letters, noise, coherence or confidence miss their gates; else a score of four parts."""
    w, alpha, noise, whole = _measures(c)
    gate = (F.length(c) >= 20) & (F.size(w) >= 5) & (alpha >= 0.7) & (noise <= 0.3) & (whole >= 0.8) & (conf >= 60)
    score = F.when(conf >= 70, 0.3).otherwise(0.1) + F.when(F.length(c) >= 100, 0.3).when(F.length(c) >= 50, 0.2).otherwise(0.0) + alpha * 0.2 + whole * 0.2
    return F.when(gate, F.least(score, F.lit(1.0))).otherwise(0.0)


def valid_answer(answer: Column, chunk: Column) -> Column:
    """An answer of enough length, letters and coherence, most of whose words stand in the chunk."""
    from .lexical import word_set

    w, alpha, noise, whole = _measures(answer)
    a, b = word_set(F.lower(answer)), word_set(F.lower(chunk))
    known = (F.size(a) == 0) | (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)) >= 0.6)
    return F.coalesce((F.length(T.trimmed(answer)) >= 10) & (F.size(w) >= 3) & (alpha >= 0.8) & (noise <= 0.2) & (whole >= 0.9) & known, F.lit(False))


#: Words of two domains of questions.
HEALTH = "health covid hospital patient medicine disease स्वास्थ्य कोभिड अस्पताल बिरामी औषधि रोग".split()
LEGAL = "constitution law right legal act section संविधान कानुन अधिकार ऐन धारा".split()


def qa_domain(c: Column) -> Column:
    """Health where more of its words occur than legal ones, else legal where any does."""
    low = F.lower(c)
    n = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    return F.when((n(HEALTH) > n(LEGAL)) & (n(HEALTH) > 0), "health").when(n(LEGAL) > 0, "legal").otherwise("generic")


def clean_ocr(c: Column) -> Column:
    """Digits and Latin letters that stand alone dropped, spaces collapsed; text that is short or has few letters is left empty."""
    t = c
    for one in ("[0-9]", "[a-zA-Z]"):
        t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_]){one}(?![\p{{L}}\p{{N}}_])", "")
    t = T.trimmed(F.regexp_replace(t, r"\s+", " "))
    return F.when((F.length(t) > 5) & (T.count_of(t, r"[\p{L}ऀ-ॿ]") / F.length(t) > 0.3), t).otherwise("")


def clean_display(c: Column) -> Column:
    """Control characters and table marks removed, spaces collapsed."""
    return T.trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", ""), r"\[TABLE[^\]]*\]", ""), r"\s+", " "))


def key_terms(df: DataFrame, id_col: str, text: str, language: str, most: int = 5) -> DataFrame:
    """W13, X15, A-counts: words of three letters or more, neither numbers nor stop words of the text's language, by length times count, the first five a text."""
    w = df.select(id_col, F.coalesce(language, F.lit("")).alias("_l"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]{3,})"), 1)).alias("term"))
    stop = F.lit(False)
    for name, words in STOP.items():
        stop = stop | ((F.col("_l") == name) & F.col("term").isin(words))
    w = w.filter(~stop & ~F.col("term").rlike(r"^\p{Nd}+$")).drop("_l")
    n = w.groupBy(id_col, "term").agg(F.count("*").alias("n")).withColumn("score", (F.length("term") * F.col("n")).cast("long"))
    win = Window.partitionBy(id_col).orderBy(F.desc("score"), "term")
    return n.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= most)


def extracted(c: Column) -> Column:
    """First sentence, or the first two where it is short."""
    s = F.filter(F.transform(F.split(c, "[.!?।॥]+"), lambda x: T.trimmed(x)), lambda x: x != "")
    a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    return F.when((F.length(a) < 50) & b.isNotNull(), F.concat(a, F.lit(". "), b)).otherwise(a)


def overlap_share(answer: Column, chunk: Column) -> Column:
    """Share of the answer's words that stand in the chunk."""
    a, b = F.array_distinct(T.tokens(F.lower(answer))), F.array_distinct(T.tokens(F.lower(chunk)))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def split_sets(df: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """70, 15 and 15 % of the rows in the order of a hash; positions come from counts by hash prefix, so no task orders all rows."""
    h = df.withColumn("h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))).withColumn("p", F.substring("h", 1, 2))
    counts = h.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select("p", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("p")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("h", id_col)) + F.col("before")
    o = h.join(F.broadcast(before), "p").withColumn("nth", nth)
    train, dev = F.floor(F.col("total") * 0.7), F.floor(F.col("total") * 0.15)
    return o.select(id_col, F.when(F.col("nth") <= train, "train").when(F.col("nth") <= train + dev, "dev").otherwise("test").alias("part"))
