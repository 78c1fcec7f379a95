"""Composed answers, spans of answers, question sets, titles, models behind interfaces, snapshots."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def relevant_portion(pairs: DataFrame, keep: int = 3, whole: int = 300, most: int = 400) -> DataFrame:
    """A short text as it is; else its sentences with most of the query's words, cut; else its beginning."""
    words = F.array_distinct(T.tokens(F.lower("query")))
    s = pairs.filter(F.length("text") > whole).select("query_id", "chunk_id", words.alias("w"), F.posexplode(F.split("text", "[.!?]+")).alias("pos", "s"))
    s = s.withColumn("s", T.trimmed(F.col("s"))).filter(F.length("s") >= 20)
    share = F.when(F.size("w") > 0, F.size(F.array_intersect("w", F.array_distinct(T.tokens(F.lower("s"))))) / F.size("w")).otherwise(0.0)
    win = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("share"), "pos")
    s = s.withColumn("share", share).filter("share > 0").withColumn("r", F.row_number().over(win)).filter(F.col("r") <= keep)
    best = s.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("r", "s"))).alias("ss")).select("query_id", "chunk_id", F.concat(F.array_join(F.col("ss.s"), ". "), F.lit(".")).alias("best"))
    best = best.withColumn("best", F.when(F.length("best") > most, F.concat(F.substring("best", 1, most - 3), F.lit("..."))).otherwise(F.col("best")))
    out = F.when(F.length("text") <= whole, F.col("text")).otherwise(F.coalesce("best", F.concat(F.substring("text", 1, whole - 3), F.lit("..."))))
    return pairs.join(best, ["query_id", "chunk_id"], "left").withColumn("portion", out).drop("best")


def multi_source_answer(portions: DataFrame, most: int = 4) -> DataFrame:
    """Portions of the first results under their titles, with the list of sources, in one text a query."""
    p = portions.filter(F.col("rank") <= most)
    head = F.when(F.col("rank") == 1, F.concat(F.lit("According to "), F.col("title"), F.lit(":\n"))).otherwise(F.concat(F.col("title"), F.lit(" also states:\n")))
    rows = p.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(head, F.col("portion")).alias("part"), F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title")).alias("source")))).alias("x"), F.avg("score").alias("mean"))
    return rows.select("query_id", F.concat(F.array_join(F.col("x.part"), "\n\n"), F.lit("\n\nSources:\n"), F.array_join(F.col("x.source"), "\n")).alias("answer"), F.least(F.col("mean") / 25.0, F.lit(1.0)).alias("confidence"))


def bilingual_format(en: Column, ne: Column) -> Column:
    """Both halves under their marks; a missing half is left out."""
    return F.concat_ws("\n\n", F.when(en.isNotNull(), F.concat(F.lit("[EN] "), en)), F.when(ne.isNotNull(), F.concat(F.lit("[NE] "), ne)))


def exact_spans(answer: Column, text: Column) -> Column:
    """X16, exact part: places of the answer's first three words of more than two characters, case-insensitive where need be; overlaps dropped."""
    words = F.slice(F.filter(T.tokens(F.regexp_replace(answer, r"[^\p{L}\p{N}_\s\x{900}-\x{97F}]", " ")), lambda w: F.length(w) > 2), 1, 3)
    found = F.transform(words, lambda w: F.struct(F.when(F.instr(text, w) > 0, F.instr(text, w)).otherwise(F.instr(F.lower(text), F.lower(w))).alias("a"), F.length(w).alias("n")))
    spans = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["a"] > 0), lambda x: F.struct((x["a"] - 1).alias("s"), (x["a"] - 1 + x["n"]).alias("e")))))
    first = F.array().cast("array<struct<s: int, e: int>>")
    return F.aggregate(spans, first, lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] >= F.element_at(acc, -1)["e"]), F.concat(acc, F.array(F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))).otherwise(acc))


def fuzzy_spans(share: float = 0.6):
    """X16, fuzzy part: first window of the text whose words share most of their letters with the phrase's words."""

    @F.pandas_udf("array<int>")
    def find(phrases: pd.Series, texts: pd.Series) -> pd.Series:
        def one(p, t):
            pw, tw = (p or "").split(), [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", t or "")]
            for i in range(len(tw) - len(pw) + 1 if pw else 0):
                win = tw[i : i + len(pw)]
                hits = sum((len(set(a.lower()) & set(b.lower())) >= min(len(a), len(b)) * share) if len(a) > 2 and len(b) > 2 else a.lower() == b.lower() for a, (b, _, _) in zip(pw, win))
                if hits >= len(pw) * share:
                    return [win[0][1], win[-1][2]]
            return None

        return pd.Series([one(p, t) for p, t in zip(phrases, texts)])

    return find


#: Own templates of questions.
QUESTIONS = {"en": ("What does the record say about {}?", "Which decision concerns {}?", "Who is named with {}?"), "ne": ("{}बारे अभिलेखमा के छ?", "{}सम्बन्धी निर्णय के हो?", "{}मा को उल्लेख छ?")}


def questions(topic: Column, language: Column, key: Column) -> Column:
    """A question on a topic by a template that the key's hash picks."""
    k = F.pmod(F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int"), F.lit(3))
    pick = lambda lang: F.element_at(F.array(*[F.lit(x) for x in QUESTIONS[lang]]), (k + 1).cast("int"))
    return F.replace(F.when(language == "ne", pick("ne")).otherwise(pick("en")), F.lit("{}"), topic)


def qa_pairs(chunks: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """Question, answer and spans of qualifying chunks; pairs without a span are left out."""
    from .qacite import extracted

    c = chunks.filter(F.col("language").isin("ne", "en") & (F.col("quality_score") >= least_quality) & (F.length("text") >= 50))
    topic = F.regexp_extract("text", r"([A-Z][a-z]{3,}|[ऀ-ॿ]{4,})", 1)
    c = c.withColumn("answer", extracted(F.col("text"))).withColumn("topic", topic).filter("topic <> '' and answer is not null")
    c = c.withColumn("question", questions(F.col("topic"), F.col("language"), F.col("chunk_id"))).withColumn("start_char", F.instr(F.col("text"), F.col("answer")) - 1)
    return c.filter("start_char >= 0").withColumn("end_char", F.col("start_char") + F.length("answer"))


def content_title(text: Column, fallback: Column) -> Column:
    """First line of a text that is neither short nor long and has letters; else a title from the id."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: T.trimmed(x)), lambda x: (F.length(x).between(15, 80)) & x.rlike(r"\p{L}{4}") & ~F.lower(x).rlike("page|www\\.|http|@"))
    return F.coalesce(F.get(lines, F.lit(0)), F.initcap(F.regexp_replace(fallback, "[_-]+", " ")))


def cross_terms(c: Column, to: str) -> Column:
    """A query in one language with the first two equivalents of a concept's terms put in their place."""
    out = F.array().cast("array<string>")
    for _, ne, en, _ in T.CONCEPTS:
        source, new = (en, ne[:2]) if to == "ne" else (ne, en[:2])
        found_new = F.lit(False)
        for w in ne if to == "ne" else en:
            found_new = found_new | F.contains(c if to == "ne" else F.lower(c), F.lit(w))
        for w in source:
            hit = F.contains(F.lower(c) if to == "ne" else c, F.lit(w)) & ~found_new
            for n in new:
                changed = F.replace(c, F.lit(w), F.lit(n))
                out = F.concat(out, F.when(hit & (changed != c), F.array(changed)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def tfidf_top(df: DataFrame, id_col: str, text: str, k: int = 5) -> DataFrame:
    """M2: words of a text by term frequency times inverse document frequency, the first k; documents are counted once over all."""

    n = df.agg(F.count("*").alias("n_docs"))
    tf = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{3,})"), 1)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(idf, "term").join(F.broadcast(n)).withColumn("score", F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0))
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 6)), "term")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "term", "tf", "score", "rank")


#: Bits of a signature, and the most in which a near row differs from its query.  Random directions differ in half of
#: the bits with a deviation of 8, so about one row in ten passes; a cosine of 0.35 differs in 99.
SIGNATURE_BITS, MOST_DIFFERENT = 256, 118


def signatures(dim: int, seed: int = 7):
    """Signs of fixed random projections of a vector, as four longs."""
    planes = np.random.default_rng(seed).standard_normal((dim, SIGNATURE_BITS))

    @F.pandas_udf("array<long>")
    def sign(v: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(x, np.float64) for x in v]) if len(v) else np.zeros((0, dim))
        return pd.Series(list(np.packbits((m @ planes) > 0, axis=1).view(np.int64)))

    return sign


def save_index(rows: DataFrame, path: str, dim: int = 64) -> DataFrame:
    """Rows with their signatures as a table; load it with spark.read.parquet and search it any number of times."""
    rows.withColumn("sig", signatures(dim)("vec")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def signature_neighbours(queries: DataFrame, rows: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """M3, approximate: every row is indexed by a signature; rows whose signature is near a query's are compared exactly.

    rows may be a saved index, whose signatures are read and not worked out again.

    Rows stay where they are; the signature test is a few bit operations, and only what passes pays for a product."""
    from .search import against_all, dot

    sign = signatures(dim)
    q = queries.withColumn("q_sig", sign("q_vec"))
    r = rows if "sig" in rows.columns else rows.withColumn("sig", sign("vec"))
    differ = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("q_sig")[i])) for i in range(SIGNATURE_BITS // 64)), F.lit(0))
    near = against_all(q, r, "query_id").filter((F.col("query_id") != F.col("row_id")) & (differ <= MOST_DIFFERENT))
    pairs = near.select("query_id", "row_id", (dot(F.col("q_vec"), F.col("vec")) / (F.col("q_norm") * F.col("norm"))).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    return pairs.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).dropDuplicates(["query_id", "row_id"])


def cross_scores(pairs: DataFrame, scorer=None) -> DataFrame:
    """M4: scores of a pair model in Arrow batches; the neutral 0.5 without one."""
    if scorer is None:
        return pairs.withColumn("rerank_score", F.lit(0.5))
    udf = F.pandas_udf(scorer, "double")
    return pairs.withColumn("rerank_score", udf("query", "text"))


def creation_method(p: DataFrame) -> DataFrame:
    """How a page came to be, from its coverage by text and its fonts."""
    return p.withColumn("method", F.when(F.col("has_image") & (F.col("coverage") < 0.1), "ocr_scanned").when((F.col("fonts") > 10) & (F.col("coverage") > 0.3), "mixed").otherwise("born_digital"))


def snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """R2: a version in its own folder; an older one is read again to go back."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return df.sparkSession.read.parquet(f"{root}/version={version}")


def point_to(spark: SparkSession, root: str, version: str, reason: str) -> None:
    """R2: the version in use, as one more entry of the pointer's history."""
    spark.createDataFrame([(version, reason)], "version string, reason string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def in_use(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """R2: the version that the pointer's last entry names."""
    version = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", "at")).first()[0]
    return version, spark.read.parquet(f"{root}/version={version}")


def publish(df: DataFrame, root: str, version: str, accept) -> str:
    """R2: snapshot, evaluation, and rollback: the new version is used, and left for the one before where `accept` refuses it."""
    spark = df.sparkSession
    before = in_use(spark, root) if accept is not None else None
    new = snapshot(df, root, version)
    point_to(spark, root, version, "published")
    if before is not None and not accept(before[1], new):
        point_to(spark, root, before[0], "rolled back")
        return before[0]
    return version


def transliterate(table: dict[str, str]):
    """Whole words from a table, else its longest keys of three, two and one characters in turn."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def word(w):
            if w in table:
                return table[w]
            out, i = [], 0
            while i < len(w):
                for n in (3, 2, 1):
                    if w[i : i + n] in table:
                        out.append(table[w[i : i + n]])
                        i += n
                        break
                else:
                    out.append(w[i])
                    i += 1
            return "".join(out)

        return texts.map(lambda t: None if t is None else " ".join(word(w) for w in t.split()))

    return run


