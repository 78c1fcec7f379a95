"""Lexical search: a set of queries scored against every row by phrases, word overlap and topics.

Query features (phrases, word sets, topics) are computed once a query; rows are read once and never shuffled before
the top-k, which keeps k rows a query and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import against_all, spread

#: Topic triggers of a query and the words that then count.
CONTEXT = (
    (("government", "political", "governance", "policy", "policies"), ("administration", "state", "public", "official", "law", "regulation")),
    (("rights", "duties", "legal", "law"), ("citizen", "constitutional", "fundamental", "obligation", "freedom")),
    (("health", "medical", "hospital", "treatment"), ("healthcare", "medicine", "patient", "clinic", "therapy")),
    (("emergency", "crisis", "disaster", "covid"), ("response", "management", "protocol", "pandemic", "preparedness")),
)
#: Fixed values: (query words, document words, text phrases, points for the document, points for the text), tried in order.
TOPICS = (
    (("constitution", "fundamental", "rights", "duties", "citizen", "article"), ("constitution", "fundamental"), ("fundamental rights", "constitution", "article", "right to"), 25.0, 15.0),
    (("health", "medical", "hospital", "doctor", "treatment", "medicine"), ("health", "medical", "hospital"), ("health service", "medical", "hospital", "treatment"), 25.0, 15.0),
    (("covid", "coronavirus", "pandemic", "vaccination", "lockdown"), ("covid", "coronavirus"), ("covid", "coronavirus", "pandemic", "vaccination"), 25.0, 15.0),
    (("emergency", "crisis", "disaster", "heoc"), ("heoc", "emergency"), ("emergency", "crisis", "disaster"), 25.0, 15.0),
    (("government", "policy", "ministry", "budget", "law"), ("government", "policy", "ministry", "blue"), (), 20.0, 0.0),
)
GOVERNANCE = ("governance", "political", "policies", "government", "constitution")
GOVERNANCE_TEXT = ("policies relating to political", "governance system", "political and governance", "guarantee the best interests", "maintain rule of law", "good governance", "mass media fair")
MONEY = ("budget allocation", "expenditure", "funding", "financial")


def any_in(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def word_set(c: Column) -> Column:
    """Distinct runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1))


def with_query_features(queries: DataFrame, longest: int = 5) -> DataFrame:
    """What depends on a query alone: lower case, words, tokens, scripts, topics, and its phrases.

    Phrases of 2 to `longest` words are kept by their first word, shortest first (repeated phrases count again), so that
    longer ones are looked for only where the shortest stands."""
    q = F.lower("query")
    tok = T.tokens(q)
    n = F.size(tok)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    longer = lambda i: F.filter(F.sequence(F.lit(2), F.greatest(F.least(n - i + 1, F.lit(longest)), F.lit(2))), lambda k: i + k - 1 <= n)
    phrases = F.filter(F.transform(starts, lambda i: F.transform(longer(i), lambda k: F.struct(F.array_join(F.slice(tok, i, k), " ").alias("p"), k.alias("k")))), lambda g: F.size(g) > 0)
    out = queries.withColumn("q", q).withColumn("q_words", word_set(q)).withColumn("q_tokens", F.array_distinct(tok)).withColumn("q_all", tok).withColumn("phrases", phrases)
    needs = lambda script: F.forall(F.col("phrases"), lambda g: F.get(g, F.lit(0))["p"].rlike(script))
    out = out.withColumn("q_dev", q.rlike(T.DEVANAGARI)).withColumn("needs_dev", needs(T.DEVANAGARI)).withColumn("needs_lat", needs("[a-z]"))
    context = F.concat(*[F.when(any_in(q, ask), F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>")) for ask, words in CONTEXT])
    topic = None
    for i, (ask, *_) in enumerate(TOPICS):
        topic = F.when(any_in(q, ask), i) if topic is None else topic.when(any_in(q, ask), i)
    out = out.withColumn("context", context).withColumn("topic", topic.otherwise(-1))
    return out.withColumn("asks_gov", any_in(q, GOVERNANCE)).withColumn("asks_law", any_in(q, ("governance", "political", "constitution"))).withColumn("asks_health", any_in(q, ("health", "medical", "hospital", "covid"))).withColumn("asks_rights", any_in(q, ("constitution", "fundamental", "rights")))


def phrase_points(base: float, each: float) -> Column:
    """Points of the query's phrases in the row; phrases that all need a script that the row lacks aren't looked for."""
    t = F.col("t")
    begun = F.filter("phrases", lambda g: F.contains(t, F.get(g, F.lit(0))["p"]))
    points = F.aggregate(F.filter(F.flatten(begun), lambda x: F.contains(t, x["p"])), F.lit(0.0), lambda s, x: s + F.lit(base) + x["k"] * F.lit(each))
    return F.when((F.col("needs_dev") & ~F.col("t_has_dev")) | (F.col("needs_lat") & ~F.col("t_has_lat")), 0.0).otherwise(points)


def overlap() -> tuple[Column, Column]:
    """Shares of common words in both and in the query's words; 0 where one has none."""
    both = F.col("n_both")
    ok = (F.size("q_words") > 0) & (F.size("t_words") > 0)
    return F.when(ok, both / (F.size("q_words") + F.size("t_words") - both)).otherwise(0.0), F.when(ok, both / F.size("q_words")).otherwise(0.0)


def coverage() -> Column:
    """Share of the query's words among the row's words between white space."""
    return F.when(F.size("q_tokens") > 0, F.size(F.array_intersect("q_tokens", "t_tokens")) / F.size("q_tokens")).otherwise(0.0)


def _clause(points: float) -> Column:
    return F.when(F.col("text").rlike(r"\([0-9०-९]+\)"), points).otherwise(0.0)


def _article(words: str, points: float) -> Column:
    return F.when(F.col("t").rlike(rf"({words}) [0-9०-९]+"), points).otherwise(0.0)


def _length(*steps) -> Column:
    n = F.length("text")
    out = F
    for low, points in steps:
        out = out.when(n > low, points)
    return out.otherwise(0.0)


def row_points(variant: str) -> Column:
    """Points that a row has for any query."""
    n = F.length("text")
    if variant == "dynamic":
        lists = F.when(F.col("text").rlike(r"[a-z]\)\s|[0-9]+\.\s"), 2.0).otherwise(0.0)
        return _clause(4.0) + _article("article|section|chapter", 3.0) + lists + F.when(n.between(100, 1000), 2.0).when(n > 1000, 1.0).otherwise(0.0)
    if variant == "simple":
        return _clause(4.0) + _article("article|section", 3.0)
    if variant == "bilingual":
        return _clause(5.0) + _article("article|section|धारा", 4.0) + F.when(F.col("t_has_dev") & (F.col("t_dev") / n > 0.1), 10.0).otherwise(0.0)
    if variant == "intelligent":
        return _length((500, 5.0), (200, 2.0)) + F.when(F.col("text").rlike("[0-9०-९]{4}"), 2.0).otherwise(0.0) + _article("article|section|chapter", 3.0)
    if variant == "fixed":
        return _length((500, 3.0), (200, 1.0)) + F.when(F.col("t").rlike(r"(article|section|chapter) [0-9०-९]+|\([0-9०-९]+\)"), 4.0).otherwise(0.0)
    return F.lit(0.0)


def with_row_features(rows: DataFrame, variant: str) -> DataFrame:
    """What depends on a row alone."""
    t = F.lower("text")
    r = rows.filter(F.col("text").isNotNull()).withColumn("t", t).withColumn("d", F.lower("doc_id")).withColumn("t_has_dev", F.col("text").rlike(T.DEVANAGARI)).withColumn("t_has_lat", t.rlike("[a-z]"))
    if variant in ("dynamic", "simple", "bilingual"):
        r = r.withColumn("t_words", word_set(t))
    if variant == "bilingual":
        r = r.withColumn("t_lang2", T.web_language(F.col("text"))).withColumn("t_dev", T.count_of(F.col("text"), T.DEVANAGARI))
    if variant in ("intelligent", "fixed"):
        r = r.withColumn("t_tokens", F.array_distinct(T.tokens(t)))
    if variant == "intelligent":
        r = r.withColumn("topics", F.array(*[F.when(any_in(F.col("d"), docs), a).when(any_in(F.col("t"), phrases), b).otherwise(0.0) for _, docs, phrases, a, b in TOPICS]))
    if variant == "fixed":
        own = any_in(F.col("t"), ("governance", "political", "constitution"))
        r = r.withColumn("gov_points", F.when(F.contains("d", F.lit("constitution")), 30.0 + F.when(any_in(F.col("t"), GOVERNANCE_TEXT), 20.0).otherwise(0.0)).otherwise(0.0)).withColumn("d_health", any_in(F.col("d"), ("health", "covid", "medical"))).withColumn("off_topic", any_in(F.col("t"), MONEY) & ~own)
    if variant == "words":
        r = r.withColumn("t_law", any_in(F.col("t"), ("constitution", "fundamental", "rights", "duties"))).withColumn("t_health", any_in(F.col("t"), ("health", "medical", "hospital", "treatment")))
    return r.withColumn("row_points", row_points(variant))


def score_dynamic() -> Column:
    """K8, K14."""
    jaccard, cover = overlap()
    context = F.size(F.filter("context", lambda w: F.contains(F.col("t"), w)))
    return F.when(F.contains("t", "q"), 25.0).otherwise(0.0) + phrase_points(5.0, 2.0) + jaccard * 15.0 + cover * 10.0 + context * 3.0 + F.col("row_points")


def score_simple() -> Column:
    """K10."""
    jaccard, cover = overlap()
    return F.when(F.contains("t", "q"), 25.0).otherwise(0.0) + phrase_points(5.0, 2.0) + jaccard * 15.0 + cover * 10.0 + F.col("row_points")


def score_bilingual() -> Column:
    """K9."""
    jaccard, cover = overlap()
    s = F.when(F.col("q_lang2") == F.col("t_lang2"), 15.0).otherwise(0.0) + F.when(F.col("q_dev") & F.col("t_has_dev"), 50.0).when(F.col("q_dev"), -30.0).otherwise(0.0)
    return s + F.when(F.contains("t", "q"), 30.0).otherwise(0.0) + phrase_points(8.0, 3.0) + jaccard * 20.0 + cover * 15.0 + F.col("row_points")


def score_intelligent() -> Column:
    """K11; the factor for another language comes last."""
    topic = F.when(F.col("topic") >= 0, F.get("topics", F.col("topic"))).otherwise(0.0)
    s = F.when(F.contains("t", "q"), 20.0).otherwise(0.0) + coverage() * 15.0 + topic + F.col("row_points")
    return F.when(F.col("prefer") == "auto", s).when(F.coalesce(F.col("language"), F.lit("en")) == F.col("prefer"), s + 5.0).otherwise(s * 0.8)


def score_fixed() -> Column:
    """K12; factors apply to what has been added up before them."""
    s = F.when(F.contains("t", "q"), 25.0).otherwise(0.0) + phrase_points(10.0, 2.0) + F.when(F.col("asks_gov"), F.col("gov_points")).otherwise(0.0) + coverage() * 12.0
    s = F.when(F.col("asks_health") & F.col("d_health"), s + 15.0).when(F.col("asks_health") & F.col("asks_law"), s * 0.3).otherwise(s)
    s = s + F.col("row_points")
    s = F.when(F.col("asks_law") & F.col("off_topic"), s * 0.1).otherwise(s)
    return F.when(F.col("prefer") == "auto", s).when(F.coalesce(F.col("language"), F.lit("en")) == F.col("prefer"), s + 3.0).otherwise(s * 0.9)


def score_words() -> Column:
    """Whole query, words as substrings and their share, two topics."""
    hits, n = F.size(F.filter("q_all", lambda w: F.contains(F.col("t"), w))), F.size("q_all")
    s = F.when(F.contains("t", "q"), 10.0).otherwise(0.0) + hits * 1.0 + F.when(n > 1, hits / n * 5.0).otherwise(0.0)
    return s + F.when(F.col("t_law") & F.col("asks_rights"), 3.0).otherwise(0.0) + F.when(F.col("t_health") & F.col("asks_health"), 3.0).otherwise(0.0)


VARIANTS = {"dynamic": (score_dynamic, 3.0), "simple": (score_simple, 2.0), "bilingual": (score_bilingual, 1.0), "intelligent": (score_intelligent, 1.0), "fixed": (score_fixed, 2.0), "words": (score_words, 0.0)}


def lexical_search(queries: DataFrame, rows: DataFrame, variant: str = "dynamic", k: int = 10) -> DataFrame:
    """Score every row for every query, keep scores above the variant's bound, the first k a query (ties by chunk_id).

    Rows without text score nothing; repeated rows of a chunk are one."""
    score, bound = VARIANTS[variant]
    q = with_query_features(queries, 40 if variant == "fixed" else 5).withColumn("q_lang2", T.web_language(F.col("query")))
    pairs = against_all(q, with_row_features(spread(rows), variant), "query_id")
    if variant in ("dynamic", "simple", "bilingual"):
        pairs = pairs.withColumn("n_both", F.size(F.array_intersect("q_words", "t_words")))
    pairs = pairs.withColumn("score", score()).filter(F.col("score") > bound).select("query_id", "chunk_id", "doc_id", "page_id", "source_authority", "score")
    # equal rows of one chunk share a dense rank, so the limit cuts before the shuffle and repeated rows go after it
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return pairs.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k).dropDuplicates(["query_id", "chunk_id"])


def sentence_ranking(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Sentences of a text by the share of the query's words they hold; the first k a pair, in that order."""
    s = pairs.select("query_id", "chunk_id", "q_words", F.posexplode(F.split("text", "[.!?।॥]+")).alias("pos", "sentence"))
    s = s.withColumn("sentence", T.trimmed(F.col("sentence"))).filter(F.length("sentence") > 10)
    share = F.size(F.array_intersect("q_words", word_set(F.lower("sentence")))) / F.greatest(F.size("q_words"), F.lit(1))
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("share"), "pos")
    return s.withColumn("share", share).filter(F.col("share") > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "pos", "sentence", "share", "rank")
