"""Column functions on text: scripts, language by script, noise, coherence, tokens, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVANAGARI = "[ऀ-ॿ]"
#: Substrings that typically stand in Nepali set in legacy fonts.
ROMANISED = ("kf", "sf]", ";+", "df", "gf]", "xf]", "g]", "df]", "tf", "sf", "nf", "rf", "hf", "wf")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def devanagari_ratio(c: Column) -> Column:
    """L1: Devanagari characters by letters; signs count above and not below, so it may exceed 1; 0 without letters."""
    letters = count_of(c, r"\p{L}")
    return F.when(letters > 0, count_of(c, DEVANAGARI) / letters).otherwise(0.0)


def block_language(c: Column) -> Column:
    """L2."""
    r = devanagari_ratio(c)
    blank = c.isNull() | (F.length(trimmed(c)) == 0) | (count_of(c, r"\p{L}") == 0)
    return F.when(blank, "mixed").when(r > 0.6, "ne").when(r < 0.1, "en").otherwise("mixed")


def query_language(c: Column) -> tuple[Column, Column]:
    """L3: language and confidence of a query by its script."""
    r = devanagari_ratio(c)
    blank = c.isNull() | (F.length(trimmed(c)) == 0)
    lang = F.when(blank, "mixed").when(r > 0.7, "ne").when(r < 0.05, "en").otherwise("mixed")
    conf = F.when(blank, 0.0).when(r > 0.7, F.least(F.lit(1.0), 0.7 + 0.3 * r)).when(r < 0.05, 0.7 + 0.3 * (1.0 - r)).otherwise(0.5)
    return lang, conf


def script_shares(c: Column) -> tuple[Column, Column, Column]:
    """Shares of Devanagari, Latin and other characters in the length; 0 for empty text."""
    n = F.length(c)
    d, latin = count_of(c, DEVANAGARI), count_of(c, "[a-zA-Z]")
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return share(d), share(latin), share(n - d - latin)


def web_language(c: Column) -> Column:
    """Nepali where Devanagari and legacy-font hints pass 0.3 of the letters."""
    hints = sum((F.contains(F.lower(c), F.lit(p)).cast("int") for p in ROMANISED), F.lit(0))
    letters = count_of(c, r"\p{L}")
    return F.when(letters == 0, "en").when((count_of(c, DEVANAGARI) + 2 * hints) / letters > 0.3, "ne").otherwise("en")


def simple_language(c: Column) -> Column:
    """L22."""
    d, latin = count_of(c, DEVANAGARI), count_of(c, "[a-zA-Z]")
    return F.when(d > latin, "ne").when(latin > 0, "en").otherwise("unknown")


def filename_language(c: Column) -> Column:
    """By the share of Devanagari among letters of both scripts in a file name; English without any."""
    d, latin = count_of(c, DEVANAGARI), count_of(c, "[A-Za-z]")
    return F.when(d + latin == 0, "en").when(d / (d + latin) >= 0.25, "ne").otherwise("en")


def is_garbage(c: Column, w: Column | None = None) -> Column:
    """Noise of character recognition; w: the text's tokens, where they are a column already."""
    n, alpha, digit, space = F.length(c), count_of(c, r"\p{L}"), count_of(c, r"\p{Nd}"), count_of(c, r"[\s]")
    w = tokens(c) if w is None else w
    lone = F.size(F.filter(w, lambda x: F.length(x) == 1))
    d = count_of(c, DEVANAGARI)
    latin = count_of(c, r"[\p{L}&&[\x{0}-\x{8ff}]]")
    return (
        F.when(c.isNull() | (n < 10), True)
        .when(alpha / n < 0.3, True)
        .when((n - alpha - digit - space) / n > 0.4, True)
        .when((F.size(w) > 5) & (lone / F.size(w) > 0.6), True)
        .when((n < 100) & (d > 0) & (latin > 0) & (F.least(d, latin) < 5), True)
        .otherwise(False)
    )


def coherence(c: Column, w: Column | None = None) -> Column:
    """L7; w: the text's tokens, where they are a column already."""
    w = tokens(c) if w is None else w
    n = F.size(w)
    mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n
    short, long = F.size(F.filter(w, lambda x: F.length(x) <= 2)), F.size(F.filter(w, lambda x: F.length(x) >= 4))
    points = 5 + F.when(mean.between(3, 12), 2).otherwise(0) + F.when(short / n < 0.5, 2).otherwise(0) + F.when(long / n > 0.3, 1).otherwise(0)
    return F.when(c.isNull() | (F.length(c) == 0), 0.0).when(n < 3, 0.3).otherwise(points / 10.0)


#: Substitutions tried in this order when text is reconstructed.
FIXES = ((r"(?<![\p{L}\p{N}_])0(?![\p{L}\p{N}_])", "O"), (r"(?<![\p{L}\p{N}_])1(?![\p{L}\p{N}_])", "I"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("०", "0"), ("१", "1"))


def reconstruct(c: Column) -> tuple[Column, Column]:
    """Text with common misreadings undone, and a score from the steps that changed it and the length kept."""
    steps, cur = F.lit(0), c
    for pattern, new in (*FIXES, (r"\s+", " ")):
        after = F.regexp_replace(cur, pattern, new)
        steps, cur = steps + (after != cur).cast("int"), after
    kept = F.array_join(F.filter(F.split(cur, " "), lambda x: (F.length(x) > 1) | x.rlike(r"^[\p{Nd}aAiIoO]$")), " ")
    steps, cur = steps + (kept != cur).cast("int"), kept
    same = (cur == "") | (cur == c)
    score = F.least(F.lit(1.0), steps * 0.3 + F.length(cur) / F.greatest(F.length(c), F.lit(1)) * 0.7)
    return F.when(same, c).otherwise(cur), F.when(same, 0.0).otherwise(score)


def with_chunk_language(df: DataFrame, text: str) -> DataFrame:
    """L5 over L6-L8: columns lang and lang_conf of a chunk, after reconstruction where it looks like noise.

    Each stage is a column of its own, so that no measure is computed twice."""
    df = df.withColumn("_t", trimmed(F.col(text))).withColumn("_w", tokens(F.col("_t"))).withColumn("_g", is_garbage(F.col("_t"), F.col("_w")))
    cur, steps = F.when(F.col("_g"), F.col("_t")), F.lit(0)
    names = []
    for k, (pattern, new) in enumerate((*FIXES, (r"\s+", " "))):
        df = df.withColumn(f"_f{k}", F.regexp_replace(cur, pattern, new))
        steps = steps + (F.col(f"_f{k}") != cur).cast("int")
        cur = F.col(f"_f{k}")
        names.append(f"_f{k}")
    kept = F.array_join(F.filter(F.split(cur, " "), lambda x: (F.length(x) > 1) | x.rlike(r"^[\p{Nd}aAiIoO]$")), " ")
    df = df.withColumn("_k", kept).withColumn("_s", steps + (F.col("_k") != cur).cast("int"))
    same = F.col("_k").isNull() | (F.col("_k") == "") | (F.col("_k") == F.col("_t"))
    df = df.withColumn("_gain", F.when(same, 0.0).otherwise(F.least(F.lit(1.0), F.col("_s") * 0.3 + F.length("_k") / F.greatest(F.length("_t"), F.lit(1)) * 0.7)))
    use = F.col("_g") & (F.col("_gain") > 0.3)
    df = df.withColumn("_x", F.when(use, F.col("_k")).otherwise(F.col("_t"))).withColumn("_still", F.when(use, is_garbage(F.col("_k"))).otherwise(F.col("_g")))
    df = df.withColumn("_r", devanagari_ratio(F.col("_x"))).withColumn("_w", tokens(F.col("_x"))).withColumn("_c", coherence(F.col("_x"), F.col("_w")))
    r, coh, gain = F.col("_r"), F.col("_c"), F.when(F.col("_g"), F.col("_gain")).otherwise(0.0)
    lang = F.when(F.col("_t") == "", "mixed").when(r > 0.7, "ne").when(r < 0.05, "en").otherwise("mixed")
    conf = (
        F.when(F.col("_t") == "", 0.0)
        .when(r > 0.7, F.least(F.lit(1.0), 0.6 + 0.4 * r + 0.2 * coh + 0.1 * gain))
        .when(r < 0.05, F.least(F.lit(1.0), 0.6 + 0.4 * (1.0 - r) + 0.2 * coh + 0.1 * gain))
        .when(F.col("_still") & (gain < 0.2), 0.1)
        .otherwise(0.5 * coh + 0.1 * gain)
    )
    return df.withColumn("lang", lang).withColumn("lang_conf", conf).drop("_t", "_w", "_g", "_k", "_s", "_gain", "_x", "_still", "_r", "_c", *names)


#: Query-side dictionaries.
ENGLISH_WORDS = (r"(?<![\p{L}\p{N}_])(the|and|or|of|in|to|for|with|by|from|up|about|into|through|during)(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])(health|ministry|government|constitution|emergency|operations|center)(?![\p{L}\p{N}_])")
DOMAINS = (
    ("constitution", "संविधान|constitution|कानून|law|अधिकार|rights|न्याय|justice"),
    ("health", "स्वास्थ्य|health|चिकित्सा|medical|रोग|disease|उपचार|treatment"),
    ("emergency", "आपातकाल|emergency|संकट|crisis|विपद्|disaster|heoc"),
    ("government", "सरकार|government|मन्त्रालय|ministry|प्रशासन|administration"),
    ("covid", "कोभिड|covid|कोरोना|corona|महामारी|pandemic|भ्याक्सिन|vaccine"),
)
CONCEPTS = (
    ("constitution", ("संविधान", "कानून", "ऐन", "नियम", "विधान"), ("constitution", "law", "act", "regulation", "statute"), 1.0),
    ("health", ("स्वास्थ्य", "चिकित्सा", "उपचार", "रोग", "आरोग्य"), ("health", "medical", "treatment", "disease", "healthcare"), 0.9),
    ("government", ("सरकार", "राज्य", "प्रशासन", "मन्त्रालय", "निकाय"), ("government", "state", "administration", "ministry", "agency"), 0.85),
    ("emergency", ("आपातकाल", "संकटकाल", "विपद्", "दुर्घटना", "आकस्मिक"), ("emergency", "crisis", "disaster", "accident", "urgent"), 0.8),
    ("rights", ("अधिकार", "हक", "स्वतन्त्रता", "न्याय", "समानता"), ("rights", "freedom", "liberty", "justice", "equality"), 0.9),
)
TABLE_WORDS = "table टेबल सूची list data statistics numbers count total sum chart graph संख्या तालिका डाटा आँकडा गणना compare vs versus तुलना कति".split()
SYNONYMS = {
    "स्वास्थ्य": "चिकित्सा", "आपतकालीन": "संकटकाल", "सरकार": "राज्य", "संविधान": "कानून",
    "health": "medical", "emergency": "crisis", "government": "administration", "constitution": "law",
}
TEMPLATES = {
    "constitution": (("संविधानमा {}", "{} कानूनी व्यवस्था"), ("constitutional {}", "{} legal framework")),
    "health": (("स्वास्थ्य क्षेत्रमा {}", "{} चिकित्सा सेवा"), ("health sector {}", "{} medical services")),
    "emergency": (("आपातकालीन {}", "{} संकट व्यवस्थापन"), ("emergency {}", "{} crisis management")),
}


def english_patterns(c: Column) -> Column:
    """L11, English side."""
    return sum((count_of(F.lower(c), p) for p in ENGLISH_WORDS), F.lit(0))


def domain(c: Column) -> Column:
    """Domain whose pattern is found most often; the first declared of ties; general without any."""
    n = [count_of(F.lower(c), f"(?:{p})") for _, p in DOMAINS]
    most = F.greatest(*n)
    out = F.when(most == 0, "general")
    for (name, _), k in zip(DOMAINS, n):
        out = out.when(k == most, name)
    return out.otherwise("general")


def concept_count(c: Column) -> Column:
    """How many concepts a query touches."""
    return sum((_touches(c, ne, en).cast("int") for _, ne, en, _ in CONCEPTS), F.lit(0))


def concept_weight(c: Column) -> Column:
    """Mean weight of the concepts touched, 0 without any."""
    n = concept_count(c)
    total = sum((F.when(_touches(c, ne, en), w).otherwise(0.0) for _, ne, en, w in CONCEPTS), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(0.0)


def _any_in(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _touches(c: Column, ne, en) -> Column:
    return _any_in(c, ne) | _any_in(F.lower(c), en)


def is_tabular(c: Column) -> Column:
    """L19."""
    return (count_of(c, "[0-9०-९]") / F.greatest(F.length(c), F.lit(1)) > 0.08) | _any_in(F.lower(c), (*TABLE_WORDS, "how many"))


def synonym_expansion(c: Column) -> Column:
    """The query with its first word that has a synonym replaced by it; null without one."""
    words = F.filter(tokens(F.lower(c)), lambda x: x.isin(list(SYNONYMS)))
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    first = F.get(words, F.lit(0))
    return F.when(F.size(words) > 0, F.replace(F.lower(c), first, table[first]))


def target_language(c: Column) -> Column:
    """L9, automatic mode."""
    lang, conf = query_language(c)
    d, latin, _ = script_shares(c)
    return (
        F.when(c.isNull() | (F.length(trimmed(c)) == 0), "en")
        .when((conf >= 0.8) & lang.isin("ne", "en"), lang)
        .when((conf >= 0.6) & (d > 0.3), "ne")
        .when((conf >= 0.6) & (latin > 0.7) & (english_patterns(c) > 0), "en")
        .when(d > latin, "ne")
        .when(latin > d, "en")
        .when(english_patterns(c) > 0, "en")
        .when(lang.isin("ne", "en"), lang)
        .otherwise("en")
    )


def expansions(c: Column, lang: str) -> Column:
    """L16, domain part, and U7: the query, its domain templates in one language, ordered, distinct, at most four."""
    k = 0 if lang == "ne" else 1
    extra = F.array().cast("array<string>")
    dom = domain(c)
    out = F.when(F.lit(False), extra)
    for name, pairs in TEMPLATES.items():
        out = out.when(dom == name, F.array(*[F.replace(F.lit(t), F.lit("{}"), c) for t in pairs[k]]))
    return F.slice(F.array_distinct(F.concat(F.array(c), out.otherwise(extra))), 1, 4)
