"""Source files: titles, years, authority patterns, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept small in titles; names of encyclopedias, what guards against them, names of authorities.
SMALL = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
WIKI = (r"(^|[_\W])(wikipedia|wikidata|wikisource|wikibooks|wikimedia)([_\W]|$)", r"(^|[_\W])(en|ne|hi|np)?wiki(pedia)?([_\W]|$)", r"(^|[_\W])(en|ne|hi|np)?wp([_\W]|$)")
NOT_WIKI = "whitepaper|wordpress|wp-content|wpadmin|workplan|work-package"
AUTHORITY = r"(^|[_\W])(gov\.?_?np|govnp|mohp|dohs|heoc|parliament|who(\.int)?)([_\W]|$)"


def title_of(file: Column) -> Column:
    """Stem of a file name, dashes and underscores to spaces; Latin words get a capital except small ones after the first."""
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.[^.]*$", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(stem, "[_-]+", " "), r"\s+", " "))
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))
    titled = F.array_join(F.transform(F.split(plain, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL), F.lower(w)).otherwise(cap(w))), " ")
    return F.when(plain == "", file).when(plain.rlike(r"^[a-zA-Z0-9\s\-_.()]+$"), titled).otherwise(plain)


def year_of(text: Column) -> Column:
    """Latest year from 1950 to 2059 that stands as a word; an underscore is part of a word."""
    years = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(19[5-9][0-9]|20[0-5][0-9])(?![\p{L}\p{N}_])"), 1)
    return F.array_max(F.transform(years, lambda y: y.cast("long")))


def classified(name: Column) -> tuple[Column, Column, Column]:
    """Authority, whether a distractor, and confidence, by patterns of a file name."""
    low = F.lower(name)
    wiki = (low.rlike(WIKI[0]) | low.rlike(WIKI[1]) | low.rlike(WIKI[2])) & ~low.rlike(NOT_WIKI)
    auth = low.rlike(AUTHORITY)
    return F.when(~wiki & auth, "authoritative").otherwise("non_authoritative"), wiki, F.when(wiki, "high").when(auth, "medium").otherwise("low")


def pattern_hits(names: DataFrame, col: str) -> DataFrame:
    """A4: how many names each pattern finds, those found by the third alone, and those that a guard keeps out."""
    low = F.lower(col)
    a, b, c, g = low.rlike(WIKI[0]), low.rlike(WIKI[1]), low.rlike(WIKI[2]), low.rlike(NOT_WIKI)
    return names.agg(F.count_if(a).alias("explicit"), F.count_if(b).alias("wiki"), F.count_if(c).alias("token"), F.count_if(g).alias("guarded"), F.count_if(a | b | c).alias("positive"), F.count_if((a | b | c) & ~g).alias("is_wiki"), F.count_if(c & ~a & ~b).alias("token_only"))


def authority_statistics(m: DataFrame) -> DataFrame:
    """A3: four cells of authority by distractor, zero-filled."""
    a = F.col("authority") == "authoritative"
    d = F.coalesce(F.col("is_distractor"), F.lit(False))
    return m.agg(F.count_if(a & ~d).alias("auth_plain"), F.count_if(a & d).alias("auth_distractor"), F.count_if(~a & ~d).alias("other_plain"), F.count_if(~a & d).alias("other_distractor"))
