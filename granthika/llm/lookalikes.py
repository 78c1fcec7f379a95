"""Problem 3: text that looks alike but differs in its characters.

Method: script-aware repair.  Forms that never change the look are folded first: width forms, joined letters, composition
of accents and signs, invisible characters, kinds of space and hyphen.  Then the dominant script of each token is
determined; in a token of mixed scripts, letters of the other script are replaced by their look-alikes of the dominant
one, and only where the resulting word is in the corpus's vocabulary (count_words over all rows).  Where both scripts
hold as many letters, and where a token consists of look-alikes alone, the text's dominant script decides.

The distinct mixed tokens and their replacements are one small table; it is broadcast behind a count (WORKER_WORDS),
and beyond it the tokens are joined by shuffle with the rows that hold any.

Defined cases: null stays null, empty stays empty; repeated rows stay repeated; ids may repeat; other columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_WORDS, cut, light, map_arrow, table
from .vocabulary import count_words

#: Letters of other scripts and the Latin letters that look like them.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXbaesijopcyxhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυ", "ABEZHIKMNOPTYXoivpu"))
ARMENIAN = dict(zip("օսոհՕ", "ounhO"))
TO_LATIN = CYRILLIC | GREEK | ARMENIAN
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()}
#: Characters without a look of their own.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
SIGNS = {"\u037e": ";", "\u0387": "\u00b7", "\u2219": "\u00b7", "\u22c5": "\u00b7", "\u02bc": "\u2019", "\u2215": "/", "\u2044": "/", "\u2024": ".", "\u2236": ":", "\ua789": ":", "\u201a": ",", "\u201b": "\u2018", "\u01c3": "!", "\u0251": "a", "\u0261": "g", "\u217c": "l"}
#: Devanagari signs that are written in two ways.
DEVANAGARI = {"ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ"}

_FOLD = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS} | {ord(a): b for a, b in SIGNS.items()}
_FOLD |= {c: unicodedata.normalize("NFKC", chr(c)) for r in ((0xFF01, 0xFFEF), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x2103, 0x2104), (0x2109, 0x210A), (0x01C4, 0x01CD), (0x0132, 0x0134)) for c in range(*r) if c not in _FOLD and unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_FOLDABLE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FOLD)) + "]")
_DANDA = re.compile("(?<=[\u0900-\u097f])( ?)[|\uff5c\u01c0\u2223](?!\\w)")
_SIGNS = re.compile("|".join(DEVANAGARI))
_ODD = re.compile("[^\x00-\x7f]|\t")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_FOREIGN = re.compile("[Ͱ-ԯ԰-֏]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
#: Letters of all scripts towards which a token may be repaired; words without any can't be a repair.
REPAIRABLE = "[A-Za-zÀ-ɏͰ-֏]"


def fold(text: str | None) -> str | None:
    """One form for all that never changes the look."""
    if not text or not _ODD.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_FOLD) if _FOLDABLE.search(text) else text)
    while True:
        new = _SIGNS.sub(lambda m: DEVANAGARI[m[0]], text)
        if new == text:
            break
        text = new
    return _DANDA.sub(r"\1।", text)


def _script(c: str) -> str:
    return "latin" if _LATIN.match(c) else "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "armenian" if "԰" <= c <= "֏" else "other"


def repair_of(token: str, latin_text: bool) -> str | None:
    """The token in its dominant script, where each letter of another one has a look-alike there; else nothing."""
    count: dict[str, int] = {}
    for c in token:
        s = _script(c) if c.isalpha() else ""
        if s:
            count[s] = count.get(s, 0) + 1
    if "other" in count or not count or set(count) == {"latin"}:
        return None
    most = max(count.values())
    best = [s for s in count if count[s] == most]
    target = "latin" if latin_text and ("latin" in best or len(count) == 1) else best[0]
    if len(best) > 1 and not latin_text and "latin" in best:
        target = next(s for s in best if s != "latin")
    if latin_text and len(count) > 1 and all(_script(c) == "latin" or c in TO_LATIN for c in token if c.isalpha()):
        target = "latin"
    if len(count) == 1 and target in count:
        return None
    to = {"latin": TO_LATIN, "cyrillic": TO_CYRILLIC, "greek": TO_GREEK}.get(target, {})
    out = [c if not c.isalpha() or _script(c) == target else to.get(c) for c in token]
    return None if None in out else "".join(out)


def mixed_tokens(text: str | None) -> dict[str, str]:
    """Tokens of a folded text that hold letters of another script, with their repair."""
    if not text or not _FOREIGN.search(text):
        return {}
    latin = len(_LATIN.findall(text)) >= len(_FOREIGN.findall(text))
    return {t: r for t in _TOKEN.findall(text) if _FOREIGN.search(t) and (r := repair_of(t, latin))}


def apply(text: str | None, words: dict[str, str] | set[str]) -> str | None:
    """The folded text with those mixed tokens repaired whose repair is in `words`."""
    mixed = {t: r for t, r in mixed_tokens(text).items() if r in words}
    return _TOKEN.sub(lambda m: mixed.get(m[0], m[0]), text) if mixed else text


def _mixed_of(df: DataFrame, *cols: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = {r for c in range(b.num_columns) for t in b.column(c).to_pylist() if t and _FOREIGN.search(t) for r in mixed_tokens(fold(t)).values()}
        return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"]) if found else None

    return map_arrow(df.select(*cols), run, "word string", 5000).distinct()


def known_words(df: DataFrame, cols: list[str], words: DataFrame) -> DataFrame:
    """The repairs of all mixed tokens in df's columns that are words of the corpus; parts of a compound count each."""
    part = _mixed_of(df, *cols).withColumn("part", F.explode(F.split("word", r"[’'-]")))
    return part.join(words.select(F.col("word").alias("part"), "n"), "part", "left").groupBy("word").agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0").select("word")


def unify(df: DataFrame, cols: list[str], words: DataFrame, most: int = WORKER_WORDS) -> DataFrame:
    """Operator: df with each of cols in one consistent form."""
    known = cut(known_words(df, cols, words))
    names = df.columns
    at = [names.index(c) for c in cols]
    plain = {c: F.col(f"`{c}`") for c in names}

    def run_with(words_of):
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out = list(b.columns)
            for k in at:
                out[k] = pa.array([apply(fold(t), w) if t else t for t, w in zip(b.column(k).to_pylist(), words_of(b))], pa.string())
            return pa.RecordBatch.from_arrays(out[: len(names)], names)

        return run

    if known.count() <= most:
        all_words = df.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in known.collect()))
        return map_arrow(df.select(*plain.values()), run_with(lambda b: repeat(all_words.value)), df.schema, 1000)
    keyed = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    per_row = map_arrow(keyed.select("__row", *cols), lambda b: _row_words(b), "__row long, word string", 1000)
    lists = per_row.join(known, "word").groupBy("__row").agg(F.collect_list("word").alias("__words"))
    joined = keyed.join(lists, "__row", "left").select(*plain.values(), "__words")
    return map_arrow(joined, run_with(lambda b: [frozenset(w or ()) for w in b.column(len(names)).to_pylist()]), df.schema, 1000)


def _row_words(b: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = sorted({(i, r) for c in range(1, b.num_columns) for i, t in zip(b.column(0).to_pylist(), b.column(c).to_pylist()) if t and _FOREIGN.search(t) for r in mixed_tokens(fold(t)).values()})
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.string())], ["__row", "word"]) if rows else None


def p3_found(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "text")
    items = table(spark, sf_dir, "proper_manual_qacite").select("qa_id", "chunk_id", "answer_exact").filter("answer_exact <> ''")
    side = F.broadcast(items) if light(items) else items
    cited = chunks.join(side, "chunk_id").filter(~F.contains("text", "answer_exact"))
    words = count_words(chunks, where=REPAIRABLE)
    same = unify(cut(cited), ["answer_exact", "text"], words).filter(F.contains("text", "answer_exact"))
    return same.select("qa_id", "chunk_id").distinct()


def p3_unified(spark, sf_dir):
    """The texts of documents, chunks and blocks and the answers, each row with its table and id, under one vocabulary."""
    sources = (("documents", "doc_id", "text"), ("chunks", "chunk_id", "text"), ("corpus_blocks", "block_id", "text"), ("proper_manual_qacite", "qa_id", "answer_exact"))
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(i).cast("string").alias("id"), F.col(c).alias("text")) for t, i, c in sources]
    rows = reduce(DataFrame.unionByName, parts)
    return unify(rows, ["text"], count_words(rows, where=REPAIRABLE))
