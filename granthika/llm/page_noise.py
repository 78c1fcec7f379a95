"""Problem 2: noise in text from scanned pages.

Method: detect and remove running headers, footers and page numbers, then join lines with corpus-vocabulary dehyphenation.
Lines at page edges (short of the line width though the next word would fit, first and last lines) are reduced to a key in
which characters that scanning confuses are equal.  A line is running where it repeats fuzzily over pages of its document:
its key, or one within a few edits of it, stands on another page.  A key is compared with every key of its document that
lengths and pairs of letters, which bound the edits, don't exclude, until one is close; more edits are allowed where the page
is scanned and its recognition unsure (conf_mean, source_page_is_ocr).  Footers are last lines
that repeat on FOOT pages or more.  A line that is only a number is a page number where it is the page's own, is marked as
one, or goes with the pages of its document at one offset.  A word cut at a line end is joined unless the corpus writes it as
a compound.  Misread words are found on the corpus's word counts: a word that becomes a far more frequent one by undoing a
confusion is misread, and is replaced by it.

The word counts are one pass with partial sums; confusions are undone once per distinct word, in a join of the word table
with itself, not once per occurrence.  The resulting table of misread words is broadcast behind a count
(WORKER_WORDS); beyond it, rare words and their blocks are joined by shuffle.

Defined cases: null and empty texts have no noise; repeated rows of a block give one row per kind; blocks that are no text
(tables, figures) are not looked at; null page ids have no page number to compare with; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORKER_WORDS, cut, map_arrow, table
from .sentences import _line_kind
from .vocabulary import count_words

#: What scanning makes of letters, wrong and right, by kind of evidence: signs and digits within words, letters.
SIGNS_FOR_LETTERS = (("1", "l"), ("1", "i"), ("1", "I"), ("1", "ा"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("9", "g"), ("!", "i"), ("!", "l"), ("|", ""), ("|", "l"), ("|", "i"), ("6", "b"), ("8", "B"))
LETTERS_FOR_LETTERS = (
    ("c", "e"), ("f", "t"), ("b", "h"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("ri", "n"),
    ("फ", "क"), ("म", "स"), ("न", "त"), ("व", "ब"), ("म", "भ"), ("ए", "ण"), ("प", "ष"), ("रव", "ख"), ("ध", "घ"), ("ट", "ठ"), ("्", ""), ("झ", "भ"), ("थ", "य"),
)
#: A right word stands at least so many times, and so many times as often as its misreading.
LEAST, TIMES, TIMES_SIGN = 6, 12, 2
#: Pages on which a line must stand to be a running header.
PAGES = 2
#: Share of a document's pages that a long line must head to be a running header.
SHARE = 0.03
#: Pages on which a last line must stand to be a footer, and on which bare numbers must go with the pages at one offset.
FOOT = RUN = 3
#: Edits by which repetitions may differ, as a share of the length: on any page, and more on a scanned page of no confidence.
EDITS, MORE_EDITS = 0.12, 0.12
_L = r"[^\W\d_]|[ऀ-ःऺ-ॏ॑-ॗॢॣ‌‍]"
TOKEN = rf"(?<![\w])[0159!|68]?(?:{_L})+(?:[01589!|6]+(?:{_L})+)*(?:(?<=[a-zऀ-ॿ])[0159](?![\w.,/]))?"
COMPOUND = rf"(?:{_L})+(?:-(?:{_L})+)+"
#: Runs of characters that hold tokens and compounds whole.
CUT = r"[^\s\"“”‘’'()\[\]{}«»,;:?।॥。，、…–—/.]+"
_TOKEN = re.compile(TOKEN)
_CUTS = re.compile(CUT)
_MARK = re.compile("[-\u2010\u00ad\u00ac]\\s")
#: Letters of words that may be cut; capitals with accents stand next to such marks only in wrongly decoded text.
_B = "[A-Za-zà-öø-ÿœऀ-ॣॱ-ॿ‌‍]"
_BREAK = re.compile(rf"({_B}+)([-\u2010\u00ad\u00ac])(?:[ \t]*\r?\n[ \t]*|[ \t]+)({_B}+)")
_HIDDEN = {ord(c): None for c in "\u00ad\u200b\u2060\ufeff\u200e\u200f"}
_HAS_HIDDEN = re.compile("[\u00ad\u200b\u2060\ufeff\u200e\u200f]")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_DEVA = re.compile("[ऀ-ॿ]")
_CONSONANTS = re.compile("(?<=[क-ह])(?=[क-ह])")
_ODD = re.compile("[0-9!|]")
_PAGE = re.compile(r"[^\w\n]{0,4}(?P<word>page|pages|p|pg|पृष्ठ|पृ|पेज|पाना)?[^\w\n]{0,4}(?P<n>[0-9०-९]{1,4}|[ivxlc]{1,7})(?P<of>\s*(?:of|/|\|)\s*(?:[0-9०-९]{1,4}|p\s*a\s*g\s*e))?[^\w\n]{0,4}", re.IGNORECASE)
_PAGE_ID = re.compile(r"_page_0*(\d+)")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
#: Characters that scanning confuses, each class by its first.
_CLASSES = ("il1|!", "o0", "s5", "g9", "ce", "ft", "bh6", "कफ", "समभ", "तन", "बव", "णए", "घध", "पष", "टठ")
_KEY = {ord(c): k[0] for k in _CLASSES for c in k} | {ord(c): None for c in "्‍‌1ा"} | {ord("1"): "i"}
_NOT_KEY = re.compile(r"[^\wऀ-ॿ]+")
_NUMBERS = re.compile(r"[\d०-९]{2,}")
_ENDS = re.compile(r"[।?!\"”,;-]$|[a-z]\.$")


def line_key(line: str) -> str:
    """A line without what scanning changes: case, digits of years and pages, confused characters, spaces."""
    t = line.lower().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("रव", "ख")
    return _NOT_KEY.sub("", _NUMBERS.sub("", t).translate(_KEY))


def page_number(line: str, page: int | None) -> bool:
    """Whether a line is only a page number: of its page, of the page before it, or marked as one."""
    m = _PAGE.fullmatch(line)
    if not m:
        return False
    n = m["n"].lower()
    if n[0] in _ROMAN:
        if m["word"] is None and not n.islower() | (len(n) == len(line.strip())):
            return False
        total = last = 0
        for c in reversed(n):
            v = _ROMAN[c]
            total += v if v >= last else -v
            last = max(last, v)
        n_value = total
    else:
        n_value = int("".join(str(int(c)) for c in n))
    if page is not None and n_value in (page, page - 1):
        return not re.search(r"\d\)?\.$", line) or n_value < 1000
    if m["word"] and len(m["word"]) > 1 or m["of"]:
        return True
    return n[0] in _ROMAN and len(n) > 1 and line.strip() == m["n"] and n.islower()


def bare_number(line: str) -> int | None:
    """The number of a line that is nothing else."""
    m = _PAGE.fullmatch(line)
    if not m or m["n"].lower()[0] in _ROMAN:
        return None
    return int("".join(str(int(c)) for c in m["n"]))


def edge_lines(text: str, page: int | None) -> tuple[list[tuple[int, str, str]], list[int], list[tuple[int, int]]]:
    """Short lines that the line width doesn't explain (index, key, kind), lines with page numbers, and other numbers with their distance from the page.

    Kinds: 'head' at the head of wrapped text, 'line' elsewhere, 'last' for a last line, 'alone' for the only one."""
    lines = text.split("\n")
    stripped = [x.strip() for x in lines]
    numbers = [k for k, x in enumerate(stripped) if x and page_number(x, page)]
    others = [(k, n - page) for k, x in enumerate(stripped) if page is not None and x and k not in numbers and (n := bare_number(x)) is not None]
    if len(lines) < 2:
        key = line_key(stripped[0]) if 7 < len(stripped[0]) <= EDGE and not numbers else ""
        return [(0, key, "alone")] if key else [], numbers, others
    body = [len(x) for k, x in enumerate(stripped) if k not in numbers]
    width = sorted(body)[-(len(body) // 4 + 1)] if body else 0
    wrapped = 30 <= width <= 110 and len(lines) > 2
    out = []
    for k, x in enumerate(stripped):
        if not 7 < len(x) <= EDGE or k in numbers:
            continue
        if k == len(lines) - 1:
            out.append((k, line_key(x), "last"))
            continue
        if _ENDS.search(x):
            continue
        fits = len(x) + 1 + len(stripped[k + 1].split(" ", 1)[0]) <= width - 4
        if (fits or k == 0) and _section_heading(x):
            continue
        out.append((k, line_key(x), "head" if k == 0 and wrapped and (fits or _upper(x) or _TITLE.search(x) is not None) else "line"))
    return [o for o in out if o[1]], numbers, others


#: Most characters of a running line; a line of print holds no more.
EDGE = 120
#: A title parted by a dash or bar that ends in a year or number.
_TITLE = re.compile(r"[|–—].*[\d०-९]\W*$")


def _upper(line: str) -> bool:
    return line.isupper() and len(line) > 8


def _section_heading(line: str) -> bool:
    kind = _line_kind(line)
    return kind >= 4.5 or kind == 4.0 and re.match(r"NOTICE|CHAPTER|ANNEX", line) is not None


def join_breaks(text: str, compounds: frozenset[str] | set[str] = frozenset()) -> tuple[str, bool]:
    """Text with words cut at line ends joined, and whether there were any; compounds keep their hyphen."""
    found = False
    if not _MARK.search(text):
        return text, False

    def one(m: re.Match) -> str:
        nonlocal found
        if f"{m[1]}-{m[3]}".lower() in compounds:
            return f"{m[1]}-{m[3]}"
        found = True
        return m[1] + m[3]

    return _BREAK.sub(one, text), found


def undo(word: str, times: int = 2) -> dict[str, bool]:
    """Words that become `word` by up to `times` confusions, and whether only signs within letters were undone."""
    out: dict[str, bool] = {}
    level = {word: True}
    for step in range(times):
        new: dict[str, bool] = {}
        for w, signs in level.items():
            deva = _DEVA.search(w) is not None
            for wrong, right in SIGNS_FOR_LETTERS:
                if wrong in w and (not right or (right == "ा") == deva):
                    at = w.find(wrong)
                    while at >= 0:
                        new[w[:at] + right + w[at + len(wrong) :]] = signs
                        at = w.find(wrong, at + 1)
            if step == 0 or not _ODD.search(w):
                for wrong, right in LETTERS_FOR_LETTERS:
                    if wrong in w:
                        at = w.find(wrong)
                        while at >= 0:
                            new.setdefault(w[:at] + right + w[at + len(wrong) :], False)
                            at = w.find(wrong, at + 1)
                if deva:
                    for m in _CONSONANTS.finditer(w):
                        new.setdefault(w[: m.start()] + "्" + w[m.start() :], False)
        for w, s in new.items():
            if w != word and w:
                out[w] = out.get(w, False) or s
        level = new
    return out


def misread_words(words: DataFrame) -> DataFrame:
    """(word, right): words that are far rarer than a word they become when confusions are undone."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if len(w) > 1 and not _FOREIGN.search(w):
                rows += [(w, r, n, s) for r, s in undo(w).items() if not _ODD.search(r)]
        if not rows:
            return None
        w, r, n, s = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(r), pa.array(n, pa.int64()), pa.array(s)], ["word", "right", "n", "signs"])

    tried = map_arrow(words.select("word", "n"), run, "word string, right string, n long, signs boolean", 2000)
    common = words.filter(F.col("n") >= LEAST).select(F.col("word").alias("right"), F.col("n").alias("m"))
    enough = F.when(F.col("signs"), F.col("m") >= F.col("n") * TIMES_SIGN).otherwise((F.col("m") >= F.col("n") * TIMES) & (F.length("word") > 2))
    return tried.join(common, "right").filter(enough).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def _prepared(text: str) -> str:
    return _BREAK.sub(r"\1\3", text)


def corpus_words(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Counts of words (joined over line ends) and of compounds within lines, in one pass over the texts."""
    kept = count_words(df, text_col, pattern=rf"{COMPOUND}|{TOKEN}", within=CUT)
    both = cut(kept)
    parts = both.filter(F.col("word").contains("-")).withColumn("part", F.explode(F.split("word", "-"))).select(F.col("part").alias("word"), "n")
    words = both.filter(~F.col("word").contains("-")).unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"))
    return words, both.filter(F.col("word").contains("-"))


def known_compounds(words: DataFrame, compounds: DataFrame) -> DataFrame:
    """Pairs of parts that the corpus writes with a hyphen more often than joined."""
    parts = F.split(F.lower("word"), "-")
    pairs = compounds.select(parts.alias("p"), "n").select(F.explode(F.expr("transform(sequence(0, size(p) - 2), i -> struct(p[i] as a, p[i + 1] as b))")).alias("x"), "n")
    pairs = pairs.groupBy(F.concat_ws("-", "x.a", "x.b").alias("pair"), F.concat("x.a", "x.b").alias("word")).agg(F.sum("n").alias("n"))
    joined = words.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("joined"))
    return pairs.join(joined, "word", "left").filter(F.col("n") > F.coalesce("joined", F.lit(0))).select("pair")


def _collected(df: DataFrame, *cols: str):
    """Rows of a table that a count has shown to be small."""
    return [tuple(r[c] for c in cols) for r in df.select(*cols).toLocalIterator()]


def _words_in(text: str) -> set[str]:
    """Words of a text with its breaks joined and kept, so that compounds of either reading are there."""
    return set(_TOKEN.findall(_prepared(text).translate(_HIDDEN))) | set(_TOKEN.findall(text.translate(_HIDDEN)))


def _own_words(b: pa.RecordBatch, find, name: str) -> pa.RecordBatch | None:
    rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in sorted(find(t))]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], ["__row", name]) if rows else None


class WordTables:
    """Misread words and compounds of a corpus, ready for its rows: broadcast where a count allows, else joined to each row."""

    def __init__(self, blocks: DataFrame, most: int = WORKER_WORDS):
        words, compounds = corpus_words(blocks, "text")
        self.pairs, self.wrong = cut(known_compounds(words, compounds)), cut(misread_words(words))
        self.sent = None
        if self.pairs.count() <= most and self.wrong.count() <= most:
            self.sent = blocks.sparkSession.sparkContext.broadcast((frozenset(p for (p,) in _collected(self.pairs, "pair")), dict(_collected(self.wrong, "word", "right"))))

    def source(self, blocks: DataFrame) -> DataFrame:
        """Rows with columns __pairs and __wrong behind their own, where nothing is broadcast."""
        if self.sent is not None:
            return blocks
        own = cut(blocks.withColumn("__row", F.monotonically_increasing_id()))
        text = own.select("__row", "text")
        mine = map_arrow(text, lambda x: _own_words(x, _words_in, "word"), "__row long, word string").join(self.wrong, "word").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("__wrong"))
        broken = map_arrow(text, lambda x: _own_words(x, lambda t: {f"{m[1]}-{m[3]}".lower() for m in _BREAK.finditer(t)}, "pair"), "__row long, pair string").join(self.pairs, "pair").groupBy("__row").agg(F.collect_set("pair").alias("__pairs"))
        return own.join(mine, "__row", "left").join(broken, "__row", "left").select(*blocks.columns, "__pairs", "__wrong")

    def reader(self):
        """A function of a batch and a row number that gives the row's compounds and misread words; it holds no reference to Spark."""
        sent = self.sent
        if sent is not None:
            return lambda b, k: sent.value
        return lambda b, k: (set(b.column(b.num_columns - 2)[k].as_py() or ()), dict(b.column(b.num_columns - 1)[k].as_py() or ()))


def text_blocks(df: DataFrame) -> DataFrame:
    unsure = F.when(F.col("source_page_is_ocr"), 1 - F.coalesce(F.least(F.greatest("conf_mean", F.lit(0.0)), F.lit(100.0)), F.lit(50.0)) / 100).otherwise(0.0)
    return df.filter((F.col("block_type") == "text") & (F.length("text") > 0)).select("block_id", "doc_id", "page_id", "text", unsure.alias("unsure"))


#: Cuts already looked up, by table of misread words; a worker keeps those of one table.
_SEEN: dict[str, dict[str, bool]] = {}


def _seen(key: str) -> dict[str, bool]:
    if key not in _SEEN:
        _SEEN.clear()
        _SEEN[key] = {}
    return _SEEN[key]


def noise(df: DataFrame, most: int = WORKER_WORDS, tables: WordTables | None = None) -> DataFrame:
    """Operator: (block_id, doc_id, page_id, unsure, kinds, edges, numbers, others) of the text blocks; edges are candidates for running lines."""
    blocks = text_blocks(df)
    tables = tables or WordTables(blocks, most)
    of, shared, key = tables.reader(), tables.sent is not None, uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kinds, edges, numbers, others = [], [], [], []
        seen = _seen(key)
        for k, (page_id, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            known, bad = of(b, k)
            m = _PAGE_ID.search(page_id or "")
            own = []
            e, n, o = edge_lines(text, int(m[1]) if m else None)
            joined, cuts = join_breaks(_without(text, n), known)
            if cuts:
                own.append("hyphenation")
            for c in set(_CUTS.findall(joined.translate(_HIDDEN) if _HAS_HIDDEN.search(joined) else joined)):
                hit = seen.get(c) if shared else None
                if hit is None:
                    hit = not bad.keys().isdisjoint(_TOKEN.findall(c))
                    if shared and len(seen) < 500_000:
                        seen[c] = hit
                if hit:
                    own.append("misread")
                    break
            if n:
                own.append("page_number")
            kinds.append(own)
            edges.append([{"line": i, "key": x, "kind": h} for i, x, h in e])
            numbers.append(n)
            others.append([{"line": i, "off": d} for i, d in o])
        edge, other = pa.struct([("line", pa.int32()), ("key", pa.string()), ("kind", pa.string())]), pa.struct([("line", pa.int32()), ("off", pa.int32())])
        cols = [*b.columns[:3], b.column(4), pa.array(kinds, pa.list_(pa.string())), pa.array(edges, pa.list_(edge)), pa.array(numbers, pa.list_(pa.int32())), pa.array(others, pa.list_(other))]
        return pa.RecordBatch.from_arrays(cols, ["block_id", "doc_id", "page_id", "unsure", "kinds", "edges", "numbers", "others"])

    return map_arrow(tables.source(blocks), run, "block_id string, doc_id string, page_id string, unsure double, kinds array<string>, edges array<struct<line: int, key: string, kind: string>>, numbers array<int>, others array<struct<line: int, off: int>>", 2000)


def _without(text: str, lines) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines) if lines else text


def paragraph(text: str, drop, known, bad) -> str:
    """Continuous text: dropped lines out, cut words joined, lines joined, misread words replaced."""
    text, _ = join_breaks("\n".join(x.strip() for x in _without(text, drop).split("\n")), known)
    return _TOKEN.sub(lambda m: bad.get(m[0], m[0]), " ".join(text.split()))


def paragraphs(df: DataFrame, most: int = WORKER_WORDS) -> DataFrame:
    """Operator: (block_id, paragraph, noise) of every text block; repeated rows stay repeated."""
    blocks = text_blocks(df)
    tables = WordTables(blocks, most)
    found = cut(noise(df, tables=tables))
    own = found.filter(F.size("kinds") > 0).select("block_id", F.explode("kinds").alias("kind"), F.lit(None).cast("int").alias("line"))
    own = own.unionByName(found.select("block_id", F.lit("page_number").alias("kind"), F.explode("numbers").alias("line"))).unionByName(running(found))
    drop = cut(own.groupBy("block_id").agg(F.collect_set("kind").alias("kinds"), F.collect_set("line").alias("drop")))
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS // 4 else drop
    of = tables.reader()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, drops = b.column(1).to_pylist(), b.column(3).to_pylist()
        done = [paragraph(t, set(d or ()), *of(b, k)) for k, (t, d) in enumerate(zip(texts, drops))]
        kinds = [sorted(x or []) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["block_id", "paragraph", "noise"])

    joined = blocks.select("block_id", "text").join(side, "block_id", "left").select("block_id", "text", "kinds", "drop")
    return map_arrow(tables.source(joined), run, "block_id string, paragraph string, noise array<string>", 2000)


def _distance(a: str, b: str, most: float) -> float:
    """Edits between two texts, all columns of the table at once as bits of an integer (Myers); inf once they must be more than `most`."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    last, whole = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, n = whole, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        m = at.get(c, 0)
        d = ((m & up) + up ^ up | m | down) & whole
        more, less = (down | ~(d | up)) & whole, up & d
        n += (more & last != 0) - (less & last != 0)
        if n - left > most:
            return math.inf
        more = more << 1 | 1
        up, down = (less << 1 | ~(d | more)) & whole, more & d & whole
    return n


def _pairs_of_letters(keys: list[str]) -> np.ndarray:
    """Bits of the pairs of neighbouring characters of each key; an edit changes four of them at most."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    bits = np.zeros((len(keys), 256), bool)
    if len(codes) > 1:
        inside = row[1:] == row[:-1]
        pair = (codes[:-1] << np.uint64(21) | codes[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
        bits[row[1:][inside], pair[inside].astype(np.int64)] = True
    return np.packbits(bits, 1).view(np.uint64).reshape(len(keys), 4)


def _with_partner(t: pa.Table) -> pa.RecordBatch | None:
    """Rows of whole groups that ask and have a partner: every one of the group's partners that bounds don't exclude is compared until one is close."""
    doc, part, key, low, high, unsure, ask, partner = (t.column(k).combine_chunks() for k in range(8))
    keys, ask = key.to_pylist(), ask.to_numpy(zero_copy_only=False)
    codes = [np.array(x.dictionary_encode().indices.fill_null(-1)) for x in (doc, low, high)]
    group = np.cumsum(np.concatenate([[0], (codes[0][1:] != codes[0][:-1]) | (np.diff(np.array(part)) != 0)]))
    start = np.searchsorted(group, np.arange(group[-1] + 1))
    n = np.bincount(group, partner.to_numpy(zero_copy_only=False)).astype(np.int64)
    length, sure = np.array([len(k) for k in keys]), np.array(unsure)
    bits = np.ascontiguousarray(_pairs_of_letters(keys).T)
    asking = np.flatnonzero(ask & (n[group] > 0))
    ends = np.cumsum(n[group[asking]])
    out, lo = [], 0
    while lo < len(asking):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        times = n[group[asking[lo:hi]]]
        x = np.repeat(asking[lo:hi], times)
        y = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + start[group[x]]
        most = np.maximum(length[x], length[y]) * (EDITS + MORE_EDITS * np.maximum(sure[x], sure[y]))
        other = np.zeros(len(x), bool)
        for c in codes[1:]:
            other |= (c[x] != c[y]) & (c[x] >= 0) & (c[y] >= 0)
        keep = np.flatnonzero(other & (np.abs(length[x] - length[y]) <= most))
        x, y, most = x[keep], y[keep], most[keep]
        differ = np.zeros(len(x), np.int64)
        for w in bits:
            differ = differ + np.bitwise_count(w[x] ^ w[y])
            keep = np.flatnonzero(differ <= 4 * most)
            x, y, most, differ = x[keep], y[keep], most[keep], differ[keep]
        order = np.lexsort((differ, x))
        done = -1
        for i, j, m in zip(x[order].tolist(), y[order].tolist(), most[order].tolist()):
            if i != done and keys[i] != keys[j] and _distance(keys[i], keys[j], m) <= m:
                out.append(i)
                done = i
        lo = hi
    return pa.RecordBatch.from_arrays([doc.take(pa.array(out)), key.take(pa.array(out))], ["doc_id", "key"]) if out else None


#: Keys of a document that are compared in one group, rows that are compared in one go, and pairs at once; they bound memory, and leave nothing out.
GROUP_KEYS, GROUP_ROWS, PAIRS = 20_000, 50_000, 1 << 20


def _whole_groups(batches):
    """Batches of rows in order, put together and parted between groups."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= GROUP_ROWS:
            t = pa.Table.from_batches(kept).combine_chunks()
            new = np.flatnonzero(np.array(pc.or_(pc.not_equal(t.column(0)[1:], t.column(0)[:-1]), pc.not_equal(t.column(1)[1:], t.column(1)[:-1])).combine_chunks()))
            if len(new):
                yield t.slice(0, int(new[-1]) + 1)
                t = t.slice(int(new[-1]) + 1)
            kept, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(kept)


def _fuzzy(keys: DataFrame, group_keys: int = GROUP_KEYS) -> DataFrame:
    """(doc_id, key) of keys that stand, as they are or within a few edits, on other pages of their document.

    keys: one row a key with the pages it stands on (number, least and greatest) and how unsure they are.  A key of one page is
    compared with all of its document that lengths and pairs of letters leave, until one is close; keys of a document that has
    many are parted by hash, and each part meets each."""
    keys = keys.filter("doc_id IS NOT NULL")
    sizes = keys.groupBy("doc_id").agg(F.ceil(F.count("*") / group_keys).cast("int").alias("parts"))
    own = keys.join(sizes, "doc_id").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["key", "low", "high", "unsure"]
    asking = own.select("doc_id", (F.col("own") * F.col("parts") + F.col("o")).alias("part"), *cols, (F.col("pages") < PAGES).alias("ask"), (F.col("own") == F.col("o")).alias("partner")).filter("ask OR partner")
    partners = own.filter("own <> o").select("doc_id", (F.col("o") * F.col("parts") + F.col("own")).alias("part"), *cols, F.lit(False).alias("ask"), F.lit(True).alias("partner"))
    both = asking.unionByName(partners).repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "part").sortWithinPartitions("doc_id", "part", F.desc("partner"))

    def run(batches):
        for t in _whole_groups(batches):
            if (found := _with_partner(t)) is not None:
                yield found

    close = keys.filter(F.col("pages") >= PAGES).select("doc_id", "key")
    return close.unionByName(both.mapInArrow(run, "doc_id string, key string")).distinct()


def running(found: DataFrame) -> DataFrame:
    """(block_id, kind, line) of each running header and footer, and of each number that goes with the pages at one offset."""
    lines = found.select("block_id", "doc_id", "page_id", "unsure", F.explode("edges").alias("e")).select("block_id", "doc_id", "page_id", "unsure", F.col("e.key").alias("key"), F.col("e.kind").alias("kind"), F.col("e.line").alias("line"))
    pages = lines.filter("kind <> 'alone'").groupBy("doc_id", "key", "page_id").agg(F.max(F.col("kind") == "head").alias("head"), F.max((F.col("line") == 0) & (F.col("kind") != "last")).alias("first"), F.max(F.col("kind") == "last").alias("last"), F.max("unsure").alias("unsure"))
    keys = cut(
        pages.groupBy("doc_id", "key").agg(
            F.count("*").alias("pages"), F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.max("unsure").alias("unsure"), F.max("head").alias("head"),
            F.sum(F.col("first").cast("int")).alias("firsts"), F.sum(F.col("last").cast("int")).alias("lasts"),
        )
    )
    docs = found.filter(F.size("edges") > 0).groupBy("doc_id").agg(F.countDistinct("page_id").alias("all_pages"))
    upper = keys.filter("head OR firsts > 0").select("doc_id", "key", "pages", "low", "high", "unsure")
    often = (F.col("firsts") >= PAGES) & (F.col("firsts") >= SHARE * F.col("all_pages"))
    headers = _fuzzy(upper).join(keys, ["doc_id", "key"]).join(docs, "doc_id").filter(F.col("head") | often).select("doc_id", "key", F.lit("header").alias("is"))
    footers = keys.join(docs, "doc_id").filter((F.col("lasts") >= FOOT) & (F.col("lasts") >= SHARE * F.col("all_pages")) & (F.length("key") >= 8)).select("doc_id", "key", F.lit("footer").alias("is"))
    hit = lines.join(headers.unionByName(footers), ["doc_id", "key"]).filter("CASE WHEN is = 'footer' THEN kind = 'last' ELSE kind <> 'last' END").select("block_id", F.col("is").alias("kind"), "line")
    bare = found.select("block_id", "doc_id", "page_id", F.explode("others").alias("o")).select("block_id", "doc_id", "page_id", F.col("o.line").alias("line"), F.col("o.off").alias("off"))
    going = bare.groupBy("doc_id", "off").agg(F.countDistinct("page_id").alias("n")).filter(F.col("n") >= RUN)
    return hit.unionByName(bare.join(going, ["doc_id", "off"], "left_semi").select("block_id", F.lit("page_number").alias("kind"), "line"))


def p2_found(spark, sf_dir):
    found = cut(noise(table(spark, sf_dir, "corpus_blocks")))
    kinds = found.select("block_id", F.explode("kinds").alias("noise_kind"))
    return kinds.unionByName(running(found).filter("kind <> 'footer'").select("block_id", F.col("kind").alias("noise_kind"))).distinct()


def p2_paragraphs(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "corpus_blocks"))
