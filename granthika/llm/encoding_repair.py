"""Problem 5: text decoded with the wrong character encoding.

Method: noisy-channel decoding.  For each encoding that may have been taken by mistake, a run of characters is laid out
as a lattice of bytes: a character stands for its byte in that encoding, the replacement character for a wildcard over
the bytes that the encoding cannot show.  A Viterbi search over the lattice finds the UTF-8 reading of highest
probability under the corpus's character frequencies, which come from the corpus's word counts; of the encodings, the
one with the most probable reading of the whole text wins, and the search repeats on its result, so that text garbled
twice is undone twice.  Where wildcards leave several readings of a word, corpus word frequencies, joined by word, choose
(restore()).  Of a run with more than READINGS of them the lattice itself is kept: its stretches between possible marks
are matched as patterns of bytes against all corpus words of their length, and a second Viterbi search over words and
marks takes the reading of highest word frequency, so none is cut.  Runs of question marks and replacement characters without a
reading are reported as lost.

Defined cases: null and empty texts are whole; a text without damage is returned as it is; repeated rows give repeated
rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, map_arrow, table
from .vocabulary import count_words

#: Encodings in which UTF-8 bytes are read by mistake.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "koi8_r")
#: Code points that a reading may hold besides those that the corpus has: none are likelier than this.
UNSEEN = -14.0
LOST = "�"
#: Marks of punctuation, which words don't hold, and their log probability; a joiner stands after a virama only.
COMMON_MARKS = "“”‘’–—…«»°²é।。，、？！：；（）"
JOINERS, AFTER, NO_JOINER = (0x200B, 0x200C, 0x200D), "्", -8.0
#: Readings of a damaged run that are listed; a run with more is matched against the corpus words by its lattice.
READINGS = 24


def _byte_of(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):  # bytes without a character there pass as control characters
        out.setdefault(chr(b), b)
    return out


def _class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


class _Codec:
    def __init__(self, name: str):
        self.name, self.byte = name, _byte_of(name)
        lead = [[c for c, b in self.byte.items() if lo <= b <= hi] for lo, hi in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4))]
        tail = [c for c, b in self.byte.items() if 0x80 <= b <= 0xBF] + [LOST]
        shown = {b for c, b in self.byte.items() if not 0x80 <= ord(c) < 0xA0}
        self.hidden = [b for b in range(128, 256) if b not in shown] or list(range(0x80, 0xC0))
        t = _class(tail)
        self.unit = re.compile(f"(?:{_class(lead[0])}{t}|{_class(lead[1])}{t}{{2}}|{_class(lead[2])}{t}{{3}}|{LOST}{t}{{1,2}}(?={_class(lead[1])}|{LOST}))+")
        self.leads, self.tails = set().union(*lead), set(tail)


_CODECS = [_Codec(c) for c in SINGLE_BYTE]
_PAIR = re.compile(_class(set().union(*(c.leads for c in _CODECS))) + "(?=" + _class(set().union(*(c.tails for c in _CODECS))) + ")")
_QUESTIONS = re.compile(r"\?{3,}|\?{2,}(?=[^?]{1,3}\?{2,})")
_TAILS = list(range(0x80, 0xC0))
_HAN = re.compile(r"[⺀-鿿가-힣-﫿Ѐ-ӿΑ-ω�]+")
_CJK = re.compile(r"[ぁ-鿿-]")
_LATIN = re.compile(r"[A-Za-z]")
#: Ranges of characters in whose scripts the corpus may be written, with a floor of log probability for
#: characters that the corpus itself doesn't show.
_PLAUSIBLE = ((0x80, 0xFF), (0x152, 0x153), (0x160, 0x161), (0x178, 0x178), (0x17D, 0x17E), (0x192, 0x192), (0x2C6, 0x2C6), (0x2DC, 0x2DC), (0x2122, 0x2122), (0x300, 0x304), (0x327, 0x327), (0x900, 0x97F), (0x200B, 0x200D), (0x2010, 0x2027), (0x2030, 0x203A), (0x2060, 0x2060), (0x20AC, 0x20AC), (0x2103, 0x2116), (0x3000, 0x3011), (0x4E00, 0x9FFF), (0xFEFF, 0xFEFF), (0xFF01, 0xFF65))


class Channel:
    """Character log probabilities of the corpus, with a floor for plausible unseen characters and nothing else."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cut = False
        self.logp = dict.fromkeys(COMMON_MARKS, -6.0)
        self.logp |= {c: max(UNSEEN, math.log(n / total)) for c, n in counts.items() if n * 200_000 > total}

    def score(self, code: int) -> float | None:
        got = self.logp.get(chr(code))
        if got is not None:
            return got
        return UNSEEN if any(a <= code <= b for a, b in _PLAUSIBLE) else None

    def decode(self, cells: list[int | None], hidden: list[int], most: int = 1) -> list[tuple[float, str]]:
        """Viterbi over the byte lattice: the best readings of all cells, best first; none where no reading exists."""
        best: list[list[tuple[float, str]]] = [[] for _ in range(len(cells) + 1)]
        best[0] = [(0.0, "")]
        self.cut = False
        for i in range(len(cells)):
            if not best[i]:
                continue
            for c in ([cells[i]] if cells[i] is not None else hidden):
                size = 1 if c < 0x80 else 2 if 0xC2 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF5 else 0
                if not size or i + size > len(cells):
                    continue
                values = [c if size == 1 else c & (0x7F >> size)]
                for k in range(i + 1, i + size):
                    tails = [cells[k]] if cells[k] is not None else [h for h in hidden if 0x80 <= h < 0xC0]
                    values = [v << 6 | t & 63 for v in values for t in tails if 0x80 <= t < 0xC0]
                for v in values:
                    if size == 3 and (v < 0x800 or 0xD800 <= v < 0xE000) or size == 4 and not 0x10000 <= v < 0x110000:
                        continue
                    s = -4.0 if size == 1 else self.score(v)
                    if s is not None:
                        lone = v in JOINERS
                        best[i + size] += [(p + s + (NO_JOINER if lone and not t.endswith(AFTER) else 0.0), t + chr(v)) for p, t in best[i]]
            for k in range(i + 1, min(i + 5, len(best))):
                if len(best[k]) > most:
                    self.cut = True
                    best[k] = sorted(best[k], key=lambda x: (-x[0], x[1]))[:most]
        return sorted(best[-1], key=lambda x: (-x[0], x[1]))[:most]

    def _lattice(self, cells: list[int | None], hidden: list[int]) -> str | None:
        """The cells of the run just decoded, if it has readings that decode() dropped; else nothing."""
        return json.dumps({"cells": cells, "hidden": hidden}) if self.cut and None in cells else None

    def gain(self, run: str, reading: float) -> float:
        """How much likelier a reading of that log probability is than the run as it stands."""
        return reading - sum(self.logp.get(c, UNSEEN) for c in run)

    def spans(self, text: str, codec: _Codec) -> list[tuple[int, int, list[str], str | None, float]]:
        """Runs with a reading: start, end, readings, lattice, gain."""
        out = []
        for m in codec.unit.finditer(text):
            run = m[0]
            if codec.name == "cp1251" and len(run) == 2 and run[1] in "ІіЅѕј" and text[m.end() : m.end() + 1].isalpha():
                continue  # look-alike letters within a Latin word
            cells = [None if c == LOST else codec.byte[c] for c in run]
            got = self.decode(cells, codec.hidden, READINGS if LOST in run else 1)
            if got:
                out.append((m.start(), m.end(), [t for _, t in got], self._lattice(cells, codec.hidden), self.gain(run, got[0][0])))
                continue
            at = m.start()
            for u in re.finditer(codec.unit.pattern[:-1], run):  # unit by unit where the whole run has no reading
                cells = [None if c == LOST else codec.byte[c] for c in u[0]]
                got = self.decode(cells, codec.hidden, READINGS if LOST in u[0] else 1)
                if got:
                    out.append((at + u.start(), at + u.end(), [t for _, t in got], self._lattice(cells, codec.hidden), self.gain(u[0], got[0][0])))
        return out

    def han_spans(self, text: str) -> list[tuple[int, int, list[str], str | None, float]]:
        """Runs of double-byte characters whose bytes are UTF-8: text read as GBK."""
        out = []
        for m in _HAN.finditer(text):
            run = m[0]
            if not _CJK.search(run):
                continue
            around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if len(run) < 2 and not _LATIN.search(around):
                continue
            raw = b"".join(b"??" if c == LOST else c.encode("gb18030", "ignore") for c in run)
            read = raw.replace(b"??", b"").decode("utf-8", "ignore")
            # two bytes of a double-byte character are often a Latin letter by chance; longer readings are not
            least = 127 if _LATIN.search(around) else 0x7FF
            fits = sum(len(c.encode()) for c in read if ord(c) > least and self.score(ord(c)) is not None)
            known = len(raw.replace(b"??", b""))
            cells = [x for c in run for x in ([None] if c == LOST else list(c.encode("gb18030", "ignore")))]
            got = self.decode(cells, _TAILS, READINGS) if LOST in run else []
            lattice = self._lattice(cells, _TAILS) if got else None
            if got or known and fits >= 0.6 * known and (fits > 2 or _LATIN.search(around)):
                got = got or self.decode(cells, _TAILS)
                readings = [t for _, t in got] or [raw.replace(b"??", b"\xff").decode("utf-8", "replace")]
                out.append((m.start(), m.end(), readings, lattice, self.gain(run, got[0][0] if got else sum(self.logp.get(c, UNSEEN) for c in readings[0]))))
        return out

    def repair(self, text: str | None) -> tuple[str | None, list[str], bool, list[str]]:
        """Text, encodings undone, whether something is lost, and readings to weigh: 'start|lattice or nothing|reading|reading...'."""
        if not text:
            return text, [], False, []
        undone: list[str] = []
        weigh: list[str] = []
        while True:  # every reading is shorter than its run, so this ends
            found: list[tuple[float, str, list]] = []
            if _PAIR.search(text):
                for c in _CODECS:
                    spans = self.spans(text, c)
                    if spans:
                        found.append((sum(x[4] for x in spans), c.name, spans))
            if _CJK.search(text):
                spans = self.han_spans(text)
                if spans:
                    found.append((sum(x[4] for x in spans), "gbk", spans))
            if not found:
                break
            _, name, spans = max(found, key=lambda x: x[0])
            undone.append(name)
            parts, at, size, weigh = [], 0, 0, []
            before = len(text)
            for a, b, readings, lattice, _ in spans:
                parts += [text[at:a], readings[0]]
                size += a - at
                if len(readings) > 1:
                    weigh.append("\x1f".join([str(size), lattice or "", *readings]))
                size += len(readings[0])
                at = b
            text = "".join([*parts, text[at:]])
            if len(text) >= before:
                break
        return text, undone, LOST in text or _QUESTIONS.search(text) is not None, weigh


def suspicious(text: str) -> bool:
    return _PAIR.search(text) is not None or LOST in text or _CJK.search(text) is not None or "??" in text


def character_counts(words: DataFrame) -> dict[str, int]:
    """How often each character stands in the corpus's words; as many rows as the corpus's scripts have characters."""
    chars = words.select(F.explode(F.split("word", "")).alias("c"), "n").filter("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    return {r["c"]: r["n"] for r in chars.collect()}


def damaged(df: DataFrame, id_col: str, text_col: str, counts: dict[str, int]) -> DataFrame:
    """Operator, first half: the rows with damage: (id, repaired, encodings, lost, readings)."""
    kind = dict(df.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        channel = Channel(counts)
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t and suspicious(t):
                fixed, undone, lost, weigh = channel.repair(t)
                if undone or lost:
                    rows.append((i, fixed, undone, lost, weigh))
        if not rows:
            return None
        cols = list(zip(*rows))
        kinds = [b.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "repaired", "encodings", "lost", "readings"])

    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, repaired string, encodings array<string>, lost boolean, readings array<string>", 5000)


def _edges(channel: Channel, cells: list[int | None], hidden: list[int]):
    """Every character that a place of the lattice may begin: (start, end, character, log probability)."""
    for i in range(len(cells)):
        for c in [cells[i]] if cells[i] is not None else hidden:
            size = 2 if 0xC2 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF5 else 1 if c < 0x80 else 0
            if not size or i + size > len(cells):
                continue
            values = [c if size == 1 else c & (0x7F >> size)]
            for k in range(i + 1, i + size):
                tails = [cells[k]] if cells[k] is not None else [h for h in hidden if 0x80 <= h < 0xC0]
                values = [v << 6 | t & 63 for v in values for t in tails if 0x80 <= t < 0xC0]
            for v in values:
                if size == 3 and (v < 0x800 or 0xD800 <= v < 0xE000) or size == 4 and not 0x10000 <= v < 0x110000:
                    continue
                s = -4.0 if size == 1 else channel.score(v)
                if s is not None:
                    yield i, i + size, chr(v), s


def _in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM" or c in "\u200c\u200d"


def _stretches(cells: list[int | None], edges: list) -> set[tuple[int, int]]:
    """Where a word of a reading may stand: from the start or a mark's end to a mark's start or the end."""
    marks = [(i, j) for i, j, c, _ in edges if not _in_word(c)]
    return {(i, j) for i in {0} | {j for _, j in marks} for j in {len(cells)} | {i for i, _ in marks} if i < j}


def _pattern(cells: list[int | None], hidden: list[int]) -> tuple[str, str]:
    """(key, pattern) of a stretch: its length with its first longest known bytes, and hexadecimal digits to match."""
    known, at = "".join(" " if c is None else "x" for c in cells), -1
    for size in (6, 3):
        at = known.find("x" * size)
        if at >= 0:
            break
    gram = "".join(f"{c:02X}" for c in cells[at : at + size]) if at >= 0 else ""
    any_of = "(?:" + "|".join(f"{h:02X}" for h in hidden) + ")"
    return f"{len(cells)}:{at}:{gram}", "^" + "".join(any_of if c is None else f"{c:02X}" for c in cells) + "$"


def best_reading(channel: Channel, lattice: str, words: dict[tuple[int, int], tuple[str, int]]) -> str | None:
    """Of all readings of the lattice, the one whose words are the most frequent, and of these the likeliest by characters.

    words: the most frequent corpus word that fits each stretch, with its count; an unknown word counts 0."""
    x = json.loads(lattice)
    edges = sorted(_edges(channel, x["cells"], x["hidden"]))
    free: dict[int, list] = {}
    for i, j, c, s in edges:
        free.setdefault(i, []).append((j, c, s))
    steps: dict[int, list] = {}
    for i, j in _stretches(x["cells"], edges):
        way: dict[int, tuple[float, str]] = {i: (0.0, "")}
        for k in range(i, j):
            if k in way:
                for e, c, s in free.get(k, ()):
                    if e <= j and _in_word(c):
                        lone = ord(c) in JOINERS and not way[k][1].endswith(AFTER)
                        new = (way[k][0] - s - (NO_JOINER if lone else 0.0), way[k][1] + c)
                        way[e] = min(way.get(e, new), new)
        if (i, j) in words:
            word, n = words[i, j]
            steps.setdefault(i, []).append((j, word, math.log(n + 0.5), 0.0, True))
        elif j in way:
            steps.setdefault(i, []).append((j, way[j][1], math.log(0.5), -way[j][0], True))
    for i, j, c, s in edges:
        if not _in_word(c):
            steps.setdefault(i, []).append((j, c, 0.0, s, False))
    done: dict[tuple[int, bool], tuple[float, float, str]] = {(0, False): (0.0, 0.0, "")}  # least first: costs, then the text
    for k in range(len(x["cells"])):
        for after in (False, True):
            if (k, after) in done:
                w, p, t = done[k, after]
                for j, part, dw, dp, word in steps.get(k, ()):
                    if not (after and word):
                        new = (w - dw, p - dp, t + part)
                        done[j, word] = min(done.get((j, word), new), new)
    ends = [done[len(x["cells"]), a] for a in (False, True) if (len(x["cells"]), a) in done]
    return min(ends)[2] if ends else None


def _by_lattice(options: DataFrame, words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(row, at, reading) of the runs that have more readings than are listed."""

    def stretches(b: pa.RecordBatch) -> pa.RecordBatch | None:
        channel, rows = Channel(counts), []
        for row, at, text in zip(*(c.to_pylist() for c in b.columns)):
            x = json.loads(text)
            for i, j in _stretches(x["cells"], list(_edges(channel, x["cells"], x["hidden"]))):
                rows.append((row, at, i, j, *_pattern(x["cells"][i:j], x["hidden"])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "at", "i", "j", "key", "pattern"]) if rows else None

    def choose(b: pa.RecordBatch) -> pa.RecordBatch:
        channel, out = Channel(counts), []
        for text, fits in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            out.append(best_reading(channel, text, {(f["i"], f["j"]): (f["word"], f["n"]) for f in fits or ()}))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["row", "at", "reading"])

    wide = options.filter("k = 0 AND lattice <> ''").select("row", "at", "lattice")
    parts = cut(map_arrow(wide, stretches, "row long, at int, i int, j int, key string, pattern string"))
    grams = F.expr("flatten(transform(array(6, 3), s -> transform(filter(sequence(0, size), o -> o + s <= size), o -> concat(size, ':', o, ':', substring(hex, 2 * o + 1, 2 * s)))))")
    keyed = words.withColumn("hex", F.expr("hex(encode(word, 'UTF-8'))")).withColumn("size", F.expr("cast(length(hex) / 2 as int)")).withColumn("key", F.explode(F.concat(grams, F.array(F.expr("concat(size, ':-1:')")))))
    side = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS // 20 else parts
    fits = keyed.join(side, "key").filter(F.expr("hex rlike pattern")).groupBy("row", "at", "i", "j").agg(F.max(F.struct("n", "word")).alias("w"))
    fits = fits.groupBy("row", "at").agg(F.collect_list(F.struct("i", "j", F.col("w.word").alias("word"), F.col("w.n").alias("n"))).alias("fits"))
    return map_arrow(wide.join(fits, ["row", "at"], "left").select("row", "at", "lattice", "fits"), choose, "row long, at int, reading string").filter("reading IS NOT NULL")


def restore(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Operator, whole: damaged rows with the text restored; corpus word frequencies choose between readings of wildcards."""
    words = cut(count_words(df, text_col, where=r"[^\x00-\x7f]"))
    counts = character_counts(words)
    bad = cut(cut(damaged(df, id_col, text_col, counts)).withColumn("row", F.monotonically_increasing_id()))
    options = (
        bad.select("row", F.explode("readings").alias("r"))
        .select("row", F.split("r", "\x1f").alias("p"))
        .select("row", F.col("p")[0].cast("int").alias("at"), F.col("p")[1].alias("lattice"), F.posexplode(F.expr("slice(p, 3, size(p) - 2)")).alias("k", "reading"))
    )
    firsts = options.filter("k = 0 AND lattice <> ''").select("row", "at", F.col("reading").alias("first"))
    wide = firsts.join(_by_lattice(options, words, counts), ["row", "at"]).select("row", "at", "reading", "first")
    best = (
        options.filter("lattice = ''")
        .withColumn("word", F.explode(F.expr(r"regexp_extract_all(reading, '[\\p{L}\\p{M}\\x{200c}\\x{200d}]+', 0)")))
        .join(words, "word", "left")
        .groupBy("row", "at", "k")
        .agg(F.first("reading").alias("reading"), F.sum(F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("score"))
        .groupBy("row", "at")
        .agg(F.max_by("reading", F.struct("score", -F.col("k"))).alias("reading"), F.min_by("reading", "k").alias("first"))
        .unionByName(wide)
        .filter("reading <> first")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "first", "reading"))).alias("changes"))
    )
    change = F.expr("aggregate(reverse(changes), repaired, (t, c) -> concat(substring(t, 1, c.at), c.reading, substring(t, c.at + length(c.first) + 1)))")
    return bad.join(best, "row", "left").select(F.col("id").alias(id_col), F.when(F.col("changes").isNull(), F.col("repaired")).otherwise(change).alias("restored"), "encodings", "lost")


def p5_found(spark, sf_dir):
    blocks = table(spark, sf_dir, "corpus_blocks")
    counts = character_counts(count_words(blocks, where=r"[^\x00-\x7f]"))
    return damaged(blocks, "block_id", "text", counts).select(F.col("id").alias("block_id")).distinct()


def p5_restored(spark, sf_dir):
    return restore(table(spark, sf_dir, "corpus_blocks"), "block_id", "text")
