"""Problem 4: sentence units of every text, whatever its languages, scripts and layout.

Method: semi-Markov dynamic programming.  Places where a unit may end (after marks with their closing quotes, at line
breaks) are the states; a unit is a whole span between two of them.  Its score joins how it closes (mark, abbreviation,
number, line that is a heading, label or list item, whether a break was forced by the line width), how the next one
opens (letter case, words that go on with a sentence, list marks), its length, and whether its quotations are balanced;
a bare quotation waits for its reporting clause.  The best sequence of spans wins, so one early decision can't spoil
what follows.  No span is too long or holds too many places.  One narrow pass over the rows; each text is handled whole.

Defined cases: null, empty and blank texts have no units; units carry no white space at their ends and cover every other
character; repeated rows give repeated units; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table
from .lookalikes import INVISIBLE, TO_LATIN

#: Abbreviations that never end a sentence, and those that may.
NEVER_END = set(
    "mr mrs ms dr prof st messrs rs re no nos vs viz cf approx incl vol vols fig figs sec art arts cl para paras p pp pvt i.e e.g ed eds ch st mt hon gen col capt sr jr esp resp ref "
    "m mm mme mlle c.-à-d ru bi bi.sam sam nam na na.pa wa.no "
    "न न.पा नं डा प्रा क क.सं वि वि.सं रु ता सं गा.पा उ जि मो इ इ.सं श्री पं क्र क्र.सं डॉ प्रो पृ ब.नं चै च.नं मि कि.मि पूर्व.नं".split()
)
MAY_END = set("etc a.m p.m ltd लि प्रा.लि h co inc jan feb aug sept oct nov dec al लि.नं".split())
#: Words that go on with a sentence after a quotation or a break.
GOES_ON = re.compile(r"(?:भनी|भन्ने|भन्दै|भनेर|भनेका|भन्यो|र|तथा|वा|अनि|कि|और|या|एवं|तक|bhani|bhanne|bhandai|ra|tatha)(?![\wऀ-ॿ])")
#: End marks of further scripts (Arabic, Urdu, Ethiopic, Burmese, Khmer, Armenian, Tibetan, Syriac, Ol Chiki, Thai).
FURTHER_ENDS = "؟۔።፧။។៕։༎།܀᱾๚๛"
_ENDS_AND_BREAKS = (
    r"(?:[.!?…।॥。！？｡‼⁇⁈⁉" + FURTHER_ENDS + r"]|(?<=[ऀ-ॿ])[|｜]|(?<=[ऀ-ॿ] )[|｜])+(?:[\"”’»」』)\]）]|[    ]»)*|[\n\r\v\f\u0085  ]"
)
_CANDIDATE = re.compile(_ENDS_AND_BREAKS)
#: Thai and Lao have no end marks; a space parts sentences and clauses alike.
_SPACED = re.compile("[\u0e01-\u0eff]")
_CANDIDATE_SPACED = re.compile(_ENDS_AND_BREAKS + "|(?<=[\u0e01-\u0eff])[ \u00a0]+(?=[\u0e01-\u0eff])")
#: Thai and Lao words that close a sentence, and words that open one.
SPACED_CLOSE = re.compile("(?:ครับ|ค่ะ|คะ|นะ|แล้ว|ด้วย|เท่านั้น|เช่นกัน|ทั้งหมด|ทุกวัน|ແລ້ວ|ເດີ|ທຸກມື້)$")
SPACED_OPEN = re.compile("(?:ผม|ฉัน|ดิฉัน|เรา|เขา|เธอ|มัน|พวก|คุณ|นี่|นั่น|วันนี้|เมื่อวาน|พรุ่งนี้|ต่อมา|จากนั้น|นอกจากนี้|อย่างไรก็ตาม|ดังนั้น|ทั้งนี้|รัฐบาล|ຂ້ອຍ|ພວກ|ລາວ|ມື້ນີ້)")
_SPACE = re.compile(r"\s*")
_LAST = re.compile(r"[^\s(\[“\"«„「『‘’/–—]*$")
_LIST = re.compile(r"(?:[-–—](?=\s+[^a-zà-ÿ])|[•*·▪●○‣◦■□▸►✓]|\(?(?:[0-9०-९]{1,3}|[a-z]|[ivx]{1,4}|[क-ह])[.)）]|\((?:[A-Z]|[IVX]{1,4})[)）]|[①-⑳])[ \t   ]+\S")
_LABEL = re.compile(r"[^\W\d_][^:：\n.।?!“”\"«»]{1,38}?[    ]?[:：]\s*[^\s“\"«]")
_LABEL_NO = re.compile(r".{3,45}?(?:\b[Nn][Oo]\b\.?|\b[Nn]umber|नं\.?|संख्या|क्र\.?|nam\.?)\s*[0-9०-९A-Z][-0-9०-९A-Za-z ./]*$")
_HEAD = re.compile(
    r"\W{0,3}(?:(?:CHAPTER|Chapter|ANNEX|Annex|ANNEXE|Annexe|APPENDIX|Appendix|SCHEDULE|Schedule|NOTICE|Notice|PART|Part|Chapitre|CHAPITRE|Avis|AVIS)\s+(?:(?:NO|No|no|N)[.°]?\s*)?[\dIVXLC]+"
    r"|(?:अनुसूची|परिच्छेद|सूचना|अनुबंध|अध्याय|भाग|खण्ड)[\s–—-]*(?:नं\.?|सं\.?|क्र\.?)?\s*[0-9०-९]|(?:附件|第[0-9一二三四五六七八九十]+[章节])|[0-9०-९]+(?:\.[0-9०-९]+)+\s+(?![a-zà-ÿ]|लाख|करोड|प्रतिशत|रुप|बजे|PER\b|MILLION\b)[^\W\d_])"
)
_CAPS = re.compile(r"[A-Z]{2}[^a-z]{60}")
_DIGITS = re.compile(r"[0-9०-९]+(?:[.,][0-9०-९]+)*$")
_WORDS = re.compile(r"[^\W\d_]+")
_OPENERS, _CLOSERS = "“«„「『", "”»」』"
_MARKS = re.compile("[\"“”«»„「」『』]")
_OPEN_MARK = re.compile(r"[\"“«„「『‘'(\[（]*")
BARE_QUOTE = re.compile(r"[\"“«„「『]")
#: Scores: unbalanced quotation, bare quotation, units that are too short; price of each character beyond LONG and up to FAR.
UNBALANCED, BARE, TINY = -7.0, -5.0, -1.5
EACH, LONG, FAR = 0.002, 400, 3400


def _line_kind(line: str, capitals: bool = True) -> float:
    """How surely a line without an end mark is a unit of its own; `capitals`: whether a line of capitals says so."""
    if not line:
        return 0.0
    if _LIST.match(line):
        return 5.0
    if _HEAD.match(line) and len(line) < 140:
        return 5.0
    if _LABEL.match(line) and len(line) < 120:
        return 4.5
    if len(line) < 70 and not line[:1].islower() and line[-1] != "." and _LABEL_NO.match(line):
        return 4.5
    letters = [c for c in line if c.isalpha()]
    if capitals and len(letters) > 5 and all(c.isupper() for c in letters):
        return 4.0
    words = _WORDS.findall(line)
    if len(words) > 1 and len(line) < 90 and words[0][0].isupper():
        capital = sum(w[0].isupper() for w in words if len(w) > 3)
        if capital and capital == sum(len(w) > 3 for w in words):
            return 0.5
    return 0.0


_BARE_WORD = {ord(c): None for c in INVISIBLE} | {ord(a): b for a, b in TO_LATIN.items()}


def _bare(word: str) -> str:
    """A word as abbreviations are listed: lower case, without invisible characters and look-alikes."""
    return (word if word.isascii() else word.translate(_BARE_WORD)).lower()


def _opening(text: str, at: int, small: float) -> float:
    """How well a unit opens there; `small` is the price of a small letter."""
    if at >= len(text):
        return 0.0
    k = _OPEN_MARK.match(text, at).end()
    c = text[k : k + 1]
    if not c:
        return -3.0
    if c.islower():
        return small
    if c in ",;:，；：、)]%‰”’»」』）।":
        return -7.0
    if GOES_ON.match(text, at):
        return -5.0
    return 1.0 if c.isupper() or k > at else 0.5


def _full_stop(text: str, start: int, end: int, after: int) -> float | None:
    """How surely a full stop ends a unit; nothing where it can't."""
    nxt = text[end : end + 1]
    word = _LAST.search(text, max(0, start - 24), start)[0]
    if nxt and not nxt.isspace():
        if nxt.isdigit() or nxt in ".,;:@/-–_)]％%" or not word or nxt == "\\":
            return None
        low = _bare(word)
        if low in NEVER_END or low in MAY_END or "." in word or "@" in word or len(word) < 2 and not word.isdigit():
            return None
        if nxt.isalpha() and nxt.isascii():
            return 1.0 if nxt.isupper() and (word[-1].islower() or word[-1].isdigit()) and text[end + 1 : end + 2].islower() | text[end + 1 : end + 2].isspace() else None
        if "ऀ" <= nxt <= "ॿ":
            return 1.0 if len(word) > 2 or word in ("छ", "हो", "थे", "है", "छन्") else None
        return 1.0
    low = _bare(word).strip("()[]“”\"«»’'")
    if low.startswith(("l'", "d'", "l’", "d’")):
        low = low[2:]
    if low in NEVER_END or low.rpartition(".")[2] in NEVER_END and "." in low:
        return -8.0
    if low in MAY_END:
        return 1.5 if text[after : after + 1].isupper() or text[after : after + 1] in "“\"«" else -6.0
    if len(word) == 1 and word.isalpha() and word.isascii():
        return -6.0
    if _DIGITS.fullmatch(word) and not text[max(0, text.rfind("\n", 0, start)) : start - len(word)].strip():
        return -8.0 if text[end : end + 1] not in ("", "\n") else 2.0
    return 2.5


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of each unit, in code points."""
    n = len(text)
    first = _SPACE.match(text).end()
    if first == n:
        return []
    last = len(text.rstrip())
    lines = [len(x.strip()) for x in text.split("\n")]
    width = max(lines)
    wrapped = width <= 120 and len(lines) > 2
    ends: list[int] = []
    starts: list[int] = []
    close: list[float] = []
    hard: list[bool] = []
    kinds: dict[int, float] = {}
    capitals = sum(map(str.isupper, text)) < 0.4 * sum(map(str.isalpha, text)) if text.isupper() or _CAPS.search(text) else True

    def kind_at(a: int) -> float:
        """Kind of the line that begins at or before a's line start."""
        if a not in kinds:
            b = text.find("\n", a)
            kinds[a] = _line_kind(text[a : b if b >= 0 else n].strip(), capitals)
        return kinds[a]

    line_start, marked = first, False
    for m in (_CANDIDATE_SPACED if _SPACED.search(text) else _CANDIDATE).finditer(text, first, last):
        s, e = m.start(), m.end()
        after = _SPACE.match(text, e).end()
        mark = m[0]
        breaks = "\n" in text[e:after] or mark in "\n\r\v\f\u0085  "
        if mark[0] in "\n\r\v\f\u0085  ":
            end = len(text[:s].rstrip()) if text[s - 1 : s].isspace() else s
            if ends and ends[-1] == end:
                line_start, marked = after, False
                continue  # the mark before this break is the candidate
            line = text[line_start:end]
            gap = text[end:after]
            own, nxt = _line_kind(line.strip(), capitals), kind_at(after)
            if marked or starts and starts[-1] == line_start and close[-1] <= 0 and text[line_start].isdigit():
                own = 0.0  # the line holds an end already, or goes on with the line before
            if own < 2.5 and text[after : after + 1].isdigit():
                nxt = 0.0  # a number may go on with a sentence
            word = text[after : after + 30].split(maxsplit=1)[:1]
            fits = end - line_start + 1 + len(word[0] if word else "") <= width - (2 if wrapped else 0)
            score = -2.4 + own + (4.0 if nxt >= 4 else 0.0)
            score += (1.0 if own or not wrapped else 0.5) if fits else (-3.0 if not own else -1.0)
            if gap.count("\n") > 1:
                score += 3.5
            if text[max(0, end - 1) : end] in ",、，" or text[max(0, end - 2) : end - 1] == "," or nxt < 4 and text[after : after + 1] in "–—-":
                score -= 5.0
            line_start, marked = after, False
        elif mark[0] in "  ":
            end, after = s, e
            score = -3.0 + 2.5 * (SPACED_CLOSE.search(text, max(0, s - 12), s) is not None) + 2.5 * (SPACED_OPEN.match(text, e) is not None)
        else:
            end = e
            if mark[0] == "." and set(mark) <= set(".\"”’»」』)]    "):
                if mark.startswith("..") :
                    score = 1.0
                else:
                    got = _full_stop(text, s, s + 1 if len(mark) == 1 else e, after)
                    if got is None:
                        continue
                    score = got
            elif mark[0] == "…":
                score = 1.0
            elif mark[0] in "!?" and text[e : e + 1] and text[e : e + 1].isalpha() and text[e : e + 1].islower():
                continue
            else:
                score = 3.0
            if breaks:
                score += 1.0 if score > 0 else 0.0
                if text[e:after].count("\n") > 1:
                    score += 2.0
                if kind_at(after) >= 4 or score < 0 and _line_kind(text[line_start:e].strip(), capitals) >= 4:
                    score += 3.0
                line_start, marked = after, False
            elif score > 0:
                marked = True
            if not breaks and _line_kind_inside(text, line_start, e):
                score -= 6.0
        plain = mark[0] in ".!?।" and len(mark) == 1 or mark[0] in "\n\r" and own >= 4.5
        score += _opening(text, after, -1.5 if plain else -7.0) if not (breaks and kind_at(after) >= 4) else 1.0
        ends.append(end)
        starts.append(after)
        close.append(score)
        hard.append(breaks)
    if not ends or ends[-1] < last:
        ends.append(last)
        starts.append(n)
        close.append(0.0)
        hard.append(True)
    return _best(text, first, last, ends, starts, close, hard)


def _line_kind_inside(text: str, a: int, e: int) -> bool:
    """Whether a mark stands within a list item or numbered heading, just after its number."""
    return e - a < 6 and _LIST.match(text, a) is not None


def _best(text: str, first: int, last: int, ends: list[int], starts: list[int], close: list[float], hard: list[bool]) -> list[tuple[int, int]]:
    """Viterbi over whole spans."""
    begin = [first, *starts[:-1]]
    n = len(ends)
    quotes = _MARKS.search(text) is not None
    level, straight = [0] * (n + 1), [0] * (n + 1)
    if quotes:
        at, lv, st = first, 0, 0
        for k in range(n):
            for c in _MARKS.findall(text, at, ends[k]):
                if c == '"':
                    st ^= 1
                elif c in _OPENERS:
                    lv += 1
                else:
                    lv -= 1
            at = ends[k]
            level[k + 1], straight[k + 1] = lv, st
    best, back = [0.0] + [-1e18] * n, [0] * (n + 1)
    # No span is ruled out.  Spans beyond FAR cost the same whatever their length, so the best start of each state of the
    # quotations stands for all; nearer ones are tried backwards until no earlier start can win, as all else only costs.
    peak, far, top = [0.0] * (n + 1), {}, None
    p = 0
    for j in range(1, n + 1):
        c, e = (close[j - 1] if j < n else 0.0), ends[j - 1]
        while p < j and e - begin[p] > FAR:
            state = (level[p], straight[p])
            if state not in far or best[p] > far[state][0]:
                far[state] = (best[p], p)
            if top is None or best[p] > top[0]:
                top = (best[p], p)
            p += 1
        own = -1e18
        for extra, candidate in ((0.0, far.get((level[j], straight[j]))), (UNBALANCED, top)):
            if candidate and candidate[0] + c - EACH * (FAR - LONG) + extra > own:
                own, back[j] = candidate[0] + c - EACH * (FAR - LONG) + extra, candidate[1]
        for i in range(j - 1, p - 1, -1):
            a = begin[i]
            size = e - a
            cost = EACH * (size - LONG) if size > LONG else 0.0
            if peak[i] + c - cost <= own:
                break
            s = best[i] + c + (TINY if size < 8 else 0.0) - cost
            if quotes:
                if level[i] != level[j] or straight[i] != straight[j]:
                    s += UNBALANCED
                elif j < n and text[a] in '"“«„「『' and text[e - 1] in '"”»」』' and not _MARKS.search(text, a + 1, e - 1) and not hard[j - 1] and BARE_QUOTE.match(text, starts[j - 1]) is None:
                    s += BARE
            if s > own:
                own, back[j] = s, i
        best[j] = own
        peak[j] = max(peak[j - 1], own)
    out, j = [], n
    while j:
        i = back[j]
        out.append((begin[i], ends[j - 1]))
        j = i
    return [(a, b) for a, b in reversed(out) if b > a]


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator: (id, start_char, end_char) of every unit."""
    kind = dict(df.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [units(t) if t else [] for t in b.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], [id_col, "start_char", "end_char"])

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, start_char int, end_char int", 1000)


def p4_found(spark, sf_dir):
    return sentence_units(table(spark, sf_dir, "documents"))
