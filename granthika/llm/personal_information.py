"""Problem 9: places with personal information, and texts with typed placeholders in their stead.

Finding: shapes with validation (e-mail, phone, identity number by its label, address from house number or street to the
last place name) and names from the list of name parts.  The list is incomplete, so it is widened by analogy: beginnings
and endings that each build several listed parts also build unlisted ones.  One automaton finds all parts; a name is a
run of given parts or initials closed by a family part, without title or attached case ending.

Method of replacement: format-preserving Feistel pseudonyms.  The digits of a validated number, apart from the prefix that
makes it valid, are permuted by a keyed balanced Feistel network over their decimal length, and dates within the calendar
by cycle walking; script and separators stay, so equal values keep equal pseudonyms across documents.  Names, mail and
street addresses get a keyed tag in their typed placeholder.

Defined cases: null and empty texts hold nothing and stay as they are; offsets count code points of the text as it is,
also where invisible characters or look-alikes stand within; repeated rows give repeated places; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, table
from .lookalikes import _FOLD, TO_LATIN

#: Case endings that may be attached to a name.
ENDINGS = {
    "devanagari": "ले लाई को का की मा बाट सँग संग द्वारा देखि सम्म हरू ने से में पर".split(),
    "latin": "le lai ko ka ki ma bata sanga dwara dekhi".split(),
}
#: Words after a name that make it the name of a place, an office or a firm.
NOT_PERSON = re.compile(r"\s*(?:&|Trust|Clinic|Foundation|Memorial|Hospital|School|Office|Works|Pvt|Ltd|Bank|Marg|Lane|Street|Tole|Chowk|Nagar|Company|Traders|Suppliers|Brothers|and Sons|स्मृति|प्रतिष्ठान|अस्पताल|कोष|ट्रस्ट|क्लिनिक|मार्ग|टोल|चोक|विद्यालय|प्रा\.)")
_TITLE = re.compile(r"(?:Mr|Ms|Mrs|Dr|Shri|shri|Sri|श्री|श्रीमती|सुश्री|डा|डॉ|Prof|Messrs|M|Mme)\.?\s+$")
_INITIAL_AFTER = re.compile(r"\s+([A-Z])\.(?=\s)")
_INITIAL_BEFORE = re.compile(r"(?<![\w.])([A-Z])\.\s+$")
_GAP = re.compile(r"\s+")
_UNKNOWN_AFTER = re.compile(r"\s+([A-Z][a-z]{2,}|[A-Z]{3,})(?![\w])")
_UNKNOWN_BEFORE = re.compile(r"(?<![\wऀ-ॿ.])([A-Z][a-z]{2,}|[A-Z]{3,}|(?<=श्री )[ऀ-ॣॱ-ॿ]{2,}|(?<=डा\. )[ऀ-ॣॱ-ॿ]{2,})\s+$")
#: Capitalised words that are no given name before a family name.
_NO_NAME = set("The And For With From Mrs Messrs Shri Nibedak Upper Lower Old New Ward Dear Late Sir Madam THE AND FOR".split())
_LETTER = re.compile(r"[^\W\d_]|[ऀ-ःऺ-ॏ]")
_D = "0-9०-९"
_EMAIL = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s?\{at\}\s?|\s+at\s+(?=[a-z0-9-]+\s+dot\s))[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s?\{dot\}\s?|\s+dot\s+)[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+(?![\w@])"
)
_PHONE = re.compile(
    rf"(?<![\w/.+-])(?<![{_D}] )(?:"
    rf"(?:(?:\+|00|\(\+)?[9९][7७][7७]\)?[-\s.]?)?(?:[9९][{_D}]{{2}}(?:[-\s.]?[{_D}]{{3}}[-\s.]?[{_D}]{{4}}|[-\s.][{_D}]{{7}}))"
    rf"|(?:\+|00)[9९][7७][7७][-\s.]?\(?[0०]?[{_D}]{{1,2}}\)?[-\s.]?[{_D}]{{3}}[-\s.]?[{_D}]{{3,4}}"
    rf"|(?:\([0०][{_D}]{{1,2}}\)[-\s]?|[0०][{_D}]{{1,2}}[-\s])[{_D}]{{3}}[-\s.]?[{_D}]{{3,4}}"
    rf")(?![{_D}]|[-/.][{_D}])"
)
_FULL = re.compile(r"(?:\+|00)[9९][7७][7७]")
_NOT_PHONE = re.compile(r"(?:circular|Circular|Letter no\.|letter no\.|grid code|plot|Tender|tender|Budget Head|परिपत्र|चलानी नं\.|कित्ता नं\.|शीर्षक|पत्र संख्या|बोलपत्र नं\.|Chalani nam\.|code|No\.|Rs\.?|NPR|रु\.?)\s*$")
#: Labels of identity numbers.
_ID = re.compile(
    rf"(?:[Pp]assport|PASSPORT|[Cc]itizenship|[Ii]dentity (?:[Cc]ard|[Nn]o|[Nn]umber|[Dd]ocument)|[Nn]ational ID|\bPAN\b|\bID\b|[Ll]icen[cs]e|[Tt]axpayer|राहदानी|पासपोर्ट|नागरिकता|परिचयपत्र|परिचय पत्र|पहचान पत्र|आधार|प्यान|स्थायी लेखा|लाइसेन्स|[Nn]agarikta|[Rr]ahadani|[Pp]arichaya ?patra|護照|护照|身份证)"
    rf"(?:[^\n.。।{_D}]{{0,24}}?(?:no\.|No\.|nos?\.|number|नं\.|नं|संख्या|क्र\.|nam\.|号码|号|:)?)[\s:#]{{0,3}}(?P<v>(?:[A-Z]{{1,3}}[-\s]?)?[{_D}]{{2,}}(?:[-/][{_D}]+)*)(?![\w])"
)
_STREET = "Lane|Street|Marg|Tole|Road|Path|Chowk|Gali|Galli|Avenue|LANE|STREET|MARG|TOLE|marg|tole|galli|chowk"
_STREET_NE = "टोल|मार्ग|गल्ली|गली|सडक|सड़क|चोक|चौक|पथ|लेन|स्ट्रिट"
_ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:House|HOUSE|house|Ghar|ghar)\s+(?:[Nn][Oo]|nam|nambar)\.?\s*\d+(?:/\d+)?,?\s+|\d+(?:/\d+)?,?\s+)?[A-Z][A-Za-z]+(?:\s[A-Z][a-z]+)?\s+(?:{_STREET})\b(?:[\s-]+\d+(?:/\d+)?)?"
    rf"(?P<rest>(?:,\s*(?:[Ww]ard|WARD|wada)\s*(?:[Nn]o\.|nam\.|nambar)?\s*\d+)?(?:,\s*[A-Z][A-Za-z]+(?:\s?[-–]\s?\d{{1,2}}(?!\d)|\s+\d{{5}}(?!\d))?)?)"
    rf"|(?<![ऀ-ॿ{_D}/-])(?:घर\s*(?:नं|नम्बर|संख्या|क्र)\.?\s*[{_D}]+(?:/[{_D}]+)?,?\s+|[{_D}]+(?:/[{_D}]+)?,?\s+)?[ऀ-ॣॱ-ॿ]+\s+(?:{_STREET_NE})(?![ऀ-ॣॱ-ॿ])(?:\s+[{_D}]+(?:/[{_D}]+)?)?"
    rf"(?P<rest2>(?:,\s*(?:वडा|वार्ड)\s*(?:नं\.|नम्बर|नं|संख्या|क्र\.)?\s*[{_D}]+)?(?:,\s*[ऀ-ॣॱ-ॿ]+(?:\s?[-–]\s?[{_D}]{{1,2}}(?![{_D}])|\s+[{_D}]{{5}}(?![{_D}]))?)?)"
)
_DIGIT = re.compile(rf"[{_D}]")
_BIRTH = re.compile(r"(?:[Bb]orn(?: on)?|[Dd]ate of birth:?|जन्म मिति:?|जन्मतिथि:?)\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")
_HAS_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted({*_FOLD, *map(ord, TO_LATIN)}) if c > 127) + "]")
_SAME = {c: v for c, v in _FOLD.items() if v is not None and len(v) == 1} | {ord(a): b for a, b in TO_LATIN.items()}
_CHANGED = {chr(c): v or "" for c, v in _FOLD.items() if v is None or len(v) != 1}
_OTHER_LENGTH = re.compile("[" + "".join(re.escape(c) for c in sorted(_CHANGED)) + "]")
_STREET_WORD = re.compile(rf"(?<=\s)(?:{_STREET})\b|(?<=\s)(?:{_STREET_NE})(?![ऀ-ॣॱ-ॿ])")
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s+(?=\S+\s+dot\s)")


#: Most characters of a mail address before and after its mark (with room for spelling it out), and of an address.
LOCAL, DOMAIN, LINE = 80, 320, 200
#: Digits of a labelled identity number, at least.
LEAST_ID = 5


def widen(parts: list[str], least: int = 3) -> set[str]:
    """Listed parts and all that analogy builds: a beginning of two listed parts or more with an ending of `least` or more."""
    heads: dict[str, set[str]] = defaultdict(set)
    tails: dict[str, set[str]] = defaultdict(set)
    for p in parts:
        for k in range(2, len(p) - 1):
            heads[p[:k]].add(p[k:])
            tails[p[k:]].add(p[:k])
    good = {t for t, h in tails.items() if len(h) >= least and len(t) >= 2}
    out = set(parts)
    for h, ts in heads.items():
        own = ts & good
        if len(own) >= 2:
            out |= {h + t for t in good}
    return out


class Finder:
    """All places of one text; built once per worker from the name list."""

    def __init__(self, names: list[tuple[str, str, str]]):
        self.words: dict[str, tuple[str, str]] = {}
        for kind in ("family", "given"):
            for script in ("latin", "devanagari"):
                for w in widen([n for n, k, s in names if k == kind and s == script]):
                    self.words.setdefault(w, (kind, script))
                    if script == "latin":
                        self.words.setdefault(w.upper(), (kind, script))
        self.auto = ahocorasick.Automaton()
        for w, v in self.words.items():
            self.auto.add_word(w, (len(w), *v))
        if self.words:
            self.auto.make_automaton()

    def _parts(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, kind, end with case ending) of each name part that is a whole word, longest first at a place."""
        best: dict[int, tuple[int, str, int]] = {}
        for last, (size, kind, script) in self.auto.iter(text):
            a, b = last - size + 1, last + 1
            if a and (_LETTER.match(text, a - 1) or text[a - 1] in "@._-" or text[a - 1].isdigit()):
                continue
            end = b
            nxt = text[b : b + 1]
            if nxt and (_LETTER.match(nxt) or nxt in "@_"):
                m = re.match(r"[ऀ-ॣॱ-ॿ]+|[a-z]+", text[b : b + 12])
                if not m or m[0] not in ENDINGS[script]:
                    continue
                end = b + m.end()
            elif nxt in (".", "-", "+") and text[b + 1 : b + 2].isalnum() and script == "latin":
                continue
            if a not in best or best[a][0] < b:
                best[a] = (b, kind, end)
        return [(a, b, kind, end) for a, (b, kind, end) in sorted(best.items())]

    def names(self, text: str) -> list[tuple[int, int]]:
        parts = self._parts(text) if self.words else []
        out: list[tuple[int, int]] = []
        i = 0
        while i < len(parts):
            start, end, kind, tail = parts[i]
            if out and start < out[-1][1]:
                i += 1
                continue
            kinds = [kind]
            j = i
            while tail == end:
                at = end
                m = _INITIAL_AFTER.match(text, at)
                if m and kinds[-1] != "family":
                    at = m.end()
                g = _GAP.match(text, at)
                k = j + 1
                if g and k < len(parts) and kinds[-1] != "family":
                    if parts[k][0] == g.end():
                        j, end, tail = k, parts[k][1], parts[k][3]
                        kinds.append(parts[k][2])
                        continue
                    u = _UNKNOWN_AFTER.match(text, at)
                    if u and k < len(parts) and parts[k][2] == "family" and (g2 := _GAP.match(text, u.end())) and parts[k][0] == g2.end():
                        j, end, tail = k, parts[k][1], parts[k][3]
                        kinds += ["given", "family"]
                        continue
                break
            before = text[max(0, start - 14) : start]
            initial = _INITIAL_BEFORE.search(before)
            if initial and kinds[0] == "family":
                start -= len(before) - initial.start()
                kinds.insert(0, "given")
                before = text[max(0, start - 14) : start]
            title = _TITLE.search(before) is not None
            if kinds[0] == "family" and len(kinds) == 1 and (u := _UNKNOWN_BEFORE.search(text[max(0, start - 40) : start])) and u[1] not in _NO_NAME:
                start -= min(40, start) - u.start(1)
                kinds.insert(0, "given")
                title = title or _TITLE.search(text[max(0, start - 14) : start]) is not None
            if len(kinds) == 1 and title and kinds[0] == "given" and tail == end and (u := _UNKNOWN_AFTER.match(text, end)):
                end = tail = u.end()
                kinds.append("family")
            whole = "family" in kinds and len(kinds) > 1 or title
            if whole and not (tail == end and NOT_PERSON.match(text, end)):
                out.append((start, end))
            i = j + 1
        return out

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in code points of the text, ordered, without overlaps."""
        if not _HAS_ODD.search(text):
            return self._find(text)
        plain = text.translate(_SAME)
        if not _OTHER_LENGTH.search(plain):
            return self._find(plain)
        size = np.ones(len(plain), np.int64)
        for m in _OTHER_LENGTH.finditer(plain):
            size[m.start()] = len(_CHANGED[m[0]])
        at = np.repeat(np.arange(len(plain)), size)
        short = _OTHER_LENGTH.sub(lambda m: _CHANGED[m[0]], plain)
        return [(int(at[a]), int(at[b - 1]) + 1, kind) for a, b, kind in self._find(short)]

    def _find(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        for h in _AT.finditer(text):
            low = max(0, h.start() - LOCAL)
            for m in _EMAIL.finditer(text, low, h.end() + DOMAIN):
                if m.start() < h.end() <= m.end() and (m.start() > low or low == 0):
                    found.append((m.start(), m.end(), "email"))
        digits = _DIGIT.search(text) is not None
        if digits:
            for h in _STREET_WORD.finditer(text):
                low = max(0, h.start() - LINE)
                for m in _ADDRESS.finditer(text, low, h.end() + LINE):
                    if m.start() < h.start() < m.end():
                        if m["rest"] or m["rest2"] or m[0].startswith("घर"):
                            found.append((m.start(), m.end(), "address"))
                        break
            found += [(*m.span("v"), "id_number") for m in _ID.finditer(text) if sum(c.isdigit() for c in m["v"]) >= LEAST_ID]
            for m in _PHONE.finditer(text):
                if _FULL.match(m[0]) or not _NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                    found.append((m.start(), m.end(), "phone"))
        found += [(a, b, "name") for a, b in self.names(text)]
        found.sort(key=lambda x: (x[0], -x[1]))
        out: list[tuple[int, int, str]] = []
        for f in found:
            if not out or f[0] >= out[-1][1]:
                out.append(f)
        return out


def permute(digits: str, key: bytes, tweak: str, rounds: int = 8) -> str:
    """Keyed bijection on decimal strings of one length: an alternating Feistel network; one digit is rotated."""
    n = len(digits)
    if n < 2:
        return "".join(str((int(d) + hmac.digest(key, tweak.encode(), "sha256")[0]) % 10) for d in digits)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for r in range(rounds):
        m = u if r % 2 == 0 else n - u
        f = int.from_bytes(hmac.digest(key, f"{tweak}|{n}|{r}|{b}".encode(), "sha256")[:16], "big")
        a, b = b, (a + f) % 10**m
    return f"{a:0{u}d}{b:0{n - u}d}" if rounds % 2 == 0 else f"{b:0{n - u}d}{a:0{u}d}"


def permute_date(day: datetime.date, key: bytes, first: int = 1900, last: int = 2100) -> datetime.date:
    """Keyed bijection on the days of [first, last): Feistel on day numbers, walked until it falls within."""
    low = datetime.date(first, 1, 1).toordinal()
    span = datetime.date(last, 1, 1).toordinal() - low
    x = day.toordinal() - low
    if not 0 <= x < span:
        return day
    width = len(str(span - 1))
    while True:
        x = int(permute(f"{x:0{width}d}", key, "date"))
        if x < span:
            return datetime.date.fromordinal(low + x)


def permute_shape(year: int, month: int, day: int, key: bytes) -> tuple[int, int, int]:
    """Keyed bijection on the days of months of 32 days that no date of the other calendar has (as 2045-03-32), by cycle walking."""
    x, span = (year - 1900) * 384 + (month - 1) * 32 + day - 1, 200 * 384
    while True:
        x = int(permute(f"{x:05d}", key, "shape"))
        if x < span:
            y, m, d = 1900 + x // 384, x % 384 // 32 + 1, x % 32 + 1
            try:
                datetime.date(y, m, d)
            except ValueError:
                return y, m, d


def _national(digits: str) -> int:
    """Where the national number of a phone number begins: behind the country's code and the trunk zero."""
    at = 5 if digits.startswith("00977") else 3 if digits.startswith("977") and len(digits) > 10 else 0
    return at + (digits[at : at + 1] == "0")


def _pseudonym(value: str, kind: str, key: bytes) -> str:
    """Placeholder of one value; a phone number's first national digit, which shows its kind, stays, the rest is permuted."""
    if kind in ("phone", "id_number"):
        plain = [str(int(c)) if c.isdigit() else c for c in value]
        digits = "".join(c for c in plain if c.isdigit())
        keep = min(len(digits) - 1, _national(digits) + 1) if kind == "phone" else 0
        core = digits[keep:]
        new = digits[:keep] + permute(core, key, kind + digits[keep - 1 : keep])
        it = iter(new)
        shown = "".join((chr(ord("०") + int(next(it))) if "०" <= c <= "९" else next(it)) if c.isdigit() else c for c in value)
        return f"[{kind.upper()} {shown}]"
    tag = hmac.digest(key, f"{kind}|{' '.join(value.split()).lower()}".encode("utf-8", "surrogatepass"), "sha256").hex()[:24]
    return f"[{kind.upper()} {tag}]"


def redact(text: str, places: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for a, b, kind in places:
        out += [text[at:a], _pseudonym(text[a:b], kind, key)]
        at = b
    done = "".join([*out, text[at:]])

    def birth(m: re.Match) -> str:
        year, month, day = (int(m[k]) for k in (1, 2, 3))
        if not 1900 <= year < 2100:
            return m[0]
        try:
            d = permute_date(datetime.date(year, month, day), key)
            year, month, day = d.year, d.month, d.day
        except ValueError:
            if not (1 <= month <= 12 and 1 <= day <= 32):
                return m[0]
            year, month, day = permute_shape(year, month, day, key)
        return m[0][: m.start(1) - m.start()] + f"{year:04d}{m[0][m.end(1) - m.start()]}{month:02d}{m[0][m.end(2) - m.start()]}{day:02d}"

    return _BIRTH.sub(birth, done)


#: Name parts that are sent to the workers at most; the list doesn't grow with the corpus.
MOST_PARTS = 1_000_000


def _name_list(names: DataFrame) -> list[tuple[str, str, str]]:
    """The name list; one beyond the bound is refused, not cut."""
    parts = [tuple(r) for r in names.select("name_part", "part_kind", "script").filter("name_part is not null").distinct().limit(MOST_PARTS + 1).collect()]
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return parts


_FINDERS: dict[int, Finder] = {}


def _finder(names: tuple) -> Finder:
    k = hash(names)
    if k not in _FINDERS:
        _FINDERS[k] = Finder(list(names))
    return _FINDERS[k]


def find_places(df: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator: (id, start_char, end_char, pii_type) of every place."""
    listed = df.sparkSession.sparkContext.broadcast(tuple(sorted(_name_list(names))))
    kind = dict(df.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        find = _finder(listed.value).find
        found = [find(t) if t else [] for t in b.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = [x for f in found for x in f]
        if not flat:
            return None
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat])], [id_col, "start_char", "end_char", "pii_type"])

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, start_char int, end_char int, pii_type string", 1000)


def redact_texts(df: DataFrame, names: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator: (id, text with placeholders, number of places) of every row."""
    listed = df.sparkSession.sparkContext.broadcast(tuple(sorted(_name_list(names))))
    kind = dict(df.dtypes)[id_col]
    secret = hashlib.sha256(key.encode()).digest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        find = _finder(listed.value).find
        texts = b.column(1).to_pylist()
        places = [find(t) if t else [] for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, p, secret) if t else t for t, p in zip(texts, places)], pa.string()), pa.array([len(p) for p in places], pa.int32())], [id_col, text_col, "n_places"])

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, {text_col} string, n_places int", 1000)


def p9_found(spark, sf_dir):
    return find_places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


def p9_redacted(spark, sf_dir):
    """The key is named in granthika.pseudonym.key; where it is unset, one is drawn, and pseudonyms are linked within this run only."""
    key = spark.conf.get("granthika.pseudonym.key", None) or secrets.token_hex(32)
    return redact_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), key)
