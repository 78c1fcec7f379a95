"""Problem 6: a language with a confidence for every chunk and every segment of a chunk.

Method: error-correcting output codes.  Each language profile (a language in one script) has a codeword of BITS bits; for
each bit a binary classifier over hashed character bigrams and trigrams tells the profiles with a one from those with a
zero.  Its margins, weighted by a logistic loss, give the distance of a text to each codeword; the nearest one is
chosen, and the text is ambiguous when the second is nearly as near.  Distances of a chunk's sentences are joined along
the chunk by a Viterbi pass with a price for a change of language, so segments are runs of whole sentences.

The classifiers are fitted on a sample of labelled rows bounded by SAMPLE (drawn by hash of the id); labels of a profile's
own script only are taken, and each sentence of the sample is relabelled once by the first fit, which clears wrong labels.
Every row of the table is classified, whole.

Defined cases: null and empty texts have no segment, and p6_segments gives them the language `und` with confidence 0; a
text without letters gets the language of its label, or none where the label is missing; of a table, the cells are read; repeated rows of one id are one; other columns are not read.
"""

from __future__ import annotations

import json
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table
from .encoding_repair import Channel, suspicious
from .lookalikes import _FOREIGN, TO_LATIN, fold

#: Most rows of the sample on which the classifiers are fitted.
SAMPLE = 6_000
#: (language, script) of each profile.
PROFILES = (("en", "latin"), ("fr", "latin"), ("ne", "latin"), ("ne", "devanagari"), ("hi", "devanagari"), ("zh", "han"))
BITS, BUCKETS = 10, 1 << 15
#: Weight of one n-gram's evidence, price of a change of language, nearness of the second codeword that makes a text ambiguous.
WEIGHT, CHANGE, AMBIGUOUS = 0.25, 6.0, 2.0
#: A piece is foreign to its nearest profile where its n-grams are rarer there than in all but this share of the sample, by this much.
FOREIGN_SHARE, FOREIGN_STEP = 0.002, 0.25
#: Letters that the profiles' scripts must hold of a piece that is none of other scripts.
KNOWN_SCRIPTS = 0.6
#: Other spellings of labels.
ALIASES = {
    "en": "en eng english en-gb en-us en_gb en_us en-in",
    "ne": "ne nep npi nepali ne-np ne_np नेपाली",
    "hi": "hi hin hindi hi-in hi_in हिन्दी हिंदी",
    "zh": "zh zho chi cmn chinese zh-cn zh_cn zh-hans 中文 汉语",
    "fr": "fr fra fre french fr-fr fr_fr français francais",
    "mixed": "mixed mul multi multilingual multiple",
}
_CANON = {a: k for k, v in ALIASES.items() for a in v.split()}
#: Ends of sentences: marks that end nothing else; a full stop after three letters or more that are no abbreviation, or between two scripts.
_CUT = re.compile(
    r"(?<=[।॥?!…|])[\"”’»」』)]*\s+|(?<=[。！？｡])[”’」』）]*\s*|\n\s*\n"
    r"|(?<=[a-zà-ÿ0-9%)]{3}\.)(?<!Pvt\.)(?<!Ltd\.)(?<!Art\.)(?<!art\.)(?<!Sec\.)(?<!Fig\.)(?<!vol\.)[\"”’»)]*\s+(?=[\"“‘«(]?[^a-z0-9\s])"
    r"|(?<=[ऀ-ॿ]{4}\.)[\"”’»)]*\s+|(?<=[a-zA-Z]\.)\s+(?=[ऀ-ॿ一-鿿])|(?<=[ऀ-ॿ]\.)\s+(?=[A-Za-z一-鿿])"
)
#: Letters of a sentence below which it is read together with its neighbour in the same script.
SHORT = 30
_NOT_LETTER = re.compile(r"[\x00-@\[-`{-¿×÷।॥०-९‐-⁯⃐-℀、-〿＀-｠�]+")
_SCRIPTS = (("latin", re.compile("[a-zà-ɏ]")), ("devanagari", re.compile("[ऀ-ॿ]")), ("han", re.compile("[一-鿿]")))
_PLAIN = Channel({})


def canonical(label: str | None) -> str | None:
    """Language of a label in any spelling; a region or script after it makes no difference."""
    low = label.strip().lower() if label else ""
    return _CANON.get(low) or _CANON.get(re.split(r"[-_ /(]", low)[0])


def pieces(text: str) -> list[str]:
    """The text's sentences as lower-case letters parted by single spaces; those without letters are left out."""
    if suspicious(text):
        text = _PLAIN.repair(text)[0] or text
    text = fold(text) or ""
    if _FOREIGN.search(text):
        text = text.translate({ord(a): b for a, b in TO_LATIN.items()})
    out: list[str] = []
    for p in _CUT.split(text):
        if p and len(p := _NOT_LETTER.sub(" ", p.lower()).strip()) > 1:
            if out and (len(p) < SHORT or len(out[-1]) < SHORT) and _script(p) == _script(out[-1]):
                out[-1] += " " + p
            else:
                out.append(p)
    return out


def pieces_at(text: str) -> list[tuple[str, int, int]]:
    """The same with each sentence's place in the text as it is."""
    out: list[list] = []
    at, ends = 0, [*_CUT.finditer(text), None]
    for m in ends:
        part, start, at = text[at : m.start() if m else len(text)], at, m.end() if m else len(text)
        for p in [" ".join(pieces(part))] if part else []:
            if p:
                end = start + len(part.rstrip())
                start += len(part) - len(part.lstrip())
                if out and (len(p) < SHORT or len(out[-1][0]) < SHORT) and _script(p) == _script(out[-1][0]):
                    out[-1][0] += " " + p
                    out[-1][2] = end
                else:
                    out.append([p, start, end])
    return [tuple(x) for x in out]


def _script(piece: str) -> str:
    return max(_SCRIPTS, key=lambda s: len(s[1].findall(piece)))[0]


def cells(text: str | None) -> str | None:
    """The strings of a table's JSON, each row a sentence; any other text as it is."""
    try:
        rows = list(_rows(json.loads(text))) if text else []
    except (ValueError, RecursionError):
        return text
    return "\n\n".join(rows) if rows else text


def _rows(value):
    values = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else [value]
    if line := " ".join(v for v in values if isinstance(v, str)):
        yield line
    for v in values:
        if isinstance(v, (dict, list)):
            yield from _rows(v)


def codewords(profiles: int = len(PROFILES), bits: int = BITS) -> np.ndarray:
    """(profiles, bits) of -1 and 1: of all ways to part the profiles in two, those that keep the codewords furthest apart, taken one by one."""
    ways = [np.array([1 if i in s else -1 for i in range(profiles)]) for k in range(1, profiles // 2 + 1) for s in combinations(range(profiles), k) if k < profiles / 2 or 0 in s]
    taken: list[np.ndarray] = []
    pairs = list(combinations(range(profiles), 2))
    while len(taken) < bits:
        apart = [sum(t[a] != t[b] for t in taken) for a, b in pairs]
        rest = [w for w in ways if not any(w is t for t in taken)]
        taken.append(max(rest, key=lambda w: sorted(d + int(w[a] != w[b]) for d, (a, b) in zip(apart, pairs))))
    return np.stack(taken, 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams at each place of all pieces in a row (a space before and after each), and each piece's start."""
    joined = " ".join(texts)
    c = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start = np.cumsum(size) - size
    two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)
    three = two ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return ((two ^ (two >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32), ((three ^ (three >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32) + BUCKETS, start


class Coder:
    """Bit classifiers (weights by n-gram bucket) and the distances they give."""

    def __init__(self, weights: np.ndarray, code: np.ndarray, likely: np.ndarray | None = None, floor: np.ndarray | None = None):
        self.weights, self.code = weights, code
        #: Log probability of each n-gram in each profile, and its mean below which a text is none of the profile's.
        self.likely, self.floor = likely, floor

    @property
    def untrained(self) -> bool:
        return not len(self.weights)

    @classmethod
    def fit(cls, texts: list[str], owner: np.ndarray) -> Coder:
        two, three, start = _grams(texts)
        of = np.repeat(owner, np.diff(np.r_[start, len(two)]))
        p = np.empty((len(PROFILES), 2 * BUCKETS))
        for k in range(len(PROFILES)):
            n = np.bincount(two[of == k], minlength=2 * BUCKETS) + np.bincount(three[of == k], minlength=2 * BUCKETS)
            p[k] = (n + 0.02) / (n.sum() + 0.02 * len(n))
        code = codewords()
        bits = [np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])]
        out = cls(np.stack(bits, 1).astype(np.float32), code, np.log(p).astype(np.float32), np.full(len(PROFILES), -np.inf))
        mean = out.means(texts, owner)
        for k in range(len(PROFILES)):
            own = mean[owner == k]
            if len(own):
                out.floor[k] = np.quantile(own, FOREIGN_SHARE) - FOREIGN_STEP
        return out

    def means(self, texts: list[str], profile: np.ndarray) -> np.ndarray:
        """Mean log probability of the n-grams of each piece in its profile."""
        two, three, start = _grams(texts)
        number = np.diff(np.r_[start, len(two)])
        of = np.repeat(profile, number)
        return np.add.reduceat(self.likely[of, two] + self.likely[of, three], start) / np.maximum(number, 1) / 2

    def distances(self, texts: list[str]) -> np.ndarray:
        """(pieces, profiles): loss of each codeword bit, added up over the bits."""
        two, three, start = _grams(texts)
        margin = np.add.reduceat(self.weights[two] + self.weights[three], start, axis=0) * WEIGHT
        return np.stack([np.logaddexp(0, -margin * w).mean(1) for w in self.code], 1)


def train(rows: list[tuple[str, str]]) -> Coder:
    """Fit on (label, text), relabel each sentence by the first fit, fit again."""
    texts, owner = [], []
    index = {p: i for i, p in enumerate(PROFILES)}
    for label, text in rows:
        for p in pieces(text):
            k = index.get((canonical(label), _script(p)))
            if k is not None and len(p) > 20:
                texts.append(p)
                owner.append(k)
    if not texts:  # nothing to learn from: no text gets a language
        return Coder(np.zeros((0, BITS), np.float32), codewords())
    first = Coder.fit(texts, np.array(owner))
    again = first.distances(texts).argmin(1)
    fits = np.array([PROFILES[a][1] == PROFILES[o][1] for a, o in zip(again, owner)])
    return Coder.fit(texts, np.where(fits, again, owner))


def _path(cost: np.ndarray) -> np.ndarray:
    """Profile of each sentence: the least sum of distances and prices of changes."""
    n, k = cost.shape
    best = cost.argmin(1)
    if (best != best[0]).any():
        total, back = cost[0].copy(), np.zeros((n, k), int)
        for i in range(1, n):
            least = int(total.argmin())
            stay = total <= total[least] + CHANGE
            back[i] = np.where(stay, np.arange(k), least)
            total = np.where(stay, total, total[least] + CHANGE) + cost[i]
        best = np.empty(n, int)
        best[-1] = total.argmin()
        for i in range(n - 1, 0, -1):
            best[i - 1] = back[i][best[i]]
    return best


def segments(cost: np.ndarray, best: np.ndarray | None = None, foreign: np.ndarray | None = None) -> list[tuple[str, float, bool, int, int]]:
    """Runs of sentences in one language from their distances: (language, confidence, ambiguous, first sentence, behind the last).

    foreign: sentences that are none of their profile's; a run that holds them for more than half is ambiguous, and its
    confidence is multiplied by the share of the others."""
    n = len(cost)
    best = _path(cost) if best is None else best
    out, at = [], 0
    names = [PROFILES[b][0] for b in best]
    for i in range(1, n + 1):
        if i == n or names[i] != names[at]:
            d: dict[str, float] = {}
            for (lang, _), x in zip(PROFILES, cost[at:i].sum(0)):
                d[lang] = min(x, d.get(lang, x))
            own = d.pop(names[at])
            gap = min(d.values()) - own
            sure = float(1 / (1 + sum(np.exp(np.clip(own - x, -50, 50)) for x in d.values())))
            strange = float(foreign[at:i].mean()) if foreign is not None else 0.0
            out.append((names[at], sure * (1 - strange), bool(gap < AMBIGUOUS or strange > 0.5), at, i))
            at = i
    return out


def _foreign(coder: Coder, texts: list[str], best: np.ndarray) -> np.ndarray:
    """Pieces whose letters are of other scripts, or whose n-grams are rarer than the nearest profile's own texts have them."""
    known = np.array([sum(len(s[1].findall(t)) for s in _SCRIPTS) < KNOWN_SCRIPTS * sum(map(str.isalpha, t)) for t in texts], bool)
    return known | (coder.means(texts, best) < coder.floor[best])


def classify(coder: Coder, texts: list[str | None], places: bool = False) -> list[list[tuple]]:
    """Segments of each text: (language, confidence, ambiguous), with `places` also start and end, and foreign texts told apart."""
    own = [(pieces_at(t) if places else [(p, 0, 0) for p in pieces(t)]) if t else [] for t in texts]
    flat = [p for ps in own for p, _, _ in ps]
    if not flat or coder.untrained:
        return [[] for _ in texts]
    cost = coder.distances(flat)
    out, at = [], 0
    if places:
        size = [len(ps) for ps in own]
        ends = np.cumsum(size)
        best = np.concatenate([_path(cost[e - n : e]) for n, e in zip(size, ends) if n])
        foreign = _foreign(coder, flat, best)
    for ps in own:
        end = at + len(ps)
        found = segments(cost[at:end], *((best[at:end], foreign[at:end]) if places else ())) if ps else []
        out.append([(*x[:3], ps[x[3]][1], ps[x[4] - 1][2]) if places else x[:3] for x in found])
        at = end
    return out


def fit_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Coder:
    known = df.filter(F.lower(F.trim(label_col)).isin([a for k, v in ALIASES.items() if k != "mixed" for a in v.split()]) & F.col(text_col).isNotNull())
    share = min(1.0, sample / max(1, known.select(label_col).count()))
    drawn = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    return train([(r[0], r[1]) for r in drawn.select(label_col, text_col).limit(2 * sample).collect()])


def label_segments(df: DataFrame, id_col: str, text_col: str, label_col: str, coder: Coder | None = None, type_col: str | None = None, places: bool = False) -> DataFrame:
    """Operator: (id, label, label_right, segments array<struct<language, confidence, ambiguous>>) of every row, in one narrow pass.

    With type_col, rows of type `table` are read by their cells.  With places, segments also have start and end in the text
    (null in tables), and those of no language that the sample has are ambiguous and of low confidence."""
    coder = coder or fit_sample(df, id_col, text_col, label_col)
    shared = df.sparkSession.sparkContext.broadcast((coder.weights, coder.code, *((coder.likely, coder.floor) if places else ())))
    kind = dict(df.dtypes)[id_col]
    names = ["language", "confidence", "ambiguous", *(["start_char", "end_char"] if places else [])]
    seg = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())))))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        labels = b.column(2).to_pylist()
        texts = b.column(1).to_pylist()
        table = [k == "table" for k in b.column(3).to_pylist()] if type_col else [False] * len(texts)
        texts = [cells(t) if k else t for t, k in zip(texts, table)]
        found = classify(Coder(*shared.value), texts, places)
        for i, f in enumerate(found):
            if not f and canonical(labels[i]) not in (None, "mixed") and (b.column(1)[i].as_py() or "").strip():
                found[i] = [(canonical(labels[i]), 0.0, True, None, None)]
        right = [(langs := {s[0] for s in f}) == set() or canonical(t) == ("mixed" if len(langs) > 1 else next(iter(langs))) for f, t in zip(found, labels)]
        values = [[dict(zip(names, (*s[:3], None, None) if k else s)) for s in f] for f, k in zip(found, table)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(right), pa.array(values, seg)], ["id", "label", "label_right", "segments"])

    fields = "language: string, confidence: double, ambiguous: boolean" + (", start_char: int, end_char: int" if places else "")
    return map_arrow(df.select(id_col, text_col, label_col, *([type_col] if type_col else [])), run, f"id {kind}, label string, label_right boolean, segments array<struct<{fields}>>", 1000)


def p6_found(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").filter("chunk_type = 'text'")
    wrong = label_segments(chunks, "chunk_id", "text", "language").filter(~F.col("label_right"))
    return wrong.select(F.col("id").alias("chunk_id"), F.posexplode("segments").alias("pos", "s")).select("chunk_id", (F.col("pos") + 1).alias("seg_no"), F.col("s.language").alias("language")).distinct()


def p6_segments(spark, sf_dir):
    """Every chunk's segments with a new confidence and their place in the text; a chunk without one is `und`."""
    chunks = table(spark, sf_dir, "chunks")
    coder = fit_sample(chunks.filter("chunk_type = 'text'"), "chunk_id", "text", "language")
    done = label_segments(chunks, "chunk_id", "text", "language", coder, "chunk_type", places=True)
    known = F.col("s").isNotNull()
    rows = done.select(F.col("id").alias("chunk_id"), "label", "label_right", F.posexplode_outer("segments").alias("pos", "s"))
    return rows.select("chunk_id", "label", F.when(known, F.col("label_right")).alias("label_right"), (F.coalesce("pos", F.lit(0)) + 1).alias("seg_no"), F.coalesce("s.language", F.lit("und")).alias("language"), F.coalesce("s.confidence", F.lit(0.0)).alias("language_confidence"), F.coalesce("s.ambiguous", F.lit(True)).alias("ambiguous"), "s.start_char", "s.end_char").distinct()
