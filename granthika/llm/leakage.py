"""Problem 8: evaluation texts that stand in training text.

Method: a BM25 inverted index of the test items' sentences, searched with block-max WAND.  Sentences lie in blocks, and
every term keeps the largest impact it has in each block where it stands, and its postings by block.  A training text is cut
into passages that overlap, so that every stretch as long as any sentence lies whole in one of them, and each passage is a
query of its distinct terms.  Its terms with the longest lists whose largest impacts add up to no more than SPLIT lie below the
pivot: a sentence must reach the rest of its threshold by the others.  A passage is passed over where their impacts don't add
up to that, a block where their maxima in it don't, and only sentences of the blocks left are scored; the longest lists are
looked up for those that came near enough.  All sentences above the threshold are retrieved, and what the passages of a
text retrieve is joined.  An alignment of words then verifies that a sentence stands in
the text with few words altered.  An item has leaked where its verified sentences make up at least half of its passage;
question and answer are verified the same way and reported.

The threshold of a sentence follows from what verifies it: words that may be missing make up 1 - VERIFY of its words and
weight, so its score falls by their greatest impact at most, and no sentence that would be verified is passed over.

Items with equal passages share their sentences and count each.  Items are indexed in parts of ITEMS_AT_ONCE, which bounds
what is sent and held; all parts up to PARTS_AT_ONCE are searched in one scan of the texts.

Defined cases: null and empty texts and passages match nothing; repeated rows of an id are one; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table
from .lookalikes import _FOREIGN, TO_LATIN, fold
from .sentences import units

ITEMS_AT_ONCE, PARTS_AT_ONCE = 20_000, 8
#: Share of a sentence's words (by number and by weight) that verifies it, share of the passage.
VERIFY, PASSAGE = 0.8, 0.5
#: Sentences of a block; words that a stretch may be longer than its sentence.
BLOCK, SLACK = 4, 6
#: Scores of passages and sentences that are held at once.
CELLS = 1 << 22
#: Share of a threshold that the longest lists may bring together without being looked at first.
SPLIT = 0.5
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:[ऀ-ःऺ-ॏ॑-ॗॢॣ̀-ͯ]+[^\W_一-鿿]*)*")
_HAN = re.compile("[一-鿿]")
_FOREIGN_TO_LATIN = {ord(a): b for a, b in TO_LATIN.items()}


def words(text: str | None) -> list[str]:
    """Words in one form; case, spacing, punctuation and look-alikes make no difference."""
    if not text:
        return []
    text = fold(text)
    if _FOREIGN.search(text):
        text = text.translate(_FOREIGN_TO_LATIN)
    return _WORD.findall(text.lower())


def terms(ws: list[str]) -> set[str]:
    """Distinct index terms: words, and pairs of neighbouring characters where a script has no spaces."""
    out = set(ws)
    if any("\u4e00" <= w <= "\u9fff" for w in out if len(w) == 1):
        out = {w for w in out if not _HAN.match(w)}
        out |= {a + b for a, b in zip(ws, ws[1:]) if _HAN.match(a) and _HAN.match(b)}
    return out


def similarity(sentence: list[str], weight: list[float], ws: list[str], places: dict[str, list[int]]) -> float:
    """Best share of the sentence's words that stand in one stretch of the text, in order: the lesser of the shares by number and by weight.

    Sentences of one pattern share most of their words but not the rare ones, so both shares count.  A stretch that holds
    VERIFY of the words holds one of any (1 - VERIFY) of them and one more, so the places of those that are rarest in the
    text are enough; below VERIFY the result is a lower bound."""
    m, best, tried, own = len(sentence), 0.0, set(), set(sentence)
    rarest = sorted(range(m), key=lambda q: len(places.get(sentence[q], ())))[: m - math.ceil(VERIFY * m) + 1]
    for q in rarest:
        for p in places.get(sentence[q], ()):
            low = max(0, p - q - 3)
            if low // 3 in tried:
                continue
            tried.add(low // 3)
            window = ws[low : p - q + m + 3]
            hits = len(own.intersection(window)) + m - len(own)
            if hits < VERIFY * m or hits <= best * m:
                continue
            kept = [k for x in SequenceMatcher(None, sentence, window, autojunk=False).get_matching_blocks() for k in range(x.a, x.a + x.size)]
            best = max(best, min(len(kept) / m, sum(weight[k] for k in kept)))
            if best > 0.999:
                return best
    return best


class Index:
    """Inverted index of the distinct sentences of all items, in blocks."""

    def __init__(self, items: list[tuple[int, str, str, str]]):
        self.parts: dict[int, list[tuple[int, int]]] = {}
        self.other: dict[int, tuple[int, int]] = {}
        known: dict[tuple, int] = {}
        one: dict[str, str] = {}

        def number(ws: list[str]) -> int:
            return known.setdefault(tuple(one.setdefault(w, w) for w in ws), len(known)) if ws else -1

        for item, passage, question, answer in items:
            own = [(passage[a:b], b - a) for a, b in units(passage)] if passage else []
            self.parts[item] = [(number(w), n) for t, n in own if (w := words(t))]
            self.other[item] = number(words(question)), number(words(answer))
        order = sorted(known, key=lambda s: (bool(_HAN.match(s[0])), s))
        place = {known[s]: i for i, s in enumerate(order)} | {-1: -1}
        self.sentences = order
        self.parts = {k: [(place[s], n) for s, n in v] for k, v in self.parts.items()}
        self.other = {k: (place[a], place[b]) for k, (a, b) in self.other.items()}
        own = [terms(list(s)) or set(s) for s in self.sentences]
        self.df = Counter(t for o in own for t in o)
        self.n = len(own)
        self.term = {t: i for i, t in enumerate(sorted(self.df))}
        self.longest = max(map(len, self.sentences), default=0)
        # Impacts are scaled so that a sentence is retrieved at 1.
        which, who, impact = [], [], []
        for s, o in enumerate(own):
            weight = {t: self.idf(t) for t in o}
            total = sum(weight.values())
            least = 1 - self._missing(s, weight) / total if total else 1.0
            for t, w in weight.items():
                which.append(self.term[t])
                who.append(s)
                impact.append(w / total / max(least, 1e-3) if total else 1.0)
        which, self.who, self.impact = np.array(which, np.int64), np.array(who, np.int64), np.array(impact, np.float64)
        sort = np.lexsort((self.who, which))
        which, self.who, self.impact = which[sort], self.who[sort], self.impact[sort]
        # For each term its blocks: block, largest impact, postings; start: the first of each term.
        blocks = self.n // BLOCK + 1
        key = which * blocks + self.who // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block, self.posting, self.postings = key[first] % blocks, first, np.diff(np.append(first, len(key)))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.start = np.searchsorted(key[first] // blocks, np.arange(len(self.term) + 1))
        self.top = np.maximum.reduceat(self.most, self.start[:-1]) if len(self.term) else np.zeros(0)
        self.length = np.add.reduceat(self.postings, self.start[:-1]) if len(self.term) else np.zeros(0, np.int64)
        self.by_length = np.argsort(-self.length, kind="stable")
        self.place = np.empty_like(self.by_length)
        self.place[self.by_length] = np.arange(len(self.term))
        self.users: dict[int, list[int]] = defaultdict(list)
        for item, ps in self.parts.items():
            for s, _ in ps:
                self.users[s].append(item)
        #: Postings scored, and postings of all terms of all passages.
        self.scored = self.all = 0

    def idf(self, t: str) -> float:
        d = self.df.get(t, 0)
        return math.log(1 + (self.n - d + 0.5) / (d + 0.5))

    def weights(self, s: int) -> list[float]:
        """Share of each word in the weight of the sentence."""
        w = [1.0 if _HAN.match(t) else self.idf(t) for t in self.sentences[s]]
        total = sum(w)
        return [x / total for x in w]

    def _missing(self, s: int, weight: dict[str, float]) -> float:
        """Most weight of index terms that a verified occurrence of the sentence may lack."""
        ws = self.sentences[s]
        spare = (1 - VERIFY) * len(ws)
        if any(_HAN.match(w) for w in ws):  # a character is part of two pairs
            return sum(sorted(weight.values(), reverse=True)[: 2 * math.floor(spare + 1e-9)])
        by_weight = (1 - VERIFY) * sum(self.idf(w) for w in ws)
        return min(by_weight, sum(sorted(weight.values(), reverse=True)[: math.floor(spare + 1e-9)])) + 1e-9

    def passages(self, ws: list[str]) -> list[np.ndarray]:
        """Terms of each passage of the words; passages overlap by as much as a sentence may be long."""
        get = self.term.get
        own = [get(w, -1) for w in ws]
        step = self.longest + SLACK
        pairs = [get(a + b, -1) if _HAN.match(a) and _HAN.match(b) else -1 for a, b in zip(ws, ws[1:])] if _HAN.search("".join(ws)) else None
        ids = np.array([own, [*pairs, -1]] if pairs is not None else [own], np.int64)
        return [ids[:, a : a + 2 * step].ravel() for a in range(0, max(1, len(ws) - step), step)]

    def search(self, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(passage, sentence) of each sentence whose score in a passage reaches its threshold."""
        blocks = self.n // BLOCK + 1
        step = max(1, CELLS // (blocks * BLOCK))
        found = [self._search(passages[at : at + step], at, blocks) for at in range(0, len(passages) if len(self.term) else 0, step)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _search(self, passages: list[np.ndarray], first: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        size, n = len(self.term), len(passages)
        owner = np.repeat(np.arange(n), [len(p) for p in passages])
        ids = np.concatenate(passages)
        # Terms of a passage in the order of their lists' length, longest first: `place` is that order.
        key = np.sort((owner * size + self.place[ids])[ids >= 0])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        owner, ids = np.divmod(key, size)
        ids = self.by_length[ids]
        # The pivot: what the longest lists can bring together stays below SPLIT, so a sentence needs the rest of 1 from the others.
        top = self.top[ids]
        run = np.cumsum(top)
        head = np.searchsorted(owner, np.arange(n))
        base = np.where(head > 0, run[head - 1], 0.0)[owner] if len(owner) else run
        rest = run - base > SPLIT
        need = 1 - 1e-6 - np.bincount(owner[~rest], weights=top[~rest], minlength=n)
        able = np.bincount(owner[rest], weights=top[rest], minlength=n) >= need
        self.all += int(self.length[ids].sum())
        keep = rest & able[owner]
        cell, entry = self._cells(owner[keep], ids[keep], blocks)
        bound = np.bincount(cell, weights=self.most[entry], minlength=n * blocks)
        hit = (bound >= np.repeat(need, blocks))[cell]
        score = self._scored(cell[hit], entry[hit], n * blocks)
        # Sentences that the shorter lists alone bring near enough get what the longest ones add.
        near = np.flatnonzero(score >= np.repeat(need, blocks * BLOCK))
        live, some = np.zeros(n, bool), np.zeros(n * blocks, bool)
        live[near // (blocks * BLOCK)] = True
        some[near // BLOCK] = True
        keep = ~rest & live[owner]
        cell, entry = self._cells(owner[keep], ids[keep], blocks)
        hit = some[cell]
        near = near[score[near] + self._scored(cell[hit], entry[hit], n * blocks)[near] >= 1 - 1e-6]
        return near // (blocks * BLOCK) + first, near % (blocks * BLOCK)

    def _cells(self, owner: np.ndarray, ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage and block, place among the blocks' maxima) of each block of each term."""
        few = self.start[ids + 1] - self.start[ids]
        entry = _ranges(self.start[ids], few)
        return np.repeat(owner * blocks, few) + self.block[entry], entry

    def _scored(self, cell: np.ndarray, entry: np.ndarray, cells: int) -> np.ndarray:
        """Scores of the sentences of all cells over the postings of the entries."""
        number = self.postings[entry]
        posting = _ranges(self.posting[entry], number)
        self.scored += len(posting)
        return np.bincount(np.repeat(cell * BLOCK, number) + self.who[posting] % BLOCK, weights=self.impact[posting], minlength=cells * BLOCK)

    def leaks_of(self, texts: list[list[str]]) -> list[list[tuple[int, float, bool, bool]]]:
        """For each text, given as its words: (item, share of its passage, question found, answer found) of each leaked item."""
        passages, owner = [], []
        for k, ws in enumerate(texts):
            own = self.passages(ws) if ws else []
            passages += own
            owner += [k] * len(own)
        got: dict[int, set[int]] = defaultdict(set)
        for p, s in zip(*(x.tolist() for x in self.search(passages))):
            got[owner[p]].add(s)
        return [self._verified(ws, got[k]) if k in got else [] for k, ws in enumerate(texts)]

    def leaks(self, text: str | None) -> list[tuple[int, float, bool, bool]]:
        return self.leaks_of([words(text)])[0]

    def _verified(self, ws: list[str], got: set[int]) -> list[tuple[int, float, bool, bool]]:
        # a passage is worth verifying only where the retrieved sentences could make up enough of it
        worth = set()
        for s in got:
            for item in self.users[s] if s in self.users else ():
                if item not in worth:
                    ps = self.parts[item]
                    if sum(n for x, n in ps if x in got) >= PASSAGE * sum(n for _, n in ps):
                        worth.add(item)
        if not worth:
            return []
        places: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(ws):
            places[w].append(k)
        stands: dict[int, bool] = {}

        def there(s: int) -> bool:
            if s not in stands:
                stands[s] = s >= 0 and s in got and similarity(list(self.sentences[s]), self.weights(s), ws, places) >= VERIFY
            return stands[s]

        out = []
        for item in sorted(worth):
            ps = self.parts[item]
            share = sum(n for s, n in ps if there(s)) / sum(n for _, n in ps)
            if share >= PASSAGE:
                q, a = self.other[item]
                out.append((item, share, there(q), there(a)))
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_BUILT: dict[str, Index] = {}


def _index(name: str, items: tuple, keep: list[str]) -> Index:
    """The index of one part of the items; a worker keeps those of the scan it is in."""
    if name not in _BUILT:
        for old in set(_BUILT) - set(keep):
            del _BUILT[old]
        _BUILT[name] = Index(list(items))
    return _BUILT[name]


def _parts(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in parts of ITEMS_AT_ONCE; the driver holds one of them at a time."""
    part: list[tuple] = []
    for r in items.filter("item_id is not null").select("item_id", "passage", "question", "answer").distinct().orderBy("item_id", "passage", "question", "answer").toLocalIterator():
        part.append((r[0], r[1] or "", r[2] or "", r[3] or ""))
        if len(part) == ITEMS_AT_ONCE:
            yield part
            part = []
    yield part


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator: (id, item_id, share, question_found, answer_found) for every text and each item that leaked into it."""
    kind = dict(df.dtypes)[id_col]
    source = df.select(id_col, text_col)
    sent = [(uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(tuple(p))) for p in _parts(items)]
    out = None
    for at in range(0, len(sent), PARTS_AT_ONCE):

        def run(b: pa.RecordBatch, sent=sent[at : at + PARTS_AT_ONCE]) -> pa.RecordBatch | None:
            texts = [words(t) for t in b.column(1).to_pylist()]
            found = []
            for name, shared in sent:
                index = _index(name, shared.value, [n for n, _ in sent])
                found += [(k, *x) for k, xs in enumerate(index.leaks_of(texts)) for x in xs]
            if not found:
                return None
            k, item, share, q, a = zip(*found)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(item, pa.int32()), pa.array(share), pa.array(q), pa.array(a)], [id_col, "item_id", "share", "question_found", "answer_found"])

        part = map_arrow(source, run, f"{id_col} {kind}, item_id int, share double, question_found boolean, answer_found boolean", 500)
        out = part if out is None else out.unionByName(part)
    return out


def p8_found(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_leaks(spark, sf_dir):
    """Leaked items with the share of the passage and whether question and answer stand in the text, too."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("question_found").alias("question_found"), F.max("answer_found").alias("answer_found"))
