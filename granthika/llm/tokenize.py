"""Problem 7: ids of every text by a public byte-level BPE tokenizer.

Method: speculate and verify.  Texts are cut into space-led units whose bounds are bounds of the tokenizer's own
pattern, too; a unit's ids are kept, so that a unit is encoded once per worker while it stays in the table.  For a new
word, greedy longest match proposes tokens.  A token sequence is the BPE result exactly when each token is the result
for its own bytes and each adjacent pair is the result for the joined bytes; all pairs of a batch are tested at once
against a sorted array of tested pair codes, and only words with a failing pair are merged exactly.

Null and empty texts give an empty list; blank texts are encoded as they are; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, spread

#: Where the public vocabulary files lie.
TOKENIZER_DIR = "/opt/tokenizers"
#: The pattern by which this family of byte-level tokenizers cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units of text kept per worker; the table is emptied beyond it.
KEPT_UNITS = 400_000
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SpeculativeBpe:
    """Encoder over ranks (token bytes to id), where a smaller rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.n = max(ranks.values()) + 1
        #: Longest token that begins with two bytes.
        self.reach: dict[bytes, int] = {}
        for k in ranks:
            self.reach[k[:2]] = max(self.reach.get(k[:2], 1), len(k))
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.good = np.zeros(0, np.int64)
        self.bad = np.zeros(0, np.int64)
        self.single: dict[int, bool] = {}
        self.fine = regex.compile(PATTERN)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: again and again the adjacent pair of lowest rank is joined, the leftmost first."""
        if len(word) > 48:
            return self._merge_long(word)
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same over linked parts with a heap of pairs: n log n, where searching all pairs for each join is quadratic."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is named by its first byte; end 0: joined to the one before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two was joined elsewhere since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(word[i : end[stop]])
                if r is not None:
                    heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0:
                r = ranks.get(word[k:stop])
                if r is not None:
                    heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        out, i, n, ranks, reach = [], 0, len(word), self.ranks, self.reach
        while i < n:
            for j in range(min(n, i + reach.get(word[i : i + 2], 1)), i, -1):
                r = ranks.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def _alone(self, token: int) -> bool:
        if token not in self.single:
            self.single[token] = self.merge(self.bytes_of[token]) == [token]
        return self.single[token]

    def _test(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair code stands for a compatible pair; new codes are merged once and kept."""
        uniq, back = np.unique(codes, return_inverse=True)
        known = np.isin(uniq, self.good, assume_unique=True)
        new = uniq[~known & ~np.isin(uniq, self.bad, assume_unique=True)]
        if len(new):
            fits = np.array([self.merge(self.bytes_of[c // self.n] + self.bytes_of[c % self.n]) == [c // self.n, c % self.n] for c in new.tolist()], bool)
            self.good = np.union1d(self.good, new[fits])
            self.bad = np.union1d(self.bad, new[~fits])
            known = np.isin(uniq, self.good, assume_unique=True)
        return known[back]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new pattern words into the table."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.propose(w) for w in raw]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(ids)), size)
        wrong = np.zeros(len(ids), bool)
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            codes = (flat[:-1] * self.n + flat[1:])[inside]
            if len(codes):
                wrong[owner[1:][inside][~self._test(codes)]] = True
        lone = [t for t in set(flat.tolist()) if not self._alone(t)]
        if lone:
            wrong[owner[np.isin(flat, lone)]] = True
        for i, w in enumerate(words):
            got = self.merge(raw[i]) if wrong[i] else ids[i]
            self.words[w] = np.asarray(got, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each."""
        parts = [_UNIT.findall(t) if t else [] for t in texts]
        if len(self.units) > KEPT_UNITS:
            self.units.clear()
            self.words.clear()
        new = [u for u in set(chain.from_iterable(parts)) if u not in self.units]
        if new:
            cut = [self.fine.findall(u) for u in new]
            unknown = [w for w in set(chain.from_iterable(cut)) if w not in self.words]
            if unknown:
                self.learn(unknown)
            words = self.words.__getitem__
            for u, ws in zip(new, cut):
                self.units[u] = b"".join(map(words, ws))
        unit = self.units.__getitem__
        joined = [b"".join(map(unit, p)) for p in parts]
        offsets = np.zeros(len(joined) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) // 4, out=offsets[1:])
        return np.frombuffer(b"".join(joined), np.int32), offsets


_ENCODERS: dict[str, SpeculativeBpe] = {}


def encoder(path: str) -> SpeculativeBpe:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpeculativeBpe(read_ranks(path))
    return _ENCODERS[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZER_DIR, out: str = "ids") -> DataFrame:
    """Operator: (id, ids) for every row, in one narrow pass; no shuffle, nothing is collected."""
    path = os.path.join(folder, vocabulary)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for s in slices(b, 1000):
                flat, offsets = enc.encode(s.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([s.column(0), ids], [id_col, out])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, {out} array<int>")
