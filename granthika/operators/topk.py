"""Exact top k of a query set against all rows, in Arrow batches: a task keeps the best rows of each query and emits nothing else.

A product in single precision tells which pairs can't be among the best; its error is bounded (MARGIN), and what it lets pass is
worked out again in double in the order of the elements, so that cosines and their ties are those of the expression in SQL.
Rows and queries of other lengths, with nulls or without a finite norm are always worked out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the product at once, and pairs that wait to be worked out.
CELLS, WAITING = 1 << 20, 1 << 20
#: Error of a cell of the product for each element of the vectors.
MARGIN = 2.0**-22


class Vectors:
    """Vectors and norms of a batch in one matrix, padded; `size` is -1 where the vector or one of its elements is null."""

    def __init__(self, vec: pa.Array, norm: pa.Array, width: int | None = None):
        lists = vec.cast(pa.large_list(pa.float64()))
        self.size = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        longest = max(int(self.size.max(initial=0)), width or 0)
        self.x = np.zeros((len(self.size), longest))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(self.size)), np.maximum(self.size, 0))
        start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.x[row, np.arange(len(row)) - start[row]] = flat.to_numpy(zero_copy_only=False)
        if flat.null_count:
            self.size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        self.norm = norm.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
        self.size[norm.is_null().to_numpy(zero_copy_only=False)] = -1
        self.width = int(np.bincount(self.size[self.size >= 0]).argmax()) if width is None and (self.size >= 0).any() else width or 0
        # Lines that the product can judge: of the common length, finite, and no longer than their norm says.
        with np.errstate(all="ignore"):
            unit = self.x[:, : self.width] / self.norm[:, None]
            long = np.sqrt((unit * unit).sum(1)) <= 1.001
        self.plain = (self.size == self.width) & (self.norm > 0) & np.isfinite(self.norm) & long
        self.unit = np.zeros((len(self.size), self.width), np.float32)
        self.unit[self.plain] = unit[self.plain]


def cosines(q: Vectors, r: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs as they are ordered: NaN is the greatest (inf), null the least (-inf)."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(min(q.x.shape[1], r.x.shape[1])):
            total += q.x[a, j] * r.x[b, j]
        c = total / (q.norm[a] * r.norm[b])
    c = np.where(np.isnan(c), np.inf, np.clip(c, -np.finfo(float).max, np.finfo(float).max))
    return np.where((q.size[a] != r.size[b]) | (q.size[a] < 0), -np.inf, c)


class Best:
    """The k best rows of each query so far, by cosine and then by id; equal ids of one cosine are one."""

    def __init__(self, ids: list, queries: Vectors, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.place: dict = {}
        for n, i in enumerate(ids):
            self.place.setdefault(i, []).append(n)
        self.names: list = []
        self.row = np.full((len(ids), k), -1, np.int64)
        self.cosine = np.full((len(ids), k), -np.inf)
        self.margin = (queries.width + 16) * MARGIN

    def add(self, ids: list, r: Vectors) -> None:
        """Rows of a batch, none of whose ids is null."""
        name = self._named(ids)
        spare, n = len(ids) - len(np.unique(name)), len(ids)
        odd = ~r.plain
        own = [(p, k) for k, i in enumerate(ids) for p in self.place.get(i, ())]
        own_q, own_r = (np.array(x, np.int64) for x in (zip(*own) if own else ((), ())))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // max(n, 1))
        for lo in range(0, len(self.ids), step):
            hi = min(lo + step, len(self.ids))
            cell = self.q.unit[lo:hi] @ r.unit.T
            cell[:, odd] = -np.inf
            mine = (own_q >= lo) & (own_q < hi)
            cell[own_q[mine] - lo, own_r[mine]] = -np.inf
            least = np.where(self.row[lo:hi, -1] >= 0, self.cosine[lo:hi, -1] - self.margin, -np.inf)
            kth = self.k + spare
            if n >= kth and (new := np.flatnonzero(np.isneginf(least) & self.q.plain[lo:hi])).size:
                least[new] = np.partition(cell[new], n - kth, axis=1)[:, n - kth] - 2 * self.margin
            near = cell >= least.astype(np.float32)[:, None] - np.float32(self.margin)
            near[:, odd] = True
            near[~self.q.plain[lo:hi]] = True
            near[own_q[mine] - lo, own_r[mine]] = False
            a, b = np.divmod(np.flatnonzero(near), n)
            waiting.append((a + lo, b))
            if sum(len(x) for x, _ in waiting) > WAITING:
                self._merge(waiting, name, r)
                waiting = []
        self._merge(waiting, name, r)

    def _named(self, ids: list) -> np.ndarray:
        """Numbers of the rows' ids; numbers of all that are kept go in the order of the ids."""
        kept = np.unique(self.row[self.row >= 0])
        both = [self.names[i] for i in kept.tolist()] + ids
        order = sorted(range(len(both)), key=both.__getitem__)
        names, number = [], np.zeros(len(both), np.int64)
        for i in order:
            if not names or both[i] != names[-1]:
                names.append(both[i])
            number[i] = len(names) - 1
        self.row = np.where(self.row >= 0, number[np.searchsorted(kept, np.maximum(self.row, 0)).clip(max=max(len(kept) - 1, 0))], -1)
        self.names = names
        return number[len(kept) :]

    def _merge(self, waiting: list, name: np.ndarray, r: Vectors) -> None:
        a, b = (np.concatenate([w[i] for w in waiting]) if waiting else np.zeros(0, np.int64) for i in (0, 1))
        for lo in range(0, len(a), 4 * WAITING):
            self._merged(a[lo : lo + 4 * WAITING], b[lo : lo + 4 * WAITING], name, r)

    def _merged(self, a: np.ndarray, b: np.ndarray, name: np.ndarray, r: Vectors) -> None:
        met = np.unique(a)
        old = self.row[met] >= 0
        q = np.concatenate([np.repeat(met, old.sum(1)), a])
        c = np.concatenate([self.cosine[met][old], cosines(self.q, r, a, b)])
        row = np.concatenate([self.row[met][old], name[b]])
        order = np.lexsort((row, -c, q))
        q, c, row = q[order], c[order], row[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (row[1:] != row[:-1])])
        q, c, row = q[new], c[new], row[new]
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        nth = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        keep = nth < self.k
        self.row[met], self.cosine[met] = -1, -np.inf
        self.row[q[keep], nth[keep]], self.cosine[q[keep], nth[keep]] = row[keep], c[keep]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """(query id, row id, cosine) of what is left."""
        a, k = np.nonzero(self.row >= 0)
        query, name = pa.array(self.ids, schema.field(0).type), pa.array(self.names, schema.field(1).type)
        for lo in range(0, len(a), 20_000):
            q, c = a[lo : lo + 20_000], self.cosine[a[lo : lo + 20_000], k[lo : lo + 20_000]]
            cosine = pa.array(np.where(np.isposinf(c), np.nan, c), mask=np.isneginf(c))
            yield pa.RecordBatch.from_arrays([query.take(pa.array(q)), name.take(pa.array(self.row[q, k[lo : lo + 20_000]])), cosine], schema=schema)
