"""Arrow operators for what expressions can't state: embeddings, query segments with offsets, token-preserving translation."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_NE, _EN = re.compile("[ऀ-ॿ\\s]+"), re.compile("[a-zA-Z\\s\\-]+")
_MASK = re.compile(r"\[\[[^\]]*\]\]|\[EN\]|\d+(?:[.,]\d+)*|`[^`]*`")


def hashed_embedding(dim: int = 64):
    """M1: deterministic embedding of words by signed hashing, unit length; a model can take its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float64)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed


def composed():
    """Texts in composed form (NFC), in Arrow batches."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return nfc


def query_segments():
    """Runs of each script with offsets; a Latin run counts where it has more than two characters and meets no Devanagari run."""

    @F.pandas_udf("array<struct<text: string, language: string, start: int, end: int, confidence: double>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            ne = [(m[0].strip(), "ne", m.start(), m.end(), 0.9) for m in _NE.finditer(t or "") if m[0].strip()]
            en = [(m[0].strip(), "en", m.start(), m.end(), 0.8) for m in _EN.finditer(t or "") if len(m[0].strip()) > 2 and not any(m.start() < b and a < m.end() for _, _, a, b, _ in ne)]
            return [dict(zip(("text", "language", "start", "end", "confidence"), x)) for x in sorted(ne + en, key=lambda x: x[2])]

        return texts.map(one)

    return cut


def translate(table: dict[str, str]):
    """Word by word from a dictionary; citation tokens, numbers and code stay as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            kept: list[str] = []

            def hide(m):
                kept.append(m[0])
                return f"\x00{len(kept) - 1}\x00"

            words = re.split(r"(\s+)", _MASK.sub(hide, t))
            done = "".join(table.get(w.strip(".,;:!?।").lower(), w) if w and not w.isspace() and "\x00" not in w else w for w in words)
            return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], done)

        return texts.map(one)

    return run
