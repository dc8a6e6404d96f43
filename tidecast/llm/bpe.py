"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string exactly one last token is valid: the one that the merges give.  A token t that ends at byte i is
valid there if the last token before it, together with t, is what the merges make of their bytes.  So the table of last tokens
grows byte by byte, a text can be appended to without looking back further than one token, and after an edit only the
table near it changes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import MEMO, cutter, read_ranks


class PrefixEncoder:
    """Tokens, the merge that makes each, and a search for all tokens that end at a byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.seen: dict[tuple[int, int], bool] = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[r] = (r, r)
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i], r), ranks.get(t[i:], r)
                if a < r and b < r and self._stay_apart(a, b, r):
                    self.halves[r] = (a, b)
                    break
        self.seen.clear()
        self.search = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.search.add_word(t.decode("latin-1"), (r, len(t)))
        self.search.make_automaton()

    def _stay_apart(self, a: int, b: int, below: int) -> bool:
        """Whether no merge ranked under ``below`` would have crossed the border between the tokens a and b.

        Merges are undone from the latest on; whenever the two tokens at the border form a token of
        lower rank than the merge undone last, that one would have come first.
        """
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            if joined is not None and joined < below:
                return False
            left, right = self.halves[a][1] != a, self.halves[b][0] != b
            if not left and not right:
                return True
            if left and (a > b or not right):
                below, a = min(below, a), self.halves[a][1]
            else:
                below, b = min(below, b + 1), self.halves[b][0]

    def valid(self, a: int, b: int) -> bool:
        got = self.seen.get((a, b))
        if got is None:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            got = self.seen[a, b] = self._stay_apart(a, b, 1 << 62)
        return got

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Fill ``last`` (last[i]: the last token of data[:i], last[0] unused) up to the end of ``data``."""
        done = len(last) - 1
        base = max(0, done - self.longest)
        last += [-1] * (len(data) - done)
        for end, (t, size) in self.search.iter(data[base:].decode("latin-1")):
            at = base + end + 1
            start = at - size
            if at > done and last[at] < 0 and start >= 0 and (start == 0 or last[start] >= 0 and self.valid(last[start], t)):
                last[at] = t
        return last

    def replace(self, last: list[int], data: bytes, start: int, end: int, new: bytes) -> tuple[list[int], bytes]:
        """Table and bytes after data[start:end] became ``new``; re-encodes from the edit until the table is in step again."""
        now = data[:start] + new + data[end:]
        table, shift, at, equal = last[:start + 1], len(new) - (end - start), start, 0
        while at < len(now):
            step = min(len(now), at + self.longest)
            self.extend(table, now[:step])
            for i in range(at + 1, step + 1):
                equal = equal + 1 if i - shift > end and table[i] == last[i - shift] else 0
            at = step
            if equal >= self.longest:
                return table + last[at - shift + 1:], now
        return table, now

    def tokens(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tokens(self.extend([-1], data))


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = got = np.array(self.encoder.encode(piece.encode("utf-8")), "<u4").tobytes()
        return got


_LOADED: dict[str, _Pieces] = {}


def _loaded(path: str) -> _Pieces:
    """The encoder of a rank file and its memo, loaded once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = _Pieces(PrefixEncoder(read_ranks(path)))
    return _LOADED[path]


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    return b"".join(map(_loaded(path).__getitem__, cutter(pattern)(text or "")))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with ``into``: the ids of the whole text as little-endian unsigned 32-bit integers (binary).

    Every match of ``pattern`` is encoded separately by the ranks at ``path``, without special tokens.  Null and empty
    texts give no ids.  Repeated rows are treated alike; an existing column ``into`` is replaced.  The path must be readable
    on every executor; a worker keeps a bounded memo of pre-tokens it has encoded.
    """
    @F.pandas_udf("binary")
    def ids(texts):
        import pandas as pd
        return pd.Series([encode_text(t, path, pattern) for t in texts], dtype=object)

    return docs.withColumn(into, ids(F.col(text)))


def decode(coded: DataFrame, path: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """``coded`` with ``into``: the bytes that the ids stand for (binary); no ids and null give no bytes."""
    @F.pandas_udf("binary")
    def plain(column):
        import pandas as pd
        table = _decoder(path)
        return pd.Series([b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in column], dtype=object)

    return coded.withColumn(into, plain(F.col(ids)))


_TOKENS: dict[str, list[bytes]] = {}


def _decoder(path: str) -> list[bytes]:
    if path not in _TOKENS:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            table[r] = t
        _TOKENS[path] = table
    return _TOKENS[path]
