"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import MergeTable
from .vocab import MEMO, PATTERN, cutter, read_merges, slices

SYMBOLS = 1 << 20
PIECES = cutter(PATTERN)


class ByteCounts:
    """Token counts of byte strings."""

    def __init__(self, path: str):
        vocab, merges = read_merges(path)
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.table = MergeTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])

    def count(self, pieces: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        _, owner = self.table.merge(self.single[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), size))
        return np.bincount(owner, minlength=len(pieces))


_LOADED: dict[str, tuple[ByteCounts, dict[str, int]]] = {}


def count_texts(texts: list[str], path: str, special: str | None = None) -> list[int]:
    """Token counts of a batch of texts; ``special`` counts as one token wherever it stands.

    The pre-tokens of the batch that the worker's memo does not have are counted together, as ragged arrays.
    """
    if path not in _LOADED:
        _LOADED[path] = ByteCounts(path), {}
    table, known = _LOADED[path]
    if len(known) > MEMO:
        known.clear()
    cut, out = [], []
    for t in texts:
        stretches = t.split(special) if special and special in t else [t]
        out.append(len(stretches) - 1)
        cut.append(PIECES(stretches[0]) if len(stretches) == 1 else [m for s in stretches for m in PIECES(s)])
    fresh = list(set().union(*cut) - known.keys())
    coded = [m.encode("utf-8") for m in fresh]
    at = 0
    while at < len(fresh):
        to, room = at, 0
        while to < len(fresh) and (to == at or room + len(coded[to]) <= SYMBOLS):
            room += len(coded[to])
            to += 1
        known.update(zip(fresh[at:to], table.count(coded[at:to]).tolist()))
        at = to
    return [n + sum(map(known.__getitem__, c)) for n, c in zip(out, cut)]


def count_tokens(docs: DataFrame, path: str, text: str = "text", special: str | None = "<|endoftext|>", into: str = "n_tokens") -> DataFrame:
    """``docs`` with ``into``: the number of tokens of the whole text by the JSON tokenizer at ``path`` (bigint).

    The special string inside a text is one token, as the tokenizer's library has it by default; nothing is
    added, cut or padded.  Null and empty texts have 0 tokens.  Repeated rows are treated alike; an existing column
    ``into`` is replaced.  Workers keep bounded memos of counted pre-tokens.
    """
    @F.pandas_udf("bigint")
    def counted(texts):
        import pandas as pd
        return pd.Series([n for run in slices([t or "" for t in texts]) for n in count_texts(run, path, special)], dtype="int64")

    return docs.withColumn(into, counted(F.col(text)))
