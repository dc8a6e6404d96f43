"""Rank-synchronous BPE merging of many sequences held as one ragged array."""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int64).max


class MergeTable:
    """Merges (left, right, made) in the order of their ranks, searched as one sorted array of pairs."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        left, right, made = np.array(merges, np.int64).T
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NEVER) of every pair, and what it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER), self.made[at]

    def merge(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, owner) when no sequence has a mergeable pair any more; owner (rising) tells whose a symbol is.

        Every round merges, in each sequence, all places of its lowest-ranked pair at once (from the left where
        they overlap); ranks are looked up again only next to a merge.  Sequences without a mergeable pair leave
        the array.
        """
        symbol = symbol.copy()
        done = [[], []]
        rank = made = None
        while len(symbol):
            if rank is None:
                rank, made = self.look_up(symbol, np.r_[symbol[1:], 0])
                rank[np.r_[owner[:-1] != owner[1:], True]] = NEVER
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[begin, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(rank, begin), length)
            open_ = lowest != NEVER
            if not open_.all():
                done[0].append(symbol[~open_])
                done[1].append(owner[~open_])
                symbol, owner, rank, made, lowest = symbol[open_], owner[open_], rank[open_], made[open_], lowest[open_]
                if not len(symbol):
                    break
            where = np.flatnonzero(rank == lowest)
            run = np.flatnonzero(np.r_[True, np.diff(where) != 1])
            odd = (np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))) & 1
            where = where[odd == 0]
            symbol[where] = made[where]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            fresh = np.zeros(len(symbol), bool)
            fresh[where] = True
            symbol, owner, rank, made, fresh = symbol[keep], owner[keep], rank[keep], made[keep], fresh[keep]
            near = np.flatnonzero(fresh | np.r_[fresh[1:], False])
            after = np.minimum(near + 1, len(symbol) - 1)
            rank[near], made[near] = self.look_up(symbol[near], symbol[after])
            rank[near[(owner[near] != owner[after]) | (after == near)]] = NEVER
        symbol, owner = np.concatenate(done[0] or [symbol]), np.concatenate(done[1] or [owner])
        order = np.argsort(owner, kind="stable")
        return symbol[order], owner[order]
