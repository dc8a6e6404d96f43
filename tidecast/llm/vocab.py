"""Vocabularies of byte-level BPE and how texts are cut before merging."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import regex

#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only (ASCII, Latin letters) are cut by the same rule written with plain ranges, which is much faster.
LATIN = re.compile(r"[\t\n\r -~\u00c0-\u024f]*")
_LATIN_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9]+"
                           "| ?[^\\sA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|\\s+(?!\\S)|\\s+").findall
#: Entries that a worker's memo of seen pieces may hold; it is emptied when full.
MEMO = 400_000
#: Characters of text that are cut into pieces at a time, unless one text is longer.
SLICE = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest counts up from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Vocabulary and merges, in order, of a byte-level BPE model in a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = byte_alphabet()
    plain = lambda s: bytes(byte[c] for c in s)
    vocab = {plain(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    merges = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return vocab, merges


@lru_cache(4)
def cutter(pattern: str):
    """A function from a text to the matches of ``pattern``."""
    find = regex.compile(pattern).findall
    if pattern != PATTERN:
        return find
    return lambda text: _LATIN_PIECES(text) if LATIN.fullmatch(text) else find(text)


def slices(texts: list[str]):
    """Runs of texts of at most ``SLICE`` characters together, or one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > SLICE:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
