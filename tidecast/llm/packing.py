"""Packing of token sequences by lexical retrieval.

Documents are dealt to shards of bounded size by their heaviest id, so that neighbours meet.  Each shard has a BM25 inverted index over token ids, with document frequencies of
the whole corpus.  A seed document asks it for its nearest unused neighbours, which fill the seed's window one after the other;
what does not fit any more is cut and seeds the next window.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import MergeTable
from .store import written
from .vocab import MEMO, byte_alphabet, slices

K1, B = 1.2, 0.75
QUERY_TERMS = 24
SHARD_TOKENS = 2_000_000

#: Texts of these characters are lower-cased and cut here; the library does all others.  Each of the characters is its own
#: normal form, and lower case changes it alone.
PLAIN = re.compile(r"[\t\n\r -~\u00c0-\u012f\u0132-\u0148\u014a-\u017e]*")
#: Fixed value: how the word vocabulary cuts lower-case text, for those characters.
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+")
ALPHABET = {b: c for c, b in byte_alphabet().items()}


class WordTokenizer:
    """Ids of texts as the library gives them, remembered by piece.

    Unseen pieces of a batch are merged together as ragged arrays.  Texts beyond ``PLAIN``, and those with a special string, are
    cut at spaces (which the tokenizer drops) and go through the library.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        self.library, self.kind = Tokenizer.from_file(path), kind
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        vocab, suffix = loaded["model"]["vocab"], loaded["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"]]
        self.table = MergeTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.inner = np.array([vocab[ALPHABET[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[ALPHABET[b] + suffix] for b in range(256)], np.int64)
        self.special = [t["content"] for t in loaded["added_tokens"]]
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        raw = [x.encode("utf-8") for x in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        end = np.cumsum(size) - 1
        symbol[end] = self.last[data[end]]
        symbol, owner = self.table.merge(symbol, np.repeat(np.arange(len(raw)), size))
        ids, cuts = symbol.astype(self.kind).tobytes(), np.searchsorted(owner, np.arange(len(raw) + 1)) * np.dtype(self.kind).itemsize
        self.pieces.update(zip(new, (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))))

    def learn_parts(self, new: list[str]) -> None:
        for at in range(0, len(new), 10_000):
            some = new[at:at + 10_000]
            for p, e in zip(some, self.library.encode_batch(some, add_special_tokens=False)):
                self.parts[p] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Packed ids of every text and the end id."""
        for memo in (self.parts, self.pieces):
            if len(memo) > MEMO:
                memo.clear()
        plain = [PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        cut = [PIECES.findall(t.lower()) if p else t.split(" ") for t, p in zip(texts, plain)]
        self.learn(list(set().union(*(c for c, p in zip(cut, plain) if p)) - self.pieces.keys()))
        self.learn_parts(list(set().union(*(c for c, p in zip(cut, plain) if not p)) - self.parts.keys()))
        last = np.array([end], self.kind).tobytes()
        return [b"".join(map((self.pieces if p else self.parts).__getitem__, c)) + last for c, p in zip(cut, plain)]


_LOADED: dict[tuple[str, str], WordTokenizer] = {}


def token_ids(texts: list[str], path: str, end: int, kind: str) -> list[bytes]:
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = WordTokenizer(path, kind)
    return _LOADED[path, kind].encode(texts, end)


def tokenize(docs: DataFrame, path: str, end: int, kind: str, text: str = "text") -> DataFrame:
    """(doc_id, ids): packed ids of the whole text and the end id; null texts count as empty."""
    def run(batches):
        for batch in batches:
            ids = []
            for some in slices([t or "" for t in batch.column(1).to_pylist()]):
                ids += token_ids(some, path, end, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "doc_id bigint, ids binary")


def document_frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How many documents have each id: counted in every task, summed by id; as many rows as the vocabulary has reach the driver."""
    def run(batches):
        df, seen = np.zeros(size, np.int64), np.zeros(size, bool)
        for batch in batches:
            for x in batch.column(0):
                seen[np.frombuffer(x.as_buffer(), kind)] = True
                own = np.flatnonzero(seen)
                df[own] += 1
                seen[own] = False
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def leading_ids(docs: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The id of the largest weight, by ``weight`` and its count, of each sequence of ids (the smallest of equals)."""
    size = np.array([len(d) for d in docs], np.int64)
    key = np.sort((np.repeat(np.arange(len(docs)), size) << 32) | np.concatenate(docs).astype(np.int64))
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    f = np.diff(np.r_[start, len(key)])
    owner, term = key[start] >> 32, key[start] & 0xFFFFFFFF
    w = weight[term] * f / (f + K1)
    cut = np.searchsorted(owner, np.arange(len(docs)))
    best = np.flatnonzero(w == np.maximum.reduceat(w, cut)[owner])
    return term[best[np.searchsorted(owner[best], np.arange(len(docs)))]]


def deal(amounts: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard, number of shards) by leading id, and the number of all shards, for the tokens ``amounts`` of each leading id.

    Ids in rising order fill a shard up to ``limit`` tokens; an id with more has shards of its own, as many as its tokens need.
    """
    first, many = np.zeros(max(amounts, default=0) + 1, np.int64), np.ones(max(amounts, default=0) + 1, np.int64)
    shard, have = 0, 0
    for term in sorted(amounts):
        n = amounts[term]
        if have and have + n > limit:
            shard, have = shard + 1, 0
        first[term], many[term] = shard, max(1, -(-n // limit))
        if many[term] > 1:
            shard, have = shard + int(many[term]), 0
        else:
            have += n
    return first, many, shard + (have > 0)


class Index:
    """BM25 postings of one shard: for each id the documents that have it and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(d) for d in docs], np.int64)
        key = np.sort((np.repeat(np.arange(len(docs)), size) << 32) | np.concatenate(docs).astype(np.int64))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        f = np.diff(np.r_[first, len(key)])
        owner, term = (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32)
        weight = (idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[owner] / mean))).astype(np.float32)
        cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
        self.of = [(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document of the shard for the heaviest ids of document i."""
        t, w = self.of[i]
        if len(t) > QUERY_TERMS:
            t = t[np.argpartition(w, -QUERY_TERMS)[-QUERY_TERMS:]]
        runs = [slice(self.start[x], self.start[x + 1]) for x in t.tolist()]
        return np.bincount(np.concatenate([self.owner[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), self.n)


def fill_windows(docs: list[np.ndarray], index: Index, window: int):
    """Pieces (document, start, length, sequence, offset): every id of every document in exactly one piece.

    Whole windows of long documents go first.  Then each seed takes its neighbours by falling score, the last one cut
    at the window's end; the cut document, or else the first one left, is the next seed.  Only the last sequence is short.
    """
    pieces, sequence = [], 0
    begin = np.zeros(len(docs), np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    for i in np.flatnonzero(size >= window).tolist():
        while size[i] - begin[i] >= window:
            pieces.append((i, int(begin[i]), window, sequence, 0))
            begin[i] += window
            sequence += 1
    left = size - begin
    unused = left > 0
    seed, first = -1, 0
    while True:
        if seed < 0 or not unused[seed]:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return pieces
            seed = first
        score = index.scores(seed)
        score[~unused] = -1
        score[seed] = np.inf
        offset, seed = 0, -1
        few = min(64, len(score))
        near = np.argpartition(-score, few - 1)[:few]
        near = near[np.argsort(-score[near], kind="stable")]
        rest = None
        at = 0
        while offset < window:
            if at == len(near):
                if rest is not None:
                    break
                rest = near = np.argsort(-np.where(unused, score, -2), kind="stable")[:int(unused.sum())]
                at = 0
                continue
            i = int(near[at])
            at += 1
            if not unused[i]:
                continue
            n = int(min(left[i], window - offset))
            pieces.append((i, int(begin[i]), n, sequence, offset))
            begin[i] += n
            left[i] -= n
            offset += n
            unused[i] = left[i] > 0
            if unused[i]:
                seed = i
        sequence += 1


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): pieces of documents in sequences of at most ``window`` tokens.

    ids (binary) are the piece's ids as little-endian unsigned 32-bit integers; start counts the document's ids before it.
    A document has the ids of its whole text (null: empty) and the end id, so every row is in at least one piece, and
    repeated rows as often as they are.  Only the last sequence of a shard may be shorter than the window.  Tokens are written once
    to the shared folder; the shards do not depend on the cluster; a task holds one shard of about ``shard_tokens`` tokens, or one longer document.
    An empty table gives an empty table.
    """
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    width = int(kind[2])
    tokens = written(tokenize(docs, path, end, kind, text))
    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ids")).alias("b")).head()
    n, amount = total["n"], (total["b"] or 0) // width
    shards = max(1, -(-amount // shard_tokens))
    df = document_frequencies(tokens, size, kind)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = amount / max(n, 1)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    limit = max(1, -(-amount // shards))
    weight = np.where(df < 2, 0, idf)

    def led(batch, column):
        """Runs of about 2^18 tokens of a batch: the first row, the sequences and their leading ids."""
        held, have, begin = [], 0, 0
        for i, x in enumerate(batch.column(column)):
            held.append(np.frombuffer(x.as_buffer(), kind))
            have += len(held[-1])
            if have >= 1 << 18 or i + 1 == batch.num_rows:
                yield begin, held, leading_ids(held, weight)
                held, have, begin = [], 0, i + 1

    def count(batches):
        got = np.zeros(size, np.int64)
        for batch in batches:
            for _, ids, term in led(batch, 0):
                np.add.at(got, term, [len(x) for x in ids])
        has = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(got[has])], names=["term", "n"])

    counted = tokens.select("ids").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    first, many, shards = deal({r["term"]: r["n"] for r in counted}, limit)
    parts = max(1, shards)

    def place(batches):
        for batch in batches:
            for begin, ids, term in led(batch, 2):
                some = batch.slice(begin, len(ids))
                shard = first[term] + np.asarray(some.column(0)) % many[term]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), some.column(1), some.column(2)], names=["part", "doc_id", "ids"])

    def packed(part, ids_of, base):
        docs = [np.frombuffer(x, kind) for _, x in ids_of]
        found = fill_windows(docs, Index(docs, idf, mean), window)
        rows = [(ids_of[i][0], s, m, docs[i][s:s + m].astype("<u4").tobytes(), len(docs[i]), (part << 40) + base + q, o) for i, s, m, q, o in found]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 2000]), types)], names=names)
        return base + found[-1][3] + 1

    def run(batches):
        held, have, base, part = [], 0, 0, 0
        for batch in batches:
            for p, d, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = p
                if held and have + len(x) // width > 1.5 * limit:
                    base = yield from packed(part, held, base)
                    held, have = [], 0
                held.append((d, x))
                have += len(x) // width
        if held:
            yield from packed(part, held, base)

    spread = F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.lit(1 << 31))
    dealt = (tokens.select(spread.alias("h"), "doc_id", "ids").mapInArrow(place, "part int, doc_id bigint, ids binary")
             .repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "ids"))
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
