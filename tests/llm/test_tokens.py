"""Token operators against the libraries."""
import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecast.llm import bpe, counts, packing

from .conftest import ODD, prose

MULTI, JSON, WORD = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [t or "" for _, t, *_ in ODD] + ["a \n \n b", "  a  b ", "a\n ", "x\t y   z", "<|endoftext|> hi <|endoftext|><|endoftext|>", "it's  we'll   x", "été \x1c \x1d x",
                                         "aaaa" * 500, "ab" * 3000, " " * 1000, "naïve    word", "<|startoftext|>  <|ENDOFTEXT|>", "İstanbul ΑΣ é"]


def noise(seed, n):
    r = random.Random(seed)
    return ["".join(chr(r.choice([r.randint(32, 126), r.randint(0, 0x2fff), r.randint(0x4e00, 0xd000), 32, 32, 10])) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_match_the_library(docs_of, reference):
    texts = TEXTS + noise(1, 300)
    coded = bpe.decode(bpe.encode(docs_of(list(enumerate(texts))), MULTI, P.PATTERN), MULTI)
    for r in coded.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["bytes"]) == texts[r["doc_id"]].encode()


def test_any_bytes_have_the_librarys_tokens(reference):
    encoder = bpe._loaded(MULTI).encoder
    r = random.Random(2)
    vocabulary = list(encoder.ranks)
    for i in range(3000):
        data = b"".join(r.choice(vocabulary) for _ in range(r.randint(1, 6))) if i % 2 else bytes(r.randrange(256) for _ in range(r.randint(1, 30)))
        assert encoder.encode(data) == reference._core_bpe.encode_single_piece(data)


def test_appends_and_edits_keep_the_table_right():
    encoder = bpe._loaded(MULTI).encoder
    r = random.Random(3)
    letters = lambda n: bytes(r.choice(b"abcdefgh tion") for _ in range(n))
    for _ in range(100):
        data = letters(400)
        table = encoder.extend([-1], data)
        more = data + letters(30)
        assert encoder.tokens(encoder.extend(list(table), more)) == encoder.encode(more)
        a = r.randint(0, 380)
        fresh, now = encoder.replace(table, data, a, a + r.randint(0, 20), letters(r.randint(0, 20)))
        assert encoder.tokens(fresh) == encoder.encode(now)


def test_counts_match_the_library(docs_of):
    texts = TEXTS + noise(4, 500)
    library = Tokenizer.from_file(JSON)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(docs_of(list(enumerate(texts))), JSON).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_ragged_merging_goes_in_rounds():
    table = counts.ByteCounts(JSON)
    library = Tokenizer.from_file(JSON)
    words = ["aaaaaaa", "banana", " unbelievable", "x"]
    assert table.count([w.encode() for w in words]).tolist() == [len(library.encode(w).ids) for w in words]


def test_pieces_hold_every_id_once(docs_of):
    texts = TEXTS + noise(5, 200) + [prose(i, 50 + i) for i in range(120)]
    docs = docs_of(list(enumerate(texts)))
    library = Tokenizer.from_file(WORD)
    want = {i: [*e.ids, 2] for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    rows = packing.pack(docs, WORD, window=512, shard_tokens=6000).collect()
    of, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]]) and zlib.crc32(r["ids"])
        of.setdefault(r["doc_id"], []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, pieces in of.items():
        assert [x for start, ids in sorted(pieces) for x in ids] == want[d]
        assert all(a + len(x) == b for (a, x), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    assert of.keys() == want.keys()
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        sizes.append(at)
    assert sum(s < 512 for s in sizes) <= -(-sum(map(len, want.values())) // 6000) + 33


def test_seeds_take_their_nearest_neighbours():
    r = np.random.default_rng(1)
    topics = [r.choice(1000, 40, replace=False) + 1000 * k for k in range(4)]
    docs = [r.choice(topics[i % 4], 100).astype(np.uint16) for i in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=5000)
    idf = np.log1p((40 - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = packing.Index(docs, idf, 100.0)
    together = {}
    for i, _, n, q, _ in packing.fill_windows(docs, index, 500):
        together.setdefault(q, []).append(i % 4)
    assert sum(len(set(t)) == 1 for t in together.values()) >= 6
    brute = np.array([sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / 100)) for t, f in zip(*np.unique(d, return_counts=True)) if t in set(docs[0].tolist())) for d in docs])
    top = index.scores(0)
    assert set(np.argsort(-top)[:8].tolist()) <= set(np.argsort(-brute)[:12].tolist())


def test_neighbours_meet_over_several_shards(docs_of):
    topics = {k: [f"{a}{b}{k}" for a, b in zip("harbour lantern quarry meadow copper violin saddle orchard".split(), "abcdefgh")] for k in "qwxyzjkv"}
    rows = [(i, f"{prose(i, 60)} " + " ".join([*topics["qwxyzjkv"[i % 8]]] * 4)) for i in range(160)]
    pieces = packing.pack(docs_of(rows), P.path("word_bpe_49k.json"), window=1024, shard_tokens=8000).collect()
    assert sorted({p["doc_id"] for p in pieces}) == list(range(160))
    together = {}
    for p in pieces:
        together.setdefault(p["sequence_id"], set()).add(p["doc_id"])
    same = [a % 8 == b % 8 for s in together.values() for a in s for b in s if a < b]
    assert len({p["sequence_id"] >> 40 for p in pieces}) > 3 and sum(same) > 0.6 * len(same)


def test_hot_leading_ids_are_split_by_size():
    first, many, n = packing.deal({3: 10, 5: 950, 7: 60, 9: 60}, 100)
    assert (first[3], many[3], first[5], many[5], first[7], first[9], n) == (0, 1, 1, 10, 11, 12, 13)
