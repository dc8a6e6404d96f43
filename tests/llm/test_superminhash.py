import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import superminhash as S

from .conftest import ODD, clash, prose
from .test_simhash import plain_components


def plain_set(text, k=2):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def plain(rows):
    sets = {i: plain_set(t) for i, t in rows}
    comp = plain_components({i: s for i, s in sets.items() if s}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    return {i: (len(s), comp.get(i, i), comp.get(i, i) == i) for i, s in sets.items()}


def plain_signature(elements, places):
    """One element after the other, with the definition's early stop."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    sig = [mask] * places
    for e in elements:
        order = list(range(places))
        for j in range(places):
            if max(sig) < j << 32:
                break
            d = mix((e + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + ((d & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            sig[order[j]] = min(sig[order[j]], j << 32 | d >> 32)
    return sig


def near_copies(seed, n, words=120, edits=8):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_signatures_follow_the_definition():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (1, 2, 7, 40, 400, 0, 3)]
    sig = S.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), 32)
    assert [row.tolist() for row in sig] == [plain_signature([int(x) for x in s], 32) for s in sets]


def test_estimates_are_close_and_vary_less():
    r = np.random.default_rng(5)
    errors = []
    for _ in range(150):
        both, own = r.integers(0, 1 << 63, 80, dtype=np.uint64), r.integers(0, 1 << 63, 40, dtype=np.uint64)
        a, b = np.r_[both, own[:20]], np.r_[both, own[20:]]
        sig = S.signatures(np.r_[a, b], np.repeat([0, 1], 100), 2)
        errors.append((sig[0] == sig[1]).mean() - 80 / 120)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < (80 / 120) * (40 / 120) / S.PLACES


def test_matches_all_pairs(docs_of):
    texts = [t for s in range(8) for t in near_copies(s, 12)] + ["a b c d e f", "a b c d e g", "a b c d e f g", "One", "one", "ONE two", prose(70, 3)]
    rows = list(enumerate(texts, 5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in S.near_duplicates(docs_of(rows)).collect()}
    assert got == plain(rows)
    assert len({c for _, c, _ in got.values()}) < len(rows) - 20


def test_links_that_the_first_member_misses(docs_of, monkeypatch):
    """Members that are near each other but not near a bucket's first one are compared too, in whole and in split buckets."""
    texts = []
    for s in range(12):
        base = prose(s, 100).split()
        for i in range(6):  # parts drift away from the base and from each other
            w = list(base)
            for j in range(i * 5):
                w[(j * 7 + i) % 100] = f"new{s}x{i // 2}x{j}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = plain(rows)
    for block in (2048, 2):
        monkeypatch.setattr(S, "BLOCK", block)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in S.near_duplicates(docs_of(rows)).collect()} == want


def test_parted_buckets_find_the_missing_links(spark, monkeypatch):
    """With labels that joined nothing, the buckets join what all pairs join, whole or in blocks."""
    known, texts = S.Words(), near_copies(3, 20, edits=20) + near_copies(4, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = S.sketches(docs).withColumn("node", F.col("doc_id"))
    labelled = nodes.select("node", "n", "sig", "keys", F.col("node").alias("label"))
    met, rows = S.met_in_buckets(nodes.select("node", "n", F.explode("keys").alias("key")), len(texts) * S.BANDS)
    want = plain_components({i: frozenset(S.shingle_hashes(t, 2, known).tolist()) for i, t in enumerate(texts)}, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    sets = nodes.select("node", "doc_id", "d1", "d2").transform(lambda n: S.hash_sets(docs, n, 2))
    for block in (2048, 3):
        monkeypatch.setattr(S, "BLOCK", block)
        partners = S.possible_partners(met, rows, labelled, 80)
        links = [tuple(r) for r in S.links_of_partners(partners, labelled, sets, 80).collect()]
        of = [plain_set(t) for t in texts]
        assert links and all(100 * len(of[u] & of[v]) >= 80 * len(of[u] | of[v]) for u, v in links)
        joined = plain_components(dict(enumerate(range(len(texts)))), lambda a, b: (a, b) in links or (b, a) in links)
        assert joined == want


def test_hubs_are_dealt(spark, monkeypatch):
    known = S.Words()
    texts = near_copies(1, 400, edits=3)
    sets = spark.createDataFrame([(i, bytearray(S.shingle_hashes(t, 2, known).tobytes())) for i, t in enumerate(texts)], "node bigint, hashes binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 400)], "u bigint, v bigint")
    got = sorted(r["v"] for r in S.verified(pairs, sets, 80).collect())
    of = [plain_set(t) for t in texts]
    assert got == [i for i in range(1, 400) if 100 * len(of[0] & of[i]) >= 80 * len(of[0] | of[i])]


def test_odd_rows(spark, docs_of):
    rows = ODD + [(12, "x", "a"), (None, prose(1, 60), "a")]
    plain_rows = S.near_duplicates(docs_of(rows)).collect()
    assert sorted(map(repr, plain_rows)) == sorted(map(repr, S.near_duplicates(clash(spark, docs_of(rows))).collect()))
    of = {}
    for r in plain_rows:
        of.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert of[1] == [(1, True)] * 2 and of[2] == [(1, False)] and of[3] == [(3, True)] and of[4] == [(4, True)] and of[6] == [(6, True)] and of[12] == [(6, False)]
    assert sorted(of[None], key=repr) == [(1, False), (None, True), (None, True)]
    assert S.near_duplicates(docs_of([])).collect() == []
