import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import audit

from .conftest import ODD, prose


def plain_audit(rows, labels):
    """Straight from the definition; rows are (doc_id, text, lang)."""
    fails = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                      "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows)})
    good, toxic = ({d for d, q, x in labels if d is not None and v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    out = {}
    for part in {p or "" for *_, p in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        made = {}
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if fails[i][f]}
                left -= gone
                share[f] += len(gone)
                alone = sum(fails[i][f] and sum(fails[i].values()) == 1 for i in mine)
                made["".join(order), step] = [len(left), len(gone), sum(fails[i][f] for i in mine) - len(gone), alone,
                                              sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        out |= {(part, *k): (*v, share[k[0][k[1] - 1]]) for k, v in made.items()}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, None, 1), (10, 1, None), (10, 0, 1), (None, 1, 1), (99, 1, 1), (21, 1, 0), (30, 1, 1)]
LOUD = "HELLO # " * 60
ROWS = ([(d, t, s) for d, t, s in ODD] + [(20 + i, prose(i % 4, 120), "ab"[i % 2]) for i in range(8)] + [(30 + i, LOUD, None) for i in range(3)]
        + [(None, LOUD, "a"), (40, prose(9, 150).upper(), "b"), (41, " ".join(f"w{i}" for i in range(200)), "b")])


@pytest.mark.parametrize("bits", [14, 1])
def test_matches_definition(spark, monkeypatch, bits):
    monkeypatch.setattr(audit, "RANGE_BITS", bits)
    got = audit.audit(table(spark, ROWS).repartition(3), labels_of(spark, LABELS)).collect()
    want = plain_audit(ROWS, LABELS)
    assert len(got) == len(want) == 600 * 5
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want


def test_merges_match_sets():
    r = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (3000, 40), (40, 3000), (2000, 2000), (1, 1)):
        a, b = (np.sort(r.choice(9000, k, replace=False)).astype(np.int64) for k in (n, m))
        assert audit.missing(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert np.array_equal(audit.gallop(a, b), np.searchsorted(b, a))
    lists = [np.sort(r.choice(500, k, replace=False)).astype(np.int64) for k in (0, 100, 300, 7)]
    mark = np.arange(0, 500, 3)
    got = audit.union_sizes(lists, [mark])
    for s in range(16):
        u = set().union(*[set(x.tolist()) for i, x in enumerate(lists) if s >> i & 1])
        assert got[s].tolist() == [len(u), len(u & set(mark.tolist()))]


def test_empty_and_clashing(spark):
    none = labels_of(spark, [])
    assert audit.audit(table(spark, []), none).collect() == []
    docs = table(spark, ROWS)
    more = docs.withColumns({c: F.lit("mine") for c in ("number", "part", "digest", "copy", "n", "range", "fails_A", "quality", "toxic", "__apart")})
    key = lambda r: tuple(r)
    assert sorted(map(key, audit.audit(more, none).collect())) == sorted(map(key, audit.audit(docs, none).collect()))


def test_own_filters_without_copies(spark):
    docs = table(spark, [(i, "x" * i, "p") for i in range(20)])
    conditions = {"S": F.length("text") < 5, "L": F.length("text") > 12}
    got = audit.interactions(audit.sizes(audit.postings(docs, conditions=conditions, copies=False)), "SL", ())
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got.collect()} == {
        ("SL", 1): (15, 5, 0, 5, 10), ("SL", 2): (8, 7, 0, 7, 14), ("LS", 1): (13, 7, 0, 7, 14), ("LS", 2): (8, 5, 0, 5, 10)}
