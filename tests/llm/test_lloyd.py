import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import lloyd

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=16, rounds=3):
    kept = []
    for i, v, _ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    h = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((h(i), v) for i, v in kept if i is not None))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        held = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, held) if c == n]
            if mine:
                centres[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept] if centres else []
    total = sum(d for _, d, _ in last)
    return [(i, c, d, sum(y for _, y, z in last if z == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in last]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def some(n, seed=1, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, scale) + (i % 5) for _ in range(64)], i) for i in range(n)]


@pytest.mark.parametrize("rows", [some(200), some(7), [(1, [0.5] * 64, 0)] * 40 + some(30, 2), some(60, 3, 1000.0)], ids=["many", "few", "copies", "large"])
def test_matches_plain(spark, monkeypatch, rows):
    monkeypatch.setattr(lloyd, "ROWS", 50)
    got = lloyd.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert order(got) == order(plain(rows))


def test_odd_vectors(spark):
    good = some(20)
    odd = [(100, None, 0), (101, [1.0] * 63, 0), (102, [1.0] * 65, 0), (103, [float("nan")] + [0.0] * 63, 0), (104, [float("inf")] + [0.0] * 63, 0), (105, [None] + [0.0] * 63, 0),
           (106, [], 0), (None, [0.25] * 64, 0), (None, None, None), (3, [0.1] * 64, 1)]
    docs = spark.createDataFrame(good + odd, SCHEMA)
    want = order(plain(good + odd))
    assert order(lloyd.cluster(docs).collect()) == want and len(want) == 22
    more = docs.withColumns({c: F.lit(1) for c in ("cluster", "distance", "block", "record", "x", "inertia")})
    assert order(lloyd.cluster(more).collect()) == want


def test_empty(spark):
    assert lloyd.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert lloyd.cluster(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_salted_slices(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(lloyd, "SALTS", 3)
    rows = some(40)
    assert order(lloyd.cluster(spark.createDataFrame(rows, SCHEMA), k=5, width=20).collect()) == order(plain(rows, 5))


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        lloyd.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)).collect()


def test_packing_and_products():
    for a in (np.array([[0, 255]]), np.array([[-1, 300]]), np.array([[-(1 << 40), 1 << 40]]), np.zeros((0, 2), np.int64), np.array([[-5, 200]])):
        assert np.array_equal(lloyd.unpack(lloyd.pack(a), 2), a)
    r = np.random.default_rng(1)
    x, c = r.integers(-(1 << 27), 1 << 27, (20, 16)), r.integers(-(1 << 27), 1 << 27, (3, 16))
    assert lloyd.products(x, c).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in c] for a in x]
