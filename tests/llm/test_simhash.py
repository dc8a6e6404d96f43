import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from tidecast.llm import graph, simhash

from .conftest import prose


def plain_fingerprint(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, near):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(items)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if comp[i] != comp[j] and near(items[i], items[j]):
                    low, high = sorted((comp[i], comp[j]))
                    comp = {k: low if c == high else c for k, c in comp.items()}
                    changed = True
    return comp


def edited(seed, n):
    base = prose(seed, 200).split()
    out = []
    for i in range(n):
        w = list(base)
        if i:
            w[random.Random(seed * 100 + i).randrange(200)] = f"edit{i}"
        out.append(" ".join(w))
    return out


def test_matches_all_pairs(docs_of):
    texts = [t for s in range(6) for t in edited(s, 8)] + ["", None, "A b", "a  B", "one", prose(50, 30), prose(51, 3)]
    rows = list(enumerate(texts, 10))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fps = {i: plain_fingerprint(t, 4) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: format(f, "016x") for i, f in fps.items()}
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows) - 5


def test_long_text_goes_in_blocks():
    text = prose(9, simhash.BLOCK + 50)
    assert simhash.fingerprint(text, 4, 42)[0] == plain_fingerprint(text, 4)


def test_anchors_cover_every_pair():
    r = np.random.default_rng(5)
    for threshold in (1, 2, 3, 4, 6, 8):
        x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(64, threshold, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        def sent(v):  # noqa: E306
            out = {}
            for row, key, home in zip(*simhash.anchor_keys(v, threshold)):
                out.setdefault(row, {})[key] = home
            return out
        a, b = sent(x), sent(y)
        assert all(any(a[i][k] or b[i][k] for k in a[i].keys() & b[i].keys()) for i in range(len(x))), threshold


def test_forest_of_a_dense_group_is_small():
    n = 3000
    fp = np.uint64(12345) ^ (np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)) ^ np.uint64(0)
    node = np.arange(n)[::-1].copy()
    u, v = simhash.group_forest(np.zeros(n, np.int64), np.ones(n, bool), fp, fp, node, 4, 0)
    assert len(u) == n - 1 and set(u.tolist()) == {0}


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)}


def test_components_across_blocks(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(2000 + i, 2001 + i) for i in range(64)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    near = {frozenset(e) for e in edges}
    want = plain_components({x: x for x in nodes}, lambda a, b: frozenset((a, b)) in near)
    monkeypatch.setattr(graph, "BLOCK", 5)
    got = graph.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)
    stars = list(graph._stars(iter([pa.RecordBatch.from_arrays([pa.array([9, 7, 3]), pa.array([7, 3, 1])], names=["u", "v"])])))
    assert [b.to_pydict() for b in stars] == [{"u": [3, 7, 9], "v": [1, 1, 1]}]


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs_whatever_the_groups(spark, docs_of):
    # each job leaves its plan, code and counts with the driver
    rows = list(enumerate([t for s in range(4) for t in edited(80 + s, 12)] + [prose(900 + s, 60) for s in range(20)], 1))
    kept, jobs = jobs_of(spark, "near copies", lambda: simhash.drop_near_duplicates(docs_of(rows)).collect())
    assert len(kept) == 24 and jobs <= 70
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "u bigint, v bigint")
    got, jobs = jobs_of(spark, "path", lambda: graph.components(path).collect())
    assert {r["component"] for r in got} == {0} and jobs <= 20


def test_drop_keeps_one_row_of_a_repeated_id(docs_of):
    a, b = prose(61, 200), spoiled(61, 200, 2)
    kept = simhash.drop_near_duplicates(docs_of([(1, a), (1, b), (1, a), (2, b), (None, a), (None, prose(62, 90)), (None, prose(62, 90))])).collect()
    assert sorted((r["doc_id"] is None, r["text"] in (a, b)) for r in kept) == [(False, True), (True, False)]


def test_drop_keeps_the_smallest_of_a_group(docs_of):
    base = prose(3, 300)
    near = " ".join(["changed"] + base.split()[1:])
    rows = [(5, base), (3, near), (9, base), (9, base), (1, prose(4, 300)), (None, base), (None, prose(8, 50)), (None, prose(8, 50)), (2, ""), (4, None)]
    kept = simhash.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 1), (False, 2), (False, 3), (True, None)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def spoiled(seed, n, edits):
    w = prose(seed, n).split()
    for e, i in enumerate(random.Random(seed).sample(range(n), edits)):
        w[i] = f"edit{seed}x{e}"
    return " ".join(w)


def test_drop_decides_by_the_jaccard_of_shingles(docs_of):
    texts = []
    for s in range(120):                                   # likeness 0.7 to 0.95 around the limit
        texts += [prose(5000 + s, 200), spoiled(5000 + s, 200, 2 + s % 6)]
    texts += ["again and again it goes " * 60 + prose(s, 100) for s in range(3)]      # one frequent shingle, other sets
    texts += edited(70, 60)                                # a dense group
    rows = list(enumerate(texts, 1))
    sets = {i: shingles(t) for i, t in rows}
    like = [jaccard(sets[i], sets[i + 1]) for i in range(1, 240, 2)]
    assert sum(x < 0.8 for x in like) > 20 and sum(0.8 <= x < 0.85 for x in like) > 10
    want = plain_components(sets, lambda a, b: jaccard(a, b) >= 0.8)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs_of(rows)).collect()} == set(want.values())


def test_groups_left_in_parts_are_searched_for_all_pairs(spark):
    # forty sets whose fingerprints are all near: they hang together by one pair that is not among the first ones, and by chains
    r = np.random.default_rng(3)
    sets = {i: list(range(1000 * i, 1000 * i + 100)) for i in range(1, 41)}
    sets[37] = sets[5][:95] + [7, 8, 9]
    sets[38] = sets[37][:90] + [6, 4]
    fps = spark.createDataFrame([(i, int(1) << int(r.integers(0, 60)), 0, 100) for i in sets], "node bigint, fp bigint, chk bigint, n int")
    table = spark.createDataFrame([(i, np.array(h, np.uint64).tobytes()) for i, h in sets.items()], "node bigint, hashes binary")
    got = simhash.near_sets(fps, lambda nodes: table.join(nodes, "node", "left_semi"), 8, 36).collect()
    assert {x["node"]: x["component"] for x in got if x["node"] != x["component"]} == {37: 5, 38: 5}


def test_many_near_copies_are_decided_in_blocks_without_rows_of_pairs(spark, docs_of, monkeypatch):
    # near copies around the limit: most pairs are unlike, and every pair once was a row with both sets
    monkeypatch.setattr(simhash, "UNIT_ROWS", 16)
    texts = [spoiled_at(7, 146, 1 + i % 6, i) for i in range(90)]
    sets = {i: shingles(t) for i, t in enumerate(texts, 1)}
    want = plain_components(sets, lambda a, b: jaccard(a, b) >= 0.8)
    assert 3 < len(set(want.values())) < 60
    sizes = []
    unit = simhash.linked_in_units
    monkeypatch.setattr(simhash, "linked_in_units", lambda members, percent: sizes.append(members.count()) or unit(members, percent))
    got = simhash.drop_near_duplicates(docs_of(list(enumerate(texts, 1)))).collect()
    assert {r["doc_id"] for r in got} == set(want.values())
    assert len(sizes) == 2 and max(sizes) <= 90 * 10              # a set goes to blocks, not to pairs


def test_units_join_what_all_pairs_join():
    r = np.random.default_rng(5)
    sets = [np.unique(r.choice(60, 40, replace=False) if i % 3 else np.arange(40) + i // 9).astype(np.uint64) for i in range(80)]
    node, side = np.arange(80) * 7 % 101, np.arange(80) % 2
    for label, sides in ((node, side * 0), (node, side), (node // 30, side * 0)):
        u, v = simhash.unit_links(node.copy(), label.copy(), sides, sets, 60)
        place = {x: i for i, x in enumerate(node.tolist())}
        like = lambda a, b: jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.6
        assert all(like(place[x], place[y]) for x, y in zip(u.tolist(), v.tolist()))
        told = set(zip(u.tolist(), v.tolist()))
        joined = lambda pair: plain_components({i: i for i in range(80)}, lambda a, b: label[a] == label[b] or pair(a, b))
        assert joined(lambda a, b: (not sides.any() or sides[a] != sides[b]) and like(a, b)) == joined(lambda a, b: {(int(node[a]), int(node[b])), (int(node[b]), int(node[a]))} & told)
        assert len(u) < 80


def spoiled_at(seed, n, edits, which):
    w = prose(seed, n).split()
    for e, i in enumerate(random.Random(which).sample(range(n), edits)):
        w[i] = f"edit{which}x{e}"
    return " ".join(w)


def test_components_of_few_edges_take_few_jobs_and_those_of_many_blocks_agree(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)]
    both = {*edges, *((b, a) for a, b in edges)}
    want = plain_components({x: x for e in edges for x in e}, lambda a, b: (a, b) in both)
    table = spark.createDataFrame(edges, "u bigint, v bigint").repartition(32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # many partitions, as on a cluster
    try:
        one, jobs = jobs_of(spark, "one block", lambda: graph.components(table).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(graph, "BLOCK", 16)
    many = graph.components(table).collect()
    touched = {x for u, v in edges if u != v for x in (u, v)}
    for got in (one, many):
        assert {x["node"]: x["component"] for x in got} == {x: want[x] for x in touched} and len(got) == len(touched)
    assert jobs <= 8
