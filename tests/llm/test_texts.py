"""Sharding, lines, passages, personal data and SpotSigs against plain versions."""
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidecast.llm import chunks, lines, pii, shards, spotsigs

from .conftest import ODD, prose


def test_shards_are_even_whole_and_shuffled(docs_of, tmp_path):
    rows = [(i, prose(i, 5)) for i in range(203)] + [(None, None)] * 100
    placed = shards.shuffle_to_shards(docs_of(rows), 8, bucket_bytes=2000)
    got = placed.collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sorted(i for i in ids if i is not None) == list(range(203)) and ids.count(None) == 100
    runs = sum(1 for a, b in zip(ids, ids[1:]) if a is not None and b == a + 1)
    assert runs < 10
    shards.write_shards(placed, str(tmp_path / "out"))
    assert placed.sparkSession.read.parquet(str(tmp_path / "out")).count() == 303


def test_lines_that_many_sites_have_stay_once(docs_of):
    rows = [(i, f"{prose(i, 12)}\nAll rights reserved. \n{prose(i + 500, 9)}", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, f"few sites\n{prose(900 + i, 8)}", f"s{i % 3}") for i in range(9)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs_of(rows)).collect()}
    for d, t, _ in rows:
        want = t if d == 0 or d >= 100 else "\n".join(x for x in t.split("\n") if x.strip() != "All rights reserved.")
        assert got[d] == want


def test_lines_near_the_threshold_are_counted_exactly(docs_of, spark):
    rows = [(i, "nine sites\nten sites\nmany", f"s{i}") for i in range(9)] + [(9, "ten sites\nmany", "s9")] + [(20 + i, "many", f"x{i}") for i in range(30)]
    found = lines.boilerplate(lines.line_table(docs_of(rows)), min_sites=10).collect()
    name = {r["h"]: t for t in ("nine sites", "ten sites", "many") for r in spark.sql(f"select xxhash64('{t}') as h").collect()}
    assert {name[r["line"]] for r in found} == {"ten sites", "many"}


def test_passages_of_fifty_words_are_found_wherever_they_stand(docs_of):
    rows, planted = [], set()
    for i in range(40):
        passage = prose(5000 + i, 51)
        for k in range(2):
            d = 2 * i + k
            rows.append((d, f"{prose(100 + d, 5 + 7 * k + i)} {passage} {prose(300 + d, 40 - i + k)}"))
            planted.add(d)
    rows += [(1000 + i, prose(7000 + i, 200)) for i in range(30)]
    found = chunks.repeated_passages(docs_of(rows)).collect()
    assert {r["doc_id"] for r in found} == planted
    text = dict(rows)
    for r in found:
        piece = text[r["doc_id"]][r["start"]:r["end"]]
        twin = text[r["doc_id"] ^ 1]
        assert piece in twin and r["first_doc_ids"] == [r["doc_id"] & ~1] and r["removed"] == bool(r["doc_id"] & 1)
    left = {r["doc_id"]: r["text"] for r in chunks.remove_passages(docs_of(rows), chunks.repeated_passages(docs_of(rows))).collect()}
    for r in found:
        t = text[r["doc_id"]]
        assert left[r["doc_id"]] == (t[:r["start"]] + t[r["end"]:] if r["removed"] else t)


def test_insertions_move_few_cuts():
    base = prose(1, 3000)
    a = {int(x) for x in chunks.chunk_text(base)[0]}
    b = {int(x) for x in chunks.chunk_text(base[:5000] + "XYZ" + base[5000:])[0]}
    assert len(a - b) <= 4
    digest, place = chunks.chunk_text("héß" * 5000)
    assert sum((p >> chunks.WORD_BITS) & ((1 << chunks.SIZE_BITS) - 1) for p in place.tolist()) == 15000


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)}
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_match_a_plain_search(docs_of):
    r = random.Random(4)
    pieces = ["a@b.co", "x.y+z@mail.example.com_q@r.st", "1.2.3.4", "001.255.0.9", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
              "+49 30 1234567 ", "+1+2", "é", "\U0001f600", "\x01", "\x02", "@", ".", "-", " ", "7", "1.2.3.4.5.6.7.8", "word", "a@b", "a@b@c.de", "..", "\n", "5500000000000004"]
    rows = [(i, "".join(r.choice(pieces) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 14)))) for i in range(400)] + list(ODD)
    rows += [(900, "9" * 30000), (901, "a" * 30000 + "@"), (902, "a.b@" + "c." * 9000 + "d"), (903, "1-" * 20000)]
    got = pii.find_personal_data(docs_of(rows), keep=("doc_id", "text")).select("text", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row["base"] == ",".join(plain_base(row["text"] or ""))
        assert row["spans"].startswith(row["base"])


def test_secrets_are_learnt_from_votes_and_redacted(docs_of):
    r = random.Random(6)
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{prose(i, 20)} token = "{code()}" {prose(i + 70, 9)} mail me@x.org') for i in range(30)]
    rows += [(100 + i, f"{prose(i + 200, 20)} chapter-{i}-of-the-long-book {prose(i + 300, 10)}") for i in range(30)]
    out = {x["doc_id"]: x for x in pii.find_personal_data(docs_of(rows), keep=("doc_id", "text")).collect()}
    assert all([s["kind"] for s in out[i]["spans"]] == ["email", "secret"] for i in range(30))
    assert all(out[100 + i]["spans"] == [] for i in range(30))
    red = {x["doc_id"]: x["text"] for x in pii.redact(docs_of(rows)).collect()}
    assert all(red[i] == f'{prose(i, 20)} token = "<SECRET>" {prose(i + 70, 9)} mail <EMAIL>' for i in range(30))
    assert all(red[100 + i] == rows[30 + i][1] for i in range(30))


def test_em_finds_the_better_labeler():
    r = random.Random(1)
    seen = defaultdict(int)
    for _ in range(5000):
        truth = r.random() < 0.3
        vote = lambda p: (1 if truth else -1) if r.random() < p else (-1 if truth else 1)
        seen[vote(0.95), vote(0.9), vote(0.6)] += 1
    share, rates, post = pii.reliabilities(sorted(seen.items()))
    assert abs(share - 0.3) < 0.05
    assert rates[0][1][0] > 0.9 > 0.75 > rates[2][1][0]
    assert post[1, 1, -1] > 0.9 > 0.1 > post[-1, -1, 1]


def plain_next(rows):
    order = sorted(rows, key=lambda x: -x[0])
    return {d: (t or "", (order[(i + 1) % len(order)][1] or "")) for i, (d, t) in enumerate(order)}


def test_edited_texts_follow_the_order_of_ids(docs_of):
    rows = [(i * 3, prose(i, 5 + i % 60)) for i in range(150)] + [(1000, None), (1001, ""), (1002, "é"), (1003, "\U0001f600ab")]
    got = {r["doc_id"]: r for r in spotsigs.edit_likeness(docs_of(rows)).collect()}
    for d, (t, nxt) in plain_next(rows).items():
        half = len(t) // 2
        assert got[d]["edited"] == t[:len(t) - half] + nxt[:half] and got[d]["n_chars"] == len(t)
        a, b = set(got[d]["signature"]), set(got[d]["edited_signature"])
        assert abs(got[d]["near_edited"] - len(a & b) / len(a | b)) < 1e-12


def test_next_rows_across_blocks_nulls_and_repeats(docs_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 7)
    rows = [(i * i, f"t{i}") for i in range(100)] + [(None, f"null {i}") for i in range(40)] + [(16, "t4"), (16, "again")]
    got = spotsigs.with_next(docs_of(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got) == sorted((d is None, d or 0, t) for d, t in rows)
    after = {r["text"]: r["next_text"] for r in got if r["text"] not in ("t4", "again")}
    assert all(after[f"t{i}"] == f"t{i - 1}" for i in range(1, 100) if i not in (4, 5))
    assert after["t5"] in ("t4", "again") and after["t0"].startswith("null")
    seen, at = [], after["t0"]
    while at.startswith("null"):
        seen.append(at)
        at = after[at]
    assert len(set(seen)) == 40 and at == "t99"


def test_signatures_skip_common_words(spark):
    df = spark.createDataFrame([("Cats like the warm, dry and sunny place.",), ("dogs fear the warm dry, and the SUNNY hill",), ("lists without links? maybe",), (None,)], "t string")
    a, b, c, d = (set(r[0]) for r in df.select(spotsigs.signatures(F.col("t"))).collect())
    assert a & b and a - b and len(c) > 1 and len(d) == 1


def test_near_pairs_are_all_found(spark):
    r = random.Random(8)
    sets = {}
    for g in range(25):
        base = [r.randrange(1 << 31) for _ in range(r.randint(1, 60))]
        for k in range(4):
            sets[len(sets)] = sorted(set(base[k // 2:] + [r.randrange(1 << 31) for _ in range(k)]))
    got = {(x["a"], x["b"]) for x in spotsigs.near_pairs(spark.createDataFrame(list(sets.items()), "key bigint, signature array<int>"), 0.8).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(i, j) for i in sets for j in sets if i < j and like(sets[i], sets[j]) >= 0.8}
    assert len(got) > 20


def test_equal_texts_have_equal_fingerprints(docs_of):
    got = [r for r in spotsigs.edit_likeness(docs_of([(1, prose(1, 30)), (2, prose(1, 30)), (3, "")])).collect() if r["doc_id"] < 3]
    assert got[0]["signature"] == got[1]["signature"]


def test_a_passage_of_a_third_document_leaves_the_first_of_two_copies(docs_of):
    passage, body = prose(801, 60), (prose(802, 60), prose(803, 60))
    copy = f"{body[0]} {passage} {body[1]}"
    docs = docs_of([(3, f"{prose(804, 60)} {passage} {prose(805, 60)}"), (5, copy), (9, copy)])
    rows = chunks.repeated_passages(docs).collect()
    mine = sorted((r["start"], r["end"], r["removed"]) for r in rows if r["doc_id"] == 5)
    assert [x[2] for x in mine] == [False, True, False]
    at = copy.index(passage)
    assert at <= mine[1][0] <= at + 64 and at + len(passage) - 64 <= mine[1][1] <= at + len(passage)
    assert sum(r["end"] - r["start"] for r in rows if r["doc_id"] == 9 and r["removed"]) == len(copy)
    assert [r["removed"] for r in rows if r["doc_id"] == 3] == [False]
