import re
from collections import Counter

from tidecast.llm import rules

from .conftest import ODD, prose


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_a_plain_count(docs_of):
    rows = ODD + [(20, "a b c d e f a b c d e g a b c d e"), (21, "x y\nx y\n \nx y#|"), (22, "p q r s t p q r s t p q r s t p q"), (23, prose(7, 400) + " " + prose(7, 30))]
    got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.ledger(docs_of(rows), keep=()).collect()]
    assert Counter(got) == Counter(plain(t) for _, t, *_ in rows)


def test_policies_and_ablations(docs_of):
    rows = [(1, prose(1, 80)), (2, "a b"), (3, "### ### " * 30), (4, "BIG WORDS!! " * 40), (5, "same line here today\n" * 30), (6, prose(2, 80))]
    book = rules.ledger(docs_of(rows))
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(book, "v1").collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    base = {r["doc_id"]: r["kept"] for r in rules.apply_policy(book, ("few_words",)).collect()}
    assert [d for d, k in base.items() if not k] == [2]
    by_rule = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rules.ablations(book, "v1").collect()}
    failed = {r["doc_id"]: r["failed"] for r in book.collect()}
    for rule, bit in rules.BITS.items():
        want = sum(1 for f in failed.values() if f & bit), sum(1 for f in failed.values() if f == bit)
        assert by_rule.get(rule, (0, 0)) == want
    assert [r["doc_id"] for r in rules.keep_good(docs_of(rows)).orderBy("doc_id").collect()] == [1, 6]
