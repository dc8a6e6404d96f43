"""The pipeline against a plain version of its stages on a small table."""
import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tidecast.llm import rules

from .conftest import prose
from .test_rules import plain as measured
from .test_simhash import jaccard, plain_components, shingles
from .test_texts import plain_base


def table():
    r = random.Random(12)
    rows = []
    for i in range(60):
        text = prose(i, 90) + "\n" + prose(900 + i, 30)
        if i % 5 == 1:
            text = rows[-1][1].replace(" ", "  ", 1)          # a copy with other white space
        if i % 5 == 2:
            text += "\nAll rights reserved."
        if i % 5 == 3:
            text += f" mail user{i}@mail.example.com or +1 (555) 010-{1000 + i}"
        if i % 10 == 4:
            text = r.choice(["### $$$ ", "BUY NOW!! ", "again and again "]) * 40
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
    return rows + [(60 + i, f"{prose(3000 + i, 60)}\nAll rights reserved.", "en", f"s{i}", None) for i in range(12)]


def stage(spark, name, docs):
    return {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)[name](spark, docs, None).collect()}


def test_every_stage_matches_a_plain_version(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = stage(spark, "quality_rules", docs)

    def good(t):
        n, chars, symbols, dup, repeat = measured(t)
        w = t.split()
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 10 * sum(c.isupper() for c in t) > 3 * chars or 10 * t.count("!") > n
                    or 5 * sum(a == b for a, b in zip(w, w[1:])) > n)
    assert set(kept) == {d for d, t, *_ in rows if good(t)} and len(kept) == 66
    now = spark.createDataFrame(list(kept.values()), docs.schema)

    lined = stage(spark, "line_dedup", now)
    holder = min(d for d, r in kept.items() if "All rights reserved." in r["text"])
    plain = {d: r["text"] if d == holder else "\n".join(x for x in r["text"].split("\n") if x != "All rights reserved.") for d, r in kept.items()}
    assert {d: r["text"] for d, r in lined.items()} == plain and all(r["n_chars"] == len(r["text"]) for r in lined.values())
    now = spark.createDataFrame(list(lined.values()), docs.schema)

    single = stage(spark, "simhash_near_dedup", now)
    comp = plain_components({d: shingles(r["text"]) for d, r in lined.items()}, lambda a, b: jaccard(a, b) >= 0.8)
    assert set(single) == set(comp.values()) and len(single) == len(lined) - 12
    assert all(single[d] == lined[d] for d in single)
    now = spark.createDataFrame(list(single.values()), docs.schema)

    clean = stage(spark, "pii", now)
    assert set(clean) == set(single)
    for d, r in single.items():
        want = r["text"]
        for span in sorted((s.split(":") for s in plain_base(want)), key=lambda s: -int(s[1])):
            want = want[:int(span[1])] + f"<{span[0].upper()}>" + want[int(span[2]):]
        assert clean[d]["text"] == want
    now = spark.createDataFrame(list(clean.values()), docs.schema)

    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, now, None).collect()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for d, r in clean.items():
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == d)
        assert np.frombuffer(b"".join(bytes(x) for _, x in own), "<u4").tolist() == [*library.encode(r["text"], add_special_tokens=False).ids, 2]


def test_run_gives_the_last_stage_over_documents(spark, tmp_path):
    docs = spark.createDataFrame(table(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len({r["doc_id"] for r in out.collect()}) == 54
    assert len(corpus_pipeline.STAGES) == 5 and rules.mask("base") == 3
