"""What every operator must take without failing: odd rows, clashing columns, empty tables."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidecast.llm import bpe, chunks, counts, lines, packing, pii, rules, shards, simhash, spotsigs

from .conftest import ODD, clash

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "simhash_drop": lambda d: simhash.drop_near_duplicates(d),
    "shards": lambda d: shards.shuffle_to_shards(d, 4),
    "spotsigs": lambda d: spotsigs.edit_likeness(d),
    "chunks": lambda d: chunks.repeated_passages(d),
    "chunks_remove": lambda d: chunks.remove_passages(d, chunks.repeated_passages(d)),
    "bpe": lambda d: bpe.decode(bpe.encode(d, MULTI, public_tokenizers.PATTERN), MULTI),
    "rules": lambda d: rules.ledger(d),
    "rules_keep": lambda d: rules.keep_good(d),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "pii": lambda d: pii.find_personal_data(d),
    "pii_redact": lambda d: pii.redact(d),
    "counts": lambda d: counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "lines": lambda d: lines.drop_boilerplate(d),
}
#: Those that give one row for each row they get.
WHOLE = {"simhash", "shards", "spotsigs", "chunks_remove", "bpe", "rules", "pii", "pii_redact", "counts", "lines"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, docs_of, name):
    docs = docs_of(ODD)
    plain = OPERATORS[name](docs).collect()
    more = OPERATORS[name](clash(spark, docs)).collect()
    assert len(plain) == len(more)
    if name in WHOLE:
        assert len(plain) == len(ODD)
        key = lambda r: (r["doc_id"] is None, r["doc_id"])
        assert sorted(map(key, plain)) == sorted(map(key, more)) == sorted((d is None, d) for d, *_ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs_of, name):
    assert OPERATORS[name](docs_of([])).collect() == []


@pytest.mark.parametrize("name", ["simhash_drop", "rules_keep", "pii_redact", "lines", "chunks_remove"])
def test_stages_keep_the_columns(spark, docs_of, name):
    docs = docs_of(ODD).withColumn("mine", F.lit(1)).withColumn("__row", F.lit(2)) if name in ("simhash_drop", "lines") else docs_of(ODD)
    assert OPERATORS[name](docs).columns == docs.columns
