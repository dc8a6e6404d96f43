import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with every other column null."""
    def build(rows, extra=""):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)
    return build


PROSE = ("when the old harbour was closed for repairs the fishing boats moved to a small bay north of the lighthouse where the water stays calm "
         "through most of the winter and nobody minds the noise of engines before dawn").split()


def prose(seed, n):
    """n words of varied prose."""
    import random
    r = random.Random(seed)
    syllables = "ka lo mi ter san du ve pri ot ul en bas".split()
    return " ".join(r.choice(PROSE) if r.random() < 0.4 else "".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, equal texts, a long text, odd characters.
ODD = [(1, prose(1, 60), "a"), (1, prose(1, 60), "a"), (2, prose(1, 60), "b"), (3, None, "a"), (4, "", None), (5, " \t\n ", "c"), (None, prose(2, 40), "a"),
       (None, None, None), (6, "x", "b"), (7, prose(3, 6000), "c"), (8, "été \x01 \x02 \U0001f600 <|endoftext|> a@b.co", "a"), (9, "\n\n\n", "b"),
       (10, "the " * 300, "d"), (11, prose(4, 30) + "\n" + prose(5, 30), "d")]


def clash(spark, df):
    """The same rows with more columns, named like columns that operators make."""
    from pyspark.sql import functions as F
    for name in ("fingerprint", "component_id", "shard", "slot", "bucket", "row", "ids", "bytes", "n_tokens", "failed", "kept", "h", "signature", "spans", "line",
                 "__row", "__t", "__bad", "__fp", "fp", "chk", "place", "at", "part", "digest", "first"):
        df = df.withColumn(name, F.lit("mine"))
    return df
