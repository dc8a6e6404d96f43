"""Quality rules as a ledger: every rule is evaluated once into a bit, policies and ablations are bit arithmetic afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE_CHARS, ascii_words, let

WINDOW = 5

#: name -> failing condition on the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 2 and 2 * n_dup_lines > n_lines",
    "capitals": "n_words > 0 and 10 * n_capitals > 3 * word_chars",
    "exclamations": "10 * n_exclamations > n_words",
    "stutter": "n_words > 0 and 5 * n_stutter > n_words",
    "long_words": "n_words > 0 and word_chars > 20 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Policies by version: the rules that reject.  "base" are the contract's two rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more; ``windows`` has a hash for each start.

    Only texts with an equal pair get here.  Sorting (hash, start) puts equal windows side by side;
    every start then adds the words that the start before it has not covered.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(pairs, lambda s: F.zip_with(
        F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    starts = F.sort_array(F.array_distinct(F.flatten(twins)))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of every row's whole text (null: no words), next to the columns ``keep``.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_exclamations, n_stutter: bigint.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c) for c in keep]
    split = docs.select(*kept, t.alias("__t"), ascii_words(F.col(text)).alias("__w"))
    n = F.size("__w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW),
                    lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(WINDOW)])))
    blank = F.btrim
    shrink = lambda pattern: F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))
    lines = split.select(
        *kept, n.alias("n_words"), F.length(F.array_join("__w", "")).alias("word_chars"), shrink(r"[#*$%&|<>]+").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: F.length(blank(x, F.lit(SPACE_CHARS))) > 0).alias("__l"),
        hashes.alias("__h"), shrink(r"\p{Lu}+").alias("n_capitals"), shrink("!+").alias("n_exclamations"),
        F.size(F.filter(F.zip_with(F.col("__w"), F.slice("__w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).alias("n_stutter"))
    big = lambda c, name: c.cast("bigint").alias(name)
    same = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    return lines.select(
        *kept, *[big(F.col(c), c) for c in ("n_words", "word_chars", "n_symbols")],
        big(F.size("__l") - F.size(F.array_distinct("__l")), "n_dup_lines"),
        big(F.when(same(F.col("__h")), _repeat_words(F.col("__h"))).otherwise(0), "n_repeat_words"),
        big(F.size("__l"), "n_lines"), *[big(F.col(c), c) for c in ("n_capitals", "n_exclamations", "n_stutter")])


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and ``failed``, a bigint with the bit of every rule that a row fails.

    One pass over the texts without an exchange; written once, it serves all policies.  Null,
    empty and blank texts have no words and fail ``few_words``.  Repeated rows are judged each on its own;
    an empty table gives an empty table.
    """
    bits = sum((F.when(F.expr(rule), BITS[name]).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return measure(docs, text, keep).withColumn("failed", bits.cast("bigint"))


def apply_policy(book: DataFrame, policy: str | tuple[str, ...], into: str = "kept") -> DataFrame:
    """``into``: whether a row of the ledger passes all rules of a policy."""
    return book.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """rule, n_failed, n_only: rows that fail a rule, and those that would stay if that rule were left out.

    The ledger is first counted by its bits (as many rows as there are combinations), then a rule is
    removed from the mask by bit arithmetic; the texts are not read again.
    """
    m = mask(policy)
    counted = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in BITS.items() if b & m])
    each = counted.select("bits", "n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The rows that pass a policy, with all their columns as they are.

    The row number beside the verdict keeps the optimizer from moving the filter below the measurements, where it
    would repeat them for every word.
    """
    base = docs.drop("__row")
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row"), F.col("text"))
    judged = apply_policy(ledger(packed, keep=("__row",)), policy, "kept").select("__row", "kept", F.monotonically_increasing_id().alias("nth"))
    return judged.where(F.col("kept") & (F.col("nth") >= 0)).select("__row.*")
