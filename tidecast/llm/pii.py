"""Personal data: fixed formats, and spans that weak labelers vote on.

The base kinds are regular expressions with checks.  Further candidates (long mixed tokens, formatted identity numbers) get
votes from regex, gazetteer and context labelers; the votes of the whole corpus are counted by pattern, expectation-maximisation
estimates how reliable every labeler is, and a logistic classifier over span features is trained on the resulting soft labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import let

#: The base kinds in the order in which spans are listed.  Possessive quantifiers and the start conditions keep the
#: search linear and free of deep recursion without changing what matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Added kinds: a long token with digits and letters, and identity numbers in groups.
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = (*BASE, *ADDED)
#: Gazetteer of words that announce a credential or an identity number.
KEY_WORDS = ("api", "apikey", "auth", "bearer", "credential", "credentials", "iban", "key", "login", "passphrase", "passport", "passwd",
             "password", "pin", "private", "secret", "session", "ssn", "tax", "token")
LEFT = 24
OPEN, CLOSE = "\x01", "\x02"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def step(total, i):  # noqa: E306
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(span)).between(16, 19) & _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    return F.lit(True)


def spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, s, e, v, l>> of the matches of a pattern in a text without the two marks: code points
    (end exclusive), the match and the ``LEFT`` characters before it.

    Matches are put between marks, the text is cut at the marks, and the lengths of the parts add up to places.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    none = F.array().cast("array<struct<kind:string,s:int,e:int,v:string,l:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.lit(False).alias("inside"), none.alias("found"))

    def step(a, p):
        end = a["at"] + F.length(p)
        hit = F.struct(F.lit(kind).alias("kind"), a["at"].alias("s"), end.alias("e"), p.alias("v"), a["before"].alias("l"))
        return F.struct(end.alias("at"), F.right(p, F.lit(LEFT)).alias("before"), (~a["inside"]).alias("inside"),
                        F.when(a["inside"], F.concat(a["found"], F.array(hit))).otherwise(a["found"]).alias("found"))

    found = F.aggregate(parts, start, step)["found"]
    return F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]"), F.filter(found, lambda x: _valid(kind, x["v"]))).otherwise(none)


def base_and_candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, __base (spans of the base kinds) and __more (candidates that touch none of them) of every whole text (null: empty)."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, "\x03\x03")
    marked = F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(OPEN)) | F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(CLOSE))
    held = docs.select(*[F.col(c) for c in keep], F.when(marked, clean).otherwise(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    t = F.col("__t")
    found = held.select(*[F.col(c) for c in keep], F.concat(*[spans(t, k, p) for k, p in BASE.items()]).alias("__base"),
                        F.concat(*[spans(t, k, p) for k, p in ADDED.items()]).alias("__raw"))
    free = F.filter("__raw", lambda c: ~F.exists("__base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return found.select(*[F.col(c) for c in keep], "__base", free.alias("__more"))


def votes(span: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 personal, -1 not, 0 abstains."""
    v, left = span["v"], F.lower(span["l"])
    word = F.regexp_extract(left, r"([a-z]+)[^a-z]*$", 1)
    n_digits = F.length(_digits(v))
    yes = lambda c, no: F.when(c, 1).when(no, -1).otherwise(0)
    return {
        "regex_hex": yes((F.length(v) >= 24) & v.rlike("^[0-9a-fA-F]+$"), v.rlike("_|--") & (n_digits < 4)),
        "regex_mixed": yes((F.length(v) >= 20) & (n_digits >= 6), n_digits < 3),
        "gazetteer": yes(word.isin(*KEY_WORDS), F.length(word) == 0),
        "context_assigned": yes(left.rlike(r"[=:]\s*[\"']?$"), left.rlike(r"[/\\]$")),
        "context_quoted": yes(left.rlike(r"[\"']$"), F.lit(False)),
        "format": yes(span["kind"] == "id_number", F.lit(False)),
    }


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict], dict]:
    """EM over counted vote patterns: (share of personal spans, each labeler's vote rates by class, posterior of each pattern).

    At most three to the number of labelers patterns.  Starts from the majority of votes; rates are smoothed by one vote each.
    """
    if not patterns:
        return 0.5, [], {}
    m = len(patterns[0][0])
    post = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    share, rates = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        ones = sum(n * post[v] for v, n in patterns)
        share = (ones + 1) / (total + 2)
        rates = [{x: ((sum(n * post[v] for v, n in patterns if v[j] == x) + 1) / (ones + 3),
                      (sum(n * (1 - post[v]) for v, n in patterns if v[j] == x) + 1) / (total - ones + 3)) for x in (-1, 0, 1)} for j in range(m)]
        for v, _ in patterns:
            a, b = math.log(share), math.log(1 - share)
            for j in range(m):
                p, q = rates[j][v[j]]
                a, b = a + math.log(p), b + math.log(q)
            post[v] = 1 / (1 + math.exp(max(-500, min(500, b - a))))
    return share, rates, post


def features(span: Column) -> list[Column]:
    """The classifier's features, each 0 or 1, from the span and its left neighbourhood only."""
    v, left = span["v"], span["l"]
    share = F.length(_digits(v)) / F.length(v)
    return [c.cast("int") for c in (
        F.length(v) >= 24, F.length(v) >= 32, share >= 0.2, share >= 0.5, v.rlike("[A-Z]") & v.rlike("[a-z]"), v.rlike("^[0-9a-fA-F]+$"), v.rlike("[_-]"),
        left.rlike(r"[\"'=:]\s*$"), left.rlike(r"\w\s+$"), span["kind"] == "id_number")]


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights (bias first) of a logistic model on counted feature vectors: (vector, personal weight, other weight)."""
    if not rows:
        return []
    w = [0.0] * (len(rows[0][0]) + 1)
    total = sum(a + b for _, a, b in rows)
    for _ in range(rounds):
        g = [decay * x for x in w]
        for x, a, b in rows:
            z = w[0] + sum(p for p, on in zip(w[1:], x) if on)
            d = ((a + b) / (1 + math.exp(max(-60, min(60, -z)))) - a) / total
            g[0] += d
            for j, on in enumerate(x):
                g[j + 1] += d * on
        w = [p - rate * q for p, q in zip(w, g)]
    return w


def train(candidates: DataFrame) -> list[float]:
    """Classifier weights from the candidates (``__more``) of the whole corpus.

    The spans are counted by votes and features: at most 3^6 times 2^10 rows reach the driver,
    however long the corpus is.  Without candidates there are no weights, and nothing is added.
    """
    span = candidates.select(F.explode("__more").alias("x"))
    counted = (span.select(F.array(*votes(F.col("x")).values()).alias("votes"), F.array(*features(F.col("x"))).alias("features"))
               .groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")).collect())
    by_votes: dict[tuple, int] = {}
    for r in counted:
        by_votes[tuple(r["votes"])] = by_votes.get(tuple(r["votes"]), 0) + r["n"]
    _, _, post = reliabilities(sorted(by_votes.items()))
    vectors: dict[tuple, list[float]] = {}
    for r in counted:
        cell, p = vectors.setdefault(tuple(r["features"]), [0.0, 0.0]), post[tuple(r["votes"])]
        cell[0] += r["n"] * p
        cell[1] += r["n"] * (1 - p)
    return logistic([(v, a, b) for v, (a, b) in sorted(vectors.items())])


def _accepted(weights: list[float]) -> Column:
    if not weights:
        return F.slice("__more", 1, 0)
    def score(x):  # noqa: E306
        return sum((w * f for w, f in zip(weights[1:], features(x))), F.lit(weights[0])) > 0
    return F.filter("__more", score)


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, base and spans: arrays of struct<kind, s, e, ...>, by kind as in ``KINDS``, then by start.

    Places are code points, end exclusive.  ``base`` are the matches of the base kinds that pass their checks; ``spans`` are
    these and the candidates that the trained classifier accepts (they never touch a base span).  Null and empty texts have
    none; repeated rows are treated alike; an empty table gives an empty table.  The texts are read twice (training, then use).
    """
    found = base_and_candidates(docs, text, keep)
    weights = train(base_and_candidates(docs, text, ()))
    return found.select(*[F.col(c) for c in keep], F.col("__base").alias("base"), F.concat("__base", _accepted(weights)).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, e.g. <EMAIL>; overlapping spans become one, named after the first.

    All rows and columns stay; null texts stay null.
    """
    base = docs.drop("__row", "__t")
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row"), F.col(text))
    found = find_personal_data(packed, text, ("__row",))
    whole = F.col("__row")[text]
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        piece = F.concat(F.substring(whole, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    done = let(F.aggregate(ordered, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, a["at"] + 1, F.length(whole))))
    now = F.when(F.size("spans") == 0, whole).otherwise(done)
    return found.select(*[(now.alias(text) if c == text else F.col("__row")[c].alias(c)) for c in base.columns])
