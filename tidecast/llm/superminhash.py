"""Near-duplicates by SuperMinHash signatures, bands, exact verification and connected components.

SuperMinHash gives every element of a set a random order of the signature's places and, place by place, the ranks j + r with r in
[0, 1); a place keeps the smallest rank.  The ranks of an element fill the places in turn, so they are correlated and the estimate of
the Jaccard likeness varies less than with independent hashes.  Once all places hold a rank below j + 1, later ranks cannot change
anything and a set's elements stop.  Here all elements of a batch of sets take their j-th step at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .graph import components
from .skew import attach
from .store import written

BANDS, BAND_ROWS = 40, 5
PLACES = BANDS * BAND_ROWS
SEED = 42
#: Elements held at once, and words remembered, by a task; steps for which exchanges are traced back instead of kept as whole orders.
BATCH, REMEMBERED, TRACED = 1 << 17, 1 << 19, 12
#: A pair of sets of likeness 0.8 agrees in fewer than this share of its places with odds below one in a million.
LOOSE = 0.65
#: Members of a bucket that are compared in one group.
BLOCK = 2048

GOLDEN, M1, M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: well spread bits from any numbers."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_hashes(text: str | None, words: int, known: Words) -> np.ndarray:
    """Distinct hashes, rising, of the word shingles of a text, A-Z lower-cased; fewer words than ``words`` make one shingle, none make none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    made = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        made = mix(made * GOLDEN + h[i:len(h) - k + 1 + i])
    return np.unique(made)


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, places: int = PLACES) -> np.ndarray:
    """(sets x places) ranks as integers, 2^32 to the step; ``elements`` are hashes, ``owner`` (rising) tells whose an element is.

    An empty set has the largest number everywhere.
    """
    sig = np.full(sets * places, np.iinfo(np.uint64).max, np.uint64)
    drawn: list[np.ndarray] = []
    order = None
    for j in range(places):
        draw = mix(elements + np.uint64((j + 1) * int(GOLDEN) & (1 << 64) - 1))
        k = (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int32) + np.int32(j)
        if j < TRACED:  # what stands at place k is found from the exchanges so far
            place = k
            for s in range(j - 1, -1, -1):
                place = np.where(place == drawn[s], np.int32(s), place)
            drawn.append(k)
        else:
            row = np.arange(len(elements))
            if order is None:
                order = np.tile(np.arange(places, dtype=np.int32), (len(elements), 1))
                for s, d in enumerate(drawn):
                    order[:, s], order[row, d] = order[row, d], order[:, s].copy()
            place = order[row, k]
            order[row, k] = order[:, j]
        np.minimum.at(sig, owner * places + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        full = sig.reshape(sets, places).max(1) < np.uint64(j + 1) << np.uint64(32)
        if full.any():
            going = ~full[owner]
            if not going.any():
                break
            if not going.all():
                elements, owner = elements[going], owner[going]
                drawn = [d[going] for d in drawn] if order is None else drawn
                order = None if order is None else order[going]
    return sig.reshape(sets, places)


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """(sets x bands) keys of ``rows`` neighbouring places each; the band's number is part of the key."""
    n, places = sig.shape
    key = np.tile(np.arange(places // rows, dtype=np.uint64), (n, 1))
    for r in range(rows):
        key = mix(key * GOLDEN + sig[:, r::rows])
    return key.astype(np.int64)


def sketches(docs: DataFrame, words: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, n, d1, d2, sig, keys): size of every row's shingle set, a 128-bit digest of it, a byte of each place and the band keys; keys are null for an empty set."""
    def run(batches):
        known = Words()
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(texts):
                sets, held, begin = [], 0, at
                while at < len(texts) and (held < BATCH or not sets):
                    sets.append(shingle_hashes(texts[at].as_py(), words, known))
                    held, at = held + len(sets[-1]), at + 1
                n = np.array([len(s) for s in sets])
                sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets))
                keys = band_keys(sig)
                low = mix(sig).astype(np.uint8)
                digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                d1, d2 = (np.array([d >> s & 0xFFFFFFFFFFFFFFFF for d in digest], np.uint64).astype(np.int64) for s in (0, 64))
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * keys.shape[1])].astype(np.int32)), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, at - begin), pa.array(n), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in low], pa.binary()), listed],
                                                 names=["doc_id", "n", "d1", "d2", "sig", "keys"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary, keys array<bigint>")


def met_in_buckets(members: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(key, node, n, many): the members (key, node, n; ``rows`` in all) of buckets with two or more, written, and how many they are."""
    many = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    met = written(attach(members, many, ["key"], "many", rows).select("key", "node", "n", "many"))
    return met, many.agg(F.coalesce(F.sum("many"), F.lit(0))).head()[0]


def first_pairs(met: DataFrame, rows: int, percent: int) -> DataFrame:
    """(u, v, bands): every member of a bucket with the bucket's head, and in how many bands they meet so; sizes that rule a link out have no row.

    The head is the member that meets most others over all its bands: of near copies of one text it is the one in their middle.  A bucket
    is only ever an aggregate (its head and size, combined on the map side): its members meet that one row.
    """
    central = met.groupBy("node").agg(F.sum("many").alias("score"))
    scored = met.join(central, "node")
    heads = written(scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("first"), "n")).alias("head"), F.count(F.lit(1)).alias("size"))
                    .select("key", (-F.col("head.first")).alias("head"), F.col("head.n").alias("head_n"), "size"))
    pairs = attach(met, heads, ["key"], "size", rows).where("node <> head").where(_sizes_fit(F.col("n"), F.col("head_n"), percent))
    return pairs.groupBy(F.col("head").alias("u"), F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("bands"))


def _sizes_fit(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class Unit:
    """Members of one bucket that are compared together: of one block (all sides 0), or of two (sides 0 and 1)."""

    def __init__(self, key: int, t: pa.Table, percent: int):
        self.key, self.percent = key, percent
        self.node, self.n, self.label, self.side = (t.column(c).to_numpy() for c in ("node", "n", "label", "side"))
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(self.node), -1)
        self.sets = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()] if "hashes" in t.column_names else None

    def partners(self):
        """(a, places b): pairs of different labels that fit by size, agree in LOOSE of their places and meet in no earlier band.

        Members of the most common label are looked at from the other side only, so a bucket that is nearly one component costs little.
        """
        _, place, many = np.unique(self.label, return_inverse=True, return_counts=True)
        usual = place == many.argmax()
        at = np.arange(len(self.node))
        for a in np.flatnonzero(~usual):
            others = (self.label != self.label[a]) & (usual | (at > a)) & (100 * np.minimum(self.n, self.n[a]) >= self.percent * np.maximum(self.n, self.n[a]))
            if self.side.any():
                others &= self.side != self.side[a]
            b = np.flatnonzero(others)
            b = b[(self.sig[b] == self.sig[a]).mean(1) >= LOOSE]
            earlier = np.flatnonzero(self.keys[a] == self.key)[0]
            yield a, b[~(self.keys[b, :earlier] == self.keys[a, :earlier]).any(1)]

    def flagged(self) -> np.ndarray:
        """Places of the members that have a partner."""
        hit = np.zeros(len(self.node), bool)
        for a, b in self.partners():
            hit[b] = True
            hit[a] |= bool(len(b))
        return np.flatnonzero(hit)

    def links(self) -> list[tuple[int, int]]:
        """Verified links, as many as join what they join: partners that already hang together here are not compared."""
        root = {x: x for x in self.label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b in self.partners():
            for o in b.tolist():
                x, y = find(self.label[a]), find(self.label[o])
                if x != y and alike(self.sets[a], self.sets[o], self.percent):
                    root[y] = x
                    out.append((int(self.node[a]), int(self.node[o])))
        return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two rising arrays of distinct hashes have a Jaccard likeness of ``percent`` or more."""
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _units(members: DataFrame, schema: str, made, percent: int) -> DataFrame:
    """``made(unit, key columns, table)`` over whole units of ``members`` (key, i, j, side, node, n, label, sig, keys and maybe hashes)."""
    def run(batches):
        held, last = [], None
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            for a, b in zip(cuts := [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1)], [*cuts[1:], batch.num_rows]):
                if held and tuple(where[a]) != last:
                    yield made(Unit(last[0], t := pa.Table.from_batches(held), percent), t)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(where[a].tolist())
        if held:
            yield made(Unit(last[0], t := pa.Table.from_batches(held), percent), t)

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def possible_partners(met: DataFrame, rows: int, labelled: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, side, node): members that have a possible partner of another component, in the unit where the two first meet.

    Looked at are buckets whose members are not all in one component.  A bucket of more than BLOCK members is dealt into blocks by hash, and every two
    blocks meet in a unit of their own.
    """
    names = ["key", "i", "j", "side", "node"]
    told = met.join(labelled.select("node", "label"), "node")
    mixed = written(told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("many").alias("size")).where("low < high").select("key", "size"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"), (o < F.col("own")).cast("int").alias("side")))
    inside = attach(met, mixed, ["key"], "size", rows).withColumn("own", own).select("key", "node", F.inline(meets)).join(labelled, "node")

    def flag(unit, t):
        at = pa.array(unit.flagged(), pa.int64())
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(at) for c in names], names=names)

    return _units(inside, "key bigint, i int, j int, side int, node bigint", flag, percent)


def links_of_partners(partners: DataFrame, labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the members of ``partners``, decided on their full sets inside the unit; a unit returns no more links than join its components."""
    def link(unit, _):
        got = np.array(unit.links(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["u", "v"])

    return _units(partners.join(labelled, "node").join(sets, "node"), "u bigint, v bigint", link, percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets (node, hashes: packed rising uint64) have a Jaccard likeness of ``percent`` or more, by counting what they share.

    The set of u is sent once to each task that compares it, that of v once a pair; a u with many pairs is dealt over many tasks.
    """
    degree = written(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("pairs")))
    dealt = attach(pairs.select("u", "v"), degree, ["u"], "pairs", degree.agg(F.coalesce(F.sum("pairs"), F.lit(0))).head()[0])
    salt = F.pmod(F.xxhash64("v"), F.ceil(F.col("pairs") / 256)).cast("int")
    others = dealt.select("u", "v", salt.alias("salt")).join(sets.withColumnRenamed("node", "v"), "v")
    own = (degree.select("u", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("pairs") / 256) - 1).cast("int"))).alias("salt"))
           .join(sets.withColumnRenamed("node", "u"), "u").select("u", F.lit(None).cast("bigint").alias("v"), "salt", "hashes"))

    def run(batches):
        mine, of = None, None
        for batch in batches:
            us, vs, hs = batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("hashes")
            keep = []
            for i, (u, v) in enumerate(zip(us, vs)):
                h = np.frombuffer(hs[i].as_buffer(), np.uint64)
                if v is None:
                    mine, of = h.copy(), u
                    continue
                if of != u:
                    raise ValueError("a set is missing")
                if alike(mine, h, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64()))], names=["u", "v"])

    met = own.unionByName(others.select("u", "v", "salt", "hashes")).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return met.mapInArrow(run, "u bigint, v bigint")


def hash_sets(docs: DataFrame, nodes: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(node, hashes): the sets of ``nodes`` (node, doc_id, d1, d2), made again from the texts of their documents; repeated rows may give a set twice."""
    def run(batches):
        known = Words()
        for batch in batches:
            sets = [shingle_hashes(t, words, known).tobytes() for t in batch.column("text").to_pylist()]
            digest = [xxhash.xxh3_128_intdigest(s) for s in sets]
            want = zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist())
            node = batch.column("node").to_pylist()
            keep = [i for i, (d, (a, b)) in enumerate(zip(digest, want))
                    if d == ((b & 0xFFFFFFFFFFFFFFFF) << 64 | a & 0xFFFFFFFFFFFFFFFF) and (not i or node[i] != node[i - 1])]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[i] for i in keep], pa.binary())], names=["node", "hashes"])

    wanted = nodes.select("doc_id", "node", "d1", "d2")
    with_id = docs.select("doc_id", F.col(text).alias("text")).join(wanted, "doc_id").select("node", "d1", "d2", "text")
    return with_id.mapInArrow(run, "node bigint, hashes binary")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: size of its set of ``words``-word shingles, smallest doc_id reachable by links, and whether it is that.

    Sets with a Jaccard likeness of ``percent`` or more are linked, decided on the full sets (64-bit hashes of their shingles).  Candidates meet in one of
    BANDS bands of BAND_ROWS places; at likeness 0.8 a pair meets in none with odds of one in 10^7.  Equal sets are one node.  Each bucket's members
    are compared with its head; after joining what is linked, buckets that still hold several components are compared pair by pair, in blocks.

    A text without words (null, empty, blank) has the empty set and is linked with nothing.  Rows without doc_id share the component of an equal
    set that has one (and are not kept), else their component is null and they are kept; they link nothing.  Repeated rows each get a row.  An empty table gives an empty
    table; other columns are ignored.  Jobs run while this is planned; tables go to the shared folder.
    """
    base = docs.select("doc_id", F.col(text).alias("text"))
    made = written(sketches(base, words))
    nodes = written(made.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
                    .withColumn("node", F.monotonically_increasing_id()))
    named = nodes.where("doc_id is not null")
    members = named.select("node", "n", F.explode("keys").alias("key"))
    counts = nodes.agg(F.count("doc_id"), F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))).head()
    met, rows = met_in_buckets(members, counts[0] * BANDS)
    pairs = written(first_pairs(met, rows, percent))
    best = written(pairs.groupBy("v").agg(F.max_by("u", F.struct("bands", "u")).alias("u")).select("u", "v"))
    texts_of = lambda some: written(hash_sets(base, named.join(some.distinct(), "node"), words))
    sets = texts_of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    good = written(verified(best, sets, percent))
    label = stage(components(good))

    def joined(found):
        nonlocal good, label
        if found.head(1):
            good = good.unionByName(found)
            label = stage(components(good))

    rest = pairs.join(best, ["u", "v"], "left_anti")
    for c in "uv":
        rest = rest.join(label.select(F.col("node").alias(c), F.col("component").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    rest = written(rest.where("lu <> lv").select("u", "v"))
    if rest.head(1):
        joined(written(verified(rest, sets, percent)))
    labelled = written(met.select("node").distinct().join(named.select("node", "n", "sig", "keys"), "node").join(label, "node", "left")
                       .select("node", "n", "sig", "keys", F.coalesce("component", "node").alias("label")))
    partners = written(possible_partners(met, rows, labelled, percent))
    if partners.head(1):
        joined(written(links_of_partners(partners, labelled, texts_of(partners.select("node")), percent)))
    placed = written(nodes.join(label, "node", "left").select("d1", "d2", "copies", "doc_id", F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("many"))
    told = written(attach(placed.drop("doc_id"), written(least), ["component"], "many", counts[2]).select("d1", "d2", "copies", "component_id"))
    told_rows = attach(made.where("n > 0").select("doc_id", "n", "d1", "d2"), told, ["d1", "d2"], "copies", counts[1]).select("doc_id", "n", "component_id")
    alone = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return told_rows.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                          F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
