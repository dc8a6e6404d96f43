"""SimHash near-duplicates, searched through the anchors of a covering code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Two fingerprints that differ in at most ``threshold`` bits
agree up to t[s] bits in at least one segment s as soon as sum(t[s] + 1) > threshold.  Each segment is padded with zeros to the
23 bits of the binary Golay code, whose 4096 words are the anchors: every 23-bit word lies within 3 bits of exactly one of them
(the covering radius).  A fingerprint is sent to all anchors within 3 + t[s] bits of its segment, so it meets, at the anchor
nearest to the other one, every fingerprint within t[s] bits.  For small thresholds the anchors are refined by one of
``threshold + 1`` blocks of the other bits, of which at least one is equal; that keeps the groups short when there are
billions of fingerprints.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .graph import components, find
from .skew import attach
from .store import written

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GOLAY, LENGTH, PARITY, RADIUS = 0b101011100011, 23, 11, 3
BLOCK = 1 << 16
#: Bytes of hashes, and members, of a block of a group that is compared in one task.
UNIT_BYTES, UNIT_ROWS = 1 << 21, 1024


@lru_cache(1)
def _syndrome_table() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of the low 12 and of the high 11 bits of a word."""
    unit = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        r = 1 << i
        for b in range(i, PARITY - 1, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - PARITY)
        unit[i] = r

    def spread(units):
        out = np.zeros(1 << len(units), np.int64)
        for i, u in enumerate(units):
            out[1 << i:2 << i] = out[:1 << i] ^ u
        return out

    return spread(unit[:12]), spread(unit[12:])


def syndromes(words: np.ndarray) -> np.ndarray:
    low, high = _syndrome_table()
    return low[words & 0xFFF] ^ high[words >> 12]


@lru_cache(8)
def error_patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All patterns of at most ``reach`` bits, grouped by syndrome (lightest first), and the group starts.

    A word plus a pattern of its own syndrome is a code word: its anchors within ``reach`` bits.
    """
    p = np.array([sum(1 << i for i in c) for w in range(reach + 1) for c in combinations(range(LENGTH), w)], np.int64)
    s = syndromes(p)
    order = np.argsort(s, kind="stable")
    return p[order], np.searchsorted(s[order], np.arange((1 << PARITY) + 1))


def segment_reach(threshold: int) -> list[int]:
    """t[s] for the three segments, as small as sum(t[s] + 1) > threshold allows; -1: not needed."""
    return [(threshold + 1 + i) // 3 - 1 for i in (2, 1, 0)]


def anchor_keys(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home): every anchor each fingerprint (uint64) is sent to; home marks the nearest one."""
    rows, keys, homes = [], [], []
    everything = np.arange(len(fp))
    fp = fp.astype(np.uint64)
    blocks = threshold + 1 if threshold <= 4 else 1
    for s, ((shift, width), t) in enumerate(zip(SEGMENTS, segment_reach(threshold))):
        if t < 0:
            continue
        piece = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        patterns, start = error_patterns(RADIUS + t)
        syn = syndromes(piece)
        many = start[syn + 1] - start[syn]
        row = np.repeat(everything, many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        pattern = patterns[start[syn][row] + nth]
        anchor = piece[row] ^ pattern
        home = np.bitwise_count(pattern) <= RADIUS
        upper = np.uint64(shift + width) if shift + width < 64 else np.uint64(0)
        rest = fp & np.uint64((1 << shift) - 1)
        if shift + width < 64:
            rest = rest | ((fp >> upper) << np.uint64(shift))
        size = -(-(64 - width) // blocks)
        for b in range(blocks):
            part = ((rest >> np.uint64(b * size)) & np.uint64((1 << size) - 1)).astype(np.int64) if blocks > 1 else np.zeros(len(fp), np.int64)
            rows.append(row)
            keys.append((((s * 8 + b) << LENGTH | anchor) << 12) | part[row])
            homes.append(home)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def shingle_hashes(text: str | None, words: int, seed: int):
    """Hashes (uint64) of the word shingles of a text in order, in blocks; none without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    body = b" ".join(tokens)
    k = min(words, len(tokens))
    begin, end = begin[:len(tokens) - k + 1], end[k - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), BLOCK):
        a, b = begin[at:at + BLOCK].tolist(), end[at:at + BLOCK].tolist()
        yield np.fromiter((digest(body[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct hashes, rising."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words, seed)]))


def fingerprint(text: str | None, words: int, seed: int, second: bool = True) -> tuple[int, int]:
    """Fingerprint of the word shingles of a text, and a second one from the same hashes for checking (or 0); 0, 0 without words."""
    return _prints(shingle_hashes(text, words, seed), second)


def _prints(blocks, second: bool) -> tuple[int, int]:
    ones, twos, n = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    for h in blocks:
        n += len(h)
        ones += _bits(h)
        if not second:
            continue
        g = h * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        twos += _bits(g)
    pack = lambda c: int(np.packbits(c * 2 > n, bitorder="little").view("<u8")[0])
    return pack(ones), pack(twos)


def _bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    b = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for at in range(0, len(b), 255):
        out += np.add.reduce(b[at:at + 255], axis=0, dtype=np.uint8)
    return out


def with_fingerprints(docs: DataFrame, words: int = 5, seed: int = 42, text: str = "text", into: str = "fp", check: str = "chk",
                      second: bool = True) -> DataFrame:
    """``docs`` with two bigint columns, the fingerprint and a second one for checks (0 if not wanted); existing columns of these names go."""
    @F.pandas_udf("fp bigint, chk bigint")
    def both(texts):
        import pandas as pd
        got = np.array([fingerprint(t, words, seed, second) for t in texts], np.uint64).reshape(-1, 2).astype(np.int64)
        return pd.DataFrame({"fp": got[:, 0], "chk": got[:, 1]})

    made = docs.drop(into, check, "__both").withColumn("__both", both(F.col(text)))
    return made.select(*[F.col(f"`{c}`") for c in made.columns if c != "__both"],
                       F.col("__both.fp").alias(into), F.col("__both.chk").alias(check))


def group_forest(key, home, fp, chk, node, threshold: int, together: int, size=None, percent: int = 0):
    """Links of each run of equal keys, as (smallest node, other node) of the parts that hang together.

    All pairs of a home and any other member are compared, in steps of growing distance, until the
    whole group is one part; rows are sorted by key with the homes first.  Gives one link a row at most.
    With ``percent``, sizes that rule out a Jaccard likeness of that much make no link.
    """
    n = len(key)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    stop = np.repeat(np.r_[cut[1:], n], np.diff(np.r_[cut, n]))
    group = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, n]))
    label = np.arange(n)
    at = np.flatnonzero(home)
    k = 1
    while True:
        at = at[at + k < stop[at]]
        if not len(at):
            break
        a, b = at, at + k
        apart = np.bitwise_count(fp[a] ^ fp[b])
        if together:
            apart += np.bitwise_count(chk[a] ^ chk[b])
        near = (label[a] != label[b]) & (apart <= (together or threshold))
        if percent:
            near &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        x, y = a[near], b[near]
        while len(x):
            x, y = find(label, x), find(label, y)
            differ = x != y
            x, y = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            np.minimum.at(label, y, x)
        if k & (k - 1) == 0 and k > 1:
            label = find(label, label)
            one = np.minimum.reduceat(label, cut) == np.maximum.reduceat(label, cut)
            at = at[~one[group[at]]]
        k += 1
    label = find(label, label)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    least = least[label]
    other = least != node
    return least[other], node[other]


def _at_anchors(fps: DataFrame, threshold: int, carried: list[str], compare, schema: str, prints: int = 1) -> DataFrame:
    """``compare`` (numpy columns key, home and ``carried``, to the columns of ``schema``) over whole groups of rows that meet at an anchor.

    The first ``prints`` of the carried columns are fingerprints, each with anchors of its own.
    """
    names = ["key", "home", *carried]
    made = [x.split()[0] for x in schema.split(", ")]
    kind = dict(fps.dtypes)

    def send(batches):
        for batch in batches:
            for p in range(prints):
                fp = batch.column(p).to_numpy().astype(np.uint64)
                for at in range(0, len(fp), 1024):
                    row, key, home = anchor_keys(fp[at:at + 1024], threshold)
                    row = row + at
                    yield pa.RecordBatch.from_arrays([pa.array(key | p << 48), pa.array(home)] + [pa.array(batch.column(i).to_numpy()[row]) for i in range(len(carried))],
                                                     names=names)

    def run(batches):
        held = None
        for batch in batches:
            cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(len(names))]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            held = [c[last:] for c in cols]
            if last:
                yield _made([c[:last] for c in cols])
        if held is not None and len(held[0]):
            yield _made(held)

    def _made(cols):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in compare(*cols)], names=made)

    sent = fps.select("fp", *[c for c in carried if c != "fp"]).mapInArrow(send, "key bigint, home boolean, " + ", ".join(f"{c} {kind[c]}" for c in carried))
    return sent.repartition("key").sortWithinPartitions("key", F.desc("home"), "node").mapInArrow(run, schema)


def links(fps: DataFrame, threshold: int = 4, together: int = 0, percent: int = 0) -> DataFrame:
    """(u, v): enough links between the rows of ``fps`` (node, fp, chk: bigint) to connect all that are near.

    Near: at most ``threshold`` differing bits, of which none are missed; or, unless it is 0, at most ``together`` differing bits
    in both fingerprints, among the pairs that meet at an anchor.  Only a spanning forest of every anchor's group is returned, so a dense group gives as
    many rows as members, not as pairs.  A group passes one task as numbers of 25 bytes a member.
    With ``percent``, the rows (then with n: int, the size of a set) meet at the anchors of both fingerprints, and sizes that rule out that likeness make no link.
    """
    def compare(key, home, fp, chk, node, n=None):
        u, v = group_forest(key, home, fp.astype(np.uint64), chk.astype(np.uint64), node, threshold, together, None if n is None else n.astype(np.int64), percent)
        return v, u

    carried = ["fp", "chk", "node"] + ["n"] * (percent > 0)
    return _at_anchors(fps, threshold, carried, compare, "u bigint, v bigint", prints=1 + (percent > 0)).distinct()


def unit_links(node: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): pairs of members with a Jaccard likeness of ``percent`` or more, as many as join what all such pairs join.

    ``sets`` have distinct hashes.  Members of one label hang together already; with two sides (0 and 1), only pairs across them are looked at.  What a member
    shares with all others is counted at once from the lists of the members that have a hash.
    """
    m = len(node)
    n = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), n)
    _, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[place] > 1
    owner, place = owner[shared], place[shared]
    cut = np.searchsorted(owner, np.arange(m + 1))
    having = owner[np.argsort(place, kind="stable")]
    start = np.searchsorted(np.sort(place), np.arange(len(many) + 1))
    values, label, sizes = np.unique(label, return_inverse=True, return_counts=True)
    usual = sizes.argmax()                                  # its members are looked at from the other side only
    two = side.any()
    us, vs = [], []
    for a in range(m):
        if label[a] == usual or cut[a] == cut[a + 1]:
            continue
        both = np.bincount(np.concatenate([having[start[x]:start[x + 1]] for x in place[cut[a]:cut[a + 1]].tolist()]), minlength=m)
        near = (100 * both >= percent * (n + n[a] - both)) & (label != label[a])
        if two:
            near &= side != side[a]
        b = np.flatnonzero(near)
        if len(b):
            found, first = np.unique(label[b], return_index=True)
            us += [node[a]] * len(found)
            vs += node[b[first]].tolist()
            label[np.isin(label, np.r_[found, label[a]])] = usual if usual in found else label[a]
    return np.array(us, np.int64), np.array(vs, np.int64)


def linked_in_units(members: DataFrame, percent: int) -> DataFrame:
    """(u, v) of ``unit_links`` over whole units of ``members`` (component, i, j, side, node, label, hashes: packed uint64)."""
    def linked(held):
        col = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for b in held for h in b.column("hashes")]
        u, v = unit_links(col("node"), col("label"), col("side"), sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy() for c in ("component", "i", "j")])
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and tuple(where[a].tolist()) != last:
                    yield linked(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(where[a].tolist())
        if held:
            yield linked(held)

    return (members.select("component", "i", "j", "side", "node", "label", "hashes").repartition("component", "i", "j")
            .sortWithinPartitions("component", "i", "j").mapInArrow(run, "u bigint, v bigint"))


def near_sets(fps: DataFrame, sets_of, threshold: int, most: int, percent: int = 80) -> DataFrame:
    """(node, component) of the nodes of ``fps`` (node, fp, chk, n) that hang together by pairs of ``percent`` likeness or more.

    Nodes that hang together by pairs that meet at an anchor, fit by size and differ in at most ``most`` bits form a group; inside it all pairs are decided
    by their shingles (``sets_of(nodes)`` gives (node, hashes)).  Pairs never leave the tasks: a group is dealt into blocks of UNIT_BYTES and
    UNIT_ROWS at most, first each block is compared in itself, then every two blocks of groups that are still in parts.
    """
    group = stage(components(links(fps, threshold, most, percent)))
    members = written(group.join(sets_of(group.select("node")), "node"))
    size = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("many"), F.sum(F.octet_length("hashes")).alias("bytes"))
                   .withColumn("blocks", F.greatest(F.ceil(F.col("bytes") / UNIT_BYTES), F.ceil(F.col("many") / UNIT_ROWS), F.lit(1)).cast("int")))
    rows, blocks = size.agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).head()
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = attach(members, size, ["component"], "many", rows).withColumn("own", own)
    good = stage(linked_in_units(dealt.select("component", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "hashes"), percent))
    label = stage(components(good))
    if blocks < 2:
        return label
    told = written(members.select("component", "node").join(label.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")))
    parts = written(told.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
                    .join(size.where("blocks > 1"), "component").select("component", "many", "blocks"))
    meets = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
                        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"), (o < F.col("own")).cast("int").alias("side")))
    across = attach(told, parts, ["component"], "many", rows).withColumn("own", own).join(members.select("node", "hashes"), "node")
    more = stage(linked_in_units(across.select("component", "node", "label", "hashes", F.inline(meets)), percent))
    return stage(components(good.unionByName(more)))


def classes(fps: DataFrame, threshold: int, together: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """(fp, chk, component) for every distinct fingerprint of ``fps`` (doc_id, fp, chk).

    Equal fingerprints are one node, named by their smallest doc_id (nulls ignored; a fingerprint that
    only rows without doc_id have stays alone and gets a null component).
    """
    nodes = stage(fps.groupBy("fp", "chk").agg(F.min(doc_id).alias("node")))
    found = components(links(nodes.where("node is not null"), threshold, together))
    return (nodes.join(found, "node", "left")
            .select("fp", "chk", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, words: int = 4, threshold: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable through links) for every row.

    Texts without words (null, empty or white space only) have fingerprint zero and link to each other.
    Repeated rows each get a row.  A row without doc_id has the component of the rows with ids that have
    the same fingerprint, else null.  An empty table gives an empty table; other columns are ignored.
    """
    fps = stage(with_fingerprints(docs.select("doc_id", "text"), words, seed, second=False).select("doc_id", "fp", "chk"))
    return fps.join(classes(fps, threshold), ["fp", "chk"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def with_sets(docs: DataFrame, words: int, seed: int, hashes: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with __node, a digest of the set of its shingles; and __fp, __chk and __n, two fingerprints and the size of the set, or with its __hashes."""
    names = ["node", "hashes"] if hashes else ["node", "fp", "chk", "n"]
    digest = lambda h: int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64))

    def prints(t):
        h = shingle_set(t, words, seed)
        fp, chk = np.array(_prints([h], True) if len(h) else (0, 0), np.uint64).astype(np.int64).tolist()
        return digest(h), fp, chk, len(h)

    @F.pandas_udf("node bigint, fp bigint, chk bigint, n int")
    def both(texts):
        import pandas as pd
        return pd.DataFrame([prints(t) for t in texts], columns=names)

    @F.udf("node bigint, hashes binary", useArrow=False)
    def held(t):
        h = shingle_set(t, words, seed)
        return digest(h), h.tobytes()

    # not computed below a join that the texts come from: most of them have no near text
    made = docs.withColumn("__both", held.asNondeterministic()(F.col(text)) if hashes else both(F.col(text)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__both.{c}").alias(f"__{c}") for c in names])


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 8, most: int = 36, percent: int = 80, seed: int = 42) -> DataFrame:
    """One row of every group of near copies: that of the smallest doc_id.  All columns stay as they are.

    Copies have sets of word shingles of a Jaccard likeness of ``percent`` or more; a chain of copies makes one group.  Looked at
    are the pairs that hang together by pairs that meet at an anchor for ``threshold`` bits of either fingerprint and differ in at most ``most`` of 128 bits
    (two fingerprints of the sets).
    Texts without words are one group.  Rows without doc_id stay only where no row with an id has their
    shingles, one for each set; of rows that repeat the kept doc_id in a group one stays.
    """
    names = ["__node", "__fp", "__chk", "__n", "__hashes", "__component", "__id", "__both", "__of"]
    base = docs.drop(*names)
    made = with_sets(base, words, seed)
    nodes = stage(made.groupBy(F.col("__node").alias("node"), F.col("__fp").alias("fp"), F.col("__chk").alias("chk"), F.col("__n").alias("n"))
                  .agg(F.min("doc_id").alias("doc_id")))

    def sets_of(wanted):
        own = nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("__id"), F.col("node").alias("__component"))
        texts = base.select("doc_id", "text").join(own, F.col("doc_id") == F.col("__id"))
        return (with_sets(texts, words, seed, hashes=True).where("__node = __component").dropDuplicates(["__node"])
                .select(F.col("__node").alias("node"), F.col("__hashes").alias("hashes")))

    group = near_sets(nodes.where("doc_id is not null"), sets_of, threshold, most, percent)
    key = F.struct(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))     # one key: equal if both ids are null, too
    kept = stage(nodes.join(group, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
                 .agg(F.min_by(key, F.struct("doc_id", "node")).alias("__of")).select("__of"))
    chosen = made.withColumn("__of", F.struct("__node", F.col("doc_id").alias("__id"))).join(kept, "__of")
    return chosen.dropDuplicates(["__of"]).select(*[F.col(f"`{c}`") for c in base.columns])
