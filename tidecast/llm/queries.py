"""The registered queries of the training-text operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import audit
from .bpe import decode, encode
from .chunks import repeated_passages
from .counts import count_tokens
from .lines import drop_boilerplate
from .lloyd import cluster
from .packing import pack
from .pii import BASE, find_personal_data, listed
from .rules import apply_policy, ledger
from .shards import shuffle_to_shards
from .simhash import near_duplicates
from .spotsigs import as_text, edit_likeness
from .superminhash import near_duplicates as minhash_near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_simhash_near_dedup")
def _simhash(spark, folder):
    return near_duplicates(documents(spark, folder))


@query("op6_quality_rules", """
    with words as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    flat as (select doc_id, unnest(range(1, greatest(len(w) - 3, 1)::bigint)) as i, w from words),
    grams as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from flat),
    again as (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams),
    covered as (select doc_id, i - coalesce(lag(i) over (partition by doc_id order by i), -9) as gap from again where c > 1),
    repeats as (select doc_id, sum(least(5, gap))::bigint as n_repeat_words from covered group by doc_id),
    lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from words),
    m as (select words.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) as caps, length(t) - length(replace(t, '!', '')) as marks,
        len(list_filter(list_zip(w[:-2], w[2:]), lambda p: p[1] = p[2])) as stutter
        from words join lines using (doc_id) left join repeats using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or (n_dup_lines >= 2 and 2 * n_dup_lines > n_lines)
             or 10 * caps > 3 * word_chars or 10 * marks > n_words or 5 * stutter > n_words or word_chars > 20 * n_words) as kept,
        (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
         + case when 10 * n_symbols > n_words then 4 else 0 end + case when n_dup_lines >= 2 and 2 * n_dup_lines > n_lines then 8 else 0 end
         + case when n_words > 0 and 10 * caps > 3 * word_chars then 16 else 0 end + case when 10 * marks > n_words then 32 else 0 end
         + case when n_words > 0 and 5 * stutter > n_words then 64 else 0 end + case when n_words > 0 and word_chars > 20 * n_words then 128 else 0 end)::bigint as failed
    from m""")
def _rules(spark, folder):
    book = apply_policy(apply_policy(ledger(documents(spark, folder)), "base", "base_kept"), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


@query("op2_external_shuffle")
def _shards(spark, folder):
    placed = shuffle_to_shards(documents(spark, folder))
    body = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_TRIM = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op10_line_dedup", f"""
    with lines as (select doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x: {_TRIM})) as line from documents),
    common as (select line, min(doc_id) as holder from lines where line <> '' group by line having count(distinct source) >= 10),
    bad as (select doc_id, list(distinct line) as gone from lines join common using (line) where doc_id <> holder group by doc_id),
    cleaned as (select doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_TRIM} = '' or not list_contains(coalesce(gone, []), {_TRIM})), chr(10)) as now
        from documents left join bad using (doc_id))
    select doc_id, (len(string_split(text, chr(10))) - case when now = '' and text <> '' then 0 else len(string_split(now, chr(10))) end)::bigint as n_removed,
        length(now)::bigint as n_chars, sha256(now) as text_sha256 from cleaned""")
def _lines(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source", "text", F.col("text").alias("before"))
    now = drop_boilerplate(docs)
    n = lambda c: F.size(F.split(c, "\n"))
    gone = (F.col("text") == "") & (F.col("before") != "")
    return now.select("doc_id", (n("before") - F.when(gone, 0).otherwise(n("text"))).cast("bigint").alias("n_removed"),
                      F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("op8_weak_supervision_pii")
def _personal(spark, folder):
    found = find_personal_data(documents(spark, folder))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op5_prefix_bpe")
def _prefix_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(documents(spark, folder).select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op9_token_counts")
def _counts(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op7_retrieval_packing")
def _packing(spark, folder):
    pieces = pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_substring_dedup")
def _repeats(spark, folder):
    return repeated_passages(documents(spark, folder))


@query("op3_spotsigs")
def _spots(spark, folder):
    made = edit_likeness(documents(spark, folder))
    return made.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("signature")).alias("fingerprint"),
                       as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """All rounds as common tables, in long form (a row for each component)."""
    near = lambda c: (f"select v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::bigint as d from flat v join {c} c using (i) group by v.r, c.c")
    parts = [f"""kept as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        flat as materialized (select r, unnest(range(1, 65)) as i, unnest(x) as x from kept),
        c0 as (select row_number() over (order by sha256('1:' || vec_id), x) - 1 as c, x from kept where vec_id is not null qualify c < {k}),
        s0 as materialized (select c::int as c, unnest(range(1, 65)) as i, unnest(x) as x from c0)"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (select r, arg_min(c, struct_pack(d, c)) as c, min(d) as d from ({near(f's{n}')}) group by r)""")
        parts.append(f"""s{n + 1} as materialized (select s.c, s.i, coalesce(m.x, s.x) as x from s{n} s left join (select a.c, v.i, floor(sum(v.x)::hugeint / count(*))::bigint as x
            from a{n} a join flat v using (r) group by a.c, v.i) m on s.c = m.c and s.i = m.i)""")
    parts.append(f"""told as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from s{rounds} group by c),
        near as (select c, sum(d)::bigint as cluster_inertia from a{rounds} group by c)""")
    return "with " + ", ".join(parts) + f"""
        select vec_id, c::int as cluster, d as distance, cluster_inertia, (select sum(cluster_inertia)::bigint from near) as inertia, centroid_sha256
        from a{rounds} join kept using (r) join told using (c) join near using (c)"""


@query("op11_dimension_sharded_lloyd", _lloyd_sql())
def _lloyd(spark, folder):
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op12_filter_interactions", """
    with w as (select *, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    fails as (select doc_id, coalesce(lang, '') as part,
        (case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
         + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 4 else 0 end
         + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
         + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end)::int as mask from w),
    marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
    masks as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fails left join marks using (doc_id) group by part, mask),
    letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
    orders as (select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from letters a, letters b, letters c, letters d, letters e
        where a.b | b.b | c.b | d.b | e.b = 31),
    steps as (select filter_order, s::int as step, bits[s] as bit, list_sum(bits[1:s - 1])::int as gone from (select *, unnest(range(1, 6)) as s from orders)),
    made as (select part, filter_order, step, bit,
        coalesce(sum(n) filter (mask & (coalesce(gone, 0) | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & coalesce(gone, 0) = 0 and mask & bit <> 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & coalesce(gone, 0) <> 0 and mask & bit <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & coalesce(gone, 0) = 0 and mask & bit <> 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (mask & coalesce(gone, 0) = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
        from masks cross join steps group by part, filter_order, step, bit)
    select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from made""")
def _audit(spark, folder):
    return audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op13_superminhash_near_dedup", """
    with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sets as (select doc_id, list_sort(list_distinct(case when len(w) = 1 then w else list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) end)) as s from words),
    same as materialized (select min(doc_id) as u, s, len(s)::bigint as n from sets where len(s) > 0 group by s),
    named as materialized (select u, n, unnest(s) as g from same),
    near as (select a.u as u, b.u as v from named a join named b on a.g = b.g and a.u < b.u and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        group by a.u, b.u, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    links as materialized (select u, v from near union select v, u from near),
    reach as (select u as node, u as other from same union select reach.node, links.v from reach join links on reach.other = links.u),
    least as (select node, min(other) as component_id from reach group by node)
    select doc_id, len(sets.s)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
    from sets left join same on sets.s = same.s left join least on node = u""")
def _minhash(spark, folder):
    return minhash_near_duplicates(documents(spark, folder))
