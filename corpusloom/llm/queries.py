"""Queries that apply each operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, mixing, ngram_join, packing, quality_model, quality_rules, sharding, substring_dedup, tokens, topk
from corpusloom.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(key: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Domains of the labels table, and the token shares that op4 asks for.
DOMAINS = ["clean", "low", "toxic"]
SHARES = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents."""
    kind = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", kind.alias("domain"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=1024, end_id=0))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), fold("id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer(), limit=1024)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domains_of(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, DOMAINS, mixing.shares_of(SHARES, DOMAINS))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), length=50)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=SHARDS, seed=SEED)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


QUERIES = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_topk": op6_topk,
    "op7_sharding": op7_sharding,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_model": op9_quality_model,
    "op10_quality_rules": op10_quality_rules,
}
SHARDS, SEED = 40, 7


def _network(source: str) -> str:
    """SQL of one pass of the network over (num, x, a, b): (num, at, a, b)."""
    sql = f"(select num, a, b, x // b as l, x % b as r from {source})"
    for k, (times, more) in enumerate(sharding.round_keys(SEED)):
        kept, moved, side = ("r", "l", "a") if k % 2 else ("l", "r", "b")
        p = sharding.PRIME
        z = f"(select *, (({kept} % {p}) * {times} + {more}) % {p} as z from {sql})"
        sql = f"(select num, a, b, {kept}, ({moved} + (z * z + z * 3 + {kept}) % {p}) % {side} as {moved} from {z})"
    return f"(select num, l * b + r as pos, a, b from {sql})"


_COMMON = " ".join(f"when lang = '{name}' then {words!r}" for name, words in quality_rules.COMMON_WORDS.items())
_ALL = repr(quality_rules.ALL_WORDS)
ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": f"""
        with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        f as (select doc_id, lang, t, w, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, length(t) as n_all, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as upper,
                     length(regexp_replace(t, '[^0-9]+', '', 'g')) as digits, length(regexp_replace(t, '[^!-/:-@\\[-`{{-~]+', '', 'g')) as marks from d),
        g as (select doc_id, p, w[p + 1:p + 5] as x from (select doc_id, w, unnest(range(0, len(w) - 4)) as p from f where len(w) >= 5)),
        r as (select doc_id, count(distinct p + k)::bigint as n_repeat_words from (select doc_id, p, count(*) over (partition by doc_id, x) as c from g), range(0, 5) t(k) where c > 1 group by 1),
        h as (select doc_id, lang, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_all,
                     [upper, digits, n_all - word_chars, n_symbols, greatest(marks - n_symbols, 0), greatest(n_all - upper - digits - (n_all - word_chars) - marks, 0)]::double[] as chars,
                     case {_COMMON} else ['', ''] end as list, w from f),
        c as (select * exclude (list, w), case when list[1] = '' then [len(list_filter(w, lambda x: list_contains({_ALL}, x)))] else list_transform(list, lambda y: len(list_filter(w, lambda x: x = y))) end::double[] as own from h),
        s as (select *, list_transform(chars, lambda x: x / nullif(list_sum(chars), 0)) as pc, list_transform(list_append(own, n_words - list_sum(own)), lambda x: x / nullif(n_words, 0)) as pw from c),
        e as (select lang, 'c' as kind, 6 as width, unnest(range(1, 7)) as k, unnest(pc) as x from s where n_words > 0 union all select lang, 'w', len(pw), unnest(range(1, len(pw) + 1)), unnest(pw) from s where n_words > 0),
        own as (select lang, kind, width, list(x order by k) as q from (select lang, kind, width, k, avg(x) as x from e where lang is not null group by 1, 2, 3, 4) group by 1, 2, 3),
        every as (select kind, width, list(x order by k) as q from (select kind, width, k, avg(x) as x from e group by 1, 2, 3) group by 1, 2),
        m as (select s.*, coalesce(oc.q, ac.q) as qc, coalesce(ow.q, aw.q) as qw from s left join own oc on oc.lang = s.lang and oc.kind = 'c' left join every ac on ac.kind = 'c'
              left join own ow on ow.lang = s.lang and ow.kind = 'w' and ow.width = len(s.pw) left join every aw on aw.kind = 'w' and aw.width = len(s.pw)),
        j as (select m.*, r.n_repeat_words, qw[-1] as rest,
                     sqrt(greatest(list_sum(list_transform(list_zip(pc, qc), lambda z: (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end + case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end) / 2)), 0)) as jc,
                     sqrt(greatest(list_sum(list_transform(list_zip(pw, qw), lambda z: (case when z[1] > 0 then z[1] * log2(2 * z[1] / (z[1] + z[2])) else 0 end + case when z[2] > 0 then z[2] * log2(2 * z[2] / (z[1] + z[2])) else 0 end) / 2)), 0)) as jw
              from m left join r using (doc_id)),
        v as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed,
                     case when n_all >= {quality_rules.MIN_CHARS} then coalesce(jc, 0) end as char_distance, case when n_words >= {quality_rules.MIN_WORDS} then coalesce(jw, 0) end as word_distance,
                     case when rest is null or rest > {1 - quality_rules.LEAST_COMMON} then {quality_rules.MAX_WORD_DISTANCE}
                          else least({quality_rules.MAX_WORD_DISTANCE}, {quality_rules.WITHOUT_WORDS} * sqrt((log2(2 / (1 + rest)) + case when rest > 0 then rest * log2(2 * rest / (1 + rest)) else 0 end + 1 - rest) / 2)) end as word_limit from j)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(char_distance, 0) <= {quality_rules.MAX_CHAR_DISTANCE} and coalesce(word_distance, 0) <= word_limit as kept,
          round(char_distance, 6) as char_distance, round(word_distance, 6) as word_distance from v
    """,
    "op7_sharding": f"""
        with recursive t as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
        h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        y as (select doc_id, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as y from h),
        c as (select doc_id, (len(y) + {sharding.OVERHEAD})::bigint as size, xor(list_reduce(list_prepend(4294967295::bigint, y), lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1])), 4294967295)::bigint as text_crc32 from y, t),
        g as materialized (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as num, count(*) over () as n from c),
        e as (select *, floor(sqrt(n - 1))::bigint + 1 as a from g),
        s as (select num, num as x, a, (n + a - 1) // a as b from e),
        w as (select num, pos, a, b from {_network("s")} union all select num, pos, a, b from {_network("(select num, pos as x, a, b from w where pos >= (select count(*) from documents)) v")})
        select doc_id, size, text_crc32, num as row_number, 'rows' as law, (pos % {SHARDS})::integer as shard, pos // {SHARDS} as slot, null::integer as grown_shard from g join w using (num) where pos < n
    """,
    "op6_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
                   where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
              from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op8_ngram_join": """
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as t from documents),
        s as (select doc_id, list_distinct(case when len(t) >= 3 then list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])
                                                when len(t) > 0 then [array_to_string(t, ' ')] else [] end) as x from w),
        e as (select doc_id, len(x) as n, unnest(x) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p where 100 * c >= 90 * (na + nb - c)),
        r(node, reached) as (select doc_id, doc_id from s union select r.node, l.b from r join l on l.a = r.reached)
        select s.doc_id, any_value(len(s.x))::bigint as n_shingles, min(r.reached) as component_id from s join r on r.node = s.doc_id group by 1
    """,
    "op5_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
        s as (select doc_id, p, substr(h, 2 * p + 1, 100) as x from (select doc_id, h, unnest(range(0, n - 49)) as p from d where n >= 50)),
        f as (select x, min(doc_id) as least from s group by 1),
        hit as (select distinct doc_id, p from s join f using (x) where least < doc_id),
        gone as (select distinct doc_id, p + k as p from hit, range(0, 50) t(k)),
        runs as (select doc_id, count(*) as n_removed, count(*) filter (before is null or before < p - 1) as n_spans from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from gone) group by 1),
        b as (select doc_id, p, substr(h, 2 * p + 1, 2) as x from (select doc_id, h, unnest(range(0, n)) as p from d where doc_id in (select doc_id from gone))),
        kept as (select doc_id, string_agg(x, '' order by p) as h from b anti join gone using (doc_id, p) group by 1)
        select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
          sha256(unhex(case when n_removed is null then d.h else coalesce(kept.h, '') end)) as kept_sha256 from d left join runs using (doc_id) left join kept using (doc_id)
    """,
}
