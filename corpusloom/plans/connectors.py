"""Registered queries over sources, sinks, checks and numeric transforms that the other catalogs don't reach."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import align, corpus
from corpusloom.plans import build, recordings
from corpusloom.plans.catalog import QUERIES, SEGMENTS, WORDS, query, read, segments, words
from corpusloom.sources import readers, schemas, sinks, sqlite


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; of a local session a temporary one. It goes when the session ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.gettempdir()
    at = f"{at.rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


@query(f"with w as ({WORDS}) select doc_id::integer as surah, (word % 7 + 1)::integer as ayah, word, (doc_id * 1000 + word)::integer as word_id, text from w")
def keyed_words_scan(spark, d):
    w = words(spark, d)
    entry = F.struct(F.concat_ws(":", "doc_id", F.col("word") % 7 + 1, "word").alias("key"), F.struct((F.col("doc_id") * 1000 + F.col("word")).cast("int").alias("id"), "text").alias("value"))
    odd = F.array(F.struct(F.lit("1:2").alias("key"), F.struct(F.lit(0).alias("id"), F.lit("too short a key").alias("text")).alias("value")))
    objects = w.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.concat(F.collect_list(entry), odd))).alias("json"))
    return readers.keyed_words(readers.json_map(objects, "json", readers.WORD))


@query("select n_nationkey as id, 'a' || n_name as name_arabic, n_name as name_simple, lower(n_name) as name_english, n_regionkey as verses_count, case when n_regionkey > 2 then 'east' end as revelation_place, case when n_nationkey % 3 = 1 then 0 else 1 end as bismillah_pre from nation")
def chapters_scan(spark, d):
    n = read(spark, d, "nation")
    flag = F.when(F.col("n_nationkey") % 3 == 1, False).when(F.col("n_nationkey") % 3 == 2, True)  # else missing
    value = F.struct(
        F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.col("n_name").alias("name_simple"), F.concat(F.lit("a"), "n_name").alias("name_arabic"),
        F.when(F.col("n_regionkey") > 2, "east").alias("revelation_place"), F.col("n_regionkey").alias("verses_count"), flag.alias("bismillah_pre"), F.lit(5).alias("revelation_order"),
    )
    objects = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), value)))).alias("json"))
    return readers.chapters(readers.json_map(objects, "json", readers.CHAPTER))


@query("select 'surah-' || n_nationkey as key, n_name as glyph from nation")
def flat_map_scan(spark, d):
    objects = read(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("surah-"), "n_nationkey"), "n_name")))).alias("json"))
    return readers.flat_map(readers.json_map(objects, "json", "string"))


@query("select r_regionkey, r_name from region")
def missing_file_guard(spark, d):
    schema = "r_regionkey int, r_name string"
    return readers.read_or_empty(spark, f"{d}/region.parquet", schema).union(readers.read_or_empty(spark, f"{d}/there_is_no_such_table.parquet", schema))


@query("select n_nationkey::bigint as n_nationkey, n_name from nation")
def sqlite_scan(spark, d):
    """The nations by way of a SQLite file: 25 rows at every size."""
    at = scratch(spark).removeprefix("file://")
    os.makedirs(at, exist_ok=True)
    with sqlite3.connect(f"{at}/nation.db") as con:
        con.execute("create table nation (n_nationkey integer primary key, n_name text not null, n_regionkey integer)")
        con.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in read(spark, d, "nation").collect()])
    con.close()
    return sqlite.read_sqlite(spark, f"{at}/nation.db", "nation", ["n_nationkey", "n_name"])


@query("select l_orderkey, l_linenumber, row_number() over () - 1 as row_index from lineitem")
def file_order(spark, d):
    return readers.in_file_order(spark, [f"{d}/lineitem.parquet"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_index")


def config_folders(spark: SparkSession, d: str) -> str:
    """A folder for each source of the documents, named moshaf_<source>, and one of metadata."""
    at = scratch(spark)
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("moshaf_"), "source").alias("config"))
    rows.write.partitionBy("config").parquet(f"{at}/data")
    rows.limit(1).select("doc_id").coalesce(1).write.parquet(f"{at}/data/moshaf_x/metadata")
    return f"{at}/data"


@query("select distinct 'moshaf_' || source as config from documents")
def config_discovery(spark, d):
    return readers.configs(spark, config_folders(spark, d))


@query("select config from (select distinct 'moshaf_' || source as config from documents) order by 1 limit 2")
def config_selection(spark, d):
    return recordings.chosen(readers.configs(spark, config_folders(spark, d)), "some", 2)


@query("select surah, ayah, phonemes from (select doc_id as surah, 1 as ayah, coalesce(case when quality = 1 then 'q' || toxic end, case when doc_id % 2 = 0 then source end) as phonemes from labels join documents using (doc_id)) where phonemes is not null")
def last_run_fallback(spark, d):
    both = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("surah"), F.lit(1).alias("ayah"), "quality", "toxic", "source")
    now = both.select("surah", "ayah", F.when(F.col("quality") == 1, F.concat(F.lit("q"), "toxic")).alias("phonemes"))
    return build.keep_last_run(now, both.where("surah % 2 = 0").select("surah", "ayah", F.col("source").alias("phonemes")))


@query("select * from (values " + ", ".join(f"({k.replace(':', ', ')}, '{v}')" for k, v in build.SPARE_PHONEMES.items()) + ") t(surah, ayah, phonemes)")
def spare_table(spark, d):
    return build.spare_phonemes(spark)


@query("""select 'not null is_centered' as rule, 0::bigint as n where false union all select 'not null line_type', count(*) from lineitem where l_linenumber = 3 having count(*) > 0
    union all select 'primary key', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) having count(*) > 0""")
def schema_violations(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("line_number"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("line_type"))
    return schemas.violations(schemas.conformed(rows, "pages"), "pages")


@query("select n_nationkey as id, n_name as name_arabic, n_name as name_simple, n_name as name_english, n_regionkey as verses_count, null as revelation_place, coalesce(nullif(n_nationkey % 2, 1), 1) as bismillah_pre from nation")
def conformed_table(spark, d):
    n = read(spark, d, "nation")
    name = F.col("n_name")
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), name.alias("name_arabic"), name.alias("name_simple"), name.alias("name_english"), F.col("n_regionkey").cast("string").alias("verses_count"), F.when(F.col("n_nationkey") % 2 == 0, 0).alias("bismillah_pre"))
    return schemas.conformed(rows, "surahs")


@query("select c_name as key, c_mktsegment as glyph from customer")
def written_table(spark, d):
    at = scratch(spark)
    sinks.write_table(read(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("glyph")), at, "ligatures")
    return spark.read.parquet(f"{at}/ligatures")


@query("""with s as (select '  ' || to_json(c_name) || ': ' || coalesce(to_json(case when c_custkey % 5 <> 0 then c_mktsegment end)::varchar, 'null') || case when c_name = (select max(c_name) from customer) then '' else ',' end as value from customer)
    select value from s union all select '{' union all select '}'""")
def json_map_sink(spark, d):
    rows = read(spark, d, "customer").select("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return sinks.json_map_lines(rows, "c_name", "segment").select("value")


@query("""with s as (select '[' || c_custkey || ',' || to_json(c_name) || ',[' || c_nationkey || ']]' || case when c_custkey = (select max(c_custkey) from customer) then '' else ',' end as value from customer)
    select value from s union all select '[' union all select ']'""")
def json_array_sink(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_name", F.array("c_nationkey").alias("nations"))
    return sinks.json_array_lines(rows, ["c_custkey", "c_name", "nations"], ["c_custkey"]).select("value")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id in (select vec_id from embeddings)")
def not_done_with_input(spark, d):
    return sinks.not_done(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"), "doc_id", read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("select distinct n_name as variant from nation where upper(n_name) = 'NATION_3' and n_nationkey in (select c_nationkey from customer)")
def variant_filter(spark, d):
    n = read(spark, d, "nation")
    there = n.join(read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return recordings.variants(n.select(F.col("n_name").alias("variant")), there.select(F.col("n_name").alias("variant")), "nation_3")


@query("""with s as (select source as variant, sum(octet_length(encode(text))) / 1e6 as size from documents group by 1), b as (select arg_min(size, variant) as base from s)
    select variant, round(size, 6) as size, round((1 - size / base) * 100, 6) as percent from s, b""")
def size_against_baseline(spark, d):
    sizes = read(spark, d, "documents").groupBy(F.col("source").alias("variant")).agg((F.sum(F.octet_length("text")) / 1e6).alias("size"))
    return recordings.against_baseline(sizes.withColumn("seq", F.col("variant"))).select("variant", F.round("size", 6).alias("size"), F.round("percent", 6).alias("percent"))


@query("select doc_id, (case when strpos(substr(text, 11), 'the') = 0 then -1 else strpos(substr(text, 11), 'the') + 9 end)::integer as at from documents where length(text) >= 10")
def find_text(spark, d):
    return read(spark, d, "documents").where(F.length("text") >= 10).select("doc_id", T.find(F.col("text"), F.lit("the"), F.lit(10)).alias("at"))


@query("select a.vec_id, len(a.embedding)::integer as n from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def same_size_check(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.where(V.same_size(F.col("a"), F.col("b")).isNull()).select("vec_id", F.size("a").alias("n"))


@query("""with q as (select vec_id, list_transform(embedding, lambda x: round_even(x::double / (list_max(list_transform(embedding, lambda y: abs(y::double))) / 127), 0)::integer) as q from embeddings)
    select vec_id, unnest(range(0, len(q)))::integer as place, unnest(q) as q from q""")
def quantized_vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(V.quantized(F.col("embedding"))).alias("place", "q"))


def palettized_vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", V.palettized(F.col("embedding"), 4).alias("values"))


def seeded_tensors(spark, d):
    return readers.seeded_tensor(spark, 249, 160)


def directory_size(spark, d):
    return readers.directory_size(spark, d)


def framed(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, frames): an embedding as eight frames of eight bins."""
    return read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8))).alias("frames"))


FRAMES = "select vec_id, k, b, embedding[k * 8 + b + 1]::double as x from embeddings, range(0, 8) t(k), range(0, 8) u(b)"


@query(f"with f as ({FRAMES}) select vec_id, k::integer as frame, b::integer as bin, round((x - avg(x) over w) / stddev_samp(x) over w, 6) as x from f window w as (partition by vec_id, b)")
def standardized_frames(spark, d):
    rows = framed(spark, d).select("vec_id", F.posexplode(V.standardized(F.col("frames"))).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.posexplode("f").alias("bin", "x")).select("vec_id", "frame", "bin", F.round("x", 6).alias("x"))


@query("select vec_id, k::integer as frame, b::integer as bin, embedding[k * 16 + b + 1]::double as x from embeddings, range(0, 4) t(k), range(0, 16) u(b)")
def stacked_frames(spark, d):
    rows = framed(spark, d).select("vec_id", F.posexplode(V.stacked(F.col("frames"))).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.posexplode("f").alias("bin", "x")).select("vec_id", "frame", "bin", F.col("x").cast("double").alias("x"))


@query("""with f as (select vec_id, k, list_position(embedding[k * 8 + 1:k * 8 + 8], list_max(embedding[k * 8 + 1:k * 8 + 8])) - 1 as c from embeddings, range(0, 8) t(k)),
    g as (select *, lag(c) over (partition by vec_id order by k) as before from f)
    select vec_id, coalesce(string_agg(c, ',' order by k) filter (c <> 0 and (before is null or before <> c)), '') as classes from g group by 1""")
def greedy_decoded(spark, d):
    return framed(spark, d).select("vec_id", F.array_join(V.greedy_decoded(F.col("frames")), ",").alias("classes"))


@query(f"with w as ({WORDS}) select doc_id, word, string_agg(text, ' ') over (partition by doc_id order by word rows between 3 preceding and 2 following) as context from w")
def context_windows(spark, d):
    return corpus.context(words(spark, d), ["doc_id"], 3, 2).select("doc_id", "word", F.array_join("context", " ").alias("context"))


@query("select conv_id, turn as word, gap from (select conv_id, turn, turn - lag(turn) over (partition by conv_id order by turn) - 1 as gap from conversations where length(text) % 3 <> 0) where gap > 0")
def skipped_positions(spark, d):
    return corpus.skipped(read(spark, d, "conversations").where(F.length("text") % 3 != 0).select("conv_id", F.col("turn").alias("word")), ["conv_id"])


def local_alignment(spark, d):
    """Each turn against the one before it in its conversation."""
    t = read(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("p"))
    both = t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", align.local(F.col("t"), F.col("p")).alias("z"))
    return both.select("conv_id", "turn", "z.*")


@query(f"""with s as ({SEGMENTS}), k as (select *, (turn // 4)::integer as verse from s where length(text) > 0 and turn % 6 <> 5),
    v as (select distinct role, conv_id, verse from k)
    select (select count(*) from conversations) as total, (select count(*) from conversations) - (select count(*) from k) as skipped, (select count(*) from k) as n_segments, (select count(*) from v) as n_verses""")
def recordings_summary(spark, d):
    c = segments(spark, d).withColumnRenamed("seq", "turn")
    verse = F.call_function("div", F.col("turn"), F.lit(4))
    at = lambda word: F.struct(F.col("conv_id").alias("sura_idx"), verse.alias("aya_idx"), word.alias("imlaey"))
    rows = c.select((F.col("turn") % 6 != 5).alias("has_quran"), at(F.col("w_start")).alias("start_span"), at(F.col("w_end")).alias("end_span"), "phonemes", "match_ratio", F.col("reciter").alias("reciter_english_name"), F.concat(F.lit("moshaf_"), "reciter").alias("config"), F.col("turn").alias("seq"))
    return recordings.summary(rows).select("total", "skipped", "n_segments", "n_verses")


#: Queries that SQL can't repeat: files' sizes, another engine's random numbers, and searches that carry a state.
for _f in (palettized_vectors, seeded_tensors, directory_size, local_alignment):
    QUERIES[_f.__name__] = _f
