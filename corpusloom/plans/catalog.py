"""Registered queries of the core engine over the test tables, and the SQL that must agree with them.

Stand-ins: a document is a verse, its tokens are words, lines of ten words are page lines, letters are turned into
Arabic ones where a rule needs them, conversations are recorded segments, and labels are optional phonemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import align, corpus, stitch
from corpusloom.plans import recordings
from corpusloom.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LATIN, ARABIC = "abcdefgh0123456789", "آأإةىَٰۖ٠١٢٣٤٥٦٧٨٩"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{d}/{name}.parquet"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, word, text): tokens of the documents, numbered from 1."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("word", "text"))
    return rows.withColumn("word", F.col("word") + 1)


WORDS = "select doc_id, unnest(t) as text, unnest(range(1, len(t) + 1))::integer as word from (select doc_id, regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{85}\\x{A0}]+') as t from documents)"
CHARS = "select doc_id, unnest(t) as ch, unnest(range(0, len(t)))::integer as idx, len(t)::integer as n from (select doc_id, string_split(text, '') as t from documents where text <> '')"
TRANSLATED = f"translate(text, '{LATIN}', '{ARABIC}')"


@query(f"select doc_id, regexp_replace(translate({TRANSLATED}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\x{{064B}}-\\x{{065F}}\\x{{06D6}}-\\x{{06DC}}]', '', 'g') as normalized from documents")
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize(F.translate("text", LATIN, ARABIC)).alias("normalized"))


@query(f"with w as ({WORDS}) select doc_id, count(*) as n_words, count(*) filter (regexp_full_match({TRANSLATED}, '[\\x{{0660}}-\\x{{0669}}]+')) as n_markers from w group by 1")
def verse_marker_filter(spark, d):
    w = words(spark, d).withColumn("text", F.translate("text", LATIN, ARABIC))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(T.is_marker(F.col("text"))).alias("n_markers"))


@query(f"with w as ({WORDS}) select doc_id, string_agg(text, ' ' order by word) as text from w where not regexp_full_match({TRANSLATED}, '[\\x{{0660}}-\\x{{0669}}]+') group by 1")
def ordered_text_agg(spark, d):
    w = words(spark, d)
    return w.where(~T.is_marker(F.translate("text", LATIN, ARABIC))).transform(lambda x: corpus.verse_texts(x, ["doc_id"]))


@query(f"with c as ({CHARS}) select doc_id, idx, case when ch = ' ' then 0 else 1 + sum((ch = ' ')::integer) over (partition by doc_id order by idx) end::integer as word from c")
def char_word_index(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(align.word_index(F.col("text"))).alias("idx", "word"))


SEGMENTS = "select conv_id, turn, role, (turn * 5)::bigint as w_start, (turn * 5 + 1 + length(text) % 20)::bigint as w_end, text, length(text) % 7 / 8.0::double as ratio from conversations"


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    start = F.col("turn") * 5
    return c.select("conv_id", start.alias("w_start"), (start + 1 + F.length("text") % 20).alias("w_end"), F.col("text").alias("phonemes"), (F.length("text") % 7 / F.lit(8.0)).alias("match_ratio"), F.col("role").alias("reciter"), F.col("turn").alias("seq"))


@query(f"""
    with s as ({SEGMENTS}),
    c as (select *, greatest(0, coalesce(max(w_end) over (partition by conv_id order by w_start, turn rows between unbounded preceding and 1 preceding), 0)) as cov,
                 regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+') as t from s),
    k as (select *, case when w_end <= cov then [] when cov <= w_start then t when len(t) = w_end - w_start then t[(cov - w_start + 1):]
                 else t[((cov - w_start) * len(t) // (w_end - w_start) + 1):] end as part from c),
    g as (select conv_id, count(*) as n, avg(ratio) as match_ratio, arg_min(role, turn) as reciter, any_value(text) as single,
                 string_agg(array_to_string(part, ' '), ' ' order by w_start, turn) filter (len(part) > 0) as joined from k group by 1)
    select conv_id, n as n_segments, round(match_ratio, 6) as match_ratio, reciter, case when n = 1 then single else coalesce(joined, '') end as phonemes from g""")
def segment_stitch(spark, d):
    out = stitch.stitch(segments(spark, d), ["conv_id"])
    return out.select("conv_id", "n_segments", F.round("match_ratio", 6).alias("match_ratio"), "reciter", "phonemes")


@query("""
    with s as (select role, conv_id, (turn // 4)::integer as verse, turn, (turn * 5)::bigint as w_start, (turn * 5 + 1 + length(text) % 20)::bigint as w_end, text from conversations where length(text) > 0),
    c as (select *, greatest(0, coalesce(max(w_end) over (partition by role, conv_id, verse order by w_start, turn rows between unbounded preceding and 1 preceding), 0)) as cov,
                 regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{85}\\x{A0}]+') as t from s),
    k as (select *, case when w_end <= cov then [] when cov <= w_start then t when len(t) = w_end - w_start then t[(cov - w_start + 1):]
                 else t[((cov - w_start) * len(t) // (w_end - w_start) + 1):] end as part from c),
    g as (select role, conv_id, verse, case when count(*) = 1 then any_value(text) else coalesce(string_agg(array_to_string(part, ' '), ' ' order by w_start, turn) filter (len(part) > 0), '') end as phonemes from k group by 1, 2, 3)
    select conv_id::integer as surah, verse as ayah, phonemes, array_to_string(list_sort(list_distinct(list(role))), ',') as configs from g group by 1, 2, 3""")
def recordings_agreed(spark, d):
    verse = F.call_function("div", F.col("turn"), F.lit(4))
    at = lambda word: F.struct(F.col("conv_id").alias("sura_idx"), verse.alias("aya_idx"), word.alias("imlaey"))
    start = F.col("turn") * 5
    rows = read(spark, d, "conversations").select(
        F.lit(True).alias("has_quran"), at(start).alias("start_span"), at(start + 1 + F.length("text") % 20).alias("end_span"), F.col("text").alias("phonemes"), F.lit(1.0).alias("match_ratio"),
        F.col("role").alias("reciter_english_name"), F.concat(F.lit("moshaf_"), "role").alias("config"), F.col("turn").alias("seq"),
    )
    out = recordings.agreed(recordings.verses(recordings.segments(rows)))
    return out.select("surah", F.col("ayah_start").alias("ayah"), "phonemes", F.array_join("configs", ",").alias("configs"))


@query("select text, lang, array_to_string(list_sort(list_distinct(list(replace(source, 'src', '')))), ',') as configs from documents group by 1, 2")
def variant_dedup(spark, d):
    out = stitch.variants(read(spark, d, "documents"), ["text", "lang"], "source", "src")
    return out.select("text", "lang", F.array_join("configs", ",").alias("configs"))


@query("select c_custkey as word_id, c_name as text, glyph_text from customer left join (select o_custkey, arg_max(o_orderpriority, o_orderkey) as glyph_text from orders group by 1) on o_custkey = c_custkey")
def glyph_left_join(spark, d):
    items = read(spark, d, "customer").select(F.col("c_custkey").alias("word_id"), F.col("c_name").alias("text"))
    glyphs = read(spark, d, "orders").select(F.col("o_custkey").alias("word_id"), F.col("o_orderpriority").alias("glyph_text"), F.col("o_orderkey").alias("seq"))
    return corpus.with_glyphs(items, glyphs)


@query("""select coalesce(a.page_id, b.doc_id) as id, coalesce(a.html, '') as text, b.phonemes from pages a
    full join (select doc_id, quality || '-' || toxic as phonemes from labels) b on a.page_id = b.doc_id""")
def ayah_full_outer(spark, d):
    texts = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    phonemes = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat_ws("-", "quality", "toxic").alias("phonemes"))
    return corpus.verses_of(texts, phonemes, ["id"])


@query("select d.doc_id, coalesce(nullif(case when quality = 1 then 'q' || toxic else '' end, ''), source) as phonemes from documents d left join labels l on d.doc_id = l.doc_id")
def fallback_join(spark, d):
    gen = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("toxic"))).otherwise("").alias("gen"))
    return read(spark, d, "documents").join(gen, "doc_id", "left").select("doc_id", corpus.preferred(F.col("gen"), F.col("source")).alias("phonemes"))


@query("select user_id, event_type, value, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1")
def upsert_last_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "value", "event_id", "ts")
    return sinks.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


def lines(w: DataFrame) -> DataFrame:
    line = F.floor((F.col("word") - 1) / 10)
    return w.groupBy("doc_id", line.alias("line")).agg(F.min("word").alias("first_word_id"), F.max("word").alias("last_word_id"))


LINES = "select doc_id, (word - 1) // 10 as line, min(word) as first_word_id, max(word) as last_word_id from w group by 1, 2"


@query(f"with w as ({WORDS}), l as ({LINES}) select w.doc_id, w.word, l.line::bigint as line from w join l on w.doc_id = l.doc_id and w.word between l.first_word_id and l.last_word_id")
def page_range_join(spark, d):
    w = words(spark, d)
    return corpus.word_lines(lines(w), w.select("doc_id", "word", F.col("word").alias("word_id")), ["doc_id"]).select("doc_id", "word", "line")


@query(f"with w as ({WORDS}), l as ({LINES}) select doc_id, (line // 15)::bigint as page, min(first_word_id) as first_word, max(last_word_id) as last_word, count(*) as n_lines from l group by 1, 2")
def first_on_page(spark, d):
    page = F.floor(F.col("line") / 15)
    return lines(words(spark, d)).groupBy("doc_id", page.alias("page")).agg(F.min("first_word_id").alias("first_word"), F.max("last_word_id").alias("last_word"), F.count("*").alias("n_lines"))


@query(f"with w as ({WORDS}), l as ({LINES}) select w.doc_id, ((word - 1) // 25)::bigint as verse, min(line // 15)::bigint as page from w join l on w.doc_id = l.doc_id and word between first_word_id and last_word_id group by 1, 2")
def position_to_page(spark, d):
    w = words(spark, d)
    verses = w.select("doc_id", F.floor((F.col("word") - 1) / 25).alias("verse"), F.col("word").alias("word_id"))
    return corpus.word_lines(lines(w), verses, ["doc_id"]).groupBy("doc_id", "verse").agg(F.min(F.floor(F.col("line") / 15)).alias("page"))


@query("""
    with r as (select doc_id, unnest(t) as ch, unnest(range(0, len(t))) as idx from (select doc_id, string_split(text, '') as t from documents where text <> '')),
    m as (select doc_id, unnest(t) as ch, unnest(range(0, len(t))) as idx from (select doc_id, string_split(replace(text, 'e ', ' e'), '') as t from documents where text <> '')),
    mk as (select doc_id, idx as place, row_number() over (partition by doc_id order by idx) - 1 as k from m where ch <> ' '),
    ends as (select doc_id, max(place) + 1 as after from mk group by 1),
    rk as (select *, sum((ch <> ' ')::integer) over (partition by doc_id order by idx) - (ch <> ' ')::integer as k from r)
    select r.doc_id, r.idx::integer as idx, coalesce(place, after, 0)::integer as pos
    from rk r left join mk on mk.doc_id = r.doc_id and mk.k = r.k left join ends on ends.doc_id = r.doc_id""")
def raw_to_merged(spark, d):
    moved = align.offsets(F.col("text"), F.replace("text", F.lit("e "), F.lit(" e")))
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.slice(moved, F.lit(1), F.length("text"))).alias("idx", "pos"))


@query(f"""
    with c as (select doc_id, idx, ch, case when idx % 3 = 0 then 1 + idx // 9 % 7 end as minw from ({CHARS}) where ch <> ' '),
    k as (select *, coalesce(last_value(minw ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and current row), 0) as w from c),
    p as (select *, lag(w, 1, 0) over (partition by doc_id order by idx) as prev from k)
    select doc_id, string_agg(case when w > prev and prev > 0 then ' ' || ch else ch end, '' order by idx) as text from p group by 1""")
def boundary_reinsert(spark, d):
    least = F.transform(places(F.length("text")), lambda i: F.when(i % 3 == 0, 1 + F.call_function("div", i, F.lit(9)) % 7).cast("int"))
    docs = read(spark, d, "documents").where(F.replace("text", F.lit(" "), F.lit("")) != "")
    return docs.select("doc_id", align.reinserted(F.col("text"), least).alias("text"))


def places(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


MAPPED = f"select doc_id, idx, ch, idx as ph_start, least(idx + idx % 3, n)::integer as ph_end, (idx % 3 = 0)::integer as deleted, (idx // 10 + 1)::integer as word from ({CHARS})"


def word_pairs(docs: DataFrame) -> DataFrame:
    """docs, and `pairs` of (phoneme_word, text_word): a character makes the phonemes from its place to that of the next one or two, ten
    characters are a word, and seven phonemes one of theirs."""
    each = lambda f: F.transform("i", f)
    rows = docs.select("*", F.length("text").alias("n"), places(F.length("text")).alias("i"))
    under = [F.col("i"), each(lambda i: F.least(i + i % 3, F.col("n"))), each(lambda i: (i % 3 == 0).cast("int")), each(lambda i: (F.call_function("div", i, F.lit(10)) + 1).cast("int"))]
    tokens = F.transform(places(F.ceil(F.col("n") / 7).cast("int")), lambda k: F.struct((k * 7).alias("start"), (k * 7 + 7).alias("end")))
    return rows.select(*docs.columns, align.word_map(tokens, *under).alias("pairs"))


@query(f"""
    with m as ({MAPPED}), c as (select distinct doc_id, word, unnest(range(ph_start, ph_end)) as ph from m where deleted = 0 and ph_end > ph_start)
    select distinct doc_id, (ph // 7 + 1)::integer as phoneme_word, word as text_word from c""")
def word_map_pairs(spark, d):
    return align.rows_from(word_pairs(read(spark, d, "documents")), ["doc_id"], "pairs")


@query("""
    with t as (select doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from documents),
    u as (select doc_id, unnest(t) as tok, unnest(range(1, len(t) + 1))::integer as word from t)
    select doc_id, word, (sum(length(tok) + 1) over (partition by doc_id order by word) - length(tok) - 1)::integer as start, (sum(length(tok) + 1) over (partition by doc_id order by word) - 1)::integer as "end" from u""")
def token_spans(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\\s+", " ").alias("s"))
    return rows.select("doc_id", F.posexplode(align.token_spans(F.col("s"))).alias("word", "x")).select("doc_id", (F.col("word") + 1).alias("word"), "x.start", "x.end")


@query(f"""
    with w as ({WORDS}), f as (select doc_id, word, text, starts_with(text, 'T') or starts_with(text, 'th') as hit from w),
    g as (select doc_id, list(text order by word) as t, coalesce(min(word) filter (not hit) - 1, count(*)) as n from f group by 1)
    select doc_id, case when n <= 1 then array_to_string(t, ' ') else array_to_string(list_concat([array_to_string(t[1:n], '')], t[n + 1:]), ' ') end as merged from g""")
def prefix_run_merge(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", T.merge_leading(F.col("t"), ["T", "th"]).alias("merged"))


@query("""
    with p as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select vec_id, round(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) as max_abs, round(list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) as mean_abs,
      round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-12), 6) as cosine, (list_position(a, list_max(a)) - 1)::integer as argmax from p""")
def vector_compare(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b_ = F.col("a"), F.col("b")
    return e.join(b, "vec_id").select("vec_id", F.round(V.max_abs(a, b_), 6).alias("max_abs"), F.round(V.mean_abs(a, b_), 6).alias("mean_abs"), F.round(V.cosine(a, b_), 6).alias("cosine"), V.argmax(a).alias("argmax"))


@query("""
    with p as (select a.label, list_position(a.embedding, list_max(a.embedding)) = list_position(b.embedding, list_max(b.embedding)) as same from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select label, round(avg(same::integer) * 100, 6) as agreement from p group by 1""")
def argmax_agreement(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", V.argmax(F.col("embedding")).alias("i"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("i").alias("j"))
    return e.join(b, "vec_id").groupBy("label").agg(F.round(F.avg((F.col("i") == F.col("j")).cast("int")) * 100, 6).alias("agreement"))


@query("""select 'documents' as name, count(*) as n, count(distinct source) as n_distinct, count(lang) as n_known from documents
    union all select 'lineitem', count(*), count(distinct l_suppkey), count(l_returnflag) from lineitem union all select 'events', count(*), count(distinct user_id), count(value) from events""")
def table_stats(spark, d):
    def one(name: str, distinct: str, known: str) -> DataFrame:
        return read(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"), F.count(known).alias("n_known")).select("name", "n", "n_distinct", "n_known")

    return one("documents", "source", "lang").union(one("lineitem", "l_suppkey", "l_returnflag")).union(one("events", "user_id", "value"))


@query("select event_id, (props::json ->> 'k')::integer as v from events where props::json ->> 'k' is not null")
def keyed_json_scan(spark, d):
    e = readers.json_map(read(spark, d, "events"), "props", "int", ["event_id"])
    return e.where("key = 'k' and value is not null").select("event_id", F.col("value").alias("v"))


@query(f"with w as ({WORDS}), l as ({LINES}) select doc_id, line::bigint as line, first_word_id, last_word_id from l where line // 15 = 1")
def page_lines_lookup(spark, d):
    return lines(words(spark, d)).where(F.floor(F.col("line") / 15) == 1)


@query("select source from (select distinct source from documents) order by 1 limit 5")
def limit_sorted(spark, d):
    return read(spark, d, "documents").select("source").distinct().orderBy("source").limit(5)


@query("select o_orderkey as surah, unnest(range(1, 1 + (o_orderkey % 4)::integer))::integer as ayah from orders where o_orderkey % 4 >= 1")
def verse_generator(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("verses_count"))
    return readers.verses(o)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def not_done(spark, d):
    return sinks.not_done(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"), "doc_id")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def key_check(spark, d):
    from corpusloom.sources.schemas import duplicates

    return duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
    with w as ({WORDS}), a as (select doc_id, word, {TRANSLATED} as text from w)
    select doc_id, word, text, regexp_replace(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\x{{064B}}-\\x{{065F}}\\x{{06D6}}-\\x{{06DC}}]', '', 'g') as normalized_text
    from a where not regexp_full_match(text, '[\\x{{0660}}-\\x{{0669}}]+')""")
def plain_words(spark, d):
    w = words(spark, d).withColumn("text", F.translate("text", LATIN, ARABIC))
    return corpus.plain_words(w, ["doc_id", "word"])


@query(f"""
    with m as ({MAPPED}), c as (select distinct doc_id, word, unnest(range(ph_start, ph_end)) as ph from m where deleted = 0 and ph_end > ph_start and doc_id in (select doc_id from labels)),
    f as (select distinct doc_id, (ph // 7 + 1)::integer as phoneme_word, word as text_word from c),
    n as (select doc_id, len(regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+'))::integer as n from documents)
    select * from f union all select doc_id, unnest(range(1, n + 1))::integer, unnest(range(1, n + 1))::integer from n where n > 0 and doc_id not in (select doc_id from f)""")
def word_map_or_identity(spark, d):
    docs = read(spark, d, "documents")
    known = read(spark, d, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    rows = docs.join(known, "doc_id", "left").select("doc_id", F.when(F.col("known"), F.col("text")).alias("text"), F.size(T.tokens(F.col("text"))).alias("words"))
    rows = word_pairs(rows).select("doc_id", align.or_identity(F.col("pairs"), F.col("words")).alias("pairs"))
    return align.rows_from(rows, ["doc_id"], "pairs")


@query(f"""
    with w as ({WORDS}), t as (select doc_id, string_agg(text, ' ' order by word) as s, list(text order by word) as g from w group by 1),
    u as (select doc_id, unnest(g) as tok, unnest(range(0, len(g)))::integer as group_idx from t)
    select doc_id, group_idx, tok as group_text, (sum(length(tok) + 1) over (partition by doc_id order by group_idx) - length(tok) - 1)::integer as ph_start,
      (sum(length(tok) + 1) over (partition by doc_id order by group_idx) - 1)::integer as ph_end from u""")
def group_spans(spark, d):
    rows = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("g")).where(F.size("g") > 0)
    rows = rows.select("doc_id", "g", align.spans(F.array_join("g", " "), F.col("g"), 1).alias("x"))
    each = F.transform(F.arrays_zip("g", "x"), lambda z, i: F.struct(i.alias("group_idx"), z["g"].alias("group_text"), z["x"]["start"].alias("ph_start"), z["x"]["end"].alias("ph_end")))
    return align.rows_from(rows.select("doc_id", each.alias("z")), ["doc_id"], "z")


@query(f"select doc_id, regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')[1] as first_word, length(regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')[1]) <= 6 and regexp_full_match(translate(regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')[1], 'ThereoandOfit', 'المصركهيعطسحق'), '{T.OPENING_LETTERS}') as opening from documents")
def opening_words(spark, d):
    first = F.get(T.tokens(F.col("text")), 0)
    return read(spark, d, "documents").select("doc_id", first.alias("first_word"), T.is_opening(F.translate(first, "ThereoandOfit", "المصركهيعطسحق")).alias("opening"))
