"""The registered queries over the corpus tables, each with the production parameters of its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import encode_bpe
from larkspur.llm.circulant import near_duplicates
from larkspur.llm.hard_negatives import hard_negatives
from larkspur.llm.langid import language_of_documents
from larkspur.llm.media import media_columns
from larkspur.llm.ngram_join import ngram_join
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality import quality_scores
from larkspur.llm.resampling import resample
from larkspur.llm.sharding import shard_rows
from larkspur.llm.topk import top_k
from larkspur.llm.toxicity import toxicity_scores
from larkspur.llm.url_filter import PATH, filter_urls, host_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_bpe(table(spark, sf_dir, "documents"), *vocabulary, keep=["doc_id"], bytes_col="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and paths of ``pages``.

    By hash, two fifths of the hosts are added, some removed, some added again; a seventh of the hosts has a folder
    listed, half of those until some day; an eleventh of the pages is listed by its whole path; and one domain.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hashed = lambda df: df.distinct().withColumn("h", F.conv(F.substring(F.md5("value"), 1, 4), 16, 10).cast("int"))
    turn = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    made = lambda df, kind, turns: df.select(F.lit(kind).alias("kind"), "value", F.explode(F.array_compact(F.array(*turns))).alias("t")).select("kind", "value", "t.action", "t.at")
    host, h = host_of(F.col("url")), F.col("h")
    hosts = hashed(pages.select(host.alias("value")).filter("value <> ''"))
    first = h % 200
    domains = made(
        hosts.filter("h % 5 < 2"), "domain", [turn("add", first), F.when(h % 3 == 0, turn("remove", first + 40 + h % 50)), F.when(h % 9 == 0, turn("add", first + 150))]
    )
    folders = made(
        hosts.filter("h % 7 = 3").withColumn("value", F.concat("value", F.lit("/en/"))), "prefix", [turn("add", h % 150), F.when(h % 2 == 0, turn("remove", h % 150 + 60))]
    )
    paths = hashed(pages.select(F.concat(host, F.regexp_extract("url", PATH, 1)).alias("value")).filter("value <> ''"))
    whole = made(paths.filter("h % 11 = 0"), "prefix", [turn("add", first)])
    one = pages.sparkSession.sql("select * from values ('domain', 'example.net', 'add', 100), ('domain', 'example.net', 'remove', 130) as t(kind, value, action, n)")
    return domains.unionByName(folders).unionByName(whole).unionByName(one.select("kind", "value", "action", day(F.col("n")).alias("at")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))"))
    return filter_urls(captures, dated_list(pages)).select("page_id", "host", "fetched_at", "blocked", "n_entries", "entry", "listed_since")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", F.lower(F.hex("text_key")).alias("text_md5"), "keep")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_top_k": op10_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resampling": op12_resampling,
    "op13_near_duplicates": op13_near_duplicates,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
        with read as (
            select page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
                lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1), '')) as host
            from pages
        ), captures as (
            select row_number() over () as r, page_id, path, host, cast(date '2024-01-01' + cast(page_id % 366 as integer) as date) as fetched_at from read
        ), hosts as (
            select distinct host as value, cast('0x' || substr(md5(host), 1, 4) as integer) as h from captures where host <> ''
        ), paths as (
            select distinct host || path as value, cast('0x' || substr(md5(host || path), 1, 4) as integer) as h from captures where host || path <> ''
        ), turns as (
            select 'domain' as kind, value, true as listed, date '2024-01-01' + h % 200 as dated from hosts where h % 5 < 2
            union all select 'domain', value, false, date '2024-01-01' + (h % 200 + 40 + h % 50) from hosts where h % 5 < 2 and h % 3 = 0
            union all select 'domain', value, true, date '2024-01-01' + (h % 200 + 150) from hosts where h % 5 < 2 and h % 9 = 0
            union all select 'prefix', value || '/en/', true, date '2024-01-01' + h % 150 from hosts where h % 7 = 3
            union all select 'prefix', value || '/en/', false, date '2024-01-01' + (h % 150 + 60) from hosts where h % 7 = 3 and h % 2 = 0
            union all select 'prefix', value, true, date '2024-01-01' + h % 200 from paths where h % 11 = 0
            union all select 'domain', 'example.net', true, date '2024-01-01' + 100
            union all select 'domain', 'example.net', false, date '2024-01-01' + 130
        ), states as (
            select kind, value, dated, bool_or(listed) as listed from turns group by all
        ), changes as (
            select * from (select *, coalesce(lag(listed) over (partition by kind, value order by dated), false) as before from states) where listed <> before
        ), intervals as (
            select kind, value, dated as valid_from, valid_to from (select *, lead(dated) over (partition by kind, value order by dated) as valid_to from changes) where listed
        ), looked as (
            select c.r, c.fetched_at, 'domain' as kind, list_aggregate(list_slice(string_split(c.host, '.'), i, 99), 'string_agg', '.') as value
            from captures c, unnest(generate_series(1, len(string_split(c.host, '.')))) as t(i) where c.host <> ''
            union
            select c.r, c.fetched_at, 'prefix', c.host || list_aggregate(list_slice(string_split(c.path, '/'), 1, i), 'string_agg', '/') || '/'
            from captures c, unnest(generate_series(1, len(string_split(c.path, '/')) - 1)) as t(i) where c.host <> ''
            union
            select r, fetched_at, 'prefix', host || path from captures where host <> ''
        ), hits as (
            select r, count(*) as n, min({'value': l.value, 'since': i.valid_from}) as least
            from looked l join intervals i on l.kind = i.kind and l.value = i.value and l.fetched_at >= i.valid_from and (i.valid_to is null or l.fetched_at < i.valid_to)
            group by r
        )
        select page_id, host, fetched_at, n is not null as blocked, coalesce(n, 0) as n_entries,
            least['value'] as entry, cast(least['since'] as date) as listed_since
        from captures left join hits using (r)
    """,
    "op10_top_k": """
        with vectors as (
            select vec_id, min(list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint))) as v
            from embeddings
            where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            group by vec_id
        ), scored as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from vectors q join vectors c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
    """,
    "op11_hard_negatives": """
        with vectors as (
            select vec_id, min({'label': cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as varchar),
                'v': list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint))}) as x
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            group by vec_id
        ), scored as (
            select q.vec_id as anchor_id, c.vec_id, q.x['label'] = c.x['label'] as same,
                cast(list_sum(list_transform(list_zip(q.x['v'], c.x['v']), lambda p: p[1] * p[2])) as bigint) as score
            from vectors q join vectors c on q.vec_id <> c.vec_id
            where q.vec_id % 100 = 0
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score
            from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from scored where same) where r <= 5
        ), ranked as (
            select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
                row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
            from positives p join scored s on p.anchor_id = s.anchor_id
            where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
        )
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
    """,
    "op12_resampling": r"""
        with recursive steps as (
            select list(c order by b) as step from (
                select b, list_reduce(list_prepend(b, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
                from (select unnest(range(256))::bigint as b)
            )
        ), texts as (
            select 'd' as side, row_number() over () as r, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark
        ), split as (
            select side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts
        ), words as (
            select side, r, word, count(*) as n from (select side, r, unnest(words) as word from split) group by 1, 2, 3
        ), spelt as (
            select word, hex(encode(word)) as h from (select distinct word from words)
        ), buckets as (
            select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from spelt, steps
        ), counts as (
            select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from words join buckets using (word) group by 1
        ), gains as (
            select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from counts
        ), weights as (
            select r, sum(n) as n, sum(n * gain) as weight from words join buckets using (word) join gains using (bucket) where side = 'd' group by 1
        ), scored as (
            select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
                (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296::double))))::bigint as score
            from split left join weights using (r) where side = 'd'
        ), ranked as (
            select *, row_number() over (order by n_features < 20, score desc, doc_id nulls last) as place, count(*) filter (n_features >= 20) over () as fit from scored
        )
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= fit * 10 // 100 then place end as rank from ranked
    """,
    "op13_near_duplicates": r"""
        with recursive split as (
            select row_number() over () as r, doc_id,
                list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
            from documents
        ), placed as (
            select r, len(words) as n_words, unnest(words) as word, generate_subscripts(words, 1) as i from split
        ), runs as (
            select r, n_words, i, concat_ws(' ', word, lead(word, 1) over w, lead(word, 2) over w, lead(word, 3) over w) as shingle from placed window w as (partition by r order by i)
        ), different as (
            select distinct r, shingle from runs where i = 1 or i <= n_words - 3
        ), each as (
            select r, shingle, count(*) over (partition by r) as n from different
        ), sizes as (
            select s.r, s.doc_id, coalesce(n, 0) as n from split s left join (select r, count(*) as n from different group by 1) using (r)
        ), links as (
            select a.r as a, b.r as b from each a join each b on a.shingle = b.shingle and a.r <> b.r and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
            group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reached as (
            select r as a, r as b from sizes union select reached.a, links.b from reached join links on reached.b = links.a
        ), components as (
            select a as r, min(doc_id) as component_id from reached join sizes on sizes.r = reached.b group by 1
        )
        select doc_id, n::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept from sizes join components using (r)
    """,
    "op9_ngram_join": r"""
        with recursive texts as (
            select doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as key from documents
        ), nodes as (
            select key, any_value(text) as text, min(doc_id) as least_id, count(*) as n_copies from texts group by 1
        ), split as (
            select key, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') as words from nodes
        ), placed as (
            select key, len(words) as n_words, unnest(words) as word, generate_subscripts(words, 1) as i from split
        ), runs as (
            select key, n_words, i, concat_ws(' ', word, lead(word, 1) over w, lead(word, 2) over w, lead(word, 3) over w, lead(word, 4) over w) as gram from placed window w as (partition by key order by i)
        ), different as (
            select distinct key, gram from runs where i = 1 or i <= n_words - 4
        ), each as (
            select key, gram, count(*) over (partition by key) as n from different
        ), links as (
            select a.key as a, b.key as b from each a join each b on a.gram = b.gram and a.key <> b.key and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
            group by a.key, b.key, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reached as (
            select key as a, key as b from nodes union select reached.a, links.b from reached join links on reached.b = links.a
        ), best as (
            select a as key, min({'none': least_id is null, 'id': coalesce(least_id, 0), 'key': b}) as best, min(least_id) as class_id from reached join nodes on nodes.key = b group by 1
        ), counts as (
            select a as key, count(*) as n_links from links group by 1
        )
        select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, n_copies, key as text_md5, key = best['key'] and doc_id is not distinct from class_id as keep
        from texts join nodes using (key) join best using (key) left join counts using (key)
    """,
}
