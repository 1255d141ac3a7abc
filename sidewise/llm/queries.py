"""One query per operator over the given tables, and plain SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.llm import ann, chat, exactdedup, fim, languageid, neardup, packing, pii, tokenfiles, variants, vectors, warc, wordbpe
from sidewise.plans.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its plain-SQL counterpart if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    r"""with turns as (select distinct conv_id, turn, role, text from conversations),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as p from turns),
    whole as (
        select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by p) as said,
            string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by p) as rendered
        from placed group by conv_id),
    single as (
        select min(conv_id) as conv_id, n_turns, said, any_value(rendered) as rendered, count(*) as copies
        from whole group by n_turns, said)
    select conv_id, n_turns, copies, rendered from single a where not exists (
        select 1 from single b where b.said[1] = a.said[1] and b.n_turns > a.n_turns and b.said[1:a.n_turns] = a.said)"""
)
def op1_maximal_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, folder, "conversations"))


@query()
def op2_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, keep_ids=False)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        F.col("sequence_id").cast("long").alias("sequence_id"), "offset",
    )


@query()
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_path(spark, "tokens")
    tokenfiles.write_token_files(table(spark, folder, "documents"), target, vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenfiles.read_token_files(spark, target)


@query(
    """select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
        row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
        sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))"""
)
def op8_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = exactdedup.find_exact_duplicates(table(spark, folder, "documents"), carry=False)
    return found.decisions.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(
        F.col("c0").alias("doc_id"),
        *[pii.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"),
        pii.described(F.col("spans")).alias("spans"),
    )


@query()
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents")).drop("row")


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = languageid.learn(docs, may_learn=~held_out)
    return languageid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score")
    )


@query(
    """with v as (
        select distinct vec_id, [floor(256 * x::double)::bigint for x in embedding] as vec from embeddings
        where vec_id is not null and len(embedding) > 0
            and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)),
    scored as (
        select q.vec_id as query_id, c.vec_id, list_inner_product(q.vec::double[], c.vec::double[])::bigint as score
        from v q join v c on q.vec_id != c.vec_id and len(q.vec) = len(c.vec) where q.vec_id % 50 = 0)
    select query_id, rank::int as rank, vec_id, score from (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
    where rank <= 5"""
)
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


@query()
def op5_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = wordbpe.encode_decode(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.withColumnRenamed("id", "doc_id")


@query(
    """with p as (select page_id, coalesce(html, '') as body from pages),
    d as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as payload_digest, body from p),
    r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by body) else page_id end as response from d)
    select page_id, payload_bytes, payload_digest, case when response = page_id then 'response' else 'revisit' end as record_type,
        case when response != page_id then response end as refers_to from r"""
)
def op6_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_path(spark, "warc")
    archives = warc.write_archives(table(spark, folder, "pages"), target)
    captures = warc.read_archives(spark, target, archives)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
    drawn as (
        select doc_id, t, string_split(t, chr(10)) as lines, len(string_split(t, chr(10))) - 1 as whole,
            ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
            ('0x' || h[25:32])::bigint as h4 from d),
    counted as (select *, whole + case when t = '' or ends_with(t, chr(10)) then 0 else 1 end as n from drawn),
    placed as (
        select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                when h4 % 100 < 50 then 'spm' else 'psm' end as form from counted),
    cuts as (
        select *, case when a > whole then t when a = 0 then '' else array_to_string(lines[1:a], chr(10)) || chr(10) end as first,
            case when b > whole then t when b = 0 then '' else array_to_string(lines[1:b], chr(10)) || chr(10) end as upto from placed),
    parts as (
        select doc_id, t, n, form, first as prefix, substr(upto, length(first) + 1) as middle, substr(t, length(upto) + 1) as suffix
        from cuts)
    select doc_id, n::bigint as n, form, case when form != 'plain' then length(prefix) end as prefix_chars,
        case when form != 'plain' then length(middle) end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(t) as restored_sha256 from parts"""
)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query()
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)


@query()
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants_of_corpus(table(spark, folder, "documents"), least_length=7, least_count=2, typo_every=31)
