"""The registered queries: each operator on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import decontam, langid, licenses, pieces, pii, simhash, substrings, topk, toxicity, warczip
from gapwright.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered PII query; a deployment passes its own.
PII_KEY = "registered-query"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, PII_KEY, counts_col="found")
    total = F.aggregate(F.map_values("found"), F.lit(0), lambda a, b: a + b)
    return found.select("doc_id", "text", F.coalesce(total, F.lit(0)).alias("n_found"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.label(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warczip.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), h as (
  select page_id, octet_length(payload)::bigint as payload_bytes, lower(sha1(payload)) as hex from p
), f as (
  select *, min(page_id) over (partition by hex) as first from h
)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4)::int)) & 31), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from f
"""


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_passages(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), pieces.load())


OP9_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), win as (
  select rid, doc_id, p, array_to_string(w[p:p + 49], ' ') as s
  from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) as p from d where doc_id is not null)
), lost as (
  select rid, p from (select rid, doc_id, p, min(doc_id) over (partition by s) as first from win) where doc_id > first
), gone as (
  select distinct rid, unnest(range(p, p + 50)) as i from lost
), per as (
  select rid, list(i) as gone from gone group by rid
)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(case when gone is null then w else
         list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' '), '')) as kept_sha256
from d left join per using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_decontamination": op2_decontamination,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_pii_pseudonyms": op4_pii_pseudonyms,
        "op5_toxicity": op5_toxicity,
        "op6_language_id": op6_language_id,
        "op7_warc_zip": op7_warc_zip,
        "op8_exact_topk": op8_exact_topk,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_zip": OP7_SQL, "op8_exact_topk": OP8_SQL, "op9_substring_dedup": OP9_SQL}
