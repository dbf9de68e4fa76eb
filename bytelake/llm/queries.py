"""The queries of this package, with production parameters, over whole tables; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm import bpecount, collision, ctw, impact, langid, lenpack, linededup, simhash, spm, warczip
from bytelake.llm.shared import table

BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    """Where the public vocabularies are installed; a parameter of the operators, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_scores(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warczip.warc_round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impact_top_k(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.token_counts(table(spark, sf_dir, "documents"), tokenizer(BPE_FILE))


def op8_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.collision_neighbours(table(spark, sf_dir, "embeddings"))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenpack.pack(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"), tokenizer(PIECE_FILE), keep_ids=False)


QUERIES = {f.__name__: f for f in (op1_simhash_neardup, op2_ctw_scores, op3_line_dedup, op4_language_id, op5_warc_zip, op6_impact_topk, op7_token_counts, op8_collision_ann, op9_length_packing, op10_sentencepiece)}

SQL = {
    "op3_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
often as (select key, max(doc_id) last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) n_lines, count(*) filter (where lost) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) kept_sha256
from (select k.*, coalesce(doc_id <> last_doc, false) lost from k left join often using (key)) group by doc_id""",
    "op5_warc_zip": """
with p as (select page_id, encode(coalesce(html, '')) b from pages), h as (select *, sha1(b) d, min(page_id) over (partition by b) least from p)
select page_id, octet_length(b) payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8)))::bigint & 31)::int, 1) for i in range(32)], '') payload_digest,
       case when page_id = least then 'response' else 'revisit' end record_type, case when page_id <> least then least end refers_to
from h""",
    "op6_impact_topk": """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] q from embeddings where embedding is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding])),
s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
