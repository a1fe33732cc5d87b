"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import table
from lantern.llm.langid import identify_languages
from lantern.llm.lengths import length_histogram, suffix_sums, token_counter
from lantern.llm.licenses import FAMILIES, license_templates, scan_licenses
from lantern.llm.mixing import mix_counts
from lantern.llm.neardup import near_duplicates
from lantern.llm.ngram_join import jaccard_components
from lantern.llm.packing import pack
from lantern.llm.quality import fit_quality, score_quality
from lantern.llm.runs import find_runs, planted, run_digest
from lantern.llm.secrets import scan_secrets, span_digest
from lantern.llm.sharding import assign_shards, topology
from lantern.llm.spelling import group_variants, word_counts
from lantern.llm.topk import integer_vectors, top_k
from lantern.llm.twins import RUNS_SQL, SPELLING_SQL, secrets_sql


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    # The tables have no addresses: the source is the host, its language section the path.
    scored = score_quality(docs, model, F.col("source"), F.col("lang"), keep=["doc_id", "source", "lang"])
    return scored.select("row.doc_id", "row.source", "row.lang", "text_p", "host_p", "path_p", "quality_p", "quality_keep")


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), topology(8))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, sf_dir, "documents")))


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies", "source")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, length=token_counter(docs)(F.col("text")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), license_templates(), families=FAMILIES, spdx=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(table(spark, sf_dir, "documents"), edit=planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    finite = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    return {
        "op1_exact_top_k": f"""
            with v as (select distinct vec_id, [floor(256 * cast(x as double)) for x in embedding] as ints from embeddings where {finite} and vec_id is not null),
            s as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.ints, v.ints) as bigint) as score
                  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
            from s qualify rank <= 5""",
        "op2_embedding_near_dedup": f"""
            with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where {finite} and label is not null
                                 and list_inner_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
            links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
                                   where list_cosine_similarity(a.e, b.e) >= 0.93),
            reach as (select vec_id as n, vec_id as m from embeddings union select r.n, l.b from reach r join links l on l.a = r.m),
            c as (select n, min(m) as component_id from reach group by n)
            select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
            from embeddings e join c on c.n = e.vec_id""",
        "op8_ngram_jaccard_join": r"""
            with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
            sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                     else list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) end as s from w),
            tok as materialized (select doc_id, len(s) as n, hash(unnest(s)) as t from sets),
            links as materialized (select a.doc_id as a, b.doc_id as b from tok a join tok b on a.t = b.t and a.doc_id <> b.doc_id
                                   group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
            reach as (select doc_id as n, doc_id as m from documents union select r.n, l.b from reach r join links l on l.a = r.m),
            c as (select n, min(m) as component_id from reach group by n)
            select s.doc_id, len(s.s) as n_shingles, c.component_id from sets s join c on c.n = s.doc_id""",
        "op11_spelling_variants": SPELLING_SQL,
        "op12_secret_scan": secrets_sql(),
        "op13_periodic_runs": RUNS_SQL,
    }
