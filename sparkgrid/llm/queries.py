"""Queries of the text operators over the ``documents`` table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sparkgrid.llm import (
    conversations, distinct_bpe, exact_dedup, mixing, near_dedup, neighbours, quality, secret_scan, sharding, spelling,
    token_counts, token_files, toxicity,
)
from sparkgrid.llm.common import documents
from sparkgrid.session import stage

QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_mixing(spark, sf_dir):
    columns = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    return mixing.mix(columns).drop("text")


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text")).drop("text")


SQL["op3_exact_dedup"] = """
with d as (select doc_id, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, cast(count(*) over (partition by t) as bigint) group_size,
  doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d
"""


@query
def op9_sharding(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir, "doc_id", "text"))


@query
def op1_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score_documents(documents(spark, sf_dir, "doc_id", "text"), labels)
    return scored.select("row.doc_id", "held_out", "score", "predicted")


@query
def op4_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), path)
    return counted.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op5_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = distinct_bpe.encode_and_decode(
        documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN)
    return decoded.withColumnRenamed("id", "doc_id")


@query
def op6_token_files(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    digests = token_files.token_file_digests(documents(spark, sf_dir, "doc_id", "text"), path)
    return digests.withColumnRenamed("id", "doc_id")


@query
def op10_minhash_near_dedup(spark, sf_dir):
    found = near_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op7_quality_rules(spark, sf_dir):
    judged = quality.judge(documents(spark, sf_dir, "doc_id", "lang", "text"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "class_distance", "word_distance")


@query
def op8_secret_scan(spark, sf_dir):
    found = secret_scan.scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op11_hnsw_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index = stage(neighbours.build_index(vectors), "index")
    return neighbours.search(index, vectors.where("vec_id % 100 = 0"))


@query
def op12_conversation_repair(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(conversations.damaged(turns), present=F.col("present"))


@query
def op13_spelling_variants(spark, sf_dir):
    counts = spelling.word_counts(documents(spark, sf_dir, "doc_id", "text"), misspell=True)
    return spelling.spelling_variants(counts)


# All pairs of sets with a common shingle, and the reach of each document over the links.
SQL["op10_minhash_near_dedup"] = """
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce("text", ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
  where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id, doc_id reached from w union select r.doc_id, e.b from r join e on e.a = r.reached)
select w.doc_id, coalesce(n.n, 0) n_shingles, m.component_id, w.doc_id = m.component_id kept
  from w left join n on n.doc_id = w.doc_id join (select doc_id, min(reached) component_id from r group by 1) m
  on m.doc_id = w.doc_id
"""
