"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import ann, bpe, chat, collocations, html_extract, mixing, oracle, packing, simhash, toxicity, url_filter, vector_dedup, warc, whitening
from cellwise.llm.store import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_chat_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover_held_out(_table(spark, sf_dir, "conversations"))


#: The rules of op2: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query
def op2_redirect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


@_query
def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query
def op7_sign_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op8_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where(ann.is_query(vectors["vec_id"], 20)))


@_query
def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op10_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op11_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = whitening.whole_numbers(_table(spark, sf_dir, "embeddings"))
    rows = keep(whitening.whiten(numbers, whitening.fit(numbers)), "whitened")
    error = whitening.identity_errors(rows).agg(F.max("identity_error")).first()[0]
    entries = rows.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "entry"))
    return entries.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "entry.whitened", "entry.explained", F.lit(error).cast("double").alias("identity_error"))


@_query
def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


SQL |= {"op2_redirect_components": oracle.OP2, "op7_sign_hash_dedup": oracle.OP7, "op9_systematic_mix": oracle.OP9, "op10_warc_dictionary": oracle.OP10, "op13_trie_collocations": oracle.OP13}
