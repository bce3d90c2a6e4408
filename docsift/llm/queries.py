"""The registered queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, html_main, language, oracles, toxicity
from .centroids import centroid_clusters
from .collocations import collocations
from .common import bounded_batches, fold, load
from .embed_dedup import embedding_duplicates
from .neardup import near_duplicates
from .packing import pack
from .repeats import remove_repeats
from .sharding import kd_shards
from .url_tree import judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@_query("op9_kd_sharding")
def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes (law ``bytes``)."""
    return (kd_shards(load(spark, sf_dir, "documents"), 8)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


@_query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of at most 2048, by minimum bin slack."""
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the folds other than 2."""
    docs = load(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(F.col("doc_id")) != 2))
    return (language.predict(docs, model)
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
                    "lang_pred", "score", "rejected"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the folds other than 2."""
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.known_labels(load(spark, sf_dir, "labels")))
    return (toxicity.score(docs, model)
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
                    "score", "predicted"))


@_query("op7_minhash_dedup", oracles.MINHASH_DEDUP)
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, near-duplicates by 2-word shingles at 80 %."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=2, percent=80)


@_query("op10_substring_dedup", oracles.SUBSTRING_DEDUP)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that a smaller document has."""
    return remove_repeats(load(spark, sf_dir, "documents"), window=13, start=7, digest=True)


@_query("op1_hnsw")
def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each query (ids divisible by 100) among all embeddings."""
    vectors = load(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.index(vectors, 10), vectors.where(F.col("vec_id") % 100 == 0), 10)


@_query("op5_embedding_dedup", oracles.EMBEDDING_DEDUP)
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked at a cosine of 0.95."""
    return embedding_duplicates(load(spark, sf_dir, "embeddings"), 0.95)


@_query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = load(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.train(pages))


#: op11: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@_query("op11_url_filter", oracles.url_tree(URL_RULES))
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, by the longest rule that fits, else by its host's path-template tree."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).withColumn("purity", F.round("purity", 9))


@_query("op12_collocations", oracles.collocations(5, 100, 100, 2000))
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases."""
    return collocations(load(spark, sf_dir, "documents"), longest=5, least=100, percent=100, top=2000)


@_query("op13_centroids", oracles.centroids(8, 10, 64, 1024, "3"))
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 8 clusters, after 10 rounds."""
    return centroid_clusters(load(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64)


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
