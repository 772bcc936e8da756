"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import crc_fold, table


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mtree

    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bitplane

    return bitplane.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.detect(docs, labels, crc_fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A source's domain, and the target weights of each level, in SQL that both engines read.
DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'web' WHEN source IN ('src4', 'src5', 'src6', 'src7', 'src8') THEN 'books' WHEN source = 'unknown' THEN 'none' ELSE 'forums' END"
WEIGHTS = {
    "domain": "CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 35 WHEN 'forums' THEN 24 ELSE 1 END",
    "language": "CASE language WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 9 ELSE 1 END",
    "source": "CASE source WHEN 'src0' THEN 3 WHEN 'src19' THEN 0 ELSE 2 END",
}


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN), {k: F.expr(w) for k, w in WEIGHTS.items()})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, crc_fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linedup

    return linedup.repeated_lines(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamerly

    return hamerly.report(hamerly.cluster(table(spark, sf_dir, "embeddings")), spark)


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pagetext

    return pagetext.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mtree_top_k, op2_token_planes, op3_ngram_jaccard, op4_toxicity, op5_suffix_dedup, op6_decontaminate, op7_mix_sources, op8_language_id, op9_line_dedup, op10_secret_scan, op11_source_divergence, op12_centroid_clusters, op13_page_text)}
ORACLES: dict[str, str] = {"op7_mix_sources": oracles.mix_sources(DOMAIN, WEIGHTS), "op9_line_dedup": oracles.LINE_DEDUP, "op1_mtree_top_k": oracles.TOP_K, "op11_source_divergence": oracles.SOURCE_DIVERGENCE, "op12_centroid_clusters": oracles.centroid_clusters()}
