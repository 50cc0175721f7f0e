"""The queries of this package over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import centroids, exact, fim, html, jaccard, language, lines, pack, pii, quality, secrets, simhash, tokenize
from lexforge.runtime import table, texts

#: The setting that holds the key of the pseudonyms, and the key of a session that has none: an example, known to all.
PII_SETTING, PII_KEY = "spark.lexforge.pii.key", "lexforge example key"
END_OF_TEXT = 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return tokenize.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Not spread: larger partitions pack better.
    return pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_OF_TEXT)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(texts(spark, sf_dir).select("doc_id", "text"), spark.conf.get(PII_SETTING, PII_KEY).encode())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(texts(spark, sf_dir), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(texts(spark, sf_dir))


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    found = quality.base_statistics(texts(spark, sf_dir).select("doc_id", "text")).withColumn("base_failed", quality.base_failed())
    return found.drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return language.identify(docs, columns=["doc_id"])


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(texts(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(texts(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(texts(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(texts(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_byte_bpe, op2_best_fit_packing, op3_line_dedup, op4_pii, op5_exact_dedup, op6_quality_rules, quality_base_statistics, op7_language_id, op8_secret_scans, op9_html_extraction, op10_ngram_jaccard, op11_fill_in_middle, op12_centroid_clustering, op13_simhash)
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.OP3_SQL, "op5_exact_dedup": exact.OP5_SQL, "quality_base_statistics": quality.OP6_BASE_SQL, "op8_secret_scans": secrets.OP8_SQL, "op10_ngram_jaccard": jaccard.OP10_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_centroid_clustering": centroids.OP12_SQL}
