"""The queries of this subpackage, with the SQL that expresses them where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, documents
from .statements import clusters_sql, collocations_sql


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, n_tokens

    light = documents(spark, sf_dir).select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    out = mix_sources(light, text_col=None)
    return out.select("doc_id", "source", "n_tokens", F.round("exponent", 9).alias("exponent"), F.round("mix_weight", 9).alias("mix_weight"), F.round("quota", 3).alias("quota"), "copies")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii
    from .spans import listed

    found = find_pii(documents(spark, sf_dir))
    counts = [count_of("base", k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets
    from .spans import listed

    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of("spans", k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave_shards, sized

    light = sized(documents(spark, sf_dir)).select("doc_id", "source", "size", "text_crc32")
    return interleave_shards(light, text_col=None).select("doc_id", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_output

    return token_output(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exponion import clustered

    return clustered(documents(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_quality_classifier, op4_decontamination, op5_mixing, op6_pii, op7_secrets, op8_sharding, op9_minhash_dedup, op10_token_output, op11_centroid_clusters, op12_collocations, op13_packing)}

SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op11_centroid_clusters": clusters_sql(),
    "op12_collocations": collocations_sql(),
}
