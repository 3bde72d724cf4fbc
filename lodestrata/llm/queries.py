"""The queries of this package's operators, and SQL for those that it can express."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decision_list, jaccard, knn_quality, langid, license_scan, media_ts, packing, sharding, warc
from .common import pick

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    """Where the vocabulary file is; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(warc.with_revisits(table(spark, sf_dir, "pages")))
    return warc.records(warc.read_chunks(archive))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select("doc_id", bpe.digests_column(F.col("text"), vocabulary_path()).alias("d")).select("doc_id", "d.*")


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = knn_quality.held_out()
    scored = knn_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    stored = docs.select("doc_id", n_bytes.alias("n_bytes"), media_ts.media_column(F.col("text")).alias("media"))
    names = "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "random_access"
    return stored.select("doc_id", "n_bytes", media_ts.features_column(F.col("media")).alias("f")).select("doc_id", "n_bytes", *(f"f.{x}" for x in names))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out()
    found = langid.identify(table(spark, sf_dir, "documents"), learn=~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the licence scan finds in rewritten licences, one for each document."""
    return license_scan.scan_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_bpe, op3_decision_list, op4_jaccard_join, op5_packing, op6_quality_knn, op7_transport_stream, op8_byte_shards, op9_language_id, op10_license_digests, license_variants,
    )
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {1 + 10 * g}, 10) as bigint) >> {35 - 5 * i}) & 31 as bigint) + 1, 1)" for g in range(4) for i in range(8)
)
ORACLE_SQL = {
    "op1_warc": (
        "with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), t as (select h, max(page_id) as top from p group by h) "
        f"select page_id, cast(strlen(html) as bigint) as payload_bytes, {_BASE32.replace('substr(h', 'substr(p.h')} as payload_digest, "
        "case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to, true as digest_ok, url as target_uri "
        "from p join t on p.h = t.h"
    ),
    "op10_license_digests": license_scan.oracle(),
    "license_variants": license_scan.variants_oracle(),
}
