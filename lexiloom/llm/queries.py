"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, flac, idfiles, licenses, minhash, packing, pieces, pii, quality, simhash, tries, warc
from .common import read_table


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_piece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(read_table(spark, sf_dir, "documents"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.id_file_round_trip(read_table(spark, sf_dir, "documents"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op10_flac_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_round_trip(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.mixed_trie(read_table(spark, sf_dir, "conversations"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_fingerprints,
        op2_license_digests,
        op3_personal_data,
        op4_quality_scores,
        op5_piece_n_best,
        op6_token_id_files,
        op7_simhash_near_duplicates,
        op8_best_fit_packing,
        op9_warc_chunk_table,
        op10_flac_blocks,
        op11_byte_bpe,
        op12_conversation_trie,
        op13_centroid_clusters,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_license_digests": licenses.oracle_sql()}
