"""Queries p2, p4, p5, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import clusters, mixing, spans, splits, tokens
from tidemark.llm import runs as run_ops
from tidemark.llm.sql import SQL  # noqa: F401
from tidemark.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped(read(spark, d, "recordings"), read(spark, d, "annotations"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(read(spark, d, "recordings"), read(spark, d, "annotations"), read(spark, d, "split_targets"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p2_splits(spark, d), read(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.grouped(clusters.cluster(read(spark, d, "cluster_windows")))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    windows = read(spark, d, "cluster_windows")
    return clusters.describe(windows, clusters.cluster(windows))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return run_ops.runs(read(spark, d, "seeds")).filter("n >= 2").select("seed_id", "first_pos", "last_pos")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return run_ops.runs(read(spark, d, "seeds"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p8_mix(spark, d), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.Shared(read(spark, d, "documents")).pairs()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.Shared(read(spark, d, "documents")).shares()


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p2_report, p4_found, p4_clusters, p5_found, p5_runs, p7_ids, p8_mix, p8_shares, p9_found, p9_shares)}
