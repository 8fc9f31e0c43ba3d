"""The queries of the thirteen operators."""

from __future__ import annotations

from tickloom.llm import (
    bpe, clustering, decontamination, language, lines, neardup, resampling, secrets, sharding, simhash, substrings,
    tokenfile, topk)
from tickloom.llm.common import table


def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("node")


def op2_lines(spark, sf_dir):
    return lines.deduplicated_lines(table(spark, sf_dir, "documents"))


def op3_bpe(spark, sf_dir):
    return bpe.encoded_documents(table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    return tokenfile.stored_documents(table(spark, sf_dir, "documents"))


def op5_substrings(spark, sf_dir):
    return substrings.deduplicated_documents(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return language.predicted_documents(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark, sf_dir):
    return neardup.classed_documents(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.scanned_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op10_top_k(spark, sf_dir):
    return topk.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op11_simhash(spark, sf_dir):
    return simhash.linked_documents(table(spark, sf_dir, "documents"))


def op12_clusters(spark, sf_dir):
    return clustering.clustered_vectors(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark, sf_dir):
    return resampling.resampled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_lines, op3_bpe, op4_token_files, op5_substrings, op6_language, op7_near_duplicates,
    op8_secrets, op9_sharding, op10_top_k, op11_simhash, op12_clusters, op13_resampling)}
SQL = {"op1_decontamination": decontamination.SQL, "op2_lines": lines.SQL, "op12_clusters": clustering.SQL}
