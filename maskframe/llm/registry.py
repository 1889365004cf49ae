"""The queries opN_<name> over the whole input tables, and their DuckDB SQL where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import bpe, decontaminate, lexical, negatives, ordinal, rules, secrets, simhash, suffixes, tokens, treebpe, urls, warc
from maskframe.llm.common import scratch_path, table

TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of smaller documents cover."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, with the tiles."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rule, else by its host's posterior."""
    return urls.verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by way of a blob ledger: a run over what came first, then one over all that scans
    only the blobs that the ledger lacks."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "ledger")
    secrets.scan(secrets.earlier(docs), path)
    return secrets.report(docs, path)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to wavelet matrix shards and read back."""
    return tokens.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document."""
    return ordinal.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the trees' verdict of every document."""
    return rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("margin")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record of every page, written and read back."""
    return warc.digests(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and the components of those within two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file and decoded again; digests of both."""
    return bpe.digests(table(spark, sf_dir, "documents"), TIKTOKEN, public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by its five nearest of the same label."""
    return negatives.contract(table(spark, sf_dir, "embeddings"))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word vocabulary as a tree and decoded again; digests of both."""
    return treebpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op12_tree_bpe": op12_tree_bpe, "op13_ranked_search": op13_ranked_search, "op8_warc": op8_warc, "op2_decontaminate": op2_decontaminate, "op6_ordinal_quality": op6_ordinal_quality, "op7_quality_rules": op7_quality_rules, "op3_url_reputation": op3_url_reputation, "op4_secret_ledger": op4_secret_ledger, "op9_simhash": op9_simhash, "op5_token_shards": op5_token_shards, "op1_suffix_dedup": op1_suffix_dedup, "op10_byte_bpe": op10_byte_bpe}
ORACLES = {"op11_hard_negatives": negatives.SQL, "op13_ranked_search": lexical.SQL, "op3_url_reputation": urls.sql(), "op4_secret_ledger": secrets.sql(), "op8_warc": warc.SQL}
