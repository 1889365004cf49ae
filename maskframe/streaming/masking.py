"""Masking as a stream: the same rows as in batch, since fakes need no state."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.hashing import SEED
from maskframe.functions.network import default_redact, target_key
from maskframe.operators import typed
from maskframe.operators.matching import match_signature


def mask_stream(stream: DataFrame, rules: Mapping[str, typed.Rule], seed: Column | str = SEED) -> DataFrame:
    """Mask a stream of typed rows; append mode, stateless."""
    return typed.mask(stream, rules, seed=seed)


def route_webhooks(signatures: DataFrame, endpoints: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: documents (doc_id, paths) with their endpoint, passed to ``sink``."""

    def route(batch: DataFrame, epoch: int) -> None:
        sink(match_signature(batch, signatures, endpoints), epoch)

    return route


def first_seen_targets(values: DataFrame, time_col: str, late: str = "1 hour") -> DataFrame:
    """Every redaction target once within the watermark: state is a row a target, dropped when late."""
    keyed = values.withColumn("target_key", target_key(F.col("section"), F.col("name"), F.col("value"))).where(default_redact(F.col("section"), F.col("name"), F.col("value")))
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["target_key"])


def windowed_stats(values: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, section, n, redacted) by event-time window; partial counts are kept by window and section."""
    redact = default_redact(F.col("section"), F.col("name"), F.col("value"))
    counted = values.withWatermark(time_col, late).groupBy(F.window(time_col, window), "section").agg(F.count("*").alias("n"), F.count_if(redact).alias("redacted"))
    return counted.select(F.col("window.start").alias("start"), "section", "n", "redacted")
