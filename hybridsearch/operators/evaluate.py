"""Evaluation of retrieved ids against expected ones, by array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_eval_id

HIT_AT, RANK_AT = 3, 5
# What a result set should reach (percent, mean reciprocal rank, seconds).
TARGETS = {"hit_rate_3": 80.0, "mrr_5": 0.7, "avg_latency": 5.0}


def _ids(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_eval_id)


def hit_at_k(retrieved: Column, expected: Column, k: int = HIT_AT) -> Column:
    """Whether one of the first k retrieved ids is expected; years do not matter."""
    return F.coalesce(F.arrays_overlap(F.slice(_ids(retrieved), 1, k), _ids(expected)), F.lit(False))


def reciprocal_rank(retrieved: Column, expected: Column, k: int = RANK_AT) -> Column:
    """1 / rank of the first expected id among the first k, else 0."""
    wanted = _ids(expected)
    ranks = F.filter(F.transform(F.slice(_ids(retrieved), 1, k), lambda r, i: F.when(F.array_contains(wanted, r), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def evaluate(results: DataFrame) -> DataFrame:
    """``total, hit_rate_3, mrr_5, avg_latency`` of ``results(expected_standards, retrieved_standards, latency_seconds)``; no row without results."""
    retrieved, expected = F.col("retrieved_standards"), F.col("expected_standards")
    return results.agg(
        F.count("*").alias("total"),
        (100.0 * F.avg(hit_at_k(retrieved, expected).cast("double"))).alias("hit_rate_3"),
        F.avg(reciprocal_rank(retrieved, expected)).alias("mrr_5"),
        F.avg(F.coalesce("latency_seconds", F.lit(0.0))).alias("avg_latency"),
    ).where("total > 0")


def latency_summary(results: DataFrame) -> DataFrame:
    """``steady_latency``: the mean without the first query (``seq`` 0), to three decimals; 0 if there is no other."""
    return results.where("seq > 0").agg(F.round(F.coalesce(F.avg(F.round("latency_seconds", 3)), F.lit(0.0)), 3).alias("steady_latency"))


def meets_targets(metrics: DataFrame) -> DataFrame:
    """``metrics`` compared with the targets."""
    return metrics.select(
        (F.col("hit_rate_3") > TARGETS["hit_rate_3"]).alias("hit_rate_ok"), (F.col("mrr_5") > TARGETS["mrr_5"]).alias("mrr_ok"), (F.col("avg_latency") < TARGETS["avg_latency"]).alias("latency_ok")
    )
