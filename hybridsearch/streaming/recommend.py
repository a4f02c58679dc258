"""Queries that arrive as files are answered against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.retrieve import batch_retrieve
from ..sources.files import SearchIndex


def recommend_stream(
    spark: SparkSession, source: str, sink: str, checkpoint: str, store: SearchIndex, encode: Callable[[DataFrame], DataFrame], top_k: int = 5, available_now: bool = True
) -> StreamingQuery:
    """Read ``query_id, query`` JSON lines as they appear in ``source`` and write each batch's answers as Parquet below ``sink``.

    ``encode`` gives a batch's ``query_id, embedding``.  A batch's folder is named by its number and overwritten when
    the batch is run again, so every query is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        batch_retrieve(batch, store, encode(batch), top_k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    queries = spark.readStream.schema("query_id string, query string").json(source)
    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
