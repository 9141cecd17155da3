"""Requests and filter settings as streams.

Routing is a projection and runs on a stream as on a table. Filter settings are a stateful aggregation, the last cost by client and area,
which Spark keeps across batches; answers to spatial requests are worked batch by batch, exactly once for each batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def client_costs(settings: DataFrame) -> DataFrame:
    """(client_id, area, cost) so far, from a stream of (client_id, seq, area, cost); for update or complete mode."""
    return settings.groupBy("client_id", "area").agg(F.max_by("cost", "seq").alias("cost"))


def answer(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers of each batch of a request stream, written below `path` in a folder for each batch; a repeated batch replaces its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
