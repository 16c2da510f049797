"""Streaming: files as they arrive, tables kept up to date, event-time sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from organelia.operators.dml import BUCKETS, change_keyed, replace_rows


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def ingest(
    stream: DataFrame, table: str, by: Sequence[str], checkpoint: str, change: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] = replace_rows, buckets: int = BUCKETS
) -> StreamingQuery:
    """Apply what has arrived to a table that is kept by key (``dml.read_keyed``), and stop.

    A batch reads and writes only the parts of the table that its keys fall into. Changes go by key, so a batch
    that is run again after a failure makes a further version with the same content. Within a batch the last row
    of a key by ``loaded_at`` counts, of equal ones the greatest by all columns. One writer per table.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*by).agg(F.max(F.struct("loaded_at", F.struct(*batch.columns).alias("row"))).alias("r")).select("r.row.*")
        change_keyed(spark, table, last, by, change, buckets)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n_events): events of a key that follow each other within the gap.

    On a stream, ``late`` is how long late events are waited for. Works on tables and streams alike.
    """
    d = events.where(F.col(time).isNotNull())
    if late is not None:
        d = d.withWatermark(time, late)
    w = F.session_window(time, gap)
    return d.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def last_values(events: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value of each key: a fold over a log in which the later line wins."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
