"""Append-only progress of routed batches as a stream, idempotent by case id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def follow_progress(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Every JSON line that appears under ``source`` goes to the Parquet folder ``table`` once by its
    case_id, whichever micro-batch it comes in: a batch leaves out what the folders of earlier batches
    hold, and one that is replayed after a failure overwrites its own folder. The first line of a
    case counts; lines without a case_id go nowhere."""
    from pyspark.errors import AnalysisException

    def append(rows: DataFrame, epoch: int) -> None:
        new = rows.filter("case_id is not null").dropDuplicates(["case_id"])
        try:
            stored = spark.read.parquet(table).filter(f"epoch < {epoch}").select("case_id")
        except AnalysisException:  # nothing is stored yet
            stored = None
        if stored is not None:
            new = new.join(stored, "case_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
