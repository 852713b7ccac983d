"""The log operators on streams of files. Event time is a TIMESTAMP in UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder


def file_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant; a local date-time is read in the session's time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_pending(attempts: DataFrame, gradings: DataFrame, grader: str) -> DataFrame:
    """New attempts that stand and have no standing grading under this grader (stream-static)."""
    done = gradings.filter(~F.col("failed") & ~F.col("deprecated") & (F.col("grader_model") == grader)).select(F.col("attempt_id").alias("id"))
    return attempts.filter(~F.col("agent_failed") & ~F.col("deprecated")).join(done.distinct(), "id", "left_anti")


def stream_dedupe(events: DataFrame, key: str, delay: str) -> DataFrame:
    """First arrival of each id; ids are remembered for ``delay`` of event time, later rows are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def running_waits(records: DataFrame) -> DataFrame:
    """Running seconds each attempt spent waiting on its provider."""
    return records.groupBy("attempt_id").agg(F.sum("delay_s").alias("wait_s"), F.count(F.lit(1)).alias("n_retries"))


def windowed_cost(calls: DataFrame, width: str, slide: str | None, delay: str) -> DataFrame:
    """Calls, tokens and cost per model and window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return calls.withWatermark("ts", delay).groupBy(w.alias("w"), "model").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("tokens"), F.sum("cost").alias("cost"))


def stall_sessions(calls: DataFrame, silence: str, delay: str) -> DataFrame:
    """Stretches of activity that a silence longer than the limit closed."""
    return calls.withWatermark("ts", delay).groupBy(F.session_window("ts", silence).alias("w"), "attempt_id").agg(F.count(F.lit(1)).alias("n_calls"))


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Runs a stream over what is there, in append mode, into a table of the shared folder."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    query = (df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _write_epoch(folder: str) -> Callable:
    def write(batch: DataFrame, epoch: int) -> None:
        # an epoch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    return write


def run_update(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Runs a stream in update mode; the latest epoch's row of each key is the state."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    query = (df.writeStream.outputMode("update").foreachBatch(_write_epoch(folder)).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    rest = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s")).select(*keys, "s.*")
