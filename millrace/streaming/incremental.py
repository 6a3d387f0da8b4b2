"""Incremental runs as streams: the state of a queue, change detection, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_folder, dropped, pinned


def stream(spark: SparkSession, folder: str, schema, files_at_once: int = 8, names: str = "*") -> DataFrame:
    """Parquet files of a folder whose names match, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", names).parquet(folder)


def run_once(df: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame:
    """Processes all that is there and stops; the result, or what ``each`` wrote, survives a restart by its checkpoint.

    Without ``each``, the rows go to a Parquet table beside the checkpoint, which is read back.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/stream-{name}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return df
    writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def latest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): that of the last event of a key; on a stream the state of each key, in update or complete mode."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """At-least-once input made exactly-once: repeats of the keys within the lateness go, state is bounded by it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """(window_start, by..., n): counts over tumbling windows, closed once the watermark has passed them."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def state(spark: SparkSession, table: str) -> DataFrame:
    """(rel, hash, seq): the last content of each file that ``changed_only`` wrote to ``table``."""
    return spark.read.parquet(f"{_states(table)}/{_newest(spark, table)}")


def _states(table: str) -> str:
    return f"{table.rstrip('/')}-state"


def _newest(spark: SparkSession, table: str, before: int | None = None) -> int | None:
    """The highest number of a finished state below ``before``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = path(_states(table))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    numbers = [int(f.getPath().getName()) for f in store.listStatus(folder) if store.exists(path(f.getPath(), "_SUCCESS"))]
    return max((n for n in numbers if before is None or n < before), default=None)


def changed_only(table: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: files (rel, hash, seq) whose content is new or changed go to ``table``/batch=number, a Parquet folder each.

    Beside it, in ``table``-state, a folder for each number holds the last content of each file, so a batch reads one state and not all
    earlier batches; older states go. A batch that is repeated after a crash writes the folders of its own
    number again, from the state before it, so nothing doubles.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = pinned(batch.groupBy("rel").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq")))
        last = _newest(spark, table, number)
        old = None if last is None else spark.read.parquet(f"{_states(table)}/{last}").select("rel", F.col("hash").alias("old"), F.col("seq").alias("old_seq"))
        if old is None:
            new, now = own, own
        else:
            both = pinned(own.join(old, "rel", "full"))
            newer = F.col("seq").isNotNull() & (F.col("old_seq").isNull() | (F.col("seq") > F.col("old_seq")))
            new = both.filter(newer & ~F.col("hash").eqNullSafe(F.col("old"))).select("rel", "hash", "seq")
            now = both.select("rel", F.when(newer, F.col("hash")).otherwise(F.col("old")).alias("hash"), F.when(newer, F.col("seq")).otherwise(F.col("old_seq")).alias("seq"))
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")
        now.write.mode("overwrite").parquet(f"{_states(table)}/{number}")
        if last is not None and (older := _newest(spark, table, last)) is not None:
            dropped(spark, f"{_states(table)}/{older}")

    return upsert
