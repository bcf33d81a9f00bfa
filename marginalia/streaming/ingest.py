"""Micro-batch forms of the pipeline: windows of landed files, incremental datasets with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.tables import read_or_empty

DATASET = "source_id string, target_id string, context string"


def archive_stream(spark: SparkSession, folder: str, window: int = 100) -> DataFrame:
    """Landed archives as a stream, at most ``window`` files a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[tT][aA][rR]").option("maxFilesPerTrigger", window).load(folder)


def update_dataset(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Fold a stream of dataset rows into the table at path until the input is used up.

    What one run brings is one update: rows of sources that earlier runs have brought are left out, all different rows of
    the other sources are kept, in however many batches they come. Each batch is written once, as new files; the
    table is never rewritten. The run's files wait in ``_run`` (which readers of the table skip) and are moved into the table
    when the run has ended; a run that broke off goes on with its batches, or with the moving, when it is started again.
    """
    spark = stream.sparkSession
    run = f"{path}/_run"
    _publish(spark, path)
    if not _there(spark, f"{run}/sources/_SUCCESS"):
        read_or_empty(spark, path, DATASET).select("source_id").distinct().write.mode("overwrite").parquet(f"{run}/sources")

    def fold(batch: DataFrame, number: int) -> None:
        columns = ["source_id", "target_id", "context"]
        known = batch.sparkSession.read.schema("source_id string").parquet(f"{run}/sources")
        fresh = batch.select(*columns).join(known, "source_id", "left_anti").distinct()
        earlier = [f"{run}/batch-{b}" for b in _batches(spark, run) if b < number]
        if earlier:
            before = batch.sparkSession.read.schema(DATASET).parquet(*earlier)
            fresh = fresh.alias("n").join(before.alias("b"), [F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{run}/batch-{number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    _path(spark, f"{run}/_ENDED")[0].create(_path(spark, f"{run}/_ENDED")[1]).close()
    _publish(spark, path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _batches(spark: SparkSession, run: str) -> list[int]:
    fs, p = _path(spark, run)
    return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-"))


def _publish(spark: SparkSession, path: str) -> None:
    """Move the files of a run that has ended into the table; names are unique, so moving can be taken up again."""
    run = f"{path}/_run"
    if not _there(spark, f"{run}/_ENDED"):
        return
    fs, home = _path(spark, path)
    for number in _batches(spark, run):
        for s in fs.listStatus(_path(spark, f"{run}/batch-{number}")[1]):
            name = s.getPath().getName()
            if not name.startswith(("_", ".")) and not fs.rename(s.getPath(), _path(spark, f"{path}/{name}")[1]):
                raise OSError(f"{name} can't be moved")
    fs.delete(_path(spark, run)[1], True)


def copy_stream(stream: DataFrame, path: str, checkpoint: str, key: str | None = None, event_time: str | None = None, late: str = "30 days") -> None:
    """Append a stream to Parquet until the input is used up; with a key, rows of a key that came within ``late`` are dropped."""
    if key:
        stream = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_window(stream: DataFrame, event_time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, kind, n)`` by tumbling windows, late rows beyond the watermark dropped."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
