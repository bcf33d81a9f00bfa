from marginalia.sources import archives
from marginalia.streaming import ingest


def test_update_stream_equals_one_batch(spark, tmp_path):
    rows = [(f"s{i % 5}", f"t{i % 3}", f"c{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, ingest.DATASET)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ingest.DATASET).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.update_dataset(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(df.distinct()).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.distinct().count()


def test_a_source_may_come_in_several_batches(spark, tmp_path):
    rows = [("s", "t", f"c{i}") for i in range(4)] + [("r", None, "c"), ("r", None, "c")]
    df = spark.createDataFrame(rows, ingest.DATASET)
    for i in range(3):
        spark.createDataFrame(rows[i::3], ingest.DATASET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.read.schema(ingest.DATASET).parquet(str(tmp_path / "out"))
    stream = spark.readStream.schema(ingest.DATASET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.update_dataset(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert read().exceptAll(df.distinct()).count() == 0 and read().count() == 5
    # a later run adds nothing to sources that the table has, and whole new sources
    spark.createDataFrame([("s", "t", "late"), ("new", "t", "a"), ("new", "t", "b")], ingest.DATASET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.update_dataset(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    assert read().count() == 7 and read().where("source_id = 's'").count() == 4


def test_moving_is_taken_up_again(spark, tmp_path):
    out = tmp_path / "out"
    spark.createDataFrame([("a", "t", "1")], ingest.DATASET).write.parquet(str(out))
    spark.createDataFrame([("b", "t", "2")], ingest.DATASET).write.parquet(str(out / "_run" / "batch-0"))
    (out / "_run" / "_ENDED").write_text("")
    ingest._publish(spark, str(out))
    ingest._publish(spark, str(out))
    assert sorted(r.source_id for r in spark.read.schema(ingest.DATASET).parquet(str(out)).collect()) == ["a", "b"] and not (out / "_run").exists()


def test_archive_stream(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("1.tar", "2.TAR", "x.txt"):
        (tmp_path / "a" / n).write_bytes(b"broken")
    seen = []
    q = ingest.archive_stream(spark, str(tmp_path / "a"), 1).writeStream.foreachBatch(lambda b, _: seen.append(archives.untar(b).count())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [1, 1]
