import uuid

from pyspark.sql import functions as F

from tidewell.sources import snapshots
from tidewell.sources.tables import shared_dir
from tidewell.streaming import feeds

ROW = "key long, value double, vsn int, time long"


def _stream(spark, df, name):
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), f"{path}-checkpoint"


def test_change_feed_reaches_the_table(spark):
    old = spark.createDataFrame([(1, 1.0, 2, 1), (2, 2.0, 2, 1), (3, 3.0, 2, 1)], ROW)
    new = spark.createDataFrame([(1, 1.5, 3, 9), (3, 3.0, 2, 1), (4, 4.0, 2, 9)], ROW)
    events = feeds.change_events(old, new, "t").withColumn("time", F.lit(9).cast("long"))
    assert {(r.op, r.key) for r in events.collect()} == {("update", 1), ("delete", 2), ("insert", 4)}
    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    snapshots.snapshot(old, root)
    stream, checkpoint = _stream(spark, events, "events")
    feeds.apply_changes(stream, root, checkpoint).awaitTermination()
    assert {(r.key, r.value) for r in snapshots.load(spark, root).collect()} == {(1, 1.5), (3, 3.0), (4, 4.0)}


def test_sessions_and_windows(spark):
    updates = spark.createDataFrame([("s", "a", "1", 1, 5), ("s", "a", "3", 3, 4), ("s", "a", "2", 2, 9)], "session string, attr string, value string, vsn int, time long")
    stream, _ = _stream(spark, updates, "updates")
    q = feeds.latest_attributes(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT session, attr, value, vsn FROM latest").collect()] == [("s", "a", "3", 3)]
    samples = spark.sql("SELECT timestamp_seconds(id * 20) AS ts, 'k' AS key, id AS value FROM range(30)")
    stream, _ = _stream(spark, samples, "samples")
    q = feeds.metric_windows(stream, "ts", "1 minute", "0 seconds").writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r.total) for r in spark.sql("SELECT * FROM windows WHERE start = timestamp_seconds(0)").collect()} == {(3, 3)}


def test_log_index_and_retention(spark):
    logs = spark.sql("SELECT id AS doc_id, timestamp_seconds(1700000000 + id * 86400) AS ts, map('k', CAST(id % 3 AS STRING)) AS data FROM range(30)")
    stream, checkpoint = _stream(spark, logs, "logs")
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    feeds.index_logs(stream, root, checkpoint).awaitTermination()
    posts = spark.read.parquet(f"{root}/batch=*/postings")
    assert posts.filter("token = '2'").count() == 10 and {"iso_year", "iso_week"} <= set(posts.columns)
    assert feeds.expired(logs, 1440, 10).count() == 20
