import os
import uuid

from pyspark.sql import functions as F

from tidewell.functions import scalars as S
from tidewell.operators import merge, search
from tidewell.sources import files, log_index
from tidewell.sources.tables import shared_dir

ROW = "key long, value double, vsn int, time long"


def test_log_index_in_batches(spark):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    schema = "token string, doc_id long"
    log_index.append(spark.createDataFrame([("disk", 1), ("error", 1), ("disk", 1), (None, 1)], schema), root)
    log_index.append(spark.createDataFrame([], schema), root)
    log_index.append(spark.createDataFrame([("disk", 2), ("fault", 2), ("disk", 1)], schema), root)

    def state():
        frequency = {r.token: r.frequency for r in log_index.dictionary(spark, root).collect()}
        both = {r.doc_id for r in log_index.boolean_search(spark, root, ("and", "disk", ("or", "error", "fault"))).collect()}
        wild = {r.doc_id for r in log_index.wildcard_search(spark, root, "$aul$").collect()}
        grams = log_index.grams(spark, root)
        return frequency, both, wild, grams.count() == grams.distinct().count()

    assert state() == ({"disk": 3, "error": 1, "fault": 1}, {1, 2}, {2}, True)
    log_index.compact(spark, root)
    assert state() == ({"disk": 2, "error": 1, "fault": 1}, {1, 2}, {2}, True)
    log_index.append(spark.createDataFrame([("error", 3)], schema), root)
    assert state()[0] == {"disk": 2, "error": 2, "fault": 1}
    # postings whose batch has no dictionary yet don't count
    spark.createDataFrame([("disk", 9, 0)], schema + ", shard int").write.partitionBy("shard").parquet(f"{root}/postings/kind=batch/n=99")
    assert log_index.postings(spark, root).filter("doc_id = 9").count() == 0


def test_log_index_makes_grams_from_words_without_comparing_them(spark, monkeypatch):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    compared, write = [], log_index._write

    def noted(rows, path, key):
        if key == "gram":
            compared.append("Aggregate" in rows._jdf.queryExecution().optimizedPlan().toString())
        write(rows, path, key)

    monkeypatch.setattr(log_index, "_write", noted)
    for rows in ([("disk", 1), ("fault", 1)], [("disk", 2), ("error", 2)]):
        log_index.append(spark.createDataFrame(rows, "token string, doc_id long"), root)
    log_index.compact(spark, root)
    assert compared == [False] * 3
    assert sorted((r.gram, r.token) for r in log_index.grams(spark, root).collect()) == sorted((f"${t}$"[i : i + 3], t) for t in ("disk", "fault", "error") for i in range(len(t)))
    assert {r.token: r.frequency for r in log_index.dictionary(spark, root).collect()} == {"disk": 2, "fault": 1, "error": 1}


def test_an_index_without_batches_finds_nothing(spark):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    assert log_index.boolean_search(spark, root, "x").count() == 0 and log_index.wildcard_search(spark, root, "x$").count() == 0


def test_entry_tokens_with_system_fields_and_hooks(spark):
    logs = spark.createDataFrame([(1, {"$time": "120001", "$level": "warn", "$src": "", "user": "7", "note": None}), (2, {"$time": "soon"}), (3, None)], "doc_id long, data map<string,string>")
    assert {(r.token, r.doc_id) for r in search.entry_tokens(logs).collect()} == {(t, 1) for t in ("2", "warn", "user", "7", "note")}
    kept = search.entry_tokens(logs, tokenizer=F.map_keys, linguistics=lambda w: F.when(~w.startswith("$"), F.upper(w)))
    assert {r.token for r in kept.collect()} == {"USER", "NOTE"}


def test_files(spark, tmp_path):
    for name, data in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.bin", b"\0")):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    old = files.contents(spark, str(tmp_path)).drop("content")
    before = spark.createDataFrame(old.collect(), old.schema)
    assert {(r.name, r.length) for r in files.listing(spark, str(tmp_path), "*.txt").collect()} == {("a.txt", 3), ("b.txt", 3)}
    (tmp_path / "a.txt").write_bytes(b"three")
    (tmp_path / "c.bin").unlink()
    (tmp_path / "d.txt").write_bytes(b"new")
    (tmp_path / "e.txt").write_bytes(b"")
    found = {(r.path.rsplit("/", 1)[1], r.change) for r in files.differences(before, files.contents(spark, str(tmp_path)).drop("content")).collect()}
    assert found == {("a.txt", "changed"), ("c.bin", "removed"), ("d.txt", "added")}
    q = files.arrivals(spark, str(tmp_path), "*.txt").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.name for r in spark.sql("SELECT name FROM arrived").collect()} == {"a.txt", "d.txt"}


def test_super_transaction(spark):
    kv = spark.createDataFrame([(1, 1.0, 2, 0), (2, 2.0, 4, 0), (3, 3.0, 2, 0)], ROW)
    other = kv.limit(0)
    add = lambda t: {"a": t["a"].filter("key < 3").select("key", (F.col("value") + 10).alias("value")), "b": t["a"].filter("key = 3").select("key", "value")}
    drop = lambda t: {"a": t["a"].filter("value = 11").select("key", F.lit(None).cast("double").alias("value")), "b": t["b"].select("key", (F.col("value") * 2).alias("value"))}
    done, applied = merge.super_transaction({"a": kv, "b": other}, [add, drop], 5)
    assert applied and {tuple(r) for r in done["a"].collect()} == {(2, 12.0, 5, 5), (3, 3.0, 2, 0)} and [tuple(r) for r in done["b"].collect()] == [(3, 6.0, 2, 5)]
    done, applied = merge.super_transaction({"a": kv, "b": other}, [add, lambda t: None], 5)
    assert not applied and done["a"] is kv and done["b"] is other


def test_dynamic_write_and_counts(spark):
    kv = spark.createDataFrame([(1, 1.0, 2, 3), (2, 2.0, 4, 3), (3, 3.0, 2, 3)], ROW)
    keys = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "key long")
    decide = lambda v, vsn, t: (F.when(v == 1, "delete").when(v.isNull(), "update").otherwise("keep"), F.lit(7.0), F.when(v.isNull() | (v > 1), vsn * 100))
    after, replies = merge.dynamic_write(kv, keys, decide, 8)
    assert {tuple(r) for r in after.collect()} == {(2, 2.0, 4, 3), (3, 3.0, 2, 3), (9, 7.0, 2, 8)}
    assert {tuple(r) for r in replies.collect()} == {(2, 400, 4, 3), (9, 100, 2, 8)}
    assert tuple(merge.restore_counts(kv, kv.filter("key > 1").selectExpr("key * 3 AS key", "value", "vsn", "time")).first()) == (2, 0, 3)


def test_passwords_and_probes(spark):
    row = spark.range(1).select(S.password(F.lit(""), [1]).alias("a"), S.password(F.lit("x"), []).alias("b"), S.double_hash(F.lit(100), 7, F.lit(2)).alias("c")).first()
    assert tuple(row) == ("", "none", (100 % 7 + 2 * (1 + 100 % 6)) % 7)
